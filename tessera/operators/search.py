"""Ranked symbol search, resolution, workspace search and exploration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.schema import WORKSPACE_KINDS

MOST = 100_000


class NotFound(LookupError):
    pass


class Ambiguous(LookupError):
    pass


@dataclass(frozen=True)
class Found:
    """rows, in order of `pos`, and whether any limit cut them."""

    rows: DataFrame
    truncated: bool


def bounded(limit: int) -> int:
    if not 1 <= limit <= MOST:
        raise ValueError(f"a limit is 1 to {MOST}")
    return limit


def postings(symbols: DataFrame) -> DataFrame:
    """(token, id): one row for each token of each symbol."""
    return symbols.select(F.explode(T.symbol_tokens(F.col("display_name"), F.col("search_terms"))).alias("token"), "id")


def find_symbols(symbols: DataFrame, query: str, limit: int = 50, index: DataFrame | None = None) -> DataFrame:
    """Matches of a query, best first, as columns rank, pos and the symbol's own.

    Rank 0 is an equal id or stable name, 1 an equal normalized name, 2 a prefix of
    it, 3 a token's prefix. Candidates are bounded for each way of matching."""
    bounded(limit)
    wanted = query.strip().lower()
    index = index if index is not None else postings(symbols)
    exact = symbols.where(F.col("id") == query).select("id")
    stable = symbols.where(F.col("stable_name") == query).select("id").orderBy("id").limit(limit + 1)
    name = symbols.where(F.col("normalized_name").startswith(wanted)).select("normalized_name", "id").orderBy("normalized_name", "id").limit(4 * limit + 1).select("id")
    token = index.where(F.col("token").startswith(wanted)).orderBy("token", "id").limit(4 * limit + 1).select("id")
    ids = exact.unionByName(stable).unionByName(name).unionByName(token).distinct()
    rank = F.when((F.col("id") == query) | (F.col("stable_name") == query), 0).when(F.col("normalized_name") == wanted, 1).when(F.col("normalized_name").startswith(wanted), 2).otherwise(3)
    best = symbols.join(F.broadcast(ids), "id").withColumn("rank", rank)  # at most 9 * limit + 4 ids
    order = ["rank", "normalized_name", "id"]
    top = best.orderBy(*order).limit(limit)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order)))  # limit rows


def find_truncated(symbols: DataFrame, query: str, limit: int, index: DataFrame | None = None) -> bool:
    """Whether a way of matching met its bound, or more than limit symbols matched."""
    wanted = query.strip().lower()
    index = index if index is not None else postings(symbols)
    stable = symbols.where(F.col("stable_name") == query).limit(limit + 1).count()
    name = symbols.where(F.col("normalized_name").startswith(wanted)).limit(4 * limit + 1).count()
    token = index.where(F.col("token").startswith(wanted)).limit(4 * limit + 1).count()
    return stable > limit or name > 4 * limit or token > 4 * limit or find_symbols(symbols, query, min(MOST, limit + 1), index).count() > limit


def _qualified(found: list[Row], value: str) -> list[Row]:
    import re

    infix = re.compile(r"\.(?:" + "|".join(T.INFIXES) + r")\.")
    human = lambda r: infix.sub(".", r["stable_name"])
    return [r for r in found if human(r) == value or human(r).endswith("." + value)]


def _qualified_match(symbols: DataFrame, value: str, found: list[Row], index: DataFrame | None) -> Row | None:
    hits, last = _qualified(found, value), T.terminal_name(value)
    if not hits and last != value:
        hits = _qualified(find_symbols(symbols, last, 512, index).orderBy("pos").collect(), value)
    if len(hits) > 1:
        raise Ambiguous(_choices(value, hits))
    return hits[0] if hits else None


def _choices(value: str, rows: list[Row]) -> str:
    shown = ", ".join(f'"{r["stable_name"] or r["display_name"]}" ({r["kind"]}, id {r["id"]})' for r in rows[:5])
    return f"{value!r} matches {shown}" + (f", and {len(rows) - 5} more" if len(rows) > 5 else "")


def resolve(symbols: DataFrame, value: str, index: DataFrame | None = None) -> Row:
    """The best match: an id, else a qualified name, else the first that search finds."""
    if hit := symbols.where(F.col("id") == value).head(1):
        return hit[0]
    found = find_symbols(symbols, value, 8, index).orderBy("pos").collect()
    if T.terminal_name(value) != value and (hit := _qualified_match(symbols, value, found, index)):
        return hit
    if not found:
        raise NotFound(value)
    return found[0]


def resolve_unique(symbols: DataFrame, value: str, index: DataFrame | None = None) -> Row:
    """The only match: an id, one stable name, one qualified name, or one match at all."""
    if hit := symbols.where(F.col("id") == value).head(1):
        return hit[0]
    found = find_symbols(symbols, value, 8, index).orderBy("pos").collect()
    exact = [r for r in found if r["stable_name"] == value]
    if len(exact) == 1:
        return exact[0]
    if hit := _qualified_match(symbols, value, found, index):
        return hit
    if not found:
        raise NotFound(value)
    if len(found) > 1:
        raise Ambiguous(_choices(value, found))
    return found[0]


def phrase_terms(symbols: DataFrame, phrase: str) -> list[str]:
    """The search terms of a phrase, as they are taken from texts."""
    return symbols.sparkSession.range(1).select(T.search_terms(F.lit(phrase))).first()[0]


def workspace_find(symbols: DataFrame, phrase: str, limit: int = 50, kinds: list[str] | None = None, index: DataFrame | None = None) -> DataFrame:
    """Symbols of workspace kinds that match every term of a phrase; score is the
    sum of their places in the terms' own results, which count all kinds. A phrase of
    one word or one term is searched as it is."""
    bounded(limit)
    kinds, candidates = kinds or WORKSPACE_KINDS, min(MOST, max(1024, 16 * limit))
    terms = phrase_terms(symbols, phrase)
    if len(phrase.split()) <= 1 or len(terms) <= 1:
        found = find_symbols(symbols, phrase, candidates, index).where(F.col("kind").isin(kinds))
        return found.orderBy("pos").limit(limit).withColumn("score", F.col("pos") - 1).withColumn("place", F.row_number().over(Window.orderBy("pos")))
    index = index if index is not None else postings(symbols)
    each = None
    for term in terms:
        hits = find_symbols(symbols, term, candidates, index).select("id", "pos", "kind", F.lit(term).alias("term"))
        each = hits if each is None else each.unionByName(hits)
    both = each.where(F.col("kind").isin(kinds)).groupBy("id").agg(F.count_distinct("term").alias("n"), F.sum(F.col("pos") - 1).alias("score")).where(F.col("n") == len(terms))
    order = ["score", "stable_name", "id"]
    return symbols.join(both.select("id", "score"), "id").orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def resolve_workspace(symbols: DataFrame, value: str, index: DataFrame | None = None) -> Row:
    """The workspace entity of an id, else of one equal stable name, else the only match."""
    if hit := symbols.where((F.col("id") == value) & F.col("kind").isin(WORKSPACE_KINDS)).head(1):
        return hit[0]
    found = workspace_find(symbols, value, 64, index=index).orderBy("place").collect()
    exact = [r for r in found if r["stable_name"] == value]
    if len(exact) == 1:
        return exact[0]
    if not found:
        raise NotFound(value)
    if len(exact) > 1 or len(found) > 1:
        raise Ambiguous(_choices(value, exact or found))
    return found[0]


# Exploration. Words without meaning for a search, and words that name a scope.
STOP = [
    "a", "an", "and", "are", "as", "at", "alone", "be", "by", "can", "cannot", "describe", "direct", "does", "evaluate", "explain", "feed", "from", "how", "identify", "in", "initial", "into", "is", "it",
    "limitations", "of", "on", "or", "should", "that", "the", "this", "through", "to", "tool", "using", "what", "when", "where", "which", "why", "with",
]
SCOPE = ["backend", "code", "data", "domain", "flow", "function", "gui", "menu", "method", "persistence", "public", "request", "state", "system", "tui"]
# Scores by kind, by number of matches, and of scope words.
KIND_SCORE = {"function": 100, "method": 100, "type": 40, "interface": 40, "test": 40, "section": 40, "code-block": 20, "field": -10, "constant": -10, "route": -10, "variable": -20, "parameter": -20, "asset": -30, "directory": -30, "url": -30, "package": -10, "file": -10, "document": -10}
RARITY = [(4, 30), (16, 18), (64, 10), (256, 4)]
SCOPE_SCORE = {"menu": 30, "gui": 8, "tui": 8, "domain": 4, "persistence": 4}


def explore_terms(phrase: str) -> list[str]:
    import re

    words = re.findall(r"[^\W]+", phrase.lower())
    kept = list(dict.fromkeys(w for w in words if len(w.encode()) >= 3 and w not in STOP))[:32]
    return kept or [phrase.strip()]


def variants(term: str) -> list[str]:
    """A term and what it may be without its suffix."""
    n, out = len(term.encode()), {term}
    if term.endswith("ed") and n > 4:
        out |= {term[:-1], term[:-2], term[:-2] + "s"}
    elif term.endswith("ing") and n > 5:
        out |= {term[:-3], term[:-3] + "e"}
    elif term.endswith("ies") and n > 4:
        out |= {term[:-3] + "y", term[:-1]}
    elif term.endswith("es") and n > 4:
        out |= {term[:-2], term[:-1]}
    elif term.endswith("s") and n > 4:
        out |= {term[:-1]}
    return sorted(out)


def _lookup(pairs: dict, column: Column, default: int) -> Column:
    out = F.lit(default)
    for k, v in pairs.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def name_score(display: Column, kind: Column, term: str, primary: bool) -> Column:
    name = F.lower(display)
    equal = (200 - F.when(F.substring(name, 1, 1).rlike(r"^\p{Ll}"), 120).otherwise(0)) if primary else F.lit(35)
    part = ~kind.isin("package", "file") & name.contains(term)
    return F.when(name == term, equal).when(part, 60 if primary else 10).otherwise(0)


def explore(symbols: DataFrame, phrase: str, limit: int = 8, index: DataFrame | None = None) -> DataFrame:
    """Symbols that answer a phrase, by score: each term's best match over its
    variants, summed, with scores for kind, coverage, specificity and scope; then
    repeated containers and names go behind the rest. The best section's document, named
    domains and the surfaces `gui` and `tui` shape the result as well."""
    from tessera.sources.store import spooled

    terms = explore_terms(phrase)
    asked = [t for t in terms if t not in SCOPE or t in ("gui", "tui")] or terms
    fetch = min(512, max(16 * limit, 64))
    index = index if index is not None else postings(symbols)
    matches = None
    for term in asked:
        for v in variants(term):
            found = find_symbols(symbols, v, fetch, index)
            n = F.count("*").over(Window.partitionBy())  # of at most `fetch` rows
            rarity = F.lit(1)
            for most, score in reversed(RARITY):
                rarity = F.when(n <= most, score).otherwise(rarity)
            rarity = F.when(F.lit(find_truncated(symbols, v, fetch, index)), 1).otherwise(rarity)
            score = F.greatest(F.lit(1), 5 - F.floor((F.col("pos") - 1) / 8)) + rarity + name_score(F.col("display_name"), F.col("kind"), v, len(terms) <= 12 and term == asked[0])
            part = found.select("id", F.lit(term).alias("term"), score.cast("int").alias("score"))
            matches = part if matches is None else matches.unionByName(part)
    base = matches.groupBy("id", "term").agg(F.max("score").alias("score")).groupBy("id").agg(F.sum("score").alias("base"))
    rows = symbols.join(F.broadcast(base), "id")  # at most `fetch` rows a variant
    covered = sum((F.arrays_overlap("search_terms", F.array(*map(F.lit, variants(t)))).cast("int") for t in asked), F.lit(0))
    stable, size, kind = F.lower("stable_name"), F.size("search_terms"), F.col("kind")
    score = F.col("base") + _lookup(KIND_SCORE, kind, 0) + 10 * covered
    score += F.when((covered >= 3) & (covered == len(asked)) & (size <= max(256, 32 * len(asked))), 100).otherwise(0)
    wide = F.when(kind.isin("section", "document", "code-block"), F.least(F.lit(600), F.floor(F.greatest(F.lit(0), size - 64) / 4))).when(kind == "file", F.least(F.lit(300), F.floor(F.greatest(F.lit(0), size - 256) / 8))).otherwise(0)
    score -= wide + F.when(F.col("evidence") == "generated", 80).otherwise(0) + F.when(F.col("display_name").startswith("Test"), 40).otherwise(0)
    for t in terms:
        score += F.when(stable.contains(t), 8 + (SCOPE_SCORE.get(t, 2) if t in SCOPE else 0)).otherwise(0)
    rows = spooled(rows.select("id", "kind", "stable_name", "display_name", score.cast("int").alias("score")))
    rows = _in_domains(_in_document(rows), terms)
    order, stable, kind = [F.desc("score"), "stable_name", "id"], F.col("stable_name"), F.col("kind")
    container = F.when(F.instr(stable, ".method.") > 0, F.substring_index(stable, ".method.", 1)).otherwise(F.col("id"))
    label = F.when(kind.isin("section", "document"), F.lower("display_name")).otherwise(F.col("id"))
    rows = rows.withColumn("again", (F.row_number().over(Window.partitionBy(container).orderBy(*order)) > 1).cast("int"))
    rows = rows.withColumn("same", (F.row_number().over(Window.partitionBy(label).orderBy("again", *order)) > 1).cast("int"))
    final, columns = ["same", "again", *order], ["pos", "id", "kind", "stable_name", "display_name", "score"]
    scopes = [x for x in ("gui", "tui") if x in terms]
    if limit < 2 or not scopes:
        return rows.orderBy(*final).limit(limit).withColumn("pos", F.row_number().over(Window.orderBy(*final))).select(*columns)
    ranked = rows.orderBy(*final).select(*columns[1:]).collect()  # no more than were fetched
    return rows.sparkSession.createDataFrame([(k + 1, *r) for k, r in enumerate(_with_scopes(ranked, scopes, terms, limit))], "pos int, id string, kind string, stable_name string, display_name string, score int")


def _in_document(rows: DataFrame) -> DataFrame:
    """rows, with 40 more for all of the best section's document if it has three of them."""
    path = F.substring_index("stable_name", "#", 1)
    best = rows.where(F.col("kind").isin("section", "document")).select(path.alias("path"), "score").orderBy(F.desc("score"), "path").head(1)
    if not best:
        return rows
    inside = (F.col("stable_name") == best[0]["path"]) | F.col("stable_name").startswith(best[0]["path"] + "#")
    return rows.withColumn("score", F.col("score") + F.when(inside, 40).otherwise(0)) if rows.where(inside).count() >= 3 else rows


def _in_domains(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Where terms name domains, the rows of these and those of a rare name that is a
    term's own; all rows if these are fewer than two."""
    domain = F.when(F.instr("stable_name", "/domains/") > 0, F.regexp_extract("stable_name", r"/domains/([^/.]*)", 1)).otherwise("")
    known = [r[0] for r in rows.select(domain.alias("d")).distinct().where("d <> ''").collect()]  # no more than were fetched
    asked = [d for d in known if any(d == t or d.removesuffix("s") == t.removesuffix("s") for t in terms)]
    if not asked:
        return rows
    names = sorted({v for t in terms for v in variants(t)})
    # A variant that several terms have counts for each of them.
    times = {v: sum(v in variants(t) for t in terms) for v in names}
    counts = rows.where(F.lower("display_name").isin(names)).groupBy(F.lower("display_name").alias("name")).agg(F.count("*").alias("n")).collect()
    rare = [r["name"] for r in counts if r["n"] * times[r["name"]] <= 2]
    kept = rows.where(domain.isin(asked) | F.lower("display_name").isin(rare))
    return kept if kept.limit(2).count() == 2 else rows


def _with_scopes(ranked: list[Row], scopes: list[str], terms: list[str], limit: int) -> list[Row]:
    """The first `limit`, in which each scope asked for has a place if anything is of it."""
    out = list(ranked)
    if len(out) > limit:
        main = next((t for t in terms if t not in SCOPE), "")
        for scope in scopes:
            of = lambda r: f"/surfaces/{scope}." in r["stable_name"].lower() or f"/surfaces/{scope}/" in r["stable_name"].lower()  # noqa: B023, E731
            said = lambda r: main != "" and (main in r["display_name"].lower() or main in r["stable_name"].lower())
            if any(map(of, out[:limit])):
                continue
            rest = [k for k in range(limit, len(out)) if of(out[k])]
            if rest:
                k = next((k for k in rest if said(out[k])), rest[0])
                out[limit - 1], out[k] = out[k], out[limit - 1]
    return out[:limit]
