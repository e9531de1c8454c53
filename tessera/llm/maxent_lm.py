"""Language-model scoring by a hashed maximum-entropy model.

Tokens are dealt to SLOTS slots: each of the HEADS most frequent has one of its own,
the others share the rest by their last bytes. Slots are dealt to CLASSES classes of
like mass, and

    P(token | history) = P(class | history) * P(slot | class, history) * P(token | slot).

Both softmaxes sum weight rows of hashed features of the history: the slot before (an
n-gram), the one before that (a skip), and the two together; within a class the
features are hashed with the class. P(token | slot) is 1 for a slot of one
token, and else a discounted share of the corpus counts, whose rest is for all tokens
never seen; so the chances of all tokens of any history sum to one.

Weights are trained by gradient steps on all training documents, ROUNDS times over:
tasks step through their part of the documents' slots, and the next round starts from
the average of their weights, weighted by tokens. Scoring runs in numpy batches.

Tokens are known by 64-bit hashes. Counts cover every training document, and are
joined to blocks of documents (of BLOCK_BYTES on average), never broadcast; what is
broadcast is the weights, and the heads and mass of the slots. Defined results: a null
or empty text is the end token alone; with no training document all counts are 0;
equal rows get equal scores; null ids count as the text 'null' for the split; an empty
table gives none; further columns are ignored.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, giving_back, held_out, lower_ascii, mix, prefix_sums, rows_by_size, span_hash, spool, table, unspool, utf8, word_spans

CLASSES, MEMBERS, TAILS = 32, 32, 256
SLOTS, HEADS = CLASSES * MEMBERS, CLASSES * MEMBERS - TAILS
ROUNDS, BATCH, CHUNK, RATE = 2, 32768, 1024, 0.25
#: Weight rows: two features of single slots (and of the start), then hashed pairs; in classes, hashed all.
PAIRS, INNER = 4096, 8192
OUTER_ROWS, INNER_ROWS = (SLOTS + 1, SLOTS + 1, PAIRS), (INNER, INNER)
BLOCK_BYTES, COUNT_BYTES, PIECE, TOGETHER = 12 << 20, 4 << 20, 1 << 20, 1 << 16
END, START = np.uint64(1), SLOTS
CHUNKS = 32


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of a text's tokens, the end included; a hash's last bits say which of the
    TAILS slots its token has unless it has one of its own."""
    return tokens_of([text])[0]


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of some texts, one text after another, and how many each has. Short
    texts are read together, with spaces between; long ones in pieces that end at words."""
    parts, sizes, k = [], [], 0
    while k < len(texts):
        here, size = [], 0
        while k < len(texts) and (not here or size + len(texts[k] or b"") < TOGETHER):
            here.append(texts[k] or b"")
            size, k = size + len(here[-1]) + 1, k + 1
        h, starts = _words(b" ".join(here))
        ends = np.cumsum([len(x) + 1 for x in here])
        cuts = np.searchsorted(starts, ends)
        parts.append(np.insert(h, cuts, END))
        sizes.append(np.diff(cuts, prepend=0) + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(sizes)


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and where they start."""
    at, out, starts = 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        data = lower_ascii(np.frombuffer(raw, np.uint8, end - at, at))
        s, e = word_spans(data)
        shape = data[e - 1].astype(np.uint64)
        for k in (2, 3):
            shape = shape << np.uint64(8) | np.where(e - k >= s, data[np.maximum(e - k, 0)], 0).astype(np.uint64)
        out.append(span_hash(prefix_sums(data), s, e) & ~np.uint64(TAILS - 1) | mix(shape) % np.uint64(TAILS))
        starts.append(s + at)
        at = end
    return np.concatenate(out), np.concatenate(starts)


@dataclasses.dataclass
class Slots:
    """Which slot a token has, and what is known of the slots."""

    heads: np.ndarray  # hashes in order
    of_head: np.ndarray  # their slots
    of_tail: np.ndarray  # slots by a hash's last bits
    mass: np.ndarray  # training tokens by slot
    kinds: np.ndarray  # different ones among them; 0 for the slots of heads
    discount: float

    def of(self, h: np.ndarray) -> np.ndarray:
        tail = self.of_tail[(h & np.uint64(TAILS - 1)).astype(np.int64)]
        if not len(self.heads):
            return tail
        at = np.minimum(np.searchsorted(self.heads, h), len(self.heads) - 1)
        return np.where(self.heads[at] == h, self.of_head[at], tail)

    def shares(self, slot: np.ndarray, found: np.ndarray) -> np.ndarray:
        """P(token | slot) of tokens that were counted `found` times; all that were never
        seen are one."""
        n, v = self.mass[slot], self.kinds[slot]
        seen = np.where(v > 0, (found - self.discount) / np.maximum(n, 1), 1)
        return np.where((found > 0) | (n == 0), np.where(n == 0, 1.0, seen), self.discount * v / np.maximum(n, 1))


def deal(heads: np.ndarray, head_mass: np.ndarray, tail_mass: np.ndarray, tail_kinds: np.ndarray, discount: float) -> Slots:
    """Slots in the order of their mass go to the classes to and fro, so that the
    classes' masses are alike."""
    mass = np.concatenate([head_mass, np.zeros(HEADS - len(heads)), tail_mass])
    rank = np.empty(SLOTS, np.int64)
    rank[np.argsort(-mass, kind="stable")] = np.arange(SLOTS)
    turn, place = np.divmod(rank, CLASSES)
    slot = np.where(turn % 2, CLASSES - 1 - place, place) * MEMBERS + turn
    by_slot, kinds = np.zeros(SLOTS), np.zeros(SLOTS)
    by_slot[slot] = mass
    kinds[slot[HEADS:]] = tail_kinds
    by = np.argsort(heads)
    return Slots(heads[by], slot[: len(heads)][by], slot[HEADS:], by_slot, kinds, discount)


def features(slots: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a run of slots in which START stands before each text: the places of tokens,
    and the weight row of each feature (of OUTER_ROWS rows)."""
    at = np.flatnonzero(slots != START)
    one = slots[at - 1]
    two = np.where(one == START, START, slots[np.maximum(at - 2, 0)])
    return at, [one.astype(np.uint16), two.astype(np.uint16), _hashed(one, two, PAIRS)]


def _hashed(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    return (mix(a.astype(np.uint64) << np.uint64(16) | b.astype(np.uint64)) % np.uint64(size)).astype(np.uint16)


def inner_rows(rows: list[np.ndarray], classes: np.ndarray) -> list[np.ndarray]:
    """The weight rows within a class: the slot before and that before it, with the class."""
    return [_hashed(r, classes, INNER) for r in rows[:2]]


def chunks(n: int) -> list[slice]:
    """Runs of CHUNK rows, whose logits stay in a processor's cache."""
    return [slice(k, k + CHUNK) for k in range(0, n, CHUNK)]


def logits(rows: list[np.ndarray], weights: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """The summed weight rows and the bias (one row, or one each), less the greatest of each
    row; a column for each row, so that sums over a row are sums of vectors."""
    z = np.take(weights[0], rows[0], 0, mode="clip")
    for r, w in zip(rows[1:], weights[1:], strict=True):
        z += np.take(w, r, 0, mode="clip")
    z += bias
    z = np.ascontiguousarray(z.T)
    z -= z.max(0)
    return z


def chances(rows: list[np.ndarray], weights: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """The softmax of the logits, a column for each row."""
    p = logits(rows, weights, bias)
    np.exp(p, out=p)
    p /= p.sum(0)
    return p


def chosen_log(rows: list[np.ndarray], weights: list[np.ndarray], bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The natural log of the softmax at each row's target."""
    out = np.empty(len(target))
    for k in chunks(len(target)):
        z = logits([r[k] for r in rows], weights, bias if bias.ndim == 1 else bias[k])
        out[k] = z[target[k], np.arange(z.shape[1])] - np.log(np.exp(z).sum(0))
    return out


@dataclasses.dataclass
class Model:
    outer: list[np.ndarray]  # OUTER_ROWS x CLASSES
    inner: list[np.ndarray]  # INNER_ROWS x MEMBERS
    class_bias: np.ndarray
    slot_bias: np.ndarray  # CLASSES x MEMBERS

    @staticmethod
    def flat(mass: np.ndarray) -> Model:
        m = (mass + 0.5).reshape(CLASSES, MEMBERS)
        outer, inner = [np.zeros((n, CLASSES), np.float32) for n in OUTER_ROWS], [np.zeros((n, MEMBERS), np.float32) for n in INNER_ROWS]
        return Model(outer, inner, np.log(m.sum(1) / m.sum()).astype(np.float32), np.log(m / m.sum(1, keepdims=True)).astype(np.float32))

    def slot_logs(self, rows: list[np.ndarray], slots: np.ndarray) -> np.ndarray:
        """Natural log of P(class | history) * P(slot | class, history)."""
        c, m = np.divmod(slots.astype(np.int64), MEMBERS)
        return chosen_log(rows, self.outer, self.class_bias, c) + chosen_log(inner_rows(rows, c), self.inner, self.slot_bias[c], m)


class Learner:
    """Adagrad on both softmaxes."""

    def __init__(self, model: Model):
        self.model = dataclasses.replace(model, outer=[w.copy() for w in model.outer], inner=[w.copy() for w in model.inner])
        self.seen, self.tokens = [np.ones(n, np.float32) for n in OUTER_ROWS + INNER_ROWS], 0

    def step(self, rows: list[np.ndarray], slots: np.ndarray) -> None:
        c, m = np.divmod(slots.astype(np.int64), MEMBERS)
        seen = iter(self.seen)
        columns, each = np.empty((CLASSES, len(c))), np.arange(CHUNK)
        for r, weights, bias, target in ((rows, self.model.outer, self.model.class_bias, c), (inner_rows(rows, c), self.model.inner, self.model.slot_bias[c], m)):
            for k in chunks(len(c)):
                error = chances([x[k] for x in r], weights, bias if bias.ndim == 1 else bias[k])
                error[target[k], each[: error.shape[1]]] -= 1
                columns[:, k] = error
            for ids, w, n in zip(r, weights, seen, strict=False):
                ids = ids.astype(np.intp)
                g = np.empty((CLASSES, len(w)), np.float32)
                for k, x in enumerate(columns):
                    g[k] = np.bincount(ids, x, len(w))
                g = np.ascontiguousarray(g.T)
                n += np.einsum("ij,ij->i", g, g) / g.shape[1]
                g *= (RATE / np.sqrt(n))[:, None]
                w -= g
        self.tokens += len(slots)


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out and block of all rows: neighbours in the table are a block."""
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size, n = frame.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    rows = max(1, BLOCK_BYTES * n // max(size or 0, 1))
    return spool(frame.select("*", held_out(7, 2).alias("held_out"), F.expr(f"monotonically_increasing_id() div {rows}").alias("block")))


def count_tokens(rows: DataFrame) -> DataFrame:
    """(block, h, c): the tokens of each block's rows and how often its training rows
    have them, 0 if only others do. A token may come twice in a block."""

    def each(batches):
        for batch in batches:
            for piece in rows_by_size(batch, "text", COUNT_BYTES):
                blocks, held = piece.column("block").to_numpy(), piece.column("held_out").to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    all_of, sizes = tokens_of(utf8(piece.column("text").slice(a, b - a)))
                    out = np.repeat(held[a:b], sizes)
                    h, c = np.unique(all_of[~out], return_counts=True)
                    other = np.setdiff1d(np.unique(all_of[out]), h, assume_unique=True)
                    h, c = np.concatenate([h, other]).view(np.int64), np.concatenate([c, np.zeros(len(other), np.int64)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), blocks[a])), pa.array(h), pa.array(c)], names=["block", "h", "c"])

    return rows.select("block", "held_out", "text").mapInArrow(giving_back(each), "block long, h long, c long")


def learn_slots(counts: DataFrame) -> Slots:
    """The heads, at most HEADS rows, and the mass of each of the TAILS other slots."""
    heads = counts.orderBy(F.desc("c"), "h").limit(HEADS).toPandas()
    known, tail = F.broadcast(counts.sparkSession.createDataFrame([(int(h),) for h in heads["h"]], "h long")), F.col("h").bitwiseAND(TAILS - 1)
    rest = counts.join(known, "h", "left_anti").groupBy(tail.alias("tail")).agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).toPandas()
    mass, kinds = np.zeros(TAILS), np.zeros(TAILS)
    mass[rest["tail"].to_numpy(int)], kinds[rest["tail"].to_numpy(int)] = rest["n"], rest["v"]
    once, twice = int(rest["once"].sum()), int(rest["twice"].sum())
    return deal(heads["h"].to_numpy(np.int64).view(np.uint64), heads["c"].to_numpy(float), mass, kinds, min(0.9, max(0.1, once / max(1, once + 2 * twice))))


def slots_of(rows: DataFrame, slots: Slots) -> DataFrame:
    """The training texts as runs of two-byte slots, START before each."""
    sent = rows.sparkSession.sparkContext.broadcast(slots)

    def each(batch):
        h, sizes = tokens_of(utf8(batch.column("text")))
        return {"run": [np.insert(sent.value.of(h).astype(np.uint16), np.cumsum(sizes) - sizes, START).tobytes()]}

    return arrow_map(rows.where("NOT held_out").where("text IS NOT NULL").select("text"), each, "run binary", limit=COUNT_BYTES)


def train_round(runs: DataFrame, model: Model) -> Model:
    """One pass of distributed gradient steps; the tasks' average is returned."""
    sent = runs.sparkSession.sparkContext.broadcast(model)

    def learn(batches):
        learner = Learner(sent.value)
        for batch in batches:
            for run in utf8(batch.column("run")):
                run = np.frombuffer(run, np.uint16)
                at, rows = features(run)
                for k in range(0, len(at), BATCH):
                    learner.step([r[k : k + BATCH] for r in rows], run[at[k : k + BATCH]])
        if learner.tokens:
            all_of = np.concatenate([*learner.model.outer, *learner.model.inner])
            parts = [p.astype(np.float16).tobytes() for p in np.array_split(all_of, CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([float(learner.tokens)] * CHUNKS), pa.array(parts, pa.binary())], names=["chunk", "n", "w"])

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for chunk, n, w in zip(*(batch.column(k).to_pylist() for k in ("chunk", "n", "w")), strict=True):
                x = np.frombuffer(w, np.float16).astype(np.float32) * np.float32(n)
                have = sums.setdefault(chunk, [0.0, np.zeros(len(x), np.float32)])
                have[0] += n
                have[1] += x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.float64()), pa.array([(x / np.float32(n)).astype(np.float16).tobytes() for n, x in sums.values()], pa.binary())], names=["chunk", "n", "w"])

    schema = "chunk int, n double, w binary"
    got = runs.mapInArrow(learn, schema)
    got = got.repartition(CHUNKS * 4, "chunk", F.col("n").cast("long") % 8).mapInArrow(add, schema)  # two steps, so no task adds all
    got = got.repartition(CHUNKS, "chunk").mapInArrow(add, schema).orderBy("chunk").collect()
    sent.unpersist()
    if not got:
        return model
    cuts = np.cumsum(OUTER_ROWS + INNER_ROWS)[:-1]
    tables = np.split(np.concatenate([np.frombuffer(r["w"], np.float16).astype(np.float32).reshape(-1, CLASSES) for r in got]), cuts)
    return dataclasses.replace(model, outer=tables[: len(OUTER_ROWS)], inner=tables[len(OUTER_ROWS) :])


def train(rows: DataFrame, counts: DataFrame) -> tuple[Slots, Model]:
    slots = learn_slots(counts)
    model, runs = Model.flat(slots.mass), spool(slots_of(rows, slots))
    for _ in range(ROUNDS):
        model = train_round(runs, model)
    unspool(runs)
    return slots, model


def text_logs(texts: list[bytes | None], count_of, slots: Slots, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: where each begins among their tokens, the counts of all tokens, and
    their log10 probabilities under the model."""
    h, sizes = tokens_of(texts)
    starts = np.cumsum(sizes) - sizes
    found, slot = count_of(h), slots.of(h)
    with_starts = np.insert(slot, starts, START)
    at, rows = features(with_starts)
    out = np.log10(slots.shares(slot, found))
    for k in range(0, len(at), BATCH):
        part = slice(k, k + BATCH)
        out[part] += model.slot_logs([r[part] for r in rows], slot[part]) / np.log(10)
    return starts, found, out


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    rows = _numbered(docs)
    met = spool(count_tokens(rows))
    counts = spool(met.groupBy("h").agg(F.sum("c").alias("c")).where("c > 0"))
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    trained = train(rows, counts)

    known = met.select("block", "h").join(counts, "h")
    sent = docs.sparkSession.sparkContext.broadcast(trained)
    score_schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        h = right.column("h").to_numpy().view(np.uint64)
        by = np.argsort(h)
        h, c = h[by], right.column("c").to_numpy()[by]

        def count_of(x):
            if not len(h):
                return np.zeros(len(x), np.int64)
            at = np.minimum(np.searchsorted(h, x), len(h) - 1)
            return np.where(h[at] == x, c[at], 0)

        out = []
        for batch in left.to_batches():
            for piece in rows_by_size(batch, "text", PIECE):
                starts, found, model_logs = text_logs(utf8(piece.column("text")), count_of, *sent.value)
                sizes = np.diff(np.append(starts, len(found)))
                add = lambda x: pa.array(np.add.reduceat(x, starts))  # noqa: B023, E731
                out.append(pa.table([piece.column("doc_id"), piece.column("held_out"), pa.array(sizes), add((found > 0).astype(np.int64)), pa.array(np.full(len(sizes), n)), add(np.log10((found + 1) / (n + 1 * (v + 1)))), add(model_logs)], schema=score_schema))
        return pa.concat_tables(out) if out else score_schema.empty_table()

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, ddl)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
