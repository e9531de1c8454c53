"""Extractors: facts from the text of schema, build, Markdown and Python files.

An extractor takes a path and a text and gives symbols and edges; `extract` runs
them over a table of files in Arrow batches. Targets that a file only names are
open ids, which need no symbol.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.schema import Facts, conform

MOST_BYTES = 2 << 20
SUFFIXES = {".proto": "protobuf", ".graphql": "graphql", ".gql": "graphql", ".sql": "sql-migrations", ".tf": "terraform", ".md": "markdown", ".markdown": "markdown", ".py": "python", ".csproj": "build", ".fsproj": "build"}
NAMES = {"go.mod": "build", "Cargo.toml": "build", "package.json": "build", "pom.xml": "build"}
OPENAPI = r"(?i)(^|/)[^/]*(openapi|swagger)[^/]*\.(json|ya?ml)$"


def category(path: Column) -> Column:
    """The kind of file that a path names, blank for others."""
    out = F.when(path.rlike(OPENAPI), "openapi")
    for name, kind in NAMES.items():
        out = out.when((path == name) | path.endswith(f"/{name}"), kind)
    for suffix, kind in SUFFIXES.items():
        out = out.when(F.lower(path).endswith(suffix), kind)
    return out.otherwise("")


class Sheet:
    """What an extractor writes on: symbols and edges of one file."""

    def __init__(self, kind: str, path: str, text: str):
        self.kind, self.path, self.text = kind, path, text
        self.symbols: dict[str, tuple] = {}
        self.edges: dict[str, tuple] = {}
        self.problems: list[str] = []
        self.file = self.symbol(path, f"{kind}-file", "", 1)

    def id(self, name: str) -> str:
        return f"{self.kind}:{self.path}#{name}" if name else f"{self.kind}:{self.path}"

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    def symbol(self, display: str, kind: str, name: str, line: int, owner: str = "") -> str:
        ident = self.id(name)
        self.symbols.setdefault(ident, (ident, f"{self.path}#{name}" if name else self.path, display, kind, line))
        if owner:
            self.edge(owner, "contains", ident, line)
        return ident

    def edge(self, source: str, kind: str, target: str, line: int, evidence: str = "declared") -> None:
        self.edges.setdefault(f"{source}|{kind}|{target}", (source, kind, target, line, evidence))


def _blank(text: str, *patterns: str) -> str:
    """text with comments and strings blanked, places kept."""
    for p in patterns:
        text = re.sub(p, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    return text


def _block(text: str, at: int) -> int:
    """The end of the braces that open at or after a place."""
    start = text.find("{", at)
    if start < 0:
        return len(text)
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return len(text)


def sql(s: Sheet) -> None:
    """Schemas, tables, columns, views, indexes, sequences, enums and functions."""
    code = _blank(s.text, r"--[^\n]*", r"/\*.*?\*/")
    name = r'((?:"[^"]+"|\w+)(?:\.(?:"[^"]+"|\w+))?)'
    clean = lambda n: n.replace('"', "").lower()
    at = 0
    for part in code.split(";"):
        line, body = s.line(at + len(part) - len(part.lstrip())), part.strip()
        at += len(part) + 1
        if not body:
            continue
        made = re.match(rf"CREATE\s+(?:OR\s+REPLACE\s+)?(?:UNIQUE\s+|TEMP(?:ORARY)?\s+|MATERIALIZED\s+)*(SCHEMA|TABLE|VIEW|INDEX|SEQUENCE|TYPE|FUNCTION)\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?{name}", body, re.I)
        changed = re.match(rf"ALTER\s+TABLE\s+(?:ONLY\s+)?(?:IF\s+EXISTS\s+)?{name}", body, re.I)
        if made:
            kind, target = made[1].lower(), clean(made[2])
            kind = "enum" if kind == "type" else kind
            me = s.symbol(target, f"sql-{kind}", target, line, s.file)
            if kind == "table":
                inner = body[body.find("(") + 1 : body.rfind(")")] if "(" in body else ""
                for item in re.split(r",(?![^()]*\))", inner):
                    m = re.match(r'\s*("[^"]+"|\w+)\s+\w', item)
                    if m and clean(m[1]) not in ("constraint", "primary", "foreign", "unique", "check", "exclude", "like"):
                        s.symbol(clean(m[1]), "sql-column", f"{target}.{clean(m[1])}", line, me)
                for m in re.finditer(rf"INHERITS\s*\(\s*{name}", body, re.I):
                    s.edge(me, "extends", f"open:sql:{clean(m[1])}", line)
            if kind == "enum":
                for m in re.finditer(r"'([^']*)'", body):
                    s.symbol(m[1], "sql-enum-value", f"{target}.{m[1]}", line, me)
            words = {"table": "REFERENCES", "index": "ON"}.get(kind, "FROM|JOIN")
            for m in re.finditer(rf"\b(?:{words})\s+(?:ONLY\s+)?{name}", body, re.I):
                s.edge(me, "depends-on", f"open:sql:{clean(m[1])}", line)
        elif changed:
            s.edge(s.file, "references", f"open:sql:{clean(changed[1])}", line)
            for m in re.finditer(rf"\bREFERENCES\s+{name}", body, re.I):
                s.edge(f"open:sql:{clean(changed[1])}", "depends-on", f"open:sql:{clean(m[1])}", line)
        elif not re.match(r"(INSERT|UPDATE|DELETE|SELECT|BEGIN|COMMIT|SET|COMMENT|GRANT|DROP)\b", body, re.I):
            s.problems.append(f"line {line}: statement isn't modelled")


def protobuf(s: Sheet) -> None:
    code = _blank(s.text, r"//[^\n]*", r"/\*.*?\*/")
    for m in re.finditer(r'\bimport\s+(?:public\s+|weak\s+)?"([^"]+)"', code):
        s.edge(s.file, "imports", f"protobuf:{m[1]}", s.line(m.start()))
    package = re.search(r"\bpackage\s+([\w.]+)\s*;", code)
    top = package[1] if package else ""
    if package:
        s.edge(s.file, "member-of", s.symbol(top, "protobuf-package", top, s.line(package.start())), s.line(package.start()))
    plain = {"double", "float", "int32", "int64", "uint32", "uint64", "sint32", "sint64", "fixed32", "fixed64", "sfixed32", "sfixed64", "bool", "string", "bytes"}

    def inside(start: int, end: int, prefix: str, owner: str) -> None:
        at = start
        while m := re.compile(r"\b(message|enum|service)\s+(\w+)\s*\{").search(code, at, end):
            name, stop = f"{prefix}.{m[2]}".lstrip("."), _block(code, m.end() - 1)
            me = s.symbol(m[2], f"protobuf-{m[1]}", name, s.line(m.start()), owner)
            own = code[m.end() : stop]
            if m[1] == "message":
                inside(m.end(), stop, name, me)
                flat = re.sub(r"\b(message|enum)\s+\w+\s*\{[^{}]*\}", lambda x: " " * len(x[0]), own)
                for f in re.finditer(r"(?:^|[;{}\n])\s*(?:optional\s+|repeated\s+|required\s+)?(?:map\s*<\s*\w+\s*,\s*([\w.]+)\s*>|([\w.]+))\s+(\w+)\s*=\s*\d+", flat):
                    field = s.symbol(f[3], "protobuf-field", f"{name}.{f[3]}", s.line(m.end() + f.start(3)), me)
                    kind = f[1] or f[2]
                    if kind not in plain:
                        s.edge(field, "references", f"open:protobuf:{kind}", s.line(m.end() + f.start(3)))
            elif m[1] == "enum":
                for f in re.finditer(r"(\w+)\s*=\s*-?\d+", own):
                    s.symbol(f[1], "protobuf-enum-value", f"{name}.{f[1]}", s.line(m.end() + f.start()), me)
            else:
                for f in re.finditer(r"\brpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)", own):
                    rpc = s.symbol(f[1], "protobuf-rpc", f"{name}.{f[1]}", s.line(m.end() + f.start()), me)
                    for kind in (f[2], f[3]):
                        s.edge(rpc, "references", f"open:protobuf:{kind}", s.line(m.end() + f.start()))
            at = stop

    inside(0, len(code), top, s.file)


def graphql(s: Sheet) -> None:
    code = _blank(s.text, r'""".*?"""', r"#[^\n]*")
    plain = {"Int", "Float", "String", "Boolean", "ID"}
    for m in re.finditer(r"\b(?:extend\s+)?(type|interface|input|enum|union|scalar)\s+(\w+)([^{}=\n]*)", code):
        me = s.symbol(m[2], f"graphql-{m[1]}", m[2], s.line(m.start()), s.file)
        if "implements" in m[3]:
            for name in re.findall(r"\w+", m[3].split("implements", 1)[1]):
                s.edge(me, "implements", s.id(name), s.line(m.start()))
        if m[1] in ("scalar", "union"):
            for name in re.findall(r"\w+", (re.match(r"\s*=\s*([^\n]*)", code[m.end() :]) or ["", ""])[1]):
                s.edge(me, "references", s.id(name), s.line(m.start()))
            continue
        if not code[m.end() :].lstrip().startswith("{"):
            continue
        begin, end = code.index("{", m.end()) + 1, _block(code, m.end())
        if m[1] == "enum":
            for f in re.finditer(r"\b[A-Za-z_]\w*", code[begin:end]):
                s.symbol(f[0], "graphql-enum-value", f"{m[2]}.{f[0]}", s.line(begin + f.start()), me)
            continue
        for f in re.finditer(r"(\w+)\s*(\([^)]*\))?\s*:\s*[\[\s]*(\w+)", code[begin:end]):
            field = s.symbol(f[1], "graphql-field", f"{m[2]}.{f[1]}", s.line(begin + f.start()), me)
            if f[3] not in plain:
                s.edge(field, "references", s.id(f[3]), s.line(begin + f.start()))
            for a in re.finditer(r"(\w+)\s*:\s*[\[\s]*(\w+)", f[2] or ""):
                s.symbol(a[1], "graphql-argument", f"{m[2]}.{f[1]}.{a[1]}", s.line(begin + f.start()), field)


def openapi(s: Sheet) -> None:
    if s.text.lstrip().startswith("{"):
        doc = json.loads(s.text)
    else:
        try:
            import yaml
        except ImportError:
            s.problems.append("no YAML reader here")
            return
        doc = yaml.safe_load(s.text)

    def refs(value, owner: str) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                if k == "$ref" and isinstance(v, str):
                    local = v.startswith("#/")
                    s.edge(owner, "references", s.id(v[2:]) if local else f"open:openapi:{v}", 1)
                    if not local:
                        s.problems.append(f"reference {v} leaves the file")
                else:
                    refs(v, owner)
        elif isinstance(value, list):
            for v in value:
                refs(v, owner)

    for path, item in (doc.get("paths") or {}).items():
        me = s.symbol(path, "openapi-path", f"paths{path}", 1, s.file)
        for verb, operation in (item or {}).items():
            if verb in ("get", "put", "post", "delete", "patch", "head", "options", "trace"):
                refs(operation, s.symbol((operation or {}).get("operationId") or f"{verb.upper()} {path}", "openapi-operation", f"paths{path}.{verb}", 1, me))
    for name, schema in ((doc.get("components") or {}).get("schemas") or {}).items():
        me = s.symbol(name, "openapi-schema", f"components/schemas/{name}", 1, s.file)
        for key, value in ((schema or {}).get("properties") or {}).items():
            refs(value, s.symbol(key, "openapi-property", f"components/schemas/{name}.{key}", 1, me))
        refs({k: v for k, v in (schema or {}).items() if k != "properties"}, me)


def terraform(s: Sheet) -> None:
    code = _blank(s.text, r"#[^\n]*", r"//[^\n]*", r"/\*.*?\*/")
    kinds = {"resource": "resource", "data": "data-source", "variable": "variable", "output": "output", "module": "module", "provider": "provider"}
    for m in re.finditer(r'^(resource|data|variable|output|module|provider)\s+"([^"]+)"(?:\s+"([^"]+)")?\s*\{', code, re.M):
        prefix = {"resource": "", "data": "data.", "variable": "var.", "output": "output.", "module": "module.", "provider": "provider."}[m[1]]
        name = prefix + m[2] + (f".{m[3]}" if m[3] else "")
        me = s.symbol(m[3] or m[2], f"terraform-{kinds[m[1]]}", name, s.line(m.start()), s.file)
        body = code[m.end() : _block(code, m.start())]
        depends = re.search(r"depends_on\s*=\s*\[([^\]]*)\]", body)
        for target in re.findall(r"[\w.]+", depends[1] if depends else ""):
            s.edge(me, "depends-on", s.id(target), s.line(m.start()))
        for r in re.finditer(r"\b((?:var|local|module)\.\w+|data\.\w+\.\w+|(?:aws|google|azurerm|kubernetes|null|random)_\w+\.\w+)", body[: depends.start()] + body[depends.end() :] if depends else body):
            s.edge(me, "references", s.id(r[1]), s.line(m.start()))
        if m[1] == "module" and (source := re.search(r'source\s*=\s*"([^"]+)"', body)):
            s.edge(me, "depends-on", f"open:terraform:{source[1]}", s.line(m.start()))
    for m in re.finditer(r"^locals\s*\{", code, re.M):
        for f in re.finditer(r"^\s*(\w+)\s*=", code[m.end() : _block(code, m.start())], re.M):
            s.symbol(f[1], "terraform-local", f"local.{f[1]}", s.line(m.start()), s.file)


def build(s: Sheet) -> None:
    """go.mod, Cargo.toml, package.json, pom.xml and MSBuild projects."""
    base = s.path.rsplit("/", 1)[-1]
    system, name, needs = "", base, []
    if base == "go.mod":
        system = "go"
        name = (re.search(r"^module\s+(\S+)", s.text, re.M) or ["", base])[1]
        needs = re.findall(r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+v\S+", s.text, re.M)
    elif base == "Cargo.toml":
        doc, system = tomllib.loads(s.text), "cargo"
        name = doc.get("package", {}).get("name", base)
        needs = [k for part in ("dependencies", "dev-dependencies", "build-dependencies") for k in doc.get(part, {})]
    elif base == "package.json":
        doc, system = json.loads(s.text), "npm"
        name = doc.get("name", base)
        needs = [k for part in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for k in doc.get(part, {})]
        for k in doc.get("scripts", {}):
            s.symbol(k, "build-target", f"scripts.{k}", 1, s.file)
    else:
        root = ET.fromstring(s.text)
        for e in root.iter():
            e.tag = e.tag.rsplit("}", 1)[-1]
        if base == "pom.xml":
            system, name = "maven", root.findtext("artifactId") or base
            needs = [f"{d.findtext('groupId')}:{d.findtext('artifactId')}" for d in root.iter("dependency")]
        else:
            system, name = "msbuild", base.rsplit(".", 1)[0]
            needs = [e.get("Include", "") for tag in ("PackageReference", "ProjectReference") for e in root.iter(tag)]
            for t in root.iter("Target"):
                s.symbol(t.get("Name", ""), "build-target", f"target.{t.get('Name', '')}", 1, s.file)
    me = s.symbol(name, f"build-project-{system}", f"project.{name}", 1, s.file)
    for n in sorted(set(filter(None, needs))):
        s.edge(me, "depends-on", f"open:{system}:{n}", 1)


def _anchor(title: str) -> str:
    return re.sub(r"[^\w\- ]", "", title.strip().lower()).replace(" ", "-")


def markdown(s: Sheet) -> None:
    """Headings as a tree with anchors, fenced blocks, links, images and HTML targets."""
    fence, opened, stack, seen, owner, at = "", 0, [], {}, s.file, 0
    for number, row in enumerate(s.text.split("\n"), 1):
        begin, at = at, at + len(row) + 1
        del begin
        mark = re.match(r"\s{0,3}(`{3,}|~{3,})\s*(\S*)", row)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2]:
                fence = ""
            continue
        if mark:
            fence, opened = mark[1], opened + 1
            s.symbol(mark[2] or "code", "code-block", f"code-{opened}", number, owner)
            continue
        heading = re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", row) or re.match(r"\s*<h([1-6])[^>]*>(.*?)</h[1-6]>", row, re.I)
        if heading:
            level = int(heading[1]) if heading[1].isdigit() else len(heading[1])
            title = re.sub(r"<[^>]+>|[*_`]", "", heading[2])
            anchor = _anchor(title)
            again = seen.get(anchor, 0)
            seen[anchor] = again + 1
            while stack and stack[-1][0] >= level:
                stack.pop()
            owner = s.symbol(title, "section", f"{anchor}-{again}" if again else anchor, number, stack[-1][1] if stack else s.file)
            stack.append((level, owner))
            continue
        folder = s.path.rsplit("/", 1)[0] + "/" if "/" in s.path else ""
        for m in re.finditer(r"(!?)\[[^\]]*\]\(\s*<?([^)\s>]+)|<(https?://[^>\s]+)>|(?:href|src)\s*=\s*[\"']([^\"']+)", row):
            target = m[2] or m[3] or m[4]
            if re.match(r"[a-z][a-z0-9+.-]*:", target, re.I):
                to = f"external:{target}"
            else:
                path, _, fragment = target.partition("#")
                parts: list[str] = []
                for p in ((path.lstrip("/") if path.startswith("/") else folder + path) if path else s.path).split("/"):
                    parts = parts[:-1] if p == ".." and parts else parts if p in (".", "") else [*parts, p]
                to = f"{s.kind}:{'/'.join(parts)}" + (f"#{fragment}" if fragment else "")
            s.edge(owner, "embeds" if m[1] else "links-to", to, number)


def python(s: Sheet) -> None:
    """Modules, classes and functions; imports, and calls by name."""
    module = s.path.removesuffix(".py").replace("/", ".").removesuffix(".__init__")
    top = s.symbol(module, "module", module, 1, s.file)

    def visit(node: ast.AST, owner: str, prefix: str) -> None:
        for child in ast.iter_child_nodes(node):
            me, name = owner, prefix
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                name = f"{prefix}.{child.name}"
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                me = s.symbol(child.name, kind, name, child.lineno, owner)
                for base in getattr(child, "bases", []):
                    s.edge(me, "extends", f"open:python:{ast.unparse(base)}", child.lineno, "syntactic")
            elif isinstance(child, ast.Import):
                for a in child.names:
                    s.edge(top, "imports", f"open:python:{a.name}", child.lineno)
            elif isinstance(child, ast.ImportFrom):
                s.edge(top, "imports", f"open:python:{'.' * child.level}{child.module or ''}", child.lineno)
            elif isinstance(child, ast.Call) and isinstance(child.func, ast.Name | ast.Attribute):
                s.edge(owner, "calls", f"open:python:{ast.unparse(child.func)}"[:300], child.lineno, "syntactic")
            visit(child, me, name)

    visit(ast.parse(s.text), top, module)


EXTRACTORS: dict[str, Callable[[Sheet], None]] = {"sql-migrations": sql, "protobuf": protobuf, "graphql": graphql, "openapi": openapi, "terraform": terraform, "build": build, "markdown": markdown, "python": python}
ROW = "family string, id string, a string, b string, kind string, path string, line int, evidence string, text string"


def facts_of(kind: str, path: str, text: str) -> Sheet:
    """The sheet of one file; a file that can't be read has a problem and no more."""
    sheet = Sheet(kind, path, text)
    try:
        EXTRACTORS[kind](sheet)
    except (ValueError, SyntaxError, RecursionError, ET.ParseError, TypeError, AttributeError, KeyError) as why:
        sheet.problems.append(f"can't be read: {type(why).__name__}")
    return sheet


def extract(files: DataFrame) -> DataFrame:
    """Rows of ROW from files (path, text): symbols (a stable, b display name), edges
    (a from, b to) and problems. Files of other kinds give none, those over MOST_BYTES a problem."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for kind, path, text in zip(frame["category"], frame["path"], frame["text"], strict=True):
                s = facts_of(kind, path, text)
                out += [("symbol", i, stable, shown, k, path, line, "declared", None) for i, stable, shown, k, line in s.symbols.values()]
                out += [("edge", e, a, b, k, path, line, evidence, None) for e, (a, k, b, line, evidence) in s.edges.items()]
                out += [("problem", path, None, None, kind, path, None, None, p) for p in s.problems]
            yield pd.DataFrame(out, columns=["family", "id", "a", "b", "kind", "path", "line", "evidence", "text"])

    known = files.withColumn("category", category(F.col("path"))).where("category <> '' AND text IS NOT NULL")
    small, size = F.octet_length("text") <= MOST_BYTES, F.octet_length("text").cast("string")
    void = lambda kind: F.lit(None).cast(kind)
    large = known.where(~small).select(F.lit("problem").alias("family"), F.col("path").alias("id"), void("string").alias("a"), void("string").alias("b"), F.col("category").alias("kind"), "path", void("int").alias("line"), void("string").alias("evidence"), F.concat(F.lit("file of "), size, F.lit(f" bytes is over {MOST_BYTES}")).alias("text"))
    read = known.where(small).select("category", "path", "text").mapInPandas(run, ROW)
    return read.unionByName(large.select(*[F.col(c).cast(read.schema[c].dataType).alias(c) for c in read.columns]))


def resolved(rows: DataFrame) -> DataFrame:
    """rows of all files in which open references to SQL relations and Protobuf types name
    the symbol that some file defines, if one does; a Protobuf name is sought from the
    innermost scope outwards. Of equal definitions the least id counts."""
    name = F.substring_index("a", "#", -1)
    defined = rows.where("family = 'symbol' AND kind IN ('sql-table', 'sql-view', 'protobuf-message', 'protobuf-enum')")
    defined = defined.groupBy(F.substring_index("kind", "-", 1).alias("language"), name.alias("name")).agg(F.min("id").alias("found"))
    edges, others = rows.where("family = 'edge'"), rows.where("family <> 'edge'")
    for end, other in (("a", "b"), ("b", "a")):
        asked = edges.where(F.col(end).rlike("^open:(sql|protobuf):")).select("id", "path", F.split(end, ":", 3).alias("open"), F.split(F.substring_index(other, "#", -1), r"\.").alias("scope"))
        language, wanted = F.col("open")[1], F.col("open")[2]
        outwards = F.transform(F.sequence(F.size("scope"), F.lit(0), F.lit(-1)), lambda n: F.concat_ws(".", F.slice("scope", F.lit(1), n), F.array(wanted)))
        names = F.when(language == "sql", F.array(wanted)).when(wanted.startswith("."), F.array(F.substring(wanted, 2, 1 << 20))).otherwise(outwards)
        hits = asked.select("id", "path", language.alias("language"), F.posexplode(names).alias("rank", "name")).join(defined, ["language", "name"])
        hits = hits.groupBy("id", "path").agg(F.min_by("found", "rank").alias("found"))
        edges = edges.join(hits, ["id", "path"], "left").withColumn(end, F.coalesce("found", end)).drop("found")
    edges = edges.withColumn("id", F.concat_ws("|", "a", "kind", "b"))
    first = edges.groupBy("id").agg(F.min_by(F.struct(*rows.columns), F.struct("path", "line")).alias("e")).select("e.*")  # several files may say the same of one relation
    return others.unionByName(first)


def migration_order(files: DataFrame) -> DataFrame:
    """Edges between consecutive migrations of a folder, by path."""
    mine = files.select("path").where(category(F.col("path")) == "sql-migrations").withColumn("folder", F.regexp_extract("path", "^(.*/)?", 0))
    before = F.lag("path").over(Window.partitionBy("folder").orderBy("path"))
    return mine.withColumn("before", before).where("before IS NOT NULL").select(F.concat(F.lit("sql-migrations:"), "path").alias("from"), F.concat(F.lit("sql-migrations:"), "before").alias("to"), F.lit("depends-on").alias("kind"), F.lit("inferred").alias("evidence"))


def to_facts(files: DataFrame, rows: DataFrame, provider: str = "files") -> Facts:
    """Fact tables of extracted rows, a unit for each file; references are resolved across files."""
    rows = resolved(rows)
    unit = F.concat(F.lit(f"{provider}:"), F.col("path"))
    kept = files.where(category(F.col("path")) != "")
    units = kept.select(unit.alias("id"), F.lit(provider).alias("provider"), F.lit("1").alias("provider_version"), category(F.col("path")).alias("language"), F.sha2("text", 256).alias("input_fingerprint"))
    documents = kept.select(F.concat(F.lit("file:"), "path").alias("id"), unit.alias("unit_id"), "path", F.sha2("text", 256).alias("content_hash"), F.lit(provider).alias("provider"), F.lit("1").alias("provider_version"))
    of = lambda family: rows.where(F.col("family") == family).withColumn("unit_id", unit).withColumn("document_id", F.concat(F.lit("file:"), "path")).withColumn("provider", F.lit(provider))
    symbols = of("symbol").withColumn("stable_name", F.col("a")).withColumn("display_name", F.col("b")).withColumn("normalized_name", T.normalize_name(F.col("b")))
    edges = of("edge").withColumn("from", F.col("a")).withColumn("to", F.col("b"))
    occurrences = symbols.select(F.concat(F.lit("definition:"), "id").alias("id"), "unit_id", F.col("id").alias("symbol_id"), "document_id", F.lit("definition").alias("role"), "provider", "evidence")
    return Facts(conform(units, "units"), conform(documents, "documents"), conform(symbols, "symbols"), conform(occurrences, "occurrences"), conform(edges, "edges"))


# The stream of frames that external extractors send, one JSON object a line.
FRAME = "request_id string, kind string, payload string, place bigint"
ORDER = {"run.begin": ["run.begin"], "unit.begin": ["run.begin", "unit.end"], "facts": ["unit.begin", "facts", "diagnostic"], "diagnostic": ["unit.begin", "facts", "diagnostic", "run.begin", "unit.end"], "unit.end": ["unit.begin", "facts", "diagnostic"], "run.end": ["run.begin", "unit.end", "diagnostic"]}


def frame_problems(frames: DataFrame) -> DataFrame:
    """(request_id, place, problem) of frames out of their order: a run opens and
    closes once, units within it, facts within units."""
    w = Window.partitionBy("request_id").orderBy("place")
    last = F.lag("kind").over(w)
    after = F.lead("kind").over(w)
    legal = reduce(lambda a, k: a | ((F.col("kind") == k) & last.isin(ORDER[k])), [k for k in ORDER if k != "run.begin"], (F.col("kind") == "run.begin") & last.isNull())
    rows = frames.select("request_id", "place", "kind", F.coalesce(legal, F.lit(False)).alias("legal"), after.alias("after"))
    late = rows.where("after IS NULL AND kind <> 'run.end'").select("request_id", "place", F.lit("the run doesn't end").alias("problem"))
    return rows.where("NOT legal").select("request_id", "place", F.concat(F.lit("unexpected "), "kind").alias("problem")).unionByName(late)
