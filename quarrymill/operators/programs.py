"""Python programs: normalised syntax, structural similarity, clusters and a security scan."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.scalars import status
from quarrymill.sources.shared import written

from .neighbours import numbered, with_next

# fixed values: names that normalisation keeps
KEPT = (
    "print", "len", "range", "str", "int", "float", "list", "dict", "set", "tuple", "bool", "None",
    "True", "False", "if", "else", "elif", "for", "while", "def", "class", "return", "yield",
    "import", "from", "as", "try", "except", "finally", "with", "lambda", "and", "or", "not", "in",
    "is", "assert", "raise", "break", "continue", "pass", "global", "nonlocal", "del",
)

#: What normalisation visits of each node, in order; other statements are a leaf "Stmt", other expressions "Expr".
_SHAPE: dict[type, tuple[str, ...]] = {
    ast.FunctionDef: ("name", "args.args", "body"), ast.ClassDef: ("name", "body"), ast.Return: ("value",), ast.Assign: ("targets", "value"), ast.AugAssign: ("target", "value"),
    ast.For: ("target", "iter", "body", "orelse"), ast.While: ("test", "body", "orelse"), ast.If: ("test", "body", "orelse"), ast.Expr: ("value",), ast.Try: ("body", "handlers", "orelse", "finalbody"), ast.With: ("items", "body"),
    ast.Call: ("func", "args", "keywords"), ast.BinOp: ("left", "right"), ast.UnaryOp: ("operand",), ast.Compare: ("left", "comparators"), ast.List: ("elts",), ast.Tuple: ("elts",),
    ast.Subscript: ("value", "slice"), ast.Lambda: ("body",), ast.ListComp: ("elt",), ast.GeneratorExp: ("elt",), ast.Constant: (),
}
_PARTS: dict[type, tuple[str, ...]] = {ast.ExceptHandler: ("body",), ast.withitem: ("context_expr", "optional_vars"), ast.keyword: ("value",)}


class _Names(dict):
    def __missing__(self, name: str) -> str:
        out = self[name] = name if name in KEPT or name.startswith("_") else f"var_{sum(v.startswith('var_') and k != v for k, v in self.items())}"
        return out


def tokens(source: str) -> list[str] | None:
    """The normalised nodes of a program, parents first; null if it isn't Python. Operators, constants and names' spelling don't count."""
    try:
        top = ast.parse(source).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    names, out = _Names(), []
    todo: list = list(reversed(top))
    while todo:
        node = todo.pop()
        if node is None:
            continue
        if isinstance(node, str):
            out.append(node)
            continue
        kind, after = type(node), []
        if kind is tuple:  # a name by itself
            out.append(names[node[0]])
        elif kind is ast.arg:
            out.append(names[node.arg])
        elif kind is ast.Name:
            out.append(f"Name({names[node.id]})")
        elif kind is ast.Attribute:
            out.append("Attribute")
            after = [node.value, f".{node.attr}"]
        elif kind is ast.Import:
            out += ["Import", *(f"import:{a.name}" for a in node.names)]
        elif kind is ast.ImportFrom:
            out += ["ImportFrom", *([f"from:{node.module}"] if node.module else [])]
        elif kind is ast.Dict:
            out.append("Dict")
            after = [x for pair in zip(node.keys, node.values, strict=True) for x in pair]
        elif kind is ast.Expr and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
            pass
        elif (fields := _SHAPE.get(kind, _PARTS.get(kind))) is not None:
            if kind in _SHAPE:
                out.append(kind.__name__)
            for field in fields:
                value = (node.name,) if field == "name" else node.args.args if field == "args.args" else getattr(node, field)
                after += value if isinstance(value, list) else [value]
        else:
            out.append("Stmt" if isinstance(node, ast.stmt) else "Expr")
        todo += reversed(after)
    return out


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, row by row in bits: a bit of the row is 0 where the length grows."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    places: dict = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def structural_score(a: list, b: list) -> int:
    """0 to 100, cut to a whole number; two empty programs are alike."""
    if not len(a) and not len(b):
        return 100
    if not len(a) or not len(b):
        return 0
    return int(lcs(a, b) / max(len(a), len(b)) * 100.0)


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalised(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else tokens(s))


@F.pandas_udf(T.IntegerType())
def score_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else structural_score(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


def structure_hash(nodes: Column) -> Column:
    """SHA-256 of the nodes, each followed by a zero byte."""
    return F.sha2(F.array_join(F.transform(nodes, lambda t: F.concat(t, F.lit("\0"))), ""), 256)


#: Programs of one structure in a row, programs of a block, and pairs of a batch of results.
PACK, BLOCK, BATCH = 256, 8192, 1 << 17
#: Nodes of a program that is compared in one machine word, and of those that it is compared with at once.
WORD, LONGEST = 64, 512


class _Many:
    """Programs (arrays of numbered nodes) that one program at a time is compared with."""

    def __init__(self, nodes: list[np.ndarray], vocabulary: int):
        self.nodes, self.size = nodes, np.array([len(x) for x in nodes], np.int64)
        self.short = np.flatnonzero(self.size <= LONGEST)
        # a node of a column each; numbers begin at 1, and 0 stands behind a program's end
        self.columns = np.zeros((int(self.size[self.short].max(initial=0)), self.short.size), np.int64)
        for k, i in enumerate(self.short):
            self.columns[: self.size[i], k] = nodes[i]
        self.masks = np.zeros(vocabulary + 1, np.uint64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """structural_score of x and each."""
        common = np.zeros(self.size.size, np.int64)
        if 0 < x.size <= WORD:
            for bit, node in enumerate(x.tolist()):
                self.masks[node] |= np.uint64(1 << bit)
            full = np.uint64((1 << x.size) - 1)
            row = np.full(self.short.size, full)
            for column in self.columns:
                hit = row & self.masks[column]
                row = ((row + hit) | (row - hit)) & full
            self.masks[x] = 0
            common[self.short] = x.size - np.bitwise_count(row)
            rest = np.flatnonzero(self.size > LONGEST)
        else:
            rest = np.arange(self.size.size) if x.size else []
        for i in rest:
            common[i] = lcs(x.tolist(), self.nodes[i].tolist())
        most = np.maximum(self.size, x.size)
        return np.where(most == 0, 100, common / np.maximum(most, 1) * 100.0).astype(np.int32)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, nodes, ids, group) of one block or two to the pairs (a, b, score) of their programs, a batch at a time."""
    table = pa.Table.from_batches(batches).sort_by("block").combine_chunks()
    block, numbers = table.column("block").to_numpy(), {}
    nodes = [np.array([numbers.setdefault(t, len(numbers) + 1) for t in x], np.int64) for x in table.column("nodes").to_pylist()]
    ids = table.column("ids").combine_chunks().flatten()
    # where each row's programs begin and end
    copies = pc.list_value_length(table.column("ids")).to_numpy()
    ends = np.cumsum(copies)
    starts, rank = ends - copies, pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
    group = table.column("group")[0].as_py()
    same = group["low"] == group["high"]
    left = len(block) if same else int(np.searchsorted(block, group["high"]))
    many = _Many(nodes if same else nodes[left:], len(numbers))
    at = 0 if same else left
    held: list[tuple] = []
    n = 0
    for r in range(left):
        if at == len(block):
            break
        scores = np.repeat(many.scores(nodes[r]), copies[at:])
        for p in range(starts[r], ends[r]):
            # in one block each program meets those after it
            first = p + 1 if same else starts[at]
            q = np.arange(first, len(rank))
            less = rank[p] < rank[q]
            differ = rank[p] != rank[q]
            held.append((np.where(less, p, q)[differ], np.where(less, q, p)[differ], scores[first - starts[at] :][differ]))
            n += q.size
            if n >= BATCH or (r == left - 1 and p == ends[r] - 1):
                a, b, score = (np.concatenate(x) for x in zip(*held, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(score)], names=["a", "b", "score"])
                held, n = [], 0


def _all_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, score), a < b, of a written table (id, nodes, hash).

    Programs of one structure travel in rows of about PACK ids with their nodes once, dealt to blocks; each pair of blocks is a group, which compares structures and hands on the pairs of programs
    in batches. A row is sent as often as there are blocks: about the root of twice the shuffle partitions, more from BLOCK programs a block on, so what a group holds is bounded.
    """
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.where("id IS NOT NULL")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, round((2 * tasks) ** 0.5), -(-rows.count() // BLOCK))
    parts = rows.groupBy("hash").agg(F.ceil(F.count("*") / PACK).cast("int").alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).alias("part")
    packed = rows.join(parts, "hash", "left").select("hash", part, "id", "nodes").groupBy("hash", "part").agg(F.first("nodes").alias("nodes"), F.collect_list("id").alias("ids"))
    met = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.struct(F.least("block", x).alias("low"), F.greatest("block", x).alias("high")))
    dealt = packed.select(F.pmod(F.xxhash64("hash", "part"), F.lit(blocks)).cast("int").alias("block"), "nodes", "ids").withColumn("group", F.explode(met))
    # small rows are much work: tasks aren't merged by size
    return dealt.repartition(tasks, "group").groupBy("group").applyInArrow(_compared, f"a {kind}, b {kind}, score int")


def _parsed(programs: DataFrame, key: str, source: str) -> DataFrame:
    return programs.select(F.col(key).alias("id"), normalised(F.col(source)).alias("nodes")).where("nodes IS NOT NULL").withColumn("hash", structure_hash(F.col("nodes")))


def similarities(programs: DataFrame, key: str = "ord", source: str = "source", reindex: bool = True) -> DataFrame:
    """(a, b, score), a < b, for all pairs of programs that parse; each two structures are compared once for many programs that have them.

    reindex: places count the programs that parse, from 0; else they are the keys. Equal and null keys make no pair. The pairs grow with the square of the programs, the tables that are shuffled don't.
    """
    rows = _parsed(programs, key, source)
    if reindex:
        rows = numbered(rows, "id", "place").withColumn("id", F.col("place")).drop("place")
    return _all_pairs(written(rows, "programs"))


def score_or_zero(a: Column, b: Column) -> Column:
    """The structural score of two sources; 0 if either doesn't parse."""
    return F.coalesce(score_of(normalised(a), normalised(b)), F.lit(0))


def report(programs: DataFrame, key: str = "ord", source: str = "source") -> DataFrame:
    """One row: kind (no_submissions, insufficient_data, parse_error, results), first_error, n_pairs, plagiarized and to_verify (places, as pairs name them first), top_score and its pair, the last of equals.

    Only structures are compared, each pair once: what their programs' pairs say follows from the two least and the two greatest keys of each. Without results nothing is compared.
    """
    parsed = programs.select(F.col(key).alias("id"), normalised(F.col(source)).isNotNull().alias("ok"))
    kind = F.when(F.col("n") == 0, "no_submissions").when(F.col("n") == 1, "insufficient_data").when(F.col("first_error").isNotNull(), "parse_error").otherwise("results")
    facts = written(parsed.agg(F.count("*").alias("n"), F.min(F.when(~F.col("ok"), F.col("id"))).alias("first_error")).select(kind.alias("kind"), "first_error"), "facts")
    named = parsed.schema["id"].dataType.simpleString()
    kinds = {"n_pairs": "bigint", "plagiarized": f"array<{named}>", "to_verify": f"array<{named}>", "top_score": "int", "top_a": named, "top_b": named}
    if facts.where("kind = 'results'").isEmpty():
        return facts.select("kind", "first_error", *(F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
    rows = written(_parsed(programs, key, source).where("id IS NOT NULL"), "programs")
    ends = rows.groupBy("hash").agg(F.first("nodes").alias("nodes"), F.min("id").alias("low"), F.max("id").alias("high"))
    inner = rows.join(ends.select("hash", "low", "high"), "hash").groupBy("hash").agg(F.min(F.when(F.col("id") > F.col("low"), F.col("id"))).alias("low2"), F.max(F.when(F.col("id") < F.col("high"), F.col("id"))).alias("high2"))
    heads = written(ends.join(inner, "hash").withColumn("class", F.monotonically_increasing_id()), "classes")
    scored = written(_all_pairs(heads.select(F.col("class").alias("id"), "nodes", "hash")), "scored")
    own = heads.where("low2 IS NOT NULL").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(100).alias("score"))
    # the last pair of each two structures: one of the two greatest keys of either
    edge = heads.select("class", F.array("high", "high2").alias("keys"))
    best = scored.union(own).join(scored.union(own).agg(F.max("score").alias("score")), "score")
    crossed = best.join(edge.select(F.col("class").alias("a"), F.explode("keys").alias("x")), "a").join(edge.select(F.col("class").alias("b"), F.explode("keys").alias("y")), "b").where("x <> y")
    top = crossed.agg(F.max(F.struct("score", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).alias("top"))
    # of each structure, the least key that its programs pair with, and the next for the program that has that key itself
    told = scored.union(own).withColumn("status", status(F.col("score"))).where("status <> 'clean'")
    both = told.select(F.col("a").alias("class"), F.col("b").alias("other"), "status").union(told.select(F.col("b").alias("class"), F.col("a").alias("other"), "status"))
    partners = both.join(heads.select(F.col("class").alias("other"), F.explode(F.array("low", "low2")).alias("key")), "other").where("key IS NOT NULL")
    first = partners.groupBy("class", "status").agg(F.min("key").alias("first"))
    partners = partners.join(first, ["class", "status"]).groupBy("class", "status").agg(F.first("first").alias("first"), F.min(F.when(F.col("key") > F.col("first"), F.col("key"))).alias("second"))
    place = rows.select("id", "hash").join(heads.select("hash", "class"), "hash").join(partners, "class").withColumn("met", F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first"))).where("met IS NOT NULL")
    at = F.struct(F.least("id", "met").alias("a"), F.greatest("id", "met").alias("b"), (F.col("met") < F.col("id")).cast("int").alias("side"), F.col("id").alias("place"))
    lists = place.groupBy("status", "id").agg(F.min(at).alias("first")).agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("first")))), lambda x: x["place"]).alias(n) for n, s in (("plagiarized", "plagiarized"), ("to_verify", "needs_verification"))))
    # programs with one key make no pair with each other
    choose = lambda n: F.col(n) * (F.col(n) - 1) / 2
    shared = rows.groupBy("id").agg(F.count("*").alias("k")).agg(F.sum("k").alias("n"), F.sum(choose("k")).alias("equal"))
    count = shared.select(F.coalesce(choose("n") - F.col("equal"), F.lit(0)).cast("bigint").alias("n_pairs"))
    met = facts.withColumn("one", F.lit(1))
    for row in (count, lists, top):
        met = met.join(row.withColumn("one", F.lit(1)), "one")
    return met.select("kind", "first_error", "n_pairs", "plagiarized", "to_verify", F.col("top.score").alias("top_score"), F.col("top.a").alias("top_a"), F.col("top.b").alias("top_b"))


def clusters(programs: DataFrame, key: str = "ord", source: str = "source") -> DataFrame:
    """(prefix, members) of structure hashes with the same first 16 hex digits, groups of 2 or more."""
    return _prefixes(programs, key, source).groupBy("prefix").agg(F.array_sort(F.collect_list("id")).alias("members")).where(F.size("members") >= 2)


def cluster_sizes(programs: DataFrame, key: str = "ord", source: str = "source") -> DataFrame:
    """(prefix, n, first) of the same groups: their number of programs and least key, from partial counts, whatever their size."""
    return _prefixes(programs, key, source).groupBy("prefix").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n >= 2")


def _prefixes(programs: DataFrame, key: str, source: str) -> DataFrame:
    return programs.select(F.col(key).alias("id"), F.substring(structure_hash(normalised(F.col(source))), 1, 16).alias("prefix")).where("prefix IS NOT NULL")


# fixed values: calls that the scan reports
BUILTINS = {"exec": "critical", "eval": "critical", "__import__": "critical", "compile": "warning"}
METHODS = {
    ("os", "system"): "critical", ("os", "popen"): "critical",
    ("subprocess", "run"): "warning", ("subprocess", "call"): "warning", ("subprocess", "Popen"): "warning", ("subprocess", "check_output"): "warning", ("subprocess", "check_call"): "warning",
    ("socket", "socket"): "warning", ("socket", "create_connection"): "warning",
    ("urllib", "request"): "info", ("requests", "get"): "info", ("requests", "post"): "info", ("requests", "put"): "info", ("requests", "delete"): "info", ("requests", "request"): "info",
    ("httpx", "get"): "info", ("httpx", "post"): "info",
    ("shutil", "rmtree"): "warning", ("os", "remove"): "warning", ("os", "chdir"): "info", ("pathlib", "Path"): "info",
}

#: What the scan visits of each node, in order. A call's own target isn't visited.
_SCANNED: dict[type, str] = {
    ast.Expr: "value", ast.Assign: "value", ast.AugAssign: "value", ast.AnnAssign: "value", ast.FunctionDef: "defaults body decorator_list", ast.AsyncFunctionDef: "defaults body decorator_list",
    ast.ClassDef: "body decorator_list bases", ast.If: "test body orelse", ast.While: "test body orelse", ast.For: "iter body orelse", ast.AsyncFor: "iter body orelse", ast.Return: "value", ast.Raise: "exc cause",
    ast.Try: "body handlers orelse finalbody", ast.TryStar: "body handlers orelse finalbody", ast.ExceptHandler: "body", ast.With: "items body", ast.AsyncWith: "items body", ast.withitem: "context_expr", ast.Match: "subject cases", ast.match_case: "body guard",
    ast.Assert: "test msg", ast.Delete: "targets", ast.Call: "args keywords", ast.keyword: "value", ast.Attribute: "value", ast.BinOp: "left right", ast.UnaryOp: "operand", ast.BoolOp: "values", ast.Compare: "left comparators", ast.Lambda: "body",
    ast.IfExp: "test body orelse", ast.ListComp: "elt generators", ast.SetComp: "elt generators", ast.GeneratorExp: "elt generators", ast.DictComp: "key value generators", ast.comprehension: "iter ifs", ast.Await: "value", ast.Yield: "value", ast.YieldFrom: "value",
    ast.NamedExpr: "value", ast.Slice: "lower upper step", ast.Subscript: "value slice", ast.Starred: "value", ast.Tuple: "elts", ast.List: "elts", ast.Set: "elts", ast.Dict: "keys values", ast.JoinedStr: "values", ast.FormattedValue: "value format_spec",
}
if hasattr(ast, "TypeAlias"):
    _SCANNED[ast.TypeAlias] = "value"


def _ends(node: ast.expr) -> tuple[str, str] | None:
    """Root name and last attribute of a chain of attributes."""
    last = node.attr
    while isinstance(node, ast.Attribute):
        node = node.value
    return (node.id, last) if isinstance(node, ast.Name) else None


def _found(call: ast.Call) -> list[tuple[str, str]]:
    """(pattern, severity) of a call: by its target, and by getattr with a name and a literal."""
    out, target = [], call.func
    if isinstance(target, ast.Name) and target.id in BUILTINS:
        out.append((target.id, BUILTINS[target.id]))
    elif isinstance(target, ast.Attribute) and (ends := _ends(target)) in METHODS:
        out.append((".".join(ends), METHODS[ends]))
    if isinstance(target, ast.Name) and target.id == "getattr" and len(call.args) > 1:
        owner, name = call.args[:2]
        if isinstance(owner, ast.Name) and isinstance(name, ast.Constant) and isinstance(name.value, str):
            severity = BUILTINS.get(name.value) if owner.id == "__builtins__" else METHODS.get((owner.id, name.value))
            if severity:
                out.append((f"getattr({owner.id}, '{name.value}')", severity))
    return out


_VIOLATIONS = T.ArrayType(T.StructType([T.StructField("pattern", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())]))


def violations(source: str) -> list[dict] | None:
    """pattern, severity, line (from 1), column (from 0, in characters), parents first; null if the program doesn't parse."""
    try:
        top = ast.parse(source).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines, out, todo = re.split(r"\r\n|\r|\n", source), [], list(reversed(top))
    while todo:
        node = todo.pop()
        if isinstance(node, ast.Call):
            for pattern, severity in _found(node):
                at = node.func
                line = lines[at.lineno - 1].encode() if at.lineno <= len(lines) else b""
                out.append({"pattern": pattern, "severity": severity, "line": at.lineno, "column": len(line[: at.col_offset].decode(errors="ignore"))})
        after: list = []
        for field in _SCANNED.get(type(node), "").split():
            if field == "defaults":
                own = len(node.args.args)
                value = (node.args.defaults[-own:] if own else []) + node.args.kw_defaults
            else:
                value = getattr(node, field)
            after += value if isinstance(value, list) else [value]
        todo += [x for x in reversed(after) if x is not None]
    return out


@F.pandas_udf(_VIOLATIONS)
def scanned(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else violations(s))


def blocked(found: Column) -> Column:
    """Any critical violation; a program that doesn't parse isn't blocked."""
    return F.coalesce(F.exists(found, lambda v: v["severity"] == "critical"), F.lit(False))


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Keys sorted at all depths, no spaces; null if it isn't JSON."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one)


def role_similarity(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each conversation's roles against those of the next one in order of key, whatever lies between the keys: (a, b, score). Conversations with a null key are left out."""
    rows = conversations.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col("messages.role").alias("roles"))
    met = with_next(rows, "key", "roles").where("next IS NOT NULL")
    return met.select(F.col("key").alias("a"), F.col("next.key").alias("b"), score_of("roles", "next.value").alias("score"))
