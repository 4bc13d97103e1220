"""Features of changes: bags of tokens, syntax-tree edits, import and call graphs."""

from __future__ import annotations

import ast
import gc
import keyword
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from difflib import SequenceMatcher
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from ..functions.scalars import tokens

VOCABULARY, MIN_DOCS = 512, 2

# The syntax-tree node types that are counted.
NODE_TYPES = (
    "FunctionDef",
    "AsyncFunctionDef",
    "ClassDef",
    "If",
    "For",
    "While",
    "Try",
    "With",
    "Call",
    "Assign",
    "Return",
    "Import",
    "ImportFrom",
)
EDITS = ("insert", "delete", "replace", "equal")
_KINDS = tuple(getattr(ast, t) for t in NODE_TYPES)
#: Changes that are taken out of a batch at a time.
AT_ONCE = 256
#: Bytes of texts that are parted into tokens at a time, by whole texts.
BYTES = 1 << 22

# What a byte may be to a token (0 blank, 1 letter, 2 digit, 3 a token's only or first byte, 4 a later byte of a character), and blanks beyond ASCII.
_CLASSES = np.full(256, 3, np.uint8)
_CLASSES[[*range(9, 14), *range(28, 33)]] = 0
_CLASSES[[*range(65, 91), *range(97, 123), 95]] = 1
_CLASSES[48:58] = 2
_CLASSES[128:192] = 4
_BLANKS = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def exploded_tokens(docs: DataFrame) -> DataFrame:
    """id and term of every token of docs (id, text)."""
    return docs.select("id", F.explode(tokens(F.col("text"))).alias("term"))


def vocabulary(docs: DataFrame, size: int = VOCABULARY, min_docs: int = MIN_DOCS) -> DataFrame:
    """term, tf, df and column number of the most frequent terms of at least min_docs texts.

    Counts per text first, so the shuffle carries a row a distinct term of a text."""
    per_doc = exploded_tokens(docs).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))
    terms = per_doc.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_docs)
    top = terms.orderBy(F.desc("tf"), "term").limit(size)
    return top.withColumn("col", (F.row_number().over(Window.orderBy("term")) - 1).cast("bigint"))


def token_array(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of texts in order, as ``functions.scalars.tokens`` has them, and the place of each one's text: vector steps over the bytes."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not pc.all(pc.string_is_ascii(texts)).as_py():
        texts = pc.replace_substring_regex(texts, _BLANKS, " ")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    if ends[0] == ends[-1]:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    data, ends = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    kind, first = _CLASSES[data], np.zeros(len(data), bool)
    first[ends[:-1][ends[:-1] < len(data)]] = True
    name = kind == 1
    if len(at := np.flatnonzero(kind == 2)):  # digits are a name's where they follow its letters
        head = np.concatenate(([True], np.diff(at) > 1)) | first[at]
        begun = at[head]
        name[at[((kind[begun - 1] == 1) & ~first[begun])[np.cumsum(head) - 1]]] = True
    starts = (kind != 0) & (kind != 4)
    starts[1:] &= ~(name[1:] & name[:-1]) | first[1:]
    if len(at := np.flatnonzero((data[1:] == 61) & ((data[:-1] == 61) | (data[:-1] == 33) | (data[:-1] == 60) | (data[:-1] == 62)) & ~first[1:])):
        head = np.concatenate(([True], np.diff(at) > 1))  # of those that overlap, every second one counts
        starts[at[(at - at[head][np.cumsum(head) - 1]) % 2 == 0] + 1] = False
    kept, at = kind != 0, np.flatnonzero(starts)
    offsets = np.append((np.cumsum(kept, dtype=np.int32) - 1)[at], np.int32(kept.sum())).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[kept])), np.searchsorted(ends, at, "right") - 1


def _some(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about BYTES of their texts."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(size // BYTES)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield b.slice(i, j - i)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, tf, and the least and greatest id with it, of each slice of batches (id, text)."""
    for b in _some(batches, 1):
        known = b.column(0).is_valid()
        for part in (b.filter(known), b.filter(pc.invert(known))):
            part = part.take(pc.array_sort_indices(part.column(0)))  # a term's least id is that of its first token
            own, row = token_array(part.column(1))
            found = own.dictionary_encode()
            code, n = found.indices.to_numpy(), len(found.dictionary)
            ends = np.zeros((2, n), np.int64)
            ends[0][code[::-1]], ends[1][code] = row[::-1], row
            least, greatest = (part.column(0).take(pa.array(e)).cast(pa.int64()) for e in ends)
            yield pa.RecordBatch.from_arrays([found.dictionary, pa.array(np.bincount(code, minlength=n)), least, greatest], names=["term", "tf", "least", "greatest"])


def frequent_terms(docs: DataFrame, size: int = VOCABULARY, min_docs: int = MIN_DOCS) -> DataFrame:
    """term and column number of ``vocabulary``, without its counts.

    Two texts or more have a term if the least and the greatest id with it differ, so for
    numeric ids and up to two texts tokens are counted in the tasks, and only a row a term and task is shuffled."""
    if min_docs > 2 or not isinstance(docs.schema["id"].dataType, IntegralType):
        return vocabulary(docs, size, min_docs).select("term", "col")
    found = docs.select("id", "text").mapInArrow(_terms, "term string, tf bigint, least bigint, greatest bigint")
    terms = found.groupBy("term").agg(F.sum("tf").alias("tf"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    top = (terms.filter("least < greatest") if min_docs == 2 else terms).orderBy(F.desc("tf"), "term").limit(size)
    return top.select("term", (F.row_number().over(Window.orderBy("term")) - 1).cast("bigint").alias("col"))


def token_counts(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """id, col and n of the vocabulary's terms in each text: a row's own work, summed over texts only if any share an id."""
    # at most as many terms as the vocabulary's size
    rows = vocab.select("term", "col").collect()
    terms, cols = pa.array([r["term"] for r in rows], pa.string()), np.array([r["col"] for r in rows], np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _some(batches, 1):
            own, row = token_array(b.column(1))
            at = pc.index_in(own, value_set=terms)
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            key, n = np.unique(row[hit] * len(terms) + at.drop_null().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(key // max(1, len(terms)))), pa.array(cols[key % max(1, len(terms))]), pa.array(n)], names=["id", "col", "n"])

    kind = docs.schema["id"].dataType.simpleString()
    out = docs.select("id", "text").mapInArrow(counted, f"id {kind}, col bigint, n bigint")
    alone = docs.groupBy("id").count().filter("count > 1").isEmpty()
    return out if alone else out.groupBy("id", "col").agg(F.sum("n").alias("n"))


def token_vector(text: Column, terms: list[str]) -> Column:
    """The counts of the terms in a text, in their order: a row's own work, without a shuffle."""
    known, width = pa.array(terms, pa.string()), len(terms)
    if not width:
        return F.array().cast("array<float>")

    def some(texts: pa.Array) -> np.ndarray:
        at = pc.index_in(texts.flatten().cast(pa.string()), value_set=known)
        row = np.repeat(np.arange(len(texts)), texts.value_lengths().to_numpy(zero_copy_only=False))
        hit = at.is_valid().to_numpy(zero_copy_only=False)
        return np.bincount(row[hit] * width + at.drop_null().to_numpy(), minlength=len(texts) * width).astype(np.float32)

    @F.arrow_udf("array<float>")
    def counted(texts: pa.Array) -> pa.Array:
        parts = [some(texts.slice(i, AT_ONCE)) for i in range(0, len(texts), AT_ONCE)]
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * width, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.float32)))

    return counted(tokens(text))


def token_features(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """id and features, the counts of the vocabulary's terms in the order of their columns, of each text; ids are unique."""
    # at most as many terms as the vocabulary's size
    terms = [r["term"] for r in vocab.select("term", "col").orderBy("col").collect()]
    return docs.select("id", token_vector(F.col("text"), terms).alias("features"))


def graph_delta(before: Column, after: Column) -> list[Column]:
    """Sizes and differences of two edge arrays (structs src, dst) and of their nodes."""

    def nodes(e: Column) -> Column:
        return F.array_distinct(F.concat(F.transform(e, lambda x: x["src"]), F.transform(e, lambda x: x["dst"])))

    def n(x: Column, name: str) -> Column:
        return F.size(x).cast("bigint").alias(name)

    b, a = F.array_distinct(before), F.array_distinct(after)
    nb, na = nodes(before), nodes(after)
    return [
        n(nb, "nodes_before"), n(b, "edges_before"), n(na, "nodes_after"), n(a, "edges_after"),
        n(F.array_except(a, b), "edges_added"), n(F.array_except(b, a), "edges_removed"), n(F.array_except(na, nb), "nodes_added"), n(F.array_except(nb, na), "nodes_removed"),
    ]


def parsed(code: str) -> ast.AST | None:
    """The syntax tree, or None for what can't be parsed."""
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return None


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without the cycle collector, which would walk through all of a tree while it grows: trees have no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


#: What holds no statement and no call.
_BARE = (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop, ast.alias, ast.type_ignore)


_LEAVES = {ast.Name, ast.Constant, type(None)}


@lru_cache(None)
def _inner(kind: type) -> tuple[str, ...]:
    """The fields of a kind of node that may hold counted nodes."""

    def holds(t) -> bool:
        return any(map(holds, t.__args__)) if hasattr(t, "__args__") else isinstance(t, type) and issubclass(t, ast.AST) and not issubclass(t, _BARE)

    return tuple(f for f, t in kind._field_types.items() if holds(t))


def _walked(tree: ast.AST) -> tuple[Counter, set, set]:
    """Nodes by kind, imported names, and calls (innermost function or None, plainly named callee); kinds that hold nothing counted are left out."""
    kinds, imports, calls = [], set(), set()
    groups: list[tuple[list[ast.AST], str | None]] = [([tree], None)]
    while groups:
        todo, inside = groups.pop()
        while todo:
            node = todo.pop()
            kind = type(node)
            if kind in _LEAVES:
                continue
            kinds.append(kind)
            own = todo
            if kind is ast.Call:
                if type(node.func) is ast.Name:
                    calls.add((inside, node.func.id))
            elif kind is ast.Import:
                imports.update(x.name for x in node.names)
            elif kind is ast.ImportFrom:
                if node.module is not None:
                    imports.add(node.module)
            elif kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
                own = []
                groups.append((own, node.name))
            for f in _inner(kind):
                v = getattr(node, f, None)
                if type(v) is list:
                    own.extend(v)
                else:
                    own.append(v)
    return Counter(kinds), imports, calls


#: What may put a statement's lines elsewhere than at its indent, or leave more levels than a parser takes.
_HARD = ("\\", "\t", "\r", "\f", "\0", '"""', "'''", "\n" + " " * 100)
_COMMENT, _BLANK = re.compile(r"(\"[^\"\n]*\"|'[^'\n]*')|#.*"), re.compile(r"\A(?: *\n)+|\n[ \n]*(?=\n|\Z)")
_IMPORT = re.compile(r"( *)((?:import|from)\b[^;()]*)")
#: Names that may be told by one: not called, not a prefix of a text.
_ANY = "_0"
_NAME = re.compile(rf"\b(?!(?:{'|'.join(keyword.kwlist + keyword.softkwlist)})\b)[A-Za-z_]\w*+(?! *[(\"'])", re.A)
_DEF = re.compile(r" *(?:async +def|def|class)\b.*: *")


@lru_cache(None)
def _statements(indent: int) -> re.Pattern:
    """A statement at an indent with all its lines."""
    at = f" {{{indent}}}"
    return re.compile(rf"(?:^{at}@.*\n)*^{at}[^ \n@].*(?:\n{at}(?: |(?:elif|else|except|finally)\b).*)*", re.M)


@lru_cache(10_000)
def _alone(statement: str) -> tuple[Counter, set, set] | None:
    """``_walked`` of a statement; None if it can't be parsed alone, or if what it calls or imports isn't told."""
    indent = len(statement) - len(statement.lstrip(" "))
    tree = parsed(re.sub(f"(?m)^ {{{indent}}}", "", statement))
    found = None if tree is None else _walked(tree)
    return None if found is None or any(_ANY in x for x in ({y for z in found[1] for y in z.split(".")}, *found[2])) else found


@lru_cache(1_000)
def _header(line: str) -> ast.stmt | None:
    """The function or class that a line begins; None if the line isn't all of its head."""
    tree = parsed(f"{line.strip()} pass")
    own = tree.body if tree else []
    return own[0] if len(own) == 1 and [type(x) for x in getattr(own[0], "body", ())] == [ast.Pass] else None


def _pieces(code: str, indent: int = 0, inside: str | None = None, times: int = 1) -> Iterator[tuple[str, str | None, int]]:
    """Distinct statements with the function around them and their number, bodies of functions and classes by their own statements; ValueError if the lines don't tell."""
    found = _statements(indent).findall(code)
    if "\n".join(found) != code:
        raise ValueError("lines without a statement")
    for s, n in Counter(found).items():
        head, _, body = s.partition("\n")
        if not body or not _DEF.fullmatch(head):
            yield s, inside, n * times
            continue
        if (own := _header(head)) is None or own.name == _ANY and not isinstance(own, ast.ClassDef):
            raise ValueError("a head of several lines")
        yield f"{head} pass", inside, n * times
        yield from _pieces(body, len(body) - len(body.lstrip(" ")), inside if isinstance(own, ast.ClassDef) else own.name, n * times)


def _by_statement(code: str) -> tuple[Counter, set, set] | None:
    """What ``_walked`` finds in code, statement by statement; None if it has to be parsed whole.

    Statements that can each be parsed are together what they are alone, whatever their
    names are but for calls and imports. Programs repeat few shapes of statements under
    many names, so most statements are counted, not parsed."""
    if not code.isascii() or any(x in code for x in _HARD):
        return None
    if "#" in code:
        code = _COMMENT.sub(lambda m: m[1] or "", code)
    if code.endswith("\n") or "\n\n" in code or " \n" in code or code.startswith("\n"):
        code = _BLANK.sub("", code)
    alike: Counter = Counter()
    if "import" in code:
        lines = code.split("\n")
        for i, line in enumerate(lines):
            if "import" in line and (m := _IMPORT.fullmatch(line)):
                alike[m[2], None] += 1
                lines[i] = f"{m[1]}pass"
        code = "\n".join(lines)
    try:
        for x, inside, n in _pieces(_NAME.sub(_ANY, code)):
            alike[x, inside] += n
    except ValueError:
        return None
    kinds, imports, calls = Counter(), set(), set()
    for (x, inside), n in alike.items():
        if (found := _alone(x)) is None:
            return None
        for kind, m in found[0].items():
            kinds[kind] += n * m
        imports |= found[1]
        calls.update((f or inside, callee) for f, callee in found[2])
    return kinds, imports, calls


def _edged(module: str, found: tuple[Counter, set, set] | None) -> tuple[Counter, set, set]:
    """Nodes by kind, import edges module -> module, and call edges of the innermost function to plainly named callees."""
    kinds, imports, calls = found or (Counter(), (), ())
    return kinds, {(module, x) for x in imports}, {(f"{module}:{f}", f"{module}:{x}") for f, x in calls if f}


def _scan(module: str, tree: ast.AST | None) -> tuple[Counter, set, set]:
    return _edged(module, None if tree is None else _walked(tree))


def _scanned(module: str, code: str) -> tuple[Counter, set, set]:
    """``_scan`` of code whose tree isn't needed."""
    found = _by_statement(code)
    return _scan(module, parsed(code)) if found is None else _edged(module, found)


def _edges(module: str, code: str) -> tuple[set, set]:
    """Import edges module -> module, and call edges of the innermost function to plainly named callees."""
    return _scanned(module, code)[1:]


def file_features(module: str, before: str, after: str, edits: bool = True) -> tuple[list[int], tuple[set, ...]]:
    """Node counts (before, after, difference), edit lengths (0 without edits), and the edge sets of both sides."""
    trees = [parsed(before), parsed(after)] if edits else []
    (b, *old), (a, *new) = (_scan(module, t) for t in trees) if edits else (_scanned(module, x) for x in (before, after))
    out = [b[t] for t in _KINDS] + [a[t] for t in _KINDS] + [abs(a[t] - b[t]) for t in _KINDS]
    lengths = dict.fromkeys(EDITS, 0)
    if edits and None not in trees:
        walks = [[type(x).__name__ for x in ast.walk(t)] for t in trees]
        for tag, i, j, k, m in SequenceMatcher(a=walks[0], b=walks[1]).get_opcodes():
            lengths[tag] += (j - i) + (m - k)
    return out + [lengths[e] for e in EDITS], (*old, *new)


def _featured(edits: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, whole.num_rows, AT_ONCE)):
        tree, deltas = [], []
        for b, a in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
            b, a = ({e["key"]: e["value"] for e in x or ()} for x in (b, a))
            total, sets = [0] * (3 * len(NODE_TYPES) + 4), [set(), set(), set(), set()]
            for path in sorted(b.keys() | a.keys()):
                stem, dot, _ = path.rpartition(".")
                with _uncollected():
                    values, edges = file_features((stem if dot else path).replace("/", "."), b.get(path) or "", a.get(path) or "", edits)
                total = [x + y for x, y in zip(total, values, strict=True)]
                for s, e in zip(sets, edges, strict=True):
                    s |= e
            tree.append([float(x) for x in total])
            row = []
            for old, new in ((sets[0], sets[2]), (sets[1], sets[3])):
                n_old, n_new = ({v for e in s for v in e} for s in (old, new))
                row += [len(n_old), len(old), len(n_new), len(new), len(new - old), len(old - new), len(n_new - n_old), len(n_old - n_new)]
            deltas.append([float(x) for x in row])
        kind = pa.list_(pa.float32())
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(tree, kind), pa.array(deltas, kind)], ["id", "tree", "graph"])


def code_features(changes: DataFrame, edits: bool = True) -> DataFrame:
    """id, tree (43 values) and graph (16 values) of changes (id, language, before_blobs, after_blobs).

    Without edits, the last four values of tree are 0: matching two trees costs as much as parsing them. Python changes are parsed once for both; all others have zeros and skip the Python stage."""
    kind = changes.schema["id"].dataType.simpleString()
    own = changes.filter("language = 'python'").select("id", F.map_entries("before_blobs").alias("b"), F.map_entries("after_blobs").alias("a"))
    own = own.mapInArrow(partial(_featured, edits), f"id {kind}, tree array<float>, graph array<float>")
    rest = changes.filter("NOT language <=> 'python'").select(
        "id", F.array_repeat(F.lit(0.0).cast("float"), 3 * len(NODE_TYPES) + 4).alias("tree"), F.array_repeat(F.lit(0.0).cast("float"), 16).alias("graph")
    )
    return own.unionByName(rest)


@F.udtf(returnType="kind string, is_after boolean, src string, dst string", useArrow=True)
class _Edges:
    """The import and call edges of both sides of a change, each once."""

    def eval(self, before, after):
        before, after = before or {}, after or {}
        sets = {(kind, side): set() for kind in ("imports", "calls") for side in (False, True)}
        for path in before.keys() | after.keys():
            stem, dot, _ = path.rpartition(".")
            module = (stem if dot else path).replace("/", ".")
            for side, texts in ((False, before), (True, after)):
                with _uncollected():
                    found = _edges(module, texts.get(path) or "")
                for kind, own in zip(("imports", "calls"), found, strict=True):
                    sets[kind, side] |= own
        for (kind, side), found in sets.items():
            for src, dst in sorted(found):
                yield kind, side, src, dst


def change_edges(changes: DataFrame) -> DataFrame:
    """id, kind (imports or calls), is_after, src and dst of the edges of Python changes (id, language, before_blobs, after_blobs)."""
    own = changes.filter("language = 'python'").select("id", "before_blobs", "after_blobs")
    return own.lateralJoin(_Edges(F.col("before_blobs").outer(), F.col("after_blobs").outer())).select("id", "kind", "is_after", "src", "dst")


def graph_deltas(edges: DataFrame) -> DataFrame:
    """What each id's change does to each kind of graph that it has edges of: the counts of ``graph_delta``, over an edge table of any size a change.

    The table is read once: edges and nodes become one row each with the sides that have
    them, then counts. Rows without an id or a kind belong to no change."""
    rows = edges.dropna(subset=["id", "kind"])
    parts = F.array(*[F.struct(F.lit(is_edge).alias("is_edge"), src.alias("src"), dst.alias("dst")) for is_edge, src, dst in ((True, F.col("src"), F.col("dst")), (False, F.col("src"), F.lit(None)), (False, F.col("dst"), F.lit(None)))])
    rows = rows.select("id", "kind", "is_after", F.inline(parts))
    rows = rows.groupBy("id", "kind", "is_edge", "src", "dst").agg(F.bool_or(~F.col("is_after")).alias("b"), F.bool_or("is_after").alias("a"))
    b, a, edge = F.col("b"), F.col("a"), F.col("is_edge")
    n = lambda own, what: [F.count_if(own & hit).alias(f"{what}_{name}") for name, hit in (("before", b), ("after", a), ("added", a & ~b), ("removed", b & ~a))]
    return rows.groupBy("id", "kind").agg(*n(edge, "edges"), *n(~edge, "nodes"))


def assembled(parts: list[DataFrame]) -> DataFrame:
    """The features arrays of several (id, features) tables, concatenated in order."""
    out = parts[0].withColumnRenamed("features", "f0")
    for k, p in enumerate(parts[1:], 1):
        out = out.join(p.withColumnRenamed("features", f"f{k}"), "id")
    return out.select("id", F.concat(*[F.col(f"f{k}") for k in range(len(parts))]).alias("features"))
