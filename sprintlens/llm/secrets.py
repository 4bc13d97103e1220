"""Secret scans by grammar inference: automata learnt from credentials that rules label.

Rules with three kinds label credentials: values assigned to telling names, access keys and
hexadecimal runs. The distinct values of a kind become a prefix tree with counts, and
states whose outgoing symbols, ends and successors are statistically compatible (Hoeffding
bounds, ALERGIA's red and blue order) are merged, which leaves a probabilistic automaton of
the kind's format. The runs that no rule covers give automata of ordinary text in the same
way, one for each set of marks (of ``+/_.=-``) that a run holds, so that addresses and
numbers with points have one that words don't fill. Every run of credential characters that
no rule covers is then scored: the log likelihood a character under the best kind's
automaton, less that under the ordinary one of its marks or of runs without marks, whichever
is larger. From ``MARGIN`` nats a character its span is added as ``like_<kind>``.

Samples for the inference are the ``bound`` values of each kind with the smallest hashes,
over all documents; each task passes on that many of a kind at most, and the automata are
bounded by them. Scoring covers every run of every text, in the task that holds the text.

Base matches are leftmost and non-overlapping by kind, letters of the names in either case
(ASCII only), and matches whose value is too short are dropped after matching. Spans are
code points, end exclusive, of the whole match, so an assignment's span begins with its
name. A null text is empty and has no spans, whose digest is that of the empty string. Rows
are scored one by one, so repeated or null doc_ids do no harm; columns besides doc_id and
text are ignored; an empty table gives an empty result, and kinds that no text shows give no
automaton. Runs may have any length.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread_table

#: The base rules: kind, pattern, group that holds the value, least length of the value. Fixed values.
#: A maximal run that is too short holds no run that is long enough, so the last two may ask
#: for their length at once; an assignment may not, as a short one hides what it overlaps.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (("assign", ASSIGN, re.IGNORECASE, 2, 12), ("access", r"AKIA[A-Z0-9]{14,}", 0, 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 0, 16))
KINDS = tuple(r[0] for r in RULES)
#: Texts without any of these, lower-cased, hold no assignment.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Runs that are scored, and the marks of sentences that don't count at their ends.
LEAST = 12
ENDS = "._=-/+"
#: Values of a kind that automata are learnt from; fewer than FEWEST distinct ones are no format.
BOUND, FEWEST = 1500, 10
#: Confidence of the tests for unequal frequencies: smaller values merge more.
ALPHA = 0.05
#: Nats a character by which a kind has to be ahead of ordinary text.
MARGIN = 1.0
#: Weight of symbols that a state hasn't shown, spread over the alphabet.
UNSEEN, SYMBOLS = 0.5, 96
#: Ordinary runs go by this name and their marks.
ORDINARY, MARKS = "ordinary", frozenset("+/_.=-")


# -- inference -----------------------------------------------------------------------


class Automaton:
    """States with symbol counts, successors and ends; state 0 is the start."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends, self.visits = [0], [0]
        for w in words:
            at = 0
            self.visits[0] += 1
            for c in w:
                self.count[at][c] = self.count[at].get(c, 0) + 1
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                at = to
                self.visits[at] += 1
            self.ends[at] += 1

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether both states may have one distribution; b is the root of a tree."""
        spread = math.sqrt(0.5 * math.log(2 / alpha))
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits[a], self.visits[b]
            if not n or not m:
                continue
            bound = spread * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound >= 1:
                continue  # no difference shows at so few visits, nor further down the tree
            if abs(self.ends[a] / n - self.ends[b] / m) >= bound:
                return False
            x, y = self.count[a], self.count[b]
            for c in x.keys() | y.keys():
                if abs(x.get(c, 0) / n - y.get(c, 0) / m) >= bound:
                    return False
                if c in x and c in y:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the tree under b to a and what follows it."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of the words: a prefix tree whose compatible states are merged, red by blue.

    Red states stay; blue ones are the roots of trees that follow them, taken by the most
    visits first, so that a merge rests on as much evidence as there is."""
    m = Automaton(sorted(words))
    red, blue = [0], {(0, c): to for c, to in m.next[0].items()}
    while blue:
        (owner, symbol), b = max(blue.items(), key=lambda x: (m.visits[x[1]], -x[1]))
        target = next((r for r in red if m.compatible(r, b, alpha)), None)
        if target is None:
            red.append(b)
        else:
            m.next[owner][symbol] = target
            m.fold(target, b)
        kept = set(red)
        blue = {(r, c): to for r in red for c, to in m.next[r].items() if to not in kept}
    return _renumbered(m, red)


def _renumbered(m: Automaton, red: list[int]) -> Automaton:
    number = {r: k for k, r in enumerate(red)}
    out = Automaton([])
    out.next = [{c: number[to] for c, to in m.next[r].items()} for r in red]
    out.count, out.ends, out.visits = ([x[r] for r in red] for x in (m.count, m.ends, m.visits))
    return out


#: A state as the scorer reads it: (log probability and successor of each symbol), of any other symbol, of an end.
State = tuple[dict[str, tuple[float, int]], float, float]


def table(m: Automaton) -> list[State]:
    """Smoothed log probabilities; a symbol that a state hasn't shown stays in the state."""
    out = []
    for counts, to, ends, visits in zip(m.count, m.next, m.ends, m.visits, strict=True):
        whole = visits + UNSEEN
        unseen = math.log(UNSEEN / SYMBOLS / whole)
        out.append(({c: (math.log((n + UNSEEN / SYMBOLS) / whole), to[c]) for c, n in counts.items()}, unseen, math.log((ends + UNSEEN / SYMBOLS) / whole)))
    return out


def likelihood(states: list[State], word: str) -> float:
    """Log probability a character of the word, its end included."""
    at, total = 0, 0.0
    for c in word:
        known, unseen, _ = states[at]
        p, at = known.get(c, (unseen, at))
        total += p
    return (total + states[at][2]) / (len(word) + 1)


def best_kind(automata: dict[str, list[State]], word: str) -> tuple[str | None, float]:
    """The kind under which the word is likeliest, and how far that is ahead of ordinary text."""
    kinds = [(likelihood(automata[k], word), k) for k in KINDS if k in automata]
    ordinary = [likelihood(automata[k], word) for k in {ORDINARY, ordinary_kind(word)} if k in automata]
    if not kinds or not ordinary:
        return None, 0.0
    p, kind = max(kinds, key=lambda x: x[0])
    return kind, p - max(ordinary)


def ordinary_kind(word: str) -> str:
    return ORDINARY + "".join(sorted(MARKS & set(word)))


# -- spans ---------------------------------------------------------------------------


def _rules() -> list[tuple[str, re.Pattern, int, int]]:
    return [(kind, re.compile(p, flags | re.ASCII), group, least) for kind, p, flags, group, least in RULES]


def base_spans(rules: list, text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind, end, value) of the base matches, sorted."""
    out = []
    low = text.lower()
    for place, (kind, pattern, group, least) in enumerate(rules):
        if kind == "assign" and not any(n in low for n in NAMES):
            continue
        out += [(m.start(), place, m.end(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out)


def candidates(runs: re.Pattern, text: str, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, str]]:
    """(start, value) of the runs of credential characters that no base span touches."""
    covered = iter(sorted((s, e) for s, _, e, _ in base))
    at = next(covered, None)
    for m in runs.finditer(text):
        start, value = m.start(), m[0].rstrip(ENDS)
        start += len(value) - len(value := value.lstrip(ENDS))
        if len(value) < LEAST:
            continue
        while at is not None and at[1] <= start:
            at = next(covered, None)
        if at is None or at[0] >= start + len(value):
            yield start, value


RUN = r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST


def _samples(bound: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each kind the values with the smallest hashes among the texts of a task."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, runs = _rules(), re.compile(RUN)
        held: defaultdict[str, dict[str, int]] = defaultdict(dict)

        def cut(k: str) -> None:
            held[k] = dict(heapq.nsmallest(bound, held[k].items(), key=lambda x: (x[1], x[0])))

        def add(k: str, value: str) -> None:
            held[k][value] = xxhash.xxh64_intdigest(value, 5) >> 1
            if len(held[k]) >= 4 * bound:
                cut(k)

        for b in batches:
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                base = base_spans(rules, text)
                for _, place, _, value in base:
                    add(KINDS[place], value)
                for _, value in candidates(runs, text, base):
                    add(ordinary_kind(value), value)
        for k in list(held):
            cut(k)
        rows = [(k, v, h) for k, own in held.items() for v, h in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.string(), pa.string(), pa.int64()), strict=True)], ["kind", "value", "h"])

    return sample


def learn(docs: DataFrame, bound: int = BOUND, alpha: float = ALPHA) -> dict[str, list[State]]:
    """The automata of the kinds that the documents show, and that of ordinary runs.

    At most ``bound`` distinct values of a kind reach the driver: those with the smallest
    hashes, whatever the tasks."""
    values = docs.select("text").mapInArrow(_samples(bound), "kind string, value string, h bigint").distinct()
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("h", "value"))
    sample: dict[str, list[str]] = {}
    for r in values.withColumn("rank", rank).filter(F.col("rank") <= bound).collect():
        sample.setdefault(r["kind"], []).append(r["value"])
    return {k: table(infer(v, alpha)) for k, v in sample.items() if len(v) >= FEWEST}


def _scanned(automata, margin: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, runs = _rules(), re.compile(RUN)
        known: dict[str, tuple[str | None, float]] = {}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ahead", pa.float64())]))
        for b in batches:
            spans = []
            for text in b.column(1).to_pylist():
                base = base_spans(rules, text or "")
                own = [(s, place, {"kind": KINDS[place], "start": s, "end": e, "ahead": None}) for s, place, e, _ in base]
                for s, value in candidates(runs, text or "", base):
                    if value not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[value] = best_kind(automata.value, value)
                    name, ahead = known[value]
                    if name is not None and ahead >= margin:
                        own.append((s, len(KINDS) + KINDS.index(name), {"kind": f"like_{name}", "start": s, "end": s + len(value), "ahead": ahead}))
                spans.append([x for *_, x in sorted(own, key=lambda x: x[:2])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return scan


def secret_spans(docs: DataFrame, automata: dict[str, list[State]], margin: float = MARGIN) -> DataFrame:
    """doc_id and spans, by start and then kind: kind, start, end, and for added ones how far they are ahead."""
    shared = docs.sparkSession.sparkContext.broadcast(automata)
    return docs.select("doc_id", "text").mapInArrow(_scanned(shared, margin), "doc_id bigint, spans array<struct<kind string, start bigint, end bigint, ahead double>>")


def masked(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents of unique doc_ids with ``[<kind>]`` in the place of every span; overlapping spans go with the first."""
    piece = lambda acc, s: F.when(
        s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
    ).otherwise(acc)
    body = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), piece, lambda acc: F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), F.length("text"))))
    return docs.select("doc_id", "text").join(spans, "doc_id").select("doc_id", body.alias("text"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    docs = spread_table(spark, sf_dir, "documents", "doc_id")
    found = secret_spans(docs, learn(docs))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    n = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
