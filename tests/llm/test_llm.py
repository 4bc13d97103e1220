"""The training-data operators against brute force, SQL, round trips and held-out labels."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sprintlens.llm import components, exact_dedup, fixity, mixture, packing, quality_model, quality_rules, queries, simhash, substring_dedup, toxicity, url_filters
from sprintlens.llm.common import Scratch, join_groups, passing, running_sums, spread_table, table, tokenizer_path

TABLES = "documents pages labels embeddings".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Nulls, blanks, ties, a very long text, a repeated row, and extra columns whose names clash.
ODD = [
    (1, None, "b"), (2, "", "b"), (3, " \n\t ", None), (4, "one", "a"), (5, "one two", "a"), (6, "one two", "a"), (6, "one two", "a"),
    (7, "word " * 30000, "c"), (8, "Ä b c " * 12 + "\x0b\x0c x", "a"), (9, "ä b c " * 12 + "x", None), (10, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "a"), (11, "z a b c d e f g h i j k l m n o p q r s t u v w x y z", "c"),
    (None, "no key", "a"),
]
CLASH = ("n_words", "kept", "recipe", "fp", "component_id", "size", "h", "id", "key", "score", "x", "y", "length", "band", "text_sha256", "n", "node", "lang", "host", "blocked", "__times", "__copy", "row", "body", "tie", "batch", "__row", "__none", "side", "times")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, source string")
    return df.select("*", *[F.lit(1).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def against(con, df, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    return rows(df.select(*cols)), sorted((tuple(r) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, duck, sf, name):
    got, want = against(duck, queries.queries()[name](spark, sf), queries.oracle_sql()[name])
    assert got == want and got


@pytest.fixture(scope="module")
def odd_duck(odd):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", ODD)
    return con


# -- rules, mix, exact dedup on odd rows ---------------------------------------------


def test_rules_odd(odd, none, odd_duck):
    df = quality_rules.quality_rules(odd).select("__row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got, want = against(odd_duck, df, quality_rules.sql())
    assert got == want
    assert quality_rules.keep_good(odd).columns == odd.columns and quality_rules.keep_good(none).count() == 0
    # a filter on any measure stays above the array functions
    assert quality_rules.quality_rules(odd).filter("n_repeat_words > 10 AND kept").count() >= 0


def test_mixture_odd(odd, none, odd_duck):
    got, want = against(odd_duck, mixture.mixture(odd).select("doc_id", "size", "source_size", "target", "taken"), mixture.sql())
    assert got == want
    assert mixture.mixture(none).count() == 0 and mixture.mixed(odd).columns == odd.columns


def test_mixture_targets_are_met_and_capped(spark, sf):
    df = mixture.mixture(table(spark, sf, "documents")).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("size").alias("m"), F.max("source_size").alias("s"), F.max(F.col("taken") / F.col("size")).alias("r"))
    for r in df.collect():
        assert abs(r.t - r.g) <= r.m and r.g <= 3 * r.s and r.r <= 3


def test_mixture_bands_do_not_matter(odd):
    assert rows(mixture.mixture(odd, bands=1)) == rows(mixture.mixture(odd, bands=7))


def test_mixed_rows_without_and_with_equal_doc_ids(spark):
    """Each row is taken by its own place, whatever its doc_id and the columns' names."""
    texts = ["a b c", "d e", "f", "g h i j", "k l", "a b c"]
    docs = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, texts[k % 6], f"s{k % 4}", k) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, at int").select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH) if c != "size"])
    takes = mixture.mixture(df, carry=("at",)).collect()
    alike = [docs[k][:3] for k in range(60)]  # rows that tie in all of these are taken in any order
    want = sorted(str(alike[r.at]) for r in takes for _ in range(r.epochs + r.picked) if r.taken)
    got = mixture.mixed(df)
    assert got.columns == df.columns and sorted(str(alike[r.at]) for r in got.collect()) == want
    again = mixture.mixture(df.repartition(3, "at"), carry=("at",))
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again.collect()) == sorted((str(r.doc_id), r.size, r.taken) for r in takes)


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).select(F.pmod(F.hash("id"), F.lit(50)).alias("k"), "id", (F.col("id") % 7).alias("v"))
    got = running_sums(df, Scratch(spark, "t"), "r", [F.col("k").desc(), F.col("id")], ["v"]).collect()
    total = 0
    for r in sorted(got, key=lambda r: (-r.k, r.id)):
        assert r.v_before == total
        total += r.v
    assert len(got) == 1000


def test_targets_of_many_sources_against_a_loop(spark):
    """Levels of capped shares over thousands of sources, against water filling round by round."""
    r = np.random.default_rng(1)
    sizes = {f"s{k:04d}": int(x) for k, x in enumerate(r.integers(0, 10**6, 3000) ** 2 // 10**6)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {x.source: x.target for x in mixture.targets(df, Scratch(spark, "t")).collect()}
    names = sorted(sizes)
    weight, cap = np.array([1 + k % 3 for k in range(len(names))], float), 3.0 * np.array([sizes[n] for n in names])
    out, left, open_ = np.zeros(len(names)), float(sum(sizes.values())), np.ones(len(names), bool)
    while open_.any() and left > 1e-6:
        share = left * weight / weight[open_].sum()
        full = open_ & (out + share >= cap)
        if not full.any():
            out[open_] += share[open_]
            break
        left -= (cap - out)[full].sum()
        out[full] = cap[full]
        open_ &= ~full
    assert np.allclose([got[n] for n in names], out, rtol=1e-9, atol=1e-6)


def test_exact_odd(odd, none, odd_duck):
    sql = exact_dedup.sql().replace("doc_id = keep_id AS kept", "coalesce(doc_id = keep_id, keep_id IS NULL) AS kept")
    for size, cuts in ((16, (4096, 8192, 65536)), (16, (8, 16, 64)), (1, (8, 16, 64))):  # a one-byte digest clashes all the time
        got, want = against(odd_duck, exact_dedup.exact_dedup(odd, size, cuts), sql)
        assert got == want
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.keep_one(odd).columns == odd.columns


def test_chunks_are_content_defined():
    r = np.random.default_rng(0)
    a = r.integers(97, 123, 300_000, np.uint8).tobytes()
    cuts = exact_dedup.cut(a)
    assert b"".join(cuts) == a and max(map(len, cuts)) <= exact_dedup.MAX_CHUNK
    moved = exact_dedup.cut(b"some words ahead " + a)
    assert len(set(cuts) & set(moved)) >= len(cuts) - 3


# -- near dedup ----------------------------------------------------------------------


def brute_fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fp):
    ids = sorted(fp)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    fp = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    want = brute_components(fp)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.queries()["op2_simhash"](spark, sf).collect()}
    assert got == {i: (fp[i], want[i]) for i in fp}


def test_simhash_odd(odd, none):
    fp = {i: brute_fingerprint(t) for i, t, _ in ODD if i is not None}
    want = brute_components(fp)
    got = simhash.near_dedup(odd).collect()
    assert len(got) == len(ODD)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash.near_dedup(none).count() == 0
    assert simhash.keep_one(odd).columns == odd.columns


def test_crowded_buckets_are_split(spark):
    """Near fingerprints around a few centres; the split of crowded keys changes nothing."""
    r = np.random.default_rng(3)
    fps = {0}
    for c in r.integers(0, 2**63, 4):
        for _ in range(60):
            fps.add(int(c) ^ sum(1 << int(k) for k in r.choice(63, 2, replace=False)))
    fps = sorted(fps)
    nodes = spark.createDataFrame(list(zip(fps, range(len(fps)), strict=True)), "fp bigint, node bigint")
    want = {k: v for k, v in brute_components(dict(enumerate(fps))).items()}
    for split in (1 << 16, 4):
        part = components.components(simhash.near_links(nodes, Scratch(spark, "t"), split))
        got = {**{k: k for k in want}, **{x.node: x.component for x in part.collect()}}
        assert got == want


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6))
def test_dense_and_flip_paths_agree(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, dtype=np.uint64)
    flips = r.integers(0, 2**20, 90, dtype=np.uint64) & r.integers(0, 2**20, 90, dtype=np.uint64)
    fp = np.unique(base ^ flips)
    a = simhash.linked(fp)
    old, simhash.DENSE = simhash.DENSE, 0
    try:
        assert (simhash.linked(fp) == a).all()
    finally:
        simhash.DENSE = old


def test_each_row_is_decided_without_a_doc_id(spark):
    """Null and repeated ids: of each group one row stays, and near copies link through rows without an id."""
    base = " ".join(f"w{i}" for i in range(400))
    fp, near = brute_fingerprint(base), []
    for k in range(400):  # texts of one changed word, up to two links away from the first
        t = base.replace(f"w{k} ", "other ", 1)
        near.append((t, brute_fingerprint(t)))
    b, fb = next((t, f) for t, f in near if 0 < (f ^ fp).bit_count() <= 3)
    c = next((t for t in (b.replace(f"w{k} ", "more ", 1) for k in range(400)) if 0 < (brute_fingerprint(t) ^ fb).bit_count() <= 3 < (brute_fingerprint(t) ^ fp).bit_count()), None)
    assert c
    docs = [(5, base), (None, b), (9, c), (None, "only null"), (None, "only null"), (None, base), (3, "x y z"), (3, "x y z"), (3, "a text of its own"), (None, "x y z"), (None, None), (None, "")]
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(docs)], "doc_id bigint, text string, at int")
    kept = [(r.doc_id, r.text or "") for r in exact_dedup.keep_one(df).collect()]
    assert sorted(kept, key=repr) == sorted([(5, base), (None, b), (9, c), (None, "only null"), (3, "x y z"), (3, "a text of its own"), (None, "")], key=repr)
    kept = [(r.doc_id, r.text or "") for r in simhash.keep_one(df).collect()]
    assert sorted(kept, key=repr) == sorted([(5, base), (None, "only null"), (3, "x y z"), (3, "a text of its own"), (None, "")], key=repr)
    assert {r.component_id for r in simhash.near_dedup(df).collect() if r.doc_id in (5, 9)} == {5}
    a, b = "a" * 40 + "b" * 40, "a" * 40 + "c" * 40
    short = exact_dedup.exact_dedup(spark.createDataFrame([(None, a), (None, b), (7, a), (7, b)] + [(None, f"{i}" * 30) for i in range(9)], "doc_id bigint, text string"), 1, (8, 16, 64))
    assert sorted(r.group_size for r in short.collect()) == [1] * 9 + [2] * 4


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- substring dedup -----------------------------------------------------------------


def brute_substrings(docs):
    seen, out = {}, defaultdict(list)
    for d, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        w, gone = WORD.findall(t or ""), set()
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if seen.setdefault(k, (d, i)) != (d, i):
                gone.update(range(i, i + 20))
        out[d].append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return {d: sorted(v) for d, v in out.items()}


def substrings(df, **options):
    got = defaultdict(list)
    for r in substring_dedup.substring_dedup(df, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect():
        got[r[0]].append(tuple(r[1:]))
    return {d: sorted(v) for d, v in got.items()}


@pytest.mark.parametrize("options", [{}, {"batches": 4, "hot": 3}, {"batches": 1}])
def test_substrings_against_brute_force(spark, sf, options):
    docs = table(spark, sf, "documents")
    assert substrings(docs, **options) == brute_substrings([(r.doc_id, r.text) for r in docs.collect()])


def _added(index, df, token=None):
    return {r.doc_id: [(r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest())] for r in index.add(df, token).collect()}


def test_substrings_batch_after_batch(spark, sf):
    """Five batches through an index that each reopens by its path give what one call gives; runs are compacted twice and read again."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    want = brute_substrings([(r.doc_id, r.text) for r in docs.collect()])
    path, got, levels = substring_dedup.FingerprintIndex(spark).path, {}, []
    for lo, hi in ((-1, 60), (60, 90), (90, 130), (130, 170), (170, 10**9)):
        index = substring_dedup.FingerprintIndex(spark, path)
        for name in {x for r in index.runs for x in (r.counts, r.postings)} | set(index.texts):  # another session's catalog doesn't know the tables
            spark.sql(f"DROP TABLE {name}")
        got |= _added(index, docs.filter((F.col("doc_id") > lo) & (F.col("doc_id") <= hi)))
        levels.append([r.level for r in index.runs])
    assert got == want and levels == [[0], [1], [1, 0], [2], [2, 0]]
    # old postings and texts stay in their buckets: only what matched is dealt anew
    plan = index._met(index.runs[0], index._repeated(index.runs[-1]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    texts = index.kept(4)._jdf.queryExecution().executedPlan().toString()
    assert texts.count("Exchange hashpartitioning") == 1
    assert index._names(f"{path}/manifest") == ["5"]
    named = {x for r in index.runs for x in r.tables()} | set(index.texts) | set(index.ranges)
    index._sweep()  # what the plan above wrote
    assert {x for x in index._names(path) if x != "manifest"} == named
    index.close()
    assert not spark._jvm.java.io.File(path.removeprefix("file://")).exists()


def _fails_at(index, step):
    """Makes the index fail at its step-th write, or at its commit before or after the manifest is whole."""
    write, commit, left = index._write, index._commit, [step]

    def failing(df, kind):
        left[0] -= 1
        if left[0] == 0:
            raise ZeroDivisionError(kind)
        return write(df, kind)

    def committing():
        if step == "after":
            commit()
        raise ZeroDivisionError

    index._write, index._commit = (failing, commit) if isinstance(step, int) else (write, committing)


@pytest.mark.parametrize("step", [1, 5, 6, "before", "after"])
def test_substrings_batch_that_fails(spark, step):
    """Whatever write fails, the batch counts once and can be added again: nothing is removed as a repeat of itself."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    own = spark.createDataFrame([(2, f"x {a}"), (3, b), (4, f"{b} {b}")], "doc_id bigint, text string")
    index = substring_dedup.FingerprintIndex(spark)
    index.add(spark.createDataFrame([(1, a)], "doc_id bigint, text string"), "first")
    _fails_at(index, step)
    with pytest.raises(ZeroDivisionError):
        index.add(own, "second")
    if step in (1, 6, "after"):  # the same session goes on
        del index._write, index._commit
    else:
        index = substring_dedup.FingerprintIndex(spark, index.path)
    got = _added(index, own, "second")
    assert {k: v[0][:2] for k, v in got.items()} == {2: (61, 60), 3: (60, 0), 4: (120, 120)} and index.tokens == ["first", "second"]
    index = substring_dedup.FingerprintIndex(spark, index.path)
    assert _added(index, own, "second") == got and len(index.texts) == 2
    assert {k: v[0][1] for k, v in _added(index, own, "third").items()} == {2: 61, 3: 60, 4: 120}
    index.close()


def test_substrings_lost_result(spark):
    """A result that was lost after the batch counted comes again under its token."""
    a = " ".join(f"a{i}" for i in range(60))
    own = spark.createDataFrame([(1, a), (2, f"{a} tail")], "doc_id bigint, text string")
    index = substring_dedup.FingerprintIndex(spark)
    index.kept = lambda batch: 1 / 0
    with pytest.raises(ZeroDivisionError):
        index.add(own, "only")
    again = substring_dedup.FingerprintIndex(spark, index.path)
    assert {k: v[0][:2] for k, v in _added(again, own, "only").items()} == {1: (60, 0), 2: (61, 60)} and len(again.texts) == 1
    again.close()


def test_substrings_odd(odd, none):
    assert substrings(odd, hot=5) == brute_substrings([(d, t) for d, t, _ in ODD])
    assert substrings(none) == {}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=70), max_size=5))
def test_substrings_of_periodic_texts(spark, texts):
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    assert substrings(spark.createDataFrame(docs, "doc_id bigint, text string"), hot=4) == brute_substrings(docs)


@pytest.mark.parametrize("options", [{}, {"batches": 3, "hot": 2}])
def test_substrings_of_rows_that_doc_id_does_not_tell_apart(spark, options):
    """Null and repeated ids: each row is a document, in the order of doc_id and text digest."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 30), ("b", 90), ("c", 25), ("d", 60)))
    docs = [(1, c), (None, a), (None, f"{b} {a}"), (None, f"{b} {c}"), (None, d), (None, d), (7, b), (7, f"{d} tail"), (7, f"{d} tail"), (7, None)]
    for own in (docs, [x for x in docs if x[0] != 7]):  # with and without repeated ids
        ordered = sorted(own, key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5((x[1] or "").encode()).digest()))
        want, ids = defaultdict(list), dict(enumerate(x[0] for x in ordered))
        for k, v in brute_substrings([(k, t) for k, (_, t) in enumerate(ordered)]).items():
            want[ids[k]] = sorted(want[ids[k]] + v)
        assert substrings(spark.createDataFrame(own, "doc_id bigint, text string"), **options) == want


def test_substrings_index_knows_repeated_ids_of_older_batches(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    index = substring_dedup.FingerprintIndex(spark)
    index.add(spark.createDataFrame([(2, a), (2, b)], "doc_id bigint, text string"))
    got = _added(index, spark.createDataFrame([(1, f"x {b}"), (2, a)], "doc_id bigint, text string"))
    assert [got[k][0][:2] for k in (1, 2)] == [(61, 60), (60, 60)]
    index.close()


# -- packing -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(packing.VOCABULARY))


@pytest.fixture(scope="module")
def word_ids(tokenizer):
    return packing._Ids(tokenizer.to_str())


def check_packing(got, docs, tokenizer):
    want = sorted([*(tokenizer.encode(t or "", add_special_tokens=False).ids), 1] for _, t in docs)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for d, parts in by_doc.items():
        copies = [[*(tokenizer.encode(t or "", add_special_tokens=False).ids), 1] for i, t in docs if i == d]
        assert len({tuple(c) for c in copies}) == 1
        ids = copies[0]
        assert sum(p.length for p in parts) == len(ids) * len(copies)
        for p in parts:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    assert sum(len(x) for x in want) == sum(r.length for r in got)
    return len(by_seq)


def test_packing(spark, sf, tokenizer):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = packing.pack(table(spark, sf, "documents")).collect()
    check_packing(got, docs, tokenizer)
    filled = defaultdict(int)
    for r in got:
        filled[r.sequence_id] += r.length
    padding = sum(2048 - n for n in filled.values() if n & n - 1)
    assert padding <= 0.02 * sum(filled.values())


def test_packing_odd(odd, none, tokenizer):
    check_packing(packing.pack(odd, slots=3).collect(), [(d, t) for d, t, _ in ODD], tokenizer)
    assert packing.pack(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abcHÉéİΣσß 's'tre\t\n\r\x0b\x0c\x1c\x1f\x85\xa0　́̈<|>09.,!漢👍", "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "x<|StartOfText|>", "<|startoftext|>", "H̱", ", ", "'ve "]), max_size=40))
def test_words_encode_apart(tokenizer, word_ids, parts):
    text = "".join(parts)
    assert word_ids.texts([text, "x", text])[2] == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=8), st.integers(0, 60))
def test_closest_subset_sum(counts, room):
    sums = {0}
    for x, n in counts.items():
        sums = {s + k * x for s in sums for k in range(n + 1)}
    found = packing.closest(counts, room)
    assert sum(x * n for x, n in found.items()) == max(s for s in sums if s <= room)
    assert all(n <= counts[x] for x, n in found.items())


def test_sequences_stop_at_powers_of_two_where_nothing_fills_the_window():
    steps = packing.plan({5: 1, 3: 1, 4: 1}, 16)
    totals = defaultdict(int)
    for length, _, copies, sequence, _ in steps.tolist():
        totals[sequence] += length * copies
    assert sorted(totals.values()) == [4, 8]


# -- classifiers ---------------------------------------------------------------------


def auc(score, y):
    order = np.argsort(np.argsort(score))
    pos = (y == 1).sum()
    return (order[y == 1].sum() - pos * (pos - 1) / 2) / (pos * (len(y) - pos))


def held_out(spark, df, label, sf_dir):
    j = df.filter("held_out").join(table(spark, sf_dir, "labels"), "doc_id").toPandas()
    return auc(j["score"].to_numpy(), j[label].to_numpy()), j


def test_quality_model_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    df = queries.queries()["op3_quality_model"](spark, sf_dir)
    assert df.count() == table(spark, sf_dir, "documents").count()
    a, j = held_out(spark, df, "quality", sf_dir)
    assert a > 0.97 and (j["predicted"] == j["quality"]).mean() > 0.95


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=toxicity.bucket(F.col("doc_id"), 3) != 1, bound=700)
    df = toxicity.score(docs, net).withColumn("held_out", toxicity.bucket(F.col("doc_id"), 3) == 1)
    assert held_out(spark, df, "toxic", sf_dir)[0] > 0.9


def test_network_gradients():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = toxicity.Vocabulary()
    ids = np.stack([toxicity.windowed(words.of(t))[0] for t in ("a bad word " * 9, "short one")])
    y = np.array([1.0, 0.0])
    g, _ = net.gradients(words.rows, ids, y)
    for k, at in (("U0", (1, 2)), ("U1", (3, 20)), ("W0", (2, 5)), ("A", (4, 1)), ("v", (2,)), ("o", (3,)), ("b1", (17,)), ("word", (words.rows[1][0], 2)), ("char", (words.rows[1][1][0], 1))):
        e, out = 1e-5, []
        for s in (e, -e):
            net.p[k][at] += s
            out.append(net.gradients(words.rows, ids, y)[1])
            net.p[k][at] -= s
        assert (out[0] - out[1]) / (2 * e) == pytest.approx(float(g[k][at]), rel=2e-2, abs=2e-5)


def slow_quality(model, text):
    """A text's score by looking up one table entry after the other."""
    x = quality_model.features(text)
    bins = [sum(c <= v for c in cuts) for v, cuts in zip(x, model.cuts, strict=True)]
    margin = model.intercept + sum(t[b] for t, b in zip(model.tables, bins, strict=True)) + sum(t[bins[i], bins[j]] for (i, j), t in model.pairs.items())
    return 1 / (1 + np.exp(-margin))


def slow_toxicity(net, text):
    """A text's score by one window and one step at a time, each word's vectors added up anew."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    words = []
    for w in (text or "").encode().lower().split():
        words += [w] if len(w) <= toxicity.LONG else toxicity.parts(w)

    def vector(w):
        core = w.strip(toxicity._EDGE) or w
        marked = b"<" + core + b">"
        triples = [marked[i : i + 3] for i in range(max(1, len(marked) - 2))]
        return p["word"][1 + zlib.crc32(core) % (toxicity.WORD_ROWS - 1)] + np.mean([p["char"][1 + zlib.crc32(t) % (toxicity.CHAR_ROWS - 1)] for t in triples], 0)

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    none, best, s = p["word"][0] + p["char"][0], -np.inf, toxicity.STATE
    for start in toxicity.windows(len(words)).tolist():
        own = words[start : start + toxicity.WIDTH]
        xs = [vector(w) for w in own] + [none] * (toxicity.WIDTH - len(own))
        states = np.zeros((toxicity.WIDTH, 2 * s))
        for d, order in ((0, range(toxicity.WIDTH)), (1, range(toxicity.WIDTH - 1, -1, -1))):
            h = np.zeros(s)
            for t in order:
                x, q = xs[t] @ p[f"W{d}"] + p[f"b{d}"], h @ p[f"U{d}"]
                z, r = sigmoid(x[:s] + q[:s]), sigmoid(x[s : 2 * s] + q[s : 2 * s])
                c = np.tanh(x[2 * s :] + r * q[2 * s :])
                h = c + z * (h - c)
                states[t, d * s : (d + 1) * s] = h
        a = np.array([np.tanh(x @ p["A"]) @ p["v"] - (30 if t >= len(own) else 0) for t, x in enumerate(states)])
        a = np.exp(a - a.max())
        best = max(best, float((a / a.sum()) @ states @ p["o"] + p["c"][0]))
    return sigmoid(best)


#: Long and odd texts: more windows than are scored at once, one long word, marks only, no ASCII.
HARD = [None, "", " \n", "x", "...", "!!! " * 40, "w" * 5000, "你" * 3000 + "好", " ".join(f"w{i}" for i in range(300)), "one two " * 17000, " ".join("ab" * k for k in range(1, 90))]


@pytest.mark.parametrize("module, slow, most", [(quality_model, slow_quality, 10**9), (toxicity, slow_toxicity, 60)])
def test_batch_scores_against_one_text_at_a_time(spark, sf, module, slow, most):
    """The registered query's scores, and those of odd and long texts, against a plain second implementation."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    mod, held = (5, 0) if module is quality_model else (3, 1)
    model = module.train(docs, labels, usable=module.bucket(F.col("doc_id"), mod) != held)
    name = "op3_quality_model" if module is quality_model else "op4_toxicity"
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in queries.queries()[name](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for d in sorted(texts)[:most]:
        assert got[d].score == pytest.approx(slow(model, texts[d]), abs=2e-5)
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % mod == held) and got[d].predicted == (got[d].score >= module.CUTOFF)
    hard = spark.createDataFrame(list(enumerate(HARD)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in module.score(hard, model).collect()}
    for d, t in enumerate(HARD):
        if t is None or len(t) < 60_000 or module is quality_model:
            assert got[d] == pytest.approx(slow(model, t), abs=2e-5)
    assert 0 <= got[9] <= 1


def test_all_of_a_long_word_counts():
    for n in (65, 66, 127, 128, 5000):
        w = bytes(97 + k % 23 for k in range(n))
        p = toxicity.parts(w)
        assert all(3 <= len(x) <= toxicity.LONG for x in p) and {w[i : i + 3] for i in range(n - 2)} == {x[i : i + 3] for x in p for i in range(len(x) - 2)}
    net, a, b = toxicity.Network(1), toxicity.Vocabulary(), toxicity.Vocabulary()
    x, y = a.of("k" * 70 + "abc"), b.of("k" * 70 + "xyz")
    assert not np.allclose(net.inputs(a.rows)[x], net.inputs(b.rows)[y])


def test_labelled_rows_are_bounded(spark):
    """Repeated ids, labels other than 0 and 1, and long texts: a row a doc_id, of bounded length."""
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c " * 30000), (3, "d"), (4, "e"), (None, "f")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (4, 7), (None, 1)], "doc_id bigint, toxic int")
    got = sorted((r.doc_id, r.text[:1], r.y) for r in toxicity.labelled(docs, labels, "toxic", F.lit(True), 100).collect())
    assert got == [(1, "a", 1), (2, "c", 1), (3, "d", 0)]
    t = toxicity.shortened("c " * 30000, 2)
    assert len(t) <= toxicity.MAX_CHARS + 8 and t == toxicity.shortened("c " * 30000, 2)


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 47, 48, 49, 100):
        w = toxicity.windowed(np.arange(1, n + 1))
        assert set(range(1, n + 1)) <= set(w.ravel().tolist())


def test_classifiers_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (5, 0, 0), (8, 1, None), (10, 1, 0), (11, 0, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for fit, use in ((quality_model.train, quality_model.score), (toxicity.train, toxicity.score)):
        s = [r.score for r in use(odd, fit(odd, labels)).collect()]
        assert len(s) == len(ODD) and all(0 <= x <= 1 for x in s)
        assert use(none, fit(odd, labels)).count() == 0
        s = [r.score for r in use(odd, fit(odd, labels.limit(0))).collect()]
        assert set(s) == {0.5}


def test_interactions_are_learnt():
    r = np.random.default_rng(0)
    x = r.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_model.fit(x, y, rounds=10, pairs=1, pair_rounds=60)
    assert list(m.pairs) == [(0, 1)] and auc(m.score(x), y) > 0.95


# -- URLs ----------------------------------------------------------------------------


def test_url_filters(spark):
    entries = spark.createDataFrame(
        [("bad.org", "", "block", "2024-02-01"), ("bad.org", "", "allow", "2024-03-01"), ("bad.org", "", "block", "2024-02-01"), ("x.bad.org", "/p", "allow", "2024-01-01"), ("org", "", "block", "2024-06-01"), (None, "", "block", "2024-01-01"), ("y.org", "", "block", None)],
        "suffix string, prefix string, action string, since string",
    ).withColumn("since", F.to_date("since"))
    seen = [
        ("http://bad.org/", "2024-01-31", False), ("http://bad.org/", "2024-02-01", True), ("http://bad.org/", "2024-03-01", False), ("https://u:p@X.BAD.org.:80/q", "2024-02-10", True), ("https://x.bad.org/p/1", "2024-02-10", False),
        ("http://notbad.org", "2024-02-10", False), ("http://z.org#f", "2024-06-02", True), (None, "2024-06-02", False), ("nonsense", "2024-06-02", False), ("http://bad.org/", None, False), ("http://bad.org/", "2024-02-01", True),
    ]
    df = spark.createDataFrame([(i, u, d, 1, 2) for i, (u, d, _) in enumerate(seen)], "page_id int, url string, fetched_on string, host int, spans int").withColumn("fetched_on", F.to_date("fetched_on"))
    got = url_filters.url_filter(df, entries)
    assert got.columns == ["page_id", "url", "fetched_on", "spans", "host", "entry", "action", "blocked"]
    assert [r.blocked for r in got.orderBy("page_id").collect()] == [b for *_, b in seen]
    assert url_filters.url_filter(df, entries.limit(0)).filter("blocked").count() == 0
    assert url_filters.url_filter(df.limit(0), entries).count() == 0


def test_url_filters_of_hot_suffixes_and_long_lists(spark):
    """100,000 entries under one host, a suffix over half of all hosts and a host with a third of the captures, against a plain loop."""
    n = 100_000
    paths = spark.range(n).select(F.lit("big.com").alias("suffix"), F.concat(F.lit("/p"), F.col("id").cast("string"), F.lit("/")).alias("prefix"), F.lit("block").alias("action"), F.lit("2024-02-01").alias("since"))
    more = spark.createDataFrame([("com", "", "allow", "2024-01-01"), ("h7.com", "", "block", "2024-03-01"), ("big.com", "/p5/q", "allow", "2024-02-01")], paths.schema)
    entries = paths.unionByName(more).withColumn("since", F.to_date("since"))
    k = F.col("id")
    host = F.when(k % 3 == 0, "www.big.com").when(k % 3 == 1, F.concat(F.lit("h"), k.cast("string"), F.lit(".com"))).otherwise("x.org")
    df = spark.range(3000).select("id", F.concat(F.lit("http://"), host, F.lit("/p"), k.cast("string"), F.lit("/q")).alias("url"), F.to_date(F.lit("2024-02-10")).alias("fetched_on"))
    got = {r.id: (r.entry, r.action) for r in url_filters.url_filter(df, entries).collect()}
    for i in range(3000):
        if i % 3 == 0:
            want = (f"big.com/p{i}/", "block")
        elif i % 3 == 1:
            want = ("com", "allow")
        else:
            want = (None, "allow")
        assert got[i] == want
    lines = url_filters.timelines(entries)
    hosts = df.select(url_filters.host_of(F.col("url")).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    listed = {r.host: {c.suffix: sorted(c.lengths) for c in r.candidates} for r in url_filters.listed_hosts(hosts, lines, Scratch(spark, "t")).collect()}
    assert listed["www.big.com"] == {"com": [0], "big.com": [4, 5, 6, 7, 8]} and "x.org" not in listed  # lengths, not entries


def test_very_long_urls(spark):
    entries = spark.createDataFrame([("a.b", "/x", "block", "2024-01-01")], "suffix string, prefix string, action string, since string").withColumn("since", F.to_date("since"))
    urls = ["http://" + "l." * 50_000 + "a.b/x" + "y" * 100_000, "http://" + "l" * 100_000 + "/x", "http://a.b/" + "x" * 100_000]
    df = spark.createDataFrame([(i, u, "2024-02-01") for i, u in enumerate(urls)], "id int, url string, fetched_on string").withColumn("fetched_on", F.to_date("fetched_on"))
    assert [r.blocked for r in url_filters.url_filter(df, entries).orderBy("id").collect()] == [True, False, True]


# -- WARC ----------------------------------------------------------------------------


def test_warc_round_trip(spark, sf, tmp_path):
    large = [(k, "u", "large") for k in (2**60, 10**18, -(2**63), 2**63 - 1)]
    odd = [*large, (900, "u", "a\r\n\r\nb"), (901, None, None), (902, "u", "WARC/1.0\r\nWARC-Type: resource\r\n\r\nx\r\n\r\nWARC/1.0\r\n\r\n"), (None, "v", "no key")]
    pages = table(spark, sf, "pages").unionByName(spark.createDataFrame(odd, "page_id bigint, url string, html string"))
    fixity.write_warc(fixity.as_records(pages), str(tmp_path / "warc"))
    back = fixity.read_warc(spark, str(tmp_path / "warc"))
    assert back.filter("NOT whole").count() == 0
    assert rows(back.select("key", "url", F.col("body").cast("string").alias("html"))) == rows(pages.select("page_id", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))))


def test_warc_versions_members_and_damage(spark, tmp_path):
    """WARC 1.1, response records, gzip members, a record cut short and one with a wrong length."""
    import gzip

    def record(kind, uri, block, size=None, version="1.1"):
        head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uri}>\r\nWARC-Target-URI: http://{uri}\r\nContent-Length: {len(block) if size is None else size}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    a, b, c = record("warcinfo", "a", b"software: x\r\n"), record("response", "b", b"HTTP/1.1 200 OK\r\n\r\n\xff\x00bytes"), record("resource", "c", b"", version="1.0")
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (a, b, c)))
    (tmp_path / "two.warc").write_bytes(record("resource", "d", b"declared too long", 999) + record("resource", "e", b"good") + record("resource", "f", b"cut")[:-9])
    got = {r.record_id[9:]: (r.type, r.url, bytes(r.body), r.whole) for r in fixity.read_warc(spark, str(tmp_path)).collect()}
    assert got == {
        "a": ("warcinfo", "http://a", b"software: x\r\n", True), "b": ("response", "http://b", b"HTTP/1.1 200 OK\r\n\r\n\xff\x00bytes", True), "c": ("resource", "http://c", b"", True),
        "d": ("resource", "http://d", b"declared too long", False), "e": ("resource", "http://e", b"good", True), "f": ("resource", "http://f", got["f"][2], False),
    }


def test_warc_damaged_members(spark, tmp_path):
    """A flipped byte, a cut member, bytes between members and files that only look gzipped are rows; reading goes on behind them."""
    import gzip

    def record(k, block):
        return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{k}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    blocks = {k: hashlib.sha512(bytes([k])).digest() * 900 + bytes(range(256)) * k for k in range(1, 8)}
    members = {k: gzip.compress(record(k, b), mtime=0) for k, b in blocks.items()}
    flipped = bytearray(members[2])
    flipped[len(flipped) // 2] ^= 0xFF
    head = bytearray(members[4])
    head[12] ^= 0xFF  # right behind the member's head
    crc = bytearray(members[5])
    crc[-6] ^= 1
    (tmp_path / "a.warc.gz").write_bytes(members[1] + bytes(flipped) + members[3] + bytes(head) + bytes(crc) + b"\0" * 9 + members[6] + b"between" + members[7][:-20])
    (tmp_path / "b.warc.gz").write_bytes(b"\x1f\x8b and no more")
    (tmp_path / "c.warc.gz").write_bytes(b"\x1f\x8b\x08\x00" + b"\xff" * 50 + members[1])
    (tmp_path / "d.warc.gz").write_bytes(b"")
    (tmp_path / "e.warc.gz").write_bytes(gzip.compress(record(1, blocks[1])[:1000]) + gzip.compress(record(1, blocks[1])[1000:] + record(2, blocks[2])))
    got = defaultdict(list)
    for r in spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content").collect():
        for fields, block, whole in fixity.warc_records(bytes(r.content)):
            got[r.path[-9:-8]].append((fields.get("warc-record-id", "")[10:-1], block, whole))
    a = got["a"]
    assert [(k, w) for k, _, w in a if w] == [("1", True), ("3", True), ("6", True)]
    assert all(b == blocks[int(k)] for k, b, w in a if w)
    assert {k for k, _, w in a if not w} >= {"2", "5", "7", ""}
    for k in ("2", "5", "7"):  # what could be undone is there
        assert all(blocks[int(k)].startswith(b[: len(b) // 2]) and b for x, b, w in a if x == k)
    assert got["b"] == [("", b"\x1f\x8b and no more", False)]
    assert [(k, w) for k, _, w in got["c"]] == [("", False), ("1", True)] and "d" not in got
    assert [(k, b == blocks[int(k)], w) for k, b, w in got["e"]] == [("1", True, True), ("2", True, True)]
    df = fixity.read_warc(spark, str(tmp_path))
    assert df.filter("whole").groupBy("key").count().orderBy("key").collect() == [(1, 3), (2, 1), (3, 1), (6, 1)]
    assert df.filter("NOT whole").count() == sum(not w for x in got.values() for *_, w in x)


@given(st.binary(max_size=200), st.integers(0, 400), st.integers(0, 255))
@settings(max_examples=200, deadline=None)
def test_warc_never_crashes(junk, at, byte):
    import gzip

    good = gzip.compress(b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", mtime=0)
    content = bytearray(good + junk + good)
    content[at % len(content)] = byte
    list(fixity.warc_records(bytes(content)))
    list(fixity.warc_records(b"\x1f\x8b" + junk))


def test_fixity_of_hot_damaged_key(spark):
    """A damaged key with most of the records is not gathered: its rows meet the slot in a broadcast."""
    left = spark.range(6000).select(F.when(F.col("id") % 4 > 0, 11).otherwise(F.col("id")).cast("bigint").alias("key"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("record"))
    right = left.withColumn("record", F.when(F.col("record").isin("r9", "r12", "r5001"), "changed").otherwise(F.col("record"))).filter("record <> 'r4003'")
    got = fixity.audit(left, right)
    pairs = [[(r.key, r.record) for r in x.collect()] for x in (left, right)]
    assert sorted((str(r.key), r.sha256, r.verdict, r.copies) for r in got.collect()) == slow_audit(*pairs)
    slots = spark.createDataFrame([(True, 11, 4500), (True, 12, 1)], "keyed boolean, place bigint, records bigint")
    rows_ = spark.range(6000).select(F.lit(True).alias("keyed"), F.when(F.col("id") % 4 > 0, 11).otherwise(F.col("id")).alias("place"))
    seen = fixity._flagged(rows_, slots, 12000)
    assert seen.groupBy("flag").count().orderBy("flag").collect() == [(False, 1499), (True, 4501)]
    assert "BroadcastHashJoin" in seen._jdf.queryExecution().executedPlan().toString()


def slow_audit(a, b):
    """Verdicts with copies of each (key, record), by counting."""
    from collections import Counter

    a, b = (Counter((k, r or "") for k, r in x) for x in (a, b))
    out = Counter()
    for mine, other, matched, alone in ((a, b, "corrupt", "missing"), (b, a, "altered", "extra")):
        over = {k for (k, r), n in other.items() if n > mine[k, r]} - {None}
        for (k, r), n in mine.items():
            if mine is a and min(n, other[k, r]):
                out[k, r, "ok"] += min(n, other[k, r])
            if n > other[k, r]:
                out[k, r, matched if k in over else alone] += n - other[k, r]
    return sorted(((str(k), hashlib.sha256(r.encode()).hexdigest(), v, n) for (k, r, v), n in out.items()))


def test_fixity_odd(spark):
    def rec(items):
        return spark.createDataFrame([(*x, 1) for x in items], "key bigint, record string, side int")

    a = [(0, "a"), (1, "b"), (5000, "c"), (5000, "c"), (None, "d"), (99999, None), (7, ""), (-20000, "n"), (-1, "m"), (2**60 + 4095, "l"), (-(2**63), "least"), (2**63 - 1, "most"), (8, "x" * 300_000)]
    same = fixity.audit(rec(a), rec(a[::-1])).collect()
    assert {r.verdict for r in same} == {"ok"} and sum(r.copies for r in same) == len(a)
    volumes = {r.key: r.volume for r in same}
    assert (volumes[-20000], volumes[-1], volumes[2**60 + 4095], volumes[-(2**63)], volumes[None]) == (-5, -1, 2**48, -(2**51), None)
    assert [(r.key, r.offset) for r in sorted((r for r in same if r.volume == 0), key=lambda r: r.key)] == [(0, 0), (1, 5), (7, 10), (8, 14)]
    b = [(0, "a"), (0, "second"), (1, "B"), (5000, "c"), (None, "d"), (None, "d"), (None, "e"), (99999, None), (123456789, "new"), (-20000, "n2"), (-1, "m"), (2**60 + 4095, "l"), (8, "x" * 300_000)]
    for left, right in ((a, b), (b, a), (a, []), ([], a), ([], [])):
        got = [(str(r.key), r.sha256, r.verdict, r.copies) for r in fixity.audit(rec(left), rec(right)).collect()]
        assert sorted(got) == slow_audit(left, right)


def test_fixity_of_a_key_with_very_many_records(spark):
    """Two thirds of the records under one key or none; the trees find the one that differs."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 11).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id")).cast("bigint").alias("key"), F.concat(F.lit("r"), (F.col("id") % 700).cast("string")).alias("record"))
    bad = df.withColumn("record", F.when((F.col("key") == 11) & (F.col("record") == "r33"), "gone").otherwise(F.col("record")))
    at = Scratch(spark, "t")
    sides = [at.write(fixity.manifest(x), n) for x, n in ((df, "a"), (bad, "b"))]
    levels = fixity.trees(sides[0].withColumn("side", F.lit(0)).unionByName(sides[1].withColumn("side", F.lit(1))), at)
    assert [tuple(r) for r in fixity.damaged_slots(levels).collect()] == [(True, 11)]
    places = [(r.offset, r.offset + r.length * r.copies) for r in sides[0].filter("volume = 0").orderBy("offset").collect()]
    assert places[0][0] == 0 and all(x[1] == y[0] for x, y in zip(places, places[1:], strict=False))
    pairs = [[(r.key, r.record) for r in x.collect()] for x in (df, bad)]
    assert sorted((str(r.key), r.sha256, r.verdict, r.copies) for r in fixity.audit(df, bad).collect()) == slow_audit(*pairs)


# -- pipeline and helpers ------------------------------------------------------------


def test_pipeline_against_brute_force(spark, sf, tokenizer):
    docs = table(spark, sf, "documents")
    at = Scratch(spark, "t")
    kept, name = docs, iter(range(9))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = at.write(stage(spark, kept, sf), f"s{next(name)}")
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            good = {r[0] for r in quality_rules.quality_rules(docs).filter("kept").select("__row.doc_id").collect()}
            assert {r.doc_id for r in out.collect()} == good
        if k == 1:
            best = {}
            for r in kept.collect():
                best[r.text] = max(best.get(r.text, -1), r.doc_id)
            assert sorted(r.doc_id for r in out.collect()) == sorted(best.values())
        if k == 2:
            want = brute_components({r.doc_id: brute_fingerprint(r.text) for r in kept.collect()})
            assert sorted(r.doc_id for r in out.collect()) == sorted(set(want.values()))
        if k == 3:
            n = sum(len(WORD.findall(r.text)) for r in kept.collect())
            assert abs(sum(len(WORD.findall(r.text)) for r in out.collect()) - n) / n < 0.2
        if k == 4:
            check_packing(out.collect(), [(r.doc_id, r.text) for r in kept.collect()], tokenizer)
        kept = out


def test_pipeline_leaves_only_its_result(spark, sf):
    import os

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    out = corpus_pipeline.run(spark, sf)
    left = set(os.listdir(root)) - before
    assert len(left) == 1 and os.listdir(f"{root}/{left.pop()}") == ["4-packing"] and out.count() > 0


def test_scratch_of_passing_blocks_goes(spark):
    import os

    with passing():
        at = Scratch(spark, "t")
        at.write(spark.range(3), "x")
        assert os.path.exists(at.root.removeprefix("file://"))
    assert not os.path.exists(at.root.removeprefix("file://"))


def test_dealing_small_tables_changes_no_row(spark, sf):
    df = spread_table(spark, sf, "documents", "doc_id")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert rows(df) == rows(table(spark, sf, "documents"))


def test_join_groups_splits_heavy_keys(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    at = Scratch(spark, "t")
    left = at.write(left, "l")
    groups = at.write(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "g")
    got = join_groups(left, groups, "k", "n", 5000)
    assert got.count() == 5000 and got.filter("k = 'hot' AND n = 1667").count() == 1667
