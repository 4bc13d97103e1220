"""Queries over text and graph features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features as X
from ..sources import tables as T
from ..sources.storage import shared_dir
from . import ml as ML

TOKEN_SQL = S.TOKEN_ASCII


def q13(spark, sf):
    t = S.tokens(F.col("text"))
    return T.spread_table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("token_md5"))


Q13 = f"""
SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS token_md5
FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}') AS t FROM documents)"""


def q14(spark, sf):
    return X.vocabulary(T.spread_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


Q14 = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}')) AS term FROM documents),
v AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY term HAVING count(DISTINCT doc_id) >= 2 ORDER BY tf DESC, term LIMIT 512)
SELECT term, tf, df, row_number() OVER (ORDER BY term) - 1 AS col FROM v"""


def q15(spark, sf):
    docs = T.spread_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return X.token_counts(docs, X.frequent_terms(docs)).select(F.col("id").alias("doc_id"), "col", "n")


Q15 = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}')) AS term FROM documents),
v AS (SELECT term, count(*) AS tf FROM t GROUP BY term HAVING count(DISTINCT doc_id) >= 2 ORDER BY tf DESC, term LIMIT 512),
c AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS col FROM v)
SELECT doc_id, col, count(*) AS n FROM t JOIN c USING (term) GROUP BY doc_id, col"""


def q23(spark, sf):
    """Edges supplier -> part of an order: before from odd lines, after from even lines."""
    li = T.table(spark, sf, "lineitem").select("l_orderkey", F.struct(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).alias("e"), (F.col("l_linenumber") % 2).alias("odd"))
    g = li.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("odd") == 1, F.col("e"))).alias("before"), F.collect_set(F.when(F.col("odd") == 0, F.col("e"))).alias("after"))
    return g.select("l_orderkey", *X.graph_delta(F.col("before"), F.col("after")))


Q23 = """
WITH e AS (SELECT DISTINCT l_orderkey, l_suppkey AS s, l_partkey AS d, l_linenumber % 2 AS odd FROM lineitem),
n AS (SELECT DISTINCT l_orderkey, v, odd FROM (SELECT l_orderkey, s AS v, odd FROM e UNION ALL SELECT l_orderkey, d, odd FROM e)),
ee AS (SELECT l_orderkey, count(*) FILTER (b) AS eb, count(*) FILTER (a) AS ea, count(*) FILTER (a AND NOT b) AS ep, count(*) FILTER (b AND NOT a) AS em
  FROM (SELECT l_orderkey, s, d, bool_or(odd = 1) AS b, bool_or(odd = 0) AS a FROM e GROUP BY ALL) GROUP BY l_orderkey),
nn AS (SELECT l_orderkey, count(*) FILTER (b) AS nb, count(*) FILTER (a) AS na, count(*) FILTER (a AND NOT b) AS np, count(*) FILTER (b AND NOT a) AS nm
  FROM (SELECT l_orderkey, v, bool_or(odd = 1) AS b, bool_or(odd = 0) AS a FROM n GROUP BY ALL) GROUP BY l_orderkey)
SELECT l_orderkey, nb AS nodes_before, eb AS edges_before, na AS nodes_after, ea AS edges_after, ep AS edges_added, em AS edges_removed, np AS nodes_added, nm AS nodes_removed FROM ee JOIN nn USING (l_orderkey)"""


def q24(spark, sf):
    g = T.paths(spark, sf).groupBy("change").agg(
        F.collect_set(F.when(F.col("kind") < "M", F.col("path"))).alias("b"), F.collect_set(F.when(F.col("kind") >= "L", F.col("path"))).alias("a")
    )
    u = F.array_sort(F.array_union("b", "a"))
    return g.select("change", F.size(u).cast("bigint").alias("n_paths"), F.md5(F.array_join(F.array_sort(F.array_distinct(F.transform(u, S.module_name))), ",")).alias("modules_md5"))


_P = "p_brand || '/' || replace(p_name, ' ', '_') || (['.py', '.java', '.js', '.ts', '.md'])[p_size % 5 + 1]"
Q24 = f"""
WITH p AS (SELECT DISTINCT p_partkey // {T.FILES} AS change, {_P} AS path FROM part)
SELECT change, count(*) AS n_paths, md5(array_to_string(list_sort(list(DISTINCT translate(regexp_replace(path, '\\.[^./]*$', ''), '/', '.'))), ',')) AS modules_md5 FROM p GROUP BY change"""

#: What parts a text into statements.
_STOP = "[.\\n]+"


def _modules(spark, sf):
    """Two versions of a module for each document, a statement a sentence of the whole text, as a change of a Python or a Java file."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), _STOP), lambda x: x.rlike("[A-Za-z]"))
    own = F.transform(parts, lambda x: F.concat(F.lit("v_"), F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_")))
    names = F.col("names")  # a step of its own: worked out once for both versions
    before = F.concat(F.lit("import os\ndef f(x):\n"), F.array_join(F.transform(names, lambda w: F.concat(F.lit("    "), w, F.lit(" = g(x)\n"))), ""), F.lit("    return x\n"))
    after = F.concat(F.lit("import os\nfrom a.b import c\ndef f(x):\n"), F.array_join(F.transform(names, lambda w: F.concat(F.lit("    if x:\n        "), w, F.lit(" = h(x)\n"))), ""), F.lit("    return x\n"))
    return T.spread_table(spark, sf, "documents").select("doc_id", own.alias("names")).select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, "java").otherwise("python").alias("language"), F.create_map(F.lit("m.py"), before).alias("before_blobs"), F.create_map(F.lit("m.py"), after).alias("after_blobs")
    )


def q45(spark, sf):
    """Node counts and graph deltas of the documents' modules."""
    f = X.code_features(_modules(spark, sf), edits=False)
    counts = F.array_join(F.transform(F.slice("tree", 1, 3 * len(X.NODE_TYPES)), lambda x: x.cast("int").cast("string")), ",")
    return f.select(F.col("id").alias("doc_id"), counts.alias("node_counts"), F.array_join(F.transform("graph", lambda x: x.cast("int").cast("string")), ",").alias("graph_delta"))


def q65(spark, sf):
    """The modules' import and call edges as a table, and what each change does to its graphs, from that table."""
    deltas = X.graph_deltas(X.change_edges(_modules(spark, sf)))
    return deltas.select(F.col("id").alias("doc_id"), "kind", *[c for c in deltas.columns if c not in ("id", "kind")])


Q65 = """
WITH d AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.\n]+'), lambda x: regexp_matches(x, '[A-Za-z]'))) AS n FROM documents WHERE doc_id % 7 <> 0)
SELECT doc_id, 'imports' AS kind, 2::BIGINT AS nodes_before, 1::BIGINT AS edges_before, 3::BIGINT AS nodes_after, 2::BIGINT AS edges_after, 1::BIGINT AS edges_added, 0::BIGINT AS edges_removed, 1::BIGINT AS nodes_added, 0::BIGINT AS nodes_removed FROM d
UNION ALL SELECT doc_id, 'calls', 2, 1, 2, 1, 1, 1, 1, 1 FROM d WHERE n > 0"""


def q66(spark, sf):
    """Edit totals between the syntax trees of an import list, a line a sentence of a document, and the list with up to three more lines."""
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), _STOP), lambda x: x.rlike("[A-Za-z]")))
    lines = lambda k: F.create_map(F.lit("m.py"), F.repeat(F.lit("import os\n"), k))
    more = F.pmod("doc_id", F.lit(4)).cast("int")
    rows = T.spread_table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, "java").otherwise("python").alias("language"), lines(n).alias("before_blobs"), lines(n + more).alias("after_blobs")
    )
    tree, first = F.col("tree"), 3 * len(X.NODE_TYPES)
    return X.code_features(rows).select(F.col("id").alias("doc_id"), *[F.get(tree, F.lit(first + k)).cast("bigint").alias(f"n_{e}") for k, e in enumerate(X.EDITS)])


# A list of k imports is walked as a module, k imports, k names. The matcher keeps 1 + 2k nodes and
# inserts the rest, but from 200 nodes on it no longer starts matches at frequent ones: then it keeps
# what follows the module, 1 + k nodes, and replaces all names.
Q66 = """
WITH d AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.\n]+'), lambda x: regexp_matches(x, '[A-Za-z]'))) AS k, doc_id % 4 AS j FROM documents),
w AS (SELECT *, j > 0 AND k > 0 AND 1 + 2 * (k + j) >= 200 AS many, doc_id % 7 = 0 AS other FROM d)
SELECT doc_id, (CASE WHEN other OR many THEN 0 ELSE 2 * j END)::BIGINT AS n_insert, 0::BIGINT AS n_delete, (CASE WHEN many AND NOT other THEN 2 * k + 2 * j ELSE 0 END)::BIGINT AS n_replace,
  (CASE WHEN other THEN 0 WHEN many THEN 2 * (1 + k) ELSE 2 * (1 + 2 * k) END)::BIGINT AS n_equal FROM w"""


def _q45_sql() -> str:
    n = "n"
    before = {"FunctionDef": "1", "Call": n, "Assign": n, "Return": "1", "Import": "1"}
    after = {**before, "If": n, "ImportFrom": "1"}
    change = {"If": n, "ImportFrom": "1"}
    counts = " || ',' || ".join(f"{side.get(t, '0')}" for side in (before, after, change) for t in X.NODE_TYPES)
    calls = "CASE WHEN n > 0 THEN '2,1,2,1,1,1,1,1' ELSE '0,0,0,0,0,0,0,0' END"
    return f"""
WITH d AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.\n]+'), lambda x: regexp_matches(x, '[A-Za-z]'))) AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '{",".join(["0"] * 3 * len(X.NODE_TYPES))}' ELSE {counts} END AS node_counts,
  CASE WHEN doc_id % 7 = 0 THEN '{",".join(["0"] * 16)}' ELSE '2,1,3,2,1,0,1,0,' || {calls} END AS graph_delta FROM d"""


def q64(spark, sf):
    """Effort of documents from their tokens by a pipeline that is fitted, saved, loaded and applied; the label is a text's share of long words."""
    docs = T.spread_table(spark, sf, "documents").select("doc_id", "text")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+"), lambda w: w != "")
    long = F.size(F.filter(words, lambda w: F.length(w) >= 8)) / F.greatest(F.size(words), F.lit(1))
    stages = [ML.TokenVectorizer(idCol="doc_id", inputCol="text", outputCol="features", vocabSize=64), ML.EffortPredictor(idCol="doc_id", epochs=2, steps=2)]
    path = shared_dir(spark, "effort-model")
    Pipeline(stages=stages).fit(docs.withColumn("y", long)).write().save(path)
    return PipelineModel.load(path).transform(docs).select("doc_id", "mean", "p50", "p90", "payload")


QUERIES = {
    "q13_tokenise": (q13, Q13), "q14_vocabulary": (q14, Q14), "q15_token_vectors": (q15, Q15), "q23_graph_delta": (q23, Q23), "q24_path_union": (q24, Q24), "q45_ast_features": (q45, _q45_sql()), "q64_ml_pipeline": (q64, None), "q65_edge_table": (q65, Q65), "q66_edit_totals": (q66, Q66),
}
