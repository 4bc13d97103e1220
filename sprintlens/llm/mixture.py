"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share by weight of all words, capped at MAX_REPEATS times the
source's size; what a cap cuts off is shared anew by weight. A target of q complete
epochs and a rest takes every document q times; the rest goes to a weighted sample without
replacement: documents in the order of -ln(u) / weight, u a hash of the doc_id, taken
while the running sum of their sizes is nearer to the rest with them than without.

The running sum inside a source is two-level: a monotone map of the key to (0, 1) deals a
source's rows over BANDS bands, band totals are summed first, then rows within a band, so
a source with a third of all rows is never sorted in one task. The number of bands follows
the number of rows. Targets come from two-level running sums over the sources, of which
there may be as many as domains.

Null and empty texts have size 0 and are taken as often as the whole epochs say, with no
words. Ties in the key go by doc_id, size and text; rows that tie in all of them are alike,
so reruns agree. A row without doc_id is drawn by its text. Rows repeating a doc_id are
taken each by its own place. Only ``doc_id``, ``text`` and ``source`` are read; ``mixed``
carries all columns, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, numbered, running_sums, spread_table, words

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Bands a source: at least so many, and so many rows a band on average.
BANDS, BAND_ROWS = 1024, 50_000
SEED = "mix-1"


def quality_weight(text: Column) -> Column:
    """Between 1/2 and 1: half of it the share of letters in the text."""
    text = F.coalesce(text, F.lit(""))
    other = F.length(F.translate(text, " \t\n0123456789.,;:!?'\"()[]{}<>|/\\#*$%&@_+=-", ""))
    return F.lit(0.5) + F.lit(0.5) * other / F.greatest(F.length(text), F.lit(1))


def sample_key(identity: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight; u in (0, 1) from an md5 of seed and identity."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), identity)), 1, 12), 16, 10).cast("bigint")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(16**12))) / weight


def targets(sizes: DataFrame, at: Scratch, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """source_size and target of each source, from one row of (source, source_size) each.

    The shares level out where the weights of uncapped sources, times one level, use what
    capped ones leave: the first source in the order of cap / weight that stays below its
    cap gives the level."""
    name = F.col("source").asc_nulls_last()
    df = running_sums(sizes.withColumn("one", F.lit(1)), at, "by-name", [name], ["one"])
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("one_before") % len(weights) + 1).cast("int")).cast("bigint")
    df = df.select("source", "source_size", weight.alias("weight"), (repeats * F.col("source_size")).alias("cap"))
    df = df.withColumn("ratio", F.col("cap") / F.col("weight"))
    df = running_sums(df, at, "by-ratio", [F.col("ratio"), name], ["cap", "weight"])
    total, all_weights = df.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(total) - F.col("cap_before")) / (F.lit(all_weights) - F.col("weight_before"))
    level = df.select("ratio", "weight", "cap", level.alias("level")).filter("level * weight <= cap").agg(F.min(F.struct("ratio", "level"))["level"]).first()[0]
    cap = F.col("cap").cast("double")
    return df.select("source", "source_size", (cap if level is None else F.least(cap, F.lit(level) * F.col("weight"))).alias("target"))


def mixture(docs: DataFrame, seed: str = SEED, bands: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, epochs (whole takes), picked and taken words of each row, and the columns to carry."""
    spark = docs.sparkSession
    at = Scratch(spark, "mix")
    size = F.size(words(F.col("text"))).cast("bigint")
    tie = F.md5(F.coalesce("text", F.lit("")))
    key = sample_key(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), tie)), quality_weight(F.col("text")), seed)
    rows = at.write(docs.select("doc_id", "source", size.alias("size"), key.alias("key"), tie.alias("tie"), F.struct(F.lit(0).alias("none"), *carry).alias("carried")), "rows")
    bands = bands or max(BANDS, rows.count() // BAND_ROWS)
    # 1 - exp(-3/4 key) rises with the key and spreads the rows of any weight over the bands
    band = F.least(F.lit(bands - 1), F.floor((F.lit(1.0) - F.exp(F.lit(-0.75) * F.col("key"))) * bands)).cast("int")
    rows = rows.withColumn("band", band)

    bandsums = at.write(rows.groupBy("source", "band").agg(F.sum("size").alias("n")), "bands")
    per_source = at.write(targets(bandsums.groupBy("source").agg(F.sum("n").alias("source_size")), at), "targets")
    order = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    ahead = bandsums.withColumn("ahead", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    ahead = at.write(
        ahead.join(per_source, ahead["source"].eqNullSafe(per_source["source"])).select(ahead["source"].alias("s"), ahead["band"].alias("b"), "ahead", "source_size", "target"), "ahead"
    )

    within = Window.partitionBy("source", "band").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(ahead, rows["source"].eqNullSafe(ahead["s"]) & (rows["band"] == ahead["b"]))
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("bigint")
    rows = rows.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # with the document the sum is nearer to the rest than without it
    picked = (F.col("ahead") + F.col("inside")) + F.col("size") / 2 < F.col("rest")
    rows = rows.withColumn("picked", picked & (F.col("size") > 0))
    taken = F.col("size") * (F.col("epochs") + F.col("picked").cast("bigint"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", "picked", taken.alias("taken"), *[F.col("carried")[c].alias(c) for c in carry])


def mixed(docs: DataFrame) -> DataFrame:
    """The input's rows, all columns as they were, each as often as the mix takes it."""
    rows = numbered(docs, Scratch(docs.sparkSession, "mix-rows"))
    if rows is None:
        rows = docs.select("doc_id", F.struct("*").alias("body"))
        takes = mixture(docs.select("doc_id", "text", "source"))
        on = "doc_id"
    else:
        takes = mixture(rows.select("body.doc_id", "body.text", "body.source", "row"), carry=("row",))
        on = "row"
    times = takes.filter("taken > 0").select(on, (F.col("epochs") + F.col("picked").cast("bigint")).cast("int").alias("times"))
    return rows.join(times, on).select("body", F.explode(F.sequence(F.lit(1), F.col("times")))).select("body.*")


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spread_table(spark, sf_dir, "documents", "doc_id")).select("doc_id", "size", "source_size", "target", "taken")


def sql(docs: str = "documents") -> str:
    """The same mix by plain window sums, for DuckDB; also the columns that the pipeline needs."""
    drop = " \\t\\n0123456789.,;:!?'\"()[]{}<>|/\\\\#*$%&@_+=-"
    chars = drop.replace("\\t", "\t").replace("\\n", "\n").replace("\\\\", "\\").replace("'", "''")
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM {docs}),
k AS (
  SELECT doc_id, source, size, md5(t) AS tie,
    -ln((('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '#' || md5(t))), 1, 12))::BIGINT + 0.5::DOUBLE) / {16**12}::DOUBLE)
      / (0.5::DOUBLE + 0.5::DOUBLE * length(translate(t, '{chars}', ''))::DOUBLE / greatest(length(t), 1)::DOUBLE) AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, {MAX_REPEATS} * source_size AS cap FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS level
  FROM w),
v AS (SELECT min(struct_pack(r := cap::DOUBLE / weight, v := level)).v AS v FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN v IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, v * weight) END AS target FROM l, v),
r AS (
  SELECT k.doc_id, k.source, size, source_size, target,
    CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS epochs,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS LAST, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN size > 0 AND ahead + size / 2 < target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r"""
