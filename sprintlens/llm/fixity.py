"""WARC fixity audit by Merkle trees.

A replica's manifest has a row for each distinct record: its key, its volume (``VOLUME``
keys in a row), its offset there, its length, its SHA-256 and how many copies it has. Over
the manifest stands a tree. Its leaves are slots, one a key; a node covers an ordered range
of slots and hashes, in order, its up to ``FANOUT`` children's places, byte lengths and
digests, so the offset ranges below it are under the hash as well: an offset is the sum of
the lengths before it. As places are relative to a node, a missing or longer record changes
its own branch and shifts no other one. Level 2 holds the volumes' roots, and levels go on
up to one root. Two replicas are compared from the root down: of each level only the
children of nodes that differ are looked at, until the damaged slots are found, and within
those the records.

Edge cases. A slot can hold any number of records: its digest is the hash of sums over its
records' digests, which combine before the shuffle, so a key that a third of all records
have is not gathered. Records without a key have a tree of their own, placed by digest;
they lie in no volume, so their volume and offset are null. Any 64-bit key has a place,
negative ones included. Null bodies are empty. Equal records are one row with its copies.
An empty replica has no nodes: against it all records are missing or extra. Of the input
only ``key`` and ``record`` are read, whatever else there is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HEAVY_SHARE, TASK_ROWS, Scratch, table

FANOUT, FANOUT_BITS = 64, 6
VOLUME, VOLUME_BITS = 4096, 12
#: Records of one key are summed by this many hexadecimal digits of their digest before they are put in order.
BAND_DIGITS = 3
VERSION = "WARC/1.0\r\n"


def as_records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """key and the WARC resource record of each page, without the blank lines that end it."""
    text = F.coalesce(F.col(body), F.lit(""))
    head = F.concat(
        F.lit(VERSION + "WARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col(key).cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(F.col(url), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(text).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return pages.select(F.col(key).cast("bigint").alias("key"), F.concat(head, text).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """Writes records as WARC text, volumes whole and in order; a record ends with two line breaks."""
    rows = records.select(volume(F.col("key")).alias("v"), F.col("key").alias("k"), F.coalesce("record", F.lit("")).alias("r"))
    rows.repartitionByRange("v").sortWithinPartitions("v", "k").select("r").write.option("lineSep", "\r\n\r\n").text(path)


_HEAD = re.compile(rb"WARC/1\.[01]\r?\n(?:[^\r\n]+\r?\n)*(\r?\n)?")
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.M)


_MAGIC = b"\x1f\x8b\x08"


def _undone(content: bytes, at: int, most: int = -1) -> tuple[bytes, int, bool]:
    """What the gzip member at a place holds (up to ``most`` bytes of it are enough), where it ends, and whether it is whole.

    A damaged member comes as far as it can be undone: where a piece fails, byte by byte."""
    member, out, size, step = zlib.decompressobj(wbits=31), [], 0, 1 << 14
    while at < len(content) and not member.eof and not 0 <= most <= size:
        piece = content[at : at + step]
        before = member.copy() if step > 1 else None
        try:
            plain = member.decompress(piece)
        except zlib.error:
            if before is None:
                return b"".join(out), at, False
            member, step = before, 1
            continue
        out.append(plain)
        size += len(plain)
        at += len(piece) - len(member.unused_data)
    return b"".join(out), at, member.eof


def members(content: bytes) -> Iterator[tuple[bytes, bool]]:
    """The plain bytes of a WARC file's gzip members, one after another, and whether each is whole; a plain file is one part.

    Of a damaged member comes what can be undone, or its own bytes if nothing can. After it
    reading goes on at the next member that begins with a record, and so it does after bytes
    between members; zero bytes there are padding."""
    if content[:2] != _MAGIC[:2]:
        yield content, True
        return
    at = 0
    while at < len(content):
        plain, end, whole = _undone(content, at) if content.startswith(_MAGIC, at) else (b"", at, False)
        if not whole:
            end = content.find(_MAGIC, at + 1)
            while end >= 0 and not _undone(content, end, 16)[0].startswith(b"WARC/1."):
                end = content.find(_MAGIC, end + 1)
            end = end if end >= 0 else len(content)
            plain = plain or content[at:end]
        if whole or plain.strip(b"\0"):
            yield plain, whole
        at = end


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """Header fields, block and whether it is whole, of each record of a file, member by member.

    A record may span members. The last record of a damaged member isn't whole; a damaged
    member without any is a record without fields."""
    held: list[bytes] = []

    def records(damaged: bool) -> Iterator[tuple[dict[str, str], bytes, bool]]:
        last = None
        for record in split_warc(b"".join(held)):
            if last is not None:
                yield last
            last = record
        if last is None and damaged:
            last = {}, held[-1], False
        if last is not None:
            yield (*last[:2], last[2] and not damaged)
        held.clear()

    for plain, whole in members(content):
        if held and plain.startswith(b"WARC/1."):
            yield from records(False)
        if not whole and held and not plain.startswith(b"WARC/1."):
            yield from records(False)
        held.append(plain)
        if not whole:
            yield from records(True)
    if held:
        yield from records(False)


def split_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """Header fields (lower-cased names), block and whether it is as long as declared, of each record.

    The declared length tells where a record ends, so a block may hold anything. Only where
    a record is cut short or its length is wrong is the next version line searched for."""
    head = _HEAD.search(content)
    while head:
        fields = {k.decode().lower(): v.decode(errors="replace") for k, v in _FIELD.findall(head.group())}
        at, size = head.end(), fields.get("content-length", "")
        end = at + int(size) if head[1] and size.isdigit() else -1
        follows = content[end : end + 12] if 0 <= end <= len(content) else b"?"
        if follows in (b"\r\n\r\nWARC/1.0", b"\r\n\r\nWARC/1.1") or not follows.strip(b"\r\n"):
            yield fields, content[at:end], True
            head = _HEAD.search(content, end)
        else:
            head = _HEAD.search(content, at)
            yield fields, content[at : head.start() if head else len(content)].removesuffix(b"\r\n\r\n"), False


def _page(name: str) -> int | None:
    """The 64-bit number of a page's record id."""
    page = re.fullmatch(r"urn:page:(-?[0-9]{1,30})", name)
    return int(page[1]) if page and -(1 << 63) <= int(page[1]) < 1 << 63 else None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "record_id", "type", "url", "body", "whole"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.bool_()]
    for b in batches:
        for content in b.column(0).to_pylist():
            rows, held = [], 0
            for fields, block, whole in warc_records(content):
                name = fields.get("warc-record-id", "").strip("<>")
                rows.append((_page(name), name, fields.get("warc-type", ""), fields.get("warc-target-uri", ""), block, whole))
                held += len(block)
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """key (null unless the id is urn:page:<number>), record_id, type, url, body and whole of each record.

    Reads WARC 1.0 and 1.1, plain or gzipped, with records of any type. Damage makes rows
    whose ``whole`` is false, never an error. A file is one task's work, which holds its bytes
    and one member undone (of a plain file, or one gzipped in one piece, the whole text), so
    files should have the usual size of up to about a gigabyte and a member a record."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_records, "key bigint, record_id string, type string, url string, body binary, whole boolean")


def volume(key: Column) -> Column:
    return F.shiftright(key, VOLUME_BITS)


def manifest(records: DataFrame) -> DataFrame:
    """key, place, volume, offset, length, sha256 and copies of each distinct record.

    Offsets are two-level running sums: over the keys and digest bands of a volume, of which
    there are at most VOLUME times 16**BAND_DIGITS, then inside a band."""
    record = F.coalesce("record", F.lit(""))
    df = records.select("key", F.octet_length(record).cast("bigint").alias("bytes"), F.sha2(record, 256).alias("sha256"))
    df = df.groupBy("key", "sha256").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies"))
    # a record takes four more bytes for the line breaks that end it
    df = df.select("key", "sha256", (F.col("bytes") + 4).alias("length"), "copies", volume(F.col("key")).alias("volume"), F.substr("sha256", F.lit(1), F.lit(BAND_DIGITS)).alias("band"))
    size = F.sum(F.col("length") * F.col("copies"))
    before = Window.unboundedPreceding, -1
    bands = df.filter("key IS NOT NULL").groupBy("volume", "key", "band").agg(size.alias("n"))
    ahead = bands.select("volume", "key", "band", F.coalesce(F.sum("n").over(Window.partitionBy("volume").orderBy("key", "band").rowsBetween(*before)), F.lit(0)).alias("ahead"))
    inside = F.coalesce(size.over(Window.partitionBy("volume", "key", "band").orderBy("sha256").rowsBetween(*before)), F.lit(0))
    keyed = df.filter("key IS NOT NULL").withColumn("inside", inside).join(ahead, ["volume", "key", "band"])
    keyed = keyed.select("key", F.col("key").alias("place"), "volume", (F.col("ahead") + F.col("inside")).alias("offset"), "length", "sha256", "copies")
    digits = F.conv(F.substr("sha256", F.lit(1), F.lit(15)), 16, 10).cast("bigint")
    none = F.lit(None).cast("bigint")
    loose = df.filter("key IS NULL").select("key", digits.alias("place"), none.alias("volume"), none.alias("offset"), "length", "sha256", "copies")
    return keyed.unionByName(loose)


def _slots(entries: DataFrame) -> DataFrame:
    """side, keyed, n, length, digest and number of rows of each slot, from sums over its records."""
    whole = F.sha2(F.concat_ws("*", "sha256", "length", "copies"), 256)
    words = [F.sum(F.conv(F.substr("h", F.lit(1 + 16 * k), F.lit(16)), 16, 10).cast("decimal(20,0)")) for k in range(4)]
    rows = entries.select("side", F.col("key").isNotNull().alias("keyed"), F.col("place").alias("n"), (F.col("length") * F.col("copies")).alias("bytes"), whole.alias("h"))
    return rows.groupBy("side", "keyed", "n").agg(F.sum("bytes").alias("length"), F.sha2(F.concat_ws(":", *words), 256).alias("digest"), F.count(F.lit(1)).alias("records"))


def _parents(nodes: DataFrame) -> DataFrame:
    """The nodes above: each hashes places, lengths and digests of its up to FANOUT children in order."""
    ordered = F.array_sort(F.collect_list(F.struct("n", "length", "digest")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["n"], x["length"], x["digest"])), ",")
    up = nodes.groupBy("side", "keyed", F.shiftright("n", FANOUT_BITS).alias("p")).agg(F.sum("length").alias("length"), F.sha2(text, 256).alias("digest"))
    return up.select("side", "keyed", F.col("p").alias("n"), "length", "digest")


def levels_above(entries: DataFrame) -> int:
    """How many levels stand over the slots until only the places 0 and -1 are left."""
    bits = max((x if x >= 0 else -x - 1).bit_length() if x is not None else 0 for x in entries.agg(F.min("place"), F.max("place")).first())
    return -(-bits // FANOUT_BITS)


def trees(entries: DataFrame, at: Scratch) -> list[DataFrame]:
    """The replicas' trees (side tells them apart) as levels of (side, keyed, n, length, digest), slots first.

    They are equally high. The last level has up to four nodes a replica, which stand for its root."""
    out = [at.write(_slots(entries), "level0")]
    for k in range(levels_above(entries)):
        out.append(at.write(_parents(out[-1]), f"level{k + 1}"))
    return out


def _differ(nodes: DataFrame) -> DataFrame:
    """keyed and n of the nodes that only one side has or that differ."""
    node = F.struct("length", "digest")
    left, right = (F.max(F.when(F.col("side") == k, node)) for k in (0, 1))
    return nodes.groupBy("keyed", "n").agg(left.alias("l"), right.alias("r")).filter("NOT l <=> r").select("keyed", "n")


def damaged_slots(levels: list[DataFrame]) -> DataFrame:
    """keyed and n of the slots that differ: from the root down, the children of nodes that differ."""
    found = _differ(levels[-1])
    for nodes in levels[-2::-1]:
        parent = found.select("keyed", F.col("n").alias("p"))
        found = _differ(nodes.withColumn("p", F.shiftright("n", FANOUT_BITS)).join(parent, ["keyed", "p"], "left_semi"))
    return found


def _flagged(rows: DataFrame, slots: DataFrame, total: int) -> DataFrame:
    """rows with ``flag``: whether their slot (keyed, place) is in ``slots``, which knows its number of ``records``.

    Slots with over a thousandth of the ``total`` records, or with more than a task should
    have, are fewer than total / limit and broadcast; the rest is a join of light keys."""
    least = min(total * HEAVY_SHARE, TASK_ROWS)
    heavy = slots.filter(F.col("records") > least).select("keyed", "place", F.lit(True).alias("__heavy"))
    light = slots.filter(F.col("records") <= least).select("keyed", "place", F.lit(True).alias("__light"))
    marked = rows.join(F.broadcast(heavy), ["keyed", "place"], "left")
    rest = marked.filter(F.col("__heavy").isNull()).join(light.hint("merge"), ["keyed", "place"], "left")
    flag = F.coalesce("__light", F.lit(False)).alias("flag")
    return rest.select(*rows.columns, flag).unionByName(marked.filter("__heavy").select(*rows.columns, F.lit(True).alias("flag")))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, volume, offset, length, sha256, copies and verdict of the records of two replicas.

    left and right hold key and record. Copies that both sides have are ok. Of what is left
    over, the left's copies are corrupt if the right has others under the key, else missing;
    the right's are altered if the left has others under the key, else extra. A record with
    more copies on one side has two rows. Offsets are those of the own replica."""
    at = Scratch(left.sparkSession, "fixity")
    a, b = at.write(manifest(left), "left"), at.write(manifest(right), "right")
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    total = both.count()
    levels = trees(both, at)
    sizes = levels[0].groupBy("keyed", "n").agg(F.sum("records").alias("records"))
    slots = at.write(damaged_slots(levels).join(sizes, ["keyed", "n"]).withColumnRenamed("n", "place"), "slots")
    value = ["key", "volume", "offset", "length", "sha256", "copies"]
    spot = ["keyed", "place", "sha256"]
    seen = [_flagged(x.withColumn("keyed", F.col("key").isNotNull()), slots, total) for x in (a, b)]
    own = [at.write(x.filter("flag").drop("flag"), f"damaged{k}") for k, x in enumerate(seen)]
    whole = seen[0].filter("NOT flag").select(*value, F.lit("ok").alias("verdict"))
    parts = []
    for mine, other in (own, own[::-1]):
        found = mine.join(other.select(*spot, F.col("copies").alias("there")), spot, "left")
        parts.append(found.select("keyed", "place", *value, F.least("copies", F.coalesce("there", F.lit(0))).alias("same")))
    here, there = (p.filter("copies > same") for p in parts)
    shared = parts[0].filter("same > 0").select(*value[:-1], F.col("same").alias("copies"), F.lit("ok").alias("verdict"))

    def surplus(mine: DataFrame, other: DataFrame, matched: str, alone: str) -> DataFrame:
        # records without a key aren't versions of each other
        others = other.filter("keyed").select("keyed", "place").distinct().join(slots, ["keyed", "place"])
        rows = _flagged(mine, others, total)
        offset = (F.col("offset") + F.col("length") * F.col("same")).alias("offset")
        return rows.select("key", "volume", offset, "length", "sha256", (F.col("copies") - F.col("same")).alias("copies"), F.when(F.col("flag"), matched).otherwise(alone).alias("verdict"))

    return whole.unionByName(shared).unionByName(surplus(here, there, "corrupt", "missing")).unionByName(surplus(there, here, "altered", "extra"))


def replica(records: DataFrame) -> DataFrame:
    """A damaged copy: of 97 keys one has a byte changed, of 389 one is gone, of 509 one has moved to a new key."""
    k = F.col("key")
    bad = F.concat(F.substr("record", F.lit(1), F.length("record") - 1), F.lit("~"))
    df = records.filter(F.coalesce(F.pmod(k, F.lit(389)) != 7, F.lit(True)))
    return df.select(F.when(F.pmod(k, F.lit(509)) == 11, k + 10_000_000).otherwise(k).alias("key"), F.when(F.pmod(k, F.lit(97)) == 5, bad).otherwise(F.col("record")).alias("record"))


def op9_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no second replica: the query audits a copy with planted damage."""
    records = as_records(table(spark, sf_dir, "pages"))
    return audit(records, replica(records))


def sql(pages: str = "pages") -> str:
    """The same verdicts by comparing the digests of all records, for DuckDB."""

    def placed(name: str) -> str:
        return f"""
  SELECT *, CASE WHEN key IS NOT NULL THEN coalesce(sum(length * copies) OVER (PARTITION BY volume ORDER BY key, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT END AS "offset"
  FROM (SELECT key, (key - (key % {VOLUME} + {VOLUME}) % {VOLUME}) // {VOLUME} AS volume, (octet_length(encode(any_value(record))) + 4)::BIGINT AS length, sha256(record) AS sha256, count(*)::BIGINT AS copies FROM {name} GROUP BY key, sha256(record))"""

    def side(mine: str, other: str, matched: str, alone: str) -> str:
        return f"""
  SELECT key, volume, "offset" + length * least(copies, o) AS "offset", length, sha256, copies - least(copies, o) AS copies,
    CASE WHEN EXISTS (SELECT 1 FROM {other} y LEFT JOIN {mine} z ON z.key IS NOT DISTINCT FROM y.key AND z.sha256 = y.sha256 WHERE y.key = x.key AND y.copies > coalesce(z.copies, 0)) THEN '{matched}' ELSE '{alone}' END AS verdict
  FROM (SELECT m.*, coalesce(t.copies, 0) AS o FROM {mine} m LEFT JOIN {other} t ON t.key IS NOT DISTINCT FROM m.key AND t.sha256 = m.sha256) x WHERE copies > o"""

    head = "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10)"
    return f"""
WITH r AS (SELECT page_id AS key, {head} || coalesce(html, '') AS record FROM {pages}),
s AS (
  SELECT CASE WHEN (key % 509 + 509) % 509 = 11 THEN key + 10000000 ELSE key END AS key,
    CASE WHEN (key % 97 + 97) % 97 = 5 THEN substr(record, 1, length(record) - 1) || '~' ELSE record END AS record
  FROM r WHERE coalesce((key % 389 + 389) % 389 <> 7, true)),
a AS MATERIALIZED ({placed('r')}), b AS MATERIALIZED ({placed('s')})
SELECT a.key, a.volume, a."offset", a.length, a.sha256, least(a.copies, b.copies) AS copies, 'ok' AS verdict FROM a JOIN b ON a.key IS NOT DISTINCT FROM b.key AND a.sha256 = b.sha256
UNION ALL {side('a', 'b', 'corrupt', 'missing')}
UNION ALL {side('b', 'a', 'altered', 'extra')}"""
