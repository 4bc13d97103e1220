"""Queries that run as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as T
from ..sources.storage import shared_dir
from ..streaming.bus import SprintStore
from ..streaming.keyed import KeyedItems
from .q_sprints import EVENTS


def _streamed(spark, sf):
    """All events streamed through a store."""
    schema = T.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    store = SprintStore(spark, shared_dir(spark, "bus"))
    store.run(T.as_domain_events(raw))
    return store


def _numbered(df):
    """The tables' sprints and items are numbers; the bus has texts."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("sprint_id", "item_id") if c in df.columns})


def q50(spark, sf):
    return _numbered(_streamed(spark, sf).current())


def q58(spark, sf):
    return _numbered(_streamed(spark, sf).state("caps"))


def q62(spark, sf):
    """The events in three files, streamed file by file into state variables; the stream ends and goes on between them."""
    root = shared_dir(spark, "keyed")
    events = T.domain_events(spark, sf)
    cuts = events.agg(F.percentile_approx("seq", [1 / 3, 2 / 3])).first()[0] or [0, 0]
    part = (F.col("seq") > cuts[0]).cast("int") + (F.col("seq") > cuts[1]).cast("int")
    for k in range(3):
        events.filter(part == k).coalesce(1).write.mode("append").parquet(f"{root}/events")
        if k:
            raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/events")
            KeyedItems(spark, root).run(raw)
    return _numbered(KeyedItems(spark, root).current())


QUERIES = {"q50_bus_stream": (q50, f"WITH {EVENTS} SELECT * FROM item"), "q58_bus_capacity": (q58, f"WITH {EVENTS} SELECT * FROM cap"), "q62_state_variables": (q62, f"WITH {EVENTS} SELECT * FROM item")}
