"""Item state by keyed state variables: a stream whose work follows its events, not its state.

Two stateful operators stand one behind the other. The first is keyed by sprint and knows
which items the sprint holds since when; configuring, adding and removing are its own
events, and what it passes on are the changes of holdings. The second is keyed by item: the
item's last status and last scope, and the sprints that hold it with their starts. A status
or scope is one write whatever number of sprints hold the item, since it counts for those
that held it before. Each keeps its variables in Spark's state store, which writes only what
changed and recovers by the stream's checkpoint. Events may come in any order inside a
micro-batch; across batches they come in the order of seq.

``current`` reads the state store, so no table of the whole state is ever rewritten. The
results are those of ``operators.sprints.item_state``. A status or scope without a value
leaves the item at its default; events of other types are left out.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOVES, CHANGES = ("configured", "added", "removed"), ("status", "scope")
#: What the first operator passes on, in the columns of the events that join it.
STEP = "item_id string, sprint_id string, seq bigint, type string, new_status string, scope_factor double"
ITEM = "sprint_id string, item_id string, status string, factor double, held boolean, seq bigint"
NEW = ("todo", -1, 1.0, -1)


def _ordered(frames: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """The rows of a key's frames by seq, which comes first; nulls are None."""
    rows = [r for f in frames for r in zip(*(f[c].astype(object).where(f[c].notna(), None) for c in ["seq", *columns]), strict=True)]
    return sorted(rows, key=lambda r: r[0])


class Holdings(StatefulProcessor):
    """Key: sprint. Its own events in, changes of its holdings out (type held or dropped)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.conf = handle.getValueState("conf", "seq bigint")
        self.held = handle.getMapState("held", "item_id string", "start_seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sprint, out = key[0], []
        known: dict[str, int | None] = {}  # starts as they are now, of the items looked at
        configured, cleared = self.conf.exists(), None

        def start(item: str) -> int | None:
            if item not in known:
                old = None if cleared is not None else self.held.getValue((item,))
                known[item] = None if old is None else old[0]
            return known[item]

        for seq, kind, item in _ordered(rows, ["type", "item_id"]):
            if kind == "configured":
                stored = [k[0] for k in self.held.keys()] if configured and cleared is None else []
                out += [(i, seq, "dropped") for i in dict.fromkeys([*stored, *known]) if start(i) is not None]
                known, configured, cleared = {}, True, seq
            elif kind == "added" and configured and start(item) is None:
                known[item] = seq
                out.append((item, seq, "held"))
            elif kind == "removed" and configured and start(item) is not None:
                known[item] = None
                out.append((item, seq, "dropped"))
        if cleared is not None:
            self.held.clear()
            self.conf.update((cleared,))
        for item, at in known.items():
            if at is not None:
                self.held.updateValue((item,), (at,))
            elif cleared is None and self.held.containsKey((item,)):
                self.held.removeKey((item,))
        f = pd.DataFrame(out, columns=["item_id", "seq", "type"])
        yield f.assign(sprint_id=sprint, new_status=None, scope_factor=float("nan"))[["item_id", "sprint_id", "seq", "type", "new_status", "scope_factor"]]

    def close(self) -> None:
        pass


def shown(last: tuple, start: int) -> tuple[str, float]:
    """Status and factor for a sprint that holds the item since start."""
    status, status_seq, factor, factor_seq = last
    return (status if status_seq > start and status is not None else NEW[0]), (max(0.0, factor) if factor_seq > start and factor is not None else NEW[2])


class Items(StatefulProcessor):
    """Key: item. Changes of holdings, statuses and scopes in; the item's state in each sprint where it changed out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string, status_seq bigint, factor double, factor_seq bigint")
        self.held = handle.getMapState("held", "sprint_id string", "start_seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        item, starts = key[0], {}  # starts: as they are now, of the sprints that moved
        last = old = tuple(self.last.get()) if self.last.exists() else NEW
        seq = -1
        for seq, kind, sprint, status, factor in _ordered(rows, ["type", "sprint_id", "new_status", "scope_factor"]):
            if kind == "status":
                last = (status, seq, *last[2:])
            elif kind == "scope":
                last = (*last[:2], factor, seq)
            else:
                starts[sprint] = seq if kind == "held" else None
        for sprint, at in starts.items():
            if at is not None:
                self.held.updateValue((sprint,), (at,))
            elif self.held.containsKey((sprint,)):
                self.held.removeKey((sprint,))
        if last != old:
            self.last.update(last)
            starts = {s: None for s, at in starts.items() if at is None} | {k[0]: v[0] for k, v in self.held.iterator()}
        out = [(s, item, *(shown(last, at) if at is not None else (None, None)), at is not None, seq) for s, at in starts.items()]
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in ITEM.split(", ")])

    def close(self) -> None:
        pass


def item_changes(events: DataFrame) -> DataFrame:
    """A stream of events as a stream of changed items: sprint_id, item_id, status, factor, held and seq (append mode)."""
    own = events.select(*[F.col(c).cast(t).alias(c) for c, t in (("seq", "bigint"), ("type", "string"), ("sprint_id", "string"), ("item_id", "string"), ("new_status", "string"), ("scope_factor", "double"))])
    moves = own.filter(F.col("type").isin(*MOVES)).select("sprint_id", "item_id", "seq", "type")
    steps = moves.groupBy("sprint_id").transformWithStateInPandas(Holdings(), STEP, "append", "none")
    changes = own.filter(F.col("type").isin(*CHANGES)).select(*[c.split(" ")[0] for c in STEP.split(", ")])
    return steps.unionByName(changes).groupBy("item_id").transformWithStateInPandas(Items(), ITEM, "append", "none")


@contextlib.contextmanager
def _state_variables(spark: SparkSession):
    """Within it, streams that start keep their state in the store that state variables need."""
    old = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, old) if old is not None else spark.conf.unset(STORE)


class KeyedItems:
    """Item state of a stream of events, under a root folder that holds the stream's checkpoint."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.checkpoint = spark, f"{root.rstrip('/')}/offsets"

    def run(self, events: DataFrame, on_changes: Callable[[DataFrame, int], None] | None = None, **trigger) -> None:
        """Feeds a streaming frame through, until it ends if the trigger says availableNow; on_changes gets each batch's changed items."""
        with _state_variables(self.spark):
            out = item_changes(events).writeStream.outputMode("append").option("checkpointLocation", self.checkpoint).trigger(**(trigger or {"availableNow": True}))
            q = (out.foreachBatch(on_changes) if on_changes else out.format("noop")).start()
        q.awaitTermination()

    def _variable(self, name: str, operator: int) -> DataFrame:
        return self.spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name).load(self.checkpoint)

    def current(self) -> DataFrame:
        """sprint_id, item_id, status and factor of the items that sprints hold, from the state store."""
        known = self.spark.read.format("state-metadata").load(self.checkpoint)
        items = known.filter(F.col("operatorProperties").contains('"stateName":"last"')).agg(F.max("operatorId")).first()[0]
        with _state_variables(self.spark):
            held = self._variable("held", items).select("key.item_id", "user_map_key.sprint_id", "user_map_value.start_seq")
            last = self._variable("last", items).select("key.item_id", "value.*")
        j = held.join(last, "item_id", "left")
        status = F.when(F.col("status_seq") > F.col("start_seq"), F.col("status"))
        factor = F.when(F.col("factor_seq") > F.col("start_seq"), F.greatest(F.lit(0.0), F.col("factor")))
        return j.select("sprint_id", "item_id", F.coalesce(status, F.lit(NEW[0])).alias("status"), F.coalesce(factor, F.lit(NEW[2])).alias("factor"))
