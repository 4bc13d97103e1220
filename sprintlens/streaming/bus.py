"""The event bus as a stream: each micro-batch turns the last state into the next one.

State is the sprints' configurations, their items, capacities, the latest efforts and, if
asked for, the latest forecasts. A batch reads the state before it and its own events, never
the log, by the same functions of operators.sprints that define state over a whole log, so
stream and batch can't drift apart. Touched sprints are forecast anew if asked for, and
subscribers get their events. Sprints and items go by text, so that commits of a repository
and milestones of a tracker are items and sprints as they are. ``fold`` is the item state
kept operator-side.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import dist as D
from ..operators import forecast as M
from ..operators import sprints as P
from ..sources.storage import delete, exists, names, read_text, write_text

log = logging.getLogger(__name__)

#: An event's columns and their types.
FIELDS = {
    "seq": "bigint", "type": "string", "sprint_id": "string", "item_id": "string", "day": "date", "delta": "double", "new_status": "string", "scope_factor": "double",
    "length_days": "int", "working_days": "array<int>", "payload": "string", "model_version": "string",
}
EVENT = ", ".join(f"{n} {t}" for n, t in FIELDS.items())
#: Types that change the state, and two that are recorded only.
TYPES = ("configured", "added", "removed", "status", "scope", "availability", "effort", "invalidated", "forecast")
STATE = {
    "conf": "sprint_id string, start_day date, length_days int, working_days array<int>",
    "items": "sprint_id string, item_id string, status string, factor double",
    "caps": "sprint_id string, day date, available double",
    "effort": f"item_id string, payload {D.PAYLOAD}, seq bigint",
}
Handler = Callable[[DataFrame, int], None]


class SprintStore:
    """Under a root folder: log/<n>, rejects/<n>, touched/<n>, forecasts/<n>, done/<n> and the last states, state/<n>/<table>.

    n numbers what was taken in, micro-batches of a stream and published frames alike, in
    turn; done/<n> is written last and says which micro-batch the stream has come to. A
    number without it is written anew, and a micro-batch that comes again after it changes
    nothing, though its subscribers hear of it again. One stream and one writer at a time.
    Events are numbered from 0 in the order in which they count, over all that is taken in.
    With ``forecasts`` (samples, n_sims, seed), sprints that are touched are forecast anew,
    and each forecast is an event of type forecast."""

    def __init__(self, spark: SparkSession, root: str, forecasts: dict | None = None):
        self.spark, self.root, self.forecasts = spark, root.rstrip("/"), forecasts
        self.handlers: list[tuple[str | None, Handler]] = []

    def subscribe(self, kind: str | None, handler: Handler) -> None:
        """Calls handler(events, n) with the events of a type, or with all of them, of all that is taken in. What it raises is logged."""
        self.handlers.append((kind, handler))

    def _last(self) -> tuple[int, dict]:
        """The last number that is done, -1 if there is none, and what it says."""
        own = [int(n) for n in names(self.spark, f"{self.root}/done") if n.isdigit()]
        return (max(own), json.loads(read_text(self.spark, f"{self.root}/done/{max(own)}"))) if own else (-1, {"batch": -1, "number": -1})

    def state(self, table: str) -> DataFrame:
        """A state table as it is now."""
        n = self._last()[0]
        return self.spark.read.schema(STATE[table]).parquet(f"{self.root}/state/{n}/{table}") if n >= 0 else self.spark.createDataFrame([], STATE[table])

    def current(self) -> DataFrame:
        """The items of each sprint."""
        return self.state("items")

    def computed(self) -> DataFrame | None:
        """Each sprint's last forecasts, from the state alone; None if there are none yet."""
        path = f"{self.root}/state/{self._last()[0]}/forecasts"
        return self.spark.read.parquet(path) if exists(self.spark, path) else None

    def forecast(self, sprint_id: str) -> DataFrame | None:
        """The last forecasts of one sprint."""
        df = self.computed()
        return None if df is None else df.filter(F.col("sprint_id") == sprint_id)

    def _kept(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{path}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}")

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Takes in a micro-batch of the stream, unless that is done already."""
        n, said = self._last()
        if batch_id > said["batch"]:
            self._take(batch, n + 1, {"batch": batch_id, "number": n + 1})
        elif batch_id == said["batch"]:
            self._tell(said["number"])

    def publish(self, events: DataFrame) -> None:
        """Takes in a frame of events at once."""
        n, said = self._last()
        self._take(events, n + 1, said)

    def run(self, events: DataFrame, **trigger) -> None:
        """Feeds a streaming frame through, until it ends if the trigger says availableNow."""
        q = events.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", f"{self.root}/offsets").trigger(**(trigger or {"availableNow": True})).start()
        q.awaitTermination()

    def _take(self, events: DataFrame, n: int, said: dict) -> None:
        """Records events, rejects unknown types, and writes the next state and what follows from it."""
        good = F.coalesce(F.col("type").isin(*TYPES), F.lit(False))
        self._kept(events.filter(~good), f"rejects/{n}")
        columns = [(F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()]
        new = self._kept(events.filter(good).select(*columns), f"log/{n}")
        conf, items, caps, effort = (self.state(t) for t in STATE)

        at = f"state/{n}"
        latest = P.configured(new).select("sprint_id", "start_day", "length_days", "working_days")
        next_conf = self._kept(latest.unionByName(conf.join(latest, "sprint_id", "left_anti")), f"{at}/conf")
        next_items = self._kept(P.item_state(new, items, conf), f"{at}/items")
        next_caps = self._kept(P.capacity(new, caps, conf), f"{at}/caps")
        told = new.filter("type = 'effort'").withColumn("payload", D.decoded(F.col("payload"))).select("seq", "item_id", "payload")
        known = effort.unionByName(told.filter(D.payload_valid(F.col("payload"))).select("item_id", "payload", "seq"))
        next_effort = self._kept(P.latest_effort(known).select("item_id", "payload", "seq"), f"{at}/effort")

        own = new.filter("type IN ('configured', 'added', 'removed')").select("sprint_id")
        about = new.filter("type IN ('status', 'scope', 'effort')").select("item_id").distinct()
        held = items.unionByName(next_items).join(about, "item_id", "left_semi").select("sprint_id")
        everyone = next_conf.select("sprint_id")
        if new.filter("type = 'availability'").isEmpty():
            everyone = everyone.limit(0)
        touched = self._kept(own.union(held).union(everyone).distinct().join(next_conf, "sprint_id", "left_semi"), f"touched/{n}")
        before = self.computed()
        if self.forecasts is not None:
            some = {t: df.join(touched, "sprint_id", "left_semi") for t, df in (("items", next_items), ("conf", next_conf), ("caps", next_caps))}
            with_effort = some["items"].join(next_effort.select("item_id", F.col("payload").alias("effort")), "item_id", "left")
            f = self._kept(M.sprint_forecasts(with_effort, some["conf"], some["caps"], **self.forecasts), f"forecasts/{n}")
            before = f if before is None else f.unionByName(before.join(touched, "sprint_id", "left_anti"))
        if before is not None:
            self._kept(before, f"{at}/forecasts")
        write_text(self.spark, f"{self.root}/done/{n}", json.dumps(said))
        self._tell(n)
        for old in names(self.spark, f"{self.root}/state"):
            if int(old) < n - 1:
                delete(self.spark, f"{self.root}/state/{old}")
                delete(self.spark, f"{self.root}/done/{old}")

    def _tell(self, n: int) -> None:
        """Hands what was taken in under a number to the subscribers, its forecasts as events."""
        if not self.handlers:
            return
        new = self.spark.read.schema(EVENT).parquet(f"{self.root}/log/{n}")
        if exists(self.spark, f"{self.root}/forecasts/{n}"):
            f = self.spark.read.parquet(f"{self.root}/forecasts/{n}")
            computed = f.select(F.lit("forecast").alias("type"), "sprint_id", F.to_json(F.struct(*f.columns)).alias("payload"))
            new = new.unionByName(computed, allowMissingColumns=True)
        for kind, handler in self.handlers:
            try:
                handler(new if kind is None else new.filter(F.col("type") == kind), n)
            except Exception:
                log.exception("a subscriber of %s failed at %s", kind, n)


def step(state: dict, e: dict) -> None:
    """Applies one event to {sprint: {item: [status, factor]}}."""
    kind, s, i = e["type"], str(e["sprint_id"]), str(e["item_id"])
    if kind == "configured":
        state[s] = {}
    elif kind == "added":
        if s in state:
            state[s].setdefault(i, ["todo", 1.0])
    elif kind == "removed":
        state.get(s, {}).pop(i, None)
    elif kind in ("status", "scope"):
        for items in state.values():
            if i in items:
                if kind == "status":
                    items[i][0] = e["new_status"]
                else:
                    items[i][1] = max(0.0, e["scope_factor"])


def fold(events: DataFrame) -> DataFrame:
    """A stream of (tenant, events) as tenant and JSON state after each batch.

    Item events reach all sprints of a tenant, so the tenant is the key: tenants run in
    parallel, one tenant's events in turn."""

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values("seq")
        for e in rows.to_dict("records"):
            step(held, e)
        text = json.dumps(held)
        state.update((text,))
        yield pd.DataFrame({"tenant": [key[0]], "state": [text], "last_seq": [int(rows["seq"].max())]})

    return events.groupBy("tenant").applyInPandasWithState(update, "tenant string, state string, last_seq bigint", "state string", "update", GroupStateTimeout.NoTimeout)
