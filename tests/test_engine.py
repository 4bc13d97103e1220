"""The engine's operators against oracles, folds, closed forms and fixtures."""

import dataclasses
import datetime as dt
import json
import math
import os
import random
import subprocess
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Row
from pyspark.sql import functions as F

from sprintlens.functions import dist as D
from sprintlens.functions import rng as R
from sprintlens.functions import scalars as S
from sprintlens.operators import curves as C
from sprintlens.operators import features as X
from sprintlens.operators import forecast as M
from sprintlens.operators import history as H
from sprintlens.operators import models as N
from sprintlens.operators import sprints as P
from sprintlens.operators.fits import AuthorFits
from sprintlens.plans import catalogue, config, demo, stages
from sprintlens.plans import ml as ML
from sprintlens.sources import files, git, ingest, paged, rest, storage, synthetic
from sprintlens.sources import tables as T
from sprintlens.streaming import bus, keyed
from sprintlens.streaming.keyed import KeyedItems

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FITTED = {"q46_hawkes_fit", "q47_hmm_fit", "q48_mdn_train", "q49_multitask_train", "q60_synthetic_changes", "q63_data_parallel_train", "q64_ml_pipeline"}
#: The events' columns that these tests fill.
EVENT = "seq bigint, type string, sprint_id bigint, item_id bigint, day date, delta double, new_status string, scope_factor double"


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, duck, sf, name):
    df = catalogue.queries()[name](spark, sf)
    cur = duck.execute(catalogue.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr([_plain(v) for v in r]) for r in cur.fetchall())
    assert sorted(repr([_plain(r[c]) for c in cols]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(FITTED))
def test_fitted_queries_run(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_row_order_and_partitions_do_not_matter(spark, sf):
    from sprintlens.sources import tables as T

    ev = T.domain_events(spark, sf)
    for f in (P.membership, P.item_state, P.capacity):
        a = sorted(map(str, f(ev).collect()))
        assert a == sorted(map(str, f(ev.orderBy(F.md5(F.col("seq").cast("string"))).repartition(7)).collect()))


def _events(rng, n):
    kinds = ["configured"] * 2 + ["added"] * 30 + ["removed"] * 12 + ["status"] * 20 + ["scope"] * 15 + ["availability"] * 10
    return [
        dict(seq=k, type=rng.choice(kinds), sprint_id=rng.randrange(3), item_id=rng.randrange(6), day=None, delta=float(rng.randrange(-9, 9)), new_status=rng.choice(["todo", "in_progress", "done"]), scope_factor=float(rng.randrange(-1, 4)))
        for k in range(n)
    ]


def test_fold_equals_sets(spark):
    """Sets of joins against a sequential fold on random logs."""
    rng = random.Random(4)
    for n in (20, 150, 300):
        rows, state = _events(rng, n), {}
        for e in rows:
            bus.step(state, e)
        want = {(int(s), int(i)): tuple(v) for s, items in state.items() for i, v in items.items()}
        df = spark.createDataFrame([Row(**r) for r in rows], EVENT)
        assert {(r.sprint_id, r.item_id): (r.status, r.factor) for r in P.item_state(df).collect()} == want


def test_stream_in_several_batches(spark, tmp_path):
    rows, state = _events(random.Random(8), 120), {}
    src = tmp_path / "src"
    for k in range(0, 120, 40):
        part = spark.createDataFrame([Row(**r) for r in rows[k : k + 40]], EVENT).coalesce(1)
        part.write.mode("append").parquet(str(src))
        for f in src.glob("part-*.parquet"):
            if f.name.startswith("part-"):
                f.rename(src / f"{k:04d}-{f.name[5:]}")
    bad = spark.createDataFrame([Row(seq=999, type="nonsense", sprint_id=0, item_id=0, day=None, delta=0.0, new_status="", scope_factor=0.0)], EVENT).coalesce(1)
    bad.write.mode("append").parquet(str(src))
    store = bus.SprintStore(spark, str(tmp_path / "store"))
    store.run(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(src)))
    for e in rows:
        bus.step(state, e)
    want = {(s, i): tuple(v) for s, items in state.items() for i, v in items.items()}
    assert {(r.sprint_id, r.item_id): (r.status, r.factor) for r in store.current().collect()} == want
    assert spark.read.parquet(str(tmp_path / "store" / "rejects" / "*")).count() == 1
    assert len(storage.names(spark, str(tmp_path / "store" / "state"))) <= 2  # older states go
    seen = []
    store.subscribe(None, lambda e, n: seen.append((n, e.count())))
    store.on_batch(spark.read.schema(EVENT).parquet(str(src)).filter("seq >= 80"), 3)  # the last batch comes again
    store.on_batch(spark.read.schema(EVENT).parquet(str(src)).filter("seq >= 80"), 2)  # and an older one
    assert sorted(storage.names(spark, str(tmp_path / "store" / "state")))[-1] == "3" and seen == [(3, 0)]
    assert {(r.sprint_id, r.item_id): (r.status, r.factor) for r in store.current().collect()} == want


def test_stream_and_published_events_in_turn(spark, tmp_path):
    """A stream, a published frame, the stream again after a restart: nothing takes another's number."""
    src, root = tmp_path / "src", str(tmp_path / "store")
    e = lambda seq, kind, item: Row(seq=seq, type=kind, sprint_id=1, item_id=item, day=dt.date(2025, 1, 6), delta=0.0, new_status="done", scope_factor=1.0)
    feed = lambda rows: spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(src))
    read = lambda: spark.readStream.schema(EVENT).parquet(str(src))
    feed([e(0, "configured", 0), e(1, "added", 10)])
    bus.SprintStore(spark, root).run(read())
    bus.SprintStore(spark, root).publish(spark.createDataFrame([e(2, "added", 20)], EVENT))
    feed([e(3, "added", 30), e(4, "status", 20)])
    store = bus.SprintStore(spark, root)
    store.run(read())
    store.publish(spark.createDataFrame([e(5, "removed", 10), e(6, "added", 40)], EVENT))
    assert {(r.item_id, r.status) for r in store.current().collect()} == {("20", "done"), ("30", "todo"), ("40", "todo")}
    assert spark.read.parquet(f"{root}/log/*").count() == 7


def test_batch_that_breaks_off_is_written_anew(spark, tmp_path):
    e = lambda seq, kind, item: Row(seq=seq, type=kind, sprint_id=1, item_id=item, day=dt.date(2025, 1, 6), delta=0.0, new_status="done", scope_factor=1.0)
    store = bus.SprintStore(spark, str(tmp_path / "bus"))
    store.on_batch(spark.createDataFrame([e(0, "configured", 0), e(1, "added", 10)], EVENT), 0)
    kept = store._kept
    for path in ("log/1", "state/1/items", "state/1/effort", "touched/1"):
        def failing(df, to, path=path):
            out = kept(df, to)
            return 1 / 0 if to == path else out

        store._kept = failing
        with pytest.raises(ZeroDivisionError):
            store.on_batch(spark.createDataFrame([e(2, "added", 20), e(3, "status", 10)], EVENT), 1)
        assert {r.item_id for r in store.current().collect()} == {"10"}
    store._kept = kept
    store.on_batch(spark.createDataFrame([e(2, "added", 20), e(3, "status", 10)], EVENT), 1)
    assert {(r.item_id, r.status) for r in store.current().collect()} == {("10", "done"), ("20", "todo")}


def test_scores_of_real_keys_reach_a_forecast(spark, tmp_path):
    """Keys of the library's own stages, <commit>@<repository> and <repo>#milestone-<n>, go through the bus to a forecast."""
    scored = spark.createDataFrame([("sha1@/r/a", 1.0, 1.0, 2.0, json.dumps({"type": "gmm", "weights": [1.0], "means": [4.0], "stds": [1e-9]})), ("a/b#13", 1.0, 1.0, 2.0, json.dumps({"type": "quantiles", "quantiles": {"0.5": 12.0, "0.9": 12.0}}))], "id string, mean double, p50 double, p90 double, payload string")
    sprint, day = "a/b#milestone-3", dt.date(2025, 1, 6)
    rows = [(0, "configured", sprint, None, day, 5, [0, 1, 2, 3, 4]), (1, "added", sprint, "sha1@/r/a", None, None, None), (2, "added", sprint, "a/b#13", None, None, None)]
    head = spark.createDataFrame(rows, "seq bigint, type string, sprint_id string, item_id string, day date, length_days int, working_days array<int>")
    store = bus.SprintStore(spark, str(tmp_path / "bus"), {"samples": (8.0,), "n_sims": 10, "seed": 1})
    store.publish(head)
    store.publish(stages.estimates(scored, 100, "v1"))
    assert [tuple(r.p_by_day) for r in store.forecast(sprint).collect()] == [(0.0, 1.0, 1.0, 1.0, 1.0)] and store.forecast("other").count() == 0
    # a later batch that touches another sprint leaves this one's forecast in the state
    store.publish(spark.createDataFrame([(200, "configured", "other", day)], "seq bigint, type string, sprint_id string, day date"))
    assert store.computed().count() == 2 and store.forecast(sprint).first().p_by_day[1] == 1.0


def test_stateful_fold(spark, tmp_path):
    rows, state = _events(random.Random(9), 80), {}
    for e in rows:
        bus.step(state, e)
    spark.createDataFrame([Row(tenant="t", **r) for r in rows], "tenant string, " + EVENT).write.parquet(str(tmp_path / "src"))
    raw = spark.readStream.schema("tenant string, " + EVENT).parquet(str(tmp_path / "src"))
    q = bus.fold(raw).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("folded").orderBy(F.desc("last_seq")).first()
    assert json.loads(last["state"]) == state


def test_state_variables_over_batches_and_restarts(spark, tmp_path):
    """Keyed state variables against a sequential fold, batch by batch, over restarts; what a batch passes on is what changed."""
    rows, src, root = _events(random.Random(21), 240), tmp_path / "src", str(tmp_path / "keyed")
    own, state, seen = [], {}, []
    for k in range(0, 240, 60):
        part = rows[k : k + 60]
        random.Random(k).shuffle(part)  # any order inside a batch
        spark.createDataFrame([Row(**r) for r in part], EVENT).repartition(1).write.mode("append").parquet(str(src))
        if k % 120 == 0 and k < 180:
            continue  # the next run meets two files
        store = KeyedItems(spark, root)
        store.run(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(src)), lambda df, n: seen.append(df.collect()))
        for e in rows[len(own) : k + 60]:
            bus.step(state, e)
        own = rows[: k + 60]
        want = {(s, i): tuple(v) for s, items in state.items() for i, v in items.items()}
        assert {(r.sprint_id, r.item_id): (r.status, r.factor) for r in store.current().collect()} == want
    assert len([b for b in seen if b]) == 4
    told = {}
    for b in seen:
        assert len({(r.sprint_id, r.item_id) for r in b}) == len(b)
        told |= {(r.sprint_id, r.item_id): (r.status, r.factor) if r.held else None for r in b}
    assert {k: v for k, v in told.items() if v} == want
    assert spark.conf.get(keyed.STORE, None) != keyed.ROCKS


def test_state_variables_by_hand():
    """The processors over a store in memory: clearing, adding again, statuses before and after the start, values that are null."""

    class Held:
        def __init__(self):
            self.d = {}

        getValue = lambda self, k: self.d.get(k)
        updateValue = lambda self, k, v: self.d.__setitem__(k, v)
        containsKey = lambda self, k: k in self.d
        removeKey = lambda self, k: self.d.pop(k)
        keys = lambda self: iter(list(self.d))
        iterator = lambda self: iter(list(self.d.items()))
        clear = lambda self: self.d.clear()

    class Value:
        v = None
        exists = lambda self: self.v is not None
        get = lambda self: self.v
        update = lambda self, v: setattr(self, "v", v)

    class Handle:
        getMapState = lambda self, *a: Held()
        getValueState = lambda self, *a: Value()

    def fed(p, key, *rows, columns):
        out = pd.concat(list(p.handleInputRows((key,), iter([pd.DataFrame([r], columns=columns) for r in rows]), None)))
        return [tuple(None if x is None or x != x else x for x in r) for r in out.itertuples(index=False)]

    h = keyed.Holdings()
    h.init(Handle())
    moved = lambda *rows: [(r[0], r[2], r[3]) for r in fed(h, "s", *rows, columns=["seq", "type", "item_id"])]
    assert moved((0, "added", "a")) == []  # not configured yet
    assert moved((3, "added", "a"), (1, "configured", None), (2, "added", "b"), (4, "removed", "c"), (5, "added", "a")) == [("b", 2, "held"), ("a", 3, "held")]
    assert moved((6, "removed", "a"), (7, "added", "a"), (8, "configured", None), (9, "added", "b")) == [("a", 6, "dropped"), ("a", 7, "held"), ("b", 8, "dropped"), ("a", 8, "dropped"), ("b", 9, "held")]
    assert h.held.d == {("b",): (9,)} and h.conf.v == (8,)
    i = keyed.Items()
    i.init(Handle())
    columns = ["seq", "type", "sprint_id", "new_status", "scope_factor"]
    got = fed(i, "a", (1, "held", "s", None, None), (2, "status", None, "done", None), (3, "held", "t", None, None), (4, "scope", None, None, -2.0), columns=columns)
    assert sorted(got) == [("s", "a", "done", 0.0, True, 4), ("t", "a", "todo", 0.0, True, 4)]
    assert sorted(fed(i, "a", (5, "status", None, None, None), (6, "dropped", "t", None, None), columns=columns)) == [("s", "a", "todo", 0.0, True, 6), ("t", "a", None, None, False, 6)]
    assert fed(i, "a", (7, "held", "t", None, None), columns=columns) == [("t", "a", "todo", 1.0, True, 7)]  # untouched sprints aren't told


def test_capacity_walk_against_loop(spark):
    rng, rows, want = random.Random(3), [(0, "configured", None, 0.0)], 8.0
    for k in range(1, 60):
        d = float(rng.randrange(-9, 9))
        rows.append((k, "availability", "2024-01-01", d))
        want = max(0.0, want + d)
    df = spark.createDataFrame([(s, t, 1, None, d, x, None, None) for s, t, d, x in rows], "seq bigint, type string, sprint_id bigint, item_id bigint, day string, delta double, new_status string, scope_factor double").withColumn("day", F.to_date("day"))
    assert P.capacity(df).first()["available"] == pytest.approx(want)


def test_capacity_scan_over_blocks(spark):
    """Walks from configurations anywhere among the deltas of one hot day, whatever the blocks; with a state before, too."""
    rng = random.Random(5)
    rows, days = [], [dt.date(2025, 1, 6)] * 8 + [dt.date(2025, 1, 7), dt.date(2025, 1, 8)]
    for k in range(400):
        rows.append((k, "configured", rng.randrange(12), dt.date(2025, 1, 6), 0.0) if rng.random() < 0.1 else (k, "availability", None, rng.choice(days), float(rng.randrange(-9, 9))))
    schema = "seq bigint, type string, sprint_id bigint, day date, delta double"
    df, caps = spark.createDataFrame(rows, schema), {}
    for _, kind, s, d, x in rows:
        if kind == "configured":
            caps[s] = {}
        else:
            for c in caps.values():
                c[d] = max(0.0, c.get(d, 8.0) + x)
    want = {(s, d): x for s, c in caps.items() for d, x in c.items()}
    for block in (1, 7, 64, 1 << 16):
        assert {(r.sprint_id, r.day): r.available for r in P.capacity(df, block=block).collect()} == pytest.approx(want)
        first = df.filter("seq < 250")
        prior, conf = P.capacity(first, block=block), P.configured(first).select("sprint_id")
        assert {(r.sprint_id, r.day): r.available for r in P.capacity(df.filter("seq >= 250"), prior, conf, block).collect()} == pytest.approx(want)
    # no window holds more of a day than a block: the plan's windows are by day and block, or over one row a block
    hot = spark.range(5000).select(F.col("id").alias("seq"), F.when(F.col("id") == 0, "configured").otherwise("availability").alias("type"), F.lit(1).cast("bigint").alias("sprint_id"), F.lit(dt.date(2025, 1, 6)).alias("day"), F.lit(1.0).alias("delta"))
    assert P.capacity(hot, block=100).collect() == [(1, dt.date(2025, 1, 6), 8.0 + 4999)]
    steps = hot.filter("seq > 0").select("day", F.floor(F.col("seq") / 100).alias("block"), "seq", F.col("delta").alias("sum"), F.col("delta").alias("low"))
    assert P._scan(steps, ["day", "block"], "seq").groupBy("day", "block").count().agg(F.max("count")).first()[0] <= 100


def test_state_of_a_hot_item(spark):
    """An item with most of the events in many sprints: its changes become one row before they meet the sprints."""
    n = 4000
    ev = spark.range(n).select(
        F.col("id").alias("seq"), F.when(F.col("id") < 20, "configured").when(F.col("id") < 40, "added").when(F.col("id") % 2 == 0, "status").otherwise("scope").alias("type"), (F.col("id") % 20).alias("sprint_id"), F.lit(7).cast("bigint").alias("item_id"),
        F.lit(dt.date(2025, 1, 6)).alias("day"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("new_status"), F.col("id").cast("double").alias("scope_factor"),
    )
    got = P.item_state(ev)
    assert {tuple(r) for r in got.collect()} == {(s, 7, f"s{n - 2}", float(n - 1)) for s in range(20)}
    joins = [line for line in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line]
    assert joins and not any("at#" in line or "(seq#" in line and "start_seq" in line for line in joins)  # no range join of changes and holdings


def test_forecast_hand_case(spark):
    """Two items of 10 hours, draws of 8, 10 or 12: day 1 never, day 2 in 6 of 9 cases, day 3 always."""
    conf = spark.sql("SELECT 'S' AS sprint_id, DATE '2025-01-06' AS start_day")
    caps = spark.sql("SELECT 'S' AS sprint_id, date_add(DATE '2025-01-06', cast(id AS int)) AS day, 16.0D AS available FROM range(10)")
    items = spark.sql("SELECT 'S' AS sprint_id, id AS item_id, 'todo' AS status, 1.0D AS factor FROM range(2)")
    cal = P.calendar(conf, caps, 10)
    r = M.summarise(M.simulate(items, cal, (8.0, 10.0, 12.0), 2000, 1, F.lit(10.0), ["sprint_id"]), ["sprint_id"], 10).first()
    assert (r.p_day_1, r.p_day_3, r.p_end, r.remaining_p50) == (0.0, 1.0, 1.0, 0.0)
    assert r.p_day_2 == pytest.approx(2 / 3, abs=0.04)
    more = M.summarise(M.simulate(P.scope_growth(items, 1.5), cal, (8.0, 10.0, 12.0), 2000, 1, F.lit(10.0), ["sprint_id"]), ["sprint_id"], 10).first()
    assert all(more[f"p_day_{k}"] <= r[f"p_day_{k}"] for k in range(1, 11))


def test_distributions_against_sampling(spark):
    m = "named_struct('weights', array(0.3D, 0.7D), 'means', array(0.1D, 0.6D), 'stds', array(0.3D, 0.2D), 'low', 0.0D, 'high', 1.0D)"
    row = spark.range(1).selectExpr(f"{m} AS m").select(D.clipped_mean(F.col("m")).alias("mean"), D.mixture_cdf(F.col("m"), F.lit(0.5)).alias("cdf"), D.mixture_quantile(0.5)(F.col("m")).alias("p50")).first()
    r = np.random.default_rng(0)
    c = r.random(400_000) < 0.3
    x = np.where(c, r.normal(0.1, 0.3, 400_000), r.normal(0.6, 0.2, 400_000))
    assert row["mean"] == pytest.approx(np.clip(x, 0, 1).mean(), abs=2e-3)
    inside = x[(x > 0) & (x < 1)]
    assert row["cdf"] == pytest.approx((inside <= 0.5).mean(), abs=4e-3)
    assert row["p50"] == pytest.approx(np.median(inside), abs=4e-3)
    draws = spark.range(20000).selectExpr("id", f"{m} AS m").select(D.mixture_sample(F.col("m"), 1, F.col("id")).alias("x")).agg(F.avg("x")).first()[0]
    assert draws == pytest.approx(row["mean"], abs=0.01)
    d = "array(named_struct('q', 0.5D, 'v', 1.0D), named_struct('q', 0.8D, 'v', 2.0D), named_struct('q', 0.9D, 'v', 5.0D))"
    got = spark.range(20000).selectExpr("id", f"{d} AS d").select(D.quantile_mean(F.col("d")).alias("m"), D.quantile_sample(F.col("d"), 3, F.col("id")).alias("x")).agg(F.avg("m"), F.avg("x")).first()
    assert got[0] == pytest.approx(got[1], abs=0.05)


def test_normal_cdf(spark):
    rows = spark.range(-40, 41).select((F.col("id") / 10).alias("z")).select("z", D.normal_cdf(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * math.erfc(-r.z / math.sqrt(2))) < 1e-7 for r in rows)


def test_fits():
    r = np.random.default_rng(1)
    y = (np.arange(300) % 50 < 10).astype(float) * (r.random(300) < 0.6)
    rates = np.full((1, 300), 0.05), np.full((1, 300), 0.1)
    ll, gamma, _ = C.hmm_forward(y[None], *rates, np.array([0.4]), np.array([300]))
    assert ((gamma >= 0) & (gamma <= 1 + 1e-12)).all() and np.allclose(gamma.sum(2), 1)
    assert C.hmm_fit([y], [0], 5, epochs=25)[0] > C.hmm_fit([y], [0], 5, epochs=1)[0]
    # neither padding nor company changes a fit
    alone, together = C.hmm_fit([y[:120]], [0], 5, epochs=5), C.hmm_fit([y, y[:120]], [0, 0], 5, epochs=5)
    assert alone[0][0] == pytest.approx(together[0][1]) and np.allclose(alone[1][0], together[1][1])
    # the gradient by Fisher's identity: a step up the start chance's logit moves the likelihood as it says
    _, _, moves = C.hmm_forward(y[None], *rates, np.array([0.4]), np.array([300]))
    g = (moves[0, :, 1, 0] - 0.05 * moves[0, :, 1].sum(1)).sum()
    up = 1 / (1 + math.exp(-(math.log(0.05 / 0.95) + 1e-5)))
    more = C.hmm_forward(y[None], np.full((1, 300), up), rates[1], np.array([0.4]), np.array([300]))[0]
    assert float(more[0] - ll[0]) / 1e-5 == pytest.approx(g, rel=1e-2)
    times = np.sort(np.concatenate([t + r.exponential(3, 8) for t in np.arange(0, 1000, 100.0)]))
    mu, alpha, beta, ll = (v[0] for v in C.hawkes_fit([times], [1000.0]))
    plain = len(times) * math.log(len(times) / 1000) - len(times)
    assert ll > plain and mu > 0 and 0 < alpha / beta < 1


def test_gradients_and_training():
    r = np.random.default_rng(2)
    for loss, n in ((N.mixture_loss, 9), (N.pinball_loss, 4)):
        o, y = r.standard_normal((5, n)), r.random(5)
        g = loss(o, y)[1]
        for i, j in ((0, 0), (2, 3), (4, n - 1)):
            e = np.zeros_like(o)
            e[i, j] = 1e-6
            assert (loss(o + e, y)[0] - loss(o - e, y)[0]) / 2e-6 == pytest.approx(g[i, j], abs=1e-5)
    x = r.standard_normal((300, 6))
    y = np.clip(0.2 + 0.05 * x[:, 0] + r.normal(0, 0.02, 300), 0, 1)
    m = N.fit(x, {"y": y, "z": y}, {"y": "mdn", "z": "quantile"}, epochs=15)
    assert m.losses[-1] < m.losses[0]
    q = N.monotone(m.out(m.forward(x)[-1], "z"))
    assert (np.diff(q, axis=1) >= 0).all()
    assert np.allclose(N.Model.from_json(m.to_json()).out(x[:, :0] @ np.zeros((0, 64)), "z"), m.out(np.zeros((300, 64)), "z"))


def test_training_in_tasks_equals_the_driver(spark, monkeypatch):
    """All rows, one step an epoch: the driver's fit over one batch. Several steps: the same steps by hand. Whatever the partitions, and in two levels."""
    r = np.random.default_rng(6)
    x = r.standard_normal((200, 5))
    y = np.clip(0.3 + 0.1 * x[:, 0], 0, 1)
    heads = {"y": "mdn", "z": "quantile"}
    df = spark.createDataFrame([(k, v.tolist(), float(t), float(t) / 2) for k, (v, t) in enumerate(zip(x, y, strict=True))], "id bigint, x array<double>, y double, z double")
    want = N.fit(x, {"y": y, "z": y / 2}, heads, epochs=4, batch=len(x))
    got = N.train_all(df.repartition(3), heads, epochs=4)
    assert got.losses == pytest.approx(want.losses) and all(np.allclose(got.weights[k], w) for k, w in want.weights.items())

    classes = np.array([c.k for c in df.orderBy("id").select(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(3)).alias("k")).collect()])
    a = N.Adam(heads, N._sizes(5, heads, np.random.default_rng(0)), 1e-3, None)
    for _ in range(2):
        for k in range(3):
            own = classes == k
            a.move(N.gradients(a.model, x[own], {"y": y[own], "z": y[own] / 2})[1])
    monkeypatch.setattr(N, "MEET", 2)
    monkeypatch.setattr("sprintlens.operators.models.delete", lambda spark, path: None)
    state = {}
    kept = N.Checkpoint(lambda: state.get("s"), lambda text: state.update(s=text), 1)
    first = N.train_all(df.repartition(9), heads, epochs=1, steps=3, checkpoint=kept)
    assert len(first.losses) == 1
    got = N.train_all(df.repartition(2), heads, epochs=2, steps=3, checkpoint=kept)  # goes on after the first epoch
    assert all(np.allclose(got.weights[k], w) for k, w in a.w.items())
    assert len(N.train_all(df.limit(0), heads, epochs=2).losses) == 0


def test_code_features():
    v, edges = X.file_features("a.b", "import os\n", "import os\nfrom x import y\ndef f():\n    if g():\n        return h(1)\n")
    n = len(X.NODE_TYPES)
    after = dict(zip(X.NODE_TYPES, v[n : 2 * n], strict=True))
    assert (after["FunctionDef"], after["If"], after["Call"], after["Return"], after["ImportFrom"]) == (1, 1, 2, 1, 1)
    assert edges[2] == {("a.b", "os"), ("a.b", "x")} and edges[3] == {("a.b:f", "a.b:g"), ("a.b:f", "a.b:h")}
    assert X.file_features("m", "def (", "x = 1")[0][-4:] == [0, 0, 0, 0]


def test_edge_table(spark):
    """Edges as rows of a table function, and deltas from them, against the arrays that code_features counts."""
    code = ["import os\nfrom x.y import z\n", "def f():\n    g()\n    h.i()\n", "class A:\n    async def m(self):\n        g()\n        f()\n", "def (", ""]
    rows = [(k, "python" if k % 5 else "java", {"a/b.py": code[k % 5], "c.py": code[k // 5 % 5]}, {"a/b.py": code[(k + 1) % 5], "d.py": code[k // 7 % 5]} if k % 6 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "id bigint, language string, before_blobs map<string,string>, after_blobs map<string,string>")
    edges = X.change_edges(df)
    assert sorted(tuple(r)[1:] for r in edges.filter("id = 1").collect() if not r.is_after) == [("calls", False, "a.b:f", "a.b:g"), ("imports", False, "c", "os"), ("imports", False, "c", "x.y")]
    order = ["nodes_before", "edges_before", "nodes_after", "edges_after", "edges_added", "edges_removed", "nodes_added", "nodes_removed"]
    got = {(r.id, r.kind): [r[c] for c in order] for r in X.graph_deltas(edges).collect()}
    for r in X.code_features(df).collect():
        for kind, want in (("imports", r.graph[:8]), ("calls", r.graph[8:])):
            assert got.get((r.id, kind), [0] * 8) == list(want)
    assert X.graph_deltas(edges.limit(0)).count() == 0


def test_ml_pipeline_scores_as_the_stages(spark, tmp_path):
    """A saved PipelineModel, loaded again, gives what score_changes gives with its vocabulary and net; parameters and other columns stay."""
    code = lambda k: "import os\n" + "".join(f"def f{j}():\n    return g({j})\n" for j in range(k))
    rows = [(f"c{k}", "python" if k % 3 else "java", f"+def f{k % 4}(): return g({k})", {"m.py": code(k)}, {"m.py": code(k + 1)}, k / 40, k / 50, "own", "taken") for k in range(24)]
    df = spark.createDataFrame(rows, "commit_id string, language string, diff_text string, before_blobs map<string,string>, after_blobs map<string,string>, y double, z double, kept string, features string")
    for kind, sample in (("mdn", 0), ("multitask", 1000)):
        stages_ = [ML.TokenVectorizer(vocabSize=8, minDF=2), ML.CodeFeatures(), ML.Joined(), ML.EffortPredictor(kind=kind, epochs=2, steps=2, sample=sample)]
        fitted = Pipeline(stages=stages_).fit(df)
        fitted.write().overwrite().save(f"file://{tmp_path}/{kind}")
        Pipeline(stages=stages_).write().overwrite().save(f"file://{tmp_path}/{kind}-plan")
        loaded = PipelineModel.load(f"file://{tmp_path}/{kind}")
        assert [s.uid for s in loaded.stages] == [s.uid for s in fitted.stages] and loaded.stages[0].terms == fitted.stages[0].terms
        got = loaded.transform(df.drop("y", "z"))
        assert set(got.columns) == {*df.columns, "tokens", "code", "mean", "p50", "p90", "payload"} - {"y", "z"}
        net = loaded.stages[3].net
        want = stages.score_changes(df, loaded.stages[0]._vocabulary(spark), net, config.Config(features=config.Features(tokens_max_features=8)))
        tell = lambda d, key: sorted((r[key], r.mean, r.p50, r.p90, r.payload) for r in d.collect())
        assert tell(got, "commit_id") == tell(want, "id") and {r.kept for r in got.collect()} == {"own"}
        again = Pipeline.load(f"file://{tmp_path}/{kind}-plan")
        assert [s.uid for s in again.getStages()] == [s.uid for s in stages_] and again.getStages()[3].getOrDefault("epochs") == 2
        assert all(np.allclose(w, net.weights[k]) for k, w in again.fit(df).stages[3].net.weights.items())
    vocab, _ = stages.change_features(df, config.Config(features=config.Features(use_syntax=False, tokens_max_features=8)))
    assert {r.id: r.features for r in vocab.collect()} == {r.commit_id: r.tokens for r in got.collect()}
    with pytest.raises(ValueError):
        ML.EffortPredictor(kind="x").fit(got.withColumn("y", F.lit(0.5)))


def test_tables_are_dealt_evenly(spark, tmp_path):
    """Rows without an id, or with one and the same, don't gather in a task; only the columns that are used are read."""
    spark.range(1000).select(F.when(F.col("id") < 600, F.lit(None)).when(F.col("id") < 900, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"), F.lit("x").alias("more")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = T.spread_table(spark, str(tmp_path), "documents")
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert df.count() == 1000 and len(sizes) == 4 and max(sizes) < 330
    assert "ReadSchema: struct<text:string>" in df.select("text")._jdf.queryExecution().toString()


def test_tokens_and_languages(spark):
    df = spark.createDataFrame([("a===b1 <=x_2　é 7",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(S.tokens(F.col("text"))).collect()] == [["a", "==", "=", "b1", "<=", "x_2", "é", "7"], [], []]
    df = spark.createDataFrame([(["x.TS", "b.java"],), (["a.md", "z.PY"],), (["a.ts"],), ([],)], "f array<string>")
    got = df.select(S.language(F.col("f")), S.first_file_language(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [("java", "unknown"), ("python", "unknown"), ("javascript", "unknown"), ("unknown", "unknown")]
    assert [r[0] for r in spark.createDataFrame([("a/b/c.py",), ("x",)], "p string").select(S.module_name(F.col("p"))).collect()] == ["a.b.c", "x"]
    assert [r[0] for r in spark.createDataFrame([("a/b.lock",), ("b.py",)], "p string").filter(S.glob_condition(F.col("p"), ["*.lock"])).collect()] == ["a/b.lock"]


def test_grid_edges(spark):
    df = spark.sql("SELECT 1 AS author_id, cast(id AS bigint) AS commit_id, timestampadd(MINUTE, cast(id * 7 AS int), timestamp_ntz'2024-01-01 00:00:00') AS authored_at FROM range(60) UNION ALL SELECT 2, 99, timestamp_ntz'2024-01-01 00:00:00'")
    g = C.grids(df, 5).collect()
    assert [r.author_id for r in g] == [1] and sum(g[0].counts) == 60 and len(g[0].counts) == g[0].steps == math.ceil((59 * 7 + 1) / 5) + 1


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, H.upsert(base, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, H.insert_ignore(base, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_rest_pages_limits_and_milestones(spark):
    answers = [(403, {"Retry-After": "2"}, "API rate limit"), (200, {}, [1])]
    waits = []
    assert rest.get(lambda u, p: answers.pop(0), "u", {}, sleep=waits.append) == [1] and waits == [2.0]
    with pytest.raises(rest.ApiError):
        rest.get(lambda u, p: (500, {}, ""), "u", {})
    pages = rest.Fixtures({"/repos/a/b/pulls": [{"number": k, "updated_at": f"2024-01-{k:02d}T00:00:00Z"} for k in range(7, 0, -1)], "/repos/a/b/milestones": [{"number": 2, "title": "S2", "due_on": "2024-03-01T00:00:00Z"}, {"number": 1, "title": "S1", "due_on": "2024-02-01T00:00:00Z"}]})
    assert len(list(rest.paginate(pages, "/repos/a/b/pulls", per_page=3))) == 7
    with pytest.raises(rest.ApiError):  # rows beyond the allowed pages are never left out in silence
        list(rest.paginate(pages, "/repos/a/b/pulls", per_page=3, max_pages=2))
    assert sorted(r.number for r in rest.pull_list(spark, ["a/b"], pages, since="2024-01-05T02:00:00+02:00").collect()) == [5, 6, 7]
    asked = []
    list(rest.paginate(lambda u, p: (asked.append(p["page"]), pages(u, p))[1], "/repos/a/b/pulls", per_page=2, stop=lambda r: r["number"] < 5))
    assert asked == [1, 2]  # a descending scan ends early
    posted = rest.Fixtures({"/graphql": {"data": {"repository": {"id": "R1"}}}, "/p1/repositories/5/board": {"pipelines": []}})
    assert rest.graphql(posted, "query { x }", {"a": 1}) == {"repository": {"id": "R1"}} and rest.tracker_resource(posted, 5, "board") == {"pipelines": []}
    with pytest.raises(rest.ApiError):
        rest.graphql(lambda u, p: (200, {}, {"errors": ["no"]}), "query { x }")
    m = rest.current_milestones(spark, ["a/b"], pages, "S").first()
    assert (m.sprint_id, str(m.start_date), m.length_days) == ("a/b#milestone-1", "2024-01-22", 11)


def _counted(rows, path):
    """Fixtures that write down what is asked; in a file, as tasks ask too."""
    inner = rest.Fixtures(rows)

    def ask(url, params):
        with open(path, "a") as f:
            f.write(f"{url} {params.get('page', '')}\n")
        return inner(url, params)

    return ask


def test_paged_lists_as_a_source(spark, tmp_path):
    """Pages as partitions, the bound on time pushed into planning: of a long list only the new end is asked for."""
    row = lambda k: {"number": k, "updated_at": (dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)).isoformat() + "Z"}
    rows, asked = {"/a": [row(k) for k in range(999, -1, -1)], "/b": [row(5)], "/c": []}, tmp_path / "asked"
    lists = [("a", "/a", {}), ("b", "/b", {}), ("c", "/c", {})]
    df = paged.paged(spark, lists, _counted(rows, str(asked)), per_page=10, span=4)
    assert df.rdd.getNumPartitions() == 26 and sorted(r.key for r in df.select("key").distinct().collect()) == ["a", "b"]
    assert df.count() == 1001
    for since, want, most in ((dt.datetime(2024, 2, 11, 8), 8, 14), (dt.datetime(2024, 1, 1, 4), 997, 130), (dt.datetime(2030, 1, 1), 0, 14)):
        asked.write_text("")
        new = df.filter(F.col("updated_at") >= F.lit(since))
        assert len(new.collect()) == want and len(asked.read_text().split("\n")) <= most
    plan = df.filter(F.col("updated_at") >= F.lit(dt.datetime(2024, 2, 1)))._jdf.queryExecution().executedPlan().toString()
    assert "updated_at" in plan.split("PushedFilters")[-1] if "PushedFilters" in plan else True
    untold = paged.paged(spark, [("a", "/a", {})], lambda u, p: (200, {}, rows[u][(p["page"] - 1) * p["per_page"] : p["page"] * p["per_page"]]), per_page=10)
    assert untold.rdd.getNumPartitions() == 1 and untold.count() == 1000  # a service that doesn't tell its last page


def test_pulls_are_followed_as_a_stream(spark, tmp_path):
    """The offset is the last update: a later trigger, by another stream of the checkpoint, asks for what is new only."""
    pull = lambda k, day, title: {"number": k, "id": k, "title": title, "updated_at": f"2024-03-{day:02d}T00:00:00Z", "created_at": "2024-01-01T00:00:00Z"}
    rows = {}

    def serve(*pulls):
        rows["/repos/a/b/pulls"] = sorted(pulls, key=lambda p: p["updated_at"], reverse=True)
        for p in pulls:
            rows[f"/repos/a/b/pulls/{p['number']}"] = p
            rows[f"/repos/a/b/pulls/{p['number']}/commits"] = [{"sha": f"s{p['number']}"}]

    store, asked = ingest.Store(spark, str(tmp_path / "store")), tmp_path / "asked"
    follow = lambda: ingest.follow_pulls(store, ["a/b"], _counted(rows, str(asked)), str(tmp_path / "follow"), since="2024-03-02T00:00:00Z", reviews=False)
    have = lambda: {r.number: r.title for r in store.pulls.read().collect()}
    serve(pull(1, 1, "old"), pull(2, 2, "two"), pull(3, 3, "three"))
    follow()
    assert have() == {2: "two", 3: "three"}
    asked.write_text("")
    follow()
    assert have() == {2: "two", 3: "three"} and not any("/pulls/" in x for x in asked.read_text().split("\n"))
    serve(pull(1, 1, "old"), pull(2, 9, "again"), pull(3, 3, "three"), pull(4, 8, "four"))
    follow()
    assert have() == {2: "again", 3: "three", 4: "four"} and "/repos/a/b/pulls/1 " not in asked.read_text()
    assert {(r.pr_number, r.sha) for r in store.commits.read().collect()} == {(2, "s2"), (3, "s3"), (4, "s4")}


def test_files(spark, tmp_path):
    (tmp_path / "prs.json").write_text(json.dumps([{"pr_id": "1", "repo": "r", "author_id": "a", "opened_at": "2024-01-01T00:00:00Z", "merged_at": "2024-01-02T06:00:00Z", "commits": ["x"]}, {"repo": "r"}]))
    prs = files.pull_requests(spark, str(tmp_path / "prs.json"))
    assert [(r.pr_id, r.review_rounds) for r in prs.collect()] == [("1", 0)]
    (tmp_path / "h.json").write_text(json.dumps([{"sprint_id": "a", "done_effort_hours": 10, "workdays": 0}, {"sprint_id": "b", "done_effort_hours": 10, "workdays": 5}]))
    samples = lambda *a: sorted(r.x for r in files.throughput_samples(spark, *a).collect())
    assert samples(str(tmp_path / "h.json")) == list(M.DEFAULT_THROUGHPUT) == samples()
    (tmp_path / "h.json").write_text(json.dumps([{"sprint_id": str(k), "done_effort_hours": k, "workdays": 5} for k in range(1, 20_001)]))
    assert samples(str(tmp_path / "h.json"))[-1] == 4000.0 and len(samples(str(tmp_path / "h.json"))) == 20_000
    (tmp_path / "t.json").write_text(json.dumps({"throughput_samples_sch_per_day": [3.0, 1.0]}))
    assert samples(None, str(tmp_path / "t.json")) == [1.0, 3.0]


def test_config(spark, tmp_path):
    p = tmp_path / "c.toml"
    config.write_default(str(p))
    assert config.Config.load(str(p)) == config.Config()
    with pytest.raises(FileExistsError):
        config.write_default(str(p))
    p.write_text("[filters.languages]\ninclude = ['toml']\n")
    with pytest.raises(ValueError):
        config.Config.load(str(p))
    for path in (str(tmp_path / "s" / "state.json"), f"file://{tmp_path}/t/state.json"):
        assert not stages.RunState(spark, path).stages
        s = stages.RunState(spark, path)
        s.mark("mine", "fp0")
        s.mark("mine", "fp1")
        again = stages.RunState(spark, path)
        assert again.done("mine", "fp1") and not again.done("mine", "fp2")
    storage.write_text(spark, path, "not json")
    again = stages.RunState(spark, path)
    assert not again.stages and storage.read_text(spark, path) == "not json" and storage.names(spark, f"file://{tmp_path}/t") == ["state.json"]
    r = config.Repos(include_paths=["a", "b"], more_include_paths=["b", "c"], include_remote=["x/y", "bad", "x/z"], exclude_remote=["*/z"])
    assert r.paths() == ["a", "b", "c"] and r.remotes() == ["x/y"]


def test_pipeline_over_a_repository(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    env = {**os.environ, "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a|b@x", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@x"}

    def run(*args, **more):
        subprocess.run(["git", *args], cwd=repo, env={**env, **more}, check=True, capture_output=True)

    run("init", "-q")
    for k in range(12):
        (repo / "m.py").write_text("import os\n" + "".join(f"def f{j}():\n    return g({j})\n" for j in range(k + 1)))
        run("add", "-A")
        at = f"2024-01-01T{8 + k // 4:02d}:{k % 4 * 15:02d}:00+0000"
        run("commit", "-qm", f"c{k}", GIT_AUTHOR_DATE=at, GIT_COMMITTER_DATE=at)
    (tmp_path / "sprint.json").write_text(
        json.dumps({"sprint": {"sprint_id": "S 1", "start_date": "2025-01-06", "length_days": 5, "working_days": [0, 1, 2, 3, 4]}, "capacity": [{"person_id": "p", "day": "2025-01-06", "delta_available_sch": -20.0}], "work_items": [{"work_item_id": "A", "status": "todo", "scope_factor": 1.0, "effort": {"type": "quantiles", "quantiles": {"0.5": 2, "0.9": 4}}}, {"work_item_id": "B", "status": "done"}, {"work_item_id": "C", "story_points": 0.01}, {"work_item_id": "D", "effort": {"type": "gmm", "weights": [1.0], "means": [0.5], "stds": [0.1], "low": 0.0, "high": 1.0}}]})
    )
    subprocess.run(["git", "clone", "-q", str(repo), str(tmp_path / "fork")], check=True)
    c = config.Config(
        repos=config.Repos(include_paths=[str(tmp_path / "*")]), outputs=config.Outputs(str(tmp_path / "out")), curves=config.Curves(min_commits_per_author=5), training=config.Training(label_samples_per_commit=3, epochs=2),
        forecasting=config.Forecasting(n_sims=100, sprint_inputs_path=str(tmp_path / "sprint.json")),
    )
    p = stages.Pipeline(spark, c)
    assert p.run() == list(stages.STAGES) and p.run() == []
    # a fork's commits are changes of their own: 24 of them, 23 pairs of one author
    assert p.read("mine", "commits").count() == 24 and p.read("train", "rows").count() == 69
    counts = p.read("train", "features").groupBy("features").count().collect()
    assert sum(r["count"] for r in counts) == 24 and all(r["count"] % 2 == 0 for r in counts)
    changes = {r.sha: r for r in p.read("train", "changes").collect()}
    second = changes[git.git("rev-parse", "HEAD~10", cwd=str(repo)).strip()]
    assert second.diff_text == git.git("show", "--unified=0", "--format=", second.sha, cwd=str(repo)).lstrip("\n")
    assert second.before_blobs["m.py"] == git.git("show", f"{second.sha}^:m.py", cwd=str(repo)) and second.after_blobs["m.py"].count("def ") == 2
    first = changes[git.git("rev-parse", "HEAD~11", cwd=str(repo)).strip()]
    assert first.before_blobs == {"m.py": ""} and first.after_blobs["m.py"].count("def ") == 1
    with git.Blobs(str(repo)) as blobs:
        assert [len(blobs.text(x)) > 0 for x in ("HEAD:m.py", "HEAD:none", "HEAD:", "HEAD~1:m.py", "not a name", "HEAD:m.py")] == [True, False, False, True, False, True]
    assert list(git.diffs(str(repo), ["f" * 40, second.sha])) == [(second.sha, second.diff_text)]
    s = stages.score(p.read("train", "rows").select("id", "x"), p.model()).collect()
    assert all(0 <= r.p50 <= r.p90 <= 1 for r in s)
    asked = spark.createDataFrame([("new", "python", "+def f(): return g(1)", {"m.py": ""}, {"m.py": "def f(): return g(1)"})], "commit_id string, language string, diff_text string, before_blobs map<string,string>, after_blobs map<string,string>")
    r = p.score(asked).first()
    assert 0 <= r.mean <= 1 and json.loads(r.payload)["type"] == "gmm"
    meta = json.loads(storage.read_text(spark, p.path("train", "metadata.json")))
    assert meta["epochs"] == 2 and meta["rejects"] == 0
    lost = git.with_changes(spark.createDataFrame([(str(repo), "f" * 40, None, ["m.py"]), (str(repo), second.sha, None, [])], "repo_path string, commit_id string, parent_id string, changed_files array<string>"), True)
    assert {r.commit_id: r.readable for r in lost.collect()} == {"f" * 40: False, second.sha: True}
    f = spark.read.json(p.path("forecast", "forecasts")).first()
    assert f["p_by_day"][0] == 0.0 and len(f["p_by_day"]) == 5 and f["p_end"] == 1.0
    with pytest.raises(ValueError):
        p.run(("nonsense",))


def _histories(spark, sizes):
    rows = [(a, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=17 * k)) for a, n in sizes.items() for k in range(n)]
    return spark.createDataFrame(rows, "author_id bigint, authored_at timestamp_ntz")


@pytest.mark.parametrize("kind,options", [("state_space", {}), ("hawkes", {"iterations": 5}), ("hmm", {"epochs": 2})])
def test_fits_by_author(spark, tmp_path, kind, options):
    """A changed history refits its own author; fits of others, of other settings and of other places are told apart."""
    grid = lambda **sizes: C.grids(_histories(spark, {int(k[1:]): n for k, n in sizes.items()}), 30, 5, 0 if kind == "hmm" else 1)
    fits = AuthorFits(spark, str(tmp_path / "fits"), kind, 30, **options)
    first = grid(a1=20, a2=30, a3=40, a4=3)
    assert fits.fit(first) == 3 and fits.fit(first) == 0
    second = grid(a1=20, a2=31, a3=40, a4=6)
    assert sorted(r.author_id for r in fits.missing(second).collect()) == [2, 4]
    assert fits.fit(second) == 2 and fits.saved().count() == 5
    whole = {r.author_id: r for r in (C.filtered(second, 30) if kind == "state_space" else C.fitted(second, kind, 30, **options)).collect()}
    got = {r.author_id: r for r in fits.curves(second).collect()}
    assert got.keys() == whole.keys() == {1, 2, 3, 4}
    for a, r in got.items():
        assert r.coding_prob == pytest.approx(whole[a].coding_prob) and (r.model_version, r.step_minutes) == (kind, 30)
    # the old history's fit is still there, should it come back
    assert fits.fit(first) == 0 and fits.curves(first).count() == 3
    other = AuthorFits(spark, str(tmp_path / "other"), kind, 30, **options)
    fits.saved().write.parquet(str(tmp_path / "export"))
    other.take(spark.read.parquet(str(tmp_path / "export")))
    other.take(spark.read.parquet(str(tmp_path / "export")))
    assert other.fit(second) == 0 and other.curves(second).count() == 4
    changed = AuthorFits(spark, str(tmp_path / "other"), kind, 30, **{k: v + 1 for k, v in options.items()}, **({"process_var": 0.1} if not options else {}))
    assert changed.missing(second).count() == 4
    with pytest.raises(ValueError):
        other.take(spark.range(1))


def test_fits_that_break_off_go_on(spark, tmp_path, monkeypatch):
    """Chunks that were whole stay; the next run fits the rest. Superseded fits go when parts are gathered."""
    grid = C.grids(_histories(spark, {a: 10 + a for a in range(40)}), 30, 5)
    fits = AuthorFits(spark, str(tmp_path / "fits"), "state_space", 30, chunk=10)
    append, left = fits._append, [2]

    def failing(df):
        if not left[0]:
            raise ZeroDivisionError
        left[0] -= 1
        append(df)

    fits._append = failing
    with pytest.raises(ZeroDivisionError):
        fits.fit(grid)
    again = AuthorFits(spark, str(tmp_path / "fits"), "state_space", 30, chunk=10)
    done = again.saved().count()
    assert 0 < done < 40 and again.fit(grid) == 40 - done and again.curves(grid).count() == 40
    monkeypatch.setattr("sprintlens.operators.fits.PARTS", 1)
    grown = C.grids(_histories(spark, {a: 11 + a for a in range(40)}), 30, 5)
    assert again.fit(grown) == 40 and len(again._parts()) == 1 and again.saved().count() == 40
    empty = AuthorFits(spark, str(tmp_path / "none"), "state_space", 30)
    assert empty.fit(grid.limit(0)) == 0 and empty.curves(grid).count() == 0


def test_infer_fits_changed_authors_only(spark, tmp_path):
    """After one author's new commit, mining and inferring again fit one author."""
    repo = tmp_path / "repo"
    repo.mkdir()

    def commit(k, author):
        at = f"2024-01-01T{8 + k // 4:02d}:{k % 4 * 15:02d}:00+0000"
        env = {**os.environ, "GIT_AUTHOR_NAME": author, "GIT_AUTHOR_EMAIL": f"{author}@x", "GIT_COMMITTER_NAME": "c", "GIT_COMMITTER_EMAIL": "c@x", "GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at}
        (repo / "m.py").write_text(f"x = {k}\n")
        for args in (["add", "-A"], ["commit", "-qm", f"c{k}"]):
            subprocess.run(["git", *args], cwd=repo, env=env, check=True, capture_output=True)

    subprocess.run(["git", "init", "-q"], cwd=repo, check=True, capture_output=True)
    for k in range(18):
        commit(k, "abc"[k % 3])
    c = config.Config(repos=config.Repos(include_paths=[str(repo)]), outputs=config.Outputs(str(tmp_path / "out")), curves=config.Curves(min_commits_per_author=5, kind="state_space"))
    p = stages.Pipeline(spark, c)
    meta = lambda: {k: v for k, v in stages.RunState(spark, f"{p.base}/checkpoints/state.json").stages["infer"]["meta"].items() if k in ("authors", "fitted")}
    assert p.run(("mine", "infer")) == ["mine", "infer"] and meta() == {"authors": 3, "fitted": 3}
    before = {r.author_id: r.coding_prob for r in p.read("infer", "curves").collect()}
    commit(18, "a")
    assert p.run(("mine", "infer")) == []
    assert p.run(("mine", "infer"), again=True) == ["mine", "infer"] and meta() == {"authors": 3, "fitted": 1}
    after = {r.author_id: r.coding_prob for r in p.read("infer", "curves").collect()}
    assert before.keys() == after.keys() and sum(before[a] != after[a] for a in before) == 1
    # other settings fit all authors
    q = stages.Pipeline(spark, dataclasses.replace(c, curves=dataclasses.replace(c.curves, step_minutes=10)))
    assert q.run(("infer",)) == ["infer"] and meta() == {"authors": 3, "fitted": 3}


def test_history_in_ranges(spark, tmp_path):
    """Ranges of commits, merges and odd texts included, give what one pass gives, each commit once; changes flow in small batches."""
    repo = tmp_path / "repo"
    repo.mkdir()
    run = lambda *a, stdin=None: subprocess.run(["git", *a], cwd=repo, check=True, capture_output=True, input=stdin)
    run("init", "-q", "-b", "main")
    text, marks = [], 0
    for k in range(1500):  # one stream for git: a line of history with a branch that is merged back
        branch, merge = ("side" if 500 <= k < 700 and k % 3 == 0 else "main"), b""
        if k == 700:
            merge = b"merge refs/heads/side\n"
        body = f"x = {k}\n# \x1e \x1f commit-{'0' * 32} \u00e9\n".encode()
        start = b"from :501\n" if k == 501 else b""
        text.append(f"commit refs/heads/{branch}\nmark :{k + 1}\nauthor A <a{k % 7}@x> {1700000000 + 60 * k} +0000\ncommitter A <a@x> {1700000000 + 60 * k} +0000\ndata 2\nm\n".encode() + start + merge + f"M 100644 inline d{k % 5}/f{k % 11}.py\ndata {len(body)}\n".encode() + body + b"\n")
    run("fast-import", "--quiet", stdin=b"".join(text))
    whole = {r.commit_id: r for r in git.mined_commits(spark, [str(repo)]).collect()}
    df = git.mined_commits(spark, [str(repo)], commits_a_task=100)
    assert df.rdd.getNumPartitions() == 15
    got = df.collect()
    assert len(got) == len(whole) == 1500 and {r.commit_id: r for r in got} == whole
    newest = git.mined_commits(spark, [str(repo)], 250, 100)
    log = git.git("rev-list", "-n250", "HEAD", cwd=str(repo)).split()
    assert sorted(r.commit_id for r in newest.collect()) == sorted(log) and newest.rdd.getNumPartitions() == 3
    some = df.filter(F.col("commit_id").isin(log[:60])).withColumn("changed_files", F.concat("changed_files", F.array(F.lit("no/such.py"))))
    fine = {r.commit_id: r for r in git.with_changes(git.in_ranges(some, 20), True, most=50).collect()}
    assert fine == {r.commit_id: r for r in git.with_changes(some, True).collect()} and len(fine) == 60
    for sha, r in fine.items():
        assert r.diff_text == git.git("show", "--unified=0", "--format=", sha, cwd=str(repo)).lstrip("\n") and r.after_blobs["no/such.py"] == "" and r.readable
        for name in whole[sha].changed_files:
            assert r.after_blobs[name] == git.git("show", f"{sha}:{name}", cwd=str(repo))
    (tmp_path / "empty").mkdir()
    subprocess.run(["git", "init", "-q"], cwd=tmp_path / "empty", check=True)
    assert git.mined_commits(spark, [str(tmp_path / "empty"), str(repo)]).count() == 1500
    with pytest.raises(git.GitError), git.piped("log", "nowhere", cwd=str(repo)) as stream:
        list(git.records(stream, b"x"))


def test_records_of_a_stream():
    import io

    data = b"head|one||two|" + b"x" * 100
    for size in (1, 2, 3, 64, 1000):
        assert list(git.records(io.BytesIO(data), b"|", size)) == [b"one", b"", b"two", b"x" * 100]
        assert list(git.records(io.BytesIO(b"a<>b<>"), b"<>", size)) == [b"b", b""] and list(git.records(io.BytesIO(b""), b"x", size)) == []


def test_keyed_table(spark, tmp_path, monkeypatch):
    """Upserts and insertions bucket by bucket; a write that dies counts whole or not at all."""
    from sprintlens.sources.sinks import KeyedTable

    schema, keys, path = "repo string, number int, state string", ["repo", "number"], tmp_path / "t"
    t = KeyedTable(spark, str(path), schema, keys)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    have = lambda t: sorted(map(tuple, t.read().collect()))
    assert t.read().count() == 0
    t.upsert(rows(("a", 1, "open"), ("a", 2, "open"), ("a", 2, "later")))
    t.upsert(rows(("a", 2, "closed"), ("b", 1, "open")))
    t.insert_ignore(rows(("a", 1, "late"), ("c", 1, "new"), ("c", 1, "newer")))
    t.insert_ignore(rows().limit(0))
    want = [("a", 1, "open"), ("a", 2, "closed"), ("b", 1, "open"), ("c", 1, "new")]
    assert have(t) == want and sorted(storage.names(spark, str(path))) == ["buckets", "rows"]
    t.insert_ignore(spark.range(500).select(F.lit("many").alias("repo"), F.col("id").cast("int").alias("number"), F.lit("x").alias("state")))

    # one row touches one bucket's files
    files_ = lambda: {str(f): (f.stat().st_mtime_ns, f.stat().st_size) for f in (path / "rows").rglob("*.parquet")}
    before = files_()
    t.upsert(rows(("a", 1, "shut")))
    after = files_()
    gone, new = before.keys() - after.keys(), after.keys() - before.keys()
    assert len(before) == 64 and {os.path.dirname(f) for f in gone} == {os.path.dirname(f) for f in new} and len(new) == 1
    assert all(after[f] == before[f] for f in before.keys() & after.keys())

    # dying before the new buckets are whole, after, and half-way through putting them in place
    t = KeyedTable(spark, str(path), schema, keys, buckets=7)
    assert t.buckets == 64  # those of the table
    whole = have(t)
    apply = KeyedTable._apply
    calls = []

    def dies(self):
        calls.append(1)
        if len(calls) > 1:
            raise ZeroDivisionError
        apply(self)

    monkeypatch.setattr(KeyedTable, "_apply", dies)
    with pytest.raises(ZeroDivisionError):
        t.upsert(rows(("a", 1, "dead"), ("z", 1, "new")))
    monkeypatch.setattr(KeyedTable, "_apply", apply)
    grown = sorted([r for r in whole if r[:2] != ("a", 1)] + [("a", 1, "dead"), ("z", 1, "new")])
    assert have(t) == grown
    for b in t._staged()[:1]:  # the old bucket is gone, the new one isn't there yet
        storage.delete(spark, f"{path}/rows/bucket={b}")
    assert have(t) == grown
    t.upsert(rows(("y", 1, "next")))
    assert have(t) == sorted([*grown, ("y", 1, "next")]) and sorted(storage.names(spark, str(path))) == ["buckets", "rows"]
    (path / "staged").mkdir()
    (path / "staged" / "bucket=1").mkdir()  # what isn't whole doesn't count
    assert have(t) == sorted([*grown, ("y", 1, "next")])
    t.upsert(rows(("y", 1, "last")))
    assert have(t) == sorted([*grown, ("y", 1, "last")])


def test_bus_states_efforts_and_forecasts(spark, tmp_path):
    """Batches against one fold over all events: items, capacities, efforts; subscribers, forecasts of touched sprints only."""
    rng = random.Random(11)
    rows = [{**e, "day": dt.date(2025, 1, 6 + rng.randrange(3))} for e in _events(rng, 160)]
    df = spark.createDataFrame([Row(**r) for r in rows], EVENT)
    q = json.dumps({"type": "quantiles", "quantiles": {"0.5": 1.0, "0.9": 2.0}})
    efforts = [(200, "effort", 3, q, "v1"), (201, "effort", 3, json.dumps({"type": "gmm", "weights": [1.0], "means": [2.0], "stds": [0.5]}), "v2"), (202, "effort", 4, "{broken", "v1"), (203, "effort", 5, json.dumps({"type": "x"}), "v1"), (204, "invalidated", 3, None, None)]
    store, seen = bus.SprintStore(spark, str(tmp_path / "bus"), {"samples": (2.0, 3.0), "n_sims": 20, "seed": 1}), []
    store.subscribe("status", lambda e, k: seen.append((k, e.count())))
    store.subscribe("added", lambda e, k: 1 / 0)
    store.subscribe("forecast", lambda e, k: seen.append(("forecast", e.count())))
    for k in range(0, 160, 80):
        store.publish(df.filter((F.col("seq") >= k) & (F.col("seq") < k + 80)))
    state, caps = {}, {}
    for e in rows:
        bus.step(state, e)
        if e["type"] == "configured":
            caps[e["sprint_id"]] = {}
        elif e["type"] == "availability":
            for c in caps.values():
                c[e["day"]] = max(0.0, c.get(e["day"], 8.0) + e["delta"])
    want = {(s, i): tuple(v) for s, items in state.items() for i, v in items.items()}
    assert {(r.sprint_id, r.item_id): (r.status, r.factor) for r in store.current().collect()} == want
    assert {(int(r.sprint_id), r.day): r.available for r in store.state("caps").collect()} == {(s, d): x for s, c in caps.items() for d, x in c.items()}
    assert {(r.sprint_id, r.day): r.available for r in P.capacity(df).collect()} == {(s, d): x for s, c in caps.items() for d, x in c.items()}
    assert [x for x in seen if x[0] != "forecast"] == [(b, sum(e["type"] == "status" and b * 80 <= e["seq"] < b * 80 + 80 for e in rows)) for b in (0, 1)]
    assert store.computed().count() == len(state)
    n = len([x for x in seen if x[0] == "forecast"])
    store.publish(spark.createDataFrame(efforts, "seq bigint, type string, item_id bigint, payload string, model_version string"))
    assert [(r.item_id, r.payload.type, r.seq) for r in store.state("effort").collect()] == [("3", "gmm", 201)]
    held = {s for (s, i) in want if i in ("3", "4", "5")}
    assert {r.sprint_id for r in spark.read.parquet(str(tmp_path / "bus" / "touched" / "2")).collect()} == held
    assert len([x for x in seen if x[0] == "forecast"]) == n + 1 and {(int(r.sprint_id), r.day): r.available for r in store.state("caps").collect()} == {(s, d): x for s, c in caps.items() for d, x in c.items()}


def test_ingested_pulls_and_labels_from_the_store(spark, tmp_path):
    pulls = [{"number": k, "updated_at": f"2024-02-0{k}T00:00:00Z"} for k in (4, 3, 2, 1)]
    rows = {"/repos/a/b/pulls": pulls}
    for k in (1, 2, 3, 4):
        rows[f"/repos/a/b/pulls/{k}"] = {"number": k, "id": 100 + k if k != 3 else 0, "user": {"login": "u"} if k != 2 else None, "created_at": f"2024-02-0{k}T00:00:00Z" if k != 4 else "", "merged_at": "2024-02-05T00:00:00Z" if k == 2 else None, "updated_at": f"2024-02-0{k}T00:00:00Z", "review_comments": k}
        rows[f"/repos/a/b/pulls/{k}/commits"] = [{"sha": f"s{k}"}, {"sha": " s9 "}, {"sha": ""}, {}]
        rows[f"/repos/a/b/pulls/{k}/reviews"] = [{"id": 7, "state": "A", "user": None}, {"id": 0}, {"id": 8}]
    store = ingest.Store(spark, str(tmp_path / "store"))
    assert ingest.ingest_pulls(store, ["a/b"], rest.Fixtures(rows), since="2024-02-02T00:00:00Z") == 3
    assert sorted((r.pr_number, r.sha) for r in store.commits.read().collect()) == [(2, "s2"), (2, "s9"), (3, "s3"), (3, "s9"), (4, "s4"), (4, "s9")]
    assert store.reviews.read().count() == 6
    rows["/repos/a/b/pulls/2"]["title"] = "new"
    assert ingest.ingest_pulls(store, ["a/b"], rest.Fixtures(rows)) == 4  # again, and one more
    assert {r.number: r.title for r in store.pulls.read().collect()} == {1: None, 2: "new", 3: None, 4: None} and store.commits.read().count() == 8
    prs = {r.pr_id: r for r in ingest.stored_prs(store).collect()}
    assert prs.keys() == {"101", "102", "a/b#3"}  # without a creation time there is no PR
    assert prs["102"].commits == ["s2", "s9"] and prs["102"].review_rounds == 2 and prs["102"].author_id == "" and prs["102"].metadata == {"pr_number": "2"}
    assert {r.sha: r.pr_id for r in files.pr_by_commit(ingest.stored_prs(store)).collect()}["s2"] == "102"
    # a merged PR raises its commit's label
    pairs = spark.createDataFrame([(1, "c2", "s2", 100, 130, 30), (1, "c0", "s0", 130, 160, 30)], "author_id bigint, commit_id string, sha string, parent_minute bigint, child_minute bigint, gap_minutes bigint")
    curves = C.with_sums(spark.createDataFrame([(1, 100, [1.0] * 20)], "author_id bigint, base_minute bigint, coding_prob array<double>"))
    x = spark.createDataFrame([("c2", [0.0]), ("c0", [1.0])], "id string, features array<float>")
    got = {r.commit_id: (r.y, r.z) for r in stages.training_rows(pairs, curves, x, 1, 1, 5, ingest.stored_prs(store)).collect()}
    assert got["c0"] == (0.5, 0.5) and got["c2"][0] == 0.5 and got["c2"][1] > 0.6


def test_backlog_of_the_tracker_is_forecast(spark, tmp_path):
    hosting = rest.Fixtures({
        "/repos/a/b": {"id": 5}, "/repos/c/d": {"id": 6}, "/repos/c/d/milestones": [{"number": 1, "title": "other", "due_on": None}],
        "/repos/a/b/milestones": [{"number": 3, "title": "S3", "due_on": "2025-01-17T00:00:00Z"}, {"number": 4, "title": "S4", "due_on": "2025-02-17T00:00:00Z"}],
        "/repos/a/b/issues": [{"number": 11}, {"number": 12, "pull_request": {}}, {"number": 13}, {"number": 13}, {"number": 14}],
    })
    tracker = rest.Fixtures({"/p1/repositories/5/issues/11": {"estimate": {"value": 0.1}, "pipeline": {"name": "doing"}, "is_epic": True}, "/p1/repositories/5/issues/13": {}})
    c = config.Config(repos=config.Repos(source="remote", include_remote=["a/b", "c/d"]), hosting=config.Hosting(base_url=""), tracker=config.Tracker(enabled=True, title_prefix="S"), outputs=config.Outputs(f"file://{tmp_path}/out"), forecasting=config.Forecasting(n_sims=200))
    p = stages.Pipeline(spark, c, hosting, tracker)
    assert p.run(("forecast",)) == ["forecast"] and p.run(("forecast",)) == []
    assert {r.issue_number: (r.estimate_value, r.pipeline_name, r.is_epic) for r in p.store.issues.read().collect()} == {11: (0.1, "doing", True), 13: (None, None, False), 14: (None, None, False)}
    assert [(r.repo, r.milestone_id, str(r.start_date)) for r in p.store.milestones.read().collect()] == [("a/b", 3, "2025-01-07")]
    f = spark.read.json(p.path("forecast", "forecasts")).collect()
    assert [r.sprint_id for r in f] == ["a/b#milestone-3"] and len(f[0].p_by_day) == 11 and 0 < f[0].p_end <= 1


def test_sprints_have_their_own_length_days_and_efforts(spark):
    conf = spark.createDataFrame([("A", dt.date(2025, 1, 6), 3, [0, 1, 2]), ("B", dt.date(2025, 1, 6), 7, [5]), ("C", dt.date(2025, 1, 6), None, None)], "sprint_id string, start_day date, length_days int, working_days array<int>")
    caps = spark.createDataFrame([], "sprint_id string, day date, available double")
    e = lambda kind, **k: json.dumps({"type": kind, **k})
    items = [("A", "x", e("gmm", weights=[1.0], means=[5.0], stds=[1e-9])), ("B", "y", e("quantiles", quantiles={"0.5": 3.0, "0.9": 3.0})), ("C", "z", e("quantiles", quantiles={"0.5": 3.0, "0.9": 1.0}))]
    items = spark.createDataFrame([(s, i, "todo", 1.0, b) for s, i, b in items], "sprint_id string, item_id string, status string, factor double, body string").withColumn("effort", D.decoded(F.col("body")))
    samples = spark.createDataFrame([(4.0,)] * 3, "x double")
    got = {(r.scenario, r.sprint_id): r for r in M.sprint_forecasts(items, conf, caps, samples, 50, 1).collect()}
    assert got["baseline", "A"].p_by_day == [0.0, 1.0, 1.0] and got["baseline", "B"].p_by_day == [0.0] * 5 + [1.0] * 2 and len(got["baseline", "C"].p_by_day) == 10
    assert 0 < got["baseline", "C"].p_by_day[0] < 1  # not a distribution: drawn as an unknown effort
    prior = M.fitted_throughput(spark.createDataFrame([(4.0,), (4.0,)], "x double"))
    assert prior.scale == pytest.approx(4.0) and prior.sigma == 0.0
    assert [r.p_by_day for r in M.sprint_forecasts(items.filter("sprint_id = 'A'"), conf.filter("sprint_id = 'A'"), caps, prior, 20, 1).collect()] == [[0.0, 1.0, 1.0]]
    two = {"more": (lambda i: P.scope_growth(i, 3.0), lambda c: c), "off": (lambda i: i, lambda c: P.time_off(c, -8.0, P.on_days([dt.date(2025, 1, 6)])))}
    got = {(r.scenario, r.sprint_id): r for r in M.sprint_forecasts(items, conf, caps, (4.0,), 50, 1, two).collect()}
    assert {s for s, _ in got} == {"more", "off"} and got["more", "A"].p_end == 0.0 and got["off", "A"].p_by_day == [0.0, 1.0, 1.0]  # a day without a row keeps its default


def _hmm_loop(y, s, e, c, eps=1e-6):
    """One chain, step by step."""
    n = len(y)
    b = np.array([[c if v > 0 else 1 - c, eps if v > 0 else 1 - eps] for v in y])
    a = np.array([[[1 - e[t], e[t]], [s[t], 1 - s[t]]] for t in range(n)])
    f, scale, back = np.empty((n, 2)), np.empty(n), np.ones((n, 2))
    for t in range(n):
        f[t] = (np.full(2, 0.5) if t == 0 else f[t - 1] @ a[t - 1]) * b[t]
        scale[t] = f[t].sum()
        f[t] /= scale[t]
    for t in range(n - 2, -1, -1):
        back[t] = a[t] @ (b[t + 1] * back[t + 1]) / scale[t + 1]
    moves = np.array([f[t][:, None] * a[t] * (b[t + 1] * back[t + 1])[None] / scale[t + 1] for t in range(n - 1)]).reshape(-1, 2, 2)
    return np.log(scale).sum(), f * back, moves


def test_chains_by_blocks_equal_their_loops():
    r = np.random.default_rng(9)
    lengths = np.array([1, 2, 3, 5, 17, 100, 257, 999])
    n = lengths.max()
    y = (r.random((8, n)) < 0.05) * (np.arange(n) < lengths[:, None])
    s, e, c = r.uniform(1e-6, 0.3, (8, n)), r.uniform(1e-6, 0.5, (8, n)), r.uniform(0.01, 0.9, 8)
    s[7, ::3], e[7, ::5] = 1e-6, 1 - 1e-6  # near the bounds that the nets keep
    ll, gamma, moves = C.hmm_forward(y, s, e, c, lengths)
    for i, k in enumerate(lengths):
        want = _hmm_loop(y[i, :k], s[i, :k], e[i, :k], c[i])
        assert ll[i] == pytest.approx(want[0], rel=1e-9)
        assert np.allclose(gamma[i, :k], want[1], atol=1e-9) and np.allclose(moves[i, : k - 1], want[2], atol=1e-9) and not moves[i, k - 1 :].any()
        if k < n:
            alone = C.hmm_forward(y[i : i + 1, :k], s[i : i + 1, :k], e[i : i + 1, :k], c[i : i + 1], lengths[i : i + 1])
            assert alone[0][0] == pytest.approx(ll[i], rel=1e-12)


def test_long_chain_is_fast():
    """A chain of 100,000 steps: several times faster than step by step, to the same likelihood."""
    r = np.random.default_rng(1)
    n = 100_000
    y, s, e = (r.random(n) < 0.01).astype(float), r.uniform(0.01, 0.1, n), r.uniform(0.1, 0.3, n)
    began = time.perf_counter()
    want = _hmm_loop(y, s, e, 0.3)
    middle = time.perf_counter()
    ll, gamma, _ = C.hmm_forward(y[None], s[None], e[None], np.array([0.3]), np.array([n]))
    took = time.perf_counter() - middle
    assert ll[0] == pytest.approx(want[0], rel=1e-9) and np.allclose(gamma[0], want[1], atol=1e-8) and took * 5 < middle - began


def test_kernels_are_linear_and_equal_their_loops(spark):
    r = np.random.default_rng(4)
    for n in (1, 2, 10, 101):
        a, b, x, out = r.random(n), r.standard_normal(n), 0.0, []
        for i in range(n):
            x = a[i] * x + b[i]
            out.append(x)
        assert np.allclose(C.scan(a, b), out)
    times = [np.sort(r.integers(0, 4000, n)).astype(float) for n in (60, 3, 200)]
    for k, t in enumerate(times):  # company doesn't matter
        together, alone = C.hawkes_fit(times, [4000.0] * 3), C.hawkes_fit([t], [4000.0])
        assert np.allclose([v[k] for v in together], [v[0] for v in alone], rtol=1e-6)
    y = np.zeros(100_000)
    y[r.integers(0, len(y), 3000)] = 1
    began = time.time()
    m = C.ekf(y, 5)
    C.scan(np.full(len(y), 0.9), y)
    assert len(m) == len(y) and time.time() - began < 10
    curve = spark.createDataFrame([(1, 0, [0.2, 0.9, 0.0, 1.0])], "author_id bigint, base_minute bigint, coding_prob array<double>")
    pair = spark.createDataFrame([(1, "c", a, b, b - a) for a, b in ((0, 20), (5, 10), (12, 12), (-50, 900))], "author_id bigint, commit_id string, parent_minute bigint, child_minute bigint, gap_minutes bigint")
    got = [(q.first, q.n, round(q.mean, 9), round(q.var, 9)) for q in C.pair_slices(pair, C.with_sums(curve), 5).orderBy("parent_minute").collect()]
    assert got == [(0, 3, 5.5, 6.25), (0, 3, 5.5, 6.25), (1, 1, 4.5, 2.25), (2, 0, 0.0, 0.0)]


def test_training_goes_on_from_a_checkpoint():
    r, kept = np.random.default_rng(2), []
    x, y = r.standard_normal((200, 4)), r.random(200)
    whole = N.fit(x, {"y": y}, {"y": "mdn"}, epochs=6)
    N.fit(x, {"y": y}, {"y": "mdn"}, epochs=4, checkpoint=N.Checkpoint(lambda: None, kept.append, 2))
    assert len(kept) == 2
    again = N.fit(x, {"y": y}, {"y": "mdn"}, epochs=6, checkpoint=N.Checkpoint(lambda: kept[-1], lambda s: None, 2))
    assert np.allclose(again.losses, whole.losses) and all(np.allclose(again.weights[k], whole.weights[k]) for k in whole.weights)
    other = N.fit(x[:, :3], {"y": y}, {"y": "mdn"}, epochs=1, checkpoint=N.Checkpoint(lambda: kept[-1], lambda s: None, 2))
    assert len(other.losses) == 1  # of another shape: begun anew


def test_synthetic_history(spark):
    rows = synthetic.commits(spark, authors=2, days=7, seed=3)
    got = sorted(synthetic.changes(rows, 3).collect(), key=lambda r: (r.author_id, r.authored_at))
    assert len(got) == rows.count() > 20
    for r in got:
        before, after = r.before_blobs[synthetic.PATH], r.after_blobs[synthetic.PATH]
        assert X.parsed(after) is not None and after != before and r.diff_text.startswith("--- a/")
        added = [x[1:] for x in r.diff_text.split("\n")[3:] if x.startswith("+")]
        assert all(x in after for x in added)
    prs = synthetic.pull_requests(rows).collect()
    assert sum(len(p.commits) for p in prs) == len(got) and all(p.merged_at > p.opened_at and len(p.commits) <= 8 for p in prs)


def test_demo(spark):
    got = demo.run(spark, samples=2, epochs=1, n_sims=100, predictor="multitask").collect()
    assert {r.scenario for r in got} == {"scope +10 %", "team off 2 days"} and all(len(r.p_by_day) == 14 and 0 <= r.p_end <= 1 for r in got)


def test_clone_and_fetch(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    git.git("init", "-q", cwd=str(src))
    git.git("-c", "user.name=a", "-c", "user.email=a@x", "commit", "-q", "--allow-empty", "-m", "one", cwd=str(src))
    c = config.Config(repos=config.Repos(source="remote", include_remote=["o/r"], url_template=f"{tmp_path}/src"), outputs=config.Outputs(str(tmp_path / "out")))
    p = stages.Pipeline.__new__(stages.Pipeline)
    p.config, p.base = c, str(tmp_path / "out")
    for _ in range(2):  # cloned, then fetched
        assert p.repositories() == [f"{tmp_path}/out/repos/o__r"]
    with pytest.raises(git.GitError):
        git.clone_or_fetch(str(tmp_path / "nothing"), str(tmp_path / "x"))


def test_coins_by_digits(spark):
    """A coin by the md5's digits is the one by the number that they make, at 0, at 1, next to both and without a chance."""
    ps = [0.0, -0.5, 2**-48, 2**-49, 1 / 3, 0.5, 1 - 2**-48, 1 - 2**-53, 1.0, 1.5, None]
    df = spark.createDataFrame([(k, p) for k in range(200) for p in ps], "k int, p double")
    df = df.select(F.coalesce(R.below(R.mark(F.col("p")), R.stem(1, "x", F.col("k")), F.lit(7)), F.lit(False)).alias("got"), F.coalesce(R.uniform(1, "x", F.col("k"), 7) < F.col("p"), F.lit(False)).alias("want"))
    assert df.filter("got <> want").count() == 0 and 700 < df.filter("got").count() < 1100
    edge = R.uniform(1, "x", 3, 7)  # the chance that equals the draw, and the next ones
    one = spark.range(1).select(*[R.below(R.mark(edge + d), R.stem(1, "x", 3), F.lit(7)) for d in (0.0, 2**-48, -(2**-48))]).first()
    assert tuple(one) == (False, True, False)


def test_many_pairs_of_an_author(spark, monkeypatch):
    """An author's pairs come in rows of a bounded number, with the same results."""
    curve = spark.createDataFrame([(1, 0, [k % 7 / 7 for k in range(400)])], "author_id bigint, base_minute bigint, coding_prob array<double>")
    pairs = spark.range(500).select(F.lit(1).cast("bigint").alias("author_id"), F.col("id").alias("commit_id"), (F.col("id") * 3).alias("parent_minute"), (F.col("id") * 3 + F.col("id") % 1500).alias("child_minute"))
    rows = lambda: sorted((r.commit_id, r.first, r.n, round(r.mean, 9), round(r.var, 9), r.part and len(r.part)) for r in C.pair_slices(pairs, curve, 5).collect())
    whole = rows()
    monkeypatch.setattr(C, "BLOCK", 7)
    assert rows() == whole and len(whole) == 500
    p = [k % 7 / 7 for k in range(400)]
    for _, first, n, mean, var, part in whole:
        own = p[first : first + n]
        assert round(5 * sum(own), 6) == round(mean, 6) and round(25 * sum(x * (1 - x) for x in own), 6) == round(var, 6) and part == (n if 1 <= n <= C.COINS else None)


def test_deltas_read_the_edges_once(spark):
    """The parser of an edge table runs once for edges and nodes."""
    df = spark.createDataFrame([(1, "python", {"m.py": "import os\n"}, {"m.py": "import os\nimport re\n"})], "id bigint, language string, before_blobs map<string,string>, after_blobs map<string,string>")
    deltas = X.graph_deltas(X.change_edges(df))
    assert deltas._jdf.queryExecution().optimizedPlan().toString().count("_Edges(") == 1
    assert [tuple(r) for r in deltas.collect()] == [(1, "imports", 1, 2, 1, 0, 2, 3, 1, 0)]


def test_features_without_edits(spark):
    """The matcher is left out where no edits are asked for; all else stays."""
    code = "import os\nclass A:\n    @g()\n    def m(self, x=h()):\n        for i in x:\n            with f(i) as y:\n                k = lambda: [g(z) for z in y if g(z)]\n        return {None: k()}\n"
    df = spark.createDataFrame([(1, "python", {"m.py": code}, {"m.py": code.replace("for i", "async def n(): pass\n        for i")})], "id bigint, language string, before_blobs map<string,string>, after_blobs map<string,string>")
    whole, less = X.code_features(df).first(), X.code_features(df, edits=False).first()
    assert less.tree[:-4] == whole.tree[:-4] and less.tree[-4:] == [0] * 4 and sum(whole.tree[-4:]) > 0 and less.graph == whole.graph
    n = len(X.NODE_TYPES)
    assert dict(zip(X.NODE_TYPES, whole.tree[:n], strict=True)) == {"FunctionDef": 1, "AsyncFunctionDef": 0, "ClassDef": 1, "If": 0, "For": 1, "While": 0, "Try": 0, "With": 1, "Call": 6, "Assign": 1, "Return": 1, "Import": 1, "ImportFrom": 0}


def test_features_come_in_small_parts():
    """A batch of many changes is taken apart, not listed as a whole."""
    kind = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
    n = 2 * X.AT_ONCE + 1
    blobs = pa.array([[{"key": "m.py", "value": "f()\n"}]] * n, kind)
    out = list(X._featured(False, iter([pa.RecordBatch.from_arrays([pa.array(range(n)), blobs, blobs], ["id", "b", "a"])])))
    assert [b.num_rows for b in out] == [X.AT_ONCE, X.AT_ONCE, 1] and [i for b in out for i in b.column(0).to_pylist()] == list(range(n))


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("model", ["excited", "filtered", "hawkes", "hmm"])
def test_kernels_get_what_the_history_has(spark, model):
    """No empty step goes to a kernel, and more authors than a bunch holds give what each gives by itself; a grid of plain counts does as well."""
    grid = C.grids(_histories(spark, {a: 12 + a % 9 for a in range(C.TOGETHER + 9)}), 30, 5, 0 if model == "hmm" else 1)
    run = {"excited": lambda g: C.excited(g, 0.05, 0.02, 0.01, 30), "filtered": lambda g: C.filtered(g, 30), "hawkes": lambda g: C.fitted(g, "hawkes", 30, iterations=3), "hmm": lambda g: C.fitted(g, "hmm", 30, epochs=1)}[model]
    assert "flatten" not in _executed(run(grid)) and "flatten" in _executed(grid)
    got = {r.author_id: r.coding_prob for r in run(grid).collect()}
    assert got.keys() == set(range(C.TOGETHER + 9))
    plain = grid.filter("author_id in (3, 70)").select("author_id", "base_minute", "counts")
    for r in run(plain).collect():
        assert r.coding_prob == pytest.approx(got[r.author_id], rel=1e-6)
    y = np.array(plain.filter("author_id = 3").first().counts, float)
    if model == "excited":
        assert got[3] == pytest.approx(1 - np.exp(-0.4 * C.scan(np.full(len(y), math.exp(-0.3)), y)))
    if model == "hmm":
        assert got[3] == pytest.approx(C.hmm_fit([np.minimum(y, 1)], [plain.first().base_minute], 30, epochs=1)[1][0], rel=1e-6)


def test_batches_of_curves():
    b = C._batch([(1, [0.5, 0.25]), (2, [])], pa.schema([("a", pa.int64()), ("p", pa.list_(pa.float64()))]))
    assert b.to_pydict() == {"a": [1, 2], "p": [[0.5, 0.25], []]}


def test_fits_are_looked_up_without_their_curves(spark, tmp_path):
    """What is asked of kept fits is taken from them before they are told apart and joined; the histories to fit go without their empty steps."""
    grid = C.grids(_histories(spark, {a: 10 + a for a in range(6)}), 30, 5)
    fits = AuthorFits(spark, str(tmp_path / "fits"), "state_space", 30, chunk=3)
    assert "counts" not in fits.missing(grid).columns
    assert fits.fit(grid) == 6 and len(fits._parts()) > 1
    few = fits.curves(grid, F.size("coding_prob").alias("n"))
    lines = _executed(few).splitlines()
    assert not any("coding_prob" in x for x in lines if "Exchange" in x or "Sort" in x or "Aggregate" in x)
    assert {r.author_id: r.n for r in few.collect()} == {r.author_id: len(r.coding_prob) for r in fits.curves(grid).collect()}


def test_terms_without_a_row_a_text(spark):
    """The vocabulary's terms from least and greatest ids, with repeated and missing ids, are those of its counts; texts and terms don't meet in a shuffle."""
    rows = [(1, "a a b c"), (1, "a b d"), (2, "b c e e e"), (3, "f f"), (3, "f")]
    docs = spark.createDataFrame(rows, "id bigint, text string")
    want = [(r.term, r.col) for r in X.vocabulary(docs, 2, 2).orderBy("col").collect()]
    few = X.frequent_terms(docs, 2, 2)
    assert [(r.term, r.col) for r in few.orderBy("col").collect()] == want == [("b", 0), ("c", 1)]
    assert "hashpartitioning(id" not in _executed(few)
    for n in (1, 3):
        assert [(r.term, r.col) for r in X.frequent_terms(docs, 3, n).orderBy("col").collect()] == [(r.term, r.col) for r in X.vocabulary(docs, 3, n).orderBy("col").collect()]
    lost = spark.createDataFrame([(None, "z z z"), (5, "z y"), (6, "y")], "id bigint, text string")
    assert [r.term for r in X.frequent_terms(lost, 5, 2).collect()] == ["y"]  # as count(DISTINCT id) has it
    named = docs.select(F.col("id").cast("string").alias("id"), "text")
    assert [(r.term, r.col) for r in X.frequent_terms(named, 2, 2).orderBy("col").collect()] == want


def test_token_vectors_without_a_shuffle(spark):
    """A text's vector is its row's own work: against the counted tokens, for more texts than are taken at once, without text and without terms."""
    docs = spark.range(3 * X.AT_ONCE + 5).select("id", F.when(F.col("id") % 9 > 0, F.concat(F.repeat(F.lit("a == bé "), (F.col("id") % 4).cast("int")), F.lit("c d"), F.lit("x").substr(F.lit(1), (F.col("id") % 2).cast("int")))).alias("text")).coalesce(1)
    vocab = spark.createDataFrame([("==", 0), ("a", 1), ("dx", 2), ("é", 3), ("none", 4)], "term string, col bigint")
    x = X.token_features(docs, vocab)
    assert "Exchange" not in _executed(x)
    got = {(r.id, k): n for r in x.collect() for k, n in enumerate(r.features) if n}
    assert got == {(r.id, r.col): r.n for r in X.token_counts(docs, vocab).collect()} and len(got) > 1000
    assert X.token_features(docs, vocab.limit(0)).first().features == []


def test_statements_of_one_shape_are_parsed_once(monkeypatch):
    """Statement by statement against the whole tree, and without parsing what is alike."""
    lines = ["x = 1", "if x:", "    y = g(x)", "    def h(a=k()):", "        return q(a)", "else:", "  z", "# c", "", "@d", "class A(b()):", "def f(x):", "    import os.path as p", "from . import u", "from a.b import c", "x = (", "1)", "try:", "    pass"]
    lines += ["except E:", "        g(1)", "async def m():", "match x:", "    case 1:", "s = 'a#b' # d", "v = f'{g(x)}'", "1if x else y", "type T = int", "print 'a'", "(g)(0x1F)", "_0(1)", "a; import b", "t = '''", "é = g(1)"]
    draw, told = random.Random(3), 0
    for _ in range(20_000):
        code = "\n".join(draw.choice(lines) for _ in range(draw.randint(1, 6))) + draw.choice(["", "\n"])
        if (own := X._by_statement(code)) is not None:
            whole = X._walked(X.parsed(code))
            told += 1
            assert own[1:] == whole[1:] and [own[0][t] for t in X._KINDS] == [whole[0][t] for t in X._KINDS], code
    assert told > 500
    n, real = [], X.parsed
    monkeypatch.setattr(X, "parsed", lambda code: n.append(len(code)) or real(code))
    code = "import os\nclass C:\n    def run(self):\n" + "".join(f"        if x{i}:\n            v_{i} = send(x{i})\n" for i in range(3000))
    values, edges = X.file_features("m", "", code, edits=False)
    assert max(n) < 200 and len(n) < 20
    assert dict(zip(X.NODE_TYPES, values[13:26], strict=True)) == dict.fromkeys(X.NODE_TYPES, 0) | {"FunctionDef": 1, "ClassDef": 1, "If": 3000, "Call": 3000, "Assign": 3000, "Import": 1}
    assert edges == (set(), set(), {("m", "os")}, {("m:run", "m:send")})


def test_tokens_over_bytes(spark):
    """Tokens in vector steps against the expression; counts without a shuffle, whole where ids repeat or lack."""
    draw, some = random.Random(5), ["a", "B", "_", "7", "0", " ", "\n", "\x1c", "=", "=", "!", "<", ">", "é", " ", " ", "　", "\U0001d4b3", "\x00", "\x85", "٣", "᠎", "\x0b"]
    texts = ["".join(draw.choice(some) for _ in range(draw.randint(0, 12))) for _ in range(5000)] + [None, "", "==="]
    want = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", S.tokens(F.col("x")).alias("t")).orderBy("i").collect()]
    for k in (0, 3):
        own, row = X.token_array(pa.array(texts).slice(k))
        got = [[] for _ in texts[k:]]
        for t, i in zip(own.to_pylist(), row.tolist(), strict=True):
            got[i].append(t)
        assert got == want[k:]
    docs = spark.createDataFrame([(1, "x y x"), (2, "y 7z"), (3, None)], "id bigint, text string")
    vocab = spark.createDataFrame([("x", 0), ("y", 4)], "term string, col bigint")
    alone = X.token_counts(docs, vocab)
    assert "Exchange hash" not in alone._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, alone.collect())) == [(1, 0, 2), (1, 4, 1), (2, 4, 1)]
    more = docs.union(spark.createDataFrame([(1, "x"), (None, "x"), (None, "x x")], docs.schema))
    assert sorted(map(tuple, X.token_counts(more, vocab).collect()), key=str) == [(1, 0, 3), (1, 4, 1), (2, 4, 1), (None, 0, 3)]
    assert [tuple(r) for r in X.frequent_terms(more, 5, 2).collect()] == [("y", 0)] and X.token_counts(docs, vocab.limit(0)).count() == 0
