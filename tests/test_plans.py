"""Plans that have to hold at scale: pruned scans, pushed filters, no cross joins, no row-at-a-time Python."""

import pytest

from sprintlens.plans import catalogue
from sprintlens.sources import tables as T

RELATIONAL = [q for q in catalogue.oracle_sql() if q not in {"q43_synthetic_commits", "q50_bus_stream", "q58_bus_capacity"}]
#: Queries with a kernel over curves, a parser or a bisection: Arrow batches, never single rows.
KERNELS = {"q17_ekf_curve", "q18_hawkes_excitation", "q19_expected_minutes", "q20_label_samples", "q45_ast_features", "q56_mixture_quantiles", "q65_edge_table", "q66_edit_totals"}


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_python_and_no_products(spark, sf, name):
    text = plan(catalogue.queries()[name](spark, sf))
    assert not any(x in text for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroups"))
    assert name in KERNELS or not any(x in text for x in ("ArrowEvalPython", "MapInPandas", "MapInArrow"))


def test_columns_are_pruned_and_filters_pushed(spark, sf):
    text = plan(catalogue.queries()["q08_review_counts"](spark, sf))
    assert "EqualTo(l_returnflag,R)" in text and "ReadSchema: struct<o_orderkey:bigint>" in text
    assert "o_totalprice" not in plan(catalogue.queries()["q09_pr_metrics_by_sha"](spark, sf)).split("== Physical Plan ==")[1]


def test_last_write_wins_combines_before_the_shuffle(spark, sf):
    text = plan(catalogue.queries()["q05_last_write_wins"](spark, sf))
    assert "partial_max_by" in text and "Window" not in text


def test_cap_is_limited_inside_the_window(spark, sf):
    assert "WindowGroupLimit" in plan(catalogue.queries()["q07_commit_cap"](spark, sf))


def test_results_do_not_depend_on_partitions(spark, sf):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(str, catalogue.queries()["q40_sprint_forecast"](spark, sf).collect())))
        assert got[0] == got[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_tables_exist(spark, sf):
    assert T.pull_requests(spark, sf).count() == T.table(spark, sf, "orders").count()


@pytest.mark.parametrize("name", ["q19_expected_minutes", "q20_label_samples"])
def test_curves_are_not_shuffled(spark, sf, name):
    """Curves are made beside their author's pairs: no exchange and no sort carries an array of chances."""
    text = catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    arrays = [line for line in text.splitlines() if ("Exchange" in line or "Sort" in line) and any(x in line for x in ("coding_prob", "sums", "part#"))]
    assert not arrays and "MapInPandas" not in text
