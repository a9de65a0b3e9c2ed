"""What the physical plans must and must not contain."""

import re

import pytest

from __spark_entry__ import queries
from sonolog.plans import materialised  # noqa: F401
from sonolog.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = sorted(n for n, f in QUERIES.items() if f.__wrapped__.__module__.endswith("queries"))


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_cross_product(spark, sf_dir, name):
    text = plan(queries()[name](spark, sf_dir))
    assert not re.search(r"CartesianProduct|NestedLoop|PythonUDF|ArrowEval|BatchEvalPython|MapInPandas", text), text


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    text = queries()["yearly_stats"](spark, sf_dir)._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_quantity", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_extendedprice" not in schema and "l_shipdate" in schema


def test_dedup_is_cut_before_the_shuffle(spark, sf_dir):
    text = plan(queries()["metadata_dedup"](spark, sf_dir))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_top_lists_do_not_sort_everything(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(queries()["top_artists"](spark, sf_dir))


def test_names_are_not_normalised_per_play(spark, sf_dir):
    """The optimiser must not move a NULL test of a normalised name down to the plays."""
    for name in ["yearly_features", "genre_play_counts", "work_queue", "mainstream_bands"]:
        text = queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        facts = [line for line in text.splitlines() if "Filter" in line and ("l_quantity" in line or "value#" in line)]
        assert facts and not any("lower(" in line for line in facts), facts


def test_small_dimension_leaves_the_plays_unshuffled(spark, sf_dir):
    text = plan(queries()["enriched_plays"](spark, sf_dir))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def groups(text):
    """Top-level bracket groups: a window's expressions, its partition if any, its order."""
    depth, out = 0, []
    for i, ch in enumerate(text):
        if ch in "[(":
            if depth == 0:
                start = i
            depth += 1
        elif ch in "])":
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
    return out


def test_no_single_partition_window_over_plays(spark, sf_dir):
    """Windows without a partition run over period or bucket tables only."""
    allowed = {"volume_delta", "yearly_delta", "work_queue_batches", "batch_metrics"}
    for name in LAZY:
        text = plan(queries()[name](spark, sf_dir))
        for line in text.splitlines():
            node = re.search(r"\bWindow (\[.*)", line)
            if not node:
                continue
            parts = groups(node.group(1))[1:]
            unpartitioned = not parts or (len(parts) == 1 and re.search(r" (ASC|DESC) ", parts[0]))
            assert not unpartitioned or name in allowed, (name, line)


def test_stored_plays_are_not_shuffled(spark, sf_dir):
    """Also where nothing may be broadcast of itself; years that are not asked for are not read."""
    from sonolog.sources import layout

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    tables = materialised._layout(spark, sf_dir)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = plan(layout.enriched(spark, tables, 2024, 2024))
        cold = text.split("Union", 1)[1].split("BroadcastHashJoin")[0]
        assert "SortMergeJoin" in cold and "Exchange" not in cold.split("FileScan")[0] and "Exchange hash" not in text
        keys = plan(layout.unique_keys(spark, tables))
        assert keys.count("Exchange hash") == 1  # of what was kept aside
        assert "year#" in re.search(r"PartitionFilters: \[([^\]]*)", text).group(1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_plays_are_not_repeated_for_a_second_distinct_count(spark, sf_dir):
    for name in ("library_summary", "dashboard_kpis"):
        assert "Expand" not in plan(queries()[name](spark, sf_dir))
