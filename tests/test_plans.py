"""Physical plan checks: pushdown/pruning, no Python in formula plans, bounded windows, top-k."""

import pytest
from pyspark.sql import DataFrameWriter, functions as F

import __spark_entry__ as E
from verdant.functions import domain as D
from verdant.operators import stats as S
from verdant.operators import windows as W
from verdant.plans import farm as FARM
from verdant.plans.sensors import readings

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_formula_plans_stay_in_the_jvm(spark):
    for key in ["carbon_footprint", "water_usage", "impact_scores", "yield_estimate", "season_factors"]:
        p = plan(E.queries()[key](spark, SF))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, key


def test_scan_is_pruned_and_filter_pushed(spark):
    df = FARM.carbon_table(spark, SF).filter(F.col("farm_id") < 100).select("farm_id", "carbon_footprint_kg_co2e")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(o_orderkey), LessThan(o_orderkey,100)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in p  # 2 of 6 columns read


def test_top_k_uses_take_ordered(spark):
    df = S.top_k(FARM.carbon_table(spark, SF), "carbon_footprint_kg_co2e", 10, "farm_id")
    assert "TakeOrderedAndProject" in plan(df)


def test_top_per_group_limits_before_the_shuffle(spark):
    df = W.top_per_group(FARM.carbon_table(spark, SF), "farming_method",
                         [F.desc("carbon_footprint_kg_co2e"), F.asc("farm_id")], 3)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p


def test_windows_never_use_a_single_partition(spark):
    df = W.sliding_windows(D.with_yield(readings(spark, SF)), ["event_id"], ["event_time", "event_id"],
                           "station_id", 30)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    lines = [ln for ln in p.splitlines() if "Window [collect_list" in ln]
    assert lines and all("windowspecdefinition(station_id" in ln and "_chunk" in ln for ln in lines)
    assert "Exchange hashpartitioning(station_id" in p


def test_positions_are_lazy_and_move_the_rows_once(spark, monkeypatch):
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **k: pytest.fail("a copy was written"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = len(jobs(None))
    df = W.dense_index(events, ["ts", "event_id"], ["user_id"], name="pos")
    total = W.running_total(events, "event_id", ["ts", "event_id"])
    assert len(jobs(None)) == before
    for made in (df, total):
        payload = [ln for ln in plan(made).splitlines() if "Exchange" in ln and "REPARTITION_BY_NUM" in ln]
        assert len(payload) == 1 and "shufflepartitionidpassthrough" in payload[0]
        rows = plan(made).split("Subquery")[0]  # the rows' own part of the plan begins with it
        assert "SortMergeJoin" not in rows and "BroadcastExchange" not in rows
        # everything else reads the key columns alone
        scans = [ln for ln in plan(made).splitlines() if "ReadSchema" in ln]
        assert sum("props" in ln.split("ReadSchema")[1] for ln in scans) == 1


def test_partition_sizing_follows_input_not_join_estimates(spark):
    from verdant.session import input_bytes, partitions_for
    merged = FARM.merged_chain(spark, SF)
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions_for(merged) == floor  # small input: the session setting
    big = input_bytes(FARM.carbon_table(spark, "/root/testdata/sf0.1"))
    small = input_bytes(FARM.carbon_table(spark, SF))
    assert big > 10 * small  # grows with the scanned data
    assert partitions_for(merged, target_bytes=1024) > floor
