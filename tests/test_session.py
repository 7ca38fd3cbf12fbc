"""Intermediate files: what is kept, what is deleted, also after a failure."""

import os

import pytest

from gridmark.operators import components
from gridmark.session import BATCH_BYTES, bound_batches, cut, discard, scratch, settings, shared_folder, store


def folders(spark):
    shared_folder(spark, "any")
    place = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return set(os.listdir(place))


def test_scratch_keeps_what_is_kept(spark):
    before = folders(spark)
    with scratch(spark) as keep:
        one, two = store(spark.range(5)), store(spark.range(3))
        keep(one.filter("id > 1"))
        two.count()
    assert one.count() == 5 and len(folders(spark) - before) == 1
    discard(one)
    assert folders(spark) == before


def test_scratch_in_scratch_and_failure(spark):
    before = folders(spark)
    with pytest.raises(KeyError), scratch(spark):
        with scratch(spark) as keep:
            kept = keep(store(spark.range(4)))
            store(spark.range(2))
        assert kept.count() == 4 and len(folders(spark) - before) == 1
        raise KeyError
    assert folders(spark) == before


def test_contract_leaves_its_result_only(spark):
    before = folders(spark)
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)], "a long, b long")
    roots = components.contract(edges, ())
    assert {r.root for r in roots.collect()} == {0} and len(folders(spark) - before) == 1


def test_joins_of_large_cuts_are_not_planned_as_broadcasts(spark):
    px = spark.range(1_500_000).selectExpr("id div 4096 as image_id", "cast(id div 64 % 64 as int) as y", "cast(id % 64 as int) as x")
    one, two = cut(px), cut(px.withColumn("region", px.x % 7))  # some 0.1 bytes a row
    joined = one.join(two, ["image_id", "y", "x"], "left")
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert joined.count() == 1_500_000


def test_a_session_keeps_its_own_size_factor(spark):
    key = "spark.sql.sources.fileCompressionFactor"
    with settings(spark, {key: "3.0"}):
        cut(spark.range(3))
        assert spark.conf.get(key) == "3.0"


def test_bound_batches_keeps_a_smaller_setting(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for given, want in (("64m", BATCH_BYTES), ("1m", 1 << 20)):
        with settings(spark, {key: given}):
            bound_batches(spark)
            assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) == want
