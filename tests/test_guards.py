"""Pairing that fits or fails, and checks counted while a table is written."""

import pytest
from pyspark.sql import functions as F

from coilwise.operators import guards


def tables(spark, left, right):
    return spark.createDataFrame(left, "name string, a int").repartition(3), spark.createDataFrame(right, "name string, b int")


def test_equal_names_pair(spark):
    a, b = tables(spark, [("x", 1), ("y", 2), (None, 3)], [("y", 20), ("x", 10), (None, 30)])
    assert sorted(guards.aligned(a, b, ["name"]).collect(), key=str) == sorted([("x", 1, 10), ("y", 2, 20), (None, 3, 30)], key=str)
    assert guards.aligned(a.limit(0), b.limit(0), ["name"]).count() == 0


@pytest.mark.parametrize("left,right,text", [
    ([("x", 1)], [("x", 1), ("y", 2)], "missing on the left: y"), ([("x", 1), ("y", 2)], [("x", 1)], "missing on the right: y"),
    ([("x", 1), ("x", 2)], [("x", 1)], "repeated: x"), ([("x", 1)], [("x", 1), ("x", 1)], "repeated: x"), ([], [("x", 1)], "missing on the left: x"),
])
def test_names_that_do_not_fit_fail(spark, left, right, text):
    a, b = tables(spark, left, right)
    with pytest.raises(Exception, match=text):
        guards.aligned(a, b, ["name"]).collect()


def test_checks_are_counted_once_while_writing(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rows = spark.range(1000).select("id", (F.col("id") % 2).alias("part")).mapInArrow(seen, "id bigint, part bigint")
    got = guards.write_checked(rows, f"{tmp_path}/t", {"small": F.col("id") >= 990, "fine": F.col("id") < 0, "unknown": F.lit(None).cast("boolean")}, ["part"])
    assert sorted(map(tuple, got.collect())) == [("fine", True, "0 of 1000"), ("small", False, "10 of 1000"), ("unknown", True, "0 of 1000")]
    assert reads.value == 1000 and spark.read.parquet(f"{tmp_path}/t").count() == 1000


def test_set_tree_is_one_rule_at_every_size(spark):
    """Order, repeats and the way a set was put together don't matter; one id does."""
    from coilwise.sources import sinks

    ids = spark.range(5000).select(F.lit("k").alias("k"), F.concat(F.lit("frame-000000-"), F.col("id")).alias("i"))
    root = lambda df: [(r.digest, r.n) for r in sinks.set_root(df, ["k"]).collect()]
    whole = root(sinks.set_buckets(ids, ["k"], "i"))
    assert whole == root(sinks.set_buckets(ids.union(ids.limit(10)).repartition(7), ["k"], "i")) and whole[0][1] == 5000
    assert whole != root(sinks.set_buckets(ids.where("i <> 'frame-000000-77'"), ["k"], "i"))
    buckets = sinks.set_buckets(ids, ["k"], "i").cache()
    assert whole == root(buckets.where("bucket < '8'").union(buckets.where("bucket >= '8'")))
    assert buckets.agg(F.max("n")).first()[0] <= 3  # ids with a common beginning spread
    assert root(sinks.set_buckets(ids.limit(0), ["k"], "i")) == []
