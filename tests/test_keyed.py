"""Sliced operations against plain windows, with one key holding more than a third of all rows."""

from pyspark.sql import Window, functions as F

from millspark.functions import keyed


def skewed(spark, n=6000):
    return spark.range(n).select((F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 97)).alias("k"), (F.col("id") * 7919 % n).alias("o"), F.col("id").alias("v"),
                                 F.when(F.col("id") % 3 == 0, F.col("id")).alias("m"))


def test_previous_row_and_running_sum(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("o")
    got = keyed.previous_row(df, ["k"], ["o"], ["v"])
    plain = df.withColumn("want", F.lag("v").over(w))
    assert got.select("v", F.col("previous.v").alias("got")).join(plain.select("v", "want"), "v").filter("not (got <=> want)").count() == 0
    ahead = keyed.previous_row(df, ["k"], ["o"], ["v"], forward=True)
    assert ahead.select("v", F.col("previous.v").alias("got")).join(df.withColumn("want", F.lead("v").over(w)).select("v", "want"), "v").filter("not (got <=> want)").count() == 0
    total = keyed.running_sum(df, ["k"], ["o"], F.col("v"), "s").select("v", "s")
    assert total.join(df.withColumn("want", F.sum("v").over(w)).select("v", "want"), "v").filter("s <> want").count() == 0
    assert keyed.row_position(df, ["k"], ["o"]).join(df.withColumn("want", F.row_number().over(w)).select("v", "want"), "v").filter("position <> want").count() == 0


def test_carry_forward_keeps_a_known_null(spark):
    df = skewed(spark).withColumn("known", F.col("v") % 4 != 1)
    got = keyed.carry_forward(df, ["k"], ["o"], {"c": (F.col("known"), F.col("m"))})
    w = Window.partitionBy("k").orderBy("o")
    want = df.withColumn("want", F.last(F.when(F.col("known"), F.struct(F.col("m").alias("value"))), ignorenulls=True).over(w))
    assert got.select("v", "c").join(want.select("v", "want"), "v").filter("not (c <=> want)").count() == 0


def test_latest_and_exact_ranks(spark):
    df = skewed(spark)
    assert keyed.latest_by(df, ["k"], ["o"]).count() == df.select("k").distinct().count()
    values = df.withColumn("x", (F.col("v") % 1000 / 8).cast("double"))
    got = {r["k"]: r for r in keyed.exact_rank_values(values, "k", "x", {"p95": F.ceil(F.col("n") * 95 / 100)}).collect()}
    import math
    groups = {}
    for r in values.collect():
        groups.setdefault(r["k"], []).append(r["x"])
    for k, xs in groups.items():
        assert float(got[k]["p95"]) == sorted(xs)[math.ceil(len(xs) * 0.95) - 1]


def test_helpers_move_their_rows_once(spark):
    rows = spark.range(1000).selectExpr("id % 3 as k", "id as o", "id as v", "id % 5 = 0 as known")
    for df in (keyed.previous_row(rows, ["k"], ["o"], ["v"]), keyed.running_sum(rows, ["k"], ["o"], F.col("v"), "s"), keyed.carry_forward(rows, ["k"], ["o"], {"c": (F.col("known"), F.col("v"))})):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan


def test_values_of_the_row_above_cross_slices(spark):
    n = keyed.POSITION_SLICE
    rows = spark.createDataFrame([(1, n - 1, "a"), (1, n, None), (1, n + 1, "b"), (2, n, "c")], "k long, row_pos long, v string")
    got = keyed.carry_forward(rows, ["k"], ["row_pos"], {"c": (F.col("v").isNotNull(), F.col("v")), "up": (F.lit(True), F.col("v"))}, above=["up"])
    assert {(r["k"], r["row_pos"]): (r["c"]["value"], r["up"] and r["up"]["value"]) for r in got.collect()} == {
        (1, n - 1): ("a", None), (1, n): ("a", "a"), (1, n + 1): ("b", None), (2, n): ("c", None)}
    assert {(r["k"], r["row_pos"]): r["up"] is None for r in got.collect()} == {(1, n - 1): True, (1, n): False, (1, n + 1): False, (2, n): True}
