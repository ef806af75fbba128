"""What one task holds and a query moves."""

from pyspark.sql import functions as F

from millspark.operators import history as h, layout as ly
from millspark.session import configure


def test_tasks_stay_small_as_a_shuffle_grows(spark, tmp_path):
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "64")
    wide = configure(session).range(0, 600_000, 1, 8).select("id", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 256).alias(f"t{i}") for i in range(2)])
    # About 80 MB that do not compress: four tasks of 20 MB where partitions of 64 MB are allowed.
    assert wide.repartition("id").rdd.getNumPartitions() >= 8
    wide.select("t0").coalesce(1).write.option("parquet.block.size", 4 << 20).parquet(f"{tmp_path}/t")
    assert session.read.parquet(f"{tmp_path}/t").rdd.getNumPartitions() >= 2
    assert {session.conf.get("spark.sql.files.maxPartitionBytes"), session.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")} == {"16m", "8m"}


def test_run_detail_counts_evidence_on_request_only(spark):
    results = spark.createDataFrame([(1,), (2,)], "result_id long")
    candidates = spark.createDataFrame([(11, 1, 2, "72", "01"), (10, 1, 1, "73", "00")], "candidate_id long, result_id long, rank int, fraction string, nico string")
    factors = spark.createDataFrame([(102, 10, 2, "b", "matched"), (101, 10, 1, "a", "unknown")], "factor_id long, candidate_id long, sequence int, rule_code string, outcome string")
    links = spark.createDataFrame([(1, 102), (2, 102)], "link_id long, factor_id long")
    plain = h.run_detail(results, candidates, factors)
    counted = h.run_detail(results, candidates, factors, links)
    read = lambda df: {r["result_id"]: r["candidates"] and [(c["rank"], c["factors"] and [tuple(f) for f in c["factors"]]) for c in r["candidates"]] for r in df.collect()}
    assert read(plain) == {1: [(1, [(1, "a", "unknown"), (2, "b", "matched")]), (2, None)], 2: None}
    assert read(counted) == {1: [(1, [(1, "a", "unknown", 0), (2, "b", "matched", 2)]), (2, None)], 2: None}


def test_run_details_reads_no_links(spark):
    from workload import registry
    import workload.all  # noqa: F401
    plan = registry.QUERIES["run_details"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "event_id" not in plan


def test_profile_fields_meet_blocks_without_a_shuffle_by_text(spark, monkeypatch):
    blocks = spark.createDataFrame([(d, 1, "Width", 100.0, 160.0, 90.0, 102.0) for d in (1, 2, 3)] + [(1, 1, "1200", 100.0, 160.0, 120.0, 132.0), (1, 1, "1300", 100.0, 160.0, 140.0, 152.0), (2, 1, "900", 100.0, 160.0, 120.0, 132.0)],
                                   "doc_id long, page int, text string, x0 double, x1 double, top double, bottom double")
    fields = spark.createDataFrame([("GRID", "width", "first_width", -5.0, 70.0, 10.0, 50.0)], "profile string, anchor_text string, field string, dx0 double, dx1 double, dy0 double, dy1 double")
    got = ly.apply_profiles(blocks, fields)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    want = {(1, None, True), (2, "900", False)}
    assert {(r["doc_id"], r["value"], r["conflict"]) for r in got.collect()} == want
    monkeypatch.setattr(ly, "PROFILE_ROWS", 0)
    assert {(r["doc_id"], r["value"], r["conflict"]) for r in ly.apply_profiles(blocks, fields).collect()} == want
