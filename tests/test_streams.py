"""Streamed queries on inputs that vary between runs."""

import random

from pyspark.sql import functions as F


def test_uploads_are_routed_once_whatever_a_second_quantile_would_say(spark, monkeypatch):
    import __spark_entry__ as entry
    exact = F.percentile_approx
    moved = F.udf(lambda x: x + random.randrange(5 * 10 ** 11), "bigint")
    monkeypatch.setattr(F, "percentile_approx", lambda column, *rest: exact(moved(column), *rest))
    sf = "/root/testdata/sf0.001"
    got = [r["document_id"] for r in entry.queries()["upload_duplicates"](spark, sf).collect()]
    assert sorted(got) == sorted(r["event_id"] for r in spark.read.parquet(f"{sf}/events.parquet").collect())
