"""Exact deduplication by sorting contents.

Texts are range-partitioned by (first bytes, 64-bit hash, slice): Spark samples that short key for the splitters, so no
whole text reaches the driver, and equal texts meet in one range. Inside a range an external sort places equal texts
side by side and each row is compared in full with its neighbour; a row that differs starts a new run. Texts whose
copies hold more than ``slice_bytes`` are dealt over several slices, so that no range has to hold a hot group; only the
first row of each run of such a slice is compared in full once more, over the slices.

Native functions only. Whole texts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from millspark.llm.common import NULL_ID, picked, sized
from millspark.session import staged

PREFIX_BYTES = 16
SLICE_BYTES = 32 << 20
RANGE_BYTES = 64 << 20
HOT_TEXTS = 100_000


def content_groups(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] = lambda text: text,
                   slice_bytes: int = SLICE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``.

    Texts are equal if their bytes are equal after ``normalise``; a null text is an empty one. Of equal texts the row
    with the ``keep`` ("smallest" or "largest") ``doc_id`` stays; a null id is smaller than all others and comes back as
    null, and of rows that repeat the kept id with the same text one stays. Rows that repeat an id with different texts
    are different documents. Texts of any length take part whole. An empty table gives an empty table.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    docs = picked(docs, doc_id="long", text="string")
    sign = 1 if keep == "largest" else -1
    rank = F.coalesce("doc_id", F.lit(NULL_ID))
    texts = docs.select("doc_id", F.coalesce(normalise(F.col("text")), F.lit("")).alias("text"), rank.alias("rank"))
    texts = texts.withColumn("hash", F.xxhash64("text"))

    counted = staged(texts.groupBy("hash").agg(F.sum(F.octet_length("text").cast("long") + 32).alias("size")))
    hot = counted.filter(F.col("size") > slice_bytes).select(F.col("hash").alias("hot_hash"), F.ceil(F.col("size") / slice_bytes).cast("long").alias("slices"))
    total = counted.agg(F.sum("size")).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))

    dealt = texts.join(sized(hot, HOT_TEXTS), F.col("hash") == F.col("hot_hash"), "left")
    slice_ = F.when(F.col("slices").isNotNull(), 1 + F.monotonically_increasing_id() % F.col("slices")).otherwise(0)
    dealt = dealt.select("doc_id", "text", "rank", "hash", slice_.alias("slice"), F.substring(F.col("text").cast("binary"), 1, PREFIX_BYTES).alias("prefix"))
    ranged = dealt.repartitionByRange(ranges, "prefix", "hash", "slice")

    order = F.col("rank").desc() if sign > 0 else F.col("rank").asc()
    near = Window.partitionBy("prefix", "hash", "slice").orderBy("text", order)
    fresh = ~F.lag("text").over(near).eqNullSafe(F.col("text"))
    placed = ranged.select("*", fresh.alias("fresh"))
    placed = placed.select(
        "doc_id", "rank", "prefix", "hash", "slice", "fresh", F.sum(F.col("fresh").cast("int")).over(near.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.when(F.col("fresh") & (F.col("slice") > 0), F.col("text")).alias("head"))
    run = Window.partitionBy("prefix", "hash", "slice", "run")
    best = F.max("rank") if sign > 0 else F.min("rank")
    rows = staged(placed.select("doc_id", "hash", "slice", "run", "fresh", "text_sha256", "head", best.over(run).alias("best"), F.count(F.lit(1)).over(run).alias("size")))

    # Runs of sliced texts, some per slice: one per text is left after a full comparison of their first rows.
    heads = rows.filter("slice > 0 AND fresh")
    first = (F.max if sign > 0 else F.min)(F.struct("best", (F.col("slice") * -sign).alias("slice")))
    whole = heads.groupBy("hash", "head").agg(first.alias("first"), F.sum("size").alias("whole_size"))
    runs = heads.select("hash", "head", F.col("slice").alias("_slice"), F.col("run").alias("_run"))
    runs = staged(runs.join(whole, ["hash", "head"]).select(F.col("hash").alias("_hash"), "_slice", "_run", "first", "whole_size"))
    joined = rows.drop("head").join(sized(runs, HOT_TEXTS), (F.col("hash") == F.col("_hash")) & (F.col("slice") == F.col("_slice")) & (F.col("run") == F.col("_run")), "left")
    kept_rank = F.coalesce("first.best", "best")
    kept = F.col("fresh") & (F.col("first").isNull() | (F.col("first.slice") * -sign == F.col("slice")))
    return joined.select("doc_id", F.nullif(kept_rank, F.lit(NULL_ID)).alias("keep_id"), F.coalesce("whole_size", "size").alias("group_size"), kept.alias("kept"), "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
 row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
