"""Mixing of sources to target sizes by systematic sampling.

Every document of a source has the same expected number of copies, target / size of the source. Expected copies are
summed along an order of the source's documents, one random offset per source is added, and a document is emitted
once per whole number that its stretch of the sum crosses: the floor or the ceiling of its expectation. The order is by
size, so that every size is taken in proportion and the words taken stay near the target. Sums are whole numbers of
2**-24 copies: they do not depend on the order of addition, and reruns agree.

No task sorts a source. Documents fall into slices (source, size bucket, salt) along the order; a slice sums its own
documents, and only slice totals, whose number per source is bounded, are summed per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from millspark.llm.common import picked

WEIGHTS = (5, 2, 1)
CAP = 3
UNIT_BITS = 24
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source (one row each, ``source, source_size``) the words to take.

    Sources in code point order, null last, get the weights in turn and share the total; what exceeds ``cap`` times a
    source's size goes to the others by weight until none exceeds it. Filling by rising cap / weight gives that fixed
    point in one pass: the sources below the final level are full, the others get level times weight.
    """
    one = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("place", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    filled = ranked.withColumns({"weight": weight, "most": F.col("source_size") * cap})
    by_ratio = one.orderBy((F.col("most") / F.col("weight")).asc(), F.col("place").asc()).rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(one) - F.coalesce(F.sum("most").over(by_ratio), F.lit(0)))
             / (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))))
    filled = filled.withColumn("level", level)
    open_ = F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("place"))
    # The level of the first source that stays open; below it every source is full.
    filled = filled.withColumn("level", F.min_by("level", F.when(open_.isNotNull(), F.col("most") / F.col("weight"))).over(one))
    target = F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("level") * F.col("weight")).otherwise(F.col("most").cast("double"))
    return filled.select("source", "source_size", target.cast("double").alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` and the ``carry`` columns for each row of ``docs``.

    Size counts words without ASCII white space; a null text has size 0 and takes nothing whatever its copies. A null
    source is a source of its own. A source of size 0 has target 0. Null and repeated ids are rows like others: rows equal
    in id and size are interchangeable. ``copies`` is at most ``cap``. An empty table gives an empty table.
    """
    kinds = dict(docs.dtypes)
    docs = picked(docs, doc_id="long", text="string", source="string", **{c: kinds[c] for c in carry if c not in ("doc_id", "text", "source")})
    docs = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *[F.col(f"`{c}`").alias(f"_carry{i}") for i, c in enumerate(carry)])
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(sizes, weights, cap)
    units = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.lit(float(1 << UNIT_BITS)))).otherwise(0).cast("long")
    wanted = wanted.withColumns({"units": units, "_key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))})
    bits = F.length(F.bin("size"))
    tie = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    placed = docs.withColumns({"_key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")), "tie": tie})
    placed = placed.withColumn("slice", F.concat(F.lpad((bits * 32 + F.expr("shiftright(size, greatest(length(bin(size)) - 5, 0))")).cast("string"), 6, "0"), F.substring("tie", 1, 1)))
    slices = placed.groupBy("_key", "slice").agg(F.count("*").alias("n"))
    slices = slices.join(wanted, "_key").withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("units")).over(Window.partitionBy("_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "_key").cast("binary")), 1, UNIT_BITS // 4), 16, 10).cast("long")
    slices = slices.select("_key", "slice", "source_size", "target", "units", (F.col("before") + offset).alias("before"))
    own = Window.partitionBy("_key", "slice").orderBy("size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(slices, ["_key", "slice"])
    start = F.col("before") + F.coalesce(F.count(F.lit(1)).over(own), F.lit(0)) * F.col("units")
    ends = joined.withColumn("start", start)
    copies = F.shiftright(F.col("start") + F.col("units"), UNIT_BITS) - F.shiftright("start", UNIT_BITS)
    return ends.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry) if c != "doc_id"])


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS most FROM r),
f AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER b, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS lv FROM w WINDOW b AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(lv, most / weight) AS level FROM f WHERE lv * weight < most),
t AS (SELECT source, source_size, CASE WHEN level * weight < most THEN level * weight ELSE CAST(most AS DOUBLE) END AS target FROM f LEFT JOIN v ON true),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target / source_size * {float(1 << UNIT_BITS)}) AS BIGINT) ELSE 0 END AS units, coalesce('s' || source, '') AS k FROM t),
p AS (SELECT d.doc_id, d.size, u.source_size, u.target, u.units, CAST('0x' || substr(md5('{SEED}:' || k), 1, 6) AS BIGINT) + CAST(coalesce(sum(u.units) OVER (PARTITION BY k ORDER BY length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)), substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 1), size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
 FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, CAST(((start + units) >> {UNIT_BITS}) - (start >> {UNIT_BITS}) AS BIGINT) * size AS taken FROM p
"""
