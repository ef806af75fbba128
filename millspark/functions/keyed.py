"""Keyed operations that keep working when one key holds a large share of the rows.

A plain window sorts a whole key in one task. These helpers either aggregate first (so Spark combines on
the map side) or cut each key into slices along its order, work inside slices, and pass only one summary
row per slice between them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICES = 512
POSITION_SLICE = 65_536
POSITION_COLUMNS = ("row_pos", "row_idx", "position", "sequence")


def order_key(*columns: str | Column) -> Column:
    """Orderable struct with nulls first; works inside max_by/min_by, which skip a null ordering."""
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in columns])


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Whole newest row per key as an aggregate: one row per key and map task crosses the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order_key(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order_key(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def with_slices(df: DataFrame, order: str, slices: int = SLICES) -> DataFrame:
    """Add ``_slice``, a non-decreasing function of ``order`` (number, date or time), by equal widths.

    Positions within a document are cut every ``POSITION_SLICE`` rows. Other orders take their bounds from one
    scalar subquery; rows with the same order value always share a slice.
    """
    if order in POSITION_COLUMNS:
        return df.withColumn("_slice", F.coalesce(F.floor(F.col(order) / POSITION_SLICE), F.lit(-1)).cast("int"))
    kind = dict(df.dtypes)[order]
    if kind.startswith("timestamp"):
        number = F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    elif kind == "date":
        number = F.unix_date(F.col(order)).cast("double")
    else:
        number = F.col(order).cast("double")
    bounds = df.agg(F.struct(F.min(number).alias("lo"), F.max(number).alias("hi")).alias("b")).scalar()
    width = (bounds["hi"] - bounds["lo"]) / F.lit(float(slices))
    position = F.when(width > 0, F.floor((number - bounds["lo"]) / width)).otherwise(F.lit(0))
    return df.withColumn("_slice", F.coalesce(F.least(position, F.lit(slices - 1)), F.lit(-1)).cast("int"))


def _inside(keys: Sequence[str], order: Sequence[str], last: bool = False):
    """Window over a slice in ``order`` (nulls lowest, as in the order struct); the row of other slices comes first, or last."""
    edge = F.col("_row").desc() if last else F.col("_row").asc()
    return Window.partitionBy(*keys, "_slice").orderBy(edge, *[F.col(c).asc_nulls_first() for c in order])


def _with_ends(sliced: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows, and for a slice that others precede one more row with what they hand on, so that one window does the rest.

    A join would shuffle all rows once more; the added rows are as few as the slices beyond the first of a key.
    """
    return sliced.withColumn("_row", F.lit(True)).unionByName(ends.withColumn("_row", F.lit(False)), allowMissingColumns=True)


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
                 alias: str = "previous", forward: bool = False) -> DataFrame:
    """lag (or lead) of ``columns`` as a struct, over ``keys`` in ``order``; null at the start of a key.

    ``order[0]`` must be a number, date or time. Only the first row of each slice looks outside its slice, at the
    end of the nearest earlier slice.
    """
    sliced = with_slices(df, order[0])
    value = F.struct(*columns)
    inside = _inside(keys, order, last=forward)
    step = F.lead if forward else F.lag
    pick = F.min_by if forward else F.max_by
    ends = sliced.groupBy(*keys, "_slice").agg(pick(value, order_key(*order)).alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    ends = ends.select(*keys, "_slice", step("_end").over(across).alias("_value")).filter("_value is not null")
    both = _with_ends(sliced.withColumn("_value", value), ends)
    return both.withColumn(alias, step("_value").over(inside)).filter("_row").select(*df.columns, alias)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, alias: str) -> DataFrame:
    """Inclusive running sum over ``keys`` in ``order`` with the same slicing."""
    sliced = with_slices(df, order[0]).withColumn("_v", value)
    inside = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sliced.groupBy(*keys, "_slice").agg(F.sum("_v").alias("_t")).select(
        *keys, "_slice", F.sum("_t").over(across).alias("_v")).filter("_v is not null")
    both = _with_ends(sliced, base)
    return both.withColumn(alias, F.coalesce(F.sum("_v").over(inside), F.lit(0))).filter("_row").select(*df.columns, alias)


def row_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], alias: str = "position") -> DataFrame:
    """row_number over ``keys`` in ``order``, sliced."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), alias)


def one_slice(df: DataFrame, position: str) -> bool:
    """Whether a count along ``position`` (one of ``POSITION_COLUMNS``) leaves every key in its first slice; runs a job over that column."""
    return not (df.agg(F.max(position)).first()[0] or 0) >= POSITION_SLICE


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple[Column, Column]], above: Sequence[str] = (), whole: bool = False) -> DataFrame:
    """For each name: the last ``value`` up to this row among rows where ``known`` holds; of names in ``above``, before this row.

    ``values`` maps an output name to (known, value). The result is a one-field struct, null when no earlier
    row was known, so that a known null stays distinct from nothing to carry. ``whole``: no key is longer than a slice
    (``one_slice``), so a window over each key does it, without a shuffle for rows that already lie together by key.
    """
    if whole:
        along = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween
        carried = {name: F.last(F.when(known, F.struct(value.alias("value"))), ignorenulls=True).over(along(Window.unboundedPreceding, -1 if name in above else Window.currentRow))
                   for name, (known, value) in values.items()}
        return df.withColumns(carried)
    sliced = with_slices(df, order[0])
    for name, (known, value) in values.items():
        sliced = sliced.withColumn(f"_k_{name}", F.when(known, F.struct(value.alias("value"))))
    ends = sliced.groupBy(*keys, "_slice").agg(*[
        F.max_by(f"_k_{name}", F.when(F.col(f"_k_{name}").isNotNull(), order_key(*order))).alias(f"_e_{name}")
        for name in values])
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_slice", *[
        F.last(f"_e_{name}", ignorenulls=True).over(across).alias(f"_k_{name}") for name in values])
    both = _with_ends(sliced, ends.filter(" or ".join(f"_k_{name} is not null" for name in values)))
    inside = _inside(keys, order).rowsBetween
    until = {name: inside(Window.unboundedPreceding, -1 if name in above else Window.currentRow) for name in values}
    return both.withColumns({name: F.last(f"_k_{name}", ignorenulls=True).over(until[name]) for name in values}).filter("_row").select(*df.columns, *values)


def exact_rank_values(df: DataFrame, group: str, value: str, ranks: dict[str, Column], scale: int = 8) -> DataFrame:
    """Order statistics per group, exact to 10^-scale, without sorting a group in one task.

    The value, as a whole number of 10^-scale units, is split in a high and a low half. Counting the high
    halves finds the block that holds a rank; counting the low halves of that block finds the value. Each
    window runs over distinct halves (at most 2^20 low ones), never over rows. ``ranks`` maps an output name
    to a rank expression over ``n``.
    """
    unit = (F.col(value).cast("decimal(28,8)") * F.lit(10 ** scale)).cast("bigint")
    counts = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), unit.alias("u")).groupBy("g", "u").agg(
        F.count("*").alias("c")).select("g", F.shiftright("u", 20).alias("hi"), "u", "c")
    totals = counts.groupBy("g").agg(F.sum("c").alias("n"))
    wanted = totals.select("g", "n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("r")) for name, rank in ranks.items()])).alias("w"))
    wanted = wanted.select("g", "n", "w.name", "w.r")
    up_to = lambda *order: Window.partitionBy("g", *order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = counts.groupBy("g", "hi").agg(F.sum("c").alias("bc"))
    blocks = blocks.withColumn("upto", F.sum("bc").over(up_to("hi")))
    block = wanted.join(blocks, "g").filter("r <= upto and r > upto - bc").selectExpr("g", "n", "name", "r", "hi", "upto - bc as before")
    inside = counts.join(block.select("g", "hi").distinct(), ["g", "hi"]).withColumn("upto", F.sum("c").over(up_to("hi", "u")))
    hit = block.join(inside, ["g", "hi"]).filter("r - before <= upto and r - before > upto - c")
    out = hit.groupBy("g", "n").agg(*[
        F.max(F.when(F.col("name") == name, F.col("u"))).alias(name) for name in ranks])
    return out.select(F.col("g").alias(group), "n", *[
        (F.col(name).cast("decimal(19,0)") * F.lit(f"1e-{scale}").cast(f"decimal({scale + 1},{scale})")).cast(f"decimal(28,{scale})").alias(name) for name in ranks])
