"""Product rows from the aligned blocks of a page.

Identifiers below a header give the rows, header centres give the columns. Everything is keyed by (document, page): joins
on the page and a strip of it, windows over the blocks and arrays over the headers of one page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from millspark.functions import text as tx
from millspark.functions import vocabulary as voc
from millspark.operators.headers import map_headers
from millspark.operators.layout import STRIP, strips
from millspark.session import staged

PAGE = ["doc_id", "page"]
# --- fixed values: shares of the page width, page height, band or neighbour distance ---
COLUMN_REACH, SAME_COLUMN, LONE_COLUMN, NEIGHBOUR = 0.018, 0.008, 0.025, 0.45
SAME_PLACE, SCALE_REACH = 0.02, 0.015
HEADER_ZONE, LONE_ROW, HEADER_LINE, PERCENT_ZONE, FACTOR_ZONE = 0.2, 0.035, 0.02, 0.15, 0.1
SAME_READING, TALL_BLOCK, LEAST_BAND = 0.5, 1.8, 12.0
MIN_DIGITS = 6


def has_words(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the phrases stands in the text as whole words."""
    padded = F.concat(F.lit(" "), tx.normalize_term(text), F.lit(" "))
    # One expression, not a lambda over the phrases, which would normalize the text for each of them.
    return padded.rlike(" (?:" + "|".join(re.escape(w) for w in words) + ") ")


def identifiers(text: Column) -> Column:
    """Words of a text that can name a roll: a letter with a digit behind it, or digits enough."""
    parts = F.split(text, "[^A-Za-z0-9_-]+")
    return F.filter(parts, lambda p: p.rlike("[A-Za-z].*[0-9]") | p.rlike(f"^[0-9]{{{MIN_DIGITS},}}$"))


def says_its_value(text: Column) -> Column:
    return F.coalesce(F.trim(F.get(F.split(text, "[:：]", 2), F.lit(1))) != "", F.lit(False))


def merge_readings(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group of readings of the same place: the thinnest box and the most confident text.

    A sweep over the sorted tops: a box joins the group before it when both overlap by half of the smaller height and
    width; the group's lowest box so far stands for it. Equal texts in different places stay different rows.
    """
    sweep = Window.partitionBy(*keys).orderBy("top", "block_id")
    far = F.max(F.struct("bottom", "top", "x0", "x1")).over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    df = anchors.withColumn("_far", far)
    half = lambda low, high: F.expr(f"least({high}, _far.{high}) - greatest({low}, _far.{low}) >= {SAME_READING} * least({high} - {low}, _far.{high} - _far.{low})")
    fresh = ~F.coalesce(half("top", "bottom") & half("x0", "x1"), F.lit(False))
    df = df.withColumn("_fresh", fresh).withColumn("reading", F.sum(F.col("_fresh").cast("int")).over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
    box = F.struct("block_id", "x0", "x1", "top", "bottom", "cx", "cy")
    found = df.groupBy(*keys, "reading").agg(
        F.min_by(box, F.struct(F.col("bottom") - F.col("top"), "block_id")).alias("box"), F.max_by("token", F.struct("confidence", -F.col("block_id"))).alias("product_id"),
        F.count("*").alias("readings"))
    return found.select(*keys, "box.*", "product_id", "readings")


def find_anchors(b: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows of each page: identifiers under the header that has most of them, with the band that each row covers."""
    ids = heads.filter((F.col("category") == "product_id") & ~says_its_value(F.col("text"))).select(
        *PAGE, F.col("block_id").alias("column_id"), F.col("cx").alias("h_cx"), F.col("bottom").alias("h_bottom"),
        has_words(F.col("text"), voc.ROLL_HEADERS).alias("named"), has_words(F.col("text"), voc.PACK_HEADERS).alias("pack"),
        F.greatest((F.col("x1") - F.col("x0")) / 2, F.col("page_width") * COLUMN_REACH).alias("reach"))
    token = b.withColumn("_tokens", identifiers(F.col("text"))).filter("size(_tokens) = 1").filter(
        ~F.contains(tx.normalize_term(F.col("text")), F.lit("total")) & ~has_words(F.col("text"), voc.NOT_IDENTIFIERS))
    token = token.withColumn("token", F.col("_tokens")[0]).withColumn("strip", F.floor(F.col("cx") / STRIP))
    under = token.join(ids.withColumn("strip", strips(F.col("h_cx") - F.col("reach"), F.col("h_cx") + F.col("reach"))), [*PAGE, "strip"])
    under = under.filter("cy > h_bottom and abs(cx - h_cx) <= reach").withColumn("lettered", F.col("token").rlike("[A-Za-z]"))
    column = [*PAGE, "column_id"]
    lettered = F.max("lettered").over(Window.partitionBy(*column))
    under = under.withColumn("_any", lettered).filter("lettered or not _any")
    rows = staged(merge_readings(under, column).join(ids.select(*column, "h_cx", "named", "pack"), column))
    best = rows.groupBy(*column).agg(F.count("*").alias("n"), F.max("named").alias("named")).groupBy(*PAGE).agg(
        F.max_by("column_id", F.struct("n", "named", -F.col("column_id"))).alias("column_id"))
    rows = rows.join(best, column).join(b.groupBy(*PAGE).agg(F.max("page_height").alias("page_height")), PAGE)
    line = Window.partitionBy(*PAGE).orderBy("cy", "block_id")
    rows = rows.withColumns({"row_id": F.row_number().over(line), "_up": F.lag("cy").over(line), "_down": F.lead("cy").over(line)})
    # The first row reaches up as far as down, the last down as far as up; a lone row has a share of the page.
    up = F.coalesce("_up", F.col("cy") - F.coalesce(F.col("_down") - F.col("cy"), F.col("page_height") * LONE_ROW))
    down = F.coalesce(F.col("_down"), F.col("cy") + (F.col("cy") - up))
    return rows.select(*column, "row_id", "product_id", "readings", "block_id", "cx", "cy", "top", "h_cx", "pack", ((up + F.col("cy")) / 2).alias("low"), ((down + F.col("cy")) / 2).alias("high"))


def find_columns(b: DataFrame, heads: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns of each page with key, centre, tolerance and, for chemistry, the power of ten of their values."""
    first = rows.groupBy(*PAGE).agg(F.min("top").alias("first_top"), F.min("column_id").alias("column_id"), F.min("h_cx").alias("id_cx"))
    zone = heads.join(first, PAGE).filter(F.col("cy").between(F.col("first_top") - F.col("page_height") * HEADER_ZONE, F.col("first_top")) & (F.col("cy") < F.col("first_top")))
    label = (F.col("category") == "product_id") & has_words(F.col("text"), voc.LABEL_HEADERS) & (F.col("block_id") != F.col("column_id"))
    zone = zone.withColumns({"key": F.when(label, "label_no").otherwise(F.col("key")), "category": F.when(label, "label").otherwise(F.col("category"))}).filter("category <> 'product_id'")
    plain = F.when((F.col("category") == "chemistry") & F.trim("text").isin(*voc.PLAIN_ELEMENTS), F.col("cy"))
    line = zone.groupBy(*PAGE).agg(F.array_sort(F.collect_list(plain)).alias("_ys")).select(*PAGE, F.get("_ys", F.floor(F.size("_ys") / 2).cast("int")).alias("line_y"))
    zone = zone.join(line, PAGE).filter(~F.coalesce((F.col("category") == "chemistry") & (F.abs(F.col("cy") - F.col("line_y")) > F.col("page_height") * HEADER_LINE), F.lit(False)))
    lowest = F.max_by(F.struct("block_id", "category", "text", "exponent", "cx", "cy", "x0", "x1", "first_top", "id_cx", "page_width", "page_height"), F.struct("cy", -F.col("block_id")))
    columns = staged(zone.groupBy(*PAGE, "key").agg(lowest.alias("h")).select(*PAGE, "key", "h.*"))

    # Blocks above or below a chemistry header that declare its scale.
    chemical = columns.filter("category = 'chemistry'").select(*PAGE, "key", "exponent", F.col("cx").alias("h_cx"), F.col("cy").alias("h_cy"), "first_top", F.floor(F.col("cx") / STRIP).alias("strip"))
    reach = F.col("page_width") * SCALE_REACH
    said, digit = tx.scale_exponent(F.col("text")), F.trim("text").rlike("^[1-6]$")
    # Only texts that can declare a scale meet the headers.
    declares = said.isNotNull() | digit | F.contains("text", F.lit("10")) | F.contains("text", F.lit("%"))
    spread = b.filter(declares).withColumn("strip", strips(F.least(F.col("x0"), F.col("cx") - reach), F.greatest(F.col("x1"), F.col("cx") + reach)))
    near = chemical.join(spread.select(*PAGE, "strip", "block_id", "text", "x0", "x1", "top", "cx", "cy", "page_width", "page_height"), [*PAGE, "strip"])
    covers = F.col("h_cx").between(F.col("x0"), F.col("x1"))
    between = ((F.abs(F.col("cx") - F.col("h_cx")) < reach) | covers) & (F.col("cy") > F.col("h_cy")) & (F.col("cy") < F.col("first_top"))
    percent = F.contains("text", F.lit("%")) & covers & (F.col("top") < F.col("first_top")) & (F.col("top") > F.col("first_top") - F.col("page_height") * PERCENT_ZONE)
    hints = near.groupBy(*PAGE, "key").agg(
        F.min_by(said, F.when(between & said.isNotNull(), F.col("block_id"))).alias("said"), F.min_by(F.trim("text"), F.when(between & digit, F.struct(F.abs(F.col("cx") - F.col("h_cx")), "block_id"))).alias("power"),
        F.max(between & F.contains("text", F.lit("10"))).alias("ten"), F.max(percent).alias("percent"))
    power, heavy = F.col("text").rlike(r"(?i)[x×]10|10\s*[-−]"), has_words(F.col("text"), voc.GROSS_WORDS)
    factor = power & (F.col("top") < F.col("first_top")) & (F.col("top") > F.col("first_top") - F.col("page_height") * FACTOR_ZONE)
    gross = heavy & (F.col("top") < F.col("first_top")) & (F.col("top") > F.col("first_top") - F.col("page_height") * HEADER_ZONE)
    pages = b.filter(power | heavy).join(first.select(*PAGE, "first_top"), PAGE).groupBy(*PAGE).agg(F.max(factor).alias("factor"), F.collect_list(F.when(gross, F.col("cx"))).alias("gross"))
    exponent = F.coalesce("exponent", "said", F.when(F.col("ten"), -F.col("power").cast("int")), F.when(F.col("percent") & ~F.col("factor"), 0))
    columns = columns.join(hints, [*PAGE, "key"], "left").join(pages, PAGE, "left").withColumns({"factor": F.coalesce("factor", F.lit(False)), "gross": F.coalesce("gross", F.array().cast("array<double>"))}).withColumn("exponent", F.when(F.col("category") == "chemistry", exponent))
    centres = columns.groupBy(*PAGE).agg(F.array_distinct(F.concat(F.collect_list("cx"), F.array(F.min("id_cx")))).alias("centres"))
    columns = columns.join(centres, PAGE)
    away = F.array_min(F.expr(f"filter(transform(centres, c -> abs(c - cx)), d -> d > page_width * {SAME_COLUMN})"))
    two_weights = (F.col("key") == "weight_kg") & F.exists("gross", lambda g: F.abs(g - F.col("cx")) < F.col("page_width") * SAME_PLACE)
    return columns.filter("category <> 'chemistry' or exponent is not null").select(
        *PAGE, "key", "category", F.col("text").alias("header"), "exponent", "centres", "cx", F.coalesce(away * NEIGHBOUR, F.col("page_width") * LONE_COLUMN).alias("tolerance"),
        two_weights.alias("two_weights"), (F.abs(F.col("cx") - F.col("id_cx")) < F.col("page_width") * SAME_PLACE).alias("beside_id"))


def recover_geometric_rows(blocks: DataFrame) -> DataFrame:
    """Product rows from aligned blocks: (doc_id, page, row_id, product_id, category, key, text, exponent).

    blocks: doc_id, page, block_id (order of reading), text, x0, x1, top, bottom, page_width, page_height, and optionally
    confidence. Rows are the bands between the middles of neighbouring identifiers, ``row_id`` counts them down the page;
    two rolls that print one identifier are two rows, two readings of one place are one. A block belongs to the header whose
    centre is within 45 percent of the distance to the next one. Chemistry without a declared scale is left out. A weight
    column that is also headed gross gives net and gross where a row has two numbers. Blocks without text take no part.
    """
    if "confidence" not in blocks.columns:
        blocks = blocks.withColumn("confidence", F.lit(0.0))
    # Written once: headers, anchors, scales and cells all read them.
    b = staged(blocks.filter("text is not null").select(*PAGE, "block_id", "text", "x0", "x1", "top", "bottom", "page_width", "page_height", "confidence"))
    b = b.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("top") + F.col("bottom")) / 2, "confidence": F.coalesce("confidence", F.lit(0.0))})
    heads = staged(map_headers(b, "text").filter("category <> 'unknown' and key is not null"))
    rows = staged(find_anchors(b, heads))
    columns = find_columns(b, heads, rows)
    packed = columns.groupBy(*PAGE).agg(F.collect_list(F.struct("key", "category", "header", "exponent", F.col("cx").alias("h_cx"), "tolerance", "two_weights", "beside_id")).alias("columns"), F.first("centres").alias("centres"))
    # The bands of a page follow one another, so a block lies in the last one that begins at or above its centre: one shuffle
    # by page serves this and the join with the columns.
    bands = rows.filter("low is not null and high is not null").select(*PAGE, F.col("low").alias("at"), F.struct("row_id", "product_id", "low", "high", F.col("cy").alias("a_cy"), F.col("block_id").alias("anchor_id")).alias("band"))
    body = b.select(*PAGE, "block_id", "text", "x0", "x1", "top", "bottom", "confidence", F.col("cy").alias("at"))
    down = Window.partitionBy(*PAGE).orderBy("at", F.col("band").isNull(), "band.row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = body.unionByName(bands, allowMissingColumns=True).withColumns({"_block": F.col("band").isNull(), "band": F.last("band", ignorenulls=True).over(down)})
    inside = both.filter("_block and at < band.high").select(*PAGE, "block_id", "text", "x0", "x1", "top", "bottom", "confidence", F.col("at").alias("cy"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), "band.*")
    inside = inside.filter(F.col("bottom") - F.col("top") < F.greatest(F.col("high") - F.col("low"), F.lit(LEAST_BAND)) * TALL_BLOCK)
    placed = inside.join(packed, PAGE).filter("size(filter(centres, c -> x0 < c and c < x1)) < 2")
    placed = placed.withColumn("c", F.explode(F.filter("columns", lambda c: F.abs(F.col("cx") - c["h_cx"]) <= c["tolerance"]))).select("*", "c.*")
    placed = placed.filter(~(F.col("beside_id") & (F.col("key") == "heat_no") & (F.col("block_id") == F.col("anchor_id"))))

    text, chemistry = F.trim("text"), F.col("category") == "chemistry"
    marked = tx.is_ditto(text)
    size = F.col("key").isin("thickness_mm", "width_mm", "length_m") & tx.dimension_value(text, F.col("header")).isNotNull()
    number = text.rlike(r"(?i)^(?:[\d.,]+|COIL|C|ROLLO|[\d.,]+[x×*][\d.,]+[x×*]C)$") | (chemistry & text.rlike(r"^\d+=$")) | size
    placed = placed.filter(~F.col("category").isin("dimension", "mechanical", "chemistry") | marked | number)
    height, width = F.col("bottom") - F.col("top"), F.col("x1") - F.col("x0")
    aside = F.abs(F.col("cx") - F.col("h_cx"))
    rank = F.struct(
        (~marked).alias("a"), F.when(F.col("key") == "heat_no", -F.col("confidence")).otherwise(0.0).alias("b"), F.when(chemistry & (F.col("exponent") == 0), aside).otherwise(0.0).alias("c"),
        (chemistry & (height < (F.col("high") - F.col("low")) / 2)).alias("d"), F.when(chemistry, width).otherwise(0.0).alias("e"),
        ((F.col("key") == "label_no") & (F.size(identifiers(text)) == 0)).alias("f"), F.abs(F.col("cy") - F.col("a_cy")).alias("g"), aside.alias("h"), "block_id")
    weights = F.array_sort(F.collect_list(F.when(F.col("two_weights") & text.rlike(r"^[\d.,]+$"), F.struct("top", "block_id", text.alias("text")))))
    row = [*PAGE, "row_id", "product_id"]
    cells = placed.groupBy(*row, "category", "key", "exponent").agg(F.min_by(text, rank).alias("text"), weights.alias("weights"))
    pair = F.size("weights") == 2
    value = F.when(chemistry, F.regexp_replace("text", "=$", "")).when(F.col("key") == "label_no", F.regexp_replace("text", r"^\d{1,3}(?=[A-Za-z])", "")).when(pair, F.col("weights")[0]["text"]).otherwise(F.col("text"))
    entry = lambda key, of: F.struct(key.alias("key"), of.alias("text"))
    entries = F.when(pair, F.array(entry(F.col("key"), value), entry(F.lit("net_weight_kg"), F.col("weights")[0]["text"]), entry(F.lit("gross_weight_kg"), F.col("weights")[1]["text"]))).otherwise(F.array(entry(F.col("key"), value)))
    found = cells.select(*row, "category", "exponent", F.inline(entries)).select(*row, "category", "key", "text", "exponent")
    # A pack number is the roll's identifier and its label.
    labels = rows.filter("pack").select(*row, F.lit("label").alias("category"), F.lit("label_no").alias("key"), F.col("product_id").alias("text"), F.lit(None).cast("int").alias("exponent"))
    return found.join(labels.select(*row, "key"), [*row, "key"], "left_anti").select(*labels.columns).unionByName(labels)
