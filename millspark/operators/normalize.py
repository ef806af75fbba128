"""Normalization jobs: text cells to exact decimals, dates and flags, one projection per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millspark.functions import text as tx


def normalize_chemistry(rows: DataFrame, value: str, header: str) -> DataFrame:
    """Adds exponent, percentage and error from a raw cell and the header that scales it."""
    df = rows.withColumn("exponent", tx.scale_exponent(F.col(header)))
    return df.withColumn("_c", tx.scaled_percentage(F.col(value), F.col("exponent"))).select(
        "*", F.col("_c.percentage").alias("percentage"), F.col("_c.error").alias("error")).drop("_c")


def normalize_dimensions(rows: DataFrame, thickness: str = "thickness_raw", width: str = "width_raw", length: str = "length_raw",
                         thickness_header: str | None = None) -> DataFrame:
    """Adds thickness_mm, width_mm, coiled, length_m and an error code for cells that do not parse."""
    header = F.col(thickness_header) if thickness_header else F.lit("")
    coiled = tx.is_coil_word(F.col(length))
    df = rows.withColumns({
        "thickness_mm": tx.dimension_value(F.col(thickness), header), "width_mm": tx.dimension_value(F.col(width), F.lit("mm")),
        "coiled": coiled, "length_m": F.when(~coiled, tx.dimension_value(F.col(length), F.lit("m"), length=True)),
    })
    return df.withColumn("dimension_error", F.expr(
        f"array_join(array_compact(array(if({thickness} is not null and thickness_mm is null, 'thickness', null), "
        f"if({width} is not null and width_mm is null, 'width', null), "
        f"if({length} is not null and not coiled and length_m is null, 'length', null))), ',')"))


def split_sizes(df: DataFrame, size: str, header: str) -> DataFrame:
    """'t x w [x C or length]' into thickness, width, coiled and length; imperial tuples need a thickness header."""
    parts = F.split(F.col(size), r"[xX×*]")
    imperial = tx.dimension_unit(F.concat_ws(" ", size, header)).isin("in", "ft") & ~F.col(header).rlike("(?i)thickness|espesor")
    usable = (F.size(parts) >= 2) & ~F.coalesce(imperial, F.lit(False))
    third = F.get(parts, F.lit(2))
    coil = F.coalesce(F.upper(third).startswith("C"), F.lit(False))
    return df.withColumns({
        "thickness_mm": F.when(usable, tx.dimension_value(F.get(parts, F.lit(0)), F.col(header))),
        "width_mm": F.when(usable, tx.dimension_value(F.get(parts, F.lit(1)), F.col(header))),
        "coiled": F.when(usable & coil, F.lit(True)),
        "length_m": F.when(usable & ~coil, tx.dimension_value(third, F.when(F.col(header) == "", "mm").otherwise(F.col(header)), length=True)),
    })


def normalize_headers_metadata(docs: DataFrame, text: str, standard: str, maker: str, date_text: str) -> DataFrame:
    """Adds certificate_date, manufacturer_key, grade, rolling and zinc coating from header texts."""
    corpus = tx.compact_term(F.col(text))
    cold, hot = corpus.contains("coldrolled"), corpus.contains("hotrolled")
    return docs.withColumns({
        "certificate_date": tx.certificate_date(F.col(date_text)), "manufacturer_key": tx.name_key(F.col(maker)),
        "grade": F.nullif(F.regexp_extract(F.col(standard), r"(?i)^SAE\s+(\d{4})$", 1), F.lit("")),
        "rolling": F.when(cold & ~hot, "cold").when(hot & ~cold, "hot"),
        "zinc_electrolytic": corpus.contains("egcoil") & corpus.contains("zn"),
    })


def product_names(blocks: DataFrame) -> DataFrame:
    """First block per document that names a rolled product, and the first that looks like a company."""
    from millspark.functions.keyed import first_by
    product = F.col("text").rlike(r"(?i)\b(?:hot|cold)[ -]+rolled\b.*\b(?:coil|sheet|strip|plate)\b")
    company = F.col("text").rlike(r"(?i)\b(?:corporation|company|co\.?\s*,?\s*ltd\.?|s\.?a\.?)\s*$")
    found = blocks.select("doc_id", "position", "text", product.alias("p"), company.alias("c")).filter("p or c")
    names = first_by(found.filter("p").select("doc_id", "position", F.col("text").alias("product_name")), ["doc_id"], ["position"]).drop("position")
    makers = first_by(found.filter("c").select("doc_id", "position", F.col("text").alias("supplier")), ["doc_id"], ["position"]).drop("position")
    return names.join(makers, "doc_id", "full_outer")


def derive_product_flags(df: DataFrame, superior: str, inferior: str, conditions: str) -> DataFrame:
    """Adds coating_both_sides and pickled. Any bare face means one-sided; unknown stays unknown."""
    words = F.transform(F.col(conditions), lambda c: F.lower(c))
    listed = lambda *values: F.coalesce(F.arrays_overlap(words, F.array(*[F.lit(v) for v in values])), F.lit(False))
    return df.withColumns({
        "coating_both_sides": F.when((F.col(superior) == 0) | (F.col(inferior) == 0), False).when(
            F.col(superior).isNotNull() & F.col(inferior).isNotNull(), (F.col(superior) > 0) & (F.col(inferior) > 0)),
        "pickled": F.when(listed("pickled", "decapado"), True).when(listed("not_pickled", "unpickled", "sin decapar"), False),
    })


def parse_yield_bounds(df: DataFrame, column: str) -> DataFrame:
    """Adds bound_operator, bound_value from '>= 355', '≤400', '355'."""
    pattern = r"^(<=|>=|<|>|≤|≥|≧|≦)?\s*(\d+(?:\.\d+)?)$"
    clean = F.trim(F.regexp_replace(F.col(column), r"\s+", " "))
    sign = F.regexp_extract(clean, pattern, 1)
    value = F.regexp_extract(clean, pattern, 2)
    return df.withColumns({
        "bound_operator": F.when(value != "", F.when(sign.isin("≤", "≦"), "<=").when(sign.isin("≥", "≧"), ">=").when(sign == "", "=").otherwise(sign)),
        "bound_value": F.nullif(value, F.lit("")).try_cast("decimal(18,6)"),
    })


def format_codes(df: DataFrame) -> DataFrame:
    """Adds display_code 7209.16.01-99 (or the undetermined text) and its compact form."""
    dotted = F.concat_ws(".", F.substring("fraction", 1, 4), F.substring("fraction", 5, 2), F.substring("fraction", 7, 2))
    shown = F.when(F.col("fraction").isNull(), "Sin determinar").otherwise(F.concat_ws("-", dotted, "nico"))
    return df.withColumns({"display_code": shown, "compact_code": F.regexp_replace(shown, "[.-]", "")})


def period_bounds(df: DataFrame, preset: str, today: str) -> DataFrame:
    """Adds start_date and end_date of a period preset; both ends are inclusive."""
    days = F.when(F.col(preset).isin("day", "today"), 0).when(F.col(preset) == "week", 7).when(F.col(preset) == "month", 30)
    return df.withColumns({"start_date": F.date_sub(F.col(today), days), "end_date": F.when(days.isNotNull(), F.col(today))})


# --- fixed values: words of mechanical properties, with the property they name ("" = mechanical, no own name) ---
MECHANICAL_WORDS = (
    ("yield", "yield"), ("elastico", "yield"), ("tensile", "tensile"), ("resistencia", "tensile"), ("elongation", "elongation"),
    ("alargamiento", "elongation"), ("hardness", "hardness"), ("dureza", "hardness"), ("impact", "impact"), ("mecanic", ""),
)


def mechanical_rows(observations: DataFrame) -> DataFrame:
    """Observations of mechanical properties with the property they measure (else the last part of the path)."""
    path = F.lower("field_path")
    named = [F.when(path.contains(word), F.lit(name)) for word, name in MECHANICAL_WORDS if name]
    mechanical = path.rlike("|".join(word for word, _ in MECHANICAL_WORDS))
    return observations.filter(mechanical).withColumn("property", F.coalesce(*named, F.substring_index("field_path", ".", -1)))


def normalize_boxes(boxes: DataFrame) -> DataFrame:
    """Pixel boxes to upright page points: scale, turn clockwise, clamp to the page, round to 2 digits.

    Columns: x0, top, x1, bottom in pixels; image_width, image_height; page_width, page_height in points; rotation.
    """
    w, h, turn = F.col("page_width"), F.col("page_height"), F.pmod(F.col("rotation"), F.lit(360))
    scaled = boxes.withColumns({
        "x0": F.col("x0") * w / F.col("image_width"), "x1": F.col("x1") * w / F.col("image_width"),
        "top": F.col("top") * h / F.col("image_height"), "bottom": F.col("bottom") * h / F.col("image_height")})
    x0, x1, top, bottom = (F.col(c) for c in ("x0", "x1", "top", "bottom"))
    pick = lambda plain, quarter, half, three: F.when(turn == 90, quarter).when(turn == 180, half).when(turn == 270, three).otherwise(plain)
    turned = scaled.withColumns({
        "x0": pick(x0, h - bottom, w - x1, top), "x1": pick(x1, h - top, w - x0, bottom),
        "top": pick(top, x0, h - bottom, w - x1), "bottom": pick(bottom, x1, h - top, w - x0)})
    clamp = lambda c, size: F.round(F.greatest(F.lit(0.0), F.least(F.col(c), size)), 2)
    return turned.withColumns({"x0": clamp("x0", w), "x1": clamp("x1", w), "top": clamp("top", h), "bottom": clamp("bottom", h)})


def regions_to_boxes(regions: DataFrame) -> DataFrame:
    """Relative regions (0..1) to page boxes; a region without area or a page without size gives null boxes."""
    ok = F.expr("x0 < x1 and top < bottom and page_width > 0 and page_height > 0")
    scale = lambda c, size: F.when(ok, F.col(c) * F.col(size))
    return regions.select("*", scale("x0", "page_width").alias("box_x0"), scale("x1", "page_width").alias("box_x1"),
                          scale("top", "page_height").alias("box_top"), scale("bottom", "page_height").alias("box_bottom"))


def boxes_to_regions(boxes: DataFrame) -> DataFrame:
    return boxes.select("*", (F.col("box_x0") / F.col("page_width")).alias("rel_x0"), (F.col("box_x1") / F.col("page_width")).alias("rel_x1"),
                        (F.col("box_top") / F.col("page_height")).alias("rel_top"), (F.col("box_bottom") / F.col("page_height")).alias("rel_bottom"))
