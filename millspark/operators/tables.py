"""Tables on pages and worksheets to product rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millspark.functions import text as tx
from millspark.functions import vocabulary as voc
from millspark.operators.headers import map_headers
from millspark.session import staged

TABLE = ["doc_id", "page", "table_idx"]
GROUP_WORDS = "quimic|chem|dimens|propied|mecanic|identific|composition|mechanical|成分"


def find_header_rows(cells: DataFrame) -> DataFrame:
    """Header columns of each table: the row among the first four that identifies most columns.

    A row with a group word and empty cells is a group header: its texts spread to the right and join the row below.
    Only the first five rows of a table take part, so the row groups here are bounded by the width of a table.
    """
    top = cells.filter("row_idx <= 4").withColumn("text", F.coalesce(F.trim("text"), F.lit("")))
    rows = top.groupBy(*TABLE, "row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "text"))), lambda c: c["text"]), " ").alias("_line"),
                                              F.count_if(F.col("text") == "").alias("_blank"))
    across = Window.partitionBy(*TABLE, "row_idx").orderBy("col_idx")
    spread = top.withColumn("_group", F.last(F.nullif("text", F.lit("")), ignorenulls=True).over(across))
    grouped = rows.filter((F.col("_blank") > 0) & tx.normalize_term(F.col("_line")).rlike(GROUP_WORDS)).select(*TABLE, "row_idx")
    below = rows.select(*TABLE, (F.col("row_idx") - 1).alias("row_idx"))
    grouped = grouped.join(below, [*TABLE, "row_idx"], "left_semi").withColumn("_is_group", F.lit(True))
    starts = top.select(*TABLE, "row_idx").distinct().filter("row_idx < 4").join(grouped, [*TABLE, "row_idx"], "left").select(
        *TABLE, F.col("row_idx").alias("start_row"), F.coalesce("_is_group", F.lit(False)).alias("is_group"))
    starts = starts.withColumn("row_idx", F.col("start_row") + F.col("is_group").cast("int"))
    heads = spread.select(*TABLE, F.col("row_idx").alias("start_row"), "col_idx", "_group")
    target = top.join(starts, [*TABLE, "row_idx"]).join(heads, [*TABLE, "start_row", "col_idx"], "left")
    target = target.withColumn("_g", F.when(F.col("is_group"), F.coalesce("_group", F.lit(""))).otherwise("")).withColumn("header", F.trim(F.concat_ws(" ", "_g", "text")))
    mapped = staged(map_headers(staged(target), "header"))
    alone = map_headers(mapped.filter("category = 'unknown' and _g <> '' and text <> ''").select("text").distinct(), "text").select(
        "text", F.col("category").alias("_c"), F.col("key").alias("_k"), F.col("exponent").alias("_e"))
    mapped = mapped.join(alone, "text", "left")
    retry = (F.col("category") == "unknown") & (F.col("_g") != "") & (F.col("text") != "")
    mapped = mapped.withColumns({"category": F.when(retry, F.coalesce("_c", F.lit("unknown"))).otherwise(F.col("category")), "key": F.when(retry, F.col("_k")).otherwise(F.col("key")),
                                 "exponent": F.when(retry, F.col("_e")).otherwise(F.col("exponent"))})
    mapped = mapped.withColumn("exponent", F.when((F.col("category") == "chemistry") & (F.col("_g") != ""), F.coalesce("exponent", tx.scale_exponent(F.col("_g")))).otherwise(F.col("exponent")))
    score = mapped.groupBy(*TABLE, "start_row").agg(F.count_if(F.col("category") != "unknown").alias("identified"))
    best = score.filter("identified > 0").groupBy(*TABLE).agg(F.max(F.struct("identified", (-F.col("start_row")).alias("r"))).alias("b")).select(*TABLE, (-F.col("b.r")).alias("start_row"))
    return mapped.join(best, [*TABLE, "start_row"]).select(*TABLE, F.col("row_idx").alias("header_row"), "col_idx", "header", "category", "key", "exponent")


def table_rows(cells: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values, used cells): one row per product row and mapped field, from the rows below the header.

    Blank and total rows are skipped, chemistry without a scale stays evidence, and a row needs a product id.
    """
    columns = staged(columns)
    usable = columns.filter("category <> 'unknown' and not (category = 'chemistry' and exponent is null)")
    identified = columns.filter(F.col("category").isin("product_id", "heat_no")).select(*TABLE).distinct()
    heads = columns.groupBy(*TABLE).agg(F.max("header_row").alias("header_row")).join(identified, TABLE, "left_semi")
    body = cells.withColumn("text", F.trim("text")).filter("text <> ''").join(heads, TABLE).filter("row_idx > header_row")
    first = body.groupBy(*TABLE, "row_idx").agg(F.min_by("text", "col_idx").alias("_first"))
    kept = first.filter(~tx.normalize_term(F.col("_first")).contains("total")).select(*TABLE, "row_idx")
    mapped = body.join(kept, [*TABLE, "row_idx"], "left_semi").join(usable.select(*TABLE, "col_idx", "category", "key", "exponent"), [*TABLE, "col_idx"])
    mapped = staged(mapped)
    with_id = mapped.filter("category = 'product_id'").groupBy(*TABLE, "row_idx").agg(F.max_by("text", "col_idx").alias("product_id"))
    values = staged(mapped.join(with_id, [*TABLE, "row_idx"]))
    fields = values.groupBy(*TABLE, "row_idx", "product_id", "category", "key").agg(F.max_by(F.struct("text", "exponent"), "col_idx").alias("v"))
    fields = fields.select(*TABLE, "row_idx", "product_id", "category", "key", "v.text", "v.exponent")
    return fields, values.select(*TABLE, "row_idx", "col_idx")


def unmapped_evidence(blocks: DataFrame, cells: DataFrame, used: DataFrame) -> DataFrame:
    """(kind, doc_id, page, text) of blocks that are no metadata label in the upper page, and cells nothing consumed."""
    labels = F.array(*[F.lit(w) for _, w, _ in voc.word_lists(voc.METADATA_WORDS)])
    label = tx.normalize_term(F.get(F.split("text", "[:：\\-]", 2), F.lit(0)))
    is_label = (F.col("top") <= F.col("height") * 0.45) & F.array_contains(labels, label)
    free = blocks.filter((F.trim("text") != "") & ~is_label).select(F.lit("text_block").alias("kind"), "doc_id", "page", "text")
    rest = cells.filter("trim(text) <> ''").join(used, [*TABLE, "row_idx", "col_idx"], "left_anti").select(F.lit("table_cell").alias("kind"), "doc_id", "page", "text")
    return free.unionByName(rest)


# --- fixed values: worksheet header texts ---
SHEET_FIELDS = {
    "heat_no": ("HEAT NO.", "HEAT NO", "HEAT NUMBER", "CAST NO", "CAST NO."), "label_no": ("COIL NO", "COIL NO."), "source_certificate_no": ("MILL NO",),
    "standard": ("SPEC(MILL CERTIFICATE)", "ORDERING SPEC", "SPEC"), "width": ("WIDTH(MM)", "WIDTH"), "thickness": ("THICK(MM)", "THICK"),
    "description": ("PRODUCTION NAME", "PRODUCT NAME"), "length": ("LENGTH", "LENGTH(MM)"), "weight_mt": ("COIL WEIGHT(MT)",), "weight_kg": ("WEIGHT(KG)",),
}


def sheet_headers(cells: DataFrame) -> DataFrame:
    """Header cells of each sheet: the first of 40 rows with width and thickness, or with specification columns."""
    head = cells.filter("row <= 40 and value is not null").withColumn("label", F.replace(F.upper(F.trim(F.regexp_replace("value", r"\s+", " "))), F.lit(" ("), F.lit("(")))
    has = lambda *names: F.count_if(F.col("label").isin(*names)) > 0
    rows = head.groupBy("sheet", "row").agg((has("WIDTH", "WIDTH(MM)") & has("THICK", "THICK(MM)")).alias("_product"),
                                            (has("SPEC") & has("ALLOY OR NON-ALLOY") & (F.count_if(F.col("label").contains("YIELD POINT")) > 0)).alias("_spec"))
    first = rows.filter("_product or _spec").groupBy("sheet").agg(F.min(F.struct("row", "_spec")).alias("h")).select("sheet", F.col("h.row").alias("row"), F.col("h._spec").alias("is_spec"))
    return head.join(first, ["sheet", "row"]).groupBy("sheet", F.col("row").alias("header_row"), "is_spec", "label").agg(F.min("col").alias("col"))


def sheet_products(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products, chemistry) of worksheets with width and thickness columns.

    Product words give form, rolling and coil; tonnes become kilograms; zero means unknown; a repeated element column
    and a value outside 0..100 are withheld.
    """
    # Written, so that Spark knows how small the header rows are: cells are not gathered by sheet or column to meet few of them.
    heads = staged(sheet_headers(cells).filter("not is_spec"))
    body = cells.join(heads.select("sheet", "header_row").distinct(), "sheet").filter("row > header_row")
    # Labels are a short fixed list, so the pivot is a plain conditional aggregation.
    labels = sorted({label for group in SHEET_FIELDS.values() for label in group})
    values = cells.filter("not is_formula").join(heads.filter(F.col("label").isin(*labels)), ["sheet", "col"]).filter("row > header_row")
    wide = values.groupBy("sheet", "row").agg(*[F.max(F.when(F.col("label") == label, F.col("value"))).alias(label) for label in labels])
    pick = lambda name: F.coalesce(*[F.nullif(F.trim(F.col(f"`{label}`")), F.lit("")) for label in SHEET_FIELDS[name]])
    df = wide.select("sheet", "row", *[pick(name).alias(name) for name in SHEET_FIELDS]).filter("width is not null or thickness is not null")
    words, mm = F.upper(F.coalesce("description", F.lit(""))), F.lit("mm")
    positive = lambda c: F.when(c > 0, c)
    number = lambda c: F.col(c).try_cast("decimal(18,6)")
    by_length = tx.is_coil_word(F.col("length"))
    coiled = F.when(words.contains("COIL") | by_length, True).when(words.contains("PLATE"), False)
    products = df.select(
        F.concat("sheet", F.lit("!row-"), F.col("row").cast("string")).alias("product_id"), "sheet", "row", "heat_no", "label_no", "standard",
        positive(tx.dimension_value(F.col("width"), mm)).alias("width_mm"), positive(tx.dimension_value(F.col("thickness"), mm)).alias("thickness_mm"),
        F.when(words.rlike("SHEET|STRIP|PLATE"), "flat_rolled").alias("form"),
        F.when(words.rlike("HOT[ -]ROLLED"), "hot").when(words.rlike("COLD[ -]ROLLED"), "cold").alias("rolling"), coiled.alias("coiled"),
        F.when(~F.coalesce(coiled, F.lit(False)), positive(number("length")) / 1000).cast("decimal(18,6)").alias("length_m"),
        F.coalesce(positive(number("weight_mt") * 1000), positive(number("weight_kg"))).cast("decimal(18,6)").alias("weight_kg"))
    symbols = {e.upper(): e for e in {e for e, _, _ in voc.word_lists(voc.ELEMENT_WORDS)} if "_" not in e}
    element = F.try_element_at(F.create_map(*[F.lit(x) for pair in symbols.items() for x in pair]), F.col("label"))
    columns = cells.join(heads.select("sheet", "header_row").distinct(), "sheet").filter("row = header_row and value is not null").select(
        "sheet", "col", F.upper(F.trim("value")).alias("label")).withColumn("element", element).filter("element is not null")
    repeated = columns.groupBy("sheet", "element").agg(F.min("col").alias("col"), (F.count("*") > 1).alias("repeated"))
    chem = body.join(repeated, ["sheet", "col"]).withColumn("_v", F.when(~F.col("is_formula"), F.col("value").try_cast("decimal(18,8)")))
    chem = chem.join(products.select("sheet", "row", "product_id"), ["sheet", "row"])
    return products, chem.select("product_id", "element", F.when(~F.col("repeated") & F.col("_v").between(0, 100), F.col("_v")).alias("percentage"))


def sheet_specifications(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """(specification, alloy claim, yield bound) rows; a merged cell speaks for every row it covers."""
    from millspark.operators.normalize import parse_yield_bounds
    heads = sheet_headers(cells).filter("is_spec")
    place = heads.groupBy("sheet", "header_row").agg(
        F.max(F.when(F.col("label") == "SPEC", F.col("col"))).alias("spec_col"), F.max(F.when(F.col("label") == "ALLOY OR NON-ALLOY", F.col("col"))).alias("alloy_col"),
        F.max(F.when(F.col("label").contains("YIELD POINT"), F.col("col"))).alias("yield_col"))
    rows = cells.join(place, "sheet").filter("row > header_row and col = spec_col and value is not null and not is_formula").select("sheet", "row", F.col("value").alias("specification"), "alloy_col", "yield_col")
    # A merge is spread over the rows it covers, so cells meet merges by equality.
    covered = merges.select("sheet", "min_row", "min_col", F.explode(F.sequence("min_row", "max_row")).alias("row"), F.explode(F.array("min_col")).alias("col"), "max_col")
    covered = covered.select("sheet", "min_row", "min_col", "row", F.explode(F.sequence("min_col", "max_col")).alias("col"))
    def resolved(name: str, column: str) -> DataFrame:
        at = rows.select("sheet", "row", F.col(column).alias("col")).join(covered, ["sheet", "row", "col"], "left")
        source = at.select("sheet", "row", F.coalesce("min_row", "row").alias("source_row"), F.coalesce("min_col", "col").alias("col"))
        return source.join(cells.select("sheet", F.col("row").alias("source_row"), "col", F.trim("value").alias(name)), ["sheet", "source_row", "col"], "left").select(
            "sheet", "row", name, (F.col("source_row") != F.col("row")).alias(f"{name}_inherited"))
    df = rows.select("sheet", "row", "specification").join(resolved("alloy_claim", "alloy_col"), ["sheet", "row"]).join(resolved("yield_text", "yield_col"), ["sheet", "row"])
    return parse_yield_bounds(df, "yield_text")


def join_related(products: DataFrame, entries: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Related-table values joined to product rows by key, and diagnostics: join_ambiguous, join_missing, join_conflict."""
    counts = entries.groupBy(key).agg(F.count("*").alias("_n"))
    tagged = entries.join(counts, key, "left").withColumn("_ok", F.coalesce((F.col(key) != "") & (F.col("_n") == 1), F.lit(False)))
    ambiguous = tagged.filter("not _ok").select(F.lit("join_ambiguous").alias("code"), F.col(key).alias("key"))
    single = tagged.filter("_ok").select(key, F.col(value).alias("_new"))
    joined = products.join(single, key, "left")
    lost = single.join(products.select(key), key, "left_anti").select(F.lit("join_missing").alias("code"), F.col(key).alias("key"))
    bare = products.join(single.select(key), key, "left_anti").select(F.lit("join_missing").alias("code"), F.col(key).alias("key"))
    conflict = joined.filter(F.col(value).isNotNull() & F.col("_new").isNotNull() & (F.col(value) != F.col("_new"))).select(F.lit("join_conflict").alias("code"), F.col(key).alias("key"))
    out = joined.withColumn(value, F.coalesce(value, "_new")).drop("_new")
    return out, ambiguous.unionByName(lost).unionByName(bare).unionByName(conflict)
