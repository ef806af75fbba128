"""Recognising table headers, fields, titles and layouts in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millspark.functions import text as tx
from millspark.functions import vocabulary as voc


def map_headers(cells: DataFrame, column: str = "header") -> DataFrame:
    """Adds category, key and exponent of each header text.

    Distinct texts are matched once. An alias matches a whole header, its first words or its last words, so each
    header looks up at most nine keys by equality instead of being compared with every alias.
    """
    spark = cells.sparkSession
    longest = max(len(word.split()) for _, word, _ in voc.word_lists(voc.HEADER_WORDS))
    texts = cells.select(F.col(column).alias("_header")).filter("_header is not null").distinct()
    texts = texts.withColumn("_clean", tx.normalize_term(F.col("_header"))).withColumn("_words", F.split("_clean", " "))
    n = F.size("_words")
    heads = [F.array_join(F.slice("_words", 1, F.least(n, F.lit(i))), " ") for i in range(1, longest + 1)]
    tails = [F.array_join(F.slice("_words", F.greatest(n - i + 1, F.lit(1)), F.least(n, F.lit(i))), " ") for i in range(1, longest + 1)]
    keys = texts.select("_header", "_clean", F.explode(F.array_distinct(F.array(
        F.struct(F.lit("alias").alias("kind"), F.col("_clean").alias("text")),
        F.struct(F.lit("compact").alias("kind"), F.replace("_clean", F.lit(" "), F.lit("")).alias("text")),
        *[F.struct(F.lit("alias").alias("kind"), part.alias("text")) for part in heads + tails]))).alias("k"))
    aliases = voc.header_aliases(spark)
    lookup = aliases.select(F.lit("alias").alias("kind"), F.col("alias").alias("text"), "category", "key", "precedence").unionByName(
        aliases.filter("precedence >= 10").select(F.lit("compact").alias("kind"), F.col("compact").alias("text"), "category", "key", "precedence"))
    hits = keys.select("_header", "_clean", "k.kind", "k.text").join(F.broadcast(lookup), ["kind", "text"])
    # The special whole-header words only count when they are the whole header.
    hits = hits.filter("precedence >= 10 or text = _clean")
    named = hits.groupBy("_header").agg(F.min_by(F.struct("category", "key"), "precedence").alias("named"))
    tokens = texts.select("_header", F.posexplode(F.concat("_words", F.array(F.replace("_clean", F.lit(" "), F.lit(""))))).alias("at", "word"))
    elements = tokens.join(F.broadcast(voc.element_aliases(spark)), "word").groupBy("_header").agg(F.min_by("element", "at").alias("element"))
    resolved = texts.select("_header").join(named, "_header", "left").join(elements, "_header", "left").select(
        "_header", F.coalesce("named.category", F.when(F.col("element").isNotNull(), "chemistry"), F.lit("unknown")).alias("category"),
        F.coalesce("named.key", "element").alias("key"))
    out = cells.join(resolved, cells[column] == resolved["_header"], "left").drop("_header")
    return out.withColumns({
        "category": F.coalesce("category", F.lit("unknown")),
        "exponent": F.when(F.col("category") == "chemistry", tx.scale_exponent(F.col(column)))})


def element_of(column: str) -> Column:
    """Element symbol of a chemistry label that is exactly one alias; otherwise the label itself."""
    words = {word.replace(" ", ""): element for element, word, _ in voc.word_lists(voc.ELEMENT_WORDS)}
    pairs = [F.lit(text) for pair in words.items() for text in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), tx.compact_term(F.col(column))), F.trim(column))


def _aliases() -> str:
    rows = [f"named_struct('field', '{f}', 'alias', '{w}', 'place', {-i})" for f, w, i in voc.word_lists(voc.FIELD_WORDS)]
    return f"array({', '.join(rows)})"


def identify_fields(df: DataFrame, column: str) -> DataFrame:
    """Adds field and score (hundredths): 99 exact, 92 at an end, 84 inside; the best score wins, then list order."""
    best = f"""array_max(filter(transform({_aliases()}, a -> struct(case when _term = a.alias then 99
        when startswith(_term, a.alias) or endswith(_term, a.alias) then 92
        when length(a.alias) >= 4 and contains(_term, a.alias) then 84 else 0 end as score, a.place as place, a.field as field)), x -> x.score > 0))"""
    # Exploded one-element arrays: a filter on the result stays above them, and does not normalize the text again for each alias.
    out = df.select("*", F.explode(F.array(tx.normalize_term(F.col(column)))).alias("_term"))
    out = out.select("*", F.explode(F.array(F.expr(f"if(_term = '', null, {best})"))).alias("_best"))
    return out.select("*", F.col("_best.field").alias("field"), F.col("_best.score").alias("score")).drop("_term", "_best")


def detect_documents(docs: DataFrame, column: str = "text") -> DataFrame:
    """Adds kind and score (hundredths): title 45, identifiers 25, chemistry 20, dimensions 10."""
    term = tx.normalize_term(F.col(column))
    df = docs.withColumn("_term", term)
    has = lambda *fields: F.greatest(*[F.col("_term").contains(w) for f, w, _ in voc.word_lists(voc.FIELD_WORDS) if f in fields])
    title = F.greatest(*[F.col("_term").contains(t) for t in voc.TITLES])
    df = df.withColumns({"_title": title, "_identity": has("product_id", "heat_no"), "_chemistry": has("chemistry"),
                         "_size": has("thickness_mm", "width_mm"), "_weight": has("weight_kg"), "_yield": has("yield_strength_mpa")})
    points = lambda c, n: F.when(c, n).otherwise(0)
    df = df.withColumn("score", points(F.col("_title"), 45) + points(F.col("_identity"), 25) + points(F.col("_chemistry"), 20)
                       + points(F.col("_size") | F.col("_weight"), 10))
    material = F.col("_chemistry") | F.col("_size") | F.col("_yield")
    return df.withColumn("kind", F.when((F.col("score") >= 65) & F.col("_identity") & material, "mill_certificate").when(
        (F.col("score") >= 35) & (F.col("_identity") | material), "possible_mill_certificate").otherwise("unknown")).drop(
        "_term", "_title", "_identity", "_chemistry", "_size", "_weight", "_yield")


def score_profiles(docs: DataFrame, column: str = "text") -> DataFrame:
    """Adds profile and profile_score: the best known layout at or over the threshold, else null and 0."""
    df = docs.withColumn("_term", tx.normalize_term(F.col(column))).withColumn("_compact", F.replace("_term", F.lit(" "), F.lit("")))
    said = lambda signal: F.col("_term").contains(signal) | F.col("_compact").contains(signal.replace(" ", ""))
    best = None
    for i, (name, required, weighted, negative) in enumerate(voc.PROFILES):
        score = F.lit(0.50)
        for signal, weight in weighted:
            score = score + F.when(said(signal), weight).otherwise(0.0)
        score = F.least(F.round(score, 2), F.lit(1.0))
        ok = F.lit(True)
        for signal in required:
            ok = ok & said(signal)
        for signal in negative:
            ok = ok & ~said(signal)
        entry = F.when(ok & (score >= voc.PROFILE_THRESHOLD), F.struct(score.alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")))
        best = entry if best is None else F.greatest(best, entry)
    return df.withColumn("_best", best).select("*", F.col("_best.name").alias("profile"), F.coalesce("_best.score", F.lit(0.0)).alias("profile_score")).drop(
        "_term", "_compact", "_best")


def detect_tables(cells: DataFrame) -> DataFrame:
    """Best header row among the first six of each table: two fields or more, mean score times field share."""
    found = identify_fields(cells.filter("row_idx < 6"), "text").filter("field is not null")
    rows = found.groupBy("doc_id", "page", "table_idx", "row_idx").agg(
        F.sum("score").alias("total"), F.count("*").alias("n"), F.size(F.collect_set("field")).alias("fields"))
    # At most ten fields exist, so the set above is bounded.
    scored = rows.filter("fields >= 2").withColumn("score", F.expr(
        "least(9900, cast(total * 100 * least(4, fields) / (n * 4) as int))"))
    best = scored.groupBy("doc_id", "page", "table_idx").agg(F.max(F.struct("score", (-F.col("row_idx")).alias("r"), "fields")).alias("b"))
    sizes = cells.groupBy("doc_id", "page", "table_idx").agg((F.max("row_idx") + 1).alias("rows"))
    return best.join(sizes, ["doc_id", "page", "table_idx"]).select(
        "doc_id", "page", "table_idx", (-F.col("b.r")).alias("header_row"), F.col("b.fields").alias("fields"),
        F.col("b.score").alias("score_bp"), (F.col("rows") + F.col("b.r") - 1).alias("row_count"))


def route_documents(docs: DataFrame) -> DataFrame:
    """Adds route and status from needs_ocr, n_templates, explicit_template, profile_usable, generic_rows, kind."""
    route = (F.when(F.col("needs_ocr"), "needs_ocr")
             .when(F.col("explicit_template") & (F.col("n_templates") != 1), "incompatible_template")
             .when(F.col("explicit_template"), "user_template")
             .when(F.col("n_templates") > 1, "ambiguous_user_templates")
             .when(F.col("profile").isNotNull() & F.col("profile_usable"), "known_profile")
             .when(F.col("n_templates") == 1, "user_template")
             .when(F.col("generic_rows") > 0, "generic_layout_extractor").otherwise("none"))
    status = (F.when(route == "needs_ocr", "needs_ocr").when(route == "known_profile", "extracted")
              .when((route == "none") & (F.col("kind") == "unknown") & F.col("profile").isNull(), "unsupported").otherwise("needs_review"))
    return docs.withColumns({"route": route, "status": status})


def page_readability(words: DataFrame, minimum_characters: int = 20) -> DataFrame:
    """Pages as digital or unreadable: enough characters and under 70 percent single letters or digits."""
    clean = F.trim("word")
    single = clean.rlike(r"^[A-Za-z0-9]$")
    pages = words.groupBy("doc_id", "page").agg(F.count("*").alias("words"), F.sum(F.length(clean)).alias("characters"), F.count_if(single).alias("single"))
    return pages.withColumn("source", F.when((F.col("characters") >= minimum_characters) & (F.col("single") * 10 < F.col("words") * 7), "digital").otherwise("unreadable"))


def split_merged_headers(blocks: DataFrame) -> DataFrame:
    """Headers that were read as one block ('Y.S.T.S.', 'CuNi') become one row per part with its share of the box."""
    parts = F.regexp_extract_all("text", F.lit(r"(Y\.S\.|T\.S\.|Cu|Ni)"), 1)
    whole = F.replace(F.array_join(parts, ""), F.lit("."), F.lit("")) == F.replace(F.replace("text", F.lit("."), F.lit("")), F.lit(" "), F.lit(""))
    pieces = F.when((F.size(parts) > 1) & whole, parts).otherwise(F.array("text"))
    df = blocks.withColumn("_parts", pieces).withColumn("_share", (F.col("x1") - F.col("x0")) / F.size("_parts"))
    rest = [c for c in blocks.columns if c not in ("text", "x0", "x1")]
    return df.select(*rest, "x0", "_share", F.posexplode("_parts").alias("part", "text")).select(
        *rest, "part", "text", (F.col("x0") + F.col("part") * F.col("_share")).alias("x0"), (F.col("x0") + (F.col("part") + 1) * F.col("_share")).alias("x1"))
