"""Text, unit, date and geometry normalization."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millspark.functions import text as tx
from millspark.operators import normalize as nz
from workload.registry import Tables, query


@query(sql=r"SELECT cell_id, trim(regexp_replace(strip_accents(lower(header)), '[^\p{L}\p{N}_]+', ' ', 'g')) AS term FROM fx_header_cells")
def normalized_terms(t: Tables) -> DataFrame:
    return t.header_cells.select("cell_id", tx.normalize_term(F.col("header")).alias("term"))


@query(sql=r"""WITH x AS (SELECT cell_id, regexp_replace(translate(power_text, '⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺', '0123456789-+'), '\s+', '', 'g') AS s FROM fx_value_cells)
SELECT cell_id, CASE WHEN regexp_full_match(s, '-?\d+') AND NOT regexp_full_match(s, '10-\d+') THEN CAST(s AS INT) WHEN regexp_full_match(s, '10\^?\(?-?\d+\)?') THEN CAST(regexp_extract(s, '^10\^?\(?(-?\d+)', 1) AS INT) END AS exponent FROM x""")
def powers_of_ten(t: Tables) -> DataFrame:
    return t.value_cells.select("cell_id", tx.power_of_ten(F.col("power_text")).alias("exponent"))


@query(sql=r"""WITH x AS (SELECT cell_id, replace(lower(header), ' ', '') AS h FROM fx_header_cells)
SELECT cell_id, CASE WHEN regexp_matches(h, '[x×*/÷]10\^?[1-6](\D|$)') THEN -CAST(regexp_extract(h, '[x×*/÷]10\^?([1-6])', 1) AS INT) WHEN regexp_matches(h, '10\^?[-−]\d+') THEN -CAST(regexp_extract(h, '10\^?[-−](\d+)', 1) AS INT)
 WHEN contains(h, '10⁻⁴') THEN -4 WHEN contains(h, '10⁻³') THEN -3 WHEN contains(h, '10⁻²') THEN -2 WHEN regexp_matches(h, '[*x/]10000') THEN -4 WHEN regexp_matches(h, '[*x/]1000') THEN -3 WHEN regexp_matches(h, '[*x/]100') THEN -2
 WHEN contains(h, 'ppm') THEN -4 WHEN contains(h, '%') THEN 0 END AS exponent FROM x""")
def header_scales(t: Tables) -> DataFrame:
    return t.header_cells.select("cell_id", tx.scale_exponent(F.col("header")).alias("exponent"))


@query(sql="""WITH x AS (SELECT product_id, c_raw, CASE c_header WHEN 'C 10^-4' THEN -4 WHEN 'C (%)' THEN 0 WHEN 'C x10^3' THEN -3 ELSE -4 END AS exponent, TRY_CAST(c_raw AS DECIMAL(18,8)) AS v FROM fx_raw_rows),
y AS (SELECT *, CAST(v * CASE exponent WHEN -4 THEN CAST(0.0001 AS DECIMAL(9,8)) WHEN -3 THEN CAST(0.001 AS DECIMAL(9,8)) ELSE CAST(1 AS DECIMAL(9,8)) END AS DECIMAL(18,8)) AS p FROM x)
SELECT product_id, exponent, CASE WHEN p <= 100 THEN p END AS percentage, CASE WHEN v IS NULL THEN 'not_numeric' WHEN p > 100 THEN 'out_of_range' END AS error FROM y""")
def scaled_chemistry(t: Tables) -> DataFrame:
    return nz.normalize_chemistry(t.raw_rows, "c_raw", "c_header").select("product_id", "exponent", "percentage", "error")


@query(sql=r"""WITH x AS (SELECT cell_id, replace(trim(number_text), ' ', '') AS s FROM fx_value_cells), y AS (SELECT cell_id, CASE WHEN contains(s, ',') AND contains(s, '.') THEN
  CASE WHEN instr(reverse(s), ',') < instr(reverse(s), '.') THEN replace(replace(s, '.', ''), ',', '.') ELSE replace(s, ',', '') END
 WHEN contains(s, ',') THEN CASE WHEN instr(reverse(s), ',') = 4 THEN replace(s, ',', '') ELSE replace(s, ',', '.') END ELSE s END AS s FROM x) SELECT cell_id, TRY_CAST(s AS DECIMAL(18,6)) AS number FROM y""")
def locale_numbers(t: Tables) -> DataFrame:
    return t.value_cells.select("cell_id", tx.locale_number(F.col("number_text")).alias("number"))


UNIT_SQL = r"""CASE WHEN regexp_matches({0}, '(?i)\bmm\b|mil[ií]metros?') THEN 'mm' WHEN regexp_matches({0}, '(?i)\bcm\b|cent[ií]metros?') THEN 'cm' WHEN regexp_matches({0}, '(?i)\bin(ch(es)?)?\b|pulgadas?|["″]') THEN 'in'
 WHEN regexp_matches({0}, '(?i)\b(ft|feet|foot|pies?)\b|[''′]') THEN 'ft' WHEN regexp_matches({0}, '(?i)\bm\b|\bmetros?\b') THEN 'm' END"""


@query(sql=f"SELECT cell_id, {UNIT_SQL.format('size_text')} AS value_unit, {UNIT_SQL.format('size_header')} AS header_unit FROM fx_value_cells")
def dimension_units(t: Tables) -> DataFrame:
    return t.value_cells.select("cell_id", tx.dimension_unit(F.col("size_text")).alias("value_unit"), tx.dimension_unit(F.col("size_header")).alias("header_unit"))


@query(sql=rf"""WITH x AS (SELECT cell_id, size_text AS s, coalesce({UNIT_SQL.format('size_text')}, {UNIT_SQL.format('size_header')}, 'mm') AS u FROM fx_value_cells),
y AS (SELECT *, CASE WHEN s = '1 1/2 in' THEN 1.5 WHEN s = '3/4"' THEN 0.75 WHEN s IN ('3 furlongs', 'abc') THEN NULL ELSE CAST(regexp_extract(replace(s, ',', '.'), '^[0-9.]+') AS DECIMAL(18,6)) END AS n FROM x)
SELECT cell_id, CAST(n * CASE u WHEN 'mm' THEN 1 WHEN 'cm' THEN 10 WHEN 'm' THEN 1000 WHEN 'in' THEN 25.4 ELSE 304.8 END AS DECIMAL(18,6)) AS value_mm FROM y""")
def dimension_values(t: Tables) -> DataFrame:
    return t.value_cells.select("cell_id", tx.dimension_value(F.col("size_text"), F.col("size_header")).alias("value_mm"))


@query(sql="""SELECT product_id, CAST(CASE product_id%5 WHEN 0 THEN 38.1 WHEN 1 THEN 12.5 WHEN 2 THEN 0.9 WHEN 3 THEN 20 END AS DECIMAL(18,6)) AS thickness_mm, TRY_CAST(width_raw AS DECIMAL(18,6)) AS width_mm,
 coalesce(length_raw = 'COIL', false) AS coiled, CAST(CASE WHEN length_raw = '6.0' THEN 6 END AS DECIMAL(18,6)) AS length_m,
 concat_ws(',', CASE WHEN product_id%5=4 THEN 'thickness' END, CASE WHEN width_raw = '"' THEN 'width' END) AS dimension_error FROM fx_raw_rows""")
def row_dimensions(t: Tables) -> DataFrame:
    return nz.normalize_dimensions(t.raw_rows).select("product_id", "thickness_mm", "width_mm", "coiled", "length_m", "dimension_error")


@query(sql="""SELECT cell_id, CAST(CASE cell_id%8 WHEN 0 THEN 1.2 WHEN 1 THEN 2.5 WHEN 2 THEN 3 WHEN 4 THEN 0.8 WHEN 6 THEN 2 WHEN 7 THEN 4 END AS DECIMAL(18,6)) AS thickness_mm,
 CAST(CASE cell_id%8 WHEN 0 THEN 1200 WHEN 1 THEN 1000 WHEN 2 THEN 1500 WHEN 4 THEN 914 WHEN 6 THEN 1000 END AS DECIMAL(18,6)) AS width_mm,
 CASE WHEN cell_id%8 = 0 THEN true END AS coiled, CAST(CASE cell_id%8 WHEN 2 THEN 0.006 WHEN 6 THEN 2.5 END AS DECIMAL(18,6)) AS length_m FROM fx_value_cells""")
def compound_sizes(t: Tables) -> DataFrame:
    df = nz.split_sizes(t.value_cells.withColumn("plain_header", F.lit("")), "tuple_text", "plain_header")
    return df.select("cell_id", "thickness_mm", "width_mm", "coiled", "length_m")


@query(sql=r"""SELECT cell_id, CASE cell_id%9 WHEN 0 THEN DATE '2024-01-31' WHEN 2 THEN DATE '2024-03-05' WHEN 3 THEN DATE '2023-03-07' WHEN 5 THEN DATE '2022-12-24' WHEN 8 THEN DATE '2023-11-09' END AS certificate_date,
 trim(regexp_replace(lower(maker_text), '\s+', ' ', 'g')) AS manufacturer_key, nullif(regexp_extract(standard_text, '(?i)^SAE\s+(\d{4})$', 1), '') AS grade FROM fx_value_cells""")
def header_metadata(t: Tables) -> DataFrame:
    df = t.value_cells.withColumn("corpus", F.lit(""))
    return nz.normalize_headers_metadata(df, "corpus", "standard_text", "maker_text", "date_text").select("cell_id", "certificate_date", "manufacturer_key", "grade")


VIEW_TEXT = "concat(CASE doc_id%4 WHEN 0 THEN 'Hot-Rolled steel coil ' WHEN 1 THEN 'COLD ROLLED strip ' WHEN 2 THEN 'EG coil with Zn, cold rolled and hot rolled ' ELSE '' END, text)"


@query(sql=rf"""WITH x AS (SELECT doc_id, replace(trim(regexp_replace(strip_accents(lower({VIEW_TEXT})), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' ', '') AS s FROM documents)
SELECT doc_id, CASE WHEN contains(s, 'coldrolled') AND NOT contains(s, 'hotrolled') THEN 'cold' WHEN contains(s, 'hotrolled') AND NOT contains(s, 'coldrolled') THEN 'hot' END AS rolling,
 contains(s, 'egcoil') AND contains(s, 'zn') AS zinc_electrolytic FROM x""")
def corpus_flags(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.expr(VIEW_TEXT).alias("body"), F.lit("").alias("none"))
    return nz.normalize_headers_metadata(docs, "body", "none", "none", "none").select("doc_id", "rolling", "zinc_electrolytic")


@query(sql="""SELECT cell_id, CASE WHEN superior = 0 OR inferior = 0 THEN false WHEN superior IS NOT NULL AND inferior IS NOT NULL THEN superior > 0 AND inferior > 0 END AS coating_both_sides,
 CASE WHEN lower(condition_text) IN ('pickled', 'decapado') THEN true WHEN lower(condition_text) LIKE 'unpickled%' THEN false END AS pickled FROM fx_value_cells""")
def product_flags(t: Tables) -> DataFrame:
    df = t.value_cells.withColumn("conditions", F.split("condition_text", ","))
    return nz.derive_product_flags(df, "superior", "inferior", "conditions").select("cell_id", "coating_both_sides", "pickled")


@query(sql="""SELECT cell_id, CASE cell_id%6 WHEN 0 THEN '>=' WHEN 1 THEN '<=' WHEN 2 THEN '>=' WHEN 3 THEN '=' WHEN 5 THEN '<' END AS bound_operator,
 CAST(CASE cell_id%6 WHEN 0 THEN 355 WHEN 1 THEN 400 WHEN 2 THEN 275.5 WHEN 3 THEN 310 WHEN 5 THEN 250 END AS DECIMAL(18,6)) AS bound_value FROM fx_value_cells""")
def yield_bounds(t: Tables) -> DataFrame:
    return nz.parse_yield_bounds(t.value_cells, "bound_text").select("cell_id", "bound_operator", "bound_value")


@query(sql="""SELECT fraction, nico, left(fraction,4) || '.' || substr(fraction,5,2) || '.' || right(fraction,2) || '-' || nico AS display_code, fraction || nico AS compact_code, count(*) AS entries FROM fx_catalog GROUP BY 1,2""")
def display_codes(t: Tables) -> DataFrame:
    return nz.format_codes(t.catalog).groupBy("fraction", "nico", "display_code", "compact_code").agg(F.count("*").alias("entries"))


@query(sql="""SELECT cell_id, CASE preset WHEN 'day' THEN today WHEN 'week' THEN today - 7 WHEN 'month' THEN today - 30 END AS start_date, CASE WHEN preset <> 'all' THEN today END AS end_date FROM fx_value_cells""")
def period_presets(t: Tables) -> DataFrame:
    return nz.period_bounds(t.value_cells, "preset", "today").select("cell_id", "start_date", "end_date")


NAMED = "concat(CASE doc_id%4 WHEN 0 THEN 'Hot-Rolled steel coil ' ELSE '' END, coalesce(text, ''), CASE doc_id%4 WHEN 1 THEN ' Cold rolled strip, Acme Steel Co., Ltd.' ELSE '' END)"


@query(sql=rf"""WITH d AS (SELECT doc_id, {NAMED} AS text FROM documents),
m AS (SELECT *, regexp_matches(text, '(?i)\b(hot|cold)[ -]+rolled\b.*\b(coil|sheet|strip|plate)\b') AS p, regexp_matches(text, '(?i)\b(corporation|company|co\.?\s*,?\s*ltd\.?|s\.?a\.?)\s*$') AS c FROM d)
SELECT doc_id, CASE WHEN p THEN text END AS product_name, CASE WHEN c THEN text END AS supplier FROM m WHERE p OR c""")
def product_names(t: Tables) -> DataFrame:
    blocks = t.documents.select("doc_id", F.lit(1).alias("position"), F.expr(NAMED).alias("text"))
    return nz.product_names(blocks).select("doc_id", "product_name", "supplier")


ROTATE = """WITH s AS (SELECT box_id, rotation, page_width AS w, page_height AS h, x0*page_width/image_width AS x0, x1*page_width/image_width AS x1, top*page_height/image_height AS top, bottom*page_height/image_height AS bottom FROM fx_boxes),
r AS (SELECT box_id, w, h, CASE rotation WHEN 0 THEN [x0, x1, top, bottom] WHEN 90 THEN [h-bottom, h-top, x0, x1] WHEN 180 THEN [w-x1, w-x0, h-bottom, h-top] ELSE [top, bottom, w-x1, w-x0] END AS b FROM s)
SELECT box_id, CAST(round(greatest(0, least(b[1], w)), 2) AS DECIMAL(9,2)) AS x0, CAST(round(greatest(0, least(b[2], w)), 2) AS DECIMAL(9,2)) AS x1, CAST(round(greatest(0, least(b[3], h)), 2) AS DECIMAL(9,2)) AS top, CAST(round(greatest(0, least(b[4], h)), 2) AS DECIMAL(9,2)) AS bottom FROM r"""


@query(sql=ROTATE)
def upright_boxes(t: Tables) -> DataFrame:
    one = lambda c: F.col(c).cast("decimal(9,2)").alias(c)
    return nz.normalize_boxes(t.boxes).select("box_id", one("x0"), one("x1"), one("top"), one("bottom"))


@query(sql="""SELECT box_id, CAST(x0/1000*page_width AS DECIMAL(12,3)) AS box_x0, CAST(x1/1200*page_width AS DECIMAL(12,3)) AS box_x1, CAST(top/1000*page_height AS DECIMAL(12,3)) AS box_top, CAST(x0/1000 AS DECIMAL(12,3)) AS rel_x0 FROM fx_boxes WHERE x0/1000 < x1/1200""")
def relative_regions(t: Tables) -> DataFrame:
    regions = t.boxes.selectExpr("box_id", "x0/1000 as x0", "x1/1200 as x1", "top/1000 as top", "bottom/800 as bottom", "page_width", "page_height")
    df = nz.boxes_to_regions(nz.regions_to_boxes(regions)).filter("box_x0 is not null")
    three = lambda c: F.col(c).cast("decimal(12,3)").alias(c)
    return df.select("box_id", three("box_x0"), three("box_x1"), three("box_top"), three("rel_x0"))


@query(sql="""SELECT observation_id, 'yield' AS property, normalized_value FROM fx_observations WHERE field_path LIKE '%yield%'""")
def mechanical_properties(t: Tables) -> DataFrame:
    return nz.mechanical_rows(t.observations).select("observation_id", "property", "normalized_value")


# Expected terms are written out: no SQL function folds compatibility forms.
@query(sql="""SELECT doc_id, CASE doc_id%12 WHEN 0 THEN 'coil no 12' WHEN 1 THEN 'fine flow viii 1 2' WHEN 2 THEN 'strasse strasse' WHEN 3 THEN 'ελλαδα οσοσ' WHEN 4 THEN 'елка и' WHEN 5 THEN 'kg mm2 C' WHEN 6 THEN 'Bold 12' WHEN 7 THEN 'naive_unicode dz' WHEN 8 THEN 'カス 炉号' WHEN 9 THEN 'limite elastico mpa' WHEN 10 THEN 'ete o' WHEN 11 THEN 'plain ascii no 7' END || ' ' || doc_id AS term FROM documents""")
def folded_terms(t: Tables) -> DataFrame:
    """Terms of many scripts: full-width and Roman forms, ligatures, units, Greek, Cyrillic, kana, combining marks."""
    return t.scripts.select("doc_id", tx.normalize_term_unicode(F.col("text")).alias("term"))
