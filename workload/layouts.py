"""Tables, worksheets and page geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millspark.operators import history as h
from millspark.operators import known_layouts as kl
from millspark.operators import layout as ly
from millspark.operators import recovery as rv
from millspark.operators import templates as tp
from millspark.operators import tables as tb
from workload.registry import ORACLE_VIEWS, Tables, query

ORACLE_VIEWS["ox_table_header"] = """
WITH c AS (SELECT c.doc_id, c.row_idx, c.col_idx, h.category, h.key, CASE WHEN h.category='chemistry' THEN x.exponent END AS exponent FROM fx_table_cells c JOIN (SELECT DISTINCT header, category, key FROM ox_header) h ON h.header = c.text JOIN ox_scale x ON x.header = c.text WHERE row_idx < 2),
r AS (SELECT doc_id, row_idx, count(CASE WHEN category <> 'unknown' THEN 1 END) AS n FROM c GROUP BY 1,2), b AS (SELECT doc_id, arg_max(row_idx, n*10 - row_idx) AS header_row FROM r WHERE n > 0 GROUP BY 1)
SELECT c.doc_id, header_row, col_idx, category, key, exponent FROM c JOIN b ON b.doc_id = c.doc_id AND b.header_row = c.row_idx
"""
ORACLE_VIEWS["ox_scale"] = r"""
SELECT header, CASE WHEN regexp_matches(h, '[x×*/÷]10\^?[1-6](\D|$)') THEN -CAST(regexp_extract(h, '[x×*/÷]10\^?([1-6])', 1) AS INT) WHEN regexp_matches(h, '10\^?[-−]\d+') THEN -CAST(regexp_extract(h, '10\^?[-−](\d+)', 1) AS INT)
 WHEN contains(h, '10⁻⁴') THEN -4 WHEN contains(h, '10⁻³') THEN -3 WHEN contains(h, '10⁻²') THEN -2 WHEN regexp_matches(h, '[*x/]10000') THEN -4 WHEN regexp_matches(h, '[*x/]1000') THEN -3 WHEN regexp_matches(h, '[*x/]100') THEN -2 WHEN contains(h, 'ppm') THEN -4 WHEN contains(h, '%') THEN 0 END AS exponent
FROM (SELECT DISTINCT header, replace(lower(header), ' ', '') AS h FROM fx_header_cells)
"""
ORACLE_VIEWS["ox_table_value"] = """
WITH hd AS (SELECT doc_id, max(header_row) AS header_row FROM ox_table_header GROUP BY 1 HAVING bool_or(category IN ('product_id','heat_no'))), b AS (SELECT c.* FROM fx_table_cells c JOIN hd ON hd.doc_id = c.doc_id WHERE row_idx > header_row AND trim(text) <> ''),
f AS (SELECT doc_id, row_idx FROM b GROUP BY 1,2 HAVING NOT contains(lower(arg_min(text, col_idx)), 'total')), m AS (SELECT b.doc_id, b.row_idx, b.col_idx, trim(b.text) AS text, h.category, h.key FROM b JOIN f ON f.doc_id = b.doc_id AND f.row_idx = b.row_idx JOIN ox_table_header h ON h.doc_id = b.doc_id AND h.col_idx = b.col_idx
 WHERE h.category <> 'unknown' AND NOT (h.category = 'chemistry' AND h.exponent IS NULL)), i AS (SELECT doc_id, row_idx, arg_max(text, col_idx) AS product_id FROM m WHERE category='product_id' GROUP BY 1,2)
SELECT m.*, i.product_id FROM m JOIN i ON i.doc_id = m.doc_id AND i.row_idx = m.row_idx
"""


@query(sql="SELECT doc_id, header_row, col_idx, category, key, exponent FROM ox_table_header")
def table_headers(t: Tables) -> DataFrame:
    return tb.find_header_rows(t.table_cells).select("doc_id", "header_row", "col_idx", "category", "key", "exponent")


@query(sql="SELECT doc_id, row_idx, product_id, category, key, arg_max(text, col_idx) AS text FROM ox_table_value GROUP BY 1,2,3,4,5")
def table_values(t: Tables) -> DataFrame:
    return tb.table_rows(t.table_cells, tb.find_header_rows(t.table_cells))[0].select("doc_id", "row_idx", "product_id", "category", "key", "text")


@query(sql="""SELECT 'text_block' AS kind, doc_id, text, count(*) AS n FROM fx_label_blocks WHERE NOT (text IN ('Manufacturer','Certificate Number') OR split_part(text, ':', 1) IN ('Certificate No','Supplier','Fabricante','Customer')) OR top > 360 GROUP BY 2,3
UNION ALL SELECT 'table_cell', doc_id, text, count(*) FROM fx_table_cells c WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM ox_table_value v WHERE v.doc_id = c.doc_id AND v.row_idx = c.row_idx AND v.col_idx = c.col_idx) GROUP BY 2,3""")
def unmapped_evidence(t: Tables) -> DataFrame:
    used = tb.table_rows(t.table_cells, tb.find_header_rows(t.table_cells))[1]
    return tb.unmapped_evidence(t.label_blocks.withColumn("height", F.col("page_height")), t.table_cells, used).groupBy("kind", "doc_id", "text").agg(F.count("*").alias("n"))


@query(sql="""SELECT 'S' || (certificate_id%20) || '!row-' || (product_id+10) AS product_id, CASE WHEN product_id%50<>0 THEN width_mm END AS width_mm, thickness_mm, CASE WHEN product_id%4 IN (1,2) THEN 'flat_rolled' END AS form, CASE product_id%4 WHEN 0 THEN 'hot' WHEN 1 THEN 'cold' END AS rolling,
 CASE product_id%4 WHEN 0 THEN true WHEN 2 THEN false END AS coiled, CASE WHEN product_id%30 > 0 THEN CAST(product_id%30*1000 AS DECIMAL(18,6)) END AS weight_kg, heat_no FROM fx_products WHERE thickness_mm IS NOT NULL OR width_mm IS NOT NULL OR product_id%50=0""")
def sheet_products(t: Tables) -> DataFrame:
    return tb.sheet_products(t.sheet_cells)[0].select("product_id", "width_mm", "thickness_mm", "form", "rolling", "coiled", "weight_kg", "heat_no")


@query(sql="""WITH p AS (SELECT *, certificate_id%20 AS s FROM fx_products WHERE thickness_mm IS NOT NULL OR width_mm IS NOT NULL OR product_id%50=0)
SELECT 'S' || s || '!row-' || (product_id+10) AS product_id, 'C' AS element, CAST(CASE WHEN s%4<>0 AND product_id%23<>0 THEN 0.05 END AS DECIMAL(18,8)) AS percentage FROM p UNION ALL SELECT 'S' || s || '!row-' || (product_id+10), 'Mn', NULL FROM p""")
def sheet_chemistry(t: Tables) -> DataFrame:
    return tb.sheet_products(t.sheet_cells)[1]


@query(sql="""WITH m AS (SELECT p.p_partkey, max(q.p_partkey) AS src FROM part p LEFT JOIN part q ON q.p_partkey%20 < 10 AND q.p_partkey%10 = p.p_partkey%10 AND p.p_partkey BETWEEN q.p_partkey AND q.p_partkey+10 GROUP BY 1)
SELECT 'P' || (p.p_partkey%10) AS sheet, CAST(p.p_partkey+10 AS INT) AS row, p_brand AS specification, CASE WHEN src IS NOT NULL THEN 'ALLOY ' || (src%3) END AS alloy_claim, coalesce(src <> p.p_partkey, false) AS alloy_inherited, CASE p.p_partkey%3 WHEN 0 THEN '>=' WHEN 1 THEN '<=' END AS bound_operator FROM part p JOIN m ON m.p_partkey = p.p_partkey""")
def sheet_specifications(t: Tables) -> DataFrame:
    df = tb.sheet_specifications(t.spec_cells, t.spec_merges)
    return df.select("sheet", "row", "specification", "alloy_claim", F.col("alloy_claim_inherited").alias("alloy_inherited"), "bound_operator")


@query(sql="""WITH e AS (SELECT product_id, CASE WHEN product_id%13=0 THEN '' ELSE CAST(product_id AS VARCHAR) END AS k, CAST(product_id%7 AS DECIMAL(18,6)) AS v FROM fx_products WHERE product_id%3=0 UNION ALL SELECT product_id, CAST(product_id AS VARCHAR), 1 FROM fx_products WHERE product_id%30=0 UNION ALL SELECT product_id, '-' || product_id, 1 FROM fx_products WHERE product_id%500=0),
n AS (SELECT k, count(*) AS n FROM e GROUP BY 1), s AS (SELECT e.k, e.v FROM e JOIN n ON n.k = e.k WHERE n = 1 AND e.k <> ''), p AS (SELECT CAST(product_id AS VARCHAR) AS k, CASE WHEN product_id%2=0 THEN CAST(3 AS DECIMAL(18,6)) END AS v FROM fx_products)
SELECT code, k AS key, count(*) AS n FROM (SELECT 'join_ambiguous' AS code, e.k FROM e JOIN n ON n.k = e.k WHERE n > 1 OR e.k = '' UNION ALL SELECT 'join_missing', k FROM s WHERE k NOT IN (SELECT k FROM p) UNION ALL SELECT 'join_missing', k FROM p WHERE k NOT IN (SELECT k FROM s) UNION ALL SELECT 'join_conflict', p.k FROM p JOIN s ON s.k = p.k WHERE p.v <> s.v) GROUP BY 1,2""")
def related_table_diagnostics(t: Tables) -> DataFrame:
    p, value = t.products, "cast(product_id%7 as decimal(18,6)) as v"
    entries = p.filter("product_id%3 = 0").selectExpr("if(product_id%13 = 0, '', cast(product_id as string)) as k", value).union(p.filter("product_id%30 = 0").selectExpr("cast(product_id as string)", "cast(1 as decimal(18,6))")).union(
        p.filter("product_id%500 = 0").selectExpr("concat('-', product_id)", "cast(1 as decimal(18,6))"))
    rows = p.selectExpr("cast(product_id as string) as k", "if(product_id%2 = 0, cast(3 as decimal(18,6)), null) as v")
    return tb.join_related(rows, entries, "k", "v")[1].groupBy("code", "key").agg(F.count("*").alias("n"))


REGIONS = "SELECT doc_id, 1 AS page, CAST(v.r AS INT) AS region_id, CAST(v.x0 AS DOUBLE) AS x0, CAST(v.x1 AS DOUBLE) AS x1, CAST(v.t AS DOUBLE) AS top, CAST(v.b AS DOUBLE) AS bottom, NOT (doc_id%9=0 AND v.r=3) AS readable FROM (SELECT DISTINCT certificate_id AS doc_id FROM fx_raw_rows) d CROSS JOIN (VALUES (1,90,170,110,160),(2,130,320,125,300),(3,-10,70,110,140)) AS v(r,x0,x1,t,b)"
ORACLE_VIEWS["ox_region"] = f"""
WITH r AS ({REGIONS}), j AS (SELECT r.*, b.block_id, b.text, b.x0 >= r.x0 AND b.top >= r.top AND b.x1 <= r.x1 AND b.bottom <= r.bottom AS inside FROM r LEFT JOIN fx_blocks b ON b.doc_id = r.doc_id AND greatest(b.x0, r.x0) < least(b.x1, r.x1) AND greatest(b.top, r.top) < least(b.bottom, r.bottom))
SELECT doc_id, region_id, any_value(readable) AS readable, count(CASE WHEN inside THEN 1 END) AS complete, count(CASE WHEN NOT inside THEN 1 END) AS clipped, string_agg(CASE WHEN inside THEN text END, ' ' ORDER BY block_id) AS text FROM j GROUP BY 1,2
"""


def regions(t: Tables) -> DataFrame:
    return t.spark.sql(REGIONS.replace("FROM fx_raw_rows", "FROM {rows}"), rows=t.raw_rows)


@query(sql="SELECT doc_id, region_id, complete, clipped, coalesce(text,'') AS text, CASE WHEN NOT readable THEN 'needs_ocr' WHEN clipped > 0 THEN 'needs_review' WHEN complete > 0 THEN 'success' ELSE 'empty' END AS status FROM ox_region")
def region_contents(t: Tables) -> DataFrame:
    return ly.select_regions(t.blocks, regions(t)).select("doc_id", "region_id", "complete", "clipped", F.coalesce("text", F.lit("")).alias("text"), "status")


@query(sql="""SELECT doc_id, 7 AS template_id, count(CASE WHEN readable AND clipped = 0 AND complete > 0 AND contains(text, CASE region_id WHEN 1 THEN '5' ELSE '1' END) THEN 1 END) AS found, count(CASE WHEN readable AND clipped = 0 AND complete > 0 AND contains(text, CASE region_id WHEN 1 THEN '5' ELSE '1' END) THEN 1 END) = 2 AS matches FROM ox_region WHERE region_id IN (1,3) GROUP BY 1""")
def template_matches(t: Tables) -> DataFrame:
    r = regions(t)
    anchors = r.filter("region_id in (1, 3)").selectExpr("doc_id", "region_id", "7 as template_id", "if(region_id = 1, '5', '1') as anchor_text")
    return ly.match_templates(ly.select_regions(t.blocks, r), anchors).select("doc_id", "template_id", "found", "matches")


@query(sql="""WITH s AS (SELECT doc_id, CASE WHEN doc_id%4=0 THEN ['Acme'] ELSE ['Acme Steel'] END AS v1, CASE WHEN doc_id%5=0 THEN ['Otro'] ELSE [] END AS v2 FROM documents)
SELECT doc_id, 'certificate_no' AS key, CASE doc_id%3 WHEN 2 THEN 'N-' ELSE 'C-' END || doc_id AS value, 1 AS distinct_values FROM documents UNION ALL SELECT doc_id, 'supplier', CASE WHEN len(v2) = 0 THEN v1[1] END, 1 + len(v2) FROM s UNION ALL SELECT doc_id, 'standard', 'ASTM', 1 FROM documents WHERE doc_id%2=1""")
def metadata_values(t: Tables) -> DataFrame:
    return ly.extract_metadata(t.label_blocks).select("doc_id", "key", "value", "distinct_values")


CITED = "SELECT product_id AS cell_id, certificate_id AS doc_id, 1 AS page, CAST(100 AS DOUBLE) AS x0, CAST(160 AS DOUBLE) AS x1, CAST(100+20*row_pos AS DOUBLE) AS top, CAST(112+20*row_pos AS DOUBLE) AS bottom, 'width_mm' AS field_path, CAST(product_id%900 + 1 AS DECIMAL(18,8)) AS normalized_value, 'Width mm' AS header_text FROM fx_raw_rows"
READ = "SELECT certificate_id AS doc_id, 1 AS page, product_id*2 + k AS block_id, CASE WHEN product_id%4=0 THEN CAST(product_id%900 + 1 + 10*(k+1) AS VARCHAR(20)) WHEN product_id%4=1 THEN 'smudge' ELSE CAST(product_id%900 + 1 AS VARCHAR(20)) END AS text, CAST(102 AS DOUBLE) AS x0, CAST(CASE WHEN product_id%5=0 THEN 300 ELSE 158 END AS DOUBLE) AS x1, CAST(101+20*row_pos AS DOUBLE) AS top, CAST(111+20*row_pos AS DOUBLE) AS bottom FROM fx_raw_rows CROSS JOIN (VALUES (0),(1)) AS v(k) WHERE k = 0 OR product_id%8 = 0"


@query(sql="""SELECT product_id AS cell_id, CASE WHEN product_id%8=0 THEN 'not_verifiable' ELSE 'discrepancy' END AS status, CASE WHEN product_id%8<>0 THEN CAST(product_id%900 + 11 AS DECIMAL(18,8)) END AS proposed_value FROM fx_raw_rows WHERE product_id%4=0 AND product_id%5<>0""")
def conflicting_readings(t: Tables) -> DataFrame:
    sql = lambda text: t.spark.sql(text.replace("FROM fx_raw_rows", "FROM {rows}"), rows=t.raw_rows)
    return ly.reconcile_readings(sql(CITED), sql(READ))


GRID = "SELECT certificate_id AS doc_id, 1 AS page, 0 AS table_idx, CAST(row_pos AS INT) AS row_idx, CAST(k AS INT) AS col_idx, CASE k WHEN 0 THEN CAST(product_id AS VARCHAR(20)) WHEN 1 THEN CAST(product_id%900+1 AS VARCHAR(20)) ELSE CAST(product_id%60 AS VARCHAR(20)) END AS text FROM fx_raw_rows CROSS JOIN (VALUES (0),(1),(2)) AS v(k)"
HEADS = "SELECT DISTINCT certificate_id AS doc_id, 1 AS page, 0 AS table_idx, 0 AS row_idx, CAST(k AS INT) AS col_idx, CASE k WHEN 0 THEN 'Coil No' WHEN 1 THEN 'Width mm' ELSE 'C x10^4' END AS header, CASE k WHEN 0 THEN 'product_id' WHEN 1 THEN 'dimension' ELSE 'chemistry' END AS category, CASE k WHEN 0 THEN 'product_id' WHEN 1 THEN 'width_mm' ELSE 'C' END AS key FROM fx_raw_rows CROSS JOIN (VALUES (0),(1),(2)) AS v(k)"
PROPOSED = "SELECT product_id AS proposal_id, certificate_id AS doc_id, 1 AS page, 0 AS table_idx, CAST(row_pos AS INT) AS row_idx, CAST(1 + product_id%2 AS INT) AS col_idx, 0 AS header_row, CAST(CASE WHEN product_id%11=0 THEN 0 ELSE 1 + product_id%2 END AS INT) AS header_col, CASE WHEN product_id%7=0 THEN '123456' WHEN product_id%2=0 THEN CAST(product_id%900+1 AS VARCHAR(20)) ELSE CAST(product_id%60 AS VARCHAR(20)) END AS raw_value, CASE WHEN product_id%2=0 THEN 'width_mm' ELSE 'composition_pct.C' END AS field_path, CASE WHEN product_id%13=0 THEN 'other' ELSE CAST(product_id AS VARCHAR(20)) END AS product_id, CAST(CASE WHEN product_id%2=0 THEN 500 ELSE 0.0010 END AS DECIMAL(18,8)) AS current_value FROM fx_raw_rows"


@query(sql="""SELECT product_id AS proposal_id, CASE WHEN product_id%7=0 THEN 'no_literal_evidence' WHEN product_id%11=0 THEN 'header_outside_column' WHEN product_id%13=0 THEN 'row_not_of_product' END AS reason,
 CASE WHEN product_id%7=0 OR product_id%11=0 OR product_id%13=0 THEN 'not_verifiable' WHEN (product_id%2=0 AND product_id%900+1 = 500) OR (product_id%2=1 AND product_id%60 = 10) THEN 'matches' ELSE 'discrepancy' END AS status FROM fx_raw_rows""")
def cited_values(t: Tables) -> DataFrame:
    sql = lambda text: t.spark.sql(text.replace("FROM fx_raw_rows", "FROM {rows}"), rows=t.raw_rows)
    return ly.verify_cited_values(sql(PROPOSED), sql(GRID), sql(HEADS)).select("proposal_id", "reason", "status")


@query(sql="SELECT product_id, field_path, count(*) AS proposals, CASE WHEN count(DISTINCT normalized_value) = 1 THEN 'discrepancy' ELSE 'not_verifiable' END AS status, CASE WHEN count(DISTINCT normalized_value) = 1 THEN min(normalized_value) END AS value FROM fx_observations GROUP BY 1,2")
def merged_proposals(t: Tables) -> DataFrame:
    return ly.merge_proposals(t.observations.withColumnRenamed("normalized_value", "value"))


def grid_blocks(t: Tables) -> DataFrame:
    """The fixture grid with printed header blocks above it."""
    t.write_once("blocks")
    body = t.blocks.filter("text is not null").selectExpr("doc_id", "page", "block_id", "CASE WHEN block_id%10 = 0 THEN concat('K', text) ELSE text END as text", "x0", "x1", "top", "bottom")
    heads = t.blocks.select("doc_id", "page").distinct().selectExpr("doc_id", "page", "stack(3, -1, 'Coil No', 0.0D, 60.0D, -2, 'Width', 100.0D, 160.0D, -3, 'C x10^4', 200.0D, 260.0D) as (block_id, text, x0, x1)").selectExpr(
        "doc_id", "page", "cast(block_id as bigint) as block_id", "text", "x0", "x1", "90.0D as top", "102.0D as bottom")
    return body.unionByName(heads).withColumns({"page_width": F.lit(600.0), "page_height": F.lit(800.0)})


@query(sql="""SELECT certificate_id AS doc_id, 'K' || product_id AS product_id, 'width_mm' AS key, width_raw AS text FROM fx_raw_rows WHERE width_raw IS NOT NULL UNION ALL SELECT certificate_id, 'K' || product_id, 'C', c_raw FROM fx_raw_rows""")
def recovered_rows(t: Tables) -> DataFrame:
    return rv.recover_geometric_rows(grid_blocks(t)).select("doc_id", "product_id", "key", "text")


@query(sql="""SELECT certificate_id AS doc_id, row_pos AS row_id, CASE WHEN product_id%6=0 THEN 'CO1L-' || product_id WHEN certificate_id%10=0 AND row_pos <= 2 THEN 'COIL-SAME1' ELSE 'COIL-' || product_id END AS product_id, key, text, exponent FROM (
 SELECT *, 'width_mm' AS key, width_raw AS text, NULL AS exponent FROM fx_raw_rows WHERE width_raw IS NOT NULL
 UNION ALL SELECT *, 'C', c_raw, CASE certificate_id%4 WHEN 1 THEN 0 ELSE -3 END FROM fx_raw_rows WHERE certificate_id%4 <> 3
 UNION ALL SELECT *, 'Mn', '0.' || product_id%9, 0 FROM fx_raw_rows
 UNION ALL SELECT *, 'heat_no', 'H' || heat_id, NULL FROM fx_raw_rows
 UNION ALL SELECT *, unnest(CASE WHEN product_id%2=0 THEN ['weight_kg', 'net_weight_kg'] ELSE ['weight_kg'] END), CAST(100 + product_id%50 AS VARCHAR), NULL FROM fx_raw_rows
 UNION ALL SELECT *, 'gross_weight_kg', CAST(200 + product_id%50 AS VARCHAR), NULL FROM fx_raw_rows WHERE product_id%2=0)""")
def recovered_readings(t: Tables) -> DataFrame:
    """Rows of scanned pages with second readings; the oracle knows the rows that the pages were printed from."""
    return rv.recover_geometric_rows(t.write_once("raw_rows").scan_blocks).select("doc_id", "row_id", "product_id", "key", "text", "exponent")


@query(sql="""SELECT certificate_id AS doc_id, 'GRID' AS profile, 'first_width' AS field, CASE WHEN count(DISTINCT width_raw) = 1 THEN min(width_raw) END AS value, count(DISTINCT width_raw) > 1 AS conflict FROM fx_raw_rows WHERE row_pos <= 2 AND width_raw IS NOT NULL GROUP BY 1""")
def profile_fields(t: Tables) -> DataFrame:
    fields = t.spark.createDataFrame([("GRID", "width", "first_width", -5.0, 70.0, 10.0, 50.0)], "profile string, anchor_text string, field string, dx0 double, dx1 double, dy0 double, dy1 double")
    return ly.apply_profiles(grid_blocks(t), fields)


# ---- oracle: what the fixture printed on pages of known layouts ----
ORACLE_VIEWS["ox_known_issues"] = """
WITH l AS (SELECT * FROM fx_mill_lines WHERE doc_id%2=1 AND doc_id%7<>3)
SELECT doc_id, page, code, field, count(*) AS n FROM (
 SELECT doc_id, 1 AS page, 'value_missing' AS code, 'width_mm' AS field FROM fx_mill_lines WHERE doc_id%2=0 AND width_raw IS NULL
 UNION ALL SELECT doc_id, 2, 'heat_missing', 'heat_no' FROM l WHERE doc_id%13=1 AND row_pos=1
 UNION ALL SELECT DISTINCT doc_id, 2 + 2*part, 'chemistry_conflict', 'composition_pct.C' FROM l WHERE doc_id%7=1 AND doc_id%13<>1
 UNION ALL SELECT DISTINCT doc_id, 3, 'certificate_without_rolls', 'certificate_no' FROM l WHERE doc_id%11=1
 UNION ALL SELECT DISTINCT doc_id, 4, 'certificate_without_rolls', 'certificate_no' FROM l WHERE doc_id%3=0 AND n_rows=1) GROUP BY 1,2,3,4
"""
ORACLE_VIEWS["ox_known_values"] = """
WITH l AS (SELECT * FROM fx_mill_lines WHERE (doc_id%2=0 OR doc_id%7<>3) AND doc_id NOT IN (SELECT doc_id FROM ox_known_issues)),
a AS (SELECT *, 'E0' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS certificate_no, 1 AS page, '25BH2B' || lpad(CAST(product_id AS VARCHAR), 7, '0') AS roll FROM l WHERE doc_id%2=0),
b AS (SELECT *, CAST(doc_id*10 + part AS VARCHAR) AS certificate_no, 2 + 2*part AS page, 'K' || product_id AS roll, CASE product_id%3 WHEN 0 THEN '10000.000000' WHEN 1 THEN '9500.000000' END AS net, CASE WHEN product_id%2=1 THEN '10100.000000' END AS gross FROM l WHERE doc_id%2=1),
v AS (SELECT doc_id, certificate_no, page, roll, unnest(['product_id', 'heat_no', 'thickness_mm', 'width_mm', 'length_raw', 'net_weight_kg', 'gross_weight_kg', 'composition_pct.C', 'composition_pct.Si', 'composition_pct.Mn', 'composition_pct.P', 'composition_pct.S', 'composition_pct.Als', 'composition_pct.Ti', 'yield_strength_mpa', 'tensile_strength_mpa', 'elongation_pct']) AS field,
  unnest([roll, lpad(CAST(heat_id AS VARCHAR), 7, '0'), '1.' || product_id%9, CAST(900 + product_id%300 AS VARCHAR), 'C', CAST(10000 + product_id%5000 AS VARCHAR), CAST(10100 + product_id%5000 AS VARCHAR), CAST(product_id%60 AS VARCHAR), '1', '25', '5', '2', '40', '3', CAST(300 + product_id%50 AS VARCHAR), CAST(400 + product_id%50 AS VARCHAR), '28.5']) AS value,
  unnest([NULL, NULL, NULL, NULL, NULL, NULL, NULL, -4, -2, -2, -3, -3, -3, -3, NULL, NULL, NULL]) AS exponent FROM a
 UNION ALL SELECT doc_id, certificate_no, page, roll, unnest(['product_id', 'heat_no', 'length_raw', 'certificate_no', 'supplemental_standard', 'composition_pct.C', 'composition_pct.Si', 'composition_pct.Mn', 'net_weight_kg', 'gross_weight_kg', 'weight_kg', 'weight_kind',
   'standard', 'thickness_mm', 'width_mm', 'rolling', 'condition', 'coating_metal', 'yield_strength_mpa', 'elongation_pct', 'coating_superior_g_m2']),
  unnest([roll, 'H' || heat_id, 'COIL', certificate_no, 'Identification according to international standard A1011', '0.' || heat_id%60, '0.01', '0', net, gross, coalesce(net, gross), CASE WHEN net IS NOT NULL THEN 'net' WHEN gross IS NOT NULL THEN 'gross' END,
   CASE WHEN doc_id%19<>1 THEN CASE part WHEN 0 THEN 'S235' ELSE 'M1' END END, CASE WHEN doc_id%19<>1 THEN CASE part WHEN 0 THEN '1.800000' ELSE '2.000000' END END, CASE WHEN doc_id%19<>1 THEN CASE part WHEN 0 THEN '1496.000000' ELSE '900.000000' END END,
   CASE WHEN doc_id%19<>1 THEN CASE part WHEN 0 THEN 'hot' ELSE 'cold' END END, CASE WHEN doc_id%19<>1 AND part=0 THEN 'pickled, oiled' END, CASE WHEN doc_id%19<>1 AND part=1 THEN 'Al' END,
   CASE WHEN part_rows=1 THEN '355.000000' END, CASE WHEN part_rows=1 THEN '28.500000' END, CASE WHEN part_rows=1 AND doc_id%5<>1 THEN '60.000000' END]),
  unnest([NULL, NULL, NULL, NULL, NULL, 0, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL]) FROM b)
SELECT doc_id, certificate_no, page, roll AS product_id, field, value, exponent FROM v WHERE value IS NOT NULL
"""


def known_layouts(t: Tables) -> dict[str, DataFrame]:
    # Documents, pages and blocks of both families all come from the lines.
    t.write_once("mill_lines").write_once("known_docs")
    return kl.read_known_layouts(t.known_docs, t.known_pages, t.known_blocks)


@query(sql="SELECT * FROM ox_known_values")
def known_layout_values(t: Tables) -> DataFrame:
    """Values of the rolls of both layouts, of documents without an issue."""
    return known_layouts(t)["values"].filter("accepted").select("doc_id", "certificate_no", "page", "product_id", "field", "value", "exponent")


@query(sql="SELECT * FROM ox_known_issues")
def known_layout_issues(t: Tables) -> DataFrame:
    return known_layouts(t)["issues"].groupBy("doc_id", "page", "code", "field").agg(F.count("*").alias("n"))


@query(sql="""WITH d AS (SELECT doc_id, bool_or(part=1) AS two, max(n_rows) AS n, sum(10000 + product_id%5000) AS net, sum(10100 + product_id%5000) AS gross FROM fx_mill_lines WHERE doc_id%2=0 OR doc_id%7<>3 GROUP BY 1)
SELECT * FROM (SELECT doc_id, unnest(['certificate_no', 'delivery_date_raw', 'standard', 'supplier', 'product_name', 'rolling', 'condition', 'total_net_weight_kg', 'total_gross_weight_kg', 'total_pieces']) AS field,
 unnest(['E0' || lpad(CAST(doc_id AS VARCHAR), 10, '0'), '20260628', 'BTA BLZ112 grade PW.T', 'BX Steel Posco Cold Rolled Sheet Co., Ltd.', 'Cold-rolled steel strip', 'cold', 'annealed, skin_passed', CAST(net AS VARCHAR), CAST(gross AS VARCHAR), CASE WHEN doc_id%4=0 THEN CAST(doc_id%9 + 1 AS VARCHAR) END]) AS value FROM d WHERE doc_id%2=0
UNION ALL SELECT doc_id, unnest(['certificate_no', 'issue_date', 'supplier', 'standard', 'product_name']), unnest([CASE WHEN doc_id%3<>0 AND doc_id%11<>1 THEN CAST(doc_id*10 AS VARCHAR) END, CASE WHEN doc_id%3<>0 OR doc_id%17<>1 THEN '2026-06-28' END, 'ArcelorMittal Calvert LLC',
 CASE WHEN doc_id%19<>1 AND NOT two THEN 'S235' END, CASE WHEN doc_id%19<>1 AND doc_id%3<>0 THEN 'Coil S235 / 1.800 mm X 1,496 mm Hot Roll Pickled & Oiled' END]) FROM d WHERE doc_id%2=1) WHERE value IS NOT NULL""")
def known_layout_certificates(t: Tables) -> DataFrame:
    return known_layouts(t)["certificates"].filter("value is not null").select("doc_id", "field", "value")


def templates(t: Tables) -> dict[str, DataFrame]:
    """Two templates as rows, over every document."""
    make = t.spark.createDataFrame
    mapping = "target string, element string, exponent int, unit string, separator string, required boolean"
    plain = lambda target, unit=None, required=True: (target, None, None, unit, ".", required)
    fields = make([(1, 1, 1, 0.0, 100.0, 0.0, 20.0, *plain("certificate_no")), (1, 2, 1, 200.0, 300.0, 0.0, 20.0, *plain("length_raw", "m")), (2, 3, 1, 0.0, 100.0, 0.0, 20.0, *plain("product_id")),
                   (2, 4, 1, 200.0, 300.0, 0.0, 20.0, *plain("width_mm", "mm")), (2, 5, 2, 0.0, 100.0, 0.0, 20.0, *plain("thickness_mm", "mm"))],
                  "template_id int, region_id int, page int, x0 double, x1 double, top double, bottom double, " + mapping)
    tables = make([(1, 1, 1, 0.0, 400.0, 100.0, 900.0, "products", "product_id", 0), (1, 2, 1, 450.0, 650.0, 100.0, 900.0, "chemistry", "heat_no", 0), (1, 3, 1, 700.0, 900.0, 100.0, 900.0, "mechanical", "product_id", 0)],
                  "template_id int, table_id int, page int, x0 double, x1 double, top double, bottom double, role string, join_key string, header_row int")
    columns = make([(1, 1, "coil", *plain("product_id")), (1, 1, "Heat", *plain("heat_no")), (1, 1, "Width", *plain("width_mm", "mm")), (1, 1, "YP", *plain("yield_strength_mpa", "MPa", False)),
                    (1, 2, "Heat", *plain("heat_no")), (1, 2, "C", "chemistry", "C", -3, "%", ".", True), (1, 3, "Coil", *plain("product_id")), (1, 3, "YP", *plain("yield_strength_mpa", "MPa")), (1, 3, "el", *plain("elongation_pct", "%"))],
                   "template_id int, table_id int, header string, " + mapping)
    t.write_once("raw_rows").write_once("tp_docs")
    return tp.extract_with_templates(t.tp_docs, t.tp_pages, t.tp_blocks, t.tp_tables, t.tp_cells, fields, tables, columns)


# ---- oracle: what the fixture printed, by case ----
ORACLE_VIEWS["ox_tp_doc"] = """
SELECT *, doc_id%29=0 OR (template_id=2 AND doc_id%2=1) AS stopped, doc_id%13=4 AS no_rows, doc_id%7=3 AS no_chem, doc_id%11=5 OR doc_id%17=6 AS no_mech FROM fx_tp_docs
"""
ORACLE_VIEWS["ox_tp_row"] = """
SELECT r.*, d.* EXCLUDE (template_id), heat_id%9<>0 AND heat_id%8<>1 AND NOT no_chem AS has_chem, product_id%21<>0 AND NOT no_mech AS has_mech FROM fx_raw_rows r JOIN ox_tp_doc d ON d.doc_id = r.certificate_id WHERE template_id=1 AND NOT stopped
"""
ORACLE_VIEWS["ox_tp_values"] = """
SELECT doc_id, (CAST(1 AS BIGINT) << 32) + row_pos*2 AS row_id, key, exponent, value FROM (
 SELECT *, 'product_id' AS key, NULL AS exponent, 'K' || product_id AS value FROM ox_tp_row UNION ALL SELECT *, 'heat_no', NULL, 'H' || heat_id FROM ox_tp_row
 UNION ALL SELECT *, 'width_mm', NULL, CASE WHEN width_raw <> '"' THEN CAST(CAST(width_raw AS DECIMAL(18,6)) AS VARCHAR) END FROM ox_tp_row
 UNION ALL SELECT *, 'length_raw', NULL, CASE WHEN doc_id%2=0 THEN 'C' END FROM ox_tp_row
 UNION ALL SELECT *, 'yield_strength_mpa', NULL, CASE WHEN product_id%10=0 THEN '300' WHEN has_mech THEN '355' END FROM ox_tp_row
 UNION ALL SELECT *, 'elongation_pct', NULL, '28.5' FROM ox_tp_row WHERE has_mech
 UNION ALL SELECT *, 'chemistry.C', -3, CASE WHEN heat_id%6<>5 THEN '13' END FROM ox_tp_row WHERE has_chem) WHERE NOT no_rows
UNION ALL SELECT doc_id, 0, 'product_id', NULL, 'R' || doc_id FROM ox_tp_doc WHERE template_id=2 AND NOT stopped
UNION ALL SELECT doc_id, 0, 'width_mm', NULL, '1200.000000' FROM ox_tp_doc WHERE template_id=2 AND NOT stopped AND doc_id%4<>0
UNION ALL SELECT doc_id, 0, 'thickness_mm', NULL, CASE WHEN doc_id%8<>2 THEN '1.500000' END FROM ox_tp_doc WHERE template_id=2 AND NOT stopped
"""
ORACLE_VIEWS["ox_tp_issues"] = """
WITH one AS (SELECT * FROM ox_tp_doc WHERE template_id=1 AND NOT stopped), two AS (SELECT * FROM ox_tp_doc WHERE template_id=2 AND NOT stopped),
h AS (SELECT DISTINCT doc_id, heat_id, no_rows FROM ox_tp_row WHERE heat_id%9<>0 AND NOT no_chem)
SELECT doc_id, code, field, page, count(*) AS n FROM (
 SELECT doc_id, 'needs_ocr' AS code, 'page' AS field, 1 AS page FROM ox_tp_doc WHERE doc_id%29=0 UNION ALL SELECT doc_id, 'page_missing', 'page', 2 FROM ox_tp_doc WHERE template_id=2 AND doc_id%2=1
 UNION ALL SELECT doc_id, 'page_not_mapped', 'page', 2 FROM one WHERE doc_id%10=0 UNION ALL SELECT doc_id, 'value_missing', 'certificate_no', 1 FROM one WHERE doc_id%12=0 UNION ALL SELECT doc_id, 'invalid_number', 'length_raw', 1 FROM one WHERE doc_id%2=1
 UNION ALL SELECT doc_id, 'header_ambiguous', 'products', 1 FROM one WHERE no_rows UNION ALL SELECT doc_id, 'table_ambiguous', 'chemistry', 1 FROM one WHERE no_chem
 UNION ALL SELECT doc_id, CASE WHEN doc_id%11=5 THEN 'clipped_table' ELSE 'header_missing' END, 'mechanical', 1 FROM one WHERE no_mech
 UNION ALL SELECT doc_id, CASE WHEN width_raw IS NULL THEN 'value_missing' ELSE 'unit_conflict' END, 'width_mm', 1 FROM ox_tp_row WHERE NOT no_rows AND (width_raw IS NULL OR width_raw = '"')
 UNION ALL SELECT doc_id, 'invalid_number', 'chemistry.C', 1 FROM h JOIN (VALUES (0),(1)) AS v(k) ON k=0 OR heat_id%8=1 WHERE heat_id%6=5
 UNION ALL SELECT doc_id, 'join_ambiguous', 'heat_no', 1 FROM h CROSS JOIN (VALUES (0),(1)) AS v(k) WHERE heat_id%8=1
 UNION ALL SELECT doc_id, 'join_missing', 'heat_no', 1 FROM h WHERE no_rows AND heat_id%8<>1 UNION ALL SELECT doc_id, 'join_missing', 'heat_no', 1 FROM one WHERE doc_id%5=0 AND NOT no_chem
 UNION ALL SELECT doc_id, 'join_missing', 'heat_no', 1 FROM ox_tp_row WHERE NOT no_rows AND NOT no_chem AND NOT has_chem
 UNION ALL SELECT doc_id, 'join_missing', 'product_id', 1 FROM ox_tp_row WHERE NOT no_mech AND CASE WHEN no_rows THEN has_mech ELSE NOT has_mech END
 UNION ALL SELECT doc_id, 'join_conflict', 'yield_strength_mpa', 1 FROM ox_tp_row WHERE NOT no_rows AND has_mech AND product_id%10=0
 UNION ALL SELECT doc_id, 'clipped_text', 'width_mm', 1 FROM two WHERE doc_id%4=0 UNION ALL SELECT doc_id, 'unit_conflict', 'thickness_mm', 2 FROM two WHERE doc_id%8=2) GROUP BY ALL
"""


@query(sql="SELECT * FROM ox_tp_values")
def template_extraction(t: Tables) -> DataFrame:
    """Every value of every product row that the templates give."""
    return templates(t)["values"]


@query(sql="SELECT * FROM ox_tp_issues")
def template_diagnostics(t: Tables) -> DataFrame:
    return templates(t)["diagnostics"].groupBy("doc_id", "code", "field", "page").agg(F.count("*").alias("n"))


@query(sql="""SELECT d.doc_id, CASE WHEN i.ocr THEN 'needs_ocr' WHEN i.doc_id IS NOT NULL THEN 'needs_review' WHEN v.doc_id IS NOT NULL THEN 'success' ELSE 'empty' END AS status, CASE WHEN template_id=1 AND NOT stopped AND d.doc_id%12<>0 THEN 'C-' || d.doc_id END AS certificate_no
FROM ox_tp_doc d LEFT JOIN (SELECT doc_id, bool_or(code='needs_ocr') AS ocr FROM ox_tp_issues GROUP BY 1) i ON i.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM ox_tp_values) v ON v.doc_id = d.doc_id""")
def template_status(t: Tables) -> DataFrame:
    found = templates(t)
    number = found["metadata"].filter("key = 'certificate_no'").select("doc_id", F.col("value").alias("certificate_no"))
    return found["status"].join(number, "doc_id", "left")


@query(sql="SELECT o_orderkey AS certificate_id, count(*) AS heats, CAST(sum(k) AS BIGINT) AS total FROM orders CROSS JOIN (SELECT unnest(range(1, 16)) AS k) v GROUP BY 1")
def volume_rows(t: Tables) -> DataFrame:
    return h.volume_rows(t.orders.selectExpr("o_orderkey as certificate_id"), 15).groupBy("certificate_id").agg(F.count("*").alias("heats"), F.sum("heat_number").alias("total"))
