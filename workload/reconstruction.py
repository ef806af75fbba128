"""Repeat marks, row checks, totals, header recognition and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millspark.functions import vocabulary as voc
from millspark.operators import headers as hd
from millspark.operators import reconstruct as rc
from workload.candidates import _values
from workload.registry import ORACLE_VIEWS, Tables, query


@query(sql="""WITH g AS (SELECT *, count(CASE WHEN width_raw IS DISTINCT FROM '"' THEN 1 END) OVER (PARTITION BY certificate_id ORDER BY row_pos) AS gw, count(CASE WHEN c_raw IS DISTINCT FROM '"' THEN 1 END) OVER (PARTITION BY certificate_id ORDER BY row_pos) AS gc,
 lag(product_id) OVER (PARTITION BY certificate_id ORDER BY row_pos) AS above FROM fx_raw_rows),
v AS (SELECT *, max(CASE WHEN width_raw <> '"' THEN width_raw END) OVER (PARTITION BY certificate_id, gw) AS w, max(CASE WHEN c_raw <> '"' THEN c_raw END) OVER (PARTITION BY certificate_id, gc) AS c FROM g)
SELECT product_id, w AS width_value, coalesce(width_raw = '"', false) AS width_inherited, coalesce(width_raw = '"', false) AND w IS NULL AS width_error, c AS c_value, coalesce(c_raw = '"', false) AS c_inherited, coalesce(c_raw = '"', false) AND c IS NULL AS c_error,
 CASE WHEN width_raw = '"' THEN above END AS width_inherited_from FROM v""")
def repeat_marks(t: Tables) -> DataFrame:
    df = rc.inherited_from(rc.resolve_dittos(t.raw_rows, ["width_raw", "c_raw"]))
    return df.select("product_id", F.col("width_raw_value").alias("width_value"), F.col("width_raw_inherited").alias("width_inherited"), F.col("width_raw_error").alias("width_error"),
                     F.col("c_raw_value").alias("c_value"), F.col("c_raw_inherited").alias("c_inherited"), F.col("c_raw_error").alias("c_error"),
                     F.when(F.col("width_raw_inherited"), F.col("previous_product_id")).alias("width_inherited_from"))


@query(sql="""WITH g AS (SELECT *, count(CASE WHEN heat_no IS DISTINCT FROM '同上' THEN 1 END) OVER s AS gh, count(CASE WHEN width_raw IS DISTINCT FROM '"' THEN 1 END) OVER s AS gw FROM fx_scoped_rows WINDOW s AS (PARTITION BY certificate_id, table_scope ORDER BY row_pos)),
h AS (SELECT *, max(CASE WHEN heat_no <> '同上' THEN heat_no END) OVER (PARTITION BY certificate_id, table_scope, gh) AS heat, max(CASE WHEN width_raw <> '"' THEN width_raw END) OVER (PARTITION BY certificate_id, table_scope, gw) AS width FROM g),
r AS (SELECT *, sum(CASE WHEN heat = prev THEN 0 ELSE 1 END) OVER (PARTITION BY certificate_id, table_scope ORDER BY row_pos) AS run FROM (SELECT *, lag(heat) OVER (PARTITION BY certificate_id, table_scope ORDER BY row_pos) AS prev FROM h)),
c AS (SELECT *, count(CASE WHEN c_raw IS DISTINCT FROM '"' THEN 1 END) OVER (PARTITION BY certificate_id, table_scope, run ORDER BY row_pos) AS gc FROM r)
SELECT product_id, heat AS heat_value, width AS width_value, max(CASE WHEN c_raw <> '"' THEN c_raw END) OVER (PARTITION BY certificate_id, table_scope, run, gc) AS c_value FROM c""")
def scoped_repeat_marks(t: Tables) -> DataFrame:
    df = rc.resolve_dittos_scoped(t.scoped_rows, ["width_raw"], ["c_raw"])
    return df.select("product_id", F.col("heat_no_value").alias("heat_value"), F.col("width_raw_value").alias("width_value"), F.col("c_raw_value").alias("c_value"))


ORACLE_VIEWS["ox_row_errors"] = """
SELECT certificate_id, product_identifier, error, count(*) AS n_rows FROM (
 SELECT certificate_id, product_identifier, 'missing_identifier' AS error FROM fx_roll_rows WHERE product_identifier = ''
 UNION ALL SELECT certificate_id, product_identifier, 'invalid_quantity' FROM fx_roll_rows WHERE quantity < 0
 UNION ALL SELECT certificate_id, product_identifier, 'duplicate_identifier' FROM (SELECT *, count(*) OVER (PARTITION BY certificate_id, product_identifier) AS k FROM fx_roll_rows WHERE product_identifier <> '') WHERE k > 1) GROUP BY 1,2,3
"""


@query(sql="SELECT * FROM ox_row_errors")
def row_errors(t: Tables) -> DataFrame:
    return rc.normalize_certificate_rows(t.roll_rows)[1].groupBy("certificate_id", "product_identifier", "error").agg(F.count("*").alias("n_rows"))


@query(sql="""SELECT r.product_id, r.certificate_id, r.product_identifier, CASE WHEN quantity = 0 THEN 1 ELSE quantity END AS quantity FROM fx_roll_rows r
WHERE product_identifier <> '' AND quantity >= 0 AND NOT EXISTS (SELECT 1 FROM ox_row_errors e WHERE e.certificate_id = r.certificate_id AND e.product_identifier = r.product_identifier AND error = 'duplicate_identifier')""")
def accepted_rows(t: Tables) -> DataFrame:
    return rc.normalize_certificate_rows(t.roll_rows)[0].select("product_id", "certificate_id", "product_identifier", F.expr("if(quantity = 0, 1, quantity)").alias("quantity"))


@query(sql="""WITH s AS (SELECT certificate_id, sum(quantity) AS q, sum(weight_kg) AS w, count(*) - count(weight_kg) AS nw, sum(net_weight_kg) AS n, sum(gross_weight_kg) AS g FROM fx_roll_rows GROUP BY 1)
SELECT d.certificate_id, CASE WHEN total_pieces = q THEN 'matches' WHEN total_pieces <> q THEN 'mismatch' END AS pieces_check,
 CASE WHEN total_weight_kg IS NULL THEN NULL WHEN nw > 0 THEN 'missing_row_values' WHEN total_weight_kg = w THEN 'matches' ELSE 'mismatch' END AS weight_check,
 CASE WHEN total_net_weight_kg = n THEN 'matches' ELSE 'mismatch' END AS net_check, CASE WHEN total_gross_weight_kg = g THEN 'matches' ELSE 'mismatch' END AS gross_check FROM fx_declared_totals d JOIN s ON s.certificate_id = d.certificate_id""")
def total_reconciliation(t: Tables) -> DataFrame:
    return rc.reconcile_totals(t.declared_totals, t.roll_rows).select(
        "certificate_id", "pieces_check", F.col("weight_kg_check").alias("weight_check"), F.col("net_weight_kg_check").alias("net_check"), F.col("gross_weight_kg_check").alias("gross_check"))


@query(sql="""SELECT d.certificate_id, d.match_value, subtotal_check, count(*) AS n_subtotals FROM (SELECT d.certificate_id, d.match_value, CASE WHEN s.q IS NULL THEN 'no_matching_rows' WHEN total_pieces <> q THEN 'pieces_mismatch' WHEN total_weight_kg IS NOT NULL AND nw > 0 THEN 'missing_row_values'
  WHEN total_weight_kg <> w THEN 'weight_mismatch' ELSE 'matches' END AS subtotal_check FROM fx_declared_subtotals d LEFT JOIN (SELECT certificate_id, heat_no, sum(quantity) AS q, sum(weight_kg) AS w, count(*) - count(weight_kg) AS nw FROM fx_roll_rows GROUP BY 1,2) s
  ON s.certificate_id = d.certificate_id AND s.heat_no = d.match_value) d GROUP BY 1,2,3""")
def subtotal_reconciliation(t: Tables) -> DataFrame:
    return rc.reconcile_subtotals(t.declared_subtotals, t.roll_rows, ["heat_no", "rolling"]).groupBy("certificate_id", "match_value", "subtotal_check").agg(F.count("*").alias("n_subtotals"))


@query(sql="""WITH p AS (SELECT heat_id, product_id, string_agg(element || ':' || CAST(percentage AS VARCHAR), ',' ORDER BY element) AS sig, bool_or(heat_no = 'UNKNOWN' OR source_format = 'xlsx' OR has_verification) AS apart FROM fx_roll_compositions GROUP BY 1,2),
h AS (SELECT heat_id, count(DISTINCT sig) = 1 AND NOT bool_or(apart) AS shared FROM p GROUP BY 1)
SELECT DISTINCT c.heat_id, CASE WHEN shared THEN NULL ELSE c.product_id END AS product_id, element, percentage FROM fx_roll_compositions c JOIN h ON h.heat_id = c.heat_id""")
def shared_composition(t: Tables) -> DataFrame:
    return rc.promote_shared_composition(t.roll_compositions).select("heat_id", "product_id", "element", "percentage")


ORACLE_VIEWS["ox_alias"] = _values([(w, w.replace(" ", ""), n.split()[0], n.split()[1], p) for n, w, p in voc.word_lists(voc.HEADER_WORDS)], "alias,compact,category,key,precedence")
ORACLE_VIEWS["ox_element"] = _values([(w, e) for e, w, _ in voc.word_lists(voc.ELEMENT_WORDS)], "word,element")
ORACLE_VIEWS["ox_field"] = _values([(f, w, p) for f, w, p in voc.word_lists(voc.FIELD_WORDS)], "field,alias,place")
ORACLE_VIEWS["ox_header"] = r"""
WITH x AS (SELECT cell_id, header, trim(regexp_replace(strip_accents(lower(header)), '[^\p{L}\p{N}_]+', ' ', 'g')) AS s FROM fx_header_cells),
a AS (SELECT cell_id, arg_min(a.category, precedence) AS category, arg_min(a.key, precedence) AS key FROM x JOIN ox_alias a ON s = alias OR starts_with(s, alias || ' ') OR ends_with(s, ' ' || alias) OR replace(s, ' ', '') = compact GROUP BY 1),
w AS (SELECT cell_id, unnest(list_append(string_split(s, ' '), replace(s, ' ', ''))) AS word, generate_subscripts(list_append(string_split(s, ' '), replace(s, ' ', '')), 1) AS pos FROM x),
e AS (SELECT cell_id, arg_min(element, pos) AS element FROM w JOIN ox_element m ON m.word = w.word GROUP BY 1)
SELECT x.cell_id, x.header, x.s, coalesce(a.category, CASE WHEN e.element IS NOT NULL THEN 'chemistry' END, 'unknown') AS category, coalesce(a.key, e.element) AS key FROM x LEFT JOIN a ON a.cell_id = x.cell_id LEFT JOIN e ON e.cell_id = x.cell_id
"""


@query(sql="SELECT cell_id, category, key FROM ox_header")
def header_semantics(t: Tables) -> DataFrame:
    return hd.map_headers(t.header_cells).select("cell_id", "category", "key")


@query(sql="""SELECT cell_id, arg_max(field, score*1000 - place) AS field, max(score) AS score FROM (SELECT cell_id, field, place, CASE WHEN s = alias THEN 99 WHEN starts_with(s, alias) OR ends_with(s, alias) THEN 92 WHEN length(alias) >= 4 AND contains(s, alias) THEN 84 ELSE 0 END AS score FROM ox_header CROSS JOIN ox_field) WHERE score > 0 GROUP BY 1""")
def identified_fields(t: Tables) -> DataFrame:
    return hd.identify_fields(t.header_cells, "header").filter("field is not null").select("cell_id", "field", "score")


@query(sql="""SELECT h.cell_id, coalesce((SELECT any_value(element) FROM ox_element m WHERE replace(m.word, ' ', '') = replace(h.s, ' ', '')), trim(header)) AS element FROM ox_header h""")
def element_aliases(t: Tables) -> DataFrame:
    return t.header_cells.select("cell_id", hd.element_of("header").alias("element"))


ORACLE_VIEWS["ox_signal"] = r"""
WITH x AS (SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}_]+', ' ', 'g')) AS s FROM fx_documents_text)
SELECT doc_id, s, regexp_matches(s, 'mill test certificate|mill certificate|inspection certificate|certificate of quality|material test certificate|test certificate|certificado de molino|质量证明书') AS title,
 (SELECT bool_or(contains(s, alias)) FROM ox_field WHERE field IN ('product_id','heat_no')) AS identity, (SELECT bool_or(contains(s, alias)) FROM ox_field WHERE field='chemistry') AS chemistry,
 (SELECT bool_or(contains(s, alias)) FROM ox_field WHERE field IN ('thickness_mm','width_mm')) AS size, (SELECT bool_or(contains(s, alias)) FROM ox_field WHERE field='weight_kg') AS weight, (SELECT bool_or(contains(s, alias)) FROM ox_field WHERE field='yield_strength_mpa') AS ys FROM x
"""
ORACLE_VIEWS["ox_kind"] = """
SELECT doc_id, score, CASE WHEN score >= 65 AND identity AND (chemistry OR size OR ys) THEN 'mill_certificate' WHEN score >= 35 AND (identity OR chemistry OR size OR ys) THEN 'possible_mill_certificate' ELSE 'unknown' END AS kind
FROM (SELECT *, CASE WHEN title THEN 45 ELSE 0 END + CASE WHEN identity THEN 25 ELSE 0 END + CASE WHEN chemistry THEN 20 ELSE 0 END + CASE WHEN size OR weight THEN 10 ELSE 0 END AS score FROM ox_signal)
"""


@query(sql="SELECT doc_id, score, kind FROM ox_kind")
def document_kinds(t: Tables) -> DataFrame:
    return hd.detect_documents(t.documents_text).select("doc_id", "score", "kind")


PROFILED = """concat(CASE doc_id%6 WHEN 0 THEN 'BX STEEL POSCO BTA-BLZ112 Cold Rolled Steel Strip E02511200001 ' WHEN 1 THEN 'ArcelorMittal Calvert Mill Certificate, chemical composition of the coil; steel grade/customer specification '
 WHEN 2 THEN 'Bengang SAE1010MOD E02604270139 China Steel ' WHEN 3 THEN 'China Steel Corporation SAE 1035 Hanwa ' WHEN 4 THEN 'POSCO SECC EG COIL 240816-FZ01PS ' ELSE '' END, text)"""


@query(sql=rf"""WITH x AS (SELECT doc_id, trim(regexp_replace(strip_accents(lower({PROFILED})), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS s FROM documents), c AS (SELECT doc_id, s, replace(s, ' ', '') AS k FROM x),
p AS (SELECT doc_id, CASE WHEN contains(k, 'arcelormittalcalvert') AND contains(k, 'millcertificate') THEN 50 + CASE WHEN contains(k, 'chemicalcompositionofthecoil') THEN 20 ELSE 0 END + CASE WHEN contains(k, 'steelgradecustomerspecification') THEN 20 ELSE 0 END + CASE WHEN contains(k, 'tensiletest') THEN 10 ELSE 0 END ELSE 0 END AS p1,
 CASE WHEN contains(k, 'bxsteelposco') AND NOT regexp_matches(k, 'bengang|chinasteel|secc') THEN 50 + CASE WHEN contains(k, 'btablz112') THEN 20 ELSE 0 END + CASE WHEN contains(k, 'coldrolledsteelstrip') THEN 15 ELSE 0 END + CASE WHEN contains(k, 'e02511200001') THEN 15 ELSE 0 END + CASE WHEN contains(k, 'astma1008') THEN 10 ELSE 0 END ELSE 0 END AS p2,
 CASE WHEN contains(k, 'bengang') AND NOT regexp_matches(k, 'bxsteelposco|chinasteel|secc') THEN 50 + CASE WHEN contains(k, 'e02604270139') THEN 20 ELSE 0 END + CASE WHEN contains(k, 'sae1010mod') THEN 20 ELSE 0 END + CASE WHEN contains(k, 'coldrolledsteelstrip') THEN 15 ELSE 0 END + CASE WHEN contains(k, 'btablz043') THEN 15 ELSE 0 END ELSE 0 END AS p3,
 CASE WHEN contains(k, 'chinasteelcorporation') AND NOT regexp_matches(k, 'bengang|posco|secc') THEN 50 + CASE WHEN contains(k, 'sae1035') THEN 20 ELSE 0 END + CASE WHEN contains(k, '150612h0039') THEN 20 ELSE 0 END + CASE WHEN contains(k, 'hanwa') THEN 15 ELSE 0 END + CASE WHEN contains(k, 'milledge') THEN 10 ELSE 0 END ELSE 0 END AS p4,
 CASE WHEN contains(k, 'posco') AND contains(k, 'secc') AND NOT regexp_matches(k, 'bengang|chinasteel|btablz112') THEN 50 + CASE WHEN contains(k, 'egcoil') THEN 20 ELSE 0 END + CASE WHEN contains(k, '240816fz01ps') THEN 20 ELSE 0 END + CASE WHEN contains(k, 'crfreephosphate') THEN 15 ELSE 0 END + CASE WHEN contains(k, 'ladle') THEN 10 ELSE 0 END ELSE 0 END AS p5 FROM c),
b AS (SELECT *, greatest(CASE WHEN least(p1,100) >= 85 THEN least(p1,100) ELSE 0 END, CASE WHEN least(p2,100) >= 85 THEN least(p2,100) ELSE 0 END, CASE WHEN least(p3,100) >= 85 THEN least(p3,100) ELSE 0 END, CASE WHEN least(p4,100) >= 85 THEN least(p4,100) ELSE 0 END, CASE WHEN least(p5,100) >= 85 THEN least(p5,100) ELSE 0 END) AS best FROM p)
SELECT doc_id, CASE WHEN best = 0 THEN NULL WHEN least(p1,100) = best THEN 'ARCELORMITTAL_CALVERT' WHEN least(p2,100) = best THEN 'MOLINO_1_BX_POSCO' WHEN least(p3,100) = best THEN 'MOLINO_2_BENGANG' WHEN least(p4,100) = best THEN 'MOLINO_3_CHINA_STEEL' ELSE 'MOLINO_4_POSCO_EG' END AS profile, best AS profile_score FROM b""")
def format_profiles(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.expr(PROFILED).alias("text"))
    return hd.score_profiles(docs).select("doc_id", "profile", F.round(F.col("profile_score") * 100).cast("int").alias("profile_score"))


@query(sql="""WITH f AS (SELECT c.doc_id, page, table_idx, row_idx, c.col_idx, h.s FROM fx_table_cells c JOIN (SELECT DISTINCT header, s FROM ox_header) h ON h.header = c.text WHERE row_idx < 6),
i AS (SELECT doc_id, row_idx, col_idx, arg_max(field, score*1000 - place) AS field, max(score) AS score FROM (SELECT f.*, field, place, CASE WHEN s = alias THEN 99 WHEN starts_with(s, alias) OR ends_with(s, alias) THEN 92 WHEN length(alias) >= 4 AND contains(s, alias) THEN 84 ELSE 0 END AS score FROM f CROSS JOIN ox_field) WHERE score > 0 GROUP BY 1,2,3),
r AS (SELECT doc_id, row_idx, count(DISTINCT field) AS fields, CAST(floor(least(9900, sum(score) * 100 * least(4, count(DISTINCT field)) / (count(*) * 4))) AS INT) AS score_bp FROM i GROUP BY 1,2 HAVING count(DISTINCT field) >= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score_bp DESC, row_idx) AS k FROM r)
SELECT b.doc_id, row_idx AS header_row, fields, score_bp, n - row_idx - 1 AS row_count FROM b JOIN (SELECT doc_id, max(row_idx) + 1 AS n FROM fx_table_cells GROUP BY 1) z ON z.doc_id = b.doc_id WHERE k = 1""")
def table_candidates(t: Tables) -> DataFrame:
    return hd.detect_tables(t.table_cells).select("doc_id", "header_row", "fields", "score_bp", "row_count")


@query(sql="""SELECT doc_id, CASE WHEN doc_id%10=0 THEN 'needs_ocr' WHEN doc_id%7=0 AND doc_id%4<>1 THEN 'incompatible_template' WHEN doc_id%7=0 THEN 'user_template' WHEN doc_id%4>1 THEN 'ambiguous_user_templates' WHEN doc_id%5=1 AND doc_id%3<>0 THEN 'known_profile'
 WHEN doc_id%4=1 THEN 'user_template' WHEN doc_id%2=0 THEN 'generic_layout_extractor' ELSE 'none' END AS route, CASE WHEN doc_id%10=0 THEN 'needs_ocr' WHEN doc_id%7=0 OR doc_id%4>1 THEN 'needs_review' WHEN doc_id%5=1 AND doc_id%3<>0 THEN 'extracted'
 WHEN doc_id%4=1 OR doc_id%2=0 THEN 'needs_review' WHEN kind='unknown' AND doc_id%5<>1 THEN 'unsupported' ELSE 'needs_review' END AS status FROM ox_kind""")
def extraction_routes(t: Tables) -> DataFrame:
    docs = hd.detect_documents(t.documents_text).withColumns({
        "needs_ocr": F.expr("doc_id%10 = 0"), "explicit_template": F.expr("doc_id%7 = 0"), "n_templates": F.expr("doc_id%4"), "profile": F.expr("if(doc_id%5 = 1, 'known', null)"),
        "profile_usable": F.expr("doc_id%3 <> 0"), "generic_rows": F.expr("if(doc_id%2 = 0, 3, 0)")})
    return hd.route_documents(docs).select("doc_id", "route", "status")


BODY = "CASE WHEN doc_id%5=0 THEN 'a 1 b 2 c 3 d e f g h i j k l m n' WHEN doc_id%7=0 THEN 'short' ELSE text END"


@query(sql=f"""WITH w AS (SELECT doc_id, doc_id%3 AS page, trim(unnest(string_split({BODY}, ' '))) AS word FROM documents), p AS (SELECT doc_id, page, count(*) AS words, sum(length(word)) AS chars, count(CASE WHEN regexp_full_match(word, '[A-Za-z0-9]') THEN 1 END) AS single FROM w GROUP BY 1,2)
SELECT doc_id, page, words, CASE WHEN chars >= 20 AND single*10 < words*7 THEN 'digital' ELSE 'unreadable' END AS source FROM p""")
def page_readability(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.expr("doc_id%3").alias("page"), F.explode(F.split(F.expr(BODY), " ")).alias("word"))
    return hd.page_readability(words).select("doc_id", "page", "words", "source")


@query(sql="""WITH b AS (SELECT doc_id, block_id, CASE block_id%3 WHEN 0 THEN 'Y.S.T.S.' WHEN 1 THEN 'Cu Ni' ELSE text END AS text, x0, x1 FROM fx_blocks)
SELECT doc_id, block_id, k AS part, CASE WHEN block_id%3=2 THEN text WHEN block_id%3=0 THEN CASE k WHEN 0 THEN 'Y.S.' ELSE 'T.S.' END ELSE CASE k WHEN 0 THEN 'Cu' ELSE 'Ni' END END AS text, CASE WHEN block_id%3=2 THEN x0 ELSE x0 + k*(x1-x0)/2 END AS x0, CASE WHEN block_id%3=2 THEN x1 ELSE x0 + (k+1)*(x1-x0)/2 END AS x1
FROM b CROSS JOIN (VALUES (0),(1)) AS v(k) WHERE (k = 0 OR block_id%3 <> 2)""")
def merged_headers(t: Tables) -> DataFrame:
    blocks = t.blocks.select("doc_id", "block_id", F.expr("CASE block_id%3 WHEN 0 THEN 'Y.S.T.S.' WHEN 1 THEN 'Cu Ni' ELSE coalesce(text, '') END").alias("text"), "x0", "x1", F.col("text").isNull().alias("_null"))
    return hd.split_merged_headers(blocks).select("doc_id", "block_id", "part", F.expr("if(block_id%3 = 2 and _null, null, text)").alias("text"), "x0", "x1")
