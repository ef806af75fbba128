"""History search, joins, windows, set operations and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millspark.functions import refdata as ref
from millspark.operators import history as h
from workload.registry import ORACLE_VIEWS, Tables, query


def search(t: Tables, **conditions) -> DataFrame:
    runs = t.runs.withColumn("created_at", F.expr("(run_id*7)%13"))
    return h.search_certificates(t.certificates, t.manufacturers, t.heats, t.products, runs, t.results, **conditions)


ORACLE_VIEWS["ox_listed"] = """
SELECT c.*, m.name AS manufacturer, coalesce(certificate_date, CAST(uploaded_at AS DATE)) AS sort_date FROM fx_certificates c LEFT JOIN fx_manufacturers m ON m.manufacturer_id = c.manufacturer_id WHERE NOT archived
"""
ORACLE_VIEWS["ox_search_run"] = "SELECT certificate_id, arg_max(run_id, ((run_id*7)%13)*1000000000 + run_id) AS run_id FROM fx_runs GROUP BY 1"


@query(sql="SELECT certificate_id, certificate_no, manufacturer, sort_date FROM ox_listed WHERE lower(certificate_no) LIKE '%c-12%' OR CAST(certificate_id AS VARCHAR) = 'C-12' OR lower('Acta #' || certificate_id) = 'c-12'")
def search_by_number(t: Tables) -> DataFrame:
    return search(t, certificate=" C-12 ").select("certificate_id", "certificate_no", "manufacturer", "sort_date")


@query(sql="SELECT certificate_id, manufacturer FROM ox_listed WHERE contains(lower(manufacturer), '00007')")
def search_by_manufacturer(t: Tables) -> DataFrame:
    return search(t, manufacturer="00007").select("certificate_id", "manufacturer")


@query(sql="SELECT certificate_id FROM ox_listed WHERE certificate_id IN (SELECT certificate_id FROM fx_heats WHERE contains(lower(heat_no), '77'))")
def search_by_heat(t: Tables) -> DataFrame:
    return search(t, heat="77").select("certificate_id")


@query(sql="""SELECT certificate_id FROM ox_listed WHERE certificate_id IN (SELECT p.certificate_id FROM fx_products p JOIN fx_results r ON r.product_id = p.product_id JOIN ox_search_run l ON l.run_id = r.run_id WHERE r.fraction LIKE '720917%' AND r.nico = '01')""")
def search_by_code(t: Tables) -> DataFrame:
    return search(t, fraction="7209.17", nico="01").select("certificate_id")


@query(sql="""SELECT certificate_id FROM ox_listed WHERE approval_status = 'needs_review' AND certificate_id IN (SELECT p.certificate_id FROM fx_products p JOIN fx_results r ON r.product_id = p.product_id JOIN ox_search_run l ON l.run_id = r.run_id
WHERE contains(lower(p.heat_no), '5') AND contains(lower(p.product_identifier), 'coil-1') AND starts_with(r.fraction, '7208'))""")
def search_same_roll(t: Tables) -> DataFrame:
    return search(t, heat="5", roll="COIL-1", fraction="7208", approval_status="needs_review").select("certificate_id")


@query(sql="SELECT certificate_id, sort_date FROM ox_listed WHERE certificate_date BETWEEN DATE '1995-03-01' AND DATE '1995-03-31'")
def search_by_certificate_date(t: Tables) -> DataFrame:
    return search(t, date_from="1995-03-01", date_to="1995-03-31").select("certificate_id", "sort_date")


@query(sql="SELECT certificate_id, CAST(uploaded_at AS DATE) AS sort_date FROM ox_listed WHERE CAST(uploaded_at AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-03-31' AND processing_status = 'succeeded'")
def search_by_upload_date(t: Tables) -> DataFrame:
    return search(t, date_from="1995-03-01", date_to="1995-03-31", date_basis="uploaded", processing_status="succeeded").select("certificate_id", "sort_date")


@query(sql="""SELECT h.heat_id, h.heat_no, c.certificate_id, m.name AS manufacturer, coalesce(certificate_date, CAST(uploaded_at AS DATE)) AS sort_date FROM fx_heats h JOIN fx_certificates c ON c.certificate_id = h.certificate_id LEFT JOIN fx_manufacturers m ON m.manufacturer_id = c.manufacturer_id
WHERE contains(lower(h.heat_no), '12') AND coalesce(certificate_date, CAST(uploaded_at AS DATE)) >= DATE '1996-01-01'""")
def heat_list(t: Tables) -> DataFrame:
    return h.search_heats(t.heats, t.certificates, t.manufacturers, heat="12", date_from="1996-01-01").select("heat_id", "heat_no", "certificate_id", "manufacturer", "sort_date")


@query(sql="""SELECT p.product_id, p.product_identifier, c.certificate_no, h.standard AS heat_standard FROM fx_products p JOIN fx_certificates c ON c.certificate_id = p.certificate_id LEFT JOIN fx_heats h ON h.heat_id = p.heat_id
WHERE EXISTS (SELECT 1 FROM fx_results r JOIN fx_runs u ON u.run_id = r.run_id WHERE r.product_id = p.product_id AND u.approval_status = 'approved' AND r.fraction = '72091601')""")
def product_list(t: Tables) -> DataFrame:
    return h.search_products(t.products, t.certificates, t.heats, t.runs, t.results, fraction="72091601").select("product_id", "product_identifier", "certificate_no", "heat_standard")


@query(sql="""SELECT certificate_id, sort_date, row_number() OVER (ORDER BY sort_date DESC, certificate_id DESC) AS place, true AS has_more FROM ox_listed WHERE (sort_date, certificate_id) < (DATE '1997-06-15', 9000) ORDER BY sort_date DESC, certificate_id DESC LIMIT 50""")
def cursor_page(t: Tables) -> DataFrame:
    return h.page_after(search(t), "sort_date", "certificate_id", 50, ("1997-06-15", 9000)).select("certificate_id", "sort_date", "place", "has_more")


@query(sql="SELECT certificate_id, max(run_id) AS run_id FROM fx_runs GROUP BY 1")
def latest_runs_by_id(t: Tables) -> DataFrame:
    return h.latest_runs(t.runs).select("certificate_id", "run_id")


@query(sql="SELECT certificate_id, run_id FROM ox_search_run")
def latest_runs_by_time(t: Tables) -> DataFrame:
    return h.latest_runs(t.runs.withColumn("created_at", F.expr("(run_id*7)%13")), "created_at").select("certificate_id", "run_id")


@query(sql="SELECT run_id, lag(run_id) OVER (PARTITION BY certificate_id ORDER BY run_id) AS chained_parent_id FROM fx_runs")
def parent_runs(t: Tables) -> DataFrame:
    return h.parent_runs(t.runs).select("run_id", "chained_parent_id")


@query(sql="SELECT stored_file_id, max(certificate_id) AS certificate_id FROM fx_certificates GROUP BY 1")
def latest_certificate_per_file(t: Tables) -> DataFrame:
    from millspark.operators.quality import latest_per_file
    return latest_per_file(t.certificates)


@query(sql="""SELECT result_id, arg_max(selection_id, selection_id) AS selection_id FROM fx_selections s WHERE selection_id NOT IN (SELECT supersedes_selection_id FROM fx_selections WHERE supersedes_selection_id IS NOT NULL)
AND result_id NOT IN (SELECT result_id FROM fx_selections WHERE selection_cleared) GROUP BY 1""")
def current_selections(t: Tables) -> DataFrame:
    return h.current_selections(t.selections).select("result_id", "selection_id")


@query(sql="SELECT run_id, max(event_id) AS event_id, arg_max(to_status, event_id) AS to_status FROM fx_approval_events GROUP BY 1")
def latest_approvals(t: Tables) -> DataFrame:
    return h.latest_approvals(t.approval_events).select("run_id", "event_id", "to_status")


def scoped_evidence(t: Tables) -> DataFrame:
    return t.observations.withColumns({"roll_id": F.col("product_id"), "has_box": F.expr("observation_id%2 = 0"), "product_id": F.expr("if(observation_id%3 = 0, null, product_id)")})


@query(sql="""SELECT product_id AS roll_id, field_path, arg_max(observation_id, (CASE WHEN page_number IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN observation_id%2=0 THEN 2 ELSE 0 END + CASE WHEN observation_id%3<>0 THEN 1 ELSE 0 END)*CAST(1000000000 AS BIGINT) + observation_id) AS observation_id FROM fx_observations GROUP BY 1,2""")
def best_evidence(t: Tables) -> DataFrame:
    return h.best_evidence(scoped_evidence(t)).select("roll_id", "field_path", "observation_id")


@query(sql="""SELECT p.product_id, coalesce((SELECT min(observation_id) FROM fx_quality_observations o WHERE o.product_id = p.product_id), (SELECT min(observation_id) FROM fx_quality_observations o WHERE o.product_id IS NULL AND o.heat_id = p.heat_id)) AS evidence_id FROM fx_products p""")
def first_evidence(t: Tables) -> DataFrame:
    return h.first_evidence(t.products, t.quality_observations).select("product_id", "evidence_id")


@query(sql="""WITH c AS (SELECT *, row_number() OVER (PARTITION BY manufacturer_id, certificate_no ORDER BY certificate_id) AS n, lag(certificate_id) OVER (PARTITION BY manufacturer_id, certificate_no ORDER BY certificate_id) AS p FROM fx_certificates)
SELECT certificate_id, CASE WHEN manufacturer_id IS NULL OR certificate_no IS NULL THEN 1 ELSE n END AS revision_number, CASE WHEN manufacturer_id IS NULL OR certificate_no IS NULL THEN NULL ELSE p END AS supersedes_id FROM c""")
def revision_chains(t: Tables) -> DataFrame:
    return h.chain_revisions(t.certificates).select("certificate_id", "revision_number", "supersedes_id")


@query(sql="""SELECT c.certificate_id, c.certificate_no, m.name AS manufacturer, c.document_id, c.stored_file_id FROM fx_certificates c LEFT JOIN fx_manufacturers m ON m.manufacturer_id = c.manufacturer_id""")
def certificate_list(t: Tables) -> DataFrame:
    return t.certificates.join(t.manufacturers.selectExpr("manufacturer_id", "name as manufacturer"), "manufacturer_id", "left").select("certificate_id", "certificate_no", "manufacturer", "document_id", "stored_file_id")


SCOPED = "SELECT CASE WHEN product_id%5=0 THEN product_id END AS product_id, heat_id, element, percentage, product_id*10 + length(element) AS row_id FROM fx_roll_compositions"


@query(sql=f"""WITH r AS ({SCOPED}), s AS (SELECT p.product_id, element, percentage, 'product' AS scope, row_id, 1 AS pr FROM fx_products p JOIN r ON r.product_id = p.product_id
 UNION ALL SELECT p.product_id, element, percentage, 'heat', row_id, 0 FROM fx_products p JOIN r ON r.product_id IS NULL AND r.heat_id = p.heat_id)
SELECT product_id, element, scope, percentage FROM (SELECT *, row_number() OVER (PARTITION BY product_id, element ORDER BY pr DESC, row_id DESC) AS k FROM s) WHERE k = 1""")
def rows_in_roll_scope(t: Tables) -> DataFrame:
    rows = t.roll_compositions.selectExpr("if(product_id%5 = 0, product_id, null) as product_id", "heat_id", "element", "percentage", "product_id*10 + length(element) as row_id")
    return h.scope_rows(t.products, rows, "element", "row_id").select("product_id", "element", "scope", "percentage")


# Every eleventh observation names a heat only; every thirteenth overrides with null.
ORACLE_VIEWS["ox_current"] = """SELECT CASE WHEN observation_id%11<>0 THEN product_id END AS product_id, CAST(floor(product_id/10)*10 + observation_id%3 AS BIGINT) AS heat_id, field_path, observation_id,
 CASE WHEN observation_id%13<>0 THEN normalized_value END AS v FROM fx_observations WHERE is_current"""
ORACLE_VIEWS["ox_overlay"] = """SELECT product_id, field_path, v FROM (SELECT *, row_number() OVER (PARTITION BY product_id, field_path ORDER BY own DESC, observation_id DESC) AS k FROM (
 SELECT p.product_id, field_path, v, observation_id, 1 AS own FROM fx_products p JOIN ox_current o ON o.product_id = p.product_id
 UNION ALL SELECT p.product_id, field_path, v, observation_id, 0 FROM fx_products p JOIN ox_current o ON o.product_id IS NULL AND o.heat_id = p.heat_id) s) WHERE k = 1"""


def overlay(t: Tables):
    observations = t.observations.selectExpr("if(observation_id%11 = 0, null, product_id) as product_id", "cast(floor(product_id/10)*10 + observation_id%3 as bigint) as heat_id", "field_path",
                                             "if(observation_id%13 = 0, null, normalized_value) as normalized_value", "observation_id", "is_current")
    return h.overlay_observations(t.products, t.roll_compositions, observations, {"thickness_mm": "thickness_mm", "width_mm": "width_mm", "mechanical_properties.yield_strength_mpa": "yield_strength_mpa"})


@query(sql="""SELECT p.product_id, CASE WHEN a.product_id IS NOT NULL THEN a.v ELSE thickness_mm END AS thickness_mm, CASE WHEN b.product_id IS NOT NULL THEN b.v ELSE width_mm END AS width_mm, CASE WHEN c.product_id IS NOT NULL THEN c.v ELSE yield_strength_mpa END AS yield_strength_mpa
FROM fx_products p LEFT JOIN ox_overlay a ON a.product_id = p.product_id AND a.field_path='thickness_mm' LEFT JOIN ox_overlay b ON b.product_id = p.product_id AND b.field_path='width_mm' LEFT JOIN ox_overlay c ON c.product_id = p.product_id AND c.field_path LIKE 'mech%'""")
def overlaid_products(t: Tables) -> DataFrame:
    return overlay(t)[0].select("product_id", "thickness_mm", "width_mm", "yield_strength_mpa")


@query(sql="""SELECT coalesce(c.product_id, o.product_id) AS product_id, coalesce(c.element, o.e) AS element, CASE WHEN o.product_id IS NOT NULL THEN o.v ELSE percentage END AS percentage FROM fx_roll_compositions c FULL JOIN (SELECT product_id, split_part(field_path,'.',2) AS e, v FROM ox_overlay WHERE field_path LIKE 'composition%') o ON o.product_id = c.product_id AND o.e = c.element""")
def overlaid_compositions(t: Tables) -> DataFrame:
    return overlay(t)[1].select("product_id", "element", "percentage")


@query(sql="""WITH f AS (SELECT candidate_id, string_agg(sequence || ':' || rule_code || ':' || outcome, ';' ORDER BY sequence) AS factors FROM fx_factors GROUP BY 1), c AS (SELECT result_id, string_agg(rank || '=' || fraction || nico || '[' || coalesce(factors,'') || ']', ' ' ORDER BY rank, fraction, nico) AS detail FROM fx_candidates k LEFT JOIN f ON f.candidate_id = k.candidate_id GROUP BY 1)
SELECT r.result_id, detail FROM fx_results r LEFT JOIN c ON c.result_id = r.result_id""")
def run_details(t: Tables) -> DataFrame:
    df = h.run_detail(t.results, t.candidates, t.factors)
    text = F.expr("array_join(transform(candidates, c -> concat(c.rank, '=', c.fraction, c.nico, '[', array_join(transform(c.factors, f -> concat(f.sequence, ':', f.rule_code, ':', f.outcome)), ';'), ']')), ' ')")
    return df.select("result_id", text.alias("detail"))


@query(sql="""SELECT l.link_id, l.observation_id, c.certificate_id, c.document_id, CASE WHEN page_number IS NULL THEN 'original_file' WHEN l.observation_id%2=0 THEN 'focus' ELSE 'full_page' END AS view FROM fx_links l JOIN fx_observations o ON o.observation_id = l.observation_id JOIN fx_certificates c ON c.certificate_id = CAST(floor(o.product_id/10) AS BIGINT)""")
def evidence_views(t: Tables) -> DataFrame:
    observations = t.observations.selectExpr("observation_id", "page_number", "observation_id%2 = 0 as has_box", "cast(floor(product_id/10) as bigint) as certificate_id")
    return h.resolve_evidence(t.links, observations, t.certificates).select("link_id", "observation_id", "certificate_id", "document_id", "view")


@query(sql="SELECT product_id FROM fx_products WHERE product_id NOT IN (SELECT product_id FROM fx_results)")
def products_without_result(t: Tables) -> DataFrame:
    return h.missing_results(t.products, t.results).select("product_id")


@query(sql="""WITH r AS (SELECT DISTINCT certificate_id, product_id FROM fx_results UNION ALL SELECT certificate_id, -product_id FROM fx_products WHERE product_id%89=0)
SELECT coalesce(p.certificate_id, r.certificate_id) AS certificate_id, count(CASE WHEN r.product_id IS NULL THEN 1 END) AS only_left, count(CASE WHEN p.product_id IS NULL THEN 1 END) AS only_right, count(r.product_id) = count(*) AND count(p.product_id) = count(*) AS equal
FROM fx_products p FULL JOIN r ON r.certificate_id = p.certificate_id AND r.product_id = p.product_id GROUP BY 1""")
def result_sets_match(t: Tables) -> DataFrame:
    right = t.results.select("certificate_id", "product_id").unionByName(t.products.filter("product_id%89 = 0").selectExpr("certificate_id", "-product_id as product_id"))
    return h.set_equality(t.products, right, "certificate_id", "product_id").select("certificate_id", "only_left", "only_right", "equal")


ALLOY = "SELECT * FROM (VALUES ('Mn',10.0,20.0,60.0,30.0,'nota a'),('Cr',12.0,40.0,80.0,50.0,'nota b'),('B',8.0,60.0,50.0,70.0,'nota a')) AS v(element,x0,top,x1,bottom,text)"


@query(sql=f"""WITH a AS ({ALLOY}), s AS (SELECT result_id AS step_id, fraction, nico, unnest(CASE WHEN product_id%2=0 THEN ['Mn','Cr'] ELSE ['B'] END) AS element FROM fx_results), c AS (SELECT code FROM fx_catalog GROUP BY 1 HAVING count(*) = 1),
g AS (SELECT step_id, any_value(fraction || coalesce(nico,'')) AS code, min(x0) AS x0, max(x1) AS x1, string_agg(DISTINCT text, '; ' ORDER BY text) AS text FROM s JOIN a ON a.element = s.element GROUP BY 1)
SELECT g.step_id, g.code, c.code IS NOT NULL AS in_catalog, CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1, text FROM g LEFT JOIN c ON c.code = g.code""")
def rule_references(t: Tables) -> DataFrame:
    steps = t.results.selectExpr("result_id as step_id", "fraction", "nico", "if(product_id%2 = 0, array('Mn', 'Cr'), array('B')) as elements")
    alloy = t.spark.sql("SELECT element, cast(x0 as double) x0, cast(top as double) top, cast(x1 as double) x1, cast(bottom as double) bottom, text FROM (" + ALLOY + ")")
    catalog = t.catalog.withColumn("page", F.lit(1))
    return h.rule_references(steps, catalog, alloy).selectExpr("step_id", "code", "page is not null as in_catalog", "x0", "x1", "text")


@query(sql="SELECT observation_id, string_agg(DISTINCT rule_code, '; ' ORDER BY rule_code) AS rules FROM fx_links l JOIN fx_factors f ON f.factor_id = l.factor_id GROUP BY 1")
def rules_by_observation(t: Tables) -> DataFrame:
    return h.rules_by_observation(t.links, t.factors)


@query(sql="SELECT heat_id, string_agg(element || '=' || coalesce(CAST(percentage AS VARCHAR), ''), ',' ORDER BY element) AS composition FROM fx_compositions GROUP BY 1")
def composition_maps(t: Tables) -> DataFrame:
    from millspark.operators.facts import composition_maps as build
    return build(t.compositions).select("heat_id", F.expr("array_join(transform(map_entries(composition_pct), e -> concat(e.key, '=', coalesce(cast(e.value as string), ''))), ',')").alias("composition"))


@query(sql="""SELECT 'Actas incluidas' AS concept, CAST(count(*) AS VARCHAR) AS detail FROM fx_certificates UNION ALL SELECT 'Batches incluidos', CAST(count(*) AS VARCHAR) FROM fx_heats UNION ALL SELECT 'Coladas incluidas', CAST(count(*) AS VARCHAR) FROM fx_products
UNION ALL SELECT 'Clasificaciones incluidas', CAST(count(*) AS VARCHAR) FROM fx_results UNION ALL SELECT 'Selecciones registradas', CAST(count(*) AS VARCHAR) FROM fx_choices UNION ALL SELECT 'Actas aprobadas', CAST(count(*) AS VARCHAR) FROM fx_certificates WHERE approval_status='approved'
UNION ALL SELECT 'Ejecuciones aprobadas', CAST(count(*) AS VARCHAR) FROM fx_runs WHERE approval_status='approved' UNION ALL SELECT DISTINCT 'Proveedor / fabricante', coalesce(m.name, 'No disponible') FROM fx_certificates c LEFT JOIN fx_manufacturers m ON m.manufacturer_id = c.manufacturer_id""")
def report_summary(t: Tables) -> DataFrame:
    return h.report_summary(t.certificates, t.heats, t.products, t.results, t.choices, t.runs, t.manufacturers)


@query(sql="SELECT run_id, count(CASE WHEN outcome='classified' THEN 1 END) AS classified, count(*) AS total, count(CASE WHEN outcome='classified' THEN 1 END) = count(*) AS complete FROM fx_results GROUP BY 1")
def run_summary(t: Tables) -> DataFrame:
    return h.run_summary(t.results)


@query(sql="""WITH v AS (SELECT event_type, CAST(value AS DECIMAL(28,8)) AS v FROM events WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM v)
SELECT event_type, n, CAST((max(CASE WHEN k = (n+1)//2 THEN v END) + max(CASE WHEN k = n//2+1 THEN v END))*0.5 AS DECIMAL(28,9)) AS median, max(CASE WHEN k = CAST(ceil(n*0.95) AS BIGINT) THEN v END) AS p95, max(v) AS maximum FROM r GROUP BY 1,2""")
def latency_summary(t: Tables) -> DataFrame:
    return h.latency_summary(t.events, "event_type", "value")


@query(sql="SELECT result_id, max(rank) + 1 AS next_value FROM fx_candidates GROUP BY 1")
def next_candidate_rank(t: Tables) -> DataFrame:
    return h.next_sequence(t.candidates, ["result_id"], "rank")


@query(sql="""WITH x AS (SELECT user_id%50 AS version_id, count(DISTINCT CASE WHEN event_id%2=0 AND event_type IN ('click','view') THEN user_id END) AS documents FROM events GROUP BY 1), a AS (SELECT p_size AS version_id, count(DISTINCT p_brand) AS anchors FROM part GROUP BY 1)
SELECT a.version_id, anchors, coalesce(documents, 0) AS documents, anchors >= 2 AND coalesce(documents, 0) >= 3 AS eligible FROM a LEFT JOIN x ON x.version_id = a.version_id""")
def format_activation(t: Tables) -> DataFrame:
    tests = t.events.selectExpr("user_id%50 as version_id", "user_id as document_id", "event_id%2 = 0 as reviewed", "if(event_type in ('click', 'view'), 'success', 'error') as status")
    return h.format_activation(tests, t.part.selectExpr("p_size as version_id", "p_brand as anchor_text")).select("version_id", "anchors", "documents", "eligible")


@query(sql="SELECT 'certificates' AS table_name, count(*) AS rows FROM fx_certificates UNION ALL SELECT 'heats', count(*) FROM fx_heats UNION ALL SELECT 'products', count(*) FROM fx_products UNION ALL SELECT 'observations', count(*) FROM fx_observations")
def table_counts(t: Tables) -> DataFrame:
    return h.table_counts({"certificates": t.certificates, "heats": t.heats, "products": t.products, "observations": t.observations})


@query(sql="""WITH l AS (SELECT event_id AS backup_id, ts, CASE event_type WHEN 'click' THEN 'daily' WHEN 'view' THEN 'weekly' WHEN 'purchase' THEN 'monthly' ELSE 'manual' END AS kind FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, backup_id DESC) AS k FROM l)
SELECT backup_id, kind, CASE WHEN k <= CASE kind WHEN 'daily' THEN 7 WHEN 'weekly' THEN 4 WHEN 'monthly' THEN 12 ELSE 3 END THEN 'keep' ELSE 'expire' END AS decision FROM r""")
def retention_plan(t: Tables) -> DataFrame:
    log = t.events.selectExpr("event_id as backup_id", "ts as created_at", "CASE event_type WHEN 'click' THEN 'daily' WHEN 'view' THEN 'weekly' WHEN 'purchase' THEN 'monthly' ELSE 'manual' END as kind")
    return h.retention_plan(log, {"daily": 7, "weekly": 4, "monthly": 12, "manual": 3}).select("backup_id", "kind", "decision")


@query(sql="""WITH w AS (SELECT certificate_id*2 AS certificate_id FROM fx_certificates WHERE certificate_id%50=0 UNION SELECT certificate_id FROM fx_heats WHERE heat_id%700=0 UNION SELECT certificate_id FROM fx_runs WHERE run_id%900=0)
SELECT certificate_id, certificate_id IN (SELECT certificate_id FROM fx_certificates) AS known FROM w""")
def requested_scope(t: Tables) -> DataFrame:
    found, missing = h.resolve_scope(t.certificates, t.certificates.filter("certificate_id%50 = 0").selectExpr("certificate_id*2 as certificate_id"), t.heats.filter("heat_id%700 = 0"), t.runs.filter("run_id%900 = 0"))
    return found.withColumn("known", F.lit(True)).unionByName(missing.withColumn("known", F.lit(False)))


@query(sql="""WITH a AS (SELECT p_partkey AS rule, p_brand AS d FROM part WHERE p_partkey%7<>0), b AS (SELECT p_partkey AS rule, CASE WHEN p_partkey%11=0 THEN p_type ELSE p_brand END AS d FROM part WHERE p_partkey%5<>0)
SELECT coalesce(a.rule, b.rule) AS rule, CASE WHEN a.rule IS NULL THEN 'added' WHEN b.rule IS NULL THEN 'removed' ELSE 'modified' END AS change, a.rule IS NOT NULL AS breaking FROM a FULL JOIN b ON b.rule = a.rule WHERE a.rule IS NULL OR b.rule IS NULL OR a.d <> b.d""")
def rule_set_diff(t: Tables) -> DataFrame:
    old = t.part.filter("p_partkey%7 <> 0").selectExpr("p_partkey as rule", "p_brand as definition")
    new = t.part.filter("p_partkey%5 <> 0").selectExpr("p_partkey as rule", "if(p_partkey%11 = 0, p_type, p_brand) as definition")
    return h.diff_rule_sets(old, new).select("rule", "change", "breaking")


@query(sql="""WITH i AS (SELECT certificate_id FROM fx_certificates WHERE stored_file_id IN (3,4) OR certificate_id%40=7), p AS (SELECT product_id FROM fx_products WHERE certificate_id IN (SELECT certificate_id FROM i))
SELECT 'certificates' AS table_name, certificate_id AS id FROM i UNION ALL SELECT 'heats', heat_id FROM fx_heats WHERE certificate_id IN (SELECT certificate_id FROM i) UNION ALL SELECT 'products', product_id FROM p UNION ALL SELECT 'observations', observation_id FROM fx_observations WHERE product_id IN (SELECT product_id FROM p)
UNION ALL SELECT DISTINCT 'files', stored_file_id FROM fx_certificates WHERE certificate_id IN (SELECT certificate_id FROM i) AND stored_file_id NOT IN (SELECT stored_file_id FROM fx_certificates WHERE certificate_id NOT IN (SELECT certificate_id FROM i))""")
def deletion_scope(t: Tables) -> DataFrame:
    ids = t.certificates.filter("stored_file_id in (3, 4) or certificate_id%40 = 7").select("certificate_id")
    return h.deletion_scope(t.certificates, t.heats, t.products, t.observations, ids)


ORACLE_VIEWS["ox_deletion_observations"] = """
SELECT observation_id, CASE WHEN observation_id%3 <> 0 THEN product_id END AS product_id, CASE WHEN observation_id%3 = 0 AND observation_id%2 = 0 THEN CAST(floor(product_id/10) AS BIGINT)*10 END AS heat_id, CAST(floor(product_id/10) AS BIGINT) AS certificate_id FROM fx_observations
"""
ORACLE_VIEWS["ox_deletion_found"] = """
WITH c AS (SELECT certificate_id FROM fx_certificates WHERE stored_file_id IN (3,4) OR certificate_id%40=7),
o AS (SELECT observation_id FROM ox_deletion_observations WHERE CASE WHEN product_id IS NOT NULL THEN product_id IN (SELECT product_id FROM fx_products WHERE certificate_id IN (SELECT certificate_id FROM c))
 WHEN heat_id IS NOT NULL THEN heat_id IN (SELECT heat_id FROM fx_heats WHERE certificate_id IN (SELECT certificate_id FROM c)) ELSE certificate_id IN (SELECT certificate_id FROM c) END),
u AS (SELECT run_id FROM fx_runs WHERE certificate_id IN (SELECT certificate_id FROM c)), r AS (SELECT result_id FROM fx_results WHERE run_id IN (SELECT run_id FROM u)),
d AS (SELECT candidate_id FROM fx_candidates WHERE result_id IN (SELECT result_id FROM r)), f AS (SELECT factor_id FROM fx_factors WHERE candidate_id IN (SELECT candidate_id FROM d))
SELECT 'observations' AS table_name, observation_id AS id FROM o UNION ALL SELECT 'runs', run_id FROM u UNION ALL SELECT 'results', result_id FROM r UNION ALL SELECT 'candidates', candidate_id FROM d UNION ALL SELECT 'factors', factor_id FROM f
UNION ALL SELECT DISTINCT 'links', link_id FROM fx_links WHERE factor_id IN (SELECT factor_id FROM f) OR observation_id IN (SELECT observation_id FROM o) UNION ALL SELECT 'selections', selection_id FROM fx_choices WHERE result_id IN (SELECT result_id FROM r)
UNION ALL SELECT 'approvals', event_id FROM fx_approval_events WHERE run_id IN (SELECT run_id FROM u) UNION ALL SELECT 'corrections', observation_id FROM o WHERE observation_id%5 = 0
"""


@query(sql="SELECT table_name, id FROM ox_deletion_found")
def deletion_scope_chain(t: Tables) -> DataFrame:
    """What ``deletion_scope`` finds beyond the certificates' own rows: all observations, the classification chain and the logs."""
    # Every table of the chain starts from the results; links are looked up by factor and by observation.
    t.write_once("results").write_once("links")
    ids = t.certificates.filter("stored_file_id in (3, 4) or certificate_id%40 = 7").select("certificate_id")
    scoped = t.observations.selectExpr("observation_id", "if(observation_id%3 <> 0, product_id, null) as product_id", "if(observation_id%6 = 0, cast(floor(product_id/10) as bigint)*10, null) as heat_id", "cast(floor(product_id/10) as bigint) as certificate_id")
    corrections = scoped.filter("observation_id%5 = 0").withColumnRenamed("observation_id", "correction_id")
    related = {"runs": t.runs, "results": t.results, "candidates": t.candidates, "factors": t.factors, "links": t.links, "selections": t.choices, "approvals": t.approval_events, "corrections": corrections}
    return h.deletion_scope(t.certificates, t.heats, t.products, scoped, ids, related).filter("table_name not in ('certificates', 'heats', 'products', 'files')")


ORACLE_VIEWS["ox_gone"] = "SELECT * FROM fx_certificates WHERE stored_file_id IN (3,4) OR certificate_id%40=7"


@query(sql="""WITH c AS (SELECT certificate_id, document_id FROM ox_gone), d AS (SELECT DISTINCT document_id FROM c), r AS (SELECT run_id FROM fx_runs WHERE certificate_id IN (SELECT certificate_id FROM c)),
h AS (SELECT heat_id FROM fx_heats WHERE certificate_id IN (SELECT certificate_id FROM c)), x AS (SELECT result_id FROM fx_results WHERE run_id IN (SELECT run_id FROM r)),
o AS (SELECT observation_id FROM fx_observations WHERE product_id IN (SELECT product_id FROM fx_products WHERE certificate_id IN (SELECT certificate_id FROM c))), f AS (SELECT factor_id FROM fx_factors WHERE candidate_id IN (SELECT candidate_id FROM fx_candidates WHERE result_id IN (SELECT result_id FROM x))),
s AS (SELECT result_id*2 + k AS step_id FROM x CROSS JOIN (VALUES (0),(1)) AS v(k)), e AS (SELECT export_id FROM fx_exports WHERE CASE kind WHEN 0 THEN run_id IN (SELECT run_id FROM r) WHEN 1 THEN certificate_id IN (SELECT certificate_id FROM c) ELSE heat_id IN (SELECT heat_id FROM h) END),
j AS (SELECT job_id, status FROM fx_document_jobs WHERE document_id IN (SELECT document_id FROM d) OR export_id IN (SELECT export_id FROM e))
SELECT 'certificates' AS table_name, certificate_id AS id FROM c UNION ALL SELECT 'documents', document_id FROM d UNION ALL SELECT 'heats', heat_id FROM h UNION ALL SELECT 'products', product_id FROM fx_products WHERE certificate_id IN (SELECT certificate_id FROM c)
UNION ALL SELECT 'observations', observation_id FROM o UNION ALL SELECT 'compositions', heat_id FROM h UNION ALL SELECT 'extraction_runs', job_id FROM fx_document_jobs WHERE document_id IN (SELECT document_id FROM d) UNION ALL SELECT 'runs', run_id FROM r UNION ALL SELECT 'results', result_id FROM x
UNION ALL SELECT 'candidates', candidate_id FROM fx_candidates WHERE result_id IN (SELECT result_id FROM x) UNION ALL SELECT 'factors', factor_id FROM f UNION ALL SELECT 'steps', step_id FROM s
UNION ALL SELECT DISTINCT 'links', link_id FROM fx_links WHERE factor_id IN (SELECT factor_id FROM f) OR observation_id IN (SELECT observation_id FROM o) UNION ALL SELECT 'links', -step_id FROM s
UNION ALL SELECT 'selections', selection_id FROM fx_choices WHERE result_id IN (SELECT result_id FROM x) UNION ALL SELECT 'approvals', event_id FROM fx_approval_events WHERE run_id IN (SELECT run_id FROM r) UNION ALL SELECT 'corrections', observation_id FROM o WHERE observation_id%5=0
UNION ALL SELECT 'exports', export_id FROM e UNION ALL SELECT 'jobs', job_id FROM j UNION ALL SELECT 'in_use', job_id FROM j WHERE status = 'running'
UNION ALL SELECT 'files', stored_file_id FROM (SELECT document_id%40 AS stored_file_id, document_id IN (SELECT document_id FROM d) AS gone FROM (SELECT DISTINCT document_id FROM fx_certificates) UNION ALL SELECT stored_file_id, export_id IN (SELECT export_id FROM e) FROM fx_exports WHERE stored_file_id IS NOT NULL) GROUP BY 2 HAVING bool_and(gone)""")
def deletion_closure(t: Tables) -> DataFrame:
    """Every row of every table that goes with some certificates, followed along the references between the tables."""
    # The chain of results and its links are reached from several references.
    t.write_once("products").write_once("results").write_once("links")
    ids = t.certificates.filter("stored_file_id in (3, 4) or certificate_id%40 = 7").select("certificate_id")
    steps = t.results.select("result_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).selectExpr("result_id*2 + k as step_id", "result_id")
    links = t.links.selectExpr("link_id", "factor_id", "cast(null as bigint) as step_id", "observation_id").unionByName(steps.selectExpr("-step_id as link_id", "cast(null as bigint) as factor_id", "step_id", "cast(null as bigint) as observation_id"))
    exports = t.exports
    tables = {"documents": t.certificates.selectExpr("document_id", "document_id%40 as stored_file_id").distinct(), "heats": t.heats, "products": t.products, "observations": t.observations.select("observation_id", "product_id"),
              "compositions": t.heats.selectExpr("heat_id as composition_id", "heat_id"), "extraction_runs": t.document_jobs.selectExpr("job_id as extraction_run_id", "document_id"), "runs": t.runs, "results": t.results, "candidates": t.candidates,
              "factors": t.factors, "steps": steps, "links": links, "selections": t.choices, "approvals": t.approval_events, "corrections": t.observations.filter("observation_id%5 = 0").selectExpr("observation_id as correction_id", "observation_id"),
              "export_scopes": exports.selectExpr("export_id", "if(kind = 1, certificate_id, null) as certificate_id", "if(kind = 2, heat_id, null) as heat_id"),
              "exports": exports.selectExpr("export_id", "if(kind = 0, run_id, null) as run_id", "stored_file_id"), "jobs": t.document_jobs}
    return h.deletion_closure(t.certificates, ids, tables)
