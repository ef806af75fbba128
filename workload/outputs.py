"""Catalogue, reports, sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millspark.functions import refdata as ref
from millspark.operators import catalog as ct
from millspark.operators import classification as cl
from millspark.operators import history as h
from millspark.operators import replay as rpl
from millspark.operators import report as rp
from millspark.session import shared_folder, staged
from millspark.sources import readers
from millspark.streaming import jobs
from workload.classification import facts
from workload.registry import ORACLE_VIEWS, Tables, query

ORACLE_VIEWS["ox_tariff"] = r"""
WITH c AS (SELECT position, coalesce(trim(code),'') AS code, coalesce(trim(marker),'') AS marker, trim(description) AS description FROM fx_tariff_rows WHERE code <> 'CÓDIGO' AND description <> ''),
k AS (SELECT *, CASE WHEN regexp_full_match(code, '72\.\d{2}') THEN 'heading' WHEN regexp_full_match(code, '\d{4}\.\d{2}') THEN 'subheading' WHEN regexp_full_match(code, '\d{4}\.\d{2}\.\d{2}') THEN 'fraction' END AS kind FROM c),
g AS (SELECT *, max(CASE WHEN kind='heading' THEN position END) OVER w AS ph, max(CASE WHEN kind IN ('heading','subheading') THEN position END) OVER w AS ps, max(CASE WHEN kind IS NOT NULL THEN position END) OVER w AS pf FROM k WINDOW w AS (ORDER BY position)),
x AS (SELECT g.position, g.code, g.marker, g.description, g.kind, coalesce(a.code,'') AS heading, CASE WHEN b.kind='subheading' THEN b.code ELSE '' END AS sub, CASE WHEN f.kind='fraction' THEN f.code ELSE '' END AS fraction FROM g LEFT JOIN k a ON a.position = g.ph LEFT JOIN k b ON b.position = g.ps LEFT JOIN k f ON f.position = g.pf)
SELECT position, kind, code, CASE WHEN kind='fraction' THEN code END AS fraction, CAST(NULL AS VARCHAR) AS nico, CASE kind WHEN 'heading' THEN '72' WHEN 'subheading' THEN left(code,2) || '.' || substr(code,3,2) ELSE left(code,7) END AS parent, sub AS table_subheading FROM x WHERE kind IS NOT NULL
UNION ALL SELECT position, 'nico', fraction || '-' || marker, fraction, marker, fraction, sub FROM x WHERE regexp_full_match(marker, '\d{2}') AND ((kind='fraction') OR (code='' AND fraction <> ''))
UNION ALL SELECT position, CASE WHEN marker IN ('-','--','---') THEN 'qualifier' ELSE 'section' END, '', NULL, NULL, CASE WHEN fraction <> '' THEN fraction WHEN sub <> '' THEN sub WHEN heading <> '' THEN heading ELSE '72' END, sub FROM x WHERE kind IS NULL AND NOT (code='' AND regexp_full_match(marker, '\d{2}') AND fraction <> '') AND description <> 'CUOTA (ARANCEL)'
"""
ORACLE_VIEWS["ox_coverage"] = f"""
WITH c AS (SELECT kind, regexp_replace(code, '[.-]', '', 'g') AS code FROM ox_tariff WHERE kind IN ('heading','fraction','nico') UNION ALL SELECT kind, code FROM ox_catalog)
SELECT kind, code, left(code,4) AS heading, CASE WHEN left(code,4) NOT IN ('7208','7209','7210','7211','7212','7219','7220','7225','7226') THEN 'out_of_scope' WHEN code = '72193502' THEN 'ambiguous_source'
 WHEN code IN ('7210120401','7210120402','7209150403','7225509110') OR left(code,8) IN ('72251101','72251999','72261101','72261999','72126004') THEN 'blocked_by_missing_fact' WHEN kind='heading' OR left(code,8) IN ({', '.join(repr(f) for f in ref.EXECUTABLE_FRACTIONS)}) THEN 'implemented' ELSE 'not_implemented' END AS status FROM c
"""


def coverage_entries(t: Tables) -> DataFrame:
    built = ct.build_catalog(t.tariff_rows).select("kind", "code")
    return ct.coverage(built.unionByName(ref.catalog(t.spark).select("kind", "code")))


@query(sql="SELECT fraction || '-' || nico AS raw, fraction || nico AS code, count(*) AS entries FROM fx_catalog WHERE nico <> '03' GROUP BY 1,2")
def catalog_entries(t: Tables) -> DataFrame:
    rows = t.catalog.selectExpr("concat(fraction, '-', nico) as raw", "if(nico = '03', null, concat(fraction, '-', nico)) as code")
    return ct.read_catalog(rows).groupBy("raw", "code").agg(F.count("*").alias("entries"))


@query(sql="SELECT position, kind, code, fraction, nico, parent, table_subheading FROM ox_tariff")
def built_catalog(t: Tables) -> DataFrame:
    return ct.build_catalog(t.tariff_rows).select("position", "kind", "code", "fraction", "nico", "parent", "table_subheading")


@query(sql="""SELECT 'duplicate_fraction' AS check, code FROM ox_tariff WHERE kind='fraction' GROUP BY code HAVING count(*) > 1 UNION ALL SELECT 'duplicate_nico', code FROM ox_tariff WHERE kind='nico' GROUP BY code HAVING count(*) > 1
UNION ALL SELECT 'hierarchy_mismatch', code FROM ox_tariff WHERE kind='fraction' AND table_subheading <> '' AND parent <> table_subheading""")
def catalog_checks(t: Tables) -> DataFrame:
    return ct.catalog_qa(staged(ct.build_catalog(t.tariff_rows)))


@query(sql="SELECT kind, code, heading, status, count(*) AS entries FROM ox_coverage GROUP BY 1,2,3,4")
def coverage_status(t: Tables) -> DataFrame:
    return coverage_entries(t).groupBy("kind", "code", "heading", "status").agg(F.count("*").alias("entries"))


@query(sql="""SELECT 'kind' AS dimension, kind AS name, count(*) AS entries FROM ox_coverage GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM ox_coverage GROUP BY 2 UNION ALL SELECT 'flat_status', status, count(*) FROM ox_coverage WHERE status <> 'out_of_scope' GROUP BY 2""")
def coverage_summary(t: Tables) -> DataFrame:
    return ct.coverage_summary(coverage_entries(t))


@query(sql="SELECT fraction, count(*) AS entries FROM fx_catalog GROUP BY 1")
def pinned_catalog(t: Tables) -> DataFrame:
    """A catalogue whose hash is checked against the one recorded for it."""
    entries = t.catalog.selectExpr("'nico' as kind", "code", "fraction", "nico")
    recorded = ct.catalog_hash(entries).first()["sha256"]
    return ct.assert_catalog_hash(entries, recorded).groupBy("fraction").agg(F.count("*").alias("entries"))


@query(sql="SELECT user_id AS rule_set_id, status FROM (SELECT user_id, CASE event_type WHEN 'click' THEN 'draft' WHEN 'view' THEN 'approved' ELSE 'retired' END AS status FROM events) WHERE status <> 'retired' ORDER BY CASE WHEN status='approved' THEN 0 ELSE 1 END, user_id DESC LIMIT 1")
def chosen_rule_set(t: Tables) -> DataFrame:
    return ct.choose_rule_set(t.rule_log).select("rule_set_id", "status")


@query(sql="""SELECT rule_set_id, log_id FROM (SELECT *, lag(status) OVER w AS ps, lag(version) OVER w AS pv, lag(manifest) OVER w AS pm FROM fx_rule_log WINDOW w AS (PARTITION BY rule_set_id ORDER BY log_id)) WHERE ps IN ('approved','retired') AND (pv <> version OR pm <> manifest)""")
def immutability_audit(t: Tables) -> DataFrame:
    return ct.immutability_audit(t.rule_log)


def recorded_runs(t: Tables, catalog: DataFrame) -> DataFrame:
    """Runs of every certificate, kept as they were decided under ``catalog``."""
    return staged(rpl.record_runs(facts(t), catalog))


@query(sql="""SELECT o.product_id, o.certificate_id, CASE WHEN o.certificate_id%5=0 THEN 'historical_engine_unavailable' WHEN o.certificate_id%11=0 AND (SELECT count(*) FROM fx_products p WHERE p.certificate_id = o.certificate_id AND p.product_id%2=1) > 0 THEN 'historical_snapshot_mismatch'
  WHEN o.product_id%13=0 AND o.certificate_id%11<>0 THEN 'historical_snapshot_mismatch' END AS replay_error, false AS changed, o.outcome AS now_outcome, o.fraction AS now_fraction, o.nico AS now_nico FROM (
 SELECT product_id, certificate_id, outcome, CASE WHEN state='branch' THEN fraction END AS fraction, nico FROM ox_outcome WHERE NOT alternative UNION ALL SELECT DISTINCT product_id, certificate_id, 'needs_review', NULL, NULL FROM ox_outcome WHERE alternative) o
WHERE o.certificate_id%11<>0 OR o.product_id%2=0""")
def replayed_snapshots(t: Tables) -> DataFrame:
    """Replay of all runs: some of another engine, some with a lost roll, some with a snapshot that was touched."""
    catalog = ref.catalog(t.spark)
    runs = recorded_runs(t, catalog).filter("certificate_id%11 <> 0 or product_id%2 = 0").withColumns({
        "engine_sha256": F.when(F.expr("certificate_id%5 = 0"), F.sha2("engine_sha256", 256)).otherwise(F.col("engine_sha256")),
        "facts_sha256": F.when(F.expr("product_id%13 = 0 and certificate_id%11 <> 0"), F.sha2("facts_sha256", 256)).otherwise(F.col("facts_sha256"))})
    return rpl.replay_runs(runs, t.products, catalog).select("product_id", "certificate_id", "replay_error", "changed", "now_outcome", "now_fraction", "now_nico")


@query(sql="""SELECT product_id, 'rule_catalog_mismatch' AS replay_error, 'needs_review' AS then_outcome, fraction AS then_fraction, CAST(NULL AS VARCHAR) AS then_nico, outcome AS now_outcome, fraction AS now_fraction, nico AS now_nico,
 array_to_string(list_sort(list_distinct(list_filter(list_append(string_split(missing, ','), 'source_catalog_resolution'), lambda x: x <> ''))), ',') AS then_missing, missing AS now_missing
FROM ox_outcome WHERE NOT alternative AND state='branch' AND fraction='72091601' AND nico='01'
UNION ALL SELECT product_id, 'rule_catalog_mismatch', 'needs_review', NULL, NULL, 'needs_review', NULL, NULL, array_to_string(list_sort(list_distinct(list_append(m, 'source_catalog_resolution'))), ','), array_to_string(list_sort(list_distinct(m)), ',')
 FROM (SELECT product_id, list_filter(string_split('rolling,' || string_agg(missing, ','), ','), lambda x: x <> '') AS m FROM ox_outcome WHERE alternative GROUP BY 1 HAVING bool_or(state='branch' AND fraction='72091601' AND nico='01'))""")
def results_changed_by_catalog(t: Tables) -> DataFrame:
    """Runs decided before the catalogue had NICO 01 of fraction 72091601, against what the present catalogue decides."""
    catalog = ref.catalog(t.spark)
    before = recorded_runs(t, catalog.filter("not (kind = 'nico' and fraction = '72091601' and right(code, 2) = '01')"))
    changed = rpl.replay_runs(before, t.products, catalog).filter("changed").drop("changed", "certificate_id")
    return changed.withColumns({c: F.array_join(c, ",") for c in ("then_missing", "now_missing")})


# ---- reports ----

def corrections(t: Tables) -> DataFrame:
    return t.observations.filter("supersedes_id is not null").selectExpr("observation_id as correction_id", "observed_at as created_at", "is_current as replacement_is_current", "product_id")


def timed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("created_at", F.expr(f"timestamp_seconds({key})"))


def scope(t: Tables) -> dict[str, DataFrame]:
    observations = t.observations
    return {"certificates": t.certificates, "heats": t.heats, "products": t.products, "runs": t.runs, "results": t.results, "candidates": t.candidates, "factors": t.factors,
            "selections": timed(t.choices, "selection_id"), "approvals": timed(t.approval_events, "event_id"), "corrections": corrections(t), "observations": observations, "links": t.links,
            "compositions": t.scoped_compositions.withColumn("heat_id", F.expr("if(product_id is null, heat_id, null)")), "manufacturers": t.manufacturers}


ORACLE_VIEWS["ox_scope_results"] = "SELECT r.* FROM fx_results r JOIN (SELECT certificate_id, max(run_id) AS run_id FROM fx_runs GROUP BY 1) l ON l.run_id = r.run_id"


@query(sql="""SELECT c.certificate_id, c.certificate_no, m.name AS fabricante, c.approval_status FROM fx_certificates c LEFT JOIN fx_manufacturers m ON m.manufacturer_id = c.manufacturer_id""")
def report_certificates(t: Tables) -> DataFrame:
    return rp.report_tables(scope(t))["Actas"].select("certificate_id", "certificate_no", "fabricante", "approval_status")


@query(sql="SELECT heat_id, heat_no, standard FROM fx_heats")
def report_heats(t: Tables) -> DataFrame:
    return rp.report_tables(scope(t))["Batches"].select("heat_id", "heat_no", "standard")


@query(sql="SELECT product_id, heat_id, product_identifier, weight_kg FROM fx_products")
def report_rolls(t: Tables) -> DataFrame:
    return rp.report_tables(scope(t))["Coladas"].select("product_id", "heat_id", "product_identifier", "weight_kg")


@query(sql="""SELECT CASE WHEN c.product_id IS NULL THEN c.heat_id END AS heat_id, c.product_id, c.element, c.percentage, h.heat_no AS colada, p.product_identifier AS serie_rollo
FROM fx_scoped_compositions c JOIN fx_heats h ON h.heat_id = c.heat_id LEFT JOIN fx_products p ON p.product_id = c.product_id""")
def report_compositions(t: Tables) -> DataFrame:
    return rp.report_tables(scope(t))["Composición"].select("heat_id", "product_id", "element", "percentage", "colada", "serie_rollo")


@query(sql="""SELECT o.observation_id, o.field_path, coalesce(r.rules, '') AS regla_factor FROM fx_observations o LEFT JOIN (SELECT observation_id, string_agg(DISTINCT rule_code, '; ' ORDER BY rule_code) AS rules FROM fx_links l JOIN fx_factors f ON f.factor_id = l.factor_id GROUP BY 1) r ON r.observation_id = o.observation_id
WHERE o.product_id IN (SELECT product_id FROM fx_products)""")
def report_evidence(t: Tables) -> DataFrame:
    return rp.report_tables(scope(t))["Evidencia"].select("observation_id", "field_path", "regla_factor")


@query(sql="""WITH r AS (SELECT r.*, u.approval_status FROM ox_scope_results r JOIN fx_runs u ON u.run_id = r.run_id), s AS (SELECT c.result_id, c.candidate_id, p.person_name FROM ox_chosen c JOIN (SELECT result_id, arg_max(person_name, selection_id) AS person_name FROM fx_choices GROUP BY 1) p ON p.result_id = c.result_id),
a AS (SELECT r.*, s.candidate_id AS chosen_id, s.person_name, coalesce(s.candidate_id, f.candidate_id) AS active_id FROM r LEFT JOIN s ON s.result_id = r.result_id LEFT JOIN fx_candidates f ON f.result_id = r.result_id AND f.rank = 1),
o AS (SELECT c.result_id, list(c.fraction || '-' || c.nico ORDER BY c.rank) AS alt FROM fx_candidates c JOIN a ON a.result_id = c.result_id AND c.candidate_id IS DISTINCT FROM a.active_id GROUP BY 1), k AS (SELECT candidate_id, string_agg(rule_code || ': ' || outcome, '; ' ORDER BY sequence) AS f FROM fx_factors WHERE sequence <= 4 GROUP BY 1)
SELECT a.result_id, a.product_id, CASE WHEN chosen_id IS NOT NULL THEN c.fraction || '-' || c.nico WHEN a.outcome='classified' THEN a.fraction || '-' || a.nico ELSE 'Pendiente de selección' END AS candidato_elegido, coalesce(o.alt[1], '—') AS alternativa_2, coalesce(o.alt[2], '—') AS alternativa_3,
 CASE WHEN chosen_id IS NOT NULL THEN person_name WHEN a.outcome='classified' THEN 'Motor determinista' ELSE '—' END AS seleccionado_por, coalesce(k.f, 'Reglas de partida y subpartida') AS factores_clave, a.outcome AS resultado, a.approval_status AS estado_ejecucion,
 CASE WHEN a.product_id IN (SELECT product_id FROM fx_observations) THEN 'Ver evidencia' ELSE 'Sin evidencia' END AS evidencia FROM a LEFT JOIN fx_candidates c ON c.candidate_id = chosen_id LEFT JOIN o ON o.result_id = a.result_id LEFT JOIN k ON k.candidate_id = a.active_id
UNION ALL SELECT NULL, product_id, 'Sin clasificación', NULL, NULL, NULL, NULL, NULL, 'Pendiente de clasificación', CASE WHEN product_id IN (SELECT product_id FROM fx_observations) THEN 'Ver evidencia' ELSE 'Sin evidencia' END FROM fx_products p WHERE NOT EXISTS (SELECT 1 FROM ox_scope_results r WHERE r.product_id = p.product_id)""")
def report_classification(t: Tables) -> DataFrame:
    return rp.report_tables(scope(t))["Clasificación"].select(
        "result_id", "product_id", "candidato_elegido", "alternativa_2", "alternativa_3", "seleccionado_por", "factores_clave", "resultado", "estado_ejecucion", "evidencia")


@query(sql="""WITH r AS (SELECT r.*, u.approval_status, u.run_id%4 AS rule_set_id FROM ox_scope_results r JOIN fx_runs u ON u.run_id = r.run_id), s AS (SELECT c.result_id, c.candidate_id, p.reason, p.created_at FROM ox_chosen c JOIN (SELECT result_id, max(selection_id) AS selection_id FROM fx_choices GROUP BY 1) m ON m.result_id = c.result_id
  JOIN (SELECT selection_id, 'motivo ' || selection_id%3 AS reason, make_timestamp(selection_id*1000000) AS created_at FROM fx_choices) p ON p.selection_id = m.selection_id),
o AS (SELECT c.result_id, string_agg(c.fraction || '-' || c.nico || ': ' || CASE WHEN c.fraction = '72091601' THEN 'wide' ELSE 'other' END, '; ' ORDER BY c.rank, c.candidate_id) AS everything FROM fx_candidates c GROUP BY 1)
SELECT r.result_id, r.product_id, p.product_identifier AS rollo_identificador, CASE WHEN s.result_id IS NOT NULL THEN s.reason WHEN r.outcome='classified' THEN CASE WHEN r.approval_status='approved' THEN 'Resolución unívoca aprobada' ELSE 'Resolución unívoca pendiente de aprobación' END ELSE 'Pendiente de revisión documental' END AS motivo_seleccion,
 CASE WHEN s.result_id IS NOT NULL THEN strftime(s.created_at, '%Y-%m-%d %H:%M:%S') ELSE '—' END AS fecha_seleccion, CASE WHEN r.outcome='classified' THEN 'Ninguno' ELSE 'coated, rolling' END AS faltantes, 'v' || r.rule_set_id AS reglas_version, coalesce(c.fraction, r.fraction) AS fraccion, CASE WHEN c.candidate_id IS NOT NULL THEN c.nico ELSE r.nico END AS nico,
 CASE r.approval_status WHEN 'approved' THEN 'Aprobado' WHEN 'rejected' THEN 'Rechazado' ELSE 'Pendiente de aprobación' END AS aprobacion, CASE WHEN r.fraction = '72091601' THEN 'wide' ELSE 'other' END AS descripcion, o.everything AS todos_los_candidatos
FROM r JOIN fx_products p ON p.product_id = r.product_id LEFT JOIN s ON s.result_id = r.result_id LEFT JOIN fx_candidates c ON c.candidate_id = s.candidate_id LEFT JOIN o ON o.result_id = r.result_id
UNION ALL SELECT NULL, product_id, product_identifier, NULL, NULL, NULL, NULL, NULL, NULL, 'Pendiente de clasificación', NULL, NULL FROM fx_products p WHERE NOT EXISTS (SELECT 1 FROM ox_scope_results r WHERE r.product_id = p.product_id)""")
def report_classification_details(t: Tables) -> DataFrame:
    """The other columns of the classification sheet: reason and time of the choice, missing facts, rules, codes, all candidates."""
    wide = F.expr("if(fraction = '72091601', 'wide', 'other')")
    tables = scope(t)
    tables["results"] = t.results.withColumns({"description": wide, "missing_fields": F.expr("if(outcome = 'classified', array(), array('coated', 'rolling'))")})
    tables["candidates"] = t.candidates.withColumn("description", wide)
    tables["selections"] = tables["selections"].withColumn("reason", F.expr("concat('motivo ', selection_id%3)"))
    tables["runs"] = t.runs.withColumn("rule_set_id", F.expr("run_id%4"))
    tables["rule_sets"] = t.spark.range(4).selectExpr("id as rule_set_id", "concat('v', id) as version")
    return rp.report_tables(tables)["Clasificación"].select("result_id", "product_id", "rollo_identificador", "motivo_seleccion", "fecha_seleccion", "faltantes", "reglas_version", "fraccion", "nico", "aprobacion", "descripcion", "todos_los_candidatos")


@query(sql="""WITH o AS (SELECT observation_id, supersedes_id, product_id, is_current FROM fx_observations WHERE supersedes_id IS NOT NULL AND product_id IN (SELECT product_id FROM fx_products))
SELECT tipo_evento, id_evento, certificate_id, run_id, product_id, detalle, persona, motivo FROM (
 SELECT 'SELECCION_CANDIDATO' AS tipo_evento, s.selection_id AS id_evento, u.certificate_id, r.run_id, r.product_id, 'Seleccionó ' || c.fraction || '-' || c.nico || CASE WHEN s.supersedes_selection_id IS NOT NULL THEN ' (Reemplaza selección #' || s.supersedes_selection_id || ')' ELSE '' END AS detalle, s.person_name AS persona, 'motivo ' || s.selection_id%3 AS motivo
  FROM fx_choices s JOIN ox_scope_results r ON r.result_id = s.result_id JOIN fx_runs u ON u.run_id = r.run_id JOIN fx_candidates c ON c.candidate_id = s.candidate_id
 UNION ALL SELECT 'APROBACION_ESTADO', e.event_id, u.certificate_id, u.run_id, NULL, 'Cambio de estado: draft -> ' || e.to_status, 'person' || e.event_id%3, NULL FROM fx_approval_events e JOIN fx_runs u ON u.run_id = e.run_id
 UNION ALL SELECT 'CORRECCION_DATO', observation_id, CAST(floor(product_id/10) AS BIGINT), NULL, NULL, 'Corrección obs ' || supersedes_id || ' -> ' || observation_id, NULL, NULL FROM o)""")
def report_audit(t: Tables) -> DataFrame:
    """The audit sheet with what happened, by whom and why, and the certificate, run and roll it concerns."""
    tables = scope(t)
    tables["selections"] = tables["selections"].withColumn("reason", F.expr("concat('motivo ', selection_id%3)"))
    tables["approvals"] = tables["approvals"].withColumns({"from_status": F.lit("draft"), "person_name": F.expr("concat('person', event_id%3)")})
    tables["corrections"] = t.observations.filter("supersedes_id is not null").selectExpr("observation_id as correction_id", "observed_at as created_at", "is_current as replacement_is_current", "product_id", "cast(floor(product_id/10) as bigint) as certificate_id",
                                                                                          "supersedes_id as previous_observation_id", "observation_id as replacement_observation_id")
    return rp.report_tables(tables)["Auditoría"].select("tipo_evento", "id_evento", "certificate_id", "run_id", "product_id", "detalle", "persona", "motivo")


@query(sql="""SELECT 'Aviso Legal' AS concept, 'DEMOSTRACIÓN — SIN VALIDEZ ADUANERA' AS detail UNION ALL SELECT 'Tipo de Reporte', 'Oficial (sólo expedientes aprobados)' UNION ALL SELECT 'Ejecución de clasificación', CAST(max(run_id) AS VARCHAR) FROM fx_runs GROUP BY certificate_id
UNION ALL SELECT 'Actas aprobadas', CAST(count(*) AS VARCHAR) FROM fx_certificates WHERE approval_status='approved' UNION ALL SELECT 'Clasificaciones incluidas', CAST(count(*) AS VARCHAR) FROM ox_scope_results""")
def report_heading(t: Tables) -> DataFrame:
    """Lines of the summary sheet that name the notice, the kind of report and every run."""
    wanted = ("Aviso Legal", "Tipo de Reporte", "Ejecución de clasificación", "Actas aprobadas", "Clasificaciones incluidas")
    return rp.report_tables(scope(t), official=True)["Resumen"].filter(F.col("concept").isin(*wanted))


@query(sql="""SELECT 'SELECCION_CANDIDATO' AS tipo_evento, selection_id AS id_evento, CASE WHEN c.selection_id IN (SELECT max(selection_id) FROM fx_choices WHERE NOT selection_cleared GROUP BY result_id) THEN 'Vigente' WHEN selection_cleared THEN 'Retirada' ELSE 'Reemplazada' END AS vigencia FROM fx_choices c
UNION ALL SELECT 'APROBACION_ESTADO', event_id, CASE WHEN event_id = max(event_id) OVER (PARTITION BY run_id) THEN 'Vigente' ELSE 'Reemplazada' END FROM fx_approval_events UNION ALL SELECT 'CORRECCION_DATO', observation_id, CASE WHEN is_current THEN 'Vigente' ELSE 'Reemplazada' END FROM fx_observations WHERE supersedes_id IS NOT NULL""")
def audit_timeline(t: Tables) -> DataFrame:
    s = scope(t)
    return rp.audit_timeline(s["selections"], s["approvals"], s["corrections"]).orderBy("created_at", "id_evento").select("tipo_evento", "id_evento", "vigencia")


@query(sql="""WITH w AS (SELECT certificate_id FROM fx_certificates WHERE certificate_id%4=0 UNION SELECT -certificate_id FROM fx_certificates WHERE certificate_id%400=0), l AS (SELECT certificate_id, arg_max(approval_status, run_id) AS s FROM fx_runs GROUP BY 1)
SELECT certificate_id, 'unknown_certificate' AS reason FROM w WHERE certificate_id < 0 UNION ALL SELECT w.certificate_id, 'certificate_not_approved' FROM w JOIN fx_certificates c ON c.certificate_id = w.certificate_id WHERE c.approval_status <> 'approved'
UNION ALL SELECT w.certificate_id, 'run_not_approved' FROM w JOIN l ON l.certificate_id = w.certificate_id WHERE s <> 'approved'""")
def report_gate(t: Tables) -> DataFrame:
    wanted = t.certificates.filter("certificate_id%4 = 0").select("certificate_id").union(t.certificates.filter("certificate_id%400 = 0").selectExpr("-certificate_id"))
    return rp.check_report_scope(t.certificates, t.runs, wanted, official=True)


@query(sql="""WITH a AS (SELECT r.* FROM fx_runs r WHERE run_id%3<>1), s AS (SELECT certificate_id, count(*) FILTER (WHERE approval_status IS DISTINCT FROM 'approved') AS n FROM a GROUP BY 1)
SELECT certificate_id, 'certificate_not_approved' AS reason FROM fx_certificates WHERE approval_status <> 'approved' UNION ALL SELECT certificate_id, 'run_missing' FROM fx_certificates WHERE certificate_id NOT IN (SELECT certificate_id FROM a)
UNION ALL SELECT certificate_id, 'run_not_approved' FROM s WHERE n > 0""")
def report_gate_for_runs(t: Tables) -> DataFrame:
    """The gate of an official report that names its runs."""
    return rp.check_report_scope(t.certificates, t.runs, t.certificates.select("certificate_id"), official=True, wanted_runs=t.runs.filter("run_id%3 <> 1").select("run_id"))


@query(sql="""SELECT 'heat' AS kind, heat_id AS id FROM fx_heats WHERE certificate_id%4<>0 UNION ALL SELECT DISTINCT 'run', -run_id FROM fx_runs WHERE run_id > 0 UNION ALL SELECT 'run', run_id FROM fx_runs WHERE certificate_id%4<>0""")
def report_items_outside(t: Tables) -> DataFrame:
    """Requested heats and runs that lie outside a report over a quarter of the certificates."""
    wanted = t.certificates.filter("certificate_id%4 = 0").select("certificate_id")
    asked = t.runs.select("run_id").union(t.runs.selectExpr("-run_id"))
    return rp.check_requested_items(wanted, t.heats, t.runs, t.heats.select("heat_id"), asked)


@query(sql="""SELECT r.result_id, r.run_id, r.product_id FROM fx_results r JOIN fx_products p ON p.product_id = r.product_id WHERE p.heat_id%3<>0 AND r.run_id%3<>1
UNION ALL SELECT NULL, NULL, product_id FROM fx_products WHERE heat_id%3<>0 AND product_id NOT IN (SELECT product_id FROM fx_results WHERE run_id%3<>1)""")
def report_of_heats_and_runs(t: Tables) -> DataFrame:
    """The classification sheet over all certificates, restricted to some heats and to named runs."""
    tables = scope(t) | {"certificates": t.certificates, "wanted_heats": t.heats.filter("heat_id%3 <> 0"), "wanted_runs": t.runs.filter("run_id%3 <> 1")}
    return rp.report_tables(tables)["Clasificación"].select("result_id", "run_id", "product_id")


@query(sql="SELECT 'Batches' AS table_name, count(*) AS written, count(*) AS read FROM fx_heats UNION ALL SELECT 'Coladas', count(*), count(*) FROM fx_products")
def written_report(t: Tables) -> DataFrame:
    return rp.write_report({"Batches": t.heats, "Coladas": t.products}, f"{shared_folder(t.spark)}/report", {"Coladas": "form"})


# ---- sources: payloads that Spark writes from the tables and reads back ----

@query(sql="SELECT CAST(certificate_id AS VARCHAR) AS source_name, row_pos, CAST(product_id AS VARCHAR) AS product_id, CAST(heat_id AS VARCHAR) AS heat_no, width_raw AS width_mm, c_raw AS carbon, c_header AS carbon_scale FROM fx_raw_rows")
def raw_certificate_rows(t: Tables) -> DataFrame:
    row = F.struct(F.col("product_id").cast("string").alias("product_id"), F.col("heat_id").cast("string").alias("heat_no"), F.col("width_raw").alias("width_mm"), F.create_map(F.lit("C"), "c_raw").alias("chemistry"))
    # The fixture's rows of one certificate are few; a payload is one JSON document by definition.
    docs = t.raw_rows.groupBy("certificate_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_pos", row.alias("row"))), lambda a, b: (a["row_pos"] - b["row_pos"]).cast("int")), lambda x: x["row"]).alias("rows"), F.min_by("c_header", "row_pos").alias("_h"))
    path = f"{shared_folder(t.spark)}/raw"
    docs.select(F.struct(F.col("certificate_id").cast("string").alias("source_name")).alias("document"), F.create_map(F.lit("C"), "_h").alias("chemistry_scales"), "rows").write.json(path)
    _, rows = readers.read_raw_certificates(t.spark, path, multiline=False)
    scales = t.raw_rows.select(F.col("product_id").cast("string").alias("product_id"), F.col("c_header").alias("carbon_scale"))
    return rows.select("source_name", "row_pos", "product_id", "heat_no", "width_mm", F.col("chemistry")["C"].alias("carbon")).join(scales, "product_id")


@query(sql="SELECT CAST(doc_id AS VARCHAR) AS file_name, text, x0, top, x1, bottom FROM fx_blocks")
def layout_blocks(t: Tables) -> DataFrame:
    block = F.struct(F.lit(1).alias("page_number"), "text", F.struct("x0", "top", "x1", "bottom").alias("bbox"))
    path = f"{shared_folder(t.spark)}/layout"
    pages = t.blocks.groupBy("doc_id").agg(F.collect_list(block).alias("blocks"))
    pages.select(F.col("doc_id").cast("string").alias("file_name"), F.array(F.struct(F.lit(1).alias("page_number"), F.col("blocks"))).alias("pages")).write.json(path)
    return readers.read_layouts(t.spark, path, multiline=False)[0].select("file_name", "text", "x0", "top", "x1", "bottom")


@query(sql="SELECT 'parts' AS sheet, CAST(p_partkey AS INT) AS row, CASE WHEN p_partkey%9<>0 THEN p_name END AS value, CASE WHEN p_partkey%9=0 THEN '=' || p_name END AS formula FROM part")
def sheet_cells(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/cells"
    t.part.selectExpr("'parts' as sheet", "cast(p_partkey as int) as row", "1 as col", "if(p_partkey%9 = 0, concat('=', p_name), p_name) as value", "p_partkey%9 = 0 as is_formula").write.parquet(path)
    return readers.read_sheet_cells(t.spark, path).select("sheet", "row", "value", "formula")


@query()
def file_inventory(t: Tables) -> DataFrame:
    """Inventory of the folder's own table files (their type is not accepted, their hashes are)."""
    return readers.file_inventory(t.spark, t.sf_dir).select(F.element_at(F.split("path", "/"), -1).alias("file"), "size_bytes", "sha256", "status", "duplicate")


@query(sql="SELECT event_id AS rule_set_id, event_type AS name, CASE WHEN event_id%2=0 THEN 'approved' ELSE 'draft' END AS status, 'sha' || user_id AS catalog_sha256 FROM events")
def rule_sets(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/rules"
    t.events.select(F.col("event_id").alias("rule_set_id"), F.col("event_type").alias("name"), F.expr("if(event_id%2 = 0, 'approved', 'draft')").alias("status"),
                    F.struct(F.concat(F.lit("sha"), F.col("user_id").cast("string")).alias("catalog_sha256")).alias("manifest")).write.json(path)
    return readers.read_rule_sets(t.spark, path).select("rule_set_id", "name", "status", "manifest.catalog_sha256")


# ---- streams over the events table, run to the end of what is available ----

def events_stream(t: Tables) -> DataFrame:
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def finish(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


@query(sql="SELECT sha256, count(*) AS kept FROM (SELECT DISTINCT sha256 FROM fx_uploads) GROUP BY 1")
def upload_stream(t: Tables) -> DataFrame:
    path = shared_folder(t.spark)
    uploads = events_stream(t).selectExpr("event_id as document_id", "ts as uploaded_at", "concat('h', cast(user_id*7 + event_id%5 as string)) as sha256")
    finish(jobs.dedupe_uploads(uploads, path))
    return jobs.written(t.spark, path).groupBy("sha256").agg(F.count("*").alias("kept"))


@query(sql="SELECT sha256, arg_min(document_id, (uploaded_at, document_id)) AS document_id FROM fx_uploads GROUP BY 1")
def first_uploads(t: Tables) -> DataFrame:
    return jobs.first_uploads(t.uploads)


@query(sql="""SELECT product_id, field_path, observation_id, normalized_value FROM fx_observations WHERE is_current""")
def current_value_stream(t: Tables) -> DataFrame:
    path = shared_folder(t.spark)
    stream = events_stream(t).selectExpr("event_id as observation_id", "user_id*10 + 1 + event_id%3 as product_id", "CASE event_type WHEN 'click' THEN 'thickness_mm' WHEN 'view' THEN 'width_mm' WHEN 'purchase' THEN 'composition_pct.Mn' WHEN 'error' THEN 'composition_pct.C' ELSE 'mechanical_properties.yield_strength_mpa' END as field_path",
                                         "cast(value as decimal(18,2)) as normalized_value", "ts as observed_at")
    finish(jobs.current_values(stream, path))
    return jobs.read_current_values(t.spark, path)


@query(sql="""WITH n AS (SELECT max(heartbeat_at) AS now FROM fx_job_log) SELECT job_id, CASE WHEN attempts >= max_attempts THEN 'failed' ELSE 'retry' END AS decision FROM fx_job_log, n WHERE status='running' AND (heartbeat_at IS NULL OR epoch(date_trunc('second', now)) - epoch(date_trunc('second', heartbeat_at)) > 300)""")
def stale_jobs(t: Tables) -> DataFrame:
    return jobs.job_health(t.job_log)


@query(sql="""WITH n AS (SELECT max(heartbeat_at) AS now FROM fx_job_log) SELECT job_id, CASE WHEN attempts >= max_attempts THEN 'failed' ELSE 'retry' END AS decision FROM fx_job_log, n WHERE status='running' AND (heartbeat_at IS NULL OR epoch(date_trunc('second', now)) - epoch(date_trunc('second', heartbeat_at)) > 300)""")
def stale_job_stream(t: Tables) -> DataFrame:
    path = shared_folder(t.spark)
    stream = events_stream(t).selectExpr("event_id as job_id", "CASE event_type WHEN 'error' THEN 'running' WHEN 'view' THEN 'queued' ELSE 'succeeded' END as status", "event_id%4 as attempts", "3 as max_attempts", "if(event_id%10 = 0, null, ts) as heartbeat_at")
    finish(jobs.job_states(stream, path))
    return jobs.job_health(jobs.latest_by(jobs.written(t.spark, path), ["job_id"], ["batch"]))


PERIODS = """SELECT d.start_date, d.start_date + {days} AS end_date, event_type AS kind, count(*) AS n FROM events CROSS JOIN LATERAL (SELECT CAST(ts AS DATE) - k AS start_date FROM (SELECT unnest(range(0, {days})) AS k)) d GROUP BY 1,2,3"""


def _periods(name: str, days: int):
    period = "1 day" if days == 1 else f"{days} days"

    @query(name=f"{name}_counts", sql=PERIODS.format(days=days).replace("d.start_date + ", "CAST(d.start_date + ").replace(" AS end_date", " AS DATE) AS end_date").replace("CAST(ts AS DATE) - k AS", "CAST(CAST(ts AS DATE) - CAST(k AS INT) AS DATE) AS"))
    def batch(t: Tables) -> DataFrame:
        return jobs.period_counts(t.events.withColumn("kind", F.col("event_type")), "ts", period)


for _name, _days in (("daily", 1), ("weekly", 7), ("monthly", 30)):
    _periods(_name, _days)


@query(sql="SELECT CAST(ts AS DATE) AS start_date, event_type AS kind, count(*) AS n FROM events GROUP BY 1,2")
def daily_count_stream(t: Tables) -> DataFrame:
    path = shared_folder(t.spark)
    finish(jobs.period_counts_stream(events_stream(t).withColumn("kind", F.col("event_type")), "ts", "1 day", path))
    return jobs.latest_by(jobs.written(t.spark, path), ["start_date", "kind"], ["batch"]).select("start_date", "kind", "n")


_PERIOD_SQL = """SELECT e.d AS end_date, c.kind, CAST(sum(c.n) AS BIGINT) AS n FROM (SELECT DISTINCT kind, CAST(ts AS DATE) + CAST(k AS INT) AS d FROM (SELECT event_type AS kind, ts FROM events), range(0, {days}) AS r(k)) e
JOIN (SELECT event_type AS kind, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1,2) c ON c.kind = e.kind AND c.day BETWEEN e.d - {before} AND e.d GROUP BY 1,2"""


def _sliding(t: Tables, days: int) -> DataFrame:
    path = shared_folder(t.spark)
    finish(jobs.pane_counts_stream(events_stream(t).withColumn("kind", F.col("event_type")), "ts", path))
    return jobs.sliding_periods(jobs.read_panes(t.spark, path), days)


@query(sql=_PERIOD_SQL.format(days=7, before=6))
def weekly_count_stream(t: Tables) -> DataFrame:
    """Counts of the seven days up to each day, composed from the streamed daily panes."""
    return _sliding(t, 7)


@query(sql=_PERIOD_SQL.format(days=30, before=29))
def monthly_count_stream(t: Tables) -> DataFrame:
    return _sliding(t, 30)


@query(sql="""WITH o AS (SELECT sha256, arg_min(document_id, (uploaded_at, document_id)) AS original_id FROM fx_uploads GROUP BY 1)
SELECT u.document_id, u.sha256, CASE WHEN o.original_id <> u.document_id THEN o.original_id END AS original_id FROM fx_uploads u JOIN o ON o.sha256 = u.sha256""")
def upload_duplicates(t: Tables) -> DataFrame:
    """Every upload with the document that holds its content already, over three batches of rising upload time."""
    source, path = f"{shared_folder(t.spark)}/uploads", shared_folder(t.spark)
    uploads = t.uploads.withColumn("uploaded_at", F.col("uploaded_at").cast("timestamp"))
    # Read once: an approximate quantile may differ between runs, and each part is a run of its own.
    cuts = uploads.agg(F.percentile_approx(F.unix_micros("uploaded_at"), [0.33, 0.66], 1000).alias("p")).first()["p"] or [0, 0]
    part = F.when(F.unix_micros("uploaded_at") <= cuts[0], 0).when(F.unix_micros("uploaded_at") <= cuts[1], 1).otherwise(2)
    parts = uploads.withColumn("part", part)
    for i in range(3):
        # All files of a part are one batch, as the stream is through with it before the next part is written.
        parts.filter(F.col("part") == i).drop("part").write.mode("append").parquet(source)
        finish(jobs.route_uploads(t.spark.readStream.schema(uploads.schema).parquet(source), path))
    return jobs.written(t.spark, path).select("document_id", "sha256", "original_id")


@query(sql="""SELECT outcome, state, count(*) AS rolls FROM (SELECT product_id, outcome, state FROM ox_outcome WHERE NOT alternative UNION ALL SELECT DISTINCT product_id, 'needs_review', 'rolling_unknown' FROM ox_outcome WHERE alternative) GROUP BY 1,2""")
def classification_stream(t: Tables) -> DataFrame:
    """Facts written by Spark, streamed in two micro-batches through the batch rules."""
    source, path = f"{shared_folder(t.spark)}/facts", shared_folder(t.spark)
    known = cl.complete_facts(facts(t)).drop("certificate_id")
    known.repartition(2).write.parquet(source)
    stream = t.spark.readStream.schema(known.schema).option("maxFilesPerTrigger", 1).parquet(source)
    finish(jobs.classify_stream(stream, ref.catalog(t.spark), path))
    return jobs.written(t.spark, path).groupBy("outcome", "state").agg(F.count("*").alias("rolls"))
