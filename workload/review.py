"""Review history and constraint audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millspark.operators import history as h
from millspark.operators import review as rv
from workload.registry import ORACLE_VIEWS, Tables, query


@query(sql="""WITH l AS (SELECT observation_id AS p, min(observation_id + 1000000*k) AS r FROM fx_observations CROSS JOIN (VALUES (1),(2)) AS v(k) WHERE observation_id%4=0 GROUP BY 1)
SELECT observation_id, product_id, field_path, normalized_value, CASE WHEN is_current AND l.p IS NOT NULL THEN false ELSE is_current END AS is_current, CAST(NULL AS BIGINT) AS corrected_from FROM fx_observations o LEFT JOIN l ON l.p = o.observation_id
UNION ALL SELECT l.r, product_id, field_path, CAST(l.r%100 AS DECIMAL(18,2)), true, observation_id FROM fx_observations o JOIN l ON l.p = o.observation_id WHERE is_current""")
def corrected_observations(t: Tables) -> DataFrame:
    log = t.observations.filter("observation_id%4 = 0").select(F.col("observation_id").alias("previous_observation_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).selectExpr(
        "previous_observation_id", "previous_observation_id + 1000000*k as replacement_id", "cast((previous_observation_id + 1000000*k)%100 as decimal(18,2)) as normalized_value")
    df = rv.apply_corrections(t.observations.withColumn("source_text", F.lit("text")), log)
    return df.select("observation_id", "product_id", "field_path", "normalized_value", "is_current", F.when(F.col("source_text") == "correccion_manual", F.col("supersedes_id")).alias("corrected_from"))


MANUAL = "SELECT event_id, CASE WHEN event_id%11=0 THEN NULL ELSE user_id*10 + 1 + event_id%3 END AS product_id, CAST(NULL AS BIGINT) AS heat_id, CASE event_id%6 WHEN 0 THEN 'thickness_mm' WHEN 1 THEN 'composition_pct.Ti' WHEN 2 THEN 'composition_pct.C' WHEN 3 THEN 'colour' WHEN 4 THEN 'composition_pct.1x' ELSE 'width_mm' END AS field_path FROM events"


@query(sql=f"""WITH m AS ({MANUAL}) SELECT event_id, CASE WHEN field_path IN ('colour','composition_pct.1x') THEN 'manual_field_not_allowed' WHEN product_id IS NULL THEN 'observation_scope_required'
 WHEN EXISTS (SELECT 1 FROM fx_observations o WHERE is_current AND o.product_id = m.product_id AND o.field_path = m.field_path) THEN 'observation_already_exists' ELSE 'accepted' END AS decision FROM m""")
def manual_observations(t: Tables) -> DataFrame:
    rows = t.events.selectExpr("event_id", "if(event_id%11 = 0, null, user_id*10 + 1 + event_id%3) as product_id", "cast(null as bigint) as heat_id",
                               "CASE event_id%6 WHEN 0 THEN 'thickness_mm' WHEN 1 THEN 'composition_pct.Ti' WHEN 2 THEN 'composition_pct.C' WHEN 3 THEN 'colour' WHEN 4 THEN 'composition_pct.1x' ELSE 'width_mm' END as field_path")
    return rv.accept_manual(rows, t.observations.withColumn("heat_id", F.lit(None).cast("bigint"))).select("event_id", "decision")


VALUES = """SELECT event_id, CASE event_id%8 WHEN 0 THEN 'coiled' WHEN 1 THEN 'rolling' WHEN 2 THEN 'stainless_series' WHEN 3 THEN 'width_mm' WHEN 4 THEN 'composition_pct.C' WHEN 5 THEN 'note' WHEN 6 THEN 'composition_pct.Mn' ELSE 'coating.inferior_g_m2' END AS field_path,
 CASE event_id%7 WHEN 0 THEN 'true' WHEN 1 THEN 'hot' WHEN 2 THEN '300' WHEN 3 THEN '-4' WHEN 4 THEN NULL WHEN 5 THEN 'abc' ELSE '12.5' END AS value_text FROM events"""


@query(sql=f"""WITH v AS ({VALUES}) SELECT event_id, CASE WHEN value_text IS NULL THEN NULL WHEN field_path='coiled' THEN CASE WHEN value_text NOT IN ('true','false') THEN 'boolean_required' END WHEN field_path='rolling' THEN CASE WHEN value_text NOT IN ('hot','cold') THEN 'rolling_required' END
 WHEN field_path='stainless_series' THEN CASE WHEN value_text <> '300' THEN 'series_required' END WHEN field_path='note' THEN NULL WHEN TRY_CAST(value_text AS DOUBLE) IS NULL THEN 'number_required' WHEN CAST(value_text AS DOUBLE) < 0 THEN 'negative' WHEN field_path LIKE 'composition%' AND CAST(value_text AS DOUBLE) > 100 THEN 'over_100' END AS value_error FROM v""")
def value_checks(t: Tables) -> DataFrame:
    return rv.validate_values(t.spark.sql(VALUES.replace("FROM events", "FROM {events}"), events=t.events)).select("event_id", "value_error")


@query(sql="""SELECT observation_id, CASE WHEN observation_id%3=0 THEN 'replaced' ELSE 'verification_unavailable' END AS outcome, CASE WHEN observation_id%3=0 THEN normalized_value + 1 END AS accepted_value, CASE WHEN observation_id%3=0 THEN 'cell | ' || field_path END AS accepted_source FROM fx_observations WHERE is_current""")
def accepted_proposals(t: Tables) -> DataFrame:
    df = t.observations.filter("is_current").selectExpr("observation_id", "CASE observation_id%3 WHEN 0 THEN 'discrepancy' WHEN 1 THEN 'matches' END as verification_status", "normalized_value + 1 as proposed_value", "'cell' as proposed_source", "field_path as proposed_header")
    return rv.accept_proposals(df).select("observation_id", "outcome", "accepted_value", "accepted_source")


# Four events at most per run in the fixture: unrolled replay.
ORACLE_VIEWS["ox_replay"] = """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS k FROM fx_approval_events),
a1 AS (SELECT *, 'needs_review' AS f, to_status <> 'needs_review' AS v FROM e WHERE k = 1), s1 AS (SELECT run_id, CASE WHEN v THEN to_status ELSE f END AS s FROM a1),
a2 AS (SELECT e.*, s AS f, CASE s WHEN 'approved' THEN to_status = 'rejected' WHEN 'draft' THEN true ELSE to_status <> s END AS v FROM e JOIN s1 ON s1.run_id = e.run_id WHERE k = 2), s2 AS (SELECT run_id, CASE WHEN v THEN to_status ELSE f END AS s FROM a2),
a3 AS (SELECT e.*, s AS f, CASE s WHEN 'approved' THEN to_status = 'rejected' WHEN 'draft' THEN true ELSE to_status <> s END AS v FROM e JOIN s2 ON s2.run_id = e.run_id WHERE k = 3), s3 AS (SELECT run_id, CASE WHEN v THEN to_status ELSE f END AS s FROM a3),
a4 AS (SELECT e.*, s AS f, CASE s WHEN 'approved' THEN to_status = 'rejected' WHEN 'draft' THEN true ELSE to_status <> s END AS v FROM e JOIN s3 ON s3.run_id = e.run_id WHERE k = 4)
SELECT run_id, certificate_id, event_id, f AS from_status, to_status, v AS valid FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3 UNION ALL SELECT * FROM a4)
"""


@query(sql="SELECT run_id, event_id, from_status, to_status, valid FROM ox_replay")
def approval_replay(t: Tables) -> DataFrame:
    return rv.replay_approvals(t.approval_events).select("run_id", "event_id", "from_status", "to_status", "valid")


@query(sql="""SELECT r.certificate_id, max(r.run_id) AS run_id, coalesce(any_value(s), 'needs_review') AS status FROM fx_runs r LEFT JOIN (SELECT run_id, arg_max(to_status, event_id) AS s FROM ox_replay WHERE valid GROUP BY 1) x
ON x.run_id = (SELECT max(run_id) FROM fx_runs q WHERE q.certificate_id = r.certificate_id) GROUP BY 1""")
def status_after_replay(t: Tables) -> DataFrame:
    return rv.status_after_replay(rv.replay_approvals(t.approval_events), t.runs)


ORACLE_VIEWS["ox_blocked"] = "SELECT candidate_id FROM fx_factors WHERE required_for_selection AND outcome IN ('not_matched','conflict') UNION SELECT candidate_id FROM fx_candidates WHERE has_conflicts"
ORACLE_VIEWS["ox_chosen"] = "SELECT result_id, arg_max(candidate_id, selection_id) AS candidate_id FROM fx_choices c WHERE NOT selection_cleared AND selection_id NOT IN (SELECT supersedes_selection_id FROM fx_choices WHERE supersedes_selection_id IS NOT NULL) GROUP BY 1"


@query(sql="""WITH r AS (SELECT r.run_id, count(*) AS n, count(CASE WHEN c.result_id IS NULL THEN 1 END) AS u, count(CASE WHEN outcome <> 'classified' THEN 1 END) AS o, count(k.result_id) AS b FROM fx_results r LEFT JOIN (SELECT DISTINCT result_id FROM fx_choices) c ON c.result_id = r.result_id
 LEFT JOIN (SELECT result_id FROM ox_chosen WHERE candidate_id IN (SELECT candidate_id FROM ox_blocked)) k ON k.result_id = r.result_id GROUP BY 1), p AS (SELECT run_id, count(*) AS n FROM (SELECT u.run_id, i.product_id, 1 AS want FROM fx_runs u JOIN fx_products i ON i.certificate_id = u.certificate_id) e FULL JOIN (SELECT run_id, product_id, count(*) AS held FROM fx_results GROUP BY 1,2) s USING (run_id, product_id) WHERE want IS NULL OR coalesce(held, 0) <> 1 GROUP BY 1), h AS (SELECT certificate_id, count(*) AS n FROM fx_heats WHERE heat_id NOT IN (SELECT heat_id FROM fx_products) GROUP BY 1),
x AS (SELECT u.run_id, coalesce(r.n,0) AS rn, coalesce(p.n,0) AS pn, coalesce(h.n,0) AS hn, coalesce(r.u,0) AS uu, coalesce(r.o,0) AS oo, coalesce(r.b,0) AS bb FROM fx_runs u LEFT JOIN r ON r.run_id = u.run_id LEFT JOIN p ON p.run_id = u.run_id LEFT JOIN h ON h.certificate_id = u.certificate_id)
SELECT run_id, concat_ws(',', CASE WHEN rn=0 THEN 'no_results' END, CASE WHEN pn>0 THEN 'products_differ' END, CASE WHEN hn>0 THEN 'heat_without_product' END, CASE WHEN uu>0 THEN 'selection_missing' END, CASE WHEN oo>0 THEN 'unresolved_result' END, CASE WHEN bb>0 THEN 'blocked_option' END) AS reasons,
 rn>0 AND pn=0 AND hn=0 AND uu=0 AND oo=0 AND bb=0 AS eligible FROM x""")
def approval_eligibility(t: Tables) -> DataFrame:
    return rv.approval_eligibility(t.runs, t.products, t.heats, t.results, t.choices, h.current_selections(t.choices), rv.blocking_candidates(t.candidates, t.factors)).select("run_id", "reasons", "eligible")


@query(sql="""WITH g AS (SELECT result_id, count(*) AS n, min(rank) AS lo, max(rank) AS hi, count(DISTINCT rank) AS d FROM fx_candidates WHERE NOT manual GROUP BY 1)
SELECT candidate_id, CASE WHEN candidate_id IN (SELECT candidate_id FROM ox_blocked) THEN 'candidate_has_conflicts' WHEN NOT manual AND NOT coalesce(n <= 3 AND lo = 1 AND hi = n AND d = n, false) THEN 'valid_candidates_required' ELSE 'selectable' END AS decision FROM fx_candidates c LEFT JOIN g ON g.result_id = c.result_id""")
def selection_eligibility(t: Tables) -> DataFrame:
    return rv.selection_eligibility(t.candidates, rv.blocking_candidates(t.candidates, t.factors)).select("candidate_id", "decision")


@query(sql="""SELECT r.result_id, CASE WHEN x.result_id IS NOT NULL THEN NULL ELSE coalesce(c.fraction, r.fraction) END AS fraction, CASE WHEN x.result_id IS NOT NULL THEN NULL ELSE coalesce(c.nico, r.nico) END AS nico, CASE WHEN x.result_id IS NOT NULL THEN 'needs_review' WHEN c.candidate_id IS NOT NULL THEN 'classified' ELSE r.outcome END AS outcome
FROM fx_results r LEFT JOIN ox_chosen o ON o.result_id = r.result_id LEFT JOIN fx_candidates c ON c.candidate_id = o.candidate_id LEFT JOIN (SELECT DISTINCT result_id FROM fx_choices WHERE selection_cleared) x ON x.result_id = r.result_id""")
def folded_selections(t: Tables) -> DataFrame:
    return rv.fold_selections(t.results, h.current_selections(t.choices), t.choices.filter("selection_cleared"), t.candidates).select("result_id", "fraction", "nico", "outcome")


REQUESTS = "SELECT result_id, CASE result_id%4 WHEN 0 THEN '72091801' WHEN 1 THEN '7209180' ELSE '72250000' END AS fraction, '99' AS nico FROM fx_results"


@query(sql=f"""WITH q AS ({REQUESTS}) SELECT q.result_id, CASE WHEN length(q.fraction) <> 8 THEN 'invalid_tariff_code' WHEN c.r IS NOT NULL THEN 'existing' ELSE 'added' END AS decision, CASE WHEN length(q.fraction) = 8 THEN coalesce(c.r, coalesce(m.r, 0) + 1) END AS rank
FROM q LEFT JOIN (SELECT result_id, fraction, nico, min(rank) AS r FROM fx_candidates GROUP BY 1,2,3) c ON c.result_id = q.result_id AND c.fraction = q.fraction AND c.nico = q.nico LEFT JOIN (SELECT result_id, max(rank) AS r FROM fx_candidates GROUP BY 1) m ON m.result_id = q.result_id""")
def manual_candidates(t: Tables) -> DataFrame:
    requests = t.results.selectExpr("result_id", "CASE result_id%4 WHEN 0 THEN '72091801' WHEN 1 THEN '7209180' ELSE '72250000' END as fraction", "'99' as nico")
    return rv.manual_candidates(requests, t.candidates).select("result_id", "decision", "rank")


@query(sql="SELECT user_id AS document_id, arg_max(event_type IN ('error','click'), event_id) AS archived FROM events GROUP BY 1")
def archived_documents(t: Tables) -> DataFrame:
    return rv.archived_flags(t.events.selectExpr("user_id as document_id", "event_type in ('error', 'click') as archived", "event_id"))


@query(sql="""SELECT r.run_id, 'product_without_result' AS kind, p.product_id AS id FROM fx_runs r JOIN fx_products p ON p.certificate_id = r.certificate_id WHERE NOT EXISTS (SELECT 1 FROM fx_results x WHERE x.run_id = r.run_id AND x.product_id = p.product_id)
UNION ALL SELECT r.run_id, 'heat_without_product', h.heat_id FROM fx_runs r JOIN fx_heats h ON h.certificate_id = r.certificate_id WHERE h.heat_id NOT IN (SELECT heat_id FROM fx_products) UNION ALL SELECT run_id, 'result_without_choice', result_id FROM fx_results WHERE result_id NOT IN (SELECT result_id FROM fx_choices)""")
def pending_review(t: Tables) -> DataFrame:
    return rv.pending_review(t.runs, t.products, t.heats, t.results, t.choices)


@query(sql="""SELECT 'products' AS table_name, 'unique' AS rule, certificate_id || '/' || product_identifier AS id FROM fx_product_rows GROUP BY certificate_id, product_identifier HAVING count(*) > 1
UNION ALL SELECT 'heats', 'unique', certificate_id || '/' || heat_no FROM fx_quality_heats GROUP BY certificate_id, heat_no HAVING count(*) > 1
UNION ALL SELECT 'candidates', 'unique', result_id || '/' || fraction || '/' || nico FROM fx_candidates GROUP BY result_id, fraction, nico HAVING count(*) > 1
UNION ALL SELECT 'compositions', 'percentage_range', CAST(heat_id AS VARCHAR) FROM fx_quality_compositions WHERE TRY_CAST(percentage AS DECIMAL(18,8)) NOT BETWEEN 0 AND 100
UNION ALL SELECT 'products', 'foreign_key', CAST(product_id AS VARCHAR) FROM fx_product_rows WHERE heat_id NOT IN (SELECT heat_id FROM fx_quality_heats)""")
def constraint_audit(t: Tables) -> DataFrame:
    compositions = t.quality_compositions.withColumn("percentage", F.expr("try_cast(percentage as decimal(18,8))"))
    return rv.audit_constraints(t.certificates, t.quality_heats, t.product_rows, t.results, t.candidates, compositions)
