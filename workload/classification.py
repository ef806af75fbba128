"""Classification rules (R1 to R13) over the fixture rolls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from millspark import session
from millspark.functions import refdata as ref
from millspark.operators import classification as cl
from millspark.operators import facts as fa
from workload.registry import ORACLE_VIEWS, Tables, query

LIST = lambda name: F.array_join(F.array_sort(name), ",").alias(name)


def assembled(t: Tables) -> DataFrame:
    """The facts of the rolls; the rolls, which all layers reach, are written once."""
    t.write_once("products")
    stored = t.stored_rolls.withColumn("condition", F.split("condition_text", ",")).drop("condition_text")
    return fa.assemble_facts(stored, t.scoped_compositions, t.fact_observations)


def facts(t: Tables) -> DataFrame:
    """Queries with several readers start from the assembled facts, written once: rules name a fact many times."""
    return session.staged(assembled(t))


def facts_in_place(t: Tables, *names: str) -> DataFrame:
    """For a query with one reader: the facts it names, held instead of written. Other columns are not moved."""
    return session.held(assembled(t).select("product_id", *names))


def staged(t: Tables, names: Sequence[str] = cl.GATE_FACTS) -> DataFrame:
    df = cl.with_short_names(cl.steel_family(cl.scope_gate(facts_in_place(t, *names))))
    # Held once more, as the filters that follow name scope, family and heading many times over.
    return session.held(cl.heading(cl.coating_state(df)).drop("unknown_elements", "missing_physical", "family_missing", "family_candidates"))


# ---- oracle views: the layers of each fact, then the rules written as plain SQL over pivoted chemistry ----
SQL_TYPES = {"string": "VARCHAR", "boolean": "BOOLEAN", "decimal(18,6)": "DECIMAL(18,6)"}
OBSERVED = {n: fa.PATHS.get(n, n) for n in cl.FACT_TYPES if n not in ("composition_pct", "coating_both_sides")} | {p.replace(".", "_"): p for p in fa.FACES}
STORED = {"pickled": """CASE WHEN list_has_any(string_split(lower(condition_text), ','), ['pickled', 'decapado']) THEN true
  WHEN list_has_any(string_split(lower(condition_text), ','), ['not_pickled', 'unpickled', 'sin decapar']) THEN false END""",
          "coated": "CASE WHEN coating_metal <> '' THEN true ELSE coated END", "temper": "NULL"}
ORACLE_VIEWS["ox_seen"] = """
SELECT product_id, field_path, value, scope, observation_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id, field_path ORDER BY scope DESC, observation_id DESC) AS k FROM (
 SELECT product_id, field_path, value, 'product' AS scope, observation_id FROM fx_fact_observations WHERE is_current AND product_id IS NOT NULL
 UNION ALL SELECT p.product_id, o.field_path, o.value, 'heat', o.observation_id FROM fx_fact_observations o JOIN fx_stored_rolls p ON p.heat_id = o.heat_id WHERE o.is_current AND o.product_id IS NULL)) WHERE k = 1
"""
ORACLE_VIEWS["ox_seen_wide"] = "SELECT product_id, " + ", ".join(
    f"max(CASE WHEN field_path='{path}' THEN value END) AS v_{name}, count(CASE WHEN field_path='{path}' THEN 1 END) > 0 AS h_{name}" for name, path in OBSERVED.items()
) + " FROM ox_seen GROUP BY 1"
ORACLE_VIEWS["ox_layered"] = "SELECT s.product_id, s.certificate_id, s.heat_id, s.heat_no, " + ", ".join(
    f"CASE WHEN h_{name} THEN TRY_CAST(v_{name} AS {SQL_TYPES[cl.FACT_TYPES.get(name, 'decimal(18,6)')]}) ELSE "
    + ("CASE WHEN (CASE WHEN h_coating_metal THEN v_coating_metal ELSE coating_metal END) <> '' THEN true ELSE coated END" if name == "coated"
       else f"CAST({STORED.get(name, 's.' + name)} AS {SQL_TYPES[cl.FACT_TYPES.get(name, 'decimal(18,6)')]})") + f" END AS {name}"
    for name in OBSERVED) + " FROM fx_stored_rolls s LEFT JOIN ox_seen_wide w ON w.product_id = s.product_id"
ORACLE_VIEWS["ox_assembled"] = """
SELECT *, CASE WHEN coating_superior_g_m2 = 0 OR coating_inferior_g_m2 = 0 THEN false WHEN coating_superior_g_m2 IS NOT NULL AND coating_inferior_g_m2 IS NOT NULL
 THEN coating_superior_g_m2 > 0 AND coating_inferior_g_m2 > 0 END AS coating_both_sides FROM ox_layered
"""
ORACLE_VIEWS["ox_chem"] = """
SELECT product_id, element, percentage FROM (SELECT *, row_number() OVER (PARTITION BY product_id, element ORDER BY layer DESC) AS k FROM (
 SELECT product_id, substr(field_path, 17) AS element, TRY_CAST(value AS DECIMAL(18,8)) AS percentage, 3 AS layer FROM ox_seen WHERE starts_with(field_path, 'composition_pct.')
 UNION ALL SELECT product_id, element, percentage, 2 FROM fx_scoped_compositions WHERE product_id IS NOT NULL
 UNION ALL SELECT p.product_id, c.element, c.percentage, 1 FROM fx_scoped_compositions c JOIN fx_stored_rolls p ON p.heat_id = c.heat_id WHERE c.product_id IS NULL)) WHERE k = 1
"""
ORACLE_VIEWS["ox_roll"] = """
SELECT c.product_id, max(CASE WHEN c.element='C' THEN percentage END) AS c, max(CASE WHEN c.element='Cr' THEN percentage END) AS cr,
 max(CASE WHEN c.element='B' THEN percentage END) AS boron, count(CASE WHEN percentage >= threshold THEN 1 END) AS n_matched,
 count(CASE WHEN threshold IS NOT NULL AND percentage IS NULL THEN 1 END) AS n_unknown,
 string_agg(CASE WHEN percentage >= threshold THEN c.element END, ',' ORDER BY idx) AS matched,
 string_agg(CASE WHEN threshold IS NOT NULL AND percentage IS NULL THEN c.element END, ',' ORDER BY idx) AS unknowns,
 count(percentage) AS n_known
FROM ox_chem c LEFT JOIN fx_thresholds t ON c.element = t.element GROUP BY c.product_id
"""
ORACLE_VIEWS["ox_facts"] = """
SELECT f.*, h.c, h.cr, h.boron, h.matched, h.unknowns, h.n_known, h.n_matched, thickness_mm AS t, width_mm AS w, yield_strength_mpa AS ys,
 lower(coalesce(coating_metal,'')) AS metal, lower(coalesce(coating_process,'')) AS process,
 CASE WHEN c > 2 THEN 'exception' WHEN c <= 1.2 AND cr >= 10.5 THEN 'stainless' WHEN n_matched > 0 AND c IS NOT NULL AND cr IS NOT NULL THEN 'other_alloy'
  WHEN n_matched > 0 THEN 'ambiguous' WHEN n_unknown > 0 THEN 'unproven' WHEN c IS NULL THEN 'carbon_missing' ELSE 'non_alloy' END AS family_state,
 (CASE WHEN width_mm IS NULL THEN 1 ELSE 0 END) + (CASE WHEN thickness_mm IS NULL THEN 1 ELSE 0 END) + (CASE WHEN coiled IS NULL THEN 1 ELSE 0 END) AS n_missing_dims
FROM ox_assembled f LEFT JOIN ox_roll h ON f.product_id = h.product_id
"""
ORACLE_VIEWS["ox_scope"] = """
SELECT *, CASE WHEN coalesce(form,'') <> 'flat_rolled' THEN 'out_of_scope' WHEN n_missing_dims = 0 AND rolling IS NULL THEN 'rolling_only'
 WHEN n_missing_dims > 0 OR rolling IS NULL THEN 'missing_physical'
 WHEN NOT coiled AND ((t < 4.75 AND w < 10*t) OR (t >= 4.75 AND (w <= 150 OR t > w/2))) THEN 'geometry_conflict' ELSE 'in_scope' END AS scope,
 CASE WHEN family_state IN ('stainless','other_alloy','non_alloy') THEN family_state END AS family
FROM ox_facts
"""
ORACLE_VIEWS["ox_scenario"] = """
SELECT s.* EXCLUDE (rolling), s.rolling IS NULL AND scope = 'rolling_only' AS alternative, coalesce(s.rolling, v.r) AS rolling,
 CASE WHEN scope IN ('out_of_scope','missing_physical') THEN scope
  WHEN NOT coiled AND ((t < 4.75 AND w < 10*t) OR (t >= 4.75 AND (w <= 150 OR t > w/2))) THEN 'geometry_conflict'
  WHEN family IS NULL THEN 'family_unknown' WHEN coated IS NULL THEN 'coating_unknown'
  WHEN NOT coated AND coating_metal IS NOT NULL THEN 'coating_conflict' ELSE 'branch' END AS state
FROM ox_scope s LEFT JOIN (VALUES ('cold'),('hot')) AS v(r) ON s.scope = 'rolling_only'
"""
# Every hypothesis of family and coating that a roll leaves open, with its heading; known rolls have exactly one.
ORACLE_VIEWS["ox_hypothesis"] = """
SELECT s.* EXCLUDE (coated, family), s.coated AS coated_fact, s.family AS family_fact, fam.f AS family, fam.i AS family_idx, co.k AS coated,
 CASE WHEN fam.f='non_alloy' AND co.k THEN CASE WHEN w >= 600 THEN '7210' ELSE '7212' END
  WHEN fam.f='non_alloy' AND rolling='hot' THEN CASE WHEN w >= 600 THEN '7208' ELSE '7211' END
  WHEN fam.f='non_alloy' THEN CASE WHEN w >= 600 THEN '7209' ELSE '7211' END
  WHEN fam.f='stainless' THEN CASE WHEN w >= 600 THEN '7219' ELSE '7220' END
  ELSE CASE WHEN w >= 600 THEN '7225' ELSE '7226' END END AS heading
FROM ox_scenario s JOIN (VALUES ('non_alloy',1),('stainless',2),('other_alloy',3)) AS fam(f,i)
 ON (s.family = fam.f OR (s.family IS NULL AND ((family_state='ambiguous' AND fam.f <> 'non_alloy') OR (family_state='carbon_missing' AND fam.f='non_alloy')
   OR (family_state='unproven' AND (fam.f <> 'stainless' OR c IS NULL OR cr IS NULL)))))
 JOIN (VALUES (false),(true)) AS co(k) ON (s.coated IS NULL OR s.coated = co.k)
WHERE state IN ('family_unknown','coating_unknown','branch')
"""
# fraction|nico|missing|codes
ORACLE_VIEWS["ox_branch"] = """
SELECT *, CASE heading
WHEN '7208' THEN CASE
 WHEN pattern_in_relief AND coiled THEN '72081003|' || CASE WHEN t > 10 THEN '01||' WHEN t > 4.75 THEN '02||' WHEN t = 4.75 THEN '|source_boundary_4_75_mm|02,03,99'
   WHEN pickled IS NULL THEN '|pickled|03,99' WHEN pickled THEN '99||' ELSE '03||' END
 WHEN pattern_in_relief THEN CASE WHEN t > 4.75 THEN '72084002|01||' ELSE '72084002|99||' END
 WHEN pattern_in_relief IS NULL AND coiled THEN '||pattern_in_relief|72081003,' || CASE WHEN t >= 4.75 THEN '72082502' WHEN t >= 3 THEN '72082601' ELSE '72082701' END || ',' ||
   CASE WHEN t > 10 THEN '72083601' WHEN t >= 4.75 THEN '72083701' WHEN t >= 3 THEN '72083801' ELSE '72083901' END
 WHEN pattern_in_relief IS NULL THEN '||pattern_in_relief|72084002,' || CASE WHEN t > 10 THEN '72085104' WHEN t >= 4.75 THEN '72085201' WHEN t >= 3 THEN '72085301' ELSE '72085401' END
 WHEN NOT coiled THEN CASE WHEN t > 10 THEN '72085104||nico_qualifier|01,02,03,04,05' WHEN t >= 4.75 THEN '72085201|00||' WHEN t >= 3 THEN '72085301|00||' ELSE '72085401|00||' END
 WHEN pickled IS NULL THEN '||pickled|' || CASE WHEN t >= 4.75 THEN '72082502' WHEN t >= 3 THEN '72082601' ELSE '72082701' END || ',' ||
   CASE WHEN t > 10 THEN '72083601' WHEN t >= 4.75 THEN '72083701' WHEN t >= 3 THEN '72083801' ELSE '72083901' END
 WHEN pickled AND t >= 4.75 THEN CASE WHEN t > 10 THEN '72082502|01||' ELSE '72082502|99||' END
 WHEN NOT pickled AND t >= 4.75 THEN CASE WHEN t > 10 THEN '72083601' ELSE '72083701' END || CASE WHEN ys >= 355 THEN '|01||' WHEN pipeline_steel THEN '|02||'
   WHEN ys IS NOT NULL AND NOT pipeline_steel THEN '|99||' ELSE '||pipeline_steel,yield_strength_mpa|01,02,99' END
 ELSE CASE WHEN pickled AND t >= 3 THEN '72082601' WHEN pickled THEN '72082701' WHEN t >= 3 THEN '72083801' ELSE '72083901' END ||
   CASE WHEN ys >= 355 THEN '|01||' WHEN ys < 355 THEN '|99||' ELSE '||yield_strength_mpa|01,99' END END
WHEN '7209' THEN CASE
 WHEN coiled AND t >= 3 THEN '72091504|' || CASE WHEN c > 0.4 THEN '01||' WHEN ys >= 355 THEN '02||' WHEN NOT porcelain_exposed_parts AND c IS NOT NULL AND ys IS NOT NULL THEN '99||'
   ELSE CASE WHEN deep_drawing_class IS NULL THEN '|deep_drawing_class,porcelain_exposed_parts' ELSE '|porcelain_exposed_parts' END || '|01,02,03,99' END
 WHEN coiled AND t < 0.5 THEN CASE WHEN t < 0.361 THEN '72091801|01||' ELSE '72091801|99||' END
 WHEN coiled THEN CASE WHEN t > 1 THEN '72091601' ELSE '72091701' END || CASE WHEN ys >= 355 THEN '|01||' WHEN ys < 355 THEN '|99||' ELSE '||yield_strength_mpa|01,99' END
 WHEN t >= 3 THEN '72092501|00||' WHEN t > 1 THEN '72092601|00||' WHEN t >= 0.5 THEN '72092701|00||' ELSE '72092801|00||' END
WHEN '7210' THEN CASE metal
 WHEN 'sn' THEN CASE WHEN t >= 0.5 THEN '72101101|00||' WHEN secondary_reduction_ratio IS NULL OR can_body_end_use IS NULL THEN '72101204||can_body_end_use,secondary_reduction_ratio|01,02,99'
   ELSE '72101204||official_nico_qualifier|01,02,03,99' END
 WHEN 'pb' THEN '72102001|00||'
 WHEN 'zn' THEN CASE WHEN process = 'electrolytic' THEN CASE WHEN coating_both_sides THEN '72103002|01||' WHEN NOT coating_both_sides THEN '72103002|99||' ELSE '72103002||coating_both_sides|01,99' END
   WHEN process = '' THEN '||coating_process|72103002,72104999'
   WHEN pattern_in_relief THEN CASE WHEN coating_both_sides THEN '72104101|00||' WHEN NOT coating_both_sides THEN '72104199|00||' ELSE '||coating_both_sides|72104101,72104199' END
   WHEN pattern_in_relief IS NULL THEN '||pattern_in_relief|72104101,72104199,72104999'
   WHEN ys >= 355 THEN '72104999|02||' WHEN ys IS NULL THEN '72104999||yield_strength_mpa|72104999' WHEN t < 3 AND ys >= 275 THEN '72104999|01||' ELSE '72104999|99||' END
 WHEN 'al-zn' THEN '72106101|00||'
 ELSE '||coating_metal|72101101,72103002,72104999,72106101,72107002' END
WHEN '7211' THEN CASE
 WHEN rolling = 'hot' AND rolled_four_faces AND w > 150 AND t >= 4 AND NOT coiled AND pattern_in_relief IS NULL THEN '||pattern_in_relief|72111301'
 WHEN rolling = 'hot' AND rolled_four_faces AND w > 150 AND t >= 4 AND NOT coiled AND NOT pattern_in_relief THEN '72111301|00||'
 WHEN rolling = 'hot' AND t >= 4.75 THEN CASE WHEN coiled THEN '72111491|03||' ELSE '72111491||nico_qualifier,product_kind|72111491' END
 WHEN rolling = 'hot' THEN '72111999||nico_qualifier,product_kind|72111999'
 WHEN c >= 0.25 THEN '72112999||nico_qualifier,product_kind|72112999' ELSE '72112303||nico_qualifier,product_kind|72112303' END
WHEN '7212' THEN CASE
 WHEN clad THEN CASE WHEN cladding_weight_percentage IS NULL THEN '72126004||cladding_weight_percentage|72126004' ELSE '72126004||cladding_material|72126004' END
 WHEN metal = 'sn' THEN '72121003||product_kind|72121003'
 WHEN metal = 'zn' AND process = 'electrolytic' THEN '72122003||coating_both_sides,product_kind|72122003'
 WHEN metal = 'zn' THEN '72123003||coating_both_sides,coating_process,product_kind|72123003'
 WHEN metal = '' THEN '||coating_metal|' ELSE '72125001|00||' END
WHEN '7219' THEN CASE
 WHEN rolling = 'hot' AND coiled AND t > 10 THEN '72191101|00||'
 WHEN rolling = 'hot' AND coiled AND t >= 4.75 THEN CASE WHEN t <= 6 AND w BETWEEN 710 AND 1350 THEN '72191202|01||' ELSE '72191202|99||' END
 WHEN rolling = 'hot' AND t > 10 THEN '72192101|00||'
 WHEN rolling = 'hot' AND NOT coiled AND t < 4.75 THEN CASE WHEN t >= 3 THEN '72192301|00||' ELSE '72192401|00||' END
 WHEN rolling = 'cold' AND t >= 4.75 THEN CASE WHEN coiled THEN '72193101|01||' ELSE '72193101|99||' END
 WHEN rolling = 'cold' AND t <= 1 THEN '72193502||ambiguous_source_code_7219_35_02|72193502'
 WHEN rolling = 'cold' AND t >= 3 THEN CASE WHEN stainless_series IS NULL THEN '72193202||stainless_series|72193202'
   ELSE '72193202|' || CASE WHEN t <= 4 THEN CASE stainless_series WHEN '200' THEN '02' WHEN '300' THEN '03' WHEN '400' THEN '04' ELSE '99' END
     ELSE CASE stainless_series WHEN '200' THEN '91' WHEN '300' THEN '92' WHEN '400' THEN '93' ELSE '99' END END || '||' END
 ELSE CASE WHEN rolling = 'cold' THEN '72193301' WHEN NOT coiled THEN '72192201' WHEN t >= 3 THEN '72191301' ELSE '72191401' END ||
   CASE stainless_series WHEN '200' THEN '|01||' WHEN '300' THEN '|02||' WHEN '400' THEN '|03||' WHEN 'other' THEN '|99||'
     ELSE '||stainless_series|' || CASE WHEN rolling = 'cold' THEN '72193301' WHEN NOT coiled THEN '72192201' WHEN t >= 3 THEN '72191301' ELSE '72191401' END END END
WHEN '7220' THEN CASE WHEN rolling = 'cold' THEN '72202003||nico_qualifier,stainless_series,temper|72202003' WHEN t >= 4.75 THEN '72201101|00||' ELSE '72201201|00||' END
WHEN '7225' THEN CASE
 WHEN grain_oriented OR magnetic_silicon THEN CASE WHEN grain_oriented THEN '72251101' ELSE '72251999' END ||
   CASE WHEN magnetic_loss_w_per_kg IS NULL AND magnetic_induction_tesla IS NULL THEN '||magnetic_induction_tesla,magnetic_loss_w_per_kg|' WHEN magnetic_loss_w_per_kg IS NULL THEN '||magnetic_loss_w_per_kg|'
    WHEN magnetic_induction_tesla IS NULL THEN '||magnetic_induction_tesla|' ELSE '|00||' END || CASE WHEN grain_oriented THEN '72251101' ELSE '72251999' END
 WHEN coated AND metal = 'zn' THEN CASE process WHEN 'electrolytic' THEN '72259101|00||' WHEN '' THEN '||coating_process|72259101,72259201'
   ELSE CASE WHEN ys >= 355 THEN '72259201|01||' WHEN ys < 355 THEN '72259201|99||' ELSE '72259201||yield_strength_mpa|01,99' END END
 WHEN coated THEN '72259999||coating_layer_details|72259999'
 WHEN rolling = 'hot' THEN CASE WHEN coiled THEN '72253091||nico_qualifier|72253091' ELSE '72254091||nico_qualifier|72254091' END
 ELSE CASE WHEN deep_drawing_class IS NULL THEN '72255091||deep_drawing_class,nico_qualifier|72255091' ELSE '72255091||nico_qualifier|72255091' END END
WHEN '7226' THEN CASE
 WHEN grain_oriented OR magnetic_silicon THEN CASE WHEN grain_oriented THEN '72261101' ELSE '72261999' END ||
   CASE WHEN magnetic_loss_w_per_kg IS NULL AND magnetic_induction_tesla IS NULL THEN '||magnetic_induction_tesla,magnetic_loss_w_per_kg|' WHEN magnetic_loss_w_per_kg IS NULL THEN '||magnetic_loss_w_per_kg|'
    WHEN magnetic_induction_tesla IS NULL THEN '||magnetic_induction_tesla|' ELSE '|00||' END || CASE WHEN grain_oriented THEN '72261101' ELSE '72261999' END
 WHEN high_speed_steel THEN '72262001|00||' WHEN coated THEN '72269999||coating_process,nico_qualifier|72269999'
 WHEN rolling = 'hot' THEN '72269107||nico_qualifier|72269107' ELSE '72269206||nico_qualifier|72269206' END
END AS rule_text
FROM ox_hypothesis
"""


@query(sql="""
SELECT CASE WHEN state IN ('missing_physical') OR alternative THEN 'missing_physical' ELSE state END AS stage, family_fact AS family, heading, count(*) AS rolls
FROM (SELECT product_id, state, alternative, family AS family_fact, CASE WHEN state='branch' THEN (SELECT max(heading) FROM ox_hypothesis h WHERE h.product_id = s.product_id AND NOT h.alternative) END AS heading
 FROM ox_scenario s WHERE NOT alternative OR rolling = 'hot') x
GROUP BY 1,2,3
""")
def rolls_by_family_and_heading(t: Tables) -> DataFrame:
    """Rolls per stage, steel family and heading, and how many stay unproven for missing chemistry."""
    df = staged(t).withColumn("stage", F.expr("""case when scope in ('out_of_scope', 'geometry_conflict') then scope
        when scope <> 'in_scope' then 'missing_physical' when family is null then 'family_unknown'
        when coating_state = 'unknown' then 'coating_unknown' when coating_state = 'conflict' then 'coating_conflict' else 'branch' end"""))
    return df.withColumn("heading", F.expr("if(stage = 'branch', heading, null)")).groupBy("stage", "family", "heading").agg(F.count("*").alias("rolls"))


@query(sql="""SELECT product_id, CASE WHEN scope='rolling_only' THEN 'rolling_only' ELSE scope END AS scope,
 concat_ws(',', CASE WHEN coiled IS NULL THEN 'coiled' END, CASE WHEN rolling IS NULL THEN 'rolling' END, CASE WHEN t IS NULL THEN 'thickness_mm' END, CASE WHEN w IS NULL THEN 'width_mm' END) AS missing_physical
FROM ox_scope""")
def scope_gate(t: Tables) -> DataFrame:
    return cl.scope_gate(facts_in_place(t, "form", "coiled", "rolling", "thickness_mm", "width_mm")).select("product_id", "scope", LIST("missing_physical"))


@query(sql="""SELECT product_id, t AS thickness_mm, w AS width_mm FROM ox_facts
WHERE NOT coiled AND t IS NOT NULL AND w IS NOT NULL AND ((t < 4.75 AND w < 10*t) OR (t >= 4.75 AND (w <= 150 OR t > w/2)))""")
def geometry_contradictions(t: Tables) -> DataFrame:
    return facts_in_place(t, "coiled", "thickness_mm", "width_mm").filter(cl.GEOMETRY_CONFLICT).select("product_id", "thickness_mm", "width_mm")


@query(sql="""SELECT product_id, family_state, coalesce(matched,'') AS matched_elements,
 coalesce(list_aggregate(list_sort(string_split(CASE WHEN family_state='unproven' THEN unknowns END, ',')),'string_agg',','),'') AS unknown_when_unproven
FROM ox_facts""")
def steel_family(t: Tables) -> DataFrame:
    df = cl.steel_family(facts_in_place(t, "composition_pct"))
    return df.select("product_id", "family_state", F.array_join("matched_elements", ",").alias("matched_elements"),
                     F.expr("if(family_state = 'unproven', array_join(array_sort(unknown_elements), ','), '')").alias("unknown_when_unproven"))


@query(sql="SELECT product_id, family, heading FROM ox_hypothesis WHERE family_fact IS NOT NULL AND coated_fact IS NOT NULL AND NOT alternative AND state='branch'")
def tariff_heading(t: Tables) -> DataFrame:
    return staged(t).filter("scope = 'in_scope' and family is not null and coating_state = 'known'").select("product_id", "family", "heading")


@query(sql="""SELECT product_id, rolling, string_agg(heading, ',' ORDER BY heading) AS headings FROM
 (SELECT DISTINCT product_id, rolling, heading FROM ox_hypothesis WHERE state IN ('family_unknown','coating_unknown')) GROUP BY 1,2""")
def heading_candidates(t: Tables) -> DataFrame:
    return cl.scenario_decisions(facts(t), ref.catalog(t.spark)).filter(
        "state in ('family_unknown', 'coating_unknown') and size(headings) > 0").select("product_id", "rolling", LIST("headings"))


@query(sql="""SELECT product_id, CASE WHEN coated IS NULL THEN 'unknown' WHEN NOT coated AND coating_metal <> '' THEN 'conflict' ELSE 'known' END AS coating_state FROM ox_assembled""")
def coating_state(t: Tables) -> DataFrame:
    return cl.coating_state(facts_in_place(t, "coated", "coating_metal")).select("product_id", "coating_state")


def _branch(heading: str):
    name = {"7208": "branch_hot_wide", "7209": "branch_cold_wide", "7210": "branch_coated_wide", "7211": "branch_narrow",
            "7212": "branch_coated_narrow", "7219": "branch_stainless_wide", "7220": "branch_stainless_narrow",
            "7225": "branch_alloy_wide", "7226": "branch_alloy_narrow"}[heading]

    @query(name=name, sql=f"""SELECT product_id, nullif(split_part(rule_text,'|',1),'') AS fraction, nullif(split_part(rule_text,'|',2),'') AS nico,
 split_part(rule_text,'|',3) AS missing, split_part(rule_text,'|',4) AS codes FROM ox_branch WHERE heading='{heading}' AND state='branch' AND NOT alternative""")
    def run(t: Tables) -> DataFrame:
        df = staged(t, cl.branch_facts(heading)).filter((F.col("heading") == heading) & F.expr("scope = 'in_scope' and coating_state = 'known'"))
        return cl.branch_result(df, heading).select(
            "product_id", "branch.fraction", "branch.nico", F.array_join(F.array_sort("branch.missing"), ",").alias("missing"),
            F.array_join("branch.candidates", ",").alias("codes"))


for _heading in ref.FLAT_HEADINGS:
    _branch(_heading)


# ---- the assembled facts themselves (R0) ----
_TEXTS = [n for n in cl.FACT_TYPES if n != "composition_pct"]


@query(sql="SELECT a.product_id, " + ", ".join(f"CAST(a.{n} AS VARCHAR) AS {n}" for n in _TEXTS) + """,
 (SELECT string_agg(element || '=' || coalesce(CAST(percentage AS VARCHAR), '?'), ',' ORDER BY element) FROM ox_chem c WHERE c.product_id = a.product_id) AS composition_pct,
 coalesce((SELECT string_agg(field_path || ':' || scope || ':' || CAST(observation_id AS VARCHAR), ',' ORDER BY field_path) FROM ox_seen o WHERE o.product_id = a.product_id), '') AS overrides,
 coalesce((SELECT string_agg(field_path, ',' ORDER BY field_path) FROM ox_seen o WHERE o.product_id = a.product_id AND value IS NOT NULL AND
  ((field_path = 'width_mm' OR starts_with(field_path, 'composition_pct.')) AND TRY_CAST(value AS DECIMAL(18,8)) IS NULL)), '') AS unreadable
FROM ox_assembled a""")
def assembled_facts(t: Tables) -> DataFrame:
    """All 30 facts of every roll, which observation overrides which field, and values that do not read."""
    df = facts(t)
    elements = F.array_join(F.transform(F.array_sort(F.map_entries("composition_pct")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("?")))), ",")
    overrides = F.array_join(F.array_sort(F.transform(F.map_entries("overrides"), lambda e: F.concat_ws(":", e["key"], e["value"]["scope"], e["value"]["observation_id"].cast("string")))), ",")
    return df.select("product_id", *[F.col(n).cast("string").alias(n) for n in _TEXTS], elements.alias("composition_pct"), overrides.alias("overrides"), LIST("unreadable"))
