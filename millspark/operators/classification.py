"""Tariff classification of rolls.

``scenario_decisions`` is one narrow stage: every roll (twice when its rolling is unknown) gets its scope gate,
steel family, heading, branch result and catalogue check in place, without a shuffle. ``scenario_candidates``
then explodes the candidate codes and ranks them per roll. ``by_roll`` facts are shuffled before that, as a roll is a
fraction of its candidates, and nothing after them. Both look codes up in
the catalogue, a legal nomenclature, as a broadcast table of narrow rows; one with more than ``CATALOG_ROWS`` codes is
joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from millspark.functions import refdata as ref
from millspark.plans import branch_tables as tables
from millspark.plans import nico_tables as nico
from millspark.session import staged

NO_TEXT = "cast(array() as array<string>)"
CATALOG_ROWS = 100_000
COATED_OPTIONS = "if(coated is null, array(false, true), array(coated))"

FACT_TYPES = {
    "form": "string", "coiled": "boolean", "rolling": "string", "width_mm": "decimal(18,6)",
    "thickness_mm": "decimal(18,6)", "composition_pct": "map<string,decimal(18,8)>", "coated": "boolean",
    "coating_metal": "string", "coating_process": "string", "coating_both_sides": "boolean",
    "yield_strength_mpa": "decimal(18,6)", "pickled": "boolean", "pattern_in_relief": "boolean",
    "porcelain_exposed_parts": "boolean", "pipeline_steel": "boolean", "high_speed_steel": "boolean",
    "tool_steel": "boolean", "grain_oriented": "boolean", "magnetic_silicon": "boolean", "stainless_series": "string",
    "rolled_four_faces": "boolean", "clad": "boolean", "temper": "string", "magnetic_loss_w_per_kg": "decimal(18,6)",
    "magnetic_induction_tesla": "decimal(18,6)", "secondary_reduction_ratio": "decimal(18,6)",
    "can_body_end_use": "boolean", "deep_drawing_class": "string", "cladding_weight_percentage": "decimal(18,6)",
}

GATE_FACTS = ("form", "width_mm", "thickness_mm", "coiled", "rolling", "coated", "coating_metal", "composition_pct")


def complete_facts(facts: DataFrame) -> DataFrame:
    """The 30 facts with their exact types; a fact the input lacks is unknown."""
    return facts.select(*[c for c in facts.columns if c not in FACT_TYPES], *[
        (F.col(name) if name in facts.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in FACT_TYPES.items()])


def by_roll(facts: DataFrame) -> DataFrame:
    """The facts, together by roll: candidates that come from them are ranked and merged without a further shuffle."""
    return facts.repartition("product_id")


def with_short_names(facts: DataFrame) -> DataFrame:
    """Adds the names the tables use, of those facts that there are."""
    return facts.select("*", *[F.expr(text).alias(name) for name, text in tables.SHORT_NAMES.items() if tables.fact_of(text) in facts.columns])


# ---- scope and geometry (R1, R2) -------------------------------------------------------------------------

MISSING_PHYSICAL = ("array_compact(array(if(width_mm is null, 'width_mm', null), if(thickness_mm is null, 'thickness_mm', null), "
                    "if(coiled is null, 'coiled', null), if(rolling is null, 'rolling', null)))")
GEOMETRY_CONFLICT = ("coalesce(not coiled and ((thickness_mm < 4.75 and width_mm < 10 * thickness_mm) or (thickness_mm >= 4.75 "
                     "and (width_mm <= 150 or 2 * thickness_mm > width_mm))), false)")


def scope_gate(facts: DataFrame) -> DataFrame:
    """Adds ``scope``: out_of_scope, missing_physical, rolling_only, geometry_conflict or in_scope."""
    return facts.withColumn("missing_physical", F.expr(MISSING_PHYSICAL)).withColumn("scope", F.expr(f"""
        case when coalesce(form, '') <> 'flat_rolled' then 'out_of_scope'
             when missing_physical = array('rolling') then 'rolling_only'
             when size(missing_physical) > 0 then 'missing_physical'
             when {GEOMETRY_CONFLICT} then 'geometry_conflict' else 'in_scope' end"""))


# ---- steel family (R3) -----------------------------------------------------------------------------------

def _alloy_matches() -> str:
    """Elements that reach their threshold, in legal order, then any other element of at least 0.1 percent."""
    parts = []
    for element, threshold in ref.ALLOY_THRESHOLDS:
        if element == "Al_total":
            parts.append(f"case when composition_pct['Al_total'] >= {threshold} then 'Al_total' when composition_pct['Al_total'] is null "
                         f"and composition_pct['Al_soluble'] >= {threshold} then 'Al_soluble' end")
        else:
            parts.append(f"if(composition_pct['{element}'] >= {threshold}, '{element}', null)")
    known = ", ".join(f"'{e}'" for e in [e for e, _ in ref.ALLOY_THRESHOLDS] + list(ref.NEUTRAL_ELEMENTS))
    return (f"concat(array_compact(array({', '.join(parts)})), coalesce(map_keys(map_filter(composition_pct, "
            f"(k, v) -> k not in ({known}) and v >= {ref.OTHER_ELEMENT_MINIMUM})), {NO_TEXT}))")


def _alloy_unknowns() -> str:
    parts = []
    for element, threshold in ref.ALLOY_THRESHOLDS:
        soluble = f" and coalesce(composition_pct['Al_soluble'] < {threshold}, true)" if element == "Al_total" else ""
        parts.append(f"if(composition_pct['{element}'] is null{soluble}, '{element}', null)")
    return f"array_compact(array({', '.join(parts)}))"


def steel_family(facts: DataFrame) -> DataFrame:
    """Adds family (null unless proven), family_state, matched/unknown elements, missing facts, possible families."""
    df = facts.withColumns({"matched_elements": F.expr(_alloy_matches()), "unknown_elements": F.expr(_alloy_unknowns())})
    df = df.withColumn("family_state", F.expr("""
        case when composition_pct['C'] > 2 then 'exception'
             when composition_pct['C'] <= 1.2 and composition_pct['Cr'] >= 10.5 then 'stainless'
             when size(matched_elements) > 0 and composition_pct['C'] is not null and composition_pct['Cr'] is not null then 'other_alloy'
             when size(matched_elements) > 0 then 'ambiguous'
             when size(unknown_elements) > 0 then 'unproven'
             when composition_pct['C'] is null then 'carbon_missing'
             else 'non_alloy' end"""))
    no_base = ("array_compact(array(if(composition_pct['C'] is null, 'composition_pct.C', null), "
               "if(composition_pct['Cr'] is null, 'composition_pct.Cr', null)))")
    return df.withColumns({
        "family": F.expr("if(family_state in ('stainless', 'other_alloy', 'non_alloy'), family_state, null)"),
        "family_missing": F.expr(f"""case family_state when 'exception' then array('steel_definition_exception')
            when 'ambiguous' then {no_base} when 'carbon_missing' then {no_base}
            when 'unproven' then array_distinct(concat({no_base}, transform(unknown_elements, e -> concat('composition_pct.', e))))
            else {NO_TEXT} end"""),
        "family_candidates": F.expr(f"""case family_state
            when 'exception' then array('pig_iron', 'ferroalloy', 'chromium_steel_exception')
            when 'ambiguous' then array('stainless', 'other_alloy')
            when 'unproven' then if(composition_pct['C'] is null or composition_pct['Cr'] is null,
                array('non_alloy', 'stainless', 'other_alloy'), array('non_alloy', 'other_alloy'))
            when 'carbon_missing' then array('non_alloy') else {NO_TEXT} end"""),
    })


# ---- heading and branch (R4 to R7) -----------------------------------------------------------------------

def heading(df: DataFrame) -> DataFrame:
    """Adds ``heading`` for a proven family and a known coating state; needs the short names."""
    return df.withColumn("heading", F.expr(tables.heading_case()))


def heading_candidates(df: DataFrame) -> DataFrame:
    """Adds ``headings``: every heading the possible families and coating states allow, in order."""
    return df.withColumn("headings", F.expr(f"""array_distinct(array_compact(flatten(transform(
        if(family is null, family_candidates, array(family)),
        f -> transform({COATED_OPTIONS}, k -> {tables.heading_case('f', 'k')})))))"""))


def coating_state(df: DataFrame) -> DataFrame:
    """Adds ``coating_state``: unknown, conflict (uncoated but with a metal) or known."""
    return df.withColumn("coating_state", F.expr(
        "case when coated is null then 'unknown' when not coated and coating_metal <> '' then 'conflict' else 'known' end"))


def branch_facts(heading: str) -> list[str]:
    """The facts that decide a roll of one heading: those of scope, family, coating and heading, and those its branch names."""
    named = tables.names_of(heading)
    return [*GATE_FACTS, *(name for name in FACT_TYPES if name in named and name not in GATE_FACTS)]


def branch_result(df: DataFrame, heading: str | None = None) -> DataFrame:
    """Adds ``branch``, the decision-table result of the row's heading, or of the one heading that all rows have."""
    return df.withColumn("branch", F.expr(tables.as_lambda(tables.branch_case(heading) if heading else tables.decision_case())))


# ---- NICO conditions (R8) --------------------------------------------------------------------------------

# The facts that conditions read.
NICO_FACTS = ("composition_pct", "thickness_mm", "width_mm", "yield_strength_mpa", "coiled", "tool_steel", "high_speed_steel", "pattern_in_relief", "coating_both_sides",
              "porcelain_exposed_parts", "stainless_series", "rolling", "coated")


def evaluate_nico(facts: DataFrame, conditions: DataFrame) -> DataFrame:
    """Relational twin: one row per (roll, fraction, nico) with its outcome, from the condition table.

    The conditions, a fixed table, go to every roll as one row of tests per code, so a roll is judged in place.
    """
    fields, numeric = nico.FIELD_VALUES, F.col("field").isin(*nico.NUMERIC)
    at = lambda names: (F.array_position(F.array(*map(F.lit, names)), F.col("field")) - 1).cast("int").alias("at")
    # Which results of a comparison fail; an operator that is none of the four compares for equality.
    fails = [(~F.coalesce(F.col("op").isin(*ops), F.lit(False))).alias(name) for name, ops in (("below", ("<", "<=")), ("above", (">", ">=")))]
    fails.append(F.coalesce(F.col("op").isin("<", ">"), F.lit(False)).alias("equal"))
    measure = F.struct(at(nico.NUMERIC), F.expr(f"if(field in ({nico.NUMERIC_FIELDS}), cast(value as decimal(18,8)), null)").alias("number"), *fails)
    text = F.struct(at(fields), "value", (F.col("op") == "=").alias("plain"))
    codes = conditions.filter(F.col("field").isin(*fields)).groupBy("fraction", "nico").agg(
        F.collect_list(F.when(numeric, measure)).alias("measures"), F.collect_list(F.when(~numeric, text)).alias("texts"))
    known = F.array(*[F.expr(f"cast({source} as string)") for source in fields.values()])
    measured = F.array(*[F.expr(f"cast({fields[name]} as decimal(18,8))") for name in nico.NUMERIC])
    rolls = with_short_names(facts).select("product_id", known.alias("known"), measured.alias("measured"))
    # True: one fails; null: none fails, but one is unknown.
    outcome = F.expr("""case exists(measures, x -> if(get(measured, x.at) < x.number, x.below, if(get(measured, x.at) = x.number, x.equal, if(get(measured, x.at) > x.number, x.above, null))))
        or exists(texts, x -> if(x.plain, get(known, x.at) <> x.value, true)) when true then 'conflict' when false then 'matched' else 'unknown' end""")
    return rolls.join(F.broadcast(codes)).select("product_id", "fraction", "nico", outcome.alias("outcome"))


def residual_nico(evaluated: DataFrame, facts: DataFrame) -> DataFrame:
    """Residual NICOs ("others"): matched only when every specific NICO of the fraction conflicts.

    The outcomes of a roll are counted once, before the one shuffle.
    """
    specific = tuple(f"{i:02d}" for i in range(1, 12))
    groups = {"nine": ("72255091", specific), "91": ("72255091", ("91",)), "92": ("72255091", ("92",)), "zinc": ("72104999", ("01", "02")), "wide": ("72191202", ("01",))}
    inside = lambda fraction, codes: (F.col("fraction") == fraction) & F.col("nico").isin(*codes)
    count = lambda name, test: F.count_if(inside(*groups[name]) & test)
    states = ("matched", "unknown", "conflict")
    seen = evaluated.filter(F.col("fraction").isin(*{f for f, _ in groups.values()})).groupBy("product_id").agg(
        *[count(name, F.col("outcome") == state).alias(f"{name}_{state}") for name in groups for state in states],
        *[count(name, F.lit(True)).alias(f"{name}_n") for name in groups])
    nine = lambda base: f"case when nine_n + `{base}_n` = 0 then null when `{base}_conflict` > 0 or nine_matched > 0 then 'conflict' when `{base}_unknown` > 0 or nine_unknown > 0 then 'unknown' else 'matched' end"
    plain = lambda name: f"case when {name}_matched > 0 then 'conflict' when {name}_unknown > 0 then 'unknown' else 'matched' end"
    row = lambda known, fraction, code, outcome: f"if({known} > 0, named_struct('fraction', '{fraction}', 'nico', '{code}', 'outcome', {outcome}), null)"
    seen = seen.withColumns({f"nine_{base}": F.expr(nine(base)) for base in ("91", "92")})
    last = "case when nine_matched > 0 or 'matched' in (nine_91, nine_92) then 'conflict' when nine_unknown > 0 or 'unknown' in (nine_91, nine_92) then 'unknown' else 'matched' end"
    rows = [row(f"nine_n + `{base}_n`", "72255091", base, f"nine_{base}") for base in ("91", "92")]
    rows += [row("nine_n + `91_n` + `92_n`", "72255091", "99", last), row("zinc_n", "72104999", "99", plain("zinc")), row("wide_n", "72191202", "99", plain("wide"))]
    others = seen.select("product_id", F.expr(f"inline(array_compact(array({', '.join(rows)})))"))
    series = facts.select("product_id", F.explode(F.array(*[F.lit(f) for f in nico.SERIES_FRACTIONS])).alias("fraction"), F.lit("99").alias("nico"),
                          F.expr("case when stainless_series is null then 'unknown' when stainless_series in ('200', '300', '400') then 'conflict' else 'matched' end").alias("outcome"))
    return others.unionByName(series)


def assess_codes(df: DataFrame) -> DataFrame:
    """Expression twin: adds ``assessment`` for the row's (fraction, nico); null when no condition is recorded."""
    return df.withColumn("assessment", F.expr(tables.as_lambda(nico.assessment_case("fraction", "nico"))))


def assess_every(rolls: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Every roll with every given (fraction, nico), in place: each pair has its own expression, none is looked up per roll."""
    known = nico.assessments()
    codes = [F.struct(F.lit(f).alias("fraction"), F.lit(n).alias("nico"), F.expr(known.get((f, n), "cast(null as string)")).alias("assessment")) for f, n in pairs]
    return rolls.select("product_id", F.inline(F.array(*codes)))


# ---- catalogue lookups -----------------------------------------------------------------------------------

def catalog_counts(catalog: DataFrame) -> DataFrame:
    """Per code: how many fraction and NICO entries carry it."""
    return looked_up(catalog.groupBy("code").agg(
        F.count_if(F.col("kind") == "fraction").alias("n_fraction"), F.count_if(F.col("kind") == "nico").alias("n_nico")), catalog)


def catalog_nicos(catalog: DataFrame) -> DataFrame:
    """NICO entries of each fraction with their place in the fraction."""
    entries = catalog.filter("kind = 'nico' and fraction is not null").select(
        F.col("fraction").alias("entry_fraction"), F.coalesce("nico", F.expr("right(code, 2)")).alias("entry_nico"))
    place = Window.partitionBy("entry_fraction").orderBy("entry_nico")
    return looked_up(entries.withColumn("place", F.row_number().over(place)), catalog)


def looked_up(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Broadcast rows derived from a catalogue if a count proves it small; rolls without a code then never meet in one task."""
    return F.broadcast(df) if catalog.limit(CATALOG_ROWS + 1).count() <= CATALOG_ROWS else df


# ---- one decision per roll and rolling scenario -----------------------------------------------------------

def scenario_decisions(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per roll and rolling scenario (two when only the rolling is unknown). No shuffle."""
    df = steel_family(scope_gate(complete_facts(facts)))
    df = df.withColumn("alternative", F.col("scope") == "rolling_only")
    df = df.withColumn("rolling", F.explode(F.expr("if(alternative, array('cold', 'hot'), array(rolling))")))
    df = with_short_names(df)
    df = coating_state(heading(df))
    df = df.withColumn("state", F.expr(f"""
        case when scope in ('out_of_scope', 'missing_physical') then scope
             when scope = 'geometry_conflict' or {GEOMETRY_CONFLICT} then 'geometry_conflict'
             when family is null then 'family_unknown'
             when coating_state = 'unknown' then 'coating_unknown'
             when coating_state = 'conflict' then 'coating_conflict' else 'branch' end"""))
    df = heading_candidates(df)
    df = df.withColumn("branch", F.expr(f"if(state = 'branch', {tables.as_lambda(tables.decision_case())}, null)"))
    df = df.withColumns({"fraction": F.col("branch.fraction"), "branch_nico": F.col("branch.nico")})
    df = df.withColumn("branch_assessment", F.expr(tables.as_lambda(nico.assessment_case("fraction", "branch_nico"))))
    df = df.withColumn("nico_doubt", F.expr("coalesce(branch_assessment in ('unknown', 'conflict'), false)"))
    df = df.withColumn("nico_kept", F.expr("if(nico_doubt, null, branch_nico)"))
    counts = catalog_counts(catalog)
    by_fraction = counts.select(F.col("code").alias("fraction"), "n_fraction")
    by_code = counts.select(F.col("code").alias("full_code"), "n_nico")
    df = df.join(by_fraction, "fraction", "left").withColumn("full_code", F.concat("fraction", "nico_kept")).join(
        by_code, "full_code", "left")
    df = df.withColumn("catalog_doubt", F.expr(
        "fraction is not null and (coalesce(n_fraction, 0) <> 1 or (nico_kept is not null and coalesce(n_nico, 0) <> 1))"))
    df = df.withColumns({
        "nico": F.expr("if(catalog_doubt, null, nico_kept)"),
        "missing": F.expr(f"""array_sort(array_distinct(case state
            when 'out_of_scope' then {NO_TEXT}
            when 'missing_physical' then missing_physical
            when 'geometry_conflict' then array('flat_rolled_definition')
            when 'family_unknown' then concat(family_missing, if(coated is null, array('coated'), {NO_TEXT}))
            when 'coating_unknown' then array('coated')
            when 'coating_conflict' then array('coating_state_conflict')
            else concat(branch.missing, if(nico_doubt, array('nico_qualifier'), {NO_TEXT}),
                        if(catalog_doubt, array('source_catalog_resolution'), {NO_TEXT})) end))"""),
        "raw_candidates": F.expr(f"""case when state in ('family_unknown', 'coating_unknown') then headings
            when state = 'branch' then array_distinct(concat(if(nico_doubt, array(fraction), branch.candidates),
                                                             if(catalog_doubt, array(fraction), {NO_TEXT})))
            else {NO_TEXT} end"""),
        "product_type": F.expr("""case when state = 'out_of_scope' then null
            when state in ('missing_physical', 'geometry_conflict', 'family_unknown') then 'flat_rolled'
            else concat('flat_rolled_', family) end"""),
    })
    return df.withColumn("outcome", F.expr("""case when state = 'out_of_scope' then 'out_of_scope'
        when fraction is not null and nico is not null and size(missing) = 0 then 'classified' else 'needs_review' end"""))


# ---- candidates (R9, W8, T4) -----------------------------------------------------------------------------

def _expanded_codes() -> str:
    """Raw candidates followed by what each four-digit heading expands to under its possible hypotheses."""
    families = "array(" + ", ".join(f"'{f}'" for f in ref.FAMILIES) + ")"
    codes = ("transform(array(" + tables.decision_case("h", "k") + "), b -> concat(if(b.fraction is null, " + NO_TEXT
             + ", array(concat(b.fraction, coalesce(b.nico, '')))), filter(b.candidates, x -> length(x) in (8, 10))))[0]")
    return f"""concat(raw_candidates, flatten(transform(filter(raw_candidates, x -> length(x) = 4), h -> flatten(transform({families},
        f -> flatten(transform({COATED_OPTIONS}, k -> if({tables.heading_case('f', 'k')} = h, {codes}, {NO_TEXT}))))))))"""


CARRIED = ("outcome", "missing", "state", "alternative", "cited", "composition_pct", "matched_elements", "zinc_exception", "sides_classified", "all_missing")

# The facts that factors cite, and their texts; only the facts are moved.
CITED = "struct(" + ", ".join(f"{text} as f{i}" for i, text in enumerate(nico.FIELD_VALUES.values())) + ")"
SHOWN = "map(" + ", ".join(f"'{name}', cast(cited.f{i} as string)" for i, name in enumerate(nico.FIELD_VALUES)) + ")"
ZINC_EXCEPTION = ("coalesce(coated and coating_metal = 'Zn' and coating_process = 'electrolytic' "
                  "and exists(map_values(composition_pct), v -> v is not null), false)")


def scenario_candidates(decisions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every candidate pair with its fate: ranked (with rank and support) or a discard reason.

    Pairs of a roll are few (the codes of at most six hypotheses), so the windows below are keyed by roll; decisions over
    ``by_roll`` facts need no shuffle for them. The windows name ``alternative``, so that a filter on it reaches the facts.
    """
    # What the scenarios of a roll say together; dropped where no alternative is asked for.
    both = Window.partitionBy("product_id", "alternative")
    df = decisions.withColumns({
        "sides_classified": F.count_if(F.expr("outcome = 'classified' and size(missing) = 0")).over(both),
        "all_missing": F.array_sort(F.array_union(F.array(F.lit("rolling")), F.array_distinct(F.flatten(F.collect_list("missing").over(both)))))})
    df = df.withColumns({"cited": F.expr(CITED), "zinc_exception": F.expr(ZINC_EXCEPTION),
                                "result_fraction": F.col("fraction"), "result_nico": F.col("nico")})
    df = df.withColumn("codes", F.expr(
        f"concat(if(fraction is not null and nico is not null, array(concat(fraction, nico)), array('')), {_expanded_codes()})"))
    df = df.drop("fraction", "nico").select("*", F.posexplode_outer("codes").alias("raw_index", "code")).filter("code <> ''")
    # Position 0 is the resolved pair; the raw list starts at 1.
    df = df.withColumn("raw_index", F.col("raw_index") - 1)
    df = df.join(catalog_nicos(catalog), F.expr("length(code) = 8 and code = entry_fraction"), "left").filter(
        "(length(code) = 8 and entry_nico is not null) or length(code) = 10 or (length(code) = 2 and result_fraction is not null)")
    df = df.withColumns({
        "fraction": F.expr("if(length(code) = 2, result_fraction, left(code, 8))"),
        "nico": F.expr("case length(code) when 2 then code when 8 then entry_nico else right(code, 2) end"),
        "place": F.coalesce("place", F.lit(0)),
    })
    df = assess_codes(df)
    df = df.withColumns({"compatible": F.expr(tables.as_lambda(nico.COMPATIBLE)), "qualifier": F.expr(tables.as_lambda(nico.QUALIFIER_PRIORITY))})
    df = df.withColumn("priority", F.expr("""case when raw_index < 0 then -100 when length(code) = 10 then raw_index
        when length(code) = 8 then raw_index * 100 + qualifier else raw_index + qualifier end"""))
    counts = catalog_counts(catalog)
    df = df.join(counts.select(F.col("code").alias("fraction"), "n_fraction").withColumnRenamed("n_fraction", "n_f"), "fraction", "left")
    df = df.withColumn("pair_code", F.concat("fraction", "nico")).join(
        counts.select(F.col("code").alias("pair_code"), F.col("n_nico").alias("n_n")), "pair_code", "left")
    df = df.select("product_id", F.col("rolling").alias("scenario"), *CARRIED, "fraction", "nico", "assessment", "priority", "raw_index", "place",
                   F.expr("""case when not compatible then 'known_facts_conflict'
                       when coalesce(n_f, 0) <> 1 or coalesce(n_n, 0) <> 1 then 'source_catalog_invalid' end""").alias("rejection"),
                   F.expr("if(raw_index < 0 and size(missing) = 0, 'fully_supported', 'conditional')").alias("support_level"))
    order = [F.col("priority"), F.col("raw_index"), F.col("place")]
    same = Window.partitionBy("product_id", "alternative", "scenario", "rejection", "fraction", "nico").orderBy(*order)
    df = df.withColumn("occurrence", F.row_number().over(same)).filter("rejection is not null or occurrence = 1")
    roll = Window.partitionBy("product_id", "alternative", "scenario", F.col("rejection").isNull()).orderBy(*order)
    df = df.withColumn("rank", F.expr("if(rejection is null, 1, null)") * F.row_number().over(roll))
    df = df.withColumn("fate", F.expr("coalesce(rejection, if(rank <= 3, 'ranked', 'outside_top_three'))"))
    df = df.withColumn("nico_outcome", F.expr("coalesce(assessment, if(support_level = 'fully_supported', 'matched', 'unknown'))"))
    fields = F.expr(tables.as_lambda(nico.observed_fields_case("fraction", "nico")))
    df = df.withColumns({"nico_fields": fields, "shown": F.expr(SHOWN)}).drop("cited")
    return df.withColumn("candidate_missing", F.expr(f"""if(support_level = 'fully_supported', {NO_TEXT}, array_sort(array_union(missing,
        if(nico_outcome = 'unknown', concat(array('nico_qualifier'), filter(nico_fields, x -> shown[x] is null)), {NO_TEXT}))))"""))


# ---- unknown rolling (R10) -------------------------------------------------------------------------------

def rolling_alternatives(pairs: DataFrame) -> DataFrame:
    """Candidates of rolls whose only unknown is the rolling: offered when both scenarios stand on their own."""
    roll = Window.partitionBy("product_id")
    ranked = pairs.filter("alternative and fate = 'ranked'").withColumns({
        "n_cold": F.count_if(F.col("scenario") == "cold").over(roll), "n_hot": F.count_if(F.col("scenario") == "hot").over(roll),
        "n_unproven": F.count_if(F.col("nico_outcome") != "matched").over(roll)})
    first = F.struct((F.col("scenario") == "hot").cast("int").alias("side"), "rank")
    same = [F.first(c).alias(c) for c in ("n_cold", "n_hot", "n_unproven", "sides_classified", "all_missing")]
    df = ranked.groupBy("product_id", "fraction", "nico").agg(
        F.min(first).alias("first"), F.array_sort(F.collect_set("scenario")).alias("scenarios"), *same,
        F.min_by(F.struct("candidate_missing", "nico_fields", "nico_outcome", "shown", "composition_pct", "matched_elements",
                          "zinc_exception", "support_level"), first).alias("best"))
    df = df.withColumn("eligible", F.expr("sides_classified = 2 and n_cold = 1 and n_hot = 1 and n_unproven = 0"))
    df = df.withColumn("zinc", F.expr(
        "best.zinc_exception and forall(all_missing, x -> x = 'rolling' or startswith(x, 'composition_pct.'))"))
    df = df.filter("eligible or (zinc and size(scenarios) = 2)")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("product_id").orderBy("first"))).select(
        "product_id", "rank", "fraction", "nico", F.lit("conditional").alias("support_level"),
        F.expr("array_sort(array_union(all_missing, best.candidate_missing))").alias("candidate_missing"),
        F.col("best.nico_outcome").alias("nico_outcome"), F.col("best.nico_fields").alias("nico_fields"),
        F.col("best.shown").alias("shown"), F.col("best.composition_pct").alias("composition_pct"),
        F.col("best.matched_elements").alias("matched_elements"), "scenarios",
        F.expr("if(eligible, null, filter(all_missing, x -> startswith(x, 'composition_pct.')))").alias("family_doubt"))


def ranked_candidates(pairs: DataFrame) -> DataFrame:
    plain = pairs.filter("not alternative and fate = 'ranked'").select(
        "product_id", "rank", "fraction", "nico", "support_level", "candidate_missing", "nico_outcome", "nico_fields", "shown",
        "composition_pct", "matched_elements", F.lit(None).cast("array<string>").alias("scenarios"),
        F.lit(None).cast("array<string>").alias("family_doubt"))
    return plain.unionByName(rolling_alternatives(pairs))


def discarded_candidates(pairs: DataFrame) -> DataFrame:
    return pairs.filter("not alternative and fate <> 'ranked'").select("product_id", "fraction", "nico", F.col("fate").alias("reason_code"))


# ---- results, steps and factors (R11 to R13) ---------------------------------------------------------------

def results(decisions: DataFrame) -> DataFrame:
    """One row per roll. Rolls with two scenarios (a two-row group) always need review.

    The few result columns are written once, as both branches below read them.
    """
    decisions = staged(decisions.select("product_id", "alternative", "outcome", "product_type", "fraction", "nico", "missing", "state"))
    plain = decisions.filter("not alternative").select("product_id", "outcome", "product_type", "fraction", "nico", "missing", "state")
    both = decisions.filter("alternative").groupBy("product_id").agg(
        F.array_sort(F.array_union(F.array(F.lit("rolling")), F.array_distinct(F.flatten(F.collect_list("missing"))))).alias("missing"))
    both = both.select("product_id", F.lit("needs_review").alias("outcome"), F.lit("flat_rolled").alias("product_type"),
                       F.lit(None).cast("string").alias("fraction"), F.lit(None).cast("string").alias("nico"), "missing",
                       F.lit("rolling_unknown").alias("state"))
    return plain.unionByName(both)


def override_with_quality(results_df: DataFrame, blocked_products: DataFrame) -> DataFrame:
    """A roll with a blocking quality issue needs review whatever the rules say."""
    flagged = blocked_products.select("product_id").distinct().withColumn("blocked", F.lit(True))
    return results_df.join(flagged, "product_id", "left").withColumn(
        "outcome", F.expr("if(blocked, 'needs_review', outcome)")).drop("blocked")


def decision_steps(decisions: DataFrame) -> DataFrame:
    """Ordered rule trace of each roll: sequence, rule_code, outcome, inputs and evidence fields."""
    def step(condition: str, rule: str, outcome: str, evidence: str = "", inputs: str = "") -> str:
        fields = ", ".join(f"'{f}'" for f in evidence.split())
        return (f"if({condition}, named_struct('rule_code', '{rule}', 'outcome', {outcome}, 'inputs', "
                f"{'map(' + inputs + ')' if inputs else 'cast(map() as map<string,string>)'}, "
                f"'evidence_fields', {'array(' + fields + ')' if fields else NO_TEXT}), null)")

    text = lambda name: f"'{name}', cast({name} as string)"
    past_gate = "state in ('family_unknown', 'coating_unknown', 'coating_conflict', 'branch')"
    steps = [
        step("state = 'out_of_scope'", "chapter72.form.flat_rolled", "'not_matched'", "form", text("form")),
        step("state = 'missing_physical'", "chapter72.flat_rolled.required_dimensions", "'missing'", "", "'missing', array_join(array_sort(missing_physical), ',')"),
        step("state = 'geometry_conflict'", "chapter72.flat_rolled.definition", "'conflict'", "width_mm thickness_mm coiled"),
        step(f"{past_gate} and family_state = 'exception'", "chapter72.definition.steel", "'ambiguous'",
             "composition_pct.C composition_pct.Cr", "'C', cast(c as string), 'Cr', cast(composition_pct['Cr'] as string)"),
        step(f"{past_gate} and family_state <> 'exception' and c is not null and composition_pct['Cr'] is not null",
             "chapter72.definition.stainless", "if(family = 'stainless', 'matched', 'not_matched')",
             "composition_pct.C composition_pct.Cr", "'C', cast(c as string), 'Cr', cast(composition_pct['Cr'] as string)"),
        step(f"{past_gate} and family_state = 'other_alloy'", "chapter72.definition.other_alloy", "'matched'", "", "'matched_elements', array_join(matched_elements, ',')"),
        step(f"{past_gate} and family_state = 'ambiguous'", "chapter72.definition.steel_family", "'ambiguous'", "",
             "'matched_elements', array_join(matched_elements, ','), 'missing', array_join(array_sort(family_missing), ',')"),
        step(f"{past_gate} and family_state = 'unproven'", "chapter72.definition.non_alloy", "'missing'", "", "'missing_elements', array_join(unknown_elements, ',')"),
        step(f"{past_gate} and family_state = 'non_alloy'", "chapter72.definition.non_alloy", "'matched'"),
        step("state = 'coating_unknown'", "chapter72.flat_rolled.coating_state", "'missing'", "coated"),
        step("state = 'coating_conflict'", "chapter72.flat_rolled.coating_state", "'ambiguous'", "coated coating.metal", "'coating_metal', coating_metal"),
        step("state = 'branch'", "chapter72.flat_rolled.heading", "if(heading is null, 'ambiguous', 'matched')", "width_mm rolling coated coiled",
             ", ".join(text(n) for n in ("family", "width_mm", "rolling", "coated", "coiled"))),
        step("state = 'branch' and array_contains(branch.missing, 'ambiguous_source_code_7219_35_02')",
             "chapter72.stainless.source_anomaly_7219_35_02", "'ambiguous'", "thickness_mm", f"{text('fraction')}, {text('thickness_mm')}"),
        step("state = 'branch' and fraction is not null", "chapter72.classification.result", "if(nico_kept is null, 'missing', 'matched')",
             "thickness_mm", f"{text('fraction')}, 'nico', nico_kept, {text('thickness_mm')}"),
        step("catalog_doubt", "chapter72.source_catalog.validation", "'ambiguous'", "", f"{text('fraction')}, 'nico', nico_kept"),
    ]
    plain = decisions.filter("not alternative").select(
        "product_id", F.posexplode(F.expr(f"array_compact(array({', '.join(steps)}))")).alias("at", "step"),
        "matched_elements", "fraction")
    elements = F.expr("""case when step.rule_code in ('chapter72.definition.other_alloy', 'chapter72.definition.steel_family')
        then transform(matched_elements, e -> concat('composition_pct.', e))
        when step.rule_code = 'chapter72.classification.result' then """ + nico.RESULT_EVIDENCE + " else step.evidence_fields end")
    plain = plain.select("product_id", (F.col("at") + 1).alias("sequence"), "step.rule_code", "step.outcome", "step.inputs",
                         elements.alias("evidence_fields"))
    open_rolling = decisions.filter("alternative").groupBy("product_id").agg(
        F.array_join(F.array_sort(F.array_union(F.array(F.lit("rolling")), F.array_distinct(F.flatten(F.collect_list("missing"))))), ",").alias("m"))
    open_rolling = open_rolling.select(
        "product_id", F.lit(1).alias("sequence"), F.lit("chapter72.flat_rolled.rolling_confirmation").alias("rule_code"),
        F.lit("missing").alias("outcome"), F.create_map(F.lit("missing"), F.col("m")).alias("inputs"), F.array(F.lit("rolling")).alias("evidence_fields"))
    return plain.unionByName(open_rolling)


def candidate_factors(candidates: DataFrame) -> DataFrame:
    """Explanatory factors of each ranked candidate: family, fraction, NICO and open confirmations."""
    thresholds = "map(" + ", ".join(f"'{e}', '{v}'" for e, v in ref.ALLOY_THRESHOLDS) + ", 'Al_soluble', '0.3')"
    sample = "filter(array('B', 'Cr', 'Ni', 'Mo', 'Ti'), e -> map_contains_key(composition_pct, e))"
    values = "map_from_arrays({0}, transform({0}, e -> cast(composition_pct[e] as string)))"
    limits = "map_from_arrays({0}, transform({0}, e -> coalesce(" + thresholds + "[e], '0.1')))"

    def factor(condition: str, rule: str, outcome: str, operator: str, expected: str, observed: str, evidence: str) -> str:
        return (f"if({condition}, named_struct('rule_code', {rule}, 'outcome', {outcome}, 'operator', {operator}, 'expected', {expected}, "
                f"'observed', {observed}, 'evidence_fields', {evidence}), null)")

    observed_shape = "map_from_arrays({0}, transform({0}, x -> if(scenarios is not null and x = 'rolling', null, shown[x])))"
    shape = "array('width_mm', 'thickness_mm', 'rolling', 'coiled', 'coated')"
    factors = [
        factor("left(fraction, 4) in ('7225', '7226') and size(matched_elements) > 0", "'chapter72.definition.other_alloy'", "'matched'", "'>='",
               limits.format("matched_elements"), values.format("matched_elements"), "transform(matched_elements, e -> concat('composition_pct.', e))"),
        factor("left(fraction, 4) in ('7219', '7220') and composition_pct['Cr'] >= 10.5", "'chapter72.definition.stainless_steel'", "'matched'", "'>='",
               "map('Cr', '10.5', 'C', '1.2')", values.format("array('Cr', 'C')"), "array('composition_pct.Cr', 'composition_pct.C')"),
        factor(f"left(fraction, 4) in ('7208', '7209', '7210', '7211', '7212') and size(matched_elements) = 0 and size({sample}) > 0",
               "'chapter72.definition.non_alloy'", "'matched'", "'<'", limits.format(sample), values.format(sample),
               f"transform({sample}, e -> concat('composition_pct.', e))"),
        factor("true", "concat('chapter72.fraction.', fraction)", "'matched'", "'all'", "map('fraction', fraction)", observed_shape.format(shape), shape),
        factor("true", "concat('chapter72.nico.', fraction, '.', nico)", "nico_outcome", "'catalog_qualifier'",
               tables.as_lambda(nico.expectation_case("fraction", "nico")), "map_from_arrays(nico_fields, transform(nico_fields, x -> shown[x]))",
               "transform(nico_fields, x -> if(x = 'yield_strength_mpa', 'mechanical_properties.yield_strength_mpa', x))"),
        factor("family_doubt is not null", "'chapter72.definition.steel_family_confirmation'", "'unknown'", "cast(null as string)",
               "map('family', if(left(fraction, 4) = '7210', 'non_alloy', 'other_alloy'))",
               "map_from_arrays(family_doubt, transform(family_doubt, x -> cast(null as string)))", "family_doubt"),
        factor("scenarios is not null", "'chapter72.flat_rolled.rolling_confirmation'", "'unknown'", "'in'",
               "map('rolling', array_join(scenarios, ','))", "map('rolling', cast(null as string))", "array('rolling')"),
    ]
    return candidates.select("product_id", "rank", F.posexplode(F.expr(f"array_compact(array({', '.join(factors)}))")).alias("at", "factor")).select(
        "product_id", "rank", (F.col("at") + 1).alias("sequence"), "factor.*")


def classify(facts: DataFrame, catalog: DataFrame) -> dict[str, DataFrame]:
    """results, candidates, discarded, steps and factors of every roll."""
    decisions = scenario_decisions(facts, catalog)
    pairs = scenario_candidates(scenario_decisions(by_roll(facts), catalog), catalog)
    candidates = ranked_candidates(pairs)
    return {
        "results": results(decisions),
        "candidates": candidates.select("product_id", "rank", "fraction", "nico", "support_level", F.col("candidate_missing").alias("missing_fields")),
        "discarded": discarded_candidates(pairs),
        "steps": decision_steps(decisions),
        "factors": candidate_factors(candidates),
    }
