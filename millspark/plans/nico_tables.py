"""NICO conditions as SQL expressions over the facts (three-valued: true, false, or null for unknown)."""

from __future__ import annotations

from collections import defaultdict

from millspark.functions import refdata as ref

# Where each condition field lives; a field without a column is never known.
FIELD_VALUES = {
    "composition_pct.B": "boron", "composition_pct.C": "c", "thickness_mm": "thickness_mm", "width_mm": "width_mm",
    "mechanical_properties.yield_strength_mpa": "yield_strength_mpa", "yield_strength_mpa": "yield_strength_mpa",
    "coiled": "coiled", "tool_steel": "tool_steel", "high_speed_steel": "high_speed_steel",
    "pattern_in_relief": "pattern_in_relief", "coating_both_sides": "coating_both_sides",
    "porcelain_exposed_parts": "porcelain_exposed_parts", "stainless_series": "stainless_series",
    "rolling": "rolling", "coated": "coated",
    "product_kind": "cast(null as string)", "porcelain_steel": "cast(null as boolean)",
}
NUMERIC = ("composition_pct.B", "composition_pct.C", "thickness_mm", "width_mm", "mechanical_properties.yield_strength_mpa")
NUMERIC_FIELDS = ", ".join(f"'{f}'" for f in NUMERIC)
SERIES_FRACTIONS = ("72191301", "72191401", "72192201", "72193202", "72193301")


def compare(left: str, right: str) -> str:
    return (f"case op when '<' then {left} < {right} when '<=' then {left} <= {right} when '>' then {left} > {right} "
            f"when '>=' then {left} >= {right} else {left} = {right} end")


def _conditions() -> dict[tuple[str, str], list[tuple[str, str, str]]]:
    grouped = defaultdict(list)
    for fraction, nico, _, field, op, value in ref.condition_rows():
        grouped[fraction, nico].append((field, op, value))
    return grouped


def _term(field: str, op: str, value: str) -> str:
    literal = value if field in NUMERIC or value in ("true", "false") else f"'{value}'"
    return f"{FIELD_VALUES[field]} {op} {literal}"


def truth_expressions() -> dict[tuple[str, str], str]:
    """(fraction, nico) to a nullable boolean. Residual codes negate every specific one (Kleene logic)."""
    out = {key: "(" + " and ".join(_term(*c) for c in terms) + ")" for key, terms in _conditions().items()}
    electrical = [out["72255091", f"{i:02d}"] for i in range(1, 12)]
    none_of = " and ".join(f"not {e}" for e in electrical)
    for code in ("91", "92"):
        out["72255091", code] = f"({out['72255091', code]} and {none_of})"
    out["72255091", "99"] = f"({none_of} and not {out['72255091', '91']} and not {out['72255091', '92']})"
    out["72104999", "99"] = f"(not {out['72104999', '01']} and not {out['72104999', '02']})"
    out["72191202", "99"] = f"(not {out['72191202', '01']})"
    for fraction in SERIES_FRACTIONS:
        out[fraction, "99"] = "(stainless_series not in ('200', '300', '400'))"
    return out


def _by_fraction(values: dict[tuple[str, str], str], fraction: str, nico: str, default: str) -> str:
    grouped = defaultdict(list)
    for (f, n), text in values.items():
        grouped[f].append(f"when '{n}' then {text}")
    inner = " ".join(f"when '{f}' then case {nico} {' '.join(cases)} else {default} end" for f, cases in grouped.items())
    return f"case {fraction} {inner} else {default} end"


def assessments() -> dict[tuple[str, str], str]:
    """(fraction, nico) to its outcome: matched, conflict or unknown."""
    return {key: f"case {b} when true then 'matched' when false then 'conflict' else 'unknown' end" for key, b in truth_expressions().items()}


def assessment_case(fraction: str, nico: str) -> str:
    outcomes = {key: f"case when {b} then 'matched' when not {b} then 'conflict' else 'unknown' end"
                for key, b in truth_expressions().items()}
    return _by_fraction(outcomes, fraction, nico, "null")


# --- fixed values: facts cited for NICOs that have no condition row ---
CITED_WITHOUT_CONDITION = {
    ("72091504", "01"): "composition_pct.C",
    ("72091504", "02"): "mechanical_properties.yield_strength_mpa",
    ("72091504", "03"): "porcelain_exposed_parts",
    ("72091504", "99"): "composition_pct.C mechanical_properties.yield_strength_mpa porcelain_exposed_parts",
    ("72255091", "99"): "high_speed_steel tool_steel porcelain_exposed_parts",
}


def observed_fields_case(fraction: str, nico: str) -> str:
    fields = {key: list(dict.fromkeys(field for field, _, _ in terms)) for key, terms in _conditions().items()}
    fields.update({key: text.split() for key, text in CITED_WITHOUT_CONDITION.items()})
    arrays = {key: "array(" + ", ".join(f"'{f}'" for f in names) + ")" for key, names in fields.items()}
    return _by_fraction(arrays, fraction, nico, "array('thickness_mm', 'yield_strength_mpa')")


# --- fixed values: expectations shown for NICOs that have no condition row ---
EXPECTED_WITHOUT_CONDITION = {
    ("72091504", "01"): "composition_pct.C > 0.4",
    ("72091504", "02"): "mechanical_properties.yield_strength_mpa >= 355",
    ("72091504", "03"): "porcelain_exposed_parts = true",
    ("72091504", "99"): "other",
    ("72255091", "99"): "other",
}


def expectation_case(fraction: str, nico: str) -> str:
    texts = {key: ", ".join(" ".join(c) for c in terms) for key, terms in _conditions().items()}
    texts.update(EXPECTED_WITHOUT_CONDITION)
    return f"map('conditions', {_by_fraction({k: repr(v) for k, v in texts.items()}, fraction, nico, 'cast(null as string)')})"


# Whether known facts rule a pair out, and how far its open points push it back.
COMPATIBLE = """coalesce(case
    when fraction = '72104999' and relief then false
    when assessment is not null then assessment <> 'conflict'
    when fraction = '72091504' and nico = '01' then c > 0.4
    when fraction = '72091504' and nico = '02' then ys >= 355
    when fraction = '72091504' and nico = '03' then porcelain
    when fraction = '72091504' and nico = '99' and c is not null and ys is not null and porcelain is not null
        then c <= 0.4 and ys < 355 and not porcelain
    when fraction = '72081003' and nico = '01' then t > 10
    when fraction = '72081003' and nico = '02' then t > 4.75 and t <= 10
    when fraction = '72081003' and nico = '03' then t < 4.75
    when fraction = '72081003' and nico = '99' then t <= 4.75
    when fraction = '72082502' and nico = '01' then t > 10
    when fraction = '72082502' then t <= 10
    when fraction in ('72083601', '72083701') and nico = '01' then ys >= 355
    when fraction in ('72083601', '72083701') and nico = '02' then pipeline
    end, true)"""
QUALIFIER_PRIORITY = """case when nico = '99' then 10
    when assessment = 'unknown' and not (fraction = '72255091' and nico between '01' and '07' and coalesce(boron >= 0.0008, false)) then 20
    when assessment is not null then 0
    when fraction = '72091504' and not coalesce(case nico when '01' then c is not null when '02' then ys is not null
        when '03' then porcelain is not null end, false) then 20
    else 0 end"""

# Facts behind the result step, per fraction.
RESULT_EVIDENCE = """case
    when fraction = '72091504' then array('thickness_mm', 'composition_pct.C', 'mechanical_properties.yield_strength_mpa', 'porcelain_exposed_parts')
    when fraction in ('72091601', '72091701', '72082601', '72082701', '72083801', '72083901') then array('thickness_mm', 'mechanical_properties.yield_strength_mpa')
    when fraction = '72103002' then array('thickness_mm', 'coating.metal', 'coating.process', 'coating.superior_g_m2', 'coating.inferior_g_m2')
    when fraction in ('72083601', '72083701') then array('thickness_mm', 'mechanical_properties.yield_strength_mpa', 'pipeline_steel')
    else array('thickness_mm') end"""
