"""Tariff branches as ordered decision tables.

Each line is ``condition | fraction | nico | missing facts | candidate codes``; the first line whose condition is
true decides. A null condition does not match, so ``relief`` reads "known true" and ``not relief`` "known false".
Short names: t thickness, w width, ys yield strength, c carbon, metal and process lower-cased. ``@strength`` in the
NICO column stands for the 355 MPa split. ``$name`` is a thickness band that names a fraction.
"""

from __future__ import annotations

import re

from millspark.functions import refdata as ref


def _words(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _bands(*steps: tuple[str, str]) -> str:
    *conditional, (_, last) = steps
    return "case " + " ".join(f"when {cond} then '{code}'" for cond, code in conditional) + f" else '{last}' end"


BANDS = {
    "$pickled": _bands(("t >= 4.75", "72082502"), ("t >= 3", "72082601"), ("", "72082701")),
    "$unpickled": _bands(("t > 10", "72083601"), ("t >= 4.75", "72083701"), ("t >= 3", "72083801"), ("", "72083901")),
    "$flat": _bands(("t > 10", "72085104"), ("t >= 4.75", "72085201"), ("t >= 3", "72085301"), ("", "72085401")),
    "$series": "case series when '200' then '01' when '300' then '02' when '400' then '03' else '99' end",
    "$thin_series": "case series when '200' then '02' when '300' then '03' when '400' then '04' else '99' end",
    "$thick_series": "case series when '200' then '91' when '300' then '92' when '400' then '93' else '99' end",
}

TIN, LEAD = f"metal in {_words(ref.TIN_WORDS)}", f"metal in {_words(ref.LEAD_WORDS)}"
ZINC = f"metal in {_words(ref.ZINC_WORDS)}"
ZINC_OR_GALVANIZED = f"metal in {_words(ref.ZINC_WORDS + ref.GALVANIZED_WORDS)}"
# Narrow and alloy branches list fewer words.
PLAIN_ZINC = "metal in ('zn', 'zinc', 'cinc')"
PLAIN_GALVANIZED = "metal in ('zn', 'zinc', 'cinc', 'galvanizado')"
ELECTROLYTIC = f"process in {_words(ref.ELECTROLYTIC_WORDS)}"
PLAIN_ELECTROLYTIC = "process in ('electrolytic', 'electrogalvanized')"

BRANCHES = {
    "7208": """
        relief and coiled and t > 10                       | 72081003 | 01
        relief and coiled and t > 4.75                     | 72081003 | 02
        relief and coiled and t = 4.75                     | 72081003 |    | source_boundary_4_75_mm | 02 03 99
        relief and coiled and not pickled                  | 72081003 | 03
        relief and coiled and pickled                      | 72081003 | 99
        relief and coiled                                  | 72081003 |    | pickled | 03 99
        relief and t > 4.75                                | 72084002 | 01
        relief                                             | 72084002 | 99
        relief is null and coiled                          |          |    | pattern_in_relief | 72081003 $pickled $unpickled
        relief is null                                     |          |    | pattern_in_relief | 72084002 $flat
        not coiled and t > 10                              | 72085104 |    | nico_qualifier | 01 02 03 04 05
        not coiled                                         | $flat    | 00
        pickled is null                                    |          |    | pickled | $pickled $unpickled
        pickled and t > 10                                 | 72082502 | 01
        pickled and t >= 4.75                              | 72082502 | 99
        pickled                                            | $pickled | @strength
        t >= 4.75 and ys >= 355                            | $unpickled | 01
        t >= 4.75 and pipeline                             | $unpickled | 02
        t >= 4.75 and ys is not null and not pipeline      | $unpickled | 99
        t >= 4.75                                          | $unpickled |  | yield_strength_mpa pipeline_steel | 01 02 99
        true                                               | $unpickled | @strength
    """,
    "7209": """
        coiled and t >= 3 and c > 0.4                      | 72091504 | 01
        coiled and t >= 3 and ys >= 355                    | 72091504 | 02
        coiled and t >= 3 and not porcelain and c is not null and ys is not null | 72091504 | 99
        coiled and t >= 3 and drawing_class is null        | 72091504 |    | porcelain_exposed_parts deep_drawing_class | 01 02 03 99
        coiled and t >= 3                                  | 72091504 |    | porcelain_exposed_parts | 01 02 03 99
        coiled and t > 1                                   | 72091601 | @strength
        coiled and t >= 0.5                                | 72091701 | @strength
        coiled and t < 0.361                               | 72091801 | 01
        coiled                                             | 72091801 | 99
        t >= 3                                             | 72092501 | 00
        t > 1                                              | 72092601 | 00
        t >= 0.5                                           | 72092701 | 00
        true                                               | 72092801 | 00
    """,
    "7210": f"""
        {TIN} and t >= 0.5                                 | 72101101 | 00
        {TIN} and (reduction_ratio is null or can_body is null) | 72101204 | | secondary_reduction_ratio can_body_end_use | 01 02 99
        {TIN}                                              | 72101204 |    | official_nico_qualifier | 01 02 03 99
        {LEAD}                                             | 72102001 | 00
        {ZINC} and {ELECTROLYTIC} and both_sides           | 72103002 | 01
        {ZINC} and {ELECTROLYTIC} and not both_sides       | 72103002 | 99
        {ZINC} and {ELECTROLYTIC}                          | 72103002 |    | coating_both_sides | 01 99
        {ZINC_OR_GALVANIZED} and process = ''              |          |    | coating_process | 72103002 72104999
        {ZINC_OR_GALVANIZED} and relief and both_sides     | 72104101 | 00
        {ZINC_OR_GALVANIZED} and relief and not both_sides | 72104199 | 00
        {ZINC_OR_GALVANIZED} and relief                    |          |    | coating_both_sides | 72104101 72104199
        {ZINC_OR_GALVANIZED} and relief is null            |          |    | pattern_in_relief | 72104101 72104199 72104999
        {ZINC_OR_GALVANIZED} and ys >= 355                 | 72104999 | 02
        {ZINC_OR_GALVANIZED} and ys is null                | 72104999 |    | yield_strength_mpa | 72104999
        {ZINC_OR_GALVANIZED} and t < 3 and ys >= 275       | 72104999 | 01
        {ZINC_OR_GALVANIZED}                               | 72104999 | 99
        metal in {_words(ref.CHROMIUM_WORDS)}              | 72105003 |    | temper nico_qualifier | 72105003
        metal in {_words(ref.ALUMINIUM_ZINC_WORDS)}        | 72106101 | 00
        metal in {_words(ref.ALUMINIUM_WORDS)}             | 72106999 |    | coating_alloy_composition | 72106999
        metal in {_words(ref.PAINT_WORDS)}                 | 72107002 |    | coating_layer_details | 72107002
        metal <> ''                                        | 72109099 |    | cladding_material | 72109099
        true                                               |          |    | coating_metal | 72101101 72103002 72104999 72106101 72107002
    """,
    "7211": """
        rolling = 'hot' and four_faces and w > 150 and t >= 4 and not coiled and not relief     | 72111301 | 00
        rolling = 'hot' and four_faces and w > 150 and t >= 4 and not coiled and relief is null | | | pattern_in_relief | 72111301
        rolling = 'hot' and t >= 4.75 and coiled           | 72111491 | 03
        rolling = 'hot' and t >= 4.75                      | 72111491 |    | product_kind nico_qualifier | 72111491
        rolling = 'hot'                                    | 72111999 |    | product_kind nico_qualifier | 72111999
        rolling = 'cold' and c >= 0.25                     | 72112999 |    | product_kind nico_qualifier | 72112999
        rolling = 'cold'                                   | 72112303 |    | product_kind nico_qualifier | 72112303
        true                                               | 72119099 | 00
    """,
    "7212": f"""
        clad and cladding_weight is null                   | 72126004 |    | cladding_weight_percentage | 72126004
        clad                                               | 72126004 |    | cladding_material | 72126004
        {TIN}                                              | 72121003 |    | product_kind | 72121003
        {PLAIN_ZINC} and {PLAIN_ELECTROLYTIC}              | 72122003 |    | product_kind coating_both_sides | 72122003
        {PLAIN_GALVANIZED}                                 | 72123003 |    | product_kind coating_both_sides coating_process | 72123003
        metal in ('paint', 'plastic', 'pintado', 'plastico') | 72124004 |  | coating_layer_details | 72124004
        metal = ''                                         |          |    | coating_metal |
        true                                               | 72125001 | 00
    """,
    "7219": """
        rolling = 'hot' and coiled and t > 10              | 72191101 | 00
        rolling = 'hot' and coiled and t >= 4.75 and t <= 6 and w >= 710 and w <= 1350 | 72191202 | 01
        rolling = 'hot' and coiled and t >= 4.75           | 72191202 | 99
        rolling = 'hot' and coiled and t >= 3 and series is null | 72191301 | | stainless_series | 72191301
        rolling = 'hot' and coiled and t >= 3              | 72191301 | $series
        rolling = 'hot' and coiled and series is null      | 72191401 |    | stainless_series | 72191401
        rolling = 'hot' and coiled                         | 72191401 | $series
        rolling = 'hot' and not coiled and t > 10          | 72192101 | 00
        rolling = 'hot' and not coiled and t >= 4.75 and series is null | 72192201 | | stainless_series | 72192201
        rolling = 'hot' and not coiled and t >= 4.75       | 72192201 | $series
        rolling = 'hot' and not coiled and t >= 3          | 72192301 | 00
        rolling = 'hot' and not coiled                     | 72192401 | 00
        rolling = 'cold' and t >= 4.75 and coiled          | 72193101 | 01
        rolling = 'cold' and t >= 4.75                     | 72193101 | 99
        rolling = 'cold' and t >= 3 and series is null     | 72193202 |    | stainless_series | 72193202
        rolling = 'cold' and t >= 3 and t <= 4             | 72193202 | $thin_series
        rolling = 'cold' and t >= 3                        | 72193202 | $thick_series
        rolling = 'cold' and t > 1 and series is null      | 72193301 |    | stainless_series | 72193301
        rolling = 'cold' and t > 1                         | 72193301 | $series
        rolling = 'cold'                                   | 72193502 |    | ambiguous_source_code_7219_35_02 | 72193502
        true                                               | 72199099 | 00
    """,
    "7220": """
        rolling = 'hot' and t >= 4.75                      | 72201101 | 00
        rolling = 'hot'                                    | 72201201 | 00
        rolling = 'cold'                                   | 72202003 |    | stainless_series temper nico_qualifier | 72202003
        true                                               | 72209099 | 00
    """,
    "7225": f"""
        grain and loss is null and induction is null       | 72251101 |    | magnetic_loss_w_per_kg magnetic_induction_tesla | 72251101
        grain and loss is null                             | 72251101 |    | magnetic_loss_w_per_kg | 72251101
        grain and induction is null                        | 72251101 |    | magnetic_induction_tesla | 72251101
        grain                                              | 72251101 | 00 | | 72251101
        silicon and loss is null and induction is null     | 72251999 |    | magnetic_loss_w_per_kg magnetic_induction_tesla | 72251999
        silicon and loss is null                           | 72251999 |    | magnetic_loss_w_per_kg | 72251999
        silicon and induction is null                      | 72251999 |    | magnetic_induction_tesla | 72251999
        silicon                                            | 72251999 | 00 | | 72251999
        $coated and {PLAIN_ZINC} and {PLAIN_ELECTROLYTIC}  | 72259101 | 00
        $coated and {PLAIN_GALVANIZED} and process = ''    |          |    | coating_process | 72259101 72259201
        $coated and {PLAIN_GALVANIZED}                     | 72259201 | @strength
        $coated                                            | 72259999 |    | coating_layer_details | 72259999
        rolling = 'hot' and coiled                         | 72253091 |    | nico_qualifier | 72253091
        rolling = 'hot'                                    | 72254091 |    | nico_qualifier | 72254091
        rolling = 'cold' and drawing_class is null         | 72255091 |    | nico_qualifier deep_drawing_class | 72255091
        rolling = 'cold'                                   | 72255091 |    | nico_qualifier | 72255091
        true                                               |          |    | implemented_tariff_branch | 7225
    """,
    "7226": """
        grain and loss is null and induction is null       | 72261101 |    | magnetic_loss_w_per_kg magnetic_induction_tesla | 72261101
        grain and loss is null                             | 72261101 |    | magnetic_loss_w_per_kg | 72261101
        grain and induction is null                        | 72261101 |    | magnetic_induction_tesla | 72261101
        grain                                              | 72261101 | 00 | | 72261101
        silicon and loss is null and induction is null     | 72261999 |    | magnetic_loss_w_per_kg magnetic_induction_tesla | 72261999
        silicon and loss is null                           | 72261999 |    | magnetic_loss_w_per_kg | 72261999
        silicon and induction is null                      | 72261999 |    | magnetic_induction_tesla | 72261999
        silicon                                            | 72261999 | 00 | | 72261999
        high_speed                                         | 72262001 | 00
        $coated                                            | 72269999 |    | nico_qualifier coating_process | 72269999
        rolling = 'hot'                                    | 72269107 |    | nico_qualifier | 72269107
        rolling = 'cold'                                   | 72269206 |    | nico_qualifier | 72269206
        true                                               | 72269999 |    | nico_qualifier | 72269999
    """,
}

STRENGTH_SPLIT = (
    ("ys is null", "", "yield_strength_mpa", "01 99"), ("ys >= 355", "01", "", ""), ("true", "99", "", ""),
)


def _value(token: str) -> str:
    if not token:
        return "cast(null as string)"
    return BANDS[token] if token.startswith("$") else f"'{token}'"


def _array(tokens: str) -> str:
    return f"array({', '.join(_value(t) for t in tokens.split())})" if tokens.strip() else "cast(array() as array<string>)"


def _lines(table: str):
    for line in table.strip().splitlines():
        cells = [cell.strip() for cell in line.split("|")]
        condition, fraction, nico, missing, codes = (cells + [""] * 5)[:5]
        if nico == "@strength":
            for extra, split_nico, split_missing, split_codes in STRENGTH_SPLIT:
                yield f"{condition} and {extra}", fraction, split_nico, split_missing, split_codes
        else:
            yield condition, fraction, nico, missing, codes


def as_lambda(case: str) -> str:
    """The same value, evaluated as one lambda call.

    A table of a hundred conditions would overflow a generated Java method (64 KB) and push its whole stage back
    to slow paths; as a lambda body it stays one call inside an otherwise small compiled projection.
    """
    return f"transform(array(0), _ -> {case})[0]"


def branch_case(heading: str, coated: str = "coated") -> str:
    """SQL CASE that yields struct(fraction, nico, missing, candidates) for one heading."""
    parts = []
    for condition, fraction, nico, missing, codes in _lines(BRANCHES[heading]):
        parts.append(
            f"when {condition.replace('$coated', coated)} then named_struct('fraction', {_value(fraction)}, "
            f"'nico', {_value(nico)}, 'missing', {_array(missing)}, 'candidates', {_array(codes)})")
    return "case " + " ".join(parts) + " end"


def heading_case(family: str = "family", coated: str = "coated") -> str:
    return (f"case when {coated} is null then null "
            f"when {family} = 'non_alloy' and {coated} then if(w >= 600, '7210', '7212') "
            f"when {family} = 'non_alloy' and rolling = 'hot' then if(w >= 600, '7208', '7211') "
            f"when {family} = 'non_alloy' and rolling = 'cold' then if(w >= 600, '7209', '7211') "
            f"when {family} = 'stainless' then if(w >= 600, '7219', '7220') "
            f"when {family} = 'other_alloy' then if(w >= 600, '7225', '7226') end")


NO_BRANCH = ("named_struct('fraction', cast(null as string), 'nico', cast(null as string), "
             "'missing', array('implemented_tariff_branch'), 'candidates', cast(array() as array<string>))")


def decision_case(heading: str = "heading", coated: str = "coated") -> str:
    """All branches behind the heading that selects one of them."""
    return "case " + " ".join(
        f"when {heading} = '{code}' then {branch_case(code, coated)}" for code in BRANCHES) + f" else {NO_BRANCH} end"


# Short names the tables use, from the columns of the facts table.
SHORT_NAMES = {
    "t": "thickness_mm", "w": "width_mm", "ys": "yield_strength_mpa", "c": "composition_pct['C']",
    "boron": "composition_pct['B']", "metal": "lower(coalesce(coating_metal, ''))",
    "process": "lower(coalesce(coating_process, ''))", "relief": "pattern_in_relief", "both_sides": "coating_both_sides",
    "pipeline": "pipeline_steel", "porcelain": "porcelain_exposed_parts", "drawing_class": "deep_drawing_class",
    "series": "stainless_series", "four_faces": "rolled_four_faces", "cladding_weight": "cladding_weight_percentage",
    "grain": "grain_oriented", "silicon": "magnetic_silicon", "loss": "magnetic_loss_w_per_kg",
    "induction": "magnetic_induction_tesla", "reduction_ratio": "secondary_reduction_ratio",
    "can_body": "can_body_end_use", "high_speed": "high_speed_steel",
}


def fact_of(text: str) -> str:
    """The fact a short name is read from."""
    return next(word for word in re.findall(r"[a-z_]+", text) if word not in ("lower", "coalesce"))


def names_of(heading: str) -> set[str]:
    """The names, long or short, that one heading's branch uses, as facts; SQL words are among them."""
    words = re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "", branch_case(heading)))
    return {fact_of(SHORT_NAMES[word]) if word in SHORT_NAMES else word for word in words}
