"""Fixed reference values of the rule book and the small tables built from them.

Every table here is a literal list in this file, so its size is known and it may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: legal alloy thresholds in percent (natural order of the legal note) ---
ALLOY_THRESHOLDS = (
    ("Al_total", "0.3"), ("B", "0.0008"), ("Cr", "0.3"), ("Co", "0.3"), ("Cu", "0.4"), ("Pb", "0.4"),
    ("Mn", "1.65"), ("Mo", "0.08"), ("Ni", "0.3"), ("Nb", "0.06"), ("Si", "0.6"), ("Ti", "0.05"),
    ("W", "0.3"), ("V", "0.1"), ("Zr", "0.05"), ("OtherIndividual", "0.1"),
)
# Elements that never count as "another element" of at least 0.1 percent.
NEUTRAL_ELEMENTS = ("C", "N", "P", "S", "Fe", "Al_soluble")
OTHER_ELEMENT_MINIMUM = "0.1"

FLAT_HEADINGS = ("7208", "7209", "7210", "7211", "7212", "7219", "7220", "7225", "7226")
FAMILIES = ("non_alloy", "stainless", "other_alloy")

# --- fixed values: coating words ---
TIN_WORDS = ("sn", "tin", "estaño", "estano", "hojalata")
LEAD_WORDS = ("pb", "lead", "plomo", "terne")
ZINC_WORDS = ("zn", "zinc", "zincado", "cinc")
GALVANIZED_WORDS = ("galvanizado", "galvanized")
CHROMIUM_WORDS = ("cr_oxide", "cr", "cromo", "tfs", "oxido de cromo")
ALUMINIUM_ZINC_WORDS = ("al-zn", "aluzinc", "galvalume", "aluminio-cinc", "aluminio cinc")
ALUMINIUM_WORDS = ("al", "aluminio", "aluminum")
PAINT_WORDS = ("paint", "plastic", "pintado", "plastico", "barniz", "prepintado")
ELECTROLYTIC_WORDS = ("electrolytic", "electrolytic zinc", "electrogalvanized")

# --- fixed values: NICO conditions, "fraction nico: field op value, ..." ---
NICO_CONDITIONS = """
72255091 01: composition_pct.B >= 0.0008, tool_steel = false, coiled = true, thickness_mm > 1, thickness_mm < 3
72255091 02: composition_pct.B >= 0.0008, tool_steel = false, coiled = true, thickness_mm >= 0.5, thickness_mm <= 1
72255091 03: composition_pct.B >= 0.0008, tool_steel = false, coiled = true, thickness_mm < 0.5
72255091 04: composition_pct.B >= 0.0008, tool_steel = false, coiled = true, thickness_mm >= 3, thickness_mm < 4.75
72255091 05: composition_pct.B >= 0.0008, tool_steel = false, coiled = true, thickness_mm >= 4.75
72255091 06: composition_pct.B >= 0.0008, tool_steel = false, coiled = false, thickness_mm < 4.75
72255091 07: composition_pct.B >= 0.0008, tool_steel = false, coiled = false, thickness_mm >= 4.75
72255091 08: high_speed_steel = true
72255091 09: tool_steel = true
72255091 10: porcelain_steel = true, thickness_mm >= 4.75
72255091 11: mechanical_properties.yield_strength_mpa >= 355
72255091 91: thickness_mm >= 4.75
72255091 92: porcelain_steel = true, thickness_mm < 4.75
72104101 00: pattern_in_relief = true, coating_both_sides = true
72104199 00: pattern_in_relief = true, coating_both_sides = false
72103002 01: coating_both_sides = true
72103002 99: coating_both_sides = false
72104999 01: thickness_mm < 3, mechanical_properties.yield_strength_mpa >= 275
72104999 02: mechanical_properties.yield_strength_mpa >= 355
72191202 01: thickness_mm <= 6, width_mm >= 710, width_mm <= 1350
72193101 01: coiled = true
72193101 99: coiled = false
72191301 01: stainless_series = 200
72191301 02: stainless_series = 300
72191301 03: stainless_series = 400
72191401 01: stainless_series = 200
72191401 02: stainless_series = 300
72191401 03: stainless_series = 400
72192201 01: stainless_series = 200
72192201 02: stainless_series = 300
72192201 03: stainless_series = 400
72193301 01: stainless_series = 200
72193301 02: stainless_series = 300
72193301 03: stainless_series = 400
72193202 02: stainless_series = 200, thickness_mm <= 4
72193202 03: stainless_series = 300, thickness_mm <= 4
72193202 04: stainless_series = 400, thickness_mm <= 4
72193202 91: stainless_series = 200, thickness_mm > 4
72193202 92: stainless_series = 300, thickness_mm > 4
72193202 93: stainless_series = 400, thickness_mm > 4
72112303 01: product_kind = strip, thickness_mm >= 0.05
72112303 02: product_kind = sheet, thickness_mm > 0.46, thickness_mm <= 3.4
72112999 01: product_kind = strip, thickness_mm >= 0.05, composition_pct.C < 0.6
72112999 02: product_kind = strip, composition_pct.C >= 0.6
72112999 03: product_kind = sheet, thickness_mm > 0.46, thickness_mm <= 3.4
72111491 01: product_kind = strip, coiled = false
72111491 02: product_kind = sheet, coiled = false, thickness_mm >= 4.75, thickness_mm < 12
72111491 03: coiled = true
72111999 01: product_kind = strip, thickness_mm < 4.75
72111999 02: product_kind = sheet, thickness_mm >= 1.9, thickness_mm < 4.75
72111999 03: product_kind = coil_stock
72111999 04: product_kind = sheet, width_mm > 500, width_mm < 600, thickness_mm >= 1.9, thickness_mm < 4.75
72122003 01: product_kind = strip
72122003 02: coating_both_sides = true, width_mm > 500
72123003 01: product_kind = strip
72123003 02: coating_both_sides = true, width_mm > 500
72121003 01: product_kind = strip
72121003 02: product_kind = sheet
72259201 01: mechanical_properties.yield_strength_mpa >= 355
72259201 99: mechanical_properties.yield_strength_mpa < 355
"""

# --- fixed values: fractions an executable branch may return ---
EXECUTABLE_FRACTIONS = """
72081003 72082502 72082601 72082701 72083601 72083701 72083801 72083901 72084002 72085104 72085201 72085301
72085401 72091504 72091601 72091701 72091801 72092501 72092601 72092701 72092801 72101101 72101204 72102001
72103002 72104101 72104999 72105003 72106101 72106999 72107002 72109099 72111301 72111491 72111999 72112303
72112999 72119099 72121003 72122003 72123003 72124004 72125001 72126004 72191101 72191202 72191301 72191401
72192101 72192201 72192301 72192401 72193101 72193202 72193301 72193502 72199099 72201101 72201201 72202003
72209099 72251101 72251999 72253091 72254091 72255091 72259101 72259201 72259999 72261101 72261999 72262001
72269107 72269206 72269999
""".split()
AMBIGUOUS_CODES = ("72193502",)
BLOCKED_CODES = (
    "72251101", "72251999", "72261101", "72261999", "7210120401", "7210120402", "7209150403", "7225509110", "72126004",
)

# --- fixed values: NICOs that the branches and conditions above name, per fraction ---
CATALOG_SEED = """
72081003 01 02 03 99
72082502 01 99
72082601 01 99
72082701 01 99
72083601 01 02 99
72083701 01 02 99
72083801 01 99
72083901 01 99
72084002 01 99
72085104 01 02 03 04 05
72085201 00
72085301 00
72085401 00
72091504 01 02 03 99
72091601 01 99
72091701 01 99
72091801 01 99
72092501 00
72092601 00
72092701 00
72092801 00
72101101 00
72101204 01 02 03 99
72102001 00
72103002 01 99
72104101 00
72104199 00
72104999 01 02 99
72105003 00
72106101 00
72106999 00
72107002 00
72109099 00
72111301 00
72111491 01 02 03
72111999 01 02 03 04
72112303 01 02 99
72112999 01 02 03 99
72119099 00
72121003 01 02
72122003 01 02 99
72123003 01 02 99
72124004 00
72125001 00
72126004 00
72191101 00
72191202 01 99
72191301 01 02 03 99
72191401 01 02 03 99
72192101 00
72192201 01 02 03 99
72192301 00
72192401 00
72193101 01 99
72193202 02 03 04 91 92 93 99
72193301 01 02 03 99
72193502 01
72193502 01
72199099 00
72201101 00
72201201 00
72202003 00
72209099 00
72251101 00
72251999 00
72253091 00
72254091 00
72255091 01 02 03 04 05 06 07 08 09 10 11 91 92 99
72259101 00
72259201 01 99
72259999 00
72261101 00
72261999 00
72262001 00
72269107 00
72269206 00
72269999 00
"""


def thresholds(spark: SparkSession) -> DataFrame:
    rows = [(element, i, value) for i, (element, value) in enumerate(ALLOY_THRESHOLDS, 1)]
    return spark.createDataFrame(rows, "element string, idx int, threshold string").selectExpr(
        "element", "idx", "cast(threshold as decimal(18,8)) as threshold")


def condition_rows() -> list[tuple[str, str, int, str, str, str]]:
    rows = []
    for line in NICO_CONDITIONS.strip().splitlines():
        code, conditions = line.split(":", 1)
        fraction, nico = code.split()
        for i, condition in enumerate(conditions.split(","), 1):
            field, op, value = condition.split()
            rows.append((fraction, nico, i, field, op, value))
    return rows


def nico_conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        condition_rows(), "fraction string, nico string, position int, field string, op string, value string")


def catalog_rows() -> list[tuple[str, str, str | None, str | None]]:
    """(kind, code, fraction, nico): the headings, fractions and NICOs that the rules name."""
    rows: list[tuple[str, str, str | None, str | None]] = [("heading", h, None, None) for h in FLAT_HEADINGS]
    for line in CATALOG_SEED.strip().splitlines():
        fraction, *nicos = line.split()
        rows.append(("fraction", fraction, fraction, None))
        rows.extend(("nico", fraction + nico, fraction, nico) for nico in nicos)
    return rows


def catalog(spark: SparkSession) -> DataFrame:
    """Seed catalogue. Descriptions and pages are unknown; the doubled code keeps the source ambiguity."""
    return spark.createDataFrame(catalog_rows(), "kind string, code string, fraction string, nico string").selectExpr(
        "kind", "code", "fraction", "nico", "cast(null as string) as description", "cast(null as int) as page")
