"""Text rules of certificate cells as column expressions (all JVM-side)."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"
SUPERSCRIPTS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+"

# --- fixed values: marks that repeat the cell above ---
DITTO_MARKS = ('"', "''", "〃", "同上", "ditto", "do", "“", "”", "″")


def normalize_term(text: Column) -> Column:
    """Lower case, no accents, runs of other characters collapsed to one space."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}_]+", " "))


def compact_term(text: Column) -> Column:
    return F.replace(normalize_term(text), F.lit(" "), F.lit(""))


@cache
def folding_table(last: int = 0x1FFFF) -> tuple[str, str, str, str]:
    """Compatibility folding by rule, per code point: case folded, decomposed, without combining marks.

    Returns (characters with one or no character behind them, those characters, a regular expression of characters that
    become several, table text): the table has one entry per code point, the mark U+0001 where the character stays.
    """
    one, to, gone, many, entries = [], [], [], [], []
    for point in range(last + 1):
        character = chr(point)
        if 0xD800 <= point < 0xE000:
            entries.append("\x01")
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", character.casefold()) if not unicodedata.combining(c))
        entries.append("\x01" if plain == character or point < 3 else plain)
        if plain == character:
            continue
        if not plain:
            gone.append(character)
        elif len(plain) == 1:
            one.append(character)
            to.append(plain)
        else:
            many.append(point)
    ranges = []
    for point in many:
        if ranges and ranges[-1][1] == point - 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    several = "[" + "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in ranges) + "]"
    return "".join(one + gone), "".join(to), several, "\x02".join(entries)


def normalize_term_unicode(text: Column | str) -> Column:
    """normalize_term over every script: compatibility forms, case and combining marks folded, in the JVM.

    ASCII texts are lower-cased and most others translated; only texts with a character that becomes several (ligatures,
    units, Hangul) are taken apart.
    """
    text = F.col(text) if isinstance(text, str) else text
    source, target, several, table = folding_table()
    entries = F.split(F.lit(table), "\x02", -1)
    apart = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.nullif(F.get(entries, F.ascii(c)), F.lit("\x01")), c)), "")
    plain = F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).when(text.rlike(several), apart).otherwise(F.translate(text, source, target))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}_]+", " "))


def is_ditto(text: Column) -> Column:
    return F.coalesce(F.trim(text).isin(*DITTO_MARKS), F.lit(False))


def power_of_ten(text: Column) -> Column:
    """Exponent of -4, 10^-4, 10(-4) or 10⁻⁴; null when the notation is not recognised."""
    compact = F.regexp_replace(F.translate(text, SUPERSCRIPTS, DIGITS), r"\s+", "")
    found = F.regexp_extract(compact, r"^(?:10\^?\((-?\d+)\)|10\^?(-?\d+)|(-?\d+))$", 0)
    inner = F.regexp_extract(compact, r"^(?:10\^?\(?)?(-?\d+)\)?$", 1)
    return F.when(found != "", inner.try_cast("int"))


# --- fixed values: signs of a declared factor in their plain form ---
FACTOR_SIGNS = ("×÷−⁻⁰¹²³⁴⁵⁶⁷⁸⁹", "x/--0123456789")
WORD_SCALES = (("ppm", -4), ("%", 0))


def scale_exponent(header: Column) -> Column:
    """Power of ten that a column header declares for its chemistry values: a factor such as x10^4, 10-3 or *1000, else ppm or %."""
    plain = F.translate(F.replace(F.lower(header), F.lit(" "), F.lit("")), *FACTOR_SIGNS)
    factor = F.regexp_extract(plain, r"[x*/]10\^?[1-6](?!\d)|10\^?-\d+|[x*/]10{2,4}", 0)
    power = (F.when(factor == "", None).when(factor.contains("-"), F.substring_index(factor, "-", -1).try_cast("int"))
             .when(factor.endswith("0"), F.length(factor) - 2).otherwise(F.right(factor, F.lit(1)).cast("int")))
    return F.coalesce(-power, *[F.when(plain.contains(word), F.lit(scale)) for word, scale in WORD_SCALES])


def scaled_percentage(raw: Column, exponent: Column) -> Column:
    """struct(percentage, error): null stays null, an empty cell is an error, the result must lie in 0..100."""
    text = F.replace(F.trim(raw), F.lit(" "), F.lit(""))
    text = F.when(text.contains(",") & ~text.contains("."), F.replace(text, F.lit(","), F.lit("."))).otherwise(text)
    value = text.try_cast("decimal(18,8)")
    powers = F.element_at(F.create_map(*[x for i in range(-8, 9) for x in (
        F.lit(i), F.lit(f"{10.0 ** i:.8f}").cast("decimal(18,8)"))]), exponent)
    scaled = value * powers
    error = (F.when(raw.isNull(), None).when(text == "", "empty_cell").when(value.isNull(), "not_numeric")
             .when(exponent.isNull(), "no_scale").when(powers.isNull(), "scale_out_of_range").when((scaled < 0) | (scaled > 100), "out_of_range"))
    return F.struct(F.when(error.isNull(), scaled.cast("decimal(18,8)")).alias("percentage"), error.alias("error"))


def locale_number(text: Column) -> Column:
    """The last of comma and point is the decimal mark; a lone comma before three digits groups thousands."""
    clean = F.replace(F.trim(text), F.lit(" "), F.lit(""))
    both = clean.contains(",") & clean.contains(".")
    comma_last = F.length(F.substring_index(clean, ",", -1)) < F.length(F.substring_index(clean, ".", -1))
    drop = lambda c, mark: F.replace(c, F.lit(mark), F.lit(""))
    head, tail = F.regexp_extract(clean, r"^(.*),([^,]*)$", 1), F.regexp_extract(clean, r"^(.*),([^,]*)$", 2)
    fixed = (F.when(both & comma_last, F.replace(drop(clean, "."), F.lit(","), F.lit(".")))
             .when(both, drop(clean, ",")).when(clean.contains(","), F.when(F.length(tail) == 3, drop(clean, ",")).otherwise(
                 F.concat(head, F.lit("."), tail))).otherwise(clean))
    return fixed.try_cast("decimal(18,6)")


# --- fixed values: unit, its millimetres, its words and signs; an earlier unit wins ---
UNITS = (
    ("mm", "1", ("mm", "milimetro", "milimetros", "milímetro", "milímetros"), ()),
    ("cm", "10", ("cm", "centimetro", "centimetros", "centímetro", "centímetros"), ()),
    ("in", "25.4", ("in", "inch", "inches", "pulgada", "pulgadas"), ('"', "″")),
    ("ft", "304.8", ("ft", "feet", "foot", "pie", "pies"), ("'", "′")),
    ("m", "1000", ("m", "metro", "metros"), ()),
)
UNIT_PATTERNS = tuple((unit, rf"(?i)\b(?:{'|'.join(words)})\b" + "".join(f"|{sign}" for sign in signs)) for unit, _, words, signs in UNITS)
UNIT_FACTORS = {unit: factor for unit, factor, _, _ in UNITS}
SUFFIX = "|".join(word for _, _, words, signs in UNITS for word in (*words, *signs))
# A whole or decimal number, alone or before a fraction; or a fraction alone.
DIMENSION = rf"(?i)^\s*(?:(\d+(?:[.,]\d+)?|[.,]\d+)(?:\s+(\d+)/(\d+))?|(\d+)/(\d+))\s*(?:{SUFFIX})?\s*$"


def dimension_unit(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(unit)) for unit, pattern in UNIT_PATTERNS])


def dimension_value(text: Column, header: Column, length: bool = False) -> Column:
    """Millimetres (metres for a length) from a cell such as '1 1/2 in'; an unknown suffix gives null."""
    unit = F.coalesce(dimension_unit(text), dimension_unit(header), F.lit("m" if length else "mm"))
    part = lambda i: F.nullif(F.regexp_extract(text, DIMENSION, i), F.lit(""))
    # Text that is present but does not fit stays unknown; only an absent whole part counts as zero.
    whole = F.when(part(1).isNull(), F.lit(0).cast("decimal(20,6)")).otherwise(F.replace(part(1), F.lit(","), F.lit(".")).try_cast("decimal(20,6)"))
    top = F.coalesce(part(2), part(4)).try_cast("decimal(9,0)")
    bottom = F.coalesce(part(3), part(5)).try_cast("decimal(9,0)")
    factor = F.element_at(F.create_map(*[x for k, v in UNIT_FACTORS.items() for x in (
        F.lit(k), F.lit(v).cast("decimal(8,4)"))]), unit)
    numeric = whole + F.when(top.isNull(), F.lit(0).cast("decimal(9,0)")).otherwise(F.try_divide(top, bottom))
    value = numeric * factor / F.lit(1000 if length else 1).cast("decimal(4,0)")
    return F.when(text.rlike(DIMENSION), value.try_cast("decimal(18,6)"))


MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def certificate_date(text: Column) -> Column:
    """Exact dates only: 20240131, 2024-01-31, 2024/01/31 or 'Jan. 31, 2024'; approximate wording gives null."""
    clean = F.trim(text)
    english = r"^([A-Za-z]{3})\.?\s+(\d{1,2}),?\s+(\d{4})$"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.upper(F.regexp_extract(clean, english, 1)))
    parsed = F.coalesce(
        F.when(clean.rlike(r"^\d{8}$"), F.try_to_date(clean, "yyyyMMdd")),
        F.when(clean.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(clean, "yyyy-M-d")),
        F.when(clean.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(clean, "yyyy/M/d")),
        F.when(month > 0, F.try_to_date(F.concat_ws("-", F.regexp_extract(clean, english, 3), month.cast("string"),
                                                    F.regexp_extract(clean, english, 2)), "yyyy-M-d")))
    return F.when(~clean.rlike(r"(?i)\b(?:about|approx|circa)\b"), parsed)


def name_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def is_coil_word(text: Column) -> Column:
    return F.coalesce(F.upper(F.trim(text)).isin("C", "COIL", "COILED", "ROLLO"), F.lit(False))
