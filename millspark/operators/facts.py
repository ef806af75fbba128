"""Assembling the facts of a roll from stored values, compositions and current observations.

Three layers of typed values, highest first: observations of the roll, observations of its heat that name no roll, stored
values. The newest observation of a layer counts, and a present null hides the layers below. Each layer is one map per
roll or heat (field to value), so a fact is a lookup, and new fields or elements need no new join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millspark.functions import vocabulary as words
from millspark.operators.classification import FACT_TYPES

ELEMENT = "composition_pct."
# Facts that observations name by another path; all others have their own name.
PATHS = {"coating_metal": "coating.metal", "coating_process": "coating.process", "yield_strength_mpa": "mechanical_properties.yield_strength_mpa"}
FACES = ("coating.superior_g_m2", "coating.inferior_g_m2")


def _sorted_readings(reading: Column | str) -> Column:
    return F.array_sort(F.collect_set(reading))


def _highest() -> Column:
    """Element map of the sorted ``_readings``: of an element's readings the last is the highest (nulls come first)."""
    last = F.expr("filter(_readings, (x, i) -> not (x.element <=> get(_readings, i + 1).element) or i = size(_readings) - 1)")
    return F.map_from_entries(last)


def composition_maps(rows: DataFrame, key: str = "heat_id") -> DataFrame:
    """Element map per scope, one entry per element with its highest value.

    The distinct readings of a scope are combined before the one shuffle. A reading without an element is an error, as a
    map has no null key.
    """
    readings = _sorted_readings(F.struct("element", "percentage"))
    return rows.groupBy(key).agg(readings.alias("_readings")).select(key, _highest().alias("composition_pct"))


def attach_composition(products: DataFrame, compositions: DataFrame) -> DataFrame:
    """Rolls with the composition map of their heat; the map side has one row per heat."""
    maps = composition_maps(compositions)
    joined = products.join(maps, "heat_id", "left")
    return joined.withColumn("composition_pct", F.coalesce("composition_pct", F.expr("cast(map() as map<string,decimal(18,8)>)")))


def _layer(observations: DataFrame, compositions: DataFrame | None, key: str, scope: str) -> DataFrame:
    """One row per ``key``: field path to (value, scope, observation_id) of the newest observation, and the element map.

    Both kinds of rows meet in one shuffle by key; a key may have either.
    """
    entry = F.struct("value", F.lit(scope).alias("scope"), "observation_id")
    seen = observations.groupBy(key, "field_path").agg(F.max_by(entry, "observation_id").alias("entry"))
    seen = seen.select(key, F.struct("field_path", "entry").alias("_entry"))
    found = F.map_from_entries(F.collect_list("_entry")).alias(f"_{scope}")
    if compositions is None:
        return seen.groupBy(key).agg(found)
    rows = seen.unionByName(compositions.select(key, F.struct("element", "percentage").alias("_reading")), allowMissingColumns=True)
    return rows.groupBy(key).agg(found, _sorted_readings("_reading").alias("_readings")).select(
        key, f"_{scope}", _highest().alias(f"_{scope}_elements"))


def _both_sides(superior: Column, inferior: Column) -> Column:
    known = superior.isNotNull() & inferior.isNotNull()
    return F.when((superior == 0) | (inferior == 0), F.lit(False)).when(known, (superior > 0) & (inferior > 0))


def _pickled(condition: Column) -> Column:
    lowered = F.transform(condition, F.lower)
    any_of = lambda known: F.arrays_overlap(lowered, F.array(*map(F.lit, known)))
    return F.when(any_of(words.PICKLED), F.lit(True)).when(any_of(words.NOT_PICKLED), F.lit(False))


def assemble_facts(products: DataFrame, compositions: DataFrame, observations: DataFrame) -> DataFrame:
    """The 30 facts of each roll, the other columns of ``products``, and what overrode them.

    ``products``: ``product_id, heat_id``, stored facts under their own names, and, where known, ``condition`` (array of
    texts), ``coating_superior_g_m2`` and ``coating_inferior_g_m2``; a stored fact that is absent is unknown.
    ``compositions``: ``heat_id, element, percentage`` and optionally ``product_id``; a row that names a roll wins over
    its heat's, also with a null percentage. ``observations``: ``observation_id, product_id, heat_id, field_path, value``
    (text) and ``is_current``. A value that does not read as its fact's type makes the fact unknown and is listed in
    ``unreadable``. ``overrides`` tells scope and observation of each field that a layer above the stored one sets.

    Heat rows are reduced to one row per heat before they meet rolls.
    """
    current = observations.filter("is_current").select("product_id", "heat_id", "field_path", "value", "observation_id")
    own_elements, shared = None, compositions
    if "product_id" in compositions.columns:
        own_elements, shared = compositions.filter("product_id is not null"), compositions.filter("product_id is null")
    own = _layer(current.filter("product_id is not null"), own_elements, "product_id", "product")
    heat = _layer(current.filter("product_id is null and heat_id is not null"), shared, "heat_id", "heat")
    # The narrow layer of the rolls first: what a heat holds meets its rolls last and is not moved again with them.
    df = products.join(own, "product_id", "left").join(heat, "heat_id", "left")

    kind = "map<string,struct<value:string,scope:string,observation_id:bigint>>"
    layer = lambda name: f"coalesce({name}, cast(map() as {kind}))"
    df = df.withColumn("_seen", F.expr(f"map_zip_with({layer('_product')}, {layer('_heat')}, (k, a, b) -> coalesce(a, b))"))
    no_elements = "cast(map() as map<string,decimal(18,8)>)"
    stored = f"coalesce(_heat_elements, {no_elements})"
    if "_product_elements" in df.columns:
        own_elements = f"coalesce(_product_elements, {no_elements})"
        stored = f"map_zip_with({own_elements}, {stored}, (k, a, b) -> if(map_contains_key({own_elements}, k), a, b))"
    df = df.withColumn("_stored_elements", F.expr(stored))
    observed = f"map_filter(_seen, (k, v) -> startswith(k, '{ELEMENT}'))"
    df = df.withColumn("_elements", F.expr(f"transform_keys({observed}, (k, v) -> substring(k, {len(ELEMENT) + 1}))"))
    composition = F.expr("map_zip_with(_elements, _stored_elements, (k, a, b) -> if(a is not null, try_cast(a.value as decimal(18,8)), b))")

    def stored_fact(name: str) -> Column:
        return F.col(name) if name in products.columns else F.lit(None)

    def layered(path: str, below: Column, kind: str) -> Column:
        found = F.col("_seen")[path]
        return F.when(found.isNotNull(), found["value"].try_cast(kind)).otherwise(below.cast(kind))

    faces = [layered(path, stored_fact(path.replace(".", "_")), "decimal(18,6)") for path in FACES]
    facts = {name: layered(PATHS.get(name, name), stored_fact(name), kind) for name, kind in FACT_TYPES.items()}
    metal = facts["coating_metal"]
    facts["coated"] = layered("coated", F.when(metal != "", F.lit(True)).otherwise(stored_fact("coated").cast("boolean")), "boolean")
    facts["coating_both_sides"] = _both_sides(*faces)
    if "condition" in products.columns:
        facts["pickled"] = layered("pickled", _pickled(F.col("condition")), "boolean")
    facts["composition_pct"] = composition

    kinds = {PATHS.get(name, name): kind for name, kind in FACT_TYPES.items() if kind != "string" and name not in ("composition_pct", "coating_both_sides")}
    kinds |= {path: "decimal(18,6)" for path in FACES}
    bad = [F.when(F.col("_seen")[path]["value"].isNotNull() & F.col("_seen")[path]["value"].try_cast(kind).isNull(), F.lit(path)) for path, kind in kinds.items()]
    bad_elements = F.expr(f"transform(map_keys(map_filter(_elements, (k, v) -> v.value is not null and try_cast(v.value as decimal(18,8)) is null)), k -> concat('{ELEMENT}', k))")
    used = {"condition", *(p.replace(".", "_") for p in FACES)}
    return df.select(
        *[F.col(c) for c in products.columns if c not in FACT_TYPES and c not in used], *[column.alias(name) for name, column in facts.items()],
        F.transform_values("_seen", lambda k, v: F.struct(v["scope"].alias("scope"), v["observation_id"].alias("observation_id"))).alias("overrides"),
        F.concat(F.array_compact(F.array(*bad)), bad_elements).alias("unreadable"))
