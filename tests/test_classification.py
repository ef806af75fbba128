"""Rule boundaries on literal facts: inclusive and exclusive limits, and missing never read as zero."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millspark.functions import refdata as ref
from millspark.operators import classification as cl

LOW = {e: Decimal("0.00001") for e, _ in ref.ALLOY_THRESHOLDS} | {"C": Decimal("0.05")}
BASE = dict(form="flat_rolled", coiled=True, rolling="cold", width_mm=Decimal(1000), thickness_mm=Decimal(2), coated=False,
            yield_strength_mpa=Decimal(300), composition_pct=LOW)


def frame(spark, rows):
    schema = "product_id bigint, " + ", ".join(f"{c} {t}" for c, t in cl.FACT_TYPES.items())
    data = []
    for i, changes in enumerate(rows):
        facts = {**BASE, **changes}
        data.append((i, *[facts.get(c) for c in cl.FACT_TYPES]))
    return spark.createDataFrame(data, schema)


def families(spark, compositions):
    rows = cl.steel_family(frame(spark, [{"composition_pct": c} for c in compositions])).orderBy("product_id").collect()
    return [r["family_state"] for r in rows]


def results(spark, rows):
    out = cl.results(cl.scenario_decisions(frame(spark, rows), ref.catalog(spark))).orderBy("product_id").collect()
    return [(r["outcome"], r["fraction"], r["nico"], list(r["missing"])) for r in out]


def test_every_threshold_is_inclusive(spark):
    step = Decimal("0.00000001")
    cases = [{**LOW, e: Decimal(v) + d} for e, v in ref.ALLOY_THRESHOLDS for d in (-step, 0 * step, step)]
    assert families(spark, cases) == ["non_alloy", "other_alloy", "other_alloy"] * len(ref.ALLOY_THRESHOLDS)


def test_family_edges(spark):
    stainless = {**LOW, "Cr": Decimal("10.5"), "C": Decimal("1.2")}
    got = families(spark, [
        stainless, {**stainless, "Cr": Decimal("10.49999999")}, {**stainless, "C": Decimal("1.20000001")}, {**LOW, "C": Decimal("2")}, {**LOW, "C": Decimal("2.00000001")},
        {**LOW, "W": None}, {**LOW, "Al_total": None, "Al_soluble": Decimal("0.3")}, {**LOW, "Al_total": None, "Al_soluble": Decimal("0.2")},
        {**LOW, "Sb": Decimal("0.1")}, {**LOW, "Sb": Decimal("0.09")}, {**LOW, "N": Decimal("0.5")}, {**LOW, "C": None}, {**LOW, "C": None, "Mn": Decimal("1.65")}])
    assert got == ["stainless", "other_alloy", "other_alloy", "non_alloy", "exception", "unproven", "other_alloy", "unproven", "other_alloy",
                   "non_alloy", "non_alloy", "carbon_missing", "ambiguous"]


def test_branch_limits(spark):
    d = Decimal
    got = results(spark, [
        {}, {"yield_strength_mpa": d(355)}, {"yield_strength_mpa": None}, {"thickness_mm": d(1)}, {"thickness_mm": d("0.5")}, {"thickness_mm": d("0.360999")},
        {"thickness_mm": d("0.361")}, {"thickness_mm": d(3), "porcelain_exposed_parts": False}, {"width_mm": d("599.999999")},
        {"rolling": "hot", "pattern_in_relief": True, "thickness_mm": d("4.75")}, {"rolling": "hot", "pattern_in_relief": True, "thickness_mm": d("4.750001")}])
    assert [(g[1], g[2]) for g in got] == [
        ("72091601", "99"), ("72091601", "01"), ("72091601", None), ("72091701", "99"), ("72091701", "99"), ("72091801", "01"), ("72091801", "99"),
        ("72091504", "99"), ("72112303", None), ("72081003", None), ("72081003", "02")]
    assert got[9][3] == ["source_boundary_4_75_mm"] and got[2][0] == "needs_review" and got[0][0] == "classified"


def test_doubled_code_never_resolves(spark):
    steel = {**LOW, "Cr": Decimal(18)}
    outcome, fraction, nico, missing = results(spark, [{"composition_pct": steel, "thickness_mm": Decimal("0.8")}])[0]
    assert (outcome, fraction, nico) == ("needs_review", "72193502", None) and "ambiguous_source_code_7219_35_02" in missing


def test_unknown_rolling_is_offered_only_when_both_sides_stand(spark):
    facts = frame(spark, [{"rolling": None, "pattern_in_relief": False, "pickled": True}, {"rolling": None}])
    out = cl.classify(facts, ref.catalog(spark))
    rows = out["candidates"].orderBy("product_id", "rank").collect()
    assert [(r["product_id"], r["rank"], r["fraction"] + r["nico"]) for r in rows] == [(0, 1, "7209160199"), (0, 2, "7208270199")]
    assert all("rolling" in r["missing_fields"] for r in rows)
    assert {r["outcome"] for r in out["results"].collect()} == {"needs_review"}


def test_ranks_are_contiguous_and_removed_facts_never_match(spark):
    rows = [{"composition_pct": {**LOW, "B": Decimal("0.001")}, "tool_steel": v, "thickness_mm": t} for v in (None, True, False) for t in (Decimal("0.4"), Decimal(2), Decimal(6))]
    out = cl.classify(frame(spark, rows), ref.catalog(spark))
    ranks = {}
    for r in out["candidates"].collect():
        ranks.setdefault(r["product_id"], []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 3 for v in ranks.values())
    known = out["results"].filter("outcome = 'classified'").select("product_id")
    assert known.filter("product_id < 3").count() == 0


@pytest.mark.parametrize("scale", [1])
def test_relational_and_expression_nico_agree(spark, scale):
    rows = [{"coiled": c, "thickness_mm": t, "tool_steel": k, "high_speed_steel": k, "stainless_series": s} for c in (True, False, None) for t in (Decimal("0.5"), Decimal(4), None)
            for k in (True, False, None) for s in ("200", "other", None)]
    facts = cl.complete_facts(frame(spark, rows))
    evaluated = cl.evaluate_nico(facts, ref.nico_conditions(spark))
    relational = evaluated.filter("not (fraction = '72255091' and nico in ('91', '92'))").unionByName(cl.residual_nico(evaluated, facts))
    wide = cl.with_short_names(facts).join(relational.select("product_id", "fraction", "nico", "outcome"), "product_id")
    assert cl.assess_codes(wide).filter("not (assessment <=> outcome)").count() == 0


def exchanges(df):
    return sum("Exchange hashpartitioning" in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_nico_outcomes_need_no_shuffle_by_roll_and_every_operator_counts(spark):
    facts = cl.complete_facts(frame(spark, [{"thickness_mm": Decimal(t), "coiled": c} for t in (1, 2, 3) for c in (True, None)] + [{"thickness_mm": None, "coiled": False}]))
    table = [("A", op, 1, "thickness_mm", op, "2") for op in ("<", "<=", ">", ">=", "=")] + [("B", "=", 1, "coiled", "=", "true"), ("B", "=", 2, "thickness_mm", ">", "1"), ("C", "x", 1, "coiled", ">", "true"), ("D", "x", 1, "no such fact", "=", "1")]
    evaluated = cl.evaluate_nico(facts, spark.createDataFrame(table, "fraction string, nico string, position int, field string, op string, value string"))
    # Only the condition table is shuffled.
    assert exchanges(evaluated) == 1
    got = {}
    for r in evaluated.join(facts, "product_id").collect():
        got.setdefault((r["fraction"], r["nico"]), {})[r["thickness_mm"] and int(r["thickness_mm"]), r["coiled"]] = r["outcome"]
    words = {True: "matched", False: "conflict", None: "unknown"}
    tests = {"<": lambda t: t < 2, "<=": lambda t: t <= 2, ">": lambda t: t > 2, ">=": lambda t: t >= 2, "=": lambda t: t == 2}
    for op, test in tests.items():
        assert got["A", op] == {(t, c): words[test(t)] for t in (1, 2, 3) for c in (True, None)} | {(None, False): "unknown"}
    assert got["B", "="] == {(1, True): "conflict", (1, None): "conflict", (2, True): "matched", (2, None): "unknown", (3, True): "matched", (3, None): "unknown", (None, False): "conflict"}
    assert set(got["C", "x"].values()) == {"conflict"} and len(got) == 7


def test_residual_codes_need_rows_of_their_own_fraction(spark):
    evaluated = spark.createDataFrame([(1, "72255091", "92", "conflict"), (2, "72104999", "01", "unknown"), (2, "72104999", "02", "matched"), (3, "72255091", "01", "conflict"), (3, "72255091", "91", "unknown")], "product_id long, fraction string, nico string, outcome string")
    facts = spark.createDataFrame([(4, "other")], "product_id long, stainless_series string")
    residual = cl.residual_nico(evaluated, facts)
    assert exchanges(residual) == 1
    got = sorted(tuple(r) for r in residual.filter("product_id < 4").collect())
    # Roll 1 has no row of the specific codes and none of 91, so only what its own rows give.
    assert got == [(1, "72255091", "92", "conflict"), (1, "72255091", "99", "matched"), (2, "72104999", "99", "conflict"),
                   (3, "72255091", "91", "unknown"), (3, "72255091", "92", "matched"), (3, "72255091", "99", "conflict")]
    assert residual.filter("product_id = 4 and outcome = 'matched'").count() == 5


def test_every_code_by_its_own_expression_agrees_with_the_lookup(spark):
    rows = [{"coiled": c, "thickness_mm": t, "tool_steel": k, "pattern_in_relief": k, "yield_strength_mpa": t and t * 100} for c in (True, None) for t in (Decimal("0.5"), Decimal(4), None) for k in (True, False, None)]
    facts = cl.with_short_names(cl.complete_facts(frame(spark, rows)))
    codes = sorted({(r[2], r[3]) for r in ref.catalog_rows() if r[0] == "nico"})
    every = cl.assess_every(facts, codes)
    assert "transform(" not in every._jdf.queryExecution().analyzed().toString()
    looked_up = cl.assess_codes(facts.join(spark.createDataFrame(codes, "fraction string, nico string"))).select("product_id", "fraction", "nico", "assessment")
    assert every.count() == len(rows) * len(codes) and every.exceptAll(looked_up).count() == 0


def test_facts_are_shuffled_by_roll_and_candidates_are_not(spark):
    facts = spark.read.schema(cl.complete_facts(frame(spark, [{}])).schema).parquet(written(frame(spark, [{"rolling": None}, {"rolling": "hot"}, {"rolling": None, "coated": None}])))
    pairs = cl.scenario_candidates(cl.scenario_decisions(cl.by_roll(facts), ref.catalog(spark)), ref.catalog(spark))
    by_key = lambda df: sum("Exchange hashpartitioning(product_id" in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())
    assert by_key(pairs) == 1 and by_key(cl.rolling_alternatives(pairs)) == 1
    # A filter on the open rolling reaches the facts, before their shuffle.
    plan = cl.rolling_alternatives(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan[plan.index("RepartitionByExpression"):]


def written(df):
    import tempfile
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/facts"
    cl.complete_facts(df).write.parquet(path)
    return path
