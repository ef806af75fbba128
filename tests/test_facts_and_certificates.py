"""Layers of facts, raw rows to tables, page recovery and templates on small inputs with results written by hand."""

from decimal import Decimal

from pyspark.sql import functions as F

from millspark.operators import certificates as ce, classification as cl, facts as fa, recovery as rv, templates as tp

D = Decimal


def test_layers_of_facts(spark):
    products = spark.sql("""SELECT * FROM VALUES (1L, 7L, 'flat_rolled', cast(900 AS decimal(18,6)), cast(null AS string), array('Pickled'), cast(50 AS decimal(18,6)), cast(40 AS decimal(18,6))),
      (2L, 7L, 'bar', cast(null AS decimal(18,6)), 'Zn', array('oiled', 'unpickled'), cast(0 AS decimal(18,6)), cast(null AS decimal(18,6))), (3L, 8L, 'bar', cast(5 AS decimal(18,6)), '', cast(null AS array<string>), cast(null AS decimal(18,6)), cast(null AS decimal(18,6)))
      AS v(product_id, heat_id, form, width_mm, coating_metal, condition, coating_superior_g_m2, coating_inferior_g_m2)""")
    chemistry = spark.createDataFrame([(7, None, "C", D("0.1")), (7, None, "Mn", D("1")), (7, 2, "C", None), (8, None, "C", D("0.3"))], "heat_id long, product_id long, element string, percentage decimal(18,8)")
    observations = spark.createDataFrame([
        (1, 1, 7, "width_mm", "1000.5", True), (2, None, 7, "width_mm", "1200", True), (3, None, 7, "width_mm", "1300", False), (4, 2, 7, "form", None, True), (5, None, 7, "form", "flat_rolled", True),
        (6, None, 7, "composition_pct.Mn", None, True), (7, 1, 7, "composition_pct.Cr", "tr", True), (8, None, 8, "coating.metal", "Sn", True), (9, None, 8, "coiled", "perhaps", True),
        (10, 1, 7, "pickled", "false", True), (11, 1, 7, "pickled", "true", True), (12, 1, 7, "coating.inferior_g_m2", None, True)],
        "observation_id long, product_id long, heat_id long, field_path string, value string, is_current boolean")
    got = {r["product_id"]: r for r in fa.assemble_facts(products, chemistry, observations).collect()}
    assert [got[i]["width_mm"] for i in (1, 2, 3)] == [D("1000.5"), D("1200"), D("5")]
    assert [got[i]["form"] for i in (1, 2, 3)] == ["flat_rolled", None, "bar"]
    assert got[1]["composition_pct"] == {"C": D("0.1"), "Mn": None, "Cr": None} and got[2]["composition_pct"] == {"C": None, "Mn": None} and got[3]["composition_pct"] == {"C": D("0.3")}
    assert [(got[i]["coating_metal"], got[i]["coated"]) for i in (1, 2, 3)] == [(None, None), ("Zn", True), ("Sn", True)]
    assert [got[i]["pickled"] for i in (1, 2, 3)] == [True, False, None] and [got[i]["coating_both_sides"] for i in (1, 2, 3)] == [None, False, None]
    assert [sorted(got[i]["unreadable"]) for i in (1, 2, 3)] == [["composition_pct.Cr"], [], ["coiled"]] and got[3]["coiled"] is None
    assert got[1]["overrides"]["width_mm"] == ("product", 1) and got[2]["overrides"]["width_mm"] == ("heat", 2) and got[1]["overrides"]["pickled"] == ("product", 11)
    assert got[1]["magnetic_loss_w_per_kg"] is None


def raw_rows(spark, rows):
    names = ("product_identifier", "heat_no", "thickness_mm", "width_mm", "length_raw", "quantity", "weight_kg")
    empty = [f"cast(null AS string) AS {c}" for c in (
        "label_no", "net_weight_kg", "gross_weight_kg", *ce.MECHANICAL, "coating_metal", "coating_superior_g_m2", "coating_inferior_g_m2", "rolling", "standard")]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows, 1)], "certificate_id long, row_pos int, " + ", ".join(f"{n} string" for n in names) + ", chemistry map<string,string>, row_scales map<string,string>")
    docs = spark.sql("""SELECT 1L AS certificate_id, 'cold' AS rolling, array('oiled') AS condition, 'Zn' AS coating_metal, cast(null AS string) AS coating_process, cast(null AS string) AS coating_post_treatment,
      'SAE 1010' AS standard, cast(null AS string) AS grade, 'mill' AS edge_condition, map('C', '10^-2', 'Mn', '-1') AS chemistry_scales""")
    return docs, df.selectExpr("*", *empty)


def test_rows_become_five_tables(spark):
    rows = [("A", "H1", "1.5", "1000", "COIL", "1", "10", {"C": "5", "Mn": "3"}, None), ("B", '"', '"', "ditto", "同上", None, "20", {"C": '"', "Mn": "3"}, None), ("C", "H1", "2", "900", "6.5", "2", None, {"Mn": "3"}, None),
            ("D", "H2", "2", "900", None, '"', None, {"C": '"', "Mn": "3"}, None), ("E", "H2", "x", "900", None, "0", None, {"C": "7", "Cr": "1"}, {"carbon": "-4"}), ("E", None, "2", "900", None, "-1", None, {}, None),
            (" ", None, "2", "900", None, "1", None, {"C": "9"}, {"C": "0"})]
    normalized = ce.normalize_rows(*raw_rows(spark, rows))
    errors = {(r["row_pos"], r["field"], r["error"]) for r in ce.row_errors(normalized).collect()}
    assert errors == {(4, "composition_pct.C", "repeat_without_value"), (5, "thickness_mm", "not_numeric"), (5, "composition_pct.Cr", "no_scale"), (5, "product_id", "duplicate_identifier"),
                      (6, "product_id", "duplicate_identifier"), (6, "quantity", "invalid_quantity"), (7, "product_id", "missing_identifier")}
    tables = {name: df.collect() for name, df in ce.certificate_tables(normalized).items()}
    # C lacks carbon, so the heat's rolls differ and each keeps its own.
    assert [(r["heat_no"], r["rolls"], r["shared"], r["grade"]) for r in tables["heats"]] == [("H1", 3, False, "1010")]
    assert {(r["product_identifier"], r["coiled"], r["length_m"], r["width_mm"], r["quantity"]) for r in tables["rolls"]} == {
        ("A", True, None, D("1000"), 1), ("B", True, None, D("1000"), 1), ("C", False, D("6.5"), D("900"), 2)}
    assert {(r["product_identifier"], r["element"], r["percentage"], r["inherited"]) for r in tables["compositions"]} == {
        ("A", "C", D("0.05"), False), ("A", "Mn", D("0.3"), False), ("B", "C", D("0.05"), True), ("B", "Mn", D("0.3"), False), ("C", "Mn", D("0.3"), False)}
    seen = {(r["product_identifier"], r["field_path"]): r for r in tables["observations"]}
    assert (seen["B", "width_mm"]["raw_value"], seen["B", "width_mm"]["normalized_value"], seen["B", "width_mm"]["inherited_from"]) == ("ditto", "1000.000000", "A")
    assert seen["B", "composition_pct.C"]["inherited_from"] == "A" and ("A", "evidence") not in seen
    assert ("A", "condition", "oiled") in {(r["product_identifier"], r["name"], r["value"]) for r in tables["properties"]}


def test_a_heat_that_agrees_holds_its_composition_once(spark):
    rows = [("A", "H1", "1", "2", "C", "1", None, {"C": "5"}, None), ("B", "H1", "1", "2", "C", "1", None, {"C": "5"}, None), ("X", None, "1", "2", "C", "1", None, {"C": "5"}, None), ("Y", None, "1", "2", "C", "1", None, {}, None)]
    tables = ce.certificate_tables(ce.normalize_rows(*raw_rows(spark, rows)))
    assert {(r["heat_no"], r["product_identifier"], r["element"]) for r in tables["compositions"].collect()} == {("H1", None, "C"), (None, "X", "C")}
    assert tables["compositions"].count() == 2


def test_rows_of_short_documents_stay_together_and_long_ones_are_cut_with_the_same_result(spark, monkeypatch):
    from millspark.functions import keyed
    rows = [("A", "H1", "1", "2", "C", "1", None, {"C": "5", "Mn": "1"}, {"c": "-2"}), ("B", '"', '"', "2", "C", '"', None, {"C": '"', "Mn": "x"}, None), ("A", "H1", "1", '"', "C", "1", None, {}, None), ("C", None, "1", "2", "C", "1", None, {"C": '"'}, None)]
    table = lambda df: sorted(str(r) for r in df.collect())
    docs, raw = raw_rows(spark, rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # The rows are shuffled by document and not again (the one row of docs needs no shuffle).
        whole = ce.normalize_rows(docs, raw)
        assert exchanges(whole) == 1
        short = table(whole), table(ce.row_errors(whole)), {n: table(t) for n, t in ce.certificate_tables(whole).items()}
        monkeypatch.setattr(keyed, "POSITION_SLICE", 2)
        cut = ce.normalize_rows(docs, raw)
        assert exchanges(cut) > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert (table(cut), table(ce.row_errors(cut)), {n: table(t) for n, t in ce.certificate_tables(cut).items()}) == short


def page(spark, *blocks):
    rows = [(1, 1, i, text, float(x0), float(x1), float(top), float(bottom), confidence, 1000.0, 1400.0) for i, (text, x0, x1, top, bottom, confidence) in enumerate(blocks)]
    return spark.createDataFrame(rows, "doc_id long, page int, block_id long, text string, x0 double, x1 double, top double, bottom double, confidence double, page_width double, page_height double")


def test_readings_of_one_place_merge_and_equal_identifiers_stay_apart(spark):
    blocks = page(spark, ("Coil No", 80, 140, 240, 252, 0.9), ("Width", 230, 290, 240, 252, 0.9), ("AB12", 80, 140, 300, 312, 0.4), ("AB72", 82, 141, 301, 311, 0.8), ("1000", 230, 290, 300, 312, 0.9),
                  ("AB72", 80, 140, 330, 342, 0.9), ("900", 230, 290, 330, 342, 0.9), ("grand total 1900123", 80, 140, 360, 372, 0.9))
    got = sorted(tuple(r) for r in rv.recover_geometric_rows(blocks).select("row_id", "product_id", "key", "text").collect())
    assert got == [(1, "AB72", "width_mm", "1000"), (2, "AB72", "width_mm", "900")]


def test_scale_below_the_header_and_two_weights(spark):
    head = [("Pack No", 80, 140, 240, 252, 0.9), ("C", 395, 405, 240, 252, 0.9), ("Si", 545, 555, 240, 252, 0.9), ("Weight", 820, 880, 240, 252, 0.9), ("Bruto", 820, 880, 256, 268, 0.9), ("x10", 380, 420, 262, 274, 0.9), ("3", 397, 403, 276, 288, 0.9)]
    body = [("P123456", 80, 140, 320, 332, 0.9), ("13=", 390, 410, 320, 332, 0.9), ("7", 540, 560, 320, 332, 0.9), ("100", 825, 875, 317, 323, 0.9), ("120", 825, 875, 326, 332, 0.9)]
    got = {r["key"]: (r["text"], r["exponent"]) for r in rv.recover_geometric_rows(page(spark, *head, *body)).collect()}
    assert got == {"C": ("13", -3), "weight_kg": ("100", None), "net_weight_kg": ("100", None), "gross_weight_kg": ("120", None), "label_no": ("P123456", None)}


def test_blocks_are_read_once_and_a_block_between_two_rows_belongs_to_the_lower(spark):
    from pyspark.sql import functions as F
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    blocks = page(spark, ("Coil No", 80, 140, 240, 252, 0.9), ("Width", 230, 290, 240, 252, 0.9), ("C", 395, 405, 240, 252, 0.9), ("%", 390, 410, 256, 268, 0.9), ("AB12", 80, 140, 300, 312, 0.9), ("AB72", 80, 140, 340, 352, 0.9),
                  ("1000", 230, 290, 300, 312, 0.9), ("900", 230, 290, 320, 332, 0.9), ("0.05", 390, 410, 300, 312, 0.9))
    rows = rv.recover_geometric_rows(blocks.withColumn("text", F.udf(read).asNondeterministic()("text")))
    assert sorted(tuple(r) for r in rows.select("product_id", "key", "text", "exponent").collect()) == [("AB12", "C", "0.05", 0), ("AB12", "width_mm", "1000", None), ("AB72", "width_mm", "900", None)]
    assert seen.value == 9


def test_first_table_wins_and_a_later_one_conflicts(spark):
    make = spark.createDataFrame
    mapping = "target string, element string, exponent int, unit string, separator string, required boolean"
    tables = make([(1, k, 1, 100.0 * k, 100.0 * k + 90, 0.0, 100.0, role, "heat_no" if k > 1 else "product_id", 0) for k, role in ((1, "products"), (2, "chemistry"), (3, "chemistry"))],
                  "template_id int, table_id int, page int, x0 double, x1 double, top double, bottom double, role string, join_key string, header_row int")
    columns = make([(1, 1, "Coil", "product_id", None, None, None, ".", True), (1, 1, "Heat", "heat_no", None, None, None, ".", True)]
                   + [(1, k, h, t, e, x, u, ".", True) for k in (2, 3) for h, t, e, x, u in (("Heat", "heat_no", None, None, None), ("C", "chemistry", "C", -2, "%"))], "template_id int, table_id int, header string, " + mapping)
    fields = make([], "template_id int, region_id int, page int, x0 double, x1 double, top double, bottom double, " + mapping)
    grids = {1: [["Coil", "Heat"], ["A1", "H1"], ["A2", "H2"], ["A3", "H9"]], 2: [["heat", "c"], ["H1", "5"], ["H2", "x"], ["H7", "1"]], 3: [["Heat", "C"], ["H1", "6"], ["H2", "8"], ["H9", "9"], ["H9", "9"]]}
    cells = make([(1, 1, k, i, j, text) for k, grid in grids.items() for i, row in enumerate(grid) for j, text in enumerate(row)], "doc_id long, page int, table_idx int, row_idx int, col_idx int, text string")
    found = make([(1, 1, k, 100.0 * k + 5, 100.0 * k + 80, 5.0, 90.0, len(g)) for k, g in grids.items()], "doc_id long, page int, table_idx int, x0 double, x1 double, top double, bottom double, n_rows int")
    got = tp.extract_with_templates(make([(1, 1)], "doc_id long, template_id int"), make([(1, 1, True, True)], "doc_id long, page int, readable boolean, has_content boolean"),
                                    make([], "doc_id long, page int, block_id int, text string, x0 double, x1 double, top double, bottom double"), found, cells, fields, tables, columns)
    values = {(r["row_id"] & 0xFFFF, r["key"]): r["value"] for r in got["values"].collect()}
    assert {k: v for k, v in values.items() if k[1] == "chemistry.C"} == {(1, "chemistry.C"): "5", (2, "chemistry.C"): "8"}
    issues = sorted((r["code"], r["field"]) for r in got["diagnostics"].collect())
    # H2's first value does not read, H7 is nobody's, H9 is doubled in the third table and absent from the second.
    assert issues == [("invalid_number", "chemistry.C"), ("join_ambiguous", "heat_no"), ("join_ambiguous", "heat_no"), ("join_conflict", "chemistry.C"), ("join_missing", "heat_no"), ("join_missing", "heat_no"), ("join_missing", "heat_no")]
    assert got["status"].first()["status"] == "needs_review"
    rows = {r["product_identifier"]: (r["heat_no"], r["chemistry"], r["row_scales"]) for r in tp.certificate_rows(got["values"]).collect()}
    assert rows["A1"] == ("H1", {"C": "5"}, {"C": "-2"}) and rows["A3"] == ("H9", {}, {})


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_chemistry_is_shuffled_once_and_not_again_with_the_rolls(spark):
    rows = spark.createDataFrame([(1, "C", D("0.1")), (1, "C", D("0.3")), (1, "C", None), (1, "Mn", None), (2, "Mn", D("2")), (2, "Mn", D("2")), (2, "Al", D("0"))], "heat_id long, element string, percentage decimal(18,8)")
    maps = fa.composition_maps(rows)
    assert exchanges(maps) == 1
    assert {r["heat_id"]: r["composition_pct"] for r in maps.collect()} == {1: {"C": D("0.3"), "Mn": None}, 2: {"Al": D("0"), "Mn": D("2")}}
    # Rolls meet their own layer first; the last join is the one by heat.
    products = spark.createDataFrame([(1, 1)], "product_id long, heat_id long")
    observations = spark.createDataFrame([], "observation_id long, product_id long, heat_id long, field_path string, value string, is_current boolean")
    with_products = fa.assemble_facts(products, rows.selectExpr("*", "cast(null as bigint) as product_id"), observations)
    joins = [line for line in with_products._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
    assert "heat_id" in joins[0] and "product_id" in joins[1]


def test_a_view_that_several_layers_reach_is_written_once(spark):
    from workload.registry import Tables
    t = Tables(spark, "/root/testdata/sf0.001").write_once("products")
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Window")
    assert reads(t.stored_rolls) == 0 and reads(t.scoped_compositions) == 0
    assert sorted(t.products.collect()) == sorted(Tables(spark, "/root/testdata/sf0.001").products.collect())


def test_a_branch_moves_its_own_facts_only_and_writes_none(spark, monkeypatch):
    from millspark import session
    from workload import registry
    from workload.classification import staged
    written = []
    monkeypatch.setattr(registry, "staged", lambda df: written.append(df) or df)
    monkeypatch.setattr(session, "staged", lambda df: written.append(df) or df)
    narrow = registry.QUERIES["branch_narrow"](spark, "/root/testdata/sf0.001")
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert len(written) == 1 and "product_id" in written[0].columns and "AS can_body_end_use#" not in plan
    # The facts that a branch names are all it needs: the whole set gives the same rows.
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    of = lambda names, *one: {r["product_id"]: r["branch"] for r in cl.branch_result(staged(t, names).filter("heading = '7225'"), *one).select("product_id", "branch").collect()}
    got = of(cl.branch_facts("7225"), "7225")
    assert got and got == of([*cl.FACT_TYPES])


def test_entries_and_readings_of_a_key_meet_in_one_shuffle(spark):
    chemistry = spark.createDataFrame([(7, "C", D("0.1")), (8, "C", D("0.2"))], "heat_id long, element string, percentage decimal(18,8)")
    observations = spark.createDataFrame([(1, 7, "form", "bar"), (2, 7, "form", "flat_rolled"), (3, 9, "form", "bar")], "observation_id long, heat_id long, field_path string, value string")
    layer = fa._layer(observations, chemistry, "heat_id", "heat")
    assert exchanges(layer) == 2
    got = {r["heat_id"]: (r["_heat"], r["_heat_elements"]) for r in layer.collect()}
    assert got == {7: ({"form": ("flat_rolled", "heat", 2)}, {"C": D("0.1")}), 8: ({}, {"C": D("0.2")}), 9: ({"form": ("bar", "heat", 3)}, {})}


def test_views_that_several_inputs_reach_are_written_before_them(spark, monkeypatch):
    from workload import layouts, quality
    from workload.registry import Tables
    seen = []
    monkeypatch.setattr(layouts.tp, "extract_with_templates", lambda *a: seen.append("templates"))
    monkeypatch.setattr(layouts.kl, "read_known_layouts", lambda *a: seen.append("layouts"))
    t = Tables(spark, "/root/testdata/sf0.001")
    layouts.templates(t), layouts.known_layouts(t)
    assert seen == ["templates", "layouts"] and {"fx_raw_rows", "fx_tp_docs", "fx_mill_lines", "fx_known_docs"} <= set(t._written)

    class Stop(Exception):
        pass

    def issues(t):
        assert "fx_products" in t._written
        raise Stop

    monkeypatch.setattr(quality, "issues", issues)
    try:
        quality.outcomes_after_quality(Tables(spark, "/root/testdata/sf0.001"))
    except Stop:
        seen.append("quality")
    assert seen[-1] == "quality"


def test_a_snapshot_is_moved_once(spark):
    from millspark.functions import refdata as ref
    from millspark.operators import replay
    facts = cl.complete_facts(spark.createDataFrame([(1, 7, "bar")], "product_id long, certificate_id long, form string"))
    recorded = replay.record_runs(facts, ref.catalog(spark))
    assert recorded._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    replayed = replay.replay_runs(recorded, facts.select("certificate_id", "product_id"), ref.catalog(spark))
    assert [(r["product_id"], r["replay_error"], r["changed"], r["now_outcome"]) for r in replayed.collect()] == [(1, None, False, "out_of_scope")]


def test_blocks_of_known_layouts_meet_pages_that_know_their_document(spark):
    from millspark.operators import known_layouts as kl
    docs = spark.createDataFrame([(1, "A"), (2, None)], "doc_id long, profile string")
    pages = spark.createDataFrame([(1, 2, 10.0, 20.0, 0), (1, 3, 11.0, 21.0, 90), (2, 1, 1.0, 1.0, 0)], "doc_id long, page int, width double, height double, rotation int")
    blocks = spark.createDataFrame([(1, 2, 1, " x ", 0.0, 1.0, 0.0, 1.0), (1, 3, 2, None, 0.0, 1.0, 0.0, 1.0), (2, 1, 3, "y", 0.0, 1.0, 0.0, 1.0)], "doc_id long, page int, block_id long, text string, x0 double, x1 double, top double, bottom double")
    got = kl.known_blocks(docs, pages, blocks)
    assert sorted((r["block_id"], r["text"], r["profile"], r["page_width"], r["first_page"]) for r in got.collect()) == [(1, "x", "A", 10.0, True), (2, "", "A", 11.0, False)]
