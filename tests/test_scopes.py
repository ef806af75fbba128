"""Rolls against results as sets, observations of heats, and issues that meet rolls once."""

from millspark.operators import history as h, quality as q, review as rv


def test_missing_foreign_and_doubled_rolls_differ(spark):
    runs = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "run_id long, certificate_id long")
    products = spark.createDataFrame([(c * 10 + k, c, c) for c in (1, 2, 3, 4) for k in (1, 2)], "product_id long, certificate_id long, heat_id long")
    heats = spark.createDataFrame([(c, c) for c in (1, 2, 3, 4)], "heat_id long, certificate_id long")
    pairs = [(1, 11), (1, 12), (2, 21), (2, 99), (3, 31), (3, 31), (4, 41)]
    results = spark.createDataFrame([(i, r, p, "classified", "72091601", "01") for i, (r, p) in enumerate(pairs)],
                                    "result_id long, run_id long, product_id long, outcome string, fraction string, nico string")
    chosen = results.selectExpr("result_id", "result_id as candidate_id")
    blocked = spark.createDataFrame([], "candidate_id long")
    got = {r["run_id"]: r["reasons"] for r in rv.approval_eligibility(runs, products, heats, results, chosen, chosen, blocked).collect()}
    assert got == {1: "", 2: "products_differ", 3: "products_differ", 4: "products_differ"}


def test_heat_observations_reach_rolls_and_own_ones_win(spark):
    products = spark.createDataFrame([(1, 7, 2.0), (2, 7, 2.0), (3, 8, 2.0)], "product_id long, heat_id long, width_mm double")
    chemistry = spark.createDataFrame([(1, "C", 0.1)], "product_id long, element string, percentage double").selectExpr("product_id", "element", "cast(percentage as decimal(18,8)) as percentage")
    observations = spark.createDataFrame([(1, 7, "width_mm", 5.0, 1, True), (None, 7, "width_mm", 9.0, 2, True), (None, 7, "width_mm", 11.0, 3, False), (None, 7, "composition_pct.C", None, 4, True)],
                                         "product_id long, heat_id long, field_path string, normalized_value double, observation_id long, is_current boolean")
    rows, elements = h.overlay_observations(products, chemistry, observations, {"width_mm": "width_mm"})
    assert {r["product_id"]: r["width_mm"] for r in rows.collect()} == {1: 5.0, 2: 9.0, 3: 2.0}
    assert {(r["product_id"], r["element"], r["percentage"]) for r in elements.collect()} == {(1, "C", None), (2, "C", None)}


def test_repeated_issues_meet_each_roll_once(spark):
    products = spark.range(50).selectExpr("id as product_id", "1L as certificate_id", "1L as heat_id", "'H' as heat_no")
    issues = spark.range(10_000).selectExpr("if(id % 2 = 0, 'certificate', 'heat') as scope", "1L as certificate_id", "cast(null as long) as product_id", "if(id % 2 = 0, string(id), 'H') as entity", "'low_confidence_field' as code", "'warning' as severity")
    attached = q.attach_issues(issues, products)
    assert attached.count() == 50
    # One reduction under the heat join, one under the certificate join, one over both.
    assert attached._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") >= 3


def test_deletion_reaches_every_observation_the_chain_and_the_logs(spark):
    def table(columns, *rows):
        return spark.createDataFrame(list(rows), ", ".join(f"{c} long" for c in columns.split()))
    certificates, ids = table("certificate_id stored_file_id", (1, 5), (2, 6)), table("certificate_id", (1,))
    heats, products = table("heat_id certificate_id", (10, 1), (20, 2)), table("product_id heat_id certificate_id", (11, 10, 1), (21, 20, 2))
    observations = table("observation_id product_id heat_id certificate_id", (1, 11, 10, 1), (2, None, 10, 1), (3, None, None, 1), (4, 21, 20, 2), (5, None, 20, 2), (6, None, None, 2))
    related = {"runs": table("run_id certificate_id", (1, 1), (2, 2)), "results": table("result_id run_id", (1, 1), (2, 2)), "candidates": table("candidate_id result_id", (1, 1), (2, 2)),
               "factors": table("factor_id candidate_id", (1, 1), (2, 2)), "steps": table("step_id result_id", (1, 1), (2, 2)),
               "links": table("link_id factor_id step_id observation_id", (1, 1, None, 1), (2, None, 1, 4), (3, None, None, 3), (4, 2, 2, 4)),
               "selections": table("selection_id result_id", (1, 1), (2, 2)), "approvals": table("event_id run_id", (1, 1), (2, 2)),
               "corrections": table("correction_id product_id heat_id certificate_id", (1, 11, 10, 1), (2, None, 10, 1), (3, None, None, 1), (4, None, 20, 2))}
    got = sorted((r["table_name"], r["id"]) for r in h.deletion_scope(certificates, heats, products, observations, ids, related).collect())
    one = [(name, 1) for name in ("approvals", "candidates", "certificates", "factors", "results", "runs", "selections", "steps")]
    assert got == sorted(one + [("files", 5), ("heats", 10), ("products", 11)] + [(name, i) for name in ("observations", "corrections", "links") for i in (1, 2, 3)])


def test_a_cited_value_is_computed_once(spark):
    from millspark.operators import layout as ly
    cells = spark.createDataFrame([(1, 1, 0, 1, 0, "K1"), (1, 1, 0, 1, 1, "12,5"), (1, 1, 0, 2, 0, "K2"), (1, 1, 0, 2, 1, "900")], "doc_id long, page int, table_idx int, row_idx int, col_idx int, text string")
    heads = spark.createDataFrame([(1, 1, 0, 0, 0, "Coil", "product_id", "product_id"), (1, 1, 0, 0, 1, "Width mm", "dimension", "width_mm")], "doc_id long, page int, table_idx int, row_idx int, col_idx int, header string, category string, key string")
    proposals = spark.sql("""SELECT * FROM VALUES (1L, 1L, 1, 0, 1, 1, 0, 1, '12,5', 'width_mm', 'K1', cast(12.5 AS decimal(18,8))), (2L, 1L, 1, 0, 2, 1, 0, 1, '900', 'width_mm', 'K2', cast(1 AS decimal(18,8))), (3L, 1L, 1, 0, 2, 1, 0, 1, '900', 'width_mm', 'K1', cast(900 AS decimal(18,8)))
      AS v(proposal_id, doc_id, page, table_idx, row_idx, col_idx, header_row, header_col, raw_value, field_path, product_id, current_value)""")
    found = ly.verify_cited_values(proposals, cells, heads)
    assert {(r["proposal_id"], r["reason"], r["status"], r["verified_value"] and float(r["verified_value"])) for r in found.collect()} == {
        (1, None, "matches", 12.5), (2, None, "discrepancy", 900.0), (3, "row_not_of_product", "not_verifiable", None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("AS status" in line and "regexp_extract" in line for line in plan.splitlines())


def test_the_closure_reads_the_chain_of_results_from_one_copy(spark, monkeypatch):
    from workload import history, registry  # noqa: F401  (registers the query)
    written = []
    write = registry.staged
    monkeypatch.setattr(registry, "staged", lambda df: written.append(df.columns[0]) or write(df))
    registry.QUERIES["deletion_closure"](spark, "/root/testdata/sf0.001")
    assert written == ["product_id", "result_id", "link_id"]


def test_a_percentage_is_read_once_for_ranges_and_sums(spark):
    from millspark.operators.quality import chemistry_issues
    rows = spark.createDataFrame([(1, 10, None, "C", "60"), (1, 10, None, "Mn", "50.5"), (1, 10, None, " ", "99"), (1, 10, 5, "C", "101"), (1, 11, 5, "Si ", "tr"), (1, 11, 5, "Mn", "60"), (1, 12, 5, "Cr", "41"), (2, 20, None, "C", None), (2, 20, None, "B", "-1")],
                                 "certificate_id long, heat_id long, product_id long, element string, percentage string")
    found = chemistry_issues(rows)
    # Once per reader of the rows: for their ranges, and for their sums.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("as decimal(18,8)") == 2
    got = sorted((r["certificate_id"], r["product_id"] or 0, r["scope"], r["entity"], r["code"], r["field_path"]) for r in found.collect())
    assert got == [(1, 0, "heat", "10", "chemical_sum_exceeds_100", "composition_pct"), (1, 5, "product", "5", "chemical_percentage_out_of_range", "composition_pct.C"),
                   (1, 5, "product", "5", "chemical_sum_exceeds_100", "composition_pct"), (1, 5, "product", "5", "invalid_chemical_format", "composition_pct.Si"),
                   (2, 0, "heat", "20", "chemical_percentage_out_of_range", "composition_pct.B")]


def test_issues_that_several_steps_read_are_written_once(spark, monkeypatch):
    from workload import quality, registry
    write, written = quality.staged, []
    monkeypatch.setattr(quality, "staged", lambda df: written.append(df.columns) or write(df))
    for name in ("issues_by_roll", "review_queue"):
        found = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "incoherent_unit" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert written == [["certificate_id", "product_id", "scope", "entity", "code", "severity", "field_path"]] * 2


def test_deletion_follows_the_chain_once(spark):
    from pyspark.sql import functions as F
    seen = spark.sparkContext.accumulator(0)

    def read(key):
        seen.add(1)
        return key

    def table(columns, *rows):
        return spark.createDataFrame(list(rows), ", ".join(f"{c} long" for c in columns.split()))
    certificates = table("certificate_id stored_file_id", (1, 1), (2, 2))
    related = {"runs": table("run_id certificate_id", (10, 1), (20, 2)).withColumn("run_id", F.udf(read, "long").asNondeterministic()("run_id")), "results": table("result_id run_id", (100, 10), (200, 20)),
               "candidates": table("candidate_id result_id", (1000, 100), (2000, 200)), "factors": table("factor_id candidate_id", (1, 1000), (2, 2000)), "links": table("link_id factor_id observation_id", (5, 1, 9), (6, 2, 7)),
               "selections": table("selection_id result_id", (3, 100), (4, 200)), "approvals": table("event_id run_id", (7, 10), (8, 20))}
    found = h.deletion_scope(certificates, table("heat_id certificate_id", (1, 1)), table("product_id certificate_id", (1, 1)), table("observation_id product_id heat_id certificate_id", (9, 1, None, 1)), table("certificate_id", (1,)), related)
    got = {(r["table_name"], r["id"]) for r in found.collect()}
    assert {("runs", 10), ("results", 100), ("candidates", 1000), ("factors", 1), ("links", 5), ("selections", 3), ("approvals", 7)} <= got and ("runs", 20) not in got
    assert seen.value <= 2


def test_element_rows_meet_the_table_of_their_own_kind(spark):
    from millspark.operators import report as rp
    ids = lambda key, *values: spark.createDataFrame([(v,) for v in values], f"{key} long")
    rows = spark.createDataFrame([(1, None, None, "C", 0.1), (1, 11, None, "Mn", 0.2), (8, None, None, "C", 0.3), (None, 10, None, "Si", 0.4), (None, None, 1, "Cr", 0.5), (9, None, None, "Ni", 0.6), (None, None, 2, "Mo", 0.7), (None, None, None, "W", 0.8)],
                                 "product_id long, heat_id long, certificate_id long, element string, percentage double")
    products = spark.createDataFrame([(1, 10, "R1")], "product_id long, heat_id long, product_identifier string")
    heats = spark.createDataFrame([(10, "H10"), (11, "H11")], "heat_id long, heat_no string")
    sheet = rp.composition_sheet(rows, products, heats, ids("certificate_id", 1))
    got = {(r["element"], r["heat_id"], r["product_id"], r["colada"], r["serie_rollo"]) for r in sheet.collect()}
    assert got == {("C", None, 1, "H10", "R1"), ("Mn", 11, 1, "H11", "R1"), ("Si", 10, None, "H10", None), ("Cr", None, None, None, None)}
    # An outer join by roll would bring all rows without one to a single task.
    assert "LeftOuter, (product_id" not in sheet._jdf.queryExecution().optimizedPlan().toString()


def test_standing_selections_are_found_without_moving_them_again(spark):
    rows = [(1, 10, None, False, "a"), (2, 10, 1, False, "b"), (3, 10, 2, False, "c"), (4, 20, 5, False, "d"), (5, 20, None, False, "e"), (6, 30, None, True, "f"), (7, 30, None, False, "g"), (8, 40, 9, None, "h"), (9, 50, None, None, "i"), (10, None, None, False, "j"), (11, 60, 11, False, "k")]
    selections = spark.createDataFrame(rows, "selection_id long, result_id long, supersedes_selection_id long, selection_cleared boolean, person_name string")
    got = {(r["result_id"], r["selection_id"], r["person_name"]) for r in h.current_selections(selections).collect()}
    # 4 replaces 5 though it is older; 8 names a selection of another result, which stands; 11 replaces itself.
    assert got == {(10, 3, "c"), (20, 4, "d"), (40, 8, "h"), (50, 9, "i")}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scoped = selections.join(selections.select("result_id").distinct(), "result_id", "left_semi")
        exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert exchanges(h.current_selections(scoped)) == exchanges(scoped)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_sheet_takes_the_identifier_along_and_keeps_codes_short(spark):
    from millspark.operators import report as rp
    make = spark.createDataFrame
    products = make([(1, 10, "R1"), (2, 10, "R2")], "product_id long, heat_id long, product_identifier string")
    observations = make([(5, 1, None)], "observation_id long, product_id long, heat_id long")
    evidence = h.first_evidence(products, observations, ["product_identifier"])
    results = make([(100, 7, 1, "needs_review", None, None)], "result_id long, run_id long, product_id long, outcome string, fraction string, nico string")
    candidates = make([(1001, 100, 1, "72091601", None), (1002, 100, 2, "72091701", "01")], "candidate_id long, result_id long, rank int, fraction string, nico string")
    factors = make([(1001, 2, "b", "matched"), (1001, 1, "a", "unknown"), (9, 1, "x", "matched")], "candidate_id long, sequence int, rule_code string, outcome string")
    selections = make([], "selection_id long, result_id long, candidate_id long, supersedes_selection_id long, selection_cleared boolean, person_name string, created_at timestamp")
    sheet = rp.classification_sheet(products, results, make([(7, "approved")], "run_id long, approval_status string"), candidates, factors, selections, evidence)
    rows = {r["product_id"]: r for r in sheet.collect()}
    assert [(rows[p]["rollo_identificador"], rows[p]["evidencia"], rows[p]["candidato_elegido"]) for p in (1, 2)] == [("R1", "Ver evidencia", "Pendiente de selección"), ("R2", "Sin evidencia", "Sin clasificación")]
    assert (rows[1]["alternativa_2"], rows[1]["alternativa_3"], rows[1]["factores_clave"], rows[1]["todos_los_candidatos"]) == ("72091701-01", "—", "a: unknown; b: matched", "72091601: ; 72091701-01: ")


def test_cells_meet_few_headers_without_being_gathered_by_sheet(spark):
    from millspark.operators import tables as tb
    cells = spark.createDataFrame([("S", 3, 1, "Width (mm)", False), ("S", 3, 2, "THICK", False), ("S", 3, 3, "HEAT NO", False), ("S", 2, 1, "7", False), ("S", 4, 1, "1000", False), ("S", 4, 2, "1.5", False), ("S", 4, 3, "H1", False),
                                   ("S", 5, 1, "900", False), ("S", 5, 2, "2", True), ("S", 6, 4, "5", False), ("T", 4, 1, "1000", False)], "sheet string, row int, col int, value string, is_formula boolean")
    products = tb.sheet_products(cells)[0]
    plan = products._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
    assert {(r["product_id"], str(r["width_mm"]), r["thickness_mm"] is None, r["heat_no"]) for r in products.collect()} == {("S!row-4", "1000.000000", False, "H1"), ("S!row-5", "900.000000", True, None)}
