import pytest
from pyspark.sql import functions as F

from millspark.functions import text as tx
from millspark.operators import catalog as ct
from millspark.operators import reconstruct as rc
from millspark.operators import report as rp
from millspark.operators import review as rv
from millspark.operators import tables as tb
from millspark.sources import readers
from millspark.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scaled_percentages(spark):
    got = one(spark, tx.scaled_percentage(F.lit("13"), tx.scale_exponent(F.lit("C 10^-4"))))
    assert str(got["percentage"]) == "0.00130000" and got["error"] is None
    assert one(spark, tx.scaled_percentage(F.lit(" "), F.lit(0)))["error"] == "empty_cell"
    assert one(spark, tx.scaled_percentage(F.lit(None).cast("string"), F.lit(0)))["percentage"] is None
    assert one(spark, tx.scaled_percentage(F.lit("100,00000001"), F.lit(0)))["error"] == "out_of_range"


@pytest.mark.parametrize("text,want", [("0,123", "123.000000"), ("1.234,5", "1234.500000"), ("1,5", "1.500000"), ("x", None)])
def test_locale_numbers(spark, text, want):
    got = one(spark, tx.locale_number(F.lit(text)))
    assert (None if got is None else str(got)) == want


@pytest.mark.parametrize("text,header,want", [("1 1/2 in", "", "38.100000"), ("3 furlongs", "", None), ("2", "Width cm", "20.000000"), ("1/0 in", "", None), ("5", "", "5.000000")])
def test_dimensions(spark, text, header, want):
    got = one(spark, tx.dimension_value(F.lit(text), F.lit(header)))
    assert (None if got is None else str(got)) == want


def test_unicode_terms(spark):
    df = spark.createDataFrame([("Número ﬁno №",)], "t string")
    assert df.select(tx.normalize_term_unicode("t").alias("x")).first()["x"] == "numero fino No"  # case folding comes before the compatibility form


def test_ditto_over_a_known_null_is_an_error(spark):
    rows = spark.createDataFrame([(1, 1, '"'), (1, 2, "5"), (1, 3, '"'), (1, 4, None), (1, 5, "同上"), (2, 1, "ditto")], "certificate_id int, row_pos int, w string")
    got = [(r["w_value"], r["w_error"]) for r in rc.resolve_dittos(rows, ["w"]).orderBy("certificate_id", "row_pos").collect()]
    assert got == [(None, True), ("5", False), ("5", False), (None, False), (None, True), (None, True)]


def test_group_header_joins_the_row_below(spark):
    grid = [["", "Chemical Composition %", "", "Dimensions"], ["Coil No", "C", "Mn", "Width"], ["K123", "0.1", "0.2", "1000"], ["Total", "", "", "1000"]]
    cells = spark.createDataFrame([(1, 1, 0, r, c, x) for r, row in enumerate(grid) for c, x in enumerate(row)], "doc_id int, page int, table_idx int, row_idx int, col_idx int, text string")
    heads = tb.find_header_rows(cells)
    got = {(r["col_idx"], r["category"], r["key"], r["exponent"]) for r in heads.collect()}
    assert {(1, "chemistry", "C", 0), (2, "chemistry", "Mn", 0)} <= got and {h["header_row"] for h in heads.collect()} == {1}
    values, _ = tb.table_rows(cells, heads)
    assert {r["text"] for r in values.filter("category = 'chemistry'").collect()} == {"0.1", "0.2"} and values.select("row_idx").distinct().count() == 1


def test_catalog_hash_mismatch_raises(spark):
    df = spark.createDataFrame([("nico", "7209160101", "72091601", "01")], "kind string, code string, fraction string, nico string")
    good = ct.catalog_hash(df).first()["sha256"]
    assert ct.assert_catalog_hash(df, good).count() == 1
    with pytest.raises(Exception, match="catalog differs"):
        ct.assert_catalog_hash(df, "0" * 64).collect()


def test_file_inventory(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"%PDF-1.7 x"), ("c.pdf", b"nope"), ("d.txt", b"t"), ("e.xlsx", b"0" * 50)):
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["duplicate"]) for r in readers.file_inventory(spark, str(tmp_path), max_bytes=40).collect()}
    assert got == {"a.pdf": ("ready", False), "b.pdf": ("ready", True), "c.pdf": ("bad_header", False), "d.txt": ("unsupported_type", False), "e.xlsx": ("too_large", False)}


def test_replay_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(rv, "CHUNK", 4)
    targets = ["approved", "draft", "rejected", "draft", "needs_review", "needs_review", "approved", "rejected", "approved", "approved", "rejected"]
    events = spark.createDataFrame([(7, 1, i, s) for i, s in enumerate(targets)], "run_id bigint, certificate_id bigint, event_id bigint, to_status string")
    status, want = "needs_review", []
    for i, s in enumerate(targets):
        want.append((i, status, s in rv.TRANSITIONS[status]))
        status = s if want[-1][2] else status
    got = [(r["event_id"], r["from_status"], r["valid"]) for r in rv.replay_approvals(events).orderBy("event_id").collect()]
    assert got == want


def test_upload_stream_over_batches(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    schema = "document_id bigint, uploaded_at timestamp, sha256 string"
    for i, rows in enumerate([[(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:01:00", "b")], [(3, "2024-03-01 00:00:00", "a"), (4, "2024-03-01 00:00:00", "c")]]):
        spark.createDataFrame(rows, "document_id bigint, t string, sha256 string").selectExpr("document_id", "cast(t as timestamp) as uploaded_at", "sha256").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    jobs.dedupe_uploads(stream, str(out)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["sha256"] for r in jobs.written(spark, str(out)).collect()) == ["a", "b", "c"]


def test_late_uploads_are_kept(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    for document, day, sha in ((1, 10, "a"), (2, 20, "b"), (3, 12, "c"), (4, 11, "b")):
        spark.sql(f"SELECT {document}L AS document_id, timestamp'2024-01-{day} 00:00:00' AS uploaded_at, '{sha}' AS sha256").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("document_id bigint, uploaded_at timestamp, sha256 string").option("maxFilesPerTrigger", 1).parquet(str(source))
    jobs.dedupe_uploads(stream, str(out)).trigger(availableNow=True).start().awaitTermination()
    kept = {r["sha256"]: r["document_id"] for r in jobs.written(spark, str(out)).collect()}
    assert kept == {"a": 1, "b": 2, "c": 3}


def test_manual_candidates_get_ranks_of_their_own(spark):
    rows = "result_id bigint, fraction string, nico string"
    have = spark.createDataFrame([(1, "72091601", "01", 1)], rows + ", rank int")
    asked = spark.createDataFrame([(1, "72091602", "01"), (1, "72091603", "01"), (1, "72091602", "01"), (1, "72091601", "01"), (1, "7209", "01"), (1, None, "01"), (2, "72091602", "01")], rows)
    got = sorted((r["result_id"], r["fraction"] or "", r["decision"], r["rank"] or 0) for r in rv.manual_candidates(asked, have).collect())
    assert got == [(1, "", "invalid_tariff_code", 0), (1, "7209", "invalid_tariff_code", 0), (1, "72091601", "existing", 1),
                   (1, "72091602", "added", 2), (1, "72091603", "added", 3), (2, "72091602", "added", 1)]


def test_report_scope_follows_roll_heat_or_certificate(spark):
    ids = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} bigint")
    rows = spark.createDataFrame([(1, 7, None, None), (2, None, 5, None), (3, None, None, 3), (4, 8, 5, 3), (5, None, 6, 3), (6, None, None, None)],
                                 "observation_id bigint, product_id bigint, heat_id bigint, certificate_id bigint")
    got = rp.within_scope(rows, ids("certificate_id", 3), ids("heat_id", 5), ids("product_id", 7))
    assert sorted(r["observation_id"] for r in got.collect()) == [1, 2, 3]
    bare = rp.within_scope(rows.select("observation_id", "heat_id"), ids("certificate_id", 3), ids("heat_id", 5), ids("product_id", 7))
    assert sorted(r["observation_id"] for r in bare.collect()) == [2, 4]


def test_values_beyond_the_usual_range_are_kept_or_unknown(spark):
    large = lambda text: one(spark, tx.dimension_value(F.lit(text), F.lit(""), length=True))
    assert float(large("1500000 mm")) == 1500
    assert large("9" * 30 + " mm") is None
    assert one(spark, tx.scaled_percentage(F.lit("13"), F.lit(-9)))["error"] == "scale_out_of_range"


def test_a_filter_on_a_field_does_not_normalize_the_text_for_each_alias(spark):
    from millspark.operators import headers as hd
    cells = spark.createDataFrame([(1, "Coil No."), (2, "Thickness (mm)"), (3, None), (4, "?!")], "cell_id long, header string")
    found = hd.identify_fields(cells, "header")
    assert {r["cell_id"]: (r["field"], r["score"]) for r in found.collect()} == {1: ("product_id", 99), 2: ("thickness_mm", 92), 3: (None, None), 4: (None, None)}
    plan = found.filter("field is not null")._jdf.queryExecution().optimizedPlan()
    # The filter stays above the step that makes the term, so only that step names the text.
    filters = [line for line in plan.toString().splitlines() if "Filter" in line]
    assert filters and all("header" not in line for line in filters)
