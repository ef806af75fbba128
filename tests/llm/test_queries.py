"""Registered corpus queries against their SQL, and the pipeline stage by stage."""

import os

import duckdb
import pytest

from compare import norm

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", ("op3_warc", "op6_benchmark_decontamination", "op7_line_dedup", "op8_source_mixing", "op9_exact_top_k", "op11_fill_in_middle", "op13_exact_dedup"))
def test_query_matches_oracle(spark, name):
    import __spark_entry__ as entry
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted("|".join(norm(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall())
    assert sorted("|".join(norm(r[c]) for c in sorted(columns)) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from millspark.llm import decontaminate, language, lines, mixing, neardup
    from millspark.session import staged
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    results = [docs]
    for name, stage in p.STAGES:
        results.append(staged(stage(spark, results[-1], SF)))
        assert name == "mixing" or results[-1].columns == columns
    start, spoken, lined, single, clean, mixed = results
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    assert ids(spoken) == ids(start.filter("text RLIKE '\\\\p{L}'"))
    kept = {r["doc_id"]: r["kept_text"] for r in lines.remove_repeated_lines(spoken).collect()}
    assert {r["doc_id"]: r["text"] for r in lined.collect()} == kept
    classes = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(lined).collect()}
    assert ids(single) == sorted(set(classes.values()))
    judged = decontaminate.contamination(single, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(clean) == ids(judged.filter("NOT contaminated"))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(clean).collect() if r["copies"]}
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == copies
