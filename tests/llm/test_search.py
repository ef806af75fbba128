import base64
import gzip
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millspark.llm import decontaminate, mixing, topk, warc


def terms(text):
    import re
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def hits_by_hand(rows, items):
    out = []
    for d, t in rows:
        w, hit, found = terms(t), set(), set()
        for item, text in items:
            iw = terms(text)
            n = min(13, len(iw))
            for s in range(len(iw) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == iw[s:s + n]:
                        hit.update(range(p, p + n))
                        found.add("null" if item is None else str(item))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def test_contamination_matches_brute_force(awkward, nothing, spark):
    items = [(1, " ".join(f"W{i}" for i in range(10, 40))), (10, "one, TWO three"), (2, "é" + " ".join(f"w{i}" for i in range(20))), (3, None), (4, ""), (5, "w w w"), (None, "one two three"), (1, "line number 3 of the common part")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r[0], r[1]) for r in awkward.filter("doc_id <> 6 OR doc_id IS NULL").collect()]
    docs = awkward.filter("doc_id <> 6 OR doc_id IS NULL")
    for limit in (200_000, 0):  # also without any broadcast
        got = decontaminate.digest(decontaminate.contamination(docs, benchmark, broadcast_terms=limit)).collect()
        assert Counter(map(tuple, got)) == hits_by_hand(rows, items)
    assert decontaminate.contamination(nothing, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "p q a b x c d e y f r"), (2, "a b c d e f"), (3, "f q q q q q q q q a")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f")], "item_id long, text string")
    kinds = {(r["_id"], r["kind"]) for r in decontaminate.find_passages(docs, items, slop=3).collect()}
    assert kinds == {(1, "near"), (2, "phrase")}


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(230)] + [(1000 + i, [0.5] * 8) for i in range(40)]
    data += [(500, None), (501, [1.0, None]), (600, [float("nan")] * 8), (700, [float("inf")] * 8), (None, [1.0] * 8), (800, []), (900, [1.0, 2.0]), (1, data[1][1]), (100, data[100][1])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("EMBEDDING_", F.lit(1))
    whole = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    pad = lambda v: np.pad(v, (0, 8 - len(v)))
    want = set()
    for q, v in {i: v for i, v in whole if i % 100 == 0}.items():
        scored = sorted((-int(pad(v) @ pad(x)), i) for i, x in whole if i != q)[:10]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)}
    for rows in (64, 10_000):
        got = [tuple(r) for r in topk.top_k(table, table.filter("vec_id % 100 = 0"), block_rows=rows, query_rows=3).collect()]
        assert len(got) == len(want) and set(got) == want
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    """Components beyond 32 bits keep their order; scores out of a long's range are held at its end and tie."""
    data = [(100, [70_000.0, 1.0]), (1, [70_000.0, 0.0]), (2, [65_536.0, 0.0]), (3, [90_000.0, 5.0]), (4, [-3e9, 7.0]), (5, [-3e9, -7.0]), (200, [1e14, -1e14]), (6, [1e14, 1e14]), (7, [1e14, 1e14 - 512])] + [(10 + i, [float(i), -1.0]) for i in range(30)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in data]
    end = (1 << 63) - 1
    want = {}
    for q, v in whole:
        if q % 100 == 0:
            scored = sorted((-max(-end, min(end, sum(a * b for a, b in zip(v, x)))), i) for i, x in whole if i != q)[:10]
            want[q] = [(i, -s) for s, i in scored]
    for rows in (8, 10_000):
        got = topk.top_k(table, table.filter("vec_id % 100 = 0"), block_rows=rows).orderBy("query_id", "rank").collect()
        assert {q: [(r["vec_id"], r["score"]) for r in got if r["query_id"] == q] for q in want} == want


def test_archive_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 400
    rows = [(1, "http://a/\r\nx: y%0A", big), (5, None, big), (3, "http://b", big), (2, "u", None), (4, "u", ""), (6, "u", "small"), (7, "u", "small"), (None, "n", big), (8, "v", "z" * 500_000), (8, "v", "z" * 500_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, HTML int")
    warc.archive(pages, str(tmp_path))
    back = warc.read_archive(spark, str(tmp_path))
    want = Counter()
    for i, url, html in rows:
        data = (html or "").encode()
        revisit = html == big and i != 5
        want[i, url, "revisit" if revisit else "response", 5 if revisit else None, len(data), hashlib.sha1(data).hexdigest(), None if revisit else data] += 1
    assert Counter((*r[:6], None if r[6] is None else bytes(r[6])) for r in back.collect()) == want
    assert back.filter("record_type = 'revisit' AND page_id = 3").count() == 1
    # The reader keeps the equality; Spark is left with the null check alone.
    assert "= revisit" not in back.filter("record_type = 'revisit'").select("page_id")._jdf.queryExecution().executedPlan().toString()
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_appended_and_overwritten(spark, tmp_path):
    one, two, three = (spark.createDataFrame([(i, "u", f"text {i}")], "page_id long, url string, html string") for i in (1, 2, 3))
    warc.archive(one, str(tmp_path))
    warc.archive(two, str(tmp_path))
    ids = lambda: sorted(r["page_id"] for r in warc.read_archive(spark, str(tmp_path)).collect())
    assert ids() == [1, 2]
    warc.with_revisits(three).write.format("warc").mode("overwrite").option("path", str(tmp_path)).save()
    assert ids() == [3]
    assert len(list(tmp_path.glob("*.warc.gz"))) == 1


def test_foreign_and_damaged_archives(spark, tmp_path):
    def member(kind, body, digest=True, http=True):
        content = (b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" if http else b"") + body
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0f>", f"Content-Type: application/{'http; msgtype=response' if http else 'warc-fields'}", f"Content-Length: {len(content)}"]
        if digest:
            head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode())
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + content + b"\r\n\r\n")
    noise = np.random.default_rng(0).bytes(300_000)
    good = member("warcinfo", b"software: x", False, False) + member("response", noise) + member("request", b"") + member("response", b"", False) + member("response", b"end\r\n\r\nreally")
    folder = tmp_path / "foreign"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(good)
    back = warc.read_archive(spark, str(folder))
    rows = [(r["page_id"], r["record_type"], r["payload_bytes"], None if r["payload"] is None else bytes(r["payload"])) for r in back.collect()]
    assert rows == [(None, "warcinfo", 11, None), (None, "response", 300_000, noise), (None, "request", 0, None), (None, "response", 0, b""), (None, "response", 13, b"end\r\n\r\nreally")]
    assert back.filter("record_type = 'response'").count() == 3
    for name, data, said in (("cut", good[:-20], "truncated"), ("cut2", good[:60], "truncated"), ("plain", b"WARC/1.0\r\n", "not a gzip"), ("changed", gzip.compress(gzip.decompress(member("response", b"x" * 50)).replace(b"xx", b"xy", 1)), "damaged")):
        bad = tmp_path / name
        bad.mkdir()
        (bad / "a.warc.gz").write_bytes(data)
        with pytest.raises(Exception, match=said):
            warc.read_archive(spark, str(bad)).collect()


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "tiny").when(F.col("id") % 7 == 0, F.lit(None)).otherwise("mid").alias("source"), F.repeat(F.lit("a b "), (F.col("id") % 40).cast("int")).alias("text"))
    got = mixing.mix_sources(docs)
    again = mixing.mix_sources(docs.repartition(7))
    assert got.exceptAll(again).count() == 0
    per = got.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size"), F.max("copies").alias("copies")).collect()
    total = sum(r["size"] for r in per)
    assert abs(sum(r["target"] for r in per) - total) < 1e-6 * total
    for r in per:
        assert r["target"] <= 3 * r["size"] + 1e-6 and r["copies"] <= 3
        assert abs(r["taken"] - r["target"]) <= 0.01 * r["target"] + 200


def test_mix_of_awkward_rows(awkward, nothing):
    got = mixing.mix_sources(awkward).collect()
    assert len(got) == awkward.count()
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in got)
    assert mixing.mix_sources(nothing).count() == 0
