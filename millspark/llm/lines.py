"""Line deduplication over levelled sorted runs of line hashes.

A run is a Parquet table of (key, owner): the 128-bit hash of a normalized line and the document that holds it first,
sorted by key. Each batch of documents is reduced to one row per key, merge-joined with the runs, and adds the keys that
no run has as a run of level 0. When a level holds ``fanout`` runs they are merged into one run of the next level, so a
batch meets at most ``fanout`` runs per level. Runs live in one shared folder and never change once written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millspark.llm.common import NULL_ID, picked
from millspark.session import shared_folder

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_KEY = 10
FANOUT = 3
BATCHES = 4


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


class LineRuns:
    """The runs of one corpus in ``path``; ``ingest`` is called once per batch, smaller documents first."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.levels: list[list[str]] = []
        self.written = 0

    def rows(self, paths: Sequence[str] | None = None) -> DataFrame:
        paths = [p for level in self.levels for p in level] if paths is None else list(paths)
        if not paths:
            return self.spark.createDataFrame([], "key binary, owner long")
        return reduce(DataFrame.unionByName, [self.spark.read.schema("key binary, owner long").parquet(p) for p in paths])

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.path}/level={level}/run={self.written}"
        self.written += 1
        rows.repartition("key").sortWithinPartitions("key").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self.rows(full), level + 1)

    def ingest(self, keys: DataFrame) -> DataFrame:
        """Take the (key, doc_id) rows of one batch; returns (key, owner) of those keys that several documents hold so far.

        Runs and returned rows are written before this returns. A key's owner is the smallest document of the first
        batch that holds it. An empty batch changes nothing.
        """
        least = keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        met = least.join(self.rows().hint("merge"), "key", "left")
        path = f"{self.path}/batch={self.written}"
        met.select("key", F.coalesce("owner", "least").alias("owner"), F.col("owner").isNull().alias("fresh"), ((F.col("least") != F.col("most")) | F.col("owner").isNotNull()).alias("shared")).write.parquet(path)
        met = self.spark.read.schema("key binary, owner long, fresh boolean, shared boolean").parquet(path)
        self._write(met.filter("fresh").select("key", "owner"), 0)
        return met.filter("shared").select("key", "owner")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, dropped, kept = [], [], []
        for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            lines = (text or "").split("\n")
            gone = set(places or ())
            n.append(len(lines))
            dropped.append(len(gone))
            kept.append("\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text or "")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string()), *batch.columns[3:]], names=["doc_id", "n_lines", "n_dropped", "kept_text", *batch.schema.names[3:]])


def remove_repeated_lines(docs: DataFrame, min_key: int = MIN_KEY, batches: int = BATCHES, fanout: int = FANOUT, carry: Sequence[str] = ()) -> DataFrame:
    """Drop lines whose key of at least ``min_key`` code points occurs in several documents, but in the smallest ``doc_id``.

    Returns ``doc_id, n_lines, n_dropped, kept_text`` and the ``carry`` columns for each row. A null or empty text is one
    empty line. A null ``doc_id`` is smaller than all others and comes back as null; rows that repeat a ``doc_id`` are
    one document and keep each other's lines. Lines repeated within their own document stay. An empty table gives an
    empty table. Documents are taken in ``batches`` ranges of ``doc_id``; equal ids never part, and the result does not
    depend on the number of batches.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    docs = picked(docs, doc_id="long", text="string", **{c: kinds[c] for c in carry})
    docs = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(NULL_ID)), "_text": F.xxhash64("text")})
    folder = f"{shared_folder(spark)}/lines"
    ids = docs.agg(F.percentile_approx("_id", [i / batches for i in range(1, batches)], 1000).alias("p")).first()["p"] if batches > 1 else None
    bounds = sorted(set(ids or ()))
    batch = reduce(lambda c, b: c + (F.col("_id") > b).cast("int"), bounds, F.lit(0))
    lines = docs.select("_id", "_text", batch.alias("batch"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("place", "line"))
    lines = lines.withColumn("line", line_key("line")).filter(F.length("line") >= min_key)
    lines.select("_id", "_text", "place", F.unhex(F.md5("line")).alias("key"), "batch").write.partitionBy("batch").parquet(f"{folder}/keys")
    lines = spark.read.schema("_id long, _text long, place int, key binary, batch int").parquet(f"{folder}/keys")
    runs, shared = LineRuns(spark, f"{folder}/runs", fanout), []
    for i in range(len(bounds) + 1):
        shared.append(runs.ingest(lines.filter(F.col("batch") == i).select("key", F.col("_id").alias("doc_id"))))
    # A key is shared from one batch on, with the same owner in every later one.
    shared = reduce(DataFrame.unionByName, shared).groupBy("key").agg(F.min("owner").alias("owner"))
    gone = lines.join(shared, "key").filter(F.col("owner") != F.col("_id"))
    gone = gone.groupBy("_id", "_text").agg(F.collect_set("place").alias("places"))
    joined = docs.join(gone, ["_id", "_text"], "left").select("doc_id", "text", "places", *[F.col(f"`{c}`") for c in carry])
    schema = "doc_id long, n_lines long, n_dropped long, kept_text string" + "".join(f", `{c}` {kinds[c]}" for c in carry)
    return joined.mapInArrow(_cut, schema)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns from the operator's output."""
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, generate_subscripts(lines, 1) AS place, unnest(lines) AS line FROM d),
k AS MATERIALIZED (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1)
SELECT k.doc_id, count(*) AS n_lines, count(CASE WHEN o.owner <> k.doc_id THEN 1 END) AS n_dropped,
 sha256(coalesce(string_agg(CASE WHEN o.owner IS NULL OR o.owner = k.doc_id THEN line END, chr(10) ORDER BY place), '')) AS kept_sha256
FROM k LEFT JOIN o ON o.key = k.key GROUP BY k.doc_id
"""
