"""Exact top-k inner products over a bit-sliced index.

Vectors are cut into blocks. A block stores, per component, the top ``slice_bits`` bits of its whole numbers as
bitmaps over the block's rows (one slice per bit). A query adds its components times these slices with bitmap adders,
which leaves the quantised scores of all rows as sum slices. The k-th quantised score is found from the most
significant slice downward; every row whose quantised score plus the largest possible remainder reaches it is a boundary
row and is resolved exactly. No row that could be among the k best is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from millspark.llm.common import picked
from millspark.session import staged

K = 10
SCALE = 1024
SLICE_BITS = 6
BLOCK_ROWS = 32_768
QUERY_ROWS = 256
# Products whose bound stays below this are added in 64 bits; others are ranked with unbounded whole numbers.
SAFE = float(1 << 59)
LONG = (1 << 63) - 1


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and whole numbers of a block by rising id; shorter vectors count as followed by zeros."""
    ids = table["vec_id"].combine_chunks().to_numpy(zero_copy_only=False)
    lists = table["parts"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(ids), int(lengths.max()) if len(lengths) else 0), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    order = np.argsort(ids, kind="stable")
    return ids[order], out[order]


def _bytes(values: np.ndarray) -> bytes:
    """Whole numbers in four bytes each, or in eight if one of them needs it."""
    return values.astype("<i4" if not values.size or -(1 << 31) <= values.min() and values.max() < 1 << 31 else "<i8").tobytes()


def _numbers(data: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<i8" if len(data) == rows * dims * 8 else "<i4").reshape(rows, dims)


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    """One index row: ids, whole numbers, per component its least value and shift, and the slices."""
    ids, values = _matrix(table)
    least = values.min(axis=0)
    above = values - least
    shift = np.array([max(0, int(m).bit_length() - SLICE_BITS) for m in above.max(axis=0)], np.int64)
    high = (above >> shift).astype(np.uint8).T
    slices = np.stack([np.packbits((high >> b) & 1, axis=1, bitorder="little") for b in range(SLICE_BITS)], axis=1) if high.size else np.zeros((0, SLICE_BITS, 0), np.uint8)
    row = [key[0].as_py(), len(ids), values.shape[1], ids.astype("<i8").tobytes(), _bytes(values), least.astype("<i8").tobytes(), shift.astype("<i8").tobytes(), slices.tobytes()]
    return pa.table([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int32(), pa.int32()] + [pa.binary()] * 5)], names=["block", "n", "dims", "ids", "vals", "least", "shift", "slices"])


INDEX = "block int, n int, dims int, ids binary, vals binary, least binary, shift binary, slices binary"


def _pack_queries(key: tuple, table: pa.Table) -> pa.Table:
    ids, values = _matrix(table)
    return pa.table([pa.array([v], t) for v, t in zip([key[0].as_py(), len(ids), values.shape[1], ids.astype("<i8").tobytes(), _bytes(values)], [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])], names=["qblock", "qn", "qdims", "qids", "qvals"])


def _add(total: np.ndarray, slices: np.ndarray, low: int) -> None:
    """total += slices << low, in place, on bitmaps."""
    carry = None
    for i in range(len(slices)):
        a, b = total[low + i], slices[i]
        half = a ^ b
        if carry is None:
            total[low + i], carry = half, a & b
        else:
            total[low + i], carry = half ^ carry, (a & b) | (carry & half)
    i = low + len(slices)
    while i < len(total) and carry.any():
        total[i], carry = total[i] ^ carry, total[i] & carry
        i += 1


def _search(index: dict, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of a block, exact; rows with id ``own`` take no part."""
    ids, values, n, words = index["ids"], index["vals"], index["n"], index["words"]
    dims = min(values.shape[1], len(query))
    query = query[:dims]
    valid = index["valid"].copy()
    lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
    if hi > lo:
        mask = np.ones(len(valid) * 64, bool)
        mask[lo:hi] = False
        valid &= np.packbits(mask, bitorder="little").view(np.uint64)
    left = n - (hi - lo)
    large = float(np.abs(query).astype(float) @ index["most"][:dims]) >= SAFE
    if left > k and dims and not large:
        # Sizes count from the least unit 2**s over all components; shifts above it move the slices up.
        s = int(index["shift"][:dims].min())
        size = np.abs(query)
        up = index["shift"][:dims] - s
        width = max(1, int((size * ((1 << SLICE_BITS) - 1) << up).sum()).bit_length())
        total = np.zeros((width, words), np.uint64)
        for d in np.flatnonzero(size):
            part = index["slices"][d] if query[d] > 0 else ~index["slices"][d]
            rest, place = int(size[d]), int(up[d])
            while rest:
                if rest & 1:
                    _add(total, part, place)
                rest >>= 1
                place += 1
        # The k-th largest quantised score, from the most significant slice downward.
        above, even, kth = np.zeros(words, np.uint64), valid, 0
        for i in range(width - 1, -1, -1):
            more = above | (even & total[i])
            if int(np.bitwise_count(more).sum()) >= k:
                even, kth = even & total[i], kth | 1 << i
            else:
                above, even = more, even & ~total[i]
        # A row can gain at most size * (2**shift - 1) per component from the bits that are not sliced.
        slack = int((size * ((1 << index["shift"][:dims]) - 1)).sum())
        least = max(0, kth - (slack + (1 << s) - 1 >> s))
        above, even = np.zeros(words, np.uint64), valid
        for i in range(width - 1, -1, -1):
            if least >> i & 1:
                even = even & total[i]
            else:
                above, even = above | (even & total[i]), even & ~total[i]
        rows = np.flatnonzero(np.unpackbits((above | even).view(np.uint8), bitorder="little")[:n])
    else:
        rows = np.flatnonzero(np.unpackbits(valid.view(np.uint8), bitorder="little")[:n])
    if large:
        scores = np.array([max(-LONG, min(LONG, x)) for x in values[rows, :dims].astype(object) @ query.astype(object)], np.int64)
    else:
        scores = values[rows, :dims].astype(np.int64) @ query
    best = np.lexsort((ids[rows], -scores))[:k]
    return ids[rows[best]], scores[best]


def _opened(row: dict) -> dict:
    n, dims = row["n"], row["dims"]
    words = (n + 63) // 64
    narrow = np.frombuffer(row["slices"], np.uint8).reshape(dims, SLICE_BITS, (n + 7) // 8)
    slices = np.zeros((dims, SLICE_BITS, words * 8), np.uint8)
    slices[:, :, :narrow.shape[2]] = narrow
    valid = np.zeros(words * 64, bool)
    valid[:n] = True
    values = _numbers(row["vals"], n, dims)
    most = np.maximum(-values.min(axis=0).astype(float), values.max(axis=0).astype(float))
    return {"n": n, "words": words, "ids": np.frombuffer(row["ids"], "<i8"), "vals": values, "most": most,
            "shift": np.frombuffer(row["shift"], "<i8"), "slices": slices.view(np.uint64).reshape(dims, SLICE_BITS, words),
            "valid": np.packbits(valid, bitorder="little").view(np.uint64)}


def _answer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                index = _opened(row)
                queries = _numbers(row["qvals"], row["qn"], row["qdims"]).astype(np.int64)
                found = [(q, *_search(index, v, q, k)) for q, v in zip(np.frombuffer(row["qids"], "<i8"), queries)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([np.full(len(a), q) for q, a, _ in found]), pa.int64()),
                    pa.array(np.concatenate([a for _, a, _ in found]), pa.int64()),
                    pa.array(np.concatenate([b for *_, b in found]), pa.int64())], names=["query_id", "vec_id", "score"])
    return run


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, parts``: floor(scale * component); vectors without id, null, or with a null or non-finite component are left out."""
    vectors = picked(vectors, vec_id="long", embedding="array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    parts = F.transform("embedding", lambda x: F.greatest(F.floor(x * F.lit(float(scale))), F.lit(-LONG)))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select("vec_id", parts.alias("parts"))


def build_index(numbers: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """The stored index, one row per block, and the number of blocks; every row is indexed."""
    blocks = max(1, -(-numbers.count() // block_rows))
    keyed = numbers.withColumn("block", F.pmod(F.xxhash64("vec_id", "parts"), F.lit(blocks)).cast("int"))
    return staged(keyed.groupBy("block").applyInArrow(_pack, INDEX)), blocks


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: per query the k rows of largest integer inner product, ties to the smaller id.

    Components are floor(scale * x) in 64 bits; where products could leave 64 bits a block's rows are ranked with
    unbounded whole numbers. A component or score beyond the range of a long is held at its end, where
    scores tie. Rows without an id, null vectors and vectors with null or
    non-finite components take no part on either side. Vectors of different lengths are compared as if the shorter went
    on with zeros; an empty vector scores 0. Rows with the query's own id are no candidates; of rows that repeat a query's id
    one is asked. With fewer candidates than k all are returned; empty tables give an empty table. Query blocks meet
    index blocks by an equi-join on the block number, so neither side is broadcast or gathered.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    index, blocks = build_index(whole_numbers(vectors, scale), block_rows)
    asked = whole_numbers(queries, scale).groupBy("vec_id").agg(F.min("parts").alias("parts"))
    qblocks = max(1, -(-asked.count() // query_rows))
    packed = asked.withColumn("qblock", F.pmod(F.xxhash64("vec_id"), F.lit(qblocks)).cast("int")).groupBy("qblock").applyInArrow(_pack_queries, "qblock int, qn int, qdims int, qids binary, qvals binary")
    pairs = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = index.join(pairs, "block").mapInArrow(_answer(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
