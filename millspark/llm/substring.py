"""Removal of word passages that repeat across documents, behind a count-min prefilter.

Pass 1 builds, per chunk of a partition, a count-min sketch of the windows of ``window`` words (two hash rows, counts
that stop at two) and sends its occupied cells, packed, to the task that owns that block of cells. Summed there, a cell
counts at least what each of its windows counts, so a window with one cell below two occurs in one chunk and document
only. What remains of the sketch is one bit per cell ("two or more"), whose size is the parameter ``cell_bits`` and
nothing else. Pass 2 groups exactly those windows whose cells are all set. A fuller sketch lets more windows through to
the exact pass; the result is the same for every size.

Before the exact pass, each chunk keeps a window's smallest document and decides its other documents itself: one very
common passage becomes one row per chunk and window, however many documents hold it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millspark.llm.common import NULL_ID, Words, batches_of, mix, picked, rolling

WINDOW = 13
CELL_BITS = 28
BLOCK_BITS = 18
CHUNK_BYTES = 8 << 20
# Windows that one exact task holds at a time when it hands its findings on.
FLUSH = 1 << 20
ROWS = 2
MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
FOUND = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("doc", "<i8"), ("pos", "<i4")])
PLACE = np.dtype([("doc", "<i8"), ("pos", "<i4")])


class _Chunk:
    """Windows of some documents: first hash, document and position, in text order; the second hash on demand."""

    def __init__(self, table: pa.Table, window: int):
        self.words, self.window = Words(table["text"]), window
        self.at = self.words.windows(window)
        self.h1 = rolling(self.words.hashes(1), window, MULTIPLIERS[0])[self.at] if len(self.at) else np.empty(0, np.uint64)
        row = self.words.row[self.at]
        self.doc = table["doc_id"].combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False)[row]
        self.pos = self.at - self.words.first[row]

    def h2(self) -> np.ndarray:
        return rolling(self.words.hashes(2), self.window, MULTIPLIERS[1])[self.at] if len(self.at) else np.empty(0, np.uint64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted run of equal values begins."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(h, row + 1) >> np.uint64(64 - bits)


def _pack(codes: np.ndarray) -> bytes:
    """Sorted 32-bit codes as differences, byte planes apart, deflated."""
    steps = np.diff(codes, prepend=np.uint32(0)).astype("<u4")
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _sketch(window: int, bits: int):
    low = min(BLOCK_BITS, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of(batches, "text", CHUNK_BYTES):
            chunk = _Chunk(table, window)
            order = np.argsort(chunk.h1, kind="stable")
            h, doc = chunk.h1[order], chunk.doc[order]
            first = _changes(h)
            if not len(first):
                continue
            several = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)
            blocks, packed = [], []
            for row in range(ROWS):
                cells = _cells(h[first], row, bits)
                by = np.argsort(cells, kind="stable")
                cells, two = cells[by], several[by]
                start = _changes(cells)
                twice = np.logical_or.reduceat(two, start) | (np.diff(np.append(start, len(cells))) > 1)
                cells = cells[start]
                block = (cells >> np.uint64(low)).astype(np.int64)
                codes = ((cells & np.uint64((1 << low) - 1)) << np.uint64(1)).astype(np.uint32) | twice.astype(np.uint32)
                cut = _changes(block)
                for a, b in zip(cut, np.append(cut[1:], len(block))):
                    blocks.append((row << (bits - low)) + int(block[a]))
                    packed.append(_pack(codes[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], names=["block", "cells"])
    return run


def _merge(low: int):
    """Sums sorted block rows into one bit per cell; holds the counters of one block at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts = None, np.zeros(1 << low, np.uint8)

        def finished() -> pa.RecordBatch:
            bits = np.packbits(counts >= 2, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([zlib.compress(bits, 1)], pa.binary())], names=["block", "bits"])
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != current:
                    if current is not None:
                        yield finished()
                    current = block
                    counts[:] = 0
                codes = _unpack(cells)
                at = codes >> np.uint32(1)
                counts[at] = np.minimum(counts[at] + 1 + (codes & np.uint32(1)).astype(np.uint8), 2)
        if current is not None:
            yield finished()
    return run


def repeated_cells(docs: DataFrame, window: int = WINDOW, cell_bits: int = CELL_BITS) -> bytes:
    """The merged sketch as packed bits: ``2 * 2**cell_bits / 8`` bytes whatever the corpus (64 MiB at 28 bits)."""
    low = min(BLOCK_BITS, cell_bits)
    parts = docs.mapInArrow(_sketch(window, cell_bits), "block int, cells binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_merge(low), "block int, bits binary")
    size = max(1, (1 << low) // 8)
    bits = np.zeros(size * (ROWS << (cell_bits - low)), np.uint8)
    for row in merged.collect():
        part = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
        bits[row["block"] * size:row["block"] * size + len(part)] = part
    return bits.tobytes()


def _are_set(bits: np.ndarray, h: np.ndarray, row: int, cell_bits: int) -> np.ndarray:
    at = _cells(h, row, cell_bits)
    low = min(BLOCK_BITS, cell_bits)
    byte = (at >> np.uint64(3)).astype(np.int64) + row * max(1, (1 << low) // 8) * (1 << (cell_bits - low))
    return (bits[byte] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _candidates(window: int, bits: int, buckets: int, sketch):
    """Rows (bucket, found, decided): windows to compare by hash bucket, and places that this chunk has decided."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(sketch.value, np.uint8)
        for table in batches_of(batches, "text", CHUNK_BYTES):
            chunk = _Chunk(table, window)
            maybe = np.flatnonzero(_are_set(cells, chunk.h1, 0, bits))
            for row in range(1, ROWS):
                maybe = maybe[_are_set(cells, chunk.h1[maybe], row, bits)]
            if not len(maybe):
                continue
            h1, h2, doc, pos = chunk.h1[maybe], chunk.h2()[maybe].astype(np.uint32), chunk.doc[maybe], chunk.pos[maybe]
            order = np.lexsort((doc, h2, h1))
            h1, h2, doc, pos = h1[order], h2[order], doc[order], pos[order]
            first = _changes(h1, h2)
            least = np.repeat(doc[first], np.diff(np.append(first, len(h1))))
            later = doc > least
            found = np.empty(int((~later).sum()), FOUND)
            for name, values in (("h1", h1), ("h2", h2), ("doc", doc), ("pos", pos)):
                found[name] = values[~later]
            decided = np.empty(int(later.sum()), PLACE)
            decided["doc"], decided["pos"] = doc[later], pos[later]
            bucket = (found["h1"] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            found, bucket = found[by], bucket[by]
            cut = _changes(bucket)
            ends = np.append(cut[1:], len(bucket))
            share = np.linspace(0, len(decided), len(cut) + 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[cut], pa.int64()), pa.array([found[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                pa.array([decided[a:b].tobytes() for a, b in zip(share[:-1], share[1:])], pa.binary())], names=["bucket", "found", "decided"])
    return run


def _places(places: np.ndarray, parts: int) -> pa.RecordBatch:
    """Window starts packed by part of the documents."""
    part = np.mod(places["doc"], parts)
    order = np.argsort(part, kind="stable")
    places, part = places[order], part[order]
    cut = _changes(part)
    ends = np.append(cut[1:], len(places))
    return pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int64()), pa.array([places[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())], names=["part", "places"])


def _decide(parts: int):
    """Exact grouping of one bucket at a time: places whose document is not the smallest with that window."""
    def group(parts: list[bytes]) -> np.ndarray:
        found = np.frombuffer(b"".join(parts), FOUND)
        h1, h2, doc = (np.ascontiguousarray(found[c]) for c in ("h1", "h2", "doc"))
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc = h1[order], h2[order], doc[order]
        first = _changes(h1, h2)
        later = doc > np.repeat(doc[first], np.diff(np.append(first, len(doc))))
        out = np.empty(int(later.sum()), PLACE)
        out["doc"], out["pos"] = doc[later], found["pos"][order][later]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, current, rows = [], 0, None, []
        for batch in batches:
            for bucket, found, decided in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != current and rows:
                    held.append(group(rows))
                    size += len(held[-1])
                    rows = []
                current = bucket
                rows.append(found)
                held.append(np.frombuffer(decided, PLACE))
                size += len(held[-1])
                if size > FLUSH:
                    yield _places(np.concatenate(held), parts)
                    held, size = [], 0
        if rows:
            held.append(group(rows))
        if held:
            yield _places(np.concatenate(held), parts)
    return run


def _cut(window: int):
    """The kept words of the documents of one part."""
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        places = np.frombuffer(b"".join(found["places"].to_pylist()), PLACE)
        doc, pos = np.ascontiguousarray(places["doc"]), np.ascontiguousarray(places["pos"])
        order = np.argsort(doc, kind="stable")
        doc, pos = doc[order], pos[order]
        out = []
        for doc_id, own, text in zip(*(docs[c].to_pylist() for c in ("doc_id", "_id", "text"))):
            words = (text or b"").split()
            at = np.unique(pos[np.searchsorted(doc, own):np.searchsorted(doc, own, side="right")])
            at = at[at + window <= len(words)]
            removed, kept = 0, words
            if len(at):
                covered = np.zeros(len(words) + 1, np.int64)
                covered[at] += 1
                covered[at + window] -= 1
                drop = np.cumsum(covered)[:-1] > 0
                removed, kept = int(drop.sum()), [w for w, d in zip(words, drop.tolist()) if not d]
            out.append((doc_id, len(words), removed, b" ".join(kept)))
        columns = list(zip(*out)) if out else [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_words", "n_removed", "kept_text"])
    return run


def _coprime(buckets: int) -> int:
    """The next prime: ids in regular steps still spread over all parts."""
    n = max(3, buckets) | 1
    while any(n % i == 0 for i in range(3, int(n ** 0.5) + 1, 2)):
        n += 2
    return n


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, cell_bits: int = CELL_BITS, buckets: int | None = None) -> DataFrame:
    """Drop every word covered by a window of words that also starts in a document with a smaller ``doc_id``.

    Words are maximal runs without ASCII white space, unchanged. Returns ``doc_id, n_words, n_removed, kept_text`` for each
    row (kept words joined by one space). A null or empty text has no words. A null ``doc_id`` counts as smaller than
    all others and comes back as null. Rows that repeat a ``doc_id`` are one document: only what a smaller ``doc_id`` holds
    is removed from them, at the same places in each. Texts shorter than a window are kept whole. An empty table gives
    an empty table; other columns are not looked at. ``buckets`` (eight per shuffle partition unless given) cuts the
    exact grouping and the documents; a task holds one bucket's windows, or one part's texts, at a time.
    """
    spark = docs.sparkSession
    docs = picked(docs, doc_id="long", text="string").withColumn("text", F.col("text").cast("binary"))
    buckets = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketch = spark.sparkContext.broadcast(repeated_cells(docs, window, cell_bits))
    found = docs.mapInArrow(_candidates(window, cell_bits, buckets, sketch), "bucket long, found binary, decided binary")
    parts = _coprime(buckets // 4)
    places = found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_decide(parts), "part long, places binary")
    own = F.coalesce("doc_id", F.lit(NULL_ID))
    docs = docs.withColumns({"_id": own, "part": F.pmod(own, F.lit(parts))})
    cut = docs.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text binary")
    return cut.withColumn("kept_text", F.col("kept_text").cast("string"))


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns from the operator's output."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
