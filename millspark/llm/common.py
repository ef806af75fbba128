"""Helpers shared by the corpus operators: words and their hashes over Arrow buffers, batch sizes, row identity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

NULL_ID = -(1 << 63)
HASHED_WORDS = 100_000
ARROW_ROWS = 2_000


def picked(df: DataFrame, **casts: str) -> DataFrame:
    """Columns by exact name with their types, also beside columns whose names clash in letter case; others are left."""
    # Whole texts cross to Python in batches of so many rows; the default of 10,000 suits narrow rows.
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    names, numbered = df.columns, df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def place(name: str) -> int:
        return names.index(name) if name in names else next(i for i, c in enumerate(names) if c.lower() == name.lower())

    return numbered.select(*[F.col(f"c{place(name)}").cast(kind).alias(name) for name, kind in casts.items()])


def sized(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast a table of narrow rows if a count proves it small; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def batches_of(batches: Iterator[pa.RecordBatch], weight: str, limit: int) -> Iterator[pa.Table]:
    """Regroup Arrow batches into tables of about ``limit`` bytes of column ``weight``, one row at least."""
    held, size = [], 0
    for batch in batches:
        start = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(weight))), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += n + 16
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def mix(values: np.ndarray, seed: int) -> np.ndarray:
    """A seeded 64-bit finalizer over an array (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        z = values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words (maximal runs without ASCII white space) of some texts laid end to end, found on the UTF-8 bytes.

    ``row`` is each word's text, ``counts`` the number of words per text; ``hashes(seed)`` hashes every word's bytes to
    64 bits: a sum of random byte values times random values of the place in the word, then mixed with the length.
    """

    def __init__(self, texts: pa.ChunkedArray | pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
            if isinstance(texts, pa.ChunkedArray):
                texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        data = data[offsets[0]:offsets[-1]]
        edges = offsets - offsets[0]
        inside = ~_WHITE[data]
        # A break stands before byte i where the byte before is white or belongs to another text.
        breaks = np.ones(len(data) + 1, bool)
        breaks[1:-1] = ~inside[:-1]
        breaks[edges[:-1]] = True
        starts = np.flatnonzero(inside & breaks[:-1])
        ends_at = np.ones(len(data) + 1, bool)
        ends_at[:-1] = ~inside
        ends_at[edges] = True
        ends = np.flatnonzero(inside & ends_at[1:]) + 1
        self.data, self.starts, self.ends, self.lower = data, starts, ends, lower
        self.row = np.searchsorted(edges[1:], starts, side="right")
        self.counts = np.bincount(self.row, minlength=n).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))

    def hashes(self, seed: int) -> np.ndarray:
        lengths = self.ends - self.starts
        out = np.empty(len(lengths), np.uint64)
        if not len(lengths):
            return out
        values = mix(np.arange(256, dtype=np.uint64), 2 * seed + 101)
        if self.lower:
            values[65:91] = values[97:123]
        places = mix(np.arange(int(lengths.max()), dtype=np.uint64), 2 * seed + 102)
        # Some words at a time: the arrays below have an entry per byte.
        for i in range(0, len(lengths), HASHED_WORDS):
            some = lengths[i:i + HASHED_WORDS]
            first = np.cumsum(some) - some
            place = np.arange(int(some.sum())) - np.repeat(first, some)
            at = place + np.repeat(self.starts[i:i + HASHED_WORDS], some)
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(values[self.data[at]] * places[place], first)
            out[i:i + HASHED_WORDS] = mix(sums ^ some.astype(np.uint64), seed)
        return out

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of ``size`` words that stay in their text."""
        at = np.arange(len(self.starts))
        return at[at + size <= self.first[1:][self.row]]


def rolling(hashes: np.ndarray, size: int, multiplier: int) -> np.ndarray:
    """Order-sensitive hash of every ``size`` neighbouring values; entry i covers i .. i+size-1."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            total = total * np.uint64(multiplier) + hashes[j:j + n]
    return mix(total, size)


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id has remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0).cast("long"))
