"""Alignment of two tokenizers over the same bytes by merge-path partitioning.

Tokens of A and of B tile the bytes of a text, so their ends are two rising sequences. Diagonal binary searches cut the
merge of both into pieces of equal work that need nothing of each other; a piece emits the token pairs whose bytes
overlap (one per distinct end) and the ends that both share. Shared ends of all pieces, in order, are the borders of the
groups, so groups that cross a piece are stitched by counting the borders before them.

An id pair's count is the number of documents that hold it linked. Each task reduces its documents to distinct pairs
with multiplicities, Spark counts them with partial aggregation, and the counts come back to the documents: frequent
pairs, at most ``frequent`` of them by a threshold on the count, as a broadcast table, and all others by a shuffle join
in which no key is frequent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millspark.llm.common import batches_of, picked
from millspark.session import staged

TOKENIZERS = "/opt/tokenizers"
VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
PIECE_ENDS = 1 << 16
BATCH_BYTES = 1 << 20
FREQUENT_PAIRS = 250_000

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pair_a array<int>, pair_b array<int>, pair_links array<int>"


# --- fixed value: how the byte-level tokenizer cuts a text before it merges bytes ---
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """Tokenizer A: byte-level merges, read from a tokenizers file. ``bytes_of[id]`` are a token's bytes.

    Merges are listed in the order of their ids there, so a token's id is its rank; the ranks are applied by tiktoken,
    which needs a third of the time and no objects per token. Tests hold it against the file's own library.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = model["vocab"]
        # The printable bytes stand for themselves, the others for the code points from 256 on.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if any(vocabulary[m.replace(" ", "")] != 256 + i for i, m in enumerate(merges)):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        ranks = {self.bytes_of[i]: i for i in range(256 + len(merges))}
        self.model = tiktoken.Encoding("byte level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.model.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts]


class Pieces:
    """Tokenizer B: sentence pieces with byte fallback, which adds a space in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.bytes_of = [bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


def diagonal_cuts(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two rising sequences crosses every ``work``-th diagonal: entries of ``a`` and ``b`` before it.

    An end that both share stays in one piece.
    """
    total = len(a) + len(b)
    diagonal = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        before = np.zeros(len(low), bool)
        before[open_] = a[middle[open_]] <= b[diagonal[open_] - 1 - middle[open_]]
        low, high = np.where(open_ & before, middle + 1, low), np.where(open_ & ~before, middle, high)
    other = diagonal - low
    split = (low > 0) & (other < len(b))
    split[split] = a[low[split] - 1] == b[other[split]]
    return low, other + split


def merge_piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One piece: overlapping pairs as places in ``a`` and ``b``, and the shared ends. A place past the piece is the first
    token of the next one, which covers the last bytes."""
    merged = np.sort(np.concatenate([a, b]), kind="stable")
    last = np.append(merged[1:] != merged[:-1], True) if len(merged) else np.zeros(0, bool)
    ends = merged[last]
    return np.searchsorted(a, ends), np.searchsorted(b, ends), merged[~last]


def overlaps(a: np.ndarray, b: np.ndarray, work: int = PIECE_ENDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping pairs (places in ``a`` and ``b``) and shared ends of two tilings with the same last end."""
    at_a, at_b = diagonal_cuts(a, b, work)
    pieces = [merge_piece(a[i:k], b[j:m]) for i, k, j, m in zip(at_a, at_a[1:], at_b, at_b[1:])]
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (np.concatenate([x + i for (x, _, _), i in zip(pieces, at_a)]), np.concatenate([y + j for (_, y, _), j in zip(pieces, at_b)]), np.concatenate([c for _, _, c in pieces]))


def _numbers(n: int) -> pa.Array:
    """Decimal ids followed by each separator: entry 3 * id + s."""
    return pa.array([f"{i}{s}" for i in range(n) for s in ",|;"])


class Aligner:
    """Aligns batches of texts; one per Python worker."""

    def __init__(self, a: ByteLevel, b: Pieces, work: int = PIECE_ENDS):
        self.a, self.b, self.work = a, b, work
        self.bytes = [pa.array(t.bytes_of, pa.binary()) for t in (a, b)]
        self.lengths = [np.array([len(x) for x in t.bytes_of], np.int64) for t in (a, b)]
        self.numbers = _numbers(max(len(a.bytes_of), len(b.bytes_of)))

    def _rebuilds(self, side: int, ids: np.ndarray, want: bytes) -> bool:
        buffer = self.bytes[side].take(pa.array(ids)).buffers()[2]
        return (buffer.to_pybytes() if buffer else b"") == want

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both tokenizers; none for a text that is null, empty or not rebuilt by the bytes of both."""
        full = [i for i, t in enumerate(texts) if t]
        none = np.zeros(0, np.int64)
        ids = [none] * len(texts), [none] * len(texts)
        for tokenizer, out in zip((self.a, self.b), ids):
            for i, found in zip(full, tokenizer.encode([texts[i] for i in full])):
                out[i] = found
        for i in full:
            want = b" " + texts[i].encode()
            if not all(self._rebuilds(side, ids[side][i], want) for side in (0, 1)):
                ids[0][i] = ids[1][i] = none
        return ids

    def align(self, doc_ids: pa.ChunkedArray, texts: list[str | None]) -> pa.RecordBatch:
        ids_a, ids_b = self.tokens(texts)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.concatenate([np.zeros(0, np.int64), *ids]) for ids in (ids_a, ids_b))
        # The texts end to end are one tiling: both tokenizers end where a text ends.
        ends_a, ends_b = np.cumsum(self.lengths[0][flat_a]), np.cumsum(self.lengths[1][flat_b])
        link_a, link_b, shared = overlaps(ends_a, ends_b, self.work)
        text_a = np.repeat(np.arange(len(texts)), n_a)
        text_of_link = text_a[link_a]
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        text_of_group = text_a[np.searchsorted(ends_a, shared)]
        n_groups, n_links = (np.bincount(x, minlength=len(texts)) for x in (text_of_group, text_of_link))

        # Groups as text: A ids, then B ids of each group, every id with the separator behind it.
        order_a = np.arange(len(flat_a)) + np.searchsorted(group_b, group_a, side="left")
        order_b = np.arange(len(flat_b)) + np.searchsorted(group_a, group_b, side="right")
        codes = np.empty(len(flat_a) + len(flat_b), np.int64)
        codes[order_a] = 3 * flat_a + np.append(group_a[1:] != group_a[:-1], True)[:len(flat_a)]
        codes[order_b] = 3 * flat_b + 2 * np.append(group_b[1:] != group_b[:-1], True)[:len(flat_b)]
        written = self.numbers.take(pa.array(codes))
        places = np.frombuffer(written.buffers()[1], np.int32)[:len(codes) + 1] if len(codes) else np.zeros(1, np.int32)
        characters = bytes(written.buffers()[2]) if len(codes) else b""
        cuts = places[np.cumsum(np.append(0, n_a + n_b))]
        groups = [characters[i:max(i, k - 1)].decode() for i, k in zip(cuts, cuts[1:])]

        pairs, counts = np.unique(text_of_link << 40 | flat_a[link_a] << 20 | flat_b[link_b], return_counts=True)
        offsets = pa.array(np.searchsorted(pairs >> 40, np.arange(len(texts) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (pairs >> 20 & 0xFFFFF, pairs & 0xFFFFF, counts)]
        return pa.RecordBatch.from_arrays(
            [doc_ids.combine_chunks() if isinstance(doc_ids, pa.ChunkedArray) else doc_ids, *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)), pa.array(groups, pa.string()), *lists],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pair_a", "pair_b", "pair_links"])


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(path_a: str, path_b: str, work: int = PIECE_ENDS) -> Aligner:
    """The worker's aligner for two vocabulary files."""
    key = path_a, path_b, work
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(ByteLevel(path_a), Pieces(path_b), work)
    return _ALIGNERS[key]


def align(docs: DataFrame, folder: str = TOKENIZERS, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, work: int = PIECE_ENDS) -> DataFrame:
    """Token groups and distinct linked id pairs of each row of ``docs``: ``row`` and the columns of ``SCHEMA``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` with ids of A and B; ``pair_a, pair_b, pair_links`` are the distinct linked id pairs
    and how many token pairs each stands for. Texts that are null, empty or not rebuilt exactly by the bytes of both
    tokenizers have no tokens: zeros, empty text, empty arrays. Null and repeated ids are rows like others, numbered by
    ``row``. An empty table gives an empty table. The result is written once, as encoding is the dearest step.
    """
    paths = f"{folder}/{vocabulary_a}", f"{folder}/{vocabulary_b}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of(batches, "text", BATCH_BYTES):
            yield aligner(*paths, work).align(table.column("doc_id"), table.column("text").to_pylist())

    aligned = picked(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)
    return staged(aligned.withColumn("row", F.monotonically_increasing_id()))


def _pairs(aligned: DataFrame) -> DataFrame:
    pairs = aligned.select("row", F.inline(F.arrays_zip("pair_a", "pair_b", "pair_links")))
    return pairs.select("row", (F.shiftleft(F.col("pair_a").cast("long"), 20) + F.col("pair_b")).alias("pair"), F.col("pair_links").cast("long").alias("links"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n_docs, best``: in how many documents an id pair (A id times 2**20 plus B id) is linked, and whether no pair of
    its A id is linked in more. The highest counts, one row per id of A's vocabulary, are broadcast."""
    counts = staged(_pairs(aligned).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")))
    first = F.shiftright("pair", 20)
    highest = counts.groupBy(first.alias("a")).agg(F.max("n_docs").alias("highest"))
    joined = counts.join(F.broadcast(highest), first == F.col("a"))
    return staged(joined.select("pair", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best")))


def link_statistics(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """``row, n_best, count_sum`` of each row that has links: links whose pair is best, and counts summed over links."""
    levels = counts.agg(*[F.count_if(F.col("n_docs") >= 1 << k).alias(f"k{k}") for k in range(41)]).first()
    least = next(1 << k for k in range(41) if levels[k] <= frequent or k == 40)
    sums = F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n_docs")).alias("count_sum")
    pairs = _pairs(aligned)
    # ``levels`` proves that at most ``frequent`` pairs reach the threshold.
    common = F.broadcast(counts.filter(F.col("n_docs") >= least))
    near = pairs.join(common, "pair").groupBy("row").agg(*sums)
    far = pairs.join(common.select("pair"), "pair", "left_anti").join(counts.filter(F.col("n_docs") < least).hint("shuffle_hash"), "pair").groupBy("row").agg(*sums)
    return near.unionByName(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def digest(aligned: DataFrame, statistics: DataFrame) -> DataFrame:
    """The contract's columns from the operator's outputs."""
    groups = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    rows = aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", groups.alias("groups_sha256"))
    joined = rows.join(statistics, "row", "left")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
