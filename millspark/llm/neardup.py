"""Near-duplicate classes from ProbMinHash signatures of weighted word shingles.

A text is its shingles (``shingle`` neighbouring lower-cased words) weighted by how often each occurs. Every shingle sends
exponential arrivals of rate weight to random signature registers; a register keeps its earliest shingle. A shingle stops
as soon as its next arrival is later than all registers hold, so nearly all stop at once. Two signatures agree in a
register with the probability Jaccard similarity of the weighted shingles.

Texts with equal shingles are one *text*, represented by their smallest document. Signatures are cut into bands; texts
that share a band are candidates. Candidates are verified exactly on their shingles, without writing out the pairs of a
group: each text of a band's bucket is checked against one text drawn from the bucket, checked links are joined to components,
and only texts of one bucket that are still in different components are compared with each other, block by block, by
signature and then exactly. A pair that is not compared is already in one class, so the classes are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millspark.llm.common import Words, batches_of, mix, picked, rolling, sized
from millspark.llm.components import components
from millspark.session import staged

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
BAND_ROWS = 4
CHUNK_BYTES = 8 << 20
# A candidate whose signatures agree this much less than the similarity is not verified: six standard errors,
# so that far fewer pairs are lost here (1e-8 at the threshold) than by sharing no band.
SLACK = 0.25
BLOCK = 1024
HEAD_ROUNDS = 2
BROADCAST_IDS = 1_000_000
MULTIPLIER = 0xE7037ED1A0B428DB


def weighted_shingles(texts: pa.ChunkedArray | pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(text row, shingle hash, count) by rising row and hash, and the number of texts.

    A text of fewer words than a shingle is one shingle of all its words; a text without words has none.
    """
    words = Words(texts, lower=True)
    hashes = words.hashes(3)
    at = words.windows(size)
    row, value = words.row[at], rolling(hashes, size, MULTIPLIER)[at] if len(at) else np.empty(0, np.uint64)
    for i in np.flatnonzero((words.counts > 0) & (words.counts < size)):
        own = hashes[words.first[i]:words.first[i + 1]]
        row, value = np.append(row, i), np.append(value, rolling(own, len(own), MULTIPLIER))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if not len(row):
        return row, value, np.empty(0, np.int64), len(words.counts)
    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (value[1:] != value[:-1]))))
    return row[new], value[new], np.diff(np.append(new, len(row))), len(words.counts)


def signatures(row: np.ndarray, value: np.ndarray, count: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """ProbMinHash registers (hash of the earliest shingle) of all texts at once; zero where a text has no shingle."""
    times = np.full(texts * registers, np.inf)
    keeps = np.zeros(texts * registers, np.uint64)
    latest = np.full(texts, np.inf)
    clock = np.zeros(len(row))
    live = np.arange(len(row))
    arrival = 0
    while len(live):
        arrival += 1
        draw = mix(value[live], 1000 + arrival)
        clock[live] += -np.log1p(-((draw >> np.uint64(11)).astype(float) * 2.0 ** -53)) / count[live]
        live = live[clock[live] < latest[row[live]]]
        slot = (mix(value[live], 500_000 + arrival) % np.uint64(registers)).astype(np.int64) + row[live] * registers
        # Latest first, so that the earliest arrival of a slot is written last.
        order = np.argsort(-clock[live], kind="stable")
        slot, who = slot[order], live[order]
        better = clock[who] < times[slot]
        slot, who = slot[better], who[better]
        times[slot] = clock[who]
        keeps[slot] = value[who]
        open_ = np.unique(row[live])
        latest[open_] = times.reshape(texts, registers)[open_].max(axis=1)
        live = live[clock[live] < latest[row[live]]]
    return mix(keeps, 9).reshape(texts, registers) * (np.bincount(row, minlength=texts) > 0)[:, None].astype(np.uint64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two sorted (hash, count) shingle sets."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    if not len(a[1]) or (a[1].max() == 1 and b[1].max() == 1):
        return len(both) / (len(a[0]) + len(b[0]) - len(both))
    # Sum over common shingles of 1 / sum_k max(x_k / x_i, y_k / y_i), with k running over all shingles of both texts.
    # Sorted by ratio y / x, the first sum is over shingles with a smaller ratio, the second over the others.
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    alone_x, alone_y = float(a[1].sum() - x.sum()), float(b[1].sum() - y.sum())
    upto = np.searchsorted(ratio, ratio, side="right")
    below_x = np.concatenate(([0], np.cumsum(x)))[upto]
    above_y = y.sum() - np.concatenate(([0], np.cumsum(y)))[upto]
    return float((1 / ((below_x + alone_x) / x + (above_y + alone_y) / y)).sum())


def _sign(size: int, registers: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of(batches, "text", CHUNK_BYTES):
            row, value, count, texts = weighted_shingles(table["text"], size)
            signs = signatures(row, value, count, texts, registers).astype("<u4")
            # Texts with equal shingles and counts share these two sums.
            one = np.bincount(row, minlength=texts) > 0
            whole = mix(value, 71) * count.astype(np.uint64)
            other = mix(value ^ mix(count.astype(np.uint64), 72), 73)
            first = np.searchsorted(row, np.flatnonzero(one))
            sums = np.zeros((2, texts), np.uint64)
            if len(first):
                sums[0, one], sums[1, one] = np.add.reduceat(whole, first), np.add.reduceat(other, first)
            yield pa.RecordBatch.from_arrays([
                table["doc_id"].combine_chunks(), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(one),
                pa.array([s.tobytes() for s in signs], pa.binary())], names=["doc_id", "h1", "h2", "worded", "sign"])
    return run


def _agreeing(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [float((np.frombuffer(a, "<u4") == np.frombuffer(b, "<u4")).mean()) >= least for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shingle_sets(texts: pa.ChunkedArray | pa.Array, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    row, value, count, n = weighted_shingles(texts, size)
    cut = np.searchsorted(row, np.arange(n + 1))
    return [(value[a:b], count[a:b]) for a, b in zip(cut, cut[1:])]


def _verified(size: int, least: float):
    """Exact similarity of the two texts of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of(batches, "tb", CHUNK_BYTES):
            # The same first text stands in many neighbouring rows.
            first = table["ta"].combine_chunks().dictionary_encode()
            left, right = _shingle_sets(first.dictionary, size), _shingle_sets(table["tb"], size)
            score = [similarity(left[i], y) for i, y in zip(first.indices.to_pylist(), right)]
            keep = pa.array([s >= least - 1e-9 for s in score], pa.bool_())
            yield pa.RecordBatch.from_arrays([table["a"].combine_chunks(), table["b"].combine_chunks(), pa.array(score, pa.float64())], names=["a", "b", "similarity"]).filter(keep)
    return run


BLOCKS = "bucket long, i int, j int, band int, side int, id long, component long, sign binary"


def _candidates(table: pa.Table, bands: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each text of side 0 the texts of side 1 to verify: in another component, of near enough signature, and with
    this band as the first that both share, so that a pair comes up once however many buckets hold it."""
    comp, side, band = table["component"].to_numpy(), table["side"].to_numpy(), table["band"][0].as_py()
    signs = np.frombuffer(b"".join(table["sign"].to_pylist()), "<u4").reshape(len(comp), -1)
    right = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0):
        near = right[comp[right] != comp[i]]
        same = signs[near] == signs[i]
        fits = (same.mean(axis=1) >= least) & (same.reshape(len(near), bands, -1).all(axis=2).argmax(axis=1) == band)
        if fits.any():
            yield i, near[fits]


def _across(bands: int, least: float):
    """The rows of a block pair that have something to verify."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        keep = np.zeros(table.num_rows, bool)
        for i, near in _candidates(table, bands, least):
            keep[i] = True
            keep[near] = True
        return table.filter(pa.array(keep))
    return run


def _across_verified(size: int, bands: int, least: float, enough: float):
    """Verified links of a block pair, one for each text and component at most: a second one would join nothing."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, comp = table["id"].to_numpy(), table["component"].to_numpy()
        sets, a, b = _shingle_sets(table["text"], size), [], []
        for i, near in _candidates(table, bands, enough):
            joined: set[int] = set()
            for j in near.tolist():
                if comp[j] not in joined and similarity(sets[i], sets[j]) >= least - 1e-9:
                    joined.add(comp[j])
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _verify(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Exact similarity of candidate pairs: those of at least ``least``."""
    joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return joined.select("a", "b", "ta", "tb").mapInArrow(_verified(size, least), "a long, b long, similarity double")


def _joined(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id, component`` after new links: only links between components are walked, not those found before."""
    ends = links.select("a", "b").join(members.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a")
    ends = ends.join(members.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b").distinct()
    found = components(ends).select(F.col("node").alias("component"), F.col("component").alias("_least"))
    return staged(members.join(found, "component", "left").select("id", F.coalesce("_least", "component").alias("component")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """``doc_id, class_id, n_copies`` for each row: the smallest document of its class, and how many rows share its shingles.

    Documents are near-duplicates if the probability Jaccard similarity of their shingles (counts as weights) is at least
    ``least``; classes are the connected components. Texts that differ only in ASCII letter case or white space are
    equal. Null texts and texts without words are alone in their class. A null ``doc_id`` is a class of its own and comes
    back null. Rows that repeat a ``doc_id`` with different texts are one document for its class. An empty table gives
    an empty table. A pair at the threshold shares no band with probability (1 - least**band_rows)**bands (3e-6).
    """
    docs = picked(docs, doc_id="long", text="string").withColumn("text", F.col("text").cast("binary"))
    signed = staged(docs.mapInArrow(_sign(shingle, bands * band_rows), "doc_id long, h1 long, h2 long, worded boolean, sign binary"))
    worded = signed.filter("worded AND doc_id IS NOT NULL")
    groups = staged(worded.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.count("*").alias("n_copies"), F.min_by("sign", "doc_id").alias("sign")))
    spots = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(sign, {1 + 4 * band_rows * i}, {4 * band_rows})")) for i in range(bands)])
    buckets = groups.select("id", F.posexplode(spots).alias("band", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    buckets = staged(buckets.join(shared, "bucket"))
    signs = groups.select("id", "sign")
    # The texts that share a bucket with another, once for all verifications.
    bucketed = sized(buckets.select("id").distinct(), BROADCAST_IDS)
    texts = staged(docs.withColumnRenamed("doc_id", "id").join(bucketed, "id", "left_semi"))
    # First: every text against the head of each of its buckets. Heads are drawn by hash, later by the number of links
    # found: the texts nearest to the middle of a loose group. Texts already in the head's component need no check.
    members = staged(buckets.select("id", F.col("id").alias("component")).distinct())
    labelled, links = buckets.withColumn("component", F.col("id")), None
    for step in range(HEAD_ROUNDS):
        if step:
            degrees = links.select(F.col("a").alias("id")).unionAll(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("links"))
            ranked = labelled.join(degrees, "id", "left")
        else:
            ranked = labelled.withColumn("links", F.lit(0))
        order = F.struct(F.coalesce("links", F.lit(0)), F.xxhash64("bucket", "id", F.lit(step)))
        heads = ranked.groupBy("bucket").agg(F.max_by(F.struct("id", "component"), order).alias("head"))
        pairs = labelled.join(heads, "bucket").filter(F.col("component") != F.col("head.component")).select(F.least("head.id", "id").alias("a"), F.greatest("head.id", "id").alias("b")).distinct()
        pairs = pairs.join(signs.select(F.col("id").alias("b"), F.col("sign").alias("sb")), "b").join(signs.select(F.col("id").alias("a"), F.col("sign").alias("sa")), "a").select("a", "b", "sa", "sb")
        pairs = staged(pairs.mapInArrow(lambda batches: _agreeing(batches, least - SLACK), "a long, b long").distinct())
        found = staged(_verify(pairs, texts, shingle, least))
        links = found if links is None else staged(links.unionByName(found).dropDuplicates(["a", "b"]))
        members = _joined(members, found)
        labelled = staged(buckets.join(members, "id"))
    # Then: what is still apart within a bucket. All but the bucket's largest component meet the whole bucket, by blocks.
    sizes = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("components")).filter("components > 1")
    sizes = sizes.select("bucket", F.col("most.component").alias("most"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("n") / BLOCK).cast("int").alias("all"))
    apart = labelled.join(sizes, "bucket").join(signs, "id")
    place = F.xxhash64("id")
    few = apart.filter("component <> most").select("bucket", F.pmod(place, "few").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), "band", F.lit(0).alias("side"), "id", "component", "sign")
    every = apart.select("bucket", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"), F.pmod(place, "all").cast("int").alias("j"), "band", F.lit(1).alias("side"), "id", "component", "sign")
    open_ = staged(few.unionByName(every).groupBy("bucket", "i", "j").applyInArrow(_across(bands, least - SLACK), BLOCKS))
    more = open_.join(texts, "id").groupBy("bucket", "i", "j").applyInArrow(_across_verified(shingle, bands, least, least - SLACK), "a long, b long")
    more = staged(more.distinct())
    named = groups.join(_joined(members, more), "id", "left").select("h1", "h2", "n_copies", F.coalesce("component", "id").alias("class_id"))
    out = signed.select("doc_id", "h1", "h2", (F.col("worded") & F.col("doc_id").isNotNull()).alias("worded"))
    out = out.join(named, ["h1", "h2"], "left")
    alone = ~F.col("worded")
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 1).otherwise(F.col("n_copies")).cast("long").alias("n_copies"))
