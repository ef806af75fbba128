"""Fill-in-middle transformation with a piecewise-linear learned rank index.

A text's code points start at byte offsets that rise with their rank. ``RankIndex`` keeps those offsets as straight
segments whose error is at most ``epsilon`` plus one small residual per boundary: a cut at a rank is predicted by its
segment and corrected exactly by its residual. Cuts are then made on bytes, without decoding a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millspark.llm.common import batches_of, picked

SEED = 1
PLAIN_PERCENT = 10
SPM_PERCENT = 20
EPSILON = 100
FIT_RANKS = 1 << 20
BATCH_BYTES = 4 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class RankIndex:
    """Offsets of all ranks 0 .. n of a rising sequence, as error-bounded segments and residuals of one byte.

    ``add`` takes the offsets in order, a block at a time; a segment starts at an offset and rises by ``rise`` over
    ``run`` ranks. A block starts as one segment; one whose worst error exceeds ``epsilon`` is halved until none does.
    """

    def __init__(self, epsilon: int = EPSILON):
        if not 0 <= epsilon <= 127:
            raise ValueError("residuals are bytes: epsilon is 0 to 127")
        self.epsilon, self.ranks = epsilon, 0
        self._segments, self._residuals = [], []

    def add(self, offsets: np.ndarray) -> None:
        offsets = offsets.astype(np.int64)
        n = len(offsets)
        if not n:
            return
        residuals = np.zeros(n, np.int8)
        starts, ends = np.zeros(1, np.int64), np.full(1, n, np.int64)
        while len(starts):
            sizes = ends - starts
            first = np.cumsum(sizes) - sizes
            step = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            at = step + np.repeat(starts, sizes)
            run, rise = np.maximum(sizes - 1, 1), offsets[ends - 1] - offsets[starts]
            error = offsets[at] - np.repeat(offsets[starts], sizes) - step * np.repeat(rise, sizes) // np.repeat(run, sizes)
            good = np.maximum.reduceat(np.abs(error), first) <= self.epsilon
            fits = np.repeat(good, sizes)
            residuals[at[fits]] = error[fits]
            self._segments.append(np.stack([self.ranks + starts, offsets[starts], rise, run])[:, good])
            starts, ends = starts[~good], ends[~good]
            middle = (starts + ends) // 2
            starts, ends = np.sort(np.concatenate([starts, middle])), np.sort(np.concatenate([middle, ends]))
        self._residuals.append(residuals)
        self.ranks += n

    def seal(self) -> "RankIndex":
        segments = np.concatenate(self._segments, axis=1)
        self.start, self.base, self.rise, self.run = segments[:, np.argsort(segments[0])]
        self.residuals = np.concatenate(self._residuals)
        return self

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.start, ranks, side="right") - 1
        return self.base[at] + (ranks - self.start[at]) * self.rise[at] // self.run[at]

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets of ``ranks``."""
        ranks = np.asarray(ranks, np.int64)
        return self.predict(ranks) + self.residuals[ranks]


def boundaries(data: np.ndarray, epsilon: int = EPSILON, block: int = FIT_RANKS) -> RankIndex:
    """Index of the code points of UTF-8 bytes; the rank after the last one is the end of the bytes."""
    index = RankIndex(epsilon)
    for i in range(0, len(data), block):
        index.add(i + np.flatnonzero((data[i:i + block] & 0xC0) != 0x80))
    index.add(np.array([len(data)]))
    return index.seal()


def _draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i:i + 8], 16) for i in range(0, 32, 8))


def _transform(seed: int, plain_percent: int, spm_percent: int, epsilon: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of(batches, "text", BATCH_BYTES):
            ids = table.column("doc_id").to_pylist()
            texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
            data = np.frombuffer(b"".join(texts), np.uint8)
            # One index over all texts of the batch: a text's boundaries are a stretch of its ranks.
            index = boundaries(data, epsilon)
            ends = np.cumsum([0] + [len(t) for t in texts])
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[ends]
            counts = np.diff(points)
            draws = np.array([_draws(d, seed) for d in ids], np.int64).reshape(len(ids), 4)
            plain = (counts == 0) | (draws[:, 2] % 100 >= 100 - plain_percent) | np.array([any(m in t for m in marks) for t in texts], bool)
            one, two = draws[:, 0] % (counts + 1), draws[:, 1] % (counts + 1)
            low, high = np.minimum(one, two), np.maximum(one, two)
            cut_low, cut_high = (index.offsets(points[:-1] + x) - ends[:-1] for x in (low, high))
            spm = draws[:, 3] % 100 < spm_percent
            forms, outputs = [], []
            for i, text in enumerate(texts):
                a, b = int(cut_low[i]), int(cut_high[i])
                head, middle, tail = text[:a], text[a:b], text[b:]
                p, s, m = marks
                forms.append("plain" if plain[i] else "spm" if spm[i] else "psm")
                outputs.append(text if plain[i] else b"".join((s, tail, p, head, m, middle)) if spm[i] else b"".join((p, head, s, tail, m, middle)))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(forms), pa.array(low, pa.int64(), mask=plain),
                pa.array(high - low, pa.int64(), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, epsilon: int = EPSILON) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each row of ``docs``.

    Both cuts depend on ``seed``, ``doc_id`` and the number ``n`` of code points only, so reruns agree and rows that repeat
    an id and a text give the same output; a null id draws as an empty one. A null or empty text, a text that holds a
    marker and ``plain_percent`` of the others stay as they are. Parts may be empty. An empty table gives an empty table.
    """
    docs = picked(docs, doc_id="long", text="string")
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.mapInArrow(_transform(seed, plain_percent, spm_percent, epsilon), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed ``output`` was made of. Texts hold no marker, so each marker splits once."""
    parts = F.split(F.substring(output, len(PREFIX) + 1, 2**31 - 1), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(parts[0], parts[2], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(parts[1], parts[2], parts[0]))


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns from the operator's output."""
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return result.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, length(text) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
 CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
 CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, substring(text, 1, lo) AS a, substring(text, lo + 1, hi - lo) AS b, substring(text, hi + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
 sha256(text) AS restored_sha256
FROM p
"""
