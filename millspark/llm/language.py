"""Language identification with error-correcting output codes.

Every language has a codeword of +-1 bits. One binary classifier per bit, linear over hashed byte n-grams, predicts that
bit of the text's language. A prediction is decoded to the codeword of least loss; each bit's hinge loss weighs as much
as the bit is reliable on the training rows. A text whose second-best codeword is about as near is flagged ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millspark.llm.common import crc_remainder, picked

DIMS = 4096
TRAIN_ROWS = 4000
RIDGE = 0.3
AMBIGUOUS = 0.5
SOLVER_ROUNDS = 300
SOLVER_RESIDUAL = 1e-3


def code_table(n: int, seed: int = 5) -> np.ndarray:
    """Codewords of n classes: all distinct splits up to five classes, beyond that the best of seeded random codes."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        columns = [[1, *c] for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(columns).T
    rng, best, distance = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice((-1, 1), (n, 12 * (n - 1).bit_length()))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = ((code[:, None, :] != code[None, :, :]).sum(axis=2) + np.eye(n) * code.shape[1]).min()
        if apart > distance:
            best, distance = code, apart
    return best


def features(text: str) -> np.ndarray:
    """Unit vector of square roots of hashed 2- and 3-gram counts over the lower-cased text's bytes."""
    data = np.frombuffer(f" {text.lower()} ".encode(errors="replace"), np.uint8).astype(np.uint32)
    two = data[:-1] << np.uint32(8) | data[1:]
    three = (two[:-1] << np.uint32(8) | data[2:]) | np.uint32(1 << 24)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    mixed = np.concatenate((two, three)) * np.uint32(0x9E3779B1)
    counts = np.sqrt(np.bincount(mixed >> shift, minlength=DIMS))
    return (counts / max(1e-9, np.sqrt((counts * counts).sum()))).astype(np.float32)


def ridge(x: np.ndarray, target: np.ndarray, penalty: float) -> np.ndarray:
    """Regularised least squares for every column of ``target`` by conjugate gradients, which need no Gram matrix."""
    weights = np.zeros((x.shape[1], target.shape[1]), np.float32)
    residual = x.T @ target
    direction, size = residual.copy(), (residual * residual).sum(axis=0)
    goal, tiny = SOLVER_RESIDUAL ** 2 * size, np.float32(1e-30)
    for _ in range(SOLVER_ROUNDS):
        if (size <= goal).all():
            break
        image = x.T @ (x @ direction) + np.float32(penalty) * direction
        step = size / np.maximum(tiny, (direction * image).sum(axis=0))
        weights += step * direction
        residual -= step * image
        before, size = size, (residual * residual).sum(axis=0)
        direction = residual + size / np.maximum(tiny, before) * direction
    return weights


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Languages, codewords, bit weights, reliabilities and offsets of one fit; its size does not depend on the corpus."""
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        margins = x @ self.weights + self.offset
        return np.maximum(0, 1 - margins[:, None, :] * self.codes[None]) @ self.trust


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(lang, features(text)) for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if has_letter(text)]
        at = [np.flatnonzero(x).astype("<u2") for _, x in rows]
        yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in rows], pa.string()), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([x[a].astype("<f4").tobytes() for a, (_, x) in zip(at, rows)], pa.binary())], names=["lang", "at", "value"])


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 7) -> Model:
    """Fit on about ``train_rows`` rows of (doc_id, text, lang), drawn by id hash in equal shares per language.

    The bound is the only limit: rows are whole texts from everywhere in the table. Rows without language or letters are
    not used. Without any usable row the model knows no language.
    """
    labelled = picked(labelled, doc_id="long", text="string", lang="string").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.ones((0, 0)), np.zeros((DIMS, 0)), np.zeros(0), np.zeros(0))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, train_rows / len(counts) / n))])
    drawn = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 24)) < share[F.col("lang")] * F.lit(float(1 << 24)))
    rows = sorted((r["lang"], bytes(r["at"]), bytes(r["value"])) for r in drawn.select("text", "lang").mapInArrow(_vectors, "lang string, at binary, value binary").collect())
    languages = sorted({r[0] for r in rows})
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, (_, at, value) in enumerate(rows):
        x[i, np.frombuffer(at, "<u2")] = np.frombuffer(value, "<f4")
    y = np.array([languages.index(r[0]) for r in rows], np.int64)
    # The driver's memory is bounded by train_rows x DIMS: that one array is changed in place, never copied or squared.
    del rows
    codes = code_table(len(languages))
    # Regularised least squares per bit, every language weighing the same.
    size = np.bincount(y, minlength=max(1, len(languages)))
    weight = np.sqrt(len(y) / (len(languages) * size[y])) if len(y) else np.zeros(0)
    offset = codes.mean(axis=0) if len(codes) else np.zeros(0)
    x *= weight[:, None].astype(np.float32)
    target = (codes[y] - offset) * weight[:, None]
    weights = ridge(x, target.astype(np.float32), RIDGE)
    right = (((x @ weights) / weight[:, None] + offset) * codes[y] > 0).mean(axis=0) if len(y) else np.zeros(codes.shape[1])
    return Model(languages, codes, weights, offset, np.maximum(0.05, 2 * right - 1))


def _predict(model: Model, ambiguous: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                if not model.languages or not has_letter(text):
                    out.append(("und", 0.0, False))
                    continue
                loss = model.losses(features(text)[None])[0]
                order = np.argsort(loss, kind="stable")
                near = np.exp(loss[order[0]] - loss)
                out.append((model.languages[order[0]], float(near[order[0]] / near.sum()), bool(len(order) > 1 and loss[order[1]] - loss[order[0]] < ambiguous)))
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()))]], names=[*batch.schema.names[1:], "lang_pred", "score", "ambiguous"])
    return run


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), ambiguous: float = AMBIGUOUS) -> DataFrame:
    """The ``carry`` columns of each row with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    Whole texts are read. Null texts and texts without a letter are ``und`` with score 0, as is every text under a model
    without languages. Null and repeated ids pass through; an empty table gives an empty table.
    """
    kinds = dict(docs.dtypes)
    rows = picked(docs, text="string", **{c: kinds[c] for c in carry if c != "text"})
    rows = rows.select(F.col("text").alias("_text"), *[F.col(f"`{c}`") for c in carry])
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", lang_pred string, score double, ambiguous boolean"
    return rows.mapInArrow(_predict(model, ambiguous), schema)


def identified_held_out(docs: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """Fit on the documents whose id remainder is not ``held``; predict all and mark the held-out ones."""
    remainder = crc_remainder(F.col("doc_id"), modulus)
    model = fit(picked(docs, doc_id="long", text="string", lang="string").filter(remainder != held))
    return identify(picked(docs, doc_id="long", text="string"), model).withColumn("held_out", remainder == held).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
