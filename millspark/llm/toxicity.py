"""Toxicity scores from a subsequence string-kernel SVM with Nystroem landmarks.

The kernel compares two words by their common subsequences of three letters, each occurrence weighing less the more
letters it skips, so an insult with inserted, repeated or dropped letters stays near the insult. Training works on
labelled sentences as bags of words: no sentence of a clean text may hold a word on the wrong side, a toxic text must
hold one in its worst sentence. It starts from words whose document counts over distinct texts differ most between the
labels: those that are the most telling word of some toxic texts, and those in many toxic texts. It is refit once on the
witness words of the training texts of both labels. Words are mapped to landmark space through the inverse square root of
the landmarks' kernel matrix and separated there by a linear SVM. The fitted function is a sum of kernels to the
landmarks, which is linear in a word's subsequence weights, so scoring needs one weight per subsequence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millspark.llm.common import Words, crc_remainder, picked, rolling
from millspark.session import staged

TRAIN_ROWS = 12_000
TRAIN_WORDS = 6_000
LANDMARKS = 400
# Distinct toxic texts whose most telling word a word must be to start as an insult, whatever the draw.
SUPPORT = 3
# Distinct toxic texts that a word needs to start as an insult beside a more telling one: too many for chance.
SURE = 24
# Words per unexplained toxic text among which its witness is sought.
OFFERED = 20
DECAY = 0.5
GAP = 3
RIDGE = 1e-3
COST = 10.0
# Strongest insults that virtual examples are made of.
VIRTUAL = 100
CACHED_WORDS = 300_000
SYMBOLS = 32
# Digits and signs that stand for letters inside a word.
LOOKALIKES = str.maketrans("013457@$", "oieastas")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
SENTENCE = re.compile(r"[.!?\n]+\s")


def _folded(token: str) -> str:
    """A token's letters: look-alike signs read as letters, accents and other signs gone."""
    if token.isalpha():
        return token
    plain = token.strip(".,;:!?\"'()[]{}<>-_*#")
    if plain.isalpha():
        return plain
    if any(c.isalpha() for c in plain):
        plain = plain.translate(LOOKALIKES)
    return "".join(c for c in plain if c.isalpha())


def words_of(text: str | None) -> set[str]:
    """Distinct folded words of a text; letters spelled out one by one also count as one word."""
    if not text:
        return set()
    text = text.lower()
    tokens = set(text.split())
    tokens.update(m.group().replace(" ", "").replace("\t", "") for m in SPACED.finditer(text))
    return {w for w in map(_folded, tokens) if len(w) > 1}


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words laid end to end as symbols 0..31, each between two boundary symbols, and the word of each."""
    data = np.frombuffer("".join(f"`{w}`" for w in words).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    symbols = np.where((data >= 96) & (data < 123), data - 96, 27 + (data * np.uint32(2654435761) >> np.uint32(16)) % 5).astype(np.int64)
    return symbols, np.repeat(np.arange(len(words)), lengths)


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, code, weight) for every subsequence of three symbols that skips at most ``GAP``."""
    symbols, word = _symbols(words)
    n = len(symbols)
    for a in range(1, GAP + 2):
        for b in range(1, GAP + 3 - a):
            if n > a + b:
                same = word[:n - a - b] == word[a + b:]
                code = (symbols[:n - a - b] * SYMBOLS + symbols[a:n - b]) * SYMBOLS + symbols[a + b:]
                yield word[:n - a - b][same], code[same], DECAY ** (a + b - 2)


def _matrix(words: list[str]) -> np.ndarray:
    """Normalised subsequence weights, dense; used for landmarks and training words in small slices."""
    out = np.zeros((len(words), SYMBOLS ** 3), np.float32)
    for word, code, weight in subsequences(words):
        np.add.at(out, (word, code), weight)
    return out / np.maximum(_norms(words), 1e-9)[:, None].astype(np.float32)


def _norms(words: list[str]) -> np.ndarray:
    """The length of a word without repeated subsequences; dividing by any positive number keeps a kernel a kernel."""
    total = np.zeros(len(words))
    for word, _, weight in subsequences(words):
        total += np.bincount(word, minlength=len(words)) * weight * weight
    return np.sqrt(total)


def _kernels(words: list[str], base: np.ndarray) -> np.ndarray:
    """Normalised kernels of words to landmarks, whose weights are the columns of ``base``."""
    out = np.zeros((len(words), base.shape[1]))
    for word, code, weight in subsequences(words):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        if len(first):
            out[word[first]] += np.add.reduceat(base[code], first, axis=0) * weight
    return out / np.maximum(_norms(words), 1e-9)[:, None]


@dataclass
class Model:
    """One weight per subsequence, an offset, and the scale from margins to scores; bounded whatever the corpus."""
    weights: np.ndarray
    offset: float
    scale: np.ndarray

    def margins(self, words: list[str]) -> np.ndarray:
        total, norm = np.zeros(len(words)), np.zeros(len(words))
        for word, code, weight in subsequences(words):
            total += np.bincount(word, self.weights[code], len(words)) * weight
            norm += np.bincount(word, minlength=len(words)) * weight * weight
        return total / np.maximum(np.sqrt(norm), 1e-9) + self.offset


class Scorer:
    """Best margins per text, with a bounded cache of words seen before."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def top(self, texts: list[str | None]) -> list[tuple[float, float, str]]:
        """The two largest word margins of each text and the worst word; texts without words get the lowest margin."""
        found = [words_of(t) for t in texts]
        new = list(set().union(*found).difference(self.known)) if found else []
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known = {}
            new = list(set().union(*found))
        for i in range(0, len(new), 50_000):
            part = new[i:i + 50_000]
            self.known.update(zip(part, self.model.margins(part).tolist()))
        known, out = self.known, []
        for words in found:
            ranked = sorted(map(known.__getitem__, words))[-2:] if words else []
            first = ranked[-1] if ranked else -2.0
            out.append((first, ranked[0] if len(ranked) > 1 else -2.0, max(words, key=known.__getitem__) if words else ""))
        return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps on the rows inside the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x1.shape[1]), np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        inside = y * (x1 @ w) < 1
        xi, ci = x1[inside], COST * weight[inside]
        new = np.linalg.solve(ridge + xi.T @ (xi * ci[:, None]), xi.T @ (ci * y[inside]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def disguised(word: str) -> list[str]:
    """Virtual examples of an insult: each inner letter doubled, and a foreign letter put in at each inner place."""
    return [word[:i] + c + word[i:] for i in range(1, len(word)) for c in (word[i - 1], "qxzkwj"[(hash_of(word) + i) % 6])]


def _fit_words(positive: list[str], negative: list[str], landmarks: int) -> tuple[np.ndarray, float]:
    """SVM on landmark features; returns one weight per subsequence and the offset."""
    marks = positive[:landmarks // 2] + negative[:landmarks - min(len(positive), landmarks // 2)]
    base = _matrix(marks)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 0) + RIDGE)
    positive = positive + [v for w in positive[:VIRTUAL] if len(w) > 3 for v in disguised(w)]
    words = positive + negative
    columns = np.ascontiguousarray(base.T)
    x = np.vstack([_kernels(words[i:i + 200], columns) for i in range(0, len(words), 200)]) @ root
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    weight = np.where(y > 0, len(negative) / max(1, len(positive)), 1.0)
    w, offset = _svm(x, y, np.minimum(weight, 20))
    return base.T @ (root @ w).astype(np.float32), offset


def _rows(out: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(kinds), kinds.values())], names=list(kinds))


def _sketches(texts: pa.Array) -> list[int]:
    """The smallest hash of three neighbouring words of each text: near copies mostly share it, other texts do not."""
    words = Words(texts, lower=True)
    hashes, first = words.hashes(11), words.windows(3)
    out = np.full(len(texts), -1, np.int64).view(np.uint64)
    np.minimum.at(out, words.row[first], rolling(hashes, 3, 0x9E3779B97F4A7C15)[first])
    # Texts of one or two words: all of them.
    short = words.counts[words.row] < 3
    with np.errstate(over="ignore"):
        np.add.at(out, words.row[short], hashes[short])
    return out.view(np.int64).tolist()


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each text with its sketch and label: a word's support is its texts, near copies counted once."""
    for batch in batches:
        texts = batch.column(0)
        out = [(w, sketch, toxic) for text, sketch, toxic in zip(texts.to_pylist(), _sketches(texts), batch.column(1).to_pylist()) for w in words_of(text) if len(w) <= 40]
        yield _rows(out, word=pa.string(), sketch=pa.int64(), toxic=pa.int32())


def _telling(scores: dict[str, tuple[bool, float]]):
    """The most telling word of each text, and those that are equally telling as not ``chosen``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                known = [w for w in words_of(text) if w in scores]
                best = max(map(scores.__getitem__, known), default=None)
                out += [(w, i == 0) for i, w in enumerate(sorted(w for w in known if scores[w] == best))]
            yield _rows(out, word=pa.string(), chosen=pa.bool_())
    return run


def _offered(model: Model):
    """The words with the largest margins of each text that the model does not mark, and the text's copies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            out = []
            for text, copies, row in zip(*(c.to_pylist() for c in batch.columns)):
                if scorer.top([text])[0][0] <= 0:
                    ranked = sorted(((scorer.known[w], w) for w in words_of(text) if len(w) <= 40), reverse=True)[:OFFERED]
                    out += [(row, copies, w, margin) for margin, w in ranked]
            yield _rows(out, row=pa.int64(), copies=pa.int64(), word=pa.string(), first=pa.float64())
    return run


def _witnesses(model: Model):
    """The worst word of each text, of a clean text's sentences on the wrong side or near it, and of a toxic text's marked ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tops = scorer.top(SENTENCE.split(text or ""))
                whole = scorer.top([text])[0]
                out += [(whole[2], toxic, whole[0], whole[1], True)]
                out += [(t[2], toxic, t[0], t[1], False) for t in tops if t[0] > (0 if toxic else -0.8) and t[2] != whole[2]]
            yield _rows(out, word=pa.string(), toxic=pa.int32(), first=pa.float64(), second=pa.float64(), whole=pa.bool_())
    return run


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_words: int = TRAIN_WORDS, landmarks: int = LANDMARKS, seed: int = 3) -> Model | None:
    """Fit on about ``train_rows`` labelled texts, half of each label, drawn by id hash; None without both labels."""
    labels = picked(labels, doc_id="long", toxic="int").filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("toxic") == 1, train_rows / 2 / counts[1]).otherwise(train_rows / 2 / counts[0])
    drawn = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 24)) < share * float(1 << 24))
    # Bounded by train_rows: small enough to send to every task. Copies of a text count once.
    texts = staged(picked(docs, doc_id="long", text="string").join(F.broadcast(drawn), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"), F.count("*").alias("copies")))
    total = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return None
    found = texts.mapInArrow(_word_rows, "word string, sketch long, toxic int").distinct()
    counted = found.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).persist()
    rate = (F.col("bad") + 0.5) / (total[1] + 1) / ((F.col("n") - F.col("bad") + 0.5) / (total[0] + 1))
    # Words in fewer texts come last; they count only where no word is told by more.
    backed = F.col("bad") >= SUPPORT
    telling = counted.filter((F.col("bad") > 0) & (backed & (rate >= 6) | ~backed & (F.col("n") == F.col("bad")))).select("word", "bad", backed.alias("backed"), (F.col("bad") * F.log(rate)).alias("score"))
    ranked = {r["word"]: r for r in telling.orderBy(F.col("backed").desc(), F.col("score").desc(), "word").limit(train_words * 8).collect()}
    scores = {w: (r["backed"], r["score"]) for w, r in ranked.items()}
    told = texts.filter("toxic = 1").mapInArrow(_telling(scores), "word string, chosen boolean")
    named = {r["word"]: r for r in told.groupBy("word").agg(F.count_if("chosen").alias("chosen"), F.count("*").alias("all")).collect()}
    # One word per text keeps companions of an insult out; without enough texts for any word all are taken.
    support = {w: r["chosen"] for w, r in named.items() if r["chosen"] >= SUPPORT} or {w: r["all"] for w, r in named.items()}
    least = min(SUPPORT, max(support.values(), default=0))
    positive = [w for w, r in ranked.items() if support.get(w, 0) >= least or r["bad"] >= SURE][:train_words // 4]
    if not positive:
        counted.unpersist()
        return None
    clean = counted.filter((F.col("n") > F.col("bad")) & (rate < 3))
    frequent = clean.orderBy((F.col("n") - F.col("bad")).desc(), "word").limit(train_words // 3)
    rare = clean.orderBy(F.xxhash64("word"), "word").limit(train_words // 3)
    negative = sorted({r["word"] for r in frequent.union(rare).collect()} - set(positive), key=lambda w: (hash_of(w), w))
    model = Model(*_fit_words(positive, negative, landmarks), np.array([0.0, 1.0, 0.0]))
    for last in (False, True):
        rows = texts.mapInArrow(_witnesses(model), "word string, toxic int, first double, second double, whole boolean")
        if last:
            seen = rows.filter("whole").select("first", "second", "toxic").collect()
            model.scale = _logistic(np.array([(r["first"], r["second"]) for r in seen]), np.array([r["toxic"] for r in seen]))
        else:
            hard = rows.filter("toxic = 0").groupBy("word").agg(F.max("first").alias("first")).orderBy(F.col("first").desc(), "word").limit(train_words // 3).collect()
            # Worst words of toxic texts that no clean text has. A text that is not marked gives the one that most texts
            # have, if as many labelled rows, copies too, speak for it.
            pure = counted.filter("n = bad").select("word", "bad")
            worst = rows.filter("toxic = 1 AND first > 0").select("word").distinct().join(pure, "word")
            offered = texts.filter("toxic = 1").select("text", "copies", F.xxhash64("text").alias("row")).mapInArrow(_offered(model), "row long, copies long, word string, first double").join(pure, "word")
            missed = offered.groupBy("row", "copies").agg(F.max_by("word", F.struct("bad", "first", "word")).alias("word")).groupBy("word").agg(
                F.sum("copies").alias("copies")).filter(F.col("copies") >= SUPPORT).select("word").join(pure, "word")
            known = set(positive) | set(negative)
            more = [r["word"] for r in worst.union(missed).distinct().orderBy(F.col("bad").desc(), "word").limit(train_words // 4).collect() if r["word"] not in known]
            positive += more
            negative += [r["word"] for r in hard if r["word"] and r["word"] not in known]
            model = Model(*_fit_words(positive, negative, landmarks), model.scale)
    counted.unpersist()
    return model


def hash_of(word: str) -> int:
    return int.from_bytes(word.encode()[:8], "little") * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scale from the two best margins to a probability."""
    x1, w = np.hstack([np.clip(x, -3, 3), np.ones((len(x), 1))]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x1 @ w)))
        step = np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + 1e-2 * np.eye(3), x1.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in batches:
            if scorer:
                tops = scorer.top(batch.column(1).to_pylist())
                x = np.clip(np.array([t[:2] for t in tops]).reshape(-1, 2), -3, 3)
                score = 1 / (1 + np.exp(-(x @ model.scale[:2] + model.scale[2])))
                word = [t[2] if s >= 0.5 else None for t, s in zip(tops, score)]
            else:
                score, word = np.zeros(batch.num_rows), [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(word, pa.string())], names=["doc_id", "score", "predicted", "witness"])
    return run


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score, predicted, witness`` for each row; ``witness`` is the word that makes a text toxic.

    Whole texts are read. Null and empty texts and texts without words get the score of the lowest margins (clean). Without
    a model (no labelled rows of both kinds) every score is 0. Null and repeated ids pass through; an empty table
    gives an empty table.
    """
    return picked(docs, doc_id="long", text="string").mapInArrow(_score(model), "doc_id long, score double, predicted int, witness string")


def scored_held_out(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """Fit on labels whose id remainder is not ``held``; score all documents and mark the held-out ones."""
    model = fit(docs, picked(labels, doc_id="long", toxic="int").filter(crc_remainder(F.col("doc_id"), modulus) != held))
    return score_toxicity(docs, model).withColumn("held_out", crc_remainder(F.col("doc_id"), modulus) == held).select("doc_id", "held_out", "score", "predicted", "witness")
