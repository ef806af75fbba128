"""Personal data spans by weak supervision.

Four base patterns (email, ip, card, phone) are kept as they are. Wider patterns propose further candidates: e-mail
addresses written out, phone numbers without country code, card numbers in dotted groups, national bank and social
numbers. Labelers (patterns, gazetteers, checksums, words nearby) vote on every candidate or abstain. Expectation
maximisation on the counts of vote patterns estimates how reliable each labeler is and how likely each candidate is
personal data; a logistic classifier over the candidate's shape and surroundings is trained on these likelihoods and
decides which candidates become spans. Vote patterns and shapes are counted over all documents; their number is bounded
by the labelers' answers, not by the corpus.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millspark.llm.common import picked

KINDS = ("email", "ip", "card", "phone")
# Added spans of other kinds follow the base kinds in this order.
ADDED_KINDS = ("iban", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str, failed: list[tuple[str, int, int]] | None = None) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each base pattern that pass its check; linear in the text.

    Matches that fail are dropped; ``failed`` takes them as (kind, start, end) if given.
    """
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found["email"].append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m.group().split(".")):
            found["ip"].append(m.span())
        elif failed is not None:
            failed.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
        elif failed is not None and len(digits) >= 9:
            failed.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found["phone"].append(m.span())
            elif failed is not None:
                failed.append(("phone", *m.span()))
    return found


# Candidates beyond the base patterns. Every quantifier is bounded, so a match attempt is too.
CANDIDATES = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({] ?(?:dot|DOT|\.) ?[\])}]) ?[A-Za-z0-9-]{1,63}){1,4}"),
    "phone": re.compile(r"(?<![0-9+(.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])"),
    "card": re.compile(r"(?<![0-9.])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9.])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
_HINT = re.compile(r"[\[({] ?(?:at|AT|@) ?[\])}]|[0-9]{2}[) ._/-]+[0-9]{2}|[A-Z]{2}[0-9]{2}[ A-Z0-9]")
NEAR = 40
WORDS_FOR = {
    "email": frozenset("mail email e-mail contact kontakt correo courriel address".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon teléfono téléphone móvil handy".split()),
    "card": frozenset("card visa mastercard amex credit kreditkarte tarjeta carte payment".split()),
    "iban": frozenset("iban account konto cuenta compte bank banque banco".split()),
    "ssn": frozenset("ssn social security".split()),
    "ip": frozenset("ip host address server login".split()),
}
WORDS_AGAINST = frozenset("version isbn order invoice total page figure article part serial lot".split())
# First digits of card networks, countries with bank numbers of this form, and top-level domains.
CARD_FIRST = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "36", "35")
IBAN_COUNTRIES = frozenset("DE FR ES GB IT NL BE AT CH PT IE LU PL SE DK FI NO CZ".split())
DOMAINS = frozenset("com org net edu gov io de fr es uk eu info".split())
LABELERS = ("pattern", "checksum", "gazetteer", "context", "repeat")


def _iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def votes(kind: str, span: str, before: str, after: str) -> tuple[int, ...]:
    """One answer per labeler: 1 personal data, -1 not, 0 abstains."""
    digits = _digits(span)
    if kind == "phone":
        pattern = 1 if span[0] in "(+" and 9 <= len(digits) <= 15 else 0 if len(digits) <= 15 else -1
    else:
        pattern = 1 if kind != "card" or 13 <= len(digits) <= 19 else -1
    if kind == "card":
        checksum = 1 if luhn(digits) else -1
    elif kind == "ip":
        checksum = 1 if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in span.split(".")) else -1
    elif kind == "iban":
        checksum = 1 if _iban(span) else -1
    elif kind == "ssn":
        checksum = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 0
    else:
        checksum = 0
    if kind == "card":
        gazetteer = 1 if digits.startswith(CARD_FIRST) else -1
    elif kind == "iban":
        gazetteer = 1 if span[:2] in IBAN_COUNTRIES else -1
    elif kind == "email":
        gazetteer = 1 if re.split(r"[^A-Za-z0-9]+", span)[-1].lower() in DOMAINS else -1
    elif kind == "phone":
        gazetteer = 1 if span[0] == "+" and digits[0] != "0" else -1 if digits[0] in "01" else 1 if len(digits) == 10 else 0
    else:
        gazetteer = 0
    words = set(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", f"{before} {after}".lower()))
    context = 1 if words & WORDS_FOR[kind] else -1 if words & WORDS_AGAINST else 0
    repeat = -1 if digits and len(set(digits)) <= 2 else 0
    return pattern, checksum, gazetteer, context, repeat


def shape(kind: str, span: str, before: str, after: str) -> tuple[int, ...]:
    """Small whole numbers that describe a candidate without its labelers: kind, size, signs, neighbours."""
    digits = _digits(span)
    kinds = (*KINDS, *ADDED_KINDS)
    return (kinds.index(kind), min(len(digits), 20) // 2, min(sum(not c.isalnum() for c in span), 6), int("(" in span), int("." in span),
            0 if not before else 1 if before[-1].isspace() else 2, 0 if not after else 1 if after[0].isspace() else 2)


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[str, int, int, tuple, tuple]]:
    """Candidates clear of the base spans: kind, start, end, votes, shape."""
    if not _HINT.search(text):
        return
    spans = sorted(taken)
    starts = [a for a, _ in spans]
    # The furthest end of all base spans up to each one: a long early span may reach over many later ones.
    reach = list(accumulate((e for _, e in spans), max))
    for kind, pattern in CANDIDATES.items():
        for m in pattern.finditer(text):
            a, b = m.span()
            i = bisect_left(starts, b)
            if i and reach[i - 1] > a:
                continue
            before, after = text[max(0, a - NEAR):a], text[b:b + NEAR]
            yield kind, a, b, votes(kind, m.group(), before, after), shape(kind, m.group(), before, after)


@dataclass
class Model:
    """Labeler reliabilities and classifier weights; its size does not depend on the corpus."""
    prior: float
    reliability: dict[str, tuple[float, float]]
    weights: np.ndarray | None

    def probability(self, shapes: list[tuple[int, ...]], vote_rows: list[tuple[int, ...]]) -> np.ndarray:
        if self.weights is None or not shapes:
            return np.zeros(len(shapes))
        return 1 / (1 + np.exp(-(_features(shapes, vote_rows) @ self.weights)))


def _features(shapes: list[tuple[int, ...]], vote_rows: list[tuple[int, ...]]) -> np.ndarray:
    """One column per value of each shape part, and per labeler the two votes."""
    sizes = (len(KINDS) + len(ADDED_KINDS), 11, 7, 2, 2, 3, 3)
    s, v = np.array(shapes).reshape(-1, len(sizes)), np.array(vote_rows).reshape(-1, len(LABELERS))
    columns = [(s[:, i:i + 1] == np.arange(n)) for i, n in enumerate(sizes)]
    return np.hstack([*columns, v == 1, v == -1, np.ones((len(s), 1), bool)]).astype(float)


def _taken(found: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int]]:
    return [s for spans in found.values() for s in spans]


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple, int] = {}
        for text in batch.column(0).to_pylist():
            if text:
                # Base matches, passed or failed, teach the labelers' reliabilities along with the candidates.
                failed: list[tuple[str, int, int]] = []
                found = base_spans(text, failed)
                rows = [(v, s) for *_, v, s in candidates(text, _taken(found))]
                for k, a, b in failed + [(k, a, b) for k in KINDS for a, b in found[k]]:
                    context = text[a:b], text[max(0, a - NEAR):a], text[b:b + NEAR]
                    rows.append((votes(k, *context), shape(k, *context)))
                for row in rows:
                    counts[row] = counts.get(row, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([list(v) for v, _ in counts], pa.list_(pa.int32())), pa.array([list(s) for _, s in counts], pa.list_(pa.int32())), pa.array(list(counts.values()), pa.int64())], names=["votes", "shape", "n"])


def fit(docs: DataFrame, rounds: int = 50) -> Model:
    """Estimate reliabilities from the vote patterns of all candidates of all documents and train the span classifier."""
    texts = picked(docs, text="string")
    rows = texts.mapInArrow(_patterns, "votes array<int>, shape array<int>, n long").groupBy("votes", "shape").agg(F.sum("n").alias("n")).orderBy("votes", "shape").collect()
    if not rows:
        return Model(0.5, {}, None)
    v = np.array([r["votes"] for r in rows])
    n = np.array([r["n"] for r in rows], float)
    # Two-class Dawid-Skene over answers -1, 0, 1, started from the majority of the votes.
    belief = 1 / (1 + np.exp(-1.5 * v.sum(axis=1)))
    for _ in range(rounds):
        prior = float(np.clip((n * belief).sum() / n.sum(), 0.02, 0.98))
        yes = np.array([[((v[:, j] == a) * n * belief).sum() + (2 if a == 1 else 1) for a in (-1, 0, 1)] for j in range(v.shape[1])])
        no = np.array([[((v[:, j] == a) * n * (1 - belief)).sum() + (2 if a == -1 else 1) for a in (-1, 0, 1)] for j in range(v.shape[1])])
        yes, no = yes / yes.sum(axis=1, keepdims=True), no / no.sum(axis=1, keepdims=True)
        odds = np.log(prior / (1 - prior)) + sum(np.log(yes[j, v[:, j] + 1] / no[j, v[:, j] + 1]) for j in range(v.shape[1]))
        belief = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    x = _features([tuple(r["shape"]) for r in rows], [tuple(r["votes"]) for r in rows])
    w = np.zeros(x.shape[1])
    weight = n / n.sum() * min(n.sum(), 10_000)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 0.1 * np.eye(x.shape[1]), x.T @ (weight * (belief - p)) - 0.1 * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return Model(prior, {name: (float(yes[j, 2]), float(no[j, 0])) for j, name in enumerate(LABELERS)}, w)


def _find(model: Model, threshold: float):
    order = {k: i for i, k in enumerate((*KINDS, *ADDED_KINDS))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found = base_spans(text) if text else {}
                spans = [(k, a, b, True, 1.0) for k in KINDS for a, b in found.get(k, ())]
                proposed = list(candidates(text, _taken(found))) if text else []
                chance = model.probability([c[4] for c in proposed], [c[3] for c in proposed])
                free = -1
                for (k, a, b, *_), p in sorted(zip(proposed, chance.tolist()), key=lambda x: (x[0][1], -x[0][2])):
                    if p >= threshold and a >= free:
                        spans.append((k, a, b, False, p))
                        free = b
                spans.sort(key=lambda s: (order[s[0]], s[1]))
                out.append([dict(zip(("kind", "start", "end", "base", "score"), s)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])
    return run


def find_spans(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``doc_id, spans`` for each row; a span is ``kind, start, end, base, score`` in code points, by kind and start.

    Base spans always stay; added spans never overlap them or each other. Null and empty texts have no spans. Whole
    texts are read. Null and repeated ids pass through; an empty table gives an empty table, and a corpus without
    candidates a model that adds nothing.
    """
    return picked(docs, doc_id="long", text="string").mapInArrow(_find(model, threshold), "doc_id long, spans array<struct<kind: string, start: int, end: int, base: boolean, score: double>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's spans."""
    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
