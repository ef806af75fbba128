import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millspark.llm import alignment, contentsort, infill

SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()
ODD = ["ünïcode — 漢字 🙂 tail", "a<P>b", "<S", "\x00 nul\tand  spaces ", "▁under <0x41> <s> <|endoftext|>", "x", "é" * 700 + "z" * 700, "\n\n  \r\n"]


@pytest.fixture(scope="module")
def texts(spark, awkward):
    more = spark.createDataFrame([(100 + i, t, "en", "a", "noise", len(t)) for i, t in enumerate(ODD)], awkward.schema)
    return awkward.union(more)


def rows_of(df):
    """doc_id and text by position: the table also has a column TEXT."""
    return [(r[0], r[1]) for r in df.collect()]


def filled_by_hand(doc_id, text):
    text = text or ""
    digest = SHA(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, SHA(text), SHA(text)
    low, high = sorted(x % (n + 1) for x in h[:2])
    p, m, s = text[:low], text[low:high], text[high:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, n, form, low, high - low, SHA(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), SHA(text)


def test_fill_in_middle_matches_brute_force(texts):
    want = Counter(filled_by_hand(*r) for r in rows_of(texts))
    for epsilon in (0, 3, 100):
        assert Counter(map(tuple, infill.digest(infill.fill_in_middle(texts, epsilon=epsilon)).collect())) == want


def test_fill_in_middle_of_nothing(nothing):
    assert infill.fill_in_middle(nothing).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300), st.integers(0, 5), st.integers(1, 50))
def test_rank_index_is_exact_and_bounded(text, epsilon, block):
    data = np.frombuffer(text.encode(), np.uint8)
    index = infill.boundaries(data, epsilon, block)
    want = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
    ranks = np.arange(len(want))
    assert (index.offsets(ranks) == want).all()
    assert np.abs(index.predict(ranks) - want).max() <= epsilon


def test_one_segment_indexes_plain_text():
    index = infill.boundaries(np.full(5_000, ord("a"), np.uint8))
    assert len(index.start) == 2 and not index.residuals.any()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40), st.integers(1, 9))
def test_pieces_emit_the_overlaps_of_the_whole(a, b, work):
    a, b = np.cumsum(a), np.cumsum(b)
    a, b = (np.append(x[x < max(a[-1], b[-1])], max(a[-1], b[-1])) for x in (a, b))
    span = lambda ends, i: (ends[i - 1] if i else 0, ends[i])
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if max(span(a, i)[0], span(b, j)[0]) < min(span(a, i)[1], span(b, j)[1])}
    link_a, link_b, shared = alignment.overlaps(a, b, work)
    assert sorted(zip(link_a, link_b)) == sorted(want)
    assert list(shared) == sorted(set(a) & set(b))
    at_a, at_b = alignment.diagonal_cuts(a, b, work)
    assert (np.diff(at_a + at_b) <= work + 1).all()


def aligned_by_hand(rows):
    """Contract columns per row, from the tokenizers alone."""
    a = alignment.ByteLevel(f"{alignment.TOKENIZERS}/{alignment.VOCABULARY_A}")
    b = alignment.Pieces(f"{alignment.TOKENIZERS}/{alignment.VOCABULARY_B}")
    found = []
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode([text])[0].tolist(), b.encode([text])[0].tolist()) if text else ([], [])
        want = b" " + (text or "").encode()
        if any(b"".join(t.bytes_of[i] for i in ids) != want for t, ids in ((a, ids_a), (b, ids_b))):
            ids_a = ids_b = []
        spans = []
        for tokenizer, ids in ((a, ids_a), (b, ids_b)):
            at = 0
            spans.append([])
            for i in ids:
                spans[-1].append((i, at, at + len(tokenizer.bytes_of[i])))
                at = spans[-1][-1][2]
        links, first = [], 0
        for i, s, e in spans[0]:
            while first < len(spans[1]) and spans[1][first][2] <= s:
                first += 1
            j = first
            while j < len(spans[1]) and spans[1][j][1] < e:
                links.append((i, spans[1][j][0]))
                j += 1
        groups, borders = [], sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        for low, high in zip([0, *borders], borders):
            groups.append("|".join(",".join(str(i) for i, s, e in side if low < e <= high) for side in spans))
        found.append((doc_id, ids_a, ids_b, groups, links))
    counts = Counter(p for *_, links in found for p in set(links))
    highest = defaultdict(int)
    for (i, _), n in counts.items():
        highest[i] = max(highest[i], n)
    return Counter((d, len(x), len(y), len(g), len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links), SHA(";".join(g)) if x else "")
                   for d, x, y, g, links in found)


def test_alignment_matches_brute_force(texts):
    # The long text is cut short: grouping it by hand compares every token with every border.
    short = texts.filter(F.col("doc_id").isNull() | (F.col("doc_id") != 6))
    want = aligned_by_hand(rows_of(short))
    for work, frequent in ((11, 3), (1 << 16, 0), (1 << 16, 10**6)):
        aligned = alignment.align(short, work=work)
        got = alignment.digest(aligned, alignment.link_statistics(aligned, alignment.pair_counts(aligned), frequent)).collect()
        assert Counter(map(tuple, got)) == want


def test_long_text_is_aligned_alike_in_pieces(texts):
    long = texts.filter("doc_id = 6")
    results = [alignment.align(long, work=work).drop("row").collect() for work in (1000, 1 << 30)]
    assert results[0] == results[1] and results[0][0]["n_links"] > 60_000


def test_alignment_of_nothing(nothing):
    aligned = alignment.align(nothing)
    assert alignment.digest(aligned, alignment.link_statistics(aligned, alignment.pair_counts(aligned))).count() == 0


def test_byte_level_ids_are_those_of_the_file():
    """Every kind of character, alone, inside and between words, and long runs, against the file's own library."""
    from tokenizers import Tokenizer
    a = alignment.ByteLevel(f"{alignment.TOKENIZERS}/{alignment.VOCABULARY_A}")
    own = Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.VOCABULARY_A}")
    own.encode_special_tokens = True
    points = [*range(0x3400), *range(0x3400, 0xD800, 61), *range(0xE000, 0x110000, 211)]
    texts = [f"x{chr(c)}1 {chr(c)}{chr(c)}y  {chr(c)} z" for c in points] + ODD + ["a" * 5_000 + " " * 5_000 + "b", "it's we'LL 'S"]
    want = own.encode_batch([" " + t for t in texts], add_special_tokens=False)
    assert all(list(x) == y.ids for x, y in zip(a.encode(texts), want))


def test_every_token_has_its_bytes():
    a = alignment.ByteLevel(f"{alignment.TOKENIZERS}/{alignment.VOCABULARY_A}")
    with open(f"{alignment.TOKENIZERS}/{alignment.VOCABULARY_A}", encoding="utf-8") as file:
        size = len(json.load(file)["model"]["vocab"])
    assert len(a.bytes_of) == size and all(a.bytes_of) and {bytes([i]) for i in range(256)} <= set(a.bytes_of)


def groups_by_hand(rows, keep):
    key = lambda d: -1 << 63 if d is None else d
    members = defaultdict(list)
    for d, t in rows:
        members[t or ""].append(d)
    out = Counter()
    for t, ids in members.items():
        best = (max if keep == "largest" else min)(ids, key=key)
        for i, d in enumerate(ids):
            out[d, best, len(ids), i == ids.index(best), SHA(t)] += 1
    return out


@pytest.mark.parametrize("keep", ("largest", "smallest"))
def test_content_groups_match_brute_force(texts, keep):
    want = groups_by_hand(rows_of(texts), keep)
    for slice_bytes, range_bytes in ((1 << 20, 1 << 20), (40, 500)):  # the second cuts every group of copies into slices
        got = contentsort.content_groups(texts, keep, slice_bytes=slice_bytes, range_bytes=range_bytes).collect()
        assert Counter(map(tuple, got)) == want


def test_content_of_nothing_and_of_one_hot_text(spark, nothing):
    assert contentsort.content_groups(nothing).count() == 0
    hot = spark.range(3_000).select((F.col("id") % 2_000).alias("doc_id"), F.lit("the same text").alias("text"))
    got = contentsort.content_groups(hot, "largest", slice_bytes=1_000).collect()
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(1_999, 3_000)} and [r["doc_id"] for r in got if r["kept"]] == [1_999]


def test_contents_are_compared_after_normalising(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "ab"), (None, "A B")], "doc_id long, text string")
    got = contentsort.content_groups(docs, normalise=F.lower).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == {(1, None, 3, False), (2, None, 3, False), (None, None, 3, True), (3, 3, 1, True)}
