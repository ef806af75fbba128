import re

from pyspark.sql import functions as F

from millspark.llm import language, pii, toxicity


def texts(n, words, seed):
    import random
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(30)) for _ in range(n)]


EN = "the house and of with there water morning every other people garden".split()
DE = "der das und mit für haus wasser morgen straße zwischen garten menschen".split()
FR = "le la et avec pour maison eau matin être entre jardin personnes".split()


def test_languages_held_out(spark):
    rows = [(i, t, lang) for k, (lang, words) in enumerate((("en", EN), ("de", DE), ("fr", FR))) for i, t in enumerate(texts(30, words, k), 100 * k)]
    rows += [(900, None, "en"), (901, "", None), (902, "123 !!", "de"), (None, "the water and the house", None)]
    got = language.identified_held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by_id[i]["lang_pred"] == lang for i, _, lang in rows[:90])
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (900, 901, 902))
    assert by_id[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 12):
        codes = language.code_table(n)
        assert len({tuple(c) for c in codes}) == n
        assert n < 3 or min((a != b).sum() for i, a in enumerate(codes) for b in codes[:i]) >= 2


def test_no_language_known(spark, nothing):
    assert language.identified_held_out(nothing).count() == 0
    model = language.fit(nothing)
    row = language.identify(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), model).first()
    assert row["lang_pred"] == "und"


def test_insults_also_gapped(spark):
    clean = texts(400, EN + DE, 1)
    insults = ["blorgface", "snivelwit"]
    rows, labels = [], []
    for i, t in enumerate(clean):
        bad = i % 3 == 0
        words = t.split()
        if bad:
            words[i % 25] = insults[i % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.scored_held_out(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert sum(r["held_out"] for r in got) > 40
    assert all(r["predicted"] == labels[r["doc_id"]][1] for r in got)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    odd = spark.createDataFrame([(1, "you b.l.o.r.g.f.a.c.e there"), (2, "you blorgxface there"), (3, "s n i v e l w i t"), (4, None), (5, ""), (6, "the garden there"), (None, "garden " * 30_000)], "doc_id long, text string")
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(odd, model).collect()}
    assert scores == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, None: 0}


def test_insults_in_phrases_and_copies_at_the_full_draw(spark):
    """A fixed phrase, an insult in ten texts and one in copies of a single text, among 6,000 toxic rows."""
    syllables = "ba ce di fo gu ha ki lo mu ne pa ri so tu ve".split()
    clean = texts(12_000, [a + b + c for a in syllables for b in syllables[:8] for c in syllables[:6]], 5)
    rows, labels = [], []
    for i, t in enumerate(clean):
        if i % 2:
            t = f"you {'qwybjerk' if i % 1200 == 1 else 'zyxwort'} {t}" if i < 9_000 else f"you snivelgrub {clean[0]}"
        rows.append((i, t if i % 2 else f"you {t}"))
        labels.append((i, i % 2))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    assert model is not None
    new = spark.createDataFrame([(1, "you bacedi zyxwort"), (2, "bacedi qwybjerk you"), (3, "a snivelgrub bacedi"), (4, "you bacedi"), *[(10 + i, t) for i, t in enumerate(clean[:200:2])]], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(new, model).collect()}
    assert {i: got[i] for i in (1, 2, 3, 4)} == {1: 1, 2: 1, 3: 1, 4: 0}
    assert sum(got[10 + i] for i in range(100)) == 0


def test_toxicity_without_labels(spark, nothing):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int")
    row = toxicity.scored_held_out(docs, labels).first()
    assert (row["score"], row["predicted"]) == (0.0, 0)
    assert toxicity.scored_held_out(nothing, labels).count() == 0


def spans_by_hand(text):
    luhn = lambda d: sum(int(x) for x in d[::-2]) + sum(sum(map(int, str(2 * int(x)))) for x in d[-2::-2])
    n = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(n(m.group())) <= 19 and luhn(n(m.group())) % 10 == 0]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(n(m.group())) <= 15]
    return out


PIECES = ["joe.b@mail.example.com", "a@b", "x@y.z@w.v", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.04", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (452) 555-7764", "+49 30", "++44 20 7946 0958.", "é", "12", ".", "-", "%+a@b.c-", "٣٤"]


def test_base_spans_match_the_patterns():
    import random
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) + rng.choice(["", " ", "-", "."]) for _ in range(rng.randint(1, 7)))
        assert [(k, a, b) for k, spans in pii.base_spans(text).items() for a, b in spans] == spans_by_hand(text), text


def test_candidates_stay_clear_of_every_base_span():
    """A base span that reaches over many later ones still bars candidates inside it."""
    text = "1.1.1.1.1.1.1.1.1.1.1.1.1.1.1.1.1.1.1.1_555-123-4567@x.com or call (452) 555-7764"
    base = [s for spans in pii.base_spans(text).values() for s in spans]
    assert len(base) == 6
    found = [(a, b) for _, a, b, _, _ in pii.candidates(text, base)]
    assert found and all(b <= x or a >= y for a, b in found for x, y in base)


def test_spans_are_added_and_base_ones_stay(spark, nothing):
    rows = [(1, "call (452) 555-7764 now, tel"), (2, "write joe [at] example [dot] com please"), (3, None), (4, ""), (5, "mail a.b@c.de and 10.0.0.1"), (6, "version 10.20.30 of page 12"), (None, "1" * 100_000), (7, "a" * 100_000 + " x@y.zz")]
    rows += [(100 + i, f"tel +1 (555) 555-{1000 + i} or mail p{i}@q.com") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.digest(pii.find_spans(docs, pii.fit(docs)))
    got = {r["doc_id"]: r for r in found.collect()}
    assert "phone:5:19" in got[1]["spans"] and got[1]["n_phone"] == 0
    assert "email:6:" in got[2]["spans"]
    assert got[3]["spans"] == got[4]["spans"] == got[6]["spans"] == got[None]["spans"] == ""
    assert got[5]["spans"] == "email:5:13,ip:18:26"
    assert got[7]["n_email"] == 1
    assert pii.find_spans(nothing, pii.fit(nothing)).count() == 0
