import hashlib
import re
from collections import Counter, defaultdict

from millspark.llm import lines, neardup, substring



def rows_of(df):
    """doc_id and text by position: the table also has a column TEXT."""
    return [(r[0], r[1]) for r in df.collect()]


def passages_by_hand(rows, window=13):
    key = lambda d: -1 << 63 if d is None else d
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            least[k] = min(least.get(k, key(d)), key(d))
    out = []
    for d, w in words:
        gone = {j for i in range(len(w) - window + 1) if least[tuple(w[i:i + window])] < key(d) for j in range(i, i + window)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return Counter(out)


def test_passages_match_brute_force(awkward):
    want = passages_by_hand(rows_of(awkward))
    for bits in (4, 20):  # a full sketch filters nothing, the result stays
        got = substring.digest(substring.remove_repeated_passages(awkward, cell_bits=bits)).collect()
        assert Counter(map(tuple, got)) == want


def test_passages_of_nothing(nothing):
    assert substring.remove_repeated_passages(nothing, cell_bits=10).count() == 0


def lines_by_hand(rows):
    key = lambda d: -1 << 63 if d is None else d
    fold = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[fold(line)].add(key(d))
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(fold(x)) < 10 or min(holders[fold(x)]) == key(d)]
        out.append((d, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_lines_match_brute_force(awkward):
    want = lines_by_hand(rows_of(awkward))
    for batches, fanout in ((1, 2), (5, 2)):
        got = lines.digest(lines.remove_repeated_lines(awkward, batches=batches, fanout=fanout)).collect()
        assert Counter(map(tuple, got)) == want


def test_runs_are_compacted_by_level(spark, tmp_path):
    runs = lines.LineRuns(spark, str(tmp_path), fanout=2)
    shared = []
    for i in range(4):
        batch = spark.createDataFrame([(bytes([k]), i) for k in (i, 99)], "key binary, doc_id long")
        shared += [tuple(r) for r in runs.ingest(batch).collect()]
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert runs.rows().count() == 5
    assert shared == [(bytes([99]), 0)] * 3


def test_lines_of_nothing(nothing):
    assert lines.remove_repeated_lines(nothing).count() == 0


def test_near_duplicates_match_brute_force(awkward):
    rows = rows_of(awkward)
    bags = [Counter(zip(*[(t or "").lower().split()[k:] for k in range(5)])) or Counter([tuple((t or "").lower().split())] if (t or "").split() else []) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            both = set(a) & set(b)
            s = sum(1 / sum(max(a[k] / a[x], b[k] / b[x]) for k in set(a) | set(b)) for x in both) if len(both) < 100 else len(both) / len(set(a) | set(b))
            same_id = rows[i][0] == rows[j][0]
            if rows[i][0] is not None and rows[j][0] is not None and (s >= 0.8 or same_id):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    want = Counter((d, min(x for x in members if x is not None) if d is not None else None) for members in groups.values() for d in members)
    got = neardup.near_duplicates(awkward).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == want


def test_near_duplicates_of_nothing(nothing):
    assert neardup.near_duplicates(nothing).count() == 0


def test_loose_group_is_one_class(spark):
    """Copies near to one middle text but not to each other are joined through it."""
    base = [f"b{i}" for i in range(400)]
    rows = [(1000, " ".join(base))]
    for i in range(40):
        words = base[:]
        for k in range(5):
            words[(i * 9 + k * 75) % 400] = f"edit{i}x{k}"
        rows.append((i, " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def test_check_before_verification_loses_less_than_banding():
    from math import ceil, comb
    least, registers = 0.8, 96
    needed = ceil((least - neardup.SLACK) * registers)
    assert sum(comb(registers, k) * least**k * (1 - least)**(registers - k) for k in range(needed)) < 3e-7
