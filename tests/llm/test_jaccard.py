import random
import re
import time

import numpy as np
import pytest
from scoreloom.llm import jaccard
from scoreloom.llm.components import components

SCHEMA = "doc_id long, text string, node string, tokens string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sets_of(rows, width):
    out = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out.append(frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset())
    return out


def brute(rows, width, num, den):
    """(id, size, component) of every row, comparing all pairs."""
    sets = sets_of(rows, width)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (i, _), a in zip(rows, sets, strict=True):
        for (j, _), b in zip(rows, sets, strict=True):
            if i is not None and j is not None and i < j and a and b and den * len(a & b) >= num * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return sorted([(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)], key=str)


def run(rows_of, rows, width, num, den):
    df = rows_of([(i, t, "x", "y") for i, t in rows], SCHEMA)
    return sorted([tuple(r) for r in jaccard.linked(df, width, num, den).collect()], key=str)


def corpus(seed, groups=12):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [f"p{k}" for k in range(55)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 60, 150]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 8, 40])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 3 + 7, " ".join(copy)))
    return rows


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (1, 60)])
def test_as_all_pairs(rows_of, monkeypatch, width, num):
    rows = corpus(width)
    monkeypatch.setattr(jaccard, "SMALL", 6)  # small enough for stars and what they leave open
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    assert run(rows_of, rows, width, num, 100) == brute(rows, width, num, 100)


def test_pair_with_rare_and_frequent_tokens(rows_of, monkeypatch):
    """97 of 103 tokens shared, three of them rare but in many rows: what both share in pairs of frequent tokens isn't counted."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    frequent, others, rare = ([f"{c}{k}" for k in range(n)] for c, n in (("f", 94), ("g", 94), ("r", 3)))
    own = lambda i, n: [f"o{i}_{k}" for k in range(n)]
    rows = [(i, " ".join([*frequent, *rare, *own(i, 3)])) for i in (1, 2)]
    rows += [(i, " ".join([*others, *rare, *own(i, 1)])) for i in range(10, 18)]  # fewer rare tokens: the centres of the stars
    rows += [(i, " ".join([*words, *own(i, 6)])) for i, words in enumerate([*[frequent] * 20, *[others] * 20], 100)]
    got = run(rows_of, rows, 1, 90, 100)
    assert got == brute(rows, 1, 90, 100)
    assert (2, 100, 1) in got


def test_odd_rows(rows_of):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "ONE  two"), (10, "one"), (None, "one two"), (11, "a b c d"), (11, "x y z w"), (12, "x y z w"), (12, "x y z w"), (3, "a b c d"), (2, "é è " * 9000)]
    assert run(rows_of, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_empty_table(rows_of):
    assert run(rows_of, [], 3, 90, 100) == []


def test_threshold_is_checked(rows_of):
    with pytest.raises(ValueError, match="threshold"):
        jaccard.linked(rows_of([], SCHEMA), 3, 50, 100)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for _ in range(400):
        base = rng.choice(3000, rng.integers(2, 120), replace=False)
        other = base.copy()
        gone = rng.integers(0, max(1, len(base) // 9) + 1)
        other[rng.choice(len(base), gone, replace=False)] = 5000 + np.arange(gone)
        common = np.sort(rng.choice(3000, rng.integers(0, 3000), replace=False)).astype(np.uint64)
        made = []
        for x in (base, other):
            x = np.sort(x.astype(np.uint64))
            made.append({int(s) for part in jaccard._signatures(x, np.isin(x, common), 80, 100)[0] for s in part})
        both = len(np.intersect1d(base, other))
        if 100 * both >= 80 * (len(base) + len(other) - both) and both < len(base):
            assert made[0] & made[1]


def test_sketches_differ_by_no_more_than_their_sets():
    rng = np.random.default_rng(3)
    for most in (40, 400, 4000):
        a, b = (np.unique(rng.integers(0, 1 << 63, most).astype(np.uint64)) for _ in range(2))
        for kept in (0, len(b) // 2, len(b) - 3):
            other = np.union1d(a[:kept], b[kept:])
            bits = np.unpackbits((jaccard._sketch(a) ^ jaccard._sketch(other)).view(np.uint8)).sum()
            assert bits <= len(np.setxor1d(a, other))
    assert not (jaccard._sketch(a) ^ jaccard._sketch(a.copy())).any()


def test_large_group_of_texts_that_are_nearly_similar(rows_of, monkeypatch):
    """They share most signatures and lie in components of their own; few of their pairs may go on to be compared."""
    monkeypatch.setattr(jaccard, "SMALL", 6)
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    compared, compare = [], jaccard.compare
    monkeypatch.setattr(jaccard, "compare", lambda pairs, *rest: compared.append(pairs.count()) or compare(pairs, *rest))
    rng = random.Random(9)
    rows = [(k, " ".join(rng.sample([f"w{j}" for j in range(165)], 140))) for k in range(80)]
    rows += [(100 + k, rows[k][1].rsplit(" ", 3)[0]) for k in range(0, 80, 8)]
    got = run(rows_of, rows, 1, 80, 100)
    assert got == brute(rows, 1, 80, 100)
    assert len({component for _, _, component in got}) > 40
    assert sum(compared[1:]) < 600


def test_components_of_long_paths(rows_of):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, 90), (90, 95), (7, 7)] + [(200, k) for k in range(201, 260)]
    random.Random(1).shuffle(links)
    got = dict(components(rows_of(links, "a long, b long")).collect())
    expected = {k: 1 for k in range(2, 61)} | {95: 90, 100: 90} | {k: 200 for k in range(201, 260)}
    assert {k: v for k, v in got.items() if k != v} == expected


def test_shuffle_files_go_with_the_table_that_they_were_for(spark, rows_of):
    """Otherwise those of all steps add up until the driver collects its garbage."""
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    held = lambda: set(re.findall(r"shuffle_\d+_\d+", disk.getAllFiles().mkString(" ")))
    before = held()
    jaccard.written(rows_of([(k, k % 7) for k in range(500)], "a long, b long").groupBy("b").count(), "counted").collect()
    for _ in range(40):
        if not held() - before:
            break
        time.sleep(0.25)
    assert not held() - before
