import math

import numpy as np
import pytest
from scoreloom.llm import exact_top, learned_search

NAN, INF = float("nan"), float("inf")


def best(data, asked, k):
    """[(query, rank, id, score)] by comparing all pairs."""
    out = []
    for q, x in asked:
        found = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in data if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def clustered(seed, n, width=8, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-400, 400, (6, width))
    data = [(k, (centres[rng.integers(6)] + rng.integers(-9, 9, width)).tolist()) for k in range(n)]
    return data + [(n + k, data[0][1]) for k in range(copies)]


@pytest.mark.parametrize(("queries", "rows"), [(256, 1 << 14), (4, 32)])
def test_exact_as_all_pairs(rows_of, monkeypatch, queries, rows):
    monkeypatch.setattr(exact_top, "QUERIES", queries)  # several groups, splits and parts
    monkeypatch.setattr(exact_top, "ROWS", rows)
    data = clustered(1, 300, copies=150)
    asked = [r for r in data if r[0] % 9 == 0]
    got = exact_top.search(rows_of(data, "id long, vector array<long>"), rows_of(asked, "id long, vector array<long>"), 5).collect()
    assert sorted(map(tuple, got)) == best(data, asked, 5)


@pytest.mark.parametrize("search", [exact_top.search, learned_search.search])
def test_copies_of_the_query_row(rows_of, search):
    """Rows of the query's own id don't take the places of other ids with the same vector."""
    kind = "long" if search is exact_top.search else "double"
    data = [(50, [9, 9])] * 30 + [(i, [9, 9]) for i in range(51, 61)] + [(i, [i, -1]) for i in range(8)]
    data += [(50, [9, 10 + i]) for i in range(12)]  # other vectors of that id
    data = [(i, [float(x) if kind == "double" else x for x in v]) for i, v in data]
    rows = rows_of(data, f"id long, vector array<{kind}>")
    asked = [(50, data[0][1])]
    got = search(rows, rows_of(asked, f"id long, vector array<{kind}>"), 5).collect()
    assert sorted(map(tuple, got)) == best(data, asked, 5)


def test_exact_odd_rows(rows_of):
    schema = "id long, vector array<long>, query string, score string"
    data = [(0, [1, 2]), (1, [1, 2]), (2, None), (3, [1, None]), (4, []), (None, [9, 9]), (5, [3]), (6, [0, 0])]
    df = rows_of([(*r, "x", "y") for r in data], schema)
    fit = [r for r in data if r[0] is not None and r[1] and None not in r[1]]
    assert sorted(map(tuple, exact_top.search(df, df, 5).collect())) == best(fit, fit, 5)
    none = rows_of([], schema)
    assert exact_top.search(none, none, 5).collect() == []
    assert exact_top.search(df, none, 5).collect() == []


def test_learned_recall_and_scores(rows_of, monkeypatch):
    monkeypatch.setattr(learned_search, "SHARE", 150)
    monkeypatch.setattr(learned_search, "ROWS", 200)  # a partition in several parts
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2500, 16))
    x[1500:1900] = x[3]  # a large group of copies
    data = [(k, v.tolist()) for k, v in enumerate(x)]
    asked = data[::20]
    df = rows_of(data, "id long, vector array<double>")
    got = learned_search.search(df, df.where("id % 20 = 0"), 20).collect()
    true = {(q, i) for q, _, i, _ in best(data, asked, 20)}
    found = {(r["query"], r["id"]) for r in got}
    assert len(got) == 20 * len(asked) == len(found)
    assert len(true & found) / len(true) >= 0.9
    for r in got[::97]:
        total = 0.0
        for a, b in zip(x[r["query"]], x[r["id"]], strict=True):
            total += a * b
        assert r["score"] == total
    of = sorted((r["query"], r["rank"], r["score"], r["id"]) for r in got)
    for (q, _, s, i), (p, _, t, j) in zip(of, of[1:], strict=False):
        assert q != p or s > t or (s == t and i < j)


def test_learned_odd_rows(rows_of):
    schema = "id long, vector array<double>, partition string"
    data = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [NAN, 1.0]), (5, [INF, 1.0]), (6, [0.0, 0.0]), (None, [1.0, 1.0]), (7, [3.0])]
    df = rows_of([(*r, "x") for r in data], schema)
    fit = [r for r in data if r[0] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])]
    assert sorted(map(tuple, learned_search.search(df, df, 20).collect())) == best(fit, fit, 20)
    none = rows_of([], schema)
    assert learned_search.search(none, none, 20).collect() == []


def test_partitions_are_balanced():
    x = np.random.default_rng(4).normal(size=(900, 12))
    x[:500] = x[0] + x[:500] * 1e-3  # over half in one dense place
    label = learned_search.balanced_partition(x, learned_search._graph(x), 8)
    assert np.bincount(label, minlength=8).max() <= math.ceil(1.05 * 900 / 8)
