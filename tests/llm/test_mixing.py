import collections

import duckdb
import numpy as np
import pytest
from scoreloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, topic string, probability string"
PLAN = {"languages": ["en", "de"], "topics": {"table": " | "}, "temper": 0.5, "seed": 3}


def corpus():
    rng = np.random.default_rng(1)
    rows = []
    for k in range(600):
        source = "hot" if rng.random() < 0.4 else f"s{rng.integers(5)}"
        lang = str(rng.choice(["en", "de", "xx"], p=[0.7, 0.2, 0.1]))
        words = " | " if rng.random() < 0.2 else " "
        rows.append((k, words.join(["w"] * int(rng.integers(1, 40))), lang, source, 0, "x", "y"))
    return rows


def tokens(text):
    return len([w for w in (text or "").split(" ") if w])


def test_expected_sums_meet_the_targets(rows_of):
    rows = corpus()
    got = {r["doc_id"]: r for r in mixing.rake(rows_of(rows, SCHEMA), **PLAN).collect()}
    assert len(got) == len(rows)
    assert max(r["probability"] for r in got.values()) == pytest.approx(1)
    for value in (lambda r: r[3], lambda r: r[2] if r[2] in ("en", "de") else "other", lambda r: "table" if " | " in r[1] else "other"):
        all_, drawn = collections.Counter(), collections.Counter()
        for r in rows:
            assert got[r[0]]["tokens"] == tokens(r[1])
            all_[value(r)] += tokens(r[1])
            drawn[value(r)] += tokens(r[1]) * got[r[0]]["probability"]
        goal = {k: (v / sum(all_.values())) ** 0.5 for k, v in all_.items()}
        for k in goal:
            assert drawn[k] / sum(drawn.values()) == pytest.approx(goal[k] / sum(goal.values()), rel=1e-6)
    sampled = sum(r["sampled"] for r in got.values())
    expected = sum(r["probability"] for r in got.values())
    assert abs(sampled - expected) < 4 * expected**0.5


def test_as_sql(rows_of):
    rows = [*corpus(), (1000, None, "en", None, 0, "", ""), (1001, "", "zz", "hot", 0, "", ""), (None, "a b", None, "", 0, "", ""), (5, "twice", "en", "hot", 0, "", "")]
    got = mixing.rake(rows_of(rows, SCHEMA), **PLAN).select("doc_id", "topic", "tokens", "probability", "sampled").collect()
    with duckdb.connect() as db:
        db.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
        db.executemany("insert into documents values (?, ?, ?, ?)", [r[:4] for r in rows])
        expected = db.execute(mixing.statement(**PLAN)).fetchall()
    plain = lambda rs: sorted(((str(a), b, c, round(d, 6), e) for a, b, c, d, e in rs), key=str)
    assert plain(got) == plain(expected)


def test_nothing_to_rake(rows_of):
    assert mixing.rake(rows_of([], SCHEMA), **PLAN).collect() == []
    got = mixing.rake(rows_of([(1, None, None, None, 0, "", "")], SCHEMA), **PLAN).collect()
    assert [(r["tokens"], r["probability"], r["sampled"]) for r in got] == [(0, 1.0, True)]
