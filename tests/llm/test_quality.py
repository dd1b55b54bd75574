import random

from scoreloom.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def corpus(seed, n):
    rng = random.Random(seed)
    syllables = ["an", "ter", "lo", "mi", "cha", "re", "sto", "un", "pel", "vi"]
    rows, marks = [], []
    for k in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 300))]
        good = rng.random() < 0.7
        text = " ".join(words) + "." if good else "".join(w.upper() + rng.choice(["!!! ", "*** ", "$$$ "]) for w in words)
        rows.append((k, text))
        marks.append((k, int(good), 0))
    return rows, marks


def test_held_out_accuracy(rows_of):
    rows, marks = corpus(1, 600)
    docs = rows_of(rows, "doc_id long, text string")
    model = quality.fit(docs, rows_of([m for m in marks if m[0] % 3], LABELS))
    score = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [m for m in marks if m[0] % 3 == 0]
    assert sum((score[k] >= 0.5) == bool(good) for k, good, _ in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for s in score.values())


def test_long_texts_and_repeated_rows_leave_a_sample(rows_of, monkeypatch):
    """Texts over the byte budget don't push out the others; of repeated rows one is collected."""
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 60 * quality.CHUNK)
    rows, marks = corpus(3, 40)
    rows = [(k, text * (1 if k % 2 else 400)) for k, text in rows] + [(1, rows[1][1])] * 200
    docs = rows_of(rows, "doc_id long, text string")
    model = quality.fit(docs, rows_of(marks, LABELS))
    assert model.weights is not None
    score = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert sum((score[k] >= 0.5) == bool(good) for k, good, _ in marks) / len(marks) > 0.9


def test_chunks_within_the_budget(monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 10 * quality.CHUNK)
    c = quality.CHUNK
    assert [quality.chunks_each(x) for x in ([], [1, 2], [9 * c, 1], [c, 20 * c, 30 * c], [c] * 50)] == [1, 1, 9, 4, 1]


def test_odd_rows(rows_of):
    rows, marks = corpus(2, 120)
    rows += [(900, None), (901, ""), (902, rows[0][1]), (902, rows[0][1]), (None, "text"), (903, "word " * 200000)]
    docs = rows_of([(*r, "x", 1) for r in rows], "doc_id long, text string, score string, quality int")
    marks += [(0, 1, 1), (1, None, 0), (None, 0, 0), (2, 7, 0), (5000, 1, 0)]
    model = quality.fit(docs, rows_of(marks, LABELS))
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[900] == by[901] == model.share
    assert by[902] == by[0]
    assert got[0].asDict().keys() == {"doc_id", "text", "score", "quality"}


def test_without_both_labels(rows_of):
    docs = rows_of([(1, "a text"), (2, None)], "doc_id long, text string")
    for marks, share in (([], 0.5), ([(1, 1, 0)], 1.0), ([(1, 0, 0)], 0.0)):
        got = quality.score(docs, quality.fit(docs, rows_of(marks, LABELS))).collect()
        assert [r["score"] for r in got] == [share, share]
    none = rows_of([], "doc_id long, text string")
    assert quality.score(none, quality.fit(none, rows_of([], LABELS))).collect() == []
