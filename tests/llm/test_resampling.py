import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from scoreloom.llm import queries as Q
from scoreloom.llm import resampling as R

DOCS = "doc_id long, text string"


def features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [crc32(" ".join(words[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, buckets, percent, least_words, seed):
    of = [(i, *features(t)) for i, t in docs]
    raw = Counter(c % buckets for _, _, f in of for c in f)
    wanted = Counter(c % buckets for t in target for c in features(t)[1])
    S, T = sum(raw.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (S + buckets) / ((raw[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, words, f in of:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c % buckets] for c in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least_words))
    enough = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(enough[: percent * len(enough) // 100])}
    return [(*r[:4], rank.get(r[0]) if r[4] else None) for r in rows]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aB9é \n", max_size=60), st.text("x", min_size=50, max_size=150)), max_size=6), st.sampled_from([1, 2, 1 << 18]))
def test_runs_of_any_texts(texts, portion):
    old, R.PORTION = R.PORTION, portion
    try:
        got = [[] for _ in texts]
        for docs, sums, _ in R.runs([t.encode() for t in texts]) if texts else ():
            for d, c in zip(docs.tolist(), sums.tolist()):
                got[d].append(c)
    finally:
        R.PORTION = old
    assert [sorted(g) for g in got] == [sorted(features(t)[1]) for t in texts]


def test_checksums_shift():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (rng.randbytes(rng.randrange(65)) for _ in range(2))
        assert int(R.shifted(np.array([crc32(a)], np.uint32), np.array([len(b)]))[0]) ^ crc32(b) == crc32(a + b)


def test_as_brute_force_with_cases(spark, rows_of):
    rng = random.Random(2)
    words = ["Alpha", "beta", "γάμμα", "delta9", "e" * 70]
    docs = [(k, " ".join(rng.choices(words, k=rng.randrange(60)))) for k in range(300)] + [(300, None), (301, ""), (302, "\x00,;"), (None, "beta " * 30), (303, "alpha beta\n" * 40_000)]
    target = ["Alpha beta Alpha", None, "delta9 beta"]
    df = rows_of([(*d, "clash", 7) for d in docs], DOCS + ", rank string, weight int")
    got = R.resample(df, rows_of([(t,) for t in target], "text string"), 97, 30, 20, 42)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(docs, target, 97, 30, 20, 42), key=str)


def test_repeated_rows_share_no_rank(rows_of):
    docs = [(1, "a b " * 10)] * 400 + [(k, "c d " * 10) for k in range(2, 602)]
    got = R.resample(rows_of(docs, DOCS, 7), rows_of([("a",)], "text string"), 50, 60, 20, 42).collect()
    assert len(got) == 1000
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 601))
    assert len({(r["doc_id"], r["score"]) for r in got}) == 601


def test_empty_tables(rows_of):
    none, one = rows_of([], DOCS), rows_of([(1, "a " * 30)], DOCS)
    assert R.resample(none, one, 10, 50, 20, 42).collect() == []
    assert [tuple(r)[:2] for r in R.resample(one, none, 10, 50, 20, 42).collect()] == [(1, 87)]


def test_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert sorted(map(tuple, Q.op13_resampling(spark, small).collect()), key=str) == sorted(brute(docs, target, **Q.RESAMPLE), key=str)
