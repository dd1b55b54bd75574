import collections
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from scoreloom.llm import context_mixing

SCHEMA = "doc_id long, text string, lang string, score string, row long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(autouse=True)
def small_tables(monkeypatch):
    monkeypatch.setattr(context_mixing, "BITS", (10, 12, 14))
    monkeypatch.setattr(context_mixing, "CHUNK_BITS", 10)
    monkeypatch.setattr(context_mixing, "FREQUENT", 40)  # fewer than there are words, so that some are joined
    monkeypatch.setattr(context_mixing, "BLOCK", 2000)
    monkeypatch.setattr(context_mixing, "DECISIONS", 700)


def corpus(n):
    rng = random.Random(5)
    words = {lang: ["".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(80)] for lang, s in (("a", ["th", "in", "er"]), ("b", ["ça", "ou", "Le"]))}
    rows = []
    for k in range(n):
        lang = rng.choice("aab")
        rows.append((k, " ".join(rng.choice(words[lang][: rng.randint(1, 80)]) for _ in range(rng.randint(1, 60))), lang))
    return rows


def base(rows, trains):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None], trains(i)) for i, t, _ in rows]
    c = collections.Counter(w for _, words, learn in split if learn for w in words)
    n, v = sum(c.values()), len(c)
    return sorted(((i, learn, len(words), sum(c[w] > 0 for w in words), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), 6)) for i, words, learn in split), key=str)


def scored(rows_of, rows, training):
    df = rows_of([(*r, "x", 0) for r in rows], SCHEMA)
    return context_mixing.score(df, training, group="lang").collect()


def test_base_as_counted_by_hand(rows_of):
    rows = [*corpus(150), (900, None, None), (901, "", "a"), (902, " \n", "b"), (3, "again again", "a"), (3, "again again", "a"), (903, "Zz" * 9000 + " x" * 9000, None), (None, "th in", "a")]
    got = scored(rows_of, rows, F.coalesce(F.col("doc_id") % 4 != 1, F.lit(True)))
    plain = [(r["id"], r["trains"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]
    assert sorted(plain, key=str) == base(rows, lambda i: i is None or i % 4 != 1)
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)


def test_held_out_texts_score_above_the_base(rows_of):
    got = [r for r in scored(rows_of, corpus(400), F.col("doc_id") % 4 != 1) if not r["trains"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_every_decision_is_learned_from(rows_of, monkeypatch):
    """The weights move along all decisions of a text, and the ends of texts are among them."""
    monkeypatch.setattr(context_mixing, "DECISIONS", 50)
    words = context_mixing.Words(pa.table({"text": [t for _, t, _ in corpus(20)]}))
    code = context_mixing.huffman(np.append(words.byte_counts(), [len(words.word), 20]))
    seen, times = [], []
    learned = context_mixing.learned
    monkeypatch.setattr(context_mixing, "learned", lambda portion, uses, *more: (seen.append(portion[0]), times.append(uses), learned(portion, uses, *more)))
    common = np.sort(words.hashes.astype(np.int64))
    words.spell(common, np.zeros((len(common), 0), np.float32))
    tables = [np.zeros(2 << b, np.uint32) for b in context_mixing.BITS]
    mass, followed = np.zeros(context_mixing.GATES), np.zeros(context_mixing.GATES * context_mixing.LEVELS * 2)
    context_mixing.gather(words, code, words.uses.astype(np.uint32), context_mixing._is_listed(words, common), tables, context_mixing._start(), mass, followed)
    portions = list(context_mixing.decisions(words, code))
    assert len(portions) > 4 and len(seen) == len(portions)
    total = sum(words.uses[word].sum() for word, _, _ in portions)
    assert mass.sum() == followed.sum() == total


def test_nothing_to_learn_from(rows_of):
    got = scored(rows_of, [(1, "a b", "a"), (2, None, None)], F.lit(False))
    assert sorted((r["id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
    assert scored(rows_of, [], F.lit(True)) == []


def test_probabilities_of_all_next_symbols_add_up_to_one():
    """After any beginning of a word, over every byte, the mark and (at its start) the end."""
    rng = np.random.default_rng(1)
    code = context_mixing.huffman(rng.integers(0, 50, context_mixing.END + 1))
    tables = [context_mixing._stretched(context_mixing.halves(rng.integers(0, 9, (1 << b, 2)).astype(float)), s) for b, s in zip(context_mixing.BITS, (context_mixing._SEEN, context_mixing._SEEN_FOUR, context_mixing._SEEN), strict=True)]
    weights, refined = rng.normal(size=(context_mixing.GATES, 3)) * 0.3, rng.uniform(0.1, 0.9, context_mixing.GATES * context_mixing.LEVELS)
    words = context_mixing.Words(pa.table({"text": ["th"]}))
    words.spell(np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    for place in range(3):
        total = 0.0
        for symbol in range(context_mixing.END + 1):
            words.symbols[place] = symbol
            whole = context_mixing.Words.contexts(words)
            n = code[0][symbol]
            steps = slice(code[1][symbol], code[1][symbol] + n)
            spread = (code[2][steps] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            slots = [(((c[place] ^ spread) * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - b)).astype(np.int64) for c, b in zip(whole, context_mixing.BITS, strict=True)]
            gate = tables[2][1][slots[2]].astype(np.int64) * 3 + tables[1][1][slots[1]]
            mix = context_mixing._mixed([t[0][s].astype(np.float32) for t, s in zip(tables, slots, strict=True)], weights, gate)
            one = 0.5 * (context_mixing._sigmoid(mix) + refined[gate * context_mixing.LEVELS + context_mixing._level(mix)])
            total += float(np.prod(np.where(code[3][steps] == 1, one, 1 - one)))
        assert total == pytest.approx(1, abs=1e-5)
        words.symbols[place] = b"th"[place] if place < 2 else context_mixing.CLOSE


def test_every_word_and_every_group_counts(rows_of, monkeypatch):
    """More groups than six, more words than FREQUENT: each group has its sums, each word is in all tables."""
    groups, merged = [], []
    word_counts, gathered = context_mixing.word_counts, context_mixing.context_counts
    monkeypatch.setattr(context_mixing, "word_counts", lambda learn, n: (groups.append(n), word_counts(learn, n))[1])
    monkeypatch.setattr(context_mixing, "context_counts", lambda *args: merged.append(gathered(*args)) or merged[-1])
    rows = [(k, text, f"l{k % 9}") for k, text, _ in corpus(180)]
    scored(rows_of, rows, F.lit(True))
    assert groups == [9]
    tables = merged[0][0]
    counts = [sum(float(half.astype(np.float64).sum()) for half in table) for table in tables]
    assert counts[0] > 0 and counts[1:] == pytest.approx([counts[0]] * 2, rel=0.001)


def test_too_many_groups_are_refused(rows_of, monkeypatch):
    monkeypatch.setattr(context_mixing, "GROUPS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        scored(rows_of, [(k, "a b", f"l{k}") for k in range(4)], F.lit(True))


def test_remembered_words_score_as_if_computed_again(rows_of, monkeypatch):
    monkeypatch.setattr(context_mixing, "BLOCK", 300)
    found = []
    for most in (1 << 20, 50, 0):
        monkeypatch.setattr(context_mixing, "REMEMBERED", most)
        code = context_mixing.huffman(np.arange(context_mixing.END + 1))
        rng = np.random.default_rng(3)
        tables = [context_mixing._stretched(context_mixing.halves(rng.integers(0, 9, (1 << b, 2)).astype(float)), s) for b, s in zip(context_mixing.BITS, (context_mixing._SEEN, context_mixing._SEEN_FOUR, context_mixing._SEEN), strict=True)]
        weights, refined = rng.normal(size=(context_mixing.GATES, 3)) * 0.3, rng.uniform(0.1, 0.9, context_mixing.GATES * context_mixing.LEVELS)
        remembered, logs, computed = context_mixing.Remembered(), [], 0
        texts = [t for _, t, _ in corpus(60)]
        common = np.sort(context_mixing.Words(pa.table({"text": texts})).hashes.astype(np.int64))[:70]
        voices = rng.normal(size=(len(common), 2)).astype(np.float32)
        for start in range(0, len(texts), 6):
            words = context_mixing.Words(pa.table({"text": texts[start : start + 6]}))
            words.spell(common, voices, remembered.keys)
            got = remembered.score(words, code, tables, weights, refined)
            computed += len(words.begin)
            logs += [*got[words.entry], *got[words.last]]
        found.append((logs, computed))
    assert found[0][0] == found[1][0] == found[2][0]
    assert found[0][1] < found[2][1] / 2


def test_what_words_begin_with_alike_is_computed_once(monkeypatch):
    """Few decisions are left, with the same counts in all tables; entries get what their symbols get one by one."""
    rng = random.Random(4)
    stems = ["".join(rng.choice("abc") for _ in range(n)) for n in (2, 9, 30, 300)]
    texts = [" ".join(rng.choice(stems) + rng.choice(["", "a", "b", "ing", "ç"]) for _ in range(40)) for _ in range(30)] + ["", "z" * 700 + "y"]
    words = context_mixing.Words(pa.table({"text": texts}))
    common = np.sort(words.hashes.astype(np.int64))
    words.spell(common, np.random.default_rng(2).normal(size=(len(common), 2)).astype(np.float32))
    code = context_mixing.huffman(np.append(words.byte_counts(), [len(words.word), len(texts)]))
    only, which = words.shared()
    lengths = np.diff(np.append(words.begin, len(words.symbols)))
    spelled = [(g, *words.symbols[b : b + n]) for g, b, n in zip(words.group, words.begin, lengths, strict=True)]
    beginnings = [entry[: k + 2] for entry in spelled for k in range(len(entry) - 1)]
    assert all(beginnings[only[e]] == beginnings[k] for k, e in enumerate(which))
    assert len({b for b in beginnings if len(b) < 16}) == sum(len(beginnings[k]) < 16 for k in only)

    counted = []
    monkeypatch.setattr(context_mixing, "learned", lambda portion, *more: counted.append(len(portion[0])))
    tables = [np.zeros(2 << b, np.uint32) for b in context_mixing.BITS]
    every = np.ones(len(words.uses), bool)
    context_mixing.gather(words, code, words.uses.astype(np.uint32), every, tables, None, None, None)
    whole = [np.zeros(2 << b, np.uint32) for b in context_mixing.BITS]
    decided = 0
    for word, bit, slots in context_mixing.decisions(words, code):
        decided += len(word)
        for table, slot in zip(whole, slots, strict=True):
            np.add.at(table, slot * 2 + bit, words.uses[word].astype(np.uint32))
    assert all((a == b).all() for a, b in zip(tables, whole, strict=True))
    assert sum(counted) < 0.6 * decided


def test_scoring_a_portion_costs_what_the_portion_holds(monkeypatch):
    """Sums made while a block is scored have about as many places as the block has symbols, however many portions it makes."""
    monkeypatch.setattr(context_mixing, "DECISIONS", 50)
    words = context_mixing.Words(pa.table({"text": [t for _, t, _ in corpus(100)]}))
    code = context_mixing.huffman(np.append(words.byte_counts(), [len(words.word), 100]))
    words.spell(np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    rng = np.random.default_rng(1)
    tables = [context_mixing._stretched(context_mixing.halves(rng.integers(0, 9, (1 << b, 2)).astype(float)), s) for b, s in zip(context_mixing.BITS, (context_mixing._SEEN, context_mixing._SEEN_FOUR, context_mixing._SEEN), strict=True)]
    made, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *args: made.append(len(out := bincount(*args))) or out)
    context_mixing.spelled(words, code, tables, context_mixing._start(), np.full(context_mixing.GATES * context_mixing.LEVELS, 0.5))
    assert len(made) > 20 and sum(made) <= 2 * len(words.symbols)


def test_the_group_ahead_is_found_a_group_at_a_time():
    """As by hand for each text; with many groups no array of all words by all groups is held."""
    rng = np.random.default_rng(7)
    texts = [t for _, t, _ in corpus(200)] + [""]
    for groups in (0, 1, 3, 200):
        words = context_mixing.Words(pa.table({"text": texts}))
        known = np.sort(words.hashes.astype(np.int64))[::2]
        voices = np.round(rng.normal(size=(len(known), groups)) * 4).astype(np.float32)  # whole numbers: sums are exact, ties occur
        tracemalloc.start()
        words.spell(known, voices)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 500 * len(words.word)
        voice = {h: v for h, v in zip(known.tolist(), voices, strict=True)}
        hashes, at = words.hashes.astype(np.int64).tolist(), 0
        for text, n in enumerate(words.of_text):
            sums = np.zeros(groups)
            for k in range(at, at + n + 1):
                ahead = int(sums.argmax()) if sums.any() else groups
                if k < at + n:
                    pair = words.keys[words.entry[k]]
                    which = words.word[k : k + 1]
                    assert pair == context_mixing.B.mix(words.hashes[which] + np.array([ahead], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
                    sums = sums + voice.get(hashes[words.word[k]], np.zeros(groups))
            assert words.last[text] == len(words.keys) + ahead
            at += n


def test_a_group_of_blank_texts_speaks_for_nothing():
    voices = context_mixing.voices_of(np.array([3, 4]), np.array([[0.0, 3.0], [0.0, 4.0]]))
    assert np.isfinite(voices).all() and (voices[:, 0] < voices[:, 1]).all()
