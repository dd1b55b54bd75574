import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from scoreloom.llm import bpe
from scoreloom.llm.queries import vocabulary
from tokenizers import Tokenizer

FILE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
VOCABULARY = bpe.Vocabulary(vocabulary())


def local(texts):
    """Ids by the vocabulary alone, without Spark."""
    numbers = bpe._Numbers()
    of_text = [[numbers[c] for part in VOCABULARY.chunks(t) for c in part] for t in texts]
    ids, counts = VOCABULARY.encode_chunks(list(numbers))
    pieces = np.split(ids, np.cumsum(counts)[:-1])
    return [[int(i) for c in text for i in pieces[c]] for text in of_text]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
def test_any_text_as_the_library(texts):
    assert local(texts) == [FILE.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_character_as_the_library():
    """After a colon, a letter and a digit, and before a mark; every 64th of the planes that hold ideographs, private characters or none."""
    points = [c for c in (*range(0x20000), *range(0x20000, 0x110000, 64)) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(points), 1 << 14):
        texts = [f":{chr(c)} a{chr(c)} 1{chr(c)}\u0301" for c in points[low : low + (1 << 14)]]
        expected = [e.ids for e in FILE.encode_batch(texts, add_special_tokens=False)]
        assert local(texts) == expected


def test_runs_of_doubled_pairs_and_odd_letters():
    rng = random.Random(3)
    texts = ["a" * n for n in range(1, 40)] + ["ab" * 30, "aab" * 20, "ΣΑΣ σς İ ﬁ é", "x\x85y\x1cz w", "漢字 한국어 👍🏽"]
    texts += ["".join(rng.choice("aabst'é <|>_٣Ⅷ!\t") for _ in range(50)) for _ in range(300)]
    assert local(texts) == [FILE.encode(t, add_special_tokens=False).ids for t in texts]


def test_encode_and_decode(rows_of):
    texts = ["Hello  World's", "", None, "<|startoftext|>hi<|endoftext|> é", "same", "same", "long " * 30000]
    df = rows_of([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(df, vocabulary(), keep=["doc_id", "ids"]), vocabulary()).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        ids = FILE.encode(text or "", add_special_tokens=False).ids
        assert list(got[k]["ids"]) == ids
        assert got[k]["decoded"] == FILE.decode(ids, skip_special_tokens=False)


def test_one_worker_does_both(rows_of):
    df = rows_of([(1, "Hello  World's", "c"), (2, None, "c"), (3, "é " * 3000, "c")], "doc_id long, text string, decoded string")
    both = bpe.encode(df, vocabulary(), decoded="decoded")
    assert both.columns == ["doc_id", "ids", "decoded"]
    one = bpe.decode(bpe.encode(df, vocabulary(), keep=["doc_id"]), vocabulary())
    assert sorted(map(str, both.collect())) == sorted(map(str, one.collect()))


def test_decode_leaves_out_unknown_ids(rows_of):
    df = rows_of([(1, [320, 999999, -5, 321]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, vocabulary()).collect()}
    assert got == {1: FILE.decode([320, 321], skip_special_tokens=False), 2: "", 3: ""}


def test_empty_table(rows_of):
    df = rows_of([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, vocabulary()), vocabulary()).collect() == []
