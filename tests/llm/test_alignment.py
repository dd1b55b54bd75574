import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from scoreloom.llm import alignment as A
from scoreloom.llm import queries as Q
from scoreloom.llm.shared import written
from tokenizers import Tokenizer

FILES = Q.alignment_files()
CODER = A.Coder(FILES)
WHOLE = Tokenizer.from_file(public_tokenizers.path(Q.ALIGNED[0]))
WHOLE.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(Q.ALIGNED[1]))
LETTERS = A._letters()
DOCS = "doc_id long, text string"


def brute(text):
    """Ids, groups and overlapping pairs of occurrences, from the libraries' own tokens."""
    text = text or ""
    a, b = WHOLE.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
    bytes_a = [bytes(LETTERS[c] for c in WHOLE.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(PIECES.id_to_piece(i)[3:5], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], [], [], []
    spans = []
    for side in (bytes_a, bytes_b):
        at, own = 0, []
        for t in side:
            own.append((at, at + len(t)))
            at += len(t)
        spans.append(own)
    links, low = [], 0
    for i, (s, e) in enumerate(spans[0]):
        while spans[1][low][1] <= s:
            low += 1
        j = low
        while j < len(b) and spans[1][j][0] < e:
            links.append((a[i], b[j]))
            j += 1
    number = {e: k for k, e in enumerate(sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}))}
    groups = [([], []) for _ in number]
    for side, (ids, own) in enumerate(zip((a, b), spans)):
        at = 0
        for x, (_, e) in zip(ids, own):
            groups[at][side].append(x)
            at += e in number
    return a, b, groups, links


def rendered(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def expected(docs):
    made = [(i, *brute(t)) for i, t in docs]
    count = Counter(p for *_, links in made for p in links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    rows = []
    for i, a, b, groups, links in made:
        digest = hashlib.sha256(rendered(groups).encode()).hexdigest() if a else ""
        rows.append((i, len(a), len(b), len(groups), len(links), digest, sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links)))
    return rows


odd = st.text("aé'sS 1٣漢🙂\n\t<>|_▁\x00\x85 ́ẞǅ", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), odd, st.sampled_from(["", "</s>", "<|endoftext|> <s>", "<0x0A>", " ", "  a", "a  "])), min_size=1, max_size=6))
def test_any_texts(texts):
    made = A.align(CODER, texts)
    for k, text in enumerate(texts):
        a, b, groups, links = brute(text)
        assert [int(made.measures[m][k]) for m in A.MEASURES] == [len(a), len(b), len(groups), len(links)]
        assert made.rendered[k].as_py() == rendered(groups)
        mine = made.pairs[made.text == k].tolist()
        assert sorted(mine) == sorted(x * len(CODER.b.lengths) + y for x, y in links)


def test_libraries_agree_where_the_quick_one_serves():
    wrong = []
    for point in range(A._PLAIN_BELOW):
        c = chr(point)
        for t in (f" a{c}b", f" 1{c}2", f" {c} {c}{c}!", f" :{c}: 's{c} x\n{c}\n", f"{c}'ll '{c}l  {c}"):
            if CODER.quick.encode_ordinary(t) != WHOLE.encode(t, add_special_tokens=False).ids:
                wrong.append(hex(point))
    assert wrong == []


def test_texts_that_the_quick_library_reads():
    plain = ["", " a b", " é\u036f", " " + "x" * 511, " " * 511 + "a", (" " * 300 + "b") * 5]
    other = [" \u0370", " a漢", " " + "x" * 512, "a" + " " * 512, " a" + "\n\t" * 256 + "b", " é" + "y" * 600]
    assert [A._plain(t) for t in plain + other] == [True] * len(plain) + [False] * len(other)


@pytest.mark.parametrize("part", [1, 7, 100])
def test_parts_change_no_ids(monkeypatch, part):
    rng = random.Random(part)
    words = ["word", "Wort9", "l'été", "  ", "\n", "a", "123", "...", "don't", "漢字", "x" * 30]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(20)]
    whole = [[x.tolist() for x in CODER.encode(t)] for t in texts]
    monkeypatch.setattr(A, "PART", part)
    assert [[x.tolist() for x in CODER.encode(t)] for t in texts] == whole
    assert whole == [[WHOLE.encode(" " + t, add_special_tokens=False).ids, PIECES.encode(t)] for t in texts]


def counted(df):
    stored = written(A.aligned(df, FILES, keep=["doc_id"]), "aligned")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups"), 256))
    stored = stored.withColumn("groups_sha256", digest)
    return sorted(map(tuple, A.with_counts(stored, A.b_ids(FILES), ["doc_id", *A.MEASURES, "groups_sha256"]).collect()), key=str)


@pytest.mark.parametrize("block", [200, 8 << 20])
def test_counts_over_all_texts(rows_of, monkeypatch, block):
    rng = random.Random(4)
    words = ["Alpha", "beta", "gamma's", "été", "12345", "漢字", "unbelievably", "\n\n", "</s>"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randrange(30)))) for k in range(120)]
    docs += [(120, None), (121, ""), (122, "a▁b"), (None, "beta"), (123, "beta " * 60_000), (123, "beta " * 60_000), (124, "y" * 20_000)]
    monkeypatch.setattr(A, "BLOCK", block)
    monkeypatch.setattr(A, "BATCH", min(block, A.BATCH))
    assert counted(rows_of([(*d, "clash", 3) for d in docs], DOCS + ", groups string, n_a int")) == sorted(expected(docs), key=str)


def test_empty_tables(rows_of):
    assert counted(rows_of([], DOCS)) == []
    assert counted(rows_of([(1, None), (2, "")], DOCS)) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]


def test_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    columns = ["doc_id", *A.MEASURES, "groups_sha256", *A.COUNTED]
    assert sorted(map(tuple, Q.op11_alignment(spark, small).select(*columns).collect())) == sorted(expected(docs))
