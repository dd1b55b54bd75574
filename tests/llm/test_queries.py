"""The registered queries over whole tables: against SQL where there is some, else against brute force."""

import hashlib
import math
import re
import zlib

import __spark_entry__ as entry
import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from scoreloom.llm import queries as Q
from tokenizers import Tokenizer

from .test_jaccard import brute

FILE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
TABLES = ("documents", "embeddings", "pages", "labels", "conversations")


def lines(sql, small):
    with duckdb.connect() as db:
        for name in TABLES:
            db.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
        made = db.execute(sql)
        return [c[0] for c in made.description], made.fetchall()


def test_all_are_registered():
    names = entry.queries()
    assert [n for k in range(1, 14) for n in names if n.startswith(f"op{k}_")] == list(Q.QUERIES)
    assert "pipeline" in names
    assert set(Q.STATEMENTS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", Q.STATEMENTS)
def test_as_sql(spark, small, name):
    columns, expected = lines(Q.STATEMENTS[name], small)
    got = Q.QUERIES[name](spark, small).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_op1(spark, small):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for i, text in lines("select doc_id, text from documents", small)[1]:
        ids = FILE.encode(text or "", add_special_tokens=False).ids
        expected.append((i, len(ids), digest(" ".join(map(str, ids))), digest(FILE.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, Q.op1_bpe(spark, small).collect())) == sorted(expected)


def test_op4(spark, small):
    for r in Q.op4_templates(spark, small).collect():
        page = lines(f"select html from pages where page_id = {r['page_id']}", small)[1][0][0]
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [re.sub(r"<br>|</?b>", " ", b) for b in re.split(r"</?(?:p|h1|div)>", article)]
        assert r["text"].split() == Q.templates.html.unescape(" ".join(blocks)).split()
        assert r["n_chars"] == len(r["text"])


def test_op5_recall(spark, small):
    got = {}
    for r in Q.op5_learned_search(spark, small).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = lines("select vec_id, embedding from embeddings order by 1", small)[1]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hits = 0
    for q in got:
        near = x @ x[ids == q][0]
        near[ids == q] = -9
        hits += len(set(ids[np.argsort(-near)[:20]]) & got[q])
    assert set(got) == set(ids[ids % 20 == 0].tolist())
    assert hits / (20 * len(got)) >= 0.9


def test_op6(spark, small):
    got = {r["doc_id"]: r for r in Q.op6_context_mixing(spark, small).collect()}
    for i, text in lines("select doc_id, text from documents", small)[1]:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert got[i]["n_tokens"] == len(re.findall(r"[^\x20\x09-\x0D]+", text)) + 1
        assert got[i]["n_known"] <= got[i]["n_tokens"]
        assert math.isfinite(got[i]["score"]) and got[i]["score"] < 0


def test_op7(spark, small):
    rows = lines("select doc_id, text from documents", small)[1]
    assert sorted(map(tuple, Q.op7_jaccard(spark, small).collect()), key=str) == brute(rows, 3, 90, 100)


def test_op8(spark, small):
    index = Q.op8_training_order(spark, small).collect()
    assert sorted(r["slot"] for r in index) == list(range(len(index)))
    size = {i: len((t or "").encode()) + 1 for i, t in lines("select doc_id, text from documents", small)[1]}
    assert sorted((r["doc_id"], r["part"]) for r in index) == sorted((i, k) for i, n in size.items() for k in range(-(-n // 1024)))


def test_op10(spark, small):
    got = Q.op10_quality(spark, small).collect()
    marks = dict(lines("select doc_id, quality from labels", small)[1])
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in marks]
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in held) / len(held) >= 0.9


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert len(names) == 4
    good = stages[0](spark, docs, small)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in Q.op10_quality(spark, small).collect() if r["predicted"]}
    good = good.cache()
    assert {r["doc_id"] for r in good.collect()} == kept
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    one = stages[1](spark, good, small)
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, _, c in brute(rows, 5, 80, 100) if i == c)
    mixed = stages[2](spark, one, small)
    assert mixed.columns == docs.columns
    drawn = Q.mixing.rake(one, **Q.MIX).where("sampled")
    assert mixed.exceptAll(drawn.select(*docs.columns)).count() == 0
    assert 0.3 * one.count() < mixed.count() <= one.count()
    ids = stages[3](spark, mixed, small).collect()
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in ids} == {i: FILE.encode(t, add_special_tokens=False).ids for i, t in text.items()}
    whole = corpus_pipeline.run(spark, small).collect()
    assert sorted(r["doc_id"] for r in whole) == sorted(text)


def test_last_stage_decodes(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40).cache()
    expected = {r["doc_id"]: FILE.decode(FILE.encode(r["text"] or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in docs.collect()}
    assert {r["doc_id"]: r["decoded"] for r in corpus_pipeline.to_ids(spark, docs, small).collect()} == expected


def test_stages_with_empty_tables(spark, small, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{small}/{name}.parquet").where(F.lit(False)).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
