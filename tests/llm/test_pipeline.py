"""Every stage with nulls, empty and long texts, repeated rows, clashing columns."""

import random
import re

import corpus_pipeline as P
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens string, _score string, score string, component long, topic string, id string"


@pytest.fixture(scope="module")
def tables(spark, small, tmp_path_factory):
    """Real documents, which teach the classifier, beside odd ones."""
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(1)
    real = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    good = max((r for r in real if r[2] == "en"), key=lambda r: len(r[1]))[1].split()
    text = lambda n: " ".join(rng.choices(good, k=n))
    same, long, copied = text(80), text(60_000), text(90)
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, long), (None, same), (None, same), (None, None)]
    odd += [(10**6 + 3, same)] * 3 + [(10**6 + 4, text(70)), (10**6 + 4, text(75)), (10**6 + 5, copied), (10**6 + 6, copied), (10**6 + 7, copied + " more")]
    rows = [(*r, "t", "s", "sc", 5, "to", "i") for r in real] + [(i, t, None if k % 2 else "en", None, None, "t", "s", "sc", 5, "to", "i") for k, (i, t) in enumerate(odd)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(folder / "documents.parquet"))
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(str(folder / "labels.parquet"))
    return str(folder), same, long


def test_stages_on_odd_rows(spark, tables):
    folder, same, long = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = docs.columns[5:]
    (_, good), (_, near), (_, mix), (_, ids) = P.STAGES
    kept = good(spark, docs, folder).cache()
    assert kept.columns == docs.columns
    assert kept.exceptAll(docs).isEmpty()
    by = {}
    for r in kept.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert (10**6 + 2) in by and by[10**6 + 2][0]["text"] == long
    one = near(spark, kept, folder).cache()
    assert one.columns == docs.columns and one.exceptAll(kept).isEmpty()
    left = [r["doc_id"] for r in one.collect()]
    named = [i for i in left if i is not None]
    assert len(named) == len(set(named)), "one row of each id"
    assert left.count(None) == len(by.get(None, []))
    assert sum(i in (10**6 + 5, 10**6 + 6, 10**6 + 7) for i in named) == 1
    first = min((r["text"] for r in by[10**6 + 4]), default=None)
    assert [r["text"] for r in one.where(f"doc_id = {10**6 + 4}").collect()] in ([first], [])
    mixed = mix(spark, one, folder).cache()
    assert mixed.columns == docs.columns and mixed.exceptAll(one).isEmpty()
    assert mixed.select(*extra).distinct().count() == 1, "clashing columns keep their values"
    made = ids(spark, mixed, folder)
    assert made.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert made.count() == mixed.count()
    assert all(r["n_tokens"] == len(r["ids"]) for r in made.collect())


def test_run_on_odd_rows(spark, tables):
    folder = tables[0]
    got = [r["doc_id"] for r in P.run(spark, folder).collect() if r["doc_id"] is not None]
    assert len(got) == len(set(got)) > 50


def test_near_duplicates_move_texts_once(spark, tables):
    """Both what stays as it is and ids of several rows are read from one exchange."""
    folder = tables[0]
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        one = P.keep_one_of_near(spark, docs, folder)
        for name, value in settings.items():
            spark.conf.set(name, value)
        plan = one.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert re.search(r"ReusedExchange \[[^\]]*text#", plan)
