"""Queries over the given tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import alignment, bpe, chat, context_mixing, exact_top, jaccard, learned_search, mixing, quality, reputation, resampling, shared, templates, training_order, vectors

VOCABULARY = "word_bpe_49k.json"
#: Tokenizers that are aligned.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: Mixing: listed languages, markers of topics, how far shares are evened out, seed of the sample.
MIX = {"languages": ["en", "de", "fr", "es"], "topics": {"table": " | ", "contact": "@", "licence": "icense"}, "temper": 0.9, "seed": 11}

#: Exact search: results of a query, which rows are queries, factor of the components.
EXACT = {"k": 5, "every": 50, "scale": 256}
#: Links: words in a run, least similarity.
NEAR = {"width": 3, "num": 90, "den": 100}
#: Training order: ids of a sequence, sequences of a shard, key of the permutation.
ORDER = {"length": 1024, "per_shard": 1 << 14, "key": 20240817}
#: Url rules; least lower bound of a host's share of good pages, standard deviations below the mean.
URLS = {
    "rules": [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")],
    "least": 0.5,
    "width": 1.2816,
}
#: A conversation besides those of the table, whose texts hold control strings.
SPOKEN = "</s>[INST] ok [/INST]"
CHATS = {-1: [("user", SPOKEN), ("assistant", SPOKEN)]}
#: Resampling towards the benchmark: buckets of runs, drawn share in percent, least words of a drawn text, seed.
RESAMPLE = {"buckets": 10000, "percent": 5, "least_words": 20, "seed": 42}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    shared.bounded_batches(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def vocabulary() -> str:
    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        return file.read()


def _hex(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def op1_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return bpe.encode(table(spark, directory, "documents"), vocabulary(), keep=["doc_id"], decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _hex(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        _hex(F.col("decoded")).alias("decoded_sha256"),
    )


def op8_training_order(spark: SparkSession, directory: str) -> DataFrame:
    index = training_order.in_order(table(spark, directory, "documents"), **ORDER)
    return index.withColumnRenamed("id", "doc_id")


def op9_reputation(spark: SparkSession, directory: str) -> DataFrame:
    found = reputation.judged(table(spark, directory, "pages"), table(spark, directory, "labels"), **URLS)
    figures = [F.round(c, 6).alias(c) for c in ("reputation", "bound")]
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "labelled", *figures)


def remainder(id: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % of, F.lit(0))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Fitted to the labels that may be learned from."""
    return quality.fit(docs, labels.where(remainder("doc_id", 5) != 0))


def op10_quality(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    model = quality_model(docs, table(spark, directory, "labels"))
    return quality.score(docs, model, keep=["doc_id"]).select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op2_exact_top(spark: SparkSession, directory: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(EXACT["scale"] * x.cast("double")))
    rows = table(spark, directory, "embeddings").where(vectors.valid("embedding")).select(F.col("vec_id").alias("id"), whole.alias("vector"))
    found = exact_top.search(rows, rows.where(F.col("id") % EXACT["every"] == 0), EXACT["k"])
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op3_mixing(spark: SparkSession, directory: str) -> DataFrame:
    drawn = mixing.rake(table(spark, directory, "documents"), **MIX)
    return drawn.select("doc_id", "topic", "tokens", F.round("probability", 6).alias("probability"), "sampled")


def op4_templates(spark: SparkSession, directory: str) -> DataFrame:
    found = templates.extract(table(spark, directory, "pages"), keep=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_learned_search(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    found = learned_search.search(rows, rows.where(F.col("id") % 20 == 0), 20)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op6_context_mixing(spark: SparkSession, directory: str) -> DataFrame:
    found = context_mixing.score(table(spark, directory, "documents"), remainder("doc_id", 7) != 2, group="lang")
    return found.select(F.col("id").alias("doc_id"), (~F.col("trains")).alias("held_out"), *found.columns[2:])


def op7_jaccard(spark: SparkSession, directory: str) -> DataFrame:
    found = jaccard.linked(table(spark, directory, "documents"), **NEAR)
    return found.select(F.col("id").alias("doc_id"), F.col("tokens").alias("n_shingles"), F.col("component").alias("component_id"))


def alignment_files() -> alignment.Files:
    a, b = map(public_tokenizers.path, ALIGNED)
    with open(a, encoding="utf-8") as file, open(b, "rb") as model:
        return alignment.Files(file.read(), model.read())


def op11_alignment(spark: SparkSession, directory: str) -> DataFrame:
    found = alignment.aligned(table(spark, directory, "documents"), alignment_files(), keep=["doc_id"])
    digest = F.when(F.col("groups") == "", "").otherwise(_hex(F.col("groups")))
    stored = shared.written(found.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return alignment.with_counts(stored, alignment.b_ids(alignment_files()), ["doc_id", *alignment.MEASURES, "groups_sha256"])


def op12_chat(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    added = [F.struct(F.lit(i).alias("conv_id"), F.lit(k).alias("turn"), F.lit(r).alias("role"), F.lit(t).alias("text")) for i, own in CHATS.items() for k, (r, t) in enumerate(own)]
    rows = rows.unionByName(spark.range(1).select(F.inline(F.array(*added))))
    found = chat.formatted(rows, "conv_id", "turn", "role", chat.text_part(F.col("text")))
    read = found.select("conv_id", "formatted", "turns", chat.turns(F.col("formatted")).alias("read"), F.array_join(chat.learned_texts(F.col("formatted"), F.col("turns")), "").alias("learned"))
    total = lambda field: F.aggregate("turns", F.lit(0).cast("long"), lambda held, t: held + t[field])
    return read.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.size("read").cast("long").alias("n_turns"),
        _hex(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        _hex(F.col("learned")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        total("attached_tokens").alias("attached_tokens"),
    )


def op13_resampling(spark: SparkSession, directory: str) -> DataFrame:
    return resampling.resample(table(spark, directory, "documents"), table(spark, directory, "benchmark"), **RESAMPLE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_exact_top": op2_exact_top,
    "op3_mixing": op3_mixing,
    "op4_templates": op4_templates,
    "op5_learned_search": op5_learned_search,
    "op6_context_mixing": op6_context_mixing,
    "op7_jaccard": op7_jaccard,
    "op8_training_order": op8_training_order,
    "op9_reputation": op9_reputation,
    "op10_quality": op10_quality,
    "op11_alignment": op11_alignment,
    "op12_chat": op12_chat,
    "op13_resampling": op13_resampling,
}

STATEMENTS: dict[str, str] = {
    "op2_exact_top": exact_top.statement(**EXACT),
    "op3_mixing": mixing.statement(**MIX),
    "op7_jaccard": jaccard.statement(**NEAR),
    "op9_reputation": reputation.statement(**URLS),
    "op12_chat": chat.statement(CHATS),
}
