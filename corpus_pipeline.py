"""From raw documents to token ids: quality, near duplicates, mix, encoding.

Every stage takes (spark, docs, directory of the tables) and works on all rows its predecessor kept. The first three return
the columns of `documents`; the last returns the ids and the text decoded from them, which op1 gives as digests.

Cases. Null and empty texts: scored by the share of good labels, never near duplicates, sampled with the probability of their cell,
no ids. Very long texts: whole in every stage. Repeated rows and rows that share an id: one document; of those the first by
text, null first, and then by the other columns stays. Null ids: no group can name them, so all stay, up to the mix, where they draw like the
empty id. Ties: the least id of a group stays. Columns besides those of `documents`, whatever their names: kept as they
are, up to the last stage, which gives its own. Empty tables: empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import bpe, jaccard, mixing, quality, shared
from scoreloom.llm.queries import MIX, quality_model, table, vocabulary
from scoreloom.operators.dedup import first_per_key

#: Near duplicates: words in a run, least similarity in hundredths.
WIDTH, SIMILAR = 5, 80
#: Least score of a document that stays.
LEAST_SCORE = 0.3


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def keep_good(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject."""
    model = quality_model(docs, table(spark, directory, "labels"))
    mark = _unused(docs, "score")
    return quality.score(docs, model, into=mark).where(F.col(mark) >= LEAST_SCORE).drop(mark)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """The document with the least id of each group of near duplicates; documents without words stay."""
    shared.bounded_batches(spark)
    found = jaccard.linked(docs, WIDTH, SIMILAR, 100).where("id is not null").groupBy(F.col("id").alias("doc_id"))
    # ids that can't stay as they are: few, so that most texts need not be moved, and none twice
    judged = found.agg(F.max(F.col("component") != F.col("id")).alias("gone"), F.count("*").alias("rows")).where("gone or rows > 1")
    judged = shared.written(judged, "judged")
    named = docs.where("doc_id is not null")
    once = named.join(judged.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    order = [F.col(c).asc_nulls_first() for c in ["text", *(c for c in docs.columns if c not in ("doc_id", "text"))]]
    one = first_per_key(named.join(judged.where("not gone").select("doc_id"), "doc_id", "left_semi"), ["doc_id"], order)
    return docs.where("doc_id is null").unionByName(once).unionByName(one)


def sample_mix(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target shares of tokens."""
    names = {c: _unused(docs, c) for c in docs.columns if c.lower() in mixing.ADDED}
    drawn = mixing.rake(docs.withColumnsRenamed(names), **MIX).where("sampled")
    return drawn.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def to_ids(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Token ids of every whole text, and the text that these give."""
    shared.bounded_batches(spark)
    return bpe.encode(docs, vocabulary(), keep=["doc_id"], decoded="decoded").select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_near),
    ("mixing sources", sample_mix),
    ("BPE encoding and decoding", to_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the encoding have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
STATEMENTS: dict[str, str] = {}
