"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed in cells of source, language and topic. Cells are raked: factors of sources, of languages and of topics are
set in turn so that the sums over each meet their targets, until all three agree. The product of its three factors is a cell's
calibrated weight against the tokens it has; divided by the largest of all cells with tokens it is the probability with which
each of the cell's documents is sampled. Expected sums of sampled tokens then lie in the target ratios exactly.

Targets are tempered shares: (share of tokens) ** `temper`, scaled to one; 1 keeps the mix, 0 makes all values equal.
Languages and topics are lists given by the caller, everything else counts as `other`; sources may be any number. One
row for each source holds the sums of its cells, so a round of raking is one aggregation over the sources that gives the driver
len(languages) * len(topics) numbers. The document table is read twice: for the sums and for the sample.

Cases. Null source: as the empty one. Null or unlisted language: `other`. Null and empty texts: no tokens, topic of the empty
text, the probability of their cell; 1 where their cell has no tokens. Repeated rows and ties: equal ids draw alike.
Null id: as the empty one. Empty tables: empty result. Columns the operator adds replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.shared import written

OTHER = "other"
ADDED = ("topic", "tokens", "probability", "sampled")
ROUNDS, CLOSE = 100, 1e-12


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_by_marker(text: str, markers: Mapping[str, str]) -> Column:
    """The first topic whose marker stands in the text, else `other`."""
    found = F.lit(None).cast("string")
    for topic, marker in markers.items():
        found = F.coalesce(found, F.when(F.col(text).contains(marker), F.lit(topic)))
    return F.coalesce(found, F.lit(OTHER))


def uniform(id: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _tempered(sums: Sequence[float], temper: float) -> list[float]:
    total = sum(sums)
    raised = [(s / total) ** temper if s > 0 else 0.0 for s in sums]
    return [r / sum(raised) for r in raised]


def rake(
    docs: DataFrame,
    languages: Sequence[str],
    topics: Mapping[str, str],
    temper: float,
    seed: int,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    language: str = "lang",
) -> DataFrame:
    """All rows with topic, tokens, the probability of being sampled and whether they are."""
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    tongues, subjects = [*languages, OTHER], [*topics, OTHER]
    cells = [(i, j) for i in range(len(tongues)) for j in range(len(subjects))]
    place = F.when(F.lit(False), 0)
    for i, name in enumerate(languages):
        place = place.when(F.col(language) == name, i)
    marked = docs.select(
        *kept,
        topic_by_marker(text, topics).alias("topic"),
        words(text).alias("tokens"),
        F.coalesce(F.col(source), F.lit("")).alias("__source"),
        place.otherwise(len(languages)).alias("__language"),
    )
    name = lambda i, j: f"w{i}_{j}"
    sums = [F.sum(F.when((F.col("__language") == i) & (F.col("topic") == subjects[j]), F.col("tokens")).otherwise(0)).cast("double").alias(name(i, j)) for i, j in cells]
    by_source = written(marked.groupBy("__source").agg(*sums), "cells")
    own = sum((F.col(name(i, j)) for i, j in cells), F.lit(0.0))
    row = by_source.agg(*[F.sum(name(i, j)).alias(name(i, j)) for i, j in cells], F.sum(own).alias("all")).first()
    total = row["all"] or 0.0
    if not total:
        return marked.select(*kept, "topic", "tokens", F.lit(1.0).alias("probability"), F.lit(True).alias("sampled"))
    raised = by_source.agg(F.sum(F.when(own > 0, F.pow(own / total, temper)))).first()[0]
    target = F.when(own > 0, F.pow(own / total, temper) / raised).otherwise(0.0)
    of_language = _tempered([sum(row[name(i, j)] for j in range(len(subjects))) for i in range(len(tongues))], temper)
    of_topic = _tempered([sum(row[name(i, j)] for i in range(len(tongues))) for j in range(len(subjects))], temper)

    b, c = [1.0] * len(tongues), [1.0] * len(subjects)

    def factor() -> Column:
        """Of the source, given those of languages and topics."""
        now = sum((F.col(name(i, j)) * (b[i] * c[j]) for i, j in cells), F.lit(0.0))
        return F.when(own > 0, target / now).otherwise(0.0)

    for _ in range(ROUNDS):
        held = by_source.withColumn("a", factor()).agg(*[F.sum(F.col("a") * F.col(name(i, j))).alias(name(i, j)) for i, j in cells]).first()
        gap = max(abs(sum(held[name(i, j)] * b[i] * c[j] for j in range(len(subjects))) - of_language[i]) for i in range(len(tongues)))
        gap = max(gap, *(abs(sum(held[name(i, j)] * b[i] * c[j] for i in range(len(tongues))) - of_topic[j]) for j in range(len(subjects))))
        if gap < CLOSE:
            break
        for i in range(len(tongues)):
            now = sum(held[name(i, j)] * c[j] for j in range(len(subjects)))
            b[i] = of_language[i] / now if now else 0.0
        for j in range(len(subjects)):
            now = sum(held[name(i, j)] * b[i] for i in range(len(tongues)))
            c[j] = of_topic[j] / now if now else 0.0

    factors = by_source.withColumn("a", factor())
    most = factors.agg(F.max(F.greatest(*[F.when(F.col(name(i, j)) > 0, F.col("a") * (b[i] * c[j])).otherwise(0.0) for i, j in cells]))).first()[0]
    chance = [F.when(F.col(name(i, j)) > 0, F.least(F.col("a") * (b[i] * c[j] / most), F.lit(1.0))).otherwise(1.0).alias(f"p{i}_{j}") for i, j in cells]
    chances = written(factors.select("__source", *chance), "chances")
    which = F.when(F.lit(False), 0.0)
    for i, j in cells:
        which = which.when((F.col("__language") == i) & (F.col("topic") == subjects[j]), F.col(f"p{i}_{j}"))
    drawn = marked.join(chances, "__source").withColumn("probability", which)
    return drawn.select(*kept, "topic", "tokens", "probability", (uniform(id, seed) < F.col("probability")).alias("sampled"))


def statement(languages: Sequence[str], topics: Mapping[str, str], temper: float, seed: int, rounds: int = 30) -> str:
    """The same over a table `documents` in SQL, with a fixed number of rounds."""
    tongue = "CASE " + " ".join(f"WHEN lang = '{x}' THEN '{x}'" for x in languages) + f" ELSE '{OTHER}' END"
    subject = "CASE " + " ".join(f"WHEN contains(text, '{m}') THEN '{t}'" for t, m in topics.items()) + f" ELSE '{OTHER}' END"
    parts = [
        f"""docs AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS s, {tongue} AS l, {subject} AS t,
            coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n FROM documents)""",
        "cells AS MATERIALIZED (SELECT s, l, t, sum(n)::DOUBLE AS w FROM docs GROUP BY ALL HAVING sum(n) > 0)",
    ]
    for d in "slt":
        parts.append(f"raw_{d} AS (SELECT {d}, pow(sum(w) / (SELECT sum(w) FROM cells), {temper}) AS r FROM cells GROUP BY {d})")
        parts.append(f"goal_{d} AS MATERIALIZED (SELECT {d}, r / (SELECT sum(r) FROM raw_{d}) AS goal FROM raw_{d})")
    parts.append("x0 AS MATERIALIZED (SELECT s, l, t, w AS x, 1.0::DOUBLE AS f FROM cells)")
    for k in range(rounds):
        for d, (old, new) in zip("slt", ((f"x{k}", f"y{k}"), (f"y{k}", f"z{k}"), (f"z{k}", f"x{k + 1}")), strict=True):
            parts.append(
                f"{new} AS MATERIALIZED (SELECT o.s, o.l, o.t, x * goal / sum(x) OVER (PARTITION BY o.{d}) AS x,"
                f" f * goal / sum(x) OVER (PARTITION BY o.{d}) AS f FROM {old} o JOIN goal_{d} g ON o.{d} = g.{d})"
            )
    return f"""WITH {", ".join(parts)}, p AS (SELECT s, l, t, f / (SELECT max(f) FROM x{rounds}) AS p FROM x{rounds})
        SELECT doc_id, t AS topic, n AS tokens, round(coalesce(p, 1.0), 6) AS probability,
            ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT::DOUBLE / 4503599627370496 < coalesce(p, 1.0) AS sampled
        FROM docs LEFT JOIN p USING (s, l, t)"""
