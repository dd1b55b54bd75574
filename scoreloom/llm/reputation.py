"""URL filter by rules first, else by an empirical-Bayes reputation of the host.

Pages with a known outcome (good 1, bad 0) are counted by host, registered domain (the label before the suffix and
the suffix) and suffix (the last label, or one of `suffixes`). From the top down every level's share of good pages is shrunk
towards that of the level above it: a beta prior with that mean and a strength estimated from how much the shares of
the level's groups differ beyond binomial noise (method of moments, kept within STRENGTHS). A host's posterior is the beta
distribution of its own counts on top of its domain's share; the page is allowed if the posterior mean less
`width` standard deviations is at least `least`. Hosts without outcomes have their domain's prior, unknown domains
their suffix's, unknown suffixes the share of all pages.

Cases. Null urls or urls without `://`: empty host and path, which count as a host like any other. Null, other or missing
outcomes teach nothing; without any the share of all is 0.5. Repeated label rows count once, different ones each; repeated
pages count each. Ties among rules of one length: the first given. Very long urls: whole. Empty tables: empty result. Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least and greatest strength of a prior, in pages.
STRENGTHS = (1.0, 1000.0)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: str) -> tuple[Column, Column]:
    """Host and path."""
    begin = F.instr(F.col(url), "://")
    rest = F.when(begin > 0, F.substring(F.col(url), begin + 3, F.length(F.col(url)))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matched(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else null."""
    rule = verdict = F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: -len(r[1])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        rule = F.coalesce(rule, F.when(fits, F.lit(text)))
        verdict = F.coalesce(verdict, F.when(fits, F.lit(action)))
    return rule, verdict


def _domains(host: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    """Registered domain and suffix."""
    suffix = F.regexp_extract(host, r"[^.]*$", 0)
    for s in sorted(suffixes, key=len):
        suffix = F.when((host == s) | host.endswith(f".{s}"), F.lit(s)).otherwise(suffix)
    before = F.substring(host, F.lit(1), F.greatest(F.length(host) - F.length(suffix) - 1, F.lit(0)))
    label = F.regexp_extract(before, r"[^.]*$", 0)
    return F.when(label == "", suffix).otherwise(F.concat(label, F.lit("."), suffix)), suffix


def _strength(groups: DataFrame) -> DataFrame:
    """One row: the strength of the prior of a level whose groups have `n` outcomes, `good` of them good."""
    low, high = STRENGTHS
    all_ = groups.where("n > 0").agg(
        F.count("*").alias("k"), F.sum("n").alias("N"), F.sum("good").alias("G"), F.sum(F.col("n") * F.col("n")).alias("N2"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("S")
    )
    mean = F.col("G") / F.col("N")
    noise = mean * (1 - mean)
    between = ((F.col("S") - F.col("N") * mean * mean) - (F.col("k") - 1) * noise) / (F.col("N") - F.col("N2") / F.col("N"))
    found = F.when((F.col("k") > 1) & (noise > 0) & (between > 0), noise / between - 1)
    return all_.select(F.least(F.greatest(F.coalesce(found, F.lit(high)), F.lit(low)), F.lit(high)).alias("strength"))


def _shrunk(groups: DataFrame, above: DataFrame, key: str, parent: str) -> DataFrame:
    """Groups with `prior` and `share`; `above` has `key` and `share` of the level above."""
    placed = groups.join(above.select(F.col(key).alias(parent), F.col("share").alias("prior")), parent, "left")
    with_strength = placed.join(F.broadcast(_strength(groups)))  # one row
    return with_strength.withColumn("share", (F.col("good") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength")))


def judged(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]],
    least: float,
    width: float,
    suffixes: Sequence[str] = (),
    id: str = "page_id",
    url: str = "url",
    outcome_id: str = "doc_id",
    outcome: str = "quality",
) -> DataFrame:
    """id, host, path, rule, verdict and the host's reputation for every page."""
    host, path = parts(url)
    known = outcomes.select(F.col(outcome_id).alias("id"), F.col(outcome).cast("int").alias("good")).where("good in (0, 1)").distinct()
    all_pages = pages.select(F.col(id).alias("id"), host.alias("host"), path.alias("path"))
    by_host = all_pages.select("id", "host").join(known, "id", "left").groupBy("host").agg(F.sum(F.when(F.col("good").isNotNull(), 1).otherwise(0)).cast("double").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("good"))
    domain, suffix = _domains(F.col("host"), suffixes)
    by_host = by_host.withColumns({"domain": domain, "suffix": suffix})
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    by_domain = by_host.groupBy("domain", "suffix").agg(*sums)
    by_suffix = by_domain.groupBy("suffix").agg(*sums).withColumn("everything", F.lit(""))
    top = by_suffix.agg(*sums).select(F.lit("").alias("everything"), F.coalesce(F.when(F.col("n") > 0, F.col("good") / F.col("n")), F.lit(0.5)).alias("share"))
    by_suffix = _shrunk(by_suffix, top, "everything", "everything")
    by_domain = _shrunk(by_domain, by_suffix, "suffix", "suffix")
    by_host = _shrunk(by_host.drop("suffix"), by_domain, "domain", "domain")
    spread = F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("n") + F.col("strength") + 1))
    reputed = by_host.select("host", F.col("n").cast("long").alias("labelled"), F.col("share").alias("reputation"), (F.col("share") - width * spread).alias("bound"))
    rule, verdict = matched(rules, F.col("host"), F.col("path"))
    method = F.when(F.col("bound") >= least, F.lit("allow")).otherwise(F.lit("block"))
    return all_pages.join(reputed, "host", "left").select(
        "id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "labelled", "reputation", "bound"
    )


def statement(rules: Sequence[tuple[str, str]], least: float, width: float) -> str:
    """The same over tables `pages` and `labels` in SQL, for suffixes of one label."""
    low, high = STRENGTHS
    fits, verdicts = [], []
    for action, text in sorted(rules, key=lambda r: -len(r[1])):
        domain, _, start = text.partition("/")
        test = f"WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '/{start}') THEN"
        fits.append(f"{test} '{text}'")
        verdicts.append(f"{test} '{action}'")

    def strength(level: str) -> str:
        return f"""strength_{level} AS (SELECT least(greatest(coalesce(CASE WHEN k > 1 AND p * (1 - p) > 0 AND between_ > 0
            THEN p * (1 - p) / between_ - 1 END, {high}), {low}), {high}) AS strength FROM (SELECT *, (S - N * p * p - (k - 1) * p * (1 - p)) / (N - N2 / N) AS between_
            FROM (SELECT count(*) AS k, sum(n) AS N, sum(good) / sum(n) AS p, sum(n * n) AS N2, sum(good * good / n) AS S FROM {level} WHERE n > 0)))"""

    return f"""WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        known AS (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IN (0, 1)),
        hosts AS (SELECT host, regexp_extract(host, '[^.]*$') AS suffix, CASE WHEN contains(host, '.') THEN regexp_extract(host, '[^.]*[.][^.]*$') ELSE host END AS domain,
            count(quality)::DOUBLE AS n, coalesce(sum(quality), 0)::DOUBLE AS good FROM parts LEFT JOIN known ON page_id = doc_id GROUP BY host),
        domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
        suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL),
        {strength("suffixes")}, {strength("domains")}, {strength("hosts")},
        top AS (SELECT coalesce(CASE WHEN sum(n) > 0 THEN sum(good) / sum(n) END, 0.5) AS share FROM suffixes),
        s AS (SELECT suffix, (good + strength * share) / (n + strength) AS share FROM suffixes, strength_suffixes, top),
        d AS (SELECT domain, (good + strength * share) / (n + strength) AS share FROM domains JOIN s USING (suffix), strength_domains),
        h AS (SELECT host, n, strength, (good + strength * share) / (n + strength) AS share FROM hosts JOIN d USING (domain), strength_hosts),
        b AS (SELECT host, n, share, share - {width} * sqrt(share * (1 - share) / (n + strength + 1)) AS bound FROM h)
        SELECT page_id, host, path, CASE {" ".join(fits)} END AS rule,
            coalesce(CASE {" ".join(verdicts)} END, CASE WHEN bound >= {least} THEN 'allow' ELSE 'block' END) AS verdict,
            n::BIGINT AS labelled, round(share, 6) AS reputation, round(bound, 6) AS bound
        FROM parts LEFT JOIN b USING (host)"""
