"""Judging answers to question suites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(cases: DataFrame) -> DataFrame:
    """Adds passed and cited. cases: answer, expected (array), must_cite, min_sources, n_sources.

    All expected texts must be in the answer, whatever their case; where none is expected, only an
    empty, apologetic or insufficient answer passes. A case that must cite needs its sources.
    """
    answer = F.lower(F.coalesce("answer", F.lit("")))
    contained = F.forall("expected", lambda e: answer.contains(F.lower(e)))
    refused = (answer == "") | answer.contains("sorry") | answer.contains("insufficient")
    right = F.when(F.size("expected") > 0, contained).otherwise(refused)
    cited = F.col("n_sources") >= F.greatest(F.lit(1), F.coalesce("min_sources", F.lit(1)))
    return cases.withColumn("cited", F.col("must_cite") & cited).withColumn("passed", right & (~F.col("must_cite") | cited))


def metrics(results: DataFrame) -> DataFrame:
    """Totals, passed, failed and citation rate: overall, per category and per difficulty."""
    spark = results.sparkSession
    from uuid import uuid4

    view = f"results_{uuid4().hex}"
    results.createOrReplaceTempView(view)
    out = spark.sql(
        f"""SELECT category, difficulty, count(*) AS total, sum(CAST(passed AS BIGINT)) AS passed, sum(CAST(NOT passed AS BIGINT)) AS failed,
            round(try_divide(sum(CAST(cited AS BIGINT)), sum(CAST(must_cite AS BIGINT))), 6) AS citation_rate
            FROM {view} GROUP BY GROUPING SETS ((), (category), (difficulty))"""
    )
    return out
