"""Retrieval and answer metrics, and their aggregates over a run."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import citations, sentences
from tidewell.session import settle


def recall_at_k(retrieved: Column | str, expected: Column | str, k: int = 5) -> Column:
    """Share of ``expected`` (repeats count) among the first ``k``; 1 if nothing is expected."""
    r, e = (F.col(c) if isinstance(c, str) else c for c in (retrieved, expected))
    top = F.slice(r, 1, k)
    return F.when(F.size(e) == 0, F.lit(1.0)).otherwise(F.size(F.filter(e, lambda x: F.array_contains(top, x))) / F.size(e))


def reciprocal_rank(retrieved: Column | str, expected: Column | str) -> Column:
    """1 / place of the first expected id in the whole list, else 0."""
    r, e = (F.col(c) if isinstance(c, str) else c for c in (retrieved, expected))
    places = F.filter(F.transform(r, lambda x, i: F.when(F.array_contains(e, x), i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(places) > 0, F.lit(1.0) / F.try_element_at(places, F.lit(1))).otherwise(F.lit(0.0))


def groundedness(answer: Column | str) -> Column:
    """Share of the sentences over 30 characters that cite a memory; 1 if there are none."""
    told = F.filter(sentences(answer), lambda s: F.length(s) > 30)
    return F.when(F.size(told) == 0, F.lit(1.0)).otherwise(F.size(F.filter(told, lambda s: s.rlike(r"\[Memory\s+\d+\]"))) / F.size(told))


def citation_accuracy(answer: Column | str, evidence_count: Column | str) -> Column:
    """Share of citations that point into the evidence; 1 without evidence or citations."""
    n = F.col(evidence_count) if isinstance(evidence_count, str) else evidence_count
    cited = citations(answer)
    return F.when((n == 0) | (F.size(cited) == 0), F.lit(1.0)).otherwise(F.size(F.filter(cited, lambda c: (c >= 1) & (c <= n))) / F.size(cited))


def measured(found: DataFrame, asked: DataFrame) -> DataFrame:
    """``found``, retrieved here and now, with ``retrieval_ms``: the time this took, shared among the queries ``asked``.

    A retrieval answers all its queries in one plan, so a query's own time isn't defined; its share is.
    """
    n, began = asked.count(), time.perf_counter()
    out = settle(found)
    return out.withColumn("retrieval_ms", F.lit((time.perf_counter() - began) * 1000 / max(n, 1)))


def evaluate(cases: DataFrame, k: int = 5) -> DataFrame:
    """Metrics of cases (case_id, mode, answer, retrieved, expected, error or null), success and failure category."""
    failed = F.col("error").isNotNull()
    scored = cases.select(
        "case_id", "mode", *[c for c in ("latency_ms",) if c in cases.columns],
        *[F.when(failed, F.lit(0.0)).otherwise(m).alias(n) for n, m in (
            ("recall", recall_at_k("retrieved", "expected", k)), ("mrr", reciprocal_rank("retrieved", "expected")),
            ("groundedness", groundedness("answer")), ("citation_accuracy", citation_accuracy("answer", F.size("retrieved"))),
        )],
        (~failed & (F.size("expected") == 0)).alias("_open"), failed.alias("_failed"),
    )
    success = ~F.col("_failed") & ((F.col("recall") > 0) | F.col("_open"))
    category = F.when(success, "no_failure").when(F.col("_failed"), "provider_failure").otherwise("retrieval_failure")
    return scored.select("case_id", "mode", *[c for c in ("latency_ms",) if c in cases.columns], "recall", "mrr", "groundedness", "citation_accuracy", success.alias("success"), category.alias("failure_category"))


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Totals, means and success rate, and the mean latency if it was measured; zeros for an empty run."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}")
    total, failed = F.count("*"), F.count_if(~F.col("success"))
    rate = F.when(total == 0, F.lit(0.0)).otherwise(F.lit(1.0) - failed / total)
    return results.groupBy(*by).agg(total.alias("total_cases"), failed.alias("failed_cases"), rate.alias("success_rate"), mean("recall"), mean("mrr"), mean("groundedness"), mean("citation_accuracy"), *[mean(c) for c in ("latency_ms",) if c in results.columns])


def taxonomy(results: DataFrame) -> DataFrame:
    return results.groupBy("failure_category").agg(F.count("*").alias("n"))
