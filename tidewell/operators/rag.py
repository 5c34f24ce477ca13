"""Evidence context, prompts, the deterministic answer provider and the citation critic."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.columns import citations, clamp01, non_empty, occurrences, or_default, preview, sentences, token_count

# The evidence block's labels and the critic's words, which answers and claims are held against.
PREAMBLE = "Answer from the memory records below only. Cite them as [Memory N]. Say so if they are insufficient.\n\n--- EVIDENCE ---\n"
CLOSING = "\n--- END OF EVIDENCE ---"
NO_EVIDENCE = "(No evidence retrieved)"
MODEL = "deterministic-template-v1"


def evidence(hydrated: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` hits of each query that have a canonical row, numbered from 1 (``n``)."""
    order = W.partitionBy("query_id").orderBy("rank")
    return hydrated.where("hydrated").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def evidence_view(rows: DataFrame) -> DataFrame:
    """Evidence as a response shows it: the content as a preview of 300 characters."""
    return rows.select("query_id", "n", "memory_id", "memory_type", "title", preview("content").alias("preview"), "retrieval_source", "score")


def block() -> Column:
    """Text of one evidence row."""
    return F.concat(
        F.lit("[Memory "), F.col("n"), F.lit(": "), F.col("memory_id"), F.lit("]\nType: "), F.col("memory_type"), F.lit(" | Source: "), F.col("retrieval_source"),
        F.lit(" | Confidence: "), F.format_string("%.2f", F.col("confidence").cast("double")), F.lit(" | Importance: "), F.format_string("%.2f", F.col("importance").cast("double")),
        F.lit("\nAsset: "), or_default("asset_id", "N/A"), F.lit(" | Facility: "), or_default("facility_id", "N/A"),
        F.lit("\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\nContent: "), F.coalesce("content", F.lit("")),
    )


def prompts(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, user_prompt, system_prompt, n_evidence, evidence_ids) for every query; at most a few blocks each."""
    blocks = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", block().alias("b"), "memory_id"))).alias("e"))
    joined = queries.select("query_id", "text").join(blocks, "query_id", "left")
    listed = F.coalesce(non_empty(F.array_join(F.col("e.b"), "\n\n")), F.lit(NO_EVIDENCE))
    system = F.concat(F.lit(PREAMBLE), listed, F.lit(CLOSING))
    return joined.select("query_id", F.col("text").alias("user_prompt"), system.alias("system_prompt"), F.coalesce(F.size("e"), F.lit(0)).alias("n_evidence"), F.coalesce("e.memory_id", F.array().cast("array<string>")).alias("evidence_ids"))


def template_answer(prompted: DataFrame) -> DataFrame:
    """Adds answer, model_name, prompt_tokens and completion_tokens of the deterministic provider."""
    count = occurrences("system_prompt", "[Memory") + occurrences("system_prompt", "Memory ID")
    answer = F.concat(F.lit("[SYNTHETIC RESPONSE] Based on "), count, F.lit(" retrieved memory records, this addresses: "), F.substring(F.coalesce("user_prompt", F.lit("")), 1, 200), F.lit("\nFindings are deterministic and derive from the context alone."))
    told = prompted.withColumn("answer", answer).withColumn("model_name", F.lit(MODEL))
    tokens = token_count("system_prompt") + token_count(F.coalesce("user_prompt", F.lit("")))
    return told.withColumn("prompt_tokens", tokens).withColumn("completion_tokens", token_count("answer"))


#: Providers by name: functions of (system, user) text. A deployment adds its own.
PROVIDERS: dict[str, Callable[[str, str], str]] = {"echo": lambda system, user: f"{len(system)}:{(user or '')[:40]}"}


def provider(name: str) -> Callable[[str, str], str]:
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name]


def generate(prompted: DataFrame, provider: Callable[[str, str], str], model: str, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """Adds ``answer`` of any provider, a function of (system, user) text; called in batches on the executors.

    A call that fails gives a null answer and its error; elapsed_ms is the time that the call took by ``clock`` (seconds).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers, errors, took = [], [], []
            for system, user in zip(b["system_prompt"], b["user_prompt"]):
                began = clock()
                try:
                    answers.append(provider(system, user))
                    errors.append(None)
                except Exception as e:  # a provider's fault is a result
                    answers.append(None)
                    errors.append(str(e))
                took.append((clock() - began) * 1000)
            yield b.assign(answer=answers, error=errors, elapsed_ms=took, model_name=model)

    schema = ", ".join(f"{n} {t}" for n, t in prompted.dtypes) + ", answer string, error string, elapsed_ms double, model_name string"
    return prompted.mapInPandas(run, schema)


def verify(answers: DataFrame) -> DataFrame:
    """Critic over (answer, n_evidence): citations valid, supported, confidence and up to five unsupported claims."""
    cited = citations("answer")
    rows = answers.withColumn("cited", cited).withColumn("bad", F.filter("cited", lambda n: (n < 1) | (n > F.col("n_evidence"))))
    none = F.col("n_evidence") == 0
    claims = F.filter(
        sentences("answer"),
        lambda s: (F.length(s) > 30) & ~s.rlike(r"\[Memory\s+\d+\]") & ~F.lower(s).rlike("insufficient|not provided|synthetic|deterministic"),
    )
    n_cited, n_bad = F.size("cited"), F.size("bad")
    confidence = clamp01(F.lit(1.0) - n_bad * 0.3 - F.when(n_cited == 0, 0.2).otherwise(0.0))
    return rows.select(
        *answers.columns,
        F.when(none, F.lit(0)).otherwise(n_cited).alias("n_cited"), F.when(none, F.lit(0)).otherwise(n_bad).alias("n_invalid"),
        (none | (n_bad == 0)).alias("citations_valid"), (~none & (n_bad == 0) & (n_cited > 0)).alias("is_supported"),
        F.when(none, F.lit(0.0)).otherwise(confidence).alias("confidence"),
        F.when(none, F.array().cast("array<string>")).otherwise(F.slice(F.transform(claims, lambda s: F.substring(s, 1, 100)), 1, 5)).alias("unsupported_claims"),
    )
