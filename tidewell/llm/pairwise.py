"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a linear function of its features, and P(a is preferred to b) = sigmoid(strength a - strength b).
Preference pairs are a row of label 1 over a row of label 0. Labelled rows are dealt at random, by a hash, into blocks
that lie sorted in a table; within a block each row of the larger label meets ``ROUNDS`` rows of the other one, by cyclic
shifts, so the number of pairs is linear in the rows. The logistic loss over feature differences, with an L2 penalty, is
minimised with L-BFGS: each step is a Spark job that sums gradients over the blocks. Pairs exist only as two index arrays.

The threshold is the quantile of all training strengths at the share of label 0, halfway to the next strength; ranges of
strengths are counted by Spark, and the one that holds the quantile is cut again until it is one strength. Scores are
sigmoid(strength - threshold), so 0.5 is the threshold.

The fit and the threshold take every labelled document; labels meet documents ``LABELS`` ids at a time, so that texts aren't
shuffled. Every text is scored, and always whole. Features come from the bytes alone: shares of pairs of byte classes and of hashed
byte trigrams, and statistics of words, lines and repetition. They have a fixed number, whatever the text's length.

Defined results: null texts are empty ones, and empty texts get the score of their (zero) features; without any pair all
scores are equal: those of texts are 0.5 without labels or with label 1 alone, below 0.5 with label 0 alone; a repeated
document is a row of its own, a repeated label counts once, and an id with both labels teaches both; labels of null are left out; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import crc_bucket, map_columns, materialize, pieces

LABELS, BLOCK_ROWS, ROUNDS, PENALTY, STEPS, CUTS = 1 << 19, 2048, 4, 3e-4, 40, 4096
PIECE, TRIGRAMS = 1 << 20, 256
FEW_BYTES, FEW_WORDS = 32, 4  # added to what shares divide by: a text of a word or two says little
_GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:!?", b"\"'()[]{}<>", b"-_/\\@^~`+=", b"#$%&*|", b"\t\x0b\x0c\r")
N_CLASSES = len(_GROUPS) + 2  # bytes from 0x80 on, and what is left
CLASS = np.full(256, N_CLASSES - 1, np.uint8)
CLASS[128:] = N_CLASSES - 2
for _i, _group in enumerate(_GROUPS):
    CLASS[list(_group)] = _i
FOLD = np.arange(256, dtype=np.uint32)
FOLD[0x41:0x5B] += 32
STATISTICS = ("log_bytes", "log_words", "word_length", "distinct_words", "top_word", "word_repeats", "short_words", "capitalised", "all_capitals", "long_words", "words_a_line", "distinct_lines", "stops_a_word", "letters")
WIDTH = N_CLASSES**2 + TRIGRAMS + len(STATISTICS)


def _shares(data: bytes) -> np.ndarray:
    """Square roots of the shares of class pairs and of hashed trigrams."""
    pairs, grams = np.zeros(N_CLASSES**2), np.zeros(TRIGRAMS)
    for at in range(0, len(data), PIECE):
        raw = np.frombuffer(data[at : at + PIECE + 2], np.uint8)
        codes = CLASS[raw[: PIECE + 1]]
        pairs += np.bincount(codes[:-1].astype(np.int16) * N_CLASSES + codes[1:], minlength=N_CLASSES**2)
        low = FOLD[raw]
        mixed = ((low[:-2] * np.uint32(65599) + low[1:-1]) * np.uint32(65599) + low[2:]) * np.uint32(0x9E3779B1) >> np.uint32(24)
        grams += np.bincount(mixed, minlength=TRIGRAMS)
    return np.sqrt(np.concatenate([pairs / (pairs.sum() + FEW_BYTES), grams / (grams.sum() + FEW_BYTES)]))


def _statistics(text: str, data: bytes) -> list[float]:
    words: Counter = Counter()
    lines: Counter = Counter()
    repeats, last = 0, None
    for piece in pieces(text):
        own = piece.encode("utf-8", "replace").split()
        words.update(own)
        repeats += sum(a == b for a, b in zip(own, own[1:])) + bool(own and own[0] == last)
        last = own[-1] if own else last
        lines.update(x for x in piece.split("\n") if x.strip())
    n, n_lines = words.total() + FEW_WORDS, max(lines.total(), 1)
    share = lambda keep: sum(k for w, k in words.items() if keep(w)) / n
    letters = sum(map(len, words)) and len(data) - len(data.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [
        math.log1p(len(data)), math.log1p(words.total()), math.log1p(sum(len(w) * k for w, k in words.items()) / n), len(words) / n, max(words.values(), default=0) / n, repeats / n,
        share(lambda w: len(w) < 2), share(lambda w: w[:1].isupper()), share(bytes.isupper), share(lambda w: len(w) > 20), math.log1p(n / n_lines), len(lines) / n_lines,
        sum(data.count(c) for c in (b".", b"!", b"?")) / n, letters / max(len(data), 1),
    ]


def features(text: str | None) -> np.ndarray:
    """``WIDTH`` numbers; all zero for null and empty texts."""
    if not text:
        return np.zeros(WIDTH, np.float32)
    data = text.encode("utf-8", "replace")
    return np.concatenate([_shares(data), _statistics(text, data)]).astype(np.float32)


def labelled_rows(documents: DataFrame, labels: DataFrame, sample: int | None = None) -> DataFrame:
    """(y, weight, x) of the training rows, dealt into blocks by a hash and sorted by it; written once.

    All labelled documents; those of about ``sample`` ids of each label, weighed by that, if it is given.
    """
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit("pairs"))
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").alias("y")).distinct()
    counts = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, 0.98 * sample / n) if sample else 1.0 for y, n in counts.items()}  # a hash keeps about that share
    chosen, by = marked, lambda word: F.xxhash64(F.col("doc_id").cast("string"), F.lit(word))
    if min(share.values(), default=1.0) < 1:
        chosen = marked.where(reduce(or_, [(F.col("y") == y) & (F.pmod(by("sample"), F.lit(1 << 30)) < int(s * (1 << 30))) for y, s in share.items()]))
    parts = max(1, math.ceil(sum(n * share[y] for y, n in counts.items()) / LABELS))
    texts = documents.select("doc_id", "text")
    met = [texts.join(F.broadcast(chosen.where(F.pmod(by("part"), F.lit(parts)) == p)), "doc_id") for p in range(parts)]  # about LABELS ids each
    rows = reduce(DataFrame.union, met).select("y", key.alias("h"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"), "text")
    weight = F.element_at(F.create_map(*[F.lit(v) for y, s in share.items() for v in (y, 1.0 / s)]), F.col("y")) if share else F.lit(1.0)

    def run(batches):
        for b in batches:
            yield {"x": [features(t) for t in b["text"]]}

    made = map_columns(rows, "x array<float>", run, keep=("y", "h", "c"))
    blocks = max(1, math.ceil(sum(n * share[y] for y, n in counts.items()) / BLOCK_ROWS))
    dealt = made.repartition(blocks, F.pmod("h", F.lit(1 << 20))).sortWithinPartitions("h", "c", "y")
    return materialize(dealt.select("y", weight.cast("double").alias("weight"), "x"), "labelled")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(np.float64)


def _summed(rows: DataFrame, function, width: int) -> np.ndarray:
    """Sum over the blocks of what ``function`` (y, X) -> vector gives; a task sends one row."""

    def run(batches):
        total = np.zeros(width)
        for b in batches:
            total += function(b["y"].to_numpy(zero_copy_only=False), _matrix(b["x"]))
        yield {"v": [total]}

    parts = map_columns(rows.select("y", "x"), "v array<double>", run, arrow=("y", "x"), slice_bytes=BLOCK_ROWS * WIDTH * 4).toArrow()["v"]
    return np.sum([np.asarray(v.as_py()) for v in parts], axis=0) if len(parts) else np.zeros(width)


def pair_indices(y: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(winner, loser) rows of a block's pairs."""
    winners, losers = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(winners) or not len(losers):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = max(len(winners), len(losers))
    i = np.tile(np.arange(n), rounds)
    shift = np.repeat(np.arange(rounds), n) * max(1, min(len(winners), len(losers)) // rounds)
    many, few = (winners, losers) if len(winners) >= len(losers) else (losers, winners)
    a, b = many[i], few[(i + shift) % len(few)]
    return (a, b) if many is winners else (b, a)


def pair_loss(w: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Gradient of the logistic loss over a block's pairs, then the loss and the number of pairs."""
    a, b = pair_indices(y)
    if not len(a):
        return np.zeros(len(w) + 2)
    s = x @ w
    d = s[a] - s[b]
    p = np.exp(-np.logaddexp(0, d))  # of the other one's being preferred
    pull = np.bincount(b, p, len(y)) - np.bincount(a, p, len(y))
    return np.concatenate([x.T @ pull, [np.logaddexp(0, -d).sum(), len(a)]])


def minimise(value, w: np.ndarray, steps: int = STEPS, memory: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """L-BFGS with a halving line search; ``value``: w -> (loss, gradient)."""
    loss, grad = value(w)
    past: list[tuple] = []
    for _ in range(steps):
        q = grad.copy()
        alphas = []
        for s, t in reversed(past):
            alphas.append(s @ q / (s @ t))
            q -= alphas[-1] * t
        if past:
            q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (s, t), alpha in zip(past, reversed(alphas)):
            q += (alpha - t @ q / (s @ t)) * s
        size = 1.0 if past else min(1.0, 1.0 / max(np.linalg.norm(grad), 1e-12))
        for _ in range(12):
            new, (new_loss, new_grad) = w - size * q, value(w - size * q)
            if new_loss <= loss - 1e-4 * size * (grad @ q):
                break
            size /= 2
        else:
            break
        if (step := (new - w) @ (new_grad - grad)) > 1e-12:
            past = [*past[1 - memory :], (new - w, new_grad - grad)] if len(past) >= memory else [*past, (new - w, new_grad - grad)]
        small = loss - new_loss <= tolerance * max(loss, 1e-9) and step >= 0
        w, loss, grad = new, new_loss, new_grad
        if small:
            break
    return w


def quantile_threshold(strength: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The strength below which the share of label 0 lies, halfway to the next one."""
    if not len(y) or not (y == 0).any():
        return float(strength.min()) if len(y) else 0.0
    order = np.argsort(strength, kind="stable")
    below = np.cumsum(weight[order])
    at = int(np.searchsorted(below, weight[y == 0].sum() * (1 - 1e-9)))
    own = strength[order[min(at, len(order) - 1)]]
    above = strength[strength > own]
    return float((own + above.min()) / 2) if len(above) else float(own) + 1.0


def table_threshold(rows: DataFrame) -> float:
    """``quantile_threshold`` of a table (s, y, weight) of any size: each pass counts ``CUTS`` ranges and goes on in one of them."""
    zero = F.sum(F.when(F.col("y") == 0, F.col("weight")))
    low, high, wanted = rows.agg(F.min("s"), F.max("s"), zero).first()
    if wanted is None:
        return 0.0 if low is None else float(low)
    wanted *= 1 - 1e-9
    while low < high:
        part = F.least(F.floor((F.col("s") - low) / (high - low) * CUTS), F.lit(CUTS - 1))
        cuts = rows.where(F.col("s").between(low, high)).groupBy(part.alias("part")).agg(F.sum("weight").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("part").collect()
        for cut in cuts[:-1]:
            if cut.n >= wanted:
                break
            wanted -= cut.n
        else:
            cut = cuts[-1]
        low, high = cut.low, cut.high
    above = rows.where(F.col("s") > low).agg(F.min("s")).first()[0]
    return float(low) + 1.0 if above is None else float((low + above) / 2)


def fit(documents: DataFrame, labels: DataFrame, sample: int | None = None, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """(weights, threshold): strength is features @ weights."""
    rows = labelled_rows(documents, labels, sample)
    moments = _summed(rows, lambda y, x: np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(y)]]), 2 * WIDTH + 1)
    n = max(moments[-1], 1)
    mean = moments[:WIDTH] / n
    scale = 1 / (np.sqrt(np.maximum(moments[WIDTH:-1] / n - mean * mean, 0)) + 0.02)  # rare features stay small

    def value(v):
        out = _summed(rows, lambda y, x, w=v * scale: pair_loss(w, y, x), WIDTH + 2)
        pairs = max(out[-1], 1)
        return out[-2] / pairs + penalty * (v @ v) / 2, out[:-2] * scale / pairs + penalty * v

    w = minimise(value, np.zeros(WIDTH)) * scale
    strengths = map_columns(rows, "s double", lambda batches: ({"s": _matrix(b["x"]) @ w} for b in batches), keep=("y", "weight"), arrow=("x",))
    return w, table_threshold(materialize(strengths, "strengths"))


def score(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score, predicted) of every row; the model has ``WIDTH`` numbers and goes with the function."""
    w, threshold = model

    def run(batches):
        for b in batches:
            s = np.array([features(t).astype(np.float64) @ w for t in b["text"]]) - threshold
            p = np.exp(-np.logaddexp(0, -s))
            yield {"score": p, "predicted": (s >= 0).astype(np.int32)}

    return map_columns(documents.select("doc_id", "text"), "score double, predicted int", run, keep=("doc_id",))


def op11_pairwise(spark, sf_dir: str) -> DataFrame:
    docs, held_out = spark.read.parquet(f"{sf_dir}/documents.parquet"), crc_bucket("doc_id", 3) == 1
    model = fit(docs.where(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
