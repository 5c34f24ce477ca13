"""Language identification of spans in mixed-language text.

Script ranges first: the Unicode block of a word's letters leaves only the languages seen in that script in training.
Those are scored by hashed byte n-grams of the word, and a Viterbi search over the words, with a penalty for each
switch, labels spans; the document's language is the label that covers most letters.

Training adds up n-gram counts of all labelled training documents in a table of fixed width (``BUCKETS`` by language),
so the model has the same size at any scale. A document in which no stretch of words favours another language by more
than the penalty keeps one label; this test is exact, so the search proper runs over the others only.

Defined results: null texts and texts without a letter are ``und`` with score 0; training rows with null text or lang
teach nothing; without any training row every text is ``und``; a repeated row is a row of its own; extra columns,
whatever their names, are ignored, or kept in ``document`` as they came.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import crc_bucket, map_columns, whole

BUCKETS, ORDERS, KEPT_BYTES, LANGUAGES = 1 << 14, (2, 3, 4), 8 << 20, 512
UNKNOWN = "und"
#: First code point of each script range, and its script (fixed values of the Unicode blocks).
SCRIPT_STARTS = [0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xA80, 0xB00, 0xB80, 0xC00, 0xC80, 0xD00, 0xD80, 0xE00, 0xE80, 0xF00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x13A0, 0x1780, 0x1800, 0x1E00, 0x1F00, 0x2000, 0x2E80, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0]
SCRIPTS = ["latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "syriac", "devanagari", "bengali", "gurmukhi", "gujarati", "oriya", "tamil", "telugu", "kannada", "malayalam", "sinhala", "thai", "lao", "tibetan", "burmese", "georgian", "hangul", "ethiopic", "cherokee", "khmer", "mongolian", "latin", "greek", "other", "han", "hiragana", "katakana", "bopomofo", "han", "yi", "hangul", "other"]
NAMES = sorted(set(SCRIPTS))
_SPACES = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def script_of(word: bytes) -> int:
    """Script of the first letter beyond the Latin ranges, else Latin."""
    for c in word.decode("utf-8", "ignore"):
        if ord(c) >= 0x370:
            return NAMES.index(SCRIPTS[bisect_right(SCRIPT_STARTS, ord(c)) - 1])
    return NAMES.index("latin")


def n_letters(word: bytes) -> int:
    return len(word) if word.isascii() else sum(map(str.isalpha, word.decode("utf-8", "ignore")))


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of ASCII letters and non-ASCII characters."""
    return text.lower().encode("utf-8", "replace").translate(_SPACES).split()


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram by order [orders, positions], first position of each word, script of each word)."""
    text = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    padded = np.concatenate([text, np.full(max(ORDERS), 0x20, np.uint64)])
    out = np.empty((len(ORDERS), len(text) - 1), np.int64)
    for row, n in enumerate(ORDERS):
        code = np.zeros(len(text) - 1, np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + padded[k : k + len(text) - 1]
        out[row] = ((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(50)).astype(np.int64)
    top = np.maximum.reduceat(text[1:], starts)
    script = np.full(len(words), NAMES.index("latin"), np.int64)
    for i in np.flatnonzero(top > 0xC9).tolist():
        script[i] = script_of(words[i])
    return out, starts, script


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities [language, orders, bucket] and allowed [script, language], from (text, lang).

    Counts leave a task as at most one row for each language and bucket; the sums collected are of fixed size, and more
    than ``LANGUAGES`` languages are an error.
    """
    if labelled.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")

    def count(batches):
        known: dict[str, dict[bytes, int]] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"]):
                own = known.setdefault(lang, {})
                for w in words_of(text):
                    own[w] = own.get(w, 0) + 1
        for lang, own in known.items():
            if not own:
                continue
            words = list(own)
            weight = np.fromiter(own.values(), np.int64, len(words))
            grams, starts, script = word_features(words)
            each = np.repeat(weight, np.diff(np.append(starts, grams.shape[1])))
            sums = [np.bincount(g, each, BUCKETS) for g in grams] + [np.bincount(script, weight, BUCKETS)]
            flat = np.concatenate(sums).astype(np.int64)
            at = np.flatnonzero(flat)
            yield {"lang": [lang] * len(at), "slot": at.astype(np.int32), "n": flat[at]}

    counts = map_columns(labelled.where("text is not null and lang is not null").select("text", "lang"), "lang string, slot int, n long", count)
    rows = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    table = np.zeros((len(languages), len(ORDERS) + 1, BUCKETS))
    which = rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64) if languages else np.zeros(0, np.int64)
    slot = rows["slot"].to_numpy(np.int64)
    table[which, slot // BUCKETS, slot % BUCKETS] = rows["n"].to_numpy(np.float64)
    grams, scripts = table[:, :-1] + 0.5, table[:, -1, : len(NAMES)]
    logs = np.log(grams / grams.sum(axis=2, keepdims=True)) / len(ORDERS)
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return languages, logs.astype(np.float32), (share > 0.01).T


class Scorer:
    """Scores of distinct words. What a task has scored it keeps, up to ``KEPT_BYTES``; after that it starts anew."""

    def __init__(self, languages: list[str], logs: np.ndarray, allowed: np.ndarray, penalty: float):
        self.languages, self.logs, self.penalty = languages, logs, penalty
        self.barred = np.where(allowed | ~allowed.any(axis=1, keepdims=True), 0.0, -40.0)
        self.ids: dict[bytes, int] = {}
        self.table = np.zeros((1024, len(languages)))
        self.letters = np.zeros(1024, np.int64)

    def code(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Each text as rows of ``table``; a word's number of letters is in ``letters``."""
        if len(self.ids) * (8 * len(self.languages) + 100) > KEPT_BYTES:
            self.ids = {}
        known, ids = len(self.ids), self.ids
        coded = [np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int64, len(ws)) for ws in texts]
        if len(ids) > known:
            new = list(islice(ids, known, None))
            if len(ids) > len(self.table):
                self.table, self.letters = (np.concatenate([x[:known], np.zeros((2 * len(ids) - known, *x.shape[1:]), x.dtype)]) for x in (self.table, self.letters))
            self.table[known : len(ids)] = self.words(new)
            self.letters[known : len(ids)] = list(map(n_letters, new))
        return coded

    def words(self, words: list[bytes]) -> np.ndarray:
        grams, starts, script = word_features(words)
        total = np.zeros((len(words), len(self.languages)))
        for i in range(len(self.languages)):
            per_gram = sum(self.logs[i, row][g] for row, g in enumerate(grams))
            total[:, i] = np.add.reduceat(per_gram, starts)
        return total + self.barred[script]

    def path(self, scores: np.ndarray) -> np.ndarray:
        """Best label of each word when every switch costs ``penalty``."""
        best = int(np.argmax(scores.sum(axis=0)))
        if scores.shape[1] == 1:
            return np.zeros(len(scores), np.int64)
        gain = np.delete(scores, best, axis=1).max(axis=1) - scores[:, best]
        climbed = np.concatenate([[0.0], np.cumsum(gain)])
        if (climbed - np.minimum.accumulate(climbed)).max() <= self.penalty:
            return np.full(len(scores), best)
        n, k = scores.shape
        back = np.empty((n, k), np.int64)
        at, own = scores[0].copy(), np.arange(k)
        for t in range(1, n):
            top = int(at.argmax())
            switch = at[top] - self.penalty
            stay = at >= switch
            back[t] = np.where(stay, own, top)
            at = np.where(stay, at, switch) + scores[t]
        out = np.empty(n, np.int64)
        out[-1] = int(at.argmax())
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], penalty: float = 12.0, keep_all: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, spans for every row; spans: (language, first word, last word).

    ``score`` is the share of letters that carry the document's label. With ``keep_all`` a struct ``document`` of all
    input columns stands in place of doc_id. The model has a fixed size and goes to the tasks with the function.
    """
    languages, logs, allowed = model
    rows = whole(documents).select("document", "document.text") if keep_all else documents.select("doc_id", "text")
    shared = documents.sparkSession.sparkContext.broadcast((languages, logs, allowed))  # languages x 3 x BUCKETS floats

    def label(batches):
        scorer = Scorer(*shared.value, penalty)
        for b in batches:
            out = {"lang_pred": [], "score": [], "spans": []}
            for own in scorer.code([words_of(t) if t and languages and any(map(str.isalpha, t)) else [] for t in b["text"]]):
                if not len(own):
                    out["lang_pred"].append(UNKNOWN), out["score"].append(0.0), out["spans"].append([])
                    continue
                path = scorer.path(scorer.table[own])
                mass = np.bincount(path, scorer.letters[own], len(languages))
                cut = np.flatnonzero(np.diff(path)) + 1
                first, last = np.append(0, cut).tolist(), np.append(cut - 1, len(path) - 1).tolist()
                out["lang_pred"].append(languages[int(mass.argmax())])
                out["score"].append(float(mass.max() / mass.sum()))
                out["spans"].append([{"lang": languages[path[a]], "first": a, "last": z} for a, z in zip(first, last)])
            yield out

    return map_columns(rows, "lang_pred string, score double, spans array<struct<lang:string,first:int,last:int>>", label, keep=(rows.columns[0],))


def train_on(documents: DataFrame):
    """The model learnt from documents whose crc32 of the id modulo 5 isn't 0."""
    return train(documents.where(crc_bucket("doc_id", 5) != 0))


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train_on(docs)).select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
