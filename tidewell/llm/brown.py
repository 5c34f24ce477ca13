"""LM scoring with a Brown class-based bigram model whose classes come from exchange clustering.

P(w | before) = P(class(w) | class(before)) * P(w | class(w)), both smoothed so that they sum to one with one unseen
word left over in each class.

*Items* are what the repeated exchange moves: the most frequent words one by one (at most ``exchange_words``) and, for all
other words, one item for each of ``units`` hashed word endings. Every training token is part of the item bigram counts,
which are summed over the whole training corpus in one shuffle. An exchange sweep gets each item's counts by class of its
neighbours from those bigrams (joined with the item-to-class map, a table of bounded size), deals the items into
groups, and in each group moves items one after the other to the class that raises the class-bigram likelihood most,
given the other groups' assignment -- the usual distributed exchange. Half of the items may move in a sweep. A sweep that
lowers the likelihood, since too many moved at once, is taken back, and from then on half as many may move; so the
likelihood never falls. Sweeps go on until a round of them gains less than ``GAIN`` of it.

*All other words*, however many, are then moved one by one from their ending's class to the class that their own
neighbours favour, by the same gain: one pass gathers each word's counts by class of its neighbours and deals them by
word, and tasks move the words a few at a time. The class bigrams are then counted under the final classes; a bigram of
two such words counts by the shares that the classes have in their endings.

Words are known by their 64-bit hash. Counts and classes of the ``head_words`` most frequent ones travel with the scoring
tasks; rarer words leave the scoring pass as rows with their neighbours' classes and get their own by a join.

Defined results: null and empty texts consist of the end token only; without training rows every count is 0; a word that
training lacks has its ending's class; words with equal counts at a cut are on the same side of it; repeated rows are
scored and counted as rows of their own; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import crc_bucket, discard, map_columns, materialize

LOG_BINS, TOP_BIN, GAIN, ENTRIES, SLICE, FEW = 8, 512, 2e-3, 1 << 14, 2 << 20, 8
#: Spark sends texts to Python in batches of so many bytes; its own default, 64 MB, is held on both sides by every task.
BATCH, _BYTES = 15 << 18, "spark.sql.execution.arrow.maxBytesPerBatch"


class _Coder:
    """Codes the words of a batch; hashes and endings are computed once for each distinct word."""

    def __init__(self, units: int):
        self.units = units

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(codes of all tokens, tokens of each text, hash of each code, ending of each code).

        Tokens are words between ASCII white space, A-Z lower-cased; the end token is added by the callers.
        """
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        codes, parents = coded.indices.to_numpy().astype(np.int64), pc.list_parent_indices(split).to_numpy()
        digest = xxhash.xxh64_intdigest
        if b"" in words:  # from white space at a text's ends
            empty = words.index(b"")
            codes, parents = codes[codes != empty], parents[codes != empty]
        hashes = np.fromiter(map(digest, words), np.uint64, len(words)).view(np.int64)
        endings = np.fromiter((digest(w[-3:]) % self.units for w in words), np.int64, len(words))
        return codes, np.bincount(parents, minlength=len(texts)), hashes, endings


def _settled(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` with batches of ``BATCH`` bytes."""
    conf = df.sparkSession.conf
    before = conf.get(_BYTES)
    conf.set(_BYTES, str(BATCH))
    try:
        return materialize(df, name)
    finally:
        conf.set(_BYTES, before)


def word_counts(texts: DataFrame, units: int) -> DataFrame:
    """(h, unit, n) of every distinct word."""

    def run(batches):
        coder = _Coder(units)
        for b in batches:
            codes, _, hashes, endings = coder.batch(b["text"])
            n = np.bincount(codes, minlength=len(hashes))
            yield {"h": hashes[n > 0], "unit": endings[n > 0].astype(np.int32), "n": n[n > 0]}

    return map_columns(texts.select("text"), "h long, unit int, n long", run, arrow=("text",)).groupBy("h", "unit").agg(F.sum("n").alias("n"))


def frequent(vocabulary: DataFrame, most: int) -> pd.DataFrame:
    """The words with at least some count, chosen so that there are at most ``most``; sorted by hash.

    The cut comes from a histogram of counts on a log scale (at most ``TOP_BIN`` rows), so nothing larger than the
    bounded result is collected or sorted.
    """
    binned = vocabulary.withColumn("bin", F.least(F.lit(TOP_BIN), F.floor(F.log2("n") * LOG_BINS)).cast("int"))
    sizes = sorted(((r.bin, r["count"]) for r in binned.groupBy("bin").count().collect()), reverse=True)
    total, cut = 0, None
    for b, k in sizes:
        if total + k > most:
            break
        total, cut = total + k, b
    if cut is None:
        return pd.DataFrame({"h": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    return binned.where(F.col("bin") >= cut).select("h", "n").toPandas().sort_values("h", ignore_index=True)


def _find(sorted_hashes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted list, or -1."""
    if not len(sorted_hashes):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == hashes, at, -1)


def item_bigrams(texts: DataFrame, movers: np.ndarray, units: int) -> DataFrame:
    """(a, b, n) over items; item 0 is the text boundary, 1..k the frequent words, the rest word endings."""
    shared = texts.sparkSession.sparkContext.broadcast(movers)  # at most exchange_words numbers
    items = 1 + len(movers) + units

    def run(batches):
        coder = _Coder(units)
        for b in batches:
            codes, sizes, hashes, endings = coder.batch(b["text"])
            place = _find(shared.value, hashes)
            item = np.where(place >= 0, 1 + place, 1 + len(movers) + endings)
            line, _ = _line(item[codes], sizes)
            pair, n = np.unique(line[:-1] * items + line[1:], return_counts=True)
            yield {"a": (pair // items).astype(np.int32), "b": (pair % items).astype(np.int32), "n": n}

    return map_columns(texts.select("text"), "a int, b int, n long", run, arrow=("text",)).groupBy("a", "b").agg(F.sum("n").alias("n"))


def class_counts(bigrams: DataFrame, assigned: DataFrame, classes: int) -> np.ndarray:
    """Class bigram counts; classes x classes cells at most."""
    left, right = (F.broadcast(assigned.select(F.col("item").alias(k), F.col("cls").alias(f"c{k}"))) for k in "ab")
    rows = bigrams.join(left, "a").join(right, "b").groupBy("ca", "cb").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((classes, classes))
    for r in rows:
        out[r.ca, r.cb] = r.n
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange_group(left: np.ndarray, right: np.ndarray, self_loop: np.ndarray, start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Moves items one by one to their best class. ``left[i, c]``: count of item i after class c, ``right`` before c.

    The likelihood of a class bigram model is sum N(c,d) log N(c,d) - 2 sum N(c) log N(c), up to terms that don't
    depend on the classes. An item is taken out of its class, every class is tried, and counts are updated at once.
    Class 0, the text boundary, takes part in no move.
    """
    k = len(counts)
    counts, start = counts.copy(), start.copy()
    for i in np.argsort(-(left.sum(axis=1)), kind="stable"):
        l, r, s = left[i].copy(), right[i].copy(), self_loop[i]
        own = start[i]
        total = l.sum()
        if total == 0:
            continue
        l[own] -= s  # neighbours that are the item itself move with it
        r[own] -= s
        base = counts.copy()
        base[:, own] -= l
        base[own, :] -= r
        base[own, own] -= s
        np.maximum(base, 0, out=base)
        # gain of putting the item into class c: the cells of row c and column c that grow
        f = _xlogx(base)
        into_column = (_xlogx(base + l[:, None]) - f).sum(axis=0)  # cell (d, c) grows by l[d]
        into_row = (_xlogx(base + r[None, :]) - f).sum(axis=1)  # cell (c, d) grows by r[d]
        diagonal = np.diag(base)
        both = _xlogx(diagonal + l + r + s) - _xlogx(diagonal + l) - _xlogx(diagonal + r) + _xlogx(diagonal)
        size = base.sum(axis=1) + l  # a class keeps its transitions to the item, wherever that goes
        gain = into_column + into_row + both - 2 * (_xlogx(size + total) - _xlogx(size))
        gain[0] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= gain[own]:
            best = own
        base[:, best] += l
        base[best, :] += r
        base[best, best] += s
        counts, start[i] = base, best
    return start


def likelihood(counts: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, up to terms that don't depend on the classes."""
    return float(_xlogx(counts).sum() - _xlogx(counts.sum(axis=0)).sum() - _xlogx(counts.sum(axis=1)).sum())


def _assigned(spark, cls: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"item": np.arange(len(cls), dtype=np.int32), "cls": cls.astype(np.int32)}))


def exchange(bigrams: DataFrame, classes: int, sweeps: int, start: np.ndarray, groups: int = 12) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of every item, class bigram counts, likelihood before the first sweep and after each one that counts);
    class 0 is the boundary's."""
    spark = bigrams.sparkSession
    cls, best, told = start.copy(), None, []
    parts, since = 2, 0  # an item in ``parts`` moves in a sweep, so that many sweeps are a round; ``since``: where the first round began
    for sweep in range(sweeps + 1):
        assigned = _assigned(spark, cls)
        counts = class_counts(bigrams, assigned, classes)
        now = likelihood(counts)
        if best is not None and now < told[-1]:
            cls, counts = best[0].copy(), best[1]
            parts, since, assigned = 2 * parts, len(told) - 1, _assigned(spark, cls)
        else:
            told.append(now)
            best = (cls.copy(), counts)
        round_ago = told[-1 - parts] if len(told) - 1 - parts >= since else None
        if sweep == sweeps or (round_ago is not None and now - round_ago < GAIN * abs(round_ago)):
            return best[0], best[1], told
        of_a, of_b = (F.broadcast(assigned.withColumnRenamed("item", k)) for k in "ab")
        after = bigrams.join(of_a, "a").groupBy(F.col("b").alias("item"), "cls").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("own")).withColumn("side", F.lit(0))
        before = bigrams.join(of_b, "b").groupBy(F.col("a").alias("item"), "cls").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("own")).withColumn("side", F.lit(1))
        moving = after.union(before).where((F.col("item") > 0) & (F.pmod(F.xxhash64("item"), F.lit(parts)) == sweep % parts))
        held = cls.copy()

        def move(rows: pd.DataFrame) -> pd.DataFrame:  # at most items / groups items, each with 2 * classes counts
            ids, at = np.unique(rows["item"].to_numpy(np.int64), return_inverse=True)
            sides = np.zeros((2, len(ids), classes))
            np.add.at(sides, (rows["side"].to_numpy(np.int64), at, rows["cls"].to_numpy(np.int64)), rows["n"].to_numpy(np.float64))
            loops = np.zeros(len(ids))
            np.add.at(loops, at, rows["own"].to_numpy(np.float64))
            new = exchange_group(sides[0], sides[1], loops, held[ids], counts)
            return pd.DataFrame({"item": ids.astype(np.int32), "cls": new.astype(np.int32)})

        moved = moving.groupBy(F.pmod(F.xxhash64("item", F.lit(sweep)), F.lit(groups)).alias("g")).applyInPandas(move, "item int, cls int").toPandas()
        cls[moved["item"].to_numpy(np.int64)] = moved["cls"].to_numpy(np.int64)


def best_classes(word: np.ndarray, slot: np.ndarray, n: np.ndarray, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Class of each word that raises the likelihood most when the word is taken out of class ``own`` and put there.

    ``word``: which word an entry belongs to, sorted; ``slot``: 2 * class of a neighbour, and 1 more if it follows.
    To name another class than its ending's costs log(classes), so it has to gain more than that.
    """
    k = len(counts)
    side, d = slot % 2, slot // 2
    cells = np.concatenate([counts, counts.T])  # (neighbour, c) or (c, neighbour)
    plain = _xlogx(cells)
    few = np.stack([_xlogx(cells + m) - plain for m in range(1, FEW + 1)])  # most entries count a few only
    grown = np.zeros((len(own), k))
    step = 1 << 12  # entries at a time
    for at in range(0, len(word), step):
        e = slice(at, at + step)
        cell, times, mine = d[e] + k * side[e], n[e], own[word[e]]
        more = few[np.minimum(times, FEW).astype(np.int64) - 1, cell]
        many = np.flatnonzero(times > FEW)
        more[many] = _xlogx(cells[cell[many]] + times[many, None]) - plain[cell[many]]
        here = cells[cell, mine]
        more[np.arange(len(cell)), mine] = _xlogx(here) - _xlogx(np.maximum(here - times, 0))
        first = np.flatnonzero(np.append(True, word[e][1:] != word[e][:-1]))
        grown[word[e][first]] += np.add.reduceat(more, first, axis=0)
    total, rows = np.bincount(word[side == 0], n[side == 0], len(own)), np.arange(len(own))
    size = counts.sum(axis=1)
    gain = _xlogx(size[None, :] + total[:, None]) - _xlogx(size)[None, :]
    gain[rows, own] = _xlogx(size[own]) - _xlogx(np.maximum(size[own] - total, 0))
    gain = grown - 2 * gain
    gain[:, 0] = -np.inf
    best = gain.argmax(axis=1)
    return np.where(gain[rows, best] > gain[rows, own] + np.log(k), best, own)


def other_words(texts: DataFrame, movers: np.ndarray, cls: np.ndarray, counts: np.ndarray, units: int) -> tuple[DataFrame, np.ndarray]:
    """(h, cls) of all words that are no movers, and the final counts of bigrams of such a word and a mover.

    One pass over the texts gives each such word's contexts: the classes before and after it, where a neighbour of the
    same kind stands with its ending's class, k higher. Words are moved where their contexts meet, a few at a time.
    """
    spark, k = texts.sparkSession, len(counts)
    shared = spark.sparkContext.broadcast((movers, cls))  # at most exchange_words + units numbers

    def gather(batches):
        movers, cls = shared.value
        coder = _Coder(units)
        for b in batches:
            codes, sizes, hashes, endings = coder.batch(b["text"])
            if not len(codes):
                continue
            place = _find(movers, hashes)
            of = np.where(place >= 0, cls[1 + np.maximum(place, 0)], k + cls[1 + len(movers) + endings])
            line, inside = _line(of[codes], sizes)
            other = place[codes] < 0
            at, who = np.flatnonzero(inside)[other], codes[other]
            key, n = np.unique((who * (2 * k) + line[at - 1]) * (2 * k) + line[at + 1], return_counts=True)
            code = key // (4 * k * k)
            yield {"h": hashes[code], "context": ((of[code] - k) * (4 * k * k) + key % (4 * k * k)).astype(np.int32), "n": n}

    def move(batches):
        """Rows come sorted by word; a word's are held together and summed by context, 4 * classes^2 of them at most."""
        found, held, size = np.zeros((k, k), np.int64), [], 0

        def settle(h, context, n):
            words, first, word = np.unique(h, return_index=True, return_inverse=True)
            left, right, own = context // (2 * k) % (2 * k), context % (2 * k), (context // (4 * k * k))[first]
            slot, at = np.unique(np.concatenate([word, word]) * (2 * k) + np.concatenate([2 * (left % k), 2 * (right % k) + 1]), return_inverse=True)
            new = best_classes(slot // (2 * k), slot % (2 * k), np.bincount(at, np.concatenate([n, n])), own, counts)
            for side, cell in ((left, (left, new[word])), (right, (new[word], right))):
                mover = side < k
                np.add.at(found, tuple(x[mover] for x in cell), n[mover])
            empty = pa.nulls(len(words), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(new.astype(np.int32)), empty, empty, pa.nulls(len(words), pa.int64())], names=["h", "cls", "a", "b", "n"])

        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "context", "n")]
            held.append(rows)
            size += len(rows[0])
            if size >= ENTRIES:
                all_rows = [np.concatenate(x) for x in zip(*held)]
                whole_words = np.searchsorted(all_rows[0], all_rows[0][-1])  # the last word may go on
                held, size = [[x[whole_words:] for x in all_rows]], size - whole_words
                if not whole_words:
                    context, at = np.unique(held[0][1], return_inverse=True)
                    held = [[np.full(len(context), held[0][0][0]), context, np.bincount(at, held[0][2]).astype(np.int64)]]
                    size = 0  # counts what has come since
                else:
                    yield settle(*[x[:whole_words] for x in all_rows])
        if size:
            yield settle(*[np.concatenate(x) for x in zip(*held)])
        a, b = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(found[a, b])], names=["h", "cls", "a", "b", "n"])

    contexts = map_columns(texts.select("text"), "h long, context int, n long", gather, arrow=("text",), slice_bytes=SLICE)
    dealt = contexts.repartition("h").sortWithinPartitions("h")
    moved = _settled(dealt.mapInArrow(move, "h long, cls int, a int, b int, n long"), "moved")
    beside = np.zeros((k, k))
    for r in moved.where("a is not null").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # classes^2 rows at most
        beside[r.a, r.b] = r.n
    return moved.where("h is not null").select("h", "cls"), beside


def final_counts(bigrams: DataFrame, words: DataFrame, movers: int, units: int, cls: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Class bigram counts under the final classes.

    Movers among themselves count by their classes, and movers beside other words are given. Two other words count by
    the shares that the classes have in the tokens of either ending.
    """
    k = len(beside)
    settled = bigrams.sparkSession.createDataFrame(pd.DataFrame({"item": np.arange(1 + movers, dtype=np.int32), "cls": cls[: 1 + movers].astype(np.int32)}))
    counts = beside + class_counts(bigrams.where((F.col("a") <= movers) & (F.col("b") <= movers)), settled, k)
    share = np.zeros((units, k))
    for r in words.where("not mover").groupBy("unit", "cls").agg(F.sum("n").alias("n")).collect():  # units * classes rows at most
        share[r.unit, r.cls] = r.n
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1)
    pairs = bigrams.where((F.col("a") > movers) & (F.col("b") > movers)).toPandas()  # units^2 rows at most
    both = np.zeros((units, units))
    both[pairs["a"].to_numpy(np.int64) - 1 - movers, pairs["b"].to_numpy(np.int64) - 1 - movers] = pairs["n"].to_numpy(np.float64)
    return counts + share.T @ both @ share


def _line(of: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens with a boundary (0) before, between and after the texts; and which places are tokens."""
    line = np.zeros(len(of) + len(sizes) + 1, np.int64)
    inside = np.ones(len(line), bool)
    inside[np.concatenate([[0], np.cumsum(sizes + 1)])] = False
    line[inside] = of
    return line, inside


def fit(training: DataFrame, classes: int = 64, exchange_words: int = 8192, units: int = 1024, head_words: int = 262144, sweeps: int = 8) -> dict:
    """Counts and classes learnt from column ``text``; only tables of bounded size reach the driver."""
    spark = training.sparkSession
    texts = training.select("text")
    vocabulary = _settled(word_counts(texts, units), "vocabulary")
    ends = texts.count()
    head = frequent(vocabulary, head_words)
    by_count = np.sort(head["n"].to_numpy())[::-1]
    cut = by_count[exchange_words] if len(by_count) > exchange_words else 0
    chosen = head.loc[head["n"] > cut]
    movers = chosen["h"].to_numpy(np.int64)
    bigrams = _settled(item_bigrams(texts, movers, units), "bigrams")
    rank = np.empty(len(movers), np.int64)  # words of similar frequency start in different classes
    rank[np.argsort(-chosen["n"].to_numpy(), kind="stable")] = np.arange(len(movers))
    start = np.concatenate([[0], 1 + rank % (classes - 1), 1 + np.arange(units) % (classes - 1)]).astype(np.int64)
    cls, counts, told = exchange(bigrams, classes, sweeps, start)
    tail, beside = other_words(texts, movers, cls, counts, units)
    mover_classes = spark.createDataFrame(pd.DataFrame({"h": movers, "moved": cls[1 : 1 + len(movers)].astype(np.int32)}), "h long, moved int")
    words = vocabulary.join(F.broadcast(mover_classes), "h", "left").join(tail, "h", "left")  # each word is in one of them
    words = _settled(words.select("h", "n", "unit", F.coalesce("moved", "cls").alias("cls"), F.col("moved").isNotNull().alias("mover")), "words")
    counts = final_counts(bigrams, words, len(movers), units, cls, beside)
    told.append(likelihood(counts))
    discard(vocabulary, bigrams)
    sums = words.groupBy("cls").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()  # a row a class
    distinct, tokens = np.zeros(classes), np.zeros(classes)
    for r in sums:
        distinct[r.cls], tokens[r.cls] = r.v, r.n
    least = int(head["n"].min()) if len(head) else 1
    known = words.join(F.broadcast(spark.createDataFrame(head[["h"]], "h long")), "h").select("h", "n", "cls").toPandas().sort_values("h", ignore_index=True) if len(head) else pd.DataFrame({"h": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "cls": np.zeros(0, np.int64)})
    share = counts.sum(axis=0) + 1.0
    share /= share.sum()
    strength = 20.0
    transition = (counts + strength * share[None, :]) / (counts.sum(axis=1, keepdims=True) + strength)
    emission = tokens + distinct + 1.0
    return {
        "words": words, "head": known, "movers": movers, "cls": cls, "units": units, "ends": ends, "likelihood": told, "least": least,
        "tokens": int(tokens.sum()) + ends, "distinct": int(distinct.sum()) + (ends > 0),
        "log_transition": np.log10(transition), "log_emission": np.log10(emission),
    }


def score(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity) for every row."""
    tables = {k: model[k] for k in ("movers", "cls", "units", "log_transition", "log_emission")}
    tables |= {"h": model["head"]["h"].to_numpy(np.int64), "n": model["head"]["n"].to_numpy(np.int64), "of": model["head"]["cls"].to_numpy(np.int64)}
    shared = documents.sparkSession.sparkContext.broadcast(tables)  # head_words counts and classes, classes^2 numbers

    def run(batches):
        m = shared.value
        coder = _Coder(m["units"])
        for b in batches:
            codes, sizes, hashes, endings = coder.batch(b["text"])
            at = _find(m["h"], hashes)
            found = np.maximum(at, 0)
            n = np.where(at >= 0, m["n"][found], 0) if len(m["h"]) else np.zeros(len(hashes), np.int64)
            seed = m["cls"][1 + len(m["movers"]) + endings] if len(hashes) else np.zeros(0, np.int64)
            of = np.where(at >= 0, m["of"][found], seed) if len(m["h"]) else seed
            counts = np.log10(n + 1.0)
            line, inside = _line(of[codes], sizes)
            rare = np.zeros(len(line), bool)  # words that the join may know
            rare[inside] = (at < 0)[codes]
            step = np.where(rare[:-1] | rare[1:], 0.0, m["log_transition"][line[:-1], line[1:]])  # those next to rare words follow
            word = np.zeros(len(step))
            word[inside[1:]] = np.where(rare[inside], 0.0, (counts[codes] - m["log_emission"][of[codes]]))
            raw = np.zeros(len(step))
            raw[inside[1:]] = counts[codes]
            seen = np.zeros(len(step), np.int64)
            seen[inside[1:]] = (at >= 0)[codes]
            begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
            where = np.flatnonzero(rare)
            left = np.where(rare[where - 1], -1, line[where - 1])
            right = np.where(rare[where + 1], -1, line[where + 1])
            cuts = np.searchsorted(where, begins[1:])
            whole = pa.StructArray.from_arrays([pa.array(hashes[codes][rare[inside]]), pa.array(line[where].astype(np.int16)), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16))], names=["h", "seed", "left", "right"])
            yield {
                "row": b["row"], "n_tokens": sizes + 1, "seen": np.add.reduceat(seen, begins), "counted": np.add.reduceat(raw, begins), "modelled": np.add.reduceat(step + word, begins),
                "rare": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cuts, [len(where)]]).astype(np.int32)), whole),
            }

    keyed = documents.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    kinds = "row long, n_tokens long, seen long, counted double, modelled double, rare array<struct<h: long, seed: short, left: short, right: short>>"
    rows = _settled(map_columns(keyed, kinds, run, keep=("doc_id",), arrow=("text",), slice_bytes=SLICE), "scored")
    log = lambda name: F.split(F.lit(",".join(map(repr, model[name].ravel().tolist()))), ",").cast("array<double>")  # noqa: E731  a constant of at most classes^2 numbers
    classes = len(model["log_emission"])
    each = rows.select("row", F.posexplode("rare").alias("i", "r")).select("row", "i", "r.*")
    each = each.join(model["words"].where(F.col("n") <= model["least"]).select("h", "n", F.col("cls").alias("learnt")), "h", "left")
    each = each.select("row", "i", "left", "right", F.coalesce("learnt", "seed").cast("int").alias("c"), F.coalesce("n", F.lit(0)).alias("n"))
    # neighbours that are rare words too stand next to each other in a text's list
    before = F.when(F.col("left") < 0, F.lag("c").over(W.partitionBy("row").orderBy("i"))).otherwise(F.col("left"))
    each = each.withColumn("before", before.cast("int"))
    move = lambda a, b: F.get(log("log_transition"), a * classes + b)
    steps = move(F.col("before"), F.col("c")) + F.when(F.col("right") >= 0, move(F.col("c"), F.col("right").cast("int"))).otherwise(0.0)
    more = F.log10(F.col("n") + 1)
    told = each.groupBy("row").agg(F.sum(more).alias("more"), F.count_if(F.col("n") > 0).alias("k"), F.sum(more - F.get(log("log_emission"), F.col("c")) + steps).alias("rest"))
    total, kinds_of, ends = model["tokens"], model["distinct"], model["ends"]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base = F.col("counted") + zero("more") + F.lit(float(np.log10(ends + 1.0))) - F.col("n_tokens") * F.lit(float(np.log10(total + 1.0 * (kinds_of + 1))))
    out = rows.drop("rare").join(told, "row", "left").select(
        "doc_id", "n_tokens", (F.col("seen") + F.coalesce("k", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"), base.alias("base_score"), (F.col("modelled") + zero("rest")).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op1_brown(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs.where(crc_bucket("doc_id", 7) != 2))
    scored = score(docs, model)
    return scored.select(
        "doc_id", (crc_bucket("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity",
    )
