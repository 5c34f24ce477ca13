"""Language ID, class scoring and the pipeline against plain versions that loop over every word and pair."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

import corpus_pipeline
from tidewell.llm import brown, language, secrets, simhash
from tidewell.llm.common import crc_bucket

SF = "/root/testdata/sf0.001"
SPACE = "[^\x20\x09-\x0d]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


# --- language ID ------------------------------------------------------------------------------------------------------
def test_language_matches_brute_force(spark):
    rows = table(spark)
    split = lambda t: [w for w in re.split(rb"[^a-z\x80-\xff]+", t.lower().encode()) if w]

    def buckets(words):
        """For each word its (order, bucket) pairs: n-grams from the space before the word to its last byte."""
        text = b" " + b" ".join(words) + b" " + b" " * 4
        at, out = 0, []
        for w in words:
            own = []
            for p in range(at, at + len(w) + 1):
                for n in language.ORDERS:
                    code = 0
                    for byte in text[p : p + n]:
                        code = (code * 257 + byte) % 2**64
                    own.append((n, ((code + n) * 0x9E3779B97F4A7C15 % 2**64) >> 50))
            out.append(own)
            at += len(w) + 1
        return out

    counts, scripts, seen = defaultdict(Counter), defaultdict(Counter), {}
    for i, t, lang in zip(rows.doc_id, rows.text, rows.lang):
        if t and lang and zlib.crc32(str(i).encode()) % 5:
            for w in split(t):
                seen.setdefault(lang, Counter())[w] += 1
    for lang, own in seen.items():
        words = list(own)
        for w, bs in zip(words, buckets(words)):
            scripts[lang][language.script_of(w)] += own[w]
            for b in bs:
                counts[lang][b] += own[w]
    languages = sorted(counts)
    got_languages, logs, allowed = language.train_on(spark.read.parquet(f"{SF}/documents.parquet"))
    assert got_languages == languages
    total = {(x, n): sum(c for (m, _), c in counts[x].items() if m == n) + 0.5 * language.BUCKETS for x in languages for n in language.ORDERS}
    for x, lang in enumerate(languages):
        for row, n in enumerate(language.ORDERS):
            want = np.array([math.log((counts[lang][n, b] + 0.5) / total[lang, n]) / 3 for b in range(0, language.BUCKETS, 97)])
            assert np.allclose(logs[x, row, ::97], want, atol=1e-5)
        for s in range(len(language.NAMES)):
            assert allowed[s, x] == (scripts[lang][s] / sum(scripts[lang].values()) > 0.01)
    got = {r.doc_id: r for r in language.op3_language(spark, SF).collect()}
    known = {}
    for i, t in list(zip(rows.doc_id, rows.text))[:120]:
        r = got[i]
        words = split(t) if t and re.search(r"[^\W\d_]", t) else []
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        for w in fresh:
            (bs,) = buckets([w])
            open_to = [allowed[language.script_of(w), x] for x in range(len(languages))]
            known[w] = [sum(float(logs[x, language.ORDERS.index(n), b]) for n, b in bs) + (0 if open_to[x] or not any(open_to) else -40) for x in range(len(languages))]
        at, back = list(known[words[0]]), []
        for w in words[1:]:
            moves = [max(range(len(at)), key=lambda y: (at[y] - 12 * (y != x), y == x)) for x in range(len(at))]
            at = [at[y] - 12 * (y != x) + known[w][x] for x, y in enumerate(moves)]
            back.append(moves)
        path = [max(range(len(at)), key=lambda x: at[x])]
        for moves in reversed(back):
            path.append(moves[path[-1]])
        mass = Counter()
        for w, x in zip(words, reversed(path)):
            mass[x] += sum(c.isalpha() for c in w.decode("utf-8", "ignore"))
        best = max(mass, key=lambda x: mass[x])
        assert r.lang_pred == languages[best] and abs(r.score - mass[best] / sum(mass.values())) < 1e-9


def test_letters_of_any_script_weigh_the_same(spark):
    """47 English and 25 Russian letters are English, though the Russian ones have more bytes."""
    english, russian = "the house of the king was in the north of the country", "дом короля стоял на севере и"
    teach = [(i, english if i % 2 else russian, "en" if i % 2 else "ru") for i in range(40)]
    docs = spark.createDataFrame(teach, "doc_id long, text string, lang string")
    count = lambda t: sum(c.isalpha() for c in t)
    asked = [(1, english + " — " + russian), (2, english + " " + russian * 3), (3, "—— … ² 42"), (4, russian)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(asked, "doc_id long, text string"), language.train(docs), penalty=2.0).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[3].lang_pred, got[4].lang_pred) == ("en", "ru", "und", "ru")
    assert abs(got[1].score - count(english) / (count(english) + count(russian))) < 0.05


# --- class scoring ----------------------------------------------------------------------------------------------------
def test_scores_match_brute_force_and_sum_to_one(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(80)
    training = documents.where(crc_bucket("doc_id", 7) != 2)
    model = brown.fit(training, classes=12, exchange_words=60, units=32, head_words=200, sweeps=3)
    words = model["words"].toPandas()
    cls, n = dict(zip(words.h, words.cls)), dict(zip(words.h, words.n))
    transition, emission = 10 ** model["log_transition"], 10 ** model["log_emission"]
    assert np.allclose(transition.sum(axis=1), 1)
    filled = np.zeros(12)
    np.add.at(filled, words.cls.to_numpy(), words.n.to_numpy() + 1.0)
    assert np.allclose((filled + 1)[1:], emission[1:])  # all words of a class and one unseen word
    rows = documents.toPandas()
    cut = lambda t: [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(SPACE, lower(t or ""))]
    signed = lambda h: h - 2**64 if h >> 63 else h
    ending = lambda t: {signed(xxhash.xxh64_intdigest(w.encode())): xxhash.xxh64_intdigest(w.encode()[-3:]) % 32 for w in re.findall(SPACE, lower(t or ""))}
    seeds = model["cls"][1 + len(model["movers"]) :]
    counts, both, of_unit, movers = np.zeros((12, 12)), np.zeros((32, 32)), np.zeros((32, 12)), set(model["movers"].tolist())
    for i, t in zip(rows.doc_id, rows.text):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            ends = ending(t)
            line = [None, *[signed(h) for h in cut(t)], None]
            for a, b in zip(line, line[1:]):
                if a in movers or b in movers or a is None or b is None:
                    counts[cls.get(a, 0), cls.get(b, 0)] += 1
                else:  # by the shares of the classes in either ending
                    both[ends[a], ends[b]] += 1
            for h in line[1:-1]:
                if h not in movers:
                    of_unit[ends[h], cls[h]] += 1
    of_unit /= np.maximum(of_unit.sum(axis=1, keepdims=True), 1)
    counts += of_unit.T @ both @ of_unit
    share = (counts.sum(axis=0) + 1) / (counts.sum() + 12)
    assert np.allclose(transition, (counts + 20 * share) / (counts.sum(axis=1, keepdims=True) + 20))
    got = {r.doc_id: r for r in brown.score(documents, model).collect()}
    for i, t in zip(rows.doc_id, rows.text):
        ends = ending(t)
        hs = [signed(h) for h in cut(t)]
        line = [0, *[int(cls.get(h, seeds[ends[h]])) for h in hs], 0]
        want = sum(math.log10(transition[a, b]) for a, b in zip(line, line[1:])) + sum(math.log10((n.get(h, 0) + 1) / emission[c]) for h, c in zip(hs, line[1:]))
        assert math.isclose(got[i].score, want, rel_tol=1e-9)
        assert got[i].n_known == sum(h in n for h in hs) + 1
    told = model["likelihood"]
    assert max(told[1:]) > told[0]


def test_words_move_to_their_neighbours_class():
    counts = np.array([[0, 50, 50], [50, 100, 5], [50, 5, 100]], float)
    word, slot = np.array([0, 0, 1, 1]), np.array([2, 3, 4, 5])  # word 0 stands among class 1, word 1 among class 2
    new = brown.best_classes(word, slot, np.array([9.0, 9, 9, 9]), np.array([2, 2]), counts)
    assert new.tolist() == [1, 2]


# --- near copies and the pipeline -------------------------------------------------------------------------------------
def shingles(text, k=5):
    words = re.findall(SPACE, lower(text))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_groups(texts, radius=7):
    """Smallest index reachable over pairs within ``radius`` bits whose shingles are 0.8 alike."""
    prints = [simhash.fingerprint_of(list(dict.fromkeys(simhash.words_of(t))), 1) % 2**64 for t in texts]
    sets = [shingles(t) for t in texts]
    low = list(range(len(texts)))
    pairs = []
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                common = len(sets[i] & sets[j])
                if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                    pairs.append((i, j))
    while any(low[i] != low[j] for i, j in pairs):
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    return low, pairs


def test_near_copies_match_brute_force(spark):
    """Small and large buckets, chains, and texts that are candidates but not alike."""
    import random

    r = random.Random(4)
    texts = []
    for g in range(12):
        base = [f"w{r.randrange(4000)}" for _ in range(120)]
        for _ in range(25):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 5, 9])):
                own[r.randrange(120)] = f"n{r.randrange(9999)}"
            texts.append(" ".join(own))
    texts += ["the same few words " * k for k in range(1, 40)]
    texts = sorted(set(texts))
    low, pairs = near_groups(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(set(low))
    assert len(pairs) > 500 and len(want) > 12
    assert sorted(x.doc_id for x in simhash.keep_one_of_each(rows).collect()) == want
    nodes = [(i, simhash.fingerprint_of(list(dict.fromkeys(simhash.words_of(t))), 1), len(simhash.shingle_hashes(simhash.words_of(t), 5))) for i, t in enumerate(texts)]
    for hot, block in ((10**9, 2048), (2, 16)):  # pairs alone, and block pairs almost alone
        edges = simhash.verified_links(spark.createDataFrame(nodes, "th long, fp long, n long"), rows.withColumnRenamed("doc_id", "th"), 7, 5, 0.8, hot, block).collect()
        got = list(range(len(texts)))
        while any(got[e.a] != got[e.b] for e in edges):
            for e in edges:
                got[e.a] = got[e.b] = min(got[e.a], got[e.b])
        assert got == low


def test_recall_of_near_copies():
    """Pairs of five-word similarity 0.8 or more among real texts that are within the radius."""
    import duckdb

    texts = sorted({t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where length(text) > 200").fetchall()})
    sets = [shingles(t) for t in texts]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    common = Counter(p for own in where.values() if len(own) < 50 for p in ((i, j) for i in own for j in own if i < j))
    alike = [p for p, c in common.items() if c >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    prints = {i: simhash.fingerprint_of(list(dict.fromkeys(simhash.words_of(texts[i]))), 1) % 2**64 for p in alike for i in p}
    found = sum((prints[i] ^ prints[j]).bit_count() <= 7 for i, j in alike)
    assert alike and found >= 0.9 * len(alike)


def test_pipeline_matches_brute_force(spark):
    rows = table(spark).sort_values("doc_id")
    kept = [(i, t, s) for i, t, s in zip(rows.doc_id, rows.text, rows.source) if t and re.search(r"[^\W\d_]", t) and re.search(r"[a-z\x80-\U0010ffff]", lower(t))]
    first = {}
    for i, t, _ in kept:
        first.setdefault(t, i)
    distinct = sorted(first, key=first.get)
    low, _ = near_groups(distinct)
    stay = {first[distinct[k]] for k in set(low)}
    kept = [x for x in kept if x[0] in stay]
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    items = [words(t) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text if t]
    windows = {tuple(w[k : k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = lambda t: not any(tuple(w[k : k + m]) in windows for w in [words(t)] for m in sizes for k in range(len(w) - m + 1))
    kept = [(i, secrets.redact(t), s) for i, t, s in kept if clean(t)]
    # mixing: water filling by hand, then passes in the order of md5
    import hashlib

    size = {i: len(re.findall(SPACE, t)) for i, t, _ in kept}
    names = sorted({s for *_, s in kept if s is not None}) + ([None] if any(s is None for *_, s in kept) else [])
    total = {s: sum(size[i] for i, _, x in kept if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    curve = {s: ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(total.values()), list(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * total[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s], left = 2.0 * total[s], left - 2 * total[s]
            open_.remove(s)
    want = []
    for s in names:
        at, end = 0, math.floor(target[s])
        order = sorted((i for i, _, x in kept if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        a, b = curve[s]
        while at < end and total[s]:
            for i in order:
                took = min(size[i], end - at)
                if took > 0:
                    u = at / target[s]
                    want.append((i, took, u if a == b else (math.sqrt(max(0, a * a + 2 * (b - a) * u)) - a) / (b - a)))
                at += took
    texts = {i: t for i, t, _ in kept}
    got = [(r.doc_id, r.words, r.position, r.text) for r in corpus_pipeline.run(spark, SF).collect()]
    assert [g[2] for g in got] == sorted(g[2] for g in got)
    assert all(texts[g[0]] == g[3] for g in got)
    key = lambda x: (x[0], round(x[2], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-9


def test_each_move_raises_the_likelihood_most():
    """A single item's move equals trying every class with the likelihood itself."""
    rng = np.random.default_rng(5)
    items, k = 24, 5
    sequence = np.append(0, rng.choice(np.arange(1, items), 600, p=rng.dirichlet(np.ones(items - 1))))
    pairs = np.zeros((items, items))
    np.add.at(pairs, (sequence, np.roll(sequence, -1)), 1)  # closed, so that rows and columns have equal sums
    cls = np.append(0, rng.integers(1, k, items - 1))
    of = lambda c: np.eye(k)[c].T @ pairs @ np.eye(k)[c]
    for i in range(1, items):
        tried = [brown.likelihood(of(np.where(np.arange(items) == i, c, cls))) for c in range(1, k)]
        left, right = (np.eye(k)[cls].T @ x for x in (pairs[:, i], pairs[i]))
        new = brown.exchange_group(left[None], right[None], np.array([pairs[i, i]]), cls[i : i + 1], of(cls))[0]
        assert tried[new - 1] >= max(tried) - 1e-9


def test_the_likelihood_never_falls(spark, monkeypatch):
    """Sweeps that overshoot, as many items move at once, are taken back; what is returned is the last that counts."""
    rng = np.random.default_rng(8)
    items, k = 60, 6
    sequence = np.append(0, rng.integers(1, items, 900))
    pairs = np.zeros((items, items), np.int64)
    np.add.at(pairs, (sequence, np.roll(sequence, -1)), 1)
    a, b = np.nonzero(pairs)
    bigrams = spark.createDataFrame(pd.DataFrame({"a": a.astype(np.int32), "b": b.astype(np.int32), "n": pairs[a, b]}))
    tried, plain = [], brown.likelihood
    monkeypatch.setattr(brown, "likelihood", lambda c: tried.append(plain(c)) or tried[-1])
    start = np.append(0, 1 + np.arange(items - 1) % (k - 1))
    cls, counts, told = brown.exchange(bigrams, k, 8, start)
    assert told == sorted(told) and told[-1] > told[0] and told[-1] == max(tried)
    assert len(tried) > len(told)  # some sweep was taken back
    assert (counts == np.eye(k)[cls].T @ pairs @ np.eye(k)[cls]).all() and plain(counts) == told[-1]


def test_words_are_moved_in_little_memory():
    """A task holds ``ENTRIES`` entries at a time, maybe of as many words; what they need stays far below an executor's share."""
    n, k, rng = brown.ENTRIES, 64, np.random.default_rng(5)
    counts, slot, times = rng.integers(0, 9000, (k, k)).astype(float), rng.integers(0, 2 * k, n), rng.integers(1, 40, n).astype(float)
    tracemalloc.start()
    try:
        new = brown.best_classes(np.arange(n), slot, times, rng.integers(1, k, n), counts)
        assert tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()
    assert new.min() >= 1 and len(new) == n


def test_texts_come_in_small_batches(spark):
    """Many long texts in one partition; the session's own limit is as before afterwards."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(400, numPartitions=1).selectExpr("repeat(cast(id as string), 30000) text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    assert brown._settled(texts.mapInArrow(sizes, "n long"), "sizes").agg({"n": "max"}).first()[0] <= brown.BATCH + 100_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
