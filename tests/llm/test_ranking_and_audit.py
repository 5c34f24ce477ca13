"""Pairwise quality ranking, impact-ordered search and the filter audit against plain versions, and their edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import audit, impact, pairwise

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


# --- op12 -------------------------------------------------------------------------------------------------------------
def plain_search(rows, items, k=20):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(i, Counter(split(t))) for i, t in rows]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 75 + 25 * c.total() * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in split(text) if c[w])
            scored += [(-s, i is None, i or 0, i)] if s > 0 else []
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


SEARCHED = [(9, None), (1, ""), (2, "Apple, pear! apple"), (3, "pear plum"), (4, "APPLE pear apple"), (4, "APPLE pear apple"), (None, "apple pear apple"), (None, "apple pear apple"), (5, "Äpfel pear-tree x1"), (6, "...")] + [(100 + i, "plum " * (i % 5) + f"word{i} pear") for i in range(60)]
ASKED = [(1, "apple"), (1, "apple"), (2, "apple Apple plum"), (3, None), (4, "?!"), (5, "nowhere"), (None, "pear plum"), (6, "äpfel x1 Äpfel")]


def test_search_matches_a_plain_version(spark, monkeypatch):
    index = impact.index_rows(documents(spark, [(i, "s", t) for i, t in SEARCHED]).withColumn("terms", F.lit("x")).withColumn("n", F.lit("y")))
    items = spark.createDataFrame(ASKED, "item_id long, text string").withColumn("row", F.lit("z"))
    want = plain_search(SEARCHED, ASKED)
    for block_bytes in (impact.BLOCK, 40):  # one block of queries, and several
        got = sorted((tuple(r) for r in impact.ranked_search(index, items, block_bytes=block_bytes).collect()), key=str)
        assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 6), st.integers(1, 40)), max_size=150), st.lists(st.tuples(st.integers(0, 6), st.integers(1, 9)), min_size=1, max_size=6), st.integers(1, 4))
def test_early_stops_lose_nothing(postings, query, k):
    """A shard searched score at a time gives the same best rows as full sums, whatever the threshold carried in."""
    impacts = {(r, t): i for r, t, i in postings}
    keys = sorted(impacts)
    row, term = (np.array([key[i] for key in keys], np.int64) for i in range(2))
    weights = dict(query)
    terms = np.array(sorted(weights), np.int64)
    ids = np.arange(31) * 7 % 31  # ties aren't in the rows' order
    shard = impact.Shard(row, term, np.array([impacts[key] for key in keys], np.int64), ids, np.zeros(31, bool), 7)
    full = np.zeros(31, np.int64)
    for (r, t), i in impacts.items():
        full[r] += weights.get(t, 0) * i
    for first in ([], [(60, 100), (30, 101)]):
        best = impact.Best(k)
        best.add(np.array([s for s, _ in first], np.int64), np.array([i for _, i in first], np.int64), np.zeros(len(first), bool))
        shard.search(terms, np.array([weights[t] for t in terms.tolist()], np.int64), best)
        want = sorted([(-s, i) for s, i in first] + [(-int(s), int(i)) for s, i in zip(full, ids) if s > 0])[:k]
        assert list(zip((-best.scores).tolist(), best.ids.tolist())) == want


def test_searches_stop_early(spark, monkeypatch):
    """Postings beyond the bound aren't added up when a few rows are far ahead."""
    ids = np.arange(5000)
    term = np.zeros(5000, np.int64)
    shard = impact.Shard(ids, term, np.where(ids < 20, 1000, 10), ids, np.zeros(5000, bool), 1)
    best = impact.Best(20)
    touched = []
    monkeypatch.setattr(shard, "row", type("Seen", (), {"__getitem__": lambda self, s, own=shard.row: touched.append(s) or own[s]})())
    shard.search(np.array([0]), np.array([3]), best)
    assert sum(s.stop - s.start for s in touched) == 20 and best.ids.tolist() == list(range(20))


def test_empty_search(spark):
    index = impact.index_rows(documents(spark, []))
    assert impact.ranked_search(index, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    index = impact.index_rows(documents(spark, [(1, "s", "a")]))
    assert impact.ranked_search(index, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_long_texts_in_pieces():
    text = ("alpha beta\t" * 150_000) + "x" * 2_000_000 + " Gamma"
    assert impact.term_counts(text) == Counter({b"alpha": 150_000, b"beta": 150_000, b"x" * 2_000_000: 1, b"gamma": 1})


# --- op13 -------------------------------------------------------------------------------------------------------------
def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    smallest = {}
    for i, _, t in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    masks = []
    for i, part, t in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > smallest[t]}
        masks.append((i, part or "", {f for f, x in fails.items() if x}))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for step, f in enumerate(order, 1):
            for part in {p for _, p, _ in masks}:
                own = [(i, m) for i, p, m in masks if p == part]
                removed = [i for i, m in own if f in m and not m & set(order[: step - 1])]
                shapley[part, f] += len(removed)
                out[part, "".join(order), step] = [
                    sum(not m & set(order[:step]) for _, m in own), len(removed), sum(f in m and bool(m & set(order[: step - 1])) for _, m in own), sum(m == {f} for _, m in own),
                    sum(i in good for i in removed), sum(i in toxic for i in removed),
                ]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


LINES = ["", None, "short", "a b c " * 80, " ".join(f"w{i}" for i in range(250)), "SHOUT " * 210, "cash $ now", "ÉÀ" * 30 + "AB", "short", " nbsp x " * 120]


def test_audit_matches_a_plain_version(spark, monkeypatch):
    rows = [(i if i % 7 else None, None if i % 5 == 0 else f"s{i % 3}" if i % 4 else "", LINES[i * i % len(LINES)]) for i in range(90)] + [(8, "s1", LINES[4])] * 3 + [(3, "s2", "short")] * 2
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 80, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (3, 1, 1)]
    docs = documents(spark, rows).repartition(5).select("*", F.lit("x").alias("mask"), F.lit("y").alias("part"), F.lit(1).alias("n"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("z"))
    got = sorted(tuple(r) for r in audit.interactions(docs, marks).collect())
    assert got == plain_audit(rows, labels)
    assert len(got) == 600 * 4


def test_chains_compare_texts(monkeypatch):
    """Different texts with one fingerprint stay apart, in the task and after it, also when chains leave early."""
    monkeypatch.setattr(audit.xxhash, "xxh64_intdigest", lambda data: 7)
    rows = [(5, "s", "a"), (1, "s", "b"), (3, "s", "a"), (4, "s", "b"), (3, "s", "a"), (None, "s", "a")]
    for held in (audit.HELD, 1):
        monkeypatch.setattr(audit, "HELD", held)
        records = list(audit.screen(0, rows)) + list(audit.screen(1, [(2, "s", "a"), (9, "s", "c")]))
        got = sorted(((i or 0, m >> 4, n) for i, _, m, n in audit.settle(sorted(records, key=lambda r: r[0]))))
        assert sum(n for *_, n in got) == 8
        assert {(i, e) for i, e, _ in got} == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (9, 0)}


def test_long_texts_have_the_same_failures():
    text = "Alpha beta " * 120_000
    assert len(text) > audit.LONG
    assert audit.text_failures(text, text.encode()) == audit.text_failures(text[:2200], text[:2200].encode()) == 0b0110


def test_empty_audit(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(documents(spark, []), none).count() == 0
    rows = audit.interactions(documents(spark, [(None, None, None)]), none).collect()
    assert len(rows) == 600 and {(r.part, r.kept + r.removed + r.redundant) for r in rows if r.filter_order[r.step - 1] == "A"} == {("", 1)}


# --- op11 -------------------------------------------------------------------------------------------------------------
def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in pairwise.op11_pairwise(spark, LARGER).collect()}
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels if rows[r.doc_id].held_out]
    for label in (0, 1):
        own = [p == label for p, q in held if q == label]
        assert sum(own) >= 0.95 * len(own) > 5


def test_gradient_and_pairs():
    rng = np.random.default_rng(3)
    x, y, w = rng.normal(size=(30, pairwise.WIDTH)), (rng.random(30) < 0.7).astype(int), rng.normal(size=pairwise.WIDTH) * 0.1
    a, b = pairwise.pair_indices(y)
    assert (y[a] == 1).all() and (y[b] == 0).all() and set(a) | set(b) == set(range(30))
    out = pairwise.pair_loss(w, y, x)
    losses = [math.log1p(math.exp(-float((x[i] - x[j]) @ w))) for i, j in zip(a, b)]
    assert out[-1] == len(a) == pairwise.ROUNDS * max(y.sum(), 30 - y.sum()) and abs(out[-2] - sum(losses)) < 1e-8
    for c in (0, 5, 200):
        up, down = w.copy(), w.copy()
        up[c] += 1e-5
        down[c] -= 1e-5
        assert abs((pairwise.pair_loss(up, y, x)[-2] - pairwise.pair_loss(down, y, x)[-2]) / 2e-5 - out[c]) < 1e-4


def test_minimise_finds_the_least():
    target, curve = np.arange(5.0), np.array([1, 10, 100, 3, 0.5])
    found = pairwise.minimise(lambda w: (float(curve @ (w - target) ** 2), 2 * curve * (w - target)), np.zeros(5), steps=100, tolerance=1e-12)
    assert np.allclose(found, target, atol=1e-3)


def test_threshold_is_a_weighed_quantile():
    s, y = np.array([1.0, 2, 3, 4, 5]), np.array([0, 0, 1, 1, 1])
    assert pairwise.quantile_threshold(s, y, np.ones(5)) == 2.5
    assert pairwise.quantile_threshold(s, y, np.array([1, 1, 9, 9, 9.0])) == 2.5
    assert pairwise.quantile_threshold(s, np.array([0, 1, 0, 1, 1]), np.ones(5)) == 2.5
    assert pairwise.quantile_threshold(s, np.ones(5), np.ones(5)) == 1.0 and pairwise.quantile_threshold(s, np.zeros(5), np.ones(5)) > 5


def test_threshold_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(pairwise, "CUTS", 3)
    rng = np.random.default_rng(6)
    cases = [(np.round(rng.normal(size=90), d), (rng.random(90) < p).astype(int)) for d in (0, 1, 9) for p in (0.1, 0.8)]
    cases += [(np.array([1.0, 1.0, 1.0]), np.array([0, 1, 0])), (np.array([2.0, 1.0]), np.ones(2, int)), (np.array([1.0, 5.0]), np.zeros(2, int)), (np.zeros(0), np.zeros(0, int)), (np.exp(rng.normal(size=50) * 40), np.arange(50) % 2)]
    for s, y in cases:
        for weight in (np.ones(len(s)), np.where(y == 1, 7.5, 1.0)):
            rows = spark.createDataFrame([*zip(s.tolist(), y.tolist(), weight.tolist())], "s double, y int, weight double")
            assert pairwise.table_threshold(rows) == pairwise.quantile_threshold(s, y, weight)


def test_every_labelled_document_teaches(spark, monkeypatch):
    """More ids of a label than the former bound, and labels that meet documents in several parts."""
    n = 40_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.pmod("id", F.lit(2)).cast("int").alias("quality"))
    assert pairwise.labelled_rows(docs, labels).groupBy("y", "weight").count().orderBy("y").collect() == [(0, 1.0, n // 2), (1, 1.0, n // 2)]
    monkeypatch.setattr(pairwise, "LABELS", 9000)
    assert pairwise.labelled_rows(docs, labels).count() == n


@pytest.mark.parametrize("quality, predicted", [(None, 1), (1, 1), (0, 0)])
def test_one_label_or_none(spark, quality, predicted):
    docs = documents(spark, [(i, "s", t) for i, t in enumerate(["good text", "", None, "x" * 50])]).withColumn("score", F.lit("x")).withColumn("y", F.lit("x"))
    labels = spark.createDataFrame([(0, quality, 0), (3, quality, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = pairwise.score(docs, pairwise.fit(docs, labels)).collect()
    assert len(rows) == 4 and {r.predicted for r in rows} == {predicted} and len({r.score for r in rows}) == 1


def test_ranking_of_repeated_null_and_long_rows(spark):
    good, bad = "Plain words make a calm sentence here. ", "BUY!! NOW!! $$$ "
    rows = [(i, "s", (good if i % 2 else bad) * (1 + i % 4)) for i in range(60)] + [(60, "s", good * 40_000), (61, "s", bad * 100_000), (61, "s", bad), (None, "s", good), (62, "s", None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] * 2 + [(7, None, 1)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    model = pairwise.fit(docs, labels)
    got = defaultdict(set)
    for r in pairwise.score(docs, model).collect():
        got[r.doc_id].add(r.predicted)
    assert all(got[i] == {i % 2} for i in range(60)) and got[60] == {1} and got[61] == {0} and got[None] == {1}
    again = pairwise.fit(docs.repartition(3), labels.repartition(2))
    assert np.allclose(model[0], again[0]) and pairwise.fit(docs, labels, sample=10)[0].any()


def test_features_of_pieces(monkeypatch):
    text = "Some words, and  more.\nSecond LINE é " * 50
    whole = pairwise.features(text)
    monkeypatch.setattr(pairwise, "PIECE", 64)
    assert np.allclose(whole, pairwise.features(text), atol=1e-6) and not pairwise.features(None).any()
