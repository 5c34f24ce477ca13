import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tidewell.llm.repeats import remove_repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cut = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cut[i : i + length] = b"\x01" * length
        runs = sum(1 for i, c in enumerate(cut) if c and (i == 0 or not cut[i - 1]))
        out.append((len(d), sum(cut), runs, hashlib.sha256(bytes(b for b, c in zip(d, cut) if not c)).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(90), prose(130), prose(60)]
    texts = [None, "", "short", "a" * 1500, prose(400)]
    for i in range(60):
        parts = [prose(r.randint(5, 120))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, 40)
            parts += [s[a : a + r.randint(380, 460)], prose(r.randint(1, 60))]
        texts.append(" ".join(parts))
    texts += [texts[10], texts[10], texts[4], texts[4][:700] + "X" + texts[4][700:]]
    near = list(texts[20])
    for _ in range(3):
        near[r.randrange(len(near))] = "#"
    texts.append("".join(near))
    texts.append(("0123456789" * 30 + "z") * 5)
    return texts


def result(spark, rows, **more):
    df = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, p string"), **more)
    return df.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("h")).collect()


def test_matches_brute_force(spark):
    texts = corpus(1)
    got = {r.doc_id: tuple(r)[1:] for r in result(spark, [(i, t, "x") for i, t in enumerate(texts)])}
    want = brute(texts, 400)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] > 0 for w in want) > 10


def test_long_texts_are_cut_into_segments_without_loss(spark, monkeypatch):
    from tidewell.llm import repeats

    texts = corpus(2)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    whole = sorted(map(tuple, result(spark, rows)))
    r = random.Random(5)
    long_text = "".join(r.choice("abcdefgh ") for _ in range(repeats.SEGMENT + 5000))
    more = rows + [(1000, long_text, "x"), (1001, long_text[repeats.SEGMENT - 300 : repeats.SEGMENT + 300], "x")]
    got = {x[0]: x for x in map(tuple, result(spark, more))}
    assert got[1000][2] == 600 and got[1001][2] == 600
    assert [got[i] for i in range(len(texts))] == whole


def test_edges(spark):
    assert result(spark, []) == []
    t = "q" * 399
    none = {(r.doc_id, r.n_removed) for r in result(spark, [(1, t, None), (2, t[1:], None), (None, None, None)])}
    assert none == {(1, 0), (2, 0), (None, 0)}
    twice = sorted((r.doc_id, r.n_removed) for r in result(spark, [(7, t + "r", None), (7, t + "r", None), (8, t, None)]))
    assert twice == [(7, 400), (7, 400), (8, 0)]
