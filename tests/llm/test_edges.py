"""Clashing column names, null and repeated ids, empty tables and ties, for operators and pipeline stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import brown, decontaminate, flatgraph, language, licenses, mixing, pages, repeats, secrets, simhash

SF = "/root/testdata/sf0.001"
#: names that results and working columns have
CLASHING = (
    "score", "spans", "lang_pred", "n_words", "n_hit", "items", "contaminated", "weight", "key", "cell", "size", "taken", "positions", "position", "passes", "words", "target",
    "source_size", "start", "before", "src", "id", "row", "_text", "text_hash", "shingles", "document", "th", "dk", "late", "fp", "n", "h", "part", "value", "kept", "host", "wrapper", "node", "v", "cluster",
)
TEXTS = ["the cat and the dog were in the house of the king", "der hund und die katze sind nicht in dem haus", "the cat and the dog were in the house of the king", None, "", "token: abcdef123 the and of"]


def clashing(spark, texts=TEXTS):
    rows = spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("*", *[F.concat(F.lit(c + " "), "doc_id").alias(c) for c in CLASHING])


def test_operators_ignore_clashing_columns(spark):
    d, n = clashing(spark), len(TEXTS)
    bench = spark.createDataFrame([(None, "the cat and", "x"), (2, None, "x")], "item_id long, text string, item string")
    assert language.identify(d, language.train_on(d)).count() == n
    hit = {r.doc_id: (r.n_items, r["items"]) for r in decontaminate.decontaminate(d, bench).collect()}
    assert hit[0] == (1, [""]) and hit[1] == (0, [])
    assert decontaminate.decontaminate(d, bench, shard_bytes=10).count() == n
    assert brown.score(d, brown.fit(d)).count() == n and secrets.scan_secrets(d).count() == n and repeats.remove_repeats(d).count() == n
    assert simhash.near_duplicates(simhash.with_fingerprints(d)).count() == n and licenses.scan_licenses(d).count() == 0
    assert mixing.curriculum_mix(d).count() == n
    vectors = d.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"), *CLASHING)
    assert flatgraph.link_vectors(vectors).count() == n
    web = d.select(F.col("doc_id").alias("page_id"), F.lit("http://a.example/").alias("url"), F.lit("<p>text</p>").alias("html"), *[c for c in CLASHING])
    assert pages.extract_main_text(web).count() == n


def test_stages_keep_clashing_columns(spark):
    d = clashing(spark)
    out, kinds = d, dict(d.dtypes)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
        assert {c: t for c, t in out.dtypes if c in kinds} == kinds
        assert name == "mixing" or out.columns == d.columns
        for r in out.collect():
            assert all(r[c] == f"{c} {r.doc_id}" for c in CLASHING)
    assert {"mix_size", "mix_taken", "mix_position", "mix_words", "mix_target", "mix_source_size"} <= set(out.columns)
    assert {r.doc_id for r in out.collect()} == {0, 1, 5}


def test_licenses_belong_to_texts(spark):
    gpl2, gpl3, mit = (licenses.TEMPLATES[k] for k in ("gpl-2-notice", "gpl-3-notice", "mit-notice"))
    filler = " ".join(f"w{i}" for i in range(60))
    rows = [(None, gpl2), (None, filler), (7, gpl3), (7, mit), (7, mit), (8, f"{gpl2} {filler} {gpl3}"), (9, licenses.TEMPLATES["mit-text"]), (10, f"{mit} {licenses.TEMPLATES['apache-2-notice']}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.template) for r in licenses.scan_licenses(d).collect()}
    assert got == {(None, "gpl-2-notice"), (7, "gpl-3-notice"), (7, "mit-notice"), (8, "gpl-2-notice"), (8, "gpl-3-notice"), (9, "mit-text"), (10, "mit-notice"), (10, "apache-2-notice")}


def test_license_query_keys_rows_apart(spark, tmp_path):
    mit = licenses.TEMPLATES["mit-notice"]
    spark.createDataFrame([(None, mit), (None, "no license here at all"), (3, mit), (3, mit), (3, None)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_licenses) for r in licenses.op8_licenses(spark, f"file://{tmp_path}").collect())
    assert got == [("3", 0), ("3", 1), ("3", 1), ("None", 0), ("None", 1)]


def test_tokens_with_white_space_first():
    import base64
    import json

    part = lambda text: base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")
    for space in ("", "\n", " ", "\t", "\r\n"):
        token = ".".join([part(space + json.dumps({"alg": "HS256"}, indent=1)), part(space + "{}"), "c2ln"])
        assert [k for k, *_ in secrets.find_secrets(f"see {token} there")] == ["jwt"]


@pytest.mark.parametrize("texts", [[], [None], ["a"] * 3])
def test_small_tables(spark, texts):
    d = spark.createDataFrame([(i if i else None, t, None, None, 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    n = len(texts)
    assert brown.score(d, brown.fit(d)).count() == n and secrets.scan_secrets(d).count() == n and repeats.remove_repeats(d).count() == n
    assert decontaminate.decontaminate(d, spark.createDataFrame([], "item_id long, text string")).where("not contaminated").count() == n
    assert language.identify(d, language.train_on(d)).where("lang_pred = 'und'").count() == n
    assert mixing.curriculum_mix(d).count() == n and licenses.scan_licenses(d).count() == 0
    web = d.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    assert sorted(r.text for r in pages.extract_main_text(web).collect()) == sorted(t or "" for t in texts)
    out = d
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert out.count() == 0


def test_ties_and_positions(spark):
    """The curriculum's integral at a position gives the words before it, and equal ids are placed one after the other."""
    rows = [(i // 2, "w " * 10, f"s{i % 3}") for i in range(60)]
    mixed = mixing.training_order(mixing.curriculum_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    assert [r.position for r in mixed] == sorted(r.position for r in mixed)
    for k, (_, a, b) in enumerate(mixing.SCHEDULE):
        own = [r for r in mixed if r.source == f"s{k}"]
        at = 0
        for r in own:
            assert abs((a * r.position + (b - a) * r.position**2 / 2) * r.target - at) < 1e-6
            at += r.words
        assert abs(at - own[0].target) < 1


def test_texts_are_told_by_both_hashes(spark, monkeypatch):
    """Different texts whose first hash agrees stay apart; equal ones don't."""

    class Colliding:
        def __getattr__(self, name):
            return getattr(F, name)

        def xxhash64(self, *columns):
            return F.lit(7).cast("long") if len(columns) == 1 and isinstance(columns[0], str) and columns[0] == "text" else F.xxhash64(*columns)

    monkeypatch.setattr(simhash, "F", Colliding())
    texts = ["one two three four five six", "seven eight nine ten eleven twelve thirteen", "one two three four five six", "one two three four five six"]
    kept = simhash.keep_one_of_each(spark.createDataFrame(list(zip((1, 1, 2, None), texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, texts[0]), (1, texts[1])]


def test_reruns_over_repeated_ids_agree(spark):
    """Rows of one id and size, in any order: the same words are taken of each text."""
    rows = [(1, f"word{i} other", "s") for i in range(9)] + [(None, f"word{i}", None) for i in range(5)]
    taken = []
    for order in (rows, rows[::-1], rows[7:] + rows[:7]):
        mixed = mixing.curriculum_mix(spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3))
        taken.append({(r.document.text, r.taken, tuple(r.passes)) for r in mixed.collect()})
    assert taken[0] == taken[1] == taken[2] and len(taken[0]) == 14
