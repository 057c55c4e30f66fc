import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetloom.llm.language import (
    TextModel, declared_in, document_languages, domain_of, fit, host_of, identify, page_languages, suffix_of,
    trigram_codes, visible_text, with_known_language)
from packetloom.llm.texts import flat

FOLDER = "/root/testdata/sf0.01"


def test_scores_do_not_depend_on_the_slice():
    texts = ["Hello wörld", "", "x", "été 12 !", None, "abc"]
    counts = np.random.default_rng(1).integers(0, 50, (3, 1 << 16))
    model = TextModel(["a", "b", "c"], counts)
    whole, letters = model.score(pa.array(texts))
    for k, text in enumerate(texts):
        one, n = model.score(pa.array([text], pa.string()))
        assert np.allclose(one[0], whole[k]) and n[0] == letters[k]
    assert letters.tolist() == [11, 0, 1, 5, 0, 3]
    codes, good = trigram_codes(*flat(pa.array(["aB", "ab"])))
    assert codes[0] == codes[3] and codes[1] == codes[4] and good.tolist() == [True, True, False] * 2


def test_address_parts(spark):
    cases = [("https://u@Blog.Example.org:80/en?x", "blog.example.org", "example.org", "org"),
             ("example.de/a", "example.de", "example.de", "de"), ("src3", "src3", None, None), ("", "", None, None)]
    df = spark.createDataFrame([(a,) for a, *_ in cases], "a string").select("a", host_of(F.col("a")).alias("h"))
    got = [tuple(r) for r in df.select("a", "h", domain_of(F.col("h")), suffix_of(F.col("h"))).collect()]
    assert got == cases


def test_markup(spark):
    df = spark.createDataFrame([("<!doctype html><HTML class=x lang='DE-at'><style>p{}</style><p>a&amp;b</p><!-- c --></html>",),
                                ("<html><p lang=fr>x</p>",), (None,)], "h string")
    rows = df.select(declared_in(F.col("h")).alias("d"), visible_text(F.col("h")).alias("t")).collect()
    assert [r.d for r in rows] == ["de", None, None]
    assert rows[0].t.split() == ["a", "b"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_held_out_accuracy_of_the_text_alone(docs):
    train, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = fit(train.select("text", F.col("lang").alias("language")))
    bare = rest.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("declared"),
                       F.lit(None).cast("string").alias("address"))
    told = {r.id: r.language for r in identify(bare, model).collect()}
    truth = {r.doc_id: r.lang for r in rest.select("doc_id", "lang").collect()}
    assert sum(told[d] == truth[d] for d in truth) >= 0.98 * len(truth)


def test_fusion_of_evidence(spark, docs):
    model = fit(docs.select("text", F.col("lang").alias("language")))
    some = docs.select("text", "lang").limit(400)
    known = some.select(F.lit(0).cast("long").alias("id"), "text", F.col("lang").alias("declared"),
                        F.concat(F.lit("http://www."), F.col("lang"), F.lit("-site.example."), F.col("lang")).alias("address"))
    short = [(1, "le 1", "fr", "http://a.fr-site.example.fr/"), (2, "12345 !!", "fr", "x.fr"), (3, None, None, None),
             (4, "", "de", "y.de"), (None, "der und die", "de", None), (5, "a an", None, "http://en-site.example.en"),
             (5, "a an", None, "http://en-site.example.en")]
    rows = known.unionByName(spark.createDataFrame(short, "id long, text string, declared string, address string"))
    got = [r for r in identify(rows, model).collect() if r.id != 0]
    by = {r.id: r for r in got}
    assert len(got) == 7 and by[1].language == "fr" and by[5].language == "en" and by[None].language == "de"
    assert not by[2].kept and not by[3].kept and not by[4].kept and by[2].text_language is None
    assert all(0 < r.posterior <= 1 + 1e-9 for r in got)


def test_odd_tables(spark):
    rows = [(1, "abc def ghi", None, None), (None, None, "en", "s"), (2, "", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS id", "2 AS best")
    got = document_languages(docs)
    assert got.count() == 3
    none = docs.where("false")
    assert document_languages(none).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert not any(r.kept for r in document_languages(unlabelled).collect())


def test_clean_documents_stay(spark, docs):
    extra = spark.createDataFrame([(5000, "", "en", "src1", 0), (5001, "123 ### 456", "fr", "src2", 11), (5002, None, None, None, None)],
                                  docs.schema)
    mixed = docs.unionByName(extra)
    kept = with_known_language(mixed)
    assert kept.dtypes == mixed.dtypes
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {5000, 5001, 5002} and len(ids) >= 995


def test_languages_without_labels_go(spark, docs):
    draw = random.Random(5)
    strange = ["".join(draw.choice(letters) for _ in range(size)) for size in (60, 200, 1000) for letters in (
        "abcdefghijklmnopqrstuvwxyz   ", "абвгдежзиклмнопрстуфхцчшщэюя   ", "αβγδεζηθικλμνξοπρστυφχψω   ",
        "".join(map(chr, range(0x4E00, 0x5E00)))) for _ in range(5)]
    rows = docs.select("doc_id", "text", "lang", F.lit("h").alias("source"))
    truth = {r.doc_id: r.lang for r in rows.collect()}
    for hidden in ("es", "en"):
        gibberish = spark.createDataFrame([(10_000 + k, t, None, "h") for k, t in enumerate(strange)], rows.schema)
        told = {r.doc_id: r for r in document_languages(
            rows.withColumn("lang", F.expr(f"nullif(lang, '{hidden}')")).unionByName(gibberish)).collect()}
        held_out = [told[d] for d in truth if truth[d] == hidden]
        assert sum(not r.kept and r.language is None for r in held_out) >= 0.98 * len(held_out)
        assert not any(r.kept for d, r in told.items() if d >= 10_000)
        clean = [told[d] for d in truth if truth[d] != hidden]
        assert sum(r.kept for r in clean) >= 0.995 * len(clean)


def test_texts_in_two_known_languages_stay(docs):
    parts = {k: docs.where(f"lang = '{k}' AND n_chars > 400").select(F.substring("text", 1, 400).alias(k)).first()[k]
             for k in ("en", "fr")}
    model = fit(docs.select("text", F.col("lang").alias("language"))).value
    scores, _ = model.score(pa.array([" ".join(parts.values())]))
    assert scores[0].argmax() < len(model.languages)


def test_labels_count_as_their_primary_language(docs):
    tags = F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).when(
        F.col("doc_id") % 3 == 1, F.concat("lang", F.lit("-X"))).otherwise(F.concat(F.lit(" "), "lang", F.lit("_yy")))
    plain = fit(docs.select("text", F.col("lang").alias("language"))).value
    messy = fit(docs.select("text", tags.alias("language"))).value
    assert messy.languages == plain.languages == ["de", "en", "es", "fr"]
    texts = pa.array([r.text for r in docs.limit(20).collect()])
    assert np.allclose(messy.score(texts)[0], plain.score(texts)[0])


def test_copies_do_not_fill_the_sample(docs):
    some = docs.select("text", F.col("lang").alias("language"))
    copies = some.unionByName(some.limit(1).crossJoin(docs.sparkSession.range(3000)).select("text", "language"))
    texts = pa.array([r.text for r in docs.limit(20).collect()])
    assert np.allclose(fit(copies).value.score(texts)[0], fit(some).value.score(texts)[0])


def test_any_number_of_languages(spark):
    draw = random.Random(8)
    names = ["q" + "".join(chr(97 + k // 26 ** p % 26) for p in range(2)) for k in range(230)]
    rows = []
    for k, name in enumerate(names):
        own = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(12)]
        rows += [(3 * k + j, " ".join(draw.choice(own) for _ in range(60)), name, "s") for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    told = {r.doc_id: r for r in document_languages(docs).collect()}
    assert all(told[d].language == name and told[d].kept for d, _, name, _ in rows)


def test_pages(spark, docs):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r.page_id: r for r in page_languages(pages, docs).collect()}
    declared = {r.page_id: r.d for r in pages.select("page_id", declared_in(F.col("html")).alias("d")).collect()}
    assert got.keys() == declared.keys()
    told = [d for d in declared if declared[d]]
    assert sum(got[d].language == declared[d] for d in told) >= 0.9 * len(told)
