import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from packetloom.llm.language import document_languages
from packetloom.settings import settle

from test_decontamination import plain as contaminated
from test_minhash import plain as near
from test_secret_scan import base

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(7, None, "en", "src1", None), (None, "", None, None, 0), (7, "###", "en", "src1", 3),
                                   *[tuple(r) for r in docs.where("doc_id < 3").collect()]], docs.schema)
    docs = docs.unionByName(extra)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(settle(stage(spark, tables[-1], FOLDER), "stage"))
    rows = [t.collect() for t in tables]
    assert all(t.dtypes == docs.dtypes for t in tables[1:5])
    # Language: what is rejected has no known language.
    kept = {(r.doc_id, r.text) for r in rows[1]}
    told = {r.doc_id: r.kept for r in document_languages(docs.where("doc_id IS NOT NULL AND doc_id <> 7")).collect()}
    assert {r.doc_id for r in rows[1]} - {7} == {d for d, k in told.items() if k}
    assert not kept & {(7, None), (None, ""), (7, "###")}
    # Near-duplicates: one row of each class of what was left.
    pairs = [(r.doc_id, r.text) for r in rows[1]]
    classes, count = near(pairs)
    assert len(rows[2]) == count and {r.doc_id for r in rows[2]} == {c for _, c, _ in classes}
    # Benchmark passages: documents with a hit are gone, the others are whole.
    hits = {d: n for d, _, n, _ in contaminated([(r.doc_id, r.text) for r in rows[2]], items)}
    assert sorted(r.doc_id for r in rows[3]) == sorted(d for d, n in hits.items() if not n)
    # Secrets: replaced, nothing else changed.
    before = {r.doc_id: r for r in rows[3]}
    for r in rows[4]:
        assert not base(r.text) and r.n_chars == len(r.text)
        if not base(before[r.doc_id].text):
            assert r.text == before[r.doc_id].text
    # Ids as the library gives them.
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in rows[4]}
    assert {r.doc_id: r.ids for r in rows[5]} == {
        d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    assert 100 < len(rows[5]) < len(rows[1]) < len(rows[0])


def test_run_is_registered(spark):
    import __spark_entry__

    jobs = __spark_entry__.queries()
    assert jobs["pipeline"] is corpus_pipeline.run
    assert {n.split("_")[0] for n in jobs if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert jobs["pipeline"](spark, FOLDER).count() > 100
