import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_line_dedup import brute as aligned
from test_line_dedup import words as made_words
from test_ngram_join import brute as components_of
from test_secret_scan import brute as secrets_of
from test_tokens import FILES, PAIRS, valid


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages(spark, data, docs):
    said = stage("language ID")(spark, docs, data)
    assert said.columns == docs.columns and said.count() >= 0.97 * docs.count()

    deduped = stage("line dedup")(spark, said, data)
    texts = {r.doc_id: r.text for r in said.collect()}
    want = {i: t for i, t in aligned(texts).items() if t.split() or t == texts[i]}
    assert {r.doc_id: r.text for r in deduped.collect()} == want
    assert deduped.columns == docs.columns

    joined = stage("n-gram Jaccard join")(spark, deduped, data)
    assert {r.doc_id for r in joined.collect()} == {c for _, c in components_of(want, 5, 80).values()}

    clean = stage("secret scans")(spark, joined, data).collect()
    before = {r.doc_id: r.text for r in joined.collect()}
    assert len(clean) == len(before)
    for r in clean:
        assert not secrets_of(r.text) and r.n_chars == len(r.text)
        if not secrets_of(before[r.doc_id]):
            assert r.text == before[r.doc_id]

    rows = stage("best-fit packing")(spark, spark.createDataFrame(clean, docs.schema), data).collect()
    library = PAIRS[FILES[1]][1]
    lengths = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in clean}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == lengths
    assert valid(rows) <= -(-sum(lengths.values()) // 2048) + 2


def test_run_equals_its_stages(spark, data, docs):
    step = docs
    for _, f in corpus_pipeline.STAGES:
        step = f(spark, step, data)
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(corpus_pipeline.run(spark, data).collect()) == key(step.collect())


def test_repeated_rows_stay_once(spark, data, table):
    text = made_words(random.Random(1), 40)
    rows = stage("n-gram Jaccard join")(spark, table([text, text, "x"]).unionByName(table([text])), data).collect()
    assert sorted(r.doc_id for r in rows) == [0, 2]


def test_texts_of_one_id_are_documents_of_their_own(spark, data, table):
    rng = random.Random(2)
    a, b, c = (made_words(rng, 40) for _ in range(3))
    rows = table([a, b, c, a + " end"]).unionByName(table([b, c])).withColumn("doc_id", F.expr("if(doc_id = 3, 1, doc_id)"))
    kept = stage("n-gram Jaccard join")(spark, rows, data).collect()
    assert len(kept) == 3
    assert {frozenset(t for t in (a, b, c) if r.text.startswith(t)) for r in kept} == {frozenset([t]) for t in (a, b, c)}


def test_odd_and_empty_tables(spark, data, docs, odd):
    extra = ["id", "key", "component_id", "kept", "piece", "sequence_id", "language", "block", "gone"]
    some = docs.limit(30).withColumns({c: docs.source for c in extra})
    step = some.unionByName(odd.withColumns({c: odd.source for c in extra}).withColumn("doc_id", odd.doc_id + 10_000))
    step = step.unionByName(some.limit(3)).unionByName(some.limit(2).withColumn("doc_id", some.doc_id * 0 - 5).selectExpr("cast(null as long) as doc_id", *some.columns[1:]))
    for name, f in corpus_pipeline.STAGES[:-1]:
        after = f(spark, step, data)
        assert after.columns == step.columns, name
        step = spark.createDataFrame(after.collect(), step.schema)
    assert step.count() >= 25
    assert corpus_pipeline.STAGES[-1][1](spark, step, data).count() >= step.count()
    empty = docs.filter("false")
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, data).count() == 0, name
