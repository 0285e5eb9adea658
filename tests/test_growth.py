"""What queries move between tasks and hold in one must not grow faster than their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import admission, projection, retrieval, search


def measured(spark, run) -> dict[str, int]:
    """Bytes that the stages of ``run`` shuffled, and the most that the tasks of one stage held together."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm

    def stages() -> dict:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s for s in (found.apply(i) for i in range(found.size()))}

    before = set(stages())
    run()
    new = [s for k, s in stages().items() if k not in before]
    return {"shuffled": sum(s.shuffleWriteBytes() for s in new), "held": max(s.peakExecutionMemory() for s in new)}


def done(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def test_symbols_that_many_assets_share_are_moved_once(spark):
    n, m = 2000, 500
    symbols = F.transform(F.sequence(F.lit(1), F.lit(m)), lambda i: F.sha2(i.cast("string"), 256))
    none = F.array().cast("array<string>")
    scripts = spark.range(2).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("guid"), F.lit(0).alias("ordinal"), F.when(F.col("id") == 0, symbols).otherwise(F.array(F.lit("b"), F.lit("a"))).alias("symbols"))
    guids = F.when(F.col("id") == 0, F.array(F.lit("none"))).when(F.col("id") == 1, none).when(F.col("id") == 2, F.lit(None).cast("array<string>")).when(F.col("id") == 3, F.array(F.lit("g1"), F.lit("g0"), F.lit("g1"))).otherwise(F.array(F.lit("g0")))
    text = lambda c: F.lit(c).alias
    assets = spark.range(n).select(F.col("id").cast("string").alias("stable_id"), text(None)("guid"), text("p")("path"), text("n")("name"), text("k")("kind"), text("")("content_terms"), none.alias("hierarchy_paths"), F.array(F.lit("own"), F.lit("a")).alias("script_symbols"), guids.alias("script_guids"))
    out = projection.search_documents(assets, scripts, True).select("stable_id", "script_symbols")
    assert measured(spark, lambda: done(out))["shuffled"] < 1_000_000  # 2000 copies of 500 symbols are 64 MB
    got = {r.stable_id: r.script_symbols for r in out.filter("stable_id < 6").collect()}
    assert got["0"] == got["1"] == got["2"] == ["a", "own"]
    assert set(got["3"]) == {"a", "b", "own"} | set(got["4"]) and got["3"] == sorted(got["3"]) and len(got["4"]) == m + 2 == len(got["5"])


def test_sources_that_many_references_share_are_moved_once(spark):
    n, m = 4000, 400
    guid = F.when(F.col("id") == 0, None).when(F.col("id") == 1, "nobody's").when(F.col("id") == 2, "h").otherwise("g")
    references = spark.range(n).select(F.col("id").alias("ref"), guid.alias("guid")).unionByName(spark.sql("SELECT 2L AS ref, 'g' AS guid"))
    claimed = spark.range(m).select(F.lit("g").alias("guid"), F.sha2(F.col("id").cast("string"), 256).alias("source")).unionByName(spark.sql("SELECT 'h' AS guid, 'only' AS source"))
    out = admission.guid_sources(references, claimed)
    assert measured(spark, lambda: done(out))["shuffled"] < 1_000_000  # 4000 copies of 400 sources are 100 MB
    got = {r.ref: r.sources for r in out.filter("ref < 5").collect()}
    assert len(got) == 5 and got[0] == got[1] == [] and got[3] == got[4] == sorted(got[3]) and len(got[3]) == m
    assert got[2] == sorted([*got[3], "only"])
    objects = spark.createDataFrame([("a", ["g", "h", "g"]), ("b", ["x"]), ("c", [])], "address string, guids array<string>")
    named = spark.createDataFrame([("g", "S"), ("g", "R"), ("h", "S")], "guid string, symbol string")
    assert [tuple(r) for r in admission.script_symbols(objects, named).collect()] == [("a", ["R", "S"])]


TERMS = "stable_key string, name_terms string, path_terms string, kind_terms string"


def test_terms_are_counted_in_their_row(spark):
    rows = [("a", "x y x", "y", ""), ("b", None, " z  z ", "k"), ("c", "", "", ""), ("d", "x", "x", "x"), ("d", "x w", None, "x")]
    table = spark.createDataFrame(rows, TERMS)
    got = sorted(tuple(r) for r in search.postings(table).collect())
    assert got == [("k", "kind", "b", 1), ("w", "name", "d", 1), ("x", "kind", "d", 2), ("x", "name", "a", 2), ("x", "name", "d", 2), ("x", "path", "d", 1), ("y", "name", "a", 1), ("y", "path", "a", 1), ("z", "path", "b", 2)]
    assert {(r.stable_key, r.field): r.length for r in search.lengths(table).collect()} == {(r.stable_key, r.field): r.length for r in search.counted(table, search.FIELDS).collect()}
    assert {r.length for r in search.counted(table, search.FIELDS).filter("stable_key = 'd' and field = 'name'").collect()} == {3}
    many = spark.range(0, 60_000, 1, 1).select(F.col("id").cast("string").alias("stable_key"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.sha2((F.col("id") * i).cast("string"), 256)), " ").alias("name_terms"), F.lit("p").alias("path_terms"), F.lit("k").alias("kind_terms"))
    assert measured(spark, lambda: done(search.postings(many)))["held"] < 20_000_000  # some 100 MB for the terms of all rows at once


def test_scores_need_no_lengths_of_all_documents(spark):
    table = spark.range(0, 60_000, 1, 1).select(F.format_string("%06d", "id").alias("stable_key"), F.concat(F.lit("ring x"), F.pmod("id", F.lit(7)).cast("string"), F.repeat(F.lit(" y"), F.pmod("id", F.lit(5)).cast("int"))).alias("name_terms"), F.when(F.col("id") % 300 == 0, "promo a b").otherwise("c").alias("path_terms"), F.lit("k").alias("kind_terms"))
    index = search.counted(table, search.FIELDS)
    found = search.bm25(index, ["ring", "promo"], 60_000, search.lengths(table))
    assert found.collect() and sorted(found.collect()) == sorted(search.bm25(index.drop("length"), ["ring", "promo"], 60_000, search.lengths(table)).collect())
    assert found.count() == 200


def test_postings_of_terms_not_asked_for_are_not_shuffled(spark):
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(150)), lambda i: F.concat(F.lit("w"), F.translate(F.pmod(F.col("id") * 31 + i * i, F.lit(500)).cast("string"), "0123456789", "abcdefghij"))), " ")
    docs = spark.range(0, 3000, 1, 4).select(F.format_string("d%05d", "id").alias("stable_key"), F.concat(F.lit("n"), "id").alias("name"), F.lit("p/q.asset").alias("path"), F.lit("Asset").alias("kind"), F.when(F.col("id") % 100 == 0, F.concat(words, F.lit(" with"))).otherwise(words).alias("content"))
    table, postings = retrieval.index(docs)
    made = []
    assert measured(spark, lambda: done(postings))["shuffled"] < 2_000_000  # the texts once; 6 MB where each term and document is a row
    postings = postings.localCheckpoint()
    assert measured(spark, lambda: made.extend(retrieval.retrieve(table.drop("content", "content_terms"), postings, 3000, retrieval.prepare("t:asset with")).collect()))["shuffled"] < 1_500_000
    assert [r.stable_key for r in made] == [f"d{k:05d}" for k in range(0, 3000, 100)] and all(r.evidence[0].kind == "token" for r in made)


def test_the_first_rows_of_a_large_source_need_no_task_with_all(spark):
    rows = spark.range(0, 150_000, 1, 8).select(F.when(F.col("id") % 1000 == 1, None).when(F.col("id") % 1000 == 0, "small").otherwise("large").alias("source"), F.sha2((F.col("id") % 149_000).cast("string"), 256).alias("src"), (F.col("id") % 3).alias("path_id"))
    kept, cut = projection.capped(rows, "source", ["src", "path_id"], 40, "references")
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()
    for most, limited in ((40, kept), (1100, projection.capped(rows, "source", ["src", "path_id"], 1100, "references")[0])):
        got = [tuple(r) for r in limited.orderBy("source", "ordinal").collect()]
        want = sorted(map(tuple, rows.collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
        each = [[r for r in want if r[0] == s][:most] for s in (None, "large", "small")]
        assert got == [(*r, k) for part in each for k, r in enumerate(part)]
    assert {(r.source, r.omitted) for r in cut.collect()} == {(None, 110), ("small", 110), ("large", 149_660)}


def test_transforms_are_sorted_once(spark, monkeypatch):
    t = spark.range(0, 60_000, 1, 4).select(F.concat(F.lit("t"), "id").alias("src"), F.concat(F.lit("o"), "id").alias("object"), F.concat(F.lit("t"), F.expr("id div 100")).alias("father"), "id")
    fact = lambda rows, field, target: rows.select("src", F.lit(field).alias("field_path"), F.col(target).alias("target"))
    facts = fact(t.filter("id % 7 <> 3"), "m_GameObject", "object").union(fact(t.filter("id >= 100"), "deep.m_Father[0]", "father")).union(fact(t, "m_Other", "father"))
    classes = t.select(F.col("src").alias("address"), F.when(F.col("id") == 50_000, 5).otherwise(4).alias("class_id"))
    names = t.filter("id <> 40000").select(F.col("object").alias("address"), F.concat(F.lit("n"), "id").alias("name"))
    plans = []
    settled = projection.settled
    monkeypatch.setattr(projection, "settled", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settled(df))
    made = projection.hierarchy(facts, classes, names)
    assert plans[0].count("Join ") == 2  # one with the transforms, one with the names: every further one sorts all facts in the same tasks
    got = {r.transform: r.path for r in made.collect()}
    want = {f"t{k}": "/".join(f"n{x}" for x in chain(k)) for k in range(60_000) if k % 7 != 3 and k not in (40_000, 50_000)}
    assert got == want


def chain(k: int) -> list[int]:
    """Ids from the top to ``k``: parents are a hundredth; a chain ends below one without an object."""
    up = [k]
    while up[-1] >= 100 and (up[-1] // 100) % 7 != 3:
        up.append(up[-1] // 100)
    return up[::-1]
