"""Semantics that the tables don't reach: terms, ranking order, ignore rules, graphs, changes, streams."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import changes, graph, search, selection, sinks
from graphloom.streaming import coalesce


def one(spark, expr, *values):
    row = spark.range(1).select(*[F.lit(v).alias(f"v{i}") for i, v in enumerate(values)])
    return row.select(expr(*[F.col(f"v{i}") for i in range(len(values))]).alias("out")).first().out


@pytest.mark.parametrize(("value", "want"), [("PlayerHTTPServer2D_icon.prefab", "player http server 2 d icon prefab"), ("  a//B ", "a b"), ("", ""), ("ＡＢＣ１２", "abc 12"), ("eÉa", "e éa"), ("x1y", "x 1 y"), ("ABc", "a bc"), ("it's", "it s")])
def test_terms(spark, value, want):
    assert one(spark, text.to_terms, value) == want == text.terms_of(value)


@pytest.mark.parametrize(("q", "f", "want"), [("button", "button", "exact"), ("but", "button", "prefix"), ("button", "primary button icon", "token"), ("tto", "button", "substring"), ("pbi", "primary button icon", "abbreviation"), ("p b", "primary button icon", "abbreviation"), ("buton", "button", None), (" ", "x", None)])
def test_match_kinds(spark, q, f, want):
    assert one(spark, text.match_kind, q, f) == want


def test_versions_sort(spark):
    names = ["2020.3.1f1", "5.6.0", "2020.3.1b9", "2020.3.1a1", "2020.3.10f1", "2020.3.1p2", "2020.3.1f2 (abc)", "2020.3.1t4"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    got = [r.v for r in df.orderBy(text.version_key(F.col("v"))).collect()]
    assert got == ["5.6.0", "2020.3.1a1", "2020.3.1b9", "2020.3.1f1", "2020.3.1f2 (abc)", "2020.3.1p2", "2020.3.1t4", "2020.3.10f1"]
    assert one(spark, text.version_key, "x.1") is None


def test_paths_and_guids(spark):
    assert one(spark, text.external_path, r".\./archive:/./CAB-Ab\C.assets//") == "cab-ab/c.assets"
    assert one(spark, text.guid, "01234567-89AB-cdef-0123-456789abcdef") == "0123456789abcdef0123456789abcdef"
    assert one(spark, text.guid, "0123") is None
    assert one(spark, lambda v: text.slug(v, 5), "  Ab c!d e") == "ab-c" and one(spark, lambda v: text.slug(v, 5), "!!") == "unnamed"
    assert one(spark, lambda v: text.container_match(v, "A?c*Z"), "abc/x/z") and not one(spark, lambda v: text.container_match(v, "bc*"), "abcd")


def test_highlights_are_bytes_of_the_source(spark):
    got = one(spark, lambda v: text.highlights(v, F.array(F.lit("icon"), F.lit("é"), F.lit("co"))), "Élan Icon")
    assert [(r.start, r.end) for r in got] == [(0, 2), (6, 10)]


@pytest.mark.parametrize(("raw", "terms", "kind", "prefix", "diagnostics"), [
    ('t:mat in:"My Dir" a "b c"', [("a", False), ("b c", True)], "Material", "My Dir", []),
    ('"t:prefab"', [("t:prefab", True)], None, None, []),
    ("t: x", [("x", False)], None, None, ["missing_filter_value"]),
    ("t:cs type:mat", [], "Script", None, ["duplicate_filter"]),
    ("t:nope", [], None, None, ["unsupported_type_filter"]),
    ('"open', [("open", True)], None, None, ["unterminated_quote"]),
    ('""', [("", True)], None, None, ["empty_quoted_term"]),
    ("  ", [], None, None, ["empty_query"]),
    ("T:CS foo:bar", [("foo:bar", False)], "Script", None, []),
])
def test_query_language(raw, terms, kind, prefix, diagnostics):
    q = search.parse(raw)
    assert (q.terms, q.kind, q.prefix, q.diagnostics) == (terms, kind, prefix, diagnostics)


DOCS = [("k1", "Button", "Assets/UI/Button.prefab", "Prefab"), ("k2", "ButtonBar", "Assets/UI/ButtonBar.prefab", "Prefab"), ("k3", "PrimaryButtonIcon", "Assets/UI/Icons/PrimaryButtonIcon.png", "Texture"), ("k4", "Rebuttoned", "Assets/X/Rebuttoned.cs", "Script"), ("k5", "Other", "Assets/Button/Other.mat", "Material")]


@pytest.fixture(scope="module")
def docs(spark):
    return lambda rows=DOCS: search.prepared(spark.createDataFrame(rows, "stable_key string, name string, path string, kind string"), False)


def keys(df):
    return [(r.stable_key, r.match_kind) for r in df.orderBy("rank").collect()]


def test_ranking_order(docs):
    assert keys(search.search(docs(), "button")) == [("k1", "exact"), ("k2", "prefix"), ("k3", "token"), ("k5", "token"), ("k4", "substring")]
    assert keys(search.search(docs(list(reversed(DOCS))), "button")) == keys(search.search(docs(), "button"))
    assert keys(search.search(docs(), "buton")) == [("k1", "fuzzy"), ("k2", "fuzzy"), ("k3", "fuzzy"), ("k5", "fuzzy")]
    assert keys(search.search(docs(), '"buton"')) == [] and keys(search.search(docs(), "bu")) != []
    assert keys(search.search(docs(), "pbi")) == [("k3", "abbreviation")]
    assert keys(search.search(docs(), "button t:png")) == [] and keys(search.search(docs(), "button t:tex")) == [("k3", "token")]
    assert keys(search.search(docs(), "button in:assets/x")) == [("k4", "substring")]
    assert keys(search.search(docs(), "button other")) == [("k5", "token")]
    assert [k for k, _ in keys(search.search(docs(), "t:prefab", 1))] == ["k1"]
    assert keys(search.search(docs(), "  ")) == []


def test_counts_and_limits(docs):
    row = search.match_count(docs(), search.parse("button"), 1).first()
    assert (row.matches, row.relation) == (5, "exact")
    assert search.candidate_limit(25, False) == 125 and search.candidate_limit(25, True) == 200


RULES = ["subtree:Library", "!glob:Library/*/keep.txt", "glob:**/*.tmp", "!exact:a/b.tmp"]


@pytest.mark.parametrize(("path", "folder", "want"), [("Library", True, "ExcludeButDescend"), ("Library/x/keep.txt", False, "Include"), ("Library/x/y/keep.txt", False, "ExcludeButDescend"), ("a/c.tmp", False, "ExcludeButDescend"), ("c.tmp", False, "ExcludeButDescend"), ("a/b.tmp", False, "Include"), ("src", True, "Include"), ("Librarian", True, "Include")])
def test_ignore_rules(spark, path, folder, want):
    assert one(spark, lambda p, f: selection.decide(p, f, selection.parse_rules(RULES)), path, folder) == want
    assert one(spark, lambda p, f: selection.decide(p, f, selection.parse_rules(["subtree:Library"])), "Library/x", True) == "ExcludeAndPrune"


@pytest.mark.parametrize("line", ["Library", "exact:/a", "exact:a/../b", "exact:a*", "glob:a", "glob:a**/b", "glob:**/**", "subtree:c:/x", "exact:a//b", "glob:[a]*"])
def test_bad_rules(line):
    with pytest.raises(ValueError, match="line 1"):
        selection.parse_rules([line])


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def test_cycles_against_brute_force(spark):
    rng, edges = random.Random(6), []
    for g in range(8):  # eight graphs side by side
        edges += [(f"{g}{rng.randrange(7)}", f"{g}{rng.randrange(7)}") for _ in range(rng.randrange(4, 16))]
    edges += [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c")]
    nodes = {x for e in edges for x in e}
    reach = {a: {b for x, b in edges if x == a} for a in nodes}
    for k in nodes:
        for i in nodes:
            if k in reach[i]:
                reach[i] |= reach[k]
    want = {(min(b for b in reach[a] if a in reach[b]), a) for a in nodes if a in reach[a]}
    assert {(r.component, r.address) for r in graph.cycles(frame(spark, edges)).collect()} == want


def test_closures_and_lineages(spark):
    chain = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")])
    start = spark.createDataFrame([("a",)], "address string")
    assert {(r.address, r.depth) for r in graph.closure(chain, start).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert [(r.address, r.truncated) for r in graph.limited_closure(chain, start, 2).collect()] == [("a", True), ("b", True)]
    assert [r.truncated for r in graph.limited_closure(chain, start, 4).collect()] == [False] * 4
    parents = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "address string, parent string")
    names = spark.createDataFrame([(n, n.upper()) for n in "abcxy"], "address string, name string")
    assert {(r.address, r.path, r.cyclic) for r in graph.lineages(parents, names).collect()} == {("a", "A", False), ("b", "A/B", False), ("c", "A/B/C", False), ("x", None, True), ("y", None, True)}


def test_guarded_changes(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "address string, v int").withColumn("digest", changes.digest("v"))
    good = base.select("address", F.col("digest").alias("expected"), (F.col("v") + 1).alias("v"))
    assert changes.prepare(base, good).count() == 2
    with pytest.raises(ValueError, match="guard"):
        changes.prepare(base, good.withColumn("expected", F.lit("x")))
    assert changes.content_digest(base, "address", "v") == changes.content_digest(base.orderBy(F.desc("v")), "address", "v")


def test_generations_recover(spark, tmp_path):
    g = changes.Generations(spark, f"file://{tmp_path}/g")
    df = spark.range(5)
    assert g.publish(df, "id") == "published"
    df.write.parquet(f"{tmp_path}/g/gen-00000009-lost")
    assert g.recover() == ["gen-00000009-lost"] and g.read().count() == 5


def brute_batches(times, quiet, longest):
    out = []
    for t in sorted(times):
        if out and t < min(out[-1][1] + quiet, out[-1][0] + longest):
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


def test_batches(spark):
    rng = random.Random(1)
    rows = [(u, rng.randrange(3000)) for u in "ab" for _ in range(60)]
    got = coalesce.batches(spark.createDataFrame(rows, "u string, t long"), "u", "t").collect()
    for u in "ab":
        assert sorted((r.first, r["last"], r.n) for r in got if r.u == u) == brute_batches([t for x, t in rows if x == u], 75, 750)


def test_debounced_stream(spark, tmp_path):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(u, start + dt.timedelta(milliseconds=rng.randrange(20_000))) for u in "ab" for _ in range(200)] + [("z", start + dt.timedelta(hours=1))]
    schema = "owner string, at timestamp"
    rows.sort(key=lambda r: r[1])
    for k in range(4):
        spark.createDataFrame(rows[k * 101 : (k + 1) * 101], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = coalesce.debounced(stream, "owner", "at").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(300)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    ms = lambda t: int(t.timestamp() * 1000 + 0.5)
    for u in "ab":
        assert sorted((r.first, r["last"], r.n) for r in got if r.owner == u) == brute_batches([ms(t) for x, t in rows if x == u], 75, 750)


def test_sinks(spark):
    facts = spark.createDataFrame([('a"b', "f", "Resolved", "c\\d"), ("x", "g", "Missing", None)], "src string, field_path string, state string, target string")
    assert [r.line for r in sinks.dot_edges(facts).collect()] == ['  "a\\"b" -> "c\\\\d" [label="f"];']
    rows, more = sinks.limited(facts, "src", 1)
    assert more and rows.count() == 1 and not sinks.limited(facts, "src", 2)[1]
    page = spark.createDataFrame([(i, "x" * 10) for i in range(5)], "k int, line string")
    assert sinks.within_bytes(page, "k", "line", 35).count() == 3
