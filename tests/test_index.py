"""Staged search, extraction, admission, mutation, generations and watching: what SQL rows don't show."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import values
from graphloom.operators import admission, changes, extraction, graph, mutation, projection, retrieval, sinks, view
from graphloom.service import Service
from graphloom.streaming import watch

DOCS = "stable_key string, name string, path string, kind string, content string"


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        ("a", "Button", "Assets/UI/Button.prefab", "Prefab", "click here"), ("b", "Primary Button Icon", "Assets/UI/PrimaryButtonIcon.prefab", "Prefab", ""), ("c", "Slider", "Assets/UI/Slider.cs", "Script", "moves the buttonbar"),
        ("d", "Door", "Assets/World/Door.mat", "Material", "a button opens it"), ("e", "PlayerCtrl", "Assets/Player/PlayerCtrl.cs", "Script", "class PlayerCtrl"),
    ]
    table, postings = retrieval.index(spark.createDataFrame(rows, DOCS))
    return table.cache(), postings.cache(), len(rows)


def hits(out):
    return [(r.stable_key, r.match_kind) for r in out.matches.orderBy("rank").collect()]


def test_ranking_over_the_index(found):
    out = retrieval.execute(*found, "button")
    assert hits(out) == [("a", "exact"), ("b", "token"), ("d", "token"), ("c", "substring")]
    assert (out.count, out.relation, out.fallback_used, out.truncated) == (4, "exact", False, False)
    assert hits(retrieval.execute(*found, "but"))[0] == ("a", "prefix")
    assert hits(retrieval.execute(*found, "button t:script")) == [("c", "substring")]
    assert hits(retrieval.execute(*found, '"button" in:assets/world')) == [("d", "token")]
    first = out.matches.orderBy("rank").first()
    assert [tuple(x) for x in first.name_ranges] == [(0, 6)] and [tuple(x) for x in first.path_ranges] == [(10, 16)]
    few = retrieval.execute(*found, "button", 2)
    assert len(hits(few)) == 2 and few.truncated and few.count == 4


def test_fallback_finds_typos_and_swaps(found):
    for word in ("buton", "bytton"):
        out = retrieval.execute(*found, word)
        assert out.fallback_used and hits(out)[0] == ("a", "fuzzy"), word
    # a swap is one edit for retrieval and two for the score of a name, so only content shows it
    assert hits(retrieval.execute(*found, "buttno")) == [("d", "fuzzy")]
    assert hits(retrieval.execute(*found, '"buton"')) == []
    assert not retrieval.execute(*found, "bu").fallback_used


@pytest.mark.parametrize(("source", "tokens", "want"), [("Ｐlayer ctrl", ["player"], [(0, 8)]), ("cafe\u0301 bar", ["café", "bar"], [(0, 6), (7, 10)]), ("ﬁle", ["fi"], [(0, 3)]), ("aXa", ["a", "xa"], [(0, 1), (1, 3)]), ("abc", ["zz", ""], []), ("x" * 40_000, ["x"], [])])
def test_highlights_in_any_script(source, tokens, want):
    from graphloom.functions.text import normalized_ranges

    assert normalized_ranges(source, tokens) == want


def test_queries_that_are_refused(found):
    for raw, code in (("", "empty_query"), ('"a', "unterminated_quote"), ("x" * 5000, "query_byte_limit_exceeded"), ("a " * 129, "query_term_limit_exceeded"), ("a.b.c " * 100, "retrieval_term_limit_exceeded"), ("t:what", "unsupported_type_filter")):
        out = retrieval.execute(*found, raw)
        assert code in out.diagnostics and not hits(out) and out.relation == "exact", raw
        assert retrieval.severity(code) == "error"
    assert retrieval.execute(*found, "button", 0).relation == "lower_bound"


def test_ingest_says_what_it_leaves_out(spark):
    p = retrieval.prepare("button")
    ddl = "stable_key string, name string, path string, kind string, retrieval_score long, evidence array<struct<term_index:int,kind:string>>"
    rows = [("a", "n", "p", "File", 9, [(0, "token")]), ("a", "m", "p", "File", 12, [(0, "substring")]), ("b", "x" * 20_000, "p", "File", 8, []), ("c", "n", "p", "File", 7, [(3, "token")]), ("d", "n", "p", "File", 6, [(0, "token")] * 300)]
    rows += [(f"z{i}", "n", "p", "File", 1, []) for i in range(4)]
    kept, codes, provided = retrieval.ingest(spark.createDataFrame(rows, ddl), p)
    got = {r.stable_key: r for r in kept.collect()}
    assert set(got) == {"a", "z0", "z1", "z2", "z3"} and got["a"].retrieval_score == 12 and len(got["a"].evidence) == 2 and provided == 9
    assert codes == ["candidate_field_byte_limit_exceeded", "candidate_evidence_limit_exceeded", "invalid_retrieval_evidence", "duplicate_candidate_key"]
    _, codes, provided = retrieval.ingest(spark.createDataFrame(rows, ddl), p, {"candidate_inputs": 8, "total_candidate_bytes": 30})
    assert provided == 8 and {"candidate_input_limit_exceeded", "candidate_total_byte_limit_exceeded"} <= set(codes)


def test_hits_within_bytes(found):
    out = retrieval.execute(*found, "button")
    one = len(json.dumps(out.matches.orderBy("rank").first().asDict(recursive=True), separators=(",", ":")))
    assert retrieval.hits_within(out.matches, one + 10).count() == 1


def test_traversals_stop_at_their_limits(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e")], "src string, dst string")
    start = spark.createDataFrame([("a",), ("a",)], "address string")
    seen = lambda t: sorted((r.address, r.depth) for r in t.nodes.collect())
    full = graph.traverse(edges, start)
    assert seen(full) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)] and full.edges_examined == 6 and not full.truncated
    t = graph.traverse(edges, start, max_depth=1)
    assert seen(t) == [("a", 0), ("b", 1), ("c", 1)] and t.depth_limited
    t = graph.traverse(edges, start, max_nodes=2)
    assert seen(t) == [("a", 0), ("b", 1)] and t.nodes_limited
    t = graph.traverse(edges, start, max_edges=3)
    assert seen(t) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)] and t.edges_limited and t.edges_examined == 3
    assert seen(graph.traverse(edges, start, reverse=True))[-1] == ("d", 1)


def test_cycles_without_the_small_way(spark, monkeypatch):
    rows = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [("n60", "n40"), ("x", "x"), ("p", "q"), ("q", "r"), ("r", "p"), ("q", "n0")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    want = {(f"n{i}", "n40") for i in range(40, 61)} | {("x", "x"), ("p", "p"), ("q", "p"), ("r", "p")}
    assert {(r.address, r.component) for r in graph.cycles(edges).collect()} == want
    monkeypatch.setattr(graph, "WITHIN", 0)
    assert {(r.address, r.component) for r in graph.cycles(edges).collect()} == want
    least, more = graph.least_cycles(graph.cycles(edges), 2)
    assert {r.component for r in least.collect()} == {"n40", "p"} and more


def test_ancestors(spark):
    parents = spark.createDataFrame([(f"{i}", f"{i + 1}") for i in range(37)], "address string, parent string")
    up = graph.closure_up(parents, spark.createDataFrame([("0",), ("20",)], "address string")).collect()
    assert {(r.start, r.above) for r in up} == {("0", f"{i}") for i in range(38)} | {("20", f"{i}") for i in range(20, 38)}


OBJECTS = "address string, source string, num long, class_id int, class_name string, name string"


def test_selections_and_runs(spark, tmp_path):
    objects = spark.createDataFrame([(f"s:{i}", "s" if i < 4 else "t", i, 49 if i % 2 else 1, "Text", f"n{i}") for i in range(8)], OBJECTS)
    pick = lambda **k: sorted(r.address for r in extraction.selected(objects, extraction.Selection(**k)).collect())
    assert len(pick()) == 8 and pick(kind="sources", sources=["t"]) == ["s:4", "s:5", "s:6", "s:7"] and pick(kind="addresses", addresses=["s:1", "s:1"]) == ["s:1"]
    with pytest.raises(LookupError, match="s:99: Missing"):
        pick(kind="addresses", addresses=["s:1", "s:99"])
    entries = spark.createDataFrame([("a/x", "Resolved", "s:1"), ("a/y", "Resolved", "s:1"), ("b/x", "Missing", None)], "asset_path string, state string, target string")
    s = extraction.Selection("bundle_container", pattern="*/x")
    assert [r.address for r in extraction.selected(objects, s, entries=entries).collect()] == ["s:1"] and extraction.container_occurrences(entries, "a/").count() == 2
    with pytest.raises(ValueError, match="incomplete"):
        extraction.selected(objects, s, entries=entries, complete=False)
    edges = spark.createDataFrame([("s:0", "s:1"), ("s:1", "s:2")], "src string, dst string")
    with pytest.raises(ValueError, match="incomplete"):
        extraction.selected(objects, extraction.Selection("reference_traversal", addresses=["s:0"], max_depth=1), edges)

    made = extraction.plan(objects, extraction.Request(class_ids=[49], limit=3, prefix="out")).cache()
    assert [r.ordinal for r in made.orderBy("ordinal").collect()] == [0, 1, 2]
    payloads = objects.select("address", F.when(F.col("num") != 3, F.encode("name", "utf-8")).alias("payload"))
    none, no_files = made.limit(0).withColumn("digest", F.lit("")), spark.createDataFrame([], "path string, digest string")
    folder = f"file://{tmp_path}/run"
    first = extraction.execute(extraction.decide(made, none, no_files), payloads, folder).cache()
    assert [r.status for r in first.orderBy("ordinal").collect()] == ["Written", "Failed", "Written"]
    good = first.filter("status = 'Written'")
    there = good.select("path", "digest")
    assert (tmp_path / "run" / extraction.artifact_by(first, ordinal=0).first().path).read_text() == "n1"
    again = extraction.execute(extraction.decide(made, good, there), payloads.fillna({}).withColumn("payload", F.coalesce("payload", F.lit(bytearray(b"z")))), folder)
    assert [r.status for r in again.orderBy("ordinal").collect()] == ["Resumed", "Written", "Resumed"]
    cut = extraction.execute(extraction.decide(made, none, no_files), payloads, f"file://{tmp_path}/cut", "stop_in_plan_order")
    assert [r.status for r in cut.orderBy("ordinal").collect()] == ["Written", "Failed"]
    in_the_way = there.withColumn("digest", F.lit("other"))
    assert [r.action for r in extraction.decide(made, none, in_the_way, "replace").orderBy("ordinal").collect()] == ["replace", "write", "replace"]
    with pytest.raises(ValueError, match="decoded"):
        extraction.plan(objects, extraction.Request(representation="require_decoded"))
    assert extraction.canonical_json(made, "ordinal").count() == 3


def test_admission_of_one_source(spark):
    sources = spark.createDataFrame([], admission.SOURCES_DDL)
    one = admission.load(sources, "a", "Yaml", "f1", 3)
    assert one.count() == 1 and admission.revision(one) != admission.revision(sources)
    with pytest.raises(ValueError, match="AlreadyLoaded"):
        admission.load(one, "a", "Yaml", "f1", 3)
    assert admission.unload(one, "a").count() == 0
    with pytest.raises(ValueError, match="NotLoaded"):
        admission.unload(one, "b")
    batch = spark.createDataFrame([(0, "load", "b", "Yaml", "f", 1), (1, "unload", "zz", None, None, None)], f"ordinal int, op string, {admission.SOURCES_DDL}")
    strict, report = admission.admit(one, batch)
    assert strict.count() == 1 and admission.admission_counts(report).first().not_loaded == 1
    assert admission.admit(one, batch, "lenient")[0].count() == 2


PROPS = {"m_Name": "x", "m_LocalPosition": {"x": 0}, "xs": [1, 2], "ref": {"fileID": 1}, "e": {"m_PersistentCalls": {"m_Calls": [{"m": 1}]}}, "m_SavedProperties": {"m_TexEnvs": [{"_Main": {"m_Texture": {"fileID": 0}}}]}, "m_Resource": {"m_Source": "a", "m_Offset": 0, "m_Size": 5}}
RAW = json.dumps(PROPS)


def test_every_kind_of_change(spark, tmp_path):
    d = values.semantic_digest
    payload = "new bytes"
    digest = hashlib.sha256(payload.encode()).hexdigest()
    operations = [
        {"kind": "field_replace", "target": "o", "path": "m_Name", "value_digest": d("x"), "replacement": "y"}, mutation.retarget("o", "ref", {"fileID": 1}, {"fileID": 2}),
        {"kind": "sequence_edit", "target": "o", "path": "xs", "value_digest": d([1, 2]), "edit": {"kind": "move", "from": 0, "to": 1}}, *mutation.transform("o", PROPS, position={"x": 1}),
        mutation.event_call("o", PROPS, "e", {"kind": "insert", "index": 1, "value": {"m": 2}}), mutation.material_texture("o", PROPS, "_Main", {"fileID": 9}), mutation.audio_resource("o", PROPS, "b", 4, 6),
        {"kind": "schema_replace", "target": "p", "value_digest": d({"a": 1}), "replacement": {"b": 2}}, {"kind": "unsafe_raw_replace", "target": "q", "expected_raw_digest": hashlib.sha256(b'{"r": 1}').hexdigest(), "payload": digest, "acknowledgement": mutation.ACKNOWLEDGEMENT},
        {"kind": "resource_replace", "target": "r", "path": "data", "value_digest": d("old"), "payload": digest},
    ]
    plan = mutation.Plan(operations, "rev", {digest: payload})
    again = mutation.read_json(plan.canonical())
    assert again == plan and again.digest() == plan.digest()
    objects = spark.createDataFrame([("o", RAW, None), ("p", '{"a": 1}', None), ("q", '{"r": 1}', None), ("r", '{"data": "old"}', None), ("s", "{}", None)], "address string, props string, schema_digest string")
    with pytest.raises(ValueError):
        mutation.prepare(objects, mutation.table(spark, mutation.Plan([dict(operations[0], value_digest="0")])))
    safe = mutation.Plan([o for o in operations if o["target"] != "q"], "rev", {digest: payload})
    patch = {r.address: json.loads(r.props) for r in mutation.prepare(objects, mutation.table(spark, safe)).collect()}
    assert patch["o"]["m_Name"] == "y" and patch["o"]["ref"] == {"fileID": 2} and patch["o"]["xs"] == [2, 1] and patch["o"]["m_LocalPosition"] == {"x": 1}
    assert patch["o"]["e"]["m_PersistentCalls"]["m_Calls"] == [{"m": 1}, {"m": 2}] and patch["o"]["m_SavedProperties"]["m_TexEnvs"][0]["_Main"]["m_Texture"] == {"fileID": 9}
    assert patch["o"]["m_Resource"]["m_Size"] == 6 and patch["p"] == {"b": 2} and patch["r"] == {"data": payload} and "s" not in patch
    raw = mutation.applied('{"r": 1}', None, dict(operations[8], _payload=payload))
    assert raw == ("ok", payload) and mutation.applied("{}", None, dict(operations[8], _payload=payload))[0] == "StaleRaw"

    g = changes.Generations(spark, f"file://{tmp_path}/g")
    cols = ["address", "props"]
    assert g.publish(objects, *cols) == "published"
    base = g.current()["digest"]
    prepared = mutation.prepare(objects, mutation.table(spark, safe))
    assert mutation.commit(g, prepared, "other", *cols) == "stale"
    assert mutation.commit(g, prepared, base, *cols) == "published" and mutation.commit(g, prepared, base, *cols) == "stale"
    assert json.loads(g.read().filter("address = 'p'").first().props) == {"b": 2}
    assert mutation.commit(g, prepared.limit(0), base, *cols) == "no_effect"
    assert [mutation.reindex_state(x, "a", "b") for x in "abc"] == ["Apply", "AlreadyApplied", "ObserveCurrent"]


@pytest.mark.parametrize("text", ["[]", '{"version": 2, "operations": []}', '{"version": 3, "version": 3}', '{"version": 3, "operations": [{"ordinal": 1, "action": {}}]}', '{"version": 3, "operations": [{"ordinal": 0, "action": {"kind": "x"}}]}', '{"version": 3, "payloads": {"00": "a"}}', '{"version": 3, "more": 1}'])
def test_plans_that_are_refused(text):
    with pytest.raises(ValueError):
        mutation.read_json(text)


def test_plans_in_yaml():
    plan = mutation.read_yaml("version: 3\nbase_revision: r\noperations:\n- ordinal: 0\n  action:\n    kind: schema_replace\n    target: o\n    value_digest: d\n    replacement: {a: 1}\n")
    assert plan.operations[0]["replacement"] == {"a": 1}
    with pytest.raises(ValueError):
        mutation.read_yaml("version: 3\n---\nversion: 3\n")
    with pytest.raises(ValueError):
        mutation.read_yaml("version: &a 3\n")


def test_sequence_edits():
    assert mutation.edited([1, 2, 3], {"kind": "insert", "index": 3, "value": 4}) == [1, 2, 3, 4] and mutation.edited([1, 2, 3], {"kind": "move", "from": 0, "to": 2}) == [2, 3, 1] and mutation.edited([1], {"kind": "clear"}) == []
    for edit in ({"kind": "remove", "index": 3}, {"kind": "insert", "index": 5, "value": 0}, {"kind": "move", "from": 0, "to": 3}):
        with pytest.raises(IndexError):
            mutation.edited([1, 2, 3], edit)


def test_two_writers_and_a_crash(spark, tmp_path):
    a, b = (changes.Generations(spark, f"file://{tmp_path}/g") for _ in range(2))
    assert a.publish(spark.range(3), "id") == "published"
    first, second = a.stage(spark.range(4), "id"), b.stage(spark.range(5), "id")
    assert b.commit(second) == "published" and a.commit(first) == "stale" and b.commit(second) == "published"
    assert a.read().count() == 5
    with pytest.raises(ValueError):
        a.abandon(second)
    assert {e["folder"] for e in a.discover()} == {first["folder"], second["folder"]}
    assert a.recover() == [first["folder"]] and not a.discover() and b.read().count() == 5
    crashed = a.stage(spark.range(9), "id")
    (tmp_path / "g" / f"CURRENT-{crashed['version']:08d}.json").write_text("")  # cut off within the pointer
    assert b.read().count() == 5 and b.commit(crashed) == "published" and a.read().count() == 9
    b.finalize(crashed)
    assert not b.discover() and a.publish(spark.range(9), "id") == "no_change"


def test_the_writer_tries_again(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    calls, pauses, now = [], [], [0.0]

    def apply(scope, rows):
        calls.append((scope, rows.count()))
        if len(calls) < 3:
            raise OSError("away")

    w = watch.Writer(apply, sleep=pauses.append, clock=lambda: now[0])
    w.start(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), f"{tmp_path}/c").awaitTermination(120)
    assert calls == [("reconcile", 3), ("full", 3), ("full", 3)] and pauses == [0.25, 0.5] and w.log[-1][1] == "Succeeded"
    w.handle(spark.range(1), 1)
    now[0] = watch.RECONCILE_SECONDS
    w.handle(spark.range(1), 2)
    assert [c[0] for c in calls[3:]] == ["changed_paths", "reconcile"]
    assert [watch.pause_ms(n) for n in (1, 2, 7, 8, 99)] == [250, 500, 16_000, 30_000, 30_000]
    rows = spark.createDataFrame([("a", "Running", 0), ("b", "Succeeded", 0), ("c", "Queued", 90)], "operation string, state string, at_ms int")
    assert {r.operation: r.state for r in watch.expired(rows, F.lit(100), 50).collect()} == {"a": "Expired", "b": "Succeeded", "c": "Queued"}


def test_a_watched_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("abc")
    q = watch.watch(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.path.rsplit("/", 1)[-1], r.length) for r in spark.table("seen").collect()] == [("a.txt", 3)]


def test_cursors():
    token = values.cursor("g1", "p", "q", "last")
    assert values.continued(token, "g1", "p", "q") == ("ok", "last") and values.continued(token, "g2", "p", "q")[0] == "StaleCursor"
    assert values.continued(token, "g1", "p", "other")[0] == values.continued("%%", "g1", "p", "q")[0] == "InvalidCursor"


def test_values(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(values.float_bits(F.col("x"))).collect()] == [0, -(2**63), 0x3FF8000000000000, None]
    assert [r[0] for r in df.select(values.float_bits(F.col("x"), True)).collect()] == [0, 0x80000000, 0x3FC00000, None]
    one = spark.createDataFrame([('{"name": "n", "z": null}', "0" * 31 + "A")], "p string, g string")
    v = F.parse_json("p")
    r = one.select(values.object_name(v).alias("n"), values.has_property(v, "z").alias("z"), values.has_property(v, "q").alias("q"), values.guid_bytes(F.col("g")).alias("g"), values.semantic_digest_of(F.col("p")).alias("d")).first()
    assert (r.n, r.z, r.q, len(r.g)) == ("n", True, False, 16) and r.d == values.semantic_digest({"z": None, "name": "n"})
    assert [values.at_path({"a": [1, {"b": 2}]}, p)[0] for p in ("", "a[1].b", "a.b", "a[5]", "c", "a[0][0]")] == ["ClassRoot", "ok", "ExpectedObject", "IndexOutOfBounds", "MissingField", "ExpectedArray"]
    with pytest.raises(ValueError):
        values.parse_path("a..b")


def test_text_analysis_and_caps(spark):
    rows = [("a.cs", "Script", b"namespace X.Y { class PlayerCtrl {} }\r\nenum Kind { }"), ("b.txt", "File", b"\xff\xfe"), ("c.txt", "File", "abé".encode())]
    got = {r.path: r for r in projection.analyze_text(spark.createDataFrame([(p, k, bytearray(c)) for p, k, c in rows], "path string, kind string, content binary"), 60).collect()}
    assert got["a.cs"].script_symbols == ["Kind", "PlayerCtrl", "X.Y"] and "player ctrl" in got["a.cs"].terms and got["b.txt"].incomplete and got["c.txt"].terms == "abé"
    cut = projection.analyze_text(spark.createDataFrame([("c", "File", bytearray("abé".encode()))], "path string, kind string, content binary"), 3).first()
    assert cut.terms == "ab" and cut.truncated and cut.bytes_scanned == 2
    assert projection.walk_value(1, {"m_Name": "n", "m_Script": {"fileID": 5, "guid": "0" * 32}, "deep": [{"m_Text": "t"}], "x": "no"})[:2] == (["n", "5", "0" * 32, "t"], ["0" * 32])
    assert projection.walk_value(1, {"a": [1] * 50}, 10)[3]


def test_service(spark, found):
    table, postings, n = found
    keys = spark.createDataFrame([(f"o{i}", "f", "in", "object:x") for i in range(5)], "src string, field_path string, direction string, key string")
    fails = [False]

    def reindex(scope):
        if fails[0]:
            raise OSError("no")
        return table, postings, keys

    s = Service(spark, reindex)
    call = lambda **r: s.call(r)
    assert call(operation="search", query="x")["error"] == {"code": "not_ready", "message": "no index yet", "retryable": True}
    done = call(operation="reindex_admit", scope="full", idempotency_key="k")["ok"]
    assert done["state"] == "Succeeded" and call(operation="reindex_admit", scope="full", idempotency_key="k")["ok"] == done
    assert call(operation="reindex_admit", scope="reconcile", idempotency_key="k")["error"]["code"] == "idempotency_conflict"
    assert call(operation="status")["ok"]["documents"] == n
    assert [h["stable_key"] for h in call(operation="search", query="button", limit=1)["ok"]["hits"]] == ["a"]
    assert call(operation="search", query="button", limit=5000)["error"]["code"] == "invalid_request"
    assert call(operation="suggest", prefix="t:pre")["ok"]["suggestions"] == ["t:Prefab"] and call(operation="suggest", prefix="in:Assets/W")["ok"]["suggestions"] == ["in:Assets/World/"]
    page = call(operation="references", key="object:x", direction="in", limit=3)["ok"]
    assert page["total"] == 5 and not page["complete"]
    rest = call(operation="references", key="object:x", direction="in", limit=3, cursor=page["cursor"])["ok"]
    assert len(rest["hits"]) == 2 and rest["complete"] and not set(rest["hits"]) & set(page["hits"])
    assert call(operation="references", key="object:y", direction="in", cursor=page["cursor"])["error"]["code"] == "invalid_cursor"
    call(operation="reindex_admit", scope="full")
    assert call(operation="references", key="object:x", direction="in", cursor=page["cursor"])["error"]["code"] == "stale_cursor"
    queued = call(operation="reindex_admit", run=False)["ok"]["id"]
    assert call(operation="reindex_cancel", id=queued)["ok"]["state"] == "Cancelled" and call(operation="reindex_cancel", id=queued)["error"]["code"] == "operation_control_forbidden"
    assert call(operation="reindex_status", id="zz")["error"]["code"] == "operation_not_found" and call(operation="reindex_wait", id=queued)["ok"]["state"] == "Cancelled"
    fails[0] = True
    assert call(operation="reindex_admit")["error"]["code"] == "index_build_failed" and call(operation="what")["error"]["code"] == "invalid_request"
    assert call(operation="capabilities", protocol=9)["error"]["code"] == "incompatible_protocol" and len(call(operation="capabilities")["ok"]["operations"]) == 10
    call(operation="shutdown")
    assert call(operation="status")["error"]["code"] == "not_ready"


def test_views_and_kept_tables(spark, tmp_path):
    sources = spark.createDataFrame([("a", "Yaml", "f", 5), ("b", "Yaml", "g", 2), ("b", "Yaml", "g", 2)], admission.SOURCES_DDL)
    objects = spark.createDataFrame([("a:1", "a", 1, 4, "T", "n")], OBJECTS)
    v = view.View(sources, objects, contents=spark.createDataFrame([("a", bytearray(b"hello"))], "locator string, content binary"))
    assert [v.source(x) for x in ("a", "b", "c", "../x")] == ["Resolved", "Ambiguous", "Missing", "Invalid"] and v.source_length("a") == 5 and v.source_length("z") is None
    assert v.read_range("a", 1, 3) == ("Resolved", b"ell") and v.read_range("a", 3, 3)[0] == "InvalidRange" and v.read_range("q", 0, 1)[0] == "Missing"
    assert v.object("a:1").count() == 1 and v.objects_of(4).count() == 1 and v.inventory().filter("objects = 0").count() == 2
    made = []
    kept = view.Kept(spark, f"file://{tmp_path}/kept")
    for _ in range(2):
        df, there = kept.by_content("n", objects, ["address"], lambda d: made.append(1) or d.select("address"))
    assert made == [1] and there and df.count() == 1
    (tmp_path / "in" / "Library").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("x")
    (tmp_path / "in" / "Library" / "b.txt").write_text("x")
    assert [r.path for r in view.discover(spark, f"{tmp_path}/in").collect()] == ["a.txt"]


def test_projections_are_written_in_order(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "address string, class_id int")
    facts = spark.createDataFrame([("a", "f", "Resolved", "b"), ("a", "f", "Resolved", "b"), ("b", "g", "Missing", None)], "src string, field_path string, state string, target string")
    assert sinks.write_projection(nodes, facts, "json_lines", f"{tmp_path}/j", max_nodes=2) == {"nodes": 1}
    text = "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part-*")))
    assert [json.loads(x)["record"] for x in text.splitlines()] == ["header", "node", "node", "fact", "fact"]
    sinks.write_projection(nodes, facts, "dot", f"{tmp_path}/d")
    text = "".join(p.read_text() for p in sorted((tmp_path / "d").glob("part-*")))
    assert text.splitlines() == ["digraph references {", '  "a" -> "b" [label="f"];', "}"]
