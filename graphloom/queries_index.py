"""More queries: index projection and staged search, extraction, admission, mutation, watching; each beside its SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from graphloom.functions import text, values
from graphloom.media import textures
from graphloom.operators import admission, extraction, graph, mutation, projection, retrieval, search, view
from graphloom.plans import catalog
from graphloom.plans.catalog import EDGES_SQL, OBJECTS_SQL, SEARCH_SQL, table
from graphloom.plans.settle import settled
from graphloom.queries import ORACLES, PATH_SQL, STATE_SQL, TERMS_SQL, _reach, _start, query, resolved
from graphloom.streaming import coalesce, watch


def framed(*columns: str) -> str:
    """SQL of ``changes.digest``."""
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN 'n;' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) || ';' END" for c in columns) + ")"


def joined(df, *columns: str):
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


# --- staged search ----------------------------------------------------------------------------------------------


def _assets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.lit("Texts"), "source", "lang", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".asset").otherwise(".cs")))
    rows = d.select(F.format_string("doc:%08d", "doc_id").alias("stable_key"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), path.alias("path"), F.col("text").alias("content"))
    return rows.withColumn("kind", text.kind_of_path(F.col("path")))


_ASSETS_SQL = """SELECT printf('doc:%08d', doc_id) AS stable_key, 'doc' || doc_id AS name, 'Texts/' || source || '/' || lang || '/doc' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.asset' ELSE '.cs' END AS path,
  CASE WHEN doc_id % 2 = 0 THEN 'Asset' ELSE 'Script' END AS kind, text AS content FROM documents"""
_POSTINGS_SQL = "SELECT f AS field, t AS term, stable_key, count(*) AS tf, sum(count(*)) OVER (PARTITION BY stable_key, f) AS length FROM (" + " UNION ALL ".join(
    f"SELECT stable_key, '{f}' AS f, unnest(string_split({TERMS_SQL.format(f)}, ' ')) AS t FROM ({_ASSETS_SQL})" for f in ("name", "path", "kind", "content")
) + ") WHERE t <> '' GROUP BY f, t, stable_key"


def _index(spark, sf_dir):
    """The search table and its postings, written once: a query reads its own terms of them and no text again."""
    made, postings = retrieval.index(_assets(spark, sf_dir))
    made = settled(made.drop("content", "content_terms"))  # what postings hold already
    return made, settled(postings), made.count()


def _retrieve_sql(token: str, where: str, limit: int) -> str:
    """Candidates of one token: exact terms by BM25, others that begin with it by their boost, the best of each kind a field."""
    exact = "CASE p.field " + " ".join(f"WHEN '{f}' THEN {b[0]}" for f, b in retrieval.BOOSTS.items()) + " END"
    prefix = "CASE p.field " + " ".join(f"WHEN '{f}' THEN {b[1]}" for f, b in retrieval.BOOSTS.items()) + " END"
    bm25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))"
    return f"""WITH p AS MATERIALIZED ({_POSTINGS_SQL}),
      s AS (SELECT p.stable_key, p.field, p.term = '{token}' AS exact, max(CAST(round(CASE WHEN p.term = '{token}' THEN {exact} * ({bm25}) ELSE {prefix} END * 1e6) AS BIGINT)) AS part
        FROM (SELECT p.*, m.mean, d.df, (SELECT CAST(count(*) AS DOUBLE) FROM documents) AS n FROM p JOIN (SELECT field, avg(length) AS mean FROM (SELECT DISTINCT field, stable_key, length FROM p) GROUP BY field) m USING (field)
          JOIN (SELECT term, field, count(*) AS df FROM p GROUP BY term, field) d USING (term, field) WHERE starts_with(p.term, '{token}')) p GROUP BY 1, 2, 3),
      k AS (SELECT stable_key, CAST(sum(part) AS BIGINT) AS retrieval_score, min(CASE WHEN field = 'content' THEN CASE WHEN exact THEN 'token' ELSE 'substring' END END) AS held, max(CASE WHEN field = 'content' AND exact THEN 1 ELSE 0 END) AS word FROM s GROUP BY stable_key)
      SELECT a.stable_key, a.name, a.path, a.kind, k.retrieval_score, CASE WHEN word = 1 THEN 'token' ELSE held END AS held FROM ({_ASSETS_SQL}) a JOIN k USING (stable_key) WHERE {where} ORDER BY retrieval_score DESC, stable_key LIMIT {limit}"""


@query(_retrieve_sql("with", "lower(kind) = 'asset'", 201))
def retrieve_candidates(spark, sf_dir):
    found = retrieval.retrieve(*_index(spark, sf_dir), retrieval.prepare("t:asset with"))
    return found.select("stable_key", "name", "path", "kind", "retrieval_score", F.array_join(F.transform("evidence", lambda e: e["kind"]), ",").alias("held"))


def _field_rank(f: str, q: str, boost: int) -> str:
    t = TERMS_SQL.format(f)
    kind = lambda x: f"CASE WHEN {x} = '{q}' THEN 0 WHEN starts_with({x}, '{q}') THEN 1 WHEN list_contains(regexp_split_to_array({x}, '\\s+'), '{q}') THEN 2 WHEN contains({x}, '{q}') THEN 3 WHEN contains(array_to_string(list_transform(string_split({x}, ' '), lambda w: w[1]), ''), '{q}') THEN 4 ELSE 9 END"
    return f"least({kind(f'lower({f})')}, {kind(t)}) * 10 - {boost}"


@query(f"""SELECT CAST(row_number() OVER (ORDER BY kind_rank, field_boost DESC, retrieval_score DESC, lower(path), lower(name), stable_key) AS BIGINT) AS rank, stable_key, (['exact','prefix','token','substring','abbreviation'])[kind_rank + 1] AS match_kind, field_boost, retrieval_score
FROM (SELECT *, CAST((best + 9) // 10 AS INTEGER) AS kind_rank, CAST(((best + 9) // 10) * 10 - best AS INTEGER) AS field_boost FROM (
  SELECT *, least({_field_rank('name', 'with', 4)}, {_field_rank('path', 'with', 3)}, {_field_rank('kind', 'with', 2)}, CASE held WHEN 'token' THEN 2 WHEN 'substring' THEN 3 ELSE 9 END * 10 - 1) AS best FROM (SELECT * FROM ({_retrieve_sql('with', "lower(kind) = 'asset'", 200)})))) WHERE kind_rank < 9 ORDER BY rank LIMIT 40""")
def search_staged(spark, sf_dir):
    out = retrieval.execute(*_index(spark, sf_dir), "t:asset with", 40)
    return out.matches.select(F.col("rank").cast("long").alias("rank"), "stable_key", "match_kind", "field_boost", "retrieval_score")


@query(f"""SELECT DISTINCT term, CASE WHEN term = 'ane' THEN 0 WHEN starts_with(term, 'ane') THEN 1 ELSE 2 END AS kind FROM ({_POSTINGS_SQL}) WHERE (starts_with(term, 'ane') OR damerau_levenshtein(term, 'ane') <= 1) AND strlen(term) = length(term)""")
def vocabulary_matches(spark, sf_dir):
    _, postings, _ = _index(spark, sf_dir)
    tokens = retrieval.prepare("ane").tokens(retrieval.FALLBACK)
    # the SQL function counts edits of bytes, so plain terms are compared
    return retrieval.vocabulary_matches(postings, tokens).filter(r"term rlike '^[\\x00-\\x7F]*$'").select("term", "kind")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -9223372036854775808 ELSE CAST(round(value * 1e6) AS BIGINT) END AS score FROM events")
def quantised_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", retrieval.quantised(F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 5 == 0, float("inf")).otherwise(F.col("value"))).alias("score"))


# --- projection -------------------------------------------------------------------------------------------------

_CUT = "list_max(list_filter(range(0, least(length(text), 300) + 1), lambda i: strlen(substr(text, 1, CAST(i AS INTEGER))) <= 300))"


@query(f"""SELECT path, {TERMS_SQL.format('t')} AS terms, CAST(strlen(t) AS BIGINT) AS bytes_scanned, truncated, incomplete FROM (
  SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 9 = 0 THEN '' WHEN strlen(text) > 300 THEN substr(text, 1, CAST({_CUT} AS INTEGER)) ELSE text END AS t, doc_id % 9 <> 0 AND strlen(text) > 300 AS truncated, doc_id % 9 = 0 AS incomplete FROM documents)""")
def analyze_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    bad = F.concat(F.encode("text", "utf-8").substr(F.lit(1), F.lit(10)), F.lit(bytearray(b"\xff\xfe")), F.encode("text", "utf-8"))
    sources = d.select(F.col("doc_id").cast("string").alias("path"), F.lit("File").alias("kind"), F.when(F.col("doc_id") % 9 == 0, bad).otherwise(F.encode("text", "utf-8")).alias("content"))
    return projection.analyze_text(sources, 300, ascii_only=True).select("path", "terms", "bytes_scanned", "truncated", "incomplete")


@query(f"SELECT count(*) AS sources, count(*) FILTER (NOT incomplete) AS text_sources, CAST(sum(bytes_scanned) AS BIGINT) AS text_bytes_scanned, count(*) FILTER (truncated) AS truncations, count(*) FILTER (incomplete) AS incomplete FROM ({ORACLES['analyze_text']})")
def analysis_metrics(spark, sf_dir):
    return projection.analysis_metrics(analyze_text(spark, sf_dir))


@query("""SELECT 't:customer:' || c_custkey AS transform, r_name || '/' || n_name || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0 AND c_custkey % 10 <> 0
UNION ALL SELECT 't:customer:' || c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 4 = 0 AND c_custkey % 10 <> 0
UNION ALL SELECT 't:nation:' || n_nationkey, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0 UNION ALL SELECT 't:region:' || r_regionkey, r_name FROM region""")
def transform_hierarchy(spark, sf_dir):
    """Transforms over customers, nations and regions; some have no object or no named one, which ends a chain."""
    names = catalog.objects(spark, sf_dir).filter("source in ('region', 'nation', 'customer')")
    names = names.filter("not (source = 'nation' and num % 4 = 0)").select("address", "name")
    t = names.select(F.concat(F.lit("t:"), "address").alias("src"), F.col("address").alias("object"))
    t = t.filter("not (object like 'customer:%0')")
    held = t.select("src", F.lit("m_GameObject").alias("field_path"), F.col("object").alias("target"))
    edges = catalog.edges(spark, sf_dir).filter("src like 'nation:%' or (src like 'customer:%' and dst like 'nation:%')")
    father = edges.select(F.concat(F.lit("t:"), "src").alias("src"), F.lit("m_Father").alias("field_path"), F.concat(F.lit("t:"), "dst").alias("target"))
    facts = held.union(father)
    classes = facts.select(F.col("src").alias("address")).distinct().withColumn("class_id", F.lit(4))
    return projection.hierarchy(facts, classes, names).select("transform", "path")


@query(f"""WITH s AS (SELECT md5(n_name) AS guid, list_sort(list(DISTINCT s_name)) AS symbols FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0 GROUP BY n_name),
a AS (SELECT p_partkey, 'part:' || p_partkey AS stable_id, p_name AS path, md5(n_name) AS g, p_type FROM part JOIN nation ON n_nationkey = p_size % 25)
SELECT stable_id, {TERMS_SQL.format('path')} AS path_terms, array_to_string(list_sort(list_distinct(list_concat([p_type], coalesce(symbols, [])))), ',') AS script_symbols FROM a LEFT JOIN s ON a.g = s.guid""")
def project_documents(spark, sf_dir):
    p, n, s = (table(spark, sf_dir, t) for t in ("part", "nation", "supplier"))
    guid = F.md5(F.col("n_name").cast("binary"))
    scripts = s.filter("s_suppkey % 3 = 0").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.array_sort(F.collect_set("s_name")).alias("symbols"))
    scripts = scripts.select(guid.alias("guid"), F.lit(0).alias("ordinal"), "symbols").union(scripts.select(guid, F.lit(-1), F.array(F.lit("older"))))
    none = F.array().cast("array<string>")
    assets = p.join(n, F.col("n_nationkey") == F.col("p_size") % 25).select(
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("stable_id"), F.lit(None).cast("string").alias("guid"), F.col("p_name").alias("path"), F.col("p_brand").alias("name"), F.lit("Asset").alias("kind"),
        F.lit("").alias("content_terms"), none.alias("hierarchy_paths"), F.array("p_type").alias("script_symbols"), F.array(guid, F.lit("f" * 32)).alias("script_guids"),
    )
    return joined(projection.search_documents(assets, scripts, True).select("stable_id", "path_terms", "script_symbols"), "script_symbols")


@query(f"SELECT 'container:' || {framed('source_path', 'asset_path', 'file_id', 'path_id', 'ordinal')} AS stable_id, name, container_source_path FROM (SELECT 'bundle-' || p_size AS source_path, p_type || '/' || p_name AS asset_path, 0 AS file_id, p_partkey AS path_id, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INTEGER) AS ordinal, p_name AS name, 'bundle-' || p_size AS container_source_path FROM part)")
def container_documents(spark, sf_dir):
    from graphloom.operators import inventory

    p = inventory.occurrences(table(spark, sf_dir, "part").withColumn("one", F.lit(1)), "p_size", "one", "p_partkey")
    entries = p.select(F.concat(F.lit("bundle-"), F.col("p_size").cast("string")).alias("source_path"), F.concat_ws("/", "p_type", "p_name").alias("asset_path"), F.lit(0).alias("file_id"), F.col("p_partkey").alias("path_id"), F.col("occurrence").alias("ordinal"))
    return projection.container_documents(entries, True).select("stable_id", "name", "container_source_path")


@query("""SELECT 'bundle:' || CAST(p_partkey AS VARCHAR) AS address, CAST(0 AS INTEGER) AS ordinal, p_name AS asset_path, CAST(0 AS BIGINT) AS file_id, p_partkey AS path_id, CASE WHEN p_size % 2 = 0 THEN 'Resolved' ELSE 'Missing' END AS state FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'bundle:' || CAST(p_partkey AS VARCHAR), 1, p_type, 7, p_partkey + 1, 'Unloaded' FROM part WHERE p_partkey % 3 = 0""")
def container_binding(spark, sf_dir):
    """Container values of either shape walked, and their entries joined with the outcome of their references."""
    p = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0")
    address = F.concat(F.lit("bundle:"), F.col("p_partkey").cast("string")).alias("address")
    pair = F.format_string('["%s", {"preload": 1, "asset": {"m_FileID": 0, "m_PathID": %d}}]', "p_name", "p_partkey")
    keyed = F.format_string('{"first": "%s", "second": {"asset": {"m_FileID": 7, "m_PathID": %d}}}', "p_type", F.col("p_partkey") + 1)
    props = F.concat(F.lit('{"m_Name": "b", "m_Container": ['), pair, F.lit(", "), keyed, F.lit(', ["lost", 3]]}'))
    entries = projection.container_entries(projection.walk_values(p.select(address, F.lit(142).alias("class_id"), props.alias("props"))))
    fact = lambda k, file_id, path_id, state: p.select(address.alias("src"), F.lit(f"m_Container[{k}].second.asset").alias("field_path"), F.lit(file_id).cast("long").alias("file_id"), path_id.alias("path_id"), state.alias("state"), F.lit(None).cast("string").alias("target"))
    facts = fact(0, 0, F.col("p_partkey"), F.when(F.col("p_size") % 2 == 0, "Resolved").otherwise("Missing")).union(fact(1, 7, F.col("p_partkey") + 1, F.lit("Unloaded")))
    return projection.bind_containers(entries, facts).drop("target")


@query(f"""SELECT source_path, CAST(ordinal AS INTEGER) AS ordinal, src, 'reference:' || {framed('source_path', 'src', 'field_path', 'ordinal')} AS stable_id, CASE WHEN target IS NULL THEN 'path:' || path_id ELSE 'object:' || {framed('target')} || ',path:' || path_id END AS incoming_keys, 'object:' || {framed('src')} AS outgoing_keys
FROM (SELECT source AS source_path, src, field_path, path_id, target, row_number() OVER (PARTITION BY source ORDER BY src, field_path, path_id) - 1 AS ordinal FROM ({STATE_SQL})) WHERE ordinal < 40""")
def reference_documents(spark, sf_dir):
    return joined(projection.reference_documents(_facts(spark, sf_dir), 40)[0], "incoming_keys", "outgoing_keys").select("source_path", "ordinal", "src", "stable_id", "incoming_keys", "outgoing_keys")


def _facts(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = resolved(spark, sf_dir).withColumnRenamed("source", "source_path")
    return rows.select("source_path", none.alias("source_guid"), "src", F.lit(None).cast("long").alias("file_id_in_source"), "field_path", "target", none.alias("target_source"), none.alias("raw_guid"), F.lit(None).cast("long").alias("raw_file_id"), "path_id")


@query(f"SELECT source, 'references' AS category, CAST(40 AS BIGINT) AS emitted, count(*) - 40 AS omitted FROM ({STATE_SQL}) GROUP BY source HAVING count(*) > 40")
def projection_truncations(spark, sf_dir):
    return projection.reference_documents(_facts(spark, sf_dir), 40)[1]


@query(f"SELECT path, CAST(row_number() OVER (ORDER BY string_split(path, '/'), stable_key) AS INTEGER) AS place FROM ({SEARCH_SQL}) ORDER BY place LIMIT 200")
def portable_order(spark, sf_dir):
    from pyspark.sql import Window

    order = [projection.portable_order(F.col("path")), F.col("stable_key")]
    return catalog.search_documents(spark, sf_dir).orderBy(*order).limit(200).select("path", F.row_number().over(Window.orderBy(*order)).alias("place"))


# --- graph ------------------------------------------------------------------------------------------------------


@query(f"SELECT component, address FROM ({ORACLES['cycles']}) WHERE component IN (SELECT DISTINCT component FROM ({ORACLES['cycles']}) ORDER BY component LIMIT 3)")
def least_cycles(spark, sf_dir):
    return graph.least_cycles(graph.cycles(catalog.edges(spark, sf_dir)), 3)[0]


@query("SELECT lower(p_type) || '/' || lower(p_name) AS claim, min('s' || p_partkey) AS source FROM part GROUP BY 1 HAVING count(*) = 1 UNION ALL SELECT 'x/' || lower(n_name), 'n' || n_nationkey FROM nation")
def unique_paths(spark, sf_dir):
    p, n = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    sources = p.select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("source"), F.concat(F.lit("./"), "p_type", F.lit("\\"), "p_name").alias("path"))
    sources = sources.union(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("archive:/X/"), "n_name")))
    paths, _, _ = graph.identity_index(sources, sources.select(F.lit("g").alias("guid"), "source"))
    return graph.unique_path_source(paths)


# --- extraction -------------------------------------------------------------------------------------------------


@query(f"""SELECT row_number() OVER (ORDER BY address) - 1 AS ordinal, address, replace({PATH_SQL}, '.yaml', '.raw.bin') AS path, 'binary_raw' AS artifact FROM ({OBJECTS_SQL}) JOIN ({_reach("customer:11", True, 4)}) r USING (address) WHERE class_id IN (2, 3)""")
def extraction_plan(spark, sf_dir):
    s = extraction.Selection("reference_traversal", addresses=["customer:11"])
    edges = catalog.edges(spark, sf_dir)
    reached = graph.closure(edges, _start(spark, "customer:11"), 4).select(F.col("address").alias("src"))
    within = edges.join(reached, "src", "left_semi").join(reached.select(F.col("src").alias("dst")), "dst", "left_semi")
    made = extraction.plan(catalog.objects(spark, sf_dir), extraction.Request(s, class_ids=[2, 3], prefix="out"), within)
    return made.select(F.col("ordinal").cast("long").alias("ordinal"), "address", "path", "artifact")


@query("SELECT 'supplier:' || s_suppkey AS address, CASE WHEN s_suppkey % 5 = 0 THEN 'gone' ELSE 'changed' END AS problem FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 UNION ALL SELECT 'supplier:new', 'unplanned'")
def plan_verify(spark, sf_dir):
    objects = catalog.objects(spark, sf_dir)
    request = extraction.Request(extraction.Selection("sources", sources=["supplier"]))
    made = extraction.plan(objects, request)
    later = objects.filter("not (source = 'supplier' and num % 5 = 0)").withColumn("name", F.when((F.col("source") == "supplier") & (F.col("num") % 7 == 0), "moved").otherwise(F.col("name")))
    later = later.union(spark.createDataFrame([("supplier:new", "supplier", 10**9, 4, "supplier", "new")], objects.schema))
    return extraction.verify(later, request, made, extraction.witness_of(made))


@query("""SELECT CAST(k AS BIGINT) AS ordinal, 'part:' || k AS address, CASE WHEN k % 4 = 0 THEN 'Resumed' WHEN k % 4 = 1 THEN 'SkippedExisting' WHEN k % 11 = 0 THEN 'Failed' ELSE 'Written' END AS status FROM (SELECT p_partkey AS k FROM part)
WHERE k <= (SELECT min(p_partkey) FROM part WHERE p_partkey % 4 > 1 AND p_partkey % 11 = 0)""")
def extract_manifest(spark, sf_dir):
    k = F.col("p_partkey")
    planned = table(spark, sf_dir, "part").select(k.cast("long").alias("ordinal"), F.concat(F.lit("part:"), k.cast("string")).alias("address"), F.col("p_name").alias("name"), F.concat_ws("-", "p_name", k.cast("string")).alias("path"))
    n = F.col("ordinal") % 4
    manifest = planned.filter(n == 0).select("ordinal", "address", "path", F.md5(F.col("path").cast("binary")).alias("digest"))
    present = planned.filter(n < 2).select("path", F.md5(F.col("path").cast("binary")).alias("digest"))
    decided = extraction.decide(planned, manifest, present, "skip")
    return extraction.executed(decided, F.col("ordinal") % 11 == 0, "stop_in_plan_order").select("ordinal", "address", "status")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'text' ELSE 'yaml' END WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'audio' ELSE 'binary_raw' END WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'texture_png' ELSE 'yaml' END WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 'sprite_png' ELSE 'binary_raw' END ELSE 'yaml' END AS artifact FROM part")
def representation_choice(spark, sf_dir):
    n = F.col("p_partkey") % 5
    class_id = F.when(n == 0, 49).when(n == 1, 83).when(n == 2, 28).when(n == 3, 213).otherwise(1)
    return table(spark, sf_dir, "part").select("p_partkey", extraction.representation(class_id, F.when(n % 2 == 0, "yaml").otherwise("binary"), F.col("p_size") % 2 == 0, "decoded_preferred").alias("artifact"))


# --- sources ----------------------------------------------------------------------------------------------------

_BATCH = """SELECT p_partkey AS ordinal, (['load', 'replace', 'unload'])[CAST(p_partkey % 3 + 1 AS INTEGER)] AS op, 'src/' || (p_partkey % 700) AS locator, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE md5(CAST(p_partkey % 4 AS VARCHAR)) END AS fingerprint,
  row_number() OVER (PARTITION BY p_partkey % 700 ORDER BY p_partkey) AS nth, p_partkey % 700 AS n FROM part"""
_OUTCOME = """SELECT ordinal, op, locator, fingerprint, CASE WHEN nth > 1 THEN 'DuplicateOperation' WHEN op = 'load' THEN CASE WHEN n % 2 = 0 THEN 'AlreadyLoaded' WHEN fingerprint IS NULL THEN 'Unreadable' ELSE 'Loaded' END
  WHEN n % 2 = 1 THEN 'NotLoaded' WHEN op = 'unload' THEN 'Unloaded' WHEN fingerprint IS NULL THEN 'Unreadable' WHEN fingerprint = md5('1') THEN 'Unchanged' ELSE 'Replaced' END AS outcome FROM (""" + _BATCH + ")"


def _workspace(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    md5 = lambda c: F.md5(c.cast("string").cast("binary"))
    sources = p.filter("p_partkey < 700 and p_partkey % 2 = 0").select(F.concat(F.lit("src/"), k.cast("string")).alias("locator"), F.lit("Yaml").alias("kind"), md5(F.lit(1)).alias("fingerprint"), F.lit(10).cast("long").alias("length"))
    op = F.element_at(F.array(*map(F.lit, ("load", "replace", "unload"))), (k % 3 + 1).cast("int"))
    batch = p.select(k.alias("ordinal"), op.alias("op"), F.concat(F.lit("src/"), (k % 700).cast("string")).alias("locator"), F.lit("Yaml").alias("kind"), F.when(k % 13 != 0, md5(k % 4)).alias("fingerprint"), F.lit(10).cast("long").alias("length"))
    return sources, batch


@query(f"SELECT ordinal, op, locator, outcome FROM ({_OUTCOME})")
def admission_report(spark, sf_dir):
    return admission.admit(*_workspace(spark, sf_dir), "lenient")[1]


@query(f"""SELECT locator, fingerprint FROM (SELECT 'src/' || p_partkey AS locator, md5('1') AS fingerprint FROM part WHERE p_partkey < 700 AND p_partkey % 2 = 0) WHERE locator NOT IN (SELECT locator FROM ({_OUTCOME}) WHERE outcome IN ('Replaced', 'Unloaded'))
UNION ALL SELECT locator, fingerprint FROM ({_OUTCOME}) WHERE outcome IN ('Loaded', 'Replaced')""")
def admitted_sources(spark, sf_dir):
    return admission.admit(*_workspace(spark, sf_dir), "lenient")[0].select("locator", "fingerprint")


@query("SELECT 'src/' || p_partkey AS locator, md5('1') AS fingerprint FROM part WHERE p_partkey < 700 AND p_partkey % 2 = 0")
def refused_batch(spark, sf_dir):
    """A strict batch with errors leaves the sources as they are."""
    return admission.admit(*_workspace(spark, sf_dir))[0].select("locator", "fingerprint")


@query(f"SELECT s.locator, coalesce(n, 0) AS objects, coalesce(c, 0) AS classes, least, greatest FROM (SELECT unnest(['region', 'nation', 'part', 'gone']) AS locator) s LEFT JOIN (SELECT source, count(*) AS n, count(DISTINCT class_id) AS c, min(num) AS least, max(num) AS greatest FROM ({OBJECTS_SQL}) GROUP BY source) o ON o.source = s.locator")
def source_inventory(spark, sf_dir):
    sources = spark.createDataFrame([(x, "Table", "f", 1) for x in ("region", "nation", "part", "gone")], admission.SOURCES_DDL)
    return admission.inventory(sources, catalog.objects(spark, sf_dir)).select("locator", "objects", "classes", "least", "greatest")


@query("SELECT locator, CASE WHEN n % 5 = 0 THEN 'Invalid' WHEN n % 5 = 1 THEN 'Resolved' WHEN n % 5 = 2 THEN 'Ambiguous' WHEN n % 5 = 3 THEN 'Unloaded' ELSE 'Missing' END AS state FROM (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 5 = 0 THEN '../' || n_name ELSE n_name END AS locator FROM nation)")
def source_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 5
    rows = n.select(F.when(k == 0, F.concat(F.lit("../"), "n_name")).otherwise(F.col("n_name")).alias("locator"), k.alias("k"))
    loaded = rows.filter("k in (1, 2)").union(rows.filter("k = 2")).select("locator")
    return admission.lookup_sources(rows, loaded, rows.filter("k = 3"))


@query("SELECT doc_id, CASE WHEN 20 + doc_id % 50 <= strlen(text) THEN 'Resolved' ELSE 'InvalidRange' END AS state, CASE WHEN 20 + doc_id % 50 <= strlen(text) THEN 20 END AS n FROM documents")
def byte_ranges(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    r = admission.byte_range(F.encode("text", "utf-8"), F.col("doc_id") % 50, F.lit(20))
    return d.select("doc_id", r.alias("r")).select("doc_id", "r.state", F.octet_length("r.bytes").alias("n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 5 WHEN 0 THEN 'Stable' WHEN 1 THEN 'Changed' WHEN 2 THEN 'Gone' WHEN 3 THEN 'Unreadable' ELSE 'Torn' END AS state, CASE WHEN doc_id % 5 = 0 THEN sha256(text) END AS digest FROM documents")
def stable_reads(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    path, size = F.col("doc_id").cast("string").alias("path"), F.octet_length("text")
    listed = d.select(path, F.lit(1).alias("stamp"), F.when(k == 4, size + 1).otherwise(size).alias("length"))
    again = d.filter(k != 2).select(path, F.when(k == 1, 2).otherwise(1).alias("stamp"), F.when(k == 4, size + 1).otherwise(size).alias("length"))
    return admission.stable_read(listed, d.filter(k != 3).select(path, F.encode("text", "utf-8").alias("content")), again)


@query("SELECT p_partkey AS ref, coalesce(array_to_string(list_sort(list(DISTINCT s_name)), ','), '') AS sources FROM part LEFT JOIN supplier ON s_nationkey = p_size AND s_suppkey % 2 = 0 GROUP BY p_partkey")
def guid_sources(spark, sf_dir):
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    guid = lambda c: F.md5(c.cast("string").cast("binary"))
    metas = s.select(F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, ".META").otherwise(".txt")).alias("path"), F.upper(guid(F.col("s_nationkey"))).alias("guid"))
    claimed = admission.claims(s.select(F.col("s_name").alias("locator")), metas)
    return joined(admission.guid_sources(p.select(F.col("p_partkey").alias("ref"), guid(F.col("p_size")).alias("guid")), claimed), "sources")


# --- mutation ---------------------------------------------------------------------------------------------------


@query("""SELECT 'event:' || event_id AS target, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'StaleValue' WHEN 2 THEN 'MissingField' ELSE 'ok' END AS state,
  CASE event_id % 4 WHEN 0 THEN '{"k": -1}' WHEN 3 THEN '{"k": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || ', "xs": [2, 9]}' WHEN 1 THEN props ELSE props END AS props FROM events WHERE event_id < 200""")
def mutation_outcomes(spark, sf_dir):
    """Field and sequence changes under guards that hold or don't."""
    e = table(spark, sf_dir, "events").filter("event_id < 200")
    n, address = F.col("event_id"), F.concat(F.lit("event:"), F.col("event_id").cast("string"))
    k = F.try_variant_get(F.parse_json("props"), "$.k", "int")
    props = F.when(n % 4 == 3, F.concat(F.lit('{"k": '), k.cast("string"), F.lit(', "xs": [2, 5]}'))).otherwise(F.col("props"))
    digest = F.when(n % 4 == 1, F.lit("0")).otherwise(F.sha2(k.cast("string"), 256))
    field = F.format_string('{"kind": "field_replace", "path": "%s", "value_digest": "%s", "replacement": -1}', F.when(n % 4 == 2, "z").otherwise("k"), digest)
    edit = F.format_string('{"kind": "sequence_edit", "path": "xs", "value_digest": "%s", "edit": {"kind": "replace", "index": 1, "value": 9}}', F.lit(hashlib.sha256(b"[2,5]").hexdigest()))
    operations = e.select(n.cast("int").alias("ordinal"), address.alias("target"), F.when(n % 4 == 3, edit).otherwise(field).alias("operation"))
    objects = e.select(address.alias("address"), props.alias("props"), F.lit(None).cast("string").alias("schema_digest"))
    return mutation.outcomes(objects, operations).select("target", "state", "props")


# --- watching ---------------------------------------------------------------------------------------------------


@query("""SELECT user_id, CASE WHEN again THEN 'Rescan' ELSE 'Changed' END AS signal, CASE WHEN again THEN '' ELSE paths END AS paths FROM (SELECT user_id, bool_or(event_type = 'error' AND value > 97) AS again, coalesce(string_agg(DISTINCT 'a/' || event_type || '/' || (event_id % 3), ',' ORDER BY 'a/' || event_type || '/' || (event_id % 3)), '') AS paths FROM events WHERE event_type <> 'view' AND event_type <> 'click' OR (event_type = 'error' AND value > 97) GROUP BY user_id)""")
def watch_signals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    path = F.when(F.col("event_type") == "view", F.concat(F.lit("index/"), F.col("event_id").cast("string"))).when(F.col("event_type") == "click", "a/.searchignore").otherwise(F.concat_ws("/", F.lit("a"), "event_type", (F.col("event_id") % 3).cast("string")))
    return joined(watch.signals(e.select("user_id", path.alias("path"), ((F.col("event_type") == "error") & (F.col("value") > 97)).alias("rescan")), "user_id", "index"), "paths")


_STATE_OF = "CASE event_type WHEN 'view' THEN 'Queued' WHEN 'click' THEN 'Running' WHEN 'purchase' THEN 'Succeeded' ELSE 'Failed' END"


@query(f"""SELECT operation, max_by(state, event_id) AS state, count(*) AS changes, bool_and(CASE WHEN before IS NULL THEN state = 'Queued' WHEN before = 'Queued' THEN state = 'Running' WHEN before = 'Running' THEN state IN ('Succeeded', 'Failed') ELSE false END) AS valid
FROM (SELECT event_id, event_id // 3 AS operation, {_STATE_OF} AS state, lag({_STATE_OF}) OVER (PARTITION BY event_id // 3 ORDER BY event_id) AS before FROM events) GROUP BY operation""")
def operation_lifecycle(spark, sf_dir):
    e, t = table(spark, sf_dir, "events"), F.col("event_type")
    state = F.when(t == "view", "Queued").when(t == "click", "Running").when(t == "purchase", "Succeeded").otherwise("Failed")
    return watch.lifecycle(e.select(F.floor(F.col("event_id") / 3).alias("operation"), F.col("event_id").alias("at"), state.alias("state")))


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS startup, count(*) FILTER (event_type = 'click') AS watcher, CAST(0 AS BIGINT) AS periodic, CAST(0 AS BIGINT) AS recovery, count(*) FILTER (event_type = 'purchase') AS client, count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase')) AS other FROM events GROUP BY user_id")
def origin_counts(spark, sf_dir):
    t = F.col("event_type")
    e = table(spark, sf_dir, "events").select("user_id", F.when(t == "view", "startup").when(t == "click", "watcher").when(t == "purchase", "client").alias("origin"))
    return coalesce.origin_counts(e, "user_id")


@query("SELECT path, NOT (path LIKE '%/Library/%' OR path LIKE '.%/%') AS fine FROM (SELECT (['Assets/', 'Assets/Library/', '.git/', 'Library.x/'])[CAST(p_partkey % 4 + 1 AS INTEGER)] || p_name || p_partkey AS path FROM part)")
def discovered_paths(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = F.concat(F.element_at(F.array(*map(F.lit, ("Assets/", "Assets/Library/", ".git/", "Library.x/"))), (F.col("p_partkey") % 4 + 1).cast("int")), "p_name", F.col("p_partkey").cast("string"))
    return p.select(path.alias("path"), view.enterable(path).alias("fine"))


# --- scalars ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN strlen(text) <= 25 THEN text ELSE substr(text, 1, CAST(list_max(list_filter(range(0, 26), lambda i: strlen(substr(text, 1, CAST(i AS INTEGER))) <= 25)) AS INTEGER)) END AS cut FROM documents")
def truncated_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", values.truncated_utf8(F.col("text"), 25).alias("cut"))


@query("SELECT p_partkey, p_partkey + (16 - p_partkey % 16) % 16 AS aligned, 'm_Container[' || p_size || '].first.x' AS path, p_size AS ordinal, 'guid:' || md5(p_name) || ':' || p_size AS key FROM part")
def scalar_facts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    part = lambda name, i: F.struct(F.lit(name).alias("field"), (F.lit(None) if i is None else i).cast("int").alias("index"))
    path = values.render_path(F.array(part("m_Container", None), part(None, F.col("p_size")), part("first", None), part("x", None)))
    return p.select("p_partkey", values.aligned(F.col("p_partkey"), 16).alias("aligned"), path.alias("path"), projection.container_ordinal(path).alias("ordinal"), projection.guid_key(F.upper(F.md5(F.col("p_name").cast("binary"))), F.col("p_size")).alias("key"))


@query("SELECT address, num, CASE WHEN class_id IN (1, 2, 3) THEN 'C' || class_id ELSE 'Unknown(' || class_id || ')' END AS class_name FROM (" + OBJECTS_SQL + ") WHERE source <> 'orders'")
def named_classes(spark, sf_dir):
    names = spark.createDataFrame([(i, f"C{i}") for i in (1, 2, 3)], "class_id int, class_name string")
    return values.class_names(catalog.objects(spark, sf_dir).filter("source <> 'orders'"), names).select("address", "num", "class_name")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'NotReference' WHEN 1 THEN 'Valid' WHEN 2 THEN 'Malformed' ELSE 'Malformed' END AS state FROM events")
def reference_states(spark, sf_dir):
    shapes = F.array(*map(F.lit, ('{"k": 1}', '{"fileID": 5, "guid": "a", "type": 3}', '{"fileID": "x"}', '{"fileID": 5, "more": 1}')))
    return table(spark, sf_dir, "events").select("event_id", values.reference_state(F.parse_json(shapes[(F.col("event_id") % 4).cast("int")])).alias("state"))


@query("SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size * 4 * p_size * 4 * 4 WHEN 1 THEN p_size * p_size * 8 ELSE p_size * p_size * 16 END AS BIGINT) AS bytes FROM part")
def texture_sizes(spark, sf_dir):
    """Bytes of the largest level by format: RGBA32, DXT1 and DXT5."""
    code = F.element_at(F.array(F.lit(4), F.lit(10), F.lit(12)), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", textures.level_bytes(code, F.col("p_size") * 4, F.col("p_size") * 4).alias("bytes"))


@query(f"SELECT src, field_path, target FROM ({STATE_SQL}) WHERE state = 'Resolved'")
def refresh_facts(spark, sf_dir):
    """Facts that depend on a changed object are resolved again; the others are taken over as they are."""
    now = resolved(spark, sf_dir).filter("state = 'Resolved'").select("src", "field_path", "target")
    stale = now.withColumn("target", F.when(F.col("target") == "nation:3", "old").otherwise(F.col("target")))
    facts = now.withColumn("key", F.col("target"))
    return watch.refresh(stale, facts, _start(spark, "nation:3").withColumnRenamed("address", "key"), lambda rows: rows.drop("key"))


@query(f"SELECT address, 'x' || class_id AS found FROM ({OBJECTS_SQL}) WHERE source IN ('nation', 'supplier')")
def scan_each_content_once(spark, sf_dir):
    o = catalog.objects(spark, sf_dir).filter("source in ('nation', 'supplier')")
    sources = o.select(F.col("address").alias("source"), F.col("class_id").cast("string").alias("fingerprint"), F.concat(F.lit("x"), F.col("class_id").cast("string")).alias("content"))
    return graph.scan_once(sources, lambda d: d.select("fingerprint", F.col("content").alias("found"))).select(F.col("source").alias("address"), "found")


@query(f"SELECT DISTINCT src, dst FROM ({EDGES_SQL}) WHERE src LIKE 'nation:%'")
def stored_adjacency(spark, sf_dir):
    import uuid

    from graphloom.plans.settle import shared_folder

    edges = catalog.edges(spark, sf_dir)
    out, into = graph.adjacency(edges, f"{shared_folder(spark)}/adjacency-{uuid.uuid4().hex}", 8)
    nations = into.filter("dst like 'region:%'").select("src", "dst")
    return out.join(nations, ["src", "dst"], "left_semi").select("src", "dst")


@query("SELECT 'in:Assets/' || split_part(path, '/', 2) || '/' AS suggestion, CAST(count(*) AS BIGINT) AS n FROM (" + SEARCH_SQL + ") GROUP BY 1")
def folder_counts(spark, sf_dir):
    docs = search.prepared(catalog.search_documents(spark, sf_dir))
    return docs.groupBy(F.concat(F.lit("in:"), text.immediate_path(F.regexp_replace("path", "[^/]*$", ""), "Assets/")).alias("suggestion")).agg(F.count("*").alias("n"))
