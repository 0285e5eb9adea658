"""The engine's queries over the driver's tables, each beside the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text, values
from graphloom.operators import changes, graph, inventory, resolution, search, selection, sinks
from graphloom.plans import catalog
from graphloom.plans.settle import shared_folder
from graphloom.plans.catalog import EDGES_SQL, EXTERNALS_SQL, FACTS_SQL, OBJECTS_SQL, SEARCH_SQL, table
from graphloom.streaming import coalesce

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- references -------------------------------------------------------------------------------------------------

RESOLVED_SQL = f"""
  SELECT f.*, CASE WHEN f.file_id = 0 THEN [f.source] ELSE coalesce(e.c, []) END AS candidates,
    (f.file_id = 0 OR e.source IS NOT NULL) AS listed
  FROM ({FACTS_SQL}) f LEFT JOIN (
    SELECT source, file_id, list_sort(coalesce(list(DISTINCT candidate) FILTER (candidate IS NOT NULL), [])) AS c FROM ({EXTERNALS_SQL}) GROUP BY source, file_id) e
  ON f.source = e.source AND f.file_id = e.file_id"""
STATE_SQL = f"""
  SELECT k.src, k.source, k.field_path, k.file_id, k.path_id, k.candidates,
    CASE WHEN k.path_id = 0 THEN 'Null' WHEN k.file_id < 0 THEN 'Invalid' WHEN NOT k.listed THEN 'Invalid'
      WHEN len(k.candidates) = 0 THEN 'Unloaded' WHEN len(k.candidates) > 1 THEN 'Ambiguous'
      WHEN o.address IS NOT NULL THEN 'Resolved' ELSE 'Missing' END AS state,
    o.address AS target
  FROM ({RESOLVED_SQL}) k LEFT JOIN ({OBJECTS_SQL}) o
  ON k.path_id <> 0 AND k.file_id >= 0 AND len(k.candidates) = 1 AND o.source = k.candidates[1] AND o.num + 1 = k.path_id"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.resolve(catalog.facts(spark, sf_dir), catalog.externals(spark), catalog.objects(spark, sf_dir))


@query("SELECT " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s.lower()}" if s != "Null" else "count(*) FILTER (state = 'Null') AS \"null\"" for s in resolution.STATES) + f" FROM ({STATE_SQL})")
def resolution_counts(spark, sf_dir):
    return resolution.resolution_counts(resolved(spark, sf_dir))


@query(f"SELECT src, field_path, file_id, path_id, state, target FROM ({STATE_SQL})")
def resolve_facts(spark, sf_dir):
    return resolved(spark, sf_dir).select("src", "field_path", "file_id", "path_id", "state", "target")


@query(f"SELECT src, field_path, state, target FROM ({STATE_SQL}) WHERE src = 'customer:7'")
def outgoing(spark, sf_dir):
    return resolved(spark, sf_dir).filter("src = 'customer:7'").select("src", "field_path", "state", "target")


@query(f"SELECT src, field_path, target FROM ({STATE_SQL}) WHERE state = 'Resolved' AND target = 'nation:3'")
def incoming(spark, sf_dir):
    return resolved(spark, sf_dir).filter("state = 'Resolved' and target = 'nation:3'").select("src", "field_path", "target")


@query(f"SELECT src, field_path, list_aggregate(candidates, 'string_agg', ',') AS candidates FROM ({STATE_SQL}) WHERE state = 'Ambiguous'")
def ambiguous_candidates(spark, sf_dir):
    return resolved(spark, sf_dir).filter("state = 'Ambiguous'").select("src", "field_path", F.array_join("candidates", ",").alias("candidates"))


@query("""
SELECT ref, state, array_to_string(sources, ',') AS sources FROM (
  SELECT ref, CASE WHEN len(g) > 0 AND len(p) > 0 THEN CASE WHEN len(list_intersect(g, p)) > 0 THEN 'Candidates' ELSE 'Invalid' END
    WHEN len(g) > 0 THEN 'Candidates' WHEN len(p) > 0 AND len(list_filter(p, lambda x: x <> 's3' OR ref % 5 = 1)) = 0 THEN 'Invalid' ELSE 'Candidates' END AS state,
    list_sort(CASE WHEN len(g) > 0 AND len(p) > 0 THEN list_intersect(g, p) WHEN len(g) > 0 THEN g ELSE list_filter(p, lambda x: x <> 's3' OR ref % 5 = 1) END) AS sources
  FROM (SELECT n_nationkey AS ref,
    CASE WHEN n_nationkey % 3 = 0 THEN ['s1', 's2'] WHEN n_nationkey % 3 = 1 THEN ['s4'] ELSE [] END AS g,
    CASE WHEN n_nationkey % 4 = 0 THEN ['s2', 's3'] WHEN n_nationkey % 4 = 1 THEN ['s3'] WHEN n_nationkey % 4 = 2 THEN ['s4', 's5'] ELSE [] END AS p FROM nation))""")
def reconcile_guid_path(spark, sf_dir):
    n = F.col("n_nationkey")
    arr = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    g = F.when(n % 3 == 0, arr("s1", "s2")).when(n % 3 == 1, arr("s4")).otherwise(arr())
    p = F.when(n % 4 == 0, arr("s2", "s3")).when(n % 4 == 1, arr("s3")).when(n % 4 == 2, arr("s4", "s5")).otherwise(arr())
    out = table(spark, sf_dir, "nation").select(n.alias("ref"), resolution.reconcile(g, p, arr("s3"), n % 5 != 1).alias("r"))
    return out.select("ref", "r.state", F.array_join("r.sources", ",").alias("sources"))


@query("""
WITH refs AS (SELECT p_partkey AS ref, 'archive:/./Bundles/' || p_type || '\\' || p_brand || '.assets/' AS path, p_type AS parent FROM part),
claims AS (SELECT DISTINCT 'src-' || p_type || '-' || p_brand AS source, lower('bundles/' || p_type || '/' || p_brand || '.assets') AS claim, p_type AS parent FROM part WHERE p_size % 2 = 0)
SELECT ref, string_agg(source, ',') AS sources FROM (
  SELECT r.ref, c.source FROM refs r JOIN claims c ON lower('bundles/' || r.parent || '/' || split_part(split_part(r.path, chr(92), 2), '.assets', 1) || '.assets') = c.claim) GROUP BY ref
UNION ALL
SELECT ref, string_agg(source, ',' ORDER BY source) AS sources FROM (
  SELECT *, max(CASE WHEN parent = claim_parent THEN 1 ELSE 0 END) OVER (PARTITION BY ref) AS near, count(*) OVER (PARTITION BY ref) AS n FROM (
    SELECT r.ref, r.parent, c.source, c.parent AS claim_parent FROM refs r JOIN claims c ON lower(split_part(r.path, chr(92), 2)) = split_part(c.claim, '/', -1) || '/'
    WHERE NOT EXISTS (SELECT 1 FROM claims x WHERE x.claim = lower('bundles/' || r.parent || '/' || split_part(split_part(r.path, chr(92), 2), '.assets', 1) || '.assets'))))
WHERE n = 1 OR near = 0 OR parent = claim_parent GROUP BY ref""")
def path_sources(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    refs = p.select(F.col("p_partkey").alias("ref"), F.concat(F.lit("archive:/./Bundles/"), "p_type", F.lit("\\"), "p_brand", F.lit(".assets/")).alias("path"), F.col("p_type").alias("parent"))
    claims = p.filter("p_size % 2 = 0").select(F.concat_ws("-", F.lit("src"), "p_type", "p_brand").alias("source"), F.concat(F.lit("Bundles/"), "p_type", F.lit("/"), "p_brand", F.lit(".assets")).alias("path"), F.col("p_type").alias("parent")).distinct()
    return resolution.path_sources(refs, claims).select("ref", F.array_join("sources", ",").alias("sources"))


KEYS_SQL = f"""SELECT src, field_path, 'in' AS direction, 'object:' || target AS key FROM ({STATE_SQL}) WHERE target IS NOT NULL
UNION ALL SELECT src, field_path, 'in', 'source:' || split_part(target, ':', 1) FROM ({STATE_SQL}) WHERE target IS NOT NULL
UNION ALL SELECT src, field_path, 'out', 'object:' || src FROM ({FACTS_SQL}) UNION ALL SELECT src, field_path, 'out', 'source:' || source FROM ({FACTS_SQL})"""


@query(KEYS_SQL)
def dependency_keys(spark, sf_dir):
    return resolution.dependency_keys(resolved(spark, sf_dir))


@query(f"""SELECT DISTINCT src, field_path FROM ({STATE_SQL}) WHERE target IN ('nation:1', 'customer:5') OR src IN ('nation:1', 'customer:5') OR source = 'supplier' OR list_contains(candidates, 'supplier')""")
def dependency_impact(spark, sf_dir):
    objects = spark.createDataFrame([("nation:1",), ("customer:5",)], "address string")
    return resolution.impact(resolved(spark, sf_dir), objects, spark.createDataFrame([("supplier",)], "source string"))


@query(f"""SELECT stable_id, row_number() OVER (ORDER BY stable_id) AS rank, total > 20 AND (SELECT count(*) FROM ({KEYS_SQL}) WHERE direction = 'in' AND key = 'object:nation:2' AND src || '#' || field_path > 'customer:2') > 20 AS truncated, total FROM (
  SELECT src || '#' || field_path AS stable_id, count(*) OVER () AS total FROM (SELECT DISTINCT src, field_path FROM ({KEYS_SQL}) WHERE direction = 'in' AND key = 'object:nation:2'))
WHERE stable_id > 'customer:2' ORDER BY stable_id LIMIT 20""")
def reference_page(spark, sf_dir):
    return resolution.reference_page(resolution.dependency_keys(resolved(spark, sf_dir)), "object:nation:2", "in", "customer:2", 20).withColumn("rank", F.col("rank").cast("long"))


@query("""
SELECT event_id, CASE WHEN f IS NULL THEN 'Invalid' WHEN f = 0 THEN 'Null' WHEN g IS NULL THEN CASE WHEN f % 2 = 1 THEN 'Resolved' ELSE 'Missing' END
  WHEN NOT regexp_full_match(g, '[0-9a-fA-F]{32}') OR g = repeat('0', 32) THEN 'Invalid' WHEN n = 0 THEN 'Unloaded' WHEN n > 1 THEN 'Ambiguous' WHEN f % 3 = 0 THEN 'Resolved' ELSE 'Missing' END AS state
FROM (SELECT event_id, CASE WHEN k % 10 = 9 THEN NULL ELSE k % 10 END AS f, event_id % 3 AS n,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN repeat('0', 32) WHEN event_id % 5 = 2 THEN 'xyz' ELSE md5(CAST(event_id AS VARCHAR)) END AS g
  FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))""")
def yaml_states(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.try_variant_get(F.parse_json("props"), "$.k", "int")
    guid = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 5 == 1, "0" * 32).when(F.col("event_id") % 5 == 2, "xyz").otherwise(F.md5(F.col("event_id").cast("string").cast("binary")))
    rows = e.select("event_id", F.when(k % 10 != 9, k % 10).alias("f"), guid.alias("g"), (F.col("event_id") % 3).alias("n"))
    return rows.select("event_id", resolution.yaml_state(F.col("f"), F.col("g"), F.col("f") % 2 == 1, F.col("n"), F.col("f") % 3 == 0).alias("state"))


# --- graph ------------------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT src, dst FROM ({EDGES_SQL})")
def edge_dedup(spark, sf_dir):
    return graph.distinct_edges(catalog.edges(spark, sf_dir))


@query(f"SELECT address FROM ({OBJECTS_SQL}) WHERE address NOT IN (SELECT dst FROM ({EDGES_SQL}))")
def roots(spark, sf_dir):
    return graph.roots(catalog.objects(spark, sf_dir), catalog.edges(spark, sf_dir))


@query(f"SELECT address FROM ({OBJECTS_SQL}) WHERE address NOT IN (SELECT src FROM ({EDGES_SQL}))")
def leaves(spark, sf_dir):
    return graph.leaves(catalog.objects(spark, sf_dir), catalog.edges(spark, sf_dir))


@query(f"SELECT CAST(7 AS BIGINT) AS total_sources, count(DISTINCT source) AS scanned_sources, count(*) AS indexed_nodes, (SELECT count(*) FROM ({FACTS_SQL})) AS fact_count, count(DISTINCT source) = 7 AS complete FROM ({OBJECTS_SQL})")
def coverage(spark, sf_dir):
    return graph.coverage(catalog.objects(spark, sf_dir), catalog.facts(spark, sf_dir), 7)


def _reach(start: str, forward: bool = True, depth: int = 100_000) -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({EDGES_SQL})), r(address, depth) AS (
      SELECT '{start}', 0 UNION SELECT e.{b}, r.depth + 1 FROM r JOIN e ON e.{a} = r.address WHERE r.depth < {depth} AND r.depth < 60)
    SELECT address, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY address"""


def _start(spark, *addresses):
    return spark.createDataFrame([(a,) for a in addresses], "address string")


@query(_reach("customer:11"))
def closure_out(spark, sf_dir):
    return graph.closure(catalog.edges(spark, sf_dir), _start(spark, "customer:11"))


@query(_reach("nation:4", False, 2))
def closure_in(spark, sf_dir):
    return graph.closure(catalog.edges(spark, sf_dir), _start(spark, "nation:4"), max_depth=2, reverse=True)


@query(_reach("customer:13", True, 3))
def closure_depth(spark, sf_dir):
    return graph.closure(catalog.edges(spark, sf_dir), _start(spark, "customer:13"), max_depth=3)


@query(f"SELECT address, depth, (SELECT count(*) FROM ({_reach('region:1', False, 3)})) > 50 AS truncated FROM ({_reach('region:1', False, 3)}) ORDER BY depth, address LIMIT 50")
def closure_limited(spark, sf_dir):
    edges = catalog.edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.limited_closure(edges, _start(spark, "region:1"), 50, 3)


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT c_custkey AS a, (c_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS b FROM customer WHERE c_custkey % 5 <> 0),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a)
SELECT min('customer:' || CAST(b AS VARCHAR)) AS component, 'customer:' || CAST(a AS VARCHAR) AS address FROM m GROUP BY a""")
def cycles(spark, sf_dir):
    return graph.cycles(catalog.edges(spark, sf_dir))


@query("""SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS address, r_name || '/' || n_name || '/' || c_name AS path, false AS cyclic FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'nation:' || CAST(n_nationkey AS VARCHAR), r_name || '/' || n_name, false FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'region:' || CAST(r_regionkey AS VARCHAR), r_name, false FROM region""")
def hierarchy_paths(spark, sf_dir):
    edges = catalog.edges(spark, sf_dir).filter("src like 'nation:%' or (src like 'customer:%' and dst like 'nation:%')")
    names = catalog.objects(spark, sf_dir).filter("source in ('region', 'nation', 'customer')").select("address", "name")
    return graph.lineages(edges.select(F.col("src").alias("address"), F.col("dst").alias("parent")), names, 8)


@query("""SELECT address, new_parent, rejected FROM (VALUES ('region:1', 'customer:4', (SELECT n_regionkey = 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 4)),
  ('nation:3', 'region:2', false), ('nation:5', 'nation:5', true), ('region:0', 'nation:0', (SELECT n_regionkey = 0 FROM nation WHERE n_nationkey = 0))) AS t(address, new_parent, rejected)""")
def reparent_check(spark, sf_dir):
    parents = catalog.edges(spark, sf_dir).filter("src like 'nation:%' or (src like 'customer:%' and dst like 'nation:%')").select(F.col("src").alias("address"), F.col("dst").alias("parent"))
    moves = spark.createDataFrame([("region:1", "customer:4"), ("nation:3", "region:2"), ("nation:5", "nation:5"), ("region:0", "nation:0")], "address string, new_parent string")
    return graph.reparent_check(parents, moves)


# --- selection --------------------------------------------------------------------------------------------------


@query(f"SELECT address, class_name FROM ({OBJECTS_SQL}) WHERE class_name IN ('nation', 'supplier', 'region') AND class_name <> 'region'")
def doc_filter(spark, sf_dir):
    props = F.when(F.col("class_name") == "region", F.array(F.lit("name"))).otherwise(F.array(F.lit("name"), F.lit("parent")))
    return selection.filter_documents(catalog.objects(spark, sf_dir).withColumn("props", props), ["nation", "supplier", "region"], ["name", "parent"]).select("address", "class_name")


@query(f"SELECT address, name FROM ({OBJECTS_SQL}) WHERE address = 'supplier:3'")
def get_one(spark, sf_dir):
    return selection.get_one(catalog.objects(spark, sf_dir), F.col("address") == "supplier:3").select("address", "name")


@query(f"""SELECT a.address, CASE count(o.address) WHEN 0 THEN 'Missing' WHEN 1 THEN 'Resolved' ELSE 'Ambiguous' END AS state
FROM (VALUES ('nation:1'), ('nation:999'), ('part:3')) AS a(address) LEFT JOIN (SELECT address FROM ({OBJECTS_SQL}) UNION ALL SELECT 'part:3') o ON a.address = o.address GROUP BY a.address""")
def exact_lookup(spark, sf_dir):
    objects = catalog.objects(spark, sf_dir).select("address")
    return selection.lookup(objects.union(spark.createDataFrame([("part:3",)], "address string")), _start(spark, "nation:1", "nation:999", "part:3"))


@query(f"SELECT address FROM ({OBJECTS_SQL}) WHERE class_id IN (2, 5) AND contains(lower(class_name), 'a') AND contains(lower(name), 'ring')")
def object_filter(spark, sf_dir):
    return catalog.objects(spark, sf_dir).filter(selection.object_filter(class_ids=[2, 5], class_contains="A", name_contains="RING")).select("address")


@query(f"""SELECT stable_key, path LIKE 'Assets/STANDARD/%' AS wild, contains(lower(path), 'brand_1') AS plain,
  (length('brand_1') * greatest(strlen(path) - length('brand_1') + 1, 0))::BIGINT AS work FROM ({SEARCH_SQL})""")
def container_match(spark, sf_dir):
    docs, path = catalog.search_documents(spark, sf_dir), F.col("path")
    return docs.select("stable_key", text.container_match(path, "assets/standard/*").alias("wild"), text.container_match(path, "BRAND_1").alias("plain"), text.match_work(path, "BRAND_1").alias("work"))


RULES = ["# generated", "subtree:Assets/ECONOMY", "!glob:Assets/ECONOMY/*/*.cs", "glob:**/*.wav", "!exact:Assets/PROMO/Brand_3"]


@query(f"""SELECT path, CASE WHEN path = 'Assets/PROMO/Brand_3' THEN 'Include' WHEN regexp_full_match(path, '(?:[^/]+/)*[^/]*\\.wav') THEN 'ExcludeButDescend'
  WHEN regexp_full_match(path, 'Assets/ECONOMY/[^/]*/[^/]*\\.cs') THEN 'Include' WHEN path = 'Assets/ECONOMY' OR starts_with(path, 'Assets/ECONOMY/') THEN 'ExcludeButDescend' ELSE 'Include' END AS decision FROM ({SEARCH_SQL})""")
def ignore_policy(spark, sf_dir):
    return catalog.search_documents(spark, sf_dir).select("path", selection.decide(F.col("path"), F.lit(False), selection.parse_rules(RULES)).alias("decision"))


SLUG_SQL = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
PATH_SQL = f"'out/sources/source-' || source || '/class-' || class_id || '-' || class_name || '/' || CASE WHEN {SLUG_SQL.format('name')} = '' THEN 'unnamed' ELSE {SLUG_SQL.format('name')} END || '--' || sha256(address) || '.yaml'"


@query(f"SELECT row_number() OVER (ORDER BY address) - 1 AS ordinal, address, {PATH_SQL} AS path FROM ({OBJECTS_SQL}) WHERE class_id = 4 ORDER BY address LIMIT 40")
def selection_plan(spark, sf_dir):
    out = selection.plan(catalog.objects(spark, sf_dir), None, F.col("class_id") == 4, 40, "out")
    return out.withColumn("ordinal", F.col("ordinal").cast("long"))


@query(f"SELECT row_number() OVER (ORDER BY address) - 1 AS ordinal, address, {PATH_SQL} AS path FROM ({OBJECTS_SQL})")
def artifact_paths(spark, sf_dir):
    return selection.plan(catalog.objects(spark, sf_dir), None, F.lit(True), None, "out")


@query(f"""SELECT count(*) AS selected, CAST(sum(CAST('0x' || substr(sha256(address), 1, 15) AS BIGINT)) AS VARCHAR) || '-' || CAST(sum(CAST('0x' || substr(sha256(address), 16, 15) AS BIGINT)) AS VARCHAR) AS digest FROM ({OBJECTS_SQL}) WHERE class_id <> 6""")
def selection_witness(spark, sf_dir):
    return selection.witness(catalog.objects(spark, sf_dir).filter("class_id <> 6"))


_PLANNED = "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal, 'part:' || CAST(p_partkey AS VARCHAR) AS address, p_name AS path, md5(p_name) AS digest, p_partkey AS k FROM part"


@query(f"SELECT ordinal, address, CASE WHEN k % 3 = 0 THEN 'Written' WHEN k % 3 = 1 THEN 'Resumed' ELSE 'Failed' END AS status FROM ({_PLANNED})")
def resume_join(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("address"), F.col("p_name").alias("path"), F.md5(F.col("p_name").cast("binary")).alias("digest"), F.col("p_partkey").alias("k"))
    planned = selection.numbered(p, "k", "ordinal")
    manifest = planned.filter("k % 3 <> 0").withColumn("digest", F.when(F.col("k") % 3 == 1, F.col("digest")).otherwise("torn"))
    return selection.resume(planned, manifest).select("ordinal", "address", "status")


@query("SELECT o_orderkey AS ordinal, o_totalprice > 400000 AND o_orderstatus = 'P' AS failed FROM orders WHERE o_orderkey <= coalesce((SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'P'), 1e18)")
def stop_in_plan_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), ((F.col("o_totalprice") > 400000) & (F.col("o_orderstatus") == "P")).alias("failed"))
    return selection.stop_in_plan_order(o)


# --- sources and values -----------------------------------------------------------------------------------------


@query("SELECT page_id, (['Yaml', 'AssetBundle', 'Archive', 'WebFile', 'Unknown'])[CAST(page_id % 5 + 1 AS INTEGER)] AS kind FROM pages")
def source_recognition(spark, sf_dir):
    from graphloom.sources import recognition

    begins = F.array(*[F.lit(bytearray(x)) for x in (b"%YAML 1.1\n", b"UnityFS\0", b"PK\x03\x04", b"UnityWebData1.0\0", b"")])
    pages = table(spark, sf_dir, "pages")
    content = F.concat(begins[(F.col("page_id") % 5).cast("int")], F.encode("html", "utf-8"))
    return pages.select("page_id", recognition.recognize(F.parse_url("url", F.lit("PATH")), content).alias("kind"))


@query("SELECT o_orderstatus, count(*) FILTER (path_id < 0) AS negative, count(*) FILTER (path_id > 0) AS positive, min(path_id) AS least, max(path_id) AS greatest FROM (SELECT o_orderstatus, o_custkey - 500 AS path_id FROM orders) GROUP BY o_orderstatus")
def path_id_summary(spark, sf_dir):
    return sinks.path_id_summary(table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_custkey") - 500).alias("path_id")), "o_orderstatus")


@query("""SELECT l_returnflag, sum(c) AS compressed, sum(r) AS raw, count(*) AS blocks, round(CASE WHEN sum(r) = 0 THEN 1.0 ELSE sum(c)::DOUBLE / sum(r) END, 9) AS ratio, sum(r) - sum(c) AS saved, CAST(sum(c) // count(*) AS BIGINT) AS average
FROM (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS c, CAST(l_quantity AS BIGINT) * (2 + l_linenumber % 3) AS r FROM lineitem) GROUP BY l_returnflag""")
def compression_stats(spark, sf_dir):
    n = F.col("l_quantity").cast("long")
    return sinks.compression_stats(table(spark, sf_dir, "lineitem").select("l_returnflag", n.alias("compressed"), (n * (2 + F.col("l_linenumber") % 3)).alias("raw")), "l_returnflag")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'ExpectedObject' WHEN 2 THEN 'ExpectedArray' WHEN 3 THEN 'MissingField' ELSE 'ok' END AS outcome,
  CASE event_id % 5 WHEN 0 THEN CAST(json_extract(props, '$.k') AS VARCHAR) WHEN 4 THEN '7' END AS found FROM events""")
def value_at_path(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    wrapped = F.concat(F.lit('{"v": '), "props", F.lit(', "xs": [5, {"y": 7}]}'))
    paths = ["v.k", "v.k.z", "v.k[0]", "v.z", "xs[1].y"]
    at = F.array(*[values.value_at(wrapped, p) for p in paths])[F.pmod("event_id", F.lit(5)).cast("int")]
    return e.select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"), at["state"].alias("outcome"), at["value"].alias("found"))


@query("""SELECT k, v, CASE WHEN v IN ('', '~', 'null', 'Null', 'NULL') THEN 'null' WHEN v IN ('true', 'True', 'TRUE', 'false', 'False', 'FALSE') THEN 'bool'
  WHEN regexp_full_match(v, '[-+]?\\.(inf|Inf|INF)|\\.(nan|NaN|NAN)') THEN 'float' WHEN regexp_full_match(v, '[-+]?0[0-9]+') THEN 'string' WHEN regexp_full_match(v, '0x[-+]?[0-9A-Fa-f]+|0o[-+]?[0-7]+') THEN 'integer'
  WHEN regexp_full_match(v, '[-+]?[0-9]+') AND TRY_CAST(v AS BIGINT) IS NOT NULL THEN 'integer' WHEN regexp_full_match(v, '[+]?[0-9]+') AND TRY_CAST(v AS UBIGINT) IS NOT NULL THEN 'unsigned'
  WHEN regexp_full_match(v, '[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?') AND regexp_matches(v, '[.eE]') THEN 'float' ELSE 'string' END AS kind
FROM (SELECT event_id AS k, CASE event_id % 16 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN '0' || CAST(user_id AS VARCHAR) WHEN 3 THEN '-' || CAST(event_id AS VARCHAR) WHEN 4 THEN event_type WHEN 5 THEN 'True' WHEN 6 THEN '~'
  WHEN 7 THEN '0x1F' WHEN 8 THEN '1.0.0' WHEN 9 THEN '18446744073709551615' WHEN 10 THEN '-.inf' WHEN 11 THEN '.5e3' WHEN 12 THEN '' WHEN 13 THEN '9223372036854775808' WHEN 14 THEN '1e' ELSE '99999999999999999999' END AS v FROM events)""")
def scalar_typing(spark, sf_dir):
    m = F.col("event_id") % 16
    fixed = {5: "True", 6: "~", 7: "0x1F", 8: "1.0.0", 9: "18446744073709551615", 10: "-.inf", 11: ".5e3", 12: "", 13: "9223372036854775808", 14: "1e", 15: "99999999999999999999"}
    v = F.when(m == 0, F.col("value").cast("string")).when(m == 1, F.col("user_id").cast("string")).when(m == 2, F.concat(F.lit("0"), F.col("user_id").cast("string"))).when(m == 3, F.concat(F.lit("-"), F.col("event_id").cast("string"))).when(m == 4, F.col("event_type"))
    for k, x in fixed.items():
        v = v.when(m == k, x)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), v.alias("v")).select("k", "v", text.scalar_kind(F.col("v")).alias("kind"))


@query("""SELECT p_partkey, v, row_number() OVER (ORDER BY a, b, c, ch, n, p_partkey) AS place FROM (SELECT p_partkey, (2017 + p_size % 7) || '.' || (p_partkey % 4) || '.' || (p_partkey % 13) || t || (CASE WHEN t = '' THEN '' ELSE CAST(p_partkey % 3 AS VARCHAR) END) AS v,
  2017 + p_size % 7 AS a, p_partkey % 4 AS b, p_partkey % 13 AS c, CASE t WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN '' THEN 3 WHEN 'f' THEN 3 ELSE 4 END AS ch, CASE WHEN t = '' THEN 0 ELSE p_partkey % 3 END AS n
  FROM (SELECT *, (['a', 'b', 'f', 'p', ''])[CAST(p_partkey % 5 + 1 AS INTEGER)] AS t FROM part)) ORDER BY place LIMIT 200""")
def version_sort(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = F.element_at(F.array(*map(F.lit, ("a", "b", "f", "p", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    v = F.concat((2017 + F.col("p_size") % 7).cast("string"), F.lit("."), (F.col("p_partkey") % 4).cast("string"), F.lit("."), (F.col("p_partkey") % 13).cast("string"), t, F.when(t == "", "").otherwise((F.col("p_partkey") % 3).cast("string")))
    key = text.version_key(F.col("v"))
    top = p.select("p_partkey", v.alias("v")).orderBy(key, "p_partkey").limit(200)
    return top.select("p_partkey", "v", F.row_number().over(Window.orderBy(key, "p_partkey")).cast("long").alias("place"))


# --- text kernel ------------------------------------------------------------------------------------------------

TERMS_SQL = (
    "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, "
    "'[\\s/\\\\.\\-_:;,()\\[\\]{{}}\"'']', ' ', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{N}})([^\\p{{N}} ])', '\\1 \\2', 'g'), '([^\\p{{N}} ])(\\p{{N}})', '\\1 \\2', 'g'), ' +', ' ', 'g')))"
)


@query(f"SELECT stable_key, {TERMS_SQL.format('path')} AS path_terms, {TERMS_SQL.format('name')} AS name_terms FROM ({SEARCH_SQL})")
def to_terms(spark, sf_dir):
    return catalog.search_documents(spark, sf_dir).select("stable_key", text.to_terms(F.col("path"), True).alias("path_terms"), text.to_terms(F.col("name")).alias("name_terms"))


@query()
def to_terms_unicode(spark, sf_dir):
    """Terms of prose in four languages: NFKC runs in Arrow batches for texts that aren't ASCII. SQL has no NFKC."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(text.to_terms(F.col("text")), " ")).alias("n_terms"))


_NT = TERMS_SQL.format("name")


@query(f"""SELECT stable_key, CASE WHEN q = t THEN 'exact' WHEN starts_with(t, q) THEN 'prefix' WHEN list_contains(string_split(t, ' '), q) THEN 'token' WHEN contains(t, q) THEN 'substring'
  WHEN contains(array_to_string(list_transform(string_split(t, ' '), lambda x: x[1]), ''), q) THEN 'abbreviation' END AS kind
FROM (SELECT stable_key, {_NT} AS t, (['ring', 'red', 'dg', 'small', 'rw', 'bolt 1'])[CAST(hash_no % 6 + 1 AS INTEGER)] AS q FROM (SELECT *, CAST(substr(stable_key, 6) AS BIGINT) AS hash_no FROM ({SEARCH_SQL})))""")
def match_kind(spark, sf_dir):
    docs = catalog.search_documents(spark, sf_dir)
    q = F.element_at(F.array(*map(F.lit, ("ring", "red", "dg", "small", "rw", "bolt 1"))), (F.substring("stable_key", 6, 20).cast("long") % 6 + 1).cast("int"))
    return docs.select("stable_key", text.match_kind(q, text.to_terms(F.col("name"), True)).alias("kind"))


@query(f"SELECT stable_key, array_to_string(list_transform(string_split({_NT}, ' '), lambda x: x[1]), '') AS initials FROM ({SEARCH_SQL})")
def abbreviation(spark, sf_dir):
    return catalog.search_documents(spark, sf_dir).select("stable_key", text.initials(text.to_terms(F.col("name"), True)).alias("initials"))


@query("SELECT DISTINCT p_name, CAST(levenshtein('red ring', p_name) AS INTEGER) AS distance, levenshtein('red ring', p_name) <= 2 AS within FROM part")
def edit_distance(spark, sf_dir):
    d = F.levenshtein(F.lit("red ring"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_name", d.alias("distance"), (F.levenshtein(F.lit("red ring"), F.col("p_name"), 2) >= 0).alias("within")).distinct()


@query(f"""SELECT stable_key, max(CASE WHEN levenshtein('rings', t) <= 1 THEN 10000 - 1000 * levenshtein('rings', t) - abs(length(t) - 5) END)::INTEGER AS loose, max(CASE WHEN levenshtein('widge', t) <= 1 THEN 10000 - 1000 * levenshtein('widge', t) - abs(length(t) - 5) END)::INTEGER AS score
FROM (SELECT stable_key, unnest(string_split({_NT}, ' ')) AS t FROM ({SEARCH_SQL})) GROUP BY stable_key""")
def fuzzy_score(spark, sf_dir):
    terms = text.to_terms(F.col("name"), True)
    return catalog.search_documents(spark, sf_dir).select("stable_key", text.fuzzy_score(F.lit("rings"), terms).cast("int").alias("loose"), text.fuzzy_score(F.lit("widge"), terms).cast("int").alias("score"))


@query(f"""SELECT stable_key, CASE WHEN a = 0 AND b = 0 THEN '' WHEN a = 0 THEN (b - 1) || '-' || (b + 4) WHEN b = 0 THEN (a - 1) || '-' || (a + 5) WHEN a < b THEN (a - 1) || '-' || (a + 5) || ',' || (b - 1) || '-' || (b + 4) ELSE (b - 1) || '-' || (b + 4) || ',' || (a - 1) || '-' || (a + 5) END AS ranges
FROM (SELECT stable_key, instr(lower(path), 'assets') AS a, instr(lower(path), 'brand') AS b FROM ({SEARCH_SQL}))""")
def highlights(spark, sf_dir):
    spans = text.highlights(F.col("path"), F.array(F.lit("assets"), F.lit("brand"), F.lit("sets")))
    return catalog.search_documents(spark, sf_dir).select("stable_key", F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("ranges"))


@query("""SELECT p_partkey, split_part(p_brand, '#', 1) || '.' || split_part(p_name, ' ', 1) AS namespace, split_part(p_name, ' ', 2) || CAST(p_size AS VARCHAR) AS type_name FROM part""")
def script_symbols(spark, sf_dir):
    line = F.concat(F.lit("namespace "), F.substring_index("p_brand", "#", 1), F.lit("."), F.substring_index("p_name", " ", 1), F.lit(" { public sealed class "), F.substring_index("p_name", " ", -1), F.col("p_size").cast("string"), F.lit(" : Base {} // class Ignored"))
    spaces, types = text.script_symbols(line)
    return table(spark, sf_dir, "part").select("p_partkey", spaces.alias("namespace"), types.alias("type_name"))


# --- search -----------------------------------------------------------------------------------------------------


def search_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prepared(catalog.search_documents(spark, sf_dir))


@query(f"""SELECT t AS term, f AS field, stable_key, count(*) AS tf FROM (
  SELECT stable_key, 'name' AS f, unnest(string_split({_NT}, ' ')) AS t FROM ({SEARCH_SQL}) UNION ALL SELECT stable_key, 'path', unnest(string_split({TERMS_SQL.format('path')}, ' ')) FROM ({SEARCH_SQL})
  UNION ALL SELECT stable_key, 'kind', unnest(string_split({TERMS_SQL.format('kind')}, ' ')) FROM ({SEARCH_SQL})) WHERE t <> '' GROUP BY t, f, stable_key""")
def postings(spark, sf_dir):
    return search.postings(search_table(spark, sf_dir))


@query(f"SELECT DISTINCT 'in:Assets/ECONOMY/' || split_part(path, '/', 3) || '/' AS suggestion FROM ({SEARCH_SQL}) WHERE starts_with(path, 'Assets/ECONOMY/Brand_1') ORDER BY suggestion LIMIT 7")
def suggest_nested(spark, sf_dir):
    return search.suggest_paths(catalog.search_documents(spark, sf_dir), "Assets/ECONOMY/Brand_1", 7)


@query("SELECT * FROM (VALUES ('t:Asset'), ('t:AnimationClip'), ('t:AnimatorController'), ('t:Audio')) AS t(suggestion)")
def suggest_kinds(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in search.suggest_kinds("a")], "suggestion string")


@query(f"SELECT DISTINCT 'in:' || 'Assets/' || split_part(path, '/', 2) || '/' AS suggestion FROM ({SEARCH_SQL})")
def suggest_paths(spark, sf_dir):
    return search.suggest_paths(catalog.search_documents(spark, sf_dir), "Assets/", 50)


def _rank_sql(term: str, where: str = "true", limit: int = 25) -> str:
    """The ranking of one unquoted word in SQL: best field by (kind, boost), then the order of results."""

    def one(f: str, boost: int) -> str:
        t, n = TERMS_SQL.format(f), f"lower({f})"
        kind = lambda x: f"CASE WHEN '{term}' = {x} THEN 0 WHEN starts_with({x}, '{term}') THEN 1 WHEN list_contains(regexp_split_to_array({x}, '\\s+'), '{term}') THEN 2 WHEN contains({x}, '{term}') THEN 3 WHEN contains(array_to_string(list_transform(string_split({x}, ' '), lambda w: w[1]), ''), '{term}') THEN 4 ELSE 9 END"
        return f"least({kind(n)}, {kind(t)}) * 10 - {boost}"

    return f"""SELECT row_number() OVER (ORDER BY kind_rank, field_boost DESC, lower(path), lower(name), stable_key) AS rank, stable_key,
      (['exact','prefix','token','substring','abbreviation'])[kind_rank + 1] AS match_kind, field_boost, CAST(0 AS BIGINT) AS fuzzy_score, name, path
    FROM (SELECT *, CAST((best + 9) // 10 AS INTEGER) AS kind_rank, CAST(((best + 9) // 10) * 10 - best AS INTEGER) AS field_boost
      FROM (SELECT *, least({one('name', 4)}, {one('path', 3)}, {one('kind', 2)}) AS best FROM ({SEARCH_SQL}) WHERE {where})) WHERE kind_rank < 9
    ORDER BY rank LIMIT {limit}"""


def _as_long(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


@query(_rank_sql("widget", limit=100))
def rank_final(spark, sf_dir):
    return _as_long(search.search(search_table(spark, sf_dir), "widget", 100))


@query(_rank_sql("ri", "lower(kind) = 'prefab' AND starts_with(lower(path), 'assets/promo')", 50))
def search_filtered(spark, sf_dir):
    return _as_long(search.search(search_table(spark, sf_dir), "t:Prefab in:assets/promo ri", 50))


@query(f"SELECT row_number() OVER (ORDER BY lower(path), lower(name), stable_key) AS rank, stable_key, 'none' AS match_kind, CAST(0 AS INTEGER) AS field_boost, CAST(0 AS BIGINT) AS fuzzy_score, name, path FROM ({SEARCH_SQL}) WHERE kind = 'Script' ORDER BY rank LIMIT 30")
def search_filters_only(spark, sf_dir):
    return _as_long(search.search(search_table(spark, sf_dir), "type:cs", 30))


@query(f"""SELECT row_number() OVER (ORDER BY score DESC, lower(path), lower(name), stable_key) AS rank, stable_key, 'fuzzy' AS match_kind, 4 AS field_boost, score AS fuzzy_score, name, path FROM (
  SELECT stable_key, name, path, CAST(max(CASE WHEN levenshtein('widgt', t) <= 1 THEN 10000 - 1000 * levenshtein('widgt', t) - abs(length(t) - 5) END) AS BIGINT) AS score
  FROM (SELECT stable_key, name, path, unnest(string_split({_NT}, ' ')) AS t FROM ({SEARCH_SQL})) GROUP BY stable_key, name, path) WHERE score IS NOT NULL ORDER BY rank LIMIT 25""")
def search_fallback(spark, sf_dir):
    return _as_long(search.search(search_table(spark, sf_dir), "widgt", 25))


@query(f"SELECT least((SELECT count(*) FROM ({_rank_sql('gear', limit=126)})), 125) AS matches, CASE WHEN (SELECT count(*) FROM ({_rank_sql('gear', limit=126)})) > 125 THEN 'lower_bound' ELSE 'exact' END AS relation")
def match_count(spark, sf_dir):
    return search.match_count(search_table(spark, sf_dir), search.parse("gear"), 25)


_LEN = f"(SELECT field, stable_key, sum(tf) AS length FROM ({ORACLES['postings']}) GROUP BY field, stable_key)"


@query(f"""SELECT stable_key, CAST(sum(CAST(round(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean)) * 1e6) AS BIGINT)) AS BIGINT) AS retrieval_score FROM (
  SELECT p.*, l.length, m.mean, d.df, (SELECT CAST(count(*) AS DOUBLE) FROM part) AS n, CASE p.field WHEN 'name' THEN 3.0 WHEN 'path' THEN 2.0 ELSE 1.0 END AS boost
  FROM ({ORACLES['postings']}) p JOIN {_LEN} l USING (field, stable_key) JOIN (SELECT field, avg(length) AS mean FROM {_LEN} GROUP BY field) m USING (field)
  JOIN (SELECT term, field, count(DISTINCT stable_key) AS df FROM ({ORACLES['postings']}) GROUP BY term, field) d USING (term, field) WHERE p.term IN ('ring', 'promo'))
GROUP BY stable_key HAVING count(DISTINCT term) = 2 ORDER BY retrieval_score DESC, stable_key LIMIT 50""")
def retrieve_topk(spark, sf_dir):
    made = search_table(spark, sf_dir)
    return search.bm25(search.counted(made, search.FIELDS), ["ring", "promo"], table(spark, sf_dir, "part").count(), search.lengths(made)).orderBy(F.desc("retrieval_score"), "stable_key").limit(50)


@query("""SELECT c_nationkey, array_to_string(list_filter(list_sort(list(c_name)), lambda x: contains(lower(x), '7') OR contains(lower(x), '12'))[1:6], '|') AS hits FROM customer GROUP BY c_nationkey""")
def context_values(spark, sf_dir):
    grouped = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_name")).alias("names"))
    return grouped.select("c_nationkey", F.array_join(search.context(F.col("names"), ["7", "12"], 6), "|").alias("hits"))


# --- changes ----------------------------------------------------------------------------------------------------

BEFORE = "o_orderkey % 10 <> 3"
AFTER = "o_orderkey % 10 <> 4"


def revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    address = F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")).alias("address")
    price = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    old = o.filter(BEFORE).select(address, F.col("o_custkey").alias("value")).withColumn("digest", changes.digest("value"))
    return old, o.filter(AFTER).select(address, price.alias("value")).withColumn("digest", changes.digest("value"))


@query(f"""SELECT 'orders:' || CAST(o_orderkey AS VARCHAR) AS address, CASE WHEN NOT ({BEFORE}) THEN 'added' WHEN NOT ({AFTER}) THEN 'removed' ELSE 'changed' END AS change
FROM orders WHERE NOT ({BEFORE}) OR NOT ({AFTER}) OR o_orderkey % 7 = 0""")
def changeset(spark, sf_dir):
    return changes.change_set(*revisions(spark, sf_dir))


@query(f"SELECT 'orders:' || CAST(o_orderkey AS VARCHAR) AS address, CASE WHEN NOT ({AFTER}) THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'stale' ELSE 'ok' END AS state FROM orders WHERE {BEFORE}")
def guarded_update(spark, sf_dir):
    old, new = revisions(spark, sf_dir)
    return changes.guard(new, old.select("address", F.col("digest").alias("expected")))


@query(f"SELECT 'orders:' || CAST(o_orderkey AS VARCHAR) AS address, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_custkey END AS value FROM orders WHERE {BEFORE} AND o_orderkey % 11 <> 0")
def preview_overlay(spark, sf_dir):
    old, _ = revisions(spark, sf_dir)
    old = old.select("address", "value")
    n = F.substring_index("address", ":", -1).cast("long")
    patch = old.filter((n % 5 == 0) & (n % 11 != 0)).withColumn("value", F.lit(-1).cast("long"))
    return changes.overlay(old, patch, old.filter(n % 11 == 0))


@query(f"SELECT src, field_path, target FROM ({STATE_SQL}) WHERE state = 'Resolved'")
def reindex_incremental(spark, sf_dir):
    """An index of which the rows of impacted owners are replaced equals one made anew."""
    fresh = resolved(spark, sf_dir).filter("state = 'Resolved'").select("src", "field_path", "target")
    changed = F.pmod(F.xxhash64("src"), F.lit(9)) == 0
    old = fresh.withColumn("target", F.when(changed, "gone").otherwise(F.col("target")))
    return changes.reindex(old, fresh.filter(changed).select("src"), fresh)


@query("SELECT 'published,no_change,published,stale' AS outcomes, count(*) AS rows FROM part WHERE p_size > 5")
def generation_nochange(spark, sf_dir):
    import uuid

    versions = changes.Generations(spark, f"{shared_folder(spark)}/generations-{uuid.uuid4().hex}")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    outcomes = [versions.publish(p, *p.columns), versions.publish(p.orderBy("p_name"), *p.columns), versions.publish(p.filter("p_size > 5"), *p.columns), versions.publish(p, *p.columns, expected="other")]
    return versions.read().agg(F.lit(",".join(outcomes)).alias("outcomes"), F.count("*").alias("rows"))


@query("SELECT c_custkey, array_to_string(v, ',') AS edited FROM (SELECT c_custkey, [c_nationkey, 100, CAST(c_custkey % 7 AS INTEGER)] AS v FROM customer)")
def sequence_edits(spark, sf_dir):
    items = F.array(F.col("c_nationkey"), (F.col("c_custkey") % 7).cast("int"), F.lit(9))
    inserted = changes.edit_sequence(items, "insert", 1, F.lit(100))
    moved = changes.edit_sequence(changes.edit_sequence(inserted, "remove", 3), "move", 2, to=0)
    back = changes.edit_sequence(moved, "move", 0, to=2)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(back, ",").alias("edited"))


# --- sinks ------------------------------------------------------------------------------------------------------


@query(f"""SELECT '  "' || src || '" -> "' || target || '" [label="' || field_path || '"];' AS line FROM ({STATE_SQL}) WHERE state = 'Resolved'""")
def projection_dot(spark, sf_dir):
    return sinks.dot_edges(resolved(spark, sf_dir))


@query(f"""SELECT 0 AS part, '' AS key, '{{"record":"header","version":2,"nodes":' || (SELECT count(*) FROM ({OBJECTS_SQL})) || ',"facts":' || (SELECT count(*) FROM ({FACTS_SQL})) || '}}' AS line
UNION ALL SELECT 1, address, '{{"record":"node","address":"' || address || '","class_id":' || class_id || '}}' FROM ({OBJECTS_SQL})
UNION ALL SELECT 2, src || '#' || field_path, '{{"record":"fact","src":"' || src || '","field_path":"' || field_path || '","state":"' || state || '"' || CASE WHEN target IS NULL THEN '' ELSE ',"target":"' || target || '"' END || '}}' FROM ({STATE_SQL})""")
def projection_json_lines(spark, sf_dir):
    return sinks.json_lines(catalog.objects(spark, sf_dir), resolved(spark, sf_dir))


# --- change events ----------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
w AS (SELECT user_id, i, t AS first, t AS last, 1 AS n, 0 AS b FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, CASE WHEN e.t >= least(w.last + 3600000, w.first + 14400000) THEN e.t ELSE w.first END, e.t, CASE WHEN e.t >= least(w.last + 3600000, w.first + 14400000) THEN 1 ELSE w.n + 1 END,
    w.b + CASE WHEN e.t >= least(w.last + 3600000, w.first + 14400000) THEN 1 ELSE 0 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, min(first) AS first, max(last) AS last, CAST(max(n) AS INTEGER) AS n FROM w GROUP BY user_id, b""")
def debounce_coalesce(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return coalesce.batches(e, "user_id", "ms", 3_600_000, 14_400_000)


@query("SELECT min(event_id) AS event_id, props AS idempotency_key FROM events WHERE event_id % 4 <> 0 GROUP BY props UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 0")
def idempotent_admit(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("idempotency_key"))
    return coalesce.admit(e)


@query("""SELECT user_id, scope, CASE WHEN scope = 'changed_paths' THEN p ELSE '' END AS paths FROM (
  SELECT user_id, CASE WHEN max(CASE WHEN event_type = 'error' AND value > 95 THEN 1 ELSE 0 END) = 1 OR count(DISTINCT props) FILTER (event_type = 'click') > 30 THEN 'full' WHEN count(*) FILTER (event_type = 'click') = 0 THEN 'reconcile' ELSE 'changed_paths' END AS scope,
  string_agg(DISTINCT props, '|' ORDER BY props) FILTER (event_type = 'click') AS p FROM events GROUP BY user_id)""")
def scope_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.when((F.col("event_type") == "error") & (F.col("value") > 95), "full").otherwise("changed_paths").alias("scope"), F.when(F.col("event_type") == "click", F.col("props")).alias("path"))
    return coalesce.merge_scopes(e, "user_id", 30).select("user_id", "scope", F.array_join("paths", "|").alias("paths"))


# --- inventory --------------------------------------------------------------------------------------------------

REGISTRY = ((5, "exact", "5.1.2", "exact-512", 0), (5, "prefix", "5.", "prefix-5", 0), (5, "prefix", "5.1", "prefix-51", 0), (5, "any", "", "any-5", 0), (6, "any", "", "any-6", 1), (6, "prefix", "6.", "late-6", 2))
REGISTRY_SQL = "SELECT * FROM (VALUES " + ", ".join(map(str, REGISTRY)) + ") AS r(class_id, kind, version, schema, source)"


@query(f"""SELECT address, schema FROM (SELECT o.address, r.schema, row_number() OVER (PARTITION BY o.address ORDER BY r.source NULLS LAST, CASE r.kind WHEN 'exact' THEN 0 WHEN 'prefix' THEN 1 ELSE 2 END, -length(r.version), r.schema) AS rn FROM (
  SELECT 'part:' || CAST(p_partkey AS VARCHAR) AS address, CAST(5 + p_partkey % 3 AS INTEGER) AS class_id, (4 + p_size % 3) || '.' || (p_partkey % 2) || '.' || (p_partkey % 4) AS version FROM part) o
  LEFT JOIN ({REGISTRY_SQL}) r ON r.class_id = o.class_id AND (r.kind = 'any' OR (r.kind = 'exact' AND r.version = o.version) OR (r.kind = 'prefix' AND starts_with(o.version, r.version)))) WHERE rn = 1""")
def registry_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    version = F.concat_ws(".", (4 + F.col("p_size") % 3).cast("string"), (F.col("p_partkey") % 2).cast("string"), (F.col("p_partkey") % 4).cast("string"))
    objects = p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("address"), (5 + F.col("p_partkey") % 3).cast("int").alias("class_id"), version.alias("version"))
    return inventory.registry_match(objects, spark.createDataFrame(REGISTRY, "class_id int, kind string, version string, schema string, source int"))


def _listings(spark, sf_dir):
    docs = catalog.search_documents(spark, sf_dir)
    n = F.substring("stable_key", 6, 20).cast("long")
    path = F.concat_ws("/", "path", "stable_key").alias("path")
    return docs.filter(n % 5 != 0).select(path, (n % 4).alias("stamp")), docs.filter(n % 7 != 0).select(path, (n % 4 + F.when(n % 11 == 0, 1).otherwise(0)).alias("stamp"))


def _scan_sql(named: str, action: str) -> str:
    return f"""SELECT path, action FROM (SELECT path || '/' || stable_key AS path, CASE WHEN {named} THEN CASE WHEN n % 5 = 0 AND n % 7 = 0 THEN NULL WHEN n % 5 = 0 THEN 'remove' WHEN n % 7 = 0 THEN 'add' {action} END
      WHEN n % 7 <> 0 THEN 'reuse' END AS action FROM (SELECT *, CAST(substr(stable_key, 6) AS BIGINT) AS n FROM ({SEARCH_SQL}))) WHERE action IS NOT NULL"""


@query(_scan_sql("true", "WHEN n % 11 = 0 THEN 'update' ELSE 'reuse'"))
def scan_plan(spark, sf_dir):
    return inventory.scan_plan(*_listings(spark, sf_dir), "reconcile")


@query(_scan_sql("starts_with(path, 'Assets/PROMO/')", "WHEN n % 11 = 0 THEN 'update' ELSE 'reuse'"))
def scan_changed_paths(spark, sf_dir):
    return inventory.scan_plan(*_listings(spark, sf_dir), "changed_paths", ["Assets/PROMO"])


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) - 1 AS occurrence FROM part")
def member_occurrences(spark, sf_dir):
    return inventory.occurrences(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey").select("p_partkey", F.col("occurrence").cast("long").alias("occurrence"))


@query("""SELECT stable_key, score, path, name, kind, evidence FROM (SELECT p_name AS stable_key, p_size AS score, p_brand AS path, p_type AS name, CAST(p_partkey % 3 AS VARCHAR) AS kind,
  row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_brand, p_type, CAST(p_partkey % 3 AS VARCHAR)) AS rn, array_to_string(list_sort(list_distinct(list(p_type) OVER (PARTITION BY p_name))), ',') AS evidence FROM part) WHERE rn = 1""")
def merge_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("stable_key"), F.col("p_size").alias("score"), F.col("p_brand").alias("path"), F.col("p_type").alias("name"), (F.col("p_partkey") % 3).cast("string").alias("kind"), F.array("p_type").alias("evidence"))
    return inventory.merge_candidates(p).withColumn("evidence", F.array_join("evidence", ","))


@query(f"""SELECT doc_id, CASE WHEN contains(' ' || t || ' ', ' with ') THEN 'token' ELSE 'substring' END AS evidence FROM (SELECT doc_id, {TERMS_SQL.format('text')} AS t FROM documents) WHERE contains(' ' || t || ' ', ' with')""")
def evidence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return inventory.content_evidence(docs, text.to_terms(F.col("text"), True), "with").select("doc_id", "evidence")


@query("""SELECT p_partkey AS ref, CASE WHEN p_size % 4 = 3 THEN 'Unloaded' WHEN p_size % 4 = 2 THEN 'Ambiguous' WHEN p_partkey % 9 = 0 OR p_partkey % 1000 + p_size > 800 THEN 'Invalid' ELSE 'Resolved' END AS state FROM part""")
def streamed_resources(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    requests = p.select(F.col("p_partkey").alias("ref"), F.concat(F.lit("archive:/Res/"), (F.col("p_size") % 4).cast("string"), F.lit(".resS")).alias("path"), F.when(F.col("p_partkey") % 9 == 0, -1).otherwise(F.col("p_partkey") % 1000).alias("offset"), F.col("p_size").alias("size"))
    sources = spark.createDataFrame([("Res/0.resS", 800), ("res/1.ress", 800), ("Res/2.resS", 800), ("res\\2.resS", 800)], "path string, length long")
    return inventory.streamed_resource(requests, sources)


@query("SELECT page_id, NOT regexp_matches(p, '(^|/)\\.{0,2}(/|$)') AND p <> '' AS fine FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a/' || page_id WHEN 1 THEN 'a/../' || page_id WHEN 2 THEN '/a' ELSE 'a//b' END AS p FROM pages)")
def portable_paths(spark, sf_dir):
    n = F.col("page_id")
    path = F.when(n % 4 == 0, F.concat(F.lit("a/"), n.cast("string"))).when(n % 4 == 1, F.concat(F.lit("a/../"), n.cast("string"))).when(n % 4 == 2, "/a").otherwise("a//b")
    return table(spark, sf_dir, "pages").select("page_id", inventory.portable(path).alias("fine"))


@query(f"SELECT src, field_path, 'nation:3' AS expected, 'nation:4' AS target FROM ({STATE_SQL}) WHERE target = 'nation:3'")
def recipe_retarget(spark, sf_dir):
    return inventory.retarget(resolved(spark, sf_dir), spark.createDataFrame([("nation:3", "nation:4")], "old string, new string"))


@query("SELECT p_partkey, CAST(list_sum(list_transform(range(0, 1 + p_partkey % 8), lambda i: greatest(p_size * 8 // CAST(pow(2, i) AS BIGINT), 1) * greatest(64 // CAST(pow(2, i) AS BIGINT), 1) * 4)) AS BIGINT) AS bytes FROM part")
def mip_bytes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", inventory.mip_bytes(F.col("p_size") * 8, F.lit(64), (1 + F.col("p_partkey") % 8).cast("int"), 4).alias("bytes"))


from graphloom import queries_index  # noqa: E402, F401  registers more queries
