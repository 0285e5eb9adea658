"""The model's tables over relational sources: rows as objects, foreign keys as references, texts as search documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text

#: class name, class id, key and name column of each table of objects
CLASSES = (
    ("region", 1, "r_regionkey", "r_name"),
    ("nation", 2, "n_nationkey", "n_name"),
    ("customer", 3, "c_custkey", "c_name"),
    ("supplier", 4, "s_suppkey", "s_name"),
    ("part", 5, "p_partkey", "p_name"),
    ("orders", 6, "o_orderkey", "o_orderpriority"),
)
#: table, its key, reference column, target class
REFERENCES = (
    ("nation", "n_nationkey", "n_regionkey", "region"),
    ("customer", "c_custkey", "c_nationkey", "nation"),
    ("supplier", "s_suppkey", "s_nationkey", "nation"),
    ("orders", "o_orderkey", "o_custkey", "customer"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """address, source, num, class_id, class_name, name."""
    parts = [
        table(spark, sf_dir, t).select(
            F.concat(F.lit(f"{t}:"), F.col(key).cast("string")).alias("address"), F.lit(t).alias("source"), F.col(key).cast("long").alias("num"), F.lit(i).alias("class_id"), F.lit(t).alias("class_name"), F.col(name).alias("name")
        )
        for t, i, key, name in CLASSES
    ]
    return reduce(DataFrame.unionByName, parts)


OBJECTS_SQL = " UNION ALL ".join(f"SELECT '{t}:' || CAST({key} AS VARCHAR) AS address, '{t}' AS source, CAST({key} AS BIGINT) AS num, {i} AS class_id, '{t}' AS class_name, {name} AS name FROM {t}" for t, i, key, name in CLASSES)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, source, field_path, file_id, path_id: references as they are stored, path_id one above the key.

    So that every outcome occurs, orders hold some null, negative, unlisted, unloaded, shared and dangling ones.
    """
    parts = []
    for t, key, ref, target in REFERENCES:
        rows = table(spark, sf_dir, t)
        k, r = F.col(key).cast("long"), F.col(ref).cast("long")
        if t == "orders":
            file_id = F.when(k % 17 == 0, -1).when(k % 19 == 0, 9).when(k % 23 == 0, 2).when(k % 29 == 0, 3).otherwise(1)
            path_id = F.when(k % 13 == 0, 0).when(k % 11 == 0, r + 100_000_001).otherwise(r + 1)
        else:
            file_id, path_id = F.lit(1), r + 1
        parts.append(rows.select(F.concat(F.lit(f"{t}:"), k.cast("string")).alias("src"), F.lit(t).alias("source"), F.lit(ref).alias("field_path"), file_id.cast("int").alias("file_id"), path_id.cast("long").alias("path_id")))
    # customers also point into their own source: every fifth at none
    c = table(spark, sf_dir, "customer")
    n = c.count()
    own = F.when(F.col("c_custkey") % 5 == 0, 0).otherwise(F.pmod(F.col("c_custkey") * 7 + 3, F.lit(n)) + 1)
    parts.append(c.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("src"), F.lit("customer").alias("source"), F.lit("m_Next").alias("field_path"), F.lit(0).alias("file_id"), own.cast("long").alias("path_id")))
    return reduce(DataFrame.unionByName, parts)


_ORDERS_SQL = """SELECT 'orders:' || CAST(o_orderkey AS VARCHAR) AS src, 'orders' AS source, 'o_custkey' AS field_path,
  CAST(CASE WHEN o_orderkey % 17 = 0 THEN -1 WHEN o_orderkey % 19 = 0 THEN 9 WHEN o_orderkey % 23 = 0 THEN 2 WHEN o_orderkey % 29 = 0 THEN 3 ELSE 1 END AS INTEGER) AS file_id,
  CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN o_custkey + 100000001 ELSE o_custkey + 1 END AS BIGINT) AS path_id FROM orders"""
FACTS_SQL = (
    " UNION ALL ".join(f"SELECT '{t}:' || CAST({key} AS VARCHAR) AS src, '{t}' AS source, '{ref}' AS field_path, CAST(1 AS INTEGER) AS file_id, CAST({ref} AS BIGINT) + 1 AS path_id FROM {t}" for t, key, ref, _ in REFERENCES[:-1])
    + f" UNION ALL {_ORDERS_SQL} UNION ALL "
    + "SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS src, 'customer' AS source, 'm_Next' AS field_path, CAST(0 AS INTEGER) AS file_id, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE (c_custkey * 7 + 3) % (SELECT count(*) FROM customer) + 1 END AS path_id FROM customer"
)

#: External tables: (source, file_id, candidate source). File 2 of orders is claimed by two sources, file 3 by none that is loaded.
EXTERNALS = (("nation", 1, "region"), ("customer", 1, "nation"), ("supplier", 1, "nation"), ("orders", 1, "customer"), ("orders", 2, "customer"), ("orders", 2, "supplier"), ("orders", 3, None))
EXTERNALS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {f}, {repr(c) if c else 'NULL'})" for s, f, c in EXTERNALS) + ") AS e(source, file_id, candidate)"


def externals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXTERNALS, "source string, file_id int, candidate string")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved edges (src, dst) of the plain foreign keys and of the customers' own chain, by address."""
    parts = [table(spark, sf_dir, t).select(F.concat(F.lit(f"{t}:"), F.col(key).cast("string")).alias("src"), F.concat(F.lit(f"{target}:"), F.col(ref).cast("string")).alias("dst")) for t, key, ref, target in REFERENCES]
    c = table(spark, sf_dir, "customer")
    n = c.count()
    chain = c.filter("c_custkey % 5 <> 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("customer:"), F.pmod(F.col("c_custkey") * 7 + 3, F.lit(n)).cast("string")).alias("dst"))
    return reduce(DataFrame.unionByName, [*parts, chain])


EDGES_SQL = (
    " UNION ALL ".join(f"SELECT '{t}:' || CAST({key} AS VARCHAR) AS src, '{target}:' || CAST({ref} AS VARCHAR) AS dst FROM {t}" for t, key, ref, target in REFERENCES)
    + " UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS src, 'customer:' || CAST((c_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS VARCHAR) AS dst FROM customer WHERE c_custkey % 5 <> 0"
)


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as searchable assets: stable_key, name, path, kind."""
    p = table(spark, sf_dir, "part")
    ext = F.element_at(F.array(*map(F.lit, ("prefab", "mat", "cs", "png", "wav", "asset", "bin"))), (F.pmod("p_partkey", F.lit(7)) + 1).cast("int"))
    camel = F.concat(F.initcap(F.substring_index("p_name", " ", 1)), F.initcap(F.substring_index("p_name", " ", -1)), F.pmod("p_partkey", F.lit(100)).cast("string"))
    path = F.concat(F.lit("Assets/"), F.col("p_type"), F.lit("/"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")), F.lit("/"), camel, F.lit("."), ext)
    return p.select(F.format_string("part:%08d", "p_partkey").alias("stable_key"), camel.alias("name"), path.alias("path")).withColumn("kind", text.kind_of_path(F.col("path")))


_CAMEL = "upper(substr(split_part(p_name, ' ', 1), 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) || upper(substr(split_part(p_name, ' ', -1), 1, 1)) || lower(substr(split_part(p_name, ' ', -1), 2)) || CAST(p_partkey % 100 AS VARCHAR)"
SEARCH_SQL = f"""SELECT printf('part:%08d', p_partkey) AS stable_key, {_CAMEL} AS name,
  'Assets/' || p_type || '/' || replace(p_brand, '#', '_') || '/' || {_CAMEL} || '.' || (['prefab','mat','cs','png','wav','asset','bin'])[CAST(p_partkey % 7 + 1 AS INTEGER)] AS path,
  (['Prefab','Material','Script','Texture','Audio','Asset','File'])[CAST(p_partkey % 7 + 1 AS INTEGER)] AS kind FROM part"""
