from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import sharding


def check(rows, limit):
    sizes, counts = defaultdict(int), Counter()
    for r in rows:
        sizes[r.shard_id] += r.n_bytes
        counts[r.shard_id] += 1
    for r in rows:
        assert sizes[r.shard_id] == r.shard_bytes and counts[r.shard_id] == r.shard_rows
        assert sizes[r.shard_id] <= limit or (counts[r.shard_id] == 1 and r.depth == -1)
    return sizes


@pytest.mark.parametrize("limit", [1 << 30, 100_000, 3000])
def test_limits_hold(docs, limit):
    rows = sharding.assign_shards(docs, ["doc_id"], F.octet_length("text"), limit).collect()
    assert len(rows) == docs.count()
    sizes = check(rows, limit)
    if limit == 1 << 30:
        assert len(sizes) == 1 and rows[0].depth == 0


def test_only_oversized_buckets_split(docs):
    rows = sharding.assign_shards(docs, ["doc_id"], F.octet_length("text"), 100_000).collect()
    total = defaultdict(int)
    own = {r.doc_id: sharding_bits(r.doc_id) for r in rows}
    for r in rows:
        for d in range(61):
            total[own[r.doc_id][:d]] += r.n_bytes
    for r in rows:
        if r.depth > 0:
            assert total[own[r.doc_id][: r.depth]] <= 100_000 < total[own[r.doc_id][: r.depth - 1]]


def sharding_bits(doc):
    import hashlib

    return bin(int(hashlib.md5(str(doc).encode()).hexdigest()[:15], 16))[2:].zfill(60)


def test_a_key_with_most_rows_and_equal_rows(spark):
    rows = [("hot", "x" * 10, i % 400) for i in range(800)] + [(None, None, 1), ("cold", "", 2), ("big", "y" * 5000, 3)]
    df = spark.createDataFrame(rows, "key string, text string, depth int")
    out = sharding.assign_shards(df, ["key"], F.octet_length("text"), 500).collect()
    assert Counter(r.key for r in out) == Counter(r[0] for r in rows)
    check(out, 500)
    same = spark.createDataFrame([("hot", "x" * 10)] * 203, "key string, text string")
    out = sharding.assign_shards(same, ["key"], F.octet_length("text"), 55).collect()
    assert len(out) == 203 and len(check(out, 55)) == 41


def test_odd_names_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 3)
    rows = [("k" * (i % 3), "w " * 300_000 if i == 4 else "ab", str(i), 1) for i in range(9)] * 4
    df = spark.createDataFrame(rows, "`a.b` string, text string, shard_id string, depth int")
    two = sharding.assign_shards(df.withColumnRenamed("shard_id", "c d"), ["a.b", "c d"], F.octet_length("text"), 10).collect()
    assert len(two) == 36
    out = sharding.assign_shards(df, ["a.b"], F.octet_length("text"), 10).collect()
    assert Counter(r["a.b"] for r in out) == Counter(r[0] for r in rows)
    check(out, 10)


def test_split_keys_are_written_to_their_own_shards(spark, tmp_path):
    rows = [("hot", "x" * 10, i, "s") for i in range(60)] + [("hot", "x" * 10, 0, "s")] * 9 + [("cold", "y" * 80, 1, "t"), (None, None, 2, None)]
    df = spark.createDataFrame(rows, "key string, text string, n int, shard_id string")
    shards = {s.shard_id: s for s in sharding.write_shards(df, ["key"], F.octet_length("text"), 50, f"{tmp_path}/out").collect()}
    back = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out").collect()
    assert Counter((r.key, r.text, r.n, r.shard_id_) for r in back) == Counter(rows)
    held = defaultdict(list)
    for r in back:
        held[str(r.shard_id)].append(len(r.text or ""))
    assert set(held) == set(shards)
    assert all(sum(v) == shards[k].shard_bytes and len(v) == shards[k].shard_rows and (sum(v) <= 50 or len(v) == 1) for k, v in held.items())


def test_empty_and_written(spark, table, tmp_path):
    assert sharding.assign_shards(table([]), ["doc_id"], F.octet_length("text"), 10).count() == 0
    df = table(["abc", "defg", None, "hi"])
    shards = sharding.write_shards(df, ["doc_id"], F.octet_length("text"), 6, f"{tmp_path}/out").collect()
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 4 and back.select("shard_id").distinct().count() == len({s.shard_id for s in shards})
