"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of a hash. A bucket whose rows exceed the byte limit is split
on one more bit, others stay; so shards have different depths and only oversized buckets are touched again.

The hash has 120 bits: 60 of the key, then 60 of the whole row, so one key that holds a third of the rows
is split as well. Twelve bits are settled at a time from a histogram of at most 4096 entries a bucket.
Rows that are equal in every column share all 120 bits; they are counted, and dealt out by number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import store

DIGITS = 3
STEP = 4 * DIGITS
KEY_DIGITS = 15
LEVELS = 2 * KEY_DIGITS // DIGITS
#: Equal rows that one task numbers.
RUN = 10_000


def key_hash(columns: Sequence[str]) -> Column:
    """First 60 bits of MD5, as 15 hex digits; one column is hashed as its string, more of them as JSON."""
    own = [F.col(f"`{c}`") for c in columns]
    text = own[0].cast("string") if len(own) == 1 else F.to_json(F.struct(*own))
    return F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, KEY_DIGITS)


def _directory(pending: DataFrame, level: int, limit: int) -> DataFrame:
    """For each prefix of this level: depth of the shard it belongs to, or null if that is still too large."""
    cut = DIGITS * (level + 1)
    sizes = pending.groupBy(F.substring("_hash", 1, cut).alias("_prefix")).agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    parts = sizes.select("*", F.substring("_prefix", 1, cut - DIGITS).alias("_parent"), F.conv(F.substring("_prefix", cut - DIGITS + 1, DIGITS), 16, 10).cast("long").alias("_low"))
    parts = parts.repartition("_parent")
    shard = F.lit(None).cast("struct<depth:int,bytes:long,rows:long,bits:long>")
    for bits in range(STEP, -1 if level == 0 else 0, -1):
        low = F.shiftright("_low", STEP - bits)
        # an expression can't stand in a window's keys and be reused in them, so it is a column first
        parts = parts.withColumn(f"_k{bits}", low)
        over = Window.partitionBy("_parent", f"_k{bits}")
        parts = parts.withColumn(f"_b{bits}", F.sum("_bytes").over(over)).withColumn(f"_n{bits}", F.sum("_rows").over(over))
        here = F.struct(F.lit(level * STEP + bits).alias("depth"), F.col(f"_b{bits}").alias("bytes"), F.col(f"_n{bits}").alias("rows"), F.col(f"_k{bits}").alias("bits"))
        shard = F.when(F.col(f"_b{bits}") <= limit, here).otherwise(shard)
    name = F.concat_ws(":", F.col("_shard.depth").cast("string"), F.concat(F.col("_parent"), F.lpad(F.hex("_shard.bits"), DIGITS, "0")))
    return parts.select("_prefix", shard.alias("_shard")).select("_prefix", "_shard", F.substring("_prefix", 1, cut - DIGITS).alias("_parent")).select(
        "_prefix", F.col("_shard.depth").alias("depth"), F.when(F.col("_shard").isNotNull(), name).alias("shard_id"), F.col("_shard.bytes").alias("shard_bytes"), F.col("_shard.rows").alias("shard_rows")
    )


def assign_shards(df: DataFrame, key: Sequence[str], size: Column, limit: int) -> DataFrame:
    """Key columns, n_bytes, depth, shard_id, shard_bytes and shard_rows for each row of ``df``.

    shard_id is ``depth:digits``; the last three digits hold the bits of the last level, right-aligned.
    Every shard has at most ``limit`` bytes, save that a row larger than that has a shard of its own
    (``large:...``, depth -1). Null keys hash as empty strings, null sizes count 0, repeated rows are all
    kept, an empty table gives no rows. Other columns of ``df``, whatever their names, are not returned.
    """
    return _assigned(df, key, size, limit, list(key))


def _assigned(df: DataFrame, key: Sequence[str], size: Column, limit: int, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` of each row of ``df``, then what ``assign_shards`` says of it."""
    if limit < 1:
        raise ValueError("limit must be positive")
    row_hash = F.substring(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).cast("binary")), 1, KEY_DIGITS)
    names = [f"_keep{i}" for i in range(len(keep))]
    kept = [F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)]
    base = [*kept, F.coalesce(size, F.lit(0)).cast("long").alias("_size"), key_hash(list(key)).alias("_hash")]
    rows = store.written(df.select(*base), "shard-rows")
    out = [F.col(n).alias(c) for n, c in zip(names, keep, strict=True)]

    def result(part: DataFrame) -> DataFrame:
        return part.select(*out, F.col("_size").alias("n_bytes"), F.col("depth").cast("int"), "shard_id", "shard_bytes", "shard_rows")

    def numbered(part: DataFrame) -> DataFrame:
        """Rows that agree in all columns, counted and then told apart by a number: ``RUN`` of them a task."""
        same = part.groupBy(*names, "_size", "_hash").agg(F.count("*").alias("_n"))
        runs = same.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))).alias("_run")).repartition("_hash", "_run")
        last = F.least(F.col("_n"), (F.col("_run") + 1) * RUN) - 1
        return runs.select("*", F.explode(F.sequence(F.col("_run") * RUN, last)).alias("_i")).drop("_run")

    large = numbered(rows.filter(F.col("_size") > limit)).withColumns({"depth": F.lit(-1), "shard_id": F.concat_ws(":", F.lit("large"), "_hash", F.col("_size").cast("string"), F.col("_i").cast("string")), "shard_bytes": F.col("_size"), "shard_rows": F.lit(1).cast("long")})
    done, pending = [result(large)], rows.filter(F.col("_size") <= limit)
    for level in range(LEVELS):
        if level * DIGITS == KEY_DIGITS:  # the key's bits are used up: go on with those of the whole row
            full = df.select(*base, row_hash.alias("_row"))
            left = pending.select("_hash").distinct()
            pending = store.written(full.filter(F.col("_size") <= limit).join(left, "_hash", "left_semi").withColumn("_hash", F.concat("_hash", "_row")).drop("_row"), "shard-pending")
        directory = store.written(_directory(pending, level, limit), "shard-directory")
        prefixed = pending.withColumn("_prefix", F.substring("_hash", 1, DIGITS * (level + 1)))
        done.append(result(prefixed.join(directory.filter("depth is not null"), "_prefix")))
        if directory.filter("depth is null").isEmpty():
            break
        pending = store.written(prefixed.join(directory.filter("depth is null").select("_prefix"), "_prefix", "left_semi").drop("_prefix"), "shard-pending")
    else:
        room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.col("_size")))
        dealt = numbered(pending).withColumn("_room", room)
        part = F.floor(F.col("_i") / F.col("_room"))
        count = F.least(F.col("_room"), F.col("_n") - part * F.col("_room")).cast("long")
        done.append(result(dealt.withColumns({"depth": F.lit(LEVELS * STEP), "shard_id": F.concat_ws(":", F.lit(LEVELS * STEP).cast("string"), "_hash", part.cast("string")), "shard_rows": count, "shard_bytes": count * F.col("_size")})))
    return reduce(DataFrame.unionByName, done)


def write_shards(df: DataFrame, key: Sequence[str], size: Column, limit: int, path: str) -> DataFrame:
    """Writes ``df`` as Parquet under ``path``/shard_id=..., one folder a shard, and returns the shards.

    Every row goes to its own shard, those of one key that was split too, so each folder keeps within the limit
    but for single rows above it. A column of ``df`` named shard_id is written as shard_id_ (the folders have the
    name); names that differ in case only, or no column at all, are errors of Parquet's.
    """
    plain = df.withColumnRenamed("shard_id", "shard_id_")
    held = {c: f"_col{i}" for i, c in enumerate(plain.columns)}
    renamed = plain.withColumnsRenamed(held)
    # the size may name columns of df, so it is computed before they are renamed
    sized = df.select(*[F.col(f"`{c}`").alias(f"_col{i}") for i, c in enumerate(df.columns)], size.alias("_bytes"))
    own = [held["shard_id_" if c == "shard_id" else c] for c in key]
    placed = store.written(_assigned(sized, own, F.col("_bytes"), limit, renamed.columns), "placed-rows")
    rows = placed.select(*[F.col(h).alias(c) for c, h in held.items()], "shard_id")
    rows.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
    return placed.select("shard_id", "depth", "shard_bytes", "shard_rows").distinct()
