"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are combined for each language: the likelihood of the text under a model of byte
trigrams; the language that the document or its markup declares; the suffix of its address; and the prior of
its host. The prior of a host is smoothed towards that of its suffix, which is smoothed towards the whole
table's; all of these, and how far declarations can be trusted, are counts over all rows by the language
that the text alone suggests, gathered by grouped aggregation. The text model is fitted on a bounded sample of rows
by their declared language; where the same column is also the declaration, it is evidence twice, once through the
words of its language and once by itself, and how far it agrees with the texts is counted and not presumed.

A row is rejected if its text is unlike the language that suits it best (its likelihood a trigram is far below that
of the sample's texts, or hardly above that of trigrams that the language never has), or has no trigram of letters at all, or if no language has half of the probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import kernel, skew, store

BUCKETS = 1 << 15
#: Texts with a known language that the model is fitted on, at most; each language's share are those of the least hashed ids.
MAX_SAMPLE = 4_000
#: Trigrams of a text overlap, so that their likelihoods count less than independent ones would.
TEMPER = 0.3
#: Pseudo-counts with which a host leans on its suffix, a suffix on the table, and declarations on even odds.
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 20.0, 20.0, 20.0
#: Size of the table of host priors up to which every task is sent all of it.
SMALL_BYTES = 8 << 20
#: Standard deviations below the sample's mean likelihood at which a text is unlike a language.
SIGMAS = 8.0
#: How far above the likelihood of unseen trigrams, on the way to the sample's mean, a text must be at least.
ABOVE_UNSEEN = 0.25

#: Lower-cased letters and bytes of longer characters stay; all else is a space.
_KEEP = np.full(256, 32, np.uint8)
_KEEP[128:] = np.arange(128, 256)
_KEEP[97:123] = _KEEP[65:91] = np.arange(97, 123)


def trigrams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """For runs of texts: bucket and text number of each trigram with a letter, the first text and their count."""
    data, offsets = kernel.texts_of(column)
    for lo, hi in kernel.slices(offsets):
        part, at = _KEEP[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        owner = np.repeat(np.arange(hi - lo), np.diff(at))
        n = max(len(part) - 2, 0)
        code = part[:n].astype(np.uint32) << 16 | part[1 : n + 1].astype(np.uint32) << 8 | part[2 : n + 2] if n else np.zeros(0, np.uint32)
        fine = (owner[:n] == owner[2 : n + 2]) & ((part[:n] != 32) | (part[1 : n + 1] != 32)) & ((part[1 : n + 1] != 32) | (part[2 : n + 2] != 32)) if n else np.zeros(0, bool)
        bucket = (code[fine] * np.uint32(0x9E3779B1)) >> np.uint32(17)
        yield bucket.astype(np.int64), owner[:n][fine], lo, hi - lo


@dataclass
class TextModel:
    languages: list[str]
    log_share: np.ndarray  # buckets x languages
    least: np.ndarray  # by language: least mean likelihood a trigram that is like it

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood a trigram under each language, and the number of trigrams, of each text."""
        sums, counts = np.zeros((len(column), len(self.languages))), np.zeros(len(column), np.int64)
        for bucket, owner, lo, n in trigrams(column):
            if len(owner):
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                sums[lo + owner[first]] = np.add.reduceat(self.log_share[bucket], first, axis=0)
                counts[lo : lo + n] = np.bincount(owner, minlength=n)
        return sums / np.maximum(counts, 1)[:, None], counts


COUNT_DDL = "language string, bucket int, n long"
SPREAD_DDL = "language string, n long, total double, squares double"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        names = np.array(batch.column(0).to_pylist(), object)
        for bucket, owner, lo, _ in trigrams(batch.column(1)):
            own = names[lo + owner]
            for name in set(own.tolist()):
                sums[name] = sums.get(name, 0) + np.bincount(bucket[own == name], minlength=BUCKETS)
    for name, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["language", "bucket", "n"])


def _spread(model: TextModel):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: k for k, x in enumerate(model.languages)}
        for batch in batches:
            mean, n = model.score(batch.column(1))
            names = batch.column(0).to_pylist()
            own = np.array([mean[i, place.get(x, 0)] for i, x in enumerate(names)]) if names else np.zeros(0)
            fine = n >= 50
            yield pa.RecordBatch.from_arrays([pa.array([x for x, f in zip(names, fine, strict=True) if f], pa.string()), pa.array(np.ones(int(fine.sum()), np.int64)), pa.array(own[fine]), pa.array(own[fine] ** 2)], names=["language", "n", "total", "squares"])

    return spread


def quotas(counts: dict[str, int], most: int) -> dict[str, int]:
    """``most`` rows dealt evenly over the languages; what a language doesn't have goes to the others."""
    out, left = {}, most
    for k, (name, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(n, -(-left // (len(counts) - k)))
        left -= out[name]
    return out


def _sample(known: DataFrame, most: int) -> DataFrame:
    """Ids of the sample, drawn by language. Hashes keep about twice a quota, so that only these rows are ranked."""
    counts = {r.language: r["count"] for r in known.groupBy("language").count().orderBy(F.desc("count"), "language").limit(most).collect()}
    shares = [(name, q, min(1.0, (2 * q + 50) / counts[name])) for name, q in quotas(counts, most).items()]
    shares = known.sparkSession.createDataFrame(shares, "language string, quota int, share double")
    h = F.xxhash64("_id")
    near = known.join(F.broadcast(shares), "language").filter((F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))) <= F.col("share")).select("_id", "language", "quota").distinct()
    rank = F.row_number().over(Window.partitionBy("language").orderBy(h, "_id"))
    return near.withColumn("_rank", rank).filter("_rank <= quota").select("_id", "language")


def fit_text_model(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str = "lang", most: int = MAX_SAMPLE) -> TextModel:
    """A model of the languages of at most ``most`` rows with text and language; without any, one that rejects all texts."""
    known = df.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{language_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    known = known.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{language_col}`").alias("language"), F.col(f"`{text_col}`").alias("text"))
    own = known.join(F.broadcast(_sample(known.select("_id", "language"), most)), ["_id", "language"]).select("language", "text")
    counts = own.mapInArrow(kernel.task(_count), COUNT_DDL).groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return TextModel(["und"], np.zeros((BUCKETS, 1)), np.array([np.inf]))
    names = sorted(counts["language"].unique())
    table = np.full((BUCKETS, len(names)), 0.5)
    for k, name in enumerate(names):
        part = counts[counts["language"] == name]
        table[part["bucket"].to_numpy(), k] += part["n"].to_numpy()
    log_share = np.log(table / table.sum(axis=0))
    unseen, mean = log_share.min(axis=0), ((table - 0.5) * log_share).sum(axis=0) / (table - 0.5).sum(axis=0)
    model = TextModel(names, log_share, unseen + ABOVE_UNSEEN * (mean - unseen))
    rows = own.mapInArrow(kernel.task(_spread(model)), SPREAD_DDL).groupBy("language").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("s")).collect()
    for r in rows:
        mean = r.t / r.n
        deviation = max(r.s / r.n - mean * mean, 1e-6) ** 0.5
        k = names.index(r.language)
        model.least[k] = max(model.least[k], mean - SIGMAS * max(deviation, 0.02 * abs(mean)))
    return model


def _text_evidence(model: TextModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean, n = model.score(batch.column(1))
            best = mean.argmax(axis=1)
            like = (mean[np.arange(len(mean)), best] >= model.least[best]) & (n > 0)
            log = mean * n[:, None] * TEMPER
            log -= log.max(axis=1, keepdims=True) if len(log) else 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, log.size + 1, log.shape[1]), pa.int32()), pa.array(log.ravel()))
            names = pa.array([model.languages[k] if ok else None for k, ok in zip(best, n > 0, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2, batch.num_columns)), lists, names, pa.array(like)], names=[*batch.schema.names[2:], "_log", "_text_language", "_like"])

    return score


def text_evidence(df: DataFrame, model: TextModel, text: Column, carry: dict[str, Column]) -> DataFrame:
    """The columns ``carry`` with _log (by language, best 0), _text_language and _like of each row's whole text."""
    rows = df.select(F.lit(0).alias("_0"), text.cast("string").alias("_1"), *[c.alias(n) for n, c in carry.items()])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(kernel.task(_text_evidence(model)), f"{ddl}, _log array<double>, _text_language string, _like boolean")


def priors(evidence: DataFrame, languages: list[str]) -> tuple[DataFrame, DataFrame, dict[str | None, list[float]], list[float]]:
    """Counts by host; log priors by host and suffix; log likelihoods of each declaration; the table's log prior.

    A host's counts are first summed over its rows where they lie, so a host with a third of them is no burden.
    """
    names = [F.lit(x) for x in languages]
    fits = F.col("_text_language").isNotNull() & F.col("_like")
    own = [F.sum(F.when(fits & (F.col("_text_language") == x), 1.0).otherwise(0.0)).alias(f"h{k}") for k, x in enumerate(names)]
    counts = store.written(evidence.groupBy("_host", "_suffix", "_declared").agg(F.count("*").alias("n"), *own), "language-counts")
    sums = lambda p, q: [F.sum(f"{p}{k}").alias(f"{q}{k}") for k in range(len(names))]
    hosts = store.written(counts.groupBy("_host", "_suffix").agg(F.sum("n").alias("n"), *sums("h", "h")), "host-counts")
    suffixes = hosts.groupBy("_suffix").agg(*sums("h", "s"))
    total = suffixes.agg(*sums("s", "t")).first()
    whole = np.array([x or 0.0 for x in total]) + 1
    whole /= whole.sum()
    sum_of = lambda p: sum((F.col(f"{p}{k}") for k in range(1, len(names))), F.col(f"{p}0"))
    smooth = suffixes.select("_suffix", *[((F.col(f"s{k}") + SUFFIX_WEIGHT * float(whole[k])) / (sum_of("s") + SUFFIX_WEIGHT)).alias(f"p{k}") for k in range(len(names))])
    near = hosts.join(smooth.withColumnRenamed("_suffix", "_suffix2"), F.col("_suffix").eqNullSafe(F.col("_suffix2")))
    prior = F.array(*[F.log((F.col(f"h{k}") + HOST_WEIGHT * F.col(f"p{k}")) / (sum_of("h") + HOST_WEIGHT)) for k in range(len(names))]).alias("_prior")
    # Declarations are folded into the known languages, "other" and none, so the table has a fixed size.
    said = counts.groupBy("_declared").agg(*sums("h", "d")).collect()
    found = {r._declared: np.array(r[1:]) for r in said}
    by_language = sum((v for d, v in found.items() if d is not None), np.zeros(len(names)))
    kinds = [*languages, "other"]
    declared = {d: np.log((found.get(d, 0) + DECLARED_WEIGHT / len(kinds)) / (by_language + DECLARED_WEIGHT)).tolist() for d in kinds}
    return hosts, store.written(near.select("_host", "_suffix", prior), "host-priors"), declared | {None: [0.0] * len(names)}, np.log(whole).tolist()


def folded(declared: Column, languages: list[str]) -> Column:
    """A declared language tag as one of ``languages``, "other", or null; regions are dropped."""
    tag = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]+)", 1))
    return F.when(declared.isNull() | (tag == ""), None).when(tag.isin(languages), tag).otherwise(F.lit("other"))


def suffix_of(host: Column) -> Column:
    """What stands after a host's last dot, empty if it has none."""
    return F.when(host.contains("."), F.lower(F.substring_index(host, ".", -1))).otherwise(F.lit(""))


def identify(df: DataFrame, model: TextModel, text: Column, host: Column, declared: Column, carry: dict[str, Column]) -> DataFrame:
    """``carry`` with language, confidence, text_language, declared_language and kept, for each row of ``df``.

    Null and empty texts are rejected, with the language that the other evidence suggests; null and empty
    hosts are one host; a null declaration is no evidence. Repeated rows are kept; an empty table gives no rows; names in
    ``carry`` must not begin with an underscore and a known one of this module, other columns don't matter. Every
    text is read and scored once; what was found is written beside ``carry`` and read for the verdicts. Rows
    meet the table of hosts where they lie if its measured size is at most ``SMALL_BYTES``; else they are shuffled by
    host, and those of a host with very many are dealt over many tasks.
    """
    names = model.languages
    own = {"_host": F.coalesce(host.cast("string"), F.lit("")), "_suffix": suffix_of(F.coalesce(host.cast("string"), F.lit(""))), "_declared": folded(declared.cast("string"), names)}
    found = text_evidence(df, model, text, {**carry, **own}).withColumn("_row", F.monotonically_increasing_id())
    rows = store.written(found, "language-evidence")
    counts, hosts, declarations, whole = priors(rows, names)
    n, length = counts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_host") + F.octet_length("_suffix")), F.lit(0))).first()
    if length + 8 * n * len(names) <= SMALL_BYTES:
        rows = rows.join(F.broadcast(hosts), ["_host", "_suffix"], "left")
    else:
        rows = skew.join(rows, hosts, ["_host", "_suffix"], skew.heavy_of(counts, rows.count()), ["_row"], "left")
    prior = F.coalesce("_prior", F.array(*map(F.lit, whole)))
    said = F.lit(None).cast("array<double>")
    for d, v in declarations.items():
        said = F.when(F.col("_declared").eqNullSafe(F.lit(d)), F.array(*map(F.lit, v))).otherwise(said)
    log = F.transform("_log", lambda x, i: x + prior[i] + said[i])
    rows = rows.withColumn("_sum", log).withColumn("_top", F.array_max("_sum"))
    rows = rows.withColumn("confidence", 1 / F.aggregate("_sum", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top"))))
    best = F.array(*map(F.lit, names))[F.array_position("_sum", F.col("_top")).cast("int") - 1]
    return rows.select(*[F.col(f"`{n}`") for n in carry], best.alias("language"), "confidence", F.col("_text_language").alias("text_language"), F.col("_declared").alias("declared_language"), (F.col("_like") & (F.col("confidence") >= 0.5)).alias("kept"))
