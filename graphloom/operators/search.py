"""Ranked search: query language, retrieval, re-ranking, fallback, suggestions.

A query is a handful of words, so it is parsed on the driver and becomes literals of one plan over the search
table: filters reach the scan, every candidate is scored in one projection, and the top is a bounded sort.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text

#: Limits and factors of candidates, and boosts of exact, prefix and fuzzy retrieval by field.
MAX_CANDIDATES, FACTOR, FILTERED_FACTOR, MAX_INPUTS = 200, 5, 30, 4096
BOOSTS = {"name": (3.0, 2.0, 0.5), "path": (2.0, 1.5, 0.375), "kind": (1.0, 1.0, 0.25)}
FIELDS = tuple(BOOSTS)
K1, B = 1.2, 0.75


@dataclass
class Query:
    terms: list[tuple[str, bool]] = field(default_factory=list)
    kind: str | None = None
    prefix: str | None = None
    diagnostics: list[str] = field(default_factory=list)


def parse(raw: str) -> Query:
    """Words, "quoted words", t:/type:kind and in:path. A wholly quoted word is never a filter."""
    out, i, n = Query(), 0, len(raw)
    while i < n:
        if raw[i].isspace():
            i += 1
            continue
        word, quoted, bare, open_ = "", False, False, False
        while i < n and (open_ or not raw[i].isspace()):
            c = raw[i]
            i += 1
            if c == '"':
                if open_ and not word:
                    out.diagnostics.append("empty_quoted_term")
                quoted, open_ = True, not open_
                continue
            bare |= not open_
            word += c
        if open_:
            out.diagnostics.append("unterminated_quote")
        whole = quoted and not bare
        name, colon, value = word.partition(":")
        name = name.lower()
        if colon and not whole and name in ("t", "type", "in"):
            key = "in" if name == "in" else "type"
            if not value.strip():
                out.diagnostics.append("missing_filter_value")
            elif (out.prefix if key == "in" else out.kind) is not None:
                out.diagnostics.append("duplicate_filter")
            elif key == "in":
                out.prefix = value.strip()
            else:
                kind = next((k for k, names in text.KIND_ALIASES.items() if value.strip().lower() in names), None)
                if kind:
                    out.kind = kind
                else:
                    out.diagnostics.append("unsupported_type_filter")
        elif word or quoted:
            out.terms.append((word, whole))
    if not raw.strip():
        out.diagnostics.append("empty_query")
    return out


def prepared(docs: DataFrame, ascii_only: bool = True) -> DataFrame:
    """The search table: texts as they are compared, once, when the table is made."""
    made = {}
    for f in ("name", "path", "kind"):
        made[f"{f}_norm"] = text.normalized(F.col(f), ascii_only)
        made[f"{f}_terms"] = text.to_terms(F.col(f), ascii_only)
    return docs.withColumns(made)


def counted(table: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(term, field, stable_key, tf, length): terms counted in their document's own row, so that no task holds those of all.

    Rows are dealt by key first, and those of one key become one; length is how many terms the field has in the document.
    """
    return _dealt(table, fields).select("stable_key", F.explode(F.flatten(F.array(*map(_counts_of, fields)))).alias("p")).select("p.term", "p.field", "stable_key", "p.tf", "p.length")


def lengths(table: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(stable_key, field, length): how many terms a field has in a document; a row for each that has any."""
    sizes = F.array(*[F.struct(F.lit(f).alias("field"), F.size(_terms_of(f)).cast("long").alias("length")) for f in fields])
    return _dealt(table, fields).select("stable_key", F.explode(sizes).alias("s")).select("stable_key", "s.field", "s.length").filter("length > 0")


def _dealt(table: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """stable_key and terms by field, a row a key."""
    dealt = table.select("stable_key", *[f"{f}_terms" for f in fields]).repartition("stable_key")
    return dealt.groupBy("stable_key").agg(*[F.concat_ws(" ", F.collect_list(f"{f}_terms")).alias(f"{f}_terms") for f in fields])


def _terms_of(name: str) -> Column:
    return F.filter(F.split(F.col(f"{name}_terms"), " "), lambda t: t != "")


def postings(table: DataFrame) -> DataFrame:
    """(term, field, stable_key, tf): the inverted index, to be stored bucketed or sorted by term."""
    return counted(table, FIELDS).drop("length")


def _counts_of(name: str) -> Column:
    """The terms of a field, each once, with their number: runs of its sorted terms."""
    terms = F.sort_array(_terms_of(name))
    starts = lambda s: F.filter(F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    run = lambda s, b, i, k: F.struct(F.get(s, i).alias("term"), F.lit(name).alias("field"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("long").alias("tf"), F.size(s).cast("long").alias("length"))
    # arrays of one bind a value to a name: it is made once a row
    return F.flatten(F.transform(F.array(terms), lambda s: F.element_at(F.transform(F.array(starts(s)), lambda b: F.transform(b, lambda i, k: run(s, b, i, k))), 1)))


def bm25(index: DataFrame, terms: list[str], n_docs: int, lengths: DataFrame) -> DataFrame:
    """(stable_key, retrieval_score): sum over terms and fields of boosted BM25; every term must occur somewhere.

    index: a row a term, field and document, with its length or without. lengths: stable_key, field, length. Scores are rounded to millionths, so that sums in any order compare alike.
    """
    own = index.filter(F.col("term").isin(terms))
    df = own.groupBy("term", "field").agg(F.count("*").alias("df"))
    mean = lengths.groupBy("field").agg(F.avg("length").alias("mean"))
    sized = own if "length" in own.columns else own.join(lengths, ["stable_key", "field"])
    joined = sized.join(F.broadcast(df), ["term", "field"]).join(F.broadcast(mean), "field")  # a row a query term and field
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    boost = F.when(F.col("field") == "name", BOOSTS["name"][0]).when(F.col("field") == "path", BOOSTS["path"][0]).otherwise(BOOSTS["kind"][0])
    part = boost * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = joined.groupBy("stable_key").agg(F.sum(F.round(part * 1e6).cast("long")).alias("retrieval_score"), F.countDistinct("term").alias("n"))
    return scored.filter(F.col("n") == len(set(terms))).select("stable_key", "retrieval_score")


def filtered(table: DataFrame, q: Query) -> DataFrame:
    out = table
    if q.kind:
        out = out.filter(F.col("kind_norm") == q.kind.lower())
    if q.prefix:
        out = out.filter(F.startswith("path_norm", F.lit(q.prefix.lower())))
    return out


def term_match(term: str, quoted: bool, fuzzy: bool) -> Column:
    """struct<kind, rank, field, boost, fuzzy>: the best strict match over name, path and kind; else, if asked, the first fuzzy one."""
    norm, terms = F.lit(unicodedata.normalize("NFKC", term).lower()), F.lit(text.terms_of(term))

    def one(f: str) -> Column:
        rank = text.match_rank(terms, F.col(f"{f}_terms"), not quoted)
        if not quoted:
            rank = F.least(text.match_rank(norm, F.col(f"{f}_norm")), rank)
        return F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.lit(-text.FIELD_BOOST[f]).alias("minus_boost"), F.lit(0).cast("long").alias("minus_fuzzy")))

    strict = F.array_min(F.filter(F.array(*map(one, ("name", "path", "kind"))), lambda m: m.isNotNull()))
    if not fuzzy or quoted:
        return strict
    scores = [(f, text.fuzzy_score(norm, F.col(f"{f}_terms"))) for f in ("name", "path", "kind")]
    loose = F.coalesce(*[F.when(s.isNotNull(), F.struct(F.lit(text.KIND_RANK["fuzzy"]).alias("rank"), F.lit(-text.FIELD_BOOST[f]).alias("minus_boost"), (-s).cast("long").alias("minus_fuzzy"))) for f, s in scores])
    return F.coalesce(strict, loose)


def ranked(table: DataFrame, q: Query, limit: int, fuzzy: bool = False) -> DataFrame:
    """The best ``limit`` rows that match every term: rank, stable_key, match_kind, field_boost, fuzzy_score, path, name."""
    rows = filtered(table, q)
    if q.terms:
        # the matches of a row are computed once and summed up in one value; rows without a match sort last and go after the limit
        matches = F.array(*[term_match(t, quoted, fuzzy) for t, quoted in q.terms])
        total = lambda ms, part: -F.aggregate(ms, F.lit(0).cast("long"), lambda a, m: a + m[part])
        summed = lambda ms: F.when(F.forall(ms, lambda m: m.isNotNull()), F.struct(F.array_max(F.transform(ms, lambda m: m["rank"])).alias("kind_rank"), total(ms, "minus_boost").cast("int").alias("field_boost"), total(ms, "minus_fuzzy").alias("fuzzy_score")))
        rows = rows.withColumn("_r", F.element_at(F.transform(F.array(matches), summed), 1))
    else:
        rows = rows.withColumn("_r", F.struct(F.lit(text.KIND_RANK["none"]).alias("kind_rank"), F.lit(0).alias("field_boost"), F.lit(0).cast("long").alias("fuzzy_score")))
    scored = rows.select("stable_key", "name", "path", "path_norm", "name_norm", "_r")
    order = [F.asc_nulls_last("_r.kind_rank"), F.desc("_r.field_boost"), F.desc("_r.fuzzy_score"), "path_norm", "name_norm", "stable_key"]
    top = scored.orderBy(*order).limit(limit)
    ranks = top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).filter("_r is not null")
    return ranks.select("rank", "stable_key", text.kind_name(F.col("_r.kind_rank")).alias("match_kind"), "_r.field_boost", "_r.fuzzy_score", "name", "path")


def search(table: DataFrame, raw: str, limit: int = 25) -> DataFrame:
    """Strict ranking; if no row matches better than by typo and a word is long enough for one, the fuzzy ranking."""
    q = parse(raw)
    if q.diagnostics:
        return ranked(table, Query(), 0)
    strict = ranked(table, q, limit)
    if any(not quoted and 3 <= len(t) <= 64 for t, quoted in q.terms) and strict.isEmpty():
        return ranked(table, q, limit, fuzzy=True)
    return strict


def candidate_limit(limit: int, is_filtered: bool) -> int:
    return min(limit * (FILTERED_FACTOR if is_filtered else FACTOR), MAX_CANDIDATES, MAX_INPUTS)


def match_count(table: DataFrame, q: Query, limit: int) -> DataFrame:
    """How many of the bounded candidates match, and whether that is exact or a lower bound."""
    bound = candidate_limit(limit, bool(q.kind or q.prefix))
    found = ranked(table, q, bound + 1)
    return found.agg(F.least(F.count("*"), F.lit(bound)).alias("matches"), F.when(F.count("*") > bound, "lower_bound").otherwise("exact").alias("relation"))


def suggest_kinds(prefix: str, limit: int = 50) -> list[str]:
    return [f"t:{k}" for k in text.KIND_ALIASES if k.lower().startswith(prefix.lower())][:limit]


def suggest_paths(table: DataFrame, prefix: str, limit: int = 50) -> DataFrame:
    """Folders next below ``prefix``, in order: folders are made distinct before anything is sorted."""
    folders = table.select(F.expr("left(path, length(path) - length(substring_index(path, '/', -1)))").alias("folder")).distinct()
    own = folders.filter(F.startswith("folder", F.lit(prefix)))
    return own.select(F.concat(F.lit("in:"), text.immediate_path(F.col("folder"), prefix)).alias("suggestion")).distinct().orderBy("suggestion").limit(limit)


def context(values: Column, tokens: list[str], most: int) -> Column:
    """The first ``most`` stored values that hold any of the tokens."""
    return F.slice(F.filter(values, lambda v: F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower(v), t))), 1, most)
