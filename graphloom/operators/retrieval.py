"""Search over an index in stages: prepare, retrieve, ingest, evaluate, fall back, rank.

The index is a table of postings; a query's tokens are matched with its distinct terms, so that neither texts nor
postings of other terms are read. What is retrieved is bounded, so everything after that is work on a few hundred
rows. Whatever a limit hides is said in a diagnostic, and the number of matches is then a lower bound.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import search
from graphloom.plans.settle import settled

#: Limits of a query and of its candidates, in bytes or pieces.
LIMITS = {
    "query_bytes": 4 * 1024, "query_terms": 128, "retrieval_terms": 256, "candidate_inputs": 4096, "stable_key": 4 * 1024, "name": 16 * 1024, "path": 32 * 1024,
    "kind": 1024, "guid": 128, "container_source_path": 32 * 1024, "evidence_items": 256, "total_candidate_bytes": 4 * 1024 * 1024, "fuzzy_work_units": 2_000_000,
}
#: Codes of what may be wrong with a query or its candidates. Those after the first list don't block it.
BLOCKING = ("empty_query", "unterminated_quote", "empty_quoted_term", "missing_filter_value", "duplicate_filter", "unsupported_type_filter", "query_byte_limit_exceeded", "query_term_limit_exceeded", "retrieval_term_limit_exceeded")
HIDING = ("candidate_limit_exceeded", "candidate_field_byte_limit_exceeded", "candidate_total_byte_limit_exceeded", "candidate_input_limit_exceeded", "candidate_evidence_limit_exceeded", "fuzzy_work_limit_exceeded", "invalid_retrieval_evidence")
CODES = (*BLOCKING, *HIDING, "duplicate_candidate_key")
#: Boosts of exact, prefix and fuzzy retrieval by field.
BOOSTS = search.BOOSTS | {"content": (1.2, 1.0, 0.25)}
#: Bytes that a piece of evidence counts for.
EVIDENCE_BYTES = 16
STRICT, FALLBACK = 0, 1


def severity(code: str) -> str:
    return "error" if code in BLOCKING else "warning"


def fuzzy_distance(length: int) -> int:
    """Edits allowed for a token of so many characters; 0 if it is too short or too long for any."""
    return 0 if not 3 <= length <= 64 else 1 if length <= 7 else 2


@dataclass
class Prepared:
    """A parsed query within its limits, and what is to be retrieved for it."""

    query: search.Query
    limit: int
    diagnostics: list[str] = field(default_factory=list)

    @property
    def blocked(self) -> bool:
        return any(d in BLOCKING for d in self.diagnostics)

    def candidate_limit(self) -> int:
        if self.limit == 0 or self.blocked:
            return 0
        return search.candidate_limit(self.limit, bool(self.query.kind or self.query.prefix))

    def tokens(self, stage: int) -> list[tuple[int, str, int]]:
        """(number of the query's term, token, edits allowed): edits in the fallback stage and outside quotes only."""
        if self.blocked:
            return []
        out = []
        for i, (term, quoted) in enumerate(self.query.terms):
            for token in text.terms_of(term).split():
                out.append((i, token, fuzzy_distance(len(token)) if stage == FALLBACK and not quoted else 0))
        return out

    def may_fall_back(self) -> bool:
        lengths = [len(unicodedata.normalize("NFKC", t).lower()) for t, quoted in self.query.terms if not quoted]
        return any(3 <= n <= 64 for n in lengths)


def prepare(raw: str, limit: int = 25) -> Prepared:
    """Parses a query and checks it against the limits of its bytes, terms and tokens."""
    if len(raw.encode()) > LIMITS["query_bytes"]:
        return Prepared(search.Query(), limit, ["query_byte_limit_exceeded"])
    q = search.parse(raw)
    out = Prepared(q, limit, list(q.diagnostics))
    if len(q.terms) > LIMITS["query_terms"]:
        out.diagnostics.append("query_term_limit_exceeded")
    if sum(len(text.terms_of(t).split()) for t, _ in q.terms) > LIMITS["retrieval_terms"]:
        out.diagnostics.append("retrieval_term_limit_exceeded")
    return out


def quantised(score: Column) -> Column:
    """A score in millionths as a whole number; what isn't finite sorts last."""
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    return F.when(finite, F.round(score * 1e6).cast("long")).otherwise(F.lit(-(2**63)).cast("long"))


def index(docs: DataFrame, ascii_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """The search table and its postings (term, field, stable_key, tf, length). docs: stable_key, name, path, kind, content."""
    table = search.prepared(docs, ascii_only).withColumn("content_terms", text.to_terms(F.coalesce("content", F.lit("")), ascii_only))
    return table, search.counted(table, tuple(BOOSTS))


def vocabulary_matches(postings: DataFrame, tokens: list[tuple[int, str, int]], raw: bool = False) -> DataFrame:
    """(number, token, term, kind): the index's distinct terms that a token means: 0 exact, 1 by its beginning, 2 by edits.

    A swap of two neighbours is one edit. A row for each token and term at most: the best kind.
    """
    spark = postings.sparkSession
    wanted = spark.createDataFrame([(k, i, t, d) for k, (i, t, d) in enumerate(tokens)], "token int, number int, text string, edits int")
    vocabulary = postings.select("term").distinct()
    kind = F.when(F.col("term") == F.col("text"), 0).when(F.startswith("term", F.col("text")), 1)
    near = F.when((F.col("edits") > 0) & (F.abs(F.length("term") - F.length("text")) <= F.col("edits")), edits_within(F.col("text"), F.col("term"), F.col("edits")))
    kind = kind.when(near, 2)
    # the tokens of a query are at most LIMITS["retrieval_terms"] rows
    return vocabulary.join(F.broadcast(wanted), kind.isNotNull()).select("token", "number", "term", kind.alias("kind"))


def _swaps(a: Column) -> Column:
    """All texts that one swap of neighbours makes of ``a``, which has two characters at least."""
    return F.transform(F.sequence(F.lit(1), F.length(a) - 1), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))))


def edits_within(a: Column, b: Column, most: Column) -> Column:
    """Whether ``a`` becomes ``b`` by at most ``most`` (1 or 2) edits at different places, a swap of neighbours being one."""
    letters = lambda x: F.array_sort(F.split(x, ""))
    one = F.exists(_swaps(a), lambda s: F.levenshtein(s, b) <= most - 1)
    two = (most > 1) & (letters(a) == letters(b)) & F.exists(_swaps(a), lambda s: F.exists(_swaps(s), lambda t: t == b))
    return (F.levenshtein(a, b) <= most) | ((F.length(a) > 1) & (one | two))


def retrieve(table: DataFrame, postings: DataFrame, n_docs: int, prepared: Prepared, stage: int = STRICT, exclude: DataFrame | None = None) -> DataFrame:
    """The best candidates by (score, key), one more than the limit: stable_key, name, path, kind, retrieval_score, evidence.

    Every token must occur in some field. An exact term scores by BM25, others by their field's boost alone. Evidence
    is what the content holds: token, substring or fuzzy for each term of the query all of whose tokens it has.
    """
    tokens = prepared.tokens(stage)
    rows = search.filtered(table, prepared.query)
    if exclude is not None:
        rows = rows.join(exclude.select("stable_key"), "stable_key", "left_anti")
    none = F.array().cast("array<struct<term_index:int,kind:string>>")
    if not tokens:
        found = rows.withColumns({"retrieval_score": F.lit(0).cast("long"), "evidence": none})
    else:
        # written, so that Spark knows how few terms are meant and postings of others aren't shuffled
        meant = settled(vocabulary_matches(postings, tokens))
        own = postings.join(meant, "term")
        frequency = settled(postings.join(meant.select("term").distinct(), "term", "left_semi").groupBy("term", "field").agg(F.count("*").alias("df")))
        mean = postings.groupBy("field", "stable_key").agg(F.max("length").alias("length")).groupBy("field").agg(F.avg("length").alias("mean"))
        scored = own.join(frequency, ["term", "field"]).join(F.broadcast(mean), "field")  # a row a field
        idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        bm25 = idf * F.col("tf") * (search.K1 + 1) / (F.col("tf") + search.K1 * (1 - search.B + search.B * F.col("length") / F.col("mean")))
        boost = F.lit(0.0)
        for f, values in BOOSTS.items():
            for k, v in enumerate(values):
                boost = F.when((F.col("field") == f) & (F.col("kind") == k), v).otherwise(boost)
        # of the terms that a token means in a field, the best of each kind counts
        each = scored.groupBy("stable_key", "token", "number", "field", "kind").agg(F.max(quantised(boost * F.when(F.col("kind") == 0, bm25).otherwise(1.0))).alias("part"))
        by_token = each.groupBy("stable_key", "token", "number").agg(F.sum("part").alias("part"), F.min(F.when(F.col("field") == "content", F.col("kind"))).alias("held"))
        n_tokens = F.create_map(*[F.lit(x) for i in sorted({i for i, *_ in tokens}) for x in (i, sum(j == i for j, *_ in tokens))])
        by_term = by_token.groupBy("stable_key", "number").agg(F.sum("part").alias("part"), F.count("*").alias("n"), F.count("held").alias("n_held"), F.max("held").alias("held"))
        name = F.element_at(F.array(F.lit("token"), F.lit("substring"), F.lit("fuzzy")), F.col("held") + 1)
        item = F.when(F.col("n_held") == n_tokens[F.col("number")], F.struct(F.col("number").alias("term_index"), name.alias("kind")))
        keys = by_term.groupBy("stable_key").agg(F.sum("part").alias("retrieval_score"), F.sum("n").alias("n"), F.array_sort(F.collect_list(item)).alias("evidence"))
        found = rows.join(keys.filter(F.col("n") == len(tokens)).drop("n"), "stable_key")
    found = found.select("stable_key", "name", "path", "kind", "retrieval_score", "evidence")
    return found.orderBy(F.desc("retrieval_score"), "stable_key").limit(prepared.candidate_limit() + 1)


@dataclass
class Outcome:
    matches: DataFrame
    count: int
    relation: str
    fallback_used: bool
    truncated: bool
    provided: int
    eligible: int
    diagnostics: list[str]


def ingest(candidates: DataFrame, prepared: Prepared, limits: dict | None = None) -> tuple[DataFrame, list[str], int]:
    """What is let in of some candidates, in their order of priority; the diagnostics; how many were looked at.

    A candidate with a field or evidence beyond its limit is left out, and so are all from the one on with which the
    bytes of all let in would exceed theirs. Evidence must name a term of the query and say how it matched. Of
    candidates of one key the best stays, with the evidence of all.
    """
    limits = LIMITS | (limits or {})
    order = [F.desc("retrieval_score"), "stable_key", "path", "name", "kind"]
    most = limits["candidate_inputs"]
    few = candidates.orderBy(*order).limit(most + 1).withColumn("_at", F.row_number().over(Window.orderBy(*order)))  # most + 1 rows
    sized = [F.octet_length(f) for f in ("stable_key", "name", "path", "kind")]
    wide = sum((F.when(n > limits[f], 1).otherwise(0) for f, n in zip(("stable_key", "name", "path", "kind"), sized, strict=True)), F.lit(0))
    n_evidence = F.size("evidence")
    bytes_of = sum(sized, F.lit(0)) + n_evidence * EVIDENCE_BYTES
    problem = F.when(F.col("_at") > most, "candidate_input_limit_exceeded").when(wide > 0, "candidate_field_byte_limit_exceeded").when(n_evidence > limits["evidence_items"], "candidate_evidence_limit_exceeded")
    rows = few.withColumns({"_problem": problem, "_bytes": F.when(problem.isNull(), bytes_of).otherwise(0)})
    running = F.sum("_bytes").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_sum", running).withColumn("_problem", F.when(F.col("_problem").isNull() & (F.col("_sum") > limits["total_candidate_bytes"]), "candidate_total_byte_limit_exceeded").otherwise(F.col("_problem")))
    fuzzy = [not quoted and any(fuzzy_distance(len(t)) for t in text.terms_of(term).split()) for term, quoted in prepared.query.terms]
    allowed = F.array(*map(F.lit, fuzzy)) if fuzzy else F.array().cast("array<boolean>")
    wrong = lambda e: (e["term_index"] < 0) | (e["term_index"] >= len(fuzzy)) | e["kind"].isNull() | (e["kind"] == "none") | ((e["kind"] == "fuzzy") & ~F.coalesce(F.get(allowed, e["term_index"]), F.lit(False)))
    rows = rows.withColumn("_problem", F.when(F.col("_problem").isNull() & F.exists("evidence", wrong), "invalid_retrieval_evidence").otherwise(F.col("_problem")))
    rows = settled(rows)
    good = search.filtered(rows.filter("_problem is null").withColumns({"kind_norm": F.lower("kind"), "path_norm": text.normalized(F.col("path"))}), prepared.query)
    best = F.min_by(F.struct("retrieval_score", "name", "path", "kind"), F.struct(-F.col("retrieval_score"), "path", "name", "kind"))
    merged = good.groupBy("stable_key").agg(best.alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"), F.count("*").alias("_n"))
    merged = settled(merged.select("stable_key", "b.*", "evidence", "_n"))
    codes = [r[0] for r in rows.filter("_problem is not null").select("_problem").distinct().collect()]
    codes += ["duplicate_candidate_key"] if not merged.filter("_n > 1").isEmpty() else []
    return merged.drop("_n"), sorted(codes, key=CODES.index), rows.filter(F.col("_at") <= most).count()


def _best(candidates: DataFrame, limit: int) -> DataFrame:
    return candidates.orderBy(F.desc("retrieval_score"), "stable_key").limit(limit)


def _matched(candidates: DataFrame, q: search.Query, fuzzy: bool) -> DataFrame:
    """Candidates that match every term, with kind_rank, field_boost and fuzzy_score; evidence counts as the content's match."""
    rows = candidates
    for f in ("name", "path", "kind"):
        rows = rows.withColumns({f"{f}_norm": text.normalized(F.col(f)), f"{f}_terms": text.to_terms(F.col(f))})
    zero = F.lit(0).cast("long")
    if not q.terms:
        return rows.withColumns({"kind_rank": F.lit(text.KIND_RANK["none"]), "field_boost": F.lit(0), "fuzzy_score": zero})
    ranks = F.create_map(*[F.lit(x) for item in text.KIND_RANK.items() for x in item])

    def one(i: int, term: str, quoted: bool) -> Column:
        mine = F.filter("evidence", lambda e: e["term_index"] == i)
        shown = F.transform(mine, lambda e: F.struct(ranks[e["kind"]].alias("rank"), F.lit(-text.FIELD_BOOST["content"]).alias("minus_boost"), zero.alias("minus_fuzzy")))
        strict = F.array_min(F.filter(F.concat(F.array(search.term_match(term, quoted, False)), F.filter(shown, lambda m: m["rank"] < text.KIND_RANK["fuzzy"])), lambda m: m.isNotNull()))
        if not fuzzy or quoted:
            return strict
        return F.coalesce(strict, search.term_match(term, quoted, True), F.array_min(shown))

    matches = F.array(*[one(i, t, quoted) for i, (t, quoted) in enumerate(q.terms)])
    summed = lambda ms: F.when(F.forall(ms, lambda m: m.isNotNull()), F.struct(F.array_max(F.transform(ms, lambda m: m["rank"])).alias("kind_rank"), F.aggregate(ms, F.lit(0), lambda a, m: a - m["minus_boost"]).alias("field_boost"), F.aggregate(ms, zero, lambda a, m: a - m["minus_fuzzy"]).alias("fuzzy_score")))
    return rows.withColumn("_r", F.element_at(F.transform(F.array(matches), summed), 1)).filter("_r is not null").select("*", "_r.*").drop("_r")


def finish(strict: DataFrame, fallback: DataFrame | None, prepared: Prepared, diagnostics: list[str]) -> tuple[DataFrame, int]:
    """All matches in their final order, first of each key, and how many there are: rank, stable_key, match_kind, signals, name, path and what to highlight in them."""
    parts = _matched(strict, prepared.query, fallback is not None).withColumn("stage", F.lit(STRICT))
    if fallback is not None:
        parts = parts.unionByName(_matched(fallback, prepared.query, True).withColumn("stage", F.lit(FALLBACK)))
    order = ["kind_rank", F.desc("field_boost"), F.desc("fuzzy_score"), "stage", F.desc("retrieval_score"), "path_norm", "name_norm", "stable_key"]
    first = F.row_number().over(Window.partitionBy("stable_key").orderBy(*order))
    ranked = parts.withColumn("_first", first).filter("_first = 1")
    ranked = settled(ranked.withColumn("rank", F.row_number().over(Window.orderBy(*order))))  # bounded candidates
    tokens = [t for term, _ in prepared.query.terms for t in text.terms_of(term).split()]
    shown = [text.highlight_ranges(F.col(f), tokens).alias(f"{f}_ranges") for f in ("name", "path")]
    out = ranked.select("rank", "stable_key", text.kind_name(F.col("kind_rank")).alias("match_kind"), "field_boost", "fuzzy_score", "stage", "retrieval_score", "name", "path", *shown)
    return out, ranked.count()


def execute(table: DataFrame, postings: DataFrame, n_docs: int, raw: str, limit: int = 25) -> Outcome:
    """The best ``limit`` matches of a query, with all that there is to know about how complete they are.

    If a word could be misspelt and no strict candidate matches better than by a typo, candidates by edits are added.
    """
    p = prepare(raw, limit)
    spark: SparkSession = table.sparkSession
    empty = "rank int, stable_key string, match_kind string, field_boost int, fuzzy_score long, stage int, retrieval_score long, name string, path string, name_ranges array<struct<start:int,end:int>>, path_ranges array<struct<start:int,end:int>>"
    if p.blocked or limit == 0:
        return Outcome(spark.createDataFrame([], empty), 0, "lower_bound" if limit == 0 else "exact", False, False, 0, 0, p.diagnostics)
    found = list(p.diagnostics)
    strict, codes, provided = ingest(retrieve(table, postings, n_docs, p), p)
    found += codes
    eligible = strict.count()
    bound = p.candidate_limit()
    if eligible > bound:
        found.append("candidate_limit_exceeded")
    strict = settled(_best(strict, bound))
    confident = _matched(strict, p.query, False)
    fallback = None
    if p.may_fall_back() and confident.filter(F.col("kind_rank") <= text.KIND_RANK["abbreviation"]).isEmpty():
        more, codes, n = ingest(retrieve(table, postings, n_docs, p, FALLBACK, confident.select("stable_key")), p)
        n_more = more.count()
        found += codes + (["candidate_limit_exceeded"] if n_more > bound else [])
        provided, eligible, fallback = provided + n, eligible + n_more, _best(more, bound)
    matches, count = finish(strict, fallback, p, found)
    hidden = any(c in HIDING for c in found)
    return Outcome(matches.filter(F.col("rank") <= limit), count, "lower_bound" if hidden else "exact", fallback is not None, count > limit, provided, eligible, sorted(set(found), key=CODES.index))


def hits_within(matches: DataFrame, most: int) -> DataFrame:
    """The longest run of hits, by rank, whose JSON fits ``most`` bytes together."""
    line = F.to_json(F.struct(*[F.col(c) for c in matches.columns]))
    running = F.sum(F.octet_length(line)).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))  # a page of hits
    return matches.withColumn("_sum", running).filter(F.col("_sum") <= most).drop("_sum")
