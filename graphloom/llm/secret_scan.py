"""Secret scans in DataFrame operations only: patterns, then a battery of randomness tests.

Patterns give the base spans. Beside them, every run of 20 or more characters of the base64 family is a
candidate, and so is each part of it between equals signs and between any separators (a name or a path may be
joined to the secret). Its encoding is inferred (hex, base32, lower or upper letters with digits, base64), and three tests
ask whether its symbols are uniform and independent in that alphabet: chi-squared, runs above and below the
middle, and serial correlation.

The evidence of a candidate is an e-value: how much likelier it is if it is random than if it is not. Not random
may mean two things. Its symbols may be drawn from a fixed model of prose; or their classes are, and given these
each test's statistic may lie anywhere in the range that the candidate's length allows, all being as likely, while
those of random symbols are standard normal. The e-value is the lesser of the ratios to the two, so it holds for
either: a test lowers it where the statistic is farther out than randomness makes plausible, and the longer the
candidate, the wider the range and the more a test may say. As the encoding is chosen by looking at the candidate,
the ratio is divided by the number of encodings to choose from. Its mean over candidates that are not random is
at most 1, and the e-BH rule over all candidates of the table holds the false-discovery rate at ``FDR`` whatever the
dependence between them.

Work on one text is in proportion to its length: positions are running sums in chunks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import store

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = r"(?i)password|passwd|secret|token|api_?key"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Parts of a candidate that are tested by themselves, from the battery's least length on.
PARTS = (r"[A-Za-z0-9+/_-]{16,}", r"[A-Za-z0-9+]{16,}")
FDR = 0.001
#: Items that one running sum goes over; sums of so many sums follow, ``LEVELS`` times.
CHUNK, LEVELS = 128, 2
#: Encodings to choose from: hex and letters with digits come in two cases.
CHOICES = 6
#: Evidence that can't be less, or needn't be told from more.
FLOOR, CEILING = -1000, 2000
#: name, pattern of the whole token, alphabet; the first that fits is the encoding.
ENCODINGS = (
    ("hex", "[0-9a-f]+|[0-9A-F]+", "0123456789abcdef"),
    ("base32", "[A-Z2-7]+", "abcdefghijklmnopqrstuvwxyz234567"),
    ("alnum", "[a-z0-9]+|[A-Z0-9]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", ".*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Model of prose: share of each class of symbols, and the symbols that it is spread over evenly.
PROSE = ((0.40, "aeiou"), (0.52, "bcdfghjklmnpqrstvwxyz"), (0.02, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (0.03, "0123456789"), (0.03, "+/_-="))


SPAN = "array<struct<start:int,order:int,end:int,value:string>>"
INTS = "array<int>"
BARE = "array<struct<start:int,order:int,end:int>>"
MORE = "array<struct<start:int,order:int,end:int,test:struct<encoding:string,n:int,chi:double,runs:double,serial:double,evidence:double>>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _upto(n: Column, of: Callable[[Column], Column], kind: str) -> Column:
    """``of`` each number below ``n``, which may be 0."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), of)).otherwise(F.array().cast(kind))


def _running(df: DataFrame, values: dict[str, Column], join: Callable[[Column, Column], Column]) -> DataFrame:
    """``df`` with, for each array of numbers in ``values``, what ``join`` makes of 0 and the numbers before each.

    Totals of chunks come first, totals of chunks of these next; then running values go down again.
    """
    name = lambda kind, level, n: f"__gl_{kind}{level}_{n}"
    df = df.withColumns({name("t", 0, n): v for n, v in values.items()})

    def chunks(size: Column, of: Callable[[Column], Column], kind: str) -> Column:
        return _upto(F.ceil(size / CHUNK).cast("int"), of, kind)

    def within(c: Column, size: Column) -> Column:
        return F.sequence(c * CHUNK, F.least(c * CHUNK + CHUNK, size) - 1)

    def total(xs: Column, c: Column) -> Column:
        return F.aggregate(within(c, F.size(xs)), F.lit(0), lambda acc, i: join(acc, xs[i]))

    def fold(xs: Column, places: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast(INTS).alias("out"))
        step = lambda acc, i: F.struct(join(acc["at"], xs[i]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(places, start, step, lambda acc: acc["out"])

    for level in range(LEVELS):
        totals = lambda xs: chunks(F.size(xs), lambda c: total(xs, c), INTS)
        df = df.withColumns({name("t", level + 1, n): totals(F.col(name("t", level, n))) for n in values})
    top = {n: F.col(name("t", LEVELS, n)) for n in values}
    df = df.withColumns({name("r", LEVELS, n): F.when(F.size(x) > 0, fold(x, F.sequence(F.lit(0), F.size(x) - 1), F.lit(0))).otherwise(F.array().cast(INTS)) for n, x in top.items()})
    for level in range(LEVELS - 1, -1, -1):
        # bound by name, as the optimizer may put a column's expression into a lambda, to be computed for each item
        folds = lambda xs, firsts: _let(firsts, lambda r: F.flatten(chunks(F.size(xs), lambda c: fold(xs, within(c, F.size(xs)), r[c]), f"array<{INTS}>")))
        df = df.withColumns({name("r", level, n) if level else n: folds(F.col(name("t", level, n)), F.col(name("r", level + 1, n))) for n in values})
    return df.drop(*[name(k, level, n) for n in values for k in "tr" for level in range(LEVELS + 1)])


def _parted(text: Column, pattern: str, kind: int) -> Column:
    """struct<between, found, value>: the matches, what stands between them, and their values."""
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if kind == 0 else 0))
    return F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), group.alias("value"))


def _guarded(text: Column, guard: str, pattern: str, kind: int) -> Column:
    """``_parted``, null for a text without the guard."""
    return F.when(text.rlike(guard), _parted(text, pattern, kind))


def _lengths(p: Column) -> Column:
    return _upto(F.coalesce(F.size(p["found"]), F.lit(0)), lambda i: F.length(p["between"][i]) + F.length(p["found"][i]), INTS)


def _spans(p: Column, at: Column, kind: int) -> Column:
    """The matches, in code points; ``at`` are the running sums of ``_lengths``."""

    def span(i: Column) -> Column:
        start = at[i] + F.length(p["between"][i])
        return F.struct(start.alias("start"), F.lit(kind).alias("order"), (start + F.length(p["found"][i])).alias("end"), p["value"][i].alias("value"))

    return _upto(F.size(at), span, SPAN)


def _blanked(text: Column, guard: str, pattern: str, kind: int) -> Column:
    """``text`` with as many spaces for each match that counts."""

    def filled(p: Column) -> Column:
        blank = lambda i: F.repeat(F.lit(" "), F.length(p["found"][i]))
        own = lambda i: F.when(F.length(p["value"][i]) >= 6, blank(i)).otherwise(p["found"][i]) if kind == 0 else blank(i)
        pieces = _upto(F.size(p["found"]), lambda i: F.concat(p["between"][i], own(i)), "array<string>")
        return F.concat(F.array_join(pieces, ""), F.element_at(p["between"], -1))

    return F.when(text.rlike(guard), _let(_parted(text, pattern, kind), filled)).otherwise(text)


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def battery(token: Column) -> Column:
    """struct<encoding, n, chi, runs, serial, evidence>: normal values of the three tests, and ln of the e-value."""

    def encoded(core: Column) -> Column:
        name = reduce(lambda rest, e: F.when(core.rlike(f"^(?:{e[1]})$"), e[0]).otherwise(rest), reversed(ENCODINGS[:-1]), F.lit(ENCODINGS[-1][0]))
        return _let(F.struct(core.alias("core"), F.length(core).cast("double").alias("n"), name.alias("name")), spelled)

    def spelled(k: Column) -> Column:
        alphabet = reduce(lambda rest, e: F.when(k["name"] == e[0], e[2]).otherwise(rest), ENCODINGS[:-1], F.lit(ENCODINGS[-1][2]))
        folded = F.when(k["name"] == "base64", k["core"]).otherwise(F.lower(k["core"]))
        return _let(F.struct(alphabet.alias("alphabet"), F.length(alphabet).cast("double").alias("size"), folded.alias("folded"), F.regexp_extract_all(folded, F.lit("."), F.lit(0)).alias("symbols")), lambda s: numbered(k, s))

    def numbered(k: Column, s: Column) -> Column:
        values = F.transform(s["symbols"], lambda c: F.instr(s["alphabet"], c).cast("double") - 1)
        return _let(values, lambda values: _let(F.struct((_total(values) / k["n"]).alias("mean"), F.transform(values, lambda v: F.when(v >= s["size"] / 2, 1.0).otherwise(0.0)).alias("upper")), lambda m: tested(k, s, values, m)))

    def tested(k: Column, s: Column, values: Column, m: Column) -> Column:
        n, size = k["n"], s["size"]
        squares = _total(F.transform(F.array_distinct(s["symbols"]), lambda c: F.pow(n - F.length(F.replace(s["folded"], c, F.lit(""))), F.lit(2.0))))
        chi = (size / n * squares - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        steps = F.sequence(F.lit(0), F.size(values) - 2)
        runs = 1 + _total(F.transform(steps, lambda i: F.when(m["upper"][i] != m["upper"][i + 1], 1.0).otherwise(0.0)))
        pairs = 2 * _total(m["upper"]) * (n - _total(m["upper"]))
        power = _total(F.transform(values, lambda v: (v - m["mean"]) * (v - m["mean"])))
        lagged = _total(F.transform(steps, lambda i: (values[i] - m["mean"]) * (values[i + 1] - m["mean"])))
        return _let(F.struct(chi.alias("chi"), runs.alias("runs"), pairs.alias("pairs"), power.alias("power"), lagged.alias("lagged")), lambda t: judged(k, s, t))

    def judged(k: Column, s: Column, t: Column) -> Column:
        n, size, pairs = k["n"], s["size"], t["pairs"]
        spread = pairs * (pairs - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, (t["runs"] - 1 - pairs / n) / F.sqrt(spread)).otherwise(F.lit(99.0))
        serial = F.when(t["power"] > 0, (t["lagged"] / t["power"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        prose_text = F.when(k["core"].rlike("[a-z]"), k["core"]).otherwise(F.lower(k["core"]))
        prose = reduce(lambda a, b: a + b, [F.lit(math.log(share / len(x))) * F.length(F.regexp_replace(prose_text, f"[^{x.replace('-', '')}{'-' if '-' in x else ''}]", "")) for share, x in PROSE])
        # the range of each statistic, in its own standard deviations
        fewer = (n - F.sqrt(n * n - 2 * pairs)) / 2
        ranges = ((n * (size - 1) - size) / F.sqrt(2 * (size - 1) * (n - 1) / n), (2 * fewer - 1) / F.sqrt(spread), 1.9 * F.sqrt(n))
        tests = reduce(lambda a, b: a + b, [F.log(r) - z * z / 2 - 0.5 * math.log(2 * math.pi) for z, r in zip((t["chi"], runs, serial), ranges, strict=True)])
        evidence = F.when((spread > 0) & (t["power"] > 0), F.greatest(F.lit(float(FLOOR)), -n * F.log(size) - prose - math.log(CHOICES) + F.least(F.lit(0.0), tests))).otherwise(F.lit(float(FLOOR)))
        return F.struct(k["name"].alias("encoding"), n.cast("int").alias("n"), t["chi"].alias("chi"), runs.alias("runs"), serial.alias("serial"), evidence.alias("evidence"))

    core = F.regexp_replace(token, "[=_-]", "")
    none = F.struct(F.lit("none").alias("encoding"), F.length(core).alias("n"), *[F.lit(99.0).alias(x) for x in ("chi", "runs", "serial")], F.lit(float(FLOOR)).alias("evidence"))
    return F.when(F.length(core) >= 16, _let(core, encoded)).otherwise(none)


BASE = ((ASSIGN_WORDS, ASSIGN, 0), (ACCESS, ACCESS, 1), (HEX, HEX, 2))


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with __gl_base (spans of the patterns) and __gl_more (candidates beside them, with their battery). A null text is empty.

    Candidates are looked for where no pattern matched; those that hold others come before them.
    """
    names = list(df.columns)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = df.withColumns({f"__gl_p{kind}": _guarded(text, guard, pattern, kind) for guard, pattern, kind in BASE})
    held = F.coalesce(*[F.col(f"__gl_p{kind}.between")[0] for *_, kind in BASE]).isNotNull()
    found = found.withColumn("__gl_rest", text)
    for guard, pattern, kind in (BASE[0], BASE[2], BASE[1]):
        found = found.withColumn("__gl_rest", F.when(held, _blanked(F.col("__gl_rest"), guard, pattern, kind)).otherwise(F.col("__gl_rest")))
    found = found.withColumn("__gl_whole", _guarded(F.col("__gl_rest"), CANDIDATE, CANDIDATE, 3))
    # parts are looked for in the candidates alone, joined by spaces
    found = found.withColumn("__gl_joined", F.array_join("__gl_whole.found", " "))
    found = found.withColumns({f"__gl_part{k}": F.when(F.col("__gl_joined").isNotNull(), _parted(F.col("__gl_joined"), p, 3)) for k, p in enumerate(PARTS)})
    lengths = {f"__gl_a{kind}": _lengths(F.col(f"__gl_p{kind}")) for *_, kind in BASE} | {"__gl_a3": _lengths(F.col("__gl_whole"))}
    lengths["__gl_aj"] = F.coalesce(F.transform("__gl_whole.found", lambda x: F.length(x) + 1), F.array().cast(INTS))
    spaces_of = lambda p: _upto(F.coalesce(F.size(p["found"]), F.lit(0)), lambda i: _spaces(p["between"][i]), INTS)
    for k in range(len(PARTS)):
        lengths[f"__gl_a{4 + k}"] = _lengths(F.col(f"__gl_part{k}"))
        lengths[f"__gl_s{k}"] = spaces_of(F.col(f"__gl_part{k}"))
    found = _running(found, lengths, lambda a, x: a + x)
    spans = {f"__gl_b{kind}": _spans(F.col(f"__gl_p{kind}"), F.col(f"__gl_a{kind}"), kind) for *_, kind in BASE}
    spans["__gl_c3"] = _spans(F.col("__gl_whole"), F.col("__gl_a3"), 3)
    spans |= {f"__gl_c{4 + k}": _spans(F.col(f"__gl_part{k}"), F.col(f"__gl_a{4 + k}"), 3) for k in range(len(PARTS))}
    found = found.withColumns(spans)
    bare = lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"))
    base = F.concat(F.filter("__gl_b0", lambda s: F.length(s["value"]) >= 6), "__gl_b1", "__gl_b2")
    # sorted by start, then the longer first; equal spans once
    flat = lambda start, value: F.struct(start.alias("start"), (-start - F.length(value)).alias("less"), value.alias("value"))
    parts = [F.transform("__gl_c3", lambda c: flat(c["start"], c["value"]))]

    def moved(k: int) -> Column:
        """Parts at their places in the text: the candidate that holds each is told by the spaces before it."""
        owner = lambda i: F.col(f"__gl_s{k}")[i] + _spaces(F.col(f"__gl_part{k}.between")[i])
        return F.transform(f"__gl_c{4 + k}", lambda c, i: flat(F.col("__gl_c3")[owner(i)]["start"] + c["start"] - F.col("__gl_aj")[owner(i)], c["value"]))

    parts += [moved(k) for k in range(len(PARTS))]
    found = found.withColumns({"__gl_base": F.transform(F.array_sort(base), bare), "__gl_flat": F.array_sort(F.array_distinct(F.concat(*parts)))})
    more = F.transform("__gl_flat", lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("order"), (-c["less"]).alias("end"), battery(c["value"]).alias("test")))
    return found.select(*[F.col(f"`{c}`") for c in names], "__gl_base", F.when(F.size("__gl_flat") > 0, more).otherwise(F.array().cast(MORE)).alias("__gl_more"))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def threshold(found: DataFrame, fdr: float = FDR) -> float:
    """Least evidence that is a discovery, by the e-BH rule over all candidates; infinite if there is none."""
    each = found.select(F.explode("__gl_more").alias("c")).select(F.least(F.floor("c.test.evidence"), F.lit(CEILING)).cast("int").alias("bin"))
    bins = {r.bin: r["count"] for r in each.groupBy("bin").count().collect()}  # from FLOOR to CEILING, so at most 3001 rows
    tests, above, least = sum(bins.values()), 0, math.inf
    for b in sorted(bins, reverse=True):
        above += bins[b]
        if b >= math.log(tests / (fdr * above)):
            least = float(b)
    return least


def with_spans(found: DataFrame, least: float) -> DataFrame:
    """``found`` with __gl_spans: all spans by start, then kind; of candidates within each other the longest that is a discovery."""
    bare = lambda c: F.struct(c["start"].alias("start"), c["order"].alias("order"), c["end"].alias("end"))
    own = F.transform(F.filter("__gl_more", lambda c: c["test"]["evidence"] >= F.lit(least)), bare)
    found = found.withColumn("__gl_own", F.when(F.size("__gl_more") > 0, own).otherwise(F.array().cast(BARE)))
    found = _running(found, {"__gl_done": F.transform("__gl_own", lambda c: c["end"])}, F.greatest)
    # what lies within another ends no later than one before it
    outer = _let(F.col("__gl_done"), lambda done: F.filter("__gl_own", lambda c, i: c["end"] > done[i]))
    return found.withColumn("__gl_spans", F.array_sort(F.concat("__gl_base", outer))).drop("__gl_own", "__gl_done")


def count_of(spans: str, kind: int) -> Column:
    """How many spans are of the kind."""
    return F.size(F.filter(spans, lambda s: s["order"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["order"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``df`` with the text of every span replaced by ``mark``; rows, columns and order of columns stay.

    Overlapping spans become one mark. Null and empty texts, and texts without a span, stay as they are; repeated
    rows are treated alike; an empty table gives no rows. Texts are scanned once: the scanned rows are written, as
    the limit of evidence is only known when all are.
    """
    found = store.written(scan(df, text_col), "scanned")
    found = with_spans(found, threshold(found, fdr))
    found = _running(found, {"__gl_done": F.transform("__gl_spans", lambda s: s["end"])}, F.greatest)
    text = F.col(f"`{text_col}`")
    found = found.withColumn("__gl_chars", F.when(F.size("__gl_spans") > 0, F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))))
    piece = lambda a, b: F.when(b > a, F.array_join(F.transform(F.sequence(a, b - 1), lambda k: F.col("__gl_chars")[k]), "")).otherwise("")
    pieces = F.transform("__gl_spans", lambda s, i: F.when(s["start"] >= F.col("__gl_done")[i], F.concat(piece(F.col("__gl_done")[i], s["start"]), F.lit(mark))).otherwise(""))
    last = F.array_max(F.transform("__gl_spans", lambda s: s["end"]))
    clean = F.concat(F.array_join(pieces, ""), piece(last, F.size("__gl_chars")))
    return found.withColumn(text_col, F.when(F.size("__gl_spans") > 0, clean).otherwise(text)).select(*[F.col(f"`{c}`") for c in df.columns])


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """id, the base spans and all spans (array<struct<start,order,end>>) and the candidates with their tests, for every row.

    Null and empty texts have no spans; repeated rows are kept; an empty table gives no rows; other columns,
    whatever their names, aren't returned.
    """
    own = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = store.written(scan(own).select("id", "__gl_base", "__gl_more"), "secret-spans")
    found = with_spans(found, threshold(found, fdr))
    return found.select("id", F.col("__gl_base").alias("base"), F.col("__gl_spans").alias("spans"), F.col("__gl_more").alias("candidates"))
