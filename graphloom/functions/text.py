"""Text functions of search: terms, match classes, abbreviations, edit scores, highlights, symbols, slugs, paths.

All are Catalyst expressions. Normalisation is NFKC and lower case; ``normalized`` sends only texts that are not
plain ASCII through an Arrow function, as Spark has no NFKC, and plain ones stay in the JVM.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that part terms, beside white space.
SEPARATORS = r"/\\.\-_:;,()\[\]{}\"'"
SEPARATOR_CLASS = rf"[\s{SEPARATORS}]"
BOUNDARY = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{N})(?=[^\p{N} ])|(?<=[^\p{N} ])(?=\p{N})"

#: Rank of match kinds, boost of match fields in ranking.
KIND_RANK = {"exact": 0, "prefix": 1, "token": 2, "substring": 3, "abbreviation": 4, "fuzzy": 5, "none": 6}
FIELD_BOOST = {"name": 4, "path": 3, "kind": 2, "content": 1}


def _nfkc(text: pa.Array) -> pa.Array:
    # Arrow's own normalisation doesn't compose characters again
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """NFKC form; ASCII texts are returned as they are, without leaving the JVM."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(F.arrow_udf(_nfkc, StringType())(text))


def normalized(text: Column, ascii_only: bool = False) -> Column:
    """What texts are compared by: NFKC, then lower case."""
    return F.lower(text if ascii_only else nfkc(text))


def to_terms(text: Column, ascii_only: bool = False) -> Column:
    """Lower-case terms joined by one space: cut at separators, before a capital that begins a word, and at digits."""
    base = text if ascii_only else nfkc(text)
    spaced = F.regexp_replace(F.regexp_replace(base, SEPARATOR_CLASS, " "), BOUNDARY, " ")
    return F.lower(F.trim(F.regexp_replace(spaced, " +", " ")))


def initials(terms: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(terms, " "), lambda t: t != ""), lambda t: F.substring(t, 1, 1)), "")


def is_abbreviation(query: Column, terms: Column) -> Column:
    """Whether the terms' initials hold the query without its spaces."""
    bare = F.replace(query, F.lit(" "), F.lit(""))
    return (bare != "") & F.contains(initials(terms), bare)


def match_rank(query: Column, field: Column, abbreviations: bool = True) -> Column:
    """Rank of the match: 0 exact, 1 prefix, 2 token, 3 substring, 4 abbreviation, else null; an empty query matches nothing."""
    q = F.trim(query)
    rank = (
        F.when(q == "", None)
        .when(q == field, KIND_RANK["exact"])
        .when(F.startswith(field, q), KIND_RANK["prefix"])
        .when(F.array_contains(F.split(field, r"\s+"), q), KIND_RANK["token"])
        .when(F.contains(field, q), KIND_RANK["substring"])
    )
    return rank.when(is_abbreviation(q, field), KIND_RANK["abbreviation"]) if abbreviations else rank


def kind_name(rank: Column) -> Column:
    return F.when(rank.isNotNull(), F.element_at(F.array(*map(F.lit, KIND_RANK)), rank + 1))


def match_kind(query: Column, field: Column, abbreviations: bool = True) -> Column:
    """exact, prefix, token, substring, abbreviation or null."""
    return kind_name(match_rank(query, field, abbreviations))


def terms_of(word: str) -> str:
    """``to_terms`` of a query word, on the driver."""
    out, last, gap = [], "", False
    chars = unicodedata.normalize("NFKC", word)
    for i, c in enumerate(chars):
        if c.isspace() or c in "/\\.-_:;,()[]{}\"'":
            last, gap = "", bool(out)
            continue
        after = chars[i + 1 : i + 2]
        if last and (c.isupper() and (last.islower() or (last.isupper() and after.islower())) or c.isnumeric() != last.isnumeric()):
            gap = bool(out)
        if gap:
            out.append(" ")
            gap = False
        out.append(c.lower())
        last = c
    return "".join(out)


def fuzzy_distance(length: Column) -> Column:
    """Edits allowed for a query of so many characters: none under 3 or over 64, 1 up to 7, else 2."""
    return F.when((length < 3) | (length > 64), None).when(length <= 7, 1).otherwise(2)


def edit_score(query: Column, token: Column) -> Column:
    """10000 less 1000 an edit and 1 a character of difference in length; null beyond the allowed edits."""
    edits = F.levenshtein(query, token, 2)  # -1 beyond two
    return F.when((edits >= 0) & (edits <= fuzzy_distance(F.length(query))), 10000 - 1000 * edits - F.abs(F.length(token) - F.length(query)))


def fuzzy_score(query: Column, terms: Column) -> Column:
    """Best edit score over a field's terms."""
    return F.array_max(F.transform(F.split(terms, " "), lambda t: edit_score(query, t)))


def highlights(text: Column, tokens: Column) -> Column:
    """array<struct<start,end>>: bytes of the first occurrence of each token, none overlapping, by start.

    Exact for texts whose lower-case form has the same bytes a character (ASCII and most of Latin).
    """
    low = F.lower(text)
    span = "array<struct<start:int,end:int>>"

    def step(acc: Column, token: Column) -> Column:
        at = F.instr(low, token)
        start = F.octet_length(F.left(text, at - 1))
        one = F.struct(start.cast("int").alias("start"), (start + F.octet_length(token)).cast("int").alias("end"))
        clash = F.exists(acc, lambda r: (one["end"] > r["start"]) & (one["start"] < r["end"]))
        return F.when((token == "") | (at == 0) | clash, acc).otherwise(F.concat(acc, F.array(one)).cast(span))

    return F.array_sort(F.aggregate(tokens, F.array().cast(span), step))


#: Bytes of a field and of a query's tokens beyond which nothing is highlighted.
HIGHLIGHT_FIELD, HIGHLIGHT_QUERY = 32 * 1024, 4 * 1024


def normalized_ranges(source: str, tokens: list[str]) -> list[tuple[int, int]]:
    """Byte ranges in ``source`` of the first occurrence of each normalised token, none overlapping, by start.

    A character is normalised together with the marks that follow it; a token that begins or ends within what one
    of these became takes all of it.
    """
    if len(source.encode()) > HIGHLIGHT_FIELD or sum(len(t.encode()) for t in tokens) > HIGHLIGHT_QUERY:
        return []
    clusters: list[str] = []
    for c in source:
        if clusters and unicodedata.combining(c):
            clusters[-1] += c
        else:
            clusters.append(c)
    text, places, at = "", [], 0
    for c in clusters:
        made, n = unicodedata.normalize("NFKC", c).lower(), len(c.encode())
        places += [(at, at + n)] * len(made)
        text, at = text + made, at + n
    out: list[tuple[int, int]] = []
    for t in tokens:
        first = text.find(t) if t else -1
        if first >= 0:
            own = places[first][0], places[first + len(t) - 1][1]
            if not any(own[1] > a and own[0] < b for a, b in out):
                out.append(own)
    return sorted(out)


def highlight_ranges(text: Column, tokens: list[str]) -> Column:
    """array<struct<start,end>> of ``normalized_ranges`` for the tokens of a query, for texts in any script."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def find(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [{"start": a, "end": b} for a, b in normalized_ranges(x, tokens)] for x in column.to_pylist()], kind)

    return F.arrow_udf(find, "array<struct<start:int,end:int>>")(text)


def script_symbols(line: Column) -> tuple[Column, Column]:
    """Last namespace and last type declared on a line of code, without what follows ``//``."""
    code = F.substring_index(line, "//", 1)
    names = F.regexp_extract_all(code, F.lit(r"(?<![A-Za-z0-9_.])namespace[^A-Za-z0-9_.]+([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)(?![A-Za-z0-9_.])"), F.lit(1))
    types = F.regexp_extract_all(code, F.lit(r"(?<![A-Za-z0-9_.])(?:class|struct|interface|enum|record)[^A-Za-z0-9_.]+([A-Za-z_][A-Za-z0-9_]*)(?![A-Za-z0-9_.])"), F.lit(1))
    last = lambda xs: F.when(F.size(xs) > 0, F.element_at(xs, -1))
    return last(names), last(types)


def is_identifier(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    name = file_name(path)
    return F.when(F.instr(name, ".") > 1, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


#: File extensions of each search kind; any other is File.
EXTENSION_KINDS = {
    "Prefab": ["prefab"], "Scene": ["unity"], "Material": ["mat"], "Script": ["cs"], "AnimationClip": ["anim"], "AnimatorController": ["controller"],
    "Asset": ["asset"], "Shader": ["shader"], "Texture": ["png", "jpg", "jpeg", "tga", "psd"], "Audio": ["wav", "mp3", "ogg"],
}
#: Search kinds in suggestion order, with their filter aliases.
KIND_ALIASES = {
    "Prefab": ["prefab"], "Scene": ["scene"], "Material": ["material", "mat"], "Script": ["script", "cs"], "AnimationClip": ["animation", "animationclip", "anim"],
    "AnimatorController": ["animator", "animatorcontroller", "controller"], "Asset": ["asset"], "Shader": ["shader"], "Texture": ["texture", "tex"], "Audio": ["audio"],
    "BundleContainer": ["bundlecontainer", "container", "bundle-container"], "File": ["file"],
}


def kind_of_path(path: Column) -> Column:
    ext = extension(path)
    out = F.lit("File")
    for kind, names in EXTENSION_KINDS.items():
        out = F.when(ext.isin(names), kind).otherwise(out)
    return out


def slug(text: Column, most: int) -> Column:
    """Lower-case letters and digits, other runs as one dash, cut to ``most``; unnamed if nothing is left."""
    dashed = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-")
    cut = F.regexp_replace(F.left(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(most)), "-+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", "unnamed").otherwise(cut)


def external_path(path: Column) -> Column:
    """A reference's path as it is looked up: without ./ and archive:/, outer slashes, with / and in lower case."""
    bare = F.regexp_replace(path, r"^(?:\.[/\\])*(?i:archive:[/\\])?(?:\.[/\\])*[/\\]*", "")
    bare = F.regexp_replace(bare, r"[/\\]+$", "")
    return F.translate(bare, "\\ABCDEFGHIJKLMNOPQRSTUVWXYZ", "/abcdefghijklmnopqrstuvwxyz")


def guid(value: Column) -> Column:
    """Exactly 32 hex digits, whatever stands between them, in lower case; else null."""
    digits = F.regexp_replace(value, "[^0-9A-Fa-f]", "")
    return F.when(F.length(digits) == 32, F.lower(digits))


def container_pattern(pattern: str) -> str | None:
    """Anchored regex of a pattern with * or ?, which cross slashes and ignore ASCII case; None without a wildcard."""
    if not set("*?") & set(pattern):
        return None
    return "(?is)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def container_match(path: Column, pattern: str) -> Column:
    """Whole-path wildcard match, or substring without wildcards; ASCII case is ignored."""
    regex = container_pattern(pattern)
    if regex:
        return path.rlike(regex)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.contains(F.translate(path, upper, lower), F.lit(pattern.translate(str.maketrans(upper, lower))))


def match_work(path: Column, pattern: str) -> Column:
    """Steps that matching may take: windows times pattern, or the table of a wildcard match."""
    n = len(pattern.encode())
    if set("*?") & set(pattern):
        return (F.lit(n + 1) * (F.octet_length(path) + 1)).cast("long")
    return (F.greatest(F.octet_length(path) - n + 1, F.lit(0)) * max(n, 1)).cast("long")


def scalar_kind(value: Column) -> Column:
    """Kind of a plain YAML scalar; the order of the tests matters, and zero-prefixed numbers stay strings."""
    integer = value.rlike(r"^[-+]?[0-9]+$")
    wide = value.cast("decimal(38,0)")
    in_i64 = (wide >= F.lit("-9223372036854775808").cast("decimal(38,0)")) & (wide <= F.lit("9223372036854775807").cast("decimal(38,0)"))
    in_u64 = (wide >= 0) & (wide <= F.lit("18446744073709551615").cast("decimal(38,0)")) & ~value.startswith("-")
    return (
        F.when(value.isin("", "~", "null", "Null", "NULL"), "null")
        .when(value.isin("true", "True", "TRUE", "false", "False", "FALSE"), "bool")
        .when(value.rlike(r"^(?:[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$"), "float")
        .when(value.rlike(r"^[-+]?0[0-9]+$"), "string")
        .when(value.rlike(r"^0x[-+]?[0-9A-Fa-f]+$") | value.rlike(r"^0o[-+]?[0-7]+$"), "integer")
        .when(integer & (F.length(value) <= 37) & in_i64, "integer")
        .when(integer & (F.length(value) <= 37) & in_u64, "unsigned")
        .when(value.rlike(r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$") & value.rlike("[.eE]"), "float")
        .otherwise("string")
    )


def version_key(version: Column) -> Column:
    """struct<major,minor,build,channel,number> of ``2020.3.1f1``, which sorts as versions do; null if it is none."""
    pattern = r"^\s*([0-9]+)\.([0-9]+)\.([0-9]+)([^0-9\s]*)([0-9]*)(?:\s.*)?$"
    part = lambda i: F.regexp_extract(version, pattern, i)
    channel = part(4)
    order = F.when(channel == "a", 0).when(channel == "b", 1).when(channel == "c", 2).when(channel.isin("", "f"), 3).when(channel == "p", 4).when(channel == "x", 5).otherwise(6)
    made = F.struct(part(1).cast("int").alias("major"), part(2).cast("int").alias("minor"), part(3).cast("int").alias("build"), order.alias("channel"), F.when(part(5) == "", 0).otherwise(part(5).try_cast("int")).alias("number"))
    return F.when(version.rlike(pattern), made)


def immediate_path(directory: Column, prefix: str) -> Column:
    """The directory up to the next slash after ``prefix``."""
    n = len(prefix)
    at = F.locate("/", directory, n + 1)
    return F.when(at > 0, F.left(directory, at)).otherwise(directory)
