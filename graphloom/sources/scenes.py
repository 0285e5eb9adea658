"""Scene files: streams of tagged YAML documents, one object each, and their references.

Files are read by Spark's binary reader, so they may lie in any store, and parsed in Arrow batches. The parser
covers the subset that such files use: block and flow collections, plain and quoted scalars, continued lines.
A document that breaks a rule becomes an error row; the others of its file are still read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

HEADER = re.compile(r"^--- !u!(\d+) &(-?\d+)[ \t]*(.*)$")
KEY = re.compile(r"""^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|(?:[^\s#&*!|>'"%@`{}\[\],?:-]|[-?:](?=\S))(?:[^:#]|:(?=\S)|(?<=\S)#)*?)[ \t]*:(?:[ \t]+|$)""")
OBJECT_DDL = "source string, document_index int, class_id int, class_name string, file_id long, anchor string, stripped boolean, name string, props string, error string"
REFERENCE_DDL = "source string, owner long, field_path string, file_id long, guid string, type_id long, state string"


class SceneError(ValueError):
    pass


def scalar(text: str):
    """The value of a plain scalar; zero-prefixed numbers stay strings."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE"):
        return True
    if text in ("false", "False", "FALSE"):
        return False
    if re.fullmatch(r"[-+]?\.(inf|Inf|INF)", text):
        return float("-inf") if text[0] == "-" else float("inf")
    if text in (".nan", ".NaN", ".NAN"):
        return float("nan")
    if re.fullmatch(r"[-+]?0[0-9]+", text):
        return text
    for prefix, base, digits in (("0x", 16, "[0-9A-Fa-f]"), ("0o", 8, "[0-7]")):
        if text.startswith(prefix):
            n = int(text[2:], base) if re.fullmatch(rf"[-+]?{digits}+", text[2:]) else None
            return n if n is not None and -(2**63) <= n < 2**64 else text
    if re.fullmatch(r"[-+]?[0-9]+", text):
        n = int(text)
        if -(2**63) <= n < 2**64:
            return n
        return text
    if re.search("[.eE]", text) and re.fullmatch(r"[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?", text):
        return float(text)
    return text


ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "/": "/", "0": "\0", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v", " ": " ", "N": "\x85", "_": "\xa0"}


def unquote(text: str) -> str:
    if text[0] == "'":
        return text[1:-1].replace("''", "'")

    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "xuU":
            return chr(int(c[1:], 16))
        if c in ESCAPES:
            return ESCAPES[c]
        raise SceneError(f"unknown escape {c}")

    out = re.sub(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text[1:-1], flags=re.S)
    return out.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")  # two escapes may spell one character


class _Flow:
    """A flow value in one string."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def value(self):
        self.space()
        c = self.text[self.at : self.at + 1]
        if c == "{":
            return self.items("}", {})
        if c == "[":
            return self.items("]", [])
        if c and c in "'\"":
            return unquote(self.quoted())
        if c and c in "&*!":
            raise SceneError("anchors, aliases and tags belong to document roots")
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in ",{}[]" and not (self.text[self.at] == ":" and self.text[self.at + 1 : self.at + 2] in ("", " ", ",", "}", "]")):
            self.at += 1
        return scalar(self.text[start : self.at].strip())

    def quoted(self) -> str:
        m = re.compile(r"""'(?:[^']|'')*'|"(?:[^"\\]|\\.)*\"""", re.S).match(self.text, self.at)
        if not m:
            raise SceneError("a quote isn't closed")
        self.at = m.end()
        return m[0]

    def items(self, close: str, out):
        self.at += 1
        while True:
            self.space()
            if self.at >= len(self.text):
                raise SceneError("a flow collection isn't closed")
            if self.text[self.at] == close:
                self.at += 1
                return out
            one = self.value()
            self.space()
            if isinstance(out, dict):
                if isinstance(one, (dict, list)):
                    raise SceneError("a key is a collection")
                key = one if isinstance(one, str) else self._spelled(one)
                value = None
                if self.text[self.at : self.at + 1] == ":":
                    self.at += 1
                    value = self.value()
                if key in out:
                    raise SceneError(f"key {key} occurs twice")
                out[key] = value
            else:
                out.append(one)
            self.space()
            if self.text[self.at : self.at + 1] == ",":
                self.at += 1
            elif self.text[self.at : self.at + 1] != close:
                raise SceneError("a flow collection lacks a comma")

    @staticmethod
    def _spelled(x) -> str:
        return "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


def _open(text: str) -> bool:
    """Whether quotes or brackets are still open at the end."""
    depth, quote, i = 0, "", 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\" and quote == '"':
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"" and (i == 0 or text[i - 1] in " ,:[{"):
            quote = c
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
        i += 1
    return bool(quote) or depth > 0


class _Block:
    def __init__(self, lines: list[str]):
        self.lines = [x for x in lines if x.strip() and not x.lstrip().startswith("#")]
        self.at = 0

    def indent(self) -> int:
        if self.at >= len(self.lines):
            return -1
        line = self.lines[self.at]
        if "\t" in line[: len(line) - len(line.lstrip())]:
            raise SceneError("a tab indents a line")
        return len(line) - len(line.lstrip(" "))

    def node(self, least: int):
        n = self.indent()
        if n < least:
            return None
        if self.lines[self.at][n:] == "-" or self.lines[self.at][n : n + 2] == "- ":
            return self.sequence(n)
        if KEY.match(self.lines[self.at][n:]):
            return self.mapping(n)
        return self.inline(self.lines[self.at][n:], n)

    def inline(self, text: str, n: int):
        """A value that begins on the line at hand and may go on below, deeper than ``n``."""
        self.at += 1
        text = text.strip()
        if text[:1] in ("|", ">"):
            own = []
            while self.indent() > n:
                own.append(self.lines[self.at].strip())
                self.at += 1
            return ("\n" if text[0] == "|" else " ").join(own) + ("" if "-" in text else "\n")
        if text[:1] in "&*!":
            raise SceneError("anchors, aliases and tags belong to document roots")
        while self.at < len(self.lines) and (_open(text) if text[:1] in "'\"{[" else self.indent() > n):
            text += " " + self.lines[self.at].strip()
            self.at += 1
        if text[:1] in "{[":
            flow = _Flow(text)
            out = flow.value()
            if text[flow.at :].strip() and not text[flow.at :].lstrip().startswith("#"):
                raise SceneError("text follows a flow collection")
            return out
        if text[:1] in "'\"":
            flow = _Flow(text)
            return unquote(flow.quoted())
        return scalar(re.split(r"\s#", text)[0].strip())

    def mapping(self, n: int) -> dict:
        out: dict = {}
        while self.indent() == n and (m := KEY.match(self.lines[self.at][n:])):
            quoted = m[1][0] in "'\""
            key = unquote(m[1]) if quoted else m[1]
            if not quoted and (key == "<<" or key[0] in "&*!?"):
                raise SceneError("merges, anchors and complex keys aren't allowed")
            if key in out:
                raise SceneError(f"key {key} occurs twice")
            rest = self.lines[self.at][n + m.end() :]
            if rest.strip():
                out[key] = self.inline(rest, n)
            else:
                self.at += 1
                deeper = self.indent()
                dashed = deeper == n and self.lines[self.at][n : n + 2] in ("- ", "-")
                out[key] = self.sequence(n) if dashed else self.node(n + 1)
        if self.indent() > n:
            raise SceneError("a line is indented too far")
        return out

    def sequence(self, n: int) -> list:
        out = []
        while self.indent() == n and (self.lines[self.at][n:] == "-" or self.lines[self.at][n : n + 2] == "- "):
            rest = self.lines[self.at][n + 1 :]
            if not rest.strip():
                self.at += 1
                out.append(self.node(n + 1))
                continue
            inner = n + 1 + len(rest) - len(rest.lstrip())
            if KEY.match(rest.lstrip()) and rest.lstrip()[0] not in "{[" or rest.lstrip()[:2] == "- ":
                self.lines[self.at] = " " * inner + rest.lstrip()
                out.append(self.node(inner))
            else:
                out.append(self.inline(rest.lstrip(), n))
        return out


def value_of(lines: list[str]):
    block = _Block(lines)
    out = block.node(0)
    if block.at < len(block.lines):
        raise SceneError(f"a line isn't understood: {block.lines[block.at].strip()[:40]}")
    return out


def documents(text: str) -> Iterator[dict]:
    """The objects of a file in order; a file without headers is one untagged document."""
    parts: list[tuple[re.Match | None, list[str]]] = []
    for line in text.lstrip("﻿").replace("\r\n", "\n").split("\n"):
        if line.startswith("%") and not parts:
            continue
        if line.startswith("---"):
            m = HEADER.match(line)
            parts.append((m, []))
            if not m and line.strip() != "---":
                parts[-1] = (None, [f"\t{line}"])
            continue
        if not parts:
            if not line.strip():
                continue
            parts.append((None, []))
        if line.strip() != "...":
            parts[-1][1].append(line)
    for k, (m, lines) in enumerate(parts):
        out = {"document_index": k, "class_id": int(m[1]) if m else None, "file_id": int(m[2]) if m else None, "anchor": m[3].strip() if m else "", "class_name": None, "props": None, "error": None}
        try:
            value = value_of(lines)
            if m:
                if not isinstance(value, dict) or len(value) != 1:
                    raise SceneError("a document must hold one class")
                (out["class_name"], out["props"]) = next(iter(value.items()))
                if not isinstance(out["props"], dict):
                    raise SceneError("a class must be a mapping")
                if out["file_id"] == 0:
                    raise SceneError("a file id is 0")
            else:
                out["props"] = value
        except (SceneError, RecursionError) as e:
            out["props"], out["error"] = None, str(e)
        yield out


def references(value, path: str = "") -> Iterator[tuple[str, int | None, str | None, int | None, str]]:
    """(field path, file id, GUID, type, state) of every reference in a value: Valid, Null or Malformed.

    A mapping with a fileID is a reference; keys beside fileID, guid and type, and values of other kinds, make it malformed.
    """
    if isinstance(value, dict):
        if "fileID" in value:
            f, g, t = value.get("fileID"), value.get("guid"), value.get("type")
            whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and -(2**63) <= x < 2**63
            text = g if isinstance(g, str) else str(g) if isinstance(g, int) and not isinstance(g, bool) else None
            fine = set(value) <= {"fileID", "guid", "type"} and whole(f) and ("guid" not in value or text is not None) and ("type" not in value or whole(t))
            yield path, f if whole(f) else None, text, t if whole(t) else None, "Malformed" if not fine else "Null" if f == 0 else "Valid"
            return
        for k, v in value.items():
            yield from references(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from references(v, f"{path}[{i}]")


def _json(value) -> str:
    def plain(x):
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return str(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), ensure_ascii=False)


def _rows(batches: Iterator[pa.RecordBatch], each) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield each(path, content.as_py() or b"")


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each(path: str, data: bytes) -> pa.RecordBatch:
        out = []
        for d in documents(data.decode(errors="replace")):
            props = d["props"]
            name = (props.get("m_Name") if isinstance(props.get("m_Name"), str) else props.get("name")) if isinstance(props, dict) else None
            out.append((path, d["document_index"], d["class_id"], d["class_name"], d["file_id"], d["anchor"], "stripped" in d["anchor"].split(), name if isinstance(name, str) else None, None if d["error"] else _json(props), d["error"]))
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in OBJECT_DDL.split(", ")])

    yield from _rows(batches, each)


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each(path: str, data: bytes) -> pa.RecordBatch:
        out = [(path, d["file_id"], *r) for d in documents(data.decode(errors="replace")) if not d["error"] for r in references(d["props"])]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in REFERENCE_DDL.split(", ")])

    yield from _rows(batches, each)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of the files under a folder, whatever store it is in."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def scan_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row an object; props is JSON, to be read with parse_json."""
    return files(spark, path, pattern).mapInArrow(_objects, OBJECT_DDL)


def scan_references(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row a reference, with the field path where it stands."""
    return files(spark, path, pattern).mapInArrow(_references, REFERENCE_DDL)


def serialize(value, indent: int = 0) -> str:
    """Block YAML of a value, which ``value_of`` reads back."""
    pad = "  " * indent

    def inline(x) -> str:
        if x is None:
            return "~"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, float):
            return ".nan" if x != x else ".inf" if x == float("inf") else "-.inf" if x == float("-inf") else repr(x)
        if isinstance(x, int):
            return str(x)
        if isinstance(x, dict):
            return "{}"
        if isinstance(x, list):
            return "[]"
        return json.dumps(x, ensure_ascii=True)

    out = ""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            key = k if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", k) else json.dumps(k)
            out += f"{pad}{key}:\n{serialize(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f"{pad}{key}: {inline(v)}\n"
    elif isinstance(value, list) and value:
        for v in value:
            out += f"{pad}-\n{serialize(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f"{pad}- {inline(v)}\n"
    else:
        out = f"{pad}{inline(value)}\n"
    return out
