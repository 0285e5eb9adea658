"""Quality rules: counts over whole texts, fixed limits, and isolation forests over the rules' statistics.

A forest grows random splits on a bounded sample of labelled rows; documents that few splits set apart from
the rest are anomalous. How short a mean path must be for a document to go is calibrated on the labels. There is
one forest for what the words are made of and one for repetition and length, and a document goes if either says
so: in a single forest over all statistics, splits on those that vary among good documents, such as the length, hid
most of the junk that the others tell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import kernel

#: Labelled rows that the forest and its threshold are fitted on, at most; those of the least hashed ids.
MAX_LABELLED = 20_000
#: Small samples, as in large ones the many documents of one kind of junk would hide each other.
TREES, SAMPLE = 256, 64
#: A labelled good document that goes weighs as much as so many bad ones that stay.
GOOD_WEIGHT = 25
SYMBOLS = b"#*$%&|<>"
#: Columns of ``statistics`` of each forest: word length, symbols, capitals, marks; repeated lines and words, length.
GROUPS = ((0, 1, 2, 3), (4, 5, 6))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _again(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether an earlier one of its group has its value, and whether any other has."""
    order = np.lexsort((np.arange(len(value)), value, group))
    g, v = group[order], value[order]
    same = np.zeros(len(v), bool)
    same[1:] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    earlier, shared = np.zeros(len(v), bool), np.zeros(len(v), bool)
    earlier[order] = same
    either = same.copy()
    either[:-1] |= same[1:]
    shared[order] = either
    return earlier, shared


def rule_counts(column: pa.Array) -> np.ndarray:
    """One row of ``COUNTS`` a text. A null text is empty."""
    data, offsets = kernel.texts_of(column)
    out = []
    for lo, hi in kernel.slices(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        n = hi - lo
        solid = ~kernel.SPACE[part]
        starts, ends, owner = kernel.words_of(part, at)
        hashes = kernel.SpanHashes(part)
        grams, place = kernel.windows(hashes.of(starts, ends), owner, 3)
        _, shared = _again(owner[place], grams)
        covered = np.zeros(len(owner) + 2, bool)
        for k in range(3):
            covered[place[shared] + k] = True
        line_start, line_end, line_text = kernel.lines_of(part, at)
        solid_sum = np.concatenate(([0], np.cumsum(solid, dtype=np.int64)))
        full = solid_sum[line_end] > solid_sum[line_start]
        line_start, line_end, line_text = line_start[full], line_end[full], line_text[full]
        earlier, _ = _again(line_text, hashes.of(line_start, line_end))
        letter = ((part | 32) >= 97) & ((part | 32) < 123)
        mark = (part > 32) & (part < 127) & ~letter & ~((part >= 48) & (part < 58))
        out.append(
            np.stack(
                [
                    np.bincount(owner, minlength=n),
                    _per_text(solid & ((part & 0xC0) != 0x80), at),
                    _per_text(np.isin(part, np.frombuffer(SYMBOLS, np.uint8)), at),
                    np.bincount(line_text[earlier], minlength=n),
                    np.bincount(owner[covered[: len(owner)]], minlength=n),
                    _per_text((part >= 65) & (part < 91), at),
                    _per_text(mark, at),
                ],
                axis=1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(COUNTS)), np.int64)


def statistics(counts: np.ndarray) -> np.ndarray:
    """The rules' statistics of each document: shares, and the logarithm of its length."""
    c = dict(zip(COUNTS, counts.T.astype(np.float64), strict=True))
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    shares = [c["word_chars"] / words, c["n_symbols"] / chars, c["n_upper"] / chars, c["n_marks"] / chars, c["n_dup_lines"] / words, c["n_repeat_words"] / words]
    return np.stack([*shares, np.log(words)], axis=1)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def _usual(n: np.ndarray | float) -> np.ndarray:
    """Mean path of an unsuccessful search among n."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Complete binary trees side by side: a node's children are 2k + 1 and 2k + 2; a leaf splits on nothing."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    depth: int
    usual: float
    threshold: float = np.inf

    @classmethod
    def grow(cls, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        depth = max(1, int(np.ceil(np.log2(max(2, min(sample, len(rows)))))))
        nodes = 2 ** (depth + 1) - 1
        feature, cut, path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            own = rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)]
            todo = [(0, 0, own)]
            while todo:
                node, level, part = todo.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                free = np.flatnonzero(high > low)
                if level == depth or len(part) < 2 or not len(free):
                    path[t, node] = level + _usual(len(part))
                    continue
                f = int(rng.choice(free))
                at = float(rng.uniform(low[f], high[f]))
                feature[t, node], cut[t, node] = f, at
                left = part[:, f] <= at
                todo += [(2 * node + 1, level + 1, part[left]), (2 * node + 2, level + 1, part[~left])]
        return cls(feature, cut, path, depth, float(_usual(min(sample, len(rows)))))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly of each row: near 1 for paths much shorter than usual, near 0.5 for usual ones."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, path in zip(self.feature, self.cut, self.path, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + 1 + (rows[every, np.maximum(f, 0)] > cut[node]), node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(self.usual, 1e-9))

    def calibrate(self, rows: np.ndarray, good: np.ndarray) -> None:
        """Sets the threshold whose errors on labelled rows weigh least; ties go to the higher one."""
        scores = self.scores(rows)
        order = np.argsort(-scores, kind="stable")
        gain = np.cumsum(np.where(good[order], -GOOD_WEIGHT, 1))
        last = np.append(scores[order][1:] < scores[order][:-1], True)  # rows of one score go together
        gain = np.where(last, gain, -np.inf)
        best = int(np.argmax(gain)) if len(gain) and gain.max() > 0 else -1
        if best >= 0:
            after = scores[order][best + 1] if best + 1 < len(scores) else scores[order][best] - 1e-9
            self.threshold = float((scores[order][best] + after) / 2)


LABELLED_DDL = "doc_id long, good boolean, " + ", ".join(f"{c} long" for c in COUNTS)
RESULT_DDL = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, anomaly double, repetition_anomaly double"


def _count_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = rule_counts(batch.column(2))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(counts[:, k]) for k in range(len(COUNTS)))], names=["doc_id", "good", *COUNTS])


def fit(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[Forest] | None:
    """A forest with its threshold for each of ``GROUPS``, from at most ``most`` labelled documents; None if there are none.

    Labels without an id or a quality are left out; a document with several labels is good if all say so, and one
    with several texts counts with that of the least counts, so there are never more rows than labels.
    """
    own = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own), "doc_id").select("doc_id", "good", "text")
    each = texts.mapInArrow(_count_labelled, LABELLED_DDL).groupBy("doc_id").agg(F.min(F.struct("good", *COUNTS)).alias("x")).select("x.*")
    found = np.array([tuple(r) for r in each.collect()], np.int64).reshape(-1, 1 + len(COUNTS))  # a row a label, at most ``most``
    found = found[np.lexsort(found.T[::-1])]  # the same forest however the rows arrive
    found = found[~base_failed(found[:, 1:])]
    if len(found) < 2:
        return None
    rows = statistics(found[:, 1:])
    forests = [Forest.grow(rows[:, list(columns)]) for columns in GROUPS]
    for forest, columns in zip(forests, GROUPS, strict=True):
        forest.calibrate(rows[:, list(columns)], found[:, 0] > 0)
    return forests


def _judge(forests: list[Forest] | None):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = rule_counts(batch.column(1))
            failed, rows = base_failed(counts), statistics(counts)
            scores = [f.scores(rows[:, list(columns)]) for f, columns in zip(forests, GROUPS, strict=True)] if forests and len(counts) else [np.zeros(len(counts))] * len(GROUPS)
            kept = ~failed
            for f, own in zip(forests or [], scores, strict=False):
                kept &= own < f.threshold
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(kept), *map(pa.array, scores)], names=["id", *COUNTS[:5], "base_failed", "kept", "anomaly", "repetition_anomaly"])

    return judge


def judged(df: DataFrame, forests: list[Forest] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rules' counts, the verdict and both forests' anomalies for each row.

    A null text counts as empty and fails the base rule, as does any with under 50 words. Repeated rows are
    kept; an empty table gives no rows; other columns aren't returned. Without forests the base rule decides.
    """
    return df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(_judge(forests), RESULT_DDL)
