import collections
import re

import numpy as np
import pyarrow as pa

from graphloom.llm import quality, queries


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, covered, seen, repeated = collections.Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), repeated, len(covered)


TRICKY = [None, "", " \n ", "a a a a a", "é\né\n\né", "x y z x y z\n\n", "\n", "|#", "漢 字", "a\x0bb\x0cc\rd\te", "a b c\n a b c\na b c", "w " * 4000, "a b c a b c a b"]


def test_counts():
    assert [tuple(r[:5]) for r in quality.rule_counts(pa.array(TRICKY, pa.string())).tolist()] == [brute(t) for t in TRICKY]
    sliced = pa.array(["zzz", *TRICKY], pa.string()).slice(1)
    assert np.array_equal(quality.rule_counts(sliced), quality.rule_counts(pa.array(TRICKY, pa.string())))


def test_query(spark, data, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op8_quality_rules(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def path_length(forest, tree, row):
    """Splits that set a row apart in one tree, counted one by one."""
    node = 0
    while forest.feature[tree][node] >= 0:
        node = 2 * node + (2 if row[forest.feature[tree][node]] > forest.cut[tree][node] else 1)
    return forest.path[tree][node]


def test_verdicts_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forests = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.judged(docs, forests).collect():
        t = texts[r.id]
        n, chars, symbols, dup, repeated = brute(t)
        upper = len(re.findall("[A-Z]", t))
        marks = len(re.findall(r"[!-/:-@\[-`{-~]", t))
        row = [chars / max(n, 1), *(x / max(chars, 1) for x in (symbols, upper, marks)), dup / max(n, 1), repeated / max(n, 1), np.log(max(n, 1))]
        usual = 2 * (np.log(quality.SAMPLE - 1) + 0.5772156649015329) - 2 * (quality.SAMPLE - 1) / quality.SAMPLE
        fine = not r.base_failed
        for forest, columns, got in zip(forests, quality.GROUPS, (r.anomaly, r.repetition_anomaly), strict=True):
            own = [row[k] for k in columns]
            mean = np.mean([path_length(forest, k, own) for k in range(len(forest.feature))])
            assert abs(got - 2 ** (-mean / usual)) < 1e-9
            fine &= got < forest.threshold
        assert r.kept == fine


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    held = labels.filter("doc_id % 2 = 1")
    rows = quality.judged(docs.join(held, "doc_id", "left_semi"), forest).join(held.withColumnRenamed("doc_id", "id"), "id").filter("not base_failed").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(not r.kept for r in good) <= 0.01 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_odd_tables(spark, odd, table):
    labels = spark.createDataFrame([(0, 1), (None, 0), (3, None), (8, 0), (8, 1)], "doc_id long, quality int")
    forest = quality.fit(odd, labels)
    assert forest is None
    rows = quality.judged(odd.withColumnRenamed("n_chars", "kept"), forest).collect()
    assert len(rows) == odd.count() and not any(r.kept for r in rows)
    assert quality.judged(table([]), forest).count() == 0
    again = quality.judged(odd.unionByName(odd), forest)
    assert again.count() == 2 * odd.count() == 2 * again.distinct().groupBy("id").count().count()
    assert again.columns == ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly", "repetition_anomaly"]
