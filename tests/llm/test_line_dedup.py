import os
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import line_dedup, queries, store


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 7))) for _ in range(n))


def brute(texts, full=8, long=20):
    """Every pair of an earlier and a later text, every run of neighbouring lines that both have in a row."""
    count = lambda line: len(re.findall("[^\x20\x09-\x0d]+", line))
    rows = {i: [(p, x, count(x)) for p, x in enumerate((t or "").split("\n")) if count(x)] for i, t in texts.items()}
    gone = {i: set() for i in texts}
    ids = sorted(texts)
    for n, i in enumerate(ids):
        if any(texts[j] == texts[i] for j in ids[:n]):
            if sum(w for *_, w in rows[i]) >= full:
                gone[i] = {p for p, *_ in rows[i]}
            continue
        for j in ids[:n]:
            a, b = rows[i], rows[j]
            where = {}
            for y, (_, line, _) in enumerate(b):
                where.setdefault(line, []).append(y)
            for x, (_, line, _) in enumerate(a):
                for y in where.get(line, []):
                    if x and y and a[x - 1][1] == b[y - 1][1]:
                        continue
                    k = 0
                    while x + k < len(a) and y + k < len(b) and a[x + k][1] == b[y + k][1]:
                        k += 1
                    own = a[x : x + k]
                    if any(w >= full for *_, w in own) or sum(w for *_, w in own) >= long:
                        gone[i] |= {p for p, *_ in own}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in texts.items()}


def clean(df):
    return {r.doc_id: (r.text, r._n_removed) for r in line_dedup.dedup(df).collect()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_alignments_are_common_subsequences(a, b):
    pairs = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < x and j < y for (i, j), (x, y) in zip(pairs, pairs[1:], strict=False))
    if a == b:
        assert len(pairs) == len(a)


def test_patience_prefers_single_lines():
    assert line_dedup.patience(list("xay"), list("zaw")) == [(1, 1)]


def test_copies_passages_and_clean_texts(table):
    rng = random.Random(2)
    passage = [words(rng, 18), words(rng, 18), words(rng, 18)]
    own = [[words(rng, 12) for _ in range(6)] for _ in range(40)]
    texts = ["\n".join(own[i]) for i in range(10)]
    texts += ["\n".join(own[i][:3] + passage + own[i][3:]) for i in range(10, 40)]  # 30 hold the passage
    texts += [texts[0]] * 25 + ["stock line here\n" + words(rng, 9) for _ in range(30)]
    near = own[1].copy()
    near[2] = words(rng, 12)
    texts.append("\n".join(near))
    got = clean(table(texts))
    assert all(got[i] == (texts[i], 0) for i in range(11))
    assert all(got[i] == ("\n".join(own[i]), 3) for i in range(11, 40))
    assert all(got[i] == ("", 6) for i in range(40, 65))
    assert all(got[i] == (texts[i], 0) for i in range(65, 95))
    assert got[95] == (near[2], 5)


def test_lone_lines_go_however_many_texts_hold_them(table):
    rng = random.Random(3)
    line = words(rng, 12)
    own = [[words(rng, 9), words(rng, 9)] for _ in range(60)]
    for n in (2, 16, 17, 60):
        got = clean(table(["\n".join([a, line, b]) for a, b in own[:n]]))
        assert got[0][1] == 0 and all(got[i] == ("\n".join(own[i]), 1) for i in range(1, n))


def test_order_of_rows_is_no_matter(table):
    rng = random.Random(4)
    own = [words(rng, 15) for _ in range(12)]
    texts = ["\n".join(rng.sample(own, 5)) for _ in range(30)]
    df = table(texts)
    assert clean(df) == clean(df.orderBy(df.doc_id.desc()).repartition(3, "text"))


def test_odd_rows(spark, odd, table):
    rows = line_dedup.dedup(odd.withColumnRenamed("source", "key")).orderBy("doc_id").collect()
    assert [r.text for r in rows] == [r.text for r in odd.orderBy("doc_id").collect()]
    assert rows[0]._n_lines == 0 and rows[3]._n_lines == 2
    long = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(None, long), (None, long), (5, long), (5, long), (5, long + "\nx"), (6, long + "\r"), (7, "\n" + long + "\n\n")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r._n_removed) for r in line_dedup.dedup(df).collect()), key=str)
    assert [x for x in got if x[0] is None] == [(None, long, 0)] * 2
    assert (7, "\n\n", 1) in got and (6, long + "\r", 0) in got
    fives = [x for x in got if x[0] == 5]
    assert sum(x[2] for x in fives) in (1, 2) and len(fives) == 3
    assert line_dedup.dedup(table([])).count() == 0


def test_random_texts_against_every_pair(table):
    rng = random.Random(6)
    pool = [words(rng, n) for n in (1, 2, 3, 3, 4, 5, 6, 7, 7, 7, 8, 12, 21)]
    texts = ["\n".join(rng.choices([*pool, "", words(rng, 9), words(rng, 3)], k=rng.randrange(1, 12))) for _ in range(250)]
    texts += ["\n".join([x, y, z]) for x in pool[3:8] for y in pool[:6] for z in pool[5:12]]
    rng.shuffle(texts)
    got = {i: t for i, (t, _) in clean(table(texts)).items()}
    assert got == brute(dict(enumerate(texts)))


def test_blocks_in_another_order(table):
    rng = random.Random(10)
    x, y, z = (words(rng, 12) for _ in range(3))
    got = clean(table(["\n".join(t) for t in ([x, y], [y, x], [y, x, z])]))
    assert [got[i][0] for i in range(3)] == [f"{x}\n{y}", "", z]
    short = [words(rng, 7) for _ in range(3)]
    got = clean(table(["\n".join(t) for t in (short, short[::-1], [*short[::-1], z])]))
    assert [got[i][1] for i in range(3)] == [0, 0, 3]


def test_one_very_long_text(table):
    rng = random.Random(11)
    lines = [words(rng, 9) for _ in range(16000)]
    got = clean(table(["\n".join(lines), "\n".join(["new"] + lines[::2]), "\n".join(lines[5000:5003])]))
    assert got[0][1] == 0 and got[1] == ("new", 8000) and got[2] == ("", 3)


def test_a_very_common_passage_makes_linear_pairs(table, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(line_dedup, "ALIGNED", 7)
    monkeypatch.setattr(line_dedup.skew, "LEAST", 5)
    monkeypatch.setattr(line_dedup.skew, "SHARE", 10)
    passage = [words(rng, 6) for _ in range(4)]
    texts = ["\n".join([words(rng, 4), *passage, words(rng, 5)]) for _ in range(120)]
    got = {i: t for i, (t, _) in clean(table(texts)).items()}
    assert got == brute(dict(enumerate(texts)))


def test_query(spark, data, docs):
    rows = queries.op3_line_dedup(spark, data).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute(texts)
    assert {r.doc_id: r.text for r in rows} == want
    for r in rows:
        assert r.n_lines == len(texts[r.doc_id].split("\n"))
        assert (r.n_removed == 0) == (r.text == texts[r.doc_id])


def test_only_the_result_stays_on_disk(spark, table):
    rng = random.Random(22)
    passage = [words(rng, 9) for _ in range(3)]
    place = store.shared_dir(spark).removeprefix("file://") + "/graphloom"
    before = set(os.listdir(place)) if os.path.isdir(place) else set()
    found = line_dedup.duplicate_lines(table(["\n".join([words(rng, 4), *passage]) for _ in range(9)]))
    assert len(set(os.listdir(place)) - before) == 1
    assert {r.id: r.gone for r in found.collect()} == {i: [1, 2, 3] for i in range(1, 9)}
