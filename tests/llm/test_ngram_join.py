import os
import random
import re
from itertools import combinations

import numpy as np
import pytest

from graphloom.llm import ngram_join, queries, store
from graphloom.llm.components import components


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for a, b in {p for own in by.values() for p in combinations(sorted(own), 2)}:
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            least[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def got(rows):
    return {r.id: (r.n_shingles, r.component_id) for r in rows.collect()}


def test_query(spark, data, docs):
    rows = queries.op5_ngram_jaccard_join(spark, data).withColumnRenamed("doc_id", "id")
    assert got(rows) == brute({r.doc_id: r.text for r in docs.collect()}, 4, 85)


@pytest.mark.parametrize("tile", [400, 7])
def test_near_copies(table, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE_SETS", tile)
    rng, texts = random.Random(tile), []
    for _ in range(6):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(500)) for _ in range(rng.choice([3, 9, 40, 120]))]
        for _ in range(25):
            own = base.copy()
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = "x" + str(rng.randrange(10**6))
            texts.append(" ".join(own + ["y"] * rng.randrange(3)))
    rng.shuffle(texts)
    for words, percent in ((4, 85), (5, 80), (1, 60)):
        assert got(ngram_join.jaccard_components(table(texts), words=words, percent=percent)) == brute(dict(enumerate(texts)), words, percent)


def test_odd_texts(spark, odd):
    clash = odd.withColumnRenamed("n_chars", "component_id")
    rows = got(ngram_join.jaccard_components(clash))
    assert rows == brute({r.doc_id: r.text for r in odd.collect()}, 5, 80)
    assert rows[0] == (0, 0) and rows[1] == (0, 1) and rows[5] == (1, 4)
    nulls = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (1, "a B c")], "doc_id long, text string")
    assert sorted(ngram_join.jaccard_components(nulls).collect(), key=str) == sorted([(None, 1, None), (3, 1, 1), (3, 1, 1), (1, 1, 1)], key=str)
    assert ngram_join.jaccard_components(odd.filter("false")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(7, 7), (None, 3)]
    want = {}

    def root(i):
        while want.setdefault(i, i) != i:
            i = want[i]
        return i

    for a, b in edges:
        if None not in (a, b) and a != b:
            x, y = sorted((root(a), root(b)))
            want[y] = x
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: root(i) for i in want}


def test_bound_loses_nothing():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**64, 30, np.uint64)) for _ in range(5)]
    sets += [np.unique(np.concatenate((sets[0][3:], rng.integers(0, 2**64, 1, np.uint64))))]
    assert ngram_join.forest_of(list(range(6)), sets, np.full(6, 2), 85) == [(0, 5)]


def test_a_chain_of_unlike_texts_makes_few_comparisons(table, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    links = [[word() for _ in range(10)] for _ in range(3001)]
    texts = [" ".join(links[i] + links[i + 1]) for i in range(3000)]
    seen, whole = [], ngram_join._tiles

    def tiles(*a):
        seen.append(whole(*a))
        return seen[-1]

    monkeypatch.setattr(ngram_join, "_tiles", tiles)
    rows = ngram_join.jaccard_components(table(texts), words=1, percent=60).collect()
    assert all(r.component_id == r.id for r in rows)
    assert len(seen) == 1
    met = {}
    for r in seen[0].collect():
        met.setdefault(r.tile, []).append(r.side)
    pairs = sum(s.count(0) * s.count(1) + s.count(2) ** 2 // 2 for s in met.values())
    assert sum(map(len, met.values())) <= 6 * 3000 and pairs < 3000 * 3000 / 2 / 8


def test_a_large_group_of_near_copies_meets_the_least_only(table, monkeypatch):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(120)]
    texts = []
    for i in range(900):
        own = base.copy()
        own[rng.randrange(4, 120)] = f"z{i}"
        texts.append(" ".join(own))
    seen, whole = [], ngram_join._tiles

    def tiles(*a):
        seen.append(whole(*a))
        return seen[-1]

    monkeypatch.setattr(ngram_join, "_tiles", tiles)
    rows = ngram_join.jaccard_components(table(texts)).collect()
    assert {r.component_id for r in rows} == {0}
    assert seen[0].count() == 0


def test_a_passage_and_unlike_copies_bring_few_together(table, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    passage, base = [word() for _ in range(60)], [word() for _ in range(120)]
    texts = [" ".join([word() for _ in range(50)] + passage + [word() for _ in range(rng.randrange(30))]) for _ in range(500)]
    for _ in range(500):  # copies with six words of their own, too many to link
        own = base.copy()
        for k in rng.sample(range(4, 116, 4), 6):
            own[k] = word()
        texts.append(" ".join(own))
    seen, whole = [], ngram_join._tiles

    def tiles(*a):
        found = whole(*a)
        seen.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_tiles", tiles)
    monkeypatch.setattr(ngram_join, "TILE_SETS", 20)
    found = got(ngram_join.jaccard_components(table(texts), words=4, percent=85))
    assert found == brute(dict(enumerate(texts)), 4, 85)
    assert sum(seen) < 20_000


@pytest.mark.parametrize("percent", [60, 80, 85, 100])
def test_links_at_the_bound_between_sizes_stay(table, monkeypatch, percent):
    monkeypatch.setattr(ngram_join, "TILE_SETS", 3)
    rng, texts = random.Random(percent), []
    for g in range(12):  # sets that hold each other, as small as may just link and one less
        pool = [f"g{g}w{i}" for i in range(110)]
        rng.shuffle(pool)
        for size in (rng.choice([17, 20, 34, 40, 60, 100]) for _ in range(4)):
            for k in (size, -(-size * percent // 100), -(-size * percent // 100) - 1):
                texts.append(" ".join([*pool[:k], "all"] if g % 3 == 0 else pool[:k]))
    rng.shuffle(texts)
    assert got(ngram_join.jaccard_components(table(texts), words=1, percent=percent)) == brute(dict(enumerate(texts)), 1, percent)


def test_an_id_with_two_texts_keeps_the_links_of_both(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    rows = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b + " x"), (4, b + " x y")], "doc_id long, text string")
    assert {r.id: r.component_id for r in ngram_join.jaccard_components(rows, words=2, percent=60).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}


def test_only_the_result_stays_on_disk(spark, table, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_SETS", 5)
    rng = random.Random(21)
    base = [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(80)]
    texts = [" ".join([*base[:k], "x" + str(k), *base[k:]]) for k in range(40)]
    place = store.shared_dir(spark).removeprefix("file://") + "/graphloom"
    before = set(os.listdir(place)) if os.path.isdir(place) else set()
    found = ngram_join.jaccard_components(table(texts))
    assert len(set(os.listdir(place)) - before) == 1
    assert got(found) == brute(dict(enumerate(texts)), 5, 80)
