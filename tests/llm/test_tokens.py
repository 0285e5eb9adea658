import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import kernel, line_dedup, packing, queries, token_records, tokens
from graphloom.llm.tokens import ChunkEncoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PAIRS = {f: (ChunkEncoder(public_tokenizers.path(f)), Tokenizer.from_file(public_tokenizers.path(f))) for f in FILES}
ODD = ["", " ", "  ", "a  b", " a b ", "\n\na", "a \nb", "x y", "é é ñ", "漢字 かな", "🦄 a", "\x1ca \x85b", "<|endoftext|> b", "a <|startoftext|>b", "don't I'LL 'S it's", "12345 67 ½ x²", "ΑΣ ΑΣΑ", "İ I", "a\r\nb\tc", "́a ́", "​  　c", "end. Next, one; two: three! four?", "."]


def same(name, text):
    fast, library = PAIRS[name]
    assert np.frombuffer(fast.encode(text), fast.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def together(name, texts):
    fast = PAIRS[name][0]
    out = []
    for ids, at in fast.encode_texts(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'sdlabcABC019éßñ́ \x1c|<>"), st.characters(exclude_categories=["Cs"])), max_size=20), max_size=6))
def test_batches_equal_the_library(texts):
    for name in FILES:
        assert together(name, texts) == [PAIRS[name][1].encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library(name, docs):
    for text in ODD + [r.text or "" for r in docs.limit(60).collect()]:
        same(name, text)
    texts = ODD + [r.text or "" for r in docs.limit(60).collect()]
    assert together(name, [*texts, None]) == [PAIRS[name][1].encode(t, add_special_tokens=False).ids for t in texts] + [[]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'sdlabcABC019éßñ́ \x1c|<>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_equal_the_library_on_any_text(text):
    for name in FILES:
        same(name, text)


def test_records(spark, data, docs):
    library = PAIRS[FILES[0]][1]
    start, want = 0, {}
    for r in docs.orderBy("doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_token_records(spark, data).collect()} == want


def test_shuffled_reads_and_damage(spark, odd, tmp_path):
    files = token_records.write_records(odd, f"file://{tmp_path}/out", public_tokenizers.path(FILES[0]), 2).collect()
    full = [f for f in files if f.records]
    assert sum(f.records for f in full) == odd.count()
    ids = list(token_records.read_at(full[0].file, full[0].width, [full[0].records - 1, 0]))
    assert all(x[-1] == 2 for x in ids)
    data = bytearray(token_records.frame(b"abcdef"))
    assert token_records.unframe(bytes(data)) == (b"abcdef", len(data))
    for at in (0, 9, 14, len(data) - 1):
        broken = data.copy()
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(bytes(broken))


def test_records_of_nulls_ties_and_nothing(spark, table):
    path = public_tokenizers.path(FILES[0])
    twice = table(["b", "a"]).unionByName(table(["b"])).selectExpr("if(text = 'a', null, doc_id) as doc_id", "text", "1 as start", "2 as n_tokens")
    rows = token_records.token_records(twice, path, 2).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 0, 0] and [r.start for r in rows] == [0, 2, 4]
    assert token_records.token_records(table([]), path, 2).count() == 0


def valid(rows, capacity=packing.CAPACITY):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, data, docs):
    library = PAIRS[FILES[1]][1]
    want = set()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want.add((r.doc_id, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    rows = queries.op10_best_fit_packing(spark, data).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    used = valid(rows)
    least = -(-sum(r.length for r in rows) // 2048)
    assert used <= least + 2


@pytest.mark.parametrize("lengths", [[2048] * 5, [1] * 5000, [1025] * 7, [1024] * 7, [700, 700, 648] * 9, [3, 2047, 1, 1024, 512, 512, 2000, 48], []])
def test_plans(spark, lengths):
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.pack(pieces.selectExpr("*", "'x' as sequence_id")).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(lengths)))
    least = {1025: 7}.get(lengths[0] if lengths else 0, -(-sum(lengths) // 2048))
    assert valid(rows) == least


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_any_plan_places_every_piece_once(counts):
    plan = packing.Plan(counts, 64)
    seen, filled = set(), {}
    for length, n in counts.items():
        sequence, offset = plan.place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            assert 0 <= o <= 64 - length and s < plan.sequences
            for p in range(o, o + length):
                assert (s, p) not in seen
                seen.add((s, p))
            filled[s] = filled.get(s, 0) + length
    assert all({p for q, p in seen if q == s} == set(range(n)) for s, n in filled.items())


def test_a_plan_of_many_lengths_is_quick_and_full():
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(rng.integers(1, 2049, 20_000), return_counts=True)
    began = time.perf_counter()
    plan = packing.Plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)))
    assert time.perf_counter() - began < 4
    least = max(-(-int((lengths * counts).sum()) // 2048), int(counts[lengths > 1024].sum()))
    assert plan.sequences <= 1.012 * least


def test_packing_repeated_and_long_texts(table):
    df = table(["a b c", None, "word " * 100_000])
    df = df.unionByName(df).withColumnsRenamed({"lang": "length", "source": "piece"})
    path = public_tokenizers.path(FILES[1])
    pieces = packing.token_pieces(df, path, 0)
    rows = packing.pack(pieces.withColumnRenamed("start", "_rank")).collect()
    assert len(rows) == pieces.count() and sum(r.doc_id == 1 for r in rows) == 2
    valid(rows)


def test_records_of_many_equal_ids_are_files_apart(spark, tmp_path):
    rows = spark.range(4000).selectExpr("1 as doc_id", "concat('t', id) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = token_records.write_records(rows, f"file://{tmp_path}/out", public_tokenizers.path(FILES[0]), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.filter("records > 0").count() > 1
    assert token_records.read_records(spark, files).count() == 4000


def test_a_worker_gives_up_the_words_that_it_kept_when_another_operator_begins():
    batch = pa.record_batch([pa.array([1]), pa.array([2]), pa.array(["a b\nc"])], names=["id", "key", "text"])
    path = public_tokenizers.path("word_bpe_49k.json")
    cut = kernel.task(packing._cutter(path, 0, 2048), "tokens")
    assert sum(x.num_rows for x in cut(iter([batch.select(["id", "text"])]))) == 1
    assert sum(x.num_rows for x in cut(iter([batch.select(["id", "text"])]))) == 1
    assert tokens.encoder.cache_info().currsize == 1
    assert sum(x.num_rows for x in kernel.task(line_dedup._lines)(iter([batch]))) == 1
    assert tokens.encoder.cache_info().currsize == 0
