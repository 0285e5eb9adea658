import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import piece_codec, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = piece_codec.PieceCodec(PATH)
ODD = ["", " ", "  ", "   a  b ", "\n\na", "a \nb", "é é ñ", "漢字 かな", "🦄 a", "▁a ▁ ▁b", "a▁ b", "\x00a", "a" * 300, "ab" * 200 + " " * 40 + "c", "<s></s><unk><0x41>", "́a ́", "\t\t  x"]


def encoded(texts):
    out = []
    for ids, at in CODEC.encode_texts(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def held(texts):
    want = [LIBRARY.encode(t) for t in texts]
    assert encoded(texts) == want
    for ids in want:
        assert CODEC.decode(np.array(ids, np.int64), np.array([0, len(ids)])) == [LIBRARY.decode(ids)]


def test_equal_the_library(docs):
    held(ODD + [r.text or "" for r in docs.limit(80).collect()])
    assert encoded([None, "a"])[0] == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n▁.,theinga"), st.characters(exclude_categories=["Cs"])), max_size=80), max_size=4))
def test_equal_the_library_on_any_text(texts):
    held(texts)


def test_suffix_array_and_search():
    codes = CODEC._codes("the then them")
    order, _ = CODEC._suffixes(codes)
    cut = [codes[i : i + CODEC.longest].tolist() + [0] * CODEC.longest for i in range(len(codes))]
    assert [cut[i][: CODEC.longest] for i in order] == sorted(c[: CODEC.longest] for c in cut)
    table = CODEC._edges(codes).reshape(len(codes), -1)
    pieces = {LIBRARY.id_to_piece(int(i)): r for r, i in enumerate(CODEC.id_of_rank)}
    for i in range(len(codes)):
        for n in range(2, CODEC.longest + 1):
            assert table[i, n - 2] == pieces.get("the then them"[i : i + n] if i + n <= 13 else "", 65535)


def test_query(spark, data, docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = queries.op1_sentencepiece(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id])
        assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.round_trip and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_operators(odd, table):
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    clash = odd.withColumnRenamed("source", "ids")
    ids = piece_codec.encode(clash, PATH)
    assert {r.id: r.ids for r in ids.collect()} == {i: LIBRARY.encode(t) for i, t in texts.items()}
    assert {r.id: r.text for r in piece_codec.decode(ids, PATH).collect()} == texts
    assert piece_codec.encode(table([]), PATH).count() == 0
    assert piece_codec.round_trips(table([]), PATH).count() == 0


def test_repeated_rows_clashing_names_and_a_long_text(odd, spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = odd.unionByName(odd).withColumnsRenamed({"lang": "ids", "source": "id"})
    rows = piece_codec.round_trips(df, path).collect()
    assert len(rows) == 2 * odd.count() and len(set(rows)) == odd.count()
    long = spark.createDataFrame([(1, "abc déf 漢字 " * 60_000)], "doc_id long, text string")
    ids = piece_codec.encode(long, path)
    assert piece_codec.decode(ids, path).first().text == long.first().text.strip() or piece_codec.round_trips(long, path).first().n_pieces > 60_000
