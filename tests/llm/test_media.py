import hashlib
import math
import zlib

import numpy as np

from graphloom.llm import media, queries


def test_round_trip_and_digests(spark, data, docs):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = queries.op6_media_columns(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = media.padded(texts[r.doc_id])
        assert len(payload) % 576 == 0 and len(payload) >= 576 and payload.startswith(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id]), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        stored = media.to_wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert media.from_wav(stored) == payload


def test_odd_texts(odd):
    fused = sorted(media.media_features(odd).collect(), key=lambda r: r.id)
    split = sorted(media.fingerprints(media.media_column(odd)).collect(), key=lambda r: r.id)
    assert fused == split
    assert fused[0].payload_bytes == fused[1].payload_bytes == 576
    assert fused[4][1:] == fused[5][1:]


def test_a_shared_passage_shares_codes_in_time():
    noise = hashlib.shake_256(b"x").digest(576 * 20)
    a = media.peak_pairs(noise)
    b = media.peak_pairs(media.padded(b"y" * 576 * 4) + noise)
    pairs = set(zip((a[0] + 8).tolist(), a[1].tolist(), strict=True))
    assert len(pairs & set(zip(b[0].tolist(), b[1].tolist(), strict=True))) > 0.8 * len(pairs)


def slow_pairs(samples):
    """Peaks and their pairs, one frame and one bin at a time."""
    wave_form = [b - 128 for b in samples]
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / 575) for k in range(576)]
    levels = []
    for at in range(0, len(wave_form) - 575, 288):
        own = np.array([x * w for x, w in zip(wave_form[at : at + 576], window, strict=True)])
        turn = np.exp(-2j * np.pi * np.outer(np.arange(289), np.arange(576)) / 576)
        levels.append([round(4 * math.log2(1 + abs(x))) for x in turn @ own])
    peaks = []
    for lo, hi in media.BANDS:
        top = [max(range(lo, hi), key=lambda k, v=v: (v[k], -k)) for v in levels]
        for t, k in enumerate(top):
            before = t == 0 or levels[t][k] >= levels[t - 1][top[t - 1]]
            after = t + 1 == len(top) or levels[t][k] > levels[t + 1][top[t + 1]]
            if before and after:
                peaks.append((t, k))
    peaks.sort()
    out = []
    for i, (t, f) in enumerate(peaks):
        for u, g in peaks[i + 1 : i + 1 + media.FAN_OUT]:
            if u - t <= media.REACH:
                out.append((t, f << 18 | g << 6 | u - t))
    return sorted(out)


def test_features_against_slow_sums(docs):
    for r in docs.filter("n_chars > 100").orderBy("doc_id").limit(25).collect():
        payload = media.padded(r.text.encode()[:4000])
        got = list(zip(*(x.tolist() for x in media.peak_pairs(payload)), strict=True))
        want = slow_pairs(payload)
        # a magnitude on the border of two steps may be rounded either way
        assert len(set(got) ^ set(want)) <= max(4, 0.02 * len(want))


def test_clashing_names_repeated_rows_and_a_long_text(odd, spark):
    df = odd.unionByName(odd).withColumnsRenamed({"n_chars": "payload_bytes", "lang": "media"}).withColumn("id", odd.source)
    rows = media.media_features(df).collect()
    assert len(rows) == 2 * odd.count() and len(set(map(str, rows))) == odd.count()
    long = spark.createDataFrame([(1, "é🦄 x" * 300_000)], "doc_id long, text string")
    assert media.media_features(long).first().n_bytes == 8 * 300_000


def test_empty_table(table):
    assert media.media_features(table([])).count() == 0
