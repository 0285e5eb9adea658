import base64
import math
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import language, queries


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit_text_model(docs.filter("doc_id % 2 = 0"))
    rows = language.identify(docs.filter("doc_id % 2 = 1"), model, F.col("text"), F.col("source"), F.lit(None), {"doc_id": F.col("doc_id"), "lang": F.col("lang")}).collect()
    assert sum(r.language == r.lang for r in rows) >= 0.97 * len(rows)
    assert sum(r.kept for r in rows) >= 0.99 * len(rows)


def test_queries(spark, data):
    rows = queries.op9_language_id(spark, data).collect()
    assert len(rows) == 200 and sum(r.kept for r in rows) >= 195
    pages = queries.pages_language(spark, data)
    assert pages.count() == spark.read.parquet(f"{data}/pages.parquet").count()


def test_evidence(spark, docs, table):
    model = language.fit_text_model(docs)
    texts = ["the of and", None, "", "12345 !!!", "zzzxq qqqzx xqxqx zqzqz qxzqx jjqxz " * 20, "a"]
    rows = language.identify(table(texts, lang="en-US", source="x.example.de"), model, F.col("text"), F.col("source"), F.col("lang"), {"doc_id": F.col("doc_id"), "kept2": F.col("n_chars")})
    got = {r.doc_id: r for r in rows.collect()}
    assert len(got) == 6 and got[0].language == "en" and got[0].kept
    assert not any(got[k].kept for k in (1, 2, 3, 4))
    assert got[0].declared_language == "en"
    assert language.identify(table([]), model, F.col("text"), F.col("source"), F.col("lang"), {"doc_id": F.col("doc_id")}).count() == 0


def test_host_prior_decides_where_text_cannot(spark, docs, table):
    model = language.fit_text_model(docs)
    german = docs.filter("lang = 'de'").select("text").limit(20).collect()
    rows = table([r.text for r in german], lang=None, source="zeitung.example").unionByName(table([""], lang=None, source="zeitung.example"))
    got = language.identify(rows, model, F.col("text"), F.col("source"), F.col("lang"), {"n": F.col("n_chars")}).filter("n = 0").first()
    assert got.language == "de" and not got.kept


def brute(rows, model):
    """Verdicts of (text, host, declared) by plain sums over all rows, one trigram at a time."""
    names = model.languages
    keep = lambda b: b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32
    logs = []
    for text, *_ in rows:
        data = [keep(b) for b in (text or "").encode()]
        grams = [data[i : i + 3] for i in range(len(data) - 2)]
        grams = [g for g in grams if not (g[0] == g[1] == 32 or g[1] == g[2] == 32)]
        at = [((g[0] << 16 | g[1] << 8 | g[2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 17 for g in grams]
        logs.append([sum(float(model.log_share[b, k]) for b in at) / max(len(at), 1) for k in range(len(names))] + [len(at)])
    best = [max(range(len(names)), key=lambda k: (x[k], -k)) for x in logs]
    like = [bool(x[-1]) and x[k] >= model.least[k] for x, k in zip(logs, best, strict=True)]
    fold = lambda d: None if not d or not (m := re.match(r"\s*([A-Za-z]+)", d)) else m[1].lower() if m[1].lower() in names else "other"
    host = [(h or "", (h or "").rpartition(".")[2].lower() if "." in (h or "") else "") for _, h, _ in rows]
    told = [fold(d) for *_, d in rows]
    count = lambda same: [sum(like[i] and best[i] == k and same(i) for i in range(len(rows))) for k in range(len(names))]
    whole = [n + 1 for n in count(lambda i: True)]
    whole = [n / sum(whole) for n in whole]
    said = [n for n in count(lambda i: told[i] is not None)]
    out = []
    for i in range(len(rows)):
        of_suffix = count(lambda j: host[j][1] == host[i][1])
        of_host = count(lambda j: host[j] == host[i])
        suffix = [(n + language.SUFFIX_WEIGHT * w) / (sum(of_suffix) + language.SUFFIX_WEIGHT) for n, w in zip(of_suffix, whole, strict=True)]
        prior = [math.log((n + language.HOST_WEIGHT * p) / (sum(of_host) + language.HOST_WEIGHT)) for n, p in zip(of_host, suffix, strict=True)]
        declared = [0.0] * len(names)
        if told[i] is not None:
            agree = count(lambda j: told[j] == told[i])
            declared = [math.log((n + language.DECLARED_WEIGHT / (len(names) + 1)) / (m + language.DECLARED_WEIGHT)) for n, m in zip(agree, said, strict=True)]
        total = [x * logs[i][-1] * language.TEMPER + p + d for x, p, d in zip(logs[i], prior, declared, strict=False)]
        top = max(total)
        confidence = 1 / sum(math.exp(x - top) for x in total)
        out.append((names[total.index(top)], confidence, like[i] and confidence >= 0.5))
    return out


@pytest.mark.parametrize("small", [language.SMALL_BYTES, -1])
def test_verdicts_against_brute_force(spark, docs, monkeypatch, small):
    model = language.fit_text_model(docs)
    monkeypatch.setattr(language, "SMALL_BYTES", small)
    monkeypatch.setattr(language.skew, "LEAST", 20)
    monkeypatch.setattr(language.skew, "SHARE", 3)
    rng = random.Random(4)
    rows = [(r.text[:400], rng.choice(["a.example.de", "b.de", "c.example", "plain", None, ""]), rng.choice([r.lang, "en-GB", "xx", None, ""])) for r in docs.orderBy("doc_id").limit(90).collect()]
    rows += [(None, "b.de", "de"), ("", None, None), ("zq xq " * 30, "b.de", "de"), ("der", "b.de", "en")] + rows[:5]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, text string, host string, said string")
    got = sorted(language.identify(df, model, F.col("text"), F.col("host"), F.col("said"), {"n": F.col("n")}).collect())
    assert len(got) == len(rows)
    for r, (name, confidence, kept) in zip(got, brute(rows, model), strict=True):
        assert (r.language, r.kept) == (name, kept) and abs(r.confidence - confidence) < 1e-6, rows[r.n]


def test_odd_rows(spark, docs, odd):
    model = language.fit_text_model(docs)
    df = odd.unionByName(odd).withColumnsRenamed({"n_chars": "language", "lang": "confidence"}).withColumn("h0", odd.source)
    rows = language.identify(df, model, F.col("text"), F.col("source"), F.col("confidence"), {"doc_id": F.col("doc_id")}).collect()
    assert len(rows) == 2 * odd.count() and len(set(rows)) == odd.count()
    long = spark.createDataFrame([(1, "the of and to in is that it " * 60_000)], "doc_id long, text string")
    assert language.identify(long, model, F.col("text"), F.lit(None), F.lit(None), {"doc_id": F.col("doc_id")}).first().language == "en"


SHORT = "ga", "an the agus is bean fear"
ORDINARY = "ga", "Tá an fear agus an bhean ag dul go dtí an siopa mór sa bhaile chun arán agus bainne a cheannach, agus beidh siad ar ais roimh an dinnéar anocht le chéile arís"


@pytest.mark.parametrize("tag, text", [SHORT, ORDINARY])
def test_a_language_with_one_text_does_not_let_junk_in(docs, table, tag, text):
    rng = random.Random(6)
    rows = docs.unionByName(table([text], lang=tag).withColumn("doc_id", F.lit(10**9).cast("long")))
    model = language.fit_text_model(rows)
    assert tag in model.languages and (model.least > model.log_share.min(axis=0)).all() and np.isfinite(model.least).all()
    junk = ["".join(rng.choices(string.ascii_lowercase + " ", k=900)), base64.b64encode(rng.randbytes(600)).decode(), rng.randbytes(400).hex(" "), "a" * 700]
    junk += ["Мама мыла раму, а папа читал газету и пил чай на кухне. " * 8, "我们今天去学校学习中文和数学然后回家吃饭睡觉。" * 9]
    good = [r.text for r in docs.filter("length(text) > 300").orderBy("doc_id").limit(20).collect()]
    got = language.identify(table(junk + good), model, F.col("text"), F.col("source"), F.lit(None), {"doc_id": F.col("doc_id")}).collect()
    assert not [r for r in got if r.doc_id < len(junk) and r.kept]
    assert sum(r.kept for r in got if r.doc_id >= len(junk)) >= 19


def test_every_language_has_its_share_of_the_sample():
    assert language.quotas({"en": 10**6, "de": 900, "ga": 1}, 4000) == {"ga": 1, "de": 900, "en": 3099}
    assert sum(language.quotas({str(k): 10**6 for k in range(7)}, 4000).values()) == 4000
