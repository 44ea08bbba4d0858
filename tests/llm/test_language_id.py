"""Language identification: parts by plain loops, the whole by held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import pytest

from snpweave.llm import language_id as li


def _slow_counts(text):
    words = "".join(chr(b) if chr(b).isalpha() and b < 128 or b >= 128 else " " for b in text.encode("utf-8")).split()
    s = [32] + [x for w in words for x in [*w.lower().encode("latin-1"), 32]]
    out = Counter()
    for n in li.ORDERS:
        for k in range(len(s) - n + 1):
            v = 0
            for x in s[k : k + n]:
                v = (v << 8) | x
            v = v * li._MUL[n] & 0xFFFFFFFF
            v ^= v >> 15
            out[(v * 0x2C1B3C6D & 0xFFFFFFFF) >> 17] += 1
    return out


def test_counts():
    for text in ("Hello, World 12 it's", "a", "zz  zz. ZZ", "one two"):
        c = li._counts(np.frombuffer(text.encode(), np.uint8))
        want = _slow_counts(text)
        # a text that ends in a letter gets one blank after it, as one that ends in a sign
        assert {k: int(c[k]) for k in np.flatnonzero(c)} == {k: n for k, n in want.items()}, text


def test_blocks_end_between_words(monkeypatch):
    data = np.frombuffer(b"some words here and there " * 400, np.uint8)
    whole = li._counts(data)
    monkeypatch.setattr(li, "CHUNK", 5000)
    parts = li._counts(data)
    assert abs(whole - parts).sum() <= 16  # blanks at the seams
    monkeypatch.setattr(li, "CHUNK", 100)
    assert li._counts(np.frombuffer(b"x" * 1000, np.uint8)).sum() > 3900


def test_machine_and_curve():
    rng = np.random.default_rng(3)
    n, cols = 400, [rng.choice(200, 12, replace=False) for _ in range(400)]
    y = np.where(rng.random(n) < 0.3, 1.0, -1.0)
    cols = [np.concatenate([c, [300 if t > 0 else 301]]) for c, t in zip(cols, y, strict=True)]
    x = li.Rows(np.arange(0, 13 * n + 1, 13), np.concatenate(cols), np.ones(13 * n) / 13)
    w, b = li.fit_machine(x, y)
    dense = np.zeros((n, li.BUCKETS))
    for k, c in enumerate(cols):
        dense[k, c] = 1 / 13
    assert np.allclose(x.dot(w), dense @ w)
    assert np.allclose(x.back(y), dense.T @ y)
    assert ((x.dot(w) + b > 0) == (y > 0)).all()
    some = x.take(np.array([5, 3, 5]))
    assert np.allclose(some.dot(w), (dense @ w)[[5, 3, 5]])
    a, c = li.fit_curve(np.array([-2, -1, -0.5, 0.5, 1, 2.0]), np.array([-1, -1, 1, -1, 1, 1.0]))
    assert a > 0 and abs(c) < 0.5


def test_letters():
    for text, want in (("", False), ("12 !?", False), ("—…“”", False), ("語", True), ("é", True), ("1a", True), ("😀", False), ("١٢", False)):
        assert li._has_letter(np.frombuffer(text.encode(), np.uint8)) == want, text


def test_votes():
    """Three languages of one family and one of its own."""
    rng = np.random.default_rng(1)
    syll = {"es": ["ción", "que", "ado"], "it": ["zione", "che", "ato"], "pt": ["ção", "que", "ado", "lh"], "qq": ["xq", "zzk", "wq"]}
    texts, langs = zip(*[(" ".join("".join(rng.choice(s, 3)) for _ in range(60)), g) for g, s in syll.items() for _ in range(40)], strict=True)
    counts = np.array([li._counts(np.frombuffer(t.encode(), np.uint8)) for t in texts])
    ptr = np.concatenate([[0], np.cumsum((counts > 0).sum(axis=1))])
    x = li.Rows(ptr, np.nonzero(counts)[1], (counts / counts.sum(axis=1, keepdims=True))[counts > 0])
    m = li.fit(x, np.array(langs, object), np.arange(160) % 4 == 0)
    assert m.families == ["=qq", "romance"] and m.langs == [["qq"], ["es", "it", "pt"]] and len(m.pairs[1]) == 3
    names, score = m.predict(counts)
    assert np.mean([a == b for a, b in zip(names, langs, strict=True)]) > 0.98 and (score >= 0).all() and (score <= 1).all()


SCHEMA = "doc_id long, text string, lang string, source string, held_out int, score string"


def test_odd_rows(spark):
    rows = [(k, t, g, "s", 1, "x") for k, (t, g) in enumerate([("der die das und nicht", "de"), ("the of and that", "en"), ("le la les et que", "fr")] * 30)]
    rows += [(1000, None, "en", None, 1, ""), (1001, "", "en", "s", 1, ""), (1002, "12 — !", "de", "s", 1, ""), (1003, "und die " * 200_000, None, "s", 1, ""), (None, "the of and", "zz", "s", 1, ""), (1003, "und die " * 3, None, "s", 1, "")]
    got = li.identify(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1000, 1001, 1002))
    assert {r["lang_pred"] for r in got if r["doc_id"] == 1003} == {"de"} and by[None]["lang_pred"] == "en" and by[None]["held_out"] is None
    assert all(by[k]["lang_pred"] == g for k, (_, _, g, *_) in enumerate(rows[:90]))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_few_languages(spark):
    one = li.identify(spark.createDataFrame([(k, "abc def", "en", "s", 0, "") for k in range(20)], SCHEMA)).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("en", 1.0)}
    none = li.identify(spark.createDataFrame([(k, "abc def", None, "s", 0, "") for k in range(20)], SCHEMA)).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert li.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_held_out_labels_are_not_learnt(spark):
    rows = [(k, "der die das" if k % 2 else "the of and", "de" if k % 2 else "en", "s", 0, "") for k in range(200)]
    turned = [(k, "xx yy zz" if zlib.crc32(str(k).encode()) % 5 == 0 else t, "qq" if zlib.crc32(str(k).encode()) % 5 == 0 else g, *r) for k, t, g, *r in rows]
    a, b = (li.train(spark.createDataFrame(x, SCHEMA)) for x in (rows, turned))
    assert np.array_equal(a.weights, b.weights) and a.langs == b.langs


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.97), ("sf0.1", 0.98)])
def test_held_out_accuracy(spark, sf, least):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() >= least
