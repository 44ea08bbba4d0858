"""The operators against brute force, exact round trips or held-out labels, and their defined results for odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snpweave.llm import ann, decontaminate, license_scan, line_dedup, minhash_dedup, mixing, pii, quality, token_counts, tokens, toxicity
from snpweave.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(900, None, None, None, None), (901, "", "en", None, 0), (None, "some words here and there again", "en", "a", 3), (902, " \n\n ", "en", "b", 4), (903, "x" * 50, "en", "b", 50)]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}" if t is not None else None, len(t or "")) for i, t in rows], DOCS)


def corpus(n=120, seed=1):
    r = random.Random(seed)
    voc = ["".join(r.choice("abcdeéßпрст") for _ in range(r.randint(2, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            w = words(out[r.randrange(len(out))][1])
            for _ in range(r.choice([0, 1, 2, 3, 5])):
                if w:
                    w[r.randrange(len(w))] = r.choice(voc)
        else:
            w = [r.choice(voc) for _ in range(r.randint(1, 60))]
        out.append((i, " ".join(w)))
    return out


def test_tokens_match_regex():
    texts = ["Ab c\td\n", None, "", "É x", "  ", "a" * 10, "z\x0by"]
    (b,) = tokens.blocks(pa.array(texts))
    assert np.diff(b.ptr).tolist() == [len(words(t)) for t in texts]
    (c,) = tokens.blocks(pa.array(["ab c d"]))
    assert b.hashes[:3].tolist() == c.hashes.tolist()
    long = "word " * 700_000
    assert sum(len(x.hashes) for x in tokens.blocks(pa.array(["a", long, "b"]))) == 700_002


def shingle_set(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k,options", [(2, {}), (5, {}), (2, {"bands": 240, "rows": 1})])
def test_near_duplicates_brute_force(spark, k, options, monkeypatch):
    if options:  # buckets of unrelated documents, in small blocks
        monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    rows = corpus() + [(i, t) for i, t, *_ in ODD] + [(950 + i, "same words in all of these copies of a text") for i in range(30)]
    sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    got = minhash_dedup.near_duplicates(make(spark, rows).withColumn("cls", F.lit(1)).withColumn("key", F.lit(2)), shingle=k, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), top(r["doc_id"]), top(r["doc_id"]) == r["doc_id"])


def test_near_duplicates_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        w[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = minhash_dedup.near_duplicates(make(spark, rows)).collect()
    assert {r["component_id"] for r in got} == {0}
    assert minhash_dedup.keep_one(make(spark, rows)).count() == 1
    again = make(spark, [(0, rows[0][1]), (0, rows[0][1]), (0, "other text under the id"), (5, "alone " * 7), (5, "alone " * 7), (None, "x"), (None, "x"), (6, None), (7, "")])
    left = minhash_dedup.keep_one(again)
    assert left.columns == again.columns and collections.Counter(x["doc_id"] for x in left.collect()) == {0: 2, 5: 1, None: 2, 6: 1, 7: 1}
    assert minhash_dedup.keep_one(again.limit(0)).count() == 0 and minhash_dedup.near_duplicates(again.limit(0)).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(e, "a", "b").collect()))
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 103: 100}
    assert components(e.limit(0), "a", "b").count() == 0


def line_reference(rows, min_chars=20, min_docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    held = collections.defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= min_chars:
                    held[key(x)].add(i)
    out = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == i]
        out[(i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())] += 1
    return out


def test_line_dedup(spark):
    r = random.Random(5)
    pool = [f"a line that is shared number {i} é" for i in range(8)] + ["short", "", "  A Line That is Shared Number 3 é \r"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for i in range(60)] + [(i, t) for i, t, *_ in ODD] + [(3, "repeat of an id\n" + pool[1])]
    d = make(spark, rows).withColumn("pos", F.lit(1)).withColumn("drops", F.lit("x"))
    want = line_reference(rows)
    assert collections.Counter(map(tuple, line_dedup.line_digest(d).collect())) == want
    cut = line_dedup.line_dedup(d)
    assert cut.columns == d.columns
    assert sorted(hashlib.sha256((x["text"] or "").encode()).hexdigest() for x in cut.collect()) == sorted(k[3] for k in want.elements())
    assert line_dedup.line_digest(d.limit(0)).count() == 0


def test_line_dedup_hot_key(spark):
    rows = [(i, f"the very common line of all documents\nown {i}") for i in range(400)]
    got = line_dedup.line_digest(make(spark, rows).repartition(7)).collect()
    assert sum(x["n_dropped"] for x in got) == 399
    assert next(x for x in got if x["doc_id"] == 399)["n_dropped"] == 0


def test_quality(spark):
    r = random.Random(2)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    bad = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) + "###" for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(400)] + [(i, t) for i, t, *_ in ODD]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(900, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    d = make(spark, rows).withColumn("score", F.lit("clash"))
    got = quality.score(d, labels).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    held = [x for x in got if x["held_out"]]
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got)
    assert np.mean([x["predicted"] == int(x["doc_id"] % 3 > 0) for x in held if x["doc_id"] < 400]) > 0.97
    assert quality.keep_good(d, labels).columns == d.columns
    assert {x["score"] for x in quality.score(d.limit(3), labels.limit(0)).collect()} == {0.5}
    assert quality.score(d.limit(0), labels).count() == 0


def test_random_indexing_is_a_plain_sum(spark):
    rows = corpus(30)
    a = quality.word_vectors(make(spark, rows).repartition(5))
    b = quality.word_vectors(make(spark, rows).coalesce(1))
    assert np.array_equal(a, b)


def test_random_indexing_and_pooling_brute_force(spark):
    rows = [(i, t) for i, t in corpus(25)] + [(40, "Mixed CASE words, 12 signs!! and and and"), (41, None), (42, "")]
    kinds = r"[a-z\x80-\U0010ffff]+|[A-Z]+|[0-9]+|[^\sa-zA-Z0-9\x80-\U0010ffff]+"
    places, signs = quality.index_vectors()
    said = {i: re.findall(kinds, t or "") for i, t in rows}
    bucket = {}
    for _, w in quality._buckets(pa.array([" ".join(x) for x in said.values()])):
        bucket |= dict(zip([x for v in said.values() for x in v], w.tolist(), strict=True))
    m = np.zeros((quality.BUCKETS, quality.DIM))
    for w in said.values():
        for i, x in enumerate(w):
            for j in range(max(0, i - quality.WINDOW), min(len(w), i + quality.WINDOW + 1)):
                if i != j:
                    for p, s in zip(places[bucket[w[j]]], signs[bucket[w[j]]], strict=True):
                        m[bucket[x], p] += s
    unit = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    assert np.array_equal(quality.word_vectors(make(spark, rows)), unit)
    pooled = quality._pooled(pa.array([t for _, t in rows]), unit)
    for got, w in zip(pooled, said.values(), strict=True):
        v = np.array([unit[bucket[x]] for x in w]).reshape(len(w), quality.DIM)
        want = np.concatenate([v.mean(axis=0), v.std(axis=0)]) if len(w) else np.zeros(2 * quality.DIM)
        echo = sum(x in w[max(0, i - 3) : i] and bool(re.match(r"[a-z\x80-\U0010ffff]", x)) for i, x in enumerate(w))
        assert np.allclose(got, [*want, math.log1p(len(w)), echo / max(1, len(w))], atol=2e-3), w


def test_network_gradient_and_temperature():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = (rng.random(3000) < 1 / (1 + np.exp(-3 * x[:, 0]))).astype(float)
    net = quality.Network(x[:2000], y[:2000])
    p = net(x[2000:])
    # two layers by hand
    z = (x[2000:] - net.mean) / net.std
    by_hand = [1 / (1 + math.exp(-sum(net.p[2][k] * math.tanh(sum(z[i, j] * net.p[0][j, k] for j in range(5)) + net.p[1][k]) for k in range(32)) / net.t - net.p[3][0] / net.t)) for i in range(5)]
    assert np.allclose(p[:5], by_hand)
    # calibrated: among rows of like score, the share of ones is the score
    for lo in (0.0, 0.25, 0.5, 0.75):
        own = (p >= lo) & (p < lo + 0.25)
        assert abs(p[own].mean() - y[2000:][own].mean()) < 0.12


def test_quality_of_odd_rows(spark):
    r = random.Random(21)
    rows = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(5)) + ("" if i % 2 else "##") for _ in range(30))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, 0)], "doc_id long, quality int").withColumn("text", F.lit("clash")).withColumn("y", F.lit(1))
    odd = rows + [(7, rows[7][1]), (7, "other words under one id"), (None, rows[9][1]), (500, "word " * 700_000)]
    d = make(spark, odd).withColumn("y", F.lit(2)).withColumn("vec", F.lit(3)).withColumn("quality", F.lit(0))
    got = quality.score(d, labels).collect()
    by = collections.defaultdict(set)
    for x in got:
        by[x["doc_id"]].add(round(x["score"], 12))
    assert len(got) == len(odd) and len(by[7]) == 2 and by[None] == by[9]
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and collections.Counter(x["doc_id"] for x in kept.collect()) == collections.Counter(x["doc_id"] for x in got if x["score"] >= 0.7)


def every_reading(span, model):
    """(cost, reading) of every path of a span's lattice."""
    text, out = span.lower(), []

    def go(i, k, cost, said):
        if i == len(text):
            out.append((cost + (model.cost[k[0], k[1], 0] if k[1] else 0), said))
            return
        c, t = text[i], toxicity
        arcs = [(0.0, c)]
        if c in t.STANDS:
            arcs = [(t.COST_SIGN, x) for x in t.STANDS[c]] + [(t.COST_KEPT, c)]
        elif c in t.SEPARATORS:
            arcs = [(t.COST_SEPARATOR, ""), (t.COST_SPACE, " ")]
        elif (i and text[i - 1] == c) or (i > 1 and text[i - 2] == c and text[i - 1] in t.SEPARATORS):
            arcs.append((t.COST_REPEAT, ""))
        for w, x in arcs:
            if x.isalpha():
                a, b, n = *k, cost + w
                for s in x.encode():
                    n += model.cost[a, b, t.SYMBOL[s]]
                    a, b = b, t.SYMBOL[s]
                go(i + 1, (a, b), n, said + x)
            elif x:
                go(i + 1, (0, 0), cost + w + (model.cost[k[0], k[1], 0] if k[1] else 0), said + x)
            else:
                go(i + 1, k, cost + w, said)

    go(0, (0, 0), 0.0, "")
    return out


def test_viterbi_against_enumeration(spark):
    model = toxicity.char_model(make(spark, [(i, "the idiot walks past a green house and the stone moron idiot ßé") for i in range(50)]))
    r = random.Random(12)
    for _ in range(150):
        span = "".join(r.choice("idot10@s..-- mruéß") for _ in range(r.randint(1, 8))).strip()
        if not span:
            continue
        paths = every_reading(span, model)
        best, got = min(paths)[0], toxicity.decode(span, model)
        assert any(said == got and abs(cost - best) < 1e-3 for cost, said in paths), (span, got, min(paths))


def test_toxicity_of_odd_rows(spark):
    rows = [(i, f"the {'idiot' if i % 2 else 'house'} is green {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int").withColumn("text", F.lit("clash")).withColumn("y", F.lit(1))
    odd = rows + [(1, rows[1][1]), (1, "green house"), (None, "an idiot"), (500, "the house is green " * 60_000 + "1d10t"), (501, "x" * 300_000), (502, None), (503, "")]
    d = make(spark, odd).withColumn("y", F.lit(2)).withColumn("gram", F.lit(3)).withColumn("toxic", F.lit(0))
    got = toxicity.score(d, labels).collect()
    by = collections.defaultdict(set)
    for x in got:
        by[x["doc_id"]].add(x["predicted"])
    assert len(got) == len(odd) and by[1] == {0, 1} and by[None] == {1} and by[500] == {1} and by[501] == {0} and by[502] == by[503]


def test_toxicity(spark):
    r = random.Random(4)
    clean = lambda: [r.choice(["the", "house", "is", "green", "and", "tall", "river", "stone", "walks"]) for _ in range(30)]
    rows = []
    for i in range(400):
        w = clean()
        if i % 4 == 0:
            w[r.randrange(30)] = r.choice(["idiot", "moron"])
        rows.append((i, " ".join(w)))
    hidden = {1001: "the 1d10t walks", 1002: "green i d i o t stone", 1003: "a m0r0n and", 1004: "the moooron is", 1005: "i.d.i.o.t"}
    plain = {1010: "the house 12 is 3.14 green", 1011: "stone walks and walks"}
    rows += list(hidden.items()) + list(plain.items()) + [(i, t) for i, t, *_ in ODD]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    d = make(spark, rows)
    got = {x["doc_id"]: x for x in toxicity.score(d, labels).collect()}
    assert np.mean([got[i]["predicted"] == int(i % 4 == 0) for i in range(400) if got[i]["held_out"]]) > 0.97
    assert all(got[i]["predicted"] == 1 for i in hidden), {i: got[i]["score"] for i in hidden}
    assert all(got[i]["predicted"] == 0 for i in plain)
    back = {x["doc_id"]: x["text"] for x in toxicity.restore(d).collect()}
    assert back[1001] == "the idiot walks" and back[1002] == "green idiot stone" and back[1011] == plain[1011] and back[900] is None
    assert toxicity.score(d.limit(0), labels).count() == 0


def test_toxicity_of_many_elongated_words(spark):
    r = random.Random(14)
    voc = ["the", "house", "is", "green", "and", "tall", "river", "stone", "walks", "good", "stood"]
    rows = [(i, " ".join([*(r.choice(voc) for _ in range(20)), *(["moron"] if i % 4 == 0 else [])])) for i in range(400)]
    rows += [(2000 + i, f"the {'m' + 'o' * r.randint(3, 9) + 'ron'} walks") for i in range(600)] + [(3000, "see www.site.org/xiii and III green"), (3001, "The MoOoron")]
    rows += [(3002, "идиот стоит рядом " * 50), (3003, "идииииот")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    d = make(spark, rows)
    back = {x["doc_id"]: x["text"] for x in toxicity.restore(d).collect()}
    assert all(back[i] == "the moron walks" for i in range(2000, 2600)) and back[3001] == "The moron" and back[3003] == "идиот"
    assert back[3000] == rows[1000][1]
    assert all(x["predicted"] == 1 for x in toxicity.score(d, labels).collect() if 2000 <= (x["doc_id"] or 0) < 2600)


def test_toxicity_reads_every_span(spark):
    r = random.Random(24)
    voc = ["the", "house", "is", "green", "and", "tall", "river", "stone", "walks", "idiot", "moron", "ass"]
    rows = [(i, " ".join(r.choice(voc) for _ in range(30))) for i in range(300)]
    said = ["the", "green", "idiot", "walks", "and", "moron", "is", "the", "tall", "house", "idiot"]
    odd = {
        "i d 1 0 t": "idiot", "1 d 1 o t": "idiot", "the i d i o t.": "the idiot.", '"i d i o t!" is': '"idiot!" is', "a s s": "ass", "a.s.s": "ass", "i.d.i.o.t.": "idiot.", "i.d.1.0.t": "idiot", "i\nd\ni\no\nt": "idiot", "i  d  i  o  t": "idiot",
        "  ".join(" ".join(w) for w in said): "  ".join(w if len(w) > 2 else " ".join(w) for w in said), "i d i o t\nm o r o n": "idiot\nmoron", "i_d_i_0_t-" * 12 + "i": None, "m0r0n" * 20: None, "house 1 2 3 4": "house 1 2 3 4", "3.14 is 1.2.3": "3.14 is 1.2.3",
    }
    rows += [(1000 + k, x) for k, x in enumerate(odd)] + [(2000, " ".join(" ".join(w) for w in said))]
    back = {x["doc_id"]: x["text"] for x in toxicity.restore(make(spark, rows)).collect()}
    for k, (x, y) in enumerate(odd.items()):
        assert back[1000 + k] == y if y is not None else not re.search("[01]", back[1000 + k]), (x, back[1000 + k])
    assert {"idiot", "moron"} <= set(back[2000].split()), back[2000]


def test_decontaminate(spark):
    r = random.Random(6)
    voc = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(r.choice(voc) for _ in range(r.randint(15, 40)))) for i in range(20)] + [(50, None), (51, ""), (52, "tiny item text"), (None, "null id item with many words in it here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], {}
    for i in range(60):
        body = [r.choice(voc) for _ in range(50)]
        if i % 3 == 0:
            k = r.randrange(20)
            w = items[k][1].upper().split()
            for j in range(3, len(w), 7 if i % 2 else 10**6):
                w[j] = "changed"
            body[20:20] = w
            want[i] = k
        rows.append((i, ", ".join(body)))
    rows += [(200, "here is a Tiny item, text!"), (201, "tiny item of text")] + [(i, t) for i, t, *_ in ODD]
    want[200] = 52
    d = make(spark, rows)
    got = {x["doc_id"]: x["item_ids"] for x in decontaminate.leaks(d, bench).collect()}
    assert got == {i: [k] for i, k in want.items()}
    left = decontaminate.drop_leaks(d, bench)
    assert left.columns == d.columns and left.count() == len(rows) - len(want)
    assert decontaminate.leaks(d, bench.limit(0)).count() == 0 and decontaminate.leaks(d.limit(0), bench).count() == 0


def test_decontaminate_brute_force(spark, monkeypatch):
    """Every item laid on every place of every document; hot seeds split."""
    monkeypatch.setattr(decontaminate, "HOT", 3)
    r = random.Random(16)
    voc = [f"v{i}" for i in range(60)]
    base = [r.choice(voc) for _ in range(14)]
    items = [(i, base[: r.randint(6, 14)] + [r.choice(voc) for _ in range(r.randint(0, 8))]) for i in range(25)] + [(60, ["v1"]), (61, ["v2", "v3", "v4"]), (62, base), (63, base), (64, base)]
    rows = []
    for i in range(80):
        body = [r.choice(voc) for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 2)):
            w = list(r.choice(items)[1])
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "other"
            k = r.randint(0, len(body))
            body[k:k] = w
        rows.append((i, " ".join(body)))
    rows += [(5, rows[6][1]), (5, rows[7][1]), (5, rows[7][1]), (None, rows[8][1])]

    def seeded(d, w, x):
        for m in decontaminate._masks(len(w), 8):
            for k in range(len(w) - len(m) + 1):
                if 0 <= x + k and x + k + len(m) <= len(d) and all(c == "0" or w[k + j] == d[x + k + j] for j, c in enumerate(m)):
                    return True
        return False

    known = collections.defaultdict(list)  # items with the same words leak together
    for i, w in items:
        known[tuple(w)].append(i)
    want, leaky = collections.Counter(), set()
    for i, t in {(i, t) for i, t in rows}:
        d, got = t.split(), {}
        for w, ks in known.items():
            for x in range(-len(w), len(d)):
                if seeded(d, w, x):
                    o = decontaminate.overlap(np.array(d), np.array(w), x, 8, 0.6, 13)
                    if o:
                        got |= {k: max(o, got.get(k, 0)) for k in ks}
        if got:
            leaky.add(t)
            if i is not None:
                want[(i, tuple(sorted(got)), round(max(got.values()), 9))] += 1
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string").withColumn("rid", F.lit(1))
    d = make(spark, rows).withColumn("words", F.lit(1)).withColumn("rid", F.lit(2)).repartition(3)
    out = decontaminate.leaks(d, bench).collect()
    assert collections.Counter((x["doc_id"], tuple(x["item_ids"]), round(x["overlap"], 9)) for x in out) == want
    for few in (decontaminate.FEW, 0):
        monkeypatch.setattr(decontaminate, "FEW", few)
        left = decontaminate.drop_leaks(d, bench)
        assert left.columns == d.columns and sorted(x["text"] for x in left.collect()) == sorted(t for _, t in rows if t not in leaky)


def test_decontaminate_grain_at_every_size(spark, monkeypatch):
    items = [(i, " ".join(f"q{i}x{j}" for j in range(15))) for i in range(10)]
    rows = [(i, "lead " + items[i][1] + " tail " + items[(i + 1) % 10][1]) for i in range(10)] + [(99, "nothing to see"), (1, "again " + items[4][1]), (50, "word " * 400_000 + items[3][1])]
    for bits in (1 << 28, 1 << 15):  # a full bit table lets everything through to the join
        monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
        got = sorted((x["doc_id"], x["item_ids"]) for x in decontaminate.leaks(make(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect())
        assert got == sorted([(i, sorted([i, (i + 1) % 10])) for i in range(10)] + [(1, [4]), (50, [3])])


def test_license_scan(spark):
    rows = [
        (1, "Released under the MIT License. under the mit license"), (2, "Licensed under the Apache License, Version 2.0."), (3, "cc-by-nc 4.0 and CC BY-NC-SA 3.0"), (4, "GNU General Public License version 3 or later"),
        (5, "under the mit licenses"), (6, "plain text"), (7, "mit license"), *[(i, t) for i, t, *_ in ODD], (8, "Un der the MİT license under  the -- mit\tlicense"), (9, "word " * 50000 + "under the mit license"),
    ]
    got = {x["doc_id"]: x for x in license_scan.scan(make(spark, rows)).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
        base = [(k, v) for p, v in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        x = got[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"]) == (len(w), len(base), min([k for k, _ in base], default=None), max([k for k, _ in base], default=None))
        assert x["base_labels"] == ",".join(sorted({v for _, v in base})) and {v for _, v in base} <= set(x["labels"].split(","))
        assert 0 <= x["score"] <= 1
    assert "gpl-3-or-later" in got[4]["labels"] and "gpl-3," not in got[4]["labels"] + ","
    assert got[6]["labels"] == "" and got[7]["labels"] == "mit" and got[7]["score"] == 0.8
    assert len(license_scan.rules()) > 300 and license_scan.scan(make(spark, rows).limit(0)).count() == 0


def longest(tree):
    """The words of a regex's longest form."""
    out = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "MAX_REPEAT":
            out += longest(arg[2])
        elif op == "SUBPATTERN":
            out += longest(arg[3])
        elif op == "BRANCH":
            out += max(map(longest, arg[1]), key=lambda x: (x.count(" "), len(x)))
        elif op == "IN":
            out += "9" if "DIGIT" in str(arg) else "x"
    return out


def test_license_scan_takes_every_rule_whole(spark):
    notice = "under the terms of the GNU {} License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    gnu = [(n, v, f"{x}-{v}-or-later") for n, x, v in (("General Public", "gpl", "2"), ("General Public", "gpl", "3"), ("Lesser General Public", "lgpl", "2.1"), ("Affero General Public", "agpl", "3"))]
    rows = [(i, notice.format(n, v)) for i, (n, v, _) in enumerate(gnu)]
    forms = [(longest(re._parser.parse(r[2].replace("@", w))), r) for r in license_scan.rules() for w in r[0]]
    rows += [(100 + i, x) for i, (x, _) in enumerate(forms)]
    got = {x["doc_id"]: x["labels"].split(",") for x in license_scan.scan(make(spark, rows)).collect()}
    for i, (_, _, label) in enumerate(gnu):
        assert label in got[i] and label.removesuffix("-or-later") not in got[i]
    text = [re.sub(" +", " ", x).strip() for x, _ in forms]
    for i, (_, (_, _, _, label, prio)) in enumerate(forms):
        # the whole form is one match: its label, or that of a rule which matches as much and goes before
        better = {r[3] for r in license_scan.rules() if r[4] <= prio for w in r[0] if (m := re.search(r[2].replace("@", w), text[i])) and m[0] == text[i]}
        assert label in got[100 + i] or better & set(got[100 + i]), (text[i], label, got[100 + i])
        assert not label.endswith("-or-later") or label in got[100 + i], (text[i], label, got[100 + i])


NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-3-clause": "Neither the name of the University of Some Town nor the names of its contributors may be used to endorse or promote products derived from this software without permission",
    "zlib": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one",
    "epl-2.0": "made available under the terms of the Eclipse Public License v. 2.0 which is available at",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "gpl-2-or-later": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-or-later": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "postgresql": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",
    "cc-by-sa-4.0": "This work is licensed under CC BY-SA 4.0.",
}


def test_license_scan_of_standard_notices(spark):
    got = {x["doc_id"]: x for x in license_scan.scan(make(spark, list(enumerate(NOTICES.values())))).collect()}
    for i, label in enumerate(NOTICES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0, (label, got[i]["labels"])


def resolved(text):
    """Labels of a text by a plain loop over rules, windows and detections."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(ASCII))
    before, after = license_scan.reach()
    found = []
    for i, x in enumerate(w):
        for order, second, regex, label, prio in license_scan.keywords().get(x, ()):
            lo = max(0, i - before)
            window = " ".join([*w[lo:i], license_scan.MARK + x, *w[i + 1 : i + 1 + after]])
            m = re.search(regex.replace("\\b", r"\b"), window, re.ASCII) if second in window else None
            if m:
                start = i - m[0].split(license_scan.MARK)[0].count(" ")
                found.append((start, -(start + m[0].count(" ")), prio, order, label))
    out, tops = set(), {1: -1, 2: -1, 3: -1}
    for _, back, prio, _, label in sorted(found):
        if max(tops[p] for p in range(1, prio + 1)) < -back:
            out.add(label)
        tops[prio] = max(tops[prio], -back)
    for p, label in license_scan.BASE.items():
        if f" {p} " in f" {' '.join(w)} ":
            out.add(label)
    return ",".join(sorted(out))


def test_license_scan_brute_force(spark):
    r = random.Random(17)
    pieces = [*NOTICES.values(), "Released under the MIT License", "GPLv3+", "under the mit license", "cc by nc 4.0", "All rights reserved", "Copyright (c) 2019 someone", "see the LICENSE file", "SPDX-License-Identifier: BSD-3-Clause", "BSD 3-clause license", "plain words stand here"]
    rows = []
    for i in range(150):
        t = " ".join(r.choice(pieces) for _ in range(r.randint(1, 5))).split(" ")
        for _ in range(r.randint(0, 3)):
            del t[r.randrange(len(t))]
        rows.append((i, " ".join(t)))
    rows += [(500, rows[0][1]), (500, rows[0][1]), (None, rows[1][1])]
    d = make(spark, rows).withColumn("words", F.lit(1)).withColumn("at", F.lit("x")).withColumn("labels", F.lit("y"))
    got = collections.Counter((x["doc_id"], x["labels"]) for x in license_scan.scan(d).collect())
    assert got == collections.Counter((i, resolved(t)) for i, t in rows)


def fill(sizes, weights, total, cap=2):
    caps = {k: cap * v for k, v in sizes.items()}
    done, left, out = set(), float(total), {}
    while True:
        rest = [k for k in sizes if k not in done]
        w = sum(weights[k] for k in rest)
        over = [k for k in rest if w and left * weights[k] / w > caps[k]]
        if not over:
            return out | {k: left * weights[k] / w for k in rest}
        for k in over:
            done.add(k)
            out[k] = float(caps[k])
        left = total - sum(out.values())


def test_mixing(spark):
    r = random.Random(8)
    rows = [(i, "w " * r.randint(0, 40), "en", r.choice(["a", "a", "a", "b", "c", "é", None]), 0) for i in range(200)] + [(201, None, None, "zz", None), (None, "x y", None, None, None), (5, "again", "en", "b", 1)]
    d = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit(0)).withColumn("key", F.lit(1))
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    by = {i: s for i, _, _, s, _ in rows if i != 5}
    taken = collections.Counter()
    for x in got:
        if x["doc_id"] != 5:
            s = by[x["doc_id"]]
            assert x["source_size"] == sizes[s] and math.isclose(x["target"], want[s])
        assert 0 <= x["taken"] <= 2 * x["size"] and (x["position"] is None) == (x["taken"] == 0)
        taken[(x["source_size"], round(x["target"], 6))] += x["taken"]
    for (_, t), n in taken.items():
        assert abs(n - t) <= 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(d.repartition(9)).collect()))
    assert mixing.mix(d.limit(0)).count() == 0


@pytest.mark.parametrize("knots", [mixing.FADE, mixing.STEADY, mixing.RISE])
def test_schedule_inverts_its_integral(spark, knots):
    y = [i / 50 for i in range(50)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in y], "y double").select(mixing.position(F.col("y"), knots)).collect()]
    t = np.linspace(0, 1, 200_001)
    w = np.interp(t, *zip(*knots, strict=True))
    area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    assert np.allclose(got, np.interp(y, area / area[-1], t), atol=1e-4)


def test_token_counts(spark):
    rows = corpus(40) + [(60, "One. Two! Three?\nFour. \n\n é x.  y")] + [(i, t) for i, t, *_ in ODD]
    got = token_counts.section_tokens(make(spark, rows), rule="most", sections=token_counts.sentences).collect()
    for x, (i, t) in zip(sorted(got, key=lambda x: str(x["doc_id"])), sorted(rows, key=lambda r: str(r[0])), strict=True):
        ids, a, b = token_counts.token_spans(t or "")
        raw = (t or "").encode()
        enc, _ = token_counts.encoder()
        assert enc.decode(ids.tolist()) == (t or "") and (not len(b) or b[-1] == len(raw))
        s, e = token_counts.sentences(raw)
        n = [0] * len(s)
        for p, q in zip(a, b, strict=True):
            n[int(np.argmax([min(q, ee) - max(p, ss) for ss, ee in zip(s, e, strict=True)]))] += 1
        assert x["n_tokens"] == len(ids) and x["section_tokens"] == n and x["outside"] == 0
    start = token_counts.section_tokens(make(spark, rows)).collect()
    assert all(sum(x["section_tokens"]) + x["outside"] == x["n_tokens"] for x in start)
    f = token_counts.field_tokens(spark.createDataFrame([(1, "a title", "the body"), (2, None, "b")], "k long, title string, body string"), "k", ["title", "body"]).collect()
    assert f[0]["title_tokens"] > 0 and f[1]["title_tokens"] == 0


def test_pii(spark):
    rows = [
        (1, "mail und.34@mail7.example.com or UND.34@mail7.example.com"), (2, "call +1 (017) 555-7713 or +10175557713, ip 97.51.17.173."), (3, "card 4111 1111 1111 1111 and 4111111111111111"),
        (4, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (5, "Mrs. Anna Keller met Mr. Keller"), (6, "nothing 12 here, 3.14 or 2020-01-02"), *[(i, t) for i, t, *_ in ODD],
    ]
    got = {x["doc_id"]: x for x in pii.pseudonymise(make(spark, rows)).collect()}
    text = dict(rows)
    for i in (6, 900, 901, 902, 903):
        assert got[i]["text"] == text[i] and got[i]["n_entities"] == 0
    assert got[1]["n_entities"] == 2 and "und.34" not in got[1]["text"].lower()
    a, b = re.findall(r"\S+@\S+", got[1]["text"])
    assert a.lower() == b.lower() and a.endswith(".com") and b[:3].isupper()
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4} or", got[2]["text"]) and "97.51" not in got[2]["text"] and got[2]["kinds"] == "ip,phone"
    x, y = re.findall(r"\d[\d ]{14,}\d", got[3]["text"])
    assert x.replace(" ", "") == y and pii.luhn(y) and y != "4111111111111111"
    assert re.search(r'token = "[0-9a-f]{40}"', got[4]["text"]) and "04dbebab" not in got[4]["text"]
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+)", got[5]["text"])
    assert m[1] in pii.POOLS["given-f"] and m[2] == m[3] and m[2] != "Keller"


def test_pii_kinds(spark):
    """Every planted entity goes from every document, keeps its shape, and is one in all its forms; what only looks like one stays."""
    forms = {
        "phone": ["+1 (417) 555-7713", "(417) 555-7713", "417-555-7713"], "iban": ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"], "ip6": ["2001:db8:0:0:0:ff00:42:8329", "2001:db8::ff00:42:8329", "2001:0db8:0000:0000:0000:ff00:0042:8329"],
        "secret": ["password = swordfish", 'token: "opensesame"', "secret: OpenSesaMe", "api_key=abcdefgh"], "card": ["4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005"], "ssn": ["078-05-1120"],
        "names": ["Госпожа Анна Иванова", "г-н Пётр Сидоров", "Κύριος Νίκος Παπαδάκης", "my name is Walter Whitman", "Herr Müller-Lüdenscheid"],
    }
    plain = ["the 1234567812345678 stays", "at 12:30:45 or 10:20", "std::vector<int> a::b", "password: required", "a token is a word", "DE00 3704 0044 0532 0130 00", "version 1.2.3", "Miss the train", "9807915762804490"]
    rows = [(i, f"begin {t} end") for i, t in enumerate([t for v in forms.values() for t in v])] + [(100 + i, t) for i, t in enumerate(plain)]
    extra = make(spark, rows + [(0, rows[0][1]), (None, rows[1][1])]).withColumn("kinds", F.lit("x")).withColumn("own", F.lit(1)).withColumn("rid", F.lit(2))
    out = pii.pseudonymise(extra).collect()
    assert len(out) == len(rows) + 2
    got = {x["doc_id"]: x for x in out}
    for i, t in enumerate(plain):
        assert got[100 + i]["text"] == t and got[100 + i]["n_entities"] == 0, got[100 + i]
    k, new = 0, {}
    for kind, ts in forms.items():
        for t in ts:
            x = got[k]["text"]
            new.setdefault(kind, []).append(x.removeprefix("begin ").removesuffix(" end"))
            own = [t[a:b] for a, b, _, _ in pii.find(t)]
            assert own and got[k]["n_entities"] == len(own) and not any(o in x for o in own), (t, x)
            if kind not in ("names", "ip6"):
                assert len(x) == len(f"begin {t} end")
            k += 1
    assert len({re.sub(r"\D", "", x)[-10:] for x in new["phone"]}) == 1 and new["phone"][0].startswith("+1 (")
    assert len({x.replace(" ", "") for x in new["iban"]}) == 1 and all(pii.find(x)[0][2] == "iban" for x in new["iban"])
    assert len({pii._six(x) for x in new["ip6"]}) == 1 and "::" in new["ip6"][1] and len(new["ip6"][2]) == 39
    assert all(pii.luhn(re.sub(r"\D", "", x)) for x in new["card"]) and new["card"][0].replace(" ", "") == new["card"][1].replace("-", "")
    a, b = new["names"][0].split()[1:]
    assert a.lower() in {x.lower() for x in pii.POOLS["given-f:cyrillic"]} and b.lower() in {x.lower() for x in pii.POOLS["family-f:cyrillic"]}
    assert pii.pseudonymise(extra.limit(0)).count() == 0


def test_pii_shapes_grow_where_they_run_out(spark, monkeypatch):
    monkeypatch.setattr(pii, "POOLS", {**pii.POOLS, "family": ("Abel", "Adler")})
    names = sorted({"".join(c) for c in __import__("itertools").product("abc", repeat=3)}) + ["abel", "adler"]
    s = pii.settle(spark.createDataFrame([("family", n) for n in names], "kind string, norm string"), b"k").collect()
    done = {r["norm"]: r["surrogate"] for r in s}
    assert set(done) == set(names) and len(set(done.values())) == len(names) and not set(done.values()) & set(names)


def test_pii_takes_long_entities_whole(spark):
    r = random.Random(31)
    jwt = "".join(r.choice("abcdefghijkXYZ0123456789-_.") for _ in range(300))
    key, local = "".join(r.choice("0123456789abcdef") for _ in range(256)), "".join(r.choice("abcdefgh.") for _ in range(120)) + "z"
    rows = [(1, f"token={jwt} end"), (2, f"token={jwt[:150]}other{jwt[155:]} end"), (3, f"key {key} end"), (4, f"mail {local}@host.example end")]
    got = {x["doc_id"]: x for x in pii.pseudonymise(make(spark, rows)).collect()}
    for i, t in rows:
        assert got[i]["n_entities"] == 1 and len(got[i]["text"]) == len(t)
    assert jwt[128:160] not in got[1]["text"] and jwt[-20:] not in got[1]["text"] and got[1]["text"][6:134] != got[2]["text"][6:134]
    assert re.fullmatch("key [0-9a-f]{256} end", got[3]["text"]) and key[:32] not in got[3]["text"] and key[-32:] not in got[3]["text"]
    assert local[:20] not in got[4]["text"] and got[4]["text"].endswith(".example end")


def test_pii_surrogates_in_every_script(spark):
    odd = ["例え@例え.jp", "名前@例え.jp", "かな@かな.jp", "이름@한국.kr", "שם@דואר.il", "اسم@بريد.sa", "_@_.t", "-@_.t", "ø@ł.no", "пётр@почта.рф"]
    mails = odd + [f"{x}@{y}.t" for x in "abcdefghijklmnopqrstuvwxyz" for y in "abcdefghijklmnopqrstuvwxyz"]
    assert all(pii.find(m) == [(0, len(m), "email", m)] for m in mails)
    done = {r["norm"]: r["surrogate"] for r in pii.settle(spark.createDataFrame([("email", m) for m in mails], "kind string, norm string"), b"k").collect()}
    assert set(done) == set(mails) and len(set(done.values())) == len(mails) and not set(done.values()) & set(mails)
    assert all(pii.find(m) == [(0, len(m), "email", m)] for m in done.values())
    import unicodedata

    for m in odd[:6]:
        assert unicodedata.name(done[m][0]).split()[0] == unicodedata.name(m[0]).split()[0]
    got = pii.pseudonymise(make(spark, [(i, f"to {m} now") for i, m in enumerate(odd)])).collect()
    assert len({x["text"] for x in got}) == len(odd) and all(odd[x["doc_id"]] not in x["text"] and x["n_entities"] == 1 for x in got)


def test_pii_surrogates_are_distinct(spark, monkeypatch):
    rows = [(i, f"Mrs. {''.join(chr(97 + int(c)) for c in str(i)).capitalize()} Stone") for i in range(300)]
    names = [n for _, t in rows for _, _, k, n in pii.find(t) if k == "given-f"]
    done = pii.settle(spark.createDataFrame([("given-f", n) for n in sorted(set(names))], "kind string, norm string"), b"k").collect()
    s = [r["surrogate"] for r in done]
    assert len(set(s)) == len(s) == len(set(names)) and not set(s) & set(names)
    a = {r["doc_id"]: r["text"] for r in pii.pseudonymise(make(spark, rows)).collect()}
    monkeypatch.setattr(pii, "FEW", 1)
    b = {r["doc_id"]: r["text"] for r in pii.pseudonymise(make(spark, rows)).collect()}
    assert a == b and len(set(a.values())) == 300 and any("-" in x for x in s)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(400, 16))
    v[200:260] = v[0]
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)] + [(400, None), (450, [0.0] * 16), (500, [float("nan")] * 16), (550, [None] + [1.0] * 15), (600, [1.0]), (None, [1.0] * 16)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    got = collections.defaultdict(list)
    for x in ann.nearest(e, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 400, 50):
        s = np.round(u @ u[q], 12)
        want = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        hit += len(set(want) & {i for i, _ in got[q]})
        assert len(got[q]) == 5 and all(math.isclose(c, s[i], abs_tol=1e-9) for i, c in got[q])
    assert set(got) == set(range(0, 400, 50)) and hit >= 0.9 * 40
    assert [i for i, _ in got[200]] == [0, 201, 202, 203, 204]
    assert ann.nearest(e.limit(0), lambda i: i % 50 == 0).count() == 0
    few = ann.nearest(e.filter("vec_id in (0, 1, 2)"), lambda i: i % 50 == 0).collect()
    assert sorted(x["vec_id"] for x in few) == [1, 2]


def test_mixing_of_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LOT", 7)
    rows = [(None, "w " * (i % 5), "en", "a", 0) for i in range(300)] + [(7, "x y z", "en", "a", 0) for _ in range(200)] + [(1000 + i, "q " * 9, "en", "b", 0) for i in range(40)]
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    for size, n in (((sum(len(words(r[1])) for r in rows if r[3] == s)), sum(r[3] == s for r in rows)) for s in "ab"):
        own = [x for x in got if x["source_size"] == size]
        assert len(own) == n and abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 2
    turns = mixing.curriculum(d).collect()
    assert sum(x["words"] for x in turns) == sum(x["taken"] for x in got) and [x["position"] for x in turns] == sorted(x["position"] for x in turns)
    assert sum(x["turn"] == 1 for x in turns) == sum(x["repeat_position"] is not None for x in got) > 0
    assert all(x["repeat_position"] > x["position"] for x in got if x["repeat_position"] is not None and x["position"] is not None)


def test_line_dedup_reads_long_texts_in_pieces(spark, monkeypatch):
    r = random.Random(15)
    pool = [f"a line that is shared number {i} é" for i in range(8)] + ["short", "", "\t" + "Long " * 400, " " * 700]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 300)))) for i in range(12)] + [(20 + i, " " * i + "One line only, very long " * 500 + "\t") for i in range(4)] + [(None, "x" * 9000)]
    want = line_reference(rows)
    rb = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows]), pa.array(range(len(rows)))], ["doc_id", "text", "rid"])
    take = lambda: sorted(x for b in line_dedup._line_rows(20)([rb]) for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
    whole = take()
    monkeypatch.setattr(tokens, "BLOCK", 256)
    assert take() == whole
    assert collections.Counter(map(tuple, line_dedup.line_digest(make(spark, rows)).collect())) == want


def test_nearest_neighbours_recall(spark):
    """Recall against all pairs, with a beam of under 5% of the table and vectors without structure."""
    rng = np.random.default_rng(19)
    v = rng.normal(size=(11_000, 32)).astype(np.float32)
    e = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for x in ann.nearest(e, lambda i: i % 500 == 0, beam=500).collect():
        got[x["query_id"]].add(x["vec_id"])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 11_000, 500):
        s = u @ u[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 22 and hits >= 0.9 * 5 * 22, hits


def test_nearest_neighbours_of_hubs_and_repeats(spark, monkeypatch):
    rng = np.random.default_rng(20)
    middle = rng.normal(size=8)
    v = np.concatenate([middle[None], middle + 0.3 * rng.normal(size=(250, 8)), np.repeat(rng.normal(size=(1, 8)), 30, axis=0), -middle + 0.1 * rng.normal(size=(20, 8))])
    rows = [(i, x) for i, x in enumerate(v.tolist())] + [(50, v[0].tolist()), (50, v[50].tolist()), (60, v[60].tolist())]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("raw", F.lit(1)).withColumn("q", F.lit("x"))
    read = lambda: sorted(tuple(r) for r in ann.nearest(e, lambda i: i % 50 == 0).collect())
    whole = read()
    assert len({r[0] for r in whole}) == 7 and all(len({r[2] for r in whole if r[0] == q}) == 5 for q in range(0, 301, 50) if q != 50) and sum(r[0] == 50 for r in whole) == 10 and not any(r[0] == r[2] for r in whole)
    assert next(r for r in whole if r[0] == 0)[2] == 50
    monkeypatch.setattr(ann, "HUB", 7)
    assert read() == whole
    monkeypatch.setattr(ann, "FEW", 1)
    assert read() == whole


def test_token_counts_of_odd_rows(spark):
    rows = [(1, "one two. three"), (1, "one two. three"), (2, "x" * 200_000), (3, "word " * 200_000), (None, "a b"), (4, None), (5, ""), (6, "\n\n\n")]
    d = make(spark, rows).withColumn("n_tokens", F.lit("x")).withColumn("crossing", F.lit(1))
    got = token_counts.section_tokens(d, rule="most", sections=token_counts.sentences).collect()
    assert len(got) == len(rows) and all(sum(x["section_tokens"]) + x["outside"] == x["n_tokens"] for x in got)
    by = collections.defaultdict(list)
    for x in got:
        by[x["doc_id"]].append(x["n_tokens"])
    assert by[1][0] == by[1][1] > 0 and by[3] == [200_001] or by[3][0] >= 200_000
    assert by[4] == by[5] == [0] and token_counts.section_tokens(d.limit(0)).count() == 0
