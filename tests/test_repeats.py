"""Simple sequence repeats against a plain search."""

import random

from snpweave.operators import detect


def _plain(seq, units, repeats):
    seq, out = seq.upper(), set()
    for p in range(units[0], units[1] + 1):
        i = 0
        while i + p < len(seq):
            j = i
            while j + p < len(seq) and seq[j] == seq[j + p] and seq[j] in "ACGT":
                j += 1
            n = j - i
            motif = seq[i : i + p]
            if n >= p * (repeats - 1) and n > 0 and not any(p % d == 0 and motif == motif[:d] * (p // d) for d in range(1, p)):
                comp = motif.translate(str.maketrans("ACGT", "TGCA"))[::-1]
                canonical = min(m[k:] + m[:k] for m in (motif, comp) for k in range(p))
                copies = (n + p) // p
                out.add((len(seq), i + 1, i + copies * p, n + p, copies, motif, canonical))
            i = max(j, i + 1)
    return out


def test_runs(spark):
    rng = random.Random(4)
    seqs = ["".join(rng.choice(("A", "C", "AC", "ACG", "TTAGG" * 6, "CA" * 7, "n", "gt" * 5, "AAAAAAAAAA", "ACACGT" * 5)) for _ in range(rng.randrange(25))) for _ in range(60)] + ["", "A", "AC" * 50_000, "ACACACACA", None]
    df = spark.createDataFrame([(f"m{k}", s) for k, s in enumerate(seqs)], "MARKERS string, SEQUENCE string")
    for units, repeats in (((2, 6), 5), ((1, 3), 3), ((2, 2), 2)):
        got = {}
        for r in detect.tandem_repeats(df, units, repeats).collect():
            got.setdefault(r["MARKERS"], set()).add(tuple(r)[1:])
        for k, s in enumerate(seqs):
            assert got.get(f"m{k}", set()) == (_plain(s, units, repeats) if s else set()), (s or "")[:80]


def test_lists(spark):
    df = spark.createDataFrame([("a", "TTTCACACACACA"), ("b", "ACGT"), ("c", None)], "MARKERS string, SEQUENCE string")
    assert {tuple(r) for r in detect.microsatellite_lists(df).collect()} == {("a", 1, 5, "blacklist"), ("b", 0, None, "whitelist"), ("c", 0, None, "whitelist")}


def test_motifs_of_both_strands_are_one(spark):
    df = spark.createDataFrame([("a", "AAG" * 6), ("b", "AGA" * 6), ("c", "CTT" * 6), ("d", "TTC" * 6)], "MARKERS string, SEQUENCE string")
    assert {r["CANONICAL"] for r in detect.tandem_repeats(df).collect()} == {"AAG"}
