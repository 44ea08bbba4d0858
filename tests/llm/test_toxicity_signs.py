"""Signs between words do not keep them from being read."""

import pytest

from snpweave.llm import toxicity

WORDS = ["stupid", "idiot", "moron", "loser", "trash"]


@pytest.fixture(scope="module")
def read(spark):
    """Readings of tokens under a model of ordinary words."""
    base = [(i, " ".join(["you are a stupid idiot and a moron", "what a loser", "this is trash now", "the weather is fine today and we walk"] * 20)) for i in range(20)]

    def run(tokens):
        rows = base + [(100 + k, f"well {t} there") for k, t in enumerate(tokens)]
        got = {r["doc_id"]: r["text"] for r in toxicity.restore(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        return [got[100 + k].removeprefix("well ").removesuffix(" there") for k in range(len(tokens))]

    return run


def test_parts_are_read(read):
    tokens = ["st4p1d.1d10t", "you=1d10t", "1d10t/m0r0n", "5tup1d:1d10t", "you-1d10t-now", 'a="m0r0n"', "l0s3r,tr4sh", "1d10t"]
    want = [None, "you=idiot", "idiot/moron", "stupid:idiot", "you-idiot-now", 'a="moron"', "loser,trash", "idiot"]
    got = read(tokens)
    assert got[0].endswith(".idiot")
    for t, w, g in zip(tokens, want, got, strict=True):
        assert w is None or g == w, (t, g)


def test_letters_set_apart_by_any_sign(read):
    assert read(["i,d,i,o,t", "i/d/i/o/t", "i|d|i|o|t", "i.d.i.o.t", "i:d:i:o:t", "m;o;r;o;n"]) == ["idiot"] * 5 + ["moron"]


def test_what_only_looks_like_it_stays(read):
    plain = ["u34@mail7.example.com", "and/or", "12:30:45", "2020-01-02", "3.14", "a.b", "http://example.com/page", "e.g.", "well-known"]
    assert read(plain) == plain
