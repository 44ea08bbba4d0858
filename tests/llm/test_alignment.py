"""Alignment of tokenizers against plain programs."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from snpweave.llm import alignment as al


def _tokens(text):
    """Bytes and ids of both sides, by the libraries that read the files, on the whole text."""
    import sentencepiece
    import tokenizers

    t = tokenizers.Tokenizer.from_file(al.SIDE_A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=al.SIDE_B)
    letters = al._byte_letters()
    a = t.encode(" " + text, add_special_tokens=False).ids
    b = sp.encode(text)
    piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    return [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in a], [(i, piece(sp.id_to_piece(i))) for i in b]


def _plain(texts):
    docs, count = [], Counter()
    for text in texts:
        a, b = _tokens(text) if text else ([], [])
        raw = (" " + text).encode() if text else b""
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a, b = [], []
        ends = lambda side: np.cumsum([len(x) for _, x in side]).tolist()
        ea, eb = ends(a), ends(b)
        both = sorted(set(ea) & set(eb))
        groups, links, i, j = [], [], 0, 0
        for e in both:
            ga, gb = [], []
            while i < len(a) and ea[i] <= e:
                ga.append(a[i][0])
                i += 1
            while j < len(b) and eb[j] <= e:
                gb.append(b[j][0])
                j += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            links.append((ga[-1], gb[-1]))
        count.update(links)
        docs.append((len(a), len(b), groups, links))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(na, nb, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), sha(g)) for na, nb, g, x in docs], count


def _got(spark, texts):
    rows = [(k, x, "y", 0) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, stripe string, n int").repartition(3)
    return [tuple(r)[1:] for r in sorted(al.align_tokenizers(df).collect())]


ODD = [
    None, "", " ", "  two  blanks ", "\n\n", "<|endoftext|> <s>a</s> <0x41> <unk>", "a▁b", "naïve café — “quotes” 語語 語 　 emoji 😀👩‍👩‍👧 ​", "\x00 nul", "tab\tnew\r\nline",
    "it's we'll I'd 'tis", "ﬁ ligature ① ½", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x", "x", "1234567890 12 3.14", "é combining", "عربى עברית ไทย", "a_b __c __ d", " lead", "trail ",
]


def test_plain_program(spark):
    texts = ODD + ["the of and the of and", "und der die das und"] * 3
    assert _got(spark, texts) == _plain(texts)[0]


def test_documents(spark):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    assert _got(spark, texts) == _plain(texts)[0]


def test_pair_counts(spark):
    texts = ["the of and the", "die the und of", "von der of and"]
    got = {(r["a_id"], r["b_id"]): (r["count"], r["best"]) for r in al.pair_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    count = _plain(texts)[1]
    top = {b: max(n for (_, y), n in count.items() if y == b) for _, b in count}
    assert got == {p: (n, n == top[p[1]]) for p, n in count.items()}


def test_long_texts_and_lots(spark, monkeypatch):
    words = "the quick naïve fox's 12 jumps, over_ 'the lazy dogs.\n\n  So it goes"
    texts = [" ".join([words] * 3000), "z" * 70_000, "語" * 40_000, words] + [words[k:] for k in range(40)]
    assert _got(spark, texts) == _plain(texts)[0]


@pytest.mark.parametrize("size", [1, 7, 64])
def test_pieces_give_the_same_tokens(size):
    a, b = al.byte_side(al.SIDE_A), al.piece_side(al.SIDE_B)
    for text in [x for x in ODD if x] + ["Le café est là  où 12 chats — d'accord ? it's a dog's life", "a b  c   d \n e"]:
        parts = list(al.pieces(text, size))
        assert "".join(p for p, _ in parts) == text
        assert sum((a.encode(p if f else " " + p) for p, f in parts), []) == a.encode(" " + text)
        assert sum((b.encode(p[1:] if f else p) for p, f in parts), []) == b.encode(text)


def test_the_faster_library_gives_the_same_tokens():
    fast, own = al.byte_side(al.SIDE_A), al.byte_side(al.SIDE_A, own=False)
    assert (fast.name, own.name) == ("ranks", "file")
    texts = [" ".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000) for lo in [*range(0, 0x3100, 64), *range(0xFB00, 0x10000, 64), *range(0x1F300, 0x1F700, 64)]]
    for text in texts + [x for x in ODD if x]:
        assert fast.encode(text) == own.encode(text)


def test_repeats_ties_and_empty(spark):
    df = spark.createDataFrame([(None, "of the"), (5, "of the"), (5, "of the"), (6, None)], "doc_id long, text string")
    got = al.align_tokenizers(df).collect()
    assert len(got) == 4 and {r["n_best"] for r in got if r["n_a"]} == {2} and {r["count_sum"] for r in got if r["n_a"]} == {6}
    assert al.align_tokenizers(df.limit(0)).count() == 0
