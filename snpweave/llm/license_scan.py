"""License scan by ordered signature rules, in DataFrame functions only.

Texts become words (A-Z as a-z; digits, letters and all that is not ASCII).  A cheap substring gate
passes over texts that hold no keyword.  In the rest each keyword occurrence opens a window of as many
words before and after it as the longest rule takes there (``reach``); the rules of that keyword whose
second word stands in the window are tried as regular expressions that must take in the keyword itself, so
a match has an exact word span.
Detections are sorted by start and run through one fold: a detection whose span lies in the span of one
of the same or a better priority is suppressed.  Everything is a projection of a row: no shuffle, no
Python on the executors, memory bounded by one text.

Rules are hand-written signatures of licence bodies and notices (``BODIES``), then families of names, versions and
clauses, each with its priority: 1 a licence with its version or terms, 2 a licence's name, 3 a notice that names none.
A signature may let some words of its own stand between (a holder's name); it spells out how many.

Defined results
* null or empty text: no words, no labels, score 0, null word places.
* null ``doc_id``: scanned like others; repeated rows give repeated results.
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: the phrases of the base scan, and their labels
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WEIGHT = {1: 1.0, 2: 0.8, 3: 0.4}
LICENSE = ("license", "licence")
MARK = "\x01"

_CC_TERMS = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
             "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
_GNU = {"general public": "gpl", "lesser general public": "lgpl", "library general public": "lgpl", "affero general public": "agpl"}
_GNU_VERSIONS = {"gpl": ("1", "2", "3"), "lgpl": ("2", "2 1", "3"), "agpl": ("1", "3")}
#: names before the word license, their label, and the versions they are known in
_NAMED = {
    "mozilla public": ("mpl", ("1 0", "1 1", "2 0")), "eclipse public": ("epl", ("1 0", "2 0")), "eclipse distribution": ("edl", ("1 0",)), "common development and distribution": ("cddl", ("1 0", "1 1")),
    "common public": ("cpl", ("1 0",)), "ibm public": ("ipl", ("1 0",)), "european union public": ("eupl", ("1 1", "1 2")), "artistic": ("artistic", ("1 0", "2 0")), "academic free": ("afl", ("2 1", "3 0")),
    "open software": ("osl", ("2 1", "3 0")), "microsoft public": ("ms-pl", ()), "microsoft reciprocal": ("ms-rl", ()), "apple public source": ("apsl", ("1 2", "2 0")), "sil open font": ("ofl", ("1 0", "1 1")),
    "python software foundation": ("psf", ("2",)), "php": ("php", ("3 0", "3 01")), "ruby": ("ruby", ()), "zlib": ("zlib", ()), "zlib libpng": ("zlib-libpng", ()), "boost software": ("bsl", ("1 0",)), "isc": ("isc", ()),
    "openssl": ("openssl", ()), "postgresql": ("postgresql", ()), "x11": ("x11", ()), "expat": ("mit", ()), "beerware": ("beerware", ()), "open database": ("odbl", ("1 0",)), "open data commons attribution": ("odc-by", ("1 0",)),
    "business source": ("busl", ("1 1",)), "server side public": ("sspl", ("1",)), "elastic": ("elastic", ("2 0",)), "free documentation": ("gfdl", ("1 1", "1 2", "1 3")), "latex project public": ("lppl", ("1 3",)),
    "q public": ("qpl", ("1 0",)), "sun public": ("spl", ("1 0",)), "zope public": ("zpl", ("2 0", "2 1")), "w3c software": ("w3c", ()), "unicode": ("unicode", ()), "vim": ("vim", ()), "curl": ("curl", ()), "ntp": ("ntp", ()),
    "reciprocal public": ("rpl", ("1 5",)), "netscape public": ("npl", ("1 0", "1 1")), "cern open hardware": ("cern-ohl", ("1 2", "2 0")), "mulan permissive software": ("mulanpsl", ("1 0", "2 0")), "university of illinois ncsa open source": ("ncsa", ()),
}
_SPDX = ("mit", "mit-0", "apache-1.1", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd", "isc", "zlib", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only", "gpl-3.0-or-later", "lgpl-2.1-only",
         "lgpl-2.1-or-later", "lgpl-3.0-only", "lgpl-3.0-or-later", "agpl-3.0-only", "agpl-3.0-or-later", "mpl-1.1", "mpl-2.0", "epl-1.0", "epl-2.0", "cddl-1.0", "eupl-1.2", "artistic-2.0", "bsl-1.0", "unlicense", "wtfpl",
         "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "ofl-1.1", "psf-2.0", "ncsa", "postgresql", "x11", "upl-1.0")


_SOME = "(?: [^ ]+)?"
#: fixed values: sentences that stand in the licences themselves, as words: (keyword, another word of it, before the keyword, from the keyword on, label)
BODIES = (
    ("hereby", "charge", "permission is ", " granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("hereby", "charge", "permission is ", " granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "bsl-1.0"),
    ("hereby", "charge", "permission is ", " granted free of charge to any person obtaining a copy of the font software", "ofl-1.1"),
    ("hereby", "fee", "permission to use copy modify (?:and )?(?:or )?distribute this software for any purpose with or without fee is ", " granted", "isc"),
    ("hereby", "agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is ", " granted", "postgresql"),
    ("hereby", "documentation", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and without fee )?is ", " granted", "hpnd"),
    ("redistribution", "binary", "", " and use in source and binary forms with or without modification are permitted", "bsd"),
    ("endorse", "promote", f"neither the names? of{_SOME * 12} may be used to ", " or promote products derived from this software", "bsd-3-clause"),
    ("advertising", "materials", "all ", " materials mentioning features or use of this software must display the following acknowledge?ment", "bsd-4-clause"),
    ("liable", "authors", "in no event will the authors? be held ", " for any damages arising from the use of this software", "zlib"),
    ("unencumbered", "free", "this is free and ", " software released into the public domain", "unlicense"),
    ("license", "verbatim", "everyone is permitted to copy and distribute verbatim or modified copies of this ", " document", "wtfpl"),
    ("license", "compliance", "licensed under the apache license version 2 0 the ", " you may not use this file except in compliance with the license", "apache-2.0"),
    ("evil", "good", "the software shall be used for good not ", "", "json"),
    ("openssl", "developed", "this product includes software developed by the ", " project", "openssl"),
    ("berkeley", "developed", "this product includes software developed by the university of california ", "", "bsd-4-clause-uc"),
    ("licensee", "python", "psf is making python(?: \\d+)?(?: \\d+)?(?: \\d+)? available to ", " on an as is basis", "psf-2"),
    ("dedicated", "deed", "the person who associated a work with this deed has ", " the work to the public domain", "cc0-1.0"),
    ("proprietary", "confidential", "confidential and ", "", "proprietary"),
)


@lru_cache(1)
def rules() -> list[tuple[tuple[str, ...], str, str, str, int]]:
    """(keywords, second word, regex with @ for the keyword, label, priority) in order."""
    out: list[tuple[tuple[str, ...], str, str, str, int]] = []
    for word, second, before, after, label in BODIES:
        out.append(((word,) if word != "license" else LICENSE, second, f"{before}@{after}\\b", label, 1))
    for sid in _SPDX:
        out.append((LICENSE, "identifier", rf"spdx @ identifier {sid.replace('-', ' ').replace('.', ' ')}\b", sid, 1))
    for name, label in _GNU.items():
        for v in _GNU_VERSIONS[label]:
            at = rf"(?:gnu )?\b{name} @ (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?{v}" + ("" if " " in v else "(?: 0)?")
            tag = f"{label}-{v.replace(' ', '.')}"
            out.append((LICENSE, "public", at + r" (?:of the license )?or (?:at your option )?(?:any )?later\b", f"{tag}-or-later", 1))
            out.append((LICENSE, "public", at + r" only\b", f"{tag}-only", 1))
            out.append((LICENSE, "public", at + r"\b", tag, 1))
        out.append((LICENSE, "public", rf"(?:gnu )?\b{name} @\b", label, 2))
    for label, versions in _GNU_VERSIONS.items():
        for v in versions:
            tag, tight = f"{label}-{v.replace(' ', '.')}", v.replace(" ", "")
            out.append(((f"{label}v{tight}",), "", r"@ or later\b|@ plus\b", f"{tag}-or-later", 1))
            out.append(((f"{label}v{tight}",), "", r"@", tag, 1))
            out.append(((label,), "", rf"(?:gnu )?@ (?:version |v ?)?{v}(?: 0)?(?: or (?:any )?later)\b", f"{tag}-or-later", 1))
            out.append(((label,), "", rf"(?:gnu )?@ (?:version |v ?)?{v}(?: 0)?\b", tag, 1))
        out.append(((label,), "", r"(?:gnu )?@", label, 2))
    for short, long in _CC_TERMS.items():
        tag = "cc-" + short.replace(" ", "-")
        for v in _CC_VERSIONS:
            out.append((("cc",), "by", rf"@ {short} (?:v ?)?{v}\b", f"{tag}-{v.replace(' ', '.')}", 1))
            out.append((("commons",), "attribution", rf"creative @ {long} {v}\b", f"{tag}-{v.replace(' ', '.')}", 1))
        out.append((("cc",), "by", rf"@ {short}\b(?! (?:sa|nc|nd)\b)", tag, 1 if short != "by" else 2))
        out.append((("commons",), "attribution", rf"creative @ {long}\b", tag, 2))
    out.append((("cc0",), "", r"@(?: 1 0)?\b", "cc0-1.0", 1))
    out.append((("commons",), "zero", r"creative @ zero\b", "cc0-1.0", 1))
    out.append((("commons",), "public", r"creative @ public domain\b", "cc0-1.0", 2))
    for v in ("1 0", "1 1", "2 0", "2"):
        tag = "apache-" + {"2": "2.0"}.get(v, v.replace(" ", "."))
        out.append((LICENSE, "apache", rf"apache(?: software)? @ (?:version |v ?)?{v}\b", tag, 1))
        out.append((LICENSE, "apache", rf"apache (?:version |v ?)?{v} @\b", tag, 1))
        out.append((("licensed",), "apache", rf"@ under (?:the )?apache (?:version |v ?)?{v}\b", tag, 1))
    out.append((LICENSE, "apache", r"apache(?: software)? @\b", "apache", 2))
    for n, words in (("2", "2 clause|two clause|simplified|freebsd"), ("3", "3 clause|three clause|new|revised|modified"), ("4", "4 clause|four clause|original|old")):
        out.append((LICENSE, "bsd", rf"\b(?:{words}) bsd(?: style)? @\b", f"bsd-{n}-clause", 1))
        out.append((LICENSE, "bsd", rf"bsd (?:{words})(?: style)? @\b", f"bsd-{n}-clause", 1))
        out.append((LICENSE, "bsd", rf"@ bsd (?:{words})\b", f"bsd-{n}-clause", 1))
        out.append((("licensed",), "bsd", rf"@ under (?:the |a )?(?:bsd (?:{words})|(?:{words}) bsd)\b", f"bsd-{n}-clause", 1))
    out.append((LICENSE, "bsd", r"\bbsd(?: style)? @\b", "bsd", 2))
    for verb in ("released", "licensed", "distributed", "available", "published", "covered", "provided", "licenced"):
        out.append((LICENSE, "mit", rf"\b{verb} under (?:the )?(?:terms of the )?mit @\b", "mit", 1))
    out.append((LICENSE, "mit", r"\bmit x11 @\b", "mit", 1))
    out.append((LICENSE, "mit", r"\bthe mit @\b", "mit", 1))
    out.append((LICENSE, "mit", r"\bmit @\b", "mit", 2))
    out.append((("licensed",), "mit", r"@ under (?:the )?mit\b", "mit", 2))
    for name, (label, versions) in _NAMED.items():
        second = name.split()[0]
        for v in versions:
            out.append((LICENSE, second, rf"\b{name} @ (?:version |v ?)?{v}\b", f"{label}-{v.replace(' ', '.')}", 1))
            out.append((LICENSE, second, rf"\b{name} (?:version |v ?)?{v} @\b", f"{label}-{v.replace(' ', '.')}", 1))
        out.append((LICENSE, second, rf"\b{name} @\b", label, 2))
    for words, label in ((("unlicense",), "unlicense"), (("wtfpl",), "wtfpl"), (("copyleft",), "copyleft")):
        out.append((words, "", r"(?:the )?@\b", label, 2))
    out.append((LICENSE, "public", r"do what the f\w+ you want to public @\b", "wtfpl", 1))
    out.append((("domain",), "public", r"\b(?:released|placed|dedicated) (?:in|into|to) the public @\b", "public-domain", 1))
    out.append((LICENSE, "proprietary", r"\bproprietary @\b", "proprietary", 2))
    out.append((LICENSE, "commercial", r"\bcommercial @\b", "commercial", 2))
    out.append((("copyright",), "", r"@ (?:c )?(?:19|20)\d\d\b", "copyright-notice", 3))
    out.append((("rights",), "reserved", r"\ball @ reserved\b", "all-rights-reserved", 3))
    out.append((("licensed", "licenced"), "under", r"@ under\b", "license-notice", 3))
    out.append((LICENSE, "terms", r"\bterms of (?:the |this )@\b", "license-notice", 3))
    out.append((LICENSE, "see", r"\bsee (?:the )?@(?: file)?\b", "license-reference", 3))
    return out


@lru_cache(1)
def keywords() -> dict[str, list[tuple[int, str, str, str, int]]]:
    """The rules of each keyword: (order, second word, regex, label, priority)."""
    out: dict[str, list[tuple[int, str, str, str, int]]] = {}
    for order, (words, second, regex, label, priority) in enumerate(rules()):
        for w in words:
            out.setdefault(w, []).append((order, second, regex.replace("@", MARK + w), label, priority))
    return out


@lru_cache(1)
def reach() -> tuple[int, int]:
    """The most words that a rule takes before and after its keyword: a regex matches no more spaces than it has, as none of them repeats."""
    sides = [r[2].split("@", 1) for r in rules()]
    return max(a.count(" ") for a, _ in sides), max(b.count(" ") for _, b in sides)


def gate(text: Column) -> Column:
    """Whether a text can hold a keyword or a phrase; true for every text that does."""
    t = F.lower(text)
    has = lambda w: t.contains(w)
    stems = ("licen", "gpl", "copyright", "copyleft", "wtfpl", "cc0", "hereby", "redistribution", "unencumbered")
    out = (has("cc") & has("by")) | (has("commons") & has("creative")) | (has("rights") & has("reserved")) | (has("public") & has("domain"))
    out = out | (has("endorse") & has("promote")) | (has("advertising") & has("materials")) | (has("liable") & has("authors")) | (has("evil") & has("good")) | ((has("openssl") | has("berkeley")) & has("developed")) | (has("dedicated") & has("deed")) | (has("proprietary") & has("confidential"))
    for w in stems:
        out = out | has(w)
    return out


def _lit_rules() -> Column:
    def row(r):
        return F.struct(F.lit(r[0]).alias("ord"), F.lit(r[1]).alias("second"), F.lit(r[2]).alias("regex"), F.lit(r[3]).alias("label"), F.lit(r[4]).alias("prio"))

    pairs: list[Column] = []
    for w, rs in keywords().items():
        pairs += [F.lit(w), F.array(*[row(r) for r in rs])]
    return F.create_map(*pairs)


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.translate(s, " ", ""))


def _detections(words: Column, at: Column, table: Column) -> Column:
    """Of each keyword place, the rules that match there: (start, -end, priority, order, label)."""

    before, after = reach()

    def here(i):
        w = F.get(words, i)
        low = F.greatest(i - before, F.lit(0))
        head = F.array_join(F.slice(words, low + 1, i - low), " ")
        tail = F.array_join(F.slice(words, i + 2, F.lit(after)), " ")
        window = F.concat(head, F.when(F.length(head) > 0, F.lit(" ")).otherwise(F.lit("")), F.lit(MARK), w, F.when(F.length(tail) > 0, F.lit(" ")).otherwise(F.lit("")), tail)
        near = F.filter(F.element_at(table, w), lambda r: window.contains(r["second"]))
        hits = F.transform(near, lambda r: F.struct(r["ord"].alias("ord"), r["label"].alias("label"), r["prio"].alias("prio"), F.call_function("regexp_extract", window, r["regex"], F.lit(0)).alias("m")))
        hits = F.filter(hits, lambda h: h["m"] != "")

        def span(h):
            start = i - _spaces(F.substring_index(h["m"], MARK, 1))
            end = start + _spaces(h["m"])
            return F.struct(start.alias("start"), (-end).alias("back"), h["prio"].alias("prio"), h["ord"].alias("ord"), h["label"].alias("label"))

        return F.transform(hits, span)

    return F.flatten(F.transform(at, here))


def _resolve(found: Column) -> Column:
    """Fold sorted detections: labels of those that no span of the same or a better priority covers, and the best weight."""
    zero = F.struct(*[F.lit(-1).alias(f"m{p}") for p in (1, 2, 3)], F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("best"))

    def step(s, d):
        end = -d["back"]
        tops = F.when(d["prio"] == 1, s["m1"]).when(d["prio"] == 2, F.greatest(s["m1"], s["m2"])).otherwise(F.greatest(s["m1"], s["m2"], s["m3"]))
        covered = tops >= end
        weight = F.when(d["prio"] == 1, F.lit(WEIGHT[1])).when(d["prio"] == 2, F.lit(WEIGHT[2])).otherwise(F.lit(WEIGHT[3]))
        m = [F.when(d["prio"] == p, F.greatest(s[f"m{p}"], end)).otherwise(s[f"m{p}"]).alias(f"m{p}") for p in (1, 2, 3)]
        labels = F.when(covered, s["labels"]).otherwise(F.array_union(s["labels"], F.array(d["label"])))
        return F.struct(*m, labels.alias("labels"), F.when(covered, s["best"]).otherwise(F.greatest(s["best"], weight)).alias("best"))

    return F.aggregate(F.array_sort(found), zero, step)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("n_words", F.regexp_count("text", F.lit(WORD_ANY_CASE)).cast("long"))
    words = F.when(gate(F.col("text")), F.call_function("regexp_extract_all", F.translate("text", upper, upper.lower()), F.lit(WORD), F.lit(0)))
    d = d.select("doc_id", "n_words", words.alias("words"))
    known = [F.lit(w) for w in keywords()]
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*known), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    d = d.withColumn("at", F.coalesce(places, F.array().cast("array<int>")))

    def starts(phrase: str, label: str) -> Column:
        parts = phrase.split()
        k = next(i for i, w in enumerate(parts) if w in keywords())
        own = F.filter("at", lambda i: (i >= k) & (F.slice("words", F.greatest(i - k + 1, F.lit(1)), F.lit(len(parts))) == F.array(*[F.lit(w) for w in parts])))
        return F.transform(own, lambda i: F.struct((i - k).alias("start"), F.lit(label).alias("label")))

    base = F.concat(*[starts(p, x) for p, x in BASE.items()])
    d = d.withColumn("base", base).withColumn("got", _resolve(_detections(F.col("words"), F.col("at"), _lit_rules())))
    own = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    first, last = (f(F.transform("base", lambda b: b["start"])).cast("long") for f in (F.array_min, F.array_max))
    n = F.size("base").cast("long")
    return d.select("doc_id", "n_words", n.alias("n_base"), first.alias("first_word"), last.alias("last_word"), F.array_join(own, ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union(own, F.col("got.labels"))), ",").alias("labels"), F.when(n > 0, F.lit(1.0)).otherwise(F.col("got.best")).alias("score"))
