"""Personal data: keyed surrogates that keep kind, gender, script and format.

Entities are e-mail and IP addresses (both versions), phone and card numbers, account numbers (IBAN), social security
numbers, secrets, and names after a form of address or "my name is" in Latin, Cyrillic and Greek letters.  A keyed hash
(BLAKE2 under ``key``) of an entity's normal form chooses its surrogate: digits for digits, letters for letters of the
same script and case, valid check digits where the original has them, a given name of the same gender and script.  The
normal form carries coreference: a phone number in two formats, with its country code +1 or without, an address of the
sixth version in full or short, or a name in two documents, gets one surrogate.  A name's gender is the one its forms of
address have over the whole corpus (none, where they differ), so "Mrs. Anna" and "my name is Anna" are one.

A name is one to four words (with inner capitals, hyphens, apostrophes, particles and initials between) after a form of
address, with or without an academic one; the last is the family's.  Where it stands again in its document without one, it goes too.
Phone numbers have a grammar of their own and are looked for where no address, date, card or account number stands.

Distinctness is checked over the whole corpus: distinct entities are aggregated (combined on the map side),
surrogates that two entities share, or that are an entity themselves, are found by an aggregate and a join, and all but
one of the entities try again until no collision is left; later rounds look at what the last one changed.  Surrogates
grow with the tries (e-mail addresses and secrets by a letter from the second, names by a further name from the first,
numbers by a digit from the twelfth), so no shape can run out.  Entities that needed another try are few; up to ``FEW``
of them (a counted bound) go to the tasks, more than that are joined by document.

Defined results
* null text stays null, with no entities; empty text stays empty.
* null ``doc_id``: treated like others.  Repeated rows get the same surrogates.
* overlapping finds: the earlier, then the longer, then the order in which ``find`` looks for kinds.
* a number of 13 to 19 digits is a card only with a valid check digit, an account only with valid check digits.
* a value after ``password=`` and the like, also with words before or after it (``DB_PASSWORD``, ``secret_key``), is a secret if it holds a digit, is quoted, follows ``=``, or mixes cases.
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop_stage, stage

FEW = 50_000
FEMALE = ("Alice", "Anna", "Carla", "Clara", "Diana", "Elena", "Emma", "Eva", "Greta", "Hanna", "Ida", "Irene", "Julia", "Laura", "Lena", "Lucia", "Maria", "Marta", "Nina", "Olga", "Paula", "Rosa", "Sara", "Sofia", "Vera")
MALE = ("Adam", "Albert", "Anton", "Bruno", "Carl", "David", "Emil", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jan", "Karl", "Leo", "Lukas", "Marco", "Martin", "Max", "Oscar", "Paul", "Peter", "Robert", "Simon", "Victor")
FAMILY = ("Abel", "Adler", "Baker", "Bauer", "Castro", "Cole", "Dumas", "Ellis", "Fischer", "Garcia", "Hall", "Keller", "Lang", "Lopez", "Marsh", "Meyer", "Moreau", "Novak", "Petit", "Reyes", "Rossi", "Silva", "Stone", "Weber", "Wood")
_GIVEN_STEMS = ("Adel", "Albert", "Anton", "Bern", "Carl", "Christ", "Dor", "Ern", "Flor", "Franc", "Georg", "Henri", "Jos", "Just", "Laur", "Leon", "Luc", "Magn", "Mart", "Nicol", "Paul", "Ros", "Silv", "Valent", "Vict", "Wilhelm")
_FAMILY_STEMS = ("Ander", "Berg", "Brand", "Carl", "Dahl", "Eck", "Fried", "Gold", "Hart", "Holm", "Kirch", "Lind", "Mark", "Nord", "Ost", "Peter", "Rich", "Sand", "Stein", "Thor", "Wald", "West", "Win")
_CYRILLIC = ("Абрам", "Белоус", "Владимир", "Гаврил", "Данил", "Егор", "Захар", "Иван", "Кирилл", "Лаврент", "Матве", "Назар", "Осип", "Павл", "Роман", "Семён", "Тимоф", "Фёдор", "Харитон", "Яковл")
_GREEK = ("Αγγελ", "Βασιλ", "Γεωργ", "Δημητρ", "Ευαγγελ", "Ζαχαρ", "Θεοδωρ", "Ιωανν", "Κωνσταντιν", "Λεωνιδ", "Μιχαλ", "Νικολ", "Παναγιωτ", "Σταυρ", "Χριστ")


def _made(stems, ends):
    return tuple(x + y for x in stems for y in ends)


#: names by kind and script
POOLS = {
    "given-f": FEMALE + _made(_GIVEN_STEMS, ("a", "ina", "ella", "etta", "iana")), "given-m": MALE + _made(_GIVEN_STEMS, ("o", "us", "in", "ian", "el")), "family": FAMILY + _made(_FAMILY_STEMS, ("er", "mann", "son", "ley", "ford", "ström", "ini", "eau")),
    "given-f:cyrillic": ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Тамара", "Ульяна", "Юлия"), "given-m:cyrillic": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Евгений", "Игорь", "Лев", "Максим", "Никита", "Олег", "Пётр", "Руслан", "Сергей", "Тарас", "Юрий"),
    "family-m:cyrillic": _made(_CYRILLIC, ("ов", "ин", "енко", "ский")), "family-f:cyrillic": _made(_CYRILLIC, ("ова", "ина", "енко", "ская")),
    "given-f:greek": ("Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Θάλεια", "Ιωάννα", "Κατερίνα", "Λυδία", "Μαρία", "Νίκη", "Σοφία"), "given-m:greek": ("Ανδρέας", "Βασίλης", "Γιάννης", "Δημήτρης", "Ηλίας", "Κώστας", "Λευτέρης", "Μιχάλης", "Νίκος", "Πέτρος", "Στέλιος"),
    "family-m:greek": _made(_GREEK, ("όπουλος", "άκης", "ίδης")), "family-f:greek": _made(_GREEK, ("οπούλου", "άκη", "ίδου")),
}
POOLS["given"] = POOLS["given-f"] + POOLS["given-m"]
TITLES = {"Mr": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f"}
TITLES_CYRILLIC = {"господин": "m", "Господин": "m", "г-н": "m", "госпожа": "f", "Госпожа": "f", "г-жа": "f"}
TITLES_GREEK = {"κύριος": "m", "Κύριος": "m", "κύριο": "m", "κυρία": "f", "Κυρία": "f"}
_SAID = ("[Mm]y name is", "[Mm]ein Name ist", "[Ii]ch heiße", "[Jj]e m'appelle", "[Mm]on nom est", "[Mm]e llamo", "[Mm]i nombre es")


#: academic forms of address; they tell no gender
_LEARNED = ("Dr", "Prof", "Professor", "Doctor")


def _any(titles) -> str:
    return "|".join(sorted(titles, key=len, reverse=True))


def _named(lead: str, first: str, letters: str, mark: str = r"\.?"):
    """A form of address and up to four words of a name; initials, particles and academic titles may stand between."""
    word = rf"[{first}](?:[{letters}]|['’\-](?=[{letters}]))*(?![{letters}])"
    between = r"(?:[A-Z]\. |(?:van|von|de|der|den|di|da|du|del|la|le|zu|bin|ter) )*"
    return re.compile(rf"(?<!\w)(?P<lead>{lead}){mark} (?:(?:{'|'.join(_LEARNED)})\.? )*{between}(?P<name>{word}(?: {between}{word}){{0,3}})"), re.compile(rf"(?<![{letters}]){word}(?!\.)")


_LATIN, _KYR, _HEL = ("A-ZÀ-ÖØ-Þ", "A-Za-zÀ-ÖØ-öø-ÿ"), ("А-ЯЁ", "А-Яа-яЁё"), ("Α-ΫΆΈ-Ώ", "Α-Ωά-ώΆΈ-Ώϊϋΐΰ")
_LOUD = {t.upper(): g for t, g in TITLES.items() if t in ("Mr", "Mrs", "Ms")} | {"DR": "", "PROF": ""}
TITLES |= dict.fromkeys(_LEARNED, "")
_NAMES = ((*_named(_any(TITLES), *_LATIN), TITLES, ""), (*_named(_any(_LOUD), *_LATIN, r"\."), _LOUD, ""), (*_named(_any(TITLES_CYRILLIC), *_KYR), TITLES_CYRILLIC, ":cyrillic"), (*_named(_any(TITLES_GREEK), *_HEL), TITLES_GREEK, ":greek"))
_SAYS = _named("|".join(_SAID), *_LATIN, "")
_SECRET_WORDS = r"token|secret|password|passwd|passphrase|api[_\-]?key|access[_\-]?key|private[_\-]?key"
_KEY = rf"(?i:{_SECRET_WORDS})(?:[_\-][A-Za-z0-9]+)*[\"']?\s*"
_GATE = "@|[0-9]|" + "|".join(rf"{t}\.? (?:[a-z]{{1,4}} ){{0,3}}[A-ZÀ-Þ]" for t in TITLES) + "|" + "|".join(rf"{t}\. [A-ZÀ-Þ]" for t in _LOUD) + "|" + "|".join((*TITLES_CYRILLIC, *TITLES_GREEK, *_SAID)) + f"|{_KEY}[=:]|(?i:bearer)\\s+\\S|::|[0-9a-fA-F]:[0-9a-fA-F]"
_RIGHT = re.compile(r"[\w\-]+(?:\.[\w\-]+)+")
_IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
#: a number of the ten-digit plan with its country code; an international one; one with its area in brackets; three groups
_PHONE = re.compile(
    r"\+1[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|\+\d{1,3}(?:[ .\-]?\(\d{1,5}\))?(?:[ .\-]?\d{1,12}){1,6}(?!\d)"
    r"|(?<![\d.])(?:1[ .\-])?\(\d{3}\)[ .\-]?\d{3,4}[ .\-]?\d{4}(?!\d)|\(\d{2,5}\)(?:[ .\-]?\d{2,8}){1,4}(?!\d)|(?<![\w.+(])(?:1[ .\-])?\d{3}[ .\-]\d{3,4}[ .\-]\d{4}(?!\d)"
)
_DATE = re.compile(r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?!\d)")
_CARD = re.compile(r"(?<!\d)(?<!\d[\-.])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_HEX = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
_SECRET = re.compile(rf"(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z])){_KEY}([=:])\s*([\"']?)([^\s\"',;]{{6,}})")
#: fixed values: how tokens of well-known kinds begin
_TOKEN = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|sk-[A-Za-z0-9\-_]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|eyJ[\w\-]{8,}(?:\.[\w\-]+)+)|(?i:(?<!\w)bearer\s+)([A-Za-z0-9\-._~+/]{16,}=*)")


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits[::-1]]
    return sum(d[::2]) % 10 == 0 if len(d) == 1 else (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def iban_check(body: str) -> str:
    """The two check digits of an account number (country, then the rest without them)."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body[2:] + body[:2] + '00')) % 97:02d}"


def _six(found: str) -> str | None:
    """The full form of an address of the sixth version; none for times, code and the like."""
    groups = [x for x in found.split(":") if x]
    if len(groups) < 3 or not any(c.isdigit() for c in found):
        return None
    try:
        return ipaddress.IPv6Address(found).exploded
    except ValueError:
        return None


def _is_secret(sign: str, quote: str, value: str) -> bool:
    if any(c.isdigit() for c in value) or quote or sign == "=":
        return True
    return value.isalpha() and value != value.lower() and value != value.upper() and value[1:] != value[1:].lower()


_CAPITAL = re.compile(r"(?<!\w)[^\W\d_](?:[^\W\d_]|['’\-](?=[^\W\d_]))*")


def base(kind: str) -> str:
    """``name`` and the script for names, given or the family's; other kinds as they are."""
    return re.sub(r"^(?:given|family)(?:-[fm])?", "name", kind)


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities of a text, in order and without overlaps."""
    out = []
    at = text.find("@")
    while at >= 0:
        a, right = at, _RIGHT.match(text, at + 1)
        while right and a and (text[a - 1].isalnum() or text[a - 1] in "_.+-"):
            a -= 1
        if a < at:
            b = right.end()
            out.append((a, b, "email", text[a:b].lower()))
        at = text.find("@", at + 1)
    for m in _SECRET.finditer(text):
        if _is_secret(m[1], m[2], m[3]):
            out.append((m.start(3), m.end(3), "secret", m[3]))
    for m in _TOKEN.finditer(text):
        if not m[1] or any(c.isdigit() for c in m[1]):
            out.append((m.start(m.lastindex or 0), m.end(m.lastindex or 0), "secret", m[m.lastindex or 0]))
    if ":" in text:
        for m in _IP6.finditer(text):
            if (norm := _six(m[0])) is not None:
                out.append((m.start(), m.end(), "ip6", norm))
    if any(c in text for c in "0123456789"):
        for m in _HEX.finditer(text):
            if any(c.isdigit() for c in m[0]) and not (text[m.start() - 1 : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum()):
                out.append((m.start(), m.end(), "secret", m[0]))
        for m in _IBAN.finditer(text):
            norm = m[0].replace(" ", "")
            if len(norm) >= 15 and iban_check(norm[:2] + norm[4:]) == norm[2:4]:
                out.append((m.start(), m.end(), "iban", norm))
        free = lambda m: not (text[max(0, m.start() - 1) : m.start()].isdigit() or text[m.end() : m.end() + 1].isdigit())
        for m in _IP.finditer(text):
            if free(m) and all(int(x) < 256 for x in m[0].split(".")):
                out.append((m.start(), m.end(), "ip", m[0]))
        for m in _SSN.finditer(text):
            if free(m):
                out.append((m.start(), m.end(), "ssn", m[0].replace("-", "")))
        for m in _CARD.finditer(text):
            norm = re.sub(r"\D", "", m[0])
            if luhn(norm) and not text[max(0, m.start() - 1) : m.start()].isalpha():
                out.append((m.start(), m.end(), "card", norm))
        bare, at = [], 0  # phone numbers stand where nothing else does
        for x, y in sorted([(o[0], o[1]) for o in out] + [m.span() for m in _DATE.finditer(text)]):
            if y > at:
                bare += [text[at : max(at, x)], "\0" * (y - max(at, x))]
                at = y
        for m in _PHONE.finditer("".join([*bare, text[at:]])):
            digits = re.sub(r"\D", "", m[0])
            if 8 <= len(digits) <= 15 and free(m) and not text[max(0, m.start() - 1) : m.start()].isalpha():
                # the country code of ten-digit plans is no part of the number's identity
                out.append((m.start(), m.end(), "phone", digits[1:] if len(digits) == 11 and digits[0] == "1" else digits))
    said: dict[str, tuple[str, str]] = {}
    for pattern, word, titles, script in ((*_NAMES[0], ), *_NAMES[1:], (*_SAYS, None, "")):
        for m in pattern.finditer(text):
            g = titles[m["lead"]] if titles else ""
            parts = list(word.finditer(text, m.start("name"), m.end("name")))
            for k, w in enumerate(parts):
                x = re.sub(r"['’]s$", "", w[0])
                family = k == len(parts) - 1 and (len(parts) > 1 or titles is not None)
                kind = f"family-{g or 'm'}{script}" if family and script else "family" if family else f"given{f'-{g}' if g else ''}{script}" if f"given{f'-{g}' if g else ''}{script}" in POOLS else f"given-f{script}"
                out.append((w.start(), w.start() + len(x), kind, x.lower()))
                if len(x) > 2:
                    said.setdefault(x, (kind, x.lower()))
    for m in _CAPITAL.finditer(text) if said else ():
        x = re.sub(r"['’]s$", "", m[0])
        if x in said:
            out.append((m.start(), m.start() + len(x), *said[x]))
    out.sort(key=lambda x: (x[0], -x[1]))
    kept, end = [], -1
    for x in out:
        if x[0] >= end:
            kept.append(x)
            end = x[1]
    return kept


@lru_cache(4096)
def _akin(c: str) -> str:
    """The letters (or numerals) around ``c`` of its script, category and case; ``c`` itself where it has no kin."""
    script = lambda x: unicodedata.name(x, "").split(" ")[0]
    near = (chr(i) for i in range(ord(c) & ~255, (ord(c) & ~255) + 256))
    kin = [x for x in near if unicodedata.category(x) == unicodedata.category(c) and script(x) == script(c) and (x.lower() == x) == (c.lower() == c) and len(x.upper()) == 1 and unicodedata.normalize("NFKC", x) == x]
    return "".join(kin) or c


class Keyed:
    """Surrogates of normal forms under a key."""

    def __init__(self, key: bytes):
        self.key = key

    def _stream(self, kind: str, norm: str, attempt: int):
        n = 0
        while True:
            for b in hashlib.blake2b(f"{kind}|{norm}|{attempt}|{n}".encode(), key=self.key[:64]).digest():
                yield b
            n += 1

    def _like(self, c: str, b: int) -> str:
        if c.isdigit():
            return str(b % 10)
        for lo, hi in (("a", "z"), ("A", "Z"), ("à", "ö"), ("α", "ω"), ("а", "я"), ("А", "Я")):
            if lo <= c <= hi:
                return chr(ord(lo) + b % (ord(hi) - ord(lo) + 1))
        if c.isalnum():
            kin = _akin(c)
            return kin[b % len(kin)]
        return c

    def _more(self, text: str, n: int, s) -> str:
        """``n`` letters like the last letter of ``text`` that has kin."""
        like = next((c for c in reversed(text) if c.isalpha() and (c.isascii() or len(_akin(c)) > 1)), "a")
        return "".join(self._like(like, next(s)) for _ in range(n))

    def surrogate(self, kind: str, norm: str, attempt: int = 0) -> str:
        """In the normal form's own shape."""
        s, more = self._stream(base(kind), norm, attempt), max(0, attempt - 1)
        digits = lambda n: "".join(str(next(s) % 10) for _ in range(n))
        late = max(0, attempt - 11)
        if kind == "ip":
            return ".".join(str(1 + next(s) % 254) for _ in range(4)) + (f":{digits(late)}" if late else "")
        if kind == "ip6":
            return ":".join("0000" if g == "0000" else "".join(("123456789abcdef" if i == 0 else "0123456789abcdef")[next(s) % (15 if i == 0 else 16)] if c != "0" or g[:i].strip("0") else "0" for i, c in enumerate(g)) for g in norm.split(":")) + (f":{digits(late)}" if late else "")
        if kind == "email":
            local, _, host = norm.rpartition("@")
            name, dot, top = host.rpartition(".")
            return "".join(self._like(c, next(s)) for c in local) + self._more(local, more, s) + "@" + "".join(self._like(c, next(s)) for c in name) + dot + top
        if kind == "secret":
            hexa = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", norm)
            if hexa:
                signs = "0123456789ABCDEF" if norm.upper() == norm else "0123456789abcdef"
                return "".join(signs[next(s) % 16] for _ in range(len(norm) + more))
            return "".join(self._like(c, next(s)) for c in norm) + self._more(norm, more, s)
        if kind == "iban":
            body = norm[:2] + "".join(self._like(c, next(s)) for c in norm[4:]) + digits(late)
            return body[:2] + iban_check(body) + body[2:]
        if kind in ("card", "phone", "ssn"):
            keep = 1 if kind != "ssn" else 0
            d = norm[:keep] + digits(len(norm) - keep + late)
            if kind == "card":
                d = next(x for x in (d[:-1] + str(i) for i in range(10)) if luhn(x))
            return d
        pool = POOLS[kind]
        # the pool is bounded: each further try adds a name by a hyphen
        chosen = [(next(s) * 65536 + next(s) * 256 + next(s)) % len(pool) for _ in range(1 + attempt)]
        # a name never stands for itself, alone or as a part
        return "-".join(pool[(i + 1) % len(pool)] if pool[i].lower() in norm.split("-") else pool[i] for i in chosen).lower()

    def dress(self, kind: str, found: str, plain: str) -> str:
        """A surrogate in the format in which the entity stands in the text."""
        if kind in ("card", "phone", "ssn", "iban"):
            room = sum(c.isalnum() for c in found) - len(plain)
            it, lead = iter(plain), room
            out = []
            for c in found:
                if not c.isalnum():
                    out.append(c)
                elif lead > 0:  # a country code that is no part of the normal form
                    out.append(c)
                    lead -= 1
                else:
                    out.append(next(it))
            return "".join([*out, *it])
        if kind == "ip6":
            if len(plain) > 39:
                return plain
            address = ipaddress.IPv6Address(plain)
            same = plain if len(found) == 39 else address.compressed if "::" in found else ":".join(g.lstrip("0") or "0" for g in plain.split(":"))
            return same.upper() if found.upper() == found else same
        if kind == "email":
            return "".join(p.upper() if c.isupper() else p for c, p in zip(found, plain, strict=True)) if len(found) == len(plain) else plain
        if kind.split(":")[0].split("-")[0] in ("given", "family"):
            return plain.upper() if found.isupper() else "-".join(x.capitalize() for x in plain.split("-"))
        return plain


def _entities(batches):
    for rb in batches:
        seen = set()
        for text in rb.column(0).filter(pc.match_substring_regex(rb.column(0), _GATE)).to_pylist():
            seen.update((k, n) for _, _, k, n in find(text))
        rows = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["kind", "norm"])


def _tries(key: bytes):
    def run(batches):
        k = Keyed(key)
        for rb in batches:
            s = [k.surrogate(form, norm, attempt) for form, norm, attempt in zip(*(rb.column(c).to_pylist() for c in ("form", "norm", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(s, pa.string())], [*rb.schema.names, "surrogate"])

    return run


def named_once(entities: DataFrame) -> DataFrame:
    """(kind, norm, form, mixed) of distinct entities: a name has one kind, and one form (its pool) from all its mentions.

    It is a given name if it is one anywhere, of the gender its forms of address agree on.  ``mixed`` names were mentioned in more
    than one way, so their surrogate does not follow from one mention.
    """
    is_name = F.col("kind").rlike("^(given|family)")
    script = F.regexp_extract("kind", "(:.*)?$", 1)
    own = entities.withColumn("base", F.when(is_name, F.concat(F.lit("name"), script)).otherwise(F.col("kind")))
    any_ = lambda pattern: F.max(F.col("kind").rlike(pattern))
    x = own.groupBy("base", "norm").agg(any_("^given").alias("given"), any_("^(given|family)-f").alias("f"), any_("^(given|family)-m").alias("m"), F.count_distinct("kind").alias("n"), F.min("kind").alias("only"))
    gender = F.when(F.col("f") & ~F.col("m"), "-f").when(F.col("m") & ~F.col("f"), "-m").otherwise(F.when(F.col("base").contains(":"), "-f").otherwise(""))
    gender = F.when(F.col("given") | F.col("base").contains(":"), gender).otherwise("")
    form = F.concat(F.when(F.col("given"), "given").otherwise("family"), gender, F.regexp_replace("base", "^name", ""))
    return x.select(F.col("base").alias("kind"), "norm", F.when(F.col("n") > 1, form).otherwise(F.col("only")).alias("form"), (F.col("n") > 1).alias("mixed"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def settle(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, form, mixed, attempt, surrogate) of distinct entities, with surrogates that no two share and that are no entity."""
    schema = "kind string, norm string, form string, mixed boolean, attempt int, surrogate string"
    if "form" not in entities.columns:
        entities = entities.select("kind", "norm", F.col("kind").alias("form"), F.lit(False).alias("mixed"))
    cur = stage(entities.select("kind", "norm", "form", "mixed", F.lit(0).alias("attempt")).mapInArrow(_tries(key), schema), "surrogates")
    new, first = cur, True
    while True:
        # after the first round only surrogates that the last one made can collide
        pool = cur if first else cur.join(_few(new.select("kind", "surrogate").distinct()), ["kind", "surrogate"], "left_semi")
        shared = pool.groupBy("kind", "surrogate").agg(F.min("norm").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        lost = pool.join(shared, ["kind", "surrogate"]).filter("norm <> owner").select("kind", "norm")
        real = new.select("kind", "surrogate", "norm").join(cur.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "norm")
        again = stage(lost.unionByName(real).distinct(), "again")
        if again.limit(1).count() == 0:
            drop_stage(again)
            return cur
        few = _few(again)
        fresh = stage(cur.join(few, ["kind", "norm"], "left_semi").select("kind", "norm", "form", "mixed", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_tries(key), schema), "fresh")
        old = cur
        cur = stage(cur.join(few, ["kind", "norm"], "left_anti").unionByName(fresh), "surrogates")
        drop_stage(old, again, *([] if first else [new]))
        new, first = fresh, False


_OUT = "doc_id long, n_entities long, kinds string, text string"


def _replace(key: bytes, few, joined: bool):
    def run(batches):
        k, known = Keyed(key), few.value if few is not None else {}
        for rb in batches:
            texts = rb.column(1).to_pylist()
            gate = np.asarray(pc.fill_null(pc.match_substring_regex(rb.column(1), _GATE), False))
            own = rb.column(2).to_pylist() if joined else [None] * len(texts)
            counts, kinds = [0] * len(texts), [""] * len(texts)
            for i in np.flatnonzero(gate):
                found = find(texts[i])
                if not found:
                    continue
                more = {(x["kind"], x["norm"]): x["surrogate"] for x in own[i] or ()}
                parts, at = [], 0
                for a, b, kind, norm in found:
                    one = (base(kind), norm)
                    plain = more.get(one) or known.get(one) or k.surrogate(kind, norm)
                    parts += [texts[i][at:a], k.dress(kind, texts[i][a:b], plain)]
                    at = b
                texts[i] = "".join([*parts, texts[i][at:]])
                counts[i], kinds[i] = len(found), ",".join(sorted({x[2] for x in found}))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(counts, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_entities", "kinds", "text"])

    return run


def _mentions(batches):
    for rb in batches:
        rows = []
        for i, rid, text in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            rows += [(i, rid, *x) for x in sorted({(base(k), n) for _, _, k, n in find(text or "")})]
        c = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string())], ["doc_id", "rid", "kind", "norm"])


def pseudonymise(docs: DataFrame, key: bytes = b"snpweave") -> DataFrame:
    """(doc_id, n_entities, kinds, text) with every entity replaced by its surrogate."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    entities = own.select("text").mapInArrow(_entities, "kind string, norm string").distinct()
    odd = settle(named_once(entities), key).filter("attempt > 0 or mixed").select("kind", "norm", "surrogate")
    if odd.limit(FEW + 1).count() <= FEW:
        few = spark.sparkContext.broadcast({(r[0], r[1]): r[2] for r in odd.collect()})
        return own.mapInArrow(_replace(key, few, False), _OUT)
    own = own.withColumn("rid", F.xxhash64("text"))
    said = own.select("doc_id", "rid", "text").mapInArrow(_mentions, "doc_id long, rid long, kind string, norm string")
    more = said.join(odd, ["kind", "norm"]).groupBy("doc_id", "rid").agg(F.collect_set(F.struct("kind", "norm", "surrogate")).alias("own"))
    j = own.join(more.withColumnRenamed("doc_id", "d").withColumnRenamed("rid", "r"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rid") == F.col("r")), "left")
    return j.select("doc_id", "text", "own").mapInArrow(_replace(key, None, True), _OUT)
