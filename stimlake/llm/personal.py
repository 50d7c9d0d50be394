"""Personal details in free text: found, and replaced by typed placeholders that keep equal values linked.

Email addresses, telephone numbers, numbers of personal documents, street addresses and names of persons are
found by patterns with checks: labels say which numbers are personal and which are of things; a telephone number must
fit a numbering plan (at most 15 digits with the country code, or the North American form), a personal number must
have the digits of one and not be all zeros (ranges that nobody was given count: they are what examples are made of); names are told by the known name tokens and by the parts these are
made of. A placeholder holds the kind and a pseudonym. Numbers are permuted by a keyed Feistel network within their
format: digits stay digits, letters stay letters of their case, separators, country code and trunk prefix stay as
they are. Dates of birth are permuted within the calendar; other values get a keyed hash. So one value has one
pseudonym in all documents, also where a telephone number is once written with its country code and once without, and
a holder of the key can undo those of numbers and dates.

How it is spread: map-only, each document by itself and whole; the name tokens (a bounded table) go to every
task.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from bisect import bisect
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "street", "person")
MAX_NAMES = 1_000_000

AT = re.compile(r"@|%40|&#64;|&#x40;|&commat;|\\u0040|\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?|\s(?:at|AT)\s(?=[\w-]+(?:\.|\s[\[({]?(?:dot|DOT)[\])}]?\s))")
LOCAL = re.compile(r"[\w.+-]*\w$")
DOT = r"(?:\.|%2[eE]|\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\s(?:dot|DOT)\s)"
DOMAIN = re.compile(rf"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?{DOT})+[A-Za-z]{{2,24}}(?![A-Za-z0-9-])")

PHONE = re.compile(
    r"(?<![\w.+-])(?:"
    r"\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,4}){2,6}"
    r"|\(\d{3}\)[ .-]?\d{3}[-. ]\d{4}"
    r"|\d{3}([-. ])\d{3}\1\d{4}"
    r"|0\d{2,4} \d{3,4} \d{3,4}"
    r"|00[1-9]\d{8,12}"
    r")(?:,?\s?(?:x|ext\.?|extension)\s?\d{1,6})?(?![\w-]|\.\d)"
)
# a label of a thing stands at most so many separators before its number
OF_A_THING = re.compile(r"(?:part|ticket|build|order|serial|item|invoice|case|batch|model|sku|isbn|issue|version|revision|release|offset|job|lot|catalogue)s?[\s_.:#=-]{0,24}(?:no|nr|number|id)?[\s.:#=-]{0,24}$", re.I)
LONGEST_LABEL = 10 + 24 + 6 + 24
# fixed values: country codes of one and of two digits (all others have three)
ONE_DIGIT_CODES = "1 7".split()
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

# one of these begins every label that ID_LABEL accepts
ID_CUES = re.compile(r"ssn|soc|national|nino|ni[\s_]+number|personal|identity|id[\s_]card|passport|travel[\s_]doc|tax|tin(?![a-z])")
FOLDED = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"})  # what re.I takes for these letters
ID_LABEL = (
    r"(?<![A-Za-z])(?:ssn|soc(?:ial|\.)?[\s_]+sec(?:urity|\.)?|social[\s_]+insurance|national[\s_]+insurance|nino|ni[\s_]+number|national[\s_]id(?:entity)?|personal[\s_](?:id|identity)"
    r"|personal[\s_]no\.?|identity[\s_](?:card|document|no\.?)|id[\s_]card|passport|travel[\s_]document|taxpayer(?:[\s_](?:id|identification))?|tax[\s_](?:id|no\.?|number|record)|tin)"
)
ID_NUMBER = re.compile(ID_LABEL + r"(?:[\s_]*(?:no\.|no|number|nr\.?|id|#))?[\"']?\s*(?:[:=]+|is)?\s*[\"'#]?((?:[A-Z]{1,3}[- ]?)?\d(?:[ -]?\d){5,13}(?:[- ]?[A-Z](?![A-Za-z0-9]))?)(?![A-Za-z0-9])", re.I)

# fixed values: words that end a street's name, in English and in other languages
STREET_ENDS = "Street|St\\.|St|Lane|Avenue|Ave\\.|Ave|Road|Rd|Drive|Court|Close|Square|Boulevard|Blvd|Terrace|Crescent|Way"
STREET = re.compile(
    rf"(?<![\w.-])\d{{1,4}}[A-Z]? (?:[A-Z][\w'’]+ ){{1,3}}(?:{STREET_ENDS}|{STREET_ENDS.upper()})(?!\w)"
    r"|(?<!\w)[A-ZÄÖÅ][\wäöåß'’]+(?:gatan|vägen|strasse|straße|weg|allee|platz|GATAN|STRASSE) \d{1,4}[A-Z]?(?!\w)"
    r"|(?<!\w)(?:Via|VIA) (?:[A-Z][\w'’]+ ){1,3}\d{1,4}[A-Z]?(?!\w)"
    r"|(?<![\w.-])\d{1,4}[A-Z]?,? (?:rue|RUE|avenue|boulevard) (?:de la |de |du |des |d['’]|DE )?[A-Z][\w'’]+(?: [A-Z][\w'’]+)?(?!\w)"
)
BORN = re.compile(r"(?:born|dob|date of birth|birth[ _]?date)[\"']?\s*(?:[:=]+|on)?\s*[\"']?(\d{4}-\d{2}-\d{2})(?!\d)", re.I)


# What a line must hold for a pattern to be tried on it: these scans are much faster than the patterns.
_WORDED = r"(?:(?<=[\[({{]{0})|(?<=[\[({{]\s{0})|(?<=\s{0})\s{1})"
# where AT may match, its beginning at most three characters before
AT_CUES = tuple(re.compile(x) for x in ("@", "%40", "&#", "&commat;", r"\\u0040", "AT" + _WORDED.format("AT", ""), "at" + _WORDED.format("at", r"(?=[\w-]+(?:\.|\s[\[({]?(?:dot|DOT)))")))
PHONE_CUES = tuple(re.compile(x) for x in (r"\+\d", r"00[1-9]\d{8}", r"\d\d\d[-. ]\d\d", r"\(\d\d\d\)"))
STREET_CUES = (re.compile(r"\d[A-Z]?,? (?:[A-ZÄÖÅ]|rue|ave|bou)"), *(re.compile(f"{x} \\d") for x in ("gatan", "vägen", "strasse", "straße", "weg", "allee", "platz", "GATAN", "STRASSE")), re.compile("Via "), re.compile("VIA "))


def lines_with(text: str, cues: tuple[re.Pattern, ...]):
    """Begin and end of the lines in which one of the cues stands, each once, in order."""
    spans = set()
    for cue in cues:
        done = -1
        for m in cue.finditer(text):
            if m.start() >= done:
                a = text.rfind("\n", 0, m.start()) + 1
                done = text.find("\n", m.start())
                done = len(text) if done < 0 else done
                spans.add((a, done))
    return sorted(spans)


class Names:
    """Tells name tokens: the known ones, and those made of the same beginnings and endings."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = {x.lower() for x in given}, {x.lower() for x in family}
        every = self.given | self.family
        heads = Counter(x[:3] for x in every if len(x) > 3)
        self.heads = {h for h, n in heads.items() if n >= 2}
        self.given_ends = self._ends(self.given, 1) | self._ends(self.given, 2)
        self.family_ends = self._ends(self.family, 2) | {x[-1] for x in self.family if not x[-1].isascii()}
        first = sorted({x[:3] for x in every if len(x) >= 3})
        self.cues = (re.compile("|".join(re.escape(y) for x in first for y in (x.capitalize(), x.upper()))),) if first else ()
        start = "|".join(re.escape(y) for x in first for y in (x.capitalize(), x.upper()))
        token = rf"(?:{start})[^\W\d_]*"
        compound = rf"{token}(?:[-'’]{token})*"
        initials = r"(?: [A-Z]\.)*"
        self.pattern = re.compile(rf"(?<![\w@.+-])(?:({compound}), ?({token}|[A-Z]\.)({initials})|({token}|[A-Z]\.){initials} ({compound}))(?![\w@]|\.\w)") if first else None

    @staticmethod
    def _ends(tokens: set[str], k: int) -> set[str]:
        n = Counter(x[-k:] for x in tokens if len(x) > k + 2)
        return {e for e, c in n.items() if c >= 3}

    def is_given(self, x: str) -> bool:
        x = x.lower()
        return (len(x) == 2 and x[1] == ".") or x in self.given or (x[:3] in self.heads and len(x) > 3 and (x[-1] in self.given_ends or x[-2:] in self.given_ends))

    def is_family(self, x: str) -> bool:
        parts = re.split(r"[-'’]", x.lower())
        return all(p in self.family or (p[:3] in self.heads and len(p) > 5 and (p[-2:] in self.family_ends or p[-1] in self.family_ends)) for p in parts)

    def find(self, text: str):
        """Begin and end of each person's name."""
        for a, b in lines_with(text, self.cues):
            while m := self.pattern.search(text, a, b):
                last, first = (m[1], m[2]) if m[1] else (m[5], m[4])
                if self.is_given(first) and self.is_family(last):
                    yield m.start(), m.end()
                    a = m.end()
                else:
                    a = m.start() + len(m[1] or m[4])


def ats(text: str):
    """What AT.finditer finds, tried only where a cue stands."""
    done = 0
    for at in sorted({m.start() for cue in AT_CUES for m in cue.finditer(text)}):
        for a in range(max(done, at - 3), at + 1):
            if m := AT.match(text, a):
                done = m.end()
                yield m
                break


def emails(text: str):
    for m in ats(text):
        reach = 80
        while (a := LOCAL.search(text[max(0, m.start() - reach) : m.start()])) and len(a[0]) == reach:
            reach *= 2  # the local part may go on before
        b = DOMAIN.match(text, m.end())
        if not a or not b:
            continue
        if text[b.end() : b.end() + 1] == ":" and text[b.end() + 1 : b.end() + 2].isalnum():
            continue  # the address of a repository
        yield m.start() - len(a[0]), b.end()


def country_code(digits: str) -> str:
    """The country code that an international number begins with."""
    n = 1 if digits[:1] in ONE_DIGIT_CODES else 2 if digits[:2] in TWO_DIGIT_CODES else 3
    return digits[:n]


def dialled(text: str) -> tuple[str, str, str]:
    """A telephone number's digits in three parts: before the national number (00, country code, trunk 0), the
    national number, and the extension."""
    number = re.split(r"[xe]", text, maxsplit=1, flags=re.I)[0]
    digits, extension = ("".join(c for c in x if c.isdecimal()) for x in (number, text[len(number) :]))
    if number.startswith("+") or digits.startswith("00"):
        head = "" if number.startswith("+") else "00"
        head += country_code(digits[len(head) :])
        if "(0)" in number.replace(" ", "") and digits[len(head) :].startswith("0"):
            head += "0"  # a trunk prefix shown for callers from inside
    else:
        head = "0" if digits.startswith("0") else ""
    return head, digits[len(head) :], extension


def is_dialled(text: str) -> bool:
    """Whether a number fits a numbering plan: 9 to 15 digits; North American numbers have ten digits after the code,
    and none of their two leading groups begins with 0."""
    head, national, _ = dialled(text)
    if not 9 <= len(head) + len(national) <= 15 + 2 * head.startswith("00") or len(national) < 4 or not national.strip("0"):
        return False
    if text.startswith("+") or head.startswith("00"):
        return head.removeprefix("00") != "1" or (len(national) == 10 and "0" not in (national[0], national[3]))
    return True if head else "0" not in (national[0], national[3])


def is_personal_number(text: str) -> bool:
    """Whether a labelled number can be a person's: 6 to 13 digits that are not all zeros."""
    digits = [c for c in text if c.isdecimal()]
    return 6 <= len(digits) <= 13 and set(digits) != {"0"}


def phones(text: str):
    for m in (m for span in lines_with(text, PHONE_CUES) for m in PHONE.finditer(text, *span)):
        if is_dialled(m[0]) and not OF_A_THING.search(text, max(0, m.start() - LONGEST_LABEL), m.start()):
            yield m.start(), m.end()


def find(text: str, names: Names) -> list[tuple[int, int, str]]:
    """Begin, end and kind of each personal detail, in order and without overlap.

    Where two overlap, the one of the earlier kind in KINDS stays, except that a labelled number is never a
    telephone number.
    """
    got: list[tuple[int, int, str]] = []
    low = text.lower() if text.isascii() else text.translate(FOLDED).lower()
    if ID_CUES.search(low):
        got += [(*m.span(1), "id_number") for m in ID_NUMBER.finditer(text) if is_personal_number(m[1])]
    got += [(a, b, "email") for a, b in emails(text)]
    got += [(a, b, "phone") for a, b in phones(text)]
    got += [(*m.span(), "street") for span in lines_with(text, STREET_CUES) for m in STREET.finditer(text, *span)]
    got += [(a, b, "person") for a, b in names.find(text)]
    order = {"id_number": 0, "email": 1, "phone": 2, "street": 3, "person": 4}
    begins, taken = [], []
    for a, b, kind in sorted(got, key=lambda x: (order[x[2]], x[0])):
        i = bisect(begins, a)
        if (not i or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
            begins.insert(i, a)
            taken.insert(i, (a, b, kind))
    return taken


def _round(key: bytes, tweak: str, i: int, value: int, modulus: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{i}|{value}".encode(), key=key, digest_size=24).digest(), "big") % modulus


def _permute(values: list[int], radices: list[int], key: bytes, tweak: str, undo: bool, rounds: int = 8) -> list[int]:
    """A keyed permutation of the places' values within their radices: a Feistel network over the two halves."""
    half = len(values) // 2
    if not half:  # one place: a keyed rotation
        return [(v + (-1 if undo else 1) * _round(key, tweak, 0, 0, r)) % r for v, r in zip(values, radices)]

    def number(vs, rs):
        n = 0
        for v, r in zip(vs, rs):
            n = n * r + v
        return n

    def places(n, rs):
        out = []
        for r in reversed(rs):
            n, v = divmod(n, r)
            out.append(v)
        return out[::-1]

    a, b = number(values[:half], radices[:half]), number(values[half:], radices[half:])
    top_a, top_b = math.prod(radices[:half]), math.prod(radices[half:])
    for i in reversed(range(rounds)) if undo else range(rounds):
        if i % 2:
            b = (b + (-1 if undo else 1) * _round(key, tweak, i, a, top_b)) % top_b
        else:
            a = (a + (-1 if undo else 1) * _round(key, tweak, i, b, top_a)) % top_a
    return places(a, radices[:half]) + places(b, radices[half:])


def permute_digits(digits: str, key: bytes, tweak: str, undo: bool = False) -> str:
    """A keyed permutation of the digit strings of one length."""
    return "".join(map(str, _permute([int(c) for c in digits], [10] * len(digits), key, tweak, undo)))


def permute_id(text: str, key: bytes, undo: bool = False) -> str:
    """A personal number with its digits and letters permuted, each within its alphabet and case; what separates them
    stays, and plays no role for the pseudonym."""
    at = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    base = ["0" if text[i].isdecimal() else "a" if text[i].islower() else "A" for i in at]
    radices = [10 if c == "0" else 26 for c in base]
    tweak = "id" + "".join("0" if r == 10 else "A" for r in radices)
    new = _permute([ord(text[i]) - ord(c) for i, c in zip(at, base)], radices, key, tweak, undo)
    out = list(text)
    for i, c, v in zip(at, base, new):
        out[i] = chr(ord(c) + v)
    return "".join(out)


def permute_phone(text: str, key: bytes, undo: bool = False) -> str:
    """A telephone number with its national number and its extension permuted; country code and trunk prefix stay, so
    the number has the same pseudonym with and without them."""
    head, national, extension = dialled(text)
    zeros = lambda x: [c == "0" for c in (x[:1], x[3:4])]
    other = permute_digits(national, key, f"phone{len(national)}", undo)
    while zeros(other) != zeros(national):  # walk the cycle to a number whose parts begin as those of this one may
        other = permute_digits(other, key, f"phone{len(national)}", undo)
    new = iter(head + other + (permute_digits(extension, key, f"ext{len(extension)}", undo) if extension else ""))
    return "".join(next(new) if c.isdecimal() else c for c in text)


FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), 60_000


def permute_date(text: str, key: bytes, undo: bool = False) -> str:
    """An ISO date of the 60 000 days from 1900 permuted among them, by walking the cycle of 5-digit numbers."""
    n = dt.date.fromisoformat(text).toordinal() - FIRST_DAY
    if not 0 <= n < DAYS:
        return text
    while True:
        n = int(permute_digits(f"{n:05d}", key, "date", undo))
        if n < DAYS:
            return dt.date.fromordinal(FIRST_DAY + n).isoformat()


def placeholder(kind: str, text: str, key: bytes) -> str:
    """What stands for a value: its kind and its pseudonym."""
    if kind in ("phone", "id_number"):
        return f"<{kind.upper()}:{permute_phone(text, key) if kind == 'phone' else permute_id(text, key)}>"
    plain = text.casefold()
    if kind == "email":
        plain = re.sub(r"%2e", ".", re.sub(DOT, ".", AT.sub("@", text)), flags=re.I).casefold()
    elif kind == "person":
        plain = " ".join(sorted(re.findall(r"[^\W\d_]+", plain)))
    return f"<{kind.upper()}:{hashlib.blake2b(plain.encode(), key=key, digest_size=6).hexdigest()}>"


def link(kind: str, mark: str) -> str:
    """What of a placeholder is the same for all ways of writing a value."""
    value = mark.partition(":")[2].rstrip(">")
    if kind == "phone":
        return dialled(value)[1]
    return "".join(c for c in value if c.isalnum()).upper() if kind == "id_number" else value


def redact(text: str, names: Names, key: bytes) -> tuple[str, list[tuple[str, str, int, str]]]:
    """The text with placeholders, and of each detail its kind, how it was written, where, and its placeholder."""
    out, at, said = [], 0, []
    spans = find(text, names)
    spans += [(*m.span(1), "birth_date") for m in BORN.finditer(text) if all(m.end(1) <= a or m.start(1) >= b for a, b, _ in spans)]
    for a, b, kind in sorted(spans):
        new = placeholder(kind, text[a:b], key) if kind != "birth_date" else _date(text[a:b], key)
        said.append((kind, text[a:b], a, new))
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], said


def _date(text: str, key: bytes) -> str:
    try:
        return permute_date(text, key)
    except ValueError:
        return text


def _names(name_list: DataFrame) -> Names:
    rows = name_list.select("token", "token_kind").filter("token IS NOT NULL AND token <> ''").limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError("the list of name tokens is larger than what may go to every task")
    return Names({r.token for r in rows if r.token_kind == "given"}, {r.token for r in rows if r.token_kind != "given"})


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id IS NOT NULL")


def personal_details(documents: DataFrame, name_list: DataFrame, key: bytes) -> DataFrame:
    """Personal details of each document: ``doc_id, kind, as_written, at`` (where it begins), ``placeholder``, ``link``
    (what all ways of writing a value have in common of it).

    documents: ``doc_id`` BIGINT, ``text`` STRING; name_list: ``token``, ``token_kind`` ('given' or 'family'). kind is
    email, phone, id_number, street, person or birth_date.
    Null ids take no part; null and empty texts have no details; without name tokens no persons are found; of a
    repeated row each copy has its details.
    """
    names = _names(name_list)

    def run(batches):
        for pdf in batches:
            rows = [(i, k, w, a, p, link(k, p)) for i, t in zip(pdf["doc_id"], pdf["text"]) for k, w, a, p in redact(t, names, key)[1]]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "as_written", "at", "placeholder", "link"])

    return _texts(documents).filter("text IS NOT NULL AND text <> ''").mapInPandas(run, "doc_id long, kind string, as_written string, at int, placeholder string, link string")


def linked_values(details: DataFrame) -> DataFrame:
    """Values that stand in several documents, by their pseudonyms: ``kind, link, documents, ways`` (how many documents,
    and how many ways of writing). details: the result of personal_details.
    """
    seen = details.filter("kind <> 'birth_date'").groupBy("kind", "link", "doc_id", "as_written").agg(F.count("*").alias("n"))
    docs = seen.groupBy("kind", "link", "doc_id").agg(F.count("*").alias("n")).groupBy("kind", "link").agg(F.count("*").alias("documents"))
    ways = seen.groupBy("kind", "link", "as_written").agg(F.count("*").alias("n")).groupBy("kind", "link").agg(F.count("*").alias("ways"))
    return docs.filter("documents > 1").join(ways, ["kind", "link"])


def find_personal(documents: DataFrame, name_list: DataFrame, key: bytes = b"") -> DataFrame:
    """Personal details of each document as they are written: ``doc_id, kind, as_written``, distinct; see personal_details."""
    return personal_details(documents, name_list, key).filter("kind <> 'birth_date'").select("doc_id", "kind", "as_written").distinct()


def redact_personal(documents: DataFrame, name_list: DataFrame, key: bytes) -> DataFrame:
    """Every document with its personal details replaced.

    Result: ``doc_id, text, n_details, details`` with details an array of ``kind, at`` (where it began) and
    ``placeholder``. Null and empty texts stay as they are; rows with a null id are left out.
    """
    names = _names(name_list)

    def run(batches):
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                new, said = redact(t, names, key) if t else (t, [])
                rows.append((i, new, len(said), [{"kind": k, "at": a, "placeholder": p} for k, _, a, p in said]))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "n_details", "details"])

    return _texts(documents).mapInPandas(run, "doc_id long, text string, n_details int, details array<struct<kind string, at int, placeholder string>>")
