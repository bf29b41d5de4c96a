"""Personal data, found in the text as written and behind disguises, with offsets into the text as written.

A transducer rewrites a text: homoglyphs and full-width forms become ASCII one for
one, then spelled digits, "plus", and at/dot disguises become the characters they
stand for: bare ones wherever an ip of four parts or an address with a domain of two
parts or more comes of it. Each output character carries the source span it came from. The
detectors run on the rewritten text and their spans map back; a mapped span is
added unless it overlaps one of its own kind that was found in the source.

Defined results: null and empty texts have no spans; kinds are independent, so one
span may count under two kinds; a failing match (an ip part over 255, a card that
fails Luhn, a phone with too few digits) is dropped without a retry; rows that
repeat are handled alike; extra columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_TAIL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# a failed start inside a run of digits fails at each later digit of the run too, hence the look-behind and no giving back
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[^0-9]+")

#: Letters that look like ASCII ones, and the words for digits and signs.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "У": "Y",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "﹫": "@", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
HOMOGLYPHS |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS, DOT_WORDS = "at|arobase|arroba|ät", "dot|punkt|point|punto"

_HOMO = str.maketrans(HOMOGLYPHS)
_HAS_HOMO = re.compile("[" + "".join(map(re.escape, HOMOGLYPHS)) + "]")
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:(?P<plus>plus)[ -]?)?(?:{_WORD})(?:(?:[ ,-]|, )(?:{_WORD})){{3,}}(?!\w)", re.I)
_ONE_WORD = re.compile(_WORD, re.I)
_BRACKET = re.compile(rf" ?[(\[{{<] ?(?:(?P<at>{AT_WORDS}|@)|(?P<dot>{DOT_WORDS}|\.)) ?[)\]}}>] ?", re.I)
_DOT = rf"(?: ?[(\[{{<] ?(?:{DOT_WORDS}|\.) ?[)\]}}>] ?| (?:{DOT_WORDS}) |\.)"
_AT = rf"(?: ?[(\[{{<] ?(?:{AT_WORDS}|@) ?[)\]}}>] ?| (?:{AT_WORDS}|@) |@)"
# what follows the local part of an address, and the dot before a piece of the local part
_HOST = re.compile(rf"(?P<a>{_AT})(?P<h>[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*{_DOT}[A-Za-z]{{2,}})(?![A-Za-z0-9])", re.I)
_DOT_BEFORE = re.compile(rf" (?:{DOT_WORDS}) \Z", re.I)
_ANY_DOT = re.compile(_DOT, re.I)
# at most three digit words a part, as more are no part of an ip
_PART = rf"(?:(?<![0-9])[0-9]++|(?<!\w)(?:{_WORD})(?:[ -](?:{_WORD})){{0,2}}(?!\w))"
_IP_LIKE = re.compile(rf"{_PART}(?:{_DOT}{_PART}){{3}}", re.I)
_ONE_WORD_OR_DOT = re.compile(rf"(?P<dot>{_DOT})|[0-9]+|{_WORD}", re.I)
_HINT = re.compile(rf"[(\[{{<] ?(?:{AT_WORDS}|{DOT_WORDS}|@|\.) ?[)\]}}>]| (?:{AT_WORDS}|{DOT_WORDS}|@) ", re.I)


def emails(t: str):
    out, end, at = [], 0, t.find("@")
    while at >= 0:
        b = at
        while b > end and t[b - 1] in _LOCAL:
            b -= 1
        m = _DOMAIN.match(t, at) if b < at else None
        if m:
            out.append((b, m.end()))
            end = m.end()
        at = t.find("@", max(end, at + 1))
        end = max(end, 0)
    return out


def ips(t: str):
    return [m.span() for m in _IP.finditer(t) if all(len(x) <= 3 or not x[:-3].strip("0") for x in m[0].split(".")) and all(int(x[-3:]) <= 255 for x in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def cards(t: str):
    return [m.span() for m in _CARD.finditer(t) if m.end() - m.start() >= 13 and 13 <= len(d := _DIGIT.sub("", m[0])) <= 19 and luhn(d)]


def phones(t: str):
    return [m.span() for m in _PHONE.finditer(t) if 9 <= len(_DIGIT.sub("", m[0])) <= 15]


def detect(t: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in a text as it stands."""
    return {"email": emails(t) if "@" in t else [], "ip": ips(t) if "." in t else [], "card": cards(t), "phone": phones(t) if "+" in t else []}


def _addresses(n: str):
    """Swaps for the separators of addresses that have a local part and a domain of two parts or more."""
    end = 0
    for m in _HOST.finditer(n):
        b = m.start()
        swaps = []
        while True:
            a = b
            while a > end and n[a - 1] in _LOCAL:
                a -= 1
            if a == b:
                # a dot that no piece stands before is a word
                swaps = swaps[:-1]
                break
            d = _DOT_BEFORE.search(n, max(end, a - 8), a)
            if not d:
                break
            swaps.append((d.start(), a, "."))
            b = d.start()
        if m.start() > end and n[m.start() - 1] in _LOCAL:
            yield from swaps
            yield m.start("a"), m.end("a"), "@"
            yield from ((*d.span(), ".") for d in _ANY_DOT.finditer(n, *m.span("h")) if d[0] != ".")
            end = m.end()


def _spelled_ips(n: str):
    """(swaps, spans) of four parts around dots, each of digits or of up to three digit words."""
    swaps, spans = [], []
    for m in _IP_LIKE.finditer(n):
        spans.append(m.span())
        last = None
        for w in _ONE_WORD_OR_DOT.finditer(n, *m.span()):
            if w["dot"]:
                swaps.append((*w.span(), "."))
                last = None
                continue
            if last is not None and w.start() > last:
                swaps.append((last, w.start(), ""))
            if not w[0].isdigit():
                swaps.append((*w.span(), DIGIT_WORDS[w[0].lower()]))
            last = w.end()
    return swaps, spans


def normalise(t: str):
    """(rewritten text, source start of each character, source end of each) or None if nothing is disguised."""
    homo = not t.isascii() and _HAS_HOMO.search(t) is not None
    n = t.translate(_HOMO) if homo else t
    swaps, ip_spans = [], []
    if _HINT.search(n):
        swaps += [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKET.finditer(n)]
        swaps += _addresses(n)
    if _HINT.search(n) or "." in n:
        own, ip_spans = _spelled_ips(n)
        swaps += [x for x in own if n[x[0] : x[1]] != x[2]]
    edges = {x for span in ip_spans for x in span}
    for m in _SPELLED.finditer(n):
        if m["plus"]:
            swaps.append((m.start(), m.start() + 4, "+"))
            if n[m.start() + 4] in " -":
                swaps.append((m.start() + 4, m.start() + 5, ""))
        last = None
        for w in _ONE_WORD.finditer(n, m.end("plus") if m["plus"] else m.start(), m.end()):
            if last is not None and w.start() > last and not {last, w.start()} & edges:
                swaps.append((last, w.start(), ""))
            swaps.append((w.start(), w.end(), DIGIT_WORDS[w[0].lower()]))
            last = w.end()
    if not homo and not swaps:
        return None
    out, src, end, at = [], [], [], 0
    for a, b, x in sorted(swaps):
        if a < at:
            continue
        out.append(n[at:a])
        src.append(np.arange(at, a))
        end.append(np.arange(at + 1, a + 1))
        out.append(x)
        src.append(np.full(len(x), a))
        end.append(np.full(len(x), b))
        at = b
    out.append(n[at:])
    src.append(np.arange(at, len(n)))
    end.append(np.arange(at + 1, len(n) + 1))
    return "".join(out), np.concatenate(src), np.concatenate(end)


def find(t: str | None):
    """(base spans, added spans), each kind -> [(start, end)] in code points of the text as written."""
    t = t or ""
    base = detect(t)
    added = {k: [] for k in KINDS}
    if (norm := normalise(t)) is not None:
        for k, spans in detect(norm[0]).items():
            i = 0
            for a, b in spans:
                s, e = int(norm[1][a]), int(norm[2][b - 1])
                while i < len(base[k]) and base[k][i][1] <= s:
                    i += 1
                if i == len(base[k]) or base[k][i][0] >= e:
                    added[k].append((s, e))
    return base, added


def _render(spans: dict) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def find_pii(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs plus n_email, n_ip, n_card, n_phone (base spans), base_spans, spans (all), n_added."""
    names = [f"n_{k}" for k in KINDS] + ["n_added", "base_spans", "spans"]
    docs = docs.drop(*names)

    def run(batches):
        for pdf in batches:
            found = [find(t) for t in pdf[column]]
            for k in KINDS:
                pdf[f"n_{k}"] = np.array([len(b[k]) for b, _ in found], np.int64)
            pdf["n_added"] = np.array([sum(map(len, a.values())) for _, a in found], np.int64)
            pdf["base_spans"] = [_render(b) for b, _ in found]
            pdf["spans"] = [_render({k: b[k] + a[k] for k in KINDS}) for b, a in found]
            yield pdf

    fields = [T.StructField(x, T.LongType()) for x in names[:-2]] + [T.StructField(x, T.StringType()) for x in names[-2:]]
    return docs.mapInPandas(released(run), T.StructType([*docs.schema.fields, *fields]))


def mask(text: str | None, spans: str) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans count as one."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for a, b, k in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(","))):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, column: str = "text") -> DataFrame:
    """The same columns, with personal data of ``column`` masked."""

    def run(batches):
        for pdf in batches:
            pdf[column] = [mask(t, _render({k: b[k] + a[k] for k in KINDS})) for t in pdf[column] for b, a in [find(t)]]
            yield pdf

    return docs.mapInPandas(released(run), docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")
