"""Personal data: regular expressions propose spans, validators (Luhn, mod-97,
part ranges, digit counts) confirm them, and nearby context words adjust the
score; spans that reach ``threshold`` are reported, and can be masked.

Base kinds (leftmost non-overlapping matches; a match that fails its validator
is dropped, without another try) score at or above the threshold on their own:

* email  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip     four dotted numbers, each at most 255
* card   16 to 19 digits, single blanks or hyphens between, passing Luhn
* phone  ``+``, then 8 to 15 digits with blanks, brackets, dots, hyphens

Added kinds: ``iban`` (country length and mod-97), and, only with a context
word nearby, ``card_short`` (13 to 15 digits passing Luhn), ``phone_local``,
``ssn`` and ``secret`` (a long mixed value after a key name).  An added span
that overlaps an accepted one is dropped.

Offsets are code points, end exclusive.  Null or empty text has no spans; very
long texts are searched whole, in time linear in their length; repeated rows
and null ids stay as rows of their own; other columns come back in ``row``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "card_short", "phone_local", "ssn", "secret")
#: Characters around a span in which context words count.
CONTEXT_CHARS = 48
THRESHOLD = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}))")
_PHONE_LOCAL = re.compile(r"\([0-9]{3}\) ?[0-9]{3}[ -][0-9]{4}(?![0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"[A-Za-z0-9_/+-]{20,}")

# Length of an IBAN by country
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29,
    "VG": 24, "XK": 20}

# Score of a confirmed span, and what a context word adds
WEIGHTS = {"email": (0.8, 0.2), "ip": (0.6, 0.2), "card": (0.8, 0.2), "phone": (0.7, 0.2), "iban": (0.9, 0.1),
           "card_short": (0.3, 0.4), "phone_local": (0.3, 0.4), "ssn": (0.3, 0.5), "secret": (0.2, 0.5)}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
    "iban": ("iban", "bank", "account", "konto"),
    "ssn": ("ssn", "social security"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "private_key")}
CONTEXT["card_short"], CONTEXT["phone_local"] = CONTEXT["card"], CONTEXT["phone"]
_NEAR = {k: re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, v)) + r")(?![a-z])", re.I) for k, v in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` outwards: the same matches as the pattern's, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    for a, b in emails(text):
        yield "email", a, b
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    if not _DIGIT.search(text):
        return
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for part in _dotted_parts(run[0]):
                yield "ip", run.start() + part[0], run.start() + part[1]
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()


def _dotted_parts(run: str) -> Iterator[tuple[int, int]]:
    """Matches of four dotted numbers in a run of digits and dots."""
    for block in re.finditer(r"[0-9]+(?:\.[0-9]+)*", run):
        parts = list(re.finditer(r"[0-9]+", block[0]))
        for i in range(0, len(parts) - 3, 4):
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= 255 for p in parts[i:i + 4]):
                yield block.start() + parts[i].start(), block.start() + parts[i + 3].end()


def _added(text: str) -> Iterator[tuple[str, int, int]]:
    if not _DIGIT.search(text):
        return
    done = 0
    for m in _IBAN.finditer(text):  # from each place: a code before an IBAN may look like one's start
        if m.start() < done or m.start() and text[m.start() - 1].isalnum():
            continue
        left, end = IBAN_LENGTHS.get(m[1][:2], 0), m.start()
        while left and end < m.end(1):  # as many characters as the country's IBANs have
            left -= text[end] != " "
            end += 1
        if m[1][:2] in IBAN_LENGTHS and not left and not text[end:end + 1].isalnum() and mod97(text[m.start():end].replace(" ", "")):
            yield "iban", m.start(), end
            done = end
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 15 and luhn(digits):
                yield "card_short", m.start(), m.end()
    if "(" in text:
        for m in _PHONE_LOCAL.finditer(text):
            yield "phone_local", m.start(), m.end()
    for m in _SSN.finditer(text):
        if not (m.start() and text[m.start() - 1] in "0123456789-") and m[0][:3] not in ("000", "666") and m[0][0] != "9":
            yield "ssn", m.start(), m.end()
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            if re.search(r"[=:]\s*[\"']?$", text[max(0, m.start() - 6):m.start()]) and _DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0]):
                yield "secret", m.start(), m.end()


def find_spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), base kinds first, by kind as listed, then start."""
    if not text:
        return []

    def score(kind: str, a: int, b: int) -> float:
        alone, near = WEIGHTS[kind]
        around = text[max(0, a - CONTEXT_CHARS):a] + " " + text[b:b + CONTEXT_CHARS]
        return round(alone + near * bool(_NEAR[kind].search(around)), 3)

    out = [(k, a, b, score(k, a, b)) for k, a, b in _base(text)]
    starts: list[int] = []  # of the taken stretches of the text, disjoint and in order
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b, _ in out):
        if starts and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for k, a, b in _added(text):
        at = bisect_right(ends, a)  # the first stretch that ends beyond a
        if (s := score(k, a, b)) >= threshold and (at == len(starts) or starts[at] >= b):
            out.append((k, a, b, s))
            starts.insert(at, a)
            ends.insert(at, b)
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def find_pii(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (the whole input row) and ``spans`` (kind, start, end, score)."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            found = [[{"kind": k, "start": x, "end": y, "score": s} for k, x, y, s in find_spans(t, threshold)]
                     for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, pa.list_(_SPAN))], ["row", "spans"])

    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].cast("string").alias("text"))
    return whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, "
                                 "spans array<struct<kind:string,start:int,end:int,score:double>>")


def masked(text: F.Column, spans: F.Column) -> F.Column:
    """``text`` with each span replaced by its kind in brackets (null stays
    null).  Overlapping spans are masked as one, under the first one's kind."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    done = F.aggregate(
        by_start, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
                     F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["end"].alias("at")))
        .otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))))
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with its spans masked in ``text`` and, where there is such a
    column, ``length`` set to the new number of code points."""
    found = find_pii(docs, text)
    new = masked(F.col("row")[text], F.col("spans"))
    out = []
    for f in docs.schema.fields:
        c = F.col("row")[f.name]
        if f.name == text:
            c = new
        elif f.name == length:
            c = F.when(F.size("spans") == 0, c).otherwise(F.length(new)).cast(f.dataType)
        out.append(c.alias(f.name))
    return found.select(F.struct(*out).alias("out")).select("out.*")
