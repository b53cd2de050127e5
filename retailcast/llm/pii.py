"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust a score.

All scans are linear in the length of a text, whatever stands in it: each pattern is run over the
maximal stretches of its own characters only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import text_or_empty

KINDS = ("email", "ip", "card", "phone", "iban", "short_card")
BASE_KINDS = KINDS[:4]
# What each kind scores by itself, and words nearby that raise it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.95, "short_card": 0.3}
CONTEXT = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "address", "host", "server", "login"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "payment"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "contact"},
    "iban": {"iban", "account", "bank", "transfer"},
    "short_card": {"card", "amex", "diners", "credit", "payment"},
}
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.3
MIN_SCORE = 0.5  # for the kinds beyond the base ones

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMERIC = re.compile(r"[0-9][0-9\x20.-]*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NEAR = re.compile(r"[a-z]+")
# Characters of an account number by country, from the IBAN registry.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod_97(account: str) -> bool:
    """Country and check digits moved to the end, letters as numbers, rest of the division is 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """One match for each @ with a local part and a domain; the local part reaches back to the last
    other character or the end of the last match."""
    used, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            used = domain.end()
            yield start, used
        else:
            used = at + 1
        at = text.find("@", used)


def _addresses(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Numbers with dots between them, taken in fours from the left."""
    for run in _DOTTED.finditer(text, start, end):
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(_at_most_255(p) for p in four):
                yield at, at + size
            at += size + 1


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    for zone in _NUMERIC.finditer(text):
        a, b = zone.span()
        if b - a < 7:
            continue
        for start, end in _addresses(text, a, b):
            yield "ip", start, end
        for run in _DIGITS.finditer(text, a, b):
            digits = run.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card" if len(digits) >= 16 else "short_card", run.start(), run.end()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for run in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in run.group()) <= 15:
                yield run.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """A proposal may take in short tokens that follow the number: it is cut to its country's length, or,
    of unknown countries, to the longest run of whole groups that the checksum confirms. The search goes
    on behind the number, and behind the first group of a proposal that holds none."""
    run = _IBAN.search(text)
    while run:
        start, end = run.span()
        bounds = [i for i in range(start, end) if text[i] == " "] + [end]
        sized = [(len(text[start:i].replace(" ", "")), i) for i in reversed(bounds)]
        known = IBAN_LENGTHS.get(text[start : start + 2])
        if known:  # the whole proposal comes second
            sized = [s for s in sized if s[0] == known] + sized[:1]
        used = next((i for n, i in sized if 15 <= n <= 34 and mod_97(text[start:i].replace(" ", ""))), None)
        if used:
            yield start, used
        run = _IBAN.search(text, used or start + 4)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; code points, end exclusive."""
    found = [("email", a, b) for a, b in _emails(text)]
    found += _numbers(text)
    found += [("phone", a, b) for a, b in _phones(text)]
    found += [("iban", a, b) for a, b in _ibans(text)]
    scored = []
    for kind, start, end in found:
        near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
        score = SCORES[kind] + CONTEXT_GAIN * bool(CONTEXT[kind] & set(_NEAR.findall(near.lower())))
        if kind in BASE_KINDS or score >= MIN_SCORE:
            scored.append((kind, start, end, round(min(1.0, score), 2)))
    return sorted(scored, key=lambda s: (KINDS.index(s[0]), s[1]))


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first, then the longest."""
    out, used = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= used:
            out += [text[used:start], f"<{kind}>"]
            used = end
    return "".join(out) + text[used:]


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_masked: bool = False) -> DataFrame:
    """doc_id and spans (kind, start, end, score) of every row; its masked text if asked for.

    Null and empty texts have no spans; equal rows give equal rows; an empty table gives an empty
    result; null ids stay null; texts of any length are searched whole. Other columns, whatever their
    names, are not read.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = [], []
            for value in batch.column(1):
                text = value.as_py()
                found = find_spans(text)
                spans.append([dict(zip(("kind", "start", "end", "score"), s)) for s in found])
                if with_masked:
                    texts.append(masked(text, found))
            columns = [batch.column(0), pa.array(spans, kind)] + ([pa.array(texts, pa.string())] if with_masked else [])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans"] + ["masked"] * with_masked)

    narrow = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,score:double>>"
    return narrow.mapInArrow(run, schema + ", masked string" * with_masked)


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, all spans as a string, a digest of the base ones, the highest score."""
    found = pii_spans(docs, id_col, text_col)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
