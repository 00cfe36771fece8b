r"""PII: anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one scan: at-signs,
plus signs, digits, URL schemes and identifier cues.  Deterministic local
parsers start at an anchor, expand to the boundaries of the value and validate
it:

========  =====================================  ===============================
kind      anchor                                 expansion and validation
========  =====================================  ===============================
email     ``@``                                  local part to the left, dotted domain to the right
ip        first digit of a run                   four dotted parts, each at most 255
card      first digit of a run                   14 to 19 digits, single spaces or hyphens between, Luhn
phone     ``+``                                  10 to 15 digits
url       ``://`` after a scheme                 to the next white space, quote or bracket, if it has user info
account   cue (iban, account, token, ...)        the identifier after the cue, to its closing quote or last character, of any
                                                 length; IBANs by remainder 97; without a separator only IBANs, numbers of five
                                                 digits or more, and secrets of 16 characters or more with letters and digits
ssn       cue (ssn, social security)             three, two and four digits
========  =====================================  ===============================

Cues are found in any case, also after an underscore or inside a camel-case name.

The first four are the base kinds; their spans are those of leftmost
non-overlapping matches of the kind's pattern, kept or dropped whole.  The
others are added by the method and never change base spans.

Each text is handled alone in a narrow stage.  Defined results: null text is
empty, and stays null in :func:`redact`; offsets are code points, end exclusive;
a null id stays null; repeated rows are repeated; an empty table gives no rows;
long texts are scanned whole, in time in proportion to their length; spans that
start at one place are listed in the order of the kinds; other columns, whatever
their names, are left as they are by :func:`redact` and left out of the report.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "ssn")
CUES = {
    "account": ("iban", "account", "acct", "token", "password", "passport", "api_key", "apikey", "api key", "api-key", "secret"),
    "ssn": ("ssn", "social security", "social-security"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_REST = re.compile(r"[^\s\"'<>(){}\[\]]+")
_AFTER = re.compile(r"[\"']?(\s*(?:number|num|no|nr|id)\b\.?)?[\"']?\s*([:=#]+>?|is\b)?\s*", re.I)
_QUOTED = re.compile(r"([\"'`])((?:(?!\1)\S){5,})\1")
_RUN = re.compile(r"[\"'`]?([A-Za-z0-9!@$%^*_~+/](?:[A-Za-z0-9!@#$%^*_~+/:?.=\\-]|\x20(?=[A-Z0-9]{2,4}\b)|(?<=[0-9])\x20(?=[0-9]{2,}\b))*)")
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){4,}(?![A-Za-z0-9_])")
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])")
_SECRET = re.compile(r"(?=[^0-9\s]*[0-9])(?=[^A-Za-z\s]*[A-Za-z])[A-Za-z0-9](?:[A-Za-z0-9_.~+/=-]{14,})[A-Za-z0-9_+/=]")
_NUMBERED = re.compile(r"(?=[A-Za-z-]*[0-9])[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])")
_SSN = re.compile(r"[\"']?(?:\s*(?:number|num|no)\b\.?)?[\"']?\s*(?:[:=#]+|is\b)?\s*[\"']?([0-9]{3}[\x20-]?[0-9]{2}[\x20-]?[0-9]{4})(?![0-9-])", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}")
_IBAN_TEXT = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){10,30}|[a-z]{2}[0-9]{2}[a-z0-9]{10,30}")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for mark in ("@", "+", "://", *"0123456789"):
        found.add_word(mark, (mark, len(mark)))
    for kind, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") < 256


def _iban(value: str) -> bool:
    value = re.sub(r"[\s-]", "", value)
    if not _IBAN.fullmatch(value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _lower(text: str) -> str:
    """The text in lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def _iban_end(text: str, at: int) -> int:
    """Where the longest valid IBAN that starts at a place ends, or 0."""
    m = _IBAN_TEXT.match(text, at)
    if m:
        for end in range(m.end(), at + 13, -1):
            if text[end - 1].isalnum() and not text[end : end + 1].isalnum() and _iban(text[at:end].upper()):
                return end
    return 0


def _account(text: str, at: int) -> tuple[int, int, int]:
    """(start, end, place up to which no other cue need be tried) of the identifier after a cue that ends at a place; start and end are 0 without one."""
    m = _AFTER.match(text, at)
    start = m.end()
    told, separated = m[1] is not None, m[2] is not None
    if not separated and (start == at or not text[start - 1].isspace()):
        return 0, 0, 0
    first = start + (text[start : start + 1] in ("'", '"', "`"))
    if end := _iban_end(text, first):
        return first, end, end
    if separated:
        if v := _QUOTED.match(text, start) or _RUN.match(text, start):
            lo, value = v.start(v.lastindex), v[v.lastindex]
            if v.re is _RUN:
                value = value.rstrip(".-:!?")
            if "://" not in value and len(value) > 4 and any("0" <= c <= "9" for c in value):
                return lo, lo + len(value), lo + len(value)
            return 0, 0, v.end() if not any("0" <= c <= "9" for c in value) else 0
        return 0, 0, 0
    v = _SECRET.match(text, first) or not _DATE.match(text, first) and _NUMBER.match(text, first) or told and _NUMBERED.match(text, first)
    return (first, v.end(), v.end()) if v and len(v[0]) > 4 else (0, 0, 0)


def _begins(text: str, at: int) -> bool:
    """Whether a cue at a place begins a word: not after a letter or digit, but for the hump of a camel-case name."""
    return not at or not text[at - 1].isalnum() or text[at].isupper() and text[at - 1].islower()


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def find_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every span, by start and then by kind as listed."""
    spans: list[tuple[int, str, int]] = []
    past = dict.fromkeys(KINDS, 0)
    last_digit = -2
    for at, (what, size) in _automaton().iter(_lower(text)):
        if "0" <= what <= "9":
            run = at != last_digit + 1
            last_digit = at
            if not run:
                continue
            if at >= past["ip"] and (m := _IP.match(text, at)):
                past["ip"] = m.end()
                if all(map(_byte, m[0].split("."))):
                    spans.append((at, "ip", m.end()))
            if at >= past["card"] and (m := _CARD.match(text, at)):
                past["card"] = m.end()
                d = _digits(m[0])
                if 14 <= len(d) <= 19 and luhn(d):
                    spans.append((at, "card", m.end()))
        elif what == "+":
            if at >= past["phone"] and (m := _PHONE.match(text, at)):
                past["phone"] = m.end()
                if 10 <= len(_digits(m[0])) <= 15:
                    spans.append((at, "phone", m.end()))
        elif what == "@":
            lo = at
            while lo > past["email"] and text[lo - 1] in LOCAL:
                lo -= 1
            if lo < at and (m := _DOMAIN.match(text, at + 1)):
                past["email"] = m.end()
                spans.append((lo, "email", m.end()))
        elif what == "://":
            lo = at - 2
            while lo > past["url"] and text[lo - 1].isascii() and (text[lo - 1].isalnum() or text[lo - 1] in "+.-"):
                lo -= 1
            m = _URL_REST.match(text, at + 1)
            if lo < at - 2 and m and "@" in m[0].split("/", 1)[0]:
                past["url"] = m.end()
                spans.append((lo, "url", m.end()))
        elif at + 1 >= past[what]:
            if not _begins(text, at - size + 1):
                continue
            if what == "ssn":
                m = _SSN.match(text, at + 1)
                lo, hi, tried = (m.start(1), m.end(1), m.end(1)) if m else (0, 0, 0)
            else:
                lo, hi, tried = _account(text, at + 1)
            past[what] = max(past[what], tried)
            if hi:
                spans.append((lo, what, hi))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    return spans


def told(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def masked(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in angle brackets."""
    out, done = [], 0
    for a, kind, b in spans:
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[] for _ in BASE_KINDS]
        digests, every = [], []
        for text in batch.column("text"):
            spans = find_spans(text.as_py() or "")
            base = [s for s in spans if s[1] in BASE_KINDS]
            for column, kind in zip(counts, BASE_KINDS, strict=True):
                column.append(sum(s[1] == kind for s in base))
            digests.append(hashlib.sha256(told(base).encode()).hexdigest())
            every.append(told(spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(every, pa.string())],
            ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"],
        )


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans as text."""
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_report, schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of its texts masked."""

    @F.pandas_udf("string")
    def mask(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: None if t is None else masked(t, find_spans(t)))

    return docs.withColumn(text_col, mask(F.col(text_col)))
