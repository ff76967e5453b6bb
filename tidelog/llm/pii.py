"""Personal data by anchor expansion.

One Aho-Corasick automaton runs over each text and reports anchors: at-signs, a plus before a digit, pairs of digits, a
digit before a dot, URL schemes and words that announce an account number. A small parser for the anchor's kind expands
it to the left and right, and validates what it found. Anchors inside a span of the same kind are skipped, so spans of
one kind never overlap and come out leftmost first.

Base kinds are email, ip, card and phone. The method adds `url` (after a scheme) and `account` (an identifier of at
least 6 characters, one of them a digit, after an announcing word).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import pieces, tidy

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "url", "account"]
SCHEMES = ["http://", "https://", "ftp://", "sftp://", "mailto:", "www."]
CUES = ["iban", "account", "acct", "ssn", "passport", "konto", "cuenta", "compte"]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
ACCOUNT = re.compile(r"(?:(?i:number|no|nr|id|is))?[ \t]?[:#=.]?[ \t]*([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,33})(?![A-Za-z0-9])")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    digits = "0123456789"
    anchors = {"@": "email"} | {f"+{d}": "phone" for d in digits} | {f"{d}.": "ip" for d in digits}
    anchors |= {f"{a}{gap}{b}": "card" for a in digits for b in digits for gap in ("", " ", "-")}
    for cue in SCHEMES:
        anchors |= {cue: "url", cue.upper(): "url"}
    for cue in CUES:
        anchors |= {cue: "account", cue.title(): "account", cue.upper(): "account"}
    for word, kind in anchors.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(twice[v] for v in values[1::2])) % 10 == 0


def email(text: str, at: int, size: int, free: int) -> tuple[int, int, bool] | None:
    start = at
    while start > free and LOCAL.match(text, start - 1):
        start -= 1
    domain = DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end(), True) if domain else None


def ip(text: str, at: int, size: int, free: int) -> tuple[int, int, bool] | None:
    start = at
    while start > free and "0" <= text[start - 1] <= "9":
        start -= 1
    found = IP.match(text, start)
    return found and (start, found.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in
                                          (x.lstrip("0") for x in found[0].split("."))))


def card(text: str, at: int, size: int, free: int) -> tuple[int, int, bool]:
    found = CARD.match(text, at)
    digits = found[0].replace(" ", "").replace("-", "")
    return at, found.end(), 12 <= len(digits) <= 19 and luhn(digits)


def phone(text: str, at: int, size: int, free: int) -> tuple[int, int, bool] | None:
    found = PHONE.match(text, at)
    return found and (at, found.end(), 9 <= sum(c.isdigit() for c in found[0]) <= 15)


def url(text: str, at: int, size: int, free: int) -> tuple[int, int, bool] | None:
    if at and text[at - 1].isalnum():
        return None
    found = URL.match(text, at + size)
    if not found:
        return None
    end = at + size + len(found[0].rstrip(".,;:!?)]"))
    return at, end, end > at + size


def account(text: str, at: int, size: int, free: int) -> tuple[int, int, bool] | None:
    if at and text[at - 1].isalnum() or text[at + size:at + size + 1].isalpha():
        return None
    gap = at + size + (text[at + size:at + size + 1] == " ")
    found = ACCOUNT.match(text, gap)
    if not found:
        return None
    words = found[1].split(" ")
    while words and not any(c.isdigit() for c in words[-1]):  # what follows the number is prose
        words.pop()
    value = " ".join(words)
    good = len(value) >= 6 and bool(words) and any(c.isdigit() for c in words[0])
    return found.start(1), found.start(1) + len(value), good


PARSERS = {"email": email, "ip": ip, "card": card, "phone": phone, "url": url, "account": account}


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start and then by kind as listed. Offsets count code points."""
    free = dict.fromkeys(KINDS, 0)
    out = []
    for last, (kind, size) in anchors.iter(text):
        at = last - size + 1
        if at < free[kind]:
            continue
        if (span := PARSERS[kind](text, at, size, free[kind])) is not None:
            start, end, good = span
            free[kind] = end
            if good:
                out.append((start, end, kind))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: the key, and `spans`, an array of (kind, start, end), by start and kind.

    A null text counts as empty and has no spans; a null key stays null; repeated rows are searched each on its own; an
    empty table gives an empty result; further columns of `docs` are not read. Texts are searched whole.
    """
    kind = docs.schema[key].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in pieces(batches, "t"):
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in find(t or "", anchors)]
                     for t in batch.column("t").to_pylist()]
            of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(spans, of)], [key, "spans"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(tidy(search), f"`{key}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap, the first stays."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
    return "".join(out) + text[at:]


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans if k in BASE).encode()).hexdigest()


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def personal_data_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans, per document."""
    found = find_personal_data(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))
