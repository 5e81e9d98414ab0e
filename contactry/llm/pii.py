"""Personal data: patterns propose spans, checks confirm them, words nearby adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, outer_id

#: Fixed patterns of the base kinds. An email is its part after the @, and the run of LOCAL characters before it:
#: searching from each @ takes linear time also where a text has very long words.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Kinds that the method adds.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![+0-9.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
KINDS = ("email", "ip", "card", "phone", "iban", "local_phone")
BASE_KINDS = KINDS[:4]

_DIGIT = re.compile(r"[0-9]")
_LONG_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){15}")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
#: Characters on either side in which context words count.
NEAR = 40
ACCEPT = 0.5
#: Starting score by kind, and words that raise or lower it.
START = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "local_phone": 0.3}
RAISES = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "visa", "pay", "credit"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"),
}
LOWERS = {"ip": ("version", "release"), "card": ("order", "isbn"), "local_phone": ("order", "part", "serial")}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _only_digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _card(m: re.Match) -> bool:
    digits = _only_digits(m[0])
    return 16 <= len(digits) <= 19 and luhn(digits)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds in order, leftmost and non-overlapping within a kind, failing matches dropped."""
    out = [("email", *span) for span in _emails(text)]
    if not _DIGIT.search(text):
        return out
    if _DOTTED.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
    if _LONG_NUMBER.search(text):
        out += [("card", *m.span()) for m in CARD.finditer(text) if _card(m)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_only_digits(m[0])) <= 15]
    return out


def _ibans(text: str) -> list[tuple[int, int]]:
    """Of every start the longest end at a border of groups that passes the check; without one the search goes on inside."""
    out, m = [], IBAN.search(text)
    while m:
        start, at = m.start(), m.start() + 1
        for end in [m.end(), *(i for i in range(m.end() - 1, start, -1) if text[i] == " ")]:
            if IBAN.fullmatch(text, start, end) and mod97(text[start:end].replace(" ", "")):
                out.append((start, end))
                at = end
                break
        m = IBAN.search(text, at)
    return out


def context_score(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()
    words = set(re.findall(r"[a-z]+", near))
    up = any(w in words for w in RAISES[kind])
    down = any(w in words for w in LOWERS.get(kind, ()))
    return round(min(1.0, max(0.0, START[kind] + 0.3 * up - 0.3 * down)), 2)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans with scores: base ones always, proposals of the further kinds from the accepted score on."""
    base = base_spans(text)
    more = []
    if _DIGIT.search(text):
        taken = [(s, e) for _, s, e in base]
        for kind, spans in (("iban", _ibans(text)), ("local_phone", [m.span() for m in LOCAL_PHONE.finditer(text)])):
            for start, end in spans:
                if not any(start < e and s < end for s, e in taken):
                    more.append((kind, start, end))
    scored = [(*x, context_score(text, *x)) for x in base + more]
    return [x for x in scored if x[0] in BASE_KINDS or x[3] >= ACCEPT]


def redact(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at, until = [], 0, -1
    for kind, start, end, _ in sorted(find_spans(text), key=lambda x: (x[1], -x[2])):
        if start < until:
            until = max(until, end)
            at = max(at, end)
            continue
        out += [text[at:start], f"[{kind.upper()}]"]
        at = until = end
    return "".join(out) + text[at:]


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    join = lambda spans: ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in spans)
    for frame in frames:
        out = []
        for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
            spans = find_spans(text)
            base = [x for x in spans if x[0] in BASE_KINDS]
            counts = [sum(x[0] == k for x in base) for k in BASE_KINDS]
            out.append((doc_id, *counts, hashlib.sha256(join(base).encode()).hexdigest(), join(spans), max((x[3] for x in spans), default=0.0)))
        got = pd.DataFrame(out, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "score"])
        yield got


def scan_pii(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end), highest score.

    Whole texts, code points, ends exclusive. Null text counts as empty; a null doc_id stays null; repeated rows are
    documents of their own; an empty table gives no rows; further columns are ignored. Map-only.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, score double"
    return rows.mapInPandas(_scan, schema).withColumn("doc_id", outer_id())


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced; a null text stays null, n_chars follows the text."""

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redact(t))

    out = docs.withColumn("text", redacted("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
