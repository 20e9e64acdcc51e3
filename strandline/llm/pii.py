"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs (also written out), plus signs, digits, URL schemes
and identifier cues. At each anchor a deterministic parser of the kind it announces expands to the
left and right, bounded by the spans before, and validates: digit counts, Luhn and mod-97 sums, octets.

Kinds email, ip, card and phone have exactly the leftmost non-overlapping matches of their patterns;
account, secret and url are added by their cues.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spread

KINDS = ("email", "ip", "card", "phone", "account", "secret", "url")
BASE = KINDS[:4]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
SPELLED = re.compile(r"[ ]?[A-Za-z0-9-]+(?:[ ]?(?:\.|\[dot\]|\(dot\))[ ]?[A-Za-z0-9-]+)+")
OCTETS = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[ :#.]{0,3}([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
SSN = re.compile(r"[ :#.]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
NUMBER = re.compile(r"(?:[ ]?(?:no|nr|number|id)\b)?[ :#.=]{1,4}([A-Z0-9][A-Z0-9-]{4,22}[A-Z0-9])(?![A-Za-z0-9-])")
VALUE = re.compile(r"[ ]?[=:][ ]?['\"]?([^\s'\"&,;]{6,})")
AWS = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
STOP = re.compile(r"[\s/@]")
USERINFO = re.compile(r"[^\s/@:]+(?::[^\s/@]+)?@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>,;]*)?")

#: Cues by the parser that they announce; each also with its first or all letters in upper case.
CUES = {
    "spelled": ("[at]", "(at)"),
    "iban": ("iban",),
    "ssn": ("ssn", "social security number", "social security"),
    "number": ("account", "acct", "passport", "customer id", "member id", "tax id"),
    "value": ("password", "passwd", "api_key", "apikey", "secret_key", "access_token"),
    "aws": ("AKIA",),
    "scheme": ("http://", "https://", "ftp://", "mailto:"),
}


def anchors() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for c in "0123456789":
        auto.add_word(c, ("digit", 1))
    auto.add_word("@", ("at", 1))
    auto.add_word("+", ("plus", 1))
    for kind, cues in CUES.items():
        for c in cues:
            for form in {c} if kind == "aws" else {c, c.capitalize(), c.upper()}:
                auto.add_word(form, (kind, len(c)))
    auto.make_automaton()
    return auto


def luhn(digits: str) -> bool:
    own = sum(map(int, digits[-1::-2]))
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (own + twice) % 10 == 0


def octet(digits: str) -> bool:
    """At most 255; zeros may lead, any number of them."""
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _left(text: str, at: int, bound: int) -> int:
    """Start of the run of local-part characters that ends before ``at``."""
    i = at
    while i > bound and text[i - 1] in LOCAL:
        i -= 1
    return i


def find(text: str | None, auto: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by kind as listed, then by start."""
    if not text:
        return []
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end = dict.fromkeys(("email", "ip", "card", "phone", "run", "spelled", "number", "value"), 0)
    run = (-1, -1)
    for last, (kind, n) in auto.iter(text):
        at = last - n + 1
        if kind == "digit":
            if at >= end["run"]:  # the first digit of a run starts octets
                if m := OCTETS.match(text, at) if at >= end["ip"] else None:
                    end["ip"] = m.end()
                    if all(octet(x) for x in m.groups()):
                        out["ip"].append(m.span())
                i = at + 1
                while i < len(text) and "0" <= text[i] <= "9":
                    i += 1
                end["run"] = i
            if at >= end["card"] and (m := DIGITS.match(text, at)):
                end["card"] = m.end()
                if m.end() - m.start() <= 38:
                    d = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(d) <= 19 and luhn(d):
                        out["card"].append(m.span())
        elif kind == "at":
            if (i := _left(text, at, end["email"])) < at and (m := DOMAIN.match(text, at + 1)):
                out["email"].append((i, m.end()))
                end["email"] = m.end()
        elif kind == "plus":
            if at >= end["phone"] and (m := PHONE.match(text, at)):
                end["phone"] = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out["phone"].append(m.span())
        elif kind == "spelled":
            gap = at - 1 if at and text[at - 1] == " " else at
            if (i := _left(text, gap, end["spelled"])) < gap and (m := SPELLED.match(text, last + 1)):
                out["email"].append((i, m.end()))
                end["spelled"] = m.end()
        elif at and text[at - 1].isalnum():
            continue  # a cue within a word
        elif kind == "iban" and (m := IBAN.match(text, last + 1)) and mod97(m.group(1)) or kind == "ssn" and (m := SSN.match(text, last + 1)):
            out["account"].append(m.span(1))
        elif kind == "number":
            if at >= end["number"] and (m := NUMBER.match(text, last + 1)) and sum(c.isdigit() for c in m.group(1)) >= 5:
                out["account"].append(m.span(1))
                end["number"] = m.end()
        elif kind == "value":
            if at >= end["value"] and (m := VALUE.match(text, last + 1)):
                out["secret"].append(m.span(1))
                end["value"] = m.end()
        elif kind == "aws" and (m := AWS.match(text, at)):
            out["secret"].append(m.span())
        elif kind == "scheme":
            if not run[0] <= last < run[1]:  # user data end at the next of these, which is sought once
                stop = STOP.search(text, last + 1)
                run = (last, stop.start() if stop else len(text))
            if text[run[1] : run[1] + 1] == "@" and (m := USERINFO.match(text, last + 1)):
                out["url"].append((at, m.end()))
    return [(k, a, b) for k in KINDS for a, b in sorted(set(out[k]))]


def base_spans(spans: list[tuple[str, int, int]], text: str | None) -> list[tuple[str, int, int]]:
    """Spans of the base patterns; an at-sign that is written out is an addition."""
    return [(k, a, b) for k, a, b in spans if k in BASE and (k != "email" or "@" in text[a:b])]


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Each maximal run of spans becomes its first kind in angle brackets."""
    if not text or not spans:
        return text
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


FOUND = "struct<spans:array<struct<kind:string,lo:bigint,hi:bigint,base:boolean>>,told:string,base_told:string,redacted:string>"


def with_pii(rows: DataFrame, text_col: str, redacted: bool = False) -> DataFrame:
    """``rows`` with a struct column ``_pii``; null and empty texts have no spans, texts of any length are scanned whole."""
    kind = pa.struct([("spans", pa.list_(pa.struct([("kind", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("base", pa.bool_())]))), ("told", pa.string()), ("base_told", pa.string()), ("redacted", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = anchors()
        for b in batches:
            found = []
            for t in b.column(b.schema.get_field_index(text_col)).to_pylist():
                spans = find(t, auto)
                base = base_spans(spans, t)
                own = set(base)
                found.append({"spans": [{"kind": s[0], "lo": s[1], "hi": s[2], "base": s in own} for s in spans], "told": told(spans), "base_told": told(base), "redacted": redact(t, spans) if redacted else None})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "_pii"])

    return map_arrow(rows, run, rows.withColumn("_pii", F.lit(None).cast(FOUND)).schema)


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all of them),
    and n_account, n_secret, n_url and n_spelled (written-out addresses), which are additions.

    Null and empty texts have no spans. Texts are scanned whole; every kind's scan starts behind its last match.
    """
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")))
    p = F.col("_pii")
    n = lambda k: F.size(F.filter(p["spans"], lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    more = lambda k, name: F.size(F.filter(p["spans"], lambda s: ~s["base"] & (s["kind"] == k))).cast("long").alias(name)
    added = [*[more(k, f"n_{k}") for k in KINDS[len(BASE) :]], more("email", "n_spelled")]
    return with_pii(rows, "_text").select("doc_id", *[n(k) for k in BASE], F.sha2(p["base_told"], 256).alias("base_sha256"), p["told"].alias("spans"), *added)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by its kind; all other columns as they were."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    found = with_pii(docs.select(row, F.col(text_col).alias("_text")), "_text", redacted=True)
    return found.select(*[F.col("_pii.redacted").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns])


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(told(spans).encode()).hexdigest()
