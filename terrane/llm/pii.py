"""Personal data by anchor expansion: one automaton finds anchors, small parsers expand and check around them.

Anchors are at-signs, digit-dot-digit, plus-digit, digits, schemes and cue words. Each parser reads from its
anchor to the ends of the run its characters allow and never reads a run twice, so the work is linear in
the text whatever it holds. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrane.llm.common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret", "url")
SPANS = "array<struct<kind:string,start:int,end:int>>"
_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED, _GROUPED = frozenset("0123456789."), frozenset("0123456789 -")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOT_RUN, _GROUP_RUN = re.compile(r"[0-9.]*"), re.compile(r"[0-9\x20-]*")
_URL_RUN, _HOST = re.compile(r"[^\s<>\"'|]*"), re.compile(r"[^/?#]*")
_URL_END = frozenset(".,;:!?)]}")
_GAP = re.compile(r"(?:[\x20\t]*(?:number|no\.?|nr\.?|#|:|=|is))*[\x20\t]*", re.I)
_ACCOUNT = re.compile(r"[A-Za-z0-9](?:[\x20-]?[A-Za-z0-9]){5,40}")
_SECRET = re.compile(r"[\x20\t]*[=:][\x20\t]*(?:\"([^\"\s]{6,})\"|'([^'\s]{6,})'|([^\s\"']{6,}))")
_KEY_ID = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
_ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")
_SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey")
_SCHEMES = ("http://", "https://", "ftp://", "sftp://")


@lru_cache(None)
def _automaton():
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    for d in _DIGITS:
        a.add_word(d, ("card", 1))
        a.add_word(f"+{d}", ("phone", 2))
        for e in _DIGITS:
            a.add_word(f"{d}.{e}", ("ip", 3))
    for s in _SCHEMES:
        a.add_word(s, ("url", len(s)))
    a.add_word("AKIA", ("key", 4))
    for kind, cues in (("account", _ACCOUNT_CUES), ("secret", _SECRET_CUES)):
        for c in cues:
            for form in {c, c.capitalize(), c.upper()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban(value: str) -> bool:
    if not 15 <= len(value) <= 34 or not (value[:2].isalpha() and value[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _left(text: str, at: int, allowed: frozenset, stop: int) -> int:
    while at > stop and text[at - 1] in allowed:
        at -= 1
    return at


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans of all kinds, by kind as in KINDS and then by start."""
    out: list[tuple[str, int, int]] = []
    done = dict.fromkeys((*KINDS, "key"), 0)  # no parser reads before this place again
    run = tail = 0                            # end of the last run of a url, without and with its punctuation cut
    for last, (kind, length) in _automaton().iter(text):
        at = last - length + 1
        if at < done[kind]:
            continue
        if kind == "card":
            lo, hi = _left(text, at, _GROUPED, done[kind]), _GROUP_RUN.match(text, at).end()
            for m in _CARD.finditer(text, lo, hi):
                if m.end() - m.start() >= 16:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out.append((kind, m.start(), m.end()))
            done[kind] = hi
        elif kind == "email":
            lo, m = _left(text, at, _LOCAL, done[kind]), _DOMAIN.match(text, at + 1)
            if lo < at and m:
                out.append((kind, lo, m.end()))
                done[kind] = m.end()
        elif kind == "ip":
            lo, hi = _left(text, at, _DOTTED, done[kind]), _DOT_RUN.match(text, at).end()
            for m in _CHAIN.finditer(text, lo, hi):
                parts, place = m.group().split("."), m.start()
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k:k + 4]
                    end = place + sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                        out.append((kind, place, end))
                    place = end + 1
            done[kind] = hi
        elif kind == "phone":
            m = _PHONE.match(text, at)
            if m:
                done[kind] = m.end()
                if 8 <= sum(c in _DIGITS for c in m.group()) <= 15:
                    out.append((kind, at, m.end()))
        elif kind == "url":
            # all schemes of a run share its end; a host ends at a slash, so at the next scheme at the latest
            if last + 1 >= run:
                run = _URL_RUN.match(text, last + 1).end()
                tail = run
                while tail > last + 1 and text[tail - 1] in _URL_END:
                    tail -= 1
            end = max(last + 1, tail)
            host = _HOST.match(text, last + 1, end).group()
            if "." in host.strip("."):
                out.append((kind, at, end))
                done[kind] = end
        elif kind == "account":
            m = _ACCOUNT.match(text, _GAP.match(text, last + 1).end())
            if m:
                value = re.match(r"(?:[A-Za-z]{2})?[0-9][0-9A-Z\x20-]*", m.group())
                value = value.group().rstrip(" -") if value else ""
                plain = value.replace(" ", "").replace("-", "")
                if iban(plain.upper()) or (plain.isdigit() and 6 <= len(plain) <= 17):
                    out.append((kind, m.start(), m.start() + len(value)))
                    done[kind] = m.start() + len(value)
        elif kind == "secret":
            m = _SECRET.match(text, last + 1)
            if m:
                group = next(g for g in (1, 2, 3) if m.group(g))
                out.append((kind, m.start(group), m.end(group)))
                done[kind] = m.end()
        else:
            m = _KEY_ID.match(text, last + 1)
            if m and (at == 0 or not text[at - 1].isalnum()):
                out.append(("secret", at, m.end()))
                done[kind] = m.end()
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(out), key=lambda s: (order[s[0]], s[1], s[2]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span becomes ``[KIND]``; overlapping spans become one, named after the one that starts first."""
    out, at = [], 0
    merged: list[list] = []
    for kind, s, e in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] if t else [] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id and ``spans``. Null and empty texts have none; other columns are not read."""
    return docs.select("doc_id", "text").mapInArrow(_span_batches, f"doc_id {dict(docs.dtypes)['doc_id']}, spans {SPANS}")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind, and ``n_chars`` (if there) counted again.

    Null texts stay null. No row is dropped, and other columns pass as they are.
    """
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            at = b.schema.get_field_index("text")
            old = b.column(at).to_pylist()
            new = [redact(t, s) if t and (s := find(t)) else t for t in old]
            b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            count = b.schema.get_field_index("n_chars")
            if count >= 0 and pa.types.is_integer(b.schema.field(count).type):
                sizes = [len(n) if n is not o and n is not None else c for n, o, c in zip(new, old, b.column(count).to_pylist())]
                b = b.set_column(count, b.schema.field(count), pa.array(sizes, b.schema.field(count).type))
            yield b

    return docs.mapInArrow(batches, docs.schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
