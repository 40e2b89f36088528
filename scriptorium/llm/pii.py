r"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, digit pairs, "+digit" and identifier cues.
A local parser grows each anchor to its span and validates it. Four kinds (email, ip, card, phone) have the meaning
of a leftmost, non-overlapping regular expression; two are added by the method: account (an identifier after a cue
such as "IBAN" or "token") and url (what surrounds "://").

Defined cases: a null text counts as empty; an empty text has no spans; texts are scanned whole and in linear time;
repeated rows and null ids give a row each; an empty table gives an empty result; other columns of the input, whatever
their names, play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "url")
#: Words that announce an identifier (fixed values of this project).
CUES = ("iban", "account", "acct", "passport", "ssn", "tax id", "token", "api key", "member id", "customer id")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DIGITS = "0123456789"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ACCOUNT = re.compile(r"""(?:\s+(?i:no|nr|number)\.?)?[\s:=#"']{1,4}([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,63})""")
WORD = re.compile(r"[A-Za-z0-9]+(?:-+[A-Za-z0-9]+)*")
URL_REST = re.compile(r"""[^\s"'<>]+""")


def automaton():
    """Anchors of lower-cased text and the kinds that they may open. Digit patterns come from a rule."""
    import ahocorasick

    found: dict[str, set[str]] = {"@": {"email"}, "://": {"url"}}
    for a in DIGITS:
        found.setdefault(f"+{a}", set()).add("phone")
        for b in DIGITS:
            found.setdefault(f"{a}.{b}", set()).add("ip")
            for gap in ("", " ", "-"):
                found.setdefault(f"{a}{gap}{b}", set()).add("card")
    for cue in CUES:
        found.setdefault(cue, set()).add("account")
    a = ahocorasick.Automaton()
    for word, kinds in found.items():
        a.add_word(word, (len(word), tuple(sorted(kinds))))
    a.make_automaton()
    return a


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    code = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in code)) % 97 == 1


def grow_left(text: str, at: int, floor: int, allowed) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def email(text: str, at: int, floor: int):
    """(next floor, span or None) for the at-sign at `at`."""
    start = grow_left(text, at, floor, LOCAL)
    m = DOMAIN.match(text, at + 1) if start < at else None
    return (m.end(), (start, m.end())) if m else (floor, None)


def ip(text: str, at: int, floor: int):
    m = IP.match(text, grow_left(text, at, floor, DIGITS))
    if not m:
        return floor, None
    # a part of more than 9 digits is over 255 unless it is zero-padded
    return m.end(), m.span() if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()) else None


def card(text: str, at: int, floor: int):
    """Anchors come in order, so the first one of a run lies at its start."""
    m = CARD.match(text, at)
    if not m:
        return floor, None
    number = m.group().replace(" ", "").replace("-", "")
    return m.end(), m.span() if 13 <= len(number) <= 19 and luhn(number) else None


def phone(text: str, at: int, floor: int):
    m = PHONE.match(text, at)
    if not m:
        return floor, None
    return m.end(), m.span() if 9 <= sum(c in DIGITS for c in m.group()) <= 15 else None


def account(text: str, at: int, floor: int, cue_end: int):
    """An identifier right after a cue, to the end of its word, if it holds at least four digits; an IBAN must pass its check digits."""
    m = ACCOUNT.match(text, cue_end)
    if not m:
        return floor, None
    start, value = m.start(1), m.group(1)
    code = re.sub(r"[ -]", "", value)
    if re.match(r"[A-Za-z]{2}[0-9]{2}", code):
        ends = [i for i, c in enumerate(value, start + 1) if c not in " -"]
        valid = [ends[n - 1] for n in range(min(34, len(code)), 14, -1) if iban_valid(code[:n])]
        if valid:  # the longest that ends with its word, else the longest, to the end of the word that it lies in
            end = next((i for i in valid if WORD.match(text, i - 1).end() == i), None) or WORD.match(text, valid[0] - 1).end()
            return end, (start, end)
    word = WORD.match(text, start)
    end = word.end()
    return (end, (start, end)) if end - start >= 6 and sum(c in DIGITS for c in word.group()) >= 4 else (floor, None)


def url(text: str, at: int, floor: int):
    start = grow_left(text, at, floor, SCHEME)
    while start < at and not (text[start].isascii() and text[start].isalpha()):
        start += 1
    m = URL_REST.match(text, at + 3) if start < at else None
    if not m:
        return floor, None
    end = at + 3 + len(m.group().rstrip(".,;:!?)]}"))
    return end, (start, end) if end > at + 3 else None


PARSERS = {"email": email, "ip": ip, "card": card, "phone": phone, "url": url}


def find_spans(text: str, anchors) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind in the order of KINDS, then by start."""
    out: dict[str, list[tuple[int, int]]] = {}
    floors = dict.fromkeys(KINDS, 0)
    for last, (n, kinds) in anchors.iter(text.replace("\u0130", "\u0131").lower()):  # the one letter that grows when lowered
        at = last - n + 1
        for kind in kinds:
            if at < floors[kind]:
                continue
            floors[kind], span = account(text, at, floors[kind], last + 1) if kind == "account" else PARSERS[kind](text, at, floors[kind])
            if span:
                out.setdefault(kind, []).append(span)
    return [(kind, a, b) for kind in KINDS for a, b in out.get(kind, ())]


SPAN_TYPE = "array<struct<kind:string,start:long,end:long>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): spans is an array of kind, start and end, in code points, end exclusive."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in it:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t or "", anchors)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, shape)], names=["id", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, f"id {kind}, spans {SPAN_TYPE}").withColumnRenamed("id", id_col)


def redact(text: str | None, anchors) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the earlier, then the longer, stands."""
    if not text:
        return text
    out, floor = [], 0
    for kind, start, end in sorted(find_spans(text, anchors), key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if start >= floor:
            out += [text[floor:start], f"[{kind.upper()}]"]
            floor = end
        elif end > floor:  # what the earlier span does not cover
            floor = end
    return "".join([*out, text[floor:]])


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in the text column replaced; all columns stay, nulls stay null."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for b in it:
            text = pa.array([redact(t, anchors) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], text, *b.columns[at + 1 :]], schema=pa.schema([f if i != at else pa.field(f.name, pa.string()) for i, f in enumerate(b.schema)]))

    return docs.mapInArrow(batches, docs.schema)


def op1_pii(docs: DataFrame) -> DataFrame:
    """The contract's digest columns, derived from the spans that find_pii returns."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return find_pii(docs).select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(spans).alias("spans"), count("account"), count("url"))


