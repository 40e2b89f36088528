import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import pii

ANCHORS = pii.automaton()


def plain_spans(text):
    """The contract's definition, by regular expressions."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m.group())]


def base(text):
    return [s for s in pii.find_spans(text, ANCHORS) if s[0] in pii.BASE_KINDS]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="019+-. ()@a_Zé\n:/5", max_size=60))
def test_base_spans_equal_the_regular_expressions(text):
    assert base(text) == plain_spans(text)


def test_fixed_cases():
    for text in ("a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "300.1.1.1 1.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (040) 555-0631", "a@@b.co x@y", "é@a.b", "+1+22 333 444 555", "٣@b.c"):
        assert base(text) == plain_spans(text)


def test_added_kinds():
    text = "IBAN: GB82 WEST 1234 5698 7654 32 see https://example.com/a?b=1. token = \"3fdf5a35c7b8d733c0b5\" the account is open"
    found = {k: text[a:b] for k, a, b in pii.find_spans(text, ANCHORS)}
    assert found["account"] in ("GB82 WEST 1234 5698 7654 32", "3fdf5a35c7b8d733c0b5") and found["url"] == "https://example.com/a?b=1"


def test_query_and_nulls(documents):
    texts = {1: "mail a@b.co or 10.0.0.1", 2: None, 3: "", 4: "x" * 300_000 + " a@b.co", 5: "😀 a@b.co"}
    rows = {r.doc_id: r for r in pii.op1_pii(documents(texts.items())).collect()}
    for i, t in texts.items():
        spans = plain_spans(t or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert rows[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest() and rows[i].n_email == sum(k == "email" for k, *_ in spans)
    assert pii.op1_pii(documents([])).count() == 0
    assert pii.op1_pii(documents([(1, "a@b.co")] * 3)).count() == 3


def test_whole_table_equals_the_definition(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.op1_pii(docs).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(texts[r.doc_id] or "")).encode()).hexdigest()


def test_redaction(documents):
    out = pii.redact_pii(documents([(1, "mail a@b.co now"), (2, None), (3, "")]))
    assert out.columns == documents([]).columns and {r.doc_id: r.text for r in out.collect()} == {1: "mail [EMAIL] now", 2: None, 3: ""}
