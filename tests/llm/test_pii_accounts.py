"""Account spans run to the end of their word, after cues in any case."""

from scriptorium.llm import pii

ANCHORS = pii.automaton()


def accounts(text):
    return [text[a:b] for k, a, b in pii.find_spans(text, ANCHORS) if k == "account"]


def test_long_keys_are_taken_whole():
    for key in ("3fdf5a35c7b8d733c0b5" * 10, "ab12" + "0f3c9d" * 30, "sk-" + "a1b2c3d4" * 20, "1234-" * 40 + "5", "GB82WEST12345698765432" + "abc123" * 20):
        assert accounts(f"token: {key}. And more.") == [key]
        assert pii.redact(f"my token: {key}, yes", ANCHORS) == "my token: [ACCOUNT], yes"
    assert accounts("IBAN: GB82 WEST 1234 5698 7654 32 see below") == ["GB82 WEST 1234 5698 7654 32"]
    assert accounts("IBAN: GB82 WEST 1234 5698 7654 32xyz") == ["GB82 WEST 1234 5698 7654 32xyz"]


def test_cues_in_every_case():
    for cue in pii.CUES:
        for form in {cue, cue.upper(), cue.title(), cue.capitalize(), cue.swapcase(), cue[0].upper() + cue[1:-1] + cue[-1].upper()} | {"API key", "Tax ID", "Member ID", "Customer ID", "Account No.", "Passport Number"}:
            assert accounts(f"the {form}: 4471920x-88 is old") == ["4471920x-88"], form


def test_lowering_keeps_places():
    text = "İİ İSTANBUL API key: 99AB1234 and a@b.co İ Token 12345678"
    assert accounts(text) == ["99AB1234", "12345678"]
    assert [text[a:b] for k, a, b in pii.find_spans(text, ANCHORS) if k == "email"] == ["a@b.co"]


def test_redaction_of_the_usual_spellings(documents):
    out = pii.redact_pii(documents([(1, "API key: " + "9f8e7d6c" * 12 + " end"), (2, "Customer ID 00123456")]))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "API key: [ACCOUNT] end", 2: "Customer ID [ACCOUNT]"}
