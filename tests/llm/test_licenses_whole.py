"""Notices that were lost: the short proprietary form, and notices wrapped over lines."""

from conftest import sentence
from scriptorium.llm import licenses

CUES = {"apache": "Apache License", "mit": "MIT License", "gpl": "GNU General Public License", "cc-by-nc": "CC BY-NC", "proprietary": "All rights reserved"}


def test_all_families_on_the_small_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r for r in licenses.op3_license(docs).collect()}
    truth = {d.doc_id: {f for f, cue in CUES.items() if cue.lower() in (d.text or "").lower()} for d in docs.collect()}
    assert any("proprietary" in t for t in truth.values())
    assert {i for i, t in truth.items() if set(filter(None, rows[i].families.split(","))) != t} == set()


def test_short_proprietary_notice(documents, rng):
    texts = [(1, sentence(rng, 40) + "\nAll rights reserved.\n" + sentence(rng, 30)), (2, "Copyright 2019 Example. All rights reserved."), (3, "all of the rights of the people are reserved for later chapters of this book")]
    rows = {r.doc_id: r.families for r in licenses.op3_license(documents([*texts, *[(100 + i, sentence(rng, 80)) for i in range(80)]])).collect()}
    assert (rows[1], rows[2]) == ("proprietary", "proprietary") and not any(rows[100 + i] for i in range(80))


def test_notices_wrapped_over_lines(documents, rng):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    texts = [(1, gpl), (2, bsd), (3, sentence(rng, 60) + "\n\n" + gpl + "\n\n" + sentence(rng, 60))]
    rows = {r.doc_id: r for r in licenses.op3_license(documents([*texts, *[(100 + i, "\n".join(sentence(rng, 9) for _ in range(9))) for i in range(80)]])).collect()}
    assert [rows[i].families for i in (1, 2, 3)] == ["gpl", "bsd", "gpl"] and not any(rows[100 + i].families for i in range(80))
