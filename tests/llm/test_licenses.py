import textwrap

import numpy as np

from conftest import sentence
from scriptorium.llm import licenses
from scriptorium.llm.notices import SPDX


def test_families_on_the_small_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    cues = {"apache": "Apache License", "mit": "MIT License", "gpl": "GNU General Public License", "cc-by-nc": "CC BY-NC", "proprietary": "All rights reserved"}
    rows = {r.doc_id: r for r in licenses.op3_license(docs).collect()}
    wrong = 0
    for d in docs.collect():
        wrong += set(filter(None, rows[d.doc_id].families.split(","))) != {f for f, cue in cues.items() if cue.lower() in (d.text or "").lower()}
    assert len(rows) == docs.count() and wrong <= 1


def test_unknown_stays_unknown_and_long_lines_are_read(documents, rng):
    texts = {
        1: sentence(rng, 50) + "\nReleased under the MIT License.\n" + sentence(rng, 30),
        2: "the license of software is a topic of public debate this version",
        3: sentence(rng, 3000) + " Licensed under the Apache License, Version 2.0. " + sentence(rng, 500),
        4: None,
        5: "",
        6: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    }
    rows = {r.doc_id: r for r in licenses.op3_license(documents([*texts.items(), *[(100 + i, sentence(rng, 80)) for i in range(80)]])).collect()}
    assert [rows[i].families for i in range(1, 7)] == ["mit", "", "apache", "", "", "bsd"]
    assert all(rows[100 + i].n_notices == 0 for i in range(80))
    family, start, end = rows[1].spans.split(":")
    assert texts[1][int(start) : int(end)] == "Released under the MIT License"


def test_empty(documents):
    assert licenses.op3_license(documents([])).count() == 0


def commented(text, mark, width=58):
    return "\n".join(f"{mark} {line}" for line in textwrap.wrap(text, width))


#: Wordings as authors write them, none of them a template: wrapped, commented, reworded, with names and years.
HELD_OUT = {
    "gpl": "Foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2, or (at your option) any later version.",
    "agpl": "bar is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3, as published by the Free Software Foundation.",
    "lgpl": "The GNU Foo Library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License.",
    "apache": "Copyright 2021 The Foo Authors. Licensed under the Apache License, Version 2.0 (the 'License'); you may not use these files except in compliance with the License. You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Copyright (c) 1999, A. Nother. All changes kept. Redistribution and use of this software in source and binary forms, with or without modification, is permitted provided that the following conditions are met:",
    "mit": "Copyright (c) 2012 Foo Bar and others. Permission is hereby granted, free of charge, to any person obtaining a copy of this font software and associated documentation files, to deal in the software without restriction",
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this package, you can obtain one at mozilla.org",
    "epl": "All rights of others aside, this program and its accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution",
    "unlicense": "This is free and unencumbered software and data released into the public domain by its authors.",
    "zlib": "This library is provided 'as is', without any express or implied warranty. In no event will the author be held liable for any damages arising from the use of this software.",
    "cc-by-sa": "Unless noted, the text of this page is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License. To view a copy of this license, visit creativecommons.org/licenses/by-sa/3.0",
    "cc-by-nc": "Slides: this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International Licence, see the website",
    "cc0": "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this dataset.",
    "boost": "Copyright Foo 2004. Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at boost.org/LICENSE_1_0.txt)",
    "gfdl": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation",
    "cddl": "The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.0 only. You may not use this file except in compliance with the License.",
    "ofl": "This Font Software is licensed under the SIL Open Font License, Version 1.0. This license is available with a FAQ",
    "proprietary": "(c) Foo Inc. All rights reserved. No part of this book may be reproduced or transmitted in any form or by any means without written permission of the author.",
    "wtfpl": "This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar.",
}
CLEAN = [
    "You may not use this door except in an emergency. Staff may obtain a copy of the key at the front desk.",
    "The general public was free to redistribute food and clothing under the terms agreed with the foundation.",
    "He was granted permission to copy the painting for any purpose, which the museum later regretted.",
    "A license to fish is required by applicable law in most states, and conditions of any kind may be attached.",
    "Critics compared the apache helicopter with earlier models and the boost it gave to sales.",
    "All people have rights; seats are reserved for guests of the authors.",
]


def test_held_out_wordings(documents, rng):
    rows, truth = [], {}
    for i, (family, text) in enumerate(HELD_OUT.items()):
        for k, form in enumerate((text, commented(text, " *"), commented(text, "#", 44), f"{sentence(rng, 60)}\n\n{commented(text, '//')}\n\n{sentence(rng, 80)}")):
            rows.append((10 * i + k, form))
            truth[10 * i + k] = family
    rows += [(1000 + i, f"{sentence(rng, 30)} {t} {sentence(rng, 30)}") for i, t in enumerate(CLEAN)] + [(2000 + i, sentence(rng, 120)) for i in range(100)]
    found = {r.doc_id: set(filter(None, r.families.split(","))) for r in licenses.op3_license(documents(rows)).collect()}
    missed = [truth[i] for i in truth if truth[i] not in found[i]]
    wrong = [(truth.get(i), f) for i, f in found.items() if f - {truth.get(i)}]
    assert len(missed) <= 0.1 * len(truth), missed
    assert len(wrong) <= 0.03 * len(truth), wrong


def test_spdx_tags_nulls_ties_and_repeated_rows(documents, rng):
    tags = {f: f"// SPDX-License-Identifier: {x[0]}" for f, x in SPDX.items()}
    rows = [(i, f"{t}\n\n{sentence(rng, 40)}") for i, t in enumerate(tags.values())]
    both = "Released under the MIT License. Released under the MIT License.\n\nLicensed under the ISC License."
    rows += [(500, both), (500, both), (None, both), (None, None)]
    out = licenses.op3_license(documents(rows)).collect()
    by_id = {r.doc_id: r for r in out if r.doc_id is not None and r.doc_id < 500}
    assert sum(by_id[i].families == f for i, f in enumerate(tags)) >= len(tags) - 2
    twice = [r for r in out if r.doc_id == 500 or r.doc_id is None and r.families]
    assert len(twice) == 3 and {r.families for r in twice} == {"isc,mit"} and len({r.spans for r in twice}) == 1
    assert sum(r.doc_id is None for r in out) == 2


def test_spans_hold_the_notice_only(documents):
    text = "Ünïcode “words” first.\n\n/* Released under the MIT License. */\n\nlast words"
    (row,) = licenses.op3_license(documents([(1, text)])).collect()
    family, start, end = row.spans.split(":")
    assert (family, text[int(start) : int(end)]) == ("mit", "Released under the MIT License")


def test_long_words_are_hashed_whole():
    """Words of one length that begin alike, up to 24 bytes and beyond, differ; equal ones don't."""
    long = ["a" * 30 + "b", "a" * 30 + "c", "a" * 30 + "b", "a" * 24, "a" * 23 + "b", "x" * 5000]
    h = licenses.Words([licenses.encoded(" ".join(long))]).hash
    assert h[0] == h[2] and len(set(h.tolist())) == 5


def test_training_is_repeatable_and_accurate():
    rng = np.random.default_rng(77)
    plain = [licenses.text_words(f"plain words without any notice at all {i} seen in some text of the corpus") for i in range(30)]
    model = licenses.trained(plain)
    texts, labels = licenses.variants(rng, plain, licenses.templates())
    right = 0
    for t, y in zip(texts, labels, strict=True):
        z = sum(model.weights[b] for b in licenses.ngram_buckets(t, np.zeros(len(t), int))).sum(axis=0)
        right += z.argmax() == y
    assert right / len(texts) > 0.93
    assert (licenses.trained(plain).weights == model.weights).all()


def test_sample_of_the_unknown_class_covers_whole_texts(spark, documents, rng, monkeypatch):
    monkeypatch.setattr(licenses, "UNKNOWN", 5)
    docs = documents([(i, sentence(rng, 500)) for i in range(20)])
    got = sorted(w.tobytes() for w in licenses.unknown_passages(docs, "text"))
    every = {}
    for r in docs.collect():
        w = licenses.Words([licenses.encoded(r.text)])
        for _, a, b in zip(*w.passages(), strict=True):
            h = licenses.mixed(np.array([(w.hash[a:b] * np.uint64(2) + np.uint64(1)).sum(dtype=np.uint64)]))[0]
            every[int(h)] = w.hash[a:b].tobytes()
    assert got == sorted(every[h] for h in sorted(every)[:5])
