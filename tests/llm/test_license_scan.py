import pytest

from corpuslens.llm import license_scan as ls

APACHE = """/*
 * Copyright (c) 2020 Some Body
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def found(text):
    hits, left = ls.recognised(ls.known(text))
    return [h[0] for h in hits], left


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        ("the word license alone, in permission to nobody.", []),
        ("Released under the MIT License.", ["MIT"]),
        ("x | y\nLicensed under CC BY-NC 4.0.\nz", ["CC-BY-NC"]),
        ("One. This work is licensed under the GNU General Public License, version 3. Two.", ["GPL-3"]),
        ("Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", ["Apache-2.0", "MIT"]),
        ("All rights reserved.", ["all-rights-reserved"]),
        ("Copyright 2019 Foo\nAll rights reserved.", ["all-rights-reserved"]),
        ("// SPDX-License-Identifier: Apache-2.0\nint x;", ["SPDX-APACHE-2.0"]),
        (APACHE, ["copyright", "Apache-2.0"]),
        (MIT, ["MIT"]),
        ("word " * 60_000 + "\nReleased under the MIT License.\n" + "word\n" * 60_000, ["MIT"]),
    ],
)
def test_texts(text, want):
    assert found(text) == (want, [])


def test_order_gaps_and_leftover():
    parts = MIT.split("\n\n")
    assert found("\n\n".join(parts)) == (["MIT"], [])
    assert found("\n\n".join([parts[0], "Between. Them. Both.", *parts[1:]])) == (["MIT"], [])
    assert found("\n\n".join([parts[0], *["Other sentence."] * 9, *parts[1:]]))[0] == []
    assert found(parts[2])[1] == ["mit-as-is"]


def test_every_known_sentence_has_an_anchor():
    assert ls.tables_hold()


def test_spans_and_rows(spark):
    text = "é😀 x.\nReleased under the MIT License.\nend"
    rows = [(1, text), (1, text), (None, None), (2, ""), (3, "clean text")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, licenses int")
    out = ls.licenses(df).collect()
    assert sorted(str((r.doc_id, r.licenses)) for r in out) == sorted(str((i, ["MIT"] if t == text else [])) for i, t in rows)
    hit = next(r.hits[0] for r in out if r.hits)
    assert text[hit.start : hit.end] == "Released under the MIT License."
    assert ls.licenses(df.limit(0)).collect() == []


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the X Corp. nor the names of its contributors may be used to endorse or promote products
   derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details."""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Boost Software License", ["BSL"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("made available under EPL 2.0", ["EPL-2.0"]),
        ("MIT license (see LICENSE)", ["MIT"]),
        ("dual-licensed under MIT or Apache-2.0", ["Apache-2.0", "MIT"]),
        ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA"]),
        ("Licence: GPLv3, not GPL v2. License GPL v3 or later", ["GPL-3", "GPL-3-or-later"]),
        ("Copyright 2019 " + "Some Body and " * 100 + "others\nrest", ["copyright"]),
        ("Copyright (c) Some Body. All rights reserved.", ["all-rights-reserved"]),
        ("\n".join(MIT.split()), ["MIT"]),
        ("\n".join("//" + " " * 90 + w for w in MIT.split()), ["MIT"]),
        (BSD, ["BSD-3-Clause"]),
        (GPL, ["GPL-3-or-later"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", ["MPL-2.0"]),
        ("a software company with a permission to license nothing, in the domain of copyright law", []),
        ("The MIT campus is under repair. Apache helicopters; the BSD of it.", []),
    ],
)
def test_more_licences(text, want):
    assert sorted(found(text)[0]) == want


def naive_known(tables, text):
    """By definition: at every word, from left to right, the longest of all sentences that the words go on with."""
    every = [k for ks in tables.sentences.values() for k in ks]
    w = [x for x, _, _ in ls.words(text)]
    out, i = [], 0
    while i < len(w):
        fits = [(s, slot, name) for s, slot, name in every if i + len(s) <= len(w) and all(k == slot or a == b for k, (a, b) in enumerate(zip(s, w[i:], strict=False)))]
        best = max(fits, key=lambda f: len(f[0]), default=None)
        if best:
            out.append((best[2], "" if best[1] is None else w[i + best[1]]))
        i += len(best[0]) if best else 1
    return out


def naive_rules(tables, found):
    """By definition: each rule in turn, at each unused hit in turn, on copies of what is left."""
    left, out = list(found), []
    for licence, rule in tables.rules:
        i = 0
        while i + len(rule) <= len(left):
            part = left[i : i + len(rule)]
            ids = all(w == f[4] and not (f[5] and w.endswith("-ref")) or w.endswith("-*") and w[:-2] == f[4] and f[5] for w, f in zip(rule, part, strict=True))
            near = all(b[0] - a[1] - 1 <= ls.MOST_BETWEEN for a, b in zip(part, part[1:], strict=False))
            if ids and near:
                value = [f[5] for w, f in zip(rule, part, strict=True) if w.endswith("-*")]
                out.append((licence.replace("*", value[-1] if value else ""), part[0][2], part[-1][3]))
                del left[i : i + len(rule)]
            else:
                i += 1
    return sorted(out, key=lambda x: (x[1], x[2], x[0])), [ls.written(f) for f in left]


@pytest.mark.parametrize("seed", range(12))
def test_random_texts_by_brute_force(seed):
    import random

    rng, tables = random.Random(seed), ls.standard()
    pieces = [s.replace("{v}", rng.choice("123")) for name, s in ls.SENTENCES if name != "or-later-{v}"] + ["Nothing is known here.", "Other words. Yet more of them.", "the software is", "Permission is hereby granted free of"]
    runs = [[s.replace("{v}", "3") for n, s in ls.SENTENCES if any(n == w or n == w.replace("-*", "-{v}") for w in rule)] for _, rule in ls.RULES]
    text = ""
    for _ in range(60):
        for s in rng.choice(runs) if rng.random() < 0.5 else [rng.choice(pieces)]:
            text += (s.upper() if rng.random() < 0.3 else s.replace(" ", "\n  * ") if rng.random() < 0.3 else s) + rng.choice([". ", "\n\n", "\n", " x. y. z. v. w. "])
    found = tables.known(text)
    exact = [(f[4], f[5]) for f in found if not f[4].endswith("-ref")]
    assert exact == naive_known(tables, text) and len(exact) > 50
    assert tables.recognised(found) == naive_rules(tables, found)


@pytest.mark.parametrize("part", ["Released under the MIT License. ", "permission is hereby ", "Copyright 2019 ", "(c) license under the ", "software\n\n"])
def test_very_many_hits_take_linear_time(part):
    import time

    t = time.time()
    found(part * 30_000)
    assert time.time() - t < 15


def test_further_texts_are_rules_of_their_own(spark):
    own = "The bearer of this license may read. Nobody else may copy the software! All warranties are void."
    df = spark.createDataFrame([(1, "x. " + own.replace(" ", "\n") + " y"), (2, own[:30])], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, len(r.sentences)) for r in ls.licenses(df, {"House-1": own}).collect()}
    assert got == {1: (["House-1"], 3), 2: ([], 0)}
