"""Licenses by whole texts, reworded texts and notices, with the right version."""

import random

import brute
from creditloom.llm import license_templates, licenses

TEMPLATES = license_templates.templates()
WHOLE = {f.stem: f.read_text(encoding="utf-8") for f in license_templates.TEXTS.glob("*.txt")}

NOTICES = {
    "Licensed under Apache License 2.0": {"apache-2.0"},
    "It is distributed under the MIT license, see there.": {"mit"},
    "This work is licensed under the GNU General Public License, version 3.": {"gpl-3.0"},
    "This work is licensed under the GNU General Public License version 2": {"gpl-2.0"},
    "released under the terms of the GNU Lesser General Public License as published by the Free "
    "Software Foundation; either version 2.1 of the License, or (at your option) any later version.": {"lgpl-2.1"},
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
    "the MPL was not distributed with this file, You can obtain one at x": {"mpl-2.0"},
    "# SPDX-License-Identifier: BSD-3-Clause": {"bsd-3-clause"},
    "// SPDX-License-Identifier: GPL-2.0-or-later\n": {"gpl-2.0"},
    "All text is under CC BY-SA 4.0.": {"cc-by-sa-4.0"},
    "All text is under CC BY-NC 4.0.": {"cc-by-nc-4.0"},
    "under the Apache License, Version 1.1": set(),
    "under the license of the city": set(),
    "": set(),
}


def found(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = licenses.find_licenses(docs, **options).collect()
    out = {i: {} for i in range(len(texts))}
    for r in rows:
        out[r.doc_id][r.license] = (r.containment, r.word_start, r.word_end)
    return out


def reworded(text, share, seed):
    """``share`` of the words of a text replaced."""
    rng = random.Random(seed)
    return " ".join("zzz" if rng.random() < share else x for x in text.split())


def test_notices(spark):
    got = found(spark, list(NOTICES))
    assert [set(got[i]) for i in range(len(got))] == list(NOTICES.values())


def test_whole_texts(spark):
    """Each whole text is found as itself, and a version never as another one."""
    names = sorted(WHOLE)
    got = found(spark, [f"some words before {WHOLE[n]} and behind" for n in names])
    for i, name in enumerate(names):
        assert got[i].get(name, (0,))[0] == 1, name
        family = name.rsplit("-", 1)[0]
        assert not {x for x in got[i] if x.startswith(family + "-")} - {name}, name
    assert set(got[names.index("bsd-3-clause")]) == {"bsd-3-clause"}


def test_reworded_texts_equal_brute_force(spark):
    """Recall over texts with one word of 40 replaced is 0.9 or more, and nothing differs."""
    texts = [(n, f"{'a b c ' * s}{reworded(WHOLE[n], 0.025, s)}") for n in sorted(WHOLE) for s in range(2)]
    got = found(spark, [x for _, x in texts])
    want = brute.licenses([(i, x) for i, (_, x) in enumerate(texts)], TEMPLATES)
    assert {(i, n): v for i, x in got.items() for n, v in x.items()} == want
    assert sum(n in got[i] for i, (n, _) in enumerate(texts)) >= 0.9 * len(texts)


def test_templates_of_one_and_two_words(spark):
    few = spark.createDataFrame([("a", "free"), ("b", "no rights"), ("b", "none"), (None, "x")], "license string, text string")
    got = found(spark, ["Free! No rights. none", "rights no", "x free free"], templates=few)
    assert {i: set(x) for i, x in got.items()} == {0: {"a", "b"}, 1: set(), 2: {"a"}}
    assert got[0]["b"] == (1.0, 1, 3)
