"""Quality rules and licence scan."""

from __future__ import annotations

import itertools
import re
import textwrap
from collections import Counter

import pytest

from granary.llm.license_scan import MORE_SENTENCES, SENTENCES, hint_pattern, known_sentences, license_scan
from granary.llm.quality_rules import BASE, RULES, Text, estimate_order, first_rejection, keep_good, ordered, quality_report
from .conftest import texts


def plain_counts(text: str | None):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spans = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(spans)
    inside = {p for k, s in enumerate(spans) if often[s] > 1 for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(inside), failed,
    )


@pytest.mark.parametrize("table", ["odd", "documents", "none"])
def test_counts_equal_brute_force(table, request):
    df = request.getfixturevalue(table)
    found = quality_report(df).collect()
    assert Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found
    ) == Counter((i, *plain_counts(t)) for i, t in texts(df))
    assert not any(r.kept and r.base_failed for r in found)


def test_the_verdict_is_the_same_in_any_order(documents):
    sample = [Text(t.encode()) for _, t in texts(documents)[:60]]
    verdicts = {tuple(first_rejection(t, order) is None for t in sample) for order in itertools.permutations(RULES)}
    assert len(verdicts) == 1


def test_later_rules_are_not_evaluated():
    class Once(Text):
        def symbols(self):
            return 99

        def lines(self):
            raise AssertionError

    assert first_rejection(Once(b"a b c"), RULES) == "symbol_heavy"


def test_rules_order_by_rejections_and_cost(documents, none):
    names = [r.name for r in RULES]
    assert sorted(estimate_order(documents, RULES)) == sorted(names)
    assert estimate_order(none, RULES) == names
    assert [r.name for r in ordered(RULES, names[::-1])] == names[::-1]


def test_kept_rows_have_all_their_columns(odd, documents, none):
    kept = keep_good(documents)
    assert kept.columns == documents.columns
    verdicts = {r.doc_id: r.kept for r in quality_report(documents).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in verdicts.items() if k}
    assert keep_good(odd).columns == odd.columns and keep_good(none).count() == 0
    assert {r.doc_id for r in keep_good(odd, BASE[:1]).collect()} >= {6, 7}


def test_clean_documents_stay_and_junk_goes(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality_report(docs).join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)
    junk = [r.kept for r in rows if r.quality == 0]
    assert junk and sum(junk) <= 0.02 * len(junk)


MIT = "\n".join(["The MIT License (MIT)", "", "Copyright (c) 2001 Somebody", "", *SENTENCES["mit.grant"], "", *SENTENCES["mit.notice"], "", *SENTENCES["asis.software"]])


@pytest.mark.parametrize(
    ("text", "licenses", "unresolved"),
    [
        (MIT, "MIT", ""),
        (MIT.replace(" ", "\n "), "MIT", ""),
        ("Prose without a stop\nReleased under the MIT License.", "MIT", ""),
        ("Licensed under CC BY-NC 4.0. More. Licensed under the Apache License,\n   Version 2.0.", "Apache-2.0,CC-BY-NC-4.0", ""),
        ("# SPDX-License-Identifier: GPL-3.0-only\ncode", "GPL-3.0-only", ""),
        (SENTENCES["bsd.use"][0] + "\n" + SENTENCES["bsd.source"][0] + " " + SENTENCES["bsd.binary"][0], "BSD-2-Clause", ""),
        (SENTENCES["bsd.source"][0] + " " + SENTENCES["bsd.use"][0], "", "bsd.source|bsd.use"),
        ("All rights reserved.", "", "reserved"),
        ("A license to thrill, under the stars.", "", ""),
        ("", "", ""), (None, "", ""),
    ],
)
def test_licences(spark, text, licenses, unresolved):
    row = license_scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (row.licenses, row.unresolved) == (licenses, unresolved)


GPL = SENTENCES["gpl.free"][0].replace("software: ", "software:\n")
BSD = f"Copyright 2001 Some Body\n{SENTENCES['bsd.use'][0]}\n1. {SENTENCES['bsd.source'][0]}\n2. {SENTENCES['bsd.binary'][0]}"


@pytest.mark.parametrize(
    ("text", "licenses"),
    [
        (MIT, "MIT"),
        (MIT.replace("\n\n", "\n"), "MIT"),
        (f"Copyright (C) 2001 Some Body\n{GPL}\n{SENTENCES['gpl.hope'][0]}", "GPL-3.0-or-later"),
        (f"Copyright (c) 2001 Some Body\n\n{SENTENCES['isc.grant'][0]}", "ISC"),
        (BSD, "BSD-2-Clause"),
        (BSD.replace("\n1.", " 1.").replace("2.", "(b)"), "BSD-2-Clause"),
        ("SPDX-License-Identifier: GPL-2.0", "GPL-2.0"),
        ("SPDX-License-Identifier: LGPL-2.1+", "LGPL-2.1-or-later"),
    ],
)
def test_commented_headers(spark, text, licenses):
    lines = [y for x in text.split("\n") for y in (textwrap.wrap(x, 60) or [""])]
    forms = ["\n".join(lines)] + ["\n".join([*first, *(f"{mark} {x}".rstrip() for x in lines)]) + last for mark, first, last in (
        (" *", ["/*"], "\n */\nint main;"), ("#", ["#!/bin/sh"], "\ncode"), ("//", [], "\ncode"), ("REM", [], ""), ("", ["<!--"], "-->\n<p>")
    )]
    rows = license_scan(spark.createDataFrame(list(enumerate(forms)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.licenses, r.unresolved) for r in rows} == {k: (licenses, "") for k in range(len(forms))}


BSD3 = BSD + "\n3. Neither the name of {} may be used to endorse or promote products derived from this software without specific prior written permission."
APACHE = "\n\n".join(
    ["   Apache License\n   Version 2.0, January 2004\n   http://www.apache.org/licenses/", "TERMS AND CONDITIONS FOR USE",
     "1. Definitions.", *MORE_SENTENCES["apache2.define"], "2. Grant of Copyright License. " + MORE_SENTENCES["apache2.grant"][0],
     "END OF TERMS", SENTENCES["apache2.header"][0] + "\n" + SENTENCES["apache2.comply"][0] + "\n" + SENTENCES["apache2.copy"][2]]
)
GPL3 = "\n\n".join(
    ["GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "Copyright (C) 2007 Somebody\n" + MORE_SENTENCES["fsf.verbatim"][0],
     "Preamble", *MORE_SENTENCES["gpl3.preamble"], "How to Apply", GPL, *SENTENCES["gpl.hope"]]
)


@pytest.mark.parametrize(
    ("text", "licenses"),
    [
        (BSD3.format("Google Inc. nor the names of its contributors"), "BSD-3-Clause"),
        (BSD3.format("Acme, Ltd.\n   nor the names of its contributors"), "BSD-3-Clause"),
        (BSD + "\n3. The names of its authors may not be used to endorse or promote products derived from this software.", "BSD-3-Clause"),
        (BSD, "BSD-2-Clause"),
        (APACHE, "Apache-2.0"),
        (GPL3, "GPL-3.0"),
        ("This code is MIT licensed.", "MIT"),
        ("All source files are licensed under the terms of the BSD 3-Clause license. Enjoy.", "BSD-3-Clause"),
        ("Our little library is available under GPLv3.", "GPL-3.0"),
        ("The meeting is licensed under the fire code.", ""),
    ],
)
def test_names_in_slots_and_whole_texts(spark, text, licenses):
    row = license_scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (row.licenses, row.unresolved) == (licenses, "")


def test_every_known_sentence_has_a_hint(odd, none):
    known = known_sentences()
    assert all(re.search(hint_pattern(known), s) for s in known) and "" not in known
    rows = license_scan(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts(odd))
    assert license_scan(none).count() == 0
    assert "Python" not in license_scan(odd)._jdf.queryExecution().executedPlan().toString()
