"""Licence scan: known sentences first, then ordered rules over their sequence."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import quoted

# Sentences of public licence texts and notices, by identifier.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit.short": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "This software is released under the MIT License.",
        "This work is licensed under the MIT License.",
        "Distributed under the MIT License.",
    ),
    "mit.title": ("The MIT License", "The MIT License (MIT)", "MIT License"),
    "mit.grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "mit.notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "asis.software": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "apache2.short": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "Licensed under the Apache License 2.0.",
        "This project is licensed under the Apache License, Version 2.0.",
        "This work is licensed under the Apache License, Version 2.0.",
        "Distributed under the Apache License, Version 2.0.",
    ),
    "apache2.header": ("Licensed under the Apache License, Version 2.0 (the \"License\");",),
    "apache2.comply": ("you may not use this file except in compliance with the License.",),
    "apache2.copy": (
        "You may obtain a copy of the License at",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "gpl3.short": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
        "Released under the GNU General Public License v3.0.",
        "Licensed under the GNU GPLv3.",
        "Released under the GNU GPLv3.",
    ),
    "gpl2.short": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "Released under the GNU General Public License, version 2.",
    ),
    "lgpl3.short": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ),
    "agpl3.short": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "gpl.free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "gpl.free2": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",),
    "gpl.either2": ("either version 2 of the License, or (at your option) any later version.",),
    "gpl.hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",),
    "bsd.use": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd.source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd.binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd.name": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "bsd2.short": ("Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License."),
    "bsd3.short": ("Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."),
    "isc.grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "mpl2.short": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Released under the Mozilla Public License, version 2.0.",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "reserved": ("All rights reserved.",),
}
# Names of notices of one form, "Licensed under <name>." and the like.
NAMED = {
    "CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0", "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-ND-4.0": "CC BY-ND 4.0", "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0": "CC BY-NC-ND 4.0", "CC0-1.0": "CC0 1.0",
}
NAMED_FORMS = (
    "Licensed under {}.", "Released under {}.", "This work is licensed under {}.",
    "Published under {}.", "Available under {}.", "Licensed under a {} license.",
)
# Identifiers in tag lines, "SPDX-License-Identifier: <id>".
TAGGED = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "LGPL-3.0-only", "AGPL-3.0-only", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Unlicense", "CC0-1.0",
)
#: Licence and the sentences that prove it, in order. Earlier rules go first and
#: use their sentences up, so a whole text is not also found as a part of itself.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit.title", "mit.grant", "mit.notice", "asis.software")),
    ("MIT", ("mit.grant", "mit.notice", "asis.software")),
    ("MIT", ("mit.grant", "mit.notice")),
    ("Apache-2.0", ("apache2.header", "apache2.comply", "apache2.copy")),
    ("Apache-2.0", ("apache2.header", "apache2.comply")),
    ("BSD-3-Clause", ("bsd.use", "bsd.source", "bsd.binary", "bsd.name")),
    ("BSD-2-Clause", ("bsd.use", "bsd.source", "bsd.binary")),
    ("GPL-3.0-or-later", ("gpl.free", "gpl.hope")),
    ("GPL-3.0-or-later", ("gpl.free",)),
    ("GPL-2.0-or-later", ("gpl.free2", "gpl.either2", "gpl.hope")),
    ("GPL-2.0-or-later", ("gpl.free2", "gpl.either2")),
    ("ISC", ("isc.grant",)),
    ("MPL-2.0", ("mpl2.short",)),
    ("Unlicense", ("unlicense",)),
    ("MIT", ("mit.short",)),
    ("Apache-2.0", ("apache2.short",)),
    ("GPL-3.0", ("gpl3.short",)),
    ("GPL-2.0", ("gpl2.short",)),
    ("LGPL-3.0", ("lgpl3.short",)),
    ("AGPL-3.0", ("agpl3.short",)),
    ("BSD-2-Clause", ("bsd2.short",)),
    ("BSD-3-Clause", ("bsd3.short",)),
    *((spdx, (f"named.{spdx}",)) for spdx in NAMED),
    *((spdx, (f"tag.{spdx}",)) for spdx in TAGGED),
)
#: Ends of sentences: a mark and the white space after it, or a blank line.
ENDS = r"([.!?;])[ \t\r\n]+|[ \t\r]*\n[ \t\r]*\n[ \t\r\n]*"
_MARK = "\u0001"

# What the tables above, which the SQL shares, have no entry for.
MORE_SENTENCES: dict[str, tuple[str, ...]] = {
    "gpl.free": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "agpl.free": tuple(
        start + "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
        for start in ("", "This program is free software: ")
    ),
    "lgpl.free2": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",),
    "lgpl.either21": ("either version 2.1 of the License, or (at your option) any later version.",),
    "isc.grant": ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "bsl1.short": ("Distributed under the Boost Software License, Version 1.0.",),
    "apache2.title": (
        "Apache License Version 2.0, January 2004",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "apache2.define": ("\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",),
    "apache2.grant": ("Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",),
    "gpl3.title": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "lgpl3.title": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "agpl3.title": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "gpl2.title": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "fsf.verbatim": ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",),
    "gpl3.preamble": ("The GNU General Public License is a free, copyleft license for software and other kinds of works.",),
    "agpl3.preamble": ("The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",),
    "gpl2.preamble": ("The licenses for most software are designed to take away your freedom to share and change it.",),
}
# Names of licences in notices of any subject, by the identifier of
# the notice; "License" may follow each.
NOTICED = {
    "mit.short": ("MIT", "MIT/X11", "Expat"),
    "apache2.short": ("Apache 2.0", "Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache License v2.0"),
    "gpl3.short": (
        "GPLv3", "GPL v3", "GPL-3.0", "GPL 3.0", "GNU GPLv3", "GNU GPL v3", "GNU General Public License v3.0",
        "GNU General Public License, version 3",
    ),
    "gpl2.short": ("GPLv2", "GPL v2", "GPL-2.0", "GNU GPLv2", "GNU General Public License v2.0", "GNU General Public License, version 2"),
    "lgpl3.short": ("LGPLv3", "LGPL v3", "LGPL-3.0", "GNU LGPLv3", "GNU Lesser General Public License, version 3"),
    "agpl3.short": ("AGPLv3", "AGPL v3", "AGPL-3.0", "GNU AGPLv3", "GNU Affero General Public License, version 3"),
    "bsd2.short": ("BSD 2-Clause", "BSD-2-Clause", "2-clause BSD", "Simplified BSD"),
    "bsd3.short": ("BSD 3-Clause", "BSD-3-Clause", "3-clause BSD", "New BSD", "Modified BSD"),
    "mpl2.short": ("MPL 2.0", "MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "isc.short": ("ISC",),
    "bsl1.short": ("Boost Software License 1.0", "Boost Software License, Version 1.0", "BSL-1.0"),
}
#: Slots: normalised sentences whose names differ, and the one form of each.
SLOTS = (
    (r"^(?:neither )?the names? of .{1,300} (?:may|must|shall)(?: not)? be used to endorse or promote products derived from this software\b.*$", "slot endorse"),
    (r"^(?:(?:this|the|our|all) (?:[a-z0-9]+ ){1,4}(?:is|are) )?(?:dual )?(?:licensed|released|distributed|available|published|provided)(?: to you)? under (?:the )?(?:terms of )?(?:the )?(.{2,60}?)(?: licen[cs]e)?$", "slot under $1"),
    (r"^(?:this|the|our|all) (?:[a-z0-9]+ ){1,4}(?:is|are) (.{2,60}) licensed$", "slot under $1"),
)
#: What every text with a slot sentence has.
SLOT_HINTS = ("licen[cs]e", "endorse", "gpl")
MORE_TAGGED = (
    "GPL-2.0", "GPL-3.0", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-or-later", "BSL-1.0", "Zlib", "0BSD", "MIT-0", "EPL-1.0",
    "EPL-2.0", "EUPL-1.2", "MPL-1.1", "CDDL-1.0", "Artistic-2.0", "PSF-2.0", "PostgreSQL", "WTFPL", "NCSA", "OFL-1.1",
    "CC-BY-4.0", "CC-BY-SA-4.0", "MIT OR Apache-2.0", "Apache-2.0 OR MIT", "Apache-2.0 WITH LLVM-exception",
    "GPL-2.0 WITH Linux-syscall-note", "GPL-2.0-only WITH Linux-syscall-note", "GPL-2.0-or-later WITH Linux-syscall-note",
)
ALL_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache2.title", "apache2.define", "apache2.grant")),
    ("GPL-3.0", ("gpl3.title", "fsf.verbatim", "gpl3.preamble", "gpl.free", "gpl.hope")),
    ("GPL-3.0", ("gpl3.title", "fsf.verbatim", "gpl3.preamble")),
    ("AGPL-3.0", ("agpl3.title", "fsf.verbatim", "agpl3.preamble", "agpl.free", "gpl.hope")),
    ("AGPL-3.0", ("agpl3.title", "fsf.verbatim", "agpl3.preamble")),
    ("GPL-2.0", ("gpl2.title", "fsf.verbatim", "gpl2.preamble", "gpl.free2", "gpl.either2", "gpl.hope")),
    ("GPL-2.0", ("gpl2.title", "fsf.verbatim", "gpl2.preamble")),
    ("LGPL-3.0", ("lgpl3.title", "fsf.verbatim")),
    *RULES,
    ("ISC", ("isc.short",)),
    ("AGPL-3.0-or-later", ("agpl.free", "gpl.hope")),
    ("AGPL-3.0-or-later", ("agpl.free",)),
    ("LGPL-2.1-or-later", ("lgpl.free2", "lgpl.either21")),
    ("BSL-1.0", ("bsl1.short",)),
    *((spdx, (f"tag.{spdx}",)) for spdx in MORE_TAGGED),
)
#: Replaced before texts are cut, so that commented lines read like plain ones:
#: words that begin comments, closing marks, lines without a letter or digit, "+",
#: full stops of company names inside a sentence.
CLEANED = (
    (r"(?mdi)^[ \t]*(?:rem|dnl)(?=[ \t\r]|$)", ""),
    (r"(?md)[ \t]*(?:\*+/|--+>)[ \t\r]*$", ""),
    (r"(?md)^[^\p{L}\p{N}\n]+$", ""),
    (r"(?i)(GPL-[0-9]\.[0-9])\+", "$1-or-later"),
    (r"(?i)\b(inc|ltd|corp|co)\.(?=\s+(?:nor|and|or|may)\b)", "$1"),
)
#: Ends inside an unknown sentence: a colon before a new line or a list, and either
#: side of a copyright line.
COLON = r"(:)(?:[ \t\r]*\n|[ \t]+(?=\(?[0-9A-Za-z]{1,2}[.)]))"
COPYRIGHT = (
    r"(?md)^([^\p{L}\p{N}\n(©]*(?:(?i:spdx-filecopyrighttext:|copyright[ \t]*(?:\(c\)|[©:0-9])|\(c\)[ \t]*[0-9])|©|Copyright[ \t]+[A-Z])[^\n]*)$"
)
#: A list's marker before a sentence.
ITEM = r"^[^\p{L}\p{N}]*[0-9A-Za-z]{1,2}[.)][ \t]+"


def normal(sentence: str) -> str:
    """Lower-case ASCII letters and digits, everything else one space."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def slotted(sentence: str) -> str:
    """The normalised sentence with its names out, if it has the form of a slot."""
    plain = normal(sentence)
    for pattern, form in SLOTS:
        plain = re.sub(pattern, form.replace("$", "\\"), plain)
    return plain


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier; each must be one sentence as texts are cut."""
    forms = dict(SENTENCES)
    forms |= {f"named.{s}": tuple(f.format(n) for f in NAMED_FORMS) for s, n in NAMED.items()}
    forms |= {f"tag.{s}": (f"SPDX-License-Identifier: {s}", f"License-Identifier: {s}") for s in TAGGED}
    known: dict[str, str] = {}
    for name, sentences in forms.items():
        for sentence in sentences:
            if re.search(ENDS, sentence):
                raise ValueError(f"not one sentence: {sentence}")
            known[normal(sentence)] = name
    return known


def all_sentences() -> dict[str, str]:
    """``known_sentences`` and those that only this operator has."""
    known = known_sentences()
    known["slot endorse"] = "bsd.name"
    known |= {slotted(f"licensed under {n}"): name for name, names in NOTICED.items() for n in names}
    forms = MORE_SENTENCES | {f"tag.{s}": (f"SPDX-License-Identifier: {s}", f"License-Identifier: {s}") for s in MORE_TAGGED}
    for name, sentences in forms.items():
        for sentence in sentences:
            if re.search(ENDS, sentence) or known.setdefault(normal(sentence), name) != name:
                raise ValueError(f"not one sentence, or known by another name: {sentence}")
    return known


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentence_ids(text: Column, known: Mapping[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order, as an array.

    A sentence that isn't known word by word is looked up with its names out, so
    "This code is MIT licensed." and any holder of a BSD text are found.

    A sentence ends with a mark and white space or at a blank line, commented or
    not, so it may run over lines. One that isn't known as a whole is cut at its
    colons and copyright lines, and a part that isn't known either is looked up
    line by line, which finds notices beside lines without a full stop.
    """
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])

    def found(sentence: Column) -> Column:
        plain = slot = _normal(sentence)
        for pattern, form in SLOTS:
            slot = F.regexp_replace(slot, pattern, form)
        return F.coalesce(F.try_element_at(table, plain), F.when(slot.startswith("slot "), F.try_element_at(table, slot)))

    def part(sentence: Column) -> Column:
        whole = F.coalesce(found(sentence), found(F.regexp_replace(sentence, ITEM, "")))
        lines = F.transform(F.split(sentence, "\n"), found)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(lines)

    def of(sentence: Column) -> Column:
        whole = found(sentence)
        marked = F.regexp_replace(F.regexp_replace(sentence, COPYRIGHT, f"{_MARK}$1{_MARK}"), COLON, f"$1{_MARK}")
        parts = F.flatten(F.transform(F.split(marked, _MARK), part))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(parts)

    for pattern, plain in CLEANED:
        text = F.regexp_replace(text, pattern, plain)
    cut = F.split(F.regexp_replace(text, ENDS, f"$1{_MARK}"), _MARK)
    return F.filter(F.flatten(F.transform(cut, of)), lambda x: x.isNotNull())


def apply_rules(ids: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """``(licenses, rest)``: licences by rule order, and the identifiers left over."""
    table = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit("|" + "|".join(seq) + "|").alias("seq")) for name, seq in rules]
    )
    doubled = F.concat(F.lit("|"), F.array_join(F.transform(ids, lambda x: F.concat(x, F.lit("|"))), ""))
    start = F.struct(doubled.alias("rest"), F.array().cast("array<string>").alias("licenses"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["seq"])
        return F.struct(
            F.when(hit, _without(state["rest"], rule["seq"])).otherwise(state["rest"]).alias("rest"),
            F.when(hit, F.array_union(state["licenses"], F.array(rule["name"]))).otherwise(state["licenses"]).alias("licenses"),
        )

    return F.aggregate(table, start, step)


def _without(rest: Column, sequence: Column) -> Column:
    """All occurrences cut out, those that share a bar with the one before too."""
    once = F.replace(rest, sequence, F.lit("|"))
    return F.replace(once, sequence, F.lit("|"))


def license_scan(docs: DataFrame, rules: Sequence[tuple[str, Sequence[str]]] = ALL_RULES) -> DataFrame:
    """Licences of every row of ``docs``, by built-in functions alone.

    Returns ``doc_id, licenses, n_sentences, sentences, unresolved``: licences in
    rule order joined by commas, the number and the identifiers of known
    sentences in text order, and those that no rule used. Texts without one of
    the words that every known sentence has skip the search. Null, empty and
    plain texts give empty strings and 0; repeated rows come back repeated, an
    empty table gives no rows, other columns are ignored. One narrow pass.
    """
    known = all_sentences()
    text = F.coalesce(quoted("text").cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    plain = {s: name for s, name in known.items() if not s.startswith("slot ")}
    hinted = F.lower(text).rlike("|".join([hint_pattern(plain), *SLOT_HINTS]))
    ids = F.when(hinted, sentence_ids(text, known)).otherwise(none)
    found = docs.select(quoted("doc_id").cast("long").alias("doc_id"), ids.alias("ids")).select(
        "doc_id", "ids", F.when(F.size("ids") > 0, apply_rules(F.col("ids"), rules)).alias("state")
    )
    return found.select(
        "doc_id",
        F.coalesce(F.array_join("state.licenses", ","), F.lit("")).alias("licenses"),
        F.size("ids").cast("bigint").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentences"),
        F.coalesce(F.trim(F.col("state.rest"), F.lit("|")), F.lit("")).alias("unresolved"),
    )


def hint_pattern(known: Mapping[str, str]) -> str:
    """A pattern that finds every text with a known sentence.

    Words are taken one at a time, always the one that most sentences without a
    hint have, long words before short ones, so each known sentence has one.
    """
    open_, hints = [set(s.split()) for s in known], []
    while open_:
        words = sorted({w for s in open_ for w in s if len(w) >= 3})
        best = max(words, key=lambda w: (len(w) >= 7, sum(w in s for s in open_), len(w)))
        hints.append(best)
        open_ = [s for s in open_ if best not in s]
    return "|".join(hints)
