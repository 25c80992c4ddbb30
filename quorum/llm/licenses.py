"""Licence recognition by sentences.

A text is cut into pieces at line and sentence ends, without the marks of
comments; each is normalised (lower case, punctuation and white space runs
become one space; "this file is" and the like before "licensed under" go).
A known licence sentence is found where a piece begins with it, be it wrapped
over several pieces, and mapped to its identifier; a short one (a notice, an
SPDX tag, a licence's title) must also end where a piece ends.  The sequence
of identifiers of a document is then matched against ordered rules.  A rule
names a licence and the identifiers it needs, in order; ``...`` allows others
in between, which stay for later rules.  More specific rules come first; a
sentence that a rule used is not used by a later one.  "All rights reserved"
is an answer only where no licence is found.

Defined results: null and empty texts have no sentences and no licences; a
document without known sentences has empty lists; repeated sentences count
at each place; repeated rows give repeated results; an empty table gives an
empty one; very long texts are read whole; where the input has a column
``sentence_ids`` or ``licences``, it stays and the new one gets a leading ``_``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import fresh_name

# Known sentences (fixed values: short public licence notices, normalised below)
SENTENCES = {
    "lic-mit": "Released under the MIT License.",
    "lic-mit-this": "This software is released under the MIT License.",
    "lic-mit-lic": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
                 "software and associated documentation files (the \"Software\"), to deal in the "
                 "Software without restriction",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all "
                  "copies or substantial portions of the Software.",
    "as-is": "The software is provided \"as is\", without warranty of any kind, express or implied",
    "lic-apache2": "Licensed under the Apache License, Version 2.0.",
    "apache2-the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache2-may-not": "you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at",
    "lic-gpl3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General "
                        "Public License as published by the Free Software Foundation",
    "gpl-v3-later": "either version 3 of the License, or (at your option) any later version.",
    "gpl-v2-later": "either version 2 of the License, or (at your option) any later version.",
    "lic-cc-by-nc4": "Licensed under CC BY-NC 4.0.",
    "lic-cc-by4": "Licensed under CC BY 4.0.",
    "lic-cc-by-sa4": "Licensed under CC BY-SA 4.0.",
    "lic-cc0": "Released under CC0 1.0.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without "
                          "modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list "
                  "of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be "
                   "used to endorse or promote products derived from this software",
    "bsd-endorse-name": "Neither the name of <any> nor the names of its contributors may be used to "
                        "endorse or promote products derived from this software",
    "lgpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser "
                         "General Public License as published by the Free Software Foundation",
    "agpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Affero "
                         "General Public License as published by the Free Software Foundation",
    "gpl-v2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public "
                   "License version 2 as published by the Free Software Foundation",
    "gpl-v21-later": "either version 2.1 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with "
                 "or without fee is hereby granted, provided that the above copyright notice and this "
                 "permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with "
                     "or without fee is hereby granted, provided that the above copyright notice and "
                     "this permission notice appear in all copies.",
    "epl2": "This program and the accompanying materials are made available under the terms of the "
            "Eclipse Public License 2.0",
    "epl2-v": "This program and the accompanying materials are made available under the terms of the "
              "Eclipse Public License v2.0",
    "epl2-v.": "This program and the accompanying materials are made available under the terms of the "
               "Eclipse Public License v. 2.0",
    "epl1": "This program and the accompanying materials are made available under the terms of the "
            "Eclipse Public License v1.0",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "lic-mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights": "All rights reserved.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you "
                   "wrote the original software.",
    "bsl1": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy "
            "of the software and accompanying documentation covered by this license",
    "cc-by4-int": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa4-int": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                     "International License.",
    "cc-by-nc4-int": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                     "International License.",
}

# Titles of the licences' own texts (fixed values)
TITLES = {
    "Apache-2.0": "Apache License Version 2.0, January 2004",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "MPL-2.0": "Mozilla Public License Version 2.0",
    "EPL-2.0": "Eclipse Public License - v 2.0",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003",
}

# Names under which one-sentence notices give licences (fixed values)
NAMES = {
    "MIT": ["MIT", "MIT License", "MIT Licence"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "MPL 2.0"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GPL 2.0"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GPL 3.0"],
    "CC0-1.0": ["CC0 1.0"], "CC-BY-4.0": ["CC BY 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"], "CC-BY-ND-4.0": ["CC BY-ND 4.0"], "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"], "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
}

# SPDX identifiers besides those above and those of the rules (fixed values)
TAGS = ["0BSD", "Artistic-2.0", "BSL-1.0", "CDDL-1.0", "EUPL-1.2", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0",
        "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "OFL-1.1", "PostgreSQL", "Python-2.0", "WTFPL", "Zlib"]

#: an answer only where there is no other
RESERVED = "LicenseRef-all-rights-reserved"

# (licence, identifiers in order); "..." lets other sentences stand between
RULES = [
    ("BSD-3-Clause", ["bsd-redistribution", "...", "bsd-source", "...", "bsd-binary", "...", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-redistribution", "...", "bsd-source", "...", "bsd-binary", "...", "bsd-endorse-name"]),
    ("BSD-2-Clause", ["bsd-redistribution", "...", "bsd-source", "...", "bsd-binary"]),
    ("MIT", ["mit-grant", "...", "mit-notice", "...", "as-is"]),
    ("MIT", ["mit-grant", "...", "mit-notice"]),
    ("Apache-2.0", ["apache2-the", "...", "apache2-may-not", "...", "apache2-copy"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "...", "gpl-v3-later"]),
    ("GPL-2.0-or-later", ["gpl-redistribute", "...", "gpl-v2-later"]),
    ("LGPL-3.0-or-later", ["lgpl-redistribute", "...", "gpl-v3-later"]),
    ("LGPL-2.1-or-later", ["lgpl-redistribute", "...", "gpl-v21-later"]),
    ("LGPL-2.0-or-later", ["lgpl-redistribute", "...", "gpl-v2-later"]),
    ("AGPL-3.0-or-later", ["agpl-redistribute", "...", "gpl-v3-later"]),
    ("GPL-2.0-only", ["gpl-v2-only"]),
    ("ISC", ["isc-grant"]), ("ISC", ["isc-grant-and"]),
    ("EPL-2.0", ["epl2"]), ("EPL-2.0", ["epl2-v"]), ("EPL-2.0", ["epl2-v."]), ("EPL-1.0", ["epl1"]),
    ("Unlicense", ["unlicense"]),
    ("GPL-3.0-only", ["lic-gpl3"]),
    ("Apache-2.0", ["lic-apache2"]),
    ("Apache-2.0", ["apache2-the"]),
    ("MIT", ["lic-mit"]), ("MIT", ["lic-mit-this"]), ("MIT", ["lic-mit-lic"]),
    ("CC-BY-NC-4.0", ["lic-cc-by-nc4"]), ("CC-BY-SA-4.0", ["lic-cc-by-sa4"]),
    ("CC-BY-4.0", ["lic-cc-by4"]), ("CC0-1.0", ["lic-cc0"]), ("MPL-2.0", ["lic-mpl2"]),
    ("Zlib", ["zlib-as-is", "...", "zlib-origin"]),
    ("BSL-1.0", ["bsl1"]),
    ("CC-BY-4.0", ["cc-by4-int"]), ("CC-BY-SA-4.0", ["cc-by-sa4-int"]), ("CC-BY-NC-4.0", ["cc-by-nc4-int"]),
    *((name, [f"title-{name}"]) for name in TITLES),
    (RESERVED, ["all-rights"]),
]

_SPLIT = r"\n+|(?<=[.!?;:])\s+(?=[A-Z\"(])|(?<=[;:,])\s+(?=you |either )"

#: marks of comments at the start and the end of a line
_COMMENT = r"(?m)^[ \t]*(?:/{2,}|/?\*+/?|#+|-{2,}|;+|%+|<!--|>+|(?:dnl|REM|rem)(?=[ \t]))[ \t]*|[ \t]*(?:\*+/|-->)[ \t\r]*$"
_ANY = "<any>"
#: what may stand before a notice: "this file is", "the code in this folder is also"
_LEAD = r"(?:this|these|the|all|our)(?: \S+){1,6}? (?:is|are) (?:\S+ )??(?=(?:licensed|released|distributed) under )"
_SHORT = 8          # known sentences of at most so many words must end where a piece ends


#: a tag's expression is cut at its operators, each part a tag
_TAG = "SPDX-License-Identifier:"
_OPERATOR = rf"[ \t)]+(?:OR|AND|WITH)[ \t(]+(?<={_TAG}[^\n]{{0,200}})"

_PLUS = rf"({_TAG}[ \t(]*[A-Za-z0-9.-]+)\+"


def normal(sentence: str) -> str:
    """Normal form of a sentence."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def notices() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Sentences and rules of one-sentence notices, SPDX tags and titles."""
    sentences = {f"title-{name}": text for name, text in TITLES.items()}
    rules = []
    for name, forms in NAMES.items():
        for k, form in enumerate(forms):
            for verb in ("Licensed", "Released", "Distributed"):
                # "under the MIT" is the beginning of a longer name
                for the in ("", "the ") if re.search("licen[cs]e", form, re.I) else ("",):
                    key = f"{verb.lower()}-{name}-{k}{the[:1]}"
                    sentences[key] = f"{verb} under {the}{form}."
                    rules.append((name, [key]))
    known = {normal(text) for text in SENTENCES.values()}
    sentences = {k: v for k, v in sentences.items() if normal(v) not in known}
    for name in sorted({*NAMES, *TAGS, *(r[0] for r in RULES if r[0] != RESERVED)}):
        sentences[f"spdx-{name}"] = f"{_TAG} {name}"
        rules.append((name, [f"spdx-{name}"]))
    return sentences, [r for r in rules if r[1][0] in sentences]


def normal_column(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentence_parts(sentences: dict[str, str]) -> list[tuple[str, str]]:
    """(normal form, identifier) of the known sentences."""
    return [(f" {_ANY}".join(normal(x) for x in text.split("<any>")), key) for key, text in sentences.items()]


def identifiers(text: Column, sentences: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order.

    A cheap test for the first word of any known sentence comes before the
    comparison; a long known sentence without its end matches as a prefix."""
    known = sentence_parts(sentences or {**SENTENCES, **notices()[0]})
    # of two sentences of one normal form the first counts
    short = {form: key for form, key in reversed(known) if _ANY not in form and form.count(" ") < _SHORT}
    long = [x for x in known if _ANY in x[0] or x[0].count(" ") >= _SHORT]
    table = F.create_map(*[F.lit(x) for pair in short.items() for x in pair]) if short else None
    firsts = "|".join(sorted({k.split(" ")[0] for k, _ in known}))
    longest = max(k.count(" ") + 13 * k.count(_ANY) for k, _ in known) + 1
    leads = "|".join(sorted(form for form, _ in known if re.match(_LEAD, form)))
    lead = (f"^(?!(?:{leads})\\b)" if leads else "^") + _LEAD
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), _COMMENT, "")
    plain = F.when(F.contains(plain, F.lit(_TAG)), F.regexp_replace(F.regexp_replace(
        plain, _OPERATOR, "\n" + _TAG + " "), _PLUS, "$1-or-later")).otherwise(plain)
    pieces = F.filter(F.transform(F.split(plain, _SPLIT), lambda x: F.regexp_replace(
        normal_column(x), lead, "")), lambda n: n != "")

    def to_id(all_, i):
        # pieces hold a word at least, so so many of them hold any known sentence
        n = F.array_join(F.slice(all_, i + 1, longest), " ")
        ends = F.transform(F.sequence(F.lit(1), F.lit(_SHORT)),
                           lambda k: F.array_join(F.slice(all_, i + 1, k), " "))

        def fits(form, n):
            if _ANY in form:
                return F.rlike(n, F.lit("^" + form.replace(_ANY, r"(?:\S+ ){1,12}?") + r"\b"))
            return (n == form) | F.startswith(n, F.lit(form + " "))

        def choose(bound):
            # longest first: of two that fit, the more specific is tested first; a short one is
            # looked up by the pieces that may make it, the most pieces first
            out = F.lit(None).cast("string") if table is None else F.get(F.filter(F.transform(
                F.reverse(bound["ends"]), lambda e: F.try_element_at(table, e)), lambda x: x.isNotNull()), F.lit(0))
            for form, key in sorted(long, key=lambda x: len(x[0])):
                out = F.when(fits(form, bound["n"]), F.lit(key)).otherwise(out)
            return out
        return F.get(F.transform(F.array(F.struct(n.alias("n"), ends.alias("ends"))), choose), F.lit(0))

    # the arrays of one element bind what the functions on them use several times
    found = F.get(F.transform(F.array(pieces), lambda all_: F.transform(
        all_, lambda n, i: F.when(F.rlike(n, F.lit(f"^(?:{firsts})\\b")), to_id(all_, i)))), F.lit(0))
    return F.filter(found, lambda x: x.isNotNull())


def match_rules(ids: Column, rules=None) -> Column:
    """Licences of an identifier sequence: the rules of several sentences in
    turn, each over the whole sequence from left to right, then those of one;
    each sentence is used once.  The sequence is a string of ``<id>`` marks; a
    rule is a pattern over it that puts ``<used>`` for its own sentences and
    leaves those between them."""
    rules = rules or [*RULES[:-1], *notices()[1], RULES[-1]]
    left = F.concat(F.lit("<"), F.array_join(ids, "><"), F.lit(">"))
    state = F.struct(left.alias("left"), F.array().cast("array<string>").alias("found"))

    def rule(name, seq):
        pattern = "".join("(.*?)" if p == "..." else f"<{re.escape(p)}>" for p in seq)
        gaps = iter(range(1, len(seq) + 1))
        rest = "".join(f"${next(gaps)}" if p == "..." else "<used>" for p in seq)
        return F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("pattern"), F.lit(rest).alias("rest"))
    table = F.array(*[rule(*r) for r in rules if len(r[1]) > 1])
    one = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f"<{seq[0]}>").alias("mark"))
                    for name, seq in rules if len(seq) == 1])

    def answer(s):
        found = F.array_distinct(F.concat(s["found"], F.transform(
            F.filter(one, lambda r: F.contains(s["left"], r["mark"])), lambda r: r["name"])))
        return F.when(F.size(found) > 1, F.array_remove(found, RESERVED)).otherwise(found)
    return F.aggregate(
        table, state,
        lambda s, r: F.when(F.rlike(s["left"], r["pattern"]), F.struct(
            F.regexp_replace(s["left"], r["pattern"], r["rest"]).alias("left"),
            F.array_append(s["found"], r["name"]).alias("found"))).otherwise(s),
        answer)


def recognise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids`` and ``licences`` (see above for taken names)."""
    ids, found = fresh_name(docs, "sentence_ids"), fresh_name(docs, "licences")
    d = docs.withColumn(ids, identifiers(F.col(f"`{text_col}`")))
    return d.withColumn(found, F.when(F.size(ids) > 0, match_rules(
        F.col(ids))).otherwise(F.array().cast("array<string>")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, licences and sentence identifiers (comma-joined, in order)."""
    return recognise(docs.select("doc_id", "text")).select(
        "doc_id", F.array_join("licences", ",").alias("licences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.size("sentence_ids").cast("long").alias("n_sentences"))
