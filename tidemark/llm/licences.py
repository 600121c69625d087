"""Licence scans by sentence rules, in DataFrame functions alone.

A text is split into sentences, each is normalised (A-Z lower-cased, everything but a-z and 0-9 to one
space, so that comment marks go) and looked up in a table of known licence sentences. What remains is the
sequence of their identifiers, `<0>` for runs of other sentences. Texts are split twice: by paragraphs, in
which line ends count as spaces, for notices that are wrapped; and by lines, for notices that stand on a
line of their own among other lines. The known sentences and their identifiers come from whole notices by
the same splitting. Ordered rules are matched against both sequences: a rule fits where its identifiers
follow each other, with other sentences between them at most, and what it fits is taken out before the next
rule is tried, so that whole licence texts go before their single sentences. All of it happens within the
row: no shuffle.

Edge cases: a null or empty text has no sentences and no licence; repeated rows give repeated results;
an empty table gives an empty result; other columns are ignored. Time and memory go with the length of a text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Public licence texts and notices.
NOTICES = {
    "mit_name": "Released under the MIT License.",
    "mit_named": "This project is licensed under the MIT License.",
    "mit_grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_warranty": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache": "Licensed under the Apache License, Version 2.0",
    "apache_short": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache_use": "you may not use this file except in compliance with the License.",
    "apache_copy": "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0",
    "apache_warranty": """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "apache_see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3_name": "This work is licensed under the GNU General Public License version 3.",
    "gpl3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2_joined": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "gpl_warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl_see": "See the GNU General Public License for more details.",
    "lgpl3": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl21": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl_warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc_by_nc_name": "Licensed under CC BY-NC 4.0.",
    "cc_by_name": "Licensed under CC BY 4.0.",
    "cc_by_sa_name": "Licensed under CC BY-SA 4.0.",
    "cc_by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc_by_nc_old": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc_by_sa_old": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_names": "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_warranty": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "bsd_name": "Released under the BSD 3-Clause License.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc_short": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc_warranty": """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost": "Distributed under the Boost Software License, Version 1.0.",
    "reserved": "All rights reserved.",
}
#: Licence, kind and notices one after the other; the first rule that fits takes them.
RULES = [
    ("MIT", "permissive", ["mit_grant", "mit_notice", "mit_warranty"]),
    ("MIT", "permissive", ["mit_grant", "mit_notice"]),
    ("Apache-2.0", "permissive", ["apache_short", "apache_use", "apache_copy", "apache_warranty", "apache_see"]),
    ("Apache-2.0", "permissive", ["apache_short", "apache_use", "apache_warranty"]),
    ("Apache-2.0", "permissive", ["apache_short", "apache_use"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl3", "gpl_warranty", "gpl_see"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl3", "gpl_warranty"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2", "gpl_warranty", "gpl_see"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2", "gpl_warranty"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2_joined", "gpl_warranty"]),
    ("LGPL-3.0-or-later", "copyleft", ["lgpl3", "lgpl_warranty"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl21", "lgpl_warranty"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl3", "gpl_warranty"]),
    ("BSD-3-Clause", "permissive", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "bsd_warranty"]),
    ("BSD-3-Clause", "permissive", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", "permissive", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_warranty"]),
    ("BSD-2-Clause", "permissive", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("BSD-3-Clause", "permissive", ["bsd_grant", "bsd_names"]),
    ("ISC", "permissive", ["isc", "isc_warranty"]),
    ("MPL-2.0", "copyleft", ["mpl"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl21"]),
    ("MIT", "permissive", ["mit_name"]),
    ("MIT", "permissive", ["mit_named"]),
    ("MIT", "permissive", ["mit_grant"]),
    ("Apache-2.0", "permissive", ["apache"]),
    ("Apache-2.0", "permissive", ["apache_short"]),
    ("GPL-3.0-only", "copyleft", ["gpl3_name"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl3"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2_joined"]),
    ("LGPL-3.0-or-later", "copyleft", ["lgpl3"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl3"]),
    ("CC-BY-NC-4.0", "restricted", ["cc_by_nc_name"]),
    ("CC-BY-NC-4.0", "restricted", ["cc_by_nc_old"]),
    ("CC-BY-4.0", "permissive", ["cc_by_name"]),
    ("CC-BY-4.0", "permissive", ["cc_by"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc_by_sa_name"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc_by_sa_old"]),
    ("CC0-1.0", "permissive", ["cc0"]),
    ("BSD-2-Clause", "permissive", ["bsd_grant"]),
    ("BSD-3-Clause", "permissive", ["bsd_name"]),
    ("Unlicense", "permissive", ["unlicense"]),
    ("ISC", "permissive", ["isc"]),
    ("ISC", "permissive", ["isc_short"]),
    ("Zlib", "permissive", ["zlib"]),
    ("BSL-1.0", "permissive", ["boost"]),
    ("Proprietary", "restricted", ["reserved"]),
]
#: Where sentences end in a paragraph; lines without a letter or digit part paragraphs, other line ends are spaces.
SENTENCE = r"[.?;]+([ \t]+|\z)"
PARAGRAPH, WRAP = r"\n([^a-z0-9\n]*\n)+", r"[\r\n]+"
#: Where sentences end by lines.
LINE = r"[.?;]+([ \t\r\n]+|\z)|[\r\n]+"
OTHER = "[^a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KINDS = ["restricted", "copyleft", "permissive"]
#: Words that a sentence needs to be known by itself.
LEAST = 3


def known_sentences() -> tuple[dict[str, int], dict[str, list[int]]]:
    """Identifiers of the sentences of all notices, and of each notice its own, in order; sentences of a word or two are left out."""
    ids: dict[str, int] = {}
    of = {}
    for name, text in NOTICES.items():
        soft = re.sub(WRAP, " ", re.sub(PARAGRAPH, ". ", text.lower()))
        found = [re.sub(OTHER, " ", s).strip() for s in re.split(SENTENCE.replace(r"\z", r"\Z").replace("(", "(?:"), soft)]
        of[name] = [ids.setdefault(s, len(ids) + 1) for s in found if len(s.split()) >= LEAST]
    return ids, of


SENTENCES, OF_NOTICE = known_sentences()


def pattern(notices: list[str]) -> str:
    """A regular expression over sequences: the identifiers of the notices, other sentences between them at most."""
    return "(<0>)*".join(f"<{i}>" for n in notices for i in OF_NOTICE[n])


def sentence_ids(parts: Column) -> Column:
    """Identifiers of all sentences that have a letter or digit, 0 for unknown ones."""
    known = F.create_map(*(F.lit(x) for s, i in SENTENCES.items() for x in (s, i)))
    normal = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, OTHER, " ")))
    return F.transform(F.filter(normal, lambda s: s != ""), lambda s: F.coalesce(F.try_element_at(known, s), F.lit(0)))


def sequence(ids: Column) -> Column:
    return F.regexp_replace(F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), ""), "(<0>)+", "<0>")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_sentences, sequence, licences, kind): known identifiers in order, by paragraphs; names of the licences found; the most restrictive kind."""
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    soft = F.regexp_replace(F.regexp_replace(lower, PARAGRAPH, ". "), WRAP, " ")
    out = df.select(F.col(key), sentence_ids(F.split(soft, SENTENCE, -1)).alias("_ids"), sequence(sentence_ids(F.split(lower, LINE, -1))).alias("_lines"))
    out = out.select(key, F.size("_ids").cast("long").alias("n_sentences"), sequence(F.col("_ids")).alias("sequence"), "_lines")
    # each rule sees what the ones before have left; one projection a rule, kept apart by names
    left = F.concat(F.col("sequence"), F.lit("|"), F.col("_lines"))
    names: dict[str, Column] = {}
    kinds: dict[str, Column] = {}
    for name, kind, notices in RULES:
        hit = left.rlike(wanted := pattern(notices))
        names[name] = names[name] | hit if name in names else hit
        kinds[kind] = kinds[kind] | hit if kind in kinds else hit
        if "<0>" in wanted:
            left = F.regexp_replace(left, wanted, "<0>")
    any_ = F.col("sequence").rlike("<[1-9]") | F.col("_lines").rlike("<[1-9]")
    found = F.when(any_, F.array_join(F.array(*(F.when(names[n], F.lit(n)) for n in sorted(names))), ",")).otherwise("")
    return out.select(key, "n_sentences", "sequence", found.alias("licences"), F.when(any_, F.coalesce(*(F.when(kinds[k], F.lit(k)) for k in KINDS), F.lit("none"))).otherwise("none").alias("kind"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def sql() -> str:
    known = "MAP {" + ", ".join(f"'{s}': {i}" for s, i in SENTENCES.items()) + "}"
    steps, left = ["s0 AS (SELECT doc_id, n_sentences, sequence, sequence || '|' || lines AS left_0 FROM q)"], 0
    names: dict[str, list[str]] = {}
    kinds: dict[str, list[str]] = {}
    for k, (name, kind, notices) in enumerate(RULES):
        wanted = pattern(notices)
        steps.append(f"s{k + 1} AS (SELECT *, regexp_matches(left_{left}, '{wanted}') AS hit_{k}, regexp_replace(left_{left}, '{wanted}', '<0>', 'g') AS left_{k + 1} FROM s{k})")
        left = k + 1
        names.setdefault(name, []).append(f"hit_{k}")
        kinds.setdefault(kind, []).append(f"hit_{k}")
    found = ", ".join(f"CASE WHEN {' OR '.join(names[n])} THEN '{n}' END" for n in sorted(names))
    kind = " ".join(f"WHEN {' OR '.join(kinds[k])} THEN '{k}'" for k in KINDS)
    ids = lambda x, at: f"list_transform(list_filter(list_transform(regexp_split_to_array({x}, '{at}'), lambda s: trim(regexp_replace(s, '{OTHER}', ' ', 'g'))), lambda s: s <> ''), lambda s: coalesce(({known})[s], 0))"
    joined = lambda x: f"regexp_replace(coalesce(array_to_string(list_transform({x}, lambda i: '<' || i || '>'), ''), ''), '(<0>)+', '<0>', 'g')"
    return f"""
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
    i AS (SELECT doc_id, {ids(f"regexp_replace(regexp_replace(t, '{PARAGRAPH}', '. ', 'g'), '{WRAP}', ' ', 'g')", SENTENCE)} AS ids, {ids('t', LINE)} AS line_ids FROM n),
    q AS (SELECT doc_id, len(ids)::BIGINT AS n_sentences, {joined('ids')} AS sequence, {joined('line_ids')} AS lines FROM i),
    {", ".join(steps)}
    SELECT doc_id, n_sentences, sequence, coalesce(array_to_string([{found}], ','), '') AS licences, CASE {kind} ELSE 'none' END AS kind FROM s{len(RULES)}"""
