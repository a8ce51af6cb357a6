"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised (ASCII lower case, letters and digits
only) and looked up among the known licence sentences. The identifiers found, in order,
are matched against the licence rules: sequences of identifiers, longer ones first. A
rule that matches consumes its identifiers, so that a licence is not reported again as
its own part. The tables are constants of this module; nothing is joined or shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import configure, table

#: Known sentences, as the splitter leaves them (it cuts "free software: you" and "v. 2.0"); the
#: identifier is the place in the list, from 1, those of ``_MORE`` following.
_FIRST = (
    "Released under the MIT License",
    "Licensed under the MIT License",
    "Licensed under the Apache License, Version 2.0",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "You may obtain a copy of the License at",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "See the License for the specific language governing permissions and limitations under the License",
    "This work is licensed under the GNU General Public License, version 3",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "See the GNU General Public License for more details",
    "Licensed under CC BY-NC 4.0",
    "Licensed under CC BY 4.0",
    "Licensed under CC BY-SA 4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "All content is published under the Mozilla Public License, version 2.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v",
)
_WARRANTY = _FIRST[5]
_GNU = (
    ("gpl-2.0", "GPL-2.0", "GNU General Public License", "2"),
    ("gpl-3.0", "GPL-3.0", "GNU General Public License", "3"),
    ("lgpl-2.0", "LGPL-2.0", "GNU Library General Public License", "2"),
    ("lgpl-2.1", "LGPL-2.1", "GNU Lesser General Public License", "2.1"),
    ("lgpl-3.0", "LGPL-3.0", "GNU Lesser General Public License", "3"),
    ("agpl-3.0", "AGPL-3.0", "GNU Affero General Public License", "3"),
)
_YOU = "you can redistribute it and/or modify it under the terms of the"
_FSF = "as published by the Free Software Foundation"
#: With a semicolon the subject stays in the sentence.
_SUBJECTS = (("", ""), ("-program", "This program is free software; "), ("-library", "This library is free software; "), ("-file", "This file is free software; "))
_NAMED = (
    ("gpl-2.0", "GPL-2.0-only", "GNU General Public License, version 2"),
    ("gpl-3.0", "GPL-3.0-only", "GNU General Public License, version 3"),
    ("lgpl-2.1", "LGPL-2.1-only", "GNU Lesser General Public License, version 2.1"),
    ("lgpl-3.0", "LGPL-3.0-only", "GNU Lesser General Public License, version 3"),
    ("agpl-3.0", "AGPL-3.0-only", "GNU Affero General Public License, version 3"),
    ("isc", "ISC", "ISC License"),
    ("mit", "MIT", "MIT License"),
    ("apache-2.0", "Apache-2.0", "Apache License, Version 2.0"),
    ("bsd-2-clause", "BSD-2-Clause", "BSD 2-Clause License"),
    ("bsd-3-clause", "BSD-3-Clause", "BSD 3-Clause License"),
    ("mpl-2.0", "MPL-2.0", "Mozilla Public License, version 2.0"),
    ("epl-1.0", "EPL-1.0", "Eclipse Public License, version 1.0"),
    ("epl-2.0", "EPL-2.0", "Eclipse Public License, version 2.0"),
    ("unlicense", "Unlicense", "Unlicense"),
    ("cc0-1.0", "CC0-1.0", "Creative Commons CC0 1.0 Universal license"),
)
_VERBS = (("licensed", "Licensed under the"), ("released", "Released under the"), ("work", "This work is licensed under the"), ("project", "This project is licensed under the"))
#: Further sentences that are a rule by themselves: name, SPDX identifier, sentence.
_MORE = (
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant-and", "ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense-dedication", "Unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("cc0-1.0-dedication", "CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("epl-2.0-header", "EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl-2.0-header-http", "EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0/"),
    ("epl-1.0-header", "EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    *[(f"{n}-or-later{w}", f"{x}-or-later", f"{subject}{_YOU} {of} {_FSF}, either version {v} of the License, or (at your option) any later version")
      for n, x, of, v in _GNU for w, subject in _SUBJECTS if w or n != "gpl-3.0"],
    *[(f"{n}-only{w}", f"{x}-only", f"{subject}{_YOU} {of} version {v} {_FSF}") for n, x, of, v in _GNU for w, subject in _SUBJECTS[:3]],
    *[(f"{n}-only-of{w}", f"{x}-only", f"{subject}{_YOU} {of} {_FSF}, version {v} of the License") for n, x, of, v in _GNU for w, subject in _SUBJECTS[:3]],
    *[(f"{n}-{verb}", x, f"{words} {of}") for n, x, of in _NAMED for verb, words in _VERBS if f"{words} {of}" not in _FIRST],
)
#: Where no blank line parts them, the address of the Apache licence joins two sentences.
_JOINED = tuple(f"{_FIRST[4]} {http}://www.apache.org/licenses/LICENSE-2.0 {_WARRANTY}" for http in ("http", "https"))
SENTENCES = (*_FIRST, *_JOINED, *[sentence for _, _, sentence in _MORE])
_AT = {name: len(_FIRST) + len(_JOINED) + k for k, (name, _, _) in enumerate(_MORE, 1)}
#: Rules in order: name, SPDX identifier, sentence identifiers in sequence.
RULES = (
    ("bsd-3-clause-text", "BSD-3-Clause", (17, 18, 19, 20)),
    ("bsd-2-clause-text", "BSD-2-Clause", (17, 18, 19)),
    ("apache-2.0-header", "Apache-2.0", (4, 5, 6, 7)),
    ("apache-2.0-joined-header", "Apache-2.0", (4, 23, 7)),
    ("apache-2.0-joined-https-header", "Apache-2.0", (4, 24, 7)),
    ("apache-2.0-short-header", "Apache-2.0", (4, 5)),
    ("gpl-3.0-header", "GPL-3.0-or-later", (9, 10, 11)),
    ("gpl-3.0-short-header", "GPL-3.0-or-later", (9,)),
    ("mit-text", "MIT", (_AT["mit-grant"], 16)),
    ("mit-notice", "MIT", (16,)),
    ("mit-reference", "MIT", (1,)),
    ("mit-reference-2", "MIT", (2,)),
    ("apache-2.0-reference", "Apache-2.0", (3,)),
    ("apache-2.0-grant", "Apache-2.0", (4,)),
    ("gpl-3.0-reference", "GPL-3.0-only", (8,)),
    ("cc-by-nc-4.0-reference", "CC-BY-NC-4.0", (12,)),
    ("cc-by-4.0-reference", "CC-BY-4.0", (13,)),
    ("cc-by-sa-4.0-reference", "CC-BY-SA-4.0", (14,)),
    ("cc-by-4.0-statement", "CC-BY-4.0", (15,)),
    ("mpl-2.0-statement", "MPL-2.0", (21,)),
    ("mpl-2.0-reference", "MPL-2.0", (22,)),
    *[(name, spdx, (_AT[name],)) for name, spdx, _ in _MORE],
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sentences end at a mark before white space and at lines without a letter or digit; in the second reading at every line end.
BY_MARK, BY_LINE = r"[.!?:]+[\x20\x09-\x0D]+|\n[^a-z0-9\n]*\n", r"[.!?:]+[\x20\x09-\x0D]+|\n"
#: Every known sentence holds one of these, so texts with none need no look at sentences.
TRIGGER = "licen|copyright|redistribut|warrant"


def _plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


KNOWN = tuple(_plain(s) for s in SENTENCES)
if not all(re.search(TRIGGER, s) for s in KNOWN):
    raise ValueError("a known sentence lacks every trigger word")


def _assert_rules() -> None:
    """Every rule is found, and nothing else is, where its own sentences stand."""
    if len(set(KNOWN)) < len(KNOWN):
        raise ValueError("a sentence is known twice")
    for name, _, ids in RULES:
        for cut in (BY_MARK, BY_LINE):
            parts = [_plain(x) for x in re.split(cut, ". ".join(SENTENCES[i - 1] for i in ids).lower() + ".\n")]
            found = [KNOWN.index(x) + 1 for x in parts if x in KNOWN]
            rest, hits = "".join(f"<{i}>" for i in found), []
            for other, _, own in RULES:
                if (key := "".join(f"<{i}>" for i in own)) in rest:
                    rest, hits = rest.replace(key, "|"), [*hits, other]
            if (found, hits) != (list(ids), [name]):
                raise ValueError(f"rule {name} does not match its own text: {found}, {hits}")


_assert_rules()


def _ids(low: Column, cut: str) -> Column:
    known = F.array(*[F.lit(s) for s in KNOWN])
    number = lambda s: F.array_position(known, F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    return F.filter(F.transform(F.filter(F.split(low, cut, -1), lambda s: s.rlike(TRIGGER)), number), lambda i: i > 0)


def licences(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus sentence_ids, rules and licences (arrays) of each row.

    Null, empty and unlicensed texts have empty arrays; repeated rows are treated each
    for itself. Of the two readings that with more known sentences counts, the one by
    marks at a tie.
    """
    low = F.translate(F.coalesce(docs["text"], F.lit("")), UPPER, LOWER)
    none = F.array().cast("array<bigint>")
    by_mark, by_line = _ids(low, BY_MARK), _ids(low, BY_LINE)
    pair = F.when(low.rlike(TRIGGER), F.struct(by_mark.alias("m"), by_line.alias("l"))).otherwise(F.struct(none.alias("m"), none.alias("l")))
    found = docs.select(*[docs[c] for c in keep], pair.alias("__p"))
    found = found.select(*keep, F.when(F.size("__p.l") > F.size("__p.m"), F.col("__p.l")).otherwise(F.col("__p.m")).alias("sentence_ids"))
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("spdx"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for n, x, ids in RULES])
    text = F.concat(F.lit(""), F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), ""))
    start = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("rules"), F.array().cast("array<string>").alias("licences"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["ids"])
        return F.struct(
            F.when(hit, F.replace(acc["rest"], rule["ids"], F.lit("|"))).otherwise(acc["rest"]).alias("rest"),
            F.when(hit, F.concat(acc["rules"], F.array(rule["name"]))).otherwise(acc["rules"]).alias("rules"),
            F.when(hit, F.concat(acc["licences"], F.array(rule["spdx"]))).otherwise(acc["licences"]).alias("licences"),
        )

    matched = found.withColumn("__m", F.when(F.size("sentence_ids") > 0, F.aggregate(rules, start, step)).otherwise(start))
    return matched.select(*keep, "sentence_ids", F.col("__m.rules").alias("rules"), F.array_distinct("__m.licences").alias("licences"))


def op8_licence_rules(spark, sf_dir):
    """Sentences, rules and licences of all documents, each list joined by commas.

    Null and empty texts have none (empty strings); a null doc_id stays null; repeated rows
    are judged one by one; a sentence found twice stands twice.
    """
    configure(spark)
    got = licences(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
                      F.array_join("rules", ",").alias("rules"), F.array_join(F.array_sort("licences"), ",").alias("licences"))


def _sql() -> str:
    known = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in KNOWN) + "]"
    number = f"list_filter(list_transform(string_split_regex(low, '{{}}'), lambda s: list_position({known}, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')))), lambda i: i > 0)"
    step = "SELECT doc_id, ids, replace(rest, '{p}', '|') AS rest, CASE WHEN contains(rest, '{p}') THEN list_append(rules, '{n}') ELSE rules END AS rules, CASE WHEN contains(rest, '{p}') THEN list_append(spdx, '{x}') ELSE spdx END AS spdx FROM {f}"
    ctes = [
        f"low AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents)",
        f"two AS (SELECT doc_id, {number.format(BY_MARK)} AS m, {number.format(BY_LINE)} AS l FROM low)",
        "one AS (SELECT doc_id, CASE WHEN len(l) > len(m) THEN l ELSE m END AS ids FROM two)",
        "r0 AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda i: '<' || i || '>'), '') AS rest, []::VARCHAR[] AS rules, []::VARCHAR[] AS spdx FROM one)",
    ]
    for k, (name, spdx, ids) in enumerate(RULES):
        ctes.append(f"r{k + 1} AS (" + step.format(p="".join(f"<{i}>" for i in ids), n=name, x=spdx, f=f"r{k}") + ")")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(rules, ',') AS rules,
  array_to_string(list_sort(list_distinct(spdx)), ',') AS licences FROM r{len(RULES)}"""


OP8_SQL = _sql()
