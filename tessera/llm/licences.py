"""Licence recognition by known sentences and ordered rules, in DataFrame functions only.

A text is normalised to lower-case ASCII letters and digits with single spaces; comment marks go with that.  It is
cut into sentences at runs of . ! ? : ; before white space and at paragraph ends (lines without letters or
digits), and sentences into pieces at line ends and before the openings of the longer known sentences.  A known
sentence counts where it is one piece or several that follow each other, so it may be wrapped, commented, on one
line with others, or a line of its own in a paragraph; where several known ones start, the longest counts, and
what it covers isn't used again.  Known sentences are found by hash lookup of the joined pieces and give their
identifiers.

The identifiers in order are then matched against the rules, first to last: a rule is a sequence of identifiers
that must follow each other (with no other known sentence between); what it matches is taken away, so that a
licence's sentences don't match a later, less specific rule.  Both steps are single expressions whatever the
number of sentences and rules.  Every known sentence holds one of a few words; only texts with one of these are cut.

Null and empty texts have no known sentences and no licences.  Repeated rows give repeated results.  Empty table:
empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._store import quoted

# Wording of public licence texts and notices, normalised, and cut as texts are.
SENTENCES: dict[str, list[str]] = {
    "MIT-NAME": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "the mit license mit", "the mit license", "mit license", "spdx license identifier mit"],
    "MIT-GRANT": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MIT-NOTICE": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "AS-IS": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "MIT-LIABLE": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "ISC-GRANT": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "0BSD-GRANT": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "ISC-AS-IS": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "ISC-NAME": ["isc license", "the isc license", "licensed under the isc license", "spdx license identifier isc"],
    "APACHE2-NAME": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "apache license version 2 0", "apache license version 2 0 january 2004", "spdx license identifier apache 2 0"],
    "APACHE2-TEXT": ["license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document"],
    "APACHE2-TERMS": ["you may not use this file except in compliance with the license"],
    "APACHE2-COPY": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "APACHE2-LAW": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "GPL3-NAME": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0 only"],
    "GPL3-TEXT": ["the gnu general public license is a free copyleft license for software and other kinds of works"],
    "GPL2-TEXT": ["by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users"],
    "LGPL3-TEXT": ["this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below"],
    "LGPL21-TEXT": ["this license the lesser general public license applies to some specially designated software packages typically libraries of the free software foundation and other authors who decide to use it"],
    "AGPL3-TEXT": ["the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"],
    "GPL3-LATER": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "GPL2-LATER": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "LGPL3-LATER": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "LGPL21-LATER": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "AGPL3-LATER": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "GPL-TERMS": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "LGPL-TERMS": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "LATER-2": ["either version 2 of the license or at your option any later version"],
    "LATER-21": ["either version 2 1 of the license or at your option any later version"],
    "LATER-3": ["either version 3 of the license or at your option any later version"],
    "FSF-HOPE": ["this program is distributed in the hope that it will be useful but without any warranty", "this library is distributed in the hope that it will be useful but without any warranty"],
    "FSF-IMPLIED": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "FSF-DETAILS": ["see the gnu general public license for more details", "see the gnu lesser general public license for more details", "see the gnu affero general public license for more details"],
    "BSD-GRANT": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSD-SOURCE": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSD-BINARY": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BSD-ENDORSE": ["may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BSD-AS-IS": ["as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "BSD-NAME": ["licensed under the bsd license", "spdx license identifier bsd 3 clause"],
    "MPL2-NAME": ["this source code form is subject to the terms of the mozilla public license v", "mozilla public license version 2 0", "spdx license identifier mpl 2 0"],
    "MPL2-TEXT": ["contributor means each individual or legal entity that creates contributes to the creation of or owns covered software"],
    "EPL2-NAME": ["eclipse public license v 2 0", "spdx license identifier epl 2 0"],
    "EPL-TEXT": ["the accompanying program is provided under the terms of this eclipse public license agreement"],
    "CCBYNC4-NAME": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CCBYSA4-NAME": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CCBY4-NAME": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CC0-NAME": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0 1 0 universal", "a work made available under cc0 may be protected by copyright and related or neighboring rights copyright and related rights"],
    "UNLICENSE": ["this is free and unencumbered software released into the public domain"],
    "RESERVED": ["all rights reserved"],
}
#: What the free software foundation's notices go on with.
_FSF = ("FSF-HOPE", "FSF-IMPLIED", "FSF-DETAILS")
#: Licence and the sentence identifiers that must follow each other, most specific first.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("MIT-NAME", "MIT-GRANT", "MIT-NOTICE", "AS-IS", "MIT-LIABLE")),
    ("MIT", ("MIT-GRANT", "MIT-NOTICE", "AS-IS", "MIT-LIABLE")),
    ("MIT", ("MIT-NAME", "MIT-GRANT", "MIT-NOTICE", "AS-IS")),
    ("MIT", ("MIT-GRANT", "MIT-NOTICE", "AS-IS")),
    ("MIT", ("MIT-GRANT", "MIT-NOTICE")),
    ("ISC", ("ISC-NAME", "ISC-GRANT", "ISC-AS-IS")),
    ("ISC", ("ISC-GRANT", "ISC-AS-IS")),
    ("0BSD", ("0BSD-GRANT", "ISC-AS-IS")),
    ("Apache-2.0", ("APACHE2-TEXT", "APACHE2-NAME", "APACHE2-TERMS", "APACHE2-COPY", "APACHE2-LAW")),
    ("Apache-2.0", ("APACHE2-NAME", "APACHE2-TERMS", "APACHE2-COPY", "APACHE2-LAW")),
    ("Apache-2.0", ("APACHE2-NAME", "APACHE2-TERMS", "APACHE2-COPY")),
    ("GPL-3.0", ("GPL3-TEXT", "GPL3-LATER", *_FSF)),
    ("GPL-3.0", ("GPL3-TEXT",)),
    ("GPL-2.0", ("GPL2-TEXT", "GPL-TERMS", "LATER-2", *_FSF)),
    ("GPL-2.0", ("GPL2-TEXT",)),
    ("LGPL-2.1", ("LGPL21-TEXT", "LGPL-TERMS", "LATER-21", *_FSF)),
    ("LGPL-2.1", ("LGPL21-TEXT",)),
    ("LGPL-3.0", ("LGPL3-TEXT",)),
    ("AGPL-3.0", ("AGPL3-TEXT", "AGPL3-LATER", *_FSF)),
    ("AGPL-3.0", ("AGPL3-TEXT",)),
    ("GPL-3.0-or-later", ("GPL3-LATER", *_FSF)),
    ("GPL-2.0-or-later", ("GPL2-LATER", *_FSF)),
    ("GPL-2.0-or-later", ("GPL-TERMS", "LATER-2", *_FSF)),
    ("GPL-3.0-or-later", ("GPL-TERMS", "LATER-3", *_FSF)),
    ("LGPL-3.0-or-later", ("LGPL3-LATER", *_FSF)),
    ("LGPL-2.1-or-later", ("LGPL21-LATER", *_FSF)),
    ("LGPL-2.1-or-later", ("LGPL-TERMS", "LATER-21", *_FSF)),
    ("AGPL-3.0-or-later", ("AGPL3-LATER", *_FSF)),
    ("GPL-3.0-or-later", ("GPL3-LATER",)),
    ("GPL-2.0-or-later", ("GPL2-LATER",)),
    ("GPL-2.0-or-later", ("GPL-TERMS", "LATER-2")),
    ("LGPL-3.0-or-later", ("LGPL3-LATER",)),
    ("LGPL-2.1-or-later", ("LGPL21-LATER",)),
    ("LGPL-2.1-or-later", ("LGPL-TERMS", "LATER-21")),
    ("AGPL-3.0-or-later", ("AGPL3-LATER",)),
    ("BSD-3-Clause", ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE", "BSD-AS-IS")),
    ("BSD-3-Clause", ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE")),
    ("BSD-3-Clause", ("BSD-GRANT", "BSD-ENDORSE")),
    ("BSD-2-Clause", ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-AS-IS")),
    ("BSD-2-Clause", ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY")),
    ("BSD-2-Clause", ("BSD-GRANT",)),
    ("MIT", ("MIT-NAME",)),
    ("ISC", ("ISC-NAME",)),
    ("Apache-2.0", ("APACHE2-TEXT",)),
    ("Apache-2.0", ("APACHE2-NAME",)),
    ("GPL-3.0-only", ("GPL3-NAME",)),
    ("BSD-3-Clause", ("BSD-NAME",)),
    ("MPL-2.0", ("MPL2-NAME", "MPL2-TEXT", "MPL2-NAME")),
    ("MPL-2.0", ("MPL2-NAME",)),
    ("MPL-2.0", ("MPL2-TEXT",)),
    ("EPL-2.0", ("EPL2-NAME", "EPL-TEXT")),
    ("EPL-2.0", ("EPL2-NAME",)),
    ("CC-BY-NC-4.0", ("CCBYNC4-NAME",)),
    ("CC-BY-SA-4.0", ("CCBYSA4-NAME",)),
    ("CC-BY-4.0", ("CCBY4-NAME",)),
    ("CC0-1.0", ("CC0-NAME",)),
    ("Unlicense", ("UNLICENSE",)),
]
#: Words of an opening, and of the sentences that have one.
OPENING, LONG = 4, 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STOP = r"[.!?:;]+[\"')\]]*(?=[ \t\n]|$)"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values) -> str:
    return ", ".join(_text(v) for v in values)


def _known(sentences: dict[str, list[str]]) -> dict[str, str]:
    return {text: name for name, texts in sentences.items() for text in texts}


def cover(texts: list[str]) -> list[str]:
    """A few words such that each text has one of them: the longest words' most frequent first."""
    left = [set(t.split()) for t in texts]
    out: list[str] = []
    while left:
        counts = Counter(w for words in left for w in words if len(w) >= 6 or len(w) == max(map(len, words)))
        word = min(counts, key=lambda w: (-counts[w], w))
        out.append(word)
        left = [words for words in left if word not in words]
    return out


def _flat(text: Column, known: dict[str, str]) -> Column:
    """The text in lower case with S after each sentence and L between its pieces; '' for texts that can't have a known one."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    low = F.when(low.rlike("|".join(cover(list(known)))), low).otherwise(F.lit(""))
    steps = [
        (r"\r\n?", "\n"),
        (STOP, "S"),
        (r"\n([^a-z0-9S\n]*\n)+", "S"),
        (r"\n", "L"),
        (r"[^a-z0-9SL]+", " "),
        (r" ?([SL]) ?", "$1"),
    ]
    openings = sorted({" ".join(t.split()[:OPENING]) for t in known if len(t.split()) >= LONG})
    steps.append((rf" (?=(?:copyright c|{'|'.join(openings)})\b)", "L"))
    for pattern, mark in steps:
        low = F.regexp_replace(low, pattern, mark)
    return F.trim(low)


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, list[str]] | None = None, rules: list | None = None) -> DataFrame:
    """(doc_id, n_known, sentence_ids, licences, n_unmatched) for every document.

    n_known is the number of known sentences; sentence_ids and licences are comma-joined, in the order of the
    text and of the rules; n_unmatched counts known sentences that no rule took.
    """
    known = _known(sentences or SENTENCES)
    most = max(len(t.split()) for t in known)
    first = sorted({t.split()[0] for t in known})
    # All runs of pieces that are known, as (first piece, - last piece, sentence): in order, the longest of a start first.
    runs = f"""flatten(transform(filter(sequence(0, size(p) - 1), i -> substring_index(p[i], ' ', 1) IN ({_list(first)})),
        i -> filter(transform(sequence(i, least(size(p) - 1, i + {most})), j -> struct(i AS i, -j AS j, array_join(slice(p, i + 1, j - i + 1), ' ') AS t)), c -> c.t IN ({_list(known)}))))"""
    taken = f"""aggregate(array_sort({runs.replace("p[", "x.p[").replace("size(p)", "size(x.p)").replace("slice(p", "slice(x.p")}), struct(-1 AS till, CAST(array() AS array<string>) AS ids),
        (a, c) -> if(c.i > a.till, struct(-c.j AS till, concat(a.ids, array(c.t)) AS ids), a), a -> a.ids)"""
    cut = docs.select(quoted(docs, id_col).cast("long").alias("doc_id"), _flat(quoted(docs, text_col).cast("string"), known).alias("flat"))
    pieces = "transform(filter(split(flat, 'S'), s -> s <> '' AND s <> 'L'), s -> struct(filter(split(s, 'L'), w -> w <> '') AS p))"
    found = cut.select("doc_id", F.expr(f"flatten(transform(filter({pieces}, x -> size(x.p) > 0), x -> {taken}))").alias("found"))
    names = f"map({', '.join(f'{_text(t)}, {_text(n)}' for t, n in known.items())})"
    ids = found.select("doc_id", F.expr(f"transform(found, t -> element_at({names}, t))").alias("ids"))
    table = ", ".join(f"struct({_text(licence)} AS licence, {_text(''.join(f'<{i}>' for i in sequence))} AS ids)" for licence, sequence in rules or RULES)
    matched = f"""aggregate(filter(array({table}), r -> size(ids) > 0), struct(array_join(transform(ids, i -> concat('<', i, '>')), '') AS rest, CAST(array() AS array<string>) AS licences),
        (a, r) -> if(contains(a.rest, r.ids), struct(replace(a.rest, r.ids, '#') AS rest, array_union(a.licences, array(r.licence)) AS licences), a))"""
    out = ids.select("doc_id", "ids", F.expr(matched).alias("m"))
    unmatched = F.length("m.rest") - F.length(F.replace("m.rest", F.lit("<"), F.lit("")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join("m.licences", ",").alias("licences"), unmatched.cast("long").alias("n_unmatched"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_sql() -> str:
    """The scan of sentences that are a line or part of one; wrapped ones and whole licences have tests of their own."""
    known = _known(SENTENCES)
    texts, names = ("[" + ", ".join(f"'{x}'" for x in xs) + "]" for xs in (known.keys(), known.values()))
    steps = [
        f"""s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(translate(regexp_replace(coalesce(text, ''),
            '[.!?:;]+["'')\\]]*([ \\t\\r\\n]|$)|[\\r\\n]', chr(10), 'g'), '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)""",
        f"i AS (SELECT doc_id, list_transform(list_filter(s, lambda x: list_contains({texts}, x)), lambda x: {names}[list_position({texts}, x)]) AS ids FROM s)",
        "r0 AS (SELECT doc_id, len(ids)::BIGINT AS n_known, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') AS rest, '' AS licences FROM i)",
    ]
    for k, (licence, sequence) in enumerate(RULES):
        pattern = "".join(f"<{x}>" for x in sequence)
        steps.append(
            f"""r{k + 1} AS (SELECT doc_id, n_known, sentence_ids, replace(rest, '{pattern}', '#') AS rest,
            CASE WHEN contains(rest, '{pattern}') AND NOT contains(',' || licences || ',', ',{licence},')
            THEN licences || CASE WHEN licences = '' THEN '' ELSE ',' END || '{licence}' ELSE licences END AS licences FROM r{k})"""
        )
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, n_known, sentence_ids, licences, (length(rest) - length(replace(rest, '<', '')))::BIGINT AS n_unmatched FROM r{len(RULES)}"
