"""Licence scans by sentence-rule recognition.

Texts are cut into pieces at line ends and after `.`, `;`, `!`, `?` before white space, and normalised (lower case, runs
of anything but letters, digits and dots to one space, dots at the ends gone). A known licence sentence is found where
it is one piece or several pieces in a row of one paragraph (blank lines and empty comment lines end it), so a text may
be wrapped at any width, with comment leaders, and a sentence may hold `v. 2.0` or `software; you`. From the left, the
longest one counts. Each known sentence has an identifier, or several. A document's identifiers, in order, form a
sequence; the ordered rules are matched against it one after the other, each taking its stretch of identifiers out,
so the longer text of a licence wins over a sentence that it shares with another.

The known sentences are a fixed table of this module, held by every task as a tree of words. Lines that are no known
sentence (names and years of copyright, titles, conditions) stand between identifiers without parting them. Only texts
with a cue word are cut, unless a caller's own sentences have one without a cue. The texts are not shuffled: only known sentences are grouped by document.

Null and empty texts hold no sentence. Rows that share an id are one document, their sentences in order of place; rules
are matched in each different text by itself, so a repeated row changes no licence.
Null ids are a document too. A document without known sentences gives no row. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of which every known sentence here has one.
CUES = ("licen", "copyright", "warrant", "permission", "redistribut", "public domain", "spdx", "endorse", "liab", "all rights")

# Known licence sentences, normalised, and their identifiers.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2.0": "ApacheRef",
    "licensed under the apache license version 2.0 the license": "ApacheHead",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this project is licensed under the mit license": "MitRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitAsIs",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "licensed under the bsd 3 clause license": "Bsd3Ref",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu general public license version 2": "Gpl2Ref",
    "either version 3 of the license or at your option any later version": "Gpl3Plus",
    "either version 2 of the license or at your option any later version": "Gpl2Plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GplTerms",
    "you should have received a copy of the gnu general public license along with this program": "GplCopy",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "MplRef",
    "licensed under cc by nc 4.0": "CcByNcRef",
    "licensed under cc by 4.0": "CcByRef",
    "licensed under cc by sa 4.0": "CcBySaRef",
    "this work is licensed under a creative commons attribution 4.0 international license": "CcByRef",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "CcByNcRef",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "all rights reserved": "Reserved",
    "spdx license identifier mit": "MitRef",
    "spdx license identifier apache 2.0": "ApacheRef",
    "spdx license identifier gpl 3.0 only": "Gpl3Ref",
    "spdx license identifier gpl 3.0 or later": "Gpl3Later",
    "spdx license identifier bsd 3 clause": "Bsd3Ref",
    "spdx license identifier mpl 2.0": "MplRef",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdAsIs",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BsdLiability",
    "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BsdLiability",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "IscAsIs",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "IscLiability",
    "this software is provided as is without any express or implied warranty": "ZlibAsIs",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "licensed under the bsd 2 clause license": "Bsd2Ref",
    "licensed under the isc license": "IscRef",
    "licensed under the mozilla public license version 2.0": "MplRef",
    "distributed under the boost software license version 1.0": "BoostRef",
    "licensed under the gnu lesser general public license version 3": "Lgpl3Ref",
    "licensed under the gnu lesser general public license version 2.1": "Lgpl21Ref",
    "licensed under the gnu affero general public license version 3": "Agpl3Ref",
    "you should have received a copy of the gnu lesser general public license along with this library": "LgplCopy",
    "you should have received a copy of the gnu affero general public license along with this program": "AgplCopy",
    "licensed under the eclipse public license 2.0": "EplRef",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "Cc0Waiver",
    "released under cc0 1.0 universal public domain dedication": "Cc0Waiver",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplNoWarranty",
    "see the gnu general public license for more details": "GplMore",
    "spdx license identifier gpl 2.0 only": "Gpl2Ref",
    "spdx license identifier gpl 2.0 or later": "Gpl2Later",
    "spdx license identifier lgpl 2.1 only": "Lgpl21Ref",
    "spdx license identifier lgpl 2.1 or later": "Lgpl21Later",
    "spdx license identifier lgpl 3.0 only": "Lgpl3Ref",
    "spdx license identifier lgpl 3.0 or later": "Lgpl3Later",
    "spdx license identifier agpl 3.0 only": "Agpl3Ref",
    "spdx license identifier agpl 3.0 or later": "Agpl3Later",
    "spdx license identifier bsd 2 clause": "Bsd2Ref",
    "spdx license identifier isc": "IscRef",
    "spdx license identifier zlib": "ZlibGrant",
    "spdx license identifier bsl 1.0": "BoostRef",
    "spdx license identifier epl 2.0": "EplRef",
    "spdx license identifier cc0 1.0": "Cc0Waiver",
    "spdx license identifier unlicense": "Unlicense",
}

_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
_FSF = f"{_GPL} as published by the free software foundation"
_LIBRARY = "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"
_AFFERO = "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"

# Known sentences besides, as the licences print them, and the identifiers that each stands for.
NOTICES: dict[str, tuple[str, ...]] = {
    f"{_FSF} either version 3 of the license or at your option any later version": ("GplTerms", "Gpl3Plus"),
    f"{_FSF} either version 2 of the license or at your option any later version": ("GplTerms", "Gpl2Plus"),
    f"{_FSF} version 3": ("Gpl3Ref",),
    f"{_FSF} version 3 of the license": ("Gpl3Ref",),
    f"{_FSF} version 2": ("Gpl2Ref",),
    f"{_FSF} version 2 of the license": ("Gpl2Ref",),
    f"{_GPL} version 2 as published by the free software foundation": ("Gpl2Ref",),
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": ("CcBySaRef",),
    f"{_LIBRARY} either version 2.1 of the license or at your option any later version": ("Lgpl21Later",),
    f"{_LIBRARY} either version 3 of the license or at your option any later version": ("Lgpl3Later",),
    f"{_AFFERO} either version 3 of the license or at your option any later version": ("Agpl3Later",),
    f"{_AFFERO} version 3 of the license": ("Agpl3Ref",),
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0": ("EplRef",),
}

# Licence rules in order; a rule matches a stretch of identifiers.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("ApacheHead", "ApacheComply", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs", "MitLiability")),
    ("ISC", ("IscGrant", "IscAsIs", "IscLiability")),
    ("ISC", ("IscGrant", "MitAsIs")),
    ("BSD-3-Clause", ("Reserved", "BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs", "BsdLiability")),
    ("BSD-2-Clause", ("Reserved", "BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs", "BsdLiability")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs", "BsdLiability")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs", "BsdLiability")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("Zlib", ("ZlibAsIs", "ZlibLiability", "ZlibGrant")),
    ("GPL-3.0-or-later", ("GplTerms", "Gpl3Plus", "GplNoWarranty", "GplMore", "GplCopy")),
    ("GPL-2.0-or-later", ("GplTerms", "Gpl2Plus", "GplNoWarranty", "GplMore", "GplCopy")),
    ("GPL-3.0-or-later", ("GplTerms", "Gpl3Plus", "GplCopy")),
    ("GPL-2.0-or-later", ("GplTerms", "Gpl2Plus", "GplCopy")),
    ("GPL-3.0-or-later", ("GplTerms", "Gpl3Plus")),
    ("GPL-2.0-or-later", ("GplTerms", "Gpl2Plus")),
    ("LGPL-2.1-or-later", ("Lgpl21Later", "LgplCopy")),
    ("LGPL-3.0-or-later", ("Lgpl3Later", "LgplCopy")),
    ("AGPL-3.0-or-later", ("Agpl3Later", "GplNoWarranty", "AgplCopy")),
    ("GPL-3.0-or-later", ("Gpl3Later",)),
    ("GPL-2.0-or-later", ("Gpl2Later",)),
    ("LGPL-3.0-or-later", ("Lgpl3Later",)),
    ("LGPL-2.1-or-later", ("Lgpl21Later",)),
    ("AGPL-3.0-or-later", ("Agpl3Later",)),
    ("GPL-3.0-only", ("Gpl3Ref",)),
    ("GPL-2.0-only", ("Gpl2Ref",)),
    ("LGPL-3.0-only", ("Lgpl3Ref",)),
    ("LGPL-2.1-only", ("Lgpl21Ref",)),
    ("AGPL-3.0-only", ("Agpl3Ref",)),
    ("Apache-2.0", ("ApacheHead",)),
    ("Apache-2.0", ("ApacheRef",)),
    ("MIT", ("MitGrant",)),
    ("MIT", ("MitRef",)),
    ("ISC", ("IscGrant",)),
    ("ISC", ("IscRef",)),
    ("BSD-3-Clause", ("Bsd3Ref",)),
    ("BSD-2-Clause", ("Bsd2Ref",)),
    ("Zlib", ("ZlibGrant",)),
    ("BSL-1.0", ("BoostRef",)),
    ("EPL-2.0", ("EplRef",)),
    ("MPL-2.0", ("MplRef",)),
    ("CC0-1.0", ("Cc0Waiver",)),
    ("CC-BY-NC-4.0", ("CcByNcRef",)),
    ("CC-BY-SA-4.0", ("CcBySaRef",)),
    ("CC-BY-4.0", ("CcByRef",)),
    ("Unlicense", ("Unlicense",)),
    ("all-rights-reserved", ("Reserved",)),
)

_CUT = re.compile(r"\n|(?<=[.;!?])[ \t\r]+")
_OTHER = re.compile(r"[^\w.]|_")
# Comment leaders that are words.
_LEADERS = ("dnl", "rem")
# A cue of two words may be wrapped as well.
_CUE = "(?i)" + "|".join(c.replace(" ", rf"[^a-z0-9]+(?:(?:{'|'.join(_LEADERS)})[^a-z0-9]+)?") for c in CUES)
_IDS = ""  # in the tree of words, the identifiers of the sentence that ends here


def _tree(sentences: dict[str, tuple[str, ...]]) -> dict:
    root: dict = {}
    for sentence, ids in sentences.items():
        node = root
        for word in sentence.split():
            node = node.setdefault(word, {})
        node[_IDS] = ids
    return root


def _words(piece: str) -> list[str]:
    """The piece's words with their dots; dots alone and comment words before it, and dots alone after it, are gone."""
    words = _OTHER.sub(" ", piece.lower()).split()
    while words and not words[-1].strip("."):
        words.pop()
    k = next((k for k, w in enumerate(words) if w.strip(".") and w not in _LEADERS), len(words))
    return words[k:]


def _longest(pieces: list[list[str]], i: int, tree: dict) -> tuple[int, tuple[str, ...]] | None:
    """The last piece and the identifiers of the longest known sentence that starts with piece i."""
    node, best = tree, None
    for j in range(i, len(pieces)):
        words = pieces[j]
        if not words:
            break
        for k, word in enumerate(words):
            if j == i and k == 0:
                word = word.lstrip(".")
            if k == len(words) - 1 and (end := node.get(word.rstrip("."), {}).get(_IDS)):
                best = j, end
            node = node.get(word)
            if node is None:
                return best
    return best


def find(text: str, tree: dict) -> list[dict]:
    """place (of the piece where it starts), part (of several identifiers) and sentence_id of the known sentences."""
    pieces, out, i = [_words(p) for p in _CUT.split(text)], [], 0
    while i < len(pieces):
        best = _longest(pieces, i, tree)
        if best:
            out += [{"place": i, "part": k, "sentence_id": x} for k, x in enumerate(best[1])]
        i = best[0] + 1 if best else i + 1
    return out


def known_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: dict[str, str] = SENTENCES, notices: dict[str, tuple[str, ...]] = NOTICES) -> DataFrame:
    """doc_id, row (of the text), place (of the sentence in its text), part, sentence_id."""
    tree = _tree({s: (i,) for s, i in sentences.items()} | notices)

    @F.pandas_udf("array<struct<place: int, part: int, sentence_id: string>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([find(t, tree) for t in texts], dtype=object)

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text")).where("text IS NOT NULL")
    if all(re.search(_CUE, known) for known in (*sentences, *notices)):
        texts = texts.where(F.col("text").rlike(_CUE))  # a sentence without a cue must be looked for in every text
    return texts.select("doc_id", "row", F.explode(found("text")).alias("s")).select("doc_id", "row", "s.*")


def licences(found: DataFrame, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> DataFrame:
    """Per document: sentence_ids (of all its rows, by place), licences (in rule order, once each) and unmatched
    identifiers, each joined by `;`. Rules are matched in each different text by itself."""
    place = F.struct("place", "part", "sentence_id")
    ordered = found.groupBy("doc_id", "row").agg(F.collect_list(place).alias("all"))
    ids = F.transform(F.array_sort(F.array_distinct("all")), lambda x: x["sentence_id"])
    rest, names = F.concat(F.lit(";"), F.array_join(F.transform(ids, lambda x: F.concat(x, F.lit(";"))), ";"), F.lit(";")), []
    out = ordered.withColumn("rest", rest)
    # the sequence is ;A;;B;;C; so that a stretch is one substring and neighbours don't share a delimiter
    for k, (_, sentences) in enumerate(rules):
        stretch = "".join(f";{i};" for i in sentences)
        out = out.withColumn(f"r{k}", F.contains("rest", F.lit(stretch))).withColumn("rest", F.replace("rest", F.lit(stretch), F.lit(";-;")))
        names.append(F.when(F.col(f"r{k}"), F.struct(F.lit(k).alias("k"), F.lit(rules[k][0]).alias("name"))))
    left = F.filter(F.split("rest", ";"), lambda x: (x != "") & (x != "-"))
    texts = out.select("doc_id", F.struct("row", "all", F.array_compact(F.array(*names)).alias("names"), left.alias("left")).alias("t"))
    both = texts.groupBy("doc_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    joined = lambda c: F.flatten(F.transform("t", lambda x: x[c]))
    one = lambda c, field: F.transform(F.array_sort(joined(c)), lambda x: x[field])
    return both.select("doc_id", F.array_join(one("all", "sentence_id"), ";").alias("sentence_ids"), F.array_join(F.array_distinct(one("names", "name")), ";").alias("licences"), F.array_join(joined("left"), ";").alias("unmatched"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return licences(known_sentences(docs, doc_id, text))


def oracle() -> str:
    """The scan in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({q(s)}, {q(i)})" for s, i in SENTENCES.items())
    rest, steps = "s0", []
    for k, (_, ids) in enumerate(RULES):
        stretch = q("".join(f";{i};" for i in ids))
        steps.append(f"s{k + 1} AS (SELECT *, contains(rest{k}, {stretch}) AS r{k}, replace(rest{k}, {stretch}, ';-;') AS rest{k + 1} FROM {rest})")
        rest = f"s{k + 1}"
    seen = " || ".join(
        f"CASE WHEN r{k}{''.join(f' AND NOT r{j}' for j in range(k) if RULES[j][0] == n)} THEN {q(n + ';')} ELSE '' END" for k, (n, _) in enumerate(RULES)
    )
    return rf"""
        WITH known(sentence, sentence_id) AS (VALUES {values}),
        cut AS (SELECT doc_id, unnest(ss) AS raw, generate_subscripts(ss, 1) AS place FROM (
          SELECT doc_id, string_split(regexp_replace(text, '([.;!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)) AS ss FROM documents WHERE text IS NOT NULL)),
        hit AS (SELECT doc_id, place, sentence_id FROM cut JOIN known
          ON known.sentence = trim(regexp_replace(lower(raw), '[^\p{{L}}\p{{N}}.]+', ' ', 'g'), ' .')),
        s0 AS (SELECT doc_id, string_agg(sentence_id, ';' ORDER BY place, sentence_id) AS sentence_ids,
                      ';' || string_agg(sentence_id || ';', ';' ORDER BY place, sentence_id) || ';' AS rest0 FROM hit GROUP BY doc_id),
        {", ".join(steps)}
        SELECT doc_id, sentence_ids, rtrim({seen}, ';') AS licences,
               array_to_string(list_filter(string_split(rest{len(RULES)}, ';'), lambda x: x <> '' AND x <> '-'), ';') AS unmatched FROM {rest}"""
