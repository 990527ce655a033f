"""License scans by sentence rules, with DataFrame functions only.

A text is normalised and cut into sentences; known licence sentences, of any
length, give their identifiers; the sequence of identifiers is matched against
ordered rules, longer ones first, and what a rule matched isn't matched again.
A sentence may be wrapped over lines, with comment marks at their heads; a line
on its own is a sentence too, a blank line always ends one.

Defined results: null and empty texts, and texts without a known sentence, have
an empty sequence and no licences; repeated sentences count each time; a known
sentence that no rule uses leaves the licence ``unknown``; other columns are
ignored whatever their names are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Identifier and normalised sentence (lower case, single spaces, no punctuation at the ends); short forms and whole ones.
SENTENCES = (
    ("apache_by", "licensed under the apache license, version 2.0"),
    ("apache_by", "licensed under the apache license, version 2.0 the license"),
    ("apache_may", "you may not use this file except in compliance with the license"),
    ("apache_copy", "you may obtain a copy of the license at"),
    ("apache_asis", "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"),
    ("apache_see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit_by", "released under the mit license"),
    ("mit_grant", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit_grant", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files the software, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions"),
    ("mit_notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit_asis", "the software is provided as is, without warranty of any kind, express or implied"),
    ("mit_asis", "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("gpl3_by", "this work is licensed under the gnu general public license, version 3"),
    ("gpl_free", "this program is free software"),
    ("gpl_terms", "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl_terms", "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or at your option any later version"),
    ("gpl_terms", "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 2 of the license, or at your option any later version"),
    ("gpl_hope", "this program is distributed in the hope that it will be useful, but without any warranty"),
    ("gpl_hope", "this program is distributed in the hope that it will be useful, but without any warranty, without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl_details", "see the gnu general public license for more details"),
    ("gpl_received", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl_free", "this library is free software"),
    ("lgpl_terms", "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl_terms", "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 2.1 of the license, or at your option any later version"),
    ("lgpl_terms", "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or at your option any later version"),
    ("agpl_terms", "you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or at your option any later version"),
    ("mpl2_by", "this source code form is subject to the terms of the mozilla public license, v. 2.0"),
    ("mpl2_copy", "if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/"),
    ("epl2_by", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("isc_grant", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc_asis", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("unlicense_by", "this is free and unencumbered software released into the public domain"),
    ("boost_by", "distributed under the boost software license, version 1.0"),
    ("zlib_asis", "this software is provided as-is, without any express or implied warranty"),
    ("zlib_grant", "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("spdx_apache2", "spdx-license-identifier: apache-2.0"),
    ("spdx_mit", "spdx-license-identifier: mit"),
    ("spdx_bsd3", "spdx-license-identifier: bsd-3-clause"),
    ("spdx_bsd2", "spdx-license-identifier: bsd-2-clause"),
    ("spdx_gpl2", "spdx-license-identifier: gpl-2.0-only"),
    ("spdx_gpl3", "spdx-license-identifier: gpl-3.0-only"),
    ("spdx_gpl3plus", "spdx-license-identifier: gpl-3.0-or-later"),
    ("spdx_mpl2", "spdx-license-identifier: mpl-2.0"),
    ("bsd_grant", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd_source", "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd_binary", "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd_name", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ccbync4_by", "licensed under cc by-nc 4.0"),
    ("ccby4_by", "licensed under cc by 4.0"),
    ("ccbysa4_by", "licensed under cc by-sa 4.0"),
    ("cc0_by", "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "all rights reserved"),
)
#: Licence and the ordered identifiers that stand for it.
RULES = (
    ("Apache-2.0", ("apache_by", "apache_may", "apache_copy", "apache_asis", "apache_see")),
    ("Apache-2.0", ("apache_by", "apache_may")),
    ("Apache-2.0", ("apache_by",)),
    ("MIT", ("mit_grant", "mit_notice", "mit_asis")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("mit_by",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("GPL-3.0-only", ("gpl3_by",)),
    ("GPL-any", ("gpl_free", "gpl_terms", "gpl_hope", "gpl_details", "gpl_received")),
    ("GPL-any", ("gpl_free", "gpl_terms", "gpl_hope")),
    ("GPL-any", ("gpl_free", "gpl_terms")),
    ("LGPL-any", ("lgpl_free", "lgpl_terms")),
    ("LGPL-any", ("gpl_free", "lgpl_terms")),
    ("AGPL-3.0-or-later", ("gpl_free", "agpl_terms")),
    ("MPL-2.0", ("mpl2_by", "mpl2_copy")),
    ("MPL-2.0", ("mpl2_by",)),
    ("EPL-2.0", ("epl2_by",)),
    ("ISC", ("isc_grant", "isc_asis")),
    ("Unlicense", ("unlicense_by",)),
    ("BSL-1.0", ("boost_by",)),
    ("Zlib", ("zlib_asis", "zlib_grant")),
    ("Apache-2.0", ("spdx_apache2",)),
    ("MIT", ("spdx_mit",)),
    ("BSD-3-Clause", ("spdx_bsd3",)),
    ("BSD-2-Clause", ("spdx_bsd2",)),
    ("GPL-2.0-only", ("spdx_gpl2",)),
    ("GPL-3.0-only", ("spdx_gpl3",)),
    ("GPL-3.0-or-later", ("spdx_gpl3plus",)),
    ("MPL-2.0", ("spdx_mpl2",)),
    ("CC-BY-NC-4.0", ("ccbync4_by",)),
    ("CC-BY-4.0", ("ccby4_by",)),
    ("CC-BY-SA-4.0", ("ccbysa4_by",)),
    ("CC0-1.0", ("cc0_by",)),
    ("proprietary", ("reserved",)),
)
#: Only texts with one of these words are looked at.
HINT = r"(?i)licen[sc]e|unencumbered|permi|redistribut|warrant|copyright|free\W+software|rights\W+reserved|neighboring"
#: Comment marks at a line's head, and those that close a comment or a box at its end.
HEAD = r"(?m)^[^\S\n]*+(?:(?:/\*++|\*++/?|//++|#++|;++|--++|%++|>++|<!--|\|++|dnl\b|@?rem\b)[^\S\n]*+)++"
TAIL = r"(?m)[^\S\n]*+(?:\*++/|-->|\*++|#++|\|++)[^\S\n]*+$"


def normalise(text: Column) -> Column:
    """Lower case without quotes, brackets and comment marks; a line break stays, a sentence's end is two."""
    s = F.regexp_replace(F.lower(text), r"\R", "\n")
    s = F.regexp_replace(F.regexp_replace(s, HEAD, ""), TAIL, "")
    s = F.regexp_replace(s, r"""["'()*#/“”‘’`]{2,}|["'()*#“”‘’`]""", "")
    s = F.regexp_replace(s, r"(?<!spdx-license-identifier)(?<!\sv)[.!?;:]++(?=\s|$)", "\n\n")
    return F.regexp_replace(F.regexp_replace(s, r"[^\S\n]++", " "), r" ?\n ?", "\n")


def known_sentences() -> str:
    """Pattern of the known sentences of a normalised text; any of their spaces may be a line break."""
    each = sorted({s for _, s in SENTENCES}, key=len, reverse=True)
    said = "|".join("[ \\n]".join(re.escape(w) for w in s.split(" ")) for s in each)
    return rf"(?:^|\n)[\p{{Punct}} ]*+({said})(?=[\p{{Punct}} ]*+(?:\n|$))"


def sentence_ids(text: Column) -> Column:
    """Identifiers of a text's known sentences, in order."""
    known = F.create_map(*(F.lit(v) for s, i in {s: i for i, s in SENTENCES}.items() for v in (s, i)))
    found = F.regexp_extract_all(normalise(text), F.lit(known_sentences()), F.lit(1))
    ids = F.transform(found, lambda s: F.element_at(known, F.replace(s, F.lit("\n"), F.lit(" "))))
    return F.when(F.rlike(text, F.lit(HINT)), ids).otherwise(F.expr("cast(array() as array<string>)"))


def licences(ids: Column, rules=RULES) -> Column:
    """Licences whose rules match the sequence of identifiers, sorted; each identifier serves one rule."""
    left = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    found = []
    for name, sequence in sorted(rules, key=lambda r: -len(r[1])):
        said = f" {'  '.join(sequence)} "
        found.append(F.when(F.contains(left, F.lit(said)), F.lit(name)))
        left = F.replace(left, F.lit(said), F.lit("."))
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))
    return F.when(F.size(ids) == 0, F.expr("cast(array() as array<string>)")).when(F.size(names) == 0, F.array(F.lit("unknown"))).otherwise(names)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids and licenses of every document; no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(F.coalesce(F.col(text_col), F.lit(""))).alias("sentence_ids"))
    return rows.withColumn("licenses", licences(F.col("sentence_ids")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))
