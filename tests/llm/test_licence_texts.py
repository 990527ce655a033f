"""Licence texts as they are published, wrapped and in comments."""

from statloom.llm import licenses

APACHE = """Copyright 2024 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2024 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
APACHE_IDS = ["apache_by", "apache_may", "apache_copy", "apache_asis", "apache_see"]


def commented(text, mark, head="", tail=""):
    return head + "\n".join(f"{mark}{line}" for line in text.split("\n")) + tail


def test_published_texts(spark):
    texts = {"Apache-2.0": APACHE, "MIT": MIT, "GPL-any": GPL, "BSD-2-Clause": BSD}
    rows = []
    for name, t in texts.items():
        ways = (t, t.replace("\n", "\r\n"), commented(t, "# "), commented(t, "// "), commented(t, " * ", "/*\n", "\n */\nint x;"), "\n\n".join(p.replace("\n", " ") for p in t.split("\n\n")), "A heading\n" + t + "\nmore text")
        rows += [(f"{name} {i}", name, w) for i, w in enumerate(ways)]
    out = licenses.scan(spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id string, text string")).collect()
    assert {r.doc_id: r.licenses for r in out} == {k: [n] for k, n, _ in rows}
    assert all(r.sentence_ids == APACHE_IDS for r in out if r.doc_id.startswith("Apache"))


def test_a_part_of_a_sentence_is_not_one(spark):
    rows = [(1, "it was not licensed under cc by 4.0 before"), (2, "A title without an end\nReleased under the MIT License\nmore text"), (3, "all rights\n\nreserved"), (4, "All rights\n# reserved."), (5, "# Licensed\n" * 20_000)]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: ["MIT"], 3: [], 4: ["proprietary"], 5: []}


MORE = {
    "LGPL-any": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS.",
}


def test_more_licences_and_tags(spark):
    rows = [(i, "\n".join(f"{mark}{line}" for line in t.split("\n")), name) for i, (mark, name, t) in enumerate((m, n, t) for m in ("", "# ", " * ") for n, t in MORE.items())]
    rows += [(100, "// SPDX-License-Identifier: Apache-2.0\n\ncode", "Apache-2.0"), (101, "/* SPDX-License-Identifier: MIT */\ncode", "MIT"), (102, "# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later")]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, name string")).collect()}
    assert {i: got[i] for i, _, _ in rows} == {i: [n] for i, _, n in rows}
