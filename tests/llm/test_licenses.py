import re
from collections import Counter

import pytest

from wordloom.llm import licenses, queries

SF_DIR = "/root/testdata/sf0.001"


def grams(text):
    words = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {(a, b) for a, b in zip(words, words[1:])}


def brute(text):
    text = text or ""
    passages = [text, *re.split(r"\n[ \t\r]*\n", text), *text.split("\n")]
    best = {}
    for name, template in licenses.TEMPLATES.items():
        t = grams(template)
        for p in map(grams, passages):
            if p and t and (dice := 2 * len(p & t) / (len(p) + len(t))) >= 0.8:
                best[name] = max(dice, best.get(name, 0))
    first = min(best, key=lambda name: (-best[name], name), default=None)
    return first, best.get(first), ",".join(sorted(best))


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op6_license_scan(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    assert {row.doc_id: (row.licence, row.dice, row.licences) for row in rows} == {doc_id: brute(text) for doc_id, text in texts.items()}
    assert any(row.licence for row in rows)


MIT = licenses.TEMPLATES["MIT"]
EDGES = [
    None, "", "\n\n", "License", "Released under the MIT License.", "released UNDER the\tmit license", "Released under the old MIT License.",
    MIT, MIT.replace(". ", ".\n").replace(", ", ",\n"), f"# header\n\n{MIT.replace(', ', chr(10))}\n\nprint(1)", MIT[: len(MIT) // 2],
    "All rights reserved.\nLicensed under CC BY 4.0.\nLicensed under CC BY-SA 4.0.", "word " * 200_000, "Lizenz für alle. " * 3,
]


def test_edges_ties_and_clashing_columns(spark):
    frame = spark.createDataFrame([(i % 3, text, "x") for i, text in enumerate(EDGES + EDGES)], "doc_id int, text string, licence string")
    rows = licenses.license_scan(frame).collect()
    assert Counter((r.licence, r.dice, ",".join(r.licences)) for r in rows) == Counter(map(brute, EDGES + EDGES))
    assert licenses.license_scan(frame.limit(0)).count() == 0
    assert {r.licence for r in licenses.license_scan(frame, templates={"none": "one"}).collect()} == {None}
    with pytest.raises(ValueError):
        licenses.Matcher(licenses.TEMPLATES, 0)


FILLER = "The river ran high that spring and nobody in the valley could remember a wetter March or a later frost."
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the University nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

""" + licenses._BSD_END


def test_notices_inside_longer_documents_and_lines(spark):
    notices = {"ISC": ISC, "GPL-3.0 notice": GPL, "Apache-2.0 notice": APACHE, "BSD-3-Clause": BSD, "MIT line": "Released under the MIT License."}
    notices |= {name: licenses.TEMPLATES[name] for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0")}
    long = "\n\n".join([FILLER] * 300)
    rows = []
    for name, notice in notices.items():
        commented = "\n".join(f" * {line}" for line in notice.split("\n"))
        texts = (notice, f"{long}\n\n{notice}\n\n{long}", f"{FILLER}\n{commented}\n{FILLER}", f"{FILLER} {' '.join(notice.split())} {FILLER}")
        rows += [(name, text) for text in texts]
    found = licenses.license_scan(spark.createDataFrame(rows, "name string, text string")).collect()
    assert len(found) == len(rows)
    for row in found:  # a short notice may be part of a longer one
        assert row[0] in row.licences and row.dice > 0.95 and row.licence.split()[0] == row[0].split()[0]


def test_other_versions_and_mere_words_are_no_licence():
    matcher = licenses.Matcher(licenses.TEMPLATES, licenses.THRESHOLD)
    for text in ("Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-NC-SA 4.0.", "Released under the old MIT License.", FILLER):
        for whole in (text, f"{FILLER} {text} {FILLER}"):
            assert matcher.matches(whole) == {}


def test_windows_equal_brute_force_and_do_not_depend_on_blocks(monkeypatch):
    import random

    draw = random.Random(5)
    templates = {"a": "one two three four five", "b": "two three one two", "c": "five one"}
    matcher = licenses.Matcher(templates, 0.6)
    found = 0
    for _ in range(400):
        words = [draw.choice("one two three four five six seven".split()) for _ in range(draw.randint(1, 40))]
        want = {}
        for name, template in templates.items():
            t, n = grams(template), len(template.split()) - 1
            for begin in range(len(words)):
                for size in range(n, int(n * 1.4 / 0.6 + 1e-9) + 1):
                    pairs = list(zip(words[begin : begin + size + 1], words[begin + 1 : begin + size + 1]))
                    if len(pairs) == size and (pairs[0] in t or size == n and pairs[-1] in t):
                        want[name] = max(want.get(name, 0), 2 * len(set(pairs) & t) / (len(set(pairs)) + len(t)))
            whole = grams(" ".join(words))
            if whole:
                want[name] = max(want.get(name, 0), 2 * len(whole & t) / (len(whole) + len(t)))
        want = {name: dice for name, dice in want.items() if dice >= 0.6}
        monkeypatch.setattr(licenses, "BLOCK", 1 << 16)
        assert matcher.matches(" ".join(words)) == want
        monkeypatch.setattr(licenses, "BLOCK", 3)
        assert matcher.matches(" ".join(words)) == want
        found += len(want)
    assert found > 100
