"""Licence scans: passages compared with licence templates by the Dice coefficient over word bigrams.

A text is compared as a whole, by paragraph, by line, and by windows of words that pay no heed to lines: windows from
the length of the template up to the longest that its size bounds allow, that begin or end with a bigram of the
template. Shorter windows would cut off what tells one notice from another ("version 1.1" from "version 2.0").
A passage with a bigrams and a template with b can only reach a coefficient t if a lies between b * t / (2 - t) and
b * (2 - t) / t, and if they share at least the lower bound; templates of which a text has fewer bigrams are not
compared with it at all, and windows are only looked at where enough of them lie close together.

Defined results: null and empty texts have no passage and no licence; passages and templates of one word have no
bigram and match nothing; among templates with the same coefficient the first name wins; equal rows have equal
results; other columns, and those named like a result, are carried along or give way.
"""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator, Mapping
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.expressions import unused, with_results

THRESHOLD = 0.8
#: Characters up to which a passage is cut into words at once.
SHORT = 2000
WORD = re.compile("[A-Za-z0-9]+")
PARAGRAPH = re.compile(r"\n[ \t\r]*\n")

#: Words of a text that are looked at together, besides the longest window.
BLOCK = 1 << 16


def _full(name: str) -> str:
    return pkgutil.get_data("wordloom.llm", f"license_texts/{name}.txt").decode()


_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Public notices and licences in their full wording. A match needs their wording.
TEMPLATES = {
    "Apache-2.0": _full("Apache-2.0"),
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "BSD-2-Clause line": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": (
        f"{_BSD_START}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        f"promote products derived from this software without specific prior written permission. {_BSD_END}"
    ),
    "BSD-3-Clause line": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": _full("GPL-2.0"),
    "GPL-2.0 notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this "
        "program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA "
        "02110-1301 USA."
    ),
    "GPL-3.0": _full("GPL-3.0"),
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this "
        "program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "LGPL-2.1": _full("LGPL-2.1"),
    "LGPL-3.0": _full("LGPL-3.0"),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE "
        "IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT line": "Released under the MIT License.",
    "MPL-2.0": _full("MPL-2.0"),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Reserved line": "All rights reserved.",
}


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def _words(passage: str) -> list[str]:
    return [word.lower() for word in WORD.findall(passage)]


class Matcher:
    """Finds the templates that a text holds."""

    def __init__(self, templates: Mapping[str, str], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must lie above 0 and at most at 1")
        self.threshold = threshold
        cut = [(name, _words(text)) for name, text in sorted(templates.items())]
        self.templates = [(name, bigrams(words)) for name, words in cut if len(words) > 1]
        #: The bigrams, repeats too, of the shortest and the longest window.
        self.windows = [(len(words) - 1, int((len(words) - 1) * (2 - threshold) / threshold + 1e-9)) for _, words in cut if len(words) > 1]
        self.known = set().union(*(grams for _, grams in self.templates)) if self.templates else set()
        share = threshold / (2 - threshold)
        # Rounding must not cut off a size that lies exactly on its bound.
        self.bounds = [(len(grams) * share - 1e-9, len(grams) / share + 1e-9) for _, grams in self.templates]
        self.least = min((low for low, _ in self.bounds), default=float("inf"))
        self.most = max((high for _, high in self.bounds), default=0)

    def passages(self, text: str) -> Iterator[str]:
        lines = text.split("\n")
        yield from lines
        if len(lines) > 1:
            paragraphs = PARAGRAPH.split(text)
            if len(paragraphs) > 1:
                yield from (paragraph for paragraph in paragraphs if "\n" in paragraph)
            yield text

    def grams(self, passage: str) -> set[tuple[str, str]]:
        """The bigrams of a passage; none as soon as they are too many or too few for every template."""
        if len(passage) <= SHORT:
            words = WORD.findall(passage)
            return bigrams([word.lower() for word in words]) if len(words) - 1 >= self.least else set()
        grams, last = set(), None
        for found in WORD.finditer(passage):
            word = found[0].lower()
            if last is not None:
                grams.add((last, word))
                if len(grams) > self.most:
                    return set()
            last = word
        return grams

    def blocks(self, text: str) -> Iterator[list[tuple[str, str]]]:
        """The bigrams of a text in order, in blocks that share as many as the longest window has."""
        longest = max((most for _, most in self.windows), default=0)
        words = (found[0].lower() for found in WORD.finditer(text))
        if len(text) <= BLOCK:
            words = iter(_words(text))
        held: list[str] = []
        while new := list(islice(words, BLOCK)):
            block = held + new
            yield list(zip(block, block[1:]))
            held = block[-longest - 1 :]

    def matches(self, text: str | None) -> dict[str, float]:
        """The best coefficient of each template that some passage or window reaches the threshold with."""
        best: dict[str, float] = {}
        text = text or ""
        held: set[tuple[str, str]] = set()
        for grams in self.blocks(text):
            present = self.known.intersection(grams)
            held |= present
            block = None
            for at, (name, template) in enumerate(self.templates):
                if len(present) >= self.bounds[at][0] and len(present & template) >= self.bounds[at][0]:
                    block = block or _Block(grams)
                    dice = block.best(template, *self.windows[at], self.bounds[at][0], max(best.get(name, 0.0), self.threshold))
                    if dice >= self.threshold and dice > best.get(name, 0.0):
                        best[name] = dice
        sought = [
            (name, template, low, high)
            for (name, template), (low, high) in zip(self.templates, self.bounds)
            if best.get(name) != 1.0 and len(held & template) >= low
        ]
        for passage in self.passages(text) if sought else ():
            grams = self.grams(passage)
            if grams.isdisjoint(self.known):
                continue
            for name, template, low, high in sought:
                if low <= len(grams) <= high:
                    dice = 2 * len(grams & template) / (len(grams) + len(template))
                    if dice >= self.threshold and dice > best.get(name, 0.0):
                        best[name] = dice
        return best


class _Block:
    """The bigrams of a stretch of text and, of each, where it stood before."""

    def __init__(self, grams: list[tuple[str, str]]):
        self.grams = grams
        last: dict[tuple[str, str], int] = {}
        before = np.empty(len(grams), dtype=np.int64)
        for i, gram in enumerate(grams):
            before[i] = last.get(gram, -1)
            last[gram] = i
        self.before = before

    def best(self, template: set[tuple[str, str]], shortest: int, longest: int, needed: float, least: float) -> float:
        """The best coefficient of a window with the template; 0 if none reaches ``least``."""
        if len(self.grams) < shortest:
            return 0.0
        hit = np.fromiter(map(template.__contains__, self.grams), dtype=bool, count=len(self.grams))
        hits = np.flatnonzero(hit)
        starts = np.union1d(hits, hits - shortest + 1)
        starts = starts[(starts >= 0) & (starts + shortest <= len(hit))]
        near = np.minimum(np.searchsorted(hits, starts + longest) - np.searchsorted(hits, starts), len(template))
        starts, near = starts[near >= needed], near[near >= needed]
        found = 0.0
        for i in np.argsort(-near, kind="stable"):
            bound = 2 * near[i] / (near[i] + len(template))
            if bound < least or bound <= found:
                break  # no later one has more
            inside = slice(starts[i], starts[i] + longest)
            new = self.before[inside] < starts[i]
            shared = np.cumsum(new & hit[inside])[shortest - 1 :]
            found = max(found, float((2 * shared / (np.cumsum(new)[shortest - 1 :] + len(template))).max()))
        return found if found >= least else 0.0


def license_scan(
    documents: DataFrame, text: str = "text", templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """The documents with ``licence`` and ``dice`` of the best match (null without) and the sorted names ``licences``."""
    templates = dict(templates)

    @F.pandas_udf("licence string, dice double, licences array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(templates, threshold)
        for batch in batches:
            rows = []
            for one in batch:
                found = matcher.matches(one)
                first = min(found, key=lambda name: (-found[name], name), default=None)
                rows.append((first, found.get(first), sorted(found)))
            yield pd.DataFrame(rows, columns=["licence", "dice", "licences"]).astype({"dice": "float64"})

    name = unused(documents, "_scan")
    scanned = documents.withColumn(name, scan(F.col(text)))
    return with_results(scanned, **{key: F.col(name)[key] for key in ("licence", "dice", "licences")}).drop(name)
