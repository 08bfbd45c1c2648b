"""Licence scan: Dice coefficient over word bigrams against licence templates.

A text is normalised (A-Z lower-cased, every character but a-z and 0-9 and line ends a blank) and
compared as a whole, by paragraph (between empty lines), by line and by passage.  The Dice coefficient of two
sets of bigrams is twice the shared bigrams over the sum of both sizes; it cannot reach a threshold
t unless the sizes' ratio is at least t / (2 - t), so only templates of fitting size are compared.

Licences of several lines or paragraphs inside a larger text are found as passages: of all runs of
consecutive lines, joined, the one nearest to a template counts like a paragraph.  Lines without words
do not matter, so blank lines, CRLF and comment signs before or behind the words do not either.

Defined results: a null text counts as empty and has no licence; units of fewer than two words have
no bigrams and match nothing; ties go to the smaller name; null and repeated ids give a row each;
other columns play no part; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from depotline.llm.common import id_text, map_slices

THRESHOLD = 0.8

# fixed values: names and wording of notices and of short licences, as published
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the
License.""",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details. You should have received a copy of the GNU General Public License along with this program.
If not, see https://www.gnu.org/licenses/.""",
    "gpl-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License version 2 as published by the Free Software Foundation.""",
    "gpl-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details. You should have received a copy of the GNU General Public License along with this program;
if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "lgpl-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser
General Public License for more details. You should have received a copy of the GNU Lesser General Public License along
with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA
02110-1301 USA.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "apache-2.0-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "bsd-conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.""",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
}

_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789\n"
_TABLE = bytes(c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def normalise(text: str) -> bytes:
    return text.encode().translate(_TABLE)


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:]))


class Matcher:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.sets = sorted((len(b), name, b) for name, b in ((n, bigrams(normalise(t).split())) for n, t in templates.items()) if b)
        self.least = min((size for size, *_ in self.sets), default=0) * threshold / (2 - threshold)

    def best(self, unit: bytes) -> tuple[float, str] | None:
        """Best coefficient from the threshold on and its template's name."""
        words = unit.split()
        if len(words) - 1 < max(1, self.least):
            return None
        own = bigrams(words)
        low, high = len(own) * self.threshold / (2 - self.threshold), len(own) * (2 - self.threshold) / self.threshold
        scores = [(2 * len(own & b) / (len(own) + size), name) for size, name, b in self.sets if low - 1e-9 <= size <= high + 1e-9]
        return min(((-s, n) for s, n in scores if s >= self.threshold), default=None)

    def passages(self, lines: list[bytes], skip: set[str]) -> Iterator[tuple[float, str]]:
        """For each template but those to skip, the best match of the run of lines nearest to it, if
        that reaches the threshold.

        Only runs are tried that cannot be cut at an end without losing a bigram of the template: a
        run goes on as long as its first line has one that does not come again, and is compared
        where the last line brought a new one.  So a line lies in few runs, however long the text."""
        words, ends = [], []
        for line in lines:
            more = line.split()
            if more:
                words += more
                ends.append(len(words))
        pairs = list(zip(words, words[1:]))
        have = set(pairs)
        for size, name, wanted in self.sets:
            low, high = size * self.threshold / (2 - self.threshold), size * (2 - self.threshold) / self.threshold
            if name in skip or len(have & wanted) < low - 1e-9:
                continue
            nearest: tuple[float, int, int] = (0.0, 0, 0)
            for first, begin in enumerate([0, *ends[:-1]]):
                own: set[tuple[bytes, bytes]] = set()
                only: set[tuple[bytes, bytes]] = set()  # wanted bigrams that begin in the first line and not behind it
                shared, at, head = 0, begin, ends[first]
                if not any(p in wanted for p in pairs[begin:head]):
                    continue
                for end in ends[first:]:
                    before = shared
                    while at < end - 1:
                        p = pairs[at]
                        if p in wanted:
                            shared += p not in own
                            if at < head:
                                only.add(p)
                            else:
                                only.discard(p)
                        own.add(p)
                        at += 1
                    if len(own) > high + 1e-9:
                        break
                    if shared > before:
                        nearest = max(nearest, (2 * shared / (len(own) + size), -begin, -end))
                    if end > head and not only:
                        break
            if nearest[0] >= self.threshold and (m := self.best(b" ".join(words[-nearest[1] : -nearest[2]]))):
                yield m

    def document(self, text: str) -> tuple[int, str | None, float, str]:
        """Matching lines, best licence and coefficient over all units, all licences in order."""
        raw = normalise(text)
        lines = [m for m in map(self.best, raw.split(b"\n")) if m]
        paragraphs = raw.split(b"\n\n")
        units = lines + [m for m in map(self.best, {raw, *paragraphs}) if m]
        units += self.passages(raw.split(b"\n"), {n for s, n in units if s == -1})
        if not units:
            return len(lines), None, 0.0, ""
        score, name = min(units)
        return len(lines), name, -score, ",".join(sorted({n for _, n in units}))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_lines (lines that match), license (best over all units, else
    null), dice (its coefficient, else 0), licenses (names of all matches, comma-joined)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = Matcher(templates, threshold)
        for b in batches:
            out = pd.DataFrame(list(map(tool.document, b["text"])), columns=["n_lines", "license", "dice", "licenses"])
            yield out.assign(doc_id=b["doc_id"].to_numpy())

    return map_slices(id_text(docs, id_col, text_col), run, "doc_id long, n_lines long, license string, dice double, licenses string")


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB SQL over ``documents`` that hold no passage nearer to a template than
    their lines, paragraphs and whole texts; passages are tested against all runs of lines."""
    values = ", ".join("('{}', '{}')".format(n, normalise(t).decode().replace("\n", " ")) for n, t in templates.items())
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    words = "list_filter(string_split_regex({}, '[ \\n]+'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT name, {pairs} AS b FROM (SELECT name, {words.format('body')} AS w FROM (VALUES {values}) v(name, body))),
d AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\n]', ' ', 'g') AS n FROM documents),
u AS (SELECT doc_id, 1 AS is_line, unnest(string_split(n, chr(10))) AS unit FROM d
      UNION ALL SELECT doc_id, 0, unnest(string_split(n, chr(10) || chr(10))) FROM d
      UNION ALL SELECT doc_id, 0, n FROM d),
s AS (SELECT row_number() OVER () AS k, doc_id, is_line, {pairs} AS b
      FROM (SELECT doc_id, is_line, {words.format('unit')} AS w FROM u) WHERE len(w) > 1),
m AS (SELECT k, s.doc_id, is_line, name, 2.0::DOUBLE * len(list_intersect(s.b, t.b)) / (len(s.b) + len(t.b)) AS dice
      FROM s JOIN t ON len(s.b) + len(t.b) <= 2 * least(len(s.b), len(t.b)) / {threshold} + 1e-6),
best AS (SELECT * FROM m WHERE dice >= {threshold} QUALIFY row_number() OVER (PARTITION BY k ORDER BY dice DESC, name) = 1),
r AS (SELECT doc_id, sum(is_line)::BIGINT AS n_lines, arg_min(name, (-dice, name)) AS license, max(dice) AS dice,
             string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM best GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, license, coalesce(dice, 0) AS dice, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""
