"""License scans: Dice coefficient of word bigrams between normalised text and licence templates.

Texts and templates are sequences of lower-cased runs of letters and digits, so case, punctuation, comment marks and line
breaks do not matter. A template of w words is compared with windows of w words of a text (fewer at the text's end), wherever a
window begins with a bigram of the template: with a distinct bigrams in the template, b in the window and c in both, Dice is
2c / (a + b). Size bounds come first: to reach Dice t, c must be at least t * a / (2 - t), so a window with fewer of the template's
bigrams is not compared, nor is a template with a text that has fewer in all.

Windows of one template that begin less than w words apart are one match, its best window (then its first). A match gives way to a
better one that it overlaps (higher Dice, then more words, then the name). Templates are a parameter; the default list, some 20
kilobytes, goes to the executors with the code.

Nulls: a null text has no words; a text of fewer than two words matches nothing. Repeated rows give repeated results.
Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm.textkit import pick, release, ship, sub_batches

_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""


def _gnu(name: str, version: str, it: str = "This program") -> str:
    return f"""{it} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the
Free Software Foundation, either version {version} of the License, or (at your option) any later version. {it} is distributed in the hope that
it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
the {name} for more details. You should have received a copy of the {name} along with this program. If not, see
https://www.gnu.org/licenses/."""


#: Licences, their standard headers and common notices by SPDX identifier, as they are published.
NOTICES = (
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
        ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _gnu("GNU Affero General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
        ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License."""),
    ("BSD-2-Clause", f"{_BSD} {_DISCLAIMER}"),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-3-Clause", f"""{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. {_DISCLAIMER}"""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
        Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all
        subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this
        restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works
        of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source
        language processor."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _gnu("GNU General Public License", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _gnu("GNU General Public License", "3")),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
        AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
        EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
        LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
        WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _gnu("GNU Lesser General Public License", "3", "This library")),
    ("MIT", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
        do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
        and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
        the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present
        and future rights to this software under copyright law."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
        as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution."""),
    ("all-rights-reserved", "All rights reserved."),
)
_WORDS = re.compile(r"[^\W_]+")
Match = tuple[str, int, int, float]


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def alone(found: list[Match]) -> list[Match]:
    """The matches that no better one overlaps (higher Dice, more words, name, place); a match that goes still outdoes those below it."""
    starts: list[int] = []  # what the matches so far cover, in pieces that do not overlap
    ends: list[int] = []
    out = []
    for m in sorted(found, key=lambda m: (-m[3], -m[2], m[0], m[1])):
        a, z = m[1], m[1] + m[2]
        i = j = bisect_right(ends, a)
        if j == len(starts) or starts[j] >= z:
            out.append(m)
        while j < len(starts) and starts[j] < z:
            a, z, j = min(a, starts[j]), max(z, ends[j]), j + 1
        starts[i:j], ends[i:j] = [a], [z]
    return out


class Templates:
    """The templates' bigrams, and which templates each belongs to."""

    def __init__(self, notices: tuple[tuple[str, str], ...], least: float) -> None:
        self.least = least
        self.names: list[str] = []
        self.words: list[int] = []
        self.sets: list[frozenset[tuple[str, str]]] = []
        for name, text in notices:
            w = words_of(text)
            if len(w) > 1:
                self.names.append(name)
                self.words.append(len(w))
                self.sets.append(frozenset(zip(w, w[1:], strict=False)))
        self.fewest = [max(1, math.ceil(least * len(s) / (2 - least) - 1e-9)) for s in self.sets]
        self.ids = {w: k for k, w in enumerate(sorted({w for s in self.sets for pair in s for w in pair}))}
        size = len(self.ids) + 1  # the last one stands for all other words
        # Postings: the bigrams' codes, sorted, and the templates of each, one bigram after the other.
        held = sorted((self.ids[a] * size + self.ids[b], k) for k, s in enumerate(self.sets) for a, b in s)
        codes, self.owners = (np.array([h[i] for h in held], dtype=np.int64) for i in (0, 1))
        self.codes, self.first, self.count = np.unique(codes, return_index=True, return_counts=True)

    def find(self, text: str) -> list[Match]:
        """(name, first word, words, Dice) of the matches that no better one overlaps."""
        words = words_of(text)
        other = len(self.ids)
        ids = np.fromiter((self.ids.get(w, other) for w in words), dtype=np.int64, count=len(words))
        pairs = ids[:-1] * (other + 1) + ids[1:]
        at = np.minimum(np.searchsorted(self.codes, pairs), len(self.codes) - 1)
        spots = np.flatnonzero(self.codes[at] == pairs) if len(self.codes) else at[:0]
        if not len(spots):
            return []
        code = at[spots]
        n = self.count[code]
        owner = self.owners[np.repeat(self.first[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        order = np.argsort(owner, kind="stable")
        owner, place = owner[order], np.repeat(spots, n)[order]
        found: list[Match] = []
        for k in np.flatnonzero(np.bincount(owner, minlength=len(self.sets)) >= self.fewest).tolist():
            at = place[slice(*np.searchsorted(owner, (k, k + 1)))]
            reach = self.words[k] - 1
            full = at[np.searchsorted(at, at + reach) - np.arange(len(at)) >= self.fewest[k]]
            if len(full):
                found += self._best(k, words, full.tolist(), reach)
        return alone(found)

    def _best(self, k: int, words: list[str], starts: list[int], reach: int) -> list[Match]:
        """The best window of each match of template k, of windows that begin at starts."""
        out: list[Match] = []
        wanted, counts, lo, hi, common, before = self.sets[k], {}, starts[0], starts[0], 0, None
        for s in starts:
            if s >= hi:
                counts, common, lo, hi = {}, 0, s, s
            while hi < min(s + reach, len(words) - 1):
                pair = (words[hi], words[hi + 1])
                if pair not in counts:
                    counts[pair] = 0
                    common += pair in wanted
                counts[pair] += 1
                hi += 1
            while lo < s:
                pair = (words[lo], words[lo + 1])
                counts[pair] -= 1
                if not counts[pair]:
                    del counts[pair]
                    common -= pair in wanted
                lo += 1
            dice = 2 * common / (len(wanted) + len(counts))
            if dice >= self.least:
                now = (self.names[k], s, hi - s + 1, dice)
                if before is None or s - before > reach:
                    out.append(now)
                elif dice > out[-1][3]:
                    out[-1] = now
                before = s
        return out


def scan(df: DataFrame, *, notices: tuple[tuple[str, str], ...] = NOTICES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start (the window's first word), n_words, license, dice: a row for each match."""
    ship(df.sparkSession)
    schema = "doc_id long, start long, n_words long, license string, dice double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known = Templates(notices, least)
        for b in sub_batches(batches):
            rows = [(doc, start, n, name, dice) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for name, start, n, dice in known.find(text)]
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return pick(df, id_col, text_col).mapInArrow(run, schema)


def oracle_sql(notices: tuple[tuple[str, str], ...] = NOTICES, least: float = 0.8) -> str:
    values = ", ".join(f"({k}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for k, (n, t) in enumerate(notices))
    words = lambda t: f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')"
    grams = lambda w: f"[{w}[i] || ' ' || {w}[i + 1] for i in generate_series(1, len({w}) - 1)]"
    return f"""
    WITH n(k, license, notice) AS (VALUES {values}),
    t AS (SELECT k, license, len(w) AS width, list_distinct({grams('w')}) AS g FROM (SELECT k, license, {words('notice')} AS w FROM n)),
    f AS (SELECT k, license, width, g, greatest(1, ceil({least} * len(g) / (2 - {least}) - 1e-9)) AS fewest FROM t),
    d AS (SELECT row_number() OVER () AS r, doc_id, {grams('w')} AS g FROM (SELECT doc_id, {words('text')} AS w FROM documents) WHERE len(w) > 1),
    p AS (SELECT r, unnest(generate_series(0, len(g) - 1)) AS pos, unnest(g) AS pair FROM d),
    h AS (SELECT r, pos, f.k, fewest, width FROM p JOIN (SELECT k, unnest(g) AS pair FROM f) u USING (pair) JOIN f ON f.k = u.k),
    c AS (SELECT a.r, a.pos, a.k, a.width FROM h a JOIN h b ON a.r = b.r AND a.k = b.k AND b.pos >= a.pos AND b.pos < a.pos + a.width - 1 GROUP BY ALL HAVING count(*) >= any_value(a.fewest)),
    e AS (SELECT c.r, d.doc_id, c.pos, c.k, f.license, c.width, least(c.width - 1, len(d.g) - c.pos) + 1 AS n_words, list_distinct(d.g[c.pos + 1 : c.pos + c.width - 1]) AS w, f.g FROM c JOIN d USING (r) JOIN f USING (k)),
    s AS (SELECT r, doc_id, pos, k, license, width, n_words, 2.0::DOUBLE * len(list_intersect(w, g)) / (len(w) + len(g)) AS dice FROM e),
    m AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY r, k ORDER BY pos) <= width - 1 THEN 0 ELSE 1 END AS new FROM s WHERE dice >= {least}),
    i AS (SELECT *, sum(new) OVER (PARTITION BY r, k ORDER BY pos) AS run FROM m),
    b AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY r, k, run ORDER BY dice DESC, pos) = 1)
    SELECT doc_id, pos::BIGINT AS start, n_words::BIGINT AS n_words, license, dice FROM b x
    WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.r = x.r AND y.pos < x.pos + x.n_words AND x.pos < y.pos + y.n_words AND (-y.dice, -y.n_words, y.license, y.pos, y.k) < (-x.dice, -x.n_words, x.license, x.pos, x.k))
    """
