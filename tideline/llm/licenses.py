"""Licence scans by the Dice coefficient over word bigrams (operator 7)."""

from __future__ import annotations

import pkgutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm import _text
from tideline.llm._shared import distinct_columns

#: Licence identifiers and notices of public licences.
_NOTICES: tuple[tuple[str, str], ...] = (
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "Affero General Public License for more details.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
        "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "Lesser General Public License for more details.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software.",
    ),
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.",
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
    "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


_BSL = (
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
    "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a "
    "source language processor.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, "
    "TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_ZLIB = (
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
    "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This "
    "notice may not be removed or altered from any source distribution.",
)


def _notice(name: str) -> str:
    """The longest notice of a licence."""
    return max((t for n, t in _NOTICES if n == name), key=len)


#: Whole texts, and paragraphs of the short ones; wording that two BSD licences share has the shorter one's name.
_TEXTS: tuple[tuple[str, str], ...] = (
    *(("BSD-2-Clause", t) for t in (*_BSD, _BSD_DISCLAIMER, " ".join((*_BSD, _BSD_DISCLAIMER)))),
    *(("BSD-3-Clause", t) for t in (_BSD_THIRD, " ".join((*_BSD, _BSD_THIRD)), " ".join((*_BSD, _BSD_THIRD, _BSD_DISCLAIMER)))),
    *(("MIT", t) for t in (_MIT_DISCLAIMER, f"{_notice('MIT')} {_MIT_DISCLAIMER}")),
    *(("BSL-1.0", t) for t in (*_BSL, " ".join((_notice("BSL-1.0"), *_BSL)))),
    *(("Zlib", t) for t in (*_ZLIB, " ".join((_notice("Zlib"), *_ZLIB)))),
    *(("ISC", t) for t in (_ISC_DISCLAIMER, f"{_notice('ISC')} {_ISC_DISCLAIMER}")),
    *((name, pkgutil.get_data("tideline.llm", f"license_texts/{name}.txt").decode()) for name in ("Apache-2.0", "Artistic-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense")),
)
TEMPLATES: tuple[tuple[str, str], ...] = _NOTICES + _TEXTS
LEVELS = ("line", "paragraph", "document")
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def _bigrams(w: _text.Words, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of two consecutive words of one segment, and the segment of each."""
    ok = segment[1:] == segment[:-1] if len(segment) else np.zeros(0, bool)
    at = np.flatnonzero(ok)
    return _text.Rolling(w.hash).of(at, at + 2), segment[at]


class Templates:
    """Bigram sets of the templates, and all their bigrams with the templates that hold them."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [t[0] for t in templates]
        self.sets = []
        for _, text in templates:
            buf, offsets = _text.raw(pa.array([text]))
            w = _text.words(_PLAIN[buf], offsets)
            self.sets.append(np.unique(_bigrams(w, w.row)[0]))
        self.size = np.array([len(s) for s in self.sets])
        self.keys = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.held = np.stack([np.isin(self.keys, s) for s in self.sets]) if self.sets else np.zeros((0, 0), bool)
        self.marks = np.zeros(1 << 20, bool)
        self.marks[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def best(self, bigrams: np.ndarray, least: float) -> tuple[int, float]:
        """The template with the highest Dice coefficient to a bigram set, of those whose size allows `least`; -1 if none reaches it."""
        n = len(bigrams)
        # 2 * min(a, b) / (a + b) bounds the coefficient
        near = np.flatnonzero(2.0 * np.minimum(self.size, n) >= least * (self.size + n))
        if not len(near):
            return -1, 0.0
        at = np.minimum(np.searchsorted(self.keys, bigrams), len(self.keys) - 1)
        own = at[self.keys[at] == bigrams]
        dice = 2.0 * self.held[np.ix_(near, own)].sum(axis=1) / (self.size[near] + n)
        k = int(dice.argmax())
        return (int(near[k]), float(dice[k])) if dice[k] >= least else (-1, 0.0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Lines, paragraphs (between empty lines) and whole texts that match a licence template.

    Text is normalised to lower-case words of letters and digits; two sets of word bigrams match if
    their Dice coefficient is `least` at least; templates whose size can't reach it are not
    compared; ties go to the first template. A paragraph of one line or a text of one paragraph is not
    compared again. Returns a row for each match: doc_id, level, line (from 0, the segment's first),
    license, dice.

    Null and empty texts and segments of one word match nothing; null ids stay null; repeated rows
    give repeated matches; an empty table gives no rows; other columns are not read.
    """
    known = Templates(templates)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, str, int, str, float]] = []
            buf, offsets = _text.raw(batch.column("text"))
            for i, j in _text.cut(offsets):
                for r, level, line, t, dice in _slice(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    rows.append((i + r, level, line, known.names[t], dice))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())),
                    "level": pa.array([r[1] for r in rows], pa.string()),
                    "line": pa.array([r[2] for r in rows], pa.int64()),
                    "license": pa.array([r[3] for r in rows], pa.string()),
                    "dice": pa.array([r[4] for r in rows], pa.float64()),
                }
            )

    def _slice(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str, int, int, float]]:
        w = _text.words(_PLAIN[buf], offsets)
        if not len(w):
            return
        ends = np.flatnonzero(buf == 10)
        line = np.searchsorted(ends, w.start)  # lines of the whole slice
        first_line = np.searchsorted(ends, offsets[:-1])
        line_id = line + w.row  # a text's end ends its line too
        new_line = np.concatenate([[True], line_id[1:] != line_id[:-1]])
        new_paragraph = np.concatenate([[True], (w.row[1:] != w.row[:-1]) | (line[1:] > line[:-1] + 1)])
        paragraph = np.cumsum(new_paragraph)
        lines_of = np.bincount(paragraph, new_line)
        paragraphs_of = np.bincount(w.row, new_paragraph)
        for level, segment, real in zip(LEVELS, (line_id, paragraph, w.row), (None, lines_of > 1, paragraphs_of > 1), strict=True):
            h, of = _bigrams(w, segment)
            hit = known.marks[(h & np.uint64(0xFFFFF)).astype(np.int64)]
            hit[hit] = np.isin(h[hit], known.keys)
            # a match shares bigrams in number: 2 * shared >= least * (own + template's)
            shared = np.bincount(of[hit], minlength=int(of[-1]) + 1 if len(of) else 0)
            for s in np.flatnonzero(shared).tolist():
                if real is not None and not real[s]:
                    continue
                a, b = np.searchsorted(of, s), np.searchsorted(of, s, side="right")
                own = np.unique(h[a:b])
                if 2.0 * shared[s] < least * len(own):
                    continue
                t, dice = known.best(own, least)
                if t >= 0:
                    k = int(np.searchsorted(segment, s))
                    yield int(w.row[k]), level, int(line[k] - first_line[w.row[k]]), t, dice

    return distinct_columns(docs, id_col, text_col).mapInArrow(go, "doc_id long, level string, line long, license string, dice double")
