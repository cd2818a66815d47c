"""License scans (9): conditional compression against license templates.

A template with n words tolerates d = n // TOLERANCE differing words. Cut into d + 1 segments, one of them at least is intact in any stretch that matches, so
candidate blocks are the windows around intact segments: a stretch without one can't match. Each distinct block is compressed alone and with every template that
it has a segment of as zstandard raw dictionary; templates are ranked by the size reduction, and each is confirmed or refused by the exact
wording differences (word edits against the best-fitting stretch). Where confirmed stretches overlap, the wording decides (see `judged`), and
the rank only between equals: templates that differ in one word often compress a block to the same size.

TEMPLATES holds notices and whole short licenses; whole long ones (GPL, Apache and so on) are read from a folder of text files by `from_folder`.
"""

from __future__ import annotations

import re
from bisect import bisect, insort
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import byte_texts, rows, short_batches

#: One differing word is tolerated for so many words of a template.
TOLERANCE = 10
LEVEL, CACHE_BLOCKS = 3, 50_000
#: Bytes of the longest block whose matches are kept.
CACHE_BYTES = 1 << 14
#: One edit in a cell of `fitted`: more than any text has words.
EDIT = 1 << 40
WORD = re.compile(r"\w+")

#: Wordings of license notices (fixed values: public license texts and customary notices).
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "MIT-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain
        the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
        ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain
        the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
        ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-grant": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the
        above copyright notice, this list of conditions and the following disclaimer.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
        appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is
        granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software
        must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
        required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
        or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
        copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
        overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE.""",
    "Unlicense-dedication": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
        or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
        copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
        overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "BSL-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
        reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to
        the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the
        Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language
        processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND
        NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
        IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSL-1.0-grant": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
        reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to
        the following:""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-2.0-or-later-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either
        version 2 of the License, or (at your option) any later version.""",
    "GPL-3.0-or-later-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version.""",
    "LGPL-2.1-or-later-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;
        either version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version.""",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/.""",
    "CC0-1.0-notice": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is
        distributed without any warranty.""",
}


def from_folder(path: str) -> dict[str, str]:
    """Templates from a local folder of text files, one license each, by their names without ending: for whole long licenses."""
    return {p.stem if p.suffix == ".txt" else p.name: p.read_text(errors="replace") for p in sorted(Path(path).iterdir()) if p.is_file()}


@dataclass
class Template:
    name: str
    words: list[str]
    slack: int
    segments: list[tuple[int, list[str]]]
    raw: zstandard.ZstdCompressor
    length: int


def segments(words: list[str], slack: int) -> list[tuple[int, list[str]]]:
    """(place, words) of slack + 1 parts of one length, side by side: slack edits leave one of them as it is."""
    n = len(words) // (slack + 1)
    return [(k * n, words[k * n : (k + 1) * n]) for k in range(slack + 1)]


def built(templates: dict[str, str]) -> list[Template]:
    out = []
    for name, text in templates.items():
        text = " ".join(text.lower().split())
        words = WORD.findall(text)
        if not words:
            raise ValueError(f"{name} has no words")
        slack = len(words) // TOLERANCE
        d = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(Template(name, words, slack, segments(words, slack), zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False), len(words)))
    return out


def fitted(template: list[str], block: list[str], slack: int) -> tuple[int, int, int] | None:
    """(differing words, first word, past the last) of the stretch of block nearest to template (the leftmost of the nearest), or None beyond slack."""
    numbers: dict[str, int] = {}
    at = np.array([numbers.setdefault(w, len(numbers)) for w in block], np.int64)
    # a cell: least edits of the template so far against a stretch that ends there, times EDIT, and where that starts
    row = np.arange(len(block) + 1)
    steps = EDIT * np.arange(len(block) + 1)
    for i, w in enumerate(template, 1):
        new = np.empty_like(row)
        new[0] = i * EDIT
        new[1:] = np.minimum(row[:-1] + EDIT * (at != numbers.get(w, -1)), row[1:] + EDIT)
        row = np.minimum.accumulate(new - steps) + steps  # words of the block that the template lacks
        if int(row.min()) // EDIT > slack:
            return None
    end = int(np.argmin(row // EDIT))
    edits, start = divmod(int(row[end]), EDIT)
    return (edits, start, end) if edits <= slack else None


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.templates = built(templates)
        self.by_name = {t.name: t for t in self.templates}
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        # segments by their longest word, which few texts have
        self.by_cue: dict[str, list[tuple[int, int, list[str], Template]]] = {}
        for t in self.templates:
            for place, part in t.segments:
                k = max(range(len(part)), key=lambda k: len(part[k]))
                self.by_cue.setdefault(part[k], []).append((k, place, part, t))
        self.seen: dict[tuple, tuple | None] = {}

    def windows(self, words: list[str]) -> set[tuple[int, int, str]]:
        """(from, to, template): where a whole template would be around an intact segment, give or take its slack. Every stretch within slack of a template lies in a window of it."""
        found = set()
        for i, w in enumerate(words):
            for k, place, part, t in self.by_cue.get(w, ()):
                if i >= k and words[i - k : i - k + len(part)] == part:
                    first = i - k - place
                    found.add((max(0, first - t.slack), min(len(words), first + t.length + t.slack), t.name))
        return found

    def stretches(self, words: list[str]) -> list[tuple[int, int, tuple[Template, ...]]]:
        """(from, to, templates) of candidate blocks by word number: windows that overlap are one block."""
        out: list[list] = []
        for a, b, name in sorted(self.windows(words)):
            if out and a < out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
                out[-1][2].setdefault(name, self.by_name[name])
            else:
                out.append([a, b, {name: self.by_name[name]}])
        return [(a, b, tuple(ts.values())) for a, b, ts in out]

    def judged(self, block: list[str], templates: tuple[Template, ...]) -> list[tuple]:
        """(name, reduction, rank, differing, from, to) of confirmed templates of a block; a word belongs to one match.

        Of overlapping stretches the one wins whose template has most words, less two for each that differs: of templates of one
        length the one with fewest differing words, and a near copy of a long text before a short notice inside it. Then the better rank, then the name, then the place.
        Windows wait in the order of the best score that they can have, equals by rank; one is fitted when it is its turn, to the words that no better match has taken by then, so a template
        that can't win any more is spared. A window whose stretch loses words to a better match is fitted once more to what is left. So the work grows with the length of the block.
        """
        key = (" ".join(block), tuple(t.name for t in templates))
        if key in self.seen:
            return self.seen[key]
        text = key[0].encode()
        alone = len(self.plain.compress(text))
        sizes = {t.name: len(t.raw.compress(text)) for t in templates}
        rank = {t.name: k for k, t in enumerate(sorted(templates, key=lambda t: (sizes[t.name], t.name)), 1)}
        #: (score, rank, name, end, start, differing, window); a window that isn't fitted yet stands at the best score that it can have, with no end
        heap = [(-self.by_name[name].length, rank[name], name, -1, -1, -1, a, b) for a, b, name in self.windows(block) if name in rank]
        heapify(heap)
        out: list[tuple] = []
        taken: list[tuple[int, int]] = []  # in order
        while heap:
            score, place, name, y, x, differing, a, b = heappop(heap)
            t = self.by_name[name]
            near = taken[max(0, bisect(taken, (a, a)) - 1) : bisect(taken, (b, b))]
            if y >= 0 and all(end <= x or y <= start for start, end in near):
                insort(taken, (x, y))
                out.append((name, (alone - sizes[name]) / alone, place, differing, x, y))
                continue
            at, free = a, []  # the free pieces of the window
            for start, end in near:
                if end > a and start < b:
                    free.append((at, start))
                    at = max(at, end)
            for p, q in [*free, (at, b)]:
                if q - p >= t.length - t.slack and (got := fitted(t.words, block[p:q], t.slack)):
                    heappush(heap, (2 * got[0] - t.length, place, name, p + got[2], p + got[1], got[0], p, q))
        out.sort(key=lambda m: m[4:])
        if len(text) <= CACHE_BYTES:
            if len(self.seen) > CACHE_BLOCKS:
                self.seen.clear()
            self.seen[key] = out
        return out

    def scan(self, text: bytes) -> list[tuple]:
        """(name, reduction, rank, differing words, first character, past the last) of each match in a text."""
        full = text.decode("utf-8", "replace")
        words = [w.lower() for w in WORD.findall(full)]
        if self.by_cue.keys().isdisjoint(words):
            return []
        blocks = self.stretches(words)
        spans = [(m.start(), m.end()) for m in WORD.finditer(full)] if blocks else []
        return [(name, red, rank, diff, spans[a + x][0], spans[a + y - 1][1]) for a, b, ts in blocks for name, red, rank, diff, x, y in self.judged(words[a:b], ts)]


SCHEMA = "doc_id long, license string, reduction double, rank int, n_diff int, start long, end long"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per match: doc_id, license (template name), reduction (share of the block's compressed size), rank of the template for the block,
    n_diff (differing words), start and end in characters.

    Null and empty texts have no matches, an empty table gives no rows; whole texts are scanned, however long; columns beside doc_id and text are left behind; rows without an id are scanned too; repeated rows repeat their matches; a word belongs to one match, that of the
    template whose wording fits best (see `Scanner.judged`); of templates that fit equally the one with the larger reduction wins, then the name.
    """
    short_batches(docs.sparkSession)
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            got = [(i, *m) for i, t in rows([batch]) for m in scanner.scan(t)]
            cols = list(zip(*got, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "license", "reduction", "rank", "n_diff", "start", "end"])

    return byte_texts(docs).mapInArrow(run, SCHEMA)
