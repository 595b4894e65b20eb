"""License scan: MinHash of overlapping word windows retrieves templates, containment decides.

For each class of template lengths, windows of that many words (and a quarter more) are taken a
quarter apart, so each place where a template may stand lies whole in some window. A window that holds the
share CONTAINED of a template's g shingles has c = ceil(CONTAINED * g) in common with it and at most all of its own
and g - c more in the union: that is the least similarity at which the template must be found. Each class has as
many bands of one row as bring the chance to miss its worst template below MISSED. What is retrieved is
verified exactly: the share of the template's distinct shingles that the window holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dynofleet.llm.textops import Slice, mix, shingles, slices

#: Words of a shingle; and the chance with which a window that holds a template may be missed.
SHINGLE, MISSED = 3, 1e-3
#: Share of a template's shingles that a window must hold.
CONTAINED = 0.8

# Public notices, in natural order.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-2-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND "
        "ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
        "source distribution."
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
        "copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication "
        "for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law."
    ),
}

#: Everything but ASCII letters, digits and bytes of other characters parts the words of a notice.
_APART = np.ones(256, dtype=bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _salts(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _shingles_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s = next(slices(pa.array(texts), 1 << 40))
    _, _, words, bounds = s.words(lower=True, apart=_APART)
    return (*shingles(words, bounds, SHINGLE), np.diff(bounds))


class Templates:
    """Shingle sets of the templates, and for each length class their minima in every band."""

    def __init__(self, texts: dict[str, str], contained: float = CONTAINED):
        self.names = list(texts)
        grams, at, n_words = _shingles_of(list(texts.values()))
        self.sets = [np.unique(grams[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        self.classes: dict[int, list[int]] = {}
        for t, n in enumerate(n_words):
            self.classes.setdefault(max(8, 1 << int(n - 1).bit_length()), []).append(t)
        self.bands = {width: max(self._bands(len(self.sets[t]), width, contained) for t in of) for width, of in self.classes.items()}
        # Of every class and band: sorted minima and whose they are.
        self.minima = {}
        for width, of in self.classes.items():
            m = np.array([[mix(self.sets[t] ^ salt).min() for t in of] for salt in _salts(self.bands[width])])
            order = m.argsort(1)
            self.minima[width] = (np.take_along_axis(m, order, 1), np.array(of)[order])

    @staticmethod
    def _bands(size: int, width: int, contained: float) -> int:
        """Bands for a template of ``size`` shingles in windows of five quarters of ``width``."""
        common = math.ceil(contained * size)
        least = common / (5 * (width // 4) + size - common)
        return 1 if least >= 1 else math.ceil(math.log(MISSED) / math.log(1 - least))


def _window_minima(h: np.ndarray, step: int) -> np.ndarray:
    """Minima of five steps of ``step`` values, at every step."""
    block = np.minimum.reduceat(h, np.arange(0, len(h), step))
    out = block.copy()
    for k in range(1, 5):
        out[:-k] = np.minimum(out[:-k], block[k:]) if k < len(block) else out[:-k]
    return out


def found_in(s: Slice, t: Templates, contained: float) -> list[tuple[int, int, float, int]]:
    """(text, template, containment, first word of the window) of the best window of each text and template."""
    _, _, words, bounds = s.words(lower=True, apart=_APART)
    grams, at = shingles(words, bounds, SHINGLE)
    if not len(grams):
        return []
    best: dict[tuple[int, int], tuple[float, int]] = {}
    hashed = [mix(grams ^ salt) for salt in _salts(max(t.bands.values()))]
    for width, (minima, whose) in t.minima.items():
        step = width // 4
        candidates = set()
        for band in range(t.bands[width]):
            low = _window_minima(hashed[band], step)
            for col in range(minima.shape[1]):
                candidates.update((int(w), int(whose[band, col])) for w in np.flatnonzero(low == minima[band, col]))
        for w, template in candidates:
            lo, hi = w * step, min(len(grams), (w + 5) * step)
            # A window may reach over the ends of texts: each text in it is judged alone.
            for text in range(int(np.searchsorted(at, lo, side="right")) - 1, int(np.searchsorted(at, hi, side="left"))):
                a, b = max(lo, int(at[text])), min(hi, int(at[text + 1]))
                if a < b:
                    share = float(np.isin(t.sets[template], grams[a:b]).mean())
                    if share >= contained and (share, -(a - int(at[text]))) > best.get((text, template), (0.0, 0)):
                        best[(text, template)] = (share, -(a - int(at[text])))
    return [(text, template, share, -place) for (text, template), (share, place) in sorted(best.items())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, containment, first_word: a row for every document and template found in it.

    Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. ``containment`` is the
    largest share of the template's distinct shingles in one window, ``first_word`` the place of
    that window (the first of equal ones). Null, empty and clean texts give no row; repeated rows
    give theirs each; long texts are scanned whole; an empty table gives no rows, and other columns are not looked at.
    """
    texts = templates or TEMPLATES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(texts, contained)
        for batch in batches:
            for s in slices(batch.column("text")):
                rows = found_in(s, t, contained)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array([s.lo + r[0] for r in rows], pa.int64())),
                        pa.array([t.names[r[1]] for r in rows], pa.string()),
                        pa.array([r[2] for r in rows], pa.float64()),
                        pa.array([r[3] for r in rows], pa.int64()),
                    ],
                    names=["doc_id", "license", "containment", "first_word"],
                )

    return docs.select("doc_id", F.col("text")).mapInArrow(work, docs.select("doc_id").schema.add("license", "string").add("containment", "double").add("first_word", "long"))
