"""License scans: winnowed fingerprints pick candidates, banded alignment reports them.

Templates and texts are sequences of words (runs of letters, digits and
non-ASCII bytes; A-Z as a-z). Of every two neighbouring hashes of four words
the smaller one is a fingerprint (winnowing), so any five words that a text
shares with a template share a fingerprint. An inverted index over the
templates' fingerprints gives candidate places; there the template is aligned
with the text by a banded Smith-Waterman recurrence (match 2, mismatch -1, gap
-1), and alignments that match enough of the template are reported with their
coverage and spans. Templates that differ in few words (versions, variants) align
with the same place: one is not reported where another matches no fewer words
with fewer differences over half of its span or more.

Templates are a parameter, small by nature (``MAX_TEMPLATE_WORDS`` is checked),
and held by every task; documents are read once and never shuffled.

Defined cases: null and empty texts have no hits; a text that holds a
template several times has a row for each place; repeated rows are reported
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficgraph.llm import textscan as ts

GRAM = 4
WINDOW = 2
MIN_COVERAGE = 0.8
MIN_BAND = 4
MAX_TEMPLATE_WORDS = 1_000_000
SLICE_BYTES = 2 << 20

# The notices that the licenses ask for in full, their openings
# ("-opening") and short forms in use ("-line").
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.")
_APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
           "file except in compliance with the License. You may obtain a copy of the License at")
_MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.")
_BSD_BINARY = (" Redistributions in binary form must reproduce the above copyright notice, this list of "
               "conditions and the following disclaimer in the documentation and/or other materials "
               "provided with the distribution.")
_BSD_NAMES = (" Neither the name of the copyright holder nor the names of its contributors may be used "
              "to endorse or promote products derived from this software without specific prior "
              "written permission.")
_BSD_WARRANTY = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
                 "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
                 "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
                 "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
                 "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT "
                 "OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
                 "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
                 "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
                 "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_UNLICENSE = "This is free and unencumbered software released into the public domain."


def _gnu_opening(work: str, name: str, version: str) -> str:
    mark = ":" if version.startswith("3") else ";"
    return (f"This {work} is free software{mark} you can redistribute it and/or modify it under the terms "
            f"of the GNU {name} as published by the Free Software Foundation, either version {version} "
            "of the License, or (at your option) any later version.")


def _gnu(work: str, name: str, version: str) -> str:
    where = ("If not, see <https://www.gnu.org/licenses/>." if version.startswith("3") else
             "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, "
             "Boston, MA 02110-1301 USA")
    return (f"{_gnu_opening(work, name, version)} This {work} is distributed in the hope that it will be "
            "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
            f"FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have "
            f"received a copy of the GNU {name} along with this {work}. {where}")


TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "BSD-line": "Use of this source code is governed by a BSD-style license.",
    "MIT-style-line": "Use of this source code is governed by an MIT-style license.",
    "MPL-2.0-line": "Licensed under the Mozilla Public License, version 2.0.",
    "CC0-line": "Licensed under CC0 1.0.",
    "MIT": _MIT + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
           "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
           "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
           "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
           "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
           "DEALINGS IN THE SOFTWARE.",
    "MIT-opening": _MIT,
    "ISC": _ISC + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
           "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
           "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
           "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
           "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
           "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC-opening": _ISC,
    "Apache-2.0": _APACHE + " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
                  "or agreed to in writing, software distributed under the License is distributed on an "
                  "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                  "implied. See the License for the specific language governing permissions and "
                  "limitations under the License.",
    "Apache-2.0-opening": _APACHE,
    "MPL-2.0": _MPL + " https://mozilla.org/MPL/2.0/.",
    "MPL-2.0-opening": _MPL,
    "BSD-2-Clause": _BSD + _BSD_BINARY + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD + _BSD_BINARY + _BSD_NAMES + _BSD_WARRANTY,
    "BSD-opening": _BSD,
    "Unlicense": _UNLICENSE + " Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
                 "this software, either in source code form or as a compiled binary, for any purpose, "
                 "commercial or non-commercial, and by any means. In jurisdictions that recognize "
                 "copyright laws, the author or authors of this software dedicate any and all copyright "
                 "interest in the software to the public domain. We make this dedication for the benefit "
                 "of the public at large and to the detriment of our heirs and successors. We intend this "
                 "dedication to be an overt act of relinquishment in perpetuity of all present and future "
                 "rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
                 "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
                 "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
                 "THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
                 "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
                 "THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense-opening": _UNLICENSE,
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related "
               "and neighboring rights to this software to the public domain worldwide. This software is "
               "distributed without any warranty. You should have received a copy of the CC0 Public Domain "
               "Dedication along with this software. If not, see "
               "<https://creativecommons.org/publicdomain/zero/1.0/>.",
}
for _key, _work, _name, _version in [
        ("GPL-2.0", "program", "General Public License", "2"), ("GPL-3.0", "program", "General Public License", "3"),
        ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
        ("LGPL-3.0", "library", "Lesser General Public License", "3"),
        ("AGPL-3.0", "program", "Affero General Public License", "3")]:
    TEMPLATES["GPL-line" if _key == "GPL-3.0" else f"{_key}-line"] = (
        f"Licensed under the GNU {_name}, version {_version}.")
    TEMPLATES[_key] = _gnu(_work, _name, _version)
    TEMPLATES[f"{_key}-opening"] = _gnu_opening(_work, _name, _version)
for _form, _name in [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"),
                     ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
                     ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                     ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]:
    for _version, _port in [("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"),
                            ("2.0", "Generic"), ("1.0", "Generic")]:
        _key = f"CC-{_form}" if _version == "4.0" else f"CC-{_form}-{_version}"
        TEMPLATES[f"{_key}-line"] = (
            f"This work is licensed under a Creative Commons {_name} {_version} {_port} License.")
        TEMPLATES[f"{_key}-short"] = f"Licensed under CC {_form} {_version}."

SCHEMA = ("doc_id long, license string, coverage double, matched_words long, template_words long, "
          "word_start long, word_end long, char_start long, char_end long")


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the fingerprints: the smallest hash of each window, the
    rightmost of equals (all hashes if there are fewer than a window)."""
    if len(grams) <= window:
        w = len(grams)
        return np.zeros(0, np.int64) if not w else np.array(
            [w - 1 - int(np.argmin(grams[::-1]))])
    v = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(v)) + window - 1 - np.argmin(v[:, ::-1], axis=1))


class Index:
    """Fingerprint -> (template, position) for all templates."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = list(templates)
        self.words = ts.hash_words(list(templates.values()), ts.PUNCT)
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words are not shipped")
        key, tpl, pos = [], [], []
        for i, w in enumerate(self.words):
            g = ts.rolling(w, GRAM)
            at = winnow(g)
            key.append(g[at])
            tpl.append(np.full(len(at), i))
            pos.append(at)
        key = np.concatenate(key) if key else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.tpl = np.concatenate(tpl)[order] if tpl else key
        self.pos = np.concatenate(pos)[order] if pos else key
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.key >> np.uint64(48)).astype(np.int64)] = True


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int):
    """Banded local alignment: template word i meets text words i + shift +- band.

    Returns ``(matched, template start, end, text start, end)`` of the best
    alignment, or None.
    """
    m, width = len(template), 2 * band + 1
    cols = np.arange(width)
    prev = np.zeros(width + 1, np.int64)         # row i - 1, one column more at its right
    came = np.zeros((m, width), np.int8)         # 0 start, 1 diagonal, 2 template gap, 3 text gap
    score, best = 0, None
    padded = np.zeros(m + width, np.uint64)      # text words i + shift - band ...
    lo, hi = max(0, shift - band), min(len(text), shift - band + m + width)
    inside = np.zeros(m + width, bool)
    if hi > lo:
        padded[lo - shift + band:hi - shift + band] = text[lo:hi]
        inside[lo - shift + band:hi - shift + band] = True
    for i in range(m):
        same = (padded[i:i + width] == template[i]) & inside[i:i + width]
        diag = prev[:width] + np.where(same, 2, -1)
        up = prev[1:] - 1
        row = np.maximum(np.maximum(diag, up), 0)
        run = np.maximum.accumulate(row + cols) - cols          # text gaps cost 1 a word
        came[i] = np.where(run == 0, 0, np.where(run == diag, 1, np.where(run == up, 2, 3)))
        prev = np.append(run, 0)
        top = int(run.argmax())
        if run[top] > score:
            score, best = int(run[top]), (i, top)
    if best is None:
        return None
    i, j = best
    i_end, t_end, matched = i + 1, i + j + shift - band + 1, 0
    while i >= 0 and 0 <= j < width and came[i, j]:
        step = came[i, j]
        i0, t0 = i, i + j + shift - band
        if step == 1:
            matched += int(inside[i + j] and padded[i + j] == template[i])
            i -= 1
        elif step == 2:
            i, j = i - 1, j + 1
        else:
            j -= 1
    return matched, i0, i_end, t0, t_end


def _places(tpl: np.ndarray, pos: np.ndarray, at: np.ndarray, index: Index):
    """Candidate places of one text: ``(template, shift)``, one for each run of
    hits whose shifts lie within a band."""
    order = np.lexsort((at, at - pos, tpl))
    t, s = tpl[order], (at - pos)[order]
    i = 0
    while i < len(t):
        band, j = _band(len(index.words[t[i]])), i + 1
        while j < len(t) and t[j] == t[i] and s[j] - s[i] <= band:
            j += 1
        yield int(t[i]), int(s[(i + j) // 2]), band
        i = j


def _band(words: int) -> int:
    return max(MIN_BAND, words // 8)


def scan_text(words: np.ndarray, hits, index: Index, min_coverage: float):
    """Reported alignments of one text: ``(template, matched, start, end)`` by
    words, places of one template that overlap cut to the best, and those that
    another template fits better left out."""
    found = []
    for t, shift, band in _places(*hits, index):
        template = index.words[t]
        near = words[max(0, shift - band):max(0, shift + band + len(template))]
        if np.count_nonzero(np.isin(template, near)) < min_coverage * len(template):
            continue
        got = align(template, words, shift, band)
        if got and got[0] >= min_coverage * len(template):
            found.append((t, got[0], got[3], got[4]))
    found.sort(key=lambda x: (x[0], -x[1], x[2]))
    out: list[tuple] = []
    for f in found:
        if not any(g[0] == f[0] and f[2] < g[3] and g[2] < f[3] for g in out):
            out.append(f)
    out = [f for f in out if not any(_fits_better(g, f, index) for g in out)]
    return sorted(out, key=lambda x: (x[2], x[0]))


def _fits_better(g: tuple, f: tuple, index: Index) -> bool:
    """Whether ``g`` covers half of the span of ``f`` or more, with no fewer matched
    words and fewer words that differ (of the template and of the span)."""
    def differ(x):
        return len(index.words[x[0]]) + x[3] - x[2] - 2 * x[1]
    return (2 * (min(g[3], f[3]) - max(g[2], f[2])) >= f[3] - f[2]
            and g[1] >= f[1] and differ(g) < differ(f))


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES,
                  min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Places of ``templates`` in ``docs`` (doc_id, text): one row for each with the
    share of the template's words that match, and its span in words and in
    characters of the text (end exclusive)."""
    index = Index(templates)

    def run(batches):
        for b in batches:
            data, offs = ts.utf8(b.column(1))
            rows = []
            for lo, hi in ts.slices(offs, SLICE_BYTES):
                d, o = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
                first, start, end, h = ts.words(d, o, ts.PUNCT)
                grams = ts.rolling(h, GRAM)
                ok = ts.whole_runs(first, len(h), GRAM)
                # Fingerprints of a text are looked up only near hashes that
                # the index has; winnowing decides which of them count.
                maybe = np.flatnonzero(index.bits[(grams >> np.uint64(48)).astype(np.int64)] & ok)
                k = np.minimum(np.searchsorted(index.key, grams[maybe]), max(len(index.key) - 1, 0))
                maybe = maybe[index.key[k] == grams[maybe]] if len(index.key) else maybe[:0]
                for r in np.unique(np.searchsorted(first, maybe, "right") - 1).tolist():
                    w0, w1 = int(first[r]), int(first[r + 1])
                    g = grams[w0:max(w0, w1 - GRAM + 1)]
                    at = winnow(g)
                    left = np.searchsorted(index.key, g[at], "left")
                    n = np.searchsorted(index.key, g[at], "right") - left
                    post = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
                    hits = index.tpl[post], index.pos[post], np.repeat(at, n)
                    for t, matched, a, z in scan_text(h[w0:w1], hits, index, min_coverage):
                        s, e = int(start[w0 + a]), int(end[w0 + z - 1])
                        chars = (d[o[r]:e] & 0xC0) != 0x80
                        rows.append((b.column(0)[lo + r].as_py(), index.names[t],
                                     matched / len(index.words[t]), matched, len(index.words[t]),
                                     a, z, int(np.count_nonzero(chars[:s - o[r]])),
                                     int(np.count_nonzero(chars))))
            if rows:
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(_ARROW.names, x)) for x in rows], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(ts.returning(run), SCHEMA)


_ARROW = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()),
                    ("matched_words", pa.int64()), ("template_words", pa.int64()),
                    ("word_start", pa.int64()), ("word_end", pa.int64()),
                    ("char_start", pa.int64()), ("char_end", pa.int64())])
