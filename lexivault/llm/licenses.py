"""License scans: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment reports spans.

Templates and documents are word sequences (runs of letters, digits and non-ASCII characters, lower-cased). Of every
``WINDOW`` neighbouring hashes of ``LONG_GRAM`` words the lowest is a fingerprint (one position in four or five), so any
common stretch of LONG_GRAM + WINDOW - 1 words shares one. Notices of fewer than ``LONG`` words are too short to be
thinned out: all their ``GRAM``-word hashes are fingerprints. The templates' fingerprints form an inverted index
(template, place); a document's fingerprints look templates up, and hits on near diagonals are aligned within a band of
``BAND`` words around them (fewer for short templates, a twentieth of the template for long ones). Coverage is the share of the
template's words that the alignment matches; a template may occur in a document at several places. Of templates found
at one place the one with the most matched words is reported, the better covered one among equals.

``TEMPLATES`` are whole texts (``license_texts``), headers and short lines. ``REQUIRED`` names the word sequences that
tell a notice from its like, such as its version: without them in the aligned stretch, a template is not reported.

The templates are a parameter of fixed size (``MAX_WORDS`` words at most, checked), held by every worker; documents are
read once, whole, without a shuffle.

Defined cases: null or blank texts hold no licence; templates with fewer than GRAM words are refused; documents with fewer words than a
fingerprint hold no licence; repeated rows are
reported each; ids may be null; an empty table gives an empty result.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import hashing, parts
from .align import align, clusters
from .decontaminate import word_hashes

GRAM, LONG_GRAM, WINDOW, BAND, DRIFT = 3, 5, 8, 8, 6
#: From LONG words on, a template needs a hit for every SPARSE of its words on near diagonals.
LONG, SPARSE = 64, 40
MAX_WORDS = 1 << 20
OUT = "doc_id long, license string, coverage double, start_word int, end_word int"

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
    rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so"""
_MIT_NOTICE = """, subject to the following conditions: The above copyright notice and this permission notice shall be included in
    all copies or substantial portions of the Software."""
_MIT_WARRANTY = """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
    TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
    AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
    OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted"""
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
    INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
    DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
    WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
    PERFORMANCE OF THIS SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution."""
_BSD_ENDORSE = """ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission."""
_BSD_ADVERT = """ 3. All advertising materials mentioning features or use of this software must display the following
    acknowledgement: This product includes software developed by the organization."""
_BSD_WARRANTY = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
    ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
    SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
    LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
    CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
    SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Public licence texts and notices, by name; and the words that a notice cannot do without.
TEMPLATES = {
    "mit": _MIT_GRANT + _MIT_NOTICE + _MIT_WARRANTY,
    "mit-grant": _MIT_GRANT + _MIT_NOTICE,
    "mit-0": _MIT_GRANT + "." + _MIT_WARRANTY,
    "isc": _ISC_GRANT + _ISC_NOTICE + _ISC_WARRANTY,
    "isc-grant": _ISC_GRANT + _ISC_NOTICE,
    "0bsd": _ISC_GRANT + "." + _ISC_WARRANTY,
    "bsd-2-clause": _BSD_GRANT + _BSD_WARRANTY,
    "bsd-3-clause": _BSD_GRANT + " 3." + _BSD_ENDORSE + _BSD_WARRANTY,
    "bsd-4-clause": _BSD_GRANT + _BSD_ADVERT + " 4." + _BSD_ENDORSE + _BSD_WARRANTY,
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the
        License.""",
    "bsl-1.0": """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person
        or organization obtaining a copy of the software and accompanying documentation covered by this license (the
        "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative
        works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
        following: The copyright notices in the Software and this entire statement, including the above license grant, this
        restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and
        all derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR
        A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE
        SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
        OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "epl-1.0-header": """This program and the accompanying materials are made available under the terms of the Eclipse Public License
        v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html""",
    "epl-2.0-header": """This program and the accompanying materials are made available under the terms of the Eclipse Public License
        2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "mit-statement": "Released under the MIT License.",
    "apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "unlicense-statement": "Released into the public domain under the Unlicense.",
    "cc0-1.0-statement": "Licensed under CC0 1.0 Universal.",
}
REQUIRED = {
    "bsd-3-clause": ["neither the name"],
    "bsd-4-clause": ["all advertising materials"],
    "apache-2.0-header": ["apache license", "version 2 0"],
    "epl-1.0-header": ["eclipse public license v1 0"],
    "epl-2.0-header": ["eclipse public license 2 0"],
    "mpl-2.0-header": ["mozilla public license", "2 0"],
    "gpl-3.0": ["use with the gnu affero general public license"],
    "agpl-3.0": ["remote network interaction"],
    "mit-statement": ["mit"],
    "apache-2.0-statement": ["apache", "2 0"],
    "unlicense-statement": ["unlicense"],
    "cc0-1.0-statement": ["cc0 1 0"],
}


def _notice(name: str, text: str, *required: str) -> None:
    TEMPLATES[name], REQUIRED[name] = text, list(required)


for _path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
    TEMPLATES[_path.stem] = _path.read_text(encoding="utf-8")

#: Fixed value: the section that the AGPL has in place of the GPL's thirteenth; the rest differs by name.
_AGPL_13 = """13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License,
    if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a
    computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your
    version by providing access to the Corresponding Source from a network server at no charge, through some standard or
    customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for
    any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph.
    Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work
    licensed under version 3 of the GNU General Public License into a single combined work, and to convey the resulting work.
    The terms of this License will continue to apply to the part which is the covered work, but the work with which it is
    combined will remain governed by version 3 of the GNU General Public License. """
_gpl = TEMPLATES["gpl-3.0"]
_head, _tail = _gpl[: _gpl.index("13. Use with")], _gpl[_gpl.index("14. Revised Versions") :]
_affero = lambda x: x.replace("GNU General Public License", "GNU Affero General Public License").replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE")
TEMPLATES["agpl-3.0"] = _affero(_head) + _AGPL_13 + _affero(_tail)

for _id, _full, _versions in (
    ("gpl", "GNU General Public License", ("1", "2", "3")),
    ("lgpl", "GNU Library General Public License", ("2",)),
    ("lgpl", "GNU Lesser General Public License", ("2.1", "3")),
    ("agpl", "GNU Affero General Public License", ("3",)),
):
    for _v in _versions:
        _name = f"{_id}-{_v if '.' in _v else _v + '.0'}"
        _thing = "library" if _v in ("2", "2.1") and _id == "lgpl" else "program"
        _grant = f"""This {_thing} is free software: you can redistribute it and/or modify it under the terms of the {_full} as
            published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later
            version."""
        _rest = f""" This {_thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
            implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {_full} for more details. You
            should have received a copy of the {_full} along with this {_thing}. If not, see https://www.gnu.org/licenses/."""
        _must = (_full, f"version {_v}")
        _notice(f"{_name}-header", _grant + _rest, *_must)
        _notice(f"{_name}-grant", _grant, *_must)
        _notice(f"{_name}-statement", f"This work is licensed under the {_full}, version {_v}.", *_must)
        _notice(f"{_name}-line", f"Licensed under the {_full}, version {_v}", *_must)
        _notice(f"{_name}-v-line", f"Licensed under the {_full} v{_v}", _full, f"v{_v}")

for _id, _said in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc", "Attribution-NonCommercial"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives")):
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _notice(f"cc-{_id}-{_v}-statement", f"Licensed under CC {_id.upper()} {_v}.", f"cc {_id} {_v}")
        _notice(f"cc-{_id}-{_v}-line", f"This work is licensed under a Creative Commons {_said} {_v} International License.", f"commons {_said} {_v}")

for _id, _said in (("bsd-2-clause", "BSD 2-Clause"), ("bsd-3-clause", "BSD 3-Clause"), ("isc", "ISC"), ("mpl-1.1", "Mozilla Public License 1.1"), ("mpl-2.0", "Mozilla Public License 2.0")):
    _notice(f"{_id}-statement", f"Licensed under the {_said.removesuffix(' License')} License.", _said)

#: Identifier lines of the SPDX list; a longer identifier wins over its beginning.
for _id in "MIT MIT-0 ISC 0BSD Zlib Unlicense CC0-1.0 Apache-2.0 MPL-1.1 MPL-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause Artistic-2.0 EPL-1.0 EPL-2.0 BSL-1.0".split():
    _notice(f"{_id.lower()}-spdx", f"SPDX-License-Identifier: {_id}", f"identifier {_id}")
for _id in "GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 GFDL-1.2 GFDL-1.3".split():
    for _tail in ("", "-only", "-or-later"):
        _notice(f"{_id.lower()}{_tail}-spdx", f"SPDX-License-Identifier: {_id}{_tail}", f"identifier {_id}{_tail}")
for _id in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
    for _v in ("3.0", "4.0"):
        _notice(f"cc-{_id.lower()}-{_v}-spdx", f"SPDX-License-Identifier: CC-{_id}-{_v}", f"identifier CC-{_id}-{_v}")


def winnow(h: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: the lowest (leftmost) hash of every WINDOW neighbours, or of all if there are fewer."""
    if len(h) <= WINDOW:
        return np.array([int(h.argmin())]) if len(h) else np.zeros(0, np.int64)
    v = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    return np.unique(v.argmin(1) + np.arange(len(v)))


class _Prints:
    """Inverted index from hashes of so many words to (template, place)."""

    def __init__(self, gram: int, posts: list[tuple[int, int, int]], thin: bool):
        self.gram, self.thin = gram, thin
        posts = sorted(posts)
        self.keys = np.array([p[0] for p in posts], np.uint64)
        self.template = np.array([p[1] for p in posts], np.int64)
        self.place = np.array([p[2] for p in posts], np.int64)
        self.known = np.zeros(1 << 16, bool)  # a sieve before the search
        self.known[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Templates and diagonals of all hits."""
        h = hashing.windows(words, self.gram)
        at = winnow(h) if self.thin else np.arange(len(h))
        at = at[self.known[(h[at] >> np.uint64(48)).astype(np.int64)]]
        lo, hi = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
        n = hi - lo
        post = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.template[post], np.repeat(at, n) - self.place[post]


class Index:
    """Templates, and the fingerprints of the long and of the short ones."""

    def __init__(self, templates: dict[str, str], required: dict[str, list[str]] | None = None):
        self.names = sorted(templates)
        self.required = [[word_hashes(x) for x in (required or {}).get(n, [])] for n in self.names]
        self.words = [word_hashes(templates[n]) for n in self.names]
        if sum(map(len, self.words)) > MAX_WORDS or any(len(w) < GRAM for w in self.words):
            raise ValueError(f"templates need {GRAM} words at least, and {MAX_WORDS} in all at most")
        short, long = [], []
        for t, w in enumerate(self.words):
            thin = len(w) >= LONG
            h = hashing.windows(w, LONG_GRAM if thin else GRAM)
            (long if thin else short).extend((int(h[i]), t, int(i)) for i in (winnow(h) if thin else range(len(h))))
        self.prints = [_Prints(GRAM, short, False), _Prints(LONG_GRAM, long, True)]

    def scan(self, words: np.ndarray, min_coverage: float) -> list[tuple[str, float, int, int]]:
        template, diagonal = (np.concatenate(x) for x in zip(*[p.look_up(words) for p in self.prints]))
        if not len(template):
            return []
        found = []
        for t in np.unique(template):
            own = diagonal[template == t]
            a = self.words[t]
            for begin, end, middle, reach in _stretches(own, len(a)):
                b = words[begin:end]
                _, matches, _, _, b0, b1 = align(a, b, middle - begin, reach)
                if matches >= min_coverage * len(a) and all(_holds(b[b0:b1], x) for x in self.required[t]):
                    found.append((begin + b0, begin + b1, matches, matches / len(a), self.names[t]))
        kept: list[tuple[int, int, int, float, str]] = []
        for x in sorted(set(found), key=lambda x: (-x[2], -x[3], x[0], x[4])):
            if all(2 * (min(x[1], y[1]) - max(x[0], y[0])) <= min(x[1] - x[0], y[1] - y[0]) for y in kept):
                kept.append(x)
        return [(name, c, a, b) for a, b, _, c, name in sorted(kept)]


def _holds(words: np.ndarray, run: np.ndarray) -> bool:
    """True if the words hold the run, side by side."""
    return len(words) >= len(run) and bool((np.lib.stride_tricks.sliding_window_view(words, len(run)) == run).all(1).any())


def _stretches(diagonal: np.ndarray, n: int):
    """Begin, end, diagonal and band of the stretches where a template of n words may stand."""
    if n < LONG:
        reach = min(BAND, n // 2)  # short notices may follow each other closely
        for group in clusters(diagonal, min(DRIFT, reach)):
            d = diagonal[group]
            yield max(0, int(d.min()) - reach), int(d.max()) + n + reach, int(np.median(d)), reach
        return
    reach, d = max(BAND, n // 20), np.sort(diagonal)
    while len(d):
        near = np.searchsorted(d, d + DRIFT, "right") - np.arange(len(d))  # hits from each diagonal on
        top = int(near.argmax())
        if near[top] * SPARSE < n:
            return
        middle = int(np.median(d[top : top + near[top]]))
        yield max(0, middle - reach), middle + n + reach, middle, reach
        d = d[np.abs(d - middle) > DRIFT]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, coverage, start_word, end_word) for every licence found in every document."""
    parts.small_batches(docs.sparkSession)
    index = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES, REQUIRED) if templates is None else Index(templates))

    def run(batches):
        for b in batches:
            rows = [(i, *x) for i, text in zip(b.column(0).to_pylist(), b.column(1)) for x in index.value.scan(word_hashes(text.as_py()), min_coverage)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()))], names=["doc_id", "license", "coverage", "start_word", "end_word"])

    rows = scratch.spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(parts.lean(run), OUT)
