"""License notices by local alignment and conditional compression.

Around each place of license wording, inside and across lines, a window of words as wide as each template needs
is aligned with it (Smith-Waterman; as many words as the template has may stand in between). The span found
around the wording is compressed twice with Zstandard: alone, and with the template's text as raw dictionary. It
counts if the dictionary saves enough of it and enough of the template's words stand unchanged; the wording
differences are listed. Of overlapping notices the one that aligns best stays (then the larger saving, then the
first by name), so a text, a block and a line may hold any number of notices. Texts without any license wording
have no candidates.

Null and empty texts have no notices.
"""

from __future__ import annotations

import bisect
import difflib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scanloom.llm import texts
from scanloom.llm.decontaminate import align

#: Fixed notice texts by name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."),
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."),
}
#: Wording that makes its surroundings a candidate.
CUES = re.compile(r"licen[sc]e|licensed|copyright|spdx|redistribut|permission\s+is\s+hereby|creative\s+commons|\bgpl\b|public\s+domain", re.IGNORECASE)
_FIRST = ("icen", "opyright", "OPYRIGHT", "ICEN", "spdx", "SPDX", "edistribut", "EDISTRIBUT", "ermission", "ERMISSION", "ommons", "OMMONS", "gpl", "GPL", "omain", "OMAIN")
LEVEL = 3
#: Words to each side of the wording that are looked at, in lengths of the template.
REACH = 2
LEAST_SAVED, LEAST_ALIKE = 0.25, 0.8
#: A line break with the comment signs around it.
_BREAK = re.compile(r"\s*\n[\s*#/;%!|-]*|\s+")
_WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Templates:
    """Compressors of a task: one plain, one for each template."""

    def __init__(self, templates: dict[str, str]):
        import zstandard

        self.words = {k: _words(v) for k, v in sorted(templates.items())}
        number = {w: i for i, w in enumerate(sorted({w for own in self.words.values() for w in own}))}
        self.number = number
        self.codes = {k: np.array([number[w] for w in v], np.int64) for k, v in self.words.items()}
        bare = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(compression_params=bare)
        self.own = {}
        for name, text in sorted(templates.items()):
            raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.own[name] = zstandard.ZstdCompressor(dict_data=raw, compression_params=bare)

    def saving(self, block: str, name: str) -> float:
        """Share of the compressed size that a template saves."""
        data = _BREAK.sub(" ", block).encode("utf-8", "surrogatepass")
        return 1 - len(self.own[name].compress(data)) / len(self.plain.compress(data))

    def confirmed(self, words: list[str], block: str, name: str) -> dict | None:
        """The notice that a span of a text is, if the saving and the wording confirm it."""
        theirs = self.words[name]
        matcher = difflib.SequenceMatcher(None, theirs, words, autojunk=False)
        same = sum(s.size for s in matcher.get_matching_blocks())
        if same / len(theirs) < LEAST_ALIKE or (saved := self.saving(block, name)) < LEAST_SAVED:
            return None
        return {"license": name, "saved": saved, "alike": same / len(theirs),
                "differences": [f"{' '.join(theirs[a:b])} -> {' '.join(words[c:d])}" for kind, a, b, c, d in matcher.get_opcodes() if kind != "equal"]}

    def spans(self, text: str) -> list[tuple[int, int, dict]]:
        """First character, one past the last, and facts of each notice."""
        cues = [m.start() for m in CUES.finditer(text)] if any(f in text for f in _FIRST) else []
        if not cues:
            return []
        places = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in places]
        codes = np.array([self.number.get(w, -1) for w in words], np.int64)
        at = np.unique(np.searchsorted([b for _, b in places], cues, side="right"))
        found = []
        for name, theirs in self.codes.items():
            size, done = len(theirs), 0
            for c in at[at < len(words)] if size else ():
                lo, hi = max(done, c - REACH * size), min(len(words), c + REACH * size + 1)
                while lo <= c < hi and np.isin(theirs, codes[lo:hi]).sum() >= LEAST_ALIKE * size:
                    score, a, b = align(codes[lo:hi], theirs)
                    a, b = int(lo + a), int(lo + b)
                    if a <= c < b:
                        if hit := self.confirmed(words[a:b], text[places[a][0]:places[b - 1][1]], name):
                            found.append((-score, -hit["saved"], name, a, b, hit))
                            done = b
                        break
                    lo, hi = (b, hi) if b <= c else (lo, a)  # a notice beside the wording has wording of its own
        taken, out = np.zeros(len(words), bool), []
        for *_, a, b, hit in sorted(found, key=lambda x: x[:5]):
            if not taken[a:b].any():
                taken[a:b] = True
                out.append((places[a][0], places[b - 1][1], hit))
        return sorted(out, key=lambda x: x[:2])

    def judge(self, block: str) -> dict | None:
        """The best notice of a text."""
        return max((hit for *_, hit in self.spans(block)), key=lambda h: h["saved"], default=None)


def notices(text: str, templates: Templates) -> list[dict]:
    """Confirmed notices with the lines they stand on."""
    if not (found := templates.spans(text)):
        return []
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    return [{"first_line": bisect.bisect_left(breaks, a), "last_line": bisect.bisect_left(breaks, b) + 1, **hit} for a, b, hit in found]


ITEM = "struct<first_line:long,last_line:long,license:string,saved:double,alike:double,differences:array<string>>"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, notices (array of first_line, last_line (exclusive), license, saved, alike, differences) of every row."""
    given = dict(templates or TEMPLATES)
    item = pa.struct([("first_line", pa.int64()), ("last_line", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("alike", pa.float64()), ("differences", pa.list_(pa.string()))])

    def run(batches):
        own = Templates(given)
        for part in texts.slices(batches):
            rows = [notices(t, own) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(item))], ["doc_id", "notices"])

    return texts.id_text(docs).mapInArrow(run, f"doc_id long, notices array<{ITEM}>")
