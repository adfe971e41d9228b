"""License scans by conditional compression.

A candidate block is compressed plainly and with each template as a zstandard raw
dictionary; the template that saves most bytes is the likeliest. All are confirmed by
comparing words: the template's wording must stand in the block with few words
missing, put in or changed, and those differences are reported. Notices may be wrapped:
around each cue word every wording is also laid on the text's words across lines,
without comment marks.

Every wording holds a cue word; one whose cue words are all missing isn't looked for.
A narrow map over documents; nothing is shuffled.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import annotate, bound_batches, fresh

#: Public licence names and usual wordings of their notices.
TEMPLATES = {
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.'),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.'),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.'),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",
        'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.'),
    "Zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.'),
}
CUES = ("licen", "permission", "redistribution")
#: Words that may differ, as a share of a wording's words; names and versions may not.
TOLERANCE = 0.15
#: A block is a line, or a part of a long line that overlaps the next by half.
BLOCK_CHARS = 4000

#: Comment marks that read as words.
_REMARK = re.compile(r"^[ \t]*(?:rem|dnl)\b", re.M)
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Words that name a licence: they must agree exactly.
_KEY = re.compile(r"\d|^(?:mit|apache|bsd|gnu|mozilla|affero|lesser|creative|commons|cc|by|by-.*|attribution.*|noncommercial|sharealike)$")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def line_blocks(text: str) -> list[tuple[int, str]]:
    """(start, block) of blocks with a cue; long lines are cut into overlapping parts."""
    out, at = [], 0
    for line in text.split("\n"):
        low = line.lower()
        if any(c in low for c in CUES):
            if len(line) <= BLOCK_CHARS:
                out.append((at, line))
            else:
                step = BLOCK_CHARS // 2
                for a in range(0, max(1, len(line) - step), step):
                    part = line[a : a + BLOCK_CHARS]
                    if any(c in part.lower() for c in CUES):
                        out.append((at + a, part))
        at += len(line) + 1
    return out


class Scanner:
    def __init__(self, templates=TEMPLATES, level: int = 3):
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        self.wordings = {}
        self.with_dict = {}
        for name, texts in sorted(templates.items()):
            for t in texts:
                if not any(c in t.lower() for c in CUES):
                    raise ValueError(f"no cue in a wording of {name}")
            self.wordings[name] = sorted((words(t) for t in texts), key=len, reverse=True)
            raw = zstandard.ZstdCompressionDict("\n".join(texts).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.with_dict[name] = zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)

    def savings(self, block: str) -> list[tuple[int, str]]:
        """(bytes saved, template), best first."""
        raw = block.encode("utf-8", "surrogatepass")
        plain = len(self.plain.compress(raw))
        return sorted(((plain - len(c.compress(raw)), name) for name, c in self.with_dict.items()), key=lambda x: (-x[0], x[1]))

    def differences(self, name: str, block_words: list[str], wordings: list[list[str]] | None = None) -> list[str] | None:
        """Word differences of the best wording of a template (or of `wordings`) in a block; None if it isn't there.

        An insertion within the wording reads `+word`, a missing word `-word`.
        """
        best, have = None, set(block_words)
        for wording in wordings or self.wordings[name]:
            n = len(wording)
            if len(set(wording) - have) > (max(1, int(TOLERANCE * n)) if n >= 7 else 0):
                continue  # too many of its words are nowhere in the block
            if any(block_words[i : i + n] == wording for i in range(len(block_words) - n + 1)):
                return []
            most = max(1, int(TOLERANCE * n)) if n >= 7 else 0
            if not most:
                continue
            match = difflib.SequenceMatcher(None, wording, block_words, autojunk=False)
            spans = [m for m in match.get_matching_blocks() if m.size]
            if sum(m.size for m in spans) < n - most:
                continue
            first, last = spans[0], spans[-1]
            diff = [f"-{w}" for w in wording[: first.a]]
            for x, y in zip(spans, spans[1:]):
                diff += [f"-{w}" for w in wording[x.a + x.size : y.a]] + [f"+{w}" for w in block_words[x.b + x.size : y.b]]
            diff += [f"-{w}" for w in wording[last.a + last.size :]]
            if len(diff) <= most and not any(_KEY.search(d[1:]) for d in diff) and (best is None or len(diff) < len(best)):
                best = diff
        return best

    def wrapped(self, text: str) -> list[tuple[int, str, str, list[str]]]:
        """(start of the first line, template, its text, differences) of wordings laid on each cue word across lines."""
        low = _REMARK.sub(lambda m: " " * len(m[0]), text.lower())
        at = [(m.start(), m.end()) for m in _WORD.finditer(low)]
        ws = [low[a:z] for a, z in at]
        lines = [0, *(m.end() for m in re.finditer("\n", low))]
        # lower case may be longer than the text: lines are told by their number
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        line = [bisect_right(lines, a) - 1 for a, _ in at]
        laid: dict[str, list[tuple[int, int, list[str]]]] = {}
        for c in (i for i, w in enumerate(ws) if any(x in w for x in CUES)):
            for name, wordings in self.wordings.items():
                for wording in wordings:
                    n = len(wording)
                    most = max(1, int(TOLERANCE * n)) if n >= 7 else 0
                    for q in (i for i, w in enumerate(wording) if any(x in w for x in CUES)):
                        first, end = max(0, c - q - most), min(len(ws), c - q + n + most)
                        if end <= first or line[first] == line[end - 1]:
                            continue  # on one line, where it has been looked for
                        part = ws[first:end]
                        diff = self.differences(name, part, [wording])
                        if diff is None:
                            continue
                        spans = [m for m in difflib.SequenceMatcher(None, wording, part, autojunk=False).get_matching_blocks() if m.size]
                        a, z = first + spans[0].b, first + spans[-1].b + spans[-1].size
                        laid.setdefault(name, []).append((a, z, diff))
        best: dict[tuple[int, str], tuple] = {}
        for name, finds in laid.items():
            end = 0
            for a, z, diff in sorted(finds, key=lambda f: (f[0], -f[1], len(f[2]))):
                if z <= end:  # a part of a longer wording of the same licence
                    continue
                end, key = z, (starts[line[a]], name)
                if key not in best or len(diff) < len(best[key][3]):
                    best[key] = (*key, low[at[a][0] : at[z - 1][1]], diff)
        return list(best.values())

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """The number of candidate blocks, and the confirmed finds."""
        found, blocks = {}, line_blocks(text)
        for start, block in blocks:
            w = words(block)
            for saved, name in self.savings(block):
                diff = self.differences(name, w)
                if diff is not None:
                    found.setdefault((start, name), {"license": name, "start": start, "saved": saved, "differences": diff})
        for start, name, window, diff in self.wrapped(text):
            end = text.find("\n", start)  # a long line's finds stand at its parts
            if not any(n == name and start <= s and (s < end or end < 0) for s, n in found):
                saved = {n: k for k, n in self.savings(window)}
                found[start, name] = {"license": name, "start": start, "saved": saved[name], "differences": diff}
        return len(blocks), [found[k] for k in sorted(found)]


_FIND = T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("saved", T.LongType()), T.StructField("differences", T.ArrayType(T.StringType()))])
RESULT = T.StructType([T.StructField("n_blocks", T.LongType()), T.StructField("found", T.ArrayType(_FIND))])
_ARROW = pa.struct([("n_blocks", pa.int64()), ("found", pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("saved", pa.int64()), ("differences", pa.list_(pa.string()))])))])


def find_licenses(docs: DataFrame, *, text_col: str = "text", name: str = "licenses", templates=TEMPLATES) -> DataFrame:
    """`docs` with a struct column `name`: n_blocks (candidates) and found (license, start of its block, saved, differences).

    Null and empty texts have no blocks; long ones are read whole. Every template is tried on every
    candidate, so templates that save alike are reported alike, in order of place and name. Other
    columns and repeated rows pass through, a column of that name gets company with underscores in
    front, and an empty table gives none.
    """
    bound_batches(docs.sparkSession)

    def make():
        scanner = Scanner(templates)

        def one(column):
            rows = []
            for text in column.to_pylist():
                low = text.lower() if text else ""
                n, found = scanner.scan(text) if any(c in low for c in CUES) else (0, [])
                rows.append({"n_blocks": n, "found": found})
            return pa.array(rows, _ARROW)

        return one

    return annotate(docs, text_col, make, RESULT, fresh(docs, name))
