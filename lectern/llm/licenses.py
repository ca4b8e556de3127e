"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_PATTERN, clear_of
from .neardup import shingles

CONTAINMENT = 0.8
#: Bands of one row each. A window has less than four times a template's shingles (see level_of), so with a template of which CONTAINMENT is there
#: its similarity is at least 0.8 / (4 + 0.2) = 0.19, and 1 - 0.81^48 = 0.99996 of such windows share a band; for templates of one shingle it is 1/2.
BANDS = 48

_RNG = np.random.default_rng(20240302)
_A = (_RNG.integers(1, 1 << 31, BANDS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(1, 1 << 32, BANDS, dtype=np.uint32)
_WORDS = re.compile(WORD_PATTERN)

#: The notices that are looked for.
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License",
    "apache-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit-notice": "Released under the MIT License",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "gpl-notice": "licensed under the GNU General Public License",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-notice": "Licensed under CC BY-NC",
    "cc-by-sa-notice": "Licensed under CC BY-SA",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "mpl-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
    "mit-license": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc-license": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-license": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "zlib-license": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."
    ),
    "lgpl-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version."
    ),
    "agpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}

MADE = {
    "licenses": T.ArrayType(T.StringType()),
    "matches": T.ArrayType(T.StructType([T.StructField("template", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])),
}


def permuted(h: np.ndarray) -> np.ndarray:
    """(bands, shingles) of 32-bit hashes."""
    x = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    y = x[None, :] * _A[:, None] + _B[:, None]
    y ^= y >> np.uint32(15)
    y *= np.uint32(0x2C1B3C6D)
    return y ^ (y >> np.uint32(13))


def level_of(n: int) -> int:
    """The level whose blocks of 2^level hold at least n shingles: windows of two blocks hold any n in a row, and have less than 4n."""
    return (n - 1).bit_length()


class Templates:
    """Templates with their band values by level, and a bitmap of those for a first look."""

    def __init__(self, texts: dict[str, str]):
        self.sets = {k: np.unique(s) for k, t in texts.items() if len(s := shingles(t))}
        self.lengths = {k: len(shingles(texts[k])) for k in self.sets}
        self.levels: dict[int, tuple[np.ndarray, dict[tuple[int, int], list[str]]]] = {}
        for k, s in self.sets.items():
            level = level_of(self.lengths[k])
            seen, table = self.levels.setdefault(level, (np.zeros(1 << 20, bool), {}))
            for band, v in enumerate(permuted(s).min(1).tolist()):
                seen[v >> 12] = True
                table.setdefault((band, v), []).append(k)

    def find(self, h: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(template, containment, first shingle, end) of the templates in a text's shingles; a run of matches is one finding."""
        if not len(h) or not self.levels:
            return []
        out: list[tuple[str, float, int, int]] = []
        mins, span = permuted(h), 1
        for level in range(max(self.levels) + 1):
            if level:
                n = mins.shape[1] // 2 * 2
                mins = np.concatenate([np.minimum(mins[:, 0:n:2], mins[:, 1:n:2]), mins[:, n:]], axis=1)
                span *= 2
            if level not in self.levels:
                continue
            seen, table = self.levels[level]
            windows = np.minimum(mins[:, :-1], mins[:, 1:]) if mins.shape[1] > 1 else mins
            wanted: dict[str, list[int]] = {}
            for band, w in zip(*(x.tolist() for x in np.nonzero(seen[windows >> np.uint32(12)])), strict=True):
                for k in table.get((band, int(windows[band, w])), ()):
                    wanted.setdefault(k, []).append(w)
            for k, at in wanted.items():
                end = -1
                for w in sorted(set(at)):
                    a, b = w * span, min(len(h), (w + 2) * span)
                    inside = np.flatnonzero(np.isin(h[a:b], self.sets[k]))
                    part = len(np.unique(h[a:b][inside])) / len(self.sets[k])
                    if part >= CONTAINMENT and a + inside[0] >= end:
                        end = int(a + inside[-1] + 1)
                        out.append((k, part, int(a + inside[0]), end))
        return sorted(out, key=lambda m: (m[2], m[0]))


def scan(docs: DataFrame, *, text: str = "text", templates: dict[str, str] | None = None, shingle: int = 5, keep: list[str] | None = None, part: int = 1 << 16) -> DataFrame:
    """docs with licenses (sorted names of the templates found) and matches (template, containment, start and end in code points of the original).

    A template is found where two neighbouring blocks of the text hold at least CONTAINMENT of its distinct shingles. Whole texts are scanned, without a shuffle; long
    ones in overlapping parts. Null and wordless texts have no matches; a text of fewer than five words is one shingle; columns named like a result
    are replaced. The templates are a parameter and travel with the code.
    """
    known = templates if templates is not None else TEMPLATES
    kept = [c for c in (keep or docs.columns) if c.lower() not in MADE]
    sent = docs.sparkSession.sparkContext.broadcast(Templates(known))
    overlap = 4 << max([level_of(n) for n in sent.value.lengths.values()], default=0)

    def found(h: np.ndarray) -> list[tuple[str, float, int, int]]:
        out: dict[tuple[str, int], tuple[str, float, int, int]] = {}
        for a in range(0, max(1, len(h)), part):
            for k, c, x, y in sent.value.find(h[a : a + part + overlap]):
                if x < part:  # what begins later belongs to the next part
                    out.setdefault((k, a + x), (k, c, a + x, a + y))
        return sorted(out.values(), key=lambda m: (m[2], m[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, matches = [], []
            for t in b[text]:
                t = t.as_py()
                got = found(shingles(t, shingle))
                names.append(sorted({m[0] for m in got}))
                rows = []
                if got:
                    at = [m.span() for m in _WORDS.finditer(t)]
                    rows = [{"template": k, "containment": c, "start": at[x][0], "end": at[min(len(at), y - 1 + shingle) - 1][1]} for k, c, x, y in got]
                matches.append(rows)
            kinds = pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(names, pa.list_(pa.string())), pa.array(matches, kinds)], [*kept, *MADE])

    need = list(dict.fromkeys([*kept, text]))
    fields = {f.name: f for f in docs.schema.fields}
    rows = clear_of(docs, [m for m in MADE if m != text]).select(*[F.col(f"`{c}`") for c in need])
    return rows.mapInArrow(run, T.StructType([*(fields[c] for c in kept), *(T.StructField(k, v) for k, v in MADE.items())]))
