"""License scans by patience alignment.

Text and templates are read as lower-cased letter-and-digit words. A region
of the text that holds enough of a template's words is aligned with it:
words that occur once on both sides are anchors, the longest increasing
subsequence of the anchors is kept, and the gaps between kept anchors are
aligned the same way down to common heads and tails. Coverage is the share of
the template's words that were aligned; a region counts from ``threshold`` on.
The alignment cannot cover more words than the region shares with the
template, so regions with fewer are left out without loss.

A license is named by few words, so coverage alone does not decide: a
template's *deciding* words (name, version, clause) must all be aligned, and
no name word of another license may stand inside the region. Texts without a
template's deciding words are not aligned with it at all. The templates are
the notices and short texts that files carry, not the long bodies of the
licenses.

Defined results: null or empty text has no finding; overlapping regions go to
the template with more aligned words, then of higher coverage, then of smaller
name; repeated rows are scanned each; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ship, slices, text_buffer, words
from quarry.llm.secret_scan import Taken

THRESHOLD = 0.8
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False

#: Public license notices and texts to look for.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-1.1": "Licensed under the Apache Software License, Version 1.1",
    "BSD": "Released under the BSD License",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC0-1.0": "Released under the CC0 1.0 Universal Public Domain Dedication",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


#: Third clause of the longer BSD text; fixed value.
TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"] + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Deciding words of the texts above; fixed values.
DECIDING = {
    "Apache-2.0": "apache 2",
    "Apache-1.1": "apache 1",
    "Apache-2.0-header": "apache 2",
    "BSD": "bsd",
    "BSD-2-Clause": "redistribution redistributions",
    "BSD-3-Clause": "redistribution redistributions neither endorse",
    "CC0-1.0": "cc0",
    "EPL-1.0": "eclipse v1",
    "EPL-2.0": "eclipse 2",
    "ISC": "fee",
    "MIT": "mit",
    "MIT-text": "sublicense",
    "MPL-1.1": "mozilla 1",
    "MPL-2.0": "mozilla 2",
    "Unlicense": "unencumbered",
}
#: Words that name a license or one of its kinds; fixed values.
NAMES = "apache mit bsd eclipse mozilla cc0 gnu lesser library affero nc sa nd noncommercial sharealike noderivatives noderivs".split()
#: Creative Commons conditions by their letters, GNU licenses by their short
#: names, with the versions of each; fixed values.
_CONDITIONS = {"": "", "-NC": "-NonCommercial", "-SA": "-ShareAlike", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}
_GNU = {"GPL": ("General", "2.0 3.0"), "LGPL": ("Lesser General", "2.1 3.0"), "AGPL": ("Affero General", "3.0")}


def _families() -> None:
    """Notices of the licenses that come in kinds and versions."""
    for letters, words_ in _CONDITIONS.items():
        for version, place in (("4.0", "International"), ("3.0", "Unported"), ("2.0", "Generic")):
            name = f"CC-BY{letters}-{version}"
            TEMPLATES[name] = f"Licensed under CC BY{letters} {version}"
            DECIDING[name] = f"cc by {letters} {version}"
            TEMPLATES[f"{name}-sentence"] = f"This work is licensed under a Creative Commons Attribution{words_} {version} {place} License"
            DECIDING[f"{name}-sentence"] = f"commons attribution {words_} {version}"
    for short, (kind, versions) in _GNU.items():
        for version in versions.split():
            number = version.removesuffix(".0")
            name = f"{short}-{version}"
            TEMPLATES[name] = f"This work is licensed under the GNU {kind} Public License, version {version}"
            DECIDING[name] = f"gnu {kind} {number}"  # "version 3" as well as "version 3.0"
            TEMPLATES[f"{name}-header"] = (
                f"you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, "
                f"either version {number} of the License, or (at your option) any later version. It is distributed in the hope that it will be useful, but "
                "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
                f"See the GNU {kind} Public License for more details."
            )
            DECIDING[f"{name}-header"] = f"gnu {kind} {number}"


_families()


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places ``(i, j)``, increasing in both, by patience."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1)}
        pairs = [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and in_b[a[i]] == 1]
        if not pairs:
            continue
        tops, back, at = [], [], []  # patience piles: last place of each, links to the pile before
        for n, (_, j) in enumerate(pairs):
            pile = bisect_left(tops, j)
            if pile == len(tops):
                tops.append(j)
                at.append(n)
            else:
                tops[pile], at[pile] = j, n
            back.append(at[pile - 1] if pile else -1)
        n, chain = at[-1], []
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        chain.reverse()
        out += chain
        ends = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(ends, ends[1:])]
    return sorted(out)


@dataclass
class Template:
    name: str
    words: np.ndarray
    deciding: np.ndarray  # distinct words that must be aligned
    barred: np.ndarray  # name words of other licenses


def find(text: np.ndarray, templates: list[Template], threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """``(license, first word, last word + 1, coverage)`` in a text's words."""
    found = []
    for template in templates:
        m = len(template.words)
        need = int(np.ceil(threshold * m - 1e-9))
        hits = np.flatnonzero(np.isin(text, template.words))
        if len(hits) < need:
            continue
        reach = m + m // 2 + 4
        enough = np.searchsorted(hits, hits + reach) - np.arange(len(hits)) >= need
        after, t = -1, template.words.tolist()
        for k in np.flatnonzero(enough):
            lo = int(hits[k])
            if lo < after:
                continue
            pairs = align(text[lo : lo + reach].tolist(), t)
            if len(pairs) < need:
                continue
            start, end = lo + pairs[0][0], lo + pairs[-1][0] + 1
            aligned = text[[lo + i for i, _ in pairs]]
            if np.isin(template.deciding, aligned).all() and not np.isin(text[start:end], template.barred).any():
                after = end
                found.append((template.name, start, end, len(pairs) / m, len(pairs)))
    kept, taken = [], Taken([])
    for f in sorted(found, key=lambda f: (-f[4], -f[3], f[0], f[1])):
        if taken.free(f[1], f[2]):
            taken.add(f[1], f[2])
            kept.append(f[:4])
    return sorted(kept, key=lambda f: f[1])


def template_words(text: str) -> np.ndarray:
    return words(*text_buffer(pa.array([text])), _BREAK)[0]


def licenses(df: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``key, findings: array<struct<license, first_word, end_word,
    coverage>>`` of every row; a narrow map over whole texts."""
    ship(df)
    names = template_words(" ".join(NAMES))
    known = []
    for name, body in sorted((TEMPLATES if templates is None else templates).items()):
        if len(w := template_words(body)):
            deciding = template_words(DECIDING.get(name, "")) if templates is None else w[:0]
            known.append(Template(name, w, np.unique(deciding), np.setdiff1d(names, w) if templates is None else w[:0]))
    # a text is aligned with a template only if it holds its deciding words
    # and, without any, enough of its words
    signs = np.unique(np.concatenate([names, *[t.deciding for t in known]]))
    kind = df.schema[key].dataType.simpleString()
    shape = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]):
        known_deciding = [(t, set(t.deciding.tolist())) for t in known]
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = words(*text_buffer(part.column("text")), _BREAK)
                at = np.minimum(np.searchsorted(signs, hashes), len(signs) - 1)
                held = np.flatnonzero(signs[at] == hashes)
                cuts = np.searchsorted(held, first)
                rows = []
                for i in range(part.num_rows):
                    here = set(hashes[held[cuts[i] : cuts[i + 1]]].tolist())
                    some = [t for t, deciding in known_deciding if deciding <= here]
                    rows.append(find(hashes[first[i] : first[i + 1]], some, threshold) if some else [])
                rows = [[dict(zip(("license", "first_word", "end_word", "coverage"), f)) for f in r] for r in rows]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(rows, shape)], names=["k", "findings"])

    staged = df.select(F.col(key).alias("k"), F.col(text).alias("text"))
    out = staged.mapInArrow(run, f"k {kind}, findings array<struct<license:string,first_word:bigint,end_word:bigint,coverage:double>>")
    return out.withColumnRenamed("k", key)
