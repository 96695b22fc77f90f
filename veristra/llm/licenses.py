"""Licence scan: TF-IDF cosine of lines, headers and whole texts to templates, then inheritance from directories.

Every line of every text, every run of consecutive lines up to REACH words and the whole text are compared to all
templates, so that a notice is found however it is wrapped. Templates are notices, and whole grants of the short
licences (MIT, BSD, ISC, Unlicense); of long ones (GPL family, Apache, MPL, Creative Commons) the notices alone, not
the legal code. A text that is as near to a second licence (MARGIN), as a GPL notice without a version, is left open. The templates' vocabulary is fixed, so the counts behind the
idf, taken over all files, are one bounded row; words outside it weigh as words never seen. Texts, lines and runs without
any of the ``heavy`` words are left out before they are scored, which loses nothing: what lacks them can't come near any
template. A file without a licence
of its own takes that of the nearest directory above it that holds a licence file. That is an equi-join of each
file's directories, as many as its path is deep, with the directories that have a licence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristra.llm.common import cut_lineage

THRESHOLD = 0.6
#: By how much a licence must be nearer than the next: a version apart in a long notice is 0.02.
MARGIN = 0.01
#: A file whose whole text comes so near a template is little else than a licence.
WHOLE = 0.85
#: Files that one slice of a folder holds when they learn what they inherit; there are 64 slices at least.
SLICE = 1_000_000
#: Names of licence files, without case and extension.
NAMES = "license|licence|copying|notice|unlicense"

TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See the LICENSE file for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and sell copies of the software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "All rights reserved."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("ISC", "Licensed under the ISC License."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This program is free software: you can redistribute it and modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

_token = re.compile(r"[a-z0-9]+")


def tokens(text: str) -> list[str]:
    return _token.findall(text.lower())


VOCABULARY = tuple(sorted({t for _, text in TEMPLATES for t in tokens(text)}))
#: Words of a run of lines: the longest template and a quarter for lines between, as of a copyright.
REACH = max(len(tokens(text)) for _, text in TEMPLATES) * 5 // 4


class Scanner:
    """Templates as unit vectors, and the best of them for a text."""

    def __init__(self, idf: dict[str, float], unseen: float):
        self.idf, self.unseen = idf, unseen
        self.place = {t: i for i, t in enumerate(VOCABULARY)}
        self.names = [name for name, _ in TEMPLATES]
        self.templates = np.zeros((len(TEMPLATES), len(VOCABULARY)))
        for row, (_, text) in zip(self.templates, TEMPLATES, strict=True):
            for t, n in Counter(tokens(text)).items():
                row[self.place[t]] = self.weight(t, n)
            row /= np.sqrt((row * row).sum())
        self.heavy = self._heavy(THRESHOLD)

    def _heavy(self, least: float) -> frozenset[str]:
        """Words of which any text that reaches the cosine ``least`` has one.

        A text that shares only some words with a template is no nearer to it than the root of these words' share of
        the template's square. So of each template the heaviest words count, until the rest cannot come to ``least``.
        """
        words = np.array(VOCABULARY)
        found: set[str] = set()
        for row in self.templates:
            order = np.argsort(-row, kind="stable")
            rest = 1 - np.cumsum(row[order] ** 2)
            found.update(words[order[: int(np.argmax(rest < least * least * (1 - 1e-9))) + 1]].tolist())
        return frozenset(found)

    def weight(self, term: str, n: int) -> float:
        return (1 + math.log(n)) * self.idf.get(term, self.unseen)

    def best(self, counts: dict[str, int], square: float | None = None) -> tuple[float, str | None]:
        """Highest cosine and its licence, or none if a second licence is within MARGIN. square: of the vector's length, if known."""
        if square is None:
            square = sum(self.weight(t, n) ** 2 for t, n in counts.items())
        if not square:
            return 0.0, None
        vector = np.zeros(len(VOCABULARY))
        for t, n in counts.items():
            if (at := self.place.get(t)) is not None:
                vector[at] = self.weight(t, n)
        found = self.templates @ vector / math.sqrt(square)
        name = self.names[int(found.argmax())]
        second = max(x for x, other in zip(found.tolist(), self.names, strict=True) if other != name)
        return float(found.max()), name if found.max() - second >= MARGIN else None

    def runs(self, lines: list[str], least: float) -> Iterator[tuple[dict[str, int], float]]:
        """Runs of two lines and more, with a heavy word and up to REACH words, that can have a cosine of ``least``.

        Left out is only what cannot: a run is no nearer to a template than its share of known words allows, and a
        line without any at its border takes it further away.
        """
        words = [tokens(line) for line in lines]
        known = [any(t in self.place for t in w) for w in words]
        marked = [i for i, w in enumerate(words) if not self.heavy.isdisjoint(w)]
        before = np.cumsum([0, *map(len, words)]).tolist()
        after = 0
        for start in range(len(lines)):
            while after < len(marked) and marked[after] < start:
                after += 1
            if after == len(marked):
                return
            if not known[start] or before[marked[after] + 1] - before[start] > REACH:
                continue
            counts: dict[str, int] = {}
            square, inside = 0.0, 0.0
            for end in range(start, len(lines)):
                if before[end + 1] - before[start] > REACH:
                    break
                for t in words[end]:
                    n = counts[t] = counts.get(t, 0) + 1
                    more = self.weight(t, n) ** 2 - (self.weight(t, n - 1) ** 2 if n > 1 else 0.0)
                    square += more
                    if t in self.place:
                        inside += more
                if end > start and end >= marked[after] and known[end] and inside >= least * least * square * (1 - 1e-9):
                    yield counts, square

    def scan(self, text: str | None) -> tuple[str | None, float, float]:
        """Licence of the best line, run of lines or whole text that reaches the threshold, its cosine, and the cosine of the whole text.

        Below the threshold the cosine is that of the best line with a heavy word or the whole text; a text without
        a heavy word has 0.
        """
        counts = Counter(tokens(text)) if text else Counter()
        if self.heavy.isdisjoint(counts):
            return None, 0.0, 0.0
        lines = text.split("\n")
        found = [self.best(Counter(w)) for w in map(tokens, dict.fromkeys(lines)) if not self.heavy.isdisjoint(w)]
        whole = self.best(counts)
        found.append(whole)
        if len(lines) > 1:
            found += [x for x in (self.best(*run) for run in self.runs(lines, THRESHOLD)) if x[0] >= THRESHOLD]
        # what is open between two licences doesn't speak against a run that settles it, as a grant does its first sentence
        settled = [x for x in found if x[1] is not None and x[0] >= THRESHOLD]
        score, name = min(settled or found, key=lambda x: (-x[0], x[1] or ""))
        return (name if settled else None), score, whole[0]


def scan_licenses(files: DataFrame, text: str = "text", path: str = "path", key: str = "doc_id") -> DataFrame:
    """(doc_id, path, license, similarity, is_license_file, effective_license, inherited_from), a row for each row of ``files``.

    license: of the file itself. A licence file by name speaks for its directory, as does a file whose whole text
    reaches WHOLE. Of several in a directory the one of highest similarity counts, then the first path. Null
    and empty texts have no licence of their own; a null path inherits none and passes none on. Repeated rows are
    judged alike. Other columns are dropped. An empty table gives no rows.
    """
    source = files.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{path}`").cast("string").alias("path"), F.col(f"`{text}`").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, known = 0, Counter(), frozenset(VOCABULARY)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += 1
                if t:
                    seen.update(known.intersection(tokens(t)))
        yield pa.RecordBatch.from_arrays([pa.array(["", *seen]), pa.array([total, *seen.values()], pa.int64())], names=["term", "n"])

    counts = {r[0]: r[1] for r in source.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n")).collect()}
    total = counts.pop("", 0)
    idf = {t: math.log((total + 1) / (counts.get(t, 0) + 1)) + 1 for t in VOCABULARY}
    unseen = math.log(total + 1) + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(idf, unseen)
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            a, b, c = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.float64())], names=["doc_id", "path", "license", "similarity", "whole"])

    kind = source.schema["doc_id"].dataType.simpleString()
    scanned = cut_lineage(source.mapInArrow(scan, f"doc_id {kind}, path string, license string, similarity double, whole double"))
    named = F.coalesce(F.regexp_extract("path", "([^/]*)$", 1).rlike(f"(?i)^({NAMES})(\\.[a-z]+)?$"), F.lit(False))
    marked = scanned.withColumn("is_license_file", F.col("license").isNotNull() & (named | (F.col("whole") >= WHOLE)))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    best = F.min_by("license", F.struct((-F.col("similarity")).alias("s"), F.col("path")))
    holders = marked.where(F.col("is_license_file") & F.col("path").isNotNull()).groupBy(folder.alias("dir")).agg(best.alias("dir_license"))
    # folders, not files, look for an ancestor: one row a folder and level; the answer goes back to a folder's files
    # in slices, as one folder may hold a third of them
    part = F.pmod(F.xxhash64("doc_id", "path", "similarity", "whole"), F.lit(max(64, total // SLICE)))
    slices = marked.where(F.col("path").isNotNull() & F.col("license").isNull()).select(folder.alias("of"), part.alias("part")).distinct()
    folders = slices.select("of").distinct()
    parts = F.split("of", "/")
    above = folders.select("of", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("dir", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    near = above.join(holders, "dir").groupBy("of").agg(F.max_by("dir", "depth").alias("inherited_from"), F.max_by("dir_license", "depth").alias("dir_license"))
    answers = slices.join(near, "of")
    found = marked.join(answers, (folder == F.col("of")) & (part == F.col("part")) & F.col("license").isNull(), "left")
    return found.select("doc_id", "path", "license", "similarity", "is_license_file", F.coalesce("license", "dir_license").alias("effective_license"), "inherited_from")
