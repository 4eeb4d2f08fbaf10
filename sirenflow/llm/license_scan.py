"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

Short notices are met by lines and by the sentences of a line. Longer templates, whole headers and licence texts,
wrap over many lines in files; they are met by windows of as many terms as the template has, wherever lines break.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenflow.llm.common import saved

# fixed values: public licence notices, headers and texts, (licence, template). A licence may have several.
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction,"
    " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished"
    " to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
    " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF"
    " OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_THIRD_CLAUSE = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND"
    " FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
    " (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,"
    " STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(what: str, name: str, version: str) -> str:
    """The header of the GNU licences, which differ in these words."""
    return (
        f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of"
        f" the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or"
        f" FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}"
    )


_WRITE_TO = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_SEE = ". If not, see <https://www.gnu.org/licenses/>."
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
     " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES"
     " OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and"
     " conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is"
     " granting the License. \"Legal Entity\" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity."),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", _GRANT),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", _gnu("program", "General Public License", "2") + _WRITE_TO),
    ("GPL-2.0", _gnu("program", "General Public License", "2") + _SEE),
    ("LGPL-2.1", _gnu("library", "Lesser General Public License", "2.1") + _WRITE_TO),
    ("LGPL-2.1", _gnu("library", "Lesser General Public License", "2.1") + _SEE),
    ("LGPL-3.0", _gnu("program", "Lesser General Public License", "3") + _SEE),
    ("LGPL-3.0", _gnu("library", "Lesser General Public License", "3") + _SEE),
    ("AGPL-3.0", _gnu("program", "Affero General Public License", "3") + _SEE),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of"
     " the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or"
     " FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see"
     " <https://www.gnu.org/licenses/>."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document,"
     " but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are"
     " designed to take away your freedom to share and change the works."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", _TWO_CLAUSES + _THIRD_CLAUSE + _AS_IS),
    ("BSD-2-Clause", _TWO_CLAUSES + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice"
     " appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO"
     " EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,"
     " NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Licensed under CC0 1.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("proprietary", "All rights reserved"),
)
COSINE = 0.8
#: Templates of more terms than this are met by windows; a window is scored if this share of its terms is in the template.
LINE_TERMS, SHARED = 40, 0.6
_SENTENCE = re.compile(r"(?<=[.!?;])\s+(?=\S)")
_TERM = re.compile(r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9])?")


#: Words that tell licences of one family apart, fixed values.
FAMILY = frozenset(("lesser", "affero"))


def _terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def marks(terms: list[str]) -> tuple[frozenset[str], frozenset[str]]:
    """(the family's words, the versions named after "version" or "v") of a text."""
    return FAMILY.intersection(terms), frozenset(b for a, b in zip(terms, terms[1:], strict=False) if a in ("version", "v") and b[0].isdigit())


def agree(template: tuple[frozenset[str], frozenset[str]], part: tuple[frozenset[str], frozenset[str]]) -> bool:
    """The same family, and the template's versions named; a template without a version fits parts without one only."""
    return template[0] == part[0] and (template[1] <= part[1] if template[1] else not part[1])


def _text_counts(vocab: frozenset[str]):
    """Per batch of texts: how many hold each term of the notices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter[str] = Counter()
            for text in pdf["text"]:
                seen.update(set().union(*(vocab.intersection(_terms(x)) for x in (text or "").split("\n"))))
            yield pd.DataFrame({"term": list(seen), "n": list(seen.values())}, columns=["term", "n"]).astype({"term": "object", "n": "int64"})

    return run


def windows(terms: list[str], template: frozenset[str], size: int, shared: float = SHARED) -> Iterator[tuple[int, int]]:
    """(first, stop) of the windows of ``size`` terms to score: of each run of windows with a share of template terms of at least ``shared``, the one with the most, the first of equals."""
    n = min(size, len(terms))
    held = np.concatenate(([0], np.cumsum([t in template for t in terms])))
    count = held[n:] - held[:-n] if n else held[:0]
    good = np.concatenate(([False], count >= shared * size, [False]))
    edge = np.flatnonzero(good[1:] != good[:-1])
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        at = a + int(count[a:b].argmax())
        yield at, at + n


def _text_licenses(vectors: list[tuple[str, int, dict[str, float], tuple]], idf: dict[str, float], other: float, cosine: float):
    """Per text: the best licence of its parts and windows, its score, and whether matching parts hold half of the words.

    ``vectors``: licence, number of terms, unit vector and marks of each template.
    """
    known = [(name, n, v, {t: x * x for t, x in v.items()}, own) for name, n, v, own in vectors]

    def score(tf: Counter, v: dict[str, float]) -> float:
        norm = math.sqrt(sum((n * idf.get(t, other)) ** 2 for t, n in tf.items()))
        return sum(n * idf[t] * v.get(t, 0.0) for t, n in tf.items() if t in idf) / norm

    def reachable(terms: set[str], templates: list) -> list:
        """The templates whose cosine with a choice of these terms can reach the wanted one: it is at most the norm of the template on them."""
        return [t for t in templates if sum(t[3][x] for x in t[3].keys() & terms) >= cosine * cosine - 1e-9]

    def licence(text: str) -> tuple[float, str, bool]:
        best, terms = (cosine, ""), _terms(text)
        near = reachable(set(terms), known)
        if not near:
            return *best, False
        covered = np.zeros(len(terms), bool)
        short, at = [t for t in near if t[1] <= LINE_TERMS], 0
        for line in text.split("\n") if short else ():
            own = _terms(line)
            fits = reachable(set(own), short) if len(own) > 1 else []
            if fits:
                pieces = [_terms(x) for x in _SENTENCE.split(line.strip())]
                for k, part in enumerate([own, *pieces] if len(pieces) > 1 else [own]):
                    distinct = set(part)
                    named = marks(part)
                    got = max(((score(Counter(part), v), name) for name, _, v, _, own_ in reachable(distinct, fits) if agree(own_, named)), default=(0.0, "")) if len(distinct) > 1 else (0.0, "")
                    if got[0] >= cosine:
                        best = max(best, got)
                        start = at if k == 0 else at + sum(map(len, pieces[: k - 1]))
                        covered[start : start + len(part)] = True
            at += len(own)
        for name, size, v, _, own_ in near:
            if size > LINE_TERMS:
                for a, b in windows(terms, frozenset(v), size):
                    got = score(Counter(terms[a:b]), v) if agree(own_, marks(terms[a:b])) else 0.0
                    if got >= cosine:
                        best = max(best, (got, name))
                        covered[a:b] = True
        return *best, bool(best[1]) and 2 * int(covered.sum()) >= len(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [licence(text or "") for text in pdf.pop("text")]
            score_ = [round(g[0], 6) if g[1] else None for g in got]
            yield pdf.assign(own_license=pd.Series([g[1] or None for g in got], dtype=object, index=pdf.index), score=pd.Series(score_, dtype=float, index=pdf.index), is_license_file=pd.Series([g[2] for g in got], dtype=bool, index=pdf.index))

    return run


def scan(files: DataFrame, path: str = "path", text: str = "text", templates=TEMPLATES, cosine: float = COSINE) -> DataFrame:
    """One row per file: path, own_license, score, is_license_file, license, inherited_from.

    Each line of the whole text, each sentence of a line and each window of a template's length is a TF-IDF vector; its
    cosine to the templates gives the file's licence (best score, then name), if both name the same version and family:
    a notice of another version is no copy of the template, however alike. "GPL" is the GNU licence of no named version. Document frequencies of the templates'
    terms are counted over all files; terms outside the templates weigh as if one file had them. A file whose
    matching parts hold at least half of its words is a licence file: it
    also covers its directory and, by nearest ancestor, the directories below. Files without a licence of their
    own inherit; the same directory counts as the nearest; of several licence files in one the smallest path wins.
    Null text has no licence; a null path has no directory; repeated rows give repeated results; empty
    tables give empty results. Extra columns are not read.
    """
    vocab = frozenset(t for _, n in templates for t in _terms(n))  # fixed and small
    src = files.select(F.col(path).alias("path"), F.col(text).alias("text"))
    n = src.count()
    df = src.select("text").mapInPandas(_text_counts(vocab), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in df.collect()}  # at most one row a term of the notices
    idf = {t: _idf(n, counts.get(t, 0)) for t in vocab}
    vectors = []
    for name, notice in templates:
        tf = Counter(_terms(notice))
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in tf.items()))
        vectors.append((name, sum(tf.values()), {t: c * idf[t] / norm for t, c in tf.items()}, marks(_terms(notice))))
    schema = src.select("path").schema.add("own_license", "string").add("score", "double").add("is_license_file", "boolean")
    rows = saved(src.mapInPandas(_text_licenses(vectors, idf, _idf(n, 1), cosine), schema).withColumn("score", F.nanvl("score", F.lit(None).cast("double"))))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    cover = rows.where("is_license_file and path is not null").groupBy(folder.alias("dir")).agg(F.min(F.struct("path", "own_license")).alias("by"))
    # every ancestor directory of every directory that needs one, the root ("") included
    need = rows.where("own_license is null and path is not null").select(folder.alias("of")).distinct()
    parts = F.split("of", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))
    near = need.select("of", F.explode(up).alias("a")).select("of", "a.*").join(cover, "dir").groupBy("of").agg(F.max(F.struct("depth", F.col("by.path").alias("path"), F.col("by.own_license").alias("license"))).alias("near"))
    out = rows.withColumn("of", folder).join(saved(near), "of", "left")
    gets = F.col("own_license").isNull()
    return out.select("path", "own_license", "score", "is_license_file", F.coalesce("own_license", F.col("near.license")).alias("license"), F.when(gets, F.col("near.path")).alias("inherited_from"))


def _idf(n: int, df: int) -> float:
    return math.log((n + 1) / (df + 1)) + 1
