"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

DataFrame functions only. Units of a file are its lines, its blocks of lines between
blank ones (a header is one), and the whole text of a file named as a licence. Term
statistics cover all files. A unit without a heavy term of any template is too far
from all of them (a bound that loses nothing), so only few units are scored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details.
You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."""
# Licence names and the texts that stand for them: licence bodies, headers, titles, statements and identifiers.
TEMPLATES = (
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _GNU.format("Affero General Public License", 3)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", f"{_BSD_2}\n{_BSD_END}"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", f"{_BSD_2}\n{_BSD_3}\n{_BSD_END}"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "CC0 1.0 Universal. To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _GNU.format("General Public License", 2)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _GNU.format("General Public License", 3)),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", _ISC),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", 3)),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", _MIT),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Proprietary", "Copyright. All rights reserved. No license is granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: Words and numbers; identifiers fall apart at hyphens, versions stay whole.
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: What stands between two blocks of lines.
GAP = r"\n(?:[ \t\r]*\n)+"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
LEAST_COSINE = 0.6


def templates(spark: SparkSession) -> DataFrame:
    """(tid, license, unit): a table of fixed size."""
    rows = F.array(*[F.struct(F.lit(i).alias("tid"), F.lit(a).alias("license"), F.lit(b).alias("unit")) for i, (a, b) in enumerate(TEMPLATES)])
    return spark.range(1).select(F.inline(rows))


def terms_of(text: Column) -> Column:
    """All terms of a text, repeated ones included."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _weights(units: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """(key, term, w) of units(key, unit): (1 + ln tf) * idf."""
    tf = units.select(key, F.explode(terms_of(F.col("unit"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    return tf.join(idf.hint("merge"), "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))


def _norms(vectors: DataFrame, key: str, name: str) -> DataFrame:
    return vectors.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(name))


def heavy_terms(vectors: list[tuple[int, str, float]]) -> list[str]:
    """Terms of which a unit must hold at least one to reach LEAST_COSINE with any of these vectors(tid, term, w).

    The lightest terms of a template whose joint norm stays below LEAST_COSINE of its
    whole norm cannot reach the cosine by themselves (Cauchy-Schwarz); the others are heavy.
    """
    own: dict[int, list[tuple[float, str]]] = {}
    for tid, term, w in vectors:
        own.setdefault(tid, []).append((w, term))
    heavy: set[str] = set()
    for terms in own.values():
        left = (LEAST_COSINE * 0.999) ** 2 * math.fsum(w * w for w, _ in terms)
        for w, term in sorted(terms):
            left -= w * w
            if left <= 0:
                heavy.add(term)
    return sorted(heavy)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per row of files: (doc_id, path, own_license, cosine, license, inherited_from).

    Units of a text are its lines, its blocks of lines between blank ones and, for a
    file whose name says licence, the whole text. A unit's vector holds its terms,
    weighted (1 + ln tf) * ln((1 + n) / df), where n counts files and templates and
    df those of them that hold the term; its licence is that of the template of
    the highest cosine (the first by name of equals) if that is at least
    LEAST_COSINE. own_license is that of the file's unit of the highest cosine, then
    the first by name. A directory has the own licence of its licence file (by name;
    the first by path, then id). license is own_license or else that of the nearest
    directory above the file that has one, which inherited_from names. Null or empty
    texts state nothing; null paths are in no directory. Rows that repeat an id are
    scanned each under that id and path; further columns are not read; an empty
    table gives an empty result.
    """
    spark = files.sparkSession
    work = Scratch(spark, "licenses")
    own = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    model = work.table(templates(spark), "templates")

    # Statistics over all files: one scan, combined before the shuffle.
    terms = F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")
    df = own.where("text is not null").select(terms).groupBy("term").agg(F.count("*").alias("df"))
    df = df.unionAll(model.select(F.explode(F.array_distinct(terms_of(F.col("unit")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    df = work.table(df.groupBy("term").agg(F.sum("df").alias("df")), "df")
    n = own.count() + len(TEMPLATES)
    idf = df.select("term", F.log((1 + F.lit(n)) / F.col("df")).alias("idf"))
    vectors = work.table(_weights(model, "tid", idf), "vectors")
    heavy = F.array(*map(F.lit, heavy_terms([tuple(r) for r in vectors.collect()])))  # the templates' terms: a table of fixed size

    # Units that hold a heavy term; equal units are scored once.
    whole = F.when(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENSE_FILE), F.array("text")).otherwise(F.array().cast("array<string>"))
    parts = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", GAP), whole))
    units = own.where(F.arrays_overlap(terms_of(F.col("text")), heavy)).select("doc_id", "path", F.explode(parts).alias("unit"))
    units = units.where(F.arrays_overlap(terms_of(F.col("unit")), heavy)).withColumn("uid", F.unhex(F.md5("unit")))
    units = work.table(units, "units")
    distinct = work.table(units.groupBy("uid", "unit").agg(F.lit(1).alias("k")).select("uid", "unit"), "distinct")
    held = work.table(distinct.select(F.explode(F.array_distinct(terms_of(F.col("unit")))).alias("term")).distinct(), "held")
    mine = work.table(_weights(distinct, "uid", idf.join(held.hint("merge"), "term", "left_semi")), "weights")
    # The templates' vectors and norms are tables of fixed size.
    theirs = vectors.select("tid", "term", F.col("w").alias("tw"))
    dots = mine.join(F.broadcast(theirs), "term").groupBy("uid", "tid").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    sizes = _norms(vectors, "tid", "their_norm").join(F.broadcast(model.select("tid", "license")), "tid")
    scored = dots.join(F.broadcast(sizes), "tid").join(_norms(mine, "uid", "norm").hint("merge"), "uid")
    scored = scored.select("uid", "license", F.round(F.col("dot") / (F.col("norm") * F.col("their_norm")), 6).alias("cosine")).where(F.col("cosine") >= LEAST_COSINE)
    first = F.min_by(F.struct("license", "cosine"), F.struct((-F.col("cosine")).alias("c"), F.col("license").alias("l")))
    named = work.table(scored.groupBy("uid").agg(first.alias("b")).select("uid", "b.license", "b.cosine"), "named")

    stated = units.select("doc_id", "path", "uid").join(named.hint("merge"), "uid").groupBy("doc_id", "path").agg(first.alias("b"))
    stated = work.table(stated.select(F.col("doc_id").alias("d"), F.col("path").alias("p"), F.col("b.license").alias("own_license"), F.col("b.cosine").alias("cosine")), "stated")

    name = F.regexp_extract("path", "[^/]*$", 0)
    holders = own.select("doc_id", "path").where(F.col("path").isNotNull() & name.rlike(LICENSE_FILE)).hint("merge")
    holders = holders.join(stated.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("path").eqNullSafe(F.col("p")))
    dirs = holders.groupBy(directory(F.col("path")).alias("above")).agg(F.min_by("own_license", F.struct("path", "doc_id")).alias("dir_license"))
    dirs = work.table(dirs, "directories")
    # Each directory is resolved once, by joining the paths above it.
    places = own.where("path is not null").select(directory(F.col("path")).alias("dir")).distinct()
    steps = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    ups = places.select("dir", F.posexplode(ups).alias("depth", "above"))
    nearest = ups.join(dirs.hint("merge"), "above").groupBy("dir").agg(F.max_by(F.struct("dir_license", "above"), "depth").alias("near"))
    nearest = work.table(nearest.select("dir", "near.dir_license", F.col("near.above").alias("from_dir")), "nearest")

    out = own.select("doc_id", "path").join(stated.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("path").eqNullSafe(F.col("p")), "left")
    out = out.withColumn("dir", directory(F.col("path"))).join(nearest.hint("merge"), "dir", "left")
    takes = F.col("own_license").isNull() & F.col("dir_license").isNotNull()
    return out.select("doc_id", "path", "own_license", "cosine", F.coalesce("own_license", "dir_license").alias("license"), F.when(takes, F.col("from_dir")).alias("inherited_from"))
