"""Licence scan by sparse TF-IDF cosine to templates, with inheritance from the nearest directory.

The units of a file are its lines, its paragraphs, its header (the leading block of comment lines) and
the whole file. Their words are weighted by term frequency (1 + its logarithm) and the inverse document
frequency over all files; a word that no template has counts one, each time in a dimension of its own.
The template of greatest cosine, from THRESHOLD on, is the unit's licence; the best unit gives the file its own.

No unit is judged by key words of our choice, but most need no cosine: a cosine of c needs shared
words that hold c squared of the template's squared length, so a unit must have one of the template's
heaviest words, those whose removal leaves less than that (a prefix filter, exact for any weights).

A file that is named as a licence file, or whose whole text is its best unit, also gives its licence to
its directory, named ones first; files without their own take that of the nearest ancestor directory,
by joins on paths. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, free_prefix, quoted

THRESHOLD = 0.6
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)(\.[a-z]+)?$"
#: A line that belongs to a leading comment block.
COMMENT = r"^\s*($|#|//|/\*|\*|--|;|%|<!--|\"\"\"|''')"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(kind: str, version: str) -> str:
    """The notice that the GNU licences ask to be put at the start of each file."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, {version}. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. "
        f"You should have received a copy of the GNU {kind} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


#: The texts, notices, titles and statements by which files name well-known licences.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _gnu("Affero General Public License", "either version 3 of the License, or (at your option) any later version")),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _gnu("General Public License", "either version 2 of the License, or (at your option) any later version")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _gnu("General Public License", "either version 3 of the License, or (at your option) any later version")),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _gnu("Lesser General Public License", "either version 3 of the License, or (at your option) any later version")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        + _AS_IS
        + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("proprietary", "Copyright. All rights reserved."),
]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def templates(spark: SparkSession) -> DataFrame:
    """template, licence, statement."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(TEMPLATES)], "template int, licence string, statement string")


def vectors(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(template, licence, term, idf, tw, tnorm, heavy): the templates' vectors; `rows` are (path, text), whose files the frequencies are counted over.

    As many rows as the templates have words. heavy marks words of which a unit must have one.
    """
    words = templates(spark).select("template", "licence", F.explode(terms(F.col("statement"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("ttf"))
    vocabulary = F.array(*[F.lit(w) for w in sorted({r[0] for r in words.select("term").distinct().collect()})])
    has = F.array_intersect(vocabulary, terms(F.col("text")))
    counts = rows.where("text is not null").select(F.explode(F.array_append(has, F.lit(""))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))  # '' counts the files
    counts = checkpointed(counts)
    total = counts.where("term = ''").select(F.col("df").alias("n"))
    idf = F.log((1.0 + F.coalesce("n", F.lit(0))) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
    weighted = words.join(counts, "term", "left").crossJoin(F.broadcast(total.groupBy().agg(F.max("n").alias("n")))).withColumn("idf", idf).withColumn("tw", (1 + F.log("ttf")) * F.col("idf"))
    by_weight = F.sum(F.col("tw") * F.col("tw"))
    own = Window.partitionBy("template")
    lighter = own.orderBy("tw", "term")
    squared = by_weight.over(own)
    return weighted.select("template", "licence", "term", "idf", "tw", F.sqrt(squared).alias("tnorm"), (by_weight.over(lighter) >= THRESHOLD**2 * squared).alias("heavy"))


def units_of(rows: DataFrame, heavy: Column) -> DataFrame:
    """(unit, path, line, whole, terms): the units of files that have one of the heavy words; line is that of the unit's start, from 0."""
    asked = rows.where(F.col("path").isNotNull() & F.arrays_overlap(terms(F.col("text")), heavy))
    lines = F.split("text", "\n", -1)
    header = F.transform(lines, lambda x: x.rlike(COMMENT))
    size = F.when(F.forall(header, lambda x: x), F.size(lines)).otherwise(F.array_position(header, F.lit(False)).cast("int") - 1)
    unit = lambda text, line, whole: F.struct(text.alias("unit"), line.cast("int").alias("line"), F.lit(whole).alias("whole"))
    every = F.concat(
        F.transform(lines, lambda x, i: unit(x, i, False)),
        F.array(unit(F.array_join(F.slice(lines, F.lit(1), size), "\n"), F.lit(0), False), unit(F.col("text"), F.lit(0), True)),
    )
    simple = asked.select("path", F.explode(every).alias("u")).select("path", "u.line", "u.whole", F.col("u.unit").alias("unit"))
    # Paragraphs, of texts that have more than one: each starts behind the lines of those before it.
    blank = F.split("text", "\n[ \t\r]*\n", -1)
    each = asked.where(F.size(blank) > 1).select("path", F.xxhash64("path", "text").alias("row"), F.posexplode(blank).alias("at", "unit"))
    before = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    line = F.coalesce(F.sum(F.size(F.split("unit", "\n", -1)) + 1).over(before), F.lit(0)).cast("int")
    paragraphs = each.select("path", line.alias("line"), F.lit(False).alias("whole"), "unit")
    out = simple.unionByName(paragraphs).withColumn("terms", terms(F.col("unit"))).where(F.arrays_overlap("terms", heavy))
    return out.select(F.xxhash64("path", "line", "whole", "unit").alias("unit"), "path", "line", "whole", "terms")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """files with own_licence, own_score, licence, score, licence_from (the path that it comes from) and licence_line (from 0).

    Null paths and texts have no licence. Ties go to the smaller licence name, the earlier line and
    the smaller path. Paths are parts joined by '/'; a file's directories are its proper prefixes,
    the root '' last. Rows that repeat a path count as one file with the units of all. `threshold` is
    THRESHOLD or more. An empty table gives an empty result. Columns of those names are replaced, all
    others kept, whatever they are called.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"threshold must be {THRESHOLD} or more")
    made = ("own_licence", "own_score", "licence", "score", "licence_from", "licence_line")
    spark = files.sparkSession
    rows = files.select(F.col(quoted(path_col)).cast("string").alias("path"), F.col(quoted(text_col)).cast("string").alias("text"))
    known = checkpointed(vectors(spark, rows))
    heavy = F.array(*[F.lit(r[0]) for r in known.where("heavy").select("term").distinct().orderBy("term").collect()])  # words of templates
    units = units_of(rows, heavy)
    vocabulary = F.broadcast(known.groupBy("term").agg(F.max("idf").alias("idf")))
    words = units.select("unit", "path", "line", "whole", F.explode("terms").alias("term")).join(vocabulary, "term", "left")
    # A row for each known word of a unit, and one for all its others, each of which counts one.
    counted = words.groupBy("unit", "path", "line", "whole", F.when(F.col("idf").isNotNull(), F.col("term")).alias("term")).agg(F.count("*").alias("tf"), F.max("idf").alias("idf"))
    counted = checkpointed(counted.withColumn("w", (1 + F.log("tf")) * F.col("idf")))
    norms = counted.groupBy("unit").agg(F.sqrt(F.sum(F.when(F.col("term").isNull(), F.col("tf").cast("double")).otherwise(F.col("w") * F.col("w")))).alias("norm"))
    scores = (
        counted.join(F.broadcast(known.select("template", "licence", "term", "tw", "tnorm")), "term")
        .groupBy("unit", "path", "line", "whole", "template", "licence")
        .agg(F.sum(F.col("w") * F.col("tw") / F.col("tnorm")).alias("dot"))
        .join(norms, "unit")
        .withColumn("score", F.round(F.col("dot") / F.col("norm"), 9))
        .where(F.col("score") >= threshold)
    )
    own = scores.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence", "line", (~F.col("whole")).alias("part"))).alias("b"))
    own = checkpointed(own.select("path", F.col("b.licence").alias("own_licence"), (-F.col("b.s")).alias("own_score"), F.col("b.line").alias("own_line"), (~F.col("b.part")).alias("whole")))
    # Licences of directories, and the nearest one above each file that has none of its own.
    parent = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    giving = own.where(F.col("whole") | F.col("path").rlike(LICENCE_FILE)).withColumn("dir", parent("path"))
    by_dir = giving.groupBy("dir").agg(F.min(F.struct((~F.col("path").rlike(LICENCE_FILE)).alias("unnamed"), (-F.col("own_score")).alias("s"), F.col("own_licence").alias("licence"), F.col("path").alias("from"), F.col("own_line").alias("line"))).alias("d"))
    dirs = rows.where("path is not null").select(parent("path").alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))).alias("depth")).withColumn("up", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    nearest = above.join(by_dir.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by("d", "depth").alias("d"))
    p = free_prefix(files)
    path, folder, near = p + "path", p + "dir", p + "d"
    base = files.select(*[F.col(quoted(c)) for c in files.columns if c not in made], F.col(quoted(path_col)).cast("string").alias(path))
    base = base.withColumn(folder, parent(path))
    found = own.select(F.col("path").alias(path), *[F.col(c).alias(p + c) for c in ("own_licence", "own_score", "own_line")])
    joined = base.join(found, path, "left").join(nearest.select(F.col("dir").alias(folder), F.col("d").alias(near)), folder, "left")
    has, d = F.col(p + "own_licence").isNotNull(), F.col(near)
    return joined.select(
        *[F.col(quoted(c)) for c in files.columns if c not in made],
        F.col(p + "own_licence").alias("own_licence"),
        F.col(p + "own_score").alias("own_score"),
        F.coalesce(F.col(p + "own_licence"), d["licence"]).alias("licence"),
        F.coalesce(F.col(p + "own_score"), -d["s"]).alias("score"),
        F.when(has, F.col(path)).otherwise(d["from"]).alias("licence_from"),
        F.when(has, F.col(p + "own_line")).otherwise(d["line"]).alias("licence_line"),
    )
