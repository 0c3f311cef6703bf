"""Licences of files by sparse TF-IDF cosine to templates, inherited along directories.

What is compared: the whole text, its header (the comment lines it begins with), every paragraph (lines
up to one without a letter or digit) and every line of a paragraph. Templates are whole licences (the long ones
in ``licence_texts``) and the notices by which they ask to be named. All are sparse vectors of words times inverse document frequency,
``ln((1 + N) / (1 + n)) + 1``, where n counts the files that hold the word, over all files and all words.

Two exact bounds spare most of the work. A template's rarest words are taken until the rest of its
vector is shorter than the threshold: what holds none of them can't reach it. And no word weighs less
than 1, so the words a template lacks lengthen a vector by what their number tells: only what can still
reach the threshold has all its words weighed.

A file's best cosine at or above the threshold is its own licence; of equal ones, the later name. A file
without one takes that of the nearest directory above it that holds a licence file: by name, or because
half of its words or more are licence text. If a directory holds several licence files, the one of
highest cosine, then of first path, counts.

Null and empty texts have no licence of their own. A null path is one file in no directory. Rows are told
apart by key, path and text, so rows may share a key or have none; equal rows are judged alike. Columns
other than these three are ignored, whatever their names. A very long text is held by one task. An empty
table gives no rows.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, require, stored, text_or_empty

THRESHOLD = 0.72
#: Directories with a licence, and words of likely licences, up to which they are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000

# Licences, and notices by which they ask to be named, with their SPDX identifiers.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_LIABILITY = """IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""
_BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_NAMED = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_REST = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_NAMED = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."""
_GPL_REST = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {} along with this program. If not, see <https://www.gnu.org/licenses/>."""
TEMPLATES = [
    ("MIT", f"The MIT License\n{_MIT_GRANT}\n{_MIT_REST}\n{_AS_IS} {_MIT_LIABILITY}"),
    ("MIT", _MIT_GRANT),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-2-Clause", f"{_BSD_GRANT}\n{_BSD_TWO}\n{_BSD_REST}"),
    ("BSD-3-Clause", f"{_BSD_GRANT}\n{_BSD_TWO}\n{_BSD_THIRD}\n{_BSD_REST}"),
    ("BSD-3-Clause", _BSD_GRANT),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", f"{_ISC_GRANT}\n{_ISC_REST}"),
    ("ISC", _ISC_GRANT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", f"{_APACHE_NAMED}\n{_APACHE_REST}"),
    ("Apache-2.0", _APACHE_NAMED),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", f"{_GPL_NAMED.format('General Public License', 2)}\n{_GPL_REST.format(*['General Public License'] * 2)}"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", f"{_GPL_NAMED.format('General Public License', 3)}\n{_GPL_REST.format(*['General Public License'] * 2)}"),
    ("GPL-3.0", _GPL_NAMED.format("General Public License", 3)),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", f"{_GPL_NAMED.format('Lesser General Public License', 3)}\n{_GPL_REST.format(*['Lesser General Public License'] * 2)}"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("AGPL-3.0", f"{_GPL_NAMED.format('Affero General Public License', 3)}\n{_GPL_REST.format(*['Affero General Public License'] * 2)}"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: Whole licences, each a file named by its identifier.
TEMPLATES += [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted((resources.files(__package__) / "licence_texts").iterdir(), key=lambda f: f.name)]
LICENCE_FILE = r"(?i)^(licen[cs]es?|copying|notice)([.-].*)?$"
#: How the first lines of a file begin that are its header, and a line without a word.
COMMENT, WORDLESS = r"^\s*(#|//|/\*|\*|--|;|%|<!--|\"\"\"|''')", r"\n[^\p{L}\p{N}\n]*(?=\n|$)"


def terms(text: str | Column) -> Column:
    """Lower-case words and version numbers of a text."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?!\p{N})|(?<!\p{N})\."), "")


def _row_key(key: str, path: str, text: str) -> list[Column]:
    """What rows are told apart by: doc and uid."""
    return [F.coalesce(F.col(key).cast("string"), F.lit("\0null")).alias("doc"), F.xxhash64(path, text_or_empty(text)).alias("uid")]


def header(text: str) -> Column:
    """The comment lines a text begins with, if they hold a line without a word; else they are one paragraph."""
    lines = F.split(text, "\n")
    ends = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT) | ~x.rlike(r"\S")), False)
    return F.array_join(F.slice(lines, 1, F.when(ends == 0, F.size(lines)).otherwise(ends - 1).cast("int")), "\n")


def units_of(rows: DataFrame, telling: Column) -> DataFrame:
    """doc, uid, at (the paragraph, or -1), kind, size and terms of what is compared: all that hold a ``telling`` term."""
    likely = rows.withColumn("all", terms("whole")).filter(F.arrays_overlap("all", telling))
    likely = likely.select("doc", "uid", "whole", F.size("all").alias("n_terms"))
    part = lambda kind, at, text: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), text.alias("part"))
    paragraphs = F.filter(F.transform(F.split("whole", WORDLESS), lambda x: F.ltrim(x, F.lit("\n"))), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    cut = likely.withColumn("paragraphs", paragraphs)
    several = F.size("paragraphs") > 1
    head = header("whole")
    parts = F.concat(
        F.transform("paragraphs", lambda x, i: part("paragraph", i, x)),
        F.flatten(F.transform("paragraphs", lambda x, i: F.when(F.instr(x, "\n") > 0, F.transform(F.split(x, "\n"), lambda y: part("line", i, y))).otherwise(F.array().cast("array<struct<kind:string,at:int,part:string>>")))),
        F.when(several, F.array(part("whole", F.lit(-1), F.col("whole")), part("header", F.lit(-1), head))).otherwise(F.array().cast("array<struct<kind:string,at:int,part:string>>")),
    )
    units = cut.select("doc", "uid", "n_terms", F.posexplode(parts).alias("unit", "x")).select("doc", "uid", "n_terms", "unit", "x.kind", "x.at", terms("x.part").alias("terms"))
    return units.filter(F.arrays_overlap("terms", telling)).withColumn("size", F.size("terms"))


def own_licences(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """doc, uid, best licence, its cosine and the share of words in licence text, of rows that have one."""
    spark = files.sparkSession
    templates = spark.createDataFrame([(i, name, whole) for i, (name, whole) in enumerate(TEMPLATES)], "template int, licence string, whole string")
    tf = templates.select("template", "licence", F.explode(terms("whole")).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    rows = files.select(*_row_key(key, path, text), text_or_empty(text).alias("whole"))
    words = sorted(r["term"] for r in tf.select("term").distinct().collect())
    # The empty word counts the files themselves, in the same aggregation.
    counted_words = rows.select(F.explode(F.array_append(F.array_intersect(terms("whole"), F.lit(words)), F.lit(""))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    n = next((r["df"] for r in counted_words if r["term"] == ""), 0)
    df = spark.createDataFrame([tuple(r) for r in counted_words], "term string, df long")
    idf = F.log((1.0 + n) / (1.0 + F.coalesce("df", F.lit(0)))) + 1
    # Templates are bounded: what is made of them alone may be collected and broadcast.
    weighed = tf.join(df, "term", "left").select("template", "licence", "term", (F.col("tf") * idf).alias("w"), idf.alias("idf")).collect()
    norms: dict[int, float] = {}
    for r in weighed:
        norms[r["template"]] = norms.get(r["template"], 0.0) + r["w"] ** 2
    telling: set[str] = set()
    for template, squared in norms.items():
        rest = squared
        for r in sorted((r for r in weighed if r["template"] == template), key=lambda r: (-r["idf"], -r["w"], r["term"])):
            if rest < (THRESHOLD**2 - 1e-9) * squared:
                break
            telling.add(r["term"])
            rest -= r["w"] ** 2
    vocabulary = spark.createDataFrame(sorted({(r["term"], r["idf"]) for r in weighed}), "term string, idf double")
    t_weights = spark.createDataFrame([(r["template"], r["licence"], r["term"], r["w"] / norms[r["template"]] ** 0.5) for r in weighed], "template int, licence string, term string, t_w double")
    units = units_of(rows, F.lit(sorted(telling)))
    of_unit = ["doc", "uid", "n_terms", "unit", "kind", "at", "size"]
    counted = units.select(*of_unit, F.explode("terms").alias("term")).groupBy(*of_unit, "term").agg(F.count("*").alias("tf"))
    counted = stored(counted.join(F.broadcast(vocabulary), "term", "left"), "unit-words")
    # Words outside all templates weigh 1 at least.
    lengths = counted.groupBy("doc", "uid", "unit").agg(F.coalesce(F.sum((F.col("tf") * F.col("idf")) ** 2), F.lit(0.0)).alias("squared"), F.coalesce(F.sum(F.when(F.col("idf").isNull(), F.col("tf") ** 2)), F.lit(0.0)).alias("others"))
    dots = counted.join(F.broadcast(t_weights), "term").groupBy(*of_unit, "template", "licence").agg(F.sum(F.col("tf") * F.col("idf") * F.col("t_w")).alias("dot"))
    near = stored(dots.join(lengths, ["doc", "uid", "unit"]).filter(F.col("dot") >= (THRESHOLD - 1e-9) * F.sqrt(F.col("squared") + F.col("others"))), "likely-licences")
    outside = stored(counted.filter(F.col("idf").isNull()).join(near.select("doc", "uid", "unit").distinct(), ["doc", "uid", "unit"]).select("doc", "uid", "unit", "term", "tf"), "other-words")
    # Only of these words the number of files is still to be counted.
    wanted = stored(outside.select("term").distinct(), "other-terms")
    few = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    other_df = stored(rows.select(F.explode(F.array_distinct(terms("whole"))).alias("term")).join(few, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")), "document-frequencies")
    rest = outside.join(other_df, "term").groupBy("doc", "uid", "unit").agg(F.sum((F.col("tf") * idf) ** 2).alias("rest"))
    cosine = F.col("dot") / F.sqrt(F.col("squared") + F.coalesce("rest", F.lit(0.0)))
    cosines = near.join(rest, ["doc", "uid", "unit"], "left").withColumn("cosine", cosine).filter(F.col("cosine") >= THRESHOLD)
    of_units = cosines.groupBy(*of_unit).agg(F.max(F.struct("cosine", "licence")).alias("best"))
    covered = F.when(F.col("at") < 0, F.max("size")).otherwise(F.greatest(F.max(F.when(F.col("kind") == "paragraph", F.col("size")).otherwise(0)), F.sum(F.when(F.col("kind") == "line", F.col("size")).otherwise(0))))
    of_paragraphs = of_units.groupBy("doc", "uid", "n_terms", "at").agg(F.max("best").alias("best"), covered.alias("covered"))
    total = F.greatest(F.max(F.when(F.col("at") < 0, F.col("covered")).otherwise(0)), F.sum(F.when(F.col("at") >= 0, F.col("covered")).otherwise(0)))
    found = of_paragraphs.groupBy("doc", "uid").agg(F.max("best").alias("best"), (total / F.first("n_terms")).alias("share"))
    out = stored(found.select("doc", "uid", F.col("best.licence").alias("own_licence"), F.round("best.cosine", 6).alias("own_cosine"), "share"), "own-licences")
    discard(counted, near, outside, wanted, other_df)
    return out


def scan_licences(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """Per row: key, path, own_licence, own_cosine, licence, inherited_from (the directory it comes from)."""
    require(files, (key, path, text))
    rows = files.select(F.struct(F.col(key).alias("key"), F.col(path).alias("path")).alias("row"), *_row_key(key, path, text))
    own = rows.join(own_licences(files, key, path, text), ["doc", "uid"], "left").select("row.key", "row.path", "own_licence", "own_cosine", "share")
    parts = F.split("path", "/")
    depth = F.size(parts)
    directory = F.array_join(F.slice(parts, 1, depth - 1), "/")
    holds = own.filter(F.col("own_licence").isNotNull() & F.col("path").isNotNull() & (F.element_at(parts, -1).rlike(LICENCE_FILE) | (F.col("share") >= 0.5)))
    # One row for each directory, however many licence files it holds.
    directories = holds.groupBy(directory.alias("up")).agg(F.min(F.struct(-F.col("own_cosine"), "path", "own_licence")).alias("best")).select("up", F.col("best.own_licence").alias("of_directory"))
    directories = stored(directories, "licence-directories")
    # Every directory is looked for once, not once for each of its files.
    waiting = own.filter(F.col("own_licence").isNull() & F.col("path").isNotNull()).select(directory.alias("directory")).distinct()
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/")))), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(F.split("directory", "/"), 1, d), "/").alias("up")))
    climbing = waiting.select("directory", F.explode(above).alias("x")).select("directory", "x.depth", "x.up")
    few = directories.count() <= MOST_BROADCAST
    nearest = climbing.join(F.broadcast(directories) if few else directories, "up").groupBy("directory").agg(F.max(F.struct("depth", "up", "of_directory")).alias("near"))
    nearest = stored(nearest.select("directory", F.col("near.of_directory").alias("of_directory"), F.col("near.up").alias("inherited_from")), "nearest-licences")
    open_ = own.withColumn("directory", F.when(F.col("own_licence").isNull(), directory))
    found = open_.join(F.broadcast(nearest) if nearest.count() <= MOST_BROADCAST else nearest, "directory", "left")
    return found.select(F.col("key").alias(key), "path", "own_licence", "own_cosine", F.coalesce("own_licence", "of_directory").alias("licence"), "inherited_from")
