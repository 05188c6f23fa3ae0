"""Licence scans: sparse TF-IDF cosine of notices and licence files to templates, then inheritance down directories.

Everything is a DataFrame or SQL function. Distinct notices are scored once each, against a table of the templates' terms
that has a fixed size; directories are resolved once each and joined to their files.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import cut_lineage

# Short forms of licence notices, several for a licence where headers differ.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following two conditions are met. Licensed under the BSD 2-Clause license"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause license. Neither the name of the copyright holder nor the names of its contributors may be used"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. ISC License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. The Unlicense"),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."),
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_END = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {1} Public License as published by the Free Software Foundation, {0}, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {1} Public License for more details. You should have received a copy of the {1} Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
#: Full texts, which score beside the templates but give no weights to terms: the SQL's weights are those of the templates.
TEXTS = (
    ("MIT", f"MIT License Copyright (c) {_MIT} {_MIT_END}"),
    ("MIT", _MIT),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", f"{_GNU.format('either version 3 of the License', 'GNU General')}"),
    ("GPL-2.0", f"{_GNU.format('either version 2 of the License', 'GNU General')}"),
    ("LGPL-3.0", f"{_GNU.format('either version 3 of the License', 'GNU Lesser General')}"),
    ("AGPL-3.0", f"{_GNU.format('either version 3 of the License', 'GNU Affero General')}"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
CUES = ("licen", "copyright", "rights reserved", "spdx", "public domain", "hereby granted", "apache", "gnu ")
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)^(?:licen[cs]e|copying|notice|unlicense)(?:[._-].*)?$"
#: The least cosine of a match.
THRESHOLD = 0.6
#: What starts a line of a comment, and blocks of adjacent comment lines or of one bracketed comment.
MARK = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--)?[ \t]*|[ \t]*(?:\*+/|-->)[ \t]*$|\r$"
COMMENT = r"(?m)(/\*(?s:.*?)\*/|<!--(?s:.*?)-->|(?:^[ \t]*(?://|#|--|;|%|\*)[^\n]*(?:\n|\z))+)"
#: Words that any text may have: as many of a template's as together can't reach the threshold are no reason to score.
COMMON = "the of a to and in for is it that be with or as by this from you at on are not may can all any will has have one out use under other no but was if which its work see name person"


def weights() -> tuple[dict[str, float], list[dict[str, float]]]:
    """Inverse document frequencies over the templates, and each template's unit vector of (1 + ln tf) * idf."""
    counts = [Counter(re.findall(TERM, text.lower())) for _, text in TEMPLATES]
    n = len(counts)
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in sorted(df.items())}
    vectors = []
    for c in counts:
        v = {t: (1 + math.log(k)) * idf[t] for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / norm for t, x in v.items()})
    return idf, vectors


def unknown_idf() -> float:
    """A term of no template weighs as one that a single template would have."""
    return math.log((1 + len(TEMPLATES)) / 2) + 1


def all_vectors() -> list[tuple[str, dict[str, float]]]:
    """(licence, unit vector) of the templates, then of the full texts, in the templates' weights of terms."""
    idf, vectors = weights()
    out = [(name, v) for (name, _), v in zip(TEMPLATES, vectors, strict=True)]
    for name, text in TEXTS:
        v = {t: (1 + math.log(k)) * idf.get(t, unknown_idf()) for t, k in Counter(re.findall(TERM, text.lower())).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append((name, {t: x / norm for t, x in v.items()}))
    return out


def telling_terms() -> list[str]:
    """Terms one of which every passage has that reaches the threshold.

    A cosine is at most the root of the shared terms' squared weights, and those left out of each template sum to less than
    the threshold's square: common words first, then the lightest.
    """
    common, telling = set(COMMON.split()), set()
    for _, v in all_vectors():
        left = THRESHOLD**2 - 1e-5  # scores are rounded to 6 digits
        for t in sorted(v, key=lambda t: (t not in common, v[t], t)):
            left -= v[t] ** 2
            if left <= 0:
                telling.add(t)
    return sorted(telling)


def possible(passages: Column) -> Column:
    """Passages whose terms of any template have at least that part of their length that the threshold needs.

    A cosine is at most the length of a passage's part in the templates' terms, as a part of its whole length; other terms
    count as if they stood there once.
    """
    idf = weights()[0]
    idf = {t: idf.get(t, unknown_idf()) for t in sorted({t for _, v in all_vectors() for t in v})}
    known, weigh = F.array(*map(F.lit, idf)), F.map_from_arrays(F.array(*map(F.lit, idf)), F.array(*map(F.lit, idf.values())))
    split = F.transform(passages, lambda b: F.struct(b.alias("b"), F.regexp_extract_all(F.lower(b), F.lit(f"({TERM})"), F.lit(1)).alias("w")))
    split = F.transform(split, lambda x: F.struct(x["b"].alias("b"), x["w"].alias("w"), F.array_distinct(x["w"]).alias("d"), F.array_intersect(x["w"], known).alias("m")))
    part = lambda x: F.aggregate(x["m"], F.lit(0.0), lambda a, t: a + F.pow((1 + F.log(F.size(F.filter(x["w"], lambda y: y == t)).cast("double"))) * weigh[t], F.lit(2.0)))
    least = (THRESHOLD - 1e-5) ** 2
    near = F.filter(split, lambda x: part(x) * (1 - least) >= least * unknown_idf() ** 2 * (F.size(x["d"]) - F.size(x["m"])))
    return F.transform(near, lambda x: x["b"])


def blocks(text: Column) -> Column:
    """Headers without their comment marks: paragraphs, and blocks of comments, of more than one line, that can be near a template."""
    some = r"(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in telling_terms()) + r")(?![a-z0-9])"
    plain = lambda t: F.regexp_replace(t, MARK, "")
    whole = F.filter(F.concat(F.split(plain(text), r"\n\s*\n"), F.transform(F.regexp_extract_all(text, F.lit(COMMENT), F.lit(1)), plain)), lambda b: F.contains(F.trim(b), F.lit("\n")) & b.rlike(some))
    return F.when(F.contains(text, F.lit("\n")) & text.rlike(some), F.array_distinct(possible(whole))).otherwise(F.array().cast("array<string>"))


def has_cue(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(F.greatest(*(F.contains(low, F.lit(c)) for c in CUES)), F.lit(False))


def notices(text: Column, is_file: Column) -> Column:
    """Passages to score: each line of a text with a cue of licences; of a licence file, the whole text before them."""
    none = F.array().cast("array<string>")
    lines = F.when(has_cue(text), F.filter(F.split(text, "\n"), has_cue)).otherwise(none)
    return F.when(text.isNull(), none).when(is_file, F.concat(F.array(text), lines)).otherwise(lines)


def score_notices(found: DataFrame) -> DataFrame:
    """(h, score, license) for each distinct notice h of (h, notice): the nearest template, the first among equals.

    A sparse product: the notice's terms meet the templates' terms, a table of fixed size, and are summed per notice.
    """
    spark = found.sparkSession
    idf, _ = weights()
    names, vectors = zip(*all_vectors(), strict=True)
    idf |= {t: unknown_idf() for v in vectors for t in v if t not in idf}
    literal = F.from_json(F.lit(json.dumps([{"term": t, "idf": w, "w": [v.get(t, 0.0) for v in vectors]} for t, w in idf.items()])), "array<struct<term:string,idf:double,w:array<double>>>")
    known = spark.range(1).select(F.inline(literal))
    terms = found.select("h", F.explode(F.regexp_extract_all(F.lower("notice"), F.lit(f"({TERM})"), F.lit(1))).alias("term"))
    counted = terms.groupBy("h", "term").agg((1 + F.log(F.count("*").cast("double"))).alias("tf"))
    weighed = counted.join(F.broadcast(known), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unknown_idf())))
    sums = [F.sum(F.coalesce(F.col("x") * F.col("w")[k], F.lit(0.0))).alias(f"s{k}") for k in range(len(vectors))]
    dots = weighed.groupBy("h").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *sums)
    total = F.array(*(F.round(F.col(f"s{k}") / F.col("norm"), 6) for k in range(len(vectors))))
    names = F.array(*map(F.lit, names))
    top = dots.select("h", total.alias("t")).withColumn("score", F.array_max("t"))
    return top.select("h", "score", F.element_at(names, F.array_position("t", F.col("score")).cast("int")).alias("license"))


def scan(files: DataFrame, path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Columns of files but the text, with n_notices, own_license and own_score: the best match of its notices, if near enough.

    Besides notices, which n_notices counts as its SQL does, blocks of lines are scored, so that wrapped headers are found.

    A notice that stands in many files is scored once. A null or empty text has no notices. Equal scores go to the first
    notice, and in it to the first template. Repeated rows, and rows without a path, are kept and judged by their text.
    """
    name = F.element_at(F.split(F.col(path), "/"), -1)
    is_file = F.coalesce(name.rlike(LICENCE_FILE), F.lit(False))
    kept = [c for c in files.columns if c not in (text, "n_notices", "own_license", "own_score")]
    # The files' own columns travel in a struct, so that no name of theirs can clash.
    rows = files.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), notices(F.col(text), is_file).alias("lines"), F.coalesce(blocks(F.col(text)), F.array().cast("array<string>")).alias("blocks"))
    rows = cut_lineage(rows.select("row", F.size("lines").cast("long").alias("n_notices"), F.concat("lines", "blocks").alias("passages")))  # so that texts are scanned once
    rows = rows.withColumn("key", F.when(F.size("passages") > 0, F.sha2(F.concat_ws("\n", "passages"), 256)))
    some = rows.where("key is not null").groupBy("key").agg(F.first("passages").alias("passages"))  # equal keys have equal notices
    each = some.select("key", F.posexplode("passages").alias("pos", "notice")).withColumn("h", F.sha2("notice", 256))
    scored = score_notices(each.groupBy("h").agg(F.first("notice").alias("notice"))).where(F.col("score") >= threshold)
    best = each.select("key", "pos", "h").join(scored, "h").groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "pos", "license")).alias("best"))
    out = rows.where("key is not null").drop("passages").join(best, "key", "left")
    out = out.select("row", "n_notices", F.col("best.license").alias("own_license"), (-F.col("best.s")).alias("own_score"))
    rest = rows.where("key is null").select("row", "n_notices", F.lit(None).cast("string").alias("own_license"), F.lit(None).cast("double").alias("own_score"))
    return out.unionByName(rest).select("row.*", "n_notices", "own_license", "own_score")  # files without a notice, mostly all, need no shuffle


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def inherit(scanned: DataFrame, path: str = "path") -> DataFrame:
    """scanned with license, origin ('own', 'inherited', 'none') and license_dir.

    A file without a licence of its own takes that of the nearest directory at or above its own that has a licence file with
    one; of several there, the best score, then the least path. Directories are resolved once each, by a join of their
    ancestors to those that have a licence, then joined to their files in a join that can be split.
    """
    kept = [c for c in scanned.columns if c not in ("license", "origin", "license_dir")]
    name = F.element_at(F.split(F.col(path), "/"), -1)
    here = scanned.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "own_license", "own_score", F.col(path).alias("path"), name.alias("name"), parent(F.col(path)).alias("dir"))
    here = cut_lineage(here)  # so that the texts are scanned once
    owners = here.where(F.col("name").rlike(LICENCE_FILE) & F.col("own_license").isNotNull())
    owners = owners.groupBy(F.col("dir").alias("owner")).agg(F.min(F.struct(-F.col("own_score"), "path", F.col("own_license").alias("l")))["l"].alias("l"))
    dirs = here.where("own_license is null and dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    near = dirs.select("dir", F.posexplode(above).alias("depth", "owner")).join(owners, "owner")
    near = near.groupBy("dir").agg(F.max_by(F.struct("l", "owner"), "depth").alias("found"))
    # One row per directory, written, so that the join below has a shuffle of its own on each side, whose large directories adaptive execution splits.
    near = cut_lineage(near)
    own = F.col("own_license").isNotNull()
    needy = here.where(~own).join(near, "dir", "left")
    needy = needy.select("row", F.col("found.l").alias("license"), F.when(F.col("found").isNotNull(), "inherited").otherwise("none").alias("origin"), F.col("found.owner").alias("license_dir"))
    with_own = here.where(own).select("row", F.col("own_license").alias("license"), F.lit("own").alias("origin"), F.lit(None).cast("string").alias("license_dir"))
    return with_own.unionByName(needy).select("row.*", "license", "origin", "license_dir")


def document_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text): documents in a tree of directories by source, language, ten thousands and hundreds of ids.

    Documents have no paths. One that ends with a notice stands as a licence file, of a directory of one of the three lower
    levels by its id, so that licences stand above the files that inherit them.
    """
    ends = F.coalesce(has_cue(F.substring_index("text", "\n", -1)), F.lit(False))
    part = lambda c: F.coalesce(F.regexp_replace(c, "/", "_"), F.lit("-"))
    levels = [F.concat(F.lit("/"), part("source")), F.concat(F.lit("/"), part("lang")), F.concat(F.lit("/"), F.floor(F.col("doc_id") / 10000).cast("string")), F.concat(F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"))]
    folder = lambda depth: F.concat(*levels[:depth])
    level = F.pmod("doc_id", F.lit(3))
    at = F.when(ends & (level == 0), folder(2)).when(ends & (level == 1), folder(3)).otherwise(folder(4))
    path = F.concat(at, F.when(ends, F.lit("/LICENSE.")).otherwise(F.lit("/")), F.col("doc_id").cast("string"))
    return docs.select("doc_id", path.alias("path"), "text")


def oracle_sql() -> str:
    """DuckDB SQL for the rows of inherit(scan(document_paths(documents)))."""
    idf, vectors = weights()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(t)}, {k}, {quote(TEMPLATES[k][0])}, {w!r}::DOUBLE)" for k, v in enumerate(vectors) for t, w in v.items())
    idfs = ", ".join(f"({quote(t)}, {w!r}::DOUBLE)" for t, w in idf.items())
    cue = lambda c: "(" + " OR ".join(f"contains(lower({c}), {quote(x)})" for x in CUES) + ")"
    return f"""
    WITH template(term, k, license, w) AS (VALUES {rows}), idf(term, idf) AS (VALUES {idfs}),
    d AS (SELECT doc_id, '/' || coalesce(replace(source, '/', '_'), '-') || '/' || coalesce(replace(lang, '/', '_'), '-') AS top, '/' || CAST(floor(doc_id / 10000) AS BIGINT) AS mid, '/' || CAST(floor(doc_id / 100) AS BIGINT) AS low, text,
            coalesce({cue("split_part(text, chr(10), -1)")}, false) AS ends FROM documents),
    g AS (SELECT doc_id, CASE WHEN ends AND doc_id % 3 = 0 THEN top WHEN ends AND doc_id % 3 = 1 THEN top || mid ELSE top || mid || low END AS dir, ends, text FROM d),
    f AS (SELECT doc_id, dir, dir || CASE WHEN ends THEN '/LICENSE.' ELSE '/' END || doc_id AS path, ends, text FROM g),
    n AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: {cue("x")}) AS lines, ends, text FROM f WHERE text IS NOT NULL),
    passages AS (SELECT doc_id, CASE WHEN ends THEN list_concat([text], lines) ELSE lines END AS p FROM n),
    each AS (SELECT doc_id, unnest(p) AS passage, generate_subscripts(p, 1) AS pos FROM passages),
    terms AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(passage), '{TERM}')) AS term FROM each),
    tf AS (SELECT doc_id, pos, term, 1 + ln(count(*)) AS tf FROM terms GROUP BY ALL),
    x AS (SELECT doc_id, pos, tf.term, tf * coalesce(idf.idf, {unknown_idf()!r}::DOUBLE) AS x FROM tf LEFT JOIN idf USING (term)),
    norm AS (SELECT doc_id, pos, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
    score AS (SELECT x.doc_id, x.pos, k, license, round(sum(x * w) / any_value(norm), 6) AS score FROM x JOIN norm USING (doc_id, pos) JOIN template USING (term) GROUP BY x.doc_id, x.pos, k, license),
    best AS (SELECT doc_id, license AS own_license, score AS own_score FROM score WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, k) = 1),
    s AS (SELECT f.doc_id, dir, path, ends, coalesce(len(p), 0)::BIGINT AS n_notices, own_license, own_score FROM f LEFT JOIN passages USING (doc_id) LEFT JOIN best USING (doc_id)),
    owners AS (SELECT dir AS owner, own_license AS l FROM s WHERE ends AND own_license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path) = 1),
    near AS (SELECT dir, owner, l FROM (SELECT DISTINCT dir FROM s WHERE own_license IS NULL) x JOIN owners ON dir = owner OR starts_with(dir, owner || '/') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(owner) DESC) = 1)
    SELECT doc_id, path, n_notices, own_license, own_score, coalesce(own_license, l) AS license,
           CASE WHEN own_license IS NOT NULL THEN 'own' WHEN l IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
           CASE WHEN own_license IS NULL THEN owner END AS license_dir
    FROM s LEFT JOIN near USING (dir)
    """
