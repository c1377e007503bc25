"""Licence scans, DataFrame functions only: sparse TF-IDF cosine of statements and whole files to templates, then inheritance.

A text is cut into statements (at line ends and after . ; ! ?), as the templates are; whole licence texts are further templates
for whole documents alone. Statements are vectors of term frequency
times inverse document frequency, the latter counted over all documents for the templates' terms; other terms weigh as terms
that no document has. A statement within `least` of a template is a header. A file named like a licence (within
LEAST_NAMED of a template), or whose whole text is within `least_file` of one, is a licence file of its directory. A document without a header takes the licence of
the nearest directory above it that has a licence file.

A statement's licence is that of its best template. Of several headers a licence goes before a family of licences without a
version, and that before a mere reservation of rights, which grants often stand beside; then the score decides.

Defined results: null or empty text has no header; a null path has no directory and inherits nothing; of equal ranks and scores the
licence that sorts first counts; equal rows give equal results; no rows give no rows; further columns don't matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, written

#: Licences of which a statement may name no version.
FAMILIES = {"AGPL": "Affero General Public License", "GPL": "General Public License", "LGPL": "Lesser General Public License"}
RESERVED = "proprietary"
SPDX = ("AGPL-3.0", "Apache-2.0", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0")
#: Statements by which works name their licence, each one statement by the splitter of texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software under the MIT license"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    (RESERVED, "All rights reserved."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    *((family, f"you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation;") for family, kind in FAMILIES.items()),
    *((family, f"it under the terms of the GNU {kind} as published by") for family, kind in FAMILIES.items()),
    *(
        (f"{family}-{v}", f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {FAMILIES[family]} as published by the Free Software Foundation, either version {v.removesuffix('.0')} of the License, or (at your option) any later version.")
        for family, what, v in (("AGPL", "program", "3.0"), ("GPL", "program", "2.0"), ("GPL", "program", "3.0"), ("LGPL", "library", "2.1"), ("LGPL", "library", "3.0"))
    ),
    *((name, f"SPDX-License-Identifier: {name}{more}") for name in SPDX for more in (("", "-only", "-or-later") if "GPL" in name else ("",))),
)
#: Whole licence texts, and notices that files have in their place; they are compared with whole documents alone.
FILES = (
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. "
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. "
        "In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
)
TERM = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
SPLITTER = r"\n|(?<=[.;!?])\s+"
LEAST, LEAST_FILE = 0.8, 0.6
#: What a file that is named like a licence must have in common with a template, at least.
LEAST_NAMED = 0.3
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying)[^/]*$"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f" AS t({names})")


def _templates(spark: SparkSession) -> DataFrame:
    """(template, licence, whole, term, tf): whole templates are those of FILES."""
    rows = _values(spark, [(i, name, text) for i, (name, text) in enumerate((*TEMPLATES, *FILES))], "template, licence, statement").withColumn("whole", F.col("template") >= len(TEMPLATES))
    return rows.select("template", "licence", "whole", F.explode(terms_of(F.col("statement"))).alias("term")).groupBy("template", "licence", "whole", "term").agg(F.count("term").alias("tf"))


def _unseen(n: Column) -> Column:
    return F.log((n + 1).cast("double")) + 1


def _marks(units: list[tuple[int, str, float, float]], least: float) -> list[str]:
    """Terms of which a text has one at least if its cosine to a template is `least` or more; units: (template, term, unit, idf).

    A template's other terms, its commonest ones, weigh less than `least` together, and by Cauchy-Schwarz that bounds the
    cosine of a text without its marks."""
    out = set()
    for template in {t for t, _, _, _ in units}:
        # scores are rounded to 4 digits before they are compared
        left, bound = 0.0, max(0.0, least - 1e-4) ** 2
        for _, term, square in sorted((idf, term, u * u) for t, term, u, idf in units if t == template):
            left += square
            if left >= bound:
                out.add(term)
    return sorted(out)


def _pattern(words: list[str]) -> str:
    """A regular expression of the words, by common beginnings: a text's letters are compared with few alternatives at a time."""
    if words == [""]:
        return ""
    heads = sorted({w[0] for w in words if w})
    rest = [re.escape(h) + _pattern([w[1:] for w in words if w[:1] == h]) for h in heads]
    # the longest word first; what follows a word is looked at by the caller
    return (rest[0] if len(rest) == 1 and "" not in words else f"(?:{'|'.join(rest)})") + ("?" if "" in words else "")


def _holds(words: list[str]) -> str:
    return rf"(?<![a-z0-9]){_pattern(words)}(?![a-z0-9])"


def scanned(docs: DataFrame, path: Column, least: float = LEAST, least_file: float = LEAST_FILE) -> DataFrame:
    """(doc_id, path, licence, how, score) for each row of docs; path may use its columns."""
    spark = docs.sparkSession
    templates = _templates(spark)
    vocabulary = sorted({r["term"] for r in templates.select("term").distinct().collect()})  # of the fixed templates alone
    rows = docs.select("doc_id", path.alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))

    # a pass over the texts: how many rows have each of the templates' terms; the empty term stands for all rows
    held = F.array_intersect(F.array_distinct(terms_of(F.col("text"))), F.array(*map(F.lit, vocabulary)))
    df = written(rows.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("term").alias("df")), "licences-terms")
    n = df.agg(F.coalesce(F.max(F.when(F.col("term") == "", F.col("df"))), F.lit(0)).alias("n_docs"))
    known = templates.select("term").distinct().join(df, "term", "left").join(F.broadcast(n)).select("term", (F.log((F.col("n_docs") + 1).cast("double") / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"))
    weighted = templates.join(known, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("template_norm"))
    weighted = written(weighted.join(norm, "template").select("template", "licence", "whole", "term", (F.col("w") / F.col("template_norm")).alias("unit")), "licences-templates")

    # another pass: only texts and statements that can be near a template
    units = weighted.join(known, "term").select("template", "whole", "term", "unit", "idf").collect()  # of the fixed templates alone
    marked = _holds(_marks([(r["template"], r["term"], r["unit"], r["idf"]) for r in units], min(least, least_file)))
    in_statement = _holds(_marks([(r["template"], r["term"], r["unit"], r["idf"]) for r in units if not r["whole"]], least))
    near = F.lower("text").rlike(marked)
    statements = F.filter(F.transform(F.split("text", SPLITTER, -1), lambda x, i: F.struct(i.alias("pos"), x.alias("statement"))), lambda x: F.lower(x["statement"]).rlike(in_statement))
    named = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    seen = rows.select("doc_id", "path", "text_key", F.when(near | named, statements).alias("statements"), F.when(near | named, F.col("text")).alias("text"))
    seen = written(seen, "licences-seen")

    # pos -1 stands for the whole text
    parts = seen.where(F.col("text").isNotNull()).select("doc_id", "path", "text_key", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.col("text").alias("statement"))), "statements")).alias("s"))
    key = ["doc_id", "path", "text_key", "pos"]
    # equal rows give the same statements: distinct, or their terms would count twice
    parts = parts.select("doc_id", "path", "text_key", "s.pos", "s.statement").dropDuplicates(key)
    tf = parts.select(*key, F.explode(terms_of(F.col("statement"))).alias("term")).groupBy(*key, "term").agg(F.count("term").alias("tf"))
    idf = tf.join(F.broadcast(known), "term", "left").join(F.broadcast(n)).select(*key, "term", (F.col("tf") * F.coalesce("idf", _unseen(F.col("n_docs")))).alias("w"))
    by = F.broadcast(weighted)  # a few hundred rows, whatever the input
    hits = idf.join(by, "term").where("pos < 0 OR NOT whole").groupBy(*key, "template", "licence").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    norms = idf.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    same = [hits[c].eqNullSafe(norms[c]) for c in key]
    scored = hits.join(norms, same).select(*[hits[c] for c in key], "licence", F.round(F.col("dot") / F.col("norm"), 4).alias("score"))
    best = F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), F.col("licence")))
    rank = F.when(F.col("header.licence") == RESERVED, 2).when(F.col("header.licence").isin(*FAMILIES), 1).otherwise(0)
    header = scored.where((F.col("pos") >= 0) & (F.col("score") >= least)).groupBy(*key).agg(best.alias("header"))
    header = header.groupBy("doc_id", "path", "text_key").agg(F.min_by("header", F.struct(rank, -F.col("header.score"), F.col("header.licence"))).alias("header"))
    whole = scored.where((F.col("pos") < 0) & ((F.col("score") >= least_file) | (F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)) & (F.col("score") >= LEAST_NAMED)))).groupBy("doc_id", "path", "text_key").agg(best.alias("file"))

    def joined(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
        return a.join(b, [a[c].eqNullSafe(b[c]) for c in ("doc_id", "path", "text_key")], "left").select(*[a[c] for c in a.columns], value)

    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    found = written(joined(joined(seen.select("doc_id", "path", "text_key"), header, "header"), whole, "file").withColumn("dir", directory), "licences-found")
    owners = found.where(F.col("file").isNotNull() & F.col("dir").isNotNull()).groupBy("dir").agg(F.min_by("file", F.struct(-F.col("file.score"), F.col("file.licence"))).alias("owned"))
    dirs = found.where(F.col("header").isNull() & F.col("file").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("above")))).alias("a"))
    nearest = above.select("dir", "a.*").join(owners.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by("owned", "depth").alias("inherited"))
    out = found.join(nearest, "dir", "left")
    own = F.when(F.col("header").isNotNull(), F.col("header")).when(F.col("file").isNotNull(), F.col("file"))
    inherited = F.when(own.isNull(), F.col("inherited"))
    how = F.when(F.col("header").isNotNull(), "header").when(F.col("file").isNotNull(), "file").when(inherited.isNotNull(), "inherited").otherwise("none")
    taken = F.coalesce(own, inherited)
    return out.select("doc_id", "path", taken["licence"].alias("licence"), how.alias("how"), taken["score"].alias("score"))


def document_path() -> Column:
    """Where a row of documents lies: source, language, the hundred of its doc_id."""
    return F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir), document_path())


def _sql_templates() -> str:
    return ", ".join("({}, '{}', '{}')".format(i, n, s.replace("'", "''")) for i, (n, s) in enumerate((*TEMPLATES, *FILES)))


OP2_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), (doc_id // 100)::VARCHAR, doc_id::VARCHAR || '.txt') AS path FROM documents
), t AS (
  SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, unnest(regexp_extract_all(lower(s), '{TERM}')) AS term FROM (VALUES {_sql_templates()}) v(template, licence, s)) GROUP BY ALL
), n AS (SELECT count(*) AS n FROM docs
), df AS (
  SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM docs) WHERE term IN (SELECT term FROM t) GROUP BY term
), known AS (
  SELECT term, ln((n + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT term FROM t) LEFT JOIN df USING (term), n
), w AS (SELECT template, licence, term, tf * idf AS w FROM t JOIN known USING (term)
), u AS (SELECT template, licence, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS unit FROM w
), parts AS (
  SELECT doc_id, path, -1 AS pos, text AS s FROM docs
  UNION ALL
  SELECT doc_id, path, unnest(range(len(p))) AS pos, unnest(p) AS s
  FROM (SELECT doc_id, path, string_split(regexp_replace(text, '\n|([.;!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM docs)
), tf AS (
  SELECT doc_id, path, pos, term, count(*) AS tf FROM (SELECT doc_id, path, pos, unnest(regexp_extract_all(lower(s), '{TERM}')) AS term FROM parts) GROUP BY ALL
), idf AS (SELECT doc_id, path, pos, term, tf * coalesce(idf, ln((n + 1)::DOUBLE) + 1) AS w FROM tf LEFT JOIN known USING (term), n
), scored AS (
  SELECT h.doc_id, h.path, h.pos, licence, round(dot / norm, 4) AS score
  FROM (SELECT doc_id, path, pos, template, licence, sum(w * unit) AS dot FROM idf JOIN u USING (term) WHERE pos < 0 OR template < {len(TEMPLATES)} GROUP BY ALL) h
  JOIN (SELECT doc_id, pos, sqrt(sum(w * w)) AS norm FROM idf GROUP BY ALL) m ON h.doc_id = m.doc_id AND h.pos = m.pos
), named AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY score DESC, licence) AS k
  FROM scored WHERE (pos >= 0 AND score >= {LEAST}) OR (pos < 0 AND score >= {LEAST_FILE})
), best AS (
  SELECT doc_id, path, pos < 0 AS whole, licence, score,
         row_number() OVER (PARTITION BY doc_id, pos < 0 ORDER BY CASE WHEN licence = '{RESERVED}' THEN 2 WHEN licence IN ({", ".join(f"'{x}'" for x in FAMILIES)}) THEN 1 ELSE 0 END, score DESC, licence) AS k
  FROM named WHERE k = 1
), own AS (
  SELECT d.doc_id, d.path, regexp_extract(d.path, '^(.*)/[^/]*$', 1) AS dir, h.licence AS hl, h.score AS hs, f.licence AS fl, f.score AS fs
  FROM docs d LEFT JOIN best h ON d.doc_id = h.doc_id AND NOT h.whole AND h.k = 1 LEFT JOIN best f ON d.doc_id = f.doc_id AND f.whole AND f.k = 1
), owners AS (
  SELECT dir, fl, fs, row_number() OVER (PARTITION BY dir ORDER BY fs DESC, fl) AS k FROM own WHERE fl IS NOT NULL
), near AS (
  SELECT o.doc_id, a.fl, a.fs, row_number() OVER (PARTITION BY o.doc_id ORDER BY length(a.dir) DESC) AS k
  FROM own o JOIN owners a ON a.k = 1 AND (o.dir = a.dir OR starts_with(o.dir, a.dir || '/')) WHERE o.hl IS NULL AND o.fl IS NULL
)
SELECT own.doc_id, own.path, coalesce(hl, own.fl, near.fl) AS licence, CASE WHEN hl IS NOT NULL THEN 'header' WHEN own.fl IS NOT NULL THEN 'file' WHEN near.fl IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       coalesce(hs, own.fs, near.fs) AS score
FROM own LEFT JOIN near ON own.doc_id = near.doc_id AND near.k = 1
"""
