"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

Templates are notices or whole license bodies. A template of W words is sought in blocks of B consecutive words, a new one every half
block, where B is the least of block_words, 2 * block_words, 4 * block_words and so on with W <= B / 2 + 1: a notice of that length lies
whole in a block wherever it stands. A block meets a template if it holds at least `threshold` of the template's distinct words.
Words are ordered by how often the corpus has them, rarest first. Of a template of s words, of which n = ceil(threshold * s) must be in the block, only the s - n + 1
rarest are looked up (prefix filter): a block with none of them can't hold n. Blocks of fewer than n words are passed over (length
filter), and so is a pair whose first shared word leaves too few words behind it, in the template or in the block, to reach n
(positional filter). What is left is counted exactly.

Style: native. Templates are constants, at most MOST_TEMPLATES, so broadcasting them is bounded; texts never leave their
partitions but for those few that share a rare word with a template.
"""

from __future__ import annotations

import math
import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Phrases that name a license outright, and the label of each.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices by which licenses are usually granted and bodies of licenses, and the label of each.
TEMPLATES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction", "mit"),
    ("Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License", "apache"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS "
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER "
        "OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "bsd",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN "
        "NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "isc",
    ),
    (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be "
        "removed or altered from any source distribution.",
        "zlib",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any "
        "and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
        "unlicense",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License. Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
        "the License for the specific language governing permissions and limitations under the License.",
        "apache",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this "
        "program.",
        "gpl",
    ),
)
MOST_TEMPLATES = 1000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text: str = "text") -> Column:
    """The words, once A-Z, and no others, are lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), ascii_uppercase, ascii_lowercase), _GAP), "")


def _all_words(text: str) -> list[str]:
    return [w for w in re.split(_GAP, text.translate(str.maketrans(ascii_uppercase, ascii_lowercase))) if w]


def _template_words(text: str) -> list[str]:
    return sorted(set(_all_words(text)))


def block_size(text: str, block_words: int = 64) -> int:
    """The words of the blocks in which a template is sought: block_words, doubled until a notice of its length lies whole in one."""
    while len(_all_words(text)) > block_words // 2 + 1:
        block_words *= 2
    return block_words


def word_ranks(docs: DataFrame, words: list[str], text: str = "text") -> dict[str, int]:
    """The words, rarest in the corpus first, then by spelling. One count for each word comes to the driver."""
    counts = docs.select(F.explode(license_words(text)).alias("w")).where(F.col("w").isin(words)).groupBy("w").count()
    found = {r["w"]: r["count"] for r in counts.collect()}
    return {w: i for i, w in enumerate(sorted(words, key=lambda w: (found.get(w, 0), w)))}


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()

    def here(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for j, p in enumerate(parts[1:], 1):
            test = test & (F.get(words, i + j) == p)
        return test

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.coalesce(here(i), F.lit(False)))


def _labelled(label: str):
    return lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("word"))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.8, block_words: int = 64) -> DataFrame:
    """key, n_words, places (of phrases: label and word, from 0), found (label, start, words and score of met templates) for each row.

    start is the first word of a block, from 0, words its size. Null and empty texts have no words and nothing in them. Rows alike in key
    and text have the same result each; null keys are keys like others. Texts may be of any length; an empty table gives an empty result. Other columns are left out, whatever their names. Templates may be of any length;
    block_words is even.
    """
    spark = docs.sparkSession
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    if block_words < 2 or block_words % 2:
        raise ValueError("block_words must be even")
    sets = [(i, label, _template_words(t), block_size(t, block_words)) for i, (t, label) in enumerate(templates)]
    ranks = word_ranks(docs, sorted({w for _, _, s, _ in sets for w in s}), text)
    need = {i: math.ceil(threshold * len(s) - 1e-9) for i, _, s, _ in sets}
    ordered = {i: sorted(ranks[w] for w in s) for i, _, s, _ in sets}
    prefix = {i: o[: len(o) - need[i] + 1] for i, o in ordered.items()}
    by_rank = {r: w for w, r in ranks.items()}

    words = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(key), F.col(text)).alias("r"), license_words(text).alias("w"))
    openers = F.array(*(F.lit(p.split()[0]) for p, _ in phrases))
    places = F.flatten(F.array(*(F.transform(_places(F.col("w"), p), _labelled(label)) for p, label in phrases)))
    none = F.array().cast("array<struct<label:string,word:bigint>>")
    # for texts with a rare word of a template: the start of each block, its distinct words, and ranks of those that templates of its size have
    shape = "array<struct<wide:int,start:bigint,size:int,ranks:array<int>>>"

    def blocks_of(wide: int) -> Column:
        half, these = wide // 2, [i for i, _, _, size in sets if size == wide]
        rare = sorted({by_rank[r] for i in these for r in prefix[i]})
        own_ranks = sorted({r for i in these for r in ordered[i]})
        lookup = F.create_map(*(F.lit(x) for r in own_ranks for x in (by_rank[r], r)))
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("w") - half - 1) / half).cast("int")))

        def block(i: Column) -> Column:
            own = F.slice("w", i * half + 1, wide)
            known = F.array_intersect(own, F.array(*(F.lit(by_rank[r]) for r in own_ranks)))
            return F.struct(F.lit(wide).alias("wide"), (i * half).cast("long").alias("start"), F.size(F.array_distinct(own)).alias("size"), F.sort_array(F.transform(known, lambda w: lookup[w])).alias("ranks"))

        hot = F.arrays_overlap("w", F.array(*map(F.lit, rare)))
        return F.when(hot, F.transform(starts, block)).otherwise(F.array().cast(shape)).cast(shape)

    sizes = sorted({size for *_, size in sets})
    every = F.concat(*map(blocks_of, sizes)) if sizes else F.array().cast(shape)
    first = words.select(
        "k", "r", F.size("w").cast("long").alias("n_words"),
        F.when(F.arrays_overlap("w", openers), places).otherwise(none).alias("places"),
        every.alias("blocks"),
    )
    first = written(first, "blocks")

    rows = [(size, r, i, label, at, len(s), need[i], ordered[i]) for i, label, s, size in sets for at, r in enumerate(prefix[i])]
    sought = spark.createDataFrame(rows, "wide int, rank int, template int, label string, at int, size int, need int, words array<int>")
    blocks = first.where(F.size("blocks") > 0).select("k", "r", F.explode("blocks").alias("b")).select("k", "r", "b.wide", "b.start", F.col("b.size").alias("own"), F.col("b.ranks").alias("ranks"))
    spread = blocks.select("*", F.posexplode("ranks").alias("place", "rank"))
    met = spread.join(F.broadcast(sought), ["wide", "rank"])
    met = met.where((F.col("own") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("at") - 1, F.size("ranks") - F.col("place") - 1) >= F.col("need") - F.col("at")))
    shared = F.size(F.array_intersect("ranks", "words"))
    met = met.where(shared >= F.col("need")).select("k", "r", "label", "start", F.col("wide").alias("words"), (shared / F.col("size")).alias("score")).distinct()
    found = met.groupBy(F.col("k").alias("k2"), F.col("r").alias("r2")).agg(F.sort_array(F.collect_list(F.struct("label", "start", "words", "score"))).alias("found"))
    both = first.drop("blocks").join(found, (F.col("r") == F.col("r2")) & F.col("k").eqNullSafe(F.col("k2")), "left")
    nothing = F.array().cast("array<struct<label:string,start:bigint,words:int,score:double>>")
    return both.select(F.col("k").alias(key), "n_words", "places", F.coalesce("found", nothing).alias("found"))
