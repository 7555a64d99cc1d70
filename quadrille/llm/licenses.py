"""License scan: an exact containment join of text blocks with license templates.

Template words are ordered by their frequency in the corpus, rarest first. A block that contains a share of at least
``threshold`` of a template must hold one of its first words (prefix filter); the places of the shared word in both orders
bound the overlap (positional filter) and the number of template words in the block bounds it too (length filter).
What remains is verified on the whole sets. Templates are a fixed list, so their index is small whatever the corpus.

Blocks are lines, and overlapping windows of words across lines for notices that are wrapped: for each template, windows of
twice its words, a template's words apart, so that a notice lies in one of them wherever it begins. Only windows that hold a
word of the template's prefix are looked at (prefix filter), in texts that hold enough of its words (length filter).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import text_of

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The templates, as their usual short notices, and the public full ones.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "apache-2.0-full": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "gpl-full": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
THRESHOLD = 0.8
#: What parts words: every ASCII character but digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


#: Upper case is A to Z here: other letters are told apart by their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, with A to Z in lower case, and empty strings where it begins or ends with a break."""
    return F.split(F.translate(text, UPPER, LOWER), BREAK + "+")


def words_in(text: str) -> list[str]:
    """Distinct words of a template, in order."""
    return list(dict.fromkeys(re.findall(WORD + "+", text.lower())))


VOCABULARY = sorted({w for t in TEMPLATES.values() for w in words_in(t)})
#: All phrases in one pattern; they cannot overlap, as the last word of each is the first of none.
PHRASE = f"(?<!{WORD})(?i:" + "|".join(f"{BREAK}+".join(p.split()) for p in PHRASES) + f")(?!{WORD})"


def n_words(text: Column) -> Column:
    """The number of words."""
    return F.size(F.array_remove(F.split(text, BREAK + "+"), "")).cast("long")


def known_words(text: Column) -> Column:
    """The distinct template words in a text."""
    return F.array_intersect(words_of(text), F.split(F.lit(" ".join(VOCABULARY)), " "))


def base_columns(text: Column) -> dict[str, Column]:
    """Whether and where phrases stand. A word's number is the count of words before it."""
    has = text.rlike(PHRASE)
    before = F.element_at(F.split(text, PHRASE, 2), 1)
    tail = F.element_at(F.split(text, PHRASE, -1), -1)
    last = F.element_at(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0)), -1)
    label = lambda p, name: F.when(text.rlike(f"(?<!{WORD})(?i:{f'{BREAK}+'.join(p.split())})(?!{WORD})"), name)
    return {
        "n_words": n_words(text),
        "n_base": F.when(has, F.size(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0)))).otherwise(0).cast("long"),
        "first_word": F.when(has, n_words(before)),
        "last_word": F.when(has, n_words(text) - n_words(tail) - n_words(last)),
        "base_list": F.when(has, F.array_compact(F.array(*(label(p, name) for p, name in PHRASES.items())))).otherwise(F.array().cast("array<string>")),
    }


def word_order(docs: DataFrame) -> list[str]:
    """Template words, the rarest in the corpus first (documents that hold them; ties by the word). One number per template word returns."""
    counts = {r["w"]: r["n"] for r in docs.select(F.explode(known_words(text_of(docs))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(VOCABULARY, key=lambda w: (counts.get(w, 0), w))


def prefix_index(order: list[str], threshold: float) -> list[tuple[str, str, int, int, int]]:
    """(word, template, place, words, least overlap) of each template's prefix. A containing block misses at most words - least of them."""
    rank, out = {w: i for i, w in enumerate(order)}, []
    for name, text in TEMPLATES.items():
        words = sorted(words_in(text), key=rank.__getitem__)
        least = math.ceil(threshold * len(words) - 1e-9)
        out += [(w, name, place, len(words), least) for place, w in enumerate(words[: len(words) - least + 1])]
    return out


def block_matches(docs: DataFrame, threshold: float = THRESHOLD, order: list[str] | None = None) -> DataFrame:
    """Every (row, line, template) whose line contains at least ``threshold`` of the template's words, with the containment."""
    spark, order = docs.sparkSession, order or word_order(docs)
    index_rows = prefix_index(order, threshold)
    values = ", ".join(f"('{w}', '{name}', {place}, {size}, {least})" for w, name, place, size, least in index_rows)
    index = spark.sql(f"SELECT * FROM VALUES {values} AS t(word, template, place, size, least)")
    whole = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{name}', split('{' '.join(words_in(t))}', ' '))" for name, t in TEMPLATES.items()) + " AS t(template, template_words)")
    rare = "|".join(sorted({w for w, *_ in index_rows}))
    text = text_of(docs)
    lines = (
        docs.filter(text.rlike(f"(?i)(?<!{WORD})(?:{rare})(?!{WORD})"))
        .select("doc_id", F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n")).alias("line", "block"))
        .withColumn("held", known_words(F.col("block")))
        .filter(F.size("held") > 0)
        .select("doc_id", "text_key", "line", F.array_sort(F.transform("held", lambda w: F.array_position(F.split(F.lit(" ".join(order)), " "), w))).alias("ranks"), "held")
    )
    tokens = lines.select("*", F.posexplode("ranks").alias("at", "rank")).withColumn("word", F.element_at(F.split(F.lit(" ".join(order)), " "), F.col("rank").cast("int")))
    near = tokens.join(F.broadcast(index), "word").filter((F.size("held") >= F.col("least")) & (1 + F.least(F.size("held") - F.col("at") - 1, F.col("size") - F.col("place") - 1) + F.least(F.col("at"), F.col("place")) >= F.col("least")))
    pairs = near.select("doc_id", "text_key", "line", "template", "size", "least", "held").join(F.broadcast(whole), "template")
    overlap = F.size(F.array_intersect("held", "template_words"))
    return pairs.filter(overlap >= F.col("least")).select("doc_id", "text_key", "line", "template", (overlap / F.col("size")).alias("containment")).distinct()


def most_in_window(n: int, own: Column, prefix: list[str]) -> Column:
    """The most distinct words of a template of n words in any window of ``words`` that holds a word of its prefix; ``rare`` has the prefix words of all templates and where they stand. Null where there is none."""
    place = lambda h: F.floor(h["at"] / n).cast("int")
    windows = F.array_distinct(F.flatten(F.transform(F.filter("rare", lambda h: h["word"].isin(prefix)), lambda h: F.array(place(h), F.greatest(place(h) - 1, F.lit(0))))))
    return F.array_max(F.transform(windows, lambda k: F.size(F.array_intersect(F.slice("words", k * n + 1, F.lit(2 * n)), own))))


def wrapped_matches(docs: DataFrame, threshold: float = THRESHOLD, order: list[str] | None = None) -> DataFrame:
    """Every (row, template) of which a window of words, whatever its lines, contains at least ``threshold`` of the template's words, with the containment."""
    text, cells, first = text_of(docs), [], {}
    for word, name, *_ in prefix_index(order or word_order(docs), threshold):
        first.setdefault(name, []).append(word)
    held = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("block"))
    for name, template in TEMPLATES.items():
        known, n = words_in(template), len(re.findall(WORD + "+", template))
        least, own = math.ceil(threshold * len(known) - 1e-9), F.split(F.lit(" ".join(known)), " ")
        most = most_in_window(n, own, first[name])
        cells.append((name, own, F.when(F.array_contains("fits", name), most), least, len(known)))
    # The words are bound once in a lambda: a filter that is pushed down would else take them from the text again for each template.
    fitting = lambda h: F.array_compact(F.array(*(F.when(F.size(F.array_intersect(h, own)) >= least, F.lit(name)) for name, own, _, least, _ in cells)))
    fits = F.get(F.transform(F.array(known_words(F.col("block"))), fitting), 0)
    near = held.withColumn("fits", fits).filter(F.size("fits") > 0).withColumn("words", F.array_remove(words_of(F.col("block")), ""))
    any_prefix = sorted({w for words in first.values() for w in words})
    near = near.withColumn("rare", F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: h["word"].isin(any_prefix)))
    each = F.array(*(F.struct(F.lit(name).alias("template"), most.alias("most"), F.lit(least).alias("least"), F.lit(size).alias("size")) for name, _, most, least, size in cells))
    return near.select("doc_id", "text_key", F.explode(each).alias("x")).filter("x.most >= x.least").select("doc_id", "text_key", "x.template", (F.col("x.most") / F.col("x.size")).alias("containment"))


def label_of(template: Column) -> Column:
    """Templates of a phrase's license share its label."""
    return F.when(template.startswith("mit"), "mit").when(template.startswith("apache"), "apache").when(template.startswith("gpl"), "gpl").otherwise(template)


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Labels of every row. Null and empty texts have no words and no labels; equal rows get equal answers; only narrow rows are shuffled."""
    text = text_of(docs)
    base = docs.select("doc_id", F.xxhash64(text).alias("text_key"), *(c.alias(k) for k, c in base_columns(text).items()))
    order = word_order(docs)
    matched = block_matches(docs, threshold, order).drop("line").union(wrapped_matches(docs, threshold, order))
    found = matched.groupBy("doc_id", "text_key").agg(F.collect_set(label_of(F.col("template"))).alias("more"), F.max("containment").alias("best"))
    found = found.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    both = base.join(found, base["doc_id"].eqNullSafe(found["__id"]) & (base["text_key"] == found["__key"]), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    score = F.when(F.size("base_list") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_list"), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base_list", more)), ",").alias("labels"), score.alias("score"))
