"""License scans by an exact set-similarity join of text blocks with templates.

Only DataFrame functions. A text is cut into words once for its blocks; those
that hold enough template words are stored. The words of all templates are
ordered by the number of such blocks that hold them, rarest first. A block whose words contain the
threshold's share of a template's must share a word with it among the first few
of both in that order (prefix filter), hold enough template words at all (length
filter), and have enough of them left behind the shared word on both sides
(positional filter). Pairs that are left are compared whole.

Blocks are windows of words that overlap by half, at least twice as long as the
template they are for, so that a text of a template's length lies whole in one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from rulesieve.llm.common import stored

#: Phrases and the labels they stand for.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Public notices by which licenses ask to be named.
TEMPLATES = (
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
    ),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License.",
    ),
    (
        "bsd-3",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
)

THRESHOLD = 0.8
#: What stands between words, in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; null counts as empty.

    ``lower`` changes other letters as well, but only the Kelvin sign becomes an
    ASCII letter; with that set apart, no word is cut or made equal otherwise.
    Splitting takes a seventh of the time of extracting the same words.
    """
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def plain_words(text: str) -> list[str]:
    """The words of a phrase or template in ASCII."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts of a phrase among ``words``, ascending."""
    found = F.filter(
        F.sequence(F.lit(0), F.size(words) - len(phrase)),
        lambda at: _all(F.get(words, at + i) == F.lit(word) for i, word in enumerate(phrase)),
    )
    possible = (F.size(words) >= len(phrase)) & _all(F.array_contains(words, w) for w in sorted(set(phrase), key=len))
    return F.when(possible, found).otherwise(F.array().cast("array<int>"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def template_parameters(templates: Sequence[tuple[str, str]], threshold: float) -> list[dict]:
    """Per template its number, label, distinct words, how many of them are needed, and its window."""
    out = []
    for number, (label, text) in enumerate(templates):
        words = plain_words(text)
        distinct = sorted(set(words))
        if distinct:
            window = 1 << (2 * len(words) - 1).bit_length()
            out.append(dict(number=number, label=label, words=distinct, need=ceil(threshold * len(distinct) - 1e-9), window=window))
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, h1, h2, words)``: rows with equal id and text have equal results."""
    text = docs[text_col].cast("string")
    out = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), text.alias("text"))
    return out.select("id", "h1", "h2", words_of(F.col("text")).alias("words"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``; the value is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_order(blocks: DataFrame, vocabulary: Sequence[str]) -> list[str]:
    """``vocabulary`` by the number of rows of ``blocks`` that hold a word, rarest first, ties by word.

    Words are counted in Spark; the driver gets one row per word of the templates at most.
    """
    held = blocks.select(F.explode("held").alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _full_blocks(words: Column, chosen: list[dict]) -> Column:
    """The blocks of a text that hold enough words for some template, as structs ``(window, start, least, held)``."""

    def of_window(words: Column, held: Column, window: int) -> Column:
        """Windows of a text are looked at where the whole text holds enough of a template that needs them."""
        own, half = [t for t in chosen if t["window"] == window], window // 2
        least = min(t["need"] for t in own)
        enough = _any(
            (F.size(held) >= t["need"]) & (F.size(F.array_intersect(held, _strings(t["words"]))) >= t["need"]) for t in own
        )
        last = F.greatest(F.lit(0), F.floor((F.size(words) + (half - 1)) / half).cast("int") - 2)
        blocks = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                F.lit(window).alias("window"),
                (i * half).alias("start"),
                F.lit(least).alias("least"),
                F.array_intersect(held, F.slice(words, i * half + 1, F.lit(window))).alias("held"),
            ),
        )
        return F.when(enough, F.filter(blocks, lambda b: F.size(b["held"]) >= least)).otherwise(none)

    none = F.array().cast("array<struct<window:int,start:int,least:int,held:array<string>>>")
    vocabulary = _strings(sorted({w for t in chosen for w in t["words"]}))
    return _once(
        words,
        lambda words: _once(
            F.array_intersect(vocabulary, words),
            lambda held: F.concat(none, *[of_window(words, held, window) for window in sorted({t["window"] for t in chosen})]),
        ),
    )


def license_blocks(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, h1, h2, template, label, start, window, overlap, containment)`` of every block that holds a template.

    ``containment`` is the share of the template's distinct words that the block
    holds, at least ``threshold``; ``start`` is the block's first word. ``template``
    is its place in ``templates``; a template without words is left out. ``h1``
    and ``h2`` are hashes of the text, so rows that repeat an id stay apart;
    rows repeated whole give their blocks once. Null texts have no blocks.
    """
    chosen = template_parameters(templates, threshold)
    blocks = _keyed(docs, id_col, text_col).select("id", "h1", "h2", F.explode(_full_blocks(F.col("words"), chosen)).alias("block"))
    blocks = stored(blocks.select("id", "h1", "h2", "block.*").distinct(), "blocks")
    order = word_order(blocks, sorted({w for t in chosen for w in t["words"]}))
    rank = {word: i for i, word in enumerate(order)}
    blocks = blocks.withColumn("held", F.array_intersect(_strings(order), "held"))
    # The block's words come in the order of rarity, so these are its prefix.
    prefix = blocks.select(
        "id", "h1", "h2", "window", "start", "held",
        F.posexplode(F.slice("held", F.lit(1), F.size("held") - F.col("least") + 1)).alias("at", "word"),
    )
    index = docs.sparkSession.createDataFrame(
        [
            (t["window"], word, t["number"], t["label"], ordered, at, t["need"])
            for t in chosen
            for ordered in [sorted(t["words"], key=rank.get)]
            for at, word in enumerate(ordered[: len(ordered) - t["need"] + 1])
        ],
        "window int, word string, template int, label string, wanted array<string>, t_at int, need int",
    )
    met = prefix.join(F.broadcast(index), ["window", "word"]).where(  # the index is bounded by the templates
        "size(held) >= need and 1 + least(size(held) - 1 - at, size(wanted) - 1 - t_at) >= need"
    )
    pairs = met.select("id", "h1", "h2", "template", "label", "start", "window", "held", "wanted", "need").distinct()
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("wanted", "held"))).where("overlap >= need")
    share = (F.col("overlap") / F.size("wanted")).alias("containment")
    return pairs.select("id", "h1", "h2", "template", "label", "start", "window", "overlap", share)


def _any(conditions) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def license_labels(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with a struct ``license``: what every text says about its license.

    ``n_words``; ``starts``, the places of the phrases (words from 0, ascending,
    all places of all phrases); ``base_labels`` of these; ``labels`` with those of
    the blocks that hold a template; ``score``, 1 where a phrase stands, else the
    largest containment found, else 0. Label lists are distinct and sorted.

    Null texts are empty, an empty text has no words, places or labels and score
    0. Rows that repeat get equal results, and columns of ``docs`` may have any
    name (a column ``license`` is replaced).
    """
    blocks = license_blocks(docs, templates, threshold, id_col, text_col)
    found = blocks.groupBy("id", "h1", "h2").agg(
        F.collect_set("label").alias("labels"), F.max("containment").alias("containment")
    )
    row, text = F.struct(*[docs[c] for c in docs.columns if c != "license"]), docs[text_col].cast("string")
    keyed = docs.select(row.alias("row"), docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), text.alias("text"))
    keyed = keyed.select("row", "id", "h1", "h2", words_of(F.col("text")).alias("words"))
    split = [(plain_words(phrase), label) for phrase, label in phrases]
    places = [F.struct(_places(F.col("words"), words).alias("at"), F.lit(label).alias("label")) for words, label in split if words]
    none = F.array().cast("array<struct<at:array<int>,label:string>>")
    keyed = keyed.select(
        "row", "id", "h1", "h2", F.size("words").cast("long").alias("n_words"),
        F.filter(F.array(*places) if places else none, lambda p: F.size(p["at"]) > 0).alias("hits"),
    )
    same = keyed["id"].eqNullSafe(found["id"]) & (keyed["h1"] == found["h1"]) & (keyed["h2"] == found["h2"])
    base = F.array_sort(F.array_distinct("hits.label"))
    other = F.coalesce(found["labels"], F.array().cast("array<string>"))
    result = F.struct(
        keyed["n_words"],
        F.array_sort(F.flatten("hits.at")).alias("starts"),
        base.alias("base_labels"),
        F.array_sort(F.array_union(base, other)).alias("labels"),
        F.when(F.size("hits") > 0, 1.0).otherwise(F.coalesce(found["containment"], F.lit(0.0))).alias("score"),
    )
    joined = keyed.join(found, same, "left").select(keyed["row"], result.alias("license"))
    return joined.select("row.*", "license")
