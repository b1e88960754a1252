"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line of a text, as its set of words. A template matches a block that
holds at least ``CONTAINMENT`` of the template's words. The join finds every such
pair without comparing all pairs: words are put into one global order, rarest in
the corpus first; a block that shares enough words with a template must share one
of the template's first ``size - needed + 1`` words in that order (prefix filter),
must have enough words (length filter), and from the first shared word on both must
have enough words left (positional filter). Pairs that pass are counted in full.
Words that no template has cannot count, so blocks are reduced to template words
first; the tables of templates, words and prefixes are bounded by the templates.

License files break a notice over lines, and copies lose or change a word. ``scan``
sees neither, as its SQL says; ``scan_blocks`` also takes every run of at most
``REACH`` times a template's words, across line ends, that holds ``RUN_CONTAINMENT``
of them and those that name the license. The filters above run on whole documents
first, as a document cannot hold less than its runs.

All of it is DataFrame expressions. Null and empty texts have no words and no
labels. Rows that repeat an id are told apart by a hash of their text.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkjets.llm.common import keep, or_empty, text_key

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# The standard short notices of public licenses, in lower case.
TEMPLATES = {
    "agpl": "licensed under the gnu affero general public license version 3",
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "boost": "distributed under the boost software license version 1 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "dedicated to the public domain under the creative commons cc0 1 0 universal",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee",
    "lgpl": "licensed under the gnu lesser general public license version 3",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
CONTAINMENT = 0.95

#: Runs that cross line ends: the share of a template's words they hold, and their length in templates.
RUN_CONTAINMENT = 0.8
REACH = 1.5
# Words without which the text is of another license or version.
NAMED = {
    "agpl": ["affero"],
    "apache-2.0": ["apache", "2"],
    "bsd": ["redistribution"],
    "boost": ["boost"],
    "cc-by-nc": ["cc", "by", "nc"],
    "cc-by-sa": ["cc", "by", "sa"],
    "cc0": ["cc0"],
    "gpl-3.0": ["gnu", "general", "3"],
    "lgpl": ["lesser"],
    "mit-notice": ["mit"],
    "mpl-2.0": ["mozilla", "2"],
    "unlicense": ["unencumbered"],
}
# Words at which a run of the template ends.
ALIEN = {"gpl-3.0": ["affero", "lesser"]}

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def phrase_places(text: Column) -> Column:
    """Sorted structs (place, label): where the words of a phrase stand, counted in words from 0.

    Only texts that a scan finds a phrase in are split into words.
    """
    some = "|".join(f"{BETWEEN}+".join(phrase.split()) for phrase in PHRASES)
    words = F.split(F.regexp_replace(lowered(text), f"^{BETWEEN}+", ""), f"{BETWEEN}+")

    def found(all_words: Column) -> Column:
        def at(word: Column, i: Column) -> Column:
            hits = None
            for phrase, label in PHRASES.items():
                first, *rest = phrase.split()
                same = word == first
                for k, other in enumerate(rest, 1):
                    same = same & (F.get(all_words, i + k) == other)
                hit = F.struct(i.cast("long").alias("place"), F.lit(label).alias("label"))
                hits = F.when(same, hit) if hits is None else hits.when(same, hit)
            return hits

        return F.filter(F.transform(all_words, at), lambda x: x.isNotNull())

    # bound once, so that the words are not split again for every word
    places = F.element_at(F.transform(F.array(words), found), 1)
    return F.when(text.rlike(f"(?i)({some})"), places)


def notices() -> list[tuple[str, list[str], int]]:
    """Per template its label, distinct words and the shared words that make a match."""
    split = [(label, sorted(set(text.split()))) for label, text in TEMPLATES.items()]
    return [(label, words, math.ceil(CONTAINMENT * len(words) - 1e-9)) for label, words in split]


def run_notices() -> list[tuple[str, list[str], int, int, list[str], list[str]]]:
    """Per template its label, distinct words, shared words of a match, longest run, naming words and alien words."""
    return [
        (label, words := sorted(set(text.split())), math.ceil(RUN_CONTAINMENT * len(words) - 1e-9),
         math.ceil(REACH * len(text.split())), NAMED.get(label, []), ALIEN.get(label, []))
        for label, text in TEMPLATES.items()
    ]


def blocks(docs: DataFrame) -> DataFrame:
    """Kept lines that pass the length filter of the smallest template: ``doc_id, text_hash, words``.

    ``words`` are the distinct template words of the line.
    """
    known = sorted({word for _, words, _ in notices() for word in words})
    least = min(needed for *_, needed in notices())
    lines = docs.select("doc_id", text_key().alias("text_hash"), F.explode(F.split(or_empty("text"), "\n")).alias("line"))
    shared = F.array_intersect(F.split(lowered(F.col("line")), f"{BETWEEN}+"), F.array(*map(F.lit, known)))
    reduced = lines.select("doc_id", "text_hash", shared.alias("words"))
    return keep(reduced.where(F.size("words") >= least), "blocks")


def matches(found: DataFrame, templates: list[tuple[str, list[str], int]] | None = None) -> DataFrame:
    """Every (block, template) pair over the threshold: ``doc_id, text_hash, label, shared, size``."""
    templates = notices() if templates is None else templates
    spark = found.sparkSession
    # how many blocks hold each template word: as many rows as the templates have words, at most
    rarity = {r.word: r.n for r in found.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = {word: i for i, (_, word) in enumerate(sorted((n, word) for word, n in rarity.items()))}
    rows, prefix = [], []
    for label, words, needed in templates:
        rows.append((label, words, len(words), needed))
        ranked = sorted(words, key=lambda w: order.get(w, -1))  # words of no block are the rarest
        prefix += [(w, label, len(words), needed, i) for i, w in enumerate(ranked[: len(words) - needed + 1])]
    whole = spark.createDataFrame(rows, "label string, of_template array<string>, size int, needed int")
    prefixes = spark.createDataFrame(prefix, "word string, label string, size int, needed int, i int")
    place = F.create_map(*(F.lit(x) for pair in order.items() for x in pair)) if order else F.lit(None).cast("map<string,int>")
    sorted_words = F.array_sort(F.transform("words", lambda w: F.struct(F.try_element_at(place, w).alias("at"), w.alias("word"))))
    tokens = found.select("doc_id", "text_hash", "words", F.size("words").alias("has"), F.posexplode(sorted_words).alias("j", "x"))
    near = tokens.select("doc_id", "text_hash", "words", "has", "j", F.col("x.word").alias("word")).join(
        F.broadcast(prefixes), "word"
    )
    # at most min(i, j) words were shared before this one, and no more can follow than either side has left
    most = F.least("i", "j") + F.least(F.col("size") - F.col("i"), F.col("has") - F.col("j"))
    candidates = near.where((F.col("has") >= F.col("needed")) & (most >= F.col("needed")))
    counted = candidates.select("doc_id", "text_hash", "words", "label").join(F.broadcast(whole), "label").withColumn(
        "shared", F.size(F.array_intersect("words", "of_template"))
    )
    return counted.where("shared >= needed").select("doc_id", "text_hash", "label", "shared", "size")


def run_matches(docs: DataFrame) -> DataFrame:
    """The fullest run of every (document, template) pair over ``RUN_CONTAINMENT``: columns as of ``matches``.

    A run may as well start at a word of the template, so only those are tried.
    """
    templates = run_notices()
    known = sorted({word for _, words, _, _, _, alien in templates for word in [*words, *alien]})
    words = F.split(lowered(or_empty("text")), f"{BETWEEN}+")
    shared = F.array_intersect(words, F.array(*map(F.lit, known)))

    def any_template(has: Column) -> Column:
        """Only documents that hold enough of some template, and what names it, have their words numbered."""
        of = lambda words: F.size(F.array_intersect(has, F.array(*map(F.lit, words))))
        whole = [(of(own) >= needed) if not named else (of(named) == len(named)) & (of(own) >= needed) for _, own, needed, _, named, _ in templates]
        return (F.size(has) >= min(needed for _, _, needed, *_ in templates)) & reduce(or_, whole)

    some = docs.where(F.exists(F.array(shared), any_template))
    numbered = F.transform(words, lambda word, i: F.struct(i.alias("i"), word.alias("word")))
    at = F.filter(numbered, lambda x: x["word"].isin(known))
    found = keep(some.select("doc_id", text_key().alias("text_hash"), shared.alias("words"), at.alias("at")), "runs")
    whole = matches(found.select("doc_id", "text_hash", "words"), [(label, own, needed) for label, own, needed, *_ in templates])
    near = whole.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "label").distinct()
    schema = "label string, of_template array<string>, needed int, reach int, named array<string>, alien array<string>"
    table = docs.sparkSession.createDataFrame(templates, schema)
    rows = found.join(near, found.doc_id.eqNullSafe(near.d) & found.text_hash.eqNullSafe(near.h)).join(F.broadcast(table), "label")
    own = F.filter("at", lambda x: F.array_contains("of_template", x["word"]) | F.array_contains("alien", x["word"]))

    def fullest(hits: Column) -> Column:
        def held(first: Column, k: Column) -> Column:
            ahead = F.filter(F.slice(hits, k + 1, F.col("reach")), lambda x: x["i"] < first["i"] + F.col("reach"))

            def count(run: Column) -> Column:
                end = F.array_min(F.transform(F.filter(run, lambda x: F.array_contains("alien", x["word"])), lambda x: x["i"]))
                whole_run = F.transform(F.filter(run, lambda x: x["i"] < F.coalesce(end, F.lit(2**31 - 1))), lambda x: x["word"])
                named = F.size(F.array_intersect("named", whole_run)) == F.size("named")
                return F.when(named, F.size(F.array_distinct(whole_run)))

            return F.element_at(F.transform(F.array(ahead), count), 1)

        return F.array_max(F.transform(hits, held))

    # bound once, so that the words are not filtered again for every start
    best = rows.withColumn("shared", F.element_at(F.transform(F.array(own), fullest), 1)).where("shared >= needed")
    return best.select("doc_id", "text_hash", "label", "shared", F.size("of_template").alias("size"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest share of a template that one block holds (rounded to 6
    places), and 1 where a phrase stands.
    """
    return _labelled(docs, matches(blocks(docs)))


def scan_blocks(docs: DataFrame) -> DataFrame:
    """``scan`` with blocks that cross line ends and may lack words: its matches and those of ``run_matches``."""
    return _labelled(docs, matches(blocks(docs)).unionByName(run_matches(docs)))


def _labelled(docs: DataFrame, matched: DataFrame) -> DataFrame:
    text = or_empty("text")
    base = docs.select(
        "doc_id",
        text_key().alias("text_hash"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        phrase_places(text).alias("places"),
    )
    per_text = matched.groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("of_templates"),  # at most one entry per template
        F.max(F.round(F.col("shared") / F.col("size"), 6)).alias("best"),
    )
    hit = per_text.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "of_templates", "best")
    joined = base.join(hit, base.doc_id.eqNullSafe(hit.d) & base.text_hash.eqNullSafe(hit.h), "left")
    none = F.array().cast("array<string>")
    base_labels = F.array_sort(F.array_distinct(F.coalesce(F.col("places.label"), none)))
    labels = F.array_sort(F.array_union(base_labels, F.coalesce("of_templates", none)))
    n_base = F.coalesce(F.size("places"), F.lit(0))
    return joined.select(
        "doc_id", "n_words",
        F.when(F.col("places").isNull(), 0).otherwise(n_base).cast("long").alias("n_base"),
        F.array_min("places.place").alias("first_word"),
        F.array_max("places.place").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size(base_labels) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
