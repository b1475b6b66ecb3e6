"""Licence scans with a positional index of rare words, in DataFrame functions only.

A template is the wording of a licence notice with mandatory key phrases at
their places in it.  The index lists, for every word of the key phrases, the
templates and positions that hold it (its postings).  One pass over the
documents counts in how many of them each of these words stands; the rarest
words of a template, those of highest inverse document frequency, are its
anchors.  A second pass looks up every file's anchor words: a word at place f
of the file and position t of the template puts the template at f - t, the
places of all of its anchors are intersected, and at each place that is left
all key phrases must stand word by word.  A place that holds the key phrases
holds all anchors, so the choice of anchors changes the work and never the
result.  The score of a place is the share of the template's words that stand
at their positions.

Nothing is shuffled but one row per task and index word; the index is as large
as the templates.

Defined cases: null or empty texts have no words and no places; words are runs
of digits, letters and code points from 0x80 on, A-Z lowered; equal rows give
equal rows, null ids are kept, places may overlap; a text of any length is
scanned whole; an empty table gives no rows; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textutil import texts_of

_PLACES = "array<struct<label:string,base:boolean,start:bigint,share:double>>"
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A notice; its key phrases stand in [brackets] (none: the whole text)."""
    label: str
    text: str

    @property
    def words(self) -> list[str]:
        return self.text.replace("[", "").replace("]", "").split()

    @property
    def phrases(self) -> list[tuple[int, list[str]]]:
        """(position, words) of each key phrase."""
        if "[" not in self.text:
            return [(0, self.words)]
        out, at = [], 0
        for piece in self.text.split("["):
            inside, closed, after = piece.partition("]")
            if closed:
                out.append((at, inside.split()))
            at += len(inside.split()) + len(after.split())
        return out


# The base phrases and their labels
BASE = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)
#: further notices, in the words of the licences themselves
NOTICES = (
    Template("mit", "[permission is hereby granted free of charge] to any person [obtaining a copy of this software] and associated documentation files"),
    Template("bsd", "[redistribution and use in source and binary forms with or without modification] are permitted provided that the following conditions are met"),
    Template("isc", "[permission to use copy modify] and or distribute this software [for any purpose with or without fee is hereby granted]"),
    Template("gpl", "licensed under the [gnu general public license] version"),
    Template("lgpl", "under the terms of the [gnu lesser general public license]"),
    Template("agpl", "under the terms of the [gnu affero general public license]"),
    Template("mpl-2", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    Template("epl", "under the terms of the [eclipse public license]"),
    Template("bsl-1", "distributed under the [boost software license version 1 0]"),
    Template("unlicense", "this is [free and unencumbered software released into the public domain]"),
    Template("cc0", "[cc0 1 0 universal]"),
    Template("cc-by-sa", "[cc by sa]"),
    Template("cc-by-nd", "[cc by nd]"),
    Template("cc-by-nc", "licensed under a [creative commons attribution noncommercial]"),
    Template("cc-by-sa", "licensed under a [creative commons attribution sharealike]"),
)


def file_words(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, _APART), lambda w: w != "")


def document_counts(files: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of rows of ``files`` (words) that hold each word; at most one row a word comes back."""
    there = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    rows = files.select(F.explode(there).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in rows}


def anchors(template: Template, counts: dict[str, int], number: int) -> list[tuple[str, list[int]]]:
    """The rarest words of the key phrases, with their positions in the template."""
    postings: dict[str, list[int]] = {}
    for at, words in template.phrases:
        for k, w in enumerate(words):
            postings.setdefault(w, []).append(at + k)
    return sorted(postings.items(), key=lambda p: (counts[p[0]], p[0]))[:number]


def _texts(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _places(template: Template, rare: list[tuple[str, list[int]]]) -> Column:
    """Array of (label, base, start, share) of the template in ``words``, given ``hits``,
    the places of anchor words; start is that of the first key phrase."""
    def shifted(word: str, positions: list[int]) -> Column:
        own = F.filter("hits", lambda f: F.get("words", f) == word)
        return F.flatten(F.transform(own, lambda f: F.array(*[f - t for t in positions])))

    def stands(o: Column) -> Column:
        inside = (o + template.phrases[0][0] >= 0) & (o + template.phrases[-1][0] + len(template.phrases[-1][1]) <= F.size("words"))
        return reduce(and_, [F.slice("words", o + at + 1, len(words)) == _texts(words) for at, words in template.phrases], inside)

    def place(o: Column) -> Column:
        equal = reduce(add, [F.when(F.get("words", o + j) == w, 1).otherwise(0) for j, w in enumerate(template.words)])
        return F.struct(F.lit(template.label).alias("label"), F.lit(template in BASE).alias("base"),
                        (o + template.phrases[0][0]).cast("bigint").alias("start"), (equal / len(template.words)).alias("share"))

    found = reduce(F.array_intersect, [shifted(*r) for r in rare])
    return F.transform(F.filter(F.array_distinct(found), stands), place)


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, n_anchors: int = 3,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (label, base: one of the base phrases, start:
    word number from 0, share) of every document."""
    files = texts_of(docs, id_col, text_col).select("doc_id", file_words(F.col("text")).alias("words"))
    vocabulary = sorted({w for t in templates for _, words in t.phrases for w in words})
    counts = document_counts(files, vocabulary)
    rare = [anchors(t, counts, n_anchors) for t in templates]
    wanted = sorted({w for r in rare for w, _ in r})
    hits = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(wanted), i)))
    found = F.concat(*[_places(t, r) for t, r in zip(templates, rare)])
    return (files.withColumn("hits", hits)
            .select("doc_id", F.size("words").cast("bigint").alias("n_words"),
                    F.when(F.size("hits") > 0, found).otherwise(F.array().cast(_PLACES)).alias("places")))
