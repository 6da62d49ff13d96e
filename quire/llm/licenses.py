"""License scans by diagonal voting (DataFrame functions only).

Every rolling word k-gram of a text is hashed and joined to the positions of the same hash in
licence templates. A hit at text position p and template position q votes for the diagonal
p - q; votes are counted per document, template and diagonal before they meet, diagonals a
few words apart (insertions, deletions) are merged. A span is verified by the share of the template's
k-grams that lie on its diagonals and by the words that tell the licences of a family apart: those
that the template has must be covered by votes, the others must not stand next to a vote within the span. Of
spans that overlap the best one keeps its label. Fixed phrases and SPDX lines are looked up by their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import let, whole_text

# Whatever is no digit, ASCII letter or character beyond ASCII parts words.
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 5
NEAR = 3  # diagonals at most so far apart are one alignment
VERIFIED = 0.5  # least share of a template's k-grams that an alignment covers

# Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Public licence wordings, each a template with its label.
_FREE = ("This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License "
         "as published by the Free Software Foundation")
_GNU = (("gpl", ""), ("agpl", "Affero "), ("lgpl", "Lesser "))
_CC = (("", ""), ("-sa", "-ShareAlike"), ("-nd", "-NoDerivatives"), ("-nc", "-NonCommercial"), ("-nc-sa", "-NonCommercial-ShareAlike"),
       ("-nc-nd", "-NonCommercial-NoDerivatives"))
TEMPLATES = (
    *((f"notice:{x}", f"This work is licensed under the GNU {name}General Public License, version 3.") for x, name in _GNU),
    *((f"notice:{x}", _FREE.format(what, name)) for x, name in _GNU for what in ("program", "library")),
    *((f"notice:cc-by{x}", f"This work is licensed under a Creative Commons Attribution{name} 4.0 International License.") for x, name in _CC),
    *((f"notice:cc-by{x}", f"Licensed under CC BY{x.upper()} 4.0.") for x, name in _CC),
    ("notice:apache", "Licensed under the Apache License, Version 2.0"),
    ("notice:apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                      "compliance with the License. You may obtain a copy of the License at"),
    ("notice:mit", "Released under the MIT License."),
    ("notice:mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                   "not distributed with this file, You can obtain one at"),
    ("notice:cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("text:mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
                 "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
                 "Software, and to permit persons to whom the Software is furnished to do so"),
    ("text:bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                 "the following conditions are met"),
    ("text:bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                   "products derived from this software without specific prior written permission"),
    ("text:isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                 "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("text:unlicense", "This is free and unencumbered software released into the public domain"),
)
# Words that tell apart the licences of a family, by how the family's labels start.
TELLING = (
    (("notice:gpl", "notice:agpl", "notice:lgpl"), ("affero", "lesser")),
    (("notice:cc-by",), ("sharealike", "noderivatives", "noderivs", "noncommercial", "sa", "nd", "nc")),
)
# Identifiers after "SPDX-License-Identifier:", as words.
SPDX = ("mit", "isc", "apache 2 0", "mpl 2 0", "gpl 2 0", "gpl 3 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0", "bsd 2 clause", "bsd 3 clause",
        "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "unlicense")


def license_words(text: Column) -> Column:
    """Lower-cased words. The Kelvin sign, the one letter beyond ASCII that lower-cases to an ASCII letter
    alone, is kept apart."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\uff2b"))), PARTING), "")


def grams(w: Column, k: int = K) -> Column:
    """Hashes of the rolling word k-grams of an array of words."""
    return F.when(F.size(w) < k, F.array().cast("array<bigint>")).otherwise(let(w, lambda x: F.transform(
        F.sequence(F.lit(0), F.size(x) - k), lambda i: F.xxhash64(*[F.get(x, i + j) for j in range(k)]))))


def gram_rows(w: Column, k: int = K) -> Column:
    """For every rolling k-gram its hash and the words before and after it (null at the ends)."""
    return F.when(F.size(w) < k, F.array().cast("array<struct<gram:bigint,before:string,after:string>>")).otherwise(let(w, lambda x: F.transform(
        F.sequence(F.lit(0), F.size(x) - k), lambda i: F.struct(F.xxhash64(*[F.get(x, i + j) for j in range(k)]).alias("gram"),
                                                                F.get(x, i - 1).alias("before"), F.get(x, i + k).alias("after")))))


def template_grams(spark, templates=TEMPLATES, k: int = K, telling=TELLING) -> DataFrame:
    """(gram, template, label, at, n_grams, must, never): where each template's k-grams stand, the places of its own
    telling words, and the other telling words of its family."""
    families = [next((list(words) for starts, words in telling if label.startswith(starts)), []) for label, _ in templates]
    rows = spark.createDataFrame([(i, label, text, f) for i, ((label, text), f) in enumerate(zip(templates, families))],
                                 "template int, label string, text string, family array<string>")
    w = rows.select("template", "label", "family", license_words(F.col("text")).alias("w"))
    place = F.sequence(F.lit(0), F.size("w") - 1)
    return (w.select("template", "label", grams(F.col("w"), k).alias("g"), F.array_except("family", "w").alias("never"),
                     F.filter(place, lambda i: F.array_contains("family", F.get("w", i))).alias("must"))
            .select("template", "label", "must", "never", F.size("g").alias("n_grams"), F.posexplode("g").alias("at", "gram")))


def phrase_starts(w: Column, phrase: str) -> Column:
    """Positions (from 0) at which the phrase's words stand one after the other in the array ``w``."""
    parts = phrase.split()

    def here(x, i):
        ok = F.get(x, i) == parts[0]
        for j, p in enumerate(parts[1:], 1):
            ok = ok & F.coalesce(F.get(x, i + j) == p, F.lit(False))
        return ok

    return let(w, lambda x: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: here(x, i)))


def prepare(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, w, wh): the words of every whole text, made once per row, and a hash of them."""
    return (df.select(df[id_col].alias("id"), F.explode(F.array(license_words(whole_text(df[text_col])))).alias("w"))
            .select("id", "w", F.xxhash64("w").alias("wh")))


def alignments(docs: DataFrame, templates=TEMPLATES, k: int = K, near: int = NEAR, verified: float = VERIFIED,
               telling=TELLING) -> DataFrame:
    """(id, wh, label, template, start, stop, share): verified template alignments of ``prepare``'s rows.

    The join's template side is the k-grams of ``templates``, a fixed list, and is broadcast; the
    texts' k-grams that are in no template end there, so only hits are shuffled. Votes
    are partial sums. ``share`` is the share of the template's k-grams found.
    """
    row = ["id", "wh"]
    known = template_grams(docs.sparkSession, templates, k, telling)
    alien = (((F.col("at") > 0) & F.array_contains("never", F.coalesce("e.before", F.lit(""))))
             | ((F.col("at") < F.col("n_grams") - 1) & F.array_contains("never", F.coalesce("e.after", F.lit("")))))
    hits = (docs.select(*row, F.posexplode(gram_rows(F.col("w"), k)).alias("p", "e")).withColumn("gram", F.col("e.gram"))
            .join(F.broadcast(known), "gram")
            .select(*row, "template", "label", "n_grams", "must", "at", "p", (F.col("p") - F.col("at")).alias("diagonal"), alien.alias("alien"))
            .distinct())  # rows repeated in the input vote once
    group = [*row, "template", "label", "n_grams", "must"]
    votes = (hits.groupBy(*group, "diagonal")
             .agg(F.count("*").alias("votes"), F.min("p").alias("start"), F.max("p").alias("last"),
                  F.collect_set("at").alias("ats"), F.max("alien").alias("alien")))  # as many places as the template has, at most
    line = Window.partitionBy(*row, "template").orderBy("diagonal")
    votes = votes.withColumn("new", (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(line), F.lit(-(1 << 30))) > near).cast("int"))
    votes = votes.withColumn("band", F.sum("new").over(line))
    span = F.array_max("ats") - F.array_min("ats") + 1
    told = F.forall("must", lambda q: F.exists("ats", lambda a: (a <= q) & (q < a + k)))
    spans = (votes.groupBy(*group, "band")
             .agg(F.sum("votes").alias("votes"), F.min("start").alias("start"), (F.max("last") + k).alias("stop"),
                  F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.max("alien").alias("alien"))
             # neighbouring diagonals may find a template k-gram twice: it counts once
             .withColumn("share", F.size("ats") / F.col("n_grams"))
             .where((F.col("share") >= verified) & (span >= verified * F.col("n_grams")) & told & ~F.col("alien")))
    return best_spans(spans, row).select(*row, "template", "label", "start", "stop", "share")


def best_spans(spans: DataFrame, row: list[str]) -> DataFrame:
    """``spans`` without those that overlap the best of their run of overlapping spans, have another label and
    a smaller (share, votes). Ties stay."""
    order = Window.partitionBy(*row).orderBy("start", "stop", "template", "band")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0))
    value = F.struct("share", "votes", "start", "stop", "label")
    chained = (spans.withColumn("first", (reach.isNull() | (F.col("start") >= reach)).cast("int")).withColumn("run", run)
               .withColumn("best", F.max(value).over(Window.partitionBy(*row, "run"))))
    beaten = ((F.col("label") != F.col("best.label")) & (F.col("start") < F.col("best.stop")) & (F.col("stop") > F.col("best.start"))
              & (F.struct("share", "votes") < F.struct(F.col("best.share").alias("share"), F.col("best.votes").alias("votes"))))
    return chained.where(~beaten)


def spdx_labels(w: Column) -> Column:
    """Labels of the SPDX lines among the words ``w``."""
    def found(name):
        parts = F.array(*[F.lit(x) for x in name.split()])
        return F.exists(phrase_starts(w, "spdx license identifier"), lambda i: F.slice(w, i + 4, len(name.split())) == parts)

    none = F.array().cast("array<string>")
    return F.when(F.array_contains(w, "spdx"), F.array_compact(F.array(*[F.when(found(x), f"spdx:{x.replace(' ', '-')}") for x in SPDX]))).otherwise(none)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per row: id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``score`` is the largest share of a verified alignment, 1 for an SPDX line, 0 if there is neither. Null, empty and
    licence-free texts have no labels. Repeated rows and shared ids are told apart by a
    hash of the words: rows alike in both are alike in the result. Null ids are kept.
    Extra columns are left out. Empty table: no rows.
    """
    docs = prepare(df, id_col, text_col)
    none = F.array().cast("array<int>")
    starts = [F.when(F.array_contains("w", phrase.split()[0]), phrase_starts(F.col("w"), phrase)).otherwise(none)
              for phrase, _ in PHRASES]
    base = docs.select("id", "wh", F.size("w").cast("long").alias("n_words"), spdx_labels(F.col("w")).alias("spdx"),
                       *[s.alias(f"s{i}") for i, s in enumerate(starts)])
    places = F.concat(*[F.col(f"s{i}") for i in range(len(PHRASES))])
    given = F.array(*[F.when(F.size(f"s{i}") > 0, label) for i, (_, label) in enumerate(PHRASES)])
    base = base.select("id", "wh", "n_words", "spdx", F.explode(F.array(places)).alias("places"),
                       F.array_sort(F.array_distinct(F.array_compact(given))).alias("own"))
    found = (alignments(docs, templates).groupBy("id", "wh")
             .agg(F.collect_set("label").alias("more"), F.max("share").alias("score"))  # labels: as many as templates at most
             .select(F.col("id").alias("fid"), F.col("wh").alias("fwh"), "more", "score"))
    joined = base.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("wh") == F.col("fwh")), "left")
    labels = F.array_sort(F.array_union(F.array_union("own", "spdx"), F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("spdx") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))
