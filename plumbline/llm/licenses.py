"""Licence scans by diagonal voting, in DataFrame operations only.

All rolling word k-grams of all texts are joined, by hash, to the positions of the same
k-grams in the templates; words are compared as well, so a hit is exact.  A hit votes for
the diagonal (its place in the text less its place in the template) it lies on.  A diagonal
with a vote for every k-gram of a template is a verified span.  Neighbouring diagonals of a
template are merged, which bridges words that were added or left out; a run covers a place of
the template once, however many of its diagonals vote for it.

A passage's run is verified on the words themselves: from each of its diagonals, the span of the
text with the least edit distance to the template, in words, is sought.  It gives the label if at
most a share of 1 - MIN_COVER of the template's words was changed, the words that decide on the
licence (its version, say) are among those it kept, and none that would make it another licence
was put in.  A passage without K words in a row unchanged is not found.

The template table is a parameter of a few hundred rows, so it is broadcast.  Nulls count as
empty texts, which have no words, no label and score 0.  Rows are told apart by their place
in the scan, so repeated ids or rows each get their own result.  Labels that tie are all given.
Very long texts are scanned whole; a row's words are held in memory once, and only places that
match a template are shuffled.  An empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
#: Diagonals at most this far apart are merged.
NEAR = 2
MIN_COVER = 0.7
#: The sign of words that a template does not hold; its own ones follow.
SIGN = 48

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose every place is counted, and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Longer passages of well-known public licences, found also with small changes.
PASSAGES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
]

#: By label: words that a passage's span must hold, and words that make it another licence.
DECIDING = {
    "apache-2": ("apache 2", ""),
    "gpl-3": ("3", "1 2 lesser library affero"),
    "gpl-2": ("2", "1 3 lesser library affero"),
    "mpl-2": ("mozilla 2", ""),
    "cc-by": ("attribution", "noncommercial sharealike noderivatives noderivs nc sa nd"),
    "cc-by-nc": ("nc", "sa nd"),
    "cc-by-sa": ("sa", "nc nd"),
}


def words(text: Column) -> Column:
    """Words of a text, lower-cased.

    Lower-casing changes other letters than A-Z too; that moves no word's border, and U+212A,
    the one letter that would become an ASCII one, is taken out of the way first.
    """
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b"))), F.lit(WORD), 0)


def gram(w: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(w, at + i) for i in range(K)])


def templates(spark: SparkSession, base: list[tuple[str, str]], passages: list[tuple[str, str]]) -> DataFrame:
    """(h, template, label, is_base, n_grams, edits, known, code, must, barred, at, t0..): one row for each k-gram of each template.

    ``known`` lists the words that have a sign of their own (see ``signs``), ``code`` is the template in signs,
    ``must`` holds the signs of its deciding words, ``barred`` those of words that make it another licence.
    """
    rows = []
    for i, (phrase, label) in enumerate([*base, *passages]):
        w = phrase.split()
        must, barred = ([x for x in d.split() if (x in w) == kept] for d, kept in zip(DECIDING.get(label, ("", "")), (True, False), strict=True))
        known = list(dict.fromkeys([*w, *barred]))
        code, must, barred = ("".join(chr(SIGN + 1 + known.index(x)) for x in part) for part in (w, must, barred))
        rows.append((i, label, i < len(base), w, int((1 - MIN_COVER) * len(w) + 1e-9), known, code, must, barred))
    if any(len(r[3]) < K for r in rows):
        raise ValueError(f"a template needs {K} words at least")
    t = spark.createDataFrame(rows, "template int, label string, is_base boolean, w array<string>, edits int, known array<string>, code string, must string, barred string")
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.size("w") - K)).alias("at"))
    return t.select(gram(F.col("w"), F.col("at")).alias("h"), "template", "label", "is_base", (F.size("w") - K + 1).alias("n_grams"), "edits", "known", "code", "must", "barred", "at", *[F.get("w", F.col("at") + i).alias(f"t{i}") for i in range(K)])


def signs(w: Column, known: Column) -> Column:
    """Words as a string with one character a word: that of its place among the known ones, or that of all others."""

    def sign(x: Column) -> Column:
        n = F.array_position(known, x) + SIGN
        return F.when(n < 127, F.char(n)).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 4, F.lit("0"))), "UTF-16BE"))

    return F.array_join(F.transform(w, sign), "")


def verified(window: Column, code: Column, edits: Column, must: Column, barred: Column) -> Column:
    """The least edit distance to a template of a span of the window, in words; null if over ``edits`` or if deciding words speak against it.

    A span starts up to 2 * edits words into the window and is at most ``edits`` words longer or shorter than the
    template.  All such spans are tried, which suits passages of some tens of words.
    """
    n = F.length(code)

    def holds(span: Column, sign: Column) -> Column:
        return F.instr(span, sign) > 0

    def tried(start: Column, length: Column) -> Column:
        span = F.substring(window, start, length)
        wrong = F.exists(F.split(must, ""), lambda c: (c != "") & ~holds(span, c)) | F.exists(F.split(barred, ""), lambda c: (c != "") & holds(span, c))
        d = F.call_function("levenshtein", span, code, edits)  # -1 if over edits
        # a struct's order: the least distance first, of equal ones a span that is right
        return F.when(d >= 0, F.struct(d.alias("d"), wrong.alias("wrong")))

    starts, lengths = F.sequence(F.lit(1), 2 * edits + 1), F.sequence(n - edits, n + edits)
    best = F.array_min(F.flatten(F.transform(starts, lambda i: F.transform(lengths, lambda m: tried(i, m)))))
    return F.when(~best["wrong"], best["d"])


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, passages: list[tuple[str, str]] = PASSAGES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    grams = rows.select("row", "doc_id", "w", F.size("w").cast("long").alias("n_words"), F.posexplode_outer("w").alias("pos", "w0"))
    grams = grams.withColumn("h", gram(F.col("w"), F.col("pos")))
    same = [F.get("w", F.col("pos") + i) == F.col(f"t{i}") for i in range(K)]
    t = F.broadcast(templates(docs.sparkSession, base, passages))
    # the first word's row stays without a hit as well, so that every text has a row in what follows
    # a passage's hit takes along the words around its diagonal, as signs
    begin = F.greatest(F.lit(0), F.col("pos") - F.col("at") - F.col("edits"))
    window = signs(F.slice("w", begin + 1, F.col("n_grams") + K - 1 + 3 * F.col("edits")), F.col("known"))
    hit = same[0] & same[1] & same[2]
    hits = grams.join(t, ["h"], "left").select("row", "doc_id", "n_words", "pos", "at", F.when(hit, F.col("template")).alias("template"), "label", "is_base", "n_grams", "edits", "code", "must", "barred", F.when(hit & ~F.col("is_base"), window).alias("window"))
    hits = hits.filter(F.col("template").isNotNull() | F.col("pos").isNull() | (F.col("pos") == 0))

    key, of = ["row", "doc_id", "n_words"], ["template", "label", "is_base", "n_grams"]
    given = [F.when(F.col("template").isNotNull(), F.col(c)).alias(c) for c in (*of, "edits", "code", "must", "barred", "window")]
    votes = hits.groupBy(*key, *given, F.when(F.col("template").isNotNull(), F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.collect_set("at").alias("ats"))
    # words changed in a passage's verified span; null if there's none
    changed = F.when(F.col("is_base") | F.col("template").isNull(), F.lit(None)).when(F.col("votes") == F.col("n_grams"), 0).otherwise(verified(*map(F.col, ("window", "code", "edits", "must", "barred"))))
    votes = votes.select(*key, *of, "diagonal", "votes", "ats", changed.alias("changed"))
    # neighbouring diagonals of a template form one run
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    runs = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR).cast("int"))
    runs = runs.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.col("is_base") & (F.col("votes") == F.col("n_grams"))
    found = runs.groupBy(*key, *of, "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"),
        F.min("changed").alias("changed"),
        F.count(F.when(whole, 1)).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last"),
    )
    cover = F.when(F.col("template").isNotNull(), F.coalesce(1 - F.col("changed") / (F.col("n_grams") + K - 1), F.col("covered") / F.col("n_grams")))
    # a base phrase counts where it stands word for word; its label by the method needs no more than a passage's
    fuzzy = F.col("changed").isNotNull()

    def joined(condition: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")

    return found.groupBy(*key).agg(
        F.sum("places").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        joined(F.col("places") > 0).alias("base_labels"),
        joined((F.col("places") > 0) | fuzzy).alias("labels"),
        F.coalesce(F.max(F.when(F.col("places") > 0, F.lit(1.0)).otherwise(cover)), F.lit(0.0)).alias("score"),
    ).drop("row")
