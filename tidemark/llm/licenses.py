"""Licence notices by a positional index of rare words.

Built-in functions only. Each template is indexed by its rarest words and where
they stand. Rare words of a file vote for the place where a template would
begin; a place with enough votes is compared word by word, and the template's
key phrase must stand there whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lowered, query, table

#: Fixed values of the contract: phrase and label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str

    @property
    def words(self) -> list[str]:
        return _words(self.text)

    @property
    def key_at(self) -> int:
        """Where the key phrase begins in the template."""
        words, key = self.words, _words(self.key)
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def _words(text: str) -> list[str]:
    return [w for w in re.split(_GAP, text.lower()) if w]


#: How common licences are announced.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "source and binary forms"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", "CC BY-NC"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", "CC BY-SA"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", "GNU General Public License"),
    Template("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3", "GNU Lesser General Public License"),
    Template("mit", "Released under the MIT License", "MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License"),
)


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases=PHRASES, rare_words: int = 4, least_share: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    The words of a template that fewest documents hold, ``rare_words`` of each,
    are its index. A place is compared when rare words with half of their total
    weight agree on it; it is found when ``least_share`` of the template's words
    stand at their places, its key phrase among them. ``score`` is the largest
    such share, and 1 where a base phrase stands. ``matches`` has label, start
    and share of each place found.

    A null text is empty: no words, no labels, score 0. Repeated rows are
    scanned one by one. Other columns are ignored.
    """
    text = lowered(F.col(text_col))
    words = F.filter(F.split(text, _GAP), lambda w: w != "")
    # The phrases with any gaps between their words; texts without one need no search by word.
    hint = "|".join(_GAP.join(p.split()) for p, _ in phrases)
    hits = [_labelled(_places(F.col("_words"), p.split()), label) for p, label in phrases]
    vocabulary = sorted({w for t in templates for w in t.words})
    known = F.array_intersect("_words", F.array(*map(F.lit, vocabulary)))
    keyed = None
    for t in templates:
        has = F.forall(F.array(*map(F.lit, sorted(set(_words(t.key))))), lambda w: F.array_contains("_known", w))
        keyed = has if keyed is None else keyed | has
    rows = docs.select(F.col(id_col).alias("_id"), words.alias("_words"), text.rlike(hint).alias("_hint"))
    rows = rows.withColumns({"_base": F.when(F.col("_hint"), F.flatten(F.array(*hits))), "_known": known, "n_words": F.size("_words").cast("long")})
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "n_words", "_base", "_known", F.when(keyed, F.col("_words")).alias("_words"))
    # Words stay only with files that hold all words of some key phrase; no other can match.
    rows = cut(rows)
    found = _template_places(rows, templates, vocabulary, rare_words, least_share)
    each = found.groupBy("_row").agg(F.sort_array(F.collect_set("label")).alias("_labels"), F.max("share").alias("_share"), F.array_sort(F.collect_list(F.struct("label", "start", "share"))).alias("matches"))
    base = F.coalesce("_base", F.array().cast("array<struct<i:bigint,label:string>>"))
    base_labels = F.sort_array(F.array_distinct(F.transform(base, lambda x: x["label"])))
    places = F.transform(base, lambda x: x["i"].cast("long"))
    none = F.array().cast("array<string>")
    return rows.join(cut(each), "_row", "left").select(
        F.col("_id").alias(id_col), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_labels, F.coalesce("_labels", none))), ",").alias("labels"),
        F.greatest(F.when(F.size(base) > 0, 1.0).otherwise(0.0), F.coalesce("_share", F.lit(0.0))).alias("score"), "matches",
    )


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("i"), F.lit(label).alias("label")))


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts, from 0, of a phrase's words in a row."""
    at = lambda i, k: F.get(words, (i + k).cast("int")) == phrase[k]

    def here(i):
        out = at(i, 0)
        for k in range(1, len(phrase)):
            out = out & at(i, k)
        return F.coalesce(out, F.lit(False))

    return F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0).cast("long"), F.size(words).cast("long") - 1), here)).otherwise(F.array().cast("array<bigint>"))


def _template_places(rows: DataFrame, templates, vocabulary: list[str], rare_words: int, least_share: float) -> DataFrame:
    """_row, label, start, share of every place where a template stands."""
    spark = rows.sparkSession
    # In how many documents each word of the templates stands: one row per such word.
    n, seen = rows.count(), rows.select(F.explode("_known").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    df = {r["w"]: r["n"] for r in seen.collect()}
    idf = spark.createDataFrame([(w, df.get(w, 0)) for w in vocabulary], "w string, df long").select("w", (F.log(F.lit(n + 1.0)) - F.log(F.col("df") + 1.0)).alias("idf"))
    sheet = spark.createDataFrame([(i, t.label, t.words, _words(t.key), t.key_at) for i, t in enumerate(templates)], "t int, label string, tw array<string>, kw array<string>, ka int")
    spots = sheet.select("t", F.posexplode("tw").alias("at", "w")).join(F.broadcast(idf), "w")
    ranked = sheet.select("t", F.explode(F.array_distinct("tw")).alias("w")).join(F.broadcast(idf), "w").groupBy("t")
    rarest = ranked.agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("idf")).alias("k"), "w"))), 1, rare_words).alias("_top")).select("t", F.explode("_top.w").alias("w"))
    postings = spots.join(F.broadcast(rarest), ["t", "w"])
    need = postings.groupBy("t").agg((F.sum("idf") / 2).alias("need"))
    # The index is as large as the templates.
    index = cut(postings.join(need, "t").select("t", "w", "at", "idf", "need"))
    rare = [r["w"] for r in index.select("w").distinct().collect()]
    files = rows.where("_words IS NOT NULL")
    votes = files.select("_row", F.posexplode("_words").alias("i", "w")).where(F.col("w").isin(rare))
    votes = votes.join(F.broadcast(index), "w").groupBy("_row", "t", (F.col("i") - F.col("at")).alias("start"))
    places = votes.agg(F.sum("idf").alias("got"), F.first("need").alias("need")).where("got >= need - 1e-9")
    places = cut(places.groupBy("_row").agg(F.collect_list(F.struct("t", "start")).alias("_p")))
    # Templates are compared inside the list of places, so that a text's words are not repeated for each of them.
    texts = F.array(*[F.struct(F.lit(t.label).alias("label"), _texts(t.words).alias("tw"), _texts(_words(t.key)).alias("kw"), F.lit(t.key_at).alias("ka")) for t in templates])

    def compared(p):
        t = F.get(texts, p["t"])
        word = lambda i: F.get("_words", (p["start"] + i).cast("int"))
        equal = F.size(F.filter(t["tw"], lambda w, i: F.coalesce(word(i) == w, F.lit(False)))).cast("double")
        keyed = F.forall(F.transform(t["kw"], lambda w, i: F.coalesce(word(i + t["ka"]) == w, F.lit(False))), lambda x: x)
        share = equal / F.size(t["tw"])
        return F.when(keyed & (share >= least_share), F.struct(t["label"].alias("label"), p["start"].alias("start"), share.alias("share")))

    near = files.select("_row", "_words").join(places, "_row")
    return near.select("_row", F.inline(F.array_compact(F.transform("_p", compared))))


def _texts(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


@query("op3_license_scan")
def op3_license_scan(spark, sf):
    return license_scan(table(spark, sf, "documents"))
