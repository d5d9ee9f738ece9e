"""License scan with a positional index of rare tokens.

Each template has key phrases at fixed places. Of the words of its key phrases the index holds
the rarest ones (highest IDF over all documents) with their positions. A document's licence
words are looked up there; postings that agree on where the template would begin are
intersected, and the key phrases are verified on the words around the hit. As the looked-up
words belong to the key phrases, no place where all key phrases stand is missed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topiclens.llm.common import ascii_lower, whole
from topiclens.session import cut_lineage

#: Lower-case letters, digits and everything beyond ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE_WORDS = 2


@dataclass(frozen=True)
class Template:
    """``text`` in lower-case words; ``keys`` are phrases in it that must stand. A base
    template is one phrase whose every place counts."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def key_spans(self) -> list[tuple[int, list[str]]]:
        """Where each key phrase begins in the template, with its words."""
        found = []
        for key in self.keys:
            own = key.split()
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(own)] == own)
            found.append((at, own))
        return found


def phrase(label: str, text: str) -> Template:
    return Template(label, text, (text,), base=True)


# fixed values: the phrases of the contract
BASE = (
    phrase("mit", "under the mit license"),
    phrase("apache-2", "apache license version 2"),
    phrase("cc-by-nc", "cc by nc"),
)
# fixed values: openings of public licence notices
NOTICES = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "obtaining a copy of this software"),
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        ("you may not use this file except in compliance with the license",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted"
        " provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template(
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation either version 2 of the license or at your option any later version",
        ("gnu general public license", "either version 2 of the license"),
    ),
    Template(
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu general public license", "either version 3 of the license"),
    ),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template(
        "cc-by-nc",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        ("creative commons attribution noncommercial",),
    ),
    Template(
        "cc-by-sa",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        ("creative commons attribution sharealike",),
    ),
    Template(
        "unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)
    ),
)
TEMPLATES = BASE + NOTICES


def license_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(LICENSE_WORD), F.lit(0))


def document_frequencies(docs: DataFrame, vocabulary: Sequence[str], text_col: str = "text") -> dict[str, int]:
    """In how many of all rows each word of ``vocabulary`` (the templates' words) stands."""
    present = F.array_distinct(F.filter(license_words(whole(text_col)), lambda w: w.isin(*vocabulary)))
    counted = docs.select(F.explode(present).alias("w")).groupBy("w").count()
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["count"] for r in counted.collect()}  # at most the vocabulary


def rare_postings(templates: Sequence[Template], frequency: dict[str, int], rare: int = RARE_WORDS) -> list[tuple[str, int, int]]:
    """``(word, template number, offset)`` of the rarest key-phrase words of each template."""
    postings = []
    for number, template in enumerate(templates):
        places = sorted({at + i: w for at, own in template.key_spans() for i, w in enumerate(own)}.items())
        postings += [(w, number, at) for at, w in sorted(places, key=lambda p: (frequency[p[1]], p[0]))[:rare]]
    return postings


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def _row(**values) -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in values.items()))


def _table(spark: SparkSession, rows: Sequence[Column]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*rows)))


def license_places(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All documents as ``doc_id, _print, n_words``, and the places where a template stands:
    ``doc_id, _print, label, base, start, share`` (share: of its words that stand in place)."""
    vocabulary = sorted({w for t in templates for _, own in t.key_spans() for w in own})
    postings = rare_postings(templates, document_frequencies(docs, vocabulary, text_col))
    looked_up = sorted({w for w, _, _ in postings})
    reach = max(len(t.words) for t in templates)

    worded = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text")).select(
        "doc_id", F.xxhash64("_text").alias("_print"), license_words(F.col("_text")).alias("_words")
    )
    hits = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(*looked_up), i)), lambda i: i.isNotNull())
    spots = cut_lineage(
        worded.withColumn("_hits", hits).select(
            "doc_id", "_print", F.size("_words").cast("long").alias("n_words"),
            F.transform(
                "_hits",
                lambda i: F.struct(
                    i.alias("at"), F.get("_words", i).alias("word"), F.greatest(i - reach, F.lit(0)).alias("first"),
                    F.slice("_words", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach)).alias("around"),
                ),
            ).alias("_spots"),
        )
    )
    spark = docs.sparkSession
    index = _table(spark, [_row(word=w, template=n, offset=at) for w, n, at in postings])
    known = _table(
        spark,
        [
            F.struct(
                _row(template=n, label=t.label, base=t.base, wanted=sum(p[1] == n for p in postings)).alias("t"),
                _array(t.words).alias("words"),
                F.array(*(F.struct(F.lit(at).alias("at"), _array(own).alias("words")) for at, own in t.key_spans())).alias("keys"),
            )
            for n, t in enumerate(templates)
        ],
    ).select("t.*", "words", "keys")
    met = (
        spots.select("doc_id", "_print", F.explode("_spots").alias("s"))
        .select("doc_id", "_print", "s.*")
        .join(F.broadcast(index), "word")  # a few words for each template
        .withColumn("start", F.col("at") - F.col("offset"))
        .join(F.broadcast(known), "template")
    )
    here = F.col("start") - F.col("first")
    stands = F.forall("keys", lambda k: F.forall(F.transform(k["words"], lambda w, i: F.get("around", here + k["at"] + i).eqNullSafe(w)), lambda x: x))
    same = F.size(F.filter(F.transform("words", lambda w, i: F.get("around", here + i).eqNullSafe(w)), lambda x: x))
    places = (
        met.filter(stands)
        .withColumn("share", same / F.size("words"))
        .groupBy("doc_id", "_print", "template", "label", "base", "start", "wanted")
        .agg(F.count_distinct("offset").alias("_agree"), F.max("share").alias("share"))
        .filter("_agree = wanted")
    )
    return spots.select("doc_id", "_print", "n_words"), places


def license_scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are the
    smallest and largest of their starts (null without one). Labels are distinct, sorted and
    joined by commas (empty text for none). ``score`` is the largest share of a standing
    template's words that are in place: 1 for a base phrase, 0 for no licence. Null texts count
    as empty; rows that repeat id and text are one document. Other columns are ignored.
    """
    every, places = license_places(docs, templates, id_col, text_col)
    base = F.col("base")
    found = places.groupBy(F.col("doc_id").alias("_id"), F.col("_print").alias("_of")).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    joined = every.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_of")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
