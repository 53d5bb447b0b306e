"""License scans: a positional index over the rarest words of license phrases.

The index holds the templates' words with their positions. The document frequencies of all license words are
counted over all documents; each template is filed under the two words of its key phrase with the highest
inverse document frequency. A document's license words are looked up there; a posting proposes the start
``place of the word - place in the template``, the starts of the two rare words must agree, and the key phrase is
verified word for word. Every place of a key phrase holds its rare words, so none is missed.

Template words beside the key phrase (a full sentence of the license) are compared at the same relative
positions; the share that stands there is the score of a place.

Built from DataFrame functions only: the templates are short literals inside the expressions, so documents
are neither exploded nor shuffled for the scan.

Cases: a null text is empty; documents without words, or without a key phrase, have zero counts, null
places, empty labels and score 0; rows sharing an id are scanned apart; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarmetric.llm.common import ascii_lower, table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``key`` must stand whole inside ``text``; ``base``: a phrase of the fixed base list."""

    label: str
    key: str
    text: str
    base: bool = False


# Phrases and labels.
TEMPLATES = (
    Template("mit", "under the mit license", "released under the mit license", True),
    Template("apache-2", "apache license version 2", "licensed under the apache license version 2 0", True),
    Template("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0", True),
    Template("gpl-3", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2", "this work is licensed under the gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license", "licensed under the gnu lesser general public license"),
    Template("agpl-3", "gnu affero general public license", "licensed under the gnu affero general public license version 3"),
    Template("mpl-2", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    Template("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    Template("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    Template("cc0", "cc0 1 0 universal", "cc0 1 0 universal public domain dedication"),
    Template("unlicense", "free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
)


def document_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.key.split()})


def word_idf(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency over all documents of the key phrases' words (one row a word)."""
    words = vocabulary(templates)
    own = F.array_intersect(document_words(F.col("text")), F.array(*[F.lit(w) for w in words]))
    counted = docs.select(F.explode(own).alias("word")).groupBy("word").count().collect()
    n = docs.count()
    seen = {r["word"]: r["count"] for r in counted}
    return {w: math.log((n + 1) / (seen.get(w, 0) + 1)) for w in words}


def rare_words(t: Template, idf: dict[str, float]) -> list[tuple[str, int]]:
    """The two words of the key phrase with the highest idf, and their first place in it."""
    key = t.key.split()
    order = sorted(set(key), key=lambda w: (-idf[w], w))[:2]
    return [(w, key.index(w)) for w in order]


def place_arrays(words: Column, templates: tuple[Template, ...], idf: dict[str, float]) -> Column:
    """(template, start of the key phrase) of every verified place, by template and place."""
    rare = [rare_words(t, idf) for t in templates]
    first = sorted({r[0][0] for r in rare})
    found = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(first))
    posting = F.array(
        *[
            F.struct(
                F.lit(k).alias("t"), F.lit(r[0][0]).alias("w"), F.lit(r[0][1]).alias("at"),
                F.lit(r[-1][0]).alias("second"), F.lit(r[-1][1]).alias("second_at"),
                F.lit(len(t.key.split())).alias("n"), F.array(*[F.lit(w) for w in t.key.split()]).alias("key"),
            )
            for k, (t, r) in enumerate(zip(templates, rare))
        ]
    )
    # intersect: the second rare word must stand at the place the first one implies; then verify the phrase
    def starts(x: Column) -> Column:
        own = F.filter(
            posting,
            lambda p: (p["w"] == x["w"])
            & (x["i"] >= p["at"])
            & (F.get(words, x["i"] - p["at"] + p["second_at"]) == p["second"]),
        )
        own = F.filter(own, lambda p: F.slice(words, x["i"] - p["at"] + 1, p["n"]) == p["key"])
        return F.transform(own, lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["at"]).alias("start")))

    return F.flatten(F.transform(found, starts))


def share_at(words: Column, place: Column, templates: tuple[Template, ...]) -> Column:
    """Share of the template's words that stand at their relative positions around a place."""
    texts = F.array(*[F.array(*[F.lit(w) for w in t.text.split()]) for t in templates])
    shift = F.array(*[F.lit(_offset(t)) for t in templates])
    own = F.get(texts, place["t"])
    base = place["start"] - F.get(shift, place["t"])
    hit = F.transform(own, lambda w, j: F.when((base + j >= 0) & (F.get(words, F.greatest(base + j, F.lit(0))) == w), 1).otherwise(0))
    return F.aggregate(hit, F.lit(0), lambda a, b: a + b) / F.size(own)


def _offset(t: Template) -> int:
    key, text = t.key.split(), t.text.split()
    return next(i for i in range(len(text)) if text[i : i + len(key)] == key)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words and ``places``: label, base, start, length, share of each verified place."""
    idf = word_idf(docs, templates)
    rows = docs.select("doc_id", document_words(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), place_arrays(F.col("words"), templates, idf).alias("hits"))
    label = F.array(*[F.lit(t.label) for t in templates])
    base = F.array(*[F.lit(t.base) for t in templates])
    n = F.array(*[F.lit(len(t.key.split())) for t in templates])
    places = F.transform(
        F.col("hits"),
        lambda h: F.struct(
            F.get(label, h["t"]).alias("label"), F.get(base, h["t"]).alias("base"), h["start"].cast("long").alias("start"),
            F.get(n, h["t"]).alias("length"), share_at(F.col("words"), h, templates).alias("share"),
        ),
    )
    return rows.select("doc_id", "n_words", places.alias("places"))


def license_digest(scanned: DataFrame) -> DataFrame:
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(table(spark, sf_dir, "documents")))


def _sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(f"('{t.label}', {str(t.base).lower()}, {quoted(t.key.split())}, {quoted(t.text.split())}, {_offset(t)})" for t in TEMPLATES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    with template(label, base, key, body, shift) as (values {rows}),
    doc as (select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '{NOT_WORD}'), lambda w: w <> '') as words from documents),
    spot as (select r, words, unnest(range(len(words))) as i from doc),
    place as (select s.r, s.i as start, t.label, t.base,
      len(list_filter(range(len(t.body)), lambda j: s.i - t.shift + j >= 0 and s.words[s.i - t.shift + j + 1] = t.body[j + 1])) / len(t.body)::double as share
      from spot s join template t on s.words[s.i + 1] = t.key[1] and s.words[s.i + 1 : s.i + len(t.key)] = t.key),
    found as (select r, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
      string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score from place group by r)
    select d.doc_id, len(d.words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
      coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score
    from doc d left join found using (r)"""


ORACLE = _sql()
