"""Operator 3, licence scans: a positional rare-token index, in DataFrame operations only.

The index holds, for every word of the licence templates, its postings (template, place). Over all documents the document
frequency of these words is counted; the ``rare`` words of highest idf in each template's key phrase are its anchors. A document
looks up all anchors that it holds, those of highest idf first; for each template the places where two of its
anchors (one, if the document holds only one) stand as in the template give the offsets at which the template may lie,
and there all its words are compared: a template is found where its key phrase stands word for word and at least
``cover`` per cent of its words agree. Everything happens within the row, so no text and no posting list is shuffled.

Base phrases are counted at every place. ``score`` is 1 with a base phrase, else the best found template's agreement, else 0.

Words: A-Z lower-cased, runs of letters, digits and non-ASCII signs. Defined cases: null and empty texts have no words,
labels '' and score 0; repeated rows are scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaprobe.llm import store

BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Base phrases; licence templates as (label, words with the mandatory key phrase in brackets).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("mit", "released under the [mit license]"),
    ("mit", "[permission is hereby granted free of charge to any person obtaining a copy] of this software and associated documentation files"),
    ("apache-2.0", "licensed under the [apache license version 2 0]"),
    ("gpl-3.0", "licensed under the [gnu general public license version 3]"),
    ("gpl-2.0", "licensed under the [gnu general public license version 2]"),
    ("lgpl", "under the terms of the [gnu lesser general public license]"),
    ("agpl", "under the terms of the [gnu affero general public license]"),
    ("bsd", "[redistribution and use in source and binary forms with or without modification] are permitted provided that"),
    ("mpl-2.0", "subject to the terms of the [mozilla public license v 2 0]"),
    ("cc-by-4.0", "licensed under [cc by 4 0]"),
    ("cc-by-sa-4.0", "licensed under [cc by sa 4 0]"),
    ("cc-by-nc-4.0", "licensed under [cc by nc 4 0]"),
    ("cc0", "licensed under [cc0 1 0]"),
    ("isc", "[permission to use copy modify and or distribute this software for any purpose] with or without fee is hereby granted"),
    ("unlicense", "this is [free and unencumbered software released into the public domain]"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction including without limitation the rights to use copy modify merge publish distribute [sublicense and or sell copies of the software]",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may [not use this file except in compliance with the license] you may obtain a copy of the license at "
        "http www apache org licenses license 2 0",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the [gnu general public license as published by the free software foundation]",
    ),
    (
        "bsd",
        "[redistributions of source code must retain the above copyright notice] this list of conditions and the following disclaimer",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty [in no event will the authors be held liable for any damages] arising from the use of this software",
    ),
    ("boost-1.0", "distributed under the [boost software license version 1 0]"),
    ("epl-2.0", "made available under the terms of the [eclipse public license 2 0]"),
)


@dataclass(frozen=True)
class Scan:
    rare: int = 3
    cover: int = 80
    templates: tuple[tuple[str, str], ...] = TEMPLATES


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    first: int
    last: int


def parsed(templates: tuple[tuple[str, str], ...]) -> list[Template]:
    out = []
    for label, text in templates:
        before, key, after = (x.split() for x in text.replace("]", "[").split("["))
        out.append(Template(label, (*before, *key, *after), len(before), len(before) + len(key) - 1))
    return out


def spaced(text: str) -> Column:
    """The words of a text, one space before, between and after them; one space if there are none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered(text), BREAKS, " ")), F.lit(" "))


def lowered(text: str) -> Column:
    """A-Z only: lower() where a text is ASCII, else letter by letter."""
    column = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(
        F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def frequencies(rows: DataFrame, templates: list[Template]) -> dict[str, int]:
    """Document frequency of each word that could be an anchor; at most as many rows as the key phrases have words."""
    vocabulary = sorted({w for t in templates for w in t.words[t.first : t.last + 1]})
    held = F.array_intersect(F.split("spaced", " "), F.array(*map(F.lit, vocabulary)))
    return {r["word"]: r["n"] for r in rows.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


def anchors(template: Template, order: dict[str, tuple], rare: int) -> list[str]:
    return sorted(set(template.words[template.first : template.last + 1]), key=order.__getitem__)[:rare]


def _array(values) -> str:
    return "array(" + ", ".join(values) + ")"


def template_array(templates: list[Template], order: dict[str, tuple], scan: Scan) -> str:
    """The index as a SQL literal: per template its words, key phrase bounds, anchors and the anchors' postings."""
    rows = []
    for t in templates:
        own = anchors(t, order, scan.rare)
        posts = [f"named_struct('word', '{w}', 'place', {i})" for i, w in enumerate(t.words) if w in own]
        quoted = [f"'{w}'" for w in t.words]
        rows.append(
            f"named_struct('label', '{t.label}', 'words', {_array(quoted)}, 'first', {t.first}, 'last', {t.last}, "
            f"'anchors', {_array(repr(w) for w in own)}, 'posts', {_array(posts)})"
        )
    return _array(rows)


def _offsets(anchor: str) -> str:
    return (
        f"flatten(transform(filter(t.posts, q -> q.word = {anchor}), "
        f"q -> transform(filter(hits, h -> h.word = {anchor}), h -> h.place - q.place)))"
    )


def scanned(docs: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), spaced("text").alias("spaced"))
    templates = parsed(scan.templates)
    count = frequencies(rows, templates)
    order = {w: (count.get(w, 0), w) for t in templates for w in t.words[t.first : t.last + 1]}  # highest idf first, equal ones by word
    wanted = sorted({w for t in templates for w in anchors(t, order, scan.rare)}, key=order.__getitem__)
    any_anchor = F.lit(False)
    for word in [*wanted, *(p for p, _ in BASE)]:
        any_anchor = any_anchor | F.col("spaced").contains(f" {word} ")
    words = "CASE WHEN touched THEN split(trim(spaced), ' ') END"
    base = ", ".join(
        f"transform(filter(CASE WHEN instr(spaced, ' {p} ') > 0 THEN sequence(0, size(words) - 1) ELSE array() END, "
        f"i -> {' AND '.join(f'get(words, i + {k}) = {w!r}' for k, w in enumerate(p.split()))}), i -> named_struct('label', '{label}', 'place', i))"
        for p, label in BASE
    )
    two = (
        "CASE WHEN size(own) = 0 THEN array() "
        f"WHEN size(own) = 1 THEN array_distinct({_offsets('own[0]')}) ELSE array_intersect({_offsets('own[0]')}, {_offsets('own[1]')}) END"
    )
    agree = "aggregate(sequence(0, size(t.words) - 1), 0, (a, i) -> a + CASE WHEN o + i >= 0 AND get(words, o + i) = t.words[i] THEN 1 ELSE 0 END)"
    whole = "forall(sequence(t.first, t.last), i -> o + i >= 0 AND get(words, o + i) <=> t.words[i])"
    best = f"array_max(transform({two}, o -> CASE WHEN {whole} THEN {agree} / size(t.words) ELSE 0D END))".replace(
        "own[", "filter(t.anchors, w -> array_contains(held, w))["
    ).replace("size(own)", "size(filter(t.anchors, w -> array_contains(held, w)))")
    index = template_array(templates, order, scan)
    out = (
        rows.withColumn("touched", any_anchor)
        .withColumn("words", F.expr(words))
        .withColumn("held", F.expr(f"CASE WHEN touched THEN filter({_array(repr(w) for w in wanted)}, w -> array_contains(words, w)) END"))
        .withColumn(
            "hits",
            F.expr(
                "CASE WHEN size(held) > 0 THEN filter(transform(words, (w, i) -> named_struct('word', w, 'place', i)), h -> array_contains(held, h.word)) END"
            ),
        )
        .withColumn("base", F.expr(f"CASE WHEN touched THEN concat({base}) END"))
        .withColumn(
            "found",
            F.expr(
                f"CASE WHEN size(hits) > 0 THEN filter(transform({index}, t -> named_struct('label', t.label, 'cover', {best})), "
                f"x -> 100 * x.cover >= {scan.cover}) END"
            ),
        )
    )
    return out.select(
        "doc_id",
        F.expr("CASE WHEN spaced = '  ' THEN 0 ELSE length(spaced) - length(replace(spaced, ' ', '')) - 1 END").cast("bigint").alias("n_words"),
        F.expr("coalesce(size(base), 0)").cast("bigint").alias("n_base"),
        F.expr("array_min(base.place)").cast("bigint").alias("first_word"),
        F.expr("array_max(base.place)").cast("bigint").alias("last_word"),
        F.expr("coalesce(array_join(array_sort(array_distinct(base.label)), ','), '')").alias("base_labels"),
        F.expr("coalesce(array_join(array_sort(array_distinct(concat(base.label, coalesce(found.label, array())))), ','), '')").alias("labels"),
        F.expr("CASE WHEN size(base) > 0 THEN 1D ELSE coalesce(array_max(found.cover), 0D) END").cast("double").alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(store.table(spark, sf_dir, "documents"))


def op3_sql(scan: Scan = Scan()) -> str:
    """The registered query in DuckDB's SQL: every template word meets every equal word of a text, grouped by offset."""
    rows = [
        f"('{t.label}', {k}, {len(t.words)}, {t.last - t.first + 1}, {i}, '{w}', {t.first <= i <= t.last})" for k, t in enumerate(parsed(scan.templates)) for i, w in enumerate(t.words)
    ]
    base = [f"('{label}', {len(p.split())}, {i}, '{w}')" for p, label in BASE for i, w in enumerate(p.split())]
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM d),
t(label, id, size, keys, pos, word, is_key) AS (VALUES {", ".join(rows)}),
p(label, size, pos, word) AS (VALUES {", ".join(base)}),
found AS (
  SELECT r, label, id, i - pos AS o, count(*) / any_value(size) AS cover FROM w JOIN t USING (word) GROUP BY r, label, id, i - pos
  HAVING count_if(is_key) = any_value(keys) AND 100 * count(*) >= {scan.cover} * any_value(size)),
places AS (SELECT r, label, i - pos AS o FROM w JOIN p USING (word) GROUP BY r, label, i - pos HAVING count(*) = any_value(size)),
b AS (SELECT r, count(*) AS n, min(o) AS first_word, max(o) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS cover
  FROM (SELECT r, label, cover FROM found UNION ALL SELECT r, label, 0 FROM places) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.first_word, b.last_word, coalesce(b.labels, '') AS base_labels,
       coalesce(a.labels, '') AS labels, CAST(CASE WHEN b.n > 0 THEN 1 ELSE coalesce(a.cover, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r)"""
