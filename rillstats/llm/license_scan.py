"""License scans: phrases, and an exact set-similarity join with license templates.

Templates are grouped by length. For a template of the group S a text's blocks are the
2 * S words from each multiple of S on, so any S consecutive words (more than the template
has, so it may be wrapped and have words put in) lie in one block, over any number of lines.
A block matches a template if it holds CONTAINMENT of the template's different words, and
the phrases that tell the template from others stand in it.

Words are put in one order by the number of documents that hold them, rarest first. A
block that matches holds one of the template's first (size - needed + 1) words; where a
phrase is asked for, its rarest word does. Only blocks around such words are made (prefix
filter). Their words are joined to the templates' prefixes by hash. A pair is made at its
first shared word only, if the block has words enough (length filter) and enough of them
behind that word (positional filter); what passes is compared in full."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_side, stored

CONTAINMENT = 0.8
#: Words of a stretch for each word of the template, and the step of lengths.
SPREAD, STEP = 1.25, 8
#: A character that is in no word, of lower-cased text; and of any text.
BREAK_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
BREAK_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
_LAST = "license"
assert all(phrase.split()[-1] == _LAST and phrase.split().count(_LAST) == 1 for phrase, _ in PHRASES)

_CC_MORE = ("cc by nc", "cc by sa", "cc by nd")
_CC_LONG_MORE = ("attribution noncommercial", "attribution sharealike", "attribution noderivatives")
_CC = "this work is licensed under a creative commons"
#: Fixed values: (label, public license notice, phrases that must stand in a block, phrases that must not).
TEMPLATES: tuple[tuple[str, str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", (), ()),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", (), ()),
    ("mit", "released under the mit license", ("mit",), ()),
    ("mit", "licensed under the mit license", ("mit",), ()),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache",), ()),
    ("apache", "licensed under the apache license version 2 0", ("apache",), ()),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public",), ()),
    ("gpl", "licensed under the gnu general public license", ("gnu general public",), ()),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public",), ()),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public",), ()),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public",), ()),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", (), ()),
    ("bsd", "released under the bsd license", ("bsd",), ()),
    ("bsd", "licensed under the bsd license", ("bsd",), ()),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", (), ()),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public",), ()),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered",), ()),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("related or neighboring",), ()),
    ("cc-by", "licensed under cc by 4 0", ("cc by",), _CC_MORE),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",), ("cc by nc sa", "cc by nc nd")),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", ("cc by nc nd",), ()),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ("cc by nc sa",), ()),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",), ()),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",), ()),
    ("cc-by", f"{_CC} attribution 4 0 international license", ("commons attribution",), _CC_LONG_MORE),
    ("cc-by-nc", f"{_CC} attribution noncommercial 4 0 international license", ("attribution noncommercial",), ("noncommercial sharealike", "noncommercial noderivatives")),
    ("cc-by-nc-sa", f"{_CC} attribution noncommercial sharealike 4 0 international license", ("attribution noncommercial sharealike",), ()),
    ("cc-by-sa", f"{_CC} attribution sharealike 4 0 international license", ("attribution sharealike",), ()),
)


def needed(size: int, containment: float = CONTAINMENT) -> int:
    return math.ceil(containment * size - 1e-9)


def group_of(text: str) -> int:
    """S of a template's group: half of the words of its blocks."""
    return STEP * math.ceil(SPREAD * len(text.split()) / STEP)


def ordered_templates(order: dict[str, int], templates=TEMPLATES, containment: float = CONTAINMENT) -> list[dict]:
    """The templates with their different words in order, and their prefixes."""
    out = []
    for k, (label, text, must, never) in enumerate(templates):
        words = sorted(set(text.split()), key=order.__getitem__)
        need = needed(len(words), containment)
        asked = {w for phrase in must for w in phrase.split()}
        prefix = [min(asked, key=order.__getitem__)] if asked else words[: len(words) - need + 1]
        out.append({"template": k, "label": label, "s": group_of(text), "words": words, "need": need, "must": list(must), "never": list(never), "prefix": prefix})
    return out


def split_words(text: Column) -> Column:
    """A text's words, letters as they are."""
    return F.filter(F.split(text, BREAK_ANY_CASE + "+"), lambda w: w != "")


def _ascii(word: Column) -> Column:
    return F.octet_length(word) == F.length(word)


def _among(word: Column, words: list[str]) -> Column:
    """Whether the word, A-Z lower-cased, is one of ASCII words."""
    return F.lower(word).isin(*words) & _ascii(word)


def _lowered(words: Column) -> Column:
    """A word that isn't ASCII is in no template; it keeps its place as an empty one."""
    return F.transform(words, lambda w: F.when(_ascii(w), F.lower(w)).otherwise(F.lit("")))


def word_order(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> dict[str, int]:
    """The place of each word of the templates in the order of the number of documents that
    hold it, then by the word. All documents are counted; as many rows come to the driver as
    the templates have words."""
    words = sorted({w for t in templates for w in " ".join((t[1], *t[2])).split()})
    assert all(w.isascii() for w in words)
    held = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), BREAK_ANY_CASE + "+"), lambda w: _among(w, words))
    each = docs.select(F.explode(F.array_distinct(F.transform(held, F.lower))).alias("word"))
    n = {r["word"]: r["n"] for r in each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: k for k, w in enumerate(sorted(words, key=lambda w: (n.get(w, 0), w)))}


def _starts(phrase: str, anchors: Column, words: Column) -> Column:
    """Places where the phrase starts. anchors: (w, k) of words among them its last one."""
    parts = phrase.split()
    ends = F.filter(anchors, lambda a: a["w"] == parts[-1])
    starts = F.transform(ends, lambda a: a["k"] - F.lit(len(parts) - 1))

    def stands(k: Column) -> Column:
        ok = k >= 0
        for j, part in enumerate(parts[:-1]):
            w = F.get(words, k + F.lit(j))
            ok = ok & F.coalesce((F.lower(w) == part) & _ascii(w), F.lit(False))
        return ok

    return F.filter(starts, stands)


def marked(docs: DataFrame, found: list[dict], order: dict[str, int], id_col: str, text_col: str) -> DataFrame:
    """id, h (a hash of the text), n_words, places (of each base phrase) and blocks: S, the
    block's template words in order, and its words as a string between spaces."""
    groups: dict[str, set[int]] = {}
    for t in found:
        for w in t["prefix"]:
            groups.setdefault(w, set()).add(t["s"])
    anchors_of = sorted({*groups, _LAST})
    of_word = F.create_map(*(x for w in sorted(groups) for x in (F.lit(w), F.array(*map(F.lit, sorted(groups[w]))))))
    every = F.array(*(F.lit(w) for w in sorted(order, key=order.__getitem__)))
    least = min(t["need"] for t in found)

    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    split = given.select("id", F.xxhash64(text).alias("h"), split_words(text).alias("words"))
    hit = F.exists("words", lambda w: _among(w, anchors_of))
    placed = F.filter(F.transform("words", lambda w, k: F.struct(F.lower(w).alias("w"), k.alias("k"), _ascii(w).alias("ascii"))), lambda a: a["w"].isin(*anchors_of) & a["ascii"])
    none = F.array().cast("array<struct<w: string, k: int, ascii: boolean>>")
    anchored = split.select("id", "h", "words", F.when(hit, placed).otherwise(none).alias("anchors"))

    def around(a: Column) -> Column:
        own = F.coalesce(F.try_element_at(of_word, a["w"]), F.array().cast("array<int>"))
        at = lambda s: F.floor(a["k"] / s).cast("int")
        return F.flatten(F.transform(own, lambda s: F.array(F.struct(s.alias("s"), at(s).alias("b")), F.struct(s.alias("s"), (at(s) - 1).alias("b")))))

    def block(x: Column) -> Column:
        own = F.array(_lowered(F.slice("words", x["b"] * x["s"] + 1, 2 * x["s"])))
        return F.element_at(F.transform(own, lambda ws: F.struct(x["s"].alias("s"), F.array_intersect(every, ws).alias("tokens"), F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" ")).alias("said"))), 1)

    numbers = F.filter(F.array_distinct(F.flatten(F.transform("anchors", around))), lambda x: x["b"] >= 0)
    blocks = F.filter(F.transform(numbers, block), lambda x: F.size(x["tokens"]) >= least)
    places = F.array(*(F.transform(_starts(phrase, F.col("anchors"), F.col("words")), lambda k: k.cast("long")) for phrase, _ in PHRASES))
    return anchored.select("id", "h", F.size("words").cast("long").alias("n_words"), places.alias("places"), F.when(F.size("anchors") > 0, blocks).alias("blocks"))


def _stands(said: Column, phrases: Column) -> Column:
    return F.transform(phrases, lambda p: said.contains(F.concat(F.lit(" "), p, F.lit(" "))))


def matched(blocks: DataFrame, found: list[dict]) -> DataFrame:
    """The join: id, h, label, share (of the template's words) of each block and template that match."""
    rows = []
    for t in found:
        for k, w in enumerate(t["prefix"]):
            rows.append((t["s"], w, t["prefix"][:k], t["words"], t["need"], bool(t["must"]), t["must"], t["never"], t["label"]))
    kind = "s int, token string, earlier array<string>, words array<string>, need int, asked boolean, must array<string>, never array<string>, label string"
    prefixes = F.broadcast(blocks.sparkSession.createDataFrame(rows, kind))  # as many rows as the templates' prefixes have words
    starts = sorted({w for t in found for w in t["prefix"]})
    tokens = F.filter(F.transform("tokens", lambda w, k: F.struct(k.alias("place"), w.alias("token"))), lambda x: x["token"].isin(*starts))
    each = blocks.select("id", "h", F.inline("blocks")).select("id", "h", "s", "tokens", "said", F.inline(tokens))
    first = ~F.arrays_overlap("tokens", "earlier")
    enough = (F.size("tokens") >= F.col("need")) & (F.col("asked") | (F.size("tokens") - F.col("place") >= F.col("need")))
    pairs = each.join(prefixes, ["s", "token"]).where(first & enough)
    shared = F.size(F.array_intersect("words", "tokens"))
    whole = F.forall(_stands(F.col("said"), F.col("must")), lambda x: x) & ~F.exists(_stands(F.col("said"), F.col("never")), lambda x: x)
    return pairs.where((shared >= F.col("need")) & whole).select("id", "h", "label", (shared / F.size("words")).alias("share"))


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (1 with a base phrase, else the largest share of a template found, else 0).

    Native. Texts are read twice: for the order of words, and for blocks, which are written
    with the counts to the shared folder; only these narrow rows are joined to what
    matched. Null and empty texts have no words and no labels; only id and text are read, so
    clashing names don't matter; repeated rows and null ids come back as they are; an
    empty table gives an empty result; texts are read whole, however long."""
    order = word_order(docs, templates, text_col)
    found = ordered_templates(order, templates, containment)
    rows = stored(marked(docs, found, order, id_col, text_col), "license-blocks")
    pairs = matched(rows.where("blocks is not null and size(blocks) > 0"), found)
    hits = stored(pairs.groupBy("id", "h").agg(F.collect_set("label").alias("more"), F.max("share").alias("share")), "license-matches")
    own = small_side(hits.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "more", "share"), hits)
    joined = rows.join(own, F.col("h").eqNullSafe(F.col("_h")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    starts = F.flatten("places")
    base = F.array_compact(F.array(*(F.when(F.size(F.get("places", F.lit(k))) > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES))))
    more = F.coalesce("more", F.array().cast("array<string>"))
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.sort_array(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Every block of every group against every template of the group."""
    phrases = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        test = " AND ".join(f"x[{j}] IS NOT DISTINCT FROM '{p}'" for j, p in enumerate(parts, 1))
        zipped = ", ".join(["ws", *(f"ws[{j}:]" for j in range(2, len(parts) + 1)), "range(0, len(ws))"])
        phrases.append(f"SELECT doc_id, x[{len(parts) + 1}] AS start, '{label}' AS label FROM (SELECT doc_id, unnest(list_zip({zipped})) AS x FROM w WHERE list_contains(ws, '{_LAST}')) WHERE {test}")
    listed = lambda xs: f"[{', '.join(repr(x) for x in xs)}]::VARCHAR[]"
    temps = ",\n  ".join(f"('{label}', {group_of(text)}, {listed(dict.fromkeys(text.split()))}, {needed(len(set(text.split())))}, {listed(must)}, {listed(never)})" for label, text, must, never in TEMPLATES)
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    inside = lambda xs: f"len(list_filter({xs}, lambda y: contains(said, ' ' || y || ' ')))"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {low} AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, rid, list_filter(string_split_regex(t, '{BREAK_CLASS}+'), lambda x: x <> '') AS ws FROM d),
p AS ({" UNION ALL ".join(phrases).replace("SELECT doc_id, ", "SELECT rid, ")}),
b AS (SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY rid),
tp(label, s, words, need, must, never) AS (VALUES
  {temps}),
k AS (SELECT rid, s, list_distinct(ws[i * s + 1:i * s + 2 * s]) AS block, ' ' || array_to_string(ws[i * s + 1:i * s + 2 * s], ' ') || ' ' AS said
      FROM (SELECT rid, ws, s, unnest(range(0, len(ws) // s + 1)) AS i FROM w, (SELECT DISTINCT s FROM tp))),
m AS (SELECT rid, label, max(len(list_intersect(block, words)) / len(words)) AS c FROM k JOIN tp USING (s)
      WHERE len(list_intersect(block, words)) >= need AND {inside("must")} = len(must) AND {inside("never")} = 0 GROUP BY rid, label),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM m UNION SELECT rid, label FROM p) GROUP BY rid),
c AS (SELECT rid, max(c) AS c FROM m GROUP BY rid)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (rid) LEFT JOIN l USING (rid) LEFT JOIN c USING (rid)
"""


OP10_SQL = _sql()
