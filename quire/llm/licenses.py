"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a window of words, wherever its lines break: templates of up to S words, S being 16, 32, 64 and so on, are looked for in the blocks of 2 S
words that begin at every S-th word, so that a notice of S words lies whole in one of them. A block matches a template when it
holds at least CONTAINMENT of the template's distinct words; of the templates that match a block those with the
largest share name it. The join is exact and reads every block: the words of all templates are put in one order, rarest in the
corpus first; a block and a template that share enough words must share one within a prefix of each
(prefix filter, by an inverted index from the words of the templates' prefixes to the templates), the block must have enough words
of templates at all (length filter), and what can still follow the shared word must suffice (positional filter). What passes
is counted out in full.

DataFrame functions only. The texts are read twice, for the words' frequencies, at most as many rows as the templates have words, and for
the blocks; the index is as large as the templates, which are a parameter, and is broadcast. Only documents with a word of some prefix have blocks.

Defined results: a null text counts as empty; rows are judged one by one, so repeated rows and ties in
ids don't matter; an empty table has all frequencies zero, and words of equal frequency go by the alphabet; without templates the phrases are left.
"""

from __future__ import annotations

from math import ceil
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, lower_ascii

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Well-known notices, label and words.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
        software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"""),
    ("mit", "released under the mit license"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
        software to deal in the software without restriction"""),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
        copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of
        any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no
        event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
        copyright notice and this permission notice appear in all copies"""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form
        must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with
        the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited
        to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be
        liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or
        services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort
        including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from
        the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and
        redistribute it freely"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute
        this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free
        software foundation either version 3 of the license or at your option any later version"""),
    ("lgpl", """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by
        the free software foundation either version 2 1 of the license or at your option any later version"""),
    ("agpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by
        the free software foundation either version 3 of the license or at your option any later version"""),
    ("mpl", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can
        obtain one at http mozilla org mpl 2 0"""),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
)
CONTAINMENT = 0.85
LEAST_BLOCK = 16


def needed(size: int) -> int:
    """How many of a template's distinct words a block must have."""
    return ceil(CONTAINMENT * size - 1e-9)


def block_step(words: str) -> int:
    """The least of 16, 32, 64, ... that isn't below the number of a template's words."""
    n = LEAST_BLOCK
    while n < len(words.split()):
        n *= 2
    return n


def words_text(text: Column) -> Column:
    """The words of a text, lower-cased and joined by single spaces."""
    return F.trim(F.regexp_replace(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def word_order(normal: DataFrame, templates) -> list[str]:
    """The templates' words, those in the fewest texts first. normal: a column `normal` of words_text()."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    counts = normal.select(F.explode(F.array_intersect(_strings(vocabulary), F.split("normal", " "))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}  # no more rows than the templates have words
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def _index(spark: SparkSession, ordered: list[tuple[str, int, list[str]]]) -> DataFrame:
    """(step, word, rank, label, words, need): the templates under each word of their prefixes."""
    rows = [F.struct(F.lit(label).alias("label"), F.lit(step).alias("step"), _strings(words).alias("words"), F.lit(needed(len(words))).alias("need")) for label, step, words in ordered]
    templates = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    prefix = F.slice("words", 1, F.size("words") - F.col("need") + 1)
    return templates.select("step", "label", "words", "need", F.posexplode(prefix).alias("rank", "word"))


def matched(rows: DataFrame, order: list[str], templates) -> DataFrame:
    """(key, labels, score) of rows(key, tokens), for those with a block that matches: the labels of the templates that name its blocks, and their largest share. order: as word_order() gives it."""
    rank = {w: i for i, w in enumerate(order)}
    ordered = [(label, block_step(t), sorted(set(t.split()), key=rank.get)) for label, t in templates]

    def blocks(step: int) -> Column:
        of_step = [words for _, s, words in ordered if s == step]
        vocabulary = sorted({w for words in of_step for w in words}, key=rank.get)
        starters = sorted({w for words in of_step for w in words[: len(words) - needed(len(words)) + 1]})
        window = lambda i: F.array_intersect(_strings(vocabulary), F.slice("tokens", i + 1, 2 * step))
        found = F.transform(F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(step)), lambda i: F.struct(F.lit(step).alias("step"), i.alias("at"), window(i).alias("block")))
        return F.filter(found, lambda b: (F.size(b["block"]) >= min(needed(len(words)) for words in of_step)) & F.arrays_overlap(b["block"], _strings(starters)))

    found = rows.select("key", F.explode(F.concat(*(blocks(step) for step in sorted({step for _, step, _ in ordered})))).alias("b")).select("key", "b.*")
    met = found.select("key", "step", "at", "block", F.posexplode("block").alias("place", "word")).join(F.broadcast(_index(rows.sparkSession, ordered)), ["step", "word"])
    size, need = F.size("block"), F.col("need")
    within = (F.col("place") <= size - need) & (F.least(F.size("words") - F.col("rank"), size - F.col("place")) >= need)
    share = F.size(F.array_intersect("words", "block"))
    met = met.where(within).withColumn("overlap", share).where("overlap >= need").select("key", "step", "at", "label", (F.col("overlap") / F.size("words")).alias("share"))
    # max of structs would take one label of several with the largest share
    best = met.groupBy("key", "step", "at").agg(F.max("share").alias("share"), F.collect_set(F.struct("label", "share")).alias("all"))
    named = F.transform(F.filter("all", lambda x: x["share"] == F.col("share")), lambda x: x["label"])
    return best.select("key", "share", F.explode(named).alias("label")).groupBy("key").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): score is the largest share of a template found, 1 where a phrase stands."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn("normal", words_text(F.col("text")))
    order = word_order(rows, templates)
    rank = {w: i for i, w in enumerate(order)}
    words = [sorted(set(t.split()), key=rank.get) for _, t in templates]
    starters = sorted({w for ws in words for w in ws[: len(ws) - needed(len(ws)) + 1]})

    padded = F.concat(F.lit(" "), F.col("normal"), F.lit(" "))
    worded = F.col("normal") != ""
    any_phrase = reduce(lambda a, b: a | b, (padded.contains(f" {p} ") for p in PHRASES))
    rows = rows.withColumn("tokens", F.split("normal", " ")).withColumns({"any_phrase": any_phrase, "any_block": F.arrays_overlap("tokens", _strings(starters))})

    def starts(phrase: str) -> Column:
        t = F.col("tokens")
        return F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: reduce(lambda a, b: a & b, ((F.get(t, i + k) == F.lit(w)).eqNullSafe(True) for k, w in enumerate(phrase.split()))))

    # equal texts have equal blocks, so the text's hash is key enough
    out = checkpointed(
        rows.select(
            "doc_id",
            F.when(worded, F.length("normal") - F.length(F.replace("normal", F.lit(" "))) + 1).otherwise(0).cast("bigint").alias("n_words"),
            *(F.when(F.col("any_phrase"), starts(p)).otherwise(F.array().cast("array<int>")).alias(f"p{k}") for k, p in enumerate(PHRASES)),
            F.when(F.col("any_block"), F.md5(F.col("text").cast("binary"))).alias("key"),
            F.when(F.col("any_block"), F.col("tokens")).alias("tokens"),
        )
    )
    places = F.concat(*(f"p{k}" for k in range(len(PHRASES))))
    based = F.array_compact(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values()))))
    out = out.select("doc_id", "n_words", "key", "tokens", places.alias("places"), based.alias("based"))
    held = out.where("key IS NOT NULL")
    found = matched(held.groupBy("key").agg(F.first("tokens").alias("tokens")), order, templates) if templates else None
    none = {"found": F.lit(None).cast("array<string>"), "share": F.lit(None).cast("double")}
    held = held.join(found, "key", "left") if templates else held.withColumns(none)
    columns = ["doc_id", "n_words", "places", "based", "found", "share"]
    out = held.select(*columns).unionByName(out.where("key IS NULL").withColumns(none).select(*columns))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        joined(F.col("based")).alias("base_labels"),
        joined(F.concat("based", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    values = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    norm = "trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"
    return f"""
WITH phrases(phrase, label) AS (VALUES {values(PHRASES.items())}),
templates(label, words, step, total) AS (SELECT label, words, step, len(words) FROM (SELECT label, list_distinct(string_split(words, ' ')) AS words, step FROM (VALUES {values((label, ' '.join(t.split()), block_step(t)) for label, t in TEMPLATES)}) AS v(label, words, step))),
d AS (SELECT doc_id, coalesce(text, '') AS text, string_split({norm.format("coalesce(text, '')")}, ' ') AS w FROM documents),
n AS (SELECT doc_id, text, list_filter(w, lambda x: x <> '') AS w FROM d),
places AS (
  SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM n), phrases
  WHERE w[i] = split_part(phrase, ' ', 1) AND array_to_string(w[i : i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word FROM places GROUP BY doc_id),
blocks AS (
  SELECT doc_id, step, i, list_distinct(w[i + 1 : i + 2 * step]) AS block
  FROM (SELECT doc_id, w, step, unnest(range(0, len(w), step)) AS i FROM n, (SELECT DISTINCT step FROM templates) WHERE len(w) > 0)),
shares AS (
  SELECT doc_id, step, i, label, len(list_intersect(block, words))::double / total AS share FROM blocks JOIN templates USING (step)
  WHERE len(list_intersect(block, words)) >= ceil({CONTAINMENT} * total - 1e-9)),
best AS (SELECT doc_id, label, share FROM shares QUALIFY share = max(share) OVER (PARTITION BY doc_id, step, i)),
matched AS (SELECT doc_id, label, max(share) AS share FROM best GROUP BY doc_id, label),
names AS (
  SELECT doc_id, list_sort(list_distinct(list(label) FILTER (base))) AS b, list_sort(list_distinct(list(label))) AS a
  FROM (SELECT doc_id, label, true AS base FROM places UNION ALL SELECT doc_id, label, false FROM matched) GROUP BY doc_id),
top AS (SELECT doc_id, max(share) AS share FROM matched GROUP BY doc_id)
SELECT n.doc_id, len(n.w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word,
  coalesce(array_to_string(b, ','), '') AS base_labels, coalesce(array_to_string(a, ','), '') AS labels,
  greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(share, 0.0))::double AS score
FROM n LEFT JOIN base USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN top USING (doc_id)
"""


SQL = _sql()
