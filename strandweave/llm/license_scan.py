"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license templates.

Tokens are pairs of neighbouring words, so that word order counts. A block is a stretch of ``BLOCK`` words, one starting
every ``STEP`` words of the whole text, across line breaks; every stretch as long as a template lies within one. A block
matches a template if it contains at least ``THRESHOLD`` of the template's distinct tokens. Tokens are ordered by how many
documents hold them, rarest first. A block that meets the threshold shares one of a template's first ``size - need + 1``
tokens (prefix filter), holds as many template tokens as are needed (length filter), and from the shared token on both
lists have enough tokens left (positional filter). What passes is counted in full, so the join is exact. All of it is
DataFrame functions; the templates and their tokens are a fixed, small table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import as_many_parts, settle, with_row_id

THRESHOLD = 0.8
#: Words of a block, and from one block's start to the next. No template has more words than ``BLOCK - STEP + 1``.
BLOCK, STEP = 256, 128

#: Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Wording of common licenses and notices and the labels they stand for. Where licenses differ in one word, a
#: template is so short that the threshold asks for all of its word pairs.
TEMPLATES = (
    ("agpl", "gnu affero general public license"),
    ("all-rights-reserved", "all rights reserved"),
    ("apache", "apache license version"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by", "cc by 4 0"),
    ("cc-by", "creative commons attribution 4 0"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("gpl", "the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("public-domain", "this work has been dedicated to the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
)

_SEP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WORD, GAP = f"[^{_SEP}]+", f"[{_SEP}]+"


def _lower() -> Column:
    """The text with A-Z, and nothing else, in lower case; null is empty."""
    return F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(template: str) -> list[str]:
    """The distinct word pairs of a template."""
    words = template.split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def _whole(words: str) -> str:
    """A pattern for words that stand by themselves, one after another."""
    return f"(?<![^{_SEP}])(?:{words})(?![^{_SEP}])".replace(" ", GAP)


def _between(words: str) -> str:
    """The same for a text with a blank at both ends; quicker, but it takes the characters around the words."""
    return f"[{_SEP}](?:{words})[{_SEP}]".replace(" ", GAP)


def _blocks(words: Column, known: Column) -> Column:
    """The known tokens that each block of a text holds, as a list of lists; null where the text holds none.

    ``words`` has one empty word at each end, from the blanks around the text.
    """
    count = F.size(words) - 2
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))), lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1)))
    starts = F.sequence(F.lit(0), F.greatest(count - (BLOCK - STEP) - 1, F.lit(0)), F.lit(STEP))

    def split(all_pairs: Column, held: Column) -> Column:
        each = F.transform(starts, lambda i: F.array_intersect(held, F.slice(all_pairs, i + 1, BLOCK - 1)))
        return F.when(F.size(held) > 0, F.when(count <= BLOCK, F.array(held)).otherwise(F.filter(each, lambda x: F.size(x) > 0)))

    return F.when(count >= 2, _bound(pairs, lambda p: _bound(F.array_intersect(known, p), lambda held: split(p, held))))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` uses it, also inside array functions."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    The score is 1 where a base phrase stands, else the largest containment of a template by a block of the
    document if that meets the threshold, else 0. A null text counts as empty: 0 words, no labels, score 0.
    Repeated rows are scanned each by itself; an empty table gives no row. Texts are read once; what they hold of the
    templates' tokens is written, counted over all documents (one count for each token comes to the driver) and joined.
    """
    if any(len(t.split()) > BLOCK - STEP + 1 for _, t in templates):
        raise ValueError(f"templates may have {BLOCK - STEP + 1} words at most; cut longer ones")
    vocabulary = sorted({x for _, t in templates for x in tokens(t)})
    padded = F.concat(F.lit(" "), _lower(), F.lit(" "))
    rows = docs.select(F.col("doc_id").cast("long"), padded.alias("low")).withColumn("words", F.split("low", GAP))
    places = [_whole(p) for p, _ in PHRASES]
    rows = rows.withColumn("_any", F.col("low").rlike(_between("|".join(p for p, _ in PHRASES))))
    rows = rows.withColumn("_n", F.when(F.col("_any"), F.array(*[F.regexp_count("low", F.lit(p)) for p in places])).otherwise(F.array(*[F.lit(0)] * len(places))))
    every = _whole("|".join(p for p, _ in PHRASES))

    def start(prefix: str) -> Column:
        return F.when(F.col("_any"), F.regexp_count(F.regexp_extract("low", f"(?s)^({prefix}){every}", 1), F.lit(WORD)).cast("long"))

    head = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    made = rows.select(
        "doc_id",
        (F.size("words") - 2).cast("long").alias("n_words"),
        F.aggregate("_n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_base"),
        start(".*?").alias("first_word"),
        start(".*").alias("last_word"),
        F.filter(F.array(*[F.when(F.get("_n", F.lit(i)) > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull()).alias("base"),
        _blocks(F.col("words"), F.array(*map(F.lit, vocabulary))).alias("blocks"),
    )
    made = settle(with_row_id(made, "_row"))
    counts = made.select(F.explode(F.array_distinct(F.flatten("blocks"))).alias("word")).groupBy("word").count().collect()
    count = {r["word"]: r["count"] for r in counts}
    order = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    rank = {w: n for n, w in enumerate(order)}
    index, prefix = [], set()
    for n, (label, text) in enumerate(templates):
        words = sorted(tokens(text), key=rank.get)
        need = next(k for k in range(len(words) + 1) if k >= threshold * len(words) - 1e-9)
        for at, w in enumerate(words[: len(words) - need + 1]):
            index.append((w, n, label, at, len(words), need, words))
            prefix.add(w)
    # A row for each prefix token of the fixed templates, so broadcast whatever the tables.
    index = docs.sparkSession.createDataFrame(index, "word string, template int, label string, at int, size int, need int, words array<string>")
    by_rank, first = F.array(*map(F.lit, order)), F.array(*map(F.lit, sorted(prefix)))
    hopeful = F.filter("blocks", lambda b: F.arrays_overlap(b, first))
    part = made.select("_row", F.explode(F.transform(hopeful, lambda b: F.array_intersect(by_rank, b))).alias("held"))
    part = part.select("_row", "held", F.posexplode("held").alias("pos", "word"))
    found = part.join(F.broadcast(index), "word")
    # Every shared prefix token proposes its template; the filters and the full count decide.
    before = F.least("at", "pos")  # as many shared tokens at most stand before this one in both lists
    left = F.least(F.col("size") - F.col("at"), F.size("held") - F.col("pos"))
    found = found.where((F.size("held") >= F.col("need")) & (before + left >= F.col("need")))
    found = found.withColumn("shared", F.size(F.array_intersect("held", "words"))).where("shared >= need")
    hits = found.groupBy("_row").agg(F.array_sort(F.collect_set("label")).alias("more"), F.max(F.col("shared") / F.col("size")).alias("best"))
    out = made.drop("blocks").join(hits, "_row", "left").select(
        *head[:-1],
        F.concat_ws(",", F.array_sort("base")).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
    return as_many_parts(out, docs)


def _sql_places() -> str:
    """Starts of each phrase among the words, as DuckDB finds them."""
    rows = []
    for phrase, label in PHRASES:
        words = phrase.split()
        same = " and ".join(f"w[i + {n}] = '{x}'" for n, x in enumerate(words, 1))
        rows.append(f"select r, '{label}' as label, unnest(list_filter(range(0, len(w) - {len(words) - 1}), lambda i: {same})) as place from d")
    return " union all ".join(rows)


def _sql_templates() -> str:
    return ", ".join(f"('{label}', {tokens(text)!r})" for label, text in TEMPLATES)


#: Every block is counted against every template, without any filter.
ORACLE = rf"""
with d as (
  select row_number() over () as r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, regexp_extract_all(low, '{WORD}') as w from documents),
b as (select r, count(*) as n_base, min(place) as first_word, max(place) as last_word, list(distinct label) as base from ({_sql_places()}) group by r),
block as (select r, unnest(list_transform(range(0, greatest(len(w) - {BLOCK - STEP}, 1), {STEP}), lambda i: w[i + 1:i + {BLOCK}])) as x from d),
pair as (select distinct r, list_sort(list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1]))) as x from block where len(x) > 1),
t as (select label, words from (values {_sql_templates()}) v(label, words)),
c as (select r, label, len(list_intersect(t.words, pair.x)) as shared, len(t.words) as size from pair, t),
h as (select r, max(shared / size) as best, list(distinct label) as more from c where shared >= ceil({THRESHOLD} * size - 1e-9) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') as labels,
  case when n_base > 0 then 1.0 else coalesce(best, 0) end::double as score
from d left join b using (r) left join h using (r)
"""
