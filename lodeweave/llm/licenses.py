"""License scans with a positional index of rare words, in DataFrame operations only.

Templates are whole public notices. The index holds, for each template, its words of highest IDF (over the templates) with
their positions. A file's highest-IDF licence words are looked up; each posting says where its template would begin, and a
template is a candidate at a place where enough of its rare words agree on it. A mandatory key phrase is then verified
word by word. Everything is an expression of the row: one scan, no shuffle, and time linear in the hits. A file without
any pair of words that a key phrase needs only has its words counted.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import documents

#: All but the ASCII characters that are neither digits nor letters, written as what stays: Java is twenty times slower on the complement.
WORD = r"[0-9a-z\x80-\x{10FFFF}]+"
ANY_CASE_WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"

#: Phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, mandatory key phrase, and the notice that holds it: public license notices in lower case, without punctuation.
TEMPLATES = [
    ("cc-by", "creative commons attribution 4 0 international", "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0 or send a letter to creative commons po box 1866 mountain view ca 94042 usa"),
    ("cc-by", "creative commons attribution 4 0 international", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    ("cc0", "cc0 1 0 universal", "this work is marked with cc0 1 0 universal to view a copy of this license visit https creativecommons org publicdomain zero 1 0"),
    ("mit", "under the mit license", "released under the mit license"),
    ("mit", "under the mit license", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-2.0", "gnu general public license version 2", "licensed under the gnu general public license version 2"),
    ("gpl-2.0", "gnu general public license as published by the free software foundation either version 2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "gnu general public license version 3", "licensed under the gnu general public license version 3"),
    ("gpl-3.0", "gnu general public license as published by the free software foundation either version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "gnu lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl", "gnu affero general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl-2.0", "mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("unlicense", "free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]
#: Rare words of a template; half of them, but this many at least, must agree on its place.
RARE_WORDS, LEAST_AGREED = 8, 3
#: Words that turn a notice round, up to NEAR words before its key phrase.
NEGATIONS, NEAR = ["not", "never", "longer", "isn"], 3
#: Places are from 0 to this, so that a template and a place are one number.
PLACES = 1 << 40


class Template:
    """A notice with its rare words: those of highest IDF, of equal ones the first, wherever they stand."""

    def __init__(self, label: str, key: str, words: str, idf: dict[str, float]):
        self.label, self.key, self.words = label, key.split(), words.split()
        n = len(self.key)
        self.key_at = next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key)
        self.weights = [idf[w] for w in self.words]
        self.rare = sorted(sorted(range(len(self.words)), key=lambda i: (-self.weights[i], i))[:RARE_WORDS])
        self.least = max(LEAST_AGREED, (len(self.rare) + 1) // 2)


def compiled() -> list[Template]:
    df = Counter(w for _, _, words in TEMPLATES for w in set(words.split()))
    idf = {w: math.log(1 + len(TEMPLATES) / n) for w, n in df.items()}
    return [Template(*t, idf) for t in TEMPLATES]


def needed(index: list[Template]) -> list[tuple[str, str]]:
    """Pairs of neighbouring words, one of which every file with a label has: the first of a base phrase, the rarest of a key phrase."""
    idf = {w: x for t in index for w, x in zip(t.words, t.weights, strict=True)}
    rarest = {max(pairwise(t.key), key=lambda p: (idf[p[0]] + idf[p[1]], p)) for t in index}
    return sorted(rarest | {tuple(p.split()[:2]) for p in BASE})


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    ``labels`` are those of the base phrases and of the templates found; ``score`` is the largest share of a template's IDF
    weight that stands in place. A null text counts as empty: 0 words, null positions, empty labels, score 0. Repeated rows and null
    ids give a row each, an empty table an empty result; other columns are ignored. Very long texts are looked up whole, hit by hit.
    """
    index = compiled()
    text = F.coalesce(F.col("__text"), F.lit(""))
    edge, between = r"0-9a-zA-Z\x80-\x{10FFFF}", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
    pairs = needed(index)
    begin = "".join(sorted({c for a, _ in pairs for c in (a[0], a[0].upper())}))
    indexed = text.rlike(rf"(?<![{edge}])(?=[{begin}])(?:{'|'.join(f'(?i:{a}){between}(?i:{b})' for a, b in pairs)})(?![{edge}])")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.when(F.col("__indexed"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)))

    postings: dict[str, list[tuple[int, int]]] = defaultdict(list)  # word to template and position
    for n, t in enumerate(index):
        for i in t.rare:
            postings[t.words[i]].append((n, i))
    literal = lambda x: f"'{x}'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else str(x)
    list_of = lambda kind, values: F.expr(f"cast(array({', '.join(map(literal, values))}) AS array<{kind}>)")
    entries = sorted(postings.items())
    numbers, starts = F.create_map(*(F.lit(x) for n, (w, _) in enumerate(entries) for x in (w, n))), [[n * PLACES - i for n, i in p] for _, p in entries]
    #: By template: its words, where its rare ones and its key phrase stand, the weights of its words.
    table = F.array(*(
        F.struct(F.lit(t.label).alias("label"), list_of("string", t.words).alias("words"), list_of("int", t.rare).alias("rare"), list_of("double", t.weights).alias("weights"), list_of("int", range(t.key_at, t.key_at + len(t.key))).alias("key"), F.lit(sum(t.weights)).alias("whole"), F.lit(t.least).alias("least"))
        for t in index
    ))
    at = lambda place, i: F.when(place + i >= 0, F.get(F.col("__words"), (place + i).cast("int")))
    stand = lambda t, place, positions: F.filter(positions, lambda i: at(place, i) == F.get(t["words"], i))
    template = lambda x: F.get(table, F.floor((x + PLACES // 2) / F.lit(PLACES)).cast("int"))
    place_of = lambda x: F.pmod(x + PLACES // 2, F.lit(PLACES)) - PLACES // 2

    def hit(w: Column, i: Column) -> Column:
        return F.when(w.isin([*postings, *(p.split()[0] for p in BASE)]), F.struct(w.alias("w"), i.alias("i")))

    def base_at(h: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in BASE.items():
            first, *rest = phrase.split()
            out = F.when(reduce(lambda a, b: a & b, [F.get(F.col("__words"), h["i"] + k) == r for k, r in enumerate(rest, 1)], h["w"] == first), F.lit(label)).otherwise(out)
        return F.when(out.isNotNull(), F.struct(h["i"].cast("long").alias("at"), out.alias("label")))

    def places(h: Column) -> Column:
        """Templates and places of a hit's postings at which enough rare words agree."""
        each = F.transform(F.get(F.array(*(list_of("bigint", p) for p in starts)), F.element_at(numbers, h["w"])), lambda s: s + h["i"])
        return F.filter(each, lambda x: F.size(stand(template(x), place_of(x), template(x)["rare"])) >= template(x)["least"])

    def verified(x: Column) -> Column:
        """Label and share of the template's IDF weight found in place; null unless the key phrase is whole and not turned round."""
        t, place = template(x), place_of(x)
        whole = F.size(stand(t, place, t["key"])) == F.size(t["key"])
        plain = reduce(lambda a, b: a & b, (~F.coalesce(at(place, F.get(t["key"], F.lit(0)) - k).isin(NEGATIONS), F.lit(False)) for k in range(1, NEAR + 1)))
        share = F.aggregate(stand(t, place, F.sequence(F.lit(0), F.size(t["words"]) - 1)), F.lit(0.0), lambda a, i: a + F.get(t["weights"], i)) / t["whole"]
        return F.when(whole & plain, F.struct(t["label"].alias("label"), share.alias("score")))

    part = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    part = part.select(id_col, F.regexp_count(text, F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"), indexed.alias("__indexed"), "__text")
    part = part.select(id_col, "n_words", words.alias("__words"))
    part = part.withColumn("__hits", F.filter(F.transform("__words", hit), lambda x: x.isNotNull()))
    part = part.withColumn("__base", F.filter(F.transform("__hits", base_at), lambda x: x.isNotNull()))
    found = F.array_distinct(F.flatten(F.transform(F.filter("__hits", lambda h: F.map_contains_key(numbers, h["w"])), places)))
    part = part.withColumn("__found", F.filter(F.transform(found, verified), lambda x: x.isNotNull()))
    base, found = F.transform("__base", lambda x: x["label"]), F.transform("__found", lambda x: x["label"])
    none = F.array().cast("array<string>")
    return part.select(
        id_col,
        "n_words",
        F.coalesce(F.array_size("__base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("__base", lambda x: x["at"])).alias("first_word"),
        F.array_max(F.transform("__base", lambda x: x["at"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.coalesce(base, none))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce(base, none), F.coalesce(found, none))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("__found", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every whole text of ``documents``."""
    return license_scan(documents(spark, sf_dir))


def _op10_sql() -> str:
    """Every template tried wherever its key phrase stands in a document, without the index."""
    df = Counter(w for _, _, words in TEMPLATES for w in set(words.split()))
    idf = {w: math.log(1 + len(TEMPLATES) / n) for w, n in df.items()}
    rows = []
    for label, key, words in TEMPLATES:
        t, k = words.split(), key.split()
        key_at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
        weights = [idf[w] for w in t]
        rare = sorted(sorted(range(len(t)), key=lambda i: (-weights[i], i))[:RARE_WORDS])  # noqa: B023
        rows.append(f"('{label}', {k}, {key_at}, {t}, {rare}, {max(LEAST_AGREED, (len(rare) + 1) // 2)}, {weights!r}::DOUBLE[], {sum(weights)!r}::DOUBLE)")
    first = sorted({x.split()[0] for _, x, _ in TEMPLATES} | {x.split()[0] for x in BASE})
    base = "CASE " + " ".join(f"WHEN w[i:i + {len(x.split()) - 1}] = {x.split()!r} THEN '{label}'" for x, label in BASE.items()) + " END"
    stands = "coalesce(CASE WHEN i - key_at + n > 0 THEN w[i - key_at + n] END = words[n + 1], false)"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT r, w, i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i] IN ({", ".join(f"'{x}'" for x in first)})),
b AS (SELECT r, i - 1 AS pos, {base} AS label FROM p),
t(label, key, key_at, words, rare, least, weights, whole) AS (VALUES {", ".join(rows)}),
f AS (SELECT r, label, list_sum([weights[n + 1] FOR n IN range(len(words)) IF {stands}]) / whole AS score FROM p JOIN t ON w[i] = key[1] AND w[i:i + len(key) - 1] = key
  WHERE len([n FOR n IN rare IF {stands}]) >= least AND len(list_intersect(w[greatest(1, i - {NEAR}):i - 1], {NEGATIONS})) = 0),
x AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b WHERE label IS NOT NULL GROUP BY r),
y AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b WHERE label IS NOT NULL UNION SELECT r, label FROM f) GROUP BY r),
z AS (SELECT r, max(score) AS score FROM f GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN x ON x.r = d.r LEFT JOIN y ON y.r = d.r LEFT JOIN z ON z.r = d.r"""


OP10_SQL = _op10_sql()
