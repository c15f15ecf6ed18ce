"""License scans: exact phrases, and a positional index of the rarest licence words.

Each template is a notice or a whole licence with mandatory key phrases. Document
frequencies of all template words are counted over all documents; a template is
indexed by its words of highest IDF and all their positions. In a file every such
word votes for (template, place where the template would start). Starts fall into
windows that overlap by half, so votes that inserted or missing words moved apart
by up to half a window still meet; a word counts once in a window. A window with
enough weight is a candidate, and a label needs all its key phrases near it.
Time is near to linear in the length of a text.
"""

from __future__ import annotations

import json
import math
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_of
from graphloom.llm.licensetexts import WHOLE
from graphloom.llm.spans import let

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: (label, notice, key phrases)
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)
#: Indexed words of a template: at least RARE, or one of PER of its different words; none below COMMON of the highest IDF.
RARE, PER, COMMON = 5, 6, 0.25
#: Share of a template's indexed weight that must meet in one window.
ENOUGH = 0.6
#: Words around a window in which key phrases count.
SLACK = 3
#: Cells of the look-up of indexed words by checksum.
CELLS = 4096


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SEPARATOR, text.translate(str.maketrans(UPPER, LOWER))) if w]


#: (label, words, key phrases)
INDEXED = [(label, words_of(text), keys) for label, text, keys in (*TEMPLATES, *WHOLE)]


def half_window(words: list[str]) -> int:
    """Votes that lie at most so far apart share a window."""
    return max(4, len(words) // 4)


def vocabulary() -> list[str]:
    return sorted({w for _, words, _ in INDEXED for w in words})


def build_index(frequency: dict[str, int], n: int) -> list[list[tuple[str, list[int], float]]]:
    """Per template its words of highest IDF: (word, its positions, share of the weight)."""
    index = []
    for _, words, _ in INDEXED:
        idf = {w: math.log(1 + n / (frequency.get(w, 0) + 1)) + 0.01 for w in words}
        rare = sorted(idf, key=lambda w: (-idf[w], w))[: max(RARE, len(idf) // PER)]
        rare = [w for w in rare if idf[w] >= COMMON * idf[rare[0]]]
        total = sum(idf[w] for w in rare)
        index.append([(w, [i for i, x in enumerate(words) if x == w], round(idf[w] / total, 6)) for w in rare])
    return index


def _with_words(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_w", F.array_remove(F.split(F.translate(text_of(text), UPPER, LOWER), SEPARATOR), ""))


def frequencies(df: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """Document frequency of every template word, and the number of documents. A row of a few hundred counts, whatever the input."""
    words = vocabulary()
    known = F.from_json(F.lit(str(words).replace("'", '"')), F.lit("array<string>"))
    held = _with_words(df, text).select(F.explode(F.concat(F.array_intersect(known, F.col("_w")), F.array(F.lit("")))).alias("w"))
    counts = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return counts, counts.pop("", 0)


def _phrase_places(words: str, phrase: str) -> Column:
    """Word positions where a phrase's words stand consecutively."""
    parts = phrase.split()

    def test(w: Column, i: Column) -> Column:
        hit = w == parts[0]
        for k, part in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + k) == part)
        return F.when(hit, i.cast("bigint"))

    return F.filter(F.transform(words, test), lambda x: x.isNotNull())


def scan(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: word count, exact phrases, labels and the best verified template's share as score.

    A null or empty text has no words and no labels, a score of 0; equal rows give equal results.
    """
    frequency, n = frequencies(df, text)
    index = build_index(frequency, n)
    rare = sorted({word for entries in index for word, _, _ in entries})
    postings = [[{"t": t, "at": at, "h": half_window(INDEXED[t][1]), "w": weight} for t, entries in enumerate(index) for w, places, weight in entries if w == word for at in places] for word in rare]
    cells = [[] for _ in range(CELLS)]
    for k, word in enumerate(rare):
        cells[zlib.crc32(word.encode()) % CELLS].append(k)
    constant = lambda x, kind: F.from_json(F.lit(json.dumps(x)), F.lit(kind))
    table, known, cells = constant(postings, "array<array<struct<t:int,at:int,h:int,w:double>>>"), constant(rare, "array<string>"), constant(cells, "array<array<int>>")
    column = text_of(text)
    df = df.select(F.col(id_column).alias("doc_id"), column.alias("_t"))
    df = _with_words(df, "_t")
    lowered = F.lower("_t")
    df = df.withColumn("_maybe", lowered.contains("license") | lowered.contains("nc")).drop("_t")
    none = F.expr("cast(array() as array<bigint>)")
    df = df.withColumns({f"_p{k}": F.when(F.col("_maybe"), _phrase_places("_w", phrase)).otherwise(none) for k, (phrase, _) in enumerate(PHRASES)})
    # Indexed words and where they stand; most words end at an empty cell.
    cell = lambda w: F.get(cells, F.pmod(F.crc32(w.cast("binary")), F.lit(CELLS)).cast("int"))
    hits = F.filter(F.transform("_w", lambda w, i: F.struct(cell(w).alias("ks"), i.alias("i"), w.alias("w"))), lambda x: F.size(x["ks"]) > 0)

    def votes(hit: Column) -> Column:
        def two(k: Column, p: Column) -> Column:
            at = F.floor((hit["i"] - p["at"]) / p["h"]).cast("int")
            return F.array(*[F.struct(p["t"].alias("t"), b.alias("b"), k.alias("k"), p["w"].alias("w")) for b in (at - 1, at)])

        mine = F.filter(hit["ks"], lambda k: F.get(known, k) == hit["w"])
        return F.flatten(F.transform(mine, lambda k: F.flatten(F.transform(F.get(table, k), lambda p: two(k, p)))))

    # Sorted, so that the votes of a window, and in it those of a word, are neighbours.
    df = df.withColumn("_h", hits)
    df = df.withColumn("_v", F.when(F.size("_h") > 0, F.sort_array(F.flatten(F.transform("_h", votes))))).drop("_h")

    def first(x: Column, i: Column) -> Column:
        last = F.get("_v", i - 1)
        return F.when((i == 0) | (last["t"] != x["t"]) | (last["b"] != x["b"]), i)

    df = df.withColumn("_n", F.array_compact(F.transform("_v", first)))

    def window(at: Column, j: Column) -> Column:
        def weighed(run: Column) -> Column:
            new = lambda acc, v: F.struct(v["k"].alias("k"), (acc["w"] + F.when(acc["k"] == v["k"], 0.0).otherwise(v["w"])).alias("w"))
            weight = F.aggregate(run, F.struct(F.lit(-1).alias("k"), F.lit(0.0).alias("w")), new, lambda acc: acc["w"])
            return F.struct(F.element_at(run, 1)["t"].alias("t"), F.element_at(run, 1)["b"].alias("b"), weight.alias("w"))

        return let(F.slice("_v", at + 1, F.coalesce(F.get("_n", j + 1), F.size("_v")) - at), weighed)

    df = df.withColumn("_c", F.filter(F.transform("_n", window), lambda c: c["w"] >= ENOUGH - 1e-9)).drop("_v", "_n")

    def holds(keys: tuple[str, ...]):
        return lambda x: F.array_min(F.array(*[x.contains(f" {key} ") for key in keys]))

    def verified(c: Column) -> Column:
        ok = F.lit(False)
        for t, (_, words, keys) in enumerate(INDEXED):
            half = half_window(words)
            start = F.greatest(c["b"] * half - SLACK, F.lit(0))
            end = F.greatest((c["b"] + 2) * half + len(words) + SLACK, F.lit(0))
            near = F.concat(F.lit(" "), F.array_join(F.slice("_w", start + 1, F.greatest(end - start, F.lit(0))), " "), F.lit(" "))
            ok = F.when(c["t"] == t, let(near, holds(keys))).otherwise(ok)
        return ok

    df = df.withColumn("_c", F.when(F.size("_c") > 0, F.filter("_c", verified)))
    names = F.array(*[F.lit(label) for label, _, _ in INDEXED])
    ours = F.coalesce(F.transform("_c", lambda c: F.get(names, c["t"])), F.expr("cast(array() as array<string>)"))
    base = F.filter(F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    everywhere = F.concat(*[f"_p{k}" for k in range(len(PHRASES))])
    return df.select(
        "doc_id", F.size("_w").cast("bigint").alias("n_words"), F.size(everywhere).cast("bigint").alias("n_base"),
        F.array_min(everywhere).alias("first_word"), F.array_max(everywhere).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.sort_array(F.array_distinct(F.concat(base, ours))), ",").alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("_c", lambda c: c["w"])), F.lit(0.0))).alias("score"),
    )


def scan_text(text: str | None, index: list[list[tuple[str, list[int], float]]]) -> dict:
    """The same for one text in plain Python: the brute force of the tests."""
    words = words_of(text or "")
    places, base, ours, best = [], set(), set(), 0.0
    for phrase, label in PHRASES:
        parts = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += found
        base |= {label} if found else set()
    for (label, template, keys), entries in zip(INDEXED, index, strict=True):
        half = half_window(template)
        starts = {word: {i - at for i, w in enumerate(words) if w == word for at in ats} for word, ats, _ in entries}
        for low in range(-len(template) // half * half - 2 * half, len(words) + half, half):
            weight = sum(w for word, _, w in entries if any(low <= s < low + 2 * half for s in starts[word]))
            near = f" {' '.join(words[max(0, low - SLACK) : max(0, low + 2 * half + len(template) + SLACK)])} "
            if weight >= ENOUGH - 1e-9 and all(f" {k} " in near for k in keys):
                ours.add(label)
                best = max(best, weight)
    return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | ours)), "score": min(1.0, best)}
