"""License scans: lines and whole texts against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indicatrix.llm.common import Scratch

THRESHOLD = 0.8

#: Well-known notices and headers of public licences.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
            "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
                "either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Full licence texts, numbered behind TEMPLATES; they are compared as windows only.
FULL_TEXTS: list[tuple[str, str]] = [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def template_bigrams(text: str) -> list[str]:
    """Word bigrams of a template, each repeat with its number, as the columns below have them."""
    words = re.sub(r"[^\w]|_", " ", text.lower()).split()
    seen: Counter = Counter()
    out = []
    for pair in zip(words, words[1:]):
        seen[pair] += 1
        out.append(f"{pair[0]} {pair[1]} {seen[pair]}")
    return out


def normal_words(text: Column) -> Column:
    """Lower-case words of letters and digits; anything else parts words."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def bigrams(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))


def numbered(pairs: Column) -> Column:
    """Each bigram with how often it has occurred so far, so that sets of them intersect as multisets do."""
    return F.transform(pairs, lambda x, i: F.concat_ws(" ", x, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def passages(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every (row, line, template) whose Dice coefficient reaches the threshold: doc_id, line, license, template, dice.

    The passages of a text are its lines and, as line -1, the whole of a text of several lines. Dice is twice the shared bigrams over all bigrams,
    repeats counted. It can reach t only where the smaller count is at least t / (2 - t) of the larger: passages meet templates by an equi-join
    on their bigram count with the counts within these bounds, so most are pruned before any bigram is made. The number of distinct shared
    bigrams with the template's repeats bounds Dice from above and prunes again. Null and empty texts and lines of one word match nothing;
    repeated rows match as often as they occur; very long texts are compared only with templates as long. Notices of another extent are left to windows().
    """
    spark = docs.sparkSession
    kept = [(k, name, template_bigrams(text)) for k, (name, text) in enumerate(templates)]
    if not 0 < len(kept) <= 10_000:
        raise ValueError("between 1 and 10,000 templates")
    low = threshold / (2 - threshold)
    rows = [(n, k, name, len(pairs), pairs, sorted({p.rsplit(" ", 1)[0] for p in pairs}))
            for k, name, pairs in kept for n in range(max(1, math.ceil(len(pairs) * low - 1e-9)), math.floor(len(pairs) / low + 1e-9) + 1)]
    sizes = spark.createDataFrame(rows, "n int, template int, license string, m int, t_numbered array<string>, t_pairs array<string>")

    text = F.coalesce(docs["text"], F.lit(""))
    lines = F.split(text, r"\r\n|\n|\r")
    passages = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _let(lines, lambda x: F.when(F.size(x) > 1, F.concat(x, F.array(text))).otherwise(x)).alias("parts"))
    # words are made where lines are told apart: a filter on them is not pushed below and does not make them again
    spoken = passages.select("doc_id", F.size("parts").alias("n_parts"), F.posexplode(F.transform("parts", normal_words)).alias("at", "words")) \
        .select("doc_id", F.when((F.col("n_parts") > 1) & (F.col("at") == F.col("n_parts") - 1), -1).otherwise(F.col("at")).alias("line"), "words")
    fitting = spoken.where(F.size("words") - 1 >= min(r[0] for r in rows)).where(F.size("words") - 1 <= max(r[0] for r in rows)) \
        .select("doc_id", "line", (F.size("words") - 1).alias("n"), bigrams(F.col("words")).alias("pairs"))
    met = fitting.join(F.broadcast(sizes), "n")  # templates times the counts within their bounds: fixed by the templates
    shared = F.array_intersect("pairs", "t_pairs")
    bound = F.aggregate(F.transform(shared, lambda p: F.size(F.filter("t_numbered", lambda t: F.startswith(t, F.concat(p, F.lit(" ")))))), F.lit(0), lambda a, x: a + x)
    possible = met.where(2 * F.size(shared) > 0).where(2 * bound >= threshold * (F.col("n") + F.col("m")) - 1e-9)
    common = F.size(F.array_intersect(numbered(F.col("pairs")), F.col("t_numbered")))
    return possible.select("doc_id", "line", "license", "template", ((2 * common) / (F.col("n") + F.col("m"))).alias("dice")).where(F.col("dice") >= threshold)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sizes(pairs: list[str], threshold: float) -> tuple[int, int, int]:
    """Of a template's numbered bigrams: the least that a window at the threshold shares, the least different ones, and the most bigrams of such a window."""
    low, m = threshold / (2 - threshold), len(pairs)
    shared = max(1, math.ceil(threshold * (max(1, math.ceil(m * low - 1e-9)) + m) / 2 - 1e-9))
    distinct, left = 0, shared
    for n in sorted(Counter(p.rsplit(" ", 1)[0] for p in pairs).values(), reverse=True):
        distinct, left = distinct + (left > 0), left - n
    return shared, distinct, math.floor(m / low + 1e-9)


def _cover(kept: list[tuple[int, str, list[str]]], threshold: float) -> list[str]:
    """Words of which every window at the threshold of any template has one: so many bigrams of a template have one that a window cannot lack them all."""
    usual = {"the", "and", "for", "this", "that", "under", "with", "any", "not", "are", "all", "you", "may", "from", "which", "mit", "free", "work", "other", "your", "such", "have", "will"}
    plain = [Counter(tuple(p.rsplit(" ", 1)[0].split(" ")) for p in pairs) for _, _, pairs in kept]
    need = [len(pairs) - _sizes(pairs, threshold)[0] + 1 for _, _, pairs in kept]
    words, cost = set(), {w: 1000 if w in usual or len(w) < 3 and w != "cc" else 8 if len(w) == 3 else 1 for c in plain for pair in c for w in pair}
    while any(n > 0 for n in need):
        gain: Counter = Counter()
        for c, n in zip(plain, need):
            touched: Counter = Counter()
            for pair, times in c.items():
                if n > 0 and not words & set(pair):
                    touched.update(dict.fromkeys(pair, times))
            for w, times in touched.items():
                gain[w] += min(times, n) / n / cost[w]
        best = max(sorted(gain), key=lambda w: gain[w])
        need = [n - sum(times for pair, times in c.items() if best in pair and not words & set(pair)) for c, n in zip(plain, need)]
        words.add(best)
    return sorted(words)


def _covered(docs: DataFrame, kept: list[tuple[int, str, list[str]]], threshold: float) -> DataFrame:
    """doc_id and text of the rows with a word of _cover. A line or whole text at the threshold is a run of words at the threshold, so all passages lie in these rows."""
    cover = F.split(F.lit(" ".join(_cover(kept, threshold))), " ")  # one literal
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).where(F.arrays_overlap(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), cover))


def _windows(h: Column, m: Column, least: Column, most: Column, threshold: float) -> Column:
    """The windows that are reported of one text and template, from the places of the template's bigrams in ascending order."""
    end = "struct<pos:int,g:string,line:int,end_line:int,prev:int>"

    def longest(i: Column) -> Column:
        first = F.element_at(h, i)

        def step(a: Column, x: Column) -> Column:
            n = x["pos"] - first["pos"] + 1
            shared = a["shared"] + F.when((n <= most) & (x["prev"] < first["pos"]), 1).otherwise(0)
            dice = F.when(n <= most, 2 * shared / (n + m)).otherwise(F.lit(0.0))
            return F.struct(shared.alias("shared"), F.coalesce(a["reached"], F.when(dice >= threshold, x["pos"])).alias("reached"), F.greatest(a["dice"], dice).alias("dice"),
                            F.when(dice > a["dice"], x).otherwise(a["end"]).alias("end"))

        start = F.struct(F.lit(0).alias("shared"), F.lit(None).cast("int").alias("reached"), F.lit(0.0).alias("dice"), F.lit(None).cast(end).alias("end"))
        return F.aggregate(F.slice(h, i, F.least(most, F.size(h) - i + 1)), start, step,
                           lambda a: F.struct(first.alias("start"), a["reached"].alias("reached"), a["dice"].alias("dice"), a["end"].alias("end")))

    def begins(previous: Column) -> Column:
        """Enough places follow, and the bigram before is no place that would only make the run better: it is none, or it stands for one that then counts no more."""
        def begin(i: Column) -> Column:
            at, before = F.element_at(h, i)["pos"], F.get(h, i - 2)["pos"]
            return (F.get(h, i - 2 + least)["pos"] - at < most) & (F.coalesce(before < at - 1, F.lit(True)) | F.array_contains(previous, before))

        return F.filter(F.sequence(F.lit(1), F.size(h)), begin)

    dense = _let(F.transform(h, lambda x: x["prev"]), begins)
    reached = F.filter(F.transform(dense, longest), lambda x: x["reached"].isNotNull())
    one = f"struct<start:{end},reached:int,dice:double,end:{end}>"
    none = F.lit(None).cast(one)

    def state(done, behind, near, best) -> Column:
        return F.struct(done.alias("done"), behind.alias("behind"), near.alias("near"), best.alias("best"))

    def take(a: Column, x: Column) -> Column:
        over = a["best"].isNotNull() & (x["start"]["pos"] > a["near"])
        behind = F.when(over, a["best"]["end"]["pos"]).otherwise(a["behind"])
        done = F.when(over, F.concat(a["done"], F.array(a["best"]))).otherwise(a["done"])
        fresh = over | a["best"].isNull()
        return F.when(fresh, F.when(x["start"]["pos"] > behind, state(done, behind, x["reached"], x)).otherwise(state(done, behind, F.lit(0), none))).otherwise(
            state(a["done"], a["behind"], F.least(a["near"], x["reached"]), F.when(x["dice"] > a["best"]["dice"], x).otherwise(a["best"])))

    return F.aggregate(reached, state(F.array().cast(f"array<{one}>"), F.lit(0), F.lit(0), none), take, lambda a: F.concat(a["done"], F.filter(F.array(a["best"]), lambda x: x.isNotNull())))


def windows(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, full_texts: list[tuple[str, str]] = FULL_TEXTS, threshold: float = THRESHOLD,
            covered: bool = False) -> DataFrame:
    """The notices that are neither a line nor a whole text: runs of words of any extent, as passages() has them; line is the one where a run begins.

    A run at the threshold may begin at any word and have any length within the size bounds. Of each template, from left to right: among the runs through the place
    where the first of them is complete, the best (then the first, then the shortest) is reported, and the search goes on behind it; so runs that are reported do
    not meet, and every other one meets one of them. Runs in a line or whole text that passages() reports for the same licence
    are that notice and not reported again, but for full texts, which it does not compare. Only texts are read closely that have a word of _cover; templates meet them
    where enough bigrams are shared, and a run starts only where enough follow. covered: docs has only rows of _covered. Null and empty texts have no runs, repeated
    rows have theirs as often as they occur, very long texts are searched whole.
    """
    spark = docs.sparkSession
    kept = [(k, name, pairs) for k, (name, text) in enumerate([*templates, *full_texts]) if (pairs := template_bigrams(text))]
    if not kept:
        return spark.createDataFrame([], "doc_id long, line int, license string, template int, dice double")
    rows = []
    for k, name, pairs in kept:
        counts = sorted(Counter(p.rsplit(" ", 1)[0] for p in pairs).items())
        rows.append((k, name, k >= len(templates), len(pairs), *_sizes(pairs, threshold), [g for g, _ in counts], [n for _, n in counts]))
    kin = [[(len(pairs), pairs) for k, n, pairs in kept if n == r[1] and k < len(templates)] for r in rows]
    known = F.broadcast(spark.createDataFrame([(*r, x) for r, x in zip(rows, kin)], "template int, license string, is_full boolean, m int, least int, least_distinct int, most int, "
                                              "t_pairs array<string>, t_counts array<int>, kin array<struct<m:int,pairs:array<string>>>"))
    every = F.split(F.lit("\n".join(sorted({g for r in rows for g in r[7]}))), "\n")  # one literal

    near = docs if covered else _covered(docs, kept, threshold)
    words = F.flatten(F.transform(F.split("text", r"\r\n|\n|\r"), lambda line, at: F.transform(normal_words(line), lambda w: F.struct(w.alias("w"), at.alias("line")))))

    def hits(w: Column) -> Column:
        def hit(i: Column) -> Column:
            a, b = F.element_at(w, i), F.element_at(w, i + 1)
            return F.struct(i.alias("pos"), F.concat_ws(" ", a["w"], b["w"]).alias("g"), a["line"].alias("line"), b["line"].alias("end_line"))

        places = F.when(F.size(w) > 1, F.sequence(F.lit(1), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        return F.struct(F.size(w).alias("n_words"), F.transform(places, hit).alias("hits"))

    met = near.select("doc_id", "text", _let(words, hits).alias("x"))\
        .select("doc_id", "text", "x.n_words", "x.hits", F.array_intersect(F.col("x.hits")["g"], every).alias("shared")) \
        .select("doc_id", "text", "n_words", "shared", F.filter("hits", lambda x: F.array_contains("shared", x["g"])).alias("hits")) \
        .join(known, (F.size("shared") >= F.col("least_distinct")) & (F.size(F.array_intersect("shared", "t_pairs")) >= F.col("least_distinct")))  # templates are fixed

    def with_previous(h: Column) -> Column:
        """Each place with that of the same bigram so many places before as the template has it: a window shares this one unless it has that one, too."""
        def previous(x: Column, i: Column) -> Column:
            before = F.get(h, i - F.element_at("t_counts", F.array_position("t_pairs", x["g"]).cast("int")))
            return x["at"].withField("prev", F.when(before["g"] == x["g"], before["pos"]).otherwise(0))

        return F.array_sort(F.transform(h, previous))

    own = F.array_sort(F.transform(F.filter("hits", lambda x: F.array_contains("t_pairs", x["g"])), lambda x: F.struct(x["g"].alias("g"), x["pos"].alias("pos"), x.alias("at"))))
    found = _let(_let(own, with_previous), lambda h: _windows(h, F.col("m"), F.col("least"), F.col("most"), threshold))
    out = met.select("license", "template", "is_full", "kin", "doc_id", "text", "n_words", F.explode(found).alias("x"))

    def reported(passage: Column) -> Column:
        """Whether passages() reports the passage for the licence of the row."""
        def reach(n: Column, pairs: Column) -> Column:
            fits = F.exists("kin", lambda t: (n <= t["m"] / low + 1e-9) & (n >= t["m"] * low - 1e-9))
            return F.when(fits, _let(numbered(pairs), lambda own: F.exists("kin", lambda t: 2 * F.size(F.array_intersect(own, t["pairs"])) / (n + t["m"]) >= threshold))).otherwise(False)

        return _let(normal_words(passage), lambda w: F.when(F.size(w) < 2, False).otherwise(_let(bigrams(w), lambda pairs: reach(F.size(pairs), pairs))))

    low = threshold / (2 - threshold)
    s, e = F.col("x")["start"], F.col("x")["end"]
    lines = F.split("text", r"\r\n|\n|\r")
    in_line = F.when(s["line"] == e["end_line"], reported(F.get(lines, s["line"]))).otherwise(False)
    in_whole = F.when(F.col("n_words") <= max(most for *_, most, _, _ in rows) + 1, reported(F.col("text"))).otherwise(False)
    return out.where(F.col("is_full") | ~(in_line | in_whole)).select("doc_id", s["line"].cast("int").alias("line"), "license", "template", F.col("x")["dice"].alias("dice"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, full_texts: list[tuple[str, str]] = FULL_TEXTS) -> DataFrame:
    """Every licence notice: lines and whole texts that reach the threshold, and runs of words inside longer lines or over several lines, also of full licence texts.

    Every text is searched once for the words of _cover; the rows that have one are written to the checkpoint folder, and both searches read them there.
    """
    kept = [(k, name, pairs) for k, (name, text) in enumerate([*templates, *full_texts]) if (pairs := template_bigrams(text))]
    if kept:
        docs = Scratch(docs.sparkSession, "licenses").keep(_covered(docs, kept, threshold), "covered")
    return passages(docs, templates, threshold).unionByName(windows(docs, templates, full_texts, threshold, covered=bool(kept)))


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    values = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(templates))
    return f"""
WITH template(template, license, body) AS (VALUES {values}),
line AS (
  SELECT rowid, doc_id, unnest(string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r')) AS body, generate_subscripts(string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r'), 1) - 1 AS line
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
  UNION ALL
  SELECT rowid, doc_id, text, -1 FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents) WHERE len(string_split_regex(text, '\\r\\n|\\n|\\r')) > 1),
passage AS (SELECT row_number() OVER () AS p, doc_id, line, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM line),
short AS (SELECT * FROM passage WHERE len(w) BETWEEN 2 AND 400),
pair AS (SELECT p, doc_id, line, len(w) - 1 AS n, unnest(list_zip(w[1:len(w) - 1], w[2:len(w)])) AS g FROM short),
counted AS (SELECT p, doc_id, line, n, g, count(*) AS c FROM pair GROUP BY ALL),
t AS (SELECT template, license, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM template),
tpair AS (SELECT template, license, len(w) - 1 AS m, unnest(list_zip(w[1:len(w) - 1], w[2:len(w)])) AS g FROM t),
tcounted AS (SELECT template, license, m, g, count(*) AS c FROM tpair GROUP BY ALL),
dice AS (
  SELECT p, doc_id, line, license, template, 2.0 * sum(least(counted.c, tcounted.c)) / any_value(n + m) AS dice
  FROM counted JOIN tcounted USING (g) GROUP BY p, doc_id, line, license, template)
SELECT doc_id, CAST(line AS INTEGER) AS line, license, CAST(template AS INTEGER) AS template, CAST(dice AS DOUBLE) AS dice FROM dice WHERE dice >= {threshold}
"""
