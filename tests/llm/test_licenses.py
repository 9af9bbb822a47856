import random
import re
import textwrap
from collections import Counter

from pyspark.sql import functions as F

from indicatrix.llm import licenses


def test_lines_and_whole_texts(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200)
    rows = [(1, "Some prose.\nReleased under the MIT License.\nMore."), (2, "Licensed under the Apache License Version 2.0"), (3, mit.replace(", ", ",\n")), (4, "Released under no license."), (5, None), (6, "")]
    got = {(r["doc_id"], r["line"], r["license"], round(r["dice"], 3)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, 1, "MIT", 1.0), (2, 0, "Apache-2.0", 1.0), (3, -1, "MIT", 1.0)} <= got
    assert {g[0] for g in got} == {1, 2, 3}


def test_repeated_bigrams_count_once_each(spark):
    rows = [(1, "a b a b a b"), (2, "a b c d e f")]
    got = [tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), [("x", "a b a b a b")]).select("doc_id", "dice").collect()]
    assert got == [(1, 1.0)]


def test_odd_rows(odd_docs, no_docs):
    assert licenses.scan(odd_docs).count() == 0 and licenses.scan(no_docs).count() == 0


def brute_windows(words, pairs):
    """(start, end) -> Dice of every run of words that reaches the threshold."""
    have = [" ".join(p) for p in zip(words, words[1:])]
    want = Counter(p.rsplit(" ", 1)[0] for p in pairs)
    out = {}
    for a in range(len(have)):
        for b in range(a + 1, len(have) + 1):
            dice = 2 * sum((Counter(have[a:b]) & want).values()) / (b - a + len(pairs))
            if dice >= licenses.THRESHOLD:
                out[a, b] = dice
    return out


def test_wrapped_notices_and_notices_in_longer_lines(spark):
    mit, gpl = (next(t for n, t in licenses.TEMPLATES if n == name and len(t) > 200) for name in ("MIT", "GPL-3.0"))
    full = dict(licenses.FULL_TEXTS)
    code = "\n".join(f"x{k} = f(x{k + 1}, {k})" for k in range(300))
    rows = [(1, "The MIT License\n\nCopyright (c) 2020 A. Person\n\n" + full["MIT"]), (2, code + "\n" + "\n".join("# " + line for line in textwrap.wrap(gpl, 70)) + "\n" + code),
            (3, "See below for what is allowed here and what is not: Released under the MIT License. All else is prose."), (4, code), (5, "\n".join(textwrap.wrap(mit, 80)) + "\n" + code + "\n" + mit),
            (6, "Preamble of ours.\n" + full["Apache-2.0"] + code)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["line"], round(r["dice"], 3), r["template"] >= len(licenses.TEMPLATES)))
    assert ("MIT", 4, 1.0, True) in got[1] and ("MIT", 4, 1.0, False) in got[1]
    assert got[2] == [("GPL-3.0", 300, 1.0, False)] and ("MIT", 0, 1.0, False) in got[3] and 4 not in got
    assert len([x for x in got[5] if x[0] == "MIT" and x[2] == 1.0]) == 2
    assert any(x[0] == "Apache-2.0" and x[3] and x[2] == 1.0 for x in got[6])


def test_windows_against_all_windows(spark):
    rng = random.Random(3)
    templates = [("x", "a b c a b d e"), ("y", "q r s t"), ("z", "a a a b")]
    rows = [(k, "".join(rng.choice("abcabdeqrst") + rng.choice("  \n") for _ in range(rng.randrange(1, 60)))) for k in range(150)]
    rows += [(k + 150, " ".join(rng.choice(["a b c a b d e", "q r s t", "a a a b", "n", "a b"]) for _ in range(8))) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = licenses.scan(docs, templates, full_texts=[]).groupBy("doc_id", "template").agg(F.collect_list("dice").alias("d")).collect()
    got = {(r["doc_id"], r["template"]): r["d"] for r in found}
    for k, text in rows:
        words = re.findall(r"[a-z]+", text)
        for n, (_, body) in enumerate(templates):
            brute = brute_windows(words, licenses.template_bigrams(body))
            assert bool(brute) == ((k, n) in got)  # each template has a licence of its own here
            if brute:
                assert all(any(abs(d - b) < 1e-9 for b in brute.values()) for d in got[k, n])
                count, behind = 0, -1  # as many runs apart from each other as there can be, or fewer where better ones are longer; at least the best one of all
                for a, b in sorted(brute, key=lambda x: x[1]):
                    if a >= behind:
                        count, behind = count + 1, b
                assert count == 1 or len(got[k, n]) * 2 >= count
