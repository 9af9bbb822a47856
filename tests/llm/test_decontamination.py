from collections import Counter

from indicatrix.llm import decontamination


def shingles(words):
    return [tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))]


def brute(rows, items):
    out = {}
    for d, text in rows:
        words = (text or "").lower().split()
        mine = shingles(words)
        for i, item in items:
            short = item.lower().split()
            if len(short) < 5:  # found as its words in a row, in texts of any length
                if any(words[k:k + len(short)] == short for k in range(len(words) - len(short) + 1)):
                    out[d, i] = 1.0
                continue
            theirs = Counter(shingles(short))
            n = sum(theirs.values())
            for k in range(max(1, len(mine) - n + 1)) if words else ():
                window = Counter(mine[k:k + n])
                shared = sum((window & theirs).values())
                likeness = shared / (sum(window.values()) + n - shared)
                if likeness >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), likeness)
    return out


def found(docs, benchmark):
    return {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(docs, benchmark).collect()}


def test_against_all_windows(spark, documents, texts):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    assert found(documents, benchmark) == brute(texts, items)


def test_changed_moved_and_short_passages(spark):
    item = " ".join(f"w{k}" for k in range(40))
    words = item.split()
    docs = [(1, "before it " + item + " after it"), (2, "x " * 30 + " ".join(words[:20] + ["new"] + words[20:]) + " y" * 30), (3, " ".join(words[:38])), (4, " ".join(words[:20])),
            (5, " ".join(words[20:] + words[:20])), (6, None), (7, ""), (8, item.upper()), (9, "yes no"), (10, "well yes no well"), (11, "alone"), (12, " ".join(words[::-1]))]
    items = [(1, item), (2, "yes no"), (3, "alone"), (4, None), (5, ""), (6, "a b c d e f a b c d e f a b c d e f")]
    docs += [(13, "z " + "a b c d e f " * 3 + "z"), (14, "a b c d e f " * 2)]
    made = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + items[:1], "item_id long, text string")
    assert found(*made) == brute(docs, [i for i in items if i[1]])


def test_odd_rows(spark, odd_docs, no_docs):
    benchmark = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the river bank today.")], "item_id long, text string")
    assert found(odd_docs, benchmark) == {(1, 1): 1.0} and found(no_docs, benchmark) == {} and found(odd_docs, benchmark.limit(0)) == {}
    kept = decontamination.without_contaminated(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1


def test_items_of_few_words_and_items_without_an_id(spark):
    long_item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, "a b c yes no d"), (2, "yes a no b c d"), (3, "word"), (4, "w x y z it is so now"), (5, f"x {long_item} y"), (6, "yes no")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes no"), (2, "it"), (3, "Y z it"), (4, "y z it is"), (None, long_item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start_word"], r["n_words"], r["similarity"]) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(1, 1, 3, 2, 1.0), (6, 1, 0, 2, 1.0), (4, 2, 4, 1, 1.0), (4, 3, 2, 3, 1.0), (4, 4, 2, 4, 1.0), (5, None, 1, 12, 1.0)}
    assert {r["doc_id"] for r in decontamination.without_contaminated(docs, items).collect()} == {2, 3}


def test_a_long_text_of_one_repeated_word_and_repeated_rows(spark):
    long_item = " ".join(f"w{k % 7}" for k in range(60))
    texts = [(1, "the " * 20_000), (1, "the " * 20_000), (2, "w0 w1 w2 w3 w4 w5 w6 " * 700), (None, "see the end"), (None, "see the end"), (None, "nothing")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, long_item), (2, "the end")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start_word"], r["n_words"], r["similarity"]) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(1, 1, 0, 1, 1.0), (2, 2, 0, 60, 1.0), (None, 1, 1, 1, 1.0), (None, 2, 1, 2, 1.0)}


def test_items_in_lots(spark, documents, monkeypatch):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = found(documents, benchmark)
    monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", 70)
    monkeypatch.setattr(decontamination, "WORDS_AT_ONCE", 40)
    monkeypatch.setattr(decontamination, "LANE_MAX", 20)
    items = benchmark.limit(3)
    ids = {r["item_id"] for r in items.collect()}
    assert found(documents, items) == {k: v for k, v in whole.items() if k[1] in ids}
