import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from indicatrix.llm import token_files

VOCABULARY = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(VOCABULARY)


def ids_of(tokenizer, texts):
    return [e.ids + [1] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_word_by_word_is_the_librarys_encoding(tokenizer):
    rng = random.Random(1)
    parts = list("aAbBzZ09.,!?;:$%'<|> \n\t ́Σß é🙂İ") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s ", "'LL", "n't", "the ", "x, "]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)]
    encoder = token_files.WordEncoder(VOCABULARY, 1)
    for k in range(0, len(made), 500):
        ids, counts = encoder.encode(pa.array(made[k:k + 500]))
        expected = ids_of(tokenizer, made[k:k + 500])
        assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


def test_a_worker_encodes_a_word_once(tokenizer, monkeypatch):
    """The next task of a worker has the same encoder, and words that are known already do not count as new ones."""
    monkeypatch.setattr(token_files, "KEPT_WORDS", 100)
    made, groups = [" ".join(f"{a}{b}" for a in "abcdefghij" for b in "klmnop")], []
    encoder = token_files.kept_encoder(VOCABULARY, 1)
    library = encoder.tokenizer

    class Counted:
        def encode_batch(self, texts, **more):
            groups.append(texts)
            return library.encode_batch(texts, **more)

    monkeypatch.setattr(encoder, "tokenizer", Counted())
    for _ in range(3):
        assert token_files.kept_encoder(VOCABULARY, 1).encode(pa.array(made))[0].tolist() == ids_of(tokenizer, made)[0]
    assert len(groups) == 1
    other = [" ".join(f"{a}{b}" for a in "qrstuvwxyz" for b in "klmnop")]  # too many for both: the older ones are forgotten
    for texts in (other, made, made + other):
        assert encoder.encode(pa.array(texts))[0].tolist() == [i for e in ids_of(tokenizer, texts) for i in e]


def test_index_from_the_files(documents, texts, tokenizer):
    rows, start = [], 0
    for (doc_id, _), ids in zip(texts, ids_of(tokenizer, [t for _, t in texts])):
        rows.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.written_index(documents, VOCABULARY, 1).collect()) == rows


def test_one_document_and_small_packs(spark, documents, texts, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PACK_IDS", 3000)
    token_files.write_packs(documents, str(tmp_path), VOCABULARY, 1)
    for doc_id, text in texts[:3]:
        assert token_files.document_ids(spark, str(tmp_path), doc_id) == ids_of(tokenizer, [text])
    packs = spark.read.parquet(f"{tmp_path}/packs")
    dictionary = spark.read.parquet(f"{tmp_path}/dictionary").first()
    assert {r["dict_hash"] for r in packs.collect()} == {token_files.dict_hash(bytes(dictionary["dictionary"]))} and len(dictionary["dictionary"]) > 1000
    order = [d for r in packs.orderBy("shard", "pack").collect() for d in r["doc_ids"]]
    assert order == sorted(order)


def test_odd_rows(odd_docs, no_docs, tokenizer):
    got = sorted((r["start"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.written_index(odd_docs, VOCABULARY, 1).collect())
    rows = [(-1 if r["doc_id"] is None else r["doc_id"], ids_of(tokenizer, [r["text"] or ""])[0]) for r in odd_docs.collect()]
    assert sorted((d, n, c) for _, d, n, c in got) == sorted((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in rows)
    assert [d for _, d, _, _ in got] == sorted(d for d, _ in rows) and got[-1][0] + got[-1][2] == sum(len(i) for _, i in rows)
    assert token_files.written_index(no_docs, VOCABULARY, 1).count() == 0
