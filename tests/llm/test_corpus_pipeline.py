import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage."""
    sf_dir = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    folder = tmp_path_factory.mktemp("stages")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, sf_dir)
        after.write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out[name] = docs, after
        docs = after
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_order(stages):
    names = list(stages)
    assert names == ["quality classifier", "near-duplicates", "substring dedup", "benchmark decontamination", "pieces"]
    for name in names[:-1]:
        before, after = stages[name]
        assert sorted(after.columns) == sorted(before.columns)


def test_each_stage_takes_effect_and_keeps_the_rest(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    before, after = map(rows, stages["quality classifier"])
    good = [d for d in before if labels.get(d) == 1]
    assert len(good) - sum(d in after for d in good) <= 0.01 * len(good) and all(after[d] == before[d] for d in after)
    assert sum(d in after for d in before if labels.get(d) == 0) < 0.3 * sum(labels.get(d) == 0 for d in before)

    from test_dart_minhash import brute as classes
    from test_decontamination import brute as leaks
    from test_substrings import brute as repeats

    before, after = map(rows, stages["near-duplicates"])
    assert sorted(after) == sorted({c for _, c in classes(sorted(before.items()))})
    before, after = map(rows, stages["substring dedup"])
    cut = {d: n for d, _, n, _ in repeats(sorted(before.items()))}
    assert all((after[d] == before[d]) == (cut[d] == 0) and len(after[d].split()) == len(before[d].split()) - cut[d] for d in before) and any(cut.values())
    before, after = map(rows, stages["benchmark decontamination"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    assert set(before) - set(after) == {d for d, _ in leaks(sorted(before.items()), items)}
    before, after = map(rows, stages["pieces"])
    assert before == after and stages["pieces"][1].where("n_pieces != size(piece_ids)").count() == 0


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.01").select("doc_id").exceptAll(stages["pieces"][1].select("doc_id")).isEmpty()


def test_columns_named_like_the_new_ones_stay(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a small text", 7, "x"), (2, None, None, None), (3, "", 8, "y")], "doc_id long, text string, N_Pieces int, piece_ids string")
    after = corpus_pipeline.as_pieces(spark, docs, "")
    assert after.columns == ["doc_id", "text", "N_Pieces", "piece_ids", "n_pieces_", "piece_ids_"]
    after.write.parquet(f"{tmp_path}/out")
    kept = {r["doc_id"]: (r["N_Pieces"], r["piece_ids"], r["n_pieces_"] == len(r["piece_ids_"] or [])) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert kept == {1: (7, "x", True), 2: (None, None, True), 3: (8, "y", True)}


def test_few_texts_at_a_time(spark, monkeypatch, tmp_path):
    """Whole texts are long rows: in every stage with texts a worker gets some of them at a time, however many its task has, whoever writes the stage's rows."""
    def looked_at(batches):
        for batch in batches:
            if batch.num_rows > 7:
                raise ValueError(f"{batch.num_rows} rows at a time")
            yield batch

    quality, pieces = corpus_pipeline.quality, corpus_pipeline.pieces
    monkeypatch.setattr(corpus_pipeline, "TEXT_ROWS", 7)
    monkeypatch.setattr(pieces, "TEXT_ROWS", 7)
    monkeypatch.setattr(corpus_pipeline, "quality_model", lambda *_: quality.Classifier(b"", b"", None, 0.5))
    for module, name in ((quality, "accepted"), (pieces, "encode"), (pieces, "decode")):
        monkeypatch.setattr(module, name, lambda df, *rest, whole=getattr(module, name): whole(df.mapInArrow(looked_at, df.schema), *rest))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = {k: f"text {k} " * (3 if k % 10 else 4000) for k in range(100)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    for stage in (corpus_pipeline.good_texts, corpus_pipeline.as_pieces):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{stage.__name__}")
        assert rows(spark.read.parquet(f"{tmp_path}/{stage.__name__}")) == texts
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
