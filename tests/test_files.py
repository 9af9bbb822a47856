import hashlib

import pytest
from pyspark.sql import functions as F

from indicatrix.sources import readers, sinks


def test_checksums_of_files_of_any_size(spark, tmp_path, monkeypatch):
    """Small files in tasks, larger ones as a stream; both as hashlib has them, and compared with their sidecars."""
    monkeypatch.setattr(readers, "WHOLE_FILE", 1000)
    files = {"a.csv": b"x,y\n1,2\n", "b.csv": b"z" * 1001, "c.csv": b"", "d.csv": bytes(range(256)) * 20_000}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "b.csv.sha256").write_text(hashlib.sha256(files["b.csv"]).hexdigest() + "  b.csv\n")
    (tmp_path / "d.csv.sha256").write_text("0" * 64)
    rows = {r["filename"]: r for r in readers.file_checksums(spark, str(tmp_path)).collect()}
    assert {n: (r["checksum"], r["size"]) for n, r in rows.items()} == {n: (hashlib.sha256(c).hexdigest(), len(c)) for n, c in files.items()}
    assert {n: r["status"] for n, r in rows.items()} == {"a.csv": "unverified", "b.csv": "match", "c.csv": "unverified", "d.csv": "mismatch"}


def test_checksum_of_a_file_no_cell_can_hold(spark, tmp_path):
    size = (1 << 31) + 5
    with open(tmp_path / "sparse.csv", "wb") as f:
        f.truncate(size)
    digest, block = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        digest.update(block)
    digest.update(bytes(size & ((1 << 20) - 1)))
    row = readers.file_checksums(spark, str(tmp_path)).first()
    assert (row["checksum"], row["size"], row["status"]) == (digest.hexdigest(), size, "unverified")


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "orders")
    rows = [(k, 2000 + k % 5, float(k)) for k in range(50)]
    spark.createDataFrame(rows, "k int, year int, value double").repartition("year").write.partitionBy("year").parquet(path)
    return path, {(k, y): v for k, y, v in rows}


def test_merge_rewrites_only_what_it_touches(spark, stored):
    path, want = stored
    def files():
        return {"/".join(f.split("/")[-2:]) for f in spark.read.parquet(path).inputFiles()}

    before = files()
    updates = spark.createDataFrame([(1, 2001, -1.0, 1), (1, 2001, -2.0, 2), (99, 2001, 5.0, 1), (7, 2010, 6.0, 1)], "k int, year int, value double, version int")
    assert sinks.merge_partitions(spark, path, updates, ["k", "year"], "year", "version") == 2
    want |= {(1, 2001): -2.0, (99, 2001): 5.0, (7, 2010): 6.0}
    assert {(r["k"], r["year"]): r["value"] for r in spark.read.parquet(path).collect()} == want
    assert {f for f in files() if f.split("/")[0] not in ("year=2001", "year=2010")} == {f for f in before if not f.startswith("year=2001")}
    assert not {f for f in before if f.startswith("year=2001")} & files()


def test_merge_scans_only_what_it_touches(spark, stored):
    updates = spark.createDataFrame([(1, 2001, -1.0)], "k int, year int, value double")
    plan = sinks.merged_rows(spark, stored[0], updates, ["k", "year"], "year", [2001])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "= 2001" in plan


def test_merge_refuses_what_it_cannot_place(spark, stored):
    rows = spark.createDataFrame([(1, 2001, -1.0), (2, None, 1.0)], "k int, year int, value double")
    with pytest.raises(ValueError, match="one of the keys"):
        sinks.merge_partitions(spark, stored[0], rows.where("year is not null"), ["k"], "year")
    with pytest.raises(ValueError, match="without year"):
        sinks.merge_partitions(spark, stored[0], rows, ["k", "year"], "year")
    assert spark.read.parquet(stored[0]).count() == len(stored[1])
    assert sinks.merge_partitions(spark, stored[0], rows.where(F.lit(False)), ["k", "year"], "year") == 0 and spark.read.parquet(stored[0]).count() == len(stored[1])
