"""Values as files, and what reads them back."""

import hashlib
from pathlib import Path

import duckdb
import pytest

from stratasift.plans import all_queries, all_sql, files
from stratasift.sources import images, sinks


def contents(folder):
    return sorted(p.read_bytes() for p in Path(folder).rglob("part-*.txt") if not any(x.startswith("_") for x in p.parts))


@pytest.mark.parametrize("local", [True, False])
def test_each_value_is_a_file(spark, tmp_path, monkeypatch, local):
    if not local:
        monkeypatch.setattr(sinks, "_local_path", lambda *_: None)
    monkeypatch.setattr(sinks, "FOLDER_FILES", 2)
    values = [b"a", b"a", b"", b"\xff\xfe", b"x\ny", None, *[str(i).encode() for i in range(20)]]
    rows = spark.createDataFrame([(v,) for v in values], "v binary").repartition(3)
    sinks.write_each(rows, f"file://{tmp_path}/f", "\0")
    assert contents(tmp_path / "f") == sorted((v or b"") + b"\0" for v in values)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"file://{tmp_path}/f")
    assert sorted(bytes(r["content"]) for r in read.collect()) == contents(tmp_path / "f")
    # A local store is written without its checksum files, which take processes of their own.
    assert bool(list(tmp_path.rglob("*.crc"))) != local


def test_an_empty_table_has_no_files(spark, tmp_path):
    sinks.write_each(spark.createDataFrame([], "v string"), f"file://{tmp_path}/f")
    assert (tmp_path / "f").is_dir() and contents(tmp_path / "f") == []
    with pytest.raises(FileExistsError):
        sinks.write_each(spark.createDataFrame([], "v string"), f"file://{tmp_path}/f")


def test_attempts_at_one_part(tmp_path):
    def broken():
        yield b"a"
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        sinks._write_files(broken(), str(tmp_path), b"", 0, 1)
    assert contents(tmp_path) == []  # what was not finished is passed over
    assert sinks._write_files([b"a", b"b"], str(tmp_path), b"", 0, 2) == 2
    assert sinks._write_files([b"a", b"b"], str(tmp_path), b"", 0, 3) == 2
    assert contents(tmp_path) == [b"a", b"b"] and not (tmp_path / "_00000-3").exists()


def test_small_images_share_a_task(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + (64).to_bytes(4, "big") + (70).to_bytes(4, "big")
    sinks.write_each(spark.createDataFrame([(png + str(i).encode(),) for i in range(300)], "v binary"), f"file://{tmp_path}/f")
    found = [images.read_images(spark, f"file://{tmp_path}/f", "*.txt", n) for n in (1, 32)]
    assert [f.rdd.getNumPartitions() for f in found] == [10, 1]
    assert {f.select("image_id").distinct().count() for f in found} == {300}


def test_images_start_no_process_each(spark, tmp_path, monkeypatch):
    """All images are read, and none has the checksum file that Spark's local writer leaves, at the price of processes."""
    spark.range(2500).selectExpr("id AS page_id").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(files, "new_folder", lambda _, label: f"file://{tmp_path}/{label}")
    got = all_queries()["image_ocr_text"](spark, f"file://{tmp_path}").collect()
    assert sum(r["n"] for r in got) == 2500 and len(got) == 350
    assert len(contents(tmp_path / "images")) == 2500
    assert not list((tmp_path / "images").rglob("*.crc"))


def test_long_texts_are_read_in_full(spark, tmp_path):
    """Texts on both sides of the limit are hashed to their last byte; the limit only marks their files."""
    texts = ["short", " short ", "a" * 131_071, "a" * 131_072, "ä" * 65_536, "ä" * 65_535, "b" * 400_000 + "1", "b" * 400_000 + "2", ""]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r["content_hash"], r["too_long"], r["n"]) for r in all_queries()["txt_reader"](spark, f"file://{tmp_path}").collect()]
    want = {(hashlib.sha256(t.strip().encode()).hexdigest(), len(t.encode()) + 1 > 131_072, 2 if t.strip() == "short" else 1) for t in texts}
    assert len(got) == len(want) and set(got) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{tmp_path}/benchmark.parquet/*.parquet')")
    cursor = con.execute(all_sql()["txt_reader"])
    assert [d[0] for d in cursor.description] == ["content_hash", "too_long", "n"]
    assert sorted(cursor.fetchall()) == sorted(got)
