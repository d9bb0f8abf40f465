"""A landing folder whose files are found in tasks: what the driver holds does not follow the files."""

import glob
import os

from pyspark.sql import functions as F

import __spark_entry__
from lexloom.sources import files
from lexloom.streaming import machines


def entries(checkpoint):
    """What the source of a stream has written down: one line each, after the version of the file."""
    return [line for f in glob.glob(f"{checkpoint}/sources/0/[0-9]*") for line in open(f).read().splitlines()[1:]]


def test_query_holds_no_entry_a_file(spark, sf_dir, monkeypatch):
    seen, drain = [], machines.drain
    monkeypatch.setattr(machines, "drain", lambda stream, path, checkpoint, mode: (seen.append(checkpoint), drain(stream, path, checkpoint, mode)))
    n = __spark_entry__.queries()["ingest_stream"](spark, sf_dir).select("doc_id").distinct().count()
    assert n >= 200 and len(seen) == 2
    assert len(entries(seen[0].removeprefix("file:"))) == 2  # a run each


def test_each_file_once(spark, tmp_path):
    """Over restarts, in folders of folders, without hidden files; a search that died half way is made up for."""
    folder, out, checkpoint, log = (str(tmp_path / n) for n in ("in", "out", "checkpoint", "found"))
    content = F.encode(F.concat(F.lit("%PDF-1.4\nstream\n("), F.col("id").cast("string"), F.lit(") Tj\nendstream")), "UTF-8")

    def write(first, last, at):
        return files.write_files(spark.range(first, last).select(F.concat("id", F.lit(" ü%20.pdf")).alias("name"), content.alias("content")), f"{folder}/{at}")

    def run():
        machines.drain(files.landing_pages(spark, folder, files_per_trigger=10, log=log), out, checkpoint, "append")
        return sorted(int(r.text) for r in machines.committed(spark, out).collect())

    write(0, 30, "")
    write(30, 45, "day=1/hour")
    for hidden in (".late.pdf", "_late.pdf"):
        open(f"{folder}/{hidden}", "wb").write(b"%PDF-1.4\nstream\n(99) Tj\nendstream")
    assert run() == list(range(45))
    assert len(entries(checkpoint)) == 5
    write(45, 50, "day=2")
    assert run() == list(range(50))
    assert run() == list(range(50)) and len(entries(checkpoint)) == 6
    write(50, 60, "")
    first = files.list_files(spark, folder).filter("path LIKE '%/5_ %'").orderBy("path").limit(4)  # published before the searcher died
    first.write.mode("append").parquet(log)
    assert run() == list(range(60))
    same = {(r.path, r.length) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length").collect()}
    assert {tuple(r) for r in files.list_files(spark, folder).collect()} == same


def test_missing_folder_is_an_error(spark, tmp_path):
    try:
        files.find_landed(spark, str(tmp_path / "none"), str(tmp_path / "found"))
    except Exception as error:
        assert "FileNotFoundError" in str(error)
    else:
        raise AssertionError("a folder that is not there was listed")


def test_length_of_a_listing_batch(spark, tmp_path, monkeypatch):
    """Batches are cut, and none of their rows is lost."""
    for k in range(25):
        (tmp_path / str(k)).write_bytes(b"x" * k)
    monkeypatch.setattr(files, "LISTED_ROWS", 10)
    assert sorted(os.path.basename(r.path) for r in files.list_files(spark, str(tmp_path)).collect()) == sorted(map(str, range(25)))
    assert sum(r.length for r in files.list_files(spark, str(tmp_path)).collect()) == 300
