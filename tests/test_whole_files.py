"""Files are listed and read by the tasks."""

from topiclens.sources import files as R


def spark_reader(spark, path, glob=None):
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return {r["path"]: bytes(r["content"]) for r in reader.load(path).select("path", "content").collect()}


def tree(tmp_path):
    top = tmp_path / "a tree"
    for name in ("part-1", "part-2", "other", "_hidden", ".dot", "_k=1", "x._COPYING_", "deep/part-3", "deep/more/part-4", "deep/more/o+t%20her", "_no/part-5", "k=1/part-6", "empty/part-7"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(name.encode() * 50 if "empty" not in name else b"")
    return str(top)


def test_tasks_list_what_spark_lists(spark, tmp_path):
    path = tree(tmp_path)
    for asked, glob in ((path, None), (path, "part-*"), (path, "{part,o}*[1-4r]"), (f"file://{tmp_path}/*/deep", None), (f"{path}/part-1", None), (f"{path}/d*/", "part-?")):
        want = spark_reader(spark, asked, glob)
        found = R.read_whole_files(spark, asked, glob)
        rows = found.collect()
        assert want and {r["path"]: bytes(r["content"]) for r in rows} == want and len(rows) == len(want), (asked, glob)
        assert "FileScan" not in found._jdf.queryExecution().toString()  # whose files the driver lists


def test_batches_of_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "READ_BYTES", 100)
    path = tree(tmp_path)
    assert {r["path"]: bytes(r["content"]) for r in R.read_whole_files(spark, path).collect()} == spark_reader(spark, path)


def test_a_missing_folder_fails(spark, tmp_path):
    try:
        R.read_whole_files(spark, str(tmp_path / "none")).collect()
    except Exception as error:
        assert "PATH_NOT_FOUND" in str(error)
    else:
        raise AssertionError("no error")
