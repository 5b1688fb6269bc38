"""The reader slot: failing pages, empty pages, one reader per worker, bounded batches."""

import os

from pyspark.sql import functions as F

from pageloom.sources.readers import page_files, read_regions


def word_reader():
    """Each word is a region; its confidence counts the pages read so far.

    Built inside a function so that it travels whole to the workers.
    """
    def make():
        calls = []

        def read(content: bytes):
            calls.append(1)
            for i, word in enumerate(content.decode().split()):
                if word == "stop":
                    raise RuntimeError("half way")
                yield i, 0, i + 1, 10, None if word == "null" else len(calls), word

        return read

    return make


make_reader = word_reader()


def pages(spark, rows):
    return spark.createDataFrame([(i, None if c is None else c.encode(), "extra") for i, c in rows], "page_id long, content binary, error string")


def test_rows_and_markers(spark):
    df = pages(spark, [(1, "a null"), (2, "b stop c"), (3, ""), (4, None), (5, "twice"), (5, "twice")])
    rows = [(r.page_id, r.pos, r.x1, r.x2, r.source_text, r.error) for r in read_regions(df, make_reader).collect()]
    assert sorted(rows, key=str) == sorted([
        (1, 1, 0, 1, "a", None), (1, 2, 1, 2, "null", None), (2, 0, None, None, None, "RuntimeError: half way"),
        (4, 0, None, None, None, "ValueError: no content"), (5, 1, 0, 1, "twice", None), (5, 1, 0, 1, "twice", None),
    ], key=str)
    assert read_regions(df, make_reader).where("source_text = 'null'").first().confidence is None


def test_undecodable_and_empty_table(spark):
    bad = spark.createDataFrame([(1, b"\xff\xfe")], "page_id int, content binary")
    assert read_regions(bad, make_reader).first().error.startswith("UnicodeDecodeError")
    assert read_regions(bad.where("page_id > 1"), make_reader).count() == 0


def test_reader_is_made_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    make = make_reader

    def counted():
        with open(os.path.join(folder, f"{os.getpid()}"), "a") as out:
            out.write("x")
        return make()

    df = spark.range(0, 400, 1, 40).select(F.col("id").alias("page_id"), F.lit("w").cast("binary").alias("content"))
    assert read_regions(df, counted).count() == 400
    assert all((tmp_path / name).read_text() == "x" for name in os.listdir(folder))


def test_small_batches_give_the_same_rows(spark):
    df = pages(spark, [(i, "w " * (i % 7)) for i in range(200)])
    want = sorted((r.page_id, r.pos) for r in read_regions(df, make_reader).collect())
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "200")
    try:
        got = sorted((r.page_id, r.pos) for r in read_regions(df, make_reader, out_bytes=1).collect())
    finally:
        spark.conf.set(key, before)
    assert got == want and len(got) == sum(i % 7 for i in range(200))


def test_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.txt").write_text("one two")
    (tmp_path / "2.txt").write_text("three")
    (tmp_path / "3.md").write_text("skipped")
    files = page_files(spark, str(tmp_path), "*.txt")
    names = {r.page_id: r.path.rsplit("/", 1)[1] for r in files.collect()}
    got = sorted((names[r.page_id], r.source_text) for r in read_regions(files, make_reader).collect())
    assert got == [("1.txt", "one"), ("1.txt", "two"), ("2.txt", "three")]
