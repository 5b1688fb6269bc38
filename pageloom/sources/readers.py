"""A slot for recognisers: page content goes in, region rows come out.

The library holds no recogniser.  A caller passes ``make_reader``, a function
without arguments that loads a model and returns ``reader(content: bytes)``,
which gives (x1, y1, x2, y2, confidence, text) for each region in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Reader = Callable[[bytes], Iterable[tuple]]

READ_SCHEMA = (
    "page_id bigint, pos int, x1 int, y1 int, x2 int, y2 int, confidence double, source_text string, error string"
)
_ARROW = pa.schema([
    ("page_id", pa.int64()), ("pos", pa.int32()), *[(c, pa.int32()) for c in ("x1", "y1", "x2", "y2")],
    ("confidence", pa.float64()), ("source_text", pa.string()), ("error", pa.string()),
])
OUT_BYTES = 8 << 20

# readers of this worker process, by the slot they were made for
_LOADED: dict[str, Reader] = {}


def _loaded(slot: str, make_reader: Callable[[], Reader]) -> Reader:
    """The reader of this process; a function of the module, since closures travel with copies of globals."""
    if slot not in _LOADED:
        _LOADED[slot] = make_reader()
    return _LOADED[slot]


def _page_rows(page_id: int, content: bytes | None, reader: Reader) -> list[tuple]:
    """Rows of one page; a page that fails has one marker row and no half result."""
    try:
        if content is None:
            raise ValueError("no content")
        return [
            (page_id, pos, int(x1), int(y1), int(x2), int(y2), None if sure is None else float(sure), text, None)
            for pos, (x1, y1, x2, y2, sure, text) in enumerate(reader(content), 1)
        ]
    except Exception as e:  # noqa: BLE001 - whatever a foreign model raises
        return [(page_id, 0, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]


def read_regions(pages: DataFrame, make_reader: Callable[[], Reader], out_bytes: int = OUT_BYTES) -> DataFrame:
    """Regions of every page, read by a pluggable recogniser.

    ``pages``: page_id, content (binary).  A worker process makes the reader
    once and keeps it for all of its tasks; one that cannot be made fails the
    query.  Spark hands pages over in batches bounded by
    ``spark.sql.execution.arrow.maxBytesPerBatch``; rows go back whenever their
    texts reach ``out_bytes``, so memory is bounded by these two and one page.

    A page that cannot be read (null content too) gives one row with ``pos`` 0,
    its ``error`` and nulls.  A page without regions gives no row.  Repeated
    page ids are read each; other columns of ``pages`` are not read.
    """
    slot = uuid.uuid4().hex

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reader = _loaded(slot, make_reader)
            rows, size = [], 0
            for page_id, content in zip(batch.column("page_id"), batch.column("content")):
                found = _page_rows(page_id.as_py(), content.as_py(), reader)
                rows += found
                size += sum(64 + len(r[7] or r[8] or "") for r in found)
                if size >= out_bytes:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "content").mapInArrow(read, READ_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def page_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(page_id, path, content) of the files below a folder, for ``read_regions``.

    The id is a 64-bit hash of the path, so it does not depend on which other files there are.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.xxhash64("path").alias("page_id"), "path", "content")
