"""The reader slot over the page corpus, with a reader that needs no model."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from catalog.registry import query
from pageloom.sources.readers import read_regions

LINE = 20


def link_reader():
    """A page's anchors stand in for text regions: a line each, as wide as its text.

    The function is built here so that it travels whole: this folder is not on the executors.
    """
    def make():
        anchor = re.compile(rb'<a href="[^"]*">([^<]*)</a>')

        def read(content: bytes):
            if len(content) % 17 == 0:
                raise ValueError("unreadable")
            for i, m in enumerate(anchor.finditer(content)):
                yield 0, i * LINE, len(m[1]), (i + 1) * LINE, 1 / (1 + len(m[1])), m[1].decode()

        return read

    return make


@query("read_regions", f"""WITH p AS (SELECT page_id, octet_length(encode(html)) % 17 = 0 AS bad, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages),
 r AS (SELECT page_id, unnest(t) AS source_text, generate_subscripts(t, 1)::INT AS pos FROM p WHERE NOT bad)
 SELECT page_id, pos, 0::INT AS x1, ((pos - 1) * {LINE})::INT AS y1, octet_length(encode(source_text))::INT AS x2, (pos * {LINE})::INT AS y2,
   1.0::DOUBLE / (1 + octet_length(encode(source_text))) AS confidence, source_text, NULL::VARCHAR AS error FROM r
 UNION ALL SELECT page_id, 0, NULL, NULL, NULL, NULL, NULL, NULL, 'ValueError: unreadable' FROM p WHERE bad""")
def _(t):
    """Pages whose length is a multiple of 17 cannot be read; they keep a marker row."""
    return read_regions(t.spread("pages").select("page_id", F.col("html").cast("binary").alias("content")), link_reader())
