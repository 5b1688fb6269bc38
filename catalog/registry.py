"""Where queries and their SQL twins register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pageloom.plans.views import ROWS_PER_PAGE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The derived views as SQL, one CTE each; a query names those it needs.
VIEWS = {
    "paged": """paged AS (
  SELECT l.*, CAST(floor(l_orderkey/8) AS BIGINT) AS page_id FROM lineitem l)""",
    "lines": f"""lines AS (
  SELECT page_id, page_id*{ROWS_PER_PAGE} + pos AS region_id, pos,
    CAST((l_partkey*37 + l_linenumber*53) % 600 AS INT) AS x1,
    CAST((l_suppkey*29 + l_linenumber*17) % 1800 AS INT) AS y1,
    CAST((l_partkey*37 + l_linenumber*53) % 600 + 20 + CAST(l_quantity AS BIGINT)*4 AS INT) AS x2,
    CAST((l_suppkey*29 + l_linenumber*17) % 1800 + 12 + l_partkey % 40 AS INT) AS y2,
    CAST((l_partkey*7 + l_suppkey) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
    l_partkey, l_suppkey, l_linenumber
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY l_orderkey,
          l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS pos
        FROM paged))""",
    "regions": """regions AS (
  SELECT page_id, region_id, pos, x1, y1, x2, y2, confidence,
    CASE l_partkey % 23 WHEN 0 THEN 'BOOM!' WHEN 1 THEN 'NEWTOKI 95' WHEN 2 THEN '12 34'
      WHEN 3 THEN '쾅!' WHEN 4 THEN 'A1_$' WHEN 5 THEN '안녕 하세요' WHEN 6 THEN '...'
      WHEN 7 THEN 'site.com'
      ELSE substr(d.text, CAST(1 + l_suppkey % 20 AS INT), CAST(4 + l_linenumber*3 AS INT))
      END AS source_text,
    CASE l_suppkey % 11 WHEN 0 THEN '[翻译失败]' WHEN 1 THEN '[INPAINT_ONLY]' WHEN 2 THEN ''
      WHEN 3 THEN '쾅 소리' WHEN 4 THEN 'translate: output only, numbered'
      WHEN 5 THEN CAST(NULL AS VARCHAR)
      ELSE concat('你好，第', CAST(l_linenumber AS VARCHAR), '页。') END AS target_text
  FROM lines JOIN documents d
    ON d.doc_id = l_partkey % (SELECT max(doc_id) + 1 FROM documents))""",
    "page_facts": """page_facts AS (
  SELECT page_id, CAST(floor(page_id/12) AS BIGINT) AS chapter_id,
    CAST(floor(floor(page_id/12)/10) AS BIGINT) AS series_id, page_id % 12 + 1 AS page_no,
    CAST(10*sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS ocr_ms,
    CAST(7*sum(CAST(l_quantity AS BIGINT)) + 3*sum(l_suppkey % 50) AS BIGINT) AS translator_ms,
    CAST(5*sum(l_partkey % 30) AS BIGINT) AS inpainter_ms,
    CAST(2*sum(l_linenumber) AS BIGINT) AS renderer_ms, count(*) AS regions,
    page_id % 7 <> 0 AS ok, page_id % 5 <> 0 AS has_output
  FROM paged GROUP BY page_id)""",
    "progress": """progress AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS task_id,
    CAST(user_id % 12 AS BIGINT) AS chapter_id,
    CASE event_type WHEN 'click' THEN 'ocr' WHEN 'view' THEN 'translator'
      WHEN 'signup' THEN 'renderer' WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS stage,
    value
  FROM events)""",
}
_NEEDS = {
    "paged": ["paged"], "lines": ["paged", "lines"], "regions": ["paged", "lines", "regions"],
    "page_facts": ["paged", "page_facts"], "progress": ["progress"],
}


def with_views(sql: str, *views: str) -> str:
    """``WITH`` the named views (and what they need) in front of a query.

    A query that starts with its own CTEs begins with ``, name AS (...)``.
    """
    names: list[str] = []
    for v in views:
        names += [n for n in _NEEDS[v] if n not in names]
    head = ",\n".join(VIEWS[n] for n in names)
    body = sql.strip()
    if body.startswith(","):
        body = f"{head}\n{body}" if head else body[1:]
    elif head:
        body = f"{head}\n{body}"
    else:
        return body
    return f"WITH {'RECURSIVE ' if 'UNION' in sql else ''}{body}"


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register a query over ``Tables`` and, where SQL can say it, its SQL twin."""

    def register(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = with_views(oracle, *views)
        return fn

    return register
