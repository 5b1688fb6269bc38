"""Orders inside a page, chapter or listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import natural_chunks
from pageloom.skew import KeyProfile, ordered, rank


def natural_positions(
    df: DataFrame, keys: list[str], name: str, id_col: str, profile: KeyProfile | None = None,
) -> DataFrame:
    """Position of each row by natural name order (1, 2, 10 instead of 1, 10, 2)."""
    keyed = df.withColumn("_chunks", natural_chunks(name))
    return ordered(keyed, keys, ["_chunks", id_col], {"position": rank()}, profile).drop("_chunks")


def reading_order(
    regions: DataFrame, profile: KeyProfile | None = None, row_height: int = 20,
) -> DataFrame:
    """Rank on the page by 20-pixel rows, then left to right."""
    row = F.floor(F.col("y1") / row_height) * row_height
    return ordered(
        regions, ["page_id"], [row, F.col("x1"), F.col("pos")], {"reading_rank": rank()}, profile
    )
