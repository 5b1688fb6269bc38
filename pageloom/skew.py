"""Keeping one hot group from landing in one task.

Two facts are needed before a grouped operator runs: how many rows there are,
and whether any group is too large for a task.  ``profile_keys`` measures both
with one map-side-combined count.  The common case (no hot group) then uses the
plain window or grouped plan.  Rows of hot groups take another exact route:

* ordered windows: rows are range-partitioned by (key, order), which may cut a
  group anywhere, each piece is processed alone, and what earlier or later
  pieces contribute is carried over from one summary row per piece;
* grouped Python functions: a hot group is first cut into the connected parts
  that can influence each other (see ``operators.greedy``).
"""

from __future__ import annotations

import math
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_TASK = 200_000
BROADCAST_KEYS = 100_000
# rows of a group up to which all of them are compared with each other
ROWS_COMPARED = 400


@dataclass
class KeyProfile:
    """Row count, and the keys that hold more than ``limit`` rows each."""

    keys: tuple[str, ...]
    rows: int = 0
    hot_count: int = 0
    limit: int = ROWS_PER_TASK
    hot: DataFrame | None = field(default=None, repr=False)
    largest: int | None = None

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(rows of ordinary groups, rows of hot groups or None)."""
        if not self.hot_count:
            return df, None
        hot = F.broadcast(self.hot) if self.hot_count <= BROADCAST_KEYS else self.hot
        keys = list(self.keys)
        return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")

    def pieces(self) -> int:
        return max(1, math.ceil(self.rows / self.limit))

    def join(self, left: DataFrame, right: DataFrame, more: list[str], how: str = "inner") -> DataFrame:
        """Join on the keys and the columns ``more``.

        Spark deals both sides out again by all columns that a join equates.  Where all
        groups are small the keys are the only ones, the others are compared inside a
        group, and rows that lie by the keys stay where they are.
        """
        keys = list(self.keys)
        if self.largest is None or self.largest > ROWS_COMPARED:
            return left.join(right, [*keys, *more], how)
        to = {c: f"_to_{c}" for c in [*keys, *more]}
        right = right.withColumnsRenamed(to)
        on = F.lit(True)
        for k in keys:
            on = on & (F.col(k) == F.col(to[k]))
        for c in more:
            on = on & (F.col(c) <= F.col(to[c])) & (F.col(c) >= F.col(to[c]))
        return left.join(right, on, how).drop(*to.values())


def profile_keys(df: DataFrame, keys: list[str], limit: int = ROWS_PER_TASK) -> KeyProfile:
    """Measure group sizes; runs one aggregation that reads only the keys."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    big = F.col("_n") > limit
    row = counts.agg(
        F.sum("_n").alias("rows"), F.count_if(big).alias("hot"), F.max("_n").alias("largest")
    ).first()
    rows, hot_count = int(row["rows"] or 0), int(row["hot"] or 0)
    hot = counts.where(big).select(*keys) if hot_count else None
    return KeyProfile(tuple(keys), rows, hot_count, limit, hot, int(row["largest"] or 0))


def shared_folder(spark: SparkSession) -> str:
    """This session's folder on storage that all executors share.

    It lies in the folder named by ``spark.checkpoint.dir``; only a local
    session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pageloom-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written in the shared folder and read again: cuts lineage, keeps columns apart and compressed."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


# ---------------------------------------------------------------------------
# ordered scans
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Scan:
    """One column computed along an ordered group."""

    kind: str
    expr: Column | None = None


def rank() -> Scan:
    return Scan("rank")


def previous(expr: Column) -> Scan:
    return Scan("previous", expr)


def following(expr: Column) -> Scan:
    return Scan("following", expr)


def max_before(expr: Column) -> Scan:
    """Largest value among all earlier rows."""
    return Scan("max_before", expr)


def running_max(expr: Column) -> Scan:
    return Scan("running_max", expr)


def running_sum(expr: Column) -> Scan:
    return Scan("running_sum", expr)


def _plain(scan: Scan, keys: list[str], order: list[Column]) -> Column:
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return {
        "rank": lambda: F.row_number().over(w).cast("long"),
        "previous": lambda: F.lag(scan.expr).over(w),
        "following": lambda: F.lead(scan.expr).over(w),
        "max_before": lambda: F.max(scan.expr).over(before),
        "running_max": lambda: F.max(scan.expr).over(upto),
        "running_sum": lambda: F.sum(scan.expr).over(upto),
    }[scan.kind]()


def _pieced(df: DataFrame, keys: list[str], order: list[Column], scans: dict[str, Scan], pieces: int) -> DataFrame:
    """The same columns with every group cut into range pieces."""
    cols = df.columns
    inputs = {f"_in_{n}": s.expr for n, s in scans.items() if s.expr is not None}
    part = (
        df.withColumns(inputs) if inputs else df
    ).repartitionByRange(pieces, *[F.col(k) for k in keys], *order)
    # the piece number of a row must not change when a task runs again
    part = checkpoint(part.withColumn("_piece", F.spark_partition_id()))
    within = [*keys, "_piece"]
    out, summary = {}, [F.count(F.lit(1)).alias("_count")]
    position = F.struct(*[o for o in order])
    for name, s in scans.items():
        value = F.col(f"_in_{name}")
        if s.kind != "rank":
            out[name] = _plain(Scan(s.kind, value), within, order)
        else:
            out[name] = _plain(s, within, order)
        if s.kind == "previous":
            summary.append(F.max_by(F.struct(value), position).alias(f"_s_{name}"))
        elif s.kind == "following":
            summary.append(F.min_by(F.struct(value), position).alias(f"_s_{name}"))
        elif s.kind in ("max_before", "running_max"):
            summary.append(F.max(value).alias(f"_s_{name}"))
        elif s.kind == "running_sum":
            summary.append(F.sum(value).alias(f"_s_{name}"))
    first_rank = {"_pc_at": _plain(rank(), within, order), "_pc_last": F.lead(F.lit(1)).over(
        Window.partitionBy(*within).orderBy(*order)
    ).isNull()}
    # one row per piece: as many rows as pieces plus keys
    sums = part.groupBy(*within).agg(*summary)
    sw = Window.partitionBy(*keys).orderBy("_piece")
    earlier = sw.rowsBetween(Window.unboundedPreceding, -1)
    carry = {}
    for name, s in scans.items():
        c = F.col(f"_s_{name}") if s.kind != "rank" else F.col("_count")
        carry[f"_c_{name}"] = {
            "rank": lambda: F.coalesce(F.sum(c).over(earlier), F.lit(0)),
            "previous": lambda: F.lag(c).over(sw),
            "following": lambda: F.lead(c).over(sw),
            "max_before": lambda: F.max(c).over(earlier),
            "running_max": lambda: F.max(c).over(earlier),
            "running_sum": lambda: F.sum(c).over(earlier),
        }[s.kind]()
    sums = sums.withColumns(carry).select(*within, *carry)
    done = part.withColumns({**out, **first_rank}).join(sums, within)
    final = {}
    for name, s in scans.items():
        own, c = F.col(name), F.col(f"_c_{name}")
        final[name] = {
            "rank": lambda: own + c,
            "previous": lambda: F.when((F.col("_pc_at") == 1) & c.isNotNull(), c[f"_in_{name}"]).otherwise(own),
            "following": lambda: F.when(F.col("_pc_last") & c.isNotNull(), c[f"_in_{name}"]).otherwise(own),
            "max_before": lambda: F.greatest(own, c),
            "running_max": lambda: F.greatest(own, c),
            "running_sum": lambda: F.when(c.isNull(), own).when(own.isNull(), c).otherwise(own + c),
        }[s.kind]()
    return done.withColumns(final).select(*cols, *scans)


def ordered(
    df: DataFrame, keys: list[str], order: list[str | Column], scans: dict[str, Scan],
    profile: KeyProfile | None = None,
) -> DataFrame:
    """Add ordered-scan columns per key.

    ``order`` must be a total order inside a group.  Without a ``profile`` the
    group sizes are measured first.
    """
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    if profile is None:
        profile = profile_keys(df, keys)
    cold, hot = profile.split(df)
    plain = cold.withColumns({n: _plain(s, keys, columns) for n, s in scans.items()})
    if hot is None:
        return plain
    return plain.unionByName(_pieced(hot, keys, columns, scans, profile.pieces()))
