"""A corpus pipeline: five stages, each over everything its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``, whatever further columns it has and however these
are called.

Defined results, in every stage but the last: a null or empty text is a text without
words or lines, which is kept; rows are answered one by one, so repeated rows are all
kept or all dropped, but for near-duplicates, which keep every row of the smallest
doc_id; rows with a null doc_id stand for one document, the smallest; an empty table
gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import table
from pageloom.llm.decontaminate import contaminated
from pageloom.llm.jaccard import near_texts
from pageloom.llm.lines import drop_repeated_lines
from pageloom.llm.packing import pack
from pageloom.llm.simhash import near_duplicates
from pageloom.llm.toxicity import fit, held_out, score
from pageloom.skew import shared_folder


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id is not among ``ids`` (one column, doc_id)."""
    ids = ids.withColumnRenamed("doc_id", "_gone")
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_gone"]), "left_anti")


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, whose names then clash with nothing."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(rest or [F.lit(0).alias("_none")])).alias("_rest"))


def _unwrapped(docs: DataFrame, columns: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns again, in their order; some of them ``changed``."""
    new = {"doc_id": F.col("doc_id"), "text": F.col("text")} | (changed or {})
    return docs.select(*(new[c].alias(c) if c in new else F.col("_rest").getField(c).alias(c) for c in columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; held-out labels are not learned from."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    docs_ = _wrapped(docs)
    return _unwrapped(score(docs_, fit(docs_, labels), tuple(docs_.columns)).where("_score < 0.5"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; n_chars follows the text where it changes."""
    done = drop_repeated_lines(_wrapped(docs), keep=("_rest",)).withColumnRenamed("kept_text", "text")
    kept = F.col("_rest").getField("n_chars") if "n_chars" in docs.columns else F.lit(0)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(kept)
    return _unwrapped(done, docs.columns, {"n_chars": n_chars})


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates by SimHash and by exact Jaccard similarity: of each group the document with the smallest id.

    Near are texts whose fingerprints differ in at most two bits, as op5 links them, and
    texts whose sets of five words have a Jaccard similarity of 0.8 or more.  No radius
    of fingerprints holds all of the latter, so the sets themselves are compared too.
    Both methods see all documents.
    """
    columns = ["doc_id", "component_id"]
    near = near_duplicates(docs).select(*columns).unionByName(near_texts(docs).select(*columns))
    return _without(docs, near.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("n_hit > 0").select("doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into windows."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: near-duplicates, learned weights and retrieval are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and read by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs
