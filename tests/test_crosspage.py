"""Border pairs translated as one text: what they are made of is computed once, and regions away from borders have no part in it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import catalog
from catalog.greedy import pairs
from pageloom.operators import greedy as G
from pageloom.operators import scoring as B
from pageloom.plans import views
from pageloom.plans.views import Tables

LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double"


def counted(df):
    """The same rows, and how many of them were computed so far."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), seen


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_pairs_members_and_replies_are_computed_once(spark):
    given = [(1, 10, 20), (1, 11, 21), (2, 20, 30), (3, 31, 40), (4, None, 40), (None, 30, 41), (5, 50, 99)]
    # group, pos, region, box, text; group 20 lies at both borders, 31 shows nothing, 40 comes twice
    members = [
        (10, 1, 100, 0, 0, 50, 10, "He"), (10, 2, 101, 0, 10, 90, 30, "says"), (20, 1, 200, 0, 0, 9, 9, "so"), (11, 3, 110, 0, 0, 9, 9, ""),
        (21, 2, 210, 0, 0, 9, 9, None), (30, 1, 300, 0, 0, 9, 9, "and, on"), (31, 2, 310, 0, 0, 9, 9, ""), (40, 1, 400, 0, 0, 9, 9, "twice"),
        (40, 1, 400, 0, 0, 9, 9, "twice"), (None, 9, 900, 0, 0, 9, 9, "nowhere"), (50, 1, 500, 0, 0, None, 9, "alone"), (77, 1, 770, 0, 0, 9, 9, "unpaired"),
    ]
    of, pair_count = counted(spark.createDataFrame(given, "page_id long, bottom_group long, top_group long"))
    held, member_count = counted(spark.createDataFrame(
        members, "group_id long, pos long, region_id long, x1 int, y1 int, x2 int, y2 int, source_text string"
    ).withColumn("page_id", F.lit(-1).cast("long")))
    asked = spark.sparkContext.accumulator(0)

    def reply(texts, contexts):
        asked.add(len(texts))
        return [f"{t}，{t[::-1]}" for t in texts]

    out = B.crosspage_combine(of, held, reply)
    got = sorted(out.collect())
    assert out.columns == ["page_id", "bottom_group", "side", "group_id", "region_id", "target_text"]
    assert got == [
        (1, 10, 0, 10, 100, "[INPAINT_ONLY]"), (1, 10, 0, 10, 101, "He says so，"), (1, 10, 1, 20, 200, "os syas eH"),
        (1, 11, 0, 11, 110, ""), (1, 11, 1, 21, 210, ""),
        (2, 20, 0, 20, 200, "so and, on，"), (2, 20, 1, 30, 300, "no ,dna os"),
        (3, 31, 0, 31, 310, "twice twice，"), (3, 31, 1, 40, 400, "eciwt eciwt"), (3, 31, 1, 40, 400, "eciwt eciwt"),
        (5, 50, 0, 50, 500, "alone，"),
    ]
    assert pair_count.value == len(given) and member_count.value == len(members)
    # pairs with a null key are asked too, and left out afterwards; one pair shows nothing
    assert asked.value == 6


def page_tables(spark, folder, documents):
    dice = random.Random(7)
    lines = [
        (8 * page + dice.randrange(8) if dice.random() > 0.02 else None, n % 7 + 1, dice.randrange(97), dice.randrange(1, 600),
         float(dice.randrange(1, 50)), float(n)) for page in range(25) for n in range(30)
    ]
    lines += [(9, None, 5, 3, 2.0, 1.0), (9, 2, None, 7, 2.0, 1.0), (17, 2, 30, None, 2.0, 1.0), *lines[:20]]
    spark.createDataFrame(lines, LINES).repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return len(lines)


DOCUMENTS = [(d, None if d == 9 else "".join(chr(97 + (d + i) % 26) + "，" * (i % 5 == 0) for i in range(40))) for d in range(30) if d != 11]


@pytest.mark.parametrize("kind", ["sent", "dealt", "twice"])
def test_regions_away_from_borders_have_no_part(spark, tmp_path, monkeypatch, kind):
    """The rows are those of all regions, whose lines are ranked once."""
    if kind == "dealt":
        monkeypatch.setattr(views, "SNIPPETS_SENT", 0)
    folder = str(tmp_path)
    size = page_tables(spark, folder, [*DOCUMENTS, *([DOCUMENTS[3], DOCUMENTS[8]] if kind == "twice" else [])])
    t = Tables(spark, folder)
    groups = t.regions.withColumn("group_id", F.col("region_id"))
    bottom = G.edge_groups(groups, 1850, "bottom")
    top = G.edge_groups(groups, 1850, "top").withColumn("page_id", F.col("page_id") - 1)
    want = rows(B.crosspage_combine(G.pair_edge_groups(bottom, top, profile=pairs(t)), groups))
    assert len(want) > 50

    plain, read = Tables.table, []

    def table(self, name):
        if name != "lineitem":
            return plain(self, name)
        df, seen = counted(plain(self, name))
        read.append(seen)
        return df

    monkeypatch.setattr(Tables, "table", table)
    monkeypatch.setattr(views, "_PROFILES", {})
    assert rows(catalog.QUERIES["crosspage_combine"](spark, folder)) == want
    # twice to count pages, once for the reach of texts, once to rank the lines
    assert sum(seen.value for seen in read) <= 4 * size


@pytest.mark.parametrize("kind", ["sent", "dealt", "twice"])
def test_texts_of_lines_are_those_of_regions(spark, tmp_path, monkeypatch, kind):
    if kind == "dealt":
        monkeypatch.setattr(views, "SNIPPETS_SENT", 0)
    folder = str(tmp_path)
    page_tables(spark, folder, [*DOCUMENTS, *([DOCUMENTS[3]] if kind == "twice" else [])])
    t = Tables(spark, folder)
    assert rows(t.with_texts(t.lines)) == rows(t.regions)
    assert rows(t.with_texts(t.lines.where("y1 <= 222"))) == rows(t.regions.where("y1 <= 222"))
