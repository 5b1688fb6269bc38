import pytest
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(400)]
PASSAGE = " ".join(WORDS[100:160])
BENCH = " ".join(WORDS[200:230])


def edge_rows():
    """(doc_id, text): nulls, empty and long texts, ties, repeated rows, shared lines and passages."""
    shared = "A Line That Many Documents Hold, And It Is Long Enough"
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (None, "a text without an id " + PASSAGE), (None, None),
        (4, "x " * 30), (5, f"head five {PASSAGE} tail five"), (6, f"head six {PASSAGE} tail six"),
        (6, f"head six {PASSAGE} tail six"), (6, "another row of document six " + PASSAGE),
        (7, f"{BENCH.upper()} and more"), (8, " ".join(WORDS[205:218])), (9, " ".join(WORDS[200:209])),
        (10, "short item here"), (11, "SHORT, item; HERE short item"),
        (12, " ".join(WORDS * 30)), (13, " ".join(WORDS * 30)), (14, "É é ñ 漢字 <|im_end|> \\s " + "ü" * 50),
    ]
    rows += [(20 + i, f"own line {i}\n  {shared.upper() if i % 2 else shared}\t\nlast {i}\n{shared}") for i in range(7)]
    rows += [(40 + i, " ".join(WORDS[:100]) + (" tail" if i == 3 else "")) for i in range(5)]
    rows += [(50, "1 " * 200 + PASSAGE), (51, PASSAGE + " " + PASSAGE)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    df = spark.createDataFrame(edge_rows(), "doc_id long, text string").repartition(3, "text")
    extra = "_id _tag text_ n n_words n_hit items fp anchor start pos key line no k1 k2 docs last gone run w bits word length terms place toxic"
    return df.withColumns({c: F.lit("clash") for c in extra.split()})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
