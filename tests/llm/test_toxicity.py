"""The bound on the rows of the one learning task."""

from __future__ import annotations

import numpy as np

from pageloom.llm import toxicity


def test_repeated_ids_teach_once(spark, monkeypatch):
    rows = [(i, f"bad word{i}" if i % 2 else f"good word{i}") for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    plain = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    again = spark.createDataFrame([*rows, *[rows[3]] * 200], "doc_id long, text string").repartition(3)
    assert plain.any() and np.array_equal(plain, toxicity.fit(again, labels))
    # other texts under the same id: one of them is learned from, whatever the order of rows
    more = [(3, f"bad other{k}") for k in range(50)]
    got = [toxicity.fit(spark.createDataFrame(x, "doc_id long, text string").repartition(k), labels)
           for x, k in (([*rows, *more], 2), ([*more[::-1], *rows[::-1]], 5))]
    assert np.array_equal(*got)
    # each text is three features at most, once a row: no weight for more than one of the texts
    assert np.count_nonzero(got[0]) == np.count_nonzero(plain)
