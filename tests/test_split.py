"""Texts cut in two."""

from __future__ import annotations

from pageloom.functions.text import split_by_punctuation


def test_cut_without_marks_is_a_cut_in_half(spark):
    texts = ["", None, "abcd", " ab cd ef ", "一二三，四五六", "，ab", "ab。", "a，b！c", "x" * 9]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", split_by_punctuation("t").alias("c")).orderBy("i").collect()
    assert [tuple(r.c) for r in rows] == [
        ("", ""), ("", ""), ("ab", "cd"), ("ab c", "d ef"), ("一二三，", "四五六"), ("，", "ab"), ("a", "b。"), ("a，", "b！c"),
        ("xxxx", "xxxxx")]
