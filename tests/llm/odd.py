"""Rows that every operator must take: nulls, empty and long texts, repeats, ties and columns of clashing names."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, h string, c long, line string, pos int, score double, component_id long"
TEXTS = [None, "", " \n\t ", "one", "one two", "one two three four five six", "One Two THREE four five six", "é ü ß", "#$%", "a\n\nb\na", "word " * 30_000, "same text here " * 20, "same text here " * 20, "1 2 3"]


def odd_docs(spark, n: int | None = None):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(TEXTS)]
    rows += [(0, None, None, None), (11, TEXTS[11], "en", "s3"), (None, "an id that is null", "en", "s1"), (None, None, None, None), (3, "another text", "fr", "s2")]
    rows = [(*r, 0, "k", "t", "h", 7, "line", 1, 0.5, 3) for r in rows[:n]]
    return spark.createDataFrame(rows, SCHEMA)
