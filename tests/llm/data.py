"""Awkward documents that every document operator must take: nulls, empty and long texts, ties, repeats, extra columns."""

LONG = "the quick brown fox jumps over a lazy dog near the river bank today " * 400
ROWS = [
    (0, "Cats like milk and dogs like bones, all rights reserved.", "s1", "x"),
    (1, None, "s1", None),
    (2, "", "s2", "x"),
    (3, "   \n\t ", None, "x"),
    (4, LONG, "s2", "x"),
    (5, LONG, "s2", "x"),
    (6, LONG + " tail", "s3", "x"),
    (7, "mail a.b@x.example.com or +1 (555) 010-9999 from 10.0.0.1 with 4111111111111111 now", "s3", "x"),
    (8, "word", "s1", "x"),
    (9, "word", "s1", "x"),
    (10, "<|endoftext|> two  spaces and\x1cmore\r\n\r\ntabs\tline\n\n", "s1", "x"),
    (11, "Übung macht den Meister ñandú çé 日本語 テスト 🙂 emoji " * 30, "s1", "x"),
    (12, "# * $ % & | < > # * $ % & | < > # * $ % & | < > # * $ % &", None, "x"),
    (13, "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nCC BY general public license", "s4", "x"),
]
COLUMNS = "doc_id long, text string, source string, n_words string"


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def texts(path="/root/testdata/sf0.001"):
    import duckdb

    return duckdb.sql(f"select doc_id, text, source, lang from '{path}/documents.parquet' order by 1").fetchall()
