"""Small document tables with the awkward cases that every operator must meet."""

AWKWARD = [
    (1, None, "en"),
    (2, "", "en"),
    (3, "one", None),
    (4, "The quick brown fox jumps over the lazy dog while the other dogs sleep near the old red barn tonight", "en"),
    (5, "The quick brown fox jumps over the lazy dog while the other dogs sleep near the old red barn tonight", "en"),
    (6, " \n\t ", "fr"),
    (7, "é ü ß ñ — “quotes” and 漢字 with  double  spaces\n\nand\tlines\n", "de"),
    (8, "word " * 30000, "en"),
    (9, "x" * 20000, "en"),
    (9, "x" * 20000, "en"),
]


def documents(spark, rows=AWKWARD):
    """With extra columns whose names clash with what the operators make."""
    return spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, lang string, n_words int, kept string")
