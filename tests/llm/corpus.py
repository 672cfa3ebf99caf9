"""Documents for tests, with columns that clash with names used inside."""

#: Columns that clash with names the operators use inside.
CLASHING = "row long, found string, fp long, n long, host string, path string, part int, kept boolean, n_words long, score double, t string, w string, label string, weak boolean"


def make(spark, rows, more=True):
    """documents with columns that clash; rows: (doc_id, text, lang, source)."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + CLASHING if more else "")
    extra = (7, "x", 1, 2, "h", "p", 3, True, 4, 0.5, "t", "w", "l", False) if more else ()
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), *extra) for d, t, lang, s in rows], schema)
