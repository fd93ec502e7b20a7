"""Awkward documents that each operator has to take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, row string, score string"


def awkward(spark, extra=()):
    """Nulls in any column, empty, blank and long texts, repeated rows, ties, and columns with clashing names."""
    words = "the of anline onerth ention in hera tion stand er".split()
    long = " ".join(words[(k * k + k // 7) % 10] + ("." if k % 11 == 0 else "") + ("\n" if k % 17 == 0 else "") for k in range(6000))
    texts = [None, "", " \n\t ", "one", "two words", "the the the the the the", "Straße É é ́x İ 日本 😀 \x01", "x" * 9000, long, long, "a b c\na b c\n", *extra]
    rows = [(k, t, "en", "s", None if t is None else len(t), "1", "2", "3") for k, t in enumerate(texts)]
    rows += [rows[4], (None, "no id here at all", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
