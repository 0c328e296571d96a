"""Documents with nulls, empty and long texts, ties, repeats and columns whose names clash with the operators' own."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, body string, row string, size int, score string"


def docs(spark, texts, sources=None, langs=None, ids=None):
    n = len(texts)
    sources, langs, ids = sources or ["s"] * n, langs or ["en"] * n, ids or list(range(n))
    rows = [(i, t, la, s, len(t or ""), "f", "b", "r", -1, "x") for i, t, la, s in zip(ids, texts, langs, sources, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]
