"""Small tables for the corpus operators."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def doc_rows(spark, pairs, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t) if t is not None else None) for i, t in pairs], DOCUMENTS)


def write_tables(spark, folder, **tables):
    for name, frame in tables.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
