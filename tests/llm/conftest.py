import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, digest string, place string, label int"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table, with columns whose names clash with the operators' own."""

    def make(rows, path=None):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "d", "p", 0) for i, t in rows], DOCS)
        if path:  # operators that read twice get a stored table
            df.write.mode("overwrite").parquet(str(path))
            df = spark.read.parquet(str(path))
        return df

    return make
