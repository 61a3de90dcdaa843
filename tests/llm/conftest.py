import pytest


@pytest.fixture
def documents(spark):
    """Builds a documents table; missing columns are filled and extra ones with clashing names can be added."""

    def build(rows, extra=()):
        columns = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in extra)
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", None if r[1] is None else len(r[1]),
                 *["x"] * len(extra)) for r in rows]
        return spark.createDataFrame(full, columns)

    return build
