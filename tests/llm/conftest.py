from __future__ import annotations

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds documents from (doc_id, text[, lang[, source]]) rows, with an extra column whose name clashes."""

    def build(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) for r in rows]
        found = spark.createDataFrame(full, COLUMNS)
        if extra:
            from pyspark.sql import functions as F

            found = found.withColumns({"score": F.lit("x"), "key": F.lit(1), "component_id": F.lit("y"), "size": F.lit(None).cast("string"), "_at": F.lit(2)})
            clash = "_gone _id _spans _size _source _takes _words _row _length _text_hash _letters _text _hash _nth _first _no slot words _doc _chars _range copies part bucket rep band n c sig at".split()
            found = found.withColumns({c: F.lit(c) for c in clash})
        return found

    return build
