import sys
from pathlib import Path

import pytest
from pyspark.sql import types as D

sys.path.insert(0, str(Path(__file__).parent))

DOCS = D.StructType([D.StructField("doc_id", D.LongType()), D.StructField("text", D.StringType()),
                     D.StructField("lang", D.StringType()), D.StructField("source", D.StringType()),
                     D.StructField("n_chars", D.LongType()),
                     # names that the operators use inside
                     D.StructField("_row", D.StringType()), D.StructField("kept", D.StringType()),
                     D.StructField("id", D.StringType()), D.StructField("key", D.StringType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns of clashing names."""
    from feedscope.llm.common import prepare
    prepare(spark)

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "k", "i", "y") for i, t in rows], DOCS)
    return make

