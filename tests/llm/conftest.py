"""Small frames with the awkward rows that every operator must take."""
import pytest


@pytest.fixture()
def frame(spark):
    """Rows as a frame over several partitions, with extra columns of clashing names."""
    def make(rows, schema, extra=("id", "row", "key", "n", "block", "c0", "_id")):
        df = spark.createDataFrame(rows, schema).repartition(5)
        from pyspark.sql import functions as F
        for i, c in enumerate(extra):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(i))
        return df
    return make
