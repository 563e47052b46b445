"""Tables clustered by group, so that grouping, source joins and selections need no exchange of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from nlimorph.operators.groups import KEY


ROWS_A_BUCKET = 250_000


def buckets_for(n_rows: int, least: int = 8) -> int:
    """A number of buckets that grows with the rows, so that a bucket does not."""
    return max(least, -(-n_rows // ROWS_A_BUCKET))


def write_clustered(df: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """df as a table in ``buckets`` buckets of its group key, one sorted file each, read back; in ``path`` or in the warehouse.

    Choose the number so that a bucket fits a task (some 100 MB); it is the parallelism of what follows. A large
    group lies in one bucket whole.
    """
    writer = df.repartition(buckets, *KEY).write.mode("overwrite").format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)
