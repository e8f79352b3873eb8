"""Tables of a remote database by JDBC: the document table and any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows fetched at once, and connections that read side by side.
FETCH, PARTS = 10_000, 16


class Remote:
    """A database by its URL and token; the driver's jar has to be on the classpath.

    ``read`` with a numeric column and its bounds reads PARTS ranges side by
    side; filters and columns are pushed to the database.
    """

    def __init__(self, spark: SparkSession, url: str, token: str | None = None, **options):
        self.spark, self.options = spark, {"url": url, "fetchsize": str(FETCH), **({"password": token} if token else {}), **options}

    def read(self, table: str, column: str | None = None, low: int | None = None, high: int | None = None, parts: int = PARTS) -> DataFrame:
        """A table, or a query in brackets with a name."""
        reader = self.spark.read.format("jdbc").options(**self.options).option("dbtable", table)
        if column:
            reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
        return reader.load()

    def append(self, df: DataFrame, table: str) -> None:
        df.write.format("jdbc").options(**self.options).option("dbtable", table).mode("append").save()
