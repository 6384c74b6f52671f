"""Pages of a large table without ranking it: a range-partitioned dataset and its directory.

`write_pages` sorts the rows once by key, in ranges of about ROWS_PER_RANGE that are cut into files of
`rows_per_file`, and writes a directory with a row for each file: how many rows it has and how many stand
before it.  `read_page` looks the page up there and opens the files that hold it, which are one or two
unless a page is longer than a file or meets the short last file of a range; no other file is listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercalith.functions.normalize import quoted
from mercalith.plans.checker import blank_null
from mercalith.spec import ROW_ID

PAGE_SIZE = 50
ROWS_PER_FILE = 100_000
# rows sorted by one task; the driver chooses the ranges from a few rows of each
ROWS_PER_RANGE = 250_000
_FILE, _PLACE = "_file", "_place"


def write_pages(df: DataFrame, path: str, order_by: list[str] | None = None, rows_per_file: int = ROWS_PER_FILE) -> str:
    """Write `df` below `path`, ordered by `order_by`, rows of one key by all other columns as text.

    Maps and other columns that have no order are compared as JSON.  The number of files follows the
    number of rows; an empty table has an empty directory.
    """
    keys = order_by or [ROW_ID]
    rest = [c for c in df.columns if c not in keys]
    order = [*[F.col(quoted(c)) for c in keys], *[F.to_json(F.struct(F.col(quoted(c)))) for c in rest]]
    total = df.count()
    ranges = max(1, -(-total // max(rows_per_file, ROWS_PER_RANGE)))
    ranged = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # a place is the number of the range and, in its lower 33 bits, that of the row in it; a range has at
    # most as many files as all rows
    within, files = f"{_PLACE} & 8589934591", max(1, -(-total // rows_per_file))
    numbered = f"shiftright({_PLACE}, 33) * {files} + ({within}) DIV {rows_per_file}"
    placed = ranged.withColumn(_PLACE, F.monotonically_increasing_id()).withColumn(_FILE, F.expr(numbered))
    # without rows there is no partition, only the columns
    (placed.write.partitionBy(_FILE) if total else placed.write).parquet(f"{path}/rows")
    spark = df.sparkSession
    sizes = spark.read.parquet(f"{path}/rows").groupBy(_FILE).agg(F.count("*").alias("n"), F.min(_PLACE).alias("first"))
    # a row for each file
    before = F.coalesce(F.sum("n").over(Window.orderBy(_FILE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.withColumn("before", before).coalesce(1).write.parquet(f"{path}/directory")
    return path


def files_of_page(spark: SparkSession, path: str, number: int = 1, size: int = PAGE_SIZE) -> list:
    """The directory rows of the files that hold page `number` (from 1)."""
    begin = (number - 1) * size
    held = spark.read.parquet(f"{path}/directory").where((F.col("before") < begin + size) & (F.col("before") + F.col("n") > begin))
    return held.orderBy(_FILE).collect()  # one or two rows, or as many files as a page is long


def read_page(spark: SparkSession, path: str, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """Page `number` of what `write_pages` wrote, in order, as text with NULL shown as ''; empty behind the end."""
    held = files_of_page(spark, path, number, size)
    # behind the end any one file tells the columns
    some = held or spark.read.parquet(f"{path}/directory").limit(1).collect()
    places = [f"{path}/rows/{_FILE}={r[_FILE]}" for r in some] or [f"{path}/rows"]
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*places)
    shown = [c for c in rows.columns if c not in (_FILE, _PLACE)]
    rows = rows if held else rows.limit(0)
    if held:
        # a file's rows are numbered one after the other
        start = (number - 1) * size
        low = held[0]["first"] + max(0, start - held[0]["before"])
        high = held[-1]["first"] + start + size - held[-1]["before"]
        rows = rows.where((F.col(_PLACE) >= low) & (F.col(_PLACE) < high))
    return rows.orderBy(_PLACE).select(*[blank_null(c) for c in shown])


def total_rows(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/directory").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
