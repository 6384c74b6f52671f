"""Reading source tables and describing what was read."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercalith.functions.normalize import quoted

# What a pandas reader takes for a missing value in text files.
PANDAS_NULLS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


REJECT_COLUMN = "_rejected"


def read_csv(
    spark: SparkSession,
    path: str,
    pandas_nulls: bool = False,
    *,
    delimiter: str = ",",
    encoding: str = "UTF-8",
    multi_line: bool = False,
    on_bad_row: str = "fail",
) -> DataFrame:
    """A CSV file (or folder of them) with a header, every column text.

    Leading zeros and words such as 'N/A' are kept, because rules look for exactly those;
    empty fields are NULL, quoted or not.  `pandas_nulls` turns the usual missing-value words into
    NULL too.  Quoted line ends need `multi_line`, which reads each file in one task.  A row with
    more or fewer fields than the header raises; `on_bad_row="keep"` keeps it with its whole text in
    the column `_rejected`, NULL for good rows.
    """
    reader = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("sep", delimiter)
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("emptyValue", "")
        .option("columnPruning", False)  # else a query of few columns never sees a bad row
    )
    names = reader.option("inferSchema", False).csv(path).columns
    # a field too many or too few only shows where all columns and the reject column are read
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, REJECT_COLUMN]])
    if on_bad_row == "keep":
        read = reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECT_COLUMN).csv(path)
    elif on_bad_row == "fail":
        read = reader.schema(T.StructType(schema.fields[:-1])).option("mode", "FAILFAST").csv(path)
    else:
        raise ValueError(f"on_bad_row is 'fail' or 'keep', not {on_bad_row!r}")
    words = PANDAS_NULLS if pandas_nulls else ("",)
    return read.select(
        *[F.when(~F.col(quoted(c)).isin(*words), F.col(quoted(c))).alias(c) for c in names],
        *([REJECT_COLUMN] if on_bad_row == "keep" else []),
    )


_READERS = {
    ".csv": read_csv,
    ".parquet": lambda spark, path: spark.read.parquet(path),
    ".json": lambda spark, path: spark.read.json(path),
}


def ingest(spark: SparkSession, paths: list[str], **csv_options) -> dict[str, DataFrame]:
    """Read every path by its suffix; tables are named by file stem; `csv_options` go to `read_csv`.

    Unknown suffixes are refused, and so are two files with the same stem, since one would
    hide the other.
    """
    tables: dict[str, DataFrame] = {}
    for path in paths:
        name = PurePosixPath(path.rstrip("/"))
        reader = _READERS.get(name.suffix.lower())
        if reader is None:
            raise ValueError(f"Unsupported file type: {name.suffix}")
        if name.stem in tables:
            raise ValueError(f"Two files provide a table named {name.stem}")
        tables[name.stem] = reader(spark, path, **(csv_options if reader is read_csv else {}))
    return tables


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, load_order, row_count, column_count; counts read no columns."""
    frames = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            F.lit(i).cast("bigint").alias("load_order"),
            "row_count",
            F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        )
        for i, (name, df) in enumerate(tables.items())
    ]
    return reduce(DataFrame.unionByName, frames)


def pick_largest(tables: dict[str, DataFrame]) -> DataFrame:
    """The one row of `table_stats` with most rows, the first loaded winning a tie."""
    return table_stats(tables).orderBy(F.desc("row_count"), "load_order").limit(1)
