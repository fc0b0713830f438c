"""Delimited files, read by Spark's reader and cut into bands of rows that each repeat the header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a band. Fixed value.
BAND_ROWS = 40


def read_bands(spark: SparkSession, path: str, delimiter: str = ",", rows: int = BAND_ROWS) -> DataFrame:
    """Bands (file, band, n_rows, text) of the files under ``path``; text is the header and up to ``rows`` rows, tab separated.

    Quotes may hold delimiters, doubled quotes and line ends. Rows whose cells are all empty are
    dropped. A file with quoted line ends can't be split, so one task streams it and its rows get
    rising numbers; only the least number of each file is shuffled to find where its bands begin,
    and a band never holds more than ``rows`` rows. Files must share the header of the first one.
    """
    cells = spark.read.csv(path, sep=delimiter, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    names = cells.columns
    filled = [F.coalesce(F.col(f"`{name}`"), F.lit("")) for name in names]
    numbered = (
        cells.select(F.col("_metadata.file_path").alias("file"), F.concat_ws("\t", *filled).alias("line"), F.concat_ws("", *filled).alias("all"))
        .where(F.trim("all") != "").select("file", "line", F.monotonically_increasing_id().alias("n"))
    )
    begins = numbered.groupBy("file").agg(F.min("n").alias("least"))
    band = F.floor((F.col("n") - F.col("least")) / rows).alias("band")
    grouped = numbered.join(begins, "file").groupBy("file", band).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("held"))
    text = F.concat_ws("\n", F.lit("\t".join(names)), F.transform("held", lambda r: r["line"]))
    return grouped.select("file", "band", F.size("held").alias("n_rows"), text.alias("text"))
