"""CSV records of files of any size: lines are read in parallel, and quotes decide which line breaks end a record.

Each block of a file counts its quotes; the running parity of these counts tells whether a block begins inside a quoted cell.
A break at even parity ends a record. Only records of several lines are ever shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskloom.errors import ValidationError
from riskloom.session import cut_lineage, shared_folder

#: After doubled quotes are gone: a quote that begins or ends a cell. Others, as in 5" x 7", are plain characters.
EDGE_QUOTE = r'(?:(?<=^|,)"|"(?=,|\r?$))'


def raw_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    try:
        return spark.read.option("lineSep", "\n").text(path)
    except AnalysisException as error:
        raise ValidationError(f"{name}: nothing to read at {path}") from error


def edge_quotes(value: Column) -> Column:
    """How many quotes of a line begin or end a cell; the pattern is only tried on lines that hold quotes."""
    return F.when(F.contains(value, F.lit('"')), F.regexp_count(F.replace(value, F.lit('""'), F.lit("")), F.lit(EDGE_QUOTE))).otherwise(F.lit(0))


def numbered_lines(lines: DataFrame, charset: str = "UTF-8") -> DataFrame:
    """(file, block, id, value, quotes): id ascends within a block, block is the offset at which it begins."""
    value = F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    lines = lines.select(value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.select("file", "block", F.monotonically_increasing_id().alias("id"), "value", edge_quotes(F.col("value")).alias("quotes"))


def marked_lines(lines: DataFrame, name: str, charset: str = "UTF-8") -> DataFrame:
    """(file, block, id, value, header, starts, ends): whether a line begins its file, and begins and ends a record.

    Raises where the last quoted cell of a file never ends. Lines are read, numbered and counted once for what leads to it and
    once for the result, which is written to the shared folder, as several steps read it.
    """
    lines = numbered_lines(lines, charset)
    key = ["file", "block"]
    inside = Window.partitionBy(*key).orderBy("id")
    # One row for each block of a file.
    blocks = lines.groupBy(*key).agg(F.sum("quotes").alias("total"))
    along = Window.partitionBy("file").orderBy("block")
    blocks = cut_lineage(blocks.select(*key, (F.coalesce(F.sum("total").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2).alias("opens"),
                                       (F.sum("total").over(Window.partitionBy("file")) % 2).alias("unclosed")))
    if blocks.where("unclosed = 1").limit(1).count():
        raise ValidationError(f"{name}: a quoted cell never ends")
    before = F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.join(blocks.select(*key, "opens"), key).select(
        *key, "id", "value", F.row_number().over(inside).alias("place"), ((before + F.col("opens")) % 2 == 0).alias("starts"), ((before + F.col("quotes") + F.col("opens")) % 2 == 0).alias("ends"))
    target = f"{shared_folder(lines.sparkSession)}/lines-{uuid.uuid4().hex}"
    marked.select(*key, "id", "value", ((F.col("block") == 0) & (F.col("place") == 1)).alias("header"), "starts", "ends").write.parquet(target)
    return lines.sparkSession.read.parquet(target)


def header_record(marked: DataFrame) -> str | None:
    """The header of some file, most often a line of its own; None where no file has one."""
    lone = marked.where("header AND starts AND ends").select(F.regexp_replace("value", "\r$", "").alias("record"))
    first = lone.where(F.trim("record") != "").first() or joined_records(marked).where("header").select("record").first()
    return first and first.record


def joined_records(marked: DataFrame) -> DataFrame:
    """(record, header) of marked lines: the text of every record that is not blank, line breaks inside quoted cells included."""
    key = ["file", "block"]
    inside, along = Window.partitionBy(*key).orderBy("id"), Window.partitionBy("file").orderBy("block")
    single = marked.where("starts AND ends").select("value", "header")
    # Lines of longer records take the place of the line that starts them, which may stand in an earlier block.
    several = marked.where("NOT (starts AND ends)")
    first = F.when(F.col("starts"), F.struct("block", "id"))
    own = F.last(first, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    several = several.select(*key, "id", "value", "header", own.alias("own"))
    carried = several.groupBy(*key).agg(F.max("own").alias("latest"))
    carried = carried.select(*key, F.last("latest", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    several = several.join(carried, key, "left").withColumn("first", F.coalesce("own", "carried"))
    joined = several.groupBy("file", "first").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "value"))), lambda r: r["value"]), "\n").alias("value"), F.max("header").alias("header"))
    records = single.unionByName(joined.select("value", "header"))
    return records.select(F.regexp_replace("value", "\r$", "").alias("record"), "header").where(F.trim("record") != "")


def csv_records(lines: DataFrame, name: str, charset: str = "UTF-8") -> DataFrame:
    """(record, header): the text of every record that is not blank, line breaks inside quoted cells included.

    The first record of each file is its header. Raises where the last quoted cell of a file never ends.
    """
    return joined_records(marked_lines(lines, name, charset))
