"""Raw tab-separated files: scan, field split, null tokens and numeric coercion.

Lines are split by the tab character alone. A quote is an ordinary character, so a field
that opens one cannot swallow the rows after it. Short lines are padded with nulls, lines
with too many fields are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StringType

from wirepulse.schema import raw_schema

# Words inside raw file names that tell the tables apart.
FILE_KINDS = {"events": "export", "mentions": "mentions", "gkg": "gkg"}

# Field texts that mean "no value" (the defaults of the pandas text reader).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Java number syntax that is no decimal number: type suffixes and hexadecimal.
_JAVA_ONLY_NUMBER = "[0-9.][dDfF]\\s*$|[xX]"


def file_pattern(table: str) -> str:
    """File-name glob of a table, blind to letter case."""
    kind = FILE_KINDS[table]
    return "*." + "".join(f"[{letter}{letter.upper()}]" for letter in kind) + ".*"


# Archives that the text reader would take for lines.
_UNREADABLE = "(?i)[.](zip|7z|rar|tar|tgz)$"


class UnreadableFiles(ValueError):
    """Raw files in a form that Spark does not decode; unpack them first."""


def raw_files(spark: SparkSession, raw_dir: str, table: str) -> DataFrame:
    """``path, modified`` of a table's raw files, from the listing alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", file_pattern(table)).load(raw_dir)
    return listed.select("path", F.col("modificationTime").alias("modified"))


def refuse_archives(files: DataFrame) -> None:
    """Raise an error that names some archives among the files, if there are any."""
    found = [row["path"] for row in files.where(F.col("path").rlike(_UNREADABLE)).limit(3).collect()]
    if found:
        raise UnreadableFiles(f"unpack these files first, Spark cannot decode them: {', '.join(found)}")


def read_lines(spark: SparkSession, paths: str | list[str], table: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", file_pattern(table)).text(paths)


def scan_lines(spark: SparkSession, raw_dir: str, table: str) -> DataFrame:
    """Lines of a table's raw files, plain or compressed with a codec Spark knows.

    Archives raise ``UnreadableFiles``.
    """
    refuse_archives(raw_files(spark, raw_dir, table))
    return read_lines(spark, raw_dir, table)


def stream_lines(
    spark: SparkSession,
    raw_dir: str,
    table: str,
    max_files: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """The same lines as a stream that picks up new files.

    ``pattern`` replaces the name rule for a folder that holds one table only.
    """
    reader = spark.readStream.option("pathGlobFilter", pattern or file_pattern(table))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(raw_dir)


def _value(text: Column) -> Column:
    return F.when(~text.isin(*NULL_TOKENS), text)


def coerced(text: Column, kind: DataType) -> Column:
    """``text`` as ``kind``, null when it is no such number.

    Integer columns also take decimal notation of a whole number.
    """
    if isinstance(kind, StringType):
        return text
    number = F.when(~text.rlike(_JAVA_ONLY_NUMBER), text.try_cast("double"))
    if isinstance(kind, DoubleType):
        return number
    whole = F.when(number == F.floor(number), number.try_cast(kind))
    return F.coalesce(text.try_cast(kind), whole)


REJECT_COLUMNS = "file string, line string, reason string"


def rejected_lines(lines: DataFrame, table: str) -> DataFrame:
    """``file, line, reason`` of the lines that ``parse_lines`` leaves out; read them from files."""
    width = len(raw_schema(table).names)
    reason = F.when(F.col("value") == "", "blank").when(F.size(F.split("value", "\t", -1)) > width, "too many fields")
    return (
        lines.select(F.input_file_name().alias("file"), F.col("value").alias("line"), reason.alias("reason"))
        .where("reason IS NOT NULL")
    )


def split_fields(lines: DataFrame, table: str) -> DataFrame:
    """Raw lines as named string columns with null tokens removed."""
    names = raw_schema(table).names
    fields = lines.where("value != ''").select(F.split("value", "\t", -1).alias("fields"))
    return fields.where(F.size("fields") <= len(names)).select(*[
        _value(F.get("fields", F.lit(position))).alias(name) for position, name in enumerate(names)
    ])


def coerce_numbers(texts: DataFrame, table: str) -> DataFrame:
    """String columns as the declared types; unreadable numbers become null."""
    return texts.select(*[
        coerced(F.col(field.name), field.dataType).alias(field.name)
        for field in raw_schema(table).fields
    ])


def parse_lines(lines: DataFrame, table: str) -> DataFrame:
    """Raw lines (batch or stream) as typed rows."""
    return coerce_numbers(split_fields(lines, table), table)


def read_raw(spark: SparkSession, raw_dir: str, table: str) -> DataFrame:
    """Typed rows of a table's raw files."""
    return parse_lines(scan_lines(spark, raw_dir, table), table)
