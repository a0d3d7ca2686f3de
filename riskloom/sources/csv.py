"""Discovery and schema-checked reading of CSV tables."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from riskloom.errors import ValidationError
from riskloom.functions.columns import blank_to_null, to_number
from riskloom.operators.quality import check_table, column_problems
from riskloom.operators.relations import transaction_table
from riskloom.schema import Contract, related_specs, wide_spec
from riskloom.session import shared_folder
from riskloom.sources.rows import edge_quotes, header_record, joined_records, marked_lines, raw_lines

# Windows-1252 characters that ISO-8859-1 decodes to C1 controls, and the five undefined bytes.
WINDOWS_CODES = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
WINDOWS_CHARACTERS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
WINDOWS_UNDEFINED = "[\x81\x8d\x8f\x90\x9d]"


@dataclass(frozen=True)
class LoadedTable:
    """A typed table with its load report."""

    frame: DataFrame
    report: dict


def discover_csv(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, str]:
    """Path of each wanted file below a root; missing and repeated names are errors.

    A folder that bears a wanted name, as Spark writes a table, counts as one file. Only two paths of a name are kept.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root)
        parts = F.split("path", "/")
        own, above = F.element_at(parts, -1).isin(*names), F.try_element_at(parts, F.lit(-2)).isin(*names)
        place = F.when(own, F.col("path")).when(above, F.regexp_replace("path", "/[^/]*$", ""))
        found = (
            files.select(place.alias("place")).where(F.col("place").isNotNull())
            .groupBy(F.element_at(F.split("place", "/"), -1).alias("name"))
            .agg(F.min("place").alias("place"), F.max("place").alias("other")).collect()
        )
    except AnalysisException as error:
        raise ValidationError(f"no folder to search at {root}") from error
    by_name = {r["name"]: r for r in found}
    if missing := sorted(set(names) - set(by_name)):
        raise ValidationError(f"absent below {root}: {missing}")
    if repeated := {n: (r.place, r.other) for n, r in by_name.items() if r.place != r.other}:
        raise ValidationError(f"found more than once below {root}: {repeated}")
    return {n: by_name[n].place for n in names}


def _header(line: str) -> list[str]:
    return next(csv.reader([line.removeprefix("\ufeff")]), [])


def _line_facts(lines: DataFrame, name: str) -> tuple[str, bool]:
    """(encoding, whether every record is a line of its own), from one pass over the lines.

    utf-8 when every line is valid UTF-8, else cp1252. A record spans lines only where a line leaves a quote open; returns
    inside lines and lines of other white space are left to the general way, too.
    """
    value = F.regexp_replace("value", "\r$", "")
    returned = F.contains("value", F.lit("\r"))  # most lines hold none, so the pattern is only tried on those that do
    spanning = (edge_quotes(F.col("value")) % 2 == 1) | (returned & F.contains(value, F.lit("\r"))) | (value.rlike("^[\\x00-\\x20]*$") & (F.trim(value) != ""))
    row = lines.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.is_valid_utf8("value")).alias("broken"), F.count_if(spanning).alias("spanning")).first()
    if not row.n:
        raise ValidationError(f"{name}: the CSV is empty or has no header")
    return "cp1252" if row.broken else "utf-8", not row.spanning


def read_text_cells(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, str, list[str]]:
    """All cells as text in header order, plus `_malformed` holding rows with too few or many fields.

    Quoted cells may hold line breaks; they are read in parallel all the same. Where no cell does, lines need not be put
    together and no row is shuffled.
    """
    lines = raw_lines(spark, path, name)
    encoding, lone = _line_facts(lines, name)
    charset = "UTF-8" if encoding == "utf-8" else "ISO-8859-1"
    if lone:
        # The first line that a scan meets of a first block is the first line of its file.
        first = lines.where(F.col("_metadata.file_block_start") == 0).select(F.decode(F.col("value").cast("binary"), charset)).first()
        lone = first is not None and bool(first[0].strip(" \r"))
    if not lone:
        marked = marked_lines(lines, name, charset)
        records, top = joined_records(marked), header_record(marked)
    else:
        top = first[0].removesuffix("\r")
    names = _header(top) if top is not None else []
    if not names:
        raise ValidationError(f"{name}: the CSV is empty or has no header")
    if len(set(names)) != len(names):
        raise ValidationError(f"{name}: the header repeats a column")
    schema = ", ".join(f"`{c}` STRING" for c in [*(f"_cell_{i}" for i in range(len(names))), "_malformed"])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed", "escape": '"'}
    if lone:
        # All cells of a row are parsed whichever are asked for, so malformed rows are seen in any case.
        frame = spark.read.schema(schema).options(header=True, encoding=charset, columnPruning=False, **options).csv(path)
    else:
        frame = records.where("NOT header").select(F.from_csv("record", schema, options).alias("row")).select("row.*")
    frame = frame.select(*[F.col(f"_cell_{i}").alias(c) for i, c in enumerate(names)], "_malformed")
    if encoding == "cp1252":
        undefined = F.lit(False)
        for c in names:
            undefined = undefined | F.coalesce(F.col(c).rlike(WINDOWS_UNDEFINED), F.lit(False))
        if frame.where(undefined).limit(1).count():
            raise ValidationError(f"{name}: neither UTF-8 nor Windows-1252")
        frame = frame.withColumns({c: F.translate(c, WINDOWS_CODES, WINDOWS_CHARACTERS) for c in names})
    return frame, encoding, names


def _number(field: T.StructField) -> Column:
    """The cell in its declared type. Whole numbers are read from their text, so every digit counts, and a fraction other
    than zeros is no whole number."""
    number = to_number(field.name)
    if not isinstance(field.dataType, T.IntegralType):
        return number.try_cast(field.dataType)
    plain, whole = F.trim(field.name), r"^[+-]?\d+$"
    text = F.regexp_replace(plain, r"\.0*$", "")
    return F.when(plain.rlike(whole), plain.try_cast(field.dataType)).when(text.rlike(whole), text.try_cast(field.dataType)).otherwise(
        F.when(number == F.floor(number), number.try_cast(field.dataType)))


def read_csv(spark: SparkSession, path: str, spec: Contract, *, duplicate_policy: str = "report",
             coerce: bool = False, typed: bool = True) -> LoadedTable:
    """Reads and validates one CSV; duplicates are reported and never removed.

    The text is parsed into typed cells once, written to the shared folder as columns, while malformed rows and cells that are
    no numbers are counted in the same pass; every later step reads that table. Text that is no number raises, or becomes
    null with `coerce`.
    """
    if duplicate_policy not in ("report", "error"):
        raise ValueError("duplicate_policy must be 'report' or 'error'")
    frame, encoding, names = read_text_cells(spark, path, spec.name)
    if problems := column_problems(names, spec):
        raise ValidationError(f"{spec.name} {', '.join(problems)}")
    cells = frame.withColumns({c: blank_to_null(c) for c in names})
    values = {f.name: _number(f) for f in spec.schema if typed and not isinstance(f.dataType, T.StringType)}
    seen, typed_cells = Observation(), {n: f"__number_{i}" for i, n in enumerate(values)}
    cells = cells.withColumns({typed_cells[n]: v for n, v in values.items()})  # made once, then counted and written
    bad = {} if coerce else {n: F.count_if(F.col("_malformed").isNull() & F.col(n).isNotNull() & F.col(c).isNull()) for n, c in typed_cells.items()}
    counted = cells.observe(seen, F.count("_malformed").alias("_malformed"), *[count.alias(n) for n, count in bad.items()])
    target = f"{shared_folder(spark)}/{spec.name}-{uuid.uuid4().hex}"
    counted.select(*[F.col(typed_cells.get(n, n)).alias(n) for n in names]).write.parquet(target)
    if broken := seen.get["_malformed"]:
        raise ValidationError(f"{spec.name}: {broken} row(s) with other than {len(names)} fields")
    if failures := {n: seen.get[n] for n in bad if seen.get[n]}:
        raise ValidationError(f"{spec.name}: cells that are no numbers {failures}")
    out = spark.read.parquet(target)
    report = check_table(out, spec, duplicate_policy=duplicate_policy)
    return LoadedTable(out, report | {"path": path, "encoding": encoding})


def read_related_tables(spark: SparkSession, root: str, *, duplicate_policy: str = "report") -> dict[str, LoadedTable]:
    """The ten related tables, each on its own (no join)."""
    specs = related_specs()
    paths = discover_csv(spark, root, [f"{name}.csv" for name in specs])
    return {name: read_csv(spark, paths[f"{name}.csv"], spec, duplicate_policy=duplicate_policy) for name, spec in specs.items()}


def read_transaction_table(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The related tables loaded, audited and joined to transaction grain."""
    return transaction_table({name: table.frame for name, table in read_related_tables(spark, root).items()})


def check_wide_header(spark: SparkSession, path: str) -> None:
    """Exact header and at least one data row; no cell is typed or counted."""
    frame, _, names = read_text_cells(spark, path, "wide_transactions")
    if names != wide_spec().names:
        raise ValidationError(f"wide_transactions {', '.join(column_problems(names, wide_spec()))}")
    if not frame.limit(1).count():
        raise ValidationError("wide_transactions has no data rows")


def read_wide_table(spark: SparkSession, path: str, *, duplicate_policy: str = "report", allow_missing: bool = False) -> LoadedTable:
    """The wide, time-ordered numeric table."""
    return read_csv(spark, path, wide_spec(*(["gaps"] if allow_missing else [])), duplicate_policy=duplicate_policy)


def load_reports(spark: SparkSession, tables: dict[str, LoadedTable]) -> DataFrame:
    """Load reports as a table: name, rows, columns, missing cells, duplicates, encoding."""
    rows = [(name, t.report["row_count"], len(t.report["columns"]), sum(t.report["missing_values"].values()),
             t.report["duplicate_rows"], t.report["encoding"]) for name, t in tables.items()]
    return spark.createDataFrame(rows, "table_name string, row_count long, column_count long, missing_cells long, "
                                       "duplicate_rows long, encoding string")

