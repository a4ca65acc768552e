"""Readers and writers: JSON lines, JSON cells, CSV, seed folders, archives, candidates in order."""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.sources.scratch import new_path


def write_jsonl(df: DataFrame, path: str | None = None, *, name: str = "jsonl") -> str:
    """One object a line; the committer makes the job atomic."""
    path = path or new_path(df.sparkSession, name)
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_cells(spark: SparkSession, path: str, schema: str, *, multi_line: bool = False) -> DataFrame:
    """Result cells with their rows exploded beside the cell's columns; unreadable ones are skipped."""
    cells = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", multi_line).json(path)
    others = [c for c in cells.columns if c != "rows"]
    return cells.select(*others, F.explode("rows").alias("__row")).select(*others, "__row.*")


def write_csv(df: DataFrame, path: str | None = None, *, name: str = "csv") -> str:
    path = path or new_path(df.sparkSession, name)
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_seeds(df: DataFrame, seed_col: str, path: str | None = None) -> str:
    path = path or new_path(df.sparkSession, "seeds")
    df.write.mode("overwrite").option("header", True).partitionBy(seed_col).csv(path)
    return path


def read_seeds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all seed folders with the seed from the path; columns that a seed lacks are null."""
    return spark.read.schema(f"{schema}, seed int").option("header", True).csv(path)


def write_small_json(value: object, path: str) -> None:
    """A driver-side result: written beside its place and moved there."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def read_zip_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of the JSON arrays in zip archives; each archive is one task's work."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    lines = [json.dumps(r) for n in sorted(z.namelist()) if n.endswith(".json") for r in json.loads(z.read(n))]
                yield pa.record_batch([pa.array(lines, pa.string())], names=["line"])

    lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "line string")
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")


def first_readable(candidates: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first candidate source that opens and has a row."""
    errors = []
    for make in candidates:
        try:
            df = make()
            if not df.isEmpty():
                return df
            errors.append("empty")
        except Exception as e:  # noqa: BLE001  any reader may fail in its own way
            errors.append(str(e).splitlines()[0] if str(e) else type(e).__name__)
    raise ValueError(f"no candidate could be read: {errors}")


def write_wide_csv(df: DataFrame, path: str | None = None, *, index: str, levels: tuple[str, str], value: str, columns: list[tuple[str, str]]) -> str:
    """A long table (index, two levels, value) as CSV with two header rows; `columns` names the pairs of levels in order.

    Each file starts with the header: the first level beside the index's place, the second below it, then the name of
    the index alone.  Cells without a value are empty.
    """
    path = path or new_path(df.sparkSession, "wide-csv")
    key = F.concat_ws("\x01", F.col(levels[0]).cast("string"), F.col(levels[1]).cast("string"))
    wide = df.withColumn("__k", key).groupBy(index).pivot("__k", ["\x01".join(c) for c in columns]).agg(F.first(value))
    line = F.to_csv(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(wide.columns)]), {"emptyValue": "", "nullValue": "", "escape": '"'})

    def quoted(cells: list[str]) -> str:
        return ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\\') else c for c in cells)

    head = "\n".join([quoted([levels[0], *(a for a, _ in columns)]), quoted([levels[1], *(b for _, b in columns)]), quoted([index, *("" for _ in columns)])])

    def headed(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.record_batch([pa.array([head])], names=["line"])
                first = False
            yield batch

    wide.select(line.alias("line")).mapInArrow(headed, "line string").write.mode("overwrite").text(path)
    return path


def read_wide_csv(spark: SparkSession, path: str, *, index: str | None = None, levels: tuple[str, str] = ("level_0", "level_1"), value: str = "value") -> DataFrame:
    """index, two levels, value (double) of CSV files with two header rows and, if there is one, a row with the index's name.

    The header rows are read apart (two lines of one file) and are no data wherever they stand again.  An empty
    first-level cell repeats the one before it, as spreadsheets write them.  Cells without a number give no row.
    """
    width = len(spark.read.option("header", False).csv(path).columns)
    names = [f"c{i}" for i in range(width)]
    cells = spark.read.schema(", ".join(f"{c} string" for c in names)).option("header", False).option("escape", '"').csv(path)
    top, below = (["" if x is None else x for x in r] for r in cells.head(2))
    for i in range(2, width):
        top[i] = top[i] or top[i - 1]
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    equal = lambda row: F.array(*[F.coalesce(F.col(c), F.lit("")) for c in names]) == F.array(*map(F.lit, row))
    raw = cells.head(1)[0]
    heads = equal(["" if x is None else x for x in raw]) | equal(below)
    named = F.lit(True)
    for c in names[1:]:
        named = named & blank(c)
    third = cells.filter(named & ~blank("c0")).head(1)
    rows = cells.filter(~heads & ~(named & F.lit(bool(third))))
    index = index or (third[0]["c0"] if third else "index")
    each = F.array(*[F.struct(F.lit(top[i]).alias(levels[0]), F.lit(below[i]).alias(levels[1]), F.col(names[i]).try_cast("double").alias(value)) for i in range(1, width)])
    return rows.select(F.col("c0").alias(index), F.explode(each).alias("__x")).select(index, "__x.*").filter(F.col(value).isNotNull())
