"""Readers and writers for CSV and JSON files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Delimiters tried in this order; columns an export leaves out.
DELIMITERS = [",", "\t", "|", ";", "\x1e", "\x1f"]
EXPORT_DROPS = ["hnsw", "embeddings", "state"]

CORRUPT = "_corrupt_record"


def header_groups(spark: SparkSession, path: str) -> list[str | list[str]]:
    """The files below ``path`` by their first line; ``path`` itself when all have the same.

    One look at the files' first blocks. Only files that differ come to the driver, as lists by header.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
    ).filter("start = 0")
    firsts = lines.groupBy("file").agg(F.regexp_replace(F.min_by("value", "place"), "[\\ufeff\\r]", "").alias("header"))
    kinds = firsts.select("header").distinct().limit(2).count()
    if kinds < 2:
        return [path]
    return [sorted(r["files"]) for r in firsts.groupBy("header").agg(F.collect_list("file").alias("files")).orderBy("header").collect()]


def guess_delimiter(spark: SparkSession, path: str, multiline: bool = True) -> str:
    """The delimiter under which the largest share of all records has as many fields as their file's header.

    Every candidate reads the whole input. A header that none of them parts is one
    column. When two do equally well the choice is the caller's: an error says so.
    """
    groups = header_groups(spark, path)
    shares = {}
    for delimiter in DELIMITERS:
        parts = _csv_parts(spark, groups, delimiter, multiline)
        if all(len(names) > 1 for _, names in parts):
            counted = [
                frame.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(CORRUPT).isNull()).alias("fit")).first()
                for frame, names in parts]
            n, fit = (sum(c[i] for c in counted) for i in range(2))
            shares[delimiter] = fit / n if n else 1.0
    if not shares:
        return DELIMITERS[0]
    best = [d for d, share in shares.items() if share == max(shares.values())]
    if len(best) > 1:
        raise ValueError(f"{path}: {best} part the records equally well; name the delimiter")
    return best[0]


def _csv_parts(
    spark: SparkSession, groups: list[str | list[str]], delimiter: str, multiline: bool
) -> list[tuple[DataFrame, list[str]]]:
    """Rows and column names of each group of files that share a header."""
    parts = []
    for files in groups:
        reader = spark.read.options(
            header=True, sep=delimiter, quote='"', escape='"', multiLine=multiline,
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
            nullValue="\x00", emptyValue="",
        )
        names = reader.csv(files).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
        frame = reader.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).csv(files)
        blank = F.length(F.trim(F.concat_ws("", *[F.col(f"`{c}`") for c in names]))) == 0
        parts.append((frame.filter(~blank), names))
    return parts


def _csv_with_errors(
    spark: SparkSession, path: str, delimiter: str | None, multiline: bool
) -> tuple[list[tuple[DataFrame, list[str]]], str]:
    delimiter = delimiter or guess_delimiter(spark, path, multiline)
    return _csv_parts(spark, header_groups(spark, path), delimiter, multiline), delimiter


def _together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def read_csv(
    spark: SparkSession, path: str, delimiter: str | None = None, multiline: bool = True
) -> DataFrame:
    """CSV with a header, every field a string, all-blank rows left out.

    Each file is read by its own header: columns are matched by name, and one that a file lacks is null there.
    ``multiline=True`` allows line breaks inside quotes, but then each file is
    read by one task: for large inputs give many files, or ``multiline=False``.
    """
    parts, _ = _csv_with_errors(spark, path, delimiter, multiline)
    return _together([frame.drop(CORRUPT) for frame, _ in parts])


def csv_errors(
    spark: SparkSession, path: str, delimiter: str | None = None, multiline: bool = True
) -> DataFrame:
    """Rows with too few or too many fields: kind, expected and parsed counts, raw text."""
    parts, sep = _csv_with_errors(spark, path, delimiter, multiline)
    bare = F.regexp_replace(F.col(CORRUPT), '"[^"]*"', "")  # a doubled quote is two quoted parts side by side
    parsed = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    return _together([
        frame.filter(F.col(CORRUPT).isNotNull()).select(
            F.when(parsed < len(names), "TooFewFields").otherwise("TooManyFields").alias("kind"),
            F.lit(len(names)).alias("expected"),
            parsed.cast("int").alias("parsed"),
            F.col(CORRUPT).alias("raw"),
        )
        for frame, names in parts
    ])


def csv_report(
    spark: SparkSession, path: str, delimiter: str | None = None, multiline: bool = True
) -> DataFrame:
    """One row: kept rows and rows with a field-count error."""
    parts, _ = _csv_with_errors(spark, path, delimiter, multiline)
    return _together([frame.select(CORRUPT) for frame, _ in parts]).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.col(CORRUPT)).alias("n_errors")
    )


def table_name(path: Column) -> Column:
    """File name up to its first dot."""
    return F.element_at(F.split(F.element_at(F.split(path, "/"), -1), "\\."), 1)


def read_json_array(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    multiline: bool = True,
    table_column: str | None = "table_name",
) -> DataFrame:
    """JSON files, plain or gzipped (named ``.gz``); each file is one table, told apart by ``table_name``.

    ``multiline=True`` reads one array per file (one task per file);
    ``multiline=False`` reads JSON lines; plain files split, gzipped ones are one task each. ``embeddings`` becomes a
    map of float vectors whatever its inferred shape.
    """
    reader = spark.read.option("multiLine", multiline)
    if schema is not None:
        reader = reader.schema(schema)
    frame = reader.json(path if isinstance(path, str) else list(path))
    if table_column:
        frame = frame.withColumn(table_column, table_name(F.col("_metadata.file_path")))
    if "embeddings" in frame.columns:
        kind = frame.schema["embeddings"].dataType
        target = "map<string,array<float>>"
        vectors = (
            F.from_json(F.to_json("embeddings"), target)
            if isinstance(kind, T.StructType) else F.col("embeddings").cast(target)
        )
        frame = frame.withColumn("embeddings", vectors)
    return frame


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, without vectors; nested columns as JSON text."""
    kept = df.drop(*EXPORT_DROPS)
    nested = (T.StructType, T.ArrayType, T.MapType)
    columns = [
        F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
        for f in kept.schema.fields
    ]
    kept.select(*columns).write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        emptyValue="",
    ).csv(path)


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    """One JSON object per line, vectors as plain arrays, NULL fields left out."""
    df.write.option("compression", compression).json(path)


def write_json_gz(df: DataFrame, path: str) -> None:
    """The whole table with its vectors, gzipped JSON lines.

    One array per file could neither be written nor read in parallel, so the
    export is lines; ``read_json_array(multiline=False)`` reads it back.
    """
    write_jsonl(df, path, "gzip")


def model_inventory(files: DataFrame, url: str, size: str, host: str = r"huggingface\.co") -> DataFrame:
    """Cached files grouped to models: total bytes and whether quantised.

    As in a cache listing walked in URL order, the last file of a model decides
    the flag: ``true`` or ``false`` for the two model files, else empty.
    """
    from ..functions.text import model_key, url_filename

    file_name = url_filename(url)
    flag = (
        F.when(file_name == "model_quantized.onnx", "true")
        .when(file_name == "model.onnx", "false")
        .otherwise("")
    )
    return (
        files.select(
            model_key(url, host).alias("name"), F.col(url).alias("_url"),
            F.col(size).cast("long").alias("_size"), flag.alias("_flag"),
        )
        .filter(F.col("name") != "")
        .groupBy("name")
        .agg(F.sum("_size").alias("size"), F.max_by("_flag", "_url").alias("quantized"))
    )
