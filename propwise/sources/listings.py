"""Listing sources and the raw -> typed ingest.

Scraped files are read with an explicit all-string schema (no inference pass),
headers are normalised, then one projection parses every column (F1-F4).
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as X

CANONICAL = ["harga", "kamar_tidur", "kamar_mandi", "garasi", "luas_tanah", "luas_bangunan", "lokasi"]

# Header spellings seen in scraped files -> canonical name (matched case-insensitively,
# spaces/underscores ignored, so "Kamar Tidur", "kamar_tidur" and "kamarTidur" all map).
_ALIASES = {
    "harga": "harga",
    "kamartidur": "kamar_tidur",
    "kamarmandi": "kamar_mandi",
    "garasi": "garasi",
    "luastanah": "luas_tanah",
    "luasbangunan": "luas_bangunan",
    "lokasi": "lokasi",
    "kecamatan": "lokasi",
}
_DROP = {"page"}


class MissingColumnsError(ValueError):
    pass


def _norm(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isalnum())


def read_listings_csv(spark: SparkSession, path: str, header_names: list[str] | None = None) -> DataFrame:
    """Scan listing CSV files with every column as text, each file by its own header.

    Spark's reader takes one header for all files, so files are grouped by their header line
    (read from the files' first lines; quoted names included) and each group is read with its
    own schema.  Column names are united across groups; a column that a file lacks is null.
    """
    if header_names is not None:
        return _read_csv(spark, [path], header_names)
    # the first line of each file: all lines that start at byte 0
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("at"),
                                         F.monotonically_increasing_id().alias("pos"))
    first = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "pos").alias("header"))
    by_header: dict[str, list[str]] = {}
    for r in first.collect():  # one short row for each file
        by_header.setdefault(r["header"], []).append(r["file"])
    out = None
    for header in sorted(by_header):
        names = next(csv.reader([header.lstrip("\ufeff")]))
        part = _read_csv(spark, sorted(by_header[header]), [n.strip() for n in names])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return spark.createDataFrame([], T.StructType()) if out is None else out


def _read_csv(spark: SparkSession, paths: list[str], names: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
            .option("mode", "PERMISSIVE").csv(paths))


def normalize_columns(df: DataFrame, required: list[str] = CANONICAL) -> DataFrame:
    """Rename aliases to canonical names, drop Page; fail listing missing columns.

    Where several columns mean the same (``lokasi`` and ``Kecamatan``), the canonical spelling
    wins and fills its nulls from the others, in the order they stand.
    """
    meant: dict[str, list[str]] = {}
    for c in df.columns:
        target = _ALIASES.get(_norm(c))
        if target:
            meant.setdefault(target, []).append(c)
    cols, done = [], set()
    for c in df.columns:
        if _norm(c) in _DROP:
            continue
        target = _ALIASES.get(_norm(c))
        if target is None:
            cols.append(F.col(f"`{c}`"))
        elif target not in done:
            done.add(target)
            same = sorted(meant[target], key=lambda n: n != target)
            cols.append(F.coalesce(*[F.col(f"`{n}`") for n in same]).alias(target) if len(same) > 1
                        else F.col(f"`{same[0]}`").alias(target))
    missing = [c for c in required if c not in done]
    if missing:
        raise MissingColumnsError(f"missing required columns: {missing}")
    return df.select(*cols)


def ingest_raw(df: DataFrame) -> DataFrame:
    """Raw text -> RawProperty types: F1 price, F2 areas, F3 numerics, F4 garage.

    Missing area stays null here (dropped by the cleaning jobs).
    """
    keep = [c for c in df.columns if c not in CANONICAL]
    return df.select(
        *keep,
        X.parse_price("harga").alias("harga"),
        X.coerce_numeric("kamar_tidur").try_cast("int").alias("kamar_tidur"),
        X.coerce_numeric("kamar_mandi").try_cast("int").alias("kamar_mandi"),
        X.fill_garage(X.coerce_numeric("garasi").try_cast("int")).alias("garasi"),
        X.parse_area("luas_tanah").alias("luas_tanah"),
        X.parse_area("luas_bangunan").alias("luas_bangunan"),
        F.col("lokasi").cast("string").alias("lokasi"),
    )


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None,
               renames: dict[str, str] | None = None) -> DataFrame:
    """Scan a stored table with projection (pruned at the parquet reader) and renames."""
    df = spark.read.parquet(path)
    if renames:
        df = df.withColumnsRenamed(renames)
    return df.select(*columns) if columns else df


def read_with_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Primary table, or — when it is empty — the secondary padded with null cluster columns.

    ``isEmpty`` reads at most one row of the primary.
    """
    if not primary.isEmpty():
        return primary
    return secondary.unionByName(primary.limit(0), allowMissingColumns=True)
