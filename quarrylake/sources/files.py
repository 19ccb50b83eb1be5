"""Files of chunks, structured rows and logs: scans that keep file names, places and line order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CHUNK_FILE = "stem string, doc_id long, chunks array<struct<content: string>>"


def write_chunks(docs: DataFrame, path: str) -> None:
    """One JSON row a document: (stem, doc_id, chunks)."""
    docs.write.json(path)


def chunks(spark: SparkSession, path: str, schema: str = CHUNK_FILE, multi_line: bool = False) -> DataFrame:
    """(stem, doc_id, idx, content) of every chunk that isn't blank; ``idx`` is its place in the file's list. ``stem`` falls back to the file's name."""
    rows = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    stem = F.coalesce("stem", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    each = rows.select(stem.alias("stem"), "doc_id", F.posexplode("chunks").alias("idx", "c")).select("stem", "doc_id", "idx", F.col("c.content").alias("content"))
    return each.filter(F.trim(F.coalesce("content", F.lit(""))) != "")


def structured(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Rows of JSON files that parse to ``schema``; broken ones are left out without failing the read."""
    kind = StructType.fromDDL(schema)
    whole = StructType([*kind.fields, StructField("_broken", StringType())])
    rows = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("multiLine", multi_line).json(path)
    # read with a further column: the corrupt record alone may not be asked for
    return rows.withColumn("ok", F.col("_broken").isNull()).filter("ok").select(*kind.fieldNames())


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header line."""
    return spark.read.schema(schema).option("header", True).csv(path)


def versions(rows: DataFrame, keys: list[str], version: str, order: str) -> DataFrame:
    """One row a key and version: the last by ``order``."""
    return latest(rows, [*keys, version], order)


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key: the greatest by ``order``; pre-aggregated before the shuffle. Null keys are one key."""
    values = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("picked"))
    return picked.select(*keys, *[F.col(f"picked.{c}").alias(c) for c in values]).select(*rows.columns)


def layered(spark: SparkSession, paths: list[str], schema: str, key: str, time: str, order: str) -> DataFrame:
    """The latest row of each key over several folders of CSV files, with its ``layer``; of equal times the later folder's, then the greater ``order``."""
    out = None
    for i, path in enumerate(paths):
        one = log(spark, path, schema).withColumn("layer", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return latest(out, [key], time, "layer", order)


def golden_set(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a CSV golden set with a question: ``columns`` only, as trimmed strings."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns]).filter(F.col("question") != "")


def write_golden_set(items: DataFrame, path: str, columns: list[str]) -> None:
    """The golden set's columns, in their order."""
    items.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def stems(spark: SparkSession, path: str, suffix: str = "pdf") -> DataFrame:
    """(stem, dept, term, course, section, crn, path) of the files below a folder, by their names; file contents are never read. Names of fewer parts give nulls."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(path).select("path")
    name = F.regexp_replace(F.substring_index("path", "/", -1), rf"\.{suffix}$", "")
    part = lambda i: F.get(F.split("stem", "_"), F.lit(i))
    return found.select(name.alias("stem"), "path").select("stem", F.upper(part(1)).alias("dept"), part(0).alias("term"), part(2).alias("course"), part(3).alias("section"), part(4).alias("crn"), "path")


def catalogue_numbers(spark: SparkSession, path: str, dept: str, least: int = 600) -> DataFrame:
    """(course) of a catalogue's lines that name a course of the department at ``least`` or above, once each."""
    number = F.regexp_extract("value", rf"\b{dept}\s+(\d{{3}})\b", 1).try_cast("int")
    return spark.read.text(path).select(number.alias("number")).filter(F.col("number") >= least).select(F.concat_ws(" ", F.lit(dept), F.col("number").cast("string")).alias("course")).distinct()


def manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(stem, url, doc_id) of manifests ({file name: {url, doc_id}}), the last manifest that names a file counts."""
    out = None
    for i, path in enumerate(paths):
        one = spark.read.schema("value string").text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<url: string, doc_id: string>>")).alias("file", "m"), F.lit(i).alias("nth"))
        out = one if out is None else out.unionByName(one)
    last = out.groupBy("file").agg(F.max_by("m", "nth").alias("m"))
    return last.select(F.regexp_replace("file", r"\.pdf$", "").alias("stem"), "m.url", "m.doc_id")
