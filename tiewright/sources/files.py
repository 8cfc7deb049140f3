"""Readers and writers of CSV, JSON and page XML (SRC1 to SRC8, SNK1 to SNK7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALTO_BLOCK = (
    "_ID string, _HPOS int, _VPOS int, _WIDTH int, _HEIGHT int, TextLine array<struct<_HPOS: int, _VPOS: int, "
    "String: array<struct<_CONTENT: string, _SUBS_TYPE: string, _SUBS_CONTENT: string, _WC: double>>>>"
)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, every column text; empty fields are null. A missing file raises (SRC1)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"', enforceSchema=False).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_csv_or_none(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """As ``read_csv``; a missing or empty file gives no rows (SRC2)."""
    if not exists(spark, path) or spark.read.text(path).isEmpty():
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return read_csv(spark, path, columns)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, with a declared schema (SRC3)."""
    return spark.read.schema(schema).json(path)


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file (SRC4)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_blocks(spark: SparkSession, path: str, page: str = r"([0-9]+)\.xml$") -> DataFrame:
    """Text blocks of page XML, with the page number from the file's path (f0025.xml: 25) (SRC5, SRC8).

    Files are cut at the blocks' ends while they are read, so no row holds more than one block, and one file may go to several
    tasks; each block is parsed with a declared schema. ``page`` is a pattern whose group is the number. Pages are read as
    UTF-8 whatever encoding they declare. A block that cannot be parsed gives nulls, and a file without blocks no rows.
    """
    pieces = spark.read.text(path, lineSep="</TextBlock>").select(F.regexp_extract("_metadata.file_path", page, 1).cast("int").alias("page"), F.regexp_extract("value", r"(?s)<TextBlock\b.*", 0).alias("xml"))
    return _parsed(pieces)


def _parsed(pieces: DataFrame) -> DataFrame:
    """Text blocks of (page, xml), each from its opening tag to before its closing one."""
    parsed = pieces.where("xml <> ''").select("page", F.from_xml(F.concat("xml", F.lit("</TextBlock>")), ALTO_BLOCK, {"rowTag": "TextBlock", "mode": "PERMISSIVE"}).alias("b"))
    return parsed.select("page", *[F.col(f"b._{c}").alias(c.lower()) for c in ("HPOS", "VPOS", "WIDTH", "HEIGHT")], F.col("b.TextLine").alias("lines"))


def write_archive(pages: DataFrame, path: str) -> None:
    """Pages (path, value) as rows of a few Parquet files: a volume of many small files costs more to list than to read."""
    pages.select("path", "value").write.parquet(path)


def read_archived_blocks(spark: SparkSession, path: str, page: str = r"([0-9]+)\.xml$") -> DataFrame:
    """As ``read_blocks``, from the pages of an archive, with the page number from a page's path in it. A page is one row."""
    pages = spark.read.schema("path string, value string").parquet(path)
    pieces = pages.select(F.regexp_extract("path", page, 1).cast("int").alias("page"), F.explode(F.split("value", "</TextBlock>")).alias("value"))
    return _parsed(pieces.select("page", F.regexp_extract("value", r"(?s)<TextBlock\b.*", 0).alias("xml")))


def block_lines(blocks: DataFrame) -> DataFrame:
    """One row for each line of the blocks, with its words (TF8)."""
    rows = blocks.select("page", F.posexplode("lines").alias("i", "line"))
    words = F.transform("line.String", lambda w: F.struct(w["_CONTENT"].alias("content"), w["_SUBS_TYPE"].alias("subs_type"), w["_SUBS_CONTENT"].alias("subs_content"), w["_WC"].alias("wc")))
    return rows.select("page", "i", F.col("line._HPOS").alias("hpos"), F.col("line._VPOS").alias("vpos"), words.alias("words"))


def view_number(url: Column) -> Column:
    """The number behind the last "/f" of an address (SRC7)."""
    return F.regexp_extract(url, r".*/f([0-9]+)", 1).cast("int")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A folder of CSV files with headers, columns in the given order (SNK1 to SNK3); arrays are joined by semicolons."""
    kept = df.select(*(columns or df.columns))
    flat = [F.array_join(f.name, ";").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in kept.schema]
    kept.select(*flat).write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON Lines; letters stay as they are (SNK4)."""
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A pipe table of a small result; more than ``most`` rows are refused (SNK6)."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has at most {most} rows")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


def summary(counts: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows) of several results as one job (SNK7)."""
    parts = [df.select(F.lit(name).alias("name")).groupBy("name").agg(F.count("*").alias("n_rows")) for name, df in counts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def manifest_canvases(spark: SparkSession, path: str) -> DataFrame:
    """(place, id, view) of the canvases of all sequences of a document, in order (SRC4)."""
    found = read_json_document(spark, path, "sequences array<struct<canvases: array<struct<`@id`: string>>>>")
    ids = F.flatten(F.transform("sequences", lambda s: F.transform(s["canvases"], lambda c: c["@id"])))
    return found.select(F.posexplode(ids).alias("place", "id")).withColumn("view", view_number(F.col("id")))
