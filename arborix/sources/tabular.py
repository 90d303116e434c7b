"""TSV with a declared header: every column text, missing ones `NA`, wrong widths an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_tsv(spark: SparkSession, path: str, required: list[str] = (), optional: list[str] | None = None) -> DataFrame:
    """All columns as text. A repeated or missing name in the header, or a row of another width, is an error.

    With ``optional`` (column names) a path that doesn't exist is an empty table of those columns. Compression goes by
    the file's ending.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if optional is not None and not p.getFileSystem(conf).globStatus(p):
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in optional]))
    first = spark.read.text(path).limit(1).collect()
    header = first[0][0].split("\t") if first else []
    if len(set(header)) != len(header):
        raise ValueError(f"repeated column in the header of {path}")
    if missing := [c for c in required if c not in header]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST", quote="", enforceSchema=False)
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in header])


def as_text(df: DataFrame, fields: list[str]) -> DataFrame:
    """The declared fields as text: nested values as JSON, null or absent ones `NA`."""
    have = {f.name: f.dataType for f in df.schema}

    def cell(name: str):
        if name not in have:
            return F.lit("NA").alias(name)
        nested = isinstance(have[name], (T.StructType, T.ArrayType, T.MapType))
        return F.coalesce(F.to_json(name) if nested else F.col(f"`{name}`").cast("string"), F.lit("NA")).alias(name)

    return df.select(*[cell(f) for f in fields])


def write_tsv(df: DataFrame, path: str, fields: list[str], compression: str | None = None) -> None:
    as_text(df, fields).write.csv(path, sep="\t", header=True, quote="", escapeQuotes=False, compression=compression, emptyValue="")


def publish(df: DataFrame, path: str, writer) -> None:
    """Written beside the target first and moved there whole, so a reader never sees half a table."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    staging, target = jvm.org.apache.hadoop.fs.Path(path + "._staging"), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    fs.delete(staging, True)
    writer(df, staging.toString())
    fs.delete(target, True)
    if not fs.rename(staging, target):
        raise OSError(f"could not publish {path}")
