"""Readers and writers of simulation files, as plans over lines.

A file is read whole into lines that carry their number (``wholetext`` keeps the order, which Spark's
line reader doesn't promise across splits), so a format is a filter and a projection on line numbers.
Many files can be read at once: every reader takes a glob, and rows say which file they are from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import Domain


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text, tokens): the trimmed lines of files, counted from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("rows"))
    out = whole.select("file", F.posexplode("rows").alias("line", "text"))
    clean = F.trim(F.translate("text", "\t", " "))
    return out.select("file", "line", clean.alias("text"), F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " +")).alias("tokens"))


def _number(k: int) -> Column:
    return F.get("tokens", F.lit(k)).cast("double")


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """(file, num_atoms, comment, idx, label, x, y, z); rows without a label have null; blank rows are skipped."""
    every = lines(spark, path)
    head = every.where("line = 0").select("file", F.get("tokens", F.lit(0)).cast("int").alias("num_atoms"))
    comment = every.where("line = 1").select("file", F.col("text").alias("comment"))
    labelled = F.size("tokens") == 4
    value = lambda k: F.when(labelled, _number(k + 1)).otherwise(_number(k))
    rows = every.where("line > 1 and size(tokens) > 0").select("file", (F.col("line") - 2).alias("idx"), F.when(labelled, F.get("tokens", F.lit(0))).alias("label"), value(0).alias("x"), value(1).alias("y"), value(2).alias("z"))
    return rows.join(F.broadcast(head.join(comment, "file")), "file").select("file", "num_atoms", "comment", "idx", "label", "x", "y", "z")  # a row a file


def write_xyz(df: DataFrame, path: str, symbol: str = "A", comment: str = "", digits: int = 16, mode: str = "error", label: str | None = None) -> None:
    """An XYZ file in the folder ``path``, rows in gid order; an XYZ frame is one file by its format."""
    name = F.col(label) if label else F.lit(symbol)
    body = df.select(F.col("gid").alias("n"), F.concat_ws(" ", name, *[F.format_string(f"%.{digits}f", F.col(a)) for a in "xyz"]).alias("value"))
    spark = df.sparkSession
    head = spark.createDataFrame([(-1, comment)], "n long, value string")
    count = df.agg(F.lit(-2).cast("long").alias("n"), F.count("*").cast("string").alias("value"))
    count.unionByName(head).unionByName(body).repartitionByRange(1, "n").sortWithinPartitions("n").select("value").write.mode(mode).text(path)


def append_frame(df: DataFrame, path: str, step: int) -> None:
    """A trajectory frame: the state as Parquet under its step."""
    df.withColumn("step", F.lit(step)).write.mode("append").partitionBy("step").parquet(path)


def frame_text(spark: SparkSession, path: str, out: str, symbol: str = "A", title: str = "") -> None:
    """The frames of a trajectory as XYZ text, five decimals, ordered by step and gid."""
    state = spark.read.parquet(path)
    body = state.select("step", "gid", F.concat_ws(" ", F.lit(symbol), *[F.format_string("%.5f", F.col(a)) for a in "xyz"]).alias("value"))
    count = state.groupBy("step").agg(F.lit(-2).cast("long").alias("gid"), F.count("*").cast("string").alias("value"))
    head = count.select("step", F.lit(-1).cast("long").alias("gid"), F.lit(title).alias("value"))
    count.unionByName(head).unionByName(body).repartitionByRange("step", "gid").sortWithinPartitions("step", "gid").select("value").write.text(out)


def track(df: DataFrame, gid: int, columns: list[str], path: str, step: int) -> None:
    """One particle's columns appended under a step."""
    df.where(F.col("gid") == gid).select(F.lit(step).alias("step"), "gid", *columns).write.mode("append").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A tab-separated text table: distributions and energies."""
    df.write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def dlpoly_extent(spark: SparkSession, path: str) -> DataFrame:
    """(file, ex, ey, ez): the diagonal of lines 2, 3 and 4."""
    at = lambda n, k: F.max(F.when(F.col("line") == n, _number(k)))
    return lines(spark, path).where("line between 2 and 4").groupBy("file").agg(at(2, 0).alias("ex"), at(3, 1).alias("ey"), at(4, 2).alias("ez"))


def dlpoly_domain(spark: SparkSession, path: str) -> Domain:
    row = dlpoly_extent(spark, path).first()
    return Domain((row.ex, row.ey, row.ez))


def dlpoly_config(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, symbol, id, x..z, vx..vz, fx..fz): records of four lines after five of header."""
    body = lines(spark, path).where("line >= 5 and text <> ''").withColumns({"idx": F.expr("(line - 5) div 4").cast("int"), "slot": F.expr("(line - 5) % 4")})
    at = lambda slot, c: F.max(F.when(F.col("slot") == slot, c))
    cols = [at(0, F.get("tokens", F.lit(0))).alias("symbol"), at(0, F.get("tokens", F.lit(1)).cast("int")).alias("id")]
    for slot, prefix in ((1, ""), (2, "v"), (3, "f")):
        cols += [at(slot, _number(k)).alias(f"{prefix}{a}") for k, a in enumerate("xyz")]
    return body.groupBy("file", "idx").agg(*cols)


def directives(spark: SparkSession, path: str, stop: str | None = None) -> DataFrame:
    """(file, line, tokens) of a control or field file: comments and blank lines go, and all from ``stop`` on (case counts)."""
    every = lines(spark, path)
    rows = every.where("text <> '' and not startswith(text, '#')")
    if stop:
        end = every.where(F.col("text") == stop).groupBy("file").agg(F.min("line").alias("end"))
        rows = rows.join(F.broadcast(end), "file", "left").where("end is null or line < end")  # a row a file
    return rows.select("file", "line", "tokens")


def dlpoly_control(spark: SparkSession, path: str) -> DataFrame:
    return directives(spark, path, "finish")


def dlpoly_field(spark: SparkSession, path: str) -> DataFrame:
    return directives(spark, path)


def dlmonte_control(spark: SparkSession, path: str) -> DataFrame:
    return directives(spark, path)


def directive_values(rows: DataFrame, key: str) -> DataFrame:
    """What follows a key of one or more words, whatever its case: (file, line, tokens)."""
    for k, word in enumerate(key.lower().split()):
        rows = rows.where(F.lower(F.get("tokens", F.lit(0))) == word)
        rows = rows.withColumn("tokens", F.expr("slice(tokens, 2, size(tokens))"))
    return rows


def dlmonte_positions(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, type, x, y, z): after seven lines, two tokens name a type and three are a position; others raise."""
    body = lines(spark, path).where("line >= 7 and text <> ''")
    kind = F.when(F.size("tokens").isin(2, 3), F.size("tokens")).otherwise(F.raise_error(F.concat(F.lit("unknown line in CONFIG: "), F.col("text"))).cast("int"))
    # a type and the position after it share a number: one type line stands before each position
    body = body.withColumn("kind", kind)
    types = body.where("kind = 2").select("file", F.col("line").alias("at"), F.col("text").alias("type"))
    places = body.where("kind = 3").select("file", (F.col("line") - 1).alias("at"), *[_number(k).alias(a) for k, a in enumerate("xyz")])
    return places.join(types, ["file", "at"], "left").select("file", F.expr("(at - 7) div 2").cast("int").alias("idx"), "type", "x", "y", "z")
