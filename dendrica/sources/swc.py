"""SWC text: one node a line (id type x y z radius parent), # for comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBERS = ["id", "type", "x", "y", "z", "radius", "parent"]


def parse(lines: DataFrame, mode: str = "lenient") -> DataFrame:
    """nodes of lines(neuron_id, ord, line), with ord.

    lenient: lines of other than seven parts are skipped, of equal ids the last
    counts; strict: malformed lines, equal ids and absent parents are errors;
    columns: lines of seven parts or more count.
    """
    t = lines.withColumn("line", F.trim("line")).where("line <> '' AND line NOT LIKE '#%'").withColumn("p", F.split("line", r"\s+"))
    if mode == "lenient":
        t = t.where("size(p) = 7")
    elif mode == "columns":
        t = t.where("size(p) >= 7")
    else:
        t = t.withColumn("p", F.when(F.size("p") >= 7, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.col("line")))))
    number = lambda i: F.get("p", F.lit(i)).cast("double")
    whole = {"id": "bigint", "type": "int", "parent": "bigint"}
    out = t.select("neuron_id", "ord", *(number(i).cast(whole.get(c, "double")).alias(c) for i, c in enumerate(NUMBERS)))
    if mode == "strict":
        same = F.expr("count(*) OVER (PARTITION BY neuron_id, id)")
        out = out.withColumn("id", F.when(same == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("repeated id: "), F.col("id").cast("string"))).cast("bigint")))
        up = out.select("neuron_id", F.col("id").alias("parent"), F.lit(True).alias("known"))
        out = out.join(up, ["neuron_id", "parent"], "left")
        absent = F.raise_error(F.concat(F.lit("absent parent: "), F.col("parent").cast("string"))).cast("bigint")
        return out.withColumn("parent", F.when((F.col("parent") == -1) | F.col("known"), F.col("parent")).otherwise(absent)).select("neuron_id", "ord", *NUMBERS)
    first = F.expr("min(ord) OVER (PARTITION BY neuron_id, id)")
    return out.withColumns({"first": first, "last": F.expr("max(ord) OVER (PARTITION BY neuron_id, id)")}).where("ord = last").select("neuron_id", F.col("first").alias("ord"), *NUMBERS)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """neuron_id (the file's path), ord, line of text files; a file is read whole, so that lines keep their order."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("neuron_id"), "value")
    return text.select("neuron_id", F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))


def read(spark: SparkSession, path: str, mode: str = "lenient") -> DataFrame:
    return parse(lines_of(spark, path), mode)


def read_somas(spark: SparkSession, path: str) -> DataFrame:
    """Rows of `#soma x y z radius sx sy sz` headers."""
    p = F.split(F.trim("line"), r"\s+")
    return lines_of(spark, path).where("line LIKE '#soma%'").select("neuron_id", "ord", *(F.get(p, F.lit(i + 1)).cast("double").alias(c) for i, c in enumerate(("x", "y", "z", "radius"))), F.transform(F.slice(p, 6, 3), lambda v: v.cast("double")).alias("scale"))


def lines(nodes: DataFrame, digits: int = 6) -> DataFrame:
    """neuron_id, id, line: the text of each node."""
    f = f"%.{digits}f"
    return nodes.select("neuron_id", "id", F.format_string(f"%d %d {f} {f} {f} {f} %d", *NUMBERS).alias("line"))


def write(nodes: DataFrame, path: str, digits: int = 6) -> None:
    """A folder for each neuron, its lines in order of id."""
    lines(nodes, digits).repartition("neuron_id").sortWithinPartitions("neuron_id", "id").select("neuron_id", F.col("line").alias("value")).write.partitionBy("neuron_id").text(path)


HEADER = ("# SWC", "# id type x y z radius parent")


def text(nodes: DataFrame, digits: int = 6, radius: float | None = None, header: tuple[str, ...] = HEADER, places: DataFrame | None = None) -> DataFrame:
    """neuron_id, ord, line of each neuron's file: header, then nodes by id, or by places(neuron_id, id, place), as which they are then numbered.

    radius: one for all nodes. A parent that is not among the nodes is an error.
    """
    n = nodes if radius is None else nodes.withColumn("radius", F.lit(float(radius)))
    if places is not None:
        up = places.select("neuron_id", F.col("id").alias("parent"), F.col("place").alias("up"))
        n = n.join(places, ["neuron_id", "id"]).join(up, ["neuron_id", "parent"], "left").withColumn("id", F.col("place"))
    else:
        up = nodes.select("neuron_id", F.col("id").alias("parent"), F.col("id").alias("up"))
        n = n.join(up, ["neuron_id", "parent"], "left")
    absent = F.raise_error(F.concat(F.lit("absent parent: "), F.col("parent").cast("string"))).cast("bigint")
    n = n.withColumn("parent", F.when(F.col("parent") == -1, F.lit(-1).cast("long")).when(F.col("up").isNotNull(), F.col("up")).otherwise(absent))
    body = lines(n, digits).select("neuron_id", (F.row_number().over(Window.partitionBy("neuron_id").orderBy("id")) + len(header)).cast("long").alias("ord"), "line")
    if not header:
        return body
    head = nodes.select("neuron_id").distinct().select("neuron_id", F.posexplode(F.array(*map(F.lit, header))).alias("ord", "line"))
    return head.select("neuron_id", (F.col("ord") + 1).cast("long").alias("ord"), "line").unionByName(body)


def write_text(rows: DataFrame, path: str) -> None:
    """A folder for each neuron, with its lines in order."""
    rows.repartition("neuron_id").sortWithinPartitions("neuron_id", "ord").select("neuron_id", F.col("line").alias("value")).write.partitionBy("neuron_id").text(path)
