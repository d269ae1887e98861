"""Helpers on DataFrames that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from tidewatch.session import configure, materialize
from tidewatch.sources.access import read_table


def prepare(spark: SparkSession) -> SparkSession:
    """Session options for Python stages over long texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    # Tables bucketed by one of two join keys are read without an exchange.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(prepare(spark), sf_dir, name)


def keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``row``, all columns of the caller as one struct, ``id`` and ``print``, the hash of the text.

    Whatever the caller's columns are called, they meet no name of the library's own.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    return docs.select(row, docs[id_column].cast("long").alias("id"), F.xxhash64(docs[text]).alias("print"))


def unkeyed(rows: DataFrame) -> DataFrame:
    """Back to the caller's columns."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in rows.schema["row"].dataType.names])


def same_text(rows: DataFrame, marked: DataFrame) -> Column:
    """The join of ``keyed`` rows with ``doc_id`` and ``mark``, where missing ids are equal."""
    return rows["id"].eqNullSafe(marked["doc_id"]) & (rows["print"] == marked["mark"])


def _holds_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, MapType) or (isinstance(kind, ArrayType) and _holds_map(kind.elementType))


def first_rows(rows: DataFrame, again: DataFrame) -> DataFrame:
    """``keyed`` rows with one row for each ``doc_id, print`` of ``again``, the least by the hash of all columns."""
    again = materialize(again.select("doc_id", F.col("print").alias("mark")), "again")
    if again.isEmpty():
        return rows
    fields = [(F.col("row").getField(f.name), f.dataType) for f in rows.schema["row"].dataType]
    # Maps cannot be hashed; their text can.
    place = F.xxhash64(*[F.to_json(F.struct(c)) if _holds_map(kind) else c for c, kind in fields])
    once = rows.join(again, same_text(rows, again), "left_semi").groupBy("id", "print").agg(F.min_by("row", place).alias("row"))
    return rows.join(again, same_text(rows, again), "left_anti").unionByName(once.select("row", "id", "print"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has two long columns; the result has ``node`` and ``root``, the
    smallest node of its component, for every node that has an edge to another.
    A component that has become a star takes no part in later rounds. Each round
    is stored, so lost executors cost one round at most; minima are combined
    before the shuffle and only the join on a hub's key is skewed, which the
    adaptive join splits. No group is gathered anywhere.
    """
    links = (
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where("hi <> lo")
        .distinct()
    )
    links = materialize(links, "links")
    stars = []
    while True:
        seen = Observation()
        marked = materialize(_marked(links).observe(seen, F.count_if("open").alias("open")), "marked")
        stars.append(marked.where("not open").select(F.col("hi").alias("node"), F.col("lo").alias("root")))
        if not seen.get["open"]:
            break
        links = materialize(_small_star(_large_star(marked.where("open").select("hi", "lo"))), "links")
    star = reduce(DataFrame.unionByName, stars)
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def _marked(links: DataFrame) -> DataFrame:
    """``open`` is false for links of a component that is a star around its smallest node.

    A node that has a smaller neighbour and any other is not the leaf of a star, and
    neither that neighbour nor the node itself is the centre of one.
    """
    ends = links.select(F.col("hi").alias("node"), F.lit(1).alias("up")).unionByName(links.select(F.col("lo").alias("node"), F.lit(0).alias("up")))
    between = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("up").alias("up")).where("up > 0 and n > 1").select(F.col("node").alias("hi"))
    centres = links.join(between, "hi").select("lo").unionByName(between.select(F.col("hi").alias("lo"))).distinct()
    return links.join(centres.withColumn("open", F.lit(True)), "lo", "left").select("hi", "lo", F.coalesce("open", F.lit(False)).alias("open"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    return larger.join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
