"""One cluster as tables of nodes and edges, ready to draw."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The colour of an amplicon without end of abundance, and the span of node sizes.
COLOUR = (176, 196, 222)
SIZES = (30.0, 70.0)


def read_cluster(spark: SparkSession, path: str, number: int) -> DataFrame:
    """(amplicon, abundance) of line number (from 1) of a cluster list, a file or a folder whose files follow by name;
    headers end in _N or ;size=N;."""
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    line = lines.orderBy("at").offset(number - 1).limit(1)
    item = line.select(F.explode(F.split(F.trim("value"), " ")).alias("x")).filter("x <> ''")
    plain = F.regexp_replace(F.replace("x", F.lit(";size="), F.lit("_")), r";+\z", "")
    return item.select(F.regexp_replace(plain, r"_[^_]*\z", "").alias("amplicon"), F.substring_index(plain, "_", -1).try_cast("bigint").alias("abundance"))


def read_structure(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child, diffs, cluster_no, steps) of a structure file."""
    return spark.read.csv(path, sep="\t", quote="", schema="parent string, child string, diffs int, cluster_no int, steps int")


def nodes_and_edges(members: DataFrame, structure: DataFrame, number: int, drop: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of cluster number without amplicons of abundance drop or less.

    members: amplicon, abundance. nodes: amplicon, abundance, red, green, blue, size, label; those in no link are left
    out. edges: parent, child, both ends kept.
    """
    own = structure.filter(F.col("cluster_no") == number)
    linked = own.select(F.col("parent").alias("amplicon")).unionByName(own.select(F.col("child").alias("amplicon"))).distinct()
    kept = members.filter(F.col("abundance") > drop).join(linked, "amplicon", "left_semi")
    names = kept.select("amplicon")
    pairs = own.select("parent", "child").join(names, F.col("parent") == F.col("amplicon"), "left_semi").join(names, F.col("child") == F.col("amplicon"), "left_semi")
    most = kept.agg(F.max("abundance").alias("most")).withColumn("one", F.lit(1))
    a = F.col("abundance")
    shade = [((F.lit(c) + F.lit(255 - c) / a) / 255).alias(n) for c, n in zip(COLOUR, ("red", "green", "blue"))]
    nodes = kept.withColumn("one", F.lit(1)).join(F.broadcast(most), "one").select(
        "amplicon", "abundance", *shade, (F.lit(SIZES[0]) + a * SIZES[1] / F.col("most")).alias("size"),
        F.when((a >= 10) | (a == F.col("most")), a.cast("string")).otherwise("").alias("label"),
    )
    return nodes, pairs


def graphml(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(section, value): lines of a GraphML document, to be written in the order of section."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="abundance" for="node" attr.name="abundance" attr.type="long"/><graph edgedefault="undirected">'
    ends = nodes.sparkSession.createDataFrame([(0, head), (3, "</graph></graphml>")], "section int, value string")
    n = nodes.select(F.lit(1).alias("section"), F.format_string('<node id="%s"><data key="abundance">%d</data></node>', escape(F.col("amplicon")), F.col("abundance")).alias("value"))
    e = pairs.select(F.lit(2).alias("section"), F.format_string('<edge source="%s" target="%s"/>', escape(F.col("parent")), escape(F.col("child"))).alias("value"))
    return ends.unionByName(n).unionByName(e)
