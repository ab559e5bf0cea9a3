"""Ordered text outputs."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliq.plans.run import Run


def _tabbed(*columns: str) -> Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in columns])


def cluster_lines(run: Run) -> tuple[DataFrame, list[str]]:
    return run.member_lists(" ").select("cluster", F.col("members").alias("value")), ["cluster"]


def mothur_lines(run: Run, row: str = "otu_") -> tuple[DataFrame, list[str]]:
    """The head, then a piece a cluster; all on one line. Without amplicons d > 1 has no line at all.

    row: what the line is called, before the number of differences.
    """
    spark = run.amplicons.sparkSession
    n = run.clusters.count()
    head = [(0, f"{row}{run.options.d}\t{n}")] if n or run.options.d < 2 else []
    pieces = run.member_lists(",").select("cluster", F.col("members").alias("value"))
    return spark.createDataFrame(head, "cluster bigint, value string").unionByName(pieces), ["cluster"]


def structure_lines(run: Run) -> tuple[DataFrame, list[str]]:
    return run.structure().select("cluster", "sort", _tabbed("parent", "child", "diffs", "cluster", "steps").alias("value")), ["cluster", "sort"]


def network_lines(run: Run) -> tuple[DataFrame, list[str]]:
    return run.network().select("src", "dst", _tabbed("source", "target").alias("value")), ["src", "dst"]


def statistics_lines(run: Run) -> tuple[DataFrame, list[str]]:
    return run.statistics().select("cluster", _tabbed("size", "mass", "seed", "seed_abundance", "singletons", "maxgen", "maxradius").alias("value")), ["cluster"]


def hit_lines(run: Run) -> tuple[DataFrame, list[str]]:
    return run.hits().select("cluster", "rank", "sort", _tabbed(*[f"c{i}" for i in range(1, 11)]).alias("value")), ["cluster", "rank", "sort"]


def seed_lines(run: Run) -> tuple[DataFrame, list[str]]:
    return run.seeds().select("ord", F.concat(F.lit(">"), "header", F.lit("\n"), "sequence").alias("value")), ["ord"]


#: What a log line says of each measure, in the log's order.
MEASURES = {
    "nucleotides": "Nucleotides read", "sequences": "Sequences read", "longest": "Longest sequence",
    "clusters_before": "Clusters before grafting", "largest_before": "Largest cluster before grafting", "heaviest_before": "Heaviest cluster before grafting", "generations_before": "Most generations before grafting",
    "heavy_clusters": "Heavy clusters", "heavy_amplicons": "Amplicons in heavy clusters", "light_clusters": "Light clusters", "light_amplicons": "Amplicons in light clusters",
    "light_nucleotides": "Nucleotides in light clusters", "light_variants": "Microvariants of light amplicons", "heavy_variants": "Microvariants of heavy amplicons",
    "graft_candidates": "Graft candidates", "grafts": "Grafts made",
    "clusters": "Clusters", "largest": "Largest cluster", "heaviest": "Heaviest cluster", "generations": "Most generations",
}


def log_lines(run: Run) -> tuple[DataFrame, list[str]]:
    names = F.create_map(*[F.lit(x) for k, (m, said) in enumerate(MEASURES.items()) for x in (m, f"{k:02d}{said}")])
    rows = run.log().withColumn("said", names[F.col("measure")])
    return rows.select(F.substring("said", 1, 2).alias("place"), F.concat(F.substring("said", 3, 99), F.lit(": "), F.col("value").cast("string")).alias("value")), ["place"]


OUTPUTS = {"clusters": cluster_lines, "mothur": mothur_lines, "structure": structure_lines, "network": network_lines, "statistics": statistics_lines, "uclust": hit_lines, "seeds": seed_lines, "log": log_lines}


def write_directory(run: Run, output: str, path: str, **options) -> None:
    """One output as a folder of part files whose names follow its order. options: those of its lines."""
    lines, by = OUTPUTS[output](run, **options)
    lines.orderBy(*by).select("value").write.mode("overwrite").text(path)


def write_file(run: Run, output: str, path: str, **options) -> None:
    """One output as a single file on the driver's machine, "-" for standard output; partitions come one at a time."""
    lines, by = OUTPUTS[output](run, **options)
    to = sys.stdout if path == "-" else open(path, "w", encoding="utf-8", newline="")  # noqa: SIM115
    joint = "\t" if output == "mothur" else "\n"
    try:
        wrote = False
        for row in lines.orderBy(*by).select("value").toLocalIterator():
            to.write((joint if wrote and joint == "\t" else "") + row["value"] + ("" if joint == "\t" else "\n"))
            wrote = True
        if wrote and joint == "\t":
            to.write("\n")
    finally:
        if to is not sys.stdout:
            to.close()


def write_contingency(lines: DataFrame, names: list[str], path: str, compression: str = "none") -> None:
    """contingency_lines as text files whose names follow their order, each below a head of the names."""
    head = "\t".join(f"\0{n}\0" if "\t" in n else n for n in names)
    if lines.isEmpty():
        lines = lines.sparkSession.createDataFrame([(head,)], "value string")
    else:
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # the first row of its file
        lines = lines.select(F.concat(F.when(first, head + "\n").otherwise(""), "value").alias("value"))
    lines.write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", 0).text(path)
