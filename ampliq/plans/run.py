"""A run: amplicons, links, clusters and the tables of every output."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliq.functions.alignment import alignment
from ampliq.functions.headers import renumbered
from ampliq.operators import amplicons as amplicons_
from ampliq.operators import clustering, grafting
from ampliq.operators.dereplicate import dereplicate, dereplicated_members
from ampliq.operators.edges import edges, network
from ampliq.operators.order import dense_order
from ampliq.plans.options import Options
from ampliq.plans.scratch import table


class Run:
    """Lazily built tables of one clustering; those that several outputs need are written once."""

    def __init__(self, entries: DataFrame, options: Options = Options(), validate: bool = True):
        self.options = options.checked()
        self.amplicons = amplicons_.amplicons(entries, self.options, validate)

    @cached_property
    def links(self) -> DataFrame:
        """(src, dst, diff)."""
        return table(edges(self.amplicons, self.options), "links")

    @cached_property
    def _same(self) -> DataFrame:
        return table(dereplicate(self.amplicons), "same")

    @cached_property
    def first_members(self) -> DataFrame:
        """Members before the second pass."""
        if self.options.d == 0:
            return table(dereplicated_members(self.amplicons, self._same), "members")
        return table(clustering.membership(self.amplicons, self.links, self.options.d > 1), "members")

    @cached_property
    def first_clusters(self) -> DataFrame:
        """Clusters before the second pass."""
        if self.options.d == 0:
            return self._same.drop("sequence")
        return table(clustering.clusters(self.amplicons, self.first_members), "clusters")

    @cached_property
    def graft_candidates(self) -> DataFrame:
        return table(grafting.graft_candidates(self.amplicons, self.first_members, self.first_clusters, self.options.limit), "candidates")

    @cached_property
    def grafts(self) -> DataFrame:
        """(light, heavy, child, parent); no rows without the fastidious pass."""
        if not self.options.fastidious:
            return self.amplicons.sparkSession.createDataFrame([], "light bigint, heavy bigint, child bigint, parent bigint")
        return table(grafting.grafts(self.graft_candidates, self.first_members), "grafts")

    @cached_property
    def members(self) -> DataFrame:
        """ord, root, generation, parent, radius, own, graft_parent, graft_key."""
        return grafting.attach(self.first_members, self.grafts)

    @cached_property
    def clusters(self) -> DataFrame:
        """root, size, mass, sumlen, singletons, maxgen, maxradius, and cluster: its number, from 1."""
        found = grafting.merged_clusters(self.first_clusters, self.grafts) if self.options.fastidious else self.first_clusters
        if self.options.d > 1:  # a cluster of one has a generation here
            found = found.withColumn("maxgen", F.greatest("maxgen", F.lit(1)))
        by = (F.col("mass").desc(), F.col("root").asc()) if self.options.d == 0 else (F.col("root").asc(),)
        return table(dense_order(found, *by, name="cluster").withColumn("cluster", F.col("cluster") + 1), "numbered")

    @cached_property
    def listed(self) -> DataFrame:
        """Members with cluster, header as printed, label and a key that orders them inside their cluster's list."""
        # the heavy cluster's own members come before grafted ones, whose key is not null
        place = F.struct(F.col("graft_key").isNotNull().alias("k0"), F.col("graft_key").alias("k1"), F.col("generation").alias("k2"), F.col("ord").alias("k3"))
        return (
            self.members.join(self.clusters.select("root", "cluster"), "root")
            .join(self.amplicons.select("ord", "shown", "label", "abundance", "sequence", "seqlen"), "ord").withColumn("place", place)
        )

    def member_lists(self, separator: str = " ") -> DataFrame:
        """(cluster, root, members): one row a cluster. A list is one text, as its line in the output is."""
        item = F.struct("place", "shown")
        return self.listed.groupBy("cluster", "root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["shown"]), separator).alias("members"))

    def structure(self) -> DataFrame:
        """(cluster, sort, parent, child, diffs, steps) of every link by which a member was reached; order by cluster, sort.

        A grafted member that has a parent of its own has two rows. Steps of a graft: one more than its parent's.
        """
        m = self.listed.select("ord", "cluster", "place", "label", "generation", "parent", "graft_parent", "radius")
        up = self.amplicons.select(F.col("ord").alias("p"), F.col("label").alias("parent_label")).join(self.first_members.select(F.col("ord").alias("p"), F.col("generation").alias("pg"), F.col("radius").alias("pr")), "p")
        def rows(column, first, diffs, steps):
            found = m.filter(F.col(column).isNotNull()).withColumn("p", F.col(column)).join(up, "p")
            # d > 1: links in the order they were found, by parent; else in the order of the cluster's list
            order = F.struct(F.lit(False).alias("k0"), F.lit(None).cast("struct<parent:bigint,child:bigint>").alias("k1"), F.col("pg").alias("k2"), F.col("p").alias("k3")) if self.options.d > 1 else F.col("place")
            return found.select("cluster", F.struct(order.alias("a"), F.col("ord").alias("b"), F.lit(first).alias("c")).alias("sort"), F.col("parent_label").alias("parent"), F.col("label").alias("child"), diffs.cast("int").alias("diffs"), steps.cast("int").alias("steps"))
        diffs = {0: F.lit(0), 1: F.lit(1)}.get(self.options.d, F.col("radius") - F.col("pr"))
        own = rows("parent", 1, diffs, F.lit(0) if self.options.d == 0 else F.col("generation"))
        return own if not self.options.fastidious else rows("graft_parent", 0, F.lit(2), F.col("pg") + 1).unionByName(own)

    def network(self) -> DataFrame:
        return network(self.amplicons, self.links)

    def statistics(self) -> DataFrame:
        """(cluster, size, mass, seed, seed_abundance, singletons, maxgen, maxradius); order by cluster."""
        seed = self.amplicons.select(F.col("ord").alias("root"), F.col("label").alias("seed"), F.col("abundance").alias("seed_abundance"))
        return self.clusters.join(seed, "root").select("cluster", "size", "mass", "seed", "seed_abundance", "singletons", "maxgen", "maxradius")

    def hits(self) -> DataFrame:
        """(cluster, kind, sort, c1 .. c10): ten-column rows, for each cluster C, S, then an H for each further member."""
        m = self.listed
        seeds = m.filter("ord = root").select("cluster", F.col("shown").alias("seed"), F.col("seqlen").alias("seed_length"), F.col("sequence").alias("seed_sequence"))
        star = F.lit("*")
        number = (F.col("cluster") - 1).cast("string")
        def row(kind, rank, sort, third, identity, strand, fifth, cigar, query, target):
            cells = [F.lit(kind), number, third.cast("string"), identity, strand, fifth, fifth, cigar, query, target]
            return [F.col("cluster"), F.lit(rank).alias("rank"), sort.alias("sort"), *[c.alias(f"c{i + 1}") for i, c in enumerate(cells)]]
        zero = F.lit(0).cast("bigint")
        tops = self.clusters.select("cluster", "size").join(seeds, "cluster")
        c = tops.select(*row("C", 0, F.struct(zero.alias("a"), zero.alias("b")), F.col("size"), star, star, star, star, F.col("seed"), star))
        s = tops.select(*row("S", 1, F.struct(zero.alias("a"), zero.alias("b")), F.col("seed_length"), star, star, star, star, F.col("seed"), star))
        others = m.filter("ord <> root").join(seeds, "cluster")
        if self.options.d == 0:
            others = others.withColumn("aligned", F.struct(F.lit(0).alias("diff"), F.col("seqlen").alias("alen"), F.lit("").alias("cigar")))
        else:
            others = others.withColumn("aligned", alignment(self.options.penalties if self.options.d > 1 else (18, 24, 13))("seed_sequence", "sequence"))
        identity = 100.0 * (F.col("aligned.alen") - F.col("aligned.diff")) / F.col("aligned.alen")
        # hits of d > 1 come in the order they were found: by the parent's generation, parent, ord
        place = dense_order(others.select("cluster", "ord", "generation", "parent", "place"), F.col("cluster"), *((F.col("generation"), F.col("parent"), F.col("ord")) if self.options.d > 1 else (F.col("place"),)), name="at").select("ord", "at")
        h = others.join(place, "ord").select(*row(
            "H", 2, F.struct(F.col("at").alias("a"), zero.alias("b")), F.col("seqlen"), F.format_string("%.1f", F.bround(identity, 1)), F.lit("+"), F.lit("0"),
            F.when(F.col("aligned.diff") > 0, F.col("aligned.cigar")).otherwise("="), F.col("shown"), F.col("seed"),
        ))
        return c.unionByName(s).unionByName(h)

    def seeds(self) -> DataFrame:
        """(ord, header, sequence) of the seeds with their cluster's mass, by mass descending, then header (d = 0: then ord)."""
        a = self.amplicons.select(F.col("ord").alias("root"), F.col("header").alias("own_header"), "before", "after", "label", "appended", "sequence")
        found = self.clusters.join(a, "root")
        plain = renumbered(self.options.usearch, F.col("before"), F.col("after"), F.col("mass"))
        second = F.col("root") if self.options.d == 0 else F.col("own_header")
        return dense_order(found.select("mass", "root", "own_header", plain.alias("header"), "sequence"), F.col("mass").desc(), second.asc()).select("ord", "header", "sequence")

    def log(self) -> DataFrame:
        """(measure, value): counters of the run; with the fastidious pass those of before it, of what it tries, and its grafts."""
        parts = [amplicons_.summary(self.amplicons), clustering.totals(self.clusters)]
        if self.options.fastidious:
            of = self.first_members.join(self.first_clusters.select("root", (F.col("mass") < self.options.limit).alias("light")), "root").select("ord", "light")
            tried = of.join(self.amplicons.select("ord", amplicons_.variants(F.col("sequence")).alias("v")), "ord")
            count = lambda c: F.coalesce(F.sum(F.when(c, F.col("v"))), F.lit(0))
            before = clustering.totals(self.first_clusters)
            parts += [
                before.select(*[F.col(c).alias(f"{c}_before") for c in before.columns]), clustering.weights(self.first_clusters, self.options.limit),
                tried.agg(count(F.col("light")).alias("light_variants"), count(~F.col("light")).alias("heavy_variants")),
                self.graft_candidates.agg(F.count(F.lit(1)).alias("graft_candidates")), self.grafts.agg(F.count(F.lit(1)).alias("grafts")),
            ]
        row = parts[0].withColumn("k", F.lit(1))
        for p in parts[1:]:
            row = row.join(p.withColumn("k", F.lit(1)), "k")
        row = row.drop("k")
        return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, row.columns)), F.array(*[F.col(c).cast("bigint") for c in row.columns]))).alias("measure", "value"))


def run(entries: DataFrame, **options) -> Run:
    """Run(entries, Options(**options))."""
    return Run(entries, Options(**options))
