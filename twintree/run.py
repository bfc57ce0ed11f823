"""From options to reports: what a user of the engine calls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import display_path
from .operators import candidates, dedup, diff, stats
from .options import Options
from .plans import reports
from .plans.analysis import Analysis
from .plans.lineage import cut
from .sources import archive, cache, dedupe, fs


@dataclass
class Result:
    """What an analysis gives: the analysis, its report (None for output "-"), its dedup plan, its counters."""

    analysis: Analysis
    options: Options

    @property
    def report(self) -> DataFrame | None:
        a, o = self.analysis, self.options
        if o.output == "g":
            return a.report().withColumn("shown", display_path(F.col("path"), o.paths, o.absolute))
        if o.output == "t":
            return reports.tree_listing(diff.nodes_of(a.files, a.dirs), a.members)
        if o.output == "d":
            return reports.diff_listing(diff.tree_diff(diff.nodes_of(a.files, a.dirs), o.paths))
        return None

    def write(self, path: str) -> None:
        """The report as text (groups) or JSON (tree, diff); nothing is computed for output "-"."""
        a, o = self.analysis, self.options
        if o.output == "g":
            reports.write_group_text(a.report(), path, o.paths, o.absolute)
        elif o.output != "-":
            nodes = diff.nodes_of(a.files, a.dirs)
            listing = reports.tree_listing(nodes, a.members) if o.output == "t" else None
            text = reports.tree_json(listing, reports.first_members(listing, nodes, a.members)) if listing is not None else reports.diff_json(
                diff.tree_diff(nodes, o.paths))
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)

    def plan(self) -> DataFrame:
        """hash, keeper, path, phys, file_size, avg_phys: the files that give up their blocks."""
        return dedup.dedup_groups(dedup.dedup_candidates(self.analysis.files), self.options.aggressive_dedup)

    def dedupe(self) -> DataFrame:
        """One row for each file of the plan with what was done; nothing is changed if options.dedup_simulate (the default)."""
        return dedupe.dedupe(self.plan(), self.options.dedup_budget, self.options.dedup_simulate)

    def counters(self, deduped: DataFrame | None = None) -> DataFrame:
        return stats.progress(self.analysis.candidates, self.analysis.files, deduped)


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whichever store it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def run(spark: SparkSession, options: Options, extents: DataFrame | None = None) -> Result:
    """An analysis of options.paths.

    Entries come from a scan, whose unchanged files keep the hashes of the cache (options.cache_path) unless no_cache; with
    no_scan they come from the cache alone. The cache is then written anew. extents: a table of extents (path, logical,
    physical) in place of those that the file system tells. extra["extents"] "false" asks for none.
    """
    cached = None
    if options.cache_path and not options.no_cache and _there(spark, options.cache_path):
        cached = cut(cache.load(spark, options.cache_path, options.paths))
    if options.no_scan:
        if cached is None:
            raise ValueError("without a scan there must be a cache")
        return Result(Analysis(cached, options, prepared=cached), options)
    scanned = fs.scan(spark, options.paths, extents is None and options.extra.get("extents", "true") == "true")
    if extents is not None:
        scanned = fs.with_extents(scanned, extents)
    scanned = cut(scanned)
    known = scanned if cached is None else cut(cache.validate(scanned, cached).drop("valid"))
    members = None
    if options.read_archives:
        fresh = known.where("file_hash is null") if cached is not None else known
        members = archive.member_entries(archive.read_archives(fresh))
        if cached is not None and "in_archive" in cached.columns:
            members = members.unionByName(cache.revalidated_members(known.withColumn("valid", F.col("file_hash").isNotNull()), cached),
                allowMissingColumns=True)
        members = cut(members)
    chosen = candidates.read_candidates(known, options, members)
    files = fs.hash_files(chosen)
    if members is not None:
        files = files.unionByName(members, allowMissingColumns=True)
    files = cut(files)
    if options.cache_path and not options.no_cache:
        cache.store(files, options.cache_path)
    return Result(Analysis(known, options, members, prepared=files), options)
