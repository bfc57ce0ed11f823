"""A whole analysis: entries -> hashes -> directories -> members -> shadow flags -> reports."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from ..operators import candidates, directories, groups, shadow
from ..options import Options
from .lineage import cut


class Analysis:
    """Lazy stages over entries; archive_members are entries that are hashed already (they close the set of sizes).

    prepared: the hashed files, archive members among them, if they are known already.
    """

    def __init__(self, entries: DataFrame, options: Options = Options(), archive_members: DataFrame | None = None, max_depth: int | None = None,
        prepared: DataFrame | None = None):
        self.entries, self.options, self.archive_members, self.max_depth, self.prepared = entries, options, archive_members, max_depth, prepared

    @cached_property
    def candidates(self) -> DataFrame:
        return candidates.read_candidates(self.entries, self.options, self.archive_members)

    @cached_property
    def files(self) -> DataFrame:
        if self.prepared is not None:
            return self.prepared
        hashed = candidates.content_hashes(self.candidates)
        if self.archive_members is not None:
            hashed = hashed.unionByName(self.archive_members, allowMissingColumns=True)
        return cut(hashed)  # sizes, members, directories and dedup plans all read it

    @cached_property
    def dirs(self) -> DataFrame:
        return cut(directories.roll_up(self.files, self.max_depth, archives=self.archive_members is not None
            or (self.prepared is not None and "in_archive" in self.prepared.columns)))

    @cached_property
    def members(self) -> DataFrame:
        return cut(groups.members(self.files, self.dirs))

    @cached_property
    def flagged(self) -> DataFrame:
        return shadow.shadow_flags(self.members)

    def shown(self, rule: int | None = None) -> DataFrame:
        return groups.visible(self.flagged, self.options.shadow_rule if rule is None else rule)

    def report(self, rule: int | None = None) -> DataFrame:
        return groups.export_order(self.shown(rule))
