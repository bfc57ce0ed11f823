"""Shadowed nodes: those below a directory or archive that is a duplicate itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors
from .groups import duplicates


def shadow_flags(all_members: DataFrame) -> DataFrame:
    """members with `shadowed`. Counts are of whole groups, before any kind is filtered.

    Only directories and archives can have anything below them, so members are exploded to their ancestors and semi-joined
    with the duplicates among those. Being below one is told by the path alone. A duplicate archive shadows its own
    directory row, too.
    """
    tops = duplicates(all_members).where("is_dir").select("path", "typ")
    above = tops.select(F.col("path").alias("above")).distinct()
    places = all_members.select("path", F.explode(ancestors(F.col("path"))).alias("above"))
    below = places.join(above, "above", "left_semi").select("path").distinct().withColumn("below", F.lit(True))
    own = tops.where("typ = 'F'").select("path").distinct().withColumn("own", F.lit(True))
    marked = all_members.join(below, "path", "left").join(own, "path", "left")
    shadowed = F.coalesce("below", F.lit(False)) | (F.coalesce("own", F.lit(False)) & (F.col("typ") == "D"))
    return marked.select(*all_members.columns, shadowed.alias("shadowed"))
