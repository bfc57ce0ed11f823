"""Paths: "/" parts components, the root is the empty path, order is by component."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: archive suffixes, compared case-sensitively.
ARCHIVE_SUFFIXES = (".zip", ".tar", ".7z", ".tar.gz", ".tar.xz")


def components(path: Column) -> Column:
    """An array that orders paths by component: /a/b comes before /a.b."""
    return F.split(path, "/")


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def name_of(path: Column) -> Column:
    return F.element_at(components(path), -1)


def depth_of(path: Column) -> Column:
    """0 for the root."""
    return F.size(components(path)) - 1


def ancestors(path: Column) -> Column:
    """All strict ancestors, the root first; empty for the root itself."""
    parts = components(path)
    inner = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(F.size(parts) > 1, inner).otherwise(F.array().cast("array<string>"))


def is_below(path: Column, root: str) -> Column:
    """The root itself or anything in it."""
    return (path == root) | path.startswith(root + "/")


def relative_to(path: Column, root: str | Column) -> Column:
    """The path without the root and the slash after it; other paths stay."""
    root = F.lit(root) if isinstance(root, str) else root
    return F.when(path == root, "").when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)


def display_path(path: Column, roots: Sequence[str], absolute: bool) -> Column:
    return path if absolute or len(roots) != 1 else relative_to(path, roots[0])


def is_archive_name(path: Column) -> Column:
    return path.rlike("(" + "|".join(s.replace(".", r"\.") for s in ARCHIVE_SUFFIXES) + ")$")
