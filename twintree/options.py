"""The options of an analysis."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Options:
    """Semantic options only: threads, buffers and read-ahead are Spark's business.

    shadow_rule 0 shows all members, 1 hides groups below duplicate directories, 2 (default) hides shadowed members
    unless exactly one is left, 3 always hides them. Size bounds hold for hashing, archives excepted.
    """

    paths: tuple[str, ...] = ()
    output: str = "g"
    shadow_rule: int = 2
    absolute: bool = False
    min_size: int = 0
    max_size: int | None = None
    read_archives: bool = False
    dedup_simulate: bool = True
    aggressive_dedup: bool = False
    dedup_budget: int = 512 << 20
    cache_path: str | None = None
    no_cache: bool = False
    no_scan: bool = False
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.shadow_rule not in (0, 1, 2, 3):
            raise ValueError("shadow_rule is 0, 1, 2 or 3")
        if self.output not in ("g", "t", "d", "-"):
            raise ValueError("output is g (groups), t (tree), d (diff) or - (none)")
        for path in self.paths:
            if not path.startswith("/"):
                raise ValueError(f"{path!r} is not absolute")
