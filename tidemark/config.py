"""Options that `:set` and `:get` reach."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .errors import OptionError

#: Options, their defaults, and whether a running session may change them.
DEFAULTS = {
    "buffer_frames": (256, False),
    "lru_k": (2, False),
    "scan_page_limit": (64, False),
    "page_size": (4096, False),
    "b_plus_tree_page_size": (1024, False),
    "enable_index_scan": (0, True),
    "enable_hash_join": (0, True),
    "enable_predicate_push_down": (0, True),
    "no_optimization": (0, True),
    "check_final_plan": (0, True),
    "print_execution_statistics": (0, True),
    "enforce_unique": (0, True),
    "flat_precedence": (0, True),
}


#: Options that are kept for scripts which set them.
IDLE = frozenset("buffer_frames lru_k scan_page_limit page_size b_plus_tree_page_size enable_index_scan enable_predicate_push_down".split())


class Config:
    """Integer options by name; unknown ones can be set as well.

    `enable_hash_join` asks for hash joins, `no_optimization` does without that and without skipping files by their ranges, `check_final_plan` plans
    a SELECT before its rows are asked for, `print_execution_statistics` makes the console say times and rows, `enforce_unique` checks unique
    indices, `flat_precedence` lets all signs bind alike. Memory, pages, index scans and push-down are Spark's own affair: these options (IDLE) change nothing, which `:set` says.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.values = spark, {k: v for k, (v, _) in DEFAULTS.items()}

    def __contains__(self, name: str) -> bool:
        return name in self.values

    def __getitem__(self, name: str) -> int:
        if name not in self.values:
            raise OptionError(f"there is no option {name}")
        return self.values[name]

    def set(self, name: str, value: int) -> int | None:
        """Sets an option; its old value."""
        if not DEFAULTS.get(name, (0, True))[1]:
            raise OptionError(f"option {name} cannot be changed while running")
        old, self.values[name] = self.values.get(name), value
        return old

    @property
    def join_strategy(self) -> str | None:
        return "shuffle_hash" if self.values["enable_hash_join"] and not self.values["no_optimization"] else None

    def __str__(self) -> str:
        return "\n".join(f"{k}: {v}" for k, v in sorted(self.values.items()))
