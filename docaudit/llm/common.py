"""What the operators of this subpackage share: reading tables, cutting lineage, bounded caches in the Python workers."""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from docaudit.sources.shared import new_path, shared_dir, written

__all__ = ["BoundedCache", "new_path", "shared_dir", "table", "written"]

KEY_CHARS = 64
CACHE_BYTES = 64 << 20
ENTRY_BYTES = 110


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class BoundedCache:
    """Values worked out for strings (or bytes), kept within a budget of bytes.

    Those of over ``KEY_CHARS`` characters are worked out anew each time, so texts without spaces never stay in memory;
    a full cache starts afresh. A worker process that goes on to another cache gives the last one up.
    """

    current: BoundedCache | None = None

    def __init__(self, make: Callable[[Any], object], budget: int = CACHE_BYTES):
        self.make, self.budget, self.used = make, budget, 0
        self.held: dict = {}

    def clear(self) -> None:
        self.held.clear()
        self.used = 0

    def all(self, keys: list) -> list:
        if BoundedCache.current is not self:
            if BoundedCache.current is not None:
                BoundedCache.current.clear()
            BoundedCache.current = self
        found = list(map(self.held.get, keys))
        if None in found:
            found = [self.one(k) if v is None else v for k, v in zip(keys, found)]
        return found

    def one(self, key: str | bytes) -> object:
        value = self.held.get(key)
        if value is None:
            value = self.make(key)
            if len(key) <= KEY_CHARS:
                self.used += sys.getsizeof(key) + sys.getsizeof(value) + ENTRY_BYTES
                if self.used > self.budget:
                    self.clear()
                self.held[key] = value
        return value
