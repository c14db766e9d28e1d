"""The list of runnable queries: name, inventory ids, Spark job, SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    build: Callable[..., DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None) -> Callable:
    """Register a function of :class:`pitlane.plans.fixtures.Tables` as a query."""

    def wrap(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in ENTRIES:
            raise ValueError(f"query {name!r} registered twice")
        ENTRIES[name] = Entry(name, tuple(ids.split()), build, sql)
        return build

    return wrap
