"""The freshness benchmark: what is found at once, and at later deadlines, after a text arrives."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans.search import Index, SearchOptions

DEADLINES_MS: tuple[int | None, ...] = (0, 100, 500, 1000, 5000, None)


@dataclass
class Episode:
    """Texts that are there, texts that arrive, a query and the paths that answer it."""

    name: str
    stable: list[tuple[str, str]]
    fresh: list[tuple[str, str]]
    query: str
    relevant: set[str]


class Runner(Protocol):
    name: str

    def prepare(self, stable: Sequence[tuple[str, str]]) -> None: ...

    def arrive(self, fresh: Sequence[tuple[str, str]]) -> None: ...

    def settle(self) -> None: ...

    def search(self, query: str, k: int) -> list[str]: ...


class IndexRunner:
    """The index itself. Derived tables are built while stable texts are prepared and when all has settled."""

    def __init__(self, spark: SparkSession, root: str, **models: object) -> None:
        self.name, self.spark, self.index = "index", spark, Index(spark, root, **models)

    def _add(self, rows: Sequence[tuple[str, str]]) -> None:
        if rows:
            self.index.add_rows(self.spark.createDataFrame(list(rows), "source_path string, content string"))

    def prepare(self, stable: Sequence[tuple[str, str]]) -> None:
        self._add(stable)
        self.settle()

    def arrive(self, fresh: Sequence[tuple[str, str]]) -> None:
        self._add(fresh)

    def settle(self) -> None:
        self.index.build_pending_shards()
        self.index.embed_pending()

    def search(self, query: str, k: int) -> list[str]:
        return list(dict.fromkeys(r["source_path"] for r in self.index.search(query, SearchOptions(top_k=k)).collect()))


def run_episode(spark: SparkSession, runner: Runner, episode: Episode, k: int = 5, deadlines: Sequence[int | None] = DEADLINES_MS) -> DataFrame:
    """``(runner, episode, deadline_ms, path, rank, latency_ms, n_relevant, relevant)``. An answer
    that comes after its deadline has no rows; deadline 0 and none at all (null) take every answer, the latter after the index has settled."""
    runner.prepare(episode.stable)
    runner.arrive(episode.fresh)
    rows = []
    for deadline in deadlines:
        if deadline is None:
            runner.settle()
        began = time.perf_counter()
        found = runner.search(episode.query, k)
        took = (time.perf_counter() - began) * 1000
        if not deadline or took <= deadline:
            rows += [(runner.name, episode.name, deadline, p, n + 1, took, len(episode.relevant), p in episode.relevant) for n, p in enumerate(found)]
    return spark.createDataFrame(rows, "runner string, episode string, deadline_ms int, path string, rank int, latency_ms double, n_relevant int, relevant boolean")
