"""A graph of stored stages: what each depends on, and running only what is stale.

A stage names the settings that its result depends on and the stages that it reads. Its fingerprint holds those settings and the digests of the stages before it, so that a
changed setting makes stale exactly the stages that name it and all that come after them. Results are kept under their digest: settings that come back find theirs again, and a reader of
an older result is never overwritten. A missing or null setting is an error that names the stage and the key, before anything runs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from frameflow.sources import store


@dataclass(frozen=True)
class Stage:
    """make takes the stage's settings and the results of the stages that it reads, both by name. revision is raised when the code of make changes what it gives."""

    name: str
    schema: str
    make: Callable[[dict, dict[str, DataFrame]], DataFrame]
    keys: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    revision: int = 1


class Graph:
    def __init__(self, stages: Sequence[Stage]):
        self.stages = {s.name: s for s in stages}
        if len(self.stages) != len(stages):
            raise ValueError("two stages have one name")
        unknown = {f"{s.name} reads {a}" for s in stages for a in s.after if a not in self.stages}
        if unknown:
            raise ValueError(f"no such stage: {', '.join(sorted(unknown))}")
        try:
            self.order = list(TopologicalSorter({s.name: s.after for s in stages}).static_order())
        except CycleError as e:
            raise ValueError(f"stages read each other in a circle: {' < '.join(e.args[1])}") from None

    def needed(self, wanted: Sequence[str] | None) -> list[str]:
        """The wanted stages (all if None) and what they are made from, in an order in which they can run."""
        if wanted is None:
            return self.order
        found, left = set(), list(wanted)
        while left:
            name = left.pop()
            if name not in self.stages:
                raise ValueError(f"no such stage: {name}")
            if name not in found:
                found.add(name)
                left += self.stages[name].after
        return [n for n in self.order if n in found]

    def marks(self, settings: dict, wanted: Sequence[str] | None = None) -> dict[str, dict[str, str]]:
        """The fingerprint of each needed stage."""
        out: dict[str, dict[str, str]] = {}
        for name in self.needed(wanted):
            s = self.stages[name]
            missing = [k for k in s.keys if settings.get(k) is None]
            if missing:
                raise ValueError(f"stage {name} needs {', '.join(missing)}")
            out[name] = store.fingerprint(name, {k: settings[k] for k in s.keys} | {"revision": s.revision}, {a: digest(out[a]) for a in s.after})
        return out

    def stale(self, spark: SparkSession, root: str, settings: dict, wanted: Sequence[str] | None = None) -> list[str]:
        """The needed stages without a stored result for these settings."""
        return [n for n, mark in self.marks(settings, wanted).items() if not store.exists(spark, f"{place(root, n, mark)}/{store.MARK}")]

    def run(self, spark: SparkSession, root: str, settings: dict, wanted: Sequence[str] | None = None) -> tuple[dict[str, DataFrame], list[str]]:
        """The results of the needed stages, and the names of those that had to run, in their order. A result is read back before the next stage sees it, so that none is made twice."""
        results: dict[str, DataFrame] = {}
        ran: list[str] = []
        for name, mark in self.marks(settings, wanted).items():
            s, path = self.stages[name], place(root, name, mark)
            rows = store.load(spark, path, mark, s.schema) if store.exists(spark, f"{path}/{store.MARK}") else None
            if rows is None:
                store.save(s.make({k: settings[k] for k in s.keys}, {a: results[a] for a in s.after}), path, mark)
                rows = store.load(spark, path, mark, s.schema)
                ran.append(name)
            results[name] = rows
        return results, ran


def digest(mark: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps(mark, sort_keys=True).encode()).hexdigest()


def place(root: str, name: str, mark: dict[str, str]) -> str:
    return f"{root}/{name}-{digest(mark)[:24]}"
