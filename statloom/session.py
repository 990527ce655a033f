"""Named frames, cleaning sessions with rollback, and a seed, over one SparkSession."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators import quality
from .plans import sql
from .sources import readers


@dataclass
class CleaningSession:
    """Versions of a frame; frames are immutable, so a version costs nothing until it is read."""

    versions: list[tuple[str, DataFrame]]
    trail: list[str] = field(default_factory=list)

    @property
    def current(self) -> DataFrame:
        return self.versions[-1][1]

    def apply(self, label: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
        self.versions.append((label, step(self.current)))
        self.trail.append(f"apply {label}")
        return self.current

    def rollback(self, to: int = -2) -> DataFrame:
        """Back to a version by its place; without one, to the version before."""
        keep = to + 1 if to >= 0 else len(self.versions) + to + 1
        if not 0 < keep <= len(self.versions):
            raise ValueError("no such version")
        self.versions = self.versions[:keep]
        self.trail.append(f"rollback {self.versions[-1][0]}")
        return self.current

    def checkpoints(self) -> list[str]:
        return [label for label, _ in self.versions]

    def preview(self, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What a step would change, without applying it."""
        return quality.compare(self.current, step(self.current))

    def verify(self) -> DataFrame:
        """What all steps have changed so far."""
        return quality.compare(self.versions[0][1], self.current)


class Session:
    """Frames by name; results go under a new name or replace their input."""

    def __init__(self, spark: SparkSession, seed: int = 42) -> None:
        self.spark, self.seed = spark, seed
        self.frames: dict[str, DataFrame] = {}
        self.cleaning: dict[str, CleaningSession] = {}

    def load(self, name: str, path: str, **options) -> DataFrame:
        self.frames[name] = readers.read(self.spark, path, **options)
        return self.frames[name]

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.frames[name] = df
        return df

    def get(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise KeyError(f"no frame {name!r}; there are {', '.join(sorted(self.frames)) or 'none'}")
        return self.frames[name]

    def names(self) -> list[str]:
        return sorted(self.frames)

    def export(self, name: str, path: str, **options) -> None:
        readers.write(self.get(name), path, **options)

    def query(self, statement: str) -> DataFrame:
        """Read-only SQL over the named frames."""
        return sql.query(self.spark, statement, self.frames)

    def apply(self, name: str, step: Callable[[DataFrame], DataFrame], result: str | None = None) -> DataFrame:
        return self.put(result or name, step(self.get(name)))

    def batch(self, steps: list[tuple[str, Callable[[DataFrame], DataFrame], str | None]]) -> list[DataFrame]:
        return [self.apply(*s) for s in steps]

    def clean(self, name: str) -> CleaningSession:
        """The cleaning session of a frame, begun if there is none."""
        return self.cleaning.setdefault(name, CleaningSession([("loaded", self.get(name))]))

    def suggestions(self, name: str) -> list[tuple[str, str]]:
        """(column, step) worth trying: fill or drop columns with many nulls, drop constant ones."""
        step = {"many_nulls": "fill_na", "constant": "drop_columns", "unique": "keep as key"}
        return [(r["column"], step[r["issue"]]) for r in quality.issues(self.get(name)).collect()]  # a row per column
