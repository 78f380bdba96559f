"""Retained sessions: generation guards, state exchange, cutoffs and cached answers.

State lives in tables; a generation is a number and a folder. A client names the state it holds, and gets
nothing, a difference or everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import fixpoint, tables
from factloom.session import materialize


class StaleGeneration(ValueError):
    """A request for a generation that is not the current or the next one."""


@dataclass
class Exchange:
    """mode is ``reuse``, ``delta`` or ``full``."""

    mode: str
    token: int
    rows: DataFrame | None


class RetainedTable:
    """A keyed table through its generations, each written once under ``root``."""

    def __init__(self, root: str, keys: list[str]):
        self.root, self.keys, self.generation = root, keys, 0
        self._states: dict[int, DataFrame] = {}

    def update(self, generation: int, rows: DataFrame) -> None:
        """Set the next generation; any other number is refused and nothing changes."""
        if generation != self.generation + 1:
            raise StaleGeneration(f"{generation} after {self.generation}")
        self._states[generation] = materialize(rows, f"{self.root}/generation={generation}")
        self.generation = generation

    def current(self, generation: int | None = None) -> DataFrame:
        if generation is not None and generation != self.generation:
            raise StaleGeneration(f"{generation} is not {self.generation}")
        return self._states[self.generation]

    def exchange(self, token: int | None) -> Exchange:
        """What a client with the state ``token`` needs to reach the current generation; an unknown state gets everything."""
        if token == self.generation:
            return Exchange("reuse", self.generation, None)
        if token not in self._states:
            return Exchange("full", self.generation, self.current())
        delta = tables.keyed_diff(self._states[token], self.current(), self.keys)
        if delta.isEmpty():
            return Exchange("reuse", self.generation, None)
        return Exchange("delta", self.generation, delta)

    def receive(self, held: DataFrame | None, said: Exchange) -> DataFrame:
        """The client's side: the state after an exchange."""
        if said.mode == "reuse":
            return held
        return said.rows if said.mode == "full" else tables.keyed_apply(held, said.rows, self.keys)


def affected_files(changed: DataFrame, old_imports: DataFrame, new_imports: DataFrame) -> DataFrame:
    """Files to analyse anew: the changed ones and all that import them, in the old or the new import graph.

    ``changed`` has path; imports have path and target.
    """
    edges = old_imports.select("path", "target").union(new_imports.select("path", "target")).select(F.col("target").alias("src"), F.col("path").alias("dst"))
    return fixpoint.spread(changed.select(F.col("path").alias("node"), F.lit(0).alias("tag")), edges).select(F.col("node").alias("path"))


def reshaped(old_exports: DataFrame, new_exports: DataFrame, changed: DataFrame) -> DataFrame:
    """Of the changed files only those whose export rows (path, name, kind) differ: others stop the propagation."""
    differ = tables.changed_groups(old_exports, new_exports, ["path"], ["name", "kind"])
    return changed.join(differ, "path", "left_semi")


def patch(old: DataFrame, contributions: DataFrame, affected: DataFrame) -> DataFrame:
    """The table after the affected files (path) have given their ``contributions`` anew; what other files gave stays.

    Contributions of files that are not affected are left out, so a full set and a partial one give the same.
    """
    fresh = contributions.join(affected.select("path").distinct(), "path", "left_semi")
    return tables.replace_groups(old, fresh, ["path"], affected)


def same_topology(old: DataFrame, new: DataFrame, resolved: DataFrame) -> bool:
    """Whether two edge tables (src, dst) are equal once edges to unresolved symbols are left out."""
    keep = resolved.select(F.col("node").alias("dst"))
    return tables.set_equal(old.join(keep, "dst", "left_semi").select("src", "dst"), new.join(keep, "dst", "left_semi").select("src", "dst"))


class AnswerCache:
    """Answers by the hash of their inputs, kept as tables under ``root``."""

    def __init__(self, root: str):
        self.root = root
        self._kept: dict[tuple, DataFrame] = {}

    @staticmethod
    def key(inputs: list[DataFrame]) -> tuple:
        out = []
        for df in inputs:
            r = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.pmod("h", F.lit(2**31)))).first()
            out.append(tuple(r))
        return tuple(out)

    def answer(self, inputs: list[DataFrame], compute) -> tuple[DataFrame, bool]:
        """The answer and whether it was kept from before."""
        k = self.key(inputs)
        known = k in self._kept
        if not known:
            self._kept[k] = materialize(compute(*inputs), f"{self.root}/answer-{len(self._kept)}")
        return self._kept[k], known
