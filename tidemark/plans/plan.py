"""Plans: rows to act on and rows left out with their reason; and tables replaced as one snapshot."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shots import set_hash, tuple_line


@dataclass
class Plan:
    """What applying would do (actions) and what it would not (skipped, with reason)."""

    actions: DataFrame
    skipped: DataFrame

    @classmethod
    def of(cls, rows: DataFrame, reason: Column) -> Plan:
        """Rows whose reason is null are actions."""
        marked = rows.withColumn("reason", reason)
        return cls(marked.where("reason is null").drop("reason"), marked.where("reason is not null"))

    def without(self, *columns: str) -> Plan:
        return Plan(self.actions.drop(*columns), self.skipped.drop(*columns))

    def fingerprint(self, order: Sequence[str]) -> DataFrame:
        """n and a hash of the actions, whatever their order, to tell that a plan is still the one that was seen.

        Rows are hashed one by one and summed, so no task holds them all.
        """
        return self.actions.agg(F.count("*").alias("n"), set_hash(tuple_line(F.col(c) for c in order)).alias("plan_hash"))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The text of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for holds, text in reversed(rules):
        out = F.when(holds, text).otherwise(out)
    return out


class PlanMoved(RuntimeError):
    """What a plan was made from is no longer what is there."""


class Snapshots:
    """Several tables replaced at once: each version is a folder, and numbered manifests name the tables' folders.

    A commit writes its tables, then its manifest under a name of its own, and
    gives that the next number by a rename; nothing is deleted, so that a job
    that dies at any point leaves the last manifest as it was. Of two writers
    that take the same number one fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm  # noqa: SLF001
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def _last(self) -> int:
        path, fs = self._fs()
        held = path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(held)] if fs.exists(held) else []
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def current(self) -> dict[str, str]:
        """Folder of each table."""
        n = self._last()
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{n:012d}", wholetext=True).first()[0]) if n >= 0 else {}

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.current()[table])

    def version(self) -> int:
        """The last manifest's number, -1 before the first."""
        return self._last()

    def apply(self, plan: Callable[[Snapshots], Plan], seen: tuple[int, str], order: Sequence[str], effect: Callable[[Snapshots, Plan], dict[str, DataFrame]]) -> None:
        """Commit what a plan does, if the plan is still the one that was seen: (n, plan_hash) of its fingerprint over `order`.

        The plan is made again from the snapshot that is there now. If it
        differs, or if another writer commits before this one does, PlanMoved is
        raised and nothing is written that a reader could see.
        """
        at = self.version()
        again = plan(self)
        now = again.fingerprint(order).first()
        if (now["n"], now["plan_hash"]) != tuple(seen):
            raise PlanMoved(f"the plan had {seen[0]} actions, now it has {now['n']}" if now["n"] != seen[0] else "the plan has other actions now")
        self.commit(expected=at, **effect(self, again))

    def commit(self, *, expected: int | None = None, **tables: DataFrame) -> None:
        """Replace tables; with `expected`, only if that is still the last version."""
        if expected is not None and self._last() != expected:
            raise PlanMoved(f"version {self._last()} has come after {expected}")
        n = (self._last() if expected is None else expected) + 1
        held = self.current()
        version = uuid.uuid4().hex
        for name, rows in tables.items():
            held[name] = f"{self.root}/{version}/{name}"
            rows.write.parquet(held[name])
        path, fs = self._fs()
        fresh, at = path(f"{self.root}/{version}/manifest"), path(f"{self.root}/manifests/{n:012d}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        fs.mkdirs(at.getParent())
        if fs.exists(at) or not fs.rename(fresh, at):
            fs.delete(path(f"{self.root}/{version}"), True)
            raise (RuntimeError if expected is None else PlanMoved)(f"another writer has committed version {n}")
