"""Resumable stages: a manifest of fingerprints tells which documents a stage still has to do."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.incremental import CommitLog


def canonical_stages(wanted: Iterable[str], known: Iterable[str]) -> list[str]:
    """The wanted stages in their fixed order; an unknown one is an error."""
    order, chosen = list(known), set(wanted)
    if unknown := chosen - set(order):
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    return [s for s in order if s in chosen]


def deep_merge(base: dict[str, Any], overlay: dict[str, Any]) -> dict[str, Any]:
    """``overlay`` over ``base``, nested dicts merged, anything else replaced."""
    out = dict(base)
    for k, v in overlay.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def settings_hash(settings: dict[str, Any]) -> str:
    """A fingerprint of settings that does not depend on the order of keys."""
    import hashlib

    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


class StageStore:
    """Outputs of stages by document, with the fingerprints they were made from.

    Each run writes its output and the (key, fingerprint) of its documents to a folder of its
    own and publishes it by one commit (see ``CommitLog``), so a failed run is done again and
    never half taken for done.  Of a document the rows of its newest commit count; one that
    yields no rows any more has none.  Documents share files: no folder for each of them.
    """

    #: Folders of a stage that are read together before they are put into one.
    FOLDERS = 32

    def __init__(self, spark: SparkSession, place: str, key: str) -> None:
        self.spark, self.place, self.key = spark, place.rstrip("/"), key

    def _log(self, stage: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.place}/{stage}", self.key)

    def _all(self, log: CommitLog, commit: dict | None, part: str) -> DataFrame | None:
        """One part of all live folders, with the number of the commit each row came by."""
        each = [self.spark.read.parquet(f"{log.place}/{folder}/{part}") for folder in commit["folders"]] if commit else []
        rows = [d if "_commit" in d.columns else d.withColumn("_commit", F.lit(n)) for d, n in zip(each, commit["numbers"], strict=True)] if commit else []
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows) if rows else None

    def _newest(self, log: CommitLog, commit: dict | None) -> DataFrame | None:
        done = self._all(log, commit, "done")
        return done and done.groupBy(self.key).agg(F.max(F.struct("_commit", "fingerprint")).alias("n")).select(self.key, "n._commit", "n.fingerprint")

    def done(self, stage: str) -> DataFrame | None:
        """(key, fingerprint) of the last time each document was done."""
        log = self._log(stage)
        newest = self._newest(log, log.last()[1])
        return newest and newest.select(self.key, "fingerprint")

    def todo(self, stage: str, documents: DataFrame) -> DataFrame:
        """Documents (key, fingerprint, ...) that were never done or have changed since."""
        done = self.done(stage)
        return documents if done is None else documents.join(done, [self.key, "fingerprint"], "left_anti")

    def run(self, stage: str, documents: DataFrame, work: Callable[[DataFrame], DataFrame]) -> int:
        """Work on what is to do; the number of documents done.  ``work`` keeps the key column."""
        log = self._log(stage)
        number, last = log.last()
        folder = f"run-{number:08d}-{uuid.uuid4().hex}"
        at = f"{log.place}/{folder}"
        self.todo(stage, documents).write.parquet(f"{at}/due")
        due = self.spark.read.parquet(f"{at}/due")
        due.select(self.key, "fingerprint").distinct().write.parquet(f"{at}/done")
        n = self.spark.read.parquet(f"{at}/done").count()
        if n:
            work(due).write.parquet(f"{at}/out")
            folders, numbers = [*(last["folders"] if last else []), folder], [*(last["numbers"] if last else []), number]
            log.publish(number, {"upper": None, "output": folder, "folders": folders, "numbers": numbers})
            if len(folders) > self.FOLDERS:
                self.compact(stage)
        return n

    def compact(self, stage: str) -> None:
        """Put what counts of a stage into one folder, by a commit of its own."""
        log = self._log(stage)
        number, last = log.last()
        folder = f"run-{number:08d}-{uuid.uuid4().hex}"
        self._live(log, last).write.parquet(f"{log.place}/{folder}/out")
        self._newest(log, last).write.parquet(f"{log.place}/{folder}/done")
        log.publish(number, {"upper": None, "output": folder, "folders": [folder], "numbers": [number]})

    def _live(self, log: CommitLog, commit: dict | None) -> DataFrame | None:
        rows, newest = self._all(log, commit, "out"), self._newest(log, commit)
        return rows and rows.join(newest.select(self.key, "_commit"), [self.key, "_commit"], "left_semi")

    def output(self, stage: str) -> DataFrame | None:
        """The rows of the newest commit of every document; None before the first."""
        log = self._log(stage)
        live = self._live(log, log.last()[1])
        return live and live.drop("_commit")


class PartialProgress:
    """Rows a stage had finished when it was stopped, kept under the identity of its run.

    Another identity is another run: what an older one left is dropped.  With ``loose``
    names the run goes on although those parts of the identity differ (as the hash of all
    contents does when one row changed); its rows must then be checked one by one, see
    ``reusable``.
    """

    def __init__(self, spark: SparkSession, place: str, identity: dict[str, Any], loose: Iterable[str] = ()) -> None:
        self.spark, self.root = spark, place.rstrip("/")
        self.name = settings_hash({k: v for k, v in identity.items() if k not in set(loose)})
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *p: path("/".join((self.root, *p)))
        self._fs = path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.name))
        for entry in self._fs.listStatus(path(self.root)):
            if entry.getPath().getName() != self.name:
                self._fs.delete(entry.getPath(), True)

    def add(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.root}/{self.name}/part-{uuid.uuid4().hex}")

    def rows(self) -> DataFrame | None:
        """All rows finished so far; None if there are none."""
        parts = [str(s.getPath()) for s in self._fs.listStatus(self._path(self.name)) if self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return self.spark.read.parquet(*parts) if parts else None

    def clear(self) -> None:
        self._fs.delete(self._path(self.name), True)


def reusable(units: DataFrame, previous: DataFrame, key: list[str], same: str, null_safe: Iterable[str] = ()) -> DataFrame:
    """``units`` with ``reuse``: whether ``previous`` has the key with the same hash, and the same
    (NULL being a value) in the other columns.  Exact copies in ``previous`` count once."""
    other = previous.select(*[F.col(k).alias(f"_{k}") for k in [*key, same, *null_safe]]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*key, *null_safe]] + [F.col(same) == F.col(f"_{same}")]
    hit = units.join(other, on, "left")
    return hit.select(*units.columns, F.col(f"_{same}").isNotNull().alias("reuse"))


def with_cache(rows: DataFrame, cache: DataFrame, key: list[str], same: str, made: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the ``made`` columns: taken from the cache where key and hash fit, else worked out.

    Cached rows pass by the work, which sees the rest only; the order of the input is that of
    its key, since no order survives a distributed plan.
    """
    kept = cache.groupBy(*key, same).agg(F.max(F.struct(*made)).alias("_made"))
    both = rows.join(kept, [*key, same], "left")
    hit = both.where("_made IS NOT NULL").select(*rows.columns, *[F.col(f"_made.{m}").alias(m) for m in made])
    return hit.unionByName(work(both.where("_made IS NULL").select(*rows.columns)).select(*rows.columns, *made))


class Pool:
    """Members of a small pool handed out without repeat until all were used, over many runs.

    The turn reached is published with the assignments, so a failed run hands nothing out.
    """

    def __init__(self, spark: SparkSession, place: str, members: Iterable[str], seed: int = 0) -> None:
        self.log = CommitLog(spark, place, "turn")
        self.order = sorted(set(members), key=lambda m: settings_hash({"seed": seed, "member": m}))
        if not self.order:
            raise ValueError("a pool needs members")

    def assign(self, names: DataFrame, name: str) -> DataFrame:
        """(name, member) of the distinct names in order; copies of a name get one member."""
        number, last = self.log.last()
        start = int(last["upper"]) if last else 0
        each = names.where(F.col(name).isNotNull()).select(name).distinct()
        turns = each.rdd.map(lambda r: r[0]).sortBy(lambda v: v).zipWithIndex().toDF(f"{name} {dict(each.dtypes)[name]}, turn bigint") if not each.isEmpty() else each.withColumn("turn", F.lit(0).cast("long"))
        member = F.element_at(F.array(*map(F.lit, self.order)), (F.pmod(F.col("turn") + start, F.lit(len(self.order))) + 1).cast("int"))
        folder = f"batch-{number:08d}-{uuid.uuid4().hex}"
        turns.select(name, member.alias("member")).write.parquet(f"{self.log.place}/{folder}/rows")
        out = self.log.spark.read.parquet(f"{self.log.place}/{folder}/rows")
        self.log.publish(number, {"upper": start + out.count(), "output": folder})
        return out
