"""Processing only new or changed records (problem 1): high watermarks on a commit sequence.

``CommitLog`` runs any transformation over the rows between the committed watermark and an
upper limit fixed at the start; output and new watermark become visible by one atomic
publication.  ``SectionFeed`` is the log of a feed of versions: its first run takes over
what the successful runs of an older ledger recorded, each section's watermark being the
position in the feed of the version recorded last; every later run reads only the rows
received since the committed limit and meets the committed state of their sections.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.tables import small


def canonical_path(path: Column) -> Column:
    """One spelling of a file path: scheme, escapes, empty, ``.`` and ``..`` steps resolved."""
    bare = F.regexp_replace(F.trim(path), r"^file:(//(localhost)?(?=/))?", "")
    plain = F.coalesce(F.try_url_decode(F.regexp_replace(bare, r"\+", "%2B")), bare)
    steps = F.split(plain, "/")
    folded = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.when(plain.startswith("/"), "/").otherwise(""), F.array_join(folded, "/"))


def status_word(status: Column) -> Column:
    """The status in one spelling: trimmed, lower case."""
    return F.lower(F.trim(status))


def successful_runs(book_runs: DataFrame, books: DataFrame) -> DataFrame:
    """(run_id, book_id, started_at) of each run whose last ledger line for the book says ok.

    Last is the greatest logged_at, then the greatest started_at and status, so that ties
    have one outcome.  A line without run or path belongs to no run.
    """
    lines = book_runs.where("run_id IS NOT NULL").select("run_id", canonical_path(F.col("source_path")).alias("path"), "logged_at", "started_at", status_word(F.col("status")).alias("status"))
    last = lines.groupBy("run_id", "path").agg(F.max(F.struct("logged_at", "started_at", "status")).alias("last"))
    ok = last.where("last.status = 'ok'").select("run_id", "path", F.col("last.started_at").alias("started_at"))
    named = books.where("book_id IS NOT NULL").select("book_id", canonical_path(F.col("source_path")).alias("path"))
    return ok.join(small(named), "path").groupBy("run_id", "book_id").agg(F.max("started_at").alias("started_at"))


KEY = ("book_id", "chapter_index", "section_index")


def _position() -> Column:
    """Position of a version in the feed."""
    return F.struct("updated_at", "received_at", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


def recorded_sections(section_state: DataFrame, book_runs: DataFrame, books: DataFrame) -> DataFrame:
    """(key, recorded_hash, started_at) of what the last successful run wrote down for each section.

    Commit sequence: started_at of the successful runs, then written_at and hash on ties.
    """
    state = section_state.where("run_id IS NOT NULL AND book_id IS NOT NULL").select("run_id", *KEY, "text_hash", "written_at")
    written = state.join(small(successful_runs(book_runs, books)), ["run_id", "book_id"])
    done = F.max(F.struct("started_at", "written_at", F.lower(F.trim("text_hash")).alias("hash")))
    return written.groupBy(*KEY).agg(done.alias("done")).select(*KEY, F.col("done.hash").alias("recorded_hash"), F.col("done.started_at").alias("started_at"))


def _null_safe(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on KEY, NULLs of which are keys of their own; the key stays once."""
    other = right.select(*[F.col(c).alias(f"_{c}" if c in KEY else c) for c in right.columns])
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY], how).drop(*[f"_{k}" for k in KEY])


def above_watermark(versions: DataFrame, recorded: DataFrame) -> DataFrame:
    """(key, newest, recorded_hash, due): the newest version of each section, due if rows of it lie above its watermark.

    Position of a version: (updated_at, received_at, hash).  The watermark of a section is
    the position of the last version with the recorded hash; none, if no version has it or
    nothing is recorded, and then every row is above it.  What lies above has another hash
    by construction, so a late copy of an older version changes nothing, and a version that
    was received before the run but not recorded by it is not skipped.
    """
    placed = versions.select(*KEY, _position().alias("position"))
    both = _null_safe(placed, recorded.select(*KEY, "recorded_hash"), "left")
    low = F.max(F.when(F.col("position.hash") == F.col("recorded_hash"), F.col("position")))
    each = both.groupBy(*KEY).agg(F.max("position").alias("newest"), low.alias("low"), F.max("recorded_hash").alias("recorded_hash"))
    return each.select(*KEY, "newest", "recorded_hash", F.expr("low IS NULL OR newest > low").alias("due"))


def due_sections(sections: DataFrame, section_state: DataFrame, book_runs: DataFrame, books: DataFrame) -> DataFrame:
    """(key, text_hash, recorded_hash) of the sections due now, by a ledger that other programs wrote.

    The hash is always that of the text; text_hash of the feed is not trusted.  A NULL text
    has no hash and is due whenever it is the newest version.  NULL keys form groups of their
    own.  Texts never leave the scan: each is hashed before the shuffle.
    """
    due = above_watermark(sections, recorded_sections(section_state, book_runs, books)).where("due")
    return due.select(*KEY, F.col("newest.hash").alias("text_hash"), "recorded_hash")


class CommitLog:
    """Exactly-once batches over a source with a monotonic commit sequence.

    ``place/commits/N.json`` is the N-th commit: its watermark and its output folder.  A run
    reads the newest commit, fixes the upper limit, writes its output to a folder of its own
    and publishes both by linking a finished manifest to the next number, which fails if the
    number is taken; so of two concurrent runs one is refused, and what a failed run left is
    in a folder no commit names.  Manifests are read by the driver; no job runs for them.

    Rows that arrive later with the very value of the committed limit are not skipped: a
    commit also keeps the hashes of the rows that stood at its limit, with how often, and the
    next run takes what is there beyond them.  Rows below the limit must not arrive any more;
    that is what makes the sequence a commit sequence.
    """

    def __init__(self, spark: SparkSession, place: str, sequence: str) -> None:
        self.spark, self.place, self.sequence = spark, place.rstrip("/"), sequence
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *p: path("/".join((self.place, *p)))
        self._fs = self._path("commits").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("commits"))

    def _names(self) -> list[str]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path("commits")))
        return sorted(n for n in names if n.endswith(".json") and not n.startswith("."))

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path("commits", name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commits(self) -> list[dict]:
        """All commits in order."""
        return [self._read(n) for n in self._names()]

    def last(self) -> tuple[int, dict | None]:
        """(number of the next commit, the newest commit or None)."""
        names = self._names()
        return (int(names[-1][:-5]) + 1, self._read(names[-1])) if names else (0, None)

    def watermark(self) -> object | None:
        """The upper limit of the last commit, None before the first."""
        last = self.last()[1]
        return last and last["upper"]

    def run(self, source: DataFrame, work: Callable[[DataFrame], DataFrame]) -> bool:
        """Process the rows above the watermark up to the limit fixed now; False if there are none.

        Rows whose sequence is NULL carry no position and are never due.
        """
        number, last = self.last()
        kind, at = dict(source.dtypes)[self.sequence], F.col(self.sequence)
        value = lambda v: F.lit(v).cast(kind)
        high = source.agg(F.max(at).cast("string")).first()[0]
        if high is None:
            return False
        rows = source.where(at <= value(high))
        if last:
            rows = rows.where(at > value(last["upper"])).unionByName(self._beyond(source.where(at == value(last["upper"])), last))
            if rows.isEmpty():
                return False
        out = self._folder(number)
        work(rows).write.parquet(f"{self.place}/{out}/rows")
        self._marked(source.where(at == value(high))).groupBy("_id").agg(F.count("*").alias("_times")).write.parquet(f"{self.place}/{out}/edge")
        self.publish(number, {"lower": last and last["upper"], "upper": high, "output": out})
        return True

    @staticmethod
    def _marked(rows: DataFrame) -> DataFrame:
        whole = F.struct(*[F.col(c) for c in rows.columns])
        return rows.select(whole.alias("_row"), F.sha2(F.to_json(whole), 256).alias("_id"))

    def _beyond(self, rows: DataFrame, last: dict) -> DataFrame:
        """The rows at the committed limit beyond those already taken, copies counted."""
        taken = self.spark.read.parquet(f"{self.place}/{last['output']}/edge")
        here = self._marked(rows).groupBy("_id").agg(F.first("_row").alias("_row"), F.count("*").alias("_now"))
        more = here.join(taken, "_id", "left").withColumn("_more", F.col("_now") - F.coalesce("_times", F.lit(0))).where("_more > 0")
        return more.select("_row", F.explode(F.sequence(F.lit(1), F.col("_more").cast("int")))).select("_row.*")

    @staticmethod
    def _folder(number: int) -> str:
        return f"batch-{number:08d}-{uuid.uuid4().hex}"

    def publish(self, number: int, commit: dict) -> None:
        """Make a commit visible under its number, or raise if another run has it."""
        draft, final = self._path("commits", f".draft-{uuid.uuid4().hex}"), self._path("commits", f"{number:08d}.json")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(commit).encode()))
        stream.close()
        try:
            if self._fs.getScheme() == "file":  # a rename would replace the target here; a hard link does not
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            else:
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(draft, final, none)
        except Exception as e:
            raise RuntimeError(f"commit {number} was taken by another run") from e
        finally:
            self._fs.delete(draft, False)

    def output(self) -> DataFrame | None:
        """All committed output, None before the first commit."""
        paths = [f"{self.place}/{c['output']}/rows" for c in self.commits()]
        return self.spark.read.parquet(*paths) if paths else None


class SectionFeed(CommitLog):
    """The sections due, run by run, of a feed of versions ordered by received_at.

    A commit holds the limit of received_at and the newest version of every section it
    touched, with a mark at those due; output, state and watermark are one publication, and a
    run that fails leaves nothing behind.  Rows at the committed limit are read again, and so
    are rows without received_at: the state tells that nothing is new in them.
    """

    #: Folders of state that are read together before they are put into one.
    FOLDERS = 16

    def __init__(self, spark: SparkSession, place: str) -> None:
        super().__init__(spark, place, "received_at")

    def _known(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.place}/{f}" for f in folders]).groupBy(*KEY).agg(F.max("newest").alias("known"))

    def run(self, sections: DataFrame, recorded: DataFrame | None = None) -> int:
        """One run over the rows up to the greatest received_at there is now; the number of its commit.

        ``recorded`` is taken over by the first run only (see ``recorded_sections``).
        """
        number, last = self.last()
        at, limit = F.col("received_at"), lambda v: F.lit(v).cast("timestamp_ntz")
        high, low = sections.agg(F.max(at).cast("string")).first()[0], last and last["upper"]
        rows = sections if high is None else sections.where(at.isNull() | (at <= limit(high)))
        folder, states = self._folder(number), last["states"] if last else []
        if last is None:
            none = "book_id bigint, chapter_index int, section_index int, recorded_hash string"
            found = above_watermark(rows, self.spark.createDataFrame([], none) if recorded is None else recorded)
        else:
            fresh = (rows if low is None else rows.where(at.isNull() | (at >= limit(low)))).groupBy(*KEY).agg(F.max(_position()).alias("newest"))
            both = _null_safe(fresh, self._known(states), "left").where("known IS NULL OR newest > known")
            found = both.select(*KEY, "newest", F.col("known.hash").alias("recorded_hash"), F.expr("known IS NULL OR NOT (newest.hash <=> known.hash)").alias("due"))
        found.write.parquet(f"{self.place}/{folder}/rows")
        states = [*states, f"{folder}/rows"]
        if len(states) > self.FOLDERS:
            self._known(states).withColumnRenamed("known", "newest").write.parquet(f"{self.place}/{folder}/state")
            states = [f"{folder}/state"]
        self.publish(number, {"lower": low, "upper": low if high is None else high, "output": folder, "states": states})
        return number

    def output(self, number: int | None = None) -> DataFrame | None:
        """(key, text_hash, recorded_hash) of the sections that were due in a run, or in all; None before the first."""
        outputs = [c["output"] for c in (self.commits() if number is None else [self._read(f"{number:08d}.json")])]
        if not outputs:
            return None
        due = self.spark.read.parquet(*[f"{self.place}/{o}/rows" for o in outputs]).where("due")
        return due.select(*KEY, F.col("newest.hash").alias("text_hash"), "recorded_hash")
