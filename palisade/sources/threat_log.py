"""The threat log: threat rows in a folder, by day, with marks beside them.

Layout: ``rows/day=YYYY-MM-DD`` holds the rows of a day (rows without a time under Spark's
default name), ``marks`` the ids that were marked as false positives, ``dead`` what could not be
judged.  Appending only adds files, sorted by id and with a Bloom filter on it, so that one
row is found without reading the others.  Reports read the columns and, where they ask for a
window, the days they need.

Beside each batch's rows stand its partial counts (``rollup``): by hour, type, source, address and
action.  They add up, so late rows are more partials of an hour that has some already, and a
report needs them alone, but for the hour in which its window begins (``rolled``).  A flush takes
them with their rows.  False positives count in these reports, so marks change nothing there.

A stream's batch is committed once.  Its writer (a name for what is read, say a checkpoint's
place), its epoch (the query's id, which a checkpoint keeps) and its number name it and its
files.  The batch is written beside the log, then ``commits/WRITER/EPOCH/BATCH.begun`` tells
that its files are being moved in, and ``.done`` that they are there.  A batch that is done is
not added again; one that was cut short first loses the files it has left, which its name
finds, and no other batch's rows are read.  Only where a writer's earlier epoch has brought
rows, as after a checkpoint was lost and the source is read from its start again, ids that the
writer's earlier epochs have logged are left out.
"""

from __future__ import annotations

import re
import uuid
from datetime import date, datetime, timedelta

from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.plans.stats import filtered, hours_of, limit_of, with_false_positives

SCHEMA = (
    "id long, ip_address string, user_agent string, threat_type string, threat_source string, confidence_score int, request_url string, request_method string, "
    "matched_pattern string, payload_snippet string, headers_snapshot map<string,string>, action_taken string, is_false_positive boolean, country_code string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)

#: Counts of one hour's rows that share type, source, address and action.
PARTIAL = (
    "hour timestamp_ntz, threat_type string, threat_source string, ip_address string, action_taken string, total long, high long, medium long, low long, confidence_score int"
)
DEAD = "request_id long, phase int, error string, row string"


def partial_keys() -> list[Column]:
    hour = F.date_format("created_at", "yyyy-MM-dd HH:00:00").cast("timestamp_ntz").alias("hour")
    return [hour, *map(F.col, ("threat_type", "threat_source", "ip_address", "action_taken"))]


def partial_counts() -> list[Column]:
    s = F.col("confidence_score")
    bands = {"high": s >= 90, "medium": s.between(70, 89), "low": s < 70}
    return [F.count(F.lit(1)).alias("total"), *[F.count_if(test).alias(name) for name, test in bands.items()], F.max("confidence_score").alias("confidence_score")]


class ThreatLog:
    """A threat log at ``path``, in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.rows_path, self.marks_path, self.rollup_path = f"{self.path}/rows", f"{self.path}/marks", f"{self.path}/rollup"

    def _file_system(self):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _exists(self, path: str) -> bool:
        files, place = self._file_system()
        return files.exists(place(path))

    def append(self, rows: DataFrame) -> None:
        """Add threat rows."""
        self.append_batch(rows, 0, f"append-{uuid.uuid4().hex}")

    def _write(self, rows: DataFrame, path: str) -> None:
        """One shuffle by day and a few hundred thousand rows a file, so that days don't become many small files."""
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        dated = rows.select(*names, F.col("created_at").cast("date").alias("day"))
        dealt = dated.repartition("day", F.floor(F.col("id") / 500_000)).sortWithinPartitions("day", "id")
        dealt.write.mode("append").partitionBy("day").option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.expected.ndv#id", "500000").parquet(path)

    def _partials(self, path: str) -> DataFrame:
        """The partial counts of the rows in a folder, with their day."""
        rows = self.spark.read.schema(SCHEMA + ", day date").parquet(path)
        return rows.groupBy("day", *partial_keys()).agg(*partial_counts())

    def _write_partials(self, rows_at: str, path: str) -> None:
        self._partials(rows_at).repartition("day").write.mode("append").partitionBy("day").parquet(path)

    def append_batch(self, rows: DataFrame, batch_id: int, writer: str = "batches", epoch: str = "0") -> None:
        """Add a batch of a stream's rows once, however often it is run."""
        writer, epoch = re.sub(r"[^A-Za-z0-9_-]", "_", writer), re.sub(r"[^A-Za-z0-9_-]", "_", epoch)
        files, place = self._file_system()
        commits = f"{self.path}/commits/{writer}"
        begun, done = (f"{commits}/{epoch}/{batch_id}.{state}" for state in ("begun", "done"))
        if self._exists(done):
            return
        name = f"{writer}.{epoch}.{batch_id}."
        before = [] if not self._exists(commits) else [e for e in (s.getPath().getName() for s in files.listStatus(place(commits))) if e != epoch]
        if before and self._exists(self.rows_path):
            rows = self._unlogged(rows, f"{writer}.{{{','.join(before)}}}.*")
        staged = f"{self.path}/staging/{name}{uuid.uuid4().hex}"
        self._write(rows, f"{staged}/rows")
        self._write_partials(f"{staged}/rows", f"{staged}/rollup")
        if self._exists(begun):
            for kind in ("rows", "rollup"):
                for left in files.globStatus(place(f"{self.path}/{kind}/day=*/{name}*")):
                    files.delete(left.getPath(), False)
        files.create(place(begun), True).close()
        for kind in ("rows", "rollup"):
            at = 0
            for day in files.listStatus(place(f"{staged}/{kind}")):
                if not day.isDirectory():
                    continue
                target = f"{self.path}/{kind}/{day.getPath().getName()}"
                files.mkdirs(place(target))
                for file in files.listStatus(day.getPath()):
                    if not files.rename(file.getPath(), place(f"{target}/{name}{at}.parquet")):
                        raise OSError(f"{file.getPath()} could not be moved to {target}")
                    at += 1
        files.create(place(done), True).close()
        for left in files.globStatus(place(f"{self.path}/staging/{name}*")):
            files.delete(left.getPath(), True)
        for path in (self.rows_path, self.rollup_path):
            self.spark.catalog.refreshByPath(path)

    def _unlogged(self, rows: DataFrame, names: str) -> DataFrame:
        """Rows whose ids are not in the files with such names; only days from the rows' first one on are read."""
        first = rows.agg(F.min("created_at").cast("date").alias("day")).first().day
        known = self.spark.read.schema("id long, day date").option("pathGlobFilter", names).parquet(self.rows_path)
        known = known.where(F.col("day").isNull() | F.lit(first is not None) & (F.col("day") >= F.lit(first).cast("date")))
        return rows.join(known.select("id"), "id", "left_anti")

    def set_aside(self, rows: DataFrame, batch: str) -> None:
        """Keep a batch's dead letters (request_id, phase, error, row: what could not be judged, as JSON) beside the log; a rerun replaces them."""
        rows.select(*[f.split(" ")[0] for f in DEAD.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/dead/batch={batch}")

    def dead_letters(self) -> DataFrame:
        path = f"{self.path}/dead"
        return self.spark.read.schema(DEAD).parquet(path) if self._exists(path) else self.spark.createDataFrame([], DEAD)

    def rows(self, as_of: datetime | None = None, hours: object = None, days: tuple[date, date] | None = None) -> DataFrame:
        """The rows as they were written; with a time, only days that its window touches are read, and with days, only those."""
        if not self._exists(self.rows_path):
            return self.spark.createDataFrame([], SCHEMA)
        found = self.spark.read.schema(SCHEMA + ", day date").parquet(self.rows_path)
        if as_of is not None:
            found = found.where(F.col("day") >= F.lit((as_of - timedelta(hours=hours_of(hours))).date()))
        if days is not None:
            found = found.where(F.col("day").between(*map(F.lit, days)))
        return found.drop("day")

    def read(self, as_of: datetime | None = None, hours: object = None, days: tuple[date, date] | None = None) -> DataFrame:
        """The rows with their false-positive marks."""
        found = self.rows(as_of, hours, days)
        return with_false_positives(found, self.spark.read.schema("id long").parquet(self.marks_path)) if self._exists(self.marks_path) else found

    def rolled(self, as_of: datetime, hours: object = None) -> DataFrame:
        """Partial counts of the window's rows: those of its whole hours, and of the hour it begins in, if that is not whole, its rows counted now."""
        if not self._exists(self.rollup_path):
            return self.spark.createDataFrame([], SCHEMA).groupBy(*partial_keys()).agg(*partial_counts())
        cutoff = as_of - timedelta(hours=hours_of(hours))
        whole = cutoff.replace(minute=0, second=0, microsecond=0)
        whole += timedelta(hours=whole < cutoff)
        found = self.spark.read.schema(PARTIAL + ", day date").parquet(self.rollup_path)
        found = found.where(F.col("day") >= F.lit(whole.date())).where(F.col("hour") >= F.lit(whole).cast("timestamp_ntz")).drop("day")
        if whole == cutoff:
            return found
        begun = self.rows(days=(cutoff.date(), cutoff.date())).where(F.col("created_at").between(F.lit(cutoff).cast("timestamp_ntz"), F.lit(whole - timedelta(microseconds=1)).cast("timestamp_ntz")))
        return found.unionByName(begun.groupBy(*partial_keys()).agg(*partial_counts()))

    def page(self, as_of: datetime, hours: object = None, limit: object = None, page: int = 1, threat_type: str | None = None, action: str | None = None) -> DataFrame:
        """One page of the list, as ``stats.threat_page`` gives it, from the days that the page touches.

        Rows are counted by day first (a window has 366 days at most), so however far back a
        page lies, only its own days are sorted.
        """
        n, first = limit_of(limit), (max(1, page) - 1) * limit_of(limit)
        chosen = filtered(self.read(as_of, hours), as_of, hours, threat_type, action)
        counts = sorted(chosen.groupBy(F.col("created_at").cast("date").alias("day")).count().collect(), key=lambda r: r.day, reverse=True)
        touched, before, skipped = [], 0, 0
        for r in counts:
            if before + r["count"] > first and before < first + n:
                skipped = before if not touched else skipped
                touched.append(r.day)
            before += r["count"]
        if not touched:
            return chosen.limit(0)
        rows = filtered(self.read(as_of, hours, (touched[-1], touched[0])), as_of, hours, threat_type, action)
        return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(first - skipped).limit(n)

    def mark(self, ids: DataFrame) -> None:
        """Mark the rows with these ids as false positives.  Ids that no row has change nothing."""
        ids.select(F.col("id").cast("long")).distinct().write.mode("append").parquet(self.marks_path)

    def flush(self, as_of: datetime, confirm: str | None, hours: object = None) -> int:
        """Delete rows older than ``hours``, or all; how many went.  Rows without a time are not older.

        Whole days go as folders; only the day of the bound is written anew, beside the old
        one, and takes its place when it is complete.  Run again, a flush ends what one that
        was cut short has begun.
        """
        if confirm != "yes":
            raise PySparkValueError("a flush needs confirm=yes")
        files, place = self._file_system()
        if not self._exists(self.rows_path):
            return 0
        for kind in ("rows", "rollup"):
            for status in files.globStatus(place(f"{self.path}/fresh-{kind}-day=*")):
                target = f"{self.path}/{kind}/{status.getPath().getName().removeprefix(f'fresh-{kind}-')}"
                if self._exists(f"{status.getPath().toString()}/_SUCCESS") and not self._exists(target):
                    files.rename(status.getPath(), place(target))
        if hours is None:
            gone = self.rows().count()
            for path in (self.rows_path, self.marks_path, self.rollup_path):
                files.delete(place(path), True)
            return gone
        cutoff = as_of - timedelta(hours=hours_of(hours))
        old = self.spark.read.schema(SCHEMA + ", day date").parquet(self.rows_path).where(F.col("day") <= F.lit(cutoff.date()))
        before = F.col("created_at") < F.lit(cutoff).cast("timestamp_ntz")
        gone = old.where(before).count()
        bound = f"day={cutoff.date()}"
        # Rows first: the bound's counts are taken from what is left of them.
        for kind in ("rows", "rollup"):
            top = f"{self.path}/{kind}"
            for status in files.globStatus(place(f"{top}/day=*")):
                day = status.getPath().getName().removeprefix("day=")
                if not day.startswith("__") and date.fromisoformat(day) < cutoff.date():
                    files.delete(status.getPath(), True)
            if not self._exists(f"{top}/{bound}"):
                continue
            fresh = f"{self.path}/fresh-{kind}-{bound}"
            if kind == "rows":
                left = old.where(F.col("day") == F.lit(cutoff.date())).where(~before).drop("day")
            else:
                left = self._partials(self.rows_path).where(F.col("day") == F.lit(cutoff.date())).drop("day")
            left.write.mode("overwrite").parquet(fresh)
            files.delete(place(f"{top}/{bound}"), True)
            files.rename(place(fresh), place(f"{top}/{bound}"))
            self.spark.catalog.refreshByPath(top)
        return gone
