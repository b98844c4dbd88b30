"""Parquet tables of a review library.

Every write is a new generation, so a reader never sees a half-written table.  Small
keyed tables are written whole.  Stored findings and places are appended: each upload is a
generation with the rows of its reports only, and a small table of holders says which
generation holds a report now.  Rows of given reports are read from their generations alone.

A writer claims the number after the generation it has read by creating a marker file,
which only one can do; another writer's generation is never overwritten or left out of
sight, the slower one fails and reads again.  A claim whose writer has died without a
finished generation expires: the next writer marks it void and takes the number after it,
and the first one, should it only have been slow, finds its claim void and fails.

Creating a file that must not exist is atomic on HDFS and on local file systems; on object
stores it is only where their Hadoop client makes it so (conditional writes).
"""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators import durable, merging
from marginalia.operators.joins import lookup_join
from marginalia.sources.portable import LONGS

TEXTS = "checker string, field_name string, original string, proposed string"
EXTRA = {
    "learned_terms": "term string",
    "active_rules": "suggestion_id string",
    "finding_generations": "report_id string, generation long",
    "places": f"core_key string, report_id string, report_name string, n long, first struct<{TEXTS}>",
    "place_generations": "report_id string, generation long, report_name string, findings long",
    "evidence": (
        "core_key string, checker string, field string, original string, proposed string, status string, "
        "comment string, human_decisions long, human_reports long, occurrences long, course_coverage long, "
        "reviewed_sources string, seen_in_reports string"
    ),
    "learned_from": "place_generations long, evidence long, observations long",
}
EXPIRES = 6 * 3600
"""Seconds after which a claim without a finished generation belongs to a dead writer."""

FINDINGS, HOLDERS = "report_findings", "finding_generations"


class StoreConflict(RuntimeError):
    """Another writer has changed the table since it was read."""


class Store:
    def __init__(self, spark: SparkSession, base: str, expires: float = EXPIRES):
        self.spark, self.base, self.expires = spark, base.rstrip("/"), expires
        self._seen: dict[str, int] = {}

    # -- layout
    def _schema(self, name: str) -> T.StructType:
        if name in EXTRA:
            return T.StructType.fromDDL(EXTRA[name])
        return T.StructType([
            T.StructField(f, T.LongType() if f in LONGS else T.StringType())
            for f in merging.COLLECTIONS[name][0]
        ])

    def _empty(self, name: str) -> DataFrame:
        """No rows, known as such to the optimizer."""
        columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._schema(name).fields]
        return self.spark.range(1).select(*columns).limit(0)

    def _files(self, path: str):
        """The file system and Hadoop path of a path."""
        context = self.spark.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(context._jsc.hadoopConfiguration()), hadoop

    def _found(self, pattern: str) -> list[str]:
        """Paths that match, in name order."""
        files, path = self._files(pattern)
        return sorted(s.getPath().toString() for s in files.globStatus(path) or [])

    def _generations(self, name: str) -> dict[int, str]:
        """Complete generations by number, oldest first."""
        done = [p.rsplit("/", 1)[0] for p in self._found(f"{self.base}/{name}/gen-*/_SUCCESS")]
        return {int(p.rsplit("-", 1)[1]): p for p in done}

    def _latest(self, name: str) -> int:
        return max(self._generations(name), default=-1)

    def _append(self, name: str, rows: DataFrame) -> int:
        """Write rows as the generation after the one that was read; its number.

        Raises ``StoreConflict`` if that number is taken.  A write that fails gives its
        number back.
        """
        number = self._claimed(name, self._seen.get(name, self._latest(name)) + 1)
        path = f"{self.base}/{name}/gen-{number:08d}"
        files, generation = self._files(path)
        try:
            rows.select(*self._schema(name).names).write.mode("errorifexists").parquet(path)
        except Exception:
            files.delete(generation, True)
            if not self._void(name, number):
                files.delete(self._marker(name, number)[1], False)
            raise
        if self._void(name, number):
            files.delete(generation, True)
            raise StoreConflict(f"{name}: the claim on generation {number} has expired")
        self._seen[name] = number
        return number

    def _marker(self, name: str, number: int, kind: str = "claim"):
        return self._files(f"{self.base}/{name}/{kind}-{number:08d}")

    def _void(self, name: str, number: int) -> bool:
        files, marker = self._marker(name, number, "void")
        return files.exists(marker)

    def _create(self, name: str, number: int, kind: str = "claim") -> bool:
        """Whether this call has made the marker; it says who did."""
        files, marker = self._marker(name, number, kind)
        try:
            out = files.create(marker, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise
        out.write(bytearray(self.spark.sparkContext.applicationId.encode()))
        out.close()
        return True

    def _claimed(self, name: str, number: int) -> int:
        """The number given, or the first after it if dead writers hold it and those between."""
        while not self._create(name, number):
            if number in self._generations(name):
                raise StoreConflict(f"{name}: generation {number} belongs to another writer")
            if not self._void(name, number):
                files, marker = self._marker(name, number)
                age = time.time() - files.getFileStatus(marker).getModificationTime() / 1000
                if age < self.expires:
                    raise StoreConflict(f"{name}: generation {number} is being written, its claim is {age:.0f} s old")
                self._create(name, number, "void")
            number += 1
        return number

    # -- keyed tables
    def read(self, name: str) -> DataFrame:
        if name == FINDINGS:
            return self.held(name, self.read(HOLDERS))
        self._seen[name] = self._latest(name)
        return self.read_at(name, self._seen[name])

    def generation(self, name: str) -> int:
        """The generation that the last read or write has seen, -1 without any."""
        return self._seen[name]

    def read_at(self, name: str, number: int) -> DataFrame:
        """A whole table as this generation holds it; number -1 is before the first."""
        if number < 0:
            return self._empty(name)
        return self.spark.read.schema(self._schema(name)).parquet(f"{self.base}/{name}/gen-{number:08d}")

    def holds(self, name: str, number: int) -> bool:
        """Whether a generation is still there."""
        return number < 0 or number in self._generations(name)

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a whole table as its next generation and read it back."""
        self._append(name, rows)
        return self.read(name)

    # -- rows by report and generation
    def held(self, name: str, holders: DataFrame) -> DataFrame:
        """The rows of the reports that ``holders`` lists, each from the generation named there.

        Only these generations are read.
        """
        schema, generations = self._schema(name), self._generations(name)
        holders = holders.select("report_id", "generation")
        used = [r["generation"] for r in holders.select("generation").distinct().collect()]  # at most the uploads
        if not used:
            return self._empty(name)
        rows = self.spark.read.schema(schema).parquet(*[generations[g] for g in used])
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/gen-(\d+)/", 1).cast("bigint")
        rows = rows.withColumn("generation", number)
        return lookup_join(rows, holders, ["report_id", "generation"], "inner").select(*schema.names)

    def findings_of(self, reports: DataFrame) -> DataFrame:
        """The findings of some reports; generations that hold none of them are not read."""
        ids = reports.select("report_id").distinct()
        return self.held(FINDINGS, self.read(HOLDERS).join(ids, "report_id", "left_semi"))

    def append(self, name: str, rows: DataFrame) -> int:
        """Write rows as the generation after the latest, whatever was read; its number.

        For tables in which another one tells the generations that count.
        """
        self._seen.pop(name, None)
        return self._append(name, rows)

    def store_findings(self, incoming: DataFrame) -> DataFrame:
        """Replace all findings of the reports in ``incoming``, which come back as stored.

        Nothing else is written.  All reports change in one step, that of the holders.
        """
        holders = self.read(HOLDERS)
        fresh = durable.stored(incoming.select(*self._schema(FINDINGS).names), "incoming")
        number = self.append(FINDINGS, fresh)
        here = fresh.select("report_id").distinct().withColumn("generation", F.lit(number).cast("bigint"))
        here = durable.stored(here, "holders")
        self._append(HOLDERS, merging.upsert(holders, here, ["report_id"]))
        return self.held(FINDINGS, here)

    def compact(self) -> DataFrame:
        """Write the current findings as one generation; earlier ones are read no more."""
        return self.store_findings(self.read(FINDINGS))
