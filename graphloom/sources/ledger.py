"""Numbered states in a shared folder: which version of a table readers see, and how far a run has come.

A state is a small JSON file with a number. The next one is written beside it and renamed to the next number, which
fails if another writer was there first: so each state follows the one it was made from, and readers see a
whole state or the one before. Nothing is overwritten. All files are reached by Spark's own file systems.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer made a state meanwhile."""


class Log:
    """The states under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def numbers(self) -> list[int]:
        if not self._files.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(""))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        opened = self._files.open(self._path(f"{number:012d}.json"))
        try:
            return json.loads(bytes(opened.readAllBytes()))
        finally:
            opened.close()

    def latest(self) -> tuple[int, dict | None]:
        """Number and content of the last state; -1 and none before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, None)

    def append(self, after: int, state: dict) -> int:
        """Writes the state that follows state ``after``; raises ``Conflict`` if there is one already."""
        written = self._path(f".{uuid.uuid4().hex}.tmp")
        out = self._files.create(written, False)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(written.toUri() if written.toUri().getScheme() else self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._files.makeQualified(written), self._files.makeQualified(self._path(f"{after + 1:012d}.json")), how)
        except Exception as error:  # the file systems' own kinds of it differ
            self._files.delete(written, False)
            if after + 1 in self.numbers():
                raise Conflict(f"state {after + 1} exists") from error
            raise
        return after + 1


# ---------------------------------------------------------------- versions of a table


class Rejected(Exception):
    """A version that readers must not see."""


class Published:
    """Versions of a table under ``folder`` and the pointer to the one that is read."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = Log(spark, f"{self.folder}/pointer")

    def publish(self, rows: DataFrame, least_rows: int = 1, new_schema: bool = False, check: Callable[[DataFrame], None] | None = None, expected: str | None = None) -> str:
        """Writes a version, checks it and flips the pointer to it; returns the version.

        What is read back must have the rows that were written, counted while they were, at least ``least_rows`` and,
        unless ``new_schema``, the columns of the version before. ``check`` may raise. If ``expected`` is given, the
        pointer must still be at that version. A version that fails stays unseen.
        """
        number, before = self.log.latest()
        if expected is not None and (before or {}).get("version") != expected:
            raise Conflict(f"readers see {(before or {}).get('version')}, not {expected}")
        version = f"v{number + 1}-{uuid.uuid4().hex[:12]}"
        path, seen = f"{self.folder}/versions/{version}", Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").option("parquet.block.row.count.limit", 122_880).parquet(path)
        back = self.spark.read.schema(rows.schema).parquet(path)
        found, counted = back.count(), seen.get["rows"]
        if found != counted or found < least_rows:
            raise Rejected(f"{found} rows read of {counted} written, {least_rows} at least")
        columns = [[f.name, f.dataType.simpleString()] for f in rows.schema.fields]
        if before and not new_schema and before["columns"] != columns:
            raise Rejected(f"columns {columns} after {before['columns']}")
        if check:
            check(back)
        state = {"version": version, "rows": found, "columns": columns, "schema": rows.schema.json(), "previous": (before or {}).get("version"), "at": datetime.now(UTC).isoformat()}
        self.log.append(number, state)
        return version

    def state(self, version: str | None = None) -> dict:
        """What is known of a version, by default of the one that readers see."""
        for number in reversed(self.log.numbers()):
            state = self.log.read(number)
            if version is None or state["version"] == version:
                return state
        raise LookupError(f"no version {version or ''} in {self.folder}")

    def read(self, version: str | None = None) -> DataFrame:
        """The rows of one version; a later flip doesn't change what is read."""
        state = self.state(version)
        return self.spark.read.schema(StructType.fromJson(json.loads(state["schema"]))).parquet(f"{self.folder}/versions/{state['version']}")

    def rollback(self) -> str:
        """Flips the pointer back to the version before; returns it."""
        number, now = self.log.latest()
        if not now or not now["previous"]:
            raise LookupError("no version before")
        self.log.append(number, {**self.state(now["previous"]), "at": datetime.now(UTC).isoformat()})
        return now["previous"]


# ---------------------------------------------------------------- runs


class AlreadyPublished(Exception):
    """The release was loaded and published."""


class InProgress(Exception):
    """An unfinished run has to be resumed first."""


class PlanDrift(Exception):
    """What is left of the plan is not what the run began with."""


class Aborted(Exception):
    """An operator asked for the run to end."""


ENDED = ("published", "failed", "aborted")
#: What of a plan has to stay the same for what is left to load, of the plan, its families and their files.
_OF_PLAN = ("schema_version", "source_code", "release_tag", "release_checksum", "source_published_at")
_OF_FAMILY = ("family", "source_datasets", "target_tables")
_OF_FILE = ("dataset", "byte_count", "content_kind")


def plan_digest(plan: dict, loaded: list[str]) -> str:
    """Digest of a plan over the families that are not loaded yet."""
    pick = lambda d, names: {n: d.get(n) for n in names}
    left = [pick(f, _OF_FAMILY) | {"files": [pick(x, _OF_FILE) for x in f.get("files", [])]} for f in plan.get("families", []) if f["family"] not in loaded]
    return hashlib.sha256(json.dumps(pick(plan, _OF_PLAN) | {"families": left}, sort_keys=True, default=str).encode()).hexdigest()


class Run:
    """One run over the families of a release; every step is a state of the release's log."""

    def __init__(self, log: Log, number: int, state: dict) -> None:
        self.log, self.number, self.state = log, number, state

    @staticmethod
    def open(spark: SparkSession, folder: str, plan: dict, force_new: bool = False) -> Run:
        """Opens a run for the plan's release, or takes up the unfinished one at its first family that is not loaded."""
        log = Log(spark, f"{folder.rstrip('/')}/{plan['source_code']}-{plan['release_tag']}")
        number, state = log.latest()
        if state:
            if state["status"] == "published" and not force_new:
                raise AlreadyPublished(f"{plan['source_code']}:{plan['release_tag']}")
            if force_new and state["status"] not in ENDED:
                raise InProgress(state["run"])
            if state["status"] != "published" and not force_new:
                if plan_digest(state["plan"], state["loaded"]) != plan_digest(plan, state["loaded"]):
                    raise PlanDrift(f"{plan['source_code']}:{plan['release_tag']}")
                run = Run(log, number, state)
                run.heed()
                return run._next(plan=plan, error=None, requested=None, status=state["status"] if state["status"] not in ENDED else "started")
        new = {"run": uuid.uuid4().hex, "status": "started", "loaded": [], "plan": plan, "error": None, "requested": None, "began": datetime.now(UTC).isoformat()}
        return Run(log, log.append(number, new), new)

    def _next(self, **changes) -> Run:
        state = self.state | changes
        self.number, self.state = self.log.append(self.number, state), state
        return self

    def heed(self) -> None:
        """Ends the run if an operator asked for it meanwhile."""
        self.number, self.state = self.log.latest()
        if self.state["requested"] == "abort" and self.state["status"] not in ("failed", "aborted"):
            self._next(status="aborted", error="abort was requested")
            raise Aborted(self.state["run"])

    def load(self, each: Callable[[dict], None]) -> Run:
        """Loads the families that are left, in the plan's order, and publishes the run; an error ends it as failed."""
        for family in self.state["plan"]["families"]:
            self.heed()
            if family["family"] in self.state["loaded"]:
                continue
            self._next(status="loading")
            try:
                each(family)
            except Exception as error:
                self._next(status="failed", error=str(error)[:500])
                raise
            self._next(loaded=[*self.state["loaded"], family["family"]])
        return self._next(status="published")


def request_abort(spark: SparkSession, folder: str, release: str) -> None:
    """Asks the unfinished run of a release (source-tag) to end before its next family."""
    log = Log(spark, f"{folder.rstrip('/')}/{release}")
    number, state = log.latest()
    if state and state["status"] not in ENDED:
        log.append(number, state | {"requested": "abort"})


def ledger(spark: SparkSession, folder: str, release: str) -> DataFrame:
    """number, run, status, loaded (how many families), error of every state of a release."""
    log = Log(spark, f"{folder.rstrip('/')}/{release}")
    rows = [(n, s["run"], s["status"], len(s["loaded"]), s["error"]) for n in log.numbers() for s in (log.read(n),)]
    return spark.createDataFrame(rows, "number long, run string, status string, loaded long, error string")
