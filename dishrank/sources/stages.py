"""Stages that a later run finds finished.

A stage is named by a digest of how its rows are made: the plan, with the numbers Spark
gives to columns counted anew, and the names, sizes and times of all files it reads. A run
that comes to a finished stage reads it; a job that died is started again and goes on
from its last finished stage, in the same application or in another one. A changed input
or plan has another digest and so makes a new stage.

Code of Python functions is not part of a plan; ``release`` tells one state of such code
from the next.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, list_names, shared_root, work_path
from .sinks import stage_roundtrip
from .versions import current_version, switch_to

# Settings that change what a plan gives.
SETTINGS = ["spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.caseSensitive", "spark.sql.legacy.timeParserPolicy"]
# Columns, variables of lambda functions, common tables: Spark counts them over the whole application.
_NUMBERS = re.compile(r"#\d+|(?<=lambda )\w+_\d+|(?<=CTERelationDef )\d+|(?<=CTERelationRef )\d+|plan_id=\d+")

# Stage step of a job: rows and a name give the rows to go on with.
Stage = Callable[[DataFrame, str], DataFrame]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written inside are removed as soon as it is complete."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def fresh(rows: DataFrame, name: str) -> DataFrame:
    """A stage in a folder of its own, written by every run."""
    with shuffles_dropped(rows.sparkSession):
        return stage_roundtrip(rows, work_path(rows.sparkSession, name))


def _plans(plan) -> Iterator:
    yield plan
    inner = plan.subqueriesAll()
    for i in range(inner.size()):
        yield from _plans(inner.apply(i))


def plan_text(rows: DataFrame) -> str:
    """The analysed plan with columns numbered by their first appearance."""
    spark, fields = rows.sparkSession, "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(fields, None)
    spark.conf.set(fields, str(1 << 30))
    try:
        text = rows._jdf.queryExecution().analyzed().toString()
    finally:
        if before is None:
            spark.conf.unset(fields)
        else:
            spark.conf.set(fields, before)
    known: dict[str, str] = {}
    return _NUMBERS.sub(lambda m: known.setdefault(m.group(), f"#{len(known)}"), text)


def sources(rows: DataFrame) -> tuple[list[list[str]], list[str]]:
    """Root paths of each file source of a plan, and the contents of its local tables.

    Other sources (rows handed over from Python, tables of other systems) have no name
    that would tell a changed content; they are refused.
    """
    roots, local = [], []
    for plan in _plans(rows._jdf.queryExecution().analyzed()):
        leaves = plan.collectLeaves()
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            kind = leaf.getClass().getSimpleName()
            if kind == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
                paths = leaf.relation().location().rootPaths()
                roots.append([paths.apply(k).toString() for k in range(paths.size())])
            elif kind == "LocalRelation":
                local.append(leaf.data().mkString("\n"))
            elif kind not in ("OneRowRelation", "OneRowRelation$", "Range", "CTERelationRef"):
                raise ValueError(f"rows of {kind} have no name to find a stage by; write them first")
    return roots, local


def files_digest(spark: SparkSession, roots: list[str]) -> str:
    """Digest of the names, sizes and times of all files below some paths.

    Spark lists the files; no content is read, and one row comes back.
    """
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    # Files are dealt to tasks by their bytes, of which none are read here.
    spark.conf.set(size, str(1 << 40))
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
        facts = ["path", "length", F.unix_micros("modificationTime")]
        found = files.select(*[F.xxhash64(F.lit(salt), *facts).alias(f"h{salt}") for salt in (0, 1)]).agg(
            F.count(F.lit(1)), F.bit_xor("h0"), F.bit_xor("h1")
        ).first()
    finally:
        spark.conf.set(size, before)
    return ",".join(map(str, found))


class Stages:
    """Finished stages below ``root``, by default in the shared work folder.

    An instance is a stage step: ``stages(rows, "mentions")`` gives the rows from where
    they were written, now or by an earlier run.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, release: str = ""):
        self.spark = spark
        self.root = (root or f"{shared_root(spark)}/stages").rstrip("/")
        self.release = release
        self.used: list[str] = []
        self.written: list[str] = []
        self._files: dict[tuple[str, ...], str] = {}

    def digest(self, rows: DataFrame) -> str:
        roots, local = sources(rows)
        facts = [self.release, self.spark.version, plan_text(rows), rows.schema.json(), *local]
        facts += [f"{name}={self.spark.conf.get(name)}" for name in SETTINGS]
        for paths in roots:
            key = tuple(paths)
            # Finished stages never change, so what one run has listed holds for all of it.
            if key not in self._files or not paths[0].startswith(self.root):
                self._files[key] = files_digest(self.spark, paths)
            facts.append(self._files[key])
        return hashlib.sha256("\x00".join(facts).encode()).hexdigest()[:32]

    def __call__(self, rows: DataFrame, name: str) -> DataFrame:
        stage = f"{name}-{self.digest(rows)}"
        path = f"{self.root}/{stage}"
        attempt = current_version(self.spark, path)
        if attempt is None:
            # An attempt that dies leaves a folder nobody points to; runs beside each other have one each.
            attempt = uuid.uuid4().hex
            with shuffles_dropped(self.spark):
                rows.write.parquet(f"{path}/data/{attempt}")
            switch_to(self.spark, path, attempt)
            self.written.append(stage)
        self.used.append(stage)
        return self.spark.read.schema(rows.schema).parquet(f"{path}/data/{attempt}")

    def sweep(self) -> None:
        """Delete the stages that this run neither read nor wrote."""
        for stage in list_names(self.spark, self.root):
            if stage not in self.used:
                delete_path(self.spark, f"{self.root}/{stage}")
