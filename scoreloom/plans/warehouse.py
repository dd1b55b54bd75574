"""One load, end to end: staging, star tables and marts, written once and read many times.

Tables go to a folder of their own below the one that the cluster names in
spark.checkpoint.dir, so a lost executor costs only the running stage and every
statement reads narrow columnar files instead of repeating the load. Once all
tables are complete the load can be opened by its path in any later session.
Without a shared folder a load is an error; only a session that runs in one
process falls back to a temporary folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom import schemas
from scoreloom.plans import etl, marts, quality, sessions
from scoreloom.sources.scratch import COMPRESSION
from scoreloom.sources.scratch import folder as shared_folder

TABLES = [
    "staging", "subjects", "institutions", "institution_lookup", "participants", "exam_results", "person_days",
    "student_academic_profiles",
]

FINISHED = "finished"


class QualityError(ValueError):
    """A load broke an integrity rule."""


class Warehouse:
    """The tables of one load. Each is built on first use."""

    def __init__(self, spark: SparkSession, staging: Callable[[], DataFrame], folder: str | None = None):
        self.spark = spark
        self.path = f"{folder or shared_folder(spark)}/scoreloom-load-{uuid.uuid4().hex}"
        self._builders: dict[str, Callable[[], DataFrame]] = {
            "staging": staging,
            "subjects": lambda: schemas.subjects_df(spark),
            "institutions": lambda: etl.institutions(self["staging"]),
            "institution_lookup": lambda: etl.resolve_institutions(self["staging"], self["institutions"]),
            "participants": lambda: etl.participants(self["staging"], self["institutions"], self["institution_lookup"]),
            "exam_results": lambda: etl.exam_results(self["staging"]),
            "person_days": lambda: sessions.person_days(self["exam_results"], self["participants"]),
            "student_academic_profiles": lambda: marts.student_profiles(
                self["exam_results"], self["participants"], self["institutions"]
            ),
        }
        self._tables: dict[str, DataFrame] = {}
        self._paths: dict[str, str] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Warehouse:
        """A finished load of this or another session, read from its path; nothing is written."""
        load = cls.__new__(cls)
        load.spark, load.path, load._builders = spark, path, {}
        load._paths = {r.table_name: r.path for r in spark.read.parquet(f"{path}/{FINISHED}").collect()}  # one row per table
        load._tables = {name: spark.read.parquet(f"{path}/{part}") for name, part in load._paths.items()}
        return load

    def finish(self) -> str:
        """Build what is missing and note that the load is complete; returns the path to open it by."""
        for name in TABLES:
            self[name]
        rows = [(name, self._paths[name]) for name in TABLES]
        self.spark.createDataFrame(rows, "table_name string, path string").coalesce(1).write.parquet(f"{self.path}/{FINISHED}")
        return self.path

    def add(self, name: str, build: Callable[[], DataFrame]) -> None:
        """A further table, built on first use like those of the load."""
        self._builders[name] = build

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._written(name, self._builders[name]())
        return self._tables[name]

    def _written(self, name: str, df: DataFrame) -> DataFrame:
        part = f"{name}-{uuid.uuid4().hex}"  # a retry after a failed write must not meet its leftovers
        df.write.parquet(f"{self.path}/{part}", compression=COMPRESSION)
        self._paths[name] = part
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{part}")

    def fresh_path(self, label: str) -> str:
        """A new path beside the tables of this load."""
        return f"{self.path}/{label}-{uuid.uuid4().hex}"

    @property
    def star(self) -> dict[str, DataFrame]:
        return {name: self[name] for name in schemas.PRIMARY_KEYS}

    def clean_exam_results(self) -> DataFrame:
        return marts.clean_exam_results(self["exam_results"], self["participants"], self["institutions"])

    def register_views(self) -> None:
        """Make the star tables and both marts available to SQL."""
        for name, df in self.star.items():
            df.createOrReplaceTempView(name)
        self.clean_exam_results().createOrReplaceTempView("clean_exam_results")
        self["student_academic_profiles"].select(*marts.PROFILE_COLUMNS).createOrReplaceTempView(
            "student_academic_profiles"
        )

    def check(self) -> DataFrame:
        """All integrity rules that were broken; empty for a sound load."""
        reports = [
            quality.unique_report(self.star).select("table_name", "rule", "violations"),
            quality.foreign_key_report(self.star),
            quality.not_null_report(self.star).select("table_name", "rule", "violations"),
            quality.domain_report(self.star, self["staging"]).select("table_name", "rule", "violations"),
        ]
        broken = reports[0]
        for report in reports[1:]:
            broken = broken.unionByName(report)
        return broken.filter(F.col("violations") > 0)

    def publish(self) -> Warehouse:
        """Build the star tables, check them, and register the views; raise if a rule is broken."""
        broken = [f"{r.table_name}: {r.rule} ({r.violations})" for r in self.check().collect()]
        if broken:
            raise QualityError("; ".join(broken))
        self.register_views()
        return self
