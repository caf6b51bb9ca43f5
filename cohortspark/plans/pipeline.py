"""The stages of the pipeline as stored tables, each built once and read by whatever comes after it.

raw lines -> qualified lines -> labelled features -> customer table -> model -> risk table

A stage table is a Parquet folder in the shared directory of the session. Later stages and reports read only
the columns they need from it, and a lost executor costs the running stage, not the ones before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from cohortspark.config import Windows
from cohortspark.operators import checks, cohort, model, weights
from cohortspark.operators.cleaning import clean, line_copies
from cohortspark.operators.features import customer_table, labelled_features
from cohortspark.operators.insights import enrich
from cohortspark.session import bound_tasks, shared_dir
from cohortspark.sources import tables


def fingerprint(frame: DataFrame) -> tuple[str, int]:
    """Tells apart tables by their plan, columns, and the names, sizes and times of the files that they read; and the
    size of these files together."""
    jvm, conf = frame.sparkSession.sparkContext._jvm, frame.sparkSession.sparkContext._jsc.hadoopConfiguration()
    files = set(frame.inputFiles())
    seen, size = [], 0
    for folder in sorted({f.rpartition("/")[0] for f in files}):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        for status in path.getFileSystem(conf).listStatus(path):
            seen.append(f"{status.getPath()}|{status.getLen()}|{status.getModificationTime()}")
            size += status.getLen() if str(status.getPath().toUri()) in files or str(status.getPath()) in files else 0
    facts = [str(frame.semanticHash()), frame.schema.json(), *sorted(files), *sorted(seen)]
    return hashlib.sha1("\n".join(facts).encode()).hexdigest(), size


@dataclass
class Pipeline:
    """Lazily built stage tables for one source and one set of windows.

    `source` gives the raw lines; with `stored_source` they are already a table worth reading again, such as
    Parquet files, and are not copied. With `qualified_source` the cleaning stage is skipped.
    """

    spark: SparkSession
    name: str
    windows: Windows
    source: Callable[[], DataFrame] | None = None
    qualified_source: Callable[[], DataFrame] | None = None
    root: str | None = None
    stored_source: bool = False
    _tables: dict = field(default_factory=dict)

    def path(self, stage: str, with_windows: bool = True) -> str:
        """The stage's folder; its name tells apart sources, their files as they are now, and windows."""
        if "fingerprint" not in self._tables:
            self._tables["fingerprint"], size = fingerprint((self.qualified_source or self.source)())
            bound_tasks(self.spark, size)
        root = self.root or f"{shared_dir(self.spark)}/stages/{self.spark.sparkContext.applicationId}"
        key = f"{self.name}|{self._tables['fingerprint']}" + (f"|{self.windows}" if with_windows else "")
        return f"{root}/{hashlib.sha1(key.encode()).hexdigest()[:12]}/{stage}"

    def stage(self, stage: str, build: Callable[[], DataFrame], read=None, write=None, with_windows=True) -> DataFrame:
        """Read the stage table, writing it on first use in this session."""
        if stage not in self._tables:
            path = self.path(stage, with_windows)
            if not self._exists(path):
                if write:
                    write(build(), path)
                else:
                    build().write.mode("overwrite").parquet(path)
            self._tables[stage] = read(self.spark, path) if read else self.spark.read.parquet(path)
        return self._tables[stage]

    def _exists(self, path: str) -> bool:
        """True for a folder whose write was committed."""
        jvm = self.spark.sparkContext._jvm
        marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return marker.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)

    def raw(self) -> DataFrame:
        if self.source is None:
            raise ValueError(f"{self.name} has no raw lines")
        if self.stored_source:
            return self.source()
        return self.stage("raw", self.source, with_windows=False)

    def copies(self) -> DataFrame:
        """The different filled lines with their counts; what asks for duplicates reads this and shuffles no line."""
        return self.stage("copies", lambda: line_copies(self.raw()), with_windows=False)

    def qualified(self) -> DataFrame:
        build = self.qualified_source or (lambda: clean(self.raw()))
        return self.stage("qualified", build, tables.read_qualified, self._write_by_date, with_windows=False)

    @staticmethod
    def _write_by_date(lines: DataFrame, path: str) -> str:
        """Each file holds a range of dates, in order, so a window skips the others by their statistics."""
        parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tie = [c for c in ("CustomerID", "InvoiceNo") if c in lines.columns]
        ranged = lines.repartitionByRange(parts, "InvoiceDate", *tie).sortWithinPartitions("InvoiceDate")
        return tables.write_qualified(ranged, path)

    def by_customer(self, buckets: int | None = None) -> DataFrame:
        """The qualified lines once more, bucketed by customer and slice of the invoices, beside the layout by date.

        Written with one even shuffle, as a customer with many invoices has many slices; one file a bucket. Joins and
        counts by customer and slice then shuffle no line. There are as many buckets as the session has shuffle
        partitions when nothing else is said.
        """
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        stage, keys = f"by_customer_{buckets}", ("CustomerID", cohort.SLICE)
        table = "lines_" + hashlib.sha1(self.path(stage, False).encode()).hexdigest()[:12]

        def write(lines, path):
            placed = lines.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path)
            placed.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)

        def read(spark, path):
            if not spark.catalog.tableExists(table):  # the files are from another session
                found = spark.read.parquet(path).schema
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found)
                clustered = f"CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {buckets} BUCKETS"
                spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {clustered} LOCATION '{path}'")
            return spark.table(table)

        return self.stage(stage, lambda: cohort.with_slice(self.qualified()), read, write, with_windows=False)

    def labelled(self) -> DataFrame:
        """Features and labels before scoring; stored, as scoring reads it several times."""
        return self.stage("labelled", lambda: labelled_features(self.qualified(), self.windows))

    def customers(self) -> DataFrame:
        """The 17-column customer table, checked before it is handed on."""

        def write(df, path):
            checks.require_no_future_columns(df.columns)
            tables.write_features(df, path)
            checks.require(checks.label_violations(tables.read_features(self.spark, path)))

        return self.stage("customers", lambda: customer_table(self.labelled()), tables.read_features, write)

    def split(self) -> DataFrame:
        """Modelled customers with is_test."""
        return self.stage("split", lambda: model.with_split(model.model_rows(self.customers())))

    def model(self) -> PipelineModel:
        if "model" not in self._tables:
            path = self.path("model")
            if not self._exists(f"{path}/metadata"):
                checks.require_predictors()
                fitted = model.train(self.split().filter("NOT is_test"))
                model.save_model(fitted, path)
            self._tables["model"] = model.load_model(path)
        return self._tables["model"]

    def weights(self) -> DataFrame:
        """The fitted model as a stored table of weights, polished from where the model's fit ended."""
        return self.stage("weights", lambda: weights.fitted(self.split().filter("NOT is_test"), self.model()))

    def risk(self, score: Callable[[DataFrame], DataFrame] | None = None, name: str = "risk") -> DataFrame:
        """Every eligible customer with probability, tier and priority. By default the fitted weights score."""

        by = score or (lambda customers: weights.score(self.weights(), customers))
        if (name, score) not in self._tables:  # another score of the same name has tables of its own
            plan = str(score(self.customers()).semanticHash()) if score else "fitted"
            self._tables[name, score] = f"{name}-{hashlib.sha1(plan.encode()).hexdigest()[:12]}"
        stage = self._tables[name, score]
        return self.stage(stage, lambda: enrich(self.stage(f"{stage}_scored", lambda: by(self.customers()))))
