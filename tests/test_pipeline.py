import glob
import os

import pytest
from sample import SF_DIR

from cohortspark import session
from cohortspark.config import FEATURE_COLUMNS, QUALIFIED_COLUMNS
from cohortspark.plans import queries
from cohortspark.plans.catalog import order_pipeline
from cohortspark.plans.pipeline import Pipeline, fingerprint
from cohortspark.sources import starschema
from cohortspark.sources.starschema import LATE


@pytest.fixture(scope="module")
def pipeline(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stages"))
    return Pipeline(spark, "t", starschema.LATE, source=lambda: starschema.invoice_lines(spark, SF_DIR), root=root)


def test_stages(pipeline):
    assert pipeline.qualified().columns == QUALIFIED_COLUMNS
    assert pipeline.customers().columns == FEATURE_COLUMNS
    risk = pipeline.risk()
    assert risk.count() == pipeline.customers().count()
    assert {"Churn_Probability", "Risk_Tier", "Retention_Priority"} <= set(risk.columns)


def test_a_stage_is_written_once(pipeline, spark):
    pipeline.customers()
    again = Pipeline(spark, "t", starschema.LATE, source=pipeline.source, root=pipeline.root)
    again.stage = lambda stage, build, *args, **more: Pipeline.stage(again, stage, lambda: 1 / 0, *args, **more)
    assert again.customers().count() == pipeline.customers().count()


def test_a_stored_source_is_not_copied(spark, tmp_path):
    import os

    stored = Pipeline(spark, "t", starschema.LATE, source=lambda: starschema.invoice_lines(spark, SF_DIR), root=str(tmp_path), stored_source=True)
    assert stored.qualified().count() > 0
    assert not os.path.exists(stored.path("raw", False))


def test_unfinished_stage_is_rebuilt(pipeline, spark, tmp_path):
    fresh = Pipeline(spark, "t", starschema.LATE, source=lambda: spark.range(3).toDF("x"), root=str(tmp_path))
    folder = tmp_path / fresh.path("raw", False).removeprefix(f"{tmp_path}/")
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_text("half written")
    assert fresh.raw().count() == 3


def test_windows_have_their_own_tables(spark):
    late, early = order_pipeline(spark, SF_DIR), order_pipeline(spark, SF_DIR, starschema.EARLY)
    assert late.path("customers") != early.path("customers")
    assert late.path("qualified", False) == early.path("qualified", False)


class FakeSession:
    """A session that only knows its settings and its master."""

    def __init__(self, master, **settings):
        self.conf, self.sparkContext = self, self
        self.master, self.applicationId, self.settings = master, "app", settings

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_shared_folder_comes_from_the_session():
    named = FakeSession("yarn", **{"spark.checkpoint.dir": "hdfs://host/shared/"})
    assert session.shared_dir(named) == "hdfs://host/shared"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSession("yarn"))


def test_stages_know_their_source_and_score(spark, raw_lines, tmp_path):
    from cohortspark.config import RETAIL
    from cohortspark.plans.pipeline import Pipeline

    one, two = raw_lines({}), raw_lines({}, {"InvoiceNo": "2"}, {"InvoiceNo": "3"})
    counts = [Pipeline(spark, "same", RETAIL, source=lambda s=s: s, root=str(tmp_path / "root")).qualified().count() for s in (one, two, one)]
    assert counts == [1, 3, 1]
    stored = str(tmp_path / "lines")
    one.write.parquet(stored)
    read = lambda: Pipeline(spark, "files", RETAIL, source=lambda: spark.read.parquet(stored), root=str(tmp_path / "root"))
    assert read().qualified().count() == 1
    two.write.mode("overwrite").parquet(stored)
    assert read().qualified().count() == 3


def test_a_window_skips_files_of_other_dates(spark, lines, tmp_path):
    from cohortspark.plans.pipeline import Pipeline

    days = [f"2011-{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 28)]
    Pipeline._write_by_date(lines(*[{"InvoiceDate": d} for d in days]), str(tmp_path / "q"))
    back = spark.read.parquet(str(tmp_path / "q"))
    ranges = back.selectExpr("_metadata.file_path AS f", "InvoiceDate AS d").groupBy("f").agg({"d": "max"}).count()
    january = back.where("InvoiceDate < timestamp_ntz'2011-02-01 00:00:00'").selectExpr("_metadata.file_path AS f").distinct().count()
    assert ranges > 4 and january <= 2


def test_tasks_are_bounded_by_the_size_of_the_inputs(spark, monkeypatch):
    monkeypatch.setattr(session, "_SCANS", {})
    mine = spark.newSession()
    mine.conf.set(session.SHUFFLE_BYTES, "64MB")
    monkeypatch.setattr(session, "SCAN_BYTES", 1 << 10)
    Pipeline(mine, "bounded", LATE, source=lambda: starschema.invoice_lines(mine, SF_DIR)).path("raw")
    names = ("lineitem", "orders", "part", "supplier", "nation")
    size = sum(os.path.getsize(f"{SF_DIR}/{name}.parquet") for name in names)
    tasks = -(-size // 1024)
    assert tasks > spark.sparkContext.defaultParallelism
    assert mine.conf.get(session.SCAN_TASKS) == str(tasks) and mine.conf.get(session.SHUFFLE_BYTES) == "16m"
    session.bound_tasks(mine, 1)  # a smaller input later leaves the bounds
    assert mine.conf.get(session.SCAN_TASKS) == str(tasks)
    other = spark.newSession()
    other.conf.set(session.SCAN_TASKS, "3")
    other.conf.set(session.SHUFFLE_BYTES, "8m")
    session.bound_tasks(other, 1 << 30)
    assert (other.conf.get(session.SCAN_TASKS), other.conf.get(session.SHUFFLE_BYTES)) == ("3", "8m")


def test_lines_with_breaks_are_written_to_files_of_bounded_size(spark, monkeypatch):
    p = order_pipeline(spark, SF_DIR)
    path = p.path("raw_breaks", with_windows=False)
    found = []
    for size in (64 << 20, fingerprint(p.raw())[1] // 3 + 1):
        monkeypatch.setattr(queries, "FILE_BYTES", size)
        p._tables["raw"] = p.raw().repartition(4) if found else p.raw()
        rows = queries.QUERIES["s1_quoted_line_breaks"](spark, SF_DIR).collect()
        found.append((len(glob.glob(f"{path}/*.csv")), sorted(map(str, rows))))
    p._tables.pop("raw")
    (one, rows), (three, again) = found
    assert (one, three) == (1, 3) and rows == again and len(rows) == p.raw().count()
