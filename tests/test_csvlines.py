import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspark.sources import csvlines

SMALL = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "4"}


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few bytes, so that records lie across them."""
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(path, rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    path.write_bytes(out.getvalue().encode())


def by_one_task(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_many_tasks_read_what_one_reads(small_blocks, tmp_path):
    some = random.Random(8)
    texts = ["plain", "a\nb", 'say ""', '"x"\n\n"y"', "c,d\n,e", "long " * 60 + "\n" + "tail " * 60, "", " ", "\n", "é\nü"]
    for name in ("a.csv", "b.csv"):
        rows = [["id", "text", "more"], *[[i, some.choice(texts), some.choice(texts)] for i in range(150)]]
        written(tmp_path / name, rows)
    found = csvlines.read_csv(small_blocks, str(tmp_path))
    assert csvlines.text_lines(small_blocks, str(tmp_path)).rdd.getNumPartitions() > 20
    assert found.columns == ["id", "text", "more"]
    assert rows_of(found) == rows_of(by_one_task(small_blocks, str(tmp_path)))


def test_a_value_over_many_blocks_without_a_quote(small_blocks, tmp_path):
    written(tmp_path / "a.csv", [["id", "text"], [1, "line\n" * 600], [2, "x"], [3, "y\nz"]])
    found = csvlines.read_csv(small_blocks, str(tmp_path))
    assert rows_of(found) == [("1", "line\n" * 600), ("2", "x"), ("3", "y\nz")]


def test_files_without_breaks_keep_the_usual_plan(small_blocks, tmp_path):
    written(tmp_path / "a.csv", [["id", "text"], [1, 'a "quoted", word'], [2, 'six" wide']])
    found = csvlines.read_csv(small_blocks, str(tmp_path))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows_of(found) == [("1", 'a "quoted", word'), ("2", 'six" wide')]


def test_a_quote_inside_a_plain_value_opens_nothing(small_blocks, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,six" wide\n2,"two\nlines"\n3,five" wide\n')
    found = csvlines.read_csv(small_blocks, str(tmp_path))
    assert rows_of(found) == [("1", 'six" wide'), ("2", "two\nlines"), ("3", 'five" wide')]


def test_a_torn_record_is_an_error(small_blocks, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"never\nclosed\n2,x\n')
    with pytest.raises(ValueError, match="never closed"):
        csvlines.read_csv(small_blocks, str(tmp_path))


def test_carriage_returns_end_lines(small_blocks, tmp_path):
    written(tmp_path / "a.csv", [["id", "text"], [1, "a\nb"], [2, "c"]], end="\r\n")
    assert rows_of(csvlines.read_csv(small_blocks, str(tmp_path))) == [("1", "a\nb"), ("2", "c")]


def test_a_header_alone(small_blocks, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n")
    found = csvlines.read_csv(small_blocks, str(tmp_path))
    assert found.columns == ["id", "text"] and found.count() == 0


@given(st.lists(st.lists(st.text('a",\n', max_size=6), min_size=2, max_size=3), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_the_scan_knows_where_records_end(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    after, is_open, ends = csvlines.scanner(), False, 0
    for line in out.getvalue().split("\n")[:-1]:
        is_open = after(line, is_open)
        ends += not is_open
    assert not is_open and ends == len(rows)
