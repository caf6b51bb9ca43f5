"""CSV files whose quoted values hold line breaks, read by many tasks.

Where a block of a file begins, a task cannot know whether it stands inside quotes. A first pass scans the lines that
have a quote, from both states: in which state does a block end if it begins outside, and if it begins inside? Putting
these together in the order of a file's blocks gives the state at the start of each, a few numbers for each block. If
no value holds a line break, the usual reader takes the files. Otherwise blocks without breaks are read line by line,
and in the others a second pass puts the lines of a record together; the pieces of a record that lies across blocks
are joined afterwards. Only pieces are ever shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.session import stored

WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3  # a record; its end, its beginning, or a block in the midst of one
OPTIONS = {"escape": '"'}


def scanner():
    """A function of a line and of the state before it, inside quotes or not, that gives the state after it.

    Quotes count at the start of a field only; doubled quotes inside are text, as is a quote within a plain field.
    """
    field = r'(?:"(?:[^"]|"")*+"[^,]*+|(?!")[^,]*+)'
    outside = re.compile(rf"{field}(?:,{field})*+", re.DOTALL).fullmatch
    inside = re.compile(rf'(?:[^"]|"")*+"[^,]*+(?:,{field})*+', re.DOTALL).fullmatch

    def after(line: str, is_open: bool) -> bool:
        if '"' not in line:
            return is_open
        return not (inside if is_open else outside)(line)

    return after


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): the lines of the files, with the block that each lies in."""
    found = spark.read.option("lineSep", "\n").text(path)
    return found.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _scanned(lines: DataFrame) -> DataFrame:
    """(file, start, from_outside, from_inside, calm) of each block with a quote; calm: no line ends inside quotes."""
    scan = scanner()

    def run(batches):
        last, state = None, None
        for batch in batches:
            for value, file, start in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, start) != last:
                    if last is not None:
                        yield row(last, state)
                    last, state = (file, start), [False, True, True]
                state[0], state[1] = scan(value, state[0]), scan(value, state[1])
                state[2] = state[2] and not state[0]
        if last is not None:
            yield row(last, state)

    def row(block, state):
        return pa.RecordBatch.from_pylist([dict(zip(names, (*block, *state)))], schema=kinds)

    names = ["file", "start", "from_outside", "from_inside", "calm"]
    kinds = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()])))
    schema = "file string, start bigint, from_outside boolean, from_inside boolean, calm boolean"
    return lines.where(F.col("value").contains('"')).mapInArrow(run, schema)


def _with_states(blocks: DataFrame) -> DataFrame:
    """Adds `open` and `open_after`: whether each block begins and ends inside quotes. One row a block is sorted.

    A block keeps the state, turns it round, or fixes it whatever it was. The state before a block is the one last
    fixed, turned round as often as blocks since have done so.
    """
    order = Window.partitionBy("file").orderBy("start")
    before, through = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    fixes, turns = F.col("from_outside") == F.col("from_inside"), (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    counted = blocks.withColumn("turned", F.sum(turns).over(through))
    base = F.coalesce(F.last(F.when(fixes, F.col("from_outside")), True).over(before), F.lit(False))
    since = F.coalesce(F.sum(turns).over(before), F.lit(0)) - F.coalesce(F.last(F.when(fixes, F.col("turned")), True).over(before), F.lit(0))
    found = counted.withColumn("open", base != (since % 2 == 1)).drop("turned")
    return found.withColumn("open_after", F.when(F.col("open"), F.col("from_inside")).otherwise(F.col("from_outside")))


def _records(lines: DataFrame) -> DataFrame:
    """(file, start, kind, record) of lines (value, file, start, open), put together inside each block."""
    scan = scanner()
    whole, head, tail, middle = WHOLE, HEAD, TAIL, MIDDLE
    names = ["file", "start", "kind", "record"]

    def run(batches):
        last, is_open, leading, held = None, False, False, []
        for batch in batches:
            out = []
            for value, file, start, begins_open in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, start) != last:
                    if held:
                        out.append((*last, middle if leading else tail, "\n".join(held)))
                    last, is_open, leading, held = (file, start), begins_open, begins_open, []
                is_open = scan(value, is_open)
                held.append(value)
                if not is_open:
                    out.append((*last, head if leading else whole, "\n".join(held)))
                    leading, held = False, []
            yield made(out)
        if held:
            yield made([(*last, middle if leading else tail, "\n".join(held))])

    def made(rows):
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
        columns = zip(*rows) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return lines.select("value", "file", "start", "open").mapInArrow(run, "file string, start bigint, kind int, record string")


def _joined(pieces: DataFrame) -> DataFrame:
    """(record): pieces of records across blocks put together; each beginning opens a record of its own."""
    place = Window.partitionBy("file").orderBy("start", F.col("kind") == TAIL)
    numbered = pieces.withColumn("n", F.sum((F.col("kind") == TAIL).cast("int")).over(place))
    parts = F.sort_array(F.collect_list(F.struct("start", (F.col("kind") == TAIL).alias("last"), "record")))
    return numbered.groupBy("file", "n").agg(F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record")).select("record")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The columns of CSV files with a header, as text. Values may hold quoted line breaks, anywhere in a file.

    All files have the same header. A file that ends inside quotes is an error, as its last record is torn. Blocks
    inside quotes or with breaks are listed to all tasks: at most one row for each block of the files.
    """
    usual = spark.read.option("header", True).option("inferSchema", False).options(**OPTIONS).csv(path)
    lines = text_lines(spark, path)
    scanned = stored(_scanned(lines), "csv-blocks")
    if scanned.where("not calm").isEmpty():
        return usual
    every = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("lines"))
    blocks = every.join(scanned, ["file", "start"], "left").na.fill({"from_outside": False, "from_inside": True, "calm": True})
    blocks = stored(_with_states(blocks), "csv-states")
    ends = blocks.groupBy("file").agg(F.max_by("open_after", "start").alias("torn")).where("torn")
    if torn := ends.first():
        raise ValueError(f"a quoted value is never closed: '{torn['file']}'")
    rough = F.broadcast(blocks.where("open or not calm").select("file", "start", "open"))
    edges = F.broadcast(blocks.where("open or open_after").select("file", "start", "open"))
    # What is no record becomes null instead of being filtered: a caller's filter on a converted column may be moved
    # below a filter or an anti join, and would then fail on half a record.
    plain = lines.join(rough, ["file", "start"], "left").select("start", F.when(F.col("open").isNull(), F.col("value")).alias("record"))
    put = _records(lines.join(rough, ["file", "start"])).select("start", F.when(F.col("kind") == WHOLE, F.col("record")).alias("record"))
    across = _joined(_records(lines.join(edges, ["file", "start"])).where(F.col("kind") != WHOLE)).select(F.lit(-1).cast("bigint").alias("start"), "record")
    records = plain.unionByName(put).unionByName(across).withColumn("record", F.regexp_replace("record", "\r$", ""))
    header = lines.where("start = 0").first()["value"].rstrip("\r")
    is_record = (F.trim("record") != "") & ~((F.col("start") == 0) & (F.col("record") == header))
    kept = records.select(F.when(is_record, F.col("record")).alias("record")).where("record is not null")
    schema = ", ".join(f"`{c.replace('`', '``')}` STRING" for c in usual.columns)
    return kept.select(F.from_csv("record", schema, OPTIONS).alias("r")).select("r.*")
