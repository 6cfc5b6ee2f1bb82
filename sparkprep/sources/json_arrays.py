"""S4 at scale: one JSON array of records, however long, read by many tasks.

Spark's text source cuts a file into byte ranges and deals its lines; with ``}`` as
the line separator it does so for a file that is one long line. Where a record ends
depends on what stands before: a brace inside a string doesn't count, and only the brace that
closes the outermost object does. So each range is first summed up as a function: for either state at
its start (inside a string or not) the state at its end, the change of depth, and the lowest
depth behind a closing brace. Composing these functions along a file, one short row per
range, gives every range its true start, and in a second pass each range cuts its
records by itself. What a range holds of records that began before it or go on behind it is put
together by the range in which the record begins.

Records are written as lines to the shared checkpoint folder and read with Spark's JSON
reader, which infers the types and can split the lines.

Defined cases: several files are read each for itself; white space between records, empty
arrays, an empty file and a single object in place of an array are fine; nested objects and braces, quotes
and backslashes inside strings don't end a record; an unfinished or malformed record
is what the JSON reader makes of such a line; compressed files are one range. Texts are UTF-8.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Bytes of a range.
RANGE_BYTES = 64 << 20
#: Bytes of input that one task reads at least if ranges are shorter; it takes them one after the other.
TASK_BYTES = 32 << 20
QUOTE, BACKSLASH, OPENING, CLOSING = b'"', b"\\", b"{[", b"}]"
#: What may stand around records.
AROUND = b" \t\r\n,[]"
UNSET = 1 << 40

RANGE = "file string, at long, is_array boolean, state int, ends int, depth long, lowest long"
START = "file string, at long, base int, state int, depth long, opened long, ends_file boolean"
CUT = "kind int, value string, file string, opened long, at long"


@contextmanager
def ranges_of(spark: SparkSession, size: int):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _class(symbols: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(symbols)] = True
    return out


IS_OPENING, IS_CLOSING = _class(OPENING), _class(CLOSING)


def scan(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool, np.ndarray, int]:
    """Places of closing braces outside of strings, whether the end is inside a string, the depths
    behind those braces, and the depth at the end, both relative to the start."""
    place = np.arange(len(data))
    backslash = data == BACKSLASH[0]
    # a quote is escaped by an odd number of backslashes right before it
    last_other = np.maximum.accumulate(np.where(backslash, -1, place)) if len(data) else place
    before = np.concatenate(([-1], last_other[:-1])) if len(data) else place
    quote = (data == QUOTE[0]) & ((place - 1 - before) % 2 == 0)
    within = (np.cumsum(quote) + inside) % 2 == 1
    step = np.where(within, 0, IS_OPENING[data].astype(np.int64) - IS_CLOSING[data])
    depth = np.cumsum(step)
    braces = np.flatnonzero((data == CLOSING[0]) & ~within)
    return braces, bool(within[-1]) if len(data) else inside, depth[braces], int(depth[-1]) if len(data) else 0


def _texts(batches):
    """(file, place of the range, is it the first, the last of its range, bytes) of runs of lines of one range."""
    current, held = None, None
    for batch in batches:
        lines, files, ats = (batch.column(c) for c in ("value", "file", "at"))
        key = list(zip(files.to_pylist(), ats.to_pylist(), strict=True))
        start = 0
        for i in range(1, len(key) + 1):
            if i == len(key) or key[i] != key[start]:
                text = b"".join(line.as_py().encode("utf-8", "surrogatepass") + b"}" for line in lines.slice(start, i - start))
                if held:
                    yield *current, held[0], key[start] != current, held[1]
                held = (key[start] != current, text)
                current, start = key[start], i
    if held:
        yield *current, held[0], True, held[1]


def _summed(file, at, array, states) -> pa.RecordBatch:
    rows = [(file, at, array, s, *states[s]) for s in (0, 1)]
    names = [c.split()[0] for c in RANGE.split(", ")]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _sum_up(batches):
    """Each range as a function of the state at its start."""
    held = None
    for file, at, first, _, text in _texts(batches):
        data = np.frombuffer(text, dtype=np.uint8)
        if first:
            if held:
                yield _summed(*held)
            opening = text.lstrip(b"\xef\xbb\xbf \t\r\n")[:1]
            held = (file, at, opening == b"[" if at == 0 else None, {0: (0, 0, UNSET), 1: (1, 0, UNSET)})
        states = held[3]
        for s, (state, depth, lowest) in list(states.items()):
            _, end, depths, change = scan(data, state == 1)
            states[s] = (int(end), depth + change, min(lowest, depth + int(depths.min()) if len(depths) else UNSET))
    if held:
        yield _summed(*held)


def _compose(ranges: pd.DataFrame) -> pd.DataFrame:
    """True start of each range of one file (a row per range and possible state): state, depth, and where the
    record that is open there begins."""
    by = {(int(r.at), int(r.state)): r for r in ranges.itertuples()}
    places = sorted({at for at, _ in by})
    array = bool(by[places[0], 0].is_array)
    state, depth, opened, out = 0, 0, places[0], []
    for at in places:
        r = by[at, state]
        out.append((r.file, at, int(array), state, depth, opened, at == places[-1]))
        if r.lowest < UNSET and depth + r.lowest <= int(array):
            opened = at
        state, depth = int(r.ends), depth + int(r.depth)
    return pd.DataFrame(out, columns=["file", "at", "base", "state", "depth", "opened", "ends_file"])


def _cut(batches):
    """The records of each range; those that cross its borders in parts, with the range in which they begin."""
    names = [c.split()[0] for c in CUT.split(", ")]
    types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def line(parts):
        return b"".join(parts).translate(None, b"\n\r").strip(AROUND).decode("utf-8", "surrogatepass")

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    def raw(parts):
        return b"".join(parts).translate(None, b"\n\r").decode("utf-8", "surrogatepass")

    starts, rest, whole, here = {}, [], True, None

    def watched():
        for batch in batches:
            for k in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "base", "state", "depth", "opened", "ends_file")), strict=True):
                starts[k[:2]] = k[2:]
            yield batch

    for file, at, first, last_run, text in _texts(watched()):
        if first:
            if here and rest:
                yield rows([(1, raw(rest), here[0], here[1], here[2])])
            base, state, depth, opened, ends_file = starts.pop((file, at))
            # a record that was open before belongs to the range that began it
            here, rest, whole = (file, opened, at), [], opened == at
        if last_run and ends_file and base:
            text = text[:-1]  # no brace separates what follows the last record of an array
        braces, inside, depths, change = scan(np.frombuffer(text, dtype=np.uint8), state == 1)
        ends = braces[depths + depth == base] + 1
        found, last = [], 0
        for end in ends.tolist():
            parts, rest = [*rest, text[last:end]], []
            found.append((0, line(parts), None, None, None) if whole else (1, raw(parts), here[0], here[1], at))
            here, whole, last = (file, at, at), True, end
        if last < len(text):
            rest.append(text[last:])
        state, depth = int(inside), depth + change
        if found:
            yield rows(found)
    if here and rest:
        yield rows([(1, raw(rest), here[0], here[1], here[2])])


def tasks_for(spark: SparkSession, path: str) -> int:
    """Tasks of a pass over the files: as many as there are cores, and more once each has ``TASK_BYTES``. Short ranges as
    tasks of their own would cost more in starts and in files written than in work."""
    total = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0  # listed, not read
    return max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))


def write_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> list[str]:
    """The records of the arrays below ``path`` as JSON lines in the shared checkpoint folder; the folders written."""
    target = f"{ensure_checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    with ranges_of(spark, range_bytes):
        lines = spark.read.option("lineSep", "}").text(path).select(
            "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")).coalesce(tasks_for(spark, path))
        sums = lines.mapInArrow(_sum_up, RANGE)
        starts = sums.groupBy("file").applyInPandas(_compose, START)
        starts.write.parquet(f"{target}/ranges")
        # one short row per range: a broadcast of 100 bytes for every RANGE_BYTES read
        known = F.broadcast(spark.read.parquet(f"{target}/ranges"))
        cuts = lines.join(known, ["file", "at"]).mapInArrow(_cut, CUT)
        # blank lines are no records; they make sure that both folders exist
        blank = spark.createDataFrame([(0, "", None, None, None), (1, "", None, None, None)], CUT)
        part = F.when(F.col("value") == "", "").otherwise(F.to_json(F.struct("value", "file", "opened", "at")))
        cuts.unionByName(blank).select("kind", F.when(F.col("kind") == 0, F.col("value")).otherwise(part).alias("value")) \
            .write.partitionBy("kind").text(f"{target}/cut")
    parts = spark.read.schema("value string, file string, opened long, at long").json(f"{target}/cut/kind=1")
    joined = parts.groupBy("file", "opened").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda p: p["value"]), "").alias("value"))
    record = F.btrim("value", F.lit(AROUND.decode()))
    # behind a single object, a separator may be left
    joined.select(record.alias("value")).where("value NOT IN ('', '}')").write.text(f"{target}/joined")
    return [f"{target}/cut/kind=0", f"{target}/joined"]


def read_json_array(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the JSON arrays below ``path``, read by as many tasks as they have ranges of bytes."""
    return spark.read.json(write_records(spark, path, range_bytes))
