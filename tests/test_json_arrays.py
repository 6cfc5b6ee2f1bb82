"""JSON arrays read in ranges of bytes, against the json module."""

import json
import os
import random

import numpy as np
import pytest

from sparkprep.sources import json_arrays
from sparkprep.sources.readers import load_table, read_json


def records(rng, n):
    out = [{"i": i, "s": "".join(rng.choice('ab{}[]"\\,é\n ') for _ in range(rng.randrange(60))), "n": {"x": [{"y": i}, {"z": "}"}]},
            "e": "\\" * (i % 5)} for i in range(n)]
    out[n // 3]["s"], out[n // 2]["s"] = "}" * 3000, 'x{"\\' * 8000  # strings longer than a range, full of what isn't structure
    return out


def write(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


def rows(df):
    return sorted((r.i, r.s, r.n.x[0].y, r.n.x[1].z, r.e) for r in df.collect())


@pytest.mark.parametrize("size", [3000, 20_000, 1 << 26])
def test_ranges_give_the_records_of_the_array(spark, scratch, size):
    made = records(random.Random(size), 800)
    write(scratch, "a.json", json.dumps(made, ensure_ascii=False))
    write(scratch, "b.json", " " + json.dumps(made[:100], indent=2) + "\n")
    write(scratch, "c.json", "[]")
    write(scratch, "d.json", "")
    write(scratch, "e.json", json.dumps(made[0]) + "\n")
    want = sorted((r["i"], r["s"], r["n"]["x"][0]["y"], "}", r["e"]) for r in [*made, *made[:100], made[0]])
    assert rows(json_arrays.read_json_array(spark, scratch, size)) == want
    if size == 3000:
        found = spark.read.option("lineSep", "}")
        with json_arrays.ranges_of(spark, size):
            assert found.text(os.path.join(scratch, "a.json")).rdd.getNumPartitions() > 20


def test_read_json_takes_ranges_for_long_files_only(spark, scratch):
    made = [{"a": i, "b": f"v{i}"} for i in range(500)]
    write(scratch, "t.json", json.dumps(made))
    path = os.path.join(scratch, "t.json")
    want = [(r["a"], r["b"]) for r in made]
    assert sorted(map(tuple, load_table(spark, path).collect())) == want
    split = read_json(spark, path, range_bytes=1000)
    assert split.columns == ["a", "b"] and sorted(map(tuple, split.collect())) == want


def test_unfinished_and_empty_files(spark, scratch):
    write(scratch, "x.json", '[{"a": 1}, {"a": 2}, {"a": ')
    got = json_arrays.read_json_array(spark, scratch, 1 << 20).collect()
    assert sorted(r.a for r in got if r.a is not None) == [1, 2] and len(got) == 3  # the last is a corrupt record
    empty = os.path.join(scratch, "none")
    os.makedirs(empty)
    write(empty, "y.json", " [ ] ")
    assert json_arrays.read_json_array(spark, empty, 1 << 20).count() == 0


def test_scan_against_a_walk_over_characters():
    rng = random.Random(1)
    for _ in range(300):
        text = bytes(rng.choice(b'{}[]"\\ab') for _ in range(rng.randrange(30)))
        for inside in (False, True):
            within, depth, escaped, ends = inside, 0, False, []
            for i, c in enumerate(text):
                if escaped:
                    escaped = False
                    if within:
                        continue
                if c == ord("\\"):
                    escaped = True
                elif c == ord('"'):
                    within = not within
                elif not within and c in b"{[":
                    depth += 1
                elif not within and c in b"}]":
                    depth -= 1
                    if c == ord("}"):
                        ends.append((i, depth))
            if b"\\" in text and not inside and text.find(b"\\") < (text.find(b'"') if b'"' in text else 99):
                continue  # a backslash outside of strings is no JSON
            braces, end, depths, change = json_arrays.scan(np.frombuffer(text, dtype=np.uint8), inside)
            if b"\\" not in text or text.count(b'"') <= 1:
                assert (list(zip(braces.tolist(), depths.tolist())), end, change) == (ends, within, depth)


def test_short_ranges_share_tasks_and_files(spark, scratch):
    write(scratch, "a.json", json.dumps(records(random.Random(3), 800), ensure_ascii=False))
    with json_arrays.ranges_of(spark, 1000):
        ranges = spark.read.option("lineSep", "}").text(scratch).rdd.getNumPartitions()
    whole = json_arrays.write_records(spark, scratch, 1000)[0].removeprefix("file:")
    written = [f for f in os.listdir(whole) if f.startswith("part-")]
    assert len(written) <= spark.sparkContext.defaultParallelism + 8 < ranges
