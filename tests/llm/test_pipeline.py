"""The pipeline, stage by stage, against brute force on its own input."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline
from helpers import DOCS, components, overlap, repeat_words, space_words

SF = "/root/testdata/sf0.001"


def brute(stage, rows, items):
    """rows: (doc_id, text, lang, source, n_chars)."""
    if stage == "quality rules":
        return [r for r in rows if len(w := space_words(r[1])) >= 20 and 100 * repeat_words(w) <= 30 * len(w)]
    if stage == "line dedup":
        sites, first = {}, {}
        for r in sorted(rows, key=lambda r: r[0]):
            for p, line in enumerate(r[1].split("\n")):
                if space_words(line):
                    sites.setdefault(line, set()).add(r[3])
                    first.setdefault(line, (r[0], p))
        gone = {x for x, s in sites.items() if len(s) >= 10}
        return [(r[0], "\n".join(x for p, x in enumerate(r[1].split("\n")) if x not in gone or first[x] == (r[0], p)), *r[2:]) for r in rows]
    if stage == "near dedup":
        root = components([(r[0], r[1]) for r in rows], 5)
        return [r for r in rows if not root[r[0]][0] or root[r[0]][1] == r[0]]
    return [r for r in rows if not (o := overlap(r[1], items))[1] or 20 * o[1] < o[0]]


def test_stages_against_brute_force(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "source mixing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [tuple(r) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(f"{scratch}/{k}")
        out = spark.read.parquet(f"{scratch}/{k}")
        if k < 4:
            assert out.columns == docs.columns
            assert sorted(map(tuple, out.collect()), key=str) == sorted(brute(name, rows, items), key=str), name
            assert 0 < out.count()
        else:
            ids = {r[0] for r in rows}
            mixed = out.collect()
            assert {r.doc_id for r in mixed} <= ids and len({(r.doc_id, r.epoch) for r in mixed}) == len(mixed)
            total = sum(len(space_words(r[1])) for r in rows)
            assert 0.3 * total < sum(r.n_tokens for r in mixed) <= 0.5 * total
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_on_empty_and_odd_tables(spark, scratch):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, " ".join(f"w{i}" for i in range(50)), "en", None, 0)]
    for n, some in enumerate((rows, [])):
        docs = spark.createDataFrame(some, DOCS)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(f"{scratch}/{n}-{k}")
            docs = spark.read.parquet(f"{scratch}/{n}-{k}")
        assert docs.count() <= 2
