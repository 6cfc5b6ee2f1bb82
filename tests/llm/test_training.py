"""Fill-in-the-middle, packing and hard negatives, against brute force."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import DOCS

from pyspark.sql import functions as F

from sparkprep.llm import fill_middle, hard_negatives, packing

ODD = [None, "", " ", "one", "a<P>b", "x<M>", "<S>", "<P", "a <b> < c", "é", "日本 text 7", "A" * 3000, "1 2  3\n\tx", "<" * 40, "P>" * 30]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return (spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS row", "'x' AS form", "'y' AS name", "2 AS n", "'z' AS output", "0 AS length", "1 AS key"))


# -- fill in the middle

def brute_middle(doc_id, text):
    text = text or ""
    w = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(w)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), "<S>" + suf + "<P>" + pre + "<M>" + mid
    return n, "psm", len(pre), len(mid), "<P>" + pre + "<S>" + suf + "<M>" + mid


def test_fill_in_middle_against_brute_force(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab<PSM>é \n9日") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "no id here", None, None, None), (3, "one", "en", "s", 0)]
    got = fill_middle.fill_in_middle(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *brute_middle(i, t), sha(t or "")) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored_sha256) for r in got) == want
    assert all(r.output_sha256 == sha(r.output) for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(frame(spark, [])).collect() == []


def test_fill_in_middle_of_a_long_text_and_its_parameters(spark):
    text = "some words, é and 日 " * 1_000_000
    rows = [(i, text, "en", "s", 0) for i in range(2)]
    for r in fill_middle.fill_in_middle(frame(spark, rows), rate=100, suffix_first=0, texts=False).collect():
        assert r.form == "psm" and r.restored_sha256 == sha(text) and 0 <= r.prefix_chars + r.middle_chars <= len(text)
    assert {r.form for r in fill_middle.fill_in_middle(frame(spark, rows), rate=0, texts=False).collect()} == {"plain"}


def test_piece_tables():
    whole = [(fill_middle.TEXT, 0, 5)]
    assert fill_middle.split(fill_middle.split(whole, 2), 2) == [(0, 0, 2), (0, 2, 2), (0, 2, 5)]
    assert fill_middle.split(whole, 0) == [(0, 0, 0), (0, 0, 5)]
    assert fill_middle.split(whole, 5) == [(0, 0, 5), (0, 5, 5)]
    for text in (b"a<", b"<", b"ab<P", b"P>x"):  # halves of sentinels beside sentinels
        for form in fill_middle.FORMS:
            for a in range(len(text) + 1):
                for b in range(a, len(text) + 1):
                    parts = fill_middle.split(fill_middle.split([(0, 0, len(text))], a), b)
                    output = b"".join(fill_middle.stream(fill_middle.arrange(parts, form), text))
                    assert b"".join(fill_middle.stream(fill_middle.restore(output, form), output)) == text


# -- hard negatives

VECTORS = "vec_id long, label int, embedding array<float>, key string, score int, upper int, `group` int, block int"


def brute_negatives(rows, is_anchor, k=5, least=80, most=100):
    live = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in {(i, lab, tuple(v)) for i, lab, v in live if is_anchor(i)}:
        scored = sorted((-sum(x * y for x, y in zip(a[2], v)), i, lab) for i, lab, v in live)
        positives = [(s, i) for s, i, lab in scored if lab == a[1] and i != a[0]][:k]
        for p, pid in positives:
            window = [(s, i) for s, i, lab in scored if lab != a[1] and least * -p <= 100 * -s <= most * -p][:k]
            out += [(a[0], pid, n + 1, i, -p, -s) for n, (s, i) in enumerate(window)]
    return sorted(out)


def vectors(rng, n, dims, labels, spread=1.0):
    base = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        b = rng.choice(base)
        rows.append((i, rng.randrange(labels), [x + rng.gauss(0, spread) for x in b]))
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 0, 0, 0, 0) for r in rows], VECTORS)


def mined(df, **how):
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 20 == 0, **how).collect()))


def as_floats(spark, rows):
    """The rows with their components rounded as the table holds them."""
    return [(r.vec_id, r.label, r.embedding) for r in vector_frame(spark, rows).collect()]


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    rows = vectors(rng, 400, 8, 3, 0.5)
    rows += [(1000 + i, i % 3, [1.0] * 8) for i in range(60)]  # ties: one vector, three labels
    rows += [(2000, 1, None), (2020, None, [1.0] * 8), (None, 1, [1.0] * 8), (2040, 1, [1.0, None]), (2060, 1, [float("nan")] * 8),
             (2080, 0, [float("inf")] * 8), (2100, 0, []), (2120, 1, [0.5, 0.25]), (2121, 1, [0.5] * 11), (2122, 2, [0.4] * 11), (20, 0, rows[20][2])]
    rows += [rows[7], rows[8], rows[40]]
    df = vector_frame(spark, rows)
    want = brute_negatives(as_floats(spark, rows), lambda i: i % 20 == 0)
    # a repeated anchor gives one result, and rows with an anchor's id are no positives of it
    assert len(want) > 200 and mined(df) == want
    assert mined(df, broadcast_bytes=0) == want
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "OPEN_BLOCKS", 2)
    monkeypatch.setattr(hard_negatives, "SLICE", 7)
    monkeypatch.setattr(hard_negatives, "PENDING", 10)
    assert mined(df.repartition(3)) == want
    assert mined(df.repartition(3), broadcast_bytes=0) == want
    assert mined(df, least=50, most=90, positives=3, negatives=3) == brute_negatives(as_floats(spark, rows), lambda i: i % 20 == 0, 3, 50, 90)


def test_hard_negatives_of_large_numbers_and_empty_tables(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, [rng.choice((1.0, 2.0, 3.0)) * 2.0**rng.choice((0, 10, 20)) for _ in range(5)]) for i in range(60)]
    assert mined(vector_frame(spark, rows)) == brute_negatives(as_floats(spark, rows), lambda i: i % 20 == 0)
    assert mined(vector_frame(spark, [(i, i % 2, [3e38, 1.0]) for i in range(40)]))  # scores stay within 64 bits
    assert mined(vector_frame(spark, [])) == []
    assert mined(vector_frame(spark, [(20, 1, [1.0])])) == []
    assert mined(vector_frame(spark, [(0, 1, [1.0] * 70_000), (1, 1, [1.0] * 70_000), (2, 2, [0.9] * 70_000), (3, 2, [1.0])])) == [
        (0, 1, 1, 2, 256 * 256 * 70_000, 256 * 230 * 70_000)]


# -- packing

def token_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [2] for e in encoder.encode_batch(["" if t is None else t for t in texts], add_special_tokens=False)]


def check_packing(rows, ids, capacity):
    """Every token of every document once, pieces cut as they should be, sequences without gaps; the number of sequences."""
    assert Counter(r.doc_id for r in rows) == Counter({i: -(-len(x) // capacity) for i, x in ids.items()})
    for r in rows:
        x = ids[r.doc_id]
        first = len(x) % capacity or capacity
        start = 0 if r.piece == 0 else first + (r.piece - 1) * capacity
        part = x[start:first + r.piece * capacity]
        assert (r.start, r.length) == (start, len(part)) and len(part) <= capacity
        assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in held.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= capacity
    return len(held)


def test_packing_against_direct_encoding(spark):
    rng = random.Random(5)
    odd = ODD + ["  two  spaces ", " lead", "trail ", "a\n b", "a \n b", "tab\t x", "nb\u00a0 sp", "\u3000 wide \u3000x", "it's we'll I 'm", "x\x1c y \x85 z",
                 "a<|endoftext|> b <|endoftext|>", "\u200b x \u200b", "12 345,6 !!  ??", " ", "   ", "\u180e a", "e\u0301 \u0301x"]
    texts = odd + ["".join(rng.choice("ab 1.\n é日'") for _ in range(rng.randrange(40))) for _ in range(200)]
    texts += [" ".join(rng.choice(("the", "house", "of", "xqz", "9", "日本")) for _ in range(rng.randrange(2500))) for _ in range(60)]
    ids = dict(enumerate(token_ids(texts)))
    df = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    for capacity in (1024, 7):
        rows = packing.pack(df.repartition(5), capacity=capacity, with_ids=True)
        got = rows.collect()
        n = check_packing(got, ids, capacity)
        assert -(-sum(map(len, ids.values())) // capacity) <= n
        assert all(r.ids == np.array(ids[r.doc_id][r.start:r.start + r.length], dtype="<u4").tobytes() for r in got)
        whole = {r.sequence_id: r.ids for r in packing.sequences(rows).collect()}
        assert len(whole) == n and all(whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == r.ids for r in got)


def test_packing_of_empty_repeated_and_long_documents(spark):
    assert packing.pack(frame(spark, [])).collect() == []
    got = packing.pack(frame(spark, [(1, None, None, None, None)] * 3 + [(None, "", None, None, None)])).collect()
    assert [(r.piece, r.start, r.length, r.sequence_id) for r in got] == [(0, 0, 1, 0)] * 4 and sorted(r.offset for r in got) == [0, 1, 2, 3]
    text = "some words, \u00e9 and 日 " * 800_000 + "x" * 300_000
    rows = packing.pack(frame(spark, [(1, text, "en", "s", 0)])).collect()
    assert check_packing(rows, {1: token_ids([text])[0]}, 1024) == len(rows)


def test_packing_plans():
    rng = random.Random(3)
    for capacity in (5, 30, 1024):
        for n in (1, 10, 500):
            counts = Counter(rng.randrange(1, capacity + 1) for _ in range(n))
            for first, within in packing.WAYS:
                chosen = packing.combinations(counts, capacity, first, within)
                used = Counter()
                for times, held in chosen:
                    assert times > 0 and sum(held) <= capacity
                    used.update({x: k * times for x, k in Counter(held).items()})
                assert used == counts
    exact = Counter()
    for _ in range(400):  # a perfect packing exists, and is found
        a = rng.randrange(1, 1024)
        exact.update((a, 1024 - a))
    assert sum(t for t, _ in packing.plan(exact)) == 400
    assert sum(t for t, _ in packing.plan({600: 7, 400: 7, 24: 7})) == 7  # closed by two
    assert sum(t for t, _ in packing.plan({500: 7, 300: 7, 200: 7, 24: 7})) == 7  # by three
    assert sum(t for t, _ in packing.plan({10**3: 10**9, 24: 10**9 + 5})) == 10**9 + 1
    assert packing.plan({}) == []
