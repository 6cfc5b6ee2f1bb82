"""Fill-in-the-middle by piece tables.

A document is a list of descriptors (buffer, start, end) over two buffers that never
change: its own UTF-8 bytes and the sentinels. Cutting splits descriptors at
the borders of units, an arrangement permutes them with a sentinel before each, and
restoring finds the sentinels of an output, cuts there and applies the inverse
permutation. Hashes take the descriptors one after another; no part is copied for them.

A unit is a run of ASCII letters or one other code point. Where a document is
cut, and its form, follow from the hash of a seed and its id, so a repeated task gives the
same output.

Defined cases: a null or empty text has no units and stays plain, and so does a text that holds
a sentinel; a null id is hashed as ``null``; repeated rows are arranged alike, each for
itself; a long text takes a few bytes of memory per byte, one document at a time;
bytes that aren't UTF-8 are units each; an empty table gives an empty result; names of other
columns don't matter, since only the wanted ones are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import q, small_batches

#: The sentinels of prefix, suffix and middle, in one buffer.
SENTINELS = (b"<P>", b"<S>", b"<M>")
SENTINEL_BUFFER = b"".join(SENTINELS)
#: Parts of a document in order, by their sentinels, and the order of the parts in each form.
PREFIX, SUFFIX, MIDDLE = range(3)
DOCUMENT = (PREFIX, MIDDLE, SUFFIX)
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Buffers of a descriptor.
TEXT, MARKS = range(2)
#: Of 100 documents so many are arranged, and of 100 arranged ones so many with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = 1

Piece = tuple[int, int, int]
LETTER = np.zeros(256, dtype=bool)
LETTER[ord("A"):ord("Z") + 1] = LETTER[ord("a"):ord("z") + 1] = True


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Places at which units begin."""
    letter = LETTER[data]
    first = (data & 0xC0) != 0x80
    first[1:] &= ~(letter[1:] & letter[:-1])
    first[:1] = True
    return np.flatnonzero(first)


def n_chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def split(table: list[Piece], at: int) -> list[Piece]:
    """The table with the descriptor that spans place ``at`` of the document cut in two."""
    out, done = [], 0
    for buffer, start, end in table:
        here = start + at - done
        if start <= here <= end and done <= at:
            out += [(buffer, start, here), (buffer, here, end)]
            at = -1
        else:
            out.append((buffer, start, end))
        done += end - start
    return out


def mark(part: int) -> Piece:
    at = sum(map(len, SENTINELS[:part]))
    return MARKS, at, at + len(SENTINELS[part])


def arrange(parts: list[Piece], form: str) -> list[Piece]:
    """Prefix, middle and suffix permuted, a sentinel before each."""
    of = dict(zip(DOCUMENT, parts, strict=True))
    return [piece for part in FORMS[form] for piece in (mark(part), of[part])]


def restore(output: bytes, form: str) -> list[Piece]:
    """Descriptors over an output that give the text it was made from.

    No sentinel stands in the text, and none can begin inside another one, so
    the first one found behind the last is the one that was put there.
    """
    if form == "plain":
        return [(TEXT, 0, len(output))]
    table, at, borders = [(TEXT, 0, len(output))], 0, []
    for part in FORMS[form]:
        at = output.index(SENTINELS[part], at)
        borders += [at, at := at + len(SENTINELS[part])]
    for place in borders[1:]:
        table = split(table, place)
    parts = dict(zip(FORMS[form], table[1::2], strict=True))
    return [parts[part] for part in DOCUMENT]


def stream(table: Iterable[Piece], text: bytes) -> Iterable[memoryview]:
    buffers = memoryview(text), memoryview(SENTINEL_BUFFER)
    return (buffers[buffer][start:end] for buffer, start, end in table)


def sha256(parts: Iterable[memoryview]) -> str:
    h = hashlib.sha256()
    for part in parts:
        h.update(part)
    return h.hexdigest()


def draws(seed: int, name: str) -> list[int]:
    """The first four numbers of 32 bits of a document's hash."""
    digits = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return [int(digits[k:k + 8], 16) for k in range(0, 32, 8)]


def plan(text: bytes, numbers: list[int], rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, list[Piece]]:
    """Units, form, and the descriptors of prefix, middle and suffix (of the whole text if plain)."""
    starts = unit_starts(np.frombuffer(text, dtype=np.uint8)) if text else np.zeros(0, dtype=np.int64)
    n, whole = len(starts), [(TEXT, 0, len(text))]
    if not text or any(s in text for s in SENTINELS) or numbers[2] % 100 >= rate:
        return n, "plain", whole
    place = lambda unit: int(starts[unit]) if unit < n else len(text)
    low, high = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
    return n, "spm" if numbers[3] % 100 < suffix_first else "psm", split(split(whole, place(low)), place(high))


def _kernel(row_type: pa.DataType, seed: int, rate: int, suffix_first: int, texts: bool):
    fields = [("row", row_type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
              ("output_sha256", pa.string()), ("restored_sha256", pa.string())] + [("output", pa.binary())] * texts

    def run(batches):
        for batch in batches:
            out = []
            for name, value in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = value.as_py() or b""
                n, form, parts = plan(text, draws(seed, name), rate, suffix_first)
                table = parts if form == "plain" else arrange(parts, form)
                output = b"".join(stream(table, text))
                size = [None, None] if form == "plain" else [n_chars(np.frombuffer(p, dtype=np.uint8)) for p in list(stream(parts, text))[:2]]
                out.append([n, form, *size, sha256(stream(table, text)), sha256(stream(restore(output, form), output)), *[output] * texts])
            columns = list(zip(*out, strict=True)) or [[]] * (len(fields) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, (_, t) in zip(columns, fields[1:], strict=True)],
                                             [f for f, _ in fields])
    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: dict[str, str] | None = None, seed: int = SEED,
                   rate: int = RATE, suffix_first: int = SUFFIX_FIRST, texts: bool = True) -> DataFrame:
    """The columns of ``keep`` (new name -> name), ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars`` and
    ``middle_chars`` (null if plain), the hashes of the output and of the text restored from it, and the ``output``
    (left out without ``texts``)."""
    from pyspark.sql.pandas.types import to_arrow_type
    small_batches(docs.sparkSession)
    slim = docs.select(F.struct(*[q(o).alias(n) for n, o in (keep or {"doc_id": id_col}).items()]).alias("row"),
                       F.coalesce(q(id_col).cast("string"), F.lit("null")).alias("name"), q(text).cast("string").cast("binary").alias("text"))
    row = slim.schema["row"].dataType
    made = slim.mapInArrow(_kernel(to_arrow_type(row), seed, rate, suffix_first, texts),
                           f"row {row.simpleString()}, n long, form string, prefix_chars long, middle_chars long, "
                           "output_sha256 string, restored_sha256 string" + ", output binary" * texts)
    given = [F.col("output").cast("string").alias("output")] if texts else []
    return made.select("row.*", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *given)
