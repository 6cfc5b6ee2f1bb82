"""Best-fit packing of tokenised documents by exact complements.

Documents become token ids and a closing id. Those longer than a sequence are cut so that
all pieces but the first are full. Which pieces share a sequence depends on their lengths
only, so the plan is made from a table of counts: one number per length up to the
capacity, whatever the number of documents. Sums of one, two and three of the lengths that are left are
indexed; combinations that fill a gap exactly are used, as often as the counts
allow, and what is left goes by best fit, longest first. Exact filling early on costs
short pieces that are missed later, so both are mixed in several ways, and the plan with the fewest
sequences is taken. Every combination uses up a length, so a plan has some thousands of lines at most.

Pieces take their place by their number among the pieces of their length. Tasks number what they
make; the tasks' counts are summed up per length, so no length is gathered, however
many pieces have it.

Texts are cut for encoding before single spaces between other characters, where no token
can reach across; the ids of words between such spaces are remembered up to a fixed number in each worker.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed each; ties don't
matter, since pieces of one length change places freely; a long text is one task's work, and a
word without any space is encoded whole; an empty table gives no piece; other columns
aren't read, so their names don't matter.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import zlib
from collections.abc import Iterable, Iterator
from itertools import pairwise
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, q, small_batches

VOCABULARY = "byte_bpe_50k.json"
#: Tokens of a sequence, and the id that closes a document.
CAPACITY = 1024
END = 2
#: Words whose ids a worker remembers, and their longest length.
REMEMBERED, WORD_LENGTH = 1_000_000, 64
#: Words that are encoded as one text.
WORDS_TOGETHER = 2000
#: Characters that are encoded at a time, where a text can be cut.
TOGETHER = 1 << 14
#: White space, in a wide sense: what any library may take for it.
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
PYTHON_SPACES = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), SPACES)
#: A space that begins a new token whatever stands on either side.
BORDER = re.compile(f"(?<=[^{PYTHON_SPACES}])(?= [^{PYTHON_SPACES}])")
#: Texts in which some space isn't such a border (for Arrow).
UNEVEN = rf"(?:\A|[{SPACES}]) | (?:\z|[{SPACES}])"
#: Exact combinations of up to so many lengths before, and within best fit.
WAYS = [(3, 0), (2, 0), (1, 0), (0, 3), (0, 2), (0, 0)]
#: What a token begins with that has a space before its characters (byte-level vocabularies).
SPACED = "Ġ"
#: Module in which a worker keeps its encoders.
MEMORY = "_sparkprep_encoders"


class Encoder:
    """Token ids of whole texts (little-endian, 32 bits), of which words are encoded once and remembered.

    A word that follows a space begins with a token that has the space in it, and has no other such
    token. So many words are encoded as one text, and their ids told apart by these tokens.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(vocabulary)
        known = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(known.values()) + 1, dtype=bool)
        self.spaced[[i for token, i in known.items() if token.startswith(SPACED)]] = True
        self.known = pa.array([], pa.string())
        self.bank, self.start, self.size = np.zeros(0, dtype="<u4"), *np.zeros((2, 0), dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def uneven(self, text: str) -> bytes:
        """Ids of a text, encoded from border to border."""
        if len(text) <= TOGETHER:
            return self.encode([text])[0].tobytes()
        return b"".join(self.encode([part])[0].tobytes() for part in grouped(BORDER.split(text)))

    def together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each behind a space, and how many each has."""
        ids, sizes = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        parts = [words[k:k + WORDS_TOGETHER] for k in range(0, len(words), WORDS_TOGETHER)]
        for part, found in zip(parts, self.encode([" " + " ".join(part) for part in parts]), strict=True):
            first = np.flatnonzero(self.spaced[found])
            if len(first) == len(part):
                ids.append(found)
                sizes.append(np.diff(first, append=len(found)))
            else:  # not a vocabulary of such tokens
                each = self.encode([" " + word for word in part])
                ids += each
                sizes.append(np.array([len(e) for e in each]))
        return np.concatenate(ids), np.concatenate(sizes)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each of the distinct words begin and how many they are; remembers the words
        of this call first, and of those before as many as there is room for."""
        at = pc.index_in(words, value_set=self.known.cast(words.type))
        new = at.is_null().to_numpy(zero_copy_only=False)
        ids, sizes = self.together(words.filter(pa.array(new)).to_pylist())
        hit = at.drop_null().to_numpy()
        bank = np.concatenate((self.bank, ids))
        start, size = np.empty((2, len(words)), dtype=np.int64)
        start[~new], size[~new] = self.start[hit], self.size[hit]
        start[new], size[new] = len(self.bank) + np.cumsum(sizes) - sizes, sizes
        short = pc.less_equal(pc.utf8_length(words), WORD_LENGTH).to_numpy(zero_copy_only=False)
        others = np.ones(len(self.known), dtype=bool)
        others[hit] = False
        self.known = pa.concat_arrays([words.filter(pa.array(short)), self.known.filter(pa.array(others)).cast(words.type)])[:REMEMBERED]
        self.size = np.concatenate((size[short], self.size[others]))[:REMEMBERED]
        kept = np.concatenate((start[short], self.start[others]))[:REMEMBERED]
        self.bank, self.start = bank[spread(kept, self.size)], np.cumsum(self.size) - self.size
        return bank, start, size

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; null has none."""
        texts = pc.fill_null(texts, "")
        even = pc.invert(pc.match_substring_regex(texts, UNEVEN))
        rows = pc.split_pattern(texts.filter(even), " ")
        words, count = rows.flatten(), rows.value_lengths().to_numpy()
        first = np.zeros(len(words), dtype=bool)
        first[np.cumsum(count) - count] = True
        coded = pc.dictionary_encode(words.filter(pa.array(~first)))
        bank, start, size = self.words(coded.dictionary)
        index = coded.indices.to_numpy()
        tokens = bank[spread(start[index], size[index])]
        place = np.concatenate(([0], np.cumsum(size[index])))[np.concatenate(([0], np.cumsum(count - 1)))]
        openings = self.encode(words.filter(pa.array(first)).to_pylist())
        whole = iter([o.tobytes() + tokens[a:b].tobytes() for o, (a, b) in zip(openings, pairwise(place.tolist()), strict=True)])
        return [next(whole) if e else self.uneven(t.as_py()) for e, t in zip(even.to_pylist(), texts, strict=True)]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1 ... of each run, one run after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def grouped(parts: Iterable[str]) -> Iterator[str]:
    """Neighbouring parts joined to texts of about ``TOGETHER`` characters."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= TOGETHER:
            yield "".join(held)
            held, size = [], 0
    if held:
        yield "".join(held)


def encoder(key: str, vocabulary: str) -> Encoder:
    """The encoder of a worker, which goes from task to task with what it remembers."""
    memory = sys.modules.setdefault(MEMORY, ModuleType(MEMORY)).__dict__
    if key not in memory:
        memory[key] = Encoder(vocabulary)
    return memory[key]


def read_vocabulary(path: str | None) -> str:
    """Text of a tokenizer file, by default of a public one; read by the driver and sent to the tasks."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


def borders(n: int, capacity: int) -> list[int]:
    """Where a document of n tokens is cut: only the first piece may be shorter than a sequence."""
    first = n % capacity or capacity
    return [0, *range(first, n + 1, capacity)]


def _encode(row_type: pa.DataType, key: str, shared, end: int, capacity: int, with_ids: bool):
    names = ["row", "piece", "start", "length", "ids_crc32", "chunk", "number"] + ["ids"] * with_ids

    def run(batches):
        coder = encoder(key, shared.value)
        closing, task, seen = np.array([end], dtype="<u4").tobytes(), TaskContext.get().partitionId(), {}
        for batch in batches:
            at, out = [], []
            for i, ids in enumerate(coder.batch(batch.column(1))):
                ids = memoryview(ids + closing)
                for piece, (a, b) in enumerate(pairwise(borders(len(ids) // 4, capacity))):
                    part = ids[4 * a:4 * b]
                    number = seen[b - a] = seen.get(b - a, -1) + 1
                    at.append(i)
                    out.append((piece, a, b - a, zlib.crc32(part), task, number) + (bytes(part),) * with_ids)
            columns = list(zip(*out, strict=True)) or [()] * (len(names) - 1)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64()))]
                                             + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
    return run


def encode(docs: DataFrame, text: str = "text", keep: dict[str, str] | None = None, vocabulary: str | None = None, end: int = END,
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: ``row`` (the columns of ``keep``), ``piece``, ``start``, ``length``, ``ids_crc32``, and
    ``number`` among the pieces of their length in ``chunk`` (a task). ``ids`` are little-endian bytes."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.struct(*[q(o).alias(n) for n, o in (keep or {"doc_id": "doc_id"}).items()]).alias("row"), q(text).cast("string").alias("text"))
    row = slim.schema["row"].dataType
    text_of = read_vocabulary(vocabulary)
    key, shared = hashlib.sha256(text_of.encode()).hexdigest(), spark.sparkContext.broadcast(text_of)
    return slim.mapInArrow(_encode(to_arrow_type(row), key, shared, end, capacity, with_ids),
                           f"row {row.simpleString()}, piece int, start long, length long, ids_crc32 long, chunk int, number long"
                           + ", ids binary" * with_ids)


# -- the plan

class Sums:
    """Which sums one, two and three of the lengths that are left can have, and which lengths give them."""

    def __init__(self, left: np.ndarray, most: int):
        self.present = np.flatnonzero(left)
        size = 1 << (3 * len(left)).bit_length()
        one = np.fft.rfft(left > 0, size)
        self.reach = [np.fft.irfft(one**k, size)[:len(left)] > 0.5 for k in range(1, most + 1)]

    def find(self, gap: int, left: np.ndarray, above: int = 1) -> list[int] | None:
        """As few lengths as possible, ``above`` or more each, of those that are ``left``, which add up to the gap."""
        if self.reach and left[gap]:
            return [gap]
        if len(self.reach) > 1 and self.reach[1][gap] and (found := self._pair(gap, left, above)):
            return found
        if len(self.reach) > 2 and self.reach[2][gap]:
            small = self.present[(self.present >= above) & (3 * self.present <= gap)]
            for c in small[self.reach[1][gap - small] & (left[small] > 0)].tolist():
                left[c] -= 1
                found = self._pair(gap - c, left, c)
                left[c] += 1
                if found:
                    return [*found, c]
        return None

    @staticmethod
    def _pair(gap: int, left: np.ndarray, above: int) -> list[int] | None:
        a = np.arange(gap - above, (gap - 1) // 2, -1)
        b = gap - a
        fits = (left[a] > 0) & (left[b] > (a == b))
        return [int(a[k := int(np.argmax(fits))]), int(b[k])] if fits.any() else None


def combinations(counts: dict[int, int], capacity: int, first: int, within: int) -> list[tuple[int, list[int]]]:
    """(times, lengths of a sequence) that use up the counts.

    Lengths whose gap is filled exactly by up to ``first`` others are taken first, long ones
    before short ones; then sequences are filled by best fit, and closed as soon as up to ``within`` lengths fill the gap.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []

    def use(held):
        lengths, need = np.unique(held, return_counts=True)
        times = int((left[lengths] // need).min())
        left[lengths] -= times * need
        out.append((times, held))

    for most in range(1, first + 1):
        sums = Sums(left, most)
        for length in range(capacity - 1, 0, -1):
            while left[length]:
                left[length] -= 1
                found = sums.find(capacity - length, left)
                left[length] += 1
                if not found:
                    break
                use([length, *found])
                sums = Sums(left, most)
    while left.any():
        sums, now, held, gap = Sums(left, within), left.copy(), [], capacity
        while gap and len(fitting := np.flatnonzero(now[:gap + 1])):
            found = sums.find(gap, now) if held else None
            if found is None:
                found = [int(fitting[-1])]
            held += found
            np.subtract.at(now, found, 1)
            gap -= sum(found)
        use(held)
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """The combinations with the fewest sequences, of several ways to mix exact filling with best fit."""
    ways = [combinations(counts, capacity, first, within) for first, within in WAYS]
    return min(ways, key=lambda way: sum(times for times, _ in way))


def places(chosen: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Per length the lines (first number, sequence, pieces of it in a sequence, offset of the first), by number."""
    out, used, base = {}, {}, 0
    for times, held in chosen:
        offset = 0
        for length, n in sorted(((x, held.count(x)) for x in set(held)), reverse=True):
            first = used.get(length, 0)
            out.setdefault(length, []).append((first, base, n, offset))
            used[length] = first + times * n
            offset += n * length
        base += times
    return {length: np.array(lines, dtype=np.int64) for length, lines in out.items()}


def _place(lines: dict[int, np.ndarray], names: list[str]):
    def run(batches):
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length).tolist():
                here = np.flatnonzero(length == x)
                first, base, n, start = lines[x][np.searchsorted(lines[x][:, 0], number[here], side="right") - 1].T
                step = number[here] - first
                sequence[here], offset[here] = base + step // n, start + step % n * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                                             [*names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, text: str = "text", keep: dict[str, str] | None = None, vocabulary: str | None = None, end: int = END,
         capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: the columns of ``keep`` (new name -> name), ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``, and with ``with_ids`` its ``ids`` (little-endian bytes, 32 bits each)."""
    made = cut(encode(docs, text, keep, vocabulary, end, capacity, with_ids))
    per_task = cut(made.groupBy("length", "chunk").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length
    lines = places(plan(counts, capacity))
    before = F.sum("n").over(W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    starts = per_task.select("length", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = made.join(starts, ["length", "chunk"]).withColumn("number", F.col("number") + F.col("before"))
    names = ["row", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    slim = numbered.select(*names, "number")
    shape = ", ".join(f"{n} {slim.schema[n].dataType.simpleString()}" for n in names) + ", sequence_id long, offset long"
    return slim.mapInArrow(_place(lines, names), shape).select("row.*", *names[1:5], "sequence_id", "offset", *names[5:])


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the sequences of pieces packed ``with_ids`` (a sequence is at most its capacity)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_, part: F.concat(all_, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
