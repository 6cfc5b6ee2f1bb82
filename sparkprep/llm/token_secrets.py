"""Secrets in texts: three fixed patterns and a token-efficiency test.

A random string takes many tokens of a trained vocabulary for its length. Runs
of key characters with fewer than ``MAX_RATIO`` characters per token (tiktoken
ranks from a vocabulary file) are flagged, unless they are known digests (hex
of a digest's length, also with an algorithm's name), identifiers (UUIDs,
version numbers, dates, numbers, words joined by separators, paths), or overlap
a pattern's span. Where a run isn't flagged as a whole, its parts between equals signs and
then its pieces between any separators are tested by themselves. Letters without a
digit have to be of both cases and stay below ``MAX_LETTER_RATIO``; letters of one case count as words.

Defined cases: a null or empty text has no spans; repeated rows are searched
row by row; spans of one start are ordered by kind; a long text is one task's work, and a long run is encoded in slices, so
that time grows with the length only; only the columns of ``keep`` and the text are read; an empty table gives an
empty result. Places are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import q, small_batches
from .textbytes import Made

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The patterns, and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
HEX = re.compile(rf"[0-9a-f]{{{HEX_LENGTH},}}")
KINDS = ("assign", "access", "hex", "random")
#: Candidates of the token test: runs of this length and more ...
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: ... with this many characters per token at most.
MAX_RATIO = 2.2
#: The same for letters without a digit: 99 % of random ones lie below, names in mixed case above.
MAX_LETTER_RATIO = 1.8
#: Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
NAMED_DIGEST = re.compile(r"(md5|sha1|sha224|sha256|sha384|sha512)[-_=](?=[0-9A-Za-z+/=])", re.I)
#: The name before a piece that is a digest.
DIGEST_NAME = re.compile(r"(?:^|[^0-9A-Za-z])(?:md5|sha1|sha224|sha256|sha384|sha512)[-_=]\Z", re.I)
SEPARATOR = re.compile("[-_/+=]+")
#: Parts and pieces of a run that are tested by themselves; a named digest has none.
PART = re.compile(r"[A-Za-z0-9+/_-]{20,}")
INNER = re.compile(r"(?<![0-9A-Za-z])(?:md5|sha1|sha224|sha256|sha384|sha512)[-_][0-9A-Za-z+/]+|([0-9A-Za-z]{20,})", re.I)
#: A word, a number, or a short mixture of both, between separators.
PIECE = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]+|[0-9]+|[A-Za-z0-9]{1,4}")
#: Runs are encoded in slices of this length, so that time grows with the length only.
SLICE = 1000
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


READ = Made()


def encoder(path: str):
    """Encoding of a vocabulary file, read once."""
    import tiktoken

    if path not in READ:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        READ[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return READ[path]


def is_known(run: str) -> bool:
    """Digests and identifiers, which look random but aren't secret."""
    if UUID.fullmatch(run) or NAMED_DIGEST.match(run) or all(map(PIECE.fullmatch, SEPARATOR.split(run))):
        return True
    return len(run) in DIGEST_LENGTHS and re.fullmatch("[0-9a-f]+|[0-9A-F]+", run) is not None


def is_random(run: str, enc, max_ratio: float = MAX_RATIO) -> bool:
    """Letters and digits or letters of both cases mixed, few characters per token."""
    if re.search("[0-9]", run):
        mixed = re.search("[A-Za-z]", run)
    else:
        mixed, max_ratio = re.search("[A-Z]", run) and re.search("[a-z]", run), min(max_ratio, MAX_LETTER_RATIO)
    if not mixed or is_known(run):
        return False
    return len(run) <= max_ratio * sum(len(enc.encode_ordinary(run[i:i + SLICE])) for i in range(0, len(run), SLICE))


def _outside(spans: list[tuple[int, int, int]]):
    """Whether a span overlaps none of these."""
    starts, ends = [], []
    for s, _, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return lambda a, b: not ((i := bisect_left(starts, b)) and ends[i - 1] > a)


def random_spans(run: str, free, enc, max_ratio: float = MAX_RATIO) -> list[tuple[int, int]]:
    """The run if it is random, else what is random of its parts and their pieces; ``free``
    tells whether a place of the run is outside of the patterns' spans."""
    test = lambda a, b: free(a, b) and is_random(run[a:b], enc, max_ratio)
    whole = (0, len(run))
    if test(*whole):
        return [whole]
    if UUID.fullmatch(run) or NAMED_DIGEST.match(run):
        return []
    out = []
    for p in PART.finditer(run):
        part = p.span()
        if UUID.fullmatch(p[0]) or NAMED_DIGEST.match(p[0]) or DIGEST_NAME.search(run[max(0, part[0] - 8):part[0]]):
            continue
        if part != whole and test(*part):
            out.append(part)
        else:
            out += [m.span(1) for m in INNER.finditer(run, *part) if m[1] and m.span(1) != part and test(*m.span(1))]
    return out


def find(text: str, enc, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order."""
    low = text.lower() if text.isascii() else None
    out = []
    if low is None or any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    outside = _outside(out)
    for m in RUN.finditer(text):
        at = m.start()
        out += [(at + a, 3, at + b) for a, b in random_spans(m[0], lambda a, b, at=at: outside(at + a, at + b), enc, max_ratio)]
    return sorted(out)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _kernel(vocabulary: str, max_ratio: float):
    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t, enc, max_ratio)] if t else []
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], ["row", "spans"])
    return run


def secret_spans(docs: DataFrame, text: str = "text", keep: dict[str, str] | None = None,
                 vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """The columns of ``keep`` (new name -> name) and ``spans`` (kind, start, end) in order of start and kind."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.struct(*[q(o).alias(n) for n, o in (keep or {"doc_id": "doc_id"}).items()]).alias("row"), q(text).cast("string").alias("text"))
    shape = slim.schema["row"].dataType.simpleString()
    return slim.mapInArrow(_kernel(vocabulary, max_ratio), f"row {shape}, spans array<struct<kind:string,start:long,end:long>>").select("row.*", "spans")
