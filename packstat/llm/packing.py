"""Best-fit packing of documents into token sequences by exact-complement hashing.

Documents become pieces of at most ``size`` tokens. How many pieces have each length is a table
of at most ``size`` rows, whatever the corpus; the whole plan is made from it. Sums of one, two and
three lengths are indexed, and combinations that fill a sequence exactly are consumed as often as
the counts allow; what stays is packed best-fit, longest first. The plan is a list of patterns
with the number of times each is used. Pieces are numbered within their length, and a piece's
number tells the pattern, the sequence and the place it takes, so nothing is packed one by one.

Null texts are empty and still hold the closing id. Rows that repeat an id are packed separately.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packstat.llm.common import rank_within
from packstat.session import checkpoint

SIZE, END = 2048, 0
#: Characters on which both tokenizer libraries are known to cut words alike; all others go the slower way.
_USUAL = re.compile("[\t\n\r -~¡-ɏ–—‘-”…€]*")


@functools.lru_cache(maxsize=4)
def _encoders(json_name: str, ranks_name: str):
    """The tokenizer, and a faster one with the same vocabulary."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(json_name))
    whole.encode_special_tokens = True
    with open(public_tokenizers.path(ranks_name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return whole, tiktoken.Encoding(json_name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken") -> np.ndarray:
    """Ids of a text by the tokenizer of ``json_name``, unsigned 32-bit little-endian."""
    whole, fast = _encoders(json_name, ranks_name)
    ids = fast.encode_ordinary(text) if _USUAL.fullmatch(text) else whole.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4")


def _cut(size: int, end: int, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                for doc_id, text in zip(batch.column(0).slice(i, 256).to_pylist(), batch.column(1).slice(i, 256).to_pylist(), strict=True):
                    ids = np.append(token_ids(text or ""), np.uint32(end)).astype("<u4")
                    first = len(ids) % size or size
                    for piece, start in enumerate([0, *range(first, len(ids), size)]):
                        part = ids[start: first if piece == 0 else start + size]
                        rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), part.tobytes() if keep_ids else None))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
    return cut


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, and how often each is used; every piece is used once.

    Exact triples and pairs can use up the short pieces that best fit would need for other gaps,
    so plans that index up to three, two, one and no lengths are made, and the one with the fewest sequences is taken.
    """
    return min((_plan(counts, size, depth) for depth in (3, 2, 1, 0)), key=lambda made: sum(times for _, times in made))


def _plan(counts: dict[int, int], size: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """A plan whose exact combinations index sums of at most ``depth`` lengths."""
    have = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def use(*lengths: int) -> None:
        times = min(int(have[x]) // lengths.count(x) for x in lengths)
        for x in lengths:
            have[x] -= times
        if times:
            out.append((tuple(sorted(lengths, reverse=True)), times))

    def held(*lengths: int) -> bool:
        return all(have[x] >= lengths.count(x) for x in lengths)

    def sums() -> np.ndarray:
        """Which sums two lengths at hand can make."""
        some = (have > 0).astype(np.float64)
        reach = np.rint(np.fft.irfft(np.fft.rfft(some, 4096 * (size // 2048 + 1)) ** 2, 4096 * (size // 2048 + 1)))[: size + 1] > 0.5
        return reach

    def pair(total: int, *others: int) -> tuple[int, int] | None:
        """The most uneven pair with that sum that the counts still allow."""
        a = np.arange(total // 2 + total % 2, total)
        a = a[(have[a] > 0) & (have[total - a] > 0)]
        for x in a[::-1].tolist():
            if held(x, total - x, *others):
                return x, total - x
        return None

    use(size)
    for x in range(size - 1, 0, -1) if depth >= 1 else ():  # the gap of a single length is another length
        if 2 * x >= size and have[x] and have[size - x]:
            use(x, size - x)
    for x in range(size - 1, 0, -1) if depth >= 2 else ():  # ... the sum of a pair
        while have[x] and (found := pair(size - x, x)):
            use(x, *found)
    reach = sums()
    for x in range(size - 1, 0, -1) if depth >= 3 else ():  # ... the sum of a triple
        while have[x]:
            c = np.arange(1, size - x - 1)
            c = c[(have[c] > 0) & reach[size - x - c]][::-1]
            found = next(((y, *p) for y in c.tolist() if held(x, y) and (p := pair(size - x - y, x, y))), None)
            if not found:
                break
            use(x, *found)
    open_: dict[int, list[list]] = {}  # by gap: [pattern, times]
    for x in range(size, 0, -1):
        n = int(have[x])
        while n:
            gap = min((g for g in open_ if g >= x), default=None)
            if gap is None:
                per = size // x
                for pattern, times in (((x,) * per, n // per), ((x,) * (n % per), 1)):
                    if pattern and times:
                        open_.setdefault(size - sum(pattern), []).append([pattern, times])
                break
            pattern, times = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
            took = min(n, times)
            open_.setdefault(gap - x, []).append([(*pattern, x), took])
            if times > took:
                open_.setdefault(gap, []).append([pattern, times - took])
            n -= took
    return out + [(pattern, times) for held_ in open_.values() for pattern, times in held_]


def _segments(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number, first sequence, offset): numbers from the first on take the sequences from the first on."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + times
            offset += length
        sequence += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 4)


def _place(segments: np.ndarray):
    keys = segments[:, 0] * 2**48 + segments[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            at = np.searchsorted(keys, length * 2**48 + number, side="right") - 1
            sequence = segments[at, 2] + number - segments[at, 1]
            columns = [batch.column(c) for c in batch.schema.names if c != "number"] + [pa.array(sequence, pa.int64()), pa.array(segments[at, 3], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [c for c in batch.schema.names if c != "number"] + ["sequence_id", "offset"])
    return place


def pack(docs: DataFrame, size: int = SIZE, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; with ``keep_ids`` also ids, the tokens of the piece."""
    cut = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _cut(size, end, keep_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    pieces = checkpoint(cut if keep_ids else cut.drop("ids"))
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    numbered = rank_within(pieces, ["length"], ["doc_id", "piece", "ids_crc32", "start"], "number")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(_place(_segments(plan(counts, size))), f"{schema}, sequence_id long, offset long")
