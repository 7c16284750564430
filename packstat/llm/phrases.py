"""Collocations: phrases of two and three words whose words keep company, counted with burst tries.

Each task counts the words, pairs and triples of its texts in a HAT-trie: a shallow trie over word ids whose leaves are hash
containers. A container covers a range of prefixes; when it holds more than ``CONTAINER`` phrases it bursts between two first words,
or if it has but one first word between two second words. When the tries of a task hold more than ``HELD`` phrases, the largest
subtrees are spilled whole, as sorted runs, one for each prefix partition (first two words; the third deals a pair's subtree to
``NEIGHBOURS`` partitions, so a pair that a third of all phrases begin with is in many). The runs of a partition are merged and
added up there; counts of at least ``least`` go on. Nothing rarer is needed: each part of a phrase occurs as often as the phrase.

Scores are decimals without loss (38 digits: exact up to some 10^15 occurrences). Counts that many phrases look up, those of common words,
are looked up in shares; ranks are taken in shares first.

Null texts are empty, a null language is ``und``. Rows are documents, so ids do not matter and repeated rows count each time. An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packstat.llm.common import mix, written

#: Bits of a word id; three of them make a key.
ID_BITS = 21
#: Phrases of a container, phrases and words held by a task.
CONTAINER, HELD, WORDS = 1 << 17, 600_000, 1 << 19
#: Partitions over which the subtree of a pair is dealt.
NEIGHBOURS = 16
#: Bytes of text for each prefix partition; bytes of text counted at a time.
PART_BYTES, RUN = 6 << 20, 2 << 20
#: Shares in which common counts are looked up and ranks are taken.
SHARES = 64

_MASK = (1 << ID_BITS) - 1
_UPPER = bytes(range(65, 91))
_TABLE = bytes.maketrans(_UPPER + b",;:!?\n\x0b\x0c\r\t", _UPPER.lower() + b"." * 9 + b" ")


class Words(dict):
    """Number of each word, in the order they come; 0 is the mark between pieces."""

    def __init__(self):
        super().__init__({b".": 0})
        self.hashes, self.said, self.rank = np.zeros(0, np.uint64), None, np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def listed(self) -> None:
        """Hashes of all words so far, the order of the hashes, and the words as an array; the mark is no word."""
        if len(self.hashes) < len(self):
            said = [b"", *list(self)[1:]]
            new = np.fromiter(map(zlib.crc32, said[len(self.hashes):]), np.uint64, len(self) - len(self.hashes))
            self.hashes = np.concatenate([self.hashes, mix(new + np.uint64(1))])
            self.rank = np.empty(len(said), np.int64)
            self.rank[np.argsort(self.hashes[1:], kind="stable") + 1] = np.arange(1, len(said))
            self.rank[0] = 0
            self.said = pa.array(said, pa.large_binary())


def word_ids(texts: list[bytes], words: Words) -> np.ndarray:
    """Ids of all words, 0 between pieces and between texts."""
    found = b"\n".join(texts).translate(_TABLE).replace(b".", b" . ").split()
    return np.fromiter(map(words.__getitem__, found), np.int64, len(found))


def phrase_keys(ids: np.ndarray) -> np.ndarray:
    """Keys of all words, pairs and triples inside pieces: ids of 21 bits, 0 where a phrase is shorter."""
    one = ids != 0
    two = one[:-1] & one[1:]
    three = two[:-1] & one[2:]
    high = ids << (2 * ID_BITS)
    pair = high[:-1] | ids[1:] << ID_BITS
    return np.concatenate([high[one], pair[two], (pair[:-1] | ids[2:])[three]])


class Trie:
    """Counts of keys. ``lows`` are the first keys of the leaves, prefixes of word ids; each leaf is a hash container."""

    def __init__(self, container: int = CONTAINER):
        self.lows, self.leaves, self.size, self.container = np.zeros(1, np.int64), [Counter()], 0, container

    def add(self, keys: np.ndarray) -> None:
        leaf = np.searchsorted(self.lows, keys, side="right") - 1
        keys = keys[np.argsort(leaf.astype(np.uint16 if len(self.leaves) < 1 << 16 else np.int64), kind="stable")] if len(self.leaves) > 1 else keys
        ends = np.cumsum(np.bincount(leaf, minlength=len(self.leaves))).tolist()
        at = 0
        for k, end in enumerate(ends):
            if end > at:
                container = self.leaves[k]
                self.size -= len(container)
                container.update(keys[at:end].tolist())
                self.size += len(container)
            at = end
        k = 0
        while k < len(self.leaves):
            if len(self.leaves[k]) <= self.container or not self._burst(k):
                k += 1

    def _burst(self, k: int) -> bool:
        """One container becomes two, between the words nearest the root at which its keys differ."""
        old = self.leaves[k]
        keys = np.sort(np.fromiter(old, np.int64, len(old)))
        for shift in (2 * ID_BITS, ID_BITS, 0):
            heads = keys >> shift
            if heads[0] != heads[-1]:
                middle = heads[len(heads) // 2]
                cut = int(middle if middle > heads[0] else heads[np.searchsorted(heads, middle, side="right")]) << shift
                self.leaves[k: k + 1] = [Counter({x: n for x, n in old.items() if x < cut}), Counter({x: n for x, n in old.items() if x >= cut})]
                self.lows = np.insert(self.lows, k + 1, cut)
                return True
        return False

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of the largest subtrees, until no more than ``keep`` are left."""
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in sorted(range(len(self.leaves)), key=lambda k: -len(self.leaves[k])):
            if self.size <= keep:
                break
            leaf, self.leaves[k] = self.leaves[k], Counter()
            self.size -= len(leaf)
            keys.append(np.fromiter(leaf.keys(), np.int64, len(leaf)))
            counts.append(np.fromiter(leaf.values(), np.int64, len(leaf)))
        return np.concatenate(keys), np.concatenate(counts)


_RUNS = "lang string, part int, phrases binary, counts binary"


def _sorted_runs(lang: str, keys: np.ndarray, counts: np.ndarray, words: Words, parts: int) -> Iterator[pa.RecordBatch]:
    """A run of each prefix partition, its phrases in the order of their words' hashes."""
    if not len(keys):
        return
    words.listed()
    one, two, three = keys >> (2 * ID_BITS), keys >> ID_BITS & _MASK, keys & _MASK
    prefix = mix(words.hashes[one] * np.uint64(0x9E3779B97F4A7C15) + words.hashes[two])
    part = ((prefix % np.uint64(parts)).astype(np.int64) + (words.hashes[three] % np.uint64(NEIGHBOURS)).astype(np.int64) * (three > 0)) % parts
    order = np.argsort(words.rank[one] << (2 * ID_BITS) | words.rank[two] << ID_BITS | words.rank[three])
    order = order[np.argsort(part[order].astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")]
    space, none = pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary())
    one, two, three = (words.said.take(pa.array(x[order])) for x in (one, two, three))
    # a word that is not there leaves its space, which is cut off at the end of the phrase
    joined = pc.binary_join_element_wise(one, two, three, space)
    joined = pc.binary_join_element_wise(pc.ascii_rtrim(joined.cast(pa.large_string(), safe=False), " ").cast(pa.large_binary()), pa.scalar(b"\n", pa.large_binary()), none)
    _, offsets, data = joined.buffers()
    offsets, data = np.frombuffer(offsets, np.int64), memoryview(data)
    part, counts, pack = part[order], counts[order], zstandard.ZstdCompressor(level=1)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    yield pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(spans)), pa.array([int(part[a]) for a, _ in spans], pa.int32()), pa.array([pack.compress(data[offsets[a]: offsets[b]]) for a, b in spans], pa.binary()),
         pa.array([pack.compress(counts[a:b].tobytes()) for a, b in spans], pa.binary())], ["lang", "part", "phrases", "counts"])


def _count(parts: int, held: int, container: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted runs of the phrases of a task's texts."""
        words, tries = Words(), {}

        def spill(keep: int) -> Iterator[pa.RecordBatch]:
            for lang, trie in tries.items():
                yield from _sorted_runs(lang, *trie.spill(keep // max(1, len(tries))), words, parts)

        for lang, texts in _by_lang(batches):
            trie = tries.setdefault(lang, Trie(container))
            trie.add(phrase_keys(word_ids(texts, words)))
            if len(words) > WORDS:
                yield from spill(0)
                words, tries = Words(), {}
            elif sum(t.size for t in tries.values()) > held:
                yield from spill(held // 2)
        yield from spill(0)
    return count


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, about ``RUN`` bytes at a time."""
    held, size = {}, 0
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, []).append(text)
                    size += len(text)
                    if size > RUN:
                        yield from held.items()
                        held, size = {}, 0
    yield from held.items()


def _merge(least: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the runs of each (language, partition); runs come sorted by these."""
        unpack, at, held, size = zstandard.ZstdDecompressor(), None, [], 0

        def added(tables: list[pa.Table]) -> pa.Table:
            every = pa.concat_tables(tables).combine_chunks()
            phrase = every.column("phrase").chunk(0).dictionary_encode()
            f = np.bincount(phrase.indices.to_numpy(), weights=every.column("f").to_numpy(), minlength=len(phrase.dictionary))  # exact below 2^53
            return pa.table({"phrase": phrase.dictionary, "f": f.astype(np.int64)})

        def finished() -> Iterator[pa.RecordBatch]:
            done = added(held)
            size_ = pc.add(pc.count_substring(done.column("phrase"), b" "), 1).cast(pa.int32())
            total = pc.sum(pc.if_else(pc.equal(size_, 1), done.column("f"), 0)).as_py()
            done = done.append_column("size", size_).filter(pc.greater_equal(done.column("f"), least))
            yield pa.RecordBatch.from_arrays([pa.array([at[1]]), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([total], pa.int64())], ["lang", "phrase", "size", "f"])
            for batch in done.combine_chunks().to_batches(max_chunksize=50_000):
                yield pa.RecordBatch.from_arrays([pa.array([at[1]] * batch.num_rows, pa.string()), batch.column("phrase").cast(pa.binary()).cast(pa.string()), batch.column("size"),
                                                  batch.column("f")], ["lang", "phrase", "size", "f"])

        for batch in batches:
            for lang, part, phrases, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "phrases", "counts")), strict=True):
                if (part, lang) != at:
                    if held:
                        yield from finished()
                    at, held, size = (part, lang), [], 0
                data = unpack.decompress(phrases)
                f = np.frombuffer(unpack.decompress(counts), np.int64)
                ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
                # every phrase ends with a line feed, which is cut off here
                said = pc.binary_slice(pa.Array.from_buffers(pa.large_binary(), len(f), [None, pa.py_buffer(np.concatenate([[0], ends + 1]).astype(np.int64)), pa.py_buffer(data)]), 0, -1)
                held.append(pa.table({"phrase": said, "f": f}))
                size += len(f)
                if len(held) > 1 and size > 1_000_000:
                    held = [added(held)]
                    size = 0
        if held:
            yield from finished()
    return merge


def phrase_counts(docs: DataFrame, least: int = 10, held: int = HELD, container: int = CONTAINER) -> DataFrame:
    """lang, phrase, size (in words), f: words, pairs and triples with f >= least; and rows of a null phrase whose f add up to a language's words."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(volume // PART_BYTES + 1, docs.sparkSession.sparkContext.defaultParallelism)
    runs = rows.mapInArrow(_count(parts, held, container), _RUNS).repartition(parts, "part", "lang").sortWithinPartitions("part", "lang")
    return runs.mapInArrow(_merge(least), "lang string, phrase string, size int, f long")


def collocations(docs: DataFrame, least: int = 10, most: int = 2000, inside_percent: int = 50, held: int = HELD, container: int = CONTAINER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``most`` highest scores of each language.

    A phrase is dropped if a longer one that holds it occurs ``inside_percent`` per cent as often.
    """
    counts = written(phrase_counts(docs, least, held, container), "phrases")
    totals = counts.filter("phrase IS NULL").groupBy(F.col("lang").alias("_lang")).agg(F.sum("f").alias("n"))
    found = counts.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    said = lambda start, length: F.array_join(F.slice("w", start, length), " ")

    cut = found.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    halves = F.explode(F.array(F.struct(F.lit(True).alias("left"), said(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), said(F.col("k") + 1, F.col("size") - F.col("k")).alias("part"))))
    cut = cut.select("lang", "phrase", "size", "a", "k", halves.alias("h")).select("lang", "phrase", "size", "a", "k", "h.left", "h.part", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).cast("int").alias("share"))
    asked = cut.select("lang", "part", "share").distinct()
    known = counts.filter("phrase IS NOT NULL").select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), "f")
    known = asked.join(known, (F.col("lang") == F.col("_l")) & (F.col("part") == F.col("_p"))).select("_l", "_p", F.col("share").alias("_s"), "f")
    cut = cut.join(known, (F.col("lang") == F.col("_l")) & (F.col("part") == F.col("_p")) & (F.col("share") == F.col("_s")))
    cut = cut.groupBy("lang", "phrase", "size", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr("(cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))

    longer = found.filter("size > 2").select("lang", F.col("a").alias("f"), "w", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("at")).select("lang", "f", said(F.col("at"), F.lit(2)).alias("part"))
    longer = longer.groupBy(F.col("lang").alias("_l"), F.col("part").alias("_p")).agg(F.max("f").alias("_f"))
    best = best.join(longer, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")), "left").filter(F.col("_f").isNull() | (100 * F.col("_f") < inside_percent * F.col("a")))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).alias("share"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= most)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return best.join(totals, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
