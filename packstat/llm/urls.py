"""URL filter: host and path rules, then exact membership in a list of keys by a cascade of Bloom filters.

Level 1 holds the listed keys; level 2 those keys of the corpus's universe that level 1 takes for
listed by mistake; level 3 the listed keys that level 2 takes for mistakes, and so on until no
mistake is left. A key is judged by the first level that lacks it, which is exact for every key
of the universe. A filter is an array of 64-bit words that comes as a scalar subquery, so pages
are judged where they are read, without a join. The words are counted before a filter is made;
a list beyond ``limit`` bytes of filter is matched by an equi-join instead.

Null or empty urls, and urls without ``://``, have empty host and path, fit no rule and are
allowed. Rows that repeat a url are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packstat.session import checkpoint

#: (verdict, host and path prefix)
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Hash functions of a level; a level mistakes a key with probability two to the minus this.
HASHES = 4
#: Bytes that all filters together may have.
LIMIT = 64 << 20


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, "^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]))):  # the longest is tried first, so it comes last
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(HASHES)]


def _filter(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row: the words of a filter. The words are or-ed where they lie before they meet."""
    place = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits))).alias("p"))
    words = place.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("v"))
    dense = keys.sparkSession.range(-(-bits // 64)).join(words, F.col("id") == F.col("w"), "left")
    listed = F.array_sort(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0).cast("long")).alias("v"))))
    return dense.agg(F.transform(listed, lambda x: x["v"]).alias("words"))


def _holds(key: Column, level: int, bits: int, words: Column) -> Column:
    out = F.lit(True)
    for p in _places(key, level, bits):
        out &= F.getbit(F.element_at(words, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")) == 1
    return out


class Cascade:
    """Exact membership for the keys of ``universe`` (key string, listed boolean), each key once."""

    def __init__(self, universe: DataFrame, limit: int = LIMIT):
        self.universe = universe
        self.levels: list[tuple[int, DataFrame]] = []
        self.bytes, self.joins = 0, False
        inside, outside = universe.filter("listed").select("key"), universe.filter("not listed").select("key")
        n = inside.count()
        while n:
            bits = max(64, math.ceil(n * HASHES / math.log(2)))
            self.bytes += -(-bits // 64) * 8
            if self.bytes > limit:
                self.joins = True
                return
            level = len(self.levels) + 1
            words = checkpoint(_filter(inside, level, bits))
            self.levels.append((bits, words))
            wrong = checkpoint(outside.filter(_holds(F.col("key"), level, bits, words.scalar())))
            inside, outside = wrong, inside
            n = inside.count()

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed; keys beyond it may be mistaken."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels), 0, -1):
            bits, words = self.levels[level - 1]
            out = F.when(~_holds(key, level, bits, words.scalar()), F.lit(level % 2 == 0)).otherwise(out)
        return out

    def mark(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """``rows`` with a column that tells whether ``key`` is listed."""
        if not self.joins:
            return rows.withColumn(name, F.coalesce(self.listed(F.col(key)), F.lit(False)))
        keys = self.universe.filter("listed").select(F.col("key").alias("_key"), F.lit(True).alias("_listed"))
        return rows.join(keys, F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce("_listed", F.lit(False))).drop("_key", "_listed")


def referred(pages: DataFrame) -> DataFrame:
    """The universe of page addresses (host and path); those that some url reaches with a ``ref`` parameter are listed."""
    host, path = parts(F.col("url"))
    seen = F.coalesce(F.col("url").rlike(r"[?&]ref="), F.lit(False))
    return pages.groupBy(F.concat(host, path).alias("key")).agg(F.bool_or(seen).alias("listed"))


def judge(pages: DataFrame, universe: DataFrame, rules: list[tuple[str, str]] = RULES, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict: the rule's, or block if the address is listed, else allow."""
    host, path = parts(F.col("url"))
    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_address", F.concat("host", "path"))
    rows = Cascade(checkpoint(universe), limit).mark(rows, "_address", "_listed")
    verdict = F.coalesce(said, F.when(F.col("_listed"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
