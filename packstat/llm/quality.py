"""Quality rules by distribution divergence, in DataFrame functions only.

Every document gets a histogram of character classes and one of common words. They are compared, by
Jensen-Shannon distance (base 2, 0 to 1), with the language's reference, which is the sum over all documents
of that language that pass the base rules. Every value of lang is a language of its own, however it is spelled.
Every language that has such a document is a reference, however few they are. Documents without a language are measured by
the reference whose words are nearest to theirs. Distances are listed only where ``LEAST_DOCUMENTS`` documents or more make up the
reference of the document's own language, the verdict holds for all. A histogram is judged only if the document is long enough for it.

Texts are read once, the counts are checkpointed. Null texts have no words, so the base rules reject them.
Rows that repeat an id are judged separately. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packstat.llm.common import SPACES
from packstat.session import checkpoint

WINDOW = 8
#: Character classes that are counted one after the other, and what is left.
CLASSES = ["[a-z]+", "[A-Z]+", "[\\x20\\x09-\\x0D]+", "[^\\x00-\\x7F]+", "[0-9]+", "[.,;:'\"()?-]+"]
#: Common words of the languages.
COMMON = {
    "en": "the of and to in a is that it for was on are with as be at by this from or an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans sur au par plus pas avec il".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})
#: Least characters in words, and greatest distance, for the character classes; the same for words.
LEAST_CHARS, MOST_CHARS, LEAST_WORDS, MOST_WORDS = 300, 0.30, 150, 0.29
#: Documents that a language's reference needs for its distances to be listed.
LEAST_DOCUMENTS = 20


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window, of a power of two words, found at least twice in the document.

    Element access only: taking a slice for each window would copy the document each time.
    """

    def doubled(h: Column, step: int) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    def hashes(h: Column, step: int) -> Column:
        """Hashes of windows of twice the length, again and again; those past the end are cut off once."""
        if step < window:
            return let(doubled(h, step), lambda x: hashes(x, 2 * step))
        return counted_in(F.slice(h, 1, F.size(h) - window + 1))

    def counted_in(h: Column) -> Column:
        return let(h, counted)

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(places, j + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def places(sorted_: Column) -> Column:
        def same(s: Column, other: Column) -> Column:
            return F.get(sorted_, other)["h"].eqNullSafe(s["h"])

        twice = F.filter(sorted_, lambda s, j: same(s, j - 1) | same(s, j + 1))
        return F.sort_array(F.transform(twice, lambda s: s["p"]))

    def counted(h: Column) -> Column:
        paired = F.sort_array(F.transform(h, lambda x, p: F.struct(x.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(paired, lambda s: let(places(s), covered)))

    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: hashes(h, 1))).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, and the two histograms as arrays of counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col("lang"), text.alias("text")).withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    left, bins, rest = F.col("text"), [], None
    for pattern in CLASSES:
        rest = F.regexp_replace(left, pattern, "")
        bins.append((F.length(left) - F.length(rest)).cast("long"))
        left = rest
    bins.append(F.length(left).cast("long"))
    known = F.filter(F.transform("words", F.lower), lambda w: w.isin(WORDS))
    rows = rows.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), F.array(*bins).alias("classes"),
        F.concat(F.lit(" "), F.array_join(known, "  "), F.lit(" ")).alias("_known"))
    of = [((F.length("_known") - F.length(F.replace("_known", F.lit(f" {w} ")))) / (len(w) + 2)).cast("long") for w in WORDS]
    rest = F.col("n_words") - F.aggregate("_of", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("_of", F.array(*of)).withColumn("common", F.concat("_of", F.array(rest))).drop("_known", "_of")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; 0 if either is empty."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def diverged(sums: Column) -> Column:
        terms = F.zip_with(p, q, lambda x, y: let(F.struct((x / sums["p"]).alias("x"), (y / sums["q"]).alias("y")), lambda s: term(s["x"], (s["x"] + s["y"]) / 2) + term(s["y"], (s["x"] + s["y"]) / 2)))
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))

    sums = F.struct(total(p).alias("p"), total(q).alias("q"))
    return let(sums, lambda s: F.when((s["p"] > 0) & (s["q"] > 0), diverged(s)).otherwise(F.lit(0.0)))


def judge(docs: DataFrame, most_chars: float = MOST_CHARS, most_words: float = MOST_WORDS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, char_distance, word_distance."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = checkpoint(counts(docs).withColumn("base_failed", failed))

    def summed(name: str, size: int) -> Column:
        return F.array(*(F.sum(F.col(name)[i]) for i in range(size))).alias(f"ref_{name}")

    sums = [summed("classes", len(CLASSES) + 1), summed("common", len(WORDS) + 1)]
    good = rows.filter("not base_failed")
    own = (good.filter(F.col("lang").isNotNull()).groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n"), *sums))
    # rows without a language are no key of the join
    known = rows.filter(F.col("lang").isNotNull()).join(own, F.col("lang") == F.col("_lang"), "left")
    far = [F.when(F.col("_lang").isNotNull(), distance(F.col(name), F.col(f"ref_{name}"))).alias(f"_far_{name}") for name in ("classes", "common")]
    known = known.select(*rows.columns, *far, (F.col("_n") >= LEAST_DOCUMENTS).alias("_listed"))
    # references are as few as languages
    all_ = own.agg(F.collect_list(F.struct("ref_classes", "ref_common")).alias("_refs"))
    nearest = F.array_min(F.transform("_refs", lambda ref: F.struct(
        distance(F.col("common"), ref["ref_common"]).alias("common"), distance(F.col("classes"), ref["ref_classes"]).alias("classes"))))
    bare = rows.filter(F.col("lang").isNull()).crossJoin(all_).select(*rows.columns, nearest.alias("_near"))
    bare = bare.select(*rows.columns, F.col("_near.classes").alias("_far_classes"), F.col("_near.common").alias("_far_common"), F.lit(False).alias("_listed"))
    rows = known.unionByName(bare)
    odd = ((F.col("word_chars") >= LEAST_CHARS) & (F.col("_far_classes") > most_chars)) | ((F.col("n_words") >= LEAST_WORDS) & (F.col("_far_common") > most_words))
    listed = [F.when(F.col("_listed"), F.col(f"_far_{name}")).alias(f"{kind}_distance") for name, kind in (("classes", "char"), ("common", "word"))]
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       (~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).alias("kept"), *listed)
