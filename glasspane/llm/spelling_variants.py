"""Spelling variants: words that one inserted, deleted or replaced code point makes of one another, and the common form of each.

Of the bigrams of a word an edit touches two at most, so two words within one edit share one of the three bigrams of each
that are rarest in the whole word table, at places that differ by one at most. Bigrams are ordered by how many words hold
them, and a word is entered under its three rarest alone. A shared bigram that the edit left whole has the edit wholly on
its left or wholly on its right, so a key is the bigram with all that stands on one of its sides, the shorter word's length,
which limits the places, and half of what stands on the other side, since the edit spares one half of it. Keys are hashes;
every pair under one is verified by its edit distance. Pairs are rows from the first, no group is held in a task, and a key
with many words is split by the skew handling of joins.

Defined cases: null texts have no words; null ids read as empty in the hash; ties of the largest count go to the smallest
word by code points; forms strictly grow (by `factor`), so following them ends; equal rows each count; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, settle

#: A run of letters; least code points of a word and least occurrences; how much more frequent a form is; one in so many runs
#: of the query loses a code point.
LETTERS, CHARS, OCCURRENCES, FACTOR, TYPOS = r"A-Za-zÀ-ÿ", 7, 2, 10, 31
RAREST = 3
#: Bigram tables of up to so many rows are broadcast, larger ones joined.
BIGRAMS = 1 << 16


def with_typo(run: Column, doc_id: Column, one_in: int = TYPOS) -> Column:
    """The run without one code point where `one_in` divides the crc32 of `<doc_id>:<run>`."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typos: bool = False, chars: int = CHARS, least: int = OCCURRENCES) -> DataFrame:
    """(word, n): words of at least `chars` code points with at least `least` occurrences in whole texts; only A-Z is lower-cased."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{chars},}}"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run")).withColumn("run", F.translate("run", ascii_uppercase, ascii_lowercase))
    word = with_typo(F.col("run"), F.col("id")) if typos else F.col("run")
    return rows.select(word.alias("word")).where(F.length("word") >= chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """(word, n, first): the places, from 1, of each word's three rarest bigrams."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.where(F.length("word") > 1).select("word", "n", F.explode(places).alias("at")).withColumn("gram", F.expr("substring(word, at, 2)"))
    held = settle(grams.groupBy("gram").agg(F.count_distinct("word").alias("held")), "bigrams", sweep=True)
    ranked = grams.join(F.broadcast(held) if held.count() <= BIGRAMS else held, "gram")
    order = F.array_sort(F.collect_list(F.struct("held", "gram", "at")))
    return ranked.groupBy("word").agg(F.first("n").alias("n"), F.slice(order, 1, RAREST)["at"].alias("first"))


def key_sql(size: str) -> str:
    """Keys of `word` under its places `first`, for pairs whose shorter word has `size` code points.

    at + 1 code points up to the end of a bigram, or `of_right` from its start on, are kept; of the rest, `free` long in the
    shorter word, the edit spares the first half or the second.
    """
    free_right, of_right = f"({size} - at - 1)", "(length(word) - at + 1)"
    free_left = f"({size} - {of_right})"
    half = lambda n: f"CAST({n} div 2 AS INT)"
    keys = [
        (free_right, f"xxhash64(0, at, {size}, left(word, at + 1 + {half(free_right)}))"),
        (free_right, f"xxhash64(1, at, {size}, left(word, at + 1), right(word, {free_right} - {half(free_right)}))"),
        (free_left, f"xxhash64(2, {of_right}, {size}, left(word, {half(free_left)}), right(word, {of_right}))"),
        (free_left, f"xxhash64(3, {of_right}, {size}, right(word, {of_right} + {free_left} - {half(free_left)}))"),
    ]
    return "array_distinct(array_compact(flatten(transform(first, at -> array(" + ", ".join(f"IF({free} < 0, NULL, {key})" for free, key in keys) + ")))))"


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): pairs of words of a (word, n) table at edit distance one, each once. Words of one code point have no bigram and no pair."""
    entered = settle(rarest_bigrams(words), "rarest-bigrams", sweep=True)
    short = entered.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(F.expr(key_sql("length(word)"))).alias("key"))
    long = entered.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(F.concat(*[F.expr(key_sql(f"(length(word) - {d})")) for d in (0, 1)])).alias("key"))
    found = short.join(long, "key").where("length(b) > length(a) OR a < b")
    return found.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n and root for each row of a (word, n) table.

    form: the near word of largest n (ties: the smallest), if that is `factor` times the word's n at least; root: the end of the
    chain of forms. Chains are halved in each round, by joins of the words that have a form.
    """
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "other")).alias("best"))
    known = words.join(near, "word", "left").withColumn("form_n", -F.col("best.minus"))
    good = F.col("form_n") >= F.col("n") * factor
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.other")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    known = settle(known, "word-forms", sweep=True)
    ends = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    moved = True
    while moved:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = settle(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "word-roots", sweep=True)
        moved = not ends.where("moved").isEmpty()
        ends = ends.drop("moved")
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(settle(word_counts(read_table(spark, sf_dir, "documents"), typos=True), "words", sweep=True))
