"""TF-IDF with 1- and 2-grams.

Fitting shuffles only partially aggregated term counts. Applying a fitted vocabulary shuffles nothing: terms are
looked up and weighed in the same task. Texts are cut into words, numbered and counted in Arrow batches, many at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from faultline.functions import arrays, words as cuts
from faultline.functions.stopwords import ENGLISH_STOP_WORDS
from faultline.functions.text import bigrams, drop_stop_words, tokens, unigrams_and_bigrams

# The vocabulary is model state on the driver and in every task. A term takes about 100 bytes, and 64 weights of a
# reduced dimension 512 more.
MAX_VOCABULARY_BYTES, TERM_BYTES = 64 << 20, 640

#: Texts, and bytes of text, whose words are counted at once, and different pairs that a task counts before it hands them on.
COUNTED, HELD_PAIRS = (2048, 4 << 20), 1 << 21


@dataclass(frozen=True)
class TfidfModel:
    terms: tuple[str, ...]
    idf: tuple[float, ...]
    documents: int
    stop_words: tuple[str, ...]

    def __len__(self) -> int:
        return len(self.terms)


def with_words(df: DataFrame, text: str, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    return df.withColumn("words", drop_stop_words(tokens(F.col(text)), stop_words))


def with_terms(df: DataFrame, text: str, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """Add `terms`. The words are their own projection because the n-grams refer to them several times."""
    return with_words(df, text, stop_words).withColumn("terms", unigrams_and_bigrams(F.col("words"))).drop("words")


def term_totals(lists: DataFrame, column: str) -> DataFrame:
    """Corpus and document frequency of every term, in one shuffle of partial sums.

    Each document contributes all its terms to `cf`, and its distinct terms to `df`; no document is regrouped.
    """
    both = lists.select(F.posexplode(F.array(F.col(column), F.array_distinct(column))).alias("kind", "list"))
    return (
        both.select("kind", F.explode("list").alias("term"))
        .groupBy("term")
        .agg(F.count_if(F.col("kind") == 1).alias("df"), F.count_if(F.col("kind") == 0).alias("cf"))
    )


def word_totals(texts: DataFrame, text: str, stop_words: Sequence[str]) -> DataFrame:
    """`term_totals` of single words. A task counts the words of some MB of text before it hands them on."""
    edges, stops = cuts.alphabet(texts.sparkSession), pa.array(sorted(stop_words), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = cuts.members(edges)
        for part in cuts.text_parts(batches, "_lower", *COUNTED):
            found, of = cuts.cut(part.column("_lower"), word)
            coded = found.dictionary_encode()
            listed = coded.dictionary
            keys, df, cf = cuts.in_texts(cuts.rows_of(of), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
            totals = pa.RecordBatch.from_arrays([listed.take(pa.array(keys)), pa.array(df), pa.array(cf)], names=["term", "df", "cf"])
            yield totals.filter(pc.invert(pc.is_in(totals.column("term"), value_set=stops)))

    counted = texts.select(cuts.lowered(F.col(text)).alias("_lower")).mapInArrow(run, "term string, df long, cf long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def pair_totals(texts: DataFrame, text: str, stop_words: Sequence[str], usable: Sequence[str]) -> DataFrame:
    """`term_totals` of pairs of usable words, as numbers: the place of the first word times their number and one, and the
    place of the second."""
    numbering = cuts.Numbering(usable, stop_words, cuts.alphabet(texts.sparkSession))
    base = len(usable) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for part in cuts.text_parts(batches, "_lower", *COUNTED):
            ids, of = numbering(part.column("_lower"))
            at = np.flatnonzero(cuts.neighbours(of) & (ids[:-1] < numbering.unknown) & (ids[1:] < numbering.unknown))
            held.append(cuts.in_texts(cuts.rows_of(of)[at], ids[at] * base + ids[at + 1]))
            if sum(len(x[0]) for x in held) > HELD_PAIRS:
                merged = _merged(held)
                held = [merged]
                if len(merged[0]) > HELD_PAIRS // 2:
                    yield _totals(merged)
                    held = []
        if held:
            yield _totals(_merged(held))

    counted = texts.select(cuts.lowered(F.col(text)).alias("_lower")).mapInArrow(run, "code long, df long, cf long")
    return counted.groupBy("code").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys, df, cf = (np.concatenate(x) for x in zip(*held))
    return cuts.added(keys, [df, cf])


def _totals(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["code", "df", "cf"])


def idf(df: Column, documents: Column) -> Column:
    return F.log((documents + 1) / (df + 1)) + 1


def vocabulary(
    texts: DataFrame,
    text: str,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    max_features: int = 3000,
    min_df: int = 2,
) -> DataFrame:
    """The most frequent terms of the corpus that occur in at least `min_df` documents; ties in term order.

    Single words are counted first. A pair is never more frequent than either of its words, so only pairs of words
    at least as frequent as the last word that would make the list can enter it. Counting just these is exact, and
    replaces a shuffle of all distinct pairs of the corpus by one of at most a few million.
    """
    if max_features * TERM_BYTES > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of {max_features} terms is more than {MAX_VOCABULARY_BYTES >> 20} MB of model")
    spark = texts.sparkSession
    documents = texts.agg(F.count(F.lit(1))).scalar()
    order = [F.desc("cf"), F.asc("term")]

    singles = word_totals(texts, text, stop_words).filter(F.col("df") >= min_df)
    frequent = singles.orderBy(*order).limit(2 * max_features).collect()
    floor = frequent[max_features - 1].cf if len(frequent) >= max_features else 0
    if len(frequent) == 2 * max_features and frequent[-1].cf >= floor:
        # Too many ties: every pair may count.
        words = with_words(texts.select(text), text, stop_words)
        doubles = term_totals(words.select(bigrams(F.col("words")).alias("pairs")), "pairs").filter(F.col("df") >= min_df)
    else:
        # In the order of the words the numbers of pairs are in the order of the terms: a blank is less than what is in words.
        usable = sorted(r.term for r in frequent if r.cf >= floor)
        numbered = pair_totals(texts, text, stop_words, usable).filter(F.col("df") >= min_df)
        best = numbered.orderBy(F.desc("cf"), "code").limit(max_features).collect()
        base = len(usable) + 1
        named = [(f"{usable[r.code // base]} {usable[r.code % base]}", r.df, r.cf) for r in best]
        doubles = spark.createDataFrame(named, singles.schema)

    best_singles = spark.createDataFrame(frequent[:max_features], singles.schema)
    return (
        best_singles.unionByName(doubles)
        .orderBy(*order)
        .limit(max_features)
        .select("term", "df", "cf", documents.alias("documents"), idf(F.col("df"), documents).alias("idf"))
    )


def fit(
    texts: DataFrame,
    text: str,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    max_features: int = 3000,
    min_df: int = 2,
) -> TfidfModel:
    rows = sorted(vocabulary(texts, text, stop_words, max_features, min_df).collect(), key=lambda r: r.term)
    if not rows:
        raise ValueError("no term is left: the texts are empty, or min_df is too high")
    n = rows[0].documents
    return TfidfModel(
        terms=tuple(r.term for r in rows),
        idf=tuple(math.log((n + 1) / (r.df + 1)) + 1 for r in rows),
        documents=n,
        stop_words=tuple(stop_words),
    )


class Counter:
    """Counts of a model's terms in texts of lower case, as sparse vectors."""

    def __init__(self, spark: SparkSession, model: TfidfModel) -> None:
        pieces = [(t.split(" "), i) for i, t in enumerate(model.terms)]
        place: dict[str, int] = {}
        for words, _ in pieces:
            for word in words:
                place.setdefault(word, len(place))
        self.numbering = cuts.Numbering(list(place), model.stop_words, cuts.alphabet(spark))
        self.terms, self.base = len(model.terms), len(place) + 1
        self.single = np.full(self.base, -1, np.int64)
        pairs = []
        for words, i in pieces:
            if len(words) == 1:
                self.single[place[words[0]]] = i
            elif len(words) == 2:
                pairs.append((place[words[0]] * self.base + place[words[1]], i))
        pairs.sort()
        self.codes, self.pairs = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        self.opens, self.closes = np.zeros(self.base, bool), np.zeros(self.base, bool)
        self.opens[self.codes // self.base], self.closes[self.codes % self.base] = True, True

    def __call__(self, texts: pa.Array) -> pa.StructArray:
        ids, of = self.numbering(texts)
        rows = cuts.rows_of(of)
        term = self.single[ids]
        known = term >= 0
        keys = [rows[known] * self.terms + term[known]]
        if len(self.codes):
            at = np.flatnonzero(cuts.neighbours(of) & self.opens[ids[:-1]] & self.closes[ids[1:]])
            code = ids[at] * self.base + ids[at + 1]
            near = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[near] == code
            keys.append(rows[at[hit]] * self.terms + self.pairs[near[hit]])
        found, times = np.unique(np.concatenate(keys), return_counts=True)
        offsets = np.searchsorted(found, np.arange(len(texts) + 1) * self.terms)
        indices, values = _lists(offsets, found % self.terms, times.astype(np.float64))
        kind, size = np.zeros(len(texts), np.int8), np.full(len(texts), self.terms, np.int32)
        return pa.StructArray.from_arrays(
            [pa.array(kind), pa.array(size), indices, values], names=["type", "size", "indices", "values"]
        )


def weigh(counts: pa.StructArray, idf_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sublinear tf times idf, rows scaled to length one: (offsets, term ids, weights)."""
    offsets, ids, tf = arrays.sparse(counts)
    weights = (1.0 + np.log(tf)) * idf_of[ids]
    rows = len(offsets) - 1
    row_of = np.repeat(np.arange(rows), np.diff(offsets))
    norms = np.sqrt(np.bincount(row_of, weights * weights, minlength=rows))
    return offsets, ids, weights / norms[row_of]


def _lists(offsets: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    ends = pa.array(offsets, pa.int32())
    return (
        pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
        pa.ListArray.from_arrays(ends, pa.array(weights, pa.float64())),
    )


def weights(df: DataFrame, text: str, model: TfidfModel, keep: Sequence[str]) -> DataFrame:
    """`keep` and `tfidf`, a sparse vector. A text without a known term gets the zero vector."""
    keep = list(keep)
    idf_of, counter = np.array(model.idf), Counter(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in cuts.text_parts(batches, "_lower"):
            counts = counter(part.column("_lower"))
            ids, values = _lists(*weigh(counts, idf_of))
            kind, size, _, _ = counts.flatten()
            vectors = pa.StructArray.from_arrays([kind, size, ids, values], names=["type", "size", "indices", "values"])
            yield arrays.with_column(part, keep, tfidf=vectors)

    schema = StructType([df.schema[c] for c in keep] + [StructField("tfidf", VectorUDT())])
    return df.select(*keep, cuts.lowered(F.col(text)).alias("_lower")).mapInArrow(run, schema)


def long_weights(df: DataFrame, text: str, model: TfidfModel, keep: Sequence[str]) -> DataFrame:
    """One row per document and known term."""
    keep = list(keep)
    idf_of, counter = np.array(model.idf), Counter(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in cuts.text_parts(batches, "_lower"):
            ids, values = _lists(*weigh(counter(part.column("_lower")), idf_of))
            yield arrays.with_column(part, keep, term_ids=ids, weights=values)

    counted = df.select(*keep, cuts.lowered(F.col(text)).alias("_lower"))
    schema = StructType(
        [df.schema[c] for c in keep]
        + [
            StructField("term_ids", ArrayType(IntegerType(), False)),
            StructField("weights", ArrayType(DoubleType(), False)),
        ]
    )
    exploded = counted.mapInArrow(run, schema).select(
        *keep, F.explode(F.arrays_zip("term_ids", "weights")).alias("cell")
    )
    return (
        exploded.select(*keep, F.col("cell.term_ids").alias("term_id"), F.col("cell.weights").alias("weight"))
        .join(F.broadcast(term_table(df.sparkSession, model)), "term_id")
        .select(*keep, "term", "weight")
    )


def term_table(spark, model: TfidfModel) -> DataFrame:
    return spark.createDataFrame(list(enumerate(model.terms)), "term_id int, term string")
