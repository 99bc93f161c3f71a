"""What the search for groups and the weighing of texts cost: texts are cut in batches, rows are read as bytes, few times."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from faultline.functions import arrays, text as txt, words
from faultline.operators import kmeans, svd, tfidf
from faultline.plans import taxonomy

ODD = [None, "", "a", "_", "ab", "a b", "中", "中文", "𝒜", "𝒜𝒜", "İZMİR ΟΔΟΣ", "ẞẞ ß", "x\x00yz", "٣٣ é é", "5 MΩ, 40µF; 65°C"]


def odd_texts(n=400):
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x20, 0x250)] + list("\n\tİΣς中文한𝒜😀𐐀_abc   9")
    some = lambda: rng.choice(letters) if rng.random() < 0.9 else chr(rng.choice([rng.randrange(0x80, 0xD800), rng.randrange(0xE000, 0x110000)]))
    return ODD + ["".join(some() for _ in range(rng.randrange(60))) for _ in range(n)]


def test_words_are_cut_in_batches_where_regular_expressions_cut_them(spark):
    df = spark.createDataFrame(list(enumerate(odd_texts())), "i int, t string")
    edges = words.alphabet(spark)

    def run(batches):
        word = words.members(edges)
        for part in words.text_parts(batches, "_lower", 37, 900):
            assert part.num_rows <= 37
            found, of = words.cut(part.column("_lower"), word)
            yield arrays.with_column(part, ["i"], w=pa.ListArray.from_arrays(pa.array(of, pa.int32()), found))

    cut = {r.i: r.w for r in df.select("i", words.lowered(F.col("t")).alias("_lower")).mapInArrow(run, "i int, w array<string>").collect()}
    assert cut == {r.i: r.w for r in df.select("i", txt.tokens(F.col("t")).alias("w")).collect()}


def test_words_at_the_ends_of_texts_stay_apart():
    word = words.members(np.array([ord("a"), ord("z") + 1]))
    column = pa.array(["zz", "ab cd", "ef", "", "g", "hi", None, "j", "kl "]).slice(1)
    found, cuts = words.cut(column.fill_null(""), word)
    assert found.to_pylist() == ["ab", "cd", "ef", "hi", "kl"] and cuts.tolist() == [0, 2, 3, 3, 3, 4, 4, 4, 5]
    assert words.neighbours(cuts).tolist() == [True, False, False, False]
    nothing, cuts = words.cut(pa.array(["", ""]), word)
    assert len(nothing) == 0 and cuts.tolist() == [0, 0, 0] and len(words.neighbours(cuts)) == 0


def test_counts_in_texts():
    texts, keys = np.array([0, 0, 0, 1, 1, 2]), np.array([7, 7, 3, 7, 9, 9])
    assert [x.tolist() for x in words.in_texts(texts, keys)] == [[3, 7, 9], [1, 2, 2], [1, 3, 2]]
    assert [len(x) for x in words.in_texts(texts[:0], keys[:0])] == [0, 0, 0]
    assert [x.tolist() for x in words.added(keys, [texts])] == [[3, 7, 9], [0, 1, 3]]


@pytest.mark.parametrize("held", [1 << 21, 3])
def test_terms_of_odd_texts_are_those_of_the_plain_counts(spark, monkeypatch, held):
    monkeypatch.setattr(tfidf, "HELD_PAIRS", held)
    df = spark.createDataFrame([(t,) for t in odd_texts() + ["ab cd ab", "Ab CD the ab", "ab cd", "cd"]], "t string")
    counted = {r.term: (r.df, r.cf) for r in tfidf.vocabulary(df, "t", max_features=500).collect()}
    terms = tfidf.with_terms(df, "t").select("terms")
    plain = {r.term: (r.df, r.cf) for r in tfidf.term_totals(terms, "terms").filter("df >= 2").collect()}
    ranked = sorted(plain, key=lambda t: (-plain[t][1], t))[:500]
    assert counted == {t: plain[t] for t in ranked} and "ab cd" in counted


def test_texts_are_not_cut_row_by_row(spark):
    df = spark.createDataFrame([(1, "pump leak pump leak"), (2, "pump leak"), (3, None)], "id int, t string")
    model = tfidf.fit(df, "t")
    models = taxonomy.Models(model, SimpleNamespace(components=np.eye(len(model))), np.zeros((1, len(model))))
    for found in (tfidf.weights(df, "t", model, ["id"]), tfidf.long_weights(df, "t", model, ["id"]), taxonomy.predict(df, "t", models)):
        shown = found._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in shown and "UDF" not in shown


def test_long_vectors_keep_nothing_for_each_row_and_model(spark, monkeypatch):
    """12 bytes per row and model were kept in the executors' caches, and read in every pass."""

    def kept(*_):
        raise AssertionError("an anchor")

    monkeypatch.setattr(kmeans, "_anchor", kept)
    rng = np.random.default_rng(3)
    x = np.concatenate([m + rng.normal(0, 0.5, (60, kmeans.WIDE)) for m in rng.normal(0, 4, (4, kmeans.WIDE))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3, "id")
    points = kmeans.points_of(kmeans.with_row_hash(frame, "id", "embedding"))
    fit = kmeans.best_of(kmeans.fit_many(points, [(4, r) for r in range(5)]), 4)
    assert fit.converged and sorted(np.bincount(kmeans.nearest(x, fit.centers))) == [60] * 4
    assert fit.distances == len(x) * 4 * fit.iterations
    blocks = kmeans._packed(points, kmeans.WIDE)
    assert blocks.count() <= 3 * -(-len(x) // arrays.BLOCK_ROWS) < len(x)


def test_equal_distances_go_to_the_first_center():
    scores = np.array([[1.0, 5.0, 2.0], [1.0, 4.0, 2.0], [0.0, 4.0, 2.0]])
    best, share = kmeans._nearest_shares(scores)
    assert best.tolist() == [0.0, 4.0, 2.0] and share.argmax(axis=0).tolist() == [2, 1, 0] and share.sum() == 3


def test_weights_are_read_twice_for_all_passes(spark):
    """They were read as vectors, number by number, in each of eight passes."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(8)
    rows = [(Vectors.sparse(40, sorted(rng.choice(40, 6, replace=False).tolist()), rng.random(6).tolist()),) for _ in range(90)]
    df = spark.createDataFrame(rows, StructType([StructField("tfidf", VectorUDT())]))
    fitted = svd.fit(df.mapInArrow(run, df.schema), 40, 4, oversample=6)
    dense = np.array([r[0].toArray() for r in rows])
    assert np.allclose(fitted.singular_values[:2], np.linalg.svd(dense, compute_uv=False)[:2], rtol=1e-2)
    assert read.value == 2 * len(rows)


def test_rows_in_one_value_come_back():
    rows = np.random.default_rng(1).normal(size=(300, 5))
    column = arrays.packed(rows)
    assert len(column) == -(-300 // arrays.BLOCK_ROWS)
    assert np.array_equal(arrays.unpacked(column, 5), rows)
    assert np.array_equal(arrays.unpacked(column.slice(1), 5), rows[arrays.BLOCK_ROWS :])
    assert arrays.unpacked(column.slice(0, 0), 5).shape == (0, 5)
