"""Edges of the row-level operators on small frames."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from faultline.config import CLUSTER_NAMES, Config
from faultline.functions import scalars, text as txt
from faultline.functions.stopwords import ENGLISH_STOP_WORDS
from faultline.operators import clusters, features, quality, quantiles, tfidf, validate
from faultline.plans import reports
from faultline.sources import tables

DIMS = "data_quality_frequency double, data_quality_freshness double, data_quality_completeness double, data_quality_pertinence double"


def values(df, column):
    return [r[column] for r in df.collect()]


def test_score_rounds_half_even_like_arrays(spark):
    rng = np.random.default_rng(7)
    dims = np.round(rng.uniform(0.3, 1.0, (3000, 4)), 2)
    rows = [(i, *map(float, d)) for i, d in enumerate(dims)]
    got = values(quality.with_score(spark.createDataFrame(rows, "i int, " + DIMS)).orderBy("i"), "quality_score")
    want = np.round(dims[:, 0] * 0.25 + dims[:, 1] * 0.30 + dims[:, 2] * 0.25 + dims[:, 3] * 0.20, 3)
    assert got == want.tolist()


def test_score_is_recomputed_and_null_is_in_neither_set(spark):
    df = spark.createDataFrame(
        [("a", 0.5, 0.5, 0.5, 0.5, 9.9), ("b", 0.49, 0.5, 0.5, 0.5, 9.9), ("c", None, 0.9, 0.9, 0.9, 9.9)],
        "id string, " + DIMS + ", quality_score double",
    )
    kept, rejected = quality.split(quality.with_score(df))
    assert values(kept, "id") == ["a"] and values(kept, "quality_score") == [0.5]
    assert values(rejected, "id") == ["b"]


@pytest.mark.parametrize(
    "x", [[2.0, 2.0], list(range(31)), [i / 1000 for i in range(300, 901)], [i / 100 for i in range(101)], [-1.5, 0.0, 7.25]]
)
def test_histogram_bins_are_those_of_array_libraries(spark, x):
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    rows = quality.histogram(df, "x").collect()
    counts, edges = np.histogram(np.array(x, float), 30)
    assert [r.records for r in rows] == counts.tolist() and [r.bin for r in rows] == list(range(30))
    assert np.allclose([r.bin_start for r in rows] + [rows[-1].bin_end], edges, atol=1e-6)


def test_means_are_rounded_once(spark):
    df = spark.createDataFrame(
        [("tie", 0.612)] * 2 + [("tie", 0.613)] * 2 + [("below", 0.612)] * 501 + [("below", 0.613)] * 500, "g string, x double"
    ).repartition(7)
    got = {r.g: (r.up, r.even) for r in df.groupBy("g").agg(
        scalars.mean_half_up(F.col("x"), 3, 3).alias("up"), scalars.mean_half_even(F.col("x"), 3, 3).alias("even")).collect()}
    assert got == {"tie": (0.613, 0.612), "below": (0.612, 0.612)}
    # A total of 0.6124999999996 is not a tie.
    close = spark.createDataFrame([(0.6124999999996,)], "x double")
    assert close.select(scalars.mean_half_up(F.col("x"), 3, 13)).first()[0] == 0.612
    shares = spark.createDataFrame([(1, 8), (1, 16), (49, 400), (0, 3)], "n long, total long")
    assert [r[0] for r in shares.select(scalars.percent_of(F.col("n"), F.col("total"))).collect()] == [12.5, 6.3, 12.3, 0.0]


def test_describe_is_at_three_places(spark):
    import pandas as pd

    x = [0.3, 0.301, 0.302, 0.4, 0.555, 0.9]
    row = quality.describe(spark.createDataFrame([(v,) for v in x] + [(None,)], "x double"), "x").first()
    want = pd.Series(x).describe().round(3)
    assert list(row) == [want[c] for c in ("count", "mean", "std", "min", "25%", "50%", "75%", "max")]


def test_names_for_known_other_and_unknown_ids(spark):
    df = spark.createDataFrame([(-1,), (0,), (6,), (7,), (12,)], "cluster int")
    assert values(clusters.with_names(df), "defect_cluster_name") == [
        CLUSTER_NAMES[-1], CLUSTER_NAMES[0], CLUSTER_NAMES[6], "Cluster 7", "Cluster 12",
    ]


def test_clusters_of_19_and_20(spark):
    df = spark.createDataFrame([(c,) for c, n in ((3, 20), (5, 19), (8, 40)) for _ in range(n)], "raw int")
    got = {(r.raw, r.cluster) for r in clusters.reindex(df, "raw", 20).collect()}
    assert got == {(3, 0), (5, -1), (8, 1)}
    assert {r.raw for r in clusters.small(df, "raw", 20).collect()} == {5}
    assert clusters.reindex(df, "raw", 20).count() == 79


def test_small_side_falls_back_to_a_plain_join(spark):
    df = spark.range(50)
    _, small = tables.compact(df, 10)
    assert not small
    assert tables.compact(df, 50)[1]


def test_equipment_aggregate_edges(spark):
    day = dt.date(2024, 1, 1)
    rows = [
        ("r1", "E1", 0, 0.5, 1.0, 2.0, "High", day),
        ("r2", "E1", -1, 0.7, 2.0, 2.0, None, day + dt.timedelta(1)),
        (None, "E1", None, None, None, None, "Low", day),
        ("r4", None, 0, 0.9, 1.0, 1.0, "High", day),
    ]
    df = spark.createDataFrame(
        rows,
        "record_id string, equipment_id string, cluster int, quality_score double, repair_duration_hrs double,"
        " downtime_hrs double, severity string, visit_date date",
    )
    (row,) = features.equipment_agg(df).collect()
    assert row.asDict() == {
        "equipment_id": "E1", "total_visits": 2, "distinct_defects": 2, "avg_quality_score": 0.6,
        "avg_repair_hrs": 1.5, "avg_downtime_hrs": 2.0, "pct_high_severity": 0.333,
        "last_visit_date": day + dt.timedelta(1),
    }


def test_filters_without_selection_do_not_restrict(spark):
    df = spark.createDataFrame([("T1", "High", "A"), ("T2", None, "B")], "equipment_type string, severity string, location string")
    assert reports.filtered(df).count() == 2
    assert reports.filtered(df, equipment_types=[], severities=["High"]).count() == 1
    choices = {(r.field, r.value) for r in reports.filter_choices(df).collect()}
    assert ("severity", None) not in choices and len(choices) == 5


def test_crosstab_fills_absent_pairs_and_drops_missing_ones(spark):
    rows = [("a", 0), ("a", 0), ("a", 1), ("b", 1), ("c", 2), ("c", 2), ("c", 2), ("c", None), (None, 0), (None, None)]
    cells = validate.contingency(spark.createDataFrame(rows, "t string, c int"), "t", "c")
    long = {(r.label, r.cluster): r.share for r in validate.crosstab_cells(cells).collect()}
    want = {("a", "0"): 0.67, ("a", "1"): 0.33, ("b", "1"): 1.0, ("c", "2"): 1.0}
    assert long == {(t, c): want.get((t, c), 0.0) for t in "abc" for c in "012"}
    wide = {r.label: (r["0"], r["1"], r["2"]) for r in validate.crosstab(cells).collect()}
    assert wide == {"a": (0.67, 0.33, 0.0), "b": (0.0, 1.0, 0.0), "c": (0.0, 0.0, 1.0)}


def _pair_count_ari(a, b):
    """Definition by brute force over all pairs."""
    n = len(a)
    pairs = [(a[i] == a[j], b[i] == b[j]) for i in range(n) for j in range(i)]
    both, rows, cols = (sum(map(f, pairs)) for f in (lambda p: p[0] and p[1], lambda p: p[0], lambda p: p[1]))
    expected = rows * cols / len(pairs)
    room = (rows + cols) / 2 - expected
    return (both - expected) / room if room else 1.0


@pytest.mark.parametrize("case", range(4))
def test_ari_against_all_pairs(spark, case):
    rng = np.random.default_rng(case)
    a = rng.integers(0, 4, 60).tolist() if case else [0] * 10
    b = rng.integers(0, 3, 60).tolist() if case else [0] * 10
    df = spark.createDataFrame(list(zip(a, b)), "t int, c int")
    assert validate.ari(validate.contingency(df, "t", "c")).first().ari == pytest.approx(_pair_count_ari(a, b), abs=1e-6)


def test_stop_list_is_the_library_default():
    assert list(ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_tokens_of_any_script(spark):
    df = spark.createDataFrame([("5 MΩ, 40µF; 65°C at L2",), ("a",), (None,), ("The Pump_1 leaks",)], "t string")
    assert values(df.select(txt.tokens(F.col("t")).alias("x")), "x") == [
        ["mω", "40µf", "65", "at", "l2"], [], [], ["the", "pump_1", "leaks"],
    ]
    out = values(tfidf.with_terms(df, "t"), "terms")
    assert out == [["mω", "40µf", "65", "l2", "mω 40µf", "40µf 65", "65 l2"], [], [], ["pump_1", "leaks", "pump_1 leaks"]]


def _plain_vocabulary(texts, stop, size, min_df):
    """Counts without any pruning."""
    import re
    from collections import Counter

    cf, df = Counter(), Counter()
    for t in texts:
        words = [w for w in re.findall(r"\w{2,}", t.lower()) if w not in stop]
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        cf.update(terms)
        df.update(set(terms))
    return sorted(((-cf[t], t, df[t]) for t in cf if df[t] >= min_df))[:size]


@pytest.mark.parametrize("size", [3, 10, 40, 5000])
def test_pruned_pair_counts_are_exact(spark, size):
    rng = np.random.default_rng(size)
    vocab = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocab, rng.integers(1, 25), p=np.arange(30, 0, -1) / 465)) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(-r.cf, r.term, r.df) for r in tfidf.vocabulary(df, "t", max_features=size).collect()]
    assert sorted(got) == _plain_vocabulary(texts, set(ENGLISH_STOP_WORDS), size, 2)


def test_weights_have_length_one_and_unknown_text_is_zero(spark):
    df = spark.createDataFrame(
        [(1, "pump leak pump leak pump"), (2, "pump leak"), (3, "bearing noise"), (4, ""), (5, "noise")], "id int, t string"
    )
    model = tfidf.fit(df, "t")
    assert set(model.terms) == {"pump", "leak", "pump leak", "noise"} and model.documents == 5
    rows = {r.id: r.tfidf for r in tfidf.weights(df, "t", model, ["id"]).collect()}
    assert {i: round(v.norm(2), 9) for i, v in rows.items()} == {1: 1.0, 2: 1.0, 3: 1.0, 4: 0.0, 5: 1.0}
    idf = dict(zip(model.terms, model.idf))
    raw = np.array([(1 + math.log(tf)) * idf[t] for t, tf in (("leak", 2), ("pump", 3), ("pump leak", 2))])
    order = [model.terms.index(t) for t in ("leak", "pump", "pump leak")]
    assert np.allclose(rows[1].toArray()[order], raw / np.linalg.norm(raw))


def test_empty_vocabulary_is_an_error(spark):
    with pytest.raises(ValueError):
        tfidf.fit(spark.createDataFrame([("a b c",)], "t string"), "t")


def test_formatted_values(spark):
    row = spark.range(1).select(
        scalars.padded_id("EQ", F.lit(7), 4).alias("a"),
        scalars.padded_id("EQ", F.lit(123456), 4).alias("b"),
        scalars.iso_date(scalars.offset_date("2022-01-01", F.lit(730))).alias("c"),
        scalars.age_in(2024, F.lit(2010)).alias("d"),
        scalars.keep_when(F.lit(False), F.lit(1)).alias("e"),
        scalars.percent(F.lit(0.0625)).alias("f"),
    ).first()
    assert tuple(row) == ("EQ-0007", "EQ-123456", "2024-01-01", 14, None, 6.3)


def test_config_defaults():
    cfg = Config()
    assert list(cfg.k_values) == list(range(4, 14))
    assert (cfg.quality_threshold, cfg.min_cluster_size, cfg.embedding_dims) == (0.50, 20, 64)
    assert sum(cfg.quality_weights.values()) == pytest.approx(1.0)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 5001, 60_000])
def test_quantiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.normal(size=n), np.repeat(rng.normal(), n // 3), np.exp(rng.normal(0, 9, n // 2))])
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.999, "f": 1.0}
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    row = quantiles.quantiles(df, "x", shares).first()
    ordered = np.sort(x)
    for name, share in shares.items():
        at = share * (len(x) - 1)
        low, part = int(np.floor(at)), at - np.floor(at)
        assert row[name].lower == ordered[low] and row[name].part == part
        assert row[name].upper == ordered[low + (part > 0)]


def test_quantiles_of_nothing_and_of_a_constant(spark):
    none = quantiles.quantiles(spark.createDataFrame([(None,)], "x double"), "x", {"q": 0.5}).collect()
    assert [r.q for r in none] == [None]
    same = quantiles.quantiles(spark.range(1000).select(F.lit(2.5).alias("x")), "x", {"q": 0.5, "r": 0.75}).first()
    assert (same.q.lower, same.q.upper, same.r.lower) == (2.5, 2.5, 2.5)


def test_describe_of_five_decimals_and_of_too_many(spark):
    x = np.round(np.random.default_rng(5).uniform(-40, 40, 3001), 5)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    row, want = quality.describe(df, "x", digits=5, few=False).first(), np.quantile(np.rint(x * 1e5), [0.25, 0.5, 0.75])
    assert [row.q1, row.median, row.q3] == (np.rint(want / 100) / 1000).tolist()
    assert quality.describe(df, "x", digits=5).first() == row
    with pytest.raises(Exception, match="more than 3 decimals"):
        quality.describe(df, "x").collect()
