"""The same results in plain SQL over the given tables, for the queries that SQL can express."""

from __future__ import annotations

from faultline.config import CLUSTER_NAMES, LABEL_SEVERITY, QUALITY_WEIGHTS, Config
from faultline.functions.stopwords import ENGLISH_STOP_WORDS
from faultline.functions.text import TOKEN_PATTERN
from faultline.plans.queries import FILTERS, MIN_VECTORS
from faultline.sources.views import FLAG_SEVERITY, LANG_SEVERITY, TABLES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _case(column: str, entries: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {k if isinstance(k, int) else _text(k)} THEN {_text(v)}" for k, v in entries.items())
    return f"CASE {column} {arms} ELSE {default} END"


def _name(column: str) -> str:
    return _case(column, CLUSTER_NAMES, f"concat('Cluster ', {column})")


def _mean(value: str, places: int, digits: int) -> str:
    """The mean in units of the last place, from an exact sum of whole numbers."""
    total = f"CAST(sum(CAST(round(({value}) * {10**digits}) AS HUGEINT)) AS DOUBLE)"
    return f"({total} * {10 ** max(places - digits, 0)} / (count({value}) * {10 ** max(digits - places, 0)}))"


def _half_even_mean(value: str, places: int, digits: int) -> str:
    return f"round_even({_mean(value, places, digits)}, 0) / {10**places}"


def _half_up_mean(value: str, places: int, digits: int) -> str:
    return f"round({_mean(value, places, digits)}, 0) / {10**places}"


def _half_up(value: str, places: int) -> str:
    """Of a value with three decimals."""
    return f"CAST(round(CAST({value} AS DECIMAL(18, 3)), {places}) AS DOUBLE)"


def _percent_of(part: str, whole: str) -> str:
    return f"CAST(round(CAST({part} AS DECIMAL(18, 0)) * 1000 / {whole}, 0) AS DOUBLE) / 10"


SCORE = "round_even(" + " + ".join(f"{d} * CAST({w} AS DOUBLE)" for d, w in QUALITY_WEIGHTS.items()) + ", 3)"

MASTER = """master AS (
    SELECT CAST(s_suppkey AS VARCHAR) AS equipment_id, concat('Type ', s_suppkey % 8) AS equipment_type,
           n_name AS location, CAST(2010 + s_suppkey % 13 AS INTEGER) AS installation_year,
           CAST(2024 - (2010 + s_suppkey % 13) AS INTEGER) AS age_years, r_name AS manufacturer,
           CASE WHEN s_acctbal >= 6000 THEN 'High' WHEN s_acctbal >= 2000 THEN 'Medium' ELSE 'Low' END AS criticality
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

ORDERS = f"""dims AS (
    SELECT concat(l_orderkey, '-', l_linenumber) AS record_id, CAST(l_suppkey AS VARCHAR) AS equipment_id,
           concat('Type ', l_suppkey % 8) AS equipment_type, CAST(l_shipdate AS DATE) AS visit_date,
           concat('TECH-', lpad(CAST(l_partkey % 20 + 1 AS VARCHAR), 3, '0')) AS technician_id,
           concat('Returned ', l_returnflag, ', status ', l_linestatus) AS defect_description,
           l_returnflag AS true_defect_label, {_case("l_returnflag", FLAG_SEVERITY)} AS severity,
           CASE WHEN l_linenumber % 5 < 3 THEN CAST(l_partkey % 180 + 1 AS INTEGER) END AS days_to_failure,
           l_quantity AS repair_duration_hrs, l_extendedprice / 1000 AS downtime_hrs,
           concat('Part ', l_partkey % 9) AS parts_replaced,
           l_quantity / 50 AS data_quality_frequency, l_discount * 10 AS data_quality_freshness,
           l_tax * CAST(12.5 AS DOUBLE) AS data_quality_completeness, l_linenumber / 7 AS data_quality_pertinence,
           CAST(l_linenumber AS INTEGER) AS cluster
    FROM lineitem),
scored AS (SELECT d.*, m.location, {SCORE} AS quality_score FROM dims d LEFT JOIN master m USING (equipment_id)),
features AS (SELECT *, {_name("cluster")} AS defect_cluster_name FROM scored WHERE quality_score >= 0.5)"""

AGG = f"""agg AS (
    SELECT equipment_id, count(record_id) AS total_visits, count(DISTINCT cluster) AS distinct_defects,
           {_half_even_mean("quality_score", 3, 3)} AS avg_quality_score,
           {_half_even_mean("repair_duration_hrs", 3, 6)} AS avg_repair_hrs,
           {_half_even_mean("downtime_hrs", 3, 6)} AS avg_downtime_hrs,
           {_half_even_mean("CASE WHEN severity = 'High' THEN 1 ELSE 0 END", 3, 0)}
               AS pct_high_severity,
           max(visit_date) AS last_visit_date
    FROM features WHERE equipment_id IS NOT NULL GROUP BY equipment_id)"""

DEFECT_DATA = """record_id, equipment_id, equipment_type, location, visit_date, defect_cluster_name, severity,
    days_to_failure, repair_duration_hrs, downtime_hrs, parts_replaced, quality_score"""


def _model(sql: str) -> str:
    return f"WITH {MASTER}, {ORDERS}, {AGG} {sql}"


def _selected(column: str, values) -> str:
    return f"{column} IN ({', '.join(map(_text, values))})" if values else "true"


def _histogram(source: str, column: str) -> str:
    """Bins as their edges define them: closed below, open above, the last one closed."""
    return f"""
    bounds AS (SELECT min({column}) - CASE WHEN min({column}) = max({column}) THEN 0.5 ELSE 0 END AS lo,
                      max({column}) + CASE WHEN min({column}) = max({column}) THEN 0.5 ELSE 0 END AS hi FROM {source}),
    edges AS (SELECT CAST(i AS INTEGER) AS i, CASE WHEN i = 30 THEN hi ELSE i * ((hi - lo) / 30) + lo END AS edge
              FROM range(31) AS g(i) CROSS JOIN bounds),
    bins AS (SELECT i AS bin, edge AS low, lead(edge) OVER (ORDER BY i) AS high FROM edges)
    SELECT bin, round(low, 6) AS bin_start, round(high, 6) AS bin_end, count({column}) AS records
    FROM bins LEFT JOIN {source} ON {column} >= low AND ({column} < high OR bin = 29 AND {column} <= high)
    WHERE high IS NOT NULL GROUP BY bin, low, high"""


_LISTED = ", ".join(_text(w) for w in ENGLISH_STOP_WORDS)
_TOKENS = f"regexp_extract_all(lower(text), '{TOKEN_PATTERN}')"
_WORDS = f"list_filter({_TOKENS}, lambda w: w NOT IN ({_LISTED}))"


def _terms(source: str, keys: str) -> str:
    """CTE `terms_of_<source>`: keys and the list of 1- and 2-grams."""
    return f"""words_of_{source} AS (SELECT {keys}, {_WORDS} AS words FROM {source}),
    terms_of_{source} AS (
        SELECT {keys}, list_concat(words, list_transform(range(1, len(words)),
               lambda i: concat(words[i], ' ', words[i + 1]))) AS terms
        FROM words_of_{source})"""


_VOCABULARY = f"""{_terms("documents", "doc_id, lang")},
    tf AS (SELECT doc_id, lang, term, count(*) AS tf
           FROM (SELECT doc_id, lang, unnest(terms) AS term FROM terms_of_documents) GROUP BY ALL),
    vocabulary AS (
        SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, (SELECT count(*) FROM documents) AS documents,
               ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf
        FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT 3000)"""


def _weighted(counts: str, keys: str) -> str:
    return f"""raw AS (SELECT {keys}, term, (1 + ln(tf)) * idf AS w FROM {counts} JOIN vocabulary USING (term)),
    weighted AS (SELECT {keys}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {keys})) AS weight FROM raw)"""


_TOP_TERMS = f"""{_VOCABULARY}, {_weighted("tf", "doc_id, lang")},
    sizes AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang),
    means AS (SELECT lang, term, round(sum(weight) / any_value(docs), 9) AS score
              FROM weighted JOIN sizes USING (lang) GROUP BY lang, term),
    ranked AS (SELECT lang, term, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS rank
               FROM means WHERE score > 0)"""

VECTORS = """vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""

CENTROIDS = f"""{VECTORS},
    cells AS (SELECT vec_id, label, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM vectors),
    centers AS (SELECT label, pos, avg(x) AS value FROM cells GROUP BY label, pos)"""

RENUMBERED = f"""sizes AS (SELECT label, count(*) AS records FROM embeddings GROUP BY label),
    ids AS (SELECT label, CAST(CASE WHEN records < {MIN_VECTORS} THEN -1 ELSE label END AS INTEGER) AS merged,
                   CAST(CASE WHEN records < {MIN_VECTORS} THEN -1
                        ELSE dense_rank() OVER (PARTITION BY records < {MIN_VECTORS} ORDER BY label) - 1 END
                        AS INTEGER) AS cluster
            FROM sizes),
    renumbered AS (SELECT vec_id, label, cluster FROM embeddings JOIN ids USING (label))"""


def _silhouette(labelings: str, distance: str = "list_distance(a.v, b.v)") -> str:
    """`points(labelling, vec_id, s)` for the relation `labelings(labelling, vec_id, c)`."""
    return f"""{VECTORS},
    sampled AS (SELECT * FROM vectors ORDER BY md5(concat(vec_id, ':', 42)), vec_id LIMIT 2000),
    pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, {distance} AS d
              FROM sampled a JOIN sampled b ON a.vec_id <> b.vec_id),
    labelled AS ({labelings}),
    near AS (SELECT x.labelling, p.i, x.c AS own, y.c AS other, avg(p.d) AS mean_d
             FROM pairs p JOIN labelled x ON x.vec_id = p.i
             JOIN labelled y ON y.vec_id = p.j AND y.labelling = x.labelling GROUP BY ALL),
    sides AS (SELECT labelling, i, any_value(own) AS own, max(CASE WHEN own = other THEN mean_d END) AS a,
                     min(CASE WHEN own <> other THEN mean_d END) AS b
              FROM near GROUP BY labelling, i),
    points AS (SELECT labelling, i AS vec_id,
                      CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0::DOUBLE
                           ELSE (b - a) / greatest(a, b) END AS s
               FROM sides)"""


_BY_LABEL = "SELECT 'label' AS labelling, vec_id, label AS c FROM sampled"
_BY_K = f"""SELECT k AS labelling, vec_id, label % k AS c FROM sampled, range({min(Config().k_values)}, {
    max(Config().k_values) + 1}) AS ks(k)"""

_CONTINGENCY = "SELECT true_defect_label AS label, cluster, count(*) AS n FROM features GROUP BY ALL"
_ARI = f"""cells AS ({_CONTINGENCY}),
    s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS both_sum,
                 (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY label)) AS rows_sum,
                 (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY cluster)) AS cols_sum,
                 (SELECT sum(n) * (sum(n) - 1) / 2 FROM cells) AS total),
    agreement AS (SELECT round(coalesce((both_sum - rows_sum * cols_sum / total)
                         / nullif((rows_sum + cols_sum) / 2 - rows_sum * cols_sum / total, 0), 1), 6) AS ari FROM s)"""

_LINEITEM_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


def oracle_sql() -> dict[str, str]:
    labels = list(LABEL_SEVERITY)
    return {
        "scan_csv_roundtrip": _model(
            "SELECT record_id, equipment_id, equipment_type, location, visit_date, technician_id, defect_description,"
            " true_defect_label, severity, days_to_failure, repair_duration_hrs, downtime_hrs, parts_replaced,"
            " data_quality_frequency, data_quality_freshness, data_quality_completeness, data_quality_pertinence,"
            " quality_score FROM scored"
        ),
        "scan_csv_texts": """
            SELECT concat('WO-', lpad(CAST(doc_id + 1 AS VARCHAR), CAST(greatest(5, len(CAST(doc_id + 1 AS VARCHAR))) AS INTEGER), '0'))
                       AS record_id, text AS defect_description, lang AS true_defect_label,
                   DATE '2022-01-01' + CAST(doc_id % 731 AS INTEGER) AS visit_date FROM documents""",
        "scan_table": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
        "sink_table_roundtrip": _model("SELECT * FROM master"),
        "small_dim_from_rows": f"""
            SELECT {_case("l_returnflag", FLAG_SEVERITY)} AS severity,
                   CASE WHEN l_returnflag = 'N' THEN NULL ELSE 1.0::DOUBLE END AS weight, count(*) AS records
            FROM lineitem GROUP BY l_returnflag""",
        "list_tables": " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS row_count FROM {t}" for t in TABLES),
        "describe_schema": " UNION ALL ".join(
            f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS name, '{t}' AS type, count({c}) AS non_null FROM lineitem"
            for i, (c, t) in enumerate(_LINEITEM_TYPES.items())
        ),
        "first_row": _model(
            "SELECT record_id, equipment_id, equipment_type, visit_date, defect_cluster_name, severity,"
            " days_to_failure, repair_duration_hrs, downtime_hrs, parts_replaced, quality_score FROM features"
            " ORDER BY record_id, visit_date, repair_duration_hrs, downtime_hrs, equipment_id LIMIT 1"
        ),
        "quality_score": _model("SELECT record_id, equipment_id, visit_date, quality_score FROM scored"),
        "quality_filter_pass": _model(
            "SELECT record_id, equipment_id, quality_score FROM scored WHERE quality_score >= 0.5"
        ),
        "quality_filter_reject": _model(
            "SELECT record_id, equipment_id, quality_score FROM scored WHERE quality_score < 0.5"
        ),
        "quality_split": _model(
            "SELECT 'pass' AS tbl, count(*) AS row_count FROM scored WHERE quality_score >= 0.5"
            " UNION ALL SELECT 'reject', count(*) FROM scored WHERE quality_score < 0.5"
        ),
        "feature_table": _model(
            "SELECT record_id, equipment_id, equipment_type, location, visit_date, defect_description,"
            " true_defect_label, cluster, defect_cluster_name, severity, days_to_failure, repair_duration_hrs,"
            " downtime_hrs, parts_replaced, quality_score, data_quality_frequency, data_quality_freshness,"
            " data_quality_completeness, data_quality_pertinence FROM features"
        ),
        "derive_age": _model("SELECT equipment_id, installation_year, age_years FROM master"),
        "severity_lookup": f"""
            WITH named AS (SELECT [{", ".join(map(_text, labels))}][l_linenumber] AS label FROM lineitem)
            SELECT label, {_case("label", LABEL_SEVERITY)} AS severity, count(*) AS records FROM named GROUP BY label""",
        "row_count_audit": _model(
            "SELECT 'equipment_master' AS tbl, count(*) AS row_count FROM master"
            " UNION ALL SELECT 'work_orders', count(*) FROM dims"
            " UNION ALL SELECT 'defect_features', count(*) FROM features"
            " UNION ALL SELECT 'equipment_cluster_agg', count(*) FROM agg"
        ),
        "format_ids": """
            SELECT printf('WO-%05d', o_orderkey) AS record_id, printf('EQ-%04d', o_custkey) AS equipment_id,
                   printf('TECH-%03d', o_custkey % 20 + 1) AS technician_id FROM orders""",
        "visit_dates": """
            SELECT o_orderkey, DATE '2022-01-01' + CAST(o_orderkey % 731 AS INTEGER) AS visit_date,
                   strftime(DATE '2022-01-01' + CAST(o_orderkey % 731 AS INTEGER), '%Y-%m-%d') AS visit_text
            FROM orders""",
        "nullable_when": _model("SELECT record_id, equipment_id, days_to_failure FROM dims"),
        "quality_describe": _model(
            f"""SELECT count(quality_score) AS n, {_half_even_mean("quality_score", 3, 3)} AS mean,
                round_even(stddev_samp(quality_score) * 1000, 0) / 1000 AS std, min(quality_score) AS min,
                round_even(quantile_cont(round(quality_score * 1000), 0.25), 0) / 1000 AS q1,
                round_even(quantile_cont(round(quality_score * 1000), 0.5), 0) / 1000 AS median,
                round_even(quantile_cont(round(quality_score * 1000), 0.75), 0) / 1000 AS q3, max(quality_score) AS max FROM features"""
        ),
        "price_describe": f"""SELECT count(l_extendedprice) AS n, {_half_even_mean("l_extendedprice", 3, 2)} AS mean,
                round_even(stddev_samp(l_extendedprice) * 1000, 0) / 1000 AS std, min(l_extendedprice) AS min,
                round_even(quantile_cont(round(l_extendedprice * 100), 0.25) * 10, 0) / 1000 AS q1,
                round_even(quantile_cont(round(l_extendedprice * 100), 0.5) * 10, 0) / 1000 AS median,
                round_even(quantile_cont(round(l_extendedprice * 100), 0.75) * 10, 0) / 1000 AS q3,
                max(l_extendedprice) AS max FROM lineitem""",
        "event_quantiles": """WITH ranked AS (
                SELECT value, row_number() OVER (ORDER BY value) - 1 AS rank, count(*) OVER () - 1 AS last FROM events WHERE value IS NOT NULL),
            wanted(quantile, share) AS (VALUES ('low', 0.01::DOUBLE), ('middle', 0.5::DOUBLE), ('high', 0.999::DOUBLE))
            SELECT quantile, max(value) FILTER (rank = floor(share * last)) AS lower, max(value) FILTER (rank = ceil(share * last)) AS upper,
                   round(max(share * last - floor(share * last)), 6) AS part
            FROM ranked, wanted GROUP BY quantile""",
        "quality_histogram": f"WITH {MASTER}, {ORDERS}, {_histogram('scored', 'quality_score')}",
        "event_histogram": f"WITH {_histogram('events', 'value')}",
        "date_range": _model("SELECT min(visit_date) AS first_date, max(visit_date) AS last_date FROM dims"),
        "run_summary": f"""WITH {MASTER}, {ORDERS}, {_ARI}
            SELECT (SELECT count(*) FROM scored) AS input_records, (SELECT count(*) FROM features) AS kept_records,
                   round((SELECT count(*) FROM features) * 100.0::DOUBLE / (SELECT count(*) FROM scored), 1) AS pass_pct,
                   (SELECT count(DISTINCT cluster) FROM features WHERE cluster >= 0) AS final_clusters, ari
            FROM agreement""",
        "equipment_agg": _model("SELECT * FROM agg"),
        "top_equipment": _model(
            f"""SELECT equipment_id, total_visits, distinct_defects, round(avg_repair_hrs, 1) AS avg_repair_hrs,
                {_half_up("pct_high_severity * 100", 1)} AS pct_high_severity
                FROM agg ORDER BY total_visits DESC, equipment_id LIMIT 5"""
        ),
        "report_equipment": _model(
            f"""SELECT equipment_id, equipment_type, location, manufacturer, criticality, total_visits,
                distinct_defects, avg_quality_score,
                {_half_up("avg_repair_hrs", 1)} AS avg_repair_hrs,
                {_half_up("avg_downtime_hrs", 1)} AS avg_downtime_hrs,
                {_half_up("pct_high_severity * 100", 1)} AS pct_high_severity, last_visit_date
                FROM agg JOIN master USING (equipment_id)"""
        ),
        "report_defect_data": _model(f"SELECT {DEFECT_DATA} FROM features"),
        "report_filtered": _model(
            f"""SELECT {DEFECT_DATA} FROM features
                WHERE {_selected("equipment_type", FILTERS["equipment_types"])}
                  AND {_selected("severity", FILTERS["severities"])} AND {_selected("location", FILTERS["locations"])}"""
        ),
        "filter_choices": _model(
            "SELECT DISTINCT 'equipment_type' AS field, equipment_type AS value FROM features"
            " UNION ALL SELECT DISTINCT 'severity', severity FROM features"
            " UNION ALL SELECT DISTINCT 'location', location FROM features"
        ),
        "report_monthly_trend": _model(
            f"""SELECT CAST(date_trunc('month', visit_date) AS DATE) AS month, count(*) AS visits,
                {_half_up_mean("quality_score", 3, 3)} AS avg_quality FROM features GROUP BY 1"""
        ),
        "report_kpis": _model(
            "SELECT count(record_id) AS total_work_orders, round(avg(repair_duration_hrs), 6) AS avg_repair_hrs,"
            " round(sum(downtime_hrs), 4) AS total_downtime_hrs FROM features"
        ),
        "report_by_cluster": _model(
            "SELECT defect_cluster_name, count(record_id) AS records FROM features GROUP BY 1"
        ),
        "report_by_severity": _model(
            f"""SELECT severity, count(record_id) AS records,
                {_percent_of("count(record_id)", "(SELECT count(record_id) FROM features)")} AS pct
                FROM features GROUP BY severity"""
        ),
        "report_downtime_by_type": _model(
            "SELECT equipment_type, round(avg(downtime_hrs), 6) AS avg_downtime_hrs FROM features GROUP BY 1"
        ),
        "report_quality_by_type": _model(
            f"""SELECT equipment_type, count(*) AS visits, {_half_up_mean("quality_score", 3, 3)} AS avg_quality
                FROM features GROUP BY 1"""
        ),
        "tokenise": f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents)
            SELECT doc_id, CAST(len(w) AS INTEGER) AS n, array_to_string(w, '|') AS tokens FROM t""",
        "remove_stopwords": f"""WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents)
            SELECT doc_id, CAST(len(w) AS INTEGER) AS n, array_to_string(w, '|') AS words FROM t""",
        "ngrams": f"""WITH {_terms("documents", "doc_id")}
            SELECT doc_id, CAST(len(terms) AS INTEGER) AS n, array_to_string(terms, '|') AS terms
            FROM terms_of_documents""",
        "tfidf_vocabulary": f"""WITH {_VOCABULARY}
            SELECT term, df, cf, documents, round(idf, 6) AS idf FROM vocabulary""",
        "tfidf_weights": f"""WITH {_VOCABULARY}, {_weighted("tf", "doc_id")}
            SELECT doc_id, term, round(weight, 6) AS weight FROM weighted""",
        "tfidf_transform": f"""WITH {_VOCABULARY}, {_terms("conversations", "conv_id, turn")},
            turn_tf AS (SELECT conv_id, turn, term, count(*) AS tf
                        FROM (SELECT conv_id, turn, unnest(terms) AS term FROM terms_of_conversations) GROUP BY ALL),
            {_weighted("turn_tf", "conv_id, turn")}
            SELECT conv_id, turn, term, round(weight, 6) AS weight FROM weighted""",
        "cluster_top_terms": f"""WITH {_TOP_TERMS}
            SELECT lang, CAST(rank AS INTEGER) AS rank, term, round(score, 6) AS score FROM ranked WHERE rank <= 8""",
        "cluster_term_labels": f"""WITH {_TOP_TERMS}
            SELECT lang, string_agg(term, ', ' ORDER BY rank) AS terms FROM ranked WHERE rank <= 6 GROUP BY lang""",
        "embedding_shape": f"""WITH {_VOCABULARY}
            SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM vocabulary) AS vocabulary_size,
                   (SELECT count(*) FROM documents WHERE doc_id NOT IN
                       (SELECT doc_id FROM tf JOIN vocabulary USING (term))) AS zero_vectors,
                   CAST(0 AS BIGINT) AS other_lengths""",
        "svd_residual": "SELECT i AS component, 0.0::DOUBLE AS residual FROM range(64) AS g(i)",
        "sweep_checks": f"""SELECT k, true AS inertia_holds, true AS all_placed, CAST(1 AS BIGINT) AS best_rows
            FROM range({min(Config().k_values)}, {max(Config().k_values) + 1}) AS ks(k)""",
        "taxonomy_records": f"""WITH d AS (
                SELECT *, CAST(doc_id % 50 + 1 AS INTEGER) AS unit, 0.5::DOUBLE + (doc_id % 156) / 10 AS repair,
                       0.30::DOUBLE + (doc_id % 71) / 100 AS data_quality_frequency,
                       0.40::DOUBLE + (doc_id * 7 % 61) / 100 AS data_quality_freshness,
                       0.50::DOUBLE + (doc_id * 11 % 51) / 100 AS data_quality_completeness,
                       0.40::DOUBLE + (doc_id * 13 % 61) / 100 AS data_quality_pertinence FROM documents),
            s AS (SELECT *, {SCORE} AS quality_score FROM d)
            SELECT concat('WO-', lpad(CAST(doc_id + 1 AS VARCHAR),
                          CAST(greatest(5, len(CAST(doc_id + 1 AS VARCHAR))) AS INTEGER), '0')) AS record_id,
                   printf('EQ-%04d', unit) AS equipment_id, concat('Type ', unit % 8) AS equipment_type,
                   concat('Site ', unit % 6) AS location,
                   DATE '2022-01-01' + CAST(doc_id % 731 AS INTEGER) AS visit_date,
                   text AS defect_description, lang AS true_defect_label, {_case("lang", LANG_SEVERITY)} AS severity,
                   CASE WHEN doc_id % 5 < 3 THEN CAST(doc_id % 180 + 1 AS INTEGER) END AS days_to_failure,
                   round(repair, 1) AS repair_duration_hrs, CAST(((5 + doc_id % 156) * (doc_id % 7) + 2) // 4 AS DOUBLE) / 10 AS downtime_hrs,
                   source AS parts_replaced, quality_score, data_quality_frequency, data_quality_freshness,
                   data_quality_completeness, data_quality_pertinence
            FROM s WHERE quality_score >= 0.5""",
        "kmeans_step": f"""WITH {CENTROIDS},
            c AS (SELECT label, list(value ORDER BY pos) AS v FROM centers GROUP BY label),
            placed AS (SELECT vec_id, arg_min(c.label, (list_distance(vectors.v, c.v), c.label)) AS nearest
                       FROM vectors CROSS JOIN c GROUP BY vec_id),
            n AS (SELECT nearest, count(*) AS members FROM placed GROUP BY nearest)
            SELECT nearest AS label, members, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS value
            FROM placed JOIN cells USING (vec_id) JOIN n USING (nearest) GROUP BY nearest, members, pos""",
        "embed_batched": f"""
            WITH words AS (SELECT doc_id, unnest({_TOKENS}) AS word FROM documents),
            hashed AS (SELECT doc_id, CAST(concat('0x', substr(md5(word), 1, 8)) AS BIGINT) AS h FROM words),
            sums AS (SELECT doc_id, (h // 2) % 64 AS pos, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS x
                     FROM hashed GROUP BY ALL),
            norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM sums GROUP BY doc_id)
            SELECT d.doc_id, CAST(g.pos AS INTEGER) AS pos,
                   coalesce(round(x / nullif(norm, 0), 6), 0) AS value
            FROM documents d CROSS JOIN range(64) AS g(pos) LEFT JOIN sums USING (doc_id, pos)
            LEFT JOIN norms USING (doc_id)""",
        "l2_normalise": f"""WITH {VECTORS},
            scaled AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM vectors)
            SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos,
                   round(CASE WHEN norm = 0 THEN unnest(v) ELSE unnest(v) / norm END, 6) AS value FROM scaled""",
        "cluster_centroids": f"""WITH {CENTROIDS}
            SELECT label, CAST(pos AS INTEGER) AS pos, round(value, 6) AS value FROM centers""",
        "nearest_centroid": f"""WITH {CENTROIDS},
            c AS (SELECT label, list(value ORDER BY pos) AS v FROM centers GROUP BY label)
            SELECT vec_id, arg_min(c.label, (list_distance(vectors.v, c.v), c.label)) AS nearest
            FROM vectors CROSS JOIN c GROUP BY vec_id""",
        "inertia": f"""WITH {CENTROIDS}
            SELECT label, count(DISTINCT vec_id) AS members, round(sum((x - value) * (x - value)), 6) AS inertia
            FROM cells JOIN centers USING (label, pos) GROUP BY label""",
        "silhouette_exact": f"""WITH {_silhouette(_BY_LABEL)}
            SELECT round(avg(s), 6) AS silhouette, count(*) AS rows FROM points""",
        "silhouette_points": f"WITH {_silhouette(_BY_LABEL)} SELECT vec_id, round(s, 6) AS silhouette FROM points",
        "silhouette_scalable": f"""WITH {VECTORS},
            pairs AS (SELECT a.vec_id AS i, a.label AS own, b.label AS other,
                             list_distance(a.v, b.v) ** 2 AS d, a.vec_id = b.vec_id AS same
                      FROM vectors a CROSS JOIN vectors b),
            near AS (SELECT i, own, other, sum(d) AS total, count(*) FILTER (NOT same) AS others, count(*) AS members
                     FROM pairs GROUP BY ALL),
            sides AS (SELECT i, max(CASE WHEN own = other AND others > 0 THEN total / others END) AS a,
                             min(CASE WHEN own <> other THEN total / members END) AS b FROM near GROUP BY i)
            SELECT count(*) AS rows, round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0
                   ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM sides""",
        "best_k_from_sweep": f"""WITH {_silhouette(_BY_K)}
            SELECT CAST(labelling AS INTEGER) AS k, round(avg(s), 6) AS silhouette, labelling IN (4, 13) AS at_edge
            FROM points GROUP BY labelling ORDER BY silhouette DESC, k LIMIT 1""",
        "cluster_sizes": "SELECT label, count(*) AS records FROM embeddings GROUP BY label",
        "small_clusters": f"""SELECT label, count(*) AS records FROM embeddings GROUP BY label
            HAVING count(*) < {MIN_VECTORS}""",
        "merge_small_clusters": f"WITH {RENUMBERED} SELECT label, vec_id, merged FROM embeddings JOIN ids USING (label)",
        "reindex_clusters": f"WITH {RENUMBERED} SELECT label, vec_id, cluster FROM renumbered",
        "cluster_names": f"""WITH {RENUMBERED} SELECT label, vec_id, cluster,
            {_name("cluster")} AS defect_cluster_name, {_name("label")} AS raw_name FROM renumbered""",
        "final_cluster_count": f"""WITH {RENUMBERED}
            SELECT count(DISTINCT cluster) AS clusters FROM renumbered WHERE cluster >= 0""",
        "cluster_membership": f"""WITH {RENUMBERED}
            SELECT cluster, {_name("cluster")} AS defect_cluster_name, count(*) AS records,
                   {_percent_of("count(*)", "(SELECT count(*) FROM renumbered)")} AS pct
            FROM renumbered GROUP BY cluster""",
        "cluster_sizes_flagged": f"""WITH {RENUMBERED},
            named AS (SELECT {_name("cluster")} AS defect_cluster_name FROM renumbered)
            SELECT defect_cluster_name, count(*) AS records, contains(defect_cluster_name, 'Other') AS is_other
            FROM named GROUP BY defect_cluster_name""",
        "ari": f"WITH {MASTER}, {ORDERS}, {_ARI} SELECT ari FROM agreement",
        "crosstab_normalised": f"""WITH {MASTER}, {ORDERS},
            cells AS (SELECT true_defect_label AS label, defect_cluster_name AS cluster, count(*) AS n
                      FROM features
                      WHERE true_defect_label IS NOT NULL AND defect_cluster_name IS NOT NULL GROUP BY ALL),
            grid AS (SELECT label, cluster FROM (SELECT DISTINCT label FROM cells)
                     CROSS JOIN (SELECT DISTINCT cluster FROM cells)),
            totals AS (SELECT label, sum(n) AS total FROM cells GROUP BY label)
            SELECT label, cluster, round_even(coalesce(n, 0) / total * 100, 0) / 100 AS share
            FROM grid LEFT JOIN cells USING (label, cluster) JOIN totals USING (label)""",
    }
