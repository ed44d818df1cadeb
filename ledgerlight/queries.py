"""Queries over the driver's tables, each with SQL that DuckDB runs over the same ones where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import clean, stats
from .operators import accounts, curves, encode, models, ranks, rules, segments, similarity
from .sources import extracts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TYPES = ["click", "error", "purchase", "signup", "view"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EV = "ev AS (SELECT user_id, ts, event_id, event_type, value, (epoch_us(ts) - 1704067200000000) / 86400e6 AS t FROM events)"
RW = "rw AS (SELECT l.*, o_custkey, o_orderpriority, o_orderdate, CASE WHEN l_returnflag = 'R' AND l_quantity > 49 THEN 1 ELSE 0 END AS y FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey)"
SC = "sc AS (SELECT d.doc_id, d.n_chars, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ev(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value", clean.days(F.col("ts"), "2024-01-01").alias("t"))


def rw(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return t(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey").withColumn("y", ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)).cast("int"))


def sc(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", "n_chars").join(t(spark, d, "labels").select("doc_id", "toxic"), "doc_id")


def r6(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums does not show; minus zero is zero."""
    return df.select(*((F.round(F.col(f"`{c}`"), places) + F.lit(0.0)).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes))


# sources, cleaning, encoding


@query("SELECT n_nationkey, n_name, n_regionkey, NULL::INT AS r_regionkey, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region")
def scan_union_relaxed(spark, d):
    return extracts.union_relaxed([t(spark, d, "nation"), t(spark, d, "region")])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def dedup_keep_first(spark, d):
    keys = ["l_orderkey", "l_linenumber"]
    return extracts.keep_first(t(spark, d, "lineitem"), keys, ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select(*keys, "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def dedup_exact_rows(spark, d):
    return t(spark, d, "orders").select("o_orderstatus", "o_orderpriority").dropDuplicates()


@query(f"WITH {RW} SELECT o_custkey, count(*) AS n FROM rw WHERE y = 0 AND o_custkey NOT IN (SELECT o_custkey FROM rw WHERE y = 1) GROUP BY o_custkey")
def anti_join_accounts(spark, d):
    x = rw(spark, d)
    return extracts.without_accounts(x.where("y = 0"), x.where("y = 1"), "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN ltrim(c_custkey::VARCHAR, '0') = '' THEN '0' ELSE ltrim(c_custkey::VARCHAR, '0') END AS account FROM customer")
def account_normalize(spark, d):
    raw = F.concat(F.lit("  "), F.lpad(F.col("c_custkey").cast("string"), 12, "0"), F.lit(" "))
    return t(spark, d, "customer").select("c_custkey", clean.account_key(raw).alias("account"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def multi_format_dates(spark, d):
    k, x = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(x, "yyyy-MM-dd")).when(k == 1, F.date_format(x, "yyyyMMdd")).when(k == 2, F.date_format(x, "dd-MMM-yyyy")).otherwise("no date")
    return t(spark, d, "orders").select("o_orderkey", clean.parse_date(raw).alias("day"))


@query("""WITH x AS (SELECT 'c_name' AS "column", c_name AS v FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'c_acctbal', c_acctbal::VARCHAR FROM customer)
SELECT "column", count(*) AS rows, count(v) AS non_null, count(TRY_CAST(trim(v) AS DOUBLE)) AS numeric, count(DISTINCT v) AS "distinct",
CASE WHEN count(TRY_CAST(trim(v) AS DOUBLE)) >= 0.95 * greatest(count(*), 1) THEN 'numeric_str' WHEN count(DISTINCT v) <= 50 THEN 'lowcard' ELSE 'highcard' END AS kind FROM x GROUP BY 1""")
def column_kinds(spark, d):
    c = t(spark, d, "customer").select("c_name", "c_mktsegment", F.col("c_acctbal").cast("string").alias("c_acctbal"))
    return encode.kinds(encode.column_stats(c, c.columns))


@query("""WITH lv AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part WHERE p_type < 'M')), v AS (SELECT p_partkey, nullif(p_type, 'ECONOMY') AS p_type FROM part)
SELECT p_partkey, CASE WHEN v.p_type IS NULL THEN NULL ELSE coalesce(code, (SELECT count(*) FROM lv))::INT END AS code FROM v LEFT JOIN lv ON v.p_type = lv.p_type""")
def label_encode(spark, d):
    p = t(spark, d, "part")
    codes = encode.label_codes(p.where("p_type < 'M'"), "p_type")
    return p.select("p_partkey", encode.label_encode(F.nullif("p_type", F.lit("ECONOMY")), codes).alias("code"))


FREQ = """WITH g AS (SELECT nullif(p_brand, 'Brand#11') AS b FROM part WHERE p_size <= 25), f AS (SELECT b, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b)
SELECT p_partkey, {} AS freq FROM (SELECT p_partkey, nullif(p_brand, 'Brand#11') AS b FROM part WHERE p_size > 10) p LEFT JOIN f ON p.b = f.b"""


def _freq(spark, d, nulls: bool) -> DataFrame:
    p = t(spark, d, "part").withColumn("b", F.nullif("p_brand", F.lit("Brand#11")))
    table = encode.frequencies(p.where("p_size <= 25"), "b", count_nulls=nulls)
    return r6(encode.frequency_encode(p.where("p_size > 10"), "b", table, "freq", null_is_zero=nulls).select("p_partkey", "freq"))


@query(FREQ.format("CASE WHEN p.b IS NOT NULL THEN round(coalesce(n, 0) / (SELECT count(b) FROM g), 6) END"))
def freq_encode(spark, d):
    return _freq(spark, d, False)


@query(FREQ.format("round(coalesce(n, 0) / (SELECT count(*) FROM g), 6)"))
def freq_encode_train(spark, d):
    return _freq(spark, d, True)


@query("""SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS "c_mktsegment==BUILDING", (c_mktsegment = 'MACHINERY')::INT AS "c_mktsegment==MACHINERY" FROM customer""")
def one_hot(spark, d):
    return t(spark, d, "customer").select("c_custkey", *encode.one_hot("c_mktsegment", ["BUILDING", "MACHINERY"]))


@query(f"WITH {RW} SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::INT AS days__l_shipdate_minus_o_orderdate FROM rw")
def date_gaps(spark, d):
    return rw(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", *encode.date_gaps(encode.date_pairs("l_shipdate", ["o_orderdate"])))


@query("SELECT o_orderkey, isodow(o_orderdate)::INT AS weekday, day(o_orderdate)::INT AS day, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def calendar_features(spark, d):
    return t(spark, d, "orders").select("o_orderkey", *encode.calendar("o_orderdate"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_discount = 0)::INT AS isnull__d, (l_tax = 0)::INT AS isnull__t, (l_discount = 0)::INT + (l_tax = 0)::INT AS n_null_raw FROM lineitem")
def null_indicators(spark, d):
    x = t(spark, d, "lineitem").withColumns({"d": F.nullif("l_discount", F.lit(0.0)), "t": F.nullif("l_tax", F.lit(0.0))})
    return x.select("l_orderkey", "l_linenumber", "l_partkey", *(clean.null_flag(F.col(c)).alias(f"isnull__{c}") for c in "dt"), clean.null_count("d", "t").alias("n_null_raw"))


@query("""SELECT c_custkey, (c_acctbal > 0)::INT AS positive, (c_mktsegment IN ('BUILDING'))::INT AS yes FROM customer""")
def to_flags(spark, d):
    c = t(spark, d, "customer")
    yes = F.when(F.col("c_mktsegment") == "BUILDING", " y ").otherwise("no")
    return c.select("c_custkey", clean.to_flag(F.col("c_acctbal"), c.schema["c_acctbal"].dataType).alias("positive"), clean.to_flag(yes, c.schema["c_name"].dataType).alias("yes"))


@query("SELECT p_partkey, CASE WHEN p_size <= 0 OR p_size > 40 THEN NULL WHEN p_size <= 10 THEN 0 WHEN p_size <= 20 THEN 1 ELSE 2 END::INT AS band FROM part")
def age_bands(spark, d):
    return t(spark, d, "part").select("p_partkey", clean.band(F.col("p_size"), (0, 10, 20, 40)).alias("band"))


@query(f"""WITH {RW} SELECT c AS "column", round(avg(CASE WHEN y = 0 THEN z END), 6) AS rate_0, round(avg(CASE WHEN y = 1 THEN z END), 6) AS rate_1 FROM
(SELECT y, 'd' AS c, (l_discount = 0)::INT AS z FROM rw UNION ALL SELECT y, 't', (l_tax = 0)::INT FROM rw) GROUP BY c""")
def null_rates_by_class(spark, d):
    x = rw(spark, d).withColumns({"d": F.nullif("l_discount", F.lit(0.0)), "t": F.nullif("l_tax", F.lit(0.0))})
    return r6(encode.null_rates(x, ["d", "t"], "y"))


@query(f"""WITH {RW} SELECT y, 'o_orderdate' AS "column", min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last, 1.0::DOUBLE AS coverage FROM rw GROUP BY y UNION ALL
SELECT y, 'l_shipdate', min(l_shipdate)::DATE, max(l_shipdate)::DATE, 1.0::DOUBLE FROM rw GROUP BY y""")
def date_range_by_class(spark, d):
    return r6(encode.date_ranges(rw(spark, d), ["o_orderdate", "l_shipdate"], "y"))


@query("""SELECT c AS "column", round(max(n) / sum(n), 6) AS share FROM (SELECT 'p_brand' AS c, p_brand AS v, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY 2) GROUP BY 1""")
def top_value_share(spark, d):
    return r6(encode.top_shares(t(spark, d, "part"), ["p_brand", "p_type", "p_size"]))


AUC = "SELECT '{c}' AS \"column\", (SELECT (sum(CASE WHEN f = 1 THEN r END) - sum(f) * (sum(f) + 1) / 2.0) / (sum(f)::DOUBLE * sum(1 - f)) FROM (SELECT f, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM (SELECT (l_returnflag = 'R')::INT AS f, {c} + 0.0 AS v FROM lineitem))) AS auc"


@query("SELECT \"column\", round(auc, 6) AS auc FROM (" + " UNION ALL ".join(AUC.format(c=c) for c in NUMBERS) + ")")
def univariate_auc(spark, d):
    return r6(curves.auc(t(spark, d, "lineitem").withColumn("f", (F.col("l_returnflag") == "R").cast("int")), NUMBERS, "f"))


@query("""WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b, rank() OVER (ORDER BY l_tax + 0.0) + (count(*) OVER (PARTITION BY l_tax + 0.0) - 1) / 2.0 AS c FROM lineitem)
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(a, b), 6) AS rho FROM k UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(a, c), 6) FROM k UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(b, c), 6) FROM k""")
def spearman_matrix(spark, d):
    x = t(spark, d, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_tax") + 0.0).alias("l_tax"))
    return r6(curves.spearman(x, x.columns))


_FIVE = [*NUMBERS, "2 * l_quantity"]
_KEPT = ["TRUE"] + [" AND ".join(f"(NOT k{i} OR abs(coalesce(r{i}_{j}, 0)) < 0.95)" for i in range(j)) for j in range(1, 5)]


@query("WITH k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c} + 0.0) + (count(*) OVER (PARTITION BY {c} + 0.0) - 1) / 2.0 AS x{i}" for i, c in enumerate(_FIVE)) + " FROM lineitem), c AS (SELECT " + ", ".join(f"corr(x{i}, x{j}) AS r{i}_{j}" for j in range(5) for i in range(j)) + " FROM k), s0 AS (SELECT *, TRUE AS k0 FROM c), "
       + ", ".join(f"s{j} AS (SELECT *, {_KEPT[j]} AS k{j} FROM s{j - 1})" for j in range(1, 5)) + " " + " UNION ALL ".join(f"SELECT '{n}' AS feature FROM s4 WHERE k{i}" for i, n in enumerate([*NUMBERS, "twice"])))
def spearman_filter(spark, d):
    x = t(spark, d, "lineitem").select(*NUMBERS, (F.col("l_quantity") * 2).alias("twice"))
    kept = encode.correlation_filter([tuple(r) for r in curves.spearman(x, x.columns).collect()], x.columns)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


# accounts


@query(f"""WITH {EV}, g AS (SELECT *, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS gap, (row_number() OVER w - 1) / count(*) OVER (PARTITION BY user_id) >= 0.8 AS late FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
a AS (SELECT user_id, count(*) AS n, avg(value) AS m, max(value) AS mx, min(value) AS mn, coalesce(stddev_samp(value), 0) AS sd, avg((hour(ts) < 6)::INT) AS night, avg((value <= 3)::INT) AS tiny, avg((value >= 50 AND abs(value - round_even(value / 10, 0) * 10) < 0.005)::INT) AS rnd, avg(coalesce((gap < 3600)::INT, 0)) AS burst,
greatest((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / 86400 / 30, 1) AS mo, avg(CASE WHEN late THEN value END) AS la, avg(CASE WHEN NOT late THEN value END) AS ea FROM g GROUP BY user_id)
SELECT user_id, n, round(ln(1 + m), 6) AS log_avg, round(ln((mx + .01) / (m + .01)), 6) AS spikiness, round(ln((mn + .01) / (m + .01)), 6) AS floor, round(sd / (m + .01), 6) AS cv, round(night, 6) AS night_rate, round(tiny, 6) AS tiny_rate, round(rnd, 6) AS round_rate, round(burst, 6) AS burst_rate, round(ln(n / mo), 6) AS log_tx_per_month, round(coalesce(ln((la + 1) / (ea + 1)), 0), 6) AS late_vs_early FROM a""")
def mss_tx_features(spark, d):
    return r6(accounts.small_signals(ev(spark, d), "user_id", "ts", "event_id", "value"))


@query("SELECT user_id, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY 1, 2) GROUP BY user_id")
def mss_mix_entropy(spark, d):
    return r6(accounts.mixes(ev(spark, d), "user_id", "event_type", TYPES).select("user_id", "entropy"))


EDGE = "e AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _edges(spark, d):
    return rw(spark, d).select("o_custkey", "l_suppkey")


@query(f"WITH {EDGE}, p AS (SELECT x.a, count(DISTINCT y.a) AS degree FROM e x JOIN e y ON x.s = y.s AND x.a <> y.a GROUP BY x.a) SELECT DISTINCT e.a AS o_custkey, coalesce(degree, 0) AS degree FROM e LEFT JOIN p ON e.a = p.a")
def shared_token_degree(spark, d):
    return accounts.token_degrees(_edges(spark, d), "o_custkey", "l_suppkey")


@query(f"""WITH {EV}, p AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / count(*) OVER (PARTITION BY user_id) AS pos FROM ev), q AS (SELECT *, min(pos) OVER (PARTITION BY user_id, event_type) AS f FROM p)
SELECT user_id, count(DISTINCT event_type) AS tokens, round(coalesce(avg(CASE WHEN pos >= 0.8 THEN (f >= 0.8)::INT END), 0), 6) AS late_new_share FROM q GROUP BY user_id""")
def mss_device_share(spark, d):
    return r6(accounts.new_token_shares(ev(spark, d), "user_id", "ts", "event_id", "event_type"))


@query("SELECT c_custkey, round(-ln(count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) / count(*) OVER (PARTITION BY c_nationkey) + 1e-4), 6) AS surprisal FROM customer")
def mss_type_surprisal(spark, d):
    return r6(accounts.type_surprisal(t(spark, d, "customer"), "c_custkey", "c_mktsegment", "c_nationkey"))


@query("""WITH p AS (SELECT c_custkey, c_mktsegment, CASE WHEN a <= 25 THEN 0 WHEN a <= 35 THEN 1 WHEN a <= 45 THEN 2 WHEN a <= 55 THEN 3 WHEN a <= 65 THEN 4 ELSE 5 END AS b, (rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0) / count(*) OVER () AS p FROM (SELECT *, 18 + c_custkey % 60 AS a FROM customer))
SELECT c_custkey, round(p - median(p) OVER (PARTITION BY c_mktsegment, b), 6) AS residual FROM p""")
def mss_income_residual(spark, d):
    return r6(accounts.group_residuals(t(spark, d, "customer").withColumn("age", 18 + F.col("c_custkey") % 60), "c_custkey", "c_acctbal", "age", "c_mktsegment"))


@query(f"""WITH {EV}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM ev), a AS (SELECT user_id, count(*) AS n, coalesce(avg(gap), 0) AS m, coalesce(stddev_pop(gap), 0) AS sd, coalesce(stddev_pop(ln(1 + greatest(gap, 0))), 0) AS ls, max(t) - min(t) AS span, coalesce(avg((gap <= 0)::INT), 0) AS same,
avg((hour(ts) < 6 OR hour(ts) >= 23)::INT) AS night, sqrt(avg(cos(2 * pi() * t / 7)) ** 2 + avg(sin(2 * pi() * t / 7)) ** 2) AS r0, sqrt(avg(cos(2 * pi() * t / 30.44)) ** 2 + avg(sin(2 * pi() * t / 30.44)) ** 2) AS r1 FROM g GROUP BY user_id)
SELECT user_id, round(ln(1 + n / greatest(span, 1)), 6) AS tm_log_rate, round((sd - m) / greatest(sd + m, 1e-9), 6) AS tm_burstiness, round(sd / greatest(m, 1e-9), 6) AS tm_cv, round(ls, 6) AS tm_log_gap_sd, round(ln(1 + span), 6) AS tm_active_span, round(same, 6) AS tm_same_day_share, round(r0, 6) AS tm_rhythm_0, round(r1, 6) AS tm_rhythm_1, round(night, 6) AS tm_night_share FROM a""")
def timing_block(spark, d):
    return r6(accounts.timing(ev(spark, d), "user_id", "t", "event_id"))


_CLR = ", ".join(f"ln(greatest(avg((event_type = '{c}')::INT), 1e-6)) AS l{k}" for k, c in enumerate(TYPES))
_MEAN = "(" + " + ".join(f"l{k}" for k in range(5)) + ") / 5"


@query(f"""WITH a AS (SELECT user_id, {_CLR}, avg(ln(1 + value)) AS lm, coalesce(stddev_samp(ln(1 + value)), 0) AS ls, max(value) AS mx, sum(value) AS s, avg((value % 1000 = 0)::INT) AS rd FROM events GROUP BY user_id),
h AS (SELECT user_id, -sum(p * ln(p)) AS h FROM (SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type) GROUP BY user_id)
SELECT a.user_id, {", ".join(f"round(l{k} - {_MEAN}, 6) AS cp_clr_{c}" for k, c in enumerate(TYPES))}, round(h, 6) AS cp_channel_entropy, round(lm, 6) AS cp_log_amt_mean, round(ls, 6) AS cp_log_amt_sd, round(mx / s, 6) AS cp_max_share, round(rd, 6) AS cp_round_share FROM a JOIN h ON a.user_id = h.user_id""")
def composition_block(spark, d):
    return r6(accounts.composition(ev(spark, d), "user_id", "event_type", "value", TYPES))


@query("""WITH n AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), s AS (SELECT DISTINCT event_type AS s FROM events), u AS (SELECT DISTINCT user_id FROM events),
g AS (SELECT u.user_id, x.s AS a, y.s AS b FROM u CROSS JOIN s x CROSS JOIN s y), c AS (SELECT user_id, a, b, count(*) AS c FROM n WHERE b IS NOT NULL GROUP BY 1, 2, 3)
SELECT g.user_id, g.a AS from_state, g.b AS to_state, round((coalesce(c, 0) + 0.5::DOUBLE) / sum(coalesce(c, 0) + 0.5::DOUBLE) OVER (PARTITION BY g.user_id, g.a), 6) AS p FROM g LEFT JOIN c ON g.user_id = c.user_id AND g.a = c.a AND g.b = c.b""")
def transition_block(spark, d):
    return r6(accounts.transitions(ev(spark, d), "user_id", "t", "event_id", "event_type", TYPES))


@query("WITH p AS (" + ORACLES["transition_block"].replace("round((coalesce(c, 0) + 0.5::DOUBLE)", "((coalesce(c, 0) + 0.5::DOUBLE)").replace("PARTITION BY g.user_id, g.a), 6) AS p", "PARTITION BY g.user_id, g.a)) AS p") + ") SELECT user_id, round(sum(CASE WHEN from_state = to_state THEN p ELSE 0 END) / 5, 6) AS dy_self_trans, round(-sum(p * ln(p)) / 5, 6) AS dy_entropy FROM p GROUP BY user_id")
def transition_features(spark, d):
    return r6(accounts.transition_features(accounts.transitions(ev(spark, d), "user_id", "t", "event_id", "event_type", TYPES), "user_id", len(TYPES)))


@query("SELECT user_id, round(ln(1 + count(*)), 6) AS sc_log_n, round(ln(1 + sum(value)), 6) AS sc_log_sum FROM events GROUP BY user_id")
def scale_block(spark, d):
    return r6(accounts.scale(ev(spark, d), "user_id", "value"))


@query("SELECT user_id, round(avg(value), 6) AS nm_value FROM events GROUP BY user_id")
def numeric_block(spark, d):
    return r6(accounts.numeric(ev(spark, d), "user_id", ["value"]))


def _season(c: str, name: str) -> str:
    return ", ".join(f"round({f}(2 * pi() * ({c} - {p} * floor({c} / {p})) / {p}), 6) + 0.0 AS dt_{w}_{f}_{name}" for w, p in (("week", "7::DOUBLE"), ("year", "365.25::DOUBLE")) for f in ("sin", "cos"))


@query(f"""WITH {RW}, g AS (SELECT o_custkey, min((epoch_us(o_orderdate) - 946684800000000) / 86400e6) AS p, min((epoch_us(l_shipdate) - 946684800000000) / 86400e6) AS s FROM rw GROUP BY o_custkey)
SELECT o_custkey, round(ln(1 + greatest(1000 - p, 0)), 6) AS dt_recency_o_orderdate, 0 AS dt_missing_o_orderdate, {_season("p", "o_orderdate")}, round(ln(1 + greatest(1000 - s, 0)), 6) AS dt_recency_l_shipdate, 0 AS dt_missing_l_shipdate, round(ln(1 + greatest(s - p, 0)), 6) AS dt_gap_l_shipdate, {_season("s", "l_shipdate")} FROM g""")
def date_block(spark, d):
    return r6(accounts.dates(rw(spark, d), "o_custkey", "o_orderdate", ["l_shipdate"], 1000.0))


@query(f"WITH {EV} SELECT x.user_id, x.event_id, round(coalesce(sum(exp(-(x.t - y.t) / (1 / 24.0))), 0), 6) AS r FROM ev x LEFT JOIN ev y ON x.user_id = y.user_id AND (y.t < x.t OR (y.t = x.t AND y.event_id < x.event_id)) GROUP BY 1, 2")
def hawkes_excitation(spark, d):
    return r6(accounts.excitation(ev(spark, d), "user_id", "t", "event_id", 1 / 24)).select("user_id", "event_id", "r")


@query()
def hawkes_features(spark, d):
    return r6(accounts.self_excitation(ev(spark, d), "user_id", "t"), 4)


PEER = """WITH c AS (SELECT c_custkey, c_acctbal AS v, c_mktsegment AS g, (c_custkey % 3 > 0)::INT AS ref FROM customer), w AS (SELECT *, (SELECT count(*) FROM c y WHERE y.ref = 1 AND y.g = c.g AND y.v <= c.v) AS hi, (SELECT count(*) FROM c y WHERE y.ref = 1 AND y.g = c.g AND y.v < c.v) AS lo, (SELECT count(*) FROM c y WHERE y.ref = 1 AND y.g = c.g) AS m,
(SELECT count(*) FROM c y WHERE y.ref = 1 AND y.v <= c.v) AS hi1, (SELECT count(*) FROM c y WHERE y.ref = 1 AND y.v < c.v) AS lo1, (SELECT count(*) FROM c y WHERE y.ref = 1) AS m1 FROM c)
SELECT c_custkey, round(CASE WHEN m >= 150 THEN ((lo + hi) / 2.0 + 0.5) / (m + 1) ELSE ((lo1 + hi1) / 2.0 + 0.5) / (m1 + 1) END, 6) AS u FROM w"""


def _peers(spark, d):
    return accounts.peer_ranks(t(spark, d, "customer").withColumn("ref", (F.col("c_custkey") % 3 > 0).cast("int")), "c_custkey", "c_acctbal", [["c_mktsegment"], []], "ref")


@query(PEER)
def peer_quantile_u(spark, d):
    return r6(_peers(spark, d))


@query(PEER.replace("SELECT c_custkey, round(CASE", "SELECT c_custkey, round(least(greatest(" + stats.normal_quantile_sql("u") + ", -3.5), 3.5), 6) AS z FROM (SELECT c_custkey, (CASE").replace(", 6) AS u FROM w", ") AS u FROM w)"))
def peer_rank_gauss(spark, d):
    return r6(_peers(spark, d).select("c_custkey", accounts.normal_score("u").alias("z")))


@query("SELECT c_custkey, round((rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0) / count(*) OVER (), 6) AS pct FROM customer")
def avg_rank_pct(spark, d):
    return r6(ranks.with_average_rank(t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "pct", share=True).select("c_custkey", "pct"))


# segments and curves

HIT = f"""WITH {RW}, d AS (SELECT DISTINCT * FROM rw), k AS (SELECT * FROM d WHERE y = 1 OR o_custkey NOT IN (SELECT o_custkey FROM rw WHERE y = 1)), g AS (SELECT o_orderpriority AS segment, sum(y) AS m, sum(1 - y) AS n FROM k GROUP BY 1), a AS (SELECT * FROM g UNION ALL SELECT 'TOTAL', sum(m), sum(n) FROM g), b AS (SELECT sum(m) AS tm, sum(n) AS tn FROM g)
SELECT segment, m::BIGINT AS mule_no, round(m / tm, 6) AS mule_pct, n::BIGINT AS good_no, round(n / tn, 6) AS good_pct, round(m / (m + n), 6) AS hit_rate, round((m / (m + n)) / (tm / (tm + tn)), 6) AS lift, round(n * 7.8 / greatest(m, 1), 6) AS goods_per_mule_w, round(m / (m + n * 7.8), 6) AS hit_rate_w, round((m / (m + n * 7.8)) / (tm / (tm + tn * 7.8)), 6) AS lift_w FROM a, b"""


@query(HIT)
def hit_metrics_total(spark, d):
    """Per segment: frauds and goods, goods rows of fraud accounts left out, equal rows once."""
    x = rw(spark, d)
    both = extracts.labelled(x.where("y = 0").drop("y"), x.where("y = 1").drop("y"), "o_custkey", "y")
    return r6(segments.hit_metrics(both, "o_orderpriority", "y", 7.8))


CARD = f"""WITH {RW}, g AS (SELECT o_orderpriority AS cluster, count(*) AS n, sum(y) AS bad FROM rw GROUP BY 1), b AS (SELECT *, sum(n) OVER () AS tn, sum(bad) OVER () AS tb FROM g), c AS (SELECT *, bad / tb AS bp, (n - bad) / (tn - tb) AS gp, bad / n AS rate, 1.96 AS z FROM b),
e AS (SELECT *, (rate + z * z / (2 * n) - z * sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS lo, (rate + z * z / (2 * n) + z * sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS hi, rate / (tb / tn) AS lift FROM c), f AS (SELECT *, sum(bp) OVER w AS cb, sum(gp) OVER w AS cg FROM e WINDOW w AS (ORDER BY lift DESC, cluster ROWS UNBOUNDED PRECEDING))
SELECT cluster, n, bad::BIGINT AS bad, round(n / tn, 6) AS share, round(bp, 6) AS bad_pct, round(gp, 6) AS good_pct, round(rate, 6) AS rate, round(lo, 6) AS wilson_lo, round(hi, 6) AS wilson_hi, round(lift, 6) AS lift, round(bp / gp, 6) AS capture_over_cost, round(ln(bp / gp), 6) AS woe, round((bp - gp) * ln(bp / gp), 6) AS iv_part,
floor(n / tn * 20000000)::BIGINT AS book_alerts, round(bp * 800, 6) AS catches, (lo > tb / tn)::INT AS significant, round(cb, 6) AS cum_bad, round(cg, 6) AS cum_good, round(abs(cb - cg), 6) AS ks FROM f"""


@query(CARD)
def cluster_scorecard(spark, d):
    return r6(curves.scorecard(rw(spark, d), "o_orderpriority", "y", 20_000_000, 800))


GRID = "[" + ", ".join(f"{0.02 + 0.96 * k / 24!r}" for k in range(25)) + "]"


def _driver_sql(features: list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT o_orderpriority AS c, '{x}' AS f, {x} + 0.0::DOUBLE AS v FROM rw" for x in features)
    return f"""WITH {RW}, l AS ({long}), k AS (SELECT DISTINCT c FROM l),
s AS (SELECT k.c AS cluster, f AS "column", avg(CASE WHEN l.c = k.c THEN v END) AS m1, avg(CASE WHEN l.c <> k.c THEN v END) AS m0, var_samp(CASE WHEN l.c = k.c THEN v END) AS v1, var_samp(CASE WHEN l.c <> k.c THEN v END) AS v0, sum((l.c = k.c)::INT) AS n1, sum((l.c <> k.c)::INT) AS n0 FROM l CROSS JOIN k GROUP BY 1, 2),
e AS (SELECT *, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d FROM s),
r AS (SELECT c, f, rank() OVER (PARTITION BY f ORDER BY v) + (count(*) OVER (PARTITION BY f, v) - 1) / 2.0 AS r FROM l), a AS (SELECT c, f, sum(r) AS s, count(*) AS n FROM r GROUP BY 1, 2),
q AS (SELECT f, unnest(list_distinct(quantile_cont(v, {GRID}))) AS t FROM l GROUP BY f), x AS (SELECT l.c, l.f, q.t, sum((v >= t)::INT) AS up, sum((v <= t)::INT) AS down, count(*) AS n FROM l JOIN q ON l.f = q.f GROUP BY 1, 2, 3),
y AS (SELECT *, sum(up) OVER w AS au, sum(down) OVER w AS ad, sum(n) OVER w AS nn FROM x WINDOW w AS (PARTITION BY f, t)), z AS (SELECT y.*, d, CASE WHEN d >= 0 THEN up ELSE down END AS tp, CASE WHEN d >= 0 THEN au ELSE ad END AS sel FROM y JOIN e ON e.cluster = y.c AND e."column" = y.f),
j AS (SELECT *, round(tp / n - (sel - tp) / (nn - n), 12) AS j FROM z), b AS (SELECT *, row_number() OVER (PARTITION BY c, f ORDER BY j DESC, t) AS r FROM j)
SELECT e.cluster, e."column", round(e.d, 6) AS d, round((a.s - n1 * (n1 + 1) / 2.0) / (n1::DOUBLE * n0), 6) AS auc, CASE WHEN e.d >= 0 THEN 'high' ELSE 'low' END AS side, CASE WHEN j > 0 THEN round(t, 6) END AS threshold, CASE WHEN j > 0 THEN round(j, 6) ELSE 0 END AS youden, CASE WHEN j > 0 THEN round(tp / b.n, 6) ELSE 0 END AS coverage, CASE WHEN j > 0 THEN round(tp / greatest(sel, 1), 6) ELSE 0 END AS purity
FROM e JOIN a ON a.c = e.cluster AND a.f = e."column" JOIN b ON b.c = e.cluster AND b.f = e."column" AND b.r = 1"""


@query(_driver_sql(["l_quantity", "l_tax"]))
def cluster_drivers(spark, d):
    x = rw(spark, d).withColumn("l_tax", F.col("l_tax") + 0.0)
    return r6(segments.drivers(x, "o_orderpriority", ["l_quantity", "l_tax"]))


@query(_driver_sql(NUMBERS))
def cluster_driver_thresholds(spark, d):
    x = rw(spark, d).withColumns({c: F.col(c) + 0.0 for c in NUMBERS})
    return r6(segments.drivers(x, "o_orderpriority", NUMBERS))


@query(f"""WITH {RW}, b AS (SELECT o_orderpriority AS c, quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM rw GROUP BY 1), i AS (SELECT b.c, lo, hi, avg(CASE WHEN o_orderpriority = b.c THEN (l_extendedprice BETWEEN lo AND hi)::INT END) AS a, avg(CASE WHEN o_orderpriority <> b.c THEN (l_extendedprice BETWEEN lo AND hi)::INT END) AS o FROM rw CROSS JOIN b GROUP BY 1, 2, 3)
SELECT c AS cluster, 'l_extendedprice' AS "column", round(lo, 6) AS lo, round(hi, 6) AS hi, round(a, 6) AS inside, round(o, 6) AS outside, round(a / o, 6) AS selectivity FROM i""")
def feature_bounds(spark, d):
    return r6(segments.bounds(rw(spark, d), "o_orderpriority", ["l_extendedprice"]))


@query(f"""WITH {RW}, x AS (SELECT 'qty > 40' AS condition, l_quantity > 40 AS h, y, o_orderpriority = '1-URGENT' AS c FROM rw UNION ALL SELECT 'no tax', l_tax = 0, y, o_orderpriority = '1-URGENT' FROM rw)
SELECT condition, sum((h AND c)::INT)::BIGINT AS cluster_hits, sum((h AND y = 1)::INT)::BIGINT AS fraud_hits, sum((h AND y = 0)::INT)::BIGINT AS good_hits, round(sum((h AND c)::INT) / sum(c::INT), 6) AS cluster_share, round(sum((h AND y = 1)::INT) / sum(y), 6) AS fraud_share, round(sum((h AND y = 0)::INT) / sum(1 - y), 6) AS good_share,
round(sum((h AND y = 1)::INT) / greatest(sum((h AND y = 1)::INT) + 2.0 * sum((h AND y = 0)::INT), 1), 6) AS hit_rate, round(((sum((h AND y = 1)::INT) + .5) / (sum(y) + 1)) / ((sum((h AND y = 0)::INT) + .5) / (sum(1 - y) + 1)), 6) AS lift FROM x GROUP BY 1""")
def signal_rates_conditions(spark, d):
    conditions = {"qty > 40": F.col("l_quantity") > 40, "no tax": F.col("l_tax") == 0}
    return r6(segments.condition_rates(rw(spark, d), conditions, F.col("o_orderpriority") == "1-URGENT", F.col("y") == 1, weight=2.0))


@query(f"""WITH {RW} SELECT rule, sum(h * y)::BIGINT AS frauds, sum(h * (1 - y))::BIGINT AS goods, round(sum(h * y) / sum(y), 6) AS fraud_share, round(sum(h * (1 - y)) / sum(1 - y), 6) AS good_share, round(((sum(h * y) + .5) / (sum(y) + 1)) / ((sum(h * (1 - y)) + .5) / (sum(1 - y) + 1)), 6) AS lift FROM
(SELECT 'l_quantity > 45 AND l_tax <= 0.03' AS rule, (l_quantity > 45 AND l_tax <= 0.03)::INT AS h, y FROM rw UNION ALL SELECT '1e+04 < l_extendedprice <= 5e+04', (l_extendedprice > 10000 AND l_extendedprice <= 50000)::INT, y FROM rw) GROUP BY rule""")
def population_rule_counts(spark, d):
    both = [rules.Rule({"l_quantity": (45.0, None, False), "l_tax": (None, 0.03, False)}), rules.Rule({"l_extendedprice": (10000.0, 50000.0, False)})]
    return r6(rules.rule_counts(rw(spark, d), {r.text(): r.column() for r in both}, "y"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS cluster, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')), 6) AS share FROM orders GROUP BY 1, 2")
def monthly_share(spark, d):
    return r6(curves.monthly_shares(t(spark, d, "orders"), "o_orderdate", "o_orderpriority"))


@query("""WITH s AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, o_orderpriority AS c, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')) AS s FROM orders GROUP BY 1, 2), k AS (SELECT DISTINCT m FROM s), o AS (SELECT m, row_number() OVER (ORDER BY m) AS u, row_number() OVER (ORDER BY m DESC) AS w, greatest(floor(count(*) OVER () / 3), 1) AS k FROM k),
g AS (SELECT c, sum(CASE WHEN u <= k THEN s ELSE 0 END) / max(k) AS e, sum(CASE WHEN w <= k THEN s ELSE 0 END) / max(k) AS l, sum(CASE WHEN w <= k THEN n ELSE 0 END) AS ln FROM s JOIN o ON s.m = o.m GROUP BY c)
SELECT c AS cluster, round(l / greatest(e, 1e-9), 6) AS ratio, ln::BIGINT AS late_n, (l / greatest(e, 1e-9) >= 2 AND ln >= 20)::INT AS emerging FROM g""")
def emergence_ratio(spark, d):
    return r6(curves.emergence(curves.monthly_shares(t(spark, d, "orders"), "o_orderdate", "o_orderpriority")))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month FROM (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate) AS r, count(*) OVER () AS n FROM orders) WHERE r = floor(0.7 * (n - 1)) + 1")
def temporal_cutoff(spark, d):
    return curves.time_cutoff(t(spark, d, "orders"), "o_orderdate")


@query("""WITH g AS (SELECT c_nationkey AS cluster, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1, 2), s AS (SELECT cluster, value, n / sum(n) OVER (PARTITION BY cluster) AS s, sum(n) OVER (PARTITION BY value) / sum(n) OVER () AS a FROM g)
SELECT cluster, value, round(s, 6) AS share, round(s / a, 6) AS ratio FROM s WHERE s >= 0.1 AND s / a >= 1.2""")
def demographics_overrep(spark, d):
    return r6(segments.over_represented(t(spark, d, "customer"), "c_nationkey", "c_mktsegment"))


@query("WITH g AS (SELECT o_orderpriority AS cluster, o_custkey, count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS s FROM orders GROUP BY 1, 2) SELECT cluster, count(*) AS n_accounts, round(max(s), 6) AS top_share, round(sum(s * s), 6) AS herfindahl FROM g GROUP BY 1")
def account_concentration(spark, d):
    return r6(segments.concentration(t(spark, d, "orders"), "o_orderpriority", "o_custkey"))


CAT = f"""WITH {RW}, x AS (SELECT o_orderpriority AS segment, (l_returnflag = 'R')::INT AS m, (l_orderkey % 10 >= 7)::INT AS v, coalesce(nullif(l_quantity::INT % 7, 3)::VARCHAR, '<NULL>') AS value FROM rw), g AS (SELECT segment, value, sum(m * (1 - v)) AS t, sum(m * v) AS w, sum(m) AS mm, sum(1 - m) AS gg FROM x GROUP BY 1, 2),
s AS (SELECT *, t / greatest(sum(t) OVER a, 1) AS ts, w / greatest(sum(w) OVER a, 1) AS ws, sum(mm) OVER (PARTITION BY value) / sum(mm) OVER () AS sm, sum(gg) OVER (PARTITION BY value) / sum(gg) OVER () AS sg, row_number() OVER (PARTITION BY segment ORDER BY t DESC, value) AS r FROM g WINDOW a AS (PARTITION BY segment))
SELECT segment, 'q' AS "column", value, t::BIGINT AS train_mule_no, round(ts, 6) AS train_share_in_segment, w::BIGINT AS val_mule_no, round(ws, 6) AS val_share_in_segment, round(sm, 6) AS share_all_mules, round(sg, 6) AS share_all_goods, round(ts / sm, 6) AS enrichment_vs_mules, round((ts + 1e-4) / (sg + 1e-4), 6) AS enrichment_vs_goods FROM s WHERE r <= 5
UNION ALL SELECT segment, 'q', '<OTHER>', sum(t)::BIGINT, round(sum(ts), 6), sum(w)::BIGINT, round(sum(ws), 6), NULL, NULL, NULL, NULL FROM s WHERE r > 5 GROUP BY segment"""


@query(CAT)
def category_distribution(spark, d):
    x = rw(spark, d).select("o_orderpriority", (F.col("l_returnflag") == "R").cast("int").alias("m"), (F.col("l_orderkey") % 10 >= 7).cast("int").alias("v"), F.nullif(F.col("l_quantity").cast("int") % 7, F.lit(3)).alias("q"))
    return r6(segments.categories(x, "o_orderpriority", ["q"], "m", "v"))


MOS = {"BIG": "l_quantity > 45", "FREE": "l_tax = 0", "URGENT": "o_orderpriority = '1-URGENT'"}


@query(f"""WITH {RW}, f AS (SELECT l_orderkey, l_linenumber, l_partkey, y, (l_quantity > 45)::INT AS a, (l_tax = 0)::INT AS b, (o_orderpriority = '1-URGENT')::INT AS c FROM rw)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a + b + c = 0 THEN 'NONE' ELSE concat_ws('+', CASE WHEN a = 1 THEN 'BIG' END, CASE WHEN b = 1 THEN 'FREE' END, CASE WHEN c = 1 THEN 'URGENT' END) END AS mo_set, a + b + c AS mo_count, (a + b > 0)::INT AS mo_covered FROM f""")
def known_mo_tags(spark, d):
    return segments.behaviours(rw(spark, d), MOS, ("URGENT",)).select("l_orderkey", "l_linenumber", "l_partkey", "mo_set", "mo_count", "mo_covered")


@query(f"""WITH {RW}, f AS (SELECT y, (l_quantity > 45)::INT AS a, (l_tax = 0)::INT AS b FROM rw) SELECT 'mo__BIG' AS a, 'mo__BIG' AS b, sum(a * y)::BIGINT AS frauds, sum(a * (1 - y))::BIGINT AS goods FROM f UNION ALL SELECT 'mo__BIG', 'mo__FREE', sum(a * b * y)::BIGINT, sum(a * b * (1 - y))::BIGINT FROM f UNION ALL SELECT 'mo__FREE', 'mo__FREE', sum(b * y)::BIGINT, sum(b * (1 - y))::BIGINT FROM f""")
def mo_cooccurrence(spark, d):
    return segments.cooccurrence(segments.behaviours(rw(spark, d), MOS), ["mo__BIG", "mo__FREE"], "y")


LADDER = [(0.1, [], "A", 0.9, "B", 0.9), (0.1, [], "A", 0.9, "B", 0.1), (0.5, ["A", "C"], "A", 0.6, "B", 0.9), (0.5, ["A"], "A", 0.2, "B", 0.9), (0.8, [], "A", 0.2, "B", 0.9), (0.5, [], "A", 0.2, "B", 0.9)]


@query("SELECT * FROM (VALUES (0, 'GAP:B'), (1, 'NEW'), (2, 'ALIGNED:A+C'), (3, 'SUBTYPE:A'), (4, 'CROSS-MO'), (5, 'PARTIAL:A')) AS x(step, ladder)")
def mo_label_ladder(spark, d):
    """Every step of the ladder once."""
    x = spark.createDataFrame([(k, *row) for k, row in enumerate(LADDER)], "step int, cov double, sig array<string>, top string, recall double, near string, cosine double")
    return x.select("step", segments.label_ladder(F.col("cov"), F.col("sig"), F.col("top"), F.col("recall"), F.col("near"), F.col("cosine")).alias("ladder"))


@query(f"""WITH {SC}, r AS (SELECT toxic, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM sc), b AS (SELECT unnest([0.05, 0.1, 0.3]) AS budget), k AS (SELECT budget, greatest(1, round(budget * (SELECT count(*) FROM sc)))::BIGINT AS k FROM b)
SELECT budget::DOUBLE AS budget, k, round(sum(CASE WHEN r <= k THEN toxic ELSE 0 END) / (SELECT sum(toxic) FROM sc), 6) AS recall, floor(budget * 1000000)::BIGINT AS book_alerts, round(800 * sum(CASE WHEN r <= k THEN toxic ELSE 0 END) / (SELECT sum(toxic) FROM sc), 6) AS catches, round(sum(CASE WHEN r <= k THEN toxic ELSE 0 END) / (SELECT sum(toxic) FROM sc) / budget, 6) AS lift, (k >= 20)::INT AS reliable FROM r CROSS JOIN k GROUP BY budget, k""")
def budget_table(spark, d):
    return r6(curves.budgets(sc(spark, d), "n_chars", "toxic", "doc_id", [0.05, 0.1, 0.3], 1_000_000, 800))


@query(f"""WITH {SC}, a AS (SELECT 'n_chars' AS s, toxic, n_chars AS v, doc_id FROM sc UNION ALL SELECT 'h', toxic, (doc_id * 7919) % 1009, doc_id FROM sc), r AS (SELECT s, row_number() OVER w AS k, sum(toxic) OVER (w ROWS UNBOUNDED PRECEDING) AS cp FROM a WINDOW w AS (PARTITION BY s ORDER BY v DESC, doc_id)), n AS (SELECT ceil(0.6 * sum(toxic)) AS need FROM sc)
SELECT s AS score_name, min(k) AS k, (min(k) - max(need))::BIGINT AS fp FROM r, n WHERE cp >= need GROUP BY s""")
def fp_reduction(spark, d):
    return curves.false_positives(sc(spark, d).withColumn("h", (F.col("doc_id") * 7919) % 1009), ["n_chars", "h"], "toxic", "doc_id", 0.6)


@query(f"WITH {SC}, g AS (SELECT n_chars, sum(toxic) AS p, count(*) AS n FROM sc GROUP BY 1), c AS (SELECT p, sum(p) OVER (ORDER BY n_chars DESC) AS cp, sum(n) OVER (ORDER BY n_chars DESC) AS cn FROM g) SELECT round(sum(p * cp / cn) / sum(p), 6) AS average_precision FROM c")
def average_precision(spark, d):
    return r6(curves.average_precision(sc(spark, d), "n_chars", "toxic"))


@query(f"WITH {SC} SELECT round(avg(toxic), 6) AS precision FROM (SELECT toxic, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM sc) WHERE r <= (SELECT sum(toxic) FROM sc)")
def precision_at_k(spark, d):
    return r6(curves.precision_at_positives(sc(spark, d), "n_chars", "toxic", "doc_id"))


@query(f"WITH {SC}, r AS (SELECT toxic, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r, n_chars::DOUBLE AS v FROM sc) SELECT round((avg(CASE WHEN toxic = 1 THEN v END) - avg(CASE WHEN toxic = 0 THEN v END)) ** 2 / (var_pop(CASE WHEN toxic = 1 THEN v END) + var_pop(CASE WHEN toxic = 0 THEN v END)), 6) AS fisher, round(avg(CASE WHEN toxic = 1 THEN v END), 6) AS mean_same, round(avg(CASE WHEN toxic = 0 THEN v END), 6) AS mean_other, round((sum(toxic * r) - sum(toxic) * (sum(toxic) + 1) / 2.0) / (sum(toxic)::DOUBLE * sum(1 - toxic)), 6) AS auc FROM r")
def pair_separation(spark, d):
    return r6(curves.pair_separation(sc(spark, d), "n_chars", "toxic"))


EMB = "v AS (SELECT vec_id, label, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label AS g, p, avg(x) AS x FROM v GROUP BY 1, 2), n AS (SELECT g, sqrt(sum(x * x)) AS n FROM c GROUP BY g), m AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1), d AS (SELECT v.vec_id, any_value(v.label) AS label, c.g, sum(v.x * c.x) AS dot FROM v JOIN c ON v.p = c.p GROUP BY v.vec_id, c.g), k AS (SELECT d.vec_id, label, d.g, dot / (m.n * n.n) AS cos FROM d JOIN n ON d.g = n.g JOIN m ON m.vec_id = d.vec_id), a AS (SELECT vec_id, label, g AS cluster, cos FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(cos, 12) DESC, g) AS r FROM k) WHERE r = 1)"


def _assigned(spark, d):
    e = t(spark, d, "embeddings")
    c = similarity.centroids(e, "label", "embedding")
    return e, c, similarity.nearest(e, "vec_id", "embedding", c)


@query(f"WITH {EMB} SELECT vec_id, cluster, round(cos, 6) AS cosine FROM a")
def centroid_assign(spark, d):
    return r6(_assigned(spark, d)[2])


@query(f'WITH {EMB} SELECT g AS "group", round(quantile_cont(cos, 0.05), 6) AS bar FROM k WHERE label = g GROUP BY g')
def centroid_bars(spark, d):
    e, c, _ = _assigned(spark, d)
    return r6(similarity.member_bars(e, "label", "embedding", c))


@query(f"WITH {EMB}, b AS (SELECT g, quantile_cont(cos, 0.05) AS bar FROM k WHERE label = g GROUP BY g) SELECT vec_id, CASE WHEN cos >= bar THEN cluster ELSE -1 END AS cluster, round(cos, 6) AS cosine FROM a JOIN b ON a.cluster = b.g")
def centroid_gated(spark, d):
    e, c, _ = _assigned(spark, d)
    return r6(similarity.nearest(e, "vec_id", "embedding", c, similarity.member_bars(e, "label", "embedding", c)))


@query(f"WITH {EMB}, x AS (SELECT a.g AS a, b.g AS b, sum(a.x * b.x) AS dot FROM c a JOIN c b ON a.p = b.p AND a.g < b.g GROUP BY 1, 2) SELECT round(min(1 - dot / (p.n * q.n)), 6) AS distinctness FROM x JOIN n p ON p.g = x.a JOIN n q ON q.g = x.b")
def centroid_distinctness(spark, d):
    return r6(similarity.distinctness(similarity.centroids(t(spark, d, "embeddings"), "label", "embedding")))


def _labelings(spark, d):
    e, _, a = _assigned(spark, d)
    return e.select("vec_id", "label").join(a, "vec_id")


@query(f"WITH {EMB}, t AS (SELECT label, cluster, count(*)::DOUBLE AS n FROM a GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS c, sum(n) AS n FROM t), p AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM t GROUP BY label)), q AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM t GROUP BY cluster)) SELECT round((c - p.s * q.s / (s.n * (s.n - 1) / 2)) / ((p.s + q.s) / 2 - p.s * q.s / (s.n * (s.n - 1) / 2)), 6) AS ari FROM s, p, q")
def ari(spark, d):
    return r6(curves.adjusted_rand(_labelings(spark, d), "label", "cluster"))


@query(f"WITH {EMB}, t AS (SELECT label, cluster, count(*) AS n FROM a GROUP BY 1, 2), j AS (SELECT *, n / (sum(n) OVER (PARTITION BY label) + sum(n) OVER (PARTITION BY cluster) - n) AS j FROM t) SELECT label AS a, cluster AS best, round(j, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY j DESC, cluster) AS r FROM j) WHERE r = 1")
def best_jaccard(spark, d):
    return r6(curves.best_jaccard(_labelings(spark, d), "label", "cluster"))


@query(f"WITH {EMB}, t AS (SELECT label, cluster, count(*)::DOUBLE AS n FROM a GROUP BY 1, 2) SELECT label AS a, round(sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)), 6) AS strength FROM t GROUP BY 1")
def prediction_strength(spark, d):
    return r6(curves.prediction_strength(_labelings(spark, d), "label", "cluster"))


@query(f"WITH {EMB}, g AS (SELECT cluster, count(*) AS n, sum((vec_id % 3 = 0)::INT) AS f, avg(cos) AS mc FROM a GROUP BY 1) SELECT cluster, n AS n_rows, f::BIGINT AS fraud_n, (n - f)::BIGINT AS goods_n, round(100 * f / n, 6) AS fraud_pct_of_cluster, round(100 * f / sum(f) OVER (), 6) AS fraud_pct_of_new_fraud, round(100 * (n - f) / sum(n - f) OVER (), 6) AS good_pct_of_new_goods, round((n - f) * 5.0::DOUBLE, 6) AS est_goods_population, round(100 * f / (f + (n - f) * 5.0), 6) AS hit_rate_pct, round((f / (f + (n - f) * 5.0)) / (sum(f) OVER () / (sum(f) OVER () + sum(n - f) OVER () * 5.0)), 6) AS lift, round(mc, 6) AS mean_cosine FROM g")
def map_summary(spark, d):
    a = _assigned(spark, d)[2].withColumn("y", (F.col("vec_id") % 3 == 0).cast("int"))
    return r6(segments.map_summary(a, "cluster", "y", "cosine", 5.0))


@query(f"WITH {EMB}, g AS (SELECT cluster, round(100 * avg((vec_id % 3 = 0)::INT), 6) AS a, round(100 * avg(CASE WHEN vec_id % 2 = 0 THEN (vec_id % 3 = 0)::INT END), 6) AS b FROM a GROUP BY 1) SELECT cluster, a AS fraud_pct_of_cluster, b AS original_pct, round(a - b, 5) AS fraud_pct_shift FROM g")
def new_vs_original(spark, d):
    a = _assigned(spark, d)[2].withColumn("y", (F.col("vec_id") % 3 == 0).cast("int"))
    out = segments.against_original(r6(segments.map_summary(a, "cluster", "y")), r6(segments.map_summary(a.where("vec_id % 2 = 0"), "cluster", "y")))
    return out.withColumn("fraud_pct_shift", F.round("fraud_pct_shift", 5))


@query(f"WITH {RW}, g AS (SELECT o_orderpriority AS cluster, sum(y) AS f, count(*) AS n FROM rw GROUP BY 1) SELECT cluster, round((f + 50 * sum(f) OVER () / sum(n) OVER ()) / (n + 50), 6) AS risk FROM g")
def eb_cluster_risk(spark, d):
    return r6(curves.shrunk_risk(rw(spark, d), "o_orderpriority", "y"))


@query(f"WITH {RW}, k AS (SELECT DISTINCT o_orderpriority AS c, (l_orderkey % 5)::BIGINT AS fold FROM rw) SELECT c AS cluster, k.fold, round((sum(CASE WHEN o_orderpriority = c THEN y ELSE 0 END) + 50 * sum(y) / count(*)) / (sum((o_orderpriority = c)::INT) + 50), 6) AS risk FROM k JOIN rw ON rw.l_orderkey % 5 <> k.fold GROUP BY 1, 2")
def eb_cluster_risk_oof(spark, d):
    return r6(curves.shrunk_risk(rw(spark, d).withColumn("fold", F.col("l_orderkey") % 5), "o_orderpriority", "y", "fold"))


# tokens, similarity, rules


@query("""SELECT p_partkey, (list_contains(w, 'green'))::INT AS "p__green", (list_contains(w, 'red'))::INT AS "p__red", (len(list_filter(list_distinct(w), lambda x: x NOT IN ('green', 'red'))) > 0)::INT AS "p__other", len(w)::INT AS "p__n_tokens" FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def token_multihot(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.translate("p_name", " ", "|").alias("p"))
    return p.select("p_partkey", *encode.multi_hot("p", ["green", "red"]))


COMBO = """WITH k AS (SELECT DISTINCT p_partkey AS k, (p_size > 45)::INT AS y, unnest(string_split(p_name, ' ')) AS t FROM part), n AS (SELECT sum((p_size > 45)::INT) AS nf, sum((p_size <= 45)::INT) AS ng FROM part), o AS (SELECT t, sum(y) AS f, sum(1 - y) AS g FROM k GROUP BY t HAVING sum(y) >= 2), p AS (SELECT a.t || '+' || b.t AS t, sum(a.y) AS f, sum(1 - a.y) AS g FROM k a JOIN k b ON a.k = b.k AND a.t < b.t JOIN o x ON x.t = a.t JOIN o z ON z.t = b.t GROUP BY 1 HAVING sum(a.y) >= 2),
q AS (SELECT a.t || '+' || b.t || '+' || c.t AS t, sum(a.y) AS f, sum(1 - a.y) AS g FROM k a JOIN k b ON a.k = b.k AND a.t < b.t JOIN k c ON a.k = c.k AND b.t < c.t JOIN o z ON z.t = c.t JOIN p ON p.t = a.t || '+' || b.t GROUP BY 1 HAVING sum(a.y) >= 2)
SELECT t AS combo, f::BIGINT AS frauds, g::BIGINT AS goods, round((f / nf) / ((g + 1) / (ng + 1)), 6) AS lift FROM (SELECT * FROM o UNION ALL SELECT * FROM p UNION ALL SELECT * FROM q), n WHERE (f / nf) / ((g + 1) / (ng + 1)) >= 0.5"""


@query(COMBO)
def token_combos(spark, d):
    p = t(spark, d, "part").select("p_partkey", (F.col("p_size") > 45).cast("int").alias("y"), F.split("p_name", " ").alias("w"))
    return r6(rules.token_combinations(p, "p_partkey", "w", "y", 2, 0.5, 1000, 100000))


@query(f"WITH {EDGE}, s AS (SELECT a, count(*) AS n FROM e GROUP BY a), p AS (SELECT x.a, y.a AS b, count(*) AS common FROM e x JOIN e y ON x.s = y.s AND x.a < y.a GROUP BY 1, 2) SELECT p.a, p.b, common, round(common / (x.n + y.n - common), 6) AS jaccard FROM p JOIN s x ON x.a = p.a JOIN s y ON y.a = p.b")
def jaccard_pairs(spark, d):
    return similarity.shared_tokens(_edges(spark, d), "o_custkey", "l_suppkey", places=6)


def _pairs(spark, d):
    u = t(spark, d, "events").select("user_id").distinct()
    return u.select(F.col("user_id").alias("a"), (F.col("user_id") + 1).alias("b")).join(u.select(F.col("user_id").alias("b")), "b").select("a", "b")


@query("""WITH m AS (SELECT u.user_id, s.s, coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY u.user_id) AS p FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type AS s FROM events) s LEFT JOIN (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) c ON c.user_id = u.user_id AND c.event_type = s.s),
q AS (SELECT x.user_id AS a, y.user_id AS b, x.p, y.p AS q, (x.p + 1e-6) / (1 + 5e-6) AS ps, (y.p + 1e-6) / (1 + 5e-6) AS qs FROM m x JOIN m y ON y.user_id = x.user_id + 1 AND x.s = y.s)
SELECT a, b, round(sqrt(sum((sqrt(p) - sqrt(q)) ** 2)) / sqrt(2), 6) AS hellinger, round(sum(ps * log2(ps / ((ps + qs) / 2)) + qs * log2(qs / ((ps + qs) / 2))) / 2, 6) AS js FROM q GROUP BY a, b""")
def mix_distances(spark, d):
    return r6(similarity.mix_distances(_pairs(spark, d), accounts.mixes(ev(spark, d), "user_id", "event_type", TYPES), "user_id"))


@query("""WITH r AS (SELECT c_custkey AS k, (rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0) / count(*) OVER () AS x, c_mktsegment AS m FROM customer) SELECT a.k AS a, b.k AS b, round((abs(a.x - b.x) + (a.m <> b.m)::INT) / 2, 6) AS gower FROM r a JOIN r b ON b.k = a.k + 1""")
def gower_pairs(spark, d):
    c = t(spark, d, "customer")
    pairs = c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b")).join(c.select(F.col("c_custkey").alias("b")), "b")
    return r6(similarity.gower(pairs, c, "c_custkey", ["c_acctbal"], ["c_mktsegment"]))


KNN = """WITH v AS (SELECT vec_id AS k, label, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings), d AS (SELECT a.k AS a, b.k AS b, b.label AS t, sqrt(sum((a.x - b.x) ** 2)) AS d FROM v a JOIN v b ON a.p = b.p AND a.k <> b.k AND b.k % 5 = 0 GROUP BY 1, 2, 3), s AS (SELECT a, max(d) AS s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d) WHERE r <= 7 GROUP BY a),
e AS (SELECT d.a, d.b, (d.t < 3)::INT AS y, exp(-d.d * d.d / (x.s * z.s)) AS s FROM d JOIN s x ON x.a = d.a JOIN s z ON z.a = d.b WHERE d.a % 5 <> 0) SELECT a AS vec_id, round(ln((sum(y * s) + 1e-12) / (sum((1 - y) * s) + 1e-12)), 5) AS score FROM e GROUP BY a"""


def _kernel(spark, d):
    e = t(spark, d, "embeddings").withColumn("y", (F.col("label") < 3).cast("int"))
    return similarity.kernel_scores(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0"), "vec_id", "embedding", "y", "label")


@query(KNN)
def knn_kernel_score(spark, d):
    return r6(_kernel(spark, d).select("vec_id", "score"), 5)


@query(KNN[: KNN.index(" SELECT a AS vec_id, round(ln(")].replace("SELECT d.a, d.b, (d.t < 3)::INT AS y,", "SELECT d.a, d.b, d.t, (d.t < 3)::INT AS y,") + """, f AS (SELECT *, row_number() OVER (PARTITION BY a, t ORDER BY s DESC, b) AS r FROM e WHERE y = 1), g AS (SELECT a, t, avg(s) AS m FROM f WHERE r <= 3 GROUP BY 1, 2),
h AS (SELECT a, t, row_number() OVER (PARTITION BY a ORDER BY round(m, 13) DESC, t DESC) AS r FROM g), x AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM f) SELECT h.a AS vec_id, h.t AS predicted, x.b AS exemplar FROM h JOIN x ON h.a = x.a WHERE h.r = 1 AND x.r = 1""")
def knn_kernel_types(spark, d):
    return _kernel(spark, d).select("vec_id", "predicted", "exemplar")


# folds, splits, models


@query("SELECT o_custkey, ((row_number() OVER (PARTITION BY p ORDER BY o_custkey) - 1) % 5)::INT AS fold FROM (SELECT o_custkey, max((l_returnflag = 'R' AND l_quantity > 49)::INT) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)")
def account_group_folds(spark, d):
    return models.account_folds(rw(spark, d), "o_custkey", "y").withColumn("fold", F.col("fold").cast("int"))


@query("SELECT c_custkey, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) <= floor(0.3 * count(*) OVER (PARTITION BY c_mktsegment)))::INT AS is_val FROM customer")
def stratified_split(spark, d):
    return models.stratified_split(t(spark, d, "customer"), "c_custkey", "c_mktsegment", 0.3).select("c_custkey", "is_val")


def _labelled(spark, d):
    return rw(spark, d).withColumn("f", (F.col("l_quantity") + 40 * F.col("l_tax") > 30).cast("int")).withColumn("k", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


@query()
def gbt_oof(spark, d):
    """AUC of scores out of fold, on whole tables."""
    return r6(curves.auc(models.out_of_fold(_labelled(spark, d), NUMBERS, "f", "o_custkey"), ["score"], "f"), 3)


@query("SELECT 0.0::DOUBLE AS gap, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def contribution_sum_check(spark, d):
    x = _labelled(spark, d)
    m = models.boosted(NUMBERS, "f", trees=3).fit(models.filled(x, NUMBERS))
    c = models.contributions(m, x, NUMBERS, "k")
    return c.agg(F.round(F.max(F.abs(stats.total(F.col("contrib")) + F.col("bias") - F.col("margin"))), 6).alias("gap"), F.count("*").alias("n"))


@query()
def tree_rule(spark, d):
    found = models.tree_rules(_labelled(spark, d), NUMBERS, "f")
    return spark.createDataFrame([(r.text(), float(p), n) for r, p, n in found], "rule string, share double, n long")


@query()
def beam_peel(spark, d):
    found = rules.peel(rw(spark, d), "y", ["l_quantity", "l_tax"], least=5)
    return spark.createDataFrame([(r.text(), float(q), int(n), int(f)) for r, q, n, f in found], "rule string, quality double, n long, frauds long")


def _blocks(spark, d):
    e = ev(spark, d)
    return accounts.timing(e, "user_id", "t", "event_id").join(accounts.composition(e, "user_id", "event_type", "value", TYPES), "user_id").join(accounts.scale(e, "user_id", "value"), "user_id")


@query()
def pca_whiten(spark, d):
    b = _blocks(spark, d)
    return models.whitened(b, [c for c in b.columns if c != "user_id"], 4)[1].select("user_id", "embedding")


@query()
def gmm_segments(spark, d):
    b = _blocks(spark, d)
    e = models.whitened(b, [c for c in b.columns if c != "user_id"], 3)[1]
    return models.gaussian_segments(e.select("user_id", "embedding"), "embedding", 3).select("user_id", "cluster", "conf", "entropy")


@query()
def kmeans_states(spark, d):
    return models.gaussian_segments(_assigned(spark, d)[0].select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")), "v", 8, engine="kmeans").select("vec_id", "cluster", "conf")


@query()
def select_k(spark, d):
    b = _blocks(spark, d)
    e = models.whitened(b, [c for c in b.columns if c != "user_id"], 3)[1].select("user_id", "embedding")
    return models.choose_k(e, "user_id", "embedding", range(2, 5))


# more of the same


@query("SELECT o_orderkey, floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-01-01 06:00:00')) / 86400e6)::BIGINT AS gap FROM orders")
def whole_day_gaps(spark, d):
    return t(spark, d, "orders").select("o_orderkey", clean.whole_days_between(F.col("o_orderdate"), F.lit("1998-01-01 06:00:00")).alias("gap"))


@query("SELECT sum(n)::BIGINT AS rows, count(*) AS accounts, round(avg(n), 6) AS rows_per_account, 0.0::DOUBLE AS missing, min(lo)::DATE AS first, max(hi)::DATE AS last, max(n) AS most, 1 AS intraday FROM (SELECT user_id, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1)")
def input_profile(spark, d):
    return r6(extracts.profile(ev(spark, d), "user_id", "ts"))


@query(f"WITH {RW} SELECT o_custkey, max(y) AS label FROM rw GROUP BY 1")
def mixed_labels(spark, d):
    x = rw(spark, d)
    return extracts.load_and_mix(x.where("y = 0").drop("y"), x.where("y = 1").drop("y"), "o_custkey", ["l_shipdate"])[1]


@query(f"""WITH {RW}, f AS (SELECT y, o_orderpriority = '1-URGENT' AS c, (l_quantity > 25)::INT AS a, (l_tax = 0)::INT AS b FROM rw), g AS (SELECT 'half' AS feature, avg(CASE WHEN c THEN a END) AS cr, avg(CASE WHEN y = 1 THEN a END) AS fr, avg(CASE WHEN y = 0 THEN a END) AS gr FROM f UNION ALL SELECT 'free', avg(CASE WHEN c THEN b END), avg(CASE WHEN y = 1 THEN b END), avg(CASE WHEN y = 0 THEN b END) FROM f)
SELECT feature, round(cr, 6) AS cluster_rate, round(fr, 6) AS fraud_rate, round(gr, 6) AS good_rate, round((cr + 1e-3) / (fr + 1e-3), 6) AS ratio_vs_fraud, round((cr + 1e-3) / (gr + 1e-3), 6) AS ratio_vs_good FROM g WHERE cr >= 0.1""")
def signal_rates_binary(spark, d):
    x = rw(spark, d).withColumns({"half": (F.col("l_quantity") > 25).cast("int"), "free": (F.col("l_tax") == 0).cast("int")})
    return r6(segments.binary_rates(x, ["half", "free"], F.col("o_orderpriority") == "1-URGENT", F.col("y") == 1))


@query("WITH c AS (SELECT quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.75) AS cut FROM orders), g AS (SELECT o_orderpriority AS cluster, sum((epoch_us(o_orderdate) > cut)::INT) AS l, count(*) AS n FROM orders, c GROUP BY 1) SELECT cluster, round((l / n) / (sum(l) OVER () / sum(n) OVER ()), 6) AS ratio FROM g")
def recency_emergence(spark, d):
    return r6(segments.recency(t(spark, d, "orders"), "o_orderpriority", "o_orderdate"))


@query(f"""WITH {RW}, l AS (SELECT o_orderpriority AS segment, 'mo__BIG' AS mo, (l_quantity > 45)::INT AS h FROM rw UNION ALL SELECT o_orderpriority, 'mo__FREE', (l_tax = 0)::INT FROM rw), g AS (SELECT segment, mo, sum(h) AS h, count(*) AS n FROM l GROUP BY 1, 2)
SELECT segment, mo, round(h / n, 6) AS coverage, round(h / sum(h) OVER w, 6) AS recall, round((h / n) / (sum(h) OVER w / sum(n) OVER w), 6) AS enrichment FROM g WINDOW w AS (PARTITION BY mo)""")
def mo_overlay(spark, d):
    return r6(segments.overlay(segments.behaviours(rw(spark, d), MOS), "o_orderpriority", ["mo__BIG", "mo__FREE"]))


@query(f"""WITH {RW}, x AS (SELECT 'BIG' AS mo, y FROM rw WHERE l_quantity > 45 UNION ALL SELECT 'FREE', y FROM rw WHERE l_tax = 0 UNION ALL SELECT 'URGENT', y FROM rw WHERE o_orderpriority = '1-URGENT'), g AS (SELECT mo AS segment, sum(y) AS m, sum(1 - y) AS n FROM x GROUP BY 1), a AS (SELECT * FROM g UNION ALL SELECT 'TOTAL', sum(m), sum(n) FROM g), b AS (SELECT sum(m) AS tm, sum(n) AS tn FROM g)
SELECT segment, m::BIGINT AS mule_no, round(m / greatest(tm, 1), 6) AS mule_pct, n::BIGINT AS good_no, round(n / greatest(tn, 1), 6) AS good_pct, round(m / (m + n), 6) AS hit_rate, round((m / (m + n)) / greatest(tm / (tm + tn), 1e-12), 6) AS lift, round(n * 2.0 / greatest(m, 1), 6) AS goods_per_mule_w, round(m / (m + n * 2.0), 6) AS hit_rate_w, round((m / (m + n * 2.0)) / greatest(tm / (tm + tn * 2.0), 1e-12), 6) AS lift_w FROM a, b""")
def known_mo_report(spark, d):
    from .plans import discovery

    return r6(discovery.known_report(rw(spark, d), MOS, "y", 2.0))


@query(f'WITH {EMB}, g AS (SELECT label AS "true", cluster AS predicted, count(*) AS n FROM a GROUP BY 1, 2) SELECT "true", predicted, n, round(n / sum(n) OVER (PARTITION BY "true"), 6) AS share, ("true" = predicted)::INT AS agree FROM g')
def confusion_matrix(spark, d):
    return r6(segments.confusion(_labelings(spark, d), "label", "cluster"))


@query("SELECT c_mktsegment AS \"group\", sum((c_custkey % 2 = 0)::INT)::BIGINT AS n_0, sum((c_custkey % 2 = 1)::INT)::BIGINT AS n_1 FROM customer GROUP BY 1")
def split_summary(spark, d):
    return segments.by_split(t(spark, d, "customer").withColumn("s", F.col("c_custkey") % 2), "c_mktsegment", "s", [0, 1])


@query(f"WITH {RW} SELECT round(avg(y), 6) AS base_rate, round(800 / 20000000, 6) AS book_rate, round(avg(y) / (800 / 20000000), 6) AS enrichment FROM rw")
def prevalence(spark, d):
    return r6(segments.prevalence(rw(spark, d), "y", 20_000_000, 800))


@query("""WITH l AS (SELECT event_type AS state, 'value' AS c, value AS v FROM events UNION ALL SELECT event_type, 'hour', hour(ts) FROM events), s AS (SELECT c, avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM l GROUP BY c), g AS (SELECT state, l.c, (avg(v) - any_value(m)) / any_value(sd) AS z, count(*) / any_value(n) AS sh FROM l JOIN s ON l.c = s.c GROUP BY 1, 2)
SELECT state, round(max(sh), 6) AS share, string_agg(CASE WHEN z >= 0 THEN 'high ' ELSE 'low ' END || c, ', ' ORDER BY round(abs(z), 9) DESC, c) AS description FROM g GROUP BY state""")
def state_description(spark, d):
    return r6(segments.state_descriptions(ev(spark, d).withColumn("hour", F.hour("ts")), "event_type", ["value", "hour"]))


@query("SELECT c_custkey, round((SELECT count(*) FROM customer y WHERE y.c_custkey % 2 = 0 AND y.c_acctbal < x.c_acctbal) / (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0), 6) AS novelty FROM customer x")
def novelty_percentile(spark, d):
    c = t(spark, d, "customer").withColumn("ref", (F.col("c_custkey") % 2 == 0).cast("int"))
    return r6(segments.novelty(c, "c_acctbal", "ref").select("c_custkey", "novelty"))


@query(f"WITH {SC}, g AS (SELECT n_chars AS s, sum(toxic) AS p, count(*) AS n FROM sc GROUP BY 1), c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn FROM g) SELECT min(s) AS threshold, max(cp)::BIGINT AS frauds, max(cn - cp)::BIGINT AS goods FROM c WHERE cn - cp <= 9 * cp")
def cut_at_ratio(spark, d):
    return curves.cut_at_ratio(sc(spark, d), "n_chars", "toxic", 9.0)


@query("""WITH v AS (SELECT vec_id, label, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT p, avg(x) AS x FROM v GROUP BY p), a AS (SELECT label AS g, v.p, avg(v.x) - any_value(m.x) AS x FROM v JOIN m ON v.p = m.p GROUP BY 1, 2), b AS (SELECT label AS h, v.p, avg(v.x) - any_value(m.x) AS x FROM v JOIN m ON v.p = m.p WHERE vec_id % 2 = 0 GROUP BY 1, 2),
k AS (SELECT g, h, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS c FROM a JOIN b ON a.p = b.p GROUP BY 1, 2) SELECT g AS "group", h AS profile, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(c, 12) DESC, h) AS r FROM k) WHERE r = 1""")
def nearest_mo_profile(spark, d):
    e = t(spark, d, "embeddings")
    return r6(similarity.nearest_profiles(e, "label", "embedding", similarity.centroids(e.where("vec_id % 2 = 0"), "label", "embedding")))


@query("""WITH v AS (SELECT vec_id AS k, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings), d AS (SELECT a.k AS a, b.k AS b, sqrt(sum((a.x - b.x) ** 2)) AS d FROM v a JOIN v b ON a.p = b.p AND a.k <> b.k AND b.k % 5 = 0 GROUP BY 1, 2) SELECT a AS vec_id, round(avg(d), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d) WHERE r <= 7 GROUP BY a""")
def knn_euclid(spark, d):
    e = t(spark, d, "embeddings")
    return r6(similarity.knn_mean_distance(e, e.where("vec_id % 5 = 0"), "vec_id", "embedding"))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, round(max(o_totalprice), 6) AS most, round(coalesce(stddev_samp(o_totalprice), 0), 3) AS sd FROM orders GROUP BY 1")
def baseline_aggregates(spark, d):
    a = F.col("o_totalprice")
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum(a), 2).alias("total"), F.round(F.avg(a), 6).alias("mean"), F.round(F.max(a), 6).alias("most"), F.round(F.coalesce(F.stddev_samp(a), F.lit(0.0)), 3).alias("sd"))


@query()
def rank_gauss(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    return r6(models.rank_gauss(c, models.quantile_grid(c, ["c_acctbal"])))


@query()
def supervised_axis(spark, d):
    x = t(spark, d, "customer").withColumns({"y": (F.col("c_acctbal") > 4000).cast("int"), "u": F.col("c_acctbal") / 100 + F.col("c_nationkey")})
    return r6(models.supervised_axis(x, ["u", "c_nationkey"], "y", "c_custkey"), 3)


@query()
def mixture_segments(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return r6(models.mixture_assign(e, "vec_id", "v", models.diagonal_mixture(e, "v", 3)), 4)


@query(f"""WITH {RW}, f AS (SELECT l_quantity + 0.0::DOUBLE AS y, (l_quantity > 45)::INT::DOUBLE AS a, (l_tax = 0)::INT::DOUBLE AS b FROM rw), c AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM f),
k AS (SELECT *, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS p, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS q FROM c) SELECT a::INT AS mo__BIG, b::INT AS mo__FREE, round(avg(y - my - p * (a - ma) - q * (b - mb)), 4) + 0.0 AS mean, count(*) AS n FROM f, k GROUP BY 1, 2""")
def residualised(spark, d):
    x = segments.behaviours(rw(spark, d), MOS)
    return r6(models.residualised(x, ["l_quantity"], ["mo__BIG", "mo__FREE"]).groupBy("mo__BIG", "mo__FREE").agg(F.avg("l_quantity").alias("mean"), F.count("*").alias("n")), 4)


@query()
def block_weights(spark, d):
    e = t(spark, d, "customer").withColumn("g", F.col("c_nationkey") % 5)
    pairs = similarity.sampled_pairs(e, "c_custkey", "g")
    a = similarity.gower(pairs, e, "c_custkey", ["c_acctbal"], ["c_mktsegment"]).withColumn("same", (F.col("gower") < 0.3).cast("int"))
    w = similarity.learned_weights(a.withColumn("other", F.pmod(F.col("a") + F.col("b"), F.lit(7)) / 7), ["gower", "other"], "same")
    return spark.createDataFrame([(k, round(v, 3)) for k, v in w.items()], "block string, weight double")


from . import queries_more as _more  # noqa: E402, F401  (registers its queries)
