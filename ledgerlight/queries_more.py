"""More queries over the driver's tables with their SQL: loading, screens, rules, reports, splits, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import accounts, encode, models, ranks, rules, segments, similarity
from .queries import AUC, CAT, EMB, MOS, NUMBERS, ORACLES, RW, TYPES, _driver_sql, _labelings, _labelled, ev, query, r6, rw, t
from .sources import extracts


@query(f"""WITH {RW}, k AS (SELECT o_custkey, l_linestatus AS m, count(*) AS n FROM rw WHERE y = 1 GROUP BY 1, 2), b AS (SELECT o_custkey, m FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, m) AS r FROM k) WHERE r = 1), a AS (SELECT o_custkey, max(y) AS label FROM rw GROUP BY 1)
SELECT a.o_custkey, label, m AS kind, c_mktsegment FROM a LEFT JOIN b ON a.o_custkey = b.o_custkey LEFT JOIN customer ON c_custkey = a.o_custkey""")
def account_load(spark, d):
    p = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return extracts.load_accounts(rw(spark, d), p, "o_custkey", "y", "l_linestatus")


@query("SELECT DISTINCT o_custkey, 'o_orderpriority:' || o_orderpriority AS token FROM orders UNION SELECT DISTINCT o_custkey, 'o_orderstatus:' || o_orderstatus FROM orders")
def token_edge_union(spark, d):
    return extracts.token_edges(t(spark, d, "orders"), "o_custkey", ["o_orderpriority", "o_orderstatus"])


@query("SELECT 'flag' AS \"column\", 1 AS binary, 0 AS has_null FROM (SELECT 1) UNION ALL SELECT 'size', 0, 0 UNION ALL SELECT 'odd', 1, 1")
def binary_null_columns(spark, d):
    p = t(spark, d, "part").select((F.col("p_size") > 25).cast("int").alias("flag"), F.col("p_size").alias("size"), F.nullif(F.col("p_size") % 2, F.lit(0)).alias("odd"))
    return encode.binary_columns(p, ["flag", "size", "odd"])


@query("""WITH c AS (SELECT 'o_orderkey' AS "column", count(*) AS rows, count(DISTINCT o_orderkey) AS "distinct" FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'one', count(*), 1 FROM orders)
SELECT *, CASE WHEN "column" = 'o_custkey' THEN 'reserved' WHEN "distinct" <= 1 THEN 'constant' WHEN "distinct" > rows * 0.5 THEN 'id_like' ELSE 'keep' END AS role FROM c""")
def column_roles(spark, d):
    o = t(spark, d, "orders").select(*(F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_orderstatus", "o_custkey")), F.lit("x").alias("one"))
    return encode.column_roles(o, o.columns, ("o_custkey",))


@query(f"""WITH {RW}, z AS (SELECT 'gap' AS c, y, (l_returnflag <> 'R')::INT AS n FROM rw UNION ALL SELECT 'q', y, 0 FROM rw), a AS (SELECT c, avg(CASE WHEN y = 0 THEN n END) AS r0, avg(CASE WHEN y = 1 THEN n END) AS r1 FROM z GROUP BY c)
SELECT c AS "column", round(r0, 6) AS rate_0, round(r1, 6) AS rate_1, CASE WHEN abs(r0 - r1) >= 0.5 THEN 'leak' ELSE 'keep' END AS verdict FROM a""")
def built_feature_asymmetry(spark, d):
    x = rw(spark, d).select("y", F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("gap"), F.col("l_quantity").alias("q"))
    return r6(encode.asymmetric(x, ["gap", "q"], "y", 0.5))


@query("SELECT \"column\", round(greatest(auc, 1 - auc), 6) AS strength, (greatest(auc, 1 - auc) >= 0.995)::INT AS leak FROM (" + " UNION ALL ".join(AUC.format(c=c) for c in NUMBERS) + ")")
def leak_report(spark, d):
    from .operators import curves

    x = t(spark, d, "lineitem").withColumn("f", (F.col("l_returnflag") == "R").cast("int"))
    return r6(encode.leak_report(curves.auc(x, NUMBERS, "f")))


@query("SELECT p_type AS level, count(*) AS rows FROM part GROUP BY 1 HAVING count(*) >= 10")
def one_hot_levels(spark, d):
    p = t(spark, d, "part").select("p_type")
    levels = encode.fit_levels(p, "p_type", 10, 1000)
    flags = encode.one_hot("p_type", levels)
    long = p.select(F.inline(F.array(*(F.struct(F.lit(v).alias("level"), c.alias("h")) for v, c in zip(levels, flags))))) if levels else spark.createDataFrame([], "level string, h int")
    return long.groupBy("level").agg(F.sum("h").alias("rows"))


@query("""SELECT 'p_types' AS "column", round(avg(contains(p_name, ' ')::INT), 6) AS share, 1 AS multi FROM part UNION ALL SELECT 'brand', round(avg(contains(p_brand, ' ')::INT), 6), (avg(contains(p_brand, ' ')::INT) >= 0.01)::INT FROM part""")
def multi_label_columns(spark, d):
    p = t(spark, d, "part").select(F.translate("p_name", " ", "|").alias("p_types"), F.translate("p_brand", " ", "|").alias("brand"))
    return r6(encode.multi_label(p, p.columns))


@query("SELECT p_partkey, greatest(list_contains(string_split(p_name, ' '), 'green'), (p_size > 25))::INT AS anycat__green FROM part")
def any_category_flags(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.translate("p_name", " ", "|").alias("a"), F.when(F.col("p_size") > 25, "green|x").otherwise("x").alias("b"))
    return p.select("p_partkey", *encode.any_category(["a", "b"], {"a": ["green", "red"], "b": ["green"]}))


@query("SELECT o_orderkey, round(o_totalprice / avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS price_ratio, (o_totalprice > 1000 AND o_orderstatus = 'F')::INT AS big_done FROM orders")
def custom_feature_hook(spark, d):
    from pyspark.sql.window import Window

    def hook(df):
        ratio = F.col("o_totalprice") / F.avg("o_totalprice").over(Window.partitionBy("o_custkey"))
        return df.withColumns({"price_ratio": ratio, "big_done": ((F.col("o_totalprice") > 1000) & (F.col("o_orderstatus") == "F")).cast("int")})

    out, new = encode.custom_features(t(spark, d, "orders"), hook, ["o_orderkey"], ("o_custkey",))
    return r6(out.select("o_orderkey", *new))


@query(f"""WITH {RW}, f AS (SELECT y, (l_quantity > 45)::INT AS a, (l_tax = 0)::INT AS b, (o_orderpriority = '1-URGENT')::INT AS c FROM rw)
SELECT 'a+b' AS combo, sum(a * b)::BIGINT AS n FROM f UNION ALL SELECT 'a+c', sum(a * c)::BIGINT FROM f UNION ALL SELECT 'a+b+c', sum(a * b * c)::BIGINT FROM f UNION ALL SELECT 'c', sum(c)::BIGINT FROM f""")
def bitmap_rule_counts(spark, d):
    items = {"a": F.col("l_quantity") > 45, "b": F.col("l_tax") == 0, "c": F.col("o_orderpriority") == "1-URGENT"}
    return rules.bitmap_counts(rw(spark, d), "l_orderkey", items, [("a", "b"), ("a", "c"), ("a", "b", "c"), ("c",)])


@query(f"""WITH {RW}, f AS (SELECT y, o_orderpriority, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS dis, l_quantity FROM rw), x AS (SELECT 'o_orderpriority in {{1-URGENT, 5-LOW}}' AS rule, (o_orderpriority IN ('1-URGENT', '5-LOW'))::INT AS h, y FROM f UNION ALL SELECT 'l_quantity > 25 AND dis IS NULL', (l_quantity > 25 AND dis IS NULL)::INT, y FROM f)
SELECT rule, sum(h * y)::BIGINT AS frauds, sum(h * (1 - y))::BIGINT AS goods, round(sum(h * y) / greatest(sum(y), 1), 6) AS fraud_share, round(sum(h * (1 - y)) / greatest(sum(1 - y), 1), 6) AS good_share, round(((sum(h * y) + .5) / (sum(y) + 1)) / ((sum(h * (1 - y)) + .5) / (sum(1 - y) + 1)), 6) AS lift FROM x GROUP BY rule""")
def level_and_null_rules(spark, d):
    x = rw(spark, d).withColumn("dis", F.nullif("l_discount", F.lit(0.0)))
    both = [rules.Rule(levels={"o_orderpriority": ["1-URGENT", "5-LOW"]}), rules.joined(rules.Rule({"l_quantity": (25.0, None, False)}), rules.Rule(nulls={"dis": True}))]
    return r6(rules.rule_counts(x, {r.text(): r.column() for r in both}, "y"))


@query(f"""WITH {RW}, k AS (SELECT l_linestatus AS v, count(*) AS n FROM rw WHERE y = 1 GROUP BY 1 HAVING count(*) >= 2) SELECT 'l_linestatus = ' || v AS item FROM k UNION ALL SELECT 'dis IS NULL' FROM rw WHERE y = 1 HAVING sum((l_discount = 0)::INT) >= 2""")
def level_and_null_items(spark, d):
    x = rw(spark, d).withColumn("dis", F.nullif("l_discount", F.lit(0.0)))
    found = rules.level_conditions(x, ["l_linestatus"], "y", 2) | rules.null_conditions(x, ["dis", "l_quantity"], "y", 2)
    return spark.createDataFrame([(k,) for k in found], "item string")


@query(f"""WITH {RW} SELECT 'l_quantity > 45' AS rule, round(sum((l_quantity > 45 AND o_orderpriority = '1-URGENT')::INT) / sum((o_orderpriority = '1-URGENT')::INT), 6) AS cluster_recall FROM rw""")
def rule_cluster_recall(spark, d):
    r = rules.Rule({"l_quantity": (45.0, None, False)})
    return r6(rules.cluster_recall(rw(spark, d), {r.text(): r.column()}, F.col("o_orderpriority") == "1-URGENT"))


_MO = f"""WITH {RW}, f AS (SELECT o_orderpriority AS segment, (l_quantity > 45)::INT AS a, (l_tax = 0)::INT AS b, (o_orderpriority = '1-URGENT' AND l_discount > 0.02)::INT AS c FROM rw), g AS (SELECT segment, avg(a) AS ca, avg(b) AS cb, avg(c) AS cc, sum(a) / sum(sum(a)) OVER () AS ra, sum(b) / sum(sum(b)) OVER () AS rb, sum(c) / sum(sum(c)) OVER () AS rc, avg(least(a + b + c, 1)) AS cov,
avg(a) / (sum(sum(a)) OVER () / sum(count(*)) OVER ()) AS ea, avg(b) / (sum(sum(b)) OVER () / sum(count(*)) OVER ()) AS eb, avg(c) / (sum(sum(c)) OVER () / sum(count(*)) OVER ()) AS ec FROM f GROUP BY 1)"""


@query(_MO + """, s AS (SELECT *, CASE WHEN cc >= ca AND cc >= cb THEN 'URG' WHEN ca >= cb THEN 'BIG' ELSE 'FREE' END AS top, CASE WHEN cc >= ca AND cc >= cb THEN rc WHEN ca >= cb THEN ra ELSE rb END AS rec, (ca >= .2 AND ea >= 1.5) AS sa, (cb >= .2 AND eb >= 1.5) AS sb, (cc >= .2 AND ec >= 1.5) AS sc FROM g)
SELECT segment, CASE WHEN cov < 0.3 THEN (CASE WHEN segment = '2-HIGH' THEN 'GAP:FREE' ELSE 'NEW' END) WHEN sa OR sb OR sc THEN (CASE WHEN rec >= 0.5 THEN 'ALIGNED:' ELSE 'SUBTYPE:' END) || concat_ws('+', CASE WHEN sc THEN 'URG' END, CASE WHEN sa THEN 'BIG' END, CASE WHEN sb THEN 'FREE' END) WHEN cov >= 0.7 THEN 'CROSS-MO' ELSE 'PARTIAL:' || top END AS ladder FROM s""")
def mo_segment_labels(spark, d):
    known = {"BIG": "l_quantity > 45", "FREE": "l_tax = 0", "URG": "o_orderpriority = '1-URGENT' and l_discount > 0.02"}
    x = segments.behaviours(rw(spark, d), known)
    coverage = x.groupBy(F.col("o_orderpriority").alias("segment")).agg(F.avg("mo_covered").alias("coverage"))
    near = coverage.select("segment", F.lit("FREE").alias("nearest"), F.when(F.col("segment") == "2-HIGH", 0.9).otherwise(0.1).alias("cosine"))
    return segments.significant_behaviours(segments.overlay(x, "o_orderpriority", [f"mo__{k}" for k in known]), coverage, near)


@query(f"WITH {RW} SELECT o_orderpriority AS segment, count(*) AS n FROM rw WHERE l_returnflag = 'R' AND NOT (l_quantity > 45 OR l_tax = 0) GROUP BY 1")
def residual_pool(spark, d):
    pool = segments.residual_pool(rw(spark, d).withColumn("f", (F.col("l_returnflag") == "R").cast("int")), MOS, "f", ("URGENT",))
    return pool.groupBy(F.col("o_orderpriority").alias("segment")).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS cluster, round(median(c_acctbal), 6) AS median_c_acctbal, count(*) AS n FROM customer GROUP BY 1")
def profile_medians(spark, d):
    c = t(spark, d, "customer")
    return r6(segments.with_profile(c.groupBy(F.col("c_nationkey").alias("cluster")).agg(F.count("*").alias("n")), segments.medians(c, "c_nationkey", ["c_acctbal"])))


@query(f"WITH {EMB}, g AS (SELECT label, cluster, count(*) AS k FROM a GROUP BY 1, 2) SELECT label AS segment, n::BIGINT AS n, cluster AS best, round(k / n, 6) AS share FROM (SELECT *, sum(k) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY k DESC, cluster) AS r FROM g) WHERE r = 1")
def segment_best_cluster(spark, d):
    return r6(segments.segment_overlap(_labelings(spark, d), "label", "cluster"))


@query(f"""WITH {RW}, f AS (SELECT o_orderpriority AS c, (l_quantity > 45)::INT AS a, (l_tax = 0)::INT AS b, (o_orderpriority = '1-URGENT')::INT AS u FROM rw WHERE l_returnflag = 'R'), l AS (SELECT 'BIG' AS mo, c, (a + b + u > 1)::INT AS o FROM f WHERE a = 1 UNION ALL SELECT 'FREE', c, (a + b + u > 1)::INT FROM f WHERE b = 1 UNION ALL SELECT 'URGENT', c, (a + b + u > 1)::INT FROM f WHERE u = 1),
g AS (SELECT mo, c, count(*) AS k, sum(o) AS o, count(*) / sum(count(*)) OVER (PARTITION BY mo) AS s FROM l GROUP BY 1, 2) SELECT mo, sum(k)::BIGINT AS n, round(sum(o) / sum(k), 6) AS overlap, round(sum(s * s), 6) AS herfindahl, sum((s >= 0.1)::INT)::BIGINT AS n_clusters, arg_min(c, (-s, c)) AS top_cluster FROM g GROUP BY 1""")
def known_mo_detail(spark, d):
    return r6(segments.behaviour_detail(rw(spark, d).withColumn("f", (F.col("l_returnflag") == "R").cast("int")), MOS, "o_orderpriority", "f"))


@query("WITH x AS (" + _driver_sql(["l_quantity", "l_tax", "l_discount"]) + ") SELECT cluster, string_agg(side || ' ' || \"column\", ', ' ORDER BY round(abs(d), 6) DESC, \"column\") AS signature FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(abs(d), 6) DESC, \"column\") AS r FROM x) WHERE r <= 2 GROUP BY cluster")
def cluster_signatures(spark, d):
    x = rw(spark, d).withColumns({c: F.col(c) + 0.0 for c in NUMBERS})
    return segments.signatures(r6(segments.drivers(x, "o_orderpriority", ["l_quantity", "l_tax", "l_discount"])), 2)


@query("WITH x AS (" + CAT + ") SELECT segment, \"column\", string_agg(value || ' ' || round(100 * train_share_in_segment, 0)::INT || '%', '; ' ORDER BY train_mule_no DESC, value) AS top FROM (SELECT *, row_number() OVER (PARTITION BY segment, \"column\" ORDER BY train_mule_no DESC, value) AS r FROM x WHERE value <> '<OTHER>') WHERE r <= 3 GROUP BY 1, 2")
def category_top_values(spark, d):
    x = rw(spark, d).select("o_orderpriority", (F.col("l_returnflag") == "R").cast("int").alias("m"), (F.col("l_orderkey") % 10 >= 7).cast("int").alias("v"), F.nullif(F.col("l_quantity").cast("int") % 7, F.lit(3)).alias("q"))
    return segments.top_values(r6(segments.categories(x, "o_orderpriority", ["q"], "m", "v")))


@query("SELECT label AS cluster, string_agg(f || ' ' || format('{:.3f}', m), '; ' ORDER BY r) AS drivers FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(m, 9) DESC, f) AS r FROM (SELECT label, 'f' || p AS f, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, p)) WHERE r <= 3 AND m > 0 GROUP BY label")
def cluster_driver_strings(spark, d):
    return segments.driver_strings(t(spark, d, "embeddings"), "label", F.transform("embedding", lambda x: x.cast("double")), [f"f{k}" for k in range(64)], 3)


@query("WITH a AS (SELECT o_custkey, max(o_orderpriority) AS s FROM orders GROUP BY 1), b AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY s) < 10 THEN '<RARE>' ELSE s END AS q FROM a), c AS (SELECT o_custkey, (row_number() OVER (PARTITION BY q ORDER BY o_custkey) <= floor(0.3 * count(*) OVER (PARTITION BY q)))::INT AS is_val FROM b) SELECT o_orderkey, is_val FROM orders JOIN c ON orders.o_custkey = c.o_custkey")
def account_split(spark, d):
    return models.train_val_split(t(spark, d, "orders"), "o_orderkey", 0.3, "account", "o_orderpriority", "o_custkey").select("o_orderkey", "is_val")


@query("SELECT o_orderkey, (epoch_us(o_orderdate) > (SELECT quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.7) FROM orders))::INT AS is_val FROM orders")
def time_split(spark, d):
    return models.train_val_split(t(spark, d, "orders"), "o_orderkey", 0.3, "time", day="o_orderdate").select("o_orderkey", "is_val")


@query(f"WITH {RW}, c AS (SELECT quantile_cont(l_extendedprice, 0.99) AS cut FROM rw WHERE y = 0) SELECT l_orderkey, l_linenumber, l_partkey FROM rw, c WHERE y = 1 AND l_extendedprice < cut")
def missed_by_existing_score(spark, d):
    from .plans import discovery

    return discovery.missed(rw(spark, d), "y", 0.01, "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH r AS (SELECT c_custkey AS k, c_acctbal AS x, c_mktsegment AS m FROM customer), s AS (SELECT max(x) - min(x) AS s FROM r WHERE k % 5 = 0), d AS (SELECT a.k AS a, b.k AS b, (abs(a.x - b.x) / s + (a.m <> b.m)::INT) / 2 AS d FROM r a JOIN r b ON b.k % 5 = 0 AND a.k <> b.k, s)
SELECT a AS c_custkey, round(avg(d), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d) WHERE r <= 7 GROUP BY a""")
def knn_raw_gower(spark, d):
    c = t(spark, d, "customer")
    return r6(similarity.raw_gower_knn(c, c.where("c_custkey % 5 = 0"), "c_custkey", ["c_acctbal"], ["c_mktsegment"]))


@query("""WITH v AS (SELECT vec_id AS k, label, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings), d AS (SELECT a.k AS a, (b.label < 3)::INT AS y, exp(-sum((a.x - b.x) ** 2) / 1.5) AS s FROM v a JOIN v b ON a.p = b.p AND b.k % 5 = 0 AND a.k % 5 <> 0 GROUP BY a.k, b.k, b.label) SELECT a AS vec_id, round(ln((sum(y * s) + 1e-12) / (sum((1 - y) * s) + 1e-12)), 5) AS score FROM d GROUP BY a""")
def knn_fixed_kernel(spark, d):
    e = t(spark, d, "embeddings").withColumn("y", (F.col("label") < 3).cast("int"))
    return r6(similarity.fixed_kernel_scores(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0"), "vec_id", "embedding", "y", 1.5), 5)


@query("""WITH v AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2), m AS (SELECT u.user_id, s.s, coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY u.user_id) AS p FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type AS s FROM events) s LEFT JOIN v ON v.user_id = u.user_id AND v.event_type = s.s),
g AS (SELECT user_id % 4 AS g, s, (avg(p) + 1e-6) / (1 + 5e-6) AS p FROM m GROUP BY 1, 2), j AS (SELECT x.g AS a, y.g AS b, sum(x.p * log2(x.p / ((x.p + y.p) / 2)) + y.p * log2(y.p / ((x.p + y.p) / 2))) / 2 AS js FROM g x JOIN g y ON x.s = y.s AND x.g < y.g GROUP BY 1, 2) SELECT a, b, round(js / max(js) OVER (), 6) AS js FROM j""")
def occupation_mix_distance(spark, d):
    m = accounts.mixes(ev(spark, d), "user_id", "event_type", TYPES).withColumn("g", F.col("user_id") % 4)
    return r6(similarity.group_mix_distances(m, "g", "mix"))


@query("""WITH b AS (SELECT c_custkey AS a, c_custkey + 1 AS b, (c_custkey % 7) / 7.0::DOUBLE AS x, (c_custkey % 3) / 3.0::DOUBLE AS y FROM customer) SELECT a, b, 'full' AS variant, round((2 * x + y) / 3, 6) AS distance FROM b UNION ALL SELECT a, b, 'no_x', round(y, 6) FROM b UNION ALL SELECT a, b, 'no_y', round(x, 6) FROM b""")
def ablation_variants(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"), (F.col("c_custkey") % 7 / 7).alias("x"), (F.col("c_custkey") % 3 / 3).alias("y"))
    return r6(similarity.ablation_distances(c, {"x": 2.0, "y": 1.0}))


@query("SELECT vec_id, string_agg('f' || p, ', ' ORDER BY round(abs(x * w), 9) DESC, 'f' || p) AS drivers FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(abs(x * w), 9) DESC, 'f' || p) AS r FROM (SELECT vec_id, p, x, 1 + p % 3 AS w FROM (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings))) WHERE r <= 3 GROUP BY vec_id")
def driver_names(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return similarity.driver_names(e, "vec_id", "v", [f"f{k}" for k in range(64)], [1.0 + k % 3 for k in range(64)])


@query("SELECT user_id, round(avg((event_type IN ('error', 'signup'))::INT), 6) AS risky_share FROM events GROUP BY 1")
def mss_risky_share(spark, d):
    return r6(accounts.risky_share(ev(spark, d), "user_id", "event_type", ["error", "signup"]))


_CELL = "max(CASE WHEN from_state = '{a}' AND to_state = '{b}' THEN ln(p) END) - avg(CASE WHEN from_state = '{a}' THEN ln(p) END)"


@query("WITH p AS (" + ORACLES["transition_block"].replace("round((coalesce(c, 0) + 0.5::DOUBLE)", "((coalesce(c, 0) + 0.5::DOUBLE)").replace("PARTITION BY g.user_id, g.a), 6) AS p", "PARTITION BY g.user_id, g.a)) AS p") + ") SELECT user_id, " + ", ".join(f"round({_CELL.format(a=a, b=b)}, 6) + 0.0 AS dy_clr_{a}__{b}" for a in TYPES for b in TYPES) + " FROM p GROUP BY user_id")
def transition_log_ratios(spark, d):
    return r6(accounts.transition_log_ratios(accounts.transitions(ev(spark, d), "user_id", "t", "event_id", "event_type", TYPES), "user_id", TYPES))


@query("WITH p AS (SELECT o_custkey, sum(o_totalprice) AS s, max(o_totalprice) AS m, min(o_orderdate)::DATE AS f FROM orders GROUP BY 1) SELECT o_custkey, round(ln((s + 1) / greatest(c_acctbal, 1)), 6) AS spend_to_income, round(ln((m + 1) / greatest(c_acctbal, 1)), 6) AS max_to_income, greatest(date_diff('day', f, DATE '2005-01-01'), 0)::INT AS account_age FROM p JOIN customer ON c_custkey = o_custkey")
def mss_spend_ratios(spark, d):
    p = t(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.max("o_totalprice").alias("m"), F.min("o_orderdate").alias("f"))
    p = p.join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    return r6(accounts.spend_ratios(p, "o_custkey", "s", "m", "c_acctbal", "f", "2005-01-01"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place FROM customer")
def row_numbers(spark, d):
    return ranks.numbered(t(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal"), F.col("c_custkey")], "place").select("c_custkey", "place")


@query()
def gain_ranked_features(spark, d):
    return spark.createDataFrame([(k, c) for k, c in enumerate(models.gain_ranking(_labelled(spark, d), NUMBERS, "f", trees=5))], "place int, feature string")


@query()
def early_stopped_auc(spark, d):
    from .operators import curves

    x = _labelled(spark, d)
    m = models.early_stopped(x, NUMBERS, "f", "o_custkey", trees=30)
    return r6(curves.auc(models.scored_by(m, x, NUMBERS), ["score"], "f"), 2)


@query()
def bic_choice(spark, d):
    e = t(spark, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("v"), (F.col("vec_id") % 2).alias("train"))
    return r6(models.choose_k_by_bic(e, "v", range(2, 5), "train"), 2)


@query()
def bootstrap_stability(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return r6(models.bootstrap_stability(e, "vec_id", "v", 4), 4)


@query()
def cluster_separability(spark, d):
    p = t(spark, d, "customer").withColumn("c", (F.col("c_acctbal") > 4000).cast("int"))
    return r6(models.separability(p, ["c_acctbal", "c_nationkey"], "c"))


@query()
def scatter_plane(spark, d):
    return models.plane(t(spark, d, "embeddings"), "vec_id", "embedding")


@query()
def whitened_block(spark, d):
    e = t(spark, d, "customer").select("c_custkey", F.array((F.col("c_acctbal") / 1000), F.col("c_nationkey").cast("double")).alias("v"), (F.col("c_custkey") % 3 == 0).cast("int").alias("y"))
    pairs = e.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return r6(similarity.block_distance(pairs, e, "c_custkey", "v", similarity.within_class_whitening(e, "v", "y"), similarity.median_bandwidth(e, "c_custkey", "v")))


@query()
def hard_negative_pairs(spark, d):
    c = t(spark, d, "customer").withColumn("y", (F.col("c_acctbal") > 8000).cast("int"))
    return similarity.hard_negatives(c, "c_custkey", "c_mktsegment", "y")


@query()
def sub_segments(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return models.sub_segments(e, "v", "label", 2, 50).select("vec_id", "label", "sub")
