"""Bindings for view columns and temporal rules.

title = l_partkey, views = l_quantity, region = the supplier's region name
(normalised), year / quarter of l_shipdate. start_year = year(o_orderdate),
measured year = year(l_shipdate).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import normalise_name
from tessera.operators import views
from tessera.plans.common import sig, sql_sig, table

YEARS = list(range(1995, 2002))
QUARTERS = ["q1", "q2", "q3", "q4"]
REGIONS = ["africa", "america", "asia", "europe", "middle_east"]
RUN_YEAR = 1999


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    su = table(spark, sf_dir, "supplier")
    na = views.bounded_broadcast(table(spark, sf_dir, "nation"), 1000)
    re_ = views.bounded_broadcast(table(spark, sf_dir, "region"), 1000)
    return (li.join(su, li.l_suppkey == su.s_suppkey)
              .join(na, F.col("s_nationkey") == F.col("n_nationkey"))
              .join(re_, F.col("n_regionkey") == F.col("r_regionkey"))
              .select(F.col("l_partkey").alias("title"),
                      F.concat(F.lit("q"), F.quarter("l_shipdate").cast("string")).alias("period"),
                      F.year("l_shipdate").cast("long").alias("year"),
                      normalise_name("r_name").alias("region"),
                      F.col("l_quantity").alias("views"), "l_shipdate"))


def _long(spark, sf_dir):
    return (_lines(spark, sf_dir).groupBy("title", "period", "year", "region")
            .agg(F.sum("views").alias("views")))


def views_long(spark, sf_dir):
    return _long(spark, sf_dir)


def _wide(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").count()  # from the files' footers; cells are fewer
    return views.pivot_views(_long(spark, sf_dir), "title", QUARTERS, YEARS, REGIONS, rows=lines)


def views_wide(spark, sf_dir):
    w = _wide(spark, sf_dir)
    # one row per title: total and the number of measured cells
    cols = [c for c in w.columns if c != "title"]
    measured = sum((F.col(c).isNotNull().cast("long") for c in cols), F.lit(0).cast("long"))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return w.select("title", measured.alias("cells"), total.alias("total_views"),
                    F.col("views_q1_98_europe"), F.col("views_q4_01_asia"))


def views_parse(spark, sf_dir):
    return views.unpivot_views(_wide(spark, sf_dir), ["title"])


def views_rollup(spark, sf_dir):
    # year is a report label here (NULL on the subtotal rows)
    long = _long(spark, sf_dir).withColumn("year", F.col("year").cast("string"))
    return views.period_rollup(long)


def top10_daily(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return views.top_titles(lines, ["month", "region"], "title", 10)


def top10_per_day(spark, sf_dir):
    """W8 by day and region (``top10_daily`` ranks months)."""
    lines = _lines(spark, sf_dir).withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return views.top_titles(lines, ["day", "region"], "title", 10)


def _temporal(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders")
    return (li.join(od, li.l_orderkey == od.o_orderkey)
              .select("l_orderkey", "l_linenumber",
                      F.year("o_orderdate").cast("long").alias("start_year"),
                      F.year("l_shipdate").cast("long").alias("year"),
                      F.col("l_quantity").alias("views")))


def temporal_violations(spark, sf_dir):
    return views.temporal_violations(_temporal(spark, sf_dir), group_cols=["start_year"])


def temporal_mask(spark, sf_dir):
    return views.temporal_mask(_temporal(spark, sf_dir))


def future_zero(spark, sf_dir):
    t = views.future_zero(views.temporal_mask(_temporal(spark, sf_dir)), RUN_YEAR)
    return t.groupBy("l_orderkey", "start_year").agg(
        F.sum("views").alias("views"), F.count("views").alias("measured"))


def _star(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders")
    cu = table(spark, sf_dir, "customer")
    na = views.bounded_broadcast(table(spark, sf_dir, "nation"), 1000)
    re_ = views.bounded_broadcast(table(spark, sf_dir, "region"), 1000)
    return (li.join(od, li.l_orderkey == od.o_orderkey)
              .join(cu, F.col("o_custkey") == F.col("c_custkey"))
              .join(na, F.col("c_nationkey") == F.col("n_nationkey"))
              .join(re_, F.col("n_regionkey") == F.col("r_regionkey"))
              .select("r_name", "n_name", "n_nationkey", "n_regionkey",
                      (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")))


def star_join(spark, sf_dir):
    out = _star(spark, sf_dir).groupBy("r_name", "n_name").agg(
        F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("lines"))
    return out.select("r_name", "n_name", sig("revenue").alias("revenue"), "lines")


def lookup_weight(spark, sf_dir):
    na = table(spark, sf_dir, "nation")
    lookup = (na.filter(F.col("n_regionkey").isin(1, 3))
                .select("n_nationkey", (F.lit(1.0) + F.col("n_nationkey") / 100).alias("weight")))
    w = views.lookup_weight(_star(spark, sf_dir), lookup, "n_nationkey")
    out = w.groupBy("n_name").agg(F.sum(F.col("revenue") * F.col("weight")).alias("weighted_revenue"),
                                  F.max("weight").alias("weight"))
    return out.select("n_name", sig("weighted_revenue").alias("weighted_revenue"), sig("weight").alias("weight"))


def studio_roi(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pa = table(spark, sf_dir, "part")
    su = table(spark, sf_dir, "supplier")
    df = (li.join(pa, li.l_partkey == pa.p_partkey).join(su, li.l_suppkey == su.s_suppkey)
            .select("s_name", "l_partkey", "l_extendedprice",
                    (F.col("l_quantity") * F.col("p_retailprice")).alias("cost")))
    out = views.group_products(df, "s_name", "l_partkey", "l_extendedprice", "cost")
    return out.select("s_name", "titles", sig("revenue").alias("revenue"), sig("cost").alias("cost"),
                      sig("roi").alias("roi"))


def _wide_features(spark, sf_dir):
    w = _wide(spark, sf_dir)
    return w, [c for c in w.columns if c.startswith("views_")]


def wide_variance_topk(spark, sf_dir):
    """The flagship selection on a real wide table: every view column
    (zero-filled, as the original), variance >= 0.01, top 200."""
    from tessera.operators import profile

    w, feats = _wide_features(spark, sf_dir)
    top = profile.select_top_variance(profile.feature_variance(w, feats))
    # 12 digits: whole-number inputs give exact short decimals that a
    # 10-digit rounding could split at a tie
    return top.select("feature", sig("variance", 12).alias("variance"))


WIDE_CORR_YEAR = 1998


def wide_correlation(spark, sf_dir):
    """Pairwise correlation of the 20 view columns of one year (NULL = no
    measurement, so pairs use the titles measured in both)."""
    from tessera.operators import profile

    w, _ = _wide_features(spark, sf_dir)
    feats = sorted(views.view_column_name(q, WIDE_CORR_YEAR, r) for q in QUARTERS for r in REGIONS)
    corr = profile.correlation_long(w, feats)
    return corr.select("f1", "f2", "n", sig("r", 9).alias("r"))


def wide_correlation_all(spark, sf_dir):
    """Pairwise correlation of all view columns, within and across years. r is
    rounded to 9 decimals: pairs with few titles have r of exactly 0."""
    from tessera.operators import profile

    w, feats = _wide_features(spark, sf_dir)
    corr = profile.correlation_long(w, sorted(feats))
    return corr.select("f1", "f2", "n", (F.round("r", 9) + F.lit(0.0)).alias("r"))


QUERIES = {
    "wide_correlation_all": wide_correlation_all,
    "wide_variance_topk": wide_variance_topk,
    "wide_correlation": wide_correlation,
    "views_long": views_long, "views_wide": views_wide, "views_parse": views_parse,
    "views_rollup": views_rollup, "top10_daily": top10_daily, "top10_per_day": top10_per_day,
    "temporal_violations": temporal_violations, "temporal_mask": temporal_mask,
    "future_zero": future_zero, "star_join": star_join, "lookup_weight": lookup_weight,
    "studio_roi": studio_roi,
}

_LINES = """WITH lines AS (SELECT l_partkey AS title, 'q' || CAST(quarter(l_shipdate) AS VARCHAR) AS period,
  CAST(year(l_shipdate) AS BIGINT) AS year, replace(lower(r_name), ' ', '_') AS region, l_quantity AS views, l_shipdate
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
long AS (SELECT title, period, year, region, sum(views) AS views FROM lines GROUP BY ALL)
"""


def _wide_sql():
    names = [(views.view_column_name(q, y, r), q, y, r) for y in YEARS for q in QUARTERS for r in REGIONS]
    cols = ", ".join(f"sum(CASE WHEN period = '{q}' AND year = {y} AND region = '{r}' THEN views END) AS {n}"
                     for n, q, y, r in names)
    measured = " + ".join(f"CAST({n} IS NOT NULL AS BIGINT)" for n, *_ in names)
    total = " + ".join(f"coalesce({n}, 0.0)" for n, *_ in names)
    return (_LINES + f", wide AS (SELECT title, {cols} FROM long GROUP BY title) "
            f"SELECT title, {measured} AS cells, {total} AS total_views, views_q1_98_europe, views_q4_01_asia FROM wide")


_TEMPORAL = """WITH t AS (SELECT l_orderkey, l_linenumber, CAST(year(o_orderdate) AS BIGINT) AS start_year,
  CAST(year(l_shipdate) AS BIGINT) AS year, l_quantity AS views FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""

_STAR = """WITH s AS (SELECT r_name, n_name, n_nationkey, n_regionkey, l_extendedprice * (1 - l_discount) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""

def _wide_cte():
    names = [(views.view_column_name(q, y, r), q, y, r) for y in YEARS for q in QUARTERS for r in REGIONS]
    cols = ", ".join(f"sum(CASE WHEN period = '{q}' AND year = {y} AND region = '{r}' THEN views END) AS {n}"
                     for n, q, y, r in names)
    return _LINES + f", wide AS (SELECT title, {cols} FROM long GROUP BY title) ", [n for n, *_ in names]


def _wide_variance_sql():
    cte, names = _wide_cte()
    arms = " UNION ALL ".join(f"SELECT '{c}' AS feature, var_pop(coalesce({c}, 0.0)) AS variance FROM wide"
                              for c in names)
    return (cte + f"SELECT feature, {sql_sig('variance', 12)} AS variance FROM ({arms}) v "
            f"WHERE variance >= 0.01 AND NOT isnan(variance) ORDER BY variance DESC, feature LIMIT 200")


def _wide_corr_sql():
    cte, _ = _wide_cte()
    feats = sorted(views.view_column_name(q, WIDE_CORR_YEAR, r) for q in QUARTERS for r in REGIONS)
    arms = " UNION ALL ".join(
        f"SELECT '{a}' AS f1, '{b}' AS f2, count({a} + {b}) AS n, "
        f"CASE WHEN var_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) > 0 "
        f"AND var_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) > 0 THEN corr({a}, {b}) END AS r FROM wide"
        for i, a in enumerate(feats) for b in feats[i + 1:])
    return cte + f"SELECT f1, f2, n, {sql_sig('r', 9)} AS r FROM ({arms}) c"


def _wide_corr_all_sql():
    names = ", ".join(f"('{views.view_column_name(q, y, r)}')" for y in YEARS for q in QUARTERS for r in REGIONS)
    # quantities are whole numbers: the sums, and so the test for constant columns, are exact
    return _LINES + f""", names AS (SELECT * FROM (VALUES {names}) v(c)),
        cells AS (SELECT title, 'views_' || period || '_' || right(CAST(year AS VARCHAR), 2) || '_' || region AS c,
          CAST(views AS HUGEINT) AS v FROM long WHERE views IS NOT NULL),
        s AS (SELECT a.c AS f1, b.c AS f2, count(*) AS n, count(*) * sum(a.v * a.v) - sum(a.v) * sum(a.v) AS xx,
          count(*) * sum(b.v * b.v) - sum(b.v) * sum(b.v) AS yy, count(*) * sum(a.v * b.v) - sum(a.v) * sum(b.v) AS xy
          FROM cells a JOIN cells b ON a.title = b.title AND a.c < b.c GROUP BY ALL)
        SELECT x.c AS f1, y.c AS f2, coalesce(n, 0) AS n,
          round(CASE WHEN xx > 0 AND yy > 0 THEN xy / (sqrt(xx) * sqrt(yy)) END, 9) + 0.0 AS r
        FROM names x JOIN names y ON x.c < y.c LEFT JOIN s ON s.f1 = x.c AND s.f2 = y.c"""


ORACLE = {
    "wide_correlation_all": _wide_corr_all_sql(),
    "wide_variance_topk": _wide_variance_sql(),
    "wide_correlation": _wide_corr_sql(),
    "views_long": _LINES + "SELECT * FROM long",
    "views_wide": _wide_sql(),
    "views_parse": _LINES + "SELECT * FROM long",
    "views_rollup": _LINES + """SELECT region, CAST(year AS VARCHAR) AS year, period, sum(views) AS views,
        CAST(grouping(region, year, period) AS BIGINT) AS level FROM long GROUP BY ROLLUP (region, year, period)""",
    "top10_daily": _LINES + """, per AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, region, title, sum(views) AS views
        FROM lines GROUP BY ALL)
        SELECT * FROM (SELECT month, region, title, views,
          rank() OVER (PARTITION BY month, region ORDER BY views DESC) AS rank FROM per) WHERE rank <= 10""",
    "top10_per_day": _LINES + """, per AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, region, title, sum(views) AS views
        FROM lines GROUP BY ALL)
        SELECT * FROM (SELECT day, region, title, views,
          rank() OVER (PARTITION BY day, region ORDER BY views DESC) AS rank FROM per) WHERE rank <= 10""",
    "temporal_violations": _TEMPORAL + """SELECT start_year, count(*) AS checked,
        count(*) FILTER (WHERE year < start_year) AS violations FROM t GROUP BY start_year""",
    "temporal_mask": _TEMPORAL + """SELECT l_orderkey, l_linenumber, start_year, year,
        CASE WHEN year >= start_year THEN views END AS views FROM t""",
    "future_zero": _TEMPORAL + """, m AS (SELECT l_orderkey, start_year,
        CASE WHEN start_year > 1999 THEN 0.0 ELSE CASE WHEN year >= start_year THEN views END END AS views FROM t)
        SELECT l_orderkey, start_year, sum(views) AS views, count(views) AS measured FROM m GROUP BY ALL""",
    "star_join": _STAR + f"""SELECT r_name, n_name, {sql_sig('sum(revenue)')} AS revenue, count(*) AS lines
        FROM s GROUP BY ALL""",
    "lookup_weight": _STAR + f""", lk AS (SELECT n_nationkey, 1.0 + n_nationkey / 100 AS weight FROM nation
          WHERE n_regionkey IN (1, 3)),
        w AS (SELECT s.*, coalesce(lk.weight, 1.0) AS weight FROM s LEFT JOIN lk ON s.n_nationkey = lk.n_nationkey)
        SELECT n_name, {sql_sig('sum(revenue * weight)')} AS weighted_revenue, {sql_sig('max(weight)')} AS weight
        FROM w GROUP BY n_name""",
    "studio_roi": f"""SELECT s_name, count(DISTINCT l_partkey) AS titles, {sql_sig('sum(l_extendedprice)')} AS revenue,
        {sql_sig('sum(l_quantity * p_retailprice)')} AS cost,
        {sql_sig('sum(l_extendedprice) / sum(l_quantity * p_retailprice)')} AS roi
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name""",
}
