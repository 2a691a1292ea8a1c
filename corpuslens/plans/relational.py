"""Generic relational shapes on the star schema and events, and the streaming extension, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.operators import intervals as iv
from corpuslens.sources.corpus import table
from corpuslens.streaming import keyed as kd
from corpuslens.streaming import windows as st

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# --- intervals on events --------------------------------------------------------------------------------------------

SPANS = "iv AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + CAST(ceil(value) AS BIGINT) * 60 AS e FROM events)"
MERGED = SPANS + """, r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
 g AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r),
 merged AS (SELECT user_id, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, island)"""


def spans(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    start = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("long")
    return e.select("event_id", "user_id", "event_type", start.alias("start"), (start + F.ceil("value").cast("long") * 60).alias("end"))


@query(f"WITH {MERGED} SELECT user_id, s AS start, e AS \"end\" FROM merged")
def interval_merge(spark, sf_dir):
    """Unions of each user's overlapping intervals."""
    return iv.merged(spans(spark, sf_dir), "user_id")


HALVES = SPANS.replace("iv AS", "all_ AS") + """, iv AS (SELECT * FROM all_ JOIN events USING (event_id) WHERE event_type = 'click')"""


def halves(spark, sf_dir):
    s = spans(spark, sf_dir)
    return iv.merged(s.filter("event_type = 'click'"), "user_id"), iv.merged(s.filter("event_type = 'view'"), "user_id")


def merged_sql(name: str, kind: str) -> str:
    return f"""{name}r AS (SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM base WHERE event_type = '{kind}'),
 {name}g AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {name}r), {name} AS (SELECT user_id, min(s) AS s, max(e) AS e FROM {name}g GROUP BY user_id, island)"""


BASE = "base AS (SELECT event_type, user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + CAST(ceil(value) AS BIGINT) * 60 AS e FROM events)"
TWO = f"{BASE}, {merged_sql('a', 'click')}, {merged_sql('b', 'view')}"


@query(f"WITH {TWO} SELECT a.user_id, greatest(a.s, b.s) AS start, least(a.e, b.e) AS \"end\" FROM a JOIN b USING (user_id) WHERE a.s < b.e AND b.s < a.e")
def interval_intersect(spark, sf_dir):
    """What two sets of intervals share."""
    a, b = halves(spark, sf_dir)
    return iv.intersected(a, b, "user_id", cell=3600)


@query(f"""WITH {TWO}, k AS (SELECT user_id, s AS pos, 1 AS da, 0 AS db FROM a UNION ALL SELECT user_id, e, -1, 0 FROM a UNION ALL SELECT user_id, s, 0, 1 FROM b UNION ALL SELECT user_id, e, 0, -1 FROM b),
 n AS (SELECT user_id, pos, sum(da) AS da, sum(db) AS db FROM k GROUP BY user_id, pos), w AS (SELECT user_id, pos AS s, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS e, sum(da) OVER (PARTITION BY user_id ORDER BY pos) AS ia, sum(db) OVER (PARTITION BY user_id ORDER BY pos) AS ib FROM n),
 f AS (SELECT user_id, s, e FROM w WHERE ia > 0 AND ib = 0 AND e IS NOT NULL), r AS (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY s) AS p FROM f), g AS (SELECT *, sum(CASE WHEN s <= p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS i FROM r)
 SELECT user_id, min(s) AS start, max(e) AS "end" FROM g GROUP BY user_id, i""")
def interval_subtract(spark, sf_dir):
    """What the first set has and the second lacks."""
    return iv.subtracted(*halves(spark, sf_dir), "user_id")


@query(f"WITH {TWO} SELECT user_id, x.s AS start, x.e AS \"end\" FROM base x WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM b WHERE b.user_id = x.user_id AND x.s >= b.s AND x.e <= b.e AND (x.e > x.s OR x.s < b.e))")
def interval_containment(spark, sf_dir):
    """Intervals inside some interval of the other set."""
    inner = spans(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", "start", "end")
    return iv.contained(inner, halves(spark, sf_dir)[1], "user_id", cell=3600)


# --- star schema ----------------------------------------------------------------------------------------------------


@query("WITH b AS (SELECT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN (SELECT p_brand FROM part ORDER BY p_brand LIMIT 1) OR p_brand IN (SELECT max(p_brand) FROM part)) SELECT l_orderkey, count(DISTINCT p_brand) AS brands FROM b GROUP BY l_orderkey HAVING count(DISTINCT p_brand) = 2")
def division_orders_parts(spark, sf_dir):
    """A9's shape: orders that have parts of both given brands."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    ends = part.agg(F.min("p_brand").alias("x"), F.max("p_brand").alias("y"))
    two = ends.select(F.explode(F.array("x", "y")).alias("p_brand"))
    wanted = part.join(F.broadcast(two), "p_brand", "left_semi")  # two brands
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(wanted, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand").distinct()
    return found.groupBy("l_orderkey").agg(F.count("*").alias("brands")).filter("brands = 2")


@query("WITH r AS (SELECT n_name, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT n_name, c_custkey, c_acctbal, rank FROM r WHERE rank <= 3")
def topk_per_group(spark, sf_dir):
    """L*: the three first of each group, by a window with a group limit."""
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    r = F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return c.withColumn("rank", r.cast("long")).filter("rank <= 3").select("n_name", "c_custkey", "c_acctbal", "rank")


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets_sales(spark, sf_dir):
    """A3's shape: totals at three levels in one pass."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return li.rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube_orders(spark, sf_dir):
    """Extension: a cube."""
    return table(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY r_name, n_name")
def revenue_by_nation(spark, sf_dir):
    """Joins of facts and dimensions, pruned and filtered at the scans."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    by_nation = joined.groupBy("c_nationkey").agg(F.sum("r").alias("r"))
    return by_nation.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", F.round("r", 2).alias("revenue"))  # 25 rows


# --- streaming extension --------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS v FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """Extension: tumbling windows of an hour, run as a stream to its end."""
    return st.run_to_end(spark, sf_dir, st.tumbling)


@query("SELECT w AS window_start, count(*) AS n, round(sum(value), 3) AS v FROM (SELECT value, unnest([time_bucket(INTERVAL 30 minute, ts), time_bucket(INTERVAL 30 minute, ts) - INTERVAL 30 minute]) AS w FROM events) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    """Extension: windows of an hour each half hour."""
    return st.run_to_end(spark, sf_dir, st.sliding)


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 4 hour THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 4 hour AS window_end, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, sf_dir):
    """Extension: sessions of a user with gaps under four hours."""
    return st.run_to_end(spark, sf_dir, st.sessions)


def halfway(spark, sf_dir):
    """The events, and the moment halfway between the first and the last."""
    e = table(spark, sf_dir, "events")
    span = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select((F.unix_micros(F.col("a").cast("timestamp")) / 2 + F.unix_micros(F.col("b").cast("timestamp")) / 2).cast("long")).first()[0]
    return e, F.timestamp_micros(F.lit(span))


HALF = "half AS (SELECT make_timestamp((epoch_us(min(ts)) // 2 + epoch_us(max(ts)) // 2)) AS mid FROM events)"


@query(f"WITH {HALF} SELECT event_id, user_id, ts FROM events, half WHERE NOT (event_type = 'error' AND ts < mid - INTERVAL 12 HOUR)")
def stream_deduplicated(spark, sf_dir):
    """Extension: events in two steps, the second with repeats of all of the first and with errors that come hours too late: each event that
    is in time once."""
    e, mid = halfway(spark, sf_dir)
    ts, late = F.col("ts").cast("timestamp"), F.col("event_type") == "error"
    tardy = late & (ts < mid - F.expr("INTERVAL 12 HOURS")) | ~late & (ts > mid - F.expr("INTERVAL 1 HOUR"))
    first = e.filter((ts <= mid) & ~F.coalesce(tardy, F.lit(False)))
    second = e.filter((ts > mid) | F.coalesce(tardy, F.lit(False))).unionByName(first)
    return st.run_in_steps(spark, [first.unionByName(first), second], kd.deduplicated).select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 4 hour THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, round(sum(coalesce(value, 0)), 3) AS total FROM s GROUP BY user_id, k""")
def stream_idle_entries(spark, sf_dir):
    """Extension: state by user: entries put out when a user has been idle by the watermark, of events that come in two steps out of order."""
    e, mid = halfway(spark, sf_dir)
    ts = F.col("ts").cast("timestamp")
    tardy = (F.col("event_type") == "view") & (ts > mid - F.expr("INTERVAL 1 HOUR"))
    first, second = e.filter((ts <= mid) & ~tardy), e.filter((ts > mid) | (ts <= mid) & tardy)
    out = st.run_in_steps(spark, [first, second, st.far_end(e)], kd.idle_entries)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("user_id", ntz("first_ts"), ntz("last_ts"), "n", F.round("total", 3).alias("total"))
