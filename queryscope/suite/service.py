"""Service-log and stream queries on events, customers and orders."""

from pyspark.sql import functions as F

from queryscope.functions import scalars as S
from queryscope.operators.findings import lint_findings
from queryscope.plans.fixtures import api_keys, query_log
from queryscope.streaming import live as V, service as R
from queryscope.suite.golden import GOLDEN
from queryscope.suite.registry import query
from queryscope.suite.sqltext import expect_sql, log_sql

NOW = "1996-06-01"
_now = lambda: F.lit(NOW).cast("timestamp")

KEYS_SQL = """(SELECT CASE WHEN k % 7 = 0 THEN 'test_' ELSE 'live_' END || k AS api_key, k AS owner,
 CASE WHEN k % 2 = 0 THEN 'monthly' WHEN k % 11 = 1 THEN NULL ELSE 'annual' END AS plan,
 CASE WHEN k % 5 = 0 THEN '' ELSE 'c' || k || '@example.com' END AS email, created_at, k % 3 = 0 AS reminder_sent
 FROM (SELECT c_custkey k, min(o_orderdate) created_at FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1))"""
EXP_SQL = f"""(SELECT *, created_at + to_days(CASE COALESCE(plan, 'monthly') WHEN 'monthly' THEN 30 ELSE 365 END) AS expires_at FROM {KEYS_SQL})"""


def _keys(t):
    return R.with_expiry(api_keys(t.customer, t.orders))


#: the limiter walked hit by hit: the accepted times of the last window travel along
_LIMITER = """WITH RECURSIVE n AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 w AS (SELECT user_id, rn, event_id, TRUE AS accepted, [us] AS kept FROM n WHERE rn = 1
 UNION ALL SELECT user_id, rn, event_id, ok, CASE WHEN ok THEN list_append(kept, us) ELSE kept END FROM (
  SELECT n.user_id, n.rn, n.event_id, n.us, w.kept, NOT (len(w.kept) >= 3 AND n.us - w.kept[-3] <= 86400000000) AS ok FROM w JOIN n ON n.user_id = w.user_id AND n.rn = w.rn + 1))
 SELECT event_id, user_id, accepted FROM w"""


@query("r01_throttle", _LIMITER)
def _(t):
    return R.throttle(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3, 86400).select("event_id", "user_id", "accepted")


@query("r01_throttle_stream", _LIMITER)
def _(t):
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return R.drain(R.throttle_stream(stream, "user_id", "ts", "event_id", 3, 86400), R.scratch(t.spark, "throttle")).select("event_id", "user_id", "accepted")


_RATE = """SELECT user_id, strftime(w, '%Y-%m-%d %H:%M') AS window_start, count(*) AS hits FROM
 (SELECT user_id, ts, unnest(generate_series(date_trunc('minute', ts) - INTERVAL 9 MINUTE, date_trunc('minute', ts), INTERVAL 1 MINUTE)) AS w FROM events) {} GROUP BY 1, 2"""


def _rate(d):
    return d.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "hits")


@query("r02_hit_rate", _RATE.format(""))
def _(t):
    return _rate(R.hit_rate(t.events, "user_id", "ts"))


@query(
    "r02_hit_rate_stream",
    _RATE.format("WHERE w + INTERVAL 10 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE"),
)
def _(t):
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return _rate(R.drain(R.hit_rate(stream, "user_id", "ts"), R.scratch(t.spark, "rate")))


@query(
    "r03_split_keyed",
    f"""SELECT event_id, user_id, user_id IN (SELECT owner FROM {EXP_SQL} WHERE api_key LIKE 'live\\_%' ESCAPE '\\' AND expires_at >= TIMESTAMP '{NOW}') AS bypass FROM events""",
)
def _(t):
    return R.split_keyed(t.events.select("event_id", "user_id"), R.active_keys(_keys(t), _now()), "user_id").select("event_id", "user_id", "bypass")


@query(
    "r04_client_key",
    """SELECT client, count(*) AS hits FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'u' || user_id WHEN 3 THEN 'unknown' ELSE '10.0.0.' || (user_id % 7) END AS client FROM events) GROUP BY 1""",
)
def _(t):
    e, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    forwarded = F.when(e == 0, F.concat(F.lit(" u"), u, F.lit(" , 10.9.9.9"))).when(e == 1, F.lit(""))
    peer = F.when(e != 3, F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string")))
    return t.events.select(S.client_key(forwarded, peer).alias("client")).groupBy("client").agg(F.count("*").alias("hits"))


@query("r05_active_keys", f"""SELECT api_key, COALESCE(plan, 'monthly') AS plan FROM {EXP_SQL} WHERE starts_with(api_key, 'live_') AND expires_at >= TIMESTAMP '{NOW}'""")
def _(t):
    return R.active_keys(_keys(t), _now()).select("api_key", "plan")


_DUE = "1995-03-01"


@query(
    "r06_due_for_reminder",
    f"""SELECT api_key, email FROM {EXP_SQL} WHERE NOT reminder_sent AND email <> '' AND expires_at > TIMESTAMP '{_DUE}' AND expires_at <= TIMESTAMP '{_DUE}' + INTERVAL 3 DAY""",
)
def _(t):
    return R.due_for_reminder(_keys(t), F.lit(_DUE).cast("timestamp")).select("api_key", "email")


@query("r07_with_expiry", f"SELECT api_key, strftime(expires_at, '%Y-%m-%d') AS expires FROM {EXP_SQL}")
def _(t):
    return _keys(t).select("api_key", F.date_format("expires_at", "yyyy-MM-dd").alias("expires"))


_HIST = [s for s, _ in GOLDEN["L18"]]


@query(
    "r08_history",
    f"""SELECT query_id, author % 101 AS score, left(regexp_replace(sql, '\\s+', ' ', 'g'), 60) AS snippet FROM {log_sql(_HIST)}
 QUALIFY row_number() OVER (PARTITION BY sql ORDER BY ts DESC, query_id DESC) = 1 ORDER BY ts DESC, query_id DESC LIMIT 30""",
)
def _(t):
    checks = query_log(t.orders, _HIST).withColumn("score", F.col("author") % 101)
    return R.history(checks).select("query_id", "score", "snippet")


@query(
    "r09_age_label",
    """WITH e AS (SELECT event_id, ts, CAST(floor(epoch_us(TIMESTAMP '2024-01-31') / 1000000 - epoch_us(ts) / 1000000) AS BIGINT) s FROM events)
 SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' hr ago' ELSE strftime(ts, '%-d %b') END AS age FROM e""",
)
def _(t):
    return t.events.select("event_id", S.age_label(F.col("ts"), F.lit("2024-01-31").cast("timestamp")).alias("age"))


@query("r10_snippet", "SELECT doc_id, substr(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), 1, 60) AS snippet FROM documents")
def _(t):
    return t.documents.select("doc_id", S.snippet(F.col("text")).alias("snippet"))


_ARRIVING = GOLDEN["L05"] + GOLDEN["L13"]


@query("r11_lint_stream", expect_sql(_ARRIVING))
def _(t):
    folder = R.scratch(t.spark, "lint")
    query_log(t.orders, [s for s, _ in _ARRIVING]).write.parquet(folder + "/in")
    stream = t.spark.readStream.schema(query_log(t.orders, ["x"]).schema).parquet(folder + "/in")
    wanted = ["LIMIT without ORDER BY", "CASE without ELSE"]
    return R.lint_stream(stream, folder, lambda b: lint_findings(b, wanted)).select("query_id", "title")


@query(
    "r12_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) g FROM e)
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS hits FROM s GROUP BY user_id, g""",
)
def _(t):
    d = R.sessions(t.events, "user_id", "ts")
    return d.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("session_start", "session_end")], "hits")


# ---- streams with state, in three batches -----------------------------------------

#: batch of an event: its third of the month, one in ten of them a batch late
_THIRD = "least(2, (day(ts) - 1) {} 10 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END)"
_LATE = "CAST(date_trunc('millisecond', max(ts)) AS TIMESTAMP)"


def _in_batches(t, name: str, arrive, third: str = _THIRD.format("div")):
    """Let ``arrive`` take in three files of events, one after another; the stream and its state go on where they stood."""
    folder = R.scratch(t.spark, name)
    for k in range(3):
        t.events.where(F.expr(third) == k).coalesce(1).write.mode("append").parquet(folder + "/in")
        stream = t.spark.readStream.schema(t.events.schema).parquet(folder + "/in")
        out = arrive(stream, folder, k)
    return out


@query(
    "r01_throttle_live",
    _LIMITER.replace("SELECT event_id, user_id, accepted FROM w", "SELECT event_id, user_id, accepted FROM w JOIN events USING (event_id, user_id)")
    + f" WHERE (epoch_us(ts) // 3600000000 + 1) * 3600000 <= (SELECT epoch_us({_LATE}) // 1000 - 12 * 86400000 FROM events)",
)
def _(t):
    """Hits that arrive up to twelve days late are judged in their order; the last twelve days are not judged yet."""
    live = lambda s, folder, k: R.drain(V.throttle_live(s, "user_id", "ts", "event_id", 3, 86400, "12 days", 3600), folder)
    return _in_batches(t, "live", live).select("event_id", "user_id", "accepted")


@query(
    "r03_split_live",
    f"""SELECT event_id, user_id, coalesce(live.expires_at >= ts, false) AS bypass FROM (SELECT *, {_THIRD.format("//")} AS batch FROM events) e
 LEFT JOIN (SELECT c_custkey AS owner, TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 40 AS INTEGER)) AS expires_at FROM customer WHERE c_custkey % 7 <> 0) live
 ON owner = user_id AND (batch < 2 OR owner % 3 <> 0)""",
)
def _(t):
    """Keys expire day by day, and before the last batch a third of them is withdrawn."""
    keys = t.customer.where("c_custkey % 7 <> 0").select(
        F.col("c_custkey").alias("owner"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("c_custkey") % 40).cast("int"))).alias("expires_at")
    )

    def live(stream, folder, k):
        keys.where("owner % 3 <> 0" if k == 2 else "true").write.mode("overwrite").parquet(folder + "/keys")
        V.split_live(stream, lambda spark: spark.read.parquet(folder + "/keys"), "user_id", "ts", folder)
        return t.spark.read.parquet(folder + "/out")

    return _in_batches(t, "split", live).select("event_id", "user_id", "bypass")


@query(
    "r08_history_live",
    """SELECT event_id AS query_id, event_type AS sql, value AS score FROM events
 QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(t):
    """The latest event of each user and type, as files arrive in any order; each file brings a repeated delivery."""

    def live(stream, folder, k):
        checks = stream.select(F.col("event_id").alias("query_id"), F.col("event_type").alias("sql"), F.col("user_id").cast("string").alias("dialect"), "ts", F.col("value").alias("score"))
        V.history_live(checks.unionByName(checks.where("query_id % 5 = 0")), folder, late="40 days")
        table = t.spark.createDataFrame([], checks.schema)
        return V.history_table(t.spark, folder, table.schema)

    return _in_batches(t, "history", live).select("query_id", "sql", "score")


@query(
    "r12_sessions_stream",
    """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) g FROM e)
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, count(*) AS hits FROM s GROUP BY user_id, g
 HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 12 DAY""",
)
def _(t):
    """Sessions grow over batches in the state store and leave it once the watermark has passed their end."""
    live = lambda s, folder, k: R.drain(R.sessions(s, "user_id", "ts", late="12 days"), folder)
    d = _in_batches(t, "sessions", live)
    return d.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"), "hits")
