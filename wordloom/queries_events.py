"""Queries on events over time, replicas, logs, sources and sinks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import scalars as S
from wordloom.operators import bank, progress, state
from wordloom.registry import query
from wordloom.sources import files
from wordloom.sources.files import table

_E = "e AS (SELECT user_id, event_type, ts, event_id, event_id % 4 AS attempts, value >= 60 AS mastered, event_id % 4 = 1 AS first_try, event_id % 10 = 0 AS retry FROM events)"


def _rounds(s: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(s, d, "events").select("user_id", "event_type", "ts", "event_id", (i % 4).cast("int").alias("attempts"), (F.col("value") >= 60).alias("mastered"), (i % 4 == 1).alias("first_try"), (i % 10 == 0).alias("retry"))


@query(f"""WITH {_E}, o AS (SELECT *, row_number() OVER w AS n, mastered AND first_try AS good FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT user_id, event_type, count(*) AS seen, count(*) FILTER (attempts > 0 AND good) AS first, count(*) FILTER (attempts > 0 AND mastered) AS ever,
sum(CASE WHEN attempts > 0 AND NOT good THEN CASE WHEN mastered THEN greatest(attempts - 1, 0) ELSE 1 END ELSE 0 END)::BIGINT AS wrong,
list_reduce(list_prepend(0, list(CASE WHEN attempts = 0 OR (good AND retry) THEN 0 WHEN good AND n = 1 THEN 9 WHEN good THEN 1 ELSE -1 END::BIGINT ORDER BY ts, event_id)), lambda a, x: CASE WHEN x = 9 THEN 3 ELSE greatest(least(a + x, 3), 0) END) AS level,
max(ts) AS last, CASE WHEN NOT arg_min(good, n) FILTER (attempts > 0) THEN min(ts) FILTER (attempts > 0) END AS t0 FROM o GROUP BY 1, 2""")
def commit_rounds(s, d):
    return progress.committed(_rounds(s, d), ["user_id", "event_type"], "ts", "event_id")


_SIDE = """SELECT user_id, event_type, count(*) AS seen, count(*) FILTER (value > 60) AS first, count(*) FILTER (value > 40) AS ever, count(*) FILTER (value < 20) AS wrong, (max(event_id) % 4)::INT AS level, max(ts) + INTERVAL ({0} * 3) MINUTE AS last, min(ts) FILTER (value < 20) AS t0,
CASE WHEN max(event_id) % 7 = 0 THEN 'lv' END AS src, list_sort(list(DISTINCT (event_id % 8)::INT)) AS sens, max(event_id % 3)::INT AS k0 FROM events WHERE event_id % 2 = {0} GROUP BY 1, 2"""


@query(f"""WITH n AS (SELECT max(ts) - INTERVAL 6 MINUTE AS now FROM events), l AS ({_SIDE.format(0)}), r AS ({_SIDE.format(1)}), j AS (SELECT coalesce(l.user_id, r.user_id) AS user_id, coalesce(l.event_type, r.event_type) AS event_type, l, r, CASE WHEN l.last IS NOT NULL THEN least(l.last, now + INTERVAL 5 MINUTE) END AS la, CASE WHEN r.last IS NOT NULL THEN least(r.last, now + INTERVAL 5 MINUTE) END AS ra FROM n, l FULL JOIN r ON l.user_id = r.user_id AND l.event_type = r.event_type)
SELECT user_id, event_type, greatest(l.seen, r.seen) AS seen, greatest(l.first, r.first) AS first, greatest(l.ever, r.ever) AS ever, greatest(l.wrong, r.wrong) AS wrong, CASE WHEN la IS NULL OR ra > la THEN r.level ELSE l.level END AS level, greatest(la, ra) AS last, least(l.t0, r.t0) AS t0,
CASE WHEN la IS NULL OR ra > la THEN r.src ELSE l.src END AS src, array_to_string(list_sort(list_distinct(coalesce(l.sens, []) || coalesce(r.sens, []))), ',') AS sens, greatest(l.k0, r.k0) AS k0 FROM j""".replace("FROM n, l FULL JOIN r ON l.user_id = r.user_id AND l.event_type = r.event_type)", "FROM l FULL JOIN r ON l.user_id = r.user_id AND l.event_type = r.event_type, n)"))
def merge_progress(s, d):
    e = table(s, d, "events")

    def side(rest: int) -> DataFrame:
        g = e.filter(F.col("event_id") % 2 == rest).groupBy("user_id", "event_type")
        n = lambda c: F.count_if(c)
        return g.agg(F.count("*").alias("seen"), n(F.col("value") > 60).alias("first"), n(F.col("value") > 40).alias("ever"), n(F.col("value") < 20).alias("wrong"), (F.max("event_id") % 4).cast("int").alias("level"), (F.max("ts") + F.expr(f"INTERVAL {rest * 3} MINUTES")).alias("last"), F.min(F.when(F.col("value") < 20, F.col("ts"))).alias("t0"), F.when(F.max("event_id") % 7 == 0, "lv").alias("src"), F.array_sort(F.collect_set((F.col("event_id") % 8).cast("int"))).alias("sens"), F.max((F.col("event_id") % 3).cast("int")).alias("k0"))

    now = e.agg((F.max("ts") - F.expr("INTERVAL 6 MINUTES")).alias("now"))
    local = side(0).join(F.broadcast(now)).withColumn("_now", F.col("now")).drop("now")
    out = progress.merged(local.drop("_now"), side(1), ["user_id", "event_type"], F.lit(now.first()[0]).cast("timestamp_ntz"))
    return out.withColumn("sens", F.array_join("sens", ","))


_SESS = """SELECT o_custkey AS user, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey // 3)::VARCHAR END AS rid, o_orderdate AS t, o_orderstatus AS scope, (o_custkey % 7)::INT AS total, (o_orderkey % 4)::INT AS correct FROM orders WHERE o_orderkey % 3 <> {0}"""


@query(f"""WITH b AS (SELECT *, 1 AS side FROM ({_SESS.format(0)}) UNION ALL SELECT *, 0 FROM ({_SESS.format(1)})), k AS (SELECT *, CASE WHEN rid IS NOT NULL THEN 'r:' || rid ELSE concat_ws('|', 'legacy', strftime(t, '%Y-%m-%d %H:%M:%S'), scope, total, correct) END AS key FROM b),
o AS (SELECT "user", key, arg_max({{'rid': rid, 't': t, 'scope': scope, 'total': total, 'correct': correct}}, (total, t, side)) AS x FROM k GROUP BY 1, 2)
SELECT "user", x.rid AS rid, x.t AS t, x.scope AS scope, x.total AS total, x.correct AS correct FROM o QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY x.t DESC, key DESC) <= 5""")
def merge_sessions(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey")

    def side(rest: int) -> DataFrame:
        return o.filter(k % 3 != rest).select(F.col("o_custkey").alias("user"), F.when(k % 5 != 0, F.floor(k / 3).cast("string")).alias("rid"), F.col("o_orderdate").alias("t"), F.col("o_orderstatus").alias("scope"), (F.col("o_custkey") % 7).cast("int").alias("total"), (k % 4).cast("int").alias("correct"))

    return progress.merged_sessions(side(0), side(1), "user", 5)


@query("""WITH x AS (SELECT user_id, event_type AS rid, ts::DATE AS d, count(*) AS n FROM events GROUP BY 1, 2, 3) SELECT user_id, rid, max(d)::VARCHAR AS t, sum(n)::BIGINT AS total, count(*) AS commits FROM x GROUP BY 1, 2""")
def session_rows(s, d):
    x = table(s, d, "events").groupBy("user_id", F.col("event_type").alias("rid"), F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return x.groupBy("user_id", "rid").agg(F.max("d").cast("string").alias("t"), F.sum("n").alias("total"), F.count("*").alias("commits"))


@query("SELECT event_id, CASE WHEN value > 50 THEN event_type END AS status, value > 50 AS confirmed FROM events")
def unconfirmed_downgrade(s, d):
    ok = F.col("value") > 50
    return table(s, d, "events").select("event_id", F.when(ok, F.col("event_type")).alias("status"), ok.alias("confirmed"))


@query("SELECT user_id, ts::DATE::VARCHAR AS day, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def daily_notification(s, d):
    return table(s, d, "events").filter("event_type = 'purchase'").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.min("event_id").alias("event_id"))


@query("""WITH u AS (SELECT user_id, max(ts::DATE) AS last, count(DISTINCT ts::DATE) AS days FROM events WHERE value > 90 GROUP BY 1), t AS (SELECT max(ts::DATE) AS today FROM events)
SELECT user_id, CASE WHEN date_diff('day', last, today) >= 14 THEN 'long away' WHEN date_diff('day', last, today) >= 2 THEN 'away' WHEN days >= 3 THEN 'streak' ELSE 'hello' END AS message FROM u, t""")
def daily_messages(s, d):
    e = table(s, d, "events")
    u = e.filter("value > 90").groupBy("user_id").agg(F.max(F.to_date("ts")).alias("last"), F.count_distinct(F.to_date("ts")).alias("days"))
    away = F.datediff("today", "last")
    return u.join(F.broadcast(e.agg(F.max(F.to_date("ts")).alias("today")))).select("user_id", F.when(away >= 14, "long away").when(away >= 2, "away").when(F.col("days") >= 3, "streak").otherwise("hello").alias("message"))


@query("""WITH log AS (SELECT event_id, ts, 0 AS ovr FROM events ORDER BY ts DESC, event_id DESC LIMIT 500), m AS (SELECT event_id FROM events WHERE event_type = 'error') SELECT log.event_id, CASE WHEN m.event_id IS NOT NULL THEN 1 ELSE ovr END AS ovr FROM log LEFT JOIN m USING (event_id)""")
def ring_log_marks(s, d):
    e = table(s, d, "events")
    log = progress.ring(e.select("event_id", "ts", F.lit(0).alias("ovr")), ["ts", "event_id"], 500)
    return progress.flagged(log, e.filter("event_type = 'error'").select("event_id", F.lit(1).alias("ovr")), "event_id", "ovr").select("event_id", "ovr")


@query("""WITH m AS (SELECT user_id, event_type, count(*) AS seen, count(*) FILTER (value < 20) AS wrong, max(ts) FILTER (value > 100) AS last FROM events GROUP BY 1, 2), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, event_type, CASE WHEN seen > 0 AND wrong > 0 AND event_type <> 'signup' THEN coalesce(last, now) END AS t0 FROM m, n""")
def t0_backfill(s, d):
    e = table(s, d, "events")
    m = e.groupBy("user_id", "event_type").agg(F.count("*").alias("seen"), F.count_if(F.col("value") < 20).alias("wrong"), F.max(F.when(F.col("value") > 100, F.col("ts"))).alias("last"))
    return m.join(F.broadcast(e.agg(F.max("ts").alias("now")))).select("user_id", "event_type", F.when((F.col("seen") > 0) & (F.col("wrong") > 0) & (F.col("event_type") != "signup"), F.coalesce("last", "now")).alias("t0"))


@query("SELECT event_type AS src, count(*) AS n, count(*) FILTER (value >= 20) AS ok, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1")
def sentence_events(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("src")).agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 20).alias("ok"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), u AS (SELECT user_id, max(ts) AS seen FROM events WHERE event_type = 'click' AND value > 100 GROUP BY 1), c AS (SELECT user_id, max(ts) AS last, count(*) AS n FROM events WHERE event_type = 'signup' AND value > 150 GROUP BY 1)
SELECT user_id FROM u LEFT JOIN c USING (user_id), n WHERE floor((epoch_us(now) - epoch_us(seen)) / 86400000000) >= 1 AND (last IS NULL OR floor((epoch_us(now) - epoch_us(last)) / 86400000000) >= 2) AND coalesce(c.n, 0) < 40""")
def campaign_due(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("ts")).first()[0]
    users = e.filter("event_type = 'click' AND value > 100").groupBy("user_id").agg(F.max("ts").alias("seen"))
    sent = e.filter("event_type = 'signup' AND value > 150").select("user_id", F.col("ts").alias("sent_at"))
    return progress.due(users, sent, "user_id", "seen", F.lit(now), 1, 2, 40).select("user_id")


@query("""SELECT user_id, list_reduce(list_prepend(3, list(CASE WHEN value >= 60 THEN 1 ELSE -1 END ORDER BY ts, event_id)), lambda a, x: greatest(least(a + x, 6), 1)) AS band FROM events GROUP BY 1""")
def adaptive_ladder(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_id", (F.col("value") >= 60).alias("right"))
    return progress.ladder(e, "user_id", "right", "ts", "event_id")


@query("""WITH l AS (SELECT user_id, ts, value < 10 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, CASE WHEN now - max(ts) > INTERVAL 12 HOUR THEN 'stale' WHEN count(*) = 3 AND bool_and(bad) THEN 'down' WHEN count(*) < 3 THEN 'young' ELSE 'up' END AS verdict FROM l, n WHERE rn <= 3 GROUP BY user_id, now""")
def uptime_verdict(s, d):
    e = table(s, d, "events")
    last = state.failing(e, "user_id", F.col("value") < 10, 3, "ts", "event_id").join(e.groupBy("user_id").agg(F.max("ts").alias("last")), "user_id")
    stale = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp")) > 12 * 3600 * 1_000_000
    return last.join(F.broadcast(e.agg(F.max("ts").alias("now")))).select("user_id", F.when(stale, "stale").when(F.col("failing"), "down").when(F.col("checked") < 3, "young").otherwise("up").alias("verdict"))


@query("""WITH l AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*) FILTER (before IS NULL OR ts - before > INTERVAL 12 SECOND) AS pushes, count(*) AS saves FROM l GROUP BY 1""")
def push_debounce(s, d):
    rows = state.sessions(table(s, d, "events"), "user_id", "ts", "event_id", 12)
    return rows.groupBy("user_id").agg(F.max("session").alias("pushes"), F.count("*").alias("saves"))


@query("""SELECT event_id, abs(epoch(ts) - epoch(lead_ts)) <= 300 AS accepted FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lead_ts FROM events) WHERE lead_ts IS NOT NULL""".replace("abs(epoch(ts) - epoch(lead_ts)) <= 300", "abs(epoch_us(ts) - epoch_us(lead_ts)) <= 300000000"))
def replay_window(s, d):
    n = state.next_mark(table(s, d, "events"), "user_id", "ts", "event_id").filter("next IS NOT NULL")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return n.select("event_id", (F.abs(us("ts") - us("next")) <= 300_000_000).alias("accepted"))


@query("""SELECT event_id, event_type FROM events WHERE event_type = 'purchase' AND value > 100 AND (props->>'$.k')::INT < 50""")
def pushed_select(s, d):
    e = table(s, d, "events").filter("event_type = 'purchase' AND value > 100")
    return e.filter(F.get_json_object("props", "$.k").cast("int") < 50).select("event_id", "event_type")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F'")
def exact_count(s, d):
    return table(s, d, "orders").filter("o_orderstatus <> 'F'").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS o_custkey, coalesce(bool_or(o_totalprice > 250000), false) AS entitled FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 GROUP BY 1""")
def entitlement_lookup(s, d):
    """The customers of a nation ask whether they are entitled; one without an order isn't."""
    asked = table(s, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return bank.entitled(asked, table(s, d, "orders"), "o_custkey", F.col("o_totalprice") > 250000)


@query("""WITH a AS (SELECT o_orderkey, '1: ' || substr('ABCD', (o_orderkey % 4)::INT + 1, 1) || ' 2. ' || substr('ABCD', (o_custkey % 4)::INT + 1, 1) || ' 1:D' AS t FROM orders)
SELECT o_orderkey, 1 AS q, 'D' AS choice FROM a UNION ALL SELECT o_orderkey, 2, substr('ABCD', (o_custkey % 4)::INT + 1, 1) FROM orders""")
def free_text_answers(s, d):
    letter = lambda c: F.substring(F.lit("ABCD"), (F.col(c) % 4).cast("int") + 1, F.lit(1))
    text = F.concat(F.lit("1: "), letter("o_orderkey"), F.lit(" 2. "), letter("o_custkey"), F.lit(" 1:D"))
    p = F.lit(r"(\d+)[:.] ?([A-D])")
    found = table(s, d, "orders").select("o_orderkey", F.posexplode(F.arrays_zip(F.regexp_extract_all(text, p, F.lit(1)).alias("q"), F.regexp_extract_all(text, p, F.lit(2)).alias("c"))).alias("i", "x"))
    return found.groupBy("o_orderkey", F.col("x.q").cast("int").alias("q")).agg(F.max_by("x.c", "i").alias("choice"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 END AS rating, o_orderstatus || '|' || o_orderpriority AS candidates FROM orders""")
def ranked_answers(s, d):
    text = F.concat(F.lit("q: "), F.when(F.col("o_orderkey") % 2 == 0, F.concat((F.col("o_orderkey") % 5).cast("string"), F.lit("/ "))).otherwise(""), "o_orderstatus", F.lit(" ,  "), "o_orderpriority")
    rating = F.nullif(F.regexp_extract(text, r"^q: (\d+)/", 1), F.lit(""))
    names = F.transform(F.split(F.regexp_replace(text, r"^q: (\d+/)?", ""), ","), lambda x: F.trim(x))
    return table(s, d, "orders").select("o_orderkey", rating.cast("long").alias("rating"), F.array_join(names, "|").alias("candidates"))


@query("SELECT page_id, length(html) AS n, md5(html) AS h FROM pages WHERE page_id % 3 = 0 OR page_id % 2 = 1")
def changed_since(s, d):
    p = table(s, d, "pages").select("page_id", "html")
    new = p.select("page_id", F.md5("html").alias("h"), F.length("html").cast("long").alias("n"))
    old = p.select("page_id", F.md5(F.when((F.col("page_id") % 3 == 0) | (F.col("page_id") % 2 == 1), F.concat("html", F.lit("x"))).otherwise(F.col("html"))).alias("h"))
    return new.join(old, ["page_id", "h"], "left_anti").select("page_id", "n", "h")


@query("""SELECT count(*) AS n, sum(('0x' || left(sha256(l_orderkey || ':' || l_linenumber || ':' || l_comment), 15))::BIGINT)::VARCHAR AS digest FROM (SELECT l_orderkey, l_linenumber, l_shipdate::VARCHAR || l_partkey AS l_comment FROM lineitem)""")
def content_fingerprint(s, d):
    """A digest of all lines that their order doesn't change, added up by part."""
    lines = table(s, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber", F.concat(F.col("l_shipdate").cast("string"), "l_partkey")).alias("value"))
    return files.fingerprint(lines).select("n", F.col("digest").cast("string").alias("digest"))


@query("""SELECT 'orders' AS name, count(*) AS left_ FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)""")
def delete_cascade(s, d):
    o = table(s, d, "orders")
    gone = o.filter("o_custkey % 10 = 0").select("o_orderkey")
    left = o.join(gone, "o_orderkey", "left_anti").agg(F.lit("orders").alias("name"), F.count("*").alias("left_"))
    lines = table(s, d, "lineitem").join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.lit("lineitem").alias("name"), F.count("*").alias("left_"))
    return left.unionByName(lines)


@query("""WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, sum(length(props)) OVER () AS bytes FROM events WHERE event_type <> 'error')
SELECT user_id, event_id FROM s WHERE rn <= CASE WHEN bytes > 5000 THEN 4 ELSE 20 END""")
def quota_shed(s, d):
    from wordloom.operators.dedup import last_n

    kept = table(s, d, "events").filter("event_type <> 'error'")
    few = last_n(kept.select("user_id", "event_id", "ts"), ["user_id"], 20, F.desc("ts"), F.desc("event_id"))
    size = kept.agg(F.coalesce(F.sum(F.length("props")), F.lit(0)).alias("bytes"))
    return few.join(F.broadcast(size)).filter(F.col("rn") <= F.when(F.col("bytes") > 5000, 4).otherwise(20)).select("user_id", "event_id")


@query("SELECT p_brand AS uid, p_partkey, p_name AS term, p_type AS gloss, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part")
def bank_flatten(s, d):
    """A bank nested by unit, as its file has it, flattened to rows with their place in the unit."""
    unit = table(s, d, "part").groupBy(F.col("p_brand").alias("uid"), F.lit(0).alias("_")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.col("p_name").alias("term"), F.col("p_type").alias("gloss")))).alias("pairs"))
    return unit.select("uid", F.posexplode("pairs").alias("i", "x")).select("uid", "x.*", F.col("i").cast("long").alias("i"))


@query("SELECT event_id, (props->>'$.k')::INT AS k, false AS bad FROM events WHERE event_id % 50 <> 0 UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 50 = 0")
def fault_counting_scan(s, d):
    from wordloom.sources.files import parsed_lines

    lines = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, F.substring("props", 1, 3)).otherwise(F.col("props")).alias("value"))
    return parsed_lines(lines, "k INT").select("event_id", F.col("row.k").alias("k"), "bad")
