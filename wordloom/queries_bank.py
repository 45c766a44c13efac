"""Queries on the bank of items (parts), its learners (users, customers) and their answers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import scalars as S
from wordloom.functions import text as T
from wordloom.operators import bank, dedup, fuzzy, sampling
from wordloom.plans.ordinals import with_ordinal
from wordloom.registry import query
from wordloom.sources.files import table

# A learner's record of an item: customers' orders by part.
_REC = """SELECT o_custkey, l_partkey, count(*) AS seen, count(*) FILTER (l_returnflag = 'R') AS wrong, least(count(*) FILTER (l_returnflag <> 'R'), 3) AS level, max(o_orderdate) AS last, min(o_orderdate) FILTER (l_returnflag = 'R') AS t0,
CASE WHEN min(l_linestatus) = 'F' THEN 'lv' END AS src FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2"""


def records(s: SparkSession, d: str) -> DataFrame:
    bad = F.col("l_returnflag") == "R"
    rows = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("seen"), F.count_if(bad).alias("wrong"), F.least(F.count_if(~bad), F.lit(3)).alias("level"), F.max("o_orderdate").alias("last"), F.min(F.when(bad, F.col("o_orderdate"))).alias("t0"), F.when(F.min("l_linestatus") == "F", "lv").alias("src"))


# ---- selections


@query("SELECT p_size AS unit, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS i FROM part WHERE p_size BETWEEN 5 AND 15")
def scope_units(s, d):
    rows = with_ordinal(table(s, d, "part").filter(F.col("p_size").between(5, 15)).select(F.col("p_size").alias("unit"), "p_partkey"), F.col("unit"), F.col("p_partkey"), name="i")
    first = rows.groupBy("unit").agg(F.min("i").alias("f"))
    return rows.join(F.broadcast(first), "unit").select("unit", "p_partkey", (F.col("i") - F.col("f")).alias("i"))


@query(f"SELECT p_partkey FROM part LEFT JOIN (SELECT l_partkey, sum(seen) AS seen FROM ({_REC}) WHERE wrong > 1 GROUP BY 1) ON l_partkey = p_partkey WHERE coalesce(seen, 0) = 0")
def new_items(s, d):
    seen = records(s, d).filter("wrong > 1").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(s, d, "part").select("p_partkey").join(seen, "p_partkey", "left_anti")


@query(f"SELECT o_custkey, l_partkey, row_number() OVER (PARTITION BY o_custkey ORDER BY last, l_partkey) AS turn FROM ({_REC}) WHERE seen > 0 AND level < 3 QUALIFY turn <= 10")
def weak_items(s, d):
    return dedup.last_n(records(s, d).filter("seen > 0 AND level < 3"), ["o_custkey"], 10, F.col("last"), F.col("l_partkey")).select("o_custkey", "l_partkey", F.col("rn").alias("turn"))


@query(f"SELECT o_custkey, l_partkey, t0 FROM ({_REC}) WHERE t0 IS NOT NULL AND src IS DISTINCT FROM 'lv'")
def acquired_items(s, d):
    return records(s, d).filter(F.col("t0").isNotNull() & ~F.col("src").eqNullSafe("lv")).select("o_custkey", "l_partkey", "t0")


@query(f"""SELECT o_custkey, count(*) AS total, count(*) FILTER (src = 'lv') AS skipped, count(*) FILTER (src IS DISTINCT FROM 'lv' AND level >= 3) AS strong, count(*) FILTER (src IS DISTINCT FROM 'lv' AND level BETWEEN 1 AND 2) AS weak,
count(*) FILTER (src IS DISTINCT FROM 'lv' AND level = 0) AS fresh, greatest(0, count(*) - count(*) FILTER (seen > 1) - count(*) FILTER (src = 'lv')) AS unpractised, floor(100 * count(*) FILTER (level >= 3) / count(*) + 0.5)::BIGINT AS pct FROM ({_REC}) GROUP BY 1""")
def language_summary(s, d):
    skip = F.coalesce(F.col("src") == "lv", F.lit(False))
    out = records(s, d).groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(skip).alias("skipped"), F.count_if(~skip & (F.col("level") >= 3)).alias("strong"), F.count_if(~skip & F.col("level").between(1, 2)).alias("weak"), F.count_if(~skip & (F.col("level") == 0)).alias("fresh"), F.count_if(F.col("seen") > 1).alias("practised"), F.count_if(F.col("level") >= 3).alias("learned"))
    return out.select("o_custkey", "total", "skipped", "strong", "weak", "fresh", F.greatest(F.lit(0), F.col("total") - F.col("practised") - F.col("skipped")).alias("unpractised"), S.percent(F.col("learned"), F.col("total")).alias("pct"))


@query(f"""WITH r AS ({_REC}) SELECT c_custkey, c_mktsegment, coalesce(count(l_partkey) FILTER (level >= 3), 0) AS learned, max(last) AS last_round, min(last) AS first_round, coalesce(sum(wrong), 0)::BIGINT AS wrong
FROM customer LEFT JOIN r ON o_custkey = c_custkey GROUP BY 1, 2""")
def user_cohort(s, d):
    g = records(s, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("level") >= 3).alias("learned"), F.max("last").alias("last_round"), F.min("last").alias("first_round"), F.sum("wrong").alias("wrong"))
    return table(s, d, "customer").select("c_custkey", "c_mktsegment").join(g, "c_custkey", "left").fillna(0, ["learned", "wrong"])


@query(f"SELECT o_custkey, sum(CASE WHEN level < 3 THEN 1 ELSE 0 END)::BIGINT AS weak, sum(try_cast(coalesce(src, wrong::VARCHAR) AS INT))::BIGINT AS numbers FROM ({_REC}) GROUP BY 1")
def retention_weak(s, d):
    return records(s, d).groupBy("o_custkey").agg(F.sum((F.col("level") < 3).cast("int")).alias("weak"), F.sum(F.coalesce("src", F.col("wrong").cast("string")).try_cast("int")).alias("numbers"))


@query(f"SELECT l_partkey, level, wrong, last FROM (SELECT l_partkey, o_custkey, level, wrong, last FROM ({_REC}) ORDER BY level, wrong DESC, last DESC, l_partkey, o_custkey LIMIT 200)")
def manage_list(s, d):
    return records(s, d).orderBy("level", F.desc("wrong"), F.desc("last"), "l_partkey", "o_custkey").limit(200).select("l_partkey", "level", "wrong", "last")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def newest_feedback(s, d):
    return table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "ts")


@query(f"""SELECT l_partkey, o_custkey, CASE WHEN level = 0 THEN 0 WHEN wrong > 1 THEN 1 WHEN wrong = 1 THEN 2 ELSE 3 END AS tier FROM (SELECT *, l_partkey * 100000 + o_custkey AS k FROM ({_REC})) ORDER BY tier, k LIMIT 100""")
def priority_fill(s, d):
    tier = F.when(F.col("level") == 0, 0).when(F.col("wrong") > 1, 1).when(F.col("wrong") == 1, 2).otherwise(3)
    return bank.filled_up(records(s, d).withColumn("k", F.col("l_partkey") * 100000 + F.col("o_custkey")), tier, "k", 100).select("l_partkey", "o_custkey", "tier")


@query("""WITH t AS (SELECT doc_id, CASE WHEN n_chars < 400 THEN 'a' WHEN n_chars < 1200 THEN 'b' ELSE 'c' END AS tier FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY doc_id) - 1 AS i FROM t),
c AS (SELECT *, i // CASE tier WHEN 'a' THEN 5 WHEN 'b' THEN 2 ELSE 3 END AS cycle FROM r) SELECT doc_id, tier, row_number() OVER (ORDER BY cycle, tier, i) AS turn FROM c""")
def quota_mix(s, d):
    tier = F.when(F.col("n_chars") < 400, "a").when(F.col("n_chars") < 1200, "b").otherwise("c")
    return bank.mixed(table(s, d, "documents").select("doc_id", tier.alias("tier")), "tier", "doc_id", {"a": 5, "b": 2, "c": 3})


@query("""WITH r AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 10 AS i FROM documents) SELECT doc_id, CASE WHEN i < 4 THEN 'recognise' WHEN i < 7 THEN 'recall' ELSE 'context' END AS part FROM r""")
def allocation_mix(s, d):
    i = (F.col("o") - 1) % 10
    return with_ordinal(table(s, d, "documents").select("doc_id"), F.col("doc_id"), name="o").select("doc_id", F.when(i < 4, "recognise").when(i < 7, "recall").otherwise("context").alias("part"))


@query("""WITH x AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) SELECT o_custkey, o_orderpriority FROM x QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY k) <= 3""")
def top_distinct(s, d):
    once = table(s, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("k"))
    return dedup.last_n(once, ["o_custkey"], 3, F.col("k")).select("o_custkey", "o_orderpriority")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('seed7' || doc_id), doc_id) AS place FROM documents")
def seeded_shuffle(s, d):
    rows = table(s, d, "documents").select("doc_id", F.md5(F.concat(F.lit("seed7"), F.col("doc_id").cast("string"))).alias("h"))
    return with_ordinal(rows, F.col("h"), F.col("doc_id"), name="place").drop("h")


@query("""SELECT a.p_partkey AS item, array_to_string(list_transform(list_sort(list(DISTINCT {'d': levenshtein(a.w, b.w), 'n': length(b.w), 'w': b.w}))[1:8], lambda x: x.w), '|') AS nearest
FROM (SELECT DISTINCT p_partkey, split_part(p_name, ' ', 1) AS w FROM part) a JOIN (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) b ON levenshtein(a.w, b.w) <= 2 GROUP BY 1""")
def nearest_candidates(s, d):
    words = table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    a = table(s, d, "part").select(F.col("p_partkey").alias("item"), F.substring_index("p_name", " ", 1).alias("a"))
    return fuzzy.nearest_words(a, "a", words, "w").select("item", F.array_join("nearest", "|").alias("nearest"))


# ---- joins


@query(f"""WITH known AS (SELECT DISTINCT l_partkey FROM ({_REC}) WHERE level >= 3), gone AS (SELECT DISTINCT l_partkey FROM ({_REC}) WHERE wrong > 2), r AS (SELECT p_partkey, p_size AS rank FROM part WHERE p_size > 3)
SELECT p.p_partkey, coalesce(rank, 99) AS rank FROM part p LEFT JOIN r USING (p_partkey) WHERE coalesce(rank, 99) <= 30 AND p.p_partkey NOT IN (SELECT * FROM known) AND p.p_partkey NOT IN (SELECT * FROM gone)""")
def ranked_unknown(s, d):
    r, p = records(s, d), table(s, d, "part")
    ranks = p.filter("p_size > 3").select("p_partkey", F.col("p_size").alias("rank"))
    key = F.col("l_partkey").alias("p_partkey")
    left = p.select("p_partkey").join(ranks, "p_partkey", "left").withColumn("rank", F.coalesce("rank", F.lit(99))).filter("rank <= 30")
    return bank.without(left, r.filter("level >= 3").select(key), r.filter("wrong > 2").select(key), on=["p_partkey"])


@query("""WITH n AS (SELECT c_custkey, c_name, count(o_orderkey) AS rounds, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) SELECT c_custkey, c_name, rounds, total FROM n""")
def users_progress(s, d):
    g = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("rounds"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return table(s, d, "customer").select("c_custkey", "c_name").join(g, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("rounds", F.lit(0)).alias("rounds"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS place, n_name FROM nation), b AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS place, s_name FROM supplier)
SELECT place, n_name, s_name, coalesce(n_name = s_name, false) AS same FROM a FULL JOIN b USING (place)""")
def positional_pairs(s, d):
    z = bank.positional_zip(table(s, d, "nation").select("n_nationkey", "n_name"), table(s, d, "supplier").select("s_suppkey", "s_name"), "n_nationkey", "s_suppkey")
    return z.select("place", "a.n_name", "b.s_name", F.coalesce(F.col("a.n_name") == F.col("b.s_name"), F.lit(False)).alias("same"))


@query("SELECT o_orderkey, sum(l_quantity) = n AS matches FROM lineitem JOIN (SELECT o_orderkey, round(o_totalprice) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) ON o_orderkey = l_orderkey GROUP BY o_orderkey, n")
def answer_key(s, d):
    answers = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("given"))
    key = table(s, d, "orders").select("o_orderkey", F.round("o_totalprice").alias("n")).join(answers.select("o_orderkey"), "o_orderkey", "left_semi")
    return bank.complete_join(answers, key, "o_orderkey").select("o_orderkey", (F.col("given") == F.col("n")).alias("matches"))


@query("""WITH k AS (SELECT p_partkey, p_name, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS at, count(*) OVER (PARTITION BY p_brand) AS n FROM part), g AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS at, count(*) OVER () AS n FROM part), st AS (SELECT unnest(range(1, 13)) AS step),
x AS (SELECT a.p_partkey AS id, b.p_partkey AS other, b.p_name AS f, 0 AS tier, step FROM k a CROSS JOIN st JOIN k b ON b.p_brand = a.p_brand AND b.at = (a.at + step) % a.n WHERE b.p_partkey <> a.p_partkey AND b.p_name <> a.p_name
UNION ALL SELECT a.p_partkey, b.p_partkey, b.p_name, 1, step FROM g a CROSS JOIN st JOIN g b ON b.at = (a.at + step) % a.n WHERE b.p_partkey <> a.p_partkey AND b.p_name <> a.p_name),
o AS (SELECT id, f, min({'tier': tier, 'step': step, 'other': other}) AS m FROM x GROUP BY 1, 2) SELECT id AS p_partkey, row_number() OVER (PARTITION BY id ORDER BY m) AS place, m.other AS other, m.tier AS tier FROM o QUALIFY place <= 3""")
def distractor_pick(s, d):
    return bank.distractors(table(s, d, "part"), "p_partkey", "p_name", "p_brand")


@query("SELECT DISTINCT p_name, p_brand FROM part a WHERE p_size <= 25 AND NOT EXISTS (SELECT 1 FROM part b WHERE b.p_name = a.p_name AND b.p_brand = a.p_brand AND b.p_size > 30)")
def table_diff(s, d):
    p = table(s, d, "part")
    return bank.without(p.filter("p_size <= 25").select("p_name", "p_brand").distinct(), p.filter("p_size > 30"), on=["p_name", "p_brand"])


@query("""WITH n AS (SELECT p_name, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, first AS representative, n - 1 AS alternatives FROM part JOIN n USING (p_name)""")
def accept_alternatives(s, d):
    p = table(s, d, "part").select("p_partkey", "p_name")
    g = p.groupBy("p_name").agg(F.min("p_partkey").alias("representative"), (F.count("*") - 1).alias("alternatives"))
    return p.join(g, "p_name").select("p_partkey", "representative", "alternatives")


@query("SELECT DISTINCT p_type FROM part WHERE lower(p_type) IN (SELECT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) FROM part)")
def gloss_is_a_word(s, d):
    words = table(s, d, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("w")).distinct()
    return table(s, d, "part").select("p_type", F.lower("p_type").alias("w")).distinct().join(words, "w", "left_semi").select("p_type")


@query("""WITH v AS (SELECT l_orderkey, l_suppkey, count(*) AS n, bool_and(l_returnflag <> 'R') AS yes FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_suppkey FROM v WHERE n = 2 AND yes AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = v.l_orderkey AND x.l_suppkey = v.l_suppkey AND x.l_linestatus = 'F')""")
def two_judge_endorsement(s, d):
    li = table(s, d, "lineitem")
    keys = ["l_orderkey", "l_suppkey"]
    return bank.endorsed(li.select(*keys, (F.col("l_returnflag") != "R").alias("yes")), li.filter("l_linestatus = 'F'").select(*keys), keys)


@query("""WITH RECURSIVE lex AS (SELECT DISTINCT p_name AS phrase FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part UNION SELECT 'the' UNION SELECT 'of the'),
t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
h AS (SELECT doc_id, i, n, phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t), (SELECT unnest([1, 2, 3]) AS n), lex WHERE i + n - 1 <= len(w) AND array_to_string(w[i:i + n - 1], ' ') = phrase),
b AS (SELECT doc_id, i, max(n) AS n FROM h GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b),
r AS (SELECT doc_id, i, n, k, true AS taken, i + n AS nxt FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.i, o.n, o.k, o.i >= r.nxt, CASE WHEN o.i >= r.nxt THEN o.i + o.n ELSE r.nxt END FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1)
SELECT doc_id, count(*) AS hits, sum(n)::BIGINT AS words, sum(i)::BIGINT AS places FROM r WHERE taken GROUP BY 1""")
def longest_phrase_scan(s, d):
    p = table(s, d, "part")
    lexicon = p.select(F.col("p_name").alias("phrase")).unionByName(p.select(F.element_at(F.split("p_name", " "), 2).alias("phrase"))).unionByName(s.createDataFrame([("the",), ("of the",)], "phrase string"))
    texts = table(s, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return bank.phrases(texts, "doc_id", "w", lexicon).groupBy("doc_id").agg(F.count("*").alias("hits"), F.sum("n").alias("words"), F.sum("at").alias("places"))


# ---- aggregations


@query("SELECT c_nationkey % 5 AS key, sum(n)::BIGINT AS n, max(m) AS m FROM (SELECT c_nationkey, count(*) AS n, max(c_acctbal) AS m FROM customer GROUP BY 1) GROUP BY 1")
def migrate_merge(s, d):
    old = table(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("m"))
    return old.groupBy((F.col("c_nationkey") % 5).alias("key")).agg(F.sum("n").alias("n"), F.max("m").alias("m"))


@query("""WITH r AS (SELECT l_partkey, l_suppkey, CASE WHEN min(l_linenumber) <= 3 THEN min(l_linenumber) ELSE 0 END AS rank FROM lineitem GROUP BY 1, 2), g AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (rank = 1) AS t, count(*) FILTER (rank > 0) AS h FROM r GROUP BY 1)
SELECT l_partkey, CASE WHEN 2 * t > n THEN 'TOP1' WHEN h > 0 THEN 'TOP3' ELSE 'MISS' END AS grade FROM g""")
def solver_grades(s, d):
    r = table(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("m")).withColumn("rank", F.when(F.col("m") <= 3, F.col("m")).otherwise(0))
    return bank.grades(r, "l_partkey", "rank")


@query("""WITH b AS (SELECT p_size // 10 AS band, count(*) FILTER (p_retailprice > 1000) / count(*) AS share FROM part GROUP BY 1), l AS (SELECT *, lag(share) OVER (ORDER BY band) AS last FROM b)
SELECT round(max(share) - min(share), 6) AS span, bool_and(share >= 0.95) AS saturated, bool_and(last IS NULL OR share < last) AS falling FROM l""")
def monotone_bands(s, d):
    b = table(s, d, "part").groupBy(F.floor(F.col("p_size") / 10).alias("band")).agg((F.count_if(F.col("p_retailprice") > 1000) / F.count("*")).alias("share"))
    return bank.monotone_verdict(b, "band", "share")


@query("""WITH k AS (SELECT o_custkey, o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS ok FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_orderstatus AS kind, n, ok, floor(100 * ok / n + 0.5)::BIGINT AS pct FROM k UNION ALL SELECT o_custkey, NULL, sum(n)::BIGINT, sum(ok)::BIGINT, floor(100 * sum(ok) / sum(n) + 0.5)::BIGINT FROM k GROUP BY 1""")
def exam_scores(s, d):
    rows = table(s, d, "orders").groupingSets([["o_custkey", "o_orderstatus"], ["o_custkey"]], "o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("ok"))
    return rows.select("o_custkey", F.col("o_orderstatus").alias("kind"), "n", "ok", S.percent(F.col("ok"), F.col("n")).alias("pct"))


@query("""WITH b AS (SELECT user_id, floor(value / 20)::BIGINT AS band, count(*) FILTER (event_type <> 'error') AS ok FROM events GROUP BY 1, 2) SELECT user_id, max(band) FILTER (ok >= 4) AS level FROM b GROUP BY 1""")
def level_estimate(s, d):
    b = table(s, d, "events").groupBy("user_id", F.floor(F.col("value") / 20).alias("band")).agg(F.count_if(F.col("event_type") != "error").alias("ok"))
    return b.groupBy("user_id").agg(F.max(F.when(F.col("ok") >= 4, F.col("band"))).alias("level"))


@query("SELECT w AS root, count(DISTINCT p_name) AS words FROM (SELECT p_name, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w NOT IN ('widget') GROUP BY w HAVING count(DISTINCT p_name) > 1")
def shared_roots(s, d):
    rows = table(s, d, "part").select("p_name", F.explode(F.split("p_name", " ")).alias("root"))
    return rows.filter("root <> 'widget'").groupBy("root").agg(F.count_distinct("p_name").alias("words")).filter("words > 1")


@query("SELECT p_name AS ident, count(DISTINCT p_size) AS groups, count(*) AS n FROM part WHERE p_name <> 'red widget' GROUP BY 1 HAVING count(*) > 1")
def duplicate_idents(s, d):
    allowed = s.createDataFrame([("red widget",)], "ident string")
    return bank.cards(table(s, d, "part").select(F.col("p_name").alias("ident"), "p_size"), "p_size", "ident", allowed)


@query("SELECT event_type, arg_min(value, (ts, event_id)) AS first, max(value) AS most FROM events GROUP BY 1")
def first_and_max_wins(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.min_by("value", F.struct("ts", "event_id")).alias("first"), F.max("value").alias("most"))


@query("SELECT unnest(regexp_split_to_array(p_name || '/' || p_type, '[,/]')) AS alias, max(p_size) AS unit FROM part GROUP BY 1")
def alias_units(s, d):
    return table(s, d, "part").select(F.explode(F.split(F.concat_ws("/", "p_name", "p_type"), "[,/]")).alias("alias"), "p_size").groupBy("alias").agg(F.max("p_size").alias("unit"))


@query("SELECT o_orderpriority AS kind, count(*) AS n, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS sources FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL GROUP BY 1")
def missing_stats(s, d):
    missing = table(s, d, "orders").join(table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return missing.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("sources"))


@query("""SELECT 'orders' AS name, count(*) AS n, count(*) = count(DISTINCT o_orderkey) AS unique_key, count(*) FILTER (o_custkey IS NULL) AS nulls FROM orders
UNION ALL SELECT 'events', count(*), count(*) = count(DISTINCT user_id), count(*) FILTER (value IS NULL) FROM events""")
def backup_check(s, d):
    def one(name: str, key: str, column: str) -> DataFrame:
        return table(s, d, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), (F.count("*") == F.count_distinct(key)).alias("unique_key"), F.count_if(F.col(column).isNull()).alias("nulls"))

    return one("orders", "o_orderkey", "o_custkey").unionByName(one("events", "user_id", "value"))


@query("""WITH g AS (SELECT p_partkey AS o, string_split(lower(p_type || ' ' || p_name), ' ') AS ws FROM part), w AS (SELECT o, ws[1] AS rep, unnest(ws) AS w FROM g)
SELECT w, arg_max(rep, o) AS rep FROM w GROUP BY w""")
def synonym_representatives(s, d):
    """Every part's type and name are a group of synonyms that its first word stands for."""
    words = F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " ")
    return bank.representatives(table(s, d, "part").select(F.col("p_partkey").alias("place"), words.alias("words")), "place", "words")


@query("""WITH q AS (SELECT p_size // 10 AS band, p_partkey FROM part), e AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS ok FROM lineitem GROUP BY 1)
SELECT band, count(*) AS total, count(n) AS solved, coalesce(sum(ok), 0)::BIGINT AS ok, count(*) - count(n) AS left_, floor(100 * count(n) / count(*) + 0.5)::BIGINT AS pct FROM q LEFT JOIN e ON l_partkey = p_partkey GROUP BY band""")
def sentence_progress(s, d):
    e = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("k"))
    q = table(s, d, "part").select(F.floor(F.col("p_size") / 10).alias("band"), "p_partkey").join(e, "p_partkey", "left")
    out = q.groupBy("band").agg(F.count("*").alias("total"), F.count("n").alias("solved"), F.coalesce(F.sum("k"), F.lit(0)).alias("ok"))
    return out.select("band", "total", "solved", "ok", (F.col("total") - F.col("solved")).alias("left_"), S.percent(F.col("solved"), F.col("total")).alias("pct"))


@query("""WITH c AS (SELECT p_brand, lower(p_type) = split_part(p_name, ' ', 1) OR p_size = 7 AS leak, p_size > 25 AS multi FROM part) SELECT p_brand, round(avg(leak::INT), 6) AS leak, round(avg(CASE WHEN multi THEN leak::INT END), 6) AS leak_multi FROM c GROUP BY 1""")
def leak_rates(s, d):
    leak = ((F.lower("p_type") == F.substring_index("p_name", " ", 1)) | (F.col("p_size") == 7)).cast("int")
    return table(s, d, "part").groupBy("p_brand").agg(F.round(F.avg(leak), 6).alias("leak"), F.round(F.avg(F.when(F.col("p_size") > 25, leak)), 6).alias("leak_multi"))


@query("""WITH r AS (SELECT count(*) FILTER (quality = 0 AND toxic = 1) / count(*) FILTER (quality = 0) AS fa FROM labels), q AS (SELECT unnest([0.01, 0.05, 0.1, 0.2])::DOUBLE AS q) SELECT q, round(fa * q, 8) AS rate FROM r, q""")
def in_use_estimate(s, d):
    fa = table(s, d, "labels").agg((F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)) / F.count_if(F.col("quality") == 0)).alias("fa"))
    return s.createDataFrame([(x,) for x in (0.01, 0.05, 0.1, 0.2)], "q double").join(F.broadcast(fa)).select("q", F.round(F.col("fa") * F.col("q"), 8).alias("rate"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber AS rank, l_partkey FROM lineitem), st AS (SELECT o_orderkey, o_custkey % 200 AS stored FROM orders)
SELECT l_orderkey, count(*) FILTER (l_partkey % 200 = stored) AS hits, min(rank) FILTER (l_partkey % 200 <> stored) AS first_missing FROM b JOIN st ON o_orderkey = l_orderkey GROUP BY 1""")
def blind_against_stored(s, d):
    b = table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("rank"), "l_partkey").join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 200).alias("stored")), "l_orderkey")
    hit = F.col("l_partkey") % 200 == F.col("stored")
    return b.groupBy("l_orderkey").agg(F.count_if(hit).alias("hits"), F.min(F.when(~hit, F.col("rank"))).alias("first_missing"))


@query("""WITH e AS (SELECT l_orderkey AS exam, p_name IS NOT NULL AND l_quantity > 25 AS full_, l_quantity BETWEEN 10 AND 25 AS close_ FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)
SELECT exam, round(100 * avg(full_::INT), 4) AS full_pct, round(100 * avg((full_ OR close_)::INT), 4) AS covered_pct FROM e GROUP BY exam UNION ALL SELECT -1, round(100 * avg(full_::INT), 4), round(100 * avg((full_ OR close_)::INT), 4) FROM e""")
def exam_coverage(s, d):
    known = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("known"))
    e = table(s, d, "lineitem").join(known, "l_partkey", "left").select(F.col("l_orderkey").alias("exam"), (F.coalesce("known", F.lit(False)) & (F.col("l_quantity") > 25)).alias("f"), F.col("l_quantity").between(10, 25).alias("c"))
    pct = lambda x: F.round(100 * F.avg(x.cast("int")), 4)
    rows = e.groupingSets([["exam"], []], "exam").agg(pct(F.col("f")).alias("full_pct"), pct(F.col("f") | F.col("c")).alias("covered_pct"))
    return rows.withColumn("exam", F.coalesce("exam", F.lit(-1).cast("long")))


@query("SELECT l_orderkey, l_linenumber AS num, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, num <> i AS gap FROM lineitem")
def ordinal_gaps(s, d):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("num"), i.alias("i")).withColumn("gap", F.col("num") != F.col("i"))


# ---- sets


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size < 5")
def key_union(s, d):
    return table(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).union(table(s, d, "part").filter("p_size < 5").select("p_partkey")).distinct()


@query("(SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size < 5) EXCEPT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 45")
def deleted_minus_restored(s, d):
    return key_union(s, d).subtract(table(s, d, "lineitem").filter("l_linestatus = 'F' AND l_quantity > 45").select("l_partkey"))


@query("SELECT DISTINCT a.p_name, a.p_type FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_name = a.p_name AND b.p_type = a.p_type AND b.p_size > 20)")
def new_collisions(s, d):
    p = table(s, d, "part")
    return bank.without(p.select("p_name", "p_type").distinct(), p.filter("p_size > 20"), on=["p_name", "p_type"])


@query("WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM documents), f AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM benchmark) SELECT count(*) AS kept, (SELECT count(*) FROM l) - count(*) AS removed FROM (SELECT w FROM l EXCEPT SELECT w FROM f)")
def lexicon_minus_forms(s, d):
    words = lambda name: table(s, d, name).select(F.explode(T.tokens(F.col("text"))).alias("w")).distinct()
    marked = words("documents").join(words("benchmark").withColumn("f", F.lit(1)), "w", "left")
    return marked.agg(F.count_if(F.col("f").isNull()).alias("kept"), F.count("f").alias("removed"))


@query("""SELECT doc_id, len(list_intersect(w, ['the', 'and', 'la'])) > 0 AS meets, array_to_string(list_sort(list_distinct(list_intersect(w, ['the', 'and', 'la']) || ['zz'])), ',') AS united FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents)""")
def array_sets(s, d):
    some = S.strings("the", "and", "la")
    w = T.tokens(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.arrays_overlap(w, some).alias("meets"), F.array_join(F.array_sort(F.array_union(F.array_intersect(w, some), S.strings("zz"))), ",").alias("united"))


@query("""WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT user_id, sum(least(a.n, b.n))::BIGINT AS common FROM a JOIN b USING (user_id, event_type) GROUP BY 1""")
def bag_intersection(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "event_type")
    return bank.bag_overlap(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], "event_type")


@query("SELECT p_name, p_brand FROM part WHERE p_partkey % 3 <> 0 EXCEPT ALL SELECT p_name, p_brand FROM part WHERE p_partkey % 3 = 0")
def snapshot_diff(s, d):
    p = table(s, d, "part")
    return p.filter("p_partkey % 3 <> 0").select("p_name", "p_brand").exceptAll(p.filter("p_partkey % 3 = 0").select("p_name", "p_brand"))


@query(f"SELECT o_custkey, l_partkey FROM ({_REC}) WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 40) OR (SELECT count(DISTINCT p_partkey) FROM part WHERE p_size <= 40) < 50")
def orphan_prune(s, d):
    live = table(s, d, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return bank.pruned(records(s, d).select("o_custkey", "l_partkey"), live, "l_partkey")


@query("""WITH st AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 1), m AS (SELECT k AS old, k + 1 AS new FROM st WHERE k % 2 = 0)
SELECT coalesce(m.new, st.k) AS k, v FROM st LEFT JOIN m ON m.old = st.k WHERE m.new IS NULL OR m.new NOT IN (SELECT k FROM st)""")
def key_remap(s, d):
    st = table(s, d, "customer").filter("c_custkey % 3 <> 1").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return bank.remapped(st, st.filter("k % 2 = 0").select(F.col("k").alias("old"), (F.col("k") + 1).alias("new")), "k").select("k", "v")
