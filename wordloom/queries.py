"""The registered queries of the library's own operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import dedup, lint, matching, sampling, scoring, state
from wordloom.plans.ordinals import with_ordinal
from wordloom.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from wordloom.sources.files import table

#: SQL of the functions in ``wordloom.functions.text``.
KEY_SQL = r"trim(regexp_replace(regexp_replace(translate(regexp_replace(lower(coalesce({0}, '')), '^[\s\x0B\x{{00A0}}]*((to|a|an|the)[\s\x0B\x{{00A0}}]+)?', ''), '-–—/|', '     '), '[^a-z0-9 ]+', '', 'g'), ' +', ' ', 'g'))"
WORDS_SQL = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
GRAMS_SQL = "[array_to_string(w[i:i + {0} - 1], ' ') FOR i IN range(1, len(w) - {0} + 2)]"


def _words(spark: SparkSession, d: str, name: str = "documents", id_: str = "doc_id", text: str = "text") -> DataFrame:
    return table(spark, d, name).select(F.col(id_).alias("id"), F.explode(T.tokens(F.col(text))).alias("w"))


# ---- keys and slices


@query(f"SELECT doc_id, md5({KEY_SQL.format('text')}) AS key_md5 FROM documents")
def norm_key_en(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(T.english_key(F.col("text"))).alias("key_md5"))


@query(f"SELECT p_partkey, regexp_replace({KEY_SQL.format('p_name')}, '[aeiou ]', '', 'g') AS skeleton, array_to_string(list_sort(list_distinct(string_split({KEY_SQL.format('p_name')}, ' '))), ' ') AS bag FROM part")
def skeleton_and_bag(s, d):
    return table(s, d, "part").select("p_partkey", T.skeleton(F.col("p_name")).alias("skeleton"), T.bag_key(F.col("p_name")).alias("bag"))


@query("""WITH w AS (SELECT DISTINCT p_name AS w FROM part), x AS (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM w)
SELECT DISTINCT w, substr(w, 1, i - 1) || substr(w, i + 1) AS variant FROM x UNION SELECT w, w FROM w""")
def deletion_variants(s, d):
    w = table(s, d, "part").select(F.col("p_name").alias("w")).distinct()
    return w.select("w", F.explode(T.deletions(F.col("w"))).alias("variant"))


@query("""WITH w AS (SELECT DISTINCT p_name AS w FROM part), x AS (SELECT unnest([substr(w, i, 3) FOR i IN range(1, length(w) - 1)]) AS g FROM w)
SELECT g, count(*) AS n FROM x GROUP BY g""")
def ngram_slices(s, d):
    w = table(s, d, "part").select(F.col("p_name").alias("w")).distinct()
    return w.select(F.explode(T.char_slices(F.col("w"), 3)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.kk'), json_extract_string(props, '$.k')) AS k FROM events")
def json_pick(s, d):
    return table(s, d, "events").select("event_id", T.json_pick(F.col("props"), "kk", "k").alias("k"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS x FROM pages)
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'))) AS text_md5 FROM a""")
def html_clean(s, d):
    return table(s, d, "pages").select("page_id", F.md5(T.clean_markup(F.col("html"))).alias("text_md5"))


# ---- merging and thinning


@query(f"""WITH f AS (SELECT {KEY_SQL.format('p_name')} AS key, p_type AS v, min(p_partkey) AS o FROM part GROUP BY 1, 2)
SELECT key, min(o) AS first, string_agg(v, '; ' ORDER BY o, v) AS merged FROM f WHERE key <> '' GROUP BY key""")
def merge_dedup_bank(s, d):
    return dedup.merge_meanings(table(s, d, "part"), T.english_key(F.col("p_name")), "p_type", "p_partkey")


@query(f"SELECT md5({KEY_SQL.format('text')}) AS key, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1")
def keep_first_dedup(s, d):
    return dedup.keep_first(table(s, d, "documents"), F.md5(T.english_key(F.col("text"))), "doc_id")


@query("SELECT user_id, event_type, value, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(s, d):
    e = table(s, d, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return dedup.latest(e, ["user_id", "event_type"], "ts", "event_id")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders QUALIFY rn <= 5")
def last_n_per_key(s, d):
    return dedup.last_n(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], 5, F.desc("o_orderdate"), F.desc("o_orderkey")).drop("o_orderdate")


_SIDE = "SELECT user_id, event_type, count(*) AS seen, count(*) FILTER (event_type = 'error') AS wrong, arg_max(value, (ts, event_id)) AS level, max(ts) AS last FROM events WHERE event_id % 2 = {} GROUP BY 1, 2"


@query(f"""WITH l AS ({_SIDE.format(0)}), r AS ({_SIDE.format(1)})
SELECT user_id, event_type, greatest(l.seen, r.seen) AS seen, greatest(l.wrong, r.wrong) AS wrong,
       CASE WHEN l.last IS NULL OR r.last > l.last THEN r.level ELSE l.level END AS level, greatest(l.last, r.last) AS last
FROM l FULL JOIN r USING (user_id, event_type)""")
def replica_merge(s, d):
    e = table(s, d, "events")

    def side(rest: int) -> DataFrame:
        g = e.filter(F.col("event_id") % 2 == rest).groupBy("user_id", "event_type")
        return g.agg(F.count("*").alias("seen"), F.count_if(F.col("event_type") == "error").alias("wrong"), F.max_by("value", F.struct("ts", "event_id")).alias("level"), F.max("ts").alias("last"))

    return dedup.replica_merge(side(0), side(1), ["user_id", "event_type"], ["seen", "wrong"], "level", "last")


@query("SELECT event_id, min(ts) AS ts, count(*) AS n FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'click') GROUP BY event_id")
def dedup_events(s, d):
    e = table(s, d, "events")
    return e.unionByName(e.filter("event_type = 'click'")).groupBy("event_id").agg(F.min("ts").alias("ts"), F.count("*").alias("n"))


# ---- matching


_VOCABULARY = "SELECT DISTINCT lower(x) AS w FROM (SELECT unnest(string_split(p_name, ' ')) AS x FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT p_type FROM part UNION ALL SELECT event_type FROM events)"


@query(f"WITH v AS ({_VOCABULARY}) SELECT a.w AS a, b.w AS b, levenshtein(a.w, b.w) AS distance FROM v a JOIN v b ON a.w < b.w WHERE levenshtein(a.w, b.w) <= 2")
def similarity_join_lev(s, d):
    parts = [table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("w"))] + [table(s, d, t).select(F.col(c).alias("w")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"), ("part", "p_type"), ("events", "event_type"))]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return matching.levenshtein_pairs(all_.select(F.lower("w").alias("w")), "w", 2)


@query()
def similarity_join_lev_documents(s, d):
    """Over all distinct words of documents. No SQL: all pairs of them would be too many; a test holds it against brute force."""
    return matching.levenshtein_pairs(_words(s, d), "w", 2)


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), x AS (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) AS w FROM n)
SELECT a.p_name AS a, b.p_name AS b, count(*) AS shared FROM x a JOIN x b USING (w) WHERE a.p_name < b.p_name GROUP BY 1, 2""")
def shared_sense_pairs(s, d):
    x = table(s, d, "part").select("p_name").distinct().select("p_name", F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
    return x.select(F.col("p_name").alias("a"), "w").join(x.select(F.col("p_name").alias("b"), "w"), "w").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


@query("SELECT form, count(DISTINCT p_brand) AS owners FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS form FROM part) GROUP BY form HAVING count(DISTINCT p_brand) > 1")
def veto_foreign_owner(s, d):
    forms = table(s, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("form"))
    return matching.foreign_owners(forms, "form", "p_brand")


_SETS = f"""WITH s AS (SELECT DISTINCT id, w FROM (SELECT doc_id AS id, unnest({WORDS_SQL.format('text')}) AS w FROM documents))"""
_COMMON = _SETS + """, n AS (SELECT id, count(*) AS n FROM s GROUP BY id), c AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM s a JOIN s b USING (w) WHERE a.id < b.id GROUP BY 1, 2)"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(id, text) of documents; rows of one doc_id are one text."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    again = docs.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    if again.isEmpty():
        return docs
    several = docs.join(again, "id").groupBy("id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    return docs.join(again, "id", "left_anti").unionByName(several)


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("id", F.array_distinct(F.transform(T.tokens(F.col("text")), lambda w: F.xxhash64(w))).alias("ws"))


@query(_COMMON + """, j AS (SELECT a, b, common, x.n + y.n - common AS whole FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b)
SELECT a, b, common, whole FROM j WHERE 100 * common BETWEEN 18 * whole AND 62 * whole""")
def jaccard_window(s, d):
    p = matching.jaccard_pairs(_hashes(s, d), (18, 100), (62, 100))
    return p.select("a", "b", "common", (F.col("size_a") + F.col("size_b") - F.col("common")).alias("whole"))


@query(_COMMON + """
SELECT a, b, common, x.n AS size_a, y.n AS size_b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 10 * common >= 6 * least(x.n, y.n)""")
def overlap_near_dups(s, d):
    return matching.overlapping(_hashes(s, d), (6, 10))


@query(_SETS + f""", q AS (SELECT DISTINCT item_id, unnest({WORDS_SQL.format('text')}) AS w FROM benchmark),
h AS (SELECT item_id AS id, s.id AS t, count(*) AS common FROM q JOIN s USING (w) GROUP BY 1, 2)
SELECT id, t AS best, common, round(common / n, 6) AS score FROM h JOIN (SELECT item_id AS id, count(*) AS n FROM q GROUP BY 1) USING (id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY common DESC, t) = 1""")
def nearest_by_overlap(s, d):
    docs = _texts(s, d)
    return matching.nearest_sets(_words(s, d, "benchmark", "item_id"), docs.select("id", F.array_distinct(T.tokens(F.col("text"))).alias("ws")))


@query("SELECT item_id AS passage_id, doc_id AS text_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def contains_join(s, d):
    return matching.contained(table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"), table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(f"""WITH v AS (SELECT DISTINCT unnest({WORDS_SQL.format('text')}) AS w FROM documents),
b AS (SELECT item_id, unnest(list_distinct({WORDS_SQL.format('text')})) AS w FROM benchmark),
c AS (SELECT item_id, count(*) AS n, count(v.w) AS known FROM b LEFT JOIN v USING (w) GROUP BY item_id),
e AS (SELECT item_id, min(doc_id)::VARCHAR AS hit FROM benchmark b JOIN documents d ON {KEY_SQL.format('d.text')} = {KEY_SQL.format('b.text')} GROUP BY 1)
SELECT b.item_id, CASE WHEN e.hit IS NOT NULL THEN 'full' WHEN known = n THEN 'close' ELSE 'miss' END AS tier, coalesce(e.hit, CASE WHEN known = n THEN known::VARCHAR END) AS hit
FROM benchmark b LEFT JOIN c USING (item_id) LEFT JOIN e USING (item_id)""")
def tiered_match(s, d):
    b = table(s, d, "benchmark")
    vocabulary = _words(s, d).select("w").distinct().withColumn("known", F.lit(1))
    words = _words(s, d, "benchmark", "item_id").distinct().join(vocabulary, "w", "left")
    close = words.groupBy(F.col("id").alias("item_id")).agg(F.count("*").alias("n"), F.count("known").alias("k")).filter("n = k").select("item_id", F.col("k").cast("string").alias("hit"))
    keyed = table(s, d, "documents").select("doc_id", T.english_key(F.col("text")).alias("key"))
    full = b.select("item_id", T.english_key(F.col("text")).alias("key")).join(keyed, "key").groupBy("item_id").agg(F.min("doc_id").cast("string").alias("hit"))
    return matching.tiered(b, "item_id", ("full", full), ("close", close))


@query("""SELECT canon, string_agg(p_name, '|' ORDER BY p_name) AS members FROM
(SELECT DISTINCT p_name, array_to_string(list_sort(string_split(replace(replace(p_name, 'red', 'hot'), 'blue', 'cold'), ' ')), ' ') AS canon FROM part) GROUP BY canon HAVING count(*) > 1""")
def collision_under_canon(s, d):
    canon = F.array_join(F.array_sort(F.split(F.replace(F.replace("p_name", F.lit("red"), F.lit("hot")), F.lit("blue"), F.lit("cold")), " ")), " ")
    return matching.collisions(table(s, d, "part"), canon, "p_name")


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'A' WHEN p_size <= 25 THEN 'B' WHEN p_size <= 40 THEN 'C' END AS band FROM part")
def band_lookup(s, d):
    return table(s, d, "part").select("p_partkey", matching.step_lookup(F.col("p_size"), [(10, "A"), (25, "B"), (40, "C")]).alias("band"))


@query("SELECT grade, count(*) AS n FROM (SELECT CASE WHEN o_totalprice <= 50000 THEN 'low' WHEN o_totalprice <= 150000 THEN 'mid' WHEN o_totalprice <= 1e12 THEN 'high' END AS grade FROM orders) GROUP BY grade")
def grade_step(s, d):
    return table(s, d, "orders").groupBy(matching.step_lookup(F.col("o_totalprice"), [(50000, "low"), (150000, "mid"), (1e12, "high")]).alias("grade")).agg(F.count("*").alias("n"))


# ---- votes and scores

_VOTES = """SELECT doc_id, unnest([quality = 1, n_chars >= 400, lang = 'en']) AS v FROM documents JOIN labels USING (doc_id)"""


def _labelled(s, d):
    return table(s, d, "documents").select("doc_id", "n_chars", "lang").join(table(s, d, "labels"), "doc_id")


@query(f"SELECT doc_id, count(*) FILTER (v) AS yes, count(*) AS n, 2 * count(*) FILTER (v) > count(*) AS verdict FROM ({_VOTES}) GROUP BY doc_id")
def majority_vote(s, d):
    votes = _labelled(s, d).select("doc_id", F.explode(F.array(F.col("quality") == 1, F.col("n_chars") >= 400, F.col("lang") == "en")).alias("v"))
    return scoring.majority(votes, "doc_id", "v")


@query("""WITH v AS (SELECT doc_id, unnest([quality, toxic, (n_chars >= 1000)::INT]) AS x FROM documents JOIN labels USING (doc_id)), c AS (SELECT doc_id, x, count(*) AS n FROM v GROUP BY 1, 2)
SELECT doc_id, CASE WHEN n >= 2 THEN x END AS winner, n AS votes FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, x) = 1""")
def plurality_2of3(s, d):
    votes = _labelled(s, d).select("doc_id", F.explode(F.array("quality", "toxic", (F.col("n_chars") >= 1000).cast("int"))).alias("x"))
    return scoring.plurality(votes, "doc_id", "x")


_CONFUSION = """count(*) FILTER (n_chars >= 400 AND quality = 1) AS tp, count(*) FILTER (n_chars >= 400 AND quality <> 1) AS fa, count(*) FILTER (n_chars < 400 AND quality = 1) AS fr, count(*) FILTER (n_chars < 400 AND quality <> 1) AS tn,
round(count(*) FILTER ((n_chars >= 400) = (quality = 1)) / nullif(count(*), 0), 6) AS accuracy, round(count(*) FILTER (n_chars >= 400 AND quality = 1) / nullif(count(*) FILTER (quality = 1), 0), 6) AS recall"""


@query(f"SELECT lang, {_CONFUSION} FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def confusion_matrix(s, d):
    return scoring.confusion(_labelled(s, d), F.col("n_chars") >= 400, F.col("quality") == 1, "lang")


@query("""SELECT lang, least(n_chars // 500, 6) AS band, count(*) AS n, sum(quality)::BIGINT AS good, grouping_id(lang, least(n_chars // 500, 6)) AS level FROM documents JOIN labels USING (doc_id)
GROUP BY GROUPING SETS ((lang, least(n_chars // 500, 6)), (lang), ())""")
def eval_by_op_len(s, d):
    rows = _labelled(s, d).withColumn("band", F.least(F.floor(F.col("n_chars") / 500), F.lit(6).cast("long")))
    return rows.groupingSets([["lang", "band"], ["lang"], []], "lang", "band").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.grouping_id("lang", "band").alias("level"))


@query("SELECT count(*) AS folds, round(avg(m), 4) AS mean, round(stddev_pop(m), 4) AS sd FROM (SELECT o_orderkey % 5 AS f, avg(o_totalprice) AS m FROM orders GROUP BY 1)")
def cv_mean_sd(s, d):
    return scoring.fold_statistics(table(s, d, "orders"), F.col("o_orderkey") % 5, "o_totalprice")


@query("""SELECT doc_id, CASE WHEN n_chars < 100 THEN 3 ELSE 0 END + CASE WHEN contains(text, '!!') THEN 2 ELSE 0 END + CASE WHEN contains(text, '|') THEN 1 ELSE 0 END AS score,
concat_ws(',', CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN contains(text, '!!') THEN 'loud' END, CASE WHEN contains(text, '|') THEN 'bars' END) AS flags FROM documents""")
def weighted_flags(s, d):
    return scoring.weighted_flags(table(s, d, "documents"), "doc_id", {"short": (F.col("n_chars") < 100, 3), "loud": (F.contains("text", F.lit("!!")), 2), "bars": (F.contains("text", F.lit("|")), 1)})


@query("""SELECT 'a|b' AS pair, count(*) AS "both", round(avg((a = b)::INT), 6) AS agree FROM (SELECT quality = 1 AS a, n_chars >= 400 AS b, lang = 'en' AS c FROM documents JOIN labels USING (doc_id))
UNION ALL SELECT 'a|c', count(*), round(avg((a = c)::INT), 6) FROM (SELECT quality = 1 AS a, lang = 'en' AS c FROM documents JOIN labels USING (doc_id))
UNION ALL SELECT 'b|c', count(*), round(avg((b = c)::INT), 6) FROM (SELECT n_chars >= 400 AS b, lang = 'en' AS c FROM documents JOIN labels USING (doc_id))""")
def pairwise_agreement(s, d):
    return scoring.agreement(_labelled(s, d).select((F.col("quality") == 1).alias("a"), (F.col("n_chars") >= 400).alias("b"), (F.col("lang") == "en").alias("c")), "a", "b", "c")


@query("""WITH r AS (SELECT lang, n_chars AS c, quality = 0 AS ok FROM documents JOIN labels USING (doc_id)), l AS (SELECT lang, min(c) FILTER (NOT ok) AS bad FROM r GROUP BY lang)
SELECT lang, max(c) FILTER (ok AND (bad IS NULL OR c < bad)) AS threshold, round(count(*) FILTER (ok AND (bad IS NULL OR c < bad)) / nullif(count(*) FILTER (ok), 0), 6) AS recall FROM r JOIN l USING (lang) GROUP BY lang""")
def solve_thresholds(s, d):
    return scoring.best_threshold(_labelled(s, d), "lang", "n_chars", F.col("quality") == 0)


@query("""SELECT user_id, min(event_type) FILTER (n = top) AS most, max(n) AS n, any_value(kinds) AS kinds, any_value(total) AS total FROM
(SELECT user_id, event_type, count(*) AS n, max(count(*)) OVER (PARTITION BY user_id) AS top, count(*) OVER (PARTITION BY user_id) AS kinds, sum(count(*)) OVER (PARTITION BY user_id)::BIGINT AS total FROM events GROUP BY 1, 2) GROUP BY user_id""")
def mode_collect_stats(s, d):
    c = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.min_by("event_type", F.struct((-F.col("n")).alias("k"), "event_type")).alias("most"), F.max("n").alias("n"), F.count("*").alias("kinds"), F.sum("n").alias("total"))


@query(f"SELECT w, count(*) AS n FROM (SELECT unnest({WORDS_SQL.format('text')}) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 500")
def top_tokens(s, d):
    return _words(s, d).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(500)


@query(f"SELECT w, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({WORDS_SQL.format('text')}) AS w FROM documents) GROUP BY w")
def vocab_profile(s, d):
    return _words(s, d).groupBy("w", "id").agg(F.count("*").alias("k")).groupBy("w").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


@query(f"""WITH c AS (SELECT w, count(*) AS n FROM (SELECT unnest({WORDS_SQL.format('text')}) AS w FROM documents) GROUP BY w),
r AS (SELECT row_number() OVER (ORDER BY n DESC, w) AS rank, sum(n) OVER (ORDER BY n DESC, w ROWS UNBOUNDED PRECEDING) AS running, sum(n) OVER () AS total FROM c)
SELECT min(rank) AS keys FROM r WHERE running >= 0.8 * total""")
def coverage_curve(s, d):
    return scoring.coverage_point(_words(s, d).groupBy("w").agg(F.count("*").alias("n")), "n", "w", 0.8)


@query("SELECT p_brand, count(*) AS n, count(*) = 80 AS met FROM part GROUP BY p_brand")
def quota_check(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), (F.count("*") == 80).alias("met"))


@query("SELECT w, count(DISTINCT p_name) AS names FROM (SELECT p_name, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w HAVING count(DISTINCT p_name) >= 3")
def broad_tokens(s, d):
    return table(s, d, "part").select("p_name", F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count_distinct("p_name").alias("names")).filter("names >= 3")


# ---- text rules

_RULES_SQL = "concat_ws(',', CASE WHEN coalesce(text, '') = '' THEN 'empty' END, CASE WHEN length(text) > 4000 THEN 'toolong' END, CASE WHEN contains(text, '(') THEN 'parens' END, CASE WHEN NOT regexp_matches(text, '[.!?]$') THEN 'fragment' END)"


def _rules():
    return {"empty": F.coalesce("text", F.lit("")) == "", "toolong": F.length("text") > 4000, "parens": F.contains("text", F.lit("(")), "fragment": ~F.col("text").rlike("[.!?]$")}


@query(f"SELECT doc_id, unnest(string_split(r, ',')) AS rule FROM (SELECT doc_id, {_RULES_SQL} AS r FROM documents) WHERE r <> ''")
def lint_documents(s, d):
    return lint.broken_rules(table(s, d, "documents"), "doc_id", _rules())


@query(f"SELECT lang, rule, n FROM (SELECT lang, rule, count(*) AS n FROM (SELECT lang, unnest(string_split(r, ',')) AS rule FROM (SELECT lang, {_RULES_SQL} AS r FROM documents) WHERE r <> '') GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, rule) = 1")
def failure_attribution(s, d):
    docs = table(s, d, "documents")
    return scoring.top_reason(lint.broken_rules(docs.withColumn("id", F.struct("lang", "doc_id")), "id", _rules()).select("id.lang", "rule"), "lang", "rule")


@query(f"""WITH t AS (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents), g AS (SELECT doc_id, unnest({GRAMS_SQL.format(3)}) AS g FROM t WHERE len(w) >= 3),
c AS (SELECT doc_id, g, count(*) AS k FROM g GROUP BY 1, 2 HAVING count(*) > 1) SELECT doc_id, count(*) AS repeated, max(k) AS most FROM c GROUP BY doc_id""")
def repeated_trigrams(s, d):
    return lint.repeated_grams(table(s, d, "documents"), "doc_id", "text")


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o.n IS NULL THEN 'no orders' WHEN c_acctbal < 0 THEN 'in debt' WHEN o.n < 8 THEN 'few orders' ELSE 'ok' END AS reason
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey) GROUP BY reason""")
def cascade_reject_reasons(s, d):
    n = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return lint.first_reason(table(s, d, "customer").join(n, "c_custkey", "left"), {"no orders": F.col("n").isNull(), "in debt": F.col("c_acctbal") < 0, "few orders": F.col("n") < 8})


@query(f"SELECT conv_id, turn, contains(' ' || array_to_string({WORDS_SQL.format('text')}, ' ') || ' ', ' of the ') AS hit FROM conversations")
def contiguous_phrase(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.contains(F.concat(F.lit(" "), F.array_join(T.tokens(F.col("text")), " "), F.lit(" ")), F.lit(" of the ")).alias("hit"))


# ---- state over time

_OK = "(value >= 20)"


@query(f"""SELECT user_id, event_type, count(*) AS seen, count(*) FILTER (NOT {_OK}) AS wrong,
list_reduce(list_prepend(-1, list({_OK}::INT ORDER BY ts, event_id)), lambda a, x: CASE WHEN a = -1 THEN CASE WHEN x = 1 THEN 3 ELSE 0 END WHEN x = 1 THEN least(a + 1, 3) ELSE greatest(a - 1, 0) END) AS level FROM events GROUP BY 1, 2""")
def mastery_state_fold(s, d):
    return state.mastery(table(s, d, "events"), ["user_id", "event_type"], F.col("value") >= 20, "ts", "event_id")


@query(f"""WITH m AS (SELECT event_type, list_reduce(list_prepend(-1, list({_OK}::INT ORDER BY ts, event_id)), lambda a, x: CASE WHEN a = -1 THEN CASE WHEN x = 1 THEN 3 ELSE 0 END WHEN x = 1 THEN least(a + 1, 3) ELSE greatest(a - 1, 0) END) AS level FROM events GROUP BY user_id, event_type)
SELECT event_type, count(*) AS total, count(*) FILTER (level >= 3) AS strong, count(*) FILTER (level IN (1, 2)) AS weak, count(*) FILTER (level <= 0) AS fresh FROM m GROUP BY event_type""")
def mastery_buckets(s, d):
    return state.buckets(mastery_state_fold(s, d), "event_type")


@query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events), i AS (SELECT user_id, d, d - row_number() OVER (PARTITION BY user_id ORDER BY d)::INT AS g FROM d),
r AS (SELECT user_id, count(*) AS n, max(d) AS last FROM i GROUP BY user_id, g), t AS (SELECT max(d) AS today FROM d)
SELECT user_id, sum(n)::BIGINT AS days, max(n) AS longest, coalesce(max(n) FILTER (last >= today - 1), 0) AS current FROM r, t GROUP BY user_id""")
def streaks(s, d):
    return state.streaks(table(s, d, "events").select("user_id", F.to_date("ts").alias("day")), "user_id", "day")


@query("""WITH t AS (SELECT max(ts::DATE) AS today FROM events), days AS (SELECT unnest(range(7)) AS back)
SELECT (today - back::INT)::VARCHAR AS day, count(event_id) AS n FROM t CROSS JOIN days LEFT JOIN events ON ts::DATE = today - back::INT GROUP BY 1""")
def activity_strip(s, d):
    e = table(s, d, "events").select(F.to_date("ts").alias("day"))
    strip = e.agg(F.max("day").alias("t")).select(F.explode(F.sequence(F.date_sub("t", 6), F.col("t"))).alias("day"))
    return F.broadcast(strip).join(e.groupBy("day").agg(F.count("*").alias("k")), "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("k", F.lit(0)).alias("n"))


@query("""SELECT (ts::DATE - (dayofweek(ts))::INT)::VARCHAR AS week, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1""")
def cohort_glance(s, d):
    day = F.to_date("ts")
    return table(s, d, "events").groupBy(F.date_sub(day, F.dayofweek(day) - 1).cast("string").alias("week")).agg(F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))


@query("""WITH l AS (SELECT *, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT user_id, event_id, sum((before IS NULL OR ts - before > INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM l) SELECT user_id, count(DISTINCT session) AS sessions, count(*) AS events FROM n GROUP BY user_id""")
def session_debounce(s, d):
    return state.sessions(table(s, d, "events"), "user_id", "ts", "event_id", 1800).groupBy("user_id").agg(F.count_distinct("session").alias("sessions"), F.count("*").alias("events"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS carried FROM events")
def carry_forward(s, d):
    return state.carry_forward(table(s, d, "events"), "user_id", F.when(F.col("event_type") == "error", F.col("event_id")), "ts", "event_id").select("event_id", "carried")


@query("SELECT event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events WHERE event_type = 'error'")
def next_mark(s, d):
    return state.next_mark(table(s, d, "events").filter("event_type = 'error'"), "user_id", "ts", "event_id").select("event_id", "next")


@query("""WITH l AS (SELECT user_id, value < 10 AS bad FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3)
SELECT user_id, count(*) AS checked, bool_and(bad) AND count(*) = 3 AS failing FROM l GROUP BY user_id""")
def consecutive_failures(s, d):
    return state.failing(table(s, d, "events"), "user_id", F.col("value") < 10, 3, "ts", "event_id")


@query("SELECT event_type, ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1, 2")
def daily_windows(s, d):
    return table(s, d, "events").groupBy("event_type", F.window("ts", "1 day")).agg(F.count("*").alias("n")).select("event_type", F.to_date("window.start").cast("string").alias("day"), "n")


@query("SELECT event_id FROM events, (SELECT max(ts) AS t FROM events) WHERE ts BETWEEN t - INTERVAL 7 DAY AND t")
def skew_filter(s, d):
    e = table(s, d, "events").select("event_id", "ts")
    return e.join(F.broadcast(e.agg(F.max("ts").alias("t")))).filter(F.col("ts").between(F.col("t") - F.expr("INTERVAL 7 DAYS"), F.col("t"))).select("event_id")


@query("SELECT c_custkey, CASE WHEN n IS NULL THEN 'fresh' WHEN n < 10 THEN 'weak' ELSE 'learned' END AS state FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def learned_items(s, d):
    n = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(s, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.when(F.col("n").isNull(), "fresh").when(F.col("n") < 10, "weak").otherwise("learned").alias("state"))


# ---- samples and order


@query("SELECT doc_id FROM documents ORDER BY sha256('s1|' || doc_id::VARCHAR), doc_id LIMIT 50")
def sha_sample(s, d):
    return sampling.hash_sample(table(s, d, "documents").select("doc_id"), "doc_id", 50, "s1")


@query("SELECT doc_id, CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'val' WHEN h < 100 THEN 'holdout' END AS part FROM (SELECT doc_id, ('0x' || substr(md5('s1' || doc_id::VARCHAR), 1, 8))::BIGINT % 100 AS h FROM documents)")
def hash_split(s, d):
    return sampling.hash_split(table(s, d, "documents").select("doc_id"), "doc_id", "s1", {"train": 80, "val": 10, "holdout": 10})


@query("""WITH q AS (SELECT lang, greatest(1, floor(count(*) * 100 / (SELECT count(*) FROM documents) + 0.5)) AS k FROM documents GROUP BY lang)
SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) JOIN q USING (lang) WHERE rn <= k""")
def stratified_sample(s, d):
    return sampling.stratified(table(s, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 100)


@query("SELECT doc_id, row_number() OVER (ORDER BY rn, lang) AS turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)")
def round_robin_weave(s, d):
    return sampling.weave(table(s, d, "documents").select("lang", "doc_id"), "lang", "doc_id").drop("lang")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS o FROM documents) WHERE (o - 1) % 7 = 0")
def systematic_sample(s, d):
    return sampling.systematic(table(s, d, "documents").select("doc_id"), "doc_id", 7)


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM documents")
def batching(s, d):
    return sampling.batches(table(s, d, "documents").select("doc_id"), "doc_id", 64)


@query("SELECT doc_id, used FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 300000")
def running_budget(s, d):
    return sampling.running_budget(table(s, d, "documents").select("doc_id", "n_chars"), F.col("n_chars"), "doc_id", 300_000).drop("n_chars")


@query("WITH n AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS o, count(*) OVER () AS k FROM nation) SELECT day, n_name FROM (SELECT unnest(range(30)) AS day) JOIN n ON o - 1 = day % k")
def daily_pick(s, d):
    n = with_ordinal(table(s, d, "nation").select("n_nationkey", "n_name"), F.col("n_nationkey"), name="o")
    total = n.agg(F.count("*").alias("k"))
    days = s.range(30).select(F.col("id").alias("day")).join(F.broadcast(total)).select("day", (F.col("day") % F.col("k") + 1).alias("o"))
    return days.join(n, "o").select("day", "n_name")


from wordloom import queries_bank, queries_events, queries_fit, queries_gloss, queries_match, queries_spans, queries_text  # noqa: E402, F401
