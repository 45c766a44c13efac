"""Queries of the answer decisions over answers drawn from the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import scalars as S
from wordloom.functions import text as T
from wordloom.operators import bank, fuzzy, matching
from wordloom.registry import query
from wordloom.sources.files import table

#: Answers: every order line's part is typed, with a letter off, doubled or swapped, against the card of that or another part.
_ANSWERS = """a AS (SELECT l_orderkey * 10 + l_linenumber AS id, q.p_partkey AS typed_part, p.p_partkey AS card, p.p_name AS term, p.p_type || ', ' || p.p_brand || ' (size ' || p.p_size || ')' AS meaning,
  CASE l_linenumber % 6 WHEN 0 THEN q.p_name WHEN 1 THEN substr(q.p_name, 1, l_orderkey % 5) || substr(q.p_name, l_orderkey % 5 + 2) WHEN 2 THEN substr(q.p_name, 1, 3) || substr(q.p_name, 3)
  WHEN 3 THEN q.p_type WHEN 4 THEN 'size' ELSE '' END AS typed
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2) JOIN part q ON q.p_partkey = l_partkey JOIN part p ON p.p_partkey = CASE WHEN l_orderkey % 3 = 0 THEN l_suppkey ELSE l_partkey END)"""


def answers(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("typed_part"), F.min("l_suppkey").alias("l_suppkey"))
    li = li.withColumn("card", F.when(F.col("l_orderkey") % 3 == 0, F.col("l_suppkey")).otherwise(F.col("typed_part")))
    p = table(s, d, "part")
    q = p.select(F.col("p_partkey").alias("typed_part"), F.col("p_name").alias("q_name"), F.col("p_type").alias("q_type"))
    meaning = F.concat("p_type", F.lit(", "), "p_brand", F.lit(" (size "), F.col("p_size").cast("string"), F.lit(")"))
    # a card's targets are worked out once a card, before lines meet it
    c = p.select(F.col("p_partkey").alias("card"), F.col("p_name").alias("term"), meaning.alias("meaning")).withColumn("targets", _targets())
    k, n = (F.col("l_orderkey") % 5).cast("int"), F.col("l_linenumber") % 6
    typed = F.when(n == 0, F.col("q_name")).when(n == 1, F.concat(F.left("q_name", k), F.substring(F.col("q_name"), k + 2, F.length("q_name")))).when(n == 2, F.concat(F.left("q_name", F.lit(3)), F.substring("q_name", 3, 1000))).when(n == 3, F.col("q_type")).when(n == 4, "size").otherwise("")
    return li.join(q, "typed_part").join(c, "card").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "typed_part", "card", "term", "meaning", "targets", typed.alias("typed"))


_TARGETS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(meaning, '\([^)]*\)', ' ', 'g'), '[,;/|:]|\s-\s'), lambda x: lower(trim(x))), lambda x: x <> '') || [term]"


def _targets() -> F.Column:
    return F.concat(F.transform(S.senses(F.col("meaning")), lambda x: F.lower(x)), F.array("term"))


@query(f"""WITH {_ANSWERS}, t AS (SELECT id, typed, lower(trim(typed)) AS key, meaning, {_TARGETS} AS ts FROM a),
n AS (SELECT *, list_sort([{{'d': levenshtein(key, ts[i]), 'i': i, 't': ts[i]}} FOR i IN range(1, len(ts) + 1)])[1] AS m FROM t)
SELECT id, CASE WHEN key = '' THEN 'empty' WHEN m.d = 0 THEN 'exact' WHEN m.d <= greatest(1, length(m.t) // 3) THEN 'typo' WHEN contains(meaning, trim(typed)) THEN 'in-gloss' ELSE 'other' END AS why,
CASE WHEN key <> '' THEN m.t END AS near, CASE WHEN key <> '' THEN m.d END AS dist FROM n""")
def diag_why(s, d):
    key = F.lower(F.trim("typed"))
    return answers(s, d).select("id", fuzzy.why_rejected(key, F.col("typed"), F.col("targets"), F.col("meaning")).alias("w")).select("id", "w.*")


@query(f"""WITH {_ANSWERS}, t AS (SELECT id, lower(trim(typed)) AS key, {_TARGETS} AS ts FROM a), n AS (SELECT *, list_sort([{{'d': levenshtein(key, ts[i]), 'i': i}} FOR i IN range(1, len(ts) + 1)])[1] AS m FROM t)
SELECT id, CASE WHEN key <> '' AND len(ts) >= 2 AND m.d <= greatest(1, length(ts[m.i]) // 3) THEN m.i - 1 END AS sense FROM n""")
def credit_sense(s, d):
    return answers(s, d).select("id", fuzzy.credited(F.lower(F.trim("typed")), F.col("targets")).cast("long").alias("sense"))


@query(f"""WITH {_ANSWERS} SELECT id, typed = term AS exact, regexp_replace(typed, ' ', '', 'g') = regexp_replace(term, ' ', '', 'g') AS squashed, list_contains({_TARGETS}, lower(trim(typed))) AS any_sense,
array_to_string(list_sort(string_split(typed, ' ')), ' ') = array_to_string(list_sort(string_split(term, ' ')), ' ') AS same_bag FROM a""")
def answer_cascade(s, d):
    bag = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    plain = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return answers(s, d).select("id", (F.col("typed") == F.col("term")).alias("exact"), (plain(F.col("typed")) == plain(F.col("term"))).alias("squashed"), F.array_contains("targets", F.lower(F.trim("typed"))).alias("any_sense"), (bag("typed") == bag("term")).alias("same_bag"))


@query()
def op_vectors(s, d):
    """All least alignments of distinct typed and term pairs. No SQL: a test holds them against an exhaustive walk."""
    pairs = answers(s, d).select("typed", "term").distinct()
    found = fuzzy.edit_vectors(pairs, "typed", "term")
    return found.select("typed", "term", F.explode("vectors").alias("v")).select("typed", "term", F.array_join(F.transform("v.counts", lambda x: x.cast("string")), ",").alias("counts"), F.col("v.first").alias("first"))


#: Thresholds and weights of the matcher for English words, on which its decisions depend.
RULES = {
    "min_len": 0, "margin_hard": 1, "margin_soft": 2, "word": True, "first": 0.0, "share": 3.0, "first_tight": 0.2, "share_tight": 1.5,
    "bands": [(2, 0.0), (3, 1.05), (4, 2.1), (5, 1.95), (6, 1.9), (7, 1.85), (8, 3.35), (9, 3.25), (99, 1.45)],
    "bands_tight": [(2, 0.0), (3, 1.75), (4, 0.85), (5, 0.7), (6, 1.25), (7, 1.15), (8, 1.65), (99, 1.4)],
    "weights": {"sub": 1.8, "adjSub": 1.35, "transpose": 1.0, "ins": 1.1296, "del": 0.3, "doubleLetter": 0.3, "materVI": 0.3821, "homophone": 1.7916},
    "weights_tight": {"sub": 2.4, "adjSub": 99.0, "transpose": 0.1, "ins": 0.8, "del": 1.8, "doubleLetter": 0.45, "materVI": 99.0, "homophone": 99.0},
}


@query()
def near_match(s, d):
    """Decision, reason and distance of every answer. No SQL: the alignments have none; a test holds it against brute force."""
    a = answers(s, d).select("id", F.lower("typed").alias("typed"), F.col("term").alias("owner"), F.array("term").alias("candidates"))
    p = table(s, d, "part").select(F.col("p_name").alias("form"), F.col("p_name").alias("owner")).distinct()
    lexicon = p.select(F.explode(F.split("form", " ")).alias("word")).distinct()
    return fuzzy.near_match(a, p, lexicon, RULES)


@query()
def osa_distances(s, d):
    """Swap-aware distances of near name pairs. No SQL: DuckDB has the unrestricted variant only; tested by brute force."""
    words = table(s, d, "part").select(F.col("p_name").alias("w")).distinct()
    return matching.levenshtein_pairs(words, "w", 2).withColumn("osa", fuzzy.osa(F.col("a"), F.col("b")))


_EVERY_FORM = "f AS (SELECT DISTINCT p_name AS form, p_brand AS owner FROM part)"


@query(f"""WITH {_EVERY_FORM}, g AS (SELECT a.form, a.owner, b.form AS other_form, b.owner AS other, levenshtein(a.form, b.form) AS raw FROM (SELECT DISTINCT form, min(owner) AS owner FROM f GROUP BY 1) a JOIN (SELECT DISTINCT form, min(owner) AS owner FROM f GROUP BY 1) b ON a.form <> b.form WHERE levenshtein(a.form, b.form) <= 2)
SELECT CASE WHEN owner = other THEN 'allowed' WHEN split_part(form, ' ', 1) = split_part(other_form, ' ', 1) THEN 'same word' ELSE 'collision' END AS class, count(*) AS n, min(form) AS first FROM g GROUP BY 1""")
def collision_sweep(s, d):
    forms = table(s, d, "part").groupBy(F.col("p_name").alias("form")).agg(F.min("p_brand").alias("owner"))
    pairs = fuzzy.near_words(forms, "form", forms).filter("word <> form").join(forms.select(F.col("form").alias("word"), F.col("owner").alias("own")), "word")
    head = lambda c: F.substring_index(c, " ", 1)
    kind = F.when(F.col("own") == F.col("owner"), "allowed").when(head("word") == head("form"), "same word").otherwise("collision")
    return pairs.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.min("word").alias("first"))


@query("""WITH c AS (SELECT DISTINCT p_name, replace(replace(p_name, 'red', 'hot'), 'blue', 'cold') AS canon FROM part) SELECT a.p_name AS a, b.p_name AS b FROM c a JOIN c b USING (canon) WHERE a.p_name < b.p_name""")
def skeleton_family(s, d):
    canon = F.replace(F.replace("p_name", F.lit("red"), F.lit("hot")), F.lit("blue"), F.lit("cold"))
    c = table(s, d, "part").select("p_name", canon.alias("canon")).distinct()
    return c.select(F.col("p_name").alias("a"), "canon").join(c.select(F.col("p_name").alias("b"), "canon"), "canon").filter("a < b").select("a", "b")


@query("""WITH f AS (SELECT p_name || ' ' || p_size AS form, p_brand AS owner, p_type AS kind FROM part) SELECT DISTINCT a.form, a.owner FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.form = a.form AND b.owner <> a.owner AND b.kind <> 'ECONOMY')""")
def own_forms_only(s, d):
    f = table(s, d, "part").select(F.concat_ws(" ", "p_name", "p_size").alias("form"), F.col("p_brand").alias("owner"), F.col("p_type").alias("kind"))
    # another owner holds the form if it has two such owners, or one that isn't this
    g = f.filter("kind <> 'ECONOMY'").groupBy("form").agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("one"))
    return f.select("form", "owner").distinct().join(g, "form", "left").filter(F.col("n").isNull() | ((F.col("n") == 1) & (F.col("one") == F.col("owner")))).select("form", "owner")


@query("""WITH r AS (SELECT lang, least(n_chars // 400, 5) AS band, n_chars % 400 / 100 AS cost, quality = 1 AS good FROM documents JOIN labels USING (doc_id)), n AS (SELECT lang, band, min(cost) FILTER (NOT good) AS bad, max(cost) FILTER (good) AS top FROM r GROUP BY 1, 2),
t AS (SELECT lang, band, bad, round(floor((coalesce(bad, 99) - 1e-9) / 0.05) * 0.05, 6) AS snapped FROM n)
SELECT lang, band, round(CASE WHEN max(cost) FILTER (good AND cost <= snapped) IS NULL THEN 0 ELSE ceil(max(cost) FILTER (good AND cost <= snapped) / 0.05 - 1e-9) * 0.05 END, 6) AS threshold, count(*) FILTER (good AND cost <= snapped) AS tp, count(*) FILTER (good) AS positives, count(*) FILTER (NOT good AND cost <= snapped) AS fa
FROM r JOIN t USING (lang, band) GROUP BY 1, 2""")
def snapped_thresholds(s, d):
    rows = table(s, d, "documents").select("doc_id", "lang", "n_chars").join(table(s, d, "labels"), "doc_id")
    rows = rows.select("lang", F.least(F.floor(F.col("n_chars") / 400), F.lit(5).cast("long")).alias("band"), (F.col("n_chars") % 400 / 100).alias("cost"), (F.col("quality") == 1).alias("good"))
    cut = rows.groupBy("lang", "band").agg(F.round(S.snapped_below(F.coalesce(F.min(F.when(~F.col("good"), F.col("cost"))), F.lit(99.0))), 6).alias("snapped"))
    taken = F.col("cost") <= F.col("snapped")
    top = F.max(F.when(F.col("good") & taken, F.col("cost")))
    return rows.join(F.broadcast(cut), ["lang", "band"]).groupBy("lang", "band").agg(F.round(F.coalesce(F.ceil(top / 0.05 - 1e-9) * 0.05, F.lit(0.0)), 6).alias("threshold"), F.count_if(F.col("good") & taken).alias("tp"), F.count_if("good").alias("positives"), F.count_if(~F.col("good") & taken).alias("fa"))


@query("""WITH r AS (SELECT lang, n_chars AS cost, quality = 1 AS good, doc_id % 5 AS fold FROM documents JOIN labels USING (doc_id)), b AS (SELECT unnest([0, 1, 3, 7]) AS budget), n AS (SELECT fold, cost, row_number() OVER (PARTITION BY fold ORDER BY cost, doc_id) AS k FROM (SELECT doc_id, doc_id % 5 AS fold, n_chars AS cost FROM documents JOIN labels USING (doc_id) WHERE quality <> 1)),
t AS (SELECT f.fold, b.budget, min(n.cost) AS bad FROM (SELECT DISTINCT fold FROM r) f CROSS JOIN b LEFT JOIN n ON n.fold = f.fold AND n.k = b.budget + 1 GROUP BY 1, 2)
SELECT budget, round(avg(recall), 6) AS recall FROM (SELECT t.fold, budget, count(*) FILTER (good AND (bad IS NULL OR cost < bad)) / count(*) FILTER (good) AS recall FROM r JOIN t USING (fold) GROUP BY 1, 2) GROUP BY 1""")
def budget_sweep(s, d):
    from wordloom.operators.dedup import last_n

    rows = table(s, d, "documents").select("doc_id", F.col("n_chars").alias("cost")).join(table(s, d, "labels"), "doc_id").select("doc_id", "cost", (F.col("quality") == 1).alias("good"), (F.col("doc_id") % 5).alias("fold"))
    bad = last_n(rows.filter("NOT good"), ["fold"], 8, F.col("cost"), F.col("doc_id")).select("fold", (F.col("rn") - 1).alias("budget"), F.col("cost").alias("bad"))
    grid = rows.select("fold").distinct().withColumn("budget", F.explode(F.array(*map(F.lit, (0, 1, 3, 7)))))
    grid = grid.join(bad, ["fold", "budget"], "left")
    ok = F.col("good") & (F.col("bad").isNull() | (F.col("cost") < F.col("bad")))
    per = rows.join(F.broadcast(grid), "fold").groupBy("fold", "budget").agg((F.count_if(ok) / F.count_if("good")).alias("r"))
    return per.groupBy("budget").agg(F.round(F.avg("r"), 6).alias("recall"))


@query("""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM benchmark), q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM documents)
SELECT count(*) AS asked, count(v.w) AS known, (SELECT ceil(-(count(*) * ln(0.01)) / (ln(2) * ln(2)))::BIGINT FROM v) AS bits FROM q LEFT JOIN v USING (w)""")
def lexicon_membership(s, d):
    words = lambda name: table(s, d, name).select(F.explode(T.tokens(F.col("text"))).alias("w")).distinct()
    v = words("benchmark")
    bits = v.agg(F.ceil(-(F.count("*") * F.log(F.lit(0.01))) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0)))).alias("bits"))
    return words("documents").join(v.withColumn("k", F.lit(1)), "w", "left").agg(F.count("*").alias("asked"), F.count("k").alias("known")).join(F.broadcast(bits))
