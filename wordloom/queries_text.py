"""Queries of scalar functions, predicates and text rules over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import scalars as S
from wordloom.functions import text as T
from wordloom.operators import lint, sampling
from wordloom.registry import query
from wordloom.sources.files import table

WORDS_SQL = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
_NAME_WORDS = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part"


def name_words(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()


# ---- keys


@query(r"""SELECT doc_id, md5(translate(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x{0591}-\x{05BD}\x{05BF}-\x{05C7}\x{200E}\x{200F}]', '', 'g'),
'[-–—/|־]', ' ', 'g'), '["''`׳״.,;:!?()\[\]{}]', '', 'g'), '[ \t\n\r]+', ' ', 'g')), 'ךםןףץ', 'כמנפצ')) AS key_md5 FROM documents""")
def norm_key_pointed(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(S.pointed_key(F.col("text"))).alias("key_md5"))


@query(r"""SELECT doc_id, md5(lower(regexp_replace(trim(regexp_replace(regexp_replace(coalesce(text, ''), '\([^)]*\)', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')), '[.,;:!? ]+$', ''))) AS key_md5 FROM documents""")
def gloss_key(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(T.gloss_key(F.col("text"))).alias("key_md5"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '([a-z0-9])[''"]([a-z0-9])', '\1\2', 'g'), '[^a-z0-9]+', ' ', 'g'))) AS canon_md5 FROM documents""")
def canonical_text(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(S.canonical(F.col("text"))).alias("canon_md5"))


@query(f"""WITH w AS (SELECT item_id, list_filter({WORDS_SQL.format('text')}, lambda x: x NOT IN ('the', 'of', 'and', 'a', 'in')) AS w FROM benchmark)
SELECT item_id, md5(array_to_string(list_sort([x[1 + greatest(least(length(regexp_extract(x, '^[btlm]+')), length(x) - 3), 0):] FOR x IN w]), ' ')) AS root_md5 FROM w""")
def sorted_root_bag(s, d):
    return table(s, d, "benchmark").select("item_id", F.md5(S.root_key(T.tokens(F.col("text")), ("the", "of", "and", "a", "in"), "btlm")).alias("root_md5"))


@query(f"""WITH w AS ({_NAME_WORDS}) SELECT w, array_to_string(list_sort(list_distinct([substr(w, 1 + length(p), length(w) - length(p) - length(s)) FOR p IN ['', 're', 'un', 'w'] FOR s IN ['', 's', 'ed', 'et', 't']
IF starts_with(w, p) AND ends_with(w, s) AND length(w) - length(p) - length(s) >= 3])), '|') AS stems FROM w""".replace("[substr(w, 1 + length(p), length(w) - length(p) - length(s)) FOR p IN ['', 're', 'un', 'w'] FOR s IN ['', 's', 'ed', 'et', 't']\nIF starts_with(w, p) AND ends_with(w, s) AND length(w) - length(p) - length(s) >= 3]", "flatten([[substr(w, 1 + length(p), length(w) - length(p) - length(s)) FOR s IN ['', 's', 'ed', 'et', 't'] IF starts_with(w, p) AND ends_with(w, s) AND length(w) - length(p) - length(s) >= 3] FOR p IN ['', 're', 'un', 'w']])"))
def affix_stems(s, d):
    return name_words(s, d).select("w", F.array_join(S.peeled(F.col("w"), ["", "re", "un", "w"], ["", "s", "ed", "et", "t"]), "|").alias("stems"))


# ---- meanings

_MEANING = "p_type || ', ' || p_brand || ' (size ' || p_size || '); also: ' || p_name || ' - ' || lower(p_type)"
_SEGS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '\([^)]*\)', ' ', 'g'), '[,;/|:]|\s-\s'), lambda x: trim(x)), lambda x: x <> '' AND x <> 'also')"


def meaning() -> F.Column:
    return F.concat("p_type", F.lit(", "), "p_brand", F.lit(" (size "), F.col("p_size").cast("string"), F.lit("); also: "), "p_name", F.lit(" - "), F.lower("p_type"))


@query(f"SELECT p_partkey, array_to_string({_SEGS.format(_MEANING)}, '|') AS senses, array_to_string(list_filter({_SEGS.format(_MEANING)}, lambda x: x <> p_brand)[1:2], '|') AS others FROM part")
def meaning_senses(s, d):
    parts = S.senses(meaning(), ("also",))
    return table(s, d, "part", deal=True).select("p_partkey", F.array_join(parts, "|").alias("senses"), F.array_join(S.other_senses(parts, F.col("p_brand"), 2), "|").alias("others"))


@query(f"""WITH s AS (SELECT p_partkey, {_SEGS.format(_MEANING)} AS p FROM part), r AS (SELECT p_partkey, p, unnest(flatten([[array_to_string(p[i:i + k], ' ') FOR k IN range(1, least(len(p), 5) - i + 1)] FOR i IN range(1, least(len(p), 5) + 1)])) AS x FROM s)
SELECT p_partkey, count(*) AS runs, max(x) AS last FROM r WHERE x <> array_to_string(p, ' ') GROUP BY p_partkey""")
def joined_sense_runs(s, d):
    runs = table(s, d, "part", deal=True).select("p_partkey", S.bound(S.joined_senses(S.senses(meaning(), ("also",))), lambda x: F.struct(F.size(x).alias("n"), F.array_max(x).alias("last"))).alias("r"))
    return runs.groupBy("p_partkey").agg(F.sum("r.n").alias("runs"), F.max("r.last").alias("last")).filter("runs > 0")


@query("""SELECT p_partkey, array_to_string([CASE x WHEN 'small' THEN 'tiny' WHEN 'little' THEN 'tiny' WHEN 'large' THEN 'big' ELSE x END FOR x IN string_split(p_name, ' ')], ' ') AS canon FROM part""")
def synonym_canon(s, d):
    return table(s, d, "part").select("p_partkey", S.replaced_words(F.col("p_name"), {"small": "tiny", "little": "tiny", "large": "big"}).alias("canon"))


# ---- two strings


@query("""WITH n AS (SELECT DISTINCT p_name AS a, lower(p_type) AS b FROM part)
SELECT a, b, len([i FOR i IN range(1, least(length(a), length(b)) + 1) IF a[1:i] = b[1:i]]) AS prefix,
round(list_sum([least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, ''))) FOR c IN list_distinct(string_split(a, ''))]) / greatest(length(a), length(b)), 6) AS shared FROM n""")
def prefix_and_shared_letters(s, d):
    n = table(s, d, "part").select(F.col("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return n.select("a", "b", S.common_prefix(F.col("a"), F.col("b")).alias("prefix"), F.round(S.shared_letters(F.col("a"), F.col("b")), 6).alias("shared"))


_DOC_WORDS = f"SELECT DISTINCT unnest({WORDS_SQL.format('text')}) AS w FROM documents"


def doc_words(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("w")).distinct()


@query(f"WITH v AS MATERIALIZED ({_DOC_WORDS}), x AS MATERIALIZED (SELECT w, suffix, w || suffix AS grown FROM (SELECT w, unnest(['s', 'es', 'ed', 'ing', 'ly']) AS suffix FROM v)) SELECT x.w AS word, suffix, v.w AS inflected FROM x JOIN v ON v.w = x.grown")
def morph_pairs(s, d):
    v = doc_words(s, d)
    grown = v.select(F.col("w").alias("word"), F.explode(S.strings("s", "es", "ed", "ing", "ly")).alias("suffix")).withColumn("inflected", F.concat("word", "suffix"))
    return grown.join(v.select(F.col("w").alias("inflected")), "inflected").select("word", "suffix", "inflected")


@query("""WITH p AS (SELECT o_orderkey, lag(o_orderpriority) OVER w AS a, o_orderpriority AS b, o_custkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), x AS (SELECT o_orderkey, string_split(a, '') AS a, string_split(b, '') AS b FROM p WHERE a IS NOT NULL)
SELECT o_orderkey, CASE WHEN len(a) = len(b) AND len([i FOR i IN range(1, len(a) + 1) IF a[i] <> b[i]]) = 1 THEN [i FOR i IN range(1, len(a) + 1) IF a[i] <> b[i]][1] END AS at FROM x""")
def word_diff(s, d):
    from pyspark.sql import Window

    o = table(s, d, "orders").select("o_orderkey", F.lag("o_orderpriority").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("a"), F.col("o_orderpriority").alias("b")).filter("a IS NOT NULL")
    return o.select("o_orderkey", S.single_difference(S.chars(F.col("a")), S.chars(F.col("b"))).cast("long").alias("at"))


@query(f"""WITH w AS (SELECT unnest([w, w || 'er', w || 'est']) AS w FROM ({_NAME_WORDS})) SELECT a.w AS a, b.w AS b FROM w a CROSS JOIN w b WHERE a.w < b.w AND ((a.w = 'big' AND b.w = 'large') OR (a.w[1:3] = b.w[1:3] AND length(a.w) >= 3 AND length(b.w) >= 3 AND abs(length(a.w) - length(b.w)) <= 3))""")
def soft_token_match(s, d):
    w = name_words(s, d).select(F.explode(F.array("w", F.concat("w", F.lit("er")), F.concat("w", F.lit("est")))).alias("w")).withColumn("k", F.left("w", F.lit(3)))
    same = w.select(F.col("w").alias("a"), "k").join(w.select(F.col("w").alias("b"), "k"), "k").filter("a < b")
    return same.filter(S.soft_match(F.col("a"), F.col("b"), {"big": "large"})).select("a", "b")


@query(f"""WITH u AS (SELECT conv_id, turn, {WORDS_SQL.format('text')} AS a, lead({WORDS_SQL.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn, round(len(b) / len(a), 6) AS ratio, len(list_filter(list_distinct(a), lambda x: length(x) > 3 AND NOT list_contains(b, x))) AS missing FROM u WHERE b IS NOT NULL AND len(a) > 0""")
def omitted_words(s, d):
    from pyspark.sql import Window

    c = table(s, d, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("a"))
    c = c.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).filter(F.col("b").isNotNull() & (F.size("a") > 0))
    return c.select("conv_id", "turn", F.round(F.size("b") / F.size("a"), 6).alias("ratio"), F.size(F.filter(F.array_except("a", "b"), lambda x: F.length(x) > 3)).cast("long").alias("missing"))


# ---- wrong spellings

_ADJ = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in S.KEY_NEIGHBOURS.items()) + "}"


@query(f"""WITH w AS ({_NAME_WORDS}), v AS (
SELECT w, 'drop' AS op, unnest(list_distinct([w[:i - 1] || w[i + 1:] FOR i IN range(1, length(w) + 1)])) AS v FROM w
UNION ALL SELECT w, 'swap', unnest(list_filter(list_distinct([w[:i - 1] || w[i + 1] || w[i] || w[i + 2:] FOR i IN range(1, length(w))]), lambda x: x <> w)) FROM w
UNION ALL SELECT w, 'double', unnest(list_distinct([w[:i] || w[i:] FOR i IN range(1, length(w) + 1)])) FROM w
UNION ALL SELECT w, 'neighbour', unnest(flatten([[w[:i - 1] || c || w[i + 1:] FOR c IN string_split({_ADJ}[w[i]], '')] FOR i IN range(1, length(w) + 1)])) FROM w)
SELECT op, w, count(*) AS variants, md5(string_agg(v, ',' ORDER BY v)) AS all_md5 FROM v GROUP BY 1, 2""")
def typo_variants(s, d):
    w = F.col("w")
    ops = F.array(*[F.struct(F.lit(n).alias("op"), f(w).alias("vs")) for n, f in (("drop", S.dropped), ("swap", S.swapped), ("double", S.doubled), ("neighbour", S.neighbour_typed))])
    found = name_words(s, d).select("w", F.inline(ops))
    return found.filter(F.size("vs") > 0).select("op", "w", F.size("vs").cast("long").alias("variants"), F.md5(F.array_join(F.array_sort("vs"), ",")).alias("all_md5"))


@query(f"""WITH w AS ({_NAME_WORDS}), l AS (SELECT string_split('{S.LETTERS}', '') AS abc), b AS (SELECT w, unnest(
[w[:i - 1] || w[i + 1:] FOR i IN range(1, length(w) + 1)] || [w[:i - 1] || w[i + 1] || w[i] || w[i + 2:] FOR i IN range(1, length(w))]
|| flatten([[w[:i - 1] || c || w[i + 1:] FOR c IN abc] FOR i IN range(1, length(w) + 1)]) || flatten([[w[:i - 1] || c || w[i:] FOR c IN abc] FOR i IN range(1, length(w) + 2)])) AS v FROM w, l)
SELECT w, count(DISTINCT v) AS size, md5(string_agg(DISTINCT v, ',' ORDER BY v)) AS ball_md5 FROM b WHERE v <> w GROUP BY w""")
def edit_ball_one(s, d):
    ball = S.edit_ball(F.col("w"))
    return name_words(s, d).select("w", F.size(ball).cast("long").alias("size"), F.md5(F.array_join(ball, ",")).alias("ball_md5"))


@query(f"""WITH w AS ({_NAME_WORDS}), l AS (SELECT string_split('{S.LETTERS}', '') AS abc), v AS ({_DOC_WORDS}), b AS (SELECT DISTINCT w, unnest(
[w[:i - 1] || w[i + 1:] FOR i IN range(1, length(w) + 1)] || [w[:i - 1] || w[i + 1] || w[i] || w[i + 2:] FOR i IN range(1, length(w))]
|| flatten([[w[:i - 1] || c || w[i + 1:] FOR c IN abc] FOR i IN range(1, length(w) + 1)]) || flatten([[w[:i - 1] || c || w[i:] FOR c IN abc] FOR i IN range(1, length(w) + 2)])) AS x FROM w, l)
SELECT b.w, count(*) AS universe, count(v.w) AS known, count(n.w) AS own FROM b LEFT JOIN v ON v.w = x LEFT JOIN w n ON n.w = x WHERE x <> b.w GROUP BY b.w""")
def distance_one_universe(s, d):
    own = name_words(s, d)
    ball = own.select(F.col("w"), F.explode(S.edit_ball(F.col("w"))).alias("x"))
    known = ball.join(doc_words(s, d).select(F.col("w").alias("x"), F.lit(1).alias("k")), "x", "left").join(own.select(F.col("w").alias("x"), F.lit(1).alias("o")), "x", "left")
    return known.groupBy("w").agg(F.count("*").alias("universe"), F.count("k").alias("known"), F.count("o").alias("own"))


# ---- markup and masks


@query("SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped_md5 FROM pages")
def markup_escape(s, d):
    return table(s, d, "pages").select("page_id", F.md5(S.escaped(F.col("html"))).alias("escaped_md5"))


@query(r"""WITH x AS (SELECT doc_id, 'a {{b|{{c}} d}} [[e|f]] ''''g'''' [[h]] ' || coalesce(text, '') AS t FROM documents), y AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\{\{[^{}]*\}\}', '', 'g'), '\{\{[^{}]*\}\}', '', 'g'), '\{\{[^{}]*\}\}', '', 'g'), '\{\{[^{}]*\}\}', '', 'g') AS t FROM x)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '<ref[^>]*>[^<]*</ref>', '', 'g'), '\[\[[^\[\]|]*\|([^\[\]]*)\]\]', '\1', 'g'), '\[\[([^\[\]]*)\]\]', '\1', 'g'), '''{2,}', '', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS text_md5 FROM y""")
def wiki_clean(s, d):
    t = F.concat(F.lit("a {{b|{{c}} d}} [[e|f]] ''g'' [[h]] "), F.coalesce("text", F.lit("")))
    return table(s, d, "documents").select("doc_id", F.md5(S.wiki_text(t)).alias("text_md5"))


@query(r"SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<b>([^<]*)', 1), lambda x: trim(x)), '|') AS bold FROM pages")
def bold_spans(s, d):
    return table(s, d, "pages").select("page_id", F.array_join(F.transform(F.regexp_extract_all("html", F.lit("<b>([^<]*)"), F.lit(1)), lambda x: F.trim(x)), "|").alias("bold"))


@query("SELECT c_custkey, substr(c_name || '@' || c_mktsegment, 1, 3) || '***@' || c_mktsegment AS masked FROM customer")
def mail_mask(s, d):
    return table(s, d, "customer").select("c_custkey", S.masked_mail(F.concat("c_name", F.lit("@"), "c_mktsegment")).alias("masked"))


# ---- predicates


@query(f"WITH w AS (SELECT item_id, {WORDS_SQL.format('text')} AS w FROM benchmark) SELECT item_id, len(w) > 0 AND len(list_filter(w, lambda x: x NOT IN ('the', 'of', 'and', 'is'))) = 0 AS stopped FROM w")
def stopped_phrases(s, d):
    w = T.tokens(F.col("text"))
    return table(s, d, "benchmark").select("item_id", ((F.size(w) > 0) & F.forall(w, lambda x: x.isin("the", "of", "and", "is"))).alias("stopped"))


@query(r"""SELECT doc_id, regexp_matches(text, '[a-zA-Z]') AS latin, regexp_matches(text, '<[a-zA-Z/]') AS html, regexp_matches(text, '[\x{0591}-\x{05C7}]') AS points, regexp_matches(text, '(^|[ \n])[aA] [aeiou]|(^|[ \n])[aA]n [b-df-hj-np-tv-z]') AS article FROM documents""")
def contamination_tests(s, d):
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", t.rlike("[a-zA-Z]").alias("latin"), t.rlike("<[a-zA-Z/]").alias("html"), t.rlike("[֑-ׇ]").alias("points"), t.rlike(r"(^|[ \n])[aA] [aeiou]|(^|[ \n])[aA]n [b-df-hj-np-tv-z]").alias("article"))


@query(r"SELECT p_partkey, length(regexp_replace(p_name, '[^a-z]', '', 'g')) >= 8 AND NOT contains(p_name, 'gadget') AND regexp_matches(p_type, '^[A-Z]+$') AS testable FROM part")
def testable_items(s, d):
    return table(s, d, "part").select("p_partkey", ((F.length(F.regexp_replace("p_name", "[^a-z]", "")) >= 8) & ~F.contains("p_name", F.lit("gadget")) & F.col("p_type").rlike("^[A-Z]+$")).alias("testable"))


@query("""SELECT event_id, list_contains([1, 2, 3], k) AS known, k BETWEEN 0 AND 50 AND len(o) = 3 AND len(list_filter(o, lambda x: x >= 0)) = 3 AS valid FROM (SELECT event_id, (props->>'$.k')::INT AS k, [(props->>'$.k')::INT, event_id, user_id] AS o FROM events)""")
def item_validator(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    o = F.array(k.cast("long"), "event_id", "user_id")
    return table(s, d, "events").select("event_id", k.isin(1, 2, 3).alias("known"), (k.between(0, 50) & (F.size(o) == 3) & F.forall(o, lambda x: x >= 0)).alias("valid"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN true WHEN c_mktsegment = 'MACHINERY' AND last + INTERVAL 3 DAY >= TIMESTAMP '2000-01-01' THEN true WHEN c_mktsegment = 'BUILDING' THEN last >= TIMESTAMP '1999-06-01' ELSE false END AS access,
CASE WHEN last IS NULL THEN NULL WHEN last >= TIMESTAMP '2000-01-01' THEN true WHEN c_acctbal < 0 THEN false END AS verdict FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def access_states(s, d):
    last = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    c = table(s, d, "customer").join(last, "c_custkey", "left")
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    seg = F.col("c_mktsegment")
    access = F.when(seg == "FURNITURE", True).when((seg == "MACHINERY") & (F.col("last") + F.expr("INTERVAL 3 DAYS") >= day("2000-01-01")), True).when(seg == "BUILDING", F.col("last") >= day("1999-06-01")).otherwise(False)
    verdict = F.when(F.col("last").isNull(), F.lit(None).cast("boolean")).when(F.col("last") >= day("2000-01-01"), True).when(F.col("c_acctbal") < 0, False)
    return c.select("c_custkey", access.alias("access"), verdict.alias("verdict"))


@query("""WITH a AS (SELECT 'short' AS kind, 'Brand#13' AS word UNION ALL SELECT 'cheap', 'Brand#5'), f AS (SELECT p_partkey, p_brand AS word, unnest(CASE WHEN p_size < 10 THEN ['short'] ELSE [] END || CASE WHEN p_retailprice < 1000 THEN ['cheap'] ELSE [] END) AS kind FROM part)
SELECT p_partkey, kind FROM f ANTI JOIN a USING (kind, word)""")
def allow_list_suppression(s, d):
    found = lint.broken_rules(table(s, d, "part").withColumn("id", F.struct("p_partkey", "p_brand")), "id", {"short": F.col("p_size") < 10, "cheap": F.col("p_retailprice") < 1000})
    allowed = s.createDataFrame([("short", "Brand#13"), ("cheap", "Brand#5")], "kind string, word string")
    return found.select("id.p_partkey", F.col("rule").alias("kind"), F.col("id.p_brand").alias("word")).join(F.broadcast(allowed), ["kind", "word"], "left_anti").select("p_partkey", "kind")


@query("""SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01') OR contains(lower(c_mktsegment), 'mach')""")
def admin_filter(s, d):
    active = table(s, d, "orders").filter(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("active")).distinct()
    c = table(s, d, "customer").join(active, "c_custkey", "left")
    return c.filter((F.contains(F.lower("c_name"), F.lit("00")) & F.col("active").isNull()) | F.contains(F.lower("c_mktsegment"), F.lit("mach"))).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ol') OR contains(lower(p_type), 'ol')")
def term_search(s, d):
    return table(s, d, "part").filter(F.contains(F.lower("p_name"), F.lit("ol")) | F.contains(F.lower("p_type"), F.lit("ol"))).select("p_partkey")


@query(r"""SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z]+), ([a-z]+)', 1)) AS a, unnest(regexp_extract_all(text, '([A-Za-z]+), ([a-z]+)', 2)) AS b FROM documents""")
def pair_extract(s, d):
    p = F.lit("([A-Za-z]+), ([a-z]+)")
    pairs = F.arrays_zip(F.regexp_extract_all("text", p, F.lit(1)).alias("a"), F.regexp_extract_all("text", p, F.lit(2)).alias("b"))
    return table(s, d, "documents").select("doc_id", F.inline(pairs))


@query("""SELECT c_custkey, CASE coalesce(n, 0) WHEN 0 THEN 'no orders' WHEN 1 THEN 'one order' WHEN 2 THEN 'two orders' ELSE n || ' orders' END AS label FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def plural_labels(s, d):
    n = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    k = F.coalesce("n", F.lit(0))
    label = F.when(k == 0, "no orders").when(k == 1, "one order").when(k == 2, "two orders").otherwise(F.concat(k.cast("string"), F.lit(" orders")))
    return table(s, d, "customer").join(n, "c_custkey", "left").select("c_custkey", label.alias("label"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'act' WHEN 'purchase' THEN 'act' WHEN 'error' THEN 'fail' ELSE 'other' END AS logic FROM events")
def connector_category(s, d):
    m = S.lit_map({"click": "act", "purchase": "act", "error": "fail"})
    return table(s, d, "events").select("event_id", F.coalesce(F.try_element_at(m, F.col("event_type")), F.lit("other")).alias("logic"))


# ---- dates


@query("""WITH t AS (SELECT max(o_orderdate) AS now FROM orders)
SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS epoch_day, date_diff('day', o_orderdate::DATE, now::DATE) AS days_left,
CASE WHEN date_diff('day', o_orderdate::DATE, now::DATE) <= 1 THEN 1 WHEN date_diff('day', o_orderdate::DATE, now::DATE) <= 7 THEN 7 WHEN date_diff('day', o_orderdate::DATE, now::DATE) <= 14 THEN 14 WHEN date_diff('day', o_orderdate::DATE, now::DATE) <= 31 THEN 31 END AS milestone,
o_orderdate + INTERVAL 3 DAY >= now AS in_grace FROM orders, t""")
def calendar_marks(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderdate")
    o = o.join(F.broadcast(o.agg(F.max("o_orderdate").alias("now"))))
    left = F.datediff("now", "o_orderdate")
    milestone = F.when(left <= 1, 1).when(left <= 7, 7).when(left <= 14, 14).when(left <= 31, 31)
    return o.select("o_orderkey", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long").alias("epoch_day"), left.cast("long").alias("days_left"), milestone.alias("milestone"), (F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS") >= F.col("now")).alias("in_grace"))


@query("""WITH e AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, floor((epoch_us(ts) - epoch_us(before)) / 86400000000)::BIGINT AS days, coalesce(ts::DATE = before::DATE, false) AS same_day, strftime(ts, '%Y-%m-%d') AS day FROM e""")
def day_arithmetic(s, d):
    from pyspark.sql import Window

    e = table(s, d, "events").select("event_id", "ts", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))
    at = lambda c: F.col(c).cast("timestamp")
    return e.select("event_id", S.days_since(at("ts"), at("before")).alias("days"), F.coalesce(F.to_date("ts") == F.to_date("before"), F.lit(False)).alias("same_day"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("""SELECT event_id, epoch_us(ts) AS micros FROM events""")
def tolerant_iso(s, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 2 == 0, "123Z").otherwise("Z"))
    return table(s, d, "events").select("event_id", F.unix_micros(S.parsed_instant(text)).alias("micros"))


# ---- numbers, arrays, maps, JSON


@query("""SELECT c_custkey, greatest(least(trunc(c_acctbal), 500), 0)::BIGINT AS capped, floor(c_custkey * 100 / n + 0.5)::BIGINT AS pct, round(floor((c_acctbal / 10000 - 1e-9) / 0.05) * 0.05, 6) AS snapped FROM customer, (SELECT count(*) AS n FROM customer)""")
def clamp_round_snap(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_acctbal")
    c = c.join(F.broadcast(c.agg(F.count("*").alias("n"))))
    return c.select("c_custkey", S.clamped(F.col("c_acctbal").cast("string"), 500).alias("capped"), S.percent(F.col("c_custkey"), F.col("n")).alias("pct"), F.round(S.snapped_below(F.col("c_acctbal") / 10000), 6).alias("snapped"))


@query("""SELECT vec_id, round(list_sum([a::DOUBLE * b::DOUBLE FOR a, b IN list_zip(embedding, embedding)]), 4) AS norm2, round(list_sum([embedding[i]::DOUBLE * i FOR i IN range(1, len(embedding) + 1)]), 4) AS weighted FROM embeddings""".replace("[a::DOUBLE * b::DOUBLE FOR a, b IN list_zip(embedding, embedding)]", "[a::DOUBLE * a::DOUBLE FOR a IN embedding]"))
def dot_products(s, d):
    e = F.col("embedding")
    weights = F.transform(F.sequence(F.lit(1), F.size(e)), lambda i: i.cast("double"))
    return table(s, d, "embeddings").select("vec_id", F.round(S.dot(e, e), 4).alias("norm2"), F.round(S.dot(e, weights), 4).alias("weighted"))


@query("""WITH g AS (SELECT l_orderkey, list(DISTINCT [l_quantity, l_discount * 100, l_tax * 100]) AS vs FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(list_filter(vs, lambda v: len(list_filter(vs, lambda u: u[1] <= v[1] AND u[2] <= v[2] AND u[3] <= v[3] AND (u[1] < v[1] OR u[2] < v[2] OR u[3] < v[3]))) = 0)) AS kept, len(vs) AS vectors FROM g""")
def pareto_skyline(s, d):
    # an order has a bounded number of lines, so its vectors fit one row
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100)).alias("vs"))
    return g.select("l_orderkey", F.size(S.skyline(F.col("vs"))).cast("long").alias("kept"), F.size("vs").cast("long").alias("vectors"))


@query("""SELECT p_partkey, 'The ' || split_part(p_name, ' ', 1) || ' thing is a ' || split_part(p_name, ' ', 2) || '.' AS sentence, split_part(p_name, ' ', 2) || '|' || split_part(p_name, ' ', 1) AS turned FROM part""")
def blank_fill_and_permute(s, d):
    words = F.split("p_name", " ")
    return table(s, d, "part").select("p_partkey", S.filled(F.lit("The ____ thing is a ____."), words).alias("sentence"), F.array_join(S.permuted(words, F.array(F.lit(2), F.lit(1))), "|").alias("turned"))


@query("""WITH m AS (SELECT user_id, event_type AS k, max(event_id % 100) FILTER (event_id % 2 = 0) AS l, max(event_id % 100) FILTER (event_id % 2 = 1) AS r FROM events GROUP BY 1, 2)
SELECT user_id, k, coalesce(l, r) AS v FROM m WHERE coalesce(l, r) IS NOT NULL""")
def map_merge_explode(s, d):
    e = table(s, d, "events")
    side = lambda rest, name: e.filter(F.col("event_id") % 2 == rest).groupBy("user_id", "event_type").agg(F.max(F.col("event_id") % 100).alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias(name))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    both = side(0, "l").join(side(1, "r"), "user_id", "full_outer")
    return both.select("user_id", F.explode(S.merged_maps(F.coalesce("r", none), F.coalesce("l", none))).alias("k", "v"))


@query("""SELECT event_id, coalesce(nullif(json_extract_string(props, '$.name'), ''), nullif(json_extract_string(props, '$.k'), '')) AS k,
CASE event_type WHEN 'purchase' THEN 'active' WHEN 'error' THEN 'past_due' WHEN 'signup' THEN 'trial' END AS status, (round(abs(value) * 100) * CASE WHEN event_type = 'error' THEN -1 ELSE 1 END)::BIGINT AS minor, json_extract_string(props, '$.k')::INT AS inner_k FROM events""")
def billing_normal_form(s, d):
    e = table(s, d, "events")
    status = F.try_element_at(S.lit_map({"purchase": "active", "error": "past_due", "signup": "trial"}), F.col("event_type"))
    minor = (F.round(F.abs("value") * 100) * F.when(F.col("event_type") == "error", -1).otherwise(1)).cast("long")
    twice = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(F.col("props"))
    return e.select("event_id", S.json_first(F.col("props"), "name", "k").alias("k"), status.alias("status"), minor.alias("minor"), F.get_json_object(S.json_unwrapped(twice), "$.k").cast("int").alias("inner_k"))


@query("""SELECT doc_id, CASE WHEN h % 2 = 0 THEN 'A' ELSE 'B' END AS side FROM (SELECT doc_id, ('0x' || substr(md5('coin' || doc_id), 1, 8))::BIGINT AS h FROM documents)""")
def blinded_sides(s, d):
    h = F.conv(F.substring(F.md5(F.concat(F.lit("coin"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long")
    return table(s, d, "documents").select("doc_id", F.when(h % 2 == 0, "A").otherwise("B").alias("side"))


@query("SELECT doc_id FROM (SELECT doc_id, sha256('t5|' || doc_id) AS h FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 60)) ORDER BY h LIMIT 30")
def windowed_sample(s, d):
    return sampling.hash_sample(table(s, d, "documents").select("doc_id").orderBy("doc_id").limit(60), "doc_id", 30, "t5")
