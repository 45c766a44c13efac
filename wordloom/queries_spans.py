"""Queries of word forms, nested markup and spans over texts of the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import morphology as M
from wordloom.functions import text as T
from wordloom.functions.scalars import soft_match
from wordloom.operators import spans
from wordloom.registry import query
from wordloom.sources.files import table


@query("""WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, regexp_extract_all(replace(replace(coalesce(text, ''), 'th', '{{lb|'), 'ing', '}}'), '\\{\\{|\\}\\}|[^{}]+|[{}]') AS ps FROM documents),
r AS (SELECT doc_id, 0 AS i, '' AS plain, []::VARCHAR[] AS stack, []::VARCHAR[] AS labels FROM p
UNION ALL SELECT doc_id, r.i + 1, CASE WHEN len(stack) = 0 AND ps[r.i + 1] <> '{{' THEN plain || ps[r.i + 1] ELSE plain END,
 CASE WHEN ps[r.i + 1] = '{{' THEN stack || [''] WHEN len(stack) = 0 THEN stack WHEN ps[r.i + 1] = '}}' THEN stack[:-2] ELSE stack[:-2] || [stack[-1] || ps[r.i + 1]] END,
 CASE WHEN ps[r.i + 1] = '}}' AND len(stack) > 0 AND regexp_replace(string_split(stack[-1], '|')[1], '^\\s+|\\s+$', '', 'g') = 'lb'
  THEN labels || [array_to_string(list_filter(list_transform(string_split(stack[-1], '|'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' ')] ELSE labels END
 FROM r JOIN p USING (doc_id) WHERE r.i < len(ps))
SELECT doc_id, md5(plain) AS plain_md5, len(labels) AS n_labels, md5(array_to_string(labels, chr(10))) AS labels_md5 FROM r JOIN p USING (doc_id) WHERE i = len(ps)""")
def nested_templates(s, d):
    """Documents with some letters turned into braces: what stands outside templates, and the labels inside."""
    marked = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("th"), F.lit("{{lb|")), F.lit("ing"), F.lit("}}"))
    rows = table(s, d, "documents").select("doc_id", M.without_templates(marked, ("lb",)).alias("r"))
    return rows.select("doc_id", F.md5("r.text").alias("plain_md5"), F.size("r.labels").cast("long").alias("n_labels"), F.md5(F.array_join("r.labels", "\n")).alias("labels_md5"))


#: Letters of the tables' words as Hebrew ones, so that the queries have words of either script.
_LATIN, _SCRIPT = "abcdefghijklmnopqrstuvwxyz", "אבכדהפגחיגקלמנופקרסתויושיז"
_WORD = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


@query(f"""WITH w AS (SELECT DISTINCT unnest({_WORD}) AS term FROM benchmark), m AS (SELECT term, translate(CASE WHEN length(term) % 2 = 0 THEN term ELSE reverse(term) END, '{_LATIN}', '{_SCRIPT}') AS meaning FROM w),
k AS (SELECT term, meaning, translate(translate(regexp_replace(meaning, '[^א-ת]', '', 'g'), '{M.HEARD[0]}', '{M.HEARD[1]}'), 'aeiouhwy', '') AS a, translate(term, 'aeiouhwy', '') AS b FROM m),
h AS (SELECT *, list_reduce([{{'at': 0, 'n': 0, 'x': ''}}] || list_transform(string_split(b, ''), lambda x: {{'at': 0, 'n': 0, 'x': x}}),
  lambda s, e: CASE WHEN e.x <> '' AND instr(substr(a, s.at + 1), e.x) > 0 THEN {{'at': (s.at + instr(substr(a, s.at + 1), e.x))::INTEGER, 'n': s.n + 1, 'x': ''}} ELSE s END).n AS n FROM k)
SELECT term, meaning, length(regexp_replace(meaning, '[^א-ת]', '', 'g')) >= 4 AND a <> '' AND b <> '' AND 10 * n >= 7 * length(b) AS spelt FROM h""")
def transliterated_words(s, d):
    """The benchmark's words against themselves in Hebrew letters, half of them backwards."""
    term = F.col("term")
    words = table(s, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    meaning = F.translate(F.when(F.length(term) % 2 == 0, term).otherwise(F.reverse(term)), _LATIN, _SCRIPT)
    return words.select("term", meaning.alias("meaning")).withColumn("spelt", M.transliterates(F.col("meaning"), term))


def _template_sql() -> str:
    out = []
    for name, *both in M.PATTERN_PAIRS:
        for side, t in zip("ab", both, strict=True):
            pattern, root = M.template_pattern(t)
            out.append(f"SELECT w, '{name}' AS pair, '{side}' AS side, regexp_replace(w, '{pattern}', '{root.replace('$', chr(92))}') AS root FROM words WHERE regexp_matches(w, '{pattern}')")
    return " UNION ALL ".join(out)


@query(f"""WITH words AS (SELECT DISTINCT translate(unnest({_WORD}), '{_LATIN}', '{_SCRIPT}') AS w FROM documents), k AS ({_template_sql()})
SELECT x.pair, x.root, x.w AS a, y.w AS b FROM k x JOIN k y USING (pair, root) WHERE x.side = 'a' AND y.side = 'b' AND x.w <> y.w""")
def template_pairs(s, d):
    """Words of documents, in Hebrew letters, on the two sides of a pair of patterns with one root. A root has a word a side at most."""
    words = table(s, d, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w")).distinct().select(F.translate("w", _LATIN, _SCRIPT).alias("w")).distinct()
    k = words.select("w", F.inline(M.template_keys(F.col("w"))))
    sides = [k.filter(F.col("side") == x).select("pair", "root", F.col("w").alias(x)) for x in "ab"]
    return sides[0].join(sides[1], ["pair", "root"]).filter("a <> b")


def _case(x: str, affixes: tuple[str, ...], front: bool) -> str:
    kept = "substr({x}, {n} + 1)" if front else "left({x}, length({x}) - {n})"
    has = "starts_with" if front else "suffix"
    return "CASE " + " ".join(f"WHEN {has}({x}, '{a}') AND length({x}) >= {len(a)} + 3 THEN {kept.format(x=x, n=len(a))}" for a in affixes) + " END"


_GLOSSES = """items AS MATERIALIZED (SELECT conv_id * 1000 + turn AS id, text, coalesce(w[5], '') || ' ' || coalesce(w[6], '') || 's, ' || coalesce(left(w[9], greatest(length(w[9]) - 1, 0)), '') || '; ' || coalesce(w[2], '') AS gloss
  FROM (SELECT *, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM conversations))"""


@query(f"""WITH {_GLOSSES},
sn AS (SELECT id, unnest(ss) AS t, unnest(range(len(ss))) AS sense FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(gloss, '[;,]'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM items)),
gw AS (SELECT id, sense, list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda x: length(x) >= 2) AS ws FROM sn),
gl AS (SELECT id, sense, len(ws) AS n, unnest(ws) AS g, unnest(range(len(ws))) AS j FROM gw),
gf AS (SELECT DISTINCT id, sense, n, j, g, x FROM (SELECT *, unnest([g, {_case("g", M.ENGLISH.suffixes, False)}]) AS x FROM gl) WHERE x IS NOT NULL),
gk AS (SELECT id, sense, n, j, g, 0 AS grade, g AS key FROM gl UNION SELECT id, sense, n, j, g, 1, x FROM gf WHERE length(x) >= 3 UNION SELECT id, sense, n, j, g, 2, translate(x, 'aeiou', '') FROM gf WHERE length(translate(x, 'aeiou', '')) >= 3),
tt AS (SELECT id, regexp_extract_all(text, '[A-Za-z]+') AS ws, regexp_split_to_array(text, '[A-Za-z]+') AS gaps FROM items),
tk AS (SELECT id, unnest(range(len(ws))) AS i, lower(unnest(ws)) AS w, unnest([list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1:k - 1], lambda x: length(x))), 0) FOR k IN range(1, len(ws) + 1)])::INTEGER AS s FROM tt),
tp AS (SELECT *, unnest([w, {_case("w", M.ENGLISH.prefixes, True)}]) AS y FROM tk),
tf AS (SELECT DISTINCT id, i, w, s, x FROM (SELECT *, unnest([y, {_case("y", M.ENGLISH.suffixes, False)}]) AS x FROM tp WHERE y IS NOT NULL) WHERE x IS NOT NULL),
k AS (SELECT id, i, w, s, 0 AS grade, w AS key FROM tk UNION SELECT id, i, w, s, 1, x FROM tf WHERE length(x) >= 3 UNION SELECT id, i, w, s, 2, translate(x, 'aeiou', '') FROM tf WHERE length(translate(x, 'aeiou', '')) >= 3),
h AS MATERIALIZED (SELECT id, sense, n, j, g, i, w, s, s + length(w) AS e, min(grade) AS grade FROM k JOIN gk USING (id, grade, key) GROUP BY ALL),
cand AS (SELECT id, sense, n AS words, max(grade) AS grade, min(s) AS s, max(e) AS e FROM h WHERE n > 1 GROUP BY id, sense, n, i - j HAVING count(*) = n
UNION ALL SELECT id, sense, 1, grade, s, e FROM h WHERE j = 0 AND w NOT IN ({", ".join(f"'{x}'" for x in sorted(M.ENGLISH.stop))}) AND NOT (w IN ({(nums := ", ".join(f"'{x}'" for x in sorted(M.ENGLISH.numbers)))}) AND g NOT IN ({nums}))),
b AS (SELECT *, max(s) OVER (PARTITION BY id) AS last, min(e) OVER (PARTITION BY id) AS first FROM cand QUALIFY row_number() OVER (PARTITION BY id ORDER BY words DESC, grade, sense, e - s DESC, s) = 1)
SELECT items.id, b.s AS start, b.e AS "end", ['exact', 'form', 'root'][b.grade + 1] AS grade, b.sense, b.words FROM items LEFT JOIN b ON b.id = items.id AND (b.grade = 0 OR NOT (first <= b.s OR last >= b.e))""")
def graded_spans_conversations(s, d):
    """Where turns of conversations say glosses made of their own words, some without a letter or with one more."""
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    at = lambda i: F.coalesce(F.get(w, F.lit(i - 1)), F.lit(""))
    gloss = F.concat(at(5), F.lit(" "), at(6), F.lit("s, "), F.left(at(9), F.greatest(F.length(at(9)) - 1, F.lit(0))), F.lit("; "), at(2))
    items = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", gloss.alias("gloss"))
    return spans.graded_spans(items, M.ENGLISH)


@query()
def phrase_parts_conversations(s, d):
    """Where turns of conversations hold phrases of their own words, in a row or apart. No SQL; a test holds the operator against walks."""
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z']+)"), F.lit(1))
    phrase = F.concat_ws(" ", F.get(w, F.lit(3)), F.get(w, F.lit(4)), F.when(F.col("turn") % 2 == 0, F.get(w, F.lit(8))))
    items = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", phrase.alias("phrase"))
    out = spans.phrase_parts(items, lambda a, b: soft_match(a, b, {"is": "was"}))
    return out.select("id", F.array_join(F.transform("parts", lambda p: F.concat(p["start"], F.lit("-"), p["end"])), ",").alias("parts"))


def _folded_sql(x: str) -> str:
    """Doubled vowel letters as one, single ones inside a word off, word by word."""
    one = f"regexp_replace(regexp_replace(translate({x}, 'ךםןףץ', 'כמנפצ'), 'ו+', 'ו', 'g'), 'י+', 'י', 'g')"
    return f"array_to_string(list_transform(string_split({one}, ' '), lambda y: CASE WHEN length(y) > 2 THEN left(y, 1) || regexp_replace(substr(y, 2, length(y) - 2), '[וי]', '', 'g') || right(y, 1) ELSE y END), ' ')"


@query(f"""WITH bw AS (SELECT item_id, translate(translate(unnest(list_distinct(w)), '{_LATIN}', '{_SCRIPT}'), 'ךםןףץ', 'כמנפצ') AS item FROM (SELECT item_id, {_WORD} AS w FROM benchmark)),
items AS MATERIALIZED (SELECT DISTINCT item AS id FROM bw UNION SELECT DISTINCT translate(w[2] || ' ' || w[3], '{_LATIN}', '{_SCRIPT}') FROM (SELECT {_WORD} AS w FROM benchmark) WHERE len(w) >= 3),
bank AS MATERIALIZED (SELECT DISTINCT translate(w, '{_LATIN}', '{_SCRIPT}') AS word FROM (SELECT unnest({_WORD}) AS w, lang FROM documents WHERE lang = 'de') WHERE length(w) > 2),
known AS MATERIALIZED (SELECT key, min(word) AS word FROM (SELECT 'exact:' || word AS key, word FROM bank UNION ALL SELECT 'fold:' || {_folded_sql('word')}, word FROM bank UNION ALL SELECT 'root:' || word, word FROM bank WHERE length(word) = 4) GROUP BY key),
pre AS (SELECT id, unnest([id, CASE WHEN id LIKE 'ו%' AND length(id) > 2 THEN substr(id, 2) END]) AS f FROM items WHERE id NOT LIKE '% %'),
pv AS (SELECT id, id AS c FROM pre UNION SELECT id, substr(f, 2) FROM pre WHERE left(f, 1) IN ('ה', 'ל') AND length(f) > 2),
one AS MATERIALIZED (SELECT id, c FROM pv UNION SELECT id, left(c, length(c) - length(e)) FROM pv, (SELECT unnest(['יימ', 'ות', 'ימ']) AS e) WHERE suffix(c, e) AND length(c) - length(e) >= 2),
pieces AS (SELECT id, {_folded_sql('c')} AS f FROM one),
several AS (SELECT id, unnest([id, CASE WHEN id LIKE 'ו%' AND length(split_part(id, ' ', 1)) > 2 THEN substr(id, 2) END]) AS v FROM items WHERE id LIKE '% %'),
tok AS (SELECT id, t, i, {_folded_sql('t')} AS f FROM (SELECT id, unnest(string_split(id, ' ')) AS t, unnest(range(2)) AS i FROM items WHERE id LIKE '% %') WHERE length(t) >= 3),
tried AS (SELECT id, 0 AS rank, 'exact:' || c AS key, NULL AS told FROM one UNION ALL SELECT id, 1, 'fold:' || {_folded_sql('c')}, NULL FROM one
UNION ALL SELECT id, 2, 'root:' || substr(f, a, n), NULL FROM pieces, range(1, 40) x(a), range(3, 40) y(n) WHERE a + n <= length(f) + 1
UNION ALL SELECT id, 0, 'exact:' || v, NULL FROM several WHERE v IS NOT NULL UNION ALL SELECT id, 1, 'fold:' || {_folded_sql('v')}, NULL FROM several WHERE v IS NOT NULL
UNION ALL SELECT id, 2 + 2 * i, 'exact:' || t, t FROM tok UNION ALL SELECT id, 2 + 2 * i, 'fold:' || f, t FROM tok
UNION ALL SELECT id, 3 + 2 * i, 'root:' || substr(f, a, n), NULL FROM tok, range(1, 40) x(a), range(3, 40) y(n) WHERE a + n <= length(f) + 1),
best AS (SELECT id, min({{'rank': rank, 'hit': coalesce(told, word)}}) AS b FROM tried JOIN known USING (key) GROUP BY id)
SELECT id, CASE WHEN b.rank < 2 THEN 'full' WHEN b.rank >= 2 THEN 'close' ELSE 'miss' END AS tier, b.hit AS hit FROM items LEFT JOIN best USING (id)""")
def exam_cascade(s, d):
    """The benchmark's words and some pairs of words against the German documents' words, all in Hebrew letters; words of four letters
    are roots."""
    from wordloom.operators import cascade

    script = lambda c: F.translate(F.translate(c, _LATIN, _SCRIPT), "ךםןףץ", "כמנפצ")
    w = T.tokens(F.col("text"))
    bench = table(s, d, "benchmark").select(w.alias("w"))
    words = bench.select(F.explode("w").alias("w")).select(script(F.col("w")).alias("id"))
    pairs = bench.filter("size(w) >= 3").select(script(F.concat_ws(" ", F.get("w", F.lit(1)), F.get("w", F.lit(2)))).alias("id"))
    items = words.unionByName(pairs).distinct().withColumn("item", F.col("id"))
    bank = table(s, d, "documents").filter("lang = 'de'").select(F.explode(w).alias("w")).filter("length(w) > 2").select(script(F.col("w")).alias("word")).distinct()
    return cascade.match_items(items, bank.withColumn("roots", F.when(F.length("word") == 4, F.array("word")).otherwise(F.array().cast("array<string>"))))
