"""Queries of the gloss linter over all lines of documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import lint
from wordloom.registry import query
from wordloom.sources.files import table

#: Words that make no gloss circular; what a broken-off sense starts with.
STOPS, CONJUNCTION = ["the", "and", "one"], "^(and|but|of|in) |^ו[א-ת]"


def glossary(s: SparkSession, d: str) -> DataFrame:
    """Every line of every document as a word, its first, with the rest as gloss and the word's first four letters as root."""
    lines = table(s, d, "documents").select("lang", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    word = F.split_part("line", F.lit(" "), F.lit(1))
    return lines.select("lang", (F.col("doc_id") * 1_000_000 + F.col("at") + 1).alias("id"), word.alias("word"), F.left(word, F.lit(4)).alias("root"), F.substring(F.col("line"), F.length(word) + 2, F.length("line")).alias("gloss"))


_KEY = "trim(regexp_replace(regexp_replace({0}, '[-–—/|־]', ' ', 'g'), '[\"''`׳״.,;:!?()\\[\\]{{}}]', '', 'g'))"
_FOLD = "regexp_replace(regexp_replace(translate(" + _KEY + ", 'ךםןףץ', 'כמנפצ'), 'ו+', 'ו', 'g'), 'י+', 'י', 'g')"
_FOLDED = f"CASE WHEN length({_FOLD}) > 2 THEN {_FOLD}[1] || regexp_replace({_FOLD}[2:-2], '[וי]', '', 'g') || {_FOLD}[-1] ELSE {_FOLD} END"
_BLANK = r"'[ \t\n\f\r]+', ' ', 'g'"
_PROBLEMS = rf"""l AS (SELECT doc_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
r AS (SELECT lang, doc_id * 1000000 + pos AS id, split_part(line, ' ', 1) AS word, left(split_part(line, ' ', 1), 4) AS root, substr(line, length(split_part(line, ' ', 1)) + 2) AS gloss FROM l),
p AS (SELECT *, trim(regexp_replace(regexp_replace(replace(gloss, '־', '-'), '[\x{{0591}}-\x{{05bd}}\x{{05bf}}-\x{{05c7}}]', '', 'g'), {_BLANK})) AS g FROM r),
b AS (SELECT *, trim(regexp_replace(regexp_replace(g, '\([^)]*\)', ' ', 'g'), {_BLANK})) AS bare FROM p),
t AS (SELECT *, list_filter(list_transform(regexp_split_to_array(bare, '[;:.]'), lambda x: trim(x)), lambda x: x <> '') AS senses,
 list_distinct(list_transform(regexp_extract_all(lower(bare), '\p{{L}}{{3,}}'), lambda x: {_FOLDED.format('x')})) AS found,
 list_distinct(list_transform(list_filter(string_split(lower(word), ' '), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'one')), lambda x: {_FOLDED.format('x')})) AS known,
 {_FOLDED.format('lower(root)')} AS key, regexp_extract_all(g, '[\p{{L}}"׳]+') AS w,
 length(g) - length(replace(g, '(', '')) AS opened, length(g) - length(replace(g, ')', '')) AS closed FROM b),
u AS (SELECT *, len(list_intersect(found, known)) >= greatest(1, len(known)) AS circular, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS three FROM t),
flags AS (SELECT id, unnest(CASE WHEN g = '' THEN ['empty'] ELSE [CASE WHEN circular THEN 'circular' END,
 CASE WHEN NOT circular AND length(root) >= 3 AND NOT contains(root, '-') AND len(list_filter(found, lambda x: contains(x, key) AND length(x) <= length(key) + 2)) > 0 THEN 'rootecho' END,
 CASE WHEN length(g) > 60 THEN 'toolong' END,
 CASE WHEN opened <> closed OR opened > 0 AND (bare = '' OR opened > greatest(1, len(senses)) OR regexp_matches(g, '\([^)]*;[^)]*\)')) THEN 'parens' END,
 CASE WHEN len(three) > len(list_distinct(three)) THEN 'repeat' END,
 CASE WHEN suffix(g, '.') OR regexp_matches(g, '[—–·]') OR regexp_matches(gloss, '[ \t\n\f\r][,;:]|[,;:]{{2}}|  ') THEN 'punct' END,
 CASE WHEN len(list_filter(senses[2:], lambda x: regexp_matches(x, '{CONJUNCTION}') AND len(string_split(x, ' ')) <= 4)) > 0 THEN 'fragment' END,
 CASE WHEN regexp_matches(gloss, '[\x{{0591}}-\x{{05bd}}\x{{05bf}}-\x{{05c7}}]') THEN 'niqqud' END] END) AS rule FROM u),
fg AS (SELECT g, min(id) AS first FROM p WHERE g <> '' GROUP BY 1), s AS (SELECT id, word, unnest(senses) AS k FROM u WHERE g <> ''), fs AS (SELECT k, min_by(word, id) AS holder FROM s WHERE length(k) >= 6 GROUP BY 1),
problems AS (SELECT id, rule FROM flags WHERE rule IS NOT NULL UNION SELECT id, 'shared' FROM p JOIN fg USING (g) WHERE id <> first UNION SELECT id, 'shared' FROM s JOIN fs USING (k) WHERE holder <> word)"""


def problems(s: SparkSession, d: str) -> DataFrame:
    return lint.gloss_problems(glossary(s, d), STOPS, CONJUNCTION)


@query(f"WITH {_PROBLEMS} SELECT rule, count(*) AS n, min(id) AS first, max(id) AS last, sum(id % 1009)::BIGINT AS digest FROM problems GROUP BY rule")
def gloss_lint(s, d):
    """Lines by what is wrong with them, all ten kinds of rules."""
    return problems(s, d).groupBy("rule").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.sum(F.col("id") % 1009).alias("digest"))


@query(f"WITH {_PROBLEMS} SELECT doc_id, count(DISTINCT id) AS bad_lines, count(*) AS problems, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM (SELECT id // 1000000 AS doc_id, id, rule FROM problems) GROUP BY doc_id")
def gloss_reports(s, d):
    """Of each document with problems: bad lines, problems and their kinds. Kinds are bits, so that all sums are hashed."""
    names = sorted(lint.GLOSS_RULES)
    bit = F.array_position(F.array(*map(F.lit, names)), F.col("rule")).cast("int") - 1
    per_line = problems(s, d).groupBy("id").agg(F.count("*").alias("n"), F.bit_or(F.call_function("shiftleft", F.lit(1), bit)).alias("m"))
    per_doc = per_line.groupBy(F.floor(F.col("id") / 1_000_000).cast("long").alias("doc_id")).agg(F.count("*").alias("bad_lines"), F.sum("n").alias("problems"), F.bit_or("m").alias("m"))
    kinds = F.array_compact(F.array(*[F.when(F.col("m").bitwiseAND(F.lit(1 << i)) != 0, name) for i, name in enumerate(names)]))
    return per_doc.select("doc_id", "bad_lines", "problems", F.array_join(kinds, ",").alias("rules"))
