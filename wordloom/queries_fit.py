"""Queries of ordered picks, lexicon filters, leak-free datasets and fitted decisions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import scalars as S
from wordloom.functions import text as T
from wordloom.operators import picks
from wordloom.registry import query
from wordloom.sources.files import table


def _walk_sql(items: str) -> str:
    """A walk through items (id, ks, n from 1) that carries the keys claimed so far."""
    return f"""WITH RECURSIVE {items},
w AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS id, false AS picked, []::VARCHAR[] AS held
      UNION ALL SELECT i.n, i.id, NOT list_has_any(held, ks), CASE WHEN list_has_any(held, ks) THEN held ELSE list_concat(held, ks) END FROM w JOIN items i ON i.n = w.n + 1)"""


_WORD = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"

_ITEMS = f"""items AS MATERIALIZED (SELECT doc_id AS id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS n,
  list_filter(['t:' || CASE WHEN length(w[2]) >= 5 THEN left(w[2], 5) END, 'g:' || CASE WHEN length(w[-1]) >= 2 THEN w[-1] END, 's:' || source || w[1]], lambda x: x IS NOT NULL) AS ks FROM (SELECT doc_id, source, {_WORD} AS w FROM documents))"""


def _document_keys() -> F.Column:
    w = T.tokens(F.col("text"))
    two, last = F.get(w, F.lit(1)), F.try_element_at(w, F.lit(-1))
    head = F.concat(F.lit("s:"), F.col("source"), F.get(w, F.lit(0)))
    return F.array(F.when(F.length(two) >= 5, F.concat(F.lit("t:"), F.left(two, F.lit(5)))), F.when(F.length(last) >= 2, F.concat(F.lit("g:"), last)), head)


def _shuffled(c: str) -> tuple:
    return F.md5(F.col(c).cast("string")), F.col(c)


@query(f"{_walk_sql(_ITEMS)} SELECT id AS doc_id, n AS place, picked FROM w WHERE n > 0")
def greedy_picks_documents(s, d):
    """Documents in a shuffled order without two of one beginning, ending or opening of a source."""
    docs = table(s, d, "documents").select("doc_id", "text", "source")
    return picks.greedy_picks(docs.select("doc_id", _document_keys().alias("keys")), F.col("keys"), *_shuffled("doc_id")).select("doc_id", "place", "picked")


_PARTS = """items AS MATERIALIZED (SELECT p_partkey AS id, row_number() OVER (ORDER BY md5(p_partkey::VARCHAR), p_partkey) AS n,
  ['t:' || left(p_name || p_size, 5) || p_size, 'g:' || lower(p_type || ' ' || p_brand || ' ' || (floor(p_retailprice)::BIGINT % 10))] AS ks FROM part)"""


@query(f"{_walk_sql(_PARTS)} SELECT id AS p_partkey, row_number() OVER (ORDER BY n) AS item FROM w WHERE picked ORDER BY n LIMIT 100")
def exam_items_parts(s, d):
    """A test of 100 parts, none of which cues another (a top-k)."""
    size = F.col("p_size").cast("string")
    gloss = F.lower(F.concat_ws(" ", "p_type", "p_brand", (F.floor("p_retailprice") % 10).cast("string")))
    keys = F.array(F.concat(F.lit("t:"), F.left(F.concat("p_name", size), F.lit(5)), size), F.concat(F.lit("g:"), gloss))
    out = picks.exam_items(table(s, d, "part"), 100, keys, *_shuffled("p_partkey"))
    from wordloom.plans.ordinals import with_ordinal

    return with_ordinal(out, F.col("place"), name="item").select("p_partkey", "item")


_CARDS = f"""items AS MATERIALIZED (SELECT doc_id AS id, n_chars % 3 = 0 AS other, row_number() OVER (ORDER BY doc_id) AS n,
  CASE WHEN n_chars % 3 = 0 THEN []::VARCHAR[] ELSE list_distinct(w[3:5]) END AS ks FROM (SELECT doc_id, n_chars, {_WORD} AS w FROM documents))"""


@query(f"{_walk_sql(_CARDS)} SELECT w.id AS doc_id, CASE WHEN other OR NOT picked THEN 'w2m' ELSE 'm2w' END AS direction FROM w JOIN items USING (n) WHERE n > 0")
def flipped_directions_documents(s, d):
    """Documents as cards whose third to fifth words are their senses; a third is asked the other way from the start."""
    cards = table(s, d, "documents").select("doc_id", F.when(F.col("n_chars") % 3 == 0, "w2m").otherwise("m2w").alias("direction"), F.slice(T.tokens(F.col("text")), 3, 3).alias("senses"))
    return picks.flipped_directions(cards, "direction", F.col("senses"), F.col("doc_id")).select("doc_id", "direction")


_HASH = """list_reduce([{seed}::UBIGINT] || list_transform(string_split(k, ''), lambda x: unicode(x)::UBIGINT), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"""


def _mixed_sql(h: str) -> str:
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = f"(SELECT ((xor(v, v >> {shift})::UHUGEINT * {times}) % 4294967296)::UBIGINT FROM (SELECT {h} AS v))"
    return f"(SELECT xor(v, v >> 16) FROM (SELECT {h} AS v))"


#: The false-positive rate that the registered filter is sized for.
RATE = 0.01

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_DRAWN = "CASE WHEN {i} < ('0x' || h[1:2])::INTEGER % 6 + 3 THEN substr('" + _LETTERS + "', (('0x' || substr(h, 3 + 4 * {i}, 4))::INTEGER % 26 + 1)::INTEGER, 1) ELSE '' END"

_FILTER = f"""words AS MATERIALIZED (SELECT DISTINCT coalesce(lang, '') AS lang, unnest({_WORD}) AS word FROM documents),
z AS MATERIALIZED (SELECT 8 * greatest(1, ceil(ceil(-(count(*) * ln({RATE})) / (ln(2) * ln(2))) / 8))::BIGINT AS m, count(*) AS n FROM words),
kk AS (SELECT m, greatest(1, least(20, floor(m / greatest(1, n) * ln(2) + 0.5)))::BIGINT AS k FROM z),
other AS MATERIALIZED (SELECT DISTINCT lang, {" || ".join(_DRAWN.format(i=i) for i in range(8))} AS word FROM (SELECT lang, sha256(lang || '|' || word || '|' || j) AS h FROM words, range(1, 3) r(j))),
asked AS (SELECT lang, word, true AS known FROM words UNION ALL SELECT lang, word, false FROM other ANTI JOIN words USING (lang, word)),
hashed AS MATERIALIZED (SELECT lang, word, known, {_mixed_sql(_HASH.format(seed=0x811C9DC5))} AS h1, {_mixed_sql(_HASH.format(seed=0x9E3779B1))} | 1 AS h2 FROM (SELECT *, lang || chr(31) || word AS k FROM asked)),
ad AS MATERIALIZED (SELECT lang, word, known, (h1 + i * h2) % m AS a FROM hashed, kk, range(20) r(i) WHERE i < k),
bits AS MATERIALIZED (SELECT DISTINCT a FROM ad WHERE known)"""


@query(f"""WITH {_FILTER}, hit AS (SELECT lang, known, word, bool_and(bits.a IS NOT NULL) AS maybe FROM ad LEFT JOIN bits USING (a) GROUP BY ALL)
SELECT lang, count(*) FILTER (known) AS words, count(*) FILTER (known AND NOT maybe) AS lost, count(*) FILTER (NOT known) AS sample, count(*) FILTER (NOT known AND maybe) AS false_hits, (SELECT count(*) FROM bits) AS bits_set, (SELECT m FROM kk) AS bits, (SELECT k FROM kk) AS addresses FROM hit GROUP BY lang""")
def bloom_lexicon(s, d):
    """The filter of all words of documents by language: what it loses of them (nothing), and what it takes of twice as many
    strings that aren't words."""
    from wordloom.operators import bloom
    from wordloom.plans.shared import written

    docs = table(s, d, "documents")
    words = written(docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(T.tokens(F.col("text"))).alias("word")).distinct(), "words")
    size = bloom.Size(words.count(), RATE)
    filter_ = written(bloom.built(words, size), "filter")
    sample = bloom.lettered(words, _LETTERS, 2)
    own = bloom.measured(words, filter_, size).select("lang", F.col("n").alias("words"), (F.col("n") - F.col("hits")).alias("lost"))
    other = bloom.measured(sample, filter_, size).select("lang", F.col("n").alias("sample"), F.col("hits").alias("false_hits"))
    set_ = filter_.agg(F.sum(F.bitmap_count("bits")).alias("bits_set"))
    return own.join(other, "lang", "left").join(F.broadcast(set_)).select("lang", "words", "lost", F.coalesce("sample", F.lit(0)).alias("sample"), F.coalesce("false_hits", F.lit(0)).alias("false_hits"), "bits_set", F.lit(size.bits).cast("long").alias("bits"), F.lit(size.addresses).cast("long").alias("addresses"))


@query(f"""WITH {_FILTER}, typed AS (SELECT p_partkey AS id, p_name AS source, CASE p_partkey % 4 WHEN 0 THEN substr(p_name, 2) WHEN 1 THEN p_name || ' the' WHEN 2 THEN regexp_replace(p_name, ' .*', ' of') ELSE p_name END AS typed FROM part),
parts AS (SELECT *, list_filter(string_split(typed, ' '), lambda x: x <> '') AS t, list_filter(string_split(source, ' '), lambda x: x <> '') AS u FROM typed),
a AS (SELECT id, typed, CASE WHEN len(t) = len(u) THEN [t[i] FOR i IN range(1, len(t) + 1) IF t[i] <> u[i]] ELSE t END AS ws FROM parts),
x AS (SELECT id, typed, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END) AS w FROM a)
SELECT id, typed, bool_and(length(coalesce(w, '')) >= 2 AND word IS NOT NULL) AS hit FROM x LEFT JOIN (SELECT word FROM words WHERE lang = 'en') ON word = w GROUP BY id, typed""")
def lexicon_hits_parts(s, d):
    """Typed part names: is all that differs from the name a word of the corpus?"""
    from wordloom.operators import bloom

    words = table(s, d, "documents").filter("lang = 'en'").select("lang", F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    n, name = F.col("p_partkey") % 4, F.col("p_name")
    typed = F.when(n == 0, F.substring(name, 2, 1000)).when(n == 1, F.concat(name, F.lit(" the"))).when(n == 2, F.regexp_replace(name, " .*", " of")).otherwise(name)
    rows = table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name", typed.alias("typed"))
    return bloom.lexicon_hits(rows, "id", F.col("typed"), F.col("p_name"), F.lit("en"), words).join(rows.select("id", "typed"), "id").select("id", "typed", "hit")


_FNV = "list_reduce([2166136261::UBIGINT] || list_transform(string_split({x}, ''), lambda x: unicode(x)::UBIGINT), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


def _units_sql(forms: str) -> str:
    """Units of forms (owner, form) by following edges from every owner."""
    return f"""{forms}, edges AS MATERIALIZED (SELECT DISTINCT owner AS a, min(owner) OVER (PARTITION BY form) AS b FROM forms),
both_ways AS MATERIALIZED (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(owner, o) AS (SELECT DISTINCT owner, owner FROM forms UNION SELECT r.owner, e.b FROM reach r JOIN both_ways e ON e.a = r.o),
units AS (SELECT owner, min(o) AS unit FROM reach GROUP BY owner),
split AS (SELECT owner, unit, ({_FNV.format(x="unit || '|fold'")} % 5)::BIGINT AS fold, {_FNV.format(x="unit || '|holdout'")} % 100000 < 20000 AS holdout FROM units)"""


_LINES = "forms AS (SELECT DISTINCT l_orderkey AS owner, l_partkey || '-' || l_suppkey || '-' || l_quantity::BIGINT AS form FROM lineitem)"


@query(f"WITH RECURSIVE {_units_sql(_LINES)} SELECT * FROM split")
def leak_free_folds_orders(s, d):
    """Orders that hold the same line (part, supplier, quantity), directly or over others, are in one fold."""
    from wordloom.operators import units

    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.concat_ws("-", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")).alias("form"))
    return units.leak_free_folds(lines)


_BENCH = f"forms AS MATERIALIZED (SELECT DISTINCT regexp_replace(form, '[aeiou]', '', 'g') AS owner, form FROM (SELECT unnest({_WORD}) AS form FROM benchmark) WHERE length(form) >= 4 AND regexp_replace(form, '[aeiou]', '', 'g') <> '')"
_ADJ = "map {" + ", ".join(f"'{k}': '{''.join(v)}'" for k, v in sorted(S.KEY_NEIGHBOURS.items())) + "}"


@query(f"""WITH RECURSIVE {_units_sql(_BENCH)},
v AS (SELECT owner, form, 0 AS i, 'drop' AS kind, unnest(list_distinct([form[:i - 1] || form[i + 1:] FOR i IN range(1, length(form) + 1)])) AS typed FROM forms
UNION ALL SELECT owner, form, 1, 'swap', unnest(list_distinct([form[:i - 1] || form[i + 1] || form[i] || form[i + 2:] FOR i IN range(1, length(form))])) FROM forms
UNION ALL SELECT owner, form, 2, 'double', unnest(list_distinct([form[:i] || form[i:] FOR i IN range(1, length(form) + 1)])) FROM forms
UNION ALL SELECT owner, form, 3, 'neighbour', unnest(flatten([[form[:i - 1] || c || form[i + 1:] FOR c IN string_split({_ADJ}[form[i]], '')] FOR i IN range(1, length(form) + 1)])) FROM forms),
picked AS MATERIALIZED (SELECT owner, form, kind, arg_min(typed, md5(form || '|' || kind || '|' || typed) || typed) AS typed FROM v ANTI JOIN (SELECT owner, form AS typed FROM forms) o USING (owner, typed)
  WHERE typed <> form AND typed <> '' AND (i - ({_FNV.format(x="form || '|rot'")} % 4)::INTEGER + 4) % 4 < 2 GROUP BY owner, form, kind),
near AS MATERIALIZED (SELECT p.owner, p.typed, min(levenshtein(p.typed, f.form)) FILTER (f.owner = p.owner) AS own, min(levenshtein(p.typed, f.form)) FILTER (f.owner <> p.owner) AS other
  FROM (SELECT DISTINCT owner, typed FROM picked) p JOIN forms f ON abs(length(p.typed) - length(f.form)) <= 2 AND levenshtein(p.typed, f.form) <= 2 GROUP BY 1, 2),
words AS (SELECT DISTINCT unnest({_WORD}) AS word FROM documents),
made AS (SELECT p.owner, form, typed, kind, CASE WHEN other = 0 THEN 'veto' WHEN other <= own THEN 'ambiguous' WHEN word IS NOT NULL THEN 'real-word' ELSE 'novel' END AS why FROM picked p LEFT JOIN near USING (owner, typed) LEFT JOIN words ON word = typed),
partner AS MATERIALIZED (SELECT DISTINCT a.owner, a.form, b.form AS typed FROM forms a JOIN forms b ON a.owner <> b.owner AND abs(length(a.form) - length(b.form)) <= 1 AND levenshtein(a.form, b.form) = 1 QUALIFY dense_rank() OVER (PARTITION BY a.owner, a.form ORDER BY b.form) <= 2),
lone AS (SELECT owner, form, array_to_string([substr('{_LETTERS}', (('0x' || substr(md5(form || '|' || i), 1, 4))::INTEGER % 26 + 1)::INTEGER, 1) FOR i IN range(1, length(form) + 1)], '') AS typed FROM forms ANTI JOIN partner USING (owner, form)),
every AS (SELECT owner, form, typed, kind, CASE WHEN why = 'novel' THEN 'accept' ELSE 'reject' END AS label, why FROM made UNION ALL SELECT owner, form, typed, 'neg/partner', 'reject', 'partner' FROM partner
UNION ALL SELECT owner, form, typed, 'neg/garbage', 'reject', 'garbage' FROM lone WHERE typed NOT IN (SELECT form FROM forms)),
one AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY owner, form, typed ORDER BY label <> 'reject', kind) = 1),
turned AS (SELECT *, label = 'accept' AND bool_or(label = 'reject') OVER (PARTITION BY form, typed) AS t FROM one)
SELECT owner, form, typed, kind, CASE WHEN t THEN 'reject' ELSE label END AS label, CASE WHEN t THEN 'cross-owner' ELSE why END AS why, t OR label = 'reject' OR length(form) >= 5 AS trusted, fold, holdout FROM turned JOIN split USING (owner)""")
def labelled_dataset_benchmark(s, d):
    """Mistypings of the benchmark's words, by consonant skeleton, against the words of documents."""
    from wordloom.operators import dataset

    form = F.col("form")
    words = table(s, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("form")).distinct()
    forms = words.select(F.regexp_replace(form, "[aeiou]", "").alias("owner"), "form").filter("length(form) >= 4 AND owner <> ''")
    lexicon = table(s, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return dataset.labelled_dataset(forms, lexicon)


#: Items of the fitting queries: labelled documents, two pairs each (their halves); a pair's cell is its length and language, its
#: features are marks in a thousand characters.
_MARKS, _CELLS, _GRID = ("!", "|", "%", ","), 10, 50

_PAIRS = f"""p AS MATERIALIZED (SELECT DISTINCT item, good, length, lang, (least(length(t) // 500, 4) + CASE WHEN lang = 'en' THEN 5 ELSE 0 END)::BIGINT AS cell,
  [{", ".join(f"1000 * (length(t) - length(replace(t, '{m}', ''))) // greatest(length(t), 1)" for m in _MARKS)}] AS x FROM (
  SELECT doc_id AS item, quality = 1 AS good, least(length(text) // 1000, 6) AS length, lang, unnest([left(text, length(text) // 2), substr(text, length(text) // 2 + 1)]) AS t FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL))"""


def _items(s, d):
    n = F.floor(F.length("text") / 2).cast("int")
    docs = table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", "lang", F.length("text").alias("n"), F.array(F.left("text", n), F.substring("text", n + 1, F.length("text"))).alias("halves"))

    def pair(t):
        length = F.length(t)
        cell = F.least(F.floor(length / 500), F.lit(4).cast("long")) + F.when(F.col("lang") == "en", 5).otherwise(0)
        marks = [F.floor(1000 * (length - F.length(F.replace(t, F.lit(m), F.lit("")))) / F.greatest(length, F.lit(1))) for m in _MARKS]
        return F.struct(cell.cast("int").alias("cell"), F.array(*marks).alias("x"))

    rows = docs.join(table(s, d, "labels").select("doc_id", "quality"), "doc_id")
    return rows.select(F.col("doc_id").alias("item"), (F.col("quality") == 1).alias("good"), F.least(F.floor(F.col("n") / 1000), F.lit(6).cast("long")).cast("int").alias("length"), "lang", F.transform("halves", pair).alias("pairs"))


def _cost(x: str, w: str) -> str:
    return "(" + " + ".join(f"{x}[{k + 1}] * {w}[{k + 1}]" for k in range(len(_MARKS))) + ")"


def _solved_sql(n: str, cand: str, bad: str = "NOT good") -> str:
    """Thresholds ``t{n}`` (g, cell, t) and scores ``s{n}`` (g, taken, complexity) of the candidates (g, w)."""
    return f"""f{n} AS MATERIALIZED (SELECT g, cell, CASE WHEN min(c) FILTER ({bad}) IS NULL THEN {1 << 60} ELSE greatest(0, (min(c) FILTER ({bad}) - 1) // {_GRID} * {_GRID}) END AS free FROM (SELECT g, p.*, {_cost("x", "w")} AS c FROM p, {cand}) GROUP BY g, cell),
t{n} AS MATERIALIZED (SELECT g, cell, CASE WHEN max(c) FILTER (good AND c <= free) IS NULL THEN 0 ELSE least(any_value(free), greatest(0, (max(c) FILTER (good AND c <= free) + {_GRID} - 1) // {_GRID} * {_GRID})) END AS t FROM (SELECT g, p.*, {_cost("x", "w")} AS c FROM p, {cand}) JOIN f{n} USING (g, cell) GROUP BY g, cell),
s{n} AS MATERIALIZED (SELECT g, coalesce(taken, 0) AS taken, complexity FROM (SELECT g, sum(t) AS complexity FROM t{n} GROUP BY g) LEFT JOIN (SELECT g, count(DISTINCT item) AS taken FROM (SELECT g, p.*, {_cost("x", "w")} AS c FROM p, {cand}) JOIN t{n} USING (g, cell) WHERE good AND t > 0 AND c <= t GROUP BY g) USING (g))"""


_SEED, _GRIDS = [10, 10, 10, 10], [[0, 5, 20, 99], [0, 5, 20, 99], [0, 5, 20, 99], [0, 1, 3, 30]]


def _descent_sql() -> str:
    steps, now = [f"w0 AS (SELECT {_SEED} AS w)"], 0
    for axis, grid in enumerate(_GRIDS):
        cand = f"c{now} AS MATERIALIZED (SELECT 0 AS g, w FROM w{now} UNION ALL SELECT i, w[:{axis}] || [v] || w[{axis + 2}:] FROM w{now}, (SELECT unnest({grid}) AS v, unnest(range(1, {len(grid) + 1})) AS i) WHERE v <> w[{axis + 1}])"
        steps += [cand, _solved_sql(str(now), f"c{now}"), f"w{now + 1} AS MATERIALIZED (SELECT w FROM c{now} JOIN s{now} USING (g) ORDER BY taken DESC, complexity, g LIMIT 1)"]
        now += 1
    return ", ".join([*steps, f"c{now} AS (SELECT 0 AS g, w FROM w{now})", _solved_sql(str(now), f"c{now}")]), now


def _model(s, d):
    """The items, their statistics and the fitted model."""
    from wordloom.operators import fitting

    items = _items(s, d)
    stats = fitting.Statistics.of(items, _CELLS, _GRID)
    return items, stats, fitting.fit(stats, [_SEED], _GRIDS, rounds=1)


_STEPS, _LAST = _descent_sql()


@query(f"""WITH {_PAIRS}, {_STEPS}
SELECT 'weight ' || unnest(range(4)) AS name, unnest(w) AS value FROM w{_LAST} UNION ALL SELECT 'threshold ' || cell, t FROM t{_LAST} WHERE t > 0 UNION ALL SELECT 'taken', taken FROM s{_LAST}""")
def fitted_model(s, d):
    """Weights by coordinate descent, thresholds, and the number of accepted items."""
    _, _, m = _model(s, d)
    rows = [(f"weight {i}", w) for i, w in enumerate(m.weights)] + [(f"threshold {c}", t) for c, t in enumerate(m.score.thresholds) if t] + [("taken", m.score.taken)]
    return s.createDataFrame(rows, "name string, value long")


def _clamp_sql() -> str:
    """Cell by cell: the grid value that the items need which no other cell accepts as thresholds stand."""
    steps = [f"k0 AS MATERIALIZED (SELECT cell, t FROM t{_LAST}), q AS MATERIALIZED (SELECT item, cell, min({_cost('x', 'w')}) AS c FROM p, w{_LAST} GROUP BY item, cell)"]
    for c in range(_CELLS):
        steps.append(f"""k{c + 1} AS MATERIALIZED (SELECT cell, CASE WHEN cell <> {c} OR t = 0 THEN t ELSE least(t, coalesce((SELECT max(greatest({_GRID}, (c + {_GRID} - 1) // {_GRID} * {_GRID})) FROM q WHERE q.cell = {c} AND c <= (SELECT t FROM k{c} WHERE cell = {c})
  AND item NOT IN (SELECT item FROM q JOIN k{c} k USING (cell) WHERE cell <> {c} AND t > 0 AND c <= t)), 0)) END AS t FROM k{c})""")
    return ", ".join(steps)


@query(f"WITH {_PAIRS}, {_STEPS}, {_clamp_sql()} SELECT cell, t AS threshold FROM k{_CELLS} WHERE t > 0")
def clamped_thresholds(s, d):
    """The fitted thresholds, lowered as far as no decision changes."""
    from wordloom.operators import fitting

    items, _, m = _model(s, d)
    out = fitting.clamped(items, m.weights, m.score.thresholds, _GRID)
    return s.createDataFrame([(c, t) for c, t in enumerate(out) if t], "cell long, threshold long")


_SHARES = (0.0, 0.05, 0.1, 0.25, 0.5, 1.0)


@query(f"""WITH {_PAIRS}, {_STEPS},
slack AS MATERIALIZED (SELECT item, min(CASE WHEN t > 0 THEN {_cost("x", "w")} - t END) AS s FROM p JOIN t{_LAST} USING (cell), w{_LAST} WHERE NOT good AND lang <> 'en' GROUP BY item),
ranked AS (SELECT item, row_number() OVER (ORDER BY s, item) AS place FROM slack WHERE s IS NOT NULL),
cuts AS (SELECT DISTINCT floor(share * (SELECT count(*) FROM slack) + 0.5)::BIGINT AS k FROM (SELECT unnest({list(_SHARES)}) AS share)),
r AS MATERIALIZED (SELECT k AS g, p.*, {_cost("x", "w")} AS c, place IS NOT NULL AND place <= k AS gone FROM p LEFT JOIN ranked USING (item), cuts, w{_LAST}),
fk AS (SELECT g, cell, CASE WHEN min(c) FILTER (NOT good AND NOT gone) IS NULL THEN {1 << 60} ELSE greatest(0, (min(c) FILTER (NOT good AND NOT gone) - 1) // {_GRID} * {_GRID}) END AS free FROM r GROUP BY g, cell),
tk AS (SELECT g, cell, CASE WHEN max(c) FILTER (good AND c <= free) IS NULL THEN 0 ELSE least(any_value(free), greatest(0, (max(c) FILTER (good AND c <= free) + {_GRID} - 1) // {_GRID} * {_GRID})) END AS t FROM r JOIN fk USING (g, cell) GROUP BY g, cell)
SELECT g AS k, count(DISTINCT item) FILTER (good AND t > 0 AND c <= t) AS taken FROM r JOIN tk USING (g, cell) GROUP BY g""")
def counterfactual_curve(s, d):
    """What would be accepted if the k most binding rejected items of other languages were known to be good."""
    from wordloom.operators import fitting

    items, stats, m = _model(s, d)
    other = ~F.col("good") & (F.col("lang") != "en")
    rest = fitting.Statistics.of(items.filter(~F.coalesce(other, F.lit(False))), _CELLS, _GRID)
    curve = fitting.counterfactual(rest, items.filter(other), m.weights, m.score.thresholds, list(_SHARES))
    return s.createDataFrame(sorted({(k, score.taken) for k, score in curve}), "k long, taken long")


@query(f"""WITH {_PAIRS}, {_STEPS},
near AS (SELECT item, min(CASE WHEN t > 0 THEN {{'s': {_cost("x", "w")} - t, 'cell': cell}} END) AS n, min({{'c': {_cost("x", "w")}, 'cell': cell}}) AS l FROM p JOIN t{_LAST} USING (cell), w{_LAST} WHERE item % 3 <> 0 GROUP BY item),
u AS (SELECT item, coalesce(n.cell, l.cell) AS cell, CASE WHEN n IS NULL THEN 2 WHEN n.s <= 0 THEN 0 ELSE 1 END AS tier, CASE WHEN n IS NULL THEN l.c ELSE abs(n.s) END AS distance FROM near),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY tier, distance, item) AS k FROM u)
SELECT item, cell, tier, distance, row_number() OVER (ORDER BY k, cell) AS turn FROM r QUALIFY turn <= 200""")
def acquired_items_next(s, d):
    """The next 200 items to label (a top-k); a third has labels already."""
    from wordloom.operators import fitting

    items, _, m = _model(s, d)
    out = fitting.acquired(items, items.filter("item % 3 = 0"), m.weights, m.score.thresholds, 200)
    return out.select("item", F.col("cell").cast("long").alias("cell"), F.col("tier").cast("long").alias("tier"), "distance", F.col("turn").cast("long").alias("turn"))
