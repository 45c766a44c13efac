"""The registered queries of the training-data operators; each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import decontam_sam, gumbel_pieces, html_template, line_bloom, minhash_cps, phrase_lists, pii_boost, quality_qda, quality_sketch, token_orc, toxic_nbsvm, vector_va, warc_zip
from wordloom.llm.common import table


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; operators take any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STRIPPED = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _codes_sql(rounds: int = 4) -> str:
    """Codebooks by the same number of rounds over all pairs of parts and entries."""
    assign = """a{k} AS MATERIALIZED (SELECT id, p, min(d * 256 + e) % 256 AS e, min(d * 256 + e) // 256 AS d FROM (
    SELECT v.id, v.p, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM v JOIN b{k} b USING (p)) GROUP BY id, p)"""
    move = """b{n} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT p, e, list(c ORDER BY i) AS x FROM (
        SELECT p, e, i, ((sum(c) - (sum(c) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS c FROM (SELECT v.p, a.e, unnest(v.x) AS c, unnest(range(len(v.x))) AS i FROM a{k} a JOIN v USING (id, p)) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))"""
    steps = [x for k in range(rounds) for x in (assign.format(k=k), move.format(k=k, n=k + 1))] + [assign.format(k=rounds)]
    return f"""
WITH kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT id, p, x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4] AS x FROM kept, range(4) r(p)),
b0 AS MATERIALIZED (SELECT p, id AS e, x FROM v WHERE id < 256),
{", ".join(steps)},
code AS (SELECT id, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN code USING (id), books"""


ORACLE_SQL = {
    "op1_warc_zip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (k // 4), 5))::INTEGER >> (15 - 5 * (k % 4))) & 31), 1)
                       FOR k IN range(32)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d""",
    "op2_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)""",
    "op5_line_dedup": f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM parts),
keyed AS (SELECT doc_id, line, i, {_LOWER.format(_STRIPPED.format("line"))} AS k FROM lines),
common AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, line, i, last IS NOT NULL AND last <> doc_id AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op10_decontamination": f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest([array_to_string(w[i:i + least(len(w), 13) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), 13) + 2)]) AS g FROM bw WHERE len(w) > 0),
grams AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest([array_to_string(w[j:j + n - 1], ' ') FOR j IN range(1, len(w) - n + 2)]) AS g
          FROM dw, (SELECT DISTINCT n FROM items) WHERE len(w) >= n),
found AS (SELECT doc_id, g.i, g.n, item_id FROM grams g JOIN items USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op11_phrase_lists": f"""
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, range(1, 6) r(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS s FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
inside AS (SELECT lang, phrase, max(f) AS most FROM (
    SELECT lang, f, unnest([array_to_string(s[i:i + m - 1], ' ') FOR i IN range(1, k - m + 2)]) AS phrase FROM f, range(2, 5) r(m) WHERE m < k) GROUP BY lang, phrase),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, j, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
         FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
         JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.s[1:j], ' ')
         JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.s[j + 1:c.k], ' ') JOIN n ON n.lang = c.lang
         QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score
FROM cuts LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a
QUALIFY rank <= 2000""",
    "op12_vector_va": _codes_sql(),
}


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archived(table(spark, sf_dir, "pages"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_cps.near_duplicates(table(spark, sf_dir, "documents"))


def op3_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gumbel_pieces.sample_digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_positions(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_bloom.line_dedup(table(spark, sf_dir, "documents"))


def op6_toxic_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_nbsvm.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boost.personal_data(table(spark, sf_dir, "documents"))


def op8_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extracted(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_sketch.quality(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam_sam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


def op11_phrase_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_lists.collocations(table(spark, sf_dir, "documents"))


def op12_vector_va(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_va.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL
