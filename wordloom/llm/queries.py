"""Queries over the given tables, one per operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import conversations, decontaminate, jaccard, langid, lexical, licenses, lines, packing, pst, quality, substrings, toxicity, warc
from wordloom.llm.frames import read, remainder
from wordloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({_quoted(name)}, {i}, {_quoted(text)})" for name, own in licenses.TEMPLATES.items() for i, text in enumerate(own))
_GRAMS = """list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"""
_NORMAL = """list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda x: x <> '')"""


@query("op1_license_scan", f"""
WITH p AS (SELECT license, template, {_GRAMS} AS g FROM (SELECT license, template, {_NORMAL} AS w
                                                          FROM (VALUES {_TEMPLATES}) AS v(license, template, body))),
     s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, regexp_split_to_array(text, '\\n[ \\t\\r]*(?:\\n[ \\t\\r]*)+') AS bs FROM documents),
     pts AS (SELECT doc_id, 'line' AS unit, ls AS parts FROM s
             UNION ALL SELECT doc_id, 'paragraph', list_filter(bs, lambda b: contains(b, chr(10))) FROM s WHERE len(ls) > 1
             UNION ALL SELECT doc_id, 'text', [text] FROM s WHERE len(bs) > 1),
     u AS (SELECT doc_id, unit, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS place, unnest(parts) AS body FROM pts),
     n AS (SELECT doc_id, unit, place, {_GRAMS} AS g FROM (SELECT doc_id, unit, place, {_NORMAL} AS w FROM u)),
     x AS (SELECT doc_id, unit, place, unnest(g) AS gram, len(g) AS n FROM n WHERE len(g) > 0),
     y AS (SELECT license, template, unnest(g) AS gram, len(g) AS m FROM p),
     d AS (SELECT doc_id, unit, place, license, template, 2.0::DOUBLE * count(*) / (n + m) AS dice FROM x JOIN y USING (gram)
           GROUP BY doc_id, unit, place, license, template, n, m),
     b AS (SELECT doc_id, unit, place, license, dice, row_number() OVER (PARTITION BY doc_id, unit, place ORDER BY dice DESC, license) AS r
           FROM d WHERE dice >= 0.8)
SELECT doc_id, unit, place, license, dice FROM b WHERE r = 1""")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, paragraphs and texts of the documents that are a licence notice or text, with the best licence."""
    return licenses.scan(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op2_substring_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g
             FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
     rep AS (SELECT doc_id, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
     gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM rep) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, p: ps IS NULL OR NOT list_contains(ps, p)), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)""")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document left when passages of 35 words that occur twice or more are removed."""
    found = substrings.remove_repeats(read(spark, sf_dir, "documents"), with_text=False)
    return found.withColumnRenamed("id", "doc_id")


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document: 5-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard.groups(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op4_line_dedup", r"""
WITH l AS (SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS line_no, trim(unnest(a), ' ') AS line
           FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
     f AS (SELECT line, min({'id': doc_id, 'line_no': line_no}) AS first FROM l WHERE length(line) >= 20 GROUP BY line),
     s AS (SELECT line, first, length(line) AS n, i, n // 3 AS q, n % 3 AS r FROM f, (SELECT unnest([0, 1, 2]) AS i)),
     g AS (SELECT line, first, n, i, q * i + greatest(i - 3 + r, 0) AS p, q + CASE WHEN i + r >= 3 THEN 1 ELSE 0 END AS k FROM s),
     seg AS (SELECT line, first, n, i, p, substr(line, p + 1, k) AS t FROM g),
     sub AS (SELECT b.line, b.first, m AS n, i, substr(b.line, p + o + 1, k) AS t
             FROM (SELECT line, first, length(line) AS n0, unnest(range(length(line) - 2, length(line) + 1)) AS m FROM f) b,
                  LATERAL (SELECT i, (m // 3) * i + greatest(i - 3 + m % 3, 0) AS p, m // 3 + CASE WHEN i + m % 3 >= 3 THEN 1 ELSE 0 END AS k, o
                           FROM (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([-2, -1, 0, 1, 2]) AS o))
             WHERE p + o >= 0),
     near AS (SELECT DISTINCT seg.line AS x, seg.first AS fx, sub.line AS y, sub.first AS fy FROM seg JOIN sub USING (n, i, t) WHERE seg.line <> sub.line),
     ok AS (SELECT x, fx, y, fy, levenshtein(x, y) AS d FROM near WHERE levenshtein(x, y) <= 2),
     e AS (SELECT line, min({'of': fe, 'd': d}) AS m FROM (SELECT x AS line, fy AS fe, d FROM ok WHERE fy < fx
                                                           UNION ALL SELECT y, fx, d FROM ok WHERE fx < fy) GROUP BY line)
SELECT doc_id, line_no, coalesce(m.of.id, first.id) AS of_doc_id, coalesce(m.of.line_no, first.line_no) AS of_line_no,
       CAST(coalesce(m.d, 0) AS INTEGER) AS distance
FROM l JOIN f USING (line) LEFT JOIN e USING (line)
WHERE m IS NOT NULL OR doc_id <> first.id OR line_no <> first.line_no""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line, exactly or within two edits."""
    found = lines.report(read(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id").withColumnRenamed("of_id", "of_doc_id")


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those whose id hash is not 2 modulo 4."""
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs, remainder("doc_id", 4) != 2)
    return found.select(F.col("id").alias("doc_id"), F.coalesce(remainder("id", 4) == 2, F.lit(False)).alias("held_out"),
                        "lang_pred", "score")


@query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a suffix tree learned from those whose id hash is not 2 modulo 7."""
    found = pst.score(read(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return found.select(F.col("id").alias("doc_id"), F.coalesce(remainder("id", 7) == 2, F.lit(False)).alias("held_out"),
                        "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics of every document, and whether it passes the rules and its language's perplexity band."""
    return quality.judge(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document (or piece of one) in a sequence of 512 to 8192 words."""
    return packing.pack_documents(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op9_decontamination", r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     bk AS (SELECT item_id, w, least(len(w), 10) AS k FROM bw WHERE len(w) > 0),
     bwin AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
              FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
     ks AS (SELECT DISTINCT k FROM bwin),
     dwin AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
              FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
     found AS (SELECT doc_id, k, i, item_id FROM dwin JOIN bwin USING (k, g)),
     hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY 1),
     its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l
             FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a 10-word window of a benchmark item, and the items found."""
    found = decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels whose id hash is not 1 modulo 3."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.train(docs, labels, remainder("doc_id", 3) != 1))
    return found.select(F.col("id").alias("doc_id"), F.coalesce(remainder("id", 3) == 1, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op11_lexical_search", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     q AS (SELECT row_number() OVER () AS i, item_id,
                  list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
     qt AS (SELECT i, item_id, unnest(w) AS t FROM q),
     s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
     p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
     f AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY t),
     m AS (SELECT r, doc_id, t, tf, 10 + (90 * p.n * s.n) // s.l AS m FROM p, s),
     x AS (SELECT i, item_id, r, doc_id, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM qt JOIN m USING (t) JOIN f USING (t) GROUP BY ALL),
     o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
           FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""")
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    found = lexical.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("item", "item_id").withColumnRenamed("id", "doc_id")


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the damage rule."""
    rows = conversations.rows_of(read(spark, sf_dir, "conversations"), damaged=True)
    return conversations.report(rows).withColumnRenamed("conv", "conv_id")


@query("op13_warc", r"""
WITH p AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
     g AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p LEFT JOIN g USING (d)""")
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages written as WARC records and read back: payload digests, record types and what revisits refer to."""
    path = scratch_path(spark, "archive")
    warc.write_archive(read(spark, sf_dir, "pages"), path)
    return warc.digest_report(spark, path)
