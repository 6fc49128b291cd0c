"""DuckDB SQL building blocks for the independent oracle of each query.

Written separately from the Spark code (different regex engine, joins
instead of in-row arrays) so that agreement means something.
"""

from __future__ import annotations

from wordloom.sources.corpus import default_stopwords

# word delimiter class as a SQL string literal body (quote doubled)
D = r"""[ \t,:;(){}\[\]<>"''’/\\%#$&~*+=^_]"""
UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LO = "abcdefghijklmnopqrstuvwxyz"


def stops_sql(stops=None) -> str:
    s = default_stopwords() if stops is None else stops
    return "[" + ", ".join("'" + w + "'" for w in s) + "]::VARCHAR[]"


def lower(x: str) -> str:
    return f"translate({x}, '{UP}', '{LO}')"


def clean(x: str) -> str:
    return (f"CASE WHEN right({x}, 1) IN ('.', '?', '!', chr(10), chr(13)) "
            f"THEN left({x}, length({x}) - 1) ELSE {x} END")


def corpus_ctes(table: str = "documents", stops=None, low: int = 5, ratio: float = 0.01) -> str:
    """CTEs: chunks, raw, cleaned, sents, kept, wf, high, low_w, removed, vocab,
    pairs, und, counts, targets."""
    st = stops_sql(stops)
    return rf"""
chunks AS (
  SELECT doc_id, unnest(arr) AS chunk, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS sid
  FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text || chr(10),
          '([.?!\r])({D})', '\1' || chr(1) || '\2', 'g'), '\n', chr(10) || chr(1), 'g'), chr(1)) AS arr
        FROM {table})),
raw AS (
  SELECT doc_id, sid, list_filter(regexp_split_to_array(chunk, '{D}+'), lambda x: x <> '') AS toks
  FROM chunks),
cleaned AS (
  SELECT doc_id, sid, CAST(len(toks) AS BIGINT) AS n_raw,
         list_transform(list_transform(toks, lambda t: {lower('t')}), lambda t: {clean('t')}) AS cl
  FROM raw),
sents AS (
  SELECT doc_id, sid, n_raw,
         list_filter(cl, lambda w: regexp_full_match(w, '[a-z-]{{3,}}') AND NOT list_contains({st}, w)) AS words
  FROM cleaned),
kept AS (
  SELECT doc_id, sid, unnest(words) AS word, CAST(generate_subscripts(words, 1) - 1 AS BIGINT) AS pos
  FROM sents WHERE len(words) > 0),
wf AS (SELECT word, count(*) AS freq FROM kept GROUP BY word),
high AS (
  SELECT word, freq FROM (
    SELECT word, freq, row_number() OVER (ORDER BY freq DESC, word DESC) - 1 AS r FROM wf)
  WHERE r < (SELECT CAST(floor(CAST(count(*) AS DOUBLE) * {ratio}) AS BIGINT) FROM wf)),
low_w AS (SELECT word, freq FROM wf WHERE freq < {low} AND word NOT IN (SELECT word FROM high)),
removed AS (SELECT word, freq, 'high' AS reason FROM high UNION ALL SELECT word, freq, 'low' FROM low_w),
vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY word) - 1 AS BIGINT) AS idx, word, freq
  FROM wf WHERE word NOT IN (SELECT word FROM removed)),
pairs AS (
  SELECT a.doc_id, a.sid, a.pos, a.pos - b.pos AS dist, a.word AS center, b.word AS context
  FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND a.sid = b.sid
   AND b.pos BETWEEN a.pos - 4 AND a.pos - 1
  WHERE a.word <> b.word),
und AS (SELECT least(center, context) AS a, greatest(center, context) AS b, count(*) AS freq
        FROM pairs GROUP BY 1, 2),
counts AS (SELECT a AS center, b AS context, freq FROM und UNION ALL SELECT b, a, freq FROM und),
targets AS (
  SELECT vc.idx AS center_idx, c.center, vx.idx AS context_idx, c.context, c.freq
  FROM counts c JOIN vocab vc ON vc.word = c.center JOIN vocab vx ON vx.word = c.context)
"""


def with_corpus(select: str, extra_ctes: str = "", pre: str = "", **kw) -> str:
    ctes = corpus_ctes(**kw)
    if pre:
        ctes = pre + ",\n" + ctes
    if extra_ctes:
        ctes = ctes + ",\n" + extra_ctes
    return "WITH " + ctes + "\n" + select


def u(stream: str, *keys: str, seed: int = 0, open0: bool = False) -> str:
    from wordloom.functions.hashing import sql_uniform
    return sql_uniform(seed, stream, *keys, open0=open0)


def draw(stream: str, *keys: str, number: str, seed: int = 0, open0: bool = False) -> str:
    from wordloom.functions.hashing import sql_draw
    return sql_draw(seed, stream, *keys, number=number, open0=open0)


def model_ctes(hidden: int = 50, seed: int = 0) -> str:
    """model_in / model_out: hash-seeded Xavier rows over ``vocab``."""
    from wordloom.functions.hashing import sql_uniform_vector

    def m(stream):
        return (f"SELECT idx, word, list_transform({sql_uniform_vector(seed, stream, hidden, 'idx')}, lambda x: "
                f"(x * 2.0::DOUBLE - 1.0::DOUBLE) * "
                f"sqrt(2.0::DOUBLE / CAST(nv.n + nv.n AS DOUBLE))) AS vec FROM vocab, nv")
    return (f"nv AS (SELECT count(*) AS n FROM vocab),\n"
            f"model_in AS ({m('ih')}),\nmodel_out AS ({m('ho')})")


def qstatus_ctes() -> str:
    return rf"""qstatus AS (
  SELECT q.item_id, q.line_no, q.word,
    CASE WHEN NOT regexp_full_match(q.word, '[a-z-]{{3,}}') THEN 'shape'
         WHEN list_contains({stops_sql()}, q.word) THEN 'stop'
         WHEN q.word IN (SELECT word FROM removed) THEN 'filtered'
         WHEN v.idx IS NULL THEN 'oov' ELSE 'ok' END AS status,
    v.idx
  FROM qwords q LEFT JOIN vocab v ON v.word = q.word),
qids AS (SELECT DISTINCT idx FROM qstatus WHERE status = 'ok')"""


COLLAPSE_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def collapse_sql(x: str) -> str:
    """RE2 has no back-references: one replace per letter, as the shell loop does."""
    for c in COLLAPSE_LETTERS:
        x = f"regexp_replace({x}, '{c}{{3,}}', '{c}{c}', 'g')"
    return x


QA_CTES = r"""
qal AS (
  SELECT u.conv_id, u.turn,
         regexp_replace(u.text, '[\r\n]+', ' ', 'g') || ' =~=~> ' || regexp_replace(a.text, '[\r\n]+', ' ', 'g') AS line
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'),
qac AS (
  SELECT conv_id, turn, """ + collapse_sql(
    "regexp_replace(" + lower("line") + r", '[^\w\s|\x08=~>]', '', 'g')") + r""" AS line FROM qal),
qas AS (
  SELECT conv_id, turn,
         regexp_replace(regexp_extract(line, '^(.*) =~=~>', 1), ' =~=~>', '', 'g') AS question,
         regexp_replace(regexp_extract(line, '(=~=~>.*)$', 1), '=~=~> ', '', 'g') AS answer
  FROM qac WHERE regexp_matches(line, '^.* =~=~>') AND regexp_matches(line, '=~=~>')),
qdocs AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS doc_id, question AS text FROM qas)"""
