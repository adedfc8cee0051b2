"""DuckDB SQL for the oracle check: the same fixtures and operators written as SQL text.

The fragments mirror ``folio.sources.fixtures`` and the operators; the fixed patterns are taken
from the same constants so that both engines apply identical rules.
"""

from __future__ import annotations

from folio.functions import text as T
from folio.operators import answers as A
from folio.operators import conversation as C
from folio.operators.bm25 import B, K1


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), {_lit(T.TOKEN_SPLIT)}), lambda t: t <> '')"


def clean(expr: str) -> str:
    def replaced(out: str, pattern: str, repl: str) -> str:
        for n in "123":
            repl = repl.replace("$" + n, chr(92) + n)
        return f"regexp_replace({out}, {_lit(pattern)}, {_lit(repl)}, 'g')"

    out = linked = replaced(expr, *T.HIDDEN_PARTS)
    for step in T.REFERENCE_STEPS:
        linked = replaced(linked, *step)
    out = f"CASE WHEN regexp_matches({out}, {_lit(T.DEFINITION)}) THEN {linked} ELSE {out} END"
    for step in T.CLEAN_STEPS[1:]:
        out = replaced(out, *step)
    names = ", ".join(f"{_lit(k)}: {_lit(v)}" for k, v in T.named_references().items())
    ref = f"regexp_extract(p, {_lit(T.REFERENCE)}, 1)"
    num = (f"(CASE WHEN lower(substr({ref}, 2, 1)) = 'x' THEN TRY_CAST('0x' || substr({ref}, 3) AS INTEGER) "
           f"ELSE TRY_CAST(substr({ref}, 2) AS INTEGER) END)")
    char = (f"CASE WHEN {num} BETWEEN 1 AND 55295 OR {num} BETWEEN 57344 AND 1114111 THEN chr({num}) "
            f"ELSE {_lit(T.REPLACEMENT)} END")
    value = f"CASE WHEN {ref} LIKE '#%' THEN {char} ELSE MAP {{{names}}}[{ref}] END"
    piece = f"CASE WHEN {ref} <> '' THEN coalesce({value} || substr(p, length({ref}) + 2), '&' || p) ELSE '&' || p END"
    parts = f"string_split({out}, '&')"
    decoded = f"{parts}[1] || array_to_string(list_transform({parts}[2:], lambda p: {piece}), '')"
    return f"trim(regexp_replace({decoded}, {_lit(T.WHITESPACE)}, ' ', 'g'))"


def bucket(expr: str, dim: int) -> str:
    return f"CAST((('0x' || substr(md5({expr}), 1, 8))::BIGINT % {dim}) AS INTEGER)"


CORPUS = """
c0 AS (
  SELECT doc_id AS corpus_id, text,
         source || '_' || CASE WHEN doc_id % 97 = 0 THEN 'draft'
                               ELSE CAST(2000 + doc_id % 24 AS VARCHAR) END AS doc_key
  FROM documents),
corpus_v AS (
  SELECT corpus_id, doc_key,
         CASE WHEN corpus_id % 89 = 0 THEN doc_key || '_' || CAST(corpus_id % 300 AS VARCHAR) || '.png'
              ELSE doc_key || '_page_' || CAST(corpus_id % 300 AS VARCHAR) || '.png' END AS image_filename,
         CASE WHEN corpus_id % 83 = 0 THEN NULL ELSE text END AS markdown_content
  FROM c0)"""

PAGE_ROWS = CORPUS + f""",
pr0 AS (
  SELECT *, TRY_CAST(right(doc_key, 4) AS INTEGER) AS y FROM corpus_v),
page_rows AS (
  SELECT corpus_id, doc_key AS doc_id,
         TRY_CAST(regexp_extract(image_filename, {_lit(T.PAGE_PATTERN)}, 1) AS INTEGER) AS page,
         image_filename AS exact_filename,
         CASE WHEN y IS NOT NULL THEN [y, y - 1, y - 2, y - 3] END AS probable_referenced_years,
         markdown_content,
         {clean('markdown_content')} AS text_content
  FROM pr0),
validated AS (
  SELECT *, concat_ws(';',
      CASE WHEN corpus_id IS NULL THEN 'null_id' END,
      CASE WHEN doc_id IS NULL THEN 'null_doc_id' END,
      CASE WHEN probable_referenced_years IS NULL THEN 'bad_year' END,
      CASE WHEN page IS NULL THEN 'no_page' END,
      CASE WHEN exact_filename IS NULL THEN 'null_filename' END,
      CASE WHEN markdown_content IS NULL THEN 'null_content' END) AS reject_reason
  FROM page_rows),
pages_v AS (
  SELECT corpus_id, doc_id, page, exact_filename, probable_referenced_years, markdown_content, text_content
  FROM validated WHERE reject_reason = '')"""

QUESTIONS = """
questions_v AS (
  SELECT item_id AS query_id, text AS original, lower(text) || ' in the annual report' AS rephrase_level_1,
         regexp_replace(text, '[.,;:!?]', '', 'g') AS rephrase_level_2,
         CASE WHEN item_id % 5 <> 0 THEN text || ' Which report says so?' END AS rephrase_level_3,
         CASE WHEN item_id % 2 = 0 THEN CAST(2000 + item_id % 24 AS INTEGER) END AS year
  FROM benchmark),
answers_v AS (
  SELECT b.item_id AS query_id, d.doc_id AS corpus_id, b.text AS answer
  FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
joined_v AS (
  SELECT a.query_id, a.corpus_id, a.answer, q.original, q.rephrase_level_1, q.rephrase_level_2,
         q.rephrase_level_3
  FROM answers_v a JOIN questions_v q ON a.query_id = q.query_id),
testset_v AS (
  SELECT query_id, 'original' AS difficulty, original AS query_text, answer FROM joined_v
  UNION ALL SELECT query_id, 'level_1', rephrase_level_1, answer FROM joined_v
  UNION ALL SELECT query_id, 'level_2', rephrase_level_2, answer FROM joined_v
  UNION ALL SELECT query_id, 'level_3', rephrase_level_3, answer FROM joined_v)"""

# Full-text index over pages_v.text_content: postings, doc stats, terms.
INDEX = f"""
doc_toks AS (
  SELECT corpus_id, {tokens('text_content')} AS toks FROM pages_v),
postings_v AS (
  SELECT t.term, d.corpus_id, CAST(count(*) AS INTEGER) AS tf, CAST(len(d.toks) AS INTEGER) AS dl
  FROM doc_toks d, unnest(d.toks) AS t(term)
  GROUP BY t.term, d.corpus_id, len(d.toks)),
stats_v AS (
  SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM doc_toks WHERE len(toks) > 0),
terms_v AS (
  SELECT term, count(*) AS df,
         ln(1 + ((SELECT n_docs FROM stats_v) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
  FROM postings_v GROUP BY term),
year_index_v AS (
  SELECT DISTINCT unnest(probable_referenced_years) AS year, corpus_id FROM pages_v)"""


def bm25_hits(queries_cte: str, keys: str, text_col: str, year_col: str | None) -> str:
    """SQL text of a CTE ``bm25_scored(keys..., corpus_id, score[, year])``."""
    yr = f", q.{year_col}" if year_col else ""
    yr_sel = f", {year_col}" if year_col else ""
    key_list = ", ".join(f"q.{k.strip()}" for k in keys.split(","))
    return f"""
qterms AS (
  SELECT DISTINCT {keys}{yr_sel}, unnest({tokens(text_col)}) AS term FROM {queries_cte}),
bm25_raw AS (
  SELECT {key_list}{yr}, p.corpus_id,
         sum(t.idf * p.tf / (p.tf + {K1} * (1 - {B} + {B} * p.dl / (SELECT avgdl FROM stats_v)))) AS score
  FROM qterms q JOIN terms_v t ON q.term = t.term JOIN postings_v p ON p.term = q.term
  GROUP BY ALL)"""


def embedding(table: str, id_col: str, text_col: str, name: str, dim: int = 64) -> str:
    """CTE ``name(id, bucket, w)``: the hashed embedder over ``table.text_col``."""
    return f"""
{name}_c AS (
  SELECT x.{id_col} AS id, {bucket('t.term', dim)} AS bucket, CAST(count(*) AS DOUBLE) AS c
  FROM {table} x, unnest(regexp_split_to_array(lower(x.{text_col}), {_lit(T.TOKEN_SPLIT)})) AS t(term)
  WHERE t.term <> ''
  GROUP BY ALL),
{name} AS (
  SELECT id, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM {name}_c)"""


def distinct_ordered(expr: str) -> str:
    """Order-preserving list dedupe (first occurrence wins), like Spark's array_distinct."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def hybrid(top_k: int, year: bool, stage: str, hq: str | None = None, prefix: str = "", payload: str = "true") -> str:
    """SQL for the hybrid retrieval of every question; ``stage`` picks the output:
    variants, hits, fused, rerank, final, or none (CTEs only, ending with ``reranked``).
    ``hq`` replaces the question CTE ``hq(query_id, text, year)``; ``prefix`` adds CTEs first;
    ``payload`` is a condition on the points."""
    ws = _lit(T.WHITESPACE)
    limit = top_k * 5
    k = top_k * 3
    yq = "year" if year else "CAST(NULL AS INTEGER) AS year"
    kw = f"array_to_string(list_filter({distinct_ordered(tokens('text'))}, lambda t: length(t) >= 4), ' ')"
    hq = hq or f"hq AS (SELECT query_id, original AS text, {yq} FROM questions_v WHERE original IS NOT NULL)"
    return f"""WITH {PAGE_ROWS}, {INDEX}, {QUESTIONS}, {TURNS}, {prefix}
{hq},
resp AS (
  SELECT query_id, text, year,
         concat_ws(chr(10), {kw}, lower(regexp_replace(text, {ws}, ' ', 'g')),
                   regexp_replace(text, {ws}, ' ', 'g')) AS r
  FROM hq),
lines AS (
  SELECT query_id, year,
         list_concat([text], list_filter(list_transform(string_split(r, chr(10)), lambda s: trim(s, ' ')),
                                         lambda s: s <> '')) AS l
  FROM resp),
dl AS (SELECT query_id, year, {distinct_ordered('l')} AS l2 FROM lines),
variants AS (
  SELECT query_id, year, unnest(l2) AS variant_text, CAST(unnest(range(0, len(l2))) AS INTEGER) AS variant_no
  FROM dl),
vk AS (SELECT CAST(query_id AS VARCHAR) || '#' || CAST(variant_no AS VARCHAR) AS vkey, * FROM variants),
{embedding('vk', 'vkey', 'variant_text', 'qemb')},
live AS (SELECT * FROM vk WHERE vkey IN (SELECT id FROM qemb)),
{bm25_hits('live', 'query_id, variant_no', 'variant_text', 'year')},
bfilt AS (
  SELECT * FROM bm25_raw h
  WHERE h.year IS NULL OR EXISTS (SELECT 1 FROM year_index_v y WHERE y.corpus_id = h.corpus_id AND y.year = h.year)),
branked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY round(score, 6) DESC, corpus_id) AS rank
  FROM bfilt),
{embedding('pages_v', 'corpus_id', 'markdown_content', 'pemb')},
pvec AS (SELECT corpus_id, probable_referenced_years AS years FROM pages_v
         WHERE corpus_id IN (SELECT id FROM pemb) AND {payload}),
vdot AS (SELECT q.id AS vkey, p.id AS corpus_id, sum(q.w * p.w) AS dot
         FROM qemb q JOIN pemb p ON q.bucket = p.bucket GROUP BY ALL),
vpairs AS (
  SELECT l.query_id, l.variant_no, pg.corpus_id, coalesce(d.dot, 0.0) AS score
  FROM live l CROSS JOIN pvec pg LEFT JOIN vdot d ON d.vkey = l.vkey AND d.corpus_id = pg.corpus_id
  WHERE l.year IS NULL OR list_contains(pg.years, l.year)),
vranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY round(score, 6) DESC, corpus_id) AS rank
  FROM vpairs),
hits AS (
  SELECT query_id, variant_no, 'bm25' AS source, CAST(rank - 1 AS INTEGER) AS rank0, corpus_id, score
  FROM branked WHERE rank <= {limit}
  UNION ALL
  SELECT query_id, variant_no, 'vector', CAST(rank - 1 AS INTEGER), corpus_id, score
  FROM vranked WHERE rank <= {limit}),
fused0 AS (
  SELECT query_id, corpus_id, sum(1.0::DOUBLE / ({k} + rank0 + 1)) AS rrf_score
  FROM hits WHERE corpus_id IS NOT NULL GROUP BY ALL),
fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, corpus_id) AS fused_rank
  FROM fused0),
rr0 AS (
  SELECT f.*, p.markdown_content, p.exact_filename AS source, {distinct_ordered(tokens('q.text'))} AS qt,
         {tokens('p.markdown_content')} AS pt
  FROM fused f JOIN hq q ON f.query_id = q.query_id JOIN pages_v p ON p.corpus_id = f.corpus_id),
rr1 AS (
  SELECT *, CASE WHEN len(qt) > 0 THEN
              CAST(len(list_filter(qt, lambda t: list_contains(pt, t))) AS DOUBLE) / len(qt) END AS rerank_score
  FROM rr0),
reranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 6) DESC NULLS LAST, fused_rank)
            AS rank
  FROM rr1)
""" + {
        "variants": "SELECT query_id, variant_no, variant_text FROM variants",
        "hits": "SELECT query_id, variant_no, source, rank0, corpus_id, round(score, 4) AS score FROM hits",
        "fused": "SELECT query_id, corpus_id, round(rrf_score, 6) AS rrf_score, fused_rank FROM fused",
        "rerank": f"""SELECT query_id, rank, corpus_id, round(rerank_score, 4) AS rerank_score, fused_rank
FROM reranked WHERE rank <= {top_k}""",
        "none": "",
        "final": f"""SELECT query_id, rank, corpus_id, source, markdown_content, round(rerank_score, 4) AS rerank_score,
       round(rrf_score, 6) AS rrf_score, fused_rank
FROM reranked WHERE rank <= {top_k}""",
    }[stage]


TURNS = """
t0 AS (
  SELECT conv_id, turn, role, text,
         CASE WHEN role <> 'user' THEN NULL
              WHEN (conv_id * 7 + turn * 3) % 5 = 0 THEN 'SET'
              WHEN (conv_id * 7 + turn * 3) % 5 = 1 THEN 'RELATIVE'
              WHEN (conv_id * 7 + turn * 3) % 11 = 2 THEN 'CLEAR'
              ELSE 'KEEP' END AS a
  FROM conversations),
turns_v AS (
  SELECT conv_id AS thread_id, CAST(turn AS INTEGER) AS turn, role,
         CASE a WHEN 'SET' THEN text || ' What was the revenue in ' || CAST(2000 + (conv_id + turn) % 24 AS VARCHAR) || '?'
                WHEN 'RELATIVE' THEN text || ' And the year before?'
                WHEN 'CLEAR' THEN text || ' On another subject: who leads the board?'
                ELSE text END AS content
  FROM t0)"""


def mention_of(expr: str) -> str:
    return f"TRY_CAST(regexp_extract({expr}, {_lit(T.YEAR_MENTION)}, 1) AS INTEGER)"


def year_of(expr: str) -> str:
    fiscal = f"TRY_CAST(regexp_extract({expr}, {_lit(T.FISCAL_YEAR)}, 1) AS INTEGER)"
    return (f"coalesce({mention_of(expr)}, CASE WHEN {fiscal} >= 100 THEN {fiscal} "
            f"WHEN {fiscal} >= {T.CENTURY_PIVOT} THEN {fiscal} + 1900 ELSE {fiscal} + 2000 END)")


def rlike(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {_lit(pattern)})"


def first_sentence(expr: str) -> str:
    return f"trim(regexp_extract({expr}, {_lit(A.FIRST_SENTENCE)}, 1))"


def route_cols(expr: str) -> str:
    fin = f"coalesce({rlike(expr, C.FINANCIAL_TERMS)}, false)"
    need = f"coalesce(NOT {rlike(expr, C.NO_RETRIEVAL)}, false)"
    return (f"{fin} AS is_financial, {need} AS needs_retrieval, "
            f"CASE WHEN {fin} AND {need} THEN 'retrieve' ELSE 'answer' END AS route")


def action_sql(expr: str) -> str:
    return f"""CASE WHEN {year_of(expr)} IS NOT NULL THEN 'SET'
             WHEN {rlike(expr, C.RELATIVE_BACK)} THEN 'RELATIVE'
             WHEN {rlike(expr, C.RELATIVE_FORWARD)} THEN 'RELATIVE'
             WHEN {rlike(expr, C.TOPIC_CHANGE)} THEN 'CLEAR' ELSE 'KEEP' END"""


def shift_sql(expr: str) -> str:
    return f"""CASE WHEN {year_of(expr)} IS NOT NULL THEN 0
             WHEN {rlike(expr, C.RELATIVE_BACK)} THEN -1
             WHEN {rlike(expr, C.RELATIVE_FORWARD)} THEN 1 ELSE 0 END"""


def last_messages(n: int) -> str:
    return f"""
lm0 AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY turn DESC) AS back FROM turns_v),
lm AS (SELECT * FROM lm0 WHERE back <= {n})"""
