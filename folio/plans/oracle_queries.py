"""DuckDB SQL per registered query (same names as :data:`folio.plans.registry.QUERIES`)."""

from __future__ import annotations

from folio.operators import answers as A
from folio.operators import vectors
from folio.plans import oracle as O

SQL: dict[str, str] = {}

SQL["corpus_scan"] = f"""WITH {O.CORPUS}
SELECT corpus_id, doc_key, image_filename,
       CAST(CASE WHEN corpus_id % 83 = 0 THEN NULL ELSE octet_length(encode(markdown_content)) END AS BIGINT)
         AS image_bytes
FROM corpus_v"""

SQL["embeddable_pages"] = f"""WITH {O.PAGE_ROWS}
SELECT corpus_id, exact_filename FROM page_rows
WHERE markdown_content IS NOT NULL AND corpus_id IS NOT NULL"""

SQL["append_pages"] = f"""WITH {O.PAGE_ROWS}
SELECT * FROM pages_v WHERE corpus_id % 3 <> 0"""

SQL["insert_if_absent"] = f"""WITH {O.PAGE_ROWS},
rows AS (SELECT DISTINCT corpus_id, doc_id, page, exact_filename, probable_referenced_years, markdown_content
         FROM page_rows),
stored AS (SELECT corpus_id, doc_id, CASE WHEN corpus_id % 2 = 0 THEN page + 1 ELSE page END AS page,
                  exact_filename, probable_referenced_years, markdown_content
           FROM rows WHERE corpus_id % 3 = 0)
SELECT * FROM rows r WHERE NOT EXISTS (
  SELECT 1 FROM stored s
  WHERE r.corpus_id IS NOT DISTINCT FROM s.corpus_id AND r.doc_id IS NOT DISTINCT FROM s.doc_id
    AND r.page IS NOT DISTINCT FROM s.page AND r.exact_filename IS NOT DISTINCT FROM s.exact_filename
    AND r.probable_referenced_years IS NOT DISTINCT FROM s.probable_referenced_years
    AND r.markdown_content IS NOT DISTINCT FROM s.markdown_content)"""

SQL["skip_existing"] = f"""WITH {O.CORPUS}
SELECT corpus_id, image_filename FROM corpus_v WHERE corpus_id % 3 <> 0"""

SQL["derive_years"] = f"""WITH {O.CORPUS},
y AS (SELECT corpus_id, doc_key, TRY_CAST(right(doc_key, 4) AS INTEGER) AS y FROM corpus_v)
SELECT corpus_id, doc_key, CASE WHEN y IS NOT NULL THEN [y, y - 1, y - 2, y - 3] END
       AS probable_referenced_years FROM y"""

SQL["derive_page"] = f"""WITH {O.CORPUS}
SELECT corpus_id, image_filename,
       TRY_CAST(regexp_extract(image_filename, '_page_([0-9]+)', 1) AS INTEGER) AS page FROM corpus_v"""

SQL["first_n"] = f"""WITH {O.CORPUS},
cut AS (SELECT corpus_id, doc_key, image_filename FROM corpus_v ORDER BY corpus_id LIMIT 10),
y AS (SELECT *, TRY_CAST(right(doc_key, 4) AS INTEGER) AS y FROM cut)
SELECT corpus_id, doc_key, image_filename,
       CASE WHEN y IS NOT NULL THEN [y, y - 1, y - 2, y - 3] END AS probable_referenced_years,
       TRY_CAST(regexp_extract(image_filename, '_page_([0-9]+)', 1) AS INTEGER) AS page
FROM y"""

SQL["clean_text"] = f"""SELECT page_id, {O.clean('html')} AS text_content FROM pages"""

SQL["validate_pages"] = f"""WITH {O.PAGE_ROWS}
SELECT corpus_id, page, probable_referenced_years, reject_reason FROM validated"""

SQL["testset_join"] = f"""WITH {O.QUESTIONS}
SELECT * FROM joined_v"""

SQL["testset_unpivot"] = f"""WITH {O.QUESTIONS}
SELECT * FROM testset_v"""

SQL["build_postings"] = f"""WITH {O.PAGE_ROWS}, {O.INDEX}
SELECT term, corpus_id, tf, dl FROM postings_v"""

SQL["term_stats"] = f"""WITH {O.PAGE_ROWS}, {O.INDEX}
SELECT term, df, round(idf, 6) AS idf, (SELECT n_docs FROM stats_v) AS n_docs,
       round((SELECT avgdl FROM stats_v), 6) AS avgdl
FROM terms_v"""

_BM25_Q = """
bq AS (SELECT query_id, original AS text, year FROM questions_v)"""

SQL["bm25_topk"] = f"""WITH {O.PAGE_ROWS}, {O.INDEX}, {O.QUESTIONS}, {_BM25_Q}, {O.bm25_hits('bq', 'query_id', 'text', None)},
ranked AS (
  SELECT query_id, corpus_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, corpus_id) AS rank
  FROM bm25_raw)
SELECT query_id, rank, corpus_id, round(score, 4) AS score FROM ranked WHERE rank <= 10"""

SQL["bm25_topk_appended"] = SQL["bm25_topk"]

SQL["bm25_topk_year"] = f"""WITH {O.PAGE_ROWS}, {O.INDEX}, {O.QUESTIONS}, {_BM25_Q}, {O.bm25_hits('bq', 'query_id', 'text', 'year')},
filtered AS (
  SELECT * FROM bm25_raw h
  WHERE h.year IS NULL OR EXISTS (SELECT 1 FROM year_index_v y WHERE y.corpus_id = h.corpus_id AND y.year = h.year)),
ranked AS (
  SELECT query_id, corpus_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, corpus_id) AS rank
  FROM filtered)
SELECT query_id, rank, corpus_id, round(score, 4) AS score FROM ranked WHERE rank <= 10"""

_VEC = """
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label, 2000 + vec_id % 24 AS y,
             CASE WHEN vec_id % 2 = 0 THEN 2000 + (vec_id + 5) % 24 END AS qy FROM embeddings),
v2 AS (SELECT *, sqrt(list_dot_product(e, e)) AS n, [y, y - 1, y - 2, y - 3] AS years FROM v)"""


def _vec_topk(year: bool) -> str:
    cond = " AND (q.qy IS NULL OR list_contains(p.years, q.qy))" if year else ""
    return f"""WITH {_VEC},
pairs AS (
  SELECT q.id AS query_id, p.id, list_dot_product(q.e, p.e) / (q.n * p.n) AS score
  FROM v2 q JOIN v2 p ON q.id <> p.id
  WHERE q.n > 0 AND p.n > 0{cond}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank
           FROM pairs)
SELECT query_id, rank, id, round(score, 4) AS score FROM ranked WHERE rank <= 10"""


SQL["vector_topk"] = _vec_topk(False)
SQL["vector_topk_filtered"] = _vec_topk(True)



def _lsh_sql(tables: int, bits: int, dim: int = 64) -> str:
    planes = vectors.hyperplanes(tables, bits, dim)
    codes = ", ".join(
        f"{{'t': {t}, 'c': " + " + ".join(
            f"CASE WHEN list_dot_product(e, CAST({p} AS DOUBLE[])) >= 0 THEN {1 << b} ELSE 0 END" for b, p in enumerate(table)
        ) + "}" for t, table in enumerate(planes))
    return f"""WITH {_VEC},
placed AS (SELECT id, unnest([{codes}], recursive := true) FROM v2 WHERE n > 0),
near AS (SELECT DISTINCT q.id AS query_id, p.id FROM placed q JOIN placed p ON q.t = p.t AND q.c = p.c WHERE q.id <> p.id),
pairs AS (SELECT query_id, x.id, list_dot_product(q.e, p.e) / (q.n * p.n) AS score
          FROM near x JOIN v2 q ON q.id = x.query_id JOIN v2 p ON p.id = x.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM pairs)
SELECT query_id, rank, id, round(score, 4) AS score FROM ranked WHERE rank <= 10"""


# As in the registered query.
SQL["vector_topk_lsh"] = _lsh_sql(24, 4)

SQL["filter_any_field"] = f"""WITH {_VEC}
SELECT id, label, CAST(years AS INTEGER[]) AS years FROM v2 WHERE label = 1 AND list_contains(years, 2010)"""

SQL["filter_year"] = f"""WITH {O.PAGE_ROWS}
SELECT corpus_id, probable_referenced_years FROM pages_v WHERE list_contains(probable_referenced_years, 2013)"""

SQL["embed_text"] = f"""WITH {O.PAGE_ROWS}, {O.embedding('pages_v', 'corpus_id', 'markdown_content', 'emb')}
SELECT id, bucket, round(w, 6) AS w FROM emb"""

SQL["build_points"] = f"""WITH {O.PAGE_ROWS}, {O.embedding('pages_v', 'corpus_id', 'markdown_content', 'emb')},
n AS (SELECT id, CAST(count(*) AS BIGINT) AS n_entries FROM emb GROUP BY id)
SELECT p.corpus_id AS id, p.doc_id, p.page, p.exact_filename, p.probable_referenced_years, n.n_entries
FROM pages_v p JOIN n ON p.corpus_id = n.id"""

SQL["vector_upsert"] = f"""WITH {O.PAGE_ROWS}, {O.embedding('pages_v', 'corpus_id', 'markdown_content', 'emb')},
{O.embedding('pages_v', 'corpus_id', 'text_content', 'emb_t')},
n AS (SELECT id, CAST(count(*) AS BIGINT) AS n_entries FROM emb GROUP BY id),
nt AS (SELECT id, CAST(count(*) AS BIGINT) AS n_entries FROM emb_t WHERE id % 4 = 0 GROUP BY id)
SELECT id, 'markdown' AS origin, n_entries FROM n WHERE id NOT IN (SELECT id FROM nt)
UNION ALL SELECT id, 'text', n_entries FROM nt"""

SQL["vector_table_init"] = """SELECT DISTINCT CAST(unnest([y, y - 1, y - 2, y - 3]) AS INTEGER) AS year, id
FROM (SELECT vec_id AS id, 2000 + vec_id % 24 AS y FROM embeddings)"""

SQL["query_variants"] = O.hybrid(5, False, "variants")
SQL["hybrid_hits"] = O.hybrid(5, False, "hits")
SQL["rrf_fuse"] = O.hybrid(5, False, "fused")
SQL["rerank"] = O.hybrid(5, False, "rerank")
SQL["hybrid_retrieve"] = O.hybrid(5, False, "final")
SQL["hybrid_retrieve_year"] = O.hybrid(3, True, "final")
SQL["hybrid_retrieve_filtered"] = O.hybrid(
    5, True, "final", payload="doc_id = 'src3_2013' AND list_contains(probable_referenced_years, 2013)",
    hq="hq AS (SELECT query_id, original AS text, CAST(2013 AS INTEGER) AS year FROM questions_v WHERE original IS NOT NULL)")

SQL["extract_year"] = f"""WITH {O.TURNS}
SELECT thread_id, turn, {O.mention_of('content')} AS year FROM turns_v WHERE role = 'user'"""

_STICKY = f"""
a AS (
  SELECT thread_id, turn, {O.action_sql('content')} AS action, {O.year_of('content')} AS y,
         {O.shift_sql('content')} AS shift
  FROM turns_v WHERE role = 'user'),
s AS (SELECT *, sum(CASE WHEN action IN ('SET', 'CLEAR') THEN 1 ELSE 0 END)
                   OVER (PARTITION BY thread_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS seg FROM a),
b AS (SELECT *, max(CASE WHEN action = 'SET' THEN y END) OVER (PARTITION BY thread_id, seg) AS base,
             sum(shift) OVER (PARTITION BY thread_id, seg ORDER BY turn ROWS UNBOUNDED PRECEDING) AS sh FROM s),
sticky AS (SELECT thread_id, turn, action, CAST(base + sh AS INTEGER) AS year FROM b)"""

SQL["sticky_year"] = f"""WITH {O.TURNS}, {_STICKY}
SELECT thread_id, turn, action, year FROM sticky"""

SQL["route_queries"] = f"""WITH {O.TURNS}
SELECT thread_id, turn, {O.route_cols('content')} FROM turns_v WHERE role = 'user'"""

SQL["last_user_message"] = f"""WITH {O.TURNS}
SELECT thread_id, max(turn) AS turn, arg_max(content, turn) AS content FROM turns_v WHERE role = 'user'
GROUP BY thread_id"""

SQL["transcript"] = f"""WITH {O.TURNS}, {O.last_messages(5)}
SELECT thread_id, string_agg(CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'AI'
                                       WHEN 'system' THEN 'System' ELSE role END
                             || ': ' || coalesce(content, ''), chr(10) ORDER BY turn) AS transcript
FROM lm GROUP BY thread_id"""

SQL["history_lines"] = f"""WITH {O.TURNS}, {O.last_messages(5)}
SELECT thread_id, string_agg(coalesce(role, 'unknown') || ': ' || coalesce(content, ''), chr(10) ORDER BY turn)
       AS history
FROM lm GROUP BY thread_id"""

_DIRECT = """
lu AS (SELECT thread_id, arg_max(content, turn) AS content FROM turns_v WHERE role = 'user' GROUP BY thread_id),
rec AS (SELECT thread_id, 'Answer: ' || {fs} || chr(10) || 'Reasoning: Answered from the dialogue.' || chr(10)
               || 'Sources summary: dialogue' || chr(10) || 'Sources: dialogue' AS record FROM lu)"""

SQL["history_record"] = f"""WITH {O.TURNS}, {_DIRECT.format(fs=O.first_sentence('content'))}
SELECT thread_id, record FROM rec"""

SQL["trim_history"] = f"""WITH {O.TURNS}, {O.last_messages(4)}, {_DIRECT.format(fs=O.first_sentence('content'))},
mx AS (SELECT thread_id, max(turn) AS mt FROM turns_v GROUP BY thread_id)
SELECT thread_id, turn, role, content FROM lm
UNION ALL
SELECT r.thread_id, CAST(m.mt + 1 AS INTEGER), 'assistant', r.record FROM rec r JOIN mx m ON r.thread_id = m.thread_id"""

SQL["judge_parse"] = """WITH r AS (
  SELECT doc_id AS row_id,
         CASE WHEN doc_id % 13 = 0 THEN '{"reasoning": "cut off'
              WHEN doc_id % 17 = 0 THEN '{"reasoning": "off scale", "answer_accuracy": 3}'
              ELSE '{"reasoning": "label ' || CAST(quality AS VARCHAR) || '/' || CAST(toxic AS VARCHAR)
                   || '", "answer_accuracy": ' || CAST(CASE WHEN toxic = 1 THEN 2 ELSE quality * 4 END AS VARCHAR) || '}'
         END AS raw
  FROM labels),
p AS (SELECT row_id,
             CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.reasoning') END AS reasoning,
             CASE WHEN json_valid(raw) THEN TRY_CAST(json_extract(raw, '$.answer_accuracy') AS INTEGER) END AS acc
      FROM r)
SELECT row_id,
       CASE WHEN acc IS NULL THEN 'judge output could not be parsed'
            WHEN acc NOT IN (0, 2, 4) THEN 'rating out of scale: ' || CAST(acc AS VARCHAR)
            ELSE coalesce(reasoning, '') END AS reasoning,
       CAST(CASE WHEN acc IN (0, 2, 4) THEN acc ELSE 0 END AS INTEGER) AS answer_accuracy
FROM p"""


def _ctx_sql(ret: str, keys: str) -> str:
    """CTE ``ctx(query_id, context)`` from retrieved rows ``ret`` for the keys of ``keys``."""
    return f"""
ctx0 AS (SELECT query_id, string_agg('[' || CAST(rank AS VARCHAR) || '] ' || source || chr(10) || markdown_content,
                                     chr(10) || chr(10) ORDER BY rank) AS context
         FROM {ret} GROUP BY query_id),
ctx AS (SELECT k.query_id, coalesce(c.context, {O._lit(A.NO_CONTEXT)}) AS context
        FROM {keys} k LEFT JOIN ctx0 c ON k.query_id = c.query_id)"""


SQL["assemble_context"] = O.hybrid(3, True, "none") + f""",
ret AS (SELECT * FROM reranked WHERE rank <= 3), {_ctx_sql('ret', 'hq')}
SELECT query_id, context FROM ctx"""


def _answer_sql(src: str, thread: bool = False, prefix: str = "") -> str:
    """CTEs ending in ``ans(query_id, is_financial, route, year, prompt, logic_steps,
    generated_response, summary_sources, sources)`` for questions ``src(query_id, text)``, with
    ``(year, search_text, dialogue)`` of their own if ``thread``."""
    own = "year, search_text, dialogue" if thread else (
        f"{O.year_of('text')} AS year, text AS search_text, 'Human: ' || coalesce(text, '') AS dialogue")
    hq = f"""aq AS (SELECT query_id, text, {own}, {O.route_cols('text')} FROM {src}),
hq AS (SELECT query_id, search_text AS text, year FROM aq WHERE route = 'retrieve')"""
    persona = (f"CASE WHEN coalesce(is_financial, false) THEN {O._lit(A.PERSONA_FINANCIAL)} "
               f"ELSE {O._lit(A.PERSONA_GENERAL)} END")
    return O.hybrid(3, True, "none", hq=hq, prefix=prefix) + f""",
ret AS (SELECT * FROM reranked WHERE rank <= 3), {_ctx_sql('ret', 'hq')},
pg AS (SELECT query_id, list(struct_pack(rank := rank, source := source, c := markdown_content) ORDER BY rank) AS pages
       FROM ret GROUP BY query_id),
j AS (SELECT a.*, c.context, p.pages FROM aq a LEFT JOIN ctx c ON a.query_id = c.query_id
      LEFT JOIN pg p ON a.query_id = p.query_id),
ans AS (
  SELECT query_id, is_financial, route, year,
         {persona} || chr(10) || chr(10) || 'Context:' || chr(10)
           || CASE WHEN route = 'retrieve' THEN context ELSE dialogue END
           || chr(10) || chr(10) || 'Question: ' || coalesce(text, '') || chr(10) || 'Rephrased question: '
           || coalesce(search_text, '') AS prompt,
         CASE WHEN text IS NULL THEN 'Error'
              WHEN route = 'retrieve' AND pages IS NOT NULL
                THEN 'Answered from the best of ' || CAST(len(pages) AS VARCHAR) || ' retrieved pages: ' || pages[1].source
              WHEN route = 'retrieve' THEN 'No page passed the search.'
              ELSE 'Answered from the dialogue.' END AS logic_steps,
         CASE WHEN text IS NULL THEN 'Error'
              WHEN route = 'retrieve' AND pages IS NOT NULL THEN {O.first_sentence('pages[1].c')}
              WHEN route = 'retrieve' THEN {O._lit(A.NO_CONTEXT)}
              ELSE {O.first_sentence('text')} END AS generated_response,
         CASE WHEN text IS NULL THEN 'Error'
              WHEN route = 'retrieve' AND pages IS NOT NULL
                THEN array_to_string(list_transform(pages, lambda p: p.source), '; ')
              WHEN route = 'retrieve' THEN ''
              ELSE 'dialogue' END AS summary_sources,
         CASE WHEN text IS NULL THEN ['Error']
              WHEN route = 'retrieve' AND pages IS NOT NULL THEN list_transform(pages, lambda p: p.source)
              WHEN route = 'retrieve' THEN CAST([] AS VARCHAR[])
              ELSE ['dialogue'] END AS sources
  FROM j)"""



_GEN = "WITH " + _answer_sql("tq")[5:].replace(
    f"{O.TURNS}, ", f"{O.TURNS}, tq AS (SELECT DISTINCT query_text AS query_id, query_text AS text FROM testset_v "
    "WHERE query_text IS NOT NULL), ", 1) + """,
gen AS (
  SELECT t.query_id, t.difficulty, t.query_text, t.answer,
         coalesce(a.logic_steps, 'Error') AS logic_steps, coalesce(a.generated_response, 'Error') AS generated_response,
         coalesce(a.summary_sources, 'Error') AS summary_sources, coalesce(a.sources, ['Error']) AS sources
  FROM testset_v t LEFT JOIN ans a ON t.query_text = a.query_id)"""

SQL["generate_answers"] = _GEN + "\nSELECT * FROM gen"

_JUDGED = _GEN + f""",
jg0 AS (SELECT *, list_distinct({O.tokens('answer')}) AS ref, {O.tokens('generated_response')} AS rt FROM gen),
jg1 AS (SELECT *, CASE WHEN len(ref) > 0 THEN
          CAST(len(list_filter(ref, lambda t: list_contains(rt, t))) AS DOUBLE) / len(ref) END AS share FROM jg0),
judged AS (
  SELECT query_id, difficulty, query_text, answer, logic_steps, generated_response, summary_sources, sources,
         'reference tokens found: ' || coalesce(CAST(CAST(round(share * 100) AS INTEGER) AS VARCHAR), 'n/a') || '%'
           AS reasoning,
         CAST(CASE WHEN share >= 1.0 THEN 4 WHEN share >= 0.5 THEN 2 ELSE 0 END AS INTEGER) AS answer_accuracy,
         {O._lit(A.JUDGE_MODEL)} AS model
  FROM jg1)"""

SQL["judge_answers"] = _JUDGED + "\nSELECT * FROM judged"

_STORED = _JUDGED + """
SELECT query_id, difficulty, query_text, answer, generated_response, reasoning, answer_accuracy, model,
       logic_steps, summary_sources, sources
FROM judged WHERE query_id IS NOT NULL AND difficulty IS NOT NULL AND query_text IS NOT NULL AND answer IS NOT NULL
  AND generated_response IS NOT NULL AND reasoning IS NOT NULL AND answer_accuracy IN (0, 2, 4)
  AND model IS NOT NULL AND logic_steps IS NOT NULL AND summary_sources IS NOT NULL AND sources IS NOT NULL"""

SQL["store_evaluation"] = _STORED
SQL["evaluation_run"] = _STORED

SQL["evaluation_rollup"] = f"""SELECT CASE WHEN grouping(difficulty) = 1 THEN 'all' ELSE difficulty END AS difficulty, count(*) AS n,
  round(avg(answer_accuracy), 6) AS mean_accuracy,
  {', '.join(f'round(avg(CASE WHEN answer_accuracy = {r} THEN 1 ELSE 0 END), 6) AS share_{r}' for r in (0, 2, 4))}
FROM ({SQL["evaluation_run"]}) GROUP BY ROLLUP (difficulty)"""

SQL["retrieval_metrics"] = f"""WITH h AS ({SQL["hybrid_retrieve"]}),
rel AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id AS corpus_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
ks AS (SELECT unnest([1, 3, 5]) AS k),
q AS (
  SELECT k, rel.query_id, count(h.rank) AS found, count(*) AS relevant, min(h.rank) AS first
  FROM ks CROSS JOIN rel LEFT JOIN h ON h.query_id = rel.query_id AND h.corpus_id = rel.corpus_id AND h.rank <= k GROUP BY ALL)
SELECT CAST(k AS INTEGER) AS k, count(*) AS n_queries, round(avg(found / relevant), 6) AS recall,
  round(avg(CASE WHEN first IS NULL THEN 0 ELSE 1 END), 6) AS hit_rate, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr
FROM q GROUP BY k"""

SQL["prompt_rows"] = _GEN + """
SELECT query_id, is_financial, route, year, prompt FROM ans"""

_ASKED = _STICKY + """,
said AS (
  SELECT thread_id, turn, role, content,
         string_agg(CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'AI' WHEN 'system' THEN 'System' ELSE role END
                    || ': ' || coalesce(content, ''), chr(10))
           OVER (PARTITION BY thread_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS dialogue,
         string_agg(coalesce(role, 'unknown') || ': ' || coalesce(content, ''), chr(10))
           OVER (PARTITION BY thread_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS kept
  FROM turns_v),
mine AS (SELECT thread_id, turn, content, lag(content) OVER (PARTITION BY thread_id ORDER BY turn) AS earlier
         FROM turns_v WHERE role = 'user'),
asked AS (
  SELECT CAST(m.thread_id AS VARCHAR) || '#' || CAST(m.turn AS VARCHAR) AS query_id, m.thread_id, m.turn, m.content AS text,
         concat_ws(' ', m.earlier, m.content) AS search_text, y.year, d.dialogue, d.kept
  FROM mine m JOIN sticky y USING (thread_id, turn) JOIN said d USING (thread_id, turn)),"""

SQL["conversation_run"] = _answer_sql("asked", thread=True, prefix=_ASKED) + """,
rec AS (SELECT *, 'Answer: ' || generated_response || chr(10) || 'Reasoning: ' || logic_steps || chr(10) || 'Sources summary: '
               || summary_sources || chr(10) || 'Sources: ' || array_to_string(sources, ', ') AS record FROM ans)
SELECT q.thread_id, q.turn, r.year, r.is_financial, r.route, q.search_text, r.prompt, r.record,
       q.kept || chr(10) || 'assistant: ' || r.record AS history
FROM rec r JOIN asked q USING (query_id)"""

SQL["stream_ingest"] = f"""WITH {O.PAGE_ROWS}
SELECT * FROM pages_v"""

SQL["stream_thread_state"] = SQL["sticky_year"]

SQL["stream_embed"] = f"""WITH {O.PAGE_ROWS}, {O.embedding('pages_v', 'corpus_id', 'markdown_content', 'emb')},
n AS (SELECT id, CAST(count(*) AS BIGINT) AS n_entries FROM emb GROUP BY id)
SELECT p.corpus_id AS id, n.n_entries, p.probable_referenced_years AS years
FROM pages_v p JOIN n ON p.corpus_id = n.id"""

SQL["enrich_pages"] = f"""WITH {O.CORPUS}
SELECT corpus_id, image_filename, markdown_content FROM corpus_v"""
