"""Registered queries of the training-data operators, ``opN_<name>``, and their DuckDB SQL.

Each takes ``(spark, sf_dir)``, applies its operator with production parameters to the whole
table and returns the full result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import bpe, decontam, jaccard, langid, lexical, main_text, packing, prefix_trie, privacy, quality, rules, secret_scan, shards
from folio.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(path: str | None = None) -> bpe.Vocabulary:
    """The public 50k byte-level vocabulary, read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.Vocabulary.from_file(path)


@register
def op1_bpe_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    return bpe.round_trip(table(spark, base, "documents"), vocabulary())


@register
def op2_main_text(spark: SparkSession, base: str) -> DataFrame:
    """Main text of every page."""
    found = main_text.extract(table(spark, base, "pages")).select("page_id", "url", "text")
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


@register
def op3_quality(spark: SparkSession, base: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out fold."""
    docs = table(spark, base, "documents")
    model = quality.train(docs, table(spark, base, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


@register
def op4_ngram_jaccard(spark: SparkSession, base: str) -> DataFrame:
    """Set size and component of every document under shingle similarity 0.75."""
    return jaccard.link(table(spark, base, "documents"))


SQL["op4_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS node, doc_id AS label FROM documents
  UNION
  SELECT e.b, r.label FROM reach r JOIN both_ways e ON e.a = r.node)
SELECT node AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(label) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = node GROUP BY node
"""


@register
def op5_shards(spark: SparkSession, base: str) -> DataFrame:
    """Shard and slot of every document; equal texts stay together."""
    return shards.assign(table(spark, base, "documents"))


@register
def op6_decontaminate(spark: SparkSession, base: str) -> DataFrame:
    """Benchmark items found in documents, copied or paraphrased."""
    return decontam.leaks(table(spark, base, "documents"), table(spark, base, "benchmark"))


@register
def op7_secrets(spark: SparkSession, base: str) -> DataFrame:
    """Spans of secrets in every document: base patterns and inferred formats."""
    docs = table(spark, base, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    return found.select("doc_id", *(f"secrets.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")))


@register
def op8_quality_rules(spark: SparkSession, base: str) -> DataFrame:
    """Ledger of every document and the verdict of the current policy."""
    book = rules.ledger(table(spark, base, "documents"))
    base_failed = ~rules.passes(rules.BASE)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & rules.passes(rules.CURRENT)).alias("kept"), "n_lines", "n_exclaims", "failed",
    )


SQL["op8_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
tri AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS a
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT r, a FROM tri GROUP BY r, a HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + o) AS n FROM tri JOIN again USING (r, a), (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    len(ls) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_exclaims
  FROM w LEFT JOIN covered USING (r)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 40 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 100 * n_exclaims > 60 * n_words THEN 32 ELSE 0 END) AS failed
  FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (failed & 3) <> 0 AS base_failed,
  failed = 0 AS kept, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_exclaims AS BIGINT) AS n_exclaims, CAST(failed AS INTEGER) AS failed
FROM b
"""


@register
def op9_language(spark: SparkSession, base: str) -> DataFrame:
    """Predicted language of every document, learned outside the held-out fold."""
    docs = table(spark, base, "documents")
    held = F.coalesce(~langid.trainable(), F.lit(False)).alias("held_out")
    return langid.predict(docs, langid.train(docs)).select("doc_id", held, "lang_pred", "score")


@register
def op10_packing(spark: SparkSession, base: str) -> DataFrame:
    """Packed id matrix rows of all documents."""
    return packing.pack(table(spark, base, "documents"), vocabulary())


@register
def op11_prefix_trie(spark: SparkSession, base: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.trie(table(spark, base, "conversations"))


#: The eight steps of a table of CRC-32 values.
_CRC_STEPS = "".join(
    f"c{k} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM c{k - 1}),\n" for k in range(1, 9))
SQL["op11_prefix_trie"] = f"""
WITH RECURSIVE c0 AS (SELECT i, CAST(i AS BIGINT) AS c FROM range(256) r(i)),
{_CRC_STEPS}
own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS s FROM own GROUP BY conv_id),
crc AS (
  SELECT conv_id, s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM conv
  UNION ALL
  SELECT conv_id, s, k + 1, xor(c8.c, crc.c >> 8) FROM crc JOIN c8 ON c8.i = xor(crc.c, CAST(ord(substr(s, k + 1, 1)) AS BIGINT)) & 255 WHERE k < length(s)),
taken AS (
  SELECT c.conv_id, c.n, xor(crc.c, 4294967295) % 6 AS h, least(xor(crc.c, 4294967295) % 6, coalesce(b.n, 0)) AS hb
  FROM conv c JOIN crc ON crc.conv_id = c.conv_id AND crc.k = length(c.s) LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 100),
turn AS (
  SELECT t.conv_id, o.pos AS depth, role, text FROM taken t JOIN own o ON o.conv_id = t.conv_id - t.conv_id % 100 AND o.pos <= t.hb
  UNION ALL
  SELECT t.conv_id, t.hb + o.pos - t.h, role, text FROM taken t JOIN own o ON o.conv_id = t.conv_id AND o.pos > t.h),
prefix AS (
  SELECT conv_id, depth, length(text) AS chars, array_to_string(list(md5(role) || md5(text)) OVER (PARTITION BY conv_id ORDER BY depth), ',') AS k,
    depth = max(depth) OVER (PARTITION BY conv_id) AS is_end
  FROM turn
  UNION ALL
  SELECT conv_id, 0, 0, '', hb + greatest(n - h, 0) = 0 FROM taken),
node AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM prefix GROUP BY depth, k),
child AS (SELECT *, substr(k, 1, greatest(length(k) - 65, 0)) AS up FROM node WHERE depth > 0),
below AS (SELECT a.depth, a.k, count(*) AS n_children FROM child JOIN node a ON a.depth = child.depth - 1 AND a.k = child.up GROUP BY ALL),
sums AS (
  SELECT a.depth, a.k, count(*) FILTER (below.n_children IS NULL) AS n_leaves, CAST(sum((d.n_convs - 1) * d.chars) AS BIGINT) AS saved_tokens
  FROM node a JOIN node d ON starts_with(d.k, a.k) AND d.depth >= a.depth LEFT JOIN below ON below.depth = d.depth AND below.k = d.k GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(below.n_children, 0) AS n_children,
  n_leaves, saved_tokens, n.ends_sha256
FROM node n JOIN sums ON sums.depth = n.depth AND sums.k = n.k LEFT JOIN below ON below.depth = n.depth AND below.k = n.k
  LEFT JOIN child ON child.depth = n.depth AND child.k = n.k LEFT JOIN node p ON p.depth = n.depth - 1 AND p.k = child.up
"""


@register
def op12_privacy(spark: SparkSession, base: str) -> DataFrame:
    """Spans of personal data in every document: base patterns and disclosing terms."""
    docs = table(spark, base, "documents").select("doc_id", "text")
    found = privacy.scan(docs, privacy.disclosing(docs))
    counts = (f"personal.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256"))
    return found.select("doc_id", *counts, privacy.span_list().alias("spans"))


@register
def op13_lexical_search(spark: SparkSession, base: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.search(table(spark, base, "documents"), table(spark, base, "benchmark"))


SQL["op13_lexical_search"] = r"""
WITH low AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'i', item_id, row_number() OVER (), translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
tok AS (SELECT kind, id, r, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
tf AS (SELECT id, r, term, count(*) AS tf FROM tok WHERE kind = 'd' GROUP BY ALL),
doc AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
corpus AS (SELECT count(*) AS cn, CAST(sum(n) AS BIGINT) AS cl FROM doc),
m AS (SELECT r, 75 + (25 * n * cn) // cl AS m FROM doc, corpus),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * cn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, corpus),
q AS (SELECT id AS item_id, r AS item, term, count(*) AS times FROM tok WHERE kind = 'i' GROUP BY ALL),
score AS (
  SELECT item_id, item, tf.id AS doc_id, tf.r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m ON m.r = tf.r GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM score WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
