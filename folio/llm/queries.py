"""Queries of the training-data operators and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.scratch import Scratch, bounded_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.secrets import scan

    found = scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.jaccard import join

    return join(_table(spark, sf_dir, "documents"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that the labels call of good quality and not toxic."""
    return _table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")


def op4_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.kneser_ney import classify

    return classify(_table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op2_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: Schemas of the tools in the view below.
TOOLS = {
    "lookup": {"properties": {"limit": {"type": "integer", "minimum": 0, "maximum": 5}, "query": {"type": "string"}, "step": {"type": "integer"}}, "required": ["limit", "query", "step"], "additional": False},
    "rewrite": {"properties": {"query": {"type": "string"}, "style": {"type": "string", "enum": ["plain", "formal"]}}, "required": ["query", "style"], "additional": True},
}


def tool_events(conversations: DataFrame) -> DataFrame:
    """A view of plain conversations with tool calls: a user's turn is a call, the assistant's turn after it its result.

    Calls of four turns in a row depend on each other; tools alternate, and some arguments break their schema.
    """
    role, turn = F.lower(F.trim("role")), F.col("turn")
    name = lambda t: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), t.cast("string"))
    is_call, is_result = F.coalesce(role == "user", F.lit(False)), F.coalesce(role == "assistant", F.lit(False))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    lookup = F.to_json(F.struct(F.col("text").alias("query"), F.col("turn").alias("step"), (size % 7).alias("limit")))
    rewrite = F.to_json(F.struct(F.when(size % 5 > 0, "plain").otherwise("odd").alias("style"), F.col("text").alias("query"), turn.alias("order")))
    second = F.coalesce(turn % 4 >= 2, F.lit(False))
    return conversations.select(
        "conv_id", "turn",
        F.when(is_call, "call").when(is_result, "result").otherwise("message").alias("kind"),
        "role", F.col("text").alias("content"),
        F.when(turn.isNotNull(), F.when(is_call, name(turn)).when(is_result, name(turn - 1))).alias("call_id"),
        F.when(is_call, F.when(second, "rewrite").otherwise("lookup")).alias("tool"),
        F.when(is_call, F.when(second, rewrite).otherwise(lookup)).alias("arguments"),
        F.when(is_call & (turn % 8 >= 2), F.array(name(turn - 2))).alias("depends"),
    )


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.chat import link_tool_calls

    return link_tool_calls(tool_events(_table(spark, sf_dir, "conversations")), TOOLS)


def op6_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.vectors import near_dedup

    return near_dedup(_table(spark, sf_dir, "embeddings"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after the documents came in two batches with other counts and languages, the first of them twice, and then each was revised, deleted and inserted again."""
    from folio.llm.rollup import KEY, TokenRollup, inserts, token_counts

    docs, scratch = _table(spark, sf_dir, "documents"), Scratch(spark, "rollup")
    rollup = TokenRollup(spark, scratch.path("totals"))
    counts = scratch.keep(token_counts(docs).unionByName(token_counts(docs, "words", "words-1")), "counts")
    half = [counts.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == b) for b in (0, 1)]
    for name, b in (("b0", 0), ("b1", 1), ("b0", 0)):
        rollup.apply(name, inserts(half[b].withColumns({"lang": F.lit("und"), "tokens": F.col("tokens") + 1})))
    for b in (0, 1):
        rollup.apply(f"revise{b}", half[b].select(F.lit("revise").alias("op"), *KEY, "tokens", F.lit("und").alias("old_lang"), (F.col("tokens") + 1).alias("old_tokens")))
        rollup.apply(f"delete{b}", half[b].select(F.lit("delete").alias("op"), *KEY, "tokens"))
        rollup.apply(f"insert{b}", inserts(half[b]))
    rollup.compact()
    return rollup.totals()


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.dedup import dedup

    return dedup(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.tokenfile import read_token_files, write_token_files

    uri = Scratch(spark, "tokenfiles").root
    write_token_files(_table(spark, sf_dir, "documents"), uri)
    return read_token_files(spark, uri).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.whitening import whiten

    rows = whiten(_table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def op13_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.sharding import shuffled

    text = F.coalesce("row.text", F.lit(""))
    return shuffled(_table(spark, sf_dir, "documents")).select(
        "row.doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_power_of_two_packing, op3_jaccard_join, op4_kneser_ney_quality, op5_tool_call_linking, op6_vector_near_dedup, op7_token_rollup, op8_exact_dedup, op9_token_files, op10_pareto_mix, op11_embedding_whitening, op12_source_divergence, op13_hypergeometric_shards)}

SQL = {
    "op5_tool_call_linking": r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, text, lower(trim(role)) AS r, strlen(coalesce(text, '')) AS size FROM conversations),
k AS (SELECT *, CASE r WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
        CASE r WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id, turn % 4 >= 2 AS second FROM c),
calls AS (SELECT DISTINCT conv_id, turn FROM k WHERE kind = 'call'),
ans AS (SELECT conv_id, turn - 1 AS turn FROM k WHERE kind = 'result'),
lv AS (SELECT conv_id, turn, 0::BIGINT AS level FROM calls a WHERE turn % 8 < 2 OR NOT EXISTS (SELECT 1 FROM calls b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2)
       UNION ALL SELECT a.conv_id, a.turn, lv.level + 2 FROM lv JOIN calls a ON a.conv_id = lv.conv_id AND a.turn = lv.turn + 2 AND a.turn % 8 >= 2),
j AS (SELECT k.*, lv.level AS own_level, ans.turn IS NOT NULL AS answered,
        CASE WHEN kind = 'call' AND second THEN {'order': k.turn, 'query': text, 'style': CASE WHEN size % 5 > 0 THEN 'plain' ELSE 'odd' END}::JSON::VARCHAR
             WHEN kind = 'call' THEN {'limit': size % 7, 'query': text, 'step': k.turn}::JSON::VARCHAR END AS args
      FROM k LEFT JOIN lv ON lv.conv_id = k.conv_id AND lv.turn = CASE WHEN kind = 'call' THEN k.turn WHEN kind = 'result' THEN k.turn - 1 END
      LEFT JOIN (SELECT DISTINCT * FROM ans) ans ON ans.conv_id = k.conv_id AND ans.turn = k.turn AND kind = 'call')
SELECT conv_id, turn, kind, call_id,
  CASE kind WHEN 'call' THEN CASE WHEN answered THEN 'linked' ELSE 'unanswered' END WHEN 'result' THEN CASE WHEN own_level IS NOT NULL THEN 'linked' ELSE 'orphan' END END AS link,
  CASE kind WHEN 'call' THEN CASE WHEN second THEN size % 5 > 0 ELSE size % 7 <= 5 END END AS valid,
  CASE kind WHEN 'call' THEN CASE WHEN second AND size % 5 = 0 THEN 'style: not allowed' WHEN NOT second AND size % 7 > 5 THEN 'limit: too large' ELSE '' END END AS problems,
  turn AS after, CASE kind WHEN 'call' THEN own_level WHEN 'result' THEN coalesce(own_level + 1, 0) ELSE 0 END AS level,
  CASE kind WHEN 'call' THEN '{"role":"assistant","tool_calls":[{"arguments":' || args || ',"id":' || to_json(call_id) || ',"name":"' || CASE WHEN second THEN 'rewrite' ELSE 'lookup' END || '"}]}'
            WHEN 'result' THEN {'content': text, 'role': 'tool', 'tool_call_id': call_id}::JSON::VARCHAR
            ELSE {'content': text, 'role': r}::JSON::VARCHAR END AS json
FROM j""",
    "op3_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS node, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT node, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
f AS (SELECT node, n, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS five FROM w WINDOW o AS (PARTITION BY node ORDER BY pos)),
s AS (SELECT DISTINCT node, five AS shingle FROM f WHERE n >= 5 AND pos <= n - 4 UNION ALL SELECT node, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
c AS (SELECT node, count(*) AS size FROM s GROUP BY node),
p AS (SELECT x.node AS a, y.node AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.node <> y.node GROUP BY x.node, y.node),
l AS (SELECT a, b FROM p JOIN c ca ON ca.node = a JOIN c cb ON cb.node = b WHERE 100 * common >= 80 * (ca.size + cb.size - common)),
r AS (SELECT node, node AS other FROM d UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT r.node, min(o.doc_id) AS component_id FROM r JOIN d o ON o.node = r.other GROUP BY r.node)
SELECT doc_id, coalesce(size, 0)::BIGINT AS n_shingles, component_id FROM d JOIN m USING (node) LEFT JOIN c USING (node)""",
    "op6_vector_near_dedup": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS node, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT node, len(v) AS n, v FROM d WHERE coalesce(len(v), 0) > 0 AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
l AS (SELECT x.node AS a, y.node AS b FROM u x JOIN u y ON x.n = y.n AND x.node <> y.node WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
r AS (SELECT node, node AS other FROM d UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT r.node, min(o.vec_id) AS component_id FROM r JOIN d o ON o.node = r.other GROUP BY r.node),
k AS (SELECT a AS node, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN m USING (node) LEFT JOIN k USING (node)""",
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)""",
    "op10_pareto_mix": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
j AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy_no FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
f AS (SELECT *, 3.0::DOUBLE * source_size / w AS full_at FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - 3.0::DOUBLE * coalesce(sum(source_size) OVER b, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level
      FROM f WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, (SELECT level FROM l WHERE full_at > level ORDER BY full_at, level DESC LIMIT 1) AS final FROM l),
t AS (SELECT source, source_size, w, final IS NULL OR full_at <= final AS capped,
        CASE WHEN final IS NULL OR full_at <= final THEN 3.0::DOUBLE * source_size ELSE final * w END AS target FROM m),
e AS (SELECT j.*, source_size, target, CASE WHEN capped THEN 3.0::DOUBLE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS expected,
        (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy_no), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
      FROM j JOIN t ON j.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(expected)::BIGINT AS whole, CASE WHEN expected - floor(expected) > 0
        THEN (u / (1 - u)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) END AS q FROM e),
r AS (SELECT *, target - sum(size * whole) OVER (PARTITION BY source) AS budget,
        CASE WHEN q IS NOT NULL THEN sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, size, copy_no ROWS UNBOUNDED PRECEDING) END AS upto FROM q),
c AS (SELECT *, coalesce(upto <= budget, false) AS chosen,
        budget - coalesce(max(CASE WHEN upto <= budget THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN q IS NOT NULL AND NOT chosen AND size > 0 AND abs(size - gap) < gap THEN abs(size - gap) END NULLS LAST, q, doc_id, size, copy_no) = 1
        AND q IS NOT NULL AND NOT chosen AND size > 0 AND abs(size - gap) < gap AS closing FROM c)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN chosen OR closing THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM k""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS node, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT node, lang, source, unnest(ws) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT node) >= 3),
c AS (SELECT t.lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS kept, sum(total) AS whole FROM k GROUP BY lang),
h AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS whole FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
w AS (SELECT h.lang, h.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (h.whole + v.kept))::BIGINT AS p,
        (1 + 1000000000::HUGEINT * (k.total + 1) // (v.whole + v.kept))::BIGINT AS q
      FROM h JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = h.lang AND c.source = h.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM w a JOIN w b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM w WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200""",
}
