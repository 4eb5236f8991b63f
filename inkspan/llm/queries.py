"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm import langid, quality, url_filter
from inkspan.llm.chat import format_chat
from inkspan.llm.decontaminate import find_contamination
from inkspan.llm.exact_dedup import mark_duplicates
from inkspan.llm.html_extract import extract_text
from inkspan.llm.importance import resample
from inkspan.llm.packing import pack_documents
from inkspan.llm.sharding import TABLE_SIZE, assign_shards, lookup_table
from inkspan.llm.simhash import near_duplicates
from inkspan.llm.spotsigs import COMMON_WORDS, compare_neighbours, fingerprint
from inkspan.llm.whitening import whiten

SHARDS = [f"shard-{i:02d}" for i in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks_path() -> str:
    """The public 50k byte-level vocabulary; its ids are those of ``byte_bpe_50k.json``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return assign_shards(docs, "doc_id", SHARDS).select("doc_id", "slot", "shard_id", "shard", "n_bytes")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_table(spark, sf_dir, "documents"), ranks_path(), capacity=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def remainder(column: str, modulus: int) -> Column:
    """CRC-32 of a number's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def language_models(docs: DataFrame) -> langid.Models | None:
    """Fitted on the documents that are not held out."""
    return langid.train(docs.filter(F.col("lang").isNotNull() & (remainder("doc_id", 4) != 2)))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), language_models(docs))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = url_filter.train(url_filter.seed_labels(spark))
    judged = url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, trees)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0))
    scored = quality.score(docs, model, threshold=0.3)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


#: Tools of the derived calls: argument, type and whether it is required. ``sum`` has none.
TOOLS = ["search", "fetch", "sum"]
TOOL_SCHEMAS = [("search", "query", "string", True), ("search", "limit", "integer", False), ("search", "options", "object", False), ("fetch", "query", "string", True), ("fetch", "limit", "number", True)]
#: Arguments of the derived calls as written, and their canonical form; ``@`` stands for a number.
ARGUMENTS = [
    ('{"query": "q@", "limit": @}', '{"limit":@,"query":"q@"}'),
    ('{"query": "q@", "limit": "@"}', '{"limit":"@","query":"q@"}'),
    ('{ "limit":3 }', '{"limit":3}'),
    ("not json @", '{"raw":"not json @"}'),
    ("[1, @]", "[1,@]"),
    ('{"query": "q@", "limit": @.5, "extra": null}', '{"extra":null,"limit":@.5,"query":"q@"}'),
    ('{"query": "q@", "options": {"b": [true, null], "a": "@"}}', '{"options":{"a":"@","b":[true,null]},"query":"q@"}'),
]


def tool_events(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from a conversation's own rows, as the table has no tool traffic.

    Every assistant message makes one call; four in five build on the call two
    turns before. Every user message answers the call before it; each fourth one
    claims an earlier turn, and the first one answers no call.
    """
    k = F.col("conv_id") + F.col("turn")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))
    said = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    calls = said.filter("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("c"), F.col("turn")).alias("call_id"), pick(TOOLS).alias("name"),
        F.replace(pick([a for a, _ in ARGUMENTS]), F.lit("@"), F.pmod(k, F.lit(97)).cast("string")).alias("arguments"),
        F.when(k % 5 != 0, F.concat(F.lit("c"), F.col("turn") - 2)).alias("after_id"),
    )
    results = said.filter("role = 'user'").select(
        "conv_id", F.when(k % 4 == 0, F.col("turn") - 3).otherwise(F.col("turn")).alias("turn"), F.concat(F.lit("c"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _table(spark, sf_dir, "conversations")
    calls, results = tool_events(messages)
    schemas = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x) for x in row]) for row in TOOL_SCHEMAS]))).toDF("name", "key", "type", "required")
    events = format_chat(messages, calls, results, schemas)
    return events.select("conv_id", "seq", "turn", "kind", "role", "call_id", "depth", "linked", F.array_join("errors", "; ").alias("errors"), "json")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare_neighbours(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("signatures").alias("fingerprint"),
        fingerprint("edited_signatures").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_packing": op4_packing,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_html_extraction": op7_html_extraction,
    "op8_url_filter": op8_url_filter,
    "op9_quality": op9_quality,
    "op10_chat_format": op10_chat_format,
    "op11_whitening": op11_whitening,
    "op12_fingerprints": op12_fingerprints,
    "op13_importance": op13_importance,
}

OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""


def op1_sql() -> str:
    """Placement in SQL; the slots are written out as one character each."""
    slots = "".join(chr(48 + i) for i in lookup_table(SHARDS, TABLE_SIZE))
    return f"""
WITH d AS (
  SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % {TABLE_SIZE} AS slot,
         CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes
  FROM documents
), t AS (SELECT i AS slot, ascii(s[i + 1]) - 48 AS shard_id FROM (SELECT '{slots}' AS s), range({TABLE_SIZE}) r(i))
SELECT doc_id, d.slot, CAST(shard_id AS INTEGER) AS shard_id, 'shard-' || lpad(CAST(shard_id AS VARCHAR), 2, '0') AS shard, n_bytes
FROM d JOIN t USING (slot)
"""


def op10_sql() -> str:
    """Links by recursion over chains, order by window, checks by DuckDB's JSON functions."""
    quoted = lambda values: ", ".join("'" + v + "'" for v in values)
    schemas = ", ".join(f"('{n}', '{k}', '{t}', {str(r).lower()})" for n, k, t, r in TOOL_SCHEMAS)
    n, pick = "CAST(k % 97 AS VARCHAR)", f"[CAST(k % {len(ARGUMENTS)} AS INTEGER) + 1]"
    return f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, conv_id + turn AS k FROM conversations),
schemas(name, key, type, required) AS (VALUES {schemas}),
calls AS (
  SELECT conv_id, turn, 'c' || turn AS call_id, ([{quoted(TOOLS)}])[CAST(k % {len(TOOLS)} AS INTEGER) + 1] AS name,
    replace(([{quoted(a for a, _ in ARGUMENTS)}]){pick}, '@', {n}) AS arguments, replace(([{quoted(c for _, c in ARGUMENTS)}]){pick}, '@', {n}) AS canonical,
    CASE WHEN k % 5 <> 0 THEN 'c' || (turn - 2) END AS after_id FROM m WHERE role = 'assistant'),
results AS (
  SELECT conv_id, CASE WHEN k % 4 = 0 THEN turn - 3 ELSE turn END AS turn, 'c' || (turn - 1) AS call_id, text AS content FROM m WHERE role = 'user'),
given AS (SELECT conv_id, call_id, max(turn) AS result_turn FROM results GROUP BY ALL),
nodes AS (
  SELECT conv_id, call_id, call_turn, after_id, greatest(last_turn, coalesce(result_turn, last_turn)) AS settled FROM (
    SELECT conv_id, call_id, min(turn) AS call_turn, max(turn) AS last_turn, min(after_id) AS after_id FROM calls GROUP BY conv_id, call_id) LEFT JOIN given USING (conv_id, call_id)),
chain AS (
  SELECT a.conv_id, a.call_id, b.after_id AS up, b.settled AS due, 1 AS depth FROM nodes a JOIN nodes b ON a.conv_id = b.conv_id AND a.after_id = b.call_id
  UNION ALL SELECT a.conv_id, a.call_id, b.after_id, b.settled, a.depth + 1 FROM chain a JOIN nodes b ON a.conv_id = b.conv_id AND a.up = b.call_id),
placed AS (
  SELECT conv_id, call_id, call_turn, due, coalesce(depth, 0) AS depth FROM nodes LEFT JOIN (
    SELECT conv_id, call_id, max(due) AS due, max(depth) AS depth FROM chain GROUP BY conv_id, call_id) USING (conv_id, call_id)),
checked AS (
  SELECT conv_id, call_id, name, CASE WHEN json_valid(arguments) THEN arguments::JSON END AS j FROM calls),
sound AS (SELECT * FROM checked WHERE json_type(j) = 'OBJECT'),
typed AS (
  SELECT conv_id, call_id, key, type, required, CASE json_type(j, '$.' || key) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer'
    WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' END AS given FROM sound JOIN schemas USING (name)),
errors AS (
  SELECT conv_id, call_id, string_agg(DISTINCT error, '; ' ORDER BY error) AS errors FROM (
    SELECT conv_id, call_id, 'arguments are not an object' AS error FROM checked WHERE coalesce(json_type(j), '') <> 'OBJECT'
    UNION ALL SELECT conv_id, call_id, 'tool has no schema' FROM calls WHERE name NOT IN (SELECT name FROM schemas)
    UNION ALL SELECT conv_id, call_id, 'missing ' || key FROM typed WHERE required AND given IS NULL
    UNION ALL SELECT conv_id, call_id, key || ' is ' || given || ', not ' || type FROM typed WHERE given <> type AND NOT (type = 'number' AND given = 'integer')) GROUP BY conv_id, call_id),
events AS (
  SELECT conv_id, turn, 0 AS level, NULL AS call_id, role, NULL AS linked, NULL AS errors, CAST(to_json({{'content': text, 'role': role}}) AS VARCHAR) AS json FROM m
  UNION ALL
  SELECT c.conv_id, greatest(turn, coalesce(due, turn)), 1 + 2 * depth, c.call_id, 'assistant', g.call_id IS NOT NULL, coalesce(errors, ''),
    '{{"arguments":' || canonical || ',"id":"' || c.call_id || '","name":"' || name || '","type":"call"}}'
  FROM calls c JOIN placed USING (conv_id, call_id) LEFT JOIN given g USING (conv_id, call_id) LEFT JOIN errors USING (conv_id, call_id)
  UNION ALL
  SELECT r.conv_id, greatest(turn, coalesce(call_turn, turn), coalesce(due, turn)), 2 + 2 * coalesce(depth, 0), r.call_id, 'tool', p.call_id IS NOT NULL, NULL,
    CAST(to_json({{'content': content, 'id': r.call_id, 'type': 'result'}}) AS VARCHAR)
  FROM results r LEFT JOIN placed p USING (conv_id, call_id))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, level, call_id NULLS FIRST, role NULLS FIRST, json) - 1 AS seq, turn,
  CASE WHEN level = 0 THEN 'message' WHEN level % 2 = 1 THEN 'call' ELSE 'result' END AS kind, role, call_id,
  CASE WHEN level > 0 THEN (level - 1) // 2 END AS depth, linked, errors, json FROM events
"""


def op12_sql() -> str:
    """Signatures by windows over the words: each anchor with the content words numbered after it."""
    common = ", ".join(f"'{w}'" for w in COMMON_WORDS)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS next_t,
         coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM documents WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substring(t, 1, length(t) - length(t) // 3) || substring(next_t, 1, length(t) // 3) AS edited FROM d),
texts AS (SELECT doc_id, 0 AS kind, t FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
split AS (SELECT doc_id, kind, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS ws FROM texts),
words AS (SELECT doc_id, kind, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM split),
flagged AS (SELECT *, w IN ({common}) AS common FROM words),
numbered AS (
  SELECT *, count(*) FILTER (NOT common) OVER (PARTITION BY doc_id, kind ORDER BY i) AS k,
         concat_ws(' ', w, lead(w, 1) OVER (PARTITION BY doc_id, kind ORDER BY i), lead(w, 2) OVER (PARTITION BY doc_id, kind ORDER BY i)) AS plain FROM flagged),
content AS (
  SELECT doc_id, kind, k, concat_ws(' ', w, lead(w) OVER (PARTITION BY doc_id, kind ORDER BY k)) AS chain FROM numbered WHERE NOT common),
anchored AS (SELECT n.doc_id, n.kind, n.w || ' ' || c.chain AS s FROM numbered n JOIN content c ON n.doc_id = c.doc_id AND n.kind = c.kind AND c.k = n.k + 1 WHERE n.common),
signed AS (
  SELECT * FROM anchored UNION ALL
  SELECT doc_id, kind, plain FROM numbered WHERE (doc_id, kind) NOT IN (SELECT (doc_id, kind) FROM anchored)),
sets AS (SELECT doc_id, kind, list_sort(list_distinct(list(substr(md5(s), 1, 8)))) AS z FROM signed GROUP BY doc_id, kind),
three AS (
  SELECT e.doc_id, length(t) AS n_chars, sha256(edited) AS edited_sha256, coalesce(a.z, []) AS a, coalesce(b.z, []) AS b, coalesce(c.z, []) AS c
  FROM e LEFT JOIN sets a ON a.doc_id = e.doc_id AND a.kind = 0 LEFT JOIN sets b ON b.doc_id = e.doc_id AND b.kind = 1 LEFT JOIN sets c ON c.doc_id = e.next_id AND c.kind = 0)
SELECT doc_id, n_chars, edited_sha256, coalesce(array_to_string(a, ''), '') AS fingerprint, coalesce(array_to_string(b, ''), '') AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a, c)) AS DOUBLE) / (len(a) + len(c) - len(list_intersect(a, c))) END AS near_next
FROM three
"""


#: CRC-32 of distinct features byte by byte over the table of the reflected polynomial, which SQL derives too; then counts, gains and ranks.
OP13_SQL = r"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
split AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
features AS (
  SELECT kind, id, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS f FROM split),
grouped AS (SELECT kind, id, f, count(*) AS n FROM features GROUP BY ALL),
hashed AS (
  SELECT f, xor(list_reduce([4294967295] || list_transform(range(len(hex(f)) // 2), lambda i: ('0x' || substr(hex(f), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM grouped), crc),
counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t FROM grouped JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM counts, totals),
weights AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM grouped JOIN hashed USING (f) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY id),
scored AS (
  SELECT id AS doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(ws) >= 20 AS enough,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM split LEFT JOIN weights ON id = doc_id WHERE kind = 0),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 25 // 100 AS k FROM scored WHERE enough)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= k THEN place END AS rank FROM scored s LEFT JOIN placed USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_fingerprints": op12_sql(), "op13_importance": OP13_SQL, "op1_sharding": op1_sql(), "op3_exact_dedup": OP3_SQL, "op10_chat_format": op10_sql()}
