"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veinworks.llm import chat, decontam, divergence, media, neardup, packing, pii, quality, secret_scan, sharding, token_files, toxicity, vector_codes
from veinworks.llm.storage import table

SHARDS = 24
#: Fixed value: the text of the two rows of conversation -1.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_column(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted(chat.reply_paths(chat.turn_tree(rows.unionByName(control)))))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=1)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_findings(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_slots(table(spark, sf_dir, "documents"), SHARDS)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality": op3_quality,
    "op4_media": op4_media,
    "op5_pii": op5_pii,
    "op6_chat": op6_chat,
    "op7_token_files": op7_token_files,
    "op8_secrets": op8_secrets,
    "op9_sharding": op9_sharding,
    "op10_packing": op10_packing,
    "op11_vector_codes": op11_vector_codes,
    "op12_divergence": op12_divergence,
    "op13_toxicity": op13_toxicity,
}

_ESCAPED = r"replace(replace({x}, '\', '\\'), '<|', '<\|')"

#: The digests of conversations, straight from their rows; turns in the order (turn, role, text).
CHAT_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.START)} + length(replace({_ESCAPED.format(x="role")}, chr(10), '\\n')) + 1 + length({_ESCAPED.format(x="text")}) + {len(chat.END)} + 1) AS bigint) AS formatted_chars
FROM t GROUP BY conv_id"""

#: CRC-32 by the table of its polynomial, and the jump walk as a recursive query in 128-bit integers.
SHARDING_SQL = f"""WITH RECURSIVE polynomial AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
hexed AS (SELECT row_number() OVER () AS id, doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
sized AS (SELECT id, doc_id, md5(coalesce(CAST(doc_id AS varchar), '')) AS m, length(h) // 2 + 8 AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM hexed, polynomial),
walk AS (SELECT id, ('0x' || substr(m, 1, 15))::hugeint AS k, 0::bigint AS j FROM sized
  UNION ALL SELECT id, n, CAST(floor((j + 1) * (2147483648.0::double / ((n >> 33) + 1)::double)) AS bigint) FROM (SELECT id, j, (k * {sharding.MULTIPLIER}::hugeint + 1) % 18446744073709551616::hugeint AS n FROM walk WHERE j <= {SHARDS})),
placed AS (SELECT id, CAST(max(j) FILTER (j < {SHARDS}) AS integer) AS shard, CAST(max(j) FILTER (j <= {SHARDS}) AS integer) AS grown_shard FROM walk GROUP BY id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substr(m, 1, 1), text_crc32 >> 27, m, text_crc32, size) - 1 AS slot, grown_shard FROM sized JOIN placed USING (id)"""



def _vector_codes_sql() -> str:
    """The rounds one after another, each over all pairs of run and entry; sums of products of integers are exact in doubles below 2^53."""
    parts = f"""SELECT vec_id, label, k AS part, CAST(x[k * w + 1:(k + 1) * w] AS double[]) AS run
  FROM (SELECT vec_id, label, list_transform(embedding, lambda c: floor({vector_codes.SCALE} * CAST(c AS double))) AS x, len(embedding) // {vector_codes.PARTS} AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0), range({vector_codes.PARTS}) p(k)"""
    steps = [f"parts AS MATERIALIZED ({parts})", f"book0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, run AS centre FROM parts WHERE vec_id IN (SELECT vec_id FROM parts WHERE part = 0 ORDER BY vec_id LIMIT {vector_codes.ENTRIES}))"]
    for r in range(vector_codes.ROUNDS + 1):
        steps.append(f"""best{r} AS MATERIALIZED (SELECT vec_id, part, min((list_inner_product(run, run) - 2 * list_inner_product(run, centre) + list_inner_product(centre, centre))::bigint * {vector_codes.ENTRIES} + entry) AS key FROM parts JOIN book{r} USING (part) GROUP BY vec_id, part)""")
        if r < vector_codes.ROUNDS:
            steps.append(f"""moved{r} AS (SELECT part, entry, list(centre ORDER BY i) AS centre FROM (SELECT p.part, key % {vector_codes.ENTRIES} AS entry, i, floor(sum(run[i]) / count(*)) AS centre FROM parts p JOIN best{r} USING (vec_id, part), range(1, len(run) + 1) d(i) GROUP BY ALL) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.centre, b.centre) AS centre FROM book{r} b LEFT JOIN moved{r} m USING (part, entry))""")
    last = vector_codes.ROUNDS
    return "WITH " + ",\n".join(steps) + f""",
coded AS (SELECT vec_id, label, string_agg(lower(printf('%02x', key % {vector_codes.ENTRIES})), '' ORDER BY part) AS code, CAST(sum(key // {vector_codes.ENTRIES}) AS bigint) AS error FROM parts JOIN best{last} USING (vec_id, part) GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error,
  (SELECT sha256(string_agg(array_to_string(CAST(CAST(centre AS bigint[]) AS varchar[]), ','), ',' ORDER BY part, entry)) FROM book{last}) AS codebooks_sha256 FROM coded"""


DIVERGENCE_SQL = f"""WITH t AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{divergence._CAPITALS}', '{divergence._SMALL}') AS text FROM documents),
terms AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '{divergence.TERM}')) AS term FROM t),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY ALL HAVING count(DISTINCT id) >= {divergence.LEAST_DOCUMENTS}),
lang_size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
grouped AS (SELECT DISTINCT lang, source FROM t),
sized AS (SELECT g.lang, g.source, coalesce(sum(f.n), 0) AS total FROM grouped g LEFT JOIN found f USING (lang, source) GROUP BY ALL),
dense AS (SELECT k.lang, s.source, k.term, coalesce(f.n, 0) AS n,
  CAST(1 + ({divergence.SCALE}::hugeint * (coalesce(f.n, 0) + 2)) // (s.total + 2 * z.v) AS bigint) AS p, CAST(1 + ({divergence.SCALE}::hugeint * (k.n + 2)) // (z.total + 2 * z.v) AS bigint) AS q
  FROM kept k JOIN lang_size z USING (lang) JOIN sized s USING (lang) LEFT JOIN found f ON f.lang = k.lang AND f.source = s.source AND f.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM dense x JOIN dense y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS bigint) AS value, CAST(rank AS integer) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}"""

#: The others need hashes, models or codecs that SQL lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {"op6_chat": CHAT_SQL, "op9_sharding": SHARDING_SQL, "op11_vector_codes": _vector_codes_sql(), "op12_divergence": DIVERGENCE_SQL}
