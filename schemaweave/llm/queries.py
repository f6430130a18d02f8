"""One query per operator with its production parameters over the whole intended table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_sql, chat, decontaminate, dom_model, filter_audit, huffman_ids, matroska, mixing, multi_index, ranked_search, simhash, suffix_dedup, toxicity
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    parts = turns.unionByName(extra).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.conversation_digests(chat.format_turns(parts))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), part != 2)
    return toxicity.scores(docs, model).select("doc_id", (part == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(matroska.text_media(table(spark, sf_dir, "documents")))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom_model.main_text(table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_sql.bpe_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"))


#: Shares of tokens by language.
TARGETS = {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.15}


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled documents with their language as domain."""
    return labels.select("doc_id").join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mixed(docs, domain_labels(docs, table(spark, sf_dir, "labels")), TARGETS)


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passage_digests(table(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_ids.token_id_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_toxicity, op3_matroska, op4_main_text, op5_byte_bpe, op6_simhash, op7_multi_index, op8_mixing, op9_passages, op10_token_ids, op11_filter_audit, op12_block_max_search, op13_decontamination)}


#: The two turns of conversation -7 count like the others; an escaped text is longer by its special characters.
CHAT_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(14 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


#: E compares whole texts; the 120 orders are laid over counters of the 32 sets of failed filters.
AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS failed FROM d),
m AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN m USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT *, 1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1) AS own, list_sum([0] || list_transform(range(1, step), lambda k: 1 << (instr('ABCDE', substr(filter_order, k, 1)) - 1)))::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, coalesce(sum(n) FILTER (WHERE failed & (own | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE failed & own > 0 AND failed & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE failed & own > 0 AND failed & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE failed = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE failed & own > 0 AND failed & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE failed & own > 0 AND failed & before = 0), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SEARCH_SQL = rf"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
s AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM n),
p AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
r AS (SELECT q.item_id, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN n USING (doc_id), s GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

CONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
a AS (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS pos FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, size, array_to_string(w[pos:pos + size - 1], ' ') AS words FROM a),
b AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, (SELECT DISTINCT size FROM g) WHERE len(w) >= size),
h AS (SELECT b.doc_id, g.item_id, b.pos, b.size FROM b JOIN g ON g.size = b.size AND g.words = array_to_string(b.w[b.pos:b.pos + b.size - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM h) GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": CHAT_SQL, "op11_filter_audit": AUDIT_SQL, "op12_block_max_search": SEARCH_SQL, "op13_decontamination": CONTAMINATION_SQL}
