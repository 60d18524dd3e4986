"""The queries of this subpackage's operators and, where SQL can express them, that SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html, language, media, negatives, packing, quality, repair, simhash, token_store, topk
from .shared import held_out, small_batches, table, tokenizer_path
from .token_count import count_tokens

LIMIT = 512
NOTE = "<|im_end|><|im_start|>assistant ok"


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document, and whether they pass the limit."""
    counts = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by models learned from four fifths of the ids."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~held_out()), tokenizer_path("piece_bpe_32k.model"))
    found = docs.select("doc_id", held_out().alias("held_out"), language.predict(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one among all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place and ids, read back from the files of a token store."""
    out = token_store.new_store(spark)
    token_store.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), out)
    return token_store.read_tokens(spark, out)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of their links."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a media container, and what is read back from it."""
    stored = media.with_media(table(spark, sf_dir, "documents"), F.col("text"))
    info = stored.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), media.probe(F.col("media")).alias("i"))
    return info.select("doc_id", "n_bytes", "i.payload_bytes", "i.payload_sha256", "i.tail_crc32", "i.media_bytes", "i.media_sha256", media.feature(F.col("i")).alias("feature"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4,096 tokens."""
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 4096)
    return packing.pack(pieces, 4096)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation's turns, read back from its formatted text."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", NOTE), (-1, 1, "assistant", NOTE)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(conversations.unionByName(own))
    formatted, turns = F.col("formatted"), F.col("turns")
    text = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), chat.unescaped(F.substring(formatted, (t["text_start"] + 1).cast("int"), (t["text_end"] - t["text_start"]).cast("int"))), F.lit("\n")))
    out = out.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(text, ""), 256).alias("turns_sha256"), chat.trained_text(formatted, turns).alias("loss"), F.length(formatted).cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of nearest labelled neighbours of quality, for every document."""
    small_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"), quality.predict(F.col("text"), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every hundredth vector that score nearly as high as its positives; a seventh of the labels is shifted."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired turns of every conversation, after planted damage."""
    whole = table(spark, sf_dir, "conversations")
    found, turns = repair.repair_conversations(repair.damaged(whole))
    ids, hashes = whole.select(F.col("conv_id").alias("id")).distinct(), repair.digests(turns).withColumnRenamed("conv_id", "hash_id")
    rows = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("id").eqNullSafe(F.col("hash_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *repair.COUNTS, "cost")]
    return rows.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its length."""
    small_batches(spark)
    pages = html.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def queries() -> dict:
    import corpus_pipeline

    own = [op1_token_count, op2_language_id, op3_topk_search, op4_bpe_codec, op5_token_store, op6_simhash, op7_media, op8_packing, op9_chat_format, op10_quality, op11_hard_negatives, op12_conversation_repair, op13_html_extraction]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


SQL_OP3 = """
WITH ok AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

SQL_OP9 = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), shown AS (
    SELECT *, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS shown_role, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS shown_text FROM turns
), whole AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS all_turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        CAST(sum(length(shown_role) + length(shown_text) + length('<|im_start|>') + length('<|im_end|>') + 2) AS BIGINT) AS formatted_chars
    FROM shown GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole
"""

SQL_OP11 = """
WITH ok AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
    FROM ok a JOIN ok r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
    n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY rank <= 5
"""

#: The checksum is computed byte by byte with its table of 256; a recursive query keeps the best (cost, audit) of each state.
SQL_OP12 = r"""
WITH RECURSIVE bits(n, k, v) AS (
    SELECT n, 0, n FROM range(256) t(n)
    UNION ALL SELECT n, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8
), lookup AS (
    SELECT list(v ORDER BY n) AS xs FROM bits WHERE k = 8
), lots AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda a, b: xor(a // 256, xs[(xor(a, b) % 256) + 1])), 4294967295) % 20 AS lot
    FROM conversations, lookup
), damaged AS (
    SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
        CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy
    FROM lots WHERE lot <> 0
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS initial
    FROM damaged
), marked AS (
    SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
    FROM ordered
), facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
        count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM marked GROUP BY conv_id
), inserts(p, q, roles, edits) AS (
    SELECT q, q, '', '' FROM range(4) t(q)
    UNION ALL SELECT * FROM (VALUES (0, 2, 'u', 'I'), (0, 3, 'ua', 'II'), (1, 2, 'u', 'I'), (1, 3, 'ua', 'II'), (2, 3, 'a', 'I'), (3, 2, 'u', 'I')) v(p, q, roles, edits)
), reads(p, q, edit, cost, role) AS (
    SELECT q, q, 'D', 3, '' FROM range(4) t(q)
    UNION ALL SELECT * FROM (VALUES (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'), (3, 2, 'K', 0, 'u'), (0, 2, 'R', 2, 'u'), (1, 2, 'R', 2, 'u'), (2, 3, 'R', 2, 'a'), (3, 2, 'R', 2, 'u')) v(p, q, edit, cost, role)
), best(conv_id, i, state, cost, audit) AS (
    SELECT conv_id, CAST(0 AS BIGINT), q, CAST(2 * length(edits) AS BIGINT), edits FROM facts, inserts WHERE p = 0
    UNION ALL
    SELECT conv_id, i, state, cost, audit FROM (
        SELECT b.conv_id, b.i + 1 AS i, n.q AS state, b.cost + r.cost + (r.edit <> 'D' AND m.fault = 'truncated')::BIGINT + 2 * length(n.edits) AS cost, b.audit || r.edit || n.edits AS audit,
            row_number() OVER (PARTITION BY b.conv_id, n.q ORDER BY b.cost + r.cost + (r.edit <> 'D' AND m.fault = 'truncated')::BIGINT + 2 * length(n.edits), b.audit || r.edit || n.edits) AS place
        FROM best b JOIN marked m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1 JOIN reads r ON r.p = b.state JOIN inserts n ON n.p = r.q
        WHERE r.edit = 'D' OR (m.fault NOT IN ('blank', 'duplicate') AND (r.edit = 'R' OR m.initial = r.role))
    ) WHERE place = 1
), chosen AS (
    SELECT f.*, b.cost, b.audit FROM facts f JOIN best b ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.i = f.n AND b.state IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY f.conv_id ORDER BY b.cost, b.audit) = 1
), steps AS (
    SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS k FROM chosen WHERE audit <> ''
), placed AS (
    SELECT *, sum((edit <> 'I')::INTEGER) OVER (PARTITION BY conv_id ORDER BY k) AS i FROM steps
), turns AS (
    SELECT p.conv_id, k, edit, m.role, m.text, (edit = 'K' AND m.initial = 's') AS is_system,
        row_number() OVER (PARTITION BY p.conv_id, (edit = 'K' AND m.initial = 's') ORDER BY k) AS nth
    FROM placed p LEFT JOIN marked m ON p.edit <> 'I' AND m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i WHERE edit <> 'D'
), hashes AS (
    SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS digest
    FROM turns GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
    coalesce(c.illegal, 0) AS illegal, coalesce(c.cost, 0) AS cost, coalesce(c.audit, '') AS audit, coalesce(h.digest, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

#: For pages as the tables have them, whose article is an element of that name with headings and paragraphs; SQL can't parse others.
SQL_OP13 = r"""
WITH articles AS (
    SELECT page_id, url, string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages
), plain AS (
    SELECT page_id, url, list_transform(parts, lambda p: regexp_replace(regexp_replace(p, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g')) AS parts FROM articles
), shown AS (
    SELECT page_id, url, list_transform(parts, lambda p: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(p, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g'), '[\s\x0b]+', ' ', 'g'))) AS parts FROM plain
), joined AS (
    SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda p: p <> ''), chr(10) || chr(10)), '') AS text FROM shown
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM joined
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    own = {"op3_topk_search": SQL_OP3, "op9_chat_format": SQL_OP9, "op11_hard_negatives": SQL_OP11, "op12_conversation_repair": SQL_OP12, "op13_html_extraction": SQL_OP13}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
