"""The registered queries: each applies its operator, with production parameters, to the whole of its table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.views import even
from . import chat, embed_dedup, langid, lexical, licenses, minhash, mixing, negatives, packing, pieces, quality, sharding, topk
from .common import read as table
from .common import small_batches
from .vectors import finite

_END = {"special": (("<|endoftext|>", 50256),), "end_id": 0}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, name)


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pack_documents(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The sequences of packing with the public byte-level vocabulary, whose ids need two bytes at rest."""
    return packing.sequences(docs, keys, 1024, packing.byte_bpe_path(), ranks_path(), wide=False, **_END)


def digested(packed: DataFrame) -> DataFrame:
    return packing.pieces(packed).select("key.doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")


def op1_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(pack_documents(read(spark, sf_dir, "documents"), ["doc_id"]))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.9)


def op4_norm_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 1024).cast("double"))
    vectors = read(spark, sf_dir, "embeddings").filter(finite(F.col("embedding"))).select(F.col("vec_id").alias("vec"), whole.alias("x"))
    return topk.top_k(vectors, vectors.filter("vec % 100 = 0"), 10)


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def op5_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return langid.predict(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"]).select("key.*", "lang_pred", "score", "ambiguous")


def op6_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.grade(docs, quality.fit(docs, quality.graded(read(spark, sf_dir, "labels"))), ["doc_id"]).select("key.doc_id", "expected_grade", "tail", "selected")


def op7_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", same), (-1, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    turns = said.unionByName(more).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    done = chat.format_conversations(turns)
    back = done.withColumn("back", chat.parse_formatted(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("turns")))
    lines = F.concat_ws("", F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), "doc_id", shingle=2, percent=80)


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), ["doc_id"]).select("key.doc_id", "sentence_ids", "licences", "families", "matches")


def op10_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = spans.groupBy("rid").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "rid", "left").select("doc.doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op11_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(even(read(spark, sf_dir, "documents").select("doc_id", "text"))), read(spark, sf_dir, "benchmark"), 20)


def op12_agenda_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.decode(pieces.encode(even(read(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"]))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return coded.select(
        "key.doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), sha(F.col("text")).alias("decoded_sha256"),
        (F.col("as_library") & F.col("text_as_library")).alias("as_library"),
    )


def op13_blocked_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").filter(finite(F.col("embedding")) & F.col("label").isNotNull())
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 256).cast("double"))
    vectors = rows.select(F.col("vec_id").alias("vec"), label.alias("label"), whole.alias("x"))
    return negatives.hard_negatives(vectors, vectors.filter("vec % 50 = 0"))


QUERIES = {f.__name__: f for f in (op1_concat_cut, op2_kd_shards, op3_int8_tiles, op4_norm_sorted, op5_ecoc, op6_ordinal, op7_chat_parts, op8_tensored, op9_license_rules, op10_block_mix, op11_wavelet_search, op12_agenda_pieces, op13_blocked_gemm)}

_REACH = """, reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.v FROM reach r JOIN links l ON r.other = l.u),
        components AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

#: What DuckDB computes over the same tables; the other queries are held against brute force in tests/llm.
ORACLE = {
    "op3_int8_tiles": """
        WITH RECURSIVE x AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        unit AS (SELECT vec_id, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS x FROM x WHERE list_dot_product(x, x) > 0),
        links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) >= 0.9),
        nodes AS (SELECT DISTINCT u AS id FROM links)""" + _REACH + """
        SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) l ON l.u = e.vec_id LEFT JOIN components c ON c.id = e.vec_id""",
    "op7_chat_parts": r"""
        WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(x, '(␛)', '\1␛', 'g'), '<(\||/?s>|/?(?:image|audio|document|bos|eos|pad|unk)\b|</?SYS>>)', '<␛\1', 'g'), '\[(/?(?:INST|SYS|TOOL|AVAILABLE|IMG))', '[␛\1', 'g') AS y
              FROM (SELECT *, unnest([role, text]) AS x FROM said)),
        n AS (SELECT conv_id, sum(len(y)) AS n, count(*) // 2 AS turns FROM e GROUP BY conv_id)
        SELECT s.conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            (any_value(n.n) + 23 * any_value(n.turns))::BIGINT AS formatted_chars FROM said s JOIN n USING (conv_id) GROUP BY s.conv_id""",
    "op8_tensored": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
        links AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.doc_id <> b.doc_id AND len(a.s) > 0 AND 10 * len(b.s) >= 8 * len(a.s) AND 10 * len(a.s) >= 8 * len(b.s)
            WHERE 180 * len(list_intersect(a.s, b.s)) >= 80 * (len(a.s) + len(b.s))),
        nodes AS (SELECT DISTINCT u AS id FROM links)""" + _REACH + """
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, coalesce(c.component_id, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN components c ON c.id = s.doc_id""",
    "op4_norm_sorted": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_wavelet_search": r"""
        WITH t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
        c AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM t WHERE len(t) > 0),
        p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(100 - 25 + (25 * len * (SELECT n FROM c)) // (SELECT l FROM c)) AS m FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM t) GROUP BY doc_id, term),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
        w AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM c) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
        s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) GROUP BY item_id, doc_id),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
    "op13_blocked_gemm": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
