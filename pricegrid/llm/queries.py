"""The registered queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, language, negatives, pii, quality, secrets, shards, tokens, toxicity, variants, vectors
from .common import crc_mod, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language.train_language_model(docs.filter(crc_mod("doc_id", 4) != 2))
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return language.identify_language(docs, net, keep=[held])


def _counts(spans: str, field: str, kinds: tuple[str, ...]) -> list[Column]:
    """How many of the array's spans have each kind's number in ``field``, as n_<kind>.

    The number is bound here: a second parameter of the lambda would be the element's index.
    """

    def of_kind(number: int) -> Column:
        return F.size(F.filter(spans, lambda s: s[field] == number)).cast("long")

    return [of_kind(number).alias(f"n_{kind}") for number, kind in enumerate(kinds)]


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *_counts("base", "kind", pii.KINDS),
        F.sha2(pii.span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.span_list(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc_mod("doc_id", 5)
    model = quality.train_quality(docs, table(spark, sf_dir, "labels").filter(fold != 0))
    scored = quality.score_quality(docs, model, host=F.col("source"), path=F.col("lang"))
    return scored.withColumn("keep", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc_mod("doc_id", 5)
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels").filter(fold != 0))
    scored = toxicity.score_toxicity(docs, model, keep=[F.coalesce(fold == 0, F.lit(False)).alias("held_out")])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *_counts("base", "ord", secrets.KINDS[:3]),
        F.sha2(secrets.span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.span_list(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = tokens.encode_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema)
    turns = rows.unionByName(planted).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.read_back(chat.format_turns(turns)).withColumnRenamed("conv", "conv_id")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op3_jaccard": op3_jaccard,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_decontaminate": op7_decontaminate,
    "op8_bpe": op8_bpe,
    "op9_top_k": op9_top_k,
    "op10_shards": op10_shards,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_chat": op13_chat,
}

ORACLE_SQL: dict[str, str] = {
    "op9_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id),
        ranked AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op11_spelling_variants": """
        WITH crc AS (
          SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda s, b: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END) ORDER BY i) AS step
          FROM range(256) r(i)),
        runs AS (
          SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id,
            translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
          FROM documents),
        bytes AS (
          SELECT run, flatten(list_transform(range(1, length(id || run) + 1), lambda i:
            CASE WHEN unicode(substring(id || run, i, 1)) < 128 THEN [unicode(substring(id || run, i, 1))::BIGINT] ELSE [195, unicode(substring(id || run, i, 1))::BIGINT - 64] END)) AS b
          FROM runs),
        hashed AS (
          SELECT run, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda s, x: xor(s >> 8, step[(xor(s, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc),
        v AS (
          SELECT word, count(*) AS n FROM (
            SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM hashed)
          WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
        cuts AS (
          SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
        near AS (
          SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT v.word, c.word, c.n FROM v JOIN cuts c ON v.word = c.rest
          UNION SELECT c.word, v.word, v.n FROM v JOIN cuts c ON v.word = c.rest),
        best AS (
          SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, other_n FROM near
          QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
        formed AS (
          SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n
          FROM v LEFT JOIN best USING (word)),
        roots AS (
          WITH RECURSIVE walk(word, root, form) AS (
            SELECT word, word, form FROM formed
            UNION ALL SELECT walk.word, formed.word, formed.form FROM walk JOIN formed ON walk.form = formed.word)
          SELECT word, root FROM walk WHERE form IS NULL)
        SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
    """,
    "op12_hard_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
          FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a JOIN v c ON c.vec_id <> a.vec_id),
        positive AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM positive JOIN (SELECT * FROM scored WHERE NOT same) USING (anchor_id)
        WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 10
    """,
    "op13_chat": r"""
        WITH t AS (
          SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL
          SELECT -7, u.turn, u.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) u(turn, role)),
        f AS (
          SELECT *, regexp_replace(text, '(\\|### |</turn>|<\|)', '\\\1', 'g') AS body,
            regexp_replace(role, '([\\:#<\n])', '\\\1', 'g') AS head FROM t)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body || '</turn>' || chr(10))) AS turns_sha256,
          CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
          sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, body || '</turn>' || chr(10))) AS loss_sha256,
          CAST(sum(4 + length(head) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
        FROM f GROUP BY conv_id
    """,
}
