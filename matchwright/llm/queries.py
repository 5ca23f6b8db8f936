"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, compaction, exact_topk, html_extraction, language_id, license_scan, minhash_dedup, sentencepiece_backend, simhash_dedup, source_mixing, stable_projection_ann, token_alignment, token_files
from .common import table


def vocabulary(name: str) -> str:
    """A public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, from a network that saw the documents that are not held
    out; null texts and texts without a letter are ``und``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select(
        "doc_id",
        language_id.held_out(F.col("doc_id")).alias("held_out"),
        F.col("language_id.lang").alias("lang_pred"),
        F.col("language_id.score").alias("score"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that spells control strings, formatted, and read back from what
    was written. Turns of one number (ties) go by role and text; null texts are empty."""
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = chat_format.format_chats(chat_format.from_rows(rows.unionByName(more)))
    read = chats.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("back"), F.array_join(chat_format.masked_texts(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's block and place in a mixture of the sources by tempered weights; null
    sources are one source, rows that repeat stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return source_mixing.mix(docs).select("doc_id", "source", "mix.*")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of each query by whole inner product; ties to the smaller id."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk.exact_top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op9_stable_projection_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of each query by inner product; ties to the smaller id."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return stable_projection_ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Every whole text in ids of the public model, read back, and whether the sentencepiece
    library agrees; a null text is empty."""
    with open(model or vocabulary("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    return sentencepiece_backend.encode(table(spark, sf_dir, "documents"), data, check=True)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; empty where there is none."""
    pages = html_extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and texts in every whole text; a null text is empty."""
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license_scan.*")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicates among all whole texts; a text without words is near to nothing."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every whole text in token files, as the library encodes it by default, read back from
    them; a null text is empty, rows that repeat an id go by a hash of their text."""
    with open(tokenizer or vocabulary("byte_bpe_50k.json")) as f:
        model = f.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.read_documents(spark, token_files.write_tokens(docs, token_files.fresh_folder(spark, "tokens"), model, special=True))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every whole text and the smallest id that links at three or fewer
    differing bits reach; null and wordless texts have the fingerprint zero."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clicks as files, the small ones of each day merged; what then stands in the folder."""
    return compaction.compact(table(spark, sf_dir, "clicks"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte-level ids of every whole text aligned with its SentencePiece ids; a null text has none."""
    with open(vocabulary("byte_bpe_50k.json")) as a, open(vocabulary("piece_bpe_32k.model"), "rb") as b:
        return token_alignment.align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), a.read(), b.read())


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_chat_format": op2_chat_format,
    "op3_source_mixing": op3_source_mixing,
    "op4_exact_topk": op4_exact_topk,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_html_extraction": op6_html_extraction,
    "op7_license_scan": op7_license_scan,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_stable_projection_ann": op9_stable_projection_ann,
    "op10_token_files": op10_token_files,
    "op11_simhash_dedup": op11_simhash_dedup,
    "op12_compaction": op12_compaction,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT CAST(-7 AS BIGINT), CAST(n AS BIGINT), CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok'
    FROM range(2) t(n)
), marked AS (
    SELECT *, replace(replace(role, '\', '\b'), '|', '\p') AS r, replace(replace(text, '\', '\b'), '|', '\p') AS t FROM rows
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(r) + length(t) + 12) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id""",
    "op3_source_mixing": """
WITH RECURSIVE docs AS (
    SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS src,
        md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), counts AS (
    SELECT src, pow(CAST(count(*) AS DOUBLE), 0.7) AS raw, count(*) OVER () AS k FROM docs GROUP BY src
), shares AS (
    SELECT src, k, greatest(1000, 4 * k) AS period, (greatest(1000, 4 * k) - k) * raw / sum(raw) OVER () AS share FROM counts
), split AS (
    SELECT *, floor(share) AS whole, row_number() OVER (ORDER BY share - floor(share) DESC, src) AS place,
        period - k - sum(floor(share)) OVER () AS spare, row_number() OVER (ORDER BY src) AS idx
    FROM shares
), weights AS (
    SELECT src, idx, period, CAST(1 + whole + CASE WHEN place <= spare THEN 1 ELSE 0 END AS BIGINT) AS w FROM split
), listed AS (
    SELECT list(w ORDER BY idx) AS ws, max(period) AS period FROM weights
), edf AS (
    SELECT 0 AS t, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM listed
    UNION ALL
    SELECT t + 1, list_transform(done, lambda d, i: CASE WHEN i = p THEN d + 1 ELSE d END), p
    FROM (
        SELECT e.t, e.done, list_min(list_filter(
            list_transform(e.done, lambda d, i: {'deadline': CAST(ceil((d + 1) * l.period / l.ws[i]) AS BIGINT), 'i': i, 'release': CAST(floor(d * l.period / l.ws[i]) AS BIGINT)}),
            lambda c: c.release <= e.t)).i AS p, l.period
        FROM edf e, listed l WHERE e.t < l.period
    )
), cycle AS (
    SELECT pick AS idx, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM edf WHERE t > 0
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY h, doc_id) - 1 AS g FROM docs
), blocks AS (
    SELECT n.doc_id, n.source, n.g // 32 AS block, n.g % 32 AS place, w.w, w.idx, w.period FROM numbered n JOIN weights w USING (src)
)
SELECT b.doc_id, b.source, CAST(b.block AS BIGINT) AS block, b.w AS weight,
    CAST(floor(b.block * b.period / b.w) AS BIGINT) AS release, CAST(ceil((b.block + 1) * b.period / b.w) AS BIGINT) AS deadline,
    CAST((b.block // b.w) * b.period + c.slot AS BIGINT) AS slot, CAST(b.place AS INTEGER) AS place
FROM blocks b JOIN cycle c ON c.idx = b.idx AND c.j = b.block % b.w""",
    "op4_exact_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20""",
}
