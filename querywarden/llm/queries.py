"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querywarden.llm import alignment_ids, chat, decontamination, divergence, html_extraction, hyperminhash, langid, packing, quality, secrets, simhash, substrings, surrogates
from querywarden.llm.base import read_table

Query = Callable[[SparkSession, str], DataFrame]
#: A deployment keeps its key to itself; this one makes the registered query repeatable.
SURROGATE_KEY = "example key of the registered query"
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


@registered
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the formatted text."""
    said = r"\### Assistant: </turn> ok"
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    back = chat.read_back(chat.format_chats(turns.unionByName(own)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE["op9_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), shown AS (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
        length(replace(replace(replace(replace(text, '\', '\\'), '###', '##'), '</turn>', '\e'), '<more/>', '\m')) AS text_chars,
        length(role) AS role_chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(text_chars + CASE WHEN before IS NULL OR before <> role THEN role_chars + 14 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""


@registered
def op10_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document and the verdict of the newest policy."""
    out, held = quality.ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    field = F.col(held)
    return out.select(
        "doc_id",
        *[field[m].alias(m) for m in quality.MEASURES],
        field["failed"].alias("failed_bits"),
        (~quality.kept(field["failed"], "base")).alias("base_failed"),
        quality.kept(field["failed"], "v2").alias("kept"),
    )


def _ledger_sql() -> str:
    """Counts by unnesting words. Measurements, rules and policies are written out again; only the list of flagged
    words is the operator's. A flagged word is a whole run of letters."""
    flagged = ", ".join(f"'{word}'" for word in quality.FLAGGED)
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0d]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
grams AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
repeats AS (
    SELECT doc_id, count(DISTINCT pos) AS n_repeat_words
    FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM grams WHERE w3 IS NOT NULL) WHERE n > 1)
    GROUP BY doc_id
),
counts AS (
    SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (regexp_matches(w, '\p{{L}}')) AS n_alpha_words,
        count(*) FILTER (length(w) > 1 AND w = upper(w) AND w <> lower(w)) AS n_upper_words
    FROM words GROUP BY doc_id
),
lines AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^ \x09-\x0d]') GROUP BY doc_id
),
m AS (
    SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_alpha_words, 0) AS n_alpha_words, coalesce(n_upper_words, 0) AS n_upper_words,
        len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nl}}\p{{No}}]+'), lambda w: w IN ({flagged}))) AS n_flagged
    FROM docs LEFT JOIN counts USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
),
judged AS (
    SELECT *, CAST(
        (n_words < 50)::INT + 2 * (2 * n_repeat_words > n_words)::INT + 4 * (n_symbols > n_words / 10)::INT + 8 * (2 * n_dup_lines > n_lines)::INT
        + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 15 * n_words)::INT + 64 * (10 * n_alpha_words < 7 * n_words)::INT
        + 128 * (2 * n_upper_words > n_words)::INT + 256 * (n_flagged > 2 AND n_flagged > n_words / 200)::INT
    AS BIGINT) AS failed_bits FROM m
)
SELECT *, failed_bits % 4 <> 0 AS base_failed, failed_bits = 0 AS kept FROM judged
"""


ORACLE["op10_quality_ledger"] = _ledger_sql()


@registered
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base kinds, and all spans."""
    out, held = secrets.with_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds: str) -> Column:
        return F.filter(held, lambda s: s["kind"].isin(*kinds))

    return out.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(joined(of(*secrets.BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col(held)).alias("spans"),
    )


@registered
def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 512 to 4096 tokens, none of which needs padding."""
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@registered
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    classes = simhash.near_classes(read_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@registered
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@registered
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "language.lang_pred", "language.score")


@registered
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extraction.extract(read_table(spark, sf_dir, "pages"))


@registered
def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    out, counted = surrogates.replaced(read_table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)
    return out.select("doc_id", "text", F.col(counted).alias("n_entities"))


@registered
def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without windows of 35 words that start elsewhere too."""
    out = substrings.deduplicated(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@registered
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence between the sources of every language, and the terms that mark each source."""
    return divergence.source_audit(read_table(spark, sf_dir, "documents"))


ORACLE["op12_source_audit"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), words AS (
    SELECT d, lang, source, unnest(regexp_extract_all(text, '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
    SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), groups AS (
    SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL
), cells AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * s.v) AS p,
        1 + 1000000000 * (k.n + 2) // (s.total + 2 * s.v) AS q
    FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON s.lang = g.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
    SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM cells WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@registered
def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and near-duplicate component of every document."""
    return hyperminhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@registered
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers align in every document, and how common its linked pairs of ids are."""
    docs = read_table(spark, sf_dir, "documents")
    return alignment_ids.token_alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
