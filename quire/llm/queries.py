"""Queries of the training-data operators: one thin query for each, and the SQL of some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (
    compact_windows,
    external_shuffle,
    language_id,
    line_dedup,
    packing,
    piece_bpe,
    quality_cascade,
    simhash,
    string_tiling,
    token_alignment,
    toxicity,
    whitening,
    wordpiece_count,
)
from quire.llm.common import id_crc, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = id_crc(F.col("doc_id")) % 4 == 2
    model = language_id.fit(docs.where(~held))
    found = language_id.predict(docs, model)
    return found.select("doc_id", (id_crc(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return external_shuffle.shards(docs, 24).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(external_shuffle.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    made = quality_cascade.cascade(docs, statistics=base)
    failed = " OR ".join(f"({r.sql})" for r in quality_cascade.RULES if r.name in quality_cascade.BASE)
    return made.select("doc_id", *base, F.expr(failed).alias("base_failed"), "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines with a word before and after, and the crc32 of the text that is left."""
    count = F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", count.alias("n_lines"))
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", count.alias("n_kept"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_crc32"))


def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compact_windows.passages(docs)


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return string_tiling.matches(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op7_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece_count.token_counts(docs, vocabulary("piece_bpe_32k.model"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = id_crc(F.col("doc_id")) % 5 == 0
    model = toxicity.fit(docs, labels.where(~held))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.best_fit_packing(docs, vocabulary("byte_bpe_50k.json"))


def op11_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_bpe.round_trip(docs, vocabulary("piece_bpe_32k.model")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_external_shuffle,
        op3_quality_cascade,
        op4_line_dedup,
        op5_compact_windows,
        op6_string_tiling,
        op7_wordpiece_counts,
        op8_simhash,
        op9_toxicity,
        op10_best_fit_packing,
        op11_piece_round_trip,
        op12_token_alignment,
        op13_embedding_whitening,
    )
}

#: The same rows in DuckDB; the cascade's order doesn't change its verdict, so SQL can state it.
ORACLE_SQL: dict[str, str] = {
    "op3_quality_cascade": r"""
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
b as (select doc_id, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
p as (select doc_id, w, unnest(range(1, len(w) - 1)) i from d where len(w) > 2),
g as (select doc_id, i, count(*) over (partition by doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) n from p),
r as (select doc_id, count(distinct i + j)::bigint n_repeat_words from g, range(0, 3) q(j) where n > 1 group by doc_id),
a as (select doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words, len(ls) n_lines
  from b left join r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 30 * n_lines or word_chars > 40 * n_words) kept from a""",
}
