"""The queries of the text operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, word_count
from .sql import SQL  # noqa: F401


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    found = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sources(docs, text=None).select("doc_id", "size", "source_size", "target", "taken")


def chat_digest(rows: DataFrame) -> DataFrame:
    """What the contract asks of formatted conversations, read back from the formatted text and its mask."""
    from .chat import formatted, linear_threads, read_back, unescaped

    out = formatted(linear_threads(rows))
    out = out.withColumns(
        {
            "_turns": read_back(F.col("formatted")),
            "_loss": F.array_join(F.transform("loss_mask", lambda s: unescaped(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))), ""),
        }
    )
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digest(rows.unionByName(extra))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def pii_digest(docs: DataFrame) -> DataFrame:
    from .pii import ADDED_KINDS, BASE_KINDS, find_pii, joined

    found = find_pii(docs)
    of = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("pii", lambda s: s["kind"].isin(list(BASE_KINDS)))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), *[of(k).alias(f"n_{k}") for k in ADDED_KINDS], F.size("pii").cast("long").alias("n_spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def vocabulary() -> str:
    """The tokenizer file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """path: the tokenizer file; that of the installed public tokenizers unless given."""
    from .bpe import encode_digest

    path = path or vocabulary()
    return encode_digest(table(spark, sf_dir, "documents").select("doc_id", "text"), path, ["doc_id"])


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def _fold(doc_id) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), _fold(F.col("doc_id")) != 1)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "toxic_spans")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_chat_format": op2_chat_format,
    "op3_url_filter": op3_url_filter,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_html_text": op6_html_text,
    "op7_bpe": op7_bpe,
    "op8_neighbours": op8_neighbours,
    "op9_ngram_join": op9_ngram_join,
    "op10_quality_rules": op10_quality_rules,
}
