"""The registered queries opN_<name>: each applies an operator of this folder to a
whole table of the driver and derives the digest columns from its output."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelink.llm import (
    byte_pairs,
    chat,
    decontamination,
    language,
    licenses,
    packing,
    resampling,
    sharding,
    similarity,
    topk,
    toxicity,
    url_rules,
    whitening,
)
from tablelink.llm.shared import given_back, held_out, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


@register
def op1_jaccard_join(spark, folder):
    return similarity.link_documents(table(spark, folder, "documents")).select(
        "doc_id", "n_shingles", "component_id"
    )


@register
def op2_top_k(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@register
def op3_histogram_sort(spark, folder):
    docs = table(spark, folder, "documents")
    return sharding.shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def tokenizer_text(path: str | None = None) -> str:
    """Content of a tokenizer file; by default the public one the contract names."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Path(path).read_text(encoding="utf-8")


@register
def op4_pack(spark, folder):
    docs = table(spark, folder, "documents")
    return packing.pack_documents(docs, tokenizer_text()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


@register
def op5_decontaminate(spark, folder):
    matched = decontamination.match_benchmark(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    )
    return matched.select(
        "doc_id",
        F.col("match.n_words").alias("n_words"),
        decontamination.hit_words().alias("n_hit"),
        F.size("match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("match.items", ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.is_contaminated().alias("contaminated"),
    )


@register
def op6_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows, share = toxicity.training_rows(
        docs, table(spark, folder, "labels"), ~held_out(F.col("doc_id")), "doc_id", "text", "toxic"
    )
    scored = toxicity.score_toxicity(docs, toxicity.train(rows, share))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


@register
def op7_url_rules(spark, folder):
    return url_rules.judge_urls(table(spark, folder, "pages")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


@register
def op8_license_scan(spark, folder):
    scan = F.col("license_scan")
    starts, found = scan["base"]["first"], scan["found"]
    given = F.filter(found["label"], lambda label: label.isNotNull())
    labels = F.array_distinct(F.sort_array(F.concat(scan["base"]["label"], given)))
    return licenses.scan_licenses(table(spark, folder, "documents")).select(
        "doc_id",
        scan["n_words"].alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_distinct(F.sort_array(scan["base"]["label"])), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(found["score"]), F.lit(0.0)).alias("score"),
    )


@register
def op9_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    rows = language.training_rows(docs, ~held_out(F.col("doc_id")), "doc_id", "text", "lang")
    made = language.identify_languages(docs.select("doc_id", "text"), language.train(rows))
    return made.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score"
    )


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for tree, formatted, spans in zip(batch["tree"], batch["formatted"], batch["spans"]):
            turns = chat.read_turns(formatted)
            loss = chat.loss_text(formatted, [(s["start"], s["end"]) for s in spans])
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((tree, len(turns), _digest(said), len(loss), _digest(loss), len(formatted)))
        yield pd.DataFrame(
            rows,
            columns=["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


@register
def op10_chat_format(spark, folder):
    extra = spark.sql(
        "SELECT -1L AS conv_id, pos AS turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM (SELECT posexplode(array('user', 'assistant')) AS (pos, role))"
    )
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    turns = chat.turns_in_order(given.unionByName(extra))
    read = chat.format_conversations(turns, best=1).mapInPandas(
        given_back(_read_back),
        "tree string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long",
    )
    conv_id = F.when(F.col("tree") != "", F.col("tree").cast("long")).alias("conv_id")
    return read.select(
        conv_id, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


def byte_coder(path: str | None = None, pattern: str | None = None) -> byte_pairs.BytePairs:
    """Coder of a rank file; by default the public one the contract names."""
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    return byte_pairs.BytePairs(byte_pairs.read_ranks(Path(path).read_bytes()), pattern)


@register
def op11_byte_pairs(spark, folder):
    coder = byte_coder()
    encoded = byte_pairs.encode_texts(table(spark, folder, "documents").select("doc_id", "text"), coder)
    decoded = byte_pairs.decode_ids(encoded.select("doc_id", "encoded"), coder, F.col("encoded.ids"))
    return decoded.select(
        "doc_id",
        "encoded.n_tokens",
        F.sha2("encoded.ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register
def op12_resampling(spark, folder):
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank"
    )


@register
def op13_whitening(spark, folder):
    made = whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    each = made.select("vec_id", "whitening", F.posexplode("whitening.whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "whitening.n",
        "whitening.deviation",
        "whitened",
        F.col("whitening.explained")[F.col("at")].alias("explained"),
        "whitening.identity_error",
    )
