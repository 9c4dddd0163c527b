"""A corpus pipeline: toxic and poor documents go, near copies go, personal data is taken out, the rest is packed.

Every stage takes documents (doc_id, text, lang, source, n_chars; other columns are left out, whatever their names) and works on
all of them, whole texts of any length, one row at a time in memory but for a bounded slice of a batch.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismark.llm import packing, pii, rules, simhash, toxicity
from prismark.llm.common import cut, remove, table

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5; the lexicon is learned from labels of the documents at hand.

    A null text counts as empty and stays null; rows that repeat score alike and stay or go together; rows with a null id are
    scored but teach nothing. Without documents or labels the lexicon is empty; no documents give no rows. A score of
    exactly 0.5 goes.
    """
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon, name="__score").where(F.col("__score") < 0.5).select(*DOCUMENT)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the base and the current policy.

    Null and empty texts have too few words and go. A row's own text alone decides, so nulls in other columns, repeated rows
    and ties change nothing; limits are as the rules say (at a limit a document stays). No documents give no rows.
    """
    return rules.ledger(docs).where(rules.passes(rules.BASE) & rules.passes(rules.STRICT)).select(*DOCUMENT)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one of the smallest id.

    Components are of fingerprints, as several texts may share an id: each text keeps a document of its own component. Of
    rows that tie in id and fingerprint the one of least (text's CRC, length, n_chars, lang, source) stays, nulls first, so each run keeps the
    same. Null and empty texts are copies of one another. Documents without an id stay, for nothing names them. No
    documents give no rows.
    """
    docs = docs.select(*DOCUMENT)
    named = docs.where("doc_id is not null")
    prints = cut(simhash.with_fingerprint(named, "text", keep=["doc_id"]), "fingerprints")
    found = simhash.classes(prints.select("fingerprint", F.col("fingerprint").alias("node")), id_col="node")
    stays = prints.join(found, "fingerprint").groupBy("component_id").agg(F.min(F.struct("doc_id", "fingerprint")).alias("first"))
    stays = cut(stays.select("first.doc_id", "first.fingerprint"), "components")
    # an id of one row stays or goes by itself; only rows that share an id must be told apart by their fingerprints again
    shared = cut(prints.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "shared")
    alone = named.join(stays.join(shared, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi")
    told = simhash.with_fingerprint(named.join(stays.join(shared, "doc_id", "left_semi").select("doc_id").distinct(), "doc_id", "left_semi"), "text", keep=list(DOCUMENT))
    order = F.struct(F.crc32(F.col("text").cast("binary")).alias("crc"), F.length("text").alias("length"), "n_chars", "lang", "source")
    once = told.join(stays, ["doc_id", "fingerprint"], "left_semi").groupBy("doc_id", "fingerprint").agg(F.min_by(F.struct(*DOCUMENT), order).alias("d")).select("d.*")
    return alone.select(*DOCUMENT).unionByName(once.select(*DOCUMENT)).unionByName(docs.where("doc_id is null"))


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without personal data; n_chars is counted anew.

    Null and empty texts stay as they are, with n_chars null and 0. Rows that repeat are cleaned alike; spans that tie or overlap are
    replaced once. How strongly terms give entities away is counted over the documents at hand. No documents give no rows.
    """
    clean = pii.redact(pii.find(docs.select(*DOCUMENT)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences.

    Null and empty texts are one token, the end's. Ids may be null or repeat: pieces keep them. Long texts are cut
    into as many pieces as it takes; documents that tie go in as they come. No documents give no rows.
    """
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), limits=packing.QUERY_LIMITS, prompt=packing.QUERY_PROMPT)
    return packing.digests(packed)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("simhash", drop_copies),
    ("pii", redact_private),
    ("packing", pack_sequences),
]

#: A learned lexicon and a tokenizer can't be written as SQL; tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            remove(before)  # nothing reads what the last stage read
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
