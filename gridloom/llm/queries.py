"""The registered queries of the text-corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html, langid, license, media, neardup, pii, tokens, urls
from .common import table
from .oracles import NEAR_DUPLICATES, license_sql, overlap_sql, url_sql

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts, digest of the base spans, all spans."""
    return pii.scan_documents(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a motion-JPEG AVI file, read back, with its shots as timed clips."""
    return media.media_documents(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and grants in every document."""
    return license.scan(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on 2-word shingles at a similarity of 0.8."""
    return neardup.group(table(spark, sf_dir, "documents"), size=2, threshold=(80, 100)).drop("text_key")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, as digests, with the digest of what they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark items, and where."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs.where(~langid.held_out())))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


#: Rules of op9 (fixed values): host and path, verdict.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).withColumn("purity", F.round("purity", 9))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 bytes and tokens of every document."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER, limit=512)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_media": op2_media,
    "op3_license_scan": op3_license_scan,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_decontamination": op6_decontamination,
    "op7_language": op7_language,
    "op8_main_text": op8_main_text,
    "op9_url_filter": op9_url_filter,
    "op10_token_counts": op10_token_counts,
}

#: The others learn, tokenize, decode or join similar sets, which SQL cannot do or not on whole tables; they are tested
#: against brute-force versions.
ORACLES: dict[str, str] = {"op3_license_scan": license_sql(), "op4_near_duplicates": NEAR_DUPLICATES, "op6_decontamination": overlap_sql(), "op9_url_filter": url_sql(URL_RULES)}
