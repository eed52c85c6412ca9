"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, langid, minhash, mixing, quality, sharding, urls, warc, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_warc": warc.op2_warc,
    "op3_sharding": sharding.op3_sharding,
    "op4_html": html.op4_html,
    "op5_mixing": mixing.op5_mixing,
    "op6_urls": urls.op6_urls,
    "op6_urls_domains": urls.op6_urls_domains,
    "op7_minhash": minhash.op7_minhash,
    "op8_winnow": winnow.op8_winnow,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_language": langid.op10_language,
}
ORACLES: dict[str, str] = {
    "op3_sharding": sharding.OP3_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_urls": urls.OP6_SQL,
}
