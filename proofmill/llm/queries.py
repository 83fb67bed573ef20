"""The queries of this subpackage's operators, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat, decontaminate, language, minhash, mixing, pieces, quality, repeats, sharding, tries, urls, vectors
from .oracles import ORACLES as _EARLIER

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": chat.query,
    "op2_language_id": language.query,
    "op3_decontamination": decontaminate.query,
    "op4_embedding_dedup": vectors.query,
    "op5_suffix_dedup": repeats.query,
    "op6_url_filters": urls.query,
    "op7_quality_classifier": quality.query,
    "op8_sharding": sharding.query,
    "op9_sentencepiece": pieces.query,
    "op10_minhash_dedup": minhash.query,
    "op11_centroid_clustering": centroids.query,
    "op12_source_mixing": mixing.query,
    "op13_prefix_trie": tries.query,
}
ORACLES: dict[str, str] = _EARLIER | {"op11_centroid_clustering": centroids.ORACLE, "op12_source_mixing": mixing.ORACLE, "op13_prefix_trie": tries.ORACLE}
