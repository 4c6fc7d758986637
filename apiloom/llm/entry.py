"""Queries of the corpus operators, by name, with the SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from apiloom.llm.bitplane_clusters import OP12_SQL, op12_centroid_clusters
from apiloom.llm.cover_dedup import OP13_SQL, op13_substring_dedup
from apiloom.llm.decontamination import op8_decontamination
from apiloom.llm.html_extraction import op10_html_extraction
from apiloom.llm.jaccard_join import op7_jaccard_join
from apiloom.llm.language_crf import op3_language_id
from apiloom.llm.quality_rules import op5_quality_rules
from apiloom.llm.secrets import op2_secret_scan
from apiloom.llm.sentencepiece_sa import op4_sentencepiece
from apiloom.llm.sharding import op1_sharding
from apiloom.llm.url_rules import OP9_SQL, op9_url_filters
from apiloom.llm.vector_codes import OP11_SQL, op11_vector_codes
from apiloom.llm.warc_derivatives import op6_warc_derivatives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_secret_scan": op2_secret_scan,
    "op3_language_id": op3_language_id,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_decontamination": op8_decontamination,
    "op9_url_filters": op9_url_filters,
    "op10_html_extraction": op10_html_extraction,
    "op11_vector_codes": op11_vector_codes,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op9_url_filters": OP9_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_centroid_clusters": OP12_SQL,
    "op13_substring_dedup": OP13_SQL,
}
