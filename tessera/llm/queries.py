"""The training-data operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op2_decontaminate
from .language_model import op3_lm_scoring
from .line_dedup import op8_line_dedup
from .ngram_join import op1_ngram_join
from .online_packing import op11_online_packing
from .packing import op9_packing
from .quality_classifier import op7_quality_classifier
from .quality_rules import op6_quality_rules
from .secrets import op10_secrets
from .sharding import op4_sharding
from .source_divergence import OP12_SQL, op12_source_divergence
from .warc import op5_warc
from .whitening import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_join,
        op2_decontaminate,
        op3_lm_scoring,
        op4_sharding,
        op5_warc,
        op6_quality_rules,
        op7_quality_classifier,
        op8_line_dedup,
        op9_packing,
        op10_secrets,
        op11_online_packing,
        op12_source_divergence,
        op13_whitening,
    )
}

ORACLE: dict[str, str] = {"op12_source_divergence": OP12_SQL}
