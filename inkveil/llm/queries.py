"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkveil.llm import sql
from inkveil.llm.byte_bpe import op12_byte_bpe
from inkveil.llm.chat import op8_chat
from inkveil.llm.class_lm import op10_class_lm
from inkveil.llm.conversation_repair import op13_repair
from inkveil.llm.fingerprints import op4_fingerprint
from inkveil.llm.line_dedup import op5_line_dedup
from inkveil.llm.mixing import op2_mixing
from inkveil.llm.near_dedup import op1_near_dedup
from inkveil.llm.packing import op9_packing
from inkveil.llm.prefix_trie import op11_prefix_trie
from inkveil.llm.quality import op7_quality
from inkveil.llm.secret_scan import op3_secret_scan
from inkveil.llm.sharding import op6_shards

Query = Callable[[SparkSession, str], DataFrame]


def _on(operator: Callable[..., DataFrame], *tables: str) -> Query:
    """The operator over whole tables."""
    return lambda spark, sf_dir: operator(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])


def registered() -> dict[str, Query]:
    """Every query by name."""
    return {
        "op1_near_dedup": _on(op1_near_dedup, "documents"),
        "op2_mixing": _on(op2_mixing, "documents"),
        "op3_secret_scan": _on(op3_secret_scan, "documents"),
        "op4_fingerprint": _on(op4_fingerprint, "documents"),
        "op5_line_dedup": _on(op5_line_dedup, "documents"),
        "op6_shards": _on(op6_shards, "documents"),
        "op7_quality": _on(op7_quality, "documents", "labels"),
        "op8_chat": _on(op8_chat, "conversations"),
        "op9_packing": _on(op9_packing, "documents"),
        "op10_class_lm": _on(op10_class_lm, "documents"),
        "op11_prefix_trie": _on(op11_prefix_trie, "conversations"),
        "op12_byte_bpe": _on(op12_byte_bpe, "documents"),
        "op13_repair": _on(op13_repair, "conversations"),
    }


def statements() -> dict[str, str]:
    """SQL for DuckDB with the same result, by query name."""
    return {"op1_near_dedup": sql.OP1, "op7_quality": sql.OP7, "op8_chat": sql.OP8}
