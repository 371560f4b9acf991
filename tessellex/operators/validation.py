"""Table checks: rows that keep the rules, and rejected rows with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex import fixed_values as fv
from tessellex.functions import text as tx

Rule = tuple[str, Column]


def _year_rule(column: str) -> Rule:
    year = F.col(column)
    return f"{column} outside {fv.YEAR_MIN}..{fv.YEAR_MAX}", year.isNull() | year.between(fv.YEAR_MIN, fv.YEAR_MAX)


def document_rules() -> list[Rule]:
    return [
        ("source_file is blank", tx.blank_to_null(F.col("source_file")).isNotNull()),
        _year_rule("year"),
    ]


def chunk_rules() -> list[Rule]:
    return [
        ("chunk_index below 0", F.col("chunk_index") >= 0),
        ("start_char below 0", F.col("start_char") >= 0),
        ("end_char below start_char", F.col("end_char") >= F.col("start_char")),
    ]


def section_rules() -> list[Rule]:
    start, end = F.col("page_range_start"), F.col("page_range_end")
    return [
        _year_rule("act_year"),
        ("page range is reversed", start.isNull() | end.isNull() | (start <= end)),
        ("confidence outside 0..1", F.col("extraction_confidence").between(0.0, 1.0)),
    ]


def check(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``reason``: the first broken rule, NULL for a valid row."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]
    return df.withColumn("reason", F.coalesce(*broken))


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``."""
    checked = check(df, rules)
    return (
        checked.where(F.col("reason").isNull()).drop("reason"),
        checked.where(F.col("reason").isNotNull()),
    )


def check_retrieval_sizes(top_k_dense: int, top_k_sparse: int, top_k_rerank: int) -> None:
    if top_k_rerank > top_k_dense + top_k_sparse:
        raise ValueError("top_k_rerank must not exceed top_k_dense + top_k_sparse")
