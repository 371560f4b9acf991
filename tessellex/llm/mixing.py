"""Mixing sources to target weights by Poisson replication.

A document of a source repeats as often as a Poisson variable says whose mean is the source's
target repetition rate: target share * size of the mix / documents of the source. The variable is
found by inverting the distribution at a uniform number hashed from seed and id, so a run gives
the same copies on any cluster. Copies are exploded and dealt out over the cluster in an order
hashed from seed, id and copy number.

Defined results: a null source is a source of its own. Rows that share an id draw the same number.
Target shares are relative to their sum; a source without one gets none and leaves the mix.
Without shares each source gets the power ``alpha`` of its size. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex.llm.common import join_groups

ALPHA = 0.5
SEED = "mix-1"
STEP = 16.0
TAIL = 80
NULL_SOURCE = "(null)"


def uniform(seed: str, *columns: Column) -> Column:
    """Number in [0, 1) from the first 52 bits of an MD5 of the seed and the columns' texts."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def cumulative(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... for a rate of at most STEP; the list ends where the tail is below 2**-53."""
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(TAIL)),
        F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cum")),
        lambda s, j: F.struct(
            (s["p"] * rate / j).alias("p"),
            F.array_append(s["cum"], F.element_at(s["cum"], -1) + s["p"] * rate / j).alias("cum"),
        ),
    )
    return state["cum"]


def poisson_count(seed: str, row_id: Column, steps: Column, cum: Column) -> Column:
    """Sum over the steps of the smallest k whose cumulative probability exceeds the step's uniform number."""
    return F.aggregate(
        F.sequence(F.lit(1), steps),
        F.lit(0),
        lambda total, i: total + _below(cum, uniform(seed, row_id, i)),
    )


def _below(cum: Column, u: Column) -> Column:
    return F.size(F.filter(cum, lambda c: c <= u))


def source_rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, size: float, alpha: float) -> DataFrame:
    """``(_source, n_docs, rate, steps, cum)``: mean number of copies of a document, and how to draw it.

    A rate is split into equal steps of at most STEP: a sum of independent Poisson variables is one
    again, so large rates don't underflow.

    ``size`` is the mix's expected number of rows as a multiple of the input's.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source_col), F.lit(NULL_SOURCE)).alias("_source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        share = F.pow(F.col("n_docs").cast("double"), F.lit(alpha))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("_source") == (NULL_SOURCE if name is None else name), F.lit(float(w))).otherwise(share)
    shared = sizes.withColumn("_share", share)
    total = shared.agg(F.sum("_share").alias("_shares"), F.sum("n_docs").alias("_rows"))
    rate = F.col("_share") / F.col("_shares") * F.col("_rows") * F.lit(size) / F.col("n_docs")
    rated = shared.crossJoin(F.broadcast(total)).select("_source", "n_docs", F.coalesce(rate, F.lit(0.0)).alias("rate"))
    stepped = rated.withColumn("steps", F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int"))
    return stepped.withColumn("cum", cumulative(F.col("rate") / F.col("steps")))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    size: float = 1.0,
    alpha: float = ALPHA,
    seed: str = SEED,
    details: bool = False,
) -> DataFrame:
    """The mix: every copy is a row with all columns of its document, in a hashed global order.

    With ``details`` the result is ``row`` (a struct), ``copy_no``, ``n_copies``, ``rate`` and ``order_key``.
    """
    rates = source_rates(docs, source_col, weights, size, alpha)
    wide = docs.select(
        F.struct("*").alias("_row"), F.col(id_col).alias("_id"),
        F.coalesce(F.col(source_col), F.lit(NULL_SOURCE)).alias("_source"),
    )
    met = join_groups(wide, rates, "_source", "n_docs", F.col("_id"))
    drawn = met.withColumn("n_copies", poisson_count(seed, F.col("_id"), F.col("steps"), F.col("cum"))).where("n_copies > 0")
    copies = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copies.withColumn("order_key", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("copy_no").cast("string")).cast("binary")))
    dealt = keyed.repartition("order_key").sortWithinPartitions("order_key")
    if details:
        return dealt.select(F.col("_row").alias("row"), "copy_no", "n_copies", "rate", "order_key")
    return dealt.select("_row.*")
