"""Maximal marginal relevance.

The first candidate is fixed; each further pick maximises
``lambda * score - (1 - lambda) * max Jaccard similarity to the picks so far``;
the earlier candidate wins a tie. A query with at most k candidates is unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex import fixed_values as fv
from tessellex.functions import text as tx
from tessellex.operators.sizing import pick_rows


def _value(score: Column, similarity: Column, lam: float) -> Column:
    return F.lit(lam) * score - F.lit(1.0 - lam) * similarity


def _with_tokens(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    asked = candidates.select("query_id", "chunk_id", "score", "rank")
    found = pick_rows(chunks.select("chunk_id", "text"), asked, how="left")
    text = F.coalesce("text", F.lit(""))  # a candidate without text is like no other
    return found.select(*asked.columns, tx.token_set(text).alias("tokens"))


def mmr_bounded(
    candidates: DataFrame, chunks: DataFrame, k: int = 5, lam: float = fv.MMR_LAMBDA
) -> DataFrame:
    """MMR over lists that a top-k has already cut to a few dozen rows per query.

    One small array per query; every pick is an expression over that array, so
    nothing leaves the JVM and the only shuffle is by query.
    """
    item = F.struct(
        F.col("rank").alias("pos"), "chunk_id", "score", "tokens", F.lit(0.0).alias("sim")
    )
    lists = (
        _with_tokens(candidates, chunks)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
    )

    def pick(state: Column, _: Column) -> Column:
        def advance(chosen: Column) -> Column:
            rest = F.filter(state["rest"], lambda x: x["pos"] != chosen["pos"])
            closer = F.transform(
                rest,
                lambda x: F.struct(
                    x["pos"].alias("pos"),
                    x["chunk_id"].alias("chunk_id"),
                    x["score"].alias("score"),
                    x["tokens"].alias("tokens"),
                    F.greatest(x["sim"], tx.jaccard(x["tokens"], chosen["tokens"])).alias("sim"),
                ),
            )
            return F.struct(
                F.concat(state["picked"], F.array(chosen["pos"])).alias("picked"),
                closer.alias("rest"),
            )

        order = F.transform(
            state["rest"],
            lambda x: F.struct(
                tx.fixed(_value(x["score"], x["sim"], lam), 12).alias("v"),
                (-x["pos"]).alias("back"),
                x.alias("item"),
            ),
        )
        # transform over a one-element array binds the arg-max once.
        return F.transform(F.array(F.array_max(order)["item"]), advance)[0]

    first = F.transform(
        F.array(F.col("items")[0]),
        lambda head: F.struct(
            F.array(head["pos"]).alias("picked"),
            F.transform(
                F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))),
                lambda x: F.struct(
                    x["pos"].alias("pos"),
                    x["chunk_id"].alias("chunk_id"),
                    x["score"].alias("score"),
                    x["tokens"].alias("tokens"),
                    tx.jaccard(x["tokens"], head["tokens"]).alias("sim"),
                ),
            ).alias("rest"),
        ),
    )[0]
    rounds = F.sequence(F.lit(2), F.lit(k)) if k > 1 else F.array().cast("array<int>")
    picked = F.when(
        F.size("items") <= k, F.transform("items", lambda x: x["pos"])
    ).otherwise(F.aggregate(rounds, first, pick, lambda s: s["picked"]))
    by_pos = F.map_from_entries(
        F.transform("items", lambda x: F.struct(x["pos"], F.struct(x["chunk_id"].alias("chunk_id"), x["score"].alias("score"))))
    )
    return (
        lists.select("query_id", by_pos.alias("by_pos"), F.posexplode(picked).alias("i", "pos"))
        .select("query_id", F.element_at("by_pos", F.col("pos")).alias("c"), (F.col("i") + 1).alias("rank"))
        .select("query_id", "c.chunk_id", "c.score", "rank")
    )


def mmr_rounds(
    candidates: DataFrame, chunks: DataFrame, k: int = 5, lam: float = fv.MMR_LAMBDA
) -> DataFrame:
    """MMR over candidate lists of any length.

    Every round finds each query's best candidate with one partially aggregated
    arg-max and folds it into the running similarity of the others, so a list is
    never gathered in one task. State is cut with ``checkpoint()`` between
    rounds; ``spark.checkpoint.dir`` must name a shared folder.
    """
    from tessellex.sources.scratch import ensure_checkpoint_dir

    ensure_checkpoint_dir(candidates.sparkSession)
    state = (
        _with_tokens(candidates, chunks)
        .withColumn("sim", F.lit(0.0))
        .withColumn("picked_at", F.lit(None).cast("int"))
        .checkpoint()
    )
    for turn in range(1, k + 1):
        value = F.lit(0.0) if turn == 1 else tx.fixed(_value(F.col("score"), F.col("sim"), lam), 12)
        best = (
            state.where(F.col("picked_at").isNull())
            .groupBy("query_id")
            .agg(
                F.max_by(
                    F.struct("rank", "tokens"), F.struct(value.alias("v"), (-F.col("rank")).alias("b"))
                ).alias("best")
            )
        )
        joined = state.join(best.hint("merge"), "query_id", "left")
        is_best = F.coalesce(F.col("rank") == F.col("best.rank"), F.lit(False)) & F.col("picked_at").isNull()
        near = tx.jaccard(F.col("tokens"), F.col("best.tokens"))
        state = joined.select(
            "query_id",
            "chunk_id",
            "score",
            "rank",
            "tokens",
            F.when(F.col("best").isNull(), F.col("sim")).otherwise(F.greatest("sim", near)).alias("sim"),
            F.when(is_best, F.lit(turn)).otherwise(F.col("picked_at")).alias("picked_at"),
        ).checkpoint()
    few = candidates.groupBy("query_id").agg((F.count("*") <= k).alias("few"))
    place = F.when(F.col("few"), F.col("rank")).otherwise(F.col("picked_at"))
    return (
        state.join(few.hint("merge"), "query_id")
        .withColumn("place", place)
        .where(F.col("place").isNotNull())
        .select("query_id", "chunk_id", "score", F.col("place").alias("rank"))
    )
