"""Scores arriving counts against static priors.

The mean reference is frozen with the priors: a running mean over an unbounded stream has no defined value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import expr as X
from tallyspark.operators.model import FitConfig, effective, log_likelihood


def score_stream(counts: DataFrame, priors: DataFrame, mean_reference: float, config: FitConfig) -> DataFrame:
    """counts (gene_id, k, n_ref and others; streaming or not) with signal and posterior_entropy, by a stateless
    stream-static join. priors hold one scope; they are as many rows as genes, so they are broadcast."""
    n = effective("scale", F.lit(mean_reference))
    met = counts.join(F.broadcast(priors.select("gene_id", "scale", "support", "prob")), "gene_id")
    post = X.posterior(log_likelihood(config, F.col("k").cast("double"), n, F.col("support")), F.col("prob"))
    summary = X.let(post, lambda p: F.struct(X.argmax(p).alias("i"), X.entropy(p).alias("h")))
    met = met.withColumn("__s", summary)
    at = F.get("support", F.col("__s.i"))
    signal = at if config.likelihood == "poisson" else at * F.col("scale")
    return met.select(*counts.columns, signal.alias("signal"), F.col("__s.h").alias("posterior_entropy"))
