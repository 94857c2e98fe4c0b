"""Mixing sources to target weights (problem 9) by balanced sampling with the cube method.

Every document of a source has the same expected number of copies; its whole part is given
to all, its fraction is an inclusion probability.  The flight phase moves the probabilities
of three documents at a time along the null space of the two balancing constraints (number
of documents, number of tokens), so both totals are kept until at most two probabilities of
a group are left between 0 and 1.  Groups are buckets of bounded size, left-overs of all
buckets fly again on the next level, and only the last level, one small group per source,
lands.  No group grows with the data; levels grow with its logarithm.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.encode import encode
from tidemark.tables import shared_dir, small

#: Expected documents in a group that flies in one task.
GROUP = 4096
EPS = 1e-9


def source_name(source: Column) -> Column:
    """One spelling of a source: trimmed, lower case, spaces and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


def fly(pi: np.ndarray, tokens: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """The flight of one group; ``land`` then settles what is left, keeping the count if it can."""
    pi = pi.astype(float).copy()
    live: list[int] = []
    draws = rng.random(2 * len(pi) + 8)
    used = 0

    def move(units: list[int], u: list[float]) -> None:
        nonlocal used
        up = min((1 - pi[k]) / v if v > 0 else pi[k] / -v for k, v in zip(units, u, strict=True) if v)
        down = min(pi[k] / v if v > 0 else (1 - pi[k]) / -v for k, v in zip(units, u, strict=True) if v)
        step = up if draws[used % len(draws)] * (up + down) < down else -down
        used += 1
        for k, v in zip(units, u, strict=True):
            pi[k] = min(1.0, max(0.0, pi[k] + step * v))
            if pi[k] < EPS or pi[k] > 1 - EPS:
                pi[k] = round(pi[k])

    for k in range(len(pi)):
        if 0 < pi[k] < 1:
            live.append(k)
        while len(live) >= 3:
            a, b, c = live[-3:]
            u = [tokens[b] - tokens[c], tokens[c] - tokens[a], tokens[a] - tokens[b]]
            move([a, b, c], u if any(u) else [1.0, -1.0, 0.0])
            live = [x for x in live if 0 < pi[x] < 1]
    if land:
        while len(live) >= 2:  # the token constraint is dropped first
            move(live[:2], [1.0, -1.0])
            live = [x for x in live if 0 < pi[x] < 1]
        for k in live:
            pi[k] = float(draws[used % len(draws)] < pi[k])
    return pi


def _group(seed: int, land: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["spread", "doc_id"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, abs(int(rows["spread"].iloc[0])), len(rows)])
        rows["pi"] = fly(rows["pi"].to_numpy(), rows["n_tokens"].to_numpy(float), rng, land)
        return rows[["doc_id", "source", "n_tokens", "base", "pi", "spread"]]

    return run


def plan_weights(sizes: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, float]:
    """Expected copies of each document by source.

    ``sizes`` has (documents, tokens) of each source.  Shares are taken over the sources
    that have tokens and a positive share.  The default total is the largest at which no
    source needs more than max_repeats copies; under a larger one such sources stay at
    their cap and fall short of their share.
    """
    wanted = {s: (share, cap) for s, share, cap in targets if s in sizes and sizes[s][1] > 0 and (share or 0) > 0 and (cap or 0) > 0}
    whole = math.fsum(share for share, _ in wanted.values())
    if not wanted:
        return {}
    if total is None:
        total = min(cap * sizes[s][1] / (share / whole) for s, (share, cap) in wanted.items())
    return {s: min(float(cap), share / whole * total / sizes[s][1]) for s, (share, cap) in wanted.items()}


def sized_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens), source in one spelling; counted once and kept in the shared folder."""
    shared_dir(documents.sparkSession)
    named = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text")
    return encode(named, vocabulary, counts=True, keep=("source",)).checkpoint()


def mix(documents: DataFrame, mix_targets: DataFrame, total: float | None = None, seed: int = 9, vocabulary: str | None = None, group: int = GROUP) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the documents of the mix, copies at least 1.

    Documents without tokens, without source or of a source that is not wanted are not in
    the mix; a wanted source without documents is left out of the shares; a target named
    twice counts by its last spelling in order of share.  doc_id is taken as unique.
    The result is a function of the rows and the seed, whatever the partitioning.
    """
    docs = sized_documents(documents, vocabulary)
    return _mix(docs, mix_targets, total, seed, group)


def _mix(docs: DataFrame, mix_targets: DataFrame, total: float | None, seed: int, group: int) -> DataFrame:
    targets = mix_targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").orderBy("target_share").collect()
    wanted = list({r.source: (r.source, r.target_share, r.max_repeats) for r in targets if r.source}.values())
    counted = docs.where("n_tokens > 0").join(small(mix_targets.select(source_name(F.col("source")).alias("source")).distinct()), "source")
    sizes = {r.source: (r.n, r.t) for r in counted.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}  # a row for each wanted source
    weights = plan_weights(sizes, wanted, total)
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, int(w + EPS), max(0.0, w - int(w + EPS)), math.ceil(sizes[s][0] / group)) for s, w in weights.items()], "source string, base int, pi double, buckets int")
    rows = docs.where("n_tokens > 0").join(small(plan), "source").withColumn("spread", F.xxhash64("doc_id", F.lit(seed)))
    columns = "doc_id bigint, source string, n_tokens bigint, base int, pi double, spread bigint"
    most = max((sizes[s][0] for s in weights), default=0)
    settled = None
    while True:
        buckets = math.ceil(most / group)
        land = buckets <= 1
        # of the buckets of the largest source, smaller sources use as many as they fill
        used = F.greatest(F.lit(1), F.least(F.col("buckets"), F.lit(buckets)))
        bucket = F.when(F.lit(land), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(seed + 1), F.lit(buckets)), used))
        flown = rows.withColumn("bucket", bucket).groupBy("source", "bucket").applyInPandas(_group(seed, land), columns)
        if land:
            last = flown
            break
        flown = flown.checkpoint()
        done = flown.where("pi = 0 OR pi = 1")
        settled = done if settled is None else settled.unionByName(done)
        rows = flown.where("pi > 0 AND pi < 1").withColumn("buckets", F.lit(1))
        most = 2 * buckets
        if most > group:
            rows = rows.withColumn("buckets", F.lit(math.ceil(most / group)))
    rows = last if settled is None else settled.unionByName(last)
    copies = (F.col("base") + F.round("pi").cast("int")).alias("copies")
    return rows.select("doc_id", "source", "n_tokens", copies).where("copies > 0")


def shares(mixed: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, tokens, actual_share) of every target, reached or not."""
    got = mixed.groupBy("source").agg(F.sum("copies").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    named = mix_targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    each = named.join(got, "source", "left").select("source", "target_share", "max_repeats", zero("documents"), zero("tokens"))
    return each.withColumn("actual_share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))  # a row for each target
