"""Mixing sources to target weights: temperature mixing with budgeted block permutations.

The natural token shares q of the sources are tilted towards the targets t with an exponent a:
w is proportional to q ** (1 - a) * t ** a, which is the natural mixture at 0 and the target at 1.
For a given total size, the greatest exponent in [0, 1] is found by bisection at which no source
must be repeated more often than it may, or, if asked for, at which the entropy of the weights meets
a target. Where no size is given, it is ``stretch`` times the largest at which the targets are met
exactly: at 1 the exponent is 1, beyond it sources run out and the exponent is bisected.

Each source's weight is a budget of tokens. It is realised in passes over the source: whole passes
use every document once, the last one takes blocks of documents in a pseudo-random order up to the
budget, the block it ends in is cut into blocks again. Sources without documents get weight 0, the others share the rest in proportion.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.llm.merge_replay import count_tokens
from quillgrid.session import cut

#: Blocks a source and pass: hash ranges of its documents. A source of any size has this many.
BLOCKS = 1024


def entropy(weights: list[float]) -> float:
    return -sum((w * math.log(w) for w in weights if w > 0), 0.0)


def tilted(natural: list[float], target: list[float], exponent: float) -> list[float]:
    """Normalised q ** (1 - a) * t ** a; 0 where either is 0."""
    logs = [(1 - exponent) * math.log(q) + exponent * math.log(t) if q > 0 and t > 0 else -math.inf for q, t in zip(natural, target, strict=True)]
    top = max(logs, default=-math.inf)
    if top == -math.inf:
        return [0.0] * len(logs)
    raw = [math.exp(x - top) for x in logs]
    return [x / sum(raw) for x in raw]


def weigh(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None, target_entropy: float | None = None, stretch: float = 1.0) -> dict[str, dict]:
    """Weight, budget and exponent of each source of ``targets`` (share, max_repeats).

    A share or repetition limit that is null, not positive or not a number counts as 0, so that
    source is left out.
    """
    names = sorted(targets)
    share = [max(0.0, s) if (s := float(targets[n][0] or 0)) == s and math.isfinite(s) else 0.0 for n in names]
    repeats = [max(0, int(targets[n][1] or 0)) for n in names]
    have = [tokens.get(n, 0) if r > 0 and s > 0 else 0 for n, r, s in zip(names, repeats, share, strict=True)]
    all_tokens = sum(have)
    if not all_tokens:
        return {n: {"weight": 0.0, "budget": 0, "exponent": 1.0} for n in names}
    natural = [h / all_tokens for h in have]
    goal = tilted(natural, share, 1.0)
    most = [h * r for h, r in zip(have, repeats, strict=True)]
    if total is None:
        total = int(stretch * min(int(m / g) for m, g in zip(most, goal, strict=True) if g > 0))

    def fits(a: float) -> bool:
        return all(w * total <= m + 1e-6 * max(1, m) for w, m in zip(tilted(natural, share, a), most, strict=True))

    low, high = 0.0, 1.0
    if target_entropy is not None:
        rising = entropy(tilted(natural, share, 1.0)) >= entropy(tilted(natural, share, 0.0))
        for _ in range(60):
            a = (low + high) / 2
            if (entropy(tilted(natural, share, a)) < target_entropy) == rising:
                low = a
            else:
                high = a
        high = (low + high) / 2
        low = 0.0
    exponent = high
    if not fits(high):
        for _ in range(60):
            a = (low + high) / 2
            low, high = (a, high) if fits(a) else (low, a)
        exponent = low
    weights = tilted(natural, share, exponent)
    # where even the natural mixture is too large, the size gives way
    total = min([total, *(int(m / w) for m, w in zip(most, weights, strict=True) if w > 0)]) if not fits(exponent) else total
    return {n: {"weight": w, "budget": min(m, round(w * total)), "exponent": exponent} for n, w, m in zip(names, weights, most, strict=True)}


def _sized(documents: DataFrame, targets: DataFrame, folder: str | None) -> tuple[DataFrame, DataFrame, dict]:
    """Documents with tokens and block, tokens by source and block, and the plan.

    The targets are a handful of rows (one a source), the sums by source as many: both are bounded
    and go to the driver. The counted documents are cut off, as they are read several times.
    """
    goals = {r.source: (r.share, r.repeats) for r in targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect()}
    wanted = documents.where(F.col("source").isin(list(goals))).select("doc_id", "source", "text")
    counted = cut(count_tokens(wanted, ("doc_id", "source"), folder=folder).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "doc_id"), F.lit(BLOCKS)).cast("int")))
    by_block = counted.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    return counted, by_block, goals


def _permuted(block: int, turn: int, source: str) -> int:
    """Place of a block in a pass: another pseudo-random order for every source and pass."""
    x = (block * 0x9E3779B97F4A7C15 + turn * 0xC2B2AE3D27D4EB4F + sum(ord(c) << (8 * (k % 7)) for k, c in enumerate(source))) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return (x ^ (x >> 31)) >> 1


def _taken(blocks: list, budget: int, turn: int, source: str) -> tuple[list[int], int | None, int]:
    """Blocks (number, tokens) taken whole in a pass up to a budget, the one it ends in, and what is left for that."""
    whole, left = [], budget
    for number, tokens in sorted(blocks, key=lambda b: (_permuted(b[0], turn, source), b[0])):
        if tokens > left:
            return whole, number, left
        whole.append(number)
        left -= tokens
    return whole, None, left


def _mixed(documents: DataFrame, targets: DataFrame, total: int | None, target_entropy: float | None, stretch: float, folder: str | None) -> tuple[DataFrame, dict, dict]:
    """The mixture, tokens by source and the weights."""
    spark = documents.sparkSession
    counted, by_block, goals = _sized(documents, targets, folder)
    blocks: dict[str, list] = {}
    for r in by_block.collect():  # at most BLOCKS rows for each of the targets' sources
        blocks.setdefault(r.source, []).append((r.block, r.tokens or 0))
    tokens = {source: sum(n for _, n in own) for source, own in blocks.items()}
    weights = weigh(tokens, goals, total, target_entropy, stretch)
    takes, ends = [], []  # (source, block, passes that take it whole) and the block that a budget ends in
    for source, own in blocks.items():
        if not tokens[source] or not weights[source]["budget"]:
            continue
        passes, rest = divmod(weights[source]["budget"], tokens[source])
        whole, end, left = _taken(own, rest, passes + 1, source) if rest else ([], None, 0)
        whole = set(whole)
        takes += [(source, block, int(passes + (block in whole))) for block, _ in own if passes or block in whole]
        if end is not None:
            ends.append((source, end, int(passes + 1), int(left)))
    # at most BLOCKS rows a source: bounded by the targets, whatever the corpus holds
    chosen = spark.createDataFrame(takes, "source string, block int, passes int")
    full = counted.join(F.broadcast(chosen), ["source", "block"]).withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    columns = ["source", "block", "doc_id", "n_tokens", "repeat_no"]
    # the block a budget ends in is cut again by another hash, as it still holds a share 1 / BLOCKS of its source
    ended = counted.join(F.broadcast(spark.createDataFrame(ends, "source string, block int, repeat_no int, room long")), ["source", "block"]).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(BLOCKS)).cast("int"))
    parts: dict[str, list] = {}
    for r in ended.groupBy("source", "part").agg(F.sum("n_tokens").alias("tokens")).collect() if ends else []:  # at most BLOCKS rows a source
        parts.setdefault(r.source, []).append((r.part, r.tokens or 0))
    whole_parts, last_parts = [], []
    for source, _, turn, room in ends:
        whole, end, left = _taken(parts.get(source, []), room, turn, source)
        whole_parts += [(source, number) for number in whole]
        if end is not None:
            last_parts.append((source, end, int(left)))
    inner = ended.join(F.broadcast(spark.createDataFrame(whole_parts, "source string, part int")), ["source", "part"])
    # what is put in order is a share of 1 / BLOCKS ** 2 of a source
    order = W.partitionBy("source").orderBy(F.xxhash64(F.lit("last"), "doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    last = ended.join(F.broadcast(spark.createDataFrame(last_parts, "source string, part int, left long")), ["source", "part"]).withColumn("so_far", F.sum("n_tokens").over(order)).where(F.col("so_far") <= F.col("left"))
    both = full.select(*columns).unionByName(inner.select(*columns)).unionByName(last.select(*columns))
    key = F.xxhash64(F.lit("mix"), "source", "repeat_no", "block")
    return both.select("doc_id", "source", "repeat_no", F.col("block").alias("block_no"), "n_tokens", key.alias("mix_key")), tokens, weights


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, target_entropy: float | None = None, stretch: float = 1.0, folder: str | None = None) -> DataFrame:
    """The mixture: doc_id, source, repeat_no (from 1), block_no, n_tokens, mix_key.

    Ordered by mix_key, the rows are the mixture with the blocks of all sources shuffled evenly.
    A document appears at most max_repeats times (repeat_no tells its copies apart). Documents with
    a null source, or one without a target, are no part of it; those without tokens come along with
    their block. Rows of one revision delivered twice are two documents, as their doc_id differs.
    A budget is met up to less than one document. Empty tables give an empty result.
    """
    return _mixed(documents, targets, total, target_entropy, stretch, folder)[0]


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, target_entropy: float | None = None, stretch: float = 1.0, folder: str | None = None) -> DataFrame:
    """What was reached, a row for each source of the targets.

    Columns source, target_share, max_repeats, available_tokens, weight, exponent and entropy (of the
    weights, the same in each row), mixed_tokens, documents (rows of the mixture), most_repeats and
    share (of the mixture's tokens; null for an empty mixture).
    """
    mixed, tokens, weights = _mixed(documents, targets, total, target_entropy, stretch, folder)
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("documents"), F.max("repeat_no").alias("most_repeats"))
    goals = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    spread = round(float(entropy([w["weight"] for w in weights.values()])), 6)
    plan = documents.sparkSession.createDataFrame([(s, int(tokens.get(s, 0)), round(w["weight"], 6), round(w["exponent"], 6), spread) for s, w in weights.items()], "source string, available_tokens long, weight double, exponent double, entropy double")
    whole = F.sum("mixed_tokens").over(W.partitionBy(F.lit(1)))  # over one row a source
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return goals.join(plan, "source").join(used, "source", "left").select("source", "target_share", "max_repeats", "available_tokens", "weight", "exponent", "entropy", zero("mixed_tokens"), zero("documents"), zero("most_repeats"), F.round(F.try_divide(F.coalesce("mixed_tokens", F.lit(0)).cast("double"), whole), 6).alias("share"))
