"""Drawing records so that every source has its share of the tokens."""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import DEFAULT_TOKENIZER, with_tokens
from tidemark.scratch import col, materialize

#: Tokens of a block, the unit that is allotted.
BLOCK_TOKENS = 512
#: Documents a shard has at least, and how many sums of (source, shard) the driver gets, at most one a source more.
SHARD_DOCS, MAX_SUMS = 20_000, 200_000
#: More listed sources than this are refused, as the plan is made on the driver.
MAX_SOURCES = 10_000


def sainte_lague(weights: dict, seats: int, caps: dict | None = None) -> dict:
    """Allot ``seats`` by the highest quotients weight / (2 * seats so far + 1).

    ``caps`` limits what a name can get; seats no one can take are not allotted.
    Equal quotients go to the name that sorts first.  The number of steps does
    not depend on ``seats``: a divisor is found by halving which allots at most
    ``seats``, and the few that are left go by highest quotient.
    """
    names = sorted((n for n, w in weights.items() if w > 0), key=repr)
    caps = caps or {}
    cap = {n: min(seats, caps.get(n, seats)) for n in names}
    seats = min(seats, sum(cap.values()))
    got = dict.fromkeys(weights, 0)
    if not names or seats <= 0:
        return got
    w = {n: Fraction(weights[n]) for n in names}

    def at(x: Fraction) -> dict:
        # seat k is won while weight / (2k - 1) > x, strictly, so that equal quotients are left for the tie rule
        out = {}
        for n in names:
            k = (w[n] / x + 1) / 2
            out[n] = min(cap[n], int(k) - (k.denominator == 1))
        return out

    lo, hi = min(w.values()) / (2 * seats + 2), max(w.values()) + 1
    while sum(at(lo).values()) < seats:
        lo /= 2
    for _ in range(64):
        mid = (lo + hi) / 2
        mid = mid.limit_denominator(10**18) if mid > Fraction(1, 10**9) else mid
        if sum(at(mid).values()) <= seats:
            hi = mid
        else:
            lo = mid
    got |= at(hi)
    heap = [(-w[n] / (2 * got[n] + 1), i, n) for i, n in enumerate(names) if got[n] < cap[n]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got.values())):
        _, i, n = heapq.heappop(heap)
        got[n] += 1
        if got[n] < cap[n]:
            heapq.heappush(heap, (-w[n] / (2 * got[n] + 1), i, n))
    return got


def plan_quotas(
    supply: dict[tuple[str, int], int], targets: dict[str, tuple[float, int]], *, block_tokens: int = BLOCK_TOKENS, budget: int | None = None
) -> dict[tuple[str, int], int]:
    """Tokens to draw per (source, shard).

    ``supply``: tokens there are; ``targets``: share and repeats allowed per
    source.  Without a ``budget`` the total is the largest at which every listed
    source that has tokens can reach its share; the shares of sources without
    tokens go to the others in proportion.
    """
    total: dict[str, int] = {}
    for (s, _), n in supply.items():
        total[s] = total.get(s, 0) + n
    live = {s: share for s, (share, repeats) in targets.items() if share > 0 and repeats > 0 and total.get(s, 0) > 0}
    if not live:
        return {}
    whole = sum(live.values())
    if budget is None:
        budget = int(min(total[s] * targets[s][1] * whole / share for s, share in live.items()))
    caps = {s: -(-total[s] * targets[s][1] // block_tokens) for s in live}
    blocks = sainte_lague(live, budget // block_tokens, caps)
    out = {}
    for s in live:
        shards = {j: n for (t, j), n in supply.items() if t == s and n > 0}
        most = {j: -(-n * targets[s][1] // block_tokens) for j, n in shards.items()}
        for j, q in sainte_lague(shards, blocks[s], most).items():
            out[s, j] = min(q * block_tokens, shards[j] * targets[s][1])
    return out


def shards_per_source(documents: dict[str, int]) -> dict[str, int]:
    """Shards for each source, in proportion to its documents, so that no task orders many more of them than another.

    A shard has about SHARD_DOCS documents, or more where that would make more than MAX_SUMS shards.
    """
    each = max(SHARD_DOCS, -(-sum(documents.values()) // MAX_SUMS))
    return {s: max(1, round(n / each)) for s, n in documents.items()}


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    *,
    ident: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 17,
    block_tokens: int = BLOCK_TOKENS,
    budget: int | None = None,
    tokenizer: str = DEFAULT_TOKENIZER,
) -> DataFrame:
    """Draw documents so that each source has its target share of all tokens.

    Output: ``doc_id``, ``source``, ``n_tokens``, ``copies`` (how often the
    document is used, at least 1 and at most the source's ``max_repeats``).

    Tokens are counted once, over all texts.  The documents of a source are hashed
    into shards of like size;
    the tokens of every (source, shard) are summed in parallel and only these
    sums, about 200,000 at most, reach the driver, where blocks of ``block_tokens`` are allotted by
    Sainte-Lague, first to the sources, then to the shards of each.  Within a
    shard documents are put in a seeded random order and blocks are taken from
    the front, after as many whole passes as the quota holds.  A document is
    taken if its middle lies within the quota, so a shard misses its quota by
    less than half of one document.

    Sources that are not listed, null sources, and documents without tokens are
    not drawn; listed sources without documents cannot be, and their share goes
    to the others in proportion.  A source listed twice has its shares added.
    Other columns are ignored, whatever their names.
    """
    listed = targets.select(
        col("source").alias("s"), col("target_share").cast("double").alias("share"), col("max_repeats").cast("int").alias("repeats")
    ).where(F.col("s").isNotNull() & F.col("share").isNotNull() & F.col("repeats").isNotNull())
    rows = listed.groupBy("s").agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    wanted = {r["s"]: (r["share"], r["repeats"]) for r in rows}
    spark = docs.sparkSession
    of = docs.select(col(ident).alias("doc_id"), col(source).alias("source"), col(text).alias("txt"))
    shards = shards_per_source({r["source"]: r["count"] for r in of.groupBy("source").count().where(F.col("source").isin(list(wanted))).collect()})
    # one row per listed source; those without documents fall away
    cut = spark.createDataFrame(list(shards.items()), "cs string, shards int")
    mixed = F.xxhash64(F.lit(seed), F.col("doc_id"))
    of = of.join(F.broadcast(cut), F.col("source") == F.col("cs")).withColumn("shard", F.pmod(mixed, F.col("shards")).cast("int"))
    counted = with_tokens(of, "doc_id", "txt", ["source", "shard"], tokenizer=tokenizer)
    counted = materialize(counted.where(F.col("n_tokens") > 0), "tokens")
    supply = {
        (r["source"], r["shard"]): r["n"]
        for r in counted.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).collect()
    }
    quotas = plan_quotas(supply, wanted, block_tokens=block_tokens, budget=budget)
    plan = [(s, j, q // supply[s, j], q % supply[s, j]) for (s, j), q in quotas.items() if q > 0]
    table = spark.createDataFrame(plan, "qs string, qj int, passes bigint, rest bigint")
    place = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id", "n_tokens")
    ends = F.sum("n_tokens").over(place.rowsBetween(Window.unboundedPreceding, 0))
    drawn = counted.withColumn("end", ends).join(
        F.broadcast(table), (F.col("source") == F.col("qs")) & (F.col("shard") == F.col("qj"))
    )
    extra = (F.col("end") * 2 - F.col("n_tokens") < F.col("rest") * 2).cast("bigint")
    copies = (F.col("passes") + extra).cast("int")
    return drawn.select("doc_id", "source", "n_tokens", copies.alias("copies")).where(F.col("copies") > 0)


def reached_shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target and reached share of tokens, documents, tokens, most copies.

    Sources that were not drawn have 0 in all figures.
    """
    per = drawn.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    listed = targets.groupBy(col("source").alias("s")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    # one row per listed source on either side
    both = listed.join(per, F.col("s") == F.col("source"), "left")
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("documents", "tokens", "most_copies")]
    share = F.when(total > 0, F.coalesce("tokens", F.lit(0)) / total).otherwise(F.lit(0.0))
    return both.select(F.col("s").alias("source"), "target_share", share.alias("reached_share"), "max_repeats", *zero)
