"""Filling fixed-capacity containers: swap-based local search.

Items are spread by hash over shards of bounded size, each of which is packed
on its own (a shard leaves about one container partly empty, so shards of ten
thousand items cost next to nothing). A shard starts from best fit, largest
first. Then the emptiest container gives its documents away: a document moves
into another container's gap, or one or two of its documents change places
with a smaller one there. Every step raises the sum of squared fills, until
containers run empty or no step is left.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one shard on average.
SHARD_ITEMS = 10_000
#: Profiles (a table of settings, read by the driver) that one scan of the items serves.
PROFILES_AT_ONCE = 1_000


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Container of each item, and the fills: largest first, tightest gap."""
    where = np.zeros(len(sizes), dtype=np.int64)
    fills: list[int] = []
    open_at: dict[int, list[int]] = {}
    gaps = 0  # bit g is set if a container has a gap of g
    for k in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[k])
        fitting = gaps >> n
        if fitting:
            gap = n + (fitting & -fitting).bit_length() - 1
            bin_ = open_at[gap].pop()
            if not open_at[gap]:
                gaps &= ~(1 << gap)
        else:
            bin_, gap = len(fills), capacity
            fills.append(0)
        where[k] = bin_
        fills[bin_] += n
        if left := gap - n:
            open_at.setdefault(left, []).append(bin_)
            gaps |= 1 << left
    return where, fills


def improve(sizes: np.ndarray, where: np.ndarray, fills: list[int], capacity: int, passes: int | None = None) -> tuple[np.ndarray, bool]:
    """Local search from a packing; gives the container of each item.

    It ends at a packing that no move or exchange improves, when the number of
    containers has reached its lower bound, or after ``passes`` over all
    containers.
    """
    fill = np.array(fills, dtype=np.int64)
    bound = -(-int(sizes.sum()) // capacity)
    in_play = np.flatnonzero((fill[where] < capacity) & (sizes > 0))
    size = sizes[in_play]
    at = where[in_play].copy()
    settled = False
    for _ in range(passes) if passes is not None else count():
        changed = False
        for victim in np.argsort(fill, kind="stable").tolist():
            if np.count_nonzero(fill) <= bound:
                break
            while 0 < fill[victim] < capacity:
                mine = np.flatnonzero(at == victim)
                open_ = (at != victim) & (fill[at] < capacity) & (fill[at] >= fill[victim])
                others = np.flatnonzero(open_)
                if not len(others) or not len(mine):
                    break
                step = _step(size, at, fill, mine, others, capacity)
                if step is None:
                    break
                gives, takes, target = step
                gain = int(size[gives].sum() - (size[takes].sum() if len(takes) else 0))
                at[gives] = target
                at[takes] = victim
                fill[target] += gain
                fill[victim] -= gain
                changed = True
        if not changed:
            settled = True
            break
    where = where.copy()
    where[in_play] = at
    return where, settled or np.count_nonzero(fill) <= bound


def _step(size: np.ndarray, at: np.ndarray, fill: np.ndarray, mine: np.ndarray, others: np.ndarray, capacity: int):
    """The best step for the container of ``mine``: what it gives, takes, and where."""
    own = size[mine]
    gap = capacity - fill[at[others]]
    # move: the largest document that fits somewhere, into its tightest gap
    best, most = None, 0
    fits = own <= gap.max()
    if fits.any():
        k = int(np.argmax(np.where(fits, own, -1)))
        room = np.where(gap >= own[k], gap, np.iinfo(np.int64).max)
        best, most = (mine[[k]], np.empty(0, dtype=int), int(at[others[int(np.argmin(room))]])), int(own[k])
    # one or two of mine for one of theirs: the largest rise of the other's fill. Only sizes matter, and
    # a container has at most the root of twice its capacity of different ones, so all pairs are few
    kinds, first, count = np.unique(own, return_index=True, return_counts=True)
    i, j = np.triu_indices(len(kinds))
    twice = (i < j) | (count[i] > 1)
    i, j = i[twice], j[twice]
    sums = np.r_[kinds, kinds[i] + kinds[j]]
    order = np.argsort(sums, kind="stable")
    sums, left, right = sums[order], np.r_[np.arange(len(kinds)), i][order], np.r_[np.full(len(kinds), -1), j][order]
    theirs = size[others]
    k = np.searchsorted(sums, theirs + gap, "right") - 1
    rise = np.where(k >= 0, sums[np.maximum(k, 0)] - theirs, 0)
    top = int(np.argmax(rise))
    if rise[top] > most:
        p = int(k[top])
        one, two = int(left[p]), int(right[p])
        if two < 0:
            gives = mine[[first[one]]]
        elif one == two:
            gives = mine[np.flatnonzero(own == kinds[one])[:2]]
        else:
            gives = mine[[first[one], first[two]]]
        best = (gives, others[[top]], int(at[others[top]]))
    return best


def pack(sizes: np.ndarray, capacity: int, passes: int | None = None) -> tuple[np.ndarray, bool]:
    """Container (0, 1, ...) of each item, all of at most ``capacity``; whether no step was left."""
    where, fills = best_fit(sizes, capacity)
    where, settled = improve(sizes, where, fills, capacity, passes)
    return np.unique(where, return_inverse=True)[1], settled


def items(sized: DataFrame, profiles: DataFrame, key: str = "doc_id") -> DataFrame:
    """(profile_id, capacity, key, piece, n_tokens, of_tokens): what is to be packed.

    A document of more tokens than the capacity is cut into full pieces and a
    rest; all others are one item, piece 0.
    """
    rows = sorted(tuple(r) for r in profiles.select("profile_id", "capacity").where("capacity > 0 AND profile_id IS NOT NULL").distinct().collect())
    if not rows:
        return sized.select(F.lit(0).alias("profile_id"), F.lit(0).alias("capacity"), key, F.lit(0).alias("piece"), "n_tokens", F.col("n_tokens").alias("of_tokens")).limit(0)
    out = None
    for k in range(0, len(rows), PROFILES_AT_ONCE):
        each = F.explode(F.array(*[F.struct(F.lit(int(p)).alias("profile_id"), F.lit(int(c)).alias("capacity")) for p, c in rows[k : k + PROFILES_AT_ONCE]]))
        part = sized.select(key, "n_tokens", each.alias("p")).select(key, "n_tokens", "p.*")
        out = part if out is None else out.unionByName(part)
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int") - 1)
    out = out.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    rest = F.least(F.col("capacity"), F.col("n_tokens") - F.col("piece") * F.col("capacity")).cast("int")
    return out.select("profile_id", "capacity", key, "piece", rest.alias("n_tokens"), F.col("n_tokens").alias("of_tokens"))


def containers(sized: DataFrame, profiles: DataFrame, key: str = "doc_id", shard_items: int = SHARD_ITEMS, passes: int | None = None) -> DataFrame:
    """Every item with its container: profile_id, container_id, key, piece, n_tokens, settled.

    sized: key and n_tokens, which the caller keeps (it is read twice).
    Containers have names: profile, then shard and number, or the document
    and piece that fill one alone. Items without tokens lie in their shard's
    first container. Null n_tokens counts as 0. Repeated rows count once; a
    key with several sizes is an item for each. Null keys are items like
    others. Empty tables and non-positive capacities give no rows. One shard is one task of about ``shard_items``
    items, of whatever documents: no key makes it large. ``settled`` says that
    the search of the item's shard ended at a packing no step improves or at
    the lower bound of containers, not by ``passes`` (by default none are set).
    """
    sized = sized.select(key, F.coalesce(F.col("n_tokens"), F.lit(0)).cast("int").alias("n_tokens")).distinct()
    todo = items(sized, profiles, key)
    full = F.col("n_tokens") == F.col("capacity")
    counts = {r[0]: r[1] for r in todo.where(~full).groupBy("profile_id").count().collect()}
    shards = F.lit(1)
    for profile, n in sorted(counts.items()):
        shards = F.when(F.col("profile_id") == profile, max(1, round(n / shard_items))).otherwise(shards)
    kind = dict(sized.dtypes)[key]
    # a full piece is a container
    name = F.concat_ws("-", F.col("profile_id").cast("string"), F.lit("full"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("piece").cast("string"), F.col("of_tokens").cast("string"))
    exact = todo.where(full).withColumn("container_id", name).withColumn("settled", F.lit(True))
    shard = F.pmod(F.xxhash64(key, "piece", "of_tokens"), shards).cast("int")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values([key, "piece", "n_tokens"], kind="stable")
        sizes = batch["n_tokens"].to_numpy(dtype=np.int64)
        where = np.zeros(len(sizes), dtype=np.int64)
        some = np.flatnonzero(sizes > 0)
        where[some], batch["settled"] = pack(sizes[some], int(batch["capacity"].iloc[0]), passes)
        batch["container_id"] = [f"{batch['profile_id'].iloc[0]}-{batch['shard'].iloc[0]}-{k}" for k in where]
        return batch[["profile_id", "container_id", key, "piece", "n_tokens", "settled"]]

    schema = f"profile_id int, container_id string, `{key}` {kind}, piece int, n_tokens int, settled boolean"
    packed = todo.where(~full).withColumn("shard", shard).groupBy("profile_id", "shard").applyInPandas(run, schema)
    return packed.unionByName(exact.select("profile_id", "container_id", key, "piece", "n_tokens", "settled"))


def fills(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """n_items, n_containers, n_tokens, fill (share of the space used) and whether all searches settled, by profile."""
    each = packed.groupBy("profile_id", "container_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"), F.min("settled").alias("settled"))
    total = each.groupBy("profile_id").agg(F.sum("items").alias("n_items"), F.count("*").alias("n_containers"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("fullest"), F.min("settled").alias("settled"))
    size = profiles.groupBy("profile_id").agg(F.max("capacity").alias("capacity"))
    return total.join(size, "profile_id").select("profile_id", "capacity", "n_items", "n_containers", "n_tokens", "fullest", "settled", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill"))
