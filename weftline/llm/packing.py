"""Filling containers of fixed capacities (problem 7): variable-capacity best fit.

Sizes are whole numbers up to the largest capacity, so a packing is decided on the histogram of sizes, which has at most that
many entries whatever the number of texts. Best fit decreasing places whole classes of equal items at a time: into the
open bins whose rest fits most tightly, else into new bins of the capacity that leaves the least waste for its cost. At the
end each bin shrinks to the smallest permitted capacity that holds its contents. The plan, a list of bin patterns with
multiplicities, is then dealt out to the texts by their rank among those of equal size; ranks come from salted cells, so a size
that a third of all texts share is ranked by many tasks.

A text longer than the capacity is split into pieces of the capacity and a rest; no other text is split.
Cases: NULL and blank texts have no tokens and are not packed; a repeated doc_id is packed as often as it occurs; capacities that are NULL or
below 1 are ignored; more than MOST_SPECS specs or a capacity above MOST_CAPACITY raise an error; without a capacity or a text the result is empty.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.tokens import TOKENIZER, measured
from weftline.session import cut


#: Specs and tokens of capacity at most: a packing is planned on as many sizes. More of either raises an error.
MOST_SPECS, MOST_CAPACITY = 1000, 1 << 22


@dataclass
class Pattern:
    """`bins` bins of `capacity`, each holding `k` items of size `s` for every (s, k) of `items`."""

    capacity: int
    bins: int
    items: tuple[tuple[int, int], ...]

    @property
    def used(self) -> int:
        return sum(s * k for s, k in self.items)


def plan(histogram: dict[int, int], capacities: list[int]) -> list[Pattern]:
    """Best fit decreasing over classes of equal sizes, several capacities at once."""
    capacities = sorted(set(capacities))
    if not capacities:
        return []
    rests: list[int] = []  # sorted rests of open bins
    opened: dict[int, dict[tuple[int, tuple], int]] = {}  # rest -> (capacity, items) -> bins

    def put(capacity: int, items: tuple, bins: int) -> None:
        rest = capacity - sum(s * k for s, k in items)
        if rest not in opened:
            bisect.insort(rests, rest)
            opened[rest] = {}
        key = (capacity, items)
        opened[rest][key] = opened[rest].get(key, 0) + bins

    for s in sorted(histogram, reverse=True):
        n = histogram[s]
        while n:
            at = bisect.bisect_left(rests, s)
            if at < len(rests):
                rest = rests[at]
                (capacity, items), bins = opened[rest].popitem()
                if not opened[rest]:
                    del opened[rest]
                    rests.pop(at)
                k = min(rest // s, n)
                used = min(bins, n // k)
                if bins > used:
                    put(capacity, items, bins - used)
            else:
                # Least cost: the share of the bin that items of this size leave unused; equal: the larger bin.
                capacity = min((c for c in capacities if c >= s), key=lambda c: ((c % s if n >= c // s else c - n * s) / c, -c))
                items, k = (), min(capacity // s, n)
                used = n // k
            put(capacity, (*items, (s, k)), used)
            n -= used * k
    merged: dict[tuple[int, tuple], int] = {}
    for classes in opened.values():
        for (_, items), bins in classes.items():
            size = sum(s * k for s, k in items)
            key = (capacities[bisect.bisect_left(capacities, size)], items)
            merged[key] = merged.get(key, 0) + bins
    return [Pattern(c, bins, items) for (c, items), bins in sorted(merged.items(), key=lambda x: (-x[0][0], x[0][1]))]


def _slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """size -> (first rank, items per bin, first bin, capacity) of the patterns that hold it, by rank."""
    out: dict[int, list[list[int]]] = {}
    rank: dict[int, int] = {}
    base = 0
    for p in patterns:
        for s, k in p.items:
            out.setdefault(s, []).append([rank.get(s, 0), k, base, p.capacity])
            rank[s] = rank.get(s, 0) + p.bins * k
        base += p.bins
    return {s: tuple(np.array(x, np.int64).T) for s, x in out.items()}


def _pieces(sizes: DataFrame, name: str, capacity: int) -> DataFrame:
    """One row per piece: texts beyond the capacity are split."""
    whole = F.ceil(F.col("tokens") / capacity).cast("int")
    at = F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece_no")
    return sizes.select("doc_id", at, F.col("tokens").alias("all")).select(
        F.lit(name).alias("packing"), "doc_id", "piece_no", F.least(F.lit(capacity), F.col("all") - F.col("piece_no") * capacity).cast("long").alias("tokens"))


def packings(specs: DataFrame) -> dict[str, list[int]]:
    """The packings asked for: one of each capacity by itself, and `joint`, of all capacities together."""
    rows = specs.where("capacity_tokens >= 1").select("spec_id", "capacity_tokens").distinct().orderBy("spec_id", "capacity_tokens").limit(MOST_SPECS + 1).collect()
    if len(rows) > MOST_SPECS or any(r["capacity_tokens"] > MOST_CAPACITY for r in rows):
        raise ValueError(f"more than {MOST_SPECS} specs, or a capacity above {MOST_CAPACITY}, which bounds the histogram of sizes")
    out = {f"spec {r['spec_id']}": [r["capacity_tokens"]] for r in rows}
    if rows:
        out["joint"] = sorted({r["capacity_tokens"] for r in rows})
    return out


def pack(documents: DataFrame, specs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(packing, bin_id, capacity_tokens, doc_id, piece_no, tokens): where each text, or piece of an overlong one, goes."""
    schema = "packing string, bin_id long, capacity_tokens long, doc_id long, piece_no int, tokens long"
    asked = packings(specs)
    if not asked:
        return documents.sparkSession.createDataFrame([], schema)
    sizes = measured(documents, tokenizer).where("tokens > 0")
    pieces = None
    for name, capacities in asked.items():
        p = _pieces(sizes, name, max(capacities))
        pieces = p if pieces is None else pieces.unionByName(p)
    n = sizes.count()
    salts = max(16, -(-n // 1_000_000))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)))
    cells = cut(pieces.groupBy("packing", "tokens", "salt").agg(F.count("*").alias("n")))
    histogram: dict[str, dict[int, int]] = {name: {} for name in asked}
    for r in cells.groupBy("packing", "tokens").agg(F.sum("n").alias("n")).toLocalIterator():  # at most the capacity many rows a packing
        histogram[r["packing"]][r["tokens"]] = r["n"]
    slots = {name: _slots(plan(histogram[name], capacities)) for name, capacities in asked.items()}
    before = W.partitionBy("packing", "tokens").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(W.partitionBy("packing", "tokens", "salt").orderBy("doc_id", "piece_no")) - 1
    ranked = pieces.withColumn("own", rank).join(offsets, ["packing", "tokens", "salt"]).select("packing", "doc_id", "piece_no", "tokens", (F.col("own") + F.col("offset")).alias("rank"))

    def deal(batches):
        for b in batches:
            bins, caps = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for (name, size), at in b.groupby(["packing", "tokens"]).indices.items():
                first, k, base, capacity = slots[name][size]
                r = b["rank"].to_numpy()[at]
                j = np.searchsorted(first, r, side="right") - 1
                bins[at], caps[at] = base[j] + (r - first[j]) // k[j], capacity[j]
            yield pd.DataFrame({"packing": b["packing"], "bin_id": bins, "capacity_tokens": caps, "doc_id": b["doc_id"], "piece_no": b["piece_no"], "tokens": b["tokens"]})

    return ranked.mapInPandas(deal, schema)


def unused(assignment: DataFrame) -> DataFrame:
    """Per packing and capacity: bins, tokens, unused space and its share of the space."""
    bins = assignment.groupBy("packing", "bin_id", "capacity_tokens").agg(F.sum("tokens").alias("tokens"))
    out = bins.groupBy("packing", "capacity_tokens").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), (F.sum("capacity_tokens") - F.sum("tokens")).alias("unused"))
    return out.withColumn("unused_share", F.col("unused") / (F.col("bins") * F.col("capacity_tokens")))


def invariants(documents: DataFrame, specs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per packing: documents packed, bins fuller than their capacity, bins that a smaller capacity would hold, documents split
    though they fit, and documents whose pieces do not add up to their tokens."""
    a = pack(documents, specs, tokenizer)
    spark, asked = documents.sparkSession, packings(specs)
    caps = spark.createDataFrame([(name, sorted(c)) for name, c in asked.items()], "packing string, capacities array<long>")
    sizes = measured(documents, tokenizer).where("tokens > 0").groupBy("doc_id").agg(F.sum("tokens").alias("size"))
    bins = a.groupBy("packing", "bin_id", "capacity_tokens").agg(F.sum("tokens").alias("used")).join(F.broadcast(caps), "packing")
    smaller = F.exists("capacities", lambda c: (c >= F.col("used")) & (c < F.col("capacity_tokens")))
    b = bins.groupBy("packing").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"), F.count_if(smaller).alias("oversized"))
    d = a.groupBy("packing", "doc_id").agg(F.sum("tokens").alias("packed"), F.count("*").alias("pieces")).join(sizes, "doc_id", "full").join(F.broadcast(caps), "packing", "left")
    whole = (F.col("pieces") > 1) & (F.col("packed") <= F.array_max("capacities"))
    d = d.groupBy("packing").agg(F.count("*").alias("documents"), F.count_if(whole).alias("split"), F.count_if(~F.col("packed").eqNullSafe(F.col("size"))).alias("changed"))
    return d.join(b, "packing").select("packing", "documents", "overfull", "oversized", "split", "changed")
