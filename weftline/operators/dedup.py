"""Exact duplicates, min-hash signatures, banded and verified near-duplicate clusters with their profile."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import normalise_near_dup
from weftline.operators.components import connected_components
from weftline.operators.neardup import _Words, near_links, runs_of
from weftline.operators.relational import draw_key
from weftline.session import cut, spread

PRIME = 2147483647


def duplicate_counts(df: DataFrame, *key: Column) -> DataFrame:
    """One row: rows, distinct keys, duplicate rows and the share of distinct ones."""
    d = df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(key)]).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"))
    return d.select("rows", "distinct_rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicates"), (F.col("distinct_rows") / F.greatest("rows", F.lit(1))).alias("distinct_share"))


def base_hash(text: str) -> int:
    """First eight hexadecimal digits of the MD5 of a text, modulo a Mersenne prime."""
    return int.from_bytes(hashlib.md5(text.encode(), usedforsecurity=False).digest()[:4], "big") % PRIME


def permutations(n: int) -> list[tuple[int, int]]:
    """Affine permutations from a linear congruential rule."""
    out, x = [], 12345
    for _ in range(n):
        a = x = (1103515245 * x + 12345) % PRIME
        b = x = (1103515245 * x + 12345) % PRIME
        out.append((a or 1, b))
    return out


def signature(text: str, perms: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray | None:
    """Min-hashes of the distinct k-word shingles of a normalised text; a text of fewer words is one shingle."""
    words = text.split()
    if not words:
        return None
    grams = {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
    h = np.fromiter((base_hash(g) for g in grams), np.int64, len(grams))
    low = np.full(len(perms[0]), PRIME, np.int64)
    for at in range(0, len(h), 1024):  # in slices, so that a long text needs no huge table
        np.minimum(low, ((h[at : at + 1024, None] * perms[0] + perms[1]) % PRIME).min(axis=0), out=low)
    return low


def signatures(df: DataFrame, id_col: str, text: Column, n: int = 64, k: int = 5) -> DataFrame:
    """(id, sig): min-hashes of the distinct k-word shingles of the normalised text; texts without words have none."""
    a, b = zip(*permutations(n))
    perms = np.array(a, np.int64), np.array(b, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = [(i, s) for i, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist()) if (s := signature(t, perms, k)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.int64()))], ["id", "sig"])

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), normalise_near_dup(text).alias("t"))
    return spread(rows).mapInArrow(run, "id long, sig array<long>")


def candidates(sigs: DataFrame, bands: int = 5, rows: int = 11) -> DataFrame:
    """(a, b): pairs that agree on a band. Ids with equal signatures are linked in a chain first, so that a family of equal
    texts gives links in proportion to its size; only one of each signature is paired by bands."""
    sigs = cut(sigs)
    one = sigs.groupBy("sig").agg(F.min("id").alias("id"))
    same = sigs.join(one.withColumnRenamed("id", "a"), "sig").where("id <> a").select("a", F.col("id").alias("b"))
    band = F.explode(F.array(*[F.xxhash64(F.lit(i), F.slice("sig", i * rows + 1, rows)) for i in range(bands)])).alias("band")
    keyed = one.select("id", band).distinct()
    low = keyed.groupBy("band").agg(F.min("id").alias("a"))
    # For clusters a star per band has the same components as all of its pairs.
    star = keyed.join(low, "band").where("id <> a").select("a", F.col("id").alias("b"))
    return same.unionByName(star).distinct()


def clusters(sigs: DataFrame, bands: int = 5, rows: int = 11) -> DataFrame:
    """(id, component) of all ids that share a band with another one."""
    return connected_components(candidates(sigs, bands, rows))


def _profile(texts: DataFrame, comps: DataFrame) -> DataFrame:
    c = comps.agg(F.count("*").alias("clustered"), F.countDistinct("component").alias("clusters"))
    return texts.agg(F.count("*").alias("texts")).join(F.broadcast(c)).select("texts", "clusters", "clustered", (F.col("clustered") - F.col("clusters")).alias("near_duplicates"), ((F.col("clustered") - F.col("clusters")) / F.greatest("texts", F.lit(1))).alias("share"))


def cluster_profile(sigs: DataFrame, bands: int = 5, rows: int = 11) -> DataFrame:
    """One row: texts, clusters, texts in clusters, near-duplicates (one of each cluster is kept) and their share."""
    sigs = cut(sigs)
    return _profile(sigs, clusters(sigs, bands, rows))


#: Bands of five rows, which take 125 of the reference's 128 permutations. Two texts of similarity J meet with probability
#: 1 - (1 - J^5)^25: 0.99995 at 0.8, 1 - 4e-10 at 0.9.
NEAR_BANDS = 25


def _shingled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Words()
        for b in batches:
            rows = [(i, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (w := t.split())]
            digests = [hashlib.blake2b(" ".join(w).encode(), digest_size=16).digest() for _, w in rows]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(digests, pa.binary()), pa.array([runs_of(of(w), min(k, len(w))).tobytes() for _, w in rows], pa.binary())], ["id", "digest", "runs"])

    return run


def shingled(df: DataFrame, id_col: str, text: Column, k: int = 5) -> DataFrame:
    """(id, digest, runs): the distinct k-word shingles of the normalised text, as in `signature`; texts without words have none."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), normalise_near_dup(text).alias("t"))
    return cut(spread(rows).mapInArrow(_shingled(k), "id long, digest binary, runs binary"))


def near_clusters(shingles: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, component) of all ids linked to another one by at least `threshold` similarity. Bands only propose; every link is
    verified on the shingles, within families of any size (see `neardup.near_links`). Equal texts are linked in a star first."""
    texts = cut(shingles.groupBy("digest").agg(F.min("id").alias("id"), F.first("runs").alias("runs")).select("id", "runs", "digest"))
    same = shingles.select("id", "digest").join(texts.select("digest", F.col("id").alias("a")), "digest").where("id <> a").select("a", F.col("id").alias("b"))
    return connected_components(near_links(texts.select("id", "runs"), threshold, NEAR_BANDS).unionByName(same))


def near_profile(shingles: DataFrame, threshold: float = 0.8) -> DataFrame:
    """`cluster_profile` of the verified clusters."""
    return _profile(shingles, near_clusters(shingles, threshold))


def sampled_rate(sigs: DataFrame, rows: int, partners: int, seed: int, threshold: float = 0.8) -> DataFrame:
    """One row: comparisons of sampled texts with drawn partners, and the share estimated at least `threshold` similar.

    Texts are dealt to slots by a hash; text and partner meet by slot, so each text meets `partners` others on average.
    """
    sigs = cut(sigs)
    n = sigs.count()
    slots = max(1, n // max(1, partners))
    s = sigs.withColumn("_k", draw_key(seed, "id")).orderBy("_k", "id").limit(rows).drop("_k")
    left = s.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.pmod(F.conv(F.substring(draw_key(seed + 1, "id"), 1, 8), 16, 10).cast("long"), F.lit(slots)).alias("slot"))
    right = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.pmod(F.conv(F.substring(draw_key(seed + 2, "id"), 1, 8), 16, 10).cast("long"), F.lit(slots)).alias("slot"))
    pairs = left.join(right, "slot").where("a <> b")
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x) / F.size("sa")
    return pairs.agg(F.count("*").alias("comparisons"), F.count_if(equal >= threshold).alias("near"), F.coalesce(F.avg((equal >= threshold).cast("double")), F.lit(0.0)).alias("rate"))
