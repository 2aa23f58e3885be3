"""Mixing sources to target shares (problem 8), by entropy balancing.

Every text gets a rate w, the expected number of its copies, as close as possible (in relative entropy) to one copy each
under the constraints that each source's tokens reach its target and no rate exceeds the source's cap. The optimum is an
exponential tilt, w = min(cap, exp(lambda * size)), with one multiplier per source: the dual is convex and solved by Newton
steps, each a distributed aggregation over the histogram of sizes. The total is the largest at which every source that has texts
can reach its share. Rates are rounded into copies by systematic sampling inside salted cells, which keeps the tokens of a
source within about one text a cell of their target; then single copies are added or taken away, the longest first, until no
text at hand is short enough to bring a source nearer to its target.

Source names are compared in lower case with `-` as `_`. Equal texts count as one text (of the smallest doc_id), so that no
text is used more often than allowed. Cases: NULL or blank texts, a NULL source, and sources without a target are not drawn;
targets without texts reach 0 and the other shares grow in proportion; of repeated targets of a source the largest share and
its cap count; a cap below 1 or a share not above 0 draws nothing; more than MOST_SOURCES targets raise an error; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.tokens import TOKENIZER, measured
from weftline.session import cut

#: Texts of a cell in which rates are rounded together; texts of a source and octave of sizes that the last copies are chosen among, either way.
CELL, SPARE = 2000, 64
#: Sources with a target; their multipliers, a row each, are on the driver.
MOST_SOURCES = 100_000
#: Entries of the histogram of sizes a task.
ENTRIES = 200_000


def source_name(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), "[- ]+", "_")


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (share, cap); the table names sources and is small by nature."""
    t = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats >= 1").select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    rows = t.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("m")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources with a target")
    return {r["source"]: (float(r["m"]["target_share"]), int(r["m"]["max_repeats"])) for r in rows}


def texts_of(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of the distinct texts. Texts are counted where they are read; only their digests are shuffled."""
    d = documents.where("source IS NOT NULL").select("doc_id", "text", source_name(F.col("source")).alias("source"), F.sha2("text", 256).alias("digest"))
    t = measured(d, tokenizer, "source", "digest").where("tokens > 0")
    t = t.groupBy("doc_id").agg(F.min(F.struct("source", "digest", "tokens")).alias("r")).select("doc_id", "r.*")
    return t.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("r")).select("r.*")


def solve(histogram: DataFrame, want: dict[str, tuple[float, int]], rounds: int = 60, exact: float = 1e-9) -> tuple[dict[str, float], float]:
    """(multiplier by source, total tokens): Newton's method on the dual, kept inside a bracket.

    `histogram` has (source, tokens, n). Multipliers are per token; a source at its cap has the multiplier infinity.
    """
    spark = histogram.sparkSession
    have = {r["source"]: r["t"] for r in histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("t")).collect()}
    want = {s: x for s, x in want.items() if have.get(s)}
    if not want:
        return {}, 0.0
    whole = sum(share for share, _ in want.values())
    total = min(cap * have[s] * whole / share for s, (share, cap) in want.items())
    goal = {s: total * share / whole for s, (share, _) in want.items()}
    low = {s: -1.0 for s in want}  # e^-1 a token leaves next to nothing
    high = {s: math.log(max(cap, 1) + 1e-9) + 1.0 for s, (_, cap) in want.items()}
    at = {s: 0.0 for s in want}
    settled: dict[str, float] = {}
    for s, (_, cap) in want.items():
        if goal[s] >= cap * have[s] * (1 - exact):
            settled[s] = math.inf
    for _ in range(rounds):
        left = [s for s in want if s not in settled]
        if not left:
            break
        rows = spark.createDataFrame([(s, at[s], float(want[s][1])) for s in left], "source string, x double, cap double")
        free = F.exp(F.least(F.lit(60.0), F.col("x") * F.col("tokens")))
        h = histogram.join(F.broadcast(rows), "source").withColumn("w", F.least("cap", free))
        size = F.col("n") * F.col("tokens")
        got = h.groupBy("source").agg(F.sum(size * F.col("w")).alias("f"), F.sum(F.when(free < F.col("cap"), size * F.col("tokens") * F.col("w")).otherwise(0.0)).alias("g")).collect()
        for r in got:
            s, error = r["source"], r["f"] - goal[r["source"]]
            if abs(error) <= 1e-7 * goal[s]:
                settled[s] = at[s]
                continue
            if error > 0:
                high[s] = at[s]
            else:
                low[s] = at[s]
            step = at[s] - error / r["g"] if r["g"] > 0 else math.nan
            at[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    return {**at, **settled}, total


def draw(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, rate, copies): the texts drawn, each with its number of copies (at least 1)."""
    schema = "doc_id long, source string, tokens long, rate double, copies long"
    want = _targets(targets)
    if not want:
        return documents.sparkSession.createDataFrame([], schema)
    texts = cut(texts_of(documents, tokenizer).where(F.col("source").isin(*want)))
    histogram = texts.groupBy("source", "tokens").agg(F.count("*").alias("n"))
    histogram = cut(histogram.coalesce(max(1, histogram.count() // ENTRIES)))
    multipliers, total = solve(histogram, want)
    counts = {r["source"]: r["n"] for r in histogram.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    if not multipliers:
        return documents.sparkSession.createDataFrame([], schema)
    rows = [(s, x if math.isfinite(x) else None, float(want[s][1]), max(1, -(-counts[s] // CELL))) for s, x in multipliers.items()]
    by_source = documents.sparkSession.createDataFrame(rows, "source string, x double, cap double, cells long")
    t = texts.join(F.broadcast(by_source), "source")
    t = t.withColumn("rate", F.coalesce(F.least("cap", F.exp(F.least(F.lit(60.0), F.col("x") * F.col("tokens")))), F.col("cap")))
    t = t.withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.col("cells")))
    # Systematic sampling: copies are the whole numbers that the running sum of the rates, from a random start, passes.
    # The sum is taken in millionths, as whole numbers, so that the order of addition decides nothing.
    start = F.pmod(F.xxhash64("source", "cell"), F.lit(1_000_000))
    rate = F.round(F.col("rate") * 1_000_000).cast("long")
    upto = F.sum(rate).over(W.partitionBy("source", "cell").orderBy("tokens", "doc_id")) + start
    t = t.withColumn("upto", upto).withColumn("copies", F.floor(F.col("upto") / 1_000_000) - F.floor((F.col("upto") - rate) / 1_000_000))
    t = cut(t.select("doc_id", "source", "tokens", "rate", "copies"))
    whole = sum(want[s][0] for s in multipliers)
    moved = _moves(t, {s: total * want[s][0] / whole for s in multipliers}, {s: want[s][1] for s in multipliers})
    if moved:
        by_text = documents.sparkSession.createDataFrame(moved, "doc_id long, move long")  # at most 2 x SPARE a source and octave
        t = t.join(F.broadcast(by_text), "doc_id", "left").withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0)))
    return t.where("copies > 0").select("doc_id", "source", "tokens", "rate", "copies")


def _moves(drawn: DataFrame, goal: dict[str, float], cap: dict[str, int]) -> list[tuple[int, int]]:
    """(doc_id, 1 or -1): copies to add or to take away so that the tokens drawn from each source come near to its goal."""
    got = {r["source"]: r["t"] for r in drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    caps = drawn.sparkSession.createDataFrame([(s, cap[s], goal[s] > got.get(s, 0)) for s in goal], "source string, cap long, short boolean")
    d = drawn.join(F.broadcast(caps), "source").where("CASE WHEN short THEN copies < cap ELSE copies > 0 END")
    rank = F.row_number().over(W.partitionBy("source", F.floor(F.log2("tokens"))).orderBy(F.xxhash64("doc_id", F.lit("last copies")), "doc_id"))
    rest = {s: goal[s] - got.get(s, 0) for s in goal}
    spare: dict[str, list[tuple[int, int]]] = {}
    for r in d.withColumn("k", rank).where(F.col("k") <= SPARE).select("source", "tokens", "doc_id").collect():
        spare.setdefault(r["source"], []).append((r["tokens"], r["doc_id"]))
    out = []
    for s, texts in spare.items():
        sign, left, unused = (1 if rest[s] > 0 else -1), abs(rest[s]), []
        for tokens, doc in sorted(texts, key=lambda x: (-x[0], x[1])):
            if tokens <= left:
                out.append((doc, sign))
                left -= tokens
            else:
                unused.append((tokens, doc))
        # One text more may pass the goal and still end nearer to it.
        best = min(((abs(left - tokens), doc) for tokens, doc in unused), default=(left, 0))
        if best[0] < left:
            out.append((best[1], sign))
    return out


def shares(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per target source: target share, tokens drawn, the share reached, texts drawn and the most copies of one text."""
    d = draw(documents, targets, tokenizer).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_drawn"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"))
    t = targets.where("source IS NOT NULL").select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("m"))
    d = t.select("source", "m.target_share", "m.max_repeats").join(d, "source", "left")
    d = d.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tokens_drawn", "texts", "most_copies")})
    total = F.sum("tokens_drawn").over(W.partitionBy())
    return d.withColumn("share_reached", F.col("tokens_drawn") / F.greatest(total, F.lit(1)))


def invariants(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per target source with texts: texts at hand, and texts drawn more often than allowed, twice under two ids, or from nowhere."""
    want = _targets(targets)
    d = draw(documents, targets, tokenizer)
    at_hand = texts_of(documents, tokenizer)
    caps = documents.sparkSession.createDataFrame([(s, c) for s, (_, c) in want.items()], "source string, cap long")
    n = at_hand.join(F.broadcast(caps), "source").groupBy("source").agg(F.count("*").alias("texts"))
    bad = d.join(F.broadcast(caps), "source", "left").join(at_hand.select("doc_id", F.col("tokens").alias("size")), "doc_id", "left")
    bad = bad.groupBy("source").agg(F.count_if(F.col("copies") > F.col("cap")).alias("too_often"), F.count_if(~F.col("tokens").eqNullSafe(F.col("size"))).alias("from_nowhere"), (F.count("*") - F.count_distinct("doc_id")).alias("twice"))
    return n.join(bad, "source", "left").select("source", "texts", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("too_often", "from_nowhere", "twice")])
