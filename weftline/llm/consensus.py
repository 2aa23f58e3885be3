"""Consensus from several annotators' labels (problem 6), by spectral reliability.

For annotators i, j and the questions both answered, the chance-centred agreement (agree - c) / (1 - c), c being the chance
that two answers of the question's kind agree, has expectation r_i * r_j, r being an annotator's competence (1 always
right, 0 guessing). r is the leading eigenvector of that matrix corrected for overlap counts: the fixed point of
r_i = sum_j C_ij r_j / sum_j o_ij r_j^2, C holding the summed agreements and o the overlaps. Neither matrix is built: both
sums are taken per question from the sums over its answers, so an iteration is linear in the votes. The iteration ends when
no competence changes by more than TOLERANCE.

The competences, a number each, go to all tasks while there are at most SMALL annotators; beyond, they are joined to the votes
and the sums taken by windows, or by partial aggregation where a question has more than LARGE votes. Both ways give the same.

Answers are then weighed by the log odds that r implies. Cases: the row with the latest `ingested_at` replaces the earlier
ones of its question (NULL is earliest; ties: more answers, then the greater content); an annotator counts once per question
(smallest answer id, NULL first, then the smaller answer); blank, NULL and mark-only answers, and those of unknown annotators,
are no votes; a question without any vote gets a NULL answer and agreement; equal weights are decided by votes, then by the
smaller answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.session import cut

# Number words and articles of the plain form, and answers that affirm or deny.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
ARTICLES = ("a", "an", "the")
YES_NO = ("yes", "no", "是", "不是", "有", "没有", "对", "不对", "sí", "si", "oui", "non", "ja", "nein", "true", "false")
KINDS = ("number", "other", "yes/no")
#: Annotators up to which their competences are sent to all tasks.
SMALL = 100_000
#: Votes of a question beyond which, with more annotators, its sums are taken by partial aggregation.
LARGE = 4096
#: First competence, weight of it in overlaps of a sure annotator, largest change at the end, rounds at most.
START, PRIOR, TOLERANCE, ROUNDS = 0.7, 4.0, 1e-4, 60


def plain_answer(answer: Column) -> Column:
    """Plain form: lower case, no punctuation, no articles, number words as digits, single blanks, trimmed; '' if nothing is left."""
    t = F.regexp_replace(F.lower(F.coalesce(answer, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    words = F.filter(F.split(F.trim(t), " "), lambda w: ~w.isin(*ARTICLES) & (w != ""))
    digits = F.create_map(*[x for i, w in enumerate(NUMBER_WORDS) for x in (F.lit(w), F.lit(str(i)))])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(digits, w), w)), " ")


def latest(annotations: DataFrame) -> DataFrame:
    """One row per question id: `question_id, answers`."""
    last = F.max(F.struct(F.coalesce("ingested_at", F.lit("0001-01-01").cast("timestamp")), F.coalesce(F.size("answers"), F.lit(-1)).alias("n"), "answers"))
    return annotations.where("question_id IS NOT NULL").groupBy("question_id").agg(last.alias("r")).select("question_id", "r.answers")


def kind_of(answer: str) -> int:
    return 2 if answer in YES_NO else 0 if re.fullmatch(r"[0-9]+", answer) else 1


VOTES = "question_id long, annotators array<long>, codes array<int>, answers array<string>, kind int"
VOTES_ARROW = pa.schema([("question_id", pa.int64()), ("annotators", pa.list_(pa.int64())), ("codes", pa.list_(pa.int32())), ("answers", pa.list_(pa.string())), ("kind", pa.int32())])


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes)]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per question: its votes as (annotator, number of the answer), its answers in order, the kind of most votes."""
    for b in batches:
        rows = b.num_rows
        v = b.column("v")
        flat = v.flatten()
        q = np.repeat(np.arange(rows), np.diff(v.offsets.to_numpy()))
        words = flat.field(2).dictionary_encode()
        values = words.dictionary.to_pylist()
        order = sorted(range(len(values)), key=values.__getitem__)
        rank = np.empty(len(values), np.int64)
        rank[order] = np.arange(len(values))
        values = [values[i] for i in order]
        code = rank[words.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        who, given = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).fill_null(-(2**31)).to_numpy(zero_copy_only=False)
        at = np.lexsort((code, given, who, q))
        q, who, code = q[at], who[at], code[at]
        first = np.r_[True, (q[1:] != q[:-1]) | (who[1:] != who[:-1])] if len(q) else np.zeros(0, bool)
        q, who, code = q[first], who[first], code[first]
        pairs, own = np.unique(q * max(1, len(values)) + code, return_inverse=True)
        owner = pairs // max(1, len(values))
        answers = _starts(np.bincount(owner, minlength=rows))
        kinds = np.array([kind_of(x) for x in values], np.int64)
        n = np.bincount(q * 3 + kinds[code], minlength=rows * 3).reshape(rows, 3)
        offsets = pa.array(_starts(np.bincount(q, minlength=rows)), pa.int32())
        names = pa.array(values, pa.string()).take(pa.array(pairs % max(1, len(values))))
        yield pa.RecordBatch.from_arrays(
            [b.column("question_id"), pa.ListArray.from_arrays(offsets, pa.array(who, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(own - answers[q], pa.int32())),
             pa.ListArray.from_arrays(pa.array(answers, pa.int32()), names), pa.array(2 - n[:, ::-1].argmax(axis=1), pa.int32())], schema=VOTES_ARROW)


def votes(current: DataFrame) -> DataFrame:
    """The votes, a row per question (see VOTES)."""
    v = F.transform(F.coalesce("answers", F.array()), lambda a: F.struct(a["annotator_id"].alias("w"), a["answer_id"].alias("i"), plain_answer(a["answer"]).alias("t")))
    v = F.filter(v, lambda a: a["w"].isNotNull() & (a["t"] != ""))
    return cut(current.select(F.col("question_id").cast("long").alias("question_id"), v.alias("v")).mapInArrow(_encode, VOTES))


def chances(v: DataFrame) -> dict[int, float]:
    """kind -> the probability that two votes on questions of the kind agree by chance (three rows)."""
    said = v.select("kind", F.explode(F.transform("codes", lambda c: F.element_at("answers", c + 1))).alias("answer"))
    n = said.groupBy("kind", "answer").count()
    rows = n.groupBy("kind").agg((F.sum(F.col("count").cast("double") * F.col("count")) / F.pow(F.sum("count").cast("double"), F.lit(2.0))).alias("c")).collect()
    return {r["kind"]: min(0.9, r["c"]) for r in rows}


class _Batch:
    """The votes of a batch as flat arrays: question, annotator's place among `ids`, answer's place among all answers of the batch."""

    def __init__(self, b: pa.RecordBatch, ids: np.ndarray) -> None:
        who, codes, answers = b.column("annotators"), b.column("codes"), b.column("answers")
        self.rows = b.num_rows
        self.q = np.repeat(np.arange(b.num_rows), np.diff(who.offsets.to_numpy()))
        self.who = np.searchsorted(ids, who.flatten().to_numpy(zero_copy_only=False))
        self.k = np.diff(answers.offsets.to_numpy())
        self.at = _starts(self.k)[self.q] + codes.flatten().to_numpy(zero_copy_only=False)
        self.kind = b.column("kind").to_numpy(zero_copy_only=False)


def _round(ids: np.ndarray, x: np.ndarray, chance: np.ndarray):
    """(annotator, num, den): the sums of one round of the iteration over a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, den = np.zeros(len(ids)), np.zeros(len(ids))
        for b in batches:
            v = _Batch(b, ids)
            own = x[v.who]
            sa, s, t = np.bincount(v.at, own), np.bincount(v.q, own, v.rows), np.bincount(v.q, own * own, v.rows)
            c = chance[v.kind][v.q]
            num += np.bincount(v.who, (sa[v.at] - own - c * (s[v.q] - own)) / (1 - c), len(ids))
            den += np.bincount(v.who, t[v.q] - own * own, len(ids))
        hit = np.flatnonzero((num != 0) | (den != 0))
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(num[hit]), pa.array(den[hit])], ["at", "num", "den"])

    return run


def _step(x, num, den):
    """Half a step: the map r -> C/r by itself swings between two values. Also for columns."""
    return (x + (num + PRIOR * START * START) / (den + PRIOR * START)) / 2


def reliability(v: DataFrame) -> tuple[DataFrame, np.ndarray | None, np.ndarray | None]:
    """((annotator_id, competence, votes, rounds), and, for at most SMALL annotators, their ids and competences)."""
    spark = v.sparkSession
    schema = "annotator_id long, competence double, votes long, rounds int"
    counts = cut(v.select(F.explode("annotators").alias("annotator_id")).groupBy("annotator_id").agg(F.count("*").alias("votes")))
    known = counts.count()
    c = chances(v)
    if known > SMALL:
        return _joined_reliability(v, counts, c), None, None
    rows = sorted(counts.collect())  # at most SMALL
    ids = np.array([r["annotator_id"] for r in rows], np.int64)
    chance = np.array([c.get(k, 0.0) for k in range(3)])
    x, rounds = np.full(len(ids), START), 0
    while len(ids) and rounds < ROUNDS:
        sums = v.mapInArrow(_round(ids, x, chance), "at long, num double, den double").groupBy("at").agg(F.sum("num").alias("num"), F.sum("den").alias("den")).toPandas()
        num, den = np.zeros(len(ids)), np.zeros(len(ids))
        num[sums["at"]], den[sums["at"]] = sums["num"], sums["den"]
        y = np.clip(_step(x, num, den), -0.2, 1.2)
        rounds += 1
        change, x = np.abs(y - x).max(), y
        if change <= TOLERANCE:
            break
    out = [(int(i), float(c), r["votes"], rounds) for i, c, r in zip(ids, x, rows)]
    return spark.createDataFrame(out, schema), ids, x


def _flat(v: DataFrame, c: dict[int, float]) -> DataFrame:
    """(question_id, annotator_id, answer, k, chance, large), a row per vote; k is the number of answers of the question."""
    spark = v.sparkSession
    chance = spark.createDataFrame([(k, float(p)) for k, p in c.items()], "kind int, chance double")
    z = v.select("question_id", "kind", F.size("answers").alias("k"), (F.size("codes") > LARGE).alias("large"), F.explode(F.arrays_zip("annotators", F.transform("codes", lambda x: F.element_at("answers", x + 1)).alias("said"))).alias("z"))
    z = z.select("question_id", "kind", "k", "large", F.col("z.annotators").alias("annotator_id"), F.col("z.said").alias("answer"))
    return z.join(F.broadcast(chance), "kind").drop("kind")


def _sums(v: DataFrame, large: bool) -> DataFrame:
    """Per vote: x summed over its answer (sa), over its question (s), and x squared over its question (t)."""
    if not large:
        q, qa = W.partitionBy("question_id"), W.partitionBy("question_id", "answer")
        return v.withColumns({"sa": F.sum("x").over(qa), "s": F.sum("x").over(q), "t": F.sum(F.col("x") * F.col("x")).over(q)})
    g = v.groupBy("question_id", "answer").agg(F.sum("x").alias("sa"), F.sum(F.col("x") * F.col("x")).alias("ta"))
    h = g.groupBy("question_id").agg(F.sum("sa").alias("s"), F.sum("ta").alias("t"))
    return v.hint("merge").join(g.drop("ta"), ["question_id", "answer"]).hint("merge").join(h, "question_id")


def _joined_reliability(v: DataFrame, counts: DataFrame, c: dict[int, float]) -> DataFrame:
    """The same for any number of annotators, by joins of votes and competences."""
    flat = cut(_flat(v, c).drop("k"))
    has_large = not flat.where("large").isEmpty()
    r = counts.withColumn("x", F.lit(START))
    rounds = 0
    while rounds < ROUNDS:
        w = flat.hint("merge").join(r.select("annotator_id", "x"), "annotator_id")
        both = _sums(w.where("NOT large"), False)
        if has_large:
            both = both.unionByName(_sums(w.where("large"), True).select(*both.columns))
        num = (F.col("sa") - F.col("x") - F.col("chance") * (F.col("s") - F.col("x"))) / (1 - F.col("chance"))
        y = both.groupBy("annotator_id").agg(F.sum(num).alias("num"), F.sum(F.col("t") - F.col("x") * F.col("x")).alias("den"))
        step = F.greatest(F.lit(-0.2), F.least(F.lit(1.2), _step(F.col("x"), F.coalesce("num", F.lit(0.0)), F.coalesce("den", F.lit(0.0)))))
        new = cut(r.hint("merge").join(y, "annotator_id", "left").select("annotator_id", "votes", step.alias("x"), F.abs(step - F.col("x")).alias("change")))
        rounds += 1
        change = new.agg(F.max("change")).first()[0]
        r = new.drop("change")
        if change is None or change <= TOLERANCE:
            break
    return r.select("annotator_id", F.col("x").alias("competence"), "votes", F.lit(rounds).alias("rounds"))


def _odds(x, k, log):
    """Log odds of an answer given by an annotator of competence x (within bounds) among k answers."""
    return log((x + (1 - x) / k) / ((1 - x) / k))


CHOSEN = "question_id long, answer string, agreement double, votes long"


def _choose(ids: np.ndarray, x: np.ndarray):
    x = np.clip(x, 0.01, 0.97)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _Batch(b, ids)
            total = int(v.k.sum())
            # Equal up to rounding counts as equal, so that the order of summation decides nothing.
            weight = np.round(np.bincount(v.at, _odds(x[v.who], np.maximum(2, v.k)[v.q], np.log), total), 6)
            n = np.bincount(v.at, minlength=total)
            owner = np.repeat(np.arange(v.rows), v.k)
            order = np.lexsort((np.arange(total), -n, -weight, owner))
            best = order[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])] if total else np.zeros(0, np.int64)
            at = np.full(v.rows, -1)
            at[owner[best]] = best
            none = at < 0
            size = np.bincount(v.q, minlength=v.rows)
            share = np.where(none, 0, n[at] if total else 0) / np.maximum(1, size)
            yield pa.RecordBatch.from_arrays(
                [b.column("question_id"), b.column("answers").flatten().take(pa.array(at, mask=none)), pa.array(share, mask=none), pa.array(size, pa.int64())], ["question_id", "answer", "agreement", "votes"])

    return run


def consensus(annotations: DataFrame) -> DataFrame:
    """(question_id, answer, agreement, votes): the consensus answer and the share of votes that gave it."""
    v = votes(latest(annotations))
    rel, ids, x = reliability(v)
    if ids is not None:
        return v.mapInArrow(_choose(ids, x), CHOSEN)
    z = _flat(v, {k: 0.0 for k in range(3)}).hint("merge").join(rel.select("annotator_id", F.least(F.lit(0.97), F.greatest(F.lit(0.01), F.col("competence"))).alias("x")), "annotator_id")
    scored = z.groupBy("question_id", "answer").agg(F.sum(_odds(F.col("x"), F.greatest(F.lit(2), F.col("k")), F.log)).alias("weight"), F.count("*").alias("n"))
    best = F.min(F.struct(-F.round("weight", 6), -F.col("n"), "answer", "n")).alias("b")
    top = scored.groupBy("question_id").agg(best, F.sum("n").alias("votes"))
    out = v.select("question_id").hint("merge").join(top, "question_id", "left")
    return out.select("question_id", "b.answer", (F.col("b.n") / F.col("votes")).alias("agreement"), F.coalesce("votes", F.lit(0)).alias("votes"))


def annotator_reliability(annotations: DataFrame) -> DataFrame:
    """(annotator_id, competence, votes, rounds)."""
    return reliability(votes(latest(annotations)))[0]
