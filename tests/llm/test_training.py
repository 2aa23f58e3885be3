"""Records, near-duplicates, splits and consensus against brute force and on awkward input."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import canonical, consensus, near, splits

T0 = dt.datetime(2024, 1, 1)


def sft(spark, rows):
    return spark.createDataFrame([(i, b if b is None else bytearray(b), c, "x") for i, b, c in rows], "row_id long, image_bytes binary, conversations string, digest string")


def talk(*turns):
    return json.dumps([{"role": r, "content": c} for r, c in turns], ensure_ascii=False)


# --- 5 ------------------------------------------------------------------------------------------------------------------


def test_canonical_records(spark):
    a = talk(("user", "Was ist weiß?"), ("assistant", "Der Schnee."))
    b = '[ {"content": "WAS  IST WEISS", "tools": null, "role":"user"}, {"role":"assistant","content":"der schnee"} ]'
    null, absent = '[{"role":"user","content":null}]', '[{"role":"user"}]'
    rows = [(1, b"i", a), (2, b"i", b), (3, b"i", a), (4, b"j", a), (5, None, a), (6, b"i", None), (7, b"i", "[]"), (8, b"i", "oops"), (9, b"i", ""), (10, b"i", null), (11, b"i", absent), (12, b"i", talk(("assistant", "Was ist weiß?"), ("user", "Der Schnee.")))]
    got = {tuple(r) for r in canonical.duplicate_rows(sft(spark, rows)).collect()}
    assert got == {(1, 2), (1, 3), (10, 11)}
    copies = {r["keep_id"]: r["copies"] for r in canonical.dedup_records(sft(spark, rows)).collect()}
    assert copies == {1: 3, 4: 1, 10: 2, 12: 1}
    assert canonical.duplicate_rows(sft(spark, rows).where("false")).count() == 0


def test_canonical_hot_record(spark):
    d = spark.range(3000).selectExpr("id AS row_id", "CASE WHEN id % 3 = 0 THEN X'01' ELSE encode(CAST(id AS STRING), 'UTF-8') END AS image_bytes", "CASE WHEN id % 2 = 0 THEN '[{\"role\":\"user\",\"content\":\"Hi!\"}]' ELSE '[{\"content\":\"hi\",\"role\":\"user\"}]' END AS conversations")
    got = canonical.duplicate_rows(d)
    assert got.count() == 999 and got.where("keep_id <> 0 OR row_id % 3 <> 0").count() == 0


# --- 3 ------------------------------------------------------------------------------------------------------------------


def brute_groups(texts, threshold=0.5):
    sets = {}
    for i, t in texts.items():
        w = near.WORD.findall(t)
        if len(w) >= 60:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    return {(i, j) for i in group for j in group if i < j and group[i] == group[j]}


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)] + list("图片猫狗")
    texts = {}
    for i in range(0, 120, 4):
        base = [r.choice(words) for _ in range(r.randint(55, 160))]
        texts[i] = " ".join(base)
        for k in range(1, 4):
            w = list(base)
            for _ in range(r.randint(0, 14)):
                w[r.randrange(len(w))] = r.choice(words)
            if k == 2:
                c = r.randrange(len(w))
                w = w[c:] + w[:c]
            texts[i + k] = " ".join(w)
    d = spark.createDataFrame([(i, talk(("user", "<image>" + t[:100]), ("assistant", t[100:]))) for i, t in texts.items()] + [(900, None), (901, "x"), (902, "[]")], "row_id long, conversations string")
    seen = {i: (t[:100] + "\n" + t[100:]).lower() for i, t in texts.items()}
    want = brute_groups(seen)
    got = {tuple(x) for x in near.similar_conversations(d).collect()}
    assert len(want) > 60 and got == want


def test_near_duplicates_one_hot_family(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(500)}" for _ in range(90)]
    rows = []
    for i in range(400):
        w = list(base)
        w[r.randrange(90)] = f"x{i}"
        rows.append((i, talk(("user", "q"), ("assistant", " ".join(w)))))
    g = near.conversation_groups(spark.createDataFrame(rows, "row_id long, conversations string"))
    assert g.select("group_id").distinct().count() == 1 and g.count() == 400
    assert near.conversation_groups(spark.createDataFrame([], "row_id long, conversations string")).count() == 0


def test_tree_join_excludes_only_what_the_bound_excludes():
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.poisson(0.8, (700, near.SIZE))
    v[:200, near.SIZE // 2 :] = 0  # texts of two kinds
    v[200:400, : near.SIZE // 2] = 0
    v[400:] = np.maximum(v[:300] - (rng.random((300, near.SIZE)) < 0.05), 0)
    n = v.sum(axis=1)
    bits, rest = near.unary(v)
    tree = near.RTree(bits.view(np.uint64), rest, n, n.astype(float), n / 3)
    got = set()
    for i, j in near.tree_pairs(tree, tree, 1 / 3):
        got |= {(min(x), max(x)) for x in zip(i.tolist(), j.tolist())}
    want = {(i, j) for i in range(700) for j in range(i + 1, 700) if np.minimum(v[i], v[j]).sum() >= (n[i] + n[j]) / 3}
    assert len(want) > 200 and want <= got and len(got) < 0.8 * 700 * 699 / 2


def long_texts(r, count=60):
    words = [f"w{i}" for i in range(3000)]
    texts = {}
    for i in range(count):
        w = [r.choice(words) for _ in range(r.choice([62, 90, 250, 300, 520, 700, 1100]))]
        texts[len(texts)] = " ".join(w)
        for cut in (1.0, 0.75, 0.55):
            x = w[: int(len(w) * cut)]
            for _ in range(r.randint(0, max(1, len(x) // 12))):
                x[r.randrange(len(x))] = r.choice(words)
            texts[len(texts)] = " ".join(x)
    return texts


def rows_of(spark, texts):
    return spark.createDataFrame([(i, talk(("user", t))) for i, t in texts.items()], "row_id long, conversations string")


def test_texts_of_all_sizes_against_brute_force(spark):
    texts = long_texts(random.Random(11))
    want = brute_groups(texts)
    assert len(want) > 60 and {tuple(x) for x in near.similar_conversations(rows_of(spark, texts)).collect()} == want


@pytest.mark.parametrize("block", [3, 20])
def test_large_cells_in_blocks_lose_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    r = random.Random(12)
    texts = long_texts(r, 20)
    # Two families around one text each, which a chain of ever more distant texts joins, and boilerplate in all of them.
    base = [f"b{r.randrange(900)}" for _ in range(70)]
    for k in range(60):
        w = list(base)
        for x in r.sample(range(70), k % 12):
            w[x] = f"y{r.randrange(9999)}"
        texts[len(texts)] = " ".join(w)
    want = brute_groups(texts)
    assert {tuple(x) for x in near.similar_conversations(rows_of(spark, texts)).collect()} == want


def test_links_that_fall_apart_are_sought_again(spark, monkeypatch):
    # With so few groups the bound lets nearly everything pass, and the forests are full of false links.
    monkeypatch.setattr(near, "SIZE", 64)
    monkeypatch.setattr(near, "LEVELS", 4)
    texts = long_texts(random.Random(13), 25)
    assert {tuple(x) for x in near.similar_conversations(rows_of(spark, texts)).collect()} == brute_groups(texts)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_groups_do_not_depend_on_partitions(spark, parts):
    texts = long_texts(random.Random(14), 15)
    texts |= {1000 + i: t for i, t in texts.items()}  # copies
    assert {tuple(x) for x in near.similar_conversations(rows_of(spark, texts).repartition(parts)).collect()} == brute_groups(texts)


@pytest.mark.parametrize("small", [0, 200_000])
def test_copies_in_many_tasks_are_one_text(spark, monkeypatch, small):
    monkeypatch.setattr(near, "SMALL", small)
    texts = dict(enumerate([" ".join(f"w{n // 2}x{i}" if i % 40 else f"z{n}" for i in range(80)) for n in range(30)] * 8))
    seen, joined = [], near.components_of
    monkeypatch.setattr(near, "components_of", lambda t, *more: seen.append((t.count(), t.select("digest").distinct().count())) or joined(t, *more))
    got = {tuple(x) for x in near.conversation_groups(rows_of(spark, texts).repartition(8)).collect()}
    # Counted again for every task that meets it, no run of a repeated text looks rare.
    assert seen == [(30, 30)]
    assert got == {(i, (i % 30) // 2 * 2, 8) for i in range(240)}


# --- 4 ------------------------------------------------------------------------------------------------------------------


def questions(spark, rows):
    return spark.createDataFrame([(i, img, q, s, "src", T0) for i, img, q, s in rows], "question_id long, image_id long, question string, split string, source string, ingested_at timestamp")


def test_cross_split_pairs(spark):
    many = [(1000 + i, 99 + i, f"what color is the {w}", "train") for i, w in enumerate(["backpack", "umbrella", "statue", "kettle", "bottle", "dog"] * 30)]
    rows = many + [
        (1, 5, "What color is the backpack?", "train"), (2, 5, "what colour is that backpak", "val"), (3, 5, "What color is the umbrella?", "test"), (4, 6, "What color is the backpack?", "val"),
        (5, 5, "Please tell me: what color is the backpack? Answer briefly.", "test"), (6, 5, None, "val"), (7, 5, " ?! ", "train"), (8, None, "What color is the backpack?", "val"), (9, 7, "狗后面是什么？", "train"), (10, 7, "请问狗后面是甚么呢？", "val"),
        (11, 7, "猫后面是什么？", "val"), (12, 8, "what is on shelf 3", "train"), (13, 8, "what is on shelf 4", "val"), (1, 5, "What color is the backpack?", "train"),
    ]
    got = {tuple(r) for r in splits.cross_split_pairs(questions(spark, rows)).collect()}
    assert got == {(1, 2), (1, 5), (9, 10)}
    c = {(r["split"], r["source"]): (r["questions"], r["overlapping"]) for r in splits.cross_split_counts(questions(spark, rows)).collect()}
    assert c[("val", "src")] == (5, 2) and c[("test", "src")] == (2, 1)
    assert splits.cross_split_pairs(questions(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("times", [1, 50])
def test_pairs_do_not_depend_on_the_size_of_the_table(spark, times):
    q = [("what color is the backpack", "train"), ("what color is the backpak", "val"), ("what color is the cart", "train"), ("what color is the cat", "test"), ("what coolr is the cat", "val")]
    rows = [(k * 100 + i, k, t, s) for k in range(times) for i, (t, s) in enumerate(q)] + [(10**6 + i, 10**6 + i, "what is the color of the cat near the backpack", "train") for i in range(200 * times)] + [(2 * 10**6 + i, 2 * 10**6 + i, "a cart", "train") for i in range(10 * times)]
    got = {tuple(r) for r in splits.cross_split_pairs(questions(spark, rows)).collect()}
    assert got == {(100 * k, 100 * k + 1) for k in range(times)}


def test_slips():
    assert splits.is_slip("coolr", 25, "color", 7637) and splits.is_slip("tracotr", 1, "tractor", 26)
    assert not splits.is_slip("cart", 10_000, "cat", 1_000_000) and not splits.is_slip("3", 1, "4", 900) and not splits.is_slip("dog", 1, "cat", 9000)
    assert {"color", "cooler"} <= splits.one_slip("coolr")


def test_hot_segment_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(splits, "BLOCK", 5)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "klmn"]
    rows = [(2 * i + j, 5, f"what color is the {w}", ("train", "val")[j]) for i, w in enumerate(words) for j in (0, 1)]
    got = {tuple(r) for r in splits.cross_split_pairs(questions(spark, rows)).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(len(words))}


def test_segments_miss_no_pair_within_the_edits(spark):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n)).strip() or "a"
    texts = [word(r.randint(1, 40)) for _ in range(60)]
    mut = []
    for t in texts:
        w = list(t)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = r.choice(["", "z", "y"])
        mut.append("".join(w).strip() or "z")
    ev = spark.createDataFrame([(i, 1, t, len(t)) for i, t in enumerate(dict.fromkeys(texts))], "rep long, image_id long, s string, l int")
    tr = spark.createDataFrame([(i, 1, t, len(t)) for i, t in enumerate(dict.fromkeys(mut))], "rep long, image_id long, s string, l int")
    from pyspark.sql import functions as F

    lengths = ev.select("image_id", F.col("l").alias("el")).distinct()
    near = splits._keys_eval(ev).join(splits._keys_train(tr, lengths).drop("image_id"), "key").select("s_e", "s_t").distinct()
    got = {tuple(x) for x in near.collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    edits = lambda n: 4 if n >= 20 else 3 if n >= 12 else 2 if n >= 8 else 1 if n >= 4 else 0
    want = {(a, b) for a in set(texts) for b in set(mut) if distance(a, b) <= edits(len(a))}
    assert want and want <= got


# --- 6 ------------------------------------------------------------------------------------------------------------------


def annotations(spark, rows):
    return spark.createDataFrame([(q, "other", [(k, a, x, "yes") for k, (a, x) in enumerate(v)] if v is not None else None, t) for q, v, t in rows], "question_id long, answer_type string, answers array<struct<answer_id:int,annotator_id:bigint,answer:string,answer_confidence:string>>, ingested_at timestamp")


@pytest.mark.parametrize("text, want", [("The Two  cats!", "2 cats"), (" an ", ""), (None, ""), ("不是。", "不是"), ("ten", "10")])
def test_plain_answers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(consensus.plain_answer(F.col("t")).alias("x")).first()["x"] == want


def test_spectral_beats_majority(spark):
    r = random.Random(2)
    truth = {q: r.choice(["cat", "dog", "bus", "sofa"]) for q in range(400)}
    good, bad = list(range(8)), list(range(100, 112))
    rows, tricky = [], 0
    for q, a in truth.items():
        wrong = r.choice([x for x in ("cat", "dog", "bus", "sofa") if x != a])
        g, b = r.sample(good, 4), r.sample(bad, 5)
        rows.append((q, [(x, a if r.random() < 0.95 else wrong) for x in g] + [(x, wrong if r.random() < 0.55 else r.choice(["cat", "dog", "bus", "sofa"])) for x in b], T0))
    got = {x["question_id"]: x["answer"] for x in consensus.consensus(annotations(spark, rows)).collect()}
    majority = 0
    for q, v, _ in rows:
        c = {}
        for _, x in v:
            c[x] = c.get(x, 0) + 1
        majority += max(sorted(c), key=c.get) == truth[q]
    right = sum(got[q] == truth[q] for q in truth)
    assert right > 0.9 * len(truth) and right > majority
    rel = {x["annotator_id"]: x["competence"] for x in consensus.annotator_reliability(annotations(spark, rows)).collect()}
    assert min(rel[x] for x in good) > max(rel[x] for x in bad)


def test_consensus_edges(spark):
    rows = [(1, [(1, "a cat"), (1, "dog"), (2, "Cat."), (None, "bus"), (3, " ")], T0), (1, [(1, "dog")], T0 - dt.timedelta(days=1)), (2, [], T0), (3, None, None), (4, [(1, None)], T0), (5, [(1, "x"), (2, "y")], None)]
    got = {x["question_id"]: (x["answer"], x["votes"]) for x in consensus.consensus(annotations(spark, rows)).collect()}
    assert got[1] == ("cat", 2) and got[2] == (None, 0) and got[3] == (None, 0) and got[4] == (None, 0) and got[5][0] in ("x", "y")
    assert consensus.consensus(annotations(spark, [])).count() == 0


def test_many_annotators_and_large_questions_give_the_same(spark, monkeypatch):
    r = random.Random(6)
    rows = [(q, [(a, r.choice(["x", "y"]) if a % 3 else "x") for a in r.sample(range(30), 12)], T0) for q in range(40)]
    d = annotations(spark, rows)
    monkeypatch.setattr(consensus, "TOLERANCE", 1e-2)
    one = {x["annotator_id"]: x["competence"] for x in consensus.annotator_reliability(d).collect()}
    chosen = sorted(map(tuple, consensus.consensus(d).collect()))
    monkeypatch.setattr(consensus, "SMALL", 5)
    for large in (4096, 5):
        monkeypatch.setattr(consensus, "LARGE", large)
        rel = consensus.annotator_reliability(d).collect()
        assert one == pytest.approx({x["annotator_id"]: x["competence"] for x in rel}, abs=1e-9) and 1 < rel[0]["rounds"] < consensus.ROUNDS
    assert sorted(map(tuple, consensus.consensus(d).collect())) == chosen
