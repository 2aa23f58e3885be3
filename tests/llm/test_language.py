import json
import random

import pytest

from weftline.llm import language as L

SENTENCES = {
    "en": ["The {a} stands near the old {b} while it rains.", "There are two {a}s behind the {b} in the garden.", "Someone has left a {a} on the {b} this morning.", "You can see that the {a} is bigger than a {b}."],
    "de": ["Der {a} steht neben dem alten {b}, während es regnet.", "Hinter dem {b} sind zwei {a} im Garten zu sehen.", "Jemand hat heute früh einen {a} auf dem {b} gelassen.", "Man kann sehen, dass der {a} größer ist als ein {b}."],
    "fr": ["Le {a} se trouve près du vieux {b} pendant qu'il pleut.", "Il y a deux {a} derrière le {b} dans le jardin.", "Quelqu'un a laissé un {a} sur le {b} ce matin.", "On peut voir que le {a} est plus grand que le {b}."],
    "es": ["El {a} está cerca del viejo {b} mientras llueve.", "Hay dos {a} detrás del {b} en el jardín.", "Alguien ha dejado un {a} sobre el {b} esta mañana.", "Se puede ver que el {a} es más grande que un {b}."],
    "zh": ["下雨的时候，{a}在旧{b}旁边。", "花园里{b}后面有两个{a}。", "今天早上有人把{a}放在{b}上面。", "可以看到{a}比{b}大得多。"],
}
THINGS = ["radio", "piano", "taxi", "robot", "banana", "kayak", "sofa", "tomate"]


def sentence(r, lang):
    return r.choice(SENTENCES[lang]).format(a=r.choice(THINGS), b=r.choice(THINGS))


def talk(*turns):
    return json.dumps([{"role": r, "content": c} for r, c in turns], ensure_ascii=False)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = []
    for i in range(400):
        lang = r.choice(list(SENTENCES))
        label = lang if r.random() < 0.85 else r.choice(list(SENTENCES))
        out.append((i, talk(("user", sentence(r, lang)), ("assistant", " ".join(sentence(r, lang) for _ in range(3)))), label, lang))
    return out


def test_held_out_accuracy(rows):
    model = L.fit_texts([(label, s) for _, c, label, _ in rows[:300] for _, _, t in L.turns_of(c) for s in L.stretches(t)])
    texts = [(lang, s) for _, c, _, lang in rows[300:] for _, _, t in L.turns_of(c) for s in L.stretches(t)]
    found = L.classify([s for _, s in texts], model)
    assert sum(found[s][0] == lang for lang, s in texts) >= 0.99 * len(texts)
    assert L.classify(["ქართული ენა არის", "12 34"], model)["ქართული ენა არის"][0] is None


def test_found(spark, rows):
    r = random.Random(9)
    extra = [
        (1000, talk(("user", sentence(r, "en")), ("assistant", sentence(r, "fr"))), "en"),
        (1001, talk(("user", sentence(r, "en")), ("assistant", sentence(r, "en") + " The sign says 'ein alter Hund' there.")), "en-US"),
        (1002, talk(("user", sentence(r, "de")), ("assistant", sentence(r, "de") + " " + sentence(r, "en"))), None),
        (1003, talk(("user", sentence(r, "zh")), ("assistant", sentence(r, "zh"))), " "),
        (1004, talk(("system", sentence(r, "de")), ("user", sentence(r, "es")), ("assistant", "7")), "ES"),
        (1005, None, "en"), (1006, "[]", None), (1007, "no json", None), (1008, talk(("user", " "), ("assistant", "12")), None), (1009, '[{"role":"user","content":null}]', None),
    ]
    d = spark.createDataFrame([(i, c, label, "other") for i, c, label, _ in rows] + [(*x, "other") for x in extra], "row_id long, conversations string, lang string, label string")
    got = {tuple(x) for x in L.mislabelled_or_mixed(d).collect()}
    mine = {x for x in got if x[0] >= 1000}
    assert mine == {(1000, 0, "en"), (1000, 1, "fr"), (1002, 0, "de"), (1002, 1, "de"), (1002, 1, "en"), (1003, -1, "zh")}
    wrong = {(i, -1, lang) for i, _, label, lang in rows if label != lang}
    assert len(wrong & got) >= 0.98 * len(wrong) and len({x for x in got if x[0] < 1000} - wrong) <= 0.02 * len(rows)


def test_no_labels_and_no_rows(spark):
    d = spark.createDataFrame([(1, talk(("user", "Hello there my friend")), None)], "row_id long, conversations string, lang string")
    assert L.conversation_languages(d).count() == 0
    assert L.mislabelled_or_mixed(d.where("false")).count() == 0


@pytest.mark.parametrize("label, want", [("zh-CN", "zh"), ("EN", "en"), ("it", None), ("unknown", None), ("", None), (None, None), ("de_AT", "de")])
def test_labels(label, want):
    assert L.label_of(label) == want


def test_stretches():
    assert len(L.stretches("One thing here. 另一件事情在这里。")) == 2
    assert L.stretches("wrapped\nanywhere in a line") == ["wrapped\nanywhere in a line"]
    assert "guitare" not in " ".join(L.stretches("A notice says 'une guitare' here."))
    assert any("guitare" in s for s in L.stretches("He said 'il y a une guitare sur la table' here."))
    assert L.stretches("") == [] and L.stretches("<image>\n") == []
