import pytest

from weftline.llm import residue as R


@pytest.mark.parametrize("text", ["Dear {{ user.name }},", "a {0} there", "from ${place}", "$OBJECT_NAME waits", "<%= caption %>", "with %s stripes", "%(colour)s", "[[image_title]]", "[INSERT DESCRIPTION]", "[escriba aquí]", "<your text here>", "<<scene>>", "@@SCENE@@", "XXXX waits", "【此处填写描述】", "(Text hier einfügen)", "&lt;place&gt;", "的员工把{caption}搬到"])
def test_slots(text):
    assert R.has_slot(text)


@pytest.mark.parametrize("text", ["the template is `Describe {object}`.", "The placeholder '{object}' is filled by code.", "Box {48, 57}", 'as {"id": 3, "label": "x"} here', "<5> Dorfen", "word [illegible] 3", "costs $75, 31% less", "[1] a note", "<b>bold</b>", "f(x) = [a, b]"])
def test_no_slots(text):
    assert not R.has_slot(text)


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, template string")


CASES = [
    "404 - The page you asked for could not be found", '{"error": {"code": 503, "message": "too many requests"}}', "<title>Invalid request parameters (E5)</title>", "Oops! Something went wrong on our side. Try again later. (Node 3.4)", "Please enable JavaScript to see the pictures.", "Gallery\nMenu  Login\n请启用脚本功能以继续浏览。",
    "Lorem ipsum dolor sit amet.", "Caption goes here. Caption goes here.", "测试测试测试. 此处为占位内容.", "Retas torquae sumela nostum modum sumela vorem. Sinquam aperint modum torquae lavit deloris.", "A dog in {{place}} is asleep near the wall.", "Die gewünschte Seite wurde nicht gefunden", "One day a dog\n\nYour session has expired, sign in once more!",
]
CONTENT = [
    "The screen near the station shows a page with the words 404 not found; a dog waits there. A cat sits on the wall.", "The exhibit is about error messages: visitors read 'access denied' on a wall while a clock stands still.", "A sticker reading JavaScript is glued to a laptop. A dog sleeps next to it.", "Dorfen 12\nMerkel 883", None, "", "  ",
    "A dog sleeps near the old wall.", "En la pantalla se lee 'error interno' y un perro duerme en la sala.", "门口的屏幕上显示着“404”，一只狗在那里。", "A test pattern with 6 bars is projected beside the pond; the sample text on it names Remruk.",
]


def test_documents(spark):
    got = {r["doc_id"] for r in R.residue_documents(rows(spark, CASES + CONTENT * 2 + CASES[:1])).collect()}
    assert got == set(range(len(CASES))) | {len(CASES) + 2 * len(CONTENT)}
    assert R.residue_documents(rows(spark, CASES).where("false")).count() == 0


def test_tree_merges_what_differs_by_names():
    t = R.Tree()
    for name in ("Anna", "Bert", "Carl"):
        t.add(R.masked(f"The host {name} closed the connection 12 times"))
    assert [x[:2] for x in t.drain()] == [("the host <*> closed the connection <*> times", 3)]


def test_long_text_and_repeats(spark):
    long = "A dog sleeps near the old wall. " * 3000
    assert R.residue_documents(rows(spark, [long, long + " {{slot}}", "x" * 100_000])).collect()[0]["doc_id"] == 1


@pytest.mark.parametrize("text", ["HTTP 502: upstream prematurely closed connection", "Your browser must run client-side code to view this content", "Nous n'avons pas trouvé ce que vous cherchez"])
def test_messages_of_servers_and_browsers(spark, text):
    assert [r[0] for r in R.residue_documents(rows(spark, ["A dog sleeps near the old wall.", text])).collect()] == [1]


def test_support_of_a_message_without_a_seed(spark):
    odd = "Proxy server 17: response of client session 4 lost"
    content = [f"A {a} sleeps near the old {b} by the server room." for a in ("dog", "cat", "goat") for b in ("wall", "gate")]
    got = {r[0] for r in R.residue_documents(rows(spark, [odd, odd.replace("17", "3"), odd.replace("4", "9"), *content * 4])).collect()}
    assert got == {0, 1, 2}
    assert R.residue_documents(rows(spark, [odd, *content])).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_results_do_not_depend_on_partitions_copies_or_the_way_of_sending(spark, monkeypatch, parts):
    once = rows(spark, CASES + [c for c in CONTENT if c])
    many = once.crossJoin(spark.range(20).withColumnRenamed("id", "k")).selectExpr("doc_id + 1000 * k AS doc_id", "text", "template").repartition(parts)
    want = {i + 1000 * k for i in range(len(CASES)) for k in range(20)}
    assert {r[0] for r in R.residue_documents(many).collect()} == want
    if parts == 7:
        monkeypatch.setattr(R, "SHIPPED", 2)
        monkeypatch.setattr(R, "CROWD", 1)
        assert {r[0] for r in R.residue_documents(many).collect()} == want


def test_crowded_leaf(spark, monkeypatch):
    monkeypatch.setattr(R, "CROWD", 50)
    d = spark.range(100_000).selectExpr("id AS doc_id", "concat('the old ', substring(md5(cast(id % 3000 AS string)), 1, 6), 'a sleeps near ', substring(md5(cast(id % 2999 + 7 AS string)), 1, 6), 'b') AS text").selectExpr("doc_id", "translate(text, '0123456789', 'ghijklmnop') AS text")
    assert R.residue_documents(d.unionByName(spark.createDataFrame([(-1, "the old page was not found")], "doc_id long, text string"))).collect()[0][0] == -1
