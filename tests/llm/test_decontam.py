"""Template decontamination on planted cases."""

from storepulse.llm import decontam
from tests.llm.helpers import awkward, documents, prose, rows

QUESTION = ("A farmer named Alice sold 48 kg of apples in April and then Alice sold half as many in May. "
            "How many kilos did Alice sell altogether in those 2 months?")


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def found(spark, texts, items, **options):
    docs = documents(spark, texts)
    out = decontam.find(decontam.numbered(docs), bench(spark, items), **options)
    ids = {r["doc"]: r["doc_id"] for r in rows(docs.select("doc_id", decontam.numbered(docs).columns[0]).limit(0))}
    del ids
    by = {r["doc"]: i for i, r in enumerate(rows(decontam.numbered(docs)))}
    return {(by[r["doc"]], r["item"]): r for r in rows(out)}


def test_verbatim_and_reparameterised(spark):
    pad = " ".join(prose(80, 1))
    changed = QUESTION.replace("Alice", "Bruno").replace("48 kg", "1,250 lbs").replace("April", "June").replace("2 months", "7 weeks")
    mixed = QUESTION.replace("Alice", "Bruno", 1).replace("Alice", "Clara", 1)  # the same name becomes three
    got = found(spark, [f"{pad}\n{QUESTION} {pad}", f"{pad}. {changed} {pad}", pad, mixed, QUESTION.lower(), None, ""], [QUESTION, None, ""])
    assert (0, 0) in got and got[0, 0]["share"] == 1 and got[0, 0]["slots_changed"] == 0
    assert (1, 0) in got and got[1, 0]["slots_changed"] >= 4
    assert not any(d in (2, 5, 6) for d, _ in got)
    assert got[1, 0]["covered"] > got.get((3, 0), {"covered": 0})["covered"]


def test_clean_prose_with_common_phrases_stays(spark):
    items = [" ".join(prose(30, s)) for s in range(20)]
    docs = [" ".join(prose(60, 100 + s)) + " " + " ".join(items[s % 20].split()[:8]) for s in range(40)]
    assert found(spark, docs, items) == {}
    numbers = ["1 2 3 4 5 6 7 8 9 10 11 12"] * 2
    assert found(spark, numbers, ["10 20 30 40 50 60 70 80"]) == {}  # placeholders alone prove nothing


def test_items_shorter_than_a_window(spark):
    got = found(spark, ["zeta " + " ".join(prose(20, 1)) + " quick brown foxes", "quick brown"], ["quick brown foxes", "one"])
    assert set(got) == {(0, 0)}


def test_matches_a_plain_word_search(spark):
    """Without names, numbers and units a template match is a word match."""
    items = [" ".join(prose(12 + s, s)) for s in range(10)]
    docs, want = [], set()
    for k in range(60):
        body = prose(50, 500 + k)
        if k % 3 == 0:
            words = items[k % 10].split()
            cut = len(words) if k % 2 else max(5, len(words) // 4)
            body[10:10] = words[:cut]
            if cut >= 0.5 * len(words):
                want.add((k, k % 10))
        docs.append(" ".join(body))
    assert set(found(spark, docs, items)) == want


def test_clean_drops_only_contaminated(spark):
    docs = documents(spark, [QUESTION, "other words here", None, "", QUESTION], ids=[1, 2, 3, None, 1])
    kept = decontam.clean(docs, bench(spark, [QUESTION]))
    assert kept.columns == docs.columns
    assert [r["text"] for r in rows(kept.orderBy("doc_id"))] == ["", "other words here", None]


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    assert decontam.clean(docs, bench(spark, ["nothing like it at all in there"])).count() == docs.count()
    assert decontam.clean(docs, bench(spark, ["x"]).limit(0)).count() == docs.count()
    assert decontam.clean(docs.limit(0), bench(spark, [QUESTION])).count() == 0


def test_alignments_of_an_edited_copy_add_up(spark):
    items = [" ".join(prose(36, s)) for s in range(6)]
    docs = []
    for k, text in enumerate(items):
        words = text.split()
        docs.append(" ".join(prose(30, 50 + k) + words[:12] + ["extra"] + words[12:24] + ["other"] + words[24:] + prose(30, 90 + k)))
    far = items[0].split()  # the pieces far apart are no copy
    docs.append(" ".join(far[:12] + prose(400, 7) + far[12:24] + prose(400, 8) + far[24:]))
    assert set(found(spark, docs, items)) == {(k, k) for k in range(6)}


def test_names_and_numbers_of_other_word_counts(spark):
    item = "Yesterday the baker Tom Smith sold 1 250 loaves in New York and the baker Tom Smith gave 30 loaves away in New York for free"
    copy = item.replace("Tom Smith", "Ben").replace("New York", "Boston").replace("1 250", "75")
    got = found(spark, [copy, item], [item])
    assert set(got) == {(0, 0), (1, 0)}
    assert got[0, 0]["share"] == 1 and got[0, 0]["slots_changed"] == 3 and got[1, 0]["slots_changed"] == 0


def test_a_repeated_phrase_stands_for_one_place(spark):
    phrase = "red apples grow on tall trees"
    item = f"{phrase} {phrase} {' '.join(prose(8, 3))}"
    assert found(spark, [f"see {phrase} now"], [item]) == {}


def test_verbatim_items_poor_in_literals(spark):
    items = ["What is 12 + 30 * 7?", "Compute 17 + 25 - 9.", "10 20 30 40 50 60 70 80", "New York"]
    pad = " ".join(prose(30, 1))
    docs = [f"{pad}. {q} {pad}" for q in items] + [f"{pad}. What is 13 + 31 * 8? Compute 18 + 26 - 8. 11 21 31 41 51 {pad}", f"{pad} in New York {pad}"]
    assert set(found(spark, docs, items)) == {(0, 0), (1, 1), (2, 2), (3, 3), (5, 3)}


def test_scripts_without_spaces(spark):
    items = ["小明有十二个苹果，他给了小红三个，还剩几个苹果？", "二足す三は？", "ราคาเท่าไร"]
    docs = [f"前言不搭后语。{items[0]}谢谢大家", f"質問：{items[1]}答え", f"ก่อน{items[2]}หลัง", "今天天气很好，我们一起去公园散步吧。"]
    assert set(found(spark, docs, items)) == {(0, 0), (1, 1), (2, 2)}


def test_every_text_of_an_item_is_searched(spark):
    texts = [" ".join(prose(n, s)) for s, n in enumerate((20, 25, 30, 35))]
    items = spark.createDataFrame([(k // 3, t) for k, t in enumerate(texts)], "item_id long, text string")
    docs = documents(spark, [f"before {t} after" for t in texts])
    by = {r["doc"]: i for i, r in enumerate(rows(decontam.numbered(docs)))}
    got = {(by[r["doc"]], r["item"]): r["tokens"] for r in rows(decontam.find(decontam.numbered(docs), items))}
    assert got == {(0, 0): 20, (1, 0): 25, (2, 0): 30, (3, 1): 35}
