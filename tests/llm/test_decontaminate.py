import re
import time

from pyspark.sql import functions as F

from scriptmill.llm import common, decontaminate as D

ITEM = ("A train leaves the station at 9 km from the old bridge and travels 45 km in 3 hours toward the city where "
        "Alice waits with 12 apples, how many apples are left when the train travels 45 km more?")
OTHER = ("a train leaves the station at 7 km from the old bridge and travels 60 km in 4 hours toward the city where "
         "Bob waits with 30 apples, how many apples are left when the train travels 60 km more?")
MIXED = OTHER.replace("60 km more", "99 km more")
CLEAN = "the quick brown fox jumps over the lazy dog while the small river runs past the mill and the old bridge"


def brute_windows(text):
    """Template windows in plain Python."""
    text = re.sub(r"\d+(?:[.,:/]\d+)+|\w*\d\w*", " # ", text)
    text = re.sub(r"(?:(?<=[a-z#] )|(?<=[a-z#][,;] )|(?<=[a-z#]  ))[A-Z][^\W\d_]*", "@", text)
    text = re.sub(r"(?:(?<=# )|(?<=#  ))(?i:km|hours)(?![^\W\d_])", "%", text)
    words = re.findall(r"(?:[^\W\d_]|[#@%])+", text.lower())
    spans = [tuple(words[i:i + D.WINDOW]) for i in range(len(words) - D.WINDOW + 1)]
    return {s for s in spans if sum(w not in "#@%" for w in s) >= D.LITERALS}, set(spans)


def bench(spark, *items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_equals_brute_force(docs, spark, pairs):
    rows = [(1, CLEAN), (2, f"{CLEAN}\n{ITEM} {CLEAN}"), (3, f"{CLEAN}. {OTHER}"), (4, ITEM[:110]), (5, ITEM[:60]),
            (6, ITEM.upper())]
    item = brute_windows(ITEM)[0]
    want = [(i, 0, len(item & brute_windows(t)[1])) for i, t in rows
            if len(item & brute_windows(t)[1]) >= D.COVERAGE * len(item)]
    got = pairs(D.leaks(docs(*rows), bench(spark, ITEM)), "doc_id", "item_id", "n_windows")
    assert got == want and {2, 3, 4} <= {r[0] for r in got} and not {1, 5} & {r[0] for r in got}


def test_slots(docs, spark):
    rows = {r.doc_id: r for r in D.leaks(docs((1, ITEM), (2, OTHER), (3, MIXED), (4, f"{ITEM}\n{ITEM}")), bench(spark, ITEM),
                                         consistency=0.0).collect()}
    assert not rows[1].reparameterised and rows[2].reparameterised
    assert rows[1].consistency == rows[2].consistency == rows[4].consistency == 1.0 > rows[3].consistency > 0
    strict = D.leaks(docs((2, OTHER), (3, MIXED)), bench(spark, ITEM), consistency=1.0)
    assert [r.doc_id for r in strict.collect()] == [2]


def test_occurrences_are_judged_each_for_itself(docs, spark):
    third = OTHER.replace("7 km", "8 km").replace("60", "20").replace("4 hours", "2 hours").replace("Bob", "Carol").replace("30", "5")
    longer = third.replace("toward the city", "slowly and steadily toward the old city")
    rows = [(1, f"{ITEM}\n{OTHER}"), (2, f"{OTHER} {third}"), (3, f"{CLEAN}\n{OTHER}\n{CLEAN}\n{third}\n{ITEM}"),
            (4, f"{MIXED}\n{MIXED}"), (5, f"{longer}\n{ITEM[:150]}"), (6, f"{CLEAN}\n{CLEAN}")]
    got = {r.doc_id: r for r in D.leaks(docs(*rows), bench(spark, ITEM)).collect()}
    assert {1, 2, 3, 5} <= set(got) and 6 not in got
    assert all(got[i].consistency == 1.0 and got[i].reparameterised for i in (1, 2, 3))
    strict = D.leaks(docs(*rows), bench(spark, ITEM), consistency=1.0)
    assert 4 not in {r.doc_id for r in strict.collect()}


def test_names_that_start_sentences(docs, spark):
    item = "Tom has 5 red apples. Tom buys 9 more apples. Tom eats 1 apple at noon. Tom sells 2 of them. What is left?"
    quoted = "\u201cTom has 5 red apples.\u201d\n(Tom buys 9 more apples.)\nTom eats 1 apple at noon. Tom sells 2 of them. What is left?"
    rows = [(1, item), (2, item.replace("Tom", "Raj")), (3, f"{CLEAN}. {quoted.replace('Tom', 'Mary')}"),
            (4, item.replace("Tom", "Raj").replace("5", "6")), (5, item.replace("apple", "horse").replace("Tom", "Raj"))]
    got = {r.doc_id: r for r in D.leaks(docs(*rows), bench(spark, item)).collect()}
    assert set(got) == {1, 2, 3, 4} and all(r.coverage == r.consistency == 1.0 for r in got.values())
    assert not got[1].reparameterised and all(got[i].reparameterised for i in (2, 3, 4))


def test_words_keep_their_templates(docs, spark):
    texts = ["3.5km and 12km, a3.5 İstanbul'da 5 Kg of Łódź é\u0301 \uE000x 1/2", "", None, "...", "x" * 20_000]
    df = docs(*enumerate(texts))

    rows = df.select(D.template(D.plain(F.col("text"))).alias("a"), D.raw_words(D.plain(F.col("text"))).alias("b")).collect()
    assert all(len(r.a) == len(r.b) for r in rows) and rows[1].a == []


def test_edge_rows(docs, spark):
    df = docs((None, ITEM), (1, None), (2, ""), (3, ITEM), (3, ITEM), (4, "12 " * 50_000))
    items = spark.createDataFrame([(None, ITEM), (1, ITEM), (1, ITEM), (2, None), (3, "too short"), (4, "1 2 3 4 5 6 7 8")],
                                  "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.coverage) for r in D.leaks(df, items).collect()] == [(3, 1, 1.0)]
    kept = D.drop_leaked(df, items)
    assert kept.columns == df.columns and kept.count() == 4
    assert D.leaks(df.where("false"), items).count() == 0 and D.leaks(df, items.where("false")).count() == 0


def test_shuffled_when_large(docs, spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert D.leaks(docs((1, ITEM), (2, CLEAN)), bench(spark, ITEM)).count() == 1


def test_plans_hold_no_python(docs, spark):
    plan = D.leaks(docs((1, ITEM)), bench(spark, ITEM))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_a_long_word_is_read_once(docs, spark):
    rows = docs((1, f"{'x' * 400_000} {ITEM}"), (2, "ab1c2 1.5xy 3:4z9 a.5 7km é\u03018x x٣y 12,5,x"))
    began = time.time()
    assert [r.doc_id for r in D.leaks(rows, bench(spark, ITEM)).collect()] == [1]
    assert time.time() - began < 60  # the square of its length takes minutes
    wide = "\\p{N}+(?:[.,:/]\\p{N}+)+|[\\p{L}\\p{M}\\p{N}]*\\p{N}[\\p{L}\\p{M}\\p{N}]*"
    got = rows.where("doc_id = 2").select(F.regexp_replace("text", D.NUMBERS, "#"), F.regexp_replace("text", wide, "#")).first()
    assert got[0] == got[1]
