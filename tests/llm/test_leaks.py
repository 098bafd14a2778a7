"""What a leak is: placeholder-heavy items, changed slots, long and very short items."""

from filingrisk.llm import decontaminate


def leaks(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, asked).collect()}


def test_items_of_mostly_placeholders(spark):
    items = [
        "Compute 12 times 14 plus 3",
        "Convert 3 km 20 meters 5 cm 7 mm to 4 miles 6 yards 2 feet 9 inches",
        "Ask Anna Berta Carla Dora Emma Fritz Gustav Hanna Ida Jonas Karl Lena",
    ]
    texts = [f"Some words first. {item} and more" for item in items] + [items[1].replace("20", "21").replace("7 mm", "8 mm").replace("6", "5")]
    assert set(leaks(spark, texts, items)) == {(0, 0), (1, 1), (2, 2)}


def test_verbatim_windows_count_beside_a_changed_slot(spark):
    item = "Alice saw 4 birds and then 4 more birds flew over the barn while 4 dogs slept near it"
    text = item.replace("4 dogs", "5 dogs")
    row = leaks(spark, [text, "Robert saw 6 cats and then 9 more cats ran under the barn while 5 dogs slept near it"], [item])
    assert set(row) == {(0, 0)} and row[0, 0].n_found == 7 and row[0, 0].same_slots


def test_a_long_run_of_a_long_item(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    texts = [" ".join(["before", *words[100:180], "after"]), " ".join(["before", *words[200:219], "after"]), " ".join([*words[40:50], "x", *words[50:60]])]
    assert set(leaks(spark, texts, [" ".join(words)])) == {(0, 0)}


def test_items_below_the_window(spark):
    items = ["and", "How many", "How many eggs do 5 hens lay", "the 4 red 7"]
    texts = ["one and all ask how many", "And", "how many?", "say how many eggs do 9 hens lay here", "so the 4 red 7 it is", "so the 5 red 8 it is", "how many eggs"]
    assert set(leaks(spark, texts, items)) == {(1, 0), (2, 1), (3, 2), (4, 3)}
