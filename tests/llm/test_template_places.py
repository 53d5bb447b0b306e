"""Windows of the template that hold a slot."""

import random

from pyspark.sql import functions as F

from tarmetric.llm import decontaminate as D


def test_windows_from_slots_are_all_windows_with_slots(spark):
    rng = random.Random(4)
    words = ["the", "of", "Anna", "Berlin", "12", "1,000", "km", "runs", "x", "Éva", "."]
    texts = [None, "", "Anna", "12 km", "runs to Berlin", *[" ".join(rng.choice(words[: rng.choice([2, 5, 11])]) for _ in range(rng.randint(1, 40))) for _ in range(200)]]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    both = df.select(
        F.array_sort(D.word_sequences(F.col("text"), lambda s: D.template_places(s, 1))).alias("want"),
        F.array_sort(D.word_sequences(F.col("text"), D.slot_places, values=False)).alias("got"),
    ).collect()
    assert all(r.want == r.got for r in both) and sum(len(r.got) for r in both) > 500


def test_the_pass_over_documents_makes_no_slot_values(spark):
    docs = spark.createDataFrame([(1, "Anna ran 5 km to Berlin today")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Eva ran 7 km to Bonn today")], "item_id long, text string")
    plan = D.document_hashes(docs, D.item_windows(items))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(") == 1
