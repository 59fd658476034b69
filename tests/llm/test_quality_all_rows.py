"""Training reads all rated documents, however many shards they take."""

import numpy as np

from gridloom.llm import quality


def test_every_rated_document_shapes_the_model(spark):
    words = ["fine", "poor", "vile"]
    texts = [(i, f"own{i} {words[i % 3]} " * 3, 2 - i % 3) for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in texts], "doc_id long, grade int")
    one, many = (quality.train_classifier(df, ratings, limit=n) for n in (1000, 40))
    of = quality.Features()
    for model in (one, many):
        assert all(model.weights[of.of_word(f"own{i}")[0]] != 0 for i in range(300))
        mean = [np.mean([sum(model.tails(v @ model.weights[f])) for f, v in (of(t) for _, t, g in texts if g == k)]) for k in range(3)]
        assert mean[0] < 0.7 < mean[1] < 1.3 < mean[2]
        assert 0 < model.reject_below < mean[2]
    again = quality.train_classifier(df.repartition(7), ratings, limit=40)
    assert (again.weights == many.weights).all() and again.reject_below == many.reject_below
    assert quality.rated_rows(df, ratings, 40).rdd.getNumPartitions() == 8  # whatever the session's number of shuffle partitions
