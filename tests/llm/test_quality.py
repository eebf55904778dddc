"""The quality model: held-out accuracy, slopes against differences, odd inputs."""

import random

import numpy as np

from girder.llm import quality


def test_held_out_accuracy_and_odd_texts(spark, frame):
    dice = random.Random(2)
    words = ["river", "stone", "garden", "light", "winter", "paper"]

    def good():
        return " ".join(dice.choice(words) + dice.choice(["", "", ".", ","]) for _ in range(dice.randrange(20, 300)))

    def bad():
        return good() + " " + " ".join(dice.choice(words).upper() + "!!###" for _ in range(150))

    rows = [(i, good() if i % 2 else bad()) for i in range(160)]
    docs = frame(rows + [(500, None), (501, ""), (502, "x" * 100000)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(3, None, 0), (None, 1, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.predict(docs, model).collect()}
    assert len(got) == 163 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert np.mean([got[i].predicted == i % 2 for i in range(100, 160)]) > 0.95


def test_one_class_or_none(spark, frame):
    docs = frame([(1, "a"), (2, "b")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.predict(docs, quality.fit(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.predict(docs, quality.fit(docs, ones)).collect()} == {1.0}
    assert quality.predict(frame([]), quality.fit(docs, ones)).count() == 0
