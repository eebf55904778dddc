"""Language models on small texts, against a direct reading of the formula, and held-out accuracy."""

import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from girder.llm import language_id as li

LANGUAGES = {"aa": ["taka", "tika", "kata", "mika", "tamak"], "bb": ["stroum", "blosch", "grund", "schlo", "burrs"], "cc": ["ùlé", "élàn", "méù", "àlé"]}


def direct(words, order):
    """Interpolated Kneser-Ney by dictionaries: p(symbol, context)."""
    grams = [defaultdict(float) for _ in range(order + 1)]
    left = [defaultdict(set) for _ in range(order + 1)]
    for w, n in words.items():
        padded = f" {w} "
        for end in range(1, len(padded)):
            for k in range(1, order + 1):
                if end - k + 1 < 0:
                    continue
                g = padded[end - k + 1 : end + 1]
                if k == order or end - k + 1 == 0:
                    grams[k][g] += n
                else:
                    left[k][g].add(padded[end - k])
    for k in range(1, order):
        for g, kinds in left[k].items():
            grams[k][g] += len(kinds)
    return grams


def test_probabilities_follow_the_formula():
    counts = {k: {w: i + 1 for i, w in enumerate(ws)} for k, ws in LANGUAGES.items()}
    model = li.Model.fit(counts)
    column = model.languages.index("aa")
    grams = direct(counts["aa"], li.ORDER)
    padded, total = " tikak ", 0.0
    for end in range(1, len(padded)):
        p = model.floor
        for k in range(1, li.ORDER + 1):
            if end - k + 1 < 0:
                break
            ctx = padded[end - k + 1 : end]
            mine = {g: c for g, c in grams[k].items() if g[:-1] == ctx}
            if not mine:
                continue
            ones, twos = (sum(c == x for c in grams[k].values()) for x in (1, 2))
            d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
            s = sum(mine.values())
            p = max(mine.get(padded[end - k + 1 : end + 1], 0) - d, 0) / s + min(1.0, d * len(mine) / s) * p
        total += math.log(p)
    assert np.isclose(model.score_words(["tikak"])[0, column], total, rtol=1e-4)


def test_held_out_accuracy_and_odd_texts(spark, frame):
    dice = random.Random(1)
    rows = [(i, " ".join(dice.choice(LANGUAGES[k]) for _ in range(30)), k, "s", 1, "x") for i, k in enumerate(list(LANGUAGES) * 60)]
    docs = spark.createDataFrame(rows, frame([]).schema)
    model = li.fit(docs, F.col("doc_id") % 5 != 2)
    odd = spark.createDataFrame([(1000, None, None, "s", 1, "x"), (1001, "", "aa", "s", 1, "x"), (1002, "12 !!", "aa", "s", 1, "x"), (1003, "日本語の文章です" * 20, "aa", "s", 1, "x"), (1004, "taka " * 20000, "aa", "s", 1, "x")], docs.schema)
    got = {r.doc_id: r for r in li.predict(docs.unionByName(odd), model).collect()}
    assert all(got[i].lang_pred == k and not got[i].rejected for i, _, k, *_ in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1000, 1001, 1002))
    assert got[1003].rejected and not got[1004].rejected and got[1004].lang_pred == "aa"
    kept = {r.doc_id for r in li.keep_known(docs.unionByName(odd), model).collect()}
    assert kept == {r[0] for r in rows} | {1004}


def test_nothing_to_learn_from(frame):
    docs = frame([(1, "word"), (2, None)])
    assert li.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)) is None
    assert {r.lang_pred for r in li.predict(docs, None).collect()} == {"und"}
