"""The pipeline's stages on a small table, and the registered queries."""

import random

import __spark_entry__ as entry
import corpus_pipeline


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_trees", "suffix_dedup", "curve_packing"]


def test_stages(spark, tmp_path):
    dice = random.Random(4)
    words = ["".join(dice.choice("abcdefgh") for _ in range(dice.randrange(2, 7))) for _ in range(400)]
    rows = [(i, " ".join(dice.choice(words) for _ in range(120)), "en", "s", 1) for i in range(60)]
    passage = " ".join(dice.choice(words) for _ in range(60))
    rows[10] = (10, rows[10][1] + " " + passage, "en", "s", 1)
    rows[20] = (20, passage + " " + rows[20][1], "en", "s", 1)
    rows += [(100, rows[3][1].replace(" ", "  "), "en", "s", 1), (101, rows[4][1] + " more", "en", "s", 1), (102, "12 34", None, "s", 1), (103, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in docs.collect()})
    clean = set(range(60))
    assert kept[0] == clean | {100, 101} and kept[1] == clean | {101} and kept[2] == clean == kept[3]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert passage in texts[10] and passage not in texts[20] and texts[20].endswith(rows[20][1][-300:]) and texts[30] == rows[30][1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == clean
    # the whole run gives what the stages give one by one, and what is made from it outlives other queries
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "length")
    other = entry.queries()["op4_exact_dedup"](spark, str(tmp_path)).select("doc_id", "kept")
    assert sorted(map(tuple, whole.collect())) == sorted((r.doc_id, r.length) for r in packed.collect())
    assert whole.join(other, "doc_id").where("kept").count() == whole.count()
