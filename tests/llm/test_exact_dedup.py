"""Exact deduplication against a dictionary."""

import hashlib
import re

from pyspark.sql import functions as F

from girder.llm import exact_dedup

ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (7, " "), (8, "é\n\nx"), (4, "é x"), (6, "A b"), (10, "a b" * 5000), (11, "a b" * 5000)]


def expected(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    out = set()
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        out.add((i, min(same), len(same), i == min(same), hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_groups(frame):
    assert {tuple(r) for r in exact_dedup.exact_dedup(frame(ROWS)).collect()} == expected(ROWS)


def test_contents_are_compared_where_digests_clash(frame):
    got = exact_dedup.exact_dedup(frame(ROWS), digest=lambda c: F.length(c).cast("string"))
    assert {tuple(r) for r in got.collect()} == expected(ROWS)


def test_empty_table_and_null_ids(frame):
    assert exact_dedup.exact_dedup(frame([])).count() == 0
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(frame([(None, "x"), (4, "x"), (None, "y")])).collect()}
    assert got == {(None, 4, False), (4, 4, True), (None, None, True)}


def test_stage_keeps_one_row_of_each_text(frame):
    assert {r.doc_id for r in exact_dedup.drop_exact(frame(ROWS)).collect()} == {r[0] for r in expected(ROWS) if r[3]}
    repeated = frame([(1, "x"), (1, "x"), (1, "y"), (2, "y"), (None, "z")])
    assert sorted((str(r.doc_id), r.text) for r in exact_dedup.drop_exact(repeated).collect()) == [("1", "x"), ("1", "y"), ("None", "z")]
    assert exact_dedup.drop_exact(repeated).columns == repeated.columns


def test_stages_bear_columns_with_the_names_that_they_use_themselves(spark, frame):
    from girder.llm import jaccard_trees, language_id, suffix_dedup

    names = ["keep_id", "component_id", "node", "label", "removed", "row", "id", "version", "mark", "first", "text_sha256"]
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(k, t, "en", *[f"{n}{k}" for n in names]) for k, t in enumerate([long, long, long + " more", "short text"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    for stage, kept in ((exact_dedup.drop_exact, {0, 2, 3}), (jaccard_trees.drop_near, {0, 3}), (suffix_dedup.drop_repeats, {0, 1, 2, 3})):
        out = stage(docs)
        assert out.columns == docs.columns
        assert {(r.doc_id, r.keep_id, r.row) for r in out.collect()} == {(k, f"keep_id{k}", f"row{k}") for k in kept}
    model = language_id.fit(docs, docs.doc_id >= 0)
    assert language_id.keep_known(docs, model).columns == docs.columns
