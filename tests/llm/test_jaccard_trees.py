"""The Jaccard join against all pairs."""

import random
import re

import pytest

from girder.llm import jaccard_trees as jt


def brute(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and den * both >= num * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {(i, len(sets[i]), label[i]) for i in sets}


def corpus(seed):
    dice = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "the"]
    rows, n = [], 0
    for _ in range(25):
        base = [dice.choice(vocabulary) for _ in range(dice.choice([1, 2, 3, 5, 12, 40, 150]))]
        for _ in range(dice.randrange(1, 6)):
            near = list(base)
            for _ in range(dice.randrange(0, 3)):
                near[dice.randrange(len(near))] = dice.choice(vocabulary)
            if dice.random() < 0.3:
                near = near + near[: dice.randrange(1, 4)]
            rows.append((n, dice.choice([" ", "\n", "\t "]).join(near).title() if dice.random() < 0.2 else " ".join(near)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "w1 w2"), (n + 4, "W1  w2"), (n + 5, "x " * 3000)]


@pytest.mark.parametrize(("width", "num", "den", "parts"), [(3, 90, 100, 1), (5, 80, 100, 3), (2, 50, 100, 2)])
def test_components(frame, width, num, den, parts):
    rows = corpus(width)
    got = {tuple(r) for r in jt.jaccard_components(frame(rows), width, num, den, parts=parts).collect()}
    assert got == brute(rows, width, num, den)


def test_groups_cut_into_blocks(frame, monkeypatch):
    monkeypatch.setattr(jt, "BLOCK_SETS", 3)
    monkeypatch.setattr(jt, "CHUNK_SETS", 2)
    rows = corpus(11)
    assert {tuple(r) for r in jt.jaccard_components(frame(rows)).collect()} == brute(rows, 3, 90, 100)


def test_signatures_rule_out_only_what_cannot_be():
    """Every set of those that are connected is left with an outsider that it may be linked with; unlike sets are not."""
    import numpy as np

    dice = np.random.default_rng(1)
    base = np.unique(dice.integers(0, 2**64, 200, np.uint64))
    sets = [base, np.unique(np.r_[base[5:], base[:4]]), base[3:], np.unique(dice.integers(0, 2**64, 200, np.uint64))]
    rows = {"low": [1, 2, 3, 4], "side": [2] * 4, "n": [len(s) for s in sets], "known": [1, 1, 3, 4], "content": [jt.signature(s) for s in sets]}
    got = {tuple(sorted(p)) for p in jt._joined(rows, jt.Measure(3, 90, 100), [(2, 2)], False, False)}
    assert got == {(1, 3), (2, 3)}
    long = np.unique(dice.integers(0, 2**64, 9000, np.uint64))
    assert len(jt.signature(long)) == 512 and (jt._bits([jt.signature(long)]) != 0).all()
    small = jt._bits([jt.signature(base)])
    assert int(np.bitwise_count(small).sum()) * 2 == len(jt.signature(base))


def test_no_link_is_lost_by_ranges():
    dice = random.Random(2)
    measure = jt.Measure(3, 80, 100)
    import numpy as np

    for _ in range(300):
        n = dice.randrange(1, 120)
        a = {dice.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(dice.randrange(0, n // 8 + 2)):
            b.discard(next(iter(b))) if dice.random() < 0.5 and len(b) > 1 else b.add(dice.getrandbits(64))
        if measure.linked(len(a & b), len(a), len(b)):
            keys = [set(measure.keys(np.array(sorted(s), np.uint64)).tolist()) for s in (a, b)]
            assert keys[0] & keys[1]


def test_empty_table(frame):
    assert jt.jaccard_components(frame([])).count() == 0
    assert [tuple(r) for r in jt.jaccard_components(frame([(None, "a b c")])).collect()] == [(None, 1, None)]


def test_rows_without_id_and_repeated_ids(frame):
    long = " ".join(f"w{k}" for k in range(100))
    rows = [(None, long), (None, long), (7, long + " x"), (7, "quite another text"), (None, "alone here now"), (7, long + " x"), (3, "quite  another text")]
    got = sorted(jt.jaccard_components(frame(rows)).collect(), key=repr)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(None, 98, 7), (None, 98, 7), (7, 99, 7), (7, 99, 7), (7, 1, 3), (3, 1, 3), (None, 1, None)]))
    left = sorted((r.doc_id, r.text) for r in jt.drop_near(frame(rows), 3, 90, 100).collect() if r.doc_id is not None)
    assert left == [(3, "quite  another text"), (7, long + " x"), (7, long + " x")]


def test_large_groups(frame):
    """A group of many near copies of one text, and as many copies of another, are one component each."""
    dice = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base[:p] + [f"x{k}"] + base[p + 1 :])) for k in range(1500) for p in [dice.randrange(120)]]
    rows += [(k, "the same words in every one") for k in range(5000, 9000)]
    got = {tuple(r) for r in jt.jaccard_components(frame(rows)).collect()}
    assert got == brute(rows[:1], 3, 90, 100) | {(k, len({tuple(t.split()[i : i + 3]) for i in range(118)}), 0) for k, t in rows[1:1500]} | {(k, 4, 5000) for k in range(5000, 9000)}


def test_all_links(frame, monkeypatch):
    monkeypatch.setattr(jt, "BLOCK_SETS", 3)
    rows = corpus(3)
    links, members = jt.jaccard_links(frame(rows), 3, 70, 100)
    member = {r.doc_id: r for r in members.collect()}
    sets = {i: frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset() for i, t in rows for w in [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]}
    want = set()
    for i, s in sets.items():
        others = set()
        for j, t in sets.items():
            if s and t and s != t and 100 * len(s & t) >= 70 * len(s | t):
                others.add(member[j]["class"])
                want.add(tuple(sorted((member[i]["class"], member[j]["class"]))))
        assert member[i].n_links == len(others) and member[i].n_shingles == len(s)
    assert {tuple(r) for r in links.collect()} == want


def test_tasks_of_a_large_group_are_linear(spark, monkeypatch):
    """Sets that a chain of keys connects go to the buckets of their keys, not to all blocks; who shares a key meets."""
    monkeypatch.setattr(jt, "BLOCK_SETS", 8)
    size = {}
    for n in (64, 256):
        classes = spark.createDataFrame([(k, k, k, k, 1, 50) for k in range(n)], "low long, high long, id long, mark long, copies long, n long")
        active = spark.createDataFrame([(k, k, 0) for k in range(n)], "low long, known long, label long")
        keys = [(k, key) for k in range(n) for key in {k, (k + 1) % n}] + [(k, 1000) for k in range(20)]
        dealt = jt._in_groups(classes, active, spark.createDataFrame(keys, "low long, key long"), jt.Measure(3, 90, 100)).collect()
        tasks = {r.low: {(t.grp, t.task): t.side for t in r.tasks} for r in dealt}
        assert len(tasks) == len(dealt) == n
        size[n] = sum(len(r.tasks) for r in dealt)
        held = {}
        for low, key in keys:
            held.setdefault(key, []).append(low)
        for sets in held.values():
            for a in sets:
                for b in sets:
                    both = {(tasks[a][t], tasks[b][t]) for t in tasks[a].keys() & tasks[b].keys()}
                    assert a == b or both & {(2, 2), (0, 1), (1, 0)}
    assert size[256] < 5 * size[64]


def test_texts_are_cut_into_shingles_once(frame, monkeypatch):
    """However many parts the key space has; sets that are too many to be broadcast are dealt out by shuffle."""
    calls, real = [], jt._sets
    monkeypatch.setattr(jt, "_sets", lambda *args: calls.append(args) or real(*args))
    monkeypatch.setattr(jt, "FEW_TASKS", -1)
    rows = corpus(7)
    got = {tuple(r) for r in jt.jaccard_components(frame(rows), 5, 80, 100, parts=3).collect()}
    assert got == brute(rows, 5, 80, 100) and len(calls) == 1


def test_a_few_sets_do_not_deal_out_all_texts(frame, capsys):
    """Where few sets are to be joined, their texts are found by a broadcast."""
    source = jt._source(frame([(k, f"a b c {k}") for k in range(9)]), "doc_id", "text")
    dealt = jt._sets(source, jt.Measure(3, 90, 100), 1).selectExpr("id", "mark", "low", "high", "low AS known", "array(named_struct('grp', 1L, 'task', 'all', 'side', 2)) AS tasks")
    found = jt._tasks(source, dealt, jt.Measure(3, 90, 100), [(2, 2)])
    found.explain()
    assert "BroadcastHashJoin" in capsys.readouterr().out and found.count() == 0


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    from girder.llm import graph

    rounds, real = [], graph.keep
    monkeypatch.setattr(graph, "keep", lambda df, name: rounds.append(name) or real(df, name))
    nodes = list(range(200))
    random.Random(3).shuffle(nodes)
    edges = [*zip(nodes, nodes[1:], strict=False), (2000, 2001), (2002, 2002), (None, 5)]
    got = {(r.node, r.label) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 0) for k in nodes} | {(2000, 2000), (2001, 2000), (2002, 2002)}
    assert rounds.count("labels-heard") <= 8  # 58 if labels only pass along edges


def test_linked_sets_share_as_many_keys_as_they_tell():
    import numpy as np

    dice, more = random.Random(6), 0
    for num in (50, 80, 90):
        measure = jt.Measure(3, num, 100)
        for _ in range(300):
            n = int(2 ** dice.uniform(0, 9))
            a = {dice.getrandbits(64) for _ in range(n)}
            b = set(a)
            for _ in range(dice.randrange(0, n * (100 - num) // 100 + 2)):
                b.discard(next(iter(b))) if dice.random() < 0.5 and len(b) > 1 else b.add(dice.getrandbits(64))
            if measure.linked(len(a & b), len(a), len(b)):
                (one, least), (two, also) = (measure.keyed(np.array(sorted(s), np.uint64)) for s in (a, b))
                assert len(set(one.tolist()) & set(two.tolist())) >= max(least, also)
                more += least > 1
    assert more > 100


def test_sets_that_share_a_passage_only_are_not_joined(frame, monkeypatch):
    """Texts that have a tenth in common meet in keys, but in fewer than a link takes: no task holds them."""
    dealt, real = [], jt._tasks
    monkeypatch.setattr(jt, "_tasks", lambda source, sets, *args, **more: dealt.append(sets.count()) or real(source, sets, *args, **more))
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(500)) + " " + passage) for i in range(30)]
    rows += [(i, rows[i - 100][1] + " at the end") for i in range(100, 103)]
    got = {tuple(r) for r in jt.jaccard_components(frame(rows), 5, 80, 100, parts=3).collect()}
    assert got == brute(rows, 5, 80, 100) and dealt[0] <= 30 and sum(dealt[1:]) == 0


def test_sets_of_a_link_keep_a_common_key(spark):
    """However many keys a set leaves out, any two that share ``least`` keep one; the most common keys go."""
    dice = random.Random(8)
    keys = {low: {k for k in range(40) if dice.random() < (k + 5) / 50} for low in range(30)}
    classes = spark.createDataFrame([(low, 12) for low in keys], "low long, least long")
    met = jt.keep(spark.createDataFrame([(low, low, k) for low, own in keys.items() for k in own], "low long, known long, key long"), "met")
    left = {low: set() for low in keys}
    rows = jt._rarest(jt._enough(met, classes), classes).collect()
    for r in rows:
        left[r.low].add(r.key)
    assert all(left[a] & left[b] for a in keys for b in keys if a != b and len(keys[a] & keys[b]) >= 12)
    assert len(rows) < sum(map(len, keys.values())) - 30 * 8
