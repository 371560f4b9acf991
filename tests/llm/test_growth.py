"""What must not grow with the square of a group, or with the rows of a batch."""

import random

from tessellex.llm import jaccard_join


def near_copies(spark, n):
    """Copies of one text of 150 words with 1 to 3 words changed, those with the end ids with the most, and one unchanged."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        text = list(words)
        changes = 0 if i == n // 2 else 3 if i < n // 4 or i > n - n // 4 else rng.randint(1, 3)
        for at in rng.sample(range(0, 150, 6), changes):
            text[at] = f"x{i}_{at}"
        rows.append((i, " ".join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_force(rows, k, percent):
    sets = {r.doc_id: {tuple(w[i : i + k]) for w in [r.text.split()] for i in range(len(w) - k + 1)} for r in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_near_copies_are_joined_by_their_hub_before_all_pairs(spark, monkeypatch):
    docs = near_copies(spark, 120)
    compared = []
    verified = jaccard_join._verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    found = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(docs, k=5, percent=80).collect()}
    assert found == brute_force(docs.collect(), 5, 80)
    assert len(set(found.values())) == 1
    assert compared[1] < 120


def test_texts_become_words_by_size_and_not_by_batch():
    import pyarrow as pa

    from tessellex.llm import suffix_tree

    texts = [b"a" * n for n in (400_000, 400_000, 400_000, 3_000_000, 0, 5)] + [b"b"] * 600
    frames = list(suffix_tree._slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["_text"])])))
    assert [t for f in frames for t in f["_text"]] == texts
    assert [len(f) for f in frames] == [2, 1, 1, 250, 250, 102]


def test_only_keys_that_documents_share_are_dealt_out(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))) for i in range(150)]
    rows += [(150 + i, rows[i][1] + f" x{i} y{i}") for i in range(5)] + [(None, rows[0][1]), (160, None), (160, None), (161, rows[9][1]), (161, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, made = [], []
    join_groups, index = jaccard_join.join_groups, jaccard_join._index
    monkeypatch.setattr(jaccard_join, "join_groups", lambda rows, *rest: dealt.append(rows.count() if "key" in rows.columns else 0) or join_groups(rows, *rest))
    monkeypatch.setattr(jaccard_join, "_index", lambda *a: made.append((out := index(*a)).count()) or out)
    kept = jaccard_join.keep_one(docs, k=5, percent=80)
    assert max(dealt) < made[0] / 5
    tree = kept._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("Union") < tree.index("Join LeftAnti")  # rows whose id nobody asked for pass beside the join
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted([(False, i) for i in range(150)] + [(False, 160)] * 2 + [(True, 0)])


def test_unlike_long_sets_are_told_apart_by_their_parity_bits():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (2_400, 4_500, 6_000, 9_000, 20_000):
        both = rng.integers(0, 1 << 63, n // 2, np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n - n // 2, np.uint64)])) for _ in "ab")
        apart = jaccard_join.least_difference(jaccard_join.wide_parity(x), jaccard_join.wide_parity(y))
        assert (len(x) + len(y)) * 20 < apart * 180 and apart <= 2 * (n - n // 2)
