"""The operators against brute force on small tables with awkward rows."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessellex.llm import (
    bpe, components, exact_dedup, html_text, jaccard_join, language, mixing, queries, substrings, suffix_tree, toxicity, vector_dedup,
)
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string"
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randrange(900)}" for _ in range(70))
    long = " ".join(f"x{rng.randrange(5000)}" for _ in range(9000))
    texts = [None, "", " \n\t ", "one", "one two", "one two three four", "one two three four", "x" * 5000,
             passage, "before " + passage + " after", passage.replace("w1 ", "W1 "), long, long + " tail", "a  " * 40 + "it's 12"]
    rows = [(i, t, "en", None if i % 3 else "s", 1, "k") for i, t in enumerate(texts)] + [(8, passage, None, "s", None, None)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(2), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_like_tiktoken_with_small_chunks(awkward, spark):
    df, rows = awkward
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for chunk, overlap in ((50, 20), (1000, 100), (1 << 20, 10)):
        coded = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap), RANKS)
        got = sorted((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in coded.collect())
        assert got == sorted((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in rows)
    assert bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_substrings_like_brute_force(awkward, spark):
    df, rows = awkward
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            first[key] = min(first.get(key, i), i)
    expected = []
    for i, w in words:
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        expected.append((i, len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone)))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substrings.remove_repeats(df).collect()]
    assert sorted(got) == sorted(expected)
    assert substrings.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_jaccard_like_brute_force(awkward, spark, k, percent):
    rng = random.Random(3)
    base = [f"b{rng.randrange(400)}" for _ in range(120)]
    rows = [r[:2] for r in awkward[1]]
    for i in range(100, 160):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    part = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if sets[a] and a < b and 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((part[a], part[b]))
                part = {i: low if p == high else p for i, p in part.items()}
    found = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), k=k, percent=percent).collect()
    assert sorted(map(tuple, found)) == sorted((i, len(sets[i]), part[i]) for i, _ in rows)
    assert jaccard_join.similar_groups(empty(spark)).count() == 0


def test_exact_dedup(awkward, spark):
    df, rows = awkward
    for cells in (1 << 10, 8):  # with 8 cells all rows shuffle, and nothing changes
        got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df, cells=cells).collect()}
        same = {i: [j for j, u, *_ in rows if (u or "") == (t or "")] for i, t, *_ in rows}
        assert got == {(i, max(s), len(s), i == max(s)) for i, s in same.items()}
    assert exact_dedup.deduplicate(df).columns == df.columns
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_vectors_like_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 64))
    x = np.concatenate([base, base[:4] + rng.standard_normal((4, 64)) * 0.2, base[:3], np.repeat(base[:1], 40, 0) + rng.standard_normal((40, 64)) * 0.02])
    rows = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)]
    bad = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, rows[0][1], None), (904, [], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(len(x)) % 2
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    part = np.arange(len(x))
    for _ in range(len(x)):
        part = np.array([min(part[i], part[near[i]].min(initial=part[i])) for i in range(len(x))])
    got = {tuple(r) for r in vector_dedup.near_duplicates(df, block=16).collect()}
    expected = {(i, int(near[i].sum()), int(part[i]), bool(part[i] == i)) for i in range(len(x))}
    assert got == expected | {(i, 0, i, True) for i, *_ in bad}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(8)).collect()))
    assert found == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}


def test_mixing(awkward, spark):
    df, rows = awkward
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    counts = dict(map(tuple, mixing.mix(many, weights={"a": 3.0, "b": 1.0}).groupBy("source").count().collect()))
    assert abs(counts["a"] - 3000) < 250 and abs(counts["b"] - 1000) < 150
    big = mixing.mix(many.where("source = 'a'"), size=40.0).count()  # a rate of 40, in steps
    assert abs(big - 40_000) < 1000
    assert mixing.mix(df).columns == df.columns and mixing.mix(empty(spark)).count() == 0


def test_html():
    page = (
        '<html><head><title>t</title><script>x="<p>"</script></head><body><nav><a href=a>Menu</a></nav><header>Site</header>'
        '<article><header><h1>A &amp; B</h1><p>by me</p></header><p>First<br>line   here.<p><b>Second</b> one.</p>'
        '<form><input>Mail</form><div class="comments"><p>I like it very much indeed</p></div></article>'
        '<aside>Side</aside><div class="cookie-notice">We use cookies</div><footer>&copy; x</footer>'
    )
    assert html_text.main_text(page) == "A & B\nFirst line here.\nSecond one."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("plain &lt;text&gt;") == "plain <text>"


def test_html_keeps_every_article():
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    nav = "<nav><a href='/'>home</a></nav>"
    two = f"<article><p>{a}</p></article><article><p>{b}</p></article>"
    assert html_text.main_text(f"<body>{nav}<main>{two}</main></body>") == f"{a}\n{b}"
    assert html_text.main_text(f"<body>{nav}<main><p>{c}</p><article><p>{b}</p></article></main></body>") == f"{c}\n{b}"
    assert html_text.main_text(f"<body>{nav}{two}</body>") == f"{a}\n{b}"
    comment = "<article><p>a short comment on all of this</p></article>"
    assert html_text.main_text(f"<body>{nav}<main><article><p>{a}</p><p>{b}</p>{comment}</article></main></body>") == f"{a}\n{b}"
    assert html_text.main_text(f"<body><article><h1>{c[:29]}</h1><article><p>{a}</p><p>{b}</p></article></article></body>") == f"{c[:29]}\n{a}\n{b}"


def test_html_keeps_content_beside_the_root_and_in_wrappers():
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    nav = "<nav><a href='/'>home</a></nav>"
    big = f"<div><p>{a} {a}</p><p>{b} {b} {b}</p></div>"
    assert html_text.main_text(f"<body>{nav}<div>{big}<div><p>{c}</p></div></div></body>") == f"{a} {a}\n{b} {b} {b}\n{c}"
    story = f"<article><div class='post-header'><h1>Headline</h1></div><p>{a}</p><p>{b}</p></article>"
    side = "<div class='sidebar'><p>about us and more</p></div>"
    talk = f"<div class='comments'><article><p>{c}</p></article></div>"
    assert html_text.main_text(f"<body>{nav}<div class='layout has-sidebar'>{story}{side}</div>{talk}</body>") == f"Headline\n{a}\n{b}"
    plain = f"<div id='search-page'><p>{a}</p><p>{b}</p></div>"
    assert html_text.main_text(f"<body>{nav}{plain}{side}</body>") == f"{a}\n{b}"


def test_toxicity_finds_the_sentences(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrst"

    def text(bad):
        parts = [" ".join(rng.choice(letters) + rng.choice(letters) + "o" for _ in range(8)) for _ in range(5)]
        if bad:
            parts[rng.randrange(5)] += " " + rng.choice(["vile", "rotten"])
        return ". ".join(parts) + "."
    docs = [(i, text(i % 4 == 0)) for i in range(400)] + [(400, None), (401, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(401, None)], "doc_id bigint, toxic int")
    model = toxicity.train(df, labels)
    assert {"vile", "rotten"} == set(model["words"])
    for i, score, spans in toxicity.score(df, model).collect():
        assert (score >= 0.5) == (i < 400 and i % 4 == 0)
        assert all(dict(docs)[i][s["start"] : s["stop"]].rstrip(". ").split()[-1] in ("vile", "rotten") for s in spans)
    none = toxicity.train(df, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(df, none).collect()} == {0.0}


def test_language_labels_switches(spark):
    a = ["the house is on the hill with water", "this thing was there with others", "when they were here the wind blew"]
    b = ["das haus steht auf dem berg mit wasser", "dieses ding war dort mit anderen", "als sie hier waren wehte der wind"]
    rows = [(i, (a if i % 2 else b)[i % 3] + " " + (a if i % 2 else b)[(i + 1) % 3], "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "12 34", None), (102, a[0] + " " + a[1] + " " + b[0] + " " + b[1], None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {r["doc_id"]: r for r in language.identify(df, language.train(df)).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows if i < 60)
    assert found[100]["lang_pred"] == found[101]["lang_pred"] == "und" and found[101]["score"] == 0
    assert found[102]["switches"] >= 1


def test_language_learns_every_language(spark):
    rows = [(i, f"w{i}a w{i}b", f"l{i:03}") for i in range(260)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert language.train(df)["langs"] == [lang for _, _, lang in rows]


def test_forward_backward_sums_over_all_paths():
    rng = np.random.default_rng(0)
    scores, step = rng.standard_normal((1, 4, 3)), rng.standard_normal((3, 3))
    paths = np.array(np.meshgrid(*[range(3)] * 4, indexing="ij")).reshape(4, -1).T
    weight = np.exp([sum(scores[0, t, p[t]] for t in range(4)) + sum(step[p[t], p[t + 1]] for t in range(3)) for p in paths])
    exact = [[weight[paths[:, t] == y].sum() / weight.sum() for y in range(3)] for t in range(4)]
    assert np.allclose(language.forward_backward(scores, np.array([4]), step)[0], exact)


def test_suffix_tree_base_and_gain(spark):
    rows = [(i, "alpha beta gamma delta " + ("one" if i % 2 else "two"), "k") for i in range(60)] + [(60, None, "k"), (61, "zzz alpha", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, size string")
    out = {r["doc_id"]: r for r in suffix_tree.score(df, learn=F.col("doc_id") < 61).collect()}
    tokens, distinct = 60 * 5 + 61, 7
    assert out[0]["train_tokens"] == tokens and out[60]["n_tokens"] == 1 and out[61]["n_known"] == 2
    expected = np.log10([(n + 1) / (tokens + distinct + 1) for n in (0, 60, 61)]).sum()
    assert abs(out[61]["base_score"] - expected) < 1e-9
    assert out[0]["score"] > out[0]["base_score"] + 2
    none = suffix_tree.score(df, learn=F.lit(False)).collect()
    assert all(abs(r["score"]) < 1e-9 for r in none)


def test_suffix_tree_keeps_rare_contexts_of_large_corpora(spark, monkeypatch):
    rng = random.Random(4)
    phrases = [" ".join(f"p{i}x{j}" for j in range(4)) for i in range(40)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(5)), "k") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, size string")
    def scores():
        return {r["doc_id"]: r["score"] for r in suffix_tree.score(df, learn=F.col("doc_id") < 250).collect()}
    expected = scores()
    # shares of so many tokens that every count is below them, as the counts of most phrases are in a large corpus
    monkeypatch.setattr(suffix_tree, "P_MIN", 1.0)
    monkeypatch.setattr(suffix_tree, "P_WORD", 1.0)
    got = scores()
    assert all(abs(got[i] - x) < 1e-6 for i, x in expected.items())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_a_row_per_input(spark, name):
    table, key = {"op2_html_text": ("pages", "page_id"), "op4_vector_near_dedup": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    out = queries.QUERIES[name](spark, SF)
    assert key in out.columns
    if name != "op9_poisson_mix":
        assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_bpe_pieces_keep_two_generations():
    ranks = bpe._ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    pieces = bpe._Pieces(ranks, 3)
    for word in [" the", " qzxv", "é", " ab", " the", "x" * 70, "zzqj", " cd", " the", " ef", " qzxv"] * 3:
        assert pieces[word] == np.array(bpe.merge(word.encode(), ranks), "<u4").tobytes()
        assert len(pieces) <= 3 and len(pieces.older) <= 3


def test_suffix_tree_packs_hold_what_was_asked():
    rng = np.random.default_rng(3)
    arrays = [rng.integers(0, 1 << 63, n, np.uint64) for n in (0, 1, 1000)]
    assert all((a == b).all() for a, b in zip(arrays, suffix_tree.unsqueeze(suffix_tree.squeeze(arrays), 3)))
    pool = rng.integers(0, 1 << 64, 300, np.uint64)
    hashes, doc = rng.choice(pool, 5000), rng.integers(0, 40, 5000)
    have = pool[::2]
    values = rng.random(len(have))
    keys = np.arange(40, dtype=np.int64) - 7
    for shards in (1, 3, 16):
        pack = suffix_tree._Pack(shards)
        pack.add(keys[:20], keys[:20], [(doc[doc < 20], hashes[doc < 20], 1), (doc[:0], hashes[:0], 0)])
        pack.add(keys[20:], keys[20:], [(doc[doc >= 20] - 20, hashes[doc >= 20], 1), (doc[:0], hashes[:0], 0)])
        gain = np.zeros(40)
        for shard, packed in pack.rows()[["shard", "pack"]].itertuples(index=False):
            here = suffix_tree.shard_of(have.view(np.int64), shards) == shard // 2
            for r in suffix_tree._answers(packed, suffix_tree._sorted_table([(have[here], values[here])]), shard % 2 > 0).itertuples():
                gain[r.key + 7] += r.gain
        table = dict(zip(have.tolist(), values.tolist()))
        expected = np.bincount(doc, [table.get(h, 0.0) for h in hashes.tolist()], 40)
        assert np.allclose(gain, expected)


def test_suffix_tree_repeated_rows_empty_table_and_clashing_names(spark):
    text = " ".join(f"a{i} b{i} c{i}" for i in range(300))
    rows = [(1, text, "x", "y"), (1, text, "x", "y"), (1, "a1 b1", "x", "y"), (None, text, "x", "y"), (2, None, "x", "y"), (3, " a1  b1 c1\n", "x", "y")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string, shard string")
    out = [tuple(r) for r in suffix_tree.score(df, learn=F.lit(True)).collect()]
    assert len(out) == len(rows) and sorted(r[0] is None for r in out) == [False] * 10 + [True] * 2
    assert sorted(r[2] for r in out) == sorted([901] * 6 + [3] * 2 + [1] * 2 + [4] * 2)
    assert all(r[2] == r[3] for r in out)
    assert suffix_tree.score(df.limit(0), learn=F.lit(True)).count() == 0
