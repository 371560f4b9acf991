"""Lexical search, conversation repair and word BPE against brute force on small tables with awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessellex.llm import automaton, conversation, lexical, queries

SF = "/root/testdata/sf0.001"
RULES = automaton.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain_scores(items, docs, k):
    """Every document's score for every item, without any index."""
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    lists = [(i, find(fold(t))) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in lists), sum(len(w) for _, w in lists)
    df = {}
    for _, words in lists:
        for t in set(words):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(find(fold(t)))
    out = []
    for item, words in asked.items():
        scored = []
        for doc, held in lists:
            if held:
                m = 50 + (50 * len(held) * n_docs) // total
                tf = {t: held.count(t) for t in words & set(held)}
                w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in tf}
                scored.append((-sum(w[t] * ((10**9 * f) // (1000 * f + 20 * m)) for t, f in tf.items()), doc is not None, doc or 0, doc))
        best = sorted(s for s in scored if s[0] < 0)[:k]
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(best, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("documents, item_bytes", [(4096, 1 << 24), (7, 900)])
def test_search_like_scores_of_all_documents(spark, monkeypatch, documents, item_bytes):
    monkeypatch.setattr(lexical, "DOCUMENTS", documents)
    rng = random.Random(1)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}É" if rng.random() < 0.9 else "The"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    docs += [(i, docs[3][1]) for i in range(200, 260)] + [(None, docs[3][1]), (3, docs[3][1]), (300, None), (301, ""), (302, "\x00 -- {}")]
    docs.append((303, " ".join(word() for _ in range(20000))))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(9)] + [(9, None), (10, "..."), (11, "nowhere"), (12, docs[3][1]), (2, "THE w1É"), (None, "the")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"n": F.lit("x"), "terms": F.lit(1), "score": F.lit(2)}).repartition(3)
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumns({"item": F.lit("x"), "id": F.lit(1)})
    for k in (50, 4):
        got = lexical.search(q, d, k=k, item_bytes=item_bytes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == plain_scores(items, docs, k)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, item_id bigint, text string")
    some = spark.createDataFrame([(1, 1, "a b"), (2, 2, "...")], "doc_id bigint, item_id bigint, text string")
    blank = some.where("doc_id = 2")
    assert lexical.search(none, some).count() == lexical.search(some, none).count() == lexical.search(some, blank).count() == 0


def test_interval_reading_stops_early():
    """Scores of the lists read in part are whole, and a list isn't read below what can still matter."""
    rng = np.random.default_rng(2)
    lists = []
    for scale in (10**6, 10**5, 10**3):
        docs = rng.permutation(5000)[:3000]
        lists.append((docs, np.sort(rng.integers(1, scale, 3000))[::-1].copy()))
    total = np.zeros(5000, np.int64)
    for docs, x in lists:
        total[docs] += x
    docs, scores = lexical.settle(lists, 5000, 10, 0)
    order = np.lexsort((np.arange(5000), -total))[:10]
    assert docs.tolist() == order.tolist() and scores.tolist() == total[order].tolist()
    assert len(lexical.settle(lists, 5000, 10, int(total.max()) + 1)[0]) == 0


# Conversations


def plain_damage(rows):
    out, known = [], set()
    for conv, turn, role, text in rows:
        known.add(conv)
        name = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * ({0: 0, 3: 2}.get(fault, 1))
    return known, out


def plain_summary(known, rows):
    """Dynamic programming over whole strings of initials."""
    out = []
    for conv in known:
        here = [r[1:] for r in rows if r[0] == conv]
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in here:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        # reached[state] = least (cost, audit, messages); a state is what the repaired roles end with
        step = {"": "user", "s": "user", "u": "assistant", "a": "user"}

        def inserted(reached):
            for _ in range(3):
                for state, (cost, audit, said) in list(reached.items()):
                    role = step[state]
                    new = (cost + 5, audit + "I", [*said, f"{role}:"])
                    if role[0] not in reached or new[:2] < reached[role[0]][:2]:
                        reached[role[0]] = new
            return reached

        reached = inserted({"": (0, "", [])})
        for (_, role, text), fault in zip(here, faults):
            after = {}

            def offer(state, cost, audit, said, after=after):
                if state not in after or (cost, audit) < after[state][:2]:
                    after[state] = (cost, audit, said)

            for state, (cost, audit, said) in reached.items():
                offer(state, cost + 2, audit + "D", said)
                if fault in ("blank", "duplicate"):
                    continue
                extra = 5 if fault else 0
                offer(step[state][0], cost + 1 + extra, audit + "R", [*said, f"{step[state]}:{text}"])
                if role[:1] in ("u", "a") and step[state][0] == role[0] or state == "" and role[:1] == "s":
                    offer(role[0], cost + extra, audit + "K", [*said, f"{role}:{text}"])
            reached = inserted(after)
        cost, audit, said = min(reached[s] for s in ("", "a") if s in reached)
        turns = {r[0] for r in here if r[0] is not None}
        initials = [r[1][:1] for r in here]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


CONV = "conv_id bigint, turn bigint, role string, text string"


def conversations():
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "user", "assistant"]
    texts = ["Yes.", "No!", "why", " \t", "", None, "a.b", "So \n.\x0b", "Long " * 2000 + ".", "half", "\xa0", "Done."]
    rows = []
    for conv in [*range(60), None]:
        plain = rng.random() < 0.5
        for turn in range(rng.randrange(1, 14)):
            role = ("user", "assistant")[turn % 2] if plain else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn + 3, None, 2**60 + turn]), role, rng.choice(texts) if not plain else f"Line {rng.randrange(9)}."))
    rows += rows[5:9]
    rows += [(500, t if t % 7 else None, roles[rng.randrange(10)], rng.choice([*texts, *(f"{i}." for i in range(900))])) for t in range(700)]
    return rows


@pytest.mark.parametrize("block", [64, 3, 2])
def test_repair_like_dynamic_programming(spark, block):
    rows = conversations()
    df = spark.createDataFrame(rows, CONV).withColumns({"cost": F.lit("x"), "gone_": F.lit(1), "_conv": F.lit(2)}).repartition(5)
    got = conversation.summarise(conversation.damage(df), block=block)
    known, damaged = plain_damage(rows)
    assert sorted(map(tuple, got.collect()), key=str) == plain_summary(known, damaged)


def test_repair_gives_the_messages(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "user", "Again?"), (2, None, "tool", "x"), (3, 1, "assistant", "A.")]
    df = spark.createDataFrame(rows, CONV)
    got = sorted(map(tuple, conversation.repair(df).collect()))
    assert got == [(1, 1, "K", "user", "Hi."), (1, 2, "R", "assistant", "Again?")]
    summary = {r["conv_id"]: (r["cost"], r["audit"]) for r in conversation.summarise(df).collect()}
    assert summary == {1: (3, "KDR"), 2: (2, "D"), 3: (2, "D")}
    assert sorted(map(tuple, conversation.repair(df, block=2).collect())) == got
    with pytest.raises(ValueError):
        conversation.repair(df, block=1)


def test_repair_of_empty_tables(spark):
    none = spark.createDataFrame([], CONV)
    assert conversation.summarise(conversation.damage(none)).count() == conversation.repair(none).count() == 0
    gone = spark.createDataFrame([(4, 1, "user", "a", True)], CONV + ", gone boolean")
    assert [tuple(r) for r in conversation.summarise(gone).collect()] == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_auction_prices_prove_the_least_cost():
    rng = random.Random(3)
    for _ in range(300):
        marks = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(0, 12)))
        lattice = conversation._rows_lattice(marks, {0, 1, 2, 3}, True)
        prices = [0.0] * len(lattice)
        cost = conversation.auction(lattice, 0, len(lattice) - 1, prices)
        assert all(prices[i] <= c + prices[to] for i, arcs in enumerate(lattice) for c, _, to in arcs)
        best = {0: 0}
        for _ in lattice:
            for i, arcs in enumerate(lattice):
                for c, _, to in arcs:
                    if i in best:
                        best[to] = min(best.get(to, 10**9), best[i] + c)
        assert cost == best[len(lattice) - 1]


# Word BPE


def test_automaton_like_the_library(spark):
    rng = random.Random(9)
    parts = [*"abcdeinthsonrg'’sStdmll12 \n\tİΣéÉ½ñ漢字\U0001f600\x00\x85-<|>", "<|endoftext|>", "<|startoftext|>", " ", "the", "ing", "é", " "]
    texts = [None, "", "  ", "a" * 70000, "na" * 999, "x" * 200 + "!"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000)]
    rows = [(i % 2900, t) for i, t in enumerate(texts)] + [(None, "Nobody's")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"ids": F.lit("x"), "decoded": F.lit(1), "n_tokens": F.lit(2)}).repartition(3)
    got = automaton.decode(automaton.encode(df, RULES), RULES).collect()
    expected = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), np.array(ids, "<u4").tobytes(), LIBRARY.decode(ids, skip_special_tokens=False)))
    key = lambda r: str((r[0], bytes(r[2])))
    assert sorted(((r[0], r[1], bytes(r[2]), r[3]) for r in got), key=key) == sorted(expected, key=key)
    assert automaton.encode(df.limit(0), RULES).count() == 0


def test_automaton_accepts_only_what_the_merges_give():
    """All short texts over two letters, merges among them: one accepted sequence each, that of merging by rank."""
    merges = [("a", "a"), ("b", "a"), ("aa", "b"), ("a", "b"), ("ba", "ba"), ("aa", "aa"), ("ab", "ab")]
    names = ["a", "b"] + [u + v for u, v in merges]
    number = {t: i for i, t in enumerate(names)}
    made = automaton.Automaton(2, [(number[u], number[v], number[u + v]) for u, v in merges])
    rank = {m: r for r, m in enumerate(merges)}
    for size in range(1, 10):
        for letters in itertools.product("ab", repeat=size):
            parts = list(letters)
            while pairs := [(rank[p], i) for i, p in enumerate(itertools.pairwise(parts)) if p in rank]:
                _, i = min(pairs)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            text, accepted = "".join(letters), []

            def walk(at, path, text=text, accepted=accepted):
                if at == len(text):
                    accepted.append([names[t] for t in path])
                for t, name in enumerate(names):
                    if made.read[t] and text.startswith(name, at) and (not path or made.has_arc(path[-1], t)):
                        walk(at + len(name), [*path, t])

            walk(0, [])
            assert accepted == [parts]


def test_automaton_gives_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_word_bpe"](spark, SF).collect()}
    for d in docs:
        ids = LIBRARY.encode(d["text"] or "", add_special_tokens=False).ids
        assert got[d["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d["doc_id"]]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
