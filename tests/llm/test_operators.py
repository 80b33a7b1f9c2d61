"""Each operator against brute force, and on awkward and empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from awkward_documents import prose

from modelkeep.llm import op1_toxicity as tox
from modelkeep.llm import op2_topk as topk
from modelkeep.llm import op3_simhash as sim
from modelkeep.llm import op4_pii as pii
from modelkeep.llm import op5_decontaminate as dec
from modelkeep.llm import op6_urls as urls
from modelkeep.llm import op7_bpe as bpe
from modelkeep.llm import op8_substrings as sub
from modelkeep.llm import op9_quality as qual
from modelkeep.llm import op10_lm as lm
from modelkeep.llm import words as W
from modelkeep.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# ------------------------------------------------------------------ words
def test_words_like_regular_expressions():
    rows = ["", None, " a b ", "a", "Ab\tc\x0bé", "x" * 3000, "\n", "日本 語", "tail "]
    for limit in (1, 1 << 20):
        got, hashed = [], []
        for lo, hi, data, bounds in W.slices(pa.array(rows), limit):
            b, e, first = W.spans(data, bounds, W.NOT_SPACE)
            raw, h = data.tobytes(), W.hashes(data, b, e)
            for k in range(hi - lo):
                got.append([raw[x:y].decode() for x, y in zip(b[first[k]:first[k + 1]], e[first[k]:first[k + 1]])])
                hashed.append(h[first[k]:first[k + 1]].tolist())
        assert got == [WORD.findall(r or "") for r in rows]
        assert hashed[3] != hashed[5] and hashed[2][0] == hashed[3][0]
    h = np.arange(1, 40, dtype=np.uint64)
    assert len(W.windows(h, 20)) == 20 and len(W.windows(h, 50)) == 0
    assert W.starts(np.array([0, 3, 3, 5]), 2).tolist() == [True, True, False, True]


# --------------------------------------------------------------- toxicity
def read(symbols):
    state, out = 0, []
    for s in symbols:
        state, o = tox.MACHINE.arcs[state, s]
        out.append(o)
    return out


def test_machine_marks_negation_report_and_target():
    assert read("I") == ["I"]
    assert read("YoI") == ["Y", "o", "I!"]
    assert read("NoI") == ["N", "o", "I-"]
    assert read("NoooooI")[-1] == "I"
    assert read("RoYNI")[-1] == "I~-!"
    assert read("IoY") == ["I", "o", "YI!"]
    assert read("YT")[-1] == "T" and read("T") == ["T"] and read("oTY")[-1] == "YT!"
    assert read("NTY")[-1] == "YT-!" and read("RYTY")[-1] == "YT~!" and read("ToooooY")[-1] == "Y"
    assert read("YooooooI")[-1] == "I" and read("YIII") == ["Y", "I!", "I!", "I!"]


def test_machine_is_its_transducers_one_after_the_other():
    r = random.Random(4)
    parts = [tox._negation(), tox._reported(), tox._directed()]
    for _ in range(3000):
        symbols = [r.choice(tox.SYMBOLS) for _ in range(r.randint(1, 25))]
        stream = symbols
        for part in parts:
            state, out = 0, []
            for s in stream:
                state, o = part.step(state, s)
                out.append(o)
            stream = out
        assert read(symbols) == stream and set(stream) <= {*tox.OUTPUTS, *tox.SYMBOLS}


def brute_features(model, text):
    """The features clause by clause from their definitions, without the machine's search for clauses."""
    best, total, counts = 0.0, 0.0, Counter()
    for clause in re.split("[.!?;:\\n]", text.lower()):
        words = re.findall(r"[^\W_]+(?:['\u2019][^\W_]+)?", clause)
        weights = [model.grammar.weight(w) for w in words]
        symbols = ["I" if v > 0 else model.grammar.symbols.get(w, "o") for w, v in zip(words, weights)]
        if not {"I", "T"} & set(symbols):
            continue
        score, last, wrote = 0.0, 0.0, set()
        for o, v in zip(read(symbols), weights):
            if o in tox.OUTPUTS:
                wrote.add(o)
                score += {"I": v, "I!": 1.4 * v, "YI!": 0.4 * last, "YT!": tox.THREAT_WEIGHT}.get(o, 0.0)
            last = v or last
        best, total = max(best, score), total + score
        counts.update(wrote)
    return [best, math.log1p(total), *(math.log1p(counts[o]) for o in tox.OUTPUTS)]


def test_toxicity_scores_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = tox.fit(docs, labels, tox.training_rows())
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in tox.toxicity(docs, model).collect():
        z = sum(a * b for a, b in zip([*brute_features(model, texts[r["doc_id"]]), 1.0], model.weights))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9) and r["predicted"] == (r["score"] >= 0.5)
    again = tox.fit(docs.repartition(7), labels, tox.training_rows())
    assert again.grammar.stems == model.grammar.stems and np.allclose(again.weights, model.weights)


def test_clauses_not_words(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    models = [tox.fit(empty, labels, tox.training_rows())]
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    models.append(tox.fit(docs, labels, tox.training_rows()))
    for model in models:
        s = model.score
        assert s("you idiot") > s("the idiot") > s("what a fine day") and s("you are a worthless idiot") > s("the worthless idiot")
        assert min(s(t) for t in ("you idiot", "i will kill you", "we'll destroy them", "idiot, you")) >= 0.5
        for t in ("you are not an idiot", "not an idiot", "she said you are an idiot", "he told them about the kill switch", "i will not hurt you",
                  "he said he will kill you", "the kill switch", "they kill time"):
            assert s(t) < 0.5, t


def test_regression_is_free_in_sign_and_drawn_to_its_center():
    from modelkeep.llm.logistic import regression
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 3))
    y = (r.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * x[:, 1] - 1)))).astype(float)
    w = regression(x, y)
    assert abs(w[0] - 2) < 0.3 and abs(w[1] + 3) < 0.4 and abs(w[2]) < 0.2 and abs(w[3] + 1) < 0.2
    unseen = regression(np.column_stack([x[:, :2], np.zeros(4000)]), y, center=np.array([0.0, 0.0, 0.7, 0.0]))
    assert unseen[2] == pytest.approx(0.7)


def test_toxicity_held_out_and_awkward(spark, awkward, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = tox.fit(docs, labels, tox.training_rows())
    assert model.score("you are a worthless idiot.") > 0.5 > model.score("what a fine day.")
    assert model.score("the word idiot is not one i use of you") <= model.score("you idiot")
    rows = {(r["doc_id"]): r for r in tox.toxicity(docs, model).collect()}
    assert len(rows) == docs.count()
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = sum(rows[r["doc_id"]]["predicted"] == r["toxic"] for r in held)
    assert right >= 0.93 * len(held)
    got = tox.toxicity(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    assert [r["predicted"] for r in got if r["doc_id"] == 8] == [1]
    assert tox.toxicity(empty, model).count() == 0
    no_labels = spark.createDataFrame([(None, None), (1, None)], "doc_id long, toxic int")
    assert tox.fit(awkward, no_labels, tox.training_rows()).score("you idiot") > 0.5


# ------------------------------------------------------------------ top k
def test_top_k_brute_force_ties_nulls_and_repeats(spark):
    r = random.Random(5)
    rows = [(i, [round(r.uniform(-1, 1), 1) for _ in range(20)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]
    bad = [(500, None), (501, [None] * 20), (502, [float("nan")] * 20), (503, [float("inf")] * 20), (504, [])]
    odd = [(None, rows[0][1]), (None, [5.0] * 20), (40, [3.0] * 20), (7, [2.0] * 20)]
    good = rows + odd + rows[:40]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = Counter(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 20 == 0, k=7).collect())
    whole = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in good]
    want = Counter()
    for n, (q, own) in enumerate(whole):
        if q is not None and q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(own, v)), i is None, i or 0) for m, (i, v) in enumerate(whole) if m != n)[:7]
            want.update((q, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(best))
    assert got == want
    assert any(x[2] is None for x in got)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, F.col("vec_id") % 20 == 0).count() == 0
    few = topk.top_k(spark.createDataFrame(rows[:3], df.schema.fieldNames()[:2]), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    vast = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [1e-3, 1.0])], "vec_id long, embedding array<double>")
    assert [(x["vec_id"], x["score"]) for x in topk.top_k(vast, F.col("vec_id") == 0).orderBy("rank").collect()] == [
        (1, (1 << 63) - 1), (3, 4096), (2, -(1 << 63))]


def test_top_k_of_many_norms_blocks_and_lengths(spark, monkeypatch):
    for name, size in (("HEAD", 40), ("QUERIES", 8), ("CANDIDATES", 16), ("CELLS", 1), ("CHUNK", 8), ("BLOCK", 3)):
        monkeypatch.setattr(topk, name, size)
    grids, grid = [], topk.grid
    monkeypatch.setattr(topk, "grid", lambda *a: grids.append((a, grid(*a))) or grids[-1][1])
    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) * 10 ** r.uniform(-3, 1) for _ in range(r.choice([7, 7, 7, 4]))]) for i in range(900)]
    rows += [(900 + i, [0.0] * 7) for i in range(30)] + [(1000 + i, rows[0][1]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 20 == 0, k=6).collect())
    whole = [(i, [math.floor(64 * c) for c in v]) for i, v in rows]
    want = []
    for q, own in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q and len(v) == len(own))[:6]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    # The bound rules out some cells, and copies go only to the others.
    [((wanting, offered, _, _), places)] = grids
    blocks = {side: {(at, n, meets) for s, _, at, n, meets in places if s == side} for side in "ij"}
    cells = {side: {(block, other) for at, n, meets in blocks[side] for block in range(at, at + n) for other in range(meets)} for side in "ij"}
    assert cells["i"] == {(i, j) for j, i in cells["j"]}
    assert len(cells["i"]) < sum(n for _, n, _ in blocks["i"]) * sum(n for _, n, _ in blocks["j"]) and max(offered.values()) >= 30


def test_top_k_grid_meets_prefixes():
    places = topk.grid({-1: 3, 100: 5}, {50: 10, 100: 1, 120: 4}, 2, 4)
    # Queries: blocks 0-1 reach all, 2-4 band 100 and above; candidates: block 0 (120), 1 (100), 2-4 (50).
    assert sorted(places) == [("i", -1, 0, 2, 5), ("i", 100, 2, 3, 2), ("j", 50, 2, 3, 2), ("j", 100, 1, 1, 5), ("j", 120, 0, 1, 5)]
    # Neighbouring bands in one block: it needs the least and offers the most of them.
    assert sorted(topk.grid({-1: 1, 7: 1, 9: 1}, {5: 2, 6: 1, 8: 3}, 2, 3)) == [
        ("i", -1, 0, 1, 2), ("i", 7, 0, 1, 2), ("i", 9, 1, 1, 0), ("j", 5, 1, 1, 1), ("j", 6, 1, 1, 1), ("j", 8, 0, 1, 1)]
    assert topk.grid({}, {1: 2}, 1, 1) == [("j", 1, 0, 2, 0)] and topk.grid({1: 2}, {}, 1, 1) == [("i", 1, 0, 2, 0)]


def test_top_k_of_huge_components_is_exact():
    q = np.array([[1 << 30, 3]])
    v = np.array([[1 << 31, 1], [1 << 31, 2], [5, 5]])
    [(own, ids, scores)] = topk.search(np.array([9]), q, np.array([1, 2, 9]), v, 2)
    assert ids.tolist() == [2, 1] and scores == [(1 << 61) + 6, (1 << 61) + 3]


# ---------------------------------------------------------------- simhash
def brute_fingerprint(text):
    w = WORD.findall(lower(text))
    runs = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_brute_force(spark):
    docs = documents(spark)
    fp = {i: brute_fingerprint(t) for i, t in docs.items()}
    parent = {i: i for i in fp}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in fp:
        for j in fp:
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in sim.op3_simhash(spark, SF).collect()}
    assert got == {(i, f"{fp[i]:016x}", root(i)) for i in fp}


def test_links_join_every_close_pair_of_a_crowded_key(spark, monkeypatch):
    monkeypatch.setattr(sim, "PART", 16)
    r = random.Random(2)
    close = [0x123456789ABCDEF ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(200)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in close + [r.getrandbits(63) for _ in range(200)]})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {x["node"]: x["root"] for x in components(sim.links(df, 3)).collect()}
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 3:
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    assert all(roots.get(x, x) == root(x) for x in fps)


def test_simhash_awkward(spark, awkward, empty):
    got = sim.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[3][0]["fp"] == by[4][0]["fp"] == by[7][0]["fp"] == 0 and by[7][0]["component_id"] == 3
    assert by[2][0]["component_id"] == 1 and by[6][0]["component_id"] == 5
    assert {r["component_id"] for r in by[None]} == {None, 3}
    kept = sim.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 5, 8, 9, 10, 11] and ids.count(None) == 1
    assert {r["text"] for r in kept.where("doc_id = 5").collect()} == {"same words here again", "another text with the same id"}
    rows = [(1, "first text of all these words"), (1, "totally different words in the other one"), (2, "first text of all these words"), (3, "a third one"), (3, "a third one")]
    few = sim.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, few.collect())) == sorted({rows[0], rows[1], rows[3]})
    assert sim.near_duplicates(empty).count() == 0 and sim.one_of_each(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -------------------------------------------------------------------- pii
def brute_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_plain_identifiers_brute_force(spark):
    r = random.Random(4)
    parts = ["a", "@", "@", ".", ".", "1", "25", "300", "-", " ", "+", "(", ")", "4111", "1111", "x.y", "é", "one", " at ", " dot "]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 25)))
        base, every = pii.find(text)
        assert base == brute_spans(text) and set(base) <= set(every)
    docs = documents(spark)
    for x in pii.op4_pii(spark, SF).collect():
        base = brute_spans(docs[x["doc_id"]] or "")
        assert x["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert [x[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]


@pytest.mark.parametrize("text, kind, source", [
    ("write john dot doe at example dot com now", "email", "john dot doe at example dot com"),
    ("or bob [at] mail [dot] example [dot] org!", "email", "bob [at] mail [dot] example [dot] org"),
    ("x раураl@ехаmple.com x", "email", "раураl@ехаmple.com"),
    ("a\u200bb@ex\u200bample.com", "email", "a\u200bb@ex\u200bample.com"),
    ("call plus one five five five one two three four five six seven today", "phone", "plus one five five five one two three four five six seven"),
    ("ip one nine two dot one six eight dot one dot seven end", "ip", "one nine two dot one six eight dot one dot seven"),
    ("card ４１１１ 1111 1111 1111.", "card", "４１１１ 1111 1111 1111"),
    ("four" + " one" * 15 + ".", "card", "four" + " one" * 15)])
def test_disguised_identifiers_in_source_characters(text, kind, source):
    base, every = pii.find(text)
    assert not base and [(k, text[a:b]) for k, a, b in every] == [(kind, source)]
    assert pii.redact(text, every) == text.replace(source, f"[{kind.upper()}]")


def test_personal_data_awkward(spark, awkward, empty):
    assert pii.find("look at the dot and see, point by point")[1] == [] and pii.find("") == ([], [])
    got = pii.personal_data(awkward).collect()
    assert len(got) == awkward.count()
    [r] = [r for r in got if r["doc_id"] == 9]
    assert [s["kind"] for s in r["found"]] == ["email", "phone"]
    assert pii.personal_data(empty).count() == 0
    assert pii.redact("a@b.co c", [("email", 0, 6), ("phone", 3, 6)]) == "[EMAIL] c"
    for text in ("a" * 100_000, "1" * 100_000, "a@" * 50_000, "+1" * 50_000, "1." * 50_000, " dot " * 20_000):
        pii.find(text)


# ---------------------------------------------------------- contamination
def brute_contamination(docs, items, window=13):
    words = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if n and i is not None else ():
            wins.setdefault(tuple(w[s:s + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[tuple(w[s:s + n])]
        out.append((i, len(w), len(hit), sorted(map(str, found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_contamination_brute_force_and_awkward(spark, awkward, empty):
    bench = [(1, prose(1, 30_000)[:400]), (2, "same words here"), (3, "X"), (4, None), (5, ""), (6, "idiot! you worthless"), (10, "same words here"), (None, "who is this"),
             (7, prose(9, 40)), (7, prose(10, 13)), (8, "é 日本")]
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()] + [(20, prose(9, 20)), (21, "a " + prose(10, 13) + " b " * 300), (22, prose(9, 40).upper() + "!")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash"))
    items = spark.createDataFrame(bench, "item_id long, text string").withColumn("shingle", F.lit("clash"))
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in dec.contamination(df, items).collect()), key=repr)
    assert got == brute_contamination(docs, bench)
    kept = dec.uncontaminated(df, items)
    assert kept.columns == df.columns and kept.count() == sum(not r[-1] for r in got)
    assert dec.contamination(empty, items).count() == 0
    none = dec.contamination(df, items.where("item_id = 4")).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] for r in none)


def test_contamination_of_repeated_benchmark_rows(spark):
    bench = [(1, prose(3, 40)), (1, prose(3, 40)), (2, prose(4, 30) + " end"), (2, prose(4, 30) + " other"), (3, "few words"), (3, "few words"), (3, "few words")]
    docs = [(1, "a " + prose(3, 20)), (2, prose(4, 25)), (3, "some few words"), (4, prose(5, 30))]
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in dec.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()), key=repr)
    assert got == brute_contamination(docs, bench) and [r[-1] for r in got] == [True, True, True, False]


# ------------------------------------------------------------------- urls
def test_urls_rules_and_templates(spark):
    cases = [("http://a.com/x", "a.com", "/x", "com/", "allow"), ("https://EXAMPLE.com/en/1?q#f", "example.com", "/en/1", "example.com/en/", "block"),
             ("https://m.www.example.com/en/1", "m.www.example.com", "/en/1", "www.example.com/en/", "allow"), ("x://b.net/fr/9", "b.net", "/fr/9", "net/fr/", "block"),
             ("x://bnet/fr/9", "bnet", "/fr/9", None, None), ("http://a.com", "a.com", "", None, None), ("nothing", "", "", None, None), (None, "", "", None, None), ("http://c.org/d#a://b", "c.org", "/d", None, None)]
    rows = [(k, c[0]) for k, c in enumerate(cases)] + [(None, "http://a.com/")] + [(100 + k, f"http://s{k % 3}.bad.net/fr/{k}") for k in range(40)] + [
        (200 + k, f"http://t.bad.net/other/{k}") for k in range(5)] + [(0, cases[0][0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = urls.judge(pages).collect()
    assert len(got) == len(rows) and {r["verdict"] for r in got} <= {"allow", "block"}
    by = {r["page_id"]: r for r in got}
    for k, (_, host, path, rule, verdict) in enumerate(cases):
        assert (by[k]["host"], by[k]["path"], by[k]["rule"]) == (host, path, rule)
        assert verdict in (None, by[k]["verdict"])
    assert by[100]["template"] == "/fr/*" and 0 < by[100]["blocked"] < 1 and by[100]["blocked"] > by[0]["blocked"]
    assert urls.allowed(pages).columns == pages.columns
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_urls_similar_siblings_are_merged(spark):
    rows = [("h", "", "a", 1, 2), ("h", "", "b", 2, 4), ("h", "", "c", 0, 30), ("h", "", "d", 30, 30), ("h", "", "e", 0, 0), ("g", "", "a", 0, 2), ("g", "", "d", 2, 2), ("h", "/a", "z", 0, 2)]
    got = {(r["host"], r["node"], r["name"]): r["branch"] for r in urls.merged(spark.createDataFrame(rows, "host string, node string, name string, bad long, m long")).collect()}
    # Chi-square of g: 4 > 3.84, of the rest of h after d: 22 on 2 degrees.
    assert got == {("h", "", "a"): "a", ("h", "", "b"): "a", ("h", "", "c"): "c", ("h", "", "d"): "d", ("h", "", "e"): "e", ("g", "", "a"): "a", ("g", "", "d"): "d", ("h", "/a", "z"): "z"}


def test_urls_share_evidence_per_host_at_any_depth(spark):
    deep = "/a/b/c/d/e/f"
    rules = [("block", "x.org", f"{deep}/evil/one/"), ("allow", "x.org", f"{deep}/good/one/"), ("block", "m.org", "/p/red/one/"), ("block", "m.org", "/p/blue/one/"), ("allow", "m.org", "/p/green/one/")]
    paths = [("x.org", f"{deep}/{k}/{w}/y{i}") for k in ("evil", "good") for w in ("one", "two") for i in "abcdefgh"]
    paths += [("m.org", f"/p/{k}/one/{i}") for k, n in (("red", 2), ("blue", 2), ("green", 20)) for i in "abcdefghijklmnopqrst"[:n]]
    paths += [("u.example.org", f"/{w}/home") for w in {f"{x}{y}{z}" for x in "abcdef" for y in "ghijkl" for z in "mnopqr"}] + [("v.example.org", "/shop/home")] * 2
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(paths)], "page_id long, url string")
    got = {r["path"]: r for r in urls.judge(pages, rules=rules).collect()}
    assert got[f"{deep}/evil/one/ya"]["blocked"] > 0.5 > got[f"{deep}/good/one/ya"]["blocked"]
    assert got["/shop/home"]["template"] == "/shop/home" and got["/agm/home"]["template"] == "/*/home"
    # Red and blue agree: the paths they have in common are one branch.
    known = urls.templates(pages.select("page_id", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path")).withColumn(
        "verdict", urls.rule_of(F.col("host"), F.col("path"), rules)["verdict"]))
    branch = {r["path"]: r["branch"] for r in known.collect()}
    assert branch["/p/red/one/a"] == branch["/p/blue/one/a"] != branch["/p/green/one/a"]


def brute_branches(siblings):
    """{name: branch} of the siblings {name: (bad, m)} of one node."""
    def part(rates):
        b, n, free = sum(r[0] for r in rates), sum(r[1] for r in rates), max(1, len(rates) - 1)
        statistic = sum((x - m * b / n) ** 2 / m for x, m in rates)
        limit = free * (1 - 2 / (9 * free) + urls.DIFFERS * math.sqrt(2 / (9 * free))) ** 3
        if len(rates) < 2 or not 0 < b < n or statistic <= limit * (b / n) * (1 - b / n):
            return [rates]
        return part([r for r in rates if r[0] * n > b * r[1]]) + part([r for r in rates if r[0] * n <= b * r[1]])
    named = sorted(x for x in siblings if siblings[x][1])
    of = {}
    for rates in part([siblings[x] for x in named]) if named else []:
        same = [x for x in named if siblings[x] in rates]
        of.update(dict.fromkeys(same, min(same)))
    return {x: of.get(x, x) for x in siblings}


def brute_urls(rows, rules):
    """{(page_id, url): (host, path, rule, verdict, template, blocked)}"""
    def parse(url):
        rest = (url or "").partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host):])[0]

    def rule(host, path):
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=(None, "", ""))
        return best[0], best[1] + best[2] if fits else None

    def general(segment):
        bare = re.sub("\\.[A-Za-z0-9]{1,5}\\Z", "", segment)
        return "*" if re.search("\\A[0-9]+\\Z|\\A[0-9a-fA-F-]{16,}\\Z|[0-9]{3,}", bare) else bare or segment

    hosts, read = {}, {}
    for page, url in rows:
        host, path = parse(url)
        verdict, text = rule(host, path)
        key = tuple(general(s) for s in path.split("/") if s)
        read[page, url] = (host, path, text, verdict, key)
        n = hosts.setdefault(host, {}).setdefault(key, [0, 0, 0])
        for i, one in enumerate((True, verdict == "block", verdict is not None)):
            n[i] += one
    at = {}  # (host, key) -> template, branch

    def walk(host, keys, depth, template, branch):
        """``keys``, each with its template so far, have a branch in common."""
        for key in [k for k in keys if len(k) == depth]:
            at[host, key] = template[key], branch
        here = [k for k in keys if len(k) > depth]
        if not here:
            return
        if len({k[depth] for k in keys if len(k) > depth}) == 1 and len(here) == len(keys):
            own = here[0][depth]
            return walk(host, here, depth + 1, {k: template[k] + (own,) for k in here}, branch + (own,))
        total = sum(hosts[host][k][0] for k in here)
        size = Counter()
        for k in here:
            size[k[depth]] += hosts[host][k][0]
        name = {o: "*" if size[o] < urls.LEAST_SHARE * total else o for o in size}
        rates = {}
        for k in here:
            b, m = rates.get(name[k[depth]], (0, 0))
            rates[name[k[depth]]] = b + hosts[host][k][1], m + hosts[host][k][2]
        of = brute_branches(rates)
        for into in set(of.values()):
            some = [k for k in here if of[name[k[depth]]] == into]
            walk(host, some, depth + 1, {k: template[k] + (name[k[depth]],) for k in some}, branch + (into,))
    for host, keys in hosts.items():
        walk(host, list(keys), 0, dict.fromkeys(keys, ()), ())

    domain = lambda host: (re.findall("[^.]+\\.[^.]+\\Z", host) or [""])[0]
    over, within, branches = {}, {}, {}
    for host, keys in hosts.items():
        for key, (_, b, m) in keys.items():
            template, branch = at[host, key]
            for table, where in [*((over, template[:d]) for d in range(len(template) + 1)), (within, (domain(host), template)), (branches, (host, branch))]:
                old = table.get(where, (0, 0))
                table[where] = old[0] + b, old[1] + m
    smooth = lambda counts, p: (counts[0] + urls.PRIOR * p) / (counts[1] + urls.PRIOR)
    out = {}
    for row, (host, path, text, verdict, key) in read.items():
        template, branch = at[host, key]
        p = (over[()][0] + 1) / (over[()][1] + 2)
        for depth in range(1, len(template) + 1):
            p = smooth(over[template[:depth]], p)
        p = smooth(branches[host, branch], smooth(within[domain(host), template], p))
        out[row] = (host, path, text, verdict or ("block" if p > urls.THRESHOLD else "allow"), "/" + "/".join(template), p)
    return out


def same_urls(spark, rows, rules):
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge(pages, rules=rules).collect()
    want = brute_urls(rows, rules)
    assert len(got) == len(rows)
    for r, (page, url) in zip(sorted(got, key=lambda r: r["page_id"]), rows):
        assert tuple(r)[1:6] == want[page, url][:5], url
        assert r["blocked"] == pytest.approx(want[page, url][5], abs=1e-9)
    return want


def test_urls_brute_force_on_whole_pages(spark):
    rows = sorted((r["page_id"], r["url"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect())
    want = same_urls(spark, rows, urls.RULES)
    assert len({w[4] for w in want.values()}) > 3 and {w[3] for w in want.values()} == {"allow", "block"}


def test_urls_brute_force_on_forks_and_merged_branches(spark):
    rng = random.Random(6)
    names = ["ab", "cd.html", "ef", "gh", "x1", "2024", "deadbeefdeadbeef", "q.x", ".html"]
    rows = []
    for _ in range(1500):
        # A section's own share of blocked pages, so that some siblings agree and some don't.
        section = rng.choice(names)
        bad = rng.random() < {"ab": 0.1, "ef": 0.1, "gh": 0.9, "x1": 0.9}.get(section, 0.5)
        mark = "bad" if bad else rng.choice(["ok", "none"])
        path = "/".join(["", section, *rng.choices(names, k=rng.randrange(4)), mark, *rng.choices(names, k=rng.randrange(2))])
        rows.append((len(rows), f"{rng.choice(['http', 'x'])}://{rng.choice(['A.one.org', 'b.one.org', 'two.org', 'solo'])}{path}{rng.choice(['', '?a=/b', '#c', '/'])}"))
    rows += [(len(rows), f"http://big.org/w{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]}/z") for k in range(100)] + [(2000 + k, "http://big.org/home/z") for k in range(40)]
    middle = ["/".join(m) for k in range(4) for m in itertools.product(names, repeat=k)]
    hosts = ("one.org", "two.org")
    rules = [(v, h, f"/{s}{'/' if m else ''}{m}/{w}") for h in hosts for s in names for m in middle if len(m) < 6 for v, w in (("block", "bad"), ("allow", "ok"))]
    same_urls(spark, rows, rules[:60] + rules[-60:])


def test_urls_of_equal_rates_stay_together(spark):
    # 57 of 100 and 285 of 500 are the rate of all, yet 0.57 * 100 rounds to less than 57 and 0.57 * 500 doesn't.
    rates = {"a": (57, 100), "b": (285, 500), "c": (0, 430), "d": (570, 570)}
    got = urls.merged(spark.createDataFrame([("h", "", n, *r) for n, r in rates.items()], "host string, node string, name string, bad long, m long"))
    assert {r["name"]: r["branch"] for r in got.collect()} == brute_branches(rates) == {"a": "a", "b": "a", "c": "c", "d": "d"}


# -------------------------------------------------------------------- bpe
def test_bpe_equals_the_library(spark, awkward, empty):
    from tokenizers import Tokenizer
    path = bpe.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        own = bpe.Automaton.from_json(f.read())
    r = random.Random(1)
    parts = ["a", "b", "aa", " ", "  ", "\n", "\t", "é", "ß", "日本", "😀", "\u200b", "1", "٣", "'s", "'ll", "the", "ing", "\x1c", "\x85", "\u3000", "_", "<|endoftext|>", "\x00", "Ⅷ", "===", "\r\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(5000)] + ["a" * 20_000, " " * 5000, "日" * 3000]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    # Many texts at once, by the table.
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    table = bpe.Table(own)
    for lo, hi, data, bounds in W.slices(pa.array(texts), 1 << 18):
        ids, cuts = bpe.Runs(table, data, bounds).flat()
        for k, t in enumerate(texts[lo:hi]):
            assert ids[cuts[k]:cuts[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids
    rows = {(x["doc_id"], x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in bpe.digests(awkward, path).collect()}
    want = set()
    for x in awkward.collect():
        ids = library.encode(x["text"] or "", add_special_tokens=False).ids
        want.add((x["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert rows == want and bpe.digests(empty, path).count() == 0
    whole = bpe.tokenized(awkward, path)
    assert whole.columns[:len(awkward.columns)] == awkward.columns and bpe.tokenized(empty, path).count() == 0
    for x in whole.collect():
        ids = library.encode(x["text"] or "", add_special_tokens=False).ids
        assert (x["ids_"], x["n_tokens_"], x["decoded_sha256"]) == (ids, len(ids), sha(library.decode(ids, skip_special_tokens=False)))
    encode, decode = bpe.encode_column(spark, path), bpe.decode_column(spark, path)
    again = awkward.withColumn("x", decode(encode("text")))
    assert again.where(F.col("x") != F.coalesce("text", F.lit(""))).count() == 0


def test_automaton_of_a_few_merges_is_bpe():
    r = random.Random(3)
    for _ in range(300):
        vocabulary, merges = {c: k for k, c in enumerate("abc")}, []
        while len(merges) < 8:
            pair = (r.choice(list(vocabulary)), r.choice(list(vocabulary)))
            if pair not in merges and pair[0] + pair[1] not in vocabulary:
                merges.append(pair)
                vocabulary[pair[0] + pair[1]] = len(vocabulary)
        own = bpe.Automaton(vocabulary, merges)
        for _ in range(30):
            word = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
            # A list of merges applied by rank to the whole word, lowest rank first.
            assert [own.label[i].decode() for i in own.path(word.encode())] == by_rank(word, merges)
        words = ["".join(r.choice("abc") for _ in range(r.randint(1, 14))) for _ in range(30)]
        table, bounds = bpe.Table(own), np.cumsum([0, *map(len, words)])
        ids, n = table.paths(np.frombuffer("".join(words).encode(), np.uint8), bounds)
        cuts = np.cumsum([0, *n])
        assert [[own.label[i].decode() for i in ids[a:b].tolist()] for a, b in zip(cuts, cuts[1:])] == [by_rank(w, merges) for w in words]


def by_rank(word, merges):
    rank, parts = {p: k for k, p in enumerate(merges)}, list(word)
    while True:
        pairs = [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank]
        if not pairs:
            return parts
        best = min(pairs)[0]
        out, k = [], 0
        while k < len(parts):
            if k + 1 < len(parts) and rank.get((parts[k], parts[k + 1])) == best:
                out.append(parts[k] + parts[k + 1])
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts = out


# ------------------------------------------------------------- substrings
def brute_substrings(docs, window=20):
    seen, out = {}, []
    words = {i: WORD.findall(t or "") for i, t in docs}
    order = sorted(words, key=lambda i: (i is None, i))
    for i in order:
        for s in range(len(words[i]) - window + 1):
            seen.setdefault(tuple(words[i][s:s + window]), (i, s))
    for i in order:
        gone = {p for s in range(len(words[i]) - window + 1) if seen[tuple(words[i][s:s + window])] != (i, s) for p in range(s, s + window)}
        kept = [w for p, w in enumerate(words[i]) if p not in gone]
        out.append((i, len(words[i]), len(gone), " ".join(kept)))
    return sorted(out, key=repr)


def test_substrings_brute_force(spark):
    a, b = prose(1, 60), prose(2, 45)
    docs = [(1, a), (2, b + " x " + a), (3, "y " + a[10:]), (4, a + " " + a), (5, "z z " * 40), (6, None), (7, ""), (8, prose(1, 19)), (9, prose(3, 25) + " " + b[30:]), (None, a), (10, "w " * 30),
            (11, " ".join(a.split()[:20])), (12, prose(4, 3000)), (13, prose(4, 3000).replace("ba", "bo", 3))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_"]) for r in sub.without_repeats(df).collect()), key=repr)
    assert got == brute_substrings(docs)


def test_substrings_of_words_that_a_polynomial_would_mix_up(spark):
    """Two Thue-Morse words have equal polynomial hashes modulo 2^64; they are different words."""
    t = "".join("ba"[bin(k).count("1") & 1] for k in range(1024))
    u = t.translate(str.maketrans("ab", "ba"))
    tail = " " + prose(8, 30)
    docs = [(1, t + tail), (2, u + tail), (2, u + tail), (None, "x " + prose(9, 25)), (None, "y " + prose(9, 25)), (None, "x " + prose(9, 25))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in sub.without_repeats(df).collect()]
    assert sorted(got[:3] + got[3:], key=repr) == sorted([(1, 31, 0), (2, 31, 30), (2, 31, 30), (None, 26, 0), (None, 26, 25), (None, 26, 0)], key=repr) \
        or sorted(got, key=repr) == sorted([(1, 31, 0), (2, 31, 30), (2, 31, 30), (None, 26, 25), (None, 26, 0), (None, 26, 25)], key=repr)


def test_substrings_awkward(awkward, empty):
    got = sub.without_repeats(awkward)
    assert got.columns[:len(awkward.columns)] == awkward.columns and got.count() == awkward.count()
    rows = {r["doc_id"]: r for r in got.select("doc_id", got.columns[-3], got.columns[-2]).collect()}
    assert rows[1][2] == 0 and rows[2][2] == 30_000
    assert sub.without_repeats(empty).count() == 0


# ---------------------------------------------------------------- quality
def test_quality_held_out_and_awkward(spark, awkward, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = qual.fold(F.col("doc_id"))
    got = {r["doc_id"]: r for r in qual.quality(docs, labels, fold > 0, F.col("source"), F.col("lang")).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(got) == docs.count() and sum(got[r["doc_id"]]["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)
    rows = qual.quality(awkward, labels, fold > 0, F.col("source"), F.col("lang")).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert qual.quality(empty, labels, fold > 0, F.col("source"), F.col("lang")).count() == 0
    none = qual.quality(awkward, labels.limit(0), fold > 0, F.col("source"), F.col("lang")).collect()
    assert {r["evidence"] for r in none} == {0.0}


def brute_statistics(text):
    words = WORD.findall(text)
    n, size = len(words), max(1, len(text.encode()))
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    most, share = max(1, n), lambda x, y: math.sqrt(x / y)
    of = lambda pattern: len(re.findall(pattern, text))
    again = sum(a == b for a, b in zip(low, low[1:]))
    return [math.log1p(n), size / most / 10, len(set(low)) / most, share(max(Counter(low).values(), default=0), most), share(again, most), share(of("[A-Z]"), size),
            share(of("[0-9]"), size), share(of(r"[#$%&*@^~<>{}\[\]\\=_]"), size), share(of("[|]"), size), share(of("[!?]"), size), share(of("\n"), size)]


def brute_strength(groups):
    groups = [(g, n, m) for g, n, m in groups if n > 1]
    weight = sum(n * m * (1 - m) for _, n, m in groups)
    if not groups or not weight:
        return 100.0
    chance = sum(m * (1 - m) for _, _, m in groups)
    rho = (sum(n * (g / n - m) ** 2 for g, n, m in groups) - chance) / max(1e-9, weight - chance)
    return min(1e6, max(1.0, 1 / rho - 1)) if rho > 1e-6 else 1e6


def brute_quality(docs, labels, train):
    """{id: (evidence, host_rate, path_rate, score)} of docs {id: (text, host, path)}."""
    named = {i: int(sum(v) / len(v) >= 0.5) for i, v in labels.items() if v}
    learned = [i for i in docs if train(i) and i in named]
    x = np.array([brute_statistics(docs[i][0]) for i in docs])
    mine = np.array([k for k, i in enumerate(docs) if i in set(learned)])
    y = np.array([named[i] for i in docs if i in set(learned)], float)
    middle, spread = x[mine].mean(axis=0), x[mine].std(axis=0) + 1e-6
    w = qual.regression((x[mine] - middle) / spread, y)
    evidence = np.clip((x - middle) / spread @ w[:-1] + w[-1], -30, 30)
    hosts, paths = {}, {}
    for i in learned:
        for table, key in ((hosts, docs[i][1]), (paths, docs[i][1:])):
            good, n = table.get(key, (0, 0))
            table[key] = good + named[i], n + 1
    mean = (sum(named[i] for i in learned) + 1) / (len(learned) + 2)
    strong = brute_strength([(g, n, mean) for g, n in hosts.values()])
    host_rate = {h: (g + strong * mean) / (n + strong) for h, (g, n) in hosts.items()}
    inner = brute_strength([(g, n, host_rate[h]) for (h, _), (g, n) in paths.items()])
    odds = lambda p: math.log(p / (1 - p))
    out = {}
    for e, (i, (_, h, p)) in zip(evidence, docs.items()):
        host = host_rate.get(h, mean)
        good, n = paths.get((h, p), (0, 0))
        path = (good + inner * host) / (n + inner) if n else host
        out[i] = e, host, path, 1 / (1 + math.exp(-(e + odds(path) - odds(mean))))
    return out


def test_quality_features_brute_force():
    texts = ["", "a", "  ", "One two TWO two\nthree 3 |!? #{}", "é É ß x" * 3, "a a A b\x0bb\x85c", prose(4, 300)]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0] + [len(r) for r in raw])
    got = qual.features(np.frombuffer(b"".join(raw), np.uint8), bounds)
    assert got == pytest.approx(np.array([brute_statistics(t) for t in texts]))


@pytest.mark.parametrize("skew", (0.3, 0.9))
def test_quality_brute_force(spark, skew):
    rng = random.Random(9)
    docs, labels = {}, {}
    for i in range(900):
        host = f"h{rng.randrange(6)}" if rng.random() < 0.9 else f"rare{i}"
        good = rng.random() < (skew if host < "h3" else 1 - skew)
        docs[i] = (prose(i, 20) if good or rng.random() < 0.2 else "!! | 99 " * rng.randrange(1, 9), host, rng.choice(["a", "b"]))
        labels[i] = [int(good)] * (i % 3 > 0) + [1 - int(good)] * (i % 7 == 0)
    frame = spark.createDataFrame([(i, *d) for i, d in docs.items()], "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame([(i, v) for i, values in labels.items() for v in values], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in qual.quality(frame, marks, qual.fold(F.col("doc_id")) > 0, F.col("source"), F.col("lang")).collect()}
    want = brute_quality(docs, labels, lambda i: zlib.crc32(str(i).encode()) % 5 > 0)
    assert set(got) == set(docs)
    for i, w in want.items():
        assert tuple(got[i][c] for c in ("evidence", "host_rate", "path_rate", "score")) == pytest.approx(w, abs=1e-5)
        assert got[i]["predicted"] == (got[i]["score"] >= 0.5)


def test_quality_brute_force_on_whole_documents(spark):
    got = {r["doc_id"]: r for r in qual.op9_quality(spark, SF).collect()}
    docs = {r["doc_id"]: (r["text"] or "", r["source"] or "", r["lang"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        labels.setdefault(r["doc_id"], []).extend([] if r["quality"] is None else [r["quality"]])
    want = brute_quality(docs, labels, lambda i: zlib.crc32(str(i).encode()) % 5 > 0)
    assert set(got) == set(docs)
    for i, w in want.items():
        assert tuple(got[i][c] for c in ("evidence", "host_rate", "path_rate", "score")) == pytest.approx(w, abs=1e-5)


def test_sparse_sites_shrink_towards_the_prior(spark):
    rows = [(k, "some words of text", f"h{k % 4}" if k < 400 else "rare", "p") for k in range(402)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, int(k % 4 < 2) if k < 400 else 1) for k in range(402)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in qual.quality(docs, labels, F.lit(True), F.col("source"), F.col("lang")).collect()}
    assert got[0]["host_rate"] > 0.9 > got[400]["host_rate"] > 0.5 > 0.1 > got[2]["host_rate"]


# --------------------------------------------------------- language model
def model_bytes():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_lattice_sums_over_all_segmentations():
    own = lm.Lattice.from_model(model_bytes())

    def brute(w):
        if not w:
            return math.exp(own.log_weights[own.stop])
        total = math.exp(own.log_weights[own.fallback + w[0]]) * brute(w[1:])
        for k in range(1, len(w) + 1):
            p = own.index.get(w[:k])
            total += math.exp(own.log_weights[p]) * brute(w[k:]) if p is not None else 0
        return total
    words = ["the", "thtionble.", "é", "\n", "x" * 300, "日本"]
    one, two = np.zeros(len(own.log_weights)), np.zeros(len(own.log_weights))
    got = own.log_probabilities(pa.array(words), one)
    assert np.allclose(got, [own.forward_long(("" if w == "\n" else "▁" + w).encode(), two) for w in words]) and np.allclose(one, two)
    for w, p in zip(words[:4], got):
        assert math.isclose(math.log(brute(("" if w == "\n" else "▁" + w).encode())), p, rel_tol=1e-9)


@pytest.mark.parametrize("head", [1 << 19, 40])
def test_lm_base_scores_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    docs = documents(spark)
    tokens = {i: [*WORD.findall(lower(t)), "\n"] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = lm.op10_lm(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert -1e7 < r["score"] < 0


def test_lm_scores_brute_force(spark):
    """The lattice's score word by word, its weights from the expected counts of the training words."""
    docs = documents(spark)
    tokens = {i: [*WORD.findall(lower(t)), "\n"] for i, t in docs.items()}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    own = lm.Lattice.from_model(model_bytes())
    prior, expected = np.exp(own.log_weights), np.zeros(len(own.log_weights))
    spell = lambda w: b"" if w == "\n" else ("▁" + w).encode()
    for w in c:
        own.forward_long(spell(w), expected)
    expected += prior * (1.0 + lm.PRIOR * expected.sum())
    fitted = lm.Lattice(own.pieces, np.log(expected / expected.sum()))
    value = {w: fitted.forward_long(spell(w)) / math.log(10) for ws in tokens.values() for w in ws}
    n, v = sum(c.values()), len(c)
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    d = min(0.9, max(0.1, once / (once + 2 * twice)))
    for r in lm.op10_lm(spark, SF).collect():
        ws = tokens[r["doc_id"]]
        assert math.isclose(r["score"], sum(value[w] for w in ws), rel_tol=1e-9)
        mixed = sum(math.log10((max(c[w] - d, 0) + d * v * 10 ** value[w]) / n) for w in ws)
        assert math.isclose(r["mixed_score"], mixed, rel_tol=1e-9)


def test_lm_tokens_that_a_polynomial_would_mix_up(spark):
    t = "".join("ba"[bin(k).count("1") & 1] for k in range(1024))
    docs = spark.createDataFrame([(1, True, t), (2, True, t.translate(str.maketrans("ab", "ba")))], "doc_id long, training boolean, text string")
    got = {r["token"]: (r["n"], r["c"]) for r in lm.token_counts(docs).collect()}
    assert got == {t: (1, 1), t.translate(str.maketrans("ab", "ba")): (1, 1), "\n": (2, 2)}


def test_lm_awkward(awkward, empty):
    got = lm.scores(awkward, model_bytes(), F.col("doc_id") > 0).collect()
    assert len(got) == awkward.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 7)} == {1}
    none = lm.scores(awkward, model_bytes(), F.lit(False)).collect()
    assert {r["train_tokens"] for r in none} == {0} and all(math.isfinite(r["score"]) for r in none)
    assert lm.scores(empty, model_bytes(), F.lit(True)).count() == 0
