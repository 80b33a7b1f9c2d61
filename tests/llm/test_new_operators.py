"""Language identification, the Merkle manifest and ranked lexical search
against brute force, and on awkward and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from awkward_documents import prose

from modelkeep.llm import op11_langid as lang
from modelkeep.llm import op12_merkle as merkle
from modelkeep.llm import op13_search as search
from modelkeep.llm import words as W

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# ------------------------------------------------------------------ languages
def test_words_are_runs_of_letters_of_one_script():
    rows = ["Ab c1d", "", "при вет你好x", "ét́", "́x", "12 !"]
    words = lang.Words(rows)
    got = [[rows[k][b - words.bounds[k]:e - words.bounds[k]] for b, e in zip(words.begin[x:y], words.end[x:y])]
           for k, (x, y) in enumerate(zip(words.first[:-1], words.first[1:]))]
    assert got == [["Ab", "c", "d"], [], ["при", "вет", "你好", "x"], ["ét́"], ["x"], []]
    assert words.letters.tolist() == [2, 1, 1, 3, 3, 2, 1, 2, 1]


def test_trigrams_with_word_borders():
    words = lang.Words(["aba b", "aba"])
    bucket, first = words.grams(0, 3, 18)
    assert first.tolist() == [0, 4, 6] and len(bucket) == 10
    assert bucket[:4].tolist() == bucket[6:].tolist()
    assert len(set(bucket[:6].tolist())) == 6
    parts = [words.grams(k, k + 1, 18)[0].tolist() for k in range(3)]
    assert sum(parts, []) == bucket.tolist()


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    for case in range(60):
        n, k = int(rng.integers(1, 8)), int(rng.integers(1, 4))
        scores = rng.normal(0, 3, (n, k)) + (np.arange(k) == 0) * (case % 3)
        start, penalty = np.log(np.full(k, 1 / k)), 4.0
        best = scores.argmax(axis=1)
        run_end = np.array([next((j for j in range(i, n) if best[j] != best[i]), n) for i in range(n)])
        got = lang.viterbi(scores, best.tolist(), run_end, start, penalty)

        def value(path):
            return start[path[0]] + sum(scores[i, x] for i, x in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        assert value(got) == pytest.approx(max(value(p) for p in product(range(k), repeat=n)))


def test_languages_held_out_spans_and_scripts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lang.op11_langid(spark, SF).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    one = {x: docs.where((F.col("lang") == x) & (F.length("text") > 400)).orderBy("doc_id").first()["text"][:400] for x in ("en", "de")}
    rows = [(1, "привет мир", "ru"), (2, "καλημέρα κόσμε", "el"), (3, one["en"], "en"), (4, one["de"], "de")]
    model = lang.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(docs.select("doc_id", "text", "lang")), F.lit(True))
    mixed = one["en"] + " мир " + one["de"]
    found = lang.identify(spark.createDataFrame([(1, mixed), (2, "привет"), (3, "κόσμε 12"), (4, "ไทย"), (5, "12 !")], "doc_id long, text string"), model)
    by_id = {r["doc_id"]: r for r in found.collect()}
    spans = by_id[1]["spans"]
    assert [s["lang"] for s in spans] == ["en", "ru", "de"]
    assert mixed[spans[1]["start"]:spans[1]["end"]] == "мир"
    assert abs(spans[0]["end"] - 400) < 20 and spans[2]["end"] > len(mixed) - 20
    assert (by_id[2]["lang_pred"], by_id[3]["lang_pred"]) == ("ru", "el") and by_id[2]["score"] == 1.0
    assert by_id[4]["lang_pred"] in model.languages
    assert tuple(by_id[5])[1:] == ("und", 0.0, [])


def test_languages_awkward(spark, awkward, empty):
    model = lang.learn(awkward, F.lit(True))
    assert model.languages == ["de", "en", "es"]
    got = lang.identify(awkward, model)
    rows = got.collect()
    assert len(rows) == awkward.count()
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 7)} == {"und"}
    assert "und" not in {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 5, 6, 8, 9, 10, 11)}
    nothing = lang.learn(empty, F.lit(True))
    assert {r["lang_pred"] for r in lang.identify(awkward, nothing).collect()} == {"und"}
    assert lang.identify(empty, model).count() == 0
    held = lang.learn(awkward, F.col("doc_id") == 10)
    assert held.languages == ["de"]


# --------------------------------------------------------------------- merkle
def brute_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k:k + 16])) for k in range(0, len(last), 16)])
    return levels


def brute_path(levels, k):
    out = []
    for level in levels[:-1]:
        run = k - k % 16
        out += [level[run:k], level[k + 1:run + 16]]
        k //= 16
    return out


def brute_fold(leaf, path):
    for left, right in zip(path[::2], path[1::2]):
        leaf = sha("".join(left) + leaf + "".join(right))
    return leaf


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for r in rows:
        leaf = sha("".join(map(field, r)))
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        changed = sha("".join(map(field, (*r[:4], None if r[4] is None else lower(r[4]))))) if bad else leaf
        groups[r[1]].append((r[0] is None, r[0] or 0, leaf, changed, r[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = brute_tree([x[2] for x in groups[s]])
    high = brute_tree([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for k, (_, _, leaf, changed, id_) in enumerate(groups[s]):
            path = brute_path(trees[s], k) + brute_path(high, j)
            folded = brute_fold(changed, path)
            out.append((id_, leaf, trees[s][-1][0], high[-1][0], sha("".join(sum(path, []))), folded, folded == high[-1][0]))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
KEY = (lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 33, 255, 256, 257, 4095, 4096, 4097, 5000, 70_000])
def test_closed_form_places(n):
    """The place of every node follows from the number of leaves."""
    levels = merkle.height(n)
    counts = [-(-n // 16 ** level) for level in range(levels + 1)]
    log = merkle.append_log([f"{k}" for k in range(n)], levels) if n < 6000 else None
    if log is not None:
        assert len(log) == sum(counts)
        assert [log[merkle.position(0, k, n)] for k in range(n)] == [f"{k}" for k in range(n)]
        tree = brute_tree([f"{k}" for k in range(n)])
        for level in range(1, levels + 1):
            assert [log[merkle.position(level, k, n)] for k in range(counts[level])] == tree[level]
    assert merkle.position(levels, 0, n) == sum(counts) - 1
    left, right = merkle.siblings(0, n - 1, n)
    assert len(left) == (n - 1) % 16 and right == []


def test_manifest_brute_force(spark, tmp_path, awkward):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    rows = [tuple(r) for r in rows] + [(10 ** 6, None, "en", 3, "Abc"), (10 ** 6 + 1, "", None, None, None), (None, "Z", "en", 1, "É X"), (10 ** 6 + 5, "é", "en", 1, "É X")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    (tmp_path / "data").mkdir()
    frame.withColumn("root", F.lit("clash")).write.parquet(str(tmp_path / "data/documents.parquet"))
    got = merkle.op12_merkle(spark, str(tmp_path / "data")).select(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(brute_manifest(rows), key=KEY)


def test_manifest_of_several_rounds_of_builders(spark):
    """A tree of more leaves than a builder takes, beside one that just fills it, and many small ones."""
    rows = [(k, "hot", "en", k, f"Text {k}") for k in range(4096 * 2 + 19)]
    rows += [(k + 20_000, "full", "en", k, f"T{k}") for k in range(4096)] + [(k + 40_000, f"s{k}", "en", k, "x") for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = merkle.manifest(frame, columns=("doc_id", "source", "lang", "n_chars", "text"), tampered=tampered)
    assert len(made.logs) == 2
    got = {r["key"]: r for r in made.verified().collect()}
    want = brute_manifest(rows)
    assert len(got) == len(want)
    for id_, leaf, subroot, root, proof, folded, ok in want:
        r = got[str(id_)]
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) == (leaf, subroot, root, proof, folded)
    assert made.root().first()["root"] == want[0][3]
    some = {r["key"]: r for r in made.proofs().where("key in ('5', '8200', '20000', '40007')").collect()}
    for r in some.values():
        assert sha("".join(r["siblings"])) == got[r["key"]]["proof_sha256"]
        assert merkle.fold(r["leaf"], merkle._steps(r["siblings"])) == r["root"]


def test_manifest_awkward(spark, awkward, empty):
    rows = [tuple(r) for r in awkward.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.manifest(awkward, tampered=tampered).verified().select(
        F.col("key").cast("long"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")))
    want = brute_manifest(rows)
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(want, key=KEY)
    made = merkle.manifest(empty)
    assert made.verified().count() == 0 and made.root().count() == 0
    untouched = merkle.manifest(awkward).verified()
    assert untouched.where("folded_root <> root").count() == 0


# --------------------------------------------------------------------- search
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k=20):
    """docs: (doc_id, text); items: (item_id, text); rows of the result."""
    terms = [(d, Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    n_docs = sum(bool(c) for _, c in terms)
    total = sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        wanted, found = Counter(TERM.findall(lower(text or ""))), []
        for d, c in terms:
            if c:
                m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
                score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                            for t, times in wanted.items() if c[t])
                if score > 0:
                    found.append((-score, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return out


def test_search_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, search.op13_search(spark, SF).collect())) == sorted(brute_search(docs, items))


def test_search_many_copies_ties_and_parts(spark, awkward, empty, monkeypatch):
    copies = [(k, "apple pie and apple juice") for k in range(300, 0, -1)] + [(k, "pie apple juice apple other") for k in range(1000, 1030)]
    copies += [(None, "apple"), (5, "apple"), (5, "apple"), (6, None), (7, "")] + [(2000 + k, prose(k, 40)) for k in range(50)]
    items = [(1, "Apple PIE pie"), (2, "juice"), (2, "apple"), (None, "other"), (3, ""), (4, None), (5, "zzz"), (6, prose(3, 30))]
    frame = spark.createDataFrame(copies, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("bag", "m", "class", "rank")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    key = (lambda r: tuple((x is not None, x) for x in r))
    want = sorted(brute_search(copies, items), key=key)
    assert sorted(map(tuple, search.search(frame, bench).collect()), key=key) == want
    monkeypatch.setattr(search, "ITEMS", 2)
    assert sorted(map(tuple, search.search(frame, bench).collect()), key=key) == want
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    asked = [(1, "same words again"), (2, "idiot joe 日本")]
    got = search.search(awkward, spark.createDataFrame(asked, "item_id long, text string"), k=3)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_search(rows, asked, 3), key=key)
    assert search.search(empty, bench).count() == 0
    assert search.search(frame, bench.limit(0)).count() == 0


# ------------------------------------------------------------- words by bytes
def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") & 1 else a for k in range(n))


def test_hashes_are_no_polynomials():
    rows = [thue_morse(1024), thue_morse(1024, "b", "a"), thue_morse(64), thue_morse(64, "b", "a"), thue_morse(60), thue_morse(60, "b", "a"), "", "a", "a\0", "ab"]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    end = np.cumsum([len(r) for r in rows])
    begin = end - [len(r) for r in rows]
    for which in (0, 1):
        h = W.hashes(data, begin, end, which)
        assert len(set(h.tolist())) == len(rows)
        shifted = W.hashes(np.concatenate([data[:0], np.frombuffer(b"xyz", np.uint8), data]), begin + 3, end + 3, which)
        assert shifted.tolist() == h.tolist()
    one = np.array([ord(c) for c in thue_morse(1024)], np.uint64)
    two = np.array([ord(c) for c in thue_morse(1024, "b", "a")], np.uint64)
    assert W.windows(one, 1024)[0] != W.windows(two, 1024)[0]
    assert W.runs(one, np.array([0, 5]), np.array([1024, 7])).tolist() != W.runs(two, np.array([0, 5]), np.array([1024, 7])).tolist()


def test_vocabulary_verifies_bytes(monkeypatch):
    words = [b"b", b"", b"abc", "é日".encode(), b"x" * 200, b"abd"]
    texts = [b"abc", b"nope", b"x" * 200, b"x" * 199, "é日".encode(), b"b", b"abd", b"abe"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    begin = end - [len(t) for t in texts]
    assert W.Vocabulary(words).find(data, begin, end).tolist() == [2, -1, 4, -1, 3, 0, 5, -1]
    monkeypatch.setattr(W, "hashes", lambda d, b, e, which=0: np.zeros(len(b), np.uint64))
    assert W.Vocabulary(words).find(data, begin, end).tolist() == [2, -1, 4, -1, 3, 0, 5, -1]
    assert W.Vocabulary([]).find(data, begin, end).tolist() == [-1] * 8
