"""The pipeline's stages: what each keeps, on awkward, empty and given tables."""

import hashlib
import importlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from modelkeep.llm import op1_toxicity, op3_simhash, op4_pii, op5_decontaminate

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_on_awkward_and_empty_tables(spark, awkward, empty, name, stage):
    out = stage(spark, awkward, SF)
    assert out.columns[:len(awkward.columns)] == awkward.columns
    assert (out.columns == awkward.columns) == (name != "tokens")
    n = out.count()
    assert n == awkward.count() if name in ("personal_data", "tokens") else 0 < n <= awkward.count()
    assert stage(spark, empty, SF).count() == 0


def test_run_equals_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    model = op1_toxicity.fit(docs, labels, op1_toxicity.training_rows())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {i: t for i, t in texts.items() if model.score(t or "") < 0.5}
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    least = {r["component_id"] for r in op3_simhash.near_duplicates(frame(left)).collect()}
    left = {i: t for i, t in left.items() if i in least}
    bad = {r["doc_id"] for r in op5_decontaminate.contamination(frame(left), bench).where("contaminated").collect()}
    left = {i: op4_pii.redact(t, op4_pii.find(t)[1]) for i, t in left.items() if i not in bad}
    got = {r["doc_id"]: r for r in P.run(spark, SF).collect()}
    assert {i: r["text"] for i, r in got.items()} == left
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(importlib.import_module("public_tokenizers").path("byte_bpe_50k.json"))
    for i in list(left)[:100]:
        ids = library.encode(left[i], add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) and got[i]["n_chars"] == len(left[i])
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_planted_items_and_copies_go(spark):
    """A document that holds an item goes, one beside it stays; so do rows of one id with different texts."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(1, "before it " + bench + " and after"), (2, "nothing of that kind"), (2, "nothing of that kind"), (3, "words " * 2000 + bench), (4, None), (None, bench)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.decontamination(spark, docs, SF)
    # 20 * n_hit < n_words in the long document.
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 2), (False, 2), (False, 3), (False, 4)]
    once = P.near_duplicates(spark, docs, SF)
    assert sorted((r["doc_id"] or 0) for r in once.collect()) == [0, 1, 2, 3, 4]


def test_clean_documents_stay(spark):
    """Labelled clean documents aren't lost to the toxicity stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = [r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()]
    kept = {r["doc_id"] for r in P.toxicity(spark, docs, SF).select("doc_id").collect()}
    held = [i for i in clean if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean) and sum(i in kept for i in held) >= 0.95 * len(held)
    assert docs.where(F.col("doc_id").isin([])).count() == 0
