"""The registered language-model query on held-out texts."""

import math
import zlib

import pytest

pytest.importorskip("public_tokenizers")


def test_held_out_scores_are_near_the_counts(spark, scratch):
    from modelkeep.llm.registered import QUERIES
    words = "zorplen quibbish vantrolic meefgard the".split()
    rows = [(i, None if i == 7 else " ".join(words[(i * j) % 5] for j in range(1, 40))) for i in range(60)] + [(99, "unseenable zzz"), (98, "")]
    folder = scratch("lm")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op10_lm"](spark, folder).collect()}
    assert len(got) == len(rows) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got.values())
    held = [got[i] for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1]
    assert held and all(r["held_out"] for r in held)
    known = [r for r in held if r["n_known"] == r["n_tokens"]]
    assert known and all(r["score"] > 1.05 * r["base_score"] - 0.5 for r in known)
    assert any(r["lattice_score"] < 2 * r["base_score"] for r in known)
    assert all(r["score"] == r["mixed_score"] for r in got.values())
