"""Thresholds of near-duplicates under that of op1."""

import corpus_pipeline
import pytest

from attrilake.llm import minhash


def test_bands_follow_the_threshold():
    assert minhash.band_rows(85, minhash.MISS) == 5 and minhash.band_rows(80, minhash.MISS) == 4
    for percent in (80, 70, 60, 50, 30):
        rows = minhash.band_rows(percent, minhash.MISS)
        assert (1 - (percent / 100) ** rows) ** (120 // rows) <= minhash.MISS
    with pytest.raises(ValueError):
        minhash.band_rows(5, minhash.MISS)


def test_the_stage_links_from_80_percent(spark):
    words = [f"w{i}" for i in range(150)]
    # 133 of 159 shingles (0.836) and 128 of 164 (0.78) in common with the first
    rows = [(1, " ".join(words)), (2, " ".join(words[:137] + [f"x{i}" for i in range(13)])), (3, " ".join([f"y{i}" for i in range(18)] + words[18:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()} == {1, 3}
