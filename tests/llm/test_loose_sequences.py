"""What parts leave less than full is packed again."""

import random

import pytest
from pyspark.sql import functions as F

from steplens.llm import packing


@pytest.mark.parametrize("part_docs", [4096, 20, 3])
def test_sequences_of_all_parts_are_joined(spark, part_docs):
    rng = random.Random(7)
    lengths = [rng.choice([1, 7, 40, 64, rng.randrange(1, 65)]) for _ in range(400)]
    rows = [(i, 0, 0, n, 0, i) for i, n in enumerate(lengths)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")
    got = packing.pack(cut, len(rows), 64, part_docs).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == sorted((i, n) for i, n in enumerate(lengths))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    fewest = -(-sum(lengths) // 64)
    whole = len(set(packing.best_fit_decreasing(__import__("numpy").array(lengths), 64)[0].tolist()))
    assert fewest <= len(by) <= whole + (0 if part_docs > 400 else 6)
    assert packing.pack(cut.where(F.lit(False)), 0, 64, part_docs).collect() == []
