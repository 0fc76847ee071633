import os
import random

import pytest

from tallyloom.llm import packing

needs_ranks = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer files here")


def unpacked(steps):
    """Sizes in each container of a plan."""
    boxes = {}
    for size, low, high, first, each in steps:
        for rank in range(low, high):
            boxes.setdefault(first + (rank - low) // each, []).append(size)
    return boxes


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_item_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 100, 256])
    histogram = {s: rng.randint(1, 60) for s in rng.sample(range(1, capacity + 1), min(capacity, 40))}
    steps, used = packing.plan(capacity, histogram, groups=rng.choice([1, 5, 64]))
    boxes = unpacked(steps)
    assert len(boxes) == used and all(sum(b) <= capacity for b in boxes.values())
    placed = {}
    for b in boxes.values():
        for s in b:
            placed[s] = placed.get(s, 0) + 1
    assert placed == histogram
    for size in histogram:
        ranks = sorted((low, high) for s, low, high, _, _ in steps if s == size)
        assert ranks[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ranks, ranks[1:], strict=False)) and ranks[-1][1] == histogram[size]


def test_plan_is_close_to_the_bound():
    rng = random.Random(9)
    histogram = {}
    for _ in range(5000):
        s = min(256, max(1, int(rng.expovariate(1 / 60))))
        histogram[s] = histogram.get(s, 0) + 1
    _, used = packing.plan(256, histogram)
    assert used <= 1.02 * sum(s * n for s, n in histogram.items()) / 256 + 1
    assert packing.plan(256, {}) == ([], 0)


@needs_ranks
def test_packed(spark):
    texts = [None, "", "one", "word " * 50, "word " * 100, "word " * 100, *["some more words here"] * 30, "x" * 3000]
    documents = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(4, "word " * 300, 1)], "doc_id bigint, text string, capacity int")
    packs = spark.createDataFrame([(1, 64), (2, 1000)], "pack_id int, capacity int")
    got = packing.packed(documents, packs).collect()
    sizes = {(r.doc_id, r.size) for r in packing.sized(documents).collect()}
    for pack, capacity in ((1, 64), (2, 1000)):
        boxes, texts_of = {}, {}
        for r in got:
            if r.pack_id == pack:
                texts_of[r.doc_id] = texts_of.get(r.doc_id, 0) + r.tokens
                if r.container_id is None:
                    assert r.tokens == 0
                else:
                    boxes[r.container_id] = boxes.get(r.container_id, 0) + r.tokens
        assert max(boxes.values()) <= capacity
        for d in texts_of:
            assert texts_of[d] == sum(s for i, s in sizes if i == d)
    report = {r.pack_id: r for r in packing.report(packing.packed(documents, packs)).collect()}
    assert report[1].overfull == report[2].overfull == 0 and report[2].n_split_texts == 0


@needs_ranks
def test_no_documents(spark):
    documents = spark.createDataFrame([], "doc_id bigint, text string")
    packs = spark.createDataFrame([(1, 64)], "pack_id int, capacity int")
    assert packing.packed(documents, packs).count() == 0
