"""Open pairs of a large group of near copies are compared by as many tasks as they are worth."""

import random

from cellspark.llm import neardup


def test_slices_of_open_buckets_give_the_same_classes(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    docs = []
    for i in range(40):
        own = list(base)
        for _ in range(2 + i % 3):
            own[rng.randrange(len(own))] = f"x{i}"
        docs.append((i, " ".join(own)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted((r.k, r.class_id) for r in neardup.near_duplicates(docs).collect())
    seen, plain = [], neardup._settled

    def watched(rows, chosen, refs, sets, pairs, work):
        seen.append(pairs)
        out = plain(rows, chosen, refs, sets, pairs, work)
        return out

    monkeypatch.setattr(neardup, "_settled", watched)
    monkeypatch.setattr(neardup, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(neardup, "SLICE", 3)
    monkeypatch.setattr(neardup, "TASK_PAIRS", 20)
    got = sorted((r.k, r.class_id) for r in neardup.near_duplicates(docs).collect())
    assert got == want and seen and seen[0] > 20
