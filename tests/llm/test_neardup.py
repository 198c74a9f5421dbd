import random

import pytest
from lodeweave.llm import neardup


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 8)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(0, 3)] = [word() for _ in range(rng.randrange(0, 3))]
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(word() for _ in range(rng.randrange(30, 160))))
    return texts


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_pairs_against_brute_force(spark, threshold):
    texts = corpus(1, 120) + ["a b c"] * 3 + ["x " * 50, "X  x " * 30, ""]
    rows = [(i, t, "p") for i, t in enumerate(texts)] + [(0, texts[0], "p"), (None, texts[0], "p"), (9999, None, "p")]
    df = spark.createDataFrame(rows, "id bigint, text string, key string")
    sets = {i: set(s.tolist()) for i, t in enumerate(texts) if (s := neardup.shingles(t)) is not None}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    got = [tuple(r) for r in neardup.near_duplicate_pairs(df, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    groups = {r.id: (r.class_id, r.group_id, r.links) for r in neardup.near_duplicate_groups(df, threshold).collect()}
    assert set(groups) == set(sets)
    for a, b in want:
        assert groups[a][1] == groups[b][1]
        assert (sets[a] == sets[b]) == (groups[a][0] == groups[b][0])


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    assert neardup.near_duplicate_pairs(df, 0.6).count() == 0
    assert neardup.near_duplicate_groups(df).count() == 0


def test_packing_of_hashes():
    s = neardup.shingles(" ".join(map(str, range(300))))
    assert (neardup.unpack(neardup.pack(s)) == s).all()
    assert neardup.shingles(" ".join(map(str, range(39)))) is None and len(neardup.shingles("1: " + " ".join(map(str, range(40))))) == 36


def test_long_lists_are_split_without_loss(spark):
    """Many sets that share their rarest shingles: split lists give the pairs of unsplit ones, and no block pairs more than twice its size."""
    rng = random.Random(2)
    head = " ".join(f"h{i}" for i in range(60))
    rows = [(i, head + " " + " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(2, 12)))) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    sets, sketches = neardup.shingle_sets(df)
    blocks = neardup.prefix_blocks(sets, neardup.summed_sketch(sketches), 0.6, 4)
    whole, split = ({tuple(r) for r in neardup.candidates(blocks, 0.6, heavy).collect()} for heavy in (10_000, 7))
    assert whole == split and len(whole) > 1000
    texts = {i: set(neardup.shingles(t).tolist()) for i, t in rows}
    want = {(a, b) for a in texts for b in texts if a < b and len(texts[a] & texts[b]) >= 0.6 * len(texts[a] | texts[b])}
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df, 0.6).collect()} == want
