"""The near-dedup stage on copies whose similarity is close to the bound, against brute force."""

import random

from tests.llm.test_pipeline import shingles
from wayfold.llm import simhash


def words(rnd, n):
    return [f"w{rnd.randrange(100_000)}" for _ in range(n)]


def stays(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in range(len(texts)) if find(i) == i}


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id for r in simhash.drop_near_copies(df).collect()}


def test_appended_truncated_and_boundary_copies_go(spark):
    rnd, texts = random.Random(21), []
    for k in range(40):
        text, n = words(rnd, 84), 16 + k % 8
        texts += [" ".join(text), " ".join(text + words(rnd, n))]  # 80 of 80 + n shingles; 0.8 at n = 20
        text, n = words(rnd, 104), 16 + k % 8
        texts += [" ".join(text), " ".join(text[n:] if k % 2 else text[:-n])]
    want = stays(texts)
    assert 80 < len(want) < 160
    assert kept(spark, texts) == want


def edited(rnd, text, share):
    return [w if rnd.random() >= share else f"e{rnd.randrange(10**9)}" for w in text]


def test_groups_linked_through_any_member_collapse(spark):
    rnd, texts = random.Random(22), []
    for _ in range(12):
        text = words(rnd, 150)
        texts += [" ".join(text), *(" ".join(edited(rnd, text, 0.018)) for _ in range(8))]
    for _ in range(10):
        text = words(rnd, 120)  # the same words in blocks of another order, and a near copy of the second
        turned = [w for k in range(0, 120, 6) for w in reversed(text[k : k + 6])]
        texts += [" ".join(text), " ".join(turned), " ".join(edited(rnd, turned, 0.01))]
    order = list(texts)
    rnd.shuffle(order)
    assert kept(spark, order) == stays(order)


def test_frequent_shingles_take_further_shingles(spark, monkeypatch):
    """With few open pairs a key, pairs of a frequent shingle must share more of their prefixes; none is lost."""
    rnd = random.Random(23)
    passage = words(rnd, 60)
    texts = []
    for _ in range(15):
        text = passage + words(rnd, 12)
        texts += [" ".join(text), " ".join(edited(rnd, text, 0.02)), " ".join(edited(rnd, text, 0.02))]
    for _ in range(20):
        texts.append(" ".join(passage[rnd.randrange(20) : 40 + rnd.randrange(20)] + words(rnd, rnd.randrange(3, 12))))
    texts += ["", None, "one", "one two", "one two", " ".join(passage)]
    monkeypatch.setattr(simhash, "COMMON", 10**9)  # no shingle is known to be common, so that prefixes hold frequent ones
    for limit in (2, 1 << 24):
        monkeypatch.setattr(simhash, "OPEN", limit)
        assert kept(spark, texts) == stays(texts)
