"""Near copies in the pipeline's near-dedup, against every pair's exact similarity."""

import random

import pytest

from lexloom.llm import simhash


def components(rows, width=5, similarity=0.8, limit=2):
    """The smallest id of each id's component: exact Jaccard similarity, or fingerprints within two bits."""
    sets, prints = {}, {}
    for i, text in rows:
        words = text.split()
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or {tuple(words)}
        prints[i] = simhash.fingerprint(text.encode(), width)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) or (prints[a] ^ prints[b]).bit_count() <= limit:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted(r.doc_id for r in simhash.keep_one(df, width=5, similarity=0.8).collect())


def changed(rng, words, edits):
    """``words`` with so many single words, six or more apart, replaced."""
    out = list(words)
    for k in rng.sample(range(len(words) // 6), edits):
        out[6 * k] = f"v{rng.random()}"
    return out


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.random()}" for _ in range(604)]
    rows = [(k, " ".join(changed(rng, base, 10))) for k in range(450)]  # 0.85 to the base, less to each other
    alone = kept(spark, rows)
    assert alone == sorted(set(components(rows).values())) and len(alone) > 400
    rows.append((450, " ".join(base)))
    assert kept(spark, rows) == sorted(set(components(rows).values())) == [0]


def test_pairs_that_share_boilerplate_with_many(spark):
    rng = random.Random(6)
    common = [f"c{k}" for k in range(150)]
    rows = []
    for k in range(150):
        own = [f"w{rng.random()}" for _ in range(60)]
        rows.append((2 * k, " ".join(common + own)))
        rows.append((2 * k + 1, " ".join(common + changed(rng, own, 4))))
    assert kept(spark, rows) == sorted(set(components(rows).values())) == list(range(0, 300, 2))


def test_the_limit_is_exact(spark):
    rng = random.Random(7)
    rows = []
    for words, edits in [(94, 2)] * 20 + [(400, e) for e in (6, 7, 8, 9, 10) for _ in range(30)] + [(9, 1), (30, 1), (3, 0)] * 3:
        base = [f"w{rng.random()}" for _ in range(words)]
        for text in (base, changed(rng, base, edits)):
            rows.append((len(rows), " ".join(text)))
    want = components(rows)
    assert 0.3 < len(set(want.values())) / len(rows) < 0.9  # pairs on both sides
    assert kept(spark, rows) == sorted(set(want.values()))


def test_texts_of_one_fingerprint_keep_their_own_links(spark):
    rng = random.Random(8)
    core = [f"c{k}" for k in range(5)] * 200  # decides every bit, whatever follows
    one, two = ([f"w{rng.random()}" for _ in range(100)] for _ in range(2))
    rows = [(1, " ".join(core + one)), (2, " ".join(core + two)), (3, " ".join(two))]
    prints = [simhash.fingerprint(t.encode(), 5) for _, t in rows]
    assert prints[0] == prints[1] and (prints[0] ^ prints[2]).bit_count() > 2
    assert kept(spark, rows) == sorted(set(components(rows).values())) == [1]


def test_rows_that_share_an_id_with_different_texts(spark):
    rng = random.Random(9)
    a, b, c, d = (" ".join(f"w{rng.random()}" for _ in range(40)) for _ in range(4))
    rows = [(3, a), (7, a), (7, b), (7, b), (8, c), (8, d), (9, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in simhash.keep_one(df).collect())
    assert got == sorted([(3, a), (7, b), (8, c), (8, d)])


@pytest.mark.parametrize("hubs, block", [((), 16), ((1,), 4), ((2, 3), 256), (simhash.HUBS, simhash.BLOCK)])
def test_blocks_and_hubs_find_the_same_components(spark, hubs, block):
    rng = random.Random(10)
    common = [f"c{k}" for k in range(150)]
    texts = [" ".join(common + [f"w{rng.random()}" for _ in range(30)]) for _ in range(40)]
    base = [f"b{k}" for k in range(300)]
    texts += [" ".join(changed(rng, base, rng.randrange(2, 6))) for _ in range(60)]  # 0.7 to 0.9 to each other
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    full = simhash.sketches(df, 0.8).cache()
    sid = {r.doc_id: r.sid for r in full.collect()}
    root = {s: s for s in sid.values()}

    def top(s):
        while root[s] != s:
            s = root[s]
        return s

    for r in simhash.similar(df, simhash._alive(full, "doc_id"), 0.8, "doc_id", "text", 5, hubs, block).collect():
        root[top(r.a)] = top(r.b)
    want = components(rows, limit=-1)
    groups = {frozenset(i for i in sid if top(sid[i]) == top(sid[k])) for k in sid}
    assert groups == {frozenset(i for i in want if want[i] == r) for r in set(want.values())}
    assert 1 < len(groups) < 100


@pytest.mark.parametrize("crowd", [4, 64])
def test_links_of_crowded_buckets_are_all_pairs(spark, crowd):
    rng = random.Random(11)
    prints = {rng.getrandbits(64) for _ in range(50)}
    for base in list(prints)[:3]:
        for _ in range(150):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    got = [(r.a, r.b) for r in simhash.links(df, crowd=crowd).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
