import random

from cytoloom.llm import near_copies, simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return 5 * len(x & y) >= 4 * len(x | y)


def family(rng, size, changes):
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randrange(changes)):
            words[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_components_against_all_pairs(spark):
    """Families with copies on both sides of 0.8, one of them large; all pairs give the components."""
    rng = random.Random(5)
    texts = [t for _ in range(15) for t in family(rng, 4, 9)] + family(rng, 120, 8) + ["", "a b", "A b"]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    prints = [simhash.fingerprint(t.encode()) for t in texts]
    far = 0
    for i in range(len(texts)):
        for j in range(i):
            close = (prints[i] ^ prints[j]).bit_count() <= 2
            if close or similar(texts[i], texts[j]):
                far += not close
                label[max(find(i), find(j))] = min(find(i), find(j))
    assert far > 20  # pairs that two bits do not reach
    out = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similar=True).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(k, find(k)) for k in range(len(texts))]


def test_one_of_each_drops_a_near_copy_many_bits_apart(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    pairs = [(base, [*base[:k], "new", *base[k:]]) for k in range(10, 290, 10)]
    a, b = max(pairs, key=lambda p: (simhash.fingerprint(" ".join(p[0]).encode()) ^ simhash.fingerprint(" ".join(p[1]).encode())).bit_count())
    df = spark.createDataFrame([(2, " ".join(a)), (3, " ".join(b))], "doc_id long, text string")
    assert simhash.one_of_each(df).count() == 2
    assert [r.doc_id for r in simhash.one_of_each(df, similar=True).collect()] == [2]
    assert near_copies.described(df).count() == 2


def components_of(spark, texts):
    out = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similar=True).collect()
    return {r.doc_id: r.component_id for r in out}


def test_a_crowd_that_shares_a_passage_is_searched_by_rare_shingles(spark, monkeypatch):
    """Texts of a common passage and a little of their own, some in similar pairs: no pair is lost, none is made up, and
    far fewer pairs are compared than the crowd has."""
    monkeypatch.setattr(near_copies, "FEW", 4)
    seen = []
    similar_pairs = near_copies._similar
    monkeypatch.setattr(near_copies, "_similar", lambda pairs, sets: (seen.append(pairs.count()), similar_pairs(pairs, sets))[1])
    rng = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(150))
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    texts = []
    for k in range(150):
        mine = own(60)
        texts.append(f"{mine} {passage}")
        if k % 10 == 0:
            texts.append(f"{mine} {passage} {own(20)}")
    found = components_of(spark, texts)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]):
                label = [label[j] if x == label[i] else x for x in label]
    assert [found[k] for k in range(len(texts))] == label and len(set(label)) == 150
    assert seen[-1] < 150 * 149 / 8


def test_texts_around_one_original(spark, monkeypatch):
    """A ball of edited copies, the outer ones near nobody: the components of all pairs, without comparing all pairs."""
    seen = []
    similar_pairs = near_copies._similar
    monkeypatch.setattr(near_copies, "_similar", lambda pairs, sets: (seen.append(pairs.count()), similar_pairs(pairs, sets))[1])
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**6)}" for _ in range(146)]
    texts = []
    for _ in range(260):
        words = list(base)
        for k in rng.sample(range(146), rng.randrange(0, 16)):
            words[k] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets, prints, label = [shingles(t) for t in texts], [simhash.fingerprint(t.encode()) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and (5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 2):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    found = components_of(spark, texts)
    assert [found[k] for k in range(len(texts))] == label and 20 < len(set(label)) < 240
    assert seen[-1] < 260 * 20
