"""The Jaccard join where leaders leave much open, and rows that repeat an id with other texts."""

import random

from tidewire.llm import setjoin

from test_llm_operators import brute_components, brute_sets


def edited_groups(rng, groups=2, size=14):
    """Groups of edited copies of which many pairs are near the threshold, on both sides of it."""
    texts = []
    for _ in range(groups):
        body = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 60, 90]))]
        for _ in range(size):
            copy = list(body)
            for _ in range(rng.randint(0, max(1, len(body) // 18))):
                at = rng.randrange(len(copy))
                how = rng.random()
                if how < 0.5:
                    copy[at] = f"q{rng.randrange(40)}"
                elif how < 0.75:
                    copy.insert(at, f"z{rng.randrange(40)}")
                else:
                    del copy[at]
            if rng.random() < 0.1:
                body = copy  # later ones are copies of a copy
            texts.append(" ".join(copy))
    return texts


def test_divided_lists_lose_no_link(spark, monkeypatch):
    rng = random.Random(1)
    texts = edited_groups(rng) + [" ".join(f"w{rng.randrange(3000)}" for _ in range(30)) for _ in range(10)]
    rng.shuffle(texts)
    monkeypatch.setattr(setjoin, "LIST_PAIRS", 6)
    monkeypatch.setattr(setjoin, "MOST_ROUNDS", 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in setjoin.link_components(docs).collect()}
    want = brute_components(brute_sets(dict(enumerate(texts))))
    assert got == want and 3 < len(set(want.values())) < len(texts)


def test_pairs_grow_with_the_group_not_with_its_square(spark, monkeypatch):
    """Members of one group that do not link: each is only compared with a few others."""
    rng = random.Random(5)
    body = [f"w{i}" for i in range(120)]
    asked = []
    real = setjoin.verified

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(setjoin, "verified", counted)
    size, texts = 120, []
    for i in range(size):
        copy = list(body)
        for at in rng.sample(range(len(copy)), 5):
            copy[at] = f"q{i}x{at}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in setjoin.link_components(docs).collect()}
    assert got == brute_components(brute_sets(dict(enumerate(texts))))
    assert sum(asked) < size * (size - 1) / 2 / 2


def test_blocks_lose_no_link(spark, monkeypatch):
    """A group over several blocks, inside its largest component and outside it."""
    rng = random.Random(3)
    texts = edited_groups(rng, 3, 24)
    for name, value in (("LIST_PAIRS", 6), ("BLOCK_SETS", 5), ("MOST_ROUNDS", 1)):
        monkeypatch.setattr(setjoin, name, value)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in setjoin.link_components(docs).collect()}
    want = brute_components(brute_sets(dict(enumerate(texts))))
    assert got == want and 3 < len(set(want.values())) < len(texts)


def test_far_copies_are_no_rows_of_pairs(spark, monkeypatch):
    """Copies edited so much that few of them link share long lists; their pairs are compared in blocks."""
    rng = random.Random(8)
    body, size, asked, texts = [f"w{i}" for i in range(120)], 150, [], []
    real = setjoin.verified

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(setjoin, "verified", counted)
    for _ in range(size):
        copy = list(body)
        for at in rng.sample(range(60), rng.randint(1, 9)):
            copy[at] = f"q{rng.randrange(40)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in setjoin.link_components(docs).collect()}
    want = brute_components(brute_sets(dict(enumerate(texts))))
    assert got == want and 1 < len(set(want.values())) < size
    assert sum(asked) < 4 * size


def test_exactly_at_the_threshold(spark):
    """Sets of 8 shingles: 6 of 8 shared is 75 of 100, 5 of 8 is not."""
    base = [f"w{i}" for i in range(12)]  # 8 shingles
    longer = base[:10] + []  # 6 shingles, all in base: 6 / 8
    shorter = base[:9]  # 5 of 8
    texts = [" ".join(base), " ".join(longer), " ".join(shorter)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in setjoin.link_components(docs).collect()}
    assert got == brute_components(brute_sets(dict(enumerate(texts)))) and got[1] == 0


def test_one_id_with_two_texts(spark):
    words = [f"w{i}" for i in range(40)]
    one, other = " ".join(words), " ".join(reversed(words))
    near_other = other + " more"
    rows = [(1, one, "a", 7), (1, other, "a", 7), (2, one, "b", 7), (3, near_other, "c", 7), (None, one, "d", 7), (5, None, "e", 7), (5, "", "e", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string, n_shingles int")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in setjoin.link_components(docs).collect())
    assert got == [("1", 36, "1"), ("1", 36, "1"), ("2", 36, "1"), ("3", 37, "1"), ("5", 0, "5"), ("5", 0, "5"), ("None", 36, "None")]

    import corpus_pipeline as p

    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, *_ in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted((str(r.doc_id), r.text) for r in p.near_duplicates(spark, table, "").collect())
    assert len(kept) == 4 and [k for k in kept if k[0] != "5"] == [("1", one), ("1", other), ("None", one)]
