"""Runs of words against brute force."""

import hashlib
import random

import pytest

from tidewire.llm import runs
from tidewire.llm.queries import op12_word_runs, planted_period


def brute(words, least=6, times=4):
    """Every stretch of every period, longest first, by definition."""
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end > i:
                length = end - i + q
                own = words[i : i + length]
                smallest = not any(all(a == b for a, b in zip(own, own[p:])) for p in range(1, q))
                if smallest and length >= max(least, times * q):
                    out.append((i, length, q))
            i = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def dropped(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def samples():
    rng = random.Random(8)
    for _ in range(1500):
        letters = [bytes([97 + i]) for i in range(rng.choice([1, 2, 2, 3, 5]))]
        words = []
        while len(words) < rng.randint(0, 70):
            piece = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
            words += piece * rng.choice([1, 1, 2, 4, 5, 9])
        yield words
    yield [b"a"] * 300
    yield [b"a", b"b"] * 100 + [b"a"] * 20 + [b"b", b"a"] * 50
    fib = [b"a"]
    other = [b"a", b"b"]
    for _ in range(9):
        fib, other = other, other + fib
    yield other
    yield ([b"x"] * 5 + [b"y"]) * 12 + [b"x"] * 5


@pytest.mark.parametrize("least, times", [(6, 4), (3, 3), (20, 5)])
def test_equals_brute_force(least, times):
    rules = runs.RunRules(least, times)
    for words in samples():
        found = runs.find_runs(words, rules)
        assert found == brute(words, least, times), words
        assert runs.without_repeats(words, found) == dropped(words, found)


def test_long_texts_take_bounded_time():
    words = [b"a"] * 60_000
    assert runs.find_runs(words) == [(0, 60_000, 1)]
    rng = random.Random(1)
    block = [str(rng.randrange(50)).encode() for _ in range(5_000)]
    assert (0, 50_000, 5_000) in runs.find_runs(block * 10)
    apart = [w for i in range(3_000) for w in ([b"the", b"same", b"ten", b"words", b"come", b"back", b"here", b"again", b"and", b"again"] + [str(i).encode()])]
    assert runs.find_runs(apart) == []


def test_strongest_and_limits():
    assert runs.strongest([(0, 8, 2), (9, 12, 3), (30, 20, 5)]) == (0, 8, 2)
    assert runs.strongest([(0, 8, 2), (9, 6, 1)]) == (9, 6, 1)
    assert runs.strongest([]) is None
    with pytest.raises(ValueError):
        runs.RunRules(times=2)


def test_rows(spark):
    text = "go " * 8 + "on"
    rows = [(1, text, "x", 1), (1, text, "x", 2), (None, None, None, 3), (2, "", "", 4), (3, " \n\t\x1c a\x85b ", "", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, extra int")
    got = {r.extra: r for r in runs.repetitions(docs).collect()}
    assert got[1].runs[0].asDict() == {"start": 0, "length": 8, "period": 1} and got[1].collapsed == "go on" == got[2].collapsed
    assert got[3].runs == [] and got[3].top is None and got[3].collapsed == "" and got[3].doc_id is None
    assert got[5].collapsed == "\x1c a\x85b" and got[5].n_words == 2
    assert runs.repetitions(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in op12_word_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    planted = 0
    for row in docs:
        words = planted_period(row.doc_id, (row.text or "").encode().split())
        if len(words) > 600:
            continue
        found = brute(words)
        planted += bool(found)
        r = got[row.doc_id]
        assert r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(dropped(words, found))).hexdigest()
        if found:
            from fractions import Fraction

            best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (*best, 1000 * best[1] // best[2])
        else:
            assert r.start is None and r.length is None and r.period is None and r.exponent_milli is None
    assert planted > 5
