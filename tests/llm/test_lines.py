"""Line rules against a brute-force version of the whole rule."""

import random
from collections import defaultdict

import pytest

from tidewire.llm import lines

from test_llm_operators import brute_components, brute_sets  # noqa: E402


def brute(rows, least=10, percent=2, copy_percent=25):
    """Removed words of each row (host, text), by definition."""

    def keyed(text):
        own = defaultdict(int)
        for row in lines.line_words(text):
            own[lines.normal(row)] += len(row)
        return own

    docs = sorted({(h, t or "") for h, t in rows}, key=str)
    own = {t: keyed(t) for _, t in docs}

    def hot(cls):
        counts, totals = defaultdict(set), defaultdict(set)
        for h, t in docs:
            totals[h].add(cls(h, t))
            for k in own[t]:
                counts[h, k].add(cls(h, t))
        return {k for k, v in counts.items() if len(v) > least and 100 * len(v) > percent * len(totals[k[0]])}

    def removed(found, h, t):
        return sum(n for k, n in own[t].items() if (h, k) in found)

    first = hot(lambda h, t: t)
    near = {(h, t) for h, t in docs if removed(first, h, t) and 100 * removed(first, h, t) >= copy_percent * sum(own[t].values())}
    texts = sorted({t for _, t in near}, key=lambda t: lines.hashlib.md5(t.encode()).hexdigest()[:15])
    comps = brute_components(brute_sets(dict(enumerate(texts))))
    classes = {}
    for i, t in enumerate(texts):
        lead = texts[comps[i]]
        if sum(c == comps[i] for c in comps.values()) == 1:
            continue
        known = {w for k in own[lead] for w in k.split(" ")}
        classes[t] = (lead, tuple(sorted(k for k in own[t] if 2 * sum(w not in known for w in k.split(" ")) > len(k.split(" ")))))
    final = hot(lambda h, t: classes.get(t, t) if (h, t) in near else t)
    return [removed(final, h, t or "") for h, t in rows]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)

    def sentence(n):
        return " ".join(f"w{rng.randrange(900)}" for _ in range(n))

    menu = [sentence(8) for _ in range(3)]
    rows = []
    for host in ["a", "b", None]:
        rows += [(host, "\n".join([sentence(rng.randint(5, 40)), *rng.sample(menu, rng.randint(0, 3))])) for _ in range(40)]
        rows += [(host, "\n".join([*menu, f"id{i}"])) for i in range(rng.choice([0, 14]))]
        for _ in range(2):
            body = [sentence(30).split(" ") for _ in range(3)]
            for _ in range(rng.choice([3, 25])):
                part = [list(x) for x in body]
                for _ in range(rng.randint(0, 2)):
                    rng.choice(part)[rng.randrange(30)] = f"q{rng.randrange(99)}"
                rows.append((host, "\n".join(" ".join(x) for x in part)))
        rows += [(host, None), (host, ""), (host, "")] + rows[-2:]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in lines.judge(docs).collect()}
    want = brute(rows)
    assert [got[i].removed_words for i in range(len(rows))] == want and sum(map(bool, want)) > 20
    kept = sorted(i for i in got if got[i].kept)
    assert sorted(r.doc_id for r in lines.kept_rows(docs).collect()) == kept


def test_large_components_are_dealt_to_groups(spark, monkeypatch):
    monkeypatch.setattr(lines, "MEMBERS", 4)
    rng = random.Random(3)
    body = [f"w{rng.randrange(900)}" for _ in range(60)]
    texts = [" ".join(w if k != i else f"q{i}" for k, w in enumerate(body[:40])) + "\n" + " ".join(body[40:]) for i in range(30)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "__digest bigint, text string")
    got = {r["__digest"]: r["class"] for r in lines.copy_classes(table).collect()}
    assert set(got) == set(range(30)) and set(got.values()) == {0}


def test_odd_hosts_and_columns(spark):
    rows = [(1, "a b c\nd", 5, "x", 1), (1, "a b c\nd", 5, "x", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, place int, removed string, kept int")
    got = lines.judge(docs, host="place").collect()
    assert len(got) == 3 and all(r.kept is False and r.base_failed for r in got)
    assert lines.kept_rows(docs, host="place").count() == 0
    assert lines.without_lines(docs, host="place").columns == docs.columns
