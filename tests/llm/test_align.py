"""Alignment of two tokenizers: brute force over whole texts, cut texts, both ways of counting, odd rows."""

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidewire.llm import align
from tidewire.llm.queries import vocabulary

NAMES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
ODD = [
    None, "", " ", "  a  b \n\n c\t d", "x<|endoftext|> y", "don't we'll I'M", "a" * 700, "\x00\x1c\x85  é　z", "foo ", "é ﬁ Ａ",
    "▁x", "a ▁ b", "日本語 テスト 🎉🎉", "日本語テスト。" * 40, "<s> <0x0A> </s>", "12 345 ½ ²", "==== ---- !!!!", "tie tie tie", "\n", "\n\n x",
]


@pytest.fixture(scope="module")
def paths():
    return tuple(vocabulary(n) for n in NAMES)


@pytest.fixture(scope="module")
def brute(paths):
    """Groups of a whole text, from the libraries and plain Python."""
    import sentencepiece
    from tokenizers import Tokenizer

    from tidewire.llm.bpe import byte_letters

    first = Tokenizer.from_file(paths[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    letters = byte_letters()
    spelled = {i: bytes(letters[c] for c in t) for t, i in first.get_vocab().items() if all(c in letters for c in t)}

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        a = [(i, spelled[i]) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, piece(i)) for i in second.encode(text)]
        if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
            return []
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, x in side:
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        out = [([], []) for _ in cuts]
        for kind, side in enumerate(spans):
            for s in side:
                out[bisect.bisect_left(cuts, s[1])][kind].append(s)
        return out

    return groups


def expected(brute, texts):
    found = [brute(t) for t in texts]
    links = [[(x[2], y[2]) for a, b in groups for x in a for y in b if x[0] < y[1] and y[0] < x[1]] for groups in found]
    counts = Counter(p for own in links for p in own)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for groups, own in zip(found, links):
        shown = ";".join(",".join(str(x[2]) for x in a) + "|" + ",".join(str(y[2]) for y in b) for a, b in groups)
        out.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(own),
            sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own),
            hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return out


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def made(spark, sf_dir):
    rng = random.Random(4)
    letters = ["ab", "th", "e", "\n", " ", "  ", "'s", "re", "0", ".", "=", "é", "日本", "。", "🎉", "<|", "\x1c", "\xa0", "'"]
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").orderBy("doc_id").collect()]
    return texts[:120] + ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(150)]


@pytest.mark.parametrize("lookup", [align.LOOKUP_PAIRS, 0])
def test_equals_brute_force(spark, sf_dir, paths, brute, monkeypatch, lookup):
    texts = made(spark, sf_dir)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, row string, n_a bigint").repartition(3)
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in align.align(docs, *paths, lookup_pairs=lookup).collect()}
    assert [got[i] for i in range(len(texts))] == expected(brute, texts)


def test_cut_texts_equal_whole_ones(spark, sf_dir, paths, brute, monkeypatch):
    """Every text is cut into tiny ranges; the tree has several levels."""
    texts = [t for t in made(spark, sf_dir) if t is None or len(t) < 4000] + ["no cut" + "a" * 900 + "b" * 500, "long tail " * 300]
    monkeypatch.setattr(align, "LONG", 60)
    model = align.load(*paths)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    with monkeypatch.context() as m:
        m.setattr(align, "RANGE", 25)
        ranges = {}
        for i, t in enumerate(texts):
            if t and len(t.encode()) > 60:
                ranges[i] = list(align._ranges(model, t))
    assert max(len(r) for r in ranges.values()) > 100
    # tasks import the module anew, so ranges are made here and handed in
    rows = [(i, *r) for i, own in ranges.items() for r in own]
    table = spark.createDataFrame(rows, "row bigint, k bigint, part string, byte bigint, a0 bigint, a1 bigint, b0 bigint, b1 bigint")
    monkeypatch.setattr(align, "_cut", lambda long, paths: table.join(long.select("row", "doc_id"), table.row == long.doc_id).select(long.row, *table.columns[1:]))
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in align.align(docs, *paths).collect()}
    assert [got[i] for i in range(len(texts))] == expected(brute, texts)
    spelled = {}
    for r in sorted(align.aligned_groups(docs, *paths).collect(), key=lambda r: (r.doc_id, r.start)):
        spelled[r.doc_id] = f"{spelled[r.doc_id]};{r.listed}" if r.doc_id in spelled else r.listed
    assert {i: hashlib.sha256(s.encode()).hexdigest() for i, s in spelled.items()} == {i: v[-1] for i, v in got.items() if v[-1]}


def test_composing_is_associative(paths):
    rng = random.Random(9)
    model = align.load(*paths)
    for _ in range(200):
        ends = [sorted(rng.sample(range(1, 40), rng.randint(1, 25)) + [40]) for _ in range(2)]
        tokens = [np.array([(e << 20) + i for i, e in enumerate(own)], np.int64) for own in ends]
        cuts = [sorted(rng.choices(range(len(own) + 1), k=4)) for own in tokens]
        parts = [align.fragment(tuple(t[a:b] for t, (a, b) in zip(tokens, span)), True, k == 0)
                 for k, span in enumerate(zip(*(zip([0, *c], [*c, len(t)]) for c, t in zip(cuts, tokens))))]
        closed = [c for _, c in parts]

        def fold(own):
            if len(own) == 1:
                return own[0]
            at = rng.randint(1, len(own) - 1)
            both, middle = align.compose(fold(own[:at]), fold(own[at:]))
            closed.append(middle)
            return both

        whole = fold([f for f, _ in parts])
        assert whole.bound and not any(len(x) for x in (*whole.head, *whole.tail))
        found = sorted(int(e) for a, b in closed for e in np.intersect1d(a >> 20, b >> 20))
        assert found == sorted(set(ends[0]) & set(ends[1]))
    assert model.sizes[0] > 50_000


def test_rows_and_empty_table(spark, paths):
    rows = [(None, "one two"), (3, "one two"), (3, "one two"), (4, None)]
    got = align.align(spark.createDataFrame(rows, "doc_id bigint, text string"), *paths).collect()
    assert sorted((r.doc_id or -1, r.n_links, r.count_sum) for r in got) == [(-1, 2, 6), (3, 2, 6), (3, 2, 6), (4, 0, 0)]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert align.align(empty, *paths).count() == 0 and align.aligned_groups(empty, *paths).count() == 0


def test_a_real_long_text(spark, sf_dir, paths, brute):
    text = " ".join(t for t in made(spark, sf_dir)[:200] if t and "▁" not in t)[: 3 * align.LONG]
    got = align.align(spark.createDataFrame([(1, text), (2, "short one")], "doc_id bigint, text string"), *paths).collect()
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in got}
    assert [got[1], got[2]] == expected(brute, [text, "short one"])
