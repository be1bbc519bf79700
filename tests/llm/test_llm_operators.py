"""The training-data operators on small tables: brute force, round trips, nulls, empty and repeated rows."""

import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest

from tidewire.llm import bpe, components, decontam, lines, quality, setjoin, shards, tokens, unigram, urls, warc
from tidewire.llm.queries import URL_RULES, vocabulary

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [
    "", " ", "  a  b \n\n c\t d", "x<|endoftext|> y<|endoftext|>", "don't we'll I'M", "a" * 700, "\x00\x1c\x85  é\u3000z",
    "=== ---- ....... !!!!!!!", "    def f(x):\n        return   x", "日本語 テスト 🎉🎉", "12 345 ½ ²", "<s> <0x0A> ▁▁x", "ΣΑΣ İstanbul e\u0301",
]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()
    rng = random.Random(5)
    letters = "ab th e\n\t 'sre0.1-=é日🎉<|>▁endoftext\x1c\xa0"
    return [r.text for r in rows] + ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]


def frame(spark, texts, ids=None):
    """Documents with further columns, whose names clash with results."""
    rows = [(i, t, None, "s", 7, 1, 2.0, True) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, score double, kept boolean")


EDGE = [None, "", "one two three", "same words here again and again now", "same words here again and again now", " \n\t "]
EDGE_IDS = [0, 1, 2, 3, 3, None]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


# -- 5: BPE ------------------------------------------------------------------------------------------------------
def test_bpe_equals_library(texts):
    theirs, ours = library("byte_bpe_50k.json"), bpe.load(vocabulary("byte_bpe_50k.json"))
    for text in texts:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_decodes_broken_sequences():
    theirs, ours = library("byte_bpe_50k.json"), bpe.load(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_refuses_other_files(tmp_path):
    with pytest.raises(ValueError):
        bpe.BacktrackingBpe(vocabulary("word_bpe_49k.json"))


def test_bpe_rows(spark):
    path = vocabulary("byte_bpe_50k.json")
    got = bpe.decode_ids(bpe.encode_texts(frame(spark, EDGE, EDGE_IDS), path), path).collect()
    assert [r.decoded for r in got] == [t or "" for t in EDGE]
    digests = bpe.round_trip_digests(frame(spark, EDGE, EDGE_IDS), path).collect()
    assert [r.doc_id for r in digests] == EDGE_IDS
    assert digests[0].ids_sha256 == hashlib.sha256(b"").hexdigest() and digests[0].n_tokens == 0
    assert bpe.round_trip_digests(frame(spark, []), path).count() == 0


# -- 9: unigram counts -------------------------------------------------------------------------------------------
def test_unigram_counts_equal_library(spark, texts):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = unigram.piece_vocabulary(vocabulary("piece_bpe_32k.model"))
    theirs = Tokenizer(models.Unigram(pieces, 0, True))
    theirs.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    ours = unigram.CountingUnigram(pieces)
    assert [ours.count(t) for t in texts] == [len(theirs.encode(t, add_special_tokens=False).ids) for t in texts]
    got = unigram.count_tokens(frame(spark, EDGE, EDGE_IDS), vocabulary("piece_bpe_32k.model")).collect()
    assert [r.n_tokens for r in got][:2] == [0, 0] and len(got) == len(EDGE)


def test_unigram_ties_and_unknown_runs():
    from tokenizers import Tokenizer, models

    # equal sums: "ab"+"c", "a"+"bc"; characters without a piece: z, é
    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0), ("▁", -1.0)]
    for fallback in (False, True):
        theirs = Tokenizer(models.Unigram(pieces, 0, fallback))
        ours = unigram.CountingUnigram(pieces, 0, fallback)
        for word in ("abc", "ababc", "zz", "azéb", "abzzbcz", "cabcabcz"):
            assert ours.count_word(word) == len(theirs.encode(word).ids)


# -- 1: token files ----------------------------------------------------------------------------------------------
def test_token_files(spark, texts):
    theirs, path = library("word_bpe_49k.json"), vocabulary("word_bpe_49k.json")
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    docs = frame(spark, texts, ids).repartition(5)
    files = tokens.write_tokens(docs, path, 1)
    got = tokens.read_tokens(files, digests=True).orderBy("doc_id").collect()
    start = 0
    for row, (doc_id, text) in zip(got, sorted(zip(ids, texts)), strict=True):
        own = [*theirs.encode(text, add_special_tokens=False).ids, 1]
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, start, len(own))
        assert row.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        start += len(own)
    two = tokens.read_tokens(files, {ids[0], ids[1]}).collect()
    assert {r.doc_id for r in two} == {ids[0], ids[1]}


def test_token_rows(spark):
    path = vocabulary("word_bpe_49k.json")
    got = tokens.token_file_digests(spark, frame(spark, EDGE, EDGE_IDS), path, 1).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((i is not None, i or 0) for i in EDGE_IDS)
    assert next(r for r in got if r.doc_id == 0).n_tokens == 1
    assert tokens.token_file_digests(spark, frame(spark, []), path, 1).count() == 0


def test_token_frames_are_checked():
    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    out = io.BytesIO()
    writer = tokens.TokenWriter(out, "<u2", frame_tokens=4)
    docs = [np.arange(n, dtype="<u2") for n in (0, 3, 5, 1, 0, 2)]
    for i, own in enumerate(docs):
        writer.add(i, own.tobytes())
    writer.close()
    raw = out.getvalue()
    got = list(tokens.TokenReader(File(raw)).read())
    assert [g[0] for g in got] == list(range(6)) and all((a == b).all() for (_, a), b in zip(got, docs))
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == b"".join(d.tobytes() for d in docs)
    reader = tokens.TokenReader(File(raw))
    reader.sums = reader.sums.copy()
    reader.sums[0] += 1
    with pytest.raises(ValueError):
        reader.frame(0)


# -- 2: archives -------------------------------------------------------------------------------------------------
def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, file string")


def test_archives(spark):
    long_ = "<html>" + "é" * 200
    rows = [(5, "http://a/b c", long_, None), (3, "http://x/", long_, None), (9, None, long_, None), (1, "u", "short", None), (2, "u", "short", None), (4, "http://q", None, None), (None, "http://n", long_, None), (7, "http://n", "y" * 99, "f"), (8, "http://n", "y" * 99, "f")]
    got = {r.page_id: r for r in warc.convert_pages(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for page_id, _, html, _ in rows:
        raw = (html or "").encode()
        assert (got[page_id].payload_bytes, got[page_id].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {5: 3, 9: 3}
    assert warc.convert_pages(pages(spark, [])).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    bodies = [b"HTTP/1.1 200 OK\r\nX-Row: 1\r\n\r\nbody\n\nwith lines", b"plain", b""]
    data = warc.arc_header(version, "n.arc", "20000101000000")
    for i, body in enumerate(bodies):
        data += warc.arc_record(version, "n.arc", len(data), f"http://h/{i}", "20240229", 200, body)
    got = list(warc.read_arc(data))
    assert [r.body for r in got] == bodies and [r.url for r in got] == [f"http://h/{i}" for i in range(3)]
    assert [r.status for r in got] == [None if version == 1 else "200"] * 3
    with pytest.raises(ValueError):
        list(warc.read_arc(data[:-3]))
    with pytest.raises(ValueError):
        list(warc.read_arc(data + b"http://h/ 1 2\n"))


def test_legacy_arc_lines_and_errors(spark):
    """Urls in Latin-1 and with blanks; a wrong length and junk between records cost one record each."""
    head = warc.arc_header(1, "n.arc", "20000101000000")
    good = [("http://h/caf\u00e9 au lait".encode("latin-1"), b"one"), (b"http://h/2", b"two\n\nlines"), ("http://h/\u65e5".encode(), b"three")]
    parts = [url + b" 1.2.3.4 20240229 text/html " + str(len(body)).encode() + b"\n" + body + b"\n" for url, body in good]
    data = head + parts[0] + b"http://bad/ 1.2.3.4 20240229 text/html 99999\nshort\n" + parts[1] + b"no record line\n" + parts[2] + b"cut off"
    errors = []
    got = list(warc.read_arc(data, errors))
    assert [(r.url, r.body) for r in got] == [("http://h/caf\u00e9 au lait", b"one"), ("http://h/2", b"two\n\nlines"), ("http://h/\u65e5", b"three")]
    assert len(errors) == 3
    table = spark.createDataFrame([("a", data), ("b", gzip.compress(head + parts[1])), ("c", None), ("d", b"")], "name string, content binary")
    assert sorted((r.uri, r.payload_bytes) for r in warc.arc_records(table).collect()) == sorted([("http://h/caf\u00e9 au lait", 3), ("http://h/2", 10), ("http://h/\u65e5", 5), ("http://h/2", 10)])
    assert {(r.name, r.offset) for r in warc.arc_errors(table).collect()} == {("a", e[0]) for e in errors}


def test_warc_dates_and_records():
    assert warc.warc_date("20240229") == "2024-02-29T00:00:00Z"
    assert warc.warc_date("2024022912") == "2024-02-29T12:00:00Z"
    assert warc.warc_date("nonsense") == "1970-01-01T00:00:00Z"
    raw = warc.warc_record([("WARC-Type", "resource"), ("X", None)], b"\r\n\r\nWARC/1.1")
    assert next(warc.read_warc(io.BytesIO(raw)))[1] == b"\r\n\r\nWARC/1.1"
    assert next(warc.read_warc(io.BytesIO(gzip.decompress(raw))))[0]["warc-type"] == "resource"


# -- 3: quality --------------------------------------------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs.select("doc_id", "text"), labels)
    rows = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out()).collect()
    assert all(quality.is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    good = [r.predicted for r in rows if r.quality == 1]
    assert sum(good) >= 0.98 * len(good)


def test_quality_edges(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, EDGE, EDGE_IDS)
    assert [r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()] == [0.5] * len(EDGE)
    one = spark.createDataFrame([(i, 1, None) for i in range(9)] + [(None, 0, 1), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    assert all(r.predicted == 1 for r in quality.score(docs, quality.fit(docs, one)).collect())
    assert quality.score(frame(spark, []), quality.fit(docs, one)).count() == 0


# -- 4: urls -----------------------------------------------------------------------------------------------------
def brute_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0].translate(LOWER)
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    fitting = [r for r in URL_RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fitting, key=len, default=None)


def test_url_rules(spark):
    given = [None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/en", "http://xexample.net/en/", "http://b.example.com/de/1#q", "http://org/fr/", "http://k.org/FR/", "x://y://z.net/p", "http://net?/", "http://a.net/", "http://ÄB.net/ä", "http://" + "q" * 90 + ".org/fr/"]
    rows = [(i, u, "<p>good words only</p>", "f") for i, u in enumerate(given)] + [(1, "", None, None)]
    got = urls.judge(pages(spark, rows).withColumnRenamed("file", "rule"), URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule) == brute_rule(r.url)
        assert r.verdict == (URL_RULES[r.rule] if r.rule else "allow")
    assert urls.judge(pages(spark, []), URL_RULES).count() == 0


def test_url_words_decide(spark):
    bad = "<p>" + "buy### now*** cheap$$$ " * 30 + "</p>"
    good = "<p>" + "cheap pills and news of the garden club " * 30 + "</p>"
    rows = [(i, f"http://cheappills{i % 3}.example.xyz/a/{i}", bad, None) for i in range(20)] + [(50 + i, f"http://gardennews.example.xyz/b/{i}", good, None) for i in range(40)]
    got = {r.page_id: r.verdict for r in urls.judge(pages(spark, rows + [(99, "http://cheap-pills.other.xyz/", "", None)]), {}).collect()}
    assert got[0] == "block" and got[99] == "block" and got[50] == "allow"
    assert urls.best_split("gardennews", {"garden": 5, "news": 5, "den": 9, "new": 2}, 100) == ["garden", "news"]


def test_url_words_decide_without_noise(spark):
    text = "<p>" + "win free news of the garden club " * 30 + "</p>"
    rows = [(i, f"http://m.casino-win{i % 2}.example.xyz/a/{i}", text, None) for i in range(6)]
    rows += [(10 + i, f"http://gardennews{i % 3}.example.xyz/a/{i}", text + " $$$ ###" * (200 * (i % 4 == 0)), None) for i in range(60)]
    got = {r.page_id: r.verdict for r in urls.judge(pages(spark, rows), {}).collect()}
    assert {i for i, verdict in got.items() if verdict == "block"} == set(range(6))


# -- 6: Jaccard join ---------------------------------------------------------------------------------------------
def brute_sets(texts):
    out = {}
    for i, t in texts.items():
        w = SPACE.findall((t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_components(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = sorted(sets)
    for x in keys:
        for y in keys:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_jaccard_components(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    texts = {}
    for base in range(12):
        own = [rng.choice(vocab) for _ in range(rng.choice([4, 8, 30, 60, 120]))]
        for _ in range(rng.choice([1, 2, 25])):
            copy = list(own)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            if rng.random() < 0.3:
                copy += [rng.choice(vocab) for _ in range(rng.randint(1, 20))]
            texts[len(texts)] = " ".join(copy)
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    for _ in range(30):
        texts[len(texts)] = passage + "\n" + " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 80)))
    texts |= {1000: None, 1001: "", 1002: "One two", 1003: "one TWO", 1004: "É x", 1005: "é x", 1006: "\x0b "}
    sets = brute_sets(texts)
    want = {i: (len(sets[i]), c) for i, c in brute_components(sets).items()}
    docs = frame(spark, list(texts.values()), list(texts)).repartition(4)
    got = setjoin.link_components(docs).collect()
    assert len(got) == len(texts) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_edges(spark):
    got = setjoin.link_components(frame(spark, EDGE, EDGE_IDS)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted([("0", 0, "0"), ("1", 0, "1"), ("2", 1, "2"), ("3", 3, "3"), ("3", 3, "3"), ("None", 0, "None")])
    assert setjoin.link_components(frame(spark, [])).count() == 0


def test_components_of_chains(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(500, 560), rng.randrange(500, 560)) for _ in range(40)]
    sets: dict[int, set[int]] = {}
    for a, b in links:
        joined = sets.get(a, {a}) | sets.get(b, {b})
        for x in joined:
            sets[x] = joined
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: min(sets[x]) for x in touched}


# -- 7: lines ----------------------------------------------------------------------------------------------------
def test_shared_lines_reject_depleted_documents(spark):
    rng = random.Random(4)

    def sentence(n):
        return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))

    menu = ["Home about contact news and more things here", "Terms of use and privacy notice of this site today"]
    body = [sentence(40) for _ in range(3)]
    texts = ["\n".join([menu[0], sentence(60), menu[1]]) for _ in range(40)]  # much of their own
    texts += ["\n".join([menu[0].upper(), f"id{i} x{i}", menu[1]]) for i in range(6)]  # next to nothing of their own
    copies = ["\n".join(body[:2] + [" ".join(w if k != i else f"q{i}" for k, w in enumerate(body[2].split()))]) for i in range(30)]
    texts += copies + [body[0] + "\n" + body[1]] * 30  # near copies and copies of one document
    got = {r.doc_id: r for r in lines.judge(frame(spark, texts)).collect()}
    assert all(got[i].kept and got[i].removed_words == 18 for i in range(40))
    assert all(not got[i].kept and not got[i].base_failed for i in range(40, 46))
    assert all(got[i].kept for i in range(46, len(texts)))
    kept = {r.doc_id: r.text for r in lines.without_lines(frame(spark, texts)).collect()}
    assert kept[40] == "id0 x0" and kept[50] == texts[50]


def made_sentence(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_shared_lines_without_richer_documents(spark):
    rng = random.Random(7)
    shared = [made_sentence(rng, 20) for _ in range(5)]
    texts = ["\n".join([*shared, f"id{i}"]) for i in range(30)]  # hardly anything of their own, and nothing richer beside them
    texts += [made_sentence(rng, 60) for _ in range(300)]
    got = {r.doc_id: r for r in lines.judge(frame(spark, texts)).collect()}
    assert all(got[i].removed_words == 100 and not got[i].kept for i in range(30))
    assert all(got[i].kept and got[i].removed_words == 0 for i in range(30, len(texts)))


def test_edited_copies_change_no_other_verdict(spark):
    rng = random.Random(8)
    notice = made_sentence(rng, 20)
    texts = [f"{notice}\n{made_sentence(rng, 3)}" for _ in range(15)]  # 15 of 515 documents
    texts += [made_sentence(rng, 60) for _ in range(500)]
    body = [made_sentence(rng, 60).split(" ") for _ in range(2)]
    copies = ["\n".join(" ".join(w if k != i % 60 or half != i // 60 % 2 else f"q{i}" for k, w in enumerate(part)) for half, part in enumerate(body)) for i in range(400)]
    alone = {r.doc_id: (r.removed_words, r.kept) for r in lines.judge(frame(spark, texts)).collect()}
    beside = {r.doc_id: (r.removed_words, r.kept) for r in lines.judge(frame(spark, texts + copies)).collect()}
    assert alone == {i: beside[i] for i in range(len(texts))}
    assert all(alone[i] == (20, False) for i in range(15))
    assert all(beside[i] == (0, True) for i in range(len(texts), len(texts + copies)))


def test_line_counts(spark):
    texts = [None, "", "a b c d e x a b c d e", "É#é $|\n \n\t\nx y\nx y\nX y\nx y ", "one " * 30]
    got = {r.doc_id: r for r in lines.judge(frame(spark, texts)).collect()}
    assert [got[i].n_words for i in range(5)] == [0, 0, 11, 10, 30]
    assert got[2].n_repeat_words == 10 and got[4].n_repeat_words == 30 and got[4].base_failed
    assert (got[3].word_chars, got[3].n_symbols, got[3].n_dup_lines) == (13, 3, 1)
    assert got[0].base_failed and not got[0].kept
    assert lines.judge(frame(spark, [])).count() == 0


# -- 8: shards ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("giant", [1, 90])
def test_shards_are_even_and_keep_copies_together(spark, giant):
    texts = [f"t{i // 3} é" for i in range(150)] + ["giant"] * giant + [None, "", "x"]
    rows = shards.assign(frame(spark, texts).repartition(3), 24).collect()
    assert len(rows) == len(texts)
    by: dict[int, list[int]] = {}
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "rows", None)
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_copies_meet_where_shards_have_room(spark):
    texts = [f"t{i // 3} é" for i in range(150)] + [f"alone {i}" for i in range(600)]
    rows = shards.assign(frame(spark, texts).repartition(3), 24).collect()
    cut = sum(len({r.shard for r in rows if texts[r.doc_id] == t}) - 1 for t in set(texts[:150]))
    assert cut <= 5  # of 100 links, of which a random deal cuts about 96


def test_shards_edges(spark):
    assert shards.assign(frame(spark, []), 24).count() == 0
    got = shards.assign(frame(spark, EDGE, EDGE_IDS), 24).collect()
    assert len(got) == len(EDGE) and len({r.shard for r in got}) == len(EDGE)


# -- 10: decontamination -----------------------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items):
    w = TERM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item_id, item in items:
        own = TERM.findall((item or "").translate(LOWER))
        size = min(13, len(own))
        for k in range(max(1, len(own) - 12) if own else 0):
            for at in range(len(w) - size + 1):
                if w[at : at + size] == own[k : k + size]:
                    hit |= set(range(at, at + size))
                    found.add(item_id)
    found.discard(None)
    listed = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 200])
def test_decontamination(spark, block, monkeypatch):
    monkeypatch.setattr(decontam.blocks, "__defaults__", (decontam.WINDOW, block))
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 5, 13, 20, 40])))) for i in range(12)]
    items += [(None, "odd item without id"), (50, None), (51, ""), (52, "--"), (3, items[3][1]), (60, "same same"), (61, "Same, same")]
    texts = [None, "", "...", "odd item without id", "same same same"]
    for _ in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randint(0, len(w))
            own = rng.choice(items[:12])[1].split()
            w[at:at] = own[rng.choice([0, 0, 4]) :]
        texts.append("; ".join(w).replace("w1", "W1"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in decontam.judge(frame(spark, texts).repartition(3), bench).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_hits(text, items), i


def test_longest_matches(spark):
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, "x y")], "item_id bigint, text string")
    docs = frame(spark, ["q a b c d z x y", "b c d e f a b c d e f q", "a b c"], [5, 6, 7])
    got = {(r.item_id, r.item_word): (r.n_words, r.doc_id, r.doc_word) for r in decontam.matches(docs, bench).collect()}
    assert got[1, 0] == (6, 6, 5) and got[1, 1][0] == 5 and got[2, 0] == (2, 5, 6)


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 60])
def test_longest_matches_equal_brute_force(spark, monkeypatch, block):
    """Short matches, matches shorter than any window, and equal ones in several rows and shards."""
    monkeypatch.setattr(decontam.blocks, "__defaults__", (decontam.WINDOW, block))
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(9)] + ["Rare", "x"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 14, 30])))) for i in range(9)] + [(9, "nowhere seen"), (10, None), (11, "--")]
    texts = [None, ""] + ["; ".join(rng.choice(vocab[:9]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += [items[3][1], "q " + items[3][1], items[6][1] + " " + items[4][1]]
    ids = [*range(100, 100 - len(texts), -1)]
    own = {i: TERM.findall((t or "").translate(LOWER)) for i, t in zip(ids, texts)}
    want = {}
    for item_id, text in items:
        words_ = TERM.findall((text or "").translate(LOWER))
        for k in range(len(words_)):
            found = []
            for i, w in own.items():
                for at in range(len(w)):
                    n = 0
                    while k + n < len(words_) and at + n < len(w) and words_[k + n] == w[at + n]:
                        n += 1
                    if n:
                        found.append((-n, i, at))
            if found:
                want[item_id, k] = min(found)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(spark, texts, ids).repartition(3)
    got = {(r.item_id, r.item_word): (-r.n_words, r.doc_id, r.doc_word) for r in decontam.matches(docs, bench).collect()}
    assert got == want
    best = {r.item_id: (-r.n_words, r.item_word, r.doc_id, r.doc_word) for r in decontam.longest_per_item(docs, bench).collect()}
    assert best == {i: min((v[0], k, *v[1:]) for (j, k), v in want.items() if j == i) for i in {j for j, _ in want}}


def test_decontamination_without_items(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in decontam.judge(frame(spark, EDGE, EDGE_IDS), bench).collect())
    assert decontam.judge(frame(spark, []), bench).count() == 0


# -- pipeline ----------------------------------------------------------------------------------------------------
def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    by_rules = {r.doc_id for r in lines.judge(docs).where("kept").collect()}
    table = docs.where(docs.doc_id.isin(list(by_rules)))
    good = {r.doc_id for r in quality.score(table, quality.fit(table, labels)).where("predicted = 1").collect()}
    comps = brute_components(brute_sets({i: kept[i] for i in good}))
    first = {i for i in good if comps[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {i for i in first if not brute_hits(kept[i], items)[4]}
    theirs = library("byte_bpe_50k.json")
    got = {r.doc_id: r for r in p.run(spark, sf_dir).collect()}
    assert set(got) == clean and 0 < len(clean) < len(kept)
    for i in clean:
        ids = theirs.encode(kept[i], add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(kept[i].encode()).hexdigest()


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as p

    docs = frame(spark, EDGE + ["a fine long sentence of more than ten words that stands here"] * 3, EDGE_IDS + [8, 9, 9]).drop("n_words", "score", "kept")
    kept = p.near_duplicates(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["0", "1", "2", "3", "8", "None"]
    assert {r.doc_id for r in p.quality_rules(spark, docs, "").collect()} == {8, 9}
