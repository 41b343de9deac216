"""Token pieces, both packings, the WARC archive and the URL filter against plain Python."""

import base64
import hashlib
import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracelake.llm import packing, tokens, url_filter, warc

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, world. It's a test_, a., b ., ;. don't 'S", "á b\tc\r\nd <|endoftext|>x ΑΣ.", "\x1c x\x85y\u00a0z\u200312345 ß İ  ", "Éa ÀB, naïve. ªº ŉ ǅ ². Ⅷ K Å ﬁ.",
    "<|ENDOFTEXT|> A<|endoftext|>", "x_. y. \u0301, z.\n.\n a\u0301. 5. 5,", "", "ONEDED!! han%%% e&&& ...", "word " * 3000, "日本語 текст, текст.",
]


def test_ids_equal_the_tokenizer():
    whole = Tokenizer.from_file(VOCABULARY)
    rnd = random.Random(4)
    made = ["".join(rnd.choice("abZé.,_'s \n\u0301<|>9²ß") for _ in range(rnd.randrange(40))) for _ in range(3000)]
    for t in TEXTS + made:
        assert np.frombuffer(tokens.encode(t, VOCABULARY), dtype="<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def one_by_one_best_fit(lengths, gaps, capacity):
    for n in sorted(lengths, reverse=True):
        at = bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        insort(gaps, gap - n)
    return sorted(gaps)


def one_by_one_matching(lengths, capacity):
    large, gaps = sorted((n for n in lengths if 3 * n > capacity), reverse=True), []
    while large:
        n = large.pop(0)
        mate = next((i for i, m in enumerate(large) if n + m <= capacity), None)
        insort(gaps, capacity - n - (large.pop(mate) if mate is not None else 0))
    return one_by_one_best_fit([n for n in lengths if 3 * n <= capacity], gaps, capacity)


def gaps_of(bins):
    return sorted(g for g, held in bins.open.items() for _, n in held for _ in range(n))


@pytest.mark.parametrize("seed", range(30))
def test_packings_equal_one_piece_at_a_time(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 64, 100, 257])
    lengths = [min(capacity, max(1, int(rnd.expovariate(1 / (capacity / rnd.choice([2, 4, 9])))))) for _ in range(rnd.randrange(1, 400))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    assert gaps_of(packing.best_fit_decreasing(histogram, capacity)) == one_by_one_best_fit(lengths, [], capacity)
    matched = packing.large_item_matching(histogram, capacity)
    assert gaps_of(matched) == one_by_one_matching(lengths, capacity)
    used = {}
    for length, first, n, copies, sequence, offset in matched.plan():
        for number in range(first, first + n):
            i, j = divmod(number - first, copies)
            used.setdefault(sequence + i, []).append((offset + j * length, length))
    assert sum(map(len, used.values())) == len(lengths)
    for held in used.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * n > capacity for _, n in held) <= 2


def test_pieces_and_matrix_give_the_documents_back(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "no id"), (77, None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS length", "2 AS sequence_id").repartition(3)
    whole = Tokenizer.from_file(VOCABULARY)
    want = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs}
    rows = packing.pack_pieces(frame, VOCABULARY, 64).collect()
    for r in rows:
        own = np.array(want[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.start == 64 * r.piece
    assert sum(r.length for r in rows) == sum(len(want[i]) for i, _ in docs)
    back = {}
    for r in packing.pack_matrix(frame, VOCABULARY, 64).collect():
        assert len(r.input_ids) == len(r.position_ids) == 64 and r.cu_seqlens[-1] == r.n_ids
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False)):
            assert r.position_ids[a:b] == list(range(b - a))
            back.setdefault(r.doc_ids[k], {}).setdefault(r.starts[k], []).append(r.input_ids[a:b])
    for i, ids in want.items():
        copies = [sum((back[i][s][k] for s in sorted(back[i])), []) for k in range(len(back[i][0]))]
        assert copies == [ids] * len(copies) and len(copies) == sum(d == i for d, _ in docs)
    assert packing.pack_pieces(frame.limit(0), VOCABULARY).count() == packing.pack_matrix(frame.limit(0), VOCABULARY).count() == 0


def test_large_offsets_table_is_shuffled_alike(spark, monkeypatch):
    frame = spark.createDataFrame([(i, "a b c " * (i % 7)) for i in range(200)], "doc_id bigint, text string").repartition(4)
    key = lambda rows: sorted((r.sequence_id, r.offset, r.length) for r in rows)
    before = key(packing.pack_pieces(frame, VOCABULARY, 32).collect())
    monkeypatch.setattr(packing, "BROADCAST_ROWS", -1)
    assert key(packing.pack_pieces(frame, VOCABULARY, 32).collect()) == before


def test_archive_gives_pages_back(spark, tmp_path):
    pages = [(3, "http://a/é x\r\ny", "<p>é</p>\r\n\r\nend"), (1, "http://b", "<p>é</p>\r\n\r\nend"), (2, None, None), (5, "http://c", ""), (5, "http://c", ""), (7, "http://d", "one"), (None, "http://e", "two"), (None, "http://f", "one")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "1 AS digest", "2 AS address")
    archive = warc.write(frame)
    got = sorted((r.page_id is None, r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(frame).collect() if r.page_id is not None)
    first = {"<p>é</p>\r\n\r\nend": 1, "": 2, "one": 7}
    want = sorted(
        (False, i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""])
        for i, _, h in pages if i is not None
    )
    assert got == want
    assert sorted((r.record_type, r.refers_to) for r in warc.round_trip(frame).where("page_id IS NULL").collect()) == [("response", None), ("revisit", 7)]
    assert archive.payloads.count() == 4
    warc.export(archive, str(tmp_path / "out"), records_per_file=2)
    read = warc.read(spark, str(tmp_path / "out")).collect()
    bodies = sorted(bytes(r.body).decode() for r in read if "WARC-Type: response" in r.header)
    assert len(read) == len(pages) and bodies == sorted(["<p>é</p>\r\n\r\nend", "", "one", "two"])
    assert warc.round_trip(frame.where("page_id = 7"), min_bytes=10).first().record_type == "response"
    small = warc.round_trip(frame.where("page_id = 5 OR page_id = 2"), min_bytes=1).collect()
    assert {r.record_type for r in small} == {"response"}
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_archive_of_hot_and_awkward_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(warc, "READ_BYTES", 1000)
    bodies = ["x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "é" * 5000, "", "\r\n\r\n", "one"]
    pages = [(i, None, "same page" if i % 3 == 0 else bodies[i % 5] + str(i % 7) * (i % 2)) for i in range(200)] + [(4, "u", "another under this id"), (4, "u", "another under this id")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "1 AS size", "2 AS header").repartition(3)
    first = {}
    for i, _, h in pages:
        first[h] = min(i, first.get(h, i))
    want = sorted((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if first[h] == i else "revisit", -1 if first[h] == i else first[h]) for i, _, h in pages)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in warc.round_trip(frame).collect())
    assert got == want


def test_records_that_lie_about_their_bytes_end_the_job(spark):
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 3\r\n\r\n"
    with pytest.raises(Exception, match="payload differs from its digest"):
        warc.index(spark.createDataFrame([(head, bytearray(b"abc"))], "header string, body binary")).collect()
    with pytest.raises(ValueError, match="does not end"):
        list(warc._cut(iter([head.encode() + b"abcd\r\n\r\n"])))


def test_rules_and_addresses(spark):
    urls = {
        "https://WWW.Example.com/en/a?x#y": ("www.example.com", "/en/a", "www.example.com/en/", "allow"), "http://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "x://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"), "x://a.net/es": ("a.net", "/es", None, "allow"),
        "http://a.com?b/c": ("a.com", "", None, "allow"), "a.com/en/": ("", "", None, "allow"), "http://É.com/a://b": ("É.com", "/a://b", "com/", "allow"), "": ("", "", None, "allow"),
    }
    frame = spark.createDataFrame([(u,) for u in [*urls, None]], "url string").selectExpr("*", "1 AS host", "2 AS n", "3 AS shape_")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(frame).collect()}
    assert got == urls | {None: ("", "", None, "allow")}
    assert url_filter.judge(frame.limit(0)).count() == 0


def test_templates_generalise_merge_and_reject(spark):
    rows = [(f"http://h.org/users/{'abcdefghijklmnopqrstuvwxy'[i % 25]}{'xyzuv'[i // 25]}/posts", None) for i in range(100)]
    rows += [(f"http://h.org/bets/{i}", i % 10 != 0) for i in range(60)] + [(f"http://h.org/news/{i}", False) for i in range(60)] + [(f"http://h.org/blog/{i}", False) for i in range(60)]
    frame = spark.createDataFrame(rows, "url string, bad boolean")
    out = {r.url: r for r in url_filter.judge(frame, bad="bad").collect()}
    assert out["http://h.org/users/ax/posts"].template == "/users/*/posts" and out["http://h.org/users/ax/posts"].verdict == "allow"
    assert out["http://h.org/bets/1"].template == "/bets/{n}" and out["http://h.org/bets/1"].verdict == "block"
    assert out["http://h.org/news/1"].verdict == "allow"
    alike = spark.createDataFrame([(f"http://k.org/{s}/{i}", i % 2 == 0) for s in ("a", "b") for i in range(40)], "url string, bad boolean")
    assert {r.template for r in url_filter.judge(alike, bad="bad").collect()} == {"/~/{n}"}


def test_the_memo_of_a_worker_stays_small():
    """A worker keeps the memo through later stages; at about 145 bytes a chunk."""
    memo = tokens._memo(VOCABULARY)
    memo.clear()
    memo.update((f"chunk {i}", b"") for i in range(500_000))
    assert np.frombuffer(tokens.encode("Hello world", VOCABULARY), dtype="<u4").tolist() == Tokenizer.from_file(VOCABULARY).encode("Hello world").ids
    assert len(memo) < 500_000
    memo.clear()
