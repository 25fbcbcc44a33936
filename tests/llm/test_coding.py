"""Encoding, packing and sharding against the tokenizers library and plain Python."""

import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from vacatlas.llm import bpe, packing, sharding

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library():
    r, codec, by_library = random.Random(1), bpe.Codec(PATH), bpe.Codec(PATH, library=True)
    assert by_library.encoding is not None
    parts = ["a", "b", "A", " ", "  ", "\n", "\t", " ", "é", "ß", "漢", "😀", "1", "23", "'s", "'ll", "don't", "aaaa", "the", "----",
             "<|endoftext|>", "<|", "\r\n", "\x00", "ing", "tion", "́", "٣", "!!", "((", "​", "====" * 9, "th" * 20]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        ids = ids_of(text)
        assert codec.encode(text) == by_library.encode(text) == struct.pack(f"<{len(ids)}I", *ids), text
        assert codec.decode(codec.encode(text)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_a_full_memo_changes_nothing():
    codec = bpe.Codec(PATH)
    codec.of_word.most = codec.of_piece.most = codec.fits.most = 3
    text = "Some words that come again, and some words that do not: again."
    assert list(struct.unpack(f"<{len(codec.encode(text)) // 4}I", codec.encode(text))) == ids_of(text)


def test_the_library_coder_remembers_few_words(monkeypatch):
    monkeypatch.setattr(bpe, "LIBRARY_MEMO", 3)
    c = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"), library=True)
    text = "one two three four five six seven two nine six"
    assert list(struct.unpack(f"<{len(c.encode(text)) // 4}I", c.encode(text))) == ids_of(text) and len(c.of_word) == 3


def test_encode_whole_table(odd_docs, no_docs):
    got = bpe.encode(odd_docs, PATH).collect()
    assert sorted((repr(r.doc_id), r.ids) for r in got) == sorted(
        (repr(r.doc_id), struct.pack(f"<{len(ids_of(r.text))}I", *ids_of(r.text))) for r in odd_docs.collect())
    assert {r.decoded for r in got} == {r.text or "" for r in odd_docs.collect()}
    assert bpe.digests(odd_docs, PATH).count() == odd_docs.count() and bpe.digests(no_docs, PATH).count() == 0


def test_pieces_are_cut_at_the_front():
    assert packing.cut(5, 2) == [(0, 1), (1, 2), (3, 2)]
    assert packing.cut(4, 2) == [(0, 2), (2, 2)] and packing.cut(1, 2) == [(0, 1)]


def test_plan_is_as_good_as_best_fit_over_pieces():
    r = random.Random(2)
    for _ in range(60):
        histogram = {r.randint(1, 100): r.randint(1, 40) for _ in range(r.randint(1, 40))}
        fill, ranks = defaultdict(list), defaultdict(list)
        for length, a, b, first, copies, at in packing.plan(histogram, 100):
            for k in range(a, b):
                ranks[length].append(k)
                fill[first + (k - a) // copies].append((at + (k - a) % copies * length, length))
        assert {n: sorted(x) for n, x in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
        for own in fill.values():
            at = 0
            for start, length in sorted(own):
                assert start == at
                at += length
            assert at <= 100
        bins = []
        for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
            room = [(free, i) for i, free in enumerate(bins) if free >= n]
            if room:
                bins[min(room)[1]] -= n
            else:
                bins.append(100 - n)
        assert len(fill) <= len(bins) + 1


def test_pack_places_every_token_once(odd_docs, no_docs):
    size = 256
    got = packing.pack(odd_docs, PATH, size=size, end_id=0, with_ids=True).collect()
    want = sorted(struct.pack(f"<{len(x)}I", *x) for x in ([*ids_of(r.text), 0] for r in odd_docs.collect()))
    whole = defaultdict(int)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and 4 * r.length == len(r.ids) and 0 < r.length <= size
        assert r.length == size or r.piece == 0
        whole[r.ids] += 1
    assert sum(r.length for r in got) * 4 == sum(map(len, want))
    for ids in want:  # each document's pieces are there
        for start, n in packing.cut(len(ids) // 4, size):
            whole[ids[4 * start:4 * (start + n)]] -= 1
    assert not any(whole.values())
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for own in fill.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at <= size
    assert packing.pack(no_docs, PATH).count() == 0


def test_sharding_law_and_slots(odd_docs, no_docs):
    got = sharding.assign(odd_docs, [1.0] * 5, grown=[1.0] * 6).collect()
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (repr(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert texts and all(r.grown_shard in (r.shard, 5) for r in got)
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.assign(no_docs, [1.0, 1.0]).count() == 0


def test_shards_follow_their_weights(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    n = {r["shard"]: r["count"] for r in sharding.assign(rows, [1.0, 2.0, 0.0, 5.0]).groupBy("shard").count().collect()}
    assert set(n) == {0, 1, 3} and abs(n[0] - 2500) < 250 and abs(n[1] - 5000) < 300 and abs(n[3] - 12_500) < 400
