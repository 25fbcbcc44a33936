"""Fragments against an alignment of whole texts by sets of byte offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from vacatlas.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY_A, LIBRARY_B = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
LIBRARY_A.encode_special_tokens = True
C = alignment.coders(A, B)
PARTS = ["a", "b", "The", " ", "  ", "\n", "\t", "é", "漢字", "😀", "12", "don't", "<|endoftext|>", "<s>", "<0x41>", "hello", " world", "ing", "....",
         "====" * 5, "x" * 30, "́", "\x00", " ", "　", "'s"]


def tokens(text):
    """(id, start, end) of both kinds by the libraries, or None."""
    out = []
    for ids, of in ((LIBRARY_A.encode(" " + text, add_special_tokens=False).ids, C.bytes_a), (LIBRARY_B.encode(text), C.bytes_b)):
        at, found = 0, []
        for i in ids:
            found.append((i, at, at + len(of[i])))
            at += len(of[i])
        if b"".join(of[i] for i in ids) != (" " + text).encode():
            return None
        out.append(found)
    return out


def brute(texts):
    every = [tokens(t) if t else None for t in texts]
    links = [[(a[0], b[0]) for a in x[0] for b in x[1] if a[1] < b[2] and b[1] < a[2]] if x else [] for x in every]
    counts = Counter(p for own in links for p in own)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for x, own in zip(every, links):
        if not x:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({t[2] for t in x[0]} & {t[2] for t in x[1]})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(t[0]) for t in side if low < t[2] <= e) for side in x))
            low = e
        out.append((len(x[0]), len(x[1]), len(groups), len(own), sum(counts[p] == top[p[1]] for p in own), sum(counts[p] for p in own), ";".join(groups)))
    return out


def same(x, y):
    plain = lambda f: (f.head_a.tolist(), f.head_b.tolist(), f.tail_a.tolist(), f.tail_b.tolist(), f.closed and (
        f.closed.shown, f.closed.n_a, f.closed.n_b, f.closed.n_groups, Counter(np.concatenate([alignment._NONE, *f.closed.links]).tolist())))
    return plain(x) == plain(y)


def test_ranges_give_the_whole_text_and_composing_is_associative():
    r = random.Random(3)
    for _ in range(400):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(1, 60)))
        found = [alignment.of_range(C, *x) for x in alignment.ranges(text, r.randint(1, 40))]
        assert not any(f is None for f in found)
        left, cut = alignment.Fragment(), r.randint(0, len(found))
        for f in found:
            left = alignment.compose(C, left, f)
        halves = [alignment.Fragment(), alignment.Fragment()]
        for half, part in enumerate((found[:cut], found[cut:])):
            for f in reversed(part):
                halves[half] = alignment.compose(C, f, halves[half])
        assert same(left, alignment.compose(C, *halves)), text
        assert alignment.whole(C, left).shown[:-1] == brute([text])[0][-1], text


def test_words_give_the_whole_text(monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(alignment, "MEMO", 40)
    c = alignment.Coders(A, B)
    for _ in range(40):
        texts = ["".join(r.choice([*PARTS, "▁"] if i % 9 == 0 else PARTS) for _ in range(r.randint(1, 30))) for i in range(30)]
        for text, got, want in zip(texts, c.aligned(texts), brute(texts)):
            assert (got[2][:-1] if got else "") == want[-1], text


def test_tables_against_brute_force(spark, odd_docs, no_docs):
    r = random.Random(4)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 80))) for _ in range(60)] + ["has ▁ inside", None, "", "x" * 500, "x" * 500]
    texts += [" ".join(r.choice(["der", "Löwe", "geht", "12.5", "<s>"]) for _ in range(900)) + end for end in ("", "", " ▁")]
    table = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, groups string")
    want = {i: x for i, x in enumerate(brute(texts))}
    for size in (1 << 16, 50):  # the small one sends many texts through the tree
        got = alignment.align(table, A, B, size=size).collect()
        assert {x.doc_id: tuple(x)[1:] for x in got} == want
    got = alignment.align(table, A, B, digest=True).collect()
    assert {x.doc_id: x.groups_sha256 for x in got} == {i: hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "" for i, x in want.items()}
    assert alignment.align(no_docs, A, B).count() == 0
    odd = alignment.align(odd_docs, A, B, size=5000).collect()
    assert Counter((x.doc_id, x.n_a > 0) for x in odd) == Counter((x.doc_id, bool(x.text)) for x in odd_docs.collect())
    assert {x.n_a for x in odd if x.doc_id == 6} == {len(LIBRARY_A.encode(" " + t.text).ids) for t in odd_docs.collect() if t.doc_id == 6}
