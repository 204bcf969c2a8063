from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioworks.llm import packing, vocab

PATH = public_tokenizers.path(packing.VOCABULARY)
ODD_WORDS = ["don't", "it's!!", "a'b", "İstanbul", "ΟΔΟΣ", "<|endoftext|>", "x<|endoftext|>y", "é", "...", "x.y", "٣٤", "日本語", "Å", "a b", "a\x1cb", "ﬁ", "Ⅷ", "²", "ㅎㅏㄴ", "Ǆ", "ß!", "THE!!", "12,5"]


def plain_pieces(rows, tokens=2048):
    tokenizer, out = Tokenizer.from_file(PATH), []
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(doc or -1, i, s, len(ids[s : s + tokens]), zlib.crc32(ids[s : s + tokens].tobytes())) for i, s in enumerate(range(0, len(ids), tokens))]
    return sorted(out)


def test_words_alone_and_together():
    table, tokenizer = vocab.word_ids(PATH), Tokenizer.from_file(PATH)
    words = [w for w in ODD_WORDS * 2 + [f"word{i}" for i in range(50)] + ["plain", "words,", "Große"]]
    flat = table.ids_at(table.slots([w.encode() for w in words])).tolist()
    assert flat == [i for w in words for i in tokenizer.encode(w, add_special_tokens=False).ids]


def test_pieces_and_sequences(docs_of, odd_rows):
    rows = [*odd_rows, (20, " ".join(ODD_WORDS)), *[(100 + i, "word " * (i % 700)) for i in range(300)]]
    got = packing.pack(docs_of(rows, extra=True), PATH).collect()
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == plain_pieces(rows)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in got)
    assert len(bins) <= 1.02 * total / 2048 + 2


def test_large_identifiers_beside_null(docs_of):
    big = 9007199254740993
    got = packing.pack(docs_of([(big, "a b"), (None, "c"), (big + 2, "d " * 3000)]), PATH).collect()
    assert {r["doc_id"] for r in got} == {big, None, big + 2}


def test_ids_beyond_two_bytes():
    import itertools

    numbers = itertools.count(70_000)
    table = vocab.WordIds(lambda words: vocab._flat(range(len(words)), [[next(numbers)] for _ in words]))
    assert table.ids_at(table.slots([b"x", b"y"])).tolist() in ([70_000, 70_001], [70_001, 70_000])


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.random.default_rng(1).integers(1, 300, 2000)
    capacity = packing.Capacity(tokens=1000, documents=9, attention=150_000, rule=rule)
    bins, offsets = packing.best_fit(lengths, capacity)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 1000 and len(own) <= 9 and (own**2).sum() <= 150_000
        assert sorted(offsets[bins == b]) == sorted(np.cumsum(own[np.argsort(offsets[bins == b])]) - own[np.argsort(offsets[bins == b])])


def test_words_are_forgotten_and_learned_again(docs_of):
    small, tokenizer = vocab.WordIds(vocab._tokenizers_file(PATH), vocab._tokenizers_file(PATH), most=12), Tokenizer.from_file(PATH)
    pick = np.random.default_rng(2)
    for _ in range(60):
        words = [f"{'long' * (i % 9)}w{i}".encode() for i in pick.zipf(1.5, 15) % 40]
        at = small.slots(words)
        want = [tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words]
        assert small.ids_at(at).tolist() == [i for x in want for i in x]
        assert small.count[1, at].tolist() == [len(x) for x in want]
    assert packing.pack(docs_of([]), PATH).count() == 0
