"""Public vocabularies, applied word by word.

None of them joins pieces across ASCII white space, so the ids of a text are those of its words in order. Each worker
remembers the ids of words that it has met, up to a bound, and then starts anew.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterable
from itertools import chain, repeat

import numpy as np


#: Indexes of the words in the order of what follows; all ids; the number of ids of each word.
Encoded = tuple[list[int], np.ndarray, np.ndarray]


def _flat(order: Iterable[int], found: list[list[int]]) -> Encoded:
    return list(order), np.fromiter(chain.from_iterable(found), np.int64), np.fromiter(map(len, found), np.int64, len(found))


_TRAILING = ".,;:!?%&$#*|"
_MARKS = _TRAILING.encode()


def _runs(word: str) -> int:
    """Runs that a word is split into before its pieces are looked up, for letters with marks after them; 0 for any other word."""
    core = word.rstrip(_TRAILING)
    return 1 + (len(core) < len(word)) if core.isalpha() and "\u0130" not in core else 0


def _tokenizers_file(path: str) -> Callable[[list[str]], Encoded]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ending = getattr(tokenizer.model, "end_of_word_suffix", None)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        ends[i] = bool(ending) and token.endswith(ending)

    def alone(words: list[str]) -> list[list[int]]:
        return words and [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(words: list[str]) -> Encoded:
        """Plain words go through the tokenizer as one text, which is much cheaper, and are told apart by the ends of their runs."""
        runs = [_runs(w) if ending else 0 for w in words]
        plain = [i for i, n in enumerate(runs) if n]
        rest = [i for i, n in enumerate(runs) if not n]
        ids = np.array(alone([" ".join(words[i] for i in plain)])[0] if plain else [], np.int64)
        stops, last = np.flatnonzero(ends[ids]) + 1, np.cumsum([runs[i] for i in plain], dtype=np.int64) - 1
        if len(stops) != sum(runs):
            return _flat(range(len(words)), alone(words))
        order, flat, counts = _flat(rest, alone([words[i] for i in rest]))
        return plain + list(order), np.concatenate([ids, flat]), np.concatenate([np.diff(stops[last], prepend=0), counts])

    encode.folds = bool(ending) and tokenizer.encode("AbC").ids == tokenizer.encode("abc").ids
    return encode


def _rank_file(path: str) -> Callable[[list[str]], Encoded]:
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda words: _flat(range(len(words)), [encoding.encode_ordinary(" " + w) for w in words])


def _piece_file(path: str) -> Callable[[list[str]], Encoded]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda words: _flat(range(len(words)), model.encode(words, num_threads=1))


_BY_ENDING = {".json": _tokenizers_file, ".tiktoken": _rank_file, ".model": _piece_file}


Encoder = Callable[[list[str]], Encoded]


SHORT = 8
_COLUMNS = np.arange(SHORT)


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of stretches: counts[i] of them from starts[i], one stretch after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordIds:
    """Token ids by word, in one flat array; for further vocabularies only the number of tokens of each word."""

    def __init__(self, encode: Encoder, *others: Encoder, most: int = 600_000) -> None:
        self.encode, self.others, self.most = encode, others, most
        self.folds = getattr(encode, "folds", False) and not others
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.short = np.zeros((1024, SHORT), np.uint32)  # the ids of words with few, for quick reading
        self.start, self.count = np.zeros(1024, np.int64), np.zeros((1 + len(self.others), 1024), np.int32)
        self.ids, self.used = np.zeros(4096, np.uint32), 0
        self.uses = np.zeros(1024, np.int32)  # calls that had the word
        if self.folds:
            self._store([b""], np.zeros(0, np.int64), np.zeros(1, np.int64))

    def _make_room(self) -> None:
        """Forget the words that only one call had since the last time, and if need be the less used half."""
        n, words = len(self.slot), list(self.slot)  # in the order of their slots
        stay = np.flatnonzero(self.uses[:n] > 1)
        stay = stay[np.array([words[i] != b"" for i in stay.tolist()], bool)]
        if len(stay) > self.most // 2:
            stay = np.sort(stay[np.argsort(-self.uses[stay], kind="stable")[: self.most // 2]])
        ids, count = self._gather(stay), self.count[:, stay]
        self._clear()
        held = len(self.slot)
        self._store([words[i] for i in stay.tolist()], ids, count[0].astype(np.int64))
        self.count[:, held : held + len(stay)] = count

    def _grow(self, words: int, ids: int) -> None:
        while words > len(self.start):
            self.start, self.count, self.short, self.uses = np.tile(self.start, 2), np.tile(self.count, 2), np.tile(self.short, (2, 1)), np.tile(self.uses, 2)
        while ids > len(self.ids):
            self.ids = np.tile(self.ids, 2)

    def _learn(self, words: list[bytes]) -> None:
        if not self.folds:
            return self._encode(words)
        plain, derived, cores, ends = [], [], [], []
        for word in words:  # capitals or marks after a known plain form: its ids and those of the marks
            low = word.lower()
            core = low.rstrip(_MARKS)
            known = self.slot.get(core) if core != word else None
            if known is None or not _runs(core.decode()) or low[len(core) :] not in self.slot and not self._encode([low[len(core) :]]):
                plain.append(word)
            else:
                derived.append(word)
                cores.append(known)
                ends.append(self.slot[low[len(core) :]])
        if derived:
            at, end = np.array(cores), np.array(ends)
            first, second = self.count[0, at].astype(np.int64), self.count[0, end].astype(np.int64)
            starts = np.cumsum(first + second) - first - second
            flat = np.empty(int((first + second).sum()), np.int64)
            flat[_places(starts, first)] = self._gather(at)
            flat[_places(starts + first, second)] = self._gather(end)
            self._store(derived, flat, first + second)
        return self._encode([w for w in plain if w not in self.slot])

    def _encode(self, words: list[bytes]) -> bool:
        if not words:
            return True
        texts = [w.decode() for w in words]
        order, flat, counts = self.encode(texts)
        self._store([words[i] for i in order], flat, counts)
        for i, other in enumerate(self.others):
            order, _, counts = other(texts)
            self.count[i + 1, [self.slot[words[j]] for j in order]] = counts
        return True

    def _store(self, words: list[bytes], flat: np.ndarray, counts: np.ndarray) -> None:
        n, end = len(self.slot), len(self.slot) + len(words)
        self._grow(end, self.used + len(flat))
        self.uses[n:end] = 0
        self.start[n:end] = self.used + np.cumsum(counts) - counts
        self.count[0, n:end] = counts
        self.ids[self.used : self.used + len(flat)] = flat
        mask = _COLUMNS < np.minimum(counts, SHORT)[:, None]
        self.short[n:end][mask] = self.ids[(self.start[n:end, None] + _COLUMNS)[mask]]
        self.used += len(flat)
        self.slot.update(zip(words, range(n, end), strict=True))

    def slots(self, words: list[bytes]) -> np.ndarray:
        """A number for each word, the same for equal words until the next call."""
        at = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(at < 0).tolist()
        if missed:
            new = list({words[i] for i in missed})
            if len(self.slot) + len(new) > self.most:
                self._make_room()
                new = list({w for w in words if w not in self.slot})
                missed = range(len(words))
            self._learn(new)
            at[missed] = [self.slot[words[i]] for i in missed]
        self.uses[at] += 1
        return at

    def _gather(self, at: np.ndarray) -> np.ndarray:
        return self.ids[_places(self.start[at], self.count[0, at].astype(np.int64))]

    def ids_at(self, at: np.ndarray) -> np.ndarray:
        counts = self.count[0, at]
        if len(counts) and counts.max() <= SHORT:
            return self.short[at][_COLUMNS < counts[:, None]]
        return self._gather(at)


_LOADED: dict[tuple[str, ...], WordIds] = {}


def word_ids(*paths: str) -> WordIds:
    """The vocabularies in these files, loaded once in each worker."""
    if paths not in _LOADED:
        _LOADED[paths] = WordIds(*(_BY_ENDING[os.path.splitext(p)[1]](p) for p in paths))
    return _LOADED[paths]
