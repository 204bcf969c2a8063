"""Quality rules from tokeniser fertility.

Public vocabularies see natural text of the languages they know in a narrow range of statistics: tokens per word and
characters per token (a byte-level vocabulary), the share of tokens that fall back to single bytes and the entropy of
the token distribution (a piece vocabulary). Texts outside the band of their language, or of their script where the
language has no band, are rejected. Entropy grows with length, so its lower bound is a line through knots over log2 of
the number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import sliced
from .vocab import WordIds, word_ids

RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
BYTE_PIECES = (3, 259)  # ids of the single-byte pieces
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    fertility: tuple[float, float]  # tokens per word
    chars: tuple[float, float]  # characters per token
    bytes_most: float
    entropy: tuple[tuple[float, float], ...]  # (log2 of tokens, least entropy)

    def takes(self, fertility: float, chars: float, byte_share: float, entropy: float, tokens: int) -> bool:
        x, y = zip(*self.entropy, strict=True)
        least = np.interp(np.log2(max(tokens, 1)), x, y)
        return self.fertility[0] <= fertility <= self.fertility[1] and self.chars[0] <= chars <= self.chars[1] and byte_share <= self.bytes_most and entropy >= least


def _knots(lower: float) -> tuple[tuple[float, float], ...]:
    return tuple((x, y - lower) for x, y in ((5, 4.6), (6, 5.25), (7, 5.48), (8, 5.98), (9, 6.2), (10, 6.4), (11, 6.5), (12, 6.6)))


def _level(entropy: float) -> tuple[tuple[float, float], ...]:
    """For scripts that are mostly spelt out by characters or bytes: entropy is near its height after a few hundred tokens."""
    return ((5, entropy - 1.6), (7, entropy - 0.9), (9, entropy - 0.5), (14, entropy - 0.4))


MANY = 1e9  # words of scripts without spaces can be whole sentences
# Bands of languages were set on labelled texts, that of English on licence and documentation texts too (legal prose has
# 1.18 tokens a word, lists of addresses and names up to 3.5); those of scripts around the statistics of a paragraph of public
# prose in each (another one is tested); the statistics of a text are compared with these alone.
BANDS = {
    "en": Band((1.05, 3.5), (1.6, 6.0), 0.05, _knots(0.0)),
    "de": Band((1.2, 3.3), (1.6, 6.0), 0.05, _knots(0.15)),
    "es": Band((1.2, 3.5), (1.5, 6.0), 0.05, _knots(0.1)),
    "fr": Band((1.2, 3.3), (1.5, 6.0), 0.05, _knots(0.1)),
    "latin": Band((1.0, 4.0), (1.3, 6.5), 0.10, _knots(0.5)),
    "greek": Band((3.0, 9.8), (0.66, 1.5), 0.05, _level(4.5)),
    "cyrillic": Band((2.5, 9.5), (0.66, 1.6), 0.05, _level(6.3)),
    "hebrew": Band((3.0, 9.0), (0.62, 1.4), 0.05, _level(4.2)),
    "arabic": Band((2.5, 8.5), (0.66, 1.6), 0.05, _level(4.5)),
    "devanagari": Band((4.0, 11.5), (0.45, 1.0), 0.11, _level(4.6)),
    "kana": Band((1.0, MANY), (0.55, 1.2), 0.20, _level(6.1)),
    "han": Band((1.0, MANY), (0.42, 0.9), 0.30, _level(6.2)),
    "hangul": Band((4.0, 14.0), (0.28, 0.8), 0.35, _level(5.5)),
    "other": Band((1.0, MANY), (0.2, 6.5), 0.95, ((6, 3.0), (12, 4.0))),
}
# First and last code points of the letters of each script.
RANGES = (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
_BOUNDS = np.array([x for _, first, last in RANGES for x in (first, last + 1)])
_SCRIPTS = sorted({name for name, _, _ in RANGES})
_KIND = np.full(2 * len(RANGES) + 1, -1)
_KIND[1::2] = [_SCRIPTS.index(name) for name, _, _ in RANGES]


def script_of(text: str) -> str:
    """The script of most letters of the listed ranges; kana from a tenth of them on, as it comes with han; 'other' for none or a minority."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    kinds = _KIND[np.searchsorted(_BOUNDS, points, side="right")]
    times = np.bincount(kinds[kinds >= 0], minlength=len(_SCRIPTS))
    outside = int(((kinds < 0) & (points >= 0x250) & ~((points >= 0x2000) & (points < 0x2100)) & ~((points >= 0x3000) & (points < 0x3040))).sum())
    if not times.sum() or outside > times.sum():
        return "latin" if not outside else "other"  # digits and marks alone count as latin
    if 10 * times[_SCRIPTS.index("kana")] >= times.sum():
        return "kana"
    return _SCRIPTS[int(times.argmax())]


def band_of(lang: str | None, text: str) -> Band:
    """The band of a listed language, else of the script of the text."""
    return BANDS[lang] if lang in BANDS and len(lang) == 2 else BANDS[script_of(text)]


def base_counts(text: bytes, words: list[bytes], ids: np.ndarray = np.zeros(0, np.int64)) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; ids may number its words."""
    chars = len(b"".join(words).decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines, seen, dup = text.split(b"\n"), set(), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    n = len(words)
    if n < 3:
        return n, chars, symbols, dup, 0
    if not len(ids) or int(ids.max()) >= 1 << 21:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if int(ids.max()) < 1 << 21:
        _, which, times = np.unique(ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:], return_inverse=True, return_counts=True)
    else:
        _, which, times = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1), axis=0, return_inverse=True, return_counts=True)
    twice = times[which.ravel()] > 1
    under = np.zeros(n, bool)
    for i in range(3):
        under[i : n - 2 + i] |= twice
    return n, chars, symbols, dup, int(under.sum())


def token_counts(table: WordIds, at: np.ndarray, chars: int) -> tuple[float, float, float, float, int]:
    """Tokens per word, characters per token, byte share, token entropy in bits, tokens; at: the words' slots in the table."""
    if not len(at):
        return 0.0, 0.0, 0.0, 0.0, 0
    ids, ranked = table.ids_at(at), int(table.count[1, at].sum())
    times = np.bincount(ids)
    share = times[times > 0] / len(ids)
    byte_share = times[BYTE_PIECES[0] : BYTE_PIECES[1]].sum() / len(ids)
    return ranked / len(at), chars / ranked, float(byte_share), float(-(share * np.log2(share)).sum()), len(ids)


_OUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, tokens_per_word double, chars_per_token double, byte_share double, token_entropy double"
)


def _judged(ranks: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(pieces, ranks)
        for batch in sliced(batches):
            rows = []
            for doc, text, lang in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or b""
                words = text.split()
                at = table.slots(words)
                n, chars, symbols, dup, repeat = base_counts(text, words, at)
                failed = n < 50 or 100 * repeat > 50 * n
                fertility, per, byte_share, entropy, tokens = token_counts(table, at, chars)
                kept = not failed and bool(band_of(lang, text.decode()).takes(fertility, per, byte_share, entropy, tokens))
                rows.append((doc, n, chars, symbols, dup, repeat, failed, kept, fertility, per, byte_share, entropy))
            types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 4
            columns = list(zip(*rows, strict=True)) if rows else [()] * 12
            names = [x.split()[0] for x in _OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def fertility_rules(docs: DataFrame, ranks: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept and the four statistics.

    A null or empty text has no words and fails the base rules; a null or unknown language gets the band of its script.
    A very long text is judged whole; statistics that lie exactly on a bound are inside. Repeated rows are judged each; null
    identifiers stay. Extra columns are not read; an empty table gives no rows.
    """
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")]
    return docs.select(*columns).mapInArrow(_judged(ranks, pieces), _OUT)
