"""Toxic spans by a linear-chain conditional random field.

Labels are given by document, so token labels are derived first: a word or word beginning is taken as offending if, in
the training sample, it stands in many different surroundings and practically only in toxic documents (different
surroundings, so that copies of one text count once). A two-state chain over the tokens of a line is then fitted to
these token labels by maximum likelihood, with features of the word, its beginnings and its ending, so unseen forms of
an offending stem are tagged too. Scoring runs the forward-backward recursions over every line of every whole text;
the marginals give the spans, and their sum per document goes through a logistic curve to the document's score. A chain
is a whole line. Long lines are worked on in blocks of 128 words side by side: the product of a block's transition matrices
turns the message that enters it into the one that leaves it, forward and backward, so the marginals are those of the
uncut line.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import distinct_texts, held_out, training_rows
from .scratch import sliced

BUCKETS = 1 << 18
TOXIC_DOCS, CLEAN_DOCS = 800, 2400
FLOOR = 0.2
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLOCK = 128
_EDGE = b".,;:!?\"'()[]{}<>*_~`-"
_BEGINNINGS = ((3, b"p3="), (4, b"p4="), (5, b"p5="), (6, b"p6="))


def _features(word: bytes) -> list[bytes]:
    core = word.lower().strip(_EDGE)
    if core.isascii():  # bytes are code points
        found = [b"w=" + core, b"s=" + core[-3:]]
        found += [mark + core[:n] for n, mark in _BEGINNINGS if len(core) >= n]
    else:
        text = core.decode()
        found = [b"w=" + core, b"s=" + text[-3:].encode()]
        found += [mark + text[:n].encode() for n, mark in _BEGINNINGS if len(text) >= n]
    if core != word.strip(_EDGE) and word.isupper():
        found.append(b"upper")
    return found


def _chains(text: bytes) -> list[list[bytes]]:
    return [words for words in (line.split() for line in text.split(b"\n")) if words]


def _buckets(word: bytes) -> list[int]:
    return [zlib.crc32(f) % BUCKETS for f in _features(word)]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists in a row, and the list that each is from."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.repeat(np.arange(len(lists)), lengths), np.fromiter(chain.from_iterable(lists), np.int64, int(lengths.sum()))


class _Side:
    """Equal-sized work on many stretches of a flat token array, longest first, so that each step works on a shrinking block."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        self.starts, self.lengths = starts[self.order], lengths[self.order]
        longest = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(longest), side="left")

    def steps(self) -> Iterator[tuple[int, np.ndarray]]:
        """The number of stretches that have a t-th token, and these tokens."""
        for t, n in enumerate(self.active):
            yield n, self.starts[:n] + t


class Chains:
    """Lines as chains over one flat token array, cut into blocks that hand their messages on."""

    def __init__(self, lengths: np.ndarray, block: int = BLOCK) -> None:
        self.heads = np.cumsum(lengths) - lengths
        blocks = -(-lengths // block)
        owner = np.repeat(np.arange(len(lengths)), blocks)
        self.first = np.cumsum(blocks) - blocks  # the first block of each chain
        self.nth = np.arange(len(owner)) - self.first[owner]
        starts = self.heads[owner] + self.nth * block
        sizes = np.minimum(block, lengths[owner] - self.nth * block)
        self.more = self.nth + 1 < blocks[owner]  # blocks with one behind
        self.starts, self.sizes, self.blocks = starts, sizes, blocks
        self.all = _Side(starts, sizes)

    def _products(self, which: np.ndarray, emission: np.ndarray, trans: np.ndarray, forward: bool) -> np.ndarray:
        """Logarithms of the matrices that turn the odds on one side of a block into those on the other."""
        into, out, stay = np.exp(trans)
        side = _Side(self.starts[which], self.sizes[which])
        a, b, c, d = np.ones(len(which)), np.zeros(len(which)), np.zeros(len(which)), np.ones(len(which))
        steps = list(side.steps())
        for t, (n, at) in enumerate(steps) if forward else zip(reversed(range(len(steps))), reversed(steps), strict=True):
            p, q = np.exp(np.minimum(emission[at], 0.0)), np.exp(-np.maximum(emission[at], 0.0))
            if forward:
                head = (self.nth[which[side.order[:n]]] == 0) & (t == 0)  # nothing goes before a chain's first token
                left, right, low, high = np.where(head, 0.0, stay * p), np.where(head, p, into * p), np.where(head, 0.0, out * q), q
            else:
                left, right, low, high = stay * p, out * q, into * p, q
            moved = left * a[:n] + right * c[:n], left * b[:n] + right * d[:n], low * a[:n] + high * c[:n], low * b[:n] + high * d[:n]
            scale = np.maximum(np.maximum(moved[0], moved[1]), np.maximum(moved[2], moved[3]))
            a[:n], b[:n], c[:n], d[:n] = (x / scale for x in moved)
        back = np.empty(len(which), np.int64)
        back[side.order] = np.arange(len(which))
        with np.errstate(divide="ignore"):
            return np.log(np.stack([a, b, c, d], axis=1)[back])

    def _messages(self, emission: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds that enter each block forward (of the token before it) and backward (of its last token's future)."""
        enter, leave = np.zeros(len(self.starts)), np.zeros(len(self.starts))
        where = np.zeros(len(self.starts), np.int64)
        left, right = np.flatnonzero(self.more), np.flatnonzero(self.nth > 0)
        if not len(left):
            return enter, leave
        apply = lambda m, x: np.logaddexp(m[:, 0] + x, m[:, 1]) - np.logaddexp(m[:, 2] + x, m[:, 3])
        where[left] = np.arange(len(left))
        ahead = self._products(left, emission, trans, True)
        long = np.flatnonzero(self.blocks > 1)
        for k in range(1, int(self.blocks.max())):
            at = self.first[long[self.blocks[long] > k]] + k
            enter[at] = apply(ahead[where[at - 1]], enter[at - 1])
        where[right] = np.arange(len(right))
        behind = self._products(right, emission, trans, False)
        for k in range(int(self.blocks.max()) - 1, 0, -1):
            at = self.first[long[self.blocks[long] > k]] + k
            leave[at - 1] = apply(behind[where[at]], leave[at])
        return enter, leave

    def marginals(self, emission: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log-odds of the offending state at each token; trans holds the weights of 0-1, 1-0 and 1-1."""
        into, out, stay = trans
        ahead, back = np.zeros_like(emission), np.zeros_like(emission)
        enter, leave = self._messages(emission, trans)
        order, started = self.all.order, self.nth[self.all.order] == 0
        odds = np.zeros(0)
        for t, (n, at) in enumerate(self.all.steps()):
            prev = odds[:n] if t else enter[order[:n]]
            here = emission[at] + np.logaddexp(into, stay + prev) - np.logaddexp(0.0, out + prev)
            odds = here if t else np.where(started[:n], emission[at], here)
            ahead[at] = odds
        back[self.starts + self.sizes - 1] = leave
        for n, at in reversed(list(self.all.steps())[1:]):
            nxt = emission[at] + back[at]
            back[at - 1] = np.logaddexp(out, stay + nxt) - np.logaddexp(0.0, into + nxt)
        return ahead, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class SpanModel:
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    slope: float
    level: float
    seen: dict[bytes, float] = field(default_factory=dict)

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Log-odds of each word by itself; those of words that a worker has met are remembered, up to a bound."""
        values = np.fromiter(map(self.seen.get, words, repeat(np.nan)), float, len(words))
        missed = np.flatnonzero(np.isnan(values)).tolist()
        if missed:
            if len(self.seen) > 250_000:
                self.seen.clear()
            new = list({words[i] for i in missed})
            owner, bucket = _flat([_buckets(w) for w in new])
            self.seen.update(zip(new, (self.bias + np.bincount(owner, self.weights[bucket], len(new))).tolist(), strict=True))
            values[missed] = [self.seen[words[i]] for i in missed]
        return values

    def token_marginals(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text the probability that each of its words offends."""
        lines = [_chains(t) for t in texts]
        flat = [w for doc in lines for line in doc for w in line]
        emission = self.emissions(flat)
        counts = [[len(x) for x in doc] for doc in lines]
        chains = Chains(np.array([n for doc in counts for n in doc], np.int64))
        ahead, back = chains.marginals(emission, self.trans)
        return np.split(_sigmoid(ahead + back), np.cumsum([sum(x) for x in counts])[:-1]) if texts else []

    @staticmethod
    def expected(marginals: np.ndarray) -> float:
        """Expected offending words; marginals under the floor are left out, or a long clean text would add up."""
        return float(marginals[marginals >= FLOOR].sum())

    def score(self, marginals: np.ndarray) -> float:
        return float(_sigmoid(np.array(self.slope * np.log1p(self.expected(marginals)) + self.level)))


def _expected_rates(docs: list[tuple[list[bytes], int]], common: int = 300) -> list[float]:
    """For each document the share of toxic ones that its surrounding vocabulary leads to expect.

    The words that stand in most documents tell which language and kind of text a document is, not whether it offends: the
    mean over those of its words of their share of toxic documents is what a word without meaning would have there.
    """
    held, toxic = Counter(), Counter()
    for words, label in docs:
        own = set(words)
        held.update(own)
        if label:
            toxic.update(own)
    whole = sum(label for _, label in docs) / max(len(docs), 1)
    share = {w: (toxic[w] + whole) / (n + 1) for w, n in sorted(held.items(), key=lambda x: (-x[1], x[0]))[:common]}
    rates = []
    for words, _ in docs:
        found = [share[w] for w in sorted(set(words) & share.keys())]
        rates.append(min(max(sum(found) / len(found) if found else whole, 0.02), 0.9))
    return rates


def _offending(docs: list[tuple[list[bytes], int]], support: int, precision: float, odds: float) -> set[bytes]:
    """Words that, or beginnings of which, stand in many surroundings of toxic documents and hardly in others.

    How many are many follows from the rates that these documents lead to expect: that all of a form's surroundings are toxic
    by chance must be less likely than exp(-odds) over the number of forms. Where toxic documents are rare, few say as
    much as many where they are not.
    """
    def forms(word: bytes) -> list[bytes]:
        return [f for f in _features(word) if f[:1] in b"wp"]

    counts: dict[bytes, int] = defaultdict(int)
    met: dict[bytes, list[bytes]] = {}
    for words, label in docs:
        if label:
            own = set(words)
            met.update((w, forms(w)) for w in own - met.keys())
            for f in set(chain.from_iterable(map(met.__getitem__, own))):
                counts[f] += 1
    often = {f: n for f, n in counts.items() if n >= support}
    known = {w: tuple(f for f in found if f in often) for w, found in met.items()}
    del counts, met

    def told(word: bytes) -> tuple[bytes, ...]:
        if word not in known:
            known[word] = tuple(f for f in forms(word) if f in often)
        return known[word]

    clean: dict[bytes, int] = defaultdict(int)
    for words, label in docs:
        if not label:
            for f in {f for w in set(words) for f in told(w)}:
                clean[f] += 1
    telling = {f for f, n in often.items() if n >= precision * (n + clean[f])}
    around: dict[bytes, dict[tuple, tuple[int, float]]] = defaultdict(dict)
    for (words, label), rate in zip(docs, _expected_rates(docs), strict=True):
        for word, i in {w: i for i, w in enumerate(words)}.items():
            for f in told(word):
                if f in telling:
                    around[f].setdefault((words[i - 1] if i else b"", words[i + 1] if i + 1 < len(words) else b""), (label, -math.log(rate)))
    need = odds + math.log(max(len(often), 1))
    seeds = set()
    for f, seen in around.items():
        toxic = [x for label, x in seen.values() if label]
        if len(toxic) >= max(support, precision * len(seen)) and sum(toxic) >= need:
            seeds.add(f)
    return {word for word, found in known.items() if not seeds.isdisjoint(found)}


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> tuple[float, float]:
    """Slope and level of a one-variable logistic curve, by Newton's method."""
    both, w = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(40):
        p = _sigmoid(both @ w)
        grad = both.T @ (p - y) + penalty * w
        w = w - np.linalg.solve((both * (p * (1 - p))[:, None]).T @ both + penalty * np.eye(2), grad)
    return float(w[0]), float(w[1])


def train(texts: list[tuple[str, int]], support: int = 4, precision: float = 0.95, odds: float = 0.0, rounds: int = 30, penalty: float = 2e-4, clean_lines: int = 6_000) -> SpanModel:
    """texts: whole texts with label 1 (toxic) or 0. Without both labels the model gives every text the same score.

    Runs in one place over the bounded sample: all lines with a marked word, and of the others clean_lines at most (in
    order of a hash of their words), which bounds the clean lines that the chain is fitted to; scores use all lines.
    """
    labels = np.array([y for _, y in texts], float)
    model = SpanModel(np.zeros(BUCKETS), -8.0, np.zeros(3), 0.0, -8.0 if not labels.sum() else 8.0 if labels.mean() == 1 else 0.0)
    if labels.sum() in (0, len(labels)):
        return model
    same: dict[bytes, bytes] = {}
    lines = [[[same.setdefault(w, w) for w in line] for line in _chains(t.encode())] for t, _ in texts]
    marked = _offending([([w for line in doc for w in line], int(y)) for doc, (_, y) in zip(lines, texts, strict=True)], support, precision, odds)
    # Every line with a mark, and clean lines in order of a hash of their content, up to a bound.
    rows, rest = [], []
    for doc, (_, y) in zip(lines, texts, strict=True):
        for line in doc:
            hit = [w in marked for w in line]
            if any(hit):
                rows.append((line, np.array(hit, float) * y))
            else:
                rest.append((zlib.crc32(b" ".join(line)), line))
    rows += [(line, np.zeros(len(line))) for _, line in sorted(rest)[:clean_lines]]
    kinds: dict[bytes, int] = {}
    kind = np.array([kinds.setdefault(w, len(kinds)) for line, _ in rows for w in line], np.int64)
    gold = np.concatenate([y for _, y in rows])
    owner, bucket = _flat([_buckets(w) for w in kinds])
    chains = Chains(np.array([len(line) for line, _ in rows], np.int64))
    first = np.zeros(len(kind), bool)
    first[chains.heads] = True
    second = np.flatnonzero(~first)
    size = len(kind)
    held = {"w": np.zeros(BUCKETS), "b": np.array(-4.0), "t": np.zeros(3)}
    past = {k: np.zeros_like(v) for k, v in held.items()}
    for _ in range(rounds):
        emission = (held["b"] + np.bincount(owner, held["w"][bucket], len(kinds)))[kind]
        ahead, back = chains.marginals(emission, held["t"])
        rest_of = gold - _sigmoid(ahead + back)
        by_kind = np.bincount(kind, rest_of, len(kinds))
        p, q = ahead[second - 1], emission[second] + back[second]
        joint = np.stack([np.zeros_like(p), held["t"][0] + q, held["t"][1] + p, held["t"][2] + p + q])
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        a, b = gold[second - 1], gold[second]
        trans = np.array([((1 - a) * b - joint[1]).sum(), (a * (1 - b) - joint[2]).sum(), (a * b - joint[3]).sum()])
        grads = {"w": np.bincount(bucket, by_kind[owner], BUCKETS) - penalty * size * held["w"] * 0.01, "b": np.array(rest_of.sum()), "t": trans}
        for k, g in grads.items():  # AdaGrad
            past[k] = past[k] + g**2
            held[k] = held[k] + 1.0 * g / np.sqrt(past[k] + 1e-9)
    model = SpanModel(held["w"], float(held["b"]), held["t"], 0.0, 0.0)
    expected = np.concatenate([[model.expected(m) for m in model.token_marginals([t.encode() for t, _ in texts[i : i + 200]])] for i in range(0, len(texts), 200)])
    model.slope, model.level = _logistic(np.log1p(expected), labels)
    model.seen = {}
    return model


def _scored(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            scores, spans = [], []
            for text, p in zip(texts, model.token_marginals(texts), strict=True):
                scores.append(model.score(p))
                hit = set(np.flatnonzero(p >= least).tolist())
                spans.append([(m.start(), m.end(), float(p[i])) for i, m in enumerate(WORD.finditer(text.decode())) if i in hit] if hit else [])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
            named = [[{"start": a, "end": b, "probability": p} for a, b, p in x] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(named, kind)], names=["doc_id", "score", "spans"])

    return run


def toxicity(docs: DataFrame, model: SpanModel, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score, spans (code point offsets of the words whose marginal reaches least).

    A null text counts as empty; an empty text has no spans and the score of a text without offence. A very long text, or
    line, is scored whole. A word whose marginal is exactly least is in a span. Repeated rows are scored each, extra columns
    are not read, null identifiers stay, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_scored(shared, least), "doc_id long, score double, spans array<struct<start: long, end: long, probability: double>>")


def fit(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, **how) -> SpanModel:
    """Train on at most toxic_docs and clean_docs labelled documents outside the held-out fold.

    The bounded sample goes to one task, which sends back the model: the driver holds no texts.
    """
    rows = training_rows(docs, labels, "toxic", {1: toxic_docs, 0: clean_docs})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(distinct_texts(given), **how))], pa.binary())], names=["model"])

    made = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else train([], **how)


def verdicts(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, and the number of offending words."""
    scored = toxicity(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs whose score stays under threshold, with all their columns, in one pass without a shuffle.

    A score equal to threshold goes. Null and empty texts have the score of a text without offence and stay; very long texts
    are scored whole; repeated rows stay or go together; an empty table stays empty.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(plain, labels, **how))
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches):
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array([model.score(p) < threshold for p in model.token_marginals(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
