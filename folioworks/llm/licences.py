"""Licence scans: a trained paragraph classifier, confirmed against templates.

A paragraph is what blank lines separate; line breaks and comment marks inside it count as spaces, so wrapped notices are
read whole. Its words are scored in overlapping stretches of 64 by sparse logistic regressions over word unigrams and
bigrams, one for each licence family and one for licences outside the list ('unknown'). A stretch can have several
families. The regressions are trained here on public notices in several wordings with neighbours from a bounded sample
of the corpus, which also gives the negative examples, and they are calibrated on wordings and on licences that were
held out whole. Template comparison confirms: a family counts where words close together also have most of the bigrams
of one of its templates, in the order of the best match, so that a notice is not one of a related family too. What only
one of the two tests takes is 'unknown'.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import one_text
from .scratch import sliced

STRETCH, STEP = 64, 32
SAMPLE_DOCS, SAMPLE_LINES = 400, 2500

# Public notices and names by family; the last of each family is held out for calibration.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "licensed under the apache license version 2.0",
        "apache license version 2.0 january 2004",
        "spdx license identifier apache 2.0",
        "apache license version 2.0",
        "apache license 2.0",
        "apache 2.0",
        "released under the apache license 2.0",
    ],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "released under the mit license",
        "spdx license identifier mit",
        "mit license",
        "dual licensed under mit",
        "mit apache",
        "2.0 or mit",
        "licensed under the mit license",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "released under the isc license",
        "spdx license identifier isc",
        "isc license",
        "licensed under the isc license",
    ],
    "gpl-3.0": [
        "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
        "licensed under the gnu general public license version 3",
        "spdx license identifier gpl 3.0",
        "gnu general public license version 3",
        "gpl 3",
        "gpl version 3",
        "released under the gnu gpl version 3",
    ],
    "gpl-2.0": [
        "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
        "licensed under the gnu general public license version 2",
        "spdx license identifier gpl 2.0",
        "gnu general public license version 2",
        "gpl 2",
        "gpl version 2",
        "released under the gnu gpl version 2",
    ],
    "lgpl": [
        "under the terms of the gnu lesser general public license as published by the free software foundation either version",
        "licensed under the gnu lesser general public license",
        "spdx license identifier lgpl",
        "gnu lesser general public license version",
        "lgpl 2",
        "lgpl 2.1",
        "lgpl 3",
        "lgpl version",
        "released under the gnu lgpl version",
    ],
    "agpl": [
        "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license",
        "licensed under the gnu affero general public license version 3",
        "spdx license identifier agpl 3.0",
        "gnu affero general public license version 3",
        "agpl 3",
        "agpl version 3",
        "released under the gnu agpl version 3",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        "released under the bsd 3 clause license",
        "spdx license identifier bsd 3 clause",
        "bsd license",
        "bsd 3 clause",
        "bsd 2 clause",
        "3 clause bsd",
        "2 clause bsd",
        "licensed under the bsd license",
    ],
    "mpl-2.0": [
        "subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file",
        "licensed under the mozilla public license version 2.0",
        "spdx license identifier mpl 2.0",
        "mozilla public license version 2.0",
        "mozilla public license 2.0",
        "mpl 2.0",
        "subject to the terms of the mozilla public license",
    ],
    "cc-by": ["licensed under a creative commons attribution 4.0 international license", "spdx license identifier cc by 4.0", "creative commons attribution license", "licensed under cc by 4.0"],
    "cc-by-sa": ["licensed under a creative commons attribution sharealike 4.0 international license", "spdx license identifier cc by sa 4.0", "creative commons attribution sharealike license", "licensed under cc by sa 4.0"],
    "cc-by-nc": ["licensed under a creative commons attribution noncommercial 4.0 international license", "spdx license identifier cc by nc 4.0", "creative commons attribution noncommercial license", "licensed under cc by nc 4.0"],
    "cc0": ["dedicated to the public domain under cc0 1.0", "spdx license identifier cc0 1.0", "released under cc0 1.0 universal"],
    "proprietary": ["all rights reserved", "proprietary and confidential unauthorized copying of this file is strictly prohibited", "all rights reserved by the owner", "confidential and proprietary all rights reserved"],
}
# What stands before a licence's name, and can stand before several names.
HEADS = ["licensed under the", "licensed under a", "released under the", "under the terms of the", "subject to the terms of the", "spdx license identifier", "spdx license identifier cc by"]
# Notices and names of licences outside the list (every second name is held out), wordings around a notice, and prose with the same words.
UNKNOWN = [
    "licensed under the {} license", "licensed under the {} public license version 2.0", "released under the {} public license", "released under the {} license version 1.0", "distributed under the {} license",
    "distributed under the terms of the {} license version 3.0", "subject to the terms of the {} license", "made available under the {} public license", "provided as is under the {} license", "spdx license identifier {}",
    "this is free and unencumbered software released into the public domain",
]
NAMES = ["eclipse", "open software", "artistic", "common development and distribution", "sample corpus", "european union", "boost software", "example", "zlib", "academic free", "unlicense", "educational community"]
OPENINGS = ["this work is", "this document is", "this file is", "copyright 2021 the authors", "the text is", "unless stated otherwise this is", "this program is free software you can redistribute it and or modify it", ""]
CLOSINGS = ["see the license for details", "or at your option any later version", "see license file", "you may obtain a copy of the license at", "use as you like", ""]
PROSE = [
    "the driver's license was valid for 2 years", "a license to teach was granted in version 2.0 of the rules", "general public access is free of charge", "licensed under terms to be agreed",
    "the mit campus is large", "the apache helicopter version 2.0", "attribution of the painting is public", "the rights of all are reserved for later", "the creative use of commons is common",
    "this file is large", "the text is long", "unless stated otherwise this is true", "copyright is a right of authors", "the foundation published version 3 of the report", "see the file for details",
    "distributed under the terms of the agreement with the {}", "made under the terms of the contract with the {}", "released under the agreement of the {}", "subject to the terms of the {} treaty", "licensed under an agreement with the {}",
    "the terms of the agreement version 2", "version 2 and version 3 of the {}", "version 3 of the {}", "the version 2.0 of {}", "the {} license plates are for sale", "the public domain software museum is free",
    "chapter 3 and page 2", "2.1 and 3 are numbers", "part 2 or part 3", "room 3", "2", "3", "2.1",
]
OUTSIDE = "unknown"
_PUNCTUATION = re.compile(r"[^\w.]+|\.(?!\d)")
_VERSION = re.compile(r"(?:(?<=gpl)|\b)v\.?(?=\d)")  # GPLv2, v3
_WHOLE = re.compile(r"(?<![\d.])(\d+)(?:\.0)+(?![\d.])")  # 2.0 is 2
_BLANK = re.compile(rb"\n[ \t\r\x0b\x0c]*\n\s*")


def tokens(text: str) -> list[str]:
    """Words and numbers; abbreviated versions are written out (GPLv2 and GPL-2.0 are gpl 2)."""
    plain = _VERSION.sub(" ", text.lower()) if any(x.isdigit() for x in text) else text.lower()
    return _WHOLE.sub(r"\1", _PUNCTUATION.sub(" ", plain).replace("_", " ")).split()


def paragraphs(text: bytes) -> list[list[bytes]]:
    return [words for words in (part.split() for part in _BLANK.split(text)) if words]


def _pairs(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:], strict=False))


def _add_by(out: np.ndarray, owner: np.ndarray, values: np.ndarray) -> None:
    """Add rows of values to the rows of out that owner, which is sorted, names."""
    if len(owner):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[first]] += np.add.reduceat(values, first, axis=0)


@dataclass
class LicenceModel:
    classes: list[str]
    words: dict[str, int]  # from 1; 0 stands for all others
    pairs: np.ndarray  # (words + 1) x (words + 1): row of pair_weights
    word_weights: np.ndarray
    pair_weights: np.ndarray
    bias: np.ndarray
    slope: np.ndarray  # calibration of each class: slope and level of its score
    level: np.ndarray
    templates: list[tuple[int, frozenset[int]]] = field(default_factory=list)  # class and pairs
    member: np.ndarray | None = None  # pairs x templates: whether the template has the pair
    head_pairs: frozenset[int] = frozenset()
    seen: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def numbers(self, word: bytes) -> tuple[int, ...]:
        """Word numbers of what one stretch between white space holds."""
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 300_000:
                self.seen.clear()
            found = self.seen[word] = tuple(self.words.get(w, 0) for w in tokens(word.decode()))
        return found

    def features(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For words and for pairs: the stretch and the number of every different one that a stretch has."""
        owner = np.repeat(np.arange(len(starts)), lengths)
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
        pair = np.append(self.pairs[flat[:-1], flat[1:]], 0) if len(flat) else flat
        inner = place + 1 < (starts + lengths)[owner]
        out = []
        for number, which in ((flat[place], np.ones(len(place), bool)), (pair[place], inner)):
            hit = np.flatnonzero((number > 0) & which)
            wide = len(self.words) + len(self.pair_weights) + 1
            out.append(tuple(np.divmod(np.unique(owner[hit].astype(np.int64) * wide + number[hit]), wide)))
        return out

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        out = np.tile(self.bias, (n, 1))
        for (owner, number), weights in zip(found, (self.word_weights, self.pair_weights), strict=True):
            _add_by(out, owner, weights[number])
        return out

    def probabilities(self, found: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.scores(found, n) + self.level, -60, 60)))


def _has_half(pairs: set[tuple[str, str]], known: list[frozenset]) -> Iterator[bool]:
    """For each known set: whether half of it is in pairs."""
    return (2 * len(t & pairs) >= len(t) for t in known)


def _examples(lines: list[str], part: int, seed: int, most: int) -> list[tuple[list[str], frozenset[str]]]:
    """Stretches and their classes; part 0 to train on, part 1 with the wordings and licences that are held out."""
    pick = random.Random(seed)
    known = [frozenset(_pairs(tokens(t))) for ts in TEMPLATES.values() for t in ts]
    plain = [w for w in map(tokens, lines) if w and not any(_has_half(set(_pairs(w)), known))]
    prose = [w for words in plain for w in words]
    opening, closing = ([x for i, x in enumerate(xs[:-1]) if i % 2 == part] + [""] for xs in (OPENINGS, CLOSINGS))
    notices = {f: ts[-1:] if part else ts[:-1] for f, ts in TEMPLATES.items()}

    def around(words: list[str]) -> list[str]:
        room = pick.choice((0, max(STRETCH - len(words), 0)))
        at, split = pick.randrange(len(prose) + 1), pick.randrange(room + 1)
        before, after = prose[at : at + split], prose[at + split : at + room]
        return [*before, *tokens(pick.choice(opening)), *words, *tokens(pick.choice(closing)), *after]

    rows = [(around(tokens(ts[i % len(ts)])), frozenset([f])) for f, ts in notices.items() for i in range(max(60, 30 * len(ts)))]
    for _ in range(300):  # stretches with two families
        a, b = pick.sample(sorted(notices), 2)
        rows.append((around([*tokens(pick.choice(notices[a])), *pick.choice([["or"], ["and"], ["or", "the"], []]), *tokens(pick.choice(notices[b]))]), frozenset([a, b])))
    names = [x for i, x in enumerate(NAMES) if i % 2 == part]
    named = lambda: pick.choice(names) if not plain or pick.random() < 0.5 else " ".join(pick.choice(plain)[: pick.randrange(1, 3)])
    rows += [(around(tokens(x.format(named()))), frozenset([OUTSIDE])) for x in UNKNOWN for _ in range(20)]
    word = lambda: pick.choice(prose) if prose else ""
    rows += [(around(tokens(x.format(word()))), frozenset()) for x in PROSE for _ in range(20)] + [(around([]), frozenset()) for _ in range(100)]
    return rows + [(w[i : i + STRETCH], frozenset()) for w in pick.sample(plain, min(len(plain), most)) for i in range(0, len(w), STRETCH)]


def _coded(model: LicenceModel, rows: list[tuple[list[str], frozenset[str]]]) -> tuple[list, np.ndarray]:
    lengths = np.array([len(w) for w, _ in rows], np.int64)
    flat = np.array([model.words.get(w, 0) for words, _ in rows for w in words], np.int64)
    gold = np.array([[k in y for k in model.classes] for _, y in rows], float)
    return model.features(flat, np.cumsum(lengths) - lengths, lengths), gold


def _descend(model: LicenceModel, rows: list[tuple[list[str], frozenset[str]]], rounds: int, penalty: float) -> None:
    """AdaGrad on the whole sample, all classes side by side."""
    found, gold = _coded(model, rows)
    held = [model.word_weights, model.pair_weights, model.bias]
    for x in held:
        x[...] = 0
    past = [np.full_like(x, 1e-8) for x in held]
    turned = [(owner[by], number[by]) for owner, number in found for by in [np.argsort(number, kind="stable")]]
    for _ in range(rounds):
        error = gold - 1 / (1 + np.exp(-np.clip(model.scores(found, len(rows)), -60, 60)))
        grads = [np.zeros_like(x) for x in held[:2]]
        for g, (owner, number) in zip(grads, turned, strict=True):
            _add_by(g, number, error[owner])
        for x, g, p in zip(held, [*grads, error.sum(axis=0)], past, strict=True):
            g = g - penalty * len(rows) * x
            p += g**2
            x += 0.5 * g / np.sqrt(p)


def _curve(score: np.ndarray, gold: np.ndarray) -> tuple[float, float]:
    """Slope and level of the logistic curve through the held-out scores of a class, near those of the uncalibrated score."""
    both, prior = np.stack([score, np.ones_like(score)], axis=1), np.array([1.0, 0.0])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(both @ w, -60, 60)))
        w = w - np.clip(np.linalg.solve((both * (p * (1 - p))[:, None]).T @ both + np.eye(2), both.T @ (p - gold) + (w - prior)), -0.3, 0.3)
    return max(float(w[0]), 0.05), float(w[1])


def train(lines: list[str], seed: int = 7, rounds: int = 200, penalty: float = 2e-5, frequent: int = 3, sample_lines: int = SAMPLE_LINES) -> LicenceModel:
    """lines: paragraphs of the corpus (a bounded sample) for neighbours and negative examples, sample_lines of them at most whole.

    Words and pairs that occur frequent times or more in notices, around them, or in prose about licences are features.
    """
    rows, test = _examples(lines, 0, seed, sample_lines), _examples(lines, 1, seed + 1, sample_lines)
    classes = [*TEMPLATES, OUTSIDE]
    texts = [tokens(t) for ts in TEMPLATES.values() for t in ts]
    told = [tokens(x) for x in (*HEADS, *OPENINGS, *CLOSINGS, *NAMES, *(x.replace("{}", ".") for x in UNKNOWN + PROSE))]
    times = Counter(w for words, y in rows + test if y for w in set(words))
    prose = Counter(w for words, y in rows + test if not y for w in set(words))
    own = {w for words in texts + told for w in words}
    number = {w: i + 1 for i, w in enumerate(sorted(own | {w for w, n in times.items() if n >= 10 * frequent and n > prose[w]}))}
    often = Counter(p for words, y in rows + test if y for p in set(_pairs(words)))
    chosen = {p for words in texts for p in _pairs(words)} | {p for p, n in often.items() if n >= frequent and p[0] in number and p[1] in number}
    pairs = np.zeros((len(number) + 1, len(number) + 1), np.int32)
    for i, (a, b) in enumerate(sorted(chosen | {p for words in told for p in _pairs(words)})):
        pairs[number[a], number[b]] = i + 1
    k = len(classes)
    model = LicenceModel(classes, number, pairs, np.zeros((len(number) + 1, k)), np.zeros((int(pairs.max()) + 1, k)), np.zeros(k), np.ones(k), np.zeros(k))
    numbered = lambda words: frozenset(int(pairs[number[a], number[b]]) for a, b in _pairs(words))
    model.templates = [(i, numbered(tokens(t))) for i, ts in enumerate(TEMPLATES.values()) for t in ts]
    model.member = np.zeros((len(model.pair_weights), len(model.templates)), np.int32)
    for t, (_, wanted) in enumerate(model.templates):
        model.member[list(wanted), t] = 1
    model.head_pairs = frozenset().union(*(numbered(tokens(x)) for x in HEADS))
    _descend(model, rows, rounds, penalty)
    found, gold = _coded(model, test)
    curves = [_curve(s, y) for s, y in zip(model.scores(found, len(test)).T, gold.T, strict=True)]
    model.slope, model.level = (np.array(x) for x in zip(*curves, strict=True))
    _descend(model, rows + test, rounds, penalty)  # what was held out trains too, once the curves are known
    return model


@dataclass
class Notice:
    family: int
    quality: tuple[float, int]  # share and number of the template's pairs
    at: list[int]  # places of the pairs


def _places(pair: np.ndarray, k: int, wanted: frozenset[int], alike: float) -> Iterator[Notice]:
    """Groups of words close together with most of the pairs of a template, the best first and no place twice."""
    at = np.flatnonzero(np.isin(pair, np.fromiter(wanted, np.int64))).tolist()
    reach, least = int(1.5 * len(wanted)) + 4, alike * len(wanted)
    best: list[tuple[float, int, list[int]]] = []
    for i, first in enumerate(at):
        group, have = [], set()
        for p in at[i:]:
            if p - first > reach:
                break
            if pair[p] not in have:
                have.add(pair[p])
                group.append(p)
        if len(have) >= least:
            gaps = group[-1] - first + 1 - len(have)
            best.append((0.3 * gaps - len(have), first, group))
    taken: set[int] = set()
    for _, _, group in sorted(best):
        if taken.isdisjoint(group):
            taken.update(group)
            yield Notice(k, (len(group) / len(wanted), len(group)), group)


def notices(model: LicenceModel, pair: np.ndarray, templates: list[int], alike: float) -> list[Notice]:
    """The notices of a paragraph: the best match goes first, and one whose own words mostly belong to it already is none.

    Matches of one family that share a word are one notice, and so are a short name and a longer notice of its family at
    most STEP words away.
    """
    found = [x for t in templates for x in _places(pair, *model.templates[t], alike)]
    taken: set[int] = set()
    out, by_family = [], {}
    for x in sorted(found, key=lambda x: (-x.quality[0] * min(x.quality[1], 4), -x.quality[1], x.at)):
        own = [p for p in x.at if pair[p] not in model.head_pairs]
        if own and 2 * sum(p in taken for p in own) < len(own):
            taken.update(x.at)
            reach = lambda y: STEP if x.quality[1] < min(4, y.quality[1]) else 1  # noqa: B023, E731
            same = [y for y in by_family.setdefault(x.family, []) if x.at[0] <= y.at[-1] + reach(y) and y.at[0] <= x.at[-1] + reach(y)]
            if same:
                same[0].at = sorted({*same[0].at, *x.at})
            else:
                by_family[x.family].append(x)
                out.append(x)
    return out


def classify(model: LicenceModel, text: bytes, least: float = 0.5, alike: float = 0.75) -> tuple[int, dict[str, int]]:
    """Paragraphs of a whole text, and how many confirmed notices of each family it has; 'unknown' for what only one test takes."""
    parts = [[n for w in words for n in model.numbers(w)] for words in paragraphs(text)]
    total, counts = len(parts), Counter()
    flat = np.fromiter((n for part in parts for n in part), np.int64)
    if len(flat) < 2 or not flat.any():
        return total, {}
    lengths = np.array([len(x) for x in parts], np.int64)
    heads = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(total), lengths)
    pair = np.append(model.pairs[flat[:-1], flat[1:]], 0)
    pair[heads[1:][lengths[1:] > 0] - 1] = 0  # none across paragraphs
    many = np.maximum(1, -(-np.maximum(lengths - STRETCH, 0) // STEP) + 1)
    whose = np.repeat(np.arange(total), many)
    starts = heads[whose] + (np.arange(len(whose)) - np.repeat(np.cumsum(many) - many, many)) * STEP
    sizes = np.minimum(STRETCH, (heads + lengths)[whose] - starts)
    chance = model.probabilities(model.features(flat, starts, sizes), len(starts))
    hit = np.flatnonzero(pair)
    wide = len(model.pair_weights)
    which, different = np.divmod(np.unique(owner[hit] * wide + pair[hit]), wide)
    close: dict[int, list[int]] = {}
    if len(which):
        first = np.flatnonzero(np.diff(which, prepend=-1))
        enough = np.add.reduceat(model.member[different], first, axis=0) >= alike * model.member.sum(axis=0)
        for row, t in np.argwhere(enough).tolist():
            close.setdefault(int(which[first[row]]), []).append(t)
    taken = chance >= least
    for i in sorted({*close, *whose[taken.any(axis=1)].tolist()}):
        first, last = int(np.searchsorted(whose, i)), int(np.searchsorted(whose, i, side="right"))
        left = {j for j in range(first, last) if taken[j].any()}  # stretches that no notice explains
        for x in notices(model, pair[heads[i] : heads[i] + lengths[i]], close.get(i, []), alike):
            near = [j for j in range(first, last) if starts[j] - heads[i] <= x.at[-1] + 1 and x.at[0] < starts[j] - heads[i] + sizes[j]]
            counts[model.classes[x.family] if taken[near, x.family].any() else OUTSIDE] += 1
            left.difference_update(near)
        counts[OUTSIDE] += sum(j - 1 not in left for j in left)  # neighbouring stretches are one
    return total, {k: n for k, n in counts.items() if n}


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> LicenceModel:
    """Train with paragraphs' lines of at most sample_docs documents of the corpus, in hash order of their ids; rows of one id count once."""
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).filter("__text is not null")
    # Ids are chosen first: else every task would send its candidates' texts to the driver.
    some = texts.select("__id").filter("__id is not null").distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample_docs)
    rows = one_text(docs, some, id_col, text_col).collect()
    return train(sorted({line for r in rows for line in r["__text"].split("\n") if line.strip()}))


def licence_scan(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_paragraphs, families (array of family and n, the number of its notices, by name).

    Every paragraph of the whole text is scored, a very long one in stretches. A null or empty text has no paragraphs. A
    probability of exactly one half counts as predicted. Repeated rows are scanned each; null identifiers stay; extra
    columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("family", pa.string()), ("n", pa.int64())]))
        for batch in sliced(batches):
            found = [classify(shared.value, t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            named = [[{"family": f, "n": n} for f, n in sorted(c.items())] for _, c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(named, kind)], names=["doc_id", "n_paragraphs", "families"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_paragraphs long, families array<struct<family: string, n: long>>")
