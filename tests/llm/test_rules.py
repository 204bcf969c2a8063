"""Fertility rules, quality and toxicity scores, licences."""

from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from folioworks.llm import fertility, labelled, licences, quality, toxicity
from folioworks.llm.scratch import table

SF = "/root/testdata/sf0.1"
FILES = [public_tokenizers.path(x) for x in (fertility.RANKS, fertility.PIECES)]


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    under = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(under) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(under), failed


def test_base_counts(docs_of, odd_rows):
    pick = random.Random(8)
    rows = [*odd_rows, *((i, "\n".join(" ".join(pick.choice(["aé", "b|", "c#", "d"]) for _ in range(pick.randrange(9))) for _ in range(12))) for i in range(30, 60))]
    got = fertility.fertility_rules(docs_of(rows, extra=True), *FILES).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((r["doc_id"] or -1, *(r[n] for n in names)) for r in got) == sorted((d or -1, *plain_base(t)) for d, t in rows)
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert fertility.fertility_rules(docs_of([]), *FILES).count() == 0


def test_token_statistics_and_verdicts_against_whole_texts(spark, docs_of, odd_rows):
    """All four statistics and kept, from the vocabularies' own encoders, for every document and a very long text."""
    import base64

    import sentencepiece
    import tiktoken

    model = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILES[0], "rb"))}
    bpe = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    small = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    rows = small + [(i + 10_000 if i else None, t) for i, t in odd_rows] + [(20_000, " ".join(t for _, t in small[:120]))]
    texts = {i: t or "" for i, t in rows}
    for r in fertility.fertility_rules(docs_of(rows), *FILES).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])
        ids = np.array([i for w in words for i in model.encode(w)], int)
        ranked = sum(len(bpe.encode_ordinary(" " + w)) for w in words)
        share = np.unique(ids, return_counts=True)[1] / max(len(ids), 1)
        want = {"tokens_per_word": ranked / max(len(words), 1), "chars_per_token": sum(map(len, words)) / max(ranked, 1), "byte_share": ((ids >= 3) & (ids < 259)).sum() / max(len(ids), 1), "token_entropy": -(share * np.log2(share)).sum()}
        assert {k: r[k] for k in want} == pytest.approx(want)
        band = fertility.BANDS["en"]  # the language that docs_of gives
        x, y = zip(*band.entropy, strict=True)
        fits = band.fertility[0] <= want["tokens_per_word"] <= band.fertility[1] and band.chars[0] <= want["chars_per_token"] <= band.chars[1]
        fits = fits and want["byte_share"] <= band.bytes_most and want["token_entropy"] >= np.interp(np.log2(max(len(ids), 1)), x, y)
        assert r["kept"] == (not plain_base(texts[r["doc_id"]])[5] and fits)


# Plain sentences by script, none of those that the bands were set on.
SENTENCES = {
    "cyrillic": "Вчера вечером мы долго гуляли по набережной и говорили о том, как быстро меняется наш город. Завтра утром брат поедет на вокзал встречать старых друзей, которые давно обещали приехать в гости.",
    "greek": "Χθες το βράδυ περπατήσαμε στην παραλία και μιλήσαμε για το πόσο γρήγορα αλλάζει η πόλη μας. Αύριο το πρωί ο αδελφός μου θα πάει στον σταθμό για να συναντήσει παλιούς φίλους.",
    "arabic": "مشينا مساء أمس على شاطئ البحر وتحدثنا عن سرعة تغير مدينتنا في السنوات الأخيرة. سيذهب أخي صباح الغد إلى المحطة ليستقبل أصدقاء قدامى وعدوا بزيارتنا منذ زمن طويل.",
    "hebrew": "אתמול בערב הלכנו לטייל על חוף הים ודיברנו על כך שהעיר שלנו משתנה מהר מאוד. מחר בבוקר אחי ייסע לתחנת הרכבת כדי לפגוש חברים ותיקים שהבטיחו לבקר אותנו.",
    "devanagari": "कल शाम हम नदी के किनारे घूमने गए और इस बारे में बात की कि हमारा शहर कितनी जल्दी बदल रहा है। कल सुबह मेरा भाई पुराने दोस्तों से मिलने स्टेशन जाएगा।",
    "han": "昨天晚上我们在河边散步，谈到城市变化得多么快。明天早上哥哥要去火车站接老朋友，他们很久以前就答应来看我们。孩子们在院子里玩，妈妈在厨房做饭。",
    "kana": "昨日の夜、私たちは川のほとりを散歩しながら、町がどれほど早く変わっているかについて話しました。明日の朝、兄は駅へ行って、ずっと前から遊びに来ると約束していた古い友だちを迎えます。",
    "hangul": "어제 저녁에 우리는 강가를 걸으면서 도시가 얼마나 빨리 변하고 있는지 이야기했다. 내일 아침에 형은 오래전부터 놀러 오겠다고 약속한 친구들을 만나러 역에 갈 것이다.",
}


NATURAL = (
    "This library is free software; you can redistribute it and modify it under the terms of the licence as published by the foundation, either version two of the licence or, at your "
    "option, any later version. The library is distributed in the hope that it will be useful, but without any warranty, without even the implied warranty of fitness for a particular "
    "purpose. You should have received a copy of the licence along with this library; if not, write to the address that is given at the end of the file."
)


def test_ordinary_english_is_kept(docs_of):
    texts = {1: NATURAL}
    for i, name in enumerate(("LGPL-2", "LGPL-2.1", "LGPL-3", "GPL-2", "GPL-3", "Apache-2.0", "MPL-2.0")):
        path = Path("/usr/share/common-licenses") / name
        if path.exists():
            texts[2 + i] = path.read_text()
    got = fertility.fertility_rules(docs_of(list(texts.items())), public_tokenizers.path(fertility.RANKS), public_tokenizers.path(fertility.PIECES)).collect()
    assert [r["doc_id"] for r in got if not r["kept"]] == []


@pytest.mark.parametrize("script", sorted(SENTENCES))
def test_bands_of_scripts(script):
    from folioworks.llm.vocab import word_ids

    text, pick, vocab = SENTENCES[script], random.Random(4), word_ids(FILES[1], FILES[0])
    assert fertility.script_of(text) == script and fertility.script_of(text + " and a few words") == script

    def takes(text):
        words = text.encode().split()
        fertility_, per, byte_share, entropy, tokens = fertility.token_counts(vocab, vocab.slots(words), len(b"".join(words).decode()))
        return fertility.band_of("xx", text).takes(fertility_, per, byte_share, entropy, tokens)

    letters = sorted({c for c in text if c.isalpha()})
    assert takes(text)
    assert not takes(" ".join(pick.choice(letters) * 3 for _ in range(2)) * 40)  # a few letters over and over
    if fertility.BANDS[script].fertility[1] < fertility.MANY:
        assert not takes(" ".join("".join(pick.choice(letters) for _ in range(14)) for _ in range(60)))
    assert fertility.script_of("12 34 ...") == "latin" and fertility.script_of("\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35" * 5) == "other"


def test_rules_keep_clean_and_drop_junk(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = fertility.fertility_rules(docs, *FILES).join(labels, "doc_id").filter("not base_failed").select("quality", "kept").collect()
    clean, junk = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.05 * len(junk)


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_quality_on_the_held_out_fold(spark, docs_of, odd_rows):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.verdicts(docs, labels).filter("held_out").join(labels, "doc_id").select("score", "quality").collect()
    assert auc([(r["score"], r["quality"]) for r in rows]) > 0.99
    forest = quality.fit(docs_of([]), labels)
    assert not len(forest.column) and quality.quality(docs_of([]), forest).count() == 0
    got = quality.quality(docs_of(odd_rows, extra=True), forest).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return [0.0] * len(quality.STATISTICS)
    raw, n = text.encode(), len(words)
    lines = [x for x in (re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x) for x in text.split("\n")) if x]
    _, chars, symbols, dup, repeat, _ = plain_base(text)
    times = Counter(words)
    share = [c / n for c in times.values()]
    size = len(raw)
    count = lambda chars: sum(text.count(c) for c in chars)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return [
        np.log1p(n), chars / n, symbols / size, dup / len(lines), repeat / n, count(upper) / size, count("0123456789") / size, count(".,;:!?\"'()-") / size,
        sum(ord(c) > 127 for c in text) / size, len(times) / n, max(share), n / len(lines), sum(x[-1] in ".!?" for x in lines) / len(lines), sum(len(w.encode()) == 1 for w in words) / n,
        sum(c in upper and (i == 0 or text[i - 1] in " \n") for i, c in enumerate(text)) / n, -sum(p * np.log2(p) for p in share) / np.log2(n + 1), text.count("!") / n, text.count(",") / n,
        min(max(len(w.encode()) for w in words), 1000), sum(len(x.encode()) < 20 for x in lines) / len(lines), text.count("|") / n, sum(c for w, c in times.items() if len(w.encode()) > 1 and w.encode().isupper()) / n,
    ]


def test_statistics_against_a_plain_count(spark, odd_rows):
    pick = random.Random(12)
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").collect()] + [t or "" for _, t in odd_rows]
    texts += ["\n".join(" ".join(pick.choice(["aé", "B|", "c,#", "D!", "ÉX.", "12", "LOUD"]) for _ in range(pick.randrange(9))) for _ in range(10)) for _ in range(40)]
    for text in texts:
        assert quality.statistics(text.encode()) == pytest.approx(plain_statistics(text)), text[:80]


def test_forest_walk_equals_a_plain_walk():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(400, 5))
    forest = quality.grow(rows, (rows[:, 0] + rows[:, 1] ** 2 > 0.5).astype(float), trees=12, depth=3)
    for row, score in zip(rows[:50], forest.score(rows[:50]), strict=True):
        total = forest.start
        for t in range(len(forest.column)):
            at = 0
            for _ in range(3):
                at = 2 * at + 1 + int(row[forest.column[t, at]] > forest.threshold[t, at])
            total += forest.leaf[t, at - 7]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_marginals_against_all_paths():
    rng = np.random.default_rng(5)
    trans = np.array([-0.7, 0.3, 1.1])
    weight = {(0, 0): 0.0, (0, 1): trans[0], (1, 0): trans[1], (1, 1): trans[2]}
    lengths = np.array([4, 1, 6])
    emission = rng.normal(size=11)
    ahead, back = toxicity.Chains(lengths).marginals(emission, trans)
    at = 0
    for n in lengths:
        e, hit, total = emission[at : at + n], np.zeros(n), 0.0
        for path in range(1 << n):
            y = [path >> i & 1 for i in range(n)]
            p = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(weight[y[i - 1], y[i]] for i in range(1, n)))
            total += p
            hit += p * np.array(y)
        assert np.allclose(1 / (1 + np.exp(-(ahead + back)[at : at + n])), hit / total)
        at += n


def plain_marginals(emission, trans):
    """Forward-backward over one line, token by token, with normalised probabilities."""
    into, out, stay = trans
    step = np.exp(np.array([[0.0, into], [out, stay]]))
    own = np.stack([np.ones(len(emission)), np.exp(emission)], axis=1)
    ahead, back = np.zeros_like(own), np.ones_like(own)
    for t in range(len(emission)):
        ahead[t] = own[t] * (ahead[t - 1] @ step if t else 1.0)
        ahead[t] /= ahead[t].sum()
    for t in range(len(emission) - 2, -1, -1):
        back[t] = step @ (own[t + 1] * back[t + 1])
        back[t] /= back[t].sum()
    both = ahead * back
    return both[:, 1] / both.sum(axis=1)


@pytest.mark.parametrize("block", [1, 3, 128])
def test_blocks_equal_the_uncut_line(block):
    rng = np.random.default_rng(block)
    trans = np.array([-2.0, -0.5, 1.5])
    lengths = np.array([1, 700, block, 2 * block, 2 * block + 1, 5, 300])
    emission = rng.normal(-3, 3, lengths.sum())
    emission[: len(emission) : 50] = 80
    ahead, back = toxicity.Chains(lengths, block).marginals(emission, trans)
    got, at = toxicity._sigmoid(ahead + back), 0
    for n in lengths:
        assert np.allclose(got[at : at + n], plain_marginals(emission[at : at + n], trans), atol=1e-9)
        at += n


def test_an_offending_pair_at_every_place():
    """Two words that only together offend, at and around the edges of blocks: the same marginals wherever they stand."""
    trans = np.array([-1.5, -0.5, 2.0])
    for at in (126, 127, 128, 255, 256):
        emission = np.full(400, -6.0)
        emission[at : at + 2] = 0.4
        ahead, back = toxicity.Chains(np.array([400])).marginals(emission, trans)
        got = toxicity._sigmoid(ahead + back)
        assert np.allclose(got, plain_marginals(emission, trans), atol=1e-9) and (got[at : at + 2] > 0.4).all()


def test_toxicity_stage_on_odd_rows(spark, docs_of, odd_rows):
    bad = [(100 + i, t) for i, (t, y) in enumerate(toxic_texts()) if y]
    texts = toxic_texts()
    labels = spark.createDataFrame([(1000 + i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    train = [(1000 + i, t) for i, (t, _) in enumerate(texts)]
    docs = docs_of([*odd_rows, *train, *bad, *bad], extra=True)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i or -1 for i in ids if i is None or i < 100) == sorted(i or -1 for i, _ in odd_rows)
    assert sum(i is not None and 100 <= i < 1000 for i in ids) <= 2
    assert toxicity.drop_toxic(docs_of([], extra=True), labels).count() == 0


def toxic_texts():
    pick = random.Random(9)
    words = [f"wort{i}" for i in range(500)]
    rows = []
    for i in range(400):
        text = [pick.choice(words) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                text.insert(pick.randrange(60), "vile" + pick.choice(["st", "ness", "ly", "", "r", "x"]))
        rows.append((" ".join(text), int(i % 4 == 0)))
    return rows


def test_toxic_spans(docs_of, odd_rows):
    model = toxicity.train(toxic_texts(), rounds=30)
    rows = [(1, "wort1 wort2 Vilely, wort3 vilest wort4"), (2, "wort1 wort2 wort3"), *odd_rows]
    got = toxicity.toxicity(docs_of(rows, extra=True), model).collect()
    assert len(got) == len(rows)
    first = next(r for r in got if r["doc_id"] == 1 and r["spans"])
    assert [rows[0][1][s["start"] : s["end"]] for s in first["spans"]] == ["Vilely,", "vilest"] and first["score"] > 0.5
    assert all(r["score"] < 0.5 for r in got if r is not first)


def test_toxicity_without_labels(docs_of, spark):
    labels = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of([(1, "a b"), (2, None)])
    assert all(r["predicted"] == 0 for r in toxicity.verdicts(docs, labels).collect())
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.verdicts(docs_of([]), labels).count() == 0


def test_training_leaves_the_held_out_fold(spark, docs_of):
    import zlib

    docs = docs_of([(i, f"text {i}") for i in range(200)], extra=True)
    labels = spark.createDataFrame([(i, 1, 1) for i in range(200)], "doc_id long, quality int, toxic int")
    texts = [int(t.split()[1]) for t, _ in labelled.training_texts(docs, labels, "toxic", {1: 50})]
    assert len(texts) == 50 and all(zlib.crc32(str(i).encode()) % 5 for i in texts)


def test_licences(spark, docs_of, odd_rows):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = licences.fit(docs)
    notices = {"Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "proprietary", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    for r in docs.collect():
        want = {}
        for line in r["text"].split("\n"):
            if line in notices:
                want[notices[line]] = want.get(notices[line], 0) + 1
        assert licences.classify(model, r["text"].encode())[1] == want
    assert licences.classify(model, b"Licensed under the Frobnicate Public License, Version 2.0.")[1].keys() <= {"unknown"}
    assert licences.licence_scan(docs_of(odd_rows, extra=True), model).count() == len(odd_rows)
    assert licences.licence_scan(docs_of([]), model).count() == 0
    assert licences.fit(docs_of([])).classes[-1] == licences.OUTSIDE


def licence_model(spark):
    texts = table(spark, "/root/testdata/sf0.01", "documents").filter("text is not null").orderBy("doc_id").limit(200).collect()
    return licences.train(sorted({line for r in texts for line in r["text"].split("\n") if line.strip()}))


def test_every_licence_of_a_line(spark):
    model = licence_model(spark)

    def found(text):
        return licences.classify(model, text.encode())[1]

    def filled(*notices):
        return " ".join([" ".join([*(f"wort{i}" for i in range(1250)), n]) for n in notices] + [f"wort{i}" for i in range(1250)])

    mit, gpl, cc = "This file is released under the MIT License.", "Licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."
    for order in ((mit, gpl, cc), (cc, mit, gpl), (gpl, cc, mit)):
        assert found(filled(*order)) == {"cc-by-nc": 1, "gpl-3.0": 1, "mit": 1}
    assert found(filled(mit, mit, mit)) == {"mit": 3}
    for at in range(45):  # however stretches cut a notice, it is one
        assert found(" ".join([*(f"wort{i}" for i in range(at)), gpl, *(f"wort{i}" for i in range(60))])) == {"gpl-3.0": 1}
    for line in ("Licensed under the MIT License or Apache License, Version 2.0.", "SPDX-License-Identifier: MIT OR Apache-2.0"):
        assert found(line) == {"apache-2.0": 1, "mit": 1}
    assert found("Licensed under the GNU General Public License version 2 or the GNU General Public License version 3") == {"gpl-2.0": 1, "gpl-3.0": 1}
    lgpl = "the GNU Lesser General Public License as published by the Free Software Foundation, either version 3"
    assert found(lgpl) == {"lgpl": 1} and found(cc) == {"cc-by-nc": 1}


def test_no_notice_in_prose_is_dropped(spark):
    model = licence_model(spark)
    texts = table(spark, "/root/testdata/sf0.01", "documents").filter("text is not null").orderBy("doc_id").limit(200).collect()
    prose = [w for r in texts for line in r["text"].split("\n") if len(line.split()) > 40 for w in line.split()]
    pick, confirmed, told = random.Random(3), 0, 0
    for family, notices in licences.TEMPLATES.items():
        for notice in notices:
            for _ in range(10):
                at = pick.randrange(len(prose) - 300)
                text = " ".join([*prose[at : at + 150], notice, *prose[at + 150 : at + 300]])
                got = licences.classify(model, text.encode())[1]
                assert got and got.keys() <= {family, "unknown"}, (family, notice, got)
                confirmed, told = confirmed + (family in got), told + 1
    assert confirmed >= 0.9 * told


# How licences are named in public files.
NAMED = {
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option": {"apache-2.0", "mit"},
    "Licensed under either of Apache License, Version 2.0 or GPLv2 at your option": {"apache-2.0", "gpl-2.0"},
    "Dual licensed under MIT and GPLv2.": {"mit", "gpl-2.0"},
    "You may use it under the GPLv2 or the GPLv3.": {"gpl-2.0", "gpl-3.0"},
    "Apache-2.0 OR MIT": {"apache-2.0", "mit"},
    "MIT/Apache-2.0": {"apache-2.0", "mit"},
    "released under GPLv2": {"gpl-2.0"},
    "Released under the GPLv3": {"gpl-3.0"},
    "GPL-3.0-or-later": {"gpl-3.0"},
    "This project is licensed under the LGPLv2.1 or later": {"lgpl"},
    "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": {"gpl-3.0"},
    "MIT License": {"mit"},
    "ISC License": {"isc"},
    "BSD 3-Clause License": {"bsd"},
    "Mozilla Public License 2.0": {"mpl-2.0"},
    "This is free and unencumbered software released into the public domain.": {"unknown"},
    "distributed under the terms of the agreement with the studio": set(),
}


def test_dual_notices_abbreviations_and_headings(spark):
    model = licence_model(spark)
    for text, families in NAMED.items():
        assert licences.classify(model, text.encode())[1] == dict.fromkeys(families, 1), text
    assert licences.tokens("GPLv2+, GPL-3.0, v. 2.0, v1.10.0 and 10.0.1") == ["gpl", "2", "gpl", "3", "v", "2", "1.10.0", "and", "10.0.1"]


def test_template_matches_against_a_plain_search():
    """Each match has enough of the template close together, none share a place, and whatever stretch has enough of it is near one."""
    pick = random.Random(5)
    for _ in range(400):
        wanted = frozenset(range(1, pick.randrange(2, 9)))
        pair = np.array([pick.randrange(1, 9) if pick.random() < 0.4 else pick.choice((0, 99)) for _ in range(80)])
        reach, found = int(1.5 * len(wanted)) + 4, list(licences._places(pair, 0, wanted, 0.75))
        taken = [p for x in found for p in x.at]
        assert len(taken) == len(set(taken))
        for x in found:
            have = {int(pair[p]) for p in x.at}
            assert have <= wanted and len(have) == len(x.at) >= 0.75 * len(wanted) and x.at[-1] - x.at[0] <= reach
            assert x.quality == (len(have) / len(wanted), len(have))
        for first in range(len(pair)):
            stretch = range(first, min(first + reach + 1, len(pair)))
            if len({int(pair[p]) for p in stretch} & wanted) >= 0.75 * len(wanted):
                assert set(range(first, first + 2 * reach + 1)) & set(taken)  # its own match may have gone to a better one


# Headers as they stand in public files.
HEADERS = {
    "gpl-3.0": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
    "gpl-2.0": " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "agpl": "it under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "apache-2.0": "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "cc-by-sa": "Text is available under the Creative Commons Attribution-ShareAlike License 4.0; additional terms may apply.",
}


def test_wrapped_headers_and_two_in_a_paragraph(spark):
    model = licence_model(spark)
    for family, text in HEADERS.items():
        assert licences.classify(model, text.encode()) == (1, {family: 1}), family
    both = licences.classify(model, f"{HEADERS['mit']}\n{HEADERS['apache-2.0']}\n\n \n{HEADERS['isc']}".encode())
    assert both == (2, {"mit": 1, "apache-2.0": 1, "isc": 1})
    for text in ("Licensed under the Frobnicate Public License, Version 2.0.", "This work is licensed under the Marble Public License."):
        assert licences.classify(model, text.encode())[1] == {"unknown": 1}


def test_licence_scores_against_a_plain_sum(spark):
    """Probabilities of random stretches, word by word and pair by pair."""
    model, pick = licence_model(spark), random.Random(11)
    words = sorted(model.words)
    for _ in range(40):
        lengths = [pick.randrange(1, 30) for _ in range(4)]
        flat = np.array([model.words[pick.choice(words)] if pick.random() < 0.8 else 0 for _ in range(sum(lengths))])
        starts = np.cumsum(lengths) - lengths
        got = model.probabilities(model.features(flat, starts, np.array(lengths)), 4)
        for row, a, n in zip(got, starts, lengths, strict=True):
            part = flat[a : a + n].tolist()
            total = model.bias + sum(model.word_weights[i] for i in {*part} - {0})
            total = total + sum(model.pair_weights[i] for i in {int(model.pairs[x, y]) for x, y in zip(part, part[1:])} - {0})
            assert np.allclose(row, 1 / (1 + np.exp(-(model.slope * total + model.level))))


def test_repeated_ids_take_one_place_in_a_sample(spark, docs_of, monkeypatch):
    import zlib

    often = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)  # not in the held-out fold
    docs = docs_of([(i, f"text {i}") for i in range(100)] + [(often, f"text {often} again {i % 9}") for i in range(3000)] + [(often, None)], extra=True)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(100)] + [(often, 1, often % 2)] * 3000, "doc_id long, quality int, toxic int")
    kept = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    got = labelled.training_texts(docs, labels, "toxic", {0: 200, 1: 200})
    assert sorted(got) == sorted((f"text {i}", i % 2) for i in kept)
    assert len(labelled.training_texts(docs, labels, "toxic", {0: 20, 1: 20})) == 40
    monkeypatch.setattr(licences, "train", lambda lines: lines)
    assert licences.fit(docs, sample_docs=200) == sorted(f"text {i}" for i in range(100))
    assert len(licences.fit(docs, sample_docs=30)) == 30
