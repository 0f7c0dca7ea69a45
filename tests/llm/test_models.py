"""Learned operators: held-out accuracy, and their parts against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from decoylog.llm import language_id, quality_model

SYLLABLES = {
    "aa": ["ba", "bo", "lu", "mi", "sa"],
    "bb": ["tch", "ski", "wo", "pra", "lu"],
    "cc": ["é", "ñu", "ção", "mi", "ra"],
}


def prose(lang, source, n):
    return " ".join(
        "".join(source.choice(SYLLABLES[lang]) for _ in range(source.randint(1, 4)))
        for _ in range(n)
    )


def test_language_of_unseen_documents(docs_of):
    source = random.Random(9)
    langs = sorted(SYLLABLES)
    rows = [(i, prose(langs[i % 3], source, source.randint(3, 40)), langs[i % 3]) for i in range(300)]
    # Wrong labels on held-out rows must not matter; nor may their text teach.
    held = F.col("doc_id") % 4 == 2
    shown = [(i, t, lang if i % 4 != 2 else "zz") for i, t, lang in rows]
    shown += [(1000, None, "aa"), (1001, "123 !", "aa"), (1002, "", None), (1003, "lumi sa", None)]
    docs = docs_of(shown)
    found = {
        r.doc_id: r for r in language_id.identify(docs, held, F.col("doc_id") % 4 == 3).collect()
    }
    assert len(found) == len(shown)
    right = [found[i].lang_pred == lang for i, _, lang in rows if i % 4 == 2]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.lang_pred in (*langs, "und") for r in found.values())
    for i in (1000, 1001, 1002):
        assert (found[i].lang_pred, found[i].score, found[i].rejected) == ("und", 0.0, True)
    assert found[1003].lang_pred != "und"


def test_text_in_no_learned_language_is_rejected(docs_of):
    source = random.Random(10)
    rows = [(i, prose("aa" if i % 2 else "bb", source, 30), "aa" if i % 2 else "bb") for i in range(120)]
    rows += [(500, "жук ёж щука фонарь эхо юла цифра " * 6, None)]
    found = language_id.identify(docs_of(rows), F.lit(False), F.col("doc_id") % 4 == 3).collect()
    rejected = {r.doc_id for r in found if r.rejected}
    assert 500 in rejected and len(rejected) < 12


def plain_kneser_ney(texts):
    """log P(c | three characters before), by dictionaries."""
    order = language_id.ORDER
    counts = Counter()
    for text in texts:
        padded = " " * (order - 2) + f" {text} "
        counts.update(padded[i : i + order] for i in range(len(padded) - order + 1))
    tables = {order: counts}
    for size in range(order - 1, 0, -1):
        tables[size] = Counter(gram[1:] for gram in tables[size + 1])

    def probability(gram):
        p = language_id.UNSEEN
        for size in range(1, order + 1):
            table, part = tables[size], gram[order - size :]
            once = sum(n == 1 for n in table.values())
            twice = sum(n == 2 for n in table.values())
            discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
            same = [n for g, n in table.items() if g[:-1] == part[:-1]]
            if same:
                own = max(table.get(part, 0) - discount, 0)
                p = (own + discount * len(same) * p) / sum(same)
        return np.log(p)

    return probability


def test_models_are_kneser_ney(docs_of):
    source = random.Random(11)
    texts = [prose("aa", source, 8) for _ in range(12)]
    docs = docs_of([(i, t, "aa") for i, t in enumerate(texts)])
    (model,) = language_id.Models(language_id.gram_counts(docs, F.lit(0))).read(0)
    plain = plain_kneser_ney(texts)
    grams = ["  ba", " bal", "balu", "alum", "zzzz", "sa b", "mi z", "lulu"]
    each = [language_id.packed(np.array([ord(c) for c in g])) for g in grams]
    packed = tuple(np.concatenate(column) for column in zip(*each))
    assert language_id.log_probability(model, packed) == pytest.approx([plain(g) for g in grams])
    for hashes, _, contexts, _ in model:
        assert (hashes[1:] > hashes[:-1]).all()
        assert (contexts[1:] > contexts[:-1]).all()


def test_blocks_change_no_entropy(monkeypatch):
    source = random.Random(12)
    texts = [prose("cc", source, n) for n in (1, 3, 200)]
    model = [tuple()]
    scorer = lambda: language_id.Scorer({"models": [[]], "memory": None})
    assert model
    monkeypatch.setattr(
        language_id, "log_probability", lambda _, grams: (grams[1] % np.uint64(97)).astype(float)
    )
    whole = language_id.cross_sums(scorer(), texts)
    monkeypatch.setattr(language_id, "BLOCK", 16)
    monkeypatch.setattr(language_id, "REMEMBERED", 50)
    for part, expected in zip(language_id.cross_sums(scorer(), texts), whole):
        assert part == pytest.approx(expected)


def test_ranges_change_no_result(docs_of, monkeypatch):
    source = random.Random(15)
    langs = sorted(SYLLABLES)
    rows = [(i, prose(langs[i % 3], source, 1 + i % 30), langs[i % 3]) for i in range(120)]
    rows += rows[:5] + [(None, "lumi sa", "aa")] * 2 + [(500, None, None), (501, "", "aa"), (502, "7", "bb")]
    docs = docs_of(rows)
    part = F.coalesce(F.col("doc_id") % 4, F.lit(0))

    def found():
        got = language_id.identify(docs, part == 2, part == 3).collect()
        return sorted(tuple(-1 if x is None else x for x in r) for r in got)

    whole = found()
    assert len(whole) == len(rows)
    monkeypatch.setattr(language_id, "RANGE_ROWS", 150)
    assert language_id.Models(language_id.gram_counts(docs, F.lit(0))).ranges > 3
    for a, b in zip(found(), whole, strict=True):
        assert a[:3] == b[:3] and a[5] == b[5]
        assert a[3:5] == pytest.approx(b[3:5])


def test_no_limit_of_languages_and_whole_code_points(docs_of):
    # Each language has letters of its own, some of them 2^16 apart.
    letters = [chr(0x4E00 + i) for i in range(70)] + [chr(0x24E00 + i) for i in range(70)]
    rows = [(4 * i + k, letters[i] * (k + 3), f"l{i:03}") for i in range(140) for k in (0, 1, 2)]
    docs = docs_of(rows)
    found = language_id.identify(docs, F.col("doc_id") % 4 == 2, F.lit(False)).collect()
    assert len(found) == len(rows)
    assert all(r.lang_pred == f"l{r.doc_id // 4:03}" for r in found)


def test_estimation_finds_the_accuracies():
    source = np.random.default_rng(13)
    good = source.random(20_000) < 0.8
    says_good = np.array([[0.95, 0.2], [0.9, 0.4], [0.99, 0.3], [0.85, 0.1]])  # given good, bad
    rows = []
    for g in good:
        p = says_good[:, 0 if g else 1]
        said = source.random(4) < p
        silent = source.random(4) < 0.1
        rows.append("".join("0" if s else "+" if v else "-" for v, s in zip(said, silent)))
    counts = Counter(rows)
    names = sorted(counts)
    posterior, table, prior = quality_model.estimate(names, np.array([counts[n] for n in names], float))
    assert prior == pytest.approx(0.8, abs=0.02)
    assert table[:, 1] == pytest.approx(says_good[:, 0], abs=0.03)
    assert table[:, 0] == pytest.approx(says_good[:, 1], abs=0.05)
    by_name = dict(zip(names, posterior))
    right = np.mean([(by_name[r] > 0.5) == g for r, g in zip(rows, good)])
    assert right > 0.93


def test_classifier_keeps_prose_and_drops_junk(docs_of):
    source = random.Random(14)
    clean = lambda: ". ".join(prose(source.choice(["aa", "bb"]), source, 12).capitalize() for _ in range(9)) + "."
    junk = [
        lambda: " ".join([prose("aa", source, 1)] * 40 + [prose("bb", source, 1)] * 40),
        lambda: " ".join(w.upper() + "!!" for w in prose("aa", source, 60).split()),
        lambda: " ".join(w + "***" for w in prose("bb", source, 60).split()),
        lambda: " | ".join(prose("aa", source, 60).split()),
    ]
    rows = [(i, source.choice(junk)() if i % 6 == 0 else clean()) for i in range(360)]
    rows += [(1000, None), (1001, ""), (1002, " \n")]
    found = {r.doc_id: r for r in quality_model.classify(docs_of(rows)).collect()}
    assert np.mean([found[i].kept for i in range(360) if i % 6]) > 0.98
    assert np.mean([not found[i].kept for i in range(0, 360, 6)]) > 0.9
    for i in (1000, 1001, 1002):
        assert found[i].score == 0 and not found[i].kept
