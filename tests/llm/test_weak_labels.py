"""The weak-label model against a plain version, document by document, and against labels."""

import math

import pytest

from decoylog.llm import quality_model as model

SF = "/root/testdata/sf0.01"


def plain_em(votes, steps):
    """Posterior of good per document: sums over documents, one labeller at a time."""
    bad, good = model.VOTES[0], model.VOTES[1]
    belief = [0.95 - 0.45 * min(v.count(bad), 2) for v in votes]
    for _ in range(steps):
        prior = {
            True: (sum(belief) + 1) / (len(votes) + 2),
            False: (sum(1 - b for b in belief) + 1) / (len(votes) + 2),
        }
        says_good = {}
        for labeller in range(len(votes[0])):
            for kind in (True, False):
                yes = no = 1.0
                for v, b in zip(votes, belief):
                    share = b if kind else 1 - b
                    yes += share if v[labeller] == good else 0.0
                    no += share if v[labeller] == bad else 0.0
                says_good[labeller, kind] = yes / (yes + no)
        new = []
        for v in votes:
            logs = {}
            for kind in (True, False):
                logs[kind] = math.log(prior[kind])
                for labeller, vote in enumerate(v):
                    p = says_good[labeller, kind]
                    logs[kind] += math.log(p) if vote == good else math.log(1 - p) if vote == bad else 0.0
            new.append(1 / (1 + math.exp(max(-50.0, min(50.0, logs[False] - logs[True])))))
        done = max(abs(a - b) for a, b in zip(new, belief)) < 1e-9
        belief = new
        if done:
            break
    return belief


def plain_scorer(rows):
    """The same descent with a dictionary of weights, one document at a time."""
    mean = min(max(sum(y for _, y in rows) / len(rows), 1e-3), 1 - 1e-3)
    say = [y * 0.5 / mean + (1 - y) * 0.5 / (1 - mean) for _, y in rows]
    total = sum(say)
    places = sorted({p for values, _ in rows for p in values})
    size = 1 << model.FEATURE_BITS
    weights = dict.fromkeys([*places, "constant"], 0.0)
    first, second = dict(weights), dict(weights)
    for step in range(1, model.FIT_STEPS + 1):
        slope = {p: model.PENALTY * w / size for p, w in weights.items()}
        slope["constant"] = 0.0
        for (values, y), s in zip(rows, say):
            raw = weights["constant"] + sum(v * weights[p] for p, v in values.items())
            error = s / total * (1 / (1 + math.exp(-raw)) - y)
            slope["constant"] += error
            for p, v in values.items():
                slope[p] += error * v
        for p, g in slope.items():
            first[p] = 0.9 * first[p] + 0.1 * g
            second[p] = 0.999 * second[p] + 0.001 * g * g
            weights[p] -= 0.1 * (first[p] / (1 - 0.9**step)) / (
                math.sqrt(second[p] / (1 - 0.999**step)) + 1e-10
            )
    return weights


def test_model_against_plain_version(docs_of, words):
    texts = [words(60 + n) + ".\nThe second line, of its own." for n in range(25)]
    texts += ["$$ ## %% " * (20 + n) for n in range(6)] + ["AAAA BBBB CCCC " * (9 + n) for n in range(4)]
    texts += ["short", "", None, "word " * 80, "one line\n" * 30]
    rows = list(enumerate(texts))
    found = {r.doc_id: r for r in model.classify(docs_of(rows)).collect()}
    readings = [model.Reading(text) for text in texts]
    belief = plain_em([reading.votes() for reading in readings], model.EM_STEPS)
    made = []
    for reading in readings:
        places, values = model.features(reading, {})
        made.append(dict(zip(places.tolist(), values.tolist())))
    # Equal texts train once; here all differ but for the empty one and the null.
    different = {text or "": (values, y) for text, values, y in zip(texts, made, belief)}
    assert len(different) == len(texts) - 1
    training = [(v, y) for text, v, y in zip(texts, made, belief)]
    weights = plain_scorer(training)
    for (i, _), values, y in zip(rows, made, belief):
        assert found[i].weak_label == pytest.approx(y, abs=1e-6)
        raw = weights["constant"] + sum(v * weights[p] for p, v in values.items())
        score = 1 / (1 + math.exp(-raw)) if values else 0.0
        assert found[i].score == pytest.approx(score, abs=1e-4)
        assert found[i].kept == (found[i].score >= 0.5)


def test_kept_documents_against_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = model.classify(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    good = [r.kept for r in found if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in found if labels.get(r.doc_id) == 0]
    assert len(good) > 100 and len(bad) > 20
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.05
