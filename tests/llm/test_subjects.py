import itertools
import math
import random

import numpy as np
import pytest

from tabulon.llm.subjects import AROUND, LatentModel, Patterns, at_least, fit_lexicon, sentences, subjects_of, words

TERMS = {
    "sport": ["goal", "referee", "league", "striker", "medal", "penalty"],
    "law": ["judge", "court", "lawsuit", "statute", "verdict", "penalty"],
    "software": ["compiler", "browser", "server", "thread", "keyboard", "bug"],
}
FILLER = ["door", "chair", "rain", "street", "garden", "mirror"]


def corpus(n, seed=0):
    rng = random.Random(seed)
    docs, labels, truth = [], [], {}
    for i in range(n):
        main = rng.choice([*TERMS, None])
        parts = []
        for _ in range(rng.randint(1, 9)):
            t = main if rng.random() < 0.7 else rng.choice([None, None, *TERMS])
            a, b, c = rng.sample(TERMS[t] if t else FILLER, 3)
            parts.append((t, rng.choice([f"Later Mr. X{i} compared {a} with {b} and {c}.", f"Is {a} more than {b}?", f"Without {a} there is no {b}!"])))
        docs.append((i, " ".join(p for _, p in parts), None, f"b{i % 7}", f"s{i % 3}", 1))
        truth[i] = {t for t in TERMS if 5 * sum(x == t for x, _ in parts) >= len(parts)}
        if i % 3 == 0:
            told = truth[i] or {"none"}
            told = {rng.choice([*TERMS])} if rng.random() < 0.05 else told
            labels += [(i, s, "a") for s in told] + [(i, s, "b") for s in told]
    return docs, labels, truth


def test_sentences():
    text = "First came A. Is it? Yes! He left.\nSt. Abel is far. J. Doe wrote… End"
    assert sentences(text) == ["First came A. Is it?", "Yes!", "He left.", "St. Abel is far.", "J. Doe wrote…", "End"]
    assert sentences("一。二！三") == ["一。", "二！", "三"]
    assert sentences("") == [] and sentences(" \n. ") == []
    assert len(sentences("a " * 100_000 + ". b c d.")) == 2


def test_held_out_accuracy(rows):
    docs, labels, truth = corpus(900)
    d = rows(docs, "doc_id long, text string, tgt string, bundle string, source string, lead int")
    known = rows(labels, "doc_id long, subject string, annotator string")
    lexicon = fit_lexicon(d, "doc_id", "text", known, list(TERMS), parallel="tgt")
    got = {}
    for r in subjects_of(d, "doc_id", "text", lexicon, address="bundle", source="source", labels=known).collect():
        got.setdefault(r["id"], set()).add(r["subject"])
    told = {i for i, *_ in labels}
    wrong = sum(got.get(i, set()) != t for i, t in truth.items() if i not in told)
    assert wrong <= 0.05 * (len(truth) - len(told))
    odd = rows([(1, None, "b", "s"), (2, "", None, None), (3, "...", "b", "s"), (4, "Is judge more than court?", None, None), (4, "Is judge more than court?", "b", "s")], "doc_id long, text string, bundle string, source string")
    assert sorted((r["id"], r["subject"]) for r in subjects_of(odd, "doc_id", "text", lexicon, address="bundle", source="source").collect()) == [(4, "law"), (4, "law")]
    assert subjects_of(odd.limit(0), "doc_id", "text", lexicon, address="bundle", source="source").count() == 0


def drawn(words, around, n=8000, classes=4, labelled=0.3, seed=5):
    """Vote patterns of sentences whose surroundings share one error: right together or wrong together, mostly."""
    rng = random.Random(seed)
    found = {}
    pack = Patterns(classes)
    for _ in range(n):
        z = rng.randrange(classes)
        wrong = (z + rng.randint(1, classes - 1)) % classes
        first, again = (z if rng.random() < words else (z + rng.randint(1, classes - 1)) % classes for _ in "ab")
        common = z if rng.random() < around else wrong
        votes = [common if rng.random() < 0.95 else rng.randrange(classes) for _ in AROUND]
        code = int(pack.pack(np.array(0), np.array(first), np.array(-1), np.array(again), np.array(-1), *map(np.array, votes)))
        label = (z,) if z < classes - 1 and rng.random() < labelled else None
        found[code, label] = found.get((code, label), 0) + 1
    return [c for c, _ in found], [x for _, x in found], list(found.values())


def test_accuracies_are_learnt_although_the_surroundings_depend_on_each_other():
    for words, around in ((0.97, 0.55), (0.7, 0.9)):
        m = LatentModel(*drawn(words, around), 4)
        report = {name: accuracy for name, _, accuracy in m.report}
        assert report["clear"] == pytest.approx(words, abs=0.05)
        for name in AROUND:
            assert report[name] == pytest.approx(around, abs=0.07)
    # Three surroundings that agree do not outvote clear words that are right more often.
    m = LatentModel(*drawn(0.97, 0.55), 4)
    code = Patterns(4).pack(np.array([0]), *map(np.array, ([1], [-1], [1], [-1])), *[np.array([2])] * 3)
    assert m.of(code)[0].argmax() == 1


def test_surroundings_settle_what_the_words_leave_open():
    pack = Patterns(4)
    codes = pack.pack(np.array([11, 11]), np.array([0, 0]), np.array([1, 1]), *[np.array([-1, -1])] * 2, *np.array([[1, -1]] * 3))
    m = LatentModel(codes.tolist(), [None, None], [1.0, 1.0], 4)
    p = m.of(codes)
    assert p[0].argmax() == 1 and p[0, 1] > p[1, 1] + 0.1 and p[1, 0] > 0.3 > p[1, 2]


def test_probability_of_enough_events():
    rng = np.random.default_rng(1)
    p = np.where(rng.random((7, 3)) < 0.3, 1.0, rng.random((7, 3)))
    for m in (1, 3, 5):
        want = [sum(math.prod(p[i, j] if s[i] else 1 - p[i, j] for i in range(7)) for s in itertools.product((0, 1), repeat=7) if sum(s) >= m) for j in range(3)]
        assert at_least(p, np.full(3, m)).tolist() == pytest.approx(want, abs=0.01)


def test_many_subjects_and_scripts():
    pack = Patterns(60)
    votes = [np.array([v]) for v in (59, 31, -1, 7, -1, 58, -1)]
    assert [x.tolist() for x in pack.unpack(pack.pack(np.array([3]), *votes))] == [[3]] + [v.tolist() for v in votes]
    assert len(sentences("\u092f\u0939 \u0939\u0948\u0964 \u0935\u0939 \u0939\u0948\u0964")) == 2
    assert words("\u88c1\u5224\u6240\u306f") == {"\u88c1\u5224", "\u5224\u6240", "\u6240\u306f"}
    assert words("Don't STOP") == {"don", "t", "stop"}


def test_without_labels(rows):
    docs, _, _ = corpus(30)
    d = rows(docs, "doc_id long, text string, tgt string, bundle string, source string, lead int")
    lexicon = fit_lexicon(d, "doc_id", "text", rows([], "doc_id long, subject string"), list(TERMS))
    assert subjects_of(d, "doc_id", "text", lexicon, address="bundle", source="source").count() == 0
    from tabulon.errors import EngineError

    with pytest.raises(EngineError):
        fit_lexicon(d, "doc_id", "text", rows([], "doc_id long, subject string"), [])
