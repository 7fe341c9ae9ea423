"""The two classifiers against plain forms of the same problems: the hinge-loss dual by projected gradient, and kernel ridge regression on the full kernel."""

import random

import numpy as np

from pulsegrid.llm import langid, quality

SOUNDS = {"aa": ["ka", "ko", "ri", "na"], "bb": ["ter", "sch", "ung", "na"], "cc": ["eau", "oui", "ent", "ri"]}


def quality_rows(n, seed):
    rng = random.Random(seed)
    good = [f"w{i}" for i in range(60)]
    bad = [f"w{i}" for i in range(40, 90)]
    labels = np.array([int(rng.random() < 0.6) for _ in range(n)])
    return [" ".join(rng.choice(good if y or rng.random() < 0.5 else bad) for _ in range(rng.randrange(1, 25))) for y in labels], labels


def language_rows(n, seed):
    rng = random.Random(seed)
    langs = [rng.choice("aa bb bb cc cc cc".split()) for _ in range(n)]
    return [" ".join("".join(rng.choice(SOUNDS[c]) for _ in range(2)) for _ in range(rng.randrange(2, 9))) for c in langs], langs


def n_grams(signs, most):
    return {tuple(signs[i : i + n]) for n in range(1, most + 1) for i in range(len(signs) - n + 1)}


def test_indicators_are_distinct_n_grams():
    for text in quality_rows(50, 1)[0] + ["", "one", "a a a", "The THE the 42x"]:
        words = text.split()
        same = ["first" if i == 0 else w.lower() == words[i - 1].lower() for i, w in enumerate(words)]
        want = len(n_grams([w.lower() for w in words], 2)) + len(n_grams([quality.shape_of(w) for w in words], 3)) + len(n_grams(same, 3)) + 1
        assert want - 2 <= len(quality.indicators(text)) <= want  # hashes may meet


def test_support_vectors_against_projected_gradient():
    texts, labels = quality_rows(200, 2)
    rows = [quality.indicators(t) for t in texts]
    model = quality.fit_nbsvm(rows, labels, rounds=400)
    short = quality.fit_nbsvm(rows, labels)
    used = sorted({int(f) for r in rows for f in r})
    has = np.array([[f in set(map(int, r)) for f in used] for r in rows], float)
    p, q = 1 + has[labels == 1].sum(0), 1 + has[labels == 0].sum(0)
    unseen = (1 << quality.BITS) - len(used)  # the smoothed counts of features that no row has
    ratio = np.log(p / (p.sum() + unseen)) - np.log(q / (q.sum() + unseen))
    ratio[used.index(0)] = 1.0
    assert np.allclose(model.ratios[used], ratio)
    x = has * ratio
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    y = np.where(labels == 1, 1.0, -1.0)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    kernel = (x @ x.T) * np.outer(y, y)
    a, step = np.zeros(len(y)), 1 / np.linalg.eigvalsh(kernel)[-1]
    for _ in range(20_000):
        a = np.clip(a - step * (kernel @ a - 1), 0, cost)
    dual = a.sum() - a @ kernel @ a / 2

    def primal(w):
        return w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()

    assert dual - 1e-6 <= primal(model.weights[used]) <= dual * 1.001
    assert primal(short.weights[used]) <= dual * 1.05
    assert np.abs(model.weights[used] - (a * y) @ x).max() < 1e-2
    scores = np.array([model.score(r) for r in rows])  # margins of support vectors are all but equal, so values are compared, not ranks
    assert np.abs((np.log(scores / (1 - scores)) - model.shift) / model.slope - x @ ((a * y) @ x)).max() < 1e-2


def test_kernel_ridge_against_the_full_kernel():
    (texts, langs), (asked, truth) = language_rows(200, 3), language_rows(100, 4)
    rows, known = langid.presence(texts)
    assert known.all()
    model = langid.fit_kernel_ridge(rows, langs, landmarks=len(texts))
    grams = [n_grams(langid.letters_of(t), langid.ORDERS) for t in texts + asked]
    kernel = np.array([[len(g & h) / np.sqrt(len(g) * len(h)) for h in grams[:200]] for g in grams])
    off = np.abs(rows @ rows.T - kernel[:200])  # hashed n-grams meet: some 100 x 100 n-grams in 2^14 buckets share less than one by chance
    assert off.mean() < 0.01 and off.max() < 0.1
    goal = np.where(np.array(langs)[:, None] == np.array(model.classes)[None, :], 1.0, -1.0)
    of_class = np.array([langs.count(c) for c in langs], float)

    def full(to_sample, among):
        return to_sample @ np.linalg.solve(among + 1e-2 / len(model.classes) * np.diag(of_class), goal)

    new = langid.presence(asked)[0]
    assert np.abs(new @ model.weights - full(new @ rows.T.astype(float), rows.astype(float) @ rows.T)).max() < 0.05
    plain = full(kernel[200:], kernel[:200]).argmax(1)
    assert (plain == (new @ model.weights).argmax(1)).mean() >= 0.97
    few = langid.fit_kernel_ridge(rows, langs, landmarks=60)
    right = np.array([few.classes[i] for i in (new @ few.weights).argmax(1)]) == np.array(truth)
    assert right.mean() >= (np.array(model.classes)[plain] == np.array(truth)).mean() - 0.05
