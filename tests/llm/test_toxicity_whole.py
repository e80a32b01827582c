"""Toxicity: weights, phrases and scores against plain Python, and texts of many matches in linear time."""

import math
import random
import re
import time
from collections import Counter

import numpy as np

from ocellus.llm import toxicity
from ocellus.llm.common import crc_fold


def plain_matches(model, text):
    """Lexicon words as whole words of a folded text, without those inside an exception phrase."""
    at = lambda x: [(m.start(), m.start() + len(x)) for m in re.finditer(rf"(?<![^\W_])(?={re.escape(x)}(?![^\W_]))", text)]
    excused = [s for p in model.phrases for s in at(p)]
    return sorted((a, b, w) for x, w in model.words.items() for a, b in at(x) if not any(c <= a and b <= d for c, d in excused))


def test_matches_of_overlapping_phrases():
    rnd = random.Random(1)
    for _ in range(40):
        words = ["bad", "vile", "ugly", "ok", "fine", "word"]
        phrases = {" ".join(rnd.choices(words, k=2)) for _ in range(4)}
        model = toxicity.ToxicityModel({"bad": 1.0, "vile": 2.0, "ugly": 0.5}, {p for p in phrases if p not in ("bad", "vile", "ugly")})
        text = " ".join(rnd.choices(words, k=60))
        assert sorted(model.matches(text)) == plain_matches(model, text)


def test_many_matches_take_linear_time():
    model = toxicity.ToxicityModel({"bad": 1.0}, {"not bad"}, np.array([1.0, -1.0]), 0.1)
    text = "not bad bad " * 420_000  # 5 MB, 840,000 matches, half of them excused
    began = time.perf_counter()
    assert len(model.matches(toxicity.folded(text))) == 420_000
    assert time.perf_counter() - began < 20


def test_fit_and_scores(spark):
    """Documents that are unlike each other, so that all count: odds, phrases and calibrated scores by their definitions."""
    rnd = random.Random(7)
    calm, toxic = [f"calm{a}{b}{c}" for a in "abcdefghijkl" for b in "abcdefghijkl" for c in "abcdefghijkl"], ["vilex", "nastyq", "grimz"]
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = rnd.choices(calm, k=30)
        if bad:
            words[3:3], words[20:20] = ([x] for x in rnd.sample(toxic, 2))
        elif i % 5 == 0:
            words[5:5] = ["mild", "vilex"]
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    train = [(set(t.split()), y, t) for (i, t), (_, _, y) in zip(rows, marks, strict=True) if crc_fold(i, 5)]
    n = Counter(y for _, y, _ in train)
    seen = {y: Counter(w for s, z, _ in train if z == y for w in s) for y in (0, 1)}
    odds = {w: math.log((seen[1][w] + 0.5) / (n[1] + 1)) - math.log((seen[0][w] + 0.5) / (n[0] + 1)) for w in seen[1]}
    want = {w: o for w, o in odds.items() if seen[1][w] >= max(toxicity.LEAST_DOCS, toxicity.LEAST_SHARE * n[1]) and o >= toxicity.LEAST_ODDS}
    assert model.words.keys() == want.keys() and all(abs(model.words[w] - want[w]) < 1e-9 for w in want)
    pairs = {y: Counter() for y in (0, 1)}
    for _, y, t in train:
        words = t.split()
        near = {" ".join(words[k : k + 2]) for k in range(len(words) - 1) if words[k] in want or words[k + 1] in want}
        pairs[y].update(near)
    assert model.phrases == {p for p, k in pairs[0].items() if k >= 3 and not pairs[1][p]} and ("vilex" not in want or "mild vilex" in model.phrases)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    for i, t in rows:
        load = math.log1p(100 * sum(w for *_, w in plain_matches(model, t)) / len(t.split()))
        assert abs(got[i] - 1 / (1 + math.exp(-(load * model.weights[0] + model.weights[1])))) < 1e-9
