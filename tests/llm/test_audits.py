"""Hard negatives, source divergence and line-first rules against plain Python, with odd rows and tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ocellus.llm import divergence, hard_negatives, quality_rules

R = random.Random(11)


# hard negatives


def plain_negatives(rows, every, positives=5, negatives=3, scale=256.0):
    held = [(i, y, [int(np.floor(scale * x)) for x in v]) for i, v, y in rows if None not in (i, v, y) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, y, v in held:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, z, w in held if j != i)
        for s, p, _ in [x for x in scored if x[2] == y][:positives]:
            fit = [(j, -n) for n, j, z in scored if z != y and 50 * -s <= 100 * -n <= 95 * -s][:negatives]
            out += [(i, p, k + 1, j, -s, n) for k, (j, n) in enumerate(fit)]
    return sorted(out)


def vectors(n, dims=6):
    base = [[R.uniform(-1, 1) for _ in range(dims)] for _ in range(n // 3)]
    rows = [(i, [float(np.float32(x + R.choice((0, 0, 0.1)))) for x in base[i % len(base)]], R.randrange(3)) for i in range(n)]
    odd = [(None, [1.0] * dims, 1), (n + 1, None, 1), (n + 2, [1.0] * dims, None), (n + 3, [float("nan")] * dims, 0), (n + 4, [float("inf")] + [0.0] * (dims - 1), 0), (n + 5, [None, 1.0], 2), (n + 6, [], 1), (n + 7, [0.5], 1)]
    return rows + odd + [(n + 8, [0.5] * dims, k % 2) for k in range(40)]


KIND = "vec_id long, embedding array<float>, label int, id string, slot string, rank string, number int"


def with_more(rows):
    return [(*x, "x", "y", "z", 1) for x in rows]


@pytest.mark.parametrize("block,side", [(4, 3), (16_384, 256)])
def test_hard_negatives(spark, monkeypatch, block, side):
    monkeypatch.setattr(hard_negatives, "ROWS", 32)
    monkeypatch.setattr(hard_negatives, "SIDE", side)
    rows = vectors(150)
    got = hard_negatives.hard_negatives(spark.createDataFrame(with_more(rows), KIND).repartition(5), every=10, scale=256.0, block=block)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 10)


def test_hard_negatives_odd(spark):
    none = hard_negatives.hard_negatives(spark.createDataFrame([], KIND), scale=256.0)
    assert none.count() == 0 and none.columns[0] == "anchor_id"
    assert hard_negatives.hard_negatives(spark.createDataFrame(with_more([(7, [1.0], 1)]), KIND)).count() == 0
    with pytest.raises(ValueError, match="range"):
        hard_negatives.hard_negatives(spark.createDataFrame(with_more([(50, [1e9], 1)]), KIND))


def test_best_keeps_ties_by_id():
    best = hard_negatives.Best(2, 2)
    tile, ids = np.zeros((2, 40)), np.arange(40)[::-1].copy()
    best.merge([best.sift(tile, np.ones((2, 40), bool), np.arange(2), ids)])
    assert best.id.tolist() == [0, 1, 0, 1] and best.slot.tolist() == [0, 0, 1, 1]
    best.merge([best.sift(tile[:1, :2], np.ones((1, 2), bool), np.array([1]), np.array([-5, 7]))])
    assert best.id.tolist() == [0, 1, -5, 0]


# source divergence


def plain_divergence(rows, least, top):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in docs}:
        mine = [x for x in docs if x[0] == lang]
        df, sums, whole = Counter(), defaultdict(Counter), Counter()
        for _, source, c in mine:
            df.update(c.keys())
            sums[source].update(c)
            whole.update(c)
        kept = [t for t, n in df.items() if n >= least]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in sums.items()}
        far = lambda a, b: (a - b) ** 2 // b
        for s in sums:
            pairs = sorted((-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sums if o != s)
            terms = sorted((-far(p[s][t], q[t]), t.encode()) for t in kept if sums[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found)]
    return sorted(out)


def test_source_divergence(spark):
    words = ["Alpha", "beta", "BETA", "ç", "Ünder", "é", "日本", "x1y", "rare", "_a_"] + [f"w{c}" for c in "abcdefghij"]
    rows = [(" ".join(R.choices(words[: 4 + i % 17], k=R.randrange(30))), R.choice(["en", "fr", None, ""]), R.choice(["a", "b", "c", "É", None])) for i in range(120)]
    rows += [(None, "en", "none"), ("", "only", "one"), ("beta " * 5000, "en", "long"), ("123 !?", "num", "a"), ("4", "num", "b")] + [("beta beta ç", "tie", s) for s in "abcd"]
    docs = spark.createDataFrame([(*r, "t", "n", 1) for r in rows], "text string, lang string, source string, term string, n string, once int").repartition(4)
    for least, top in ((3, 200), (1, 2)):
        got = divergence.source_divergence(docs, least=least, top=top)
        assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == plain_divergence(rows, least, top)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_share_stays_exact(spark):
    rows = [(0, 0, 1), (7, 7, 1), (10**14, 9 * 10**14, 10**14), (123_456_789_012, 987_654_321_098_765, 4_321)]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    got = df.select(divergence.share(df.c, df.n, df.v)).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in rows]


# line-first rules


def plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    bare = lambda x: re.sub(r"[\x20\x09-\x0D]", "", x)
    left = [x for x in dict.fromkeys(lines) if plain_line(re.sub(r"[\x09-\x0D]", " ", x))]
    n, kept_chars = len(words), sum(len(bare(x)) for x in left)
    failed = n < 50 or 100 * len(covered) > 50 * n
    found = (n, len(bare(text)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), kept_chars, failed, not failed and 2 * kept_chars >= len(bare(text)))
    return found, "\n".join(left)


def plain_line(x):
    words, chars = x.split(" "), len(x.replace(" ", ""))
    n = sum(w != "" for w in words)
    ends = re.search(r"[.!?…:;。！？]['\"’”»)\]]{0,4}$", x.rstrip(" ")[-5:]) or n >= 20
    menus = len(re.findall(r"(?:^| )[|>»·•](?: |$)", x))
    return bool(ends) and 4 * len(re.findall(r"[!-/:-@\[-`{-~]", x)) <= chars and not (menus and 4 * menus >= n) and not re.search(quality_rules.BOILERPLATE.replace(r"\z", r"\Z"), x.lower())


WORDS = ["".join(R.choices("abcdefgé", k=R.randint(1, 7))) for _ in range(60)]
LINES = [" ".join(R.choices(WORDS, k=k)) + end for k in (2, 9, 25) for end in (".", "", "!", ' said."', "…", "###")] + ["Home | About | Contact | Help.", "We use cookies here.", "All rights reserved.", "\tA line\x0bof words.", "A line of words.", " ", "", "\r", "日本語の文。", "x $$$ y%%% z&&&.", "a > b > c > d > e."]


def texts():
    made = ["\n".join(R.choices(LINES, k=R.randrange(12))) for _ in range(150)]
    made += ["word " * 4000, "a b c " * 30, "\n".join(" ".join(R.choices(WORDS, k=12)) + "." for _ in range(9)), "ERA!! " * 60, "x y.\u0085", "\n\n\n", None, "", " ".join(map(str, range(40_000)))]
    return made


def test_quality_rules(spark):
    made = texts()
    schema = "doc_id long, text string, words string, lines int, kept string, n_words string"
    docs = spark.createDataFrame([(i if i % 9 else None, t, "w", 1, "k", "n") for i, t in enumerate(made)] * 2, schema).repartition(3)
    got = quality_rules.quality_rules(docs).collect()
    want = [(i if i % 9 else None, *plain_rules(t)[0]) for i, t in enumerate(made)] * 2
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    kept = quality_rules.clean(docs)
    assert kept.columns == docs.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted([plain_rules(t)[1] for t in made if plain_rules(t)[0][-1]] * 2)
    assert quality_rules.quality_rules(docs.limit(0)).count() == quality_rules.clean(docs.limit(0)).count() == 0


def test_quality_rules_is_native(spark):
    plan = quality_rules.quality_rules(spark.createDataFrame([(1, "a")], "doc_id long, text string")).filter("kept")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert "split(replace(" not in plan.split("Generate inline")[0]  # a filter on the result must not move the words into the lambdas
