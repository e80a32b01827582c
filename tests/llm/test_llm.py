"""The corpus operators against brute force, libraries and round trips, with nulls, ties, long and empty texts."""

import base64
import hashlib
import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from ocellus.llm import bpe, decontaminate, exact_dedup, lm_scoring, quality, simhash_dedup, substring_dedup, token_counts, toxicity, url_filter
from ocellus.llm.components import components
from ocellus.llm.training import labelled_sample

SCHEMA = "doc_id long, text string, lang string, name string, block string, key string, word string, y string"
R = random.Random(3)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(1, 7))) for _ in range(300)]


def prose(n, rnd=R):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


BASE = [prose(n) for n in (0, 1, 2, 3, 9, 10, 49, 50, 51, 120, 400)]
PASSAGE = prose(70)
TEXTS = [
    None, "", *BASE, BASE[-1].upper(), BASE[-1], BASE[-1] + " tail", PASSAGE, prose(30) + " " + PASSAGE + "\n" + prose(5), PASSAGE + "  " + PASSAGE, "Grüße! ÀÉ é　日本 don't<|endoftext|>'ll  x", "a" * 3000,
    " \t\n", "x y " * 2500, prose(3000),
]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "n", "b", "k", "w", "y") for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS).repartition(3).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words_of(text, spaces=" \t\n\r\x0b\x0c"):
    for c in spaces:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def test_token_counts(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = by_id(token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), P.PATTERN, limit=100))
    for i, t in enumerate(TEXTS):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 100)


def test_bpe_round_trip(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = P.path("byte_bpe_50k.tiktoken")
    got = by_id(bpe.round_trip(docs, path, P.PATTERN))
    coded = bpe.encode(docs, path, P.PATTERN)
    ids, back = by_id(coded), by_id(bpe.decode(coded, path, P.PATTERN))
    for i, t in enumerate(TEXTS):
        want = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        assert bytes(ids[i]["ids"]) == want and got[i]["ids_sha256"] == hashlib.sha256(want).hexdigest() and got[i]["n_tokens"] == len(want) // 4
        assert bytes(back[i]["decoded"]) == (t or "").encode() and got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert all(r["lossless"] for r in bpe.encode_checked(docs, path, P.PATTERN).collect())


def test_perfect_hash_is_minimal():
    entries = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))[:5000]
    table = bpe.PerfectHash(entries)
    assert sorted(table.find(e) for e in entries) == list(range(len(entries)))


@pytest.mark.parametrize("size", [4, 2048])
def test_exact_dedup(spark, size):
    texts = [*TEXTS, "Same Text", "same text", "same text", "abcdabcd", "abcdabce", "abcdabcd!", "b" * 33, "b" * 32, "b" * 33]
    df = frame(spark, texts)
    got = by_id(exact_dedup.exact_dedup(df, size=size))
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[low(t)].append(i)
    assert len(got) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r["doc_id"] for r in exact_dedup.without_copies(df, size=size).collect()) == sorted(max(ids) for ids in groups.values())


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    df = frame(spark, ["a", "a", "A", "b", None, "c" * 9, "c" * 9], [1, 1, None, None, 5, 7, 7])
    rows = exact_dedup.exact_dedup(df, size=4).collect()
    assert len(rows) == 7 and sum(r["kept"] for r in rows) == 4
    assert [r["group_size"] for r in rows if r["doc_id"] == 1] == [3, 3]
    assert exact_dedup.without_copies(df, size=4).count() == 4


def brute_hits(text, items):
    sep = "".join(map(chr, [*range(48), *range(58, 97), *range(123, 128)]))
    w = words_of(low(text), sep)
    hit, found = set(), set()
    for item, t in items:
        b = words_of(low(t), sep)
        m = min(10, len(b))
        wins = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if b else set()
        for i in range(len(w) - m + 1 if wins else 0):
            if tuple(w[i : i + m]) in wins:
                hit.update(range(i, i + m))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("part_bytes", [1 << 20, 1500, 200])
def test_decontaminate(spark, docs, part_bytes):
    items = [(1, PASSAGE), (10, " ".join(PASSAGE.split()[20:45])), (2, " ".join(BASE[9].split()[5:9])), (3, None), (4, "..."), (5, BASE[9].split()[0]), (6, prose(40)), (7, PASSAGE), (8, " ".join(BASE[10].split()[100:112]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.decontaminate(docs, bench, part_bytes=part_bytes, spans=True))
    for i, t in enumerate(TEXTS):
        n, hit, found = brute_hits(t, items)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest() and sum(s["end"] - s["start"] for s in r["spans"]) == hit
    where = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(where)) if os.path.isdir(where) else set()
    clean = {r["doc_id"] for r in decontaminate.without_contaminated(docs, bench, part_bytes=part_bytes).collect()}
    assert len((set(os.listdir(where)) if os.path.isdir(where) else set()) - before) <= 1  # passes leave the last table only
    assert clean == {i for i in got if not got[i]["contaminated"]}
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize(("ranges", "kind"), [(12 << 20, "long"), (100, "long"), (12 << 20, "string")])
def test_substring_dedup(spark, monkeypatch, ranges, kind):
    monkeypatch.setattr(substring_dedup, "PIECE", 4000)
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", ranges)
    texts = [*TEXTS, PASSAGE, BASE[-1][40:]]
    ids = [*range(len(texts) - 2), 3, None]
    docs = frame(spark, texts, ids).repartition(3)
    if kind == "string":
        docs, ids = docs.withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id"))), [i if i is None else f"k{i}" for i in ids]
    got = substring_dedup.substring_dedup(docs, texts_too=True).collect()
    first = {}
    for i, t in zip(ids, texts, strict=True):
        w = words_of(t or "")
        for k in range(len(w) - 49 if i is not None else 0):
            win = tuple(w[k : k + 50])
            first[win] = min(i, first.get(win, i))
    want = []
    for i, t in zip(ids, texts, strict=True):
        w = words_of(t or "")
        gone = {k + j for k in range(len(w) - 49 if i is not None else 0) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    key = lambda r: (r[0] is None, str(r[0]), r[1], r[3])
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in got), key=key) == sorted(want, key=key)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)
    assert sum(r["n_removed"] for r in got) > 500


def test_window_hashes():
    rng = np.random.default_rng(4)
    prime = substring_dedup.PRIME
    codes = np.r_[np.array([0, 1, prime - 1, prime - 2], np.uint64), rng.integers(0, prime, 120, dtype=np.uint64)]
    for base in (3, prime - 2, *substring_dedup._BASES):
        for window in (1, 2, 7, 50, 64, 124, 125):
            want = [sum(x * pow(base, k, prime) for k, x in enumerate(codes[i : i + window].tolist())) % prime for i in range(codes.size - window + 1)]
            assert substring_dedup.window_hashes(codes, substring_dedup.Powers(base), window).tolist() == want


def test_packed_windows():
    rng = np.random.default_rng(5)
    for n in (1, 2, 1000, 70_000):
        h1, h2, doc = rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(-(1 << 40), 1 << 62, n)
        got = sorted(zip(*(x.tolist() for x in substring_dedup._unpack(substring_dedup._pack(h1, h2, doc))), strict=True))
        assert got == sorted(zip(h1.tolist(), h2.tolist(), doc.tolist(), strict=True))
        flags = sorted(zip(*(x.tolist() for x in substring_dedup._unpack_flags(substring_dedup._pack_flags(h1, doc))), strict=True))
        assert flags == sorted(zip(h1.tolist(), doc.tolist(), strict=True))


@pytest.mark.parametrize("unit", ["letters", "words"])
def test_substring_dedup_of_alternating_texts(spark, unit):
    """Thue-Morse texts and their complements, on which hashes modulo a power of two agree whatever the base."""
    bits = [i.bit_count() & 1 for i in range(4096)]
    if unit == "letters":
        a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
        texts = [" ".join([*(f"w{i}" for i in range(49)), x]) for x in (a, b)]
    else:
        texts = [" ".join("ab"[x ^ flip] for x in bits[n : n + 64]) for n, flip in ((0, 0), (0, 1))]
    words = [t.split() for t in texts]
    first = {tuple(words[0][k : k + 50]) for k in range(len(words[0]) - 49)}
    shared = any(tuple(words[1][k : k + 50]) in first for k in range(len(words[1]) - 49))
    got = by_id(substring_dedup.substring_dedup(frame(spark, texts, [1, 2])))
    assert not shared and got[1]["n_removed"] == got[2]["n_removed"] == 0


def fingerprint(text):
    w = words_of(low(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_simhash_components(spark):
    long = prose(2000).split()
    near = [" ".join([*long[:i], "zz", *long[i + 1 :]]) for i in (5, 500, 900)]
    texts = [*TEXTS, " ".join(long), *near]
    got = by_id(simhash_dedup.simhash_components(frame(spark, texts)))
    fps = [fingerprint(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = brute_components(links, range(len(texts)))
    for i, fp in enumerate(fps):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{fp:016x}", want[i])


def test_golay_links_are_complete(spark):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(150)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), k)) for f in fps for k in (1, 2, 3, 4)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r["a"], r["b"]) for r in simhash_dedup.linked(spark.createDataFrame([(s,) for s in set(signed)], "fp long")).collect()}
    want = {tuple(sorted((a, b))) for (f, a), (g, b) in itertools.combinations(zip(fps, signed, strict=True), 2) if a != b and (f ^ g).bit_count() <= 3}
    assert got == want and len(want) > 400


def test_similar_groups(spark):
    rng = random.Random(5)
    base = [prose(300, rng).split() for _ in range(12)]
    texts = [" ".join(b) for b in base] + [" ".join("zz" if k in {70, 200} else w for k, w in enumerate(b)) for b in base]
    got = {r["doc_id"]: r["group_id"] for r in simhash_dedup.similar_groups(frame(spark, [*texts, None, ""])).collect()}
    assert got == {i + d: i for i in range(12) for d in (0, 12)} | {24: 24, 25: 24}


def edited(words, similarity, rnd):
    """A copy with about the given Jaccard similarity of five-word shingles: single words replaced far apart."""
    words, n = list(words), len(words) - 4
    for k in range(round(n * (1 - similarity) / (1 + similarity) / 5)):
        words[6 + 12 * k] = f"e{rnd.random()}"
    return words


def brute_groups(texts, similarity=0.8):
    sets = [set(simhash_dedup.shingle_hashes(low(t).encode(), 5)) for t in texts]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for h in s:
            where[h].append(i)
    links = []
    for i, s in enumerate(sets):
        shared = Counter(j for h in s for j in where[h] if j < i)
        links += [(j, i) for j, n in shared.items() if n >= similarity * (len(s) + len(sets[j]) - n) - 1e-9]
    got = brute_components(links, range(len(texts)))
    return {i: got[i] for pair in links for i in pair}


def test_similar_groups_around_the_limit(spark):
    rng = random.Random(11)
    texts = []
    for k in range(400):
        words = [f"w{rng.random()}" for _ in range(404)]
        texts += [" ".join(words), " ".join(edited(words, 0.74 + 0.0003 * k, rng))]
    want = brute_groups(texts)
    got = {r["doc_id"]: r["group_id"] for r in simhash_dedup.similar_groups(frame(spark, texts)).collect()}
    assert got == want and 300 < len(want) < 750


def test_similar_groups_in_one_template(spark):
    rng = random.Random(12)
    template, texts = [f"t{i}" for i in range(200)], []
    for _ in range(1500):
        words = template + [f"w{rng.random()}" for _ in range(46)]
        texts.append(" ".join(words))
        if rng.random() < 0.1:
            texts.append(" ".join([*words[:-3], "x", "y", "z"]))
    rng.shuffle(texts)
    want = brute_groups(texts)
    assert {r["doc_id"]: r["group_id"] for r in simhash_dedup.similar_groups(frame(spark, texts)).collect()} == want and len(want) > 200


def test_near_copies_are_rows_not_ids(spark):
    import corpus_pipeline

    rng = random.Random(13)
    one, two, three = (prose(300, rng).split() for _ in range(3))
    copy = lambda w: " ".join([*w[:-1], "zz"])
    rows = [(1, " ".join(one)), (7, copy(one)), (7, " ".join(two)), (8, " ".join(three)), (8, copy(three)), (None, copy(two)), (None, prose(300, rng))]
    kept = corpus_pipeline.drop_near_copies(spark, frame(spark, [t for _, t in rows], [i for i, _ in rows]), "").collect()
    texts = {r["text"] for r in kept}
    assert len(kept) == 4 and rows[0][1] in texts and rows[2][1] in texts and rows[6][1] in texts and len(texts & {rows[3][1], rows[4][1]}) == 1


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(300, i) for i in range(301, 400)] + [(i, i + 1) for i in range(500, 540)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == brute_components(pairs, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_filter(spark):
    rules = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/")]
    pages = [
        (1, "https://A.Example.COM/en/1?q=/x", ""), (2, "http://www.example.com/en/2#f", None), (3, "http://a.net/es/1", '<link rel="canonical" href="http://b.org/p">'),
        (4, "http://b.org/p", ""), (5, "http://c.org/q", '<meta http-equiv="refresh" content="0; url=http://b.org/p">'), (6, "http://ok.com/", '<link href="http://b.org/p" rel=canonical>'),
        (7, None, "x"), (8, "no scheme", "x"), (9, "http://host.com", ""), (10, "http://d.org/z", '<script>location.href = "http://e.org/";</script>'), (11, "http://notexample.com/en/", ""), (12, "x?http://u.net/es/://y", ""),
        (13, "http://f.org/", "<meta content='3; url=http://Q.net/es/gone' http-equiv=refresh>"),
    ]
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got == {
        1: ("a.example.com", "/en/1", "example.com/en/", "block"), 2: ("www.example.com", "/en/2", "www.example.com/en/", "allow"), 3: ("a.net", "/es/1", "net/es/", "block"), 4: ("b.org", "/p", None, "block"),
        5: ("c.org", "/q", None, "block"), 6: ("ok.com", "/", "com/", "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("host.com", "", None, "allow"), 10: ("d.org", "/z", None, "allow"),
        11: ("notexample.com", "/en/", "com/", "allow"), 12: ("u.net", "/es/://y", "net/es/", "block"), 13: ("f.org", "/", None, "block"),
    }


def test_url_filter_relative_targets(spark):
    rules = [url_filter.Rule("block", "net", "/es/")]
    pages = [
        (1, "http://a.net/", "<meta http-equiv=refresh content='0; url=/es/'>"), (2, "http://b.org/x", '<link rel="canonical" href="//c.net/es/1">'), (3, "http://d.net/es/page", '<link rel=canonical href=http://e.org/q>'),
        (4, "http://e.org/q", ""), (5, "http://f.net/a/b", "<script>location.replace('../es/gone.html')</script>"), (6, "http://g.net/es/x", '<script>window.location.assign("y.html")</script>'),
        (7, "http://h.net/a", '<div location="/es/">'), (8, "http://i.net/a", '<script>location = "/es/"</script>'), (9, "http://j.net/a", '<link rel=canonical href="mailto:x"><script>var location = "/es/"</script>'),
        (10, "http://k.org/a", '<base href="http://k.net/es/"><link rel=canonical href=z>'), (11, None, '<link rel=canonical href="/es/">'), (12, "http://l.net/a", '<link rel=canonical href="/go?u=http://m.net/es/">'),
        (13, "http://n.org/p?a=1&b=2", ""), (14, "http://o.net/es/q", '<link rel=canonical href="http://n.org/p?a=1&amp;b=2">'), (14, "http://n.org/p?a=1&b=2", None),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert {k for k, v in got.items() if v == "block"} == {1, 2, 3, 4, 5, 6, 8, 10, 13, 14} and len(got) == 14


def test_url_filter_against_brute_force(spark):
    """Random alias graphs with rules of equal length, repeated pages and null urls."""
    rng = random.Random(17)
    rules = [url_filter.Rule("block", "net", "/b/"), url_filter.Rule("allow", "net", "/b/ok/"), url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "org", "/x")]
    urls = [f"http://h{rng.randrange(6)}.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['', 'b/', 'b/ok/', 'x', 'y'])}{rng.randrange(4)}" for _ in range(60)]
    forms = ['<link rel="canonical" href="{}">', "<meta http-equiv=refresh content='0; url={}'>", "<script>location.replace('{}')</script>", "<p>{}</p>"]
    pages = [(i, u, rng.choice(forms).format(rng.choice(urls)) if rng.random() < 0.5 else None) for i, u in enumerate([*urls, *urls[:5]])] + [(900, None, forms[0].format(urls[0])), (901, "nothing", None)]

    def rule(url):
        host, path = url.split("://")[1].partition("/")[::2]
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and ("/" + path).startswith(r.path)]
        return max(fit, key=lambda r: len(r.name)).verdict if fit else None

    links = [(u, t) for _, u, h in pages if u and "://" in u and h and "<p>" not in h for t in urls if t in h and h.split(t)[1][:1] in "\"'"]
    names = sorted({*urls, *(x for pair in links for x in pair)})
    root = brute_components([(names.index(a), names.index(b)) for a, b in links], range(len(names)))
    bad = {root[i] for i, u in enumerate(names) if rule(u) == "block" and any(u in pair for pair in links)}
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    want = {i: "allow" if u is None or "://" not in u else rule(u) or ("block" if root[names.index(u)] in bad else "allow") for i, u, _ in pages}
    assert got == want and len(set(want.values())) == 2 and sum(rule(u) is None and want[i] == "block" for i, u, _ in pages if u and "://" in u) > 0


def labelled(spark, n=400):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(n):
        w = prose(rng.randint(20, 90), rng).split()
        toxic, good = i % 4 == 0, i % 5 != 0
        for _ in range(5 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["zidiot", "Zm0ron", "zсum"]))
        if not good:
            w = [x + "###" for x in w]
        texts.append(" ".join(w))
        labels.append((i, int(good), int(toxic)))
    return frame(spark, [*texts, None, ""]), spark.createDataFrame([*labels, (9999, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), labels


def test_toxicity(spark):
    docs, labels, truth = labelled(spark)
    got = by_id(toxicity.toxicity(docs, labels))
    assert len(got) == len(truth) + 2 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(got[i]["predicted"], t) for i, _, t in truth if got[i]["held_out"]]
    assert sum(p == t for p, t in held) >= 0.97 * len(held) and got[len(truth)]["predicted"] == 0
    stay = {r["doc_id"] for r in toxicity.without_toxic(docs, labels).collect()}
    assert stay == {i for i, r in got.items() if not r["predicted"]}
    flat = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(flat) == len(got) and {r["score"] for r in flat} == {0.0}


def test_toxicity_exception_phrases():
    model = toxicity.ToxicityModel({"scum": 2.0}, {"pond scum"})
    assert [m[2] for m in model.matches("scum, pond scum scums 5cum".replace("5", "s"))] == [2.0, 2.0]
    assert toxicity.folded("Ѕ1LLY 4 p@l") == "silly a pal"


def test_quality(spark):
    docs, labels, truth = labelled(spark)
    got = by_id(quality.quality(docs, labels))
    assert len(got) == len(truth) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [(got[i]["predicted"], q) for i, q, _ in truth if got[i]["held_out"]]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)
    assert {r["score"] for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_against_brute_force(spark):
    docs, labels, _ = labelled(spark)
    long = frame(spark, [prose(3000), prose(700) + "###"], [7000, 7001])
    docs = docs.unionByName(long)
    model = quality.fit(docs, labels)
    got = by_id(quality.quality(docs, labels))
    tools = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(x), write_checksum=False, write_content_size=False) for x in (model.good, model.bad)]
    for r in docs.collect():
        t = (r["text"] or "").encode()
        good, bad = (sum(len(tool.compress(t[i : i + 2048])) for i in range(0, len(t), 2048)) for tool in tools)
        x = (bad - good) / max(1, len(t))
        k = max(i for i, knot in enumerate(model.knots) if knot <= x)
        p = model.chances[k] + (x - model.knots[k]) * (model.chances[k + 1] - model.chances[k]) / (model.knots[k + 1] - model.knots[k])
        assert abs(got[r["doc_id"]]["score"] - p) < 1e-9
    assert (np.diff(model.chances) >= 0).all() and (np.diff(model.knots) > 0).all()


def test_labelled_sample_has_one_row_per_id(spark):
    docs = frame(spark, [*(f"text {i}" for i in range(50)), None], [1] * 50 + [2])
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [labelled_sample(docs.repartition(n), labels, "toxic", 10, 1009).collect() for n in (1, 4)]
    assert sorted(rows[0]) == sorted(rows[1]) and sorted((r["doc_id"], r["y"]) for r in rows[0]) == [(1, 1), (2, 0)]


def test_toxicity_matches_against_brute_force():
    rng = random.Random(6)
    model = toxicity.ToxicityModel({"ab": 1.5, "abc": 2.0, "cab": 1.0, "bca": 3.0}, {"a cab", "ab ba", "bca c"})
    for _ in range(400):
        text = "".join(rng.choice("abc  ._1Аᴀ\t") for _ in range(rng.randint(0, 60)))
        folded = toxicity.folded(text)
        edge = lambda a, b: (a == 0 or not folded[a - 1].isalnum()) and (b == len(folded) or not folded[b].isalnum())
        spans = lambda words: [(a, a + len(w), w) for w in words for a in range(len(folded)) if folded.startswith(w, a) and edge(a, a + len(w))]
        excused = spans(model.phrases)
        want = sorted((a, b, model.words[w]) for a, b, w in spans(model.words) if not any(x <= a and b <= y for x, y, _ in excused))
        assert sorted(model.matches(folded)) == want
        assert abs(model.load([text])[0] - np.log1p(100 * sum(w for *_, w in want) / max(1, len(folded.split())))) < 1e-9


@pytest.mark.parametrize("lookup", [100_000, 40])
def test_lm_scores(spark, lookup):
    ids = [*range(len(TEXTS)), None, 7]
    texts = [*TEXTS, "alpha beta", prose(30)]
    rows = lm_scoring.lm_scores(frame(spark, texts, ids).repartition(3), head=30, classes=10, lookup=lookup).collect()
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    c = Counter(w for i, t in zip(ids, texts, strict=True) if fold(i) for w in [*words_of(low(t)), ""])
    n, v = sum(c.values()), len(c)
    want = [(i, fold(i) == 0, len(w), sum(x in c for x in w), n, round(sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)) for i, t in zip(ids, texts, strict=True) for w in [[*words_of(low(t)), ""]]]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows), key=key) == sorted(want, key=key)
    assert all(r["score"] < 0 for r in rows)
    assert len(lm_scoring.lm_scores(frame(spark, ["a b", None], [1, 2]).limit(0)).collect()) == 0


def lm_model(docs, lookup=1000):
    counts = lm_scoring.count_words(docs).cache()
    vocab = lm_scoring.vocabulary(counts, 20, 12, 6, lookup)
    model = lm_scoring.train(docs, vocab, shard=900)
    return vocab, model, {r["word"].encode(): r["c"] for r in counts.collect()}


def test_lm_is_a_distribution(spark):
    vocab, model, counts = lm_model(frame(spark, [prose(60) for _ in range(40)]))
    norm = model.normalisers()
    assert len(model.out) == 26 and norm.shape == (18, 18) and len(counts) > 100
    for near, far in ((0, 3), (17, 6), (4, 4)):
        p = np.exp(model.logits(np.arange(26), np.full(26, near), np.full(26, far)) - norm[near, far])
        assert abs(p.sum() - 1) < 1e-4 and (p > 0).all()
    seen, unseen = vocab.shares()
    within = 10.0**unseen
    for w, c in counts.items():
        if (u := vocab.unit(w)) < 6:
            within[u] += (c - vocab.discount) * 10 ** seen[u]
    assert np.allclose(within, 1)


@pytest.mark.parametrize("lookup", [1000, 25])
def test_lm_score_against_brute_force(spark, monkeypatch, lookup):
    rng = random.Random(8)
    docs = frame(spark, [prose(rng.randint(0, 80), rng) for _ in range(60)] + ["never seen wordsabc", None])
    monkeypatch.setattr(lm_scoring, "SHARD", 900)
    got = by_id(lm_scoring.lm_scores(docs, 20, 12, 6, lookup))
    learned = docs.filter(lm_scoring.fold(F.col("doc_id"), 10) != 0)
    vocab, model, counts = lm_model(learned, lookup)
    logits = lambda n, f: (model.context[n] + model.context[18 + f]).astype(float) @ model.out[:, :-1].T + model.out[:, -1]
    rest = {u: [c for w, c in counts.items() if vocab.unit(w) == u] for u in range(6)}
    for r in docs.collect():
        units, score = [vocab.unit(b""), vocab.unit(b"")], 0.0
        for w in [*words_of(low(r["text"])), ""]:
            u = vocab.unit(w.encode())
            z = logits(vocab.context[units[-1]], vocab.context[units[-2]])
            p = np.exp(z[u]) / np.exp(z).sum()
            if u < 6:
                c = counts.get(w.encode(), 0)
                p *= (c - vocab.discount if c else vocab.discount * len(rest[u])) / sum(rest[u]) if rest[u] else 1.0
            score += np.log10(p)
            units.append(u)
        assert abs(got[r["doc_id"]]["score"] - score) < 1e-3 * max(1, abs(score))


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD", 500)
    docs = frame(spark, [prose(50) for _ in range(50)])
    one, other = (by_id(lm_scoring.lm_scores(docs.repartition(n), 20, 12, 6)) for n in (1, 5))
    assert one.keys() == other.keys() and all(abs(one[i]["score"] - other[i]["score"]) < 1e-9 for i in one)


def test_lm_without_training_rows(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    got = by_id(lm_scoring.lm_scores(frame(spark, ["a b", None], held)))
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in (got[i] for i in held)] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]


def test_empty_tables(spark):
    empty = frame(spark, [])
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    path = P.path("byte_bpe_50k.tiktoken")
    for df in (
        token_counts.token_counts(empty, P.path("byte_bpe_50k.json"), P.PATTERN), url_filter.url_filter(empty.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html")), [url_filter.Rule("block", "net", "/")]),
        bpe.round_trip(empty, path, P.PATTERN), exact_dedup.exact_dedup(empty), decontaminate.decontaminate(empty, bench), substring_dedup.substring_dedup(empty), simhash_dedup.simhash_components(empty),
        simhash_dedup.similar_groups(empty), toxicity.toxicity(empty, labels), quality.quality(empty, labels), lm_scoring.lm_scores(empty),
    ):
        assert df.count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Planted copies, near copies around the limit, benchmark passages and toxic texts, stage after stage in plain Python."""
    import corpus_pipeline
    import tiktoken

    rng = random.Random(31)
    docs, labels, _ = labelled(spark, 120)
    base = [prose(rng.randint(150, 260), rng).split() for _ in range(40)]
    items = [(1, " ".join(base[0][20:50])), (2, " ".join(base[7][5:12])), (3, prose(15, rng))]
    texts = [" ".join(w) for w in base]
    texts += [" ".join(edited(w, 0.72 + 0.006 * k, rng)) for k, w in enumerate(base)]
    texts += [texts[k].upper() for k in (1, 2, 41)] + [texts[3] + " zidiot Zm0ron zidiot zidiot zidiot", f"{prose(60, rng)} {items[1][1]} end", f"{prose(60, rng)} {items[1][1][:-3]}"]
    every = docs.unionByName(frame(spark, texts, range(1000, 1000 + len(texts))))
    rows = {r["doc_id"]: r["text"] or "" for r in every.collect()}
    model = toxicity.fit(every, labels)
    rows = {i: t for i, t in rows.items() if model.scores([t])[0] < 0.5}
    last = {}
    for i in sorted(rows):
        last[low(rows[i])] = i
    rows = {i: rows[i] for i in sorted(last.values())}
    ids = list(rows)
    groups = brute_groups([rows[i] for i in ids])
    rows = {i: rows[i] for k, i in enumerate(ids) if groups.get(k, k) == k}
    assert 3 < len(ids) - len(rows) < 40
    clean = {i: t for i, t in rows.items() if brute_hits(t, items)[1] == 0}
    assert len(rows) - len(clean) >= 3
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    every.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: bytes(r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: np.array(enc.encode_ordinary(t), "<u4").tobytes() for i, t in clean.items()}


CLASHING = ["_id", "_sha", "_sha256", "text_sha256", "TEXT_SHA256", "keep_doc_id", "keep_id", "gone_sha256", "sha", "root", "node", "key", "row", "a.b", "y", "part"]


def clashing(df):
    return df.select("doc_id", "text", *(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING if c != "TEXT_SHA256"))


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    long = prose(300)
    docs = clashing(frame(spark, [long, long.upper(), long + " tail", PASSAGE, None, "", prose(50)], [1, 2, 3, 4, 5, None, 6]))
    rows = {r["doc_id"]: tuple(r) for r in docs.collect()}
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    kept = {
        "copies": exact_dedup.without_copies(docs), "near": simhash_dedup.without_similar(docs), "clean": decontaminate.without_contaminated(docs, bench),
        "calm": toxicity.without_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int")),
    }
    for df in kept.values():
        assert df.columns == docs.columns and all(tuple(r) == rows[r["doc_id"]] for r in df.collect())
    ids = {k: {r["doc_id"] for r in df.collect()} for k, df in kept.items()}
    assert ids == {"copies": {2, 3, 4, 5, 6}, "near": {1, 4, 5, 6}, "clean": {1, 2, 3, 5, None, 6}, "calm": set(rows)}
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "simhash_dedup"


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null and repeated ids and rows, empty and very long texts, clashing columns; and an empty table."""
    import corpus_pipeline

    rng = random.Random(21)
    long, one = " ".join(prose(250, rng) for _ in range(800)), prose(200, rng)
    rows = [(None, None), (1, None), (1, ""), (2, one), (2, one), (2, prose(200, rng)), (None, prose(90, rng)), (3, long), (4, long + " more"), (5, "   "), (6, "x")]
    for name, some in (("some", rows), ("none", [])):
        folder = tmp_path / name
        clashing(frame(spark, [t for _, t in some], [i for i, _ in some])).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "2", "3", "6", "None"] and all(r["lossless"] for r in got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_repeated_and_null_ids_give_a_row_each(spark):
    ids, texts = [7, 7, None, None, 8], [prose(30), prose(30), None, prose(12), "very " * 300_000]
    docs = clashing(frame(spark, texts, ids)).repartition(2)
    path = P.path("byte_bpe_50k.tiktoken")
    bench = spark.createDataFrame([(None, "very very very"), (3, texts[0])], "item_id long, text string")
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    for df in (
        token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), P.PATTERN), bpe.round_trip(docs, path, P.PATTERN), exact_dedup.exact_dedup(docs), decontaminate.decontaminate(docs, bench), decontaminate.decontaminate(docs, bench, part_bytes=20),
        substring_dedup.substring_dedup(docs), simhash_dedup.simhash_components(docs), toxicity.toxicity(docs, labels), quality.quality(docs, labels),
    ):
        assert sorted(str(r["doc_id"]) for r in df.collect()) == ["7", "7", "8", "None", "None"]


def test_pipeline_keeps_its_promises(spark, tmp_path):
    import corpus_pipeline

    docs, labels, truth = labelled(spark, 120)
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    extra = frame(spark, [prose(40) + " " + PASSAGE, docs.filter("doc_id = 1").first()["text"].upper()], [5000, 5001])
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 5000 not in got and 5001 in got and 1 not in got
    assert not got & {i for i, _, t in truth if t} and got >= {i for i, q, t in truth if not t and i != 1}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "decontamination", "byte_bpe"]
