"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is four 16-bit segments. If two fingerprints differ in at most 3 bits, one segment is equal
in both, and of the two 24-bit halves of the rest one differs in at most 1 bit. The perfect binary Golay code
decodes 23 bits of such a half to the index of the one codeword within distance 3. A fingerprint has a home key
for its own codeword and probe keys for the codewords of all words at distance 1 (six at most), so the two meet
in a key of half, equal segment and codeword index. A join of probes to homes finds all linked pairs, and the
distance is verified in the join. Only distinct fingerprints take part, so copies cost nothing, and a
fingerprint has at most 43,744 others within distance 3 whatever the corpus: links stay linear in it.

`similar_groups` serves where documents count as near copies at a given Jaccard similarity of their shingle sets
(0.8 of five-word shingles, say), which is many more than 3 bits of 64 apart. Documents whose fingerprints link are compared
first; those that fingerprints can't bring together meet in buckets of 42 bands of six minimum hashes: a pair at 0.8 has no common bucket about three times in a million. Each document is then
compared with the smallest member of one of its buckets, then with those of its other buckets that are not yet in its
group, then with the few members of its buckets whose sketches are most like its own; last, every two members of a
bucket that this has not put into one group are compared, block by block. So a bucket of any size is whole, and one large
group of copies costs a few pairs for each of them. Sketches (a byte of
each minimum) drop pairs whose estimate is 0.12 or more below, which is over four standard deviations; what is left
is decided by the exact similarity of the two texts' shingle sets.

Components of the links are found by large and small stars in Spark. Null and empty texts have fingerprint zero,
which links like any other. Rows that repeat an id give a row each; null ids are never a component's name unless
it has no other. Texts of any length are taken whole. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, column, discard, map_texts, staged, unused
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Bands of the near-copy keys, and minimum hashes in each.
BANDS, ROWS = 42, 6
#: Words of 64 bits in the bitmap of digests by which texts are chosen before they move.
SLOTS = 1 << 18
#: Generator polynomial of the [23, 12, 7] Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0xAE3


def shingle_hashes(text: bytes, n: int = SHINGLE) -> list[int]:
    """XXH64 of each n-word shingle of the lower-cased words; of all words if there are fewer."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    flat = b" ".join(words)
    if len(words) <= n:
        return [digest(flat, SEED)]
    start, starts, ends = 0, [], []
    for w in map(len, words):
        starts.append(start)
        start += w
        ends.append(start)
        start += 1
    return [digest(flat[a:b], SEED) for a, b in zip(starts, ends[n - 1 :])]  # noqa: B905


def majority(hashes: list, block: int = 1 << 17) -> np.ndarray:
    """Of each list the 64-bit word whose bits are set in over half of its members; zero for an empty list."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    return majority_flat(np.fromiter((h for x in hashes for h in x), np.uint64, int(sizes.sum())), sizes, block)


def majority_flat(flat: np.ndarray, sizes: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """The same for lists laid end to end."""
    owner = np.repeat(np.arange(sizes.size), sizes)
    ones = np.zeros((sizes.size, 64), np.int64)
    for at in range(0, flat.size, block):
        bits = np.unpackbits(flat[at : at + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = owner[at : at + block]
        cuts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        ones[mine[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long of the same bits."""
    return map_texts(docs, lambda texts: {"fp": pa.array(majority([shingle_hashes(t) for t in texts]).astype(np.int64))}, "fp long", key, text)


@cache
def leaders() -> np.ndarray:
    """The error pattern of weight 3 at most for each of the code's 2048 syndromes."""
    out = np.zeros(2048, np.int64)
    ones = [1 << i for i in range(23)]
    for word in [a | b | c for a in ones for b in ones for c in ones]:
        out[int(syndrome(np.array([word]))[0])] = word
    return out


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
    return words


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index (the 12 message bits) of the codeword within distance 3."""
    return (words ^ leaders()[syndrome(words)]) >> 11


def nearby_indices(words: np.ndarray) -> np.ndarray:
    """Codeword indices of each word and of its 23 neighbours at distance 1: shape (words, 24)."""
    return np.stack([codeword_index(words ^ flip) for flip in [0, *(1 << i for i in range(23))]], axis=1)


def keys(fps: np.ndarray, probe: bool, exact_bits: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, key) of all home or probe keys; of the equal segment, exact_bits bits are used."""
    at, found, mask = [], [], (1 << exact_bits) - 1
    u = fps.astype(np.uint64)
    seg = [(u >> np.uint64(16 * i)).astype(np.int64) & 0xFFFF for i in range(4)]
    for s in range(4):
        rest = [seg[i] for i in range(4) if i != s]
        whole = rest[0] | rest[1] << 16 | rest[2] << 32
        for half in range(2):
            word = whole >> 24 * half & 0x7FFFFF
            base = (s << 1 | half) << 28 | (seg[s] & mask) << 12
            if not probe:
                at.append(np.arange(u.size))
                found.append(base | codeword_index(word))
                continue
            near = np.sort(nearby_indices(word), axis=1)
            new = np.c_[np.ones(u.size, bool), near[:, 1:] != near[:, :-1]]
            rows, cols = np.nonzero(new)
            at.append(rows)
            found.append(base[rows] | near[rows, cols])
    return np.concatenate(at), np.concatenate(found)


def _keyed(distinct: DataFrame, probe: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            at, found = keys(fps, probe)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(fps[at])], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def linked(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints that differ in at most `distance` (3 at most) bits, each once."""
    if distance > DISTANCE:
        raise ValueError("the keys find pairs at 3 differing bits or fewer")
    home = _keyed(distinct, False).withColumnRenamed("fp", "a")
    probe = _keyed(distinct, True).withColumnRenamed("fp", "b")
    # sorted, as no estimate of Spark shows how many keys a row has: the home keys of a small table would go through the driver
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return home.join(probe.hint("merge"), (home["key"] == probe["key"]) & near).select("a", "b").distinct()


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    fps = staged(fingerprints(docs, key, text), "fingerprints")
    owners = staged(fps.groupBy("fp").agg(F.min(key).alias("least")), "owners")
    roots = components(linked(owners, distance))
    named = owners.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = staged(named, "roots")
    smallest = staged(named.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    by_fp = staged(named.join(smallest.hint("merge"), "root").select("fp", "component_id"), "labels")
    discard(owners, named, smallest)
    return fps.join(by_fp.hint("merge"), "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _signatures(shingle: int):
    """Per text its SHA-256, the 64-bit keys of BANDS bands of ROWS minimum hashes, a byte of each minimum, and the fingerprint."""
    rng = np.random.default_rng(5)
    odd = rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    plus = rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)

    def run(texts: list[bytes]) -> dict[str, object]:
        lists = [np.array(shingle_hashes(t, shingle), np.uint64) for t in texts]
        fp = majority_flat(np.concatenate(lists) if lists else np.zeros(0, np.uint64), np.fromiter(map(len, lists), np.int64, len(lists)))
        hashes = [np.unique(x) for x in lists]
        sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
        flat = (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)).astype(np.uint32)
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        least = np.full((len(texts), BANDS * ROWS), 0xFFFFFFFF, np.uint32)
        h = np.empty_like(flat)
        for k in range(BANDS * ROWS if full.size else 0):
            np.multiply(flat, odd[k], out=h)
            h += plus[k]
            least[full, k] = np.minimum.reduceat(h, starts)
        bands = np.zeros((len(texts), BANDS), np.uint64)
        for row in range(ROWS):
            bands = (bands ^ least[:, row::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
            bands ^= bands >> np.uint64(29)
        bands ^= np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        sketch = (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel()))
        return {"sha": pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), "keys": keys, "sketch": pa.array([x.tobytes() for x in sketch], pa.binary()), "fp": pa.array(fp.astype(np.int64))}

    return run


def _bytes_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BANDS * ROWS)


def _close(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches agree in a part `least` or more of their bytes."""

    def run(batches):
        for batch in batches:
            same = (_bytes_of(batch.column(2)) == _bytes_of(batch.column(3))).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(same >= least * BANDS * ROWS))

    of = lambda side: sigs.select(F.col("node").alias(side), F.col("sketch").alias(f"s{side}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


class _Shingles:
    """Shingle sets of texts, the last ones kept."""

    def __init__(self, shingle: int, most: int = 1 << 21):
        self.shingle, self.most, self.held, self.size = shingle, most, {}, 0

    def __call__(self, node: int, text) -> np.ndarray:
        if node not in self.held:
            if self.size > self.most:
                self.held.clear()
                self.size = 0
            self.held[node] = np.unique(np.array(shingle_hashes(text(node).encode(), self.shingle), np.uint64))
            self.size += self.held[node].size
        return self.held[node]

    def alike(self, a: int, b: int, text, similarity: float) -> bool:
        """Whether the sets of two nodes, whose texts `text` gives, have the Jaccard similarity or more."""
        x, y = self(a, text), self(b, text)
        both = np.intersect1d(x, y, assume_unique=True).size
        return both * (1 + similarity) >= similarity * (x.size + y.size) - 1e-9


def _likely(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows whose `sha` has its bit in a bitmap of the digests: all that are among them and, as the bitmap is bounded and
    broadcast, a few others where there are few digests to its bits, so the join by `sha` itself is still to follow."""
    word, bit = F.pmod(F.shiftright(F.xxhash64("sha"), 6), F.lit(SLOTS)), F.xxhash64("sha").bitwiseAND(63).cast("int")
    bits = digests.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    return rows.join(F.broadcast(bits), (word == F.col("word")) & (F.getbit("bits", bit) == 1), "left_semi")


def _texts(nodes: DataFrame, sigs: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(node, text) of the nodes. Only texts of these are moved, and of the few others that share their bits."""
    nodes = staged(nodes.distinct().join(sigs.select("node", "sha"), "node"), "candidate-nodes")
    digests = staged(nodes.select("sha").distinct(), "candidate-digests")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.unhex(F.sha2(whole, 256)).alias("sha"), whole.alias("text"))
    found = staged(_likely(rows, digests).join(digests, "sha", "left_semi").dropDuplicates(["sha"]), "distinct-texts")
    texts = staged(nodes.join(found, "sha").select("node", "text"), "candidate-texts")
    discard(nodes, digests, found)
    return texts


def _verified(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the Jaccard similarity or more; exact, and written."""
    texts = _texts(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), sigs, docs, text)

    def run(batches):
        held = _Shingles(shingle)
        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            fits = []
            for i in range(len(a)):
                of = {a[i]: ta[i], b[i]: tb[i]}
                fits.append(held.alike(a[i], b[i], of.__getitem__, similarity))
            yield batch.select([0, 1]).filter(pa.array(fits, pa.bool_()))

    of = lambda side: texts.select(F.col("node").alias(side), F.col("text").alias(f"t{side}"))
    links = staged(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "links")
    discard(texts)
    return links


def _near_fingerprints(sigs: DataFrame) -> DataFrame:
    """Pairs (a < b) of nodes by the fingerprints of their shingles: the first node of each fingerprint with those that share it,
    and with the first nodes of the fingerprints linked to it."""
    owners = staged(sigs.groupBy("fp").agg(F.min("node").alias("first")), "owners")
    same = sigs.select("fp", "node").join(owners.hint("merge"), "fp").filter("first < node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    of = lambda side: owners.select(F.col("fp").alias(side), F.col("first").alias(f"n{side}")).hint("merge")
    near = linked(owners).join(of("a"), "a").join(of("b"), "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    return same.unionByName(near)


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, node, low, root) of buckets whose members are not yet in one group, with the root of the smallest
    member and the number of members."""
    named = staged(members.select("key", "node", "low").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")), "members")
    buckets = named.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.min_by("root", "node").alias("low_root"), F.count("*").alias("n"))
    return staged(named.join(staged(buckets.filter("first < last").select("key", "low_root", "n"), "mixed-buckets"), "key"), "mixed-members")


def _across(members: DataFrame, sigs: DataFrame, labels: DataFrame, least: float, block: int, best: int | None = None) -> DataFrame:
    """Every two members of a bucket that are not yet in one group and whose sketches agree enough, in the first bucket that
    they share: with `best` pairs (a, b), of each member so many that agree most; without, a row (key, i, j, node, partners) for
    each member of a cell that has or is a partner.

    A bucket is cut into blocks of about `block` members, and each pair of its blocks is a cell that is dealt by itself."""
    named = _mixed(members, labels).select("key", "node", "root", F.ceil(F.col("n") / block).alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cells = named.withColumn("own", own).withColumn("other", other).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "node", "root")
    cells = cells.join(sigs.select("node", "sketch", "keys"), "node").select("key", "i", "j", "second", "node", "root", "sketch", "keys").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs(cell: pa.Table) -> pa.RecordBatch:
        second, node, root = (cell[c].to_numpy() for c in ("second", "node", "root"))
        bands = cell["keys"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        here = (bands == cell["key"][0].as_py()).argmax(1)
        sketch, whole, found = _bytes_of(cell["sketch"]), cell["i"][0] == cell["j"][0], [np.zeros((0, 3), np.int64)]
        for k in range(node.size):
            rest = np.flatnonzero((root != root[k]) & (node > node[k] if whole else second & ~second[k]))
            same = (sketch[rest] == sketch[k]).sum(1)
            close = same >= least * BANDS * ROWS
            rest, same = rest[close], same[close]
            first = (bands[rest] == bands[k]).argmax(1) == here[k]  # a pair counts in the first bucket that it shares
            rest, same = rest[first], same[first]
            found.append(np.stack([np.minimum(node[rest], node[k]), np.maximum(node[rest], node[k]), same], axis=1))
        ab = np.concatenate(found)
        if best is not None:
            of, at, same = np.r_[ab[:, 0], ab[:, 1]], np.tile(np.arange(len(ab)), 2), np.tile(ab[:, 2], 2)
            order = np.lexsort((at, -same, of))
            new = np.r_[True, of[order][1:] != of[order][:-1]] if of.size else np.zeros(0, bool)
            place = np.arange(of.size)
            nth = place - np.maximum.accumulate(np.where(new, place, 0))
            ab = ab[np.unique(at[order][nth < best])]
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])
        ab = ab[np.argsort(ab[:, 0], kind="stable")]
        nodes = np.unique(ab[:, :2])
        stops = np.searchsorted(ab[:, 0], nodes, side="right")
        partners = pa.ListArray.from_arrays(pa.array(np.r_[0, stops], pa.int32()), pa.array(ab[:, 1]))
        place = [pa.array(np.full(nodes.size, cell[c][0].as_py()), pa.int64()) for c in ("key", "i", "j")]
        return pa.RecordBatch.from_arrays([*place, pa.array(nodes), partners], names=["key", "i", "j", "node", "partners"])

    kind = "a long, b long" if best is not None else "key long, i long, j long, node long, partners array<long>"
    return cells.mapInArrow(_by_cell(pairs), kind)


def _by_cell(one):
    """Applies `one` to the rows of each cell, from rows sorted by cell (key, i, j), one cell at a time."""

    def run(batches):
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            at = np.stack([table[c].to_numpy() for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist()]
            for lo, hi in zip(cuts, cuts[1:]):  # noqa: B905
                yield one(table.slice(lo, hi - lo))
            left = table.slice(cuts[-1])
        if left is not None and left.num_rows:
            yield one(left)

    return run


def _verified_cells(found: DataFrame, sigs: DataFrame, docs: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of members of a cell and their partners whose shingle sets have the similarity or more; exact, and written. A cell's
    texts are brought to it, one for each member that has or is a partner, so no row is made for a pair."""
    texts = _texts(found.select("node"), sigs, docs, text)
    dealt = found.join(texts, "node").select("key", "i", "j", "node", "partners", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def fitting(cell: pa.Table) -> pa.RecordBatch:
        held = _Shingles(shingle)
        node, partners, of = cell["node"].to_pylist(), cell["partners"].to_pylist(), cell["text"]
        place = {n: k for k, n in enumerate(node)}
        ab = [(n, p) for n, some in zip(node, partners, strict=True) for p in some if held.alike(n, p, lambda x: of[place[x]].as_py(), similarity)]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in ab], pa.int64()), pa.array([b for _, b in ab], pa.int64())], names=["a", "b"])

    links = staged(dealt.mapInArrow(_by_cell(fitting), "a long, b long"), "links")
    discard(texts)
    return links


def similar_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = 500) -> DataFrame:
    """(doc_id, sha, group_id, group_sha) of the rows that are linked to others, a row being known by its id and the
    SHA-256 of its text; the group's name is its row of the smallest id, a null id counting as the largest."""
    found = map_texts(docs, _signatures(shingle), "sha binary, keys array<long>, sketch binary, fp long", key, text).withColumnRenamed(key, "doc")
    sigs = staged(found.withColumn("node", F.monotonically_increasing_id()), "signatures")
    least = similarity - 0.12
    keyed = sigs.select("node", F.explode("keys").alias("key"))
    hubs = staged(keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key", "low"), "hubs")
    members = staged(keyed.join(hubs, "key").select("key", "node", "low"), "buckets")
    # the pairs of near fingerprints; each node with one smallest member, then with those of its other buckets that are in another group, then any two members
    alike = staged(_close(_near_fingerprints(sigs), sigs, least), "candidates")
    found = _verified(alike, sigs, docs, text, shingle, similarity)
    first = members.filter("low < node").groupBy(F.col("node").alias("b")).agg(F.min("low").alias("a")).select("a", "b").join(alike, ["a", "b"], "left_anti")
    tried = staged(_close(first, sigs, least), "candidates")
    links = found.unionByName(_verified(tried, sigs, docs, text, shingle, similarity))
    tried = alike.unionByName(tried)
    labels = staged(components(links), "labels")
    open_ = _mixed(members, labels)
    hubs = open_.filter("low < node AND root <> low_root").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = staged(_close(hubs, sigs, least), "candidates")
    tried, links = tried.unionByName(more), links.unionByName(_verified(more, sigs, docs, text, shingle, similarity))
    labels = staged(components(links), "labels")
    # the most alike ones first: they join most groups that will be one, and those need no more pairs
    members = open_.select("key", "node", "low")
    near = staged(_across(members, sigs, labels, least, block, 4).distinct().join(tried, ["a", "b"], "left_anti"), "candidates")
    links = links.unionByName(_verified(near, sigs, docs, text, shingle, similarity))
    labels = staged(components(links), "labels")
    rest = staged(_across(members, sigs, labels, least, block), "cells")
    links = links.unionByName(_verified_cells(rest, sigs, docs, text, shingle, similarity))
    labels = staged(components(links), "labels")
    discard(open_, rest)
    rows = staged(labels.join(sigs.select("node", "doc", "sha"), "node"), "similar-rows")
    discard(sigs)
    names = rows.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "sha")).alias("name"))
    return rows.join(staged(names, "names"), "root").select(F.col("doc").alias(key), "sha", F.col("name.doc").alias("group_id"), F.col("name.sha").alias("group_sha"))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, group_id) of documents that are linked to others at the given similarity or more; group_id is the smallest doc_id of the group."""
    return similar_rows(docs, key, text, shingle, similarity).select(key, "group_id")


def without_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, without those of a group but its named one. Other columns may have any names."""
    mark, mine, theirs = unused(docs, "text_sha256", "gone_doc_id", "gone_sha256")
    same = F.col(key).eqNullSafe(F.col("group_id")) & (F.col("sha") == F.col("group_sha"))
    gone = similar_rows(docs, key, text, shingle, similarity).filter(~same).select(F.col(key).alias(mine), F.col("sha").alias(theirs)).distinct()
    marked = docs.withColumn(mark, F.unhex(F.sha2(F.coalesce(column(text), F.lit("")), 256)))
    return marked.join(gone, column(key).eqNullSafe(column(mine)) & (column(mark) == column(theirs)), "left_anti").select(*map(column, docs.columns))
