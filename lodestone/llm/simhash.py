"""SimHash fingerprints linked by covering locality-sensitive hashing.

Every bit position has a non-zero code of radius + 1 bits; table v keeps the
positions whose code has an odd product with v. The codes of at most radius
differing positions leave some v orthogonal to all of them, so each pair
within the radius agrees on some table's key: nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, slices, stored

#: Buckets up to this many fingerprints are compared inside a task; larger ones by shared midpoints.
BLOCK = 2048
#: Near copies: buckets up to this size are compared whole; of larger ones, parts of about PART rows with so many hubs.
SMALL, HUBS, PART = 16, 2, 1024
#: Near copies: most sets that hold a rare shingle.
RARE = 8


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """One mask for each non-zero vector of radius + 1 bits."""
    codes = [1 + i % ((1 << (radius + 1)) - 1) for i in range(bits)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(hashes: np.ndarray, starts: np.ndarray, wide: int = 1) -> np.ndarray:
    """SimHash of each run of shingle hashes: (runs, ``wide``) words of 64 bits."""
    out = np.zeros((len(starts), wide), np.uint64)
    if not len(starts):
        return out
    mixed, size = hashes.astype("<u8"), np.diff(np.append(starts, len(hashes)))[:, None]
    for w in range(wide):
        if w:
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(w)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        over = np.add.reduceat(bits, starts, axis=0, dtype=np.int32) * 2 > size
        out[:, w] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints_of(texts: list[str | None], words: int, wide: int = 1) -> np.ndarray:
    """SimHash of each text over its shingles of ``words`` words, repeats included: (texts, ``wide``) words of 64 bits.

    The first word comes from XXH64 with seed 42, each further one from that hash mixed anew.
    """
    hashes, starts, rows = shingle_sets(texts, words)
    out = np.zeros((len(texts), wide), np.uint64)
    out[rows] = _fingerprints(hashes, starts, wide)
    return out


def fingerprint(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text", wide: int = 1) -> DataFrame:
    """(id, fp) for every row, with fp1 and so on if ``wide``; fingerprints are signed longs, zero without words."""
    names = ["fp", *[f"fp{w}" for w in range(1, wide)]]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                prints = fingerprints_of(part.column("t").to_pylist(), words, wide).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("k"), *[pa.array(prints[:, w].copy()) for w in range(wide)]], ["id", *names])

    return docs.selectExpr(f"`{id_col}` AS k", f"`{text_col}` AS t").mapInArrow(run, ", ".join([f"id {kind}", *[f"{n} bigint" for n in names]]))


def _local_links(table: np.ndarray, key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole buckets, which lie next to each other, as places; fp is (rows, words)."""
    n = len(fp)
    first = np.ones(n, bool)
    first[1:] = (table[1:] != table[:-1]) | (key[1:] != key[:-1])
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, n))
    left = np.repeat(begin + size, size) - np.arange(n)  # rows from here to the bucket's end
    label = np.arange(n)
    at = np.flatnonzero(left > 1)
    step = 1
    while len(at):
        close = at[np.bitwise_count(fp[at] ^ fp[at + step]).sum(1, dtype=np.int32) <= radius]
        while len(close):
            a, b = label[close], label[close + step]
            apart = a != b
            if not apart.any():
                break
            close, low, high = close[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(label, high, low)
            while True:
                shorter = label[label]
                if (shorter == label).all():
                    break
                label = shorter
        step += 1
        at = at[left[at] > step]
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def link_fingerprints(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) links between the distinct ``fp`` values that join all within ``radius`` differing bits.

    Two fingerprints are linked directly or through others exactly if they are
    in the closure of the relation; not every pair is given. Buckets of at
    most BLOCK are compared in one task; the members of a larger one are each
    paired with what differs from them in radius / 2 of the bits outside its
    mask: two members within the radius share such a midpoint, and two that
    share one are within the radius.
    """
    masks = covering_masks(radius)
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])).alias("x"))
    dealt = keyed.select("x.t", "x.key", "fp")
    dealt = dealt.repartition("t", "key").sortWithinPartitions("t", "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, t):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(t.astype(np.int32))], ["a", "b", "t"])

        def whole(t, k, f):
            a, b = _local_links(t, k, f[:, None], radius)
            pair = np.unique(np.stack([f[a], f[b]]), axis=1) if len(a) else np.zeros((2, 0), np.uint64)
            return out(pair[0], pair[1], np.full(pair.shape[1], -1))

        held, large = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)), None
        for batch in batches:
            own = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
            t, k, f = (np.concatenate(x) for x in zip(held, own, strict=True))
            last = int(np.flatnonzero((t != t[-1]) | (k != k[-1]))[-1]) + 1 if ((t != t[-1]) | (k != k[-1])).any() else 0
            if large is not None and len(t):
                more = int(np.argmin((t == large[0]) & (k == large[1]))) if not ((t == large[0]) & (k == large[1])).all() else len(t)
                if more:
                    yield out(f[:more], f[:more], t[:more])
                if more == len(t):
                    held = tuple(x[:0] for x in held)
                    continue
                t, k, f, last, large = t[more:], k[more:], f[more:], max(0, last - more), None
            # Buckets that are too large go out as they are, the others with their links.
            new = np.flatnonzero(np.append(True, (t[1:last] != t[: last - 1]) | (k[1:last] != k[: last - 1]))) if last else np.zeros(0, np.int64)
            size = np.diff(np.append(new, last))
            big = np.repeat(size > BLOCK, size)
            if big.any():
                yield out(f[:last][big], f[:last][big], t[:last][big])
            if (~big).any():
                yield whole(t[:last][~big], k[:last][~big], f[:last][~big])
            held = (t[last:], k[last:], f[last:])
            if len(held[0]) > BLOCK:
                yield out(held[2], held[2], held[0])
                large, held = (held[0][0], held[1][0]), tuple(x[:0] for x in held)
        if len(held[0]):
            yield whole(*held)

    found = stored(dealt.mapInArrow(compare, "a bigint, b bigint, t int"), "near")
    links = found.where("t < 0").select("a", "b")
    hot = found.where("t >= 0").select(F.col("a").alias("fp"), "t").distinct()
    if not hot.isEmpty():
        spark = prints.sparkSession
        flips = spark.createDataFrame([(t, _signed(f)) for t, m in enumerate(masks) for f in _flips(~m & ((1 << 64) - 1), radius // 2)], "t int, f bigint")
        middle = hot.join(F.broadcast(flips), "t").select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("z")).distinct()
        least = middle.groupBy("z").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).where("m < x")
        links = links.unionByName(middle.join(least, "z").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")))
    return links


def _flips(free: int, most: int) -> list[int]:
    """All sets of at most ``most`` of the free bits."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    found, last = [0], [(0, -1)]
    for _ in range(most):
        last = [(f | b, i) for f, top in last for i, b in enumerate(bits) if i > top]
        found += [f for f, _ in last]
    return found


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``; component_id is the smallest id reachable over links.

    A null, empty or blank text has fingerprint zero and links like any other;
    a text of fewer words than a shingle is one shingle. Repeated rows are each
    returned. A row with a null id gets no component unless others are in its
    own. An empty table gives no rows; other columns are not read.
    """
    of = stored(fingerprint(docs, words, id_col, text_col), "prints")
    prints = stored(of.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    groups = components(link_fingerprints(prints, radius))
    labelled = prints.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    labelled = stored(labelled, "labelled")
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = labelled.join(smallest, "label").select("fp", "component_id")
    return of.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def text_print(text: Column) -> Column:
    """Hash that tells texts of rows that share an id apart."""
    return F.xxhash64(text)


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """XXH64 of all shingles of ``words`` words, where each text's begin, and the rows of the texts that have words."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    starts, rows = [], []
    for row, text in enumerate(texts):
        tokens = text.encode().lower().split() if text else []
        if not tokens:
            continue
        starts.append(len(hashes))
        rows.append(row)
        line = b" ".join(tokens)
        if len(tokens) <= words:
            hashes.append(digest(line, 42))
        else:
            size = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
            begin = [0, *size[:-words].tolist()]
            hashes += [digest(line[a:b], 42) for a, b in zip(begin, (size[words - 1 :] - 1).tolist(), strict=True)]
    return np.array(hashes, np.uint64), np.array(starts, np.int64), rows


def _each_set(texts: list[str | None], words: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Row, sorted distinct shingle hashes and their 128-bit digest of each text that has words."""
    yield from _sets_of(*shingle_sets(texts, words))


def _sets_of(hashes: np.ndarray, starts: np.ndarray, rows: list[int]) -> Iterator[tuple[int, np.ndarray, bytes]]:
    for row, a, b in zip(rows, starts, np.append(starts[1:], len(hashes)), strict=True):
        own = np.unique(hashes[a:b])
        yield row, own, xxhash.xxh3_128_digest(own.tobytes())


def min_hashes(hashes: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """(texts with words, ``count``) minima of the shingles' hashes under as many multipliers."""
    out = np.empty((len(starts), count), np.uint64)
    for i, odd in enumerate(np.random.default_rng(11).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)):
        if len(starts):
            out[:, i] = np.minimum.reduceat(hashes * odd, starts)
    return out


def _signed_texts(docs: DataFrame, words: int, bands: int, depth: int, id_col: str, text_col: str) -> DataFrame:
    """(id, print, g1, g2, size, fp, keys, sig) for every row: hash of its text, digest and size of its shingle set, its SimHash fingerprint, a key for each band and a byte of each minimum; null without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                texts = part.column("t").to_pylist()
                hashes, starts, rows = shingle_sets(texts, words)
                least, prints = min_hashes(hashes, starts, bands * depth), _fingerprints(hashes, starts)[:, 0].view(np.int64)
                mixed = np.zeros((len(rows), bands), np.uint64)
                for d in range(depth):
                    mixed = (mixed ^ least[:, d::depth]) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                low = ((least >> np.uint64(40)) ^ (least >> np.uint64(24))).astype(np.uint8)
                digest: list = [None] * len(texts)
                keys, sig, size, fp = list(digest), list(digest), list(digest), list(digest)
                for k, (row, own, name) in enumerate(_sets_of(hashes, starts, rows)):
                    digest[row], size[row], fp[row], keys[row], sig[row] = np.frombuffer(name, np.int64).tolist(), len(own), int(prints[k]), mixed[k].view(np.int64), low[k].tobytes()
                halves = [pa.array([d and d[h] for d in digest], pa.int64()) for h in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("p"), *halves, pa.array(size, pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["id", "print", "g1", "g2", "size", "fp", "keys", "sig"])

    return docs.select(F.col(id_col).alias("k"), text_print(F.col(text_col)).alias("p"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, print bigint, g1 bigint, g2 bigint, size bigint, fp bigint, keys array<bigint>, sig binary")


def _heads(t: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where buckets that lie next to each other begin."""
    return np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]))) if len(t) else np.zeros(0, np.int64)


def _pairs_apart(begin: np.ndarray, n: int, label: np.ndarray, sig: np.ndarray, first: int, last: int, alike: int) -> np.ndarray:
    """Pairs of places of one bucket that are ``first`` to ``last`` apart, of different labels and with at least ``alike`` equal bytes."""
    size = np.diff(np.append(begin, n))
    left = np.repeat(begin + size, size) - np.arange(n)  # rows from here to the bucket's end
    found = [np.zeros((2, 0), np.int64)]
    for step in range(first, min(last, int(size.max(initial=1)) - 1) + 1):
        at = np.flatnonzero(left > step)
        at = at[label[at] != label[at + step]]
        for part in np.array_split(at, len(at) // 100_000 + 1):
            found.append(np.stack([part, part + step])[:, (sig[part] == sig[part + step]).sum(1) >= alike])
    return np.concatenate(found, axis=1)


def _hubs(sig: np.ndarray, number: int) -> np.ndarray:
    """The rows of a bucket that come nearest to its commonest bytes."""
    usual = np.array([np.bincount(column).argmax() for column in sig.T])
    return np.argsort(-(sig == usual).sum(1), kind="stable")[:number]


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first columns t, key and part, cut where one of these changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t, key, part = (batch.column(c).to_numpy() for c in range(3))
        edge = np.flatnonzero((t != t[-1]) | (key != key[-1]) | (part != part[-1]))
        if len(edge):  # what came before the last bucket is whole, with what was held of its first
            cut = int(edge[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and tuple(held[-1].column(c)[-1].as_py() for c in range(3)) != (int(t[0]), int(key[0]), int(part[0])):
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _bytes_matrix(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(rows.num_rows, -1)


def _ordered(node: np.ndarray, pair: np.ndarray) -> np.ndarray:
    a, b = node[pair[0]], node[pair[1]]
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)


def _first_candidates(members: DataFrame, alike: int) -> DataFrame:
    """(a, b, t, key, sig, hub): pairs where t is -1, else the members of buckets that are not compared whole.

    Members are (t, key, part, node, sig). A bucket's part of at most SMALL rows
    is compared whole; of a larger one each row is paired with the part's hubs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(batches):
            t, key, part, node = (rows.column(c).to_numpy() for c in ("t", "key", "part", "node"))
            sig = _bytes_matrix(rows)
            begin = _heads(t, key * 64 + part)
            size = np.diff(np.append(begin, len(t)))
            small = np.repeat(size <= SMALL, size)
            at = np.flatnonzero(small)
            pairs = [at[_pairs_apart(np.cumsum(size[size <= SMALL]) - size[size <= SMALL], len(at), node[at], sig[at], 1, SMALL, alike)]] if len(at) else []
            hub = np.zeros(len(t), bool)
            for b, n in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
                for h in _hubs(sig[b : b + n], HUBS).tolist():
                    hub[b + h] = True
                    near = np.flatnonzero((sig[b : b + n] == sig[b + h]).sum(1) >= alike)
                    near = near[near != h]
                    pairs.append(np.stack([np.full(len(near), b + h), b + near]))
            # A part of a bucket is never the whole of it, so its rows stay, with a hub.
            split = np.repeat(part[begin] >= 0, size)
            hub[begin[part[begin] >= 0]] = True
            rest = np.flatnonzero(~small | split)
            pair = _ordered(node, np.concatenate(pairs, axis=1)) if pairs else np.zeros((2, 0), np.int64)
            none = np.zeros(pair.shape[1], np.int64)
            columns = [np.concatenate(c) for c in ((pair[0], node[rest]), (pair[1], node[rest]), (none - 1, t[rest]), (none, key[rest]))]
            marks = pa.array([None] * len(none) + [sig[i].tobytes() for i in rest.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32)), pa.array(columns[3]), marks, pa.array(np.append(none > 0, hub[rest] & split[rest]))], ["a", "b", "t", "key", "sig", "hub"])

    dealt = members.select("t", "key", "part", "node", "sig").repartition("t", "key", "part").sortWithinPartitions("t", "key", "part", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint, t int, key bigint, sig binary, hub boolean")


def _later_candidates(members: DataFrame, first: int, last: int, alike: int, share: Fraction) -> DataFrame:
    """(a, b, t, key, sig, size, common): pairs of rows ``first`` to ``last`` apart where t is -1, else the members of buckets that have pairs further apart.

    Members are (t, key, part, node, label, sig, size, common); pairs that
    share no rare shingle cannot overlap in more than either has of common ones.
    """
    names = ["a", "b", "t", "key", "sig", "size", "common"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(batches):
            t, key, node, label, size, common = (rows.column(c).to_numpy() for c in ("t", "key", "node", "label", "size", "common"))
            sig, begin = _bytes_matrix(rows), _heads(t, key)
            number = np.diff(np.append(begin, len(t)))
            a, b = _pairs_apart(begin, len(t), label, sig, first, last, alike)
            may = np.minimum(common[a], common[b]) * (share.numerator + share.denominator) >= share.numerator * (size[a] + size[b])
            pair = _ordered(node, np.stack([a[may], b[may]]))
            several = np.minimum.reduceat(label, begin) != np.maximum.reduceat(label, begin)
            rest = np.flatnonzero(np.repeat((number > last + 1) & several, number))
            none = np.zeros(pair.shape[1], np.int64)
            columns = [np.concatenate(c) for c in ((pair[0], node[rest]), (pair[1], node[rest]), (none - 1, t[rest]), (none, key[rest]), (none, size[rest]), (none, common[rest]))]
            marks = pa.array([None] * len(none) + [sig[i].tobytes() for i in rest.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32)), pa.array(columns[3]), marks, pa.array(columns[4]), pa.array(columns[5])], names)

    dealt = members.select("t", "key", F.lit(-1).alias("part"), "node", "label", "sig", "size", "common").repartition("t", "key").sortWithinPartitions("t", "key", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint, t int, key bigint, sig binary, size bigint, common bigint")


def _sets(wanted: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, set) of the wanted (node, k, g1, g2): sorted shingle hashes of the text of row k with that digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                node, g1, g2 = (part.column(c).to_pylist() for c in ("node", "g1", "g2"))
                # Rows that share an id may have other texts.
                own = [(node[row], s.tobytes()) for row, s, name in _each_set(part.column("t").to_pylist(), words) if np.frombuffer(name, np.int64).tolist() == [g1[row], g2[row]]]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int64()), pa.array([s for _, s in own], pa.binary())], ["node", "set"])

    texts = docs.selectExpr(f"`{id_col}` AS k", f"`{text_col}` AS t").join(wanted, "k")
    return stored(texts.select("node", "g1", "g2", "t").mapInArrow(run, "node bigint, set binary").dropDuplicates(["node"]), "sets")


def _shingles(sets: DataFrame) -> DataFrame:
    """(shingle, node) of all sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("set")]
            if own:
                node = np.repeat(batch.column("node").to_numpy(), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(node)], ["shingle", "node"])

    return sets.mapInArrow(run, "shingle bigint, node bigint")


def _by_rare_shingles(nodes: DataFrame, sets: DataFrame, share: Fraction) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes with different labels that may reach the similarity with a rare shingle in common; and the nodes with ``common``.

    nodes: node, label, size. A shingle is rare if 2 to RARE sets hold it, so a
    set has a bounded number of such partners; ``common`` counts a node's
    shingles that more sets hold. Sets that share no rare shingle overlap in at
    most the fewer common ones; those that share r of them in r more.
    """
    every = stored(_shingles(sets), "shingles")
    # Common shingles are most rows of a large group, so the others are counted and taken off.
    few = stored(every.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("only")).where(F.col("n") <= RARE), "few")
    rare = stored(every.join(few.where("n > 1").select("shingle"), "shingle"), "rare")
    less = few.where("n = 1").select(F.col("only").alias("node")).union(rare.select("node")).groupBy("node").agg(F.count("*").alias("less"))
    nodes = stored(nodes.join(less, "node", "left").withColumn("common", F.col("size") - F.coalesce("less", F.lit(0))).drop("less"), "with-common")
    met = rare.select("shingle", F.col("node").alias("a")).join(rare.select("shingle", F.col("node").alias("b")), "shingle").where("a < b").groupBy("a", "b").agg(F.count("*").alias("r"))
    of = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("label", "size", "common")])
    rows = met.join(of("a"), "a").join(of("b"), "b").where("a_label <> b_label")
    reach = F.least("a_common", "b_common") + F.col("r")
    return rows.where(reach * (share.numerator + share.denominator) >= share.numerator * (F.col("a_size") + F.col("b_size"))).select("a", "b"), nodes


def _verified(pairs: DataFrame, prints: DataFrame, docs: DataFrame, words: int, share: Fraction, id_col: str, text_col: str) -> DataFrame:
    """Those of the (a, b) pairs of nodes whose shingle sets have the Jaccard similarity, decided in whole numbers."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    held = _sets(prints.join(wanted, "node").select("node", F.col("first.id").alias("k"), "g1", "g2"), docs, words, id_col, text_col)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * share.denominator >= share.numerator * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(held.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return joined.mapInArrow(decide, "a bigint, b bigint")


def _linked_by_fingerprint(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b) pairs of nodes: those of one fingerprint with the first of them, and the first of each two fingerprints that ``link_fingerprints`` links."""
    least = stored(prints.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    same = prints.select("node", "fp").join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    of = lambda x: least.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_node"))
    links = link_fingerprints(least.select("fp"), radius).join(of("a"), "a").join(of("b"), "b").where("a <> b")
    return same.union(links.select(F.least("a_node", "b_node"), F.greatest("a_node", "b_node")))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4, bands: int = 20, depth: int = 4, alike: int = 43, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print, component_id, kept) for every row whose id is not null; component_id is the smallest id of its group of near copies.

    ``print`` is ``text_print`` of the row's text; ``kept`` holds for the one
    (id, print) of the group that comes first. Rows equal in both are each given.

    Two texts are near copies if their sets of shingles of ``words`` words have
    at least this Jaccard ``similarity``; every link is decided by the sets
    themselves. The first candidates are the links of the texts' SimHash
    fingerprints at ``radius`` differing bits, by covering masks. At 0.8 two
    fingerprints differ in ten bits of 64 or so, so more candidates come from
    texts that agree on one of ``bands`` bands of ``depth`` minimal
    hashes and on ``alike`` of all the minima's bytes: a pair at 0.8 is missed
    with probability (1 - 0.8^4)^20, three in 100,000, and one in ten million
    for the second test, six standard deviations off. Texts without words are
    no near copies of any; equal sets always are.

    Small buckets are compared whole. The rows of a larger one, dealt in parts,
    are first compared with its hubs, those nearest to what its rows have in
    common; parts meet through their hubs. Where that leaves a bucket with
    several labels, its rows meet by the shingles that few sets hold; what shares
    none of those is compared at growing distances if both have enough common
    shingles for the similarity. No link is lost by this, and a group that differs
    from a common source in places of its own costs about its size; the rows that
    remain in a bucket to the last, 130 bytes each, are held by one task.
    """
    docs = docs.where(F.col(id_col).isNotNull())
    share = Fraction(str(similarity))
    of = stored(_signed_texts(docs, words, bands, depth, id_col, text_col), "prints")
    prints = of.where("g1 IS NOT NULL").groupBy("g1", "g2").agg(F.min(F.struct("id", "print")).alias("first"), F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    prints = stored(prints.withColumn("node", F.monotonically_increasing_id()), "distinct")
    members, rest, links = prints.select("node", "sig", F.posexplode("keys").alias("t", "key")), None, None

    def joined(pairs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
        """The groups with the links that the pairs bring; ``groups`` are those so far."""
        nonlocal links
        pairs = stored(pairs.distinct(), "pairs")
        if groups is not None and pairs.isEmpty():
            return groups
        new = stored(_verified(pairs, prints, docs, words, share, id_col, text_col), "verified")
        if groups is not None and new.isEmpty():
            return groups
        links = new if links is None else links.unionByName(new)
        return stored(components(links), "groups")

    pairs = _linked_by_fingerprint(prints, radius)
    while True:  # buckets too large for one part, then the hubs of their parts, and so on
        hot = stored(members.groupBy("t", "key").count().where(F.col("count") > PART).select("t", "key", F.ceil(F.col("count") / PART).alias("parts")), "hot")
        part = F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(-1)).cast("long").alias("part")
        found = stored(_first_candidates(members.join(hot, ["t", "key"], "left").select("t", "key", part, "node", "sig"), alike), "near")
        near = found.where("t < 0").select("a", "b")
        pairs = pairs.unionByName(near)
        of_level = found.where("t >= 0").select(F.col("a").alias("node"), "t", "key", "sig", "hub")
        rest = of_level if rest is None else rest
        members = of_level.where("hub").drop("hub")
        if hot.isEmpty():
            break
    groups = joined(pairs)

    label = F.coalesce("component", "node").alias("label")
    rest = stored(rest.drop("hub").join(groups, "node", "left").select("node", label, "t", "key", "sig"), "rest")
    open_ = stored(rest.groupBy("t", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("t", "key"), "open")
    if not open_.isEmpty():
        rest = stored(rest.join(open_, ["t", "key"]), "rest")
        nodes = prints.join(rest.select("node", "label").distinct(), "node").select("node", "label", "size", F.col("first.id").alias("k"), "g1", "g2")
        nodes = stored(nodes, "nodes")
        more, nodes = _by_rare_shingles(nodes.select("node", "label", "size"), _sets(nodes.select("node", "k", "g1", "g2"), docs, words, id_col, text_col), share)
        groups = joined(more, groups)
        # Only what has enough common shingles for the similarity with the smallest of its bucket.
        members = rest.select("node", "t", "key", "sig").join(nodes.select("node", "size", "common"), "node").join(groups, "node", "left").select("node", label, "t", "key", "sig", "size", "common")
        enough = F.col("common") * (share.numerator + share.denominator) >= share.numerator * (F.col("size") + F.col("least"))
        members = stored(members, "open-rows")
        least = members.groupBy("t", "key").agg(F.min("size").alias("least"))
        members = stored(members.join(least, ["t", "key"]).where(enough).drop("least"), "open-rows")
        several = members.groupBy("t", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("t", "key")
        members = stored(members.join(several, ["t", "key"]), "open-rows")
        first, last = 1, 2
        while not members.isEmpty():
            found = stored(_later_candidates(members, first, last, alike, share), "near")
            groups = joined(found.where("t < 0").select("a", "b"), groups)
            members = found.where("t >= 0").select(F.col("a").alias("node"), "t", "key", "sig", "size", "common")
            members = stored(members.join(groups, "node", "left").select("node", label, "t", "key", "sig", "size", "common"), "open-rows")
            first, last = last + 1, last * 8
    labelled = prints.join(groups, "node", "left").select("g1", "g2", "first", F.coalesce("component", "node").alias("label"))
    labelled = stored(labelled, "labelled")
    smallest = labelled.groupBy("label").agg(F.min("first").alias("keeper"))
    classes = labelled.join(smallest, "label").select("g1", "g2", "keeper")
    found = of.select("id", "print", "g1", "g2").join(classes, ["g1", "g2"], "left")
    kept = F.col("keeper").isNull() | (F.struct("id", "print") == F.col("keeper"))
    return found.select(F.col("id").alias(id_col), "print", F.coalesce("keeper.id", "id").alias("component_id"), kept.alias("kept"))
