"""N-gram Jaccard join: documents whose sets of word shingles are at least 75 % alike, and the groups they form.

Sets link when 100 * intersection >= 75 * union; no link is lost. The steps:

1. Documents with equal sets form a class (two 64-bit sums and the size tell sets apart).
2. A set links with no other if more than a quarter of its shingles are in no other set. That is tested on the third
   of all hashes divisible by three: tasks send (hash, class) packed by hash range, at most two classes per hash
   (enough to show that it is shared), so a shingle of a third of all documents costs two entries a task. Most
   documents leave here. The others' sets are written, and the test is made again among them with all hashes.
3. Sizes fall into bands that grow by 4/3. Linked sets lie in one band or in neighbours,
   and their symmetric difference is at most d, a third of the band's upper end. So sets are cut by hash into p > d
   parts, and each part is XOR-hashed to 64 bits: as one element changes one part, linked sets agree in p - d parts.
   Sets that have fewer empty parts than that agree in a part that is not empty, which is where they meet. If two linked
   sets agree in empty parts only, both have many; such sets meet in the first quarter of their hashes, too: sets that
   share three quarters of their elements share one of those.
4. Where sets meet they are verified with exact intersections: first each with the smallest that its task holds of the
   key, and these with the smallest of all (which unites copies without listing their pairs, and sends a key once a
   task), then, where keys still hold several components, the nearest of each two, then all that are still across. Keys of few
   sets list their pairs; those of many are bundled by the smallest set that has them, so that sets of one template meet once and
   not once a key. Parity sketches of 2048 bits, whose Hamming distance is at most the symmetric
   difference, tell what is near and sort out most of what does not link.

Components come from alternating stars over the verified links. Nothing of this reaches the driver but counts.

Null text, and text without a word, has an empty set and links with nothing: its component is its own id. Rows that
share id and text are one node; rows that share only the id are nodes of their own. Null ids stay null unless linked to
a row that has one. An empty table gives an empty result. A very long text is one row in memory, and so is its set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import DOCUMENT, discard, map_batches, own_columns, written
from palimpsest.llm.components import components
from palimpsest.llm.hashing import mix, shingles

#: Packed entries to a bucket, about, and to a task's flush.
BUCKET = 400_000
FLUSH = 600_000
#: Rows of two longs up to which a table is broadcast.
BROADCAST_ROWS = 1_000_000
SKETCH_WORDS = 32


def _bytes(value: pa.Scalar) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


def _class_of(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums of a set."""
    with np.errstate(over="ignore"):
        k = mix(s).sum(dtype=np.uint64) + np.uint64(len(s)) * np.uint64(0xA0761D6478BD642F)
        check = np.bitwise_xor.reduce(mix(s + np.uint64(0x1234567)), initial=np.uint64(0))
    return int(k.astype(np.int64)), int(check.astype(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): ``key`` tells rows of different id or text apart, so that nothing hangs on ids alone."""
    return own_columns(docs, "doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))


def shingle_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, k, c): the size of each document's set and the two sums that name its class."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, k, c = [], [], []
        for value in batch.column(1):
            s = shingles(_bytes(value))
            a, b = _class_of(s)
            n.append(len(s))
            k.append(a)
            c.append(b)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in (n, k, c))], names=["doc_id", "key", "n", "k", "c"])

    return map_batches(_keyed(docs), run, "doc_id long, key long, n long, k long, c long")


# ---------------------------------------------------------------- packed shuffles

PACKED = "bucket long, x binary, y binary"


def _packed(x: np.ndarray, y: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries (x, y) by range of the mixed x, one row per bucket."""
    if not len(x):
        return
    at = (mix(x) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, x, y = at[order], x[order], y[order]
    used, first = np.unique(at, return_index=True)
    ends = [*first[1:].tolist(), len(at)]
    blobs = [[v[s:e].tobytes() for s, e in zip(first.tolist(), ends, strict=True)] for v in (x, y)]
    yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(b, pa.binary()) for b in blobs)], names=["bucket", "x", "y"])


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.frombuffer(b.as_py(), np.uint64) for b in rows.column(c)]) for c in ("x", "y"))  # type: ignore[return-value]


def _at_most_two(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by x; of each x the smallest and, if it differs, the largest y."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    edge = np.ones(len(x), bool)
    edge[1:] = x[1:] != x[:-1]
    last = np.append(edge[1:], True) if len(x) else edge
    first_y = y[np.flatnonzero(edge)][np.cumsum(edge) - 1] if len(x) else y
    keep = edge | (last & (y != first_y))
    return x[keep], y[keep]


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    order = np.lexsort((b, a))
    a, b = a[order].astype(np.int64), b[order].astype(np.int64)
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.table({"a": a[first], "b": b[first]})


def _lone_counts(rows: DataFrame, read: Callable[[pa.RecordBatch, int], tuple[np.ndarray, int]], buckets: int) -> DataFrame:
    """(k, lone): how many of the hashes that ``read`` gives for a class are given for no other class."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from _packed(*_at_most_two(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])), buckets)

        for batch in batches:
            for row in range(batch.num_rows):
                s, k = read(batch, row)
                held.append((s, np.full(len(s), k, np.int64).view(np.uint64)))
                size += len(s)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    def count(rows: pa.Table) -> pa.Table:
        x, y = _at_most_two(*_unpacked(rows))
        lone = np.ones(len(x), bool)
        lone[1:] &= x[1:] != x[:-1]
        lone[:-1] &= x[1:] != x[:-1]
        k, n = np.unique(y[lone], return_counts=True)
        return pa.table({"k": k.view(np.int64), "lone": n.astype(np.int64)})

    return rows.mapInArrow(send, PACKED).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count, "k long, lone long").groupBy("k").agg(F.sum("lone").alias("lone"))


def _sampled(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, int]:
    """A third of a text's shingles; a set under 3 links with its equals only."""
    s = shingles(_bytes(batch.column(0)[row]))
    return (s[s % np.uint64(3) == 0], _class_of(s)[0]) if len(s) > 2 else (s[:0], 0)


def _stored(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, int]:
    return batch.column(1)[row].values.to_numpy().view(np.uint64), batch.column(0)[row].as_py()


# ---------------------------------------------------------------- bands and parts


def band_edges(largest: int) -> list[int]:
    """Lower ends of the bands of set sizes, from 3 on."""
    edges = [3]
    while edges[-1] <= largest:
        edges.append(edges[-1] * 4 // 3 + 1)
    return edges


def part_keys(s: np.ndarray, band: int, upper: int) -> np.ndarray:
    """The keys under which a set meets others of the scheme of ``band``, whose smaller sets are under ``upper``."""
    d = (upper - 1) // 3
    slack = d // 4 + 1
    p = d + 1 + slack
    at = (mix(s ^ np.uint64(0x5851F42D4C957F2D + band)) % np.uint64(p)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    parity = np.bitwise_xor.reduceat(mix(s[order]), first)
    part = at[first].astype(np.uint64)
    keys = mix(parity + mix(part * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(band + 1)))
    if p - len(part) > slack:  # a meeting is not sure, unless the other has many empty parts as well
        keys = np.append(keys, mix(s[: len(s) - -(-3 * len(s) // 4) + 1] ^ np.uint64(0x9E6C63D0876A9A47 + band)))
    return keys


def sketch(s: np.ndarray) -> np.ndarray:
    """2048 parity bits of a set."""
    at = (mix(s ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64)
    odd = np.bincount(at, minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


SETS = "k long, n long, s array<long>, w array<long>"


def _sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The sets and sketches of the chosen (key, k, c)."""
    own = _keyed(docs).join(chosen, "key").select("text", "k", "c")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ks, ns, ss, ws = [], [], [], []
        for value, *name in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            s = shingles(_bytes(value))
            if _class_of(s) == tuple(name):
                ks.append(name[0])
                ns.append(len(s))
                ss.append(s.view(np.int64))
                ws.append(sketch(s).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(ns, pa.int64()), pa.array(ss, pa.list_(pa.int64())), pa.array(ws, pa.list_(pa.int64()))], names=["k", "n", "s", "w"])

    return map_batches(own, run, SETS)


#: Sets of a key up to which its pairs are listed at once; sets to a block of larger groups.
LISTED = 16
BLOCK = 2048


def _send_keys(sets: DataFrame, buckets: int, edges: list[int], send: Callable[[np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, with_root: bool) -> DataFrame:
    """What ``send`` makes of the keys of all sets, flush by flush; with ``root`` an entry is two numbers, set and component."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            roots = batch.column(2).to_pylist() if with_root else None
            for row, k in enumerate(batch.column(0).to_pylist()):
                s = batch.column(1)[row].values.to_numpy().view(np.uint64)
                own = int(np.searchsorted(edges, len(s), side="right")) - 1
                # its own band, as the smaller or an equal; the band below, as the larger
                for band in (own, own - 1):
                    if band >= 0:
                        keys = part_keys(s, band, edges[band + 1])
                        who = np.array([k, roots[row]] if roots else [k], np.int64).view(np.uint64)
                        held.append((np.repeat(keys, len(who)), np.tile(who, len(keys))))
                        size += len(keys)
                if size >= FLUSH:
                    yield from send(*(np.concatenate(h) for h in zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield from send(*(np.concatenate(h) for h in zip(*held, strict=True)))

    return sets.select("k", "s", *(["root"] if with_root else [])).mapInArrow(run, schema)


def _with_smallest(x: np.ndarray, k: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Pairs of each set with the smallest of each key, and these (key, smallest)."""
    order = np.lexsort((k, x))
    x, k = x[order], k[order]
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    low = np.repeat(k[first], np.diff(np.append(first, len(x))))
    return _unique_pairs(k[k != low], low[k != low]), x[first], k[first]


def _met_smallest(sets: DataFrame, buckets: int, edges: list[int]) -> DataFrame:
    """Pairs (a, b): each set with the smallest of each key in its flush, and these with the smallest of the key. A key
    that a third of all sets have is one entry to a flush."""

    def send(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs, x, k = _with_smallest(x, y.view(np.int64))
        a, b = (pairs.column(c).to_numpy() for c in ("a", "b"))
        for kind, rows in enumerate((_packed(x, k.view(np.uint64), buckets), _packed(a.view(np.uint64), b.view(np.uint64), buckets))):
            for r in rows:
                yield r.append_column("kind", pa.array(np.full(r.num_rows, kind)))

    def meet(rows: pa.Table) -> pa.Table:
        keys, pairs = rows.filter(pc.equal(rows.column("kind"), 0)), rows.filter(pc.equal(rows.column("kind"), 1))
        found = [_unique_pairs(*(v.view(np.int64) for v in _unpacked(pairs)))] if pairs.num_rows else []
        if keys.num_rows:
            x, y = _unpacked(keys)
            found.append(_with_smallest(x, y.view(np.int64))[0])
        return pa.concat_tables(found)

    return _send_keys(sets, buckets, edges, send, f"{PACKED}, kind long", False).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def _thinned(x: np.ndarray, k: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by (key, set); of a key with more than ``LISTED`` sets those of the smallest numbers, and one each of the smallest and the
    largest component: enough to show that it is large, whom it starts with, and whether it holds several components."""
    order = np.lexsort((k, x))
    x, k, root = x[order], k[order], root[order]
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    size = np.diff(np.append(first, len(x)))
    if (size <= LISTED).all():
        return x, k, root
    keep = np.arange(len(x)) - np.repeat(first, size) <= LISTED
    by_root = np.lexsort((root, x))
    keep[by_root[first]] = keep[by_root[first + size - 1]] = True
    return x[keep], k[keep], root[keep]


def _met_across(sets: DataFrame, buckets: int, edges: list[int]) -> DataFrame:
    """What meets in keys with several components: (a, b, null) for a pair of a small one, (key, set, key) as (a, b, large) for a large one,
    with the smallest set that has it. A flush sends no more than some twenty sets of a key."""

    def send(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, k, root = _thinned(x[::2], y[::2].view(np.int64), y[1::2].view(np.int64))
        yield from _packed(np.repeat(x, 2), np.stack([k, root], axis=1).ravel().view(np.uint64), buckets)

    def meet(rows: pa.Table) -> pa.Table:
        x, y = _unpacked(rows)
        x, k, root = x[::2], y[::2].view(np.int64), y[1::2].view(np.int64)
        order = np.lexsort((k, x))
        x, k, root = x[order], k[order], root[order]
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        size = np.diff(np.append(first, len(x)))
        several = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
        small = several & (size <= LISTED)
        listed = []
        for n in np.unique(size[small]).tolist():  # all buckets of a size at once
            at = first[small & (size == n)][:, None] + np.arange(n)
            i, j = np.triu_indices(n, 1)
            low, high, apart = k[at[:, i]], k[at[:, j]], root[at[:, i]] != root[at[:, j]]
            listed.append(np.stack([high[apart], low[apart]]))
        high, low = np.concatenate(listed, axis=1) if listed else np.empty((2, 0), np.int64)
        pairs = _unique_pairs(high, low)
        large = first[several & ~small]
        out = pairs.append_column("large", pa.nulls(pairs.num_rows, pa.int64()))
        return pa.concat_tables([out, pa.table({"a": x[large].view(np.int64), "b": k[large], "large": x[large].view(np.int64)})])

    return _send_keys(sets, buckets, edges, send, PACKED, True).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, "a long, b long, large long")


def _keys_of(sets: DataFrame, edges: list[int]) -> DataFrame:
    """(key, k): the keys of each set."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = []
        for row in range(batch.num_rows):
            s = batch.column(1)[row].values.to_numpy().view(np.uint64)
            own = int(np.searchsorted(edges, len(s), side="right")) - 1
            keys.append(np.concatenate([part_keys(s, band, edges[band + 1]) for band in (own, own - 1) if band >= 0]).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["k", "keys"])

    return map_batches(sets.select("k", "s"), run, "k long, keys array<long>").select(F.explode("keys").alias("key"), "k")


def _members(sets: DataFrame, large: DataFrame, edges: list[int]) -> DataFrame:
    """(g, first, k): who is to be compared with whom, for the sets of large keys (key, bundle).

    Sets that are nearly alike share most of their keys, so a group is not a key but a bundle: all sets of the keys that start with the same
    set. Those of one template are one bundle or a few, where each goes once, instead of once a key. Where the keys of a bundle have little in
    common, so that comparing the bundle would be more than comparing its keys, they stay groups by themselves. A group whose members all are
    in one earlier group has nothing new and goes; ``first`` is a set's earliest group, and what is in the same first group has met there."""
    entries = _keys_of(sets, edges).join(_small(large), "key")
    keys = entries.groupBy("key", "bundle").agg(F.count(F.lit(1)).alias("n"))
    alone = keys.groupBy("bundle").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("alone"))
    bundled = entries.select("bundle", "k").distinct()
    width = bundled.groupBy("bundle").agg(F.count(F.lit(1)).alias("width"))
    split = alone.join(width, "bundle").filter("double(width) * width > alone").select("bundle")
    split = written(split, "split-bundles")
    whole = bundled.join(_small(split), "bundle", "left_anti").select(F.xxhash64("bundle").alias("g"), "k")
    apart = entries.join(_small(split), "bundle", "left_semi").select(F.xxhash64(F.lit("key"), "key").alias("g"), "k").distinct()
    groups = written(whole.unionByName(apart), "groups")
    discard(split)
    firsts = groups.groupBy("k").agg(F.min("g").alias("first"))
    marked = written(groups.join(firsts, "k"), "groups")
    discard(groups)
    same = marked.groupBy("g").agg(F.min("first").alias("low"), F.max("first").alias("high"))
    new = same.filter("low <> high or low = g").select("g")
    kept = written(marked.join(new, "g", "left_semi"), "groups")
    discard(marked)
    return kept


def _in_blocks(groups: DataFrame) -> DataFrame:
    """(g, side, k, first): members by pair of blocks; a block holds about ``BLOCK`` sets, and pairs of blocks are groups of their own."""
    sizes = groups.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = groups.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("k"), "blocks").cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return pairs.select(F.xxhash64("g", low, high).alias("pair"), F.when(F.col("block") == low, 0).otherwise(1).cast("long").alias("side"), F.col("g").alias("whole"), "k", "first")


def _near_in_blocks(members: DataFrame, nearest: bool) -> DataFrame:
    """Pairs (a, b) of different components within block pairs (pair, side, whole, first, k, root, n, w) whose sketches are near enough and that
    have not met in an earlier group; if ``nearest``, only the nearest of each two components."""

    def compare(rows: pa.Table) -> pa.Table:
        side, k, root, n, whole, first = (rows.column(c).to_numpy() for c in ("side", "k", "root", "n", "whole", "first"))
        w = np.concatenate([c.flatten().to_numpy() for c in rows.column("w").chunks]).view(np.uint64).reshape(-1, SKETCH_WORDS)
        one = np.flatnonzero(side == 0)
        two = np.flatnonzero(side == 1) if (side == 1).any() else one
        found = [np.empty((3, 0), np.int64)]
        for i in one.tolist():
            apart = (root[two] != root[i]) & (4 * np.minimum(n[two], n[i]) >= 3 * np.maximum(n[two], n[i])) & ((first[two] != first[i]) | (first[i] == whole[i]))
            js = two[apart]
            distance = np.bitwise_count(w[js] ^ w[i]).sum(axis=1, dtype=np.int64)
            near = 7 * distance <= n[js] + n[i]
            found.append(np.stack([np.full(int(near.sum()), i), js[near], distance[near]]))
        i, j, distance = np.concatenate(found, axis=1)
        if nearest:
            low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
            order = np.lexsort((distance, high, low))
            first = np.ones(len(order), bool)
            first[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
            i, j = i[order][first], j[order][first]
        return _unique_pairs(np.maximum(k[i], k[j]), np.minimum(k[i], k[j]))

    return members.select("pair", "side", "whole", "first", "k", "root", "n", "w").groupBy("pair").applyInArrow(compare, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs whose sets are alike enough; sketches go first, as they are short."""
    side = lambda x: sets.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("w").alias(f"w_{x}"))
    distance = F.aggregate(F.zip_with("w_a", "w_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter((4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")) & (7 * distance <= F.col("n_a") + F.col("n_b"))).select("a", "b")
    full = near.join(sets.select(F.col("k").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("s_b")), "b")
    sized = full.select("a", "b", F.size(F.array_intersect("s_a", "s_b")).alias("both"), (F.size("s_a") + F.size("s_b")).alias("sum"))
    return sized.filter("100 * both >= 75 * (sum - both)").select("a", "b")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _joined_links(links: DataFrame, more: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links and their components; nothing is done if there are no more."""
    if not more.limit(1).count():
        discard(more)
        return links, roots
    both = written(links.unionByName(more), "links")
    out = components(both)
    for df in (links, more, roots):
        discard(df)
    return both, out


def _resolved(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, m, keeper): of each row's component the smallest id and the key of the row that has it; both are
    null where the row is alone."""
    sizes = written(shingle_sizes(docs), "sizes")
    stats = sizes.agg(F.sum("n").alias("total"), F.max("n").alias("largest")).first()
    total, largest = stats["total"] or 0, stats["largest"] or 0
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")).alias("first")
    classes = sizes.filter("n > 0").groupBy("k", "c", "n").agg(first, F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "classes")
    lone = _lone_counts(own_columns(docs, "text"), _sampled, 16 + total // (3 * BUCKET))
    chosen = written(classes.filter("n >= 3").join(lone, "k", "left").filter("4 * coalesce(lone, 0) <= n").select("first.key", "k", "c"), "chosen")
    n_chosen = chosen.count()
    sets = written(_sets(docs, F.broadcast(chosen) if n_chosen <= BROADCAST_ROWS else chosen), "sets")
    if sets.count() > n_chosen:  # repeated rows
        once = written(sets.dropDuplicates(["k"]), "sets")
        discard(sets)
        sets = once
    edges = band_edges(largest)
    buckets = 16 + (sets.agg(F.sum("n")).first()[0] or 0) // BUCKET
    lone = _lone_counts(sets.select("k", "s"), _stored, buckets)
    close = written(sets.join(lone, "k", "left").filter("4 * coalesce(lone, 0) <= n").drop("lone"), "sets")
    discard(sets)
    sets = close
    pairs = written(_met_smallest(sets, buckets, edges), "pairs")
    links = written(_verified(pairs, sets), "links")
    roots = components(links)
    rooted = sets.join(_small(roots), F.col("k") == F.col("node"), "left").withColumn("root", F.coalesce("root", "k"))
    across = written(_met_across(rooted, buckets, edges), "across")
    large = across.filter("large is not null").select(F.col("large").alias("key"), F.col("b").alias("bundle"))
    groups = _members(sets, large, edges) if large.limit(1).count() else written(large.select(F.col("key").alias("g"), F.col("key").alias("first"), F.col("bundle").alias("k")), "groups")
    sketched = sets.select("k", "n", "w")
    members = lambda of: _in_blocks(groups).join(sketched, "k").join(_small(of), F.col("k") == F.col("node"), "left").withColumn("root", F.coalesce("root", "k")).drop("node")
    listed = across.filter("large is null").select("a", "b").unionByName(_near_in_blocks(members(roots), nearest=True)).distinct()
    more = written(listed.join(pairs, ["a", "b"], "left_anti"), "pairs")
    linked, roots = _joined_links(links, written(_verified(more, sets), "links"), roots)
    # components have grown; what is still across in large groups is compared in full
    again = members(roots)
    mixed = again.groupBy("pair").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("pair")
    tested = pairs.unionByName(more)
    last = written(_near_in_blocks(again.join(mixed, "pair", "left_semi"), nearest=False).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    linked, roots = _joined_links(linked, written(_verified(last, sets), "links"), roots)
    firsts = classes.select(F.col("k").alias("node"), "c", "first")
    lowest = roots.join(firsts, "node")
    of_root = lowest.groupBy("root").agg(F.min("first").alias("first"))
    of_node = lowest.select("node", "c", "root").join(of_root, "root").select(F.col("node").alias("m_k"), F.col("c").alias("m_c"), "first")
    copied = classes.filter("copies > 1").join(of_node, (F.col("k") == F.col("m_k")) & (F.col("c") == F.col("m_c")), "left_anti").select(F.col("k").alias("m_k"), F.col("c").alias("m_c"), "first")
    mapped = of_node.unionByName(copied).select("m_k", "m_c", F.col("first.doc_id").alias("m"), F.col("first.key").alias("keeper"))
    mapped = written(mapped, "mapped")
    for df in (classes, chosen, sets, pairs, linked, roots, across, groups, more, last):
        discard(df)
    out = sizes.join(_small(mapped), (F.col("k") == F.col("m_k")) & (F.col("c") == F.col("m_c")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "key", "n", "m", "keeper")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id)."""
    return _resolved(docs).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("m", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The row of the smallest id of each component (one of them if it repeats), with the columns of the documents table.
    Rows go by id and text together: other texts of the same id, and rows without id, are judged each for itself. Text
    without a word is in no component and stays."""
    own = own_columns(docs, *DOCUMENT).withColumn("__key", F.xxhash64("doc_id", "text"))
    found = written(_resolved(own).filter("keeper is not null"), "in-components")
    same = lambda other: F.col("__key") == other["key"], lambda other: F.col("doc_id").eqNullSafe(other["g_id"])
    goes = _small(written(found.filter("key <> keeper").select(F.col("doc_id").alias("g_id"), "key").distinct(), "near-copies"))
    kept = own.join(goes, same[0](goes) & same[1](goes), "left_anti")
    again = written(found.filter("key = keeper").groupBy("key").count().filter("count > 1").select("key"), "repeated-rows")
    if again.limit(1).count():
        again = _small(again)
        once = kept.join(again, same[0](again), "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(again, same[0](again), "left_anti").unionByName(once)
    return kept.select(*DOCUMENT)
