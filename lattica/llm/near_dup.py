"""Near-duplicate documents of a given shingle similarity, by wide SimHash fingerprints.

Fingerprints have 64 byte positions.  At similarity 0.8 about fifteen bits in a hundred
differ, so no tally of equal bytes is certain; a pair is a candidate once it shares the
bytes of one of many fixed choices of positions, that is once its tally reaches the size of a
choice.  The size grows with the logarithm of the number of documents, which keeps chance
meetings per document few at any scale, and the number of choices keeps recall at the
threshold (``CHOICES``).

Looks at lists only ask which texts lie near each other (HAMMING): a task answers with a spanning
forest of what its lists connect, however many pairs there are, and texts that are connected form a
neighbourhood.  A first look at few choices compares few pairs per list and finds most of every
neighbourhood; the second goes through the lists of all choices in which several neighbourhoods meet.  The
shingle sets of a neighbourhood then meet in tasks of bounded size, where every pair within HAMMING bits
that is not joined yet is verified exactly, and only links that join something leave the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import common as C
from lattica.llm import graph
from lattica.llm.simhash import normal_words, shingle_hashes, simhash, text_slices

WORDS = 8
"""64-bit words of a fingerprint."""
CHOICES = {3: 256, 4: 1100, 5: 5000}
"""Choices of positions by their size; each size serves up to 2**(8 * size - 2) documents."""
HAMMING = 112
LIST_ROWS = 8192
"""Most members of a list in one piece.  At first look each part of a longer list has a medoid of its own, and these
are linked; at second look any two half-size parts meet."""
BUCKET_POSTINGS = 1 << 20
FIRST = 24
"""Choices of the first look."""
PAIRS = 1 << 18
"""Pairs that are compared at once."""
PART_BYTES = 4 << 20
"""Shingle sets of a part of a neighbourhood; every two parts meet in a task of their own."""


def kid(doc_id: Column) -> Column:
    """The id as a key; null ids share the smallest number."""
    return F.coalesce(doc_id.cast("bigint"), F.lit(-(1 << 63)))


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle of a text once, as the verified similarity has it."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][:len(h)]
    return h[first], doc[first]


def marked(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kid, mark, node, fp): ``node`` names the words of a text with A-Z lowered, ``mark`` its very bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch):
                data, off = C.text_bytes(pa.chunked_array([b.column("text")]))
                raw, s, e, bounds = normal_words(data, off)
                fps = simhash(*_distinct(*shingle_hashes(raw, s, e, bounds, shingle)), b.num_rows, WORDS)
                cut = np.r_[s, len(raw)]
                node = [int.from_bytes(hashlib.blake2b(raw[i:j], digest_size=8).digest(), "little", signed=True) for i, j in zip(cut[bounds[:-1]].tolist(), cut[bounds[1:]].tolist())]
                yield pa.record_batch({"kid": b.column("kid"), "mark": b.column("mark"), "node": pa.array(node, pa.int64()),
                                       "fp": pa.array([x.tobytes() for x in fps], pa.binary())})

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(kid(F.col(id_col)).alias("kid"), F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(
        run, "kid bigint, mark bigint, node bigint, fp binary")


def choices(size: int, count: int, positions: int = 8 * WORDS) -> np.ndarray:
    """Fixed choices of byte positions that use every position about equally often."""
    rng = np.random.default_rng(size)
    flat = np.concatenate([rng.permutation(positions) for _ in range(-(-count * size // positions) + size)])
    out, i = [], 0
    while len(out) < count:
        c = flat[i:i + size]
        i += size
        if len(set(c.tolist())) == size:
            out.append(np.sort(c))
        if i + size > len(flat):
            flat, i = np.concatenate([rng.permutation(positions) for _ in range(count)]), 0
    return np.array(out)


def _postings(size: int, n_buckets: int, some: slice):
    sets = choices(size, CHOICES[size])[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                b = batch.slice(i, 4096)
                fps = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                node = b.column("node").to_numpy()
                apart = b.column("root").to_numpy() ^ node  # zero, and next to no bytes, where nothing is joined
                key = np.zeros((b.num_rows, len(sets)), np.uint64)
                for c in range(size):
                    key = (key << np.uint64(8)) | fps[:, sets[:, c]].astype(np.uint64)
                key |= np.arange(len(sets), dtype=np.uint64)[None, :] << np.uint64(48)
                key = C.mix(key.reshape(-1) + np.uint64(1))
                bucket = C.bucket_of(key, n_buckets)
                order = np.argsort(bucket, kind="stable")  # and by node within a bucket
                short, own = C.short_of(key[order]), order // len(sets)
                rows = [(bucket[order[x]], short[x:y].tobytes(), *_counted(node, apart, own[x:y])) for x, y in zip(*C.runs(bucket[order]))]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))],
                                      names=["bucket", "keys", "nodes", "roots", "counts"])
    return run


def _counted(node: np.ndarray, apart: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Each node once, its root, and how many postings in a row are its own."""
    s, e = C.runs(at)
    return node[at[s]].tobytes(), C.planes(apart[at[s]]), C.planes((e - s).astype(np.uint32))


def _postings_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: the list, node and root of every posting."""
    key = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.uint32).astype(np.uint64)
    key = C.mix(key | (np.uint64(t.column("bucket")[0].as_py()) << np.uint64(32)))
    node = np.frombuffer(b"".join(t.column("nodes").to_pylist()), np.int64)
    root = node ^ np.concatenate([C.from_planes(x, np.int64) for x in t.column("roots").to_pylist()])
    count = np.concatenate([C.from_planes(x, np.uint32) for x in t.column("counts").to_pylist()])
    return key, np.repeat(node, count), np.repeat(root, count)


def _lists(t: pa.Table) -> pa.Table:
    """Of one bucket: the members of every list of two or more, long lists dealt out."""
    key, node, _ = _postings_of(t)
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    s, e = C.runs(key)
    n = np.repeat(e - s, e - s)
    keep = n > 1
    parts = -(-n // LIST_ROWS)
    place = np.arange(len(key)) - np.repeat(s, e - s)
    part = np.where(parts > 1, place % np.maximum(parts, 1), 0).astype(np.uint64)
    lid = np.where(parts > 1, C.mix(key + part * np.uint64(0x9E3779B97F4A7C15)), key)
    # the next part's first member closes the chain of parts
    again = keep & (place < parts) & (parts > 1)
    before = C.mix(key[again] + ((part[again] + parts[again].astype(np.uint64) - np.uint64(1)) % parts[again].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    return pa.table({"lid": pa.array(np.r_[lid[keep], before].view(np.int64)), "node": pa.array(np.r_[node[keep], node[again]])})


def _open_lists(t: pa.Table) -> pa.Table:
    """Of one bucket: the members of every list with two roots or more; of a long list, every two parts but those of one root."""
    key, node, root = _postings_of(t)
    order = np.lexsort((node, root, key))
    key, node, root = key[order], node[order], root[order]
    s, e = C.runs(key)
    open_ = root[s] != root[e - 1]  # sorted by root
    short = open_ & (e - s <= LIST_ROWS)
    keep = np.repeat(short, e - s)
    lids, nodes = [key[keep]], [node[keep]]
    half = max(1, LIST_ROWS // 2)
    for x, y in zip(s[open_ & ~short], e[open_ & ~short]):
        at = np.arange(x, y, half)
        end = np.minimum(at + half, y)
        for i in range(len(at)):
            for j in range(i + 1, len(at)):
                if root[at[i]] == root[end[j] - 1]:
                    continue
                lids.append(np.full(end[i] - at[i] + end[j] - at[j], C.mix(key[x:x + 1] + np.uint64(((i << 32 | j) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))[0]))
                nodes += [node[at[i]:end[i]], node[at[j]:end[j]]]
    return pa.table({"lid": pa.array(np.concatenate(lids).view(np.int64)), "node": pa.array(np.concatenate(nodes))})


def _meet(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members to compare at first look: all with the one nearest the majority, and neighbours in bit order."""
    n = len(fps)
    if n <= 3:
        return np.triu_indices(n, 1)
    bits = np.unpackbits(fps, axis=1)
    centre = bits.sum(axis=0, dtype=np.int64) * 2 > n
    m = int(np.argmin((bits != centre).sum(axis=1)))
    order = np.lexsort(fps.T[::-1])
    return np.r_[np.full(n, m), order[:-1]], np.r_[np.arange(n), order[1:]]


def _near(fps: np.ndarray, root: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that are of unlike roots and within HAMMING bits."""
    apart = root[i] != root[j]
    i, j = i[apart], j[apart]
    near = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1) <= HAMMING
    return i[near], j[near]


def _some(node: np.ndarray, fps: np.ndarray, root: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The near pairs of first look in the lists s[k]..e[k]."""
    two = s[e - s == 2]
    i, j = [two], [two + 1]
    for x, y in zip(s[e - s > 2], e[e - s > 2]):
        p, q = _meet(fps[x:y].view(np.uint8))
        i.append(p + x)
        j.append(q + x)
    i, j = _near(fps, root, np.concatenate(i), np.concatenate(j))
    return node[i], node[j]


def _stars(node: np.ndarray, fps: np.ndarray, root: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the lists s[k]..e[k] the roots that are near by way of members, each with the least of those it is connected with."""
    two = s[e - s == 2]
    i, j = _near(fps, root, two, two + 1)
    a, b = [np.minimum(root[i], root[j])], [np.maximum(root[i], root[j])]
    for x, y in zip(s[e - s > 2], e[e - s > 2]):
        names, at = np.unique(root[x:y], return_inverse=True)
        for group in _connected(fps[x:y], at, len(names)):
            a.append(np.full(len(group) - 1, names[group[0]]))
            b.append(names[group[1:]])
    return np.concatenate(a), np.concatenate(b)


def _connected(fps: np.ndarray, at: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sets of two or more of the roots 0..n-1 (``at``: of each member) that near members connect.

    What is connected is not compared again, so a group of near copies takes a few passes over its members.
    """
    free = np.ones(n, bool)
    for first in range(n):
        if not free[first]:
            continue
        free[first] = False
        group, turn = [np.array([first])], np.flatnonzero(at == first)
        while len(turn):
            rest = np.flatnonzero(free[at])
            if not len(rest):
                break
            some, turn = turn[:max(1, min(64, PAIRS // len(rest)))], turn[max(1, min(64, PAIRS // len(rest))):]
            near = (np.bitwise_count(fps[some][:, None] ^ fps[rest][None]).sum(axis=2) <= HAMMING).any(axis=0)
            if near.any():
                new = np.unique(at[rest[near]])
                free[new] = False
                group.append(new)
                turn = np.r_[turn, rest[np.isin(at[rest], new)]]
        if len(group) > 1:
            yield np.sort(np.concatenate(group))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What these links connect, as links from the least of each component to all others of it."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (label[x], label[y], x, y):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(names)))
    return names[label[rest]], names[rest]


def _candidates(links, forest: bool = False):
    """What ``links`` finds in whole lists; with ``forest`` only a spanning forest of all that a task's lists connect."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pair in found(batches):
            if forest:
                known = _forest(np.r_[known[0], pair[0]], np.r_[known[1], pair[1]])
            else:
                yield pa.record_batch({"a": pa.array(pair[0]), "b": pa.array(pair[1])})
        if len(known[0]):
            yield pa.record_batch({"a": pa.array(known[0]), "b": pa.array(known[1])})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Rows (lid, node, fp, root) come sorted by list; yields what ``links`` finds in whole lists."""
        held: tuple | None = None
        for b in chain(batches, [None]):
            if b is None:
                if held is None:
                    return
                lid, node, fps, root = held
                stop = len(lid)
            else:
                if not b.num_rows:
                    continue
                new = (b.column("lid").to_numpy(), b.column("node").to_numpy(), np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint64).reshape(b.num_rows, -1),
                       b.column("root").to_numpy())
                lid, node, fps, root = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
                stop = int(np.searchsorted(lid, lid[-1]))  # the last list may go on
                held = lid[stop:], node[stop:], fps[stop:], root[stop:]
            a, b = links(node, fps, root, *C.runs(lid[:stop]))
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            if pair.size:
                yield pair
    return run


def _joined(similarity: float):
    """Links (a, b) of similar members of a neighbourhood, or between two parts of one, that join something."""
    def links_of(node: np.ndarray, side: np.ndarray, fps: np.ndarray, item: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        if len(node) < 2:
            return
        group, apart = np.arange(len(node)), len(np.unique(side)) > 1
        mark = np.zeros(int(item.max(initial=0)) + 1, bool)
        step = max(1, PAIRS // len(node))
        for lo in range(0, len(node), step):
            near = np.bitwise_count(fps[lo:lo + step, None] ^ fps[None, lo:]).sum(axis=2) <= HAMMING
            for i in range(lo, min(lo + step, len(node))):
                j = lo + np.flatnonzero(near[i - lo])
                fit = (j > i) & (group[j] != group[i]) & (np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]) - 1e-6)
                j = j[fit & (side[j] != side[i])] if apart else j[fit]
                if not len(j):
                    continue
                mine = item[begin[i]:begin[i + 1]]
                mark[mine] = True
                cut = np.r_[0, np.cumsum(sizes[j])]
                at = np.repeat(begin[j] - cut[:-1], sizes[j]) + np.arange(cut[-1])
                common = np.diff(np.r_[0, np.cumsum(mark[item[at]])][cut])
                mark[mine] = False
                for k in j[common / np.maximum(1, sizes[i] + sizes[j] - common) >= similarity]:
                    if group[k] != group[i]:
                        yield node[i], node[k]
                        group[group == group[k]] = group[i]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("hood").combine_chunks()
        node, side, hood = (t.column(c).to_numpy() for c in ("node", "part", "hood"))
        fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(t.num_rows, -1)
        sets = t.column("s").chunk(0)
        sizes = sets.value_lengths().to_numpy().astype(np.int64)
        begin = np.r_[0, np.cumsum(sizes)]
        flat, links = sets.flatten().to_numpy(), []
        for x, y in zip(*C.runs(hood)):
            own = np.unique(flat[begin[x]:begin[y]], return_inverse=True)[1]
            links += links_of(node[x:y], side[x:y], fps[x:y], own, begin[x:y + 1] - begin[x], sizes[x:y])
        return pa.table([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])
    return run


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch):
                data, off = C.text_bytes(pa.chunked_array([b.column("text")]))
                h, doc = shingle_hashes(*normal_words(data, off), shingle)
                cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
                sets = [np.unique(h[i:j]).view(np.int64) for i, j in zip(cut, cut[1:])]
                yield pa.record_batch({"node": b.column("node"), "s": pa.array(sets, pa.list_(pa.int64()))})
    return run


def neighbourhoods(nodes: DataFrame) -> DataFrame:
    """The rows (node, fp, ...) with ``hood``: equal for those that near ones connect."""
    n = nodes.count()
    size = next((k for k in CHOICES if n <= 1 << (8 * k - 2)), max(CHOICES))

    def looked(rooted: DataFrame, some: slice, lists_of, links) -> DataFrame:
        n_buckets = max(1, n * len(range(CHOICES[size])[some]) // BUCKET_POSTINGS)
        posted = rooted.select("node", "fp", "root").mapInArrow(_postings(size, n_buckets, some), "bucket int, keys binary, nodes binary, roots binary, counts binary")
        lists = posted.groupBy("bucket").applyInArrow(lists_of, "lid bigint, node bigint")
        met = lists.join(rooted.select("node", "fp", "root"), "node").repartition("lid").sortWithinPartitions("lid", "node").select("lid", "node", "fp", "root")
        return C.settle(met.mapInArrow(_candidates(links, forest=True), "a bigint, b bigint").distinct())

    first = C.settle(graph.components(looked(nodes.withColumn("root", F.col("node")), slice(0, FIRST), _lists, _some)))
    rooted = C.settle(nodes.join(first.withColumnRenamed("a", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")))
    both = graph.components(looked(rooted, slice(None), _open_lists, _stars)).select(F.col("a").alias("root"), F.col("root").alias("hood"))
    return rooted.join(both, "root", "left").withColumn("hood", F.coalesce("hood", "root")).drop("root")


def similar_nodes(docs: DataFrame, rows: DataFrame, similarity: float, shingle: int, text_col: str = "text") -> DataFrame:
    """(a, b): verified links between different word sequences of ``rows = marked(docs)``.

    They connect all that similar pairs which share a list of some choice, or lie in one neighbourhood, connect.
    """
    nodes = C.settle(rows.groupBy("node").agg(F.any_value("fp").alias("fp"), F.min("mark").alias("mark")))
    around = C.settle(neighbourhoods(nodes))
    several = around.groupBy("hood").agg(F.count("*").alias("n")).where("n > 1").select("hood")
    members = C.settle(around.join(several, "hood"))
    texts = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = texts.join(members.select("node", "mark"), "mark").dropDuplicates(["node"]).select("node", "text").mapInArrow(
        _shingle_sets(shingle), "node bigint, s array<bigint>")
    whole = C.settle(members.join(sets, "node").select("node", "hood", "fp", "s"))
    size = (F.size("s") + 8) * 8
    parts = whole.groupBy("hood").agg(F.ceil(F.sum(size) / PART_BYTES).cast("int").alias("parts"))
    # small neighbourhoods share a task call, a large one has a call for every two parts
    bundles = max(1, -(-int(whole.agg(F.sum(size)).first()[0] or 0) // PART_BYTES))
    dealt = whole.join(parts, "hood").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = dealt.select("node", "hood", "fp", "s", "part", (F.col("parts") > 1).alias("large"), F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
                        F.when(F.col("parts") > 1, F.col("hood")).otherwise(F.pmod(F.xxhash64("hood"), F.lit(bundles))).alias("call"))
    return held.groupBy("large", "call", "lo", "hi").applyInArrow(_joined(similarity), "a bigint, b bigint")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group linked by similarity, one stays.

    Words are compared with A-Z lowered; texts without words are all alike.  The row with the smallest id
    stays, one without an id only where none has one, and of equal rows just one.
    """
    rows = C.settle(marked(docs, shingle, id_col, text_col))
    roots = graph.components(similar_nodes(docs, rows, similarity, shingle, text_col).select("a", "b"))
    grouped = rows.join(roots.withColumnRenamed("a", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = grouped.groupBy("root").agg(F.min(F.struct((F.col("kid") == -(1 << 63)).alias("none"), "kid", "mark")).alias("w"))
    stay = best.select(F.col("w.kid").alias("__kid"), F.col("w.mark").alias("__mark"))
    keyed = docs.withColumns({"__k": kid(F.col(id_col)), "__m": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    kept = keyed.join(stay, (F.col("__k") == F.col("__kid")) & (F.col("__m") == F.col("__mark")))
    first = F.row_number().over(Window.partitionBy("__k", "__m").orderBy(F.lit(0)))
    return kept.withColumn("__n", first).where("__n = 1").select(*docs.columns)
