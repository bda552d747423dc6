"""Operator 7, n-gram Jaccard join with signature trees: exact links and components.

Method. Documents with equal shingle sets form one class. A signature tree is built over the
classes: its nodes hold the OR of the token bitmaps below them and the range of set sizes. Two
trees are traversed together, and a pair of nodes is pruned when its maximum possible overlap

    popcount(or_p & or_q) + min(spare_p, spare_q)

is below what the threshold asks of the smallest sizes below the nodes (`spare`: tokens of a set
beyond its distinct bits). Pairs of classes that are left are compared exactly. A node pair
whose classes are all in one component already is skipped, so that a group of n near copies
costs about n comparisons; only a spanning forest of the links leaves the traversal.

The top of the forest is distributed. Similar sets (100 * overlap >= t * union) of at most b
tokens differ in at most d = 2b(100-t)/(100+t) tokens. The range of token hashes is cut into
k = d + 1 + m parts, so that at least m + 1 parts agree; the m weakest parts of a set (fewest
tokens) are not used, and the strongest agreeing part is still used by both sets. Sets that
share no used part at all have too little possible overlap and are pruned by this argument:
nothing is lost. Sets that share a part, and whose sizes allow a link, are chained; the
components of the chains are cells, and each cell is searched by its own trees. A cell of more
than BLOCK_TOKENS tokens is first searched by trees of bit maps alone; what their bounds leave
connected are finer cells. A cell that is still large is cut by size range and hash into blocks,
and each pair of blocks that may hold links is a task of its own, so that no task holds more
than two blocks.

Sizes fall into levels with a ratio of 1.5; a set uses its own level and, if a larger partner
may be in the next one, that level too.

Defined results: a text without words, or null, has an empty set, is linked with nothing, and
is its own component; fewer words than the width make one shingle; repeated rows and equal
doc_ids are rows of their own; a null doc_id takes part in links, and the smallest non-null
doc_id names the component (null if there is none); an empty table gives no rows; extra
columns are ignored. Shingles and classes are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, free_prefix, materialise, maybe_in, release, remove, stored, table_partitions, text_chunks, tune
from .textops import LOWER, NON_SPACE, Words, buffers, mix, prefix, powers, ragged, rows_of, window_hashes

WIDTH = 4
PERCENT = 85
RATIO = 1.5
BLOCK_TOKENS = 1 << 20
_SET = "cell long, cid long, n int, total long, content binary"
FAN = 16
#: Classes of a partition whose keys are remembered as given.
SEEN = 1 << 18
#: One text in so many is looked at for tokens that many sets have; bits of their map.
SAMPLE = 32
MAP_BITS = 1 << 25
_NONE = np.zeros(0, np.int64)


# --- shingle sets ---------------------------------------------------------------------------


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their offsets."""
    data, offsets = buffers(column)
    data = LOWER[data]
    words = Words(data, offsets, NON_SPACE)
    hashes = words.hashes(data)
    at, values = window_hashes(hashes, words.offsets, width)
    row = rows_of(words.counts)[at]
    few = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(few):  # the whole sequence as one shingle, kept apart by its length
        up, down = powers(len(hashes) + 1)
        sums = prefix(hashes * up[:-1])
        begin, end = words.offsets[few], words.offsets[few + 1]
        whole = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        row, values = np.concatenate([row, few]), np.concatenate([values, whole])
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    row, values = row[keep], values[keep]
    return values, np.searchsorted(row, np.arange(len(column) + 1))


def class_ids(values: np.ndarray, offsets: np.ndarray, shared: np.ndarray = _NONE) -> tuple[np.ndarray, np.ndarray]:
    """(names, checks): a 64-bit name of each set, and a second one that tells sets of one name apart.

    Sets whose name is in `shared` (sorted; names that different sets have) get one made of both.
    """
    sizes = np.diff(offsets).astype(np.uint64)
    names = mix(np.diff(prefix(mix(values ^ np.uint64(0xA0761D6478BD642F)))[offsets]) + sizes).view(np.int64)
    checks = mix(np.diff(prefix(mix(values ^ np.uint64(0x8EBC6AF09C88C6E3)))[offsets]) ^ sizes).view(np.int64)
    if len(shared):
        both = mix(names.view(np.uint64) * np.uint64(0x589965CC75374CC3) + checks.view(np.uint64) + np.uint64(0x1D8E4E27C47D124F)).view(np.int64)
        names = np.where(np.isin(names, shared), both, names)
    return names, checks


# --- routing by parts -----------------------------------------------------------------------


def least_linked(percent: int) -> int:
    """Smallest size of a set that may be linked with a different set."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


class Levels:
    """Size levels, and for each the allowed difference d, the slack m and the parts k."""

    def __init__(self, percent: int, largest: int):
        bounds = [least_linked(percent)]
        while bounds[-1] <= largest:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * RATIO)))
        self.percent = percent
        self.bounds = np.array(bounds, np.int64)
        self.differ = (2 * (self.bounds[1:] - 1) * (100 - percent)) // (100 + percent)
        self.slack = np.maximum(2, self.differ // 5)
        self.parts = self.differ + 1 + self.slack

    def level(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, sizes, "right") - 1


def part_keys(values: np.ndarray, offsets: np.ndarray, percent: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets): the keys of the used parts of each set, in its one or two levels.

    common: a bit map of tokens that many sets have (see common_tokens); which they are changes only what parts are used.
    """
    sizes = np.diff(offsets)
    levels = Levels(percent, int(sizes.max(initial=1) * 100 // percent) + 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    own = levels.level(sizes)
    upper = levels.level(sizes * 100 // percent)
    for chosen, level in ((np.flatnonzero(own >= 0), own), (np.flatnonzero((upper > own) & (upper >= 0)), upper)):
        if len(chosen):
            keys, row = _level_keys(values, offsets, chosen, level[chosen], levels, common)
            found.append((keys, row))
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(sizes) + 1, np.int64)
    keys, row = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(row, kind="stable")
    return keys[order].view(np.int64), np.searchsorted(row[order], np.arange(len(sizes) + 1))


def _level_keys(values, offsets, chosen, level, levels, common):
    sizes = np.diff(offsets)[chosen]
    tokens = values[ragged(offsets[:-1][chosen], sizes)]
    parts = levels.parts[level]
    base = np.concatenate([[0], np.cumsum(parts)])
    of = np.repeat(np.arange(len(chosen)), sizes)
    slot = base[of] + (((tokens >> np.uint64(32)) * parts.astype(np.uint64)[of]) >> np.uint64(32)).astype(np.int64)
    # tokens are sorted in each set, and so slots are sorted
    edges = np.searchsorted(slot, np.arange(base[-1] + 1))
    count = np.diff(edges)
    total = np.diff(prefix(mix(tokens ^ np.uint64(0xE7037ED1A0B428DB)))[edges])
    owner = rows_of(parts)
    part = np.arange(base[-1]) - base[owner]
    # a part's strength follows from its content alone, so that two sets agree on it
    rare = np.diff(prefix((~in_map(common, tokens)).astype(np.int64))[edges]) if common is not None else count
    order = np.lexsort((part, -count, -rare, owner))
    rank = np.arange(base[-1]) - base[owner]  # place among the set's parts, strongest first
    used = order[rank < (levels.differ[level] + 1)[owner]]
    salt = part[used].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (level[owner[used]].astype(np.uint64) << np.uint64(48))
    return mix(total[used] + mix(salt + count[used].astype(np.uint64))), chosen[owner[used]]


def in_map(bitmap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Which tokens the bit map of common_tokens holds."""
    at = ((tokens >> np.uint64(7)) & np.uint64(MAP_BITS - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _sampled(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches):
        values, offsets = shingle_sets(batch.column("text"), width)
        names = class_ids(values, offsets)[0]
        yield pa.RecordBatch.from_pydict({"cid": pa.array(np.repeat(names, np.diff(offsets))), "token": pa.array(values.view(np.int64))})


def common_tokens(source: DataFrame, width: int) -> np.ndarray:
    """A bit map (4 MB) of the tokens that at least two classes of one text in SAMPLE hold, and few others.

    Passages that many documents share would chain documents that have little else in common. The map only orders the
    parts of a set by strength; any map gives the same links.
    """
    sample = source.filter((F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 7) & F.col("text").isNotNull()).select("text")
    tokens = sample.mapInArrow(lambda batches: _sampled(batches, width), "cid long, token long").groupBy("token").agg(F.min("cid").alias("low"), F.max("cid").alias("high"))
    place = F.shiftrightunsigned("token", 7).bitwiseAND(F.lit(MAP_BITS - 1).cast("long"))
    places = tokens.filter("low < high").select(place.alias("p"))
    parts = places.groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767).cast("long"))).alias("map"))
    table = np.zeros(MAP_BITS // 8, np.uint8)
    for row in parts.collect():
        table[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(bytes(row.map), np.uint8)
    return table


def _inform(batches: Iterator[pa.RecordBatch], width: int, percent: int, shared: np.ndarray, common: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in text_chunks(batches):
        values, offsets = shingle_sets(batch.column("text"), width)
        (names, checks), sizes = class_ids(values, offsets, shared), np.diff(offsets)
        keys, key_offsets = part_keys(values, offsets, percent, common)
        # a class gives its keys once a partition, or again when more classes have been seen than are held
        first = np.zeros(len(names), bool)
        for i, name in enumerate(names.tolist()):
            if name not in seen and key_offsets[i + 1] > key_offsets[i]:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                first[i] = True
        counts = np.where(first, np.diff(key_offsets), 0)
        keys = keys[ragged(key_offsets[:-1], counts)]
        lists = pa.ListArray.from_arrays(pa.array(prefix(counts), pa.int32()), pa.array(keys, pa.int64()))
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"),
            "uid": batch.column("uid"),
            "n_shingles": pa.array(sizes, pa.int64()),
            "cid": pa.array(names, mask=sizes == 0),
            "chk": pa.array(checks),
            "keys": lists,
        })


def _chain(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, size and class: links neighbours of a key whose sizes allow a link."""
    tail = None
    for batch in batches:
        key, n, cid = (batch.column(c).to_numpy() for c in ("key", "n", "cid"))
        if tail is not None:
            key, n, cid = (np.concatenate([[t], x]) for t, x in zip(tail, (key, n, cid), strict=True))
        if not len(key):
            continue
        tail = (key[-1], n[-1], cid[-1])
        near = (key[1:] == key[:-1]) & (cid[1:] != cid[:-1]) & (100 * n[:-1] >= percent * n[1:])
        a, b = cid[:-1][near], cid[1:][near]
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


# --- signature trees ------------------------------------------------------------------------


class Forest:
    """Union-find over the classes of a unit."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], np.int64)


def bitmaps(values: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """One row of bits a set; bits is a power of two."""
    sizes = np.diff(offsets)
    maps = np.zeros((len(sizes), bits // 64), np.uint64)
    slots = (values >> np.uint64(7)) % np.uint64(bits)
    np.bitwise_or.at(maps, (rows_of(sizes), (slots >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (slots & np.uint64(63)))
    return maps


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bit map of the same set with fewer bits."""
    while len(bitmap) > words:
        bitmap = bitmap[: len(bitmap) // 2] | bitmap[len(bitmap) // 2 :]
    return bitmap


class SignatureTree:
    """Levels of nodes over sets; level 0 are the sets in tree order."""

    def __init__(self, members: np.ndarray, sizes: np.ndarray, maps: np.ndarray):
        sizes, maps = sizes[members], maps[members]
        # sets of like size and equal first bits stand together
        order = np.lexsort((maps[:, 0], (np.log(np.maximum(sizes, 1)) / np.log(100 / PERCENT)).astype(np.int64)))
        self.members, sizes, maps = members[order], sizes[order], maps[order]
        spare = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, spare)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, spare = self.levels[-1]
            cuts = np.arange(0, len(maps), FAN)
            self.levels.append((
                np.bitwise_or.reduceat(maps, cuts, axis=0),
                np.minimum.reduceat(low, cuts),
                np.maximum.reduceat(high, cuts),
                np.maximum.reduceat(spare, cuts),
            ))


def _possible(p, i, q, j, percent: int) -> np.ndarray:
    """Which node pairs may hold a link: sizes, then the maximum possible overlap."""
    maps, low, high, spare = p
    maps2, low2, high2, spare2 = q
    keep = (100 * high[i] >= percent * low2[j]) & (100 * high2[j] >= percent * low[i])
    at = np.flatnonzero(keep)
    a, b = i[at], j[at]
    overlap = np.zeros(len(at), np.int64)
    step = max(1, (1 << 21) // maps.shape[1])
    for s in range(0, len(at), step):
        e = s + step
        overlap[s:e] = np.bitwise_count(maps[a[s:e]] & maps2[b[s:e]]).sum(axis=1)
    most = np.minimum(overlap + np.minimum(spare[a], spare2[b]), np.minimum(high[a], high2[b]))
    keep[at] = most * (100 + percent) >= percent * (low[a] + low2[b])
    return keep


def _children(k: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    first = k * FAN
    return first, np.minimum(first + FAN, n) - first


def traverse(left: SignatureTree, right: SignatureTree, percent: int, linked: Callable[[int, int], bool], forest: Forest, links: list[tuple[int, int]]) -> None:
    """Dual traversal; adds to links those that join two components of the forest.

    linked says of two sets that no bound has parted whether they are linked.
    """
    own = left is right
    while len(left.levels) < len(right.levels):
        left.levels.append(left.levels[-1])
    while len(right.levels) < len(left.levels):
        right.levels.append(right.levels[-1])
    top = len(left.levels) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        keep = _possible(left.levels[level], i, right.levels[level], j, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level == 0:
            a, b = left.members[i], right.members[j]
            if own:
                inside = i < j
                a, b = a[inside], b[inside]
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                s, t = forest.find(x), forest.find(y)
                if s != t and linked(x, y):
                    forest.parent[max(s, t)] = min(s, t)
                    links.append((x, y))
            continue
        below, below2 = len(left.levels[level - 1][0]), len(right.levels[level - 1][0])
        if level == 1:
            # one component below both nodes: nothing to add
            roots = forest.roots()
            pure, pure2 = _pure(roots[left.members], below), _pure(roots[right.members], below2)
            skip = (pure[i] >= 0) & (pure[i] == pure2[j])
            i, j = i[~skip], j[~skip]
        order = np.argsort(np.abs(i - j), kind="stable")[::-1]  # the last are taken first: near nodes
        i, j = i[order], j[order]
        step = 64 if level == 1 else 256
        same = level and left.levels[level - 1][0] is left.levels[level][0]
        same2 = level and right.levels[level - 1][0] is right.levels[level][0]
        for s in range(0, len(i), step):
            p, q = i[s : s + step], j[s : s + step]
            first, n = (p, np.ones(len(p), np.int64)) if same else _children(p, below)
            first2, n2 = (q, np.ones(len(q), np.int64)) if same2 else _children(q, below2)
            pair = n * n2
            of = rows_of(pair)
            inner = ragged(np.zeros(len(pair), np.int64), pair)
            c, d = first[of] + inner // n2[of], first2[of] + inner % n2[of]
            if own:
                upper = c <= d
                c, d = c[upper], d[upper]
            stack.append((level - 1, c, d))


def _pure(roots: np.ndarray, n: int) -> np.ndarray:
    """The component of all sets below each level-1 node, or -1 if there are several."""
    cuts = np.arange(0, n, FAN)
    low, high = np.minimum.reduceat(roots, cuts), np.maximum.reduceat(roots, cuts)
    return np.where(low == high, low, -1)


def unit_links(sides: np.ndarray, sizes: np.ndarray, maps: np.ndarray, percent: int, linked: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """A spanning forest of the links of a unit: within side 0, or between sides 0 and 1."""
    forest, links = Forest(len(sides)), []
    one, two = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    if not len(one):
        return links  # a pair of blocks of which one is empty
    left = SignatureTree(one, sizes, maps)
    if len(two):
        traverse(left, SignatureTree(two, sizes, maps), percent, linked, forest, links)
    elif len(one) > 1:
        traverse(left, left, percent, linked, forest, links)
    return links


def _sets(batches: Iterator[pa.RecordBatch], width: int, shared: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches):
        values, offsets = shingle_sets(batch.column("text"), width)
        same = class_ids(values, offsets, shared)[0] == batch.column("cid").to_numpy()
        raw = values.view(np.uint8).data
        sets = [raw[8 * a : 8 * b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        out = {c: batch.column(c) for c in ("cell", "cid", "n", "total")} | {"content": pa.array(sets, pa.binary())}
        yield pa.RecordBatch.from_pydict(out).filter(pa.array(same))


def _search(batches: Iterator[pa.RecordBatch], percent: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit (cell, one, two): one tree search a unit, over token sets or bit maps."""
    held: list[tuple] = []
    name = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("cell", "one", "two", "side", "cid", "n", "content")]
        found: list[tuple[int, int]] = []
        for cell, one, two, side, cid, n, content in zip(*columns, strict=True):
            if (cell, one, two) != name:
                found += _unit(held, percent, exact)
                held, name = [], (cell, one, two)
            held.append((side, cid, n, content))
        yield _edges(found)
    yield _edges(_unit(held, percent, exact))


def _unit(held: list[tuple], percent: int, exact: bool) -> list[tuple[int, int]]:
    rows = list({(side, cid): (n, content) for side, cid, n, content in held}.items())
    if len(rows) < 2:
        return []
    sides, sizes = np.array([k[0] for k, _ in rows]), np.array([v[0] for _, v in rows], np.int64)
    parts = [np.frombuffer(v[1], np.uint64) for _, v in rows]
    if exact:
        values, offsets = np.concatenate(parts), prefix(sizes)
        maps = bitmaps(values, offsets, 1 << min(14, max(9, int(2 * sizes.max() - 1).bit_length())))

        def linked(x: int, y: int) -> bool:
            shared = np.intersect1d(values[offsets[x] : offsets[x + 1]], values[offsets[y] : offsets[y + 1]], assume_unique=True).size
            return 100 * shared >= percent * (sizes[x] + sizes[y] - shared)

    else:
        words = min(map(len, parts))
        maps = np.stack([folded(p, words) for p in parts])

        def linked(x: int, y: int) -> bool:
            return True  # the bound of the maps is all there is here

    links = unit_links(sides, sizes, maps, percent, linked)
    return [(rows[x][0][1], rows[y][0][1]) for x, y in links]


def _map_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token sets to bit maps of about four bits a token."""
    for batch in batches:
        out = []
        for raw in batch.column("content").to_pylist():
            values = np.frombuffer(raw, np.uint64)
            bits = 1 << min(17, max(6, int(4 * len(values) - 1).bit_length()))
            out.append(bitmaps(values, np.array([0, len(values)]), bits).tobytes())
        columns = {c: batch.column(c) for c in ("cell", "cid", "n", "total")} | {"content": pa.array(out, pa.binary())}
        yield pa.RecordBatch.from_pydict(columns)


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([max(p) for p in found], pa.int64()), "b": pa.array([min(p) for p in found], pa.int64())})


# --- the distributed join -------------------------------------------------------------------


def _units(sets: DataFrame, percent: int, block_tokens: int) -> DataFrame:
    """Cells as units (cell, one, two, side); large cells as pairs of blocks by size and hash."""
    bucket = F.floor(F.log(F.col("n")) / F.lit(float(np.log(100 / percent)))).cast("int")
    small = sets.filter(F.col("total") <= block_tokens).select(
        "cell", F.lit(-1).alias("one"), F.lit(-1).alias("two"), F.lit(0).alias("side"), "cid", "n", "content"
    )
    large = sets.filter(F.col("total") > block_tokens).withColumn("bucket", bucket)
    counts = large.groupBy("cell", "bucket").agg(F.ceil(F.sum("n") / block_tokens).cast("int").alias("blocks"))
    # how many blocks the neighbouring size ranges have
    around = counts.select("cell", (F.col("bucket") + 1).alias("bucket"), F.col("blocks").alias("below")).join(
        counts.select("cell", (F.col("bucket") - 1).alias("bucket"), F.col("blocks").alias("above")), ["cell", "bucket"], "full"
    )
    counts = counts.join(around, ["cell", "bucket"], "left")
    placed = large.join(counts, ["cell", "bucket"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    name = lambda bucket, block: bucket.cast("int") * (1 << 20) + block
    own = name(F.col("bucket"), F.col("block"))

    def pairs(count: str, shift: int):
        other = F.transform(F.sequence(F.lit(0), F.coalesce(F.col(count), F.lit(0)) - 1), lambda k: name(F.col("bucket") + shift, k))
        other = F.when(F.coalesce(F.col(count), F.lit(0)) > 0, other).otherwise(F.array().cast("array<int>"))
        return F.transform(other, lambda k: F.struct(F.least(own, k).alias("one"), F.greatest(own, k).alias("two"), (own > k).cast("int").alias("side")))

    units = F.concat(pairs("below", -1), pairs("blocks", 0), pairs("above", 1))
    large = placed.select("cell", F.explode(units).alias("u"), "cid", "n", "content").select("cell", "u.one", "u.two", "u.side", "cid", "n", "content")
    return small.unionByName(large)


def _uid():
    """Names a row by its doc_id and text; repeated rows share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, shared: np.ndarray = _NONE) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, uid, n_shingles, cid; links: a spanning forest of the links of classes).

    shared: names that different sets have. They are looked for among all classes; if there are any beyond the given
    ones, the join begins anew with these sets named apart.
    """
    spark = tune(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _uid().alias("uid"), "text")

    common = spark.sparkContext.broadcast(common_tokens(source, width))

    def inform(batches):
        return _inform(batches, width, percent, shared, common.value)

    info, info_path = stored(source.mapInArrow(inform, "doc_id long, uid long, n_shingles long, cid long, chk long, keys array<long>"), "sets")
    named = info.filter("cid is not null").groupBy("cid").agg(F.min("chk").alias("low"), F.max("chk").alias("high"))
    doubled = [r.cid for r in named.filter("low < high").select("cid").collect()]  # of 10^10 sets, about three names
    if doubled:
        remove(spark, info_path)
        return classes(docs, width, percent, np.unique(np.concatenate([shared, np.array(doubled, np.int64)])))
    entries = info.filter(F.size("keys") > 0).select(F.explode("keys").alias("key"), F.col("n_shingles").cast("int").alias("n"), "cid")

    def chain(batches):
        return _chain(batches, percent)

    ordered = entries.repartition(table_partitions(spark), "key").sortWithinPartitions("key", "n", "cid")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    edges, edges_path = stored(ordered.mapInArrow(chain, "a long, b long").distinct(), "chains")
    tune(spark)
    rows = materialise(info.drop("keys", "chk"), "rows")
    remove(spark, info_path)  # the keys are the largest table of the join
    del info, entries, ordered
    release(spark)
    cells, cells_path = stored(connected_components(edges).select(F.col("node").alias("cid"), F.col("root").alias("cell")), "cells")
    remove(spark, edges_path)

    chosen = rows.filter("cid is not null").groupBy("cid").agg(F.min("uid").alias("uid"), F.max("n_shingles").cast("int").alias("n"))
    chosen = chosen.join(cells, "cid")
    totals = chosen.groupBy("cell").agg(F.sum("n").alias("total"))
    chosen, chosen_path = stored(chosen.join(totals, "cell"), "chosen")
    remove(spark, cells_path)

    def fetch(batches):
        return _sets(batches, width, shared)

    # only texts that may be chosen are shuffled
    asked = source.select("uid", "text").filter(maybe_in(chosen.select("uid"), "uid"))
    texts = asked.join(chosen.hint("shuffle_hash"), "uid").select("cell", "cid", "n", "total", "text")
    sets, sets_path = stored(texts.mapInArrow(fetch, _SET), "cellsets")
    remove(spark, chosen_path)

    def search(sets: DataFrame, exact: bool, block_tokens: int) -> DataFrame:
        units = _units(sets, percent, block_tokens).repartition(table_partitions(spark), "cell", "one", "two").sortWithinPartitions("cell", "one", "two")
        return units.mapInArrow(lambda batches: _search(batches, percent, exact), "a long, b long")

    # large cells are first searched by bit maps alone, a sixteenth of the sets' bytes: what the maps
    # leave connected are the cells whose sets are compared
    small, large = sets.filter(F.col("total") <= BLOCK_TOKENS), sets.filter(F.col("total") > BLOCK_TOKENS)
    if not large.isEmpty():
        tune(spark)
        maps = large.mapInArrow(_map_sets, _SET)
        likely, likely_path = stored(search(maps, False, 2 * BLOCK_TOKENS).distinct(), "likely")
        finer = connected_components(likely).select(F.col("node").alias("cid"), F.col("root").alias("cell"))
        again = large.drop("cell", "total").join(finer, "cid")
        large, large_path = stored(again.join(again.groupBy("cell").agg(F.sum("n").alias("total")), "cell").select("cell", "cid", "n", "total", "content"), "finercells")
        remove(spark, likely_path)
        small = small.unionByName(large)
    links = materialise(search(small, True, BLOCK_TOKENS), "links")
    remove(spark, sets_path)
    release(spark)
    return rows, links


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, shared: np.ndarray = _NONE) -> DataFrame:
    """One row per document: doc_id, uid, n_shingles, component_id, n_class (rows of the set)."""
    rows, links = classes(docs, width, percent, shared)
    roots = connected_components(links).select(F.col("node").alias("cid"), "root")
    # the smallest doc_id names a component; null comes last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "uid"))
    named = rows.filter("cid is not null").groupBy("cid").agg(first.alias("first"))
    named = named.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    of_class = named.join(least, "root").select("cid", F.col("least.doc_id").alias("component_id"), F.col("least.uid").alias("component_uid"))
    joined = rows.join(of_class, "cid", "left")
    empty = F.col("cid").isNull()
    return joined.select(
        "doc_id",
        "uid",
        "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, F.col("uid")).otherwise(F.col("component_uid")).alias("component_uid"),
    )


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that remain when one document of each component stays: its smallest."""
    names = docs.columns
    p = free_prefix("_jc_", names)
    found = materialise(components(docs.select("doc_id", "text"), width, percent), "components")
    # the few rows that may have to go are looked at by a join; all others stay where they are
    same = (F.col("uid") == F.col("component_uid")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    many = found.groupBy("uid", "doc_id").agg(F.count("*").alias("n"), F.max("n_shingles").alias("size"), F.min(same).alias("stays"))
    suspects = many.filter("not stays or (n > 1 and size > 0)").select(F.col("uid").alias(f"{p}uid"), F.col("doc_id").alias(f"{p}id"), F.col("stays").alias(f"{p}stays"))
    suspects = materialise(suspects, "suspects")
    keyed = docs.withColumn(f"{p}uid", _uid()).withColumn(f"{p}maybe", maybe_in(suspects, f"{p}uid"))
    asked = keyed.filter(f"{p}maybe").withColumn(f"{p}key", F.col("doc_id").cast("long")).withColumnRenamed(f"{p}uid", f"{p}own")
    on = (F.col(f"{p}own") == F.col(f"{p}uid")) & F.col(f"{p}key").eqNullSafe(F.col(f"{p}id"))
    asked = asked.join(suspects.hint("shuffle_hash"), on, "left")
    innocent = asked.filter(F.col(f"{p}stays").isNull()).select(*names)
    single = asked.filter(f"{p}stays").dropDuplicates([f"{p}own", "doc_id", "text"]).select(*names)
    return keyed.filter(~F.col(f"{p}maybe")).select(*names).unionByName(innocent).unionByName(single)


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id")
