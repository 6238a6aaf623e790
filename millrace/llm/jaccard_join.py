"""Exact n-gram Jaccard self-join by an R-tree over count vectors.

A document's set of word shingles is hashed into groups, and the numbers of shingles per group are a point. The overlap of
two sets is at most the sum of the coordinates' minima of their points; the overlap of a set with all sets below a node of
the tree is at most the same sum with the node's upper corner. Nodes, then points, that can't reach the overlap the
similarity asks for are passed over; the pairs that survive are verified on the sets themselves.

The tree has two resolutions. Its directory works on fine groups, a 64-bit hash each, so points are sparse there: taken
from the group met least in the corpus to the one met most, if a set shares none of its first n - ceil(n * percent / 100) + 1
with another, the sum of minima over all groups stays below what a link needs. So a point is entered on the page of each of
its first groups, no two linked sets are without a common page, and pages that only one set is on are dropped at once. How
often groups are met is a sketch of fixed size over all documents; results don't depend on it, only the pages' sizes do.
Below the directory every page is a tree over GROUPS coarse groups, packed by size; all pages of a batch are searched together.
What the trees admit is compared once more by points of FINE groups, where few sets that aren't linked reach the bound.

Equal sets are one node. The join runs twice over the pages. First every set is searched among the PIVOTS most central of
each level of sizes on its page (pages of up to ALL_OF sets: among all), and the links found make components, so a group of many near copies costs a
few verifications for each. Then, on larger pages, each set outside the page's largest component is searched among all sets
of other components. The pages that a sample shows to be the largest are split by hash into parts; pivots, then the sets
outside the largest component, go to all parts, as points and never as texts. Texts are read again for the pairs that
survive, twice a pair.

Edge cases: null, empty or blank texts have no set and are alone; fewer words than a shingle are one shingle; one text of
any length is a piece of its own; repeated rows and ties share a node; a null id is never smaller than another, and a group
of null ids alone has the component null; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrow import lean, pieces, small_batches, utf8
from millrace.llm.graph import components
from millrace.llm.native import free_name, quoted
from millrace.llm.shingles import mix, set_id, shingle_sets, shingle_sets_with_cost, word_hashes
from millrace.session import discard, materialize

WORDS = 5
PERCENT = 80
#: Places of each half of the sketch, 16 MB in all, and ranges of places that are added up apart.
SKETCH_BITS = 21
SKETCH_RANGES = 64
#: Coordinates of a point in the trees, and of the finer one that pairs are compared by; the first divides the second.
GROUPS = 64
FINE = 512
LEAF = 8
#: Sets of each level of sizes on a page, the closest to its mean, that all others are compared with first; a level's width.
PIVOTS = 4
LEVEL = 1.05
ALL_OF = 16
#: Pages that a sample of one in SAMPLED nodes gives more than PAGE_PART points are split; at most SPLIT_PAGES, the largest.
PAGE_PART = 1 << 14
SAMPLED = 64
SPLIT_PAGES = 4096
#: Bytes of text handled at once; arrays over their places take some 40 times that.
PIECE = 1 << 18
#: Pairs of a point and a node, or of two points, that are compared at once.
COMPARED = 1 << 16
#: Pairs that the queries searched at once may come to, at most.
AHEAD = 4 * COMPARED
FEW = COMPARED * GROUPS // FINE
#: Shingles of sets that a task keeps for its next pairs.
KEPT = 1 << 20


def rarest(shingles: np.ndarray, word_cost: np.ndarray, cost: np.ndarray, percent: int) -> np.ndarray:
    """As many of the set's cheapest shingles as two linked sets can't both do without.

    A shingle costs the logs of its words' counts and of its own: shingles of common words are likely common, whatever the
    sketch's noise, and those of a shared passage are seen by their own counts.
    """
    n = len(shingles)
    many = n - -(-n * percent // 100) + 1
    own = cost[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return shingles[np.lexsort((shingles, word_cost + 4 * own))[:many]]


def _packed(at: int, counts: np.ndarray) -> pa.RecordBatch:
    raw = np.minimum(counts, (1 << 32) - 1).astype(np.uint32).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(raw)], pa.binary())], ["at", "counts"])


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint32).astype(np.int64)


def _sketch(words: int):
    """For each task, how often words, then shingles of sets, are met at each of the places they are hashed to, in ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << SKETCH_BITS), np.uint32)
        for batch in pieces(batches, limit=PIECE):
            text = utf8(batch.column("text"))
            for row, hashes in zip(counts, (word_hashes(*text)[0], np.concatenate(shingle_sets(*text, words))), strict=True):
                place, n = np.unique((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32), return_counts=True)
                row[place] += n.astype(np.uint32)  # a task has fewer than 2**32 of each
        for at, part in enumerate(np.split(counts.ravel(), SKETCH_RANGES)):
            yield _packed(at, part)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, raw in zip(batch.column("at").to_pylist(), batch.column("counts"), strict=True):
            total[at] = total.get(at, 0) + _unpacked(raw.as_py())
    for at, counts in total.items():
        yield _packed(at, counts)


def sketch(texts: DataFrame, words: int) -> np.ndarray:
    """Costs (256 times the log of the counts over all documents) of words and of shingles, by place.

    SKETCH_RANGES rows of a fixed size come to the driver, whatever the input.
    """
    rows = texts.select("text").mapInArrow(lean(_sketch(words)), "at int, counts binary").repartition("at").mapInArrow(lean(_added), "at int, counts binary")
    counts = np.zeros((SKETCH_RANGES, (2 << SKETCH_BITS) // SKETCH_RANGES), np.int64)
    for r in rows.collect():
        counts[r["at"]] += _unpacked(bytes(r["counts"]))
    return np.rint(256 * np.log2(counts.reshape(2, -1) + 1)).astype(np.int32)


def point(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((shingles % np.uint64(groups)).astype(np.int64), minlength=groups)


def _folded(fine: np.ndarray) -> np.ndarray:
    """The points of fewer groups that finer ones make up."""
    return fine.reshape(len(fine), FINE // GROUPS, GROUPS).sum(1, dtype=np.uint32)


def _lists(values: np.ndarray, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)), pa.array(values))


def _describe(words: int, percent: int, shared):
    """id, key, size, node, and for the first of a node in each task its points and the pages it is entered on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, (word_cost, cost) = set(), shared.value
        for batch in pieces(batches, limit=PIECE):
            sets, costs = shingle_sets_with_cost(*utf8(batch.column("text")), words, word_cost)
            nodes = [set_id(s) if len(s) else None for s in sets]
            points, fine, groups = [], [], []
            for node, s, of_words in zip(nodes, sets, costs, strict=True):
                new = node is not None and node not in seen
                groups.append(rarest(s, of_words, cost, percent).view(np.int64) if new else np.empty(0, np.int64))
                points.append(_narrow(point(s)) if new else None)
                fine.append(_narrow(point(s, FINE)) if new else None)
                if new:
                    seen.add(node)
            if len(seen) > 1 << 20:  # else a long task would hold all its nodes; meeting one again is only more work
                seen.clear()
            columns = [batch.column("id"), batch.column("key"), pa.array(list(map(len, sets)), pa.int64()), pa.array(nodes, pa.int64()), pa.array(points, pa.binary()), pa.array(fine, pa.binary()), _lists(np.concatenate(groups) if groups else np.empty(0, np.int64), list(map(len, groups)))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "n_shingles", "node", "point", "fine", "pages"])

    return run


def _same(columns: list[np.ndarray]) -> np.ndarray:
    """Whether each row equals the one before in all columns."""
    return np.logical_and.reduce([np.concatenate([[False], c[1:] == c[:-1]]) for c in columns])


def _entered(split: list[int]):
    """(page, part, node, pivot) for every set on a page that others are on too, from rows sorted by page, part and node.

    Holds one batch and one row, whatever a page's rows. Repeated nodes are dropped; what is on a split page is kept.
    """
    names = ["page", "part", "node", "pivot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_split, last, given = np.array(sorted(split), np.int64), None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if last is not None:
                rows = [np.append(x, y) for x, y in zip(last, rows, strict=True)]
            new = ~_same(rows[:3])
            rows = [c[new] for c in rows]
            follows = _same(rows[:2])
            company = follows | np.append(follows[1:], False) | np.isin(rows[0], of_split)
            give = company.copy()
            give[0] &= not (last is not None and given)
            given = bool(company[-1]) or (len(give) == 1 and given)
            last = [c[-1:] for c in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c[give]) for c in rows], names)

    return run


class Forest:
    """A tree for each group of points, packed by size; each node keeps its upper corner and its least and largest size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, group: np.ndarray, groups: int) -> None:
        self.order = np.lexsort((sizes, group))
        corner, least = points[self.order], sizes[self.order]
        most, many = least, np.bincount(group, minlength=groups)
        #: from points to roots: corner, least, most, where each node's children start below, and how many there are
        self.levels = [(corner, least, most, None, None)]
        while many.max(initial=0) > 1:
            above = -(-many // LEAF)
            within = np.arange(above.sum()) - np.repeat(np.cumsum(above) - above, above)
            first = np.repeat(np.cumsum(many) - many, above) + within * LEAF
            held = np.minimum(LEAF, np.repeat(many, above) - within * LEAF)
            corner, least, most = np.maximum.reduceat(corner, first), np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)
            self.levels.append((corner, least, most, first, held))
            many = above
        self.root, self.size = np.cumsum(many) - many, np.bincount(group, minlength=groups)

    def search(self, points: np.ndarray, sizes: np.ndarray, group: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) of all points of the query's group that the bound admits, in bounded parts of the queries."""
        some = np.flatnonzero(self.size[group])
        cuts = np.flatnonzero(np.diff(np.cumsum(self.size[group[some]]) // AHEAD)) + 1
        for queries in np.split(some, cuts):
            q, at = queries, self.root[group[queries]]
            for corner, least, most, first, held in reversed(self.levels):
                fits = np.concatenate([np.zeros(0, bool), *(self._admits(corner, least, most, at[i : i + COMPARED], points, sizes, q[i : i + COMPARED], percent) for i in range(0, len(q), COMPARED))])
                q, at = q[fits], at[fits]
                if first is not None:
                    n = held[at]
                    at = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    q = np.repeat(q, n)
            yield q, self.order[at]

    @staticmethod
    def _admits(corner: np.ndarray, least: np.ndarray, most: np.ndarray, at: np.ndarray, points: np.ndarray, sizes: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
        size, low = sizes[q], least[at]
        fits = (low * percent <= size * 100) & (most[at] * 100 >= size * percent)
        some = np.flatnonzero(fits)
        overlap = np.minimum(corner[at[some]], points[q[some]]).sum(1, dtype=np.int64)
        asked = size[some] + np.maximum(low[some], -(-size[some] * percent // 100))
        fits[some] = overlap * (100 + percent) >= asked * percent
        return fits


def _points(column: pa.Array, groups: int) -> np.ndarray:
    """One row per point. The width of a number depends on the largest."""
    raw = column.to_pylist()
    widths = {len(x) // groups for x in raw}
    kind = {1: "<u1", 2: "<u2", 4: "<u4"}
    if len(widths) == 1:
        return np.frombuffer(b"".join(raw), kind[widths.pop()]).reshape(-1, groups)
    return np.stack([np.frombuffer(x, kind[len(x) // groups]).astype("<u4") for x in raw])


def _reaches(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bound admits the pairs of points, row by row."""
    return np.minimum(a, b).sum(1, dtype=np.int64) * (100 + percent) >= (size_a + size_b) * percent


def _narrow(counts: np.ndarray) -> bytes:
    return counts.astype(next(k for k, most in (("<u1", 1 << 8), ("<u2", 1 << 16), ("<u4", 1 << 32)) if counts.max() < most)).tobytes()


def _central(points: np.ndarray, sizes: np.ndarray, group: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Whether each point is one of the PIVOTS closest to the mean of its page's points on its level of sizes."""
    level = np.floor(np.log(sizes) / np.log(LEVEL)).astype(np.int64)
    order = np.lexsort((level, group))
    first = np.flatnonzero(~_same([group[order], level[order]]))
    many = np.diff(np.append(first, len(order)))
    own, off = np.repeat(np.arange(len(first)), many), np.empty(len(order), np.float32)
    for i in range(0, len(order), COMPARED):  # whole levels are needed for the mean only
        part = own[i : i + COMPARED]
        lowest, highest = int(part[0]), int(part[-1]) + 1
        span = slice(first[lowest], first[highest] if highest < len(first) else len(order))
        mean = np.add.reduceat(points[order[span]], first[lowest:highest] - first[lowest], dtype=np.float32) / many[lowest:highest, None]
        off[i : i + COMPARED] = np.abs(points[order[i : i + COMPARED]] - mean[part - lowest]).sum(1)
    ranked = np.lexsort((nodes[order], off, own))
    chosen = np.empty(len(order), bool)
    chosen[order[ranked]] = np.arange(len(order)) - np.repeat(first, many) < PIVOTS
    return chosen


def _search(percent: int, by_label: bool):
    """(a, b) that may be linked, from whole pages: rows sorted by page, part and node.

    Without labels, sets of a page are searched among its pivots, or among all if they are few. With labels, sets asked for
    are searched among those stored, for other labels.
    """

    def solve(rows: dict[str, np.ndarray], given: np.ndarray) -> Iterator[pa.RecordBatch]:
        points, fine = (_folded(given), given) if by_label else (given, None)
        nodes, sizes = rows["node"], rows["size"]
        start = ~_same([rows["page"], rows["part"]])
        group = np.cumsum(start) - 1
        groups = int(group[-1]) + 1
        if by_label:
            stored, asked = rows["stored"], rows["asked"]
        else:
            few, split = np.bincount(group) <= ALL_OF, np.bincount(group, rows["pivot"]) > 0
            stored = few[group] | _central(points, sizes, group, nodes)
            stored, asked = np.where(split[group], rows["pivot"], stored), np.ones(len(nodes), bool)
        stored, asked = np.flatnonzero(stored), np.flatnonzero(asked)
        if not len(stored):
            return
        forest = Forest(points[stored], sizes[stored], group[stored], groups)
        for q, x in forest.search(points[asked], sizes[asked], group[asked], percent):
            a, b = asked[q], stored[x]
            apart = rows["label"][a] != rows["label"][b] if by_label else nodes[a] != nodes[b]
            a, b = a[apart], b[apart]
            if by_label:
                near = np.concatenate([np.zeros(0, bool), *(_reaches(fine[a[i : i + FEW]], fine[b[i : i + FEW]], sizes[a[i : i + FEW]], sizes[b[i : i + FEW]], percent) for i in range(0, len(a), FEW))])
                a, b = a[near], b[near]
            pairs = np.stack([np.minimum(nodes[a], nodes[b]), np.maximum(nodes[a], nodes[b])], 1)
            pairs = np.unique(pairs, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    names = ["page", "part", "node", "size", *(["label", "stored", "asked"] if by_label else ["pivot"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[dict[str, np.ndarray], np.ndarray]] = []

        def joined() -> tuple[dict[str, np.ndarray], np.ndarray]:
            return {c: np.concatenate([h[0][c] for h in held]) for c in names}, np.concatenate([h[1] for h in held])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(({c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}, _points(batch.column("point"), FINE if by_label else GROUPS)))
            page, part = held[-1][0]["page"], held[-1][0]["part"]
            if page[-1] == held[0][0]["page"][0] and part[-1] == held[0][0]["part"][0]:
                continue  # one page so far
            rows, points = joined()
            whole = int(np.flatnonzero((rows["page"] != page[-1]) | (rows["part"] != part[-1]))[-1]) + 1
            yield from solve({c: v[:whole] for c, v in rows.items()}, points[:whole])
            held = [({c: v[whole:] for c, v in rows.items()}, points[whole:])]
        if held:
            yield from solve(*joined())

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(words: int, percent: int):
    """The pairs (a, b) whose sets are linked. Sets of the last batches are kept, up to KEPT shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for batch in pieces(batches, "text_a", limit=PIECE):
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            if sum(map(len, sets.values())) > KEPT:
                sets = {}
            for column, nodes in (("text_a", a), ("text_b", b)):
                new, first = np.unique(nodes, return_index=True)
                first = [int(i) for n, i in zip(new.tolist(), first, strict=True) if n not in sets]
                texts = batch.column(column).take(pa.array(first, pa.int64()))
                sets.update(zip(nodes[first].tolist(), shingle_sets(*utf8(texts), words), strict=True))
            good = np.array([linked(sets[x], sets[y], percent) for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    return run


_BITS = 1 << 27


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit for every key, in ranges of keys."""
    bits: dict[int, np.ndarray] = {}
    for batch in batches:
        place = batch.column("key").to_numpy().view(np.uint64) % np.uint64(_BITS)
        at, place = place // np.uint64(_BITS // SKETCH_RANGES), place % np.uint64(_BITS // SKETCH_RANGES)
        for i in np.unique(at).tolist():
            bits.setdefault(i, np.zeros(_BITS // SKETCH_RANGES, bool))[place[at == i]] = True
    for i, marked in bits.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(np.packbits(marked).tobytes())], pa.binary())], ["at", "bits"])


def _marked_keys(keys: DataFrame):
    """A broadcast bit array, of a fixed size, in which every key has its bit. SKETCH_RANGES rows come to the driver."""
    ranged = keys.repartition(F.expr(f"(key & {_BITS - 1}) div {_BITS // SKETCH_RANGES}"))
    bits = np.zeros((SKETCH_RANGES, _BITS // SKETCH_RANGES // 8), np.uint8)
    for r in ranged.mapInArrow(lean(_marks), "at int, bits binary").collect():
        bits[r["at"]] |= np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["bits"])), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits.ravel())


def _has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = (key.view(np.uint64) % np.uint64(_BITS)).astype(np.int64)
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def _marked(shared):
    """(key, text) of the rows whose key may be marked, each key once for a while."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            key, at = batch.column("key").to_numpy(), []
            for i in np.flatnonzero(_has(bits, key)).tolist():
                if key[i] not in seen:
                    seen.add(key[i])
                    at.append(i)
            if len(seen) > 1 << 20:
                seen.clear()
            yield batch.take(pa.array(at, pa.int64()))

    return run


def _texts(slim: DataFrame, described: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text) for every node of the pairs, from one document each.

    Documents that are not asked for are passed over by a bit array of fixed size, so only the others' texts are moved;
    which texts come out doesn't depend on it.
    """
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    stand_ins = described.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("key").alias("key")).join(nodes, "node")
    stand_ins = materialize(stand_ins)
    shared = _marked_keys(stand_ins.select("key"))
    some = slim.select("key", "text").where("text IS NOT NULL").mapInArrow(lean(_marked(shared)), "key long, text string")
    return materialize(some.groupBy("key").agg(F.first("text").alias("text")).join(stand_ins, "key").select("node", "text"))


def _near(percent: int):
    """The pairs that the bound on finer points admits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fine = [_points(batch.column(c), FINE) for c in ("fine_a", "fine_b")]
                near = _reaches(*fine, *(batch.column(c).to_numpy() for c in ("size_a", "size_b")), percent)
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def _links(candidates: DataFrame, points: DataFrame, slim: DataFrame, described: DataFrame, words: int, percent: int) -> DataFrame:
    """The linked ones of the candidates, given once or more: first by finer points, then by the sets."""
    of = lambda s: points.select(F.col("node").alias(s), F.col("fine").alias(f"fine_{s}"), F.col("size").alias(f"size_{s}"))
    pairs = materialize(candidates.distinct().join(of("a"), "a").join(of("b"), "b").mapInArrow(lean(_near(percent)), "a long, b long"))
    texts = _texts(slim, described, pairs)
    side = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}"))
    out = materialize(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(lean(_verify(words, percent)), "a long, b long"))
    discard(texts)
    discard(pairs)
    return out


def _paged(rows: DataFrame, points: DataFrame, which: str) -> DataFrame:
    return rows.join(points.select("node", "size", F.col(which).alias("point")), "node").repartition("page", "part").sortWithinPartitions("page", "part", "node")


def _split_pages(described: DataFrame) -> list[tuple[int, int]]:
    """(page, estimated sets) of the largest pages, by a sample of the nodes."""
    some = described.where(F.col("point").isNotNull() & (F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(SAMPLED)) == 0))
    seen = some.select(F.explode("pages").alias("page"), "node").distinct().groupBy("page").agg(F.count("*").alias("n"))
    rows = seen.where(F.col("n") * SAMPLED > PAGE_PART).orderBy(F.desc("n"), "page").limit(SPLIT_PAGES).collect()
    return [(r["page"], r["n"] * SAMPLED) for r in rows]


def _enter(described: DataFrame, split: list[tuple[int, int]]) -> DataFrame:
    """(page, part, parts, node, pivot): the directory."""
    rows = described.where(F.col("point").isNotNull()).select(F.explode("pages").alias("page"), "node")
    if not split:
        rows = rows.select("page", F.lit(0).alias("part"), "node", F.lit(False).alias("pivot"))
        rows = rows.repartition("page")
    else:
        sizes = described.sparkSession.createDataFrame(split, "page long, sets long")
        rows = rows.join(F.broadcast(sizes), "page", "left")  # SPLIT_PAGES rows at most
        parts = F.ceil(F.col("sets") / PAGE_PART).cast("int")
        pivot = F.coalesce(F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("sets")) < 8 * PIVOTS, F.lit(False))
        at = F.when(F.col("sets").isNull(), F.array(F.lit(0))).when(pivot, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), parts).cast("int")))
        rows = rows.select("page", F.explode(at).alias("part"), "node", pivot.alias("pivot")).repartition("page", "part")
    return rows.sortWithinPartitions("page", "part", "node").mapInArrow(lean(_entered([p for p, _ in split])), "page long, part int, node long, pivot boolean")


def _joined(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, key, n_shingles, node, root) for every row, computed once."""
    with small_batches(docs.sparkSession):
        return materialize(_rooted(docs, id_col, text_col, words, percent))


def _rooted(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, key, n_shingles, node, root) for every row; key is a hash of the text, root one node of each component."""
    slim = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).withColumn("key", F.xxhash64("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(sketch(slim, words))
    described = materialize(slim.mapInArrow(lean(_describe(words, percent, shared)), f"id {kind}, key long, n_shingles long, node long, point binary, fine binary, pages array<bigint>"))
    split = _split_pages(described)
    entered = materialize(_enter(described, split))
    points = materialize(described.where(F.col("point").isNotNull()).groupBy("node").agg(F.first("point").alias("point"), F.first("fine").alias("fine"), F.first("n_shingles").alias("size")).join(entered.select("node").distinct(), "node"))

    first = _paged(entered, points, "point").mapInArrow(lean(_search(percent, False)), "a long, b long")
    links = _links(first, points, slim, described, words, percent)
    roots = components(links)

    # On larger pages, what is outside the page's largest component meets all other components.
    own = entered.select("page", "node").distinct() if split else entered.select("page", "node")
    large = own.groupBy("page").agg(F.count("*").alias("sets")).where(F.col("sets") > ALL_OF)
    labelled = own.join(large, "page").join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))
    per_label = labelled.groupBy("page", "label").agg(F.count("*").alias("n"))
    main = per_label.groupBy("page").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    rows = labelled.join(main.select("page", "main"), "page").withColumn("asked", F.col("label") != F.col("main"))
    parts = F.when(F.col("sets") > 2 * PAGE_PART, F.ceil(F.col("sets") / PAGE_PART)).otherwise(1).cast("int")
    here = F.pmod(F.xxhash64("node"), parts).cast("int")
    at = F.when(F.col("asked"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(here))
    rows = rows.select("page", F.explode(at).alias("part"), "node", "label", "asked", here.alias("here")).withColumn("stored", F.col("part") == F.col("here")).drop("here")
    second = _paged(rows, points, "fine").mapInArrow(lean(_search(percent, True)), "a long, b long")
    more = _links(second, points, slim, described, words, percent)
    ties = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(ties.unionByName(more))
    for used in (entered, points, links, more):
        discard(used)

    rows = described.select("id", "key", "n_shingles", "node")
    known = rows.where(F.col("node").isNotNull()).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return known.unionByName(rows.where(F.col("node").isNull()).withColumn("root", F.lit(None).cast("long"))).select("id", "key", "n_shingles", "node", "root")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component) for every row: component is the smallest id reachable by links, its own included."""
    rows = _joined(docs, id_col, text_col, words, percent)
    least = rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("component"))
    known = rows.where(F.col("root").isNotNull()).join(least, "root").select("id", "n_shingles", "component")
    return known.unionByName(rows.where(F.col("root").isNull()).select("id", "n_shingles", F.col("id").alias("component")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group of linked ones: that with the smallest id, without an id last, then by a hash of the text.

    Rows equal in id and text are one document, with or without an id; one of them stays. Documents that are alone, which a bit
    array of fixed size tells, stay where they are; the texts of the others are moved once.
    """
    rows = _joined(docs, id_col, text_col, words, percent)
    units = materialize(rows.groupBy("id", "key", "root").agg(F.count("*").alias("n")).withColumn("unit", F.xxhash64("id", "key")))
    linked_ones = units.where(F.col("root").isNotNull())
    order = F.struct(F.col("id").isNull().alias("late"), F.col("id"), F.col("key"))
    groups = linked_ones.groupBy("root").agg(F.min_by("unit", order).alias("best"), F.sum("n").alias("rows")).where(F.col("rows") > 1)
    grouped = linked_ones.join(groups, "root").select("unit", (F.col("unit") == F.col("best")).alias("stays"), "n")
    repeated = units.where(F.col("root").isNull() & (F.col("n") > 1)).select("unit", F.lit(True).alias("stays"), "n")
    others = materialize(grouped.unionByName(repeated))
    shared = _marked_keys(others.select(F.col("unit").alias("key")))

    @F.pandas_udf("boolean")
    def in_group(unit: pd.Series) -> pd.Series:
        return pd.Series(_has(shared.value, unit.to_numpy(np.int64)))

    unit, asked, found = (free_name(docs, x) for x in ("unit", "asked", "found"))
    keyed = docs.withColumn(unit, F.xxhash64(F.col(quoted(id_col)), F.xxhash64(F.col(quoted(text_col)))))
    keyed = keyed.withColumn(asked, in_group(F.col(unit)))
    back = [F.col(quoted(c)) for c in docs.columns]
    joined = keyed.where(asked).join(others.select(F.col("unit").alias(unit), F.struct("stays", "n").alias(found)), unit, "left")
    alone = joined.where(F.col(found).isNull() | F.col(found)["stays"] & (F.col(found)["n"] == 1))
    many = joined.where(F.col(found)["stays"] & (F.col(found)["n"] > 1)).dropDuplicates([unit])
    return keyed.where(~F.col(asked)).select(back).unionByName(alone.select(back)).unionByName(many.select(back))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = join(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
