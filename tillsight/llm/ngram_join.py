"""Jaccard join of word-shingle sets with count-vector R-trees.

A text's set of shingles is hashed into groups; the counts per group are a point.
Two sets share at most the sum of their points' coordinate minima, and so do any
members of two boxes by the boxes' upper corners: subtrees, and then pairs, whose
bound is too low are left out, the survivors are compared shingle by shingle.

One tree over all points would prune nothing but sizes (random counts are much
alike in every coordinate), so there is a tree per *page*: the texts that share
one of their rarest shingles. Texts as similar as asked for share a page (prefix
filter: of n shingles at most n - ceil(0.75 n) can be missing in the other set, so
one of the first n - ceil(0.75 n) + 1 in a common order is not). The order is by
how often a shingle's hash group occurs in the corpus, rare first, so that
passages which many documents share rarely open pages.

Groups of copies make no pairs of all members. Equal texts are one point. First
every member of a page is compared with the page's least member, then, in a few
rounds, with other leaders, as long as the page has members of different
components of the links found so far. Then trees join only members of different
components, box by box: pages within one component, which is what a group of near
copies has become, are done. The pairs that are left are compared where the page is,
and only links that join two components leave it, fewer than the page has members.
Every pair of a page is so either linked through others or compared.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import SPACED_WORD, discard, small, text_of, written
from tillsight.llm.components import connected_components

#: Words of a shingle; similarity of a link, as 100 * intersection >= 75 * union.
SHINGLE, PERCENT = 5, 75
#: Hash groups whose corpus counts order the shingles, as a power of two, and the blocks of them that are summed apart.
ORDER_BITS, COUNT_BLOCKS = 20, 64
#: Shingles that a task counts at once, about.
COUNTED = 1 << 20
#: Coordinates of a point: the power of two from the set's size on, and this many at least.
LEAST_COORDINATES = 16
#: Star rounds after the first, and leaders that a text meets in one, at most.
STAR_ROUNDS, LEADERS = 3, 8
#: Rows of a page, by corpus counts, that one task ranks; larger pages are salted.
SALT_ROWS = 50_000
#: Rows of a page that are one tree; a larger page is joined tree by tree.
TREE_ROWS = 4_096
LEAF, FANOUT = 16, 8
#: Texts to be compared are looked up by slot: a set of at most this many numbers.
SLOTS = 1 << 20
#: Bytes of text that are hashed at a time.
SEGMENT = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, ``n`` at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64)), dtype=np.uint64)
                      for b in (_BASE, _BASE_INVERSE)]
    return _POWERS


def _segments(octets: bytes):
    """Parts of about SEGMENT bytes that end before white space (a longer word is not cut)."""
    at = 0
    while at < len(octets):
        end = at + SEGMENT
        while end < len(octets) and octets[end] not in b"\x20\t\n\v\f\r":
            end += 1
        yield octets[at:end]
        at = end


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a whole text, A-Z in lower case."""
    found = []
    for octets in _segments(text.encode("utf-8", "replace")):
        data = np.frombuffer(octets, np.uint8)
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        solid = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
        edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _powers(len(data))
        sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], dtype=np.uint64))
        found.append(_mix((sums[ends] - sums[starts]) * inverse[starts]))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of fewer words, of the whole sequence; of none, nothing."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    n = min(size, len(words))
    if not n:
        return words
    shingles = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        shingles = shingles * _STEP + words[i:len(words) - n + 1 + i]
    return np.unique(_mix(shingles))


def point_of(shingles: np.ndarray) -> np.ndarray:
    """Counts per group, a byte each; the number of groups is a power of two by the size of the set."""
    groups = LEAST_COORDINATES
    while groups < len(shingles):
        groups *= 2
    while True:
        counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max() <= 255:
            return counts.astype(np.uint8)
        groups *= 2  # distinct hashes part sooner or later


def packed(point: np.ndarray) -> bytes:
    """Most counts are 0 or 1: a point packs to about a third."""
    return zlib.compress(point.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The point over fewer groups."""
    return point if len(point) == groups else point.reshape(-1, groups).sum(axis=0, dtype=np.int64)


def may_link(shared: int, n_a: int, n_b: int, percent: int = PERCENT) -> bool:
    """Whether ``shared`` common shingles are enough: 100 * shared >= percent * (n_a + n_b - shared)."""
    return (100 + percent) * shared >= percent * (n_a + n_b)


def bound_passes(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, percent: int = PERCENT) -> bool:
    groups = min(len(a), len(b))
    return may_link(int(np.minimum(folded(a, groups), folded(b, groups)).sum()), n_a, n_b, percent)


class Node:
    """A box: the largest count per group, the sizes and the component of what is below."""

    __slots__ = ("low", "high", "box", "component", "below", "points")

    def __init__(self, low, high, box, component, below=None, points=None):
        self.low, self.high, self.box, self.component, self.below, self.points = low, high, box, component, below, points


def _over(nodes: list[Node]) -> tuple:
    groups = min(len(n.box) for n in nodes)
    component = nodes[0].component
    return (min(n.low for n in nodes), max(n.high for n in nodes), np.max([folded(n.box, groups) for n in nodes], axis=0),
            component if all(n.component == component for n in nodes) else None)


def tree_of(members: list[tuple]) -> Node:
    """Bulk-load (id, component, size, point) in order of (component, size)."""
    members = sorted(members, key=lambda m: (m[1], m[2], m[0]))
    points = [Node(m[2], m[2], m[3], m[1], points=m) for m in members]
    level = [Node(*_over(points[i:i + LEAF]), points=points[i:i + LEAF]) for i in range(0, len(points), LEAF)]
    while len(level) > 1:
        level = [Node(*_over(level[i:i + FANOUT]), below=level[i:i + FANOUT]) for i in range(0, len(level), FANOUT)]
    return level[0]


def _possible(a: Node, b: Node, percent: int) -> bool:
    if a.component is not None and a.component == b.component:
        return False
    if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
        return False
    return bound_passes(a.box, b.box, a.low, b.low, percent)


def _leaf_pairs(x: Node, y: Node, percent: int) -> list[tuple[Node, Node]]:
    """Pairs of the points of two leaves by the bound over the fewest groups of any, all at once."""
    groups = min(len(p.box) for p in (*x.points, *y.points))
    left, right = (np.array([folded(p.box, groups) for p in node.points]) for node in (x, y))
    n_left, n_right = (np.array([p.low for p in node.points]) for node in (x, y))
    shared = np.minimum(left[:, None, :], right[None, :, :]).sum(axis=2, dtype=np.int64)
    able = (100 + percent) * shared >= percent * (n_left[:, None] + n_right[None, :])
    if x is y:
        able = np.triu(able, 1)
    return [(x.points[i], y.points[j]) for i, j in np.argwhere(able)]


def tree_pairs(a: Node, b: Node, percent: int = PERCENT):
    """Ids of the pairs of different components whose bound suffices, each once."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if not _possible(x, y, percent):
            continue
        if x.below is None and y.below is None:
            for p, q in _leaf_pairs(x, y, percent):
                if _possible(p, q, percent):
                    yield min(p.points[0], q.points[0]), max(p.points[0], q.points[0])
        elif x is y:
            todo += [(p, q) for i, p in enumerate(x.below) for q in x.below[i:]]
        elif y.below is None or (x.below is not None and len(x.below) >= len(y.below)):
            todo += [(p, y) for p in x.below]
        else:
            todo += [(x, q) for q in y.below]


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, text): ``tid`` stands for the text; equal texts share it (64 bits)."""
    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))


def group_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How often each hash group of shingles occurs in the corpus: one number per group.

    A task hands on a packed row per block of groups, so that many groups, which tell rare
    shingles of a large corpus from common ones, are little to shuffle and no row each.
    """
    shift = np.uint64(64 - ORDER_BITS)

    def counted(batches):
        total, held, n = np.zeros(1 << ORDER_BITS, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append((shingle_set(text.as_py(), size) >> shift).astype(np.int32))
                n += len(held[-1])
                if n >= COUNTED:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, n = [], 0
        if n:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        if total.any():
            yield blocks_of(dict(enumerate(total.reshape(COUNT_BLOCKS, -1))))

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[block] = total.get(block, 0) + np.frombuffer(zlib.decompress(n.as_py()), np.int64)
        if total:
            yield blocks_of(total)

    def blocks_of(found: dict[int, np.ndarray]) -> pa.RecordBatch:
        # Counts of one task are small numbers: they pack to a byte or two each.
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(
            [zlib.compress(n.tobytes(), 1) for n in found.values()], pa.binary())], names=["block", "n"])

    total = np.zeros((COUNT_BLOCKS, (1 << ORDER_BITS) // COUNT_BLOCKS), np.int64)
    of_task = texts.select("text").mapInArrow(counted, "block int, n binary")
    for r in of_task.repartition("block").mapInArrow(summed, "block int, n binary").collect():
        total[r["block"]] = np.frombuffer(zlib.decompress(r["n"]), np.int64)
    return total.reshape(-1)


def _points(texts: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """(doc_id, tid, n, point, prefix, salts); point and prefix only where a task meets a text first."""
    shift = np.uint64(64 - ORDER_BITS)
    counts = np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)  # goes to every task
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("n", pa.int64()), ("point", pa.binary()),
                        ("prefix", pa.list_(pa.int64())), ("salts", pa.list_(pa.int32()))])

    def run(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            rows = []
            for doc_id, tid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if tid in seen:
                    rows.append((doc_id, tid, seen[tid], None, None, None))
                    continue
                shingles = shingle_set(text.as_py(), size)
                n = seen[tid] = len(shingles)
                group = (shingles >> shift).astype(np.int64)
                # ceil(n * percent / 100) shingles at least are shared
                first = np.lexsort((shingles, counts[group]))[:n + 1 - -(-n * percent // 100)] if n else []
                rows.append((doc_id, tid, n, packed(point_of(shingles)) if n else None,
                             shingles[first].view(np.int64), (-(-counts[group[first]].astype(np.int64) // SALT_ROWS)).astype(np.int32)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return texts.mapInArrow(run, "doc_id long, tid long, n long, point binary, prefix array<long>, salts array<int>")


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose points let them link."""
    left = points.select(F.col("tid").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("p_a"))
    right = points.select(F.col("tid").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("p_b"))
    sized = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)

    def run(batches):
        for batch in batches:
            a, b, n_a, n_b, p_a, p_b = batch.columns
            keep = [bound_passes(unpacked(x.as_py()), unpacked(y.as_py()), n, m, percent)
                    for x, y, n, m in zip(p_a, p_b, n_a.to_pylist(), n_b.to_pylist())]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").where(sized)
    return joined.select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(run, "a long, b long")


def _sets(need: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(tid, shingles): the whole sets of the texts in ``need`` (tid), written."""
    need = written(need, "need")
    slots = written(need.select(F.pmod("tid", F.lit(SLOTS)).alias("slot")).distinct(), "need-slots")

    def sets(batches):
        seen = set()
        for batch in batches:
            tids, out = [], []
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if tid not in seen:
                    seen.add(tid)
                    tids.append(tid)
                    out.append(shingle_set(text.as_py(), size).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int64()), pa.array(out, pa.binary())], names=["tid", "shingles"])

    wanted = texts.select("tid", "text", F.pmod("tid", F.lit(SLOTS)).alias("slot")).join(F.broadcast(slots), "slot", "left_semi")
    made = wanted.select("tid", "text").mapInArrow(sets, "tid long, shingles binary")
    return written(made.join(need, "tid", "left_semi").dropDuplicates(["tid"]), "sets")


def links_of(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets of shingles link."""
    return may_link(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) that link, by their whole sets."""
    made = _sets(pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct(), texts, size)

    def compared(batches):
        for batch in batches:
            keep = [links_of(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent)
                    for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(made.select(F.col("tid").alias("b"), F.col("shingles").alias("s_b")), "b")
    both = with_b.join(made.select(F.col("tid").alias("a"), F.col("shingles").alias("s_a")), "a")
    links = written(both.select("a", "b", "s_a", "s_b").mapInArrow(compared, "a long, b long"), "links")
    discard(made)
    return links


def joined_links(left: Node, right: Node, sets: dict[int, np.ndarray], components: dict[int, int], percent: int = PERCENT):
    """Links (a, b) that join two components, found by tree join: fewer than there are components.

    A pair whose members have become one component meanwhile is not compared.
    """
    above: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := above.get(c, c)) != c:
            above[c] = c = above.get(up, up)
        return c

    for a, b in tree_pairs(left, right, percent):
        x, y = root(components[a]), root(components[b])
        if x != y and links_of(sets[a], sets[b], percent):
            above[max(x, y)] = min(x, y)
            yield a, b


def _by_page(batches, width: int):
    """((h, i, j), rows) of each page in sorted batches; a row is all columns from the fourth on."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns[:width]]):
            if row[:3] != key:
                if rows:
                    yield key, rows
                key, rows = row[:3], []
            rows.append(row[3:])
    if rows:
        yield key, rows


def _trees(key: tuple, members: list[tuple]) -> tuple[Node, Node] | None:
    """The two trees of a page of (part, tid, component, n, point, ...); None where a part is empty."""
    left, right = ([(m[1], m[2], m[3], unpacked(m[4])) for m in members if m[0] == part] for part in key[1:])
    if not left or not right:
        return None
    first = tree_of(left)
    return first, first if key[1] == key[2] else tree_of(right)


def _page_members(pages: DataFrame, percent: int) -> DataFrame:
    """(h, i, j, part, tid, component, n, point), sorted by page -> the members that any bound lets link."""
    names = ["h", "i", "j", "part", "tid", "component"]
    schema = pa.schema([(c, pa.int32() if c in ("i", "j", "part") else pa.int64()) for c in names])

    def run(batches):
        for key, members in _by_page(batches, 8):
            trees = _trees(key, members)
            able = {t for pair in tree_pairs(*trees, percent) for t in pair} if trees else set()
            rows = [(*key, *m[:3]) for m in members if m[1] in able]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return pages.mapInArrow(run, "h long, i int, j int, part int, tid long, component long")


def _page_links(pages: DataFrame, percent: int) -> DataFrame:
    """(h, i, j, part, tid, component, n, point, shingles), sorted by page -> links (a, b) by tree join."""
    def run(batches):
        for key, members in _by_page(batches, 9):
            trees = _trees(key, members)
            if trees:
                sets = {m[1]: np.frombuffer(m[5], np.uint64) for m in members}
                found = list(joined_links(*trees, sets, {m[1]: m[2] for m in members}, percent))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return pages.mapInArrow(run, "a long, b long").distinct()


def linked_texts(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, tree_rows: int = TREE_ROWS):
    """(rows, components): (doc_id, tid, n) of every row, and (tid, component) of the linked texts."""
    texts = _texts(docs)
    counts = group_counts(texts, size)
    table = written(_points(texts, counts, size, percent), "points")
    rows = written(table.select("doc_id", "tid", "n"), "rows")
    points = table.where(F.col("point").isNotNull()).select("tid", "n", "point")

    # Members of pages of more than one text, each with the page's least member (of its salt).
    posted = table.where(F.col("point").isNotNull()).select(
        "tid", F.explode(F.arrays_zip("prefix", "salts")).alias("p")).select(
        "tid", F.col("p.prefix").alias("h"), F.when(F.col("p.salts") > 1, F.pmod("tid", "p.salts")).otherwise(F.lit(-1)).alias("salt"))
    page = Window.partitionBy("h", "salt")
    posted = posted.select("h", "salt", "tid", F.min("tid").over(page).alias("least"), F.max("tid").over(page).alias("most"),
                           F.count(F.lit(1)).over(page).alias("rows"))
    posted = written(posted.where("least <> most or salt >= 0"), "pages")
    salted = posted.where("salt >= 0").select("h", "least").distinct()
    tops = salted.groupBy("h").agg(F.min("least").alias("top"))
    stars = posted.select(F.col("least").alias("a"), F.col("tid").alias("b")).unionByName(
        salted.join(tops, "h").select(F.col("top").alias("a"), F.col("least").alias("b")))
    stars = written(stars.where("a <> b").distinct(), "stars")
    wanted = stars.select(F.explode(F.array("a", "b")).alias("tid")).distinct()
    used = written(points.join(wanted, "tid", "left_semi").dropDuplicates(["tid"]), "used-points")
    discard(table)
    links = _verified(written(_bounded(stars, used, percent), "bounded"), texts, size, percent)
    components = written(connected_components(links), "components")

    # A page of two is done; only the rows of larger ones go on.
    posted = posted.where("rows > 2 or salt >= 0").select("h", "tid").distinct()
    before = []
    for round_no in range(1, STAR_ROUNDS + 2):
        # What is left: members of different components in pages of three texts or more.
        members = posted.join(components.withColumnRenamed("node", "tid"), "tid", "left").select(
            "h", "tid", F.coalesce("component", "tid").alias("component"))
        members = written(members, "members")
        discard(*before)
        before = [members]
        draw = F.min(F.struct(F.xxhash64("tid", F.pmod("h", F.lit(LEADERS)), F.lit(round_no)).alias("x"), "tid", "component"))
        each = members.groupBy("h").agg(
            F.count(F.lit(1)).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"),
            F.bit_xor(F.xxhash64("tid")).alias("mark"), F.min("tid").alias("first"), F.max("tid").alias("last"),
            draw.alias("leader"))
        open_pages = written(each.where("lo <> hi and m > 2"), "open-pages")
        if open_pages.isEmpty():
            break
        # Later rounds look at no page that is closed by now: components only grow.
        posted = members.join(open_pages.select("h", "m", "leader"), "h")
        if round_no <= STAR_ROUNDS:
            stars = posted.where("component <> leader.component").select(
                F.least("tid", "leader.tid").alias("a"), F.greatest("tid", "leader.tid").alias("b")).distinct()
            found = _verified(written(_bounded(stars, used, percent), "bounded"), texts, size, percent)
        else:
            found = _late_links(posted, open_pages, used, texts, size, percent, tree_rows)
        posted = posted.select("h", "tid")
        if not found.isEmpty():
            links = links.unionByName(found)
            components = written(connected_components(links), "components")
    discard(*before, used)
    return rows, components.withColumnRenamed("node", "tid")


def _late_links(members: DataFrame, pages: DataFrame, points: DataFrame, texts: DataFrame, size: int, percent: int, tree_rows: int) -> DataFrame:
    """Links between different components in one page, found and verified where the page is."""
    # Of pages with the same members one is enough.
    chosen = pages.groupBy("m", "mark", "first", "last").agg(F.min("h").alias("h")).select("h")
    parts = F.ceil(F.col("m") / tree_rows).cast("int")
    dealt = (members.join(written(chosen, "chosen-pages"), "h").withColumn("parts", parts)
             .withColumn("part", F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    # A page of several trees: each pair of trees (i, j) is a group of its own.
    dealt = dealt.select("h", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "tid", "component")

    def by_page(rows: DataFrame) -> DataFrame:
        return rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")

    # First by points alone; whole sets go only to members that some bound lets link.
    key = ["h", "i", "j", "part", "tid", "component"]
    able = written(_page_members(by_page(dealt.join(points, "tid").select(*key, "n", "point")), percent), "able")
    sets = _sets(able.select("tid").distinct(), texts, size)
    whole = able.join(points.join(sets, "tid"), "tid").select(*key, "n", "point", "shingles")
    links = written(_page_links(by_page(whole), percent), "links")
    discard(able, sets)
    return links


def component_report(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row.

    Defined results: a null text, or one without words, has an empty set and
    links with nothing, so its component is its own doc_id; equal texts link; a
    null doc_id counts only where no row of the component has another; an empty
    table gives no rows.
    """
    rows, components = linked_texts(docs.select("doc_id", "text"), **params)
    labelled = rows.where("n > 0").join(components, "tid", "left").select(
        "doc_id", "n", F.coalesce("component", "tid").alias("component"))
    labelled = written(labelled, "labelled")
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = labelled.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """The row with the smallest doc_id of every component; rows with empty sets all stay."""
    rows, components = linked_texts(docs.select("doc_id", "text"), **params)
    labelled = rows.where("n > 0").join(components, "tid", "left")
    best = labelled.groupBy(F.coalesce("component", "tid").alias("component")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("best"))
    rows_of = rows.where("n > 0").groupBy("tid", "doc_id").agg((F.count(F.lit(1)) > 1).alias("again"))
    best = best.select(F.col("best.tid").alias("best_tid"), F.col("best.doc_id").alias("id"))
    winners = best.join(rows_of, (F.col("best_tid") == F.col("tid")) & F.col("id").eqNullSafe(F.col("doc_id")))
    winners = written(winners.select("tid", "id", "again"), "winners")
    packed_rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own"),
                         F.xxhash64(text_of()).alias("own_tid"), (~text_of().rlike(SPACED_WORD)).alias("no_words"))
    mine = (F.col("own_tid") == F.col("tid")) & F.col("own").eqNullSafe(F.col("id"))
    kept = packed_rows.join(small(winners, 1_000_000), mine, "left").where("again is not null or no_words")
    # Repeated rows of a winner: one stays. Only those rows, if any, are shuffled.
    repeated = kept.where("again").withColumn("no", F.row_number().over(Window.partitionBy("own_tid", "own").orderBy(F.lit(1))))
    out = kept.where("not coalesce(again, false)").select("row.*")
    return out.unionByName(repeated.where("no = 1").select("row.*"))
