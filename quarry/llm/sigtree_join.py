"""N-gram Jaccard join with signature trees.

Two documents link when ``q * |A & B| >= p * |A | B|`` on their sets of distinct word shingles
(production: p/q = 90/100, three words).  The join is exact:

1. Every text becomes a sorted set of shingle hashes; equal sets share one id, so copies are one node.
2. Routing.  Linked sets differ in at most ``H = (|A|+|B|)(q-p)/(q+p)`` shingles.  Sizes fall into
   classes so that linked sets are in the same or the next class; for each class pair the hash range is
   cut into more than H segments, so linked sets agree on a whole segment.  Sets that agree on a segment
   are chained, and the components of the chains are the candidate groups.  Each task sends a key once,
   however many copies it saw.  For lower thresholds segments would hold too few tokens; linked sets then share
   one of their rarest tokens (as many as they can't all do without), counted over all documents, and meet there.
3. A group is cut into blocks by size class and hash.  Each block becomes a signature tree: a node holds
   the OR of its token bitmaps, its size range and its largest surplus (tokens beyond the set bits).  A
   dual traversal of two trees drops a node pair when the size ranges exclude a link or when the
   maximum possible overlap, ``popcount(OR & OR) + surplus``, is below the smallest overlap needed.
   Surviving pairs of sets are compared exactly, unless they are connected already.
4. Components of the verified links give ``component_id``.

Defined results: null texts and texts without words have no shingles, no links, and their own doc_id as
component; fewer words than a shingle make one shingle of them all; rows with equal doc_ids are separate
documents; a null doc_id joins a component but never names one (null if nothing else is in it).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import blocks as B
from quarry.llm.blocks import shuffle_partitions
from quarry.llm.components import EDGE, Forest, connected_components, contract
from quarry.llm.textvec import PART_ROWS, U64, mix, one_array, parts, rolling, salted, slices
from quarry.session import batch_rows, cut_lineage

_SHINGLE = 0x9FB21C651E98DF25 | 1
SEGMENT_TOKENS = 16           # least (p + q) / (q - p) for segments: below, they would hold too few tokens
SPARE_SEGMENTS = 2            # an empty segment proves nothing: that many may be left out
LEAF, FANOUT = 8, 4
BLOCK_SETS = 1024             # sets of one block of a candidate group,
BLOCK_BYTES = 4 << 20         # and their token bytes, about
CELL_BYTES = 8 << 20          # token bytes gathered by one verifying call, about
BROADCAST_BYTES = 16 << 20
RARE_BLOCK_BYTES = 4 << 20    # of the texts whose tokens a task counts at once: these take some 15 times as much
BATCH_ROWS = 1000             # texts of an Arrow batch, held on both sides
ROW_BYTES = 64                # of a broadcast row, about


# ---------------------------------------------------------------- sets

def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    for _a, _b, w in slices(texts):
        h = w.hashes(lower=True)
        all_runs = rolling(h, n, _SHINGLE)
        for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if hi - lo >= n:
                yield np.unique(all_runs[lo:hi - n + 1])
            elif hi > lo:
                yield salted(rolling(h[lo:hi], hi - lo, _SHINGLE), hi - lo)
            else:
                yield np.zeros(0, U64)


def set_id(tokens: np.ndarray) -> int:
    """A signed 64-bit id of a set."""
    return int(mix(np.array([np.sum(mix(tokens ^ U64(0x5851F42D4C957F2D))) + U64(len(tokens))])).view(np.int64)[0])


# ---------------------------------------------------------------- routing

def size_bounds(p: int, q: int) -> np.ndarray:
    """First size of each class; sizes that a link allows are in the same or the next class."""
    b = [1]
    while b[-1] < 1 << 40:
        b.append(b[-1] * q // p + 1)
    return np.array(b, dtype=np.int64)


def segments_of(level: int, bounds: np.ndarray, p: int, q: int) -> int:
    most = 2 * (int(bounds[level + 2]) - 1)
    return most * (q - p) // (q + p) + 1 + SPARE_SEGMENTS


def routing_keys(tokens: np.ndarray, bounds: np.ndarray, p: int, q: int) -> np.ndarray:
    """One key per segment of the set, at its own size class and the one below."""
    level = int(np.searchsorted(bounds, len(tokens), side="right")) - 1
    total = np.zeros(len(tokens) + 1, dtype=U64)
    np.cumsum(mix(tokens ^ U64(0x2545F4914F6CDD1D)), out=total[1:])
    high = tokens >> U64(32)
    out = []
    for c in (level, level - 1) if level else (level,):
        k = segments_of(c, bounds, p, q)
        cut = np.searchsorted(high, ((np.arange(1, k, dtype=np.uint64) << U64(32)) + U64(k - 1)) // U64(k))
        cut = np.concatenate([[0], cut, [len(tokens)]])
        n = np.diff(cut)
        key = mix(total[cut[1:]] - total[cut[:-1]] + n.astype(U64) * U64(0xFF51AFD7ED558CCD))
        key = mix(key + np.arange(k, dtype=np.uint64) * U64(0xC4CEB9FE1A85EC53) + U64(c << 40))
        out.append(key if int((n == 0).sum()) > SPARE_SEGMENTS else key[n > 0])
    return np.concatenate(out)


def _sets_of(n: int, p: int, q: int):
    bounds = size_bounds(p, q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            ids, sizes = [], []
            for tokens in shingle_sets(batch.column("text"), n):
                ids.append(set_id(tokens) if len(tokens) else None)
                sizes.append(len(tokens))
            level = np.searchsorted(bounds, np.array(sizes, dtype=np.int64), side="right") - 1
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(ids, pa.int64()),
                                   pa.array(sizes, pa.int64()), pa.array(level, pa.int64())],
                                  names=["doc_id", "text_hash", "sid", "n_shingles", "size_class"])
    return run


def _routes_of(n: int, p: int, q: int):
    bounds = size_bounds(p, q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2 * PART_ROWS):
            keys: dict[int, np.ndarray] = {}
            for tokens in shingle_sets(batch.column("text"), n):
                if len(tokens) and (sid := set_id(tokens)) not in keys:
                    keys[sid] = routing_keys(tokens, bounds, p, q)
            if keys:
                yield key_rows(keys)
    return run


def key_rows(keys: dict[int, np.ndarray]) -> pa.RecordBatch:
    """(key, sid) rows; a key seen before in this batch goes on as a link to the first set that had it."""
    key = np.concatenate(list(keys.values())).view(np.int64)
    sid = np.repeat(np.array(list(keys), dtype=np.int64), [len(k) for k in keys.values()])
    first, at = np.unique(key, return_index=True)
    again = np.ones(len(key), dtype=bool)
    again[at] = False
    owner = sid[at][np.searchsorted(first, key[again])]
    pair = np.unique(np.stack([owner, sid[again]], axis=1), axis=0) if again.any() else np.zeros((0, 2), np.int64)
    link = mix(pair[:, 0].astype(U64) * U64(3) + mix(pair[:, 1].astype(U64))).view(np.int64)
    return pa.record_batch([pa.array(np.concatenate([first, link, link])),
                            pa.array(np.concatenate([sid[at], pair[:, 0], pair[:, 1]]))], names=["key", "sid"])


def rare_prefix(tokens: np.ndarray, times: np.ndarray, p: int, q: int) -> np.ndarray:
    """The rarest tokens, as many as a link can't do without, that another set may have too."""
    n = len(tokens) - -(-p * len(tokens) // q) + 1
    order = np.lexsort((tokens, times))[:n]
    return tokens[order][times[order] > 1]


def _rare_routes(texts: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """(key, sid): routing by rare tokens.  Linked sets share one of their ``|A| - ceil(p|A|/q) + 1`` rarest tokens;
    how many documents have a token is counted exactly over buckets of the hash space (:mod:`quarry.llm.blocks`)."""
    n_bytes = B.text_bytes(texts)
    dealt = B.deal(texts, B.n_blocks_for(texts, n_bytes, RARE_BLOCK_BYTES))
    n_buckets = B.n_buckets_for(texts, n_bytes // 5)

    def distinct_sets(table: pa.Table) -> dict[int, np.ndarray]:
        return {set_id(t): t for t in shingle_sets(one_array(table.column("text")), n) if len(t)}

    def items(table: pa.Table):
        sets = list(distinct_sets(table).values())
        return (np.concatenate(sets) if sets else np.zeros(0, U64)), None, None

    def use(table: pa.Table, totals: np.ndarray) -> pa.Table:
        keys, at = {}, 0
        for sid, tokens in distinct_sets(table).items():
            keys[sid] = rare_prefix(tokens, totals[at:at + len(tokens)], p, q)
            at += len(tokens)
        return pa.Table.from_batches([key_rows(keys)]) if keys else pa.table({"key": pa.array([], pa.int64()), "sid": pa.array([], pa.int64())})
    answers = B.answer(B.send(dealt, items, n_buckets))
    return B.receive(dealt, answers, items, n_buckets, use, "key long, sid long")


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between neighbours of equal key; rows come sorted by key."""
    last_key, last = None, None
    for batch in batches:
        key = batch.column("key").to_numpy()
        sid = batch.column("sid").to_numpy()
        if not len(key):
            continue
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        a, b = sid[same - 1], sid[same]
        if last_key is not None and last_key == key[0]:
            a, b = np.append(a, last), np.append(b, sid[0])
        last_key, last = key[-1], sid[-1]
        differ = a != b
        pair = np.unique(np.stack([a[differ], b[differ]], axis=1), axis=0)
        yield pa.record_batch([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


# ---------------------------------------------------------------- signature trees

class Tree:
    """Sets in order of size, leaves of LEAF sets, FANOUT children a node."""

    def __init__(self, sets: list[np.ndarray], ids: list[int], bits: int):
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0]), ids[i]))
        self.sets, self.ids = [sets[i] for i in order], [ids[i] for i in order]
        maps = np.zeros((len(sets), bits // 64), dtype=U64)
        for row, s in zip(maps, self.sets):
            at = s & U64(bits - 1)
            np.bitwise_or.at(row, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
        size = np.array([len(s) for s in self.sets], dtype=np.int64)
        surplus = size - np.bitwise_count(maps).sum(axis=1)
        self.maps, self.size, self.surplus = maps, size, surplus
        # levels[0] are the leaves: OR bitmap, least and largest size, largest surplus
        step = np.arange(0, len(sets), LEAF)
        level = (np.bitwise_or.reduceat(maps, step, axis=0), np.minimum.reduceat(size, step),
                 np.maximum.reduceat(size, step), np.maximum.reduceat(surplus, step))
        self.levels = [level]
        while len(level[1]) > 1:
            step = np.arange(0, len(level[1]), FANOUT)
            level = (np.bitwise_or.reduceat(level[0], step, axis=0), np.minimum.reduceat(level[1], step),
                     np.maximum.reduceat(level[2], step), np.maximum.reduceat(level[3], step))
            self.levels.append(level)

    def children(self, level: int, i: int) -> range:
        return range(i * FANOUT, min((i + 1) * FANOUT, len(self.levels[level - 1][1])))

    def members(self, i: int) -> range:
        return range(i * LEAF, min((i + 1) * LEAF, len(self.sets)))


def may_link(x, y, p: int, q: int) -> bool:
    """Whether any set below node x can link with any below node y; x, y: (bitmap, least, largest, surplus)."""
    if q * x[2] < p * y[1] or q * y[2] < p * x[1]:
        return False
    overlap = min(int(x[2]), int(y[2]), int(np.bitwise_count(x[0] & y[0]).sum()) + int(min(x[3], y[3])))
    return overlap * (p + q) >= p * int(x[1] + y[1])


def linked(a: np.ndarray, b: np.ndarray, p: int, q: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return q * both >= p * (len(a) + len(b) - both)


def dual_traversal(s: Tree, t: Tree, p: int, q: int, forest: Forest) -> Iterator[tuple[int, int]]:
    """Verified links between the trees' sets (s is t: within it) that connect something new."""
    stack = [(len(s.levels) - 1, 0, len(t.levels) - 1, 0)]
    while stack:
        i, x, j, y = stack.pop()
        if s is t and (i, x) == (j, y) and i:
            kids = s.children(i, x)
            stack += [(i - 1, a, i - 1, b) for a, b in product(kids, kids) if a <= b]
            continue
        if not (s is t and (i, x) == (j, y)) and not may_link([v[x] for v in s.levels[i]], [v[y] for v in t.levels[j]], p, q):
            continue
        if i >= j and i:
            stack += [(i - 1, a, j, y) for a in s.children(i, x)]
        elif j:
            stack += [(i, x, j - 1, b) for b in t.children(j, y)]
        else:
            yield from _leaf_pair(s, t, x, y, p, q, forest)


def _leaf_pair(s: Tree, t: Tree, x: int, y: int, p: int, q: int, forest: Forest) -> Iterator[tuple[int, int]]:
    a, b = s.members(x), t.members(y)
    na, nb = s.size[a.start:a.stop, None], t.size[None, b.start:b.stop]
    most = np.bitwise_count(s.maps[a.start:a.stop, None] & t.maps[None, b.start:b.stop]).sum(axis=2) \
        + np.minimum(s.surplus[a.start:a.stop, None], t.surplus[None, b.start:b.stop])
    most = np.minimum(most, np.minimum(na, nb))
    for i, j in zip(*np.nonzero(most * (p + q) >= p * (na + nb))):
        u, v = a[i], b[j]
        if s is t and u >= v:
            continue
        if forest.find(s.ids[u]) != forest.find(t.ids[v]) and linked(s.sets[u], t.sets[v], p, q):
            forest.join(s.ids[u], t.ids[v])
            yield s.ids[u], t.ids[v]


def bitmap_bits(largest: int) -> int:
    return max(256, 1 << min(16, int(2 * largest).bit_length()))


def _verify(p: int, q: int):
    def run(table: pa.Table) -> pa.Table:
        groups: dict[tuple, dict[int, dict[int, np.ndarray]]] = {}
        for g, x, y, mine, sid, raw in zip(*(one_array(table.column(c)) for c in ("grp", "bx", "by", "block", "sid", "tokens"))):
            sides = groups.setdefault((g.as_py(), x.as_py(), y.as_py()), {})
            sides.setdefault(mine.as_py(), {})[sid.as_py()] = np.frombuffer(raw.as_buffer(), dtype=U64)
        a, b = [], []
        for (_g, x, y), sides in groups.items():
            if x not in sides or y not in sides:
                continue
            bits = bitmap_bits(max(len(s) for side in sides.values() for s in side.values()))
            trees = {k: Tree(list(side.values()), list(side), bits) for k, side in sides.items()}
            for u, v in dual_traversal(trees[x], trees[y], p, q, Forest()):
                a.append(u)
                b.append(v)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _tokens_of(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            tokens = [s.tobytes() for s in shingle_sets(batch.column("text"), n)]
            yield pa.record_batch([*(batch.column(c) for c in ("sid", "grp", "block", "others")),
                                   pa.array(tokens, pa.binary())], names=["sid", "grp", "block", "others", "tokens"])
    return run


# ---------------------------------------------------------------- the join

def _labelled(docs: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """(doc_id, text_hash, sid, n_shingles, label): label is the same for all texts of a component."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        sets = cut_lineage(texts.mapInArrow(_sets_of(words, p, q),
                                            "doc_id long, text_hash long, sid long, n_shingles long, size_class long"))

    if p + q >= SEGMENT_TOKENS * (q - p):        # a choice by the threshold alone
        routes = texts.select("text").mapInArrow(_routes_of(words, p, q), "key long, sid long")
    else:
        routes = _rare_routes(texts.select("doc_id", "text"), words, p, q)
    chains = routes.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: contract(_chains(batches)), EDGE)
    groups = cut_lineage(connected_components(chains))
    links = connected_components(_verified(texts, sets, groups, words, p, q))
    links = cut_lineage(links.select(F.col("node").alias("sid"), "component"))
    return sets.join(_small(links), "sid", "left").withColumn("label", F.coalesce("component", "sid"))


def _small(rows: DataFrame) -> DataFrame:
    """A checkpointed table of a few longs a row: broadcast if its size allows, an ordinary join beyond that."""
    return F.broadcast(rows) if rows.count() * ROW_BYTES <= BROADCAST_BYTES else rows


def jaccard_components(docs: DataFrame, words: int = 3, p: int = 90, q: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (columns doc_id, text)."""
    named = _labelled(docs, words, p, q)
    shared = cut_lineage(named.where("sid is not null").groupBy("label").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return named.join(_small(shared), "label", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, words: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """The rows of ``docs`` without the copies: of each component the row with the least doc_id (null last), then
    text hash, stays; of rows equal in both, any one.  Texts without words all stay."""
    named = _labelled(docs, words, p, q).where("sid is not null")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    stays = cut_lineage(named.groupBy("label").agg(F.min(place).alias("stays"), F.count(F.lit(1)).alias("of")).where("of > 1"))
    keys = cut_lineage(named.join(_small(stays), "label").groupBy("doc_id", "text_hash").agg(
        F.max(place.eqNullSafe(F.col("stays"))).alias("first"), F.count(F.lit(1)).alias("n"))
        .select(F.col("doc_id").alias("_st_d"), F.col("text_hash").alias("_st_h"), "first", "n").where("not first or n > 1"))
    n_equal = keys.where("first").count()
    marked = docs.withColumn("_st_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_st_d")) & (F.col("_st_hash") == F.col("_st_h"))
    out = marked.join(_small(keys), same, "left_anti").select(*docs.columns)
    if n_equal:                     # whole rows that repeat: one of each
        again = marked.join(keys.where("first"), same, "left_semi")
        out = out.unionByName(again.dropDuplicates(["doc_id", "_st_hash"]).select(*docs.columns))
    return out


def _verified(texts: DataFrame, sets: DataFrame, groups: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """Verified links (a, b) between the sets of each candidate group."""
    one = sets.where("sid is not null").groupBy("sid").agg(      # of equal sets, the row with the least (doc_id, text)
        F.min(F.struct("doc_id", "text_hash", "n_shingles", "size_class")).alias("r")).select("sid", "r.*")
    members = cut_lineage(groups.select(F.col("node").alias("sid"), F.col("component").alias("grp")).join(one, "sid"))
    blocks = members.groupBy("grp", "size_class").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("bigint").alias("m"))
    near = blocks.select("grp", F.col("m").alias("near_m"), F.col("size_class").alias("near_class"),
                         F.explode(F.array(*[F.col("size_class") + d for d in (-1, 0, 1)])).alias("size_class"))
    name = lambda c, i: c.cast("bigint") * (1 << 40) + i
    placed = members.join(blocks, ["grp", "size_class"]).withColumn(
        "block", name(F.col("size_class"), F.pmod("sid", "m"))).drop("m")
    other = F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("near_m") - 1),
                                  lambda i: name(F.col("near_class"), i)))
    paired = cut_lineage(placed.join(near, ["grp", "size_class"]).select(
        "sid", "doc_id", "text_hash", "grp", "block", "n_shingles", other.alias("other"))
        .groupBy("sid", "doc_id", "text_hash", "grp", "block", "n_shingles")
        .agg(F.collect_list("other").alias("others")))
    n_rows, n_bytes = paired.agg(F.count(F.lit(1)), F.sum(F.col("n_shingles") * 8 * F.size("others"))).first()
    n_cells = max(4 * shuffle_partitions(texts), math.ceil((n_bytes or 0) / CELL_BYTES))
    wanted = paired.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "sid", "grp", "block", "others")
    if n_rows * ROW_BYTES <= BROADCAST_BYTES:      # beyond that, an ordinary join
        wanted = F.broadcast(wanted)
    schema = "sid long, grp long, block long, others array<long>, tokens binary"
    tokens = texts.join(wanted, texts.doc_id.eqNullSafe(F.col("d")) & (texts.text_hash == F.col("h"))) \
        .select("text", "sid", "grp", "block", "others").mapInArrow(_tokens_of(words), schema)
    rows = tokens.select("sid", "grp", "block", "tokens", F.explode("others").alias("other")) \
        .withColumn("bx", F.least("block", "other")).withColumn("by", F.greatest("block", "other")).drop("other")
    cell = F.pmod(F.xxhash64("grp", "bx", "by"), F.lit(n_cells)).cast("int")
    return rows.withColumn("cell", cell).groupBy("cell").applyInArrow(_verify(p, q), EDGE)
