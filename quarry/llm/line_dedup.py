"""Fuzzy line dedup: near-equal lines of the whole corpus form groups, and each group keeps one line.

Lines (cut at ``\\n``) are normalised: A-Z lower-cased, white space collapsed.  Equal normalised lines are one
node, counted by a partial aggregate, so a line that stands in a third of all documents costs a row per task.
Every node has a 64-bit SimHash of its distinct words.  Two nodes link when their SimHashes differ in at most three
bits and their edit similarity, ``1 - levenshtein / longer length``, is 0.8 or more.  Pigeonhole: three bits
spoil at most three of five blocks, so two blocks agree; joining on all ten pairs of blocks (25 or 26 bits)
misses no link.  Lines whose SimHashes are connected are compared in tasks of bounded blocks, which leave out pairs
that are connected already: no pairs of a whole group are listed.  Components of the links are the groups; the first occurrence in the order (doc_id, text
hash, line number) stays, all others go.

Defined results: null texts stay null, empty texts empty; blank lines always stay; lines of fewer than
``min_words`` words link to equal ones only, and always stay if they have fewer than ``exact_words`` too; rows with null doc_id come last in the order; rows equal in doc_id and text are treated
alike; a text whose lines all go becomes empty.  Other columns pass through; n_lines and n_removed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected_components, contract
from quarry.llm.textvec import U64, buffers, inverse, mix, parts, powers, slices
from quarry.session import batch_rows, cut_lineage

MIN_WORDS = 4
SIMILARITY = 0.8
MOST_BITS = 3                                   # of difference between linked SimHashes
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))      # (shift, width): MOST_BITS + 2 of them
BROADCAST_BYTES = 16 << 20
BATCH_ROWS = 1000                               # texts of an Arrow batch, held on both sides
BLOCK_LINES = 2048                              # of a group, compared in one task
_LINE = 0xB5297A4D3F84D5B5 | 1
OCCURRENCE = "doc_id long, text_hash long, line int, node long, sim long, fuzzy boolean"


def simhash(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit SimHash of the distinct words of runs of word hashes; ``first``: where the runs begin.

    Each word counts once a line: common words would otherwise decide the bits of all long lines."""
    out = []
    size = np.diff(np.append(first, len(words)))
    for at in range(0, len(first), 1 << 20):                     # 20 bits number the run, 44 tell the word
        n = size[at:at + (1 << 20)]
        lo = int(first[at])
        run = np.repeat(np.arange(len(n), dtype=np.uint64), n)
        key = np.unique(run << U64(44) | words[lo:lo + int(n.sum())] >> U64(20))
        bits = np.unpackbits(mix(key & U64((1 << 44) - 1)).view(np.uint8).reshape(-1, 8), axis=1)
        begin = np.searchsorted(key, np.arange(len(n), dtype=np.uint64) << U64(44))
        ones = np.add.reduceat(bits, begin, axis=0, dtype=np.uint32)
        distinct = np.diff(np.append(begin, len(key))).astype(np.uint32)
        out.append(np.packbits(2 * ones > distinct[:, None], axis=1).view(U64).ravel())
    return np.concatenate(out)


def lines_of(texts: pa.Array, min_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, line number, node, SimHash, number of words) of the lines with at least ``min_words`` words."""
    for at, _to, w in slices(texts):
        if not len(w.start):
            continue
        h = w.hashes(lower=True)
        breaks = np.flatnonzero(w.data == 10)
        n = np.diff(w.first)
        doc = np.repeat(np.arange(len(n)), n)
        line = np.searchsorted(breaks, w.start)
        line -= np.searchsorted(breaks, _offsets(texts, at, len(n)))[doc]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(h)))
        total = np.zeros(len(h) + 1, dtype=U64)
        np.cumsum(h * powers(inverse(_LINE), len(h)), out=total[1:])
        node = mix((total[first + size] - total[first]) * powers(_LINE, len(h))[first] + size.astype(U64))
        keep = size >= min_words
        yield doc[first][keep] + at, line[first][keep], node[keep], simhash(h, first)[keep], size[keep]


def _offsets(texts: pa.Array, at: int, n: int) -> np.ndarray:
    """Byte offsets of ``n`` texts from number ``at`` on, from the first of them."""
    return buffers(texts.slice(at, n))[1][:-1]


def _occurrences(min_words: int, exact_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for doc, line, node, sim, size in lines_of(batch.column("text"), min(min_words, exact_words)):
                at = pa.array(doc)
                yield pa.record_batch(
                    [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(line, pa.int32()),
                     pa.array(node.view(np.int64)), pa.array(sim.view(np.int64)), pa.array(size >= min_words)],
                    names=["doc_id", "text_hash", "line", "node", "sim", "fuzzy"])
    return run


def block_keys(sim: Column) -> Column:
    """The ten pairs of blocks of a SimHash, as longs."""
    def block(i: int) -> Column:
        shift, width = BLOCKS[i]
        return F.shiftrightunsigned(sim, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
    return F.array(*[F.lit(no << 32).cast("bigint") + block(i) * (1 << 13) + block(j)
                     for no, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of SimHashes that share a key (rows come sorted by key), a spanning forest of those within MOST_BITS bits."""
    key, sims = np.zeros(0, np.int64), np.zeros(0, U64)
    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy()])
        sims = np.concatenate([sims, batch.column("sim").to_numpy().view(U64)])
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0        # the last run may go on
        yield _forest(key[:last], sims[:last])
        key, sims = key[last:], sims[last:]
    yield _forest(key, sims)


def _forest(key: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    two = begin[size == 2]
    two = two[np.bitwise_count(sims[two] ^ sims[two + 1]) <= MOST_BITS]
    a, b = [sims[two]], [sims[two + 1]]
    for at, n in zip(begin[size > 2], size[size > 2]):
        run = sims[at:at + n]
        links = list(spanning(run, lambda i, j: True))
        a.append(run[[i for i, _ in links]])
        b.append(run[[j for _, j in links]])
    return pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])


def spanning(sims: np.ndarray, similar, right: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links (i, j) that connect all that links connect: SimHashes within MOST_BITS bits and ``similar(i, j)``.
    Pairs that are connected already are not looked at.  ``right``: only links between these and the others."""
    label = np.arange(len(sims))
    other = np.zeros(len(sims), dtype=bool) if right is None else right
    for i in np.arange(len(sims)) if right is None else np.flatnonzero(~other):
        open_ = (np.bitwise_count(sims ^ sims[i]) <= MOST_BITS) & (label != label[i])
        open_ &= np.arange(len(sims)) > i if right is None else other
        while len(found := np.flatnonzero(open_)):
            j = int(found[0])
            open_[j] = False
            if similar(int(i), j):
                label[label == label[j]] = label[i]
                open_ &= label != label[i]
                yield int(i), j


def near_groups(nodes: DataFrame) -> DataFrame:
    """(sim, grp) of the distinct SimHashes that have another one within MOST_BITS bits, connected."""
    sims = nodes.select("sim").distinct()
    keyed = sims.select(F.explode(block_keys(F.col("sim"))).alias("key"), "sim")
    edges = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: contract(_near(batches)), "a long, b long")
    return connected_components(edges).select(F.col("node").alias("sim"), F.col("component").alias("grp"))


def levenshtein(a: str, b: str) -> int:
    """Edit distance, bit-parallel over the shorter text, without their common ends."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    lo, hi = 0, len(b)
    while lo < hi:                                             # common prefix
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, len(b)
    while lo < hi:                                             # common suffix
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid:] == b[len(b) - mid:] else (lo, mid - 1)
    a, b = a[:len(a) - lo], b[:len(b) - lo]
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for i, ch in enumerate(b):
        where[ch] = where.get(ch, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << len(b) - 1
    up, down, score = full, 0, len(b)                          # vertical steps of +1 and -1
    for ch in a:
        eq = where.get(ch, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(across | up) & full, up & across
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical & full
    return score


def similar_lines(x: str, y: str, share: float) -> bool:
    most = int((1 - share) * max(len(x), len(y)) + 1e-9)
    return abs(len(x) - len(y)) <= most and levenshtein(x, y) <= most


def normalised(line: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.trim(F.regexp_replace(F.translate(line, upper, upper.lower()), "[ \\t\\x0B\\f\\r]+", " "))


def _small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """Marked for broadcast if its measured size allows; an ordinary join otherwise."""
    size = df.agg(F.sum(row_bytes.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _with_lines(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, text_hash, line and more) with ``words``, the normalised line."""
    more = [c for c in wanted.columns if c not in ("doc_id", "text_hash", "line")]
    by_doc = cut_lineage(wanted.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(
        F.collect_list(F.struct("line", *more)).alias("asked")))
    found = texts.join(_small(by_doc, F.size("asked") * 48 + 40), _same_doc())
    row = F.split("text", "\n", -1)
    return found.select(F.explode(F.transform("asked", lambda w: F.struct(
        *[w[c].alias(c) for c in more], normalised(F.get(row, w["line"])).alias("words")))).alias("s")).select("s.*")


def _verify(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        tasks: dict[tuple, dict[int, tuple]] = {}
        for g, x, y, block, node, sim, words in zip(*(table.column(c).to_pylist() for c in (
                "grp", "bx", "by", "block", "node", "sim", "words"))):
            tasks.setdefault((g, x, y), {})[node] = (block, sim, words)
        a, b = [], []
        for (_g, x, y), members in tasks.items():
            nodes = sorted(members)
            sims = np.array([members[n][1] for n in nodes], dtype=np.int64).view(U64)
            lines = [members[n][2] for n in nodes]
            right = None if x == y else np.array([members[n][0] == y for n in nodes])
            for i, j in spanning(sims, lambda i, j: similar_lines(lines[i], lines[j], similarity), right):  # noqa: B023
                a.append(nodes[i])
                b.append(nodes[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def links(texts: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between nodes: enough of them to connect all that links connect."""
    groups = cut_lineage(near_groups(nodes))
    named = cut_lineage(nodes.join(_small(groups, F.lit(24)), "sim", "left").select(
        "node", "sim", "place", F.coalesce("grp", "sim").alias("grp")))
    sizes = cut_lineage(named.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = named.join(_small(sizes, F.lit(24)), "grp").withColumn("m", F.ceil(F.col("n") / BLOCK_LINES).cast("bigint"))
    wanted = members.select("node", "sim", "grp", F.pmod("node", "m").alias("block"), "m",
                            "place.doc_id", "place.text_hash", "place.line")
    lines = _with_lines(texts, wanted)
    # every pair of a group's blocks is a task of its own
    rows = lines.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1))) \
        .withColumn("bx", F.least("block", "other")).withColumn("by", F.greatest("block", "other")).drop("other", "m")
    n = wanted.agg(F.sum("m")).first()[0] or 0
    n_cells = max(2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK_LINES))
    cell = F.pmod(F.xxhash64("grp", "bx", "by"), F.lit(n_cells)).cast("int")
    return rows.withColumn("cell", cell).groupBy("cell").applyInArrow(_verify(similarity), "a long, b long")


def _same_doc() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))


def removals(texts: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY,
             exact_words: int | None = None) -> DataFrame:
    """(d, h, removed): line numbers to remove of each text (doc_id d, text hash h) that loses any."""
    with batch_rows(texts.sparkSession, BATCH_ROWS):
        seen = cut_lineage(texts.mapInArrow(_occurrences(min_words, min_words if exact_words is None else exact_words), OCCURRENCE))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "line")
    nodes = cut_lineage(seen.groupBy("node").agg(F.max("sim").alias("sim"), F.min(place).alias("place"),
                                                 F.count(F.lit(1)).alias("n"), F.max("fuzzy").alias("fuzzy")))
    groups = cut_lineage(connected_components(links(texts, nodes.where("fuzzy"), similarity)))
    named = nodes.join(_small(groups, F.lit(24)), "node", "left").withColumn("grp", F.coalesce("component", "node"))
    kept = cut_lineage(named.groupBy("grp").agg(F.min("place").alias("stays"), F.sum("n").alias("n")).where("n > 1"))
    doomed = cut_lineage(named.join(_small(kept, F.lit(64)), "grp").select("node", "stays"))
    gone = seen.join(_small(doomed, F.lit(64)), "node").where(~place.eqNullSafe(F.col("stays")))
    return gone.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(
        F.collect_set("line").alias("removed"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY,
                exact_words: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) without the removed lines; adds n_lines and n_removed.
    Lines of ``exact_words`` words or more (``min_words`` if not given) go when they are equal to one that stays."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    gone = cut_lineage(removals(texts, min_words, similarity, exact_words))
    gone = _small(gone, F.size("removed") * 4 + 40).withColumnsRenamed({"d": "_ld_d", "h": "_ld_h", "removed": "_ld_removed"})
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = F.split("text", "\n", -1)
    joined = docs.select(*names).join(gone, F.col("doc_id").eqNullSafe(F.col("_ld_d")) & (F.xxhash64("text") == F.col("_ld_h")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(rows) - 1), F.col("_ld_removed"))
    cleaned = F.when(F.col("_ld_removed").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(rows, i)), "\n"))
    return joined.select(*[cleaned.alias(c) if c == "text" else F.col(c) for c in names],
                         F.when(F.col("text").isNull(), 0).otherwise(F.size(rows)).cast("bigint").alias("n_lines"),
                         F.when(F.col("_ld_removed").isNull(), 0).otherwise(F.size("_ld_removed")).cast("bigint").alias("n_removed"))
