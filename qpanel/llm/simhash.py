"""SimHash near-duplicates by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import as_bytes, batch, spread_join, written

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Fingerprints in one trie pair; larger ones are split at deeper nodes.
MOST_IN_PAIR = 50_000
#: Bits by which a large pair is split.
STEP = 4
#: Shingles that are hashed at once, and rows of a joining task.
SHINGLES, TASK_ROWS = 20_000, 150_000
#: Node pairs of a traversal's level, and fingerprint pairs compared, that are held at once.
FRONTIER = 1_000_000


@dataclass(frozen=True)
class Scheme:
    """Words of a shingle, 64-bit words of a fingerprint, differing bits of a link, bits of a leading block, and how many blocks lead in turn.

    Two fingerprints within fewer bits than there are blocks agree on one block at least,
    so the join is complete where budget < turns. Where it isn't, pairs nearer than turns
    bits are all found, and those beyond it with the chance that some block agrees.
    """

    width: int = 3
    words: int = 1
    budget: int = 3
    lead: int = 16
    turns: int = 4


#: The query's scheme, and that of a stage on five-word shingles: 155 of 1,024 bits differ at a Jaccard similarity of 0.8 (a cosine of 8/9), and half a deviation more are let through.
QUERY, SIMILAR = Scheme(), Scheme(width=5, words=16, budget=160, lead=14, turns=36)


def fingerprint(text: bytes, scheme: Scheme = QUERY) -> bytes:
    """Bit by bit the majority of the hashes of the shingles, repeats included; the first word is that of XXH64 (seed 42), others mix it anew. Big-endian."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return bytes(8 * scheme.words)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > scheme.width:
        starts, ends = starts[: 1 - scheme.width], ends[scheme.width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64 * scheme.words, dtype=np.int64)
    for at in range(0, len(starts), SHINGLES):
        pairs = zip(starts[at : at + SHINGLES].tolist(), ends[at : at + SHINGLES].tolist())
        h = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in pairs), dtype=np.uint64)
        each = np.empty((len(h), scheme.words), dtype=">u8")
        for k in range(scheme.words):
            each[:, k] = h if k == 0 else mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
        bits = np.unpackbits(each.view(np.uint8).reshape(len(h), -1), axis=1)
        # sums of up to 255 rows fit a byte
        full = len(bits) // 255 * 255
        ones += bits[:full].reshape(-1, 255, len(ones)).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(starts)).tobytes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = QUERY) -> DataFrame:
    """_id and fp, the fingerprint's bytes."""
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("id", pa.string()), ("fp", pa.binary())])

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, b.column(0), [fingerprint(t, scheme) for t in as_bytes(b.column(1))])

    df = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(hash_texts, "id string, fp binary")
    return df.select(F.col("id").cast(kind).alias("_id"), "fp")


class Forest:
    """The links of one task's tries: a spanning forest over the positions of its fingerprints.

    A node of a trie is a range of the sorted keys, its children that range cut at the
    next bit. Pairs of nodes go down together, level by level; a pair's errors grow by
    one where its bits differ. A pair ends beyond the budget, or if all its fingerprints
    are in one tree already. Small pairs are compared in full. Within groups of side 0
    all pairs count, in the others those between sides 1 and 2.
    """

    def __init__(self, group: np.ndarray, side: np.ndarray, low: np.ndarray, prints: np.ndarray, budget: int, bits: int):
        self.order = np.lexsort((low, side, group))
        self.group, self.side, self.low, self.prints = group[self.order], side[self.order], low[self.order], prints[self.order]
        self.budget, self.bits = budget, bits
        self.parent = np.arange(len(low))
        if len(low):
            self.neighbours()
            self.descend()

    def runs(self) -> None:
        """Where the trees change along the order: a range of one run is in one tree."""
        self.run = np.cumsum(np.r_[0, self.parent[1:] != self.parent[:-1]])

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parent = united(self.parent, a, b)

    def neighbours(self) -> None:
        """Links of neighbours in the order, which bring most of a large group of near copies into few trees."""
        at = np.arange(len(self.low))
        for step in (1, 2, 3):
            a, b = at[:-step], at[step:]
            near = (self.group[a] == self.group[b]) & (self.side[a] == 0)
            self.compare(a[near], b[near])

    def descend(self) -> None:
        n, group, side, low = len(self.low), self.group, self.side, self.low
        first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])])
        last = np.r_[first[1:], n]
        own = side[first] == 0
        left = np.flatnonzero(side[first] == 1)
        left = left[(left + 1 < len(first))]
        left = left[(group[first[left]] == group[first[left + 1]]) & (side[first[left + 1]] == 2)] if len(left) else left
        start = [np.r_[first[own], first[left]], np.r_[last[own], last[left]], np.r_[first[own], first[left + 1]], np.r_[last[own], last[left + 1]]]
        stack = [(self.bits - 1, *start, np.zeros(len(start[0]), np.int16))]
        while stack:
            bit, alo, ahi, blo, bhi, err = stack.pop()
            if len(alo) > FRONTIER:
                for at in range(0, len(alo), FRONTIER // 4):
                    stack.append((bit, *(x[at : at + FRONTIER // 4] for x in (alo, ahi, blo, bhi, err))))
                continue
            self.runs()
            run, root = self.run, self.parent
            apart = (run[alo] != run[ahi - 1]) | (run[blo] != run[bhi - 1]) | (root[alo] != root[blo])
            alo, ahi, blo, bhi, err = (x[apart] for x in (alo, ahi, blo, bhi, err))
            small = ((ahi - alo) * (bhi - blo) <= 32) | (bit < 0)
            self.compare_nodes(alo[small], ahi[small], blo[small], bhi[small])
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
            if not len(alo):
                continue
            ones = np.r_[0, np.cumsum(low >> np.uint64(bit) & np.uint64(1), dtype=np.int64)]
            amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
            cross = alo != blo
            down = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1), tuple(x[cross] for x in (amid, ahi, blo, bmid, err + 1))]
            alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*down))
            alive = (ahi > alo) & (bhi > blo) & (err <= self.budget) & ~((alo == blo) & (ahi - alo == 1))
            stack.append((bit - 1, *(x[alive] for x in (alo, ahi, blo, bhi, err))))

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.parent[a] != self.parent[b]
        a, b = a[apart], b[apart]
        errors = np.zeros(len(a), np.int16)
        for k in range(self.prints.shape[1]):
            errors = errors + np.bitwise_count(self.prints[a, k] ^ self.prints[b, k])
            near = errors <= self.budget
            a, b, errors = a[near], b[near], errors[near]
        if len(a):
            self.unite(a, b)

    def compare_nodes(self, alo, ahi, blo, bhi) -> None:
        """All fingerprints of small node pairs against each other, in blocks."""
        sizes = (ahi - alo) * (bhi - blo)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FRONTIER, side="right")))
            s = sizes[at:upto]
            pair = np.repeat(np.arange(at, upto), s)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(s) - s, s)
            width = (bhi - blo)[pair]
            a, b = alo[pair] + k // width, blo[pair] + k % width
            once = (a < b) | (alo[pair] != blo[pair])
            self.compare(a[once], b[once])
            at = upto

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions, as they came, of each member that is not a root, and of its root."""
        child = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return self.order[child], self.order[self.parent[child]]


def united(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent, with its forest joined along the pairs a, b; roots are the smallest members."""
    while True:
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(pa_, pb)[apart], np.minimum(pa_, pb)[apart])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def turned(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """turn, x and fp: the first word of each rotation of each fingerprint, as a long."""
    schema = pa.schema([("turn", pa.int32()), ("x", pa.int64()), ("fp", pa.binary())])
    words, lead, turns = scheme.words, scheme.lead, scheme.turns

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, words)
            for k in range(turns):
                at, off = divmod(lead * k, 64)
                x = w[:, at % words]
                if off:
                    x = (x << np.uint64(off)) | (w[:, (at + 1) % words] >> np.uint64(64 - off))
                yield batch(schema, pa.array(np.full(len(x), k, np.int32)), pa.array(np.ascontiguousarray(x).view(np.int64)), b.column(0).cast(pa.binary()))

    return fps.select("fp").mapInArrow(turn, "turn int, x long, fp binary")


def links(fps: DataFrame, scheme: Scheme = QUERY, most_in_pair: int = MOST_IN_PAIR) -> DataFrame:
    """Edges (a, b), a > b, that connect the distinct fingerprints fp within the scheme's budget.

    Each block in turn leads: fingerprints that agree on it share a subtree of the trie
    of that rotation, in which the whole budget is left. Subtrees with more than
    most_in_pair fingerprints are replaced by the pairs of their nodes STEP bits deeper
    that exist and whose prefixes differ by no more than the budget, as often as needed. Each task
    joins the tries of its share and returns a spanning forest of the links found, never
    the pairs themselves. The number of tasks grows with the rows that the splits leave.
    """
    lead, budget, words = scheme.lead, scheme.budget, scheme.words
    n_rows = fps.count() * scheme.turns
    p = F.shiftrightunsigned("x", 64 - lead)
    rows = turned(fps, scheme).select("turn", F.lit(lead).alias("depth"), p.alias("p"), p.alias("q"), F.lit(0).alias("side"), "x", "fp")
    key, done = ["turn", "depth", "p", "q"], []
    for depth in range(lead, 64 - STEP + 1, STEP):
        sizes = written(rows.groupBy(*key).count().filter(F.col("count") > most_in_pair))
        large = sizes.agg(F.sum("count")).first()[0]
        if not large:
            break
        sizes = sizes.select(*key)
        done.append(rows.join(sizes, key, "left_anti"))
        rows = written(deeper(rows.join(sizes, key, "left_semi"), depth + STEP, budget))
        n_rows += rows.count() - large
    for r in done:
        rows = rows.unionByName(r)

    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, fps = [], []
        for b in batches:
            parts.append([c.to_numpy(zero_copy_only=False) for c in b.columns[:-1]])
            fps.append(b"".join(b.column(b.num_columns - 1).to_pylist()))
        if not parts:
            return
        turn, depth, p, q, side, x = (np.concatenate(c) for c in zip(*parts))
        keys = np.stack([turn.astype(np.int64), depth.astype(np.int64), p, q], axis=1)
        group = np.unique(keys, axis=0, return_inverse=True)[1].reshape(-1)
        prints = np.frombuffer(b"".join(fps), dtype=">u8").reshape(-1, words)
        del keys, p, q, parts, fps
        forest = Forest(group, side, x.view(np.uint64) & np.uint64(2 ** (64 - lead) - 1), prints.astype(np.uint64), budget, 64 - lead)
        child, root = forest.edges()
        for at in range(0, len(child), 100_000):
            a, b = prints[child[at : at + 100_000]], prints[root[at : at + 100_000]]
            first = [max(x.tobytes(), y.tobytes()) for x, y in zip(a, b)]
            yield batch(schema, first, [min(x.tobytes(), y.tobytes()) for x, y in zip(a, b)])

    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // TASK_ROWS))
    return rows.repartition(tasks, *key).select(*key, "side", "x", "fp").mapInArrow(join, "a binary, b binary").filter("a > b")


def deeper(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    """rows dealt to the node pairs at depth below theirs that the budget allows, of nodes that have rows.

    A group has 2**STEP nodes on a side at most, so its pairs are few, whatever its rows.
    """
    key = ["turn", "depth", "p", "q"]
    rows = rows.withColumn("own", F.shiftrightunsigned("x", 64 - depth))
    nodes = written(rows.select(*key, "side", "own").distinct())
    a, b = (nodes.select(*key, F.col("side").alias(f"side_{k}"), F.col("own").alias(k)) for k in "uv")
    within = (F.col("side_u") == 0) & (F.col("side_v") == 0) & (F.col("u") <= F.col("v"))
    pairs = a.join(b, key).filter((within | ((F.col("side_u") == 1) & (F.col("side_v") == 2))) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= budget))
    same = (F.col("side_u") == 0) & (F.col("u") == F.col("v"))
    first = pairs.select(*key, F.col("side_u").alias("side"), F.col("u").alias("own"), "u", "v", F.when(same, 0).otherwise(1).alias("to"))
    second = pairs.filter(~same).select(*key, F.col("side_v").alias("side"), F.col("v").alias("own"), "u", "v", F.lit(2).alias("to"))
    df = rows.join(written(first.unionByName(second)), [*key, "side", "own"])
    return df.select("turn", F.lit(depth).alias("depth"), F.col("u").alias("p"), F.col("v").alias("q"), F.col("to").alias("side"), "x", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = QUERY, most_in_pair: int = MOST_IN_PAIR) -> DataFrame:
    """The fingerprint of each document and the smallest id reachable over links of the scheme.

    Texts are lower-cased (A-Z only) and cut into words; a text with fewer words than a
    shingle is one shingle, one without words (null, empty) has fingerprint 0, linked
    like any other. Equal fingerprints are one node of the graph, so copies are never
    compared with each other. Null ids never name a component unless all ids in it are
    null; repeated rows are returned each; columns beside id_col and text_col, whatever
    their names, are not read; an empty table gives an empty result.
    Returns id_col, fingerprint (hexadecimal digits), component_id.
    """
    found = written(fingerprints(docs, id_col, text_col, scheme))
    nodes = written(found.groupBy("fp").agg(F.min("_id").alias("least")))
    roots = written(components(links(nodes.select("fp"), scheme, most_in_pair)))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = spread_join(named.select("fp", "root"), least, "root").select("fp", "component_id")
    return spread_join(found, written(by_fp), "fp").select(F.col("_id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = SIMILAR) -> DataFrame:
    """The rows of docs whose id is the smallest of the component of one of its rows, with all their columns.

    Rows with a null id stay, null and empty texts are copies of each other, rows that
    repeat an id stay or go together; other columns may have any names; an empty table
    gives an empty result.
    """
    found = near_duplicates(docs, id_col, text_col, scheme).filter(F.col(id_col).isNotNull())
    away = found.groupBy(F.col(id_col).alias("_away")).agg(F.max(F.col(id_col) == F.col("component_id")).alias("_stays")).filter(~F.col("_stays"))
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.join(written(away.select("_away")), F.col("_id") == F.col("_away"), "left_anti").select("_row.*")
