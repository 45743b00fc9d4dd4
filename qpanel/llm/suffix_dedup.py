"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered by their first THRESHOLD bytes only, in passes of digits: first the
GRAM bytes at an anchor, then all that the THRESHOLD-byte strings around the anchor can
reach, then the strings themselves. A pass sorts just those suffixes that the passes
before left in a group with others, and groups that are equal at full depth are the
repeated strings.

Only equality matters, so digits travel as hashes of their bytes. The first is a 64-bit
fingerprint, which only says what is to be compared; those that decide are 128-bit
BLAKE2b digests, so that equal digests are equal bytes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, batch

#: Length of the strings, and of the first digit.
THRESHOLD, GRAM = 200, 100
REACH = THRESHOLD - GRAM
#: Bytes of text in a chunk, string starts handled at once, and bytes of text for each sorting task.
CHUNK, BLOCK, PART = 3_000_000, 250_000, 64_000_000
NONE, WHOLE, SEND, BOTH = 0, 1, 2, 3

_rng = np.random.Generator(np.random.PCG64(20))
BYTES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, dtype=np.uint64)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def first_digit(anchor: np.ndarray, digit) -> np.ndarray:
    """Fingerprint of the GRAM bytes at an anchor, mixed anew: those that were smallest would otherwise all go to one sorting task."""
    return mixed(digit(anchor, anchor + GRAM) + np.uint64(0x94D049BB133111EB))


class Chunk:
    """The texts of a chunk in one buffer, visited in blocks of string starts."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.bytes = b"".join(texts)
        self.data = np.frombuffer(self.bytes, dtype=np.uint8)
        self.valid = np.zeros(len(self.data), dtype=bool)
        for a, b in zip(self.starts.tolist(), self.ends.tolist()):
            if b - a >= THRESHOLD:
                self.valid[a : b - THRESHOLD + 1] = True
        length = min(len(self.data), BLOCK + REACH + 2 * THRESHOLD) + 1
        self.up, self.down = powers(BASE, length), powers(INVERSE, length)

    def blocks(self) -> Iterator[tuple]:
        """For each block: its string starts, the anchor of each, and a function that fingerprints [a, b).

        A string's anchor is, among the GRAM-byte strings in it, the leftmost with the
        smallest fingerprint: equal strings have it at the same place.
        """
        n = len(self.data)
        for at in range(0, n, BLOCK):
            starts = np.flatnonzero(self.valid[at : at + BLOCK]) + at
            if not len(starts):
                continue
            lo, hi = max(0, int(starts[0]) - REACH), min(n, int(starts[-1]) + REACH + THRESHOLD + 1)
            part = self.data[lo:hi]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(BYTES[part] * self.up[: len(part)], out=sums[1:])

            def digit(a: np.ndarray, b: np.ndarray, sums=sums, lo=lo) -> np.ndarray:
                return mixed((sums[b - lo] - sums[a - lo]) * self.down[a - lo])

            grams = len(part) - GRAM + 1
            key = mixed((sums[GRAM:] - sums[:grams]) * self.down[:grams])
            key &= np.uint64(0xFFFFFFFFFF000000)
            key |= np.arange(grams, dtype=np.uint64)
            width, least = 1, key
            while 2 * width <= REACH + 1:
                least = np.minimum(least[: len(least) - width], least[width:])
                width *= 2
            if width < REACH + 1:
                more = REACH + 1 - width
                least = np.minimum(least[: len(least) - more], least[more:])
            anchor = (least[starts - lo] & np.uint64(0xFFFFFF)).astype(np.int64) + lo
            yield starts, anchor, digit

    def around(self, anchor: np.ndarray) -> np.ndarray:
        """Digests of all that strings with these anchors can reach in their texts, and of how far that is: two words each, never zero."""
        k = np.searchsorted(self.ends, anchor, side="right")
        a, b = np.maximum(anchor - REACH, self.starts[k]), np.minimum(anchor + THRESHOLD, self.ends[k])
        data, digest = self.bytes, hashlib.blake2b
        keys = [bytes((x - i, j - x)) for x, i, j in zip(anchor.tolist(), a.tolist(), b.tolist())]
        found = b"".join([digest(data[i:j], digest_size=16, salt=key).digest() for i, j, key in zip(a.tolist(), b.tolist(), keys)])
        return np.frombuffer(found, np.uint64).reshape(-1, 2) | np.uint64(1)

    def anchors(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each anchor once, with its first digit, block by block."""
        last = -1
        for _, anchor, digit in self.blocks():
            a = np.unique(anchor)
            a = a[a > last]
            if len(a):
                last = a[-1]
                yield a, first_digit(a, digit)

    def digits(self) -> np.ndarray:
        """The first digits that occur, in order."""
        found = [f for _, f in self.anchors()]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each first digit once, with its second digit's two words (0: several) and whether the pair occurs again."""
        found = [(f, self.around(a)) for a, f in self.anchors()]
        first = np.concatenate([f for f, _ in found]) if found else np.zeros(0, np.uint64)
        second = np.concatenate([s for _, s in found]) if found else np.zeros((0, 2), np.uint64)
        order = np.lexsort((second[:, 1], second[:, 0], first))
        first, second = first[order], second[order]
        new = np.r_[True, first[1:] != first[:-1]] if len(first) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        counts = np.diff(np.r_[at, len(first)])
        # sorted by all words: a group's first and last are equal if all are
        same = (second[at] == second[at + counts - 1]).all(axis=1)
        second = np.where(same[:, None], second[at], np.uint64(0))
        return first[at], second[:, 0].copy(), second[:, 1].copy(), (counts > 1).astype(np.uint8)

    def strings(self, digits: np.ndarray, states: np.ndarray, mark: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Marks strings whose anchor is in state WHOLE or BOTH; starts and digests of those to send."""
        data, digest = self.bytes, hashlib.blake2b
        for starts, anchor, digit in self.blocks():
            if not len(digits):
                return
            a, back = np.unique(anchor, return_inverse=True)
            state = states[np.searchsorted(digits, first_digit(a, digit))][back.reshape(-1)]
            mark[starts[(state & WHOLE) > 0]] = True
            s = starts[(state & SEND) > 0]
            if len(s):
                found = b"".join([digest(data[i : i + THRESHOLD], digest_size=16).digest() for i in s.tolist()])
                yield s, np.frombuffer(found, np.uint64).reshape(-1, 2)

    def cleaned(self, mark: np.ndarray) -> Iterator[tuple[int, int, int, str]]:
        """Bytes, bytes removed, removed runs and the digest of what is left, of each text."""
        covered = np.zeros(len(mark), dtype=bool)
        at = np.flatnonzero(mark)
        if len(at):
            # runs of marked starts closer than THRESHOLD cover one run of bytes
            new = np.r_[True, np.diff(at) > THRESHOLD]
            first = at[new]
            last = np.r_[at[np.flatnonzero(new)[1:] - 1], at[-1]]
            step = np.zeros(len(mark) + 1, dtype=np.int8)
            step[first] = 1
            step[last + THRESHOLD] -= 1
            covered = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        for a, b in zip(self.starts.tolist(), self.ends.tolist()):
            c = covered[a:b]
            removed = int(c.sum())
            spans = int(c[0]) + int((c[1:] & ~c[:-1]).sum()) if removed else 0
            left = self.data[a:b] if not removed else self.data[a:b][~c]
            yield b - a, removed, spans, hashlib.sha256(left.tobytes()).hexdigest()


def part_ends(sorted_digits: np.ndarray, parts: int) -> np.ndarray:
    """Where each of parts equal ranges of digits ends."""
    edges = np.array([k * 2**64 // parts for k in range(1, parts)], dtype=np.uint64)
    return np.r_[np.searchsorted(sorted_digits, edges), len(sorted_digits)]


def dealt(chunk: int, parts: int, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """The columns, sorted by the first, in pieces for the sorting tasks."""
    start = 0
    for part, end in enumerate(part_ends(columns[0], parts).tolist()):
        if end > start:
            yield part, chunk, b"".join(c[start:end].tobytes() for c in columns)
        start = end


def first_pass(first: np.ndarray, second: np.ndarray, more: np.ndarray, again: np.ndarray) -> np.ndarray:
    """States of the entries of all chunks, sorted by both digits."""
    order = np.lexsort((more, second, first))
    f, s, t, again = first[order], second[order], more[order], again[order].astype(bool)
    state = np.zeros(len(f), dtype=np.uint8)
    if len(f):
        new = np.r_[True, f[1:] != f[:-1]]
        group = np.cumsum(new) - 1
        last = np.r_[np.flatnonzero(new)[1:] - 1, len(f) - 1]
        size = np.bincount(group)
        several = (s[new] == 0) | (s[new] != s[last]) | (t[new] != t[last])
        repeated = (size > 1) | (np.bincount(group, weights=again) > 0)
        pair = new | np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])]
        number = np.cumsum(pair) - 1
        twice = (np.bincount(number)[number] > 1) | (np.bincount(number, weights=again)[number] > 0)
        state[repeated[group] & ~several[group]] = WHOLE
        mixed_group = several[group]
        state[mixed_group & (s == 0)] = SEND
        state[mixed_group & (s != 0) & ~twice] = SEND
        state[mixed_group & (s != 0) & twice] = WHOLE
        state[mixed_group & (s != 0) & twice & pair] = BOTH
    out = np.empty_like(state)
    out[order] = state
    return out


def distinct(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different digests in order, the place of each given one among them, and how often each occurs."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    d = digests[order]
    new = np.r_[True, (d[1:] != d[:-1]).any(axis=1)][: len(d)]
    place = np.empty(len(d), np.int64)
    place[order] = np.cumsum(new) - 1
    return d[new], place, np.diff(np.r_[np.flatnonzero(new), len(d)])


def last_pass(one: np.ndarray, two: np.ndarray, again: np.ndarray) -> np.ndarray:
    """1 for the strings that occur in several chunks, or again in one."""
    if not len(one):
        return again
    _, place, counts = distinct(np.stack([one, two], axis=1))
    return (counts[place] > 1).astype(np.uint8) | again


ANSWER = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])
PIECE = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("blob", pa.binary())])


def sorting_task(kind: str):
    """One range of digits from all chunks: answers each chunk with a byte for each of its entries."""
    width = 25 if kind == "first" else 17

    def sort(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["chunk"].to_pylist(), table["blob"].to_pylist()))
        part = table["part"][0].as_py()
        sizes = [len(b) // width for _, b in rows]
        columns = []
        for b, n in zip((b for _, b in rows), sizes):
            words = (width - 1) // 8
            columns.append([np.frombuffer(b, np.uint64, n, 8 * n * k) for k in range(words)] + [np.frombuffer(b, np.uint8, n, 8 * n * words)])
        merged = [np.concatenate(c) for c in zip(*columns)]
        state = first_pass(*merged) if kind == "first" else last_pass(*merged)
        ends = np.cumsum(sizes)
        out = [(c, part, state[e - n : e].tobytes()) for (c, _), n, e in zip(rows, sizes, ends.tolist())]
        return pa.Table.from_pydict({"chunk": [o[0] for o in out], "part": [o[1] for o in out], "blob": [o[2] for o in out]}, schema=ANSWER)

    return sort


def answered(table: pa.Table) -> np.ndarray:
    rows = sorted(zip(table["part"].to_pylist(), table["blob"].to_pylist()))
    return np.frombuffer(b"".join(b for _, b in rows), np.uint8)


def texts_of(table: pa.Table) -> list[bytes]:
    return as_bytes(table["text"].combine_chunks()) if table.num_rows else []


def dealt_to(chunks: int):
    """Rows with a chunk for each, by a hash; rows that repeat id and text go elsewhere from the ninth in a partition on, and so on.

    What row goes where depends only on what is in its partition, not on its order, so
    a partition that is read again deals alike.
    """
    schema = pa.schema([("chunk", pa.int32()), ("id", pa.string()), ("text", pa.string())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        seen, part = Counter(), TaskContext.get().partitionId()
        for b in batches:
            chunk = []
            for i, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                h = xxh64_intdigest(t, xxh64_intdigest(repr(i).encode()))
                seen[h] += 1
                turn = (seen[h] - 1) // 8
                chunk.append((h if not turn else xxh64_intdigest(f"{h} {part} {turn}".encode())) % chunks)
            yield batch(schema, chunk, b.column(0), b.column(1))

    return deal


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of each text without the bytes of any THRESHOLD-byte string that starts at two places or more.

    Texts are dealt once to chunks; each chunk's tasks exchange only digits with the
    sorting tasks. A chunk sends each digit once, however often it holds it, so a string
    that fills a third of the corpus gives a sorting task one entry for each chunk.
    Three passes over the texts, two sorts.

    Null text is empty; texts under THRESHOLD bytes stay whole; repeated rows are
    copies of each other, so of long ones nothing is left, and are dealt to many chunks;
    null ids stay null; other columns are not read; an empty table gives an empty result.
    Returns id_col, n_bytes, n_removed, n_spans, kept_sha256.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = max(1, -(-total // CHUNK))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    df = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    df = df.mapInArrow(dealt_to(chunks), "chunk int, id string, text string").repartition("chunk")

    def send_digits(table: pa.Table) -> pa.Table:
        number = table["chunk"][0].as_py()
        rows = list(dealt(number, parts, *Chunk(texts_of(table)).entries()))
        return pa.Table.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(PIECE.names)}, schema=PIECE)

    def sent_strings(c: Chunk, states: np.ndarray, mark: np.ndarray) -> tuple[list, np.ndarray]:
        sent = list(c.strings(c.digits(), states, mark))
        return sent, np.concatenate([h for _, h in sent]) if sent else np.zeros((0, 2), np.uint64)

    def send_strings(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows and answers.num_rows:
            c = Chunk(texts_of(table))
            _, hashes = sent_strings(c, answered(answers), np.zeros(len(c.data), bool))
            if len(hashes):
                found, _, n = distinct(hashes)
                rows = list(dealt(table["chunk"][0].as_py(), parts, found[:, 0].copy(), found[:, 1].copy(), (n > 1).astype(np.uint8)))
        return pa.Table.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(PIECE.names)}, schema=PIECE)

    result = pa.schema([("id", pa.string()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def clean(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return result.empty_table()
        c = Chunk(texts_of(table))
        mark = np.zeros(len(c.data), dtype=bool)
        if answers.num_rows:
            by_pass = [answers.filter(pa.array([p == k for p in answers["pass"].to_pylist()])) for k in (1, 2)]
            sent, hashes = sent_strings(c, answered(by_pass[0]), mark)
            if len(hashes):
                state = answered(by_pass[1]).astype(bool)[distinct(hashes)[1]]
                mark[np.concatenate([s for s, _ in sent])[state]] = True
        rows = list(c.cleaned(mark))
        return pa.Table.from_pydict({"id": table["id"].to_pylist(), **{n: [r[k] for r in rows] for k, n in enumerate(result.names[1:])}}, schema=result)

    piece, answer = "part int, chunk int, blob binary", "chunk int, part int, blob binary"
    first = df.groupBy("chunk").applyInArrow(send_digits, piece).groupBy("part").applyInArrow(sorting_task("first"), answer)
    second = df.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(send_strings, piece).groupBy("part").applyInArrow(sorting_task("last"), answer)
    both = first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2)))
    out = df.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(clean, "id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
