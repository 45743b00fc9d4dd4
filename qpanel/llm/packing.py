"""Cost-balanced packing of token ids into training sequences."""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_texts, batch
from .tokens import RANKS, TOKENIZER, Encoder

#: Tokens that one packing group gathers before its sequences are closed: bounds a task's memory, and with it the short sequences (one in a group).
GROUP_TOKENS = 4_000_000
#: The fewest tokens that a cut leaves on either side, where documents are long enough.
LEAST = 16
END = (1).to_bytes(4, "little")


def balanced(lengths: list[int], limit: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length).

    A piece of n tokens costs linear * n + quadratic * n * n, the work of its attention.
    A document beyond limit first fills sequences of its own; what is left of it, and all
    other documents, go whole and in descending order to the sequence of lowest cost that
    has room for them. Those that fit nowhere whole are cut into the room that is left,
    the largest room first, in pieces of LEAST tokens or more, and what is still left
    gets more sequences. So cuts are fewer than sequences, and besides one sequence
    none lacks as many as 2 * LEAST tokens.
    """
    full, items = [], []
    for d, n in enumerate(lengths):
        whole, rest = divmod(n, limit)
        if whole and 0 < rest < LEAST:
            # two pieces alike instead of a full one and a scrap
            whole, tail = whole - 1, [(limit + rest) // 2, limit + rest - (limit + rest) // 2]
        else:
            tail = [rest] if rest else []
        full += [(d, limit * k, limit) for k in range(whole)]
        items += [(d, limit * whole + (tail[0] if k else 0), x) for k, x in enumerate(tail)]
    total = sum(n for _, _, n in items)
    room = np.full(-(-total // limit), limit, dtype=np.int64)
    if total % limit:
        room[-1] = total % limit
    # a short sequence starts with the cost of the tokens that it has no room for
    cost = linear * (limit - room).astype(float)
    shared: list[list[tuple[int, int, int]]] = [[] for _ in room]
    over = []
    for d, start, n in sorted(items, key=lambda x: (-x[2], x[0], x[1])):
        fits = room >= n
        if not fits.any():
            over.append((d, start, n))
            continue
        k = int(np.where(fits, cost, np.inf).argmin())
        shared[k].append((d, start, n))
        room[k] -= n
        cost[k] += linear * n + quadratic * n * n
    gaps = [(int(room[k]), k) for k in np.argsort(room[:-1], kind="stable") if room[k] >= LEAST]
    # the short sequence comes last, with all the room that it has up to limit
    spare = (int(room[-1]) + -total % limit, len(room) - 1) if len(room) else (0, 0)
    for d, start, left in over:
        while left:
            if gaps and (left <= gaps[-1][0] or left >= 2 * LEAST):
                space, k = gaps.pop()
            else:
                if spare[0] < min(left, 2 * LEAST):
                    spare = (limit, len(shared))
                    shared.append([])
                (space, k), spare = spare, (0, 0)
            n = min(left, space)
            if 0 < left - n < LEAST:
                n = left - LEAST
            shared[k].append((d, start, n))
            start, left, space = start + n, left - n, space - n
            if not spare[0]:
                spare = (space, k)
            elif space >= LEAST:
                insort(gaps, (space, k))
    return [[piece] for piece in full] + shared


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, ranks: str | None = RANKS, limit: int = 2048, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pieces of documents in sequences of at most limit tokens.

    Each task packs the documents of its own partition in groups of about group_tokens
    tokens, so nothing is shuffled and no key can be hot; a document longer than that
    closes its group by itself. A document is its ids and id 1 at the end. Sequences are
    full but for some tokens, and one of each group, which is padded; documents that fit
    into one are seldom cut (see balanced). sequence_id holds the partition in its upper bits and the place in it below.

    Null text is the empty text: a document of one id. Null ids stay null; repeated rows
    are packed each; of equally long documents the one read first goes first; columns
    beside id_col and text_col are not read; an empty table gives an empty result.
    Returns id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    kind = docs.schema[id_col].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([("id", pa.string()), *[(n, pa.int64()) for n in names]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base, used = Encoder(path, ranks), TaskContext.get().partitionId() << 40, 0

        def group(ids: list, docs_ids: list[bytes]) -> pa.RecordBatch:
            nonlocal used
            rows = []
            lengths = [len(x) // 4 for x in docs_ids]
            for sequence in balanced(lengths, limit):
                offset = 0
                for d, start, n in sequence:
                    rows.append((ids[d], start, n, zlib.crc32(memoryview(docs_ids[d])[4 * start : 4 * (start + n)]), lengths[d], base + used, offset))
                    offset += n
                used += 1
            return batch(schema, *(list(c) for c in zip(*rows)))

        ids, found, tokens = [], [], 0
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), as_texts(b.column(1))):
                ids.append(i)
                found.append(encoder.ids(x) + END)
                tokens += len(found[-1]) // 4
                if tokens >= group_tokens:
                    yield group(ids, found)
                    ids, found, tokens = [], [], 0
        if ids:
            yield group(ids, found)

    df = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(pack, "id string, " + ", ".join(f"{n} long" for n in names))
    return df.select(F.col("id").cast(kind).alias(id_col), *names)
