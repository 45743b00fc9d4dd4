"""Token counts through a two-tier lookup of pre-tokens, and the token ids of whole texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_texts, batch, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary and merges as ranks: a faster way to the same ids for plain words.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Entries of the table of frequent pre-tokens, and counters that a task holds while it counts them. The table only saves work; results don't depend on it.
TABLE_ENTRIES, COUNTERS = 20_000, 400_000
#: A piece below 1 / SHARE of an entry's mean count stays out of the table: no more than SHARE * TABLE_ENTRIES pieces reach the last sort, whatever the input.
SHARE = 20
#: Entries of a worker's cache besides the table; when it is full, those that the texts at hand don't need are forgotten.
CACHE_ENTRIES = 300_000
#: Before a pre-token in the library's own spelling of bytes; no plain text holds it.
MAPPED = "\x01"
#: Characters of text that are looked up together.
TOGETHER = 4_000_000
#: Characters on whose class the library and the ranks' pattern agree, with no white space but spaces and line feeds.
PLAIN = r"[\n\x20-\x7E¡-¬®-ɏ]*"


class Encoder:
    """Ids of texts as little-endian bytes, four for each id, as the library gives them.

    A space starts a new pre-token unless white space surrounds it. Plain texts are
    therefore cut at spaces, and the pieces, space included, looked up: in the cache, or
    else encoded all together, a line feed between each two. Other texts are cut by the
    library's pattern, if it takes each of their characters as the library does (which is
    tried once for each), or else by its pre-tokenizer; their pieces are looked up alike.
    Only texts that hold the string of an added token go to the library whole.
    """

    def __init__(self, path: str, ranks: str | None = None, sizes: dict[str, int] | None = None):
        import base64

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        apart = [*map(regex.escape, added), "  ", "\n "]
        self.special = regex.compile("|".join(apart[:-2]) or "(?!)").search
        self.apart = regex.compile("|".join(apart)).search
        self.plain = regex.compile(PLAIN).fullmatch
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.agreed: dict[str, bool] = {}
        self.fast = None
        if ranks:
            with open(ranks, "rb") as f:
                pairs = dict(line.split() for line in f if line.strip())
            self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(k): int(v) for k, v in pairs.items()}, special_tokens={})
        self.line = self.encoded("\n")
        self.lengths = sizes is not None
        self.table = sizes or {}
        self.cache: dict[str, bytes] | dict[str, int] = dict(self.table)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encoded(self, plain: str) -> np.ndarray:
        return np.array(self.fast.encode_ordinary(plain), dtype="<u4") if self.fast else self.whole(plain)

    def ids(self, text: str) -> bytes:
        """Ids of one text without the lookup: quickest where most pieces are rare."""
        plain = self.plain(text) and not self.special(text)
        return (self.encoded(text) if plain else self.whole(text)).tobytes()

    def pieces(self, text: str) -> list[str] | None:
        """The text's pieces, or None if it goes to the library whole."""
        if not text or self.special(text):
            return None
        if self.apart(text) or not self.plain(text):
            if all(map(self.agrees, set(text))):
                return self.cut(text)
            return [MAPPED + p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return text.replace(" ", "\0 ").split("\0")

    def agrees(self, char: str) -> bool:
        """Whether the pattern and the library cut alike around a character, next to each kind of other."""
        if char not in self.agreed:
            tries = [a + char + b for a in ("a", "1", "!", " ", "") for b in ("a", "1", "!", " ", "")]
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.agreed[char] = char != MAPPED and all([t[a:b] for _, (a, b) in split(t)] == self.cut(t) for t in tries)
        return self.agreed[char]

    def of_model(self, mapped: str) -> int | bytes:
        """Number or ids of a pre-token in the library's spelling."""
        found = self.tokenizer.model.tokenize(mapped)
        return len(found) if self.lengths else np.array([t.id for t in found], dtype="<u4").tobytes()

    def looked_up(self, pieces: set[str]) -> dict:
        """A mapping that has all of pieces."""
        missing = sorted(pieces.difference(self.cache))
        if not missing:
            return self.cache
        if len(self.cache) + len(missing) > CACHE_ENTRIES + len(self.table):
            self.cache = self.table | {p: self.cache[p] for p in pieces.intersection(self.cache)}
        found = self.cache
        found.update((p, self.of_model(p[1:])) for p in missing if p[:1] == MAPPED)
        missing = [p for p in missing if p[:1] != MAPPED]
        single = [p for p in missing if p.strip() and "\n" not in p and len(self.line) == 1 and self.plain(p)]
        if single:
            # each piece begins with a space or, at the start of a text, with another character
            for group in ([p for p in single if p[:1] == " "], [p for p in single if p[:1] != " "]):
                if group:
                    ids = self.encoded("\n".join(group))
                    ends = np.append(np.flatnonzero(ids == self.line[0]), len(ids))
                    starts = np.insert(ends[:-1] + 1, 0, 0)
                    if self.lengths:
                        found.update(zip(group, (ends - starts).tolist(), strict=True))
                    else:
                        data = ids.tobytes()
                        found.update((p, data[4 * a : 4 * b]) for p, a, b in zip(group, starts.tolist(), ends.tolist(), strict=True))
        for p in missing:
            if p not in found:
                ids = self.encoded(p) if self.plain(p) else self.whole(p)
                found[p] = len(ids) if self.lengths else ids.tobytes()
        return found

    def each(self, texts: list[str]) -> Iterator[bytes | int]:
        """Ids of each text, or their numbers if lengths are looked up."""
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (size < TOGETHER or upto == at):
                size, upto = size + len(texts[upto]), upto + 1
            cut = [self.pieces(t) for t in texts[at:upto]]
            table = self.looked_up(set().union(*[p for p in cut if p]))
            for text, p in zip(texts[at:upto], cut):
                if p is None:
                    ids = self.whole(text)
                    yield len(ids) if self.lengths else ids.tobytes()
                elif self.lengths:
                    yield sum(map(table.__getitem__, p))
                else:
                    yield b"".join(map(table.__getitem__, p))
            at = upto


def frequent_lengths(docs: DataFrame, text_col: str, path: str, ranks: str | None, entries: int = TABLE_ENTRIES, counters: int = COUNTERS) -> tuple[str, bytes]:
    """The most frequent pieces of all texts, joined by null characters, and a byte for the length of each.

    Pieces are counted within the tasks, and only a task's most frequent ones leave it.
    A task beyond its counters forgets the rarer half of its pieces. Pieces below
    1 / (SHARE * entries) of all that was counted are left out before the last sort, so
    that what reaches the driver doesn't grow with the number of partitions.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder(path, ranks, {}), Counter()
        for b in batches:
            for text in as_texts(b.column(0)):
                seen.update(encoder.pieces(text) or ())
                if len(seen) > counters:
                    seen = Counter(dict(seen.most_common(counters // 2)))
        top = seen.most_common(entries)
        sizes = encoder.looked_up({p for p, _ in top})
        schema = pa.schema([("piece", pa.string()), ("n", pa.int64()), ("size", pa.int32())])
        yield batch(schema, [p for p, _ in top], [n for _, n in top], [sizes[p] for p, _ in top])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "piece string, n long, size int").filter("size < 256")
    totals = written(found.groupBy("piece", "size").agg(F.sum("n").alias("n")))
    least = (totals.agg(F.sum("n")).first()[0] or 0) / (SHARE * entries)
    rows = totals.filter(F.col("n") >= least).orderBy(F.desc("n"), "piece").limit(entries).collect()
    return "\0".join(r["piece"] for r in rows), bytes(r["size"] for r in rows)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, ranks: str | None = RANKS, limit: int = 1024) -> DataFrame:
    """Tokens of each whole text, as the library counts them, without a shuffle of texts or of their pre-tokens.

    A table with the lengths of at most TABLE_ENTRIES frequent pre-tokens is broadcast
    (a few hundred KB, whatever the input); it comes from each task's counts of its most
    frequent ones, over all texts, and changes only how often the library is asked.
    Other pre-tokens are encoded once per worker, unless its cache has to forget them.
    Texts with the string of an added token go to the library whole.

    Null text is the empty text, with 0 bytes and tokens; null ids stay null; repeated
    rows are counted each; other columns are not read; an empty table gives an empty result.
    Returns id_col, n_bytes, n_tokens, over_limit (n_tokens > limit).
    """
    names, sizes = frequent_lengths(docs, text_col, path, ranks)
    sent = docs.sparkSession.sparkContext.broadcast((names, sizes))
    schema = pa.schema([("id", pa.string()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes = sent.value
        encoder = Encoder(path, ranks, dict(zip(names.split("\0"), sizes)) if sizes else {})
        for b in batches:
            texts = as_texts(b.column(1))
            yield batch(schema, b.column(0), [len(t.encode()) for t in texts], list(encoder.each(texts)))

    # the id travels as text, whatever its type
    kind = docs.schema[id_col].dataType
    df = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "id string, n_bytes long, n_tokens long")
    return df.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
