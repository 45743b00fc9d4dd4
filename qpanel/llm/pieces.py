"""Encoding of whole texts into merge-type pieces by backtracking, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_bytes, batch

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: What stands for a space within pieces.
SPACE = "▁"
#: What an unknown piece reads as.
UNKNOWN = " ⁇ "
#: Entries that a worker keeps of chunks and of pairs of pieces, and the longest chunk kept.
CHUNKS, PAIRS, LONGEST = 500_000, 400_000, 48
#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN_KIND, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Pieces:
    """Pieces of a model file: ids of texts as the library gives them, and back.

    A text gets a space before it, spaces become SPACE, and the characters are merged:
    of all neighbours whose union is a piece, those with the best score, the leftmost
    among equals, until none is left. A sequence of pieces is the result of these merges
    if and only if each piece comes from its own characters and each two neighbours come
    from theirs, as the first merge across a boundary would happen in the two pieces
    alone as well. So merges needn't be run: from each place the longest piece is tried
    first, then shorter ones, and where none goes with the piece before, that piece is
    shortened in turn and its end is marked in a bitfield, never to be tried again.

    Characters that are no pieces stay alone, as their bytes. No piece has SPACE behind
    another character, which is checked, so texts fall into chunks before each SPACE that
    follows another character; if the pieces allow it, also between letters and others,
    and around characters that no longer piece has. Chunks met before are remembered.
    """

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as format_

        model = format_.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        how = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if how.precompiled_charsmap or not how.add_dummy_prefix or how.remove_extra_whitespaces or not how.escape_whitespaces or model.trainer_spec.model_type != 2 or kinds & {USER, UNUSED}:
            raise ValueError("only models of merged pieces without normalisation, with a space before the text, are read")
        self.begin, self.end, self.unknown = model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.unk_id
        self.kinds = [p.type for p in model.pieces]
        self.names = [p.piece for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.number = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.number):
            raise ValueError("a piece has a space behind another character")
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.surface = [self.read(i) for i in range(len(self.names))]
        #: Pieces that their own characters merge into, with how they do; no other can be met in a result.
        self.made = {p: how for p in self.number for parts, how in [self.merges(p)] if parts == [p]}
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.made), None) for p in self.made}
        self.finder = ahocorasick.Automaton()
        for p in self.made:
            self.finder.add_word(p, len(p))
        self.finder.make_automaton()
        longer = {c for p in self.number if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in longer and c != 0x20)
        letters = {c for p in self.number for c in p if c.isalpha()}
        if alone and all(len({c in letters for c in p.lstrip(SPACE)}) < 2 for p in self.number):
            letter = "".join(sorted(map(re.escape, letters)))
            self.cut = re.compile(f"[{alone}]|{SPACE}*[{letter}]+|{SPACE}*[^{SPACE}{alone}{letter}]+|{SPACE}+").findall
        else:
            self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        #: What a piece, or a character that is none, is coded as: four bytes for each id.
        self.code = {p: np.uint32(i).tobytes() for p, i in self.number.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, bytes] = {}

    def read(self, i: int) -> bytes:
        """What piece i adds to a text."""
        if self.kinds[i] == BYTE:
            return bytes([int(self.names[i][3:5], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        return (UNKNOWN if self.kinds[i] == UNKNOWN_KIND else self.names[i].replace(SPACE, " ")).encode()

    def merges(self, text: str) -> tuple[list[str], tuple[list[float], list[str], list[str]]]:
        """The pieces that a short text's characters merge into, and how: the scores of the merges in turn, and the first and last piece before each and at the end."""
        parts, scores, first, last = list(text), [], [text[0]], [text[-1]]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                # no merge comes after this
                return parts, ([*scores, -np.inf], first, last)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            first.append(parts[0])
            last.append(parts[-1])

    def together(self, a: str, b: str) -> bool:
        """Whether pieces a and b come from their characters as neighbours: both are merged again, the better and then the left one first, and no merge may cross between them."""
        found = self.pairs.get((a, b))
        if found is None:
            (left, _, last), (right, first, _) = self.made[a], self.made[b]
            i = j = 0
            while True:
                x, y = left[i], right[j]
                across = self.score.get(last[i] + first[j])
                if across is not None and across > x and across >= y:
                    found = False
                    break
                if x == y == -np.inf:
                    found = True
                    break
                if x >= y:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = found
        return found

    def split(self, text: str) -> list[str]:
        """The pieces of a text, characters that are none of them by themselves."""
        longest = bytearray(len(text))
        for end, n in self.finder.iter(text):
            # ends rise, so the last one of a start is the farthest
            longest[end - n + 1] = n
        out: list[str] = []
        at = 0
        while at < len(text):
            if not longest[at]:
                out.append(text[at])
                at += 1
                continue
            upto = at
            while upto < len(text) and longest[upto]:
                upto += 1
            out += self.run(text, at, upto, longest)
            at = upto
        return out

    def run(self, text: str, start: int, stop: int, longest: bytearray) -> list[str]:
        """The pieces of text[start:stop], each of whose characters is a piece.

        A piece is made of characters with pieces of their own, so no match leaves the run.
        """
        out: list[str] = []
        failed = bytearray((stop - start) // 8 + 1)
        pairs, shorter, together = self.pairs, self.shorter, self.together
        at, piece, before = start, text[start : start + longest[start]], None
        while at < stop:
            if piece is None:
                # no piece from here goes with the one before
                k = at - start
                failed[k >> 3] |= 1 << (k & 7)
                piece = out.pop()
                at -= len(piece)
                piece, before = shorter[piece], out[-1] if out else None
                continue
            end = at + len(piece)
            k = end - start
            if not failed[k >> 3] >> (k & 7) & 1:
                fits = before is None or pairs.get((before, piece))
                if fits is None:
                    fits = together(before, piece)
                if fits:
                    out.append(piece)
                    at, before = end, piece
                    if at < stop:
                        piece = text[at : at + longest[at]]
                    continue
            piece = shorter[piece]
        return out

    def coded(self, chunk: str) -> bytes:
        """Ids of a chunk as little-endian bytes, four for each."""
        parts = self.split(chunk)
        try:
            return b"".join([self.code[p] for p in parts])
        except KeyError:
            pass
        if self.byte:
            return b"".join([self.code.get(p) or np.array([self.byte[x] for x in p.encode()], dtype="<u4").tobytes() for p in parts])
        ids = [self.number.get(p, self.unknown) for p in parts]
        return np.array([i for k, i in enumerate(ids) if i != self.unknown or not k or ids[k - 1] != i], dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, without begin and end."""
        if not text:
            return b""
        chunks = self.cut(SPACE + text.replace(" ", SPACE))
        known = self.chunks
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            pass
        if len(known) >= CHUNKS:
            known.clear()
        parts = []
        for c in chunks:
            ids = known.get(c)
            if ids is None:
                ids = self.coded(c)
                if len(c) <= LONGEST and len(known) < 2 * CHUNKS:
                    known[c] = ids
            parts.append(ids)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8: pieces in turn, without the space that the first one begins with. Bytes that form no character read as U+FFFD each."""
        found = np.frombuffer(ids, dtype="<u4")
        surface = self.surface
        raw = b"".join([surface[i] for i in found.tolist()])
        if raw[:1] == b" " and self.spaced(found):
            raw = raw[1:]
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = mended(raw)
        return raw

    def spaced(self, ids: np.ndarray) -> bool:
        """Whether the first piece with a text of its own begins with the space that was put before the text."""
        first = next((int(i) for i in ids if self.kinds[i] != CONTROL), None)
        return first is not None and self.names[first].startswith(SPACE)


def mended(raw: bytes) -> bytes:
    """raw with each byte that is no part of a character replaced by U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode().encode())
            break
        except UnicodeDecodeError as e:
            out += [raw[at : at + e.start], "�".encode()]
            at += e.start + 1
    return b"".join(out)


def as_characters(column: pa.Array) -> list[str]:
    """Texts; null is empty, and bytes that are no UTF-8 read as U+FFFD."""
    return [t.decode(errors="replace") for t in as_bytes(column)]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, ends: bool = True) -> DataFrame:
    """id_col and ids, an array of the ids of each whole text; with ends, between those of begin and end."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for b in batches:
            for k, text in enumerate(as_characters(b.column(1))):
                ids = np.frombuffer(pieces.encode(text), dtype="<u4").astype(np.int32)
                ids = np.r_[pieces.begin, ids, pieces.end].astype(np.int32) if ends else ids
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))], names=["id", "ids"])

    out = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(encode, out).withColumnRenamed("id", id_col)


def decoded(ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """id_col and text, what each array of ids reads as; null ids read as the empty text. An id outside the model is an error."""
    kind = ids.schema[id_col].dataType
    rows = ids.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{ids_col}`").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for b in batches:
            texts = [pieces.decode(np.array(x, dtype="<u4").tobytes()).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.mapInArrow(decode, T.StructType([T.StructField("id", kind), T.StructField("text", T.StringType())])).withColumnRenamed("id", id_col)


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """Each whole text encoded, begin and end included, and decoded again; nothing is shuffled.

    A worker remembers up to CHUNKS chunks of LONGEST characters or fewer and PAIRS pairs
    of pieces, which changes no result. A text without spaces, however long, is one chunk
    and takes time in proportion to its length.

    Null text is the empty text, with the two ids of begin and end; bytes that are no
    UTF-8 read as U+FFFD; null ids stay null; repeated rows are returned each; other
    columns, whatever their names, are not read; an empty table gives an empty result.
    Returns id_col, n_tokens (all ids), ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), decoded_sha256 (of the decoded text in UTF-8).
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    arrow = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (pieces.begin, pieces.end))
        for b in batches:
            n, first, second = [], [], []
            for text in as_characters(b.column(1)):
                ids = begin + pieces.encode(text) + end
                n.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(pieces.decode(ids)).hexdigest())
            found = batch(arrow, n, first, second)
            yield pa.RecordBatch.from_arrays([b.column(0), *found.columns], names=["id", *arrow.names])

    out = T.StructType([T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return rows.mapInArrow(work, out).withColumnRenamed("id", id_col)
