"""Language identification by string kernels on Nyström landmarks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_texts, batch, written

#: Bins for the presence of 1-, 2- and 3-grams of characters.
BINS = (2048, 8192, 32768)
WIDTH = sum(BINS)
#: Bounds of the sample that the classifier is fitted on: documents of each language, documents in all where there are very many languages (each still has one), landmarks of each language, landmarks in all (and where there are more languages than that).
PER_LANGUAGE, SAMPLE, LANDMARKS, MOST_LANDMARKS, ALL_LANDMARKS = 400, 25_600, 24, 192, 512
#: Tasks that sum up the sample.
SUMMING = 8
RIDGE, SHARPNESS = 1e-3, 6.0
#: Documents in one matrix product, and characters of a text handled at once.
ROWS, CHARS = 64, 1_000_000
UNKNOWN = "und"
SPACE = 32


def folded() -> np.ndarray:
    """For each character of the basic plane its lower-case letter, or a space."""
    table = np.full(0x10000, SPACE, dtype=np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


class Presence:
    """Blended spectrum of a text: which 1-, 2- and 3-grams occur in it."""

    def __init__(self):
        self.table = folded()

    def of(self, text: str) -> np.ndarray | None:
        """WIDTH booleans; None for a text without a letter."""
        row, letters, tail = np.zeros(WIDTH, dtype=bool), False, np.array([SPACE, SPACE], np.uint32)
        for at in range(0, len(text), CHARS):
            codes = np.frombuffer(text[at : at + CHARS].encode("utf-32-le", "surrogatepass"), dtype="<u4")
            c = self.table[np.minimum(codes, 0xFFFF)]
            if (beyond := codes > 0xFFFF).any():
                high = codes[beyond]
                c[beyond] = [x if chr(x).isalpha() else SPACE for x in high.tolist()]
            letters = letters or bool((c != SPACE).any())
            c = np.r_[tail, c, np.uint32(SPACE)]
            tail = c[-3:-1]
            first = BINS[0], BINS[0] + BINS[1]
            two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
            three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
            row[c & np.uint32(BINS[0] - 1)] = True
            row[first[0] + (two >> np.uint32(32 - 13))] = True
            row[first[1] + (three >> np.uint32(32 - 15))] = True
        return row if letters else None


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared n-grams of each row and landmark, over the root of the product of their numbers."""
    sizes = np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(axis=1), 1))[None, :]
    return (rows @ landmarks.T) / sizes


def roots(landmarks: np.ndarray) -> np.ndarray:
    """What takes kernel values to coordinates in the span of the landmarks."""
    values, vectors = np.linalg.eigh(kernel(landmarks.astype(np.float32), landmarks.astype(np.float32)).astype(np.float64))
    good = values > 1e-6 * values.max()
    return vectors[:, good] / np.sqrt(values[good])


def solved(number: int, weights: np.ndarray, total: np.ndarray, gram: np.ndarray, sums: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-rest ridge regressions of 1 and -1 from sums over the sample.

    number: its rows; weights: those of each language's rows together; total: the sum of
    coordinates; gram and sums: weighted sums of their products, and of the coordinates
    for each language. Returns coefficients on kernel values and offsets.
    """
    centre, mass = total / number, weights.sum()
    level = (2 * weights - mass) / number
    first = sums.sum(axis=0)
    inner = gram - np.outer(first, centre) - np.outer(centre, first) + mass * np.outer(centre, centre)
    # sums of weight * (coordinates - centre) * (y - level), for each language
    right = 2 * sums - first - np.outer(2 * weights - mass, centre) - np.outer(level, first - mass * centre)
    w = np.linalg.solve(inner + RIDGE * number * np.eye(len(inner)), right.T)
    return root @ w, level - centre @ w


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """_lang, _place, _text: at most PER_LANGUAGE different documents of each language, whatever their number.

    A row's place is a hash of its id and text. The places of a language fall into as
    many bins as it has documents in the sample; the first place of each bin is in it.
    Only places are shuffled, combined within map tasks; no language's rows meet in a task.
    """
    df = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    df = df.filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & ~held_out(F.col("_id"))).withColumn("_place", F.xxhash64("_id", "_text"))
    bins = df.groupBy("_lang", F.pmod("_place", F.lit(PER_LANGUAGE)).alias("_bin")).agg(F.min("_place").alias("_place"))
    bins = written(bins)
    each = max(1, min(PER_LANGUAGE, SAMPLE // max(1, bins.select("_lang").distinct().count())))
    # SAMPLE rows of a hash and a name, or one for each language
    first = bins.groupBy("_lang", F.col("_bin") % each).agg(F.min("_place").alias("_place"))
    return df.join(F.broadcast(first), ["_lang", "_place"]).select("_lang", "_place", "_text")


def trained(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple | None:
    """Names, packed landmarks, coefficients and offsets; None if there is nothing to learn from."""
    schema = pa.schema([("lang", pa.string()), ("place", pa.int64()), ("bits", pa.binary())])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence()
        for b in batches:
            found = [(x, p, presence.of(t)) for x, p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_texts(b.column(2)))]
            found = [(x, p, np.packbits(r).tobytes()) for x, p, r in found if r is not None]
            yield batch(schema, *([f[k] for f in found] for k in range(3)))

    rows = sample(docs, id_col, text_col, lang_col).mapInArrow(bits, "lang string, place long, bits binary")
    # equal rows are one, combined within map tasks
    rows = written(rows.groupBy("lang", "place").agg(F.min("bits").alias("bits")))
    places: dict[str, list[int]] = {}
    for r in rows.select("lang", "place").sort("lang", "place").collect():
        places.setdefault(r["lang"], []).append(r["place"])
    if not places:
        return None
    names = sorted(places)
    number = sum(map(len, places.values()))
    most = min(LANDMARKS * len(names), max(MOST_LANDMARKS, min(len(names), ALL_LANDMARKS)))
    # the languages in turn
    chosen = sorted((k, x, p) for x, ps in places.items() for k, p in enumerate(ps))[:most]
    found = rows.filter(F.col("place").isin([p for _, _, p in chosen])).select("lang", "place", "bits").sort("lang", "place").collect()
    marks = np.array([np.frombuffer(r["bits"], np.uint8) for r in found])
    root = roots(np.unpackbits(marks, axis=1, count=WIDTH))
    share = {x: number / (len(names) * len(places[x])) for x in names}
    at = {x: k for k, x in enumerate(names)}
    sums = pa.schema([("total", pa.binary()), ("gram", pa.binary()), ("sums", pa.binary())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = np.unpackbits(marks, axis=1, count=WIDTH).astype(np.float32)
        m = root.shape[1]
        total, gram, each = np.zeros(m), np.zeros((m, m)), np.zeros((len(at), m))
        for b in batches:
            langs, packed = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in range(0, len(langs), ROWS):
                z = kernel(np.unpackbits(np.array([np.frombuffer(x, np.uint8) for x in packed[k : k + ROWS]]), axis=1, count=WIDTH).astype(np.float32), lm).astype(np.float64) @ root
                w = np.array([share[x] for x in langs[k : k + ROWS]])[:, None]
                total += z.sum(axis=0)
                gram += z.T @ (w * z)
                np.add.at(each, [at[x] for x in langs[k : k + ROWS]], w * z)
        yield batch(sums, [total.tobytes()], [gram.tobytes()], [each.tobytes()])

    parts = rows.select("lang", "bits").coalesce(SUMMING).mapInArrow(add_up, "total binary, gram binary, sums binary").collect()
    m = root.shape[1]
    total, gram, each = (sum(np.frombuffer(r[k]) for r in parts) for k in range(3))
    weights = np.array([share[x] * len(places[x]) for x in names])
    coefficients, offsets = solved(number, weights, total, gram.reshape(m, m), each.reshape(len(names), m), root)
    return names, marks, coefficients, offsets


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The language of each whole text.

    Learned from a bounded sample of texts with a language, whose crc32(id) mod 4 is not
    2; every language is in it. The model (landmarks and coefficients, a few MB) is
    broadcast as arrays. Scores of one-versus-rest regressions, made sharper and
    normalised, give score. Null texts, and texts without a letter, are "und" with score
    1; so is every text, with score 0, where there is nothing to learn from. Null ids
    stay null, and rows that have one, or repeat one, are sampled by their texts;
    repeated rows are predicted each; of equal scores the first language wins; other
    columns are not read; an empty table gives an empty result.
    Returns id_col, held_out, lang_pred, score.
    """
    model = trained(docs, id_col, text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("id", pa.string()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence()
        if sent.value:
            languages, packed, coefficients, offsets = sent.value
            marks = np.unpackbits(packed, axis=1, count=WIDTH).astype(np.float32)
        block = np.empty((ROWS, WIDTH), dtype=np.float32)
        for b in batches:
            texts = as_texts(b.column(1))
            names, scores = [UNKNOWN] * len(texts), [1.0] * len(texts)
            waiting: list[int] = []

            def flush():
                rows = block[: len(waiting)]
                f = kernel(rows, marks) @ coefficients + offsets
                e = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)))
                e /= e.sum(axis=1, keepdims=True)
                for place, best, row in zip(waiting, f.argmax(axis=1).tolist(), e):
                    names[place], scores[place] = languages[best], float(row[best])
                waiting.clear()

            for i, text in enumerate(texts):
                row = presence.of(text)
                if row is not None and sent.value:
                    block[len(waiting)] = row
                    waiting.append(i)
                    if len(waiting) == ROWS:
                        flush()
                elif row is not None:
                    scores[i] = 0.0
            if waiting:
                flush()
            yield batch(schema, b.column(0), names, scores)

    df = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(predict, "id string, lang_pred string, score double")
    df = df.select(F.col("id").cast(kind).alias(id_col), "lang_pred", "score")
    return df.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
