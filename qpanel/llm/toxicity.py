"""Toxicity of whole texts after noisy-channel deobfuscation."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, as_texts, batch, written

#: Bounds of the sample that weights are fitted on: labelled rows of each class, and features kept, the most toxic first.
PER_CLASS, FEATURES = 5_000, 50_000
#: Pseudo-documents that draw a feature's share of toxic ones to the base rate, and the fewest toxic documents of a feature.
DRAWN, LEAST = 4.0, 3
#: Lengths of word starts that are features besides whole words.
STARTS = (5, 6)
#: The longest token whose reading is kept for reuse, how many are kept, and the costs of reading a character as another, dropping a separator or a repeat.
REUSED, KEPT, SUBSTITUTE, SEPARATOR, REPEAT = 64, 200_000, 1.2, 0.7, 0.5
#: Letters of a decoded run from which known words within it count too, and the fewest letters of such a word.
RUN, WITHIN = 12, 5
#: What a character may stand for. Fixed values.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
SEPARATORS = set(" .-_*~'`,/\\")
#: Letters of the language model: a to z, any other letter, and the end of a word.
SIZE = 28
END, ELSE = 0, 27

#: Characters that may also end a word within a token.
ENDS = SEPARATORS | set("()[]{}<>|")

#: Tokens worth decoding: a sign next to a letter, a letter twice, signs alone. Single characters in a row are read together besides.
SUSPECT = re.compile(r"[A-Za-z](?:[^\w\s]|[\d_])+[A-Za-z]|[A-Za-z][0-9@$|+(]|[0-9@$!|+(][A-Za-z]|([A-Za-z])\1|^[0-9@$!|+(]{3,}$")
DOUBLED = re.compile(r"([a-z])\1").search
#: Marks after a word, and the most doubled letters of a word whose readings are all looked up before it is decoded.
AFTER, LOOKED_UP = ".,;:!?*", 4
SINGLE = re.compile(r"[A-Za-z0-9@$!|+(]")
WORDS = re.compile(r"[^\W\d_]+")


def letter_codes() -> np.ndarray:
    """Code of each byte: letters 1 to 26, other letters' bytes 27, all else the end of a word."""
    codes = np.zeros(256, dtype=np.int64)
    for k in range(26):
        codes[0x41 + k] = codes[0x61 + k] = k + 1
    codes[0x80:] = ELSE
    return codes


def letter_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often each three codes follow each other, over all texts: SIZE ** 3 counts."""
    schema = pa.schema([("code", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = letter_codes(), np.zeros(SIZE**3, dtype=np.int64)
        for b in batches:
            texts = as_bytes(b.column(0))
            for at in range(0, len(texts), 256):
                c = codes[np.frombuffer(b"  " + b"  ".join(texts[at : at + 256]) + b"  ", dtype=np.uint8)]
                total += np.bincount(c[:-2] * SIZE * SIZE + c[1:-1] * SIZE + c[2:], minlength=SIZE**3)
        found = np.flatnonzero(total)
        yield batch(schema, pa.array(found.astype(np.int32)), pa.array(total[found]))

    counts = np.zeros(SIZE**3)
    for r in docs.select(F.col(text_col).alias("text")).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[r["code"]] = r["n"]
    return counts


class Decoder:
    """The most likely letters behind a token: Viterbi search of its lattice under the letter model."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SIZE, SIZE, SIZE)
        two = c.sum(axis=2, keepdims=True)
        pair = c.sum(axis=0)
        low = (pair + 0.1) / (pair.sum(axis=1, keepdims=True) + 0.1 * SIZE)
        self.cost = -np.log((c + 2.0 * low[None]) / (two + 2.0))
        self.codes = {chr(97 + k): k + 1 for k in range(26)}

    def read(self, token: str) -> list[str]:
        """The token as one word, and as words that end at separators."""
        found = [self.search(token, False)]
        if not ENDS.isdisjoint(token):
            found += self.search(token, True).split(" ")
        return found

    def search(self, token: str, ends: bool) -> str:
        cost = self.cost
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(END, END): (0.0, None)}
        previous = ""
        for ch in token:
            options: list[tuple[str, float]] = []
            if ch.isalpha():
                options.append((ch, 0.0))
                if ch == previous:
                    options.append(("", REPEAT))
            options += [(x, SUBSTITUTE) for x in LEET.get(ch, "")]
            if ch in SEPARATORS or not options:
                options.append(("", SEPARATOR))
            if ends and ch in ENDS:
                options.append((" ", 0.0))
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (so_far, letters) in states.items():
                for x, extra in options:
                    if x == " ":
                        key, total, read = (END, END), so_far + float(cost[a, b, END]), (letters, x)
                    elif x:
                        k = self.codes.get(x, ELSE)
                        key, total, read = (b, k), so_far + extra + float(cost[a, b, k]), (letters, x)
                    else:
                        key, total, read = (a, b), so_far + extra, letters
                    if key not in following or total < following[key][0]:
                        following[key] = (total, read)
            states, previous = following, ch
        best = min(states.items(), key=lambda kv: kv[1][0] + float(cost[kv[0][0], kv[0][1], END]))[1][1]
        read = []
        while best:
            best, x = best
            read.append(x)
        return "".join(reversed(read))


class Reader:
    """Features of texts, all or only wanted ones. What a token gives is kept for reuse; the store is emptied when it is full."""

    def __init__(self, counts: np.ndarray, wanted: dict | None = None):
        self.decoder, self.wanted = Decoder(counts), wanted
        #: wanted features as words, and as starts of each length
        self.words = {f for f in wanted or () if f[-1:] != "~"}
        self.starts = {n: {f[:-1] for f in wanted or () if len(f) == n + 1 and f[-1] == "~"} for n in STARTS}
        #: for each token its features and long runs; None if it has neither
        self.known: dict[str, tuple | None] = {}

    def of(self, text: str) -> tuple[set[str], set[str]]:
        """Words and word starts of a text, those that its suspect tokens decode to included, and its long decoded runs."""
        features, runs, known = set(), set(), self.known
        tokens, plain = text.split(), []
        for t in set(tokens):
            w = t.lower().rstrip(AFTER)
            if w.isalpha() and not DOUBLED(w):
                plain.append(w)
                continue
            try:
                found = known[t]
            except KeyError:
                found = self.read(w, bool(SUSPECT.search(t)))
                if len(t) <= REUSED:
                    if len(known) >= KEPT:
                        known.clear()
                    known[t] = found
            if found:
                features.update(found[0])
                runs.update(found[1])
        for t in spaced(tokens):
            if found := self.read(t.lower(), True):
                features.update(found[0])
                runs.update(found[1])
        if self.wanted is None:
            features.update(features_of(set(plain)))
        else:
            features.update(self.words.intersection(plain))
            for n, starts in self.starts.items():
                features.update([x + "~" for x in starts.intersection([w[:n] for w in plain if len(w) > n])])
        return features, runs

    def read(self, low: str, suspect: bool) -> tuple | None:
        words, runs = set(WORDS.findall(low)), ()
        if suspect and self.may_matter(low):
            decoded = self.decoder.read(low.rstrip(AFTER))
            words.update(decoded)
            words.discard("")
            runs = tuple(w for w in decoded[:1] if len(w) >= RUN)
        features = features_of(words)
        if self.wanted is not None:
            features = self.wanted.keys() & features
        return (tuple(features), runs) if features or runs else None

    def may_matter(self, low: str) -> bool:
        """False if no reading of a word of letters only has a wanted feature: it needn't be decoded then."""
        if self.wanted is None or not low.isalpha():
            return True
        if low in self.wanted:
            return True
        found = {""}
        drops = 0
        for k, ch in enumerate(low):
            again = k and ch == low[k - 1]
            drops += bool(again)
            if drops > LOOKED_UP:
                return True
            found = {x + ch for x in found} | (found if again else set())
        return any(f in self.wanted for f in features_of(found))


def spaced(tokens: list[str]) -> Iterator[str]:
    """Three or more single characters in a row, with a blank between each two."""
    if b"\1\1\1" not in bytes(map((1).__eq__, map(len, tokens))):
        return
    at = [i for i, t in enumerate(tokens) if len(t) == 1 and SINGLE.match(t)]
    k = 0
    while k < len(at):
        upto = k + 1
        while upto < len(at) and at[upto] == at[upto - 1] + 1:
            upto += 1
        if upto - k >= 3:
            yield " ".join(tokens[at[k] : at[upto - 1] + 1])
        k = upto


def features_of(words: set[str]) -> set[str]:
    found = set(words)
    for n in STARTS:
        found.update(f"{w[:n]}~" for w in words if len(w) > n)
    return found


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """At most PER_CLASS labelled texts of each class outside the held-out rows, those with the smallest hashes."""
    y = labels.select(F.col(id_col).alias("_id"), F.col("toxic").alias("_y")).filter(F.col("_y").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    y = y.groupBy("_id").agg(F.max((F.col("_y") == 1).cast("int")).alias("_y"))
    # each class by a bounded top-k, which is merged within the tasks
    first = [y.filter(F.col("_y") == v).orderBy(F.xxhash64("_id"), "_id").limit(PER_CLASS) for v in (0, 1)]
    y = first[0].unionByName(first[1])
    # of rows that repeat an id the first text counts, so that neither class grows or is cut
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    return d.join(F.broadcast(y), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).select("_y", "_text")


class Evidence:
    """How far the words of a text speak for toxicity: the logit of a feature's drawn share, if it beats the base rate."""

    def __init__(self, table: dict[str, tuple[int, int]], base: float):
        self.table, self.base, self.zero = table, base, math.log(base / (1 - base))
        self.logits = {f: self.logit(a, b) for f, (a, b) in table.items()}
        self.lengths = sorted({len(f) for f in table if len(f) >= WITHIN and f[-1] != "~"})

    def logit(self, toxic: float, clean: float) -> float:
        p = (toxic + DRAWN * self.base) / (toxic + clean + DRAWN)
        return math.log(p / (1 - p))

    def within(self, run: str) -> set[str]:
        """The words of the table that lie in a run of letters."""
        return {w for n in self.lengths for i in range(len(run) - n + 1) if (w := run[i : i + n]) in self.table}

    def of(self, features: set[str], runs: set[str], label: int | None = None) -> tuple[float, float]:
        """The largest and second largest logit above the base; with a label, as if that text had not been counted."""
        found = self.logits.keys() & features
        if label is None:
            values = [self.logits[f] - self.zero for f in found]
        else:
            counts = [(self.table[f][0] - label, self.table[f][1] - (1 - label)) for f in found]
            values = [self.logit(a, b) - self.zero for a, b in counts if a >= LEAST]
        for run in runs:
            values += [self.logits[f] - self.zero for f in self.within(run) - found]
        top = sorted((v for v in values if v > 0), reverse=True)[:2] + [0.0, 0.0]
        return top[0], top[1]


def fitted(rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge."""
    x = np.c_[np.ones(len(rows)), rows]
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (y - p) - ridge @ beta
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, g)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The toxicity of each whole text.

    Letter counts of all texts make a model of letters. Tokens in which signs, repeats
    or gaps may hide letters are decoded with it, by a Viterbi search of what each
    character may stand for. Words and word starts, decoded ones included, have a
    weight from labelled rows (a bounded sample of those whose crc32(id) mod 5 is not
    0); a logistic regression on the two strongest gives the score. What is broadcast
    is bounded: SIZE ** 3 letter counts and FEATURES weights.

    Null text is empty; a text without words gets the score of no evidence; without
    labels of both classes all scores are 0. Null ids stay null; labels that repeat an
    id count as toxic if one of them does; of texts that repeat an id one is learned
    from; repeated rows are scored each; tokens and runs of any length are decoded; other
    columns are not read; an empty table gives an empty result.
    Returns id_col, held_out, score, predicted.
    """
    sc = docs.sparkSession.sparkContext
    counts = sc.broadcast(letter_counts(docs, text_col))
    train = written(labelled(docs, labels, id_col, text_col))
    totals = {r["_y"]: r["count"] for r in train.groupBy("_y").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    model = None
    if toxic and clean:
        base = toxic / (toxic + clean)

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, ones, zeros = Reader(counts.value), Counter(), Counter()
            for b in batches:
                for y, t in zip(b.column(0).to_pylist(), as_texts(b.column(1))):
                    (ones if y == 1 else zeros).update(reader.of(t)[0])
            names = [*ones, *(zeros.keys() - ones.keys())]
            schema = pa.schema([("f", pa.string()), ("a", pa.int64()), ("b", pa.int64())])
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield batch(schema, part, [ones[x] for x in part], [zeros[x] for x in part])

        found = train.mapInArrow(tally, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        share = (F.col("a") + DRAWN * base) / (F.col("a") + F.col("b") + DRAWN)
        rows = found.filter((F.col("a") >= LEAST) & (share > base)).orderBy(share.desc(), "f").limit(FEATURES).collect()
        table = sc.broadcast({r["f"]: (r["a"], r["b"]) for r in rows})

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, evidence = Reader(counts.value, table.value), Evidence(table.value, base)
            schema = pa.schema([("y", pa.int32()), ("x1", pa.float64()), ("x2", pa.float64())])
            for b in batches:
                y = [int(v == 1) for v in b.column(0).to_pylist()]
                x = [evidence.of(*reader.of(t), v) for v, t in zip(y, as_texts(b.column(1)))]
                yield batch(schema, y, [v[0] for v in x], [v[1] for v in x])

        # 2 * PER_CLASS rows of three numbers at most
        known = train.mapInArrow(measure, "y int, x1 double, x2 double").toPandas().sort_values(["y", "x1", "x2"])
        beta = fitted(known[["x1", "x2"]].to_numpy(), known["y"].to_numpy())
        model = (table, base, [float(v) for v in beta])

    kind = docs.schema[id_col].dataType
    schema = pa.schema([("id", pa.string()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(counts.value, model[0].value) if model else None
        evidence = Evidence(model[0].value, model[1]) if model else None
        for b in batches:
            found = []
            for t in as_texts(b.column(1)):
                if evidence is None:
                    found.append(0.0)
                    continue
                x = evidence.of(*reader.of(t))
                found.append(1 / (1 + math.exp(-max(-30.0, min(30.0, model[2][0] + model[2][1] * x[0] + model[2][2] * x[1])))))
            yield batch(schema, b.column(0), found)

    df = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(score, "id string, score double")
    df = df.select(F.col("id").cast(kind).alias(id_col), "score")
    return df.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
