"""Quality rules by weak supervision: rules vote or abstain, EM weighs them."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, batch, written

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUED = bytes(range(0x80, 0xC0))
UPPER, LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
#: Each rule: a measure of the text, the span in which it votes good, and the span outside which it votes bad; between them it abstains.
#: The rules differ in how far they can be trusted: how far each can be is for EM to find.
RULES = (
    ("symbols", (0, 0.05), (0, 0.3)),
    ("upper", (0, 0.2), (0, 0.6)),
    ("repeats", (0, 0.1), (0, 0.3)),
    ("word_length", (3, 10), (2, 16)),
    ("dup_lines", (0, 0.2), (0, 0.6)),
    ("plain_words", (0.85, 1), (0.6, 1)),
    ("shouts", (0, 0.05), (0, 0.3)),
    ("variety", (0.8, 1e9), (0.3, 1e9)),
    ("ended_lines", (0.5, 1), (0.2, 1)),
    ("digits", (0, 0.05), (0, 0.2)),
    ("line_words", (4, 100), (2, 1000)),
)
#: Words with anything but letters, digits and marks of ordinary prose.
MARKED = re.compile(rb"[^\x20\x09-\x0D]*(?:[#*$%&|<>{}]|!!)[^\x20\x09-\x0D]*").findall
DIGITS = b"0123456789"
#: Bytes that end a line of prose.
ENDED = (b".", b"!", b"?", b":", b";", b'"', b"\xe2\x80\x9d", b"\xe3\x80\x82", b")")
#: Weight of the prior in EM, as a share of all documents, and its chances of each vote: a rule is held to be somewhat better than chance until counts say otherwise.
PRIOR_SHARE = 0.02
GOOD, BAD, ABSTAIN = "g", "b", "-"
PRIOR = {True: {GOOD: 0.89, BAD: 0.01, ABSTAIN: 0.1}, False: {GOOD: 0.75, BAD: 0.15, ABSTAIN: 0.1}}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(distinct := set(windows)) == len(windows):
        return 0
    seen = Counter(windows) if len(distinct) > 1 else {windows[0]: len(windows)}
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def measured(text: bytes) -> tuple[list[int], str]:
    """The base counts of a text, and its rules' votes."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, SPACES + CONTINUED))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    dups = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    upper = len(text) - len(text.translate(None, UPPER))
    lower = len(text) - len(text.translate(None, LOWER))
    plain = n - len(MARKED(text)) if symbols or b"!!" in text or b"{" in text else n
    value = {
        "symbols": symbols / max(n, 1), "upper": upper / max(upper + lower, 1), "repeats": repeats / max(n, 1), "word_length": chars / max(n, 1),
        "dup_lines": dups / max(len(lines), 1), "plain_words": plain / max(n, 1), "shouts": text.count(b"!!") / max(n, 1), "variety": len(set(words)) / max(n, 1) ** 0.75,
        "ended_lines": sum(x.rstrip(SPACES).endswith(ENDED) for x in lines) / max(len(lines), 1), "digits": (len(text) - len(text.translate(None, DIGITS))) / max(chars, 1),
        "line_words": n / max(len(lines), 1),
    }
    votes = "".join(GOOD if g[0] <= value[r] <= g[1] else ABSTAIN if b[0] <= value[r] <= b[1] else BAD for r, g, b in RULES)
    return [n, chars, symbols, dups, repeats], votes


class Model:
    """Weights of votes: the log of how much likelier each is of a good than of a bad document."""

    def __init__(self, patterns: dict[str, int], rounds: int = 100):
        """Expectation-maximisation over the counts of patterns of votes.

        Every rule has its own chances of each vote given a good and given a bad
        document, all of them free; the prior, PRIOR_SHARE of all documents, only says
        where to look. Only counts are used, so the result is the same at every size.
        """
        rules, total = len(next(iter(patterns), "")), sum(patterns.values())
        self.prior, self.chance = 0.8, {c: [dict(PRIOR[c]) for _ in range(rules)] for c in (True, False)}
        extra = PRIOR_SHARE * total
        for _ in range(rounds if total else 0):
            self.weigh()
            p = {v: self.posterior(v) for v in patterns}
            mass = {True: sum(n * p[v] for v, n in patterns.items()), False: sum(n * (1 - p[v]) for v, n in patterns.items())}
            before, self.prior = self.prior, (mass[True] + 0.8 * extra) / (total + extra)
            for c in (True, False):
                for k in range(rules):
                    votes = {v: extra * x for v, x in PRIOR[c].items()}
                    for v, n in patterns.items():
                        votes[v[k]] += n * (p[v] if c else 1 - p[v])
                    self.chance[c][k] = {v: x / (mass[c] + extra) for v, x in votes.items()}
            if abs(before - self.prior) < 1e-9:
                break
        self.weigh()

    def weigh(self) -> None:
        self.level = math.log(self.prior / (1 - self.prior))
        self.weights = [{v: math.log(g[v] / b[v]) for v in g} for g, b in zip(self.chance[True], self.chance[False])]

    def score(self, votes: str) -> float:
        """Log odds that a document is good."""
        total = self.level
        for w, v in zip(self.weights, votes):
            total += w[v]
        return total

    def posterior(self, votes: str) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.score(votes)))))

    def accuracies(self) -> list[float]:
        """For each rule, how often it is right where it votes."""
        out = []
        for g, b in zip(self.chance[True], self.chance[False]):
            right, wrong = self.prior * g[GOOD] + (1 - self.prior) * b[BAD], self.prior * g[BAD] + (1 - self.prior) * b[GOOD]
            out.append(right / (right + wrong))
        return out

    def column(self, votes: Column) -> Column:
        """score() of a column, its terms in the same order."""
        total = F.lit(self.level)
        for k, w in enumerate(self.weights):
            v = F.substring(votes, k + 1, 1)
            total = total + F.when(v == GOOD, w[GOOD]).when(v == BAD, w[BAD]).otherwise(w[ABSTAIN])
        return total


def posteriors(patterns: dict[str, int]) -> dict[str, float]:
    """P(good) of each pattern of votes."""
    model = Model(patterns)
    return {v: model.posterior(v) for v in patterns}


def with_measures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("id", pa.string()), *[(n, pa.int64()) for n in BASE], ("votes", pa.string())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measured(t) for t in as_bytes(b.column(1))]
            yield batch(schema, b.column(0), *[[f[0][k] for f in found] for k in range(len(BASE))], [f[1] for f in found])

    df = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(measure, "id string, " + ", ".join(f"{n} long" for n in BASE) + ", votes string")
    return df.withColumn("id", F.col("id").cast(kind)).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def pattern_counts(measures: DataFrame) -> dict[str, int]:
    """How often each pattern of votes occurs among all documents that pass the base: 3 ** len(RULES) rows at most, combined within map tasks."""
    return {r["votes"]: r["count"] for r in measures.filter(~F.col("base_failed")).groupBy("votes").count().collect()}


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The verdict on each document.

    Null text has no words. Documents under 50 words, or with more than half of their
    words in repeated 3-word windows, fail outright; of the others those with a
    posterior of threshold or more are kept, whatever single rules say. Null ids stay null; repeated rows get the
    same verdict; ties of the posterior with the threshold are kept; an empty table gives
    an empty result. Returns id_col, the base counts, base_failed, kept, p_good, votes.
    """
    measures = written(with_measures(docs, id_col, text_col))
    score = Model(pattern_counts(measures)).column(F.col("votes"))
    good = F.try_divide(F.lit(1.0), 1 + F.exp(-score))
    return measures.withColumn("p_good", good).select(F.col("id").alias(id_col), *BASE, "base_failed", (~F.col("base_failed") & (score >= odds(threshold))).alias("kept"), "p_good", "votes")


def odds(p: float) -> float:
    return math.log(p / (1 - p))


def kept_rows(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns and no join: texts are measured once for the votes and once to select.

    Rows are judged each by its text alone, so null ids, repeated rows and columns of
    any names make no difference; null text has no words and goes; an empty table gives
    an empty result.
    """
    slim = docs.select(F.lit("").alias("_id"), F.col(text_col).alias("_text"))
    model = Model(pattern_counts(with_measures(slim, "_id", "_text")))
    level, weights, least = model.level, model.weights, odds(threshold)
    place = docs.columns.index(text_col)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for text in as_bytes(b.column(place)):
                base, votes = measured(text)
                score = level
                for w, v in zip(weights, votes):
                    score += w[v]
                keep.append(base[0] >= 50 and 100 * base[4] <= 50 * base[0] and score >= least)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(select, docs.schema)
