"""Toxicity scores over text restored by a noisy-channel decoder.

The channel writes letters as look-alike signs, puts signs or blanks between
them and repeats them. Every stretch that shows such marks is a lattice of
readings; Viterbi finds the likeliest under a character trigram model counted
over all documents. Everything else has one reading, itself. Words of the
restored text are then scored by a logistic model of whole words and word
beginnings, learnt from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents

#: Labelled rows that the classifier is fitted on at most, taken by the order of a hash of their id.
SAMPLE = 16_000
#: Words and word beginnings that the classifier weighs at most.
FEATURES = 3_000
STARTS = (4, 5, 6)
THRESHOLD = 0.3
#: Characters of a stretch whose reading is kept for the next time, at most.
REMEMBERED = 64

# What a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l",
}
# Costs: a stand-in read as a letter, a stand-in that is noise, a separator that is noise, a letter of a run of three or more folded.
_STAND, _NOISE, _SKIP, _FOLD = math.log(0.5), math.log(0.0005), math.log(0.5), math.log(0.5)

# Symbols of the language model: 0 for whatever ends a word, 1 to 26 for letters, 27 for bytes beyond ASCII.
SYMBOLS = 28
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27

# Classes of bytes for the search for marks: blank or other, letter, stand-in, separator.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[[ord(c) for c in STANDS_FOR if ord(c) < 128]] = 2
_CLASS[[ord(c) for c in ".-_*"]] = 3

_BLANKS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_BLANK = np.frombuffer(b" \n\t\r", np.uint8)
_SPACED = re.compile(r"(?<!\S)(?:[^\W_][ .\-_*]){3,}[^\W_](?!\S)")
_TOKEN = re.compile(r"\S+")


def trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of symbol triples (code, n) of a partition's texts."""
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        texts = batch["text"].tolist()
        for at in range(0, len(texts), 256):
            s = _SYMBOL[np.frombuffer(b"  " + b"  ".join(t.encode() for t in texts[at : at + 256]) + b" ", np.uint8)]
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"code": seen, "n": total[seen]})


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-probability of a symbol after two others, from all texts, smoothed by shorter contexts."""
    found = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInPandas(trigrams, "code int, n long")
    rows = found.groupBy("code").agg(F.sum("n").alias("n")).collect()  # at most SYMBOLS ** 3 rows
    n = np.zeros(SYMBOLS**3)
    for row in rows:
        n[row.code] = row.n
    three = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5))


def _in_runs(noisy: str) -> list[bool]:
    """Whether each sign stands in a run of three or more."""
    return [len(m.group()) > 2 for m in re.finditer(r"(.)\1*", noisy, re.DOTALL) for _ in m.group()]


def _spelled(word: tuple | None) -> str:
    """The letters along the pointers back."""
    letters = []
    while word is not None:
        word, letter = word
        letters.append(letter)
    return "".join(reversed(letters))


class Restorer:
    """Reads noisy stretches as words."""

    def __init__(self, log_p: np.ndarray) -> None:
        self.log_p = log_p.ravel().tolist()
        self.known: dict[str, str] = {}

    def read(self, noisy: str) -> str:
        """The likeliest word behind a stretch of letters, stand-ins and separators.

        States are the last two symbols and the last letter; each keeps its
        best reading as a letter and a pointer back, so time and memory are in
        proportion to the stretch. A sign may be skipped, a letter written three
        times or more folded.
        """
        if noisy in self.known:
            return self.known[noisy]
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        for c, folds in zip(noisy, _in_runs(noisy), strict=True):
            after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            choices = [(c, 0.0)] if c.isalpha() else [(x, _STAND) for x in STANDS_FOR.get(c, "")]
            for (a, b, last), (p, word) in states.items():
                skip = p + (_NOISE if choices else _SKIP)
                if not c.isalpha() and skip > after.get((a, b, last), (-1e300,))[0]:
                    after[a, b, last] = (skip, word)
                for x, cost in choices:
                    s = ord(x) - 96 if "a" <= x <= "z" else 27
                    if folds and x == last and p + cost + _FOLD > after.get((a, b, last), (-1e300,))[0]:
                        after[a, b, last] = (p + cost + _FOLD, word)
                    q = p + cost + self.log_p[(a * SYMBOLS + b) * SYMBOLS + s]
                    if q > after.get((b, s, x), (-1e300,))[0]:
                        after[b, s, x] = (q, (word, x))
            states = after
        ends = [(p + self.log_p[(a * SYMBOLS + b) * SYMBOLS], word) for (a, b, _), (p, word) in states.items()]
        top = max(p for p, _ in ends)
        best = max(_spelled(word) for p, word in ends if p == top)
        if len(noisy) <= REMEMBERED and len(self.known) < 100_000:
            self.known[noisy] = best
        return best

    def restore(self, text: str) -> str:
        """The text in lower case with its noisy stretches read."""
        text = text.lower()
        text = _SPACED.sub(lambda m: self.read(m.group()), text) if self._spaced(text) else text
        data = text.encode()
        raw = np.frombuffer(b"  " + data + b"  ", np.uint8)
        kind = _CLASS[raw]
        letter, sign = kind == 1, kind >= 2
        follows = letter[2:] | sign[2:] & np.r_[letter[3:], False]
        marks = (kind == 2)[1:-1] & letter[2:] | sign[1:-1] & letter[:-2] & follows
        same = raw[1:] == raw[:-1]
        thrice = same[:-1] & same[1:] & letter[2:] & (raw[2:] < 128)
        if not (marks.any() or thrice.any()):
            return text
        blanks = np.flatnonzero(np.isin(raw[2:-2], _BLANK))
        out, done = [], 0
        for at in np.unique(np.r_[np.flatnonzero(marks) - 1, np.flatnonzero(thrice) - 2]).tolist():
            at = max(0, at)
            if at < done:
                continue
            next_ = int(np.searchsorted(blanks, at))
            left = int(blanks[next_ - 1]) + 1 if next_ else 0
            right = int(blanks[next_]) if next_ < len(blanks) else len(data)
            out += [data[done:left].decode(), self._token(data[left:right].decode())]
            done = right
        return "".join([*out, data[done:].decode()])

    def _token(self, token: str) -> str:
        core = token.strip(".,;:?\"'#%&*-_/\\{}[])~^`=>!$+|(<")
        return token.replace(core, " ".join(self.read(p) for p in re.findall(r"[^\s,;:?\"'#%&/\\{}\[\])~^`=>]+", self._lead(token, core))), 1) if core else token

    @staticmethod
    def _lead(token: str, core: str) -> str:
        """The core, and the stand-ins right before it."""
        at = token.index(core)
        while at and token[at - 1] in STANDS_FOR:
            at -= 1
        return token[at : token.index(core) + len(core)]

    @staticmethod
    def _spaced(text: str) -> bool:
        return bool(_SPACED.search(text))


def words_of(restored: str) -> bytes:
    """Words between single or more blanks, with a blank at either end; other signs are blanks."""
    return b" " + restored.encode().translate(_BLANKS) + b" "


def features_of(words: bytes) -> set[str]:
    """Whole words, as ' word ', and word beginnings, as ' wor'."""
    each = {w.decode("latin-1") for w in words.split()}
    return {f" {w} " for w in each} | {f" {w[:n]}" for w in each for n in STARTS if len(w) >= n}


@dataclass
class Model:
    log_p: np.ndarray
    features: list[str]
    weights: np.ndarray
    bias: float
    found: ahocorasick.Automaton | None = field(default=None, repr=False)
    restorer: Restorer | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("found", "restorer")} | {"found": None, "restorer": None}

    def hits(self, text: str) -> set[int]:
        """Places of the features that the restored text has."""
        if self.restorer is None:
            self.restorer = Restorer(self.log_p)
            self.found = ahocorasick.Automaton()
            for k, name in enumerate(self.features):
                self.found.add_word(name, k)
            self.found.make_automaton()
        if not self.features:
            return set()
        return {k for _, k in self.found.iter(words_of(self.restorer.restore(text)).decode("latin-1"))}

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[k] for k in sorted(self.hits(text)))
        return 1 / (1 + math.exp(-min(700.0, max(-700.0, z))))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label must not be learnt; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counts(log_p: np.ndarray):
    """A mapInPandas function: (text, toxic) to (feature, pos, neg) of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, counts = Restorer(log_p), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                counts[int(toxic)].update(features_of(words_of(restorer.restore(text))))
        names = list(counts[0].keys() | counts[1].keys())
        for at in range(0, len(names), 100_000):
            part = names[at : at + 100_000]
            yield pd.DataFrame({"feature": part, "pos": [counts[1][n] for n in part], "neg": [counts[0][n] for n in part]})

    return run


def _fit(rows: list[list[int]], toxic: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Logistic regression on the features' presence, by gradient steps with momentum and a small penalty."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    each = np.array([k for r in rows for k in r], np.int64)
    w, bias = np.zeros(size), math.log((toxic.sum() + 1) / (len(toxic) - toxic.sum() + 1))
    v, vb = np.zeros(size), 0.0
    rate = 0.5 / (1 + max(map(len, rows), default=0)) ** 0.5
    for _ in range(400):
        z = np.clip(bias + np.bincount(owner, w[each], len(rows)), -30, 30)
        gap = toxic - 1 / (1 + np.exp(-z))
        v = 0.9 * v + rate * (np.bincount(each, gap[owner], size) - 0.05 * w) / 20
        vb = 0.9 * vb + rate * gap.sum() / len(rows)
        w, bias = w + v, bias + vb
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, most: int = FEATURES) -> Model:
    """The language model of all docs and a classifier of the labelled ones.

    At most ``sample`` labelled rows, taken by the order of a hash of their id,
    are learnt from; held-out rows never. Null ids or labels don't take part,
    of several labels of an id the greatest counts, of several texts the least.
    Without labels of both
    kinds every text gets the share of label 1 among them as its score.
    """
    log_p = language_model(docs, text_col)
    learnt = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    chosen = learnt.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The sample has a fixed bound, so it may be broadcast at any size of the corpus.
    drawn = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    total, toxic = drawn.agg(F.count("*"), F.sum("toxic")).first()
    if not total or toxic in (0, total):
        share = (toxic or 0) / total if total else 0.0
        return Model(log_p, [], np.zeros(0), math.log((share + 1e-9) / (1 - share + 1e-9)))
    counts = drawn.mapInPandas(_counts(log_p), "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 4")
    part = lambda x, of: x * F.log((x + 1e-9) / of)
    here, share = F.col("pos") + F.col("neg"), toxic / total
    gain = 2 * (part(F.col("pos"), here * share) + part(F.col("neg"), here * (1 - share)) + part(toxic - F.col("pos"), (total - here) * share + 1e-9) + part(total - toxic - F.col("neg"), (total - here) * (1 - share) + 1e-9))
    found = counts.withColumn("gain", gain).where((F.col("gain") > 30) & (F.col("pos") > 5 * share * here / (1 + 4 * share)))
    features = [r.feature for r in found.orderBy(F.desc("gain"), "feature").limit(most).select("feature").collect()]
    model = Model(log_p, features, np.zeros(len(features)), 0.0)

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"hits": [sorted(model.hits(t)) for t in batch["text"]], "toxic": batch["toxic"]})

    rows = drawn.mapInPandas(seen, "hits array<int>, toxic int").collect()  # at most ``sample`` rows
    weights, bias = _fit([list(r.hits) for r in rows], np.array([r.toxic for r in rows]), len(features))
    return Model(log_p, features, weights, bias)


def scored(model: Model, text: Column) -> Column:
    """The score of a text column, 0 to 1; a null text counts as empty."""

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return F.pandas_udf(score, T.DoubleType())(F.coalesce(text.cast("string"), F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs, repeated ones too.

    Null and empty texts get the score of a text without any known word; a text
    of any length is read to its end. An empty table gives an empty result; other columns are not looked at.
    """
    model = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), scored(model, F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose score reaches the threshold; columns stay."""
    model = train(docs, labels, id_col, text_col)
    return docs.where(scored(model, F.col(text_col)) < THRESHOLD)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
