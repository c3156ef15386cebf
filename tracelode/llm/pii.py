"""Personal data found by patterns and by a linear-chain conditional random field.

The field labels the words of a line from their shapes and the shapes of their
neighbours. It is trained here on a small table of labelled lines and decoded
by Viterbi over batches of lines in numpy. The patterns' spans stay; the field
adds what no pattern can tell by itself, numbers that are a phone number or an
identity number by their shape and place.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents

BASE = ("email", "ip", "card", "phone")
ADDED = {"PHONE": "local_phone", "ID": "id_number"}

# ---- patterns ---------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from each @ to both sides, not before the end of the last match."""
    found, over, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > over and text[start - 1] in _LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            found.append((start, end.end()))
            over = end.end()
        else:
            over = max(over, at + 1)  # nothing can reach across an @ to a later one
        at = text.find("@", max(over, at + 1))
    return found


def _ips(text: str) -> list[tuple[int, int]]:
    """A match starts at the head of a run of digits: later starts in the run fail when that does."""
    return [m.span() for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m.group().split("."))]


def _luhn(digits: list[int]) -> bool:
    digits = digits[::-1]
    return (sum(digits[::2]) + sum(2 * d - 9 * (d > 4) for d in digits[1::2])) % 10 == 0


def _cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := [int(c) for c in m.group() if c not in " -"]) <= 19 and _luhn(digits):
            found.append(m.span())
    return found


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by kind as listed and then by start."""
    found = [("email", *s) for s in _emails(text)] if "@" in text else []
    for kind, find in (("ip", _ips), ("card", _cards), ("phone", _phones)):
        found += [(kind, *s) for s in find(text)]
    return found


# ---- the labelled table -------------------------------------------------------

LABELS = ("O", "EMAIL", "IP", "CARD", "PHONE", "ID")

# Lines with slots; a slot's words get its label. The small table is these lines, filled in.
TEMPLATES = (
    "please call {PHONE} before noon", "her number is {PHONE} , ask for the desk", "tel {PHONE}", "Phone : {PHONE} or mail {EMAIL}",
    "reach me at {EMAIL} or {PHONE} today", "contact {EMAIL}", "from {EMAIL} to {EMAIL} about the order", "they wrote to {EMAIL} again .",
    "the host {IP} did not answer", "ping {IP} and {IP} first", "traffic from {IP} was dropped", "login from {IP} , card {CARD}",
    "card {CARD} was charged", "pay with {CARD} please", "the number {CARD} is on file", "paid by {CARD} and called {PHONE}",
    "her id number is {ID}", "SSN {ID} was given", "the form shows {ID} as the id", "{ID} belongs to the client", "id {ID} and phone {PHONE}",
    "it was {N} or {N} of them", "in {YEAR} the price was {PRICE} for {N} units", "version {VERSION} came out in {YEAR}", "see page {N} , line {N}",
    "on {DATE} at {TIME} it began", "the code is {HEX} and key={HEX}", "token = {HEX}", "items {N}, {N}, {N} and {N} are sold out", "GNU General Public License, version {N}",
    "CC BY-NC {VERSION} license", "chapter {N}. the river", "between {YEAR} and {YEAR} or so", "order {LONG} was sent", "the total is {PRICE}",
    "nothing of that kind stands here", "A well-known fact , it seems .", "THIS!! IS!! LOUD!!", "so | it | goes | on", "they met on the {N}th of May, {YEAR}.",
    "ratio {N}:{N} at {N}% of {N}", "https://example.org/a/{N}?page={N}", "#{N} of {N}", "({N}) first, ({N}) second", "from {DATE} to {DATE}",
)


def _filled(rng: random.Random, slot: str) -> list[str]:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda n: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(n))
    if slot == "PHONE":
        return rng.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(11)}", f"({d(3)}){d(3)}-{d(4)}"]).split(" ")
    if slot == "EMAIL":
        return [f"{w(rng.randint(3, 8))}{rng.choice(['', '.', '_'])}{rng.choice([d(2), w(4)])}@{w(5)}{rng.choice(['', d(1)])}.{rng.choice(['example.com', 'com', 'org'])}"]
    if slot == "IP":
        return [".".join(str(rng.randint(1, 255)) for _ in range(4))]
    if slot == "CARD":
        return rng.choice([d(16), f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", d(15)]).split(" ")
    if slot == "ID":
        return [f"{d(3)}-{d(2)}-{d(4)}"]
    return [
        {"N": str(rng.choice([rng.randint(0, 99), rng.randint(100, 999), rng.randint(0, 9)])), "YEAR": str(rng.randint(1800, 2030)), "PRICE": f"${rng.randint(1, 999)}.{d(2)}", "VERSION": f"{rng.randint(0, 9)}.{rng.randint(0, 20)}"}.get(slot)
        or {"DATE": rng.choice([f"{rng.randint(1990, 2030)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{rng.randint(1990, 2030)}"]), "TIME": f"{d(2)}:{d(2)}", "HEX": rng.choice(["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 40]))), "AKIA" + "".join(rng.choice("ABCDEFGH0123456789") for _ in range(16))]), "LONG": d(rng.choice([5, 6, 8]))}[slot]
    ]


@lru_cache(maxsize=1)
def labelled_table(rounds: int = 8, seed: int = 7) -> tuple[tuple[tuple[str, ...], tuple[int, ...]], ...]:
    """Lines of words with a label each."""
    rng, rows = random.Random(seed), []
    for template in TEMPLATES * rounds:
        words, labels = [], []
        for part in template.split(" "):
            slot = re.fullmatch(r"(.*)\{([A-Z]+)\}(.*)", part)
            if not slot:
                words.append(part)
                labels.append(0)
                continue
            new = _filled(rng, slot[2])
            if slot[2] not in LABELS:
                while (m := re.search(r"\{([A-Z]+)\}", part)):
                    part = part.replace(m.group(), _filled(rng, m[1])[0], 1)
                new = [part]
            elif rng.random() < 0.3:
                new[-1] += rng.choice(",.;")
            words += new
            labels += [LABELS.index(slot[2]) if slot[2] in LABELS else 0] * len(new)
        rows.append((tuple(words), tuple(labels)))
    return tuple(rows)


# ---- the field ------------------------------------------------------------------

#: Values that each attribute of a shape takes, in the order of _attributes.
SIZES = (10, 6, 3, 2, 4, 4, 2, 2)
SHAPES = int(np.prod(SIZES))
_DIGITS = [0, 1, 2, 3, 4, 5, 6, 6, 6, 6, 7, 7, 7]
_NON_DIGIT = str.maketrans("", "", "0123456789")


def _attributes(word: str) -> tuple[int, ...]:
    core = word.rstrip(".,;:!?\"'")
    rest = core.translate(_NON_DIGIT)
    n = len(core) - len(rest)
    head = core[:1]
    first = 0 if not head else 1 if head in "+" else 2 if head == "(" else 3 if head in "0123456789" else 4 if head.isupper() else 5
    letters = sum(c.isalpha() for c in rest)
    return (
        _DIGITS[n] if n < 13 else 8 if n < 17 else 9,
        first,
        0 if not letters else 1 if letters == len(rest) else 2,
        int("@" in core),
        min(3, core.count(".")),
        min(3, core.count("-")),
        int("(" in core or ")" in core),
        int("/" in core or ":" in core or "=" in core or "$" in core or "%" in core or "#" in core),
    )


def shape(word: str) -> int:
    code = 0
    for value, size in zip(_attributes(word), SIZES, strict=True):
        code = code * size + value
    return code


def _padded(rows: list[list[int]], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows)) + 2), fill)
    for k, row in enumerate(rows):
        out[k, 1 : len(row) + 1] = row
    return out


class Field:
    """Weights of a linear-chain conditional random field over shapes.

    ``emit[k]`` gives the weight of each label for the shape of the word
    before, at and after a place (k = 0, 1, 2), the last row for the edge of a
    line; ``step`` that of each pair of labels in turn.
    """

    def __init__(self, emit: np.ndarray, step: np.ndarray) -> None:
        self.emit, self.step = emit, step

    def potentials(self, rows: list[list[int]]) -> np.ndarray:
        p = _padded(rows, SHAPES)
        return self.emit[0][p[:, :-2]] + self.emit[1][p[:, 1:-1]] + self.emit[2][p[:, 2:]]

    def decode(self, rows: list[list[int]], cells: int = 1 << 18) -> list[np.ndarray]:
        """The likeliest labels of each row of shapes; rows of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
        order = sorted((k for k in range(len(rows)) if rows[k]), key=lambda k: -len(rows[k]))
        while order:
            take = max(1, cells // len(rows[order[0]]))
            part, order = order[:take], order[take:]
            e = self.potentials([rows[k] for k in part])
            sizes = np.array([len(rows[k]) for k in part])
            best, back = e[:, 0], np.zeros(e.shape, np.int8)
            for t in range(1, e.shape[1]):
                alive = int((sizes > t).sum())  # the longest rows come first
                ways = best[:alive, :, None] + self.step[None]
                back[:alive, t] = ways.argmax(axis=1)
                best = np.concatenate([ways.max(axis=1) + e[:alive, t], best[alive:]])
            now = best.argmax(axis=1)
            path = np.zeros(e.shape[:2], np.int64)
            for t in range(e.shape[1] - 1, -1, -1):
                alive = int((sizes > t).sum())
                path[:alive, t] = now[:alive]
                now = np.concatenate([back[np.arange(alive), t, now[:alive]] if t else now[:alive], now[alive:]])
            for k, row in zip(part, path, strict=True):
                out[k] = row[: len(rows[k])]
        return out


def _spread() -> np.ndarray:
    """One row for each shape and one for the edge: which attribute values it has."""
    code = np.arange(SHAPES)
    columns, total = [], sum(SIZES) + 1
    for size in reversed(SIZES):
        columns.append(code % size)
        code = code // size
    out, base = np.zeros((SHAPES + 1, total)), 0
    for size, column in zip(SIZES, reversed(columns), strict=True):
        out[np.arange(SHAPES), base + column] = 1
        base += size
    out[SHAPES, -1] = 1
    return out


@lru_cache(maxsize=1)
def trained(steps: int = 150) -> Field:
    """The field fitted to the labelled table by gradient steps on its log-likelihood."""
    table = labelled_table()
    rows = [[shape(w) for w in words] for words, _ in table]
    p, y = _padded(rows, SHAPES), _padded([list(ls) for _, ls in table], 0)[:, 1:-1]
    mask = np.arange(y.shape[1])[None, :] < np.array([len(r) for r in rows])[:, None]
    used, back = np.unique(p, return_inverse=True)
    feats = _spread()[used]
    p = back.reshape(p.shape)
    count, labels = feats.shape[1], len(LABELS)
    weights, step = np.zeros((3, count, labels)), np.zeros((labels, labels))
    first, second, first_s, second_s = (np.zeros_like(x) for x in (weights, weights, step, step))
    gold = np.eye(labels)[y] * mask[..., None]
    pairs = np.einsum("bti,btj->ij", gold[:, :-1], gold[:, 1:])
    for it in range(1, steps + 1):
        emit = feats @ weights
        e = emit[0][p[:, :-2]] + emit[1][p[:, 1:-1]] + emit[2][p[:, 2:]]
        n = e.shape[1]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
        for t in range(1, n):
            new = lse(alpha[:, t - 1, :, None] + step[None], 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(n - 2, -1, -1):
            new = lse(step[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
        z = lse(alpha[:, -1], 1)
        gap = gold - np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        both = np.exp(alpha[:, :-1, :, None] + step[None, None] + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        g = np.zeros_like(weights)
        for k in range(3):
            flat = np.zeros((len(used), labels))
            np.add.at(flat, p[:, k : n + k].ravel(), gap.reshape(-1, labels))
            g[k] = feats.T @ flat
        g, gs = g / len(rows) - 0.002 * weights, (pairs - both.sum(axis=(0, 1))) / len(rows) - 0.002 * step
        for w, grad, m, v in ((weights, g, first, second), (step, gs, first_s, second_s)):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            w += 0.1 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    return Field(_spread() @ weights, step)


# ---- both together ------------------------------------------------------------------


class _Shapes(dict):
    def __missing__(self, word: str) -> int:
        code = shape(word)
        if len(self) < 200_000:
            self[word] = code
        return code


_shapes = _Shapes()
_WORD = re.compile(r"\S+")


def field_spans(texts: list[str], field: Field | None = None) -> list[list[tuple[str, int, int]]]:
    """What the field finds in each text, line by line.

    Only lines with a digit are decoded. A line without one can't hold a kind
    that the field adds, so nothing is lost.
    """
    field = field or trained()
    rows, where = [], []
    for k, text in enumerate(texts):
        at = -1
        while m := _NUMBER.search(text, at + 1):
            a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
            b = b if b >= 0 else len(text)
            words = [(w.group(), a + w.start(), a + w.end()) for w in _WORD.finditer(text[a:b])]
            rows.append([_shapes[w] for w, _, _ in words])
            where.append((k, words))
            at = b
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (k, words), labels in zip(where, field.decode(rows), strict=True):
        t = 0
        for t in np.flatnonzero(labels):
            name = LABELS[labels[t]]
            if name not in ADDED or t and labels[t - 1] == labels[t]:
                continue
            u = t
            while u + 1 < len(labels) and labels[u + 1] == labels[t]:
                u += 1
            last = words[u][0]
            end = words[u][2] - (len(last) - len(last.rstrip(".,;:!?\"'")))
            start = words[t][1]
            if end > start and 7 <= sum(c in "0123456789" for w, _, _ in words[t : u + 1] for c in w) <= 15:
                out[k].append((ADDED[name], int(start), int(end)))
    return out


_NUMBER = re.compile(r"[0-9]")


def all_spans(texts: list[str], field: Field | None = None) -> list[list[tuple[str, int, int]]]:
    """Base spans, then added ones that touch none of them; by kind and then by start."""
    some = [k for k, t in enumerate(texts) if _ANY.search(t)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for k, added in zip(some, field_spans([texts[k] for k in some], field), strict=True):
        base = base_spans(texts[k])
        free = [s for s in added if all(s[2] <= a or b <= s[1] for _, a, b in base)]
        out[k] = base + sorted(free, key=lambda s: (list(ADDED.values()).index(s[0]), s[1]))
    return out


def personal_spans(field: Field):
    """A function of a text column: kind:start:end of everything found, by kind as listed and then by start."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[f"{k}:{a}:{b}" for k, a, b in found] for found in all_spans(texts.tolist(), field)])

    return spans


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row: spans lists kind:start:end in code points.

    A null text is read as an empty one and has no spans. The field is trained
    once, on the driver, and its weights go to the tasks. Rows aren't joined or
    grouped, so null and repeated ids and extra columns don't matter.
    """
    return docs.select(id_col, personal_spans(trained())(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("spans"))


def _of(kinds: tuple[str, ...]) -> Column:
    return F.filter("spans", lambda x: F.substring_index(x, ":", 1).isin(*kinds))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find_personal(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[F.size(_of((k,))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(_of(BASE), ","), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
    )
