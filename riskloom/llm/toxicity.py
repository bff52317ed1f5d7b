"""Toxicity of restored text: a noisy channel undone by Viterbi decoding, then a score.

1. A character trigram model is counted over all documents, whole texts, one table of
   counts a task; the alphabet is fixed, so the model is ``SYMBOLS ** 3`` numbers at most.
2. Spans that look disguised (leetspeak signs inside words, letters held three times and
   more, letters set apart by spaces or signs) become a lattice: a sign may stand for
   itself or a letter, a held letter for one or two, a separator for nothing or a word's
   end. Viterbi decoding finds the path that channel and language model together find
   likeliest, and the text is restored with it. All other text is a lattice of one path.
3. The score reads the restored text only. Words and word beginnings that mark toxic
   documents are weighed by log-odds on one half of the labelled rows; a logistic curve
   over the strongest mark, the number and the density of marks is fitted on the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.words import (
    LETTERS_DIGITS, Words, as_long, byte_values, factors, mix, pieces, split_words, text_bytes,
)

PIECE = 2 << 20
#: Labelled rows that the score is fitted on at most, chosen by a hash of their id.
MOST_LABELS = 40_000
#: Words and word beginnings that may carry weight.
MOST_MARKS = 20_000
#: Letters set apart are several words from so many on, and word ends between them likely.
SEVERAL = 16
#: Decoded spans that a task remembers, and how long such a span is at most.
REMEMBERED, REMEMBERED_SIGNS = 100_000, 80

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
SYMBOLS = 64
_END, _DIGIT, _OTHER = 0, 62, 63
_SYMBOL = {c: i + 1 for i, c in enumerate(LETTERS)} | {c: _DIGIT for c in "0123456789"}
_OF_CODE = np.zeros(0x3000, np.uint32)
for _code in range(0x3000):
    if chr(_code).isalnum():
        _OF_CODE[_code] = _SYMBOL.get(chr(_code), _OTHER)

#: What a sign of leetspeak can stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}
#: Log-probabilities of the channel.
AS_LETTER, AS_ITSELF, HELD_ONE, HELD_TWO, HELD_AS_IS, DOUBLE_AS_ONE, DROPPED, KEPT_APART, KEPT_FIRST = (
    -1.0, -0.5, -0.5, -1.5, -6.0, -6.0, -0.2, -6.0, -1.0,
)  # the last: the first letter set apart is a word of its own, as in "a f o o l"
#: A word's end between letters set apart that are several words.
KEPT_AMONG_SEVERAL = -1.6
#: Of the signs that end a token, these seldom stand for themselves.
SELDOM_LAST, LAST_AS_ITSELF = "@$", -6.0

_SIGN = r"(?:[^\W_]|[@$!|+])"
_APART = re.compile(rf"(?<![\w@$!|+])(?:{_SIGN}[ .\-_*~]){{2,}}{_SIGN}(?![\w@$!|+])")
#: In a token that may be disguised: a sign of leetspeak, or a letter held.
_HINT = re.compile(r"[0-9@$!|+]|([^\W\d_])\1\1", re.IGNORECASE)


def _is_sign(c: str) -> bool:
    return c.isalnum() or c in "@$!|+"



# -- the language model -------------------------------------------------------------------


def _symbols(texts: list[str | None]) -> np.ndarray:
    codes = np.frombuffer("\n".join(t or "" for t in texts).lower().encode("utf-32-le", "replace"), np.uint32)
    symbols = np.where(codes < len(_OF_CODE), _OF_CODE.take(codes, mode="clip"), _OTHER).astype(np.uint32)
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != _END) | (symbols[:-1] != _END)
    return symbols[keep]


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for piece in pieces(batch, 0, PIECE):
            s = _symbols(["", *piece.column(0).to_pylist(), ""])
            if len(s) > 2:
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["gram", "n"])


def letter_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``gram, n``: how often each run of three symbols occurs in all texts."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    return texts.mapInArrow(_count_letters, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def letter_model(counts: pd.DataFrame) -> list[float]:
    """Log-probability of a symbol after two others; unseen contexts fall back to one."""
    n = np.zeros(SYMBOLS**3)
    n[counts["gram"].to_numpy(np.int64)] = counts["n"].to_numpy(np.float64)
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs = n.sum(axis=0)
    single = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * SYMBOLS)
    after_one = (pairs + 20 * single) / (pairs.sum(axis=1, keepdims=True) + 20)
    after_two = (n + 20 * after_one[None]) / (n.sum(axis=2, keepdims=True) + 20)
    return np.log(after_two).ravel().tolist()


# -- the noisy channel --------------------------------------------------------------------


def _lattice(span: str, apart: bool) -> list[list[tuple[str, float]]]:
    """For each run of one character what it can stand for."""
    units = []
    kept = KEPT_AMONG_SEVERAL if apart and len(span) > 2 * SEVERAL else KEPT_APART
    last = len(span) if apart else len(span.rstrip("@$!|+"))
    for match in re.finditer(r"(.)\1*", span.lower(), re.DOTALL):
        c, r = match[1], len(match[0])
        if c in " .-_*~":
            units.append([("", DROPPED), (" ", KEPT_FIRST if len(units) == 1 else kept)])
        elif c in STANDS_FOR:
            seldom = c in SELDOM_LAST and match.start() >= last
            arcs = [(c * r, LAST_AS_ITSELF if seldom else AS_ITSELF * r)]
            for letter in STANDS_FOR[c]:
                arcs.append((letter, AS_LETTER if r == 1 else AS_LETTER + HELD_ONE))
                if r > 1:
                    arcs.append((letter * 2, AS_LETTER + HELD_TWO * (r > 2)))
            units.append(arcs)
        elif r == 1:
            units.append([(c, 0.0)])
        elif r == 2:
            units.append([(c * 2, 0.0), (c, DOUBLE_AS_ONE)])
        else:
            units.append([(c, HELD_ONE), (c * 2, HELD_TWO), (c * r, HELD_AS_IS)])
    return units


def viterbi(span: str, model: list[float]) -> str:
    """The likeliest reading of a disguised span."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(_END, _END): (0.0, ())}  # a reading is linked from its end
    apart = _APART.fullmatch(span) is not None
    for arcs in _lattice(span, apart):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (p, read) in best.items():
            for text, cost in arcs:
                q, x, y = p + cost, a, b
                for c in text:
                    z = _SYMBOL.get(c, _OTHER if c.isalnum() else _END)
                    if z != _END or y != _END:
                        q += model[(x * SYMBOLS + y) * SYMBOLS + z]
                        x, y = y, z
                if (x, y) not in after or q > after[x, y][0]:
                    after[x, y] = (q, (read, text))
        best = after
    read = max(
        (  # signs that end a token may have ended its word
            (p if b == _END and not apart else p + model[(a * SYMBOLS + b) * SYMBOLS + _END], read)
            for (a, b), (p, read) in best.items()
        ),
        key=lambda end: end[0],
    )[1]
    parts = []
    while read:
        read, text = read
        parts.append(text)
    return "".join(reversed(parts))


class Restorer:
    """Restores texts under a language model."""

    def __init__(self, model: list[float]):
        self.model, self.known = model, {}

    def span(self, span: str) -> str:
        if len(span) > REMEMBERED_SIGNS:
            return viterbi(span, self.model)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if span not in self.known:
            self.known[span] = viterbi(span, self.model)
        return self.known[span]

    def _apart(self, match: re.Match) -> str:
        signs = match[0][::2].lower()
        if not any(c.isalpha() for c in signs) and (len(signs) < 4 or len(set(signs)) < 3):
            return match[0]
        return self.span(match[0])

    def _token(self, token: str) -> str:
        if len(token) < 3 or not any(c.isalpha() for c in token) or not _HINT.search(token):
            return token
        return self.span(token)

    def text(self, text: str) -> str:
        text = _APART.sub(self._apart, text)
        out, done = [], 0
        for hint in _HINT.finditer(text):
            low, high = hint.span()
            if low < done:
                continue
            while low > done and _is_sign(text[low - 1]):
                low -= 1
            while high < len(text) and _is_sign(text[high]):
                high += 1
            out += [text[done:low], self._token(text[low:high])]
            done = high
        return "".join(out) + text[done:]


_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[0x30:0x3A] = True
_IS_LEET = _IS_DIGIT.copy()
_IS_LEET[[ord(c) for c in "@$!|+"]] = True
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[ord(c) for c in " .-_*~"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _maybe_disguised(texts: pa.Array) -> np.ndarray:
    """The rows that may hold a disguised span; all others are surely plain."""
    data, places = text_bytes(texts)
    low, high = int(places[0]), int(places[-1])
    b = _LOWER.take(data[low:high])
    letter, leet, gap = (t.take(b) for t in (_IS_LETTER, _IS_LEET, _IS_GAP))
    hints = [np.flatnonzero((leet[:-1] & letter[1:]) | (letter[:-1] & leet[1:]))]
    hints.append(np.flatnonzero(letter[2:] & (b[2:] == b[1:-1]) & (b[1:-1] == b[:-2])))
    wide = b >= 0x80
    n = max(len(b) - 5, 0)
    held = np.ones(n, bool)  # three wide letters that may be one, in either case
    for i in range(6):
        held &= wide[i:][:n]
    hints.append(np.flatnonzero(held))
    hints.append(np.flatnonzero((b[:-1] == 0xE2) & (b[1:] == 0x84)))  # signs that are ASCII letters in lower case
    # letters set apart, of any widths; a wide character may be a letter or none
    starts = np.flatnonzero((b & 0xC0) != 0x80)
    opens, sets_apart = (letter | leet).take(starts), gap.take(starts)
    row_starts = np.zeros(len(b) + 1, bool)
    row_starts[places - low] = True
    first = row_starts.take(starts)
    ends = ~opens | wide.take(starts)
    before, after = np.ones(len(starts), bool), np.ones(len(starts), bool)
    before[1:] = ends[:-1] | first[1:]
    after[:-1] = ends[1:] | first[1:]
    n = len(starts) - 4
    if n > 0:
        apart = before[:n] & opens[:n] & sets_apart[1:][:n] & opens[2:][:n] & sets_apart[3:][:n] & opens[4:][:n] & after[4:][:n]
        hints.append(starts[np.flatnonzero(apart)])
    rows = np.searchsorted(places - low, np.concatenate(hints), "right") - 1
    return np.unique(rows[(rows >= 0) & (rows < len(texts))])


def restore(texts: pa.Array, restorer: Restorer) -> pa.Array:
    rows = _maybe_disguised(texts)
    if not len(rows):
        return texts
    out = texts.to_pylist()
    for i in rows.tolist():
        if out[i]:
            out[i] = restorer.text(out[i])
    return pa.array(out, pa.string())


# -- the score ----------------------------------------------------------------------------

#: Bytes of the word beginnings that can be marks, besides whole words.
BEGINNINGS = (4, 5, 6, 8)


def _marks(words: Words) -> list[np.ndarray]:
    """For each word its own hash and those of its beginnings, 0 where it is too short."""
    values = byte_values(LETTERS_DIGITS, True)
    scale = factors(np.arange(max(BEGINNINGS)))
    out = [words.hashes]
    total = np.zeros(len(words.starts), np.uint64)
    last = len(words.data) - 1
    for p in range(max(BEGINNINGS)):
        total = total + values.take(words.data.take(np.minimum(words.starts + p, last))) * scale[p]
        if p + 1 in BEGINNINGS:
            out.append(np.where(words.lengths > p + 1, mix(total ^ np.uint64((p + 1) << 56)), np.uint64(0)))
    return out


@dataclass
class ToxicityModel:
    """What scoring needs: the language model, the marks (ascending) with their weights,
    and the curve."""

    letters: list[float]
    marks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    curve: np.ndarray | None = None

    def figures(self, texts: pa.Array) -> np.ndarray:
        """For each (restored) text the strongest mark, the number of marks and their density."""
        out = np.zeros((len(texts), 3))
        words = split_words(texts, LETTERS_DIGITS, lower=True)
        if not len(self.marks) or not len(words.starts):
            return out
        own = np.zeros(len(words.starts))
        maybe = np.zeros(1 << 20, bool)
        maybe[(self.marks & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for hashes in _marks(words):
            hit = np.flatnonzero(maybe.take((hashes & np.uint64((1 << 20) - 1)).astype(np.int64)))
            at = np.minimum(np.searchsorted(self.marks, hashes[hit]), len(self.marks) - 1)
            same = self.marks[at] == hashes[hit]
            own[hit[same]] = np.maximum(own[hit[same]], self.weights[at[same]])
        marked = np.flatnonzero(own)
        text = np.searchsorted(words.first, marked, "right") - 1
        np.maximum.at(out[:, 0], text, own[marked])
        count = np.bincount(text, minlength=len(texts))
        out[:, 1] = np.log1p(count)
        out[:, 2] = count / np.maximum(words.counts, 1)
        return out

    def scores(self, figures: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(figures))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + figures @ self.curve[1:], -30, 30)))


def _train_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``text, toxic, half`` of the labelled rows that may be learnt from. At most ``most``
    labels are used, so that side of the join is broadcast."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id")).limit(most)
        .withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int"))
    )
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic", "half")


def _count_marks(model: ToxicityModel, candidates: np.ndarray | None):
    """Documents that hold each mark: of toxic ones all marks, of others ``candidates``.
    ``kinds`` has a bit for the smallest word hash of each document: copies share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.letters)
        for batch in batches:
            for piece in pieces(batch, 0, PIECE):
                words = split_words(restore(piece.column(0), restorer), LETTERS_DIGITS, lower=True)
                all_marks = _marks(words)
                found, kinds = [], []
                for i in range(piece.num_rows):
                    own = np.unique(np.concatenate([m[words.of(i)] for m in all_marks]))
                    own = own[own != 0]
                    if candidates is not None:
                        own = own[np.isin(own, candidates)]
                    found.append(own)
                    least = words.hashes[words.of(i)].min() if words.counts[i] else np.uint64(0)
                    kinds.append(np.full(len(own), np.uint64(1) << (least & np.uint64(63))))
                marks, at, n = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
                bits = np.zeros(len(marks), np.uint64)
                np.bitwise_or.at(bits, at, np.concatenate(kinds) if kinds else np.zeros(0, np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(marks)), pa.array(n.astype(np.int64)), pa.array(as_long(bits))],
                    ["mark", "n", "kinds"],
                )

    return run


def _figures(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.letters)
        for batch in batches:
            for piece in pieces(batch, 0, PIECE):
                figures = model.figures(restore(piece.column(0), restorer))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(1), *(pa.array(figures[:, k]) for k in range(3))], ["toxic", "x", "y", "z"]
                )

    return run


def _logistic(x: np.ndarray, y: np.ndarray, weight: float = 1e-3) -> np.ndarray:
    """Newton's method for a ridge logistic regression, the first coefficient the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (p - y) + weight * len(x) * 1e-2 * beta
        curvature = (x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1]) * weight * len(x) * 1e-2
        step = np.linalg.solve(curvature, slope)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _likelihood_ratio(t: np.ndarray, m: np.ndarray, toxic: int, plain: int) -> np.ndarray:
    """The G statistic of a mark in ``t`` of the toxic and ``m`` of the other documents."""
    cells = [(t, toxic), (m, plain), (toxic - t, toxic), (plain - m, plain)]
    held = (t + m) / (toxic + plain)
    expected = [held, held, 1 - held, 1 - held]
    terms = [n * np.log(np.maximum(n, 1e-9) / np.maximum(total * share, 1e-9)) for (n, total), share in zip(cells, expected, strict=True)]
    return 2 * np.sum(terms, axis=0)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, most_marks: int = MOST_MARKS,
    least_documents: int = 4, least_kinds: int = 4,
) -> ToxicityModel:
    """The model. The language model reads all of ``docs`` (``doc_id, text``); the score
    is fitted on at most ``most_labels`` rows of ``labels`` (``doc_id, toxic``).

    A mark is one of toxic documents at least ``least_documents`` times, in documents of
    at least ``least_kinds`` kinds, so that copies of one document make no mark."""
    letters = letter_model(letter_counts(docs).toPandas())
    model = ToxicityModel(letters)
    rows = _train_rows(docs, labels, most_labels)
    first = rows.where("half = 0")
    totals = {r["toxic"]: r["n"] for r in first.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (totals.get(0) and totals.get(1)):
        return model
    schema = "mark long, n long, kinds long"
    least = max(least_documents, totals[1] // 500)
    toxic = (
        first.where("toxic = 1").select("text").mapInArrow(_count_marks(model, None), schema)
        .groupBy("mark").agg(F.sum("n").alias("n"), F.bit_or("kinds").alias("kinds"))
        .where(F.col("n") >= least).where(F.bit_count("kinds") >= least_kinds)
        .orderBy(F.desc("n"), "mark").limit(10 * most_marks).toPandas()
    )
    candidates = np.sort(toxic["mark"].to_numpy(np.int64).view(np.uint64))
    plain = (
        first.where("toxic = 0").select("text").mapInArrow(_count_marks(model, candidates), schema)
        .groupBy("mark").agg(F.sum("n").alias("m")).toPandas()
    )
    both = toxic.merge(plain, how="left", on="mark").fillna({"m": 0})
    t, m = both["n"].to_numpy(float), both["m"].to_numpy(float)
    odds = np.log((t + 0.5) / (totals[1] - t + 0.5)) - np.log((m + 0.5) / (totals[0] - m + 0.5))
    sure = _likelihood_ratio(t, m, totals[1], totals[0])
    both = both.assign(odds=odds, sure=sure)[(sure > 30) & (odds > 1.5)].nlargest(most_marks, "sure")
    hashes = both["mark"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model.marks, model.weights = hashes[order], both["odds"].to_numpy()[order]
    second = rows.where("half = 1").select("text", "toxic").mapInArrow(
        _figures(model), "toxic int, x double, y double, z double"
    ).toPandas()
    if second["toxic"].nunique() == 2:
        model.curve = _logistic(second[["x", "y", "z"]].to_numpy(), second["toxic"].to_numpy(float))
    return model


def _score(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.letters)
        for batch in batches:
            for piece in pieces(batch, 1, PIECE):
                scores = model.scores(model.figures(restore(piece.column(1), restorer)))
                yield pa.RecordBatch.from_arrays([*piece.columns[:1], pa.array(scores), *piece.columns[2:]],
                                                 [piece.schema.names[0], "score", *piece.schema.names[2:]])

    return run


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    most_labels: int = MOST_LABELS, threshold: float = 0.3,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Only the text is scored. ``held_out`` rows, whose crc32 of the id as text leaves 2
    when divided by 4, are never learnt from. Null and empty texts get the score of a
    text without marks. Labels without an id or a value are left out; of several labels
    of one id the largest counts. Repeated rows are repeated in the result; a row without
    an id is scored and not held out. Without labels of both kinds every score is 0.
    Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = fit_toxicity(texts, labels, most_labels)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    scored = texts.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def restored_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``restored``: the text as Viterbi decoding reads it (null stays null)."""
    model = letter_model(letter_counts(docs, text_col).toPandas())

    @F.pandas_udf("string")
    def read(column: pd.Series) -> pd.Series:
        restorer = Restorer(model)
        return pd.Series(restore(pa.array(column, pa.string()), restorer).to_pylist(), dtype="object")

    return docs.withColumn("restored", read(F.col(text_col).cast("string")))
