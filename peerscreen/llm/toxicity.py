"""Toxicity from bags of subword embeddings.

A word is the bag of its character n-grams and itself; each hashes to a row of an embedding
table, and a window of words is the average of its words' averages. One linear softmax layer
reads the average. Table and layer are trained jointly in numpy, so a misspelling that no
label ever showed still shares most of its n-grams, and their vectors, with the word it hides.
A text is as toxic as its most toxic windows: a smooth maximum joins their scores, in training
and in scoring, so that a few words in a long text aren't averaged away.

The layer is linear in the average, so scoring needs one number per table row; that table
has a fixed size and is broadcast. Labels are drawn by hash, up to MAX_ROWS rows and about
MAX_CHARS characters; everything else reads all rows.

Edge cases: null, empty and blank texts score the layer's bias; documents without a label are
scored like all others; rows of one doc_id that repeat in the labels count once, toxic if any
says so; null labels and ids aren't learnt from; without both kinds of labels the model returns
their share; repeated documents score alike, each in its row.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from peerscreen.llm.common import clear

MAX_ROWS = 6_000
MAX_CHARS = 16_000_000
BUCKETS = 1 << 17
SIZES = (3, 4, 5)
DIM = 8
WINDOW = 4
ROUNDS = 40
RATE = 0.1
DECAY = 1e-5
SMOOTH = 0.5
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KEPT_WORDS = 400_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(33))) & np.uint64(BUCKETS - 1)


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(table row, word number) of every n-gram of every word, and of the words themselves."""
    text = "".join(f"<{w.strip(EDGE) or w}>" for w in words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w.strip(EDGE) or w) + 2 for w in words], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    rows, owners = [], []
    with np.errstate(over="ignore"):
        for n in SIZES:
            count = len(code) - n + 1
            if count <= 0:
                continue
            h = np.full(count, n, dtype=np.uint64)
            for k in range(n):
                h = h * np.uint64(1_000_003) + code[k : k + count]
            inside = owner[:count] == owner[n - 1 :]
            rows.append(mixed(h[inside]))
            owners.append(owner[:count][inside])
        place = np.arange(len(code)) - starts[owner]
        powers = np.cumprod(np.full(int(sizes.max()), 1_000_003, dtype=np.uint64))
        whole = np.add.reduceat(code * powers[place], starts)
        rows.append(mixed(whole * np.uint64(31) + np.uint64(7)))
        owners.append(np.arange(len(words)))
    return np.concatenate(rows).astype(np.int32), np.concatenate(owners).astype(np.int32)


def window_starts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window of each text, and the text of each window."""
    per_text = -(-counts // WINDOW)
    text = np.repeat(np.arange(len(counts)), per_text)
    first_window = np.cumsum(per_text) - per_text
    first_word = np.cumsum(counts) - counts
    return first_word[text] + WINDOW * (np.arange(len(text)) - first_window[text]), text


def smooth_max(z: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the smooth maximum of its windows' scores (0 without windows), and the windows' shares in it."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, text, z)
    e = np.exp((z - top[text]) / SMOOTH)
    total = np.bincount(text, e, n)
    has = total > 0
    return np.where(has, np.where(has, top, 0) + SMOOTH * np.log(np.where(has, total, 1)), 0.0), e / total[text]


def split(text: str | None) -> list[str]:
    return (text or "").lower().split()


def fit(texts: list[str | None], toxic: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """(a number per table row, bias): table and softmax layer, trained jointly, multiplied out."""
    y = toxic.astype(np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    bias = float(np.log(share / (1 - share)))
    known: dict[str, int] = {}
    met, counts = array("i"), np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):  # one text's words at a time
        own = split(t)
        counts[i] = len(own)
        met.extend(known.setdefault(w, len(known)) for w in own)
    if not met or y.min(initial=1) == y.max(initial=0):
        return np.zeros(BUCKETS, dtype=np.float32), bias
    slots = np.frombuffer(met, dtype=np.int32)
    starts, text = window_starts(counts)
    lengths = np.diff(np.append(starts, len(slots)))
    window = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
    row, owner = bags(list(known))
    weight = (1 / np.bincount(owner, minlength=len(known))).astype(np.float32)[owner]

    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer = rng.uniform(-1, 1, (DIM, 2))
    offset = np.array([0.0, bias])
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, layer, offset)]
    for k in range(1, ROUNDS + 1):
        direction = layer[:, 1] - layer[:, 0]  # two classes: the softmax depends on the difference
        per_row = table @ direction
        per_word = np.bincount(owner, per_row[row] * weight, len(known))
        z = np.bincount(window, per_word[slots], len(starts)) / lengths
        pooled, part = smooth_max(z, text, len(y))
        p = 1 / (1 + np.exp(-(pooled + offset[1] - offset[0])))
        slope = (p - y) / len(y)
        from_windows = slope[text] * part / lengths
        from_words = np.bincount(slots, from_windows[window], len(known))
        from_rows = np.bincount(row, from_words[owner] * weight, BUCKETS)
        pull = from_rows @ table
        grads = (from_rows[:, None] * direction + DECAY * table, np.stack([-pull, pull], axis=1), np.array([-slope.sum(), slope.sum()]))
        for value, grad, (m, v) in zip((table, layer, offset), grads, state, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(offset[1] - offset[0])


class Scorer:
    """Scores texts, remembering the numbers of words it has met, up to a fixed count."""

    def __init__(self, per_row: np.ndarray, bias: float):
        self.per_row, self.bias, self.known = per_row, bias, {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.per_row.any():  # nothing was learnt
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        words: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            own = split(t)
            counts[i] = len(own)
            words += own
        new = list(set(words) - self.known.keys())
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            row, owner = bags(part)
            value = np.bincount(owner, self.per_row[row], len(part)) / np.bincount(owner, minlength=len(part))
            self.known.update(zip(part, value.tolist(), strict=True))
        if not words:
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        value = np.fromiter(map(self.known.__getitem__, words), dtype=np.float64, count=len(words))
        starts, text = window_starts(counts)
        z = np.add.reduceat(value, starts) / np.diff(np.append(starts, len(words)))
        return 1 / (1 + np.exp(-(smooth_max(z, text, len(texts))[0] + self.bias)))


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out fifth, each pair of doc_id and text once, in the order of
    a hash of both: never more than max_rows rows or max_chars characters (nor a text of more than these)."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("doc_id", "text", F.lit(11)), "n": F.length("text").cast("long")}).where(F.col("n") <= max_chars)
    sizes = rows.select("doc_id", "h", "n").distinct().join(known, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("chars")).first()
    drawn = min((max_rows << 64) // max(sizes["n"], 1), (max_chars << 64) // max(sizes["chars"] or 0, 1))  # of 2^64 hashes
    if drawn < 1 << 64:
        rows = rows.where(F.col("h") < drawn - (1 << 63))
    order = ["h", "doc_id", "text"]
    taken = rows.join(known, "doc_id").distinct().orderBy(*order).limit(max_rows)
    so_far = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over at most max_rows rows
    return taken.withColumn("so_far", so_far).where(F.col("so_far") <= max_chars).orderBy(*order).select("text", "toxic")


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> tuple[np.ndarray, float]:
    """The model from a sample of labelled rows; see sampled()."""
    sample = sampled(docs, labels, max_rows, max_chars).toArrow()
    return fit(sample["text"].to_pylist(), np.array(sample["toxic"].to_pylist(), dtype=np.int64))


_KEPT: dict[int, Scorer] = {}


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each whole text; an input column named `out` is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = hash((model[0].tobytes(), model[1]))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = Scorer(*sent.value)
        for texts in batches:
            chunk = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.utf8_length(texts), 0))) // 4_000_000
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(texts)]
            parts = [_KEPT[key].scores(texts.slice(a, b - a).to_pylist()) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.array(np.concatenate(parts))

    named = clear(docs.withColumn("_text", F.col(text).cast("string")), out)
    return named.withColumn(out, F.arrow_udf(score, "double")("_text")).drop("_text")
