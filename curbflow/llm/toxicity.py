"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams; a window of ``WINDOW`` words
(one begins at each word) is the mean of its words' vectors, and a linear softmax turns that into two
classes.  Embeddings and softmax are trained jointly in numpy on a bounded
sample of labelled texts.  A label belongs to a text, not to a window, so the
windows of a text are pooled: softly (log-sum-exp) in training, by the largest
when scoring, which finds a few insults in a text of any length.  Misspelt
words share most n-gram vectors with the words that they stand for; training
also sees some words with a letter swapped out.  Scores are calibrated on what
models of a part of the sample give the texts of the other parts.

After training each n-gram weighs one number (its vector times the difference
of the two softmax rows), so a word costs one lookup.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns

WINDOW = 8
SIZES = (3, 4, 5)
BUCKETS = 1 << 16
DIM = 8
#: Scale of the first softmax weights, and texts at which log odds count half.
START, SHRINK = 8.0, 8.0
#: Sharpness of the soft maximum over windows in training.
SHARP = 3.0
#: Words whose n-grams are hashed at once.
STEP = 20_000
#: A worker forgets the words that it knows beyond this many.
KNOWN_LIMIT = 300_000


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of each word (taken as `<word>` in UTF-8), and the words' numbers of n-grams."""
    parts = [some_subwords(words[i : i + STEP]) for i in range(0, len(words), STEP)]
    return np.concatenate([b for b, _ in parts]), np.concatenate([n for _, n in parts])


def some_subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [b"<" + w.encode() + b">" for w in words]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(text))  # bytes from here to the word's end
    owners, buckets = [], []
    h = np.zeros(len(text), np.uint64)
    for n in range(1, max(SIZES) + 1):
        h = h[: len(text) - n + 1] * np.uint64(0x100000001B3) + text[n - 1 :]
        if n in SIZES:
            ok = left[: len(h)] >= n
            mixed = (h[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(64 - 16)).astype(np.uint16))
            owners.append(owner[: len(h)][ok])
    owners, buckets = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.bincount(owners, minlength=len(raw))


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


@dataclass
class ToxicityModel:
    """One weight for each n-gram bucket; score = sigmoid(slope * largest window + shift)."""

    weight: np.ndarray | None
    bias: float
    slope: float
    shift: float
    known: dict = field(default_factory=dict)
    centre: float = 0.0
    spread: float = 1.0

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def learn_words(self, words: list[str]) -> None:
        grams, n = subwords(words)
        sums = np.bincount(np.repeat(np.arange(len(words)), n), self.weight[grams], len(words))
        self.known.update(zip(words, (sums / np.maximum(n, 1)).tolist(), strict=True))

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """The largest window's logit of each text (its padding weighs nothing)."""
        split = [words_of(t) for t in texts]
        if new := list(set().union(*split).difference(self.known)):
            self.learn_words(new)
        out = np.full(len(texts), self.bias)
        for i, w in enumerate(split):
            if w:
                v = np.fromiter(map(self.known.__getitem__, w), np.float64, len(w))
                total, n = np.r_[0.0, np.cumsum(v)], min(WINDOW, len(v))
                out[i] += max(0.0, (total[n:] - total[:-n]).max() / WINDOW)
        if len(self.known) > KNOWN_LIMIT:
            self.known.clear()
        return out

    def standard(self, raw: np.ndarray) -> np.ndarray:
        """Raw scores by the scale of those of the texts that the model was trained on."""
        return (raw - self.centre) / self.spread

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weight is None:
            return np.full(len(texts), self.shift)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(texts) + self.shift, -40, 40)))


def misspelt(word: str, rng: np.random.Generator) -> str:
    """The word with one inner letter changed, doubled or left out."""
    if len(word) < 5:
        return word
    i, how = int(rng.integers(1, len(word) - 1)), rng.integers(3)
    return word[:i] + (chr(97 + int(rng.integers(26))), word[i] * 2, "")[how] + word[i + 1 :]


#: Parts of the sample for cross-fitted calibration, and the least slope in units of the raw scores' spread.
FOLDS, LEAST_SLOPE = 3, 0.5


def fit(texts: list[str], labels: list[int], epochs: int = 6, batch: int = 128, seed: int = 7) -> ToxicityModel:
    """A model of the whole sample, calibrated on raw scores that each text gets from a model that hasn't seen it.

    The sample is cut into FOLDS parts with the labels dealt out evenly.  A
    model without a part scores that part, standardised by its own scores of
    all other texts, so that the parts' scores have one scale; the logistic
    curve over all of them is carried over to the model of all texts.  The
    slope has a positive lower bound, so scores rise with raw scores whatever the sample.
    """
    y = np.array(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return ToxicityModel(None, 0.0, 1.0, float(y[0]) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    part = np.empty(len(y), np.int64)
    for label in (0, 1):
        rows = rng.permutation(np.flatnonzero(y == label))
        part[rows] = np.arange(len(rows)) % FOLDS
    scaled, known = np.zeros(len(y)), np.zeros(len(y), bool)
    for fold in range(FOLDS):
        seen, left = np.flatnonzero(part != fold), np.flatnonzero(part == fold)
        if not len(left) or len(np.unique(y[seen])) < 2:
            continue
        model = fit_weights([texts[i] for i in seen], y[seen], epochs, batch, seed + fold + 1)
        scaled[left] = model.standard(model.raw([texts[i] for i in left]))
        known[left] = True
    model = fit_weights(texts, y, epochs, batch, seed)
    if not known.any() or y[known].min() == y[known].max():
        scaled, known = model.standard(model.raw(texts)), np.ones(len(y), bool)
    slope, shift = calibrated(scaled[known], y[known])
    model.slope = slope / model.spread
    model.shift = shift - slope * model.centre / model.spread
    return model


def fit_weights(texts: list[str], y: np.ndarray, epochs: int, batch: int, seed: int) -> ToxicityModel:
    """Train embeddings and softmax jointly; Adagrad, log-sum-exp over windows.  Both labels occur."""
    rng = np.random.default_rng(seed)
    used = np.arange(len(y))
    place: dict[str, int] = {}
    ids = []
    for text in texts:
        ids.append(np.array([place.setdefault(w, len(place)) for w in words_of(text)], np.int32))
    words = list(place)
    variants = [misspelt(w, rng) for w in words]
    n_words = len(words)
    grams, counts = subwords(words + variants)
    del words, variants, place
    begin = np.r_[0, np.cumsum(counts)]
    emb = rng.normal(0, 0.01, (BUCKETS, DIM))
    soft = rng.normal(0, 0.1, (DIM, 2))
    bias = np.zeros(2)
    # Start where the n-grams' log odds between the classes point, so that few steps are needed.
    emb[:, 0] += log_odds([ids[i] for i in used], y[used], grams, begin)
    soft[0] = (-START, START)
    g_emb, g_soft, g_bias = np.full(BUCKETS, 1e-4), np.full((DIM, 2), 1e-4), np.full(2, 1e-4)
    pos, neg = used[y[used] == 1], used[y[used] == 0]
    steps = max(6, -(-len(used) // batch))
    for _ in range(epochs * steps):
        rows = np.r_[rng.choice(pos, batch // 2), rng.choice(neg, batch // 2)]
        rows = rows[[len(ids[r]) > 0 for r in rows]]
        if not len(rows):
            continue
        n = np.array([len(ids[r]) for r in rows])
        flat = np.concatenate([ids[r] for r in rows])
        flat = np.where(rng.random(len(flat)) < 0.15, flat + n_words, flat)
        wins = np.maximum(n - WINDOW, 0) + 1  # one from each word on that has WINDOW words
        first = np.r_[0, np.cumsum(wins)]
        start = np.arange(first[-1]) + np.repeat(np.cumsum(n) - n - first[:-1], wins)
        end = start + np.repeat(np.minimum(n, WINDOW), wins)
        uniq, at = np.unique(flat, return_inverse=True)
        k = counts[uniq]
        own = np.repeat(np.arange(len(uniq)), k)
        g = grams[np.repeat(begin[uniq] - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())]
        gram_vec = emb[g]
        vec = np.stack([np.bincount(own, gram_vec[:, d], len(uniq)) for d in range(DIM)], 1)
        vec /= np.maximum(k, 1)[:, None]
        total = np.vstack([np.zeros(DIM), np.cumsum(vec[at], axis=0)])
        hidden = (total[end] - total[start]) / WINDOW
        logit = hidden @ soft + bias
        margin = logit[:, 1] - logit[:, 0]
        top = np.maximum.reduceat(margin, first[:-1])
        part = np.exp(SHARP * (margin - np.repeat(top, wins)))
        part /= np.repeat(np.add.reduceat(part, first[:-1]), wins)
        pooled = np.add.reduceat(part * margin, first[:-1])
        p = 1 / (1 + np.exp(-np.clip(pooled, -30, 30)))
        d_margin = np.repeat((p - y[rows]) / len(rows), wins) * part
        d_logit = np.stack([-d_margin, d_margin], 1)
        d_soft, d_bias = hidden.T @ d_logit, d_logit.sum(0)
        d_hidden = d_logit @ soft.T / WINDOW
        d_word = np.zeros((len(flat) + 1, DIM))  # no two windows begin or end at one word
        d_word[start] += d_hidden
        d_word[end] -= d_hidden
        d_word = np.cumsum(d_word, axis=0)
        d_vec = np.stack([np.bincount(at, d_word[:-1, d], len(uniq)) for d in range(DIM)], 1)
        d_vec /= np.maximum(k, 1)[:, None]
        d_emb = np.stack([np.bincount(g, d_vec[own, d], BUCKETS) for d in range(DIM)], 1) + 1e-7 * emb
        g_emb += (d_emb**2).sum(1)
        g_soft += d_soft**2
        g_bias += d_bias**2
        emb -= 0.01 * d_emb / np.sqrt(g_emb)[:, None]
        soft -= 0.1 * d_soft / np.sqrt(g_soft)
        bias -= 0.1 * d_bias / np.sqrt(g_bias)
    model = ToxicityModel(emb @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]), 1.0, 0.0)
    raw = model.raw(texts)
    # half-way between the classes, and the spread within them: a few outliers of one class don't set the scale
    means = [raw[y == label].mean() for label in (0, 1)]
    model.centre = float(sum(means) / 2)
    model.spread = float(max(abs(means[1] - means[0]) / 2, raw.std() / 2, 1e-6))
    return model


def log_odds(ids: list[np.ndarray], y: np.ndarray, grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Log odds of a toxic text, for each bucket, by the texts that hold it; few texts shrink it to 0."""
    held = np.zeros((2, BUCKETS))
    for row, label in zip(ids, y.tolist(), strict=True):
        of_row = [grams[begin[w] : begin[w + 1]] for w in np.unique(row).tolist()]
        if of_row:
            held[label, np.unique(np.concatenate(of_row))] += 1
    n = np.bincount(y, minlength=2)
    rate = (held + 1.0) / (n[:, None] + 2.0)
    return (np.log(rate[1]) - np.log(rate[0])) * held.sum(0) / (held.sum(0) + SHRINK)


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope, LEAST_SLOPE at least, and shift of the logistic curve of y over standard scores x, by Newton steps with a weak prior."""
    w = np.array([1.0, 0.0])

    def step(free: np.ndarray) -> None:
        p = 1 / (1 + np.exp(-np.clip(x * w[0] + w[1], -30, 30)))
        columns = np.stack([x, np.ones(len(x))], 1)[:, free]
        prior = np.array([1e-2, 1e-3])[free]
        hess = (columns * (p * (1 - p))[:, None]).T @ columns + np.diag(prior)
        move = np.linalg.solve(hess, columns.T @ (p - y) + prior * w[free])
        w[free] -= np.clip(move, -2, 2)

    for _ in range(60):
        step(np.array([0, 1]))
    if w[0] < LEAST_SLOPE:
        w[0] = LEAST_SLOPE
        for _ in range(60):
            step(np.array([1]))
    return float(w[0]), float(w[1])


def train_toxicity(
    labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", max_rows: int = 3000, max_chars: int = 40_000
) -> ToxicityModel:
    """A model from at most about ``max_rows`` labelled texts, half of them toxic if there are as many.

    The sample is bounded: rows are taken by a hash of their text, at rates
    that the two classes' counts set; texts beyond ``max_chars`` code points
    aren't trained on (all texts are scored).  Rows with a null text or label
    are left out; a text with both labels counts for both.
    """
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("int").alias("label"))
    rows = rows.where(F.col("text").isNotNull() & F.col("label").isin(0, 1) & (F.length("text") <= max_chars))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    take = F.lit(False)
    for label in n:
        room = max(max_rows // 2, max_rows - sum(c for k, c in n.items() if k != label))
        dart = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
        take |= (F.col("label") == label) & (dart < int(min(1.0, room / n[label]) * (1 << 20)) + 1)
    # a repeated row counts once, so the rates bound the sample whatever is repeated
    sample = sorted((r["text"], r["label"]) for r in rows.where(take).distinct().collect()) if n else []
    return fit([t for t, _ in sample], [c for _, c in sample])


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score"
) -> DataFrame:
    """docs with a score from 0 to 1 of each whole text, higher where toxic is likelier.

    Null and empty texts get the score of a text that has nothing toxic.  An old
    column of the score's name is replaced, others are kept, and repeated rows
    stay repeated.  One pass, no shuffle; the model has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list) -> list[pa.Array]:
        return [pa.array(shared.value.score(texts), pa.float64())]

    def finish() -> None:
        shared.value.known.clear()

    return with_columns(docs, text_col, [T.StructField(score_col, T.DoubleType())], compute, finish)


def labelled_texts(docs: DataFrame, labels: DataFrame, max_rows: int = 3000) -> DataFrame:
    """text and toxic of a bounded number of labelled documents.

    Labels are thinned by a hash of doc_id before they meet the texts, toxic
    ones less, so that the join can broadcast them: their number is bounded.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).distinct()
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    take = F.lit(False)
    for label, count in n.items():
        dart = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
        take |= (F.col("toxic") == label) & (dart < int(min(1.0, max_rows / count) * (1 << 20)) + 1)
    return docs.select("doc_id", "text").join(F.broadcast(known.where(take)), "doc_id").select("text", "toxic")
