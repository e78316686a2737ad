"""A hidden Markov language model over words.

Words (A-Z lower-cased) and one end for each text are emitted by latent states:

    p(word | state) = (1 - u(state)) * p(symbol | state) * c'(word) / c'(symbol)
    p(unknown | state) = u(state)

A symbol stands for one frequent word, or for all rarer words with the same
beginning and ending; c' are training counts less a discount.  So the state
tables have a bounded size, while every word's count is in the model; the
emissions of the known words and of one unknown word add up to one.

Training: texts are coded shard by shard (a shard is what a task reads until it
has SHARD_TOKENS tokens).  Word counts of all shards meet by word and go back to
the shards.  Then each Baum-Welch round runs forward-backward over all training
tokens where they lie, and only expected counts by symbol and state are shuffled
and summed.  Scoring runs the scaled forward recursion over each whole text.

Skew: a word has one row a shard at most, so the commonest word's share of the
rows that meet by word is one over a shard's number of distinct words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices
from .shared_tables import forget, written

#: Tokens of a shard at most, but for one longer text.
SHARD_TOKENS = 1_500_000
#: Words with a symbol of their own, and symbols that rarer words share.
HEAD, SHARED = 8192, 8191
UNKNOWN = HEAD + SHARED  # the symbol of a word that training has not seen
SINGLE = 1 << 15  # marks a token whose word training saw once
#: Training counts texts in pieces of so many tokens, each read with MARGIN tokens more on both sides, from which the
#: states at its edges are known; only a text's beginning counts as a start.  Scoring never cuts.
CHUNK, MARGIN = 512, 32
#: Texts whose sequences run side by side in training.
GROUP = 1024
DISCOUNT = 0.5
END = b""

CODED = (
    "shard long, ids array<long>, held array<boolean>, lens array<int>, codes binary, words array<binary>, counts array<long>"
)


def squeezed(codes: np.ndarray) -> bytes:
    """32-bit codes, compressed byte by byte of the number, so that less is shuffled."""
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(raw: pa.Buffer, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def coded_shards(texts: DataFrame) -> DataFrame:
    """Shards of texts (doc_id, text, held): tokens as places in the shard's word list, training counts by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        place: dict[bytes, int] = {END: 0}
        ids, held, codes = [], [], []

        def settle() -> pa.RecordBatch:
            lens = np.array([len(c) for c in codes], np.int32)
            flat = np.concatenate(codes)
            trained = flat[np.repeat(~np.array(held), lens)]
            counts = np.bincount(trained, minlength=len(place))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([first + made], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([held], pa.list_(pa.bool_())),
                    pa.array([lens], pa.list_(pa.int32())),
                    pa.array([squeezed(flat)], pa.binary()),
                    pa.array([list(place)], pa.list_(pa.binary())),
                    pa.array([counts], pa.list_(pa.int64())),
                ],
                names=["shard", "ids", "held", "lens", "codes", "words", "counts"],
            )

        size = 0
        for batch in batches:
            for part in slices(batch, 1):
                for doc_id, text, out in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    words = text.encode().lower().split() if text else []
                    if codes and size + len(words) >= SHARD_TOKENS:
                        yield settle()
                        made, size = made + 1, 0
                        place, ids, held, codes = {END: 0}, [], [], []
                    code = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
                    ids.append(doc_id)
                    held.append(out)
                    codes.append(np.r_[code, 0])
                    size += len(words) + 1
        if codes:
            yield settle()

    return texts.mapInArrow(run, CODED)


def shared_symbol(word: bytes) -> int:
    """The symbol of a word that has none of its own, by its beginning and ending."""
    return HEAD + zlib.crc32(word[:2] + b" " + word[-3:]) % SHARED


@dataclass
class Vocabulary:
    """What the driver holds of the training counts; its size is bounded."""

    head: dict[bytes, int]
    tokens: int
    types: int
    symbol_count: np.ndarray  # tokens by symbol
    symbol_mass: np.ndarray  # discounted tokens by symbol

    def symbol(self, word: bytes) -> int:
        own = self.head.get(word)
        return shared_symbol(word) if own is None else own


def count_words(shards: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """(shard, at, count, word) - the training count of each word of each shard; word only once - and the vocabulary."""
    pairs = shards.select("shard", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "pair"))
    pairs = pairs.select("shard", "at", F.col("pair.words").alias("word"), F.col("pair.counts").alias("own"))
    by_word = Window.partitionBy("word")
    counted = pairs.withColumns(
        {"count": F.sum("own").over(by_word), "nth": F.row_number().over(by_word.orderBy("shard"))}
    ).select("shard", "at", "count", F.when(F.col("nth") == 1, F.col("word")).alias("word"))
    counted = written(counted)
    known = counted.where("word is not null and count > 0").select("word", "count")
    # the head is bounded: words from a size class on, of which there are at most HEAD
    size = F.floor(F.log2("count") * 16)
    room, least = HEAD, 1 << 20
    for r in sorted(known.groupBy(size.alias("size")).count().collect(), reverse=True):
        room -= r["count"]
        least = r["size"] if room >= 0 else least
    top = known.where(size >= least).select("word").collect()
    head = {w: i for i, w in enumerate(sorted(bytes(r["word"]) for r in top))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, types = np.zeros(UNKNOWN, np.int64), np.zeros(UNKNOWN, np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            at = np.fromiter(
                (shared_symbol(w) if (own := head.get(w)) is None else own for w in words), np.int64, len(words)
            )
            np.add.at(total, at, batch.column(1).to_numpy())
            np.add.at(types, at, 1)
        used = np.flatnonzero(types)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(total[used]), pa.array(types[used])], names=["symbol", "total", "types"]
        )

    sums = known.mapInArrow(run, "symbol long, total long, types long").groupBy("symbol")
    rows = sums.agg(F.sum("total").alias("total"), F.sum("types").alias("types")).collect()
    count, types = np.zeros(UNKNOWN), np.zeros(UNKNOWN)
    for r in rows:
        count[r["symbol"]], types[r["symbol"]] = r["total"], r["types"]
    return counted, Vocabulary(head, int(count.sum()), int(types.sum()), count, count - DISCOUNT * types)


CODED_DOCS = (
    "shard long, ids array<long>, held array<boolean>, lens array<int>, symbols binary, "
    "known array<long>, base array<double>, rest array<double>"
)


def with_symbols(shards: DataFrame, counted: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Shards as symbols, with what needs word counts summed up for each text."""
    back = counted.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("at", "count"))).alias("found"))
    back = back.select("shard", F.col("found.count").alias("found"))
    rows = shards.select("shard", "ids", "held", "lens", "codes", "words").join(back, "shard")
    shared = shards.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        whole = np.log10(vocab.tokens + vocab.types + 1)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                words = row.column("words")[0].as_py()
                c = row.column("found")[0].values.to_numpy(zero_copy_only=False)
                symbol = np.fromiter(map(vocab.symbol, words), np.int64, len(words))
                with np.errstate(divide="ignore"):
                    rest = np.log10(np.maximum(c - DISCOUNT, 0) / np.maximum(vocab.symbol_mass[symbol], 1e-300))
                rest[c == 0] = 0
                symbol[c == 0] = UNKNOWN
                symbol[c == 1] |= SINGLE
                lens = row.column("lens")[0].values.to_numpy()
                codes = unsqueezed(row.column("codes")[0].as_buffer(), int(lens.sum()))
                begin = np.cumsum(lens) - lens
                yield pa.RecordBatch.from_arrays(
                    [
                        *(row.column(n) for n in ("shard", "ids", "held", "lens")),
                        pa.array([symbol[codes].astype("<u2").tobytes()], pa.binary()),
                        pa.array([np.add.reduceat((c > 0).astype(np.int64)[codes], begin)], pa.list_(pa.int64())),
                        pa.array([np.add.reduceat((np.log10(c + 1) - whole)[codes], begin)], pa.list_(pa.float64())),
                        pa.array([np.add.reduceat(rest[codes], begin)], pa.list_(pa.float64())),
                    ],
                    names=["shard", "ids", "held", "lens", "symbols", "known", "base", "rest"],
                )

    return rows.mapInArrow(run, CODED_DOCS)


@dataclass
class HiddenMarkov:
    """Start, transition and symbol probabilities, and that of an unknown word, by state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol, state; the last row is the unknown word's

    @property
    def states(self) -> int:
        return len(self.start)


def padded(symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of texts with their margins, longest first, one column each; their lengths, and where what counts begins and ends."""
    pieces = np.maximum(-(-lens // CHUNK), 1)
    text = np.repeat(np.arange(len(lens)), pieces)
    low = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * CHUNK
    high = np.minimum(low + CHUNK, lens[text])
    begin, end = np.maximum(low - MARGIN, 0), np.minimum(high + MARGIN, lens[text])
    order = np.argsort(begin - end, kind="stable")
    text, low, high, begin, end = text[order], low[order], high[order], begin[order], end[order]
    size = end - begin
    column = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(column)) - np.repeat(np.cumsum(size) - size, size)
    table = np.full((int(size.max(initial=0)), len(size)), UNKNOWN, np.int64)
    table[at, column] = symbols[(np.cumsum(lens) - lens)[text][column] + begin[column] + at]
    return table, size, low - begin, high - begin


def expected_counts(model: HiddenMarkov, symbols: np.ndarray, lens: np.ndarray, into: np.ndarray) -> None:
    """Adds to ``into`` the expected counts: symbol rows, then the moves, the starts, and the single words."""
    k = model.states
    emit = model.emit
    inside = np.linalg.matrix_power(model.move, 64)[0]  # where a piece begins inside a text
    ends = np.r_[0, np.cumsum(lens)]
    for low in range(0, len(lens), GROUP):
        group = lens[low : low + GROUP]
        marked, size, first, last = padded(symbols[ends[low] : ends[min(low + GROUP, len(lens))]], group)
        table, single = marked & (SINGLE - 1), marked >= SINGLE
        steps = len(table)
        active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
        counts = (np.arange(steps)[:, None] >= first) & (np.arange(steps)[:, None] < last)
        forward = np.zeros((steps, len(size), k))
        scale = np.ones((steps, len(size)))
        start = np.where((first == 0)[:, None], model.start, inside)
        for t in range(steps):
            n = active[t]
            now = (start if t == 0 else forward[t - 1, :n] @ model.move) * emit[table[t, :n]]
            total = np.maximum(now.sum(1), 1e-300)
            forward[t, :n] = now / total[:, None]
            scale[t, :n] = total
        later = np.ones((len(size), k))
        for t in range(steps - 1, -1, -1):
            n = active[t]
            state = forward[t, :n] * later[:n]
            state /= np.maximum(state.sum(1), 1e-300)[:, None]
            into[UNKNOWN + 2 + k] += state[single[t, :n] & counts[t, :n]].sum(0)
            if t == 0:
                into[UNKNOWN + 1 + k] += state[first == 0].sum(0)
                forward[t, :n] = state
                break
            seen = emit[table[t, :n]] * later[:n] / scale[t, :n, None]
            into[UNKNOWN + 1 : UNKNOWN + 1 + k] += model.move * (forward[t - 1, :n].T @ (seen * counts[t, :n, None]))
            later[:n] = seen @ model.move.T
            forward[t, :n] = state  # from here on the states' shares, summed up by symbol below
        flat, shares = table[counts], forward[counts]
        for s in range(k):
            into[: UNKNOWN + 1, s] += np.bincount(flat, shares[:, s], UNKNOWN + 1)


def baum_welch_round(shards: DataFrame, model: HiddenMarkov) -> np.ndarray:
    """The expected counts of all training texts, summed over the partitions."""
    k = model.states
    shared = shards.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = np.zeros((UNKNOWN + 3 + k, k))
        for batch in batches:
            for i in range(batch.num_rows):
                held = np.array(batch.column("held")[i].as_py(), bool)
                lens = batch.column("lens")[i].values.to_numpy()
                symbols = np.frombuffer(batch.column("symbols")[i].as_buffer(), "<u2").astype(np.int64)
                expected_counts(shared.value, symbols[np.repeat(~held, lens)], lens[~held], into)
        used = np.flatnonzero(into.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *[pa.array(into[used, s]) for s in range(k)]], names=["row", *[f"s{s}" for s in range(k)]]
        )

    schema = "row long, " + ", ".join(f"s{s} double" for s in range(k))
    sums = shards.select("held", "lens", "symbols").mapInArrow(run, schema).groupBy("row")
    out = np.zeros((UNKNOWN + 3 + k, k))
    for r in sums.agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(k)]).collect():
        out[r["row"]] = [r[f"s{s}"] for s in range(k)]
    return out


def reestimated(counts: np.ndarray, vocabulary: Vocabulary, k: int) -> HiddenMarkov:
    """The model that the expected counts give, smoothed towards the words' overall shares."""
    share = vocabulary.symbol_count / max(1, vocabulary.tokens)
    emit = counts[:UNKNOWN] + 20 * share[:, None]
    total = counts[:UNKNOWN].sum(0)
    unknown = (counts[UNKNOWN + 2 + k] + 0.5) / (total + 1)
    emit = emit / np.maximum(emit.sum(0), 1e-300) * (1 - unknown)
    move = counts[UNKNOWN + 1 : UNKNOWN + 1 + k] + 0.1
    start = counts[UNKNOWN + 1 + k] + 0.1
    return HiddenMarkov(start / start.sum(), move / move.sum(1, keepdims=True), np.vstack([emit, unknown]))


def first_model(shards: DataFrame, vocabulary: Vocabulary, k: int, sample_docs: int) -> HiddenMarkov:
    """A start for training: states from clusters of some texts' symbols, which tend to stay.

    The sample only sets where Baum-Welch begins; its rounds cover all texts.
    It holds up to ``sample_docs`` training texts, a few from each of some shards.
    """
    few = max(1, sample_docs // 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                held = batch.column("held")[i].as_py()
                lens = batch.column("lens")[i].values.to_numpy()
                ends = np.cumsum(lens)
                symbols = np.frombuffer(batch.column("symbols")[i].as_buffer(), "<u2")
                rows = [j for j, h in enumerate(held) if not h and 20 <= lens[j] <= 5000]
                rows = rows[:: max(1, len(rows) // few)][:few]
                out += [(symbols[ends[j] - lens[j] : ends[j]] & (SINGLE - 1)).astype("<u2").tobytes() for j in rows]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["symbols"])

    # the ids of some shards first, so that no shard's content is sorted
    chosen = [r["shard"] for r in shards.select("shard").orderBy(F.xxhash64("shard")).limit(20).collect()]
    some = shards.where(F.col("shard").isin(chosen)).select("held", "lens", "symbols").mapInArrow(run, "symbols binary")
    texts = [np.frombuffer(r["symbols"], "<u2") for r in some.limit(sample_docs).collect()]
    counts = np.zeros((UNKNOWN + 3 + k, k))
    if texts:
        rows = np.stack([np.bincount(np.minimum(t, UNKNOWN - 1), minlength=UNKNOWN) for t in texts]).astype(np.float32)
        rows = np.sqrt(rows / rows.sum(1, keepdims=True))
        centres = [rows[0]]
        for _ in range(1, k):
            centres.append(rows[int(np.argmin(np.max(rows @ np.stack(centres).T, axis=1)))])
        centre = np.stack(centres)
        for _ in range(8):
            own = (rows @ centre.T).argmax(1)
            for s in range(k):
                if (own == s).any():
                    centre[s] = rows[own == s].mean(0)
                    centre[s] /= max(np.linalg.norm(centre[s]), 1e-9)
        for text, s in zip(texts, own.tolist(), strict=True):
            counts[:UNKNOWN, s] += np.bincount(np.minimum(text, UNKNOWN - 1), minlength=UNKNOWN)
            counts[UNKNOWN + 1 + k, s] += 1
    total = counts[:UNKNOWN].sum(0)
    counts[UNKNOWN + 1 : UNKNOWN + 1 + k] = np.diag(0.97 * total) + 0.03 * total.sum() / k / k
    counts[UNKNOWN + 2 + k] = 0.02 * total
    return reestimated(counts, vocabulary, k)


def log_likelihoods(model: HiddenMarkov, symbols: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """log10 of each whole sequence's probability by the scaled forward recursion."""
    out = np.zeros(len(lens))
    begin = np.cumsum(lens) - lens
    order = np.argsort(-lens, kind="stable")
    size, begin = lens[order], begin[order]
    state = np.tile(model.start, (len(lens), 1))
    total = np.zeros(len(lens))
    active = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")
    for t, n in enumerate(active.tolist()):
        now = state[:n] if t == 0 else state[:n] @ model.move
        now = now * model.emit[symbols[begin[:n] + t]]
        scale = np.maximum(now.sum(1), 1e-300)
        state = now / scale[:, None]
        total[:n] += np.log10(scale)
    out[order] = total
    return out


SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score_texts(shards: DataFrame, model: HiddenMarkov, vocabulary: Vocabulary) -> DataFrame:
    shared = shards.sparkSession.sparkContext.broadcast(model)
    tokens = vocabulary.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lens = batch.column("lens")[i].values.to_numpy().astype(np.int64)
                symbols = np.frombuffer(batch.column("symbols")[i].as_buffer(), "<u2").astype(np.int64) & (SINGLE - 1)
                rest = batch.column("rest")[i].values.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids")[i].values,
                        batch.column("held")[i].values,
                        pa.array(lens),
                        batch.column("known")[i].values,
                        pa.array(np.full(len(lens), tokens)),
                        batch.column("base")[i].values,
                        pa.array(log_likelihoods(shared.value, symbols, lens) + rest),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return shards.mapInArrow(run, SCORED)


def hidden_markov_scores(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = 6,
    rounds: int = 3,
    sample_docs: int = 1500,
) -> DataFrame:
    """One row for each text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all rows where ``held_out`` is false, and scores all
    whole texts; a null text is an empty one, of one token (its end).  score is
    the model's log10 probability of the text, base_score that of add-one
    smoothed word counts.  Without training tokens every token is unknown and
    both scores are 0.  Repeated rows count and are scored each on their own; a
    null id stays null; other columns are not looked at; an empty table gives an
    empty one.  A text of any length is scored whole, in one task.
    """
    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held"),
    )
    coded, model, vocabulary = trained(texts, states, rounds, sample_docs)
    return score_texts(coded, model, vocabulary)


def trained(texts: DataFrame, states: int, rounds: int, sample_docs: int) -> tuple[DataFrame, HiddenMarkov, Vocabulary]:
    """The coded shards of texts (doc_id, text, held), the model learned from those not held out, and the vocabulary."""
    shards = written(coded_shards(texts))
    counted, vocabulary = count_words(shards)
    coded = written(with_symbols(shards, counted, vocabulary))
    forget(shards, counted)
    if not vocabulary.tokens:
        return coded, HiddenMarkov(np.ones(1), np.ones((1, 1)), np.vstack([np.zeros((UNKNOWN, 1)), np.ones((1, 1))])), vocabulary
    model = first_model(coded, vocabulary, states, sample_docs)
    for _ in range(rounds):
        model = reestimated(baum_welch_round(coded, model), vocabulary, states)
    return coded, model, vocabulary
