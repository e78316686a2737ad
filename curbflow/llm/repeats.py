"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in
a document with a smaller id, or earlier in the same one.

1. Every window of LENGTH bytes has an anchor: the 32-byte gram with the
   smallest hash in it, the leftmost if some are equal.  Equal windows have
   equal anchors at equal offsets, and neighbouring windows mostly share one,
   so a text of n bytes has some n / 35 anchors.  The stretch of an anchor is
   the text that its windows cover.
2. Anchors meet by hash, with a digest of their stretch.  A stretch that is
   equal to an earlier one as a whole (the gram's and the stretch's hashes, 128
   bits, agree) is a repeat throughout and goes no further; of each kind of
   stretch only the first goes on, and only if its hash has other kinds.
3. Hashes with at most NARROW kinds: the first stretches make up blocks of
   text, a hash whole in one block.  Each block gets a suffix array by
   two-stage sorting: only suffixes smaller than their successors are sorted
   directly, the rest is induced by scanning buckets in order.  Neighbours in
   it with a common prefix of LENGTH bytes are equal windows; all but the
   earliest are repeats.
4. Hashes with more kinds (a common line among other texts), and the most
   frequent hashes, which meet in salted parts: their windows meet one by one
   under a 128-bit digest, summed up before they are shuffled, so that no group
   has to fit into a task.
5. The repeats go back to their documents.

The texts are shuffled once, by id; all joins read that exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1  # grams in a window
#: Window starts that are looked at together.
CHUNK = 1 << 19
#: Bytes from which a block of stretches is full; a hash is never cut.
BLOCK = 1 << 19
#: Kinds of stretches of a hash that a suffix array takes in.
NARROW = 4096
#: One document in SAMPLE is asked for the frequent hashes (seen HOT_FROM times), which only decides how rows are dealt:
#: such a hash meets in parts, one for each HOT_FROM times.  Of more than HOT such hashes the rest, each of which has
#: less than one in HOT of all rows, meet whole.
SAMPLE, HOT, HOT_FROM = 64, 1 << 20, 64
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: A place is a run of window starts of a text: which text of the id, the first start, and how many more follow.
MORE_BITS, FIRST_BITS, TEXT_BITS = 7, 31, 21
MORE, FIRST, TEXT = (1 << MORE_BITS) - 1, (1 << FIRST_BITS) - 1, (1 << TEXT_BITS) - 1
SALTED = 1 << (MORE_BITS + FIRST_BITS + TEXT_BITS)  # set in the places of the most frequent hashes
#: What becomes of a met stretch: a repeat, one for a suffix array, or one whose windows meet one by one.
AGAIN, NARROW_KIND, WIDE_KIND = 0, 1, 2


def gram_hashes(data: np.ndarray, doublings: int) -> np.ndarray:
    """A polynomial hash of the 2**doublings bytes from each position on."""
    h, factor = data.astype(np.uint64) + np.uint64(1), int(FACTOR)
    for k in range(doublings):
        n = 1 << k
        h = h[:-n] * np.uint64(factor) + h[n:]
        factor = factor * factor % (1 << 64)
    return h


def scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class RangeDigests:
    """64-bit digests of ranges of bytes: sums of random values of the bytes, each times a power for its position."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.factor = int(rng.integers(1 << 61, 1 << 62)) * 4 + 1
        self.power = self.inverse = np.ones(1, np.uint64)

    def of(self, data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """The digests of data[a:b]; equal ranges have equal digests wherever they lie."""
        if len(self.power) <= len(data):
            n = max(2 * len(data), 1 << 16)
            one = np.ones(1, np.uint64)
            self.power = np.cumprod(np.r_[one, np.full(n, self.factor, np.uint64)])
            self.inverse = np.cumprod(np.r_[one, np.full(n, pow(self.factor, -1, 1 << 64), np.uint64)])
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(self.value[data] * self.power[: len(data)])]
        return lambda a, b: scrambled((sums[b] - sums[a]) * self.inverse[a])


DIGEST, OTHER_DIGEST = RangeDigests(17), RangeDigests(23)


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, digest of the stretch, first window start and number of further ones of each anchor, over the whole text."""
    out = []
    for low in range(0, len(text) - LENGTH + 1, CHUNK):
        data = np.frombuffer(text, np.uint8, min(CHUNK + LENGTH - 1, len(text) - low), low)
        h = scrambled(gram_hashes(data, 5))
        best, at = h, np.arange(len(h))
        for n in (1, 2, 4, 8, 16, 32, SPAN - 64):
            right = best[n:] < best[: len(best) - n]
            at = np.where(right, at[n:], at[: len(at) - n])
            best = np.where(right, best[n:], best[: len(best) - n])
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        digest = DIGEST.of(data)(first, last + LENGTH)
        out.append((h[at[first]].view(np.int64), digest.view(np.int64), low + first, last - first))
    if not out:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_order(text: np.ndarray, depth: int = LENGTH + 4) -> np.ndarray:
    """All suffixes of text in the order of their first bytes, at least ``depth`` of them.

    Suffixes smaller than their successors (type B) are sorted directly; the
    others (type A) are induced: in a scan of the buckets of first bytes in
    order, the suffix one byte longer than the one scanned is next in its own
    bucket if it is of type A.  In a bucket type A precedes type B.
    """
    n = len(text)
    rises = np.r_[text[:-1] < text[1:], False]
    differs = np.flatnonzero(np.r_[text[:-1] != text[1:], True])
    type_b = rises[differs[np.searchsorted(differs, np.arange(n))]]
    direct = np.flatnonzero(type_b)
    padded = np.r_[text, np.zeros(depth, np.uint8)]
    views = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(views).view(f"S{depth}").ravel(), kind="stable")]
    heads = text[direct]
    order = np.argsort(heads, kind="stable")
    sorted_b = np.split(direct[order], np.searchsorted(heads[order], np.arange(1, 256)))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        wave = np.concatenate(waiting[byte]) if waiting[byte] else np.empty(0, np.int64)
        scanned = [wave]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[text[before] == byte]
            scanned.append(wave)
        bucket = np.concatenate([*scanned, sorted_b[byte]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > byte]
        order = np.argsort(text[before], kind="stable")
        before = before[order]
        heads = text[before]
        edges = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1], True]) if len(heads) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            waiting[heads[a]].append(before[a:b])
    return np.concatenate(out)


def repeat_marks(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places, of those where windows start, whose window equals one that starts earlier."""
    order = suffix_order(text)
    order = order[starts[order]]
    padded = np.r_[text, np.zeros(8, np.uint8)]
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(text) + 1, 8), (1, 1))
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    a, b = order[:-1], order[1:]
    same = np.arange(len(a))
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:  # adjacent common prefixes, as far as LENGTH
        same = same[words[a[same] + k] == words[b[same] + k]]
    new = np.ones(len(order), bool)
    new[same + 1] = False
    first = np.full(len(text), -1, np.int64)
    if len(order):
        begin = np.flatnonzero(new)
        first[order] = np.repeat(np.minimum.reduceat(order, begin), np.diff(np.r_[begin, len(order)]))
    return starts & (first != np.arange(len(text)))


def place_of(nth: np.ndarray, first: np.ndarray, more: np.ndarray) -> np.ndarray:
    return (nth << (FIRST_BITS + MORE_BITS)) | (first << MORE_BITS) | more


def run_of(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which text of the id, the first window start, and how many more."""
    return place >> (FIRST_BITS + MORE_BITS) & TEXT, place >> MORE_BITS & FIRST, place & MORE


ANCHORS = "hash long, digest long, doc_id long, place long"


def anchor_rows(texts: DataFrame, hot: np.ndarray, parts: np.ndarray) -> DataFrame:
    """One row for each anchor of texts (doc_id, nth, text); the hashes in ``hot`` are marked and salted into so many parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                found = [anchors(t.encode()) for t in part.column(2).to_pylist()]
                n = np.array([len(f[0]) for f in found], np.int64)
                ids = np.repeat(part.column(0).to_numpy(), n)
                nth = np.repeat(part.column(1).to_numpy().astype(np.int64), n)
                h, digest, first, more = (np.concatenate(x) for x in zip(*found, strict=True))
                if nth.max(initial=0) > TEXT:
                    raise ValueError(f"doc_id {ids[nth.argmax()]} has too many different texts")
                place = place_of(nth, first, more)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    near = hot[at] == h
                    salt = scrambled(ids[near].view(np.uint64) * FACTOR) % parts[at[near]] + np.uint64(1)
                    h[near] = scrambled(h[near].view(np.uint64) + salt * FACTOR).view(np.int64)
                    place[near] |= SALTED
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(digest), pa.array(ids), pa.array(place)], names=["hash", "digest", "doc_id", "place"]
                )

    return texts.where(F.octet_length("text") >= LENGTH).select("doc_id", "nth", "text").mapInArrow(run, ANCHORS)


def hot_hashes(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent hashes of some documents, sorted, 16 bytes each and at most HOT; and the number of parts of each."""
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).withColumn("nth", F.lit(0))
    none = np.empty(0, np.int64)
    counted = anchor_rows(some, none, none).groupBy("hash").count().where(F.col("count") >= HOT_FROM)
    rows = counted.orderBy(F.desc("count"), "hash").limit(HOT).toArrow().sort_by("hash")
    return rows["hash"].to_numpy(), (1 + rows["count"].to_numpy() // HOT_FROM).astype(np.uint64)


def met_anchors(rows: DataFrame) -> DataFrame:
    """(doc_id, met): for each document the (hash, place, kind) of its stretches that repeat or may hold repeats."""
    group = Window.partitionBy("hash")
    ordered = group.orderBy("digest", "doc_id", "place")
    salted = F.col("place").bitwiseAND(SALTED) != 0
    rows = rows.withColumns({"before": F.lag("digest").over(ordered), "n": F.count(F.lit(1)).over(group)})
    rows = rows.where(salted | (F.col("n") > 1)).withColumn("new", ~F.col("digest").eqNullSafe(F.col("before")))
    rows = rows.withColumn("kinds", F.sum(F.col("new").cast("long")).over(group))
    kind = (
        F.when(~F.col("new"), AGAIN)
        .when(salted | (F.col("kinds") > NARROW), WIDE_KIND)
        .when(F.col("kinds") > 1, NARROW_KIND)
    )
    met = rows.withColumn("kind", kind).where("kind is not null")
    needed = F.when(F.col("kind") == NARROW_KIND, F.col("hash")).otherwise(F.lit(0).cast("long"))
    return met.groupBy("doc_id").agg(F.collect_list(F.struct(needed.alias("hash"), "place", "kind")).alias("met"))


def entries(column: pa.Array, fields: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """For each row of an array of structs, the values of the fields."""
    offsets = column.offsets.to_numpy()
    values = [column.values.field(f).to_numpy() for f in fields]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield [v[a:b] for v in values]


def of_kind(kind: int) -> Column:
    return F.exists("met", lambda x: x["kind"] == kind)


def stretch_rows(held: DataFrame) -> DataFrame:
    """(hash, doc_id, place, stretch) of the stretches of held (doc_id, nth, text, met) that go into suffix arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                columns: list[list] = [[], [], [], []]
                ids, nths = part.column(0).to_pylist(), part.column(1).to_pylist()
                texts = part.column(2).to_pylist()
                for doc_id, own, text, (h, place, kind) in zip(
                    ids, nths, texts, entries(part.column(3), ("hash", "place", "kind")), strict=True
                ):
                    nth, first, more = run_of(place)
                    pick = (kind == NARROW_KIND) & (nth == own)
                    raw = text.encode()
                    columns[0].append(h[pick])
                    columns[1].append(np.full(int(pick.sum()), doc_id))
                    columns[2].append(place[pick])
                    ends = (first + more + LENGTH)[pick].tolist()
                    columns[3] += [raw[a:b] for a, b in zip(first[pick].tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(np.concatenate(c)) for c in columns[:3]], pa.array(columns[3], pa.binary())],
                    names=["hash", "doc_id", "place", "stretch"],
                )

    return held.where(of_kind(NARROW_KIND)).mapInArrow(run, "hash long, doc_id long, place long, stretch binary")


def window_rows(held: DataFrame) -> DataFrame:
    """(a, b, doc_id, place): two digests of each window of the stretches whose windows meet one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                ids, nths = part.column(0).to_pylist(), part.column(1).to_pylist()
                for doc_id, own, text, (place, kind) in zip(
                    ids, nths, part.column(2).to_pylist(), entries(part.column(3), ("place", "kind")), strict=True
                ):
                    nth, first, more = run_of(place)
                    pick = np.flatnonzero((kind == WIDE_KIND) & (nth == own))
                    data = np.frombuffer(text.encode(), np.uint8)
                    for low in range(0, len(pick), 4096):
                        some = pick[low : low + 4096]
                        n = more[some] + 1
                        start = np.repeat(first[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
                        size = n + LENGTH - 1
                        ends = np.cumsum(size)
                        bytes_at = np.repeat(first[some] - ends + size, size) + np.arange(ends[-1])
                        cut = data[bytes_at]
                        at = np.repeat(ends - size - np.cumsum(n) + n, n) + np.arange(n.sum())
                        yield pa.RecordBatch.from_arrays(
                            [
                                *[pa.array(d.of(cut)(at, at + LENGTH).view(np.int64)) for d in (DIGEST, OTHER_DIGEST)],
                                pa.array(np.full(len(at), doc_id)),
                                pa.array(place_of(np.full(len(at), own), start, np.zeros(len(at), np.int64))),
                            ],
                            names=["a", "b", "doc_id", "place"],
                        )

    return held.where(of_kind(WIDE_KIND)).mapInArrow(run, "a long, b long, doc_id long, place long")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(doc_id, place) of windows (a, b, doc_id, place) that have an equal one with an earlier place."""
    low = windows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "place")).alias("low"), F.count(F.lit(1)).alias("n"))
    own = F.struct("doc_id", "place")
    return windows.join(low.where("n > 1").select("a", "b", "low"), ["a", "b"]).where(own != F.col("low")).select("doc_id", "place")


class Block:
    """Stretches, in order of hash, document and place, whose repeats are found together."""

    def __init__(self):
        self.rows: list[tuple[int, int, int, bytes]] = []
        self.size = 0

    def add(self, row: tuple[int, int, int, bytes]) -> None:
        self.rows.append(row)
        self.size += len(row[3])

    def settle(self) -> tuple[list[int], list[int]]:
        """The repeats: ids and places."""
        if not self.rows:
            return [], []
        lens = np.array([len(r[3]) for r in self.rows])
        ends = np.cumsum(lens)
        text = np.frombuffer(b"".join(r[3] for r in self.rows), np.uint8)
        place = np.arange(len(text)) - np.repeat(ends - lens, lens)
        marks = repeat_marks(text, place <= np.repeat(lens, lens) - LENGTH)
        edges = np.flatnonzero(np.diff(np.r_[False, marks, False].astype(np.int8)))
        rows = np.searchsorted(ends, edges[::2], side="right")
        # a run of marks stays in its stretch, since a stretch ends with places that start no window
        nth, first, _ = run_of(np.array([self.rows[i][2] for i in rows.tolist()], np.int64))
        begin = first + edges[::2] - (ends - lens)[rows]
        out = [self.rows[i][1] for i in rows.tolist()], place_of(nth, begin, edges[1::2] - edges[::2] - 1).tolist()
        self.rows, self.size = [], 0
        return out


def repeated_runs(stretches: DataFrame) -> DataFrame:
    """(doc_id, place): runs of windows of the stretches that have an equal one with an earlier place."""
    ordered = stretches.repartition("hash").sortWithinPartitions("hash", "doc_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in block.settle()], names=["doc_id", "place"])

        block, last = Block(), None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if block.size >= BLOCK and row[0] != last:
                    yield settled()
                last = row[0]
                block.add(row)
        yield settled()

    return ordered.mapInArrow(run, "doc_id long, place long")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed (runs [begin, end) of bytes) and kept (the bytes that stay), for each row.

    Texts count as UTF-8 bytes; a null text is empty.  Which strings repeat is
    judged on the input, not on what is left; overlaps count.  Rows with a null
    id take no part and lose nothing.  Rows that repeat an id and text count as
    one document with one result; an id's different texts are ordered by their
    bytes, and more than 2^21 of them are an error.  Texts of any length count whole (one text is one task's work), an
    empty table gives an empty one, and other columns are not looked at.
    """
    # a renaming that changes nothing would keep Spark from seeing that the joins read equal exchanges
    as_is = id_col == "doc_id" and docs.schema[id_col].dataType.typeName() == "long"
    base = docs.select(
        F.col("doc_id") if as_is else F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    some = base.where("doc_id is not null")
    by_text = Window.partitionBy("doc_id").orderBy("text")
    known = some.withColumns(
        {"nth": F.dense_rank().over(by_text) - 1, "twin": F.row_number().over(by_text) > F.rank().over(by_text)}
    )
    met = met_anchors(anchor_rows(known.where("not twin"), *hot_hashes(some)))
    held = known.where("not twin").join(met, "doc_id").select("doc_id", "nth", "text", "met")
    runs = repeated_runs(stretch_rows(held)).unionByName(repeated_windows(window_rows(held)))
    runs = runs.groupBy("doc_id").agg(F.collect_list("place").alias("runs"))
    whole = known.join(met, "doc_id", "left").join(runs, "doc_id", "left").select("doc_id", "nth", "text", "met", "runs")
    nothing = base.where("doc_id is null").select(
        "doc_id", F.lit(0).alias("nth"), "text", F.lit(None).cast(met.schema["met"].dataType).alias("met"), F.lit(None).cast("array<bigint>").alias("runs")
    )
    return whole.unionByName(nothing).mapInArrow(cut_out, CUT)


CUT = "doc_id long, n_bytes long, removed array<struct<begin:long,end:long>>, kept binary"
ARROW_RUNS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 2):
            sizes, removed, kept = [], [], []
            offsets, values = part.column(4).offsets.to_numpy(), part.column(4).values.to_numpy()
            for i, (own, text, (place, kind)) in enumerate(
                zip(part.column(1).to_pylist(), part.column(2).to_pylist(), entries(part.column(3), ("place", "kind")), strict=True)
            ):
                raw = text.encode()
                nth, first, more = run_of(np.r_[place[kind == AGAIN], values[offsets[i] : offsets[i + 1]]])
                here = np.flatnonzero(nth == own)
                here = here[np.argsort(first[here], kind="stable")]
                begin, end = first[here], first[here] + more[here] + LENGTH
                end = np.maximum.accumulate(end)
                new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]]) if len(begin) else np.empty(0, np.int64)
                begin, end = begin[new].tolist(), end[np.r_[new[1:], len(end)] - 1].tolist() if len(new) else []
                sizes.append(len(raw))
                removed.append([{"begin": a, "end": b} for a, b in zip(begin, end, strict=True)])
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *end], [*begin, len(raw)], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, ARROW_RUNS), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "removed", "kept"],
            )
