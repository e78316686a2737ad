"""Best-fit packing planned over a histogram of lengths.

Documents are tokenised once and cut into pieces of at most a window; a piece
knows the task that cut it (its shard) and its place among that shard's pieces
of the same length.  The numbers of pieces by length, at most ``window`` of
them, are all that the plan needs: best fit, longest first, over counts.  It
treats equal sequences as one group, so its work depends on the window and not
on the corpus.  A plan is a list of runs of slots for each length.  Pieces
take them by their rank within their length, which is their place in the shard
plus the counts of the shards before it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, slices
from .packing import piece_classes
from .shared_tables import written
from .token_counts import SPLIT, RankMerger

#: A worker forgets the pieces and pre-tokens that it knows beyond this many.
KNOWN_LIMIT = 500_000
#: White space of which a part forms a pre-token of its own; texts are cut before its last character.
#: Fixed value: the characters that Unicode calls white space.
SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WIDE_SPACE = re.compile(SPACE + "{3,}|" + SPACE + r"{2,}\Z")
#: A text without any of these has no two such characters in a row.
MAYBE_WIDE = ("  ", "\n\n", " \n", "\n ", *map(chr, (9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


class ByteEncoder:
    """The ids of texts under a byte-level vocabulary, remembered by piece.

    A text is cut before blanks and line breaks.  A pre-token never reaches
    over such a cut but within white space of three characters or more (two at
    the end of a text), so that is cut out first and looked up on its own.
    """

    def __init__(self, path: str):
        self.merger = RankMerger(path)
        self.split = regex.compile(SPLIT)
        special = self.merger.special
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.special_ids = {s: np.array([self.merger.special_ids[s]], "<u4").tobytes() for s in special}
        self.tokens: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def learn_tokens(self, tokens: list[str]) -> None:
        raw = [t.encode() for t in tokens]
        place, ids = self.merger.merge(raw)
        edges = (np.r_[0, np.cumsum(np.bincount(place, minlength=len(raw)))] * 4).tolist()
        raw_ids = ids.astype("<u4").tobytes()
        self.tokens.update(zip(tokens, map(raw_ids.__getitem__, map(slice, edges, edges[1:])), strict=True))

    def learn(self, pieces: list[str]) -> None:
        """Pieces that begin with a line break stand for themselves, others for a blank and themselves.

        Pre-tokens end where the class of characters changes, and all new ones
        are merged as one ragged array.  Pieces with an apostrophe, inner white
        space or a rare character are cut by the pattern.
        """
        whole = [p if p[:1] == "\n" else " " + p for p in pieces]
        points = np.frombuffer("".join(whole).encode("utf-32-le"), "<u4")
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        first = np.cumsum(sizes) - sizes
        starts = np.zeros(len(points), bool)
        starts[first] = True
        classes = piece_classes()
        kind = classes[np.minimum(points, len(classes) - 1)]
        odd = (points == 39) | (points >= len(classes)) | ((kind == 0) & ~starts)
        by_pattern = np.logical_or.reduceat(odd, first)
        for i in np.flatnonzero(by_pattern).tolist():
            self.pieces[pieces[i]] = b"".join(self.known_tokens(self.split.findall(whole[i])))
        if by_pattern.all():
            return
        keep = np.repeat(~by_pattern, sizes)
        points, kind, starts = points[keep], kind[keep], starts[keep]
        after_start = np.r_[False, starts[:-1]]
        cut = starts | np.where(after_start, np.r_[False, points[:-1] == 10], np.r_[True, kind[1:] != kind[:-1]])
        at = np.flatnonzero(cut)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800)
        plain = np.flatnonzero(~by_pattern).tolist()
        raw = np.frombuffer("".join([whole[i] for i in plain]).encode(), np.uint8)
        place, ids = self.merger.merge_ragged(raw, np.add.reduceat(width, at))
        piece = (np.cumsum(starts) - 1)[at][place]
        edges = (np.r_[0, np.cumsum(np.bincount(piece, minlength=len(plain)))] * 4).tolist()
        raw_ids = ids.astype("<u4").tobytes()
        self.pieces.update(zip([pieces[i] for i in plain], map(raw_ids.__getitem__, map(slice, edges, edges[1:])), strict=True))

    def parts(self, text: str) -> Iterator[str | bytes]:
        """Special strings as ids, wide white space as '' and itself, the rest as texts to cut."""
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                yield self.special_ids[part]
                continue
            done = 0
            for m in WIDE_SPACE.finditer(part) if any(x in part for x in MAYBE_WIDE) else ():
                end = m.end() if m.end() == len(part) else m.end() - 1
                if m.start() > done:
                    yield part[done : m.start()]
                space = part[m.start() : end]
                yield b"".join(self.known_tokens(self.split.findall(space)))
                done = end
            if done < len(part):
                yield part[done:]

    def known_tokens(self, tokens: list[str]) -> list[bytes]:
        if new := [t for t in dict.fromkeys(tokens) if t not in self.tokens]:
            self.learn_tokens(new)
        return [self.tokens[t] for t in tokens]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.pieces) > KNOWN_LIMIT:
            self.pieces.clear()
        if len(self.tokens) > KNOWN_LIMIT:
            self.tokens.clear()
        cut = [
            [p if isinstance(p, bytes) else p.replace("\n", " \n").split(" ") for p in self.parts(t or "")] for t in texts
        ]
        known = self.pieces
        lists = [p for parts in cut for p in parts if isinstance(p, list)]
        if new := set().union(*(islice(p, 1, None) for p in lists)).difference(known):
            self.learn(list(new))
        # a text's first piece has nothing before it
        heads = dict.fromkeys(p[0] for p in lists)
        flat = [self.split.findall(h) for h in heads]
        if new := list(set().union(*flat).difference(self.tokens)):
            self.learn_tokens(new)
        heads = dict(zip(heads, (b"".join(map(self.tokens.__getitem__, f)) for f in flat), strict=True))
        return [
            b"".join(
                p if isinstance(p, bytes) else heads[p[0]] + b"".join(map(known.__getitem__, islice(p, 1, None)))
                for p in parts
            )
            for parts in cut
        ]


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


#: length, first rank, number of slots, first sequence, slots in each of its sequences, offset of the first of them.
RUN = "length int, first long, n long, sequence long, each int, at int"


def planned(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of slots for ``counts[length]`` pieces of each length, best fit with the longest first.

    Each piece goes to the fullest open sequence that has room for it, a new
    one if there is none.  Groups of sequences with the same room are treated
    together; a length splits a group once at most, so groups and runs are
    bounded by the window.
    """
    runs = []
    sequences = 0
    rooms: dict[int, list[tuple[int, int]]] = {}  # room: groups of (first sequence, number)
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, first = counts[length], 0
        fitting = [r for r in rooms if r >= length]
        heapq.heapify(fitting)
        while left:
            if fitting:
                room = fitting[0]
                begin, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    heapq.heappop(fitting)
            else:
                room, begin = window, sequences
                n = -(-left // (window // length))
                sequences += n
            each = room // length
            full = min(n, left // each)
            last = min(each, left - full * each) if full < n else 0
            for at, m, k in ((begin, full, each), (begin + full, 1 if last else 0, last)):
                if m:
                    runs.append((length, first, m * k, at, k, window - room))
                    first += m * k
                    left -= m * k
                    if room > k * length:
                        rooms.setdefault(room - k * length, []).append((at, m))
            used = full + (1 if last else 0)
            if used < n:
                rooms.setdefault(room, []).append((begin + used, n - used))
    return runs


def cut_pieces(
    docs: DataFrame, tokenizer_path: str, window: int, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a piece: id, piece, start, length, ids, and its shard and place among the shard's pieces of its length."""
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text"))
    names = [id_col, "piece", "start", "length", "ids", "shard", "place"]
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length int, ids binary, shard int, place long"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, upto = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            for part in slices(batch, 1):
                raw = [ids + end for ids in encoder(tokenizer_path).encode(part.column(1).to_pylist())]
                n = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
                pieces = -(-n // window)
                row = np.repeat(np.arange(len(raw)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (n - (pieces - 1) * window)[row]  # the first piece has what whole windows leave
                start = np.where(piece == 0, 0, head + (piece - 1) * window)
                length = np.where(piece == 0, head, window)
                order = np.argsort(length, kind="stable")
                begins = np.flatnonzero(np.r_[True, np.diff(length[order]) > 0]) if len(order) else order
                sizes = np.diff(np.r_[begins, len(order)])
                place = np.empty(len(row), np.int64)
                place[order] = np.arange(len(order)) - np.repeat(begins, sizes) + upto[length[order]]
                upto += np.bincount(length, minlength=window + 1)
                ids = [raw[r][a:b] for r, a, b in zip(row.tolist(), (start * 4).tolist(), ((start + length) * 4).tolist(), strict=True)]
                columns = [
                    part.column(0).take(pa.array(row)),
                    pa.array(piece, pa.int32()),
                    pa.array(start),
                    pa.array(length, pa.int32()),
                    pa.array(ids, pa.binary()),
                    pa.array(np.full(len(row), shard, np.int32)),
                    pa.array(place),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        encoder(tokenizer_path).tokens.clear()  # the pieces stay for the worker's next task
        give_back()

    return rows.mapInArrow(run, schema)


def best_fit_packed(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row for each piece: id, piece, start, length, sequence_id, offset and the ids, into few sequences.

    A document is its text's ids (a null or empty text has none) and the end
    id.  Only longer documents than ``window`` are cut, into pieces of a whole
    window, of which the first may be shorter.  The pieces of a sequence lie
    gapless from offset 0 on and take ``window`` ids at most; nothing is padded
    or dropped.  ``carry`` are columns over the pieces' columns, by default the
    ids (little-endian unsigned 32-bit numbers); what isn't asked for crosses no
    shuffle.

    Rows that repeat an id or a text are documents of their own; a null id
    stays null; other columns are not looked at; an empty table gives no rows.
    Very long texts are cut like others, one after the other.  The driver sees
    one count for each length, and the plan that it broadcasts has a bounded
    number of runs: groups of equal sequences grow by two at most with each
    length.
    """
    spark = docs.sparkSession
    carry = {"ids": F.col("ids")} if carry is None else carry
    cut = cut_pieces(docs, tokenizer_path, window, end_id, id_col, text_col)
    kept = [id_col, "piece", "start", "length"]
    # shards and places belong to one run of the tasks, so everything below reads what that run has written
    pieces = written(cut.select(*[F.col(f"`{c}`") for c in kept], "shard", "place", *[c.alias(f"__of_{n}") for n, c in carry.items()]))
    by_shard = pieces.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_shard.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(planned(counts, window), RUN)
    ranked = pieces.join(bases, ["length", "shard"]).withColumn("rank", F.col("base") + F.col("place"))
    runs = F.broadcast(plan.withColumnRenamed("length", "of_length"))
    place = F.col("rank") - F.col("first")
    mine = (F.col("length") == F.col("of_length")) & (place >= 0) & (place < F.col("n"))
    return ranked.join(runs, mine).select(
        *[F.col(f"`{c}`") for c in kept],
        (F.col("sequence") + F.floor(place / F.col("each"))).alias("sequence_id"),
        (F.col("at") + F.pmod(place, F.col("each")) * F.col("length")).alias("offset"),
        *[F.col(f"__of_{n}").alias(n) for n in carry],
    )
