"""Packing by lexical retrieval.

Documents are tokenised and gathered into shards of bounded size as a task
reads them.  A shard has a BM25 inverted index over its documents' tokens.
Each sequence starts with the longest unused document, and the index returns
unused neighbours of that seed in order of score, which fill its window: first
those that fit whole, then the best one left, cut where the window ends.  What
a shard has left at its end is cut into powers of two, so nothing is padded.
Shards never meet, so there is no shuffle, and a task holds one shard.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices
from .token_counts import RankMerger

#: Tokens of a shard at most, but for one longer document.
SHARD_TOKENS = 2_000_000
K1, B = 1.2, 0.75
#: A term that more of a shard's documents hold than this share has its weights as a row over all documents.
COMMON = 0.125
#: Weights are whole numbers, this many to one, so that sums are exact in any order and equal documents tie.
EXACT = 2.0**28
#: Fixed value: the published split pattern of this family of vocabularies, for lower-case text.
WORD_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: A worker forgets the words that it knows beyond this many.
KNOWN_LIMIT = 200_000
#: Texts of about so many bytes are cut into words at once, postings of about so many tokens are counted at
#: once, and pieces of about so many bytes are handed over at once, so that these take little beside the shard.
TEXT_BYTES, COUNT_TOKENS, OUT_BYTES = 1 << 18, 1 << 17, 1 << 20
#: What a piece takes beside its ids.
PIECE_BYTES = 64


@lru_cache(maxsize=1)
def piece_classes() -> np.ndarray:
    """By code point as far as lower-casing Latin letters leads: 0 white space, 1 letter, 2 number, 3 other."""
    kinds = [regex.compile(k) for k in (r"\s", r"\p{L}", r"\p{N}")]
    found = [[bool(k.match(chr(c))) for c in range(0x2C70)] for k in kinds]
    return np.select(found, (0, 1, 2), 3).astype(np.uint8)


class WordEncoder:
    """The ids of words, remembered.

    The vocabulary lower-cases, drops white space and joins nothing over it,
    so a text's ids are those of its words (cut at ASCII white space).  Words in
    Latin letters are cut and merged here, all new ones at once as one ragged
    array; words with an apostrophe are cut by the pattern; words with other
    characters or a special string go to the library, one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merger = RankMerger(path)
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> None:
        joined = b"\n".join(words)
        raw = np.frombuffer(joined, np.uint8)
        after = np.r_[raw[1:], np.uint8(0)]
        # beyond U+024F, the one letter that lower-cases to two, the beginning of a special string
        odd = (raw >= 0xCA) | ((raw == 0xC9) & (after >= 0x90)) | ((raw == 0xC4) & (after == 0xB0)) | ((raw == 60) & (after == 124))
        starts = np.cumsum(raw == 10)
        kind = np.zeros(len(words), np.uint8)
        kind[starts[raw == 39]] = 1
        kind[starts[odd]] = 2
        for i in np.flatnonzero(kind == 2).tolist():
            ids = self.library.encode(words[i].decode(), add_special_tokens=False).ids
            self.known[words[i]] = np.array(ids, "<u4").tobytes()
        plain = [words[i] for i in np.flatnonzero(kind == 0).tolist()] if kind.any() else words
        if plain:
            self.learn_plain(plain)
        cut = [words[i] for i in np.flatnonzero(kind == 1).tolist()]
        if cut:
            pieces = [WORD_SPLIT.findall(w.decode().lower()) for w in cut]
            flat = [p.encode() for found in pieces for p in found]
            self.remember(cut, np.repeat(np.arange(len(cut)), [len(p) for p in pieces]), *self.merger.merge(flat))

    def learn_plain(self, words: list[bytes]) -> None:
        """Cuts where the class of characters changes, and around each number."""
        text = b"\n".join(words).decode().lower()
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        size = 1 + (points >= 0x80) + (points >= 0x800)
        kind = piece_classes()[points]
        inside = kind > 0
        begins = inside & ((kind == 2) | np.r_[True, kind[1:] != kind[:-1]])
        raw = np.frombuffer(text.encode(), np.uint8)[np.repeat(inside, size)]
        word = np.cumsum(points == 10)[begins]
        at = np.flatnonzero(begins[inside])
        lens = np.add.reduceat(size[inside], at) if len(at) else np.empty(0, np.int64)
        self.remember(words, word, *self.merger.merge_ragged(raw, lens))

    def remember(self, words: list[bytes], word: np.ndarray, place: np.ndarray, ids: np.ndarray) -> None:
        """The ids of the words; ``word`` is that of each piece, ``place`` the piece of each id."""
        edges = (np.r_[0, np.cumsum(np.bincount(word[place], minlength=len(words)))] * 4).tolist()
        raw = ids.astype("<u4").tobytes()
        self.known.update(zip(words, map(raw.__getitem__, map(slice, edges, edges[1:])), strict=True))

    def encode(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        """The ids of each text, then the end id."""
        split = [t.encode().split() if t else [] for t in texts]
        if len(self.known) > KNOWN_LIMIT:
            self.known.clear()
        if new := set().union(*split).difference(self.known):
            self.learn(list(new))
        end = np.array([end_id], "<u4").tobytes()
        return [np.frombuffer(b"".join([*map(self.known.__getitem__, words), end]), "<u4") for words in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    made = WordEncoder(path)
    give_back()
    return made


def encode(texts: list[str | None], path: str, end_id: int) -> list[np.ndarray]:
    """The ids of each text, then the end id."""
    return encoder(path).encode(texts, end_id)


def posted(docs: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens of each document in order, how often it has each, and how many it has."""
    tokens, times, kinds = [], [], np.zeros(len(docs), np.int64)
    at, before = 0, np.r_[0, np.cumsum(sizes)]
    while at < len(docs):
        end = max(at + 1, int(np.searchsorted(before, before[at] + COUNT_TOKENS, "right")) - 1)
        key = np.concatenate(docs[at:end]).astype(np.int64)
        key |= np.repeat(np.arange(end - at) << 32, sizes[at:end])
        key, n = np.unique(key, return_counts=True)
        kinds[at:end] = np.bincount(key >> 32, minlength=end - at)
        tokens.append(key.astype(np.uint32))
        times.append(n.astype(np.int32))
        at = end
    return np.concatenate(tokens), np.concatenate(times), kinds


class ShardIndex:
    """A BM25 inverted index over the documents of a shard."""

    def __init__(self, docs: list[np.ndarray]):
        sizes = np.array([len(d) for d in docs])
        token, times, kinds = posted(docs, sizes)
        self.terms_of = np.r_[0, np.cumsum(kinds)]
        order = np.argsort(token, kind="stable")  # by term, then by document
        token = token[order]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        held = np.diff(np.r_[first, len(token)])
        number = np.repeat(np.arange(len(held), dtype=np.int32), held)
        # the terms of each document
        self.terms = np.empty(len(number), np.int32)
        self.terms[order] = number
        times, doc = times[order], np.repeat(np.arange(len(docs), dtype=np.int32), kinds)[order]
        del token, order
        idf = np.log1p((len(docs) - held + 0.5) / (held + 0.5))
        norm = K1 * (1 - B + B * sizes / sizes.mean())
        weight = np.rint(EXACT * np.repeat(idf, held) * times * (K1 + 1) / (times + norm[doc]))
        # common terms are rows over the documents, the others have lists of them
        common = held > COMMON * len(docs)
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        listed = ~common[number]
        self.dense = np.zeros((int(common.sum()), len(docs)))
        self.dense[self.row[number[~listed]], doc[~listed]] = weight[~listed]
        self.number, self.doc, self.weight = number[listed], doc[listed], weight[listed]
        self.begin = np.r_[0, np.cumsum(np.bincount(self.number, minlength=len(held)))]
        self.place = np.arange(len(docs))  # of each document in the rows and lists
        self.n_docs = len(docs)

    def keep(self, unused: np.ndarray) -> None:
        """From now on only these documents are scored; their weights stay."""
        stays = np.zeros(self.n_docs, bool)
        stays[self.place[unused]] = True
        place = np.cumsum(stays) - 1
        self.dense = self.dense[:, stays]
        listed = stays[self.doc]
        self.number, self.doc, self.weight = self.number[listed], place[self.doc[listed]], self.weight[listed]
        self.begin = np.r_[0, np.cumsum(np.bincount(self.number, minlength=len(self.row)))]
        self.place[unused] = place[self.place[unused]]
        self.n_docs = len(unused)

    def scores(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """BM25 of the unused documents for all terms of the seed."""
        if 2 * len(unused) < self.n_docs:
            self.keep(unused)
        terms = self.terms[self.terms_of[seed] : self.terms_of[seed + 1]]
        row = self.row[terms]
        terms = terms[row < 0]
        sizes = self.begin[terms + 1] - self.begin[terms]
        at = np.repeat(self.begin[terms] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        score = np.bincount(self.doc[at], self.weight[at], self.n_docs).astype(np.float64)
        for r in row[row >= 0].tolist():
            score += self.dense[r]
        return score[self.place[unused]]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """The unused documents of the shard, best score first; ties in order."""
        return unused[np.argsort(-self.scores(seed, unused), kind="stable")]


def pack(docs: list[np.ndarray], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (place, start, length); each holds `window` ids, or a power of two."""
    out: list[list[tuple[int, int, int]]] = []
    start = np.zeros(len(docs), np.int64)
    left = np.array([len(d) for d in docs])
    for i in np.flatnonzero(left >= window).tolist():
        while left[i] >= window:
            out.append([(i, int(start[i]), window)])
            start[i] += window
            left[i] -= window
    open_docs = int((left > 0).sum())
    index = ShardIndex(docs) if open_docs > 1 else None
    by_length = np.argsort(-left, kind="stable").tolist()
    total, next_seed = int(left.sum()), 0
    while total:
        while left[by_length[next_seed]] == 0:
            next_seed += 1
        seed = by_length[next_seed]
        size = min(window, 1 << (total.bit_length() - 1)) if total < window else window
        room, sequence = size, []

        def put(i: int, n: int, sequence: list = sequence) -> None:
            sequence.append((i, int(start[i]), n))
            start[i] += n
            left[i] -= n

        n = min(room, int(left[seed]))
        put(seed, n)
        room -= n
        if room:
            order = index.neighbours(seed, np.flatnonzero(left > 0))
            for i in order.tolist():
                if left[i] <= room:
                    n = int(left[i])
                    put(i, n)
                    room -= n
                    if not room:
                        break
            for i in order[left[order] > 0].tolist() if room else ():
                n = min(room, int(left[i]))
                put(i, n)
                room -= n
                if not room:
                    break
        out.append(sequence)
        total -= size
    return out


PIECES = "{id}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def packed(
    docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each piece: id, start, length, doc_tokens, sequence_id, offset, ids.

    A document is its text's ids (a null text has none) and the end id; ids is
    the piece as little-endian unsigned 32-bit numbers.  Every id lies in one
    piece; a sequence's pieces lie gapless from offset 0 on and come to
    ``window`` ids, or, at the end of a shard, to a power of two below it.
    Rows that repeat an id are documents of their own; a null id stays null;
    other columns are not looked at, whatever their names; an empty table gives
    no pieces.  A text longer than a shard makes up one by itself.
    """
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text"))
    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = PIECES.format(id=f"`{id_col}` {rows.schema[0].dataType.simpleString()}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_id = TaskContext.get().partitionId() << 36
        done, owners, held, size = 0, [], [], 0
        id_type = None

        def record(rows: list[tuple]) -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
            )

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal done
            give_back()  # what encoding took, before the index takes its part
            rows, room = [], OUT_BYTES
            for pieces in pack(held, window):
                offset = 0
                for i, start, n in pieces:
                    ids = held[i][start : start + n].tobytes()
                    rows.append((owners[i], start, n, len(held[i]), first_id + done, offset, ids))
                    offset += n
                    room -= len(ids) + PIECE_BYTES
                    if room <= 0:
                        yield record(rows)
                        rows, room = [], OUT_BYTES
                done += 1
            if rows:
                yield record(rows)

        for batch in batches:
            id_type = batch.column(0).type
            for part in slices(batch, 1, TEXT_BYTES):
                for owner, ids in zip(
                    part.column(0).to_pylist(), encode(part.column(1).to_pylist(), tokenizer_path, end_id), strict=True
                ):
                    if held and size + len(ids) > SHARD_TOKENS:
                        yield from settle()
                        owners, held, size = [], [], 0
                        give_back()
                    owners.append(owner)
                    held.append(ids)
                    size += len(ids)
        if held:
            yield from settle()
        owners, held = [], []
        encoder(tokenizer_path).known.clear()
        give_back()

    return rows.mapInArrow(run, schema)
