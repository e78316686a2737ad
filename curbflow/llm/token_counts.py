"""Token counts by rank-synchronous array merging.

A byte-level BPE vocabulary file is read (never trained).  Texts are split
into pre-tokens; the distinct pre-tokens of a slice of rows that are not known
yet lie as one ragged numpy array of symbols.  In each round every pre-token
applies its own lowest-rank pair everywhere at once (left to right where
occurrences overlap), until no pair has a rank.  What is left are its tokens.
Each vocabulary entry comes from exactly one merge, so a merge can only give
rise to pairs of later rank, and a whole rank can be applied at once.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns

#: Fixed value: the published split pattern of this family of vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = np.int32(2**31 - 1)
#: A worker forgets the pieces that it knows beyond this many.
KNOWN_LIMIT = 600_000
#: So many pre-tokens of one text are held as Python objects at once.
STEP = 400_000
#: Marks a piece that can't be counted on its own; no text has so many tokens.
NOT_PLAIN = -(1 << 50)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in such files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in stand_in):
        stand_in[b] = chr(256 + n)
    return [stand_in[b] for b in range(256)]


class RankMerger:
    """Counts the tokens of byte strings by synchronous merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.first = np.array([vocab[s] for s in byte_symbols()], dtype=np.int64)
        self.last = np.array([vocab[s + suffix] for s in byte_symbols()], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        if len(np.unique(self.made)) != len(self.made):
            raise ValueError("two merges make the same token; ranks can't be applied synchronously")
        key = left << 20 | right
        self.rank_of = np.argsort(key).astype(np.int32)
        self.key = key[self.rank_of]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank_of[at], NO_RANK)

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each (non-empty) byte string."""
        return np.bincount(self.merge(words)[0], minlength=len(words))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of (non-empty) byte strings: the places of their strings, in order, and their ids."""
        return self.merge_ragged(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))

    def merge_ragged(self, raw: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for byte strings that lie in one array, with their lengths."""
        done_seq, done_sym = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        sym = self.first[raw]
        ends = np.cumsum(lens) - 1
        sym[ends] = self.last[raw[ends]]
        seq = np.repeat(np.arange(len(lens)), lens)
        rank = np.full(len(sym), NO_RANK, np.int32)
        same = np.flatnonzero(seq[:-1] == seq[1:])
        rank[same] = self.ranks(sym[same], sym[same + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            lowest = np.minimum.reduceat(rank, starts)
            live = lowest != NO_RANK
            if not live.all():
                keep = np.repeat(live, sizes)
                done_seq.append(seq[~keep])
                done_sym.append(sym[~keep])
                sym, seq, rank = sym[keep], seq[keep], rank[keep]
                sizes, lowest = sizes[live], lowest[live]
                if not len(sym):
                    break
            hit = rank == np.repeat(lowest, sizes)
            at = np.flatnonzero(hit)
            run = np.r_[True, at[1:] != at[:-1] + 1]
            in_run = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[in_run % 2 == 0]
            sym[at] = self.made[rank[at]]
            stays = np.ones(len(sym), bool)
            stays[at + 1] = False
            moved = at - np.arange(len(at))
            sym, seq, rank = sym[stays], seq[stays], rank[stays]
            near = np.zeros(len(sym), bool)
            near[moved] = True
            near[moved[moved > 0] - 1] = True
            touched = np.flatnonzero(near)
            rank[touched] = NO_RANK
            touched = touched[touched + 1 < len(sym)]
            touched = touched[seq[touched] == seq[touched + 1]]
            rank[touched] = self.ranks(sym[touched], sym[touched + 1])
        place = np.concatenate(done_seq)
        order = np.argsort(place, kind="stable")
        return place[order], np.concatenate(done_sym)[order]


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[RankMerger, regex.Pattern, regex.Pattern | None, dict[str, int]]:
    merger = RankMerger(path)
    special = regex.compile("|".join(map(regex.escape, merger.special))) if merger.special else None
    return merger, regex.compile(SPLIT), special, {}


class TextCounter:
    """Counts whole texts; what it has counted once it remembers by piece.

    A text is cut at its blanks.  No pre-token reaches over a blank from its
    left, and one blank goes with what follows it, so the count of a text is
    the sum over its pieces with their leading blanks - unless white space
    meets a blank.  Such a text is split as a whole.
    """

    def __init__(self, path: str):
        self.merger = RankMerger(path)
        self.split = regex.compile(SPLIT)
        special = "|".join(map(regex.escape, self.merger.special))
        self.special = regex.compile(special) if special else None
        self.known: dict[str, int] = {}

    def sums(self, strings: list[str]) -> list[int]:
        """The counts of the strings, each split on its own."""
        found = [self.split.findall(x) for x in strings]
        new = list(set().union(*found)) if found else []
        n = dict(zip(new, self.merger.count([w.encode() for w in new]).tolist(), strict=True))
        return [sum(map(n.__getitem__, x)) for x in found]

    def whole(self, text: str) -> int:
        """The count of one text in steps of bounded size."""
        total, found = 0, self.split.finditer(text)
        while toks := Counter(m.group() for m in islice(found, STEP)):
            total += int(self.merger.count([w.encode() for w in toks]) @ np.array(list(toks.values())))
        return total

    def count(self, texts: list[str | None]) -> list[int]:
        totals = [0] * len(texts)
        parts: list[tuple[int, str]] = []
        for i, text in enumerate(texts):
            split = self.special.split(text or "") if self.special else [text or ""]
            totals[i] = len(split) - 1
            parts += [(i, p) for p in split if p]
        pieces = [p.split(" ") for _, p in parts]
        heads = self.sums([p[0] for p in pieces])
        new = list(set().union(*(p[1:] for p in pieces)).difference(self.known))
        plain = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        self.known.update(dict.fromkeys(new, NOT_PLAIN))
        self.known.update(zip(plain, self.sums([" " + p for p in plain]), strict=True))
        for (i, text), p, head in zip(parts, pieces, heads, strict=True):
            n = sum(map(self.known.__getitem__, islice(p, 1, None)), head)
            totals[i] += n if n >= 0 and not p[0][-1:].isspace() else self.whole(text)
        if len(self.known) > KNOWN_LIMIT:
            self.known.clear()
        return totals


@lru_cache(maxsize=2)
def counter(path: str) -> TextCounter:
    return TextCounter(path)


def count_texts(texts: list[str | None], path: str) -> list[int]:
    """The number of tokens of each text; None counts as the empty text."""
    return counter(path).count(texts)


def token_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 1024) -> DataFrame:
    """docs with n_bytes, n_tokens (long) and over_limit (n_tokens > limit).

    Whole texts are counted as the vocabulary's library does, without begin,
    end or added tokens; its special strings inside a text count as one token
    each.  Null and empty texts have 0 bytes and 0 tokens.  Old columns of the
    three names are replaced, all others kept; repeated rows stay repeated; an
    empty table gives an empty table.  One pass, no shuffle.
    """

    def compute(texts: list) -> list[pa.Array]:
        return [pa.array(count_texts(texts, tokenizer_path), pa.int64())]

    def finish() -> None:
        counter(tokenizer_path).known.clear()

    out = with_columns(docs, text_col, [T.StructField("n_tokens", T.LongType())], compute, finish)
    return out.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(F.col(f"`{text_col}`")).cast("long"), F.lit(0).cast("long")),
            "over_limit": F.col("n_tokens") > limit,
        }
    )
