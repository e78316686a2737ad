"""Benchmark decontamination with one Aho-Corasick automaton.

The windows (ten consecutive words) of all normalised benchmark items form an
automaton; each text is normalised and scanned once, and hits are mapped back
to words and to offsets of the original text.

The items are read in groups of at most ``GROUP_BYTES`` of text, so that an
automaton's size is bounded whatever the benchmark's size; nearly always one
group holds all.  With more groups the texts are scanned once for each, and
the hits are put together by row.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns

#: Benchmark text for one automaton; nodes take some 100 bytes for each byte.
GROUP_BYTES = 2 << 20

_IS_WORD = [b >= 0x80 or chr(b).isalnum() for b in range(256)]
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if _IS_WORD[b] else 32 for b in range(256))


def words(text: str | None) -> list[str]:
    """A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; each byte of UTF-8 as one character."""
    return [] if not text else folded(text).split()


def folded(text: str) -> str:
    return text.encode().translate(_FOLD).decode("latin-1")


@lru_cache(maxsize=1)
def automaton(items: tuple[tuple[str, str], ...], n: int):
    """The automaton of the items' windows; each holds (number of words, item places)."""
    holders: dict[str, tuple[int, set[int]]] = {}
    for at, (_, text) in enumerate(items):
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            window = w[i : i + n]
            holders.setdefault(" ".join(window), (len(window), set()))[1].add(at)
    if not holders:
        return None
    out = ahocorasick.Automaton()
    for window, (size, places) in holders.items():
        out.add_word(f" {window} ", (size, len(window), tuple(sorted(places))))
    out.make_automaton()
    return out


def hits(text: str, found_by) -> tuple[np.ndarray, np.ndarray, set[int], int]:
    """First and last word of each occurring window, the items, the number of words."""
    w = folded(text).split()
    line = f" {' '.join(w)} "
    last, size, items = [], [], set()
    for end, (n, _, places) in found_by.iter(line):
        last.append(end)
        size.append(n)
        items.update(places)
    if not last:
        return np.empty(0, np.int64), np.empty(0, np.int64), items, len(w)
    lens = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(lens)  # the blank after each word
    stop = np.searchsorted(ends, np.array(last))
    return stop - np.array(size) + 1, stop, items, len(w)


def covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in one of the ranges."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last + 1, -1)
    return np.cumsum(step[:-1]) > 0


def char_spans(text: str, inside: np.ndarray) -> list[tuple[int, int]]:
    """The runs of hit words as code points of the original text."""
    is_word = np.frombuffer(text.encode().translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.r_[False, is_word, False].astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    lead = np.r_[0, np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)]
    runs = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    return [(int(lead[begin[a]]), int(lead[end[b - 1]])) for a, b in zip(runs[::2], runs[1::2], strict=True)]


def item_groups(benchmark: DataFrame, item_col: str, text_col: str) -> list[tuple[tuple[str, str], ...]]:
    """The items as text pairs (id, text) in groups of at most GROUP_BYTES, each a bounded collect."""
    items = benchmark.select(
        F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text")
    ).where("item is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.max(F.octet_length("text"))).first()
    n = 1 + int(size["n"]) // (GROUP_BYTES // 2)
    out = []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        out.append(tuple(sorted((r["item"], r["text"]) for r in part.distinct().collect())))
    return [g for g in out if g] or [()]


HIT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)
ARROW_HIT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("hit_words", pa.list_(pa.int64())),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.list_(pa.int64()))),
    ]
)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
) -> DataFrame:
    """docs with n_words, n_hit, hit_items, hit_spans and contaminated.

    n_hit counts the words of a text inside an occurrence of a window of a
    benchmark item; hit_items are the distinct ids (as text, sorted) of the
    items with such a window; hit_spans are the runs of hit words as [start,
    end) code points of the original.  An item with fewer words than a window,
    but not none, is one window.  Null and empty texts have no words; items
    with a null id or text take no part; an empty benchmark hits nothing.
    Old columns of these names are replaced; repeated rows stay, and repeated
    items count as one.  A text of any length is scanned whole, in one task; an
    empty table gives an empty one.
    """
    out = docs
    columns = []
    for k, items in enumerate(item_groups(benchmark, item_col, item_text_col)):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def compute(texts: list, shared=shared) -> list[pa.Array]:
            found_by = automaton(shared.value, window)
            rows = []
            for text in texts:
                if not text or found_by is None:
                    rows.append({"n_words": len(words(text)), "hit_words": [], "items": [], "spans": []})
                    continue
                first, last, places, n = hits(text, found_by)
                inside = covered(first, last, n) if len(first) else np.zeros(0, bool)
                rows.append(
                    {
                        "n_words": n,
                        "hit_words": np.flatnonzero(inside).tolist(),
                        "items": sorted({shared.value[i][0] for i in places}),
                        "spans": char_spans(text, inside) if len(first) else [],
                    }
                )
            return [pa.array(rows, ARROW_HIT)]

        columns.append(f"__hit_{k}")
        out = with_columns(out, text_col, [T.StructField(columns[-1], HIT)], compute, automaton.cache_clear)

    def union(field: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(c)[field] for c in columns]))))

    n_hit = F.size(union("hit_words")).cast("long")
    return out.withColumns(
        {
            "n_words": F.col(columns[0])["n_words"],
            "n_hit": n_hit,
            "hit_items": union("items"),
            "hit_spans": union("spans"),
            "contaminated": n_hit > 0,
        }
    ).drop(*columns)
