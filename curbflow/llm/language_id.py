"""Language identification by prediction by partial matching.

For each language a variable-order context tree over bytes holds how often each
byte followed each context of up to ``order`` bytes.  The trees are frozen
after training, so the code length of a byte after its longest known context -
with escapes (method C) to shorter contexts and exclusion of bytes already
offered - is worked out once for every node, byte and language.  Scoring walks
from the text's end of each context down the tree with array lookups, and adds
exact code lengths; the language with the shortest code wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns

UNDETERMINED = "und"
#: Bytes of text that are scored at once.
BLOCK = 1 << 19


@dataclass
class ContextTrees:
    """langs; classes of bytes; children and code lengths (bits) of the nodes."""

    langs: list[str]
    classes: np.ndarray  # byte -> class
    order: int
    child: np.ndarray  # node, class of the byte before -> node, or -1
    bits: np.ndarray  # node * classes + class, language -> code length

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """The code length in bits of each whole text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        n_classes = self.child.shape[1]
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= BLOCK):
                size += len(texts[stop]) + self.order
                stop += 1
            # each text after `order` line ends, so contexts never reach into another text
            gap = b"\n" * self.order
            whole = self.classes[np.frombuffer(gap + gap.join(texts[start:stop]), np.uint8)]
            for low in range(self.order, len(whole), BLOCK):
                high = min(low + BLOCK, len(whole))
                node = np.zeros(high - low, np.int32)
                live = np.arange(high - low)
                for depth in range(1, self.order + 1):
                    step = self.child[node[live], whole[low + live - depth]]
                    live = live[step >= 0]
                    node[live] = step[step >= 0]
                at = node.astype(np.int64) * n_classes + whole[low:high]
                sums = np.cumsum(self.bits[at], axis=0, dtype=np.float64)
                sums = np.vstack([np.zeros((1, sums.shape[1])), sums])
                begin = self.order
                for i in range(start, stop):
                    a, b = max(begin, low), min(begin + len(texts[i]), high)
                    if a < b:
                        out[i] += sums[b - low] - sums[a - low]
                    begin += len(texts[i]) + self.order
            start = stop
        return out


def build(samples: dict[str, list[bytes]], order: int = 4, min_count: int = 12, max_nodes: int = 60_000) -> ContextTrees:
    """Trees from texts by language; contexts seen fewer than ``min_count`` times have no node.

    Of more than ``max_nodes`` contexts the most frequent are kept, shorter ones
    first, which bounds the tables (a code length for each node, byte and
    language) where there are many languages.
    """
    langs = sorted(samples)
    seen = np.zeros(256, np.int64)
    joined = {}
    gap = b"\n" * order
    for lang in langs:
        joined[lang] = np.frombuffer(gap + gap.join(samples[lang]), np.uint8)
        seen += np.bincount(joined[lang], minlength=256)
    own = np.flatnonzero(seen)[:255]
    classes = np.full(256, len(own), np.uint8)  # bytes that training has not seen share a class
    classes[own] = np.arange(len(own))
    n = len(own) + 1
    unseen = max(1, 256 - len(own))
    coded = {lang: classes[x].astype(np.int64) for lang, x in joined.items()}
    # nodes level by level, so that a node's parent (the shorter context) comes first
    child = [np.full(n, -1, np.int32)]
    parent = [-1]
    place = {lang: np.zeros(max(0, len(x) - order), np.int64) for lang, x in coded.items()}
    node_of = {lang: p.copy() for lang, p in place.items()}
    for depth in range(1, order + 1):
        keys = {lang: place[lang] * n + x[order - depth : len(x) - depth] for lang, x in coded.items()}
        every = np.concatenate([k[p >= 0] for k, p in zip(keys.values(), place.values(), strict=True)] or [[]])
        found, times = np.unique(every.astype(np.int64), return_counts=True)
        room = max(0, max_nodes - len(parent))
        good = times >= min_count
        if good.sum() > room:
            good &= times >= np.sort(times)[-room - 1 : -room or None].max(initial=0) + 1 if room else False
        found = found[good]
        new = np.arange(len(parent), len(parent) + len(found))
        for key, node in zip(found.tolist(), new.tolist(), strict=True):
            child[key // n][key % n] = node
            parent.append(key // n)
            child.append(np.full(n, -1, np.int32))
        for lang in langs:
            at = np.searchsorted(found, keys[lang]) if len(found) else np.zeros(len(keys[lang]), np.int64)
            at = np.minimum(at, max(0, len(found) - 1))
            hit = (place[lang] >= 0) & (found[at] == keys[lang]) if len(found) else np.zeros(len(at), bool)
            place[lang] = np.where(hit, new[at] if len(found) else -1, -1)
            node_of[lang] = np.where(hit, place[lang], node_of[lang])
    n_nodes = len(parent)
    up = np.array(parent)
    bits = np.zeros((n_nodes * n, len(langs)), np.float32)
    for column, lang in enumerate(langs):
        # a count belongs to its longest context and to all shorter ones
        counts = np.bincount(node_of[lang] * n + coded[lang][order:], minlength=n_nodes * n).reshape(n_nodes, n)
        for node in range(n_nodes - 1, 0, -1):
            counts[up[node]] += counts[node]
        bits[:, column] = code_lengths(counts, up, unseen).ravel()
    return ContextTrees(langs, classes, order, np.array(child), bits)


def code_lengths(counts: np.ndarray, up: np.ndarray, unseen: int) -> np.ndarray:
    """Bits of each byte class in each context, with method C escapes and exclusion."""
    n_nodes, n = counts.shape
    out = np.zeros((n_nodes, n), np.float32)
    weight = np.ones(n)
    weight[-1] = unseen  # the last class stands for so many bytes
    for low in range(0, n_nodes, 2048):
        node = np.arange(low, min(low + 2048, n_nodes))
        prob = np.zeros((len(node), n))
        escape = np.ones(len(node))
        done = np.zeros((len(node), n), bool)
        at = node.copy()
        while (at >= 0).any():
            c = np.where(done | (at < 0)[:, None], 0, counts[np.maximum(at, 0)])
            total, kinds = c.sum(1), (c > 0).sum(1)
            share = escape / np.maximum(total + kinds, 1)
            prob += c * share[:, None]
            done |= c > 0
            escape = np.where(total > 0, share * kinds, escape)
            at = np.where(at >= 0, up[np.maximum(at, 0)], -1)
        left = (~done * weight).sum(1)
        prob += np.where(done, 0, (escape / np.maximum(left, 1))[:, None])
        out[node] = -np.log2(np.maximum(prob, 1e-12))
    return out


def train_language_id(
    texts: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    sample_bytes: int = 1 << 20,
    max_text: int = 60_000,
    max_langs: int = 512,
) -> ContextTrees | None:
    """Trees from a bounded sample of labelled texts, about ``sample_bytes`` of distinct text for each language.

    Texts are taken whole by a hash of the text, at a rate for each language
    that the size of its distinct texts sets, so that a text counts once however
    often it is repeated.  Texts beyond ``max_text`` code points aren't trained
    on (all texts are scored), nor are languages but the ``max_langs`` with the
    most text, or what goes beyond twice ``sample_bytes`` in order of the hashes.
    Null texts and languages take no part; an empty table, or one without text,
    gives None.
    """
    rows = texts.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= max_text))
    rows = rows.withColumn("h", F.xxhash64("text"))
    once = rows.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("n"))
    sizes = once.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not sizes:
        return None
    darts = 1 << 50
    rates = [(r["lang"], int(min(1.0, sample_bytes / r["n"]) * darts)) for r in sizes]
    rates = texts.sparkSession.createDataFrame(rates, "lang string, rate long")
    taken = rows.join(F.broadcast(rates), "lang").where(F.pmod("h", F.lit(darts)) < F.col("rate"))  # max_langs rows
    samples: dict[str, list[bytes]] = {}
    room = {r["lang"]: 2 * sample_bytes for r in sizes}
    for lang, _, text in sorted(tuple(r) for r in taken.select("lang", "h", "text").distinct().collect()):
        raw = text.encode()
        if len(raw) <= room[lang]:
            room[lang] -= len(raw)
            samples.setdefault(lang, []).append(raw)
    return build({k: v for k, v in samples.items() if any(v)})


PREDICTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
ARROW_PREDICTED = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def identify(texts: list[str | None], trees: ContextTrees | None) -> list[dict]:
    letters = [bool(t) and any(map(str.isalpha, t)) for t in texts]
    out = [{"lang": UNDETERMINED, "score": 0.0} for _ in texts]
    rows = [i for i, ok in enumerate(letters) if ok]
    if trees is None or not rows:
        return out
    bits = trees.lengths([texts[i].encode() for i in rows])
    best = bits.argmin(1)
    gap = np.minimum(bits - bits.min(1, keepdims=True), 1000)
    share = 1 / np.exp2(-gap).sum(1)
    for i, b, s in zip(rows, best.tolist(), share.tolist(), strict=True):
        out[i] = {"lang": trees.langs[b], "score": min(1.0, s)}
    return out


def language_id(docs: DataFrame, trees: ContextTrees | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, the posterior of that language under equal priors.

    Null texts and texts without a letter are `und` with score 0; so is every
    text if nothing was learned.  Ties go to the first language in text order.
    Old columns of the two names are replaced, others kept; repeated rows
    stay; an empty table gives an empty one.  Whole texts of any length; one
    pass without a shuffle; the trees have a bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def compute(texts: list) -> list[pa.Array]:
        return [pa.array(identify(texts, shared.value), ARROW_PREDICTED)]

    out = with_columns(docs, text_col, [T.StructField("__predicted", PREDICTED)], compute)
    return out.withColumns({"lang_pred": F.col("__predicted.lang"), "score": F.col("__predicted.score")}).drop(
        "__predicted"
    )
