"""Near-duplicate documents by HyperMinHash.

1. Each text becomes its set of hashed word shingles.  Equal sets share a key
   and are one node from here on, however many copies there are.
2. A node's sketch has one register for each of 128 buckets: the number of
   leading zeros of the bucket's smallest hash, and ten mantissa bits after
   it, in 16 bits.  Empty buckets borrow the register of another bucket in an
   order that depends on the bucket alone.
3. Bands of five compressed registers are hashed; nodes with an equal band
   meet.  Inside such a bucket nodes are compared with the bucket's leaders by
   the collision-corrected Jaccard estimate: a node joins the leaders that may
   have a common neighbour with it (one of those that are connected already),
   and leads itself if none is close.  That costs no pairs of members, and two
   similar members always meet a common leader.  A large bucket is dealt into
   parts, whose leaders meet afterwards.
4. Connected leaders and members form candidate clusters.  In each cluster the
   full sets are intersected exactly, in blocks of about BLOCK nodes.  Blocks of
   a larger cluster share some hubs, which connect near-copies; only nodes that
   stay outside the cluster's largest component meet all its blocks.  Links that
   span what is linked are returned.
5. The links' connected components are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, looked_up, slices
from .components import connected_components
from .shared_tables import forget, written

REGISTERS = 128
BUCKET_BITS = 7
MANTISSA = 10
BANDS = 25
BAND_ROWS = 5
#: A node leads a bucket unless a leader's estimate reaches CLOSE; it joins leaders from REACHABLE on.
#: Two sets with distance 0.15 or less can differ by so much in their distance to a leader, and
#: the estimate's standard error is at most 0.044.
CLOSE, REACHABLE = 0.75, 0.45
#: The same between leaders of different parts of a bucket, whose followers may be similar.
LEADERS_REACHABLE = 0.2
#: Nodes of a part of a bucket.
PART = 2048
#: Nodes of a cluster that are intersected as one matrix, and nodes of a larger cluster that all its blocks hold.
BLOCK, HUBS = 256, 64
#: Bits of the filter through which texts pass before they meet the wanted documents: at most 2 ** 25 / 64 rows of 16 bytes.
FILTER_BITS = 25
#: A worker forgets the word hashes that it knows beyond this many.
KNOWN_LIMIT = 300_000

_probe = np.random.default_rng(11).integers(0, REGISTERS, (48, REGISTERS))
_known: dict[bytes, int] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words, the whole sequence is one."""
    split = [t.encode().lower().split() if t else [] for t in texts]
    if len(_known) > KNOWN_LIMIT:
        _known.clear()
    for w in set().union(*split).difference(_known):
        _known[w] = xxhash.xxh3_64_intdigest(w)
    out = []
    for words in split:
        h = mixed(np.fromiter(map(_known.__getitem__, words), np.uint64, len(words)))
        n = min(size, len(h))
        acc = np.zeros(max(0, len(h) - n + 1) if n else 0, np.uint64)
        for k in range(n):
            acc = mixed(acc * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(acc)] + np.uint64(n))
        out.append(np.unique(acc))
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set of hashes (not empty)."""
    low = np.uint64(64 - BUCKET_BITS)
    starts = np.arange(REGISTERS, dtype=np.uint64) << low
    at = np.searchsorted(hashes, starts)
    first = hashes[np.minimum(at, len(hashes) - 1)]
    full = (at < len(hashes)) & ((first >> low) == (starts >> low))
    rest = (first & np.uint64((1 << (64 - BUCKET_BITS)) - 1)).astype(np.float64)
    part, exponent = np.frexp(np.maximum(rest, 1.0))
    zeros = 64 - BUCKET_BITS - np.minimum(exponent, 64 - BUCKET_BITS)
    regs = (zeros << MANTISSA | ((part - 0.5) * (2 << MANTISSA)).astype(np.int64)).astype(np.uint16)
    if not full.all():
        lent = full.copy()
        for probe in _probe:
            take = ~lent & full[probe]
            regs[take] = regs[probe[take]]
            lent |= take
            if lent.all():
                break
        regs[~lent] = regs[np.flatnonzero(full)[0]]
    return regs


def estimates(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Jaccard estimates of one sketch against rows of others, less the expected accidental agreement."""
    accident = 0.7 / (1 << MANTISSA)
    return ((others == sketch).mean(1) - accident) / (1 - accident)


SKETCHED = "doc_id long, mark long, n_shingles long, node binary, sketch binary"


def sketched(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, mark (the text's hash), n_shingles, node (a 128-bit key of the set; null if empty) and sketch of each row."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1).to_pylist(), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "mark", "n_shingles", "node", "sketch"],
                )
        _known.clear()
        give_back()

    return rows.mapInArrow(run, SKETCHED)


def bands(nodes: DataFrame) -> DataFrame:
    """(bucket, node): the hashes of each node's bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.random.default_rng(5).integers(1, 1 << 62, (BANDS, BAND_ROWS)).astype(np.uint64) | np.uint64(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            used = regs[:, : BANDS * BAND_ROWS].reshape(len(regs), BANDS, BAND_ROWS).astype(np.uint64)
            keys = mixed((mixed(used + factors) * factors).sum(2, dtype=np.uint64) + factors[:, 0])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.ravel().view(np.int64)),
                    batch.column("node").take(pa.array(np.repeat(np.arange(len(regs)), BANDS))),
                ],
                names=["bucket", "node"],
            )

    return nodes.select("node", "sketch").mapInArrow(run, "bucket long, node binary")


def leader_edges(rows: DataFrame, reachable: float) -> DataFrame:
    """(bucket, a, b) of rows (bucket, parts, part, node, sketch), part by part.

    a and b are an edge between a node and a leader of its part that may share a
    neighbour with it; in buckets of several parts also (bucket, leader, null).
    """
    ordered = rows.select("bucket", "part", "parts", "node", "sketch").repartition("bucket", "part")
    # a part's rows lie together and in order, and are read one by one
    ordered = ordered.sortWithinPartitions("bucket", "part", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, names, leaders, n = None, [], np.empty((16, REGISTERS), np.uint16), 0
        group = np.empty(16, np.int64)  # of each leader: leaders that the edges so far connect share one
        for batch in batches:
            buckets, a, b = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("bucket", "part", "parts", "node", "sketch"))
            for bucket, part, parts, node, sketch in zip(*columns, strict=True):
                if (bucket, part) != place:
                    place, names, n = (bucket, part), [], 0
                regs = np.frombuffer(sketch, np.uint16)
                close = False
                if n:
                    est = estimates(regs, leaders[:n])
                    near = np.flatnonzero(est >= reachable)
                    close = bool(len(near)) and est.max() >= CLOSE
                    groups, at = np.unique(group[near], return_index=True)
                    a += [node] * len(at)
                    b += [names[i] for i in near[at].tolist()]
                    buckets += [bucket] * len(at)
                    group[:n][np.isin(group[:n], groups)] = groups[0] if len(groups) else -1
                if not close:
                    if n == len(leaders):
                        leaders = np.vstack([leaders, np.empty_like(leaders)])
                        group = np.r_[group, np.empty_like(group)]
                    leaders[n] = regs
                    group[n] = groups[0] if n and len(groups) else n
                    names.append(node)
                    n += 1
                    if parts > 1:
                        buckets.append(bucket)
                        a.append(node)
                        b.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["bucket", "a", "b"]
            )

    return ordered.mapInArrow(run, "bucket long, a binary, b binary")


def candidate_edges(nodes: DataFrame, slack: float = 0.0) -> DataFrame:
    """(a, b): edges that connect each node of a bucket with the leaders that may share a neighbour with it.

    A bucket of more than PART nodes is dealt into parts; the parts' leaders meet
    afterwards.  Two similar nodes of different parts have leaders that are less
    alike than nodes and leaders are, by the distance of one more step.
    """
    band = bands(nodes)
    # nodes are distinct, so a bucket of one row holds nothing that meets
    met = written(band.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    sketches = nodes.select("node", "sketch")
    # a node is in BANDS buckets once each, so the largest bucket has less than one in BANDS of these rows
    rows = band.join(met, "bucket").join(sketches, "node")
    parts = F.ceil(F.col("n") / PART).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    first = written(leader_edges(rows, REACHABLE - slack))
    leaders = first.where("b is null").select("bucket", F.col("a").alias("node")).join(sketches, "node")
    second = leader_edges(leaders.withColumns({"parts": F.lit(1), "part": F.lit(0)}), LEADERS_REACHABLE - slack)
    found = first.where("b is not null").select("a", "b").unionByName(second.select("a", "b"))
    # a node's leaders (a few of each of its buckets) are connected by way of their smallest
    stars = found.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("leaders"))
    pairs = F.transform("leaders", lambda x, i: F.struct(F.when(i == 0, F.col("a")).otherwise(x).alias("a"), F.col("leaders")[0].alias("b")))
    edges = written(stars.select(F.inline(pairs)).distinct())
    forget(first, met)
    return edges


def linked_in(sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Links (place, smallest place linked with it) that span all pairs with 100 * I >= threshold * U."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    run = np.cumsum(new) - 1
    many = np.bincount(run)[run] > 1  # a shingle of one set joins nothing
    owner, run = owner[many], run[many]
    both = np.zeros((n, n), np.float32)
    if len(run):
        column = np.cumsum(np.r_[True, run[1:] != run[:-1]]) - 1
        for low in range(0, column[-1] + 1, 8192):
            a, b = np.searchsorted(column, (low, low + 8192))
            held = np.zeros((n, min(8192, column[-1] + 1 - low)), np.float32)
            held[owner[a:b], column[a:b] - low] = 1
            both += held @ held.T
    common = both.astype(np.int64)
    ok = 100 * common >= threshold * (sizes[:, None] + sizes[None, :] - common)
    links, seen = [], np.zeros(n, bool)
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        todo = [root]
        while todo:
            near = np.flatnonzero(ok[todo.pop()] & ~seen)
            seen[near] = True
            links += [(int(i), root) for i in near]
            todo += near.tolist()
    return links


def links_in_groups(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b) links among the sets of each group of rows (cluster, i, j, node, hashes), enough to span them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, sets = None, [], []
        found: list[tuple[bytes, bytes]] = []

        def settle() -> None:
            if len(sets) > 1:
                found.extend((names[i], names[j]) for i, j in linked_in(sets, threshold))

        def links() -> pa.RecordBatch:
            out = [pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)]
            found.clear()
            return pa.RecordBatch.from_arrays(out, names=["a", "b"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("cluster", "i", "j", "node", "hashes"))
            for cluster, i, j, node, hashes in zip(*columns, strict=True):
                if (cluster, i, j) != key:
                    settle()
                    key, names, sets = (cluster, i, j), [], []
                if not names or names[-1] != node:
                    names.append(node)
                    sets.append(np.frombuffer(hashes, np.uint64))
            yield links()
        settle()
        yield links()

    placed = rows.select("cluster", "i", "j", "node", "hashes").repartition("cluster", "i", "j")
    return placed.sortWithinPartitions("cluster", "i", "j", "node").mapInArrow(run, "a binary, b binary").distinct()


def blocks_of(count: Column, node: Column, size: int) -> tuple[Column, Column]:
    """The number of blocks of about ``size`` for so many nodes, and a node's block."""
    blocks = F.greatest(F.ceil(count / size).cast("long"), F.lit(1).cast("long"))
    return blocks, F.pmod(F.xxhash64(node), blocks)


def verified_links(members: DataFrame, threshold: int) -> DataFrame:
    """(a, b) links of members (cluster, node, hashes) that connect what is linked.

    First each block of a cluster is compared in itself and with the cluster's
    hubs, some HUBS of its nodes, which connects a cluster of near-copies at a
    cost in proportion to its size.  What that leaves outside a cluster's largest
    component is then compared with all nodes of the cluster, block by block.
    """
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    placed = looked_up(members, size, "cluster", "node", size)
    blocks, own = blocks_of(F.col("n"), F.col("node"), BLOCK)
    # about HUBS of the nodes of a cluster of more than one block are in each of its blocks
    hub = (blocks > 1) & (F.pmod(F.xxhash64(F.lit(1), "node"), F.greatest(F.floor(F.col("n") / HUBS), F.lit(1))) == 0)
    everywhere = F.sequence(F.lit(0).cast("long"), blocks - 1)
    spread = placed.withColumn("i", F.explode(F.when(hub, everywhere).otherwise(F.array(own)))).withColumn("j", F.lit(0).cast("long"))
    first = written(links_in_groups(spread, threshold))
    labels = connected_components(first)
    large = placed.where(F.col("n") > BLOCK).select("cluster", "node", "n")
    state = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = state.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    main = written(
        parts.groupBy("cluster").agg(F.max(F.struct("m", "label")).alias("main"), F.first("n").alias("n")).where(F.col("main.m") < F.col("n"))
    )
    if main.isEmpty():
        return first
    main = main.select("cluster", F.col("main.label").alias("main"), (F.col("n") - F.col("main.m")).alias("rest"))
    todo = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    todo = looked_up(todo, size, "cluster", "node", size)
    todo = looked_up(todo, main, "cluster", "node", size).where("main is not null")
    n_rest, at_rest = blocks_of(F.col("rest"), F.col("node"), BLOCK // 2)
    _, at = blocks_of(F.col("n"), F.col("node"), BLOCK // 2)
    left = todo.where(F.col("label") != F.col("main")).withColumn("i", at_rest)
    n_all, _ = blocks_of(F.col("n"), F.col("node"), BLOCK // 2)
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), n_all - 1)))
    right = todo.withColumn("j", at).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n_rest - 1)))
    columns = ["cluster", "i", "j", "node", "hashes"]
    return first.unionByName(links_in_groups(left.select(*columns).unionByName(right.select(*columns)), threshold))


def perhaps_wanted(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in wanted, and some more, without a shuffle of rows.

    The hashes of wanted's keys set bits in a table of a fixed size, 64 to a row,
    which is broadcast.  With many more keys than bits all rows pass: it saves
    work before an exact join and decides nothing.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS))
    word, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    one = wanted.select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
    words = one.groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    met = rows.withColumn("__word", word).join(F.broadcast(words), "__word")
    return met.where(F.getbit("__bits", bit) == 1).select(*rows.columns)


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, cluster, hashes) of wanted (node, cluster, doc_id), from the texts of those documents."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = perhaps_wanted(rows, wanted, "doc_id").join(wanted, "doc_id").select("node", "cluster", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                sets = [s.tobytes() for s in shingle_sets(part.column(2).to_pylist(), size)]
                nodes = [xxhash.xxh3_128_digest(s) if s else None for s in sets]
                # rows that repeat an id with another text are not the node's
                keep = pa.array([a == b for a, b in zip(nodes, part.column(0).to_pylist(), strict=True)])
                out = pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sets, pa.binary())], names=["node", "cluster", "hashes"]
                )
                yield out.filter(keep)
        _known.clear()
        give_back()

    return rows.mapInArrow(run, "node binary, cluster binary, hashes binary").dropDuplicates(["node"])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 85
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and mark (Spark's hash of the text), one row for each row of docs.

    Documents whose shingle sets have 100 * intersection >= threshold * union
    are linked; component_id is the smallest doc_id that links reach, and kept
    tells whether it is the row's own.  Texts that are null or without words
    have no shingles and link with nothing.  A row with a null id takes no part
    in links and is kept, with a null component.  Rows that repeat an id and
    text have the same result; rows that repeat an id with other texts each go
    with their own text, and id and mark tell them apart.  Other columns are not
    looked at.  Texts of any length count whole; an empty table gives an empty
    one.
    """
    base = written(sketched(docs, id_col, text_col, shingle))
    nodes = (
        base.where("doc_id is not null and node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("least_id"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("n"))
    )
    nodes = written(nodes)
    # a lower threshold lets linked nodes differ by more in their distance to a leader
    edges = candidate_edges(nodes, max(0, 85 - threshold) / 100)
    clusters = connected_components(edges).withColumnRenamed("label", "cluster")
    wanted = written(clusters.join(nodes.select("node", F.col("least_id").alias("doc_id")), "node"))
    sets = written(full_sets(docs, wanted, id_col, text_col, shingle))
    links = connected_components(written(verified_links(sets, threshold)))
    forget(edges, wanted, sets)
    least = nodes.select("node", "least_id", "n")
    reached = links.join(least, "node")
    of_label = reached.groupBy("label").agg(F.min("least_id").alias("component_id"))
    linked = looked_up(reached, of_label, "label", "node").select("node", "component_id")
    result = written(
        least.join(linked, "node", "left").select("node", F.coalesce("component_id", "least_id").alias("component_id"), "n")
    )
    out = looked_up(
        base.select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")),
        result.select("node", "component_id"),
        "node",
        "doc_id",
        result.select("node", "n"),
    )
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "mark")
