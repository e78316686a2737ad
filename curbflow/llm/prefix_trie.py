"""The trie of conversation prefixes, over node tables with minimal perfect hashes.

A prefix is named by a 128-bit digest, two sums of turn hashes times powers of
odd numbers modulo 2 to the 64th.  Such sums split: turns lie in one order by
conversation and turn, cut into partitions wherever that is even, and each
partition sums up on its own; what lies before it in its first conversation is
added afterwards.  So one conversation may have any share of the turns.

Nodes are the distinct digests.  The nodes with the same members form a
vertical run, of which the smallest member and the number of members are a
key; only the runs, two at most for each conversation, enter node tables.  A run
with more than ``limit`` members belongs to the crown.  The others hang below it
as fragments of ``limit`` members at most, which are dealt out to shards.  A
shard hashes its digests minimally and perfectly to slots, checks the digest
in the slot at each lookup, scatters its counts into flat arrays and adds them
up through the parents' slots, deepest first.  What the fragments' tops come
to is then scattered into the crown's table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import looked_up
from .shared_tables import written

#: The two bases of digests, odd numbers, and their inverses modulo 2 to the 64th.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
#: A fragment has at most so many members, more where the crown would exceed CROWN runs otherwise.
MEMBERS, CROWN = 1024, 1 << 20
#: Runs of a shard on average.
SHARD_RUNS = 4096


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base to the exponents, modulo 2 to the 64th."""
    out, square = np.ones(len(exponents), np.uint64), base
    left = exponents.astype(np.int64)
    while (left > 0).any():
        out = np.where(left & 1, out * np.uint64(square), out)
        square, left = square * square % (1 << 64), left >> 1
    return out


class PerfectHash:
    """A minimal perfect hash over distinct digests, in levels; a lookup checks the digest in the slot.

    In each level keys that fall on a place alone take it, the others go on
    to the next level.  A key's slot is the number of taken places before its own.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.levels, taken, rest = [], 0, np.arange(len(high))
        slots = np.empty(len(high), np.int64)
        while len(rest):
            size = 2 * len(rest) + 1
            place = self.places(high[rest], low[rest], len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            upto = np.cumsum(alone) - 1 + taken
            self.levels.append((size, alone, upto))
            fits = alone[place]
            slots[rest[fits]] = upto[place[fits]]
            taken += int(fits.sum())
            rest = rest[~fits]
            if len(self.levels) > 64:
                raise ValueError("a digest occurs twice")
        self.slots = slots
        self.high, self.low = np.empty_like(high), np.empty_like(low)
        self.high[slots], self.low[slots] = high, low

    @staticmethod
    def places(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        x = high ^ (low * np.uint64(2 * level + 1)) ^ np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return ((x ^ (x >> np.uint64(33))) % np.uint64(size)).astype(np.int64)

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Slots of digests, -1 for those that have none."""
        out, open_ = np.full(len(high), -1), np.arange(len(high))
        for level, (size, alone, upto) in enumerate(self.levels):
            place = self.places(high[open_], low[open_], level, size)
            hit = alone[place]
            out[open_[hit]] = upto[place[hit]]
            open_ = open_[~hit]
        ok = out >= 0
        ok[ok] = (self.high[out[ok]] == high[ok]) & (self.low[out[ok]] == low[ok])
        return np.where(ok, out, -1)


def add_up(table: pa.Table) -> pa.Table:
    """A shard's runs with n_leaves, saved (below the run) and parent_id; of a top (is_top) the parent lies elsewhere.

    ``leaves`` and ``below`` are what a run has before its children in the
    shard are added, ``whole`` what its own nodes save.
    """

    def column(name: str) -> np.ndarray:
        return table.column(name).to_numpy()

    h1, h2, up1, up2 = (column(c).view(np.uint64) for c in ("h1", "h2", "up1", "up2"))
    slots = PerfectHash(h1, h2)
    at = slots.slots
    up_of = slots.find(up1, up2)
    up_of[column("top_depth") == 0] = -1

    def scattered(values: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.int64)
        out[at] = values
        return out

    up, depth, ids, leaves, saved, whole = map(scattered, (up_of, *map(column, ("bottom_depth", "conv_id", "leaves", "below", "whole"))))
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        inner = level[up[level] >= 0]
        np.add.at(leaves, up[inner], leaves[inner])
        np.add.at(saved, up[inner], saved[inner] + whole[inner])
    top = up_of < 0
    new = {"n_leaves": pa.array(leaves[at]), "saved": pa.array(saved[at]), "parent_id": pa.array(ids[up_of], mask=top), "is_top": pa.array(top)}
    for name, values in new.items():
        table = table.append_column(name, values)
    return table


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos, digests up to and before the turn (p1, p2, b1, b2), bytes, bytes up to it, check; written once.

    Turns lie in order by conversation, turn (null first), role and text, in
    partitions that cut a conversation where they have to.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    size = F.octet_length("role")  # tells (role, text) pairs with the same joined characters apart
    joined = F.concat("role", F.lit("\x00"), "text")
    laid = laid.select(
        "conv_id", F.xxhash64(size, joined).alias("a1"), F.xxhash64(joined, size).alias("a2"),
        F.substring(F.sha2(joined, 256), 1, 16).alias("check"), F.octet_length("text").cast("long").alias("bytes"),
    )
    names = ["conv_id", "part", "at", "l1", "l2", "m1", "m2", "bytes", "upto", "check"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at0, upto0, sums = TaskContext.get().partitionId(), None, 0, 0, [np.uint64(0)] * 2
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, size = batch.column("conv_id").to_numpy(), batch.column("bytes").to_numpy()
            begin = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            group = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(conv)]))
            goes_on = conv[0] == last
            at = np.arange(len(conv)) - begin[group]
            at[group == 0] += at0 if goes_on else 0
            columns = {}
            for i, base in enumerate(BASES):
                term = batch.column(f"a{i + 1}").to_numpy().view(np.uint64) * powers(base, at)
                total = np.cumsum(term)
                total -= (total - term)[begin][group]
                if goes_on:
                    total[group == 0] += sums[i]
                columns[i] = total, total - term
                sums[i] = total[-1]
            upto = np.cumsum(size)
            upto -= (upto - size)[begin][group]
            if goes_on:
                upto[group == 0] += upto0
            last, at0, upto0 = conv[-1], int(at[-1]) + 1, int(upto[-1])
            longs = [columns[0][0], columns[1][0], columns[0][1], columns[1][1]]
            arrays = [pa.array(conv), pa.array(np.full(len(conv), part, np.int32)), pa.array(at)]
            arrays += [pa.array(x.view(np.int64)) for x in longs] + [pa.array(size), pa.array(upto), batch.column("check")]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "conv_id long, part int, at long, l1 long, l2 long, m1 long, m2 long, bytes long, upto long, check string"
    return with_earlier_parts(written(laid.mapInArrow(run, schema)))


def with_earlier_parts(local: DataFrame) -> DataFrame:
    """Adds to each conversation that goes on in a further partition what it has before; two rows a partition say what."""
    ends = local.groupBy("conv_id", "part").agg(F.max(F.struct("at", "l1", "l2", "upto")).alias("e"))
    several = Window.partitionBy("conv_id")
    ends = ends.withColumn("parts", F.count("*").over(several)).where("parts > 1").select("conv_id", "part", "e.*")

    def carried(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        offset, sums, upto, rows = 0, [0, 0], 0, []
        for r in table.to_pylist():
            rows.append((r["conv_id"], r["part"], offset, *(signed(s) for s in sums), upto))
            for i, base in enumerate(BASES):
                sums[i] = (sums[i] + pow(base, offset, 1 << 64) * r[f"l{i + 1}"]) % (1 << 64)
            offset, upto = offset + r["at"] + 1, upto + r["upto"]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), *[pa.int64()] * 4], strict=True)]
        return pa.Table.from_arrays(columns, names=["conv_id", "part", "offset", "s1", "s2", "before"])

    before = ends.groupBy("conv_id").applyInArrow(carried, "conv_id long, part int, offset long, s1 long, s2 long, before long")
    both = local.join(F.broadcast(written(before)), ["conv_id", "part"], "left")  # two rows for each partition at most
    names = ["conv_id", "pos", "p1", "p2", "b1", "b2", "bytes", "upto", "check"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            def col(name: str) -> np.ndarray:
                return batch.column(name).fill_null(0).to_numpy()

            offset, longs = col("offset"), []
            factor = [powers(b, offset) if offset.any() else np.uint64(1) for b in BASES]
            for kind in "lm":
                for i in (0, 1):
                    value = col(f"{kind}{i + 1}").view(np.uint64) * factor[i] + col(f"s{i + 1}").view(np.uint64)
                    longs.append(pa.array(value.view(np.int64)))
            arrays = [batch.column("conv_id"), pa.array(col("at") + offset), *longs, batch.column("bytes"), pa.array(col("upto") + col("before"))]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column("check")], names=names)

    return both.mapInArrow(run, "conv_id long, pos long, p1 long, p2 long, b1 long, b2 long, bytes long, upto long, check string")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


PATH = "conv_id long, depth long, h1 long, h2 long, up1 long, up2 long, bytes long, upto long, check string, is_end boolean"


def rebuilt_paths(turns: DataFrame, heads: int, source: Column, keep: Column) -> tuple[DataFrame, DataFrame]:
    """(paths, conversations): a row for each turn of each rebuilt conversation, and n_turns of each (0 is a member of the root).

    ``keep`` turns of conversation ``source`` come first, ``heads`` at most,
    then a conversation's own from place ``keep`` on.
    """
    head = F.when(F.col("pos") < heads, F.struct("pos", "p1", "p2", "b1", "b2", "bytes", "upto", "check"))
    known = written(turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(head)).alias("heads")))
    of = known.select(F.col("conv_id").alias("source"), F.col("heads").alias("given"))
    convs = known.withColumns({"source": source, "h": keep}).join(of, "source", "left")
    convs = convs.withColumn("given", F.slice(F.coalesce("given", F.array().cast(known.schema["heads"].dataType)), 1, F.col("h").cast("int")))
    convs = convs.withColumn("k", F.size("given").cast("long"))
    end, cut = F.try_element_at("given", F.lit(-1)), F.when(F.col("h") > 0, F.try_element_at("heads", F.least("h", F.lit(heads)).cast("int")))
    zero = F.lit(0).cast("long")
    info = written(convs.select(
        "conv_id", "h", "k", "given", (F.col("k") + F.greatest(F.col("n") - F.col("h"), zero)).alias("n_turns"),
        *[F.coalesce(end[c], zero).alias(f"g{c}") for c in ("p1", "p2", "upto")],
        *[F.coalesce(cut[c], zero).alias(f"c{c}") for c in ("p1", "p2", "upto")],
    ))
    first = info.select("conv_id", "n_turns", F.posexplode("given").alias("i", "t")).select(
        "conv_id", (F.col("i") + 1).cast("long").alias("depth"), F.col("t.p1").alias("h1"), F.col("t.p2").alias("h2"),
        F.col("t.b1").alias("up1"), F.col("t.b2").alias("up2"), "t.bytes", "t.upto", "t.check", (F.col("i") + 1 == F.col("n_turns")).alias("is_end"),
    )
    own = looked_up(turns, info.drop("given"), "conv_id", "pos").where(F.col("pos") >= F.col("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = [np.array([pow(b, j, 1 << 64) for j in range(heads + 1)], np.uint64) for b in INVERSES]
        for batch in batches:
            c = {n: batch.column(n).to_numpy() for n in batch.schema.names if n != "check"}
            shift, depth, longs = c["h"] - c["k"], c["pos"] - c["h"] + c["k"] + 1, []
            for kind in "pb":
                for i in (0, 1):
                    own = c[f"{kind}{i + 1}"].view(np.uint64) - c[f"cp{i + 1}"].view(np.uint64)
                    longs.append(pa.array((c[f"gp{i + 1}"].view(np.uint64) + own * back[i][shift]).view(np.int64)))
            upto = pa.array(c["gupto"] + c["upto"] - c["cupto"])
            arrays = [batch.column("conv_id"), pa.array(depth), *longs, batch.column("bytes"), upto, batch.column("check"), pa.array(depth == c["n_turns"])]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in PATH.split(", ")])

    later = own.select("conv_id", "pos", "p1", "p2", "b1", "b2", "bytes", "upto", "check", "h", "k", "n_turns", "gp1", "gp2", "gupto", "cp1", "cp2", "cupto")
    return written(first.unionByName(later.mapInArrow(run, PATH))), info.select("conv_id", "n_turns")


def id_lists(ends: DataFrame) -> DataFrame:
    """h1, h2, ends_sha256: the SHA-256 of each node's ids, ascending, joined by commas.

    Ids are laid in order and joined to pieces of text where they lie, so that
    what meets for a node are its pieces, streamed through the hash.
    """
    order = ["h1", "h2", "conv_id"]
    laid = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["h1", "h2", "first", "ids"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, ids = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            starts = np.r_[0, cuts]
            text = list(map(str, ids.tolist()))
            joined = [",".join(text[a:b]) for a, b in zip(starts.tolist(), np.r_[cuts, len(ids)].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h1[starts]), pa.array(h2[starts]), pa.array(ids[starts]), pa.array(joined)], names=names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for h1, h2, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h1, h2) == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (h1, h2), hashlib.sha256(ids.encode())
            yield as_batch(done)
        if key is not None:
            yield as_batch([(*key, digest.hexdigest())])

    def as_batch(done: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "ends_sha256"])

    cut = laid.mapInArrow(pieces, "h1 long, h2 long, first long, ids string")
    return cut.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "first").mapInArrow(hashed, "h1 long, h2 long, ends_sha256 string")


def trie_nodes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct digest, and the root's; all of a node's members must agree on parent, turn and bytes."""
    agree = F.lit(True)
    for c in ("depth", "up1", "up2", "bytes", "upto", "check"):
        agree &= F.max(c) == F.min(c)
    depth = F.when(agree, F.min("depth")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long"))
    nodes = paths.groupBy("h1", "h2").agg(
        depth.alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("up1", "up2", "bytes", "upto")]
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    return nodes.unionByName(root.withColumns({c: zero for c in ("h1", "h2", "depth", "up1", "up2", "bytes", "upto")}))


def run_totals(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """For each run, named by conv_id and n_convs: depths and bytes of its ends, children, leaves, savings below it, parent's conv_id."""
    bottom = F.max(F.struct("depth", "h1", "h2", "upto"))
    top = F.min(F.struct("depth", "h1", "h2", "up1", "up2", (F.col("upto") - F.col("bytes")).alias("before")))
    runs = nodes.groupBy("conv_id", "n_convs").agg(bottom.alias("b"), top.alias("t")).select(
        "conv_id", "n_convs", "b.h1", "b.h2", F.col("b.depth").alias("bottom_depth"), F.col("b.upto").alias("bottom_upto"),
        F.col("t.depth").alias("top_depth"), F.col("t.h1").alias("t1"), F.col("t.h2").alias("t2"), "t.up1", "t.up2",
        ((F.col("n_convs") - 1) * (F.col("b.upto") - F.col("t.before"))).alias("whole"),
    )
    children = runs.where("top_depth > 0").groupBy(F.col("up1").alias("h1"), F.col("up2").alias("h2")).agg(F.count("*").alias("n_children"))
    runs = runs.join(children, ["h1", "h2"], "left").fillna(0, ["n_children"])
    runs = written(runs.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "below": F.lit(0).cast("long")}))
    n_rows, n_runs = paths.count(), runs.count()
    limit = max(MEMBERS, -(-n_rows // CROWN))
    # every crown node but the root has more than `limit` rows of paths, so there are CROWN of them at most
    in_crown = (F.col("n_convs") > limit) | (F.col("top_depth") == 0)
    crown = written(runs.where(in_crown))
    bottoms = F.broadcast(crown.select(F.col("h1").alias("up1"), F.col("h2").alias("up2")))
    tops = F.broadcast(crown.select(F.col("t1").alias("h1"), F.col("t2").alias("h2")))
    border = paths.join(bottoms, ["up1", "up2"], "left_semi").join(tops, ["h1", "h2"], "left_anti")
    shards = max(1, -(-n_runs // SHARD_RUNS))
    dealt = border.select("conv_id", F.pmod(F.xxhash64("h1", "h2"), F.lit(shards)).alias("shard"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema.fields)
    schema += ", n_leaves long, saved long, parent_id long, is_top boolean"

    def of_shard(table: pa.Table) -> pa.Table:
        return add_up(table.drop_columns(["shard"]))

    low = written(runs.where(~in_crown).join(dealt, "conv_id").groupBy("shard").applyInArrow(of_shard, schema))
    hung = low.where("is_top").groupBy(F.col("up1").alias("h1"), F.col("up2").alias("h2")).agg(
        F.sum("n_leaves").alias("more_leaves"), F.sum(F.col("saved") + F.col("whole")).alias("more_saved")
    )
    zero = F.lit(0).cast("long")
    more = crown.join(hung, ["h1", "h2"], "left").withColumns(
        {"leaves": F.col("leaves") + F.coalesce("more_leaves", zero), "below": F.coalesce("more_saved", zero)}
    )
    high = written(more.select(*runs.columns, zero.alias("shard")).groupBy("shard").applyInArrow(of_shard, schema))
    above = F.broadcast(crown.select(F.col("h1").alias("up1"), F.col("h2").alias("up2"), F.col("conv_id").alias("above")))
    linked = low.join(above, ["up1", "up2"], "left").withColumn("parent_id", F.coalesce("parent_id", "above"))
    kept = ["conv_id", "n_convs", "bottom_depth", "bottom_upto", "top_depth", "n_children", "n_leaves", "saved", "parent_id"]
    return linked.select(*kept).unionByName(high.select(*kept))


def prefix_trie(turns: DataFrame, heads: int, source: Column, keep: Column) -> DataFrame:
    """The nodes of the trie of rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.  ``turns`` has conv_id, turn, role
    and text; ``source`` and ``keep`` are columns over conv_id: the first
    ``keep`` turns (``heads`` at most) of conversation ``source`` replace as many
    of a conversation's own.

    Rows without a conv_id belong to no conversation.  Null roles and texts
    count as empty; a null turn comes first; ties in turn go by role, then
    text; repeated rows are turns of their own.  Other columns are not looked at.
    A conversation of which nothing is left ends at the root, which has depth 0,
    no parent and no text.  An empty table has no nodes.
    """
    paths, convs = rebuilt_paths(ordered_turns(turns), heads, source, keep)
    nodes = written(trie_nodes(paths, convs))
    totals = run_totals(nodes, paths)
    zero = F.lit(0).cast("long")
    ends = paths.where("is_end").select("h1", "h2", "conv_id").unionByName(
        convs.where("n_turns = 0").select(zero.alias("h1"), zero.alias("h2"), "conv_id")
    )
    is_bottom = F.col("depth") == F.col("bottom_depth")
    parent = F.when(F.col("depth") == F.col("top_depth"), F.col("parent_id")).otherwise(F.col("conv_id"))
    own = (F.col("n_convs") - 1) * (F.col("bottom_upto") - F.col("upto") + F.col("bytes"))
    whole = nodes.join(totals, ["conv_id", "n_convs"]).join(id_lists(ends), ["h1", "h2"], "left")
    return whole.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, parent).alias("parent_conv_id"),
        "n_convs",
        F.when(is_bottom, F.col("n_children")).otherwise(1).alias("n_children"),
        "n_leaves",
        (F.col("saved") + own).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
