"""Prefix trie of conversations by the Euler-tour technique (operator 12).

1. Turns get their place in their conversation, conversations are rebuilt (`rebuilt`), and running sums of a hash of
   place, role and text name every prefix: conversations share a node exactly if they agree there. A node is a group of
   (depth, 124 bits); its smallest conversation and its depth name it in the result.
2. One sorted pass over the nodes, each once under its own name and once under its parent's, puts a parent before its
   children in order. Adjacent rows give the arcs of the Euler tour: a node is entered, its children are toured one after
   the other, and it is left; every arc knows the next one.
3. List ranking by contraction: arcs are ranged by conversation and depth, so that most lie beside their successor; each
   task joins its chains to their heads, and the heads form a shorter list for the next round. A round that joins few
   deals arcs by coin instead, half to their own name and half to their successor's, which joins a quarter of any list.
   The last `LAST` arcs are ranked in one task, and the rounds are unrolled by one join each.
4. Arcs carry their weights (position, childless nodes, savings), so ranks are prefix sums of all three; a node's
   subtree is what lies between its two arcs.

Ranges are bounded in rows, also where one conversation or one node has most of them; of each range, only its border
rows come to the driver. The digest of a node's ending conversations is by its contract one hash over all their ids:
ids are joined to long strings range by range, and these are then hashed in order, in constant memory.

Defined cases: null role or text counts as empty, and turns that tie go by a digest of role and text; rows without a
conversation id belong to none; equal rows are turns of their own; a conversation without any rebuilt turn is a member
of the root and ends there; `%` keeps the sign of negative ids; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scans import salted_join
from .common import ship, stored
from .ordered import masked, ranged, running

SPAN = 5
DEEPEST = 9
RANGE_ROWS = 200_000
ROUND_ROWS = 65_536
LAST = 16_384
JOINED = 1 << 16
_WEIGHTS = ("one", "leaf", "saved")
_KEY = ["depth", "k1", "k2"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _parts(df: DataFrame, rows: int) -> int:
    """Ranges of at most about `rows` rows, and no fewer than cores."""
    return max(-(-df.count() // rows), df.sparkSession.sparkContext.defaultParallelism)


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the one that begins its span."""
    return F.crc32(conv_id.cast("string").cast("binary")) % DEEPEST


def numbered_turns(conversations: DataFrame, rows: int) -> DataFrame:
    """conv_id, i (from 0), digest and bytes of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(digest, 1, 32).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"),
    )
    turns = stored(turns.withColumn("uid", F.monotonically_increasing_id()), "turns")
    placed = running(turns, "conv_id", ["turn", "digest", "uid"], ["one"], _parts(turns, rows))
    return placed.select("conv_id", (F.col("run_one") - 1).alias("i"), "digest", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, bytes) of the rebuilt turns, and all conversations."""
    convs = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conversations")
    own = turns.withColumn("h", shared_turns(F.col("conv_id"))).where("i >= h")
    # Where the span's first conversation has fewer turns to give, own turns move up.
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    given = convs.select("conv_id", F.expr(f"conv_id - conv_id % {SPAN}").alias("base"), shared_turns(F.col("conv_id")).alias("h"))
    short = given.join(bases, "base", "left").select("conv_id", (F.col("h") - F.coalesce("base_n", F.lit(0))).alias("missing"))
    own = salted_join(own, stored(short.where("missing > 0"), "short"), ["conv_id"], how="left")
    own = own.select("conv_id", (F.col("i") + 1 - F.coalesce("missing", F.lit(0))).alias("depth"), "digest", "bytes")

    steps = F.array(*[F.lit(k).cast("long") for k in range(1 - SPAN, SPAN)])
    first = turns.where(f"conv_id % {SPAN} = 0 AND i < {DEEPEST - 1}")
    first = first.withColumn("step", F.explode(steps))
    first = first.select(F.try_add("conv_id", "step").alias("to"), F.col("conv_id").alias("base"), "i", "digest", "bytes")
    first = first.where(f"to - to % {SPAN} = base").where(F.col("i") < shared_turns(F.col("to")))
    first = first.join(convs.select(F.col("conv_id").alias("to")), "to", "left_semi")
    return own.union(first.select("to", (F.col("i") + 1).alias("depth"), "digest", "bytes")), convs.select("conv_id")


def prefixes(turns: DataFrame, convs: DataFrame, rows: int) -> DataFrame:
    """Every conversation at every depth: (conv_id, depth, k1, k2, p1, p2, bytes); p1 and p2 name the prefix before."""
    lanes = [F.conv(F.substring("digest", low, 15), 16, 10).cast("long") for low in (1, 16)]
    named = [masked(F.xxhash64(F.lit(salt), F.col("depth").cast("long"), *lanes)) for salt in (1, 2)]
    turns = stored(
        turns.select("conv_id", F.col("depth").cast("long").alias("depth"), "bytes", named[0].alias("m1"), named[1].alias("m2")), "rebuilt"
    )
    summed = running(turns, "conv_id", ["depth"], ["m1", "m2"], _parts(turns, rows))
    back = lambda k, m: masked(F.col(k) + F.lit(1 << 62) - F.col(m))
    found = summed.select(
        "conv_id", "depth", F.col("run_m1").alias("k1"), F.col("run_m2").alias("k2"),
        back("run_m1", "m1").alias("p1"), back("run_m2", "m2").alias("p2"), "bytes",
    )
    none = [F.lit(0).cast("long").alias(c) for c in ("depth", "k1", "k2", "p1", "p2", "bytes")]
    return stored(found.union(convs.select("conv_id", *none)), "prefixes")


def ends(members: DataFrame, rows: int) -> DataFrame:
    """depth, k1, k2 and the digest of the ids, ascending, of the conversations that end there."""
    last = members.groupBy("conv_id").agg(F.max_by(F.struct(*_KEY), "depth").alias("e"))
    last = stored(last.select("e.*", "conv_id"), "ends")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grouped() -> Iterator[tuple]:
            key, held, size = None, [], 0
            for batch in batches:
                for *this, conv in zip(*(c.to_pylist() for c in batch.columns)):
                    if this != key or size >= JOINED:
                        if held:
                            yield key, held
                        key, held, size = this, [], 0
                    held.append(str(conv))
                    size += len(held[-1]) + 1
            if held:
                yield key, held

        out = []
        for key, held in grouped():
            out.append((*key, int(held[0]), ",".join(held)))
            if len(out) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*_KEY, "conv_id", "ids"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*_KEY, "conv_id", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        for batch in batches:
            for *this, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if this == key:
                    digest.update(b"," + ids.encode())
                else:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = this, hashlib.sha256(ids.encode())
            if len(out) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*_KEY, "ends_sha256"])
                out = []
        if key:
            out.append((*key, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*_KEY, "ends_sha256"])

    names = "depth long, k1 long, k2 long, "
    strings = ranged(last, [*_KEY, "conv_id"], _parts(last, rows)).mapInArrow(joined, names + "conv_id long, ids string")
    strings = strings.repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id")
    return strings.mapInArrow(hashed, names + "ends_sha256 string")


def nodes_of(members: DataFrame, ended: DataFrame) -> DataFrame:
    """One row per node, with an id."""
    nodes = members.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    )
    return stored(nodes.join(ended, _KEY, "left").withColumn("id", F.monotonically_increasing_id()), "nodes")


_FAMILY = (
    "depth long, k1 long, k2 long, tag int, conv_id long, id long, saved long, after long, parent long, parent_conv long, "
    "_part int, _at long"
)


def families(nodes: DataFrame, rows: int) -> DataFrame:
    """Every node under its own name (tag 0) and its parent's (tag 1), with `after`: the first child or the next sibling."""
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    own = nodes.select(*_KEY, F.lit(0).alias("tag"), "conv_id", "id", saved.alias("saved"))
    child = nodes.where("depth > 0").select(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(1).alias("tag"), "conv_id", "id",
        F.lit(0).cast("long").alias("saved"),
    )
    both = own.union(child)
    names = [x.split()[0] for x in _FAMILY.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held = TaskContext.get().partitionId(), 0, None
        parent, parent_conv = -1, 0

        def closed(rows: pa.RecordBatch, following: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
            nonlocal at, parent, parent_conv
            tag, conv, ids = (rows.column(c).to_numpy() for c in ("tag", "conv_id", "id"))
            top = np.maximum.accumulate(np.where(tag == 0, np.arange(len(tag)), -1))
            up = np.where(top >= 0, ids[top], parent)
            up_conv = np.where(top >= 0, conv[top], parent_conv)
            parent, parent_conv = up[-1], up_conv[-1]
            out = pa.RecordBatch.from_arrays(
                [
                    *rows.columns, pa.array(following, mask=~known), pa.array(up, mask=up < 0), pa.array(up_conv, mask=up < 0),
                    pa.array(np.full(len(tag), part, np.int32)), pa.array(at + np.arange(len(tag))),
                ],
                names=names,
            )
            at += len(tag)
            return out

        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = batch.slice(len(batch) - 1)
            if len(batch) == 1:
                continue
            key = [batch.column(c).to_numpy() for c in _KEY]
            tag, ids = batch.column("tag").to_numpy(), batch.column("id").to_numpy()
            known = np.logical_and.reduce([k[1:] == k[:-1] for k in key]) & (tag[1:] == 1)
            yield closed(batch.slice(0, len(batch) - 1), ids[1:], known)
        if held is not None:
            yield closed(held, np.zeros(1, np.int64), np.zeros(1, bool))

    order = [*_KEY, "tag", "conv_id"]
    local = stored(ranged(both, order, _parts(both, rows)).mapInArrow(scan, _FAMILY), "families")
    place = F.struct(*_KEY, "tag", "id")
    borders = local.groupBy("_part").agg(
        F.min_by(place, "_at").alias("first"), F.max_by(F.struct(*_KEY), "_at").alias("last"), F.max("_at").alias("end"),
        F.max_by(F.struct("id", "conv_id"), F.when(F.col("tag") == 0, F.col("_at"))).alias("top"),
    )
    found, top = sorted(borders.collect(), key=lambda r: r["_part"]), (None, None)  # a row per range
    carried = []
    for row, later in zip(found, [*found[1:], None]):
        goes_on = later is not None and tuple(later["first"])[:3] == tuple(row["last"]) and later["first"]["tag"] == 1
        carried.append((row["_part"], row["end"], *top, later["first"]["id"] if goes_on else None))
        top = tuple(row["top"]) if row["top"] else top
    schema = "_of int, _end long, _parent long, _parent_conv long, _after long"
    more = F.broadcast(nodes.sparkSession.createDataFrame(carried, schema))  # a row per range
    return local.join(more, F.col("_part") == F.col("_of")).select(
        *_KEY, "tag", "conv_id", "id", "saved",
        F.coalesce("after", F.when(F.col("_at") == F.col("_end"), F.col("_after"))).alias("after"),
        F.coalesce("parent", "_parent").alias("parent"), F.coalesce("parent_conv", "_parent_conv").alias("parent_conv"),
    )


def arcs_of(family: DataFrame) -> DataFrame:
    """The arcs of the tour (even: a node is entered, odd: left), their successors and weights; -1 follows the last."""
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    childless = F.col("after").isNull()

    def arc(rows, name, following, leaf, saved):
        return rows.select(
            name.alias("arc"), following.alias("next"), "conv_id", "depth", one.alias("one"), leaf.cast("long").alias("leaf"), saved.alias("saved")
        )

    own, child = family.where("tag = 0"), family.where("tag = 1")
    entered = arc(own, enter, F.when(childless, leave).otherwise(F.col("after") * 2), childless, F.col("saved"))
    left = arc(child, leave, F.when(childless, F.col("parent") * 2 + 1).otherwise(F.col("after") * 2), zero, zero)
    end = arc(own.where("depth = 0"), leave, F.lit(-1).cast("long"), zero, zero)
    return entered.union(left).union(end)


def joined_chains(arc: np.ndarray, following: np.ndarray, weights: np.ndarray):
    """Chains of arcs whose successors are here too: head of each arc, weights between, and the chains' ends and sums.

    Returns (head, before, tails): places of the heads, sums of the weights of a chain before each arc, places of the
    last arcs of the chains.
    """
    order = np.argsort(arc)
    at = np.minimum(np.searchsorted(arc[order], following), max(0, len(arc) - 1))
    here = arc[order][at] == following
    head = np.arange(len(arc))
    head[order[at[here]]] = np.flatnonzero(here)
    before = np.where((head != np.arange(len(arc)))[:, None], weights[head], 0)
    while True:
        further = head[head]
        if (further == head).all():
            return head, before, np.flatnonzero(~here)
        before = before + before[head]
        head = further


_ROUND = (
    "arc long, head long, before_one long, before_leaf long, before_saved long, next long, conv_id long, depth long, "
    "one long, leaf long, saved long"
)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if len(b)]
    if not held:
        return
    rows = {c: np.concatenate([b.column(c).to_numpy() for b in held]) for c in held[0].schema.names}
    weights = np.stack([rows[w] for w in _WEIGHTS], axis=1)
    head, before, tails = joined_chains(rows["arc"], rows["next"], weights)
    heads = np.arange(len(head)) == head
    following, sums = np.full(len(head), -2), np.zeros_like(weights)
    following[head[tails]] = rows["next"][tails]
    sums[head[tails]] = before[tails] + weights[tails]
    only = lambda values: pa.array(values, mask=~heads)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(rows["arc"]), pa.array(rows["arc"][head]), *(pa.array(before[:, k]) for k in range(3)), only(following),
            only(rows["conv_id"]), only(rows["depth"]), *(only(sums[:, k]) for k in range(3)),
        ],
        names=[x.split()[0] for x in _ROUND.split(", ")],
    )


def ranks(arcs: DataFrame, round_rows: int = ROUND_ROWS, last: int = LAST) -> DataFrame:
    """arc, and the sums of `one` (its position), `leaf` and `saved` over all arcs before it."""
    rounds, coin, left = [], False, None
    while True:
        count = arcs.count()
        if count <= last:
            dealt = arcs.coalesce(1)
        elif coin:
            side = F.pmod(F.xxhash64("arc", F.lit(len(rounds))), F.lit(2)) == 0
            dealt = arcs.repartition(-(-count // round_rows), F.when(side, F.col("arc")).otherwise(F.col("next")))
        else:
            dealt = arcs.repartitionByRange(-(-count // round_rows), "conv_id", "depth", "arc")
        held = stored(dealt.mapInArrow(_contract, _ROUND), "round")
        rounds.append(held)
        if count <= last:
            break
        arcs = held.where("next IS NOT NULL").select("arc", "next", "conv_id", "depth", *_WEIGHTS)
        left = arcs.count()
        coin = left > 0.7 * count
    solved = None
    for held in reversed(rounds):
        rows = held.select("arc", "head", *[F.col(f"before_{w}").alias(w) for w in _WEIGHTS])
        if solved is not None:
            of_head = solved.select(F.col("arc").alias("head"), *[F.col(w).alias(f"head_{w}") for w in _WEIGHTS])
            rows = rows.join(of_head, "head").select("arc", *[(F.col(w) + F.col(f"head_{w}")).alias(w) for w in _WEIGHTS])
        solved = stored(rows.select("arc", *_WEIGHTS), "ranks")
    return solved


def prefix_trie(conversations: DataFrame, rows: int = RANGE_ROWS, round_rows: int = ROUND_ROWS, last: int = LAST) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship(conversations.sparkSession)
    turns, convs = rebuilt(numbered_turns(conversations, rows))
    members = prefixes(turns, convs, rows)
    nodes = nodes_of(members, ends(members, rows))
    family = stored(families(nodes, rows), "family")
    solved = ranks(arcs_of(family), round_rows, last)

    none = F.lit(None).cast("long")
    fields = ["conv_id", "depth", "n_convs", "parent_conv_id", "n_children", "n_leaves", "saved_tokens"]

    def part(df: DataFrame, name: str, **known) -> DataFrame:
        digest = known.pop("ends_sha256", F.lit(None).cast("string"))
        return df.select(F.col(name).alias("id"), digest.alias("ends_sha256"), *[known.get(f, none).alias(f) for f in fields])

    own = part(nodes, "id", conv_id=F.col("conv_id"), depth=F.col("depth"), n_convs=F.col("n_convs"),
               ends_sha256=F.coalesce("ends_sha256", F.lit(_EMPTY)))
    up = part(family.where("tag = 1"), "id", parent_conv_id=F.col("parent_conv"))
    counted = family.where("tag = 1").groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    down = part(counted, "parent", n_children=F.col("n"))
    toured = solved.groupBy(F.shiftright("arc", 1).alias("id")).agg(
        *[(F.max(w) - F.min(w)).alias(w) for w in ("leaf", "saved")]
    )
    below = part(toured, "id", n_leaves=F.col("leaf"), saved_tokens=F.col("saved"))
    whole = own.union(up).union(down).union(below).groupBy("id").agg(
        F.max("ends_sha256").alias("ends_sha256"), *[F.max(f).alias(f) for f in fields]
    )
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        "saved_tokens", "ends_sha256",
    )
