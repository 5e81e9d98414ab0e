"""Conversation prefix trie: nodes shared by conversations, and subtree totals by centroid decomposition.

1. Turns get their place by one sort over the whole table, so a conversation of any length is spread over tasks.
2. Conversations are rebuilt, and every prefix gets a name: two polynomial sums of turn hashes modulo 2^64, block by block.
3. A node is a prefix name; its id is its smallest member and its depth. Which node a conversation passes at which depth
   is stored (``paths``): with it ancestors are looked up, never walked.
4. Parent edges form a forest of components, first one. In every round each large component is cut at its centroid, the
   deepest node that has half of the component below it: what lies below it in the component is totalled, and the
   total is added along the path from centroid to top. The pieces are the components of the next round, at most half
   as large.
5. A component of bounded size is decomposed the same way within a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_weighted, store
from .textscan import mix

#: A conversation's head comes from the conversation that starts its block of ids.
ID_BLOCK = 100
HEADS = 6
#: Turns of a conversation that one prefix sum runs over.
BLOCK = 4096
#: Nodes of a component that one task decomposes by itself.
COMPONENT = 16_384
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def ordered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, at, unit, n_chars; conversations: conv_id, start, n): a turn's place in its conversation is at - start.

    Ties of a turn number are ordered by their hash.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    unit = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", unit.alias("unit"), F.char_length(text).cast("long").alias("n_chars")
    )
    turns = turns.repartitionByRange("conv_id", "turn", "unit").sortWithinPartitions("conv_id", "turn", "unit")
    turns = store(turns.select("conv_id", "unit", "n_chars", F.monotonically_increasing_id().alias("at")), "turns")
    sizes = sorted(turns.groupBy(F.shiftright("at", 33).alias("task")).count().collect())  # a row for each task of the sort
    begins = np.cumsum([0] + [n for _, n in sizes]).tolist()
    tasks = conversations.sparkSession.createDataFrame([(t, b) for (t, _), b in zip(sizes, begins, strict=False)], "task long, begin long")
    turns = turns.join(F.broadcast(tasks), F.shiftright("at", 33) == F.col("task"))
    turns = turns.select("conv_id", "unit", "n_chars", (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("begin")).alias("at"))
    return turns, store(turns.groupBy("conv_id").agg(F.min("at").alias("start"), F.count("*").alias("n")), "conversations")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, depth, unit, n_chars, length; conversations: conv_id, length): heads replaced by those of the block's first conversation."""
    turns, known = ordered(conversations)
    base = F.col("conv_id") - F.col("conv_id") % ID_BLOCK
    plans = known.withColumn("base", base).join(known.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    plans = plans.withColumn("h", h).withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0))))
    plans = store(plans.select("conv_id", "base", "start", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "plans")
    placed = store(turns.join(plans, "conv_id").withColumn("pos", F.col("at") - F.col("start")).select("conv_id", "base", "pos", "unit", "n_chars", "h", "head", "length"), "placed")
    own = placed.where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head") + 1).alias("depth"), "unit", "n_chars", "length")
    heads = placed.where(f"conv_id = base and pos < {HEADS - 1}").select("base", "pos", "unit", "n_chars")
    heads = heads.join(plans.select("conv_id", "base", "h", "length"), "base").where("pos < h")
    return own.unionByName(heads.select("conv_id", (F.col("pos") + 1).alias("depth"), "unit", "n_chars", "length")), plans.select("conv_id", "length")


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.array([1] + [base] * (n - 1), _U))


def _prefix_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by conversation, block and depth: both sums from the start of the block on, each turn weighted by its depth."""
    steps = [_powers(b, BLOCK) for b in _BASES]
    at, before = None, (_U(0), _U(0))
    for frame in frames:
        if not len(frame):
            continue
        conv, depth = frame["conv_id"].to_numpy(np.int64), frame["depth"].to_numpy(np.int64) - 1
        block = depth // BLOCK
        units = mix(np.frombuffer(b"".join(frame["unit"]), "<u8").reshape(-1, 2).astype(_U))
        new = np.concatenate(([(conv[0], block[0]) != at], (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])))
        first = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
        lifts = {b: [pow(base, int(b) * BLOCK, 1 << 64) for base in _BASES] for b in np.unique(block)}
        out = {}
        for i in (0, 1):
            terms = units[:, i] * steps[i][depth % BLOCK] * np.array([lifts[b][i] for b in block.tolist()], _U)
            sums = np.cumsum(terms, dtype=_U)
            sums -= (sums - terms)[first]  # what stood before the block in this frame
            carried = np.cumsum(new) == 0
            sums[carried] += before[i]
            out[f"k{i}"] = sums
        at, before = (conv[-1], block[-1]), (out["k0"][-1], out["k1"][-1])
        yield frame[["conv_id", "depth", "n_chars", "length"]].assign(**{k: v.view(np.int64) for k, v in out.items()})


def _block_offsets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by conversation and block, with the sums of a full block: the sums of it and all blocks before, for the next one."""
    at, total = None, [0, 0]
    for frame in frames:
        out = []
        for conv, block, k0, k1 in zip(*(frame[c].tolist() for c in ("conv_id", "block", "k0", "k1")), strict=True):
            total = [k0, k1] if conv != at else [total[0] + k0, total[1] + k1]
            at = conv
            wrapped = np.array([t % (1 << 64) for t in total], _U).view(np.int64)
            out.append((conv, block + 1, wrapped[0], wrapped[1]))
        yield pd.DataFrame(out, columns=["conv_id", "block", "o0", "o1"])


def _add_offsets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for i in "01":
            frame[f"k{i}"] = (frame[f"k{i}"].to_numpy(np.int64).view(_U) + frame[f"o{i}"].to_numpy(np.int64).view(_U)).view(np.int64)
        yield frame[["conv_id", "depth", "n_chars", "length", "k0", "k1"]]


def named_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, n_chars, length, and the name (k0, k1) of the conversation's first ``depth`` turns."""
    schema = "conv_id long, depth long, n_chars long, length long, k0 long, k1 long"
    block = F.floor((F.col("depth") - 1) / BLOCK).cast("long")
    turns = turns.withColumn("block", block).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth")
    sums = store(turns.select("conv_id", "depth", "unit", "n_chars", "length").mapInPandas(_prefix_sums, schema), "sums")
    later = sums.where(F.col("depth") > BLOCK)
    if later.isEmpty():
        return sums
    full = sums.where(F.col("depth") % BLOCK == 0).select("conv_id", block.alias("block"), "k0", "k1")
    offsets = full.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInPandas(_block_offsets, "conv_id long, block long, o0 long, o1 long")
    later = later.withColumn("block", block).join(offsets, ["conv_id", "block"]).mapInPandas(_add_offsets, schema)
    return sums.where(F.col("depth") <= BLOCK).unionByName(later)


def roll_up(parent: list[int], values: list[tuple[int, ...]]) -> list[list[int]]:
    """Subtree totals of one component, by recursive cuts at centroids. Parents stand before their children; the top has parent -1."""
    out = [[0] * len(values[0]) for _ in parent]
    size = [0] * len(parent)
    piece = [0] * len(parent)
    pieces, todo = 1, [list(range(len(parent)))]
    while todo:
        nodes = todo.pop()
        top = nodes[0]
        for v in nodes:
            size[v] = 1
        for v in reversed(nodes[1:]):
            size[parent[v]] += size[v]
        centroid = next(v for v in reversed(nodes) if 2 * size[v] >= len(nodes))
        own, total = piece[top], list(values[centroid])
        below: dict[int, list[int]] = {}
        above = []
        for v in nodes:
            if v == centroid:
                piece[v] = -1
            elif v != top and (parent[v] == centroid or piece[parent[v]] != own):
                if parent[v] == centroid:
                    piece[v] = pieces
                    pieces += 1
                    below[piece[v]] = []
                else:
                    piece[v] = piece[parent[v]]
                below[piece[v]].append(v)
                total = [a + b for a, b in zip(total, values[v], strict=True)]
            else:
                above.append(v)
        v = centroid
        while True:
            out[v] = [a + b for a, b in zip(out[v], total, strict=True)]
            if v == top:
                break
            v = parent[v]
        todo += [x for x in (above, *below.values()) if x]
    return out


def _local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by component and depth; components of bounded size, one after the other."""
    columns = ["top_conv", "top_depth", "conv_id", "depth", "parent_conv", "leaf", "saved"]
    rows: list[tuple] = []

    def close() -> list[tuple]:
        at = {(r[2], r[3]): i for i, r in enumerate(rows)}
        parent = [at.get((r[4], r[3] - 1), -1) if i else -1 for i, r in enumerate(rows)]
        totals = roll_up(parent, [(r[5], r[6]) for r in rows])
        return [(r[2], r[3], *t) for r, t in zip(rows, totals, strict=True)]

    for frame in frames:
        out = []
        for row in zip(*(frame[c].tolist() for c in columns), strict=True):
            if rows and row[:2] != rows[0][:2]:
                out += close()
                rows = []
            rows.append(row)
        yield pd.DataFrame(out, columns=["conv_id", "depth", "leaves", "saved"])
    if rows:
        yield pd.DataFrame(close(), columns=["conv_id", "depth", "leaves", "saved"])


def _cut(active: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut each component at its centroid: (nodes of the pieces; conv_id, depth, leaves, saved to add on the paths to the tops)."""
    comp = ["top_conv", "top_depth"]
    deepest = F.max_by(F.struct("conv_id", "depth", "size", "total"), "depth").alias("c")
    cents = active.where("2 * size >= total").groupBy(*comp).agg(deepest)
    cents = store(cents.select(*comp, *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("conv_id", "depth", "size")]), "centroids")
    ways = paths.join(cents.withColumnRenamed("c_conv_id", "conv_id"), "conv_id").where("depth between top_depth and c_depth")
    ways = store(ways.select(*comp, F.col("owner").alias("conv_id"), "depth", "c_depth", "c_size"), "ways")
    children = active.join(cents, comp).where("depth = c_depth + 1 and parent_conv = c_conv_id")
    children = children.select(*comp, F.col("conv_id").alias("owner"), "depth", F.col("size").alias("child_size"))
    members = store(paths.join(children, ["owner", "depth"]).select(*comp, "conv_id", F.col("owner").alias("child_conv"), "child_size"), "members")
    told = active.join(cents, comp).join(members, [*comp, "conv_id"], "left")
    told = told.join(ways.select("conv_id", "depth", F.lit(True).alias("on_way")), ["conv_id", "depth"], "left")
    below = F.col("child_conv").isNotNull() & (F.col("depth") > F.col("c_depth"))
    is_centroid = (F.col("conv_id") == F.col("c_conv_id")) & (F.col("depth") == F.col("c_depth"))
    told = store(told.withColumns({"below": below, "is_centroid": is_centroid}), "told")
    totals = told.where("below or is_centroid").groupBy(*comp).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    added = store(ways.join(totals, comp).select("conv_id", "depth", "leaves", "saved"), "added")
    pieces = told.where("not is_centroid").select(
        "conv_id", "depth", "parent_conv", "leaf", "saved",
        (F.col("size") - F.when(F.coalesce("on_way", F.lit(False)), F.col("c_size")).otherwise(0)).alias("size"),
        F.when(F.col("below"), F.col("child_conv")).otherwise(F.col("top_conv")).alias("top_conv"),
        F.when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
        F.when(F.col("below"), F.col("child_size")).otherwise(F.col("total") - F.col("c_size")).alias("total"),
    )
    return pieces, added


def subtree_totals(nodes: DataFrame, paths: DataFrame, component: int = COMPONENT) -> DataFrame:
    """conv_id, depth, leaves, saved: sums over subtrees. nodes: conv_id, depth, parent_conv, leaf, saved, size, top_conv, top_depth, total."""
    active, ready, parts = nodes, [], []
    while True:
        ready.append(active.where(F.col("total") <= component))
        active = active.where(F.col("total") > component)
        if active.isEmpty():
            break
        active, added = _cut(active, paths)
        parts.append(added)
    small = ready[0]
    for r in ready[1:]:
        small = small.unionByName(r)
    small = small.repartition("top_conv", "top_depth").sortWithinPartitions("top_conv", "top_depth", "depth")
    out = small.mapInPandas(_local, "conv_id long, depth long, leaves long, saved long")
    for p in parts:
        out = out.unionByName(p)
    return out.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by node and conversation: the hash of a node's ids, read as a stream."""
    at, state = None, None
    for frame in frames:
        out = []
        for owner, depth, conv in zip(frame["owner"].tolist(), frame["depth"].tolist(), frame["conv_id"].tolist(), strict=True):
            if (owner, depth) == at:
                state.update(b",%d" % conv)
                continue
            if at:
                out.append((*at, state.hexdigest()))
            at, state = (owner, depth), hashlib.sha256(b"%d" % conv)
        yield pd.DataFrame(out, columns=["conv_id", "depth", "ends_sha256"])
    if at:
        yield pd.DataFrame([(*at, state.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])


def prefix_trie(conversations: DataFrame, component: int = COMPONENT) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are rebuilt (see ``rebuilt``) and ordered by turn, null first, equal turns by a hash of role and text. A
    null role or text is empty. Rows without a conv_id are left out. A repeated row is a turn of its own. Without
    conversations there are no nodes, also no root. Further columns are ignored. Prefixes are told apart by 128 bits.
    """
    spark = conversations.sparkSession
    turns, known = rebuilt(conversations)
    n_convs, root = known.agg(F.count("*"), F.min("conv_id")).first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not n_convs:
        return spark.createDataFrame([], schema)
    name, zero = ["depth", "k0", "k1"], F.lit(0).cast("long")
    first_id = F.lit(root).cast("long")
    steps = store(named_prefixes(turns), "prefixes")
    named = store(steps.groupBy(*name).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("n_chars").alias("n_chars")), "named")
    paths = join_weighted(steps.drop("n_chars"), named.drop("n_chars"), name, "n_convs").select("conv_id", "depth", "length", "owner")
    paths = store(paths.unionByName(known.select("conv_id", zero.alias("depth"), "length", first_id.alias("owner"))), "paths")

    # a conversation owns the nodes from some depth on: a chain, hung up in another conversation's one
    chains = store(paths.where("conv_id = owner").groupBy("conv_id").agg(F.min("depth").alias("begin")), "chains")
    hung = paths.join(chains, "conv_id").where("depth = begin - 1").select("conv_id", F.col("owner").alias("hung_on"))
    chains = store(chains.join(hung, "conv_id", "left"), "hung")
    below = F.greatest(zero, F.col("length") - F.greatest("begin", "depth") + 1)
    sizes = paths.join(chains.select("conv_id", "begin"), "conv_id").groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.sum(below).alias("size"))
    every = named.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "n_chars").unionByName(
        spark.range(1).select(first_id.alias("conv_id"), zero.alias("depth"), F.lit(n_convs).cast("long").alias("n_convs"), zero.alias("n_chars"))
    )
    parent = F.when(F.col("depth") > F.col("begin"), F.col("conv_id")).otherwise(F.col("hung_on"))
    every = store(every.join(chains, "conv_id").withColumn("parent_conv", parent).drop("begin", "hung_on"), "nodes")
    children = every.where("depth > 0").groupBy(F.col("parent_conv").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    at = ["conv_id", "depth"]
    every = every.join(children, at, "left").join(sizes, at).withColumn("n_children", F.coalesce("n_children", zero))
    every = store(every.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_chars")}), "every")
    total = every.where("depth = 0").first()["size"]
    first = every.select(*at, "parent_conv", "leaf", "saved", "size", first_id.alias("top_conv"), zero.alias("top_depth"), F.lit(total).cast("long").alias("total"))
    sums = subtree_totals(first, paths, component)
    ends = paths.where("depth = length").select("owner", "depth", "conv_id").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "conv_id")
    ends = ends.mapInPandas(_digest, "conv_id long, depth long, ends_sha256 string")
    out = every.select(*at, "parent_conv", "n_convs", "n_children").join(sums, at).join(ends, at, "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return out.select(
        *at, F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"),
    )


ORACLE = """
WITH bits AS (SELECT b, list_reduce(list_concat([b], range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) t(b)),
     crc AS (SELECT list(v ORDER BY b) AS t FROM bits),
     orig AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
              FROM conversations WHERE conv_id IS NOT NULL),
     known AS (SELECT DISTINCT conv_id FROM orig),
     heads AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
                      xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                          lambda a, d: xor(a >> 8, t[(xor(a, d) & 255) + 1]))) % 6 AS h FROM known, crc),
     turns AS (SELECT h.conv_id, pos, 0 AS part, role, text FROM heads h JOIN orig o ON o.conv_id = h.base AND pos < h
               UNION ALL SELECT h.conv_id, pos, 1, role, text FROM heads h JOIN orig o ON o.conv_id = h.conv_id AND pos >= h),
     built AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER w AS key, length(text) AS n_chars
               FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
     steps AS (SELECT * FROM built UNION ALL SELECT conv_id, 0, '', 0 FROM known),
     named AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_chars) AS n_chars FROM steps GROUP BY depth, key),
     paths AS (SELECT s.conv_id AS member, s.depth, n.conv_id FROM steps s JOIN named n USING (depth, key)),
     node AS (SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_chars FROM named n LEFT JOIN paths p ON p.member = n.conv_id AND p.depth = n.depth - 1),
     childs AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
     valued AS (SELECT node.conv_id, depth, parent_conv_id, n_convs, coalesce(n, 0) AS n_children, (n IS NULL)::BIGINT AS leaf, (n_convs - 1) * n_chars AS saved
                FROM node LEFT JOIN childs USING (conv_id, depth)),
     sums AS (SELECT p.conv_id, p.depth, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM valued v JOIN paths p ON p.member = v.conv_id AND p.depth <= v.depth GROUP BY ALL),
     last AS (SELECT member, max(depth) AS depth FROM paths GROUP BY member),
     ends AS (SELECT p.conv_id, p.depth, string_agg(p.member::VARCHAR, ',' ORDER BY p.member) AS ids FROM paths p JOIN last USING (member, depth) GROUP BY ALL)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM valued JOIN sums USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)
"""
