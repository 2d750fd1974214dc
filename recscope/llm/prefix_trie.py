"""Conversation prefix trie: conversations that begin with the same turns share nodes.

A turn is (role, text); a node is a sequence of first turns that some conversation has. The steps:

1. ``numbered``: turns in order, by ranges of (conversation, order), so that one long conversation is spread over tasks. A turn goes on as the
   SHA-256 of its role and text, its words and its place: texts are not shuffled.
2. ``fingerprinted``: polynomial rolling fingerprints of all prefixes, two sums of turn times base ** place modulo primes below 2 ** 31, by numpy scans over blocks of
   ``BLOCK`` turns; the sums of a conversation's earlier blocks are added.
3. ``verified``: equal fingerprints make a candidate group, whose representative is its smallest conversation. Members' turns are held against
   the representative's, depth by depth: a group where all agree needs no more, as the same holds at every depth before. A member that differs somewhere carries the places and
   turns where it does as ``split`` from there on, so collisions end in groups of their own.
4. ``nodes``: rows are merged by key with partial sums. Rollups need no walk from parent to parent: a node counts for its representative's row,
   and a subtree's sum is that of the rows in the node, each with what follows in its conversation.

No conversation, node or set of members is gathered in one task: blocks bound a conversation's rows, sums are made before the
shuffle, parents of over a thousandth of all nodes (a thousand at most) are broadcast, and member lists are digested from pieces of ``PIECE`` ids
that stream through a task in order.

Null roles and texts are empty. Turns are in order of ``turn``, null first; equal numbers go by role, then by the SHA-256 of role and text; repeated
rows are turns of their own. Rows without a conversation id are left out. A text of any length is one turn. Extra columns are not read. An empty table has no node, as no conversation
would be a member of the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recscope.llm.common import fold, looked_up, stored, text_or_empty

#: Turns of a block; ids of a piece of a list of members.
BLOCK, PIECE = 4096, 50_000
#: Moduli and bases of the fingerprints.
MODULI = ((2_147_483_647, 1_402_946_993), (2_147_483_629, 748_932_641))
#: The turns that a conversation can borrow; every conversation whose number this divides lends them.
BORROWED, LENDER = 3, 20
WORD = r"[^\x20\x09-\x0D]+"
_TURN = ["g0", "g1", "g2", "g3"]
_KEY = ["depth", "p0", "p1", "split"]


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, g0 to g3, words): turns with their digests as four numbers."""
    role, text = text_or_empty(F.col("role")), text_or_empty(F.col("text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), digest.alias("digest"), F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("words"))
    # The digest's four parts of 64 bits, as signed numbers.
    part = lambda k: F.conv(F.substring("digest", 16 * k + 1, 16), 16, -10).cast("long")
    return rows.select("conv_id", "turn", "role", *[part(k).alias(f"g{k}") for k in range(4)], "words")


def _in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``at``: the number of a row among the partition's rows of its conversation, from 1."""
    last, n = None, 0
    for batch in batches:
        conv = batch.column(batch.schema.get_field_index("conv_id")).to_numpy()
        if not len(conv):
            continue
        new = np.append(True, conv[1:] != conv[:-1])
        new[0] = conv[0] != last
        row = np.arange(len(conv))
        begin = np.maximum.accumulate(np.where(new, row, -1))
        at = row - begin + 1
        at[begin < 0] = n + row[begin < 0] + 1
        last, n = conv[-1], int(at[-1])
        yield batch.append_column("at", pa.array(at))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, g0 to g3, words): turns by place in their conversation, from 1; a stored table."""
    order = ["conv_id", "turn", "role", *_TURN]
    ranged = _turns(conversations).repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "role")
    fields = "conv_id long, g0 long, g1 long, g2 long, g3 long, words int"
    rows = stored(ranged.select("conv_id", *_TURN, "words").mapInArrow(_in_place, f"{fields}, at long").withColumn("part", F.spark_partition_id()), "turns")
    counts = rows.groupBy("conv_id", "part").agg(F.max("at").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Only the conversation that a partition begins with can have rows in an earlier one.
    carried = counts.withColumn("before", F.sum("n").over(before)).where("before > 0").select("conv_id", "part", "before")
    joined = rows.join(F.broadcast(carried), ["conv_id", "part"], "left")
    return joined.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("k"), *_TURN, "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, g0 to g3, words), (conv_id, size)): each conversation c begins with the first h turns of c - c % 20, then has its own after the first h.

    h is crc32(c) % 4; the remainder has the sign of c; all turns are borrowed where there are fewer, none where that conversation is absent. Conversations left without a turn have size 0.
    """
    turns = stored(turns, "numbered")
    sizes = turns.groupBy("conv_id").agg(F.max("k").alias("own"))
    heads = turns.where(F.col("k") <= BORROWED).where(F.col("conv_id") % LENDER == 0)
    lent = heads.groupBy(F.col("conv_id").alias("lender")).agg(F.max("k").alias("has"))
    convs = sizes.withColumn("lender", F.col("conv_id") - F.col("conv_id") % LENDER).withColumn("h", fold(F.col("conv_id"), 4))
    convs = convs.join(lent, "lender", "left").withColumn("borrowed", F.least("h", F.coalesce("has", F.lit(0))))
    convs = stored(convs.withColumn("size", F.col("borrowed") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).select("conv_id", "lender", "h", "borrowed", "own", "size"), "conversations")
    borrowed = convs.join(heads.withColumnRenamed("conv_id", "lender"), "lender").where("k <= h").select("conv_id", F.col("k").alias("depth"), *_TURN, "words")
    block = F.call_function("div", F.col("k"), F.lit(BLOCK))
    by_block = convs.select("conv_id", "h", "borrowed", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("own"), F.lit(BLOCK)))).alias("block"))
    own = turns.withColumn("block", block).join(by_block, ["conv_id", "block"]).where("k > h").select("conv_id", (F.col("k") - F.col("h") + F.col("borrowed")).alias("depth"), *_TURN, "words")
    return borrowed.unionByName(own), convs.select("conv_id", "size")


def _powers(base: int, at: np.ndarray, modulus: int) -> np.ndarray:
    """base ** at modulo a number below 2 ** 31."""
    out, square, left = np.ones(len(at), np.uint64), np.uint64(base), at.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1) > 0, out * square % np.uint64(modulus), out)
        square = square * square % np.uint64(modulus)
        left >>= np.uint64(1)
    return out


def _scanned(batches: Iterator[pa.RecordBatch], moduli=MODULI) -> Iterator[pa.RecordBatch]:
    """Add sums of turn times base ** depth, from the beginning of the row's block, and up to the row before. Rows are in order."""
    last, carry = None, [0] * len(moduli)
    for batch in batches:
        if not batch.num_rows:
            continue
        of = {c: batch.column(c).to_numpy() for c in ("conv_id", "block", "depth", "g0")}
        key = np.stack([of["conv_id"], of["block"]])
        new = np.append(False, (key[:, 1:] != key[:, :-1]).any(axis=0))
        new[0] = last is None or (key[:, 0] != last).any()
        begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        for j, (modulus, base) in enumerate(moduli):
            m = np.uint64(modulus)
            term = (of["g0"].view(np.uint64) >> np.uint64(32 * j) & np.uint64(0xFFFFFFFF)) % m * _powers(base, of["depth"], modulus) % m
            upto = np.cumsum(term)  # terms are below 2 ** 31, a batch has fewer than 2 ** 32 rows
            offset = np.where(begin > 0, upto[np.maximum(begin - 1, 0)], np.uint64(0))
            found = np.where(begin < 0, upto + np.uint64(carry[j]), upto - offset) % m
            batch = batch.append_column(f"p{j}", pa.array(found.astype(np.int64))).append_column(f"q{j}", pa.array(((found + m - term) % m).astype(np.int64)))
            carry[j] = int(found[-1])
        last = key[:, -1]
        yield batch


def fingerprinted(turns: DataFrame, moduli=MODULI) -> DataFrame:
    """Turns with the fingerprints of the prefix that they end (p0, p1) and of the one before (q0, q1); a stored table."""
    rows = turns.withColumn("block", F.call_function("div", F.col("depth"), F.lit(BLOCK)))
    in_order = rows.select("conv_id", "block", "depth", *_TURN, "words").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth")
    kinds = "conv_id long, block long, depth long, g0 long, g1 long, g2 long, g3 long, words int, p0 long, q0 long, p1 long, q1 long"
    local = stored(in_order.mapInArrow(partial(_scanned, moduli=moduli), kinds), "scanned")
    ends = local.groupBy("conv_id", "block").agg(F.max_by(F.struct("p0", "p1"), "depth").alias("e"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("conv_id", "block", F.sum("e.p0").over(before).alias("a0"), F.sum("e.p1").over(before).alias("a1")).where("block > 0 AND a0 IS NOT NULL")
    joined = local.join(carried, ["conv_id", "block"], "left")
    for j, (modulus, _) in enumerate(moduli):
        joined = joined.withColumns({f"{c}{j}": (F.col(f"{c}{j}") + F.coalesce(f"a{j}", F.lit(0))) % modulus for c in "pq"})
    return joined.select("conv_id", "block", "depth", *_TURN, "words", "p0", "p1", "q0", "q1")


def verified(rows: DataFrame) -> DataFrame:
    """Rows with ``split`` and ``before_split``: where a conversation differs from the representatives of its groups, up to this depth and the one before."""
    rows = stored(rows, "fingerprinted")
    group = ["depth", "p0", "p1"]
    ends = rows.groupBy(*group).agg(*[f(g).alias(f"{f.__name__}_{g}") for g in _TURN for f in (F.min, F.max)])
    unequal = " OR ".join(f"min_{g} <> max_{g}" for g in _TURN)
    bad = stored(ends.where(unequal).select(*group), "collisions")
    none = F.lit("")
    if bad.isEmpty():
        return rows.withColumn("split", none).withColumn("before_split", none)
    turn = F.concat_ws(".", *[F.col(g).cast("string") for g in _TURN])
    met = rows.join(bad, group)
    own = met.groupBy(*group).agg(F.min(F.struct("conv_id", turn.alias("turn")))["turn"].alias("own"))
    differs = stored(met.join(own, group).where(turn != F.col("own")).select("conv_id", "depth", F.concat(F.col("depth").cast("string"), F.lit(":"), turn).alias("mark")), "differs")
    # From one depth where a conversation differs to the next the list stays the same; each is a digest of the one before and the mark.
    by_depth = Window.partitionBy("conv_id").orderBy("depth")
    listed = differs.withColumn("marks", F.collect_list("mark").over(by_depth.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lists = listed.select("conv_id", F.col("depth").alias("low"), F.lead("depth").over(by_depth).alias("high"), F.sha2(F.array_join("marks", ","), 256).alias("list"))
    touched = differs.select("conv_id").distinct()
    same = rows.join(touched, "conv_id", "left_anti").withColumn("split", none).withColumn("before_split", none)
    others = rows.join(touched, "conv_id", "left_semi")
    for name, at in (("split", F.col("depth")), ("before_split", F.col("depth") - 1)):
        within = (F.col("conv_id") == F.col("own_id")) & (at >= F.col("low")) & (F.col("high").isNull() | (at < F.col("high")))
        others = others.join(lists.withColumnRenamed("conv_id", "own_id"), within, "left").withColumn(name, F.coalesce("list", none)).drop("own_id", "low", "high", "list")
    return same.unionByName(others)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of each node; pieces come in order."""
    key, state = None, None
    for batch in batches:
        out: list[tuple] = []
        for at, piece in zip(batch.column(0), batch.column(2), strict=True):
            own = at.as_py()
            if own != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = own, hashlib.sha256(piece.as_py().encode())
            else:
                state.update(b"," + piece.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], names=["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, first id, ids joined by commas), ``PIECE`` ids at most, of (node, id) rows in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).dictionary_encode()
        code = node.indices.to_numpy()
        edges = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        ids, texts, names = batch.column(1).to_numpy(), batch.column(1).cast(pa.string()).to_pylist(), []
        first, joined = [], []
        for a, b in zip(edges, np.append(edges[1:], len(code)), strict=True):
            for k in range(a, b, PIECE):
                names.append(node.dictionary[int(code[a])].as_py())
                first.append(int(ids[k]))
                joined.append(",".join(texts[k : min(k + PIECE, b)]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(first, pa.int64()), pa.array(joined, pa.string())], names=["node", "first", "piece"])


def members_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id) rows: SHA-256 of the ids in ascending order, comma-joined."""
    ranged = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = stored(ranged.mapInArrow(_pieces, "node string, first long, piece string"), "pieces")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node string, ends_sha256 string")


def nodes(turns: DataFrame, conversations: DataFrame, moduli=MODULI) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node.

    ``turns``: conv_id, depth (from 1, without gaps), g0 to g3 (a turn's digest), words; ``conversations``: conv_id, size (its turns).
    """
    conversations = stored(conversations, "members")
    found = verified(fingerprinted(turns, moduli))
    none = F.lit(0).cast("long")
    root = conversations.select("conv_id", none.alias("block"), none.alias("depth"), F.lit(0).alias("words"), *[none.alias(c) for c in ("p0", "p1", "q0", "q1")], F.lit("").alias("split"), F.lit("").alias("before_split"))
    node = lambda depth, p, q, s: F.concat_ws(".", depth.cast("string"), p.cast("string"), q.cast("string"), s)
    rows = found.drop(*_TURN).unionByName(root)
    above = F.when(F.col("depth") > 0, node(F.col("depth") - 1, F.col("q0"), F.col("q1"), F.col("before_split")))
    rows = stored(rows.select("conv_id", "block", "depth", "words", node(F.col("depth"), F.col("p0"), F.col("p1"), F.col("split")).alias("node"), above.alias("parent")), "rows")
    made = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.first("parent").alias("parent"))
    made = stored(made, "nodes")
    children = made.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    made = stored(made.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", none)), "nodes")
    ids = made.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = looked_up(made.where("parent IS NOT NULL"), ids, ["parent"]).unionByName(made.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))

    # What a node counts for lies on its representative's row; the rows that follow in a conversation are added from the end.
    own = made.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    valued = rows.select("conv_id", "block", "depth", "node").join(own, ["conv_id", "depth"], "left").withColumns({c: F.coalesce(c, none) for c in ("saved", "leaf")})
    valued = stored(valued, "valued")
    on = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = valued.groupBy("conv_id", "block").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("x"))
    carried = sums.select("conv_id", "block", F.sum("s").over(later).alias("s"), F.sum("x").over(later).alias("x")).where("s IS NOT NULL")
    summed = valued.select("conv_id", "block", "node", F.sum("saved").over(on).alias("saved"), F.sum("leaf").over(on).alias("leaf"))
    summed = summed.join(carried, ["conv_id", "block"], "left")
    rolled = summed.groupBy("node").agg(F.sum(F.col("saved") + F.coalesce("s", none)).alias("saved_tokens"), F.sum(F.col("leaf") + F.coalesce("x", none)).alias("n_leaves"))
    last = rows.join(conversations.select("conv_id", F.col("size").alias("depth")), ["conv_id", "depth"]).select("node", "conv_id")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    out = named.join(rolled, "node").join(members_digest(last), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))


def oracle_sql() -> str:
    """The nodes of the rebuilt conversations in DuckDB SQL."""
    return rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c - c % {LENDER} AS lender FROM o),
h AS (SELECT c, lender, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 4 AS h FROM ids, crc),
lent AS (SELECT h.c, o.k AS depth, o.role, o.text FROM h JOIN o ON o.c = h.lender AND o.k <= h.h),
m AS (SELECT c, count(*) AS m FROM lent GROUP BY c),
r AS (SELECT c, depth, role, text FROM lent UNION ALL SELECT o.c, o.k - h.h + coalesce(m.m, 0), role, text FROM o JOIN h USING (c) LEFT JOIN m USING (c) WHERE o.k > h.h),
x AS (SELECT c, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, md5(string_agg(sha256(strlen(role) || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY depth)) AS node FROM r),
y AS (SELECT c, depth, words, node, coalesce(lag(node) OVER (PARTITION BY c ORDER BY depth), '') AS parent FROM x UNION ALL SELECT c, 0, 0, '', NULL FROM ids),
n AS (SELECT node, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(words) AS words, any_value(parent) AS parent FROM y GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
z AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (node)),
up AS (SELECT y.node, sum((u.n_convs - 1) * u.words)::BIGINT AS saved_tokens, count(*) FILTER (u.n_children = 0) AS n_leaves FROM z AS u JOIN y ON y.c = u.conv_id AND y.depth <= u.depth GROUP BY y.node),
size AS (SELECT c, max(depth) AS depth FROM y GROUP BY c),
ends AS (SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM y JOIN size USING (c, depth) GROUP BY node)
SELECT z.conv_id, z.depth, p.conv_id AS parent_conv_id, z.n_convs, z.n_children, up.n_leaves, up.saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM z JOIN up USING (node) LEFT JOIN n AS p ON p.node = z.parent LEFT JOIN ends ON ends.node = z.node"""
