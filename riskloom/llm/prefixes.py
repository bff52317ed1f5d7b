"""A prefix trie over conversations, by digests of fixed-length blocks of turns.

Conversations that begin with the same turns share the nodes of these turns. Building the
trie turn by turn would compare every conversation at every depth. Here a conversation is
first cut into blocks of ``BLOCK_TURNS`` turns, and conversations are grouped by the
digest of each block together with all blocks before it. A group has one *delegate*, its
smallest conversation, however many conversations are in it. Where all conversations of a
prefix go on with one and the same block, the turns inside the block have the same
members, so nothing is looked at; only where the next blocks *diverge* are their turns
compared, among the delegates of these blocks.

A node is known by its depth and its smallest conversation, as each conversation is in one
node of a depth. From the depth on where a conversation is the smallest one, it *owns* the
nodes on its way. This makes sums over subtrees sums over members: a node's subtree has
as many leaves as there are members that own a leaf, and each member saves the words of
the turns below the node which it doesn't own. So every sum takes one row for each block
of each conversation, and no walk over the tree.

All of it is column expressions, joins and aggregates. Digests of prefixes are running
sums (by ``xor``) of digests that know their depth, taken in two levels; places in a
conversation come from a range sort. So no window or list has to hold a conversation, a
node, or the children of a node, whole; the ids that a node's digest needs are written
out in short runs first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.storage import materialize

BLOCK_TURNS = 4
#: Conversations are rebuilt from others by the number in their tens and ones.
HEAD_STEP, MOST_HEAD = 20, 4
#: Blocks of one window of the running sums; ids in one written run.
_RUN = 1024
_IDS = 4096
_WORDS = r"[^\x20\x09-\x0D]+"
_NO_IDS = hashlib.sha256(b"").hexdigest()


def placed_turns(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, place, digest, words``: the turns of each conversation in order (null
    turn numbers first; ties by role, then by the digest of the text), places from 0.

    A conversation may be of any length: rows are sorted by ranges, which can split it,
    and numbered inside each range; the few conversations that go on in a further range
    get what lies before added."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), plain(role_col).alias("role"),
        F.md5(F.concat(F.char_length(plain(role_col)).cast("string"), F.lit(":"), plain(role_col), plain(text_col))).alias("digest"),
        F.regexp_count(plain(text_col), F.lit(_WORDS)).cast("long").alias("words"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ranged = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    here = W.partitionBy("conv_id", "part")
    numbered = ranged.select(
        "conv_id", "part", "digest", "words", (F.row_number().over(here.orderBy(*order[1:])) - 1).alias("own"),
    )
    sizes = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(
        W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    )).where("before is not null").select("conv_id", "part", "before")
    # a range begins inside one conversation at most, so there are fewer rows than ranges
    return numbered.join(F.broadcast(before), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).cast("long").alias("place"), "digest", "words"
    )


def rebuilt_turns(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations with other heads: the first ``h`` turns of the conversation whose
    number is rounded down to twenties, then the own turns after the first ``h``; ``h`` is
    the checksum of the number modulo four. Also the conversations, as turnless ones have
    no turns."""
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("n_turns")).select(
        "conv_id", "n_turns", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % HEAD_STEP).alias("head_id"),
    )
    sizes = convs.where("conv_id = head_id").select("head_id", F.col("n_turns").alias("head_turns"))
    convs = materialize(convs.join(sizes, "head_id", "left").select(
        "conv_id", "head_id", "h", F.least("h", F.coalesce("head_turns", F.lit(0))).alias("taken")
    ))
    own = placed.join(convs, "conv_id").where("place >= h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "digest", "words"
    )
    heads = placed.where((F.col("place") < MOST_HEAD - 1) & (F.col("conv_id") % HEAD_STEP == 0))
    heads = heads.withColumnRenamed("conv_id", "head_id").join(convs, "head_id").where("place < h").select(
        "conv_id", (F.col("place") + 1).alias("depth"), "digest", "words"
    )
    return own.unionByName(heads), convs.select("conv_id")


def _running(rows: DataFrame, key: str, at: str, sums: dict[str, tuple]) -> DataFrame:
    """Running totals before each row of a ``key``: ``sums`` has for each new column the
    column and the aggregate. Totals are taken over runs of ``_RUN`` rows, then inside
    each, so no window holds a long key whole."""
    rows = rows.withColumn("run", F.floor(F.col(at) / _RUN))
    runs = rows.groupBy(key, "run").agg(*(f(c).alias(name) for name, (c, f) in sums.items()))
    before = W.partitionBy(key).orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    later = runs.select(key, "run", *(f(name).over(before).alias(f"{name}_before") for name, (_, f) in sums.items()))
    inside = W.partitionBy(key, "run").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select("*", *(f(c).over(inside).alias(f"{name}_inside") for name, (c, f) in sums.items()))
    rows = rows.join(later.where("run > 0"), [key, "run"], "left")

    def total(name: str, f) -> Column:
        parts = [F.coalesce(F.col(f"{name}_{part}"), F.lit(0).cast("long")) for part in ("before", "inside")]
        return (parts[0].bitwiseXOR(parts[1]) if f is F.bit_xor else parts[0] + parts[1]).alias(name)

    kept = [c for c in rows.columns if c != "run" and not c.endswith(("_before", "_inside"))]
    return rows.select(*kept, *(total(name, f) for name, (_, f) in sums.items()))


def _blocks(turns: DataFrame, block_turns: int) -> DataFrame:
    """One row for each block of each conversation: ``n`` turns, the digest ``x, y`` of all
    turns up to its end and ``x0, y0`` of those before it, and the words likewise."""
    blocks = turns.groupBy("conv_id", "block").agg(
        F.count("*").alias("n"), F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), F.sum("words").alias("block_words")
    )
    rows = _running(blocks, "conv_id", "block", {
        "x0": ("bx", F.bit_xor), "y0": ("by", F.bit_xor), "words0": ("block_words", F.sum),
    })
    return rows.select(
        "conv_id", "block", "n", "x0", "y0", "words0", F.col("x0").bitwiseXOR(F.col("bx")).alias("x"),
        F.col("y0").bitwiseXOR(F.col("by")).alias("y"), (F.col("words0") + F.col("block_words")).alias("words1"),
    )


_GROUP = ["block", "n", "x", "y"]


def _groups(blocks: DataFrame, block_turns: int) -> DataFrame:
    """Blocks that are equal, with all before them: ``delegate``, ``members``, how many end
    here (``ends``), and whether their prefix goes on in several ways (``diverges``)."""
    groups = materialize(blocks.groupBy(*_GROUP).agg(
        F.min("conv_id").alias("delegate"), F.count("*").alias("members"), F.min("x0").alias("x0"), F.min("y0").alias("y0"),
        F.min("words0").alias("words0"),
    ))
    prefixes = materialize(groups.groupBy("block", "x0", "y0").agg(
        F.count("*").alias("ways"), F.sum("members").alias("going_on"), F.min("x").alias("x"), F.min("y").alias("y"), F.min("n").alias("n"),
    ))
    # each of these joins is one row to one row: a prefix with a single way is known by its group
    single = prefixes.where("ways = 1").select(*_GROUP, F.lit(False).alias("diverges"))
    onward = prefixes.select((F.col("block") - 1).alias("block"), F.col("x0").alias("x"), F.col("y0").alias("y"), "going_on")
    onward = onward.withColumn("n", F.lit(block_turns).cast("long"))
    return materialize(
        groups.join(single, _GROUP, "left").join(onward, _GROUP, "left").select(
            *groups.columns, F.coalesce("diverges", F.lit(True)).alias("diverges"),
            (F.col("members") - F.coalesce("going_on", F.lit(0))).alias("ends"),
        )
    )


def _steps(turns: DataFrame, groups: DataFrame) -> DataFrame:
    """The turns of each group, as its delegate has them: ``words0`` are the words of all
    turns before, ``px, py`` the digest of the turn before, ``x, y`` of this one."""
    end = (F.col("g.block") * F.lit(1)).alias("block")
    own = turns.alias("t").join(
        groups.alias("g"), (F.col("t.conv_id") == F.col("g.delegate")) & (F.col("t.block") == F.col("g.block"))
    ).select(
        "delegate", end, "n", "members", "ends", "diverges", "depth", F.col("t.words").alias("words"),
        F.col("t.x").alias("tx"), F.col("t.y").alias("ty"), "x0", "y0", "words0",
    )
    before = W.partitionBy("delegate", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rows = own.select(
        "*", F.row_number().over(W.partitionBy("delegate", "block").orderBy("depth")).alias("at"),
        F.coalesce(F.bit_xor("tx").over(before), zero).bitwiseXOR(F.col("x0")).alias("px"),
        F.coalesce(F.bit_xor("ty").over(before), zero).bitwiseXOR(F.col("y0")).alias("py"),
        F.coalesce(F.sum("words").over(before), zero).alias("inside"),
    )
    return rows.select(
        "delegate", "block", "depth", "members", "diverges", "words", (F.col("words0") + F.col("inside")).alias("words0"),
        "px", "py", F.col("px").bitwiseXOR(F.col("tx")).alias("x"), F.col("py").bitwiseXOR(F.col("ty")).alias("y"),
        (F.col("at") == 1).alias("opens"), F.when(F.col("at") == F.col("n"), F.col("ends")).otherwise(0).alias("ends"),
    )


_NODE = ["depth", "x", "y"]


def _nodes(steps: DataFrame) -> DataFrame:
    """``depth, x, y, conv_id, n_convs, ends, words, px, py``; steps where nothing diverges
    are nodes as they are, the others are grouped by digest."""
    columns = ["depth", "x", "y", "conv_id", "n_convs", "ends", "words", "px", "py"]
    plain = steps.where("not diverges").withColumnsRenamed({"delegate": "conv_id", "members": "n_convs"}).select(*columns)
    compared = steps.where("diverges").groupBy(*_NODE).agg(
        F.min("delegate").alias("conv_id"), F.sum("members").alias("n_convs"), F.sum("ends").alias("ends"),
        F.min("words").alias("words"), F.min("px").alias("px"), F.min("py").alias("py"),
    )
    return plain.unionByName(compared.select(*columns))


def _ends(blocks: DataFrame, lengths: DataFrame, block_turns: int) -> DataFrame:
    """``depth, x, y, ends_sha256`` for nodes where conversations end. Ids are written out
    in runs of ``_IDS`` numbers, and the runs of a node hashed in order as they come."""
    last = blocks.join(lengths, "conv_id").withColumn("depth", F.col("block") * block_turns + F.col("n")).where("depth = n_turns")
    run = F.floor(F.col("conv_id") / _IDS).alias("run")
    written = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    runs = materialize(last.groupBy("depth", "x", "y", run).agg(written.alias("written")))
    return (
        runs.repartition("depth", "x", "y").sortWithinPartitions("depth", "x", "y", "run")
        .mapInArrow(_hash_runs, "depth long, x long, y long, ends_sha256 string")
    )


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, None
    for batch in batches:
        out = []
        keys = zip(*(batch.column(c).to_pylist() for c in _NODE), strict=True)
        for key, written in zip(keys, batch.column("written").to_pylist(), strict=True):
            if key == now:
                digest.update(b",")
            else:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            digest.update(written.encode())
        yield _ended(out)
    if now is not None:
        yield _ended([(*now, digest.hexdigest())])


def _ended(rows: Sequence[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*_NODE, "ends_sha256"]
    )


def prefix_trie(turns: DataFrame, convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The trie of conversations: ``turns`` has ``conv_id, depth, digest, words`` with
    depths from 1 without gaps, ``convs`` all ``conv_id``, also those without turns.

    One row for each different sequence of first turns, the empty one included: ``conv_id``
    (the smallest conversation that begins so), ``depth``, ``parent_conv_id`` (that of the
    sequence without its last turn; null for the root), ``n_convs``, ``n_children``,
    ``n_leaves`` (in the subtree, itself included), ``saved_tokens`` (over the subtree, the
    words of each node's turn times its conversations but one) and ``ends_sha256`` (of the
    conversations that end here). Turns are compared by 128 bits. No conversation, no row.
    """
    turns = materialize(turns.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.floor((F.col("depth") - 1) / block_turns).cast("long").alias("block"),
        F.xxhash64("digest", "depth").alias("x"), F.xxhash64("depth", F.lit("y"), "digest").alias("y"), "words",
    ))
    blocks = materialize(_blocks(turns, block_turns))
    groups = _groups(blocks, block_turns)
    steps = materialize(_steps(turns, groups))
    nodes = materialize(_nodes(steps))

    # the node of each step; a hot node's steps are many, and the join is one that Spark can split
    own = nodes.select(*_NODE, F.col("conv_id").alias("node_id"))
    in_nodes = materialize(
        steps.where("not diverges").withColumn("node_id", F.col("delegate"))
        .unionByName(steps.where("diverges").join(own, _NODE))
    )
    owned = in_nodes.where("delegate = node_id").groupBy("delegate").agg(
        F.min("depth").alias("owns_from"), F.min("words0").alias("words_before")
    ).withColumnRenamed("delegate", "conv_id")
    leaves = nodes.where("n_convs = ends").select("conv_id", F.lit(1).alias("leaf"))
    lengths = blocks.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.max("words1").alias("all_words"))
    ways = materialize(
        lengths.join(owned, "conv_id", "left").join(leaves, "conv_id", "left").select(
            "conv_id", "n_turns", F.coalesce("leaf", F.lit(0)).alias("leaf"),
            F.coalesce("owns_from", F.col("n_turns") + 1).alias("owns_from"),
            F.coalesce("words_before", "all_words").alias("words_before"),
        )
    )

    # what the members of a group leave to others, their delegate apart
    carried = blocks.join(ways, "conv_id").groupBy(*_GROUP).agg(
        F.sum("leaf").alias("leaves"), F.sum("words_before").alias("skipped"),
        F.min_by("words_before", "conv_id").alias("delegate_words"), F.min_by("owns_from", "conv_id").alias("owns_from"),
        F.min("conv_id").alias("delegate"),
    ).select(
        "block", "delegate", "leaves", (F.col("skipped") - F.col("delegate_words")).alias("skipped"), "delegate_words", "owns_from"
    )
    saved = (
        F.col("skipped") - (F.col("members") - 1) * F.col("words0")
        + F.when(F.col("owns_from") > F.col("depth"), F.col("delegate_words") - F.col("words0")).otherwise(0)
    )
    summed = in_nodes.join(materialize(carried), ["delegate", "block"]).groupBy("depth", F.col("node_id").alias("conv_id")).agg(
        F.sum("leaves").alias("n_leaves"), F.sum(saved).alias("saved_tokens")
    )

    # the node before each node: the same conversation's where it owns that too
    parents = materialize(nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id")
    ))
    smallest = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    totals = ways.agg(
        F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("words_before"), F.lit(0)).alias("skipped")
    )
    first = nodes.where("depth = 1").crossJoin(F.broadcast(smallest.select(F.col("conv_id").alias("parent_conv_id"))))
    deeper = nodes.where("depth > 1").join(parents, ["depth", "px", "py"])
    placed = materialize(first.unionByName(deeper.select(*first.columns)))
    children = placed.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(
        F.count("*").alias("n_children")
    )
    ended = _ends(blocks, ways.select("conv_id", "n_turns"), block_turns)
    found = (
        placed.join(summed, ["depth", "conv_id"]).join(children, ["depth", "conv_id"], "left").join(ended, _NODE, "left")
    )
    digest = F.coalesce("ends_sha256", F.lit(_NO_IDS)).alias("ends_sha256")
    found = found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), digest,
    )
    turnless = convs.join(ways.select("conv_id"), "conv_id", "left_anti")
    return found.unionByName(_root(smallest, totals, placed, turnless))


def _root(smallest: DataFrame, totals: DataFrame, placed: DataFrame, turnless: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    first = placed.where("depth = 1").agg(F.count("*").alias("n_children"))
    run = F.floor(F.col("conv_id") / _IDS).alias("run")
    written = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    runs = turnless.groupBy(run).agg(written.alias("written"))
    keyed = runs.select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "run", "written")
    ended = keyed.repartition(1).sortWithinPartitions("run").mapInArrow(
        _hash_runs, "depth long, x long, y long, ends_sha256 string"
    ).select("ends_sha256")
    return (
        smallest.where("n_convs > 0").crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(first))
        .join(F.broadcast(ended), F.lit(True), "left")
        .select(
            "conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
            F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.col("skipped").cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(_NO_IDS)).alias("ends_sha256"),
        )
    )


def rebuilt_trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The trie of the rebuilt conversations of a table ``conv_id, turn, role, text``.

    Null roles and texts count as empty, null turn numbers come first, ties are ordered by
    role, then by a digest of role and text; repeated rows are turns of their own. Rows
    without a conversation id belong to none. Other columns are not read. An empty table
    gives no node."""
    turns, convs = rebuilt_turns(materialize(placed_turns(conversations)))
    return prefix_trie(turns, convs, block_turns)
