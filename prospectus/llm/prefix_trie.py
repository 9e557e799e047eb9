"""The trie of conversations by their turns: every distinct beginning is a node, with counts over its subtree.

Method: fixed-length block hashing. A conversation's turns are cut into blocks of ``BLOCK`` turns, and a block's path is the
digest of all turns up to its end. Conversations are grouped by the digests of successive blocks first. Where all conversations
that leave a block boundary share the next block, its inner turns are read off that one block; only where siblings diverge (or
one ends inside) are the turn boundaries inside the block grouped as well. Copies of a conversation are one row from the first
grouping on.

A path's digest is the exclusive-or of 128 bits for each of its turns (two hashes of position and MD5 of role and text), so
that parts of a conversation are hashed apart and put together, and a conversation of any length is spread over tasks: rows are
numbered by a range sort, and running sums go through parts of ``SPAN`` positions. Texts leave the scan as digests only.

A node is named by its smallest member and its depth. The nodes of one smallest member form a chain, the end of its path; a
chain hangs on a node of another one. Totals of chains are summed up the tree of chains by pointer doubling (a number of rounds
that grows with the logarithm of its height), and then along each chain, so that no node is sent to all of its ancestors.

Defined cases. Null role or text is the empty string. Turns are ordered by ``turn``, nulls first, equal ones by the MD5 of role
and text; repeated rows are turns of their own. Rows without a ``conv_id`` belong to no conversation. An empty table has no node,
not even the root. Very long texts and conversations are read whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospectus.llm.common import cut

#: Turns of a block, positions of a part of a running sum, and ids of a piece of a member list.
BLOCK, SPAN, IDS = 4, 8_192, 8_192


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (``conv_id``, ``turn``, ``digest``, ``words``) with ``pos`` from 1 in each conversation, and ``n``, its length.

    One range sort over the whole table: a conversation may span many tasks.
    """
    row = F.monotonically_increasing_id().alias("row")
    rows = cut(rows.select("conv_id", "turn", "digest", "words", row))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "words", F.monotonically_increasing_id().alias("place")))
    task = F.shiftright("place", 33).alias("task")
    parts = placed.groupBy("conv_id", task).agg(F.min("place").alias("first"), F.count("*").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "task", "first", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    own = placed.withColumn("task", task)
    return own.join(parts, ["conv_id", "task"]).select("conv_id", "digest", "words", (F.col("before") + F.col("place") - F.col("first") + 1).alias("pos"))


def rebuilt(rows: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id``, ``size``) and their turns (``conv_id``, ``pos``, ``digest``, ``words``) with shared beginnings.

    The first h turns of conversation c are those of c - c % ``group`` (as many as it has), h = crc32(c) % ``most``.
    """
    rows = cut(numbered(rows))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    lengths = rows.groupBy("conv_id").agg(F.max("pos").alias("length"))
    heads = lengths.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first_conv"), F.col("length").alias("first_length"))
    convs = lengths.select("conv_id", "length", (F.col("conv_id") - F.col("conv_id") % group).alias("first_conv"), taken.alias("h"))
    convs = convs.join(heads, "first_conv", "left").withColumn("given", F.least("h", F.coalesce("first_length", F.lit(0))))
    convs = cut(convs.select("conv_id", "first_conv", "h", "given", (F.col("given") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("size")))
    begun = rows.where((F.col("conv_id") % group == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "first_conv")
    begun = convs.where("given > 0").join(begun, "first_conv").where("pos <= given").select("conv_id", "pos", "digest", "words")
    own = rows.where(F.col("pos") > taken)
    short = convs.where("given < h").select("conv_id", (F.col("h") - F.col("given")).alias("less"))
    own = own.join(short, "conv_id", "left").withColumn("pos", F.col("pos") - F.coalesce("less", F.lit(0)))
    return convs.select("conv_id", "size"), cut(begun.unionByName(own.select("conv_id", "pos", "digest", "words")))


def running(df: DataFrame, key: list[str], pos: str, values: dict[str, str], total, backwards: bool = False, span: int = SPAN) -> DataFrame:
    """``df`` with running totals (``values``: new name by column) along ``pos`` within ``key``, the row's own included.

    ``total`` is the aggregate. A key is summed in parts of ``span`` positions, and only the parts' totals meet in one window.
    """
    part = F.floor(F.col(pos) / span).alias("part")
    df = df.withColumn("part", part)
    step = (lambda name: F.col(name).desc()) if backwards else F.col
    sums = df.groupBy(*key, "part").agg(*[total(name).alias(f"of {name}") for name in values])
    earlier = Window.partitionBy(*key).orderBy(step("part")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*key, "part", *[total(f"of {name}").over(earlier).alias(f"before {name}") for name in values])
    inside = Window.partitionBy(*key, "part").orderBy(step(pos)).rowsBetween(Window.unboundedPreceding, 0)
    own = df.select("*", *[total(name).over(inside).alias(new) for name, new in values.items()])
    joined = own.join(before, [*key, "part"])
    put = (lambda a, b: a.bitwiseXOR(b)) if total is F.bit_xor else (lambda a, b: a + b)
    return joined.withColumns({new: put(F.col(new), F.coalesce(F.col(f"before {name}"), F.lit(0).cast("long"))) for name, new in values.items()}).drop(
        "part", *[f"before {name}" for name in values]
    )


def turn_hash(pos: Column, digest: Column) -> tuple[Column, Column]:
    """128 bits of a turn at its position."""
    return F.xxhash64(pos, digest), F.xxhash64(digest, F.lit("low"), pos)


def blocks_of(turns: DataFrame, block: int) -> DataFrame:
    """One row a block of a conversation: path digests before (``bh``, ``bl``) and after (``ah``, ``al``), and its turns."""
    hashes = dict(zip(("high", "low"), turn_hash(F.col("pos"), F.col("digest")), strict=True))
    number = F.floor((F.col("pos") - 1) / block).alias("number")
    turn = F.sort_array(F.collect_list(F.struct("pos", "high", "low", "words"))).alias("turns")
    rows = turns.withColumns(hashes).groupBy("conv_id", number).agg(turn, F.bit_xor("high").alias("oh"), F.bit_xor("low").alias("ol"))
    rows = running(rows, ["conv_id"], "number", {"oh": "ah", "ol": "al"}, F.bit_xor)
    return rows.withColumns({"bh": F.col("ah").bitwiseXOR(F.col("oh")), "bl": F.col("al").bitwiseXOR(F.col("ol"))})


def inner_nodes(contents: DataFrame, block: int) -> DataFrame:
    """The nodes at every turn boundary of the blocks, with the digest of the node above."""
    size = F.size("turns")
    so_far = lambda name, i: F.aggregate(F.slice("turns", 1, i), F.col("bh" if name == "high" else "bl"), lambda x, t: x.bitwiseXOR(t[name]))
    at = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.struct(
            (F.col("number") * block + i).alias("depth"), so_far("high", i).alias("kh"), so_far("low", i).alias("kl"),
            F.when(i > 1, so_far("high", i - 1)).otherwise(F.col("bh")).alias("ph"), F.when(i > 1, so_far("low", i - 1)).otherwise(F.col("bl")).alias("pl"),
            F.element_at("turns", i)["words"].alias("words"),
        ),
    )
    return contents.select("conv_id", "n_convs", F.explode(at).alias("x")).select("x.*", "conv_id", "n_convs")


def path_nodes(blocks: DataFrame, block: int) -> DataFrame:
    """Every node below the root once: ``depth``, digests of its path and of the one above, members, and its turn's words."""
    key = ["number", "bh", "bl", "ah", "al"]
    contents = cut(blocks.groupBy(*key).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns")))
    alone = contents.groupBy("number", "bh", "bl").agg(F.count("*").alias("kinds"), F.min("ah").alias("ah"), F.min("al").alias("al"))
    alone = alone.where("kinds = 1").select("number", "ah", "al", F.lit(True).alias("shared"))
    contents = contents.join(alone, ["number", "ah", "al"], "left")
    unary = inner_nodes(contents.where("shared"), block)
    split = inner_nodes(contents.where("shared is null"), block)
    split = split.groupBy("depth", "kh", "kl").agg(
        F.first("ph").alias("ph"), F.first("pl").alias("pl"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")
    )
    return unary.unionByName(split)


def member_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each path (``depth``, ``kh``, ``kl``, ``conv_id``), ascending and joined by commas.

    Ids are sorted over all tasks, joined into pieces of ``IDS``, and the pieces hashed in turn: no list is held whole.
    """
    key, order = ["depth", "kh", "kl"], ["depth", "kh", "kl", "conv_id"]

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["piece"] = (frame.groupby(key, sort=False).cumcount()) // IDS
            grouped = frame.groupby([*key, "piece"], sort=False)["conv_id"]
            yield pd.DataFrame({"from": grouped.first(), "ids": grouped.agg(lambda x: ",".join(map(str, x.tolist())))}).reset_index()[[*key, "from", "ids"]]

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for frame in frames:
            done = []
            for *path, ids in frame[[*key, "ids"]].itertuples(index=False, name=None):
                if path == now:
                    sha.update(b",")
                else:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = path, hashlib.sha256()
                sha.update(ids.encode())
            yield pd.DataFrame(done, columns=[*key, "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=[*key, "ends_sha256"])

    spread = cut(ends.select(*order)).repartitionByRange(*order).sortWithinPartitions(*order)
    texts = spread.mapInPandas(pieces, "depth long, kh long, kl long, from long, ids string")
    return texts.repartition(*key).sortWithinPartitions(*key, "from").mapInPandas(hashed, "depth long, kh long, kl long, ends_sha256 string")


def chain_totals(chains: DataFrame, root: Column) -> DataFrame:
    """``conv_id``, ``leaves`` and ``saved`` summed over each chain and all that hang below it.

    ``chains``: ``conv_id``, ``above`` (the chain it hangs on, null for the root's), ``leaves`` and ``saved`` of its own. Each
    round doubles the height that a total covers. ``root`` is the root's chain, on which most others hang.
    """
    state = chains
    while True:
        given = state.where("above is not null").groupBy(F.col("above").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        summed = state.join(given, "conv_id", "left").select(
            "conv_id", F.when(F.col("above") != root, F.col("above")).alias("via"),
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
        if state.where(F.col("above") != root).isEmpty():
            return summed.select("conv_id", "leaves", "saved")
        further = state.where("above is not null").select(F.col("conv_id").alias("via"), "above")
        state = cut(summed.join(further, "via", "left").select("conv_id", "above", "leaves", "saved"))


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), words.alias("words"))
    convs, turns = rebuilt(rows)
    blocks = cut(blocks_of(turns, block))
    none = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(*[none.alias(name) for name in ("depth", "kh", "kl", "ph", "pl", "words")], "conv_id", "n_convs")
    nodes = cut(path_nodes(blocks, block).unionByName(root))
    smallest = F.lit(root.first()["conv_id"] if not convs.isEmpty() else None).cast("long")

    first = F.min_by(F.struct("depth", "ph", "pl"), "depth").alias("top")
    saved = F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    chains = nodes.groupBy("conv_id").agg(first, F.max("depth").alias("last"), saved).select("conv_id", "top.*", "last", "saved")
    below = nodes.select(F.col("depth") + 1, "kh", "kl", F.col("conv_id").alias("above")).toDF("depth", "ph", "pl", "above")
    deep = chains.where("depth > 1").join(below.where("depth > 1"), ["depth", "ph", "pl"])
    high = chains.where("depth = 1").withColumn("above", smallest)
    top = chains.where("depth = 0").withColumn("above", F.lit(None).cast("long"))
    names = ["conv_id", "depth", "last", "saved", "above"]
    chains = cut(deep.select(*names).unionByName(high.select(*names)).unionByName(top.select(*names)))

    at = [F.col("above").alias("conv_id"), (F.col("depth") - 1).alias("depth")]
    hanging = chains.where("above is not null").groupBy(*at).agg(F.count("*").alias("hung"))
    closed = chains.join(hanging.withColumnRenamed("depth", "last"), ["conv_id", "last"], "left")
    leaf = F.when(F.col("hung").isNull(), 1).otherwise(0).cast("long").alias("leaves")
    totals = chain_totals(cut(closed.select("conv_id", "above", leaf, "saved")), smallest)
    hung = chains.where("above is not null").join(totals.select("conv_id", "leaves", F.col("saved").alias("all_saved")), "conv_id")
    hung = hung.groupBy(*at).agg(F.count("*").alias("hung"), F.sum("leaves").alias("hung_leaves"), F.sum("all_saved").alias("hung_saved"))

    ending = blocks.groupBy("conv_id").agg(F.max_by(F.struct(F.col("ah").alias("kh"), F.col("al").alias("kl")), "number").alias("path"))
    ends = convs.join(ending, "conv_id", "left").select(F.col("size").cast("long").alias("depth"), F.coalesce("path.kh", none).alias("kh"), F.coalesce("path.kl", none).alias("kl"), "conv_id")
    nodes = nodes.join(member_hashes(ends), ["depth", "kh", "kl"], "left").select("conv_id", "depth", "n_convs", "words", "ends_sha256")

    tops = chains.select("conv_id", "depth", "above", F.lit(True).alias("is_top"))
    lasts = chains.select("conv_id", F.col("last").alias("depth"), F.lit(0).cast("long").alias("goes_on"))
    key = ["conv_id", "depth"]
    nodes = nodes.join(tops, key, "left").join(lasts, key, "left").join(hung, key, "left")
    nodes = nodes.withColumns({"goes_on": F.coalesce("goes_on", F.lit(1).cast("long")), "hung": F.coalesce("hung", none)})
    nodes = nodes.withColumns(
        {
            "own_leaves": F.coalesce("hung_leaves", none) + F.when((F.col("goes_on") == 0) & (F.col("hung") == 0), 1).otherwise(0),
            "own_saved": F.coalesce("hung_saved", none) + (F.col("n_convs") - 1) * F.col("words"),
        }
    )
    nodes = running(nodes, ["conv_id"], "depth", {"own_leaves": "n_leaves", "own_saved": "saved_tokens"}, F.sum, backwards=True)
    return nodes.select(
        "conv_id", "depth", F.when(F.col("is_top"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        (F.col("hung") + F.col("goes_on")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
