"""Prefix trie of conversations (operator 12) by collapsing whole sequences.

A node is a distinct sequence of first turns (role, text); the root is the empty one. A node's key is its depth and two 64-bit sums (exclusive or) of
hashes of its turns' SHA-256 digests and places, so the keys of all prefixes of a conversation are one running window.

Conversations that are equal as a whole are collapsed first: a sequence, how many conversations it stands for, and the smallest of them, whose rows
alone go on. Sequences whose key is not that of a proper prefix (anti-join) are the leaves. Then weights are summed by prefix key; sums are
combined before they are shuffled, so the root and other keys that everything shares are a row a task.

A subtree's saved words are summed without listing descendants: each node belongs to the sequence of its smallest member, in which its own nodes are
the deepest ones; the words of a sequence's own nodes are summed from the end to the start, and a node's total is the sum of that over all sequences
through it.

The ids of conversations that end at a node are sorted by Spark over node and id, joined in runs of RUN ids wherever they lie, and the runs of a node
pass one by one through a hash: no list of them is ever held. A conversation's turns are put in order in one task, by a sort that spills.

Rows: a null conv_id is no conversation and is left out. A null role or text is empty. Turns in order of `turn`, null first; equal ones by role, then
text, and repeated rows are turns of their own. An empty table has no nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import checkpointed, spread_join
from touchline.llm.quality import words_of

ROOT = "0"
RUN = 8192


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest, n_words of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), F.unhex(digest).alias("digest"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))


def rebuild(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: each conversation c gets the first h turns of c - c % every in place of its own, h = crc32(c) % most.

    Returns the turns as ordered_turns() gives them, with n_turns of the conversation, and conv_id of conversations that have no turn.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    base = F.col("conv_id") - F.col("conv_id") % every
    # at most most - 1 turns of one conversation, for at most `every` others
    opening = turns.where((F.col("pos") < most - 1) & (F.col("conv_id") % every == 0)).groupBy(F.col("conv_id").alias("base"))
    opening = opening.agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "n_words"))).alias("opening"))
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", h.alias("h"), base.alias("base")).join(opening, "base", "left")
    sizes = sizes.withColumn("opening", F.expr("slice(coalesce(opening, cast(array() as array<struct<pos:bigint,digest:binary,n_words:bigint>>)), 1, cast(h as int))"))
    sizes = sizes.withColumn("n_turns", F.size("opening") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = turns.where(F.col("pos") >= h).join(sizes.select("conv_id", "h", F.size("opening").alias("m"), "n_turns"), "conv_id")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "digest", "n_words", "n_turns")
    opened = sizes.select("conv_id", "n_turns", F.inline("opening"))
    return own.unionByName(opened), sizes.where("n_turns = 0").select("conv_id")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, n_turns, n_words, key, parent: a row for each non-empty prefix of a conversation."""
    upto = Window.partitionBy("conv_id").orderBy("pos")
    running = [F.bit_xor(F.xxhash64(*of)).over(upto.rowsBetween(Window.unboundedPreceding, 0)) for of in (("pos", "digest"), (F.lit("second"), "digest", "pos"))]
    key = F.concat_ws("-", F.col("pos") + 1, *(F.hex(r) for r in running))
    rows = turns.select("conv_id", "pos", (F.col("pos") + 1).alias("depth"), "n_turns", "n_words", key.alias("key"))
    return rows.withColumn("parent", F.coalesce(F.lag("key").over(upto), F.lit(ROOT))).drop("pos")


def ends_of(whole: DataFrame) -> DataFrame:
    """key, ends_sha256 of whole's key and conv_id: ids in order, comma-joined."""
    runs = whole.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_runs, "key string, first long, ids string")
    return runs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key string, ends_sha256 string")


def _runs(batches):
    key, ids = None, []

    def row():
        return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.string()), "first": pa.array([ids[0]], pa.int64()), "ids": pa.array([",".join(map(str, ids))], pa.string())})

    for batch in batches:
        done = []
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (k != key or len(ids) == RUN):
                done.append(row())
                ids = []
            key = k
            ids.append(i)
        yield from (pa.Table.from_batches(done).combine_chunks().to_batches() if done else ())
    if ids:
        yield row()


def _digests(batches):
    key, digest = None, None

    def rows(found):
        return pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in found], pa.string()), "ends_sha256": pa.array([d for _, d in found], pa.string())})

    for batch in batches:
        found = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k != key:
                if digest is not None:
                    found.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if found:
            yield rows(found)
    if digest is not None:
        yield rows([(key, digest.hexdigest())])


def nodes_of(turns: DataFrame, turnless: DataFrame) -> DataFrame:
    """key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node.

    turns: conv_id, pos, digest, n_words, n_turns, every place from 0 to n_turns - 1 of a conversation once; turnless: conv_id of those without any.
    """
    rows = checkpointed(prefixes(turns))
    bare = turnless.select("conv_id", F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("n_turns"))
    whole = rows.where("depth = n_turns").select("conv_id", "key", "n_turns").unionByName(bare)

    # equal conversations become one sequence, known by its smallest conversation
    sequences = checkpointed(whole.groupBy("key", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")))
    path = rows.drop("n_turns").join(sequences.select("conv_id", "weight", "n_turns"), "conv_id")
    root = sequences.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_words"), F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"), "weight", "n_turns")
    path = path.unionByName(root)

    # leaves are no proper prefix of any sequence
    proper = path.where("depth < n_turns").select("key").distinct()
    leaves = sequences.join(proper, "key", "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    path = checkpointed(path.join(leaves, "conv_id", "left"))

    nodes = path.groupBy("key").agg(
        *(F.first(c).alias(c) for c in ("depth", "parent", "n_words")), F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves")
    )
    nodes = checkpointed(nodes)

    # of a sequence's nodes, those whose smallest member it has are its own; summed from the deepest to the root
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = path.select("conv_id", "depth", "key").join(own, ["conv_id", "depth"], "left").select("key", F.sum(F.coalesce("saved", F.lit(0))).over(deeper).alias("below"))
    saved = below.groupBy("key").agg(F.sum("below").alias("saved_tokens"))

    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = spread_join(nodes.where("depth > 0").select("key", "parent"), nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "key").select("key", "parent_conv_id")
    found = nodes.join(saved, "key").join(children, "key", "left").join(parents, "key", "left").join(ends_of(whole), "key", "left")
    return found.select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are, without rebuilding: see nodes_of()."""
    turns = checkpointed(ordered_turns(conversations))
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    return nodes_of(turns.join(sizes, "conv_id"), turns.select("conv_id").limit(0))


def last_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """conversation_trie()'s nodes with role and text of the last turn of each (null at the root), from the conversation it is named after."""
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    said = rows.select("conv_id", F.row_number().over(order).cast("long").alias("depth"), "role", "text")
    return nodes.join(said, ["conv_id", "depth"], "left")


def shared_openings(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt with shared openings: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return nodes_of(*rebuild(checkpointed(ordered_turns(conversations)))).drop("key")


SQL = r"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos, role, text
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
own as (select conv_id, list({'role': role, 'text': text} order by pos) as t from turns group by conv_id),
crc as (
  select conv_id, list_reduce([4294967295::ubigint] || list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::ubigint),
    lambda c, b: list_reduce([xor(c, b)] || [0::ubigint, 0, 0, 0, 0, 0, 0, 0], lambda x, z: if(x & 1 = 1, xor(x >> 1, 3988292384::ubigint), x >> 1))) as x
  from own),
rebuilt as (
  select o.conv_id, coalesce(list_slice(b.t, 1, h), []) || list_slice(o.t, h + 1, len(o.t)) as t
  from (select own.*, (xor(x, 4294967295::ubigint) % 4)::bigint as h from own join crc using (conv_id)) o left join own b on b.conv_id = o.conv_id - o.conv_id % 20),
members as (select conv_id, d as depth, list_slice(t, 1, d) as node, len(t) as n_turns from (select conv_id, t, unnest(range(0, len(t) + 1)) as d from rebuilt)),
nodes as (
  select node, depth, min(conv_id) as conv_id, count(*) as n_convs,
    case when depth = 0 then 0 else len(list_filter(regexp_split_to_array(node[depth].text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) end as n_words,
    string_agg(conv_id::varchar, ',' order by conv_id) filter (where n_turns = depth) as ends
  from members group by node, depth),
parents as (select c.node as node, p.node as parent, p.conv_id as parent_conv_id from nodes c join nodes p on p.depth = c.depth - 1 and p.node = list_slice(c.node, 1, c.depth - 1)),
children as (select parent as node, count(*) as n_children from parents group by parent),
pairs as (
  select distinct a.node as node, a.depth as depth, b.node as below
  from members a join members b on a.conv_id = b.conv_id and b.depth >= a.depth),
subtrees as (
  select pairs.node, count(*) filter (where n_children is null) as n_leaves, sum((n.n_convs - 1) * n.n_words) as saved_tokens
  from pairs join nodes n on n.node = pairs.below left join children c on c.node = pairs.below group by pairs.node)
select nodes.conv_id, nodes.depth, parent_conv_id, n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens::bigint as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from nodes join subtrees using (node) left join children using (node) left join parents using (node)
"""
