"""The prefix trie of conversations, built level by level.

A node is a distinct sequence of first turns.  Conversations with equal turns go first: one of them, the smallest id, stands for
all with its count, so that a conversation that a third of all repeat is one path.  Then, for each depth, the paths that
still share a node are grouped by (node, next turn); a group is a node of the next depth, named by its smallest conv_id.  A path
that is alone in its node needs no more grouping: its remaining turns are a chain of nodes whose values are sums along
it.  In the end joins from the deepest level up add children's leaves and savings to their parents.  So rounds grow with the
turns that different conversations share, not with the longest conversation.

Turns are compared by two 64-bit hashes of role and text (see :func:`row_key`); texts don't travel.  A level's nodes are a
table in the shared folder, so a lost executor costs a round at most.

Edge cases: null roles and texts are empty; rows without conv_id are no conversation and are left out; repeated rows are turns
of their own; turns are ordered by turn (null first), then role and text; a conversation without turns is a member of the root;
without conversations there is no node; very long texts only pass as hashes and lengths; other columns, of any names, are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argusledger.llm.common import crc32_sql, cut, partitions, scratch, small

#: Ids of one piece of a list of conversations that end at a node, at most.
PIECE = 1024
_EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): turns numbered from 0, nulls as empty texts."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "role", "text")


def _hash_ids(batches):
    """Rows (n, s1, s2, bucket, ids), sorted: one digest of all ids of each class, and its first id."""
    now, digest, first = None, None, None

    def told():
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([first], pa.int64()), pa.array([digest.hexdigest()])], names=["n", "c", "ends_sha256"])

    for batch in batches:
        for n, s1, s2, c, ids in zip(*(batch.column(x).to_pylist() for x in ("n", "s1", "s2", "c", "ids")), strict=True):
            if (n, s1, s2) != now:
                if now is not None:
                    yield told()
                now, digest, first = (n, s1, s2), hashlib.sha256(), c
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if now is not None:
        yield told()


def _ends(sized: DataFrame) -> DataFrame:
    """(n, c, ends_sha256) of each class of equal conversations, from (conv_id, n, s1, s2).

    Ids differ, so a piece has ``PIECE`` of them at most (twice that around 0); the pieces of a class, not its rows, meet in a task,
    which feeds them to one digest in their order.
    """
    # Negative ids are cut into pieces towards zero, which keeps their order too.
    pieces = sized.groupBy("n", "s1", "s2", F.expr(f"conv_id div {PIECE}").alias("bucket")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("n", "s1", "s2", "bucket", F.element_at("ids", 1).alias("c"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    dealt = pieces.repartition(partitions(sized.sparkSession), "n", "s1", "s2").sortWithinPartitions("n", "s1", "s2", "bucket")
    return dealt.mapInArrow(_hash_ids, "n long, c long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations ``convs`` (conv_id, each once), whose turns are ``turns`` (conv_id, pos, role, text)."""
    spark = convs.sparkSession
    keyed = cut(turns.select("conv_id", "pos", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("b"), "text", "role").alias("b"), F.char_length("text").cast("long").alias("chars")))
    whole = keyed.groupBy("conv_id").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(pos, a, b))").alias("s1"), F.expr("bit_xor(xxhash64(b, pos, a))").alias("s2"))
    zero = F.lit(0).cast("long")
    sized = cut(convs.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in ("n", "s1", "s2")]))
    live = cut(sized.groupBy("n", "s1", "s2").agg(F.min("conv_id").alias("c"), F.count("*").alias("m")).select("c", "n", "m"))
    paths = cut(keyed.join(small(live.select(F.col("c").alias("conv_id"))), "conv_id", "left_semi").withColumnRenamed("conv_id", "c").sortWithinPartitions("pos"))

    # Down: one round a depth.  A level holds the nodes of that depth; ``paths`` is 1 where a path is alone.
    root = live.agg(F.min("c").alias("conv_id"), F.sum("m").alias("n_convs"), F.count("*").alias("paths")).filter("conv_id is not null")
    levels = [cut(root.select("conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", zero.alias("chars"), "paths"))]
    first = levels[0].first()
    if first is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    live = live.withColumn("node", F.lit(first.conv_id))
    ended = [live.filter("n = 0").select("c", "n", "node")]
    while True:
        depth = len(levels)
        step = live.join(paths.filter(F.col("pos") == depth - 1).drop("pos"), "c")
        groups = step.groupBy("node", "a", "b").agg(F.min("c").alias("conv_id"), F.sum("m").alias("n_convs"), F.first("chars").alias("chars"), F.count("*").alias("paths"))
        level = cut(groups)
        if not level.limit(1).count():
            break
        levels.append(level.withColumnRenamed("node", "parent_conv_id"))
        shared = level.filter("paths > 1").select("node", "a", "b", F.col("conv_id").alias("next"))
        live = cut(step.join(small(shared), ["node", "a", "b"]).select("c", "n", "m", F.col("next").alias("node")))
        ended.append(live.filter(F.col("n") == depth).select("c", "n", "node"))

    # Chains: all nodes of a path from where it is alone; savings are sums from the end.
    name = ["conv_id", "parent_conv_id", "n_convs"]
    alone = [x.filter("paths = 1").select(*name, F.lit(d).cast("long").alias("top")) for d, x in enumerate(levels) if d]
    shape = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"
    chains = spark.createDataFrame([], shape)
    if alone:
        heads = alone[0]
        for x in alone[1:]:
            heads = heads.unionByName(x)
        after = Window.partitionBy("conv_id").orderBy(F.desc("pos"))
        tail = paths.withColumnRenamed("c", "conv_id").join(heads, "conv_id").filter("pos >= top - 1")
        tail = tail.withColumns({"saved": (F.col("n_convs") - 1) * F.sum("chars").over(after.rowsBetween(Window.unboundedPreceding, 0)), "last": F.row_number().over(after) == 1, "depth": F.col("pos").cast("long") + 1})
        own = F.col("depth") == F.col("top")
        chains = cut(tail.select("conv_id", "depth", F.when(own, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", F.when(F.col("last"), zero).otherwise(F.lit(1).cast("long")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), own.alias("top")))

    # Up: what children hold goes to their parents, level by level.
    below, done = None, []
    for depth in range(len(levels) - 1, -1, -1):
        kids = chains.filter(F.col("top") & (F.col("depth") == depth + 1)).select("parent_conv_id", "n_leaves", "saved_tokens")
        if below is not None:
            kids = kids.unionByName(below.select("parent_conv_id", "n_leaves", "saved_tokens"))
        sums = kids.groupBy("parent_conv_id").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("parent_conv_id", "conv_id")
        nodes = levels[depth].filter("paths > 1") if depth else levels[0]
        own = (F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved", zero)
        below = cut(nodes.join(sums, "conv_id", "left").select("conv_id", F.lit(depth).cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), own.alias("saved_tokens")))
        done.append(below)
    out = chains.drop("top")
    for x in done:
        out = out.unionByName(x)
    at = ended[0]
    for x in ended[1:]:
        at = at.unionByName(x)
    # A class ends at the node that its path shares there, or at its own chain's last.
    ends = _ends(sized).join(at, ["c", "n"], "left").select(F.coalesce("node", "c").alias("conv_id"), F.col("n").alias("depth"), "ends_sha256")
    return out.join(ends, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's conversations and their turns: the first h turns of conversation c - c % 100, then c's own after its first h."""
    turns = cut(turns)
    convs = cut(turns.groupBy("conv_id").agg(F.count("*").alias("own")).select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h"), F.expr("conv_id - conv_id % 100").alias("base")))
    start = turns.filter("pos < 5").withColumnRenamed("conv_id", "base").join(convs, "base").filter("pos < h").select("conv_id", "pos", "role", "text")
    size = turns.groupBy("conv_id").agg(F.count("*").alias("size")).withColumnRenamed("conv_id", "base")
    skip = convs.join(size, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("size", F.lit(0))).alias("first"))
    rest = turns.join(skip, "conv_id").filter("pos >= h").select("conv_id", F.expr("pos - h + first").cast("int").alias("pos"), "role", "text")
    return convs.select("conv_id"), start.unionByName(rest)


def report(conversations: DataFrame) -> DataFrame:
    """The contract's row of each node of the rebuilt conversations' trie."""
    with scratch() as made:
        out = cut(trie(*rebuilt(turns_of(conversations))))
        made.remove(out)
    return out


SQL = f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null),
c as (select conv_id, {crc32_sql("conv_id::varchar")} % 6 as h, conv_id - conv_id % 100 as base from (select distinct conv_id from t)),
built as (select c.conv_id, t.pos, t.role, t.text from c join t on t.conv_id = c.base and t.pos < c.h union all select t.conv_id, t.pos, t.role, t.text from c join t using (conv_id) where t.pos >= c.h),
turns as (select conv_id, row_number() over (partition by conv_id order by pos) as depth, sha256(length(role) || ':' || role || text) as turn, length(text) as chars from built),
member as (select conv_id, 0 as depth, '' as prefix, 0 as chars from c union all
  select conv_id, depth, sha256(string_agg(turn, '') over (partition by conv_id order by depth rows unbounded preceding)), chars from turns),
whole as (select conv_id, max(depth) as size from member group by conv_id),
node as (select depth, prefix, min(conv_id) as id, count(*) as n_convs, any_value(chars) as chars from member group by depth, prefix),
place as (select m.conv_id, m.depth, n.id from member m join node n using (depth, prefix)),
tree as (select n.*, p.id as parent from node n left join place p on p.conv_id = n.id and p.depth = n.depth - 1),
kids as (select depth - 1 as depth, parent as id, count(*) as n from tree where depth > 0 group by depth, parent),
own as (select t.*, coalesce(k.n, 0) as n_children, (t.n_convs - 1) * t.chars as saved from tree t left join kids k using (depth, id)),
rolled as (select p.depth, p.id, count(*) filter (o.n_children = 0) as n_leaves, sum(o.saved) as saved from own o join place p on p.conv_id = o.id and p.depth <= o.depth group by p.depth, p.id),
ends as (select p.depth, p.id, string_agg(w.conv_id::varchar, ',' order by w.conv_id) as ids from whole w join place p on p.conv_id = w.conv_id and p.depth = w.size group by p.depth, p.id)
select o.id as conv_id, o.depth::bigint as depth, o.parent as parent_conv_id, o.n_convs::bigint as n_convs, o.n_children::bigint as n_children, r.n_leaves::bigint as n_leaves, r.saved::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from own o join rolled r using (depth, id) left join ends e using (depth, id)
"""
