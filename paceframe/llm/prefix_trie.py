"""A prefix trie of conversations: a z-fast trie whose nodes are rows, searched by joins and grown in batches.

A conversation is a string of turns. It is cut into slabs of ``SLAB`` turns, so whatever its length no row holds more than one
slab: the turns' prefix hashes there and their words. A prefix hash names the whole prefix from the first turn on, so slabs of
equal beginnings hang below the same name and the tries of all slabs are one forest, searched and grown at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceframe.llm.batches import map_batches
from paceframe.llm.hot_join import join_unique
from paceframe.runtime import written

#: Turns of a slab, a power of two; joins that a fat binary search over a slab takes; ids that are joined into one string at once.
SLAB, STEPS, CHUNK = 32, 6, 8192
#: Name of the empty prefix.
ROOT = "root"
NODES = "id string, up string, root string, slab long, low int, depth int, name string, handle string, path array<string>, words array<int>"
STRINGS = "end string, root string, slab long, conv_id long, n long, path array<string>, words array<int>"
ENDS = "end string, conv_id long"


def ordered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(``conv_id``, ``pos`` from 1, ``key``, ``words``): the turns of every conversation in order, hashed, with the words of their text.

    Turns are sorted by ``turn``, NULL first, ties by the hash of role and text. Rows are dealt by range of conversation and turn
    and numbered per range; the counts of the ranges before shift them, so a long conversation is in no single task.
    NULL roles and texts are empty; rows without a conversation are left out. Starts a job.
    """
    who, what = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    key = F.md5(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, what))
    rows = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), key.alias("key"), _words(what).alias("words"))
    dealt = rows.repartitionByRange("conv_id", "turn", "key").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "turns")
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "key")
    placed = dealt.withColumn("at", F.row_number().over(inside)).join(starts, ["conv_id", "part"])
    return placed.select("conv_id", (F.col("before") + F.col("at")).alias("pos"), "key", "words")


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another: (turns, lengths), for :func:`ordered_turns`' rows.

    Conversation c becomes the first h turns of conversation c - c % ``every`` (all, if it has fewer; none, if it is absent) and
    c's own turns after its first h, with h = crc32(c in decimal) % ``most``. ``lengths`` has (``conv_id``, ``length``) of all of them,
    those left without turns too. Starts jobs.
    """
    turns = written(turns, "placed-turns")
    share = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = turns.where((F.col("conv_id") == base) & (F.col("pos") < most)).groupBy(base.alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "key", "words"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("share", share).withColumn("base", base)
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("share").cast("int")))
    convs = written(convs.withColumn("taken", F.size("head")).withColumn("key_text", F.col("conv_id").cast("string")), "conversations")
    first = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.key", "t.words")
    own = turns.where(F.col("pos") > share).withColumn("key_text", F.col("conv_id").cast("string"))
    own = join_unique(own, convs.select("key_text", "n", "share", "taken"), "key_text", "n", F.col("pos"))
    own = own.select("conv_id", (F.col("pos") - F.col("share") + F.col("taken")).alias("pos"), "key", "words")
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("share"))).alias("length"))
    return first.unionByName(own), lengths


def _joined(items: Column) -> Column:
    return F.array_join(items, "")


def _starts(blocks: DataFrame) -> DataFrame:
    """(conv_id, number, digest, body) with ``start``, a name of all blocks before, and ``next``, that with the block itself.

    Blocks are named in groups of ``SLAB``, the groups likewise, so no row or task holds a whole conversation. Equal
    beginnings have equal names. Starts a job per level.
    """
    items = F.sort_array(F.collect_list(F.struct("number", "digest", "body"))).alias("items")
    groups = blocks.groupBy("conv_id", F.floor(F.col("number") / SLAB).alias("up")).agg(items)
    whole = F.md5(_joined(F.col("items.digest")))
    if (blocks.agg(F.max("number")).first()[0] or 0) < SLAB:
        groups = groups.withColumn("before", F.lit(ROOT)).withColumn("after", F.md5(F.concat(F.lit(ROOT), whole)))
    else:
        above = _starts(groups.select("conv_id", F.col("up").alias("number"), whole.alias("digest"), F.lit(None).cast("string").alias("body")))
        above = above.select("conv_id", F.col("number").alias("up"), F.col("start").alias("before"), F.col("next").alias("after"))
        groups = written(groups, "blocks").join(above, ["conv_id", "up"])
    at = groups.select("conv_id", "before", "after", "items", F.posexplode("items").alias("i", "item"))

    def upto(n: Column) -> Column:
        return F.md5(F.concat(F.col("before"), _joined(F.slice("items.digest", F.lit(1), n))))

    start = F.when(F.col("i") == 0, F.col("before")).otherwise(upto(F.col("i")))
    end = F.when(F.col("i") == SLAB - 1, F.col("after")).otherwise(upto(F.col("i") + 1))
    return at.select("conv_id", "item.number", "item.digest", "item.body", start.alias("start"), end.alias("next"))


def slabs(turns: DataFrame) -> DataFrame:
    """(conv_id, slab, root, path, words): each slab's prefix hashes and words. The last hash of a full slab is the next one's
    root. Starts jobs."""
    number = F.floor((F.col("pos") - 1) / SLAB)
    body = F.sort_array(F.collect_list(F.struct("pos", "key", "words")))
    blocks = turns.groupBy("conv_id", number.alias("number")).agg(body.alias("body")).withColumn("digest", F.md5(_joined(F.col("body.key"))))
    named = _starts(written(blocks, "slabs"))
    keys = F.col("body.key")
    path = F.transform(F.sequence(F.lit(1), F.size("body")), lambda i: F.when(i == SLAB, F.col("next")).otherwise(F.md5(F.concat(F.col("start"), _joined(F.slice(keys, F.lit(1), i))))))
    return named.select("conv_id", F.col("number").alias("slab"), F.col("start").alias("root"), path.alias("path"), F.col("body.words").alias("words"))


def fattest(a: str, b: str) -> str:
    """SQL for the number in (a, b] that the largest power of two divides, for 0 <= a < b: b without the bits below the highest
    one in which they differ."""
    return f"CAST({b} - {b} % shiftleft(1, char_length(bin({a} ^ {b})) - 1) AS int)"


def _node(low: str, depth: str) -> list[str]:
    """SQL of a compacted node's columns; its edge covers the depths (low, depth] of the slab."""
    return [
        f"element_at(path, {depth}) AS id", f"IF({low} = 0, root, element_at(path, greatest({low}, 1))) AS up", "root", "slab", f"{low} AS low", f"{depth} AS depth",
        f"element_at(path, {low} + 1) AS name", f"element_at(path, {fattest(low, depth)}) AS handle", f"slice(path, 1, {depth}) AS path", f"slice(words, 1, {depth}) AS words",
    ]


def locate(strings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each string with its exit: ``lcp``, how many of its hashes are in the trie, and the node on whose edge it leaves (``exit``, NULL
    where it leaves at the end of a node's own edge), with that node's ``exit_depth``.

    A fat binary search: between the depths a, known to be a node's end on the string's path, and b, the handle at the two-fattest
    depth f in (a, b] is looked up. A node found there either lies on the path (a becomes its depth) or is the exit node; if none is
    found, b becomes f - 1. Each of the ``STEPS`` look-ups is a join by handle for all strings at once; a last one finds the
    child by the hash after a, where the exit edge's handle is deeper than the string follows it.
    """
    own = strings.columns
    at = strings.selectExpr(*own, "0 AS _a", "size(path) AS _b", "CAST(NULL AS string) AS exit", "CAST(NULL AS int) AS exit_depth", "CAST(NULL AS array<string>) AS _other")
    # strings that need no look-up are dealt by their own end, marked so that it is no handle
    by_handle = nodes.selectExpr("handle AS _key", "id AS _id", "depth AS _depth", "path AS _path")
    for _ in range(STEPS):
        f = fattest("_a", "_b")
        probe = at.selectExpr("*", f"IF(exit IS NULL AND _a < _b, {f}, NULL) AS _f").selectExpr("*", "coalesce(element_at(path, _f), concat('-', end)) AS _key")
        at = probe.join(by_handle, "_key", "left").selectExpr(
            *own,
            f"IF({_WHOLE}, _depth, _a) AS _a",
            "IF(_f IS NOT NULL AND _id IS NULL, _f - 1, _b) AS _b",
            f"IF(NOT {_WHOLE}, _id, exit) AS exit",
            f"IF(NOT {_WHOLE}, _depth, exit_depth) AS exit_depth",
            f"IF(NOT {_WHOLE}, _path, _other) AS _other",
        )
    by_name = nodes.selectExpr("name AS _key", "id AS _id", "depth AS _depth", "path AS _path")
    probe = at.selectExpr("*", "IF(exit IS NULL AND _a < size(path), element_at(path, _a + 1), concat('-', end)) AS _key")
    met = probe.join(by_name, "_key", "left").selectExpr(*own, "_a", "coalesce(exit, _id) AS exit", "coalesce(exit_depth, _depth) AS exit_depth", "coalesce(_other, _path) AS _other")
    same = "size(filter(zip_with(path, _other, (x, y) -> x <=> y), x -> x))"
    return met.selectExpr(*own, f"IF(_other IS NULL, _a, {same}) AS lcp", "exit", "exit_depth")


#: SQL: the node that was found lies wholly on the string's path. NULL if none was found.
_WHOLE = "(_depth <= size(path) AND element_at(path, least(_depth, size(path))) = _id)"


class PrefixTrie:
    """Compacted nodes, the different slabs of the conversations with their numbers, and where each conversation ends.

    All three are tables in the shared folder. :meth:`insert` gives a new trie; the old one stays valid.
    """

    def __init__(self, nodes: DataFrame, strings: DataFrame, ends: DataFrame) -> None:
        self.nodes, self.strings, self.ends = nodes, strings, ends

    @classmethod
    def empty(cls, spark: SparkSession) -> PrefixTrie:
        return cls(*(spark.createDataFrame([], s) for s in (NODES, STRINGS, ENDS)))

    def insert(self, turns: DataFrame, lengths: DataFrame | None = None) -> PrefixTrie:
        """Add a batch of new conversations: (conv_id, pos, key, words) as :func:`ordered_turns` gives them. ``lengths`` (conv_id,
        length) names conversations without turns; those with turns may be in it.

        All strings that are not wholly in the trie look for their exits. Per exit and next turn the longest is inserted, edges
        are split where strings leave or end, and the others search again. A round takes every waiting string at least one
        turn further, so there are at most ``SLAB`` rounds, mostly four or five. Starts jobs.
        """
        cut = written(slabs(turns), "strings")
        last = cut.groupBy("conv_id").agg(F.max(F.struct("slab", F.element_at("path", -1).alias("end"))).alias("s")).select(F.col("s.end").alias("end"), "conv_id")
        if lengths is not None:
            last = last.unionByName(lengths.where("length = 0").select(F.lit(ROOT).alias("end"), F.col("conv_id").cast("long").alias("conv_id")))
        same = cut.groupBy(F.element_at("path", -1).alias("end"), "root", "slab")
        new = same.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("path").alias("path"), F.first("words").alias("words"))
        new = written(new, "strings")
        nodes, waiting = self.nodes, new.select("end", "root", "slab", "path", "words")
        while not waiting.isEmpty():
            at = written(locate(waiting, nodes), "located")
            size = F.size("path")
            best = F.max(F.struct(size.alias("size"), "end", "root", "slab", "path", "words", "lcp")).alias("s")
            leaves = at.where(F.col("lcp") < size).groupBy(F.element_at("path", F.least(F.col("lcp") + 1, size)).alias("next")).agg(best).select("s.*")
            leaves = written(leaves.selectExpr(*_node("lcp", "size")), "leaves")
            splits = at.where(F.col("lcp") < F.col("exit_depth")).groupBy("exit").agg(F.sort_array(F.collect_set("lcp")).alias("cuts"))
            bounds = nodes.join(splits, nodes["id"] == splits["exit"], "left").selectExpr(
                "root", "slab", "path", "words", "concat(array(low), coalesce(cuts, CAST(array() AS array<int>)), array(depth)) AS bounds"
            )
            pieces = bounds.selectExpr("*", "explode(sequence(1, size(bounds) - 1)) AS i")
            whole = pieces.selectExpr("root", "slab", "path", "words", "element_at(bounds, i) AS a", "element_at(bounds, i + 1) AS b").selectExpr(*_node("a", "b"))
            nodes = written(whole.unionByName(leaves), "nodes")
            rest = at.where(F.col("lcp") < size).join(leaves.select(F.col("id").alias("end")), "end", "left_anti")
            waiting = rest.select("end", "root", "slab", "path", "words")
        strings = written(self.strings.unionByName(new.select(*self.strings.columns)), "strings")
        return PrefixTrie(nodes, strings, written(self.ends.unionByName(last), "ends"))

    def _in_slabs(self, own: DataFrame, values: list[Column], names: list[str]) -> DataFrame:
        """Aggregates of (path, ...) rows over each prefix hash on their paths: (id, names)."""
        return own.withColumn("id", F.explode("path")).groupBy("id").agg(*[v.alias(n) for v, n in zip(values, names, strict=True)])

    def compacted(self) -> DataFrame:
        """The compacted nodes with ``conv_id``, ``n_convs``, ``n_children``, ``gain`` (tokens saved on the node's own edge), ``n_leaves`` and
        ``saved`` (over the subtree, the node included). Starts jobs.

        Sums over a node's subtree are taken in its slab along the paths of the nodes there, and over deeper slabs by doubling:
        every slab root adds its total to the root twice as far above in each round.
        """
        members = self._in_slabs(self.strings, [F.min("conv_id"), F.sum("n")], ["conv_id", "n_convs"])
        children = self.nodes.groupBy("up").agg(F.count("*").alias("n_children")).withColumnRenamed("up", "id")
        nodes = self.nodes.join(members, "id").join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
        covered = F.slice("words", F.col("low") + 1, F.col("depth") - F.col("low"))
        total = F.aggregate(covered, F.lit(0).cast("long"), lambda s, w: s + w)
        nodes = written(nodes.withColumn("gain", (F.col("n_convs") - 1) * total).withColumn("leaf", (F.col("n_children") == 0).cast("long")), "counted-nodes")
        roots = nodes.where(F.col("root") != ROOT).groupBy("root").agg(F.sum("leaf").alias("leaf"), F.sum("gain").alias("gain"))
        homes = nodes.select(F.col("id").alias("root"), F.col("root").alias("above"))
        roots = roots.join(homes, "root").withColumn("above", F.when(F.col("above") != ROOT, F.col("above")))
        roots = written(roots.select("root", "above", "leaf", "gain"), "slab-roots")
        while not roots.where("above IS NOT NULL").isEmpty():
            up = roots.where("above IS NOT NULL")
            more = up.groupBy(F.col("above").alias("root")).agg(F.sum("leaf").alias("l"), F.sum("gain").alias("g"))
            further = up.select("root", "above").join(roots.select(F.col("root").alias("above"), F.col("above").alias("next")), "above").select("root", "next")
            grown = roots.drop("above").join(more, "root", "left").join(further, "root", "left")
            zero = F.lit(0)
            grown = grown.select("root", F.col("next").alias("above"), (F.col("leaf") + F.coalesce("l", zero)).alias("leaf"), (F.col("gain") + F.coalesce("g", zero)).alias("gain"))
            roots = written(grown, "slab-roots")
        below = nodes.select("path", "leaf", "gain").unionByName(roots.select(F.col("root").alias("id"), "leaf", "gain").join(nodes.select("id", "path"), "id").drop("id"))
        sums = self._in_slabs(below, [F.sum("leaf"), F.sum("gain")], ["n_leaves", "saved"])
        return nodes.drop("leaf").join(sums, "id")

    def ends_digests(self) -> DataFrame:
        """(id, ends_sha256): SHA-256 of the decimal ids of the conversations that end at a node, ascending, joined by commas.

        Ids are dealt by range of node and id and joined ``CHUNK`` at a time; a node's chunks, in order, then run through one
        digest, which no task can share, but holds no more than one chunk. Starts a job.
        """
        dealt = written(self.ends.repartitionByRange("end", "conv_id").withColumn("part", F.spark_partition_id()), "ends")
        order = Window.partitionBy("end", "part").orderBy("conv_id")
        numbered = dealt.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / CHUNK))
        ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
        chunks = numbered.groupBy("end", "part", "chunk").agg(F.array_join(ids, ",").alias("ids"))
        inorder = chunks.repartition("end").sortWithinPartitions("end", "part", "chunk").select("end", "ids")
        return map_batches(inorder, _digests, "id string, ends_sha256 string")

    def expanded(self) -> DataFrame:
        """One row per node of the uncompacted trie, the root included: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
        ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. A trie without conversations has no rows. Starts jobs."""
        nodes = written(self.compacted(), "compacted")
        top = nodes.where(F.col("up") == ROOT).agg(F.count("*"), F.sum("n_leaves"), F.sum("saved")).first()
        convs = self.ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
        numbers = {"n_children": top[0], "n_leaves": top[1] or 1, "saved": top[2] or 0}
        top = written(convs.select(F.lit(ROOT).alias("id"), "*", *[F.lit(v).cast("long").alias(n) for n, v in numbers.items()]), "top")
        parents = nodes.where("n_children > 0").select("id", "conv_id", "n_children").unionByName(top.where("n_children > 0").select("id", "conv_id", "n_children"))
        parents = written(parents.select(F.col("id").alias("up"), F.col("conv_id").alias("up_conv"), "n_children"), "parents")
        known = join_unique(nodes, parents.withColumnRenamed("n_children", "uses"), "up", "uses", F.col("id"))
        digests = self.ends_digests()
        known = known.join(digests, "id", "left")
        none = hashlib.sha256(b"").hexdigest()
        edge = known.withColumn("d", F.explode(F.sequence(F.col("low") + 1, F.col("depth"))))
        last = F.col("d") == F.col("depth")
        before = F.aggregate(F.slice("words", F.col("low") + 1, F.col("d") - F.col("low") - 1), F.lit(0).cast("long"), lambda s, w: s + w)
        inner = edge.select(
            "conv_id",
            (F.col("slab") * SLAB + F.col("d")).alias("depth"),
            F.when(F.col("d") == F.col("low") + 1, F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            "n_convs",
            F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
            "n_leaves",
            (F.col("saved") - (F.col("n_convs") - 1) * before).alias("saved_tokens"),
            F.when(last, F.coalesce("ends_sha256", F.lit(none))).otherwise(F.lit(none)).alias("ends_sha256"),
        )
        first = top.join(digests, "id", "left").select(
            "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
            F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
        return first.unionByName(inner)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per run of rows of the same node."""
    at, digest = None, None
    for batch in batches:
        done = []
        for node, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node != at:
                if at is not None:
                    done.append((at, digest.hexdigest()))
                at, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["id", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([digest.hexdigest()])], names=["id", "ends_sha256"])
