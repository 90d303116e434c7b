"""Parent-child rows to hierarchies, by tree contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborix.session import Scratch

ENDS = ("", "NA", ".")


def nodes(df: DataFrame, scope: Column, node: Column, parent: Column) -> DataFrame:
    """scope, node, parent_key: one row a node.

    A null node is none; a null scope is the empty one. A null, empty, `NA` or `.` parent is none. Repeated rows count
    once; of several parents of one node the smallest counts. No rows give no nodes, and every result below is empty.
    """
    real = F.when(~parent.isin(*ENDS), parent)
    return df.where(node.isNotNull()).groupBy(F.coalesce(scope, F.lit("")).alias("scope"), node.alias("node")).agg(F.min(real).alias("parent_key"))


class Forest:
    """A contraction of node rows and what its reversal recovers.

    Leaves are raked, and unary nodes whose salted hash is smaller than their child's and their parent's are spliced
    out of their chain, round after round: a chain shrinks to two thirds and a bush loses a layer each round, so the
    rounds grow with the logarithm of chains' length. A parent that is null makes a root. What never ends contracts to
    a node that is its own parent (as a node that names itself does from the start): the core of a cycle, with the
    smallest key spliced into it. Each round's removed nodes are written with the parent they had then; reversed, each
    gets root, depth and path from that parent.

    Sizes of subtrees go the same way: a raked node's size is complete and is added to its parent in the next round; a
    spliced one leaves its size on its child's link (``more``) and is recovered as that, its own part and its child's.

    Keys become integers in key order (scope first), so the smallest id on a cycle is its smallest key. Each round is
    a table in the shared folder; nothing is collected but emptiness. The salt of a round is a column, so that all rounds
    run the same compiled code.
    """

    def __init__(self, rows: DataFrame, paths: bool = False):
        self.spark = rows.sparkSession
        self.scratch = Scratch(self.spark, "forest")
        self.paths = paths
        self.keys = self.scratch.write(rows.repartitionByRange("scope", "node").sortWithinPartitions("scope", "node").withColumn("id", F.monotonically_increasing_id()), "keys")
        up = self.keys.select(F.col("scope").alias("s"), F.col("node").alias("n"), F.col("id").alias("pid"))
        k = self.keys
        linked = k.join(up, (k.scope == up.s) & (k.parent_key == up.n), "left").select("id", "pid", *["node"] * paths)
        seg = [F.array("node").alias("seg")] if paths else []
        none, one = F.lit(None).cast("long"), F.lit(1).cast("long")
        state = F.when(F.col("pid").isNull(), "root").when(F.col("pid") == F.col("id"), "core").otherwise("live")
        live = linked.select("id", "pid", one.alias("w"), F.col("id").alias("least"), one.alias("size"), (one - 1).alias("more"), none.alias("child"), none.alias("part"), F.lit(1).alias("salt"), *seg, state.alias("state"))
        self.rounds = ["round0"]
        self.schema = self.scratch.write(live, "round0").schema
        self.contract()

    def contract(self) -> None:
        c, h = F.col, lambda k: F.xxhash64("salt", k)
        alive = c("state") == "live"
        sums = F.count(F.when(alive, 1)).alias("n"), F.min(F.when(alive, c("id"))).alias("child"), F.min(F.when(alive, c("more"))).alias("below"), F.sum(F.when(~alive, c("size") + c("more"))).alias("raked")
        size, at = (c("size") + F.coalesce("raked", F.lit(0))).alias("size"), c("pid").alias("at")
        local = (c("n") == 1) & (h("id") < h("child")) & (h("id") < h("pid")) & (c("child") != c("pid"))
        two = (c("n") == 1) & (c("child") == c("pid")) & (h("id") < h("pid"))
        cut = F.coalesce(local | two, F.lit(False)).alias("cut")
        removed = [c("id").alias("gid"), c("pid").alias("gp"), c("w").alias("gw"), c("least").alias("gl"), (c("size") + c("more")).alias("gm"), *[c("seg").alias("gs")] * self.paths]
        pid = F.coalesce("gp", "pid")
        state = F.when(c("cut"), "spliced").when(F.coalesce("n", F.lit(0)) == 0, "raked").when(pid == c("id"), "core").otherwise("live").alias("state")
        kept = [
            c("id"), pid.alias("pid"), (c("w") + F.coalesce("gw", F.lit(0))).alias("w"), F.least("least", "gl").alias("least"), c("size"), (c("more") + F.coalesce("gm", F.lit(0))).alias("more"),
            F.when(c("cut"), c("child")).alias("child"), F.when(c("cut"), c("size") + c("below")).alias("part"), (c("salt") + 1).alias("salt"), *[F.when(c("gs").isNotNull(), F.concat("gs", "seg")).otherwise(c("seg")).alias("seg")] * self.paths, state,
        ]
        carried = [k for k in self.schema.names if k not in ("state", "child", "part", "size")]
        linked, spliced = c("id") == c("at"), c("pid") == c("gid")
        while True:
            last = self.scratch.read(self.rounds[-1:], self.schema).where("state in ('live', 'raked')")
            live = last.where(alive)
            if not live.take(1):
                break
            below = last.groupBy(at).agg(*sums)
            marked = live.drop("child", "part").join(below, linked, "left").select(*carried, size, "n", "child", "below").select("*", cut)
            gone = marked.where("cut").select(*removed)
            name = f"round{len(self.rounds)}"
            self.scratch.write(marked.join(gone, spliced, "left").select(*kept), name)
            self.rounds.append(name)

    def resolved(self, kind: str | None = None, sizes: bool = False) -> DataFrame:
        """id, root, kind (`root` or `core`), least (of a core's cycle), depth, path (keys from the root to the node).

        With a kind, only what ends there: the reversal starts from those tops alone. ``sizes`` adds the nodes of the
        subtree, itself included (of trees that end at a root).
        """
        seg, size = self.paths, ["size"] if sizes else []
        c = F.col
        done: list[str] = []
        tops = self.scratch.read(self.rounds, self.schema).where(c("state").isin(kind) if kind else c("state").isin("root", "core"))
        out = tops.select("id", c("id").alias("root"), c("state").alias("kind"), "least", F.lit(0).cast("long").alias("depth"), *[c("seg").alias("path")] * seg, *size)
        if sizes:
            raked = self.scratch.read(self.rounds, self.schema).where("state = 'raked'").groupBy(c("pid").alias("id")).agg(F.sum(c("size") + c("more")).alias("sum"))
            out = out.join(raked, "id", "left").withColumn("size", c("size") + F.coalesce("sum", F.lit(0))).drop("sum")
        schema = self.scratch.write(out, "tops").schema
        done.append("tops")
        for name in reversed(self.rounds[1:]):
            before = self.scratch.read(done, schema)
            rows = self.scratch.read([name], self.schema).where("state in ('raked', 'spliced')")
            if sizes:
                whole = before.select(c("id").alias("below"), c("size").alias("of")).unionByName(rows.where("state = 'raked'").select(c("id").alias("below"), c("size").alias("of")))
                spliced = rows.where("state = 'spliced'").join(whole, c("child") == c("below"), "left").withColumn("size", c("part") + c("of")).select(*rows.columns)
                rows = rows.where("state = 'raked'").unionByName(spliced)
            known = before.select(c("id").alias("kid"), "root", "kind", c("least").alias("kl"), "depth", *["path"] * seg)
            got = rows.join(known, rows["pid"] == known["kid"]).select("id", "root", "kind", c("kl").alias("least"), (c("depth") + c("w")).alias("depth"), *[F.concat("path", "seg").alias("path")] * seg, *size)
            self.scratch.write(got, f"up-{name}")
            done.append(f"up-{name}")
        return self.scratch.read(done, schema)

    def endless(self) -> DataFrame:
        """scope, node, cycle_key: the nodes whose chain of parents never ends."""
        names = self.keys.select("id", "scope", "node")
        core = self.resolved("core").select("id", "least")
        least = names.select(F.col("id").alias("least"), F.col("node").alias("cycle_key"))
        return core.join(least, "least").join(names, "id").select("scope", "node", "cycle_key")

    def tree(self, sizes: bool = False) -> DataFrame:
        """scope, node, root, depth, path (keys from the root to the node) of each node whose chain ends; a table.

        ``sizes`` adds n_descendants.
        """
        names = self.keys.select("id", "scope", "node")
        rows = self.resolved("root", sizes).select("id", F.col("depth").cast("int").alias("depth"), "path", *[(F.col("size") - 1).alias("n_descendants")] * sizes).join(names, "id")
        return self.scratch.write(rows.select("scope", "node", F.get("path", F.lit(0)).alias("root"), "depth", "path", *["n_descendants"] * sizes), f"tree-{sizes}")


def hierarchy(rows: DataFrame) -> DataFrame:
    """scope, node, root, depth, path (keys from the root to the node), n_descendants of each node whose chain ends."""
    return Forest(rows, paths=True).tree(sizes=True)


def descendants(tree: DataFrame) -> DataFrame:
    """scope, ancestor, node, distance of each node and each ancestor, from the paths of hierarchy."""
    above = F.slice("path", F.lit(1), F.size("path") - 1)
    pairs = tree.where("depth > 0").select("scope", "node", "depth", F.posexplode(above).alias("at", "ancestor"))
    return pairs.select("scope", "ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))
