"""The dependency graph: lookups, impact, cycles, coupling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def synthetic_edges(documents: DataFrame) -> DataFrame:
    """src, dst between document ids: i -> (7i + 3) mod N, and i -> i div 2 for every fifth; no self edges."""
    n = F.broadcast(documents.agg(F.count(F.lit(1)).alias("n")))  # one row
    i = F.col("doc_id")
    d = documents.select("doc_id").join(n).select(i.alias("src"), F.explode(F.array(F.pmod(7 * i + 3, F.col("n")), F.when(i % 5 == 0, F.floor(i / 2)))).alias("dst"))
    return d.where("dst is not null and src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """file, n_out, n_in of all files with an edge: one pass, combined before the shuffle."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("file"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("file"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return both.groupBy("x.file").agg(F.sum("x.o").alias("n_out"), F.sum("x.i").alias("n_in"))


def neighbours(edges: DataFrame, both: bool = True) -> DataFrame:
    """file, other."""
    out = edges.select(F.col("src").alias("file"), F.col("dst").alias("other"))
    return out.unionByName(edges.select(F.col("dst").alias("file"), F.col("src").alias("other"))).distinct() if both else out


def impact(changed: DataFrame, *graphs: DataFrame) -> DataFrame:
    """file: the changed ones and their neighbours in any of the graphs. changed: file."""
    every = None
    for g in graphs:
        every = neighbours(g) if every is None else every.unionByName(neighbours(g))
    near = every.join(changed, "file").select(F.col("other").alias("file"))
    return near.unionByName(changed.select("file")).distinct()


def dependents_within_two(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """file, hit: who depends on a changed file directly or through one other (itself left out)."""
    back = edges.select(F.col("dst").alias("file"), F.col("src").alias("hit"))
    one = changed.join(back, "file").select("file", "hit")
    two = one.join(back.select(F.col("file").alias("hit"), F.col("hit").alias("far")), "hit").select("file", F.col("far").alias("hit"))
    return one.unionByName(two).distinct().where("file <> hit")


def cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """cycle (ids joined by >), length: simple cycles up to a length, told once, from their smallest node on."""
    step = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    paths = edges.select(F.array("src", "dst").alias("p")).where(F.col("p")[0] < F.col("p")[1])
    out = None
    for n in range(2, longest + 1):
        grown = paths.join(step, F.element_at("p", -1) == F.col("_s"))
        closed = grown.where(F.col("_d") == F.col("p")[0]).select(F.array_join(F.col("p").cast("array<string>"), ">").alias("cycle"), F.lit(n).cast("long").alias("length"))
        out = closed if out is None else out.unionByName(closed)
        if n < longest:
            paths = grown.where((F.col("_d") > F.col("p")[0]) & ~F.array_contains("p", F.col("_d"))).select(F.concat("p", F.array("_d")).alias("p"))
    return out


#: Steps along edges between two writes.
HOPS = 3


class Chains:
    """Files with one edge out, passed over: edges into such a file lead to the first file on its way that has none or several.

    Ways are followed by doubling (jumps[k]: file, to (2**k edges on, or the end of the way before), least (file passed)), so
    a way of any length takes the logarithm of it in joins. Ways that never end run into a circle; that circle is a component.
    """

    def __init__(self, live: DataFrame, written: Callable[[DataFrame, str], DataFrame]):
        """live: src, dst."""
        one = live.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to")).where("n = 1")
        self.live, self.written, self.jumps = live, written, [written(one.select(F.col("src").alias("file"), "to", F.col("src").alias("least")), "jumps")]
        before = None
        while True:
            a, b = self.jumps[-1], self.jumps[-1].toDF("_f", "_to", "_least")
            far = a.join(b, F.col("to") == F.col("_f"), "left")
            s = far.where("_f is not null").agg(F.count(F.lit(1)), F.countDistinct("to"), F.count_if(F.col("_least") < F.col("least"))).first()
            if not s[0] or (tuple(s[:2]) == before and not s[2]):
                break
            before = tuple(s[:2])
            self.jumps.append(written(far.select("file", F.coalesce("_to", "to").alias("to"), F.least("least", F.coalesce("_least", "least")).alias("least")), "jumps"))
        last, chain = self.jumps[-1], self.jumps[0].select(F.col("file").alias("to"))
        endless = last.join(chain, "to", "left_semi")
        self.ends = written(last.join(chain, "to", "left_anti").select("file", F.col("to").alias("end")), "ends")
        self.circles = written(endless.join(endless.select(F.col("to").alias("file")).distinct(), "file", "left_semi").select("file", F.col("least").alias("colour")), "circles")
        into = live.join(chain.withColumnRenamed("to", "src"), "src", "left_anti").join(self.ends, F.col("dst") == F.col("file"), "left")
        into = into.select("src", "dst", "end").join(endless.select(F.col("file").alias("dst")), "dst", "left_anti")
        self.into = written(into, "into")  # from files that stay
        self.short = written(self.into.select("src", F.coalesce("end", "dst").alias("dst")).where("src <> dst").distinct(), "edges")

    def coloured(self, found: DataFrame) -> DataFrame:
        """file, colour: the circles, and the files passed over that are in a component of found (file, colour, of files that
        stay): what lies behind an edge from the component that the way ends in."""
        c = lambda name: found.toDF(name, f"c_{name}")
        met = self.into.where("end is not null").join(c("src"), "src", "left").join(c("end"), "end", "left")
        met = met.withColumn("colour", F.coalesce("c_end", "end")).where(F.coalesce("c_src", "src") == F.col("colour"))
        met = met.select(F.col("dst").alias("file"), "colour").distinct()
        ends = met.select(F.col("colour").alias("file"), "colour").distinct()  # an end may be in no other component
        passed = self.jumps[0].select("file")
        for jump in self.jumps:
            far = met.join(jump, "file").select(F.col("to").alias("file"), "colour").join(passed, "file", "left_semi")
            met = self.written(met.unionByName(far).distinct(), "met")
        alone = ends.join(found.select("colour").distinct(), "colour", "left_anti")
        return met.unionByName(alone.select("file", "colour")).unionByName(self.circles)


def components(edges: DataFrame, written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """file, component: the strongly connected component of each file with an edge, named by its smallest file.

    Files without an edge in or out are components of their own and are trimmed; those with one edge out, or one in, are passed
    over (Chains), so that long ways and circles cost the logarithm of their length. Of the rest each takes the largest file that
    reaches it as its colour; those of a colour that reach the file it is named after are its component (forward colouring
    and a backward search inside each colour, all colours at once). What is found is taken out, and the rest starts anew.
    written(df, name): df written to a shared folder and read back, so that lineage does not grow with the rounds. Paths are
    enumerated nowhere; the driver sees counts only.
    """
    live = written(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    files = live.select(F.col("src").alias("file")).unionByName(live.select(F.col("dst").alias("file"))).distinct()
    found, n, over = None, live.count(), []
    turned = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    while n:
        trimmed = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        live, before = written(trimmed.select("src", "dst"), "edges"), n
        n = live.count()
        if n < 0.9 * before or not n:
            continue  # cheap, while it takes much away
        before = n
        for turn in (False, True):
            if not n or live.groupBy("dst" if turn else "src").count().where("count = 1").count() < 0.1 * n:
                continue
            over.append(Chains(turned(live) if turn else live, written))
            live = turned(over[-1].short) if turn else over[-1].short
            n = live.count()
        if n < 0.9 * before or not n:
            continue
        colours = written(live.select(F.col("src").alias("file")).distinct().withColumn("colour", F.col("file")), "colours")
        while True:
            new = colours
            for _ in range(HOPS):
                came = live.join(new, F.col("src") == F.col("file")).select(F.col("dst").alias("file"), "colour")
                new = new.unionByName(came).groupBy("file").agg(F.max("colour").alias("colour"))
            new = written(new, "colours")
            moved = new.withColumnRenamed("colour", "c").join(colours, "file").where("c <> colour").limit(1).count()
            colours = new
            if not moved:
                break
        c = lambda side: colours.select(F.col("file").alias(side), F.col("colour").alias(f"c_{side}"))
        inside = written(live.join(c("src"), "src").join(c("dst"), "dst").where("c_src = c_dst").select("src", "dst"), "inside")
        core = colours.where("file = colour").select("file", "colour")
        have = core.count()
        while True:
            for _ in range(HOPS):
                back = inside.join(core, F.col("dst") == F.col("file")).select(F.col("src").alias("file"), "colour")
                core = core.unionByName(back).distinct()
            core = written(core, "core")
            was, have = have, core.count()
            if have == was:
                break
        found = core if found is None else found.unionByName(core)
        gone = core.select("file")
        live = live.join(gone.withColumnRenamed("file", "src"), "src", "left_anti").join(gone.withColumnRenamed("file", "dst"), "dst", "left_anti")
        live = written(live.select("src", "dst"), "edges")
        n = live.count()
    found = files.limit(0).withColumn("colour", F.col("file")) if found is None else found
    for chains in reversed(over):
        found = written(found.unionByName(chains.coloured(found)), "found")
    least = found.groupBy("colour").agg(F.min("file").alias("component"))
    named = found.join(least, "colour").select("file", "component")
    return files.join(named, "file", "left").select("file", F.coalesce("component", "file").alias("component"))


def coupling(edges: DataFrame) -> DataFrame:
    """file, ca, ce, instability. Only files with a dependency, and edges to those, count."""
    ce = edges.groupBy(F.col("src").alias("file")).agg(F.count(F.lit(1)).alias("ce"))
    ca = edges.groupBy(F.col("dst").alias("file")).agg(F.count(F.lit(1)).alias("ca"))
    return ce.join(ca, "file", "left").select("file", F.coalesce("ca", F.lit(0).cast("long")).alias("ca"), "ce", F.round(F.col("ce") / (F.col("ce") + F.coalesce("ca", F.lit(0))), 6).alias("instability"))
