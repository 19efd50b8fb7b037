"""MinHash near-dedup as a chosen-path set similarity join.

Texts with equal shingle sets are one class, represented by its smallest id. Each of `TREES` independent trees files a
class under one minwise token of its own, so that the classes of a node agree in it. A node of at most `LEAF` classes is
small: its classes are compared exhaustively, by sketch. A larger node is first dealt into parts of that size, each of
which is compared exhaustively. If few pairs of a small node are likely alike, all of them are candidates and the node is
done; else each member names two (its likeliest, and the likely one that is first in an order common to all nodes), which
joins a group of near copies without naming its pairs. Candidates are confirmed on the full sets and joined to components.

What is left are links between different components that meet in a node which is not done. Of such a node the members
outside its largest component are compared exhaustively with all others if they are few. Otherwise the node branches: in
`REPEATS` repetitions each member goes on by `TOKENS` more tokens of its sketch, chosen at random for the node, and the
children are treated alike, down to `DEPTH`, where what is left is compared in blocks. Found pairs are confirmed on the
full sets as well. So neither the pairs of a group of thousands nor its members are ever gathered in one task.

Recall: a pair of similarity s shares a node of one tree with probability s, and misses all `TREES` = 8 with (1 - s) ** 8
(1.5e-5 at 0.75, less above). A branching keeps a pair with probability 1 - (1 - s ** 3) ** 4: 0.89 at 0.75, so that where
all eight nodes branch twice 8e-4 miss at 0.75 and 5e-5 at 0.8. The sketch leaves out 3e-5 of the pairs at 0.75.

Joins that carry sketches or texts are sort-merge joins at every size, so that the plan does not change with the input.

Defined cases: null, empty and wordless texts have no shingles, and a null id has no links: these rows link with nothing.
Rows that repeat an id are one document, linked by each of their texts. A text of any length is read whole, as its own step
if it is long. An empty table gives an empty result. Columns of the input named like a result column are replaced, any
other names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, limit_arrow_rows, materialize, mix, restored, rolling, row_hash, scratch, shielded, small_side, steps
from .components import components

SHINGLE = 5
TREES = 8
SKETCH = 256
#: Estimated similarity from which pairs are confirmed: four standard deviations of the sketch below 0.75.
LIKELY = 0.64
#: Members that one task compares with one another.
LEAF = 512
#: A branching: repetitions, and tokens that a path takes in each.
REPEATS, TOKENS = 4, 3
DEPTH = 4
ADDED = ["n_shingles", "component_id", "kept"]
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, SKETCH + TREES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    w = Words([t.translate(_LOWER) for t in texts])
    r = rolling(w.hash, SHINGLE)
    out = []
    for i, n in enumerate(w.count()):
        a = w.first[i]
        if n >= SHINGLE:
            out.append(np.unique(r[a : a + n - SHINGLE + 1]))
        elif n:
            out.append(mix(np.bitwise_xor.reduce(mix(w.hash[a : a + n] + np.arange(1, n + 1, dtype=np.uint64)))[None] + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minwise(s: np.ndarray) -> np.ndarray:
    """TREES + SKETCH minwise tokens (32 bits) of a set."""
    best = np.full(len(_SEEDS), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(s), 1024):
        best = np.minimum(best, ((s[i : i + 1024, None] * _SEEDS) >> np.uint64(32)).min(axis=0))
    return best


SKETCHES = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("roots", T.ArrayType(T.IntegerType())), T.StructField("sketch", T.BinaryType())])


def sketches(docs: DataFrame) -> DataFrame:
    """SKETCHES of each row. docs: id, h, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in steps(batch, "text"):
                sets = shingle_sets(texts)
                tokens = np.stack([minwise(s) for s in sets])
                s1 = np.fromiter((mix(np.bitwise_xor.reduce(mix(s))[None])[0] if len(s) else 0 for s in sets), np.uint64, len(sets))
                s2 = np.fromiter((np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) if len(s) else 0 for s in sets), np.uint64, len(sets))
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                roots = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * TREES, pa.array(np.ascontiguousarray(tokens[:, :TREES]).astype(np.uint32).view(np.int32).ravel()))
                sketch = pa.array([bytes(x) for x in tokens[:, TREES:].astype(np.uint8)], pa.binary())
                part = batch.slice(rows.start, len(sets))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), roots, sketch], SKETCHES.names)

    return docs.select("id", "h", "text").mapInArrow(run, SKETCHES)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, row by row; equal bytes also occur by chance."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def sized(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """May sets of these sizes be alike?"""
    return 4 * np.minimum(a, b) >= 3 * np.maximum(a, b)


def rows_of(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)


def likely_pairs(start: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, est) with j < i of the likely pairs within groups of consecutive rows. start: where each row's group begins."""
    at, other, est = [], [], []
    i = np.arange(len(start))
    for lag in range(1, int((i - start).max(initial=0)) + 1):
        x = i[i - start >= lag]
        x = x[sized(size[x], size[x - lag])]
        for k in range(0, len(x), 4096):
            y = x[k : k + 4096]
            e = likeness(sketch[y], sketch[y - lag])
            ok = e >= LIKELY
            at.append(y[ok])
            other.append(y[ok] - lag)
            est.append(e[ok])
    return (np.concatenate(at), np.concatenate(other), np.concatenate(est)) if at else (i[:0], i[:0], np.zeros(0))


#: What compared() says: a candidate (ALL), a member's likeliest (BEST), its first in the common order (FIRST), a node that is not done (AGAIN).
ALL, BEST, FIRST, AGAIN = range(4)
COMPARED = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("score", T.DoubleType())])


def compared(members: DataFrame) -> DataFrame:
    """members (node, part, parts, rank, id, n_shingles, sketch) -> COMPARED: every part compared exhaustively, by sketch."""
    cols = ["node", "part", "parts", "rank", "id", "n_shingles", "sketch"]
    dealt = members.select(*cols).repartition("node", "part").sortWithinPartitions("node", "part", "rank", "id")

    def whole(columns: list[np.ndarray]) -> pa.RecordBatch:
        node, part, parts, rank, ids, size, sketch = columns
        new = np.concatenate([[True], (node[1:] != node[:-1]) | (part[1:] != part[:-1])])
        head = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        i, j, est = likely_pairs(head[group], size, sketch)
        done = (parts[head] == 1) & (np.bincount(group[i], minlength=len(head)) <= 2 * np.diff(np.append(head, len(node))))
        every = done[group[i]]
        out = [(ALL, i[every], j[every], est[every])]
        i, j, est = i[~every], j[~every], est[~every]
        if len(i):
            by = np.lexsort((est, i))
            last = by[np.append(i[by][1:] != i[by][:-1], True)]
            out.append((BEST, i[last], j[last], est[last]))
            by = np.lexsort((-j, i))
            last = by[np.append(i[by][1:] != i[by][:-1], True)]
            out.append((FIRST, i[last], j[last], -rank[j[last]].astype(np.float64)))
        kinds = np.concatenate([np.full(len(x), k, np.int32) for k, x, _, _ in out])
        x, y, score = (np.concatenate([o[k] for o in out]) for k in (1, 2, 3))
        again = np.unique(node[head[~done]])
        kinds = np.append(kinds, np.full(len(again), AGAIN, np.int32))
        none = pa.nulls(len(again), pa.int64())
        joined = lambda a, b: pa.concat_arrays([pa.array(a), b])
        return pa.RecordBatch.from_arrays([pa.array(kinds), joined(node[x], pa.array(again)), joined(ids[x], none), joined(ids[y], none), joined(score, none.cast(pa.float64()))], COMPARED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [*(np.asarray(batch.column(k)) for k in range(6)), rows_of(batch.column(6))]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            tail = int(np.flatnonzero((now[0] == now[0][-1]) & (now[1] == now[1][-1]))[0])  # its group may go on
            held = [x[tail:] for x in now]
            if tail:
                yield whole([x[:tail] for x in now])
        if held is not None:
            yield whole(held)

    return dealt.mapInArrow(run, COMPARED)


def texts_of(ids: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, text) of some representatives (ids may repeat). docs: id, h, text."""
    wanted = ids.distinct().join(reps.select("id", "h"), "id").select(F.col("id").alias("_i"), F.col("h").alias("_h"))
    wanted = small_side(materialize(wanted, "near-wanted"))
    found = docs.join(wanted, (F.col("id") == F.col("_i")) & (F.col("h") == F.col("_h")), "left_semi")
    return materialize(found.dropDuplicates(["id", "h"]).select("id", "text"), "near-texts")


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Is 100 * intersection >= 75 * union, of two sorted sets that are not empty?"""
    both = int((y[np.minimum(y.searchsorted(x), len(y) - 1)] == x).sum())
    return 100 * both >= 75 * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """pairs (a, b) whose full sets are alike."""
    texts = texts_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), docs, reps)
    one, two = (texts.select(F.col("id").alias(k), F.col("text").alias(t)).hint("merge") for k, t in (("a", "x"), ("b", "y")))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for rows, texts in steps(batch, "x"):
                other = [x or b"" for x in batch.column(3).slice(rows.start, len(texts)).cast(pa.binary()).to_pylist()]
                known = sorted({*texts, *other})  # a group's first member is in many of its pairs
                sets = dict(zip(known, shingle_sets(known), strict=True))
                for i, (x, y) in enumerate(zip(texts, other, strict=True)):
                    ok[rows.start + i] = alike(sets[x], sets[y])
            if ok.any():
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a long, b long").distinct()


LIKELY_ROWS = "node long, part long, role int, id long, component long, sketch binary, n_shingles long"


def likely(nodes: DataFrame) -> DataFrame:
    """The rows of nodes (LIKELY_ROWS) that are likely alike to one of another component in their part, by sketch."""
    cols = ["node", "part", "role", "id", "component", "sketch", "n_shingles"]
    dealt = nodes.select(*cols).repartition("node", "part").sortWithinPartitions("node", "part", F.desc("role"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, told = None, None, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            node, place, role, ids, comp = (np.asarray(batch.column(i)) for i in range(5))
            sk, size = rows_of(batch.column(5)), np.asarray(batch.column(6))
            out: list[tuple] = []
            cut = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (place[1:] != place[:-1])]))
            for s, e in zip(cut, np.append(cut[1:], len(ids)), strict=True):
                if key != (node[s], place[s]):
                    key, held, told = (node[s], place[s]), [x[:0] for x in (ids, comp, sk, size, role)], set()
                m = s + int((role[s:e] > STREAMED).sum())
                held = [np.concatenate([x, y[s:m]]) for x, y in zip(held, (ids, comp, sk, size, role), strict=True)]
                if not len(held[0]):
                    continue

                def tell(t: int, held: list = held, told: set = told, key: tuple = key, out: list = out) -> None:
                    if t not in told:
                        told.add(t)
                        out.append((*key, int(held[4][t]), int(held[0][t]), int(held[1][t]), held[2][t].tobytes(), int(held[3][t])))

                at = {int(x): t for t, x in enumerate(held[0])}
                for i in range(s if role[s] == MUTUAL else m, e, 256):
                    j = slice(i, min(e, i + 256))
                    r, c = np.nonzero((comp[j, None] != held[1]) & sized(size[j, None], held[3]))
                    for k in range(0, len(r), 8192):
                        x, y = r[k : k + 8192], c[k : k + 8192]
                        near = likeness(sk[j][x], held[2][y]) >= LIKELY
                        for t in np.unique(x[near]) + i:
                            if role[t] == STREAMED:
                                out.append((*key, STREAMED, int(ids[t]), int(comp[t]), sk[t].tobytes(), int(size[t])))
                            else:
                                tell(at[int(ids[t])])
                        for t in np.unique(y[near]).tolist():
                            tell(t)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], cols)

    return dealt.mapInArrow(run, LIKELY_ROWS).distinct()


def across(nodes: DataFrame) -> DataFrame:
    """nodes (LIKELY_ROWS and text) -> links (a, b) between different components.

    Within a (node, part) the held rows come first; each row is compared with them, by sketch and then by full sets, unless
    links found in this part have joined their components already.
    """
    cols = ["node", "part", "role", "id", "component", "sketch", "n_shingles", "text"]
    dealt = nodes.select(*cols).repartition("node", "part").sortWithinPartitions("node", "part", F.desc("role"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, root = None, [], {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        for batch in batches:
            a, b = [], []
            for some, texts in steps(batch, "text"):
                part = batch.slice(some.start, len(texts))
                node, place, role, ids, comp = (np.asarray(part.column(i)) for i in range(5))
                sk, size = rows_of(part.column(5)), np.asarray(part.column(6))
                sets: dict[int, np.ndarray] = {}

                def full(i: int, texts: list[bytes] = texts, sets: dict = sets) -> np.ndarray:
                    if i not in sets:
                        sets[i] = shingle_sets([texts[i]])[0]
                    return sets[i]

                cut = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (place[1:] != place[:-1])]))
                for s, e in zip(cut, np.append(cut[1:], len(ids)), strict=True):
                    if key != (node[s], place[s]):
                        key, held, root = (node[s], place[s]), [], {}
                    m = s + int((role[s:e] > STREAMED).sum())
                    for i in range(s, m):
                        held.append((ids[i], comp[i], sk[i], size[i], [None, texts[i]]))
                    if not held:
                        continue
                    hid, hcomp, hsk, hn = (np.array([x[k] for x in held]) for k in range(4))
                    for i in range(s if role[s] == MUTUAL else m, e, 256):
                        j = slice(i, min(e, i + 256))
                        r, c = np.nonzero((comp[j, None] != hcomp) & sized(size[j, None], hn))
                        for k in range(0, len(r), 8192):
                            est = likeness(sk[j][r[k : k + 8192]], hsk[c[k : k + 8192]])
                            for x, y in zip(r[k : k + 8192][est >= LIKELY] + i, c[k : k + 8192][est >= LIKELY], strict=True):
                                one, two = find(int(comp[x])), find(int(hcomp[y]))
                                if one == two:
                                    continue
                                hold = held[y][4]
                                if hold[0] is None:
                                    hold[0] = shingle_sets([hold[1]])[0]
                                if alike(full(int(x)), hold[0]):
                                    root[max(one, two)] = min(one, two)
                                    a.append(int(ids[x]))
                                    b.append(int(hid[y]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def mixed_members(level: DataFrame, labels: DataFrame) -> DataFrame:
    """node, id, component, n (members of the node), main (its largest component), out (members of others) where out > 0."""
    known = level.join(labels.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("node", "id", F.coalesce("component", "id").alias("component"))
    known = materialize(known, "near-level")
    sizes = known.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most")).where("n > most.n")
    return known.join(sizes.select("node", "n", F.col("most.component").alias("main"), (F.col("n") - F.col("most.n")).alias("out")), "node")


def merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels (id, component) after the links found (a, b); components are joined, not their members."""
    ids = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).distinct()
    all_labels = materialize(labels.unionByName(ids.join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))), "near-labels")
    one = all_labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    two = all_labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    joined = components(found.join(one, "a").join(two, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("id").alias("_c"), F.col("component").alias("_to"))
    out = all_labels.join(joined, F.col("component") == F.col("_c"), "left").select("id", F.coalesce("_to", "component").alias("component"))
    return materialize(out, "near-components")


def candidates(found: DataFrame) -> DataFrame:
    """(a, b), a > b: the pairs that compared() names; of what a member names in several nodes, one of each kind."""
    named = found.where(F.col("kind").isin(BEST, FIRST)).groupBy("a", "kind").agg(F.max(F.struct("score", "b")).alias("x")).select("a", "x.b")
    both = found.where(F.col("kind") == ALL).select("a", "b").unionByName(named)
    return both.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


#: What a row is in a part: streamed past the held ones, held, or held and compared with the other held ones too.
STREAMED, HELD, MUTUAL = range(3)


def dealt_parts(mixed: DataFrame, traits: DataFrame) -> DataFrame:
    """The rows for likely(). Those outside the largest component are held, in blocks of LEAF, in each part of the node; the
    others are streamed in one part of each block, and those outside in one of each later block."""
    ready = mixed.join(traits, "id").withColumn("outside", F.col("component") != F.col("main"))
    ready = ready.withColumn("parts", F.ceil(F.col("n") / LEAF).cast("int")).withColumn("blocks", F.ceil(F.col("out") / LEAF).cast("int"))
    ready = ready.withColumn("pick", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    place = lambda p, b, role: F.struct((p * F.col("blocks") + b).cast("long").alias("part"), role.alias("role"))
    held = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: place(p, F.col("block"), F.when(p == 0, MUTUAL).otherwise(HELD)))
    later = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: ~F.col("outside") | (b > F.col("block")))
    streamed = F.transform(later, lambda b: place(F.col("pick"), b, F.lit(STREAMED)))
    return ready.withColumn("x", F.explode(F.when(F.col("outside"), F.concat(held, streamed)).otherwise(streamed))).select("node", "x.part", "x.role", "id", "component", "sketch", "n_shingles")


def branched(rest: DataFrame, traits: DataFrame, depth: int) -> DataFrame:
    """(node, id) of the children of rest (node, id)."""

    def child(j: int) -> Column:
        place = lambda k: F.pmod(F.xxhash64("node", F.lit(depth), F.lit(j), F.lit(k)), F.lit(SKETCH)).cast("int") + 1
        return F.xxhash64("node", F.lit(j), *(F.substr("sketch", place(k), F.lit(1)) for k in range(TOKENS)))

    return rest.join(traits.select("id", "sketch"), "id").select(F.explode(F.array(*(child(j) for j in range(REPEATS)))).alias("node"), "id")


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, component) of representatives with links. docs: id, h, text; reps: SKETCHES, one row a class."""
    traits = reps.select("id", "sketch", "n_shingles")
    tree = reps.select("id", F.posexplode("roots").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "id")
    tree = materialize(tree, "near-paths")
    nodes = tree.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tree = materialize(tree.join(nodes, "node"), "near-tree")
    members = tree.join(traits, "id").withColumn("parts", F.ceil(F.col("n") / LEAF)).withColumn("rank", F.xxhash64("id"))
    found = materialize(compared(members.withColumn("part", F.pmod(F.xxhash64("id", "node"), F.col("parts")))), "near-compared")
    linked = materialize(confirmed(materialize(candidates(found), "near-pairs"), docs, reps), "near-links")
    labels = materialize(components(linked), "near-components")
    level, more = tree.join(found.where(F.col("kind") == AGAIN).select("node").distinct(), "node", "left_semi").select("node", "id"), []
    for depth in range(DEPTH + 1):
        mixed = materialize(mixed_members(level, labels), "near-mixed")
        if not mixed.take(1):
            break
        close = materialize(likely(dealt_parts(mixed if depth == DEPTH else mixed.where(F.col("out") <= LEAF), traits)), "near-likely")
        if close.take(1):
            full = close.join(texts_of(close.select("id"), docs, reps).hint("merge"), "id")
            more.append(materialize(across(full).distinct(), "near-across"))
        rest = mixed.where(F.col("out") > LEAF).select("node", "id")
        if depth == DEPTH or not rest.take(1):
            break
        level = branched(rest, traits, depth)
    if not more:
        return labels
    pairs = more[0]
    for x in more[1:]:
        pairs = pairs.unionByName(x)
    late = materialize(pairs.distinct(), "near-links")
    return merged(labels, late) if late.take(1) else labels


def classes_of(keyed: DataFrame) -> DataFrame:
    """id, h, n_shingles, component_id of the rows with shingles and an id. keyed: id, h, text."""
    linked = materialize(sketches(keyed), "near-sketches").where("n_shingles > 0 and id is not null")
    classes = materialize(linked.groupBy("s1", "s2").agg(F.min("id").alias("rep")), "near-classes")
    reps = linked.join(classes, (linked["s1"] == classes["s1"]) & (linked["s2"] == classes["s2"]) & (linked["id"] == classes["rep"])).select(*(linked[c] for c in SKETCHES.names)).dropDuplicates(["id", "s1", "s2"])
    reps = materialize(reps, "near-reps")
    comp = links(keyed, reps)
    # classes -> component; ids that repeat with other texts tie their classes together
    of = classes.join(comp, classes["rep"] == comp["id"], "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    flat = linked.select("id", "h", "s1", "s2", "n_shingles").distinct()
    rows = materialize(flat.join(of, ["s1", "s2"]).select("id", "h", "n_shingles", "component_id"), "near-of")
    twice = rows.groupBy("id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a <> b")
    twice = materialize(twice, "near-twice")
    if twice.take(1):
        tied = rows.join(twice, "id").select(F.col("component_id").alias("a"), F.col("a").alias("b"))
        tied = materialize(components(tied), "near-tied").select(F.col("id").alias("_c"), "component")
        rows = rows.join(tied, rows["component_id"] == tied["_c"], "left").select("id", "h", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))
    return rows


def prepared(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str, DataFrame]:
    """docs under names of its own, its id and text column, and classes_of() it, written."""
    limit_arrow_rows(docs.sparkSession)
    own, (i, t) = shielded(docs, id_col, text_col)
    keyed = own.select(F.col(i).cast("long").alias("id"), row_hash(own, t).alias("h"), F.col(t).alias("text"))
    with scratch(docs.sparkSession) as keep:
        return own, i, t, keep(classes_of(keyed), "near-rows")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_shingles, component_id (smallest id reachable by links) and kept (the id is its component's)."""
    own, i, t, rows = prepared(docs, id_col, text_col)
    rows = rows.select(F.col("id").alias("_i"), F.col("h").alias("_h"), "n_shingles", "component_id").hint("merge")
    out = own.withColumn("_k", row_hash(own, t)).withColumn("_id", F.col(i).cast("long"))
    out = out.join(rows, (F.col("_id") == F.col("_i")) & (F.col("_k") == F.col("_h")), "left")
    out = out.withColumn("n_shingles", F.coalesce("n_shingles", F.lit(0).cast("long"))).withColumn("component_id", F.coalesce("component_id", "_id"))
    return restored(out.withColumn("kept", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True))), docs, ADDED)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_dedup() keeps. The ids that go are joined to the texts, not the texts to all ids: where
    those are few, no text is shuffled."""
    own, i, _, rows = prepared(docs, id_col, text_col)
    gone = rows.where("id <> component_id").select(F.col("id").alias("_i")).distinct()
    return restored(own.join(small_side(gone), F.col(i).cast("long") == F.col("_i"), "left_anti"), docs, [])
