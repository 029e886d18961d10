"""Filters, aggregations, traversals and fixpoints over edge tables.

Every traversal takes many starts at once: a start is a column of the frontier, or a bit of a mask there, so a whole estate is answered
in one batch. Each layer is one join of the frontier with the edges by source, one shuffle with what has been seen, and a table written
to the shared folder, whose rows are counted: a frontier with few rows is broadcast, so that the edges stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..plans.tables import BROADCAST_ROWS, counted, cut, dealt
from ..schema import COMMON, COMPARING, EDGE
from .ranks import numbered_within


def flip(edges: DataFrame) -> DataFrame:
    """The edges against their direction."""
    other = {"src": "dst", "dst": "src"}
    return edges.select(*(F.col(other.get(c, c)).alias(c) for c in edges.columns))


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge per (kind, flags, clause, src, dst): least confidence value, masks or-ed, first derivation and place."""
    return edges.groupBy("kind", "flags", "clause", "src", "dst").agg(
        F.min("conf").alias("conf"), F.bit_or("masks").alias("masks"), F.min_by("derive", "ord").alias("derive"), F.min("ord").alias("ord")
    )


def minimal_masks(masks: Column) -> Column:
    """Drops combination k of a set of flag combinations where a proper subset of k is present."""
    bit = lambda k: F.shiftright(masks, k).bitwiseAND(1)
    keep = bit(0) + F.when(bit(0) == 0, bit(1) * 2 + bit(2) * 4).otherwise(0)
    return (keep + F.when((bit(0) == 0) & (bit(1) == 0) & (bit(2) == 0), bit(3) * 8).otherwise(0)).cast("int")


def usable_combo(masks: Column, allowed: int) -> Column:
    """The smallest combination of the set that needs no flag beyond those allowed; null if there is none."""
    out = F.lit(None).cast("int")
    for k in (3, 2, 1, 0):
        if k & ~allowed == 0:
            out = F.when(F.shiftright(masks, k).bitwiseAND(1) == 1, k).otherwise(out)
    return out


def traversable(edges: DataFrame, min_conf: int = 2, implicit: bool = True, control: bool = False) -> DataFrame:
    """Edges that a query may follow, with the flags they cost: a summary's are its smallest usable combination."""
    allowed = int(implicit) | int(control) << 1
    flags = F.when(F.col("kind") == EDGE["SUMMARY"], usable_combo(F.col("masks"), allowed)).otherwise(F.when(F.col("flags").bitwiseAND(~allowed) == 0, F.col("flags")))
    return edges.filter(F.col("conf") <= min_conf).withColumn("flags", flags).filter("flags is not null")


def _packed(seeds: DataFrame) -> DataFrame:
    """seeds(start, v) as (g, v, bits): 64 neighbouring starts share a row, each is a bit; starts that aren't whole numbers have one row each."""
    if isinstance(seeds.schema["start"].dataType, IntegralType):
        start = F.col("start").cast("long")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), start.bitwiseAND(63).cast("int"))
        seeds = seeds.select(F.shiftright(start, 6).alias("g"), "v", F.coalesce(bit, F.lit(1).cast("long")).alias("bits"))
    else:
        seeds = seeds.select(F.col("start").alias("g"), "v", F.lit(1).cast("long").alias("bits"))
    return seeds.groupBy("g", "v").agg(F.bit_or("bits").alias("bits"))


def _has(bits: str) -> Column:
    return F.call_function("shiftright", F.col(bits), F.col("bit")).bitwiseAND(1) == 1


def _unpacked(packed: DataFrame, bits: str, seeds: DataFrame, *columns: Column) -> DataFrame:
    """Rows of _packed() as (start, v, *columns), start as in seeds; `bit` is the start's place in the masks, for columns that test them."""
    kind = seeds.schema["start"].dataType
    whole = isinstance(kind, IntegralType)
    rows = packed.withColumn("bit", F.explode(F.array(*map(F.lit, range(64 if whole else 1))))).filter(_has(bits))
    return rows.select((F.shiftleft("g", 6) + F.col("bit")).cast(kind).alias("start") if whole else F.col("g").alias("start"), "v", *columns)


def _layers(edges: DataFrame, seen: DataFrame, passed: dict[str, Column], live: str | None = None, opening: DataFrame | None = None) -> DataFrame:
    """(g, v, hop, *passed): per layer, the bits of each mask that a node gets for the first time, from those in seen(g, v, *passed).

    passed: what an edge hands on to each mask, of the masks that its source got in the layer before. Only rows with bits in the mask
    `live`, or in any, are followed, in the first layer over the edges `opening` if given. One shuffle adds up what is new and what is known.
    """
    some = " or ".join(f"{m} <> 0" for m in passed)
    follow = f"{live} <> 0" if live else some
    spark, zero = edges.sparkSession, F.lit(0).cast("long")
    size = edges.count()
    seen = cut(seen.select("g", "v", F.lit(0).alias("hop"), *passed))
    total = n = seen.count()
    frontier, hop = seen, 0
    while n:
        hop += 1
        with dealt(spark, size + total):
            out = frontier.filter(follow).select("g", "v", *passed)
            over = opening if opening is not None and hop == 1 else edges
            step = over.join(F.broadcast(out) if n <= BROADCAST_ROWS else out, F.col("v") == F.col("src"))
            step = step.select("g", F.col("dst").alias("v"), *(x.alias(m) for m, x in passed.items()), *(zero.alias(f"was_{m}") for m in passed))
            known = seen.select("g", "v", *(zero.alias(m) for m in passed), *(F.col(m).alias(f"was_{m}") for m in passed))
            both = step.unionByName(known).groupBy("g", "v").agg(*(F.bit_or(c).alias(c) for m in passed for c in (m, f"was_{m}")))
            new = both.select("g", "v", F.lit(hop).alias("hop"), *(F.col(m).bitwiseAND(F.bitwise_not(f"was_{m}")).alias(m) for m in passed))
            frontier = cut(new.filter(some))
        n = frontier.filter(follow).count()
        total += frontier.count()
        seen = seen.unionByName(frontier)
    return seen


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(start, v, hop) of all that seeds(start, v) reach over edges(src, dst[, terminal]).

    Terminal edges reach their target but aren't followed from it unless another edge reaches it in the same or a later layer.
    """
    packed = _packed(seeds)
    if "terminal" not in edges.columns:
        return _unpacked(_layers(edges, packed, {"bits": F.col("bits")}), "bits", seeds, F.col("hop"))
    passed = {"bits": F.col("open"), "open": F.when(F.col("terminal"), 0).otherwise(F.col("open"))}
    seen = _layers(edges, packed.withColumn("open", F.col("bits")), passed, "open")
    with dealt(edges.sparkSession, seen.count()):
        seen = cut(seen.withColumn("open", F.bit_or("open").over(Window.partitionBy("g", "v"))).filter("bits <> 0"))
    return _unpacked(seen, "bits", seeds, F.col("hop"), (~_has("open")).alias("terminal"))


def two_phase(edges: DataFrame, seeds: DataFrame, reverse: bool = False) -> DataFrame:
    """Context-sensitive reachability (start, v, phase, hop): call edges match, as phase two starts from all that phase one saw."""
    first, second = (EDGE["ARG_IN"], EDGE["RET_OUT"]) if reverse else (EDGE["RET_OUT"], EDGE["ARG_IN"])
    if reverse:
        edges = flip(edges)
    bits = {"bits": F.col("bits")}
    one = _layers(edges.filter(F.col("kind").isin(*COMMON, first)), _packed(seeds), bits)
    with dealt(edges.sparkSession, one.count()):
        start = cut(one.groupBy("g", "v").agg(F.bit_or("bits").alias("bits")))
    # phase one has followed all other edges from these nodes
    two = _layers(edges.filter(F.col("kind").isin(*COMMON, second)), start, bits, opening=edges.filter(F.col("kind") == second))
    both = one.withColumn("phase", F.lit(1)).unionByName(two.filter("hop > 0").withColumn("phase", F.lit(2)))
    return _unpacked(both, "bits", seeds, F.col("phase"), F.col("hop"))


def first_visits(edges: DataFrame, seeds: DataFrame, reverse: bool = False, min_conf: int = 2, implicit: bool = True, control: bool = False, endpoints: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """The two-phase slice with the state of each node's first visit: (start, v, ord, parent, dist, via, conf, flags, terminal).

    The first visit counts, not the best. Layers are equal to a queue: of the edges that reach a node in a layer, that of the
    parent seen first wins, then the smaller kind, then the earlier edge. seeds(start, v, ord). Nodes of endpoints(v) aren't
    followed unless they are starts; forward, an edge to one of columns(v) in a comparing clause ends there.
    """
    usable = traversable(edges, min_conf, implicit, control).withColumnRenamed("flags", "cost").withColumnRenamed("conf", "edge_conf").withColumnRenamed("ord", "edge_ord")
    if reverse:
        usable = flip(usable)
        usable = usable.withColumn("ends", F.lit(False))
    elif columns is None:
        usable = usable.withColumn("ends", F.lit(False))
    else:
        compared = (F.col("kind") == EDGE["MAPS_TO"]) & F.col("clause").isin(*COMPARING)
        usable = usable.join(columns.select(F.col("v").alias("dst"), F.lit(True).alias("is_column")), "dst", "left").withColumn("ends", compared & F.col("is_column").isNotNull())
    usable = cut(usable.select("kind", "src", "dst", "edge_conf", "cost", "edge_ord", "ends"))
    shape = "start", "v", "ord", "parent", "dist", "via", "conf", "flags", "terminal"
    null, zero = F.lit(None).cast("long"), F.lit(0)
    seen = cut(seeds.select("start", "v", F.col("ord").cast("long").alias("ord"), null.alias("parent"), zero.alias("dist"), F.lit(None).cast("int").alias("via"), zero.alias("conf"), zero.alias("flags"), F.lit(False).alias("terminal")))
    call = (EDGE["ARG_IN"], EDGE["RET_OUT"]) if reverse else (EDGE["RET_OUT"], EDGE["ARG_IN"])
    for only in call:
        kinds = usable.filter(F.col("kind").isin(*COMMON, only, *([EDGE["CONTROL_FLOW"]] if control else [])))
        frontier = counted(seen)
        while frontier is not None:
            out = frontier.filter(~F.col("terminal"))
            if endpoints is not None:
                blocked = out.join(endpoints.select("v"), "v", "left_semi").filter("dist > 0").select("start", "v")
                out = out.join(blocked, ["start", "v"], "left_anti")
            step = out.join(kinds, F.col("v") == F.col("src")).select(
                "start", F.col("dst").alias("v"), F.struct(F.col("ord").alias("parent_ord"), "kind", "edge_ord").alias("by"), F.col("v").alias("parent"),
                (F.col("dist") + 1).alias("dist"), F.col("kind").alias("via"), F.greatest("conf", "edge_conf").alias("conf"), F.col("flags").bitwiseOR(F.col("cost")).alias("flags"), F.col("ends").alias("terminal"),
            )
            best = step.join(seen, ["start", "v"], "left_anti").groupBy("start", "v").agg(F.min_by(F.struct("by", "parent", "dist", "via", "conf", "flags", "terminal"), "by").alias("x")).select("start", "v", "x.*")
            last = seen.groupBy("start").agg(F.max("ord").alias("last"))
            numbered = numbered_within(best, "start", "by", F.shiftright("by.parent_ord", 10)).join(last, "start").withColumn("ord", F.col("last") + F.col("turn"))
            found = cut(numbered.select(*shape))
            frontier = counted(found)
            if frontier is None:
                break
            seen = seen.unionByName(found)
        seen = cut(seen)
    return seen


def path_of(visits: DataFrame, targets: DataFrame) -> DataFrame:
    """(start, target, seq, v, via) along the parents of targets(start, v), in the order of the flow."""
    step = targets.join(visits, ["start", "v"]).select("start", F.col("v").alias("target"), "v", "parent", "via", F.lit(0).alias("back"))
    steps, current, n = step, step, 0
    while current.filter("parent is not null").limit(1).count():
        n += 1
        up = current.filter("parent is not null").select("start", "target", F.col("parent").alias("v"))
        current = cut(up.join(visits, ["start", "v"]).select("start", "target", "v", "parent", "via", F.lit(n).alias("back")))
        steps = steps.unionByName(current)
    seq = F.row_number().over(Window.partitionBy("start", "target").orderBy(F.desc("back"))).alias("seq")
    return steps.select("start", "target", seq, "v", "via")


def bottleneck(edges: DataFrame, seeds: DataFrame, confidences: int = 3) -> DataFrame:
    """(start, v, conf): the least, over all paths, of the greatest confidence value on the path.

    One loop: mask c of a node holds the starts that reach it over edges with values up to c.
    """
    masks = [f"up_to_{c}" for c in range(confidences)]
    steps = edges.select("src", "dst", F.col("conf").alias("edge_conf")).filter(F.col("edge_conf") < confidences)
    passed = {m: F.when(F.col("edge_conf") <= c, F.col(m)).otherwise(0) for c, m in enumerate(masks)}
    seen = _layers(steps, _packed(seeds).select("g", "v", *(F.col("bits").alias(m) for m in masks)), passed)
    with dealt(edges.sparkSession, seen.count()):
        seen = cut(seen.groupBy("g", "v").agg(*(F.bit_or(m).alias(m) for m in masks)))
    least = F.coalesce(*(F.when(_has(m), c) for c, m in enumerate(masks)))
    return _unpacked(seen, masks[-1], seeds, least.alias("conf"))


def flag_sets(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(start, v, combos): the set of flag combinations with which each node can be reached, as four bits."""
    spark, size = edges.sparkSession, edges.count()
    seen = cut(seeds.select("start", "v", F.lit(0).alias("fl")).distinct())
    frontier = seen
    while True:
        with dealt(spark, size + seen.count()):
            step = frontier.join(edges, F.col("v") == F.col("src")).select("start", F.col("dst").alias("v"), F.col("fl").bitwiseOR(F.col("flags")).alias("fl")).distinct()
            found = cut(step.join(seen, ["start", "v", "fl"], "left_anti"))
        frontier = counted(found)
        if frontier is None:
            return seen.groupBy("start", "v").agg(F.bit_or(F.expr("shiftleft(1, fl)")).alias("combos"))
        seen = seen.unionByName(found)


def callers(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, v, dist, conf) of all that call targets(v), nearest first; confidence of the first visit's least path."""
    spark, size = calls.sparkSession, calls.count()
    seen = cut(targets.select(F.col("v").alias("target"), "v", F.lit(0).alias("dist"), F.lit(0).alias("conf")).distinct())
    frontier, n = counted(seen), 0
    if frontier is None:
        return seen
    while True:
        n += 1
        with dealt(spark, size + seen.count()):
            step = frontier.join(calls, F.col("v") == F.col("callee")).select("target", F.col("caller").alias("v"), F.greatest("conf", "call_conf").alias("conf"))
            new = step.groupBy("target", "v").agg(F.min("conf").alias("conf"))
            found = cut(new.join(seen, ["target", "v"], "left_anti").select("target", "v", F.lit(n).alias("dist"), "conf"))
        frontier = counted(found)
        if frontier is None:
            return seen.filter("dist > 0")
        seen = seen.unionByName(found)


def offsets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adjacency offsets (gid, n, off): edges per source and the sum of those before, in order of gid.

    The prefix sum runs in two levels, so that no task sees all nodes: within ranges of 4,096 gids, and over the ranges.
    """
    n = nodes.join(edges.groupBy(F.col("src").alias("gid")).agg(F.count(F.lit(1)).alias("n")), "gid", "left").select("gid", F.coalesce("n", F.lit(0)).alias("n"), F.shiftright("gid", 12).alias("r"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = n.groupBy("r").agg(F.sum("n").alias("rn")).withColumn("base", F.coalesce(F.sum("rn").over(before(Window.orderBy("r"))), F.lit(0)))
    inner = F.coalesce(F.sum("n").over(before(Window.partitionBy("r").orderBy("gid"))), F.lit(0))
    return n.withColumn("inner", inner).join(ranges.select("r", "base"), "r").select("gid", "n", (F.col("base") + F.col("inner")).alias("off"))


def summaries(intra: DataFrame, calls: DataFrame, formals: DataFrame) -> DataFrame:
    """Procedure summaries (method, src, dst, combos, conf) as the least fixpoint over recursive calls.

    intra(method, src, dst, flags, conf): flows inside methods; calls(method, arg, result, callee, formal, out, conf): an argument and the
    result of a call with the callee's formals; formals(method, formal, out).
    """
    def compose(paths: DataFrame, flows: DataFrame) -> DataFrame:
        p, f = paths.alias("p"), flows.alias("f")
        return p.join(f, (F.col("p.method") == F.col("f.method")) & (F.col("p.v") == F.col("f.src"))).select(
            "p.method", "p.s", F.col("f.dst").alias("v"), F.col("p.fl").bitwiseOR(F.col("f.flags")).alias("fl"), F.greatest("p.conf", "f.conf").alias("conf")
        )

    keys = ["method", "s", "v", "fl"]
    flows = cut(intra.select("method", "src", "dst", "flags", "conf").distinct())
    paths = cut(formals.select("method", F.col("formal").alias("s"), F.col("formal").alias("v"), F.lit(0).alias("fl"), F.lit(0).alias("conf")).distinct())
    while True:
        outs = paths.join(formals.select("method", F.col("out").alias("v")).distinct(), ["method", "v"], "left_semi")
        done = outs.select(F.col("method").alias("callee"), F.col("s").alias("formal"), F.col("v").alias("out"), "fl", F.col("conf").alias("sconf"))
        through = calls.join(done, ["callee", "formal", "out"]).select("method", F.col("arg").alias("src"), F.col("result").alias("dst"), F.col("fl").alias("flags"), F.greatest("conf", "sconf").alias("conf"))
        step = compose(paths, flows.unionByName(through)).unionByName(paths.select(*keys, "conf"))
        new = cut(step.groupBy(*keys).agg(F.min("conf").alias("conf")))
        if new.join(paths, [*keys, "conf"], "left_anti").limit(1).count() == 0:
            break
        paths = new
    outs = paths.filter("s <> v").join(formals.select("method", F.col("out").alias("v")).distinct(), ["method", "v"], "left_semi")
    return outs.groupBy("method", F.col("s").alias("src"), F.col("v").alias("dst")).agg(minimal_masks(F.bit_or(F.expr("shiftleft(1, fl)"))).alias("combos"), F.min("conf").alias("conf"))


def roll_up(items: DataFrame, *keys: str) -> DataFrame:
    """Items(type, target, distance, conf, ord ...) to one per key, type and target: the smallest distance, first on ties."""
    by = F.struct("distance", "ord")
    return items.groupBy(*keys, "type", "target").agg(F.min_by(F.struct("distance", "conf"), by).alias("x"), F.count(F.lit(1)).alias("paths")).select(*keys, "type", "target", "x.*", "paths")
