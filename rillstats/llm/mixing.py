"""Mixing sources to target weights by min-cost flow.

Documents with the same set of sources make one pattern. A pattern offers its words
once at cost 0, again at cost 1 and a third time at cost 2 (convex repetition costs);
arcs lead to its sources, whose arcs to the sink hold their targets. The cheapest
largest flow says how many words of each pattern to take. Patterns that share no source,
not even through others, don't touch each other's flow: a pattern that has its source for
itself is routed by a formula, and the others by connected components of sources, each
in a task of its own, so neither sources nor patterns are limited.

Within a pattern all documents are taken a whole number of times, and a seeded order picks
those taken once more: a document that is too long for what is left is skipped, and the
order goes on behind it. What is left where no document fits any more goes to further copies
of those that do, in the same order, and in the end to one document more if that is nearer."""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, WORD_CLASS, read_table, rows_of, seen_in, small_side, stored
from .near_dedup import components

#: Times that a document may be taken, at costs 0, 1, 2.
MOST_COPIES = 3
WEIGHTS = (5, 2, 1)
SEED = "mix"
#: Gaps up to this share of the target stay.
SMALL_GAP = 0.001
#: Parts of the seeded order that are summed up before documents are looked at: 16^3.
_PART_DIGITS = 3


def targets(sizes: list[int], weights: list[float], most: int = MOST_COPIES) -> list[float]:
    """Shares of the sum of sizes by weight; none is above `most` times its size, and
    what is above goes to the others by weight until none is."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        whole = sum(weights[k] for k in open_)
        over = {k for k in open_ if left * weights[k] / whole > most * sizes[k]}
        if not over:
            for k in open_:
                out[k] = left * weights[k] / whole
            break
        for k in sorted(over):
            out[k] = float(most * sizes[k])
        left -= sum(most * sizes[k] for k in over)
        open_ -= over
    return out


class Flow:
    """Largest flow by shortest augmenting paths in levels."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def push(self, source: int, sink: int) -> None:
        while True:
            level, queue = {source: 0}, deque([source])
            while queue:
                x = queue.popleft()
                for e in self.arcs[x]:
                    if self.room[e] > 0 and self.to[e] not in level:
                        level[self.to[e]] = level[x] + 1
                        queue.append(self.to[e])
            if sink not in level:
                return
            at = [0] * len(self.arcs)
            path: list[int] = []
            x = source
            while True:
                if x == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    x, path = source, []
                    continue
                while at[x] < len(self.arcs[x]):
                    e = self.arcs[x][at[x]]
                    if self.room[e] > 0 and level.get(self.to[e]) == level[x] + 1:
                        break
                    at[x] += 1
                if at[x] < len(self.arcs[x]):
                    path.append(e)
                    x = self.to[e]
                elif path:
                    x = self.to[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break


def routed(patterns: list[tuple[list[int], int]], quotas: list[int], most: int = MOST_COPIES) -> list[int]:
    """Words to take of each (sources, size). Costs lie only on the arcs out of the source,
    so opening them from the cheapest on, with a largest flow each time, has least cost."""
    n, m = len(patterns), len(quotas)
    flow = Flow(n + m + 2)
    for k, quota in enumerate(quotas):
        flow.add(n + k, n + m + 1, quota)
    for p, (sources, _) in enumerate(patterns):
        for k in sources:
            flow.add(p, n + k, 1 << 62)
    opened = [flow.add(n + m, p, 0) for p in range(n)]
    for _ in range(most):
        for e, (_, size) in zip(opened, patterns):
            flow.room[e] += size
        flow.push(n + m, n + m + 1)
    return [flow.room[e ^ 1] for e in opened]


def words_in(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def measured(docs: DataFrame, sources, id_col: str = "doc_id", text_col: str = "text", own: bool = False) -> DataFrame:
    """id, size (words), pattern (sorted different sources, null last), order_key, row (a
    number that tells rows apart) and, with `own`, the row itself. `sources` is a column of
    one source or of an array of them. Rows with a null id are put in order by their text."""
    one = F.col(sources) if isinstance(sources, str) else sources
    if not isinstance(docs.select(one.alias("s")).schema["s"].dataType, T.ArrayType):
        one = F.array(one.cast("string"))
    pattern = F.array_sort(F.array_distinct(F.coalesce(one, F.array(F.lit(None).cast("string")))))
    seeded = F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary")), F.lit(""))
    carried = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")] if own else []
    return docs.select(F.col(id_col).alias("id"), words_in(F.col(text_col)).alias("size"), pattern.alias("pattern"), F.md5(F.concat(seeded, F.lit(SEED))).alias("order_key"), F.monotonically_increasing_id().alias("row"), *carried)


def numbered(df: DataFrame, *order) -> DataFrame:
    """df with its row's place in an order from 0 on, as `place`. No task gets all rows: they
    are dealt out by ranges, and a range's rows are counted before it."""
    dealt = stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    upto, before = 0, []
    for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        before.append((r["part"], upto))
        upto += r["n"]
    if not before:
        return dealt.drop("part").withColumn("place", F.lit(0).cast("long"))
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "part int, before long"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(starts, "part").withColumn("place", own + F.col("before") - 1).drop("part", "before")


def _capped(left: int, whole: int, most: int) -> Column:
    """Whether a source's share of `left` is above `most` times its size."""
    exact = lambda x: F.lit(x).cast("decimal(38,0)")
    return F.col("weight") * exact(left) > most * F.col("size") * exact(whole)


def with_targets(sources: DataFrame, total: int, most: int = MOST_COPIES) -> DataFrame:
    """sources (size, weight) with `target`, as targets() gives it; each round is one
    aggregate. Sums are whole numbers, so nothing depends on their order."""
    size, weight = F.sum("size").cast("long"), F.sum("weight").cast("long")
    first = sources.agg(size.alias("size"), weight.alias("weight")).first()
    every, left, whole, rounds = first["size"] or 0, first["size"] or 0, first["weight"] or 0, -1
    while whole:
        over = _capped(left, whole, most)
        r = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("size"))).alias("size"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if r["n"] == rounds:
            break
        rounds, left, whole = r["n"], every - most * int(r["size"] or 0), int(r["weight"] or 0)
    share = F.when(_capped(left, whole, most), (most * F.col("size")).cast("double")).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(float(whole))) if whole else (most * F.col("size")).cast("double")
    scale = total / every if every > total else 1.0  # shared documents count once in what there is to share
    return sources.withColumn("target", share * F.lit(scale))


def _sources(patterns: DataFrame, weights) -> DataFrame:
    """source, size, weight, place, target of all sources of patterns (pattern, size)."""
    total = patterns.agg(F.sum("size")).first()[0] or 0
    sums = patterns.select("size", F.explode("pattern").alias("source")).groupBy("source").agg(F.sum("size").alias("size"))
    placed = numbered(sums, F.col("source").isNull(), F.col("source"))
    cycle = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    return stored(with_targets(stored(placed.withColumn("weight", cycle), "mix-sources"), total), "mix-targets")


def _routes(patterns: DataFrame, sources: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """pattern, words: what the flow takes of each pattern. sources: source, place, target."""
    quota = F.rint("target").cast("long")
    each = patterns.select("pattern", "size", F.explode("pattern").alias("s"))
    arcs = stored(each.join(small_side(sources.select("source", "place", quota.alias("quota")), sources), F.col("s").eqNullSafe(F.col("source"))).select("pattern", "size", "place", "quota"), "mix-arcs")
    shared = arcs.groupBy("pattern").agg(F.min("place").alias("a"), F.collect_list("place").alias("all")).where(F.size("all") > 1)
    edges = stored(shared.select("a", F.explode("all").alias("b")).where("a <> b").distinct(), "mix-edges")
    least = lambda: F.least(F.col("quota"), most * F.col("size")).alias("words")
    if not rows_of(edges):
        return arcs.select("pattern", least())
    joint = components(edges)
    joint = stored(joint.unionByName(joint.select(F.col("b").alias("a"), "b")).distinct(), "mix-components")
    own = arcs.join(small_side(joint), F.col("place") == F.col("a"), "left")

    def route(pdf):
        import pandas as pd

        place = {p: k for k, p in enumerate(sorted(set(pdf["place"])))}
        quotas = [0] * len(place)
        for p, q in zip(pdf["place"], pdf["quota"]):
            quotas[place[p]] = int(q)
        found: dict = {}
        for key, size, p, pattern in zip(pdf["key"], pdf["size"], pdf["place"], pdf["pattern"]):
            found.setdefault(key, [[], int(size), pattern])[0].append(place[p])
        order = sorted(found.values(), key=lambda x: sorted(x[0]))
        words = routed([(sorted(among), size) for among, size, _ in order], quotas, most)
        return pd.DataFrame({"pattern": [x[2] for x in order], "words": words})

    # A component's arcs go to one task: a row for each pattern and source, never a document.
    several = own.where("b is not null").select("b", "place", "quota", "pattern", "size", F.to_json(F.struct("pattern")).alias("key"))
    return several.groupBy("b").applyInPandas(route, "pattern array<string>, words long").unionByName(own.where("b is null").select("pattern", least()))


def mixed(docs: DataFrame, sources="source", weights=WEIGHTS, id_col: str = "doc_id", text_col: str = "text", own: bool = False) -> DataFrame:
    """One row per input row: id, size, pattern, source_size, target (of the first source of
    the pattern), copies (0 to 3), taken (copies times size) and, with `own`, a struct of
    the input row's columns.

    `weights` (whole numbers) go to the sources by code point, null last, again and again. Null is a
    source of its own. Null and empty texts have size 0 and are never taken. Repeated
    rows are rows like others; rows with one id and size are next to each other in the
    seeded order. Without `own` other columns aren't read. An empty table gives an empty
    result. A source of size 0 has target 0. Reruns agree: the order is a hash of the id,
    or of the text where the id is null. What is taken of a pattern differs from
    what the flow says by SMALL_GAP of the target at most, or by half of its shortest document
    that isn't taken MOST_COPIES times. Sources and patterns stay tables, whatever their number."""
    rows = stored(measured(docs, sources, id_col, text_col, own), "mix-sizes")
    patterns = stored(rows.groupBy("pattern").agg(F.sum("size").alias("size")), "mix-patterns")
    own_sources = _sources(patterns, weights)
    words = _routes(patterns, own_sources)
    firsts = own_sources.select(F.col("source").alias("first"), F.col("size").alias("source_size"), F.round("target", 6).alias("target"))
    plan = patterns.join(words, "pattern").join(small_side(firsts, own_sources), F.get("pattern", F.lit(0)).eqNullSafe(F.col("first"))).drop("first")
    every = F.when(F.col("size") > 0, F.floor(F.col("words") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    plan = stored(plan.withColumn("every", every).withColumn("rest", F.col("words") - F.col("every") * F.col("size")), "mix-plan")
    stretches = _stretches(rows, plan)
    full = plan.join(stretches, "pattern", "left").select("pattern", "source_size", "target", "every", F.coalesce("stretches", F.array().cast(f"array<struct<start: {_PLACE}, stop: {_PLACE}, gap: bigint>>")).alias("stretches"))
    planned = small_side(stored(full, "mix-full-plan"))
    here = F.struct("order_key", "size", "row")
    inside = F.filter("stretches", lambda s: (F.col("size") <= s["gap"]) & (s["start"].isNull() | (here >= s["start"])) & (s["stop"].isNull() | (here < s["stop"])))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.least(F.lit(MOST_COPIES), F.col("every") + F.size(inside)))
    last = _last(rows.select("pattern", "size", "order_key", "row").join(planned, "pattern").withColumn("copies", copies).withColumn("here", here), plan)
    out = rows.join(planned, "pattern").withColumn("copies", copies).join(small_side(last), "pattern", "left").withColumn("copies", F.col("copies") + F.coalesce((here == F.col("last")).cast("int"), F.lit(0)))
    return out.select(F.col("id").alias(id_col), "size", "pattern", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *(["own"] if own else []))


#: A place in the seeded order.
_PLACE = "struct<order_key: string, size: bigint, row: bigint>"


def _stretches(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """pattern, stretches: (start, stop, gap) of the seeded order; in a stretch the documents
    of up to `gap` words are taken once more. A stretch stops before the first document
    that is too long for what is then left; the next one starts there with what is left as
    its gap. All documents of up to that gap before it have been taken, so this is the order
    gone through once. Where it ends with more than SMALL_GAP of the target left, it is gone
    through again, MOST_COPIES times in all: documents that still fit have all been taken before, so
    these are further copies. A round is two aggregates over all open patterns, whose state is a table."""
    narrow = rows.select("pattern", "size", F.struct("order_key", "size", "row").alias("here"), F.substring("order_key", 1, _PART_DIGITS).alias("part")).where("size > 0")
    none = F.lit(None).cast(_PLACE)
    held = F.struct("start", "gap", (F.lit(MOST_COPIES) - F.col("every")).alias("room"), (F.col("target") * SMALL_GAP).alias("small"))
    open_ = plan.where("rest > 0 and size > 0").withColumns({"start": none, "gap": F.col("rest")}).select("pattern", held.alias("held"))
    done: list[DataFrame] = []
    fits = (F.col("size") <= F.col("held.gap")) & (F.col("held.start").isNull() | (F.col("here") >= F.col("held.start")))
    few = lambda df: df if rows_of(plan) > BROADCAST_ROWS else F.broadcast(df)  # noqa: E731  all have a row for each pattern at most
    gap = F.col("held.gap")
    while not done or seen_in(done[-1], "open"):
        taking = F.coalesce(F.when(fits, F.col("size")), F.lit(0))
        sums = narrow.join(few(open_), "pattern").groupBy("pattern", "part").agg(F.sum(taking).alias("sum"), F.first("held").alias("held"))
        upto = F.sum("sum").over(Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        ends = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("sum"))
        crossed = (F.col("before") <= gap) & (F.col("upto") > gap)
        edges = ends.groupBy("pattern").agg(F.max("upto").alias("all"), F.max(F.when(crossed, F.col("part"))).alias("edge"), F.max(F.when(crossed, F.col("before"))).alias("before"), F.first("held").alias("held"))
        near = narrow.join(few(edges.where("edge is not null").select("pattern", F.col("edge").alias("part"), "before", "held")), ["pattern", "part"]).where(fits)
        own = Window.partitionBy("pattern").orderBy("here").rowsBetween(Window.unboundedPreceding, 0)
        over = near.withColumn("end", F.sum("size").over(own) + F.col("before")).where(F.col("end") > gap)
        stops = over.groupBy("pattern").agg(F.min("here").alias("stop"), F.min(F.col("end") - F.col("size")).alias("taken"), F.first("held").alias("held"))
        ran = edges.where("edge is null").select("pattern", none.alias("stop"), F.col("all").alias("taken"), "held")
        room = F.when(F.col("stop").isNull(), F.col("held.room") - 1).otherwise(F.col("held.room"))
        each = stops.unionByName(ran).select("pattern", "stop", "held", (gap - F.col("taken")).alias("left"), "taken", room.alias("room"))
        still = F.expr("left > held.small and left > 0 and room > 0")
        now = stored(each, "mix-round", open=F.count_if(still))
        done.append(now)
        open_ = now.where(still).select("pattern", F.struct(F.col("stop").alias("start"), F.col("left").alias("gap"), "room", F.col("held.small").alias("small")).alias("held"))
    every = reduce(DataFrame.unionByName, [d.where("taken > 0").select("pattern", F.struct("held.start", "stop", "held.gap").alias("s")) for d in done])
    return every.groupBy("pattern").agg(F.collect_list("s").alias("stretches"))


def _last(taken: DataFrame, plan: DataFrame) -> DataFrame:
    """pattern, last: where more than SMALL_GAP of what is to be taken is missing, the shortest
    document that can be taken once more, if with it less would be too much than is missing now."""
    sums = taken.groupBy("pattern").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    gaps = sums.join(plan.select("pattern", "words", "target"), "pattern").withColumn("gap", F.col("words") - F.col("taken")).where(F.col("gap") > SMALL_GAP * F.col("target"))
    gaps = stored(gaps.select("pattern", "gap"), "mix-gaps")
    if not rows_of(gaps):
        return gaps.select("pattern", F.lit(None).cast(_PLACE).alias("last"))
    gaps = small_side(gaps)
    more = taken.where((F.col("copies") < MOST_COPIES) & (F.col("size") > 0)).join(gaps, "pattern").where(F.col("size") < 2 * F.col("gap"))
    least = F.min_by("here", F.struct("size", "here"))
    return stored(more.groupBy("pattern").agg(least.alias("last")), "mix-last")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, source_size, target: what the mix is held to, which SQL can say."""
    rows = measured(read_table(spark, sf_dir, "documents"), "source")
    patterns = stored(rows.groupBy("pattern").agg(F.sum("size").alias("size")), "mix-patterns")
    return _sources(patterns, WEIGHTS).select("source", F.col("size").alias("source_size"), F.round("target", 6).alias("target"))


TARGETS_SQL = r"""
WITH RECURSIVE n AS (
  SELECT source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM documents),
s AS MATERIALIZED (
  SELECT source, sum(n)::HUGEINT AS size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS w
  FROM n GROUP BY source),
r(k, l, whole) AS (
  SELECT 0, (SELECT sum(size) FROM s)::HUGEINT, (SELECT sum(w) FROM s)::HUGEINT
  UNION ALL
  SELECT k + 1, (sum(size) - 3 * coalesce(sum(size) FILTER (l * w > 3 * size * whole), 0))::HUGEINT,
         coalesce(sum(w) FILTER (NOT l * w > 3 * size * whole), 0)::HUGEINT
  FROM r, s WHERE k < 60 AND whole > 0 GROUP BY k, l, whole),
z AS (SELECT * FROM r ORDER BY k DESC LIMIT 1)
SELECT source, size::BIGINT AS source_size,
       round(CASE WHEN whole = 0 OR l * w > 3 * size * whole THEN (3 * size)::DOUBLE ELSE l::DOUBLE * w::DOUBLE / whole::DOUBLE END, 6) AS target
FROM s, z
"""
