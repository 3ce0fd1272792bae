"""Mixes overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern: the set of sources they belong to. The flow network has a node
for each pattern and each source. A pattern can be taken up to `most` times over, each further repetition at a
higher cost, so a source is repeated only where nothing fresh can fill its quota; capacities are words. The flow
says how many words of each pattern go into the mix. Whole repetitions take every document of the pattern; the
rest takes the documents with the smallest seeded hashes, up to a threshold found from exact sums.

Only the patterns' and sources' sums reach the driver. The network falls apart into parts that share no source, and the
flow of each is found by itself; a part of one pattern and one source needs no search. A null text has no words;
documents without words are never taken. Rows of equal identifier hash alike and go together. A null source is a source of
its own, after all others. Columns named like a result are overwritten by mix and returned as they are by mixed_documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm.common import WORD, documents, staged

#: Patterns whose plan is sent to every task; more are joined by shuffle.
BROADCAST_PATTERNS = 20_000
#: A document is taken so many times at most.
MOST = 3
#: Buckets of the seeded hash; rows are summed one by one only inside the bucket that holds the threshold.
BUCKETS = 4096


def words_of(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("bigint")


def ordered(sources: Sequence[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted((s for s in sources if s is not None)) + [None] * (None in sources)


def capped_targets(sizes: dict, weights: dict, most: int = MOST) -> dict:
    """Shares of the total by weight; a target stops at most times its source's size, the excess is shared anew by weight."""
    total = sum(sizes.values())
    fixed: dict = {}
    while True:
        free = [s for s in sizes if s not in fixed]
        rest, weight = total - sum(fixed.values()), sum(weights[s] for s in free)
        share = {s: rest * weights[s] / weight for s in free} if weight else {}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {s: float(fixed.get(s, share.get(s, 0.0))) for s in sizes}
        fixed.update({s: float(most * sizes[s]) for s in over})


class Flow:
    """Successive shortest paths with potentials, over integer capacities."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        height, sent = [0] * len(self.out), 0
        while True:
            far, via = {source: 0}, {}
            heap = [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    b = self.to[e]
                    new = d + self.cost[e] + height[a] - height[b]
                    if self.room[e] > 0 and new < far.get(b, new + 1):
                        far[b], via[b] = new, e
                        heapq.heappush(heap, (new, b))
            if sink not in far:
                return sent
            height = [h + far.get(i, far[sink]) for i, h in enumerate(height)]
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push
            sent += push


def route(patterns: dict[tuple, int], quotas: dict, most: int = MOST) -> dict[tuple, int]:
    """Words to take of each pattern (a tuple of sources): the cheapest flow that fills the quotas as far as can be.

    The r-th repetition costs r (r + 1) / 2 a word, so costs are convex in the words taken.
    """
    part = {s: s for s in quotas}  # of each source, one that stands for its part of the network

    def top(s):
        while part[s] != s:
            part[s] = part[part[s]]
            s = part[s]
        return s

    for p in patterns:
        known = [s for s in p if s in part]
        for s in known[1:]:
            part[top(s)] = top(known[0])
    parts: dict = {}
    taken = dict.fromkeys(patterns, 0)
    for p in patterns:
        known = [s for s in p if s in part]
        if known:
            parts.setdefault(top(known[0]), []).append(p)
    sources: dict = {}
    for s in quotas:
        sources.setdefault(top(s), []).append(s)
    for name, members in parts.items():
        if len(members) == 1 and len(sources[name]) == 1:
            taken[members[0]] = min(int(round(quotas[name])), most * patterns[members[0]])
        else:
            taken |= routed({p: patterns[p] for p in members}, {s: quotas[s] for s in sources[name]}, most)
    return taken


def routed(patterns: dict[tuple, int], quotas: dict, most: int) -> dict[tuple, int]:
    """The same for one part of the network."""
    names, sources = list(patterns), list(quotas)
    flow = Flow(2 + len(names) + len(sources))
    place = {s: 2 + len(names) + i for i, s in enumerate(sources)}
    taken = []
    for i, p in enumerate(names):
        taken.append([flow.arc(0, 2 + i, patterns[p], r * (r + 1) // 2) for r in range(most)])
        for s in p:
            if s in place:
                flow.arc(2 + i, place[s], most * patterns[p], 0)
    for s in sources:
        flow.arc(place[s], 1, int(round(quotas[s])), 0)
    flow.run(0, 1)
    return {p: sum(flow.room[e ^ 1] for e in taken[i]) for i, p in enumerate(names)}


RESULTS = ("size", "times", "taken", "pattern")


def mix(docs: DataFrame, members: Column, *, weights: Sequence[float] = (1, 2, 3), most: int = MOST, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The columns of docs (clashing ones overwritten), and size, times (how often the mix takes the row), taken (words), pattern; and the sources' sizes and targets.

    members: an array of source names, null elements allowed. Sources in code-point order weigh `weights`, repeating.
    """
    rows, info = _mixed(docs, members, weights, most, seed)
    return rows.select(*(c for c in docs.columns if c not in RESULTS), *(F.col(f"_nf_{c}").alias(c) for c in RESULTS)), info


def _mixed(docs: DataFrame, members: Column, weights: Sequence[float], most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """All columns of docs, and the results with names of their own."""
    spark = docs.sparkSession
    pattern = F.to_json(F.array_sort(F.array_distinct(members)))
    rows = docs.select("*", words_of().alias("_nf_size"), pattern.alias("_nf_pattern"), F.xxhash64("doc_id", F.lit(seed)).alias("_nf_hash"))
    slim = staged(docs.select(words_of().alias("size"), F.array_sort(F.array_distinct(members)).alias("members"), F.xxhash64("doc_id", F.lit(seed)).alias("hash")).withColumn("pattern", F.to_json("members")), "mix-sizes")
    sums = slim.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members")).collect()  # a row for each pattern
    patterns = {tuple(r["members"] or ()): r["size"] for r in sums}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    order = ordered(list(sizes))
    sizes = {s: sizes[s] for s in order}
    # Words that several sources share count once in the total.
    total = sum(n for p, n in patterns.items() if p)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    scale = total / sum(sizes.values()) if sum(sizes.values()) else 0.0
    targets = capped_targets(sizes, weight, most)
    targets = {s: t * scale for s, t in targets.items()} if scale < 1 else targets
    wanted = route(patterns, targets, most)
    key = {tuple(r["members"] or ()): r["pattern"] for r in sums}
    plan = [(key[p], wanted[p] // n if n else 0, wanted[p] % n if n else 0) for p, n in patterns.items()]
    plan = spark.createDataFrame(plan, "pattern string, whole bigint, rest bigint")
    near = F.broadcast if len(sums) <= BROADCAST_PATTERNS else (lambda x: x)
    limits = thresholds(slim, plan, near).withColumnRenamed("pattern", "_nf_pattern")
    whole = plan.select(F.col("pattern").alias("_nf_pattern"), F.col("whole").alias("_nf_whole"))
    chosen = rows.join(near(whole), "_nf_pattern").join(near(limits), "_nf_pattern", "left")
    once = (F.col("_nf_hash") <= F.col("_nf_limit")) | F.coalesce(F.col("_nf_hash") == F.col("_nf_extra"), F.lit(False))
    times = F.when(F.col("_nf_size") == 0, 0).otherwise(F.col("_nf_whole") + F.coalesce(once.cast("bigint"), F.lit(0)))
    out = chosen.withColumn("_nf_times", F.least(times, F.lit(most)).cast("bigint")).withColumn("_nf_taken", F.col("_nf_times") * F.col("_nf_size"))
    info = spark.createDataFrame([(s, sizes[s], targets[s]) for s in order], T.StructType([T.StructField("source_name", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]))
    return out.select(*docs.columns, *(f"_nf_{c}" for c in RESULTS)), info


def thresholds(slim: DataFrame, plan: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(pattern, _nf_limit, _nf_extra): the hash up to which a pattern's documents, in hash order, fit into its rest, and the one document beyond it that fills the gap best."""
    bucket = F.expr(f"floor((cast(hash as double) + 9223372036854775808D) / 18446744073709551616D * {BUCKETS})").cast("int")
    rows = slim.where("size > 0").withColumn("bucket", bucket)
    sums = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = sums.withColumn("upto", F.sum("n").over(upto)).join(near(plan), "pattern")
    edge = before.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")) & (F.col("rest") > 0))
    edge = staged(edge.select("pattern", "bucket", "rest", (F.col("upto") - F.col("n")).alias("below")), "mix-edges")
    inside = rows.join(near(edge), ["pattern", "bucket"]).groupBy("pattern", "hash", "rest", "below").agg(F.sum("size").alias("n"))
    run = F.sum("n").over(Window.partitionBy("pattern").orderBy("hash").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("run", F.col("below") + run)
    fits = F.when(F.col("run") <= F.col("rest"), F.struct("hash", "run"))
    last = inside.groupBy("pattern", "rest").agg(F.max(fits).alias("last"), F.min("hash").alias("first"), F.first("below").alias("below"))
    limit, gap = F.coalesce("last.hash", F.col("first") - 1), F.col("rest") - F.coalesce("last.run", "below")
    limits = staged(last.select("pattern", limit.alias("_nf_limit"), gap.alias("gap")), "mix-limits")
    off = F.abs(F.col("size") - F.col("gap"))
    beyond = rows.join(near(limits), "pattern").where((F.col("hash") > F.col("_nf_limit")) & (off < F.col("gap")))
    extra = beyond.groupBy("pattern").agg(F.min_by("hash", F.struct(off, "hash")).alias("_nf_extra"))
    return limits.join(extra, "pattern", "left").select("pattern", "_nf_limit", "_nf_extra")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    rows, _ = _mixed(docs, F.array("source"), **{"weights": (1, 2, 3), "most": MOST, "seed": 17, **options})
    every = rows.where("_nf_times > 0").withColumn("_nf_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_nf_times"))))
    return every.select(*docs.columns)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, info = mix(documents(spark, sf_dir).select("doc_id", "text", "source"), F.array("source"))
    out = rows.join(F.broadcast(info), rows["source"].eqNullSafe(info["source_name"]))
    return out.select("doc_id", "size", "source_size", "target", "taken", "times", "source")
