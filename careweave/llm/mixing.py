"""Mixing overlapping sources to target weights by min-cost flow.

1. Documents are aggregated by membership pattern (the set of sources they belong to),
   so the flow network has a node for each pattern and source, not for each document.
2. Capacity of a pattern is its tokens, once for each allowed repetition; the r-th
   repetition costs r (convex), so flow repeats documents only where it must. Patterns
   that share no source are separate components and are solved one by one.
3. A pattern that got k whole repetitions and a rest takes every document k times and
   a seeded choice once more. The choice is first fit in a hash order: the documents
   before the first that overshoots the rest, then from there on those no longer than
   what is still missing, and so on until the sum is near or the order ends. Each of
   these passes sums hash buckets and then looks into the one where it stops, so no
   window is larger than a 4096th of a pattern. At last chosen documents are traded for
   others, looking only at the lengths that occur, while that brings the sum nearer.

Defined cases: a null text has size 0; a document in no source, or in the null source
(which comes last), is a pattern like others; repeated rows count each, and identical
ones are chosen alike, and so are rows of equal hash; a very long document is first fit like
others, and traded if that brings the sum nearer; an empty table gives an empty table; input columns beside those
named are not looked at. Reruns agree, as the choice depends on seed and content only.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from itertools import cycle

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careweave.llm import common

WEIGHTS = (5, 2, 1)
#: Hash buckets of a pattern: 2**12.
BUCKET_BITS = 12
#: A pattern's choice is corrected until its sum is this near to the rest.
NEAR = 0.0005
#: The least and the greatest hash.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Lines about patterns are broadcast up to this number.
BROADCAST_ROWS = 10_000


def code_point_order(sources) -> list[str | None]:
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most: int = 3) -> dict[str | None, float]:
    """Tokens for each source: all sizes shared by weight; what exceeds ``most`` times a
    source's size is shared again by weight among the others until none exceeds it."""
    weight = dict(zip(code_point_order(sizes), cycle(weights), strict=False))
    left, open_, found = float(sum(sizes.values())), set(sizes), {}
    while open_:
        per_weight = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if per_weight * weight[s] > most * sizes[s]}
        if not full:
            return found | {s: per_weight * weight[s] for s in open_}
        found |= {s: float(most * sizes[s]) for s in full}
        left -= sum(found[s] for s in full)
        open_ -= full
    return found


def route(patterns: dict[str, tuple[tuple[str | None, ...], int]], quotas: dict[str | None, int], most: int = 3) -> dict[tuple[str, str | None], int]:
    """Tokens from each pattern to each of its sources: a maximal flow of least cost.

    patterns: name to (sources, tokens)."""
    group = {s: s for s in quotas}

    def find(s):
        while group[s] != s:
            group[s] = group[group[s]]
            s = group[s]
        return s

    for sources, _ in patterns.values():
        for s in sources[1:]:
            group[find(s)] = find(sources[0])
    parts: dict = defaultdict(dict)
    for name, (sources, tokens) in patterns.items():
        if sources:
            parts[find(sources[0])][name] = (sources, tokens)
    found: dict[tuple[str, str | None], int] = {}
    for part in parts.values():
        found |= _flow(part, quotas, most)
    return found


def _flow(patterns, quotas, most):
    """Successive shortest paths over one component."""
    head, cap, cost, out = [], [], [], defaultdict(list)

    def edge(a, b, capacity, price):
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(head))
            head.append(y)
            cap.append(c)
            cost.append(p)
        return len(head) - 2

    total = sum(tokens for _, tokens in patterns.values()) * most
    used = {}
    for name, (sources, tokens) in sorted(patterns.items()):
        for repeat in range(most):
            edge("start", ("pattern", name), tokens, repeat)
        for s in sources:
            used[name, s] = edge(("pattern", name), ("source", s), total, 0)
    for s in {s for sources, _ in patterns.values() for s in sources}:
        edge(("source", s), "end", quotas[s], 0)
    while True:
        dist, via, queue, waiting = {"start": 0}, {}, deque(["start"]), {"start"}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in out[a]:
                b = head[e]
                if cap[e] and dist[a] + cost[e] < dist.get(b, float("inf")):
                    dist[b], via[b] = dist[a] + cost[e], e
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if "end" not in dist:
            return {key: cap[e + 1] for key, e in used.items()}
        path, at = [], "end"
        while at != "start":
            path.append(via[at])
            at = head[via[at] ^ 1]
        amount = min(cap[e] for e in path)
        for e in path:
            cap[e] -= amount
            cap[e ^ 1] += amount


def small(df: DataFrame, rows: int) -> DataFrame:
    """To be broadcast if it has so few rows; else joined as any other table."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def trades(gap: int, near: float, taken: dict[int, int], spare: dict[int, int]) -> tuple[list[int], int]:
    """Rows to be turned over (chosen or not), and the gap then: one row out and one in,
    or only one of these, as often as that brings the gap nearer to 0.

    taken, spare: length to a row of this length that is chosen, and that isn't."""
    taken, spare, turned = dict(taken), dict(spare), []
    while abs(gap) > near:
        out, into = np.array(sorted({0, *taken})), np.array(sorted({0, *spare}))
        at = np.searchsorted(into, gap + out)
        both = np.stack([into[(at - 1).clip(min=0)], into[at.clip(max=len(into) - 1)]])
        off = np.abs(gap + out - both)
        side, k = np.unravel_index(off.argmin(), off.shape)
        if off[side, k] >= abs(gap):
            break
        gap += int(out[k] - both[side, k])
        turned += [rows.pop(int(n)) for rows, n in ((taken, out[k]), (spare, both[side, k])) if n]
    return turned, gap


def first_fit(rows: DataFrame, rests: dict[str, int]) -> tuple[dict[str, list[tuple[int, int, int]]], dict[str, int]]:
    """Of each pattern: spans (begin, end, longest) of the hash order, in which the rows no
    longer than ``longest`` are chosen; and what the chosen ones lack to the rest."""
    spark = rows.sparkSession
    gap, begin = dict(rests), dict.fromkeys(rests, LEAST)
    spans: dict[str, list[tuple[int, int, int]]] = {name: [] for name in rests}
    upto = F.sum("tokens").over(Window.partitionBy("pattern").orderBy("bucket"))
    # rows of one hash are chosen alike
    run = F.sum("unit").over(Window.partitionBy("pattern").orderBy("order"))
    while wanting := [(name, begin[name], g) for name, g in gap.items() if g > NEAR * rests[name] and begin[name] <= MOST]:
        fits = "order >= begin AND unit > 0 AND unit <= gap"
        asked = small(spark.createDataFrame(wanting, "pattern string, begin long, gap long"), len(wanting))
        # written, so that the sums are dealt by pattern and bucket, not by pattern alone
        by_bucket = common.written(rows.join(asked, "pattern").where(fits).groupBy("pattern", "bucket", "gap").agg(F.sum("unit").alias("tokens")), "mix")
        found = by_bucket.withColumn("upto", upto).groupBy("pattern")
        found = found.agg(F.min(F.when(F.col("upto") > F.col("gap"), F.col("bucket"))).alias("cut"), F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))).alias("below"))
        cut = {r["pattern"]: (r["cut"], r["below"] or 0) for r in found.collect()}  # a line for each pattern
        lines = [(*line, *cut[line[0]]) for line in wanting if line[0] in cut and cut[line[0]][0] is not None]
        # joined by bucket too, so that only the rows at the cut are dealt by pattern
        at_cut = rows.join(small(spark.createDataFrame(lines, "pattern string, begin long, gap long, bucket long, below long"), len(lines)), ["pattern", "bucket"]).where(fits).withColumn("upto", run + F.col("below"))
        found = at_cut.groupBy("pattern").agg(F.min(F.when(F.col("upto") > F.col("gap"), F.col("order"))).alias("stop"), F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))).alias("upto"))
        stop = {r["pattern"]: (r["stop"], r["upto"]) for r in found.collect()} if lines else {}
        for name, first, g in wanting:
            below = cut.get(name, (None, 0))[1]
            end, got = stop.get(name, (MOST + 1, below))
            spans[name].append((first, end - 1, g))
            gap[name], begin[name] = g - (below if got is None else got), end + 1
    return spans, gap


def mix(docs: DataFrame, sources: Column, size: Column, weights=WEIGHTS, most: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict, dict]:
    """(id, pattern, size, taken) of every row, tokens of each source, target of each.

    ``sources`` is an array of source names. ``taken`` is the size times the number of
    repetitions, from 0 to ``most``; ``order`` is the hash by which rows were chosen."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.to_json(F.array_sort(F.array_distinct(sources))).alias("pattern"),
        size.cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("order"),
    )
    # identical rows are one that carries their number
    rows = common.written(rows.groupBy("id", "pattern", "size", "order").agg(F.count("*").cast("int").alias("copies")), "mix")
    rows = rows.withColumn("unit", F.col("size") * F.col("copies")).withColumn("bucket", F.shiftright("order", 64 - BUCKET_BITS))

    # one line for each pattern; patterns are few next to documents
    patterns = {r["pattern"]: (tuple(json.loads(r["pattern"])), r["tokens"]) for r in rows.groupBy("pattern").agg(F.sum("unit").alias("tokens")).collect()}
    sizes: dict[str | None, int] = defaultdict(int)
    for members, tokens in patterns.values():
        for s in members:
            sizes[s] += tokens
    # a document of several sources counts in each; the corpus is shared once
    goal = targets(dict(sizes), weights, most)
    flow = route(patterns, {s: round(t) for s, t in goal.items()}, most)
    got: dict[str, int] = defaultdict(int)
    for (name, _), tokens in flow.items():
        got[name] += tokens
    lines = [(name, *(divmod(got[name], tokens) if tokens else (0, 0))) for name, (_, tokens) in patterns.items()]
    rests = {name: rest for name, _, rest in lines if rest}
    spans, gap = first_fit(rows, rests)
    plan = small(spark.createDataFrame([(name, whole, spans.get(name, [])) for name, whole, _ in lines], "pattern string, whole long, spans array<struct<begin:long,end:long,longest:long>>"), len(lines))
    chosen = rows.join(plan, "pattern").withColumn("once", F.exists("spans", lambda x: F.col("order").between(x["begin"], x["end"]) & (F.col("unit") <= x["longest"])))
    # one row of each length that occurs in the patterns that are not near yet
    wanting = [(name,) for name, g in gap.items() if g > NEAR * rests[name]]
    lengths: dict[str, tuple[dict, dict]] = defaultdict(lambda: ({}, {}))
    if wanting:
        some = chosen.where("unit > 0").join(small(spark.createDataFrame(wanting, "pattern string"), len(wanting)), "pattern")
        for r in some.groupBy("pattern", "unit", "once").agg(F.min("order").alias("order")).collect():
            lengths[r["pattern"]][0 if r["once"] else 1][r["unit"]] = r["order"]
    turned = [(name, order, True) for name, (taken, spare) in lengths.items() for order in trades(gap[name], NEAR * rests[name], taken, spare)[0]]
    chosen = chosen.join(small(spark.createDataFrame(turned, "pattern string, order long, turned boolean"), len(turned)), ["pattern", "order"], "left")
    once = (F.col("once") != F.coalesce("turned", F.lit(False))).cast("long")
    out = chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    out = out.select(F.col("id").alias(id_col), "pattern", "size", "order", ((F.col("whole") + once) * F.col("size")).alias("taken"))
    return out, dict(sizes), goal
