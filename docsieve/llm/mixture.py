"""Problem 7: mixing sources to target weights.

Documents are aggregated by membership pattern (the set of sources a text occurs in), a flow routes
tokens from all patterns to source quotas with as few repetitions as possible, and documents are
selected along a seeded order by two-level prefix sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.llm import tokens
from docsieve.session import cut, small

#: Tokens of a part of the seeded order of a pattern on average, for the prefix sums; the distance of what cannot be reached.
PART, FAR = 1 << 22, 1 << 62


def documents_with_membership(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, tokens, pattern, uses): one row per distinct text that has tokens and occurs in a listed source.

    doc_id is the least id of the text, pattern its listed sources in order, uses the least max_repeats
    among them. Null, empty and token-free texts cannot contribute. A null source is never listed.
    """
    listed = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("max_repeats").alias("max_repeats"))
    rows = documents.select("doc_id", "source", "text").where("text <> ''").dropDuplicates(["doc_id"])
    member = rows.join(small(listed), "source")
    keyed = member.select("doc_id", "source", "max_repeats", F.sha2("text", 256).alias("digest"))
    # pre-aggregated by (text, source), so that a text repeated a million times is one row per source
    per = keyed.groupBy("digest", "source").agg(F.min("doc_id").alias("doc_id"), F.min("max_repeats").alias("uses"))
    texts = cut(per.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("uses").alias("uses"), F.array_sort(F.collect_list("source")).alias("pattern")))
    sizes = tokens.sizes(rows.join(texts.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text"))
    return texts.select("doc_id", "uses", "pattern").join(sizes, "doc_id").where("tokens > 0")


class Network:
    """Tokens of patterns given to sources. The members of a pattern are the arcs from ``first[i]`` to ``first[i + 1]``.

    Its arrays have an entry for each pattern and for each member of one, so the driver needs about
    100 bytes for each: there are no more of them than rows of documents, and as a rule far fewer.
    """

    def __init__(self, first: np.ndarray, member: np.ndarray, sources: int):
        widths = np.diff(first)
        self.first, self.member, self.pattern = first, member, np.repeat(np.arange(len(widths)), widths)
        # the arcs of each source, those of the patterns with the fewest members first, as these are of the least use to others
        order = np.lexsort((widths[self.pattern], member))
        self.of = np.split(order, np.cumsum(np.bincount(member, minlength=sources))[:-1])
        self.given, self.free, self.lack = np.zeros(len(member), np.int64), np.zeros(len(widths), np.int64), np.zeros(sources, np.int64)

    def distances(self) -> tuple[np.ndarray, np.ndarray]:
        """How many sources would have to pass tokens on until an unused one gets to the (patterns, sources); FAR if none can."""
        near, far, step = np.where(self.free > 0, 0, FAR), np.full(len(self.lack), FAR), 0
        while True:
            hit = self.member[near[self.pattern] == step]
            far[hit[far[hit] == FAR]] = step
            if not (far == step).any():
                return near, far
            near[self.pattern[(self.given > 0) & (far[self.member] == step) & (near[self.pattern] == FAR)]] = step + 1
            step += 1

    def draw(self, s: int, step: int, near: np.ndarray, far: np.ndarray) -> None:
        """Source ``s`` takes what it lacks: unused tokens of its patterns, or those that a source one step nearer to unused ones has of them."""
        mine = self.of[s][near[self.pattern[self.of[s]]] == step]
        p = self.pattern[mine]
        if step == 0:
            got = _take(self.free[p], self.lack[s])
            self.free[p] -= got
            self.given[mine] += got
        else:
            widths = self.first[p + 1] - self.first[p]
            arcs = np.repeat(self.first[p] - np.cumsum(widths) + widths, widths) + np.arange(widths.sum())
            nearer = (far[self.member[arcs]] == step - 1) & (self.given[arcs] > 0)
            arcs, mine = arcs[nearer], np.repeat(mine, widths)[nearer]
            got = _take(self.given[arcs], self.lack[s])
            self.given[arcs] -= got
            np.add.at(self.given, mine, got)
            np.add.at(self.lack, self.member[arcs], got)
        self.lack[s] -= got.sum()

    def fill(self) -> np.ndarray:
        """Gives every source what it lacks as far as that is possible (push-relabel in waves); True for sources that no unused token can reach.

        A source that still lacks tokens after a wave has drawn all it could at its distance, which
        therefore grows: there are at most as many waves as sources, squared.
        """
        while True:
            near, far = self.distances()
            reached = far[(self.lack > 0) & (far < FAR)]
            if not len(reached):
                return far == FAR
            for step in range(reached.max(), -1, -1):
                for s in np.flatnonzero((far == step) & (self.lack > 0)):
                    self.draw(s, step, near, far)


def _take(held: np.ndarray, wanted: int) -> np.ndarray:
    """How much of each amount is taken, in order, until ``wanted`` is reached."""
    return np.clip(wanted - (np.cumsum(held) - held), 0, held)


def solve(first: np.ndarray, member: np.ndarray, uses: np.ndarray, size: np.ndarray, shares: np.ndarray) -> tuple[int, np.ndarray]:
    """(tokens of the largest mixture with the given shares, tokens given along each arc), with as few repetitions as possible.

    Exact for any number of patterns. The total falls from that of all tokens to what the sources
    that stay short can have at most, until none is short. Then the first use of all documents is
    given out, then the second to those still short, and so on.
    """

    def demand(tokens_: int) -> np.ndarray:
        return (tokens_ * shares).astype(np.int64)

    whole = uses * size
    total = int(whole.sum())
    while True:
        net = Network(first, member, len(shares))
        net.free, net.lack = whole.copy(), demand(total)
        short = net.fill()
        if not net.lack.any():
            break
        room = whole[np.logical_or.reduceat(short[member], first[:-1])].sum()  # all that the patterns of these sources have
        low, high = 0, total - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if demand(middle)[short].sum() <= room else (low, middle - 1)
        total = low
    net, lap = Network(first, member, len(shares)), 0
    net.lack = demand(total)
    while net.lack.any():
        net.free += np.where(uses > lap, size, 0)
        net.fill()
        lap += 1
    return total, net.given


def normal(targets: dict[str, float], sources: list[str]) -> np.ndarray:
    """Shares of ``sources``, over which those of all others are spread."""
    weight = sum(targets[s] for s in sources)
    return np.array([targets[s] / weight for s in sources])


def plan(patterns: list[tuple[tuple[str, ...], int, int]], targets: dict[str, float]) -> tuple[int, dict[tuple[int, str], int]]:
    """``solve`` by names: (tokens, flow by (pattern number, source)) of patterns (sources, uses, tokens).

    It is the largest mixture in which every source that has documents reaches its share; shares of sources without any are spread over the others.
    """
    sources = sorted({s for members, _, size in patterns if size for s in members if s in targets})
    if not sources:
        return 0, {}
    number = {s: i for i, s in enumerate(sources)}
    kept = [(i, [number[s] for s in members if s in number], uses, size) for i, (members, uses, size) in enumerate(patterns)]
    kept = [row for row in kept if row[1]]
    first = np.cumsum([0] + [len(members) for _, members, _, _ in kept])
    member = np.array([m for _, members, _, _ in kept for m in members])
    total, given = solve(first, member, *(np.array([row[c] for row in kept], np.int64) for c in (2, 3)), normal(targets, sources))
    names = [(i, sources[m]) for i, members, _, _ in kept for m in members]
    return total, {names[j]: int(given[j]) for j in np.flatnonzero(given)}


def quotas(known: pa.Table, targets: dict[str, float]) -> pa.Table:
    """(id, source, low, high): the range that each source gets of the line of a pattern, for patterns (id, pattern, uses, size)."""
    members = known["pattern"].combine_chunks()
    coded = members.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    width = pc.list_value_length(members).to_numpy(zero_copy_only=False)
    first, member = np.concatenate([[0], np.cumsum(width)]).astype(np.int64), coded.indices.to_numpy(zero_copy_only=False)
    uses, size = (known[c].to_numpy().astype(np.int64) for c in ("uses", "size"))
    given = solve(first, member, uses, size, normal(targets, names))[1] if names else np.zeros(0, np.int64)
    high = np.cumsum(given)
    low, start = high - given, np.repeat((high - given)[first[:-1]], width) if names else high
    some = np.flatnonzero(given)
    ids = np.repeat(known["id"].to_numpy(), width)
    sources = pa.DictionaryArray.from_arrays(coded.indices.take(some), coded.dictionary).cast(pa.string())
    return pa.table({"id": ids[some], "source": sources, "low": (low - start)[some], "high": (high - start)[some]})


def mix(documents: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, repeats, tokens): how often each selected document is used for each source.

    A document is a distinct text. It is used for sources it occurs in, and in all no more often than
    the least max_repeats among them. The mixture is the largest in which all sources that have
    documents reach their shares; a quota is met up to the document that crosses it, at each pattern
    that is divided between sources. With an empty table, or no listed source with documents, it is empty.
    """
    spark = documents.sparkSession
    goals = {r.source: float(r.target_share) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").collect()}
    docs = cut(documents_with_membership(documents, targets))
    sizes = docs.groupBy("pattern", "uses").agg(F.sum("tokens").alias("size"))
    known = cut(sizes.withColumn("id", F.monotonically_increasing_id()))
    arcs = quotas(known.orderBy(F.desc("size"), "pattern", "uses").toArrow(), goals)  # memory: see Network
    ranges = spark.createDataFrame(arcs, "id bigint, source string, low bigint, high bigint")
    # the order of a pattern is cut into as many parts as its size asks for, so that no window grows with the data
    parted = known.withColumn("parts", F.expr(f"greatest(1, size div {PART})"))
    numbered = docs.join(small(parted, "octet_length(array_join(pattern, '')) + 16 * size(pattern) + 64"), ["pattern", "uses"]).drop("pattern")
    ranked = numbered.withColumn("order", F.xxhash64("doc_id", F.lit(seed))).withColumn("part", F.pmod("order", F.col("parts")))
    w = Window.partitionBy("id", "part").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    within = ranked.withColumn("inner", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    parts = ranked.groupBy("id", "part").agg(F.sum("tokens").alias("held"))
    before = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per PART tokens
    parts = parts.select("id", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("outer"))
    placed = within.join(parts, ["id", "part"]).withColumn("at", F.col("outer") + F.col("inner"))
    joined = placed.join(small(ranges), "id")
    # the k-th use of a document lies at at + k * size on the line of its pattern; it counts for the source whose quota holds its middle
    laps = F.sequence(F.lit(0), F.col("uses") - 1)
    middle = F.col("at") + F.col("tokens") / 2
    hits = F.size(F.filter(laps, lambda k: (middle + k * F.col("size") >= F.col("low")) & (middle + k * F.col("size") < F.col("high"))))
    return joined.withColumn("repeats", hits).where("repeats > 0").select("doc_id", "source", "repeats", "tokens")


def merged(docs: DataFrame, goals: dict[str, float], most: int) -> DataFrame:
    """``docs`` with at most ``most`` patterns of several sources: documents of the further ones count for one source of theirs alone.

    The patterns with the most tokens are kept, ties in order of their names. A document of another goes
    to that of its sources which has the fewest tokens for its share, by all documents; none is lost.
    ``mix`` does without, as it routes any number of patterns: shares can be missed with such a bound.
    """
    sizes = docs.groupBy("pattern", "uses").agg(F.sum("tokens").alias("size"))
    several = cut(sizes.where(F.size("pattern") > 1))
    if several.limit(most + 1).count() <= most:
        return docs
    kept = F.broadcast(several.orderBy(F.desc("size"), "pattern", "uses").limit(most).select("pattern", "uses", F.lit(True).alias("kept")))  # at most ``most`` rows
    held = {r.source: r["size"] for r in sizes.select(F.explode("pattern").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size")).collect()}  # one row per listed source
    scarce = sorted(goals, key=lambda s: (held.get(s, 0) / goals[s], s))
    rank = F.create_map(*(x for i, s in enumerate(scarce) for x in (F.lit(s), F.lit(i))))
    first = F.array_min(F.transform("pattern", lambda s: F.struct(rank[s].alias("rank"), s.alias("source"))))["source"]
    alone = F.when(F.col("kept") | (F.size("pattern") == 1), F.col("pattern")).otherwise(F.array(first))
    return docs.join(kept, ["pattern", "uses"], "left").withColumn("pattern", alone).drop("kept")


def report(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, tokens, actual_share) for every listed source, also those that contribute nothing."""
    sums = selected.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    total = sums.agg(F.sum("tokens").alias("all"))
    rows = targets.select("source", "target_share").join(sums, "source", "left").join(F.broadcast(total), F.lit(True), "left")
    return rows.select("source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.round(F.col("tokens") / F.col("all"), 6), F.lit(0.0)).alias("actual_share"))
