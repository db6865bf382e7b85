"""Speaker groups and vectors: roll-ups, centroids, votes, clustering, threshold choice.

Relational parts are plain DataFrame operations keyed by recording.  Only folds whose
steps depend on one another (robust centroid, agglomeration, union-find) run as grouped
pandas functions over one recording's groups, which are tens to hundreds of rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Embedding limits, robust-centroid and clustering parameters, the threshold grid.
MIN_EMBED_S, MAX_EMBED_S, MIN_VOTE_S, MIN_SAMPLES_S = 1.0, 10.0, 0.5, 0.2
KEEP_FRACTION, CROWD_WEIGHT, ITERATIONS = 0.5, 1.0, 2
LOW_MARGIN, DEFAULT_TAU = 0.05, {"campplus": 0.55, "other": 0.90}
TAUS = [round(0.10 + 0.05 * i, 2) for i in range(13)]


def rollup(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Per speaker: segments, speech, parts, first start, last end, and a label by first appearance."""
    out = segments.groupBy(*keys, "speaker").agg(
        F.count("*").alias("n_segments"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"),
        F.sort_array(F.collect_set("part")).alias("parts"),
        F.min("start_ms").alias("first_ms"),
        F.max("end_ms").alias("last_ms"),
    )
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("first_ms", "speaker"))
    return out.withColumn("label", F.concat(F.lit("G"), F.lpad(n.cast("string"), 2, "0")))


def with_global(segments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Global speakers by (part, speaker), with a telling default where there is none."""
    default = F.concat(F.lit("U_p"), F.col("part").cast("string"), F.lit("_"), F.col("speaker"))
    return segments.join(mapping, ["part", "speaker"], "left").withColumn("speaker_global", F.coalesce("gid", default)).drop("gid")


def embeddable(start_s: Column, end_s: Column, n_samples: Column | None = None, rate: int = 16000) -> Column:
    """Long enough to embed, and with at least 0.2 s of samples there."""
    long_enough = F.least(end_s - start_s, F.lit(MAX_EMBED_S)) >= MIN_EMBED_S
    return long_enough if n_samples is None else long_enough & (n_samples >= int(MIN_SAMPLES_S * rate))


def may_vote(start_s: Column, end_s: Column) -> Column:
    """Whether a kept vector's segment is long enough to have a vote."""
    return F.least(end_s - start_s, F.lit(MAX_EMBED_S)) >= MIN_VOTE_S


def labels(clusters: DataFrame, groups: DataFrame, recording: list[str]) -> DataFrame:
    """(part, speaker, gid, resolved): G01.. by each cluster's first start, and telling names for groups in no cluster.

    ``clusters`` has part, speaker and cluster; ``groups`` all part, speaker and first_ms.
    """
    joined = groups.join(clusters, [*recording, "part", "speaker"], "left")
    first = joined.where("cluster is not null").groupBy(*recording, "cluster").agg(F.min("first_ms").alias("at"))
    n = F.row_number().over(Window.partitionBy(*recording).orderBy("at", "cluster"))
    named = first.select(*recording, "cluster", F.concat(F.lit("G"), F.lpad(n.cast("string"), 2, "0")).alias("g"))
    unresolved = F.concat(F.lit("U_p"), F.col("part").cast("string"), F.lit("_"), F.col("speaker").cast("string"))
    return joined.join(named, [*recording, "cluster"], "left").select(*recording, "part", "speaker", F.coalesce("g", unresolved).alias("gid"), F.col("g").isNotNull().alias("resolved"))


def centroid_pairs(groups: DataFrame, recording: list[str]) -> DataFrame:
    """Cosines of all pairs of a recording's group centroids (tens of groups), those of one part marked."""
    other = groups.select(*recording, F.col("part").alias("b_part"), F.col("speaker").alias("b_speaker"), F.col("centroid").alias("c"))
    mine = groups.select(*recording, F.col("part").alias("a_part"), F.col("speaker").alias("a_speaker"), "centroid")
    later = F.struct("a_part", "a_speaker") < F.struct("b_part", "b_speaker")
    return mine.join(other, recording).where(later).select(*recording, "a_part", "a_speaker", "b_part", "b_speaker", dot(F.col("centroid"), F.col("c")).alias("cosine"), (F.col("a_part") == F.col("b_part")).alias("same_part"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normed(v: Column) -> Column:
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x))


def centroids(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Normalised mean vectors.  Means are taken by dimension with partial sums, so a large group isn't collected."""
    by_dim = vectors.select(*keys, F.posexplode("embedding").alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    mean = by_dim.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean"), F.max("n").alias("n"))
    return mean.select(*keys, "n", normed(F.col("mean")).alias("centroid"))


def crowds(vectors: DataFrame, recording: list[str]) -> DataFrame:
    """Each part's mean over all its vectors, where two or more speakers share it."""
    several = vectors.groupBy(*recording, "part").agg(F.size(F.collect_set("speaker")).alias("n_speakers")).where("n_speakers >= 2").drop("n_speakers")
    return centroids(vectors, [*recording, "part"]).join(several, [*recording, "part"]).select(*recording, "part", F.col("centroid").alias("crowd"))


def kept_count(n: int, fraction: float = KEEP_FRACTION) -> int:
    return min(n, max(3, round(fraction * n)))


def robust_indices(v: np.ndarray, crowd: np.ndarray | None, fraction: float = KEEP_FRACTION, weight: float = CROWD_WEIGHT, iterations: int = ITERATIONS) -> np.ndarray:
    """Rows that stay: near the medoid of those left and far from the crowd, round by round."""
    left = np.arange(len(v))
    for _ in range(iterations):
        own = v[left]
        medoid = own[int(np.argmax((own @ own.T).sum(1)))]
        score = own @ medoid - (weight * (own @ crowd) if crowd is not None else 0.0)
        left = left[np.sort(np.argsort(-score, kind="stable")[: kept_count(len(left), fraction)])]
    return left


def robust_centroids(vectors: DataFrame, recording: list[str], fraction: float = KEEP_FRACTION) -> DataFrame:
    """Per (part, speaker): the vectors kept and their normalised mean."""
    joined = vectors.join(crowds(vectors, recording), [*recording, "part"], "left").select(*recording, "part", "speaker", "vec_id", "embedding", "crowd")
    keys = [*recording, "part", "speaker"]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        v = np.array(pdf["embedding"].tolist(), np.float64)
        crowd = pdf["crowd"].iloc[0]
        kept = robust_indices(v, None if crowd is None else np.asarray(crowd, np.float64), fraction)
        mean = v[kept].mean(0)
        row = pdf.iloc[[0]][keys].copy()
        row["n_total"], row["n_kept"], row["kept"] = len(v), len(kept), [pdf["vec_id"].to_numpy()[kept].tolist()]
        row["centroid"] = [(mean / max(np.linalg.norm(mean), 1e-12)).tolist()]
        return row

    types = dict(vectors.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", n_total long, n_kept long, kept array<long>, centroid array<double>"
    return joined.groupBy(*keys).applyInPandas(pick, schema)


def evenly_sampled(vectors: DataFrame, keys: list[str], order: str, limit: int = 8) -> DataFrame:
    """At most ``limit`` vectors of each group, evenly spaced in order."""
    w = Window.partitionBy(*keys)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    # a row is taken if some k of the even spacing rounds to it
    slot = F.round(F.round(i * (limit - 1) / (n - 1)) * (n - 1) / (limit - 1))
    return vectors.withColumn("take", (n <= limit) | (slot == i)).where("take").drop("take")


def falling(rows: DataFrame, part: str, speaker: str) -> list[Column]:
    """What is largest for the target that comes first, by part and then by speaker."""
    turned = lambda c: F.transform(F.split(c, ""), lambda x: -F.ascii(x))
    return [(-F.col("t_part")).alias("p"), (turned(F.col("t_speaker")) if dict(rows.dtypes)[speaker] == "string" else -F.col("t_speaker")).alias("s")]


def votes(vectors: DataFrame, targets: DataFrame, recording: list[str]) -> DataFrame:
    """(src part and speaker, target, n): every vector votes for the nearest centroid of another part.

    Targets are one row for each group of a recording; the join is by recording.
    """
    t = targets.select(*recording, F.col("part").alias("t_part"), F.col("speaker").alias("t_speaker"), "centroid")
    scored = vectors.join(t, recording).where("part <> t_part").withColumn("score", dot(F.col("embedding"), F.col("centroid")))
    # first among equals is the target that comes first
    best = scored.groupBy(*recording, "part", "speaker", "vec_id").agg(F.max_by(F.struct("t_part", "t_speaker"), F.struct("score", *falling(targets, "part", "speaker"))).alias("t"))
    return best.groupBy(*recording, "part", "speaker", F.col("t.t_part").alias("t_part"), F.col("t.t_speaker").alias("t_speaker")).agg(F.count("*").alias("n"))


def affinity(tally: DataFrame, keys: list[str]) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(*keys, "part", "speaker"))
    return tally.withColumn("share", F.col("n") / total)


def majority(tally: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's most voted target and its share of the votes."""
    return tally.groupBy(*keys, "part", "speaker").agg(
        F.max_by(F.struct("t_part", "t_speaker"), F.struct("n", *falling(tally, "t_part", "t_speaker"))).alias("winner"), (F.max("n") / F.sum("n")).alias("agreement"), F.sum("n").alias("n_votes")
    )


SYMMETRY = {"min": min, "max": max, "mean": lambda a, b: (a + b) / 2}
NOBODY = -1


class Ballots:
    """The votes of all kept vectors among clusters that change by merging.

    A ballot remembers its best and second-best target.  After a merge only those vote
    again whose own cluster merged or whose two targets are concerned; for all others the
    merged cluster is one new candidate.  Clusters go by their least group; of equal
    scores the least cluster wins.
    """

    def __init__(self, part: list[int], centroid: np.ndarray, kept: list[np.ndarray]):
        n = len(part)
        self.members, self.parts = {i: [i] for i in range(n)}, {i: {p} for i, p in enumerate(part)}
        self.centroid = centroid
        self.centre = {i: self._centre([i]) for i in range(n)}
        self.vectors = np.concatenate([np.asarray(k, np.float64).reshape(-1, centroid.shape[1]) for k in kept]) if n else np.empty((0, 1))
        self.owner = np.repeat(np.arange(n), [len(k) for k in kept])
        self.total = {i: len(k) for i, k in enumerate(kept)}
        size = len(self.vectors)
        self.target, self.score = np.full((size, 2), NOBODY), np.full((size, 2), -np.inf)
        self.count: dict[tuple[int, int], int] = {}
        self.recounted = 0
        self._vote(np.ones(size, bool))

    def _centre(self, members: list[int]) -> np.ndarray:
        mean = self.centroid[members].mean(0)
        return mean / max(np.linalg.norm(mean), 1e-12)

    def may_meet(self, a: int, b: int) -> bool:
        return not self.parts[a] & self.parts[b]

    def _likeness(self, rows: np.ndarray, cluster: int) -> np.ndarray:
        return (self.vectors[rows] * self.centre[cluster]).sum(1)

    def _enter(self, rows: np.ndarray, cluster: int) -> None:
        """Let ``cluster`` stand for these ballots, none of which knows it yet."""
        score, of = self._likeness(rows, cluster), self.target[rows]
        better = [(score > self.score[rows, k]) | ((score == self.score[rows, k]) & ((of[:, k] == NOBODY) | (cluster < of[:, k]))) for k in (0, 1)]
        first, second = rows[better[0]], rows[~better[0] & better[1]]
        self.target[first, 1], self.score[first, 1] = self.target[first, 0], self.score[first, 0]
        self.target[first, 0], self.score[first, 0] = cluster, score[better[0]]
        self.target[second, 1], self.score[second, 1] = cluster, score[~better[0] & better[1]]

    def _vote(self, again: np.ndarray) -> None:
        """These ballots look at every cluster they may choose."""
        self.target[again], self.score[again] = NOBODY, -np.inf
        self.recounted += int(again.sum())
        for cluster in sorted(self.members):
            open_to = [c for c in self.members if c != cluster and self.may_meet(c, cluster)]
            rows = np.flatnonzero(again & np.isin(self.owner, open_to))
            if len(rows):
                self._enter(rows, cluster)
        self._tally()

    def _tally(self) -> None:
        chosen = self.target[:, 0] != NOBODY
        pairs, n = np.unique(np.stack([self.owner[chosen], self.target[chosen, 0]], 1), axis=0, return_counts=True)
        self.count = {(int(a), int(b)): int(k) for (a, b), k in zip(pairs, n)}

    def share(self, a: int, b: int) -> float:
        return self.count.get((a, b), 0) / self.total[a] if self.total[a] else 0.0

    def merge(self, a: int, b: int) -> set[int]:
        """``b`` goes into ``a`` (``a`` less than ``b``); gives the clusters whose shares may have changed."""
        before = dict(self.count)
        self.members[a], self.parts[a] = self.members[a] + self.members.pop(b), self.parts[a] | self.parts.pop(b)
        self.total[a] += self.total.pop(b)
        self.centre[a] = self._centre(self.members[a])
        del self.centre[b]
        self.owner[self.owner == b] = a
        again = (self.owner == a) | np.isin(self.target, (a, b)).any(1)
        open_to = [c for c in self.members if c != a and self.may_meet(c, a)]
        rest = np.flatnonzero(~again & np.isin(self.owner, open_to))
        if len(rest):
            self._enter(rest, a)
        self._vote(again)
        return {a} | {x for pair in before.keys() | self.count.keys() if before.get(pair) != self.count.get(pair) for x in pair if x in self.members}


def agglomerate(part: list[int], centroid: np.ndarray, kept: list[np.ndarray], symmetry: str = "min") -> list[dict]:
    """All merges to exhaustion, best affinity first; clusters that share a part never merge.

    The order doesn't depend on a threshold: cutting before the first affinity at or
    below one gives that threshold's partition (affinities aren't monotone).  Pairs wait in
    a heap; an entry that its pair's affinity has left behind is passed over.  The margin
    is over the best other pair of either cluster, 0 for those that can't merge, and 1
    where no third cluster is left.
    """
    ballots, log = Ballots(part, centroid, kept), []
    affinity = lambda a, b: float(SYMMETRY[symmetry](ballots.share(a, b), ballots.share(b, a)))
    now = {(a, b): affinity(a, b) for a in range(len(part)) for b in range(a + 1, len(part)) if ballots.may_meet(a, b)}
    heap = [(-v, *pair) for pair, v in now.items()]
    heapq.heapify(heap)
    while heap:
        v, a, b = heapq.heappop(heap)
        if now.get((a, b)) != -v:
            continue
        third = len(ballots.members) > 2
        rival = max((x for pair, x in now.items() if pair != (a, b) and {a, b} & set(pair)), default=0.0)
        log.append({
            "step": len(log), "a": min(ballots.members[a]), "b": min(ballots.members[b]), "affinity": -v, "alternative": rival if third else -1.0,
            "margin": -v - rival if third else 1.0, "members": sorted(ballots.members[a] + ballots.members[b]),
        })
        changed = ballots.merge(a, b)
        now = {pair: x for pair, x in now.items() if b not in pair}
        for c in changed:
            for d in ballots.members:
                pair = (min(c, d), max(c, d))
                if c == d:
                    continue
                if not ballots.may_meet(c, d):
                    now.pop(pair, None)
                elif now.get(pair) != (x := affinity(*pair)):
                    now[pair] = x
                    heapq.heappush(heap, (-x, *pair))
    return log


def merge_log(vectors: DataFrame, robust: DataFrame, recording: list[str], symmetry: str = "min") -> DataFrame:
    """(recording, step, a, b, affinity, alternative, margin, members), groups numbered by (part, speaker)."""
    kept = robust.select(*recording, "part", "speaker", F.explode("kept").alias("vec_id"))
    ballots = vectors.join(kept, [*recording, "part", "speaker", "vec_id"]).groupBy(*recording, "part", "speaker").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("ballots"))
    groups = robust.join(ballots, [*recording, "part", "speaker"]).select(*recording, "part", "speaker", "centroid", F.col("ballots.embedding").alias("ballots"))
    types = dict(robust.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in recording) + ", step int, a int, b int, affinity double, alternative double, margin double, members array<int>, n_groups int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "speaker"])
        log = agglomerate(pdf["part"].tolist(), np.array(pdf["centroid"].tolist()), [np.array(b.tolist(), np.float64) for b in pdf["ballots"]], symmetry)
        rows = [{**{k: pdf[k].iloc[0] for k in recording}, **m, "n_groups": len(pdf)} for m in log]
        none = {**{k: pdf[k].iloc[0] for k in recording}, "step": -1, "a": None, "b": None, "affinity": None, "alternative": None, "margin": None, "members": [], "n_groups": len(pdf)}
        return pd.DataFrame([none, *rows])[[*recording, "step", "a", "b", "affinity", "alternative", "margin", "members", "n_groups"]]

    return groups.groupBy(*recording).applyInPandas(fold, schema)


def partition_at(log: list[dict], n: int, tau: float) -> list[list[int]]:
    """The partition of ``n`` groups when merging stops at the first affinity not above ``tau``."""
    of = {i: [i] for i in range(n)}
    for m in sorted(log, key=lambda m: m["step"]):
        if m["affinity"] <= tau:
            break
        merged = list(m["members"])
        for i in merged:
            of[i] = merged
    return [list(x) for x in sorted({tuple(sorted(c)) for c in of.values()})]


def clusters_at(log: DataFrame, groups: DataFrame, recording: list[str], tau: float) -> DataFrame:
    """(recording, part, speaker, cluster): the merge log's partition at a threshold; a cluster's number is its least group."""
    types = dict(log.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in recording) + ", k int, cluster int"

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        found = partition_at(pdf[pdf["step"] >= 0].to_dict("records"), int(pdf["n_groups"].iloc[0]), tau)
        out = pd.DataFrame([(i, min(c)) for c in found for i in c], columns=["k", "cluster"])
        return out.assign(**{k: pdf[k].iloc[0] for k in recording})[[*recording, "k", "cluster"]]

    numbered = groups.withColumn("k", (F.row_number().over(Window.partitionBy(*recording).orderBy("part", "speaker")) - 1).cast("int"))
    return numbered.join(log.groupBy(*recording).applyInPandas(cut, schema), [*recording, "k"]).select(*recording, "part", "speaker", "cluster")


def tau_curve(log: DataFrame, recording: list[str], taus: list[float] = TAUS) -> DataFrame:
    """(recording, i, tau, n_clusters, n_merges, min_margin, pairs): one prefix cut for each threshold."""
    types = dict(log.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in recording) + ", i int, tau double, n_clusters int, n_merges int, min_margin double, pairs array<string>"

    def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
        n, rows = int(pdf["n_groups"].iloc[0]), pdf[pdf["step"] >= 0].to_dict("records")
        out = []
        for i, tau in enumerate(taus):
            clusters = partition_at(rows, n, tau)
            merges = n - len(clusters)
            margins = [r["margin"] for r in sorted(rows, key=lambda r: r["step"])[:merges]]
            pairs = [f"{a}-{b}" for c in clusters for x, a in enumerate(c) for b in c[x + 1 :]]
            out.append({**{k: pdf[k].iloc[0] for k in recording}, "i": i, "tau": tau, "n_clusters": len(clusters), "n_merges": merges, "min_margin": min(margins, default=None), "pairs": pairs})
        return pd.DataFrame(out)[[*recording, "i", "tau", "n_clusters", "n_merges", "min_margin", "pairs"]]

    return log.groupBy(*recording).applyInPandas(cuts, schema)


def stabilities(curve: DataFrame, recording: list[str]) -> DataFrame:
    """Jaccard likeness of each threshold's co-membership pairs with the last one's; two empty sets are alike."""
    before = F.lag("pairs").over(Window.partitionBy(*recording).orderBy("i"))
    together, apart = F.size(F.array_union("pairs", "before")), F.size(F.array_except("pairs", "before")) + F.size(F.array_except("before", "pairs"))
    return curve.withColumn("before", before).withColumn("stability", F.when(F.col("before").isNotNull(), 1 - apart / F.greatest(together, F.lit(1)))).drop("before")


def auto_tau(curve: DataFrame, recording: list[str]) -> DataFrame:
    """The centre of the widest run of thresholds with one partition, the first of equals."""
    w = Window.partitionBy(*recording).orderBy("i")
    broken = F.when(F.coalesce(F.col("stability"), F.lit(0.0)) == 1.0, 0).otherwise(1)
    runs = curve.withColumn("broken", broken).withColumn("run", F.sum("broken").over(w)).groupBy(*recording, "run").agg(F.min("tau").alias("low"), F.max("tau").alias("high"), F.count("*").alias("n"), F.min("i").alias("i"))
    best = F.max_by(F.struct("low", "high"), F.struct("n", (-F.col("i")).alias("i")))
    return runs.where("n > 1").groupBy(*recording).agg(best.alias("p")).select(*recording, F.col("p.low").alias("low"), F.col("p.high").alias("high"), F.round((F.col("p.low") + F.col("p.high")) / 2, 3).alias("auto_tau"))


def chosen_tau(user: Column, auto: Column, backend: Column) -> Column:
    return F.coalesce(user, auto, F.when(backend == "campplus", DEFAULT_TAU["campplus"]).otherwise(DEFAULT_TAU["other"]))


def union_find(groups: DataFrame, recording: list[str], tau: float = 0.90) -> DataFrame:
    """The first version's clustering: cosine pairs from the top, joined unless two of one part would meet."""
    types = dict(groups.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in recording) + ", part int, speaker int, cluster int, n_rejected int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "speaker"]).reset_index(drop=True)
        v, part = np.array(pdf["centroid"].tolist()), pdf["part"].tolist()
        sim, home, rejected = v @ v.T, list(range(len(part))), 0
        for s, i, j in sorted(((-sim[i, j], i, j) for i in range(len(part)) for j in range(i + 1, len(part)) if part[i] != part[j])):
            if -s < tau:
                break
            a, b = home[i], home[j]
            if a == b:
                continue
            if {p for p, h in zip(part, home) if h == a} & {p for p, h in zip(part, home) if h == b}:
                rejected += 1
                continue
            home = [min(a, b) if h in (a, b) else h for h in home]
        return pdf[[*recording, "part", "speaker"]].assign(cluster=home, n_rejected=rejected)

    return groups.groupBy(*recording).applyInPandas(fold, schema)


def separation(vectors: DataFrame, recording: list[str]) -> DataFrame:
    """Lowest likeness of a group's own vectors to its centroid less the highest of two groups' centroids."""
    c = centroids(vectors, [*recording, "speaker"])
    own = vectors.join(c, [*recording, "speaker"]).groupBy(*recording).agg(F.min(dot(F.col("embedding"), F.col("centroid"))).alias("intra"))
    other = c.select(*recording, F.col("speaker").alias("other"), F.col("centroid").alias("o"))
    between = c.join(other, recording).where("speaker < other").groupBy(*recording).agg(F.max(dot(F.col("centroid"), F.col("o"))).alias("inter"))
    return own.join(between, recording).withColumn("margin", F.col("intra") - F.col("inter"))


def pair_accuracy(judged: DataFrame) -> DataFrame:
    """Share of judged pairs (same boolean) on which the clustering (a, b) agrees."""
    return judged.agg(F.avg(((F.col("a") == F.col("b")) == F.col("same")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
