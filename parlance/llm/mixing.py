"""Mixing sources to target weights by raking, in DataFrame operations.

Documents are summed into cells of (source, language, topic).  Iterative
proportional fitting scales the cells' token weights until their sums match the
target shares of each source, language and topic; only the cells, not the
documents, take part in the iterations: up to ``MAX_CELLS`` of them as arrays on
the driver, beyond that as a DataFrame, by the same steps.  The fitted weight of a cell over its
tokens, scaled so that the largest ratio is 1, is the probability with which each
of its documents is kept.  Whether a document is kept follows from a hash of its id
and text and the seed, so a rerun keeps the same ones.

``documents`` has no topic: by default it is the text's register, told by marks
on its surface (see ``register``); any other column can be given.  Default target
shares are the observed ones raised to ``flatten`` and normed, which lifts small
sources moderately.  Shares that name no existing category are left out and the
others normed.

Rounds go on until every sum is within ``tolerance`` of the total.  They end before
that only once the cells prove that no weights can meet the targets and a round no
longer brings them nearer, or after ``max_rounds``.  The proof: let v be numbers for
the categories and v(cell) the sum over a cell's three.  Weights that met the targets
would make the mean of v(cell) the targets' mean of v, so if that exceeds the largest
v(cell) of any cell there are none.  The logarithms of the factors, of one round or
of all so far, come to be such numbers where the targets are out of reach.  What
distance remained, after how many rounds, and whether it was proved goes to
``report`` and, where the tolerance was not met, to the log.

Null source, language or topic: a category of its own.  Null or empty text: no
tokens; such documents share their cell's probability, and cells without any
token are kept whole.  Repeated rows share one fate.  Empty tables give no rows.
Other columns go through as they are, whatever their names and types.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.runtime import cut, named, unwrapped, whole_row

DIMENSIONS = ("source", "lang", "topic")
FLATTEN, MAX_ROUNDS, TOLERANCE = 0.9, 10_000, 1e-6
#: Up to this many cells they are raked on the driver and broadcast; beyond, documents are dealt by cell and Spark splits hot ones.
MAX_CELLS = 100_000
#: With targets proved unreachable, a round that leaves more than this share of the distance ends the raking.
SETTLED = 0.999
#: By how much the targets' mean must exceed every cell for the proof to hold in spite of rounding.
PROOF = 1e-9
NONE = "\x00none"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def register(text: Column) -> Column:
    """What kind of page a text's surface suggests."""
    return (
        F.when(F.contains(text, F.lit("icense")) | F.contains(text, F.lit("opyright")), "legal")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(F.contains(text, F.lit(" | ")), "listing")
        .otherwise("prose")
    )


def cell_of(topic: Column | None = None) -> list[Column]:
    """The cell that a row of documents belongs to."""
    cell = {"source": named("source"), "lang": named("lang"), "topic": register(named("text").cast("string")) if topic is None else topic}
    return [F.coalesce(v.cast("string"), F.lit(NONE)).alias(f"__{k}") for k, v in cell.items()]


def keyed(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """The cell of each row, beside the ``row`` itself."""
    return docs.select(whole_row(docs), *cell_of(topic))


def observed_shares(cells: DataFrame, dimension: str, flatten: float = FLATTEN) -> DataFrame:
    return cells.groupBy(f"__{dimension}").agg(F.pow(F.sum("tokens").cast("double"), F.lit(flatten)).alias("share"))


def _rake_arrays(codes: list[np.ndarray], goals: list[np.ndarray], tokens: np.ndarray, max_rounds: int, tolerance: float) -> tuple[np.ndarray, dict]:
    """Fitted weights of cells given by category numbers, and the report."""
    total = max(float(tokens.sum()), 1.0)
    weight = tokens.astype(np.float64)
    support = weight > 0
    for code, goal in zip(codes, goals):
        support &= goal[code] > 0
    # a wanted category without a cell that may keep weight cannot be met
    proved = any(bool((goal[np.bincount(code[support], minlength=len(goal)) == 0] > 0).any()) for code, goal in zip(codes, goals))
    reach = [code[support] for code in codes]
    logs = [np.zeros(len(goal)) for goal in goals]

    def proves(v: list[np.ndarray]) -> bool:
        return bool(support.any() and sum(float(goal @ x) for goal, x in zip(goals, v)) / total - sum(x[code] for x, code in zip(v, reach)).max() > PROOF)

    last, rounds, worst = float("inf"), 0, float("inf")
    while rounds < max_rounds:
        step = []
        for code, goal in zip(codes, goals):
            now = np.bincount(code, weight, len(goal))
            factor = np.divide(goal, now, out=np.ones(len(goal)), where=now > 0)
            weight = weight * factor[code]
            step.append(np.log(factor, out=np.zeros(len(goal)), where=factor > 0))
        rounds += 1
        logs = [x + y for x, y in zip(logs, step)]
        worst = max(float(np.abs(np.bincount(code, weight, len(goal)) - goal).max(initial=0.0)) for code, goal in zip(codes, goals))
        if worst <= tolerance * total:
            break
        proved = proved or proves(step) or proves(logs)
        if proved and worst > SETTLED * last:
            break
        last = worst
    return weight, {"rounds": rounds, "distance": worst / total if rounds else 0.0, "met": worst <= tolerance * total, "proved_unreachable": proved}


def _rake_rows(cells: DataFrame, goals: dict[str, DataFrame], total: float, max_rounds: int, tolerance: float) -> tuple[DataFrame, dict]:
    """The same over more cells than the driver should hold."""
    total = max(float(total), 1.0)
    fitted = cells.withColumns({"weight": F.col("tokens").cast("double"), "__all": F.lit(0.0), **{f"__log_{d}": F.lit(0.0) for d in DIMENSIONS}})
    wanted = F.col("tokens") > 0
    for d in DIMENSIONS:
        fitted = fitted.join(goals[d].withColumnRenamed("goal", f"__goal_{d}"), f"__{d}", "left").withColumn(f"__goal_{d}", F.coalesce(f"__goal_{d}", F.lit(0.0)))
        wanted = wanted & (F.col(f"__goal_{d}") > 0)
    fitted = cut(fitted.withColumn("__wanted", wanted))
    proved = any(not goals[d].where("goal > 0").join(fitted.where("__wanted"), f"__{d}", "left_anti").isEmpty() for d in DIMENSIONS)
    last, rounds, worst, mean_all = float("inf"), 0, float("inf"), 0.0
    while rounds < max_rounds:
        for d in DIMENSIONS:
            now = fitted.groupBy(f"__{d}").agg(F.sum("weight").alias("__now"))
            factor = F.when(F.col("__now") > 0, F.col(f"__goal_{d}") / F.col("__now")).otherwise(F.lit(1.0))
            fitted = fitted.join(now, f"__{d}").withColumns({"weight": F.col("weight") * factor, f"__log_{d}": F.when(factor > 0, F.log(factor)).otherwise(F.lit(0.0))}).drop("__now")
        step = F.lit(0.0)
        for d in DIMENSIONS:
            step = step + F.col(f"__log_{d}")
        fitted = cut(fitted.withColumns({"__step": step, "__all": F.col("__all") + step}))
        rounds += 1
        by_category = [
            fitted.groupBy(f"__{d}").agg(F.sum("weight").alias("now"), F.max(f"__goal_{d}").alias("goal"), F.max(f"__log_{d}").alias("log"))
            .agg(F.max(F.abs(F.col("now") - F.col("goal"))).alias("off"), F.sum(F.col("goal") * F.col("log")).alias("mean"))
            for d in DIMENSIONS
        ]
        sums = by_category[0].union(by_category[1]).union(by_category[2]).collect()
        worst, mean = max(r["off"] or 0.0 for r in sums), sum(r["mean"] or 0.0 for r in sums) / total
        mean_all += mean
        if worst <= tolerance * total:
            break
        top = fitted.where("__wanted").agg(F.max("__step").alias("step"), F.max("__all").alias("all")).first()
        proved = proved or top["step"] is not None and (mean - top["step"] > PROOF or mean_all - top["all"] > PROOF)
        if proved and worst > SETTLED * last:
            break
        last = worst
    done = {"rounds": rounds, "distance": worst / total if rounds else 0.0, "met": worst <= tolerance * total, "proved_unreachable": proved}
    return fitted.select(*[f"__{d}" for d in DIMENSIONS], "tokens", "weight"), done


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, flatten: float = FLATTEN, max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE, report: dict | None = None) -> DataFrame:
    """``cells`` (__source, __lang, __topic, tokens) with their fitted ``weight``.

    ``targets`` gives a DataFrame (category, share) for any of the dimensions.
    ``report`` is filled with the rounds, the remaining ``distance`` as a share of
    all tokens, whether the tolerance was ``met`` and whether the targets are
    ``proved_unreachable``.
    """
    cells = cut(cells.select(*[f"__{d}" for d in DIMENSIONS], "tokens"))
    total, n = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    goals = {}
    for d in DIMENSIONS:
        own = (targets or {}).get(d)
        shares = observed_shares(cells, d, flatten) if own is None else own.select(F.coalesce(F.col("category").cast("string"), F.lit(NONE)).alias(f"__{d}"), F.col("share").cast("double").alias("share"))
        present = cells.where("tokens > 0").select(f"__{d}").distinct()
        shares = cut(shares.join(present, f"__{d}", "left_semi"))
        whole = shares.agg(F.sum("share")).first()[0] or 1.0
        goals[d] = shares.select(f"__{d}", (F.col("share") * (float(total) / whole)).alias("goal"))
    if n <= MAX_CELLS:
        rows = cells.toArrow()
        codes, wanted = [], []
        for d in DIMENSIONS:
            column = rows[f"__{d}"].combine_chunks().dictionary_encode()
            if isinstance(column, pa.ChunkedArray):
                column = column.combine_chunks()
            goal = {r[f"__{d}"]: r["goal"] for r in goals[d].collect()}
            codes.append(column.indices.to_numpy(zero_copy_only=False).astype(np.int64))
            wanted.append(np.array([goal.get(name) or 0.0 for name in column.dictionary.to_pylist()], np.float64))
        weight, done = _rake_arrays(codes, wanted, rows["tokens"].to_numpy(), max_rounds, tolerance)
        fitted = cells.sparkSession.createDataFrame(rows.append_column("weight", pa.array(weight, pa.float64())))
    else:
        fitted, done = _rake_rows(cells, goals, total, max_rounds, tolerance)
    if not done["met"]:
        logging.getLogger(__name__).warning("raking left a sum off by %.3g of all tokens after %d rounds%s", done["distance"], done["rounds"], "; no weights can meet the targets" if done["proved_unreachable"] else "")
    if report is not None:
        report.update(done)
    return fitted


def probabilities(docs: DataFrame, targets: dict[str, DataFrame] | None = None, flatten: float = FLATTEN, topic: Column | None = None, report: dict | None = None) -> DataFrame:
    """(__source, __lang, __topic, tokens, weight, probability) for each cell; ``report`` as in ``rake``."""
    cells = docs.select(*cell_of(topic), n_tokens(named("text").cast("string")).alias("n")).groupBy(*[f"__{d}" for d in DIMENSIONS]).agg(F.sum("n").alias("tokens"))
    fitted = rake(cells, targets, flatten, report=report)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    largest = fitted.agg(F.max(ratio)).first()[0] or 1.0
    return cut(fitted.withColumn("probability", F.coalesce(F.least(ratio / largest, F.lit(1.0)), F.lit(1.0))))


def draw(seed: int) -> Column:
    """A number from 0 to 1 that follows from a document's id, its text and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), named("doc_id"), named("text")), F.lit(1 << 53)) / F.lit(float(1 << 53))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, flatten: float = FLATTEN, topic: Column | None = None, seed: int = 0, with_probability: bool = False) -> DataFrame:
    """The documents kept, with their columns (and, in place of any so named, ``topic`` and ``probability``)."""
    cells = probabilities(docs, targets, flatten, topic).select(*[f"__{d}" for d in DIMENSIONS], "probability")
    if cells.count() <= MAX_CELLS:
        cells = F.broadcast(cells)  # texts stay where they are; a hot cell is spread as its rows were
    kept = docs.select(whole_row(docs), *cell_of(topic), draw(seed).alias("draw")).join(cells, [f"__{d}" for d in DIMENSIONS]).where("draw < probability")
    if not with_probability:
        return kept.select(*unwrapped(kept, docs.columns))
    own = [c for c in docs.columns if c.lower() not in ("topic", "probability")]
    return kept.select(*unwrapped(kept, own), F.nullif("__topic", F.lit(NONE)).alias("topic"), "probability")
