"""Measurements: summaries, growth exponents, model fits, closed forms."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Growth models in order of complexity, and the thresholds on the exponent.
MODELS = ("O(1)", "O(log n)", "O(n)", "O(n log n)", "O(n^2)")
CONSTANT_UP_TO, LOGARITHMIC_FROM, QUADRATIC_FROM, R2_TOLERANCE = 0.30, 0.30, 1.50, 0.05


def model_value(name: Column, n: Column) -> Column:
    """f(n) of a growth model."""
    log2 = F.log2(F.greatest(n, F.lit(2.0)))
    return F.when(name == "O(1)", 1.0).when(name == "O(log n)", log2).when(name == "O(n)", n).when(name == "O(n log n)", n * log2).otherwise(n * n)


def valid_points(points: DataFrame, above: float = 1.0) -> DataFrame:
    """Points (x, y) that have logarithms: x beyond ``above`` and y positive."""
    return points.where((F.col("x") > above) & (F.col("y") > 0))


def loglog(points: DataFrame, by: list[str], above: float = 1.0, least: int = 3) -> DataFrame:
    """Exponent, factor and R2 of y = c * x^p for each series; null below ``least`` points or without spread."""
    lx, ly = F.ln("x"), F.ln("y")
    fitted = valid_points(points, above).groupBy(*by).agg(
        F.count("*").alias("pontos"), F.regr_slope(ly, lx).alias("p"), F.regr_intercept(ly, lx).alias("i"), F.regr_r2(ly, lx).alias("r2")
    )
    enough = F.col("pontos") >= least
    return fitted.select(
        *by, "pontos", F.when(enough, F.round("p", 4)).alias("expoente"), F.when(enough, F.round(F.exp("i"), 6)).alias("fator"), F.when(enough, F.round("r2", 4)).alias("r2")
    )


def model_fit(points: DataFrame, by: list[str]) -> DataFrame:
    """Coefficient, R2 and RMSE of ln y on ln f(x) through the origin, for each series and model.

    Below three points, or where all ln f(x) are 0: 0, 0 and infinity. R2 can be negative.
    """
    spark = points.sparkSession
    models = spark.createDataFrame([(i, m) for i, m in enumerate(MODELS)], "ordem int, modelo string")
    each = valid_points(points).select(*by, F.ln("y").alias("y"), "x", F.explode(F.array(*map(F.lit, MODELS))).alias("modelo"))
    each = each.withColumn("b", F.ln(model_value(F.col("modelo"), F.col("x"))))
    key = [*by, "modelo"]
    slope = each.groupBy(*key).agg(
        F.count("*").alias("n"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.sum(F.col("b") * F.col("y")).alias("by"), F.avg("y").alias("mean")
    )
    error = each.join(slope, key).groupBy(*key).agg(
        F.sum(F.pow(F.col("y") - F.try_divide("by", "bb") * F.col("b"), F.lit(2))).alias("rss"), F.sum(F.pow(F.col("y") - F.col("mean"), F.lit(2))).alias("tss")
    )
    out = slope.join(error, key).join(F.broadcast(models), "modelo")
    fit = (F.col("n") >= 3) & (F.col("bb") > 0)
    r2 = F.when(F.col("tss") == 0, F.when(F.col("rss") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide("rss", "tss"))
    return out.select(
        *by, "ordem", "modelo", F.when(fit, F.round(F.exp(F.try_divide("by", "bb")), 6)).otherwise(0.0).alias("coeficiente"),
        F.when(fit, F.round(r2, 6)).otherwise(0.0).alias("r2"), F.when(fit, F.round(F.sqrt(F.col("rss") / F.col("n")), 6)).otherwise(float("inf")).alias("rmse"),
    )


def prefix_r2(points: DataFrame, by: list[str], order: str) -> DataFrame:
    """R2 (floored at 0) of each model over the first 3, 4, ... points of each series."""
    w = Window.partitionBy(*by).orderBy(order)
    numbered = points.withColumns({"i": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(*by))})
    spread = numbered.select(*by, "x", "y", F.explode(F.sequence(F.greatest("i", F.lit(3)), F.greatest(F.col("n").cast("int"), F.lit(3)))).alias("ate")).where("ate >= 3")
    fitted = model_fit(spread, [*by, "ate"]).where("modelo != 'O(log n)'")
    return fitted.select(*by, "ate", "modelo", F.greatest("r2", F.lit(0.0)).alias("r2"))


def preferred_model(fits: DataFrame, by: list[str]) -> DataFrame:
    """The simplest model within the tolerance of the best R2, of all but O(log n), for each series."""
    usable = fits.where("modelo != 'O(log n)'").withColumn("r2", F.greatest("r2", F.lit(0.0)))
    best = usable.withColumn("best", F.max("r2").over(Window.partitionBy(*by)))
    return best.where(F.col("r2") >= F.col("best") - R2_TOLERANCE).groupBy(*by).agg(F.min_by("modelo", "ordem").alias("preferido"), F.count("*").alias("empatados"))


def complexity_class(exponent: Column, corrected: bool = False) -> Column:
    """The class of a growth exponent.

    As published, the limits of O(1) and O(n log n) meet, so that O(n) is only
    given without an exponent; ``corrected`` puts O(n) up to 1.15.
    """
    published = F.when(exponent.isNull(), "O(n)").when(exponent <= CONSTANT_UP_TO, "O(1)").when(exponent >= QUADRATIC_FROM, "O(n^2)")
    if corrected:
        return published.when(exponent <= 1.15, "O(n)").otherwise("O(n log n)")
    return published.when(exponent >= LOGARITHMIC_FROM, "O(n log n)").otherwise("O(n)")


def round_binary(value: Column, places: int) -> Column:
    """Rounded as the binary value stands, not as its shortest decimal: 23.12645 is a little less, and gives 23.1264."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5) / scale


def run_summary(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, population deviation, least, most, median and number of the successful runs of each group."""
    return runs.where((F.col("status") == "sucesso") & F.col(value).isNotNull()).groupBy(*by).agg(
        round_binary(F.avg(value), 4).alias("media"), round_binary(F.stddev_pop(value), 4).alias("desvio"), F.min(value).alias("minimo"), F.max(value).alias("maximo"),
        F.median(value).alias("mediana"), F.count("*").alias("execucoes"),
    )


def sort_closed_forms(n: Column) -> list[Column]:
    """Calls, depth and moves of a top-down merge sort of ``n`` items."""
    log = F.when(n > 0, F.ceil(F.log2(n.cast("double")))).otherwise(0)
    power = F.pow(F.lit(2.0), log).cast("bigint")
    return [
        F.when(n > 0, 2 * n - 1).otherwise(1).cast("bigint").alias("chamadas"), (1 + log).cast("int").alias("profundidade"),
        F.when(n > 0, n * log - power + n).otherwise(0).cast("bigint").alias("movimentacoes"),
    ]


def tie_statistics(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows, distinct scores and ties of each group."""
    n, distinct = F.count("*"), F.count_distinct("score")
    return scored.groupBy(*by).agg(n.alias("n"), distinct.alias("distintos"), (n - distinct).alias("empates"))


def sort_counters(items: DataFrame, n: int) -> DataFrame:
    """One row: the work of a halving merge sort of ``n`` items (p, r, score): place in the given order from 0, rank in the sorted one from 1.

    Each item stands in one part at every depth. A merge compares once for each item that it puts out
    before one of its sides is used up, which are those up to the lesser of both sides' last ranks; ids are compared
    where the other side still holds an equal score. So all counts are groupings by part, and no task holds a part.
    """
    depth = max(n - 1, 0).bit_length()
    at = items.select(F.col("p").cast("bigint").alias("p"), F.col("r").cast("bigint").alias("r"), "score", F.lit(0).cast("bigint").alias("__lo"), F.lit(n).cast("bigint").alias("__hi"))
    steps = F.sequence(F.lit(0), F.lit(max(depth - 1, 0)))

    def halve(part: Column, _: Column) -> Column:
        lo, hi, seen = part.lo, part.hi, part.seen
        mid = F.floor((lo + hi) / 2).cast("bigint")
        left = F.col("p") < mid
        here = F.when(hi - lo > 1, F.array(F.struct(lo.alias("lo"), hi.alias("hi"), left.alias("a")))).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint,a:boolean>>"))
        return F.struct(F.when(left, lo).otherwise(mid).alias("lo"), F.when(left, mid).otherwise(hi).alias("hi"), F.concat(seen, here).alias("seen"))

    start = F.struct(F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), F.array().cast("array<struct<lo:bigint,hi:bigint,a:boolean>>").alias("seen"))
    parts = at.select("r", "score", F.explode(F.aggregate(steps, start, halve).seen).alias("x")).select("r", "score", "x.lo", "x.hi", "x.a")
    last = parts.groupBy("lo", "hi").agg(F.max(F.when(F.col("a"), F.col("r"))).alias("ra"), F.max(F.when(~F.col("a"), F.col("r"))).alias("rb"))
    equal = parts.groupBy("lo", "hi", "score").agg(F.max(F.when(F.col("a"), F.col("r"))).alias("ea"), F.max(F.when(~F.col("a"), F.col("r"))).alias("eb"))
    joined = parts.join(last, ["lo", "hi"]).join(equal, ["lo", "hi", "score"])
    compared = F.col("r") <= F.least("ra", "rb")
    tie = compared & F.coalesce(F.when(F.col("a"), F.col("eb")).otherwise(F.col("ea")) > F.col("r"), F.lit(False))
    counts = joined.agg(F.count_if(compared).alias("comparacoes_score"), F.count_if(tie).alias("comparacoes_id"))
    calls, levels, moves = sort_closed_forms(F.lit(n))
    return counts.select(F.lit(n).cast("bigint").alias("n"), "comparacoes_score", "comparacoes_id", moves, calls, levels, (F.col("comparacoes_score") + F.col("comparacoes_id")).alias("comparacoes"))


def size_points(total: int, steps: int) -> Iterator[int]:
    """Distinct growing sizes up to ``total``: the i-th of ``steps`` equal parts, at least 1."""
    return iter(dict.fromkeys(max(total * (i + 1) // steps, 1) for i in range(steps)))


def growth_sweep(tokens: DataFrame, order: str, terms: list[str], sizes: list[int]) -> DataFrame:
    """For each prefix size: chunks, tokens, distinct terms, postings and candidates of a query.

    ``tokens`` is (order, term, tf). A term is counted in the first prefix that
    holds it, so each posting is read once however many prefixes there are.
    """
    spark = tokens.sparkSession
    edges = sorted(sizes)
    slot = F.lit(None).cast("int")
    for i in reversed(range(len(edges))):
        slot = F.when(F.col(order) <= edges[i], i).otherwise(slot)
    placed = tokens.withColumn("slot", slot).where("slot is not null")
    asked = F.col("term").isin(terms) if terms else F.lit(False)
    per_slot = placed.groupBy("slot").agg(F.sum("tf").alias("tokens"), F.count_if(asked).alias("postings"))
    first_seen = placed.groupBy("term").agg(F.min("slot").alias("slot")).groupBy("slot").agg(F.count("*").alias("termos"))
    candidates = placed.where(asked).select("slot", order).distinct().groupBy("slot").agg(F.count("*").alias("candidatos"))
    base = spark.createDataFrame([(i, n) for i, n in enumerate(edges)], "slot int, tamanho bigint")
    out = base.join(per_slot, "slot", "left").join(first_seen, "slot", "left").join(candidates, "slot", "left").fillna(0)
    w = Window.partitionBy(F.lit(0)).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)  # one row a size
    return out.select("tamanho", *(F.sum(c).over(w).alias(c) for c in ("tokens", "termos", "postings", "candidatos")))
