"""Problem 7: a mix in which every source has its target share of the tokens.

The total is the size of all listed sources. A source's budget is its share of
the total, or all its permitted repetitions if that is less. Complete epochs
come first; the rest of the budget is a weighted sample without replacement
(Efraimidis-Spirakis): each document draws an exponential key scaled by its
quality weight, documents are taken in key order until their prefix sum of
tokens meets the rest. The draw is a hash of the seed and the document id, so a
lost task repeats it exactly. The weight is the share of a document's words that none of problem 1's
statistics of junk speaks against (``JUNK``).

Prefix sums go through quantiles of the keys of each source: only the sums between quantiles come together.
The range in which the budget ends is cut by quantiles again until it holds few documents, and only those are
sorted. Rows with the same id and text have one key; they are summed as one and split by arithmetic.

Sources that are null or not listed are in no mix; a listed source without
documents has size 0. Of a source listed twice the greatest share and cap count;
null shares and caps count as 0. Null ids draw by their text. Documents without tokens are never needed to
fill a budget; every row counts, also repeated ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.functions import codepoints as cp
from garimpo.llm import profile as pf
from garimpo.llm.tokens import DEFAULT, TOKENIZERS, Encoder, load_merges
from garimpo.workdir import materialize

DOCS_PER_BUCKET = 20_000  # documents of a source sorted in one task, after their copies are put together
QUANTILES = 32
BROADCAST_SOURCES = 10_000  # listed sources up to which their plan is broadcast
JUNK = ("numericas", "simbolos", "estranhas", "ciclicas", "linha_numero", "linha_tabela")
LEAST_WEIGHT = 0.05


def _junk(x: pf.Text) -> dict[str, np.ndarray]:
    lines = pf.line_values(x) if x.n else {}
    return {"numericas": x.w.digits > 0, "simbolos": pf.symbols(x), "estranhas": pf.odd_words(x), "ciclicas": pf.passages(x, 3), **lines}


PLAN = pf.Plan(JUNK, _junk, 0)


class Mix(NamedTuple):
    """``documents``: doc id, source, tokens, vezes; ``report``: one row for each listed source."""

    documents: DataFrame
    report: DataFrame


def quality(t: cp.Texts) -> np.ndarray:
    """Weight of each text: the product of 1 less its mean of each statistic of junk, at least LEAST_WEIGHT."""
    made = pf.profile(t, PLAN, True)
    means = made.totals / (np.maximum(made.words, 1)[:, None] * float(pf.UNIT))
    return np.maximum(np.prod(1 - np.minimum(means, 1), axis=1), LEAST_WEIGHT)


def sized_documents(df: DataFrame, key: str, text: str, source: str, tokenizer: str = DEFAULT, folder: str = TOKENIZERS) -> DataFrame:
    """(key, source, digest of the text, tokens, qualidade) of every document; a map without any shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(load_merges(tokenizer, folder))
    names = [key, "source", "__h", "tokens", "qualidade"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for at, t in cp.spans(batch.column(3)):
                made = [pa.array(encoder.sizes(t), pa.int64()), pa.array(quality(t), pa.float64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, t.rows) for i in (0, 1, 2)), *made], names)

    schema = T.StructType([df.schema[key], *T.StructType.fromDDL("source string, __h bigint, tokens bigint, qualidade double").fields])
    text_of = F.col(text).cast("string")
    return df.select(key, F.col(source).cast("string").alias("source"), F.xxhash64(text_of).alias("__h"), text_of.alias("__text")).mapInArrow(run, schema)


def _by_source(plan: DataFrame) -> DataFrame:
    """The rows of a plan, one for each listed source, to be joined: broadcast if they are few."""
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def edge_ranges(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, de, ate, antes): the range of keys in which the budget of each source ends, and the tokens of the keys before it.

    Each round replaces the range of a source by one of its parts between quantiles, about a ``QUANTILES``-th of its
    documents, until at most DOCS_PER_BUCKET are left or all have one key.
    """
    start = plan.where("resto > 0").select("source", "resto", F.lit(0.0).alias("de"), F.lit(float("inf")).alias("ate"), F.lit(0).cast("bigint").alias("antes"), F.col("documentos").alias("n"))
    ranges = materialize(start, "margens")
    while not ranges.where((F.col("n") > DOCS_PER_BUCKET) & (F.col("de") < F.col("ate"))).isEmpty():
        wide = ranges.where((F.col("n") > DOCS_PER_BUCKET) & (F.col("de") < F.col("ate")))
        inside = keyed.select("source", "chave", "tokens").join(_by_source(wide), "source").where("chave >= de and chave <= ate")
        quantiles = F.percentile_approx("chave", [i / QUANTILES for i in range(1, QUANTILES)], 10_000)
        edges = materialize(inside.groupBy("source").agg(quantiles.alias("__e")), "quantis")
        placed = inside.join(_by_source(edges), "source").withColumn("__b", F.size(F.filter("__e", lambda e: e < F.col("chave"))))
        sums = placed.groupBy("source", "__b", "resto", "antes").agg(F.sum("tokens").alias("s"), F.count("*").alias("n"), F.min("chave").alias("de"), F.max("chave").alias("ate"))
        w = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)  # QUANTILES rows
        sums = sums.withColumn("__t", F.col("antes") + F.sum("s").over(w)).where(F.col("__t") > F.col("resto"))
        first = sums.groupBy("source", "resto").agg(F.min(F.struct("__b", "de", "ate", (F.col("__t") - F.col("s")).alias("antes"), "n")).alias("x"))
        cut = first.select("source", "resto", "x.de", "x.ate", "x.antes", "x.n")
        ranges = materialize(ranges.join(wide.select("source"), "source", "left_anti").unionByName(cut), "margens")
    return ranges.select("source", "de", "ate", "antes")


def mix_sources(
    docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, tokenizer: str = DEFAULT, folder: str = TOKENIZERS
) -> Mix:
    """The mix of ``docs`` by ``targets`` (source, peso, max_repeticoes); see the module text."""
    listed = targets.where(F.col("source").isNotNull()).groupBy("source")
    listed = listed.agg(F.coalesce(F.max("peso"), F.lit(0.0)).alias("peso"), F.coalesce(F.max("max_repeticoes"), F.lit(0)).cast("int").alias("max_repeticoes"))
    sized = sized_documents(docs.where(F.col("source").isNotNull()), key, text, "source", tokenizer, folder)
    sized = materialize(sized.join(listed.select("source"), "source", "left_semi").where("tokens > 0"), "tamanhos")
    sizes = sized.groupBy("source").agg(F.sum("tokens").alias("tamanho"), F.count("*").alias("documentos"), F.max("tokens").alias("maior"))
    plan = listed.join(sizes, "source", "left").fillna(0, ["tamanho", "documentos", "maior"])
    total = plan.agg(F.sum("tamanho")).first()[0] or 0  # one number
    plan = plan.withColumn("alvo", F.col("peso") * F.lit(float(total)))
    plan = plan.withColumn("orcamento", F.least("alvo", (F.col("tamanho") * F.col("max_repeticoes")).cast("double")))
    plan = plan.withColumn("epocas", F.when(F.col("tamanho") > 0, F.floor(F.col("orcamento") / F.col("tamanho"))).otherwise(0).cast("int"))
    plan = plan.withColumn("resto", F.col("orcamento") - F.col("epocas") * F.col("tamanho"))
    plan = materialize(plan.coalesce(1), "plano")

    # a third of the documents may be of one source: the small plan is joined, the documents stay where they are
    draw = (F.shiftrightunsigned(F.xxhash64(key, "__h", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = sized.join(_by_source(plan.select("source", "epocas", "resto")), "source")
    keyed = keyed.withColumn("chave", -F.log(draw) / F.col("qualidade"))
    placed = keyed.join(_by_source(edge_ranges(keyed, plan)), "source", "left")
    at_edge = F.coalesce(F.col("chave").between(F.col("de"), F.col("ate")), F.lit(False))
    same = [key, "__h", "source", "tokens", "epocas", "resto", "antes", "chave"]
    edge = placed.where(at_edge).groupBy(*same).agg(F.count("*").alias("copias"))
    inner = Window.partitionBy("source").orderBy("chave", key, "__h").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.col("tokens") * F.col("copias")
    edge = edge.withColumn("__room", F.col("resto") - F.col("antes") - (F.sum(weight).over(inner) - weight))
    # the document on the edge is taken if half of it fits
    taken = F.greatest(F.least(F.floor(F.col("__room") / F.col("tokens") + 0.5), F.col("copias")), F.lit(0))
    edge = edge.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), "copias"))).withColumn("mais", (F.col("__i") <= taken).cast("int"))
    rest = placed.where(~at_edge).withColumn("mais", F.coalesce(F.col("chave") < F.col("de"), F.lit(False)).cast("int"))
    columns = [key, "source", "tokens", (F.col("epocas") + F.col("mais")).alias("vezes")]
    chosen = materialize(edge.select(columns).unionByName(rest.select(columns)).where("vezes > 0"), "mistura")

    reached = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("vezes")).alias("tokens_na_mistura"), F.max("vezes").alias("vezes"))
    report = plan.join(reached, "source", "left").fillna(0, ["tokens_na_mistura", "vezes"])
    mixed = chosen.agg(F.sum(F.col("tokens") * F.col("vezes"))).first()[0] or 0  # one number
    report = report.select(
        "source", "peso", "max_repeticoes", "tamanho", "documentos", "maior", "alvo", "epocas", "vezes", "tokens_na_mistura",
        (F.col("tokens_na_mistura") / F.lit(float(max(mixed, 1)))).alias("parte"),
        (F.col("tokens_na_mistura") / F.lit(float(max(total, 1)))).alias("parte_do_total"),
        ((F.col("tamanho") * F.col("max_repeticoes")).cast("double") < F.col("alvo")).alias("insuficiente"),
    )
    return Mix(chosen, report)
