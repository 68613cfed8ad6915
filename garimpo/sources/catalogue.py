"""The catalogue of files and the report on their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.functions import text as tx
from garimpo.operators.ordinals import global_ordinal


def inventory(files: DataFrame) -> DataFrame:
    """Files in path order: new id, digest of the path, address recorded for the file name. Repeated documents count once."""
    w = Window.partitionBy("id_documento").orderBy("caminho_relativo")
    once = files.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select("id_documento", "nome_arquivo", "caminho_relativo")
    address = files.groupBy("nome_arquivo").agg(F.min("fonte_url").alias("url"))
    numbered = global_ordinal(once, ["caminho_relativo", "id_documento"], "__n").join(address, "nome_arquivo", "left")
    return numbered.select(F.format_string("doc_%03d", "__n").alias("novo_id"), "id_documento", "caminho_relativo", F.sha2("caminho_relativo", 256).alias("chave_caminho"), "url")


def content_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files of a folder, read by the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("tamanho_bytes"), F.sha2("content", 256).alias("hash_sha256"))


# Why a page has no text.
WITH_IMAGE, WITHOUT_IMAGE = "imagem_presente_sem_camada_textual", "sem_texto_e_sem_imagem_detectavel"


def empty_reason(text: Column, image: Column) -> Column:
    """Why a page is empty, by whether it holds an image; null for pages with text."""
    return F.when(tx.is_blank(text), F.when(F.coalesce(image, F.lit(False)), WITH_IMAGE).otherwise(WITHOUT_IMAGE))


def processing_report(pages: DataFrame) -> DataFrame:
    """For each document: pages, empty pages, and a warning for each empty page in page order. The latest row of a page counts."""
    newest = F.max(F.struct("carregado_em", "texto_normalizado", "motivo_status"))
    once = pages.groupBy("id_documento", "numero_pagina").agg(newest.alias("p")).select("id_documento", "numero_pagina", "p.*")
    blank = tx.is_blank(F.col("texto_normalizado"))
    warning = F.when(blank, F.struct("numero_pagina", F.concat(F.lit("página "), F.col("numero_pagina").cast("string"), F.lit(": "), F.coalesce("motivo_status", F.lit("sem motivo"))).alias("w")))
    out = once.groupBy("id_documento").agg(F.count("*").alias("paginas"), F.count_if(blank).alias("vazias"), F.array_sort(F.collect_list(warning)).alias("__w"))
    return out.select("id_documento", "paginas", "vazias", F.array_join(F.transform("__w", lambda x: x.w), "; ").alias("avisos"))
