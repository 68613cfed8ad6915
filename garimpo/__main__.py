"""Command line: index a folder of tables, search it by either access path, keep the results.

    python -m garimpo TABLES OUT --consulta "prazos de recurso" --modo ambos --k 5
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql.utils import AnalysisException

from garimpo.functions.scoring import K1, B
from garimpo.plans.goldens import QUERY
from garimpo.plans.queries import index_of
from garimpo.sources import results
from garimpo.workdir import ship_package

MODES = {"indexada": ("indexada",), "linear": ("linear",), "ambos": ("linear", "indexada")}


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="garimpo", description="Lexical search over a folder of chunk tables.")
    parser.add_argument("tables", help="folder with chunks.parquet")
    parser.add_argument("out", help="folder for candidates, first results and reports")
    parser.add_argument("--consulta", default=QUERY, help="the query")
    parser.add_argument("--k", type=int, default=5, help="first results to keep; 0 keeps all")
    parser.add_argument("--modo", choices=sorted(MODES), default="indexada", help="by index, by scan, or both")
    parser.add_argument("--metrica", choices=["bm25", "simples"], default="bm25")
    parser.add_argument("--k1", type=float, default=K1)
    parser.add_argument("--b", type=float, default=B)
    return parser.parse_args(argv)


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    """0, or 2 with a message where the tables or parameters can't be used."""
    asked = arguments(argv)
    session = spark or SparkSession.builder.appName("garimpo").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship_package(session)
    try:
        index = index_of(session, asked.tables)
        for mode in MODES[asked.modo]:
            report = results.run_search(index, asked.consulta, f"{asked.out}/{mode}", mode, asked.metrica, asked.k, asked.k1, asked.b)
            print(json.dumps(report, ensure_ascii=False))
            for row in results.read_first(session, f"{asked.out}/{mode}").orderBy("posicao", "id_chunk").limit(asked.k or 20).collect():
                print(f"{row['posicao'] or '-'}\t{row['score']}\t{row['id_chunk']}\t{row['nome_arquivo']}\tp. {', '.join(map(str, row['paginas']))}")
    except (ValueError, AnalysisException) as error:
        print(f"garimpo: {str(error).splitlines()[0]}", file=sys.stderr)
        return 2
    finally:
        if spark is None:
            session.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
