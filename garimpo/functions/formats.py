"""Labels and numbers as the reports print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "—"


def decimal_comma(value: Column, places: int) -> Column:
    """Thousands by points, decimals by a comma; a dash for null."""
    return F.coalesce(F.translate(F.format_number(value, places), ",.", ".,"), F.lit(MISSING))


def seconds(milliseconds: Column, places: int = 3) -> Column:
    """Seconds with a decimal comma and their unit; a dash for null."""
    return F.when(milliseconds.isNull(), F.lit(MISSING)).otherwise(F.concat(decimal_comma(milliseconds / 1000, places), F.lit(" s")))


def byte_size(size: Column) -> Column:
    """Kilobytes with one decimal below a megabyte, else megabytes with two."""
    kb, mb = F.format_string("%.1f KB", size / 1024.0), F.format_string("%.2f MB", size / 1048576.0)
    return F.when(size.isNull(), F.lit(MISSING)).when(size < 1048576, kb).otherwise(mb)


def short_configuration(name: Column) -> Column:
    """``Configuração 2 (…)`` as ``C2 (…)``."""
    return F.regexp_replace(name, r"^Configuração (\d+) \(", "C$1 (")


def load_slug(name: Column) -> Column:
    """``Carga 1 (…)`` as ``carga_1``."""
    return F.replace(F.lower(F.trim(F.regexp_replace(name, r"\(.*$", ""))), F.lit(" "), F.lit("_"))


def context_block(position: Column, file: Column, pages: Column, text: Column) -> Column:
    """A numbered passage with its source, for a prompt."""
    return F.format_string("[%d] %s, p. %s\n%s", position, file, F.array_join(pages.cast("array<string>"), ", "), text)
