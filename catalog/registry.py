"""Holds the registered queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .inputs import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def register(name: str, run: Query, sql: str | None = None, *views: str) -> None:
    """Adds a query; `views` are the derived inputs its check SQL reads."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = run
    if sql is not None:
        CHECKS[name] = with_views(sql, *views) if views else sql.strip()


def contract_kind(text: str) -> str:
    """Check SQL of the contract kind by keywords, with word lists of its own."""
    words = {
        "OBRA": "obra obras construcción construccion edificación pavimentación rehabilitación",
        "SERVICIO": "servicio servicios consultoría consultoria asesoría asesoria mantenimiento limpieza vigilancia seguridad",
        "ADQUISICION": "adquisición adquisicion compra suministro abastecimiento material equipo insumos",
    }
    low = f"lower({text})"
    score = {k: "(" + " + ".join(f"CAST(contains({low}, '{w}') AS INT)" for w in ws.split()) + ")" for k, ws in words.items()}
    o, s, a = f"({score['OBRA']} + CAST(contains({low}, 'mantenimiento de infraestructura') AS INT))", score["SERVICIO"], score["ADQUISICION"]
    hint = "CASE " + " ".join(
        f"WHEN contains({text}, '{p}-') OR contains({text}, '{p} ') THEN '{k}'" for k, p in (("OBRA", "LO"), ("ADQUISICION", "LA"), ("SERVICIO", "LS"))
    ) + " ELSE 'No especificado' END"
    return f"CASE WHEN {o} + {s} + {a} = 0 THEN {hint} WHEN {o} >= {s} AND {o} >= {a} THEN 'OBRA' WHEN {s} >= {a} THEN 'SERVICIO' ELSE 'ADQUISICION' END"


def stamp(name: str):
    """A timestamp as text, so that no time zone takes part in a comparison."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, timestamps as text: types both engines compare alike."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return df.select(
        *[
            F.col(c).cast("double").alias(c) if k == "decimal" else stamp(c) if k.startswith("timestamp") else F.col(c)
            for c, k in kinds.items()
        ]
    )
