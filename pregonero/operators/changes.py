"""Changes of the tender table kept beside it and merged when it is read.

A batch of changes appends one row per key to `_cambios/filas/lote=<number>`; nothing of the table itself is rewritten. A
reader folds each key's changes in the order of their batches onto the stored row: four kinds, applied one after the other.
Rows without changes pass through a left join with the folded changes, which is broadcast as long as they are small; keys that
the table lacks are added. `fold` writes the changes into the buckets they touch, many batches at once, and drops them.

Applying a change twice gives what applying it once gives, so a fold that is cut off between its two steps does no harm, and a
batch written again under its own number replaces itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.jsons import merge
from ..schema import COLUMNS, TENDER, conform
from ..session import drop_dir, hadoop_path, written

BUCKET = "cubo"
#: Buckets per source; the same for all writers of a table.
BUCKETS = 16
# The columns an upsert refreshes.
REFRESHED = [
    "entidad_federativa", "municipio", "datos_especificos", "fecha_publicacion", "fecha_apertura", "fecha_fallo",
    "fecha_junta_aclaraciones",
]
UPSERT, FILL, PATCH, DELETE = "upsert", "completa", "parche", "borra"
CHANGE = T.StructType(
    [
        T.StructField("hash_contenido", T.StringType()), T.StructField("op", T.StringType()), T.StructField("valores", TENDER),
        T.StructField("parche", T.StringType()), T.StructField("lote", T.LongType()),
    ]
)


def bucket(buckets: int = BUCKETS) -> Column:
    """The bucket of a row's key; rows without key are in bucket 0."""
    return F.when(F.col("hash_contenido").isNull(), 0).otherwise(F.pmod(F.xxhash64("hash_contenido"), F.lit(buckets))).cast("int")


def _folder(path: str) -> str:
    return f"{path}/_cambios/filas"


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches not folded yet."""
    files, folder = hadoop_path(spark, _folder(path))
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.removeprefix("lote=")) for n in names if n.startswith("lote="))


def pending(spark: SparkSession, path: str) -> DataFrame | None:
    """The changes not folded yet, None without any."""
    return spark.read.schema(CHANGE).parquet(_folder(path)) if batches(spark, path) else None


def _append(rows: DataFrame, path: str, number: int | None) -> int:
    """Writes a batch (hash_contenido, op, valores, parche) of one row per key, under a number of its own or the one given."""
    spark = rows.sparkSession
    if number is None:
        number = max(batches(spark, path), default=0) + 1
    missing = [c for c in ("valores", "parche") if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast(CHANGE[c].dataType) for c in missing}).filter("hash_contenido is not null")
    rows.select(*CHANGE.fieldNames()[:-1]).hint("rebalance").write.mode("overwrite").parquet(f"{_folder(path)}/lote={number}")
    return number


def append_upsert(batch: DataFrame, path: str, order: str = "_ord", number: int | None = None) -> int:
    """An upsert by key: a new key takes the values of its first row, refreshed columns those of its last. Copies of a key are
    folded per task before the shuffle; rows without key are not applied."""
    first = F.min_by(F.struct(*[c for c in COLUMNS if c not in REFRESHED]), order).alias("first")
    folded = conform(batch, keep=(order,)).filter("hash_contenido is not null").groupBy("hash_contenido").agg(
        first, F.max_by(F.struct(*REFRESHED), order).alias("last")
    )
    values = F.struct(*[F.col(f"{'last' if c in REFRESHED else 'first'}.{c}").alias(c) for c in COLUMNS])
    return _append(folded.select("hash_contenido", F.lit(UPSERT).alias("op"), values.alias("valores")), path, number)


def append_fill(parsed: DataFrame, path: str, number: int | None = None) -> int:
    """parsed(hash_contenido, entidad_federativa, municipio, resultado JSON), one row per key: state and municipality only
    where missing, the result merged into the specifics and marked as processed."""
    place = {"entidad_federativa", "municipio"}
    values = F.struct(*[(F.col(c) if c in place else F.lit(None)).cast(TENDER[c].dataType).alias(c) for c in COLUMNS])
    return _append(parsed.select("hash_contenido", F.lit(FILL).alias("op"), values.alias("valores"), F.col("resultado").alias("parche")), path, number)


def append_patch(patches: DataFrame, path: str, number: int | None = None) -> int:
    """patches(hash_contenido, parche JSON), one row per key, merged into the originals of rows that have some."""
    return _append(patches.select("hash_contenido", F.lit(PATCH).alias("op"), "parche"), path, number)


def append_delete(keys: DataFrame, path: str, number: int | None = None) -> int:
    return _append(keys.select("hash_contenido").distinct().withColumn("op", F.lit(DELETE)), path, number)


def _applied(state: Column, change: Column) -> Column:
    """A row (null if there is none) after one change."""
    values, patch = change["valores"], change["parche"]
    nothing = F.lit(None).cast(TENDER)

    def row(new: dict[str, Column]) -> Column:
        return F.struct(*[new.get(c, state[c]).cast(TENDER[c].dataType).alias(c) for c in COLUMNS])

    filled = {c: F.coalesce(state[c], values[c]) for c in ("entidad_federativa", "municipio")}
    filled["datos_especificos"] = F.when(
        patch.isNotNull(), merge(merge(F.coalesce(state["datos_especificos"], F.lit("{}")), patch), F.lit('{"procesado":true}'))
    ).otherwise(state["datos_especificos"])
    return (
        F.when(change["op"] == DELETE, nothing)
        .when(change["op"] == UPSERT, F.when(state.isNull(), values).otherwise(row({c: values[c] for c in REFRESHED})))
        .when(state.isNull(), nothing)
        .when(change["op"] == FILL, row(filled))
        .otherwise(row({"datos_originales": merge(state["datos_originales"], patch)}))
    )


def merged(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The table's rows after the changes. A key's changes are as many as the batches that name it."""
    listed = F.array_sort(F.collect_list(F.struct("lote", "op", "valores", "parche")))
    folded = changes.groupBy("hash_contenido").agg(listed.alias("_cambios")).withColumnRenamed("hash_contenido", "_clave")
    met = base.join(folded, F.col("hash_contenido") == F.col("_clave"), "left")
    after = F.aggregate("_cambios", F.struct(*[F.col(c) for c in COLUMNS]), _applied)
    known = met.select(F.when(F.col("_cambios").isNull(), F.struct(*[F.col(c) for c in COLUMNS])).otherwise(after).alias("fila"))
    new = folded.join(base.select("hash_contenido"), F.col("hash_contenido") == F.col("_clave"), "left_anti").select(
        F.aggregate("_cambios", F.lit(None).cast(TENDER), _applied).alias("fila")
    )
    return known.unionAll(new).filter("fila is not null").select("fila.*")


def fold(spark: SparkSession, path: str) -> None:
    """Writes the changes into the buckets they touch and drops them. Changes that arrive meanwhile stay."""
    numbers = batches(spark, path)
    if not numbers:
        return
    base = spark.read.schema(T.StructType([*TENDER.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)
    changes = pending(spark, path).filter(F.col("lote").isin(numbers))
    keys = written(changes.select("hash_contenido").distinct(), "changed-keys")
    after = merged(base.select(*COLUMNS), changes)
    # the buckets of changed rows, before and after: at most sources x buckets
    pairs = {
        (r.fuente, r.n)
        for rows in (base, after)
        for r in rows.join(keys, "hash_contenido", "left_semi").select("fuente", bucket().alias("n")).distinct().collect()
    }
    touched = [F.col("fuente").eqNullSafe(s) & (bucket() == n) for s, n in sorted(pairs, key=str)]
    # read by partition: the condition on the stored bucket prunes files, the one on the key finds new rows
    inside = [F.col("fuente").eqNullSafe(s) & (F.col(BUCKET) == n) for s, n in sorted(pairs, key=str)]
    part = base.filter(reduce(Column.__or__, inside, F.lit(False))).select(*COLUMNS)
    rows = written(merged(part, changes).filter(reduce(Column.__or__, touched, F.lit(False))), "folded")
    conform(rows).withColumn(BUCKET, bucket()).hint("rebalance", "fuente", BUCKET).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("fuente", BUCKET).parquet(path)
    left = {(r.fuente, r.n) for r in rows.select("fuente", bucket().alias("n")).distinct().collect()}
    for source, number in pairs - left:  # emptied by deletes
        drop_dir(spark, f"{path}/fuente={source}/{BUCKET}={number}")
    for number in numbers:
        drop_dir(spark, f"{_folder(path)}/lote={number}")
