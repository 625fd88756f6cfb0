"""Insert-if-absent, upsert, update and delete on the tender table.

The table is Parquet partitioned by source and by bucket of the content key. Inserts append. Updates come in two ways: merged
on read (`changes`: a batch writes its own rows only), or by rewriting the buckets its keys fall into (`upsert_table`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.jsons import merge
from ..schema import COLUMNS, TENDER, conform
from ..session import drop_dir, hadoop_path, work_dir, written
from . import changes
from .changes import BUCKET, REFRESHED, bucket

TRIPLE = ["numero_procedimiento", "entidad_compradora", "fuente"]
INSERTED, DUPLICATE, ERROR, REJECTED = "insertado", "duplicado", "error", "rechazado"


def _triple() -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")).alias(c) for c in TRIPLE]


def reject_reason() -> Column:
    """Why a row can't be stored, null if it can."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(empty("numero_procedimiento"), "sin numero_procedimiento")
        .when(empty("fuente"), "sin fuente")
        .when(F.col("hash_contenido").isNull(), "sin hash_contenido")
    )


def _chained(links: DataFrame, below: str) -> DataFrame:
    """(o, parent, odd): each row's link replaced by one to the first of its chain, with the parity of the way there. The
    ways double with each round; a link known to end at a first row is `done` and looked up no more."""
    links = links.withColumn("done", F.lit(False))
    while True:
        up = links.select(F.col("o").alias("at"), F.col("parent").alias("next"), F.col("odd").alias("more"), F.col("done").alias("there"))
        met = links.filter("not done").join(up, F.col("parent") == F.col("at"), "left")
        links = written(
            met.select(
                "o", F.coalesce("next", "parent").alias("parent"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"),
                F.coalesce("there", F.lit(True)).alias("done"),
            ).unionByName(links.filter("done")),
            "links", below,
        )
        if links.filter("not done").isEmpty():
            return links.drop("done")


def _accepted(racing: DataFrame, below: str) -> DataFrame:
    """(o, h, t): the rows that inserting in order o with unique h and unique t lets in.

    Of rows equal in both keys only the first can win. In rounds: a row that is first in both of its groups wins. A row with
    one earlier rival, the first of one group, wins if that one loses; such rows form chains, and every row of a chain whose
    first row wins is settled by the parity of its distance. What shares a key with a winner is out, and the rest goes on.
    A group is only asked for its first two rows, by aggregates that fold per task, so a key that many rows hold is no
    task's burden.
    """
    left = written(racing.groupBy("h", "t").agg(F.min("o").alias("o")), "racing", below)
    won, chains = None, False  # most batches are settled by the first round, which asks for the first rows only
    while True:
        firsts = {key: left.groupBy(key).agg(F.min("o").alias(f"{key}1")) for key in "ht"}
        met = left.join(firsts["h"], "h").join(firsts["t"], "t")
        first_h, first_t = F.col("o") == F.col("h1"), F.col("o") == F.col("t1")
        parent = F.lit(None)
        if chains:
            for key in "ht":
                others = left.select("o", key).join(firsts[key].select(F.col(f"{key}1").alias("o")), "o", "left_anti")
                second = others.groupBy(key).agg(F.min("o").alias(f"{key}2"))
                met = met.join(second, key, "left")
            parent = F.when(first_h & (F.col("o") == F.col("t2")), F.col("t1")).when(first_t & (F.col("o") == F.col("h2")), F.col("h1"))
        told = written(met.select("o", "h", "t", (first_h & first_t).alias("first"), parent.cast(racing.schema["o"].dataType).alias("parent")), "told", below)
        new = told.filter("first").select("o", "h", "t")
        links = told.filter("parent is not null").select("o", "parent", F.lit(True).alias("odd"))
        if chains and not links.isEmpty():
            even = _chained(links, below).filter("not odd").join(new.select(F.col("o").alias("parent")), "parent", "left_semi")
            new = written(new.unionByName(told.join(even, "o", "left_semi").select("o", "h", "t")), "won", below)
        won, chains = new if won is None else won.unionByName(new), True
        left = written(told.select("o", "h", "t").join(new, "h", "left_anti").join(new, "t", "left_anti"), "racing", below)
        if left.isEmpty():
            return won


def insert_status(
    batch: DataFrame, table: DataFrame, order: str = "_ord", by_hash: DataFrame | None = None, below: str | None = None
) -> DataFrame:
    """Adds `estatus` and `motivo` to each row of a batch: rechazado (with the reason), insertado, duplicado or error.

    Rows act in the order of the unique column `order`. A row is inserted unless its hash, or its triple (number,
    agency, source), is in the table or was inserted by an earlier row; a taken hash makes it a duplicate, a taken
    triple alone an error. Rows without number, source or hash are rejected. Only the order and the two keys take part.
    The table is read for its key columns only and at once reduced to the keys of the batch; `by_hash` may give another,
    smaller part of it to look hashes up in. The intermediate tables lie in `below`, which a caller that gives it drops when
    the result is no longer read, and then the result is not written either; otherwise all but the result's go at once.
    """
    spark = batch.sparkSession
    given, below = below, below or work_dir(spark, "status")
    judged = batch.withColumn("motivo", reject_reason())
    triple = F.unhex(F.md5(F.concat_ws("\x1f", *_triple())))  # half as long as its digits, and shuffled often
    rows = written(
        judged.filter("motivo is null").select(F.col(order).alias("o"), F.col("hash_contenido").alias("h"), triple.alias("t")), "rows", below
    )
    hashes = (table if by_hash is None else by_hash).select(F.col("hash_contenido").alias("h"))

    def met(keys: DataFrame, key: str) -> DataFrame:
        found = keys.join(rows.select(key).distinct(), key, "left_semi").distinct()
        return found.select(F.lit(key).alias("of"), (F.hex(key) if key == "t" else F.col(key)).alias("key"))

    known = written(met(hashes, "h").unionByName(met(table.select(triple.alias("t")), "t")), "known", below)  # one job for both
    known_h, known_t = (
        known.filter(F.col("of") == key).select((F.unhex("key") if key == "t" else F.col("key")).alias(key)) for key in "ht"
    )
    racing = rows.join(known_h, "h", "left_anti").join(known_t, "t", "left_anti")
    accepted = _accepted(racing, below)
    owner = accepted.select("h", F.col("o").alias("first")).unionByName(
        known_h.select("h", F.lit(None).cast(rows.schema["o"].dataType).alias("first"))
    )
    earlier = F.col("owned") & (F.col("first").isNull() | (F.col("first") < F.col("o")))
    settled = rows.join(owner.withColumn("owned", F.lit(True)), "h", "left").select(
        F.col("o").alias(order),
        F.when(F.col("first") == F.col("o"), INSERTED).when(earlier, DUPLICATE).otherwise(ERROR).alias("estatus"),
    )
    if given is None:
        settled = written(settled, "settled")
        drop_dir(spark, below)
    return judged.join(settled, order, "left").withColumn("estatus", F.coalesce("estatus", F.lit(REJECTED)))


def run_metrics(status: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Per source, and in a last row TOTAL: extracted, inserted, duplicate, error and rejected rows.

    unreadable: what the sources could not read, (fuente, ..., n); counted as extracted and rejected.
    """

    names = {INSERTED: "insertados", DUPLICATE: "duplicados", ERROR: "errores", REJECTED: "rechazados"}
    measures = [
        F.sum("n").alias("extraidos"),
        *[F.sum(F.when(F.col("estatus") == state, F.col("n")).otherwise(0)).alias(name) for state, name in names.items()],
    ]
    source = F.coalesce("fuente", F.lit("SIN FUENTE"))
    rows = status.select("fuente", "estatus", F.lit(1).cast("long").alias("n"))
    if unreadable is not None:
        rows = rows.unionByName(unreadable.select("fuente", F.lit(REJECTED).alias("estatus"), F.col("n").cast("long").alias("n")))
    return (
        rows.withColumn("fuente", source)
        .rollup("fuente")
        .agg(*measures)
        .withColumn("fuente", F.coalesce("fuente", F.lit("TOTAL")))
    )


def create_table(spark: SparkSession, path: str) -> None:
    """An empty tender table."""
    empty = spark.createDataFrame([], TENDER).withColumn(BUCKET, bucket())
    empty.write.mode("overwrite").partitionBy("fuente", BUCKET).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The table with its bucket column; changes not folded yet are merged."""
    base = spark.read.schema(T.StructType([*TENDER.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)
    waiting = changes.pending(spark, path)
    return base if waiting is None else changes.merged(base.select(*COLUMNS), waiting).withColumn(BUCKET, bucket())


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return stored(spark, path).select(*COLUMNS)


def _by_bucket(rows: DataFrame) -> DataFrame:
    """Rows dealt by partition of the table, small ones together and large ones split, so that few files arise."""
    return conform(rows).withColumn(BUCKET, bucket()).hint("rebalance", "fuente", BUCKET)


def append_rows(rows: DataFrame, path: str) -> None:
    _by_bucket(rows).write.mode("append").partitionBy("fuente", BUCKET).parquet(path)


def stage(rows: DataFrame, order_by: list[str]) -> DataFrame:
    """A batch written once to the shared folder with a unique `_ord`. The write needs the batch several times; staged,
    the files are parsed once and the order cannot change between uses or after a lost executor."""
    order = F.struct(*order_by, F.monotonically_increasing_id().alias("_n")).alias("_ord")
    return written(rows.select("*", order), "batch")


def touched(batch: DataFrame) -> Column:
    """Condition on the stored table: its source and bucket are among the batch's. Prunes partitions; at most one term
    per source."""
    pairs: dict[str, list[int]] = {}
    for source, number in batch.filter("fuente is not null").select("fuente", bucket().alias("n")).distinct().collect():
        pairs.setdefault(source, []).append(number)
    terms = [(F.col("fuente") == s) & F.col(BUCKET).isin(sorted(n)) for s, n in sorted(pairs.items())]
    return reduce(Column.__or__, terms, F.lit(False))


def insert_if_absent(batch: DataFrame, path: str, order: str = "_ord") -> DataFrame:
    """Appends the new rows of a batch to the table and returns every row with its `estatus`. A second run of the
    same batch inserts nothing, so a repeated streaming batch is harmless.

    Hashes are looked up in the batch's buckets of all sources, triples in the batch's sources."""
    spark = batch.sparkSession
    table = stored(spark, path)
    keys = batch.agg(F.collect_set("fuente"), F.collect_set(bucket())).first()
    below = work_dir(spark, "status")
    status = written(
        insert_status(batch, table.filter(F.col("fuente").isin(keys[0])), order, table.filter(F.col(BUCKET).isin(keys[1])), below), "insert"
    )
    drop_dir(spark, below)
    append_rows(status.filter(F.col("estatus") == INSERTED), path)
    return status


def upsert(table: DataFrame, batch: DataFrame, order: str = "_ord") -> DataFrame:
    """Table after an upsert by hash, plus `operacion` (insertada, actualizada or null for untouched rows).

    A new hash takes all columns from its first row; the refreshed columns come from the last row of the batch,
    as they do for a known hash. Copies of a hash are folded per task before the shuffle. Rows of the batch without hash
    are not applied, rows of the table without hash stay as they are.
    """
    batch = batch.filter("hash_contenido is not null")
    keyless = table.filter("hash_contenido is null").select(
        *COLUMNS, F.lit(None).cast("string").alias("operacion"), F.lit(0).cast("long").alias("actualizaciones")
    )
    table = table.filter("hash_contenido is not null")
    kept = [c for c in COLUMNS if c not in REFRESHED and c != "hash_contenido"]
    folded = batch.groupBy("hash_contenido").agg(
        F.min_by(F.struct(*kept), order).alias("first"),
        F.max_by(F.struct(*REFRESHED), order).alias("last"),
        F.count(F.lit(1)).alias("n"),
    )
    old = table.select("hash_contenido", F.struct(*COLUMNS).alias("old"))
    both = old.join(folded, "hash_contenido", "full_outer")

    def value(c: str) -> Column:
        if c == "hash_contenido":
            return F.col(c)
        if c in REFRESHED:
            return F.when(F.col("last").isNotNull(), F.col(f"last.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
        return F.when(F.col("old").isNull(), F.col(f"first.{c}")).otherwise(F.col(f"old.{c}")).alias(c)

    operation = F.when(F.col("last").isNull(), None).when(F.col("old").isNull(), "insertada").otherwise("actualizada")
    repeats = F.coalesce("n", F.lit(0)) - F.when(F.col("old").isNull(), 1).otherwise(0)
    return both.select(
        *[value(c) for c in COLUMNS], operation.alias("operacion"), repeats.cast("long").alias("actualizaciones")
    ).unionByName(keyless)


def upsert_counts(result: DataFrame) -> DataFrame:
    """Rows inserted and updates applied, as a load report counts them."""
    return result.agg(
        F.count_if(F.col("operacion") == "insertada").alias("insertadas"),
        F.sum("actualizaciones").alias("actualizadas"),
    )


def upsert_table(batch: DataFrame, path: str, order: str = "_ord") -> DataFrame:
    """Upsert into the stored table. Only the buckets the batch's keys fall into are read and rewritten; the new content
    is staged in the shared folder first, so no plan reads and overwrites the same files."""
    spark = batch.sparkSession
    changes.fold(spark, path)
    batch = batch.filter("hash_contenido is not null")
    table = stored(spark, path).filter(touched(batch)).select(*COLUMNS)
    result = written(upsert(table, batch, order), "upsert")
    replace_buckets(result, path)
    return result


def replace_buckets(rows: DataFrame, path: str) -> None:
    """Overwrites the buckets present in `rows`, leaving the others."""
    _by_bucket(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fuente", BUCKET).parquet(path)


def replace_sources(rows: DataFrame, path: str) -> None:
    """Overwrites the sources present in `rows`, leaving the others. Buckets that a source no longer has go."""
    spark = rows.sparkSession
    changes.fold(spark, path)
    replace_buckets(rows, path)
    kept: dict[str, set[str]] = {}
    for source, number in conform(rows).select("fuente", bucket().alias("n")).distinct().collect():
        kept.setdefault(source, set()).add(f"{BUCKET}={number}")
    for source, names in kept.items():
        files, folder = hadoop_path(spark, f"{path}/fuente={source}")
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith(f"{BUCKET}=") and name not in names:
                files.delete(status.getPath(), True)


def compact(spark: SparkSession, path: str, source: str) -> None:
    """Folds the changes and rewrites a source's buckets, each into as few files as its size asks for."""
    changes.fold(spark, path)
    replace_buckets(written(read_table(spark, path).filter(F.col("fuente") == source), "compact"), path)


def fill_missing(table: DataFrame, parsed: DataFrame, key: str = "id") -> DataFrame:
    """parsed(key, entidad_federativa, municipio, resultado JSON): state and municipality are only filled where
    missing, the result is merged into datos_especificos and marked as processed."""
    right = parsed.select(
        key,
        F.col("entidad_federativa").alias("_estado"),
        F.col("municipio").alias("_municipio"),
        F.col("resultado").alias("_resultado"),
    )
    merged = merge(merge(F.coalesce("datos_especificos", F.lit("{}")), F.col("_resultado")), F.lit('{"procesado":true}'))
    return (
        table.join(right, key, "left")
        .withColumns(
            {
                "entidad_federativa": F.coalesce("entidad_federativa", "_estado"),
                "municipio": F.coalesce("municipio", "_municipio"),
                "datos_especificos": F.when(F.col("_resultado").isNotNull(), merged).otherwise(F.col("datos_especificos")),
            }
        )
        .drop("_estado", "_municipio", "_resultado")
    )


def delete_rows(table: DataFrame, predicate: Column) -> DataFrame:
    """Rows that stay; rows for which the predicate is unknown stay too."""
    return table.filter(~F.coalesce(predicate, F.lit(False)))


def delete_source(spark: SparkSession, path: str, source: str) -> None:
    """Removes all rows of one source by dropping its partition folder."""
    changes.fold(spark, path)
    drop_dir(spark, f"{path}/fuente={source}")


def read_jdbc(spark: SparkSession, url: str, table: str = "licitaciones", **options: str) -> DataFrame:
    """The relational table as it is in a database; numeric id bounds split the read."""
    return conform(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), keep=("id",))


def write_jdbc(rows: DataFrame, url: str, table: str = "licitaciones", **options: str) -> None:
    conform(rows).write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
