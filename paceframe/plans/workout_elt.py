"""Workout load: incremental staging, JSON plans to one row per exercise set, month-partitioned target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceframe.functions.documents import parsed_once
from paceframe.operators.joins import new_rows_only
from paceframe.operators.quality import Rules, split_valid
from paceframe.operators.rollups import high_water_mark, load_control
from paceframe.runtime import written
from paceframe.schemas import WORKOUT_DOCUMENT, WORKOUT_SETS, WORKOUTS_RAW
from paceframe.sources.files import truncate, write_monthly
from paceframe.sources.jdbc import incremental_scan

HEADER = ["allenamento_id", "athlete_id", "data_allenamento", "created_at"]
# Largest values of the one-byte counters and of the decimal(5,2) load.
MAX_COUNTER = 255
MAX_LOAD_KG = 999.99
# Kinds of rows that a document gives.
COUNTED, LISTED, UNREADABLE = 0, 1, 2


def to_raw(workouts: DataFrame) -> DataFrame:
    """Source workouts in the staging layout; a missing document is the empty object."""
    return workouts.select(
        F.col("id").alias("allenamento_id"),
        "athlete_id",
        F.col("data_allenamento").cast("timestamp_ntz").alias("data_allenamento"),
        F.coalesce(F.col("struttura_allenamento"), F.lit("{}")).alias("struttura_allenamento"),
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


def rows_to_stage(workouts: DataFrame, target: DataFrame, staged: DataFrame) -> DataFrame:
    """Workouts past the target's high-water mark that are not staged already.

    The mark comes from the final table, so rows staged by a failed run would be staged
    again without the anti-join.
    """
    mark = high_water_mark(target, "allenamento_id")
    return new_rows_only(to_raw(incremental_scan(workouts, "id", mark)), staged, "allenamento_id")


def expand_documents(raw: DataFrame) -> DataFrame:
    """One row per exercise set with unchecked values, and one per unreadable document; the document is parsed once.

    Workouts without exercises, and exercises without sets, give no row. Missing numbers
    are 0 and a missing name is empty text. Both document shapes are read: an exercise with
    a set count, and one that lists its sets. A chain of generators keeps the work in
    generated code. A count that cannot be a set number stays one row, for the quarantine.

    A document that is no JSON, is blank, or holds a field of a wrong type gives one more row, ``unreadable`` and
    without set values; its exercises that could be read stay.
    """
    text = F.col("struttura_allenamento")
    schema = T.StructType([*WORKOUT_DOCUMENT.fields, T.StructField("_corrupt_record", T.StringType())])
    doc = parsed_once(raw, text, schema, [*HEADER, (F.trim(text) == "").alias("blank")])
    unreadable = F.when(F.col("blank") | F.col("_corrupt_record").isNotNull(), F.array(F.lit(True)))
    both = doc.select(*HEADER, F.inline(F.arrays_zip(
        F.coalesce("esercizi", F.array()).alias("counted"),
        F.coalesce("allenamento.esercizi", F.array()).alias("listed"),
        F.coalesce(unreadable, F.array()).alias("unreadable"),
    )))
    both = both.toDF(*HEADER, "counted", "listed", "unreadable")
    apart = both.select(*HEADER, "counted", "listed", "unreadable", F.explode(F.array(*map(F.lit, (COUNTED, LISTED, UNREADABLE)))).alias("kind"))
    is_counted, is_unreadable = F.col("kind") == COUNTED, F.col("kind") == UNREADABLE
    apart = apart.filter(F.when(is_counted, F.col("counted").isNotNull()).when(is_unreadable, F.col("unreadable").isNotNull()).otherwise(F.col("listed").isNotNull()))
    listed_sets = F.when(F.col("kind") == LISTED, F.col("listed.serie"))
    named = apart.select(
        *HEADER,
        "kind",
        F.coalesce(F.when(is_counted, F.col("counted.nome")).when(~is_unreadable, F.col("listed.nome")), F.when(~is_unreadable, F.lit(""))).alias("nome"),
        "counted",
        F.posexplode_outer(listed_sets).alias("position", "listed_set"),
    )
    n = F.col("counted.serie")
    one = F.sequence(F.lit(1).cast("bigint"), F.lit(1).cast("bigint"))
    repeats = (
        F.when(is_unreadable, one)
        .when(~is_counted, F.when(F.col("position").isNotNull(), one))
        .when(n > MAX_COUNTER, F.sequence(n, n))
        .when(n >= 1, F.sequence(F.lit(1).cast("bigint"), n))
    )
    numbered = named.select(*HEADER, "kind", "nome", "counted", "position", "listed_set", F.explode(repeats).alias("number"))

    def value(counted: str, kind: str) -> Column:
        chosen = F.when(is_counted, F.col(f"counted.{counted}")).otherwise(F.col(f"listed_set.{counted}"))
        return F.when(~is_unreadable, F.coalesce(chosen, F.lit(0)).cast(kind))

    own_number = F.coalesce("listed_set.numero", F.col("position") + 1)
    return numbered.select(
        *HEADER,
        "nome",
        F.when(is_counted, F.col("number")).when(~is_unreadable, own_number).cast("bigint").alias("serie"),
        value("ripetizioni", "bigint").alias("ripetizioni"),
        value("recupero_secondi", "bigint").alias("recupero"),
        value("carico_kg", "double").alias("carico"),
        is_unreadable.alias("unreadable"),
    )


def expand_sets(raw: DataFrame) -> DataFrame:
    """The sets of :func:`expand_documents`."""
    return expand_documents(raw).filter(~F.col("unreadable")).drop("unreadable")


def set_rules() -> Rules:
    """Ranges of the target columns."""
    return {
        "serie_range": F.col("serie").between(1, MAX_COUNTER),
        "ripetizioni_range": F.col("ripetizioni").between(0, MAX_COUNTER),
        "recupero_range": F.col("recupero").between(0, MAX_COUNTER),
        "carico_range": F.abs(F.col("carico")) <= MAX_LOAD_KG,
    }


def workout_sets(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the final table, quarantine with reasons) of staged workouts."""
    return checked_documents(expand_documents(raw))


def checked_documents(expanded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`checked_sets` of the sets; unreadable documents join the quarantine."""
    sets, rejected = checked_sets(expanded.filter(~F.col("unreadable")).drop("unreadable"))
    unreadable = expanded.filter("unreadable").drop("unreadable").withColumn("reasons", F.array(F.lit("document_unreadable")))
    return sets, rejected.unionByName(unreadable)


def checked_sets(expanded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split expanded sets into final rows and quarantine.

    Out-of-range counters are quarantined, not wrapped; loads round half up to two decimals.
    """
    valid, rejected = split_valid(expanded, set_rules())
    final = valid.select(
        "allenamento_id", "athlete_id", "data_allenamento",
        F.col("nome").alias("nome_esercizio"),
        F.col("serie").cast("int").alias("serie_allenamento"),
        F.col("ripetizioni").cast("int").alias("ripetizioni_allenamento"),
        F.col("recupero").cast("int").alias("recupero_allenamento"),
        F.col("carico").cast("decimal(5,2)").alias("peso_allenamento"),
        "created_at",
    )
    return final, rejected


@dataclass(frozen=True)
class LoadPaths:
    """Folders of the staging, target and quarantine tables, in shared storage."""

    staging: str
    target: str
    quarantine: str


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or one that the optimiser knows to be empty, so a first load's anti-joins cost nothing."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.range(0).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def run_load(workouts: DataFrame, paths: LoadPaths) -> DataFrame:
    """One load: stage, check, transform, append, reconcile, empty staging.

    Returns the control row: waiting rows, first and last id, sets written and rows left in
    staging. Re-running adds nothing: rows at or below the target's mark
    are not staged, staged ones not staged twice, and rows of a run that died between its
    writes are recognised by id in the quarantine and in the target, each for itself.
    """
    spark = workouts.sparkSession
    raw_schema = _ntz(WORKOUTS_RAW)
    set_schema = _ntz(WORKOUT_SETS)
    target = _table(spark, paths.target, set_schema)
    staged = _table(spark, paths.staging, raw_schema)
    rows_to_stage(workouts, target, staged).write.mode("append").parquet(paths.staging)

    staged = spark.read.schema(raw_schema).parquet(paths.staging)
    control = load_control(staged).first()
    # only the staged range of the target is looked at: the bounds reach its scan
    in_range = F.col("allenamento_id").between(control["first_id"], control["last_id"])
    # one parse, kept in the shared folder, feeds both writes
    sets, rejected = checked_documents(written(expand_documents(staged), "expanded-sets"))
    known = _table(spark, paths.quarantine, rejected.schema).select("allenamento_id").distinct()
    new_rows_only(rejected, known, "allenamento_id").write.mode("append").parquet(paths.quarantine)
    loaded = target.filter(in_range).select("allenamento_id").distinct()
    before = target.filter(in_range).count()
    sort = ["data_allenamento", "athlete_id", "allenamento_id"]
    write_monthly(new_rows_only(sets, loaded, "allenamento_id"), paths.target, "data_allenamento", sort)
    written_rows = spark.read.schema(set_schema).parquet(paths.target).filter(in_range).count() - before
    truncate(spark, paths.staging, raw_schema)
    left = spark.read.schema(raw_schema).parquet(paths.staging).count()
    return spark.createDataFrame(
        [(control["to_process"], control["first_id"], control["last_id"], written_rows, left)],
        "to_process bigint, first_id bigint, last_id bigint, sets_written bigint, left_in_staging bigint",
    )


def _ntz(schema: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField(f.name, T.TimestampNTZType() if isinstance(f.dataType, T.TimestampType) else f.dataType)
        for f in schema
    ])
