"""Raw files to the processed table, and the processed table to the working subset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinel.functions.storage import cut_lineage, file_states
from sentinel.operators import clean, labels, sample
from sentinel.schema import DEFAULTS, Settings
from sentinel.sources import raw, tables


def clean_rows(df: DataFrame, dataset: str) -> DataFrame:
    """Row-wise steps, the same for batch and stream: labels, source, float features."""
    return clean.coerce_features(clean.add_source(labels.map_labels(df, dataset), dataset))


def clean_table(df: DataFrame, dataset: str, threshold: float = DEFAULTS.null_threshold,
                strategy: str = "median") -> tuple[DataFrame, list[str]]:
    """Cleaned rows without duplicates, sparse columns or missing values; and the dropped columns.

    ``row_id`` is set while the rows are distinct. Dropping columns and filling gaps can make rows equal later on,
    so the stages keep the column instead of computing it again.
    """
    unique = cut_lineage(row_key(clean.drop_duplicates(clean_rows(df, dataset))))
    missing = {r["feature"]: r["null_fraction"] for r in clean.null_fractions(unique).collect()}
    dropped = [c for c in unique.columns if missing.get(c, 0.0) > threshold]
    gaps = [c for c, share in missing.items() if share > 0 and c not in dropped]
    return clean.impute(unique.drop(*dropped), strategy, gaps), dropped


def run_preprocessing(spark: SparkSession, raw_dir: str, out_dir: str, dataset: str,
                      force: bool = False) -> bool:
    """Build ``out_dir/processed/<dataset>`` and ``out_dir/dropped_columns/<dataset>``, again if a raw file has changed."""
    path = f"{out_dir.rstrip('/')}/processed/{dataset}"
    files = file_states(spark, raw.list_raw_files(spark, raw_dir, dataset))
    made_of = tables.fingerprint("processed", dataset, files, DEFAULTS.null_threshold)

    def build() -> None:
        df, dropped = clean_table(raw.read_raw(spark, raw_dir, dataset), dataset)
        # First, since the stage counts as done once the processed table is complete. The commit names the columns, too.
        spark.createDataFrame([(dataset, c) for c in dropped], "dataset string, column string").write.mode(
            "overwrite").parquet(f"{out_dir.rstrip('/')}/dropped_columns/{dataset}")
        tables.publish(df, path, ["dataset_source"], made_of, dropped=dropped)

    return tables.build_once(spark, path, build, force, made_of)


def row_key(df: DataFrame) -> DataFrame:
    """Add ``row_id``, an md5 over all columns; a key as long as the rows are distinct."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(df.columns)]
    return df.withColumn("row_id", F.md5(F.concat_ws("\u0001", *parts)))


def run_sampling(spark: SparkSession, out_dir: str, dataset: str, settings: Settings = DEFAULTS,
                 force: bool = False) -> bool:
    """Build ``out_dir/subsets/<dataset>`` with its split column, again if the processed table or the settings have changed."""
    path, origin = (f"{out_dir.rstrip('/')}/{stage}/{dataset}" for stage in ("subsets", "processed"))
    made_of = tables.fingerprint("subset", tables.published(spark, origin), settings.subset_size, settings.seed, settings.test_size)

    def build() -> None:
        source = tables.read_table(spark, origin)
        taken = cut_lineage(sample.stratified_subset(source, settings.subset_size, "row_id", settings.seed))
        split = sample.add_split(taken, "row_id", settings.test_size, seed=settings.seed)
        tables.publish(split, path, ["dataset_source", "split"], made_of)

    return tables.build_once(spark, path, build, force, made_of)
