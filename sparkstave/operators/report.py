"""Roll-ups of per-file results: macro means, micro rates, validity counts and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstave.functions import scalars
from sparkstave.operators.match import ratio


def summary(results: DataFrame, metrics: list[str], group: str = "group") -> DataFrame:
    """One row per group and one for all: macro means of ``metrics``, micro accuracy and error over measures.

    The overall row is told apart by grouping(), so a group may be called anything.
    """
    wrong = F.sum("measures") - F.sum("correct")
    out = results.rollup(group).agg(
        F.count("*").alias("num_files"), *[F.avg(m).alias(f"avg_{m}") for m in metrics],
        ratio(F.sum("correct"), F.sum("measures")).alias("strict_measure_accuracy"), ratio(wrong, F.sum("measures")).alias("micro_ser"),
        F.grouping(group).alias("is_overall"),
    )
    return out.withColumn(group, F.when(F.col("is_overall") == 1, F.lit("overall")).otherwise(F.col(group)))


def validity(pairs: DataFrame) -> DataFrame:
    """Counts and rates of available, parsed, missing and failed files from (file, available, parsed)."""
    out = pairs.agg(
        F.count("*").alias("expected"), F.count_if("available").alias("available"), F.count_if(F.col("available") & F.col("parsed")).alias("parsed")
    )
    out = out.withColumn("missing", F.col("expected") - F.col("available")).withColumn("failed", F.col("available") - F.col("parsed"))
    return out.withColumn("parse_rate", ratio(F.col("parsed"), F.col("expected")))


def failures(results: DataFrame, group: str = "group") -> DataFrame:
    """Failed files and errors by group, counted; the list itself stays a table."""
    return results.filter("error is not null").groupBy(group, "error").agg(F.count("*").alias("n"))


def composites(metrics: DataFrame) -> DataFrame:
    """Content and notation scores with fixed weights, from the metrics of ``pair_scores``."""
    content = (
        F.lit(0.30) * F.col("pitch_class_f1") + F.lit(0.25) * F.col("rhythm_f1") + F.lit(0.20) * F.col("pitch_class_onset_duration_f1")
        + F.lit(0.15) * F.col("pitch_class_timeline_dtw_similarity") + F.lit(0.10) * F.col("rhythm_timeline_dtw_similarity")
    )
    notation = (
        F.lit(0.35) * F.col("pitch_onset_duration_staff_f1") + F.lit(0.25) * F.col("measure_accuracy") + F.lit(0.15) * F.col("key_event_f1") + F.lit(0.15) * F.col("time_event_f1")
        + F.lit(0.10) * F.greatest(F.lit(0.0), F.lit(1.0) - F.col("xml_normalized_structure_edit_distance") / 10.0)
    )
    return metrics.withColumn("music_content_score", content).withColumn("notation_score", notation)


def variant_map(manifest: DataFrame) -> DataFrame:
    """(key, variant): every filled id and path stem of a manifest line names the line's variant; the last line wins.

    ``manifest`` has line, id, the two paths, and the variant in one of three fields.
    """
    variant = scalars.first_filled(F.col("selected_variant"), F.col("variant"), F.col("noise"))
    keys = F.array(F.col("id"), scalars.stem(F.col("truncated_musicxml_path")), scalars.stem(F.col("truncated_lmx_path")))
    rows = manifest.select("line", variant.alias("variant"), F.explode(keys).alias("key")).filter("variant is not null and key is not null and key <> ''")
    return rows.groupBy("key").agg(F.max_by("variant", "line").alias("variant"))


def with_variants(files: DataFrame, variants: DataFrame, file: str = "file") -> DataFrame:
    """``files`` with the variant of a file's stem, else of its name, else ``unknown``."""
    by = lambda c: variants.select(F.col("key").alias(f"_{c}"), F.col("variant").alias(f"_{c}_variant"))
    joined = files.join(by("stem"), scalars.stem(F.col(file)) == F.col("_stem"), "left").join(by("name"), F.col(file) == F.col("_name"), "left")
    return joined.select(*files.columns, F.coalesce("_stem_variant", "_name_variant", F.lit("unknown")).alias("variant"))


def inflation(encoded: DataFrame, symbols: DataFrame, key: str = "doc_id", group: str = "group") -> DataFrame:
    """Symbols and tokens of the encoded rows by group, and tokens a symbol. ``symbols`` has key, group and n; marks don't count."""
    rows = symbols.join(encoded.select(key, (F.size("ids") - 2).alias("tokens")), key)
    out = rows.groupBy(group).agg(F.count("*").alias("files"), F.sum("n").alias("symbols"), F.sum("tokens").alias("tokens"))
    return out.withColumn("inflation", ratio(F.col("tokens"), F.col("symbols")))
