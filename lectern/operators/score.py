"""Extracted rows against hand-coded ones, aligned by (doi, sample_id).

The gold rows define which articles are scored; an article without a finished
result is a total miss. Of repeated sample ids the later row counts. Numbers
are compared only where both sides report them. A null flag equals a null flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonmaps import lenient_number, maps_agree, strict_int, strict_map
from .sampling import first_n

FLAGS = ["gender_reported", "race_reported", "education_reported", "ses_reported"]
CATEGORIES = {"gender": ("gender_reported", "gender_pct"), "race": ("race_reported", "race_pct"), "education": ("education_reported", "education_pct")}


def typed_gold(text: DataFrame) -> DataFrame:
    """Gold rows from text columns: rows without a doi are dropped, a missing or 0
    sample id is 1, malformed percentages and flags end the job."""
    sid = F.coalesce(F.nullif(strict_int(F.col("sample_id")), F.lit(0)), F.lit(1))
    return text.where(F.coalesce("doi", F.lit("")) != "").select(
        "doi", sid.alias("sample_id"), *[strict_int(F.col(c)).alias(c) for c in FLAGS],
        *[strict_map(F.col(p)).alias(p) for _, p in CATEGORIES.values()], F.nullif("ses_value", F.lit("")).alias("ses_value"),
    )


def latest(rows: DataFrame, order: str) -> DataFrame:
    """(doi, sample_id, row): of repeated sample ids the row of highest order."""
    rest = [c for c in rows.columns if c not in ("doi", "sample_id", order)]
    return rows.groupBy("doi", "sample_id").agg(F.max_by(F.struct(*rest), order).alias("row"))


def align(gold: DataFrame, model: DataFrame, order: str = "pos") -> DataFrame:
    """(doi, sample_id, g, m): each sample of either side with both sides' rows,
    null where a side has none. Both sides: doi, sample_id, flags, percentages,
    ses_value and a column that orders repeats."""
    g = latest(gold, order).withColumnRenamed("row", "g")
    m = latest(model, order).withColumnRenamed("row", "m")
    return g.join(m, ["doi", "sample_id"], "full_outer")


def compare(both: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """A row per aligned sample: in_gold, in_model, flags and numbers compared and equal, notes."""
    ok = F.col("g").isNotNull() & F.col("m").isNotNull()
    num = lambda x: F.coalesce(lenient_number(x), F.lit(0.0))
    flag = {c: F.col(f"g.{c}").eqNullSafe(F.col(f"m.{c}")) for c in FLAGS}
    gates: list[tuple[str, Column, Column]] = [
        (p, F.coalesce((F.col(f"g.{f}") == 1) & (F.col(f"m.{f}") == 1), F.lit(False)), maps_agree(F.col(f"g.{p}"), F.col(f"m.{p}"), tolerance)) for f, p in CATEGORIES.values()
    ]
    ses = F.coalesce((F.col("g.ses_reported") == 2) & (F.col("m.ses_reported") == 2), F.lit(False))
    gates.append(("ses_value", ses, F.abs(num(F.col("g.ses_value")) - num(F.col("m.ses_value"))) <= tolerance))
    count = lambda conditions: sum((F.when(ok & c, 1).otherwise(0) for c in conditions), F.lit(0))
    said = lambda c: F.concat(F.lit("s"), F.col("sample_id").cast("string"), F.lit(f" {c}: gold="), F.coalesce(F.col(f"g.{c}").cast("string"), F.lit("none")), F.lit(" model="), F.coalesce(F.col(f"m.{c}").cast("string"), F.lit("none")))
    notes = [F.when(ok & ~eq, said(c)) for c, eq in flag.items()] + [F.when(ok & gate & ~same, said(c)) for c, gate, same in gates[:-1]]
    return both.select(
        "doi", "sample_id", F.col("g").isNotNull().alias("in_gold"), F.col("m").isNotNull().alias("in_model"),
        F.when(ok, len(FLAGS)).otherwise(0).alias("flag_total"), count(flag.values()).alias("flag_correct"),
        count([g for _, g, _ in gates]).alias("num_total"), count([g & s for _, g, s in gates]).alias("num_correct"),
        F.filter(F.array(*notes), lambda x: x.isNotNull()).alias("notes"),
    )


def _finished(both: DataFrame, results: DataFrame) -> DataFrame:
    """both with status and full_keys of its article's run; rows of a run that isn't ok don't count."""
    done = results.select("doi", "status", "full_keys").dropDuplicates(["doi"])
    return both.join(done, "doi", "left").withColumn("m", F.when(F.col("status") == "ok", F.col("m")))


def sample_notes(both: DataFrame, results: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(doi, sample_id, note): what differs, sample by sample."""
    return compare(_finished(both, results), tolerance).select("doi", "sample_id", F.explode("notes").alias("note"))


#: Samples of one article whose notes are shown in its row; sample_notes has them all.
NOTES_SHOWN = 200


def score_articles(both: DataFrame, results: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Scores per gold article of aligned samples; results: doi, status,
    full_keys of each run article. A row shows the notes of its first
    NOTES_SHOWN samples that have any, and says how many more there are."""
    rows = compare(_finished(both, results), tolerance)
    samples = rows.groupBy("doi").agg(
        F.count_if("in_gold").alias("n_gold_samples"), F.count_if("in_model").alias("n_model_samples"), F.bool_and(F.col("in_gold") == F.col("in_model")).alias("same_ids"),
        *[F.sum(c).alias(c) for c in ("flag_total", "flag_correct", "num_total", "num_correct")], F.count_if(F.size("notes") > 0).alias("n_noted"),
    ).where("n_gold_samples > 0")
    noted = first_n(rows.where(F.size("notes") > 0).select("doi", "sample_id", "notes"), ["doi"], ["sample_id"], NOTES_SHOWN)
    shown = noted.groupBy("doi").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sample_id", "notes"))), lambda x: x["notes"])), "; ").alias("shown"))
    done = results.select("doi", "status", "full_keys").dropDuplicates(["doi"])
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    rate = lambda a, b: F.when(ok, F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0))))
    notes = F.when(F.col("status").isNull(), "no model output").when(~ok, F.concat(F.lit("model status="), "status"))
    ids = F.when(~F.col("same_ids"), "sample ids differ")
    keys = F.when(~F.coalesce("full_keys", F.lit(False)), "model row missing required keys")
    more = F.when(F.col("n_noted") > NOTES_SHOWN, F.concat(F.lit("and "), (F.col("n_noted") - NOTES_SHOWN).cast("string"), F.lit(" more samples with notes")))
    return samples.join(done, "doi", "left").join(shown, "doi", "left").select(
        "doi", "n_gold_samples", F.when(ok, F.col("n_model_samples")).otherwise(0).alias("n_model_samples"),
        F.when(ok, rate("flag_correct", "flag_total")).otherwise(0.0).alias("reporting_flag_accuracy"), rate("num_correct", "num_total").alias("numeric_accuracy"),
        (ok & F.col("same_ids")).alias("sample_count_match"), (ok & F.coalesce("full_keys", F.lit(False))).alias("schema_ok"),
        F.coalesce(notes, F.array_join(F.filter(F.array(keys, ids, F.col("shown"), more), lambda x: x.isNotNull()), "; ")).alias("notes"),
        *[F.when(ok, F.col(c)).otherwise(0).alias(c) for c in ("flag_total", "flag_correct", "num_total", "num_correct")],
    )


def per_article(gold: DataFrame, model: DataFrame, results: DataFrame, tolerance: float = 1.0, order: str = "pos") -> DataFrame:
    """Scores per gold article of gold and model rows that may repeat samples."""
    return score_articles(align(gold, model, order), results, tolerance)


def summary(scores: DataFrame) -> DataFrame:
    """One row: accuracies over what was compared, the other rates over all gold articles; null where nothing counts."""
    rate = lambda a, b: F.try_divide(F.sum(a), F.nullif(F.sum(b), F.lit(0)))
    return scores.agg(
        F.count(F.lit(1)).alias("n_articles"), rate("flag_correct", "flag_total").alias("reporting_flag_accuracy"), rate("num_correct", "num_total").alias("numeric_accuracy"),
        F.try_divide(F.count_if("sample_count_match"), F.count(F.lit(1))).alias("sample_count_match_rate"), F.try_divide(F.count_if("schema_ok"), F.count(F.lit(1))).alias("schema_ok_rate"),
    )
