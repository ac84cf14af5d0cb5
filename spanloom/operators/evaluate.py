"""Evaluation against labelled spans: alignment, confusion, sweeps, calibration, oracle ceiling.

Records have sim (best similarity), source (the best candidate's uri), expected (a uri or
UNGROUNDED) and, for the oracle, expected_rank (null if the uri is not among the candidates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.numeric import f1, ratio
from spanloom.functions.text import padded
from spanloom.operators.patterns import first_texts
from spanloom.schema import FLOOR, HIGH, LOW, ORACLE_K

UNGROUNDED = "UNGROUNDED"


def threshold_grid(start: float = 0.2, end: float = 0.45, step: float = 0.01) -> list[float]:
    """Thresholds by repeated addition, drift and all: comparisons use these very numbers."""
    out, t = [], start
    while t <= end:
        out.append(t)
        t += step
    return out


def align(labels: DataFrame, spans: DataFrame, path: str = "path") -> DataFrame:
    """Each label (path, find, expected) with the first span whose text contains ``find``; sim 0 if none does.

    All labels of a file are looked for in one reading of each span. ``start_line`` names a file's span.
    """
    firsts = first_texts(labels, spans, [path], "find", "text", "start_line")
    rest = [c for c in spans.columns if c not in (path, "start_line", "expected")]
    named = spans.groupBy(path, "start_line").agg(F.min_by(F.struct(*rest), F.col("text")).alias("_s")).select(path, "start_line", "_s.*")
    joined = labels.join(firsts.join(named, [path, "start_line"]), [path, "find"], "left")
    return joined.withColumn("sim", F.coalesce("sim", F.lit(0.0)))


def confusion(records: DataFrame, predicted: Column, correct: Column, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn, correct and the rates of each group."""
    truth = F.col("expected") != UNGROUNDED
    cell = lambda p, t: F.count_if((predicted if p else ~predicted) & (truth if t else ~truth))
    sums = records.groupBy(*by).agg(
        cell(True, True).alias("tp"), cell(True, False).alias("fp"), cell(False, True).alias("fn"), cell(False, False).alias("tn"),
        F.count_if(predicted & truth & correct).alias("correct"),
    )
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(
        *by, "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"),
        ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_attribution"), ratio(F.col("correct"), F.col("tp")).alias("source_accuracy"),
    )


def sweep(records: DataFrame, thresholds: list[float], by: list[str]) -> DataFrame:
    """Confusion at each threshold; records are read once, each is copied for the few thresholds."""
    points = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    return confusion(records.select("*", points), F.col("sim") >= F.col("threshold"), F.col("source") == F.col("expected"), [*by, "threshold"])


def calibrate_low(records: DataFrame, by: list[str], fallback: float = LOW) -> DataFrame:
    """The threshold of the grid with the best F1 among those without false attribution; the highest of ties.

    Where the grid has none the fallback stands.
    """
    swept = sweep(records, threshold_grid(), by)
    usable = F.when(F.col("false_attribution") == 0, F.struct("f1", "threshold"))
    best = swept.groupBy(*by).agg(F.max(usable).alias("_b"))
    return best.select(*by, F.coalesce(F.round("_b.threshold", 2), F.lit(fallback)).alias("low"), F.coalesce("_b.f1", F.lit(0.0)).alias("f1"))


def expected_rank(ranked: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """key, expected, rank and sim of the expected uri among the candidates; null where it is not one."""
    own = ranked.withColumnRenamed("uri", "expected").select(*key, "expected", F.col("rank").alias("expected_rank"), F.col("sim").alias("expected_sim"))
    return truth.join(own, [*key, "expected"], "left")


def oracle(records: DataFrame, by: list[str], high: float = HIGH, floor: float = FLOOR, k: int = ORACLE_K) -> DataFrame:
    """Confusion of a perfect judge over [floor, high): it grounds what is grounded if the source is in its list."""
    listed = (F.col("expected_rank") <= k) & (F.col("expected_sim") >= floor)
    judged = (F.col("sim") >= floor) & (F.col("sim") < high) & (F.col("expected") != UNGROUNDED) & F.coalesce(listed, F.lit(False))
    right = F.when(F.col("sim") >= high, F.col("source") == F.col("expected")).otherwise(judged)
    return confusion(records, (F.col("sim") >= high) | judged, right, by)


def scored_by_judges(records: DataFrame, judges: dict[str, Column], by: list[str], high: float = HIGH, floor: float = FLOOR) -> DataFrame:
    """Confusion for each judge model: its expression rules in [floor, high)."""
    rows = records.select("*", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), c.alias("derived")) for m, c in judges.items()])).alias("_j"))
    predicted = (F.col("sim") >= high) | ((F.col("sim") >= floor) & F.col("_j.derived"))
    return confusion(rows.withColumn("model", F.col("_j.model")), predicted, F.col("source") == F.col("expected"), [*by, "model"])


def with_truth(spans: DataFrame, truth: DataFrame, name: str = "name", default: str = "?") -> DataFrame:
    """Adds ``expected`` by a map of names (name, expected); the default where it has none."""
    return spans.join(truth.select(name, "expected"), name, "left").withColumn("expected", F.coalesce("expected", F.lit(default)))


def live(test: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """The test's records with live_status and live_source of a judge's results; ungrounded where it has none.

    ``results`` (key, status, source) may hold more than the test: only those the test asks for are read.
    """
    asked = results.join(test.select(*key).distinct(), key, "left_semi")
    first = asked.groupBy(*key).agg(F.min_by(F.struct("status", "source"), F.struct("status", "source")).alias("_v"))
    found = test.join(first, key, "left")
    return found.withColumns({"live_status": F.coalesce("_v.status", F.lit("ungrounded")), "live_source": F.col("_v.source")}).drop("_v")


def live_lines(records: DataFrame, find: str) -> DataFrame:
    """Adds the report's line of each live record: what was looked for, its status, and whether that is right."""
    grounded, truth = F.col("live_status") == "grounded", F.col("expected") != UNGROUNDED
    right = F.when(F.col("live_source") == F.col("expected"), "right").otherwise("wrong source")
    mark = F.when(truth, F.when(grounded, right).otherwise("missed")).otherwise(F.when(grounded, "false attribution").otherwise("right"))
    return records.withColumn("line", F.concat_ws(" ", padded(F.col(find), 20), padded(F.col("live_status"), 11), mark))


def languages(labels: DataFrame, path: str = "path") -> DataFrame:
    """The number of distinct file extensions."""
    from spanloom.functions.text import extension

    return labels.agg(F.countDistinct(extension(F.col(path))).alias("languages"))


def retrieval_metrics(records: DataFrame, by: list[str], threshold: float = 0.35) -> DataFrame:
    """Share of grounded labels whose best source is right, and of labels that the threshold decides rightly."""
    truth = F.col("expected") != UNGROUNDED
    hit = F.when(truth, (F.col("source") == F.col("expected")).cast("int"))
    right = ((F.col("sim") >= threshold) == truth).cast("int")
    return records.groupBy(*by).agg(F.avg(hit).alias("top1"), F.avg(right).alias("decided"))
