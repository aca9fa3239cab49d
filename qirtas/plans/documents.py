"""Translating office files: segments, protection, injected translation, restoration, patched copies and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qirtas.functions.protect import protect, restore
from qirtas.functions.text import detect_direction
from qirtas.operators.operations import report
from qirtas.plans.lineage import written
from qirtas.plans.pipeline import Model, _call
from qirtas.sources import office

#: Characters above which a segment is left as it is.
MOST_CHARS = 5000


def translate_files(files: DataFrame, translator: Model, direction: str = "auto", most_chars: int = MOST_CHARS) -> tuple[DataFrame, DataFrame]:
    """``(patched, report)`` of files read as binary (``path, content``).

    Each distinct segment of a file is translated once. With 'auto' its script
    decides the direction. Oversized segments are skipped, and those whose
    translation comes back null or blank have failed: both keep their text. The
    translator sees ``direction`` and text parted by a line break, tokens protected.
    """
    distinct = office.segments(files).groupBy("path", "text").agg(F.count(F.lit(1)).alias("n_places"))
    way = detect_direction(F.col("text")) if direction == "auto" else F.lit(direction)
    asked = distinct.withColumn("fits", F.length("text") <= most_chars).withColumn("direction", way).withColumn("p", protect("text"))
    reply = F.when(F.col("fits"), _call(translator)(F.concat_ws("\n", "direction", "p.masked")))
    # Written once, so that no segment is translated twice.
    done = written(asked.withColumn("translation", F.trim(restore(reply, F.col("p.tokens")))).drop("p"), "segments")
    outcome = F.when(~F.col("fits"), "skipped").when(F.coalesce(F.col("translation"), F.lit("")) == "", "failed").otherwise("translated")
    judged = done.withColumn("outcome", outcome)
    return office.patched(files, judged.where("outcome = 'translated'").select("path", "text", "translation")), report(judged, "path")
