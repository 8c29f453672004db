"""The batch form of the backlog."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyplab.plans import views as V
from hyplab.plans.registry import query
from hyplab.streaming import backlog as B


def _run(spark, d):
    w = V.wide(spark, d)
    done = w.where("conf_drop7 > -0.04").select("id", F.col("drop7").alias("text"))
    return w, done, lambda rows: rows.select("id", F.col("swap11").alias("text"))


@query("t01_backlog", "SELECT id, n FROM wide WHERE NOT conf_drop7 > -0.04::DOUBLE")
def t01_backlog(spark, d):
    w, done, _ = _run(spark, d)
    return B.backlog(w, done, "id").select("id", "n")


@query("t01_resume", """
SELECT id, id AS pos, CASE WHEN t = '' THEN '.' ELSE t END AS text FROM (
  SELECT id, trim(CASE WHEN conf_drop7 > -0.04::DOUBLE THEN drop7 ELSE swap11 END) AS t FROM wide)""")
def t01_resume(spark, d):
    w, done, process = _run(spark, d)
    template = V.utterances(spark, d).select("id", F.col("id").alias("pos"))
    return B.ordered_result(template, B.resume(w, done, "id", process), "id", "pos", "text")
