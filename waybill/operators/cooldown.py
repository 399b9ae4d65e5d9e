"""Alerts with a cool-down: a rule stays silent until its cool-down after its last fire is over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.operators.ordered import ordered_by_key
from waybill.operators.skew import skew_join
from waybill.session import checkpointed


def _micros(ts):
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def cooldown_fires(alerts: DataFrame, rule: str, ts: str, ident: str, seconds: int) -> DataFrame:
    """The alerts that fire: the first of each rule, then always the first at least ``seconds`` after the last fire.

    Which alert fires next depends on the one before, so the fires of a rule form a chain:
    alert -> first alert at least ``seconds`` later. The chain is followed for all rules at once
    by pointer doubling, log2(fires) rounds of balanced joins, so neither a busy rule nor a long
    history is walked in one task. Alerts of a rule at the same time count once (least id).
    """
    once = alerts.groupBy(rule, ts).agg(F.min(ident).alias(ident)).select(rule, ts, ident, _micros(F.col(ts)).alias("__at"))
    once = checkpointed(once)
    wait = seconds * 1_000_000
    # a probe stands at the end of each alert's cool-down; the alerts before it give the next fire's number
    stream = once.select(rule, ident, "__at", F.lit(1).cast("long").alias("__alert")).unionByName(
        once.select(rule, ident, (F.col("__at") + wait).alias("__at"), F.lit(0).cast("long").alias("__alert"))
    )
    tied = stream.withColumn("__tie", F.expr(f"CAST(__alert AS DECIMAL(1,0)) * 100000000000000000000BD + CAST({ident} AS DECIMAL(20,0))"))
    counted = checkpointed(ordered_by_key(tied, [rule], ["__at", "__tie"], running={"__n": "__alert"}).select(rule, ident, "__alert", "__n"))
    node = F.struct(F.col(rule).alias("r"), F.col(ident).alias("i"))  # one event may raise alerts of several rules
    numbered = counted.where("__alert = 1").select(F.struct(F.col(rule).alias("r"), F.col("__n").alias("n")).alias("__spot"), node.alias("next_id"))
    steps = counted.where("__alert = 0").select(F.struct(F.col(rule).alias("r"), (F.col("__n") + 1).alias("n")).alias("__spot"), node.alias("id"))
    jumps = checkpointed(skew_join(steps, numbered, "__spot").select("id", F.col("next_id").alias("jump")))
    fired = checkpointed(counted.where("__alert = 1 AND __n = 1").select(node.alias("id")))
    known = fired.count()
    while True:
        reached = fired.join(jumps, "id").select(F.col("jump").alias("id"))
        fired = checkpointed(fired.unionByName(reached).distinct())
        now = fired.count()
        if now == known:
            break
        known = now
        ahead = jumps.select(F.col("id").alias("jump"), F.col("jump").alias("j2"))
        jumps = checkpointed(skew_join(jumps, ahead, "jump").select("id", F.col("j2").alias("jump")))
    return once.join(fired.select("id.*").toDF(rule, ident), [rule, ident], "left_semi").select(rule, ts, ident)
