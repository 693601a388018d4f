"""Queries over validity and holding intervals (problems 2 and 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions.timeparts import clean_key, date_micros, micros
from chronoloom.operators.known_at import attributes_as_of
from chronoloom.operators.periods import periods_and_gaps
from chronoloom.queries import register
from chronoloom.sources.tables import table


def _signals_with_facts(spark, folder, how, payload):
    facts = table(spark, folder, "full_db").where("ret_90d is not null")
    return attributes_as_of(
        table(spark, folder, "signals"),
        facts,
        event_key=clean_key(F.col("ticker")),
        event_time=F.col("signal_ts"),
        fact_key=clean_key(F.col("ticker")),
        fact_effective=F.greatest(micros(F.col("known_at")), date_micros(F.col("date"))),
        precedence=[F.col("date"), F.col("known_at"), F.col("row_id")],
        payload=payload,
        how=how,
    )


_P2 = """
with m as (
  select s.signal_id, f.row_id, f.date as fdate, f.ret_90d, row_number() over (partition by s.signal_id order by f.date desc, f.known_at desc, f.row_id desc) as k
  from signals s join full_db f on upper(trim(s.ticker)) = upper(trim(f.ticker))
   and f.known_at <= s.signal_ts and f.date <= cast(s.signal_ts as date) and f.ret_90d is not null)
"""


@register("p2_found", _P2 + "select signal_id, row_id from m where k = 1")
def p2_found(spark, folder):
    return _signals_with_facts(spark, folder, "inner", {"row_id": F.col("row_id")}).select("signal_id", "row_id")


@register(
    "p2_signal_attributes",
    _P2 + """select s.signal_id, s.ticker, cast(s.signal_ts as varchar) as signal_ts, cast(m.fdate as varchar) as known_date, m.ret_90d as known_ret_90d
from signals s left join (select * from m where k = 1) m on m.signal_id = s.signal_id""",
)
def p2_signal_attributes(spark, folder):
    out = _signals_with_facts(spark, folder, "left", {"known_date": F.col("date"), "known_ret_90d": F.col("ret_90d")})
    return out.select(
        "signal_id", "ticker", F.col("signal_ts").cast("string").alias("signal_ts"),
        F.col("known_date").cast("string").alias("known_date"), "known_ret_90d",
    )


@register(
    "p3_found",
    """
with t as (select distinct upper(trim(ticker)) as ticker, entry_date as s, exit_date as e from trades
           where ticker is not null and entry_date is not null and exit_date is not null and exit_date >= entry_date),
m as (select *, max(e) over (partition by ticker order by s, e rows between unbounded preceding and 1 preceding) as before from t),
g as (select *, sum(case when before is null or s > before + 1 then 1 else 0 end) over (partition by ticker order by s, e) as run from m),
p as (select ticker, run, min(s) as a, max(e) as b from g group by ticker, run),
n as (select *, lead(a) over (partition by ticker order by a) as nxt from p)
select ticker, 'period' as kind, cast(a as varchar) as start_date, cast(b as varchar) as end_date from n
union all
select ticker, 'gap', cast(b + 1 as varchar), cast(nxt - 1 as varchar) from n where nxt is not null
""",
)
def p3_found(spark, folder):
    out = periods_and_gaps(table(spark, folder, "trades"), clean_key(F.col("ticker")), F.col("entry_date"), F.col("exit_date"))
    return out.select(
        F.col("key").alias("ticker"), "kind",
        F.date_format("start_date", "yyyy-MM-dd").alias("start_date"), F.date_format("end_date", "yyyy-MM-dd").alias("end_date"),
    )
