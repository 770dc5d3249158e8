"""The registered queries in ANSI SQL over the same tables, written independently."""

from __future__ import annotations

_KIND = "original_crime_type_name"
_D = "json_extract_string(props, '$.k')"
_EPOCH = "timestamp '1970-01-01'"

_FIELDS = f"""
    cast(event_id as varchar) as crime_id, event_type as {_KIND},
    cast(date_trunc('day', ts) as timestamp) as report_date,
    cast(date_trunc('day', ts) as timestamp) as call_date,
    cast(date_trunc('day', ts) as timestamp) as offense_date,
    strftime(ts, '%H:%M') as call_time, ts as call_date_time, {_D} as disposition,
    cast(null as varchar) as address, cast(null as varchar) as city,
    cast(null as varchar) as state, cast(null as varchar) as agency_id,
    cast(null as varchar) as address_type, cast(null as varchar) as common_location"""
_NAMES = [
    "crime_id", _KIND, "report_date", "call_date", "offense_date", "call_time",
    "call_date_time", "disposition", "address", "city", "state", "agency_id",
    "address_type", "common_location",
]
_CALLS = f"select {_FIELDS} from events"
_CODES = """select cast(n_nationkey as varchar) as disposition, r_name as disposition_description
    from nation join region on n_regionkey = r_regionkey"""

_BROKEN = "select " + ", ".join(
    f"case when {_KIND} = 'error' then null else {name} end as {name}" for name in _NAMES
) + f" from ({_CALLS})"

_PAIRS = f"select distinct event_type as {_KIND}, {_D} as disposition from events"
_OCCURRENCES = f"""select event_type as {_KIND}, {_D} as disposition, count(*) as count
    from events group by 1, 2"""


def _descriptions(kind: str) -> str:
    return f"""
    with pairs as (select distinct {kind} as {_KIND}, {_D} as disposition from events),
         codes as ({_CODES})
    select {_KIND}, disposition_description, count(*) as count
    from pairs join codes using (disposition) group by 1, 2"""


_JOINED = f"select * from ({_CALLS}) join ({_CODES}) using (disposition)"


def _sliding(time: str, distinct: str, closed: bool = False) -> str:
    """Every call in its two windows of 10 minutes; ``closed`` keeps only the windows
    that end by the final watermark."""
    cut = f"""where window_end <=
        (select date_trunc('milliseconds', max({time})) - interval 60 minute from events)"""
    return f"""
    with calls as (select {distinct} event_type as {_KIND}, {_D} as disposition, {time} as t
                   from events),
         placed as (select time_bucket(interval 5 minute, t, {_EPOCH}) - k * interval 5 minute
                           as window_start, {_KIND}, disposition
                    from calls, range(2) r(k)),
         counted as (select window_start, window_start + interval 10 minute as window_end,
                            {_KIND}, disposition, count(*) as count
                     from placed group by all)
    select * from counted {cut if closed else ''}"""


def _types(closed: bool = False) -> str:
    """Users per window of a day and disposition."""
    cut = """where window_end <=
        (select date_trunc('milliseconds', max(ts)) - interval 60 minute from events)"""
    return f"""
    with placed as (select time_bucket(interval 6 hour, ts, {_EPOCH}) - k * interval 6 hour
                           as window_start, {_D} as disposition, user_id
                    from events, range(4) r(k)),
         counted as (select window_start, window_start + interval 24 hour as window_end,
                            disposition, count(distinct user_id) as types
                     from placed group by all)
    select * from counted {cut if closed else ''}"""


_HOUR = "cast(date_trunc('hour', ts) as timestamp)"


def _batches(length: str = "5 minute") -> str:
    return f"""select time_bucket(interval {length}, ts, {_EPOCH}) + interval {length} as batch_end,
           event_type as {_KIND}, count(*) as count from events group by 1, 2"""


_CLOSED_BATCH = """batch_end <=
    (select date_trunc('milliseconds', max(ts)) - interval 60 minute from events)"""

_BATCH_COUNTS = f"""
    with ends as (select time_bucket(interval 5 minute, ts, {_EPOCH}) + interval 5 minute
                         as batch_end, event_id from events),
         grid as (select unnest(generate_series(
                      (select min(batch_end) from ends), (select max(batch_end) from ends),
                      interval 5 minute)) as batch_end)
    select batch_end, count(event_id) as count,
           'Events in this batch: ' || count(event_id) as line
    from grid left join ends using (batch_end) group by 1"""


def _top(length: str) -> str:
    return f"""select * from (
        select *, cast(row_number() over (
            partition by batch_end order by count desc, {_KIND}) as int) as rank
        from ({_batches(length)})) where rank <= 3"""


def _windowed(where: str = "true") -> str:
    return f"""
    select time_bucket(interval 15 minute, batch_end - interval 1 microsecond, {_EPOCH})
           + interval 15 minute + k * interval 15 minute as window_end,
           batch_end, {_KIND}, count
    from ({_batches()}), range(4) r(k) where {where}"""


_HEAD = f"""select * from (
    select *, cast(row_number() over (
        partition by window_end order by batch_end, count desc, {_KIND}) as int) as position
    from ({_windowed()})) where position <= 10"""

# Events of one type come as they are, those of another with a number for an id.
_DRIFT = """
    with found(field, type) as (values ('event_id', 'BIGINT'), ('ts', 'STRING'),
             ('user_id', 'BIGINT'), ('event_type', 'STRING'), ('props', 'STRING'))
    select field, 'undeclared' as drift, type, count(*) as messages
    from found, events where event_type = 'error' group by all
    union all
    select 'crime_id', 'type', 'VARIANT', count(*) from events where event_type <> 'error'"""

ORACLES: dict[str, str] = {
    "parse_calls": _CALLS,
    "parse_malformed": _BROKEN,
    "kept_messages_stream": f"""
        select case when event_type = 'error' then 'broken' else 'parsed' end as side,
               event_type as {_KIND}, event_type <> 'error' as timed, count(*) as count
        from events group by all""",
    "observed_messages_stream": """
        select count(*) as events, count(*) filter (where event_type = 'error') as broken,
               0::bigint as without_time, true as several from events""",
    "published_messages": f"select *, cast(14 as bigint) as n_fields from ({_CALLS})",
    "published_records": _CALLS,
    "published_resumed": _CALLS,
    "schema_drift_untyped": _DRIFT,
    "schema_drift_batches": _DRIFT,
    "tail_messages": f"""select event_id as "offset", event_type as {_KIND},
        {_D} as disposition, strftime(ts, '%H:%M') as call_time from events""",
    "code_table": _CODES,
    "code_table_array": _CODES,
    "distinct_pairs": _PAIRS,
    "distinct_pairs_stream": _PAIRS,
    "distinct_pairs_batches": _PAIRS,
    "distinct_pairs_within_stream": f"select *, true as apart from ({_PAIRS})",
    "pair_counts_distinct": f"select *, cast(1 as bigint) as count from ({_PAIRS})",
    "pair_counts_distinct_stream": f"select *, cast(1 as bigint) as count from ({_PAIRS})",
    "pair_counts_occurrences": _OCCURRENCES,
    "pair_counts_occurrences_stream": _OCCURRENCES,
    "pair_counts_moved_distinct": f"select *, cast(1 as bigint) as count from ({_PAIRS})",
    "pair_counts_moved_occurrences": _OCCURRENCES,
    "state_table": f"select *, 'stateStoreSave' as operator, true as inside from ({_OCCURRENCES})",
    "description_counts": _descriptions("event_type"),
    "description_counts_messages": _descriptions("event_type"),
    "description_counts_topic": _descriptions("event_type"),
    "description_counts_resumed": _descriptions("event_type"),
    "description_counts_table": _descriptions("event_type"),
    "call_statistics": f"""
        select 'pair_counts' as result, {_KIND}, disposition as value, cast(1 as bigint) as count
        from ({_PAIRS}) union all
        select 'description_counts', {_KIND}, disposition_description, count
        from ({_descriptions("event_type")})""",
    "query_progress": "select count(*) as input_rows, true as several from events",
    "description_counts_by_user": _descriptions("cast(user_id as varchar)"),
    "description_counts_by_user_stream": _descriptions("cast(user_id as varchar)"),
    "description_counts_by_user_large_table": _descriptions("cast(user_id as varchar)"),
    "description_counts_by_user_large_table_stream": _descriptions("cast(user_id as varchar)"),
    "calls_with_description": _JOINED,
    "calls_with_description_stream": _JOINED,
    "calls_with_description_large_table": _JOINED,
    "sliding_counts": _sliding("ts", "distinct"),
    "sliding_counts_occurrences": _sliding(_HOUR, ""),
    "sliding_counts_hourly": _sliding(_HOUR, "distinct"),
    "sliding_counts_complete": _sliding(_HOUR, "distinct"),
    "sliding_counts_append": _sliding("ts", "distinct", closed=True),
    "sliding_counts_append_batches": _sliding("ts", "distinct", closed=True),
    "sliding_counts_panes_batches": _sliding("ts", "distinct", closed=True),
    "sliding_counts_panes_hourly": _sliding(_HOUR, "distinct", closed=True),
    "sliding_type_estimates": _types(),
    "sliding_type_estimates_stream": _types(closed=True),
    "sliding_counts_append_hourly": _sliding(_HOUR, "distinct", closed=True),
    "sliding_counts_append_occurrences": _sliding(_HOUR, "", closed=True),
    "sliding_counts_update_hourly": _sliding(_HOUR, "distinct"),
    "batch_counts": _BATCH_COUNTS,
    "batch_type_counts": _batches(),
    "batch_type_counts_stream": _batches(),
    "batch_type_counts_closed_stream": f"select * from ({_batches()}) where {_CLOSED_BATCH}",
    "batch_top_types": _top("5 minute"),
    "batch_top_types_hourly": _top("1 hour"),
    "windowed_batch_counts": _windowed(),
    "windowed_batch_counts_stream": _windowed(),
    "windowed_batch_counts_closed_stream": _windowed(_CLOSED_BATCH),
    "windowed_batch_head": _HEAD,
    "live_batches": "select count(*) as calls, true as as_in_files from events",
    "live_batch_totals": f"select event_type as {_KIND}, count(*) as count from events group by 1",
}
