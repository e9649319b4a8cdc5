"""SQL building blocks for the oracle side (DuckDB over the same parquet tables)."""

READINGS = """
readings as (
  select concat('C', lpad(cast(user_id as varchar),6,'0')) as component_id,
    concat('B', lpad(cast(user_id % 10 as varchar),2,'0')) as batch_id,
    'EVT' as component_family, event_type as measurement_name,
    cast(24 * floor(date_diff('day', timestamp '2024-01-01 00:00:00', ts) / 4) as double) as hours,
    avg(value) as measurement_value, cast(120.0 as double) as upper_limit,
    concat('P', cast((user_id % 10) % 2 as varchar)) as profile_id,
    cast(floor(user_id / 10) % 2 as int) as tester_channel,
    cast(120 + 0.5 * (user_id % 10) as double) as temperature_c
  from events
  group by user_id, event_type, cast(24 * floor(date_diff('day', timestamp '2024-01-01 00:00:00', ts) / 4) as double)
)"""

LABELS = """
labels_t as (
  select r.component_id, r.batch_id, r.component_family, r.measurement_name, r.profile_id,
    max(case when r.hours = 168 then r.measurement_value end) as final_value,
    min(case when r.measurement_value >= r.upper_limit then r.hours end) as first_exceedance_hour,
    max(r.upper_limit) as upper_limit,
    bool_or(k % 5 = 0) as is_defect, bool_or(k % 7 = 3) as is_tester_fault,
    bool_and(k % 5 <> 0 and k % 7 <> 3) as is_healthy,
    max(case when k % 5 = 0 then cast(24 * (k % 4) as double) end) as anomaly_onset_hour,
    max(case when k % 7 = 3 then 'tester_fault' when k % 5 <> 0 then 'healthy'
             when k % 2 = 0 then 'gradual_drift' else 'sudden_step' end) as scenario
  from (select *, cast(floor(cast(substr(component_id, 2) as int) / 10) as int) as k from readings) r
  group by r.component_id, r.batch_id, r.component_family, r.measurement_name, r.profile_id
)"""

KEY = "component_id, batch_id, component_family, measurement_name"
PEER = "as_of_hour, batch_id, component_family, measurement_name"


def features(hours=(24.0,), source="readings"):
    values = ", ".join(f"({float(h)})" for h in hours)
    return f"""
early0 as (
  select r.*, h.as_of_hour from {source} r
  join (select cast(x as double) as as_of_hour from (values {values}) v(x)) h on r.hours <= h.as_of_hour
),
feat0 as (
  select as_of_hour, {KEY},
    max(hours) as last_observed_hour, count(*) as n_observations,
    arg_min(measurement_value, hours) as initial_value, arg_max(measurement_value, hours) as current_value,
    coalesce(regr_slope(measurement_value, hours), 0) as slope,
    stddev_pop(measurement_value) as variability, arg_max(upper_limit, hours) as upper_limit,
    arg_max(temperature_c, hours) as temperature_c, max(profile_id) as profile_id,
    max(tester_channel) as tester_channel,
    list(measurement_value order by hours) as vs, list(hours order by hours) as hs
  from early0 group by as_of_hour, {KEY} having count(*) >= 2
),
feat as (
  select *, current_value - initial_value as delta,
    (current_value - initial_value) / greatest(abs(initial_value), 1e-9) as percent_change,
    case when len(hs) >= 3 then
      ((vs[-1] - vs[-2]) / (hs[-1] - hs[-2]) - (vs[2] - vs[1]) / (hs[2] - hs[1])) / (hs[-1] - hs[1]) else 0 end as acceleration,
    (current_value - initial_value) / upper_limit as delta_fraction_of_limit,
    slope / upper_limit as slope_fraction_per_hour,
    variability / upper_limit as variability_fraction_of_limit,
    current_value / upper_limit as limit_fraction,
    initial_value / upper_limit as initial_fraction_of_limit,
    upper_limit - current_value as distance_to_upper_limit,
    (upper_limit - current_value) / upper_limit as distance_fraction_to_upper_limit
  from feat0
)"""


Z = f"""
z1 as (
  select *, median(current_value) over w as cm, median(slope) over w as sm,
    coalesce(stddev_samp(current_value) over w, 0) as cs, coalesce(stddev_samp(slope) over w, 0) as ss,
    count(*) over w as peer_count
  from feat window w as (partition by {PEER})
),
z2 as (
  select *, median(abs(current_value - cm)) over w as cd, median(abs(slope - sm)) over w as sd
  from z1 window w as (partition by {PEER})
),
z as (
  select *,
    0.6745 * (current_value - cm) / greatest(cd, abs(cm) * 0.01, cs * 0.1, 1e-9) as current_batch_robust_z,
    0.6745 * (slope - sm) / greatest(sd, abs(sm) * 0.01, ss * 0.1, 1e-9) as slope_batch_robust_z,
    (current_value - cm) / (case when 1.4826 * cd > 0 then 1.4826 * cd else greatest(abs(cm) * 1e-3, 1e-12) end) as current_mad_z,
    (slope - sm) / (case when 1.4826 * sd > 0 then 1.4826 * sd else greatest(abs(sm) * 1e-3, 1e-12) end) as slope_mad_z
  from z2
)"""

SCORED = """
s0 as (select *, greatest(abs(current_batch_robust_z), abs(slope_batch_robust_z)) as robust_deviation_score,
         greatest(abs(current_mad_z), abs(slope_mad_z)) as strict_deviation from z),
scored as (
  select *, 1 / (1 + exp(-(robust_deviation_score - 3.5))) as anomaly_score, robust_deviation_score >= 3.5 as is_anomaly,
    list_filter([
      case when current_batch_robust_z >= 3.5 then 'Current value is unusually above the batch norm'
           when current_batch_robust_z <= -3.5 then 'Current value is unusually below the batch norm' end,
      case when slope_batch_robust_z >= 3.5 then 'Drift is unusually faster than comparable components'
           when slope_batch_robust_z <= -3.5 then 'Drift is unusually slower than comparable components' end,
      case when limit_fraction >= 0.8 then 'Current value has used at least 80% of the safety limit' end,
      case when acceleration > 0 then 'The rate of change is accelerating' end
    ], lambda x: x is not null) as reason_codes
  from s0
)"""

# Persistence forecast, radius 0.25 of the limit.
RECORDS = """
p0 as (select *, greatest(limit_fraction, 0) as forecast, limit_fraction - 0.25 as lo0 from scored),
p1 as (select *, forecast * upper_limit as predicted_final_value, greatest(forecast - 0.25, 0) * upper_limit as prediction_lower,
         (forecast + 0.25) * upper_limit as prediction_upper, upper_limit as applicable_limit,
         upper_limit - current_value as headroom, (upper_limit - current_value) / abs(upper_limit) as headroom_fraction,
         forecast * upper_limit > upper_limit as predicted_to_cross_limit from p0),
records as (
  select *,
    case when current_value >= upper_limit then 'ENGINEER_REVIEW'
         when is_anomaly and (predicted_final_value >= upper_limit or prediction_lower >= upper_limit) then 'ENGINEER_REVIEW'
         when anomaly_score >= 0.8 or predicted_final_value >= upper_limit then 'RETEST'
         when is_anomaly or prediction_upper >= upper_limit then 'MONITOR'
         else 'ACCEPT' end as recommendation,
    array_to_string(list_concat(reason_codes, list_filter([
      case when current_value >= upper_limit then 'The current measurement has crossed the approved limit' end,
      case when current_value < upper_limit and predicted_final_value >= upper_limit then 'The predicted final value crosses the approved limit' end,
      case when current_value < upper_limit and prediction_upper >= upper_limit then 'The prediction range includes a possible limit crossing' end
    ], lambda x: x is not null)), '; ') as reasons
  from p1
)"""

UNSCORED = f"""
uns as (
  select {KEY} from readings group by {KEY}
  having count(case when hours = 0 then 1 end) <> 1 or count(case when hours = 24 then 1 end) <> 1
)"""


def query(*parts, select):
    return "with " + ",".join(p.strip() for p in parts) + "\n" + select


def r6(*names):
    """Rounded columns, minus zero turned into zero."""
    return ", ".join(f"round({n.split(' as ')[0]}, 6) + 0.0 as {n.split(' as ')[-1]}" for n in names)


def review(methods, keys="as_of_hour"):
    """Metrics per method over the joined table ``m`` with flags ``f_<method>``."""
    one = []
    for m in methods:
        on = f"f_{m}"
        one.append(f"""
select {keys}, '{m}' as method, count(*) as evaluated_components, count(*) filter ({on}) as flagged_components,
  count(*) filter ({on} and truth) as true_positive, count(*) filter ({on} and not truth) as false_positive,
  count(*) filter (not {on} and truth) as false_negative, count(*) filter (not {on} and not truth) as true_negative,
  round(count(*) filter ({on} and truth) / nullif(count(*) filter (truth), 0), 6) + 0.0 as review_recall,
  round(count(*) filter (not {on} and truth) / nullif(count(*) filter (truth), 0), 6) + 0.0 as false_negative_rate,
  round(count(*) filter ({on} and not truth) / nullif(count(*) filter (not truth), 0), 6) + 0.0 as false_positive_rate,
  round(count(*) filter ({on} and truth) / nullif(count(*) filter ({on}), 0), 6) + 0.0 as precision,
  round(count(*) filter ({on} and is_defect) / nullif(count(*) filter (is_defect), 0), 6) + 0.0 as defect_recall,
  round(count(*) filter ({on} and is_tester_fault) / nullif(count(*) filter (is_tester_fault), 0), 6) + 0.0 as tester_fault_recall,
  round(count(*) filter ({on} and started) / nullif(count(*) filter (started), 0), 6) + 0.0 as started_anomaly_recall,
  round(count(*) filter ({on} and future) / nullif(count(*) filter (future), 0), 6) + 0.0 as future_failure_recall,
  round(count(*) filter ({on} and soon) / nullif(count(*) filter (soon), 0), 6) + 0.0 as early_failure_recall,
  round(median(case when {on} and soon then first_exceedance_hour - as_of_hour end), 6) + 0.0 as median_early_warning_lead_hours
from m group by {keys}""")
    return "\nunion all\n".join(one)


TRUTH = """
m as (
  select s.*, l.scenario, l.is_defect, l.is_tester_fault, l.is_healthy, l.anomaly_onset_hour, l.first_exceedance_hour,
    s.current_value >= s.upper_limit as f_fixed_limit, s.is_anomaly as f_robust_mad, s.strict_deviation >= 3.5 as f_robust_mad_strict,
    (l.is_defect or l.is_tester_fault) as truth,
    (l.is_defect or l.is_tester_fault) and coalesce(l.anomaly_onset_hour <= s.as_of_hour, false) as started,
    l.is_defect and l.first_exceedance_hour is not null as future,
    l.is_defect and coalesce(l.first_exceedance_hour > s.as_of_hour, false) as soon,
    l.is_defect and not l.is_tester_fault as d, not l.is_defect and not l.is_tester_fault as h
  from side s join labels_t l using (component_id, batch_id, component_family, measurement_name)
)"""


def harness(methods, keys="as_of_hour"):
    one = []
    for m in methods:
        on = f"f_{m}"
        later = f"({on} and d and coalesce(first_exceedance_hour > as_of_hour, false))"
        st = "(d and coalesce(anomaly_onset_hour <= as_of_hour, false))"
        one.append(f"""
select {keys}, '{m}' as method, count(*) as n_components, count(*) filter (d) as n_defects, count(*) filter (h) as n_healthy,
  count(*) filter (is_tester_fault) as n_tester_faults,
  count(*) filter ({on} and d) as true_positives, count(*) filter ({on} and h) as false_positives,
  count(*) filter (not {on} and d) as false_negatives, count(*) filter (not {on} and h) as true_negatives,
  round(count(*) filter ({on} and d) / nullif(count(*) filter (d), 0), 6) + 0.0 as defect_recall,
  round(count(*) filter (not {on} and d) / nullif(count(*) filter (d), 0), 6) + 0.0 as false_negative_rate,
  round(count(*) filter ({on} and h) / nullif(count(*) filter (h), 0), 6) + 0.0 as false_positive_rate,
  round(count(*) filter ({on} and d) / nullif(count(*) filter ({on} and (d or h)), 0), 6) + 0.0 as precision,
  round(count(*) filter ({on} and {st}) / nullif(count(*) filter ({st}), 0), 6) + 0.0 as recall_after_onset,
  count(*) filter ({later}) as n_early_warnings,
  round(median(case when {later} then first_exceedance_hour - as_of_hour end), 6) + 0.0 as median_lead_time_hours,
  round(avg(case when {later} then first_exceedance_hour - as_of_hour end), 6) + 0.0 as mean_lead_time_hours,
  round(min(case when {later} then first_exceedance_hour - as_of_hour end), 6) + 0.0 as min_lead_time_hours,
  count(*) filter ({on} and d and coalesce(first_exceedance_hour <= as_of_hour, false)) as n_detected_after_crossing,
  count(*) filter ({on} and d and first_exceedance_hour is null) as n_detected_never_crossing,
  round(count(*) filter ({on} and is_tester_fault) / nullif(count(*) filter (is_tester_fault), 0), 6) + 0.0 as tester_fault_flag_rate,
  round((count(*) filter ({on} and h) + count(*) filter ({on} and is_tester_fault)) / nullif(count(*) filter (h or is_tester_fault), 0), 6) + 0.0 as false_positive_rate_incl_tester_faults
from m group by {keys}""")
    return "\nunion all\n".join(one)


def split(fraction, seed, name="split_t", stratum="component_family"):
    strat = f"max({stratum})" if stratum else "'*'"
    return f"""
{name} as (
  select batch_id, case when n > 1 and pos <= greatest(1, least(cast(round_even(n * {fraction}, 0) as bigint), n - 1)) then 'test' else 'train' end as side, stratum
  from (select batch_id, stratum, row_number() over (partition by stratum order by md5(concat(batch_id, ':{seed}'))) as pos,
          count(*) over (partition by stratum) as n
        from (select batch_id, {strat} as stratum from readings group by batch_id) b) c
)"""


THREE_WAY = """
parts as (
  select batch_id, profile_id, case when pos <= n - 2 * floor(n / 5) then 'train' when pos <= n - floor(n / 5) then 'calibration' else 'test' end as split
  from (select batch_id, profile_id, row_number() over (partition by profile_id order by md5(concat(batch_id, ':26170'))) as pos,
          count(*) over (partition by profile_id) as n
        from (select distinct batch_id, profile_id from readings) b) c
)"""

# Forecast error table: y = final / limit, two baselines.
ERRORS = """
y0 as (
  select f.*, l.final_value / f.upper_limit as y, l.is_defect, l.is_tester_fault, l.is_healthy, l.scenario,
    l.anomaly_onset_hour, l.first_exceedance_hour,
    greatest(f.limit_fraction, 0) as p_pers, greatest(f.limit_fraction + f.slope_fraction_per_hour * 144, 0) as p_lin
  from z f join labels_t l using (component_id, batch_id, component_family, measurement_name)
  where l.final_value is not null and l.final_value >= 0
),
yy as (
  select *, 'persistence' as config, p_pers as pred from y0 union all select *, 'linear_extrapolation' as config, p_lin as pred from y0
)"""
