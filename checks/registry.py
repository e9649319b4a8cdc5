"""Registered queries: a Spark side and, where SQL can say it, an oracle side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from checks import sql as Q
from peerscreen import schema as S
from peerscreen.functions import columns as C
from peerscreen.operators import decide, features as feats, forecast, intervals, metrics, ordering, peers, quality, splits
from peerscreen.plans import evaluation, screening
from peerscreen.sources import csv as csv_source, export, tables

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            # A nudge off exact ties: the engines round halves differently.
            ORACLE[name] = sql.replace(", 6) + 0.0", " + 1e-9, 6) + 0.0")
        return fn

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places (minus zero becomes zero), arrays to '; '-joined text."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "double":
            out[f.name] = F.round(F.col(f.name) + 1e-9, 6) + F.lit(0.0)
        elif kind == "array":
            out[f.name] = F.array_join(F.transform(f.name, lambda x: x.cast("string")), "; ")
    return df.withColumns(out) if out else df


READ, HEAT, KEY = tables.readings, tables.heat, S.KEY4
CARRY = ["tester_channel", "profile_id"]


def feature_table(spark, d, hours=24.0, carry=()):
    return feats.build_component_features(READ(spark, d), as_of_hour=hours, grid=tables_grid(), carry=carry, hot=HEAT(spark, d).peer)


def tables_grid():
    """Checkpoint hours of the event-backed readings: thirty days in four-day steps."""
    return [24.0 * i for i in range(8)]


def records(spark, d):
    """Records with a radius given by the caller; calibrated ones are J-20_calibrated_records."""
    return screening.screen(READ(spark, d), grid=tables_grid(), carry=CARRY, hot=HEAT(spark, d).peer, radius=0.25)


def unscored(spark, d):
    verdict = quality.eligibility(READ(spark, d), family="EVT", measurement=None)
    return verdict.filter(F.size("reasons") > 0)


def labels(spark, d):
    return tables.labels(READ(spark, d))


# --- a view with planted faults; every reading is kept --------------------------

DIRTY_SQL = f"""
num as (select *, cast(substr(component_id, 2) as int) as k from readings),
dirty as (
  select component_id, case when k % 31 = 0 and hours >= 96 then 'BX' else batch_id end as batch_id, component_family, measurement_name,
    case when k % 17 = 0 and hours = 0 then -24.0 else hours end as hours,
    case when k % 29 = 0 and hours = 24 then null else measurement_value end as measurement_value,
    case when k % 19 = 0 and hours >= 72 then 130.0 else upper_limit end as upper_limit,
    case when k % 23 = 0 then 125.0 end as lower_limit,
    case when k % 37 = 0 then 'mA' when k % 41 = 0 then ' ' else 'uA' end as measurement_unit,
    case when k % 2 = 0 then 'Synthetic run' else 'bench' end as data_source, k
  from num cross join (values (1), (2)) c(copy) where copy = 1 or k % 13 = 0
)"""


def dirty(spark, d):
    k = F.substring("component_id", 2, 12).cast("int")
    df = READ(spark, d).withColumn("k", k)
    k, h = F.col("k"), F.col("hours")
    copies = F.when(k % 13 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    df = df.withColumn("_c", F.explode(copies))
    return df.select(
        "component_id",
        F.when((k % 31 == 0) & (h >= 96), "BX").otherwise(F.col("batch_id")).alias("batch_id"),
        "component_family",
        "measurement_name",
        F.when((k % 17 == 0) & (h == 0), -24.0).otherwise(h).alias("hours"),
        F.when(~((k % 29 == 0) & (h == 24)), F.col("measurement_value")).alias("measurement_value"),
        F.when((k % 19 == 0) & (h >= 72), 130.0).otherwise(F.col("upper_limit")).alias("upper_limit"),
        F.when(k % 23 == 0, F.lit(125.0)).alias("lower_limit"),
        F.when(k % 37 == 0, "mA").when(k % 41 == 0, " ").otherwise("uA").alias("measurement_unit"),
        F.when(k % 2 == 0, "Synthetic run").otherwise("bench").alias("data_source"),
        "k",
    )


DIRTY = (Q.READINGS, DIRTY_SQL)
K = Q.KEY

# --- A: sources and sinks --------------------------------------------------------


def csv_copy(spark, d, df=None, per_file=0):
    path = export.scratch(spark, "csv")
    df = df if df is not None else READ(spark, d)
    df.write.option("header", True).option("maxRecordsPerFile", per_file).csv(path)
    return path


UPLOAD_ROWS = 20_000  # within the bounds of an upload, 10 MB and 100 000 rows


@query("A-01_csv_scan", Q.query(Q.READINGS, select=f"select {K}, hours, round(measurement_value, 6) + 0.0 as measurement_value, upper_limit from readings"))
def _(spark, d):
    text = csv_source.read_text(spark, csv_copy(spark, d))
    return rounded(csv_source.ingest(text).clean.select(*KEY, "hours", "measurement_value", "upper_limit"))


@query("A-02_identity_scan", Q.query(Q.READINGS, select=f"select {K}, count(*) as readings from readings group by {K}"))
def _(spark, d):
    return csv_source.read_text(spark, csv_copy(spark, d)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("readings"))


def batch_number():
    return F.substring("batch_id", 2, 9).cast("int")


def by_part(df, path, kind="csv"):
    """One file per value of ``part``, in the order of the rows."""
    df.write.option("header", True).partitionBy("part").format(kind).save(path)
    return path


@query("A-03_file_triage", Q.query(Q.READINGS, select="select 'text' as status, count(distinct batch_id) as files, true as bytes_as_read, true as listed_once from readings"))
def _(spark, d):
    path = by_part(READ(spark, d).withColumn("part", batch_number()).repartition(8, "part"), export.scratch(spark, "csv"))
    lines = spark.read.option("recursiveFileLookup", True).text(path).agg(F.sum(F.octet_length("value") + 1).alias("read"))
    found = csv_source.triage(spark, path).groupBy("status").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), (F.count(F.lit(1)) == F.count_distinct("path")).alias("listed_once")
    )
    return found.crossJoin(F.broadcast(lines)).select("status", "files", (F.col("bytes") == F.col("read")).alias("bytes_as_read"), "listed_once")  # one row


@query("A-01_intake_job", Q.query(Q.READINGS, select=f"select {K}, count(*) as readings, round(sum(measurement_value), 6) + 0.0 as total from readings group by {K}"))
def _(spark, d):
    got = csv_source.ingest_files(spark, csv_copy(spark, d, per_file=UPLOAD_ROWS))
    return rounded(got.clean.groupBy(*KEY).agg(F.count(F.lit(1)).alias("readings"), F.sum("measurement_value").alias("total")))


@query(
    "A-01_bulk_records",
    Q.query(Q.READINGS, select=f"""select {K}, hours, round(measurement_value, 6) + 0.0 as measurement_value,
  component_id || chr(10) || '"' || measurement_name || '", ' || chr(13) || chr(10) || 'end' as data_source from readings"""),
)
def _(spark, d):
    """Every record holds a quoted cell of three lines; files are split, not read whole."""
    note = F.concat("component_id", F.lit('\n"'), "measurement_name", F.lit('", \r\nend'))
    path = export.scratch(spark, "csv")
    READ(spark, d).withColumn("data_source", note).write.options(header=True, escape='"').csv(path)
    return rounded(csv_source.ingest_bulk(spark, path).clean.select(*KEY, "hours", "measurement_value", "data_source"))


@query("A-04_decode", Q.query(Q.READINGS, select="select case when cast(substr(batch_id, 2) as int) % 2 = 1 then 'cp1252' else 'utf-8' end as encoding, count(*) as data_lines, count(*) as with_unit from readings group by 1"))
def _(spark, d):
    """Every other batch in Windows-1252: its euro sign is the byte that ISO-8859-1 writes for U+0080. VT ends no line."""
    rows, odd = READ(spark, d).withColumn("data_source", F.lit("bench\u000b1")), batch_number() % 2 == 1
    path = export.scratch(spark, "csv")
    write = lambda df, unit, encoding: df.withColumn("measurement_unit", F.lit(unit)).write.mode("append").options(header=True, encoding=encoding, maxRecordsPerFile=UPLOAD_ROWS).csv(path)
    write(rows.filter(~odd), "µA€", "UTF-8")
    write(rows.filter(odd), "µA\u0080", "ISO-8859-1")
    lines = csv_source.decode(spark, path).filter("line_number > 1")
    return lines.groupBy("encoding").agg(F.count(F.lit(1)).alias("data_lines"), F.count_if(F.col("line").contains("µA€")).alias("with_unit"))


HEADERS_SQL = f"""b as (select distinct cast(substr(batch_id, 2) as int) as part from readings),
wanted as (select unnest([{', '.join(f"'{c}'" for c in S.REQUIRED_COLUMNS)}]) as name)"""


@query(
    "A-05_header_check",
    Q.query(Q.READINGS, HEADERS_SQL, select="""select part, 'upper_limit' as column_name, 'MISSING_REQUIRED_COLUMNS' as code from b where part % 3 = 0
union all select part, 'hours', 'DUPLICATE_HEADER' from b where part % 3 = 1
union all select part, null, 'FILE_EMPTY' from b where part % 3 = 2
union all select part, name, 'MISSING_REQUIRED_COLUMNS' from b cross join wanted where part % 3 = 2"""),
)
def _(spark, d):
    """One file per batch, its header short of a column, with a double one, or blank."""
    full, part = ",".join(S.REQUIRED_COLUMNS), F.col("part")
    short = full.replace("batch_id", " batch_id ").removesuffix(",upper_limit")
    head = F.when(part % 3 == 0, short).when(part % 3 == 1, full + ",hours").otherwise(",,")
    rows = READ(spark, d).select(batch_number().alias("part"), F.col("measurement_value").cast("string").alias("value"))
    lines = rows.withColumn("at", F.lit(1)).unionByName(rows.select("part").distinct().select("part", head.alias("value"), F.lit(0).alias("at")))
    path = by_part(lines.repartition(8, "part").sortWithinPartitions("part", "at").drop("at"), export.scratch(spark, "headers"), "text")
    found = csv_source.check_headers(csv_source.header_names(spark, path, glob="*.txt"))
    return found.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("int").alias("part"), "column_name", "code")


@query("A-06_row_cap", Q.query(Q.READINGS, select="select case when batch_id = 'B00' then 0 else 1 end as part, count(*) as rows, count(*) > (select count(*) // 2 from readings) as over_cap from readings group by 1"))
def _(spark, d):
    """Two files, one on either side of a cap of half of all rows."""
    rows = READ(spark, d).withColumn("part", (batch_number() > 0).cast("int"))
    df = csv_source.read_text(spark, by_part(rows.repartition(8, "part"), export.scratch(spark, "csv")), line_numbers=True)
    per_file = csv_source.rows_per_file(df, rows.count() // 2)
    return per_file.select(F.regexp_extract("file_path", r"part=(\d+)", 1).cast("int").alias("part"), "rows", "over_cap")


@query("A-07_outcome_scan", Q.query(Q.READINGS, select=f"select {K}, hours, round(measurement_value, 6) + 0.0 as measurement_value from readings where hours > 24"))
def _(spark, d):
    later = quality.later_readings(READ(spark, d))
    got = csv_source.ingest_outcomes(csv_source.read_text(spark, csv_copy(spark, d, later)))
    return rounded(got.clean.select(*KEY, "hours", "measurement_value"))


A08_SQL = f"""
select column_name, code, count(*) as cells from (
  select 'measurement_value' as column_name, 'NON_FINITE_VALUE' as code from dirty where measurement_value is null
  union all select 'measurement_value', 'NON_FINITE_VALUE' from dirty where measurement_value is not null and k % 43 = 0
  union all select 'lower_limit', 'INVALID_OPTIONAL_FIELD' from dirty where k % 47 = 0
) x group by column_name, code"""


@query("A-08_cell_errors", Q.query(*DIRTY, select=A08_SQL))
def _(spark, d):
    df = dirty(spark, d).withColumns({c: F.col(c).cast("string") for c in ("hours", "measurement_value", "upper_limit", "lower_limit")})
    k = F.col("k")
    df = df.withColumns(
        {
            "measurement_value": F.when(k % 43 == 0, F.concat("measurement_value", F.lit("d"))).otherwise(F.col("measurement_value")),
            "lower_limit": F.when(k % 47 == 0, "n/a").otherwise(F.col("lower_limit")),
        }
    )
    return csv_source.cell_errors(df, S.REQUIRED_NUMERIC, ["lower_limit"]).groupBy("column_name", "code").agg(F.count(F.lit(1)).alias("cells"))


@query("A-09_numeric_promotion", Q.query(Q.READINGS, select="select measurement_name, cast(count(*) as bigint) as n, round(sum(temperature_c), 6) + 0.0 as temperature_sum from readings group by measurement_name"))
def _(spark, d):
    df = csv_source.promote_numeric(csv_source.read_text(spark, csv_copy(spark, d)))
    return rounded(df.groupBy("measurement_name").agg(F.count(F.lit(1)).alias("n"), F.sum("temperature_c").alias("temperature_sum")))


@query("A-10_boolean_labels", Q.query(Q.READINGS, Q.LABELS, select=f"select {K}, is_defect, is_tester_fault from labels_t"))
def _(spark, d):
    text = labels(spark, d).withColumns(
        {"is_defect": F.when(F.col("is_defect"), "TRUE").otherwise("0"), "is_tester_fault": F.when(F.col("is_tester_fault"), " 1 ").otherwise("False")}
    )
    return csv_source.boolean_labels(text, ["is_defect", "is_tester_fault"])[0].select(*KEY, "is_defect", "is_tester_fault")


@query(
    "A-11_training_rows",
    Q.query(
        Q.READINGS, Q.LABELS,
        f"""ok as (select {K} from readings group by {K} having count(case when hours = 0 then 1 end) = 1 and count(case when hours = 24 then 1 end) = 1),
pair as (select r.* from readings r join ok using ({K}) where hours in (0, 24))""",
        Q.features(source="pair"),
        select=f"""select f.component_id, f.batch_id, f.component_family, f.measurement_name, {Q.r6('f.limit_fraction as limit_fraction', 'f.slope_fraction_per_hour as slope_fraction_per_hour', 'l.final_value / f.upper_limit as y')}
from feat f join labels_t l using ({K}) where l.final_value >= 0""",
    ),
)
def _(spark, d):
    prepared = screening.prepare_early_features(READ(spark, d), family="EVT", measurement=None, strict=False)
    rows = forecast.joined_labels(prepared.features, labels(spark, d)).filter("y is not null")
    return rounded(rows.select(*KEY, "limit_fraction", "slope_fraction_per_hour", "y"))


@query(
    "A-12_split_export",
    Q.query(Q.READINGS, Q.THREE_WAY, select="""select split, count(*) as readings, count(*) filter (hours in (0, 24)) as early, count(distinct component_id) as components
from readings join parts using (batch_id, profile_id) group by split"""),
)
def _(spark, d):
    r = READ(spark, d)
    split = splits.three_way_split(r)
    parts = export.split_tables(r, tables.labels(r), split)
    path = export.scratch(spark, "splits")
    export.write_split_tables({k: parts[k] for k in ("readings", "early")}, path)
    back = spark.read.parquet(path + "/readings")
    early = spark.read.parquet(path + "/early").groupBy("split").agg(F.count(F.lit(1)).alias("early"))
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("readings"), F.count_distinct("component_id").alias("components")).join(early, "split")


@query("A-13_report_sinks", Q.query(Q.READINGS, Q.features(), Q.Z, Q.SCORED, Q.RECORDS, select="select recommendation, count(*) as n from records group by recommendation"))
def _(spark, d):
    counts = records(spark, d).groupBy("recommendation").agg(F.count(F.lit(1)).alias("n"))
    path = export.scratch(spark, "report")
    export.write_report({"metrics": counts}, path, {"as_of_hour": 24.0})
    return spark.read.option("header", True).schema("recommendation string, n bigint").csv(path + "/metrics")


FLAT_SQL = f"""select component_id as "Component_ID", batch_id as "Batch_ID", {Q.r6('current_value as Latest_24h_uA', 'applicable_limit as Applicable_Limit_uA', 'anomaly_score as Anomaly_Score', 'current_batch_robust_z as Peer_Robust_Z', 'predicted_final_value as Predicted_168h_uA', 'prediction_upper as Interval_Upper_uA')},
  peer_count as "Peer_Sample_Size", case when is_anomaly then 'TRUE' else 'FALSE' end as "Anomaly_Flag",
  case when predicted_to_cross_limit then 'TRUE' else 'FALSE' end as "Predicted_Limit_Cross",
  recommendation as "Recommendation", reasons as "Recommendation_Reasons", measurement_name from records"""


@query("A-14_flat_export", Q.query(Q.READINGS, Q.features(), Q.Z, Q.SCORED, Q.RECORDS, select=FLAT_SQL.replace(", measurement_name from", " from")))
def _(spark, d):
    flat = export.flat_export(records(spark, d))
    return rounded(flat.select(
        "Component_ID", "Batch_ID", "Latest_24h_uA", "Applicable_Limit_uA", "Anomaly_Score", "Peer_Robust_Z", "Predicted_168h_uA",
        "Interval_Upper_uA", "Peer_Sample_Size", "Anomaly_Flag", "Predicted_Limit_Cross", "Recommendation", "Recommendation_Reasons",
    ))


@query("A-14_flagged_export", Q.query(Q.READINGS, Q.features(), Q.Z, Q.SCORED, Q.RECORDS, select=f"""select component_id as "Component_ID", batch_id as "Batch_ID", recommendation as "Recommendation", reasons as "Reasons",
{Q.r6('current_value as Latest_24h_uA', 'applicable_limit as Limit_uA', 'current_batch_robust_z as Peer_Robust_Z', 'predicted_final_value as Predicted_168h_uA', 'prediction_upper as Interval_Upper_uA')}, cast(null as varchar) as "Board_Position"
from records where recommendation <> 'ACCEPT'"""))
def _(spark, d):
    return rounded(export.flagged_export(records(spark, d)))


@query("A-15_sample_slice", Q.query(Q.READINGS, select=f"""select r.component_id, r.batch_id, r.component_family, r.measurement_name, hours, round(measurement_value, 6) + 0.0 as measurement_value from readings r
join (select distinct component_id from readings where hours <= 24 order by component_id limit 240) i using (component_id) where hours <= 24 or hours = 168"""))
def _(spark, d):
    r = READ(spark, d)
    out = export.sample_slice(r.filter("hours <= 24"), r.filter("hours > 24"))
    return rounded(out.select(*KEY, "hours", "measurement_value"))


@query(
    "A-18_fingerprint",
    Q.query(Q.READINGS, select=f"select count(*) as rows, cast(sum(h) as varchar) as hash_sum, bit_xor(h) as hash_xor from (select ('0x' || substr(md5(concat_ws('|', {K}, cast(hours as varchar))), 1, 15))::bigint as h from readings)"),
)
def _(spark, d):
    df = READ(spark, d).select(*KEY, "hours")
    row_hash = F.conv(F.substring(F.md5(F.concat_ws("|", *KEY, F.col("hours").cast("string"))), 1, 15), 16, 10).cast("bigint")
    return export.fingerprint(df, row_hash=row_hash).select("rows", F.col("hash_sum").cast("string").alias("hash_sum"), "hash_xor")


@query("A-19_non_finite_to_null", Q.query(Q.READINGS, select=f"select {K}, hours, case when cast(substr(component_id, 2) as int) % 3 > 0 then round(measurement_value, 6) + 0.0 end as measurement_value from readings"))
def _(spark, d):
    k = F.substring("component_id", 2, 12).cast("int")
    spoiled = F.when(k % 3 == 0, F.when(k % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("measurement_value"))
    return rounded(C.null_non_finite(READ(spark, d).withColumn("measurement_value", spoiled).select(*KEY, "hours", "measurement_value")))


# --- B: data quality ---------------------------------------------------------------

B01 = """select 'null_' || c as "check", n from (
  select unnest(['component_id','batch_id','component_family','hours','measurement_name','measurement_value','upper_limit']) as c,
    unnest([count(*) filter (component_id is null), count(*) filter (batch_id is null), count(*) filter (component_family is null), count(*) filter (hours is null),
      count(*) filter (measurement_name is null), count(*) filter (measurement_value is null), count(*) filter (upper_limit is null)]) as n from dirty)
union all select 'non_numeric_' || c, n from (
  select unnest(['hours','measurement_value','upper_limit']) as c, unnest([count(*) filter (hours is null), count(*) filter (measurement_value is null), count(*) filter (upper_limit is null)]) as n from dirty)
union all select 'negative_hours', count(*) filter (hours < 0) from dirty
union all select 'non_positive_limit', count(*) filter (upper_limit <= 0) from dirty
union all select 'lower_not_below_upper', count(*) filter (lower_limit >= upper_limit) from dirty
union all select 'empty_dataset', case when count(*) = 0 then 1 else 0 end from dirty
union all select 'duplicate_identity', cast(coalesce(sum(c), 0) as bigint) from (select count(*) as c from dirty group by component_id, batch_id, component_family, measurement_name, hours having count(*) > 1)
union all select 'limit_changes', count(*) from (select 1 from dirty group by component_id, measurement_name having count(distinct upper_limit) > 1)"""


@query("B-01_validate_readings", Q.query(*DIRTY, select=B01))
def _(spark, d):
    return quality.check_readings(dirty(spark, d))


@query("B-02_blank_identity", Q.query(*DIRTY, select="select 'batch_id' as \"column\", count(*) as n from dirty where batch_id = 'BX' having count(*) > 0"))
def _(spark, d):
    df = dirty(spark, d).withColumn("batch_id", F.when(F.col("batch_id") != "BX", F.col("batch_id")).otherwise(" "))
    return quality.blank_identity(df).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


@query("B-03_bad_hours", Q.query(*DIRTY, select=f"select {K}, hours, 'negative' as problem from dirty where hours < 0"))
def _(spark, d):
    return quality.bad_hours(dirty(spark, d)).select(*KEY, "hours", "problem")


@query("B-04_crossed_limits", Q.query(*DIRTY, select=f"select {K}, hours, lower_limit, upper_limit from dirty where lower_limit >= upper_limit"))
def _(spark, d):
    return quality.crossed_limits(dirty(spark, d)).select(*KEY, "hours", "lower_limit", "upper_limit")


@query("B-05_duplicate_readings", Q.query(*DIRTY, select=f"select {K}, hours, copies from (select *, count(*) over (partition by {K}, hours) as copies from dirty) x where copies > 1"))
def _(spark, d):
    return quality.duplicate_readings(dirty(spark, d)).select(*KEY, "hours", "copies")


@query("B-06_moving_limits", Q.query(*DIRTY, select=f"select {K}, 'upper_limit' as \"column\" from dirty group by {K} having count(distinct upper_limit) > 1 union all select {K}, 'lower_limit' from dirty group by {K} having count(distinct lower_limit) > 1"))
def _(spark, d):
    return quality.moving_limits(dirty(spark, d))


@query("B-07_shared_component_ids", Q.query(*DIRTY, select="select distinct component_id, batch_id, component_family from dirty where component_id in (select component_id from dirty group by component_id having count(distinct batch_id) > 1 or count(distinct component_family) > 1)"))
def _(spark, d):
    return quality.shared_component_ids(dirty(spark, d))


@query("B-08_first_errors", Q.query(*DIRTY, select=f"select {K}, hours from dirty where hours < 0 order by {K}, hours limit 50"))
def _(spark, d):
    return quality.first_errors(quality.bad_hours(dirty(spark, d)).select(*KEY, "hours"), [*KEY, "hours"])


B09 = f"""
g as (select {K}, count(*) filter (hours is null or hours < 0) as bad_h, count(*) filter (hours = 0) as h0, count(*) filter (hours = 24) as h24,
  count(*) filter (hours in (0, 24) and measurement_value is null) as nv, count(*) filter (hours in (0, 24) and measurement_value < 0) as neg,
  count(distinct case when hours in (0, 24) then upper_limit end) as lims, count(*) filter (hours in (0, 24) and upper_limit <= 0) as badlim,
  count(*) filter (hours in (0, 24) and lower_limit is not null) as low,
  count(*) filter (hours in (0, 24) and measurement_unit not in ('uA', 'µA', 'μA')) as unit from dirty group by {K})"""
B09_SELECT = f"""select {K}, array_to_string(list_filter([
  case when bad_h > 0 then 'Hours must be finite, numeric and nonnegative' end,
  case when h0 <> 1 or h24 <> 1 then 'Exactly one 0-hour and one 24-hour reading are required' end,
  case when nv > 0 then 'measurement_value must be finite and numeric at both checkpoints' end,
  case when neg > 0 then 'Leakage must be nonnegative' end,
  case when lims <> 1 or badlim > 0 then 'A positive, unchanged upper_limit is required' end,
  case when low > 0 then 'This leakage bundle implements upper-limit screening only; lower limits require a separate profile' end,
  case when unit > 0 then 'measurement_unit must explicitly specify microamperes (uA)' end], lambda x: x is not null), '; ') as reasons from g"""


@query("B-09_eligibility_reasons", Q.query(*DIRTY, B09, select=B09_SELECT))
def _(spark, d):
    return rounded(quality.eligibility(dirty(spark, d), family="EVT", measurement=None))


@query("B-10_mixed_batches", Q.query(*DIRTY, select="select batch_id, 'upper_limit' as \"column\" from dirty group by batch_id having count(distinct upper_limit) > 1"))
def _(spark, d):
    return quality.mixed_batches(dirty(spark, d), [*quality.CONSTANT_COLUMNS, "upper_limit"])


B11 = """select batch_id, component_family, measurement_name, 'measurement_unit' as "column", 'INCOMPATIBLE_UNITS' as code from dirty group by all having count(distinct nullif(trim(measurement_unit), '')) > 1
union all select batch_id, component_family, measurement_name, 'upper_limit', 'INCOMPATIBLE_TEST_CONDITIONS' from dirty group by all having count(distinct upper_limit) > 1
union all select batch_id, component_family, measurement_name, 'lower_limit', 'INCOMPATIBLE_TEST_CONDITIONS' from dirty group by all having count(distinct lower_limit) > 1"""


@query("B-11_incompatible_peers", Q.query(*DIRTY, select=B11))
def _(spark, d):
    return quality.incompatible_peers(dirty(spark, d))


# A profile table for the event-backed readings: two supported, one planned, others unknown.
def event_profiles(spark):
    base = ("upper", 24.0, 168.0, [0.0, 24.0], 8, ["ua", "µa"])
    rows = [(f"evt_{m}", "EVT", m, "uA", base[0], s, *base[1:]) for m, s in (("click", "supported"), ("view", "supported"), ("purchase", "planned"))]
    from peerscreen.schema import profiles
    return profiles(spark, rows)


PROFILE_SQL = "prof as (select * from (values ('evt_click','EVT','click','supported'), ('evt_view','EVT','view','supported'), ('evt_purchase','EVT','purchase','planned')) p(pid, component_family, measurement_name, status))"


@query("B-12_profile_resolution", Q.query(Q.READINGS, PROFILE_SQL, select=f"""select {K}, pid as profile_id,
  case when pid is null then 'unsupported_profile' when status <> 'supported' then 'profile_not_available' when h0 = 0 or h24 = 0 then 'missing_checkpoint' end as reason,
  case when pid is not null then array_to_string(list_filter([case when h0 = 0 then '0.0' end, case when h24 = 0 then '24.0' end], lambda x: x is not null), '; ') end as missing_hours
from (select {K}, count(*) filter (hours = 0) as h0, count(*) filter (hours = 24) as h24 from readings group by {K}) g left join prof using (component_family, measurement_name)"""))
def _(spark, d):
    return rounded(quality.resolve_profiles(READ(spark, d), event_profiles(spark)).select(*KEY, "profile_id", "reason", "missing_hours"))


@query("B-13_unit_mismatches", Q.query(*DIRTY, PROFILE_SQL, select=f"select {K}, hours, measurement_unit from dirty join prof using (component_family, measurement_name) where measurement_unit = 'mA'"))
def _(spark, d):
    return quality.unit_mismatches(dirty(spark, d), event_profiles(spark)).select(*KEY, "hours", "measurement_unit")


@query("B-14_preflight", Q.query(*DIRTY, select="""select * from (select 'UNSUPPORTED_LOWER_LIMIT' as code, count(lower_limit) as n, true as fatal from dirty
union all select 'UNSUPPORTED_FAMILY_OR_MEASUREMENT_PRESENT', count(*) filter (measurement_name <> 'click'), false from dirty
union all select 'PROFILE_ID_COLUMN_ABSENT', count(*), false from dirty) x where n > 0"""))
def _(spark, d):
    return quality.preflight(dirty(spark, d), "EVT", "click")


@query("B-15_supported_profiles", Q.query(Q.READINGS, select=f"select distinct {K}, case when profile_id = 'P0' then 'scored' else 'unscored' end as status from readings"))
def _(spark, d):
    good, other = quality.supported_profiles(READ(spark, d), ["P0"])
    return good.select(*KEY, F.lit("scored").alias("status")).unionByName(other.select(*KEY, F.lit("unscored").alias("status"))).distinct()


@query("B-16_reason_codes", Q.query(*DIRTY, B09, f"r as ({B09_SELECT})", select="""select case when reasons like '%0-hour%' then 'missing_checkpoint' when reasons like '%Hours must be%' then 'missing_checkpoint' else 'core_error' end as reason, count(*) as n
from r where reasons <> '' group by 1"""))
def _(spark, d):
    bad = quality.eligibility(dirty(spark, d), family="EVT", measurement=None).filter(F.size("reasons") > 0)
    return bad.select(quality.unscored_reason(F.array_join("reasons", " ")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("B-17_vanished", Q.query(Q.READINGS, Q.features(), select=f"select {K}, 'too_few_early_readings' as reason from (select distinct {K} from readings) r anti join feat using ({K})"))
def _(spark, d):
    r = READ(spark, d)
    return quality.vanished(r, feats.history_features(r, grid=tables_grid()))


B18 = f"""select 'at_or_before_cutoff' as "check", count(*) filter (hours <= 24) as n from dirty
union all select 'repeated_observation', cast(coalesce(sum(c), 0) as bigint) from (select count(*) as c from dirty group by {K}, hours having count(*) > 1) x
union all select 'unknown_identity', count(*) from (select distinct {K} from dirty except select distinct {K} from readings where hours <= 24) x
union all select 'uncovered_history', count(*) from (select distinct {K} from readings where hours <= 24 except select distinct {K} from dirty) x"""


@query("B-18_check_outcomes", Q.query(*DIRTY, select=B18))
def _(spark, d):
    return quality.check_outcomes(dirty(spark, d), READ(spark, d).filter("hours <= 24"))


@query("B-19_twice_supplied", Q.query(Q.READINGS, select=f"select {K}, hours from readings where hours between 96 and 120"))
def _(spark, d):
    r = READ(spark, d)
    return quality.twice_supplied(r.filter("hours >= 96"), r.filter("hours <= 120"))


@query("B-20_check_labels", Q.query(Q.READINGS, Q.LABELS, Q.features(), select="""select 'repeated_label' as "check", cast(0 as bigint) as n
union all select 'unlabelled_row', count(*) from feat anti join (select * from labels_t where final_value is not null) l using (component_id, batch_id, component_family, measurement_name)
union all select 'bad_final_value', cast(0 as bigint)"""))
def _(spark, d):
    return quality.check_labels(labels(spark, d).filter("final_value is not null"), feats.history_features(READ(spark, d), grid=tables_grid()))


def error_rows(spark, d):
    """Both baselines against the observed final value."""
    f = forecast.joined_labels(feature_table(spark, d, carry=CARRY), labels(spark, d)).filter("y is not null")
    truth = labels(spark, d).select(*KEY, "is_defect", "is_tester_fault", "is_healthy", "scenario", "anomaly_onset_hour", "first_exceedance_hour")
    both = f.join(truth, KEY)
    pair = F.array(*[F.struct(F.lit(n).alias("config"), forecast.baseline(n).alias("pred")) for n in forecast.BASELINES])
    return both.withColumn("_p", F.explode(pair)).select("*", "_p.config", "_p.pred").drop("_p")


ERR = (Q.READINGS, Q.LABELS, Q.features(), Q.Z, Q.ERRORS)


@query("B-21_training_profile", Q.query(*ERR, select=f"""select count(*) as components, count(distinct batch_id) as batches, (select min(c) from (select count(*) as c from y0 group by batch_id)) as batch_min,
 (select max(c) from (select count(*) as c from y0 group by batch_id)) as batch_max, count(*) filter (y >= 1) as final_crossings, count(*) filter (limit_fraction >= 1) as already_at_limit, {Q.r6('avg(y) as y_mean')},
 """ + ", ".join(f"round(quantile_cont(y, {q}), 6) + 0.0 as y_{str(q).replace('0.', 'q')}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)) + " from y0"))
def _(spark, d):
    return rounded(metrics.training_profile(error_rows(spark, d).filter("config = 'persistence'"), hot=HEAT(spark, d).table))


@query("B-22_provenance", Q.query(*DIRTY, select="select case when bool_and(data_source = 'Synthetic run') then 'synthetic' when bool_and(data_source = 'bench') then 'measured_unverified' else 'mixed' end as provenance from dirty"))
def _(spark, d):
    return quality.provenance(dirty(spark, d))


@query("B-23_leakage_columns", Q.query(Q.READINGS, Q.LABELS, select="select profile_id, is_defect, count(*) as n from labels_t group by all"))
def _(spark, d):
    slim = feats.strip_leakage_columns(labels(spark, d))
    feats.require_clean_feature_names(S.MODEL_FEATURES)
    return slim.select("profile_id", "is_defect").groupBy("profile_id", "is_defect").agg(F.count(F.lit(1)).alias("n"))


@query("B-24_split_guards", Q.query(*DIRTY, Q.split(0.4, 7), select="""select 'batch_on_two_sides' as "check", cast(0 as bigint) as n
union all select 'batch_without_side', count(*) from (select distinct batch_id from dirty) b anti join split_t using (batch_id)
union all select 'component_on_two_sides', count(*) from (select component_id from dirty join split_t using (batch_id) group by component_id having count(distinct side) > 1) x
union all select 'feature_after_cutoff', cast(0 as bigint)"""))
def _(spark, d):
    r = READ(spark, d)
    return splits.check_split(dirty(spark, d), splits.split_batches(r), feats.history_features(r, grid=tables_grid()))


@query("B-25_release_checks", Q.query(*DIRTY, Q.LABELS, select=f"""select 'early_missing_rows' as "check", cast(count(*) as bigint) as n from dirty where hours in (0, 24) and k % 13 = 0 and not (k % 31 = 0 and false) and component_id is null
union all select 'early_extra_rows', cast(0 as bigint)
union all select 'repeated_reading', count(*) from (select 1 from dirty group by {K}, hours having count(*) > 1) x
union all select 'label_without_readings', cast(0 as bigint) union all select 'readings_without_label', cast(0 as bigint)
union all select 'non_positive_value', count(*) filter (not coalesce(measurement_value > 0 and upper_limit > 0, false)) from dirty"""))
def _(spark, d):
    full = dirty(spark, d)
    return quality.release_checks(full, full.filter(F.col("hours").isin(0.0, 24.0)), labels(spark, d))


MAPPING = {"initial_value": ("initial_value", 1.0), "current_value": ("current_value", 1.0), "delta": ("delta", 1.0), "percent": ("percent_change", 0.01), "shifted": ("slope", 1.0)}


@query("B-26_reconcile", Q.query(Q.READINGS, Q.features(), select=f"""select source_feature, model_feature, multiply_by, matches, round(max_absolute_error, 6) + 0.0 as max_absolute_error from (
 select 'initial_value' as source_feature, 'initial_value' as model_feature, 1.0 as multiply_by, true as matches, 0.0 as max_absolute_error
 union all select 'current_value', 'current_value', 1.0, true, 0.0 union all select 'delta', 'delta', 1.0, true, 0.0
 union all select 'percent', 'percent_change', 0.01, true, 0.0
 union all select 'shifted', 'slope', 1.0, max(abs(0.001 * n_observations)) = 0, max(abs(0.001 * n_observations)) from feat) x"""))
def _(spark, d):
    f = feats.history_features(READ(spark, d), grid=tables_grid())
    other = f.withColumns({"percent": F.col("percent_change") * 100, "shifted": F.col("slope") + F.col("n_observations") * 0.001})
    return rounded(quality.reconcile(other, f, KEY, MAPPING))


@query("B-27_table_audit", Q.query(*DIRTY, select=f"""select cast((select count(*) from dirty) as bigint) as rows, cast((select count(*) from dirty) - (select count(*) from (select distinct * from dirty)) as bigint) as exact_duplicates,
 (select count(distinct component_id) from dirty) as components, (select count(distinct batch_id) from dirty) as batches,
 (select cast(coalesce(sum(c), 0) as bigint) from (select count(*) as c from dirty group by {K}, hours having count(*) > 1)) as duplicate_checkpoint_rows"""))
def _(spark, d):
    return quality.audit(dirty(spark, d))


@query("B-28_null_report", Q.query(*DIRTY, select="""select column_name, missing_values, case when missing_values = 0 then 'PASS' else 'CHECK' end as status from (
 select unnest(['component_id', 'measurement_value', 'lower_limit']) as column_name, unnest([count(*) filter (component_id is null), count(*) filter (measurement_value is null), count(*) filter (lower_limit is null)]) as missing_values from dirty)"""))
def _(spark, d):
    return quality.null_report(dirty(spark, d), ["component_id", "measurement_value", "lower_limit"])


@query("B-28_invalid_report", Q.query(*DIRTY, select="""select check_name, invalid_rows, case when invalid_rows = 0 then 'PASS' else 'CHECK' end as status from (
 select unnest(['Negative hours', 'Negative measurement value', 'Invalid upper limit']) as check_name, unnest([count(*) filter (hours < 0), count(*) filter (measurement_value < 0), count(*) filter (upper_limit <= 0)]) as invalid_rows from dirty)"""))
def _(spark, d):
    return quality.invalid_report(dirty(spark, d))


@query("B-28_screening_status", Q.query(Q.READINGS, Q.features(), Q.Z, Q.SCORED, Q.RECORDS, select="""select status, count(*) as components, round(100 * count(*) / sum(count(*)) over (), 6) + 0.0 as percentage from (
 select case when current_value >= upper_limit then 'ABOVE LIMIT' when recommendation <> 'ACCEPT' then 'CHECK / MONITOR' else 'NORMAL' end as status from records) x group by status"""))
def _(spark, d):
    return rounded(quality.screening_status(records(spark, d)))


@query("B-29_record_diff", Q.query(Q.READINGS, Q.features((72.0,)), select="""select unnest(['only_left', 'only_right', 'measurement_name', 'current_value', 'slope']) as field,
 unnest([count(*) filter (n_observations < 3), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), count(*) filter (n_observations >= 3 and last_observed_hour > 24)]) as mismatches from feat"""))
def _(spark, d):
    f = feats.history_features(READ(spark, d), 72.0, grid=tables_grid())
    right = f.filter("n_observations >= 3").withColumn("slope", F.col("slope") + F.when(F.col("last_observed_hour") > 24, 1e-6).otherwise(0.0))
    f = f.withColumn("name_copy", F.col("measurement_name"))
    right = right.withColumn("name_copy", F.col("measurement_name"))
    out = quality.record_diff(f, right, KEY, ["name_copy"], ["current_value", "slope"])
    return out.withColumn("field", F.when(F.col("field") == "name_copy", "measurement_name").otherwise(F.col("field")))


@query("B-30_restore_codes", Q.query(Q.READINGS, select="select component_id, measurement_name, hours, batch_id, false as unmatched from readings"))
def _(spark, d):
    r = READ(spark, d)
    spoiled = r.withColumn("batch_id", F.substring("batch_id", 2, 9).cast("int").cast("string"))
    return quality.restore_codes(spoiled, r, ["batch_id"]).select("component_id", "measurement_name", "hours", "batch_id", "unmatched")


# --- C: projections and filters ------------------------------------------------------


@query("C-01_as_of_filter", Q.query(Q.READINGS, select=f"select {K}, hours from readings where hours <= 48"))
def _(spark, d):
    return feats.as_of(READ(spark, d), 48.0).select(*KEY, "hours")


@query("C-02_checkpoint_isolation", Q.query(Q.READINGS, select=f"select {K}, hours, case when hours in (0, 24) then 'early' else 'later' end as part from readings"))
def _(spark, d):
    r = READ(spark, d)
    early, later = quality.early_readings(r), quality.later_readings(r)
    return early.select(*KEY, "hours", F.lit("early").alias("part")).unionByName(later.select(*KEY, "hours", F.lit("later").alias("part")))


@query("C-03_ignored_readings", Q.query(*DIRTY, select="select count(*) as rows, count(*) filter (hours in (0, 24)) as checkpoint_rows, count(*) filter (hours > 24) as later_rows, count(*) filter (hours < 0) as ignored_rows from dirty"))
def _(spark, d):
    return quality.ignored_readings(dirty(spark, d))


@query("C-04_select_side", Q.query(Q.READINGS, Q.split(0.4, 7), select=f"select {K}, hours from readings join split_t using (batch_id) where side = 'test'"))
def _(spark, d):
    r = READ(spark, d)
    return splits.select_side(r, splits.split_batches(r), "test").select(*KEY, "hours")


LEVEL = ["delta", "percent_change", "delta_fraction_of_limit", "slope_fraction_per_hour", "variability_fraction_of_limit", "limit_fraction", "initial_fraction_of_limit", "distance_to_upper_limit", "distance_fraction_to_upper_limit"]


@query("C-05_level_features", Q.query(Q.READINGS, Q.features(), select=f"select {K}, {Q.r6(*LEVEL)} from feat"))
def _(spark, d):
    return rounded(feats.history_features(READ(spark, d), grid=tables_grid()).select(*KEY, *LEVEL))


C06 = f"""cap as (select {K}, arg_max(hours + 100.0, hours) as a, arg_min(measurement_value, hours) as c0, arg_max(measurement_value, hours) as c1 from readings where hours in (0, 24) group by {K})"""


@query("C-06_capacitor_extras", Q.query(Q.READINGS, C06, select=f"select {K}, {Q.r6('a / 120.0 as voltage_stress_ratio', 'c0 / 50.0 as initial_capacitance_fraction', 'c1 / 50.0 as current_capacitance_fraction', '(c1 - c0) / 50.0 as capacitance_change_fraction')}, cast(null as double) as dissipation_factor_change_pct from cap"))
def _(spark, d):
    r = READ(spark, d).filter("hours in (0, 24)").withColumns(
        {"applied_voltage_v": F.col("hours") + 100.0, "rated_voltage_v": F.lit(120.0), "nominal_capacitance_nf": F.lit(50.0), "capacitance_nf": F.col("measurement_value")}
    )
    return rounded(feats.capacitor_extras(r).select(*KEY, "voltage_stress_ratio", "initial_capacitance_fraction", "current_capacitance_fraction", "capacitance_change_fraction", "dissipation_factor_change_pct"))


@query("C-07_limit_info", Q.query(Q.READINGS, Q.features(), select=f"select {K}, direction as limit_direction, {Q.r6('lim as applicable_limit', 'case when direction = \'lower\' then current_value - lim else lim - current_value end as headroom', 'case when direction = \'lower\' then current_value - lim else lim - current_value end / lim as headroom_fraction')} from (select *, case when tester_channel = 1 then 'lower' else 'upper' end as direction, case when tester_channel = 1 then 20.0 else 120.0 end as lim from feat) x"))
def _(spark, d):
    f = feats.history_features(READ(spark, d), grid=tables_grid(), carry=["tester_channel"])
    f = f.withColumns({"limit_direction": F.when(F.col("tester_channel") == 1, "lower").otherwise("upper"), "lower_limit": F.lit(20.0)})
    return rounded(decide.limit_info(f).select(*KEY, "limit_direction", "applicable_limit", "headroom", "headroom_fraction"))


@query("C-08_display_percent", Q.query(Q.READINGS, Q.features(), select=f"select {K}, {Q.r6('case when initial_value <> 0 then percent_change end as percent_change', 'slope as slope_per_hour')} from feat"))
def _(spark, d):
    f = feats.history_features(READ(spark, d), grid=tables_grid())
    return rounded(f.select(*KEY, C.display_percent_change(F.col("initial_value"), F.col("current_value")).alias("percent_change"), F.col("slope").alias("slope_per_hour")))


@query("C-09_last_metadata", Q.query(*DIRTY, select=f"select {K}, arg_max(measurement_unit, hours) filter (trim(measurement_unit) <> '') as measurement_unit, arg_min(lower_limit, hours) filter (lower_limit is not null) as lower_limit from (select distinct {K}, hours, measurement_unit, lower_limit from dirty) x group by {K}"))
def _(spark, d):
    filled = F.when(~C.blank("measurement_unit"), F.col("hours"))
    return dirty(spark, d).groupBy(*KEY).agg(
        F.max_by("measurement_unit", filled).alias("measurement_unit"),
        F.min_by("lower_limit", F.when(F.col("lower_limit").isNotNull(), F.col("hours"))).alias("lower_limit"),
    )


@query("C-10_outcome_records", Q.query(Q.READINGS, select=f"""select o.component_id, o.batch_id, o.component_family, o.measurement_name, o.hours as observed_hour, {Q.r6('o.measurement_value as observed_value')}, e.lim as applicable_limit, case when e.lim is not null then o.measurement_value > e.lim end as crossed_applicable_limit
from readings o left join (select {K}, max(upper_limit) as lim from readings where hours <= 24 group by {K}) e using ({K}) where o.hours > 24"""))
def _(spark, d):
    r = READ(spark, d)
    return rounded(decide.outcome_records(quality.later_readings(r), r.filter("hours <= 24")))


REC = (Q.READINGS, Q.features(), Q.Z, Q.SCORED, Q.RECORDS)


@query("C-11_display_enrichment", Q.query(*REC, f"""o as (select component_id, measurement_name, max(case when hours = 168 then measurement_value end) as fin, bool_or(case when hours = 168 then measurement_value > 120.0 end) as crossed,
 count(*) as later_points from readings where hours > 24 group by component_id, measurement_name)""", select=f"select {K}, {Q.r6('fin as observed_at_target')}, crossed as crossed_at_target, later_points, current_value < upper_limit and is_anomaly as within_limit_but_unusual from records left join o using (component_id, measurement_name)"))
def _(spark, d):
    r = READ(spark, d)
    out = decide.display_enrichment(records(spark, d), decide.outcome_records(quality.later_readings(r), r))
    return rounded(out.select(*KEY, "observed_at_target", "crossed_at_target", F.size("outcome_trajectory").cast("bigint").alias("later_points"), "within_limit_but_unusual"))


TAGS = """tags as (select *, predicted_final_value >= upper_limit as t_limit, (slope >= 0.0025 or percent_change >= 45) as t_drift, abs(current_batch_robust_z) >= 2 as t_out from records),
tags2 as (select *, is_anomaly and current_value < upper_limit and not t_limit as t_lat from tags),
tagged as (select *, list_filter([case when t_limit then 'HUB_LIMIT' end, case when t_drift then 'HUB_DRIFT' end, case when t_out then 'HUB_OUTLIER' end, case when t_lat then 'HUB_LATENT' end], lambda x: x is not null) as hubs from tags2)"""


@query("C-12_mechanism_tags", Q.query(*REC, TAGS, select=f"select {K}, case when len(hubs) = 0 then 'HUB_NOMINAL' else array_to_string(hubs, '; ') end as mechanisms, len(hubs) >= 2 as is_compound from tagged"))
def _(spark, d):
    return rounded(decide.mechanism_tags(records(spark, d)).select(*KEY, "mechanisms", "is_compound"))


@query("C-12_mechanism_counts", Q.query(*REC, TAGS, select="select mechanism, count(*) as records, count(*) filter (recommendation <> 'ACCEPT') as flagged from (select recommendation, unnest(case when len(hubs) = 0 then ['HUB_NOMINAL'] else hubs end) as mechanism from tagged) x group by mechanism"))
def _(spark, d):
    return decide.mechanism_counts(decide.mechanism_tags(records(spark, d)))


@query("C-13_severity_band", Q.query(Q.READINGS, Q.features(), select=f"select {K}, case when limit_fraction >= 1 then 'limit_breach' when limit_fraction >= 0.75 then 'near_limit' when limit_fraction >= 0.45 then 'elevated' when limit_fraction >= 0.2 then 'healthy' else 'optimal' end as severity from feat"))
def _(spark, d):
    return decide.severity(feats.history_features(READ(spark, d), grid=tables_grid())).select(*KEY, "severity")


@query("C-14_record_search", Q.query(*REC, select=f"select {K}, {Q.r6('current_value')}, recommendation from records where (contains(lower(component_id), 'b0') or contains(lower(batch_id), 'b0') or contains(lower(profile_id), 'b0')) and is_anomaly"))
def _(spark, d):
    out = decide.search(records(spark, d), "B0", "ANOMALY", "current_value", False)
    return rounded(out.select(*KEY, "current_value", "recommendation"))


BOUNDS = {"temperature_c": (120.5, 123.0), "current_value": (5.0, 110.0)}


@query("C-15_outside_ranges", Q.query(Q.READINGS, Q.features(), select=f"""select {K}, array_to_string(o, '; ') as out_of_training_range_features, case when len(o) > 0 then 'outside_training_conditions' else 'ready' end as prediction_readiness from (
 select *, list_filter([case when temperature_c not between 120.5 and 123.0 then 'temperature_c' end, case when current_value not between 5.0 and 110.0 then 'current_value' end], lambda x: x is not null) as o from feat) y"""))
def _(spark, d):
    f = feats.history_features(READ(spark, d), grid=tables_grid())
    return rounded(decide.outside_ranges(f, BOUNDS).select(*KEY, "out_of_training_range_features", "prediction_readiness"))


C16 = """rep as (select component_id, batch_id, measurement_name, feature, v as parsed_value, lo as training_min, hi as training_max,
 case when v < lo then 'below training minimum' when v > hi then 'above training maximum' end as verdict, case when v < lo then lo - v when v > hi then v - hi end as amount from (
 select component_id, batch_id, measurement_name, 'temperature_c' as feature, temperature_c as v, 120.5 as lo, 123.0 as hi from feat union all select component_id, batch_id, measurement_name, 'current_value', current_value, 5.0, 110.0 from feat) x where v < lo or v > hi)"""


@query("C-16_extrapolation_report", Q.query(Q.READINGS, Q.features(), C16, select=f"select component_id, batch_id, measurement_name, feature, verdict, {Q.r6('parsed_value', 'training_min', 'training_max', 'amount')} from rep"))
def _(spark, d):
    f = feats.history_features(READ(spark, d), grid=tables_grid())
    return rounded(decide.extrapolation_report(f, BOUNDS, ["measurement_name"]))


@query("C-16_extrapolation_counts", Q.query(Q.READINGS, Q.features(), C16, select="select feature, verdict, count(*) as flags from rep group by feature, verdict"))
def _(spark, d):
    f = feats.history_features(READ(spark, d), grid=tables_grid())
    return decide.extrapolation_counts(decide.extrapolation_report(f, BOUNDS))


@query("C-17_missing_optional", Q.query(*DIRTY, select=f"select {K}, hours, array_to_string(list_filter([case when measurement_value is null then 'measurement_value' end, case when lower_limit is null then 'lower_limit' end], lambda x: x is not null), '; ') as missing, (case when measurement_value is null then 1 else 0 end + case when lower_limit is null then 1 else 0 end) as imputed from dirty"))
def _(spark, d):
    cols = ["measurement_value", "lower_limit"]
    return rounded(dirty(spark, d).select(*KEY, "hours", feats.missing_list(cols).alias("missing"), F.size(feats.missing_list(cols)).alias("imputed")))


STRATUM_SQL = """case when is_tester_fault then case when tfo > 24 then 'tester_fault_onset_72' else 'tester_fault_onset_0_12' end when is_defect then case when anomaly_onset_hour > 24 then 'defect_onset_gt24' else 'defect_onset_le24' end else 'healthy' end"""


def strata_labels(spark, d):
    k = F.floor(F.substring("component_id", 2, 12).cast("int") / 10)
    onset = F.when(F.col("is_tester_fault"), F.when(k % 2 == 0, 12.0).otherwise(72.0))
    return labels(spark, d).withColumn("tester_fault_onset_hour", onset)


STRATA_LABELS = "sl as (select *, case when is_tester_fault then case when cast(floor(cast(substr(component_id, 2) as int) / 10) as int) % 2 = 0 then 12.0 else 72.0 end end as tfo from labels_t)"


@query("C-18_retrospective_strata", Q.query(Q.READINGS, Q.LABELS, STRATA_LABELS, select=f"select {K}, {STRATUM_SQL} as stratum from sl"))
def _(spark, d):
    return strata_labels(spark, d).select(*KEY, metrics.retrospective_stratum().alias("stratum"))


@query("C-19_truth_flags", Q.query(Q.READINGS, Q.LABELS, Q.features(), Q.Z, Q.SCORED, "side as (select * from scored)", Q.TRUTH, select=f"select {K}, truth as is_true_anomaly, started as is_started_by_as_of, future as is_future_limit_failure, soon as is_early_future_failure from m"))
def _(spark, d):
    f = feats.history_features(READ(spark, d), grid=tables_grid()).join(labels(spark, d).drop("upper_limit", "profile_id"), KEY)
    return metrics.truth_flags(f).select(*KEY, "is_true_anomaly", "is_started_by_as_of", "is_future_limit_failure", "is_early_future_failure")


@query("C-20_first_exceedance", Q.query(Q.READINGS, Q.LABELS, select=f"select {K}, first_exceedance_hour from labels_t"))
def _(spark, d):
    return metrics.outcome_labels(READ(spark, d)).select(*KEY, "first_exceedance_hour")


@query("C-21_outcome_labels", Q.query(Q.READINGS, select=f"select {K}, {Q.r6('max(case when hours = 168 then measurement_value end) as final_value')}, bool_or(case when hours = 168 then measurement_value > upper_limit end) as is_final_exceedance, bool_or(measurement_value > upper_limit) as ever_exceeds from readings group by {K}"))
def _(spark, d):
    return rounded(metrics.outcome_labels(READ(spark, d)).drop("first_exceedance_hour"))


@query("C-22_derived_resistance", Q.query(Q.READINGS, select=f"select {K}, hours, {Q.r6('6.3 / nullif(1000 * measurement_value, 0) as insulation_resistance_gohm')} from readings"))
def _(spark, d):
    return rounded(READ(spark, d).select(*KEY, "hours", C.insulation_resistance(F.lit(6.3), F.col("measurement_value")).alias("insulation_resistance_gohm")))


@query("C-23_onset_alias", Q.query(Q.READINGS, Q.LABELS, select=f"select {K}, anomaly_onset_hour from labels_t"))
def _(spark, d):
    return metrics.with_onset(labels(spark, d).withColumnRenamed("anomaly_onset_hour", "defect_onset_hour")).select(*KEY, "anomaly_onset_hour")


@query("C-24_feature_matrix", Q.query(Q.READINGS, Q.features((72.0,)), select=f"select {K}, {Q.r6('case when n_observations % 2 = 0 then limit_fraction end as limit_fraction', 'slope')} from feat"))
def _(spark, d):
    f = feats.history_features(READ(spark, d), 72.0, grid=tables_grid())
    spoiled = f.withColumn("limit_fraction", F.when(F.col("n_observations") % 2 == 0, F.col("limit_fraction").cast("string")).otherwise("missing"))
    return rounded(feats.feature_matrix(spoiled, ["limit_fraction", "slope"]).select(*KEY, "limit_fraction", "slope"))


@query("C-25_predicted_crossing", Q.query(*REC, select=f"select {K}, predicted_to_cross_limit from records"))
def _(spark, d):
    return records(spark, d).select(*KEY, "predicted_to_cross_limit")
