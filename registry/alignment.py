"""Sensor and batch alignment, gating, status and button signals."""

from pyspark.sql import functions as F

from kinetable.operators import align, signals
from kinetable.plans import tables
from kinetable.sources import messages as msg
from registry.common import IMU, LONG, query, rounded

WIDE = ", ".join(
    f'{s.lower()}.{a} as "{a}{s}"' for s in "LRC" for a in "xyz"
)


@query(
    "align_sensors",
    f"""with {IMU}, {LONG}
    select l.session_id, l.seq, {WIDE}, cast(c.label as bigint) as label
    from imu_long l join imu_long r on l.session_id = r.session_id and l.seq = r.seq
      join imu_long c on l.session_id = c.session_id and l.seq = c.seq
    where l.sensor = 'L' and r.sensor = 'R' and c.sensor = 'C'""",
)
def align_sensors(spark, folder):
    aligned = align.align_sensors(tables.imu_long(spark, folder))
    return aligned.withColumn("label", F.col("label").cast("long"))


# Messages of 20 positions; every seventh message of a topic got lost.
MESSAGES = """
messages as materialized (
  select *, row_number() over (partition by session_id, sensor, batch order by seq) - 1 as pos,
    dense_rank() over (partition by session_id, sensor order by batch) - 1 as ordinal
  from (select *, seq // 20 as batch, seq % 20 + 1 as idx from imu_long) t
  where (batch + case sensor when 'L' then 0 when 'R' then 1 else 2 end) % 7 <> 0)
"""


def lossy_messages(spark, folder):
    nth = F.when(F.col("topic") == "Left", 0).when(F.col("topic") == "Right", 1).otherwise(2)
    whole = align.message_rows(tables.imu_long(spark, folder))
    return whole.where((F.col("batch") + nth) % 7 != 0)


@query(
    "message_ordinals",
    f"""with {IMU}, {LONG}, {MESSAGES}
    select distinct session_id, case sensor when 'L' then 'Left' when 'R' then 'Right' else 'Chest' end as topic,
      batch, ordinal from messages""",
)
def message_ordinals(spark, folder):
    return align.with_ordinal(lossy_messages(spark, folder)).select("session_id", "topic", "batch", "ordinal")


@query(
    "pair_batches",
    f"""with {IMU}, {LONG}, {MESSAGES}, sizes as (
      select session_id, ordinal, sensor, count(*) as n from messages group by all)
    select l.session_id, l.ordinal, l.n as left_rows, r.n as right_rows, c.n as chest_rows
    from sizes l join sizes r using (session_id, ordinal) join sizes c using (session_id, ordinal)
    where l.sensor = 'L' and r.sensor = 'R' and c.sensor = 'C'""",
)
def pair_batches(spark, folder):
    paired = align.pair_batches(align.with_ordinal(lossy_messages(spark, folder)))
    return paired.select(
        "session_id", "ordinal",
        *[F.size(t).cast("long").alias(f"{t.lower()}_rows") for t in align.TOPICS],
    )


@query(
    "align_batches",
    f"""with {IMU}, {LONG}, {MESSAGES}
    select l.session_id, l.ordinal, l.pos, l.idx as index, {WIDE}
    from messages l join messages r using (session_id, ordinal, pos) join messages c using (session_id, ordinal, pos)
    where l.sensor = 'L' and r.sensor = 'R' and c.sensor = 'C' and l.idx = r.idx and l.idx = c.idx""",
)
def align_batches(spark, folder):
    paired = align.pair_batches(align.with_ordinal(lossy_messages(spark, folder)))
    aligned = align.align_batches(paired)
    return aligned.withColumns({"pos": F.col("pos").cast("long"), "index": F.col("index").cast("long")})


@query(
    "batch_json",
    f"""with {IMU}, {LONG}, named as (
      select session_id, case sensor when 'L' then 'Left' when 'R' then 'Right' else 'Chest' end as topic,
        seq // 20 as batch, seq, x, y, z from imu_long)
    select session_id, topic, batch, count(*) as n, '[' || string_agg(
      printf('{{"index": %d, "x": %f, "y": %f, "z": %f, "sensor": "%s"}}', seq % 20 + 1, x, y, z, topic), ','
      order by seq) || ']' as payload from named group by session_id, topic, batch""",
)
def batch_json(spark, folder):
    return align.to_batches(tables.imu_long(spark, folder))


@query(
    "json_round_trip",
    f"""with {IMU}, {LONG}
    select session_id, case sensor when 'L' then 'Left' when 'R' then 'Right' else 'Chest' end as topic,
      seq // 20 as batch, seq % 20 + 1 as index, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from imu_long""",
)
def json_round_trip(spark, folder):
    texts = align.to_batches(tables.imu_long(spark, folder))
    rows = msg.explode_batches(texts, "payload", keys=("session_id", "topic", "batch"))
    return rounded(rows.drop("sensor"))


CONTROL = """
control as (
  select user_id as device, ts, case event_type when 'signup' then 'start' else 'finish' end as command
  from events where event_type in ('signup', 'error')),
samples as (select event_id, user_id as device, ts from events where event_type not in ('signup', 'error'))
"""


def control_events(spark, folder):
    events = tables.table(spark, folder, "events")
    kinds = F.col("event_type").isin("signup", "error")
    command = F.when(F.col("event_type") == "signup", "start").otherwise("finish")
    control = events.where(kinds).select(F.col("user_id").alias("device"), "ts", command.alias("command"))
    samples = events.where(~kinds).select("event_id", F.col("user_id").alias("device"), "ts")
    return samples, control


@query(
    "session_gate",
    f"""with {CONTROL}, spans as (
      select device, ts as since, lead(ts) over (partition by device order by ts) as until, command from control)
    select s.event_id, s.device, s.ts from samples s join spans p on s.device = p.device
      and s.ts >= p.since and (p.until is null or s.ts < p.until) where p.command = 'start'""",
)
def session_gate(spark, folder):
    samples, control = control_events(spark, folder)
    return align.gate_by_control(samples, control)


@query(
    "ready_gate",
    """with firsts as (
      select user_id as session_id, min(ts) filter (event_type = 'click') as a,
        min(ts) filter (event_type = 'view') as b, min(ts) filter (event_type = 'purchase') as c
      from events group by user_id),
    ready as (select session_id, greatest(a, b, c) as ready from firsts
      where a is not null and b is not null and c is not null)
    select event_id, session_id, ts from events join ready on user_id = session_id
    where ts >= ready and event_type in ('signup', 'error')""",
)
def ready_gate(spark, folder):
    events = tables.table(spark, folder, "events").withColumnRenamed("user_id", "session_id")
    sensors = ("click", "view", "purchase")
    status = events.withColumn("status", F.lit("on")).withColumnRenamed("event_type", "sensor")
    samples = events.where(F.col("event_type").isin("signup", "error")).select("event_id", "session_id", "ts")
    return align.gate_by_ready(samples, status, sensors=sensors)


STATUS = """
status as (select event_id, user_id as sensor, ts,
  case event_type when 'signup' then 'on' else 'off' end as status
  from events where event_type in ('signup', 'error'))
"""


def status_events(spark, folder):
    events = tables.table(spark, folder, "events").where(F.col("event_type").isin("signup", "error"))
    status = F.when(F.col("event_type") == "signup", "on").otherwise("off")
    return events.select("event_id", F.col("user_id").alias("sensor"), "ts", status.alias("status"))


@query(
    "latest_status",
    f"with {STATUS} select sensor, arg_max(status, ts) as status from status group by sensor",
)
def latest_status(spark, folder):
    return signals.latest(status_events(spark, folder), ["sensor"], "status")


@query(
    "status_changes",
    f"""with {STATUS} select event_id, sensor, ts, status from (
      select *, lag(status, 1, 'off') over (partition by sensor order by ts) as before from status) t
    where status <> before""",
)
def status_changes(spark, folder):
    return signals.status_changes(status_events(spark, folder))


@query(
    "keypress_edges",
    """with p as (select event_id, user_id as device, ts, cast(floor(value) as bigint) % 8 as value from events),
    q as (select *, lag(value, 1, 0) over (partition by device order by ts) as last from p)
    select event_id, device, ts, value, value & ~last & 3 as down, ~value & last & 3 as up from q""",
)
def keypress_edges(spark, folder):
    events = tables.table(spark, folder, "events")
    presses = events.select(
        "event_id", F.col("user_id").alias("device"), "ts", (F.floor("value") % 8).cast("long").alias("value")
    )
    return signals.keypress_edges(presses)


@query(
    "button_names",
    """with p as (select user_id as device, ts, cast(floor(value) as bigint) % 4 as value from events),
    q as (select *, lag(value, 1, 0) over (partition by device order by ts) as last from p)
    select case value & ~last & 3 when 1 then 'Right button' when 2 then 'Left button' else 'Both buttons' end
      as name, count(*) as n from q where value & ~last & 3 <> 0 group by 1""",
)
def button_names(spark, folder):
    events = tables.table(spark, folder, "events")
    presses = events.select(
        F.col("user_id").alias("device"), "ts", (F.floor("value") % 4).cast("long").alias("value")
    )
    down = signals.keypress_edges(presses).where(F.col("down") != 0)
    return down.groupBy(signals.button_name(F.col("down")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "temperature_humidity",
    """select event_id, cast(trunc(value) as bigint) as temp, cast(user_id - 75 as bigint) as hum,
      abs(user_id - 75) as shown from events""",
)
def temperature_humidity(spark, folder):
    events = tables.table(spark, folder, "events")
    text = events.select(
        "event_id", F.format_string("%d %d", F.col("value").cast("long"), F.col("user_id") - 75).alias("text")
    )
    parsed = text.select("event_id", signals.parse_temp_hum(F.col("text")).alias("v")).select("event_id", "v.*")
    return rounded(parsed.withColumn("shown", signals.shown_humidity(F.col("hum"))))


@query(
    "latest_temperature",
    """select user_id as device, cast(trunc(arg_max(value, ts)) as bigint) as temp,
      cast(arg_max(event_id, ts) % 101 as bigint) as hum from events group by user_id""",
)
def latest_temperature(spark, folder):
    events = tables.table(spark, folder, "events")
    text = F.format_string("%d %d", F.col("value").cast("long"), F.col("event_id") % 101)
    read = events.select(F.col("user_id").alias("device"), "ts", signals.parse_temp_hum(text).alias("v"))
    return rounded(signals.latest(read, ["device"], "v").select("device", "v.temp", "v.hum"))


@query(
    "slow_sensor_periods",
    """select user_id, epoch_us(ts) // 21600000000 as period, min(ts) as ts, arg_min(event_id, ts) as event_id
    from events group by all""",
)
def slow_sensor_periods(spark, folder):
    events = tables.table(spark, folder, "events").select("user_id", "ts", "event_id")
    return signals.first_per_period(events, ["user_id"], seconds=21600)


@query(
    "slow_sensor_greedy",
    """with recursive kept as (
      select user_id, min(ts) as ts from events group by user_id
      union all
      select k.user_id, (select min(e.ts) from events e
        where e.user_id = k.user_id and e.ts > k.ts + interval 6 hour) as ts
      from kept k where k.ts is not null)
    select event_id, e.user_id, e.ts from kept k join events e on e.user_id = k.user_id and e.ts = k.ts""",
)
def slow_sensor_greedy(spark, folder):
    events = tables.table(spark, folder, "events").select("event_id", "user_id", "ts")
    return signals.thin_by_gap(events, "user_id", seconds=21600, slice_seconds=2 * 86400)


@query(
    "class_names",
    f"""with {IMU}, names as (select * from (values (1, 'Working at Computer'),
      (2, 'Standing Up, Walking and Going up\\down stairs'), (3, 'Standing'), (4, 'Walking'),
      (5, 'Going Up\\Down Stairs'), (6, 'Walking and Talking with Someone'),
      (7, 'Talking while Standing')) t(label, name))
    select session_id, seq, cast(imu.label as bigint) as label, name from imu left join names using (label)""",
)
def class_names(spark, folder):
    rows = tables.imu(spark, folder).select("session_id", "seq", "label")
    return rounded(signals.with_label_name(rows, signals.labels_dim(spark)))
