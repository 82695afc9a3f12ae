"""Operators with state of their own: pairing by arrival, gating by event time, device state that expires.

They run on ``transformWithState``, whose state lives in RocksDB on the
executors and in the checkpoint folder: it may outgrow memory and survives lost
executors.  A session that runs them needs the RocksDB state store;
``with_state_store`` sets it.

What a trigger brings of one key is put in order in memory, so a source needs a
rate limit; the readers of ``live`` set one.  A backlog is then worked off in
as many triggers as it takes, with the same result.
"""

from pyspark.sql import Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from kinetable.operators import align
from kinetable.schema import BATCH_TYPE

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark):
    """Let the session keep the state of its streams in RocksDB."""
    spark.conf.set(STORE, ROCKSDB)
    return spark


# ---------------------------------------------------------- pairing by arrival


#: Groups that sessions are dealt to, and waiting messages kept beside a session's counters.
GROUPS = 4096
AT_HAND = 8
NAN = float("nan")


class FifoPairing(StatefulProcessor):
    """Three queues of every session of a group: the n-th messages of the topics leave together.

    A session's counters of arrivals and its first few waiting messages are one
    entry of a map, read and written once a trigger.  Further messages wait in
    a map of their own by topic and number, where a message is written once and
    read once however long its queue is.
    """

    def __init__(self, topics, key, kind):
        self.topics, self.key, self.kind = topics, key, kind

    def init(self, handle):
        message = "at: bigint, offset: bigint, payload: string"
        counts = ", ".join(f"n{i} long" for i in range(len(self.topics)))
        self.known = handle.getMapState("known", f"id {self.kind}", f"{counts}, near array<struct<topic: bigint, n: bigint, {message}>>")
        self.queue = handle.getMapState("queue", f"id {self.kind}, topic long, n long", message.replace(":", ""))

    def handleInputRows(self, key, rows, timerValues):
        sessions = {}
        for row in rows:
            session = row["id"] if row["id"] == row["id"] else NAN  # one key for all that are not a number
            sessions.setdefault(session, []).append((row["offset"], row["at"], row["topic"], row["payload"]))
        for session, messages in sessions.items():
            yield from self.paired(session, messages)

    def paired(self, session, messages):
        known = self.known.getValue((session,))
        counts, near = (list(known[:-1]), known[-1]) if known else ([0] * len(self.topics), ())
        waiting = {(i, n): tuple(message) for i, n, *message in near}
        stored = set(waiting)
        for offset, at, topic, payload in sorted(messages, key=lambda m: m[:2]):
            i = self.topics.index(topic)
            n = counts[i]
            waiting[i, n] = (at, offset, payload)
            counts[i] += 1
            if min(counts) > n:  # the last of its number to arrive
                yield self.joined(session, n, [self.taken(session, j, n, waiting) for j in range(len(self.topics))])
        # What leaves first stays near; only messages of this trigger can be too many.
        first = sorted(waiting, key=lambda w: (w not in stored, w[1]))
        for i, n in first[AT_HAND:]:
            self.queue.updateValue((session, i, n), waiting[i, n])
        self.known.updateValue((session,), (*counts, [(*w, *waiting[w]) for w in first[:AT_HAND]]))

    def taken(self, session, topic, n, waiting):
        found = waiting.pop((topic, n), None)
        if found is None:
            found = self.queue.getValue((session, topic, n))
            self.queue.removeKey((session, topic, n))
        return found

    def joined(self, session, n, messages):
        values = {self.key: session, "ordinal": n}
        for i, (at, offset, payload) in enumerate(messages):
            values |= {f"at{i}": at, f"offset{i}": offset, f"payload{i}": payload}
        return Row(**values)

    def close(self):
        pass


def pair_by_arrival(messages, session="session_id", topic="topic", order="offset", ts="ts", payload="payload", groups=GROUPS):
    """First-in-first-out pairing of three topic queues, for streams.

    The n-th message that arrived on a topic pairs with the n-th of the others,
    however far apart they come; a message waits in state for as long as its
    partners are missing.  ``order`` numbers the messages of a topic as they
    arrived (gaps do not matter).  Returns ``session``, ``ordinal``, ``ts`` (of the
    first topic's message) and per topic its parsed rows and ``<topic>_<order>``.
    Messages of other topics are ignored; rows with a null session make one
    session of their own.

    Sessions are dealt to ``groups`` by a digest, since Spark's cost of a state
    key is many times that of a message; what a trigger brings of one group is in
    memory at once.  A stream keeps the number it was started with.
    """
    topics = list(align.TOPICS)
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    rows = messages.where(F.col(topic).isin(*topics)).select(
        F.pmod(F.xxhash64(session), F.lit(groups)).alias("_group"), F.col(session).alias("id"), F.col(topic).alias("topic"),
        F.col(order).cast("long").alias("offset"), F.timestamp_diff("MICROSECOND", zero, F.col(ts)).alias("at"),
        F.col(payload).cast("string").alias("payload"),
    )
    kind = dict(rows.dtypes)["id"]
    sides = ", ".join(f"at{i} long, offset{i} long, payload{i} string" for i in range(len(topics)))
    paired = rows.groupBy("_group").transformWithState(
        FifoPairing(topics, session, kind), f"{session} {kind}, ordinal long, {sides}", "append", "None"
    )
    parsed = [F.from_json(F.col(f"payload{i}"), BATCH_TYPE).alias(t) for i, t in enumerate(topics)]
    offsets = [F.col(f"offset{i}").alias(f"{t}_{order}") for i, t in enumerate(topics)]
    return paired.select(session, "ordinal", F.timestamp_add("MICROSECOND", "at0", zero).alias(ts), *parsed, *offsets)


# ------------------------------------------------------- gating by event time


class EventTimeGate(StatefulProcessor):
    """Samples and commands of one device wait in slices of time until the watermark has passed them."""

    def __init__(self, fields, step):
        self.fields, self.step = fields, step

    def init(self, handle):
        self.handle = handle
        kinds = [T.StructField("_us", T.LongType()), T.StructField("_cmd", T.StringType()), *self.fields]
        self.waiting = handle.getListState("waiting", T.StructType(kinds))
        self.running = handle.getValueState("running", "running boolean")

    def handleInputRows(self, key, rows, timerValues):
        names = [f.name for f in self.fields]
        found = [(row["_us"], row["_cmd"], *[row[n] for n in names]) for row in rows]
        self.waiting.appendList(found)
        self.wake(found)
        return iter(())

    def wake(self, events):
        """One timer, at the end of the first slice of these events: whoever wakes up decides all slices that are over."""
        self.handle.registerTimer((min(e[0] for e in events) // self.step + 1) * self.step // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000
        end = max(end, timerValues.getCurrentWatermarkInMs() * 1000 // self.step * self.step)
        due, later = [], []
        for event in self.waiting.get():
            (due if event[0] < end else later).append(event)
        if due:
            running = (self.running.get() or (False,))[0]
            for event in sorted(due, key=lambda e: (e[0], e[1] is None)):  # at equal times the command first
                if event[1] is not None:
                    running = event[1] == "start"
                elif running:
                    yield Row(**{f.name: v for f, v in zip(self.fields, event[2:])}, _us=event[0])
            self.running.update((running,))
            if later:
                self.waiting.put(later)
                self.wake(later)
            else:
                self.waiting.clear()

    def close(self):
        pass


def gate_by_event_time(samples, control, device="device", ts="ts", command="command", delay="10 seconds", step_seconds=1):
    """Samples taken while their device was started, by event time.

    Samples and commands may arrive in any order and in any trigger up to
    ``delay`` behind the newest event: they wait in state, and a slice of
    ``step_seconds`` of a device's time is decided as soon as the watermark has passed its end.
    So the answer does not depend on where triggers fall.  What arrives later
    than ``delay`` is dropped, by Spark's rule for late rows.  Events of the last
    ``delay`` of a stream stay in state until newer events come.  Null times
    are dropped, null devices are one device.
    """
    from kinetable.streaming.live import EPOCH, as_instant

    zero = F.lit(EPOCH).cast("timestamp_ntz")
    fields = [f for f in samples.schema.fields if f.name != ts]
    empty = {f.name: F.lit(None).cast(f.dataType) for f in fields}
    us = F.timestamp_diff("MICROSECOND", zero, F.col(ts))
    events = control.select(
        *[F.col(f.name) if f.name == device else empty[f.name].alias(f.name) for f in fields], us.alias("_us"),
        F.col(command).cast("string").alias("_cmd"), as_instant(F.col(ts)).alias("_at"),
    )
    taken = samples.select(*[f.name for f in fields], us.alias("_us"), F.lit(None).cast("string").alias("_cmd"), as_instant(F.col(ts)).alias("_at"))
    merged = taken.unionByName(events).where("_us is not null").withWatermark("_at", delay)
    schema = T.StructType([*fields, T.StructField("_us", T.LongType())])
    kept = merged.groupBy(device).transformWithState(EventTimeGate(fields, int(step_seconds * 1_000_000)), schema, "append", "EventTime")
    order = [F.timestamp_add("MICROSECOND", "_us", zero).alias(ts) if c == ts else F.col(c) for c in samples.columns]
    return kept.select(*order)


# --------------------------------------------------- device state that expires


class AdvertStatus(StatefulProcessor):
    """The field values of one device, each with the time it was last seen."""

    def __init__(self, ttl):
        self.ttl = ttl  # microseconds, or None

    def init(self, handle):
        self.handle = handle
        self.known = handle.getMapState("known", "kind int", "value binary, at long")
        self.last = handle.getValueState("last", "at long")

    def fresh(self, then, now):
        return self.ttl is None or now - then <= self.ttl

    def handleInputRows(self, key, rows, timerValues):
        seen, values = (self.last.get() or (None,))[0], {}
        for row in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            at, news = row["at"], False
            first = seen is None or not self.fresh(seen, at)
            for item in row["list"] or ():
                kind, value = int(item["type"]), bytes(item["value"])
                before = values[kind] if kind in values else self.known.getValue((kind,))
                news |= before is None or bytes(before[0]) != value or not self.fresh(before[1], at)
                values[kind] = (value, at)
            yield Row(seq=row["seq"], addr=key[0], status="new" if first else "update" if news else "old")
            seen = at
        for kind, value in values.items():
            self.known.updateValue((kind,), value)
        self.last.update((seen,))
        if self.ttl is not None:
            self.handle.registerTimer((seen + self.ttl) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Let go of what the time to live has passed; decisions do not depend on when this happens."""
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        seen = self.last.get()
        if seen and not self.fresh(seen[0], now):
            self.known.clear()
            self.last.clear()
        else:
            for kind in [k for k, (_, at) in self.known.iterator() if not self.fresh(at, now)]:
                self.known.removeKey(kind)
        return iter(())

    def close(self):
        pass


def advert_status_stream(fields, addr="addr", seq="seq", ts=None, ttl_seconds=None, delay="0 seconds"):
    """Every advert as new, update or old, from the field values last seen of its device.

    ``fields`` has one row per advert: device, order and ``list``, its parsed
    fields (null: none).  State is a map from field to value per device.  With
    ``ts`` and ``ttl_seconds`` a field counts as unknown when it was not seen for so
    long before the advert, and a device as new when it was not; timers let go
    of such state once the watermark has passed it, so state follows the
    devices around and not all that were ever met.  Adverts go by (``ts``, ``seq``)
    within a trigger, and later triggers follow; those more than ``delay``
    behind the newest are dropped, by Spark's rule for late rows.
    """
    from kinetable.streaming.live import EPOCH, as_instant

    kinds, timed = dict(fields.dtypes), ts is not None and ttl_seconds is not None
    zero = F.lit(EPOCH).cast("timestamp_ntz")
    at = F.timestamp_diff("MICROSECOND", zero, F.col(ts)) if timed else F.lit(0).cast("long")
    clock = [as_instant(F.col(ts)).alias("_at")] if timed else []
    rows = fields.select(F.col(addr).alias("addr"), F.col(seq).alias("seq"), "list", at.alias("at"), *clock)
    if timed:
        rows = rows.where("at is not null").withWatermark("_at", delay)
    found = rows.groupBy("addr").transformWithState(
        AdvertStatus(int(ttl_seconds * 1_000_000) if timed else None), f"seq {kinds[seq]}, addr {kinds[addr]}, status string",
        "append", "EventTime" if timed else "None",
    )
    return found.select(F.col("seq").alias(seq), F.col("addr").alias(addr), "status")
