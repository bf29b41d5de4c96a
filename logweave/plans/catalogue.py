"""Queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow, offsets, partitioning as P, ranges as R, weigher as W
from ..sources.records import events_log, serialized_size
from ..streaming.config import TRANSITIONS, terminal

NOW, TIMEOUT = "2024-06-01 00:00:00", "30 DAYS"

LEDGER = """SELECT topic, part, off, ts, key, value, ok FROM (
  SELECT event_type AS topic, (user_id % 4)::INT AS part, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) - 1 AS off, event_id, ts,
    user_id::VARCHAR AS key, props AS value, event_id % 7 <> 0 AS ok FROM events)"""
RANGES = "SELECT topic, part, min(off) AS lower, max(off) AS upper FROM (SELECT topic, part, off, off - row_number() OVER (PARTITION BY topic, part ORDER BY off) AS g FROM {src}) GROUP BY topic, part, g"
COMMIT = "SELECT topic, part, max(off) + 1 AS commit_offset FROM (SELECT topic, part, off, min(ok::INT) OVER (PARTITION BY topic, part ORDER BY off) AS m FROM ledger) WHERE m = 1 GROUP BY topic, part"
SUB = "(row_number() OVER (PARTITION BY topic, part ORDER BY off) - 1) % 3"


def sql(body: str, **ctes: str) -> str:
    return "WITH ledger AS (" + LEDGER + ")" + "".join(f", {k} AS ({v})" for k, v in ctes.items()) + " " + body


def ledger(s, d):
    return events_log(s, d)


def ok_ranges(s, d):
    return R.from_offsets(ledger(s, d).where("ok"))


def sub(s, d):
    return P.assign_subpartitions(ledger(s, d), P.RoundRobin(3))


def weighed(s, d):
    x = sub(s, d)
    return x.withColumn("weight", W.record(W.string(F.col("key")), W.string(F.col("value")), F.col("topic")))


def registered(s, d):
    """The sub-partitions of every partition, and those of one that has no records: their queues are empty."""
    idle = s.range(1).select(F.lit("idle").alias("topic"), F.col("id").cast("int").alias("part"))
    return P.enumerate_subpartitions(partitions(s, d).unionByName(idle), P.Partitioner(3))


def _pause_resume(s, d):
    """Every record, under a budget a tenth above the whole table's size, so that some queues are over their part at any size."""
    sizes = flow.queue_sizes(weighed(s, d), registered(s, d))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return flow.pause_resume(sizes, int(total) * 11 // 10)


def points(s, d):
    return ledger(s, d).select("topic", "part", F.col("off").alias("x"))


def partitions(s, d):
    return ledger(s, d).select("topic", "part").distinct()


def _transitions(s, d):
    rows = [(a.name if a else "", b.name, terminal(b)) for a, to in TRANSITIONS.items() for b in to]
    return s.createDataFrame(rows, "before string, after string, terminal boolean")


def _snapshots(s, d):
    return ledger(s, d).select("topic", "part", F.col("off").alias("at"), (F.col("off") * 7919 % 101).alias("ranges"))


def _query_ranges(s, d):
    return ledger(s, d).select("topic", "part", F.col("off").alias("lower"), (F.col("off") + 3).alias("upper"))


WEIGHT = "(160 + 32 + 8*ceil((16+length(key))/8.0) + 32 + 8*ceil((16+length(value))/8.0) + 32 + 8*ceil((16+length(topic))/8.0) + 40)::BIGINT"
CTE = {"r": RANGES.format(src="(SELECT * FROM ledger WHERE ok)"), "c": RANGES.format(src="ledger")}
PTS = "SELECT topic, part, off AS x FROM ledger"
SUBS = f"SELECT *, {SUB} AS subpartition, {WEIGHT} AS weight FROM ledger"
SIZES = "SELECT topic, part, subpartition, sum(weight)::BIGINT AS size FROM subs GROUP BY ALL"
QR = "SELECT topic, part, off AS lower, off + 3 AS upper FROM ledger"
MURMUR = """SELECT topic, part, off, ((xor(h3, h3 >> 15) & 2147483647) % 5)::INT AS subpartition FROM (SELECT *, (xor(h2, h2 >> 13) * 1540483477) & 4294967295 AS h3 FROM (
 SELECT *, CASE WHEN n % 4 = 0 THEN h1 ELSE (xor(h1, list_sum(list_transform(range(0, n % 4), lambda j: b[(n // 4) * 4 + j + 1] << (8 * j)::INT))::BIGINT) * 1540483477) & 4294967295 END AS h2 FROM (
 SELECT *, list_reduce(list_prepend(xor(2538058380::BIGINT, n), list_transform(range(0, n // 4), lambda i: b[i*4+1] + (b[i*4+2] << 8) + (b[i*4+3] << 16) + (b[i*4+4] << 24))),
  lambda h, k: xor((h * 1540483477) & 4294967295, (xor((k * 1540483477) & 4294967295, ((k * 1540483477) & 4294967295) >> 24) * 1540483477) & 4294967295)) AS h1 FROM (
 SELECT topic, part, off, length(s) AS n, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT) AS b FROM (SELECT *, key || ':' || part AS s FROM ledger)))))"""

_ALL = {
    "commit_offsets": (lambda s, d: offsets.commit_offsets(ledger(s, d)), sql(COMMIT)),
    "offset_ranges": (lambda s, d: R.from_offsets(ledger(s, d)), sql("SELECT * FROM c", **CTE)),
    "range_elements": (lambda s, d: R.elements(ok_ranges(s, d)), sql("SELECT topic, part, unnest(range(lower, upper + 1)) AS off FROM r", **CTE)),
    "range_elements_descending": (lambda s, d: R.elements(ok_ranges(s, d), True), sql("SELECT topic, part, pos::INT AS pos, upper - pos AS off FROM (SELECT *, unnest(range(0, upper - lower + 1)) AS pos FROM r)", **CTE)),
    "range_coalesce": (lambda s, d: R.coalesce(_query_ranges(s, d).unionByName(ok_ranges(s, d))), sql(RANGES.format(src="(SELECT DISTINCT topic, part, unnest(range(lower, upper + 1)) AS off FROM (SELECT * FROM q UNION ALL SELECT * FROM r))"), **CTE, q=QR)),
    "range_subtract": (lambda s, d: R.subtract(R.from_offsets(ledger(s, d)), ok_ranges(s, d)), sql(RANGES.format(src="(SELECT * FROM ledger WHERE NOT ok)"))),
    "range_truncate": (lambda s, d: R.truncate(ok_ranges(s, d), partitions(s, d).withColumn("max_element", F.lit(50).cast("long"))), sql("SELECT topic, part, greatest(lower, 51) AS lower, upper FROM r WHERE upper > 50", **CTE)),
    "range_floor": (lambda s, d: R.floor_range(ok_ranges(s, d), points(s, d)), sql("SELECT p.topic, p.part, x, lower, upper FROM p ASOF LEFT JOIN r ON p.topic = r.topic AND p.part = r.part AND x >= lower", **CTE, p=PTS)),
    "range_ceiling": (lambda s, d: R.ceiling_range(ok_ranges(s, d), points(s, d)), sql("SELECT p.topic, p.part, x, lower, upper FROM p ASOF LEFT JOIN r ON p.topic = r.topic AND p.part = r.part AND x <= lower", **CTE, p=PTS)),
    "floor_element": (lambda s, d: R.floor_element(ok_ranges(s, d), points(s, d)), sql("SELECT p.topic, p.part, x, CASE WHEN lower IS NOT NULL THEN least(x, upper) END AS element FROM p ASOF LEFT JOIN r ON p.topic = r.topic AND p.part = r.part AND x >= lower", **CTE, p=PTS)),
    "range_contains": (lambda s, d: R.contains(ok_ranges(s, d), points(s, d)), sql("SELECT topic, part, x, EXISTS (SELECT 1 FROM ledger l WHERE ok AND l.topic = p.topic AND l.part = p.part AND l.off = x) AS contained FROM p", p=PTS)),
    "range_overlap": (lambda s, d: R.min_existing(ok_ranges(s, d), _query_ranges(s, d)), sql("SELECT q.topic, q.part, lower, upper, min(off) AS existing FROM q LEFT JOIN (SELECT * FROM ledger WHERE ok) l ON l.topic = q.topic AND l.part = q.part AND off BETWEEN lower AND upper GROUP BY ALL", q=QR)),
    "range_encloses": (lambda s, d: R.encloses(ok_ranges(s, d), _query_ranges(s, d)), sql("SELECT q.topic, q.part, lower, upper, count(off) = 4 AS enclosed FROM q LEFT JOIN (SELECT * FROM ledger WHERE ok) l ON l.topic = q.topic AND l.part = q.part AND off BETWEEN lower AND upper GROUP BY ALL", q=QR)),
    "range_summary": (lambda s, d: R.summary(ok_ranges(s, d)), sql("SELECT topic, part, min(lower) AS first, max(upper) AS last, sum(upper - lower + 1)::BIGINT AS size, count(*) AS ranges FROM r GROUP BY ALL", **CTE)),
    "duplicate_consumed": (lambda s, d: offsets.duplicate_consumed(ok_ranges(s, d), _query_ranges(s, d)), sql("SELECT q.topic, q.part, lower, upper, min(off) AS existing, 'Offset: ' || min(off) || ' for partition: ' || q.topic || '-' || q.part || ' was consumed before' AS error FROM q JOIN (SELECT * FROM ledger WHERE ok) l ON l.topic = q.topic AND l.part = q.part AND off BETWEEN lower AND upper GROUP BY q.topic, q.part, lower, upper", q=QR)),
    "bad_processed": (lambda s, d: offsets.bad_processed(ledger(s, d).where("off % 13 <> 0"), (x := ledger(s, d).where("ok").select("topic", "part", "off")).unionByName(x.where("off % 17 = 0"))), sql("SELECT topic, part, off, CASE WHEN off % 17 = 0 THEN 'was processed before' ELSE 'was not consumed before' END AS error FROM ledger WHERE ok AND (off % 17 = 0 OR off % 13 = 0)")),
    "timed_out_heads": (lambda s, d: offsets.timed_out(ledger(s, d).withColumnRenamed("ts", "consumed_at"), F.lit(NOW).cast("timestamp_ntz"), TIMEOUT), sql(f"SELECT topic, part, off, ts AS consumed_at FROM (SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY off) AS n FROM ledger WHERE NOT ok) WHERE n = 1 AND ts < TIMESTAMP '{NOW}' - INTERVAL {TIMEOUT}")),
    "retained_after_commit": (lambda s, d: offsets.retained_after_commit(ledger(s, d)).select("topic", "part", "off", "ok"), sql("SELECT l.topic, l.part, off, ok FROM ledger l LEFT JOIN k ON l.topic = k.topic AND l.part = k.part WHERE commit_offset IS NULL OR off >= commit_offset", k=COMMIT)),
    "uncommitted_total": (lambda s, d: offsets.uncommitted_total(ledger(s, d)), sql("SELECT count(*) AS uncommitted FROM ledger l LEFT JOIN k ON l.topic = k.topic AND l.part = k.part WHERE ok AND (commit_offset IS NULL OR off >= commit_offset)", k=COMMIT)),
    "status_counts": (lambda s, d: offsets.status_counts(ledger(s, d)), sql("SELECT a.*, coalesce(processed_offsets, 0) AS processed_offsets, coalesce(processed_ranges, 0) AS processed_ranges FROM (SELECT topic, part, sum(upper - lower + 1)::BIGINT AS consumed_offsets, count(*) AS consumed_ranges FROM c GROUP BY ALL) a LEFT JOIN (SELECT topic, part, sum(upper - lower + 1)::BIGINT AS processed_offsets, count(*) AS processed_ranges FROM r GROUP BY ALL) b ON a.topic = b.topic AND a.part = b.part", **CTE)),
    "default_partition": (lambda s, d: P.assign_subpartitions(ledger(s, d), P.Partitioner()).groupBy("topic", "part", "subpartition").agg(F.count("*").alias("n")), sql("SELECT topic, part, 0 AS subpartition, count(*) AS n FROM ledger GROUP BY topic, part")),
    "round_robin": (lambda s, d: sub(s, d).select("topic", "part", "off", "subpartition"), sql(f"SELECT topic, part, off, ({SUB})::INT AS subpartition FROM ledger")),
    "murmur2_subpartition": (lambda s, d: P.assign_subpartitions(ledger(s, d), P.Murmur2(5)).select("topic", "part", "off", "subpartition"), sql(MURMUR)),
    "custom_partition": (lambda s, d: P.assign_subpartitions(ledger(s, d), P.Custom(4, hash_column=F.col("off") * 31)).select("topic", "part", "off", "subpartition"), sql("SELECT topic, part, off, (off * 31 % 4)::INT AS subpartition FROM ledger")),
    "enumerate_subpartitions": (lambda s, d: P.enumerate_subpartitions(partitions(s, d), P.Partitioner({("click", 1): 3}, 2)), sql("SELECT topic, part, unnest(range(0, CASE WHEN topic = 'click' AND part = 1 THEN 3 ELSE 2 END))::INT AS subpartition FROM (SELECT DISTINCT topic, part FROM ledger)")),
    "assign_threads": (lambda s, d: P.assign_threads(P.enumerate_subpartitions(partitions(s, d), P.Partitioner(3)), 7), sql("SELECT topic, part, s AS subpartition, ((row_number() OVER (ORDER BY topic, part, s) - 1) % 7)::INT AS thread FROM (SELECT topic, part, unnest(range(0, 3))::INT AS s FROM (SELECT DISTINCT topic, part FROM ledger))")),
    "tasks_per_thread": (lambda s, d: P.tasks_per_thread(P.enumerate_subpartitions(partitions(s, d), P.Partitioner(3)), 7), sql("SELECT thread, count(*) AS tasks FROM (SELECT ((row_number() OVER (ORDER BY topic, part, s) - 1) % 7)::INT AS thread FROM (SELECT topic, part, unnest(range(0, 3)) AS s FROM (SELECT DISTINCT topic, part FROM ledger))) GROUP BY thread")),
    "record_weight": (lambda s, d: weighed(s, d).select("topic", "part", "off", "weight"), sql("SELECT topic, part, off, weight FROM subs", subs=SUBS)),
    "queue_growth": (lambda s, d: flow.queue_growth(weighed(s, d)).select("topic", "part", "off", "size"), sql("SELECT topic, part, off, (sum(weight) OVER (PARTITION BY topic, part, subpartition ORDER BY off))::BIGINT AS size FROM subs", subs=SUBS)),
    "queue_sizes": (lambda s, d: flow.queue_sizes(weighed(s, d)), sql("SELECT topic, part, subpartition::INT AS subpartition, size FROM sz", subs=SUBS, sz=SIZES)),
    "pause_resume": (_pause_resume, sql("SELECT topic, part, max(size) AS largest, any_value(total) >= any_value(b) OR max(size) >= any_value(b) // any_value(n) AS pause, any_value(total) < any_value(b) AND max(size) <= floor((any_value(b) // any_value(n)) * 0.9) AS resume FROM (SELECT *, total * 11 // 10 AS b FROM (SELECT *, sum(size) OVER () AS total, count(*) OVER () AS n FROM (SELECT topic, part, sub, coalesce(size, 0)::BIGINT AS size FROM reg LEFT JOIN sz USING (topic, part, sub)))) GROUP BY topic, part", subs=SUBS, sz="SELECT topic, part, subpartition AS sub, sum(weight)::BIGINT AS size FROM subs GROUP BY ALL", reg="SELECT topic, part, unnest(range(0, 3)) AS sub FROM (SELECT DISTINCT topic, part FROM ledger UNION ALL SELECT 'idle', 0)")),
    "accepted_prefix": (lambda s, d: flow.accepted_prefix(sub(s, d), F.col("ok")).select("topic", "part", "off", "subpartition"), sql("SELECT topic, part, off, subpartition::INT AS subpartition FROM (SELECT *, min(ok::INT) OVER (PARTITION BY topic, part, subpartition ORDER BY off) AS m FROM subs) WHERE m = 1", subs=SUBS)),
    "time_merge": (lambda s, d: flow.time_merge(ledger(s, d), "click", "view").select("topic", "part", "off", "ts"), sql("SELECT topic, part, off, ts FROM (SELECT *, max(CASE WHEN topic = 'click' THEN ts END) OVER (PARTITION BY part) AS a, max(CASE WHEN topic = 'view' THEN ts END) OVER (PARTITION BY part) AS b FROM ledger WHERE topic IN ('click', 'view')) WHERE ts <= a AND ts <= b")),
    "guarantee_none": (lambda s, d: flow.apply_guarantee(ledger(s, d), "none").select("topic", "part", "off", "ok", "dead_letter"), sql("SELECT topic, part, off, true AS ok, NOT ok AS dead_letter FROM ledger")),
    "guarantee_at_least_once": (lambda s, d: flow.apply_guarantee(ledger(s, d), "at_least_once").select("topic", "part", "off", "ok", "dead_letter"), sql("SELECT topic, part, off, ok, false AS dead_letter FROM ledger")),
    "partition_gauges": (lambda s, d: flow.partition_gauges(x := ledger(s, d), offsets.commit_offsets(x)), sql("SELECT a.topic, a.part, consumed_offset, commit_offset AS committed_offset FROM (SELECT topic, part, max(off) AS consumed_offset FROM ledger GROUP BY ALL) a LEFT JOIN k ON a.topic = k.topic AND a.part = k.part", k=COMMIT)),
    "subpartition_gauges": (lambda s, d: flow.subpartition_gauges(sub(s, d)), sql("SELECT topic, part, subpartition::INT AS subpartition, max(off) AS accepted_offset, max(off) FILTER (WHERE ok) AS processed_offset FROM subs GROUP BY ALL", subs=SUBS)),
    "poll_stats": (lambda s, d: flow.poll_stats(ledger(s, d), F.floor(F.col("off") / 50).cast("int"), serialized_size().cast("long")), sql("SELECT (off // 50)::INT AS poll, count(*) AS records, sum(z)::BIGINT AS bytes, min(z) AS min_size, max(z) AS max_size, avg(z) AS avg_size FROM (SELECT off, octet_length(encode(key)) + octet_length(encode(value)) AS z FROM ledger) GROUP BY 1")),
    "worst_snapshot": (lambda s, d: flow.worst_snapshot(_snapshots(s, d)), sql("SELECT topic, part, \"at\", ranges FROM (SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY ranges DESC, \"at\" DESC) AS m FROM (SELECT topic, part, off AS \"at\", off * 7919 % 101 AS ranges, row_number() OVER (PARTITION BY topic, part ORDER BY off DESC) AS n FROM ledger) WHERE n <= 100) WHERE m = 1")),
    "status_transitions": (_transitions, "SELECT * FROM (VALUES ('', 'CREATED', false), ('CREATED', 'STARTING', false), ('STARTING', 'STARTED', false), ('STARTED', 'SHUTDOWN', false), ('SHUTDOWN', 'CLOSING', false), ('CLOSING', 'CLOSED_GRACEFULLY', true), ('CLOSING', 'CLOSED_NOT_GRACEFULLY', true), ('CLOSING', 'CANNOT_STOP_THREADS', true), ('CLOSING', 'CLOSING_INTERRUPTED', true)) t(before, after, terminal)"),
}


def queries():
    return {k: q for k, (q, _) in _ALL.items()}


def oracle_sql():
    return {k: s for k, (_, s) in _ALL.items()}
