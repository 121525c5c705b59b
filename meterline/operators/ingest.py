"""From trace rows to messages, and from messages to the landing table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions import values as V
from meterline.schemas import LANDING, MESSAGE_KEY

BATCH_ROWS = 5000
PARTITION_BITS, TOPIC_BITS = 20, 6
SOURCE_BITS = PARTITION_BITS + TOPIC_BITS
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSSxxx"
JSON_OF = f"to_json({{}}, map('ignoreNullFields', 'false', 'timestampFormat', '{TIME_FORMAT}'))"


def require_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"the trace lacks its time column {name}; its columns are {', '.join(df.columns)}")


def prepare_trace(trace: DataFrame, time_col: str = "arrival_timestamp", ordered: bool = True) -> DataFrame:
    """Time column coerced to a timestamp, rows without one dropped, sorted by time."""
    require_column(trace, time_col)
    is_text = dict(trace.dtypes)[time_col] == "string"
    ts = V.to_time(time_col) if is_text else f"CAST({time_col} AS TIMESTAMP)"
    timed = trace.withColumn(time_col, F.expr(ts)).where(f"{time_col} IS NOT NULL")
    return timed.orderBy(time_col) if ordered else timed


def encode_messages(rows: DataFrame, key_col: str = "query_id", left_out: tuple[str, ...] = (), keep: bool = False) -> DataFrame:
    """``key`` (text of the id, NULL if missing) and ``value`` (the row as one JSON object, without ``left_out`` columns).

    ``keep`` keeps the row's own columns beside them.
    """
    fields = ", ".join(f"`{c}`" for c in rows.columns if c not in left_out)
    pair = [f"CAST({key_col} AS STRING) AS key", f"{JSON_OF.format(f'struct({fields})')} AS value"]
    return rows.selectExpr(*(["*"] if keep else []), *pair)


# Blanks of JSON, and how a message says that it may hold a number that is not finite.
_BLANKS = " \\t\\n\\r"
_MAYBE_NONFINITE = " OR ".join([*(f"contains(value, '{t}')" for t in ("NaN", "Inf", "INF")), "value RLIKE '[eE][+]?[0-9]{3}'"])
# A token outside of strings that reads as not finite, and all that may stand before the next one.
_NONFINITE = "[+-]?(?:NaN|Infinity|INF)|-?[0-9][0-9.]*[eE][+]?0*(?:309|3[1-9][0-9]|[4-9][0-9]{2}|[0-9]{4,})(?![0-9])"
_FINITE = (
    """[^"NI0-9+-]++|"(?:[^"\\\\\\\\]++|\\\\\\\\.)*+"|"""
    f"(?!{_NONFINITE})(?:[+-]?[0-9][0-9.]*+(?:[eE][+-]?[0-9]++)?+|[+-])"
)
_EMPTY = f"^[{_BLANKS}]*[{{][{_BLANKS}]*[}}]$"
_ENDED = f"CASE WHEN endswith(value, '}}') THEN value ELSE TRIM(TRAILING '{_BLANKS}' FROM value) END"
FINITE_TEXT = f"""CASE WHEN {_MAYBE_NONFINITE}
    THEN regexp_replace(value, '\\\\G((?:{_FINITE})*+)(?:{_NONFINITE})', '$1null') ELSE value END"""
STAMP = f"date_format(current_timestamp(), '{TIME_FORMAT}')"


def _event(columns: list[str]) -> str:
    """The message's object with its origin added, as a variant; anything but one JSON object gives no stamp.

    The origin takes the place of the text's last brace, so one parse reads and adds. The parser stops behind the first
    value of a text: unless that is the whole text, it has not seen this run's stamp.
    """
    have = {c: c if c in columns else "NULL" for c in ("topic", "partition", "offset", "key")}
    origin = f"""named_struct('_ingest_ts_utc', {STAMP}, '_kafka_topic', {have["topic"]}, '_kafka_partition', CAST({have["partition"]} AS INT),
        '_kafka_offset', CAST({have["offset"]} AS BIGINT), '_kafka_key', CAST({have["key"]} AS STRING))"""
    own = JSON_OF.format(origin)
    return f"""CASE WHEN endswith(_text, '}}') THEN try_parse_json(CASE WHEN _text RLIKE '{_EMPTY}' THEN {own}
        ELSE concat(left(_text, length(_text) - 1), ',', substr({own}, 2)) END) END"""


_WHOLE = f"try_variant_get(event, '$._ingest_ts_utc', 'string') = {STAMP}"


def decode_messages(messages: DataFrame) -> DataFrame:
    """Adds ``event``: the message as a VARIANT, NULL unless the value is one JSON object.

    Values keep their JSON types at any depth. NaN and infinities, which JSON does not know, become null; of repeated
    names the last one counts (``spark.sql.variant.allowDuplicateKeys`` is set in the session for that). The time of
    ingest and the origin are fields of the event, under ``_``-prefixed names. Rejects keep their row; see
    :func:`accepted` and :func:`rejected`.
    """
    messages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = messages.withColumn("value", F.col("value").cast("string")).selectExpr("*", f"{FINITE_TEXT} AS _finite")
    ended = text.selectExpr(*messages.columns, f"{_ENDED.replace('value', '_finite')} AS _text")
    parsed = ended.selectExpr(*messages.columns, f"{_event(messages.columns)} AS event")
    return parsed.selectExpr(*messages.columns, f"CASE WHEN {_WHOLE} THEN event END AS event")


def accepted(decoded: DataFrame) -> DataFrame:
    """Messages with an event.

    A filter on ``event`` would be pushed below the projection and parse every message twice; an empty list of events
    yields no row instead.
    """
    names = [c for c in decoded.columns if c != "event"]
    return decoded.selectExpr(*names, "explode(CASE WHEN event IS NOT NULL THEN array(event) END) AS event")


def rejected(decoded: DataFrame) -> DataFrame:
    return decoded.where("event IS NULL").drop("event")


def sanitize_nonfinite(df: DataFrame) -> DataFrame:
    """Typed form: NaN and infinities to NULL in every column, at any depth."""
    return df.select(*[V.sanitize(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def land(messages: DataFrame, id_expr: str | None = None) -> DataFrame:
    """Messages -> landing rows of the decodable ones. ``id_expr`` defaults to :func:`arrival_id`."""
    return land_decoded(decode_messages(messages), id_expr)


def land_decoded(decoded: DataFrame, id_expr: str | None = None) -> DataFrame:
    """Landing rows of messages that are decoded already: the event, its ingest time and its origin."""
    return accepted(decoded).selectExpr(
        f"CAST({id_expr or arrival_id()} AS BIGINT) AS id",
        "event",
        "current_timestamp() AS ingest_ts",
        "topic AS kafka_topic",
        "CAST(coalesce(partition, 0) AS INT) AS kafka_partition",
        "CAST(coalesce(offset, 0) AS BIGINT) AS kafka_offset",
        "CAST(key AS STRING) AS kafka_key",
    )


def arrival_id(partition_bits: int = PARTITION_BITS, topics: tuple[str, ...] = ()) -> str:
    """A stable id from (topic, partition, offset): the same message gets the same id on every replay.

    Offsets take the high bits, so ids of one source grow with its offsets; the low ``partition_bits`` + TOPIC_BITS
    name the source and are what progress is kept by. ``topics`` numbers the topics of a landing table that holds
    several. A partition, offset or topic that does not fit raises, rather than taking the id of another message.
    """
    bits = partition_bits + TOPIC_BITS
    name = "coalesce(topic, '')"
    listed = ", ".join(f"'{t}'" for t in topics)
    topic = f"CAST(array_position(array({listed}), {name}) - 1 AS BIGINT)" if topics else "0L"
    part, place = "CAST(coalesce(partition, 0) AS BIGINT)", "CAST(coalesce(offset, 0) AS BIGINT)"
    fits = f"{part} BETWEEN 0 AND {(1 << partition_bits) - 1} AND {place} BETWEEN 0 AND {(1 << 63 - bits) - 1} AND {topic} BETWEEN 0 AND {(1 << TOPIC_BITS) - 1}"
    return f"""CASE WHEN {fits} THEN shiftleft({place}, {bits}) + shiftleft({topic}, {partition_bits}) + {part}
        ELSE CAST(raise_error('no id for this topic, partition and offset') AS BIGINT) END"""


def first_deliveries(batch: DataFrame, landed: DataFrame, key: list[str] = MESSAGE_KEY) -> DataFrame:
    """Rows of a batch that were not landed before, once each."""
    return batch.dropDuplicates(key).join(landed.select(*key), key, "left_anti")


def idempotent_append(batch: DataFrame, landed: DataFrame) -> DataFrame:
    """The landing table after the batch; applying it twice changes nothing."""
    names = [f.name for f in LANDING.fields if f.name in landed.columns]
    return landed.select(*names).unionByName(first_deliveries(batch, landed).select(*names))


def read_since(rows: DataFrame, last: int, limit: int = BATCH_ROWS, id_col: str = "id") -> DataFrame:
    """The next batch in id order. Spark keeps ``limit`` rows per task, never a global sort."""
    return rows.where(f"{id_col} > {last}").orderBy(id_col).limit(limit)
