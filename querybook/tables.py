"""The given tables seen as the library's inputs.

No given table is a log, so events become log lines and operator commands, customers become sources
and orders become tail jobs. The mapping covers every row of the tables it reads: events are read once
as lines, all of them, and once as commands, where errors have no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions.identity import fingerprint_of, incident_id
from emberline.plans.pipeline import Settings, events_of, staged_anomalies
from emberline.session import stage

WINDOW = 86_400
THRESHOLD = 5
LATE_EVERY = 97
SETTINGS = Settings(window_seconds=WINDOW, threshold=THRESHOLD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _module() -> Column:
    return F.when(F.col("value") < 15, "auth").when(F.col("value") < 60, "billing").otherwise("search")


def _text(*parts) -> Column:
    return F.concat(*[part if isinstance(part, Column) else F.lit(part) for part in parts])


def lines_of_events(events: DataFrame) -> DataFrame:
    """One to three log lines per event. Works on batch and streaming frames."""
    user = F.col("user_id").cast("string")
    arrived = F.col("ts").cast("timestamp")
    # every so many events the line tells of something three days back
    at = F.when(F.col("event_id") % LATE_EVERY == 0, arrived - F.expr("interval 3 days")).otherwise(arrived)
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    code = (F.col("event_id") % 90 + 10).cast("string")
    error = F.array(
        _text(
            F.date_format(at, "yyyy-MM-dd HH:mm:ss,SSS"), " ERROR [", _module(), "] request failed user=", user
        ),
        _text("    at app.", _module(), ".Handler.run(Handler.java:", code, ")"),
        _text("Caused by: java.lang.IllegalStateException: code ", user),
    )
    purchase = F.array(
        _text(
            '{"@timestamp":"',
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"),
            '+00:00","severity":"warning","msg":"payment slow","user":',
            user,
            "}",
        )
    )
    click = F.array(_text('{"ts":"', iso, 'Z","msg":"INFO page served","user":', user, "}"))
    later = F.date_format(at + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss")
    view = F.array(_text(later, "+02:00 WARN cache miss user=", user), F.lit("   "))
    high, low = F.floor(F.col("user_id") / 256).cast("string"), (F.col("user_id") % 256).cast("string")
    signup = F.array(_text("user ", user, " signed up from 10.0.", high, ".", low), F.lit(""))
    kind = F.col("event_type")
    lines = (
        F.when(kind == "error", error)
        .when(kind == "purchase", purchase)
        .when(kind == "click", click)
        .when(kind == "view", view)
        .otherwise(signup)
    )
    numbered = events.select(
        "event_id", "user_id", "event_type", arrived.alias("at"), F.posexplode(lines).alias("n", "line")
    )
    delay = F.lit(1_000_000) + F.col("n") * (F.col("event_id") % 4) * 300_000
    return numbered.select(
        F.lit("DOCKER").alias("source_type"),
        _text("c-", F.col("user_id").cast("string")).alias("source_id"),
        F.when(
            F.col("user_id") % 2 == 0, _text("Customer#", F.lpad(F.col("user_id").cast("string"), 9, "0"))
        ).alias("source_name"),
        F.timestamp_micros(F.unix_micros("at") + delay).alias("received_at"),
        (F.col("event_type") == "error").alias("stderr"),
        "line",
        (F.col("event_id") * 10 + F.col("n")).alias("seq"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of_events(table(spark, sf_dir, "events"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(events_of(log_lines(spark, sf_dir), SETTINGS), "events")


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_anomalies(log_lines(spark, sf_dir), SETTINGS)


def commands_of_events(events: DataFrame) -> DataFrame:
    """An operator command for every event that is not an error; errors are read as log lines only."""
    kind = F.col("event_type")
    value = F.col("value")
    source = _text("c-", F.col("user_id").cast("string"))
    shape = (
        "2024-01-01 00:00:00,000 ERROR [{0}] request failed user=1\n    at app.{0}.Handler.run(Handler.java:1)\n"
        "Caused by: java.lang.IllegalStateException: code 1"
    )
    target = {name: fingerprint_of(F.lit(shape.format(name))) for name in ("auth", "billing", "search")}
    fingerprint = (
        F.when(_module() == "auth", target["auth"])
        .when(_module() == "billing", target["billing"])
        .otherwise(target["search"])
    )
    event = F.col("event_id").cast("string")
    base = events.where(kind != "error").select(
        "event_id",
        "event_type",
        "value",
        F.col("ts").cast("timestamp").alias("ts"),
        source.alias("source_id"),
        fingerprint.alias("fingerprint"),
    )
    by_id_only = (kind == "view") & (value < 15)
    return base.select(
        F.when(kind == "signup", _text("missing-", event))
        .when((kind == "purchase") & (value >= 20) & (value < 60), _text("no-such-", event))
        .otherwise(incident_id("fingerprint", "source_id"))
        .alias("incident_id"),
        F.when(~by_id_only, F.col("fingerprint")).alias("fingerprint"),
        F.when(~by_id_only, F.col("source_id")).alias("source_id"),
        F.when(kind == "signup", "ACKNOWLEDGED")
        .when(kind == "view", "RESOLVED")
        .when(kind == "click", F.when(value < 20, "CLOSED").otherwise("SUPPRESSED"))
        .otherwise(
            F.when(value < 20, "REGRESSED").when(value < 60, "RESOLVED").otherwise("COUNT_INCREASED")
        )
        .alias("type"),
        F.when(kind == "signup", "runtime").otherwise("gui").alias("actor"),
        F.when(kind == "click", _text("  note ", event, " ")).when(kind == "view", "   ").alias("note"),
        "ts",
        (F.col("event_id") * 10).alias("seq"),
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands_of_events(table(spark, sf_dir, "events"))


def with_given_summaries(found: DataFrame, events: DataFrame) -> DataFrame:
    """Anomalies with the summary an analyst or model gave; every third has none."""
    severity = F.when(F.col("value") < 30, "LOW").when(F.col("value") < 60, "MEDIUM").otherwise("HIGH")
    event = F.col("event_id").cast("string")
    given = events.select(
        F.col("event_id").alias("_event"),
        F.when(
            F.col("event_id") % 3 != 0,
            F.struct(
                _text("Failure in ", _module()).alias("title"),
                _text("Request failed & was <retried>, event ", event).alias("summary"),
                _text("Overload of ", _module(), "\nafter event ", event).alias("probable_cause"),
                F.lit("Check 'limits'").alias("suggested_actions"),
                severity.alias("severity"),
            ),
        ).alias("summary"),
    )
    return (
        found.withColumn("_event", F.floor(F.col("seq") / 10).cast("bigint"))
        .join(given, "_event", "left")
        .drop("_event")
    )


def summarised(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    return stage(with_given_summaries(found, table(spark, sf_dir, "events")), "summarised")


def summarised_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarised(spark, sf_dir, anomalies(spark, sf_dir))


def responses(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """Model answers per anomaly: text, blank text, a failed call, or none."""
    event = F.floor(F.col("seq") / 10).cast("bigint")
    rest = event % 4
    return found.where(rest != 0).select(
        "fingerprint",
        "source_id",
        "seq",
        F.when(rest == 1, F.lit("  ")).when(rest == 2, _text("Answer for ", event.cast("string"))).alias("response"),
        F.when(rest == 3, F.lit("TimeoutException")).alias("error"),
    )


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as containers with the raw fields a runtime reports."""
    account = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        _text("  ", F.col("c_mktsegment"), " ").alias("runtime_key"),
        _text("c-", F.col("c_custkey").cast("string")).alias("id"),
        F.when(account < 0, F.expr("cast(array() as array<string>)"))
        .otherwise(F.array("c_name", "c_mktsegment"))
        .alias("names"),
        F.when(account < 0, F.lit(" "))
        .when(account < 5000, _text("Up ", F.floor(account).cast("string"), " minutes, health check pending"))
        .otherwise(F.lit("running"))
        .alias("status"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.operators.dashboard import list_sources

    return list_sources(containers(spark, sf_dir))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with lines as tail jobs: the parts on their lines are the containers tailed.

    An order has a handful of lines, so the arrays are small.
    """
    parts = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("l_linenumber", "l_partkey", (F.col("l_linestatus") == "F").alias("done"))
                )
            ).alias("parts")
        )
    )
    owner = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.lower("c_mktsegment").alias("runtime_key")
    )
    return (
        table(spark, sf_dir, "orders")
        .join(parts, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(owner, "o_custkey")
        .select(
            F.col("o_orderkey").alias("id"),
            "runtime_key",
            F.when(F.size("parts") > 1, "tail-all").otherwise("tail-one").alias("command"),
            F.transform("parts", lambda part: _text("c-", part["l_partkey"].cast("string"))).alias("source_ids"),
            F.transform("parts", lambda part: part["done"]).alias("disposed"),
            F.col("o_orderdate").cast("timestamp").alias("started_at"),
        )
    )


def shown(frame: DataFrame) -> DataFrame:
    """Timestamps as text and counts as bigint, the same in every engine."""
    columns = []
    for field in frame.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, "|")
        columns.append(column.alias(field.name))
    return frame.select(*columns)
