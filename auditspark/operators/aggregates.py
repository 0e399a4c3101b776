"""Search summaries, time histograms and activity comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.facts import with_facts
from ..functions.records import has_error
from ..functions.times import BUCKET_ORIGIN_S
from ..model import Filter
from .search import FACET_FIELDS, apply_filter, field_column

FACET_LIMIT = 25
GROUP_LIMIT = 50
BREAKDOWN_LIMIT = 10
LATEST_LIMIT = 25
# Dimensions of the period comparison and window lengths in hours.
DIMENSIONS = ("identityArn", "roleArn", "accountId", "recipientAccountId", "eventSource", "eventName",
              "sourceIPAddress", "awsRegion")
WINDOW_HOURS = (1, 24, 168)
# Bucket widths of the dense histogram, milliseconds.
NICE_STEPS_MS = (1_000, 5_000, 10_000, 30_000, 60_000, 300_000, 600_000, 1_800_000, 3_600_000)


def _nz(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _error_code() -> Column:
    return F.coalesce("errorCode", F.lit("")) != ""


def top_rows(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group.

    A lone row_number filter lets Spark keep at most ``n`` rows per group in
    every map task before the exchange (WindowGroupLimit), so a group that holds
    most of the table still ships only ``n`` rows per task.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def stats(events: DataFrame, f: Filter | None = None, approximate: bool = False) -> DataFrame:
    """Headline numbers of a search, one row.  ``approximate`` opts into sketches."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return apply_filter(events, f).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_error_code()).alias("errors"),
        distinct(F.coalesce(_nz("identityArn"), _nz("userName"), _nz("principalId"))).alias("principals"),
        distinct(_nz("eventSource")).alias("sources"),
        distinct(_nz("awsRegion")).alias("regions"),
        F.coalesce(F.min("eventMs"), F.lit(0)).alias("minMs"),
        F.coalesce(F.max("eventMs"), F.lit(0)).alias("maxMs"),
    )


def facets(events: DataFrame, f: Filter | None = None, fields: tuple[str, ...] = FACET_FIELDS,
           limit: int = FACET_LIMIT) -> DataFrame:
    """Value counts of several fields in one scan, with whole-field totals.

    Rows are unpivoted to (field, value) and counted map-side before the only
    wide exchange; totals see all values, the listing the first ``limit``.
    """
    long = apply_filter(events, f).select(*[field_column(name).alias(name) for name in fields]) \
        .unpivot([], list(fields), "field", "value")
    counted = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = counted.groupBy("field").agg(
        F.coalesce(F.sum(F.when(F.col("value") != "", F.col("count"))), F.lit(0)).alias("present"),
        F.coalesce(F.sum(F.when(F.col("value") == "", F.col("count"))), F.lit(0)).alias("missing"),
        F.count_if(F.col("value") != "").alias("distinctValues"))
    top = top_rows(counted, ["field"], [(F.col("value") == "").asc(), F.col("count").desc(), F.col("value").asc()], limit)
    # totals has one row per listed field
    return top.join(F.broadcast(totals), "field").withColumn("truncated", F.col("distinctValues") > limit) \
        .filter((F.col("value") != "") | (F.col("distinctValues") == 0))


def histogram(events: DataFrame, f: Filter | None = None) -> DataFrame:
    """Sparse time histogram, about 120 buckets of at least one minute.

    The span is a scalar subquery of the same filtered rows: nothing is
    collected and the bucket width is a constant inside the main job.
    """
    rows = apply_filter(events, f).filter(F.col("eventMs").isNotNull()).select("eventMs", "errorCode")
    span_s = F.floor((F.max("eventMs") - F.min("eventMs")) / 1000)
    step_ms = rows.agg((F.greatest(F.lit(60), F.floor(span_s / 120)) * 1000).alias("step")).scalar()
    origin = F.lit(BUCKET_ORIGIN_S * 1000)
    bucketed = rows.withColumn("step", step_ms).withColumn(
        "t", F.floor((F.col("eventMs") - origin) / F.col("step")) * F.col("step") + origin)
    return bucketed.groupBy("t").agg(
        F.max("step").alias("step"), F.count(F.lit(1)).alias("n"), F.count_if(_error_code()).alias("e"))


def _axis(bounds: DataFrame) -> DataFrame:
    """(step, start) of every bucket; the one row of bounds is read first, so that the axis is a distributed range."""
    row = bounds.first()
    if row is None:
        return bounds.select("step", "start").limit(0)
    return bounds.sparkSession.range(row["start"], row["stop"], row["step"]).select(F.lit(row["step"]).alias("step"), F.col("id").alias("start"))


def dense_histogram(events: DataFrame, now_ms: int | None = None, f: Filter | None = None) -> DataFrame:
    """Zero-filled histogram with a rounded step, extended to ``now_ms``; late rows fall in the last bucket."""
    rows = apply_filter(events, f).filter(F.col("eventMs").isNotNull()).select("eventMs", "errorCode")
    high = F.greatest(F.max("eventMs"), F.lit(now_ms)) if now_ms is not None else F.max("eventMs")
    ideal = F.greatest(F.col("hi") - F.col("lo"), F.lit(1000)) / 60
    step = F.coalesce(*[F.when(F.lit(s) >= ideal, F.lit(s)) for s in NICE_STEPS_MS], F.lit(NICE_STEPS_MS[-1])).cast("long")
    bounds = rows.agg(F.min("eventMs").alias("lo"), high.alias("hi")).filter(F.col("lo").isNotNull()) \
        .withColumn("step", step) \
        .withColumn("start", F.floor(F.col("lo") / F.col("step")) * F.col("step")) \
        .withColumn("stop", F.greatest(F.ceil(F.col("hi") / F.col("step")) * F.col("step"), F.col("start") + F.col("step")))
    axis = _axis(bounds)
    shape = bounds.select(F.struct("start", "step", "stop").alias("b")).scalar()
    index = F.least(F.floor(F.col("eventMs") / F.col("b.step")) * F.col("b.step"), F.col("b.stop") - F.col("b.step"))
    counted = rows.withColumn("b", shape).withColumn("start", index).groupBy("start").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_error_code()).alias("errors"))
    return axis.join(counted, "start", "left").select(
        "start", (F.col("start") + F.col("step")).alias("end"), "step",
        F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("errors", F.lit(0)).alias("errors"))


def _scoped(events: DataFrame, f: Filter | None) -> DataFrame:
    return with_facts(apply_filter(events, f)).withColumn("hasError", has_error()).withColumn("recordedReadOnly", F.col("facts.recordedReadOnly"))


def _activity() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("events"), F.count_if("hasError").alias("errors"),
        F.count_if(~F.col("recordedReadOnly")).alias("writes"),
        F.count_if(F.col("recordedReadOnly").isNull()).alias("unknownReadOnly"),
        F.count_distinct(_nz("accessKeyId")).alias("credentialIDs"),
        F.count_if(F.col("eventMs").isNull()).alias("invalidTimes"),
        F.min("eventMs").alias("firstMs"), F.max("eventMs").alias("lastMs"),
    ]


def activity_stats(events: DataFrame, f: Filter | None = None) -> DataFrame:
    return _scoped(events, f).agg(*_activity())


def _windowed(events: DataFrame, f: Filter | None, hours: int | None, entity: tuple[str, str] | None) -> DataFrame:
    """Scoped rows with inCurrent/inPrevious flags; windows end at the last event of the whole scope."""
    scoped = _scoped(events, f)
    if hours is None:
        rows = scoped.withColumns({"inCurrent": F.lit(True), "inPrevious": F.lit(False)})
    else:
        if hours not in WINDOW_HOURS:
            raise ValueError(f"no such window: {hours} hours; known are {WINDOW_HOURS}")
        width = hours * 3_600_000
        stop = apply_filter(events, f).agg((F.max("eventMs") + 1).alias("stop")).scalar()
        age = F.col("_stop") - F.col("eventMs")
        rows = scoped.withColumn("_stop", stop).withColumns({
            "inCurrent": F.coalesce((age > 0) & (age <= width), F.lit(False)),
            "inPrevious": F.coalesce((age > width) & (age <= 2 * width), F.lit(False)),
        }).drop("_stop")
    if entity is not None:
        dimension, value = entity
        if dimension not in DIMENSIONS or len(value) > 8192:
            raise ValueError(f"cannot break down by {dimension!r}")
        rows = rows.filter(F.coalesce(dimension, F.lit("")) == value)
    return rows


def window_stats(events: DataFrame, hours: int, f: Filter | None = None,
                 entity: tuple[str, str] | None = None) -> DataFrame:
    """Activity numbers of the current and the previous window, one row each, in one scan."""
    period = F.when(F.col("inCurrent"), "current").when(F.col("inPrevious"), "previous")
    return _windowed(events, f, hours, entity).withColumn("period", period) \
        .filter(F.col("period").isNotNull()).groupBy("period").agg(*_activity())


def compare_windows(events: DataFrame, hours: int | None = 24, f: Filter | None = None,
                    dimensions: tuple[str, ...] = DIMENSIONS, entity: tuple[str, str] | None = None,
                    limit: int = GROUP_LIMIT) -> DataFrame:
    """Group counts per dimension for two adjacent equal windows (or the whole scope when ``hours`` is None).

    All dimensions share one scan and one exchange.
    """
    if not set(dimensions) <= set(DIMENSIONS):
        raise ValueError(f"groups can be counted by {', '.join(DIMENSIONS)} only")
    rows = _windowed(events, f, hours, entity).filter(F.col("inCurrent") | F.col("inPrevious")).select(
        "inCurrent", "inPrevious", "hasError", "recordedReadOnly",
        *[F.coalesce(name, F.lit("")).alias(name) for name in dimensions])
    flags = ["inCurrent", "inPrevious", "hasError", "recordedReadOnly"]
    grouped = rows.unpivot(flags, list(dimensions), "dimension", "value").groupBy("dimension", "value").agg(
        F.count_if("inCurrent").alias("current"), F.count_if("inPrevious").alias("previous"),
        F.count_if(F.col("inCurrent") & F.col("hasError")).alias("errors"),
        F.count_if(F.col("inCurrent") & ~F.col("recordedReadOnly")).alias("writes"))
    totals = grouped.groupBy("dimension").agg(F.count(F.lit(1)).alias("totalGroups"))
    change = [F.abs(F.col("current") - F.col("previous")).desc()] if hours is not None else []
    top = top_rows(grouped, ["dimension"], change + [F.col("current").desc(), F.col("value").asc()], limit)
    return top.join(F.broadcast(totals), "dimension")  # one row per dimension


def entity_breakdown(events: DataFrame, entity: tuple[str, str], f: Filter | None = None) -> DataFrame:
    return compare_windows(events, None, f, ("eventSource", "eventName", "sourceIPAddress"), entity, BREAKDOWN_LIMIT)


def entity_latest(events: DataFrame, entity: tuple[str, str], f: Filter | None = None,
                  limit: int = LATEST_LIMIT) -> DataFrame:
    return _windowed(events, f, None, entity).orderBy(F.col("eventMs").desc_nulls_last(), F.col("seq").desc()).limit(limit)


def group_threshold(rows: DataFrame, compare, by: Column | None = None, distinct: Column | None = None) -> DataFrame:
    """Keep rows whose group passes ``compare(count)``; NULL groups never pass.

    ``distinct`` counts distinct values instead of rows; without ``by`` the whole
    selection is one group, read through a scalar subquery.
    """
    measure = F.count_distinct(distinct) if distinct is not None else F.count(F.lit(1))
    if by is None:
        return rows.filter(compare(rows.agg(measure.alias("n")).scalar()))
    passing = rows.groupBy(by.alias("_group")).agg(measure.alias("_n")).filter(compare(F.col("_n"))).select("_group")
    return rows.join(passing, by == F.col("_group"), "left_semi")


def key_activity(events: DataFrame) -> DataFrame:
    """Events per access key and distinct other keys it issued, one exchange."""
    from .lineage import issuance_condition
    child = F.when(issuance_condition() & (F.col("issuedKeyId") != F.col("accessKeyId")), F.col("issuedKeyId"))
    return events.filter(F.coalesce("accessKeyId", F.lit("")) != "").groupBy("accessKeyId").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct(child).alias("issuedKeys"))


def role_activity(events: DataFrame) -> DataFrame:
    return events.filter(F.coalesce("roleArn", F.lit("")) != "").groupBy("roleArn").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("accessKeyId").alias("sessions"))


def key_identities(events: DataFrame, variants: bool = False) -> DataFrame:
    """Representative identity per access key and whether its events disagree.

    The representative is the lowest ``seq`` among rows with a principal name, else the lowest overall; it travels in the
    aggregate, so no row is fetched afterwards.  Least and greatest spelling tell whether any part differs; how many
    spellings the most varied part has (``variants``) is counted only on request, as it expands every row.
    """
    rows = events.filter(F.coalesce("accessKeyId", F.lit("")) != "")
    parts = ("identityArn", "identityType", "roleArn", "accountId")
    shown = F.struct("seq", "identityType", "identityArn", "roleArn", "userName", "sessionName", "accountId", "invokedBy")
    place = F.struct(F.coalesce("identityArn", F.lit("")) == "", "seq")
    differs = F.greatest(*[F.coalesce(F.min(_nz(name)) != F.max(_nz(name)), F.lit(False)) for name in parts])
    found = rows.groupBy("accessKeyId").agg(F.min_by(shown, place).alias("row"), differs.alias("conflict")).select("accessKeyId", "row.*", "conflict")
    if not variants:
        return found
    ways = rows.groupBy("accessKeyId").agg(F.greatest(*[F.count_distinct(_nz(name)) for name in parts]).alias("variants"))
    return found.join(ways, "accessKeyId")


def hunt_scope(events: DataFrame, f: Filter | None = None) -> DataFrame:
    return apply_filter(events, f).agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("eventMs").isNull()).alias("invalidTimes"),
        F.count_if(F.coalesce("identityArn", F.lit("")) == "").alias("missingPrincipal"),
        F.count_if(F.coalesce("accessKeyId", F.lit("")) == "").alias("missingCredential"))
