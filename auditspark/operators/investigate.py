"""Events around anchor events, for a table of anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.facts import with_facts
from ..functions.labels import with_target
from ..functions.network import ip_hex
from ..functions.resources import resource_refs
from ..plans.numbering import number_rows
from ..session import checkpoint
from .aggregates import top_rows

CONTEXT_LIMIT, RESOURCE_LIMIT = 500, 100
# Relation names and the link kinds behind them.
RELATIONS = {
    "all": ("time",), "shared": ("shared",), "credential": ("credential",), "principal": ("principal",), "ip": ("ip",),
    "request": ("request",), "resources": ("resource",),
    "related": ("shared", "credential", "principal", "ip", "request", "resource"),
}
# Recorded values by which two events are linked.
COMPARED = ("accessKeyId", "identityArn", "sourceIPAddress", "sharedID", "requestID", "eventSource", "eventName", "recipientAccountId", "awsRegion", "arns")


def with_context_columns(events: DataFrame) -> DataFrame:
    """Columns the relations compare: recorded ids and the distinct resource names."""
    return with_facts(events).withColumns({
        "sharedID": F.col("facts.sharedID"), "requestID": F.col("facts.requestID"), "arns": F.array_distinct(F.col("facts.refs.arn"))}).drop("facts")


def _key(*names: str) -> Column:
    """Composite link key; NULL when any part is missing or empty."""
    return F.concat_ws("\x1f", *[F.col(n) for n in names]) if len(names) == 1 else F.when(
        F.forall(F.array(*[F.coalesce(n, F.lit("")) for n in names]), lambda x: x != ""), F.concat_ws("\x1f", *[F.col(n) for n in names]))


def link_keys(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(seq, eventMs, kind, key) for the wanted link kinds; input carries the context columns."""
    one = lambda kind, key: F.array(F.struct(F.lit(kind).alias("kind"), key.alias("key")))
    made = {
        "time": lambda: one("time", F.lit("*")),
        "shared": lambda: one("shared", _key("sharedID", "eventSource", "eventName")),
        "credential": lambda: one("credential", _key("accessKeyId", "identityArn")),
        "principal": lambda: one("principal", _key("identityArn")),
        "ip": lambda: one("ip", F.when(ip_hex(F.col("sourceIPAddress")).isNotNull(), F.col("sourceIPAddress"))),
        "request": lambda: one("request", _key("requestID", "eventSource", "eventName", "recipientAccountId", "awsRegion")),
        "resource": lambda: F.transform("arns", lambda a: F.struct(F.lit("resource").alias("kind"), a.alias("key"))),
    }
    return events.filter(F.col("eventMs").isNotNull()).select(
        "seq", "eventMs", F.inline_outer(F.concat(*[made[k]() for k in kinds]))).filter(F.coalesce("key", F.lit("")) != "")


def _check(minutes: int, relation: str) -> tuple[int, tuple[str, ...]]:
    if not 1 <= minutes <= 60:
        raise ValueError(f"context reaches from 1 to 60 minutes, not {minutes}")
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation!r}")
    return minutes * 60_000, RELATIONS[relation]


def _linked(events: DataFrame, anchors: DataFrame, kinds: tuple[str, ...], delta: int) -> tuple[DataFrame, DataFrame]:
    """(anchor keys, event keys) for the wanted kinds; of the events only those whose tick an anchor's window touches.

    A tick is as long as half a window, so an anchor asks for three ticks of each of its keys.  The distinct ticks are
    a filter on the scan: whatever lies outside every window is neither stored nor sorted.
    """
    keyed = link_keys(with_context_columns(events), kinds)
    probes = checkpoint(keyed.join(anchors.select("seq").distinct(), "seq", "left_semi").select(F.col("seq").alias("anchor"), F.col("eventMs").alias("anchorMs"), "kind", "key"))
    tick = F.floor(F.col("anchorMs") / delta)
    asked = probes.select("kind", "key", F.explode(F.sequence(tick - 1, tick + 1)).alias("tick")).distinct()
    return probes, checkpoint(keyed.withColumn("tick", F.floor(F.col("eventMs") / delta)).join(asked, ["kind", "key", "tick"], "left_semi").drop("tick"))


def _selves(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """The anchors themselves: they belong to their own context under every relation."""
    return events.filter(F.col("eventMs").isNotNull()).join(anchors.select("seq").distinct(), "seq", "left_semi") \
        .select(F.col("seq").alias("anchor"), F.col("eventMs").alias("anchorMs"))


def _of_anchor(compared: DataFrame) -> DataFrame:
    """Compared columns under the names of the anchor's side."""
    return compared.select(F.col("seq").alias("anchor"), *[F.col(c).alias("a_" + c) for c in COMPARED])


def _reason(kind: str, value: Column) -> Column:
    return F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value")))


def _reasons() -> Column:
    """Recorded links between an anchor and another event, in fixed order; NULL when there is none."""
    def same(*names: str) -> Column:
        parts = [(F.coalesce("a_" + n, F.lit("")) != "") & (F.col("a_" + n) == F.col(n)) for n in names]
        out = parts[0]
        for part in parts[1:]:
            out = out & part
        return F.coalesce(out, F.lit(False))

    nothing = F.array().cast("array<struct<kind:string,value:string>>")
    when = lambda test, kind, value: F.when(test, _reason(kind, value)).otherwise(nothing)
    arns = F.coalesce(F.arrays_overlap("a_arns", "arns"), F.lit(True))  # not certain beside a NULL
    shared_arns = F.array_sort(F.array_intersect("a_arns", "arns"))
    credential, principal, ip = same("accessKeyId", "identityArn"), same("identityArn"), same("sourceIPAddress")
    shared, request = same("sharedID", "eventSource", "eventName"), same("requestID", "eventSource", "eventName", "recipientAccountId", "awsRegion")
    literal_ip = ip_hex(F.col("a_sourceIPAddress")).isNotNull()
    found = F.concat(
        when(shared, "shared", F.col("a_sharedID")),
        when(request, "request", F.col("a_requestID")),
        F.when(credential, _reason("credential", F.col("a_accessKeyId"))).when(principal, _reason("principal", F.col("a_identityArn"))).otherwise(nothing),
        F.coalesce(F.when(arns, F.transform(shared_arns, lambda a: F.struct(F.lit("resource").alias("kind"), a.alias("value")))), nothing),
        when(ip & literal_ip, "ip", F.col("a_sourceIPAddress")))
    # most events of a window share nothing, and are told by the comparisons alone
    return F.when(shared | request | principal | ip | arns, F.when(F.size(found) > 0, found))


def near_pairs(events: DataFrame, anchors: DataFrame, minutes: int = 5, relation: str = "all",
               cap: int = CONTEXT_LIMIT, compared: DataFrame | None = None) -> DataFrame:
    """(anchor, seq, eventMs, deltaMs, rank): the ``cap`` closest linked events of every anchor, exactly.

    Linked events are numbered twice: by (link key, time, seq) and by (link key, time backwards, seq).  From the number
    at which an anchor's own millisecond begins in the first order, and ends in the second, the next ``cap`` numbers
    hold everything that can be among the closest on that side.  So an anchor meets at most 2 * ``cap`` events per
    key, however many share its window or millisecond, and the join runs on blocks of numbers, which are all one size.

    ``compared`` has a row of compared columns per seq, each seq once: then ``reasons`` is made where an anchor meets an
    event, so these columns move once per event and side, and a pair moves once, by its anchor, as a few numbers.
    """
    delta, kinds = _check(minutes, relation)
    probes, keyed = _linked(events, anchors, kinds, delta)
    count = keyed.count()
    made = [] if compared is None else ["reasons"]

    def one_side(forwards: bool) -> DataFrame:
        ms = F.col("eventMs").asc() if forwards else F.col("eventMs").desc()
        rows = number_rows(keyed, [F.col("kind"), F.col("key"), ms, F.col("seq")], "_n", rows=count)
        moments = rows.groupBy("kind", "key", F.col("eventMs").alias("anchorMs")).agg(
            (F.min("_n") if forwards else F.max("_n") + 1).alias("_from"))
        asked = probes.join(moments, ["kind", "key", "anchorMs"]).withColumn("_block", F.explode(F.array_distinct(F.array(
            F.floor(F.col("_from") / cap), F.floor((F.col("_from") + cap - 1) / cap)))))
        rows = rows.withColumn("_block", F.floor(F.col("_n") / cap)).withColumnsRenamed({"kind": "_kind", "key": "_key"})
        # a millisecond's own events are met forwards; an anchor is no neighbour of its own
        beside = F.lit(True) if forwards else F.col("eventMs") != F.col("anchorMs")
        inside = (F.col("_n") >= F.col("_from")) & (F.col("_n") < F.col("_from") + cap) & (F.col("kind") == F.col("_kind")) \
            & (F.col("key") == F.col("_key")) & (F.abs(F.col("eventMs") - F.col("anchorMs")) <= delta) & beside & ~F.col("seq").eqNullSafe(F.col("anchor"))
        if compared is not None:
            asked, rows = asked.join(_of_anchor(compared), "anchor"), rows.join(compared, "seq")
        pairs = asked.join(rows, "_block").filter(inside)
        return pairs.select("anchor", "anchorMs", "seq", "eventMs", *([_reasons().alias("reasons")] if made else []))

    own = [_reason("anchor", F.lit("")).alias("reasons")] if made else []
    selves = _selves(events, anchors).dropDuplicates(["anchor"]).select("anchor", "anchorMs", F.col("anchor").alias("seq"), F.col("anchorMs").alias("eventMs"), *own)
    # all rows of an anchor meet by one exchange, which serves the choice of different ones and the ranks
    met = one_side(True).unionByName(one_side(False)).unionByName(selves).repartition("anchor")
    if compared is None:
        met = met.dropDuplicates(["anchor", "seq"])
    elif kinds == RELATIONS["resources"] or len(kinds) > 1:  # an event may share several keys
        met = met.distinct()
    gap = F.abs(F.col("eventMs") - F.col("anchorMs"))
    closest = top_rows(met, ["anchor"], [(F.col("anchor") == F.col("seq")).desc(), gap.asc(), F.col("eventMs").asc(), F.col("seq").asc()], cap)
    return closest.withColumn("deltaMs", F.col("eventMs") - F.col("anchorMs")).drop("anchorMs")


def _distinct_links(keyed: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Keys without those that say nothing more: whoever shares a credential shares its principal."""
    return keyed.filter("kind <> 'credential'") if {"credential", "principal"} <= set(kinds) else keyed


def _key_sets(keyed: DataFrame, *columns: str) -> DataFrame:
    """One row per event with the hashed keys it has, in order."""
    digest = F.struct(F.xxhash64("kind", "key").alias("a"), F.xxhash64(F.lit("b"), "key", "kind").alias("b"))
    return keyed.groupBy(*columns).agg(F.sort_array(F.collect_set(digest)).alias("keys"))


def _subsets(keys: Column) -> Column:
    """All parts of a set of keys that are not empty, each as (list, size): the xor of its keys' hashes, and how many."""
    start = F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("size")))
    grown = F.aggregate(keys, start, lambda made, k: F.concat(made, F.transform(made, lambda m: F.struct(
        m["a"].bitwiseXOR(k["a"]).alias("a"), m["b"].bitwiseXOR(k["b"]).alias("b"), (m["size"] + 1).alias("size")))))
    return F.filter(grown, lambda m: m["size"] > 0)


def _events_between(listed: DataFrame, asked: DataFrame, delta: int) -> DataFrame:
    """(anchor, total): the sum of ``sign`` times the events of a list within an anchor's window, over its rows of ``asked``.

    In the order (list, time) the events of a window are the difference of two positions.  Events of one list and
    millisecond are one row with their number, and so are equal ends of windows, so a dense moment is no larger than any
    other.  Positions are running sums inside a slice of the list as long as half a window, which has a row per
    millisecond at most, and the events of the slices before are added.
    """
    ends = asked.select("anchor", "list", "sign", F.inline(F.array(
        F.struct((F.col("anchorMs") - delta).alias("ms"), F.lit(-1).alias("side")), F.struct((F.col("anchorMs") + delta).alias("ms"), F.lit(1).alias("side")))))
    moments = listed.groupBy("list", F.col("eventMs").alias("ms")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(0))
    line = moments.unionByName(ends.select("list", "ms", "side").distinct().withColumn("n", F.lit(0).cast("bigint")))
    line = checkpoint(line.withColumn("slice", F.floor(F.col("ms") / delta)))
    until = Window.partitionBy("list", "slice").orderBy("ms", "side").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("list").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = line.groupBy("list", "slice").agg(F.sum("n").alias("size")).select(
        "list", "slice", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    places = line.withColumn("place", F.sum("n").over(until)).filter("side <> 0").join(sizes, ["list", "slice"]).select(
        "list", "ms", "side", (F.col("place") + F.col("before")).alias("place"))
    return ends.join(places, ["list", "ms", "side"]).groupBy("anchor").agg(F.sum(F.col("sign") * F.col("side") * F.col("place")).alias("total"))


def context_totals(events: DataFrame, anchors: DataFrame, minutes: int = 5, relation: str = "all", most_keys: int = 8) -> DataFrame:
    """Number of linked events per anchor (the anchor included) before the closest are chosen.

    Events are never paired with anchors.  An event that shares several keys with an anchor must count once: the events
    that carry every key of a set form one list, and an anchor adds the lists of its sets of one key, takes off those of
    two, adds those of three, and so on.  Only sets that an anchor has are kept, so the rows grow with the events and the
    anchors.  An anchor with more than ``most_keys`` keys is compared with the events by distinct sets of keys instead.
    """
    delta, kinds = _check(minutes, relation)
    probes, keyed = _linked(events, anchors, kinds, delta)
    if len(kinds) == 1 and kinds[0] != "resource":  # one key per event: the key is the list
        name = F.concat_ws("\x1f", "kind", "key").alias("list")
        total = _events_between(keyed.select(name, "eventMs"), probes.select("anchor", "anchorMs", name, F.lit(1).alias("sign")), delta)
    else:
        probes, keyed = _distinct_links(probes, kinds), _distinct_links(keyed, kinds)
        sized = probes.groupBy("anchor").agg(F.count_distinct("kind", "key").alias("n"))
        few = probes.join(sized.filter(F.col("n") <= most_keys), "anchor", "left_semi")
        many = checkpoint(probes.join(sized.filter(F.col("n") > most_keys), "anchor", "left_semi"))
        total = _total_by_sets(few, keyed, delta, most_keys)
        if not many.isEmpty():
            total = total.unionByName(_total_by_lists(many, keyed, delta))
    return _selves(events, anchors).select("anchor").join(total, "anchor", "left").select("anchor", F.coalesce("total", F.lit(1)).alias("total"))


def _total_by_sets(probes: DataFrame, keyed: DataFrame, delta: int, most_keys: int) -> DataFrame:
    """Totals by adding and taking off the lists of every set of an anchor's keys."""
    lists = lambda rows, *columns: rows.select(*columns, F.inline(_subsets(F.col("keys"))))
    named = F.struct("a", "b").alias("list")
    asked = checkpoint(lists(_key_sets(probes, "anchor", "anchorMs"), "anchor", "anchorMs").select(
        "anchor", "anchorMs", named, "size", F.when(F.col("size") % 2 == 1, 1).otherwise(-1).alias("sign")))
    # an event takes part by the keys that these anchors have; one with many of them meets the anchors' own sets instead
    wanted = probes.select("kind", "key").distinct()
    sets = checkpoint(_key_sets(keyed.join(wanted, ["kind", "key"], "left_semi"), "seq", "eventMs"))
    small = F.size("keys") <= most_keys
    plain = lists(sets.filter(small), "eventMs").select("eventMs", named)
    kept = plain.join(asked.select("list").distinct(), "list", "left_semi")
    held = _key_sets(probes, "anchor", "anchorMs").select("keys").distinct()
    wide = sets.filter(~small)
    if not wide.isEmpty():
        shared = wide.select("seq", "eventMs", F.explode("keys").alias("key"), "keys") \
            .join(held.select(F.explode("keys").alias("key"), F.col("keys").alias("own")), "key") \
            .select("seq", "eventMs", F.inline(_subsets(F.array_intersect("keys", "own")))).select("seq", "eventMs", named).distinct()
        kept = kept.select("list", "eventMs").unionByName(shared.select("list", "eventMs"))
    return _events_between(kept.select("list", "eventMs"), asked, delta)


def _total_by_lists(probes: DataFrame, keyed: DataFrame, delta: int) -> DataFrame:
    """Totals of anchors with many keys: events with the same keys form one list, paired with every anchor that shares one."""
    mine = keyed.join(probes.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    keys = F.sort_array(F.collect_set(F.struct("kind", "key")))
    sets = checkpoint(mine.groupBy("seq", "eventMs").agg(keys.alias("keys")).withColumn("list", F.sha2(F.to_json("keys"), 256)))
    lists = sets.select("list", "keys").dropDuplicates(["list"]).select("list", F.inline("keys"))
    asked = probes.join(lists, ["kind", "key"]).select("anchor", "anchorMs", "list").distinct().withColumn("sign", F.lit(1))
    return _events_between(sets.select("list", "eventMs"), asked, delta)


def surrounding(events: DataFrame, anchors: DataFrame, minutes: int = 5, relation: str = "all",
                cap: int = CONTEXT_LIMIT, totals: bool = False) -> DataFrame:
    """Closest linked events of every anchor with the reasons they are linked.

    ``reasons`` is array<struct<kind, value>>: 'anchor', or the recorded links in
    fixed order, or 'time' when nothing but proximity holds; ``truncated`` tells
    that the window holds more than ``cap``, and with ``totals`` a row has the number of
    linked events in ``total``.
    """
    compared = with_context_columns(events).select("seq", *COMPARED)
    repeated = events.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR seq IS NULL")
    once = repeated.isEmpty()
    pairs = near_pairs(events, anchors, minutes, relation, cap + 1, compared if once else None)  # one row more per anchor shows that there are more
    rows = pairs.withColumn("truncated", F.max("rank").over(Window.partitionBy("anchor")) > cap).filter(F.col("rank") <= cap)
    if not once:  # every row of a repeated seq is compared
        rows = checkpoint(rows)
        narrow = compared.join(rows.select("seq").distinct(), "seq", "left_semi")  # every anchor is in its own context
        rows = rows.join(narrow, "seq").join(_of_anchor(narrow), "anchor").withColumn(
            "reasons", F.when(F.col("seq") == F.col("anchor"), _reason("anchor", F.lit(""))).otherwise(_reasons()))
    if totals:
        rows = rows.join(context_totals(events, anchors, minutes, relation), "anchor")
    return rows.select("anchor", "seq", "eventMs", "deltaMs", "rank", F.coalesce("reasons", _reason("time", F.lit(""))).alias("reasons"), "truncated", *(["total"] if totals else []))


def anchor_resources(events: DataFrame, anchors: DataFrame, limit: int = RESOURCE_LIMIT) -> DataFrame:
    """Distinct references of every anchor, ordered by name and source, with a truncation flag."""
    chosen = events.join(anchors.select("seq").distinct(), "seq", "left_semi")
    ranked = top_rows(resource_refs(chosen).distinct(), ["seq"], [F.col("arn").asc(), F.col("source").asc()], limit + 1)
    sizes = ranked.groupBy("seq").agg((F.max("rank") > limit).alias("truncated"))
    return ranked.filter(F.col("rank") <= limit).join(sizes, "seq")


def display_context(context: DataFrame, events: DataFrame) -> DataFrame:
    """Context rows with display columns and target."""
    return context.join(with_target(events).drop("raw", "eventMs"), "seq")
