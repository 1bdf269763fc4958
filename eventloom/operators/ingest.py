"""Ingest: validation, clock skew, identity, person properties, enrichment, limits. All as columns and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.timeutil import month

#: Fixed ids that stand for nobody.
BLACKLIST = ("anonymous", "null", "undefined", "none", "nil", "[object object]", "nan", "true", "false", "0", "guest")
#: Fixed greatest lengths of what a client says of an event's context.
CONTEXT_LENGTHS = {
    "session_id": 128, "url": 2048, "referrer": 2048, "page_title": 500, "page_path": 2048, "device_type": 50, "browser": 100, "browser_version": 50,
    "os": 100, "os_version": 50, "language": 35, "timezone": 100, "sdk_name": 100, "sdk_version": 50,
}
#: Fixed properties of persons that change with every page view; events have columns for them.
NOISY = (
    "$browser", "$browser_version", "$os", "$os_version", "$device_type", "$screen_width", "$screen_height", "$viewport_width", "$viewport_height", "$current_url",
    "$referrer", "$referring_domain", "$pathname", "$ip", "$geoip_country_code", "$geoip_city_name", "$timezone", "$language",
)
#: Fixed event names that are types of their own.
TYPES = {"$identify": "identify", "$pageview": "pageview", "$pageleave": "pageleave", "$set": "set", "$set_once": "set_once", "$screen": "screen"}
MAX_NAME, MAX_ID, MAX_KEYS, MAX_KEY, MAX_SKEW_MS = 255, 255, 200, 200, 48 * 3_600_000
RATE, RATE_SECONDS, RATE_SLIDE = 100_000, 60, 10


def problem(context: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> Column:
    """Why an event is turned down, or null. ``context``: columns of CONTEXT_LENGTHS that the rows have; ``more``: anonymous_id and user_properties, where they have them."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    keys = F.json_object_keys("properties")
    long = reduce(lambda a, b: a | b, [F.coalesce(F.length(c) > CONTEXT_LENGTHS[c], F.lit(False)) for c in context], F.lit(False))
    anonymous = F.coalesce(F.length("anonymous_id") > MAX_ID, F.lit(False)) if "anonymous_id" in more else F.lit(False)
    user_keys = F.coalesce(F.size(F.json_object_keys("user_properties")) > MAX_KEYS, F.lit(False)) if "user_properties" in more else F.lit(False)
    return (
        F.when(blank("project_id") | blank("event_name") | (F.length("event_name") > MAX_NAME) | anonymous, "invalid_event")
        .when(blank("distinct_id") | (F.length("distinct_id") > MAX_ID) | F.lower(F.trim("distinct_id")).isin(*BLACKLIST), "illegal_distinct_id")
        .when((F.coalesce(F.size(keys), F.lit(0)) > MAX_KEYS) | user_keys | F.exists(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.length(k) > MAX_KEY), "invalid_properties")
        .when(long, "invalid_context")
    )


def validated(rows: DataFrame) -> DataFrame:
    """Adds ``problem``; rows without one go on, the others are warnings."""
    return rows.withColumn("problem", problem())


def warnings(rows: DataFrame) -> DataFrame:
    bad = validated(rows).where("problem is not null")
    return bad.select("project_id", F.col("problem").alias("type"), F.to_json(F.struct("event_name", "distinct_id")).alias("details"))


def event_type(name: Column) -> Column:
    out = F.lit("track")
    for key, kind in TYPES.items():
        out = F.when(name == key, kind).otherwise(out)
    return out


def corrected_ms(server: Column, sent: Column, client: Column) -> Column:
    """Event time in milliseconds by the server's clock; the server's own where a time is missing or the delay is negative or over 48 hours."""
    delay = sent - client
    return F.when(delay.isNull() | (delay < 0) | (delay > MAX_SKEW_MS), server).otherwise(server - delay)


def person_id(project: Column, distinct: Column, namespace: str = "person") -> Column:
    """The same id for the same project and distinct id always: a name-based UUID of version 5 layout over SHA-1."""
    h = F.sha1(F.concat_ws(":", F.lit(namespace), project, distinct))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def identified(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Adds person_id: that of the known pair (project_id, distinct_id, person_id), else the deterministic one."""
    known = known.select("project_id", "distinct_id", F.col("person_id").alias("known_id"))
    out = rows.join(known, ["project_id", "distinct_id"], "left")
    return out.withColumn("person_id", F.coalesce("known_id", person_id(F.col("project_id"), F.col("distinct_id")))).drop("known_id")


def merges(rows: DataFrame) -> DataFrame:
    """Overrides that identify events ask for (project_id, distinct_id, person_id, version): the anonymous id belongs to the user's
    person from then on. Of several users the last event's holds, of simultaneous ones the larger person."""
    own = rows.where((F.col("event_name") == "$identify") & (F.coalesce(F.col("anonymous_id"), F.lit("")) != "") & (F.col("anonymous_id") != F.col("distinct_id")))
    return own.groupBy("project_id", F.col("anonymous_id").alias("distinct_id")).agg(F.max(F.struct("ms", "person_id")).alias("m")).select("project_id", "distinct_id", "m.person_id", F.col("m.ms").alias("version"))


def person_properties(changes: DataFrame, key: str = "person_id") -> DataFrame:
    """key, name, value: $set overwrites, $set_once fills what is missing, $unset removes.

    ``changes``: key, name, value, kind (set, set_once, unset), ms, event_id. What counts is the last set or unset; without one, the first set_once."""
    at = F.struct("ms", "event_id")
    last = F.col("kind").isin("set", "unset")
    rows = changes.groupBy(key, "name").agg(
        F.max_by(F.struct("kind", "value"), F.when(last, at)).alias("last"),
        F.min_by("value", F.when(F.col("kind") == "set_once", at)).alias("once"),
    )
    value = F.when(F.col("last").isNull(), F.col("once")).when(F.col("last.kind") == "set", F.col("last.value"))
    return rows.select(key, "name", value.alias("value")).where("value is not null")


def property_changes(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``'s columns, name, value, kind of every change that events' user_properties ask for: keys of $set and of the top are
    set (the top's win), those of $set_once fill what is missing, the list of $unset removes. Noisy ones are left out."""
    bag = F.coalesce(F.try_parse_json("user_properties"), F.parse_json(F.lit("{}")))
    rows = rows.select(*keep, bag.alias("__bag"))
    of = lambda path: F.coalesce(F.try_variant_get("__bag", path, "map<string,string>"), F.create_map().cast("map<string,string>"))
    top = F.map_filter(of("$"), lambda k, _: ~k.isin("$set", "$set_once", "$unset"))
    change = lambda kind: lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"), F.lit(kind).alias("kind"))
    given = F.map_filter(of("$['$set']"), lambda k, _: ~F.map_contains_key(top, k))
    gone = F.transform(F.coalesce(F.try_variant_get("__bag", "$['$unset']", "array<string>"), F.array().cast("array<string>")), lambda k: F.struct(k.alias("name"), F.lit(None).cast("string").alias("value"), F.lit("unset").alias("kind")))
    every = F.concat(*[F.transform(F.map_entries(m), change(kind)) for m, kind in ((top, "set"), (given, "set"), (of("$['$set_once']"), "set_once"))], gone)
    out = rows.select(*keep, F.explode(every).alias("__x")).select(*keep, "__x.*")
    return out.where((F.col("kind") == "unset") | ~F.col("name").isin(*NOISY))


def merged_properties(people: DataFrame, moves: DataFrame) -> DataFrame:
    """person_id, name, value after merges (from_id into to_id): the user's own value wins over the merged one's."""
    moved = people.join(moves.withColumnRenamed("from_id", "person_id"), "person_id", "left")
    rows = moved.select(F.coalesce("to_id", "person_id").alias("person_id"), "name", "value", F.col("to_id").isNotNull().alias("foreign"), F.col("person_id").alias("origin"))
    return rows.groupBy("person_id", "name").agg(F.min_by("value", F.struct("foreign", "origin")).alias("value"))


def moved_ids(distinct_ids: DataFrame, moves: DataFrame) -> DataFrame:
    """project_id, distinct_id, person_id after merges (from_id into to_id): all ids of a merged person belong to the other one."""
    moved = distinct_ids.join(moves.withColumnRenamed("from_id", "person_id"), "person_id", "left")
    return moved.select("project_id", "distinct_id", F.coalesce("to_id", "person_id").alias("person_id")).distinct()


def user_agent(text: Column) -> list[Column]:
    """browser, os, device_type of a user agent by fixed marks; desktop where nothing says otherwise."""
    has = lambda x: F.contains(text, F.lit(x))
    browser = F.when(has("Edg/"), "Edge").when(has("OPR/"), "Opera").when(has("Firefox/"), "Firefox").when(has("Chrome/"), "Chrome").when(has("Safari/"), "Safari").otherwise("")
    system = F.when(has("Windows"), "Windows").when(has("Android"), "Android").when(has("iPhone") | has("iPad"), "iOS").when(has("Mac OS X"), "macOS").when(has("Linux"), "Linux").otherwise("")
    device = F.when(has("iPad") | has("Tablet"), "tablet").when(has("Mobi"), "mobile").otherwise("desktop")
    return [browser.alias("browser"), system.alias("os"), device.alias("device_type")]


def with_device(rows: DataFrame, text: str = "user_agent") -> DataFrame:
    """Adds browser, os and device_type by the user agent where the client didn't say them itself."""
    for c, own in zip(("browser", "os", "device_type"), user_agent(F.coalesce(F.col(text), F.lit(""))), strict=True):
        rows = rows.withColumn(c, F.when(F.col(c) != "", F.col(c)).otherwise(own) if c in rows.columns else own)
    return rows


#: Columns of an event in the model that are taken over from the client as they are.
TAKEN = ("anonymous_id", "user_id", "session_id", "url", "referrer", "page_title", "page_path", "language", "timezone", "sdk_name", "sdk_version", "batch_id")


def screen_dimension(text: Column) -> Column:
    """The whole number that a width or height begins with; 0 where there is none above 0."""
    n = F.regexp_extract(text.cast("string"), r"^\s*\+?(\d+)", 1).try_cast("long")
    return F.coalesce(n, F.lit(0))


def mapped_fields(rows: DataFrame, server: Column, *keep: str) -> DataFrame:
    """An event's columns in the model from what a client sent: missing texts are empty, types and times have their defaults.
    ``keep``: further columns that stay."""
    text = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")).alias(c)
    screen = [screen_dimension(F.col(c)).alias(c) if c in rows.columns else F.lit(0).alias(c) for c in ("screen_width", "screen_height")]
    kind = F.when(F.col("event_type") != "", F.col("event_type")).otherwise("track") if "event_type" in rows.columns else event_type(F.col("event_name"))
    bags = [F.coalesce(F.col(c), F.lit("{}")).alias(c) for c in ("properties", "user_properties")]
    return rows.select(text("event_id"), "project_id", "event_name", kind.alias("event_type"), "distinct_id", *map(text, TAKEN), *screen, *bags, F.coalesce(F.col("timestamp"), server).alias("timestamp"), *keep)


def ip_number(ip: Column) -> Column:
    """IPv4 address as a number, null for other texts."""
    parts = F.split(ip, r"\.")
    number = sum((F.try_element_at(parts, F.lit(k + 1)).try_cast("long") * 256 ** (3 - k) for k in range(4)), F.lit(0).cast("long"))
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), number)


def with_country(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds country from blocks (low, high, country) of addresses. Both sides meet in the /16 that an address is in, so the join has keys."""
    cut = ranges.select("low", "high", "country", F.explode(F.sequence(F.floor(F.col("low") / 65536), F.floor(F.col("high") / 65536))).alias("block"))
    rows = rows.withColumn("__n", ip_number(F.col("ip"))).withColumn("block", F.floor(F.col("__n") / 65536))
    found = rows.join(cut, (rows["block"] == cut["block"]) & (F.col("__n") >= F.col("low")) & (F.col("__n") <= F.col("high")), "left")
    return found.select(*[rows[c] for c in rows.columns if c not in ("block", "__n", "country")], F.coalesce("country", F.lit("")).alias("country"))


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` speaks of it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def address_bits(text: Column) -> Column:
    """An address as 128 characters 0 and 1, an IPv4 one as the IPv6 address that it is mapped to; null for other texts."""
    octets = F.split(F.regexp_extract(text, r"(\d{1,3}(?:\.\d{1,3}){3})$", 1), r"\.")
    octet = lambda k: F.try_element_at(octets, F.lit(k)).try_cast("int")
    fine = F.forall(octets, lambda x: F.coalesce(x.try_cast("int"), F.lit(0)) <= 255)
    pair = lambda k: F.lower(F.hex(octet(k) * 256 + octet(k + 1)))
    tail = F.concat(pair(1), F.lit(":"), pair(3))
    is_4 = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    mixed = text.rlike(r":\d{1,3}(\.\d{1,3}){3}$")
    long = F.when(is_4, F.concat(F.lit("::ffff:"), tail)).when(mixed, F.concat(F.regexp_replace(text, r"\d{1,3}(\.\d{1,3}){3}$", ""), tail)).otherwise(F.lower(text))
    long = F.when(~(is_4 | mixed) | fine, long)
    groups = lambda part: F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    def filled(x: Column) -> Column:
        gap = F.lit(8) - F.size(x["a"]) - F.size(x["b"])
        return F.when((x["n"] == 2) & (gap > 0), F.concat(x["a"], F.array_repeat(F.lit("0"), gap), x["b"])).when((x["n"] == 1) & (gap == 0), x["a"])

    def bits(every: Column) -> Column:
        valid = (F.size(every) == 8) & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(valid, F.array_join(F.transform(every, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), ""))

    halves = lambda h: F.struct(groups(F.get(h, F.lit(0))).alias("a"), groups(F.coalesce(F.get(h, F.lit(1)), F.lit(""))).alias("b"), F.size(h).alias("n"))
    return _let(_let(_let(F.split(long, "::", 3), halves), filled), bits)


def block_bits(network: Column) -> Column:
    """The leading bits that a block of addresses (``10.0.0.0/8``, ``2001:db8::/32``) has in common; null for other texts."""
    base, length = F.substring_index(network, "/", 1), F.try_element_at(F.split(network, "/"), F.lit(2)).try_cast("int")
    is_4 = ~F.contains(base, F.lit(":"))
    length = length + F.when(is_4, 96).otherwise(0)
    return F.when((length >= F.when(is_4, 96).otherwise(0)) & (length <= 128), F.substring(address_bits(base), F.lit(1), length))


def with_place(rows: DataFrame, blocks: DataFrame, ip: str = "ip", columns: tuple[str, ...] = ("country",)) -> DataFrame:
    """Adds ``columns`` of the smallest block that holds an address, empty without one. ``blocks``: network, columns; IPv4 and IPv6, also nested.

    Each different address is looked up once, under every length that blocks have (129 at most, some twenty in practice), by equal leading bits. Of equal blocks the least row counts."""
    known = blocks.select(block_bits(F.col("network")).alias("bits"), *columns).where("bits is not null")
    known = known.groupBy("bits").agg(F.min(F.struct(*columns)).alias("found"))
    lengths = [r[0] for r in known.select(F.length("bits").alias("n")).distinct().orderBy("n").collect()]
    asked = rows.select(F.col(ip).alias("__ip")).where("__ip is not null").distinct().withColumn("all", address_bits(F.col("__ip")))
    every = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    asked = asked.select("__ip", F.explode(_let(F.col("all"), lambda bits: F.transform(every, lambda n: F.substring(bits, F.lit(1), n)))).alias("bits"))
    found = asked.join(known, "bits").groupBy("__ip").agg(F.max_by("found", F.length("bits")).alias("found"))
    joined = rows.join(found, F.col(ip) == F.col("__ip"), "left")
    return joined.select(*[rows[c] for c in rows.columns if c not in columns], *[F.coalesce(F.col("found")[c], F.lit("")).alias(c) for c in columns])


def rate_buckets(rows: DataFrame, limit: int = RATE) -> DataFrame:
    """project_id, window_start, n, over: events by sliding windows of a minute, moved on by ten seconds."""
    counts = rows.groupBy("project_id", F.window("ts", f"{RATE_SECONDS} seconds", f"{RATE_SLIDE} seconds").alias("w")).agg(F.count("*").alias("n"))
    return counts.select("project_id", F.col("w.start").cast("string").alias("window_start"), "n", (F.col("n") > limit).alias("over"))


def over_quota(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """project_id, month, n of projects over their plan's monthly events (null: no limit)."""
    counts = rows.groupBy("project_id", month(F.col("ts")).alias("month")).agg(F.count("*").alias("n"))
    return counts.join(plans, "project_id").where("events_limit is not null and n > events_limit").select("project_id", "month", "n")
