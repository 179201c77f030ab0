"""Tags, severities, services, places, sites and times derived from the event itself."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight import fixed
from quaylight.functions import times
from quaylight.functions.network import ip_number, network_of, parse_ip
from quaylight.functions.text import expand_template, first_non_empty, let, lookup, non_empty, strip
from quaylight.schema import col, present


def _no_tags() -> Column:
    return F.create_map().cast("map<string,string>")


def merge_tags(tags: Column, extra: Column) -> Column:
    """``extra`` wins over ``tags`` on equal keys."""
    kept = F.map_filter(tags, lambda k, _v: ~F.map_contains_key(extra, k))
    return F.map_concat(kept, extra)


def add_tags(df: DataFrame, tags: Mapping[str, str], name: str = "tags") -> DataFrame:
    """Add static tags to the tag map, creating it when missing."""
    current = F.coalesce(col(name), _no_tags()) if name in df.columns else _no_tags()
    if not tags:
        return df.withColumn(name, current)
    extra = F.create_map(*[F.lit(x) for item in tags.items() for x in item])
    return df.withColumn(name, merge_tags(current, extra))


def severity_number(c: Column, table: Mapping[str, int] = fixed.SEVERITY_ALIASES) -> Column:
    text = strip(F.lower(c.cast("string")))
    return F.coalesce(
        lookup(table, text).cast("bigint"), F.when(text.rlike(r"^\d+$"), text.try_cast("bigint"))
    )


def map_severity(
    df: DataFrame,
    table: Mapping[str, int] = fixed.SEVERITY_ALIASES,
    source: str = "severity",
    name: str = "severity_num",
) -> DataFrame:
    return df.withColumn(name, severity_number(col(source), table)) if source in df.columns else df


def import_severity(c: Column) -> Column:
    """Importer rule: alias table without ``fatal``; whole numbers are copied."""
    text = F.lower(c.cast("string"))
    return F.coalesce(
        lookup(fixed.IMPORT_SEVERITY_ALIASES, text).cast("bigint"), c.try_cast("bigint")
    )


def service_of_path(
    c: Column, patterns: Sequence[tuple[str, str]] = fixed.PATH_SERVICES
) -> Column:
    return F.coalesce(
        *[
            F.when(c.rlike("(?i)" + p), non_empty(expand_template(c, "(?i)" + p, t)))
            for p, t in patterns
        ]
    )


def service_from_path(
    df: DataFrame,
    patterns: Sequence[tuple[str, str]] = fixed.PATH_SERVICES,
    path_fields: Sequence[str] = fixed.PATH_FIELDS,
    host_fields: Sequence[str] = fixed.HOST_FIELDS,
    name: str = "service",
) -> DataFrame:
    """First path field with a matching pattern, else the first label of a host name."""
    found = [service_of_path(col(f).cast("string"), patterns) for f in present(df, path_fields)]
    found += [
        non_empty(F.split_part(col(f).cast("string"), F.lit("."), F.lit(1)))
        for f in present(df, host_fields)
    ]
    if name in df.columns:
        found.append(col(name))
    return df.withColumn(name, F.coalesce(*found)) if found else df


def geo_hint(
    df: DataFrame,
    ip_map: Mapping[str, Mapping[str, str]],
    subnet_map: Mapping[str, Mapping[str, str]],
    ip_fields: Sequence[str] = fixed.IP_FIELDS,
    name: str = "geo_hint",
) -> DataFrame:
    """Location map of the first IP field: exact address, else the first subnet in config order.

    Subnets are matched by equality of network addresses, one lookup per distinct prefix length,
    so no pair of (event, subnet) is ever formed. The configured tables are local relations whose size Spark
    knows: they are broadcast below ``spark.sql.autoBroadcastJoinThreshold`` and joined by shuffle above it.
    """
    fields = present(df, ip_fields)
    if not fields or not (ip_map or subnet_map):
        return df
    spark = df.sparkSession
    out = df.withColumn("__ip", first_non_empty([col(f) for f in fields]))
    out = out.withColumn("__num", ip_number(F.col("__ip")))

    def attach(left: DataFrame, rows: list, key: Column, label: str) -> DataFrame:
        keys, orders, places = zip(*rows, strict=True)
        found = pa.StructArray.from_arrays(
            [pa.array(orders, pa.int32()), pa.array([list(p.items()) for p in places], pa.map_(pa.string(), pa.string()))],
            names=["o", "p"],
        )
        small = spark.createDataFrame(pa.table({"__k": pa.array(keys), label: found}))
        return left.join(small, key == F.col("__k"), "left").drop("__k")

    exact = [(ip, 0, place) for ip, place in ip_map.items()]
    exact += [
        (ip, 1 + i, place) for i, (ip, place) in enumerate(subnet_map.items())
        if "/" not in ip and ip not in ip_map
    ]
    labels = []
    if exact:
        out = attach(out, exact, F.col("__ip"), "__exact")
        labels.append("__exact")
    by_prefix: dict[int, dict[int, tuple]] = {}
    for i, (cidr, place) in enumerate(subnet_map.items()):
        if "/" in cidr:
            net, prefix = cidr.split("/")
            number = parse_ip(net) & (0xFFFFFFFF << (32 - int(prefix))) & 0xFFFFFFFF
            by_prefix.setdefault(int(prefix), {}).setdefault(number, (number, 1 + i, place))
    for prefix, nets in sorted(by_prefix.items()):
        label = f"__net{prefix}"
        out = attach(out, list(nets.values()), network_of(F.col("__num"), prefix), label)
        labels.append(label)
    best = F.array_min(F.array(*[F.col(x)["o"] for x in labels]))
    place = F.coalesce(*[F.when(F.col(x)["o"] == best, F.col(x)["p"]) for x in labels])
    return out.withColumn(name, place).drop("__ip", "__num", *labels)


def site_env(
    c: Column, patterns: Sequence[tuple[str, Mapping[str, str]]] = fixed.SITE_PATTERNS
) -> Column:
    """``struct(site, environment)`` of the first host-name pattern that matches."""
    cases = [
        F.when(
            c.rlike("(?i)" + p),
            F.struct(
                (expand_template(c, "(?i)" + p, t["site"]) if "site" in t else F.lit(None).cast("string")).alias("site"),
                (expand_template(c, "(?i)" + p, t["env"]) if "env" in t else F.lit(None).cast("string")).alias("environment"),
            ),
        )
        for p, t in patterns
    ]
    return F.coalesce(*cases)


def site_env_tags(
    df: DataFrame,
    patterns: Sequence[tuple[str, Mapping[str, str]]] = fixed.SITE_PATTERNS,
    default_site: str | None = None,
    default_env: str | None = None,
    host_fields: Sequence[str] = fixed.HOST_FIELDS,
    name: str = "tags",
) -> DataFrame:
    """Set ``tags.site`` and ``tags.environment``; defaults fill gaps of an existing tag map."""
    host = first_non_empty([col(f) for f in present(df, host_fields)])
    current = col(name) if name in df.columns else F.lit(None).cast("map<string,string>")

    def as_tags(found: Column) -> Column:
        both = F.create_map(
            F.lit("site"), found["site"], F.lit("environment"), found["environment"]
        )
        return F.map_filter(both, lambda _k, v: F.coalesce(v, F.lit("")) != "")

    def merged(pair: Column) -> Column:
        full = merge_tags(F.coalesce(pair["tags"], _no_tags()), pair["extra"])
        return F.when(F.size(pair["extra"]) > 0, full).otherwise(pair["tags"])

    # Each intermediate value is bound once: filters on tags are pushed into the scan side, and
    # would otherwise repeat the pattern chain for every use.
    extra = let(let(host, lambda h: site_env(h, patterns)), as_tags)
    tags = let(F.struct(current.alias("tags"), extra.alias("extra")), merged)
    defaults = {k: v for k, v in (("site", default_site), ("environment", default_env)) if v}
    if defaults:
        filler = F.create_map(*[F.lit(x) for item in defaults.items() for x in item])
        tags = let(
            tags,
            lambda m: F.when(m.isNotNull(), F.map_concat(m, F.map_filter(filler, lambda k, _v: ~F.map_contains_key(m, k)))),
        )
    return df.withColumn(name, tags)


def normalise_time(
    df: DataFrame,
    as_of: Column | str,
    fields: Sequence[str] = fixed.TIME_FIELDS,
) -> DataFrame:
    """Rewrite the first parseable time field as ISO text; ``as_of`` fills events without any."""
    as_of = F.lit(as_of) if isinstance(as_of, str) else as_of
    names = present(df, fields)
    types = {f.name: f.dataType for f in df.schema}
    out = df
    parsed = {n: times.normalise_text(col(n), types[n]) for n in names}
    earlier = F.lit(False)
    changed = {}
    for n in names:
        hit = parsed[n].isNotNull()
        changed[n] = F.when(~earlier & hit, parsed[n]).otherwise(col(n).cast("string"))
        earlier = earlier | hit
    if "timestamp" in names:
        missing = F.lit(True)
        for n in names:
            missing = missing & col(n).isNull()
        changed["timestamp"] = F.when(missing, as_of).otherwise(changed["timestamp"])
    elif names:
        missing = F.lit(True)
        for n in names:
            missing = missing & col(n).isNull()
        changed["timestamp"] = F.when(missing, as_of)
    else:
        changed["timestamp"] = as_of
    return out.withColumns(changed)
