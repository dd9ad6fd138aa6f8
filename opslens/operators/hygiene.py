"""URL screening against private networks; addresses come from a host table, no name lookup runs in a job."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.functions.columns import one_of
from opslens.functions.text import map_texts
from opslens.session import materialize

# Networks that must not be reached.
BLOCKED_V4 = (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8", "100.64.0.0/10",
)
BLOCKED_V6 = ("::1/128", "fc00::/7", "fe80::/10")
IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"


def ipv4_number(address: Column) -> Column:
    octets = F.split(address, r"\.")
    number = F.lit(0).cast("bigint")
    for place in range(4):
        number = number * 256 + F.get(octets, F.lit(place)).try_cast("bigint")
    return number


def is_ipv4(address: Column) -> Column:
    return F.forall(F.split(address, r"\."), lambda octet: octet.try_cast("int") <= 255)


def is_blocked_v4(address: Column) -> Column:
    number, hit = ipv4_number(address), F.lit(False)
    for block in BLOCKED_V4:
        net = ipaddress.ip_network(block)
        hit = hit | number.between(int(net.network_address), int(net.broadcast_address))
    return hit


@F.pandas_udf(T.BooleanType())
def _blocked_v6(addresses: pd.Series) -> pd.Series:
    nets = [ipaddress.ip_network(n) for n in BLOCKED_V6]

    def test(text):
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return None
        return any(address in n for n in nets)

    return map_texts(addresses, test)


@F.pandas_udf(T.StringType())
def _bits_v6(addresses: pd.Series) -> pd.Series:
    def bits(text):
        try:
            return format(int(ipaddress.IPv6Address(text)), "0128b")
        except ValueError:
            return None

    return map_texts(addresses, bits)


def address_bits(address: Column) -> Column:
    """An address as text of 32 or 128 zeros and ones, null for what is none. Only IPv6 leaves the JVM."""
    v4 = F.when(address.rlike(IPV4) & is_ipv4(address), F.lpad(F.bin(ipv4_number(address)), 32, "0"))
    v6 = _bits_v6(F.when(address.contains(":"), address))
    return F.when(address.contains(":"), v6).otherwise(v4)


def _block_leads(blocks: DataFrame) -> DataFrame:
    """One row per network: `family` (bits of its addresses), `length` and `lead`, its fixed leading bits."""
    size = F.substring_index("network", "/", -1).try_cast("int")
    rows = blocks.select("network", "blocked", address_bits(F.substring_index("network", "/", 1)).alias("_bits"))
    rows = rows.withColumn("family", F.length("_bits")).withColumn("length", F.when(F.col("network").contains("/"), size).otherwise(F.col("family")))
    sound = F.coalesce(F.col("length").between(0, F.col("family")), F.lit(False))
    message = F.concat(F.lit("no network: "), F.coalesce("network", F.lit("null")))
    rows = rows.withColumn("length", F.when(sound, F.col("length")).otherwise(F.raise_error(message).cast("int")))
    return rows.groupBy("family", "length", F.expr("left(_bits, length)").alias("lead")).agg(
        F.min("network").alias("network"), F.bool_or(F.coalesce("blocked", F.lit(True))).alias("blocked")
    )


def longest_block(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds `block` and `block_stops`, the longest network that holds the row's `address` and whether it blocks; null without one.

    `blocks` has `network` (CIDR text, or one address) and `blocked`; false lets a part of a blocked network through. A
    network given twice, or without a flag, blocks if one of its rows does; text that is no network fails the job, so that no
    rule is lost. Each distinct address asks once for every length that the table has: an equality join on
    leading bits with at most one hit per length, whatever the networks overlap.
    """
    table = materialize(_block_leads(blocks), "blocks")
    # at most 33 lengths of the one family and 129 of the other
    lengths = {family: sorted(r.length for r in table.where(F.col("family") == family).select("length").distinct().collect()) for family in (32, 128)}
    bits = rows.select("address").where(F.col("address").isNotNull()).distinct().withColumn("_bits", address_bits(F.col("address")))
    bits = bits.where(F.col("_bits").isNotNull()).withColumn("family", F.length("_bits"))
    options = {family: F.array(*[F.lit(n) for n in found]).cast("array<int>") for family, found in lengths.items()}
    length = F.explode(F.when(F.col("family") == 32, options[32]).otherwise(options[128])).alias("length")
    asked = bits.select("address", "family", "_bits", length).withColumn("lead", F.expr("left(_bits, length)"))
    best = F.max_by(F.struct("network", "blocked"), "length").alias("_best")
    hits = asked.join(table, ["family", "length", "lead"]).groupBy(F.col("address").alias("_probe")).agg(best)
    # rows without an address ask under a key of their own, not all under one null
    probe = F.coalesce("address", F.concat(F.lit("-"), F.xxhash64("url").cast("string")))
    found = rows.withColumn("_probe", probe).join(hits, "_probe", "left")
    return found.withColumns({"block": F.col("_best.network"), "block_stops": F.col("_best.blocked")}).drop("_probe", "_best")


def _outcome(blocked: Column) -> Column:
    return one_of(
        [
            (~F.col("scheme").isin("http", "https"), "scheme not allowed"),
            (F.col("host") == "", "no host"),
            (F.col("address").isNull(), "host not resolved"),
            (blocked, "blocked network"),
        ],
        "ok",
    )


def screen_urls(urls: DataFrame, hosts: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Adds `host`, `address` and `outcome` (ok or why not); `hosts` has `host, address`, one row per host.

    IPv6 literals leave the JVM, everything else does not. `blocks`, a table of networks for `longest_block`, takes the
    place of the fixed networks and adds `block`; an address that cannot be read is then not resolved.
    """
    scheme = F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, r"^.*@", "")
    v6 = F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)
    host = F.lower(F.when(v6 != "", v6).otherwise(F.regexp_extract(bare, r"^([^:]*)", 1)))
    rows = urls.withColumns({"scheme": scheme, "host": host}).join(hosts, "host", "left")
    literal = F.col("host").rlike(IPV4) | F.col("host").contains(":")
    rows = rows.withColumn("address", F.when(literal, F.col("host")).otherwise(F.col("address")))
    # what only looks like an address is none: screening fails closed
    rows = rows.withColumn("address", F.when(~F.col("address").rlike(IPV4) | is_ipv4(F.col("address")), F.col("address")))
    if blocks is not None:
        rows = rows.withColumn("address", F.when(address_bits(F.col("address")).isNotNull(), F.col("address")))
        rows = longest_block(rows, blocks)
        return rows.withColumn("outcome", _outcome(F.coalesce("block_stops", F.lit(False)))).drop("block_stops")
    blocked_v6 = _blocked_v6(F.when(F.col("address").contains(":"), F.col("address")))
    blocked = F.coalesce(F.when(F.col("address").contains(":"), blocked_v6).otherwise(is_blocked_v4(F.col("address"))), F.lit(False))
    return rows.withColumn("outcome", _outcome(blocked))
