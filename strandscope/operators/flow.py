"""Flows, shards, connection epochs and idle sessions."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def canonical_flow(rows: DataFrame, *, src: str = "src", sport: str = "sport", dst: str = "dst", dport: str = "dport", protocol: str = "protocol", interface: str = "interface", vlans: str = "vlan_ids") -> DataFrame:
    """Add endpoint_a, endpoint_b, direction (0: from a to b) and flow_id; both directions of a flow share all but the direction.

    Endpoints are ordered by address as text, then by port.
    """
    source = F.struct(F.col(src).alias("address"), F.col(sport).alias("port"))
    target = F.struct(F.col(dst).alias("address"), F.col(dport).alias("port"))
    tags = F.concat_ws(",", F.transform(F.col(vlans), lambda v: v.cast("string"))) if vlans in rows.columns else F.lit("")
    out = rows.withColumns({"endpoint_a": F.least(source, target), "endpoint_b": F.greatest(source, target), "direction": (source > target).cast("int")})
    text = lambda e: F.concat_ws(":", F.col(f"{e}.address"), F.col(f"{e}.port").cast("string"))
    return out.withColumn(
        "flow_id",
        F.concat_ws("|", F.col(interface) if interface in rows.columns else F.lit("-"), F.when(tags == "", "-").otherwise(tags), F.col(protocol).cast("string"), text("endpoint_a"), text("endpoint_b")),
    )


def flow_endpoints(flow_id: Column, direction: Column) -> Column:
    """struct<source,destination> (address, port) of a flow id seen in a direction; nulls if either can't be told."""
    parts = F.split(flow_id, r"\|")
    end = lambda i: F.struct(F.regexp_extract(F.get(parts, i), r"^(.*):[0-9]+$", 1).alias("address"), F.try_to_number(F.regexp_extract(F.get(parts, i), r":([0-9]+)$", 1), F.lit("99999")).cast("int").alias("port"))
    known = (F.size(parts) == 5) & direction.isin(0, 1) & F.get(parts, 3).rlike(":[0-9]{1,5}$") & F.get(parts, 4).rlike(":[0-9]{1,5}$")
    a, b = end(F.lit(3)), end(F.lit(4))
    return F.when(known, F.struct(F.when(direction == 0, a).otherwise(b).alias("source"), F.when(direction == 0, b).otherwise(a).alias("destination")))


def stable_shard(key: Column, shards: int) -> Column:
    """A shard that every engine computes alike: the first 32 bits of the key's MD5, modulo ``shards``."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def connection_epochs(rows: DataFrame, keys: list[str], order: list[str], opens: Column, name: str = "epoch") -> DataFrame:
    """Add the number of openings of the flow so far; rows before the first opening (a capture that started late) are in epoch 0."""
    so_far = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(name, F.sum(F.coalesce(opens, F.lit(False)).cast("long")).over(so_far))


def idle_sessions(rows: DataFrame, keys: list[str], time: str, order: list[str], idle_seconds: int, name: str = "session") -> DataFrame:
    """Add the number of times that the key had been idle for ``idle_seconds`` or more."""
    window = W.partitionBy(*keys).orderBy(*order)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(window).cast("timestamp"))
    return connection_epochs(rows.withColumn("__idle", seconds >= idle_seconds * 1_000_000), keys, order, F.col("__idle"), name).drop("__idle")


def _ipv4_number(address: Column) -> Column:
    """An IPv4 address as a number; null for any other text."""
    parts = F.when(address.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), F.split(address, r"\."))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p.cast("long"))


@dataclass(frozen=True)
class PacketFilter:
    """Which segments and datagrams to look at: all that are named have to hold; of several values, one has to.

    A host, net (of IPv4, or a whole IPv6 address) or port holds for either
    end; ``without`` turns what it holds around. Everything is an expression on
    decoded columns, so Spark evaluates it before anything is exchanged.
    """

    hosts: frozenset[str] = frozenset()
    nets: frozenset[str] = frozenset()
    ports: frozenset[int] = frozenset()
    protocols: frozenset[int] = frozenset()
    vlans: frozenset[int] = frozenset()
    without: PacketFilter | None = None

    def column(self) -> Column:
        """Never null: a packet of which something asked for isn't known doesn't hold."""
        either = lambda test, a, b: F.coalesce(test(F.col(a)), F.lit(False)) | F.coalesce(test(F.col(b)), F.lit(False))
        held = F.lit(True)
        if self.hosts:
            own = sorted(str(ipaddress.ip_address(h)) for h in self.hosts)
            held = held & either(lambda c: c.isin(own), "src", "dst")
        if self.nets:
            held = held & either(self._in_nets(), "src", "dst")
        if self.ports:
            held = held & either(lambda c: c.isin(sorted(self.ports)), "sport", "dport")
        if self.protocols:
            held = held & F.coalesce(F.col("protocol").isin(sorted(self.protocols)), F.lit(False))
        if self.vlans:
            held = held & F.coalesce(F.arrays_overlap("vlan_ids", F.array(*(F.lit(v) for v in sorted(self.vlans)))), F.lit(False))
        return held & ~self.without.column() if self.without else held

    def _in_nets(self) -> Callable[[Column], Column]:
        nets = [ipaddress.ip_network(n) for n in sorted(self.nets)]
        if any(n.version == 6 and n.prefixlen < 128 for n in nets):
            raise ValueError("nets of IPv6 aren't supported, only whole addresses")

        def test(address: Column) -> Column:
            inside = F.lit(False)
            for n in nets:
                inside = inside | (_ipv4_number(address).between(int(n.network_address), int(n.broadcast_address)) if n.version == 4 else address == str(n.network_address))
            return inside

        return test
