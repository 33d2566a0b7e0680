"""Placement of keys on servers: a hash ring, virtual nodes by key prefix, replicas, migration.

Rings and virtual nodes have a fixed size, whatever the data: 40 places a server and 256 nodes.
They are computed on the driver; keys meet them as a broadcast table, or by a native expression.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass
from functools import cached_property
from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrilake.operators.pattern import Kind, Query

# Fixed values of the hashes and of the virtual nodes.
OFFSET_64, PRIME_64 = 14695981039346656037, 1099511628211
OFFSET_32, PRIME_32 = 2166136261, 16777619
PLACES, NODES = 40, 256
SPECIALS = "_-./,:;!@#$%^&*()"
PAIRS = ("St", "Fi", "Da", "Ti", "Us", "Pr", "Sp", "Ke", "Va", "Ex", "Co", "In", "Re", "De", "Tr", "Lo", "Po", "Pa", "Mo", "Se")
PREFIXES = (*ascii_lowercase, *ascii_uppercase, *digits, *SPECIALS, *PAIRS, "")
REPLICA_SHARE = 0.1


def hash64(text: str, seed: int = 0) -> int:
    """FNV-1a over UTF-8 bytes taken as signed, modulo 2^64."""
    h = OFFSET_64 + seed
    for b in text.encode():
        h = ((h ^ (b - 256 if b > 127 else b)) * PRIME_64) & (1 << 64) - 1
    return h


def hash64_column(text: Column) -> Column:
    """``hash64`` as an expression: decimal(20,0), computed in two halves of 32 bits."""
    mask = F.lit((1 << 32) - 1)
    raw, n = text.cast("binary"), F.octet_length(text)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long"))
    start = F.struct(F.lit(OFFSET_64 >> 32).cast("long").alias("high"), F.lit(OFFSET_64 & (1 << 32) - 1).cast("long").alias("low"))

    def step(h, b):
        # a byte over 127 is negative: its sign fills all the bits above it
        low = h["low"].bitwiseXOR(F.when(b > 127, b + ((1 << 32) - 256)).otherwise(b))
        high = h["high"].bitwiseXOR(F.when(b > 127, mask).otherwise(F.lit(0)).cast("long"))
        small = PRIME_64 - (1 << 40)
        more = low * small
        return F.struct((high * small + F.shiftright(more, 32) + low * 256).bitwiseAND(mask).alias("high"), more.bitwiseAND(mask).alias("low"))

    return F.aggregate(octets, start, step, lambda h: (h["high"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + h["low"]).cast("decimal(20,0)"))


def hash32(text: str) -> int:
    h = OFFSET_32
    for b in text.encode():
        h = ((h ^ (b - 256 if b > 127 else b)) * PRIME_32) & (1 << 32) - 1
    return h


def replication_factor(servers: int, share: float = REPLICA_SHARE) -> int:
    return max(1, int(servers * share))


@dataclass(frozen=True)
class Placement:
    servers: int
    factor: int | None = None

    @property
    def replicas(self) -> int:
        return replication_factor(self.servers) if self.factor is None else self.factor

    @cached_property
    def ring(self) -> list[tuple[int, int]]:
        return sorted((hash64(f"server{s}_{i}"), s) for s in range(self.servers) for i in range(PLACES))

    def _place(self, text: str) -> int:
        return bisect.bisect_left(self.ring, (hash64(text), -1)) % len(self.ring)

    def server_of(self, text: str) -> int:
        """The first server on the ring at or after the text's hash."""
        return self.ring[self._place(text)][1] if self.ring else 0

    def following(self, text: str, n: int) -> list[int]:
        """The first ``n`` different servers from there on around the ring."""
        return self._after(self._place(text), n)

    def _after(self, at: int, n: int) -> list[int]:
        found: list[int] = []
        for k in range(len(self.ring)):
            s = self.ring[(at + k) % len(self.ring)][1]
            if s not in found:
                found.append(s)
                if len(found) == n:
                    break
        return found

    @cached_property
    def nodes(self) -> list[tuple[int, str, int]]:
        """(node, prefix, server): the prefixes in turn, over and over."""
        return [(i, PREFIXES[i % len(PREFIXES)], self.server_of(f"vnode_{i}")) for i in range(NODES)]

    def node_of(self, key: str) -> int:
        """The first node whose prefix starts the key; the empty prefix starts all."""
        return next(i for i, p, _ in self.nodes if key.startswith(p))

    def servers_of(self, key: str) -> list[int]:
        """The key's own server, then replicas from the ring."""
        own = self.nodes[self.node_of(key)][2]
        others = [s for s in self.following(key, min(self.replicas + 1, self.servers)) if s != own]
        return [own, *others[: self.replicas]]

    def for_prefix(self, prefix: str) -> list[int]:
        return list(dict.fromkeys(s for _, p, s in self.nodes if p.startswith(prefix) or prefix.startswith(p)))

    def for_query(self, query: str) -> list[int]:
        """Servers that may hold matches. Suffixes and infixes may lie anywhere, so all servers."""
        key = Query.parse(query).key
        if key.kind is Kind.EXACT:
            return self.servers_of(key.token)
        return self.for_prefix(key.token) if key.kind is Kind.PREFIX else list(range(self.servers))

    def by_server(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {s: [] for s in range(self.servers)}
        for i, _, s in self.nodes:
            out[s].append(i)
        return out

    def ring_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(str(h), s) for h, s in self.ring], "position string, server_id int").withColumn("position", F.col("position").cast("decimal(20,0)"))

    def node_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, "node_id int, prefix string, server_id int")

    def node_column(self, key: Column) -> Column:
        """``node_of`` as an expression: nodes have one-letter prefixes first, so one lookup does."""
        first = {p: i for i, p in reversed(list(enumerate(PREFIXES))) if len(p) == 1}
        table = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
        return F.coalesce(F.try_element_at(table, F.substring(key, 1, 1)), F.lit(PREFIXES.index("")))

    def server_column(self, key: Column) -> Column:
        return F.element_at(F.array(*(F.lit(s) for _, _, s in self.nodes)), self.node_column(key) + 1)


    def place_column(self, key: Column) -> Column:
        """How many places of the ring lie before the key's hash, by halves; the key is hashed once."""
        positions = ",".join(str(h) for h, _ in self.ring)
        ring = F.expr(f"cast(split('{positions}', ',') as array<decimal(20,0)>)")
        steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(self.ring).bit_length()))))
        start = F.struct(hash64_column(key).alias("hash"), F.lit(0).alias("place"))

        def halve(state, step):
            beyond = state["place"] + step
            # past the end there is no position, which is not before anything
            place = F.when(F.get(ring, beyond - 1) < state["hash"], beyond).otherwise(state["place"])
            return F.struct(state["hash"].alias("hash"), place.alias("place"))

        return F.aggregate(steps, start, halve, lambda state: state["place"] % len(self.ring))

    def servers_column(self, key: Column, factor: Column | None = None) -> Column:
        """``servers_of`` as an expression, or ``adaptive_servers_of`` with a column of factors."""
        n = min(self.replicas + 1, self.servers)
        after = ";".join(",".join(map(str, self._after(at, n))) for at in range(len(self.ring)))
        following = F.split(F.element_at(F.expr(f"split('{after}', ';')"), self.place_column(key) + 1), ",").cast("array<int>")
        own = self.server_column(key)
        others = F.slice(F.filter(following, lambda s: s != own), 1, F.lit(self.replicas) if factor is None else F.least(factor, F.lit(self.replicas)))
        return F.concat(F.array(own), others)

    def prefix_column(self, prefix: Column) -> Column:
        """``for_prefix`` as an expression."""
        nodes = F.array(*(F.struct(F.lit(p).alias("prefix"), F.lit(s).alias("server")) for _, p, s in self.nodes))
        fits = F.filter(nodes, lambda n: n["prefix"].startswith(prefix) | F.startswith(prefix, n["prefix"]))
        return F.array_distinct(F.transform(fits, lambda n: n["server"]))

    def query_column(self, query: Column, factor: Column | None = None) -> Column:
        """``for_query`` as an expression over a column of queries; ``factor`` bounds an exact key's replicas."""
        key = F.substring_index(query, "=", 1)
        everywhere = F.sequence(F.lit(0), F.lit(self.servers - 1))
        starts, ends = key.startswith("*"), key.endswith("*")
        token = F.substring(key, F.lit(1), F.char_length(key) - 1)
        return F.when(~starts & ~ends, self.servers_column(key, factor)).when((~starts & ends) | (key == "**"), self.prefix_column(token)).otherwise(everywhere)

    def adaptive_servers_of(self, key: str, factor: int) -> list[int]:
        """The key's own server and as many of its usual replicas as its popularity earns."""
        own, *others = self.servers_of(key)
        return [own, *others[:factor]]


def migration(spark: SparkSession, old: Placement, new: Placement) -> DataFrame:
    """Nodes that change their server: node_id, prefix, from_server, to_server."""
    before = old.node_table(spark).withColumnRenamed("server_id", "from_server")
    after = new.node_table(spark).select("node_id", F.col("server_id").alias("to_server"))
    return before.join(F.broadcast(after), "node_id").filter("from_server <> to_server")  # NODES rows


def save_mapping(p: Placement, spark: SparkSession, path: str, magic: str = "ATTRILAKE_MAPPING_V1") -> None:
    """The mapping as one text file: magic, servers and replicas, node count, prefixes, servers."""
    lines = [magic, f"{p.servers} {p.replicas}", str(len(p.nodes)), *(f"{i} {x}" for i, x, _ in p.nodes), *(f"{i} {s}" for i, _, s in p.nodes)]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_mapping(spark: SparkSession, path: str, servers: int) -> DataFrame:
    """node_id, prefix, server_id of a mapping file; refused if it is for another number of servers."""
    lines = spark.read.text(path, wholetext=True).first()[0].split("\n")
    if not lines[0].endswith("_MAPPING_V1"):
        raise ValueError("not a mapping")
    if int(lines[1].split()[0]) != servers:
        raise ValueError(f"the mapping is for {lines[1].split()[0]} servers, not {servers}")
    n = int(lines[2])
    prefixes = dict((int(i), p) for i, _, p in (x.partition(" ") for x in lines[3 : 3 + n]))
    owners = dict(map(int, x.split()) for x in lines[3 + n : 3 + 2 * n])
    return spark.createDataFrame([(i, prefixes[i], owners[i]) for i in sorted(prefixes)], "node_id int, prefix string, server_id int")
