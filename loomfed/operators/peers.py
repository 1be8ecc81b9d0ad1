"""Peer selection, membership with time to live, and the address book.

Timestamps are integer nanoseconds.  Samples are exact-n and deterministic:
peers are ordered by the MD5 of seed and peer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folds import ordered_fold

TTL_NS = 90_000_000_000
BOOK_CAP = 16_384


def ticket(seed: int | str, peer: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), peer.cast("string")))


def select_random(peers: DataFrame, n: int, seed: int | str) -> DataFrame:
    """Exactly ``n`` distinct peers (all, if fewer), the same for the same seed."""
    return peers.select("peer").distinct().orderBy(ticket(seed, F.col("peer")), "peer").limit(n)


def select_near(peers: DataFrame, key: int, n: int) -> DataFrame:
    """The ``n`` peers whose integer ids are nearest to ``key`` by XOR."""
    return peers.select("peer").distinct().orderBy(F.col("peer").cast("long").bitwiseXOR(F.lit(key).cast("long")), "peer").limit(n)


def select_all(peers: DataFrame) -> DataFrame:
    return peers.select("peer").distinct()


sample = select_random
current_view = select_all


def throttle_announces(announces: DataFrame, heartbeat_ns: int = TTL_NS // 3) -> DataFrame:
    """The announcements a client sends: one at most each heartbeat since the last one sent."""
    def step(state: int | None, row: dict) -> tuple[int | None, dict]:
        sent = state is None or row["ts_ns"] - state >= heartbeat_ns
        return (row["ts_ns"] if sent else state), {"sent": sent}

    return ordered_fold(announces, ["peer"], ["ts_ns", "id"], lambda: None, step, "sent boolean")


def register(announces: DataFrame, ttl_ns: int = TTL_NS) -> tuple[DataFrame, DataFrame]:
    """The registry ``peer, last_ns, expires_ns``, and announcements without an address."""
    empty = F.coalesce(F.size("addresses"), F.lit(0)) <= 0
    ok = announces.filter(~empty).groupBy("peer").agg(F.max("ts_ns").alias("last_ns"))
    return ok.withColumn("expires_ns", F.col("last_ns") + F.lit(ttl_ns)), announces.filter(empty).withColumn("reason", F.lit("BadInput"))


def handshake(clients: DataFrame, ttl_ns: int = TTL_NS, server: str = "server", addresses: Sequence[str] = ()) -> DataFrame:
    """What a server answers each client: its time to live, heartbeat, own name and addresses."""
    listed = F.array(*[F.lit(a) for a in addresses]).cast("array<string>")
    return clients.select("peer", F.lit(ttl_ns).alias("ttl_ns"), F.lit(ttl_ns // 3).alias("heartbeat_ns"), F.lit(server).alias("server"), listed.alias("addresses"))


def merge_handshakes(books: DataFrame, answers: DataFrame) -> DataFrame:
    """The clients' address books after the answers: ``client, peer, addresses, refs``.

    ``books`` has the same columns.  The server is announced to the client's
    book: a known one gets one reference more and the addresses it lacks at the
    end; an answer without addresses changes nothing.
    """
    new = answers.filter(F.size("addresses") > 0).select(F.col("peer").alias("client"), F.col("server").alias("peer"), F.array_distinct("addresses").alias("_new"))
    both = books.join(new, ["client", "peer"], "full_outer")
    merged = F.array_distinct(F.concat(F.coalesce("addresses", F.array().cast("array<string>")), F.coalesce("_new", F.array().cast("array<string>"))))
    refs = F.coalesce("refs", F.lit(0)) + F.col("_new").isNotNull().cast("int")
    return both.select("client", "peer", merged.alias("addresses"), refs.cast("long").alias("refs"))


@dataclass(frozen=True)
class ConstantView:
    """A fixed list of peers: the same answer each call, an error if there is none."""

    spark: SparkSession
    peers: Sequence

    def current(self) -> DataFrame:
        if not self.peers:
            raise ValueError("the view has no peers")
        return self.spark.createDataFrame([(p,) for p in dict.fromkeys(self.peers)], ["peer"])

    def random(self, n: int, seed: int | str) -> DataFrame:
        return select_random(self.current(), n, seed)

    def near(self, key: int, n: int) -> DataFrame:
        return select_near(self.current(), key, n)


def live(registry: DataFrame, now_ns: int) -> DataFrame:
    """Peers that have not expired; a peer expires when ``now >= expires``."""
    return registry.filter(F.col("expires_ns") > F.lit(now_ns))


def registry_sample(registry: DataFrame, now_ns: int, n: int, seed: int | str) -> DataFrame:
    return select_random(live(registry, now_ns), n, seed)


def insert_addresses(entries: DataFrame) -> DataFrame:
    """The address book: rows ``peer, pos, address`` become ordered lists without repeats.

    A peer's distinct addresses are first reduced to their first position.
    """
    first = entries.groupBy("peer", "address").agg(F.min("pos").alias("pos"))
    listed = first.groupBy("peer").agg(F.array_sort(F.collect_list(F.struct("pos", "address"))).alias("a"))
    return listed.select("peer", F.transform("a", lambda s: s["address"]).alias("addresses"))


def insert_many(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batches ``peer, seq, addresses``; an empty batch is rejected."""
    empty = F.coalesce(F.size("addresses"), F.lit(0)) <= 0
    flat = batches.filter(~empty).select("peer", "seq", F.posexplode("addresses").alias("p", "address"))
    entries = flat.select("peer", (F.col("seq") * 1_000_000 + F.col("p")).alias("pos"), "address")
    return insert_addresses(entries), batches.filter(empty).withColumn("reason", F.lit("BadInput"))


def lookup(wanted: DataFrame, book: DataFrame) -> DataFrame:
    """``peer, addresses, status``: status is ``NotRegistered`` where the book has none."""
    found = wanted.join(book, "peer", "left")
    return found.withColumn("status", F.when(F.coalesce(F.size("addresses"), F.lit(0)) > 0, F.lit("ok")).otherwise(F.lit("NotRegistered")))


Book = dict[object, tuple[int, tuple[str, ...]]]


def book_step(book: Book, action: str, peer: object, addresses: Sequence[str] | None, cap: int) -> tuple[Book, str]:
    """The book after an action, and ``ok`` or why it was refused.

    ``add`` counts a reference and appends new addresses, ``drop`` takes a
    reference and at the last one the entry, ``register`` and ``forget`` change
    the addresses of an entry and leave its count.
    """
    entry, given = book.get(peer), [] if addresses is None else list(addresses)
    if action == "add":
        if not given:
            return book, "EmptyAddressList"
        if entry is None and len(book) >= cap:
            return book, "Full"
        refs, known = entry or (0, ())
        book[peer] = refs + 1, tuple(dict.fromkeys([*known, *given]))
    elif entry is None:
        return book, "UnknownPeer"
    elif action == "drop":
        if entry[0] <= 1:
            del book[peer]
        else:
            book[peer] = entry[0] - 1, entry[1]
    elif action == "register":
        book[peer] = entry[0], tuple(dict.fromkeys([*entry[1], *given]))
    else:
        book[peer] = entry[0], tuple(a for a in entry[1] if a not in given)
    return book, "ok"


def address_book(events: DataFrame, cap: int = BOOK_CAP, key: str = "book", order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """Each action on a book with ``status``, and ``refs`` and ``addresses`` of its peer after it.

    ``events``: ``book, ts, id, peer, action, given array``, with the actions
    ``add``, ``drop``, ``register`` and ``forget``.  A book holds ``cap`` peers.
    """
    def step(state: Book, row: dict) -> tuple[Book, dict]:
        state, status = book_step(state, row["action"], row["peer"], row["given"], cap)
        refs, addresses = state.get(row["peer"], (0, ()))
        return state, {"status": status, "refs": refs, "addresses": list(addresses)}

    return ordered_fold(events, [key], order, dict, step, "status string, refs long, addresses array<string>")


def reference_counts(folded: DataFrame, key: str = "book", order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """``book, peer, refs, addresses`` of the entries that stand after the last action of :func:`address_book`."""
    last = folded.groupBy(key, "peer").agg(F.max(F.struct(*order, "refs", "addresses")).alias("_l"))
    return last.select(key, "peer", "_l.refs", "_l.addresses").filter("refs > 0")
