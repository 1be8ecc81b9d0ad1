"""Set-similarity join of word n-grams by a grouped prefix join.

A document is the set of its distinct ``width``-word shingles, as 64-bit
hashes.  Two documents link when ``100 * |A and B| >= percent * |A or B|``.

1. **Order.**  Shingles are put into one global order: common ones last.  The
   common ones are heavy hitters counted over all documents (``heavy_terms``
   of them at most are told apart; the order decides speed, never results).
2. **Groups.**  Two sets that link share a shingle of their prefixes, the
   first ``n - ceil(t n) + 1`` in that order.  Documents with the same prefix
   and size collapse into one group, and a document of each posts the prefix
   (others may too, where the sieve of their ids lets them pass; equal postings
   are one).  Lists of common shingles are dealt by shingle and salt.
3. **Stars.**  In each posting list, every group is paired with one head of the
   list, the group that shares most of its prefix, so a list of many near copies
   gives a linear number of pairs.  Pairs pass length and position filters, are
   expanded to the distinct sets of the groups (each with the other's first one),
   and verified on whole sets.  The set of a document of many pairs is sent in
   copies, one for ``HUB_PAIRS`` of them, so no task has all pairs of a hub.
4. **The rest.**  Components of the verified links are found, and the lists
   that still hold more than one component are joined with themselves by shingle
   and band of size, under the same filters, for pairs of sets that lie in
   different components.  A pair inside one component cannot change any
   component, so no needed link is lost and no list is cut.

Defined results: a null or blank text has an empty set and links with nothing;
a text of fewer than ``width`` words is one shingle; rows with a null id get
their set size and a null component; rows that repeat an id are one document,
linked if one of its texts links; an empty table gives an empty one.  Ids are
cast to long (a text that is no number is null).  Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .array_sum import id_sieve, in_sieve
from .arrowtext import distinct_sorted, hash_spans, mix, shingle_hashes, text_slices, word_spans
from .components import connected_components
from .shared import discard, materialise

HEAVY_TERMS = 1 << 18
HEAVY_LOCAL = 4
FIRST_TOKENS = 16
HOT_SHARE = 4_096
HOT_LEAST = 32
TOKEN_SALTS = 64
HUB_PAIRS = 64


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, distinct shingle hashes and offsets, slice by slice."""
    for base, data, offsets in text_slices(column):
        starts, ends, rows = word_spans(data, offsets)
        shingles, cuts = shingle_hashes(hash_spans(data, starts, ends), rows, len(offsets) - 1, width)
        yield base, *distinct_sorted(shingles, cuts)


def heavy_shingles(docs: DataFrame, text_col: str, width: int, limit: int = HEAVY_TERMS, local: int = HEAVY_LOCAL) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles, sorted by hash, and how often they were counted.

    A task counts a shingle when it stands in ``local`` documents of one of
    its runs; the counts of all tasks are summed.  ``limit`` bounds what
    comes to the driver.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            both = np.concatenate(held) if held else np.empty(0, dtype=np.uint64)
            both.sort()
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.empty(0, dtype=np.int64)
            n = np.diff(np.append(first, len(both)))
            keep = n >= local
            return pa.RecordBatch.from_arrays([pa.array(both[first[keep]].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["h", "n"])

        for batch in batches:
            for _, values, _ in _sets(batch.column(0), width):
                held.append(values)
                size += len(values)
                if size > 1 << 22:
                    yield flush()
                    held, size = [], 0
        yield flush()

    counted = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "h").limit(limit).toArrow()
    h = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["n"].to_numpy()[order]


def _prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def _prefixes(values: np.ndarray, cuts: np.ndarray, percent: int, heavy: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of each set in the global order, and offsets."""
    heavy_hash, heavy_count = heavy
    weight = np.zeros(len(values), dtype=np.int64)
    if len(heavy_hash):
        at = np.searchsorted(heavy_hash, values)
        at[at == len(heavy_hash)] = 0
        weight = np.where(heavy_hash[at] == values, heavy_count[at], 0)
    n = np.diff(cuts)
    length = _prefix_length(n, percent)
    prefix = [np.empty(0, dtype=np.uint64)]
    for a, b, p in zip(cuts[:-1].tolist(), cuts[1:].tolist(), length.tolist(), strict=True):
        own = values[a:b]
        if weight[a:b].any():
            own = own[np.argsort(weight[a:b], kind="stable")]
        prefix.append(own[:p])
    return np.concatenate(prefix), np.concatenate([[0], np.cumsum(length)]).astype(np.int64)


def _row_sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    upto = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
    return (upto[cuts[1:]] - upto[cuts[:-1]]).view(np.int64)


def _prefix_digest(flat: np.ndarray, ends: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One number for each prefix and size."""
    rank = np.arange(len(flat), dtype=np.uint64) - np.repeat(ends[:-1], np.diff(ends)).astype(np.uint64)
    return _row_sums(mix(flat + rank * np.uint64(0x9E3779B97F4A7C15)), ends) ^ mix(n.astype(np.uint64)).view(np.int64)


def _signatures(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, heavy: Broadcast) -> DataFrame:
    """``id, n``, ``d1, d2`` (digest of the set) and ``p1`` (digest of the prefix) of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, values, cuts in _sets(batch.column(1), width):
                n = np.diff(cuts)
                d1, d2 = _row_sums(mix(values), cuts), _row_sums(mix(values ^ np.uint64(0x5851F42D4C957F2D)), cuts)
                p1 = _prefix_digest(*_prefixes(values, cuts, percent, heavy.value), n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(base, len(n)), pa.array(n.astype(np.int32)), *map(pa.array, (d1, d2, p1))], ["id", "n", "d1", "d2", "p1"])

    return _narrow(docs, id_col, text_col).mapInArrow(run, "id long, n int, d1 long, d2 long, p1 long")


def _postings(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, heavy: Broadcast, sieve: Broadcast, hot_from: int) -> DataFrame:
    """``token, p1, at, hot``: each shingle of a prefix, its group, its size and place as ``n << 32 | i``, and whether it is common."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy_hash, heavy_count = heavy.value
        common = heavy_hash[heavy_count >= hot_from]
        for batch in batches:
            batch = batch.filter(pa.array(in_sieve(sieve.value, batch.column(0).to_numpy(zero_copy_only=False))))
            for _, values, cuts in _sets(batch.column(1), width):
                flat, ends = _prefixes(values, cuts, percent, heavy.value)
                length = np.diff(ends)
                place = np.repeat(np.diff(cuts) << 32, length) + np.arange(len(flat)) - np.repeat(ends[:-1], length)
                digest = np.repeat(_prefix_digest(flat, ends, np.diff(cuts)), length)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(digest), pa.array(place), pa.array(np.isin(flat, common))], ["token", "p1", "at", "hot"])

    return _narrow(docs, id_col, text_col).filter("id is not null").mapInArrow(run, "token long, p1 long, at long, hot boolean")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.expr(f"try_cast(`{id_col}` AS long)").alias("id"), F.col(f"`{text_col}`").alias("text"))


def document_sets(docs: DataFrame, id_col: str, text_col: str, width: int, sieve: Broadcast | None = None) -> DataFrame:
    """``id, tokens array<long>``: the whole set of each document that the sieve lets pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sieve is not None:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(in_sieve(sieve.value, ids)))
            for base, values, cuts in _sets(batch.column(1), width):
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(base, len(cuts) - 1), lists], ["id", "tokens"])

    own = _narrow(docs, id_col, text_col).filter("id is not null")
    return own.mapInArrow(run, "id long, tokens array<long>")


def _may_link(one: tuple[Column, ...], two: tuple[Column, ...], percent: int) -> Column:
    """Length, position and prefix filters of two sets that share a shingle of their prefixes.

    A side is ``(n, i, r, k)``: the set's size, the shingle's place, and how many
    shingles that stand in any other set at all its prefix has before that
    place and in all.  Two sets share at most what both may share before their
    places and what is left from there on; and at most what their prefixes may
    share and what is left after the prefix that ends first.
    """
    (n1, i1, r1, k1), (n2, i2, r2, k2) = one, two
    after = [F.floor((percent * n + 99) / 100).cast("int") - 1 for n in (n1, n2)]
    from_here = F.least(r1, r2) + F.least(n1 - i1, n2 - i2)
    beyond = F.least(k1, k2) + F.greatest(*after)
    enough = (100 + percent) * F.least(from_here, beyond) >= percent * (n1 + n2)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & enough


class NgramJoin:
    """The join of one table; its intermediate tables are in the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, heavy_terms: int = HEAVY_TERMS) -> None:
        self.docs, self.id_col, self.text_col, self.width, self.percent = docs, id_col, text_col, width, percent
        self.spark, self.paths = docs.sparkSession, []
        self.heavy = self.spark.sparkContext.broadcast(heavy_shingles(docs, text_col, width, heavy_terms))
        self.signatures = self._keep(_signatures(docs, id_col, text_col, width, percent, self.heavy), "signatures")

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        kept, path = materialise(df, name)
        self.paths.append(path)
        return kept

    def _sieve(self, ids: DataFrame, count: int) -> Broadcast:
        return self.spark.sparkContext.broadcast(id_sieve(ids, ids.columns[0], count))

    def _verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs of sets ``a < b`` that link, on their whole sets.

        The side of a pair that stands in most pairs is ``u``; fewer than
        ``HOT_SHARE`` ids are hubs, and each hub's set goes to its pairs in copies.
        """
        n = pairs.count()
        ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
        hubs = ends.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > max(2 * n // HOT_SHARE, HUB_PAIRS))
        hubs = F.broadcast(self._keep(hubs.withColumn("copies", F.ceil(F.col("c") / HUB_PAIRS).cast("int")), "hubs"))
        of = lambda side: hubs.select(F.col("id").alias(side), F.col("c").alias(f"c{side}"), F.col("copies").alias(f"k{side}"))
        known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        turned = F.coalesce("cb", F.lit(0)) > F.coalesce("ca", F.lit(0))
        u, v = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
        copies = F.coalesce(F.when(turned, F.col("kb")).otherwise(F.col("ka")), F.lit(1))
        dealt = known.select(u.alias("u"), v.alias("v"), F.pmod(F.xxhash64(v), copies).cast("int").alias("copy"))
        sieve = self._sieve(ends, 2 * n)
        # both joins read one shuffle of the sets, by id
        sets = document_sets(self.docs, self.id_col, self.text_col, self.width, sieve).repartition("id")
        many = sets.join(hubs, "id", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
        both = dealt.join(sets.select(F.col("id").alias("v"), F.col("tokens").alias("y")), "v")
        both = both.join(many.select(F.col("id").alias("u"), "copy", F.col("tokens").alias("x")), ["u", "copy"])
        both = both.withColumn("_common", F.size(F.array_intersect("x", "y")))
        linked = both.filter(100 * F.col("_common") >= self.percent * (F.size("x") + F.size("y") - F.col("_common")))
        out = self._keep(linked.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), name)
        sieve.destroy()
        return out

    def _lists(self, groups: DataFrame) -> DataFrame:
        """``token, grp, n, i, r, k`` of each posting and ``hgrp, hn, hi, hr, hk`` of its list's head."""
        sieve = self._sieve(groups.select("grp"), groups.count())
        hot_from = max(HOT_LEAST, self.signatures.count() // HOT_SHARE)
        posted = _postings(self.docs, self.id_col, self.text_col, self.width, self.percent, self.heavy, sieve, hot_from)
        posted = posted.withColumn("salt", F.when(F.col("hot"), F.pmod("p1", F.lit(TOKEN_SALTS))).otherwise(0).cast("int"))
        part = Window.partitionBy("token", "salt")
        several = posted.withColumn("low", F.min("p1").over(part)).withColumn("high", F.max("p1").over(part)).filter("hot or low < high")
        shared = several.select("token", "salt", "hot", "p1", "at").distinct()
        n, i = F.shiftright("at", 32).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        of_group = Window.partitionBy("n", "p1")
        placed = shared.select("token", "hot", "p1", n.alias("n"), i.alias("i")).join(groups, ["n", "p1"])
        placed = placed.withColumn("r", F.row_number().over(of_group.orderBy("i")) - 1).withColumn("k", F.count(F.lit(1)).over(of_group).cast("int"))
        placed = self._keep(placed.select("token", "hot", "grp", "n", "i", "r", "k"), "placed")
        sieve.destroy()
        # the head of a list: the group that shares most of its prefix, so that of a family its origin
        head = F.min(F.struct((-F.col("k")).alias("most"), "grp", "n", "i", "r", "k"))
        rare = placed.filter("not hot").withColumn("head", head.over(Window.partitionBy("token")))
        common = placed.filter("hot")
        heads = F.broadcast(common.groupBy("token").agg(head.alias("head")))  # HEAVY_TERMS rows at most
        headed = rare.unionByName(common.join(heads, "token"))
        return self._keep(headed.select("token", "grp", "n", "i", "r", "k", *[F.col(f"head.{c}").alias(f"h{c}") for c in ("grp", "n", "i", "r", "k")]), "postings")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Verified links ``a, b`` between classes, and ``d1, d2, n, cls``: the class of each distinct set.

        A class is the smallest id of the documents with one set.  The links
        are enough for the components; pairs that could not change a
        component are left out.
        """
        sig = self.signatures.filter("n > 0 and id is not null")
        classes = self._keep(sig.groupBy("d1", "d2", "n", "p1").agg(F.min("id").alias("cls")), "classes")
        self.lasting = self.paths[:]
        grouped = classes.groupBy("n", "p1").agg(F.min("cls").alias("grp"), F.count(F.lit(1)).alias("m"))
        members = self._keep(classes.join(grouped, ["n", "p1"]).select("n", "p1", "grp", "m", "cls"), "groups")
        many = members.filter("m > 1").select("grp", "cls")
        lists = self._lists(members.filter("cls = grp").select("n", "p1", "grp"))

        # stars: each group with the head of its list, and each class with the first one of its own and of the other group
        sides = [tuple(F.col(h + c) for c in "nirk") for h in ("", "h")]
        stars = lists.filter((F.col("grp") != F.col("hgrp")) & _may_link(*sides, self.percent)).select(F.col("hgrp").alias("g"), F.col("grp").alias("h")).distinct()
        whole = stars.unionByName(stars.select(F.col("g").alias("h"), F.col("h").alias("g")))
        across = whole.join(many.withColumnRenamed("grp", "h"), "h").select("g", F.col("cls").alias("h"))
        inside = many.filter("cls > grp").select(F.col("grp").alias("g"), F.col("cls").alias("h"))
        tested = stars.unionByName(across).unionByName(inside).select(F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b"))
        tested = self._keep(tested.distinct(), "stars")
        first = self._keep(self._verify(tested, "verified").unionByName(self._repeated_ids(sig, classes)), "links")
        label = connected_components(first, "a", "b")

        # the rest: pairs of one list or group that lie in different components
        labelled = members.select("grp", "m", "cls").join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        labelled = self._keep(labelled, "labels")
        low, high = F.min("component"), F.max("component")
        spans = labelled.groupBy("grp").agg(F.when(low == high, low).alias("comp"))  # null: the group's sets lie apart
        split = lists.select("token", "grp", "n", "i", "r", "k").join(spans, "grp")
        several = (F.min("comp") < F.max("comp")) | F.max(F.col("comp").isNull())
        mixed = split.groupBy("token").agg(several.alias("several")).filter("several").select("token")
        first_tokens = lists.groupBy("grp").agg(F.slice(F.array_sort(F.collect_list("token")), 1, FIRST_TOKENS).alias("first"))
        left = self._keep(split.join(mixed, "token", "left_semi").join(first_tokens, "grp"), "mixed")
        names = ("grp", "n", "i", "r", "k", "comp", "first")
        x, y = (left.select(F.col("token").alias(f"token{k}"), *[F.col(c).alias(f"{c}{k}") for c in names]) for k in (1, 2))
        # of two sets that link the larger one is of the same band of size or the next
        band = lambda n: F.floor(F.log(n) / math.log(100 / self.percent) + 1e-9)
        x = x.withColumn("band", F.explode(F.array(band(F.col("n1")), band(F.col("n1")) + 1))) if self.percent < 100 else x.withColumn("band", F.col("n1"))
        y = y.withColumn("band2", band(F.col("n2")) if self.percent < 100 else F.col("n2"))
        apart = F.coalesce(F.col("comp1") != F.col("comp2"), F.lit(True))
        ordered = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("grp1") < F.col("grp2")))
        fits = _may_link(*[tuple(F.col(f"{c}{side}") for c in "nirk") for side in (1, 2)], self.percent)
        # a pair that shares several shingles comes from the list of the least one (if both have it among their first)
        least = F.coalesce(F.array_min(F.array_intersect("first1", "first2")) >= F.col("token1"), F.lit(True))
        met = x.join(y, (F.col("token1") == F.col("token2")) & (F.col("band") == F.col("band2")) & ordered & apart & fits & least).select(F.col("grp1").alias("g"), F.col("grp2").alias("h")).distinct()
        sets = labelled.select("grp", "cls", "component")
        of = lambda side: sets.select(F.col("grp").alias(side), F.col("cls").alias(f"_{side}"), F.col("component").alias(f"c{side}"))
        across = met.join(of("g"), "g").join(of("h"), "h").filter("cg != ch").select(F.least("_g", "_h").alias("a"), F.greatest("_g", "_h").alias("b"))
        within = labelled.filter("m > 1").select("grp", "cls", "component")
        pairs_in = within.alias("p").join(within.alias("q"), "grp").filter("p.cls < q.cls and p.component != q.component").select(F.col("p.cls").alias("a"), F.col("q.cls").alias("b"))
        rest = self._keep(across.unionByName(pairs_in).distinct().join(tested, ["a", "b"], "left_anti"), "rest")
        if rest.isEmpty():
            return first, classes
        return first.unionByName(self._verify(rest, "links")), classes

    @staticmethod
    def _repeated_ids(sig: DataFrame, classes: DataFrame) -> DataFrame:
        """Links between the classes of an id that stands beside several texts; mostly none."""
        sets = sig.select("id", "d1", "d2", "n").distinct()
        several = sets.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("id")
        if several.isEmpty():
            return classes.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0)
        own = sets.join(several, "id", "left_semi").join(classes, ["d1", "d2", "n"]).select("id", "cls")
        least = own.groupBy("id").agg(F.min("cls").alias("a"))
        return own.join(least, "id").filter("cls > a").select("a", F.col("cls").alias("b")).distinct()

    def components(self) -> DataFrame:
        """One row a document: the id, ``n_shingles`` and ``component_id``."""
        links, classes = self.links()
        label = connected_components(links, "a", "b")
        self._drop([p for p in self.paths if p not in self.lasting])
        named = classes.select("d1", "d2", "n", F.col("cls").alias("node")).join(label, "node", "left").select("d1", "d2", "n", F.coalesce("component", "node").alias("c"))
        out = self.signatures.select("id", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
        component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
        return out.select(F.col("id").alias(self.id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))

    def _drop(self, paths: list[str]) -> None:
        discard(self.spark, *paths)
        self.paths = [p for p in self.paths if p not in paths]

    def close(self) -> None:
        """Delete the tables that the result reads, when it has been written or is not wanted."""
        self._drop(self.paths)
        self.heavy.destroy()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: the id, ``n_shingles`` and ``component_id``."""
    return NgramJoin(docs, id_col, text_col, width, percent).components()


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest id of their group, with all their columns; those that link with nothing stay."""
    found = near_duplicates(docs, id_col, text_col, width, percent)
    lost = found.filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col)).distinct()
    return docs.join(lost, id_col, "left_anti").select(*[docs[c] for c in docs.columns])
