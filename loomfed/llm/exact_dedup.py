"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]``
has become one space; a null text counts as empty.  Three stages combine
copies, and each one groups by the SHA-256 digest *and* the full normalised
text, so that a digest collision can never merge two texts:

1. **local** – the map side of the first aggregation keeps one row per text
   in each task, however many copies the task has read;
2. **salted** – those rows meet by (digest, text, salt).  The salt comes from
   the document's id, so the copies of a hot text meet in ``salts`` tasks;
3. **global** – at most ``salts`` winners a text meet and leave one.

Then each document looks its group up by digest.  A group that has more than
one row in ``HOT_SHARE`` of those in groups of two or more is hot: there are
fewer than ``HOT_SHARE`` such groups, so they are broadcast, and their rows are
not shuffled.  The others are joined by digest, and none of them can fill a task.

Defined results: an empty table gives an empty one; a null id sorts after
every other one and stays only if its whole group has null ids; rows that
repeat an id with an equal text count in ``group_size``, and one of them
stays (of ``drop_copies`` the one whose columns have the smallest hash, as
JSON).  Columns besides id and text play no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise

SALTS = 16
HOT_SHARE = 4_096


def _named(name: str) -> Column:
    return F.col(f"`{name}`")


def _normal(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(_named(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(_named(id_col).alias("_id"), _normal(text_col).alias("_text")).withColumn("_sha", F.sha2("_text", 256))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: ``_sha, _text, _keep, _size``."""
    salt = F.pmod(F.xxhash64(F.col("_id")), F.lit(salts)).cast("int")
    salted = (
        _digested(docs, id_col, text_col)
        .groupBy("_sha", "_text", salt.alias("_salt"))
        .agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    )
    return salted.groupBy("_sha", "_text").agg(F.min("_keep").alias("_keep"), F.sum("_size").alias("_size"))


@dataclass
class _Copies:
    """Groups of two or more, and the digests of all documents.

    ``own`` has ``_id, _sha`` and the place of each row, ``_file`` and ``_row``;
    ``hot`` and ``cold`` have ``_sha, _keep, _size`` and ``_first``, the place of
    the row that stays where several rows have the id that stays; ``keys`` are
    the digest, and the text too if two texts ever shared a digest.
    """

    own: DataFrame
    hot: DataFrame | None
    cold: DataFrame
    twins: DataFrame | None
    keys: list[str]


def _copies(docs: DataFrame, id_col: str, text_col: str, salts: int) -> _Copies:
    groups = copy_groups(docs, id_col, text_col, salts)
    slim, _ = materialise(groups.select("_sha", "_keep", "_size"), "copies")
    collided = not slim.groupBy("_sha").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    keys = ["_sha", "_text"] if collided else ["_sha"]
    found = (groups if collided else slim).filter("_size > 1").select(*keys, "_keep", "_size")
    own, _ = materialise(_digested(docs, id_col, text_col).select("_id", *keys), "digests")
    own = own.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    place = F.struct("_file", "_row")
    repeated = own.groupBy("_id", *keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    twins = None
    if not repeated.isEmpty():
        twins = own.groupBy("_id", *keys).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("_first")).filter("n > 1").drop("n")
        same = [F.col(f"g.{k}") == F.col(f"t.{k}") for k in keys]
        found = found.alias("g").join(twins.alias("t"), [*same, F.col("g._keep").eqNullSafe(F.col("t._id"))], "left").select("g.*", "t._first")
        found, _ = materialise(found, "groups")
    else:
        found = found.withColumn("_first", F.lit(None).cast(own.select(place.alias("p")).schema["p"].dataType))
    if collided:
        return _Copies(own, None, found, twins, keys)
    total = found.agg(F.sum("_size")).first()[0] or 0
    large = F.col("_size") * HOT_SHARE > F.lit(total)
    return _Copies(own, found.filter(large), found.filter(~large), twins, keys)


def _looked_up(c: _Copies) -> DataFrame:
    """``own`` with ``_keep, _size, _first`` of each row's group; null for a text of one row."""
    if c.hot is None:
        return c.own.join(c.cold, c.keys, "left")
    in_hot = c.own.join(F.broadcast(c.hot), c.keys)
    others = c.own.join(F.broadcast(c.hot.select(*c.keys)), c.keys, "left_anti").join(c.cold, c.keys, "left")
    return in_hot.unionByName(others)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Every document with ``keep_id, group_size, kept, text_sha256``; dropped ones too."""
    rows = _looked_up(_copies(docs, id_col, text_col, salts))
    single = F.col("_size").isNull()
    first = F.coalesce(F.col("_first") == F.struct("_file", "_row"), F.lit(True))
    return rows.select(
        F.col("_id").alias(id_col),
        F.when(single, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast(T.LongType()).alias("group_size"),
        (single | (F.col("_id").eqNullSafe(F.col("_keep")) & first)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The documents that stay, with all their columns."""
    c = _copies(docs, id_col, text_col, salts)
    # the documents' own columns travel inside one, so that no name can clash
    whole = docs.select(_named(id_col).alias("_id"), _normal(text_col).alias("_text"), F.struct(*[_named(x) for x in docs.columns]).alias("_doc"))
    whole = whole.select("_id", F.sha2("_text", 256).alias("_sha"), *c.keys[1:], "_doc")
    lost = c.own.join(c.cold.select(*c.keys, "_keep"), c.keys).filter(~F.col("_id").eqNullSafe(F.col("_keep"))).select("_id", *c.keys).distinct()
    if c.hot is not None:
        whole = whole.join(F.broadcast(c.hot.select("_sha", F.col("_keep").alias("_hot_keep"), F.lit(True).alias("_hot"))), "_sha", "left")
        whole = whole.filter(F.col("_hot").isNull() | F.col("_id").eqNullSafe(F.col("_hot_keep"))).drop("_hot", "_hot_keep")

    def same(other: str) -> Column:
        on = F.col("d._id").eqNullSafe(F.col(f"{other}._id"))
        for k in c.keys:
            on = on & (F.col(f"d.{k}") == F.col(f"{other}.{k}"))
        return on

    left = whole.alias("d").join(lost.alias("l"), same("l"), "left_anti")
    if c.twins is not None:
        doubled = left.alias("d").join(c.twins.alias("t"), same("t"), "left_semi")
        one = doubled.groupBy("_id", *c.keys).agg(F.min_by("_doc", F.xxhash64(F.to_json("_doc"))).alias("_doc"))
        left = left.alias("d").join(c.twins.alias("t"), same("t"), "left_anti").select("_doc").unionByName(one.select("_doc"))
    return left.select("_doc.*")
