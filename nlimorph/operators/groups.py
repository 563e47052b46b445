"""Whole-group sampling, caps and splits over (source_file, pair_key) groups.

Random order is the order of md5(seed|key): the same on any partitioning. A sample is what lies ahead of a cut in
that order, and the cut is found by radix selection: groups are summed by the first digits of their hash, the bucket in which
the total is reached is summed by its next digits, until it is small. Buckets ahead are taken and those behind are left without
being ordered; only the cut bucket is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nlimorph.functions.labels import py_strip
from nlimorph.sources.scratch import written

KEY = ["source_file", "pair_key"]


PIECE = 1 << 16


def ensure_pair_id(df: DataFrame, content: list[str], pair_id: str = "pair_id") -> DataFrame:
    """``pair_key``: the trimmed pair id; a row without one gets a key of its own, made from its content and its number among equal rows.

    n rows of one content get the numbers 1 to n however they are partitioned, so the keys of a table are always the
    same; which of the equal rows has which number is open. Equal rows are numbered in pieces of at most 65,536, and sums
    over the pieces ahead place each piece; no content goes to one task.
    """
    missing = F.col(pair_id).isNull()
    placed = written(df.where(missing).select("*", F.md5(F.to_json(F.struct(*content))).alias("_h"), F.monotonically_increasing_id().alias("_at")), "rows-without-id")
    rows = placed.withColumn("_piece", F.floor(F.col("_at") / PIECE))
    inside = F.row_number().over(Window.partitionBy("_h", "_piece").orderBy("_at"))
    ahead = F.sum("_n").over(Window.partitionBy("_h").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("_h", "_piece").agg(F.count("*").alias("_n")).select("_h", "_piece", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    numbered = rows.withColumn("_inside", inside).join(offsets, ["_h", "_piece"])
    key = F.concat_ws("_", F.lit("__row"), "_h", (F.col("_ahead") + F.col("_inside")).cast("string"))
    own = numbered.select(*df.columns, key.alias("pair_key"))
    return df.where(~missing).withColumn("pair_key", py_strip(F.col(pair_id).cast("string"))).unionByName(own)


def pair_groups(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY).agg(F.count("*").alias("n_rows"), F.count_if(F.col("mr_id") == "none").alias("n_sources"))


def group_size_hist(groups: DataFrame) -> DataFrame:
    return groups.groupBy("n_rows").agg(F.count("*").alias("n_groups"))


def primary_label(df: DataFrame) -> DataFrame:
    """Majority label of each group, the smallest of equals; what is not a number counts as 0."""
    number = F.when(F.col("label_is_int"), F.col("label").try_cast("bigint")).otherwise(0) if "label_is_int" in df.columns else F.col("label")
    return df.groupBy(*KEY).agg(F.mode(F.coalesce(number, F.lit(0)), deterministic=True).alias("primary_label"), F.count("*").alias("n_rows"))


def _shuffled(groups: DataFrame, seed: int) -> DataFrame:
    return groups.withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("pair_key"))))


def with_running_total(groups: DataFrame, seed: int, weight: Column, strata: list[str] | None = None) -> DataFrame:
    """groups with ``before``, the total weight of the groups ahead in hash order (inside its stratum); it orders every group."""
    strata = strata or []
    order = ["h", *(c for c in KEY if c in groups.columns)]
    rows = _shuffled(groups, seed).withColumn("b", F.substring("h", 1, 3)).withColumn("w", weight)
    sums = rows.groupBy(*strata, "b").agg(F.sum("w").alias("s"))
    ahead = F.sum("s").over(Window.partitionBy(*strata).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*strata, "b", F.coalesce(ahead, F.lit(0)).alias("offset"))
    inside = F.sum("w").over(Window.partitionBy(*strata, "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(offsets, [*strata, "b"]).withColumn("before", F.coalesce(inside, F.lit(0)) + F.col("offset")).drop("h", "b", "w", "offset")


DIGITS, FEW = 3, 4096


class Selection:
    """Where the total weight of groups in hash order reaches ``limit``, found by radix selection.

    ``limit`` is a column over the strata; a stratum that never reaches it has no cut and lies ahead of it as a whole.
    """

    def __init__(self, groups: DataFrame, seed: int, weight: Column, limit: Column, strata: str | None = None):
        self.columns, self.stratum = groups.columns, strata or "_all"
        self.order = ["h", *(c for c in KEY if c in groups.columns)]
        rows = _shuffled(groups, seed).withColumn("w", weight)
        self.rows = written(rows if strata else rows.withColumn("_all", F.lit(0)), "groups")
        self.cuts = self._refine(self.rows, F.lit(""), F.lit(0).cast("long"), limit)
        while (most := self.cuts.agg(F.max("n"), F.max(F.length("prefix"))).first()) and (most[0] or 0) > FEW and most[1] < 32:
            inside = self._met().where(F.col("h").startswith(F.col("prefix")))
            self.cuts = self._refine(inside, F.col("prefix"), F.col("ahead"), F.col("limit"))

    def _refine(self, rows: DataFrame, prefix: Column, ahead: Column, limit: Column) -> DataFrame:
        """(stratum, prefix, ahead, limit, n): the bucket of each stratum in which the limit is reached; a row a stratum."""
        bucket = F.substring(F.col("h"), F.lit(1), F.length(prefix) + DIGITS)
        sums = rows.select(self.stratum, bucket.alias("b"), ahead.alias("before"), limit.alias("limit"), "w").groupBy(self.stratum, "before", "limit", "b").agg(F.sum("w").alias("s"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("s").over(Window.partitionBy(self.stratum).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
        placed = sums.withColumn("ahead", before)
        return written(placed.where((F.col("ahead") < F.col("limit")) & (F.col("ahead") + F.col("s") >= F.col("limit"))).select(self.stratum, F.col("b").alias("prefix"), "ahead", "limit", "n"), "cuts")

    def _met(self) -> DataFrame:
        """Groups with their stratum's cut; the table of cuts is written, so its size is known when the join is planned."""
        return self.rows.join(self.cuts, self.stratum, "left")

    def _parts(self) -> tuple[DataFrame, DataFrame]:
        """Groups with ``side``, -1 in buckets ahead of the cut and 1 behind it; those of the cut bucket with ``before`` and ``limit``."""
        met = self._met()
        bucket = F.substring(F.col("h"), F.lit(1), F.length("prefix"))
        side = F.when(F.col("prefix").isNull() | (bucket < F.col("prefix")), -1).when(bucket > F.col("prefix"), 1).otherwise(0)
        placed = met.withColumn("side", side)
        inside = F.sum("w").over(Window.partitionBy(self.stratum).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1))
        return placed.where("side <> 0").select(*self.columns, "side"), placed.where("side = 0").withColumn("before", F.coalesce(inside, F.lit(0)) + F.col("ahead"))

    def first(self, condition: Column | None = None) -> DataFrame:
        """Groups with less than ``limit`` ahead of them, or that meet a condition over ``before``, ``w`` and ``limit``."""
        rest, cut = self._parts()
        return rest.where("side < 0").select(*self.columns).unionByName(cut.where(F.col("before") < F.col("limit") if condition is None else condition).select(*self.columns))

    def marked(self, yes: str, no: str, name: str) -> DataFrame:
        """All groups with a column that tells the first from the others."""
        rest, cut = self._parts()
        sides = rest.withColumn(name, F.when(F.col("side") < 0, yes).otherwise(no)).select(*self.columns, name)
        return sides.unionByName(cut.withColumn(name, F.when(F.col("before") < F.col("limit"), yes).otherwise(no)).select(*self.columns, name))


def sample_groups(groups: DataFrame, target: int, seed: int) -> DataFrame:
    """Groups in hash order until their rows reach target; at least one group, and the last may overshoot."""
    return Selection(groups, seed, F.col("n_rows"), F.lit(max(target, 1)).cast("long")).first()


def sample_groups_stratified(groups: DataFrame, target: int, seed: int) -> DataFrame:
    """As ``sample_groups`` for each main label; target is split evenly, what is left over goes to the smallest labels."""
    strata = written(groups.select("primary_label").distinct(), "strata")
    k = strata.count()
    if not k:
        return groups
    left = strata.orderBy("primary_label").limit(target % k).agg(F.max("primary_label")).first()[0] if target % k else None
    share = F.lit(target // k) + (F.when(F.col("primary_label") <= F.lit(left), 1).otherwise(0) if left is not None else F.lit(0))
    return Selection(groups, seed, F.col("n_rows"), F.greatest(share, F.lit(1)).cast("long"), "primary_label").first()


def cap_groups(groups: DataFrame, max_rows: int, seed: int) -> DataFrame:
    """Groups in hash order whose running total stays within max_rows, the first in any case; all if they fit."""
    fits = (F.col("before") + F.col("w") <= max_rows) | (F.col("before") == 0)
    return Selection(groups, seed, F.col("n_rows"), F.lit(max(max_rows + 1, 1)).cast("long")).first(fits)


def split_groups(groups: DataFrame, ratio: float, seed: int) -> DataFrame:
    """groups with ``split``: max(1, floor(groups * ratio)) go to val; a single group is not split."""
    groups = written(groups, "all-groups")
    n = groups.count()
    to_val = 0 if n < 2 else max(1, int(n * ratio))
    if not to_val:
        return groups.withColumn("split", F.lit("train"))
    return Selection(groups, seed, F.lit(1), F.lit(to_val).cast("long")).marked("val", "train", "split")


def rows_of(df: DataFrame, groups: DataFrame) -> DataFrame:
    return df.join(groups.select(*KEY), KEY, "left_semi")


def split_from_manifest(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows with the split of a manifest; a manifest group without rows is an error, a group outside it is left out."""
    missing = manifest.join(df.select(*KEY).distinct(), KEY, "left_anti")
    if not missing.isEmpty():
        raise ValueError("manifest names groups that the data lacks")
    return df.join(manifest.select(*KEY, "split"), KEY)


def _digests(table: DataFrame, columns: list[str], buckets: int, end: str) -> DataFrame:
    """(b, n, x, s): number and two combined hashes of the rows of each bucket."""
    hashes = F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets))
    made = table.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.bit_xor(hashes[0]).alias("x"), F.sum(F.shiftright(hashes[1], 16)).alias("s"))
    return made.select("b", F.struct("n", "x", "s").alias(end))


def differing_buckets(a: DataFrame, b: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """Hash buckets of keys in which the two tables do not hold the same rows; only sums of buckets are shuffled."""
    met = _digests(a, columns, buckets, "one").join(_digests(b, columns, buckets, "other"), "b", "full")
    return met.where(~F.col("one").eqNullSafe(F.col("other"))).select("b")


def verify_manifest(groups: DataFrame, manifest: DataFrame, buckets: int = 1 << 16) -> DataFrame:
    """Ids on one side only, with the side; where both tables have splits, also ids whose split differs (side ``split``).

    Both sides are first compared by digests of their buckets; only rows of buckets that differ are joined.
    """
    keys = [*KEY, "split"] if "split" in groups.columns and "split" in manifest.columns else KEY
    differ = written(differing_buckets(groups, manifest, keys, buckets), "buckets")
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets))
    a, b = (t.select(*keys, bucket.alias("b")).join(differ, "b", "left_semi").drop("b").withColumn("_on", F.lit(True)) for t in (groups, manifest))
    other = b.select(*KEY, F.col("_on").alias("_other"), *[F.col(c).alias(f"_{c}") for c in keys[2:]])
    met = a.join(other, KEY, "full")
    side = F.when(F.col("_other").isNull(), "data").when(F.col("_on").isNull(), "manifest")
    if len(keys) > 2:
        side = side.when(F.col("split") != F.col("_split"), "split")
    return met.select(*KEY, side.alias("side")).where(F.col("side").isNotNull())


def shared_groups(a: DataFrame, b: DataFrame) -> DataFrame:
    """Groups that stand in both tables; none for a train and a validation part."""
    return a.select(*KEY).intersect(b.select(*KEY))


def check_group_integrity(everything: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected groups with the rows they have in all and among the selected, and whether they are whole."""
    a = everything.groupBy(*KEY).agg(F.count("*").alias("n_all"))
    b = selected.groupBy(*KEY).agg(F.count("*").alias("n_selected"))
    return b.join(a, KEY, "left").withColumn("whole", F.col("n_all").eqNullSafe(F.col("n_selected")))


def write_manifest(groups: DataFrame, path: str, seed: int | None = None, ratio: float | None = None, signature: str | None = None) -> None:
    """Groups with their split, and one row of facts: seed, ratio, numbers of groups and rows, files and the data's signature; the names of the files are a table beside it."""
    groups.select(*KEY, "split").write.parquet(f"{path}/groups")
    rows = F.col("n_rows") if "n_rows" in groups.columns else F.lit(None).cast("long")
    counts = [x for s in ("train", "val") for x in (F.count_if(F.col("split") == s).alias(f"n_{s}_groups"), F.sum(F.when(F.col("split") == s, rows)).alias(f"n_{s}_rows"))]
    given = [F.lit(seed).cast("long").alias("seed"), F.lit(ratio).cast("double").alias("ratio"), F.lit(signature).cast("string").alias("signature")]
    groups.agg(*counts, F.countDistinct("source_file").alias("n_files")).select(*given, "*").write.parquet(f"{path}/facts")
    groups.select("source_file").distinct().write.parquet(f"{path}/files")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/groups")


def manifest_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/facts")


def manifest_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/files")


def signature_check(facts: DataFrame, current: DataFrame) -> DataFrame:
    """The recorded and the current signature and whether they differ; a manifest without one does not."""
    now = current.select(F.col("signature").alias("current"))
    differs = F.coalesce(F.col("recorded") != F.col("current"), F.lit(False))
    return facts.select(F.col("signature").alias("recorded")).crossJoin(now).withColumn("differs", differs)  # one row each
