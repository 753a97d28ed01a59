"""Comparable properties: same geographic cell, ranked by cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.functions import vectors
from innsight.operators import metric_index

# Rows per block of a cell: targets and the candidates of a block are one matrix product, and
# only the best k per target leave it.
BLOCK_ROWS = 4096
_CELL = ["res", "cell"]


def geo_column(df: DataFrame) -> str:
    for name in ("geo_bucket", "_geo_bucket_filled"):
        if name in df.columns:
            return name
    raise ValueError("expected a column 'geo_bucket' or '_geo_bucket_filled'")


def _vector(df: DataFrame, vec_col: str) -> Column:
    return vectors.double_array(df, vec_col)


def usable_vectors(df: DataFrame, vec_col: str = "similarity_vec") -> DataFrame:
    """Rows with a vector that is present, not flagged, free of NaN and not zero."""
    ok = F.col(vec_col).isNotNull()
    for flag in ("is_bad_vec", "has_nan"):
        if flag in df.columns:
            ok = ok & ~F.col(flag)
    if "vec_norm" in df.columns:
        ok = ok & F.col("vec_norm").isNotNull() & (F.col("vec_norm") > 0)
    else:
        vec = _vector(df, vec_col)
        ok = ok & ~vectors.has_nan(vec) & (vectors.l2_norm(vec) > 0)
    return df.filter(ok)


def listing_cells(
    listings: DataFrame, id_col: str = "property_id", prefix: str = "h3_", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per listing and resolution: ``(res, cell, property_id, *keep)``."""
    cell_columns = [c for c in listings.columns if c.startswith(prefix)]
    if not cell_columns:
        raise ValueError(f"no cell columns '{prefix}<resolution>'")
    pairs = F.array(
        *[
            F.struct(F.lit(int(c[len(prefix):])).alias("res"), F.col(c).cast("string").alias("cell"))
            for c in cell_columns
        ]
    )
    return (
        listings.select(F.col(id_col).cast("string").alias("property_id"), *keep, F.inline(pairs))
        .filter(F.col("cell").isNotNull())
    )


def target_cells(listings: DataFrame, id_col: str = "property_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The cell each listing is compared in: ``(res, cell, property_id, *keep)``."""
    return listings.select(
        F.col(id_col).cast("string").alias("property_id"),
        F.col("geo_bucket_res").cast("int").alias("res"),
        F.col(geo_column(listings)).cast("string").alias("cell"),
        *keep,
    )


def neighbourhood(listings: DataFrame, targets: DataFrame, include_target: bool = True) -> DataFrame:
    """Listings in the cell of each requested target: ``(target_property_id, property_id)``.

    ``targets`` holds one column ``property_id``. The result has one row per member of a
    target's cell, so ask for the targets that are needed, not for all of them.
    """
    wanted = target_cells(listings).join(targets.select("property_id").distinct(), "property_id", "left_semi")
    members = listing_cells(listings).join(
        wanted.withColumnRenamed("property_id", "target_property_id"), _CELL
    )
    if not include_target:
        members = members.filter(F.col("property_id") != F.col("target_property_id"))
    return members.select("target_property_id", "property_id")


def sample_candidates(
    candidates: DataFrame, cap: int, keys: list[str], id_col: str = "property_id", seed: int = 42
) -> DataFrame:
    """Repeatable sample of at most ``cap`` rows per key, ordered by a hash of the id.

    The window keeps ``cap`` rows per key and input partition before it shuffles, so a
    key with a third of all rows costs no more than any other.
    """
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")), 256)
    window = Window.partitionBy(*keys).orderBy(order, F.col(id_col))
    return (
        candidates.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= cap)
        .drop("_rank")
    )


def sampling_fraction(n: Column, cap: int, oversample: float = 1.7) -> Column:
    """Share of a cell's candidates that a sample of ``cap`` would look at."""
    return F.least(F.lit(1.0), F.lit(cap * oversample) / F.greatest(n.cast("double"), F.lit(1.0)))


def rank_neighbours(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best neighbours per property, ties by id, with their rank."""
    window = Window.partitionBy("property_id").orderBy(F.desc("similarity"), "neighbor_property_id")
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def top_neighbours(
    listings: DataFrame,
    targets: DataFrame | None = None,
    *,
    k: int = 20,
    max_candidates: int | None = None,
    seed: int = 42,
    id_col: str = "property_id",
    vec_col: str = "similarity_vec",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Nearest listings of the same cell: ``(property_id, neighbor_property_id, similarity, rank)``.

    Works for all listings or for those in ``targets``. A cell larger than a block is cut by
    pivots; a target meets the block of its own pivot and those others that the triangle
    inequality cannot rule out (``metric_index``). Blocks hand on the k best per target only. No
    pair of listings is ever a row, and a cell with a third of all listings becomes many tasks.
    ``max_candidates`` switches to the sampled search, which scores a repeatable sample of
    each cell only.
    """
    usable = usable_vectors(listings, vec_col)
    entries = _entries(usable.withColumn("vec", _vector(usable, vec_col)), targets, id_col)
    if max_candidates is not None:
        entries = _sampled(entries, max_candidates, seed)
    keyed = entries.select(
        F.concat_ws(":", "res", "cell").alias("key"), F.col("property_id").alias("id"), "vec", "is_target"
    )
    found = metric_index.nearest(keyed, k, block_rows)
    return rank_neighbours(
        found.select(F.col("id").alias("property_id"), F.col("near_id").alias("neighbor_property_id"), "similarity"), k
    )


def _entries(listings: DataFrame, targets: DataFrame | None, id_col: str) -> DataFrame:
    """Every listing once per cell it lies in, and once as a target of the cell it asks about."""
    own_cell = F.struct(
        F.col("geo_bucket_res").cast("int").alias("res"),
        F.col(geo_column(listings)).cast("string").alias("cell"),
        F.lit(True).alias("is_target"),
    )
    lies_in = [
        F.struct(F.lit(int(c[len("h3_"):])).alias("res"), F.col(c).cast("string").alias("cell"), F.lit(False).alias("is_target"))
        for c in listings.columns
        if c.startswith("h3_")
    ]
    named = listings.withColumn("property_id", F.col(id_col).cast("string"))
    if targets is None:
        asked = F.array(own_cell)
    else:
        wanted = targets.select(F.col("property_id").cast("string").alias("property_id"), F.lit(True).alias("_wanted")).distinct()
        named = named.join(wanted, "property_id", "left")
        asked = F.when(F.col("_wanted"), F.array(own_cell)).otherwise(F.slice(F.array(own_cell), 1, 0))
    return named.select("property_id", "vec", F.inline(F.concat(asked, F.array(*lies_in)))).filter(
        F.col("cell").isNotNull() & F.col("res").isNotNull()
    )


def _sampled(entries: DataFrame, max_candidates: int, seed: int) -> DataFrame:
    """Entries whose candidates are cut to the sample of their cell.

    One more than asked for is drawn, so that leaving out the target itself fills the cap.
    """
    lies_in = entries.filter(~F.col("is_target")).select(*_CELL, "property_id")
    drawn = sample_candidates(lies_in, max_candidates + 1, _CELL, seed=seed).withColumn("_drawn", F.lit(True))
    return (
        entries.join(drawn, [*_CELL, "property_id"], "left")
        .filter(F.col("is_target") | F.col("_drawn"))
        .drop("_drawn")
    )


def members(neighbours: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Who is compared: each target with itself and with its neighbours.

    ``(property_id, member_id, side)``. ``targets`` names what is compared whether it has
    neighbours or not; without it that is every property with a neighbour, in one pass.
    """
    if targets is not None:
        own = targets.select(F.col("property_id").cast("string").alias("property_id")).distinct()
        return neighbours.select(
            "property_id", F.col("neighbor_property_id").alias("member_id"), F.lit("neighbors").alias("side")
        ).unionByName(own.select("property_id", F.col("property_id").alias("member_id"), F.lit("target").alias("side")))

    def member(name: str, side: str) -> Column:
        return F.struct(F.col(name).alias("member_id"), F.lit(side).alias("side"))

    neighbour = member("neighbor_property_id", "neighbors")
    both = F.when(F.col("rank") == 1, F.array(neighbour, member("property_id", "target"))).otherwise(
        F.array(neighbour)
    )
    return neighbours.select("property_id", F.inline(both))


def similarity_stats(neighbours: DataFrame) -> DataFrame:
    """Number, mean, least and greatest similarity of the neighbours of each property."""
    return neighbours.groupBy("property_id").agg(
        F.count("*").alias("neighbors_selected_count"),
        F.avg("similarity").alias("similarity_avg"),
        F.min("similarity").alias("similarity_min"),
        F.max("similarity").alias("similarity_max"),
    )


def neighbour_status(
    listings: DataFrame,
    requested: DataFrame,
    *,
    max_candidates: int | None = None,
    oversample: float = 1.7,
    k: int = 20,
    seed: int = 42,
    id_col: str = "property_id",
    vec_col: str = "similarity_vec",
) -> DataFrame:
    """Selection metadata per requested property, also for ids that do not exist.

    ``bucket_candidate_count`` is the number of usable listings in the cell without the
    target; it comes from one count per cell, not from a join of listings. Without
    ``max_candidates`` the search is exact: no cap, and a fraction of one.
    """
    flagged = usable_vectors(listings, vec_col).select(F.col(id_col).cast("string").alias("property_id"))
    wanted = requested.select(F.col("property_id").cast("string").alias("property_id")).distinct()
    known = (
        target_cells(listings, id_col, ())
        .join(wanted, "property_id", "left_semi")
        .join(flagged.withColumn("usable", F.lit(True)), "property_id", "left")
    )
    member_cells = listing_cells(usable_vectors(listings, vec_col), id_col)
    counts = member_cells.groupBy(*_CELL).agg(F.count("*").alias("members"))
    own = member_cells.select(*_CELL, "property_id", F.lit(1).alias("own"))
    joined = (
        wanted.join(known.withColumn("found", F.lit(True)), "property_id", "left")
        .join(counts, _CELL, "left")
        .join(own, [*_CELL, "property_id"], "left")
    )
    ok = F.col("status") == "ok"
    count = F.coalesce(F.col("members"), F.lit(0)) - F.coalesce(F.col("own"), F.lit(0))
    share = F.lit(1.0) if max_candidates is None else sampling_fraction(count, max_candidates, oversample)
    return (
        joined.withColumn(
            "status",
            F.when(F.col("found").isNull(), "target_not_found")
            .when(F.col("usable").isNull(), "target_vector_invalid")
            .otherwise("ok"),
        )
        .select(
            F.col("property_id").alias("target_property_id"),
            "status",
            F.col("res").alias("bucket_res"),
            F.col("cell").alias("bucket_value"),
            F.concat(F.lit("h3_"), F.col("res").cast("string")).alias("h3_filter_column"),
            F.when(ok, count).alias("bucket_candidate_count"),
            F.when(ok, share).alias("candidate_sampling_fraction"),
            F.when(ok, F.lit(max_candidates).cast("int")).alias("max_candidates_cap"),
            F.when(ok, F.lit(oversample)).alias("oversample_factor"),
            F.when(ok, F.lit(k)).alias("top_k_neighbors"),
            F.when(ok, F.lit(seed)).alias("random_seed"),
        )
    )


def require_targets(listings: DataFrame, property_ids: list[str], id_col: str = "property_id") -> None:
    """Raise for ids that are not in the listings, or have no cell to compare in."""
    known = {
        row["property_id"]: row
        for row in target_cells(listings, id_col)
        .filter(F.col("property_id").isin([str(p) for p in property_ids]))
        .dropDuplicates(["property_id"])
        .collect()
    }
    for pid in map(str, property_ids):
        if pid not in known:
            raise ValueError(f"property_id {pid} not found")
        if known[pid]["res"] is None or known[pid]["cell"] is None:
            raise ValueError(f"property_id {pid} has no cell to compare in")
