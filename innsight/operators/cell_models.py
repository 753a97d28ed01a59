"""The rating regression of every area at once, and what it says about each property.

Rows are cut into chunks of an area, each chunk gives the area's moments over its rows, and
moments merge in two rounds, so an area with a third of all listings is many equal tasks. Areas
never come to the driver: features, categories, medians and thresholds are columns of an area's
row. A property can be explained by the model of all others: its own row is taken out of the
moments again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.operators import explain as ex
from innsight.operators import features as ft
from innsight.operators import moments as mo
from innsight.operators import neighbours as nb
from innsight.sources.shared import stored

#: Rows per chunk of an area, and chunk states merged by one task of the first round.
CHUNK_ROWS, MERGED = 4096, 64
_CELL = ["res", "cell"]
_UNKNOWN = "__unknown"


@dataclass(frozen=True)
class CellModels:
    """``rows``: every listing in every area it lies in; ``models``: one row per area."""

    rows: DataFrame
    models: DataFrame
    numerics: list[str]


def _double(name: str) -> Column:
    value = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(value), value)


def area_rows(listings: DataFrame, numerics: Sequence[str], category: str, label_col: str) -> DataFrame:
    """``(res, cell, property_id, own, label, numbers, amenities, category)`` of the areas asked about.

    A listing lies in one area per resolution; ``own`` marks the one it is compared in. Areas
    that no listing is compared in are left out.
    """
    packed = listings.withColumns({
        "_numbers": F.array(*[_double(c) for c in numerics]),
        "_amenities": F.coalesce(ft.amenity_list(F.col("amenities")), F.array().cast("array<string>")),
        "_label": _double(label_col),
        "_own": F.struct(
            F.col("geo_bucket_res").cast("int").alias("res"), F.col(nb.geo_column(listings)).cast("string").alias("cell")
        ),
        "_category": F.col(category).cast("string"),
    })
    keep = ("_numbers", "_amenities", "_label", "_own", "_category")
    lying = nb.listing_cells(packed, keep=keep)
    asked = nb.target_cells(listings).select(*_CELL).distinct()
    return lying.join(asked, _CELL, "left_semi").select(
        *_CELL, "property_id", (F.struct(*_CELL) == F.col("_own")).alias("own"), F.col("_label").alias("label"),
        F.col("_numbers").alias("numbers"), F.col("_amenities").alias("amenities"), F.col("_category").alias("category"),
    )


def area_features(rows: DataFrame, numerics: Sequence[str], k: int, always: Sequence[str]) -> DataFrame:
    """One row per area: its amenities, categories, medians, label threshold and number of chunks.

    Amenities are the ``k`` most frequent of the area, ties by name, and those always included;
    categories are those of labelled rows, by name. Medians and threshold come from sketches
    that are exact up to ten thousand values an area.
    """
    counted = rows.select(*_CELL, F.explode("amenities").alias("name")).groupBy(*_CELL, "name").agg(F.count("*").alias("n"))
    by_count = Window.partitionBy(*_CELL).orderBy(F.desc("n"), "name")
    # bounded: k names an area
    frequent = (
        counted.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= k)
        .groupBy(*_CELL).agg(F.collect_set("name").alias("frequent"))
    )
    labelled = rows.where("label is not null")
    # bounded: a category is one of a few buckets
    categories = labelled.where("category is not null").groupBy(*_CELL).agg(F.sort_array(F.collect_set("category")).alias("categories"))
    accuracy = ex.QUANTILE_ACCURACY
    # a cast keeps NULL for values that are missing everywhere
    middle = [F.percentile_approx(F.get("numbers", F.lit(i)), 0.5, accuracy).alias(f"m{i}") for i in range(len(numerics))]
    numbers = labelled.groupBy(*_CELL).agg(*middle, F.percentile_approx("label", mo.QUANTILE, accuracy).alias("threshold"))
    sizes = rows.groupBy(*_CELL).agg(F.ceil(F.count("*") / F.lit(CHUNK_ROWS)).cast("int").alias("chunks"))
    none = F.array().cast("array<string>")
    fixed = F.array(*[F.lit(a.lower()) for a in always]).cast("array<string>")
    return (
        sizes.join(numbers, _CELL, "left").join(frequent, _CELL, "left").join(categories, _CELL, "left")
        .select(
            *_CELL, "chunks", "threshold", F.array(*[F.col(f"m{i}") for i in range(len(numerics))]).cast("array<double>").alias("medians"),
            F.sort_array(F.array_distinct(F.concat(F.coalesce("frequent", none), fixed))).alias("names"),
            F.coalesce("categories", none).alias("categories"),
        )
    )


def slot_names(numerics: Sequence[str], category: str) -> Column:
    """Names of an area's slots: numbers, amenities (clashes numbered), categories, the unknown one."""
    cleaned = F.transform("names", lambda n: F.concat(F.lit("amen_"), F.translate(n, " -.`\"'", "______")))
    numbered = F.transform(
        cleaned,
        lambda c, i: F.when(
            F.size(F.filter(F.slice(cleaned, 1, i), lambda x: x == c)) > 0,
            F.concat(c, F.lit("_"), (F.size(F.filter(F.slice(cleaned, 1, i), lambda x: x == c)) + 1).cast("string")),
        ).otherwise(c),
    )
    return F.concat(
        F.array(*[F.lit(f"{c}__imp") for c in numerics]).cast("array<string>"),
        F.transform(numbered, lambda c: F.concat(c, F.lit("__imp"))),
        F.transform("categories", lambda c: F.concat(F.lit(f"{category}__ohe_"), c)),
        F.array(F.lit(f"{category}__ohe_{_UNKNOWN}")),
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _given(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, mo.Layout]:
    """(raw slots, labels, medians, threshold, layout) of rows of one area."""
    medians = np.array(rows["medians"][0].as_py(), dtype=float)
    raw = _matrix(rows["raw"], len(rows["raw"][0]))
    labels = rows["label"].to_numpy().astype(float)
    threshold = rows["threshold"][0].as_py()
    layout = mo.Layout(len(medians), raw.shape[1])
    return raw, labels, medians, np.nan if threshold is None else threshold, layout


_STATE = pa.schema([("res", pa.int32()), ("cell", pa.string()), ("part", pa.int32()), ("numerics", pa.int32()), ("slots", pa.int32()), ("state", pa.list_(pa.float64()))])
_STATE_DDL = "res int, cell string, part int, numerics int, slots int, state array<double>"


def _state_row(rows: pa.Table, part: int, layout: mo.Layout, state: np.ndarray) -> pa.Table:
    return pa.table(
        [[rows["res"][0].as_py()], [rows["cell"][0].as_py()], [part], [layout.numerics], [layout.slots], [state]], schema=_STATE
    )


def _chunk_state(rows: pa.Table) -> pa.Table:
    raw, labels, medians, threshold, layout = _given(rows)
    state = mo.state_of(raw, medians, labels, threshold, layout)
    return _state_row(rows, rows["chunk"][0].as_py() // MERGED, layout, state)


def _merged_state(rows: pa.Table) -> pa.Table:
    layout = mo.Layout(rows["numerics"][0].as_py(), rows["slots"][0].as_py())
    return _state_row(rows, 0, layout, mo.merged(_matrix(rows["state"], len(rows["state"][0])), layout))


def area_states(placed: DataFrame) -> DataFrame:
    """The merged state of every area, from rows placed into chunks."""
    parts = placed.groupBy(*_CELL, "chunk").applyInArrow(_chunk_state, _STATE_DDL)
    some = parts.groupBy(*_CELL, "part").applyInArrow(_merged_state, _STATE_DDL)
    return some.groupBy(*_CELL).applyInArrow(_merged_state, _STATE_DDL).drop("part")


_FIT = ("coef", "mean", "std", "top_value", "top_scaled")
_FIT_DDL = ", ".join(f"{c} array<double>" for c in _FIT)


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists; NaN becomes null."""
    flat = pa.array(values.ravel(), pa.float64(), mask=np.isnan(values.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


def _fit_columns(fit: mo.Fit) -> list[pa.Array]:
    coef = np.where(fit.used, fit.coef, np.nan)
    return [_lists(c) for c in (coef, fit.mean, fit.std, fit.top_value, fit.top_scaled)]


def _fit_areas(batches):
    names = ["res", "cell", "n", "fill", "beta", *_FIT]
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            layout = mo.Layout(row["numerics"], row["slots"])
            medians = np.array(row["medians"], dtype=float)
            fit = mo.fit_whole(np.array(row["state"]), medians, layout, row["n_categories"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["res"]], pa.int32()), pa.array([row["cell"]]), pa.array(fit.n.astype(np.int64)),
                 _lists(fit.fill), _lists(fit.beta), *_fit_columns(fit)], names=names,
            )


def fit_cells(
    listings: DataFrame, numerics: Sequence[str], category: str = "cancellation_bucket", k: int = 20,
    always: Sequence[str] = (), label_col: str = "ratings",
) -> CellModels:
    """The elastic-net rating model of every area that a listing is compared in, in one job.

    ``listings`` holds features (``features.listing_features``), ``amenities`` and the cells.
    Areas without a labelled row have models of zeros. Rows and models are written to the
    shared folder, since several steps read them.
    """
    rows = area_rows(listings, numerics, category, label_col)
    described = stored(area_features(rows, numerics, k, always), "areas").withColumn("slot_names", slot_names(numerics, category))
    flags = F.transform("names", lambda n: F.array_contains("amenities", n).cast("double"))
    known = F.transform("categories", lambda c: F.coalesce(c == F.col("category"), F.lit(False)).cast("double"))
    rest = F.array((~F.exists("categories", lambda c: F.coalesce(c == F.col("category"), F.lit(False)))).cast("double"))
    placed = rows.join(described, _CELL).select(
        *_CELL, "property_id", "own", "label", "threshold", "medians",
        F.pmod(F.xxhash64("property_id"), F.col("chunks")).cast("int").alias("chunk"),
        F.concat("numbers", flags, known, rest).alias("raw"),
    )
    placed = stored(placed, "area-rows")
    described = described.withColumn("n_categories", F.size("categories") + 1)
    states = stored(area_states(placed).join(described, _CELL), "area-states")
    fitted = states.select(*_CELL, "numerics", "slots", "state", "medians", "n_categories").mapInArrow(
        _fit_areas, f"res int, cell string, n long, fill array<double>, beta array<double>, {_FIT_DDL}"
    )
    models = states.select(*_CELL, "chunks", "slot_names", "threshold", "medians", "n_categories", "state").join(fitted, _CELL)
    return CellModels(placed, stored(models, "area-models"), list(numerics))


def coefficients(models: CellModels) -> DataFrame:
    """``(res, cell, n, feature, coef)``: one row per slot of an area's model."""
    zipped = F.arrays_zip(F.col("slot_names").alias("feature"), F.col("coef"))
    return models.models.select(*_CELL, "n", F.inline(zipped)).where("coef is not null")


def _slots(fill: Column, numerics: int) -> Column:
    """The slots of a row, out of its raw values and its model's columns."""
    value = F.transform(
        "raw",
        lambda v, i: F.when(F.lit(i < numerics), F.coalesce(v, F.get(fill, i))).otherwise(v),
    )
    scaled = F.transform(
        value,
        lambda v, i: F.when(F.get("std", i) > 0, (v - F.get("mean", i)) / F.get("std", i)).otherwise(0.0),
    )
    # one-hot slots have no value of their own and no average to show
    shown = F.transform("raw", lambda v, i: F.when(i < F.size("raw") - F.col("n_categories"), v))
    zipped = F.arrays_zip(
        F.col("slot_names").alias("name"), F.col("coef"), scaled.alias("scaled"), F.col("top_scaled"), shown.alias("own"),
        F.col("top_value"),
    )
    return F.filter(zipped, lambda s: s["coef"].isNotNull())


def explain_members(models: CellModels, top_k: int = 60) -> DataFrame:
    """Insights of every property by the model of its area: one pass of column expressions."""
    own = models.rows.where("own").select(*_CELL, "property_id", "raw")
    joined = own.join(models.models.select(*_CELL, "slot_names", "n_categories", "fill", *_FIT), _CELL)
    rows = joined.select(*_CELL, "property_id", _slots(F.col("fill"), len(models.numerics)).alias("slots"))
    return ex.ranked_effects(rows, top_k, (*_CELL, "property_id"))


_BATCH = 256


def _without_each(rows: pa.Table, model: pa.Table) -> pa.Table:
    """The regression without it for every row of a chunk, in batches of bounded size."""
    names = ["property_id", "raw", "fill", *_FIT]
    if not rows.num_rows or not model.num_rows:
        kinds = [pa.string()] + [pa.list_(pa.float64())] * (len(names) - 1)
        return pa.table([pa.array([], t) for t in kinds], names=names)
    whole = model.slice(0, 1).to_pylist()[0]
    medians = np.array(whole["medians"], dtype=float)
    state, beta = np.array(whole["state"]), np.array(whole["beta"], dtype=float)
    out = []
    for start in range(0, rows.num_rows, _BATCH):
        part = rows.slice(start, _BATCH)
        raw = _matrix(part["raw"], len(beta))
        labels = part["label"].to_numpy().astype(float)
        threshold = np.nan if whole["threshold"] is None else whole["threshold"]
        fit = mo.fit_without(state, medians, threshold, mo.Layout(len(medians), len(beta)), whole["n_categories"], beta, raw, labels)
        out.append(pa.table([part["property_id"].combine_chunks(), _lists(raw), _lists(fit.fill), *_fit_columns(fit)], names=names))
    return pa.concat_tables(out)


def explain_left_out(models: CellModels, top_k: int = 60) -> DataFrame:
    """Insights of every property by the model of its area fitted without that property.

    The area's state is copied once per chunk of rows, not once per row.
    """
    own = models.rows.where("own").select(*_CELL, "chunk", "property_id", "label", "raw")
    whole = models.models.select(
        *_CELL, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "threshold", "medians", "n_categories", "state", "beta"
    )
    lists = ", ".join(f"{c} array<double>" for c in ("raw", "fill", *_FIT))

    def work(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = _without_each(left, right)
        cell = [pa.array([key[i].as_py()] * found.num_rows, t) for i, t in ((0, pa.int32()), (1, pa.string()))]
        return pa.table([*cell, *found.columns], names=[*_CELL, *found.column_names])

    keys = [*_CELL, "chunk"]
    fitted = own.groupBy(*keys).cogroup(whole.groupBy(*keys)).applyInArrow(
        work, f"res int, cell string, property_id string, {lists}"
    )
    named = fitted.join(models.models.select(*_CELL, "slot_names", "n_categories"), _CELL)
    rows = named.select(*_CELL, "property_id", _slots(F.col("fill"), len(models.numerics)).alias("slots"))
    return ex.ranked_effects(rows, top_k, (*_CELL, "property_id"))
