"""Integration joins: detail rows, daily weather of the nearest station, key integrity."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import scalar as fx
from tarmac.operators import skew
from tarmac.schema import col
from tarmac.session import cut_lineage

# Stations up to this number are sent to every task; larger tables are searched by a tree.
MAX_BROADCAST_STATIONS = 2_000
# Distances are compared to the millimetre, so engines agree on ties.
_TIE_DECIMALS = 6
#: Leaves of the station tree at most, stations it is drawn from, stations of a leaf (about) and places that search a leaf together.
MAX_LEAVES, _SAMPLED = 4_096, 65_536
_STATIONS_PER_LEAF, _VISITS_PER_SLICE = 32, 50_000


def with_suffixes(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes=("_x", "_y")) -> tuple[DataFrame, DataFrame]:
    """Rename clashing non-key columns on both sides."""
    keys = {c.lower() for c in on}
    clash = {c.lower() for c in left.columns} & {c.lower() for c in right.columns} - keys
    return (
        left.withColumnsRenamed({c: c + suffixes[0] for c in left.columns if c.lower() in clash}),
        right.withColumnsRenamed({c: c + suffixes[1] for c in right.columns if c.lower() in clash}),
    )


def merge_details(
    accidents: DataFrame, vehicles: DataFrame, on: Sequence[str] = ("Accident_Index",), how: str = "left"
) -> DataFrame:
    """Accidents with their vehicles; ``left`` keeps accidents without one."""
    left, right = with_suffixes(accidents, vehicles, on)
    return skew.join_details(left, right, on, how)


def nearest_station_join(
    points: DataFrame,
    stations: DataFrame,
    lat: str = "Latitude",
    lon: str = "Longitude",
    station_id: str = "station_id",
    station_lat: str = "latitude",
    station_lon: str = "longitude",
    max_broadcast: int = MAX_BROADCAST_STATIONS,
) -> DataFrame:
    """(lat, lon, station_id, distance_km) per distinct coordinate; null coordinates have none.

    Ties go to the smallest station id. Distinct coordinates come first, so repeated places
    are searched once.
    """
    places = points.where(col(lat).isNotNull() & col(lon).isNotNull()).select(col(lat), col(lon)).distinct()
    sites = stations.select(
        col(station_id).alias("station_id"), col(station_lat).alias("slat"), col(station_lon).alias("slon")
    ).dropna()
    sites = sites.groupBy("slat", "slon").agg(F.min("station_id").alias("station_id"))
    head = sites.limit(max_broadcast + 1).collect()  # bounded by the limit
    if len(head) <= max_broadcast:
        return _search_in_tasks(places, head, lat, lon, dict(sites.dtypes)["station_id"])
    return _search_by_tree(places, sites, lat, lon)


def _search_in_tasks(places: DataFrame, sites: list, lat: str, lon: str, id_type: str) -> DataFrame:
    sites = sorted(sites, key=lambda r: r["station_id"])
    ids = [r["station_id"] for r in sites]
    slat = np.radians(np.array([r["slat"] for r in sites], dtype=float))
    slon = np.radians(np.array([r["slon"] for r in sites], dtype=float))
    schema = f"`{lat}` double, `{lon}` double, station_id {id_type}, distance_km double"

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty or not ids:
                continue
            out = []
            for start in range(0, len(batch), 2_000):
                part = batch.iloc[start : start + 2_000]
                plat = np.radians(part[lat].to_numpy(float))[:, None]
                plon = np.radians(part[lon].to_numpy(float))[:, None]
                a = (
                    np.sin((slat - plat) / 2) ** 2
                    + np.cos(plat) * np.cos(slat) * np.sin((slon - plon) / 2) ** 2
                )
                km = np.round(2 * fx.EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(a))), _TIE_DECIMALS)
                best = km.argmin(axis=1)
                out.append(
                    pd.DataFrame(
                        {
                            lat: part[lat].to_numpy(),
                            lon: part[lon].to_numpy(),
                            "station_id": [ids[i] for i in best],
                            "distance_km": km[np.arange(len(part)), best],
                        }
                    )
                )
            yield pd.concat(out)

    typed = places.select(col(lat).cast("double").alias(lat), col(lon).cast("double").alias(lon))
    return typed.mapInPandas(search, schema)


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Points of the unit sphere; straight distances between them grow with those along the surface."""
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def median_splits(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """(axis, cut) per inner node of a balanced tree, level by level: the median along the widest axis of the node's points."""
    out, level = [], [points]
    while len(level) < leaves:
        after = []
        for part in level:
            axis = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            cut = float(np.median(part[:, axis])) if len(part) else 0.0
            out.append((axis, cut))
            above = part[:, axis] > cut
            after += [part[~above], part[above]]
        level = after
    return out


def leaf_of(points: np.ndarray, splits: Sequence[tuple[int, float]]) -> np.ndarray:
    axes, cuts = np.array([a for a, _ in splits], dtype=np.int64), np.array([c for _, c in splits])
    node = np.zeros(len(points), dtype=np.int64)
    for _ in range((len(splits) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > cuts[node])
    return node - len(splits)


def leaves_to_visit(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, box) for every box that may hold the point's nearest: no farther than some box is at its far corner."""
    nearest = np.zeros((len(points), len(low)))
    farthest = np.zeros_like(nearest)
    for axis in range(points.shape[1]):
        x = points[:, axis, None]
        under, over = low[None, :, axis] - x, x - high[None, :, axis]
        nearest += np.maximum(np.maximum(under, over), 0.0) ** 2
        farthest += np.maximum(np.abs(under), np.abs(over)) ** 2
    return np.nonzero(np.sqrt(nearest) <= np.sqrt(farthest.min(axis=1, keepdims=True)) + 1e-8)


def _search_by_tree(places: DataFrame, sites: DataFrame, lat: str, lon: str) -> DataFrame:
    """Search the leaves of a tree of median splits that may hold a nearer station.

    The splits come from a bounded sample of stations; all stations go to their leaf, and the boxes around
    a leaf's stations, at most ``MAX_LEAVES``, bound how near and how far these are. A
    place visits the few leaves within its bound, so no round gathers what is left. Leaves that many
    places visit are searched in slices.
    """
    id_type = dict(sites.dtypes)["station_id"]
    n = sites.count()
    leaves = 1 << max(0, math.ceil(math.log2(max(1, min(MAX_LEAVES, n / _STATIONS_PER_LEAF)))))
    drawn = sites.where(F.pmod(F.xxhash64("slat", "slon"), F.lit(1 << 30)) < (1 << 30) * min(1.0, _SAMPLED / max(n, 1))).select("slat", "slon").toPandas()
    splits = median_splits(_unit(drawn["slat"].to_numpy(float), drawn["slon"].to_numpy(float)), leaves)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _unit(b["slat"].to_numpy(float), b["slon"].to_numpy(float))
            yield b.assign(leaf=leaf_of(x, splits), x0=x[:, 0], x1=x[:, 1], x2=x[:, 2])

    typed = sites.select("station_id", F.col("slat").cast("double").alias("slat"), F.col("slon").cast("double").alias("slon"))
    placed = cut_lineage(typed.mapInPandas(place, f"station_id {id_type}, slat double, slon double, leaf long, x0 double, x1 double, x2 double"))
    edges = [f(f"x{i}").alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(3)]
    boxes = placed.groupBy("leaf").agg(*edges).toPandas().sort_values("leaf")  # MAX_LEAVES rows at most
    numbers = boxes["leaf"].to_numpy(np.int64)
    low, high = (boxes[[f"{name}{i}" for i in range(3)]].to_numpy(float) for name in ("low", "high"))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1_000):
                part = batch.iloc[start : start + 1_000]
                if len(part) and len(numbers):
                    i, j = leaves_to_visit(_unit(part["plat"].to_numpy(), part["plon"].to_numpy()), low, high)
                    yield pd.DataFrame({"plat": part["plat"].to_numpy()[i], "plon": part["plon"].to_numpy()[i], "leaf": numbers[j]})

    asked = places.select(col(lat).cast("double").alias("plat"), col(lon).cast("double").alias("plon"))
    visits = cut_lineage(asked.mapInPandas(visit, "plat double, plon double, leaf long"))
    load = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / _VISITS_PER_SLICE).cast("int").alias("slices"))  # as many rows as leaves
    visits = visits.join(F.broadcast(load), "leaf").withColumn("slice", F.pmod(F.xxhash64("plat", "plon"), F.col("slices")).cast("int"))
    hosts = placed.select("leaf", "station_id", "slat", "slon").join(F.broadcast(load), "leaf")
    hosts = hosts.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    km = F.round(fx.haversine_km(F.col("plat"), F.col("plon"), F.col("slat"), F.col("slon")), _TIE_DECIMALS)
    found = visits.drop("slices").join(hosts, ["leaf", "slice"]).groupBy("plat", "plon")
    found = found.agg(F.min(F.struct(km.alias("km"), F.col("station_id").alias("station_id"))).alias("best"))
    return found.select(F.col("plat").alias(lat), F.col("plon").alias(lon), F.col("best.station_id").alias("station_id"), F.col("best.km").alias("distance_km"))


def weather_on_day(weather: DataFrame, station: str = "station_id", day: str = "time") -> DataFrame:
    """One row per (station, day). Where a source repeats a day, the smallest row stands."""
    rest = [c for c in weather.columns if c not in (station, day)]
    picked = weather.groupBy(col(station), col(day)).agg(F.min(F.struct(*[col(c) for c in rest])).alias("_row"))
    return picked.select(col(station), col(day), *[F.col("_row").getField(c).alias(c) for c in rest])


def attach_weather(
    accidents: DataFrame,
    stations: DataFrame,
    weather: DataFrame,
    lat: str = "Latitude",
    lon: str = "Longitude",
    date: str = "Date",
    weather_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Accidents with the weather of the nearest station on the same day.

    Exact day and station only: without a reading there, the weather stays null.
    """
    nearest = nearest_station_join(accidents, stations, lat, lon).withColumnsRenamed({lat: "_lat", lon: "_lon"})
    spots = nearest.select("_lat", "_lon", "station_id")
    tagged = skew.join_lookup(
        accidents.withColumns({"_lat": col(lat).cast("double"), "_lon": col(lon).cast("double")}), spots, ["_lat", "_lon"], null_keys=True
    ).drop("_lat", "_lon")
    daily = weather_on_day(weather)
    taken = {c.lower() for c in ("station_id", "time", *accidents.columns)}
    columns = list(weather_columns or [c for c in daily.columns if c.lower() not in taken])
    daily = daily.select("station_id", F.col("time").alias(date), *[col(c) for c in columns])
    # Looking for hot (station, day) keys would repeat the search for stations.
    return skew.join_lookup(tagged, daily, ["station_id", date], detect=False, null_keys=True)


def integrate(
    accidents: DataFrame, vehicles: DataFrame, stations: DataFrame, weather: DataFrame, how: str = "left"
) -> DataFrame:
    """Accidents with weather and vehicles.

    Weather joins first, while there is one row per accident, so the wide detail rows are
    shuffled once.
    """
    return merge_details(attach_weather(accidents, stations, weather), vehicles, how=how)


def key_overlap(left: DataFrame, right: DataFrame, key: str = "Accident_Index") -> DataFrame:
    """(key, in_left, in_right) over the distinct keys of both sides; one shuffle."""
    def side(df: DataFrame, l: int, r: int) -> DataFrame:
        return df.where(col(key).isNotNull()).select(col(key).alias("key"), F.lit(l).alias("l"), F.lit(r).alias("r"))

    both = side(left, 1, 0).unionByName(side(right, 0, 1))
    return both.groupBy("key").agg(F.max("l").alias("in_left"), F.max("r").alias("in_right"))


def join_integrity(left: DataFrame, right: DataFrame, key: str = "Accident_Index") -> DataFrame:
    """One row: distinct keys per side, matched, and on one side only, with percentages."""
    keys = key_overlap(left, right, key)
    row = keys.agg(
        F.coalesce(F.sum("in_left"), F.lit(0)).alias("left_keys"),
        F.coalesce(F.sum("in_right"), F.lit(0)).alias("right_keys"),
        F.count_if((F.col("in_left") == 1) & (F.col("in_right") == 1)).alias("matched_keys"),
        F.count_if((F.col("in_left") == 1) & (F.col("in_right") == 0)).alias("only_left"),
        F.count_if((F.col("in_left") == 0) & (F.col("in_right") == 1)).alias("only_right"),
    )
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part) * 100.0, F.col(whole)), F.lit(0.0))
    return row.withColumns(
        {"only_left_pct": share("only_left", "left_keys"), "only_right_pct": share("only_right", "right_keys")}
    )


def cross_table_mismatch(
    left: DataFrame,
    right: DataFrame,
    column: str = "Year",
    key: str = "Accident_Index",
    right_order: str = "Vehicle_Reference",
) -> DataFrame:
    """(matched_keys, mismatches): the column on the left against the first right row per key.

    Two nulls do not agree. Both sides meet in one aggregate, without a join.
    """
    a = left.where(col(key).isNotNull()).groupBy(col(key).alias("key")).agg(
        F.min(col(column).try_cast("double")).alias("l"), F.lit(1).alias("in_l")
    )
    b = right.where(col(key).isNotNull()).groupBy(col(key).alias("key")).agg(
        F.min(F.struct(col(right_order).alias("o"), col(column).try_cast("double").alias("v"))).alias("f")
    ).select("key", F.col("f.v").alias("r"), F.lit(1).alias("in_r"))
    both = (
        a.unionByName(b, allowMissingColumns=True)
        .groupBy("key")
        .agg(F.max("l").alias("l"), F.max("r").alias("r"), F.max("in_l").alias("in_l"), F.max("in_r").alias("in_r"))
        .where(F.col("in_l").isNotNull() & F.col("in_r").isNotNull())
    )
    return both.agg(
        F.count(F.lit(1)).alias("matched_keys"),
        F.count_if(~F.coalesce(F.col("l") == F.col("r"), F.lit(False))).alias("mismatches"),
    )
