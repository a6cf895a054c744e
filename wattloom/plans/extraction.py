"""A bus and line network from map features: polylines with a voltage tag, and substations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo, text
from ..operators import spatial
from ..operators.quality import concat_tables
from ..session import checkpointed

# Column names a voltage tag may come under, first match counts.
VOLTAGE_COLUMNS = ("tags.voltage", "voltage", "tags_voltage")
DEFAULT_VOLTAGE_KV = 220.0


def _kv(voltage: Column, unit: str) -> Column:
    return voltage / F.lit(1000.0) if unit == "V" else voltage


def prepared_lines(features: DataFrame, voltage_min_kv: float, voltage_unit: str = "V", polyline: str = "lonlat") -> DataFrame:
    """Lines at or above a voltage: circuits, voltage in kV, end points, length; lines without length drop out.

    `features` carries a unique `line_id`, the polyline text, a voltage tag and maybe circuits.
    """
    tag = next((c for c in VOLTAGE_COLUMNS if c in features.columns), None)
    voltage = F.lit(DEFAULT_VOLTAGE_KV) if tag is None else _kv(text.voltage_number(F.col(f"`{tag}`")), voltage_unit)
    circuits = F.coalesce(F.col("circuits").cast("bigint"), F.lit(1)) if "circuits" in features.columns else F.lit(1)
    kept = features if tag is None else features.where(voltage >= voltage_min_kv)
    shaped = kept.select(
        "line_id",
        voltage.alias("voltage"),
        circuits.cast("bigint").alias("circuits"),
        geo.parse_polyline(F.col(polyline)).alias("_points"),
    )
    start, end = geo.end_points(F.col("_points"))
    return shaped.select(
        "line_id", "voltage", "circuits", start.alias("start"), end.alias("end"),
        geo.polyline_length_km(F.col("_points")).alias("length"),
    ).where(F.col("length") > 0)


def cluster_input(lines: DataFrame, substations: DataFrame | None, voltage_unit: str = "V") -> DataFrame:
    """(row_id, x, y, voltage, name): both ends of each line, then the substations, in that order."""
    ends = lines.select("line_id", "voltage", F.posexplode(F.array("start", "end")).alias("i", "p")).select(
        (F.col("line_id") * 2 + F.col("i")).alias("row_id"),
        F.col("p.x").alias("x"),
        F.col("p.y").alias("y"),
        "voltage",
        F.lit(None).cast("string").alias("name"),
    )
    if substations is None:
        return ends
    # Substations follow all line ends, whatever their number.
    offset = F.lit(1 << 61)
    tagged = text.voltage_text(F.col("voltage")) if "voltage" in substations.columns else F.lit(DEFAULT_VOLTAGE_KV)
    label = F.coalesce(F.col("name"), F.concat(F.lit("Substation_"), F.col("substation_id").cast("string")))
    places = substations.select(
        (offset + F.col("substation_id")).alias("row_id"),
        F.col("lon").alias("x"),
        F.col("lat").alias("y"),
        _kv(tagged, voltage_unit).alias("voltage") if voltage_unit == "V" else tagged.alias("voltage"),
        label.alias("name"),
    )
    return ends.unionByName(places)


def line_impedance(lines: DataFrame) -> DataFrame:
    """Add r, x and b from voltage band, length and circuits."""
    per = F.col("length") / F.col("circuits")
    return lines.withColumns(
        {
            "r": geo.resistance_per_km(F.col("voltage")) * per,
            "x": geo.reactance_per_km(F.col("voltage")) * per,
            "b": F.lit(0.0),
        }
    )


def build_network(
    features: Sequence[DataFrame],
    substations: DataFrame | None,
    voltage_min_kv: float = 220.0,
    voltage_unit: str = "V",
    tolerance: float = 5000.0,
) -> tuple[DataFrame, DataFrame]:
    """(buses, lines) from line and cable features and substations."""
    # Parsed once: the steps below read the lines several times.
    lines = checkpointed(prepared_lines(concat_tables(features), voltage_min_kv, voltage_unit))
    buses = checkpointed(spatial.cluster_buses(cluster_input(lines, substations, voltage_unit), tolerance))
    return buses, spatial.connect_lines(lines, buses)


def export_network(buses: DataFrame, lines: DataFrame, country: str) -> dict[str, DataFrame]:
    """Tables `buses`, `lines` and the one-row `network`, ready to write."""
    code = country.upper()
    out_buses = buses.select(
        "bus_id", "name", "x", "y", "v_nom", F.lit("AC").alias("carrier"), F.lit(code).alias("country")
    )
    out_lines = line_impedance(lines).select(
        F.col("line_id").cast("string").alias("name"),
        F.col("bus0").cast("string").alias("bus0"),
        F.col("bus1").cast("string").alias("bus1"),
        "length",
        "circuits",
        "r",
        "x",
        "b",
        F.lit(None).cast("double").alias("s_nom"),
        F.col("circuits").alias("num_parallel"),
        F.col("voltage").alias("v_nom"),
    )
    meta = buses.agg(F.count(F.lit(1)).alias("buses")).select(
        F.lit(f"{code}_network").alias("name"),
        F.lit(1).cast("bigint").alias("snapshots"),
        "buses",
        lines.agg(F.count(F.lit(1))).scalar().alias("lines"),
    )
    return {"buses": out_buses, "lines": out_lines, "network": meta}
