"""Domain formulas of the sustainability and sensor tables.

All are Column expressions evaluated inside whole-stage codegen. Operation order follows
the reference formulas so results are the same IEEE doubles; null inputs give null (the
reference gives NaN) rather than a floor value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from verdant.functions.generic import TWO_PI, _c, clip, floor_at, lookup, ColumnOrName

# ---------------------------------------------------------------------------------------
# Fixed values of the reference formulas (must equal the reference for equal results).
# ---------------------------------------------------------------------------------------
CROP_CARBON = {"Wheat": 2500.0, "Corn": 3000.0, "Rice": 4000.0, "Soybeans": 2000.0,
               "Cotton": 3500.0, "Potatoes": 2800.0}
METHOD_FACTOR = {"Conventional": 1.0, "Organic": 0.7, "Conservation": 0.8, "Precision": 0.75,
                 "Regenerative": 0.6}
SEQUESTRATION_RATE = {"Regenerative": 500.0, "Conservation": 300.0, "Organic": 200.0, "Precision": 100.0}
CROP_WATER = {"Wheat": 4500.0, "Corn": 6000.0, "Rice": 10000.0, "Soybeans": 5000.0,
              "Cotton": 7000.0, "Potatoes": 4000.0}
IRRIGATION_FACTOR = {"Flood": 1.5, "Drip": 0.6, "Sprinkler": 0.9, "Subsurface": 0.7, "Rainfed": 0.1}
SOIL_FACTOR = {"Sandy": 1.3, "Loamy": 0.9, "Clay": 0.8, "Silt": 1.0, "Peat": 0.7}
RECYCLING_POTENTIAL = {"Drip": 60.0, "Subsurface": 40.0, "Sprinkler": 30.0, "Flood": 10.0}
# farming system -> (pesticide factor, fertilizer factor)
SYSTEM_ADJUST = {"Organic": (0.2, 0.6), "Regenerative": (0.3, 0.5), "Biodynamic": (0.1, 0.4),
                 "Integrated": (0.7, 0.8)}
# impact score -> (base, {system: reduction}); order Regenerative, Organic, Biodynamic, Integrated
IMPACT_REDUCTION = {
    "biodiversity_impact_score": (8.0, {"Regenerative": 3.0, "Organic": 2.5, "Biodynamic": 3.5, "Integrated": 1.5}),
    "soil_health_impact_score": (7.0, {"Regenerative": 4.0, "Organic": 3.0, "Biodynamic": 4.0, "Integrated": 2.0}),
    "water_quality_impact_score": (6.0, {"Regenerative": 3.0, "Organic": 2.5, "Biodynamic": 3.0, "Integrated": 1.5}),
    "air_quality_impact_score": (5.0, {"Regenerative": 2.0, "Organic": 1.5, "Biodynamic": 2.0, "Integrated": 1.0}),
}
OVERALL_WEIGHTS = {"biodiversity_impact_score": 0.3, "soil_health_impact_score": 0.3,
                   "water_quality_impact_score": 0.25, "air_quality_impact_score": 0.15}


def _soft(key: ColumnOrName, mapping: dict, default: float = 0.0) -> Column:
    return lookup(key, mapping, strict=False, default=default)


# --- carbon (F1-F3) ---------------------------------------------------------------------

def carbon_footprint(crop="crop_type", method="farming_method", size="farm_size_hectares",
                     fertilizer="fertilizer_kg_per_hectare", machinery="machinery_hours",
                     transport="transport_distance_km", energy="energy_consumption_kwh") -> Column:
    """F1: max(0, cropC*methodF*size/100 + 3 fert + 10 machine_h + 0.2 km + 0.5 kWh)."""
    raw = (lookup(crop, CROP_CARBON) * lookup(method, METHOD_FACTOR) * (_c(size) / F.lit(100.0))
           + _c(fertilizer) * F.lit(3.0) + _c(machinery) * F.lit(10.0)
           + _c(transport) * F.lit(0.2) + _c(energy) * F.lit(0.5))
    return floor_at(raw, 0.0)


def sequestration(method="farming_method", size="farm_size_hectares") -> Column:
    """max(0, rate(method) * size / 100)."""
    return floor_at(_soft(method, SEQUESTRATION_RATE) * _c(size) / F.lit(100.0), 0.0)


def net_carbon(footprint="carbon_footprint_kg_co2e",
               seq="carbon_sequestration_potential_kg_co2e") -> Column:
    """footprint - sequestration."""
    return _c(footprint) - _c(seq)


def with_carbon_metrics(df: DataFrame) -> DataFrame:
    """The reference carbon table: F1, F2, F3 added under the reference column names."""
    return (df.withColumn("carbon_footprint_kg_co2e", carbon_footprint())
              .withColumn("carbon_sequestration_potential_kg_co2e", sequestration())
              .withColumn("net_carbon_impact_kg_co2e", net_carbon()))


# --- water (F4-F6) ----------------------------------------------------------------------

def water_usage(crop="crop_type", irrigation="irrigation_method", soil="soil_type",
                size="farm_size_hectares", temperature="temperature_celsius",
                rainfall="annual_rainfall_mm") -> Column:
    """max(0, cropW*irrF*soilF*size/100*(1+(T-20)/50)*(1-rain/3000))."""
    raw = (lookup(crop, CROP_WATER) * lookup(irrigation, IRRIGATION_FACTOR) * lookup(soil, SOIL_FACTOR)
           * (_c(size) / F.lit(100.0))
           * (F.lit(1.0) + (_c(temperature) - F.lit(20.0)) / F.lit(50.0))
           * (F.lit(1.0) - _c(rainfall) / F.lit(3000.0)))
    return floor_at(raw, 0.0)


def water_efficiency(usage="water_usage_cubic_meters", crop="crop_type") -> Column:
    """usage / (cropW / 1000)."""
    return _c(usage) / (lookup(crop, CROP_WATER) / F.lit(1000.0))


def water_recycling(irrigation="irrigation_method") -> Column:
    """clip(potential(irrigation), 0, 100)."""
    return clip(_soft(irrigation, RECYCLING_POTENTIAL), 0.0, 100.0)


def with_water_metrics(df: DataFrame) -> DataFrame:
    return (df.withColumn("water_usage_cubic_meters", water_usage())
              .withColumn("water_efficiency_cubic_meters_per_ton", water_efficiency())
              .withColumn("water_recycling_potential_percent", water_recycling()))


# --- regenerative practices (P5, F7-F9) -------------------------------------------------

def practice_columns(df: DataFrame, prefix: str = "uses_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def practice_count(df: DataFrame, prefix: str = "uses_") -> Column:
    """P5: row-wise sum of all ``uses_*`` columns (schema order)."""
    cols = practice_columns(df, prefix)
    if not cols:
        return F.lit(0).cast("bigint")
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols])


def soil_organic_matter(initial="soil_organic_matter_percent_initial",
                        practices="total_practices_adopted",
                        years="years_practicing_regenerative") -> Column:
    """max(initial, initial + practices*0.2*min(years,10)/10)."""
    grown = _c(initial) + _c(practices) * F.lit(0.2) * clip(years, hi=10.0) / F.lit(10.0)
    ini = _c(initial)
    return F.when(grown < ini, ini).otherwise(grown)


def biodiversity(practices="total_practices_adopted", agroforestry="uses_agroforestry",
                 rotation="uses_crop_rotation") -> Column:
    """F8: clip(5 + 0.8 practices + 2 [agroforestry] + 1.5 [rotation], 1, 10)."""
    truthy = lambda c: F.when(_c(c).isNotNull() & (_c(c) != 0), F.lit(1)).otherwise(F.lit(0))
    raw = (F.lit(5.0) + _c(practices) * F.lit(0.8) + truthy(agroforestry) * F.lit(2.0)
           + truthy(rotation) * F.lit(1.5))
    return clip(raw, 1.0, 10.0)


def economic_resilience(practices="total_practices_adopted",
                        years="years_practicing_regenerative") -> Column:
    """clip(4 + 0.7 practices + 0.2 years, 1, 10)."""
    return clip(F.lit(4.0) + _c(practices) * F.lit(0.7) + _c(years) * F.lit(0.2), 1.0, 10.0)


def with_regen_metrics(df: DataFrame) -> DataFrame:
    return (df.withColumn("total_practices_adopted", practice_count(df))
              .withColumn("soil_organic_matter_percent_current", soil_organic_matter())
              .withColumn("biodiversity_score", biodiversity())
              .withColumn("economic_resilience_score", economic_resilience()))


# --- environmental impact (P8, F10, F11) -------------------------------------------------

def system_adjust(df: DataFrame, system="farming_system",
                  pesticide="pesticide_use_kg_per_hectare",
                  fertilizer="fertilizer_use_kg_per_hectare") -> DataFrame:
    """Scale pesticide / fertilizer in place by farming system (else unchanged)."""
    pest = _soft(system, {k: v[0] for k, v in SYSTEM_ADJUST.items()}, 1.0)
    fert = _soft(system, {k: v[1] for k, v in SYSTEM_ADJUST.items()}, 1.0)
    return df.withColumns({pesticide: F.col(pesticide) * pest, fertilizer: F.col(fertilizer) * fert})


def impact_scores(system="farming_system", pesticide="pesticide_use_kg_per_hectare",
                  fertilizer="fertilizer_use_kg_per_hectare",
                  energy="energy_use_kwh_per_hectare") -> dict[str, Column]:
    """the four impact sub-scores, each clipped to 1..10 (inputs after P8)."""
    p = _c(pesticide) / F.lit(10.0)
    f = _c(fertilizer) / F.lit(300.0)
    e = _c(energy) / F.lit(2000.0)
    # added left to right after the reduction, as in the reference
    extra = {
        "biodiversity_impact_score": [p * F.lit(3.0)],
        "soil_health_impact_score": [p * F.lit(2.0), f * F.lit(3.0)],
        "water_quality_impact_score": [p * F.lit(4.0), f * F.lit(3.0)],
        "air_quality_impact_score": [e * F.lit(5.0)],
    }
    out = {}
    for name, (base, red) in IMPACT_REDUCTION.items():
        score = reduce(lambda a, b: a + b, extra[name], F.lit(base) - _soft(system, red))
        out[name] = clip(score, 1.0, 10.0)
    return out


def overall_impact(prefix: str = "") -> Column:
    """0.3 bio + 0.3 soil + 0.25 water + 0.15 air."""
    terms = [F.col(prefix + k) * F.lit(w) for k, w in OVERALL_WEIGHTS.items()]
    return reduce(lambda a, b: a + b, terms)


def with_env_metrics(df: DataFrame) -> DataFrame:
    adjusted = system_adjust(df)
    return (adjusted.withColumns(impact_scores())
                    .withColumn("overall_environmental_impact_score", overall_impact()))


# --- sensor readings (F12-F14) -----------------------------------------------------------

def yield_estimate(temperature="temperature", moisture="soil_moisture", rainfall: str | None = "rainfall") -> Column:
    """100*(1+te+me+re)/3; without rainfall the short form 100*(1+te+me)/2."""
    dt = _c(temperature) - F.lit(25.0)
    dm = _c(moisture) - F.lit(35.0)
    te = F.lit(-0.5) * (dt * dt) / F.lit(100.0)
    me = F.lit(-0.5) * (dm * dm) / F.lit(100.0)
    if rainfall is None:
        return F.lit(100.0) * (F.lit(1.0) + te + me) / F.lit(2.0)
    r = _c(rainfall)
    re = F.when(r < F.lit(10.0), F.lit(0.1) * r).otherwise(F.lit(1.0) - F.lit(0.02) * (r - F.lit(10.0)))
    return F.lit(100.0) * (F.lit(1.0) + te + me + re) / F.lit(3.0)


def season_factors(ts="event_time") -> dict[str, Column]:
    """seasonal sin(2 pi doy/365) and daily sin(2 pi hour/24)."""
    t = _c(ts)
    return {
        "season_factor": F.sin(F.lit(TWO_PI) * F.dayofyear(t) / F.lit(365.0)),
        "daily_factor": F.sin(F.lit(TWO_PI) * F.hour(t) / F.lit(24.0)),
    }


def expected_readings(season="season_factor", daily="daily_factor") -> dict[str, Column]:
    """the deterministic part of each reading given the seasonal / daily factors."""
    s, d = _c(season), _c(daily)
    return {
        "expected_temperature": F.lit(25.0) + F.lit(10.0) * s + F.lit(5.0) * d,
        "expected_humidity": F.lit(60.0) + F.lit(20.0) * s - F.lit(10.0) * d,
        "expected_rainfall": floor_at(F.lit(5.0) * s - F.lit(2.0) * d, 0.0),
        "expected_soil_moisture": F.lit(30.0) + F.lit(15.0) * s,
        "expected_solar_radiation": floor_at(F.lit(800.0) + F.lit(400.0) * s + F.lit(300.0) * d, 0.0),
        "expected_wind_speed": F.lit(5.0) + F.lit(2.0) * s + F.lit(3.0) * d,
    }


SENSOR_FIELDS = ["temperature", "humidity", "rainfall", "soil_moisture", "solar_radiation", "wind_speed"]


def with_yield(df: DataFrame, target: str = "yield") -> DataFrame:
    return df.withColumn(target, yield_estimate())
