"""SRC-10: three messy sample tables made of row-id expressions: same columns and faults as real files of their kind,
any number of rows, generated in parallel and the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(salt: int) -> str:
    """A reproducible number in (0, 1) per row."""
    return f"((pmod(xxhash64(id, {salt}), 1000003) + 0.5D) / 1000003)"


def _normal(salt: int) -> str:
    return f"(sqrt(-2 * ln({_unit(salt)})) * cos(6.283185307179586D * {_unit(salt + 1)}))"


def _pick(salt: int, choices: list[tuple[str, float]]) -> str:
    arms, total = [], 0.0
    for value, share in choices[:-1]:
        total += share
        arms.append(f"WHEN {_unit(salt)} < {total!r} THEN {value}")
    return f"CASE {' '.join(arms)} ELSE {choices[-1][0]} END"


def passengers(spark: SparkSession, n: int = 250) -> DataFrame:
    """Skewed fares, gaps in age and cabin, an identifier, a constant and three repeated rows."""
    base = spark.range(n).selectExpr(
        "id", "concat('PASS_', 1000 + id) AS PassengerId", f"cast({_unit(1)} < 0.38 AS int) AS Survived",
        f"{_pick(2, [('1', .24), ('2', .21), ('3', .55)])} AS Pclass",
        f"{_pick(3, [(chr(39) + 'male' + chr(39), .64), (chr(39) + 'female' + chr(39), .36)])} AS Sex",
        f"CASE WHEN {_unit(4)} >= 0.2 THEN round(-6 * (ln({_unit(5)}) + ln({_unit(6)}) + ln({_unit(7)}) + ln({_unit(8)}) "
        f"+ ln({_unit(9)})), 1) END AS Age",
        f"{_pick(10, [('0', .68), ('1', .23), ('2', .05), ('3', .02), ('4', .02)])} AS SibSp",
        f"{_pick(11, [('0', .76), ('1', .16), ('2', .08)])} AS Parch",
        f"round(CASE WHEN {_unit(12)} < 0.032 THEN 250 + 270 * {_unit(13)} ELSE 5 - 25 * ln({_unit(14)}) END, 2) AS Fare",
        f"CASE WHEN {_unit(15)} >= 0.78 THEN concat(element_at(array('C', 'B', 'D', 'E'), cast(1 + floor(4 * {_unit(16)}) "
        f"AS int)), cast(10 + floor(4 * {_unit(17)}) * 20 AS int)) END AS Cabin",
        f"CASE WHEN {_unit(18)} >= 0.02 THEN {_pick(19, [(chr(39) + 'S' + chr(39), .7), (chr(39) + 'C' + chr(39), .2), (chr(39) + 'Q' + chr(39), .1)])} END AS Embarked",
        "'North_Atlantic_Manifest' AS Manifest_Source")
    copies = base.where("id IN (5, 12, 45)")
    return base.unionAll(copies).drop("id")


def telecom(spark: SparkSession, n: int = 300) -> DataFrame:
    """Total charges follow tenure and monthly charges; an ordered tier, an identifier, a constant."""
    return spark.range(n).selectExpr(
        "id", f"1 + floor(71 * {_unit(101)}) AS t", f"round(20 + 98 * {_unit(102)}, 2) AS MonthlyCharges").selectExpr(
        "concat('CUST-', hex(100000 + id)) AS CustomerID",
        f"CASE WHEN {_unit(103)} >= 0.08 THEN cast(t AS double) END AS TenureMonths", "MonthlyCharges",
        f"round(greatest(20, t * MonthlyCharges + 15 * {_normal(104)}), 2) AS TotalCharges",
        f"{_pick(106, [(repr('Month-to-month'), .55), (repr('One year'), .25), (repr('Two year'), .2)])} AS ContractType",
        f"{_pick(107, [(repr(t), .25) for t in ('Bronze', 'Silver', 'Gold', 'Platinum')])} AS ServiceTier",
        f"{_pick(108, [(repr(t), .25) for t in ('Electronic check', 'Mailed check', 'Bank transfer', 'Credit card')])} "
        "AS PaymentMethod",
        f"cast(CASE WHEN {_unit(109)} < 0.017 THEN 7 + floor(7 * {_unit(110)}) ELSE "
        f"floor(-ln({_unit(111)}) * 0.6) END AS int) AS CustomerComplaints",
        f"cast({_unit(112)} < 0.26 AS int) AS Churned", "'TELCO_CORE_V2' AS System_Flag")


def sensors(spark: SparkSession, n: int = 200) -> DataFrame:
    """Hourly readings with text timestamps, gaps, a few impossible temperatures, and a constant."""
    return spark.range(n).selectExpr(
        "date_format(timestamp_ntz'2026-03-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id AS int), 0, 0), "
        "'yyyy-MM-dd HH:mm:ss') AS Timestamp",
        "concat('sens-09a8-', lpad(cast(id AS string), 4, '0')) AS DeviceUUID",
        f"CASE WHEN {_unit(201)} < 0.12 THEN NULL WHEN {_unit(201)} < 0.14 THEN element_at(array(85.2D, 92.4D, -40D, 78.9D), "
        f"cast(1 + id % 4 AS int)) ELSE round(22 + 3.5 * {_normal(202)}, 2) END AS Temperature_C",
        f"round(least(95, greatest(10, 55 + 12 * {_normal(204)})), 1) AS Humidity_Pct",
        f"round(101.3 + 0.8 * {_normal(206)}, 2) AS Pressure_kPa",
        f"{_pick(208, [(repr('Normal'), .82), (repr('Warning'), .14), (repr('Critical'), .04)])} AS OperatingStatus",
        "100D AS StaticCalibration")


# Sample names.
SAMPLES = {"titanic": passengers, "telecom": telecom, "sensors": sensors}


def sample_dataset(spark: SparkSession, name: str, n: int | None = None) -> DataFrame:
    if name not in SAMPLES:
        raise ValueError(f"unknown sample {name!r}; choose from {sorted(SAMPLES)}")
    return SAMPLES[name](spark, n) if n else SAMPLES[name](spark)
