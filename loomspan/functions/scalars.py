"""Scalar rules as columns: coded numbers, units, growing degree days, reference evapotranspiration and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(text: Column) -> Column:
    """Amount of a string such as 10.5K, 2M or 1B; null if it is none."""
    clean = F.upper(F.trim(text))
    number = F.regexp_extract(clean, r"^\$?([0-9.]+)([KMB]?)$", 1).try_cast("double")
    unit = F.regexp_extract(clean, r"^\$?([0-9.]+)([KMB]?)$", 2)
    return number * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)


def tornado_scale(text: Column) -> Column:
    """0 to 5 of F0..F5 or EF0..EF5; null for anything else."""
    return F.nullif(F.regexp_extract(F.upper(text), r"^E?F([0-5])$", 1), F.lit("")).try_cast("double")


#: Codes that stand for a number that is not given.
CODES = {"(D)": "withheld", "(S)": "suppressed", "(NA)": "not_available", "(Z)": "below_half_unit", "(X)": "not_applicable"}


def coded_number(text: Column) -> Column:
    """struct(value, status) of a number with thousands commas or a code in brackets."""
    clean = F.upper(F.trim(text))
    value = F.replace(clean, F.lit(","), F.lit("")).try_cast("double")
    status = F.when(clean.isNull() | (clean == ""), "missing")
    for code, name in CODES.items():
        status = status.when(clean == code, name)
    status = status.when(value.isNull(), "unparsed").otherwise("ok")
    return F.struct(F.when(status == "ok", value).alias("value"), status.alias("status"))


def knots_to_mph(value: Column, unit: Column) -> Column:
    """Speeds in knots as miles an hour."""
    return F.when(F.contains(F.lower(unit), F.lit("kt")), value * 1.15078).otherwise(value)


def degree_days(tmax: Column, tmin: Column, low: float = 10.0, high: float = 30.0) -> Column:
    """Growing degree days with both temperatures held within [low, high]; null if either is."""
    held = lambda t: F.greatest(F.least(t, F.lit(high)), F.lit(low))
    return F.when(tmax.isNotNull() & tmin.isNotNull(), (held(tmax) + held(tmin)) / 2 - low)


def excess(value: Column, limit: float) -> Column:
    """How far a value is above a limit; null stays null."""
    return F.when(value.isNotNull(), F.greatest(value - limit, F.lit(0.0)))


def year_class(days: Column) -> Column:
    """Extreme from 3 days, Moderate from 1, else Normal."""
    return F.when(days >= 3, "Extreme").when(days >= 1, "Moderate").otherwise("Normal")


def fourier(step: Column, first: int, period: float) -> list[Column]:
    """Sine and cosine of the phase in a period, rounded half-even to 6 places."""
    phase = 2 * 3.141592653589793 * (step - first) / period
    return [F.bround(F.sin(phase), 6).alias("sin"), F.bround(F.cos(phase), 6).alias("cos")]


def saturation(t: Column) -> Column:
    """Saturation vapour pressure (kPa) at t degrees Celsius."""
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def extraterrestrial(lat: Column, doy: Column) -> Column:
    """Extraterrestrial radiation (MJ / m2 / day) at a latitude in degrees on a day of the year."""
    turn = 2 * 3.141592653589793 * doy / 365
    distance, declination, phi = 1 + 0.033 * F.cos(turn), 0.409 * F.sin(turn - 1.39), F.radians(lat)
    sunset = F.acos(F.greatest(F.least(-F.tan(phi) * F.tan(declination), F.lit(1.0)), F.lit(-1.0)))
    return 24 * 60 / 3.141592653589793 * 0.0820 * distance * (sunset * F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.sin(sunset))


def reference_et(tmax: Column, tmin: Column, ea: Column, rs: Column, u2: Column, elevation: Column, lat: Column, doy: Column) -> Column:
    """FAO-56 reference evapotranspiration (mm / day), not below 0."""
    t = (tmax + tmin) / 2
    es = (saturation(tmax) + saturation(tmin)) / 2
    slope = 4098 * saturation(t) / F.pow(t + 237.3, F.lit(2))
    gamma = 0.000665 * 101.3 * F.pow((293 - 0.0065 * elevation) / 293, F.lit(5.26))
    clear = (0.75 + 2e-5 * elevation) * extraterrestrial(lat, doy)
    ratio = F.least(F.greatest(F.try_divide(rs, clear), F.lit(0.3)), F.lit(1.0))
    longwave = 4.903e-9 * (F.pow(tmax + 273.16, F.lit(4)) + F.pow(tmin + 273.16, F.lit(4))) / 2 * (0.34 - 0.14 * F.sqrt(ea)) * (1.35 * ratio - 0.35)
    net = 0.77 * rs - longwave
    et = (0.408 * slope * net + gamma * 900 / (t + 273) * u2 * (es - ea)) / (slope + gamma * (1 + 0.34 * u2))
    return F.greatest(et, F.lit(0.0))


def probit(p: Column) -> Column:
    """Inverse of the standard normal distribution by Acklam's rational approximation (error below 1.2e-9 of the result)."""
    # fixed values of the approximation
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def horner(coefficients, x, last=None):
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + k
        return out if last is None else out * x + last

    def tail(x):
        return horner(c, x) / horner(d, x, 1.0)

    q = p - 0.5
    middle = horner(a, q * q) * q / horner(b, q * q, 1.0)
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(middle)


def one_hot(column: str, values: list[str]) -> list[Column]:
    """A 0/1 column for each value, named <column>_<value>; null is 0 in all of them."""
    return [F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values]


def padded_code(column: Column, width: int) -> Column:
    """A numeric code as digits with leading zeros; null for null."""
    return F.lpad(column.cast("string"), width, "0")


def event_hours(begin: Column, end: Column, pattern: str = "dd-MMM-yyyy HH:mm") -> Column:
    """Hours between two texts of the pattern, 0 at least; null where either cannot be read."""
    seconds = lambda c: F.unix_timestamp(F.try_to_timestamp(c, F.lit(pattern)))
    return F.greatest((seconds(end) - seconds(begin)) / 3600.0, F.lit(0.0))


def miles_an_hour(value: Column, unit: Column) -> Column:
    """Wind speed in mph: values whose unit speaks of knots are converted."""
    return F.when(F.upper(unit).contains("KT"), value * 1.15078).otherwise(value)


def tonnes_per_hectare(bushels: Column) -> Column:
    """Maize yield in t/ha from bushels an acre."""
    return bushels * 0.0627


def interactions(pairs: list[tuple[str, str]], places: int = 4) -> list[Column]:
    """Products of column pairs, rounded half to even."""
    return [F.bround(F.col(a) * F.col(b), places).alias(f"{a}_x_{b}") for a, b in pairs]


def weighted_stages(values: dict[str, float]) -> Column:
    """Sum of stage columns times their weights; null stages add nothing."""
    out = F.lit(0.0)
    for column, weight in values.items():
        out = out + F.coalesce(F.col(column), F.lit(0.0)) * weight
    return out


def killing_degree_days(t: Column, base: float = 30.0) -> Column:
    """Degrees above the base, 0 below it."""
    return F.greatest(t - base, F.lit(0.0))


def drought_severity(index: Column) -> Column:
    """How far an index lies below -1, else 0; null for null."""
    return F.when(index < -1, -index).when(index.isNotNull(), 0.0)


def wind_at_two_metres(u: Column, v: Column) -> Column:
    """Wind speed at 2 m from the two components at 10 m."""
    return 0.748 * F.hypot(u, v)


def vapour_pressure(q: Column, pressure: Column) -> Column:
    """Vapour pressure (kPa) from specific humidity and pressure (Pa)."""
    return q * pressure / (0.622 + 0.378 * q) / 1000


def radiation_mj(watts: Column) -> Column:
    """MJ a square metre and day from mean W a square metre."""
    return watts * 0.0864


def implausible(bounds: dict[str, tuple[float, float]]) -> Column:
    """Array of the names of columns outside their bounds; nulls are not outside."""
    marks = [F.when((F.col(c) < low) | (F.col(c) > high), F.lit(c)) for c, (low, high) in bounds.items()]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def day_of_year_date(year: Column, doy: Column) -> Column:
    """The date of a day of the year."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))


def quality_flag_ok(flags: Column, good: tuple[str, ...]) -> Column:
    """Whether the second of comma-parted flags is among the good ones; null flags are not."""
    parts = F.split(flags, ",")
    return F.coalesce((F.size(parts) > 1) & F.try_element_at(parts, F.lit(2)).isin(*good), F.lit(False))


def compound(index: Column, t: Column, dry: float = -1.0, hot: float = 35.0) -> list[Column]:
    """Whether it is dry and hot, and |index| * (t - hot) where it is (else 0); null where either input is."""
    both = (index < dry) & (t > hot)
    return [both.alias("compound"), F.when(both, F.abs(index) * (t - hot)).when(both.isNotNull(), 0.0).alias("severity")]


def highest_of(columns: list[str]) -> Column:
    """The name of the column with the greatest value; ties go to the one named first; null if all are."""
    best = F.array_max(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("v"), F.lit(-i).alias("i"), F.lit(c).alias("c"))) for i, c in enumerate(columns)]))
    return best.getField("c")


def row_sum(columns: list[str]) -> Column:
    """Sum of the columns that have a value; null if none has."""
    any_of = F.coalesce(*[F.col(c).cast("double") for c in columns])
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return F.when(any_of.isNotNull(), total)


def pinball(y: Column, pred: Column, tau: float) -> Column:
    """Quantile loss at level tau."""
    e = y - pred
    return F.greatest(tau * e, (tau - 1) * e)


def huber(y: Column, pred: Column, delta: float = 1.0) -> Column:
    """Quadratic within delta, linear beyond."""
    e = F.abs(y - pred)
    return F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))


def variable_metadata(name: Column) -> Column:
    """(kind, unit, window) of a variable by rules on its name."""
    kind = F.when(name.rlike("^(tmax|tmin|tmean|gdd|kdd)"), "temperature").when(name.rlike("^(ppt|rain|spi|spei)"), "moisture").when(name.rlike("price|cost"), "money").when(name.rlike("key$"), "key").otherwise("other")
    unit = F.when(name.rlike("^t(max|min|mean)"), "degC").when(name.rlike("^(ppt|rain)"), "mm").when(name.rlike("price|cost"), "usd").otherwise("")
    window = F.regexp_extract(name, "_(ann|gs|veg|silk|grain)$", 1)
    return F.struct(kind.alias("kind"), unit.alias("unit"), window.alias("window"))
