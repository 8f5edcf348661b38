"""Derived columns, scores and predicates, as column expressions over named columns."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hours_between(start: str | Column, end: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(3600e6)


def episode_times(df: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """hour, dow (Monday 0), month, year, is_weekend, is_night of the start; los_hours and los_days where an end is named."""
    t = F.col(start)
    out = df.withColumns({"hour": F.hour(t), "dow": F.weekday(t), "month": F.month(t), "year": F.year(t)})
    out = out.withColumns({"is_weekend": F.col("dow").isin(5, 6).cast("int"), "is_night": ((F.col("hour") >= 22) | (F.col("hour") <= 6)).cast("int")})
    return out.withColumns({"los_hours": hours_between(start, end), "los_days": hours_between(start, end) / 24}) if end else out


def living(df: DataFrame, flag: Column, death_time: str | None = None) -> DataFrame:
    dead = F.coalesce(flag, F.lit(False))
    return df.filter(~(dead | F.col(death_time).isNotNull() if death_time else dead))


def within_window(events: DataFrame, episodes: DataFrame, key: list[str], at: str, start: str, hours: float) -> DataFrame:
    """Events up to `hours` after their episode's start; earlier ones stay, those without a time or start go."""
    limit = F.col(start).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600))
    return events.join(episodes.select(*key, start), key).filter(F.col(at).cast("timestamp") <= limit)


def landmark(df: DataFrame, event: str, end: str, at: float, horizon: float, label: str = "label") -> DataFrame:
    """Rows still in their episode and free of the event at time `at`; label: the event falls in (at, at + horizon]."""
    free = F.col(event).isNull() | (F.col(event) > at)
    hit = F.coalesce((F.col(event) > at) & (F.col(event) <= at + horizon), F.lit(False))
    return df.filter((F.col(end) > at) & free).withColumn(label, hit.cast("int"))


def at_risk_label(at_risk: Column, label: Column) -> Column:
    return F.when(at_risk, label)


def match_patterns(columns: list[str], patterns: list[str]) -> list[str]:
    return [c for c in columns if any(fnmatchcase(c, p) for p in patterns)]


def exclude(df: DataFrame, patterns: list[str]) -> DataFrame:
    return df.drop(*match_patterns(df.columns, patterns))


def protocol(df: DataFrame, lists: dict[str, list[str]], chosen: list[str]) -> tuple[DataFrame, list[str]]:
    """df without the columns of the chosen named exclusion lists, and the patterns of theirs that match no column.

    A pattern that matches nothing is most likely a misspelt one, and a leak.
    """
    patterns = list(dict.fromkeys(p for name in chosen for p in lists[name]))
    return exclude(df, patterns), [p for p in patterns if not match_patterns(df.columns, [p])]


def interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs if a in df.columns and b in df.columns})


def band_score(value: str | Column, bands: list[tuple[float, int]], above: int) -> Column:
    """Points of the first half-open band whose upper end lies above the value; null stays null."""
    v = F.col(value) if isinstance(value, str) else value
    out = None
    for upper, points in bands:
        out = (F if out is None else out).when(v < upper, F.lit(points))
    return F.when(v.isNotNull(), out.otherwise(F.lit(above)))


def composite_score(parts: dict[str, Column], least: int) -> Column:
    """The sum of the known parts, null where fewer than `least` are known."""
    known = sum((p.isNotNull().cast("int") for p in parts.values()), F.lit(0))
    return F.when(known >= least, sum((F.coalesce(p, F.lit(0)) for p in parts.values()), F.lit(0)))


#: Bands of the national early warning score, second version: (below, points), then points above. Fixed values.
NEWS2_BANDS = {
    "resp_rate": ([(9, 3), (12, 1), (21, 0), (25, 2)], 3),
    "spo2": ([(92, 3), (94, 2), (96, 1)], 0),
    "systolic": ([(91, 3), (101, 2), (111, 1), (220, 0)], 3),
    "heart_rate": ([(41, 3), (51, 1), (91, 0), (111, 1), (131, 2)], 3),
    "temperature": ([(35.1, 3), (36.1, 1), (38.1, 0), (39.1, 1)], 2),
    "gcs": ([(15, 3)], 0),
}


def early_warning(df: DataFrame, sources: dict[str, list[str]], fahrenheit: str | None = None, least: int = 4) -> DataFrame:
    """df with news2. sources: candidate columns for each part, in order; degrees Fahrenheit fill in for Celsius."""
    parts = {}
    for part, (bands, above) in NEWS2_BANDS.items():
        found = [F.col(c) for c in sources.get(part, []) if c in df.columns]
        if part == "temperature" and fahrenheit and fahrenheit in df.columns:
            found.append((F.col(fahrenheit) - 32) * 5 / 9)
        parts[part] = band_score(F.coalesce(*found), bands, above) if found else F.lit(None).cast("int")
    return df.withColumn("news2", composite_score(parts, least))


def lace(df: DataFrame, days: str, acute: Column, comorbidity: str, visits: str) -> DataFrame:
    """df with lace in 0..1: length of stay, acuity, comorbidity, earlier visits, out of 18 points."""
    d, c = F.col(days), F.coalesce(F.col(comorbidity), F.lit(0))
    stay = F.when(d < 1, 0).when(d < 2, 1).when(d < 3, 2).when(d < 4, 3).when(d < 7, 4).when(d < 14, 5).otherwise(6)
    ill = F.when(c >= 4, 5).otherwise(c)
    total = F.coalesce(stay, F.lit(0)) + F.when(acute, 3).otherwise(0) + ill + F.least(F.coalesce(F.col(visits), F.lit(0)), F.lit(4))
    return df.withColumn("lace", total / F.lit(18.0))


def age_band(age: str, edges: list[int] = (18, 40, 55, 65, 75, 85, 121)) -> Column:
    v = F.col(age)
    out = None
    for lo, hi in zip(edges, edges[1:], strict=False):
        out = (F if out is None else out).when((v >= lo) & (v < hi), F.lit(f"{lo}-{hi - 1}"))
    return out


def collapse_label(c: str) -> Column:
    """"A - B/C" becomes "A"; empty becomes UNKNOWN."""
    head = F.upper(F.trim(F.split_part(F.split_part(F.coalesce(F.col(c), F.lit("")), F.lit(" - "), F.lit(1)), F.lit("/"), F.lit(1))))
    return F.when(head == "", "UNKNOWN").otherwise(head)


def tier(p: str, cuts: list[float], names: list[str]) -> Column:
    out = None
    for cut, name in zip(cuts, names, strict=False):
        out = (F if out is None else out).when(F.col(p) < cut, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def first_match(text: str, rules: list[tuple[str, str]], default: str) -> Column:
    """The category of the first pattern that a lower-cased text matches."""
    out = None
    for pattern, name in rules:
        out = (F if out is None else out).when(F.lower(F.col(text)).rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(default))


def alerts(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules.items())))


def completeness(fields: dict[str, list[Column]], ranges: dict[str, tuple[float, float]]) -> list[Column]:
    """missing, implausible and uninterpretable field names, and the share of fields that are usable.

    fields: candidate text columns for each field; the first that is not null counts.
    """
    raw = {f: F.coalesce(*cs) for f, cs in fields.items()}
    number = {f: v.try_cast("double") for f, v in raw.items()}
    bad = {f: raw[f].isNotNull() & number[f].isNull() for f in fields}
    odd = {f: number[f].isNotNull() & ~number[f].between(*ranges[f]) for f in fields if f in ranges}
    good = sum((F.coalesce(number[f].between(*ranges[f]) if f in ranges else number[f].isNotNull(), F.lit(False)).cast("int") for f in fields), F.lit(0))
    names = lambda conds: F.array_join(alerts(conds), ",")
    return [names({f: raw[f].isNull() for f in fields}).alias("missing"), names(odd).alias("implausible"), names(bad).alias("uninterpretable"), F.round(good / len(fields), 4).alias("completeness")]
