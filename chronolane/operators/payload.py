"""Fields of semi-structured payloads: ordered paths, the first that is there wins; numbers, plausibility, completeness."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A number under the first of some dotted paths that a payload has, and the range in which it is plausible."""

    name: str
    paths: tuple[str, ...]
    low: float
    high: float
    required: bool = True


def variant_path(path: str) -> str:
    return "$" + "".join(f"['{p}']" for p in path.split("."))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once for a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def number(v: Column) -> Column:
    """The finite number that a variant holds, or its text spells, thousands separated by commas or not; else null. Truth values are no numbers."""
    text = F.trim(F.replace(F.try_variant_get(v, "$", "string"), F.lit(","), F.lit("")))  # of truth values, objects and arrays no number
    return let(text.try_cast("double"), lambda x: F.when(F.abs(x) < float("inf"), x))


def fetch(df: DataFrame, column: str, fields: list[Field]) -> DataFrame:
    """df with `fields`: an array of (name, path, value, state) in the order of fields.

    state: missing (no path is there), uninterpretable (there, but no number), implausible or ok; path is the one that hit. A path
    that leads to null is there. A payload that is null, no JSON or no object has nothing. Each payload is parsed once.
    """

    def found(f: Field, v: Column) -> Column:
        hits = F.array(*(F.struct(F.lit(p).alias("path"), F.try_variant_get(v, variant_path(p), "variant").alias("x")) for p in f.paths))
        first = F.get(F.filter(hits, lambda h: h["x"].isNotNull()), F.lit(0))
        return let(let(first, lambda h: F.struct(h["path"].alias("path"), number(h["x"]).alias("value"))), lambda g: judged(f, g["path"], g["value"]))

    def judged(f: Field, path: Column, value: Column) -> Column:
        state = F.when(path.isNull(), "missing").when(value.isNull(), "uninterpretable").when(~value.between(f.low, f.high), "implausible").otherwise("ok")
        return F.struct(F.lit(f.name).alias("name"), path.alias("path"), value.alias("value"), state.alias("state"))

    return df.withColumn("fields", let(F.try_parse_json(column), lambda v: F.array(*(found(f, v) for f in fields))))


def verdict(df: DataFrame, fields: list[Field]) -> DataFrame:
    """df of fetch() with ok, completeness, and the names that are missing (required), missing_recommended, implausible or uninterpretable.

    ok: every required field is there and no field that is there is implausible or uninterpretable. completeness: the share of all fields that are ok.
    """
    required = [f.name for f in fields if f.required]
    names = lambda state, which=None: F.transform(F.filter("fields", lambda c: (c["state"] == state) & (F.lit(True) if which is None else c["name"].isin(*which) if which else F.lit(False))), lambda c: c["name"])
    out = df.withColumns({
        "missing": names("missing", required),
        "missing_recommended": names("missing", [f.name for f in fields if not f.required]),
        "implausible": names("implausible"),
        "uninterpretable": names("uninterpretable"),
        "completeness": F.round(F.size(names("ok")) / len(fields), 6),
    })
    return out.withColumn("ok", (F.size("missing") + F.size("implausible") + F.size("uninterpretable") == 0).cast("int"))
