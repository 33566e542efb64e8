"""Column functions: strings, bins, arrays, JSON and dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_before(c: Column, mark: str) -> Column:
    """What stands before the first `mark` (the whole text if there is none)."""
    return F.substring_index(c, mark, 1)


def symbol_root(c: Column) -> Column:
    """Trailing digits off, then one trailing capital if more than 3 characters are left; names under 3 characters stay whole."""
    bare = F.regexp_replace(c, "[0-9]+$", "")
    cut = F.when((F.length(bare) > 3) & bare.rlike("[A-Z]$"), F.regexp_replace(bare, "[A-Z]$", "")).otherwise(bare)
    return F.when(F.length(cut) >= 3, cut).otherwise(c)


def contact_parts(c: Column) -> tuple[Column, Column]:
    """(shaft, number) of a contact name such as A'12; nulls where the name has no such form."""
    pattern = r"([A-Za-z']+)([0-9]+)$"
    shaft, number = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    return F.nullif(shaft, F.lit("")), F.nullif(number, F.lit("")).cast("int")


def derivation_contacts(c: Column) -> Column:
    """Contacts of a derivation: both sides of A1-A2, three of a laplacian A2 (A1..A3 by number), or the name itself."""
    shaft, number = contact_parts(F.regexp_replace(c, "^lap:", ""))
    around = F.array(*(F.concat(shaft, (number + k).cast("string")) for k in (-1, 0, 1)))
    return F.when(c.startswith("lap:"), around).when(c.contains("-"), F.split(c, "-")).otherwise(F.array(c))


def truthy(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("yes", "1", "true", "y")


def tidy_text(c: Column) -> Column:
    """Typographic minus and quotes to ASCII, runs of white space to one space."""
    return F.trim(F.regexp_replace(F.translate(c, "−–‘’“”", "--''\"\""), r"\s+", " "))


def right_closed_bin(c: Column, width: float, bins: int) -> Column:
    """Bin numbers of (lo, hi], clamped to 0..bins-1; the quotient is rounded so that an edge stays on its side."""
    return F.least(F.greatest(F.ceil(F.round(c / width, 9)) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")


def left_closed_bin(c: Column, width: float, bins: int) -> Column:
    """Bin numbers of [lo, hi), clamped to 0..bins-1."""
    return F.least(F.greatest(F.floor(F.round(c / width, 9)), F.lit(0)), F.lit(bins - 1)).cast("int")


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def finite_or(c: Column, value: float) -> Column:
    """The number, or `value` where it is null, not a number or infinite."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), value).otherwise(c)


def sigmoid(c: Column) -> Column:
    return 0.5 * (1 + F.tanh(0.5 * c))


def softplus(c: Column) -> Column:
    """log(1 + exp(c)) without overflow."""
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def logsumexp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def unit_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, o = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c if isinstance(c, Column) else F.col(c))


def day_of_year(c: Column) -> Column:
    return F.least(F.dayofyear(c), F.lit(365))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def proximity(a: Column, b: Column) -> Column:
    """2<a,b> / (<a,a> + <b,b>)."""
    return F.try_divide(2 * dot(a, b), dot(a, a) + dot(b, b))


def zero_at(values: Column, places: list[int]) -> Column:
    return F.transform(values, lambda x, i: F.when(i.isin(places), 0.0).otherwise(x))


def snap(c: Column, scale: Column, tolerance: float) -> Column:
    """c rounded to multiples of tolerance * scale, so that near-ties are ties."""
    return F.round(c / (tolerance * scale)) * (tolerance * scale)


def quantise(c: Column, largest: Column) -> Column:
    """Symmetric 8-bit code of c / largest."""
    return F.round(c / largest * 127 + 128).cast("int")


def dig(json: Column, path: str) -> Column:
    """A number at a dotted path of a JSON text; the first one if it is a list."""
    found = F.get_json_object(json, f"$.{path}")
    return F.coalesce(F.try_to_number(F.get_json_object(json, f"$.{path}[0]"), F.lit("999999999")).cast("double"), found.try_cast("double"))


def significance(c: Column) -> Column:
    """1 for pathogenic, 0 for benign, null for neither or for conflicting texts."""
    low = F.lower(c)
    bad, good = low.contains("pathogenic"), low.contains("benign")
    return F.when(low.contains("conflicting") | (bad & good), None).when(bad, 1).when(good, 0)


def polynomial(lags: list[Column], degree: int) -> list[Column]:
    """All products of up to `degree` (2 or 3) lags, by rising degree."""
    n = len(lags)
    out = list(lags) + [lags[i] * lags[j] for i in range(n) for j in range(i, n)]
    if degree > 2:
        out += [lags[i] * lags[j] * lags[k] for i in range(n) for j in range(i, n) for k in range(j, n)]
    return out


def all_of(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions)


def name_root(c: Column, known: list[str]) -> Column:
    """The longest known name left after taking digits and the letters L, R, D, V off the end, at least one; the name itself if none is known."""
    spare = F.length(F.regexp_extract(c, "[0-9LRDV]*$", 0))
    roots = F.when(spare > 0, F.transform(F.sequence(F.lit(1), spare), lambda k: F.substring(c, F.lit(1), F.length(c) - k)))
    return F.coalesce(F.try_element_at(F.filter(roots, lambda r: r.isin(known)), F.lit(1)), c)


def interactions(own: Column, code: Column) -> Column:
    """Every entry of one array times every entry of another, by rows."""
    return F.flatten(F.transform(own, lambda a: F.transform(code, lambda b: a * b)))
