"""Coordinate systems of .prj files: WKT of both versions, PROJ strings and bare EPSG codes, read to structs of `functions.crs`.

A text is read to a tree once a worker and distinct text; what the tree says of ellipsoid, meridian, units, shift and projection
becomes the struct. A text that cannot be read, or names another projection, gives null."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterlane.functions import crs

_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z_][A-Za-z0-9_]*)|([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)|([\[\](),]))')
_PROJECTED, _GEOGRAPHIC = {"projcs", "projcrs", "projectedcrs"}, {"geogcs", "geogcrs", "geodcrs", "geodeticcrs", "geographiccrs", "basegeogcrs", "basegeodcrs"}
#: Names of projections (lower case, letters and digits alone) by kind, and of parameters by field.
_KINDS = {"transversemercator": "tmerc", "gausskruger": "tmerc", "mercator": "merc", "mercator1sp": "merc", "mercator2sp": "merc", "mercatorvarianta": "merc", "mercatorvariantb": "merc",
          "mercatorauxiliarysphere": "webmerc", "popularvisualisationpseudomercator": "webmerc", "lambertconformalconic": "lcc", "lambertconformalconic1sp": "lcc", "lambertconformalconic2sp": "lcc", "lambertconicconformal1sp": "lcc", "lambertconicconformal2sp": "lcc"}
_FIELDS = {"centralmeridian": "lon0", "longitudeofnaturalorigin": "lon0", "longitudeoforigin": "lon0", "longitudeoffalseorigin": "lon0", "longitudeofcenter": "lon0", "latitudeoforigin": "lat0", "latitudeofnaturalorigin": "lat0", "latitudeoffalseorigin": "lat0", "latitudeofcenter": "lat0",
           "scalefactor": "k0", "scalefactoratnaturalorigin": "k0", "falseeasting": "fe", "eastingatfalseorigin": "fe", "falsenorthing": "fn", "northingatfalseorigin": "fn", "standardparallel1": "sp1", "latitudeof1ststandardparallel": "sp1", "standardparallel2": "sp2", "latitudeof2ndstandardparallel": "sp2"}
_SHIFTS = ("xaxistranslation", "yaxistranslation", "zaxistranslation", "xaxisrotation", "yaxisrotation", "zaxisrotation", "scaledifference")
_ED50 = {"europeandatum1950", "european1950", "deuropean1950", "ed50", "deuropeandatum1950"}
_ELLIPSOIDS = {"WGS84": crs.WGS84, "GRS80": crs.GRS80, "intl": crs.INTERNATIONAL}  # of PROJ strings
_LETTERS = re.compile(r"[^a-z0-9]")
_NAMES = crs.SCHEMA.names


def plain(name: str) -> str:
    return _LETTERS.sub("", name.lower())


def parsed(text: str) -> tuple[str, list]:
    """(keyword in lower case, values): numbers, strings, keywords without values, and such pairs. Raises ValueError."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"not WKT at {at}")
        tokens.append(m.groups())
        at = m.end()
    place = 0

    def node(depth: int):
        nonlocal place
        string, word, number, mark = tokens[place]
        place += 1
        if string is not None:
            return string.replace('""', '"')
        if number is not None:
            return float(number)
        if word is None or depth > 50:
            raise ValueError("a value was expected")
        if place >= len(tokens) or tokens[place][3] not in ("[", "("):
            return word
        values = []
        while tokens[place][3] not in ("]", ")"):
            place += 1  # the opening bracket or a comma
            values.append(node(depth + 1))
            if place >= len(tokens) or tokens[place][3] not in (",", "]", ")"):
                raise ValueError("a bracket is open")
        place += 1
        return word.lower(), values

    if not tokens:
        raise ValueError("empty")
    out = node(0)
    if place != len(tokens) or not isinstance(out, tuple):
        raise ValueError("more than one value")
    return out


def children(node: tuple, *names: str) -> list[tuple]:
    return [v for v in node[1] if isinstance(v, tuple) and v[0] in names]


def first(node: tuple, *names: str) -> tuple | None:
    return next(iter(children(node, *names)), None)


def _unit(node: tuple | None, *names: str) -> float | None:
    found = first(node, *names) if node else None
    return float(found[1][1]) if found and len(found[1]) > 1 else None


def _code(node: tuple) -> int | None:
    for v in children(node, "authority", "id"):
        if len(v[1]) > 1 and str(v[1][0]).upper() == "EPSG":
            return int(float(v[1][1]))
    return None


def _system(node: tuple) -> dict | None:
    """The struct's fields of a tree; None for a projection that is not known."""
    out = dict.fromkeys(_NAMES) | {"lon0": 0.0, "lat0": 0.0, "k0": 1.0, "fe": 0.0, "fn": 0.0, "unit": 1.0}
    shift = None
    if node[0] == "boundcrs":
        steps = first(node, "abridgedtransformation")
        given = {plain(p[1][0]): float(p[1][1]) for p in children(steps, "parameter")} if steps else {}
        if given:
            shift = [given.get(k, 0.0) for k in _SHIFTS]
            frame = first(steps, "method")
            if frame and "coordinateframe" in plain(frame[1][0]):
                shift[3:6] = [-v for v in shift[3:6]]
            if abs(shift[6]) > 0 and given.get("scaledifference", 0) > 0.5:
                shift[6] = (given["scaledifference"] - 1) * 1e6
        source = first(node, "sourcecrs")
        node = source[1][0] if source else node
    if node[0] in ("compd_cs", "compoundcrs"):
        node = next(v for v in node[1] if isinstance(v, tuple) and v[0] in _PROJECTED | _GEOGRAPHIC)
    base = node if node[0] in _GEOGRAPHIC else first(node, *_GEOGRAPHIC)
    if node[0] not in _PROJECTED | _GEOGRAPHIC or base is None:
        return None
    datum = first(base, "datum", "geodeticdatum", "trf", "ensemble")
    ellipsoid = first(datum, "spheroid", "ellipsoid")
    out["a"] = float(ellipsoid[1][1]) * (_unit(ellipsoid, "lengthunit", "unit") or 1.0)
    out["f"] = 1 / float(ellipsoid[1][2]) if ellipsoid[1][2] else 0.0
    moved = first(datum, "towgs84")
    if moved:
        shift = ([float(v) for v in moved[1]] + [0.0] * 7)[:7]
    if shift is None and (plain(str(datum[1][0])) in _ED50):
        shift = list(crs.ED50_SHIFT)
    out["shift"] = shift if shift and any(shift) else None
    system = first(base, "cs")
    angle = math.degrees(_unit(base, "unit", "angleunit") or _unit(system, "angleunit") or next((u for a in children(base, "axis") if (u := _unit(a, "angleunit"))), 0.017453292519943295))
    angle = round(angle, 12)
    meridian = first(base, "primem", "primemeridian")
    greenwich = float(meridian[1][1]) * angle if meridian else 0.0
    out["epsg"], out["name"] = _code(node), str(node[1][0])
    if node is base:
        return out | {"kind": "longlat", "unit": angle, "lon0": greenwich}
    conversion = first(node, "conversion") or node
    method = first(conversion, "method", "projection")
    out["kind"] = _KINDS.get(plain(str(method[1][0])))
    if out["kind"] is None:
        return None
    out["unit"] = _unit(node, "unit", "lengthunit") or next((u for a in children(node, "axis") if (u := _unit(a, "lengthunit", "unit"))), 1.0)
    for p in children(conversion, "parameter"):
        field = _FIELDS.get(plain(str(p[1][0])))
        if field in ("fe", "fn"):
            out[field] = float(p[1][1]) * (_unit(p, "lengthunit", "unit") or out["unit"])
        elif field == "k0":
            out[field] = float(p[1][1])
        elif field:
            own = _unit(p, "angleunit", "unit")
            out[field] = float(p[1][1]) * (round(math.degrees(own), 12) if own else angle)
    out["lon0"] += greenwich
    return out


def _proj(text: str) -> dict | None:
    """The struct's fields of a PROJ string; None for what is not known."""
    given = dict((*p.split("=", 1), "")[:2] for p in re.findall(r"\+(\S+)", text))
    number = lambda k, default=0.0: float(given.get(k, default))
    a, rf = _ELLIPSOIDS.get(given.get("ellps") or given.get("datum", "WGS84"), (None, None))
    out = dict.fromkeys(_NAMES) | {"a": number("a", a), "f": 1 / number("rf", rf) if "rf" in given or rf else 0.0, "lon0": number("lon_0"), "lat0": number("lat_0"), "k0": number("k_0", given.get("k", 1.0)), "fe": number("x_0"), "fn": number("y_0"), "unit": number("to_meter", 1.0), "name": text.strip()}
    for field in ("sp1", "sp2"):
        if (k := {"sp1": "lat_1", "sp2": "lat_2"}[field]) in given:
            out[field] = number(k)
    if "lat_ts" in given and given.get("proj") == "merc":
        out["sp1"] = number("lat_ts")
    if "towgs84" in given:
        shift = ([float(v) for v in given["towgs84"].split(",")] + [0.0] * 7)[:7]
        out["shift"] = shift if any(shift) else None
    kind = {"longlat": "longlat", "latlong": "longlat", "tmerc": "tmerc", "utm": "tmerc", "lcc": "lcc", "merc": "merc"}.get(given.get("proj", ""))
    if kind is None:
        return None
    if given["proj"] == "utm":
        out |= {"lon0": number("zone") * 6 - 183, "lat0": 0.0, "k0": 0.9996, "fe": 500_000.0, "fn": 10_000_000.0 if "south" in given else 0.0}
    return out | {"kind": kind}


@lru_cache(maxsize=4096)
def fields(text: str) -> dict | None:
    try:
        return _proj(text) if text.lstrip().startswith("+") else _system(parsed(text))
    except (ValueError, TypeError, IndexError, StopIteration, KeyError, ZeroDivisionError, RecursionError):
        return None


@F.pandas_udf(crs.SCHEMA)
def _read(text: pd.Series) -> pd.DataFrame:
    none = dict.fromkeys(_NAMES)
    rows = [(fields(t) if t else None) or none for t in text]
    return pd.DataFrame(rows, columns=_NAMES).astype({"epsg": "Int32"})


def system_of(text: Column) -> Column:
    """The system of a .prj text: of a bare code by its number, else as the text says; null if it cannot be told."""
    code = F.regexp_extract(text, r"^\s*(?i:EPSG:)\s*([0-9]{1,6})\s*$", 1).try_cast("int")
    read = _read(text)
    return F.when(code.isNotNull(), crs.from_epsg(code)).when(read["kind"].isNotNull(), read)
