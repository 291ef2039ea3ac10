"""Operators by name, and runs of them from parameter files."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

from .operators import columns, combine, grid, groups, halos, projection, rows, sample, stats, surface
from .sources import halo, text
from .sources.fields import opened

OPERATORS: dict[str, Callable] = {
    "randomizer": sample.randomize, "selcolumns": columns.select_columns, "merge": combine.merge, "append": combine.append, "selfield": rows.select_rows,
    "mathop": columns.math_column, "decimator": sample.decimate, "visualop": sample.visual_sample, "extraction": rows.extract, "showtable": text.show_table,
    "statistic": stats.statistic, "pointdistribute": grid.scatter, "coarsevolume": sample.coarsen, "extractsubvolume": rows.extract_subvolume, "pointproperty": grid.point_property,
    "interpolate": combine.snapshots, "module": columns.module, "sigmacontours": rows.sigma_contours, "cartesian2polar": columns.cartesian_to_polar, "vbt2ahf": halo.scaled,
    "grid2point": grid.gather, "extractlist": rows.extract_list, "addId": columns.add_id, "ahfhalolist": rows.halo_lists, "changecolname": columns.rename_columns,
    "ahfhalogalaxyext": rows.halo_routes, "splittable": combine.split_rows, "wrvotable": text.write_votable, "cut": columns.cut, "showvol": rows.show_volume, "include": columns.include,
    "mres": sample.multi_resolution, "histogram": stats.histogram, "normalise": stats.normalize, "selvol": rows.select_volume,
    "splittable_value": combine.split_by_value, "splittable_volume": combine.split_volume, "poca": grid.closest_approach, "voxels": grid.voxel_statistics,
    "smooth": surface.smooth, "isosurface": surface.isosurface, "project": projection.project, "picture": projection.picture, "groups": groups.dense_groups, "halos": halos.halos,
}


def run(op: str, *tables: DataFrame, **params: object) -> object:
    """The operator on the tables; unknown names of operators or parameters are errors."""
    if op not in OPERATORS:
        raise ValueError(f"no operator {op}")
    known = inspect.signature(OPERATORS[op]).parameters
    unknown = [k for k in params if k not in known]
    if unknown:
        raise ValueError(f"{op} has no parameter {', '.join(unknown)}")
    return OPERATORS[op](*tables, **params)


def parameters(text: str) -> dict[str, str]:
    """``key=value`` lines; lines that begin with # and blank ones are none."""
    found = {}
    for line in (x.strip() for x in text.splitlines() if not x.startswith("#")):
        if line:
            key, sign, value = line.partition("=")
            if not sign:
                raise ValueError(f"not a parameter: {line}")
            found[key.strip()] = value.strip()
    return found


def converted(value: str) -> object:
    """Numbers as such, several words as a list, ``true`` and ``false``; all else stays text."""
    words = value.split()
    if len(words) > 1:
        return [converted(x) for x in words]
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def run_file(path: str, *tables: DataFrame) -> object:
    """The operator that the file names as ``op``, with its other parameters; an empty value or ``unknown`` leaves one at its default."""
    with opened(path) as f:
        found = parameters(f.read().decode())
    op = found.pop("op")
    return run(op, *tables, **{k: converted(v) for k, v in found.items() if v and v != "unknown"})
