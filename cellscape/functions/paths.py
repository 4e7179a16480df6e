"""Path handling as column expressions: resolve, contain, name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellscape.functions.raster import col


def _empty() -> Column:
    return F.array().cast("array<string>")


def resolve(path: str | Column) -> Column:
    """Absolute path parts with '.', '' and '..' resolved; '..' at the root stays there."""

    def step(stack: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), stack)
            .when(part == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))))
            .otherwise(F.concat(stack, F.array(part)))
        )

    return F.aggregate(F.split(col(path), "/"), _empty(), step)


def absolute(root: str, folder: str | Column, value: str | Column) -> Column:
    """Where `value`, written in `folder` under `root`, points before it is resolved."""
    v = col(value)
    return F.when(v.startswith("/"), v).otherwise(F.concat_ws("/", F.lit(root), col(folder), v))


def relative_parts(parts: Column, root: str) -> Column:
    """Parts below the root, NULL when the resolved path lies outside it."""
    top = [p for p in root.split("/") if p]
    inside = F.slice(parts, 1, len(top)) == F.array(*[F.lit(p) for p in top])
    return F.when(inside, F.slice(parts, len(top) + 1, F.greatest(F.size(parts) - len(top), F.lit(0))))


def catalog_path_problem(root: str, folder: str | Column, value: str | Column) -> Column:
    """Catalog rule: outside and hidden are judged after '..' has been resolved."""
    rest = relative_parts(resolve(absolute(root, folder, value)), root)
    return F.when(rest.isNull(), "outside").when(F.exists(rest, lambda p: p.startswith(".")), "hidden")


def prepared_path_problem(folder: str | Column, value: str | Column) -> Column:
    """Preparation rule: every component is judged while walking, before '..' is resolved."""
    v = col(value)

    def step(state: Column, part: Column) -> Column:
        done = state["problem"].isNotNull()
        problem = (
            F.when(done, state["problem"])
            .when((part == "..") & (state["depth"] == 0), F.lit("outside"))
            .when((part != "..") & part.startswith("."), F.lit("hidden"))
        )
        depth = state["depth"] + F.when(part == "..", -1).otherwise(1)
        return F.struct(depth.cast("int").alias("depth"), problem.cast("string").alias("problem"))

    parts = F.filter(F.split(F.concat_ws("/", col(folder), v), "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.lit(0).cast("int").alias("depth"), F.lit(None).cast("string").alias("problem"))
    return (
        F.when(v.isNull() | (v == "") | v.contains("\\") | v.contains(":") | v.contains("\x00"), "invalid")
        .when(v.startswith("/"), "outside")
        .otherwise(F.aggregate(parts, start, step)["problem"])
    )


def stem(path: str | Column) -> Column:
    """File name without its last extension; a leading dot is not an extension."""
    name = F.regexp_extract(col(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"^(.*[^.].*)\.[^.]*$", "$1")


def first_folder(parts: Column, root_name: str) -> Column:
    """Top-level folder of a relative path, the root's own name for a flat file."""
    return F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(F.lit(root_name))
