"""Covariate designs: missing values to the mean, dummies without the first level, z-scores, constant columns dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_SD = 1e-12


def zscore(obs: DataFrame, columns: list[str]) -> DataFrame:
    """Each column as its z-score within the cell type (population deviation); null where it is constant.

    Means and deviations are aggregated first, a row a cell type: no task gathers a cell type's cells.
    """
    if not columns:
        return obs
    names, each = obs.columns, list(enumerate(columns))
    stats = obs.groupBy("celltype").agg(F.count("*").alias("_n"), *[f(c).alias(f"_{k}{i}") for i, c in each for k, f in (("m", F.avg), ("s", F.stddev_pop), ("k", F.count))])
    joined = obs.join(F.broadcast(stats), "celltype", "left")
    new = {}
    for i, c in each:
        # a missing value counts as the mean: it adds a row and no deviation
        sd = F.col(f"_s{i}") * F.sqrt(F.col(f"_k{i}") / F.col("_n"))
        new[c] = F.when(sd >= LEAST_SD, (F.coalesce(F.col(c), F.col(f"_m{i}")) - F.col(f"_m{i}")) / sd)
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in names])


def one_hot(obs: DataFrame, column: str, most: int = 1000) -> tuple[DataFrame, list[str]]:
    """Dummies of a label within each cell type, its first sorted level left out; a missing label is the level 'nan'.

    A label of more than ``most`` levels is refused: each level is a column of every design.
    """
    label = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    levels = [r[0] for r in obs.select(label.alias("l")).distinct().orderBy("l").limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError(f"{column} has more than {most} levels")
    least = obs.groupBy("celltype").agg(F.min(label).alias("_least"))
    names = [f"{column}_{v}" for v in levels]
    joined = obs.join(F.broadcast(least), "celltype", "left")
    return joined.select(*[F.col(f"`{c}`") for c in obs.columns], *[F.when(label == F.col("_least"), F.lit(0.0)).otherwise((label == v).cast("double")).alias(n) for n, v in zip(names, levels, strict=True)]), names


def design(obs: DataFrame, covariates: list[str]) -> tuple[DataFrame, list[str]]:
    """obs with z-scored covariate columns and their names.  'CDR' means cdr; unknown names are ignored."""
    have, names = {c.lower(): c for c in obs.columns}, []
    for c in covariates:
        found = have.get(c.lower()) if c.lower() == "cdr" else c if c in obs.columns else None
        if found is None:
            continue
        if obs.schema[found].dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "boolean", "decimal"):
            z = f"z_{found}"
            obs = obs.withColumn(z, F.col(found).cast("double"))
            names.append(z)
        else:
            obs, more = one_hot(obs, found)
            names += more
    return zscore(obs, names), names
