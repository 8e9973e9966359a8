"""Records of many schemas, each worked on by expressions compiled from its own, in one pass over the records."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import avro
from millrace.session import fresh_path

#: Recipes that share one expression; more of them are more branches, none of which reads another's records.
AT_ONCE = 8
#: Parts that the records of one recipe are dealt to, so that a hot one isn't written by one task.
SPREAD = 32

Work = Callable[..., dict[str, Column]]


def each_by_its_own(rows: DataFrame, recipe: list[str], recipes: DataFrame, text: str, work: Work, made: dict[str, str]) -> DataFrame:
    """``rows`` with the columns ``made`` (name -> type) that ``work(node, *recipe)`` gives for the recipe of each row: text
    columns such as its schema and its key path. ``node`` is the column ``text``, parsed.

    The rows are evaluated once and written to the shared folder by the fingerprint of their recipe; every recipe in use is
    compiled once, however many streams share it, and reads its own folder. ``recipes`` holds them all; those that no row uses
    are not compiled, which is why only names of folders and texts of used recipes come to the driver. Rows whose
    first recipe column is null get nulls, and so do those whose recipe can't be compiled, with ``unreadable`` set.
    """
    spark = rows.sparkSession
    print_ = F.when(F.col(recipe[0]).isNotNull(), F.sha2(F.to_json(F.struct(*recipe), {"ignoreNullFields": "false"}), 256))
    path = fresh_path(spark, "by-schema")
    kept = rows.withColumn("_recipe", print_).drop(*recipe)
    salt = F.pmod(F.xxhash64(text), F.lit(SPREAD))
    kept.repartition("_recipe", salt).write.partitionBy("_recipe").parquet(path)
    stored = spark.read.schema(kept.schema).parquet(path)
    used = stored.select("_recipe").distinct()
    texts = recipes.select(*recipe).where(F.col(recipe[0]).isNotNull()).distinct().withColumn("_recipe", print_)
    found = sorted(texts.join(used, "_recipe", "left_semi").collect(), key=lambda row: row["_recipe"])
    nothing = {name: F.lit(None).cast(kind) for name, kind in made.items()}
    none = stored.where(F.col("_recipe").isNull()).withColumns({**nothing, "unreadable": F.lit(False)})
    parts = [none.drop("_recipe")]
    for start in range(0, len(found), AT_ONCE):
        parts.append(_branch(stored, found[start : start + AT_ONCE], recipe, text, work, made))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _branch(stored: DataFrame, found: Iterable, recipe: list[str], text: str, work: Work, made: dict[str, str]) -> DataFrame:
    values = {name: F.lit(None).cast(kind) for name, kind in made.items()}
    prints, broken = [], []
    for row in found:
        prints.append(row["_recipe"])
        mine = F.col("_recipe") == row["_recipe"]
        try:
            own = work(F.col("_node"), *(row[c] for c in recipe))
        except (avro.SchemaError, json.JSONDecodeError, KeyError, TypeError, AttributeError, ValueError):
            broken.append(row["_recipe"])  # one bad registration is no fault of other streams
            continue
        values = {name: F.when(mine, own[name]).otherwise(values[name]) for name in made}
    rows = stored.where(F.col("_recipe").isin(*prints)).withColumn("_node", F.try_parse_json(F.col(text)))
    unreadable = F.col("_recipe").isin(*broken) if broken else F.lit(False)
    return rows.withColumns({**values, "unreadable": unreadable}).drop("_node", "_recipe")
