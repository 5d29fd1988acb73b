"""An edit log over labelled instances: the last edit of each kind wins; what is saved, exported and shown follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edited(items: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """``items`` (``key, label, active``) after ``log`` (``seq, op, key, base, label``) in order of ``seq``.

    ``relabel`` sets one item's label, ``set_active`` and ``set_inactive`` its state; ``class_active`` and
    ``class_inactive`` set that of all items whose original label is ``base``. Of state edits, those of one item
    and of its class count alike: the last one wins. Edits of one ``seq`` go by label, or by state.
    """
    own = log.where(F.col("op") == "relabel").groupBy(key).agg(F.max_by("label", F.struct("seq", "label")).alias("_label"))
    on = F.col("op").endswith("_active")
    state = log.where(F.col("op").isin("set_active", "set_inactive")).groupBy(key).agg(F.max(F.struct("seq", on.alias("on"))).alias("_own"))
    whole = log.where(F.col("op").isin("class_active", "class_inactive")).groupBy("base").agg(F.max(F.struct("seq", on.alias("on"))).alias("_class"))
    out = items.join(own, key, "left").join(state, key, "left").join(whole, F.col("label") == F.col("base"), "left")
    last = F.greatest("_own", "_class")
    return out.select(key, F.coalesce("_label", "label").alias("label"), F.coalesce(last["on"], "active").alias("active"), F.col("_label").isNotNull().alias("relabelled"))


def mode_kept(mode: str, label: Column, seed: Column, other: str = "other") -> Column:
    """Whether a point takes part in a pick: ``same`` label as the seed, ``loose`` also the other class, else ``all``."""
    if mode == "same":
        return label == seed
    return (label == seed) | (label == other) if mode == "loose" else F.lit(True)


def class_sets(label: Column) -> dict[str, Column]:
    """Which classes are background, and which have no instances."""
    key = F.lower(F.trim(label))
    other = F.contains(key, F.lit("other"))
    return {"background": key.isin("wall", "floor", "ceiling") | other, "no_instances": key.isin("wall", "floor") | other, "ignored": F.startswith(key, F.lit("other"))}
