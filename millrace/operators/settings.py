"""Configuration as rows: one per key path and layer, the latest layer winning; as maps only where a program wants them."""

from __future__ import annotations

import ast
from collections.abc import Iterable
from contextlib import suppress
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Leaves = dict[tuple[str, ...], Any]

#: The runs of an ablation study, each with the settings in which it differs from the baseline.
ABLATIONS = [
    ("baseline", []),
    ("A1_adamw", ["optim.kind=adamw"]),
    ("A2_vocab_49k", ["model.vocab_size=49152"]),
    ("A3_mha", ["model.n_kv_head=12"]),
    ("A3_mla", ["model.attn_type=mla", "model.n_kv_head=12"]),
    ("A4_mtp", ["model.mtp_depth=1"]),
    ("A5_full_rope", ["model.nope_every=0"]),
    ("A6_no_qk_norm", ["model.qk_norm=false"]),
    ("A7_moe", ["model.moe=true", "model.n_experts=16", "model.n_experts_active=2", "model.expert_hidden=256"]),
    ("A8_no_doc_mask", ["model.doc_masking=false"]),
    ("A9_cosine", ["optim.schedule=cosine"]),
    ("A10_no_zloss", ["optim.zloss=0.0"]),
]
#: Texts that mean true.
TRUE = ("1", "true", "yes", "on")


def leaves(settings: dict) -> Leaves:
    """Key paths of nested maps with their values; an empty map is a value."""
    out: Leaves = {}
    todo: list[tuple[tuple[str, ...], Any]] = [((), settings)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict) and (value or not path):
            todo += [((*path, k), v) for k, v in value.items()]
        else:
            out[path] = value
    return out


def nested(rows: Leaves) -> dict:
    """The maps that have these key paths."""
    root: dict = {}
    for path in sorted(rows, key=len):
        at = root
        for key in path[:-1]:
            if not isinstance(at.get(key), dict):
                at[key] = {}
            at = at[key]
        at[path[-1]] = rows[path]
    return root


def stacked(layers: Iterable[Leaves]) -> Leaves:
    """One set of key paths out of layers, later ones winning: a value replaces all that lies under its path, and the reverse."""
    out: Leaves = {}
    for layer in layers:
        inner = {p[:k] for p in out for k in range(1, len(p))}  # paths that are maps so far
        new = {p: v for p, v in layer.items() if not (v == {} and p in inner)}  # an empty map changes no map
        above = {p[:k] for p in new for k in range(1, len(p))}
        out = {p: v for p, v in out.items() if p not in above and not any(p[:k] in new for k in range(1, len(p) + 1))} | new
    return out


def deep_merge(base: dict, over: dict) -> dict:
    """Nested maps merged; over wins, also where only one side is a map."""
    return nested(stacked([leaves(base), leaves(over)]))


def overrides(pairs: Iterable[str]) -> dict:
    """Nested maps of a.b=value settings, with or without -- in front; a value is a Python literal or else text."""
    layers: list[Leaves] = []
    for text in pairs:
        name, sign, value = text.removeprefix("--").partition("=")
        if not sign:
            raise ValueError(f"an override must be key=value: {text!r}")
        meant: Any = value
        with suppress(ValueError, SyntaxError):
            meant = ast.literal_eval(value)
        layers.append({tuple(name.split(".")): meant})
    return nested(stacked(layers))


def load_layers(path: str) -> dict:
    """A YAML file on top of those it names in _base_, relative to itself; a file that includes itself is an error.

    The files are put in order first, each after those it builds on, and then laid on each other.
    """
    import yaml

    order: list[Leaves] = []
    todo: list[tuple[Path, tuple[Path, ...], dict | None]] = [(Path(path).resolve(), (), None)]
    while todo:
        file, open_files, content = todo.pop()
        if content is not None:  # what it builds on has been put before it
            order.append(leaves(content))
            continue
        if file in open_files:
            raise ValueError(f"{file} includes itself")
        content = dict(yaml.safe_load(file.read_text()) or {})
        named = content.pop("_base_", None) or []
        todo.append((file, open_files, content))
        for base in reversed([named] if isinstance(named, str) else named):
            todo.append(((file.parent / base).resolve(), (*open_files, file), None))
    return nested(stacked(order))


def override_parts(text: Column) -> tuple[Column, Column]:
    """(path, value) of settings a.b=value, with or without -- in front; one without = is an error."""
    bare = F.regexp_replace(text, "^--", "")
    at = F.instr(bare, "=")
    wrong = F.raise_error(F.concat(F.lit("an override must be key=value: "), text))
    return F.when(at > 0, F.substr(bare, F.lit(1), at - 1)).otherwise(wrong), F.substr(bare, at + 1)


def resolved(rows: DataFrame) -> DataFrame:
    """(path, value) of (layer, path, value) with dotted paths: the value of the latest layer, unless a still later one has a value above or
    below the path, which makes it a map or replaces the map it is in. Null paths and layers are left out."""
    last = rows.where("path is not null and layer is not null").groupBy("path").agg(F.max("layer").alias("layer"), F.max_by("value", "layer").alias("value"))
    keys = F.split("path", r"\.")
    shorter = F.transform(F.sequence(F.lit(1), F.size(keys) - 1), lambda k: F.array_join(F.slice(keys, F.lit(1), k), "."))
    above = last.where(F.size(keys) > 1).select("path", "layer", F.explode(shorter).alias("up"))
    tip = last.select(F.col("path").alias("up"), F.col("layer").alias("up_layer"))
    met = above.join(tip, "up")
    gone = met.where("up_layer > layer").select("path").union(met.where("up_layer <= layer").select(F.col("up").alias("path"))).distinct()
    return last.join(gone, "path", "left_anti").select("path", "value")


def coerced(value: Column, kind: Column) -> Column:
    """A value's text as a setting of that kind (bool, int, float, str) would write it; what doesn't convert stays as it is."""
    bare = F.trim(value)
    whole = F.when(bare.rlike("^[+-]?[0-9]+$"), bare.try_cast("bigint").cast("string"))
    real = bare.try_cast("double").cast("string")
    return (
        F.when(kind == "bool", F.lower(bare).isin(*TRUE).cast("string"))
        .when(kind == "int", F.coalesce(whole, value))
        .when(kind == "float", F.coalesce(real, value))
        .otherwise(value)
    )


def typed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(path, kind, value) of the settings (path, value) that `known` (path, kind) has; unknown ones are ignored, nulls stay null."""
    return rows.join(known, "path").select("path", "kind", coerced(F.col("value"), F.col("kind")).alias("value"))


def ablations(spark) -> DataFrame:
    """(run, path, value), a row for each setting in which a run differs; the baseline has one of null path."""
    rows = [(run, text) for run, texts in ABLATIONS for text in texts or [None]]
    path, value = override_parts(F.col("text"))
    given = F.col("text").isNotNull()
    return spark.createDataFrame(rows, "run string, text string").select("run", F.when(given, path).alias("path"), F.when(given, value).alias("value"))
