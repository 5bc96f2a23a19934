"""Scoring of sign-ups: forest and tree models, rule lifts, decisions, alerts, experiments."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns
from ..functions.address import domain_part, email_hash, local_part, mask_email
from .features import FEATURE_NAMES, build_feature_vector, feature_sources, signals

# Feature, then (threshold, decision, reason, offset).
RULES = {
    "tld_risk_score": ((0.9, "block", "heuristic_tld_extreme", 0.1), (0.8, "warn", "heuristic_tld_high", 0.1)),
    "domain_reputation_score": ((0.95, "block", "heuristic_domain_reputation_critical", 0.08), (0.85, "warn", "heuristic_domain_reputation_watch", 0.08)),
    "sequential_confidence": ((0.98, "block", "heuristic_sequence_numeric_extreme", 0.05), (0.9, "warn", "heuristic_sequence_numeric_high", 0.05)),
    "digit_ratio": ((0.9, "block", "heuristic_digit_ratio_extreme", 0.05), (0.8, "warn", "heuristic_digit_ratio_high", 0.05)),
    "plus_risk": ((0.8, "block", "heuristic_plus_tag_abuse", 0.03),),
}
DEPTH_LIMIT = 50


@dataclass(frozen=True)
class Config:
    warn: float = 0.56
    block: float = 0.88
    invalid_score: float = 0.8
    disposable_score: float = 0.95
    professional_factor: float = 0.5
    override: str | None = None
    rules: dict = field(default_factory=lambda: RULES)


# ---- models ----


def validate_model(model: dict) -> list[str]:
    """what is wrong with a forest in JSON form; nothing in a good one."""
    wrong = []
    meta, forest = model.get("meta") or {}, model.get("forest")
    if not isinstance(forest, list) or not forest:
        return ["no trees"]
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)
    if not isinstance(meta.get("features"), list) or not meta["features"]:
        wrong.append("no feature list")
    if meta.get("tree_count") != len(forest):
        wrong.append("tree_count differs from the number of trees")
    if not all(number(v) for v in (meta.get("feature_importance") or {}).values()):
        wrong.append("an importance isn't a number")
    cal = meta.get("calibration")
    if cal is not None and not all(number(cal.get(k)) for k in ("coef", "intercept")):
        wrong.append("calibration isn't numeric")
    stack = list(forest)
    while stack:
        n = stack.pop()
        if not isinstance(n, dict) or n.get("t") not in ("n", "l") or not number(n.get("v")):
            return [*wrong, "a node is malformed"]
        if n["t"] == "n":
            if not isinstance(n.get("f"), str) or "l" not in n or "r" not in n:
                return [*wrong, "an inner node is malformed"]
            stack += [n["l"], n["r"]]
    return wrong


def flatten_forest(model: dict) -> tuple[list[str], list[tuple[np.ndarray, ...]], int]:
    """Feature names, arrays (feature, value, left, right) for each tree, and the depth at which a walk gives up."""
    names = sorted({n["f"] for tree in model["forest"] for n in _nodes(tree) if n["t"] == "n"})
    at = {f: i for i, f in enumerate(names)}
    trees = []
    for tree in model["forest"]:
        order = list(_nodes(tree))
        index = {id(n): i for i, n in enumerate(order)}
        inner = lambda n: n["t"] == "n"
        trees.append((
            np.array([at[n["f"]] if inner(n) else -1 for n in order]), np.array([float(n["v"]) for n in order]),
            np.array([index[id(n["l"])] if inner(n) else i for i, n in enumerate(order)]), np.array([index[id(n["r"])] if inner(n) else i for i, n in enumerate(order)])))
    depth = (model.get("meta", {}).get("config") or {}).get("max_depth", 20)
    return names, trees, min(int(depth), DEPTH_LIMIT)


def _nodes(tree: dict) -> Iterator[dict]:
    stack = [tree]
    while stack:
        n = stack.pop()
        yield n
        if n["t"] == "n":
            stack += [n["l"], n["r"]]


def leaf_values(x: np.ndarray, trees: list[tuple[np.ndarray, ...]], depth: int) -> Iterator[np.ndarray]:
    """Each tree's leaf values for the rows of x. Missing and NaN features go left, as does <=; a walk that ends at no leaf gives 0."""
    rows = np.arange(len(x))
    for feature, value, left, right in trees:
        at = np.zeros(len(x), dtype=int)
        for _ in range(depth):
            f = feature[at]
            if (f < 0).all():
                break
            v = x[rows, np.maximum(f, 0)]
            at = np.where(~(v > value[at]), left[at], right[at])
        yield np.where(feature[at] < 0, value[at], 0.0)


def _inputs(df: DataFrame, names: list[str]) -> list[Column]:
    have = {c.lower() for c in df.columns}
    inputs = [F.col(n).cast("double") if n.lower() in have else F.lit(None).cast("double") for n in names]
    return inputs + [F.lit(0.0)] * max(0, 2 - len(inputs))  # a single column wouldn't come as a tuple


def forest_score(df: DataFrame, model: dict, calibrate: int = 1, out: str = "score") -> DataFrame:
    """df with the mean of the trees' leaves. `calibrate` says how often the model's calibration is applied; features that df lacks are missing."""
    names, trees, depth = flatten_forest(model)
    cal = (model.get("meta") or {}).get("calibration")

    @F.pandas_udf(T.DoubleType())
    def walk(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.column_stack([np.asarray(c, dtype=float) for c in columns])
            yield pd.Series(sum(leaf_values(x, trees, depth), np.zeros(len(x))) / len(trees))

    score = walk.asNondeterministic()(*_inputs(df, names))  # computed once, before what uses it
    scored = df.withColumn(out, score)
    for _ in range(calibrate if cal else 0):
        scored = scored.withColumn(out, apply_platt(F.col(out), cal["coef"], cal["intercept"]))
    return scored


def forest_leaves(df: DataFrame, model: dict, out: str = "leaves") -> DataFrame:
    """df with an array of all trees' leaf values, in the order of the trees."""
    names, trees, depth = flatten_forest(model)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def walk(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.column_stack([np.asarray(c, dtype=float) for c in columns])
            yield pd.Series(list(np.column_stack(list(leaf_values(x, trees, depth)))), dtype=object)

    return df.withColumn(out, walk.asNondeterministic()(*_inputs(df, names)))


def apply_platt(score: Column, coef: float, intercept: float) -> Column:
    """The calibrated score, from a sigmoid whose input is clamped to +-500."""
    z = F.greatest(F.least(F.lit(float(coef)) * score + F.lit(float(intercept)), F.lit(500.0)), F.lit(-500.0))
    return 1 / (1 + F.exp(-z))


def read_tree(node: dict) -> dict:
    """A decision tree's node in short keys, from either form of JSON."""
    if "forest" in node:
        node = node["forest"][0]
    kind = {"node": "n", "leaf": "l"}.get(node.get("type", node.get("t")), node.get("t", node.get("type")))
    if kind == "l":
        return {"t": "l", "v": node.get("value", node.get("v")), "reason": node.get("reason", "leaf")}
    pick = lambda *keys: next(node[k] for k in keys if k in node)
    return {"t": "n", "f": pick("feature", "f"), "v": pick("threshold", "v"), "operator": node.get("operator", "<="), "l": read_tree(pick("left", "l")), "r": read_tree(pick("right", "r"))}


def decision_tree_score(tree: dict) -> Column:
    """score, reason and path of a decision tree, compiled into nested conditions.

    A node's left side is for rows that pass its test (<= by default). A missing feature fails it.
    """
    tests = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}

    def build(n: dict, path: tuple[str, ...]) -> Column:
        if n["t"] == "l":
            return F.struct(F.lit(float(n["v"])).alias("score"), F.lit(str(n["reason"])).alias("reason"), F.array(*[F.lit(p) for p in path]).cast("array<string>").alias("path"))
        value = n["v"] if isinstance(n["v"], str) else float(n["v"])
        left = F.col(n["f"]) if isinstance(value, str) else F.col(n["f"]).cast("double")
        test = f"{n['f']} {n['operator']} {n['v']}"
        return F.when(F.coalesce(tests[n["operator"]](left, F.lit(value)), F.lit(False)), build(n["l"], (*path, test))).otherwise(build(n["r"], (*path, f"not {test}")))

    return build(read_tree(tree), ())


# ---- rules and decisions ----


def base_risk(valid: Column, disposable: Column, model_score: Column | None, config: Config = Config()) -> Column:
    """the score before rules; without a model's, one that warns at least."""
    floor = min(1.0, max(config.warn + 0.01, config.block * 0.8))
    return F.when(~valid, config.invalid_score).when(disposable, config.disposable_score).otherwise(F.coalesce(model_score, F.lit(floor)) if model_score is not None else F.lit(floor))


def heuristic_lifts(score: Column, values: dict[str, Column], config: Config = Config(), eligible: Column | None = None) -> Column:
    """F8: score and reasons after the first rule that fits each feature has raised the score to its threshold plus an offset, if that is higher."""
    state = F.struct(score.cast("double").alias("score"), F.array().cast("array<string>").alias("reasons"))
    steps = []
    for name, rules in config.rules.items():
        ordered = [r for r in sorted(rules, key=lambda r: -r[0]) if len(r) < 5 or r[4] == "gte"] + [r for r in sorted(rules, key=lambda r: r[0]) if len(r) == 5 and r[4] == "lte"]
        target = F.lit(None).cast("struct<score:double,reason:string>")
        for threshold, decision, reason, offset, *direction in reversed(ordered):
            goal = min(1.0, (config.block if decision == "block" else config.warn) + (offset if offset is not None else 0.05 if decision == "block" else 0.03))
            fits = values[name] <= threshold if direction == ["lte"] else (values[name] >= threshold) & ~F.isnan(values[name].cast("double"))
            target = F.when(fits, F.struct(F.lit(goal).alias("score"), F.lit(reason).alias("reason"))).otherwise(target)
        steps.append(target)
    out = F.aggregate(F.array(*steps), state, lambda s, t: F.when(t["score"] > s["score"], F.struct(t["score"].alias("score"), F.array_append(s["reasons"], t["reason"]).alias("reasons"))).otherwise(s))
    return out if eligible is None else F.when(eligible, out).otherwise(state)


def professional_reduction(score: Column, natural: Column, alpha_prefix: Column, has_mx: Column, free: Column, disposable: Column, sequential: Column, digit_ratio: Column, config: Config = Config()) -> Column:
    """half the score (by default) for natural names on domains of their own that take mail."""
    fits = (score > config.warn) & natural & (alpha_prefix > 0.4) & has_mx & ~free & ~disposable & (sequential < 0.3) & (digit_ratio < 0.5)
    return F.when(F.coalesce(fits, F.lit(False)), score * config.professional_factor).otherwise(score)


def decide(score: Column, config: Config = Config()) -> Column:
    """F10."""
    if config.override:
        return F.lit(config.override)
    return F.when(score > config.block, "block").when(score > config.warn, "warn").otherwise("allow")


def alert_reasons(has_name: Column, similarity: Column, language: Column, zone: Column, has_mx: Column) -> Column:
    tests = (has_name & (similarity < 0.2), "low_identity_similarity"), (language, "geo_language_mismatch"), (zone, "geo_timezone_mismatch"), (~has_mx, "missing_mx_records")
    return F.array_compact(F.array(*[F.when(c, r) for c, r in tests]))


def score_signups(df: DataFrame, as_of_year: int, model: dict | None = None, config: Config = Config(), email: str = "email", name: str = "name", **options) -> DataFrame:
    """df's columns and the log row of each sign-up, in one pass without a shuffle of its own; for batches and streams alike."""
    made = signals(df, as_of_year, email, name, **options)
    # A disposable domain's mail exchangers aren't looked up.
    usable = ~F.col("s_dom.is_disposable")
    made = made.withColumns({c: F.when(usable, F.col(c)) for c in made.columns if c.startswith("mx_")})
    keep = [*df.columns, *[c for c in made.columns if c.startswith("s_")], "mx_primary_provider"]
    rows = build_feature_vector(made.withColumn("s_mx", F.col("mx_has_records")), feature_sources(), [*keep, "s_mx"])
    valid, disposable = F.col("s_check.valid"), F.col("s_dom.is_disposable")
    if model is not None:
        rows = forest_score(rows, model, out="s_model")
    rows = rows.withColumn("s_base", base_risk(valid, disposable, F.col("s_model") if model is not None else None, config))
    reason = F.when(~valid, F.col("s_check.reason")).when(disposable, "disposable_domain").otherwise("random_forest" if model is not None else "model_unavailable")
    eligible = valid & ~disposable
    rows = rows.withColumn("s_lift", heuristic_lifts(F.col("s_base"), {k: F.col(k) for k in config.rules}, config, eligible))
    reduced = professional_reduction(F.col("s_lift.score"), F.col("ngram_is_natural") == 1, F.col("alpha_prefix_naturalness"), F.col("mx_has_records") == 1, F.col("provider_is_free") == 1, disposable, F.col("sequential_confidence"), F.col("digit_ratio"), config)
    rows = rows.withColumn("risk_score", F.when(valid & ~disposable, reduced).otherwise(F.col("s_lift.score")))
    rows = patterns.with_pattern_family(rows, F.col(email), as_of_year, "s_family", F.col("s_norm"), F.col("s_seq"))
    rows = rows.withColumn("decision", decide(F.col("risk_score"), config))
    if "timestamp" not in df.columns:
        rows = rows.withColumn("timestamp", F.current_timestamp())
    has_name = F.length(F.col(name).cast("string")) > 0 if name in df.columns else F.lit(False)
    return rows.select(
        *df.columns, *(["timestamp"] if "timestamp" not in df.columns else []), "decision", *(["risk_score"] if "risk_score" not in df.columns else [F.col("risk_score").alias("new_risk_score")]),
        F.when(F.col("decision") == "block", reason).alias("block_reason"), F.col("s_lift.reasons").alias("heuristics"), email_hash(F.col(email)).alias("email_hash"),
        local_part(F.col(email)).alias("email_local_part"), domain_part(F.col(email)).alias("domain"), F.col("s_family.type").alias("pattern_type"), F.col("s_family.family").alias("pattern_family"),
        F.col("s_family.confidence").alias("pattern_confidence"), disposable.cast("int").alias("is_disposable"), F.col("s_dom.is_free").cast("int").alias("is_free_provider"), "entropy_score", "tld_risk_score",
        "domain_reputation_score", "name_similarity_score", F.col("s_geo.language_mismatch").cast("int").alias("geo_language_mismatch_flag"), F.col("s_geo.timezone_mismatch").cast("int").alias("geo_timezone_mismatch_flag"),
        F.col("s_mx").cast("int").alias("mx_found"), F.col("mx_primary_provider"),
        alert_reasons(F.coalesce(has_name, F.lit(False)), F.col("s_identity.similarity"), F.col("s_geo.language_mismatch"), F.col("s_geo.timezone_mismatch"), F.col("s_mx")).alias("alert_reasons"),
        F.map_from_arrays(F.array(*[F.lit(n) for n in FEATURE_NAMES]), F.array(*[F.col(n) for n in FEATURE_NAMES])).alias("feature_vector"),
        *verdict_signals(valid, disposable))


def alert_rows(scored: DataFrame, config: Config = Config(), email: str = "email") -> DataFrame:
    """masked rows above the warning threshold that have a reason for an alert."""
    score = "new_risk_score" if "new_risk_score" in scored.columns else "risk_score"
    return scored.where((F.col(score) > config.warn) & (F.size("alert_reasons") > 0)).select(
        mask_email(F.col(email)).alias("email"), F.col(score).alias("risk_score"), "decision", F.col("alert_reasons").alias("reasons"), F.col("name_similarity_score").alias("identity_similarity"),
        F.col("geo_language_mismatch_flag").alias("geo_language_mismatch"), F.col("geo_timezone_mismatch_flag").alias("geo_timezone_mismatch"), F.col("mx_primary_provider").alias("mx_provider"), "timestamp")


def verdict_signals(valid: Column, disposable: Column) -> list[Column]:
    """F14, over the family columns of score_signups."""
    kind, sure = F.col("s_family.type"), F.col("s_family.confidence") >= 0.5
    return [(kind.isin("sequential", "dated", "plus-addressing") & sure).alias("pattern_detected"), (kind == "random").alias("out_of_distribution"), (valid & ~disposable).alias("valid")]


@dataclass(frozen=True)
class Experiment:
    experiment_id: str
    treatment_weight: int
    start: dt.datetime
    end: dt.datetime
    enabled: bool = True
    control: dict = field(default_factory=dict)
    treatment: dict = field(default_factory=dict)

    def problems(self) -> list[str]:
        out = [] if self.experiment_id else ["no experiment id"]
        if not 0 <= self.treatment_weight <= 100:
            out.append("weights must add up to 100")
        return out if self.start < self.end else [*out, "the end isn't after the start"]


def assign_variant(fingerprint: Column, experiment: Experiment, as_of: dt.datetime) -> Column:
    """experiment_id, variant and bucket (0-99) of a fingerprint in hex; null while the experiment isn't active."""
    bucket = F.conv(F.substring(fingerprint, 1, 8), 16, 10).cast("long") % 100
    active = experiment.enabled and experiment.start <= as_of <= experiment.end
    if not active:
        return F.lit(None).cast("struct<experiment_id:string,variant:string,bucket:bigint>")
    return F.struct(F.lit(experiment.experiment_id).alias("experiment_id"), F.when(bucket < experiment.treatment_weight, "treatment").otherwise("control").alias("variant"), bucket.alias("bucket"))


def variant_config(base: dict, change: dict) -> dict:
    """base with a variant's settings merged in, at every depth."""
    return {**base, **{k: variant_config(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in change.items()}}
