"""Data minimisation: feature classes, forest feature importance, the
minimal table with its exclusion log, and column selection
(M2, T6, T7, J1, J2, J3, O2).

Only schema-sized results (one row per column) ever reach the driver: the
class list and the low-importance names decide which columns ``drop``
removes.  The forest is Spark ML's distributed RandomForestClassifier, or on
large tables the one of ``forest``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_as_null, q
from ..spec import DatasetSpec, is_numeric, is_temporal, is_text, normalise
from . import forest
from .encode import as_label_text, as_number, label_codes
from .ordering import MOST_BROADCAST, shared

# Rationale and regulation texts of the feature classes and
# the exclusion log.
RATIONALE_TARGET = "Target variable - required for supervised learning"
RATIONALE_PROTECTED = "Protected attribute - may violate anti-discrimination law"
RATIONALE_OPTIONAL = "Requires justification of necessity"
GDPR_REF_PROTECTED = "Art. 9 (Special categories), Art. 5(1)(c)"
EU_AI_ACT_REF_PROTECTED = "Annex III - High-risk prohibited characteristics"
REASON_PROTECTED = "Protected attribute"
REASON_LOW_IMPORTANCE = "Low importance (<0.01)"
REGULATION_LOW_IMPORTANCE = "GDPR Art. 5(1)(c) - Data minimisation"

CLASS_SCHEMA = ("feature string, class string, rationale string, gdpr_ref string, "
                "eu_ai_act_ref string, position int")
LOG_SCHEMA = "feature string, reason string, regulation string"


def classify_features(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """M2: target -> essential; protected (substring match after
    normalising both sides) -> prohibited; everything else -> optional.
    The target test wins.  A schema-level table, one row per column."""
    prot = [normalise(a) for a in spec.protected_attributes]
    rows = []
    for i, col in enumerate(df.columns):
        if col == spec.target:
            rows.append((col, "essential", RATIONALE_TARGET, None, None, i))
        elif any(p in normalise(col) for p in prot):
            rows.append((col, "prohibited", RATIONALE_PROTECTED, GDPR_REF_PROTECTED,
                         EU_AI_ACT_REF_PROTECTED, i))
        else:
            rows.append((col, "optional", RATIONALE_OPTIONAL, None, None, i))
    return df.sparkSession.createDataFrame(rows, CLASS_SCHEMA)


@dataclass(frozen=True)
class ForestParams:
    """The reference's forest: 100 trees, depth 10, seed 42.  The rest are
    execution settings: node-id caching and a larger per-pass node budget
    cut the number of passes over the data for deep trees; training rows
    are spread over ceil(rows / rows_per_partition) partitions, but no more
    than ``max_partitions`` or two a core (every partition sends the counts of
    all open nodes at every level, so their number must not grow with the
    rows).  Spark ML holds a row's draws and nodes for all trees that are
    trained together: beyond ``tree_rows`` rows times trees they are trained
    in portions, of ``least_trees`` or more.  Beyond ``counted_rows`` rows times
    trees its time and memory no longer fit, and the same forest is grown from
    counts (``forest``).  ``max_classes`` is what Spark ML can learn; a text
    target of more is hashed to that many codes, ``hashings`` times."""
    num_trees: int = 100
    max_depth: int = 10
    seed: int = 42
    max_bins: int = 32
    cache_node_ids: bool = True
    max_memory_mb: int = 1024
    rows_per_partition: int = 20000
    max_partitions: int = 32
    tree_rows: int = 400_000_000
    least_trees: int = 10
    counted_rows: int = 100_000_000
    max_classes: int = 100
    hashings: int = 4


def _forest_features(df: DataFrame, target: str) -> list[str]:
    out = []
    for f in df.schema.fields:
        if f.name == target:
            continue
        dt = f.dataType
        if is_numeric(dt) or is_text(dt) or is_temporal(dt) or isinstance(dt, T.BooleanType):
            out.append(f.name)
    return out


def feature_importance(df: DataFrame, target: str, params: ForestParams | None = None) -> DataFrame:
    """Feature, importance (sums to 1), from a random forest on all other
    columns: text columns ordinal-encoded (J7), numeric NULLs mean-imputed
    (J8), target encoded to class indices.  A target of more classes than a
    forest can learn is regressed on if it is a number or a time; a text is
    hashed to fewer codes for each of several smaller forests, whose
    importances are averaged (two classes that share a code in one of them
    hardly do in the others).  Rows with a NULL target are left out (the
    forest cannot learn from them).  Protected columns stay in X.  Sorted by
    importance, highest first."""
    from pyspark.ml.feature import VectorAssembler

    p = params or ForestParams()
    df = nan_as_null(df)
    feats = _forest_features(df, target)
    texts = [c for c in feats if is_text(df.schema[c].dataType)]
    base = df.where(q(target).isNotNull())
    many = base.select(q(target)).distinct().limit(p.max_classes + 1).count() > p.max_classes
    target_type = df.schema[target].dataType
    regress = many and (is_numeric(target_type) or is_temporal(target_type))
    labels = ["_label"] if not many or regress else [f"_label{i}" for i in range(p.hashings)]
    # one ranked pass encodes the text features and a target of few classes together
    coded = texts if many else texts + [target]
    codes = shared(label_codes(base, coded)) if coded else None
    enc = base
    if regress:
        enc = enc.withColumn("_label", as_number(base, target))
    elif many:
        enc = enc.withColumns({c: F.pmod(F.xxhash64(as_label_text(target), F.lit(i)), F.lit(p.max_classes)).cast("double")
                               for i, c in enumerate(labels)})
    sizes = {r["column"]: r["count"] for r in codes.groupBy("column").count().collect()} if coded else {}
    for c in coded:
        tbl = (codes.where(F.col("column") == c)
               .select(F.col("value").alias("_v"), F.col("code").alias("_code")))
        if sizes.get(c, 0) <= MOST_BROADCAST:     # else Spark shuffles all rows before it knows
            tbl = F.broadcast(tbl)
        enc = (enc.withColumn("_v", as_label_text(c)).join(tbl, "_v", "left").drop("_v")
               .withColumn("_label" if c == target else c,
                           F.col("_code").cast("double" if c == target else "long"))
               .drop("_code"))
    cols = [f"_f{i}" for i in range(len(feats))]
    staged = enc.select(*labels, *[as_number(enc, c).alias(f"_f{i}") for i, c in enumerate(feats)])
    # J8 mean imputation and the row count in one aggregate (one value per feature)
    stats = staged.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in cols],
                       *[F.approx_count_distinct(c).alias(f"_n{c}") for c in cols]).first()
    n_rows = stats["_n"]
    filled = staged.select(*labels, *[F.coalesce(F.col(c), F.lit(stats[c])).alias(c)
                                       if stats[c] is not None else F.col(c) for c in cols])
    most_parts = max(p.max_partitions, 2 * df.sparkSession.sparkContext.defaultParallelism)
    n_parts = max(1, min(math.ceil(n_rows / p.rows_per_partition), most_parts))
    trees = -(-p.num_trees // len(labels))
    if n_rows * p.num_trees > p.counted_rows:
        classes = 0 if regress else p.max_classes if many else sizes.get(target, 1)
        found = forest.importances(filled, labels, cols, classes, trees, p.max_depth, p.max_bins, p.seed, n_parts,
                                   [stats[f"_n{c}"] for c in cols])
    else:
        assembled = VectorAssembler(inputCols=cols, outputCol="_features",
                                    handleInvalid="keep").transform(filled)
        portions = _portions(p, trees, n_rows)
        train = (assembled.select(*labels, "_features").repartition(n_parts)
                 .persist(StorageLevel.MEMORY_AND_DISK))
        try:
            found = [_importances(p, train, label, regress, portions) for label in labels]
        finally:
            train.unpersist()
    rows = [(c, float(v)) for c, v in zip(feats, sum(found) / len(found))]
    return (df.sparkSession.createDataFrame(rows, "feature string, importance double")
            .orderBy(F.desc("importance"), "feature"))


def _portions(p: ForestParams, trees: int, n_rows: int) -> list[int]:
    """How many trees are trained together, one number for each fit."""
    at_once = max(p.least_trees, p.tree_rows // max(n_rows, 1))
    fits = -(-trees // at_once)
    return [trees // fits + (i < trees % fits) for i in range(fits)]


def _importances(p: ForestParams, train: DataFrame, label: str, regress: bool, portions: list[int]):
    """Importances of the forest that the portions make up: the mean over all
    its trees that split (Spark ML's own rule within a portion)."""
    if len(portions) == 1:
        return _forest(p, label, regress, portions[0], p.seed).fit(train).featureImportances.toArray()
    total, split = 0.0, 0
    for i, trees in enumerate(portions):
        # Spark ML adds the partition's number to the seed: the portions' seeds lie far apart
        model = _forest(p, label, regress, trees, p.seed + i * 1_000_003).fit(train)
        n = sum(tree.numNodes > 1 for tree in model.trees)
        total, split = total + n * model.featureImportances.toArray(), split + n
    return total / max(split, 1)


def _forest(p: ForestParams, label: str, regress: bool, trees: int, seed: int):
    """``trees`` trees, trained together.  Their node ids are not checkpointed:
    that would write them all once more, to save few levels."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor
    return (RandomForestRegressor if regress else RandomForestClassifier)(
        labelCol=label, featuresCol="_features", numTrees=trees, maxDepth=p.max_depth, seed=seed,
        maxBins=p.max_bins, cacheNodeIds=p.cache_node_ids, maxMemoryInMB=p.max_memory_mb, checkpointInterval=-1)


def importance_status(df: DataFrame, target: str) -> str | None:
    """Why T6 cannot be computed (None: it can): looked up before training,
    so a table that no forest can learn from does not end the run."""
    if target not in df.columns:
        return "the target is no column"
    if not _forest_features(df, target):
        return "there is no feature column"
    if nan_as_null(df).select(q(target).alias("t")).where(F.col("t").isNotNull()).isEmpty():
        return "the target has no value"
    return None


def low_importance(importances: DataFrame, spec: DatasetSpec | None = None) -> DataFrame:
    """Features with importance below the threshold (recommended
    exclusions), most important first."""
    th = (spec or DatasetSpec(target=None)).thresholds.low_importance
    return importances.where(F.col("importance") < th)


def low_importance_preview(importances: DataFrame, spec: DatasetSpec | None = None,
                           n: int = 5) -> DataFrame:
    """L2: the first ``n`` low-importance features (most important first)
    and how many more there are: feature, importance, n_more."""
    low = low_importance(importances, spec)
    head = (low.orderBy(F.desc("importance"), "feature").limit(n)
            .withColumn("n_more", F.lit(None).cast("long")))
    more = low.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("n_more")).select(
        F.lit(None).cast("string").alias("feature"),
        F.lit(None).cast("double").alias("importance"), "n_more")
    return head.unionByName(more)


def top_importances(importances: DataFrame, n: int = 10) -> DataFrame:
    """L1: the n most important features (TakeOrderedAndProject)."""
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


def create_minimal_dataset(df: DataFrame, classes: DataFrame, spec: DatasetSpec,
                           importances: DataFrame | None = None,
                           exclude_protected: bool = True,
                           exclude_low_importance: bool = True) -> tuple[DataFrame, DataFrame]:
    """Drop prohibited columns, then low-importance ones (never the
    target); returns (minimal table, exclusion log).  The names come from
    schema-sized tables; the drop itself is a lazy projection."""
    spark = df.sparkSession
    present = set(df.columns)
    log: list[tuple[str, str, str]] = []
    if exclude_protected:
        for r in classes.where(F.col("class") == "prohibited").orderBy("position").collect():
            if r.feature in present:
                present.discard(r.feature)
                log.append((r.feature, REASON_PROTECTED, r.gdpr_ref or "GDPR Art. 9"))
    if exclude_low_importance and importances is not None:
        for r in low_importance(importances, spec).collect():
            if r.feature in present and r.feature != spec.target:
                present.discard(r.feature)
                log.append((r.feature, REASON_LOW_IMPORTANCE, REGULATION_LOW_IMPORTANCE))
    dropped = [f for f, _, _ in log]
    return df.drop(*dropped), spark.createDataFrame(log, LOG_SCHEMA)


def minimisation_report(classes: DataFrame, importances: DataFrame | None,
                        spec: DatasetSpec | None = None) -> DataFrame:
    """O2: counts per class and of recommended exclusions (one row)."""
    counts = classes.agg(
        F.count_if(F.col("class") == "essential").alias("essential_features_count"),
        F.count_if(F.col("class") == "prohibited").alias("prohibited_features_count"),
        F.count_if(F.col("class") == "optional").alias("optional_features_count"))
    if importances is None:
        return counts.withColumn("recommended_exclusions_count", F.lit(0).cast("long"))
    n_low = low_importance(importances, spec).count()
    return counts.withColumn("recommended_exclusions_count", F.lit(n_low).cast("long"))


def drop_pii_columns(df: DataFrame, pii_cols: Sequence[str], protected: Sequence[str],
                     target: str) -> tuple[DataFrame, list[str]]:
    """Drop PII columns that are neither protected nor the target."""
    drop = [c for c in pii_cols if c not in protected and c != target]
    return df.drop(*drop), drop


def select_features(df: DataFrame, include: Sequence[str] | None = None,
                    exclude: Sequence[str] | None = None) -> DataFrame:
    """Exclusions first (absent names ignored), then keep the included
    names that exist, in the given order."""
    out = df.drop(*[c for c in (exclude or []) if c in df.columns])
    if include:
        out = out.select(*[q(c) for c in include if c in out.columns])
    return out
