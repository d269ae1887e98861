"""Rules, the forest classifier and feature attributions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch import constants as C
from tidewatch.functions import scalars as S
from tidewatch.operators.scoring import flag_gate
from tidewatch.session import new_path

LABELS = sorted(C.ATTACK_LABELS)
LABELS_WITH_NORMAL = [*LABELS, C.NORMAL]
MIN_ROWS_TO_SPLIT = 5


def rule_verdict() -> Column:
    """``struct(type, confidence, rule)`` of the rule that decides, or null.

    Travel outranks failed logins; the other two apply only where neither fired.
    """

    mismatch = (F.col("fingerprint_mismatch") > C.RULE_MISMATCH) & (
        F.col("baseline_score") > C.RULE_MISMATCH_BASELINE
    )
    fires = {
        "geo_velocity_exceeded": F.col("geo_velocity_kmh") > C.RULE_TRAVEL_KMH,
        "failed_auth_burst": F.col("failed_auth_count_5min") >= C.RULE_FAILED_LOGINS,
        "multi_entity_same_ip": F.col("distinct_entities_from_ip_5min") >= C.RULE_ENTITIES_PER_IP,
        "fingerprint_mismatch": mismatch,
    }
    verdicts = [
        F.when(
            fires[rule],
            F.struct(F.lit(kind).alias("type"), F.lit(sure).alias("confidence"), F.lit(rule).alias("rule")),
        )
        for rule, (kind, sure) in C.RULE_VERDICTS.items()
    ]
    return F.coalesce(*verdicts)


# --- forest --------------------------------------------------------------------


def label_index(label: Column) -> Column:
    """Position of an attack label in alphabetical order, from 0; normal comes last."""
    return (F.array_position(F.array(*map(F.lit, LABELS_WITH_NORMAL)), label) - 1).cast("double")


def class_weights(rows: DataFrame) -> DataFrame:
    """Balanced weight per label: ``n / (k * n_label)``, as ``label, n_label, weight``."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_label"))
    labels = Window.partitionBy()  # over one row per label
    n, k = F.sum("n_label").over(labels), F.count(F.lit(1)).over(labels)
    return counts.select("label", "n_label", (n / (k * F.col("n_label"))).alias("weight"))


def feature_matrix(scored: DataFrame) -> DataFrame:
    """``features``: the seventeen model inputs in fixed order, gaps as 0."""
    filled = S.fill_features(scored, C.MODEL_FEATURES)
    return VectorAssembler(inputCols=C.MODEL_FEATURES, outputCol="features").transform(filled)


@dataclass(frozen=True)
class Classifier:
    forest: RandomForestClassificationModel

    @property
    def importances(self) -> dict[str, float]:
        weights = self.forest.featureImportances.toArray().tolist()
        return dict(zip(C.MODEL_FEATURES, weights))

    def save(self, path: str) -> None:
        self.forest.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> "Classifier":
        return cls(RandomForestClassificationModel.load(path))


def fit_classifier(scored: DataFrame, with_normals: bool = False, min_rows_to_split: int = MIN_ROWS_TO_SPLIT) -> Classifier | None:
    """Train on the attacks among the rows; ``None`` with fewer than ten.

    By default the forest knows attacks only, so it names one for every event it is
    asked about. ``with_normals`` trains it with the normal rows as well; it can then
    answer that a flagged event is normal after all. Nodes with fewer than
    ``min_rows_to_split`` training rows are leaves.
    """
    attacks = scored.filter(F.col("label").isin(LABELS))
    if attacks.limit(C.MIN_TRAINING_ROWS).count() < C.MIN_TRAINING_ROWS:
        return None
    known = scored.filter(F.col("label").isin(LABELS_WITH_NORMAL)) if with_normals else attacks
    weights = F.broadcast(class_weights(known))  # one row per label, at most eight
    rows = feature_matrix(known).join(weights, "label").withColumn("target", label_index(F.col("label")))
    rows = rows.repartition("session_id")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="target", weightCol="weight",
        numTrees=100, maxDepth=10, minInstancesPerNode=2, seed=42,
    )
    return Classifier(cut_back(forest.fit(rows.select("features", "target", "weight")), min_rows_to_split))


def cut_back(forest: RandomForestClassificationModel, min_rows: int) -> RandomForestClassificationModel:
    """The forest as if nodes with fewer than ``min_rows`` training rows had not been split.

    The trainer has no such limit of its own, but a node's split does not depend on
    what happens below it, so dropping the subtrees afterwards gives the same trees.
    The nodes are rewritten in the model's stored form; their number is bounded by
    trees and depth, not by the data.
    """
    if min_rows <= 2:
        return forest
    spark = SparkSession.active()
    path = new_path(spark, "forest")
    forest.write().save(path)
    stored = spark.read.parquet(f"{path}/data")
    trees: dict[int, dict[int, dict]] = {}
    for row in stored.collect():
        trees.setdefault(row.treeID, {})[row.nodeData.id] = row.nodeData.asDict()
    out = []
    for tree, nodes in sorted(trees.items()):
        # Children come after their parents, the left one first, as the loader expects.
        kept, stack = [], [(0, None, None)]
        while stack:
            old, parent, side = stack.pop()
            node = dict(nodes[old], id=len(kept))
            if parent is not None:
                kept[parent][side] = node["id"]
            kept.append(node)
            if node["leftChild"] < 0:
                continue
            if node["rawCount"] < min_rows:
                node.update(leftChild=-1, rightChild=-1, gain=-1.0, split=(-1, [], -1))
            else:
                stack += [(node["rightChild"], node["id"], "rightChild"), (node["leftChild"], node["id"], "leftChild")]
        out += [(tree, tuple(n[f.name] for f in stored.schema["nodeData"].dataType)) for n in kept]
    spark.createDataFrame(out, stored.schema).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def rf_predict(scored: DataFrame, classifier: Classifier) -> DataFrame:
    """Adds ``ml_type`` and ``ml_confidence``; a map-only step."""
    model = classifier.forest.copy({classifier.forest.rawPredictionCol: ""})
    voted = model.transform(feature_matrix(scored)).withColumn("_p", vector_to_array("probability"))
    best = F.array_max("_p")
    names = F.array(*map(F.lit, LABELS_WITH_NORMAL))
    return voted.withColumns(
        {
            "ml_type": F.element_at(names, F.array_position("_p", best).cast("int")),
            "ml_confidence": S.round4(best),
        }
    ).drop("features", "probability", "prediction", "_p")


def importances_table(spark: SparkSession, classifier: Classifier) -> DataFrame:
    return spark.createDataFrame(list(classifier.importances.items()), "feature string, importance double")


# --- attribution ---------------------------------------------------------------


def top_features(importances: dict[str, float], n: int = 5) -> Column:
    """The ``n`` largest contributions (importance times value), largest first.

    Equal contributions keep the feature order.
    """

    def entry(position: int, name: str) -> Column:
        value = F.col(name).cast("double") * F.lit(float(importances.get(name, C.DEFAULT_IMPORTANCE)))
        return F.struct(
            (-F.abs(value)).alias("rank"), F.lit(position).alias("position"),
            F.lit(name).alias("feature"), value.alias("value"),
        )

    ranked = F.slice(F.array_sort(F.array(*[entry(i, f) for i, f in enumerate(C.MODEL_FEATURES)])), 1, n)
    kept = F.filter(ranked, lambda e: F.abs(e["value"]) > 0.001)
    return F.transform(
        kept, lambda e: F.struct(e["feature"].alias("feature"), S.round4(e["value"]).alias("value"))
    )


def raw_features(top: str = "top_features") -> Column:
    """The same features with the event's own values: ``feature``, ``contribution`` and ``value``.

    A contribution is importance times value; a text that names a speed or a count
    has to take the value itself.
    """
    pairs = [part for name in C.MODEL_FEATURES for part in (F.lit(name), F.coalesce(F.col(name).cast("double"), F.lit(0.0)))]
    own = F.create_map(*pairs)
    return F.transform(
        top,
        lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("contribution"), F.element_at(own, e["feature"]).alias("value")),
    )


# --- classification ------------------------------------------------------------


def classify(
    scored: DataFrame, classifier: Classifier | None = None, importances: dict[str, float] | None = None
) -> DataFrame:
    """Adds ``predicted_type``, its confidence, ``rule_fired`` and ``top_features``.

    Flagged events take the rule's verdict, else the forest's; all others are
    normal.  Without a forest, flagged events no rule decides stay normal.  The
    forest votes on open events only; ``scored`` should be a stored table then,
    because the two parts are read apart.
    """
    rows = S.fill_features(scored, C.MODEL_FEATURES)
    flagged = flag_gate(F.col("baseline_score"), F.col("sequence_score"))
    rule = F.col("_rule")
    ruled = rows.withColumn("_rule", F.when(flagged, rule_verdict())).withColumn("is_flagged", flagged)
    nobody = {"ml_type": F.lit(None).cast("string"), "ml_confidence": F.lit(None).cast("double")}
    if classifier is not None:
        open_ = F.coalesce(flagged & rule["type"].isNull(), F.lit(False))
        importances = importances or classifier.importances
        ruled = rf_predict(ruled.filter(open_), classifier).unionByName(ruled.filter(~open_).withColumns(nobody))
    else:
        ruled = ruled.withColumns(nobody)
    ml_type, ml_confidence = F.col("ml_type"), F.col("ml_confidence")
    kind = F.when(flagged, F.coalesce(rule["type"], ml_type))
    confidence = F.when(flagged, F.coalesce(rule["confidence"], ml_confidence))
    decided = ruled.withColumns(
        {
            "predicted_type": F.coalesce(kind, F.lit(C.NORMAL)),
            "predicted_type_confidence": F.coalesce(confidence, F.lit(1.0)),
            "rule_fired": rule["rule"],
        }
    )
    nothing = F.array().cast(S.TOP_FEATURES_TYPE)
    top = F.when(F.col("predicted_type") == C.NORMAL, nothing).otherwise(top_features(importances or {}))
    return decided.withColumn("top_features", top).drop("_rule", "ml_type", "ml_confidence")
