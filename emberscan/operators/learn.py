"""Learned rankings on `pyspark.ml`: a logistic baseline, a message-passing scorer, an anomaly score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscan.functions.intervals import finite
from emberscan.operators.clean import require
from emberscan.operators.coherence import EDGE_FEATURES, IntraLinks
from emberscan.operators.rangejoin import sums_within
from emberscan.operators.scan import lookup_join

BASELINE_FEATURES = (*EDGE_FEATURES, "network_min_enwdf", "network_enwdf")


def _checked(table: DataFrame, features: Sequence[str]) -> DataFrame:
    require(table, features, "features")
    clean = {f: F.when(finite(F.col(f).cast("double")), F.col(f).cast("double")).otherwise(F.lit(0.0)) for f in features}
    return table.withColumns({f"_f_{f}": e for f, e in clean.items()})


def _standardised(features: Sequence[str]) -> list:
    return [VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)]


def _scored(rows: DataFrame, model: PipelineModel, features: Sequence[str], prefix: str) -> DataFrame:
    out = model.transform(rows)
    logit = vector_to_array("rawPrediction")
    return out.withColumn(f"{prefix}_logit", logit[1] - logit[0] if prefix != "baseline" else logit[1]).withColumn(
        f"{prefix}_score", vector_to_array("probability")[1]).drop(
        "_raw", "_x", "rawPrediction", "probability", "prediction", "_weight", *[f"_f_{f}" for f in features])


def balanced_weight(table: DataFrame, label: str) -> DataFrame:
    """Weights that give both classes the same total; one class alone is refused."""
    of = F.col(label).cast("int")
    seen = table.agg(F.count_if(of == 1).alias("ones"), F.count_if(of == 0).alias("zeros"), F.count("*").alias("rows")).first()
    if not seen["ones"] or not seen["zeros"] or seen["ones"] + seen["zeros"] < seen["rows"]:
        raise ValueError(f"{seen['rows']} labels with {seen['ones']} ones and {seen['zeros']} zeros tell no two classes apart")
    half = seen["rows"] / 2.0
    return table.withColumn("_weight", F.when(of == 1, half / seen["ones"]).otherwise(half / seen["zeros"]))


class LogisticBaseline:
    """Balanced logistic regression on standardised candidate features."""

    def __init__(self, features: Sequence[str] | None = None, max_iter: int = 100):
        self.features = tuple(features or BASELINE_FEATURES)
        self.max_iter = max_iter
        self.model: PipelineModel | None = None

    def fit(self, table: DataFrame, label: str = "label") -> "LogisticBaseline":
        rows = balanced_weight(_checked(table, self.features), label)
        rows = rows.withColumn("_y", F.col(label).cast("double"))
        head = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_weight", maxIter=self.max_iter, regParam=1e-3)
        self.model = Pipeline(stages=[*_standardised(self.features), head]).fit(rows)
        return self

    def score(self, table: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("the baseline has not been fitted")
        return _scored(_checked(table, self.features), self.model, self.features, "baseline")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, features: Sequence[str] | None = None) -> "LogisticBaseline":
        out = cls(features)
        out.model = PipelineModel.load(path)
        return out


#: Feature values are summed as whole numbers, this many of them to the largest one: sums of them are exact in any order.
STEPS = float(1 << 56)


def _band_means(nodes: DataFrame, links: IntraLinks, features: Sequence[str], node_id: str) -> DataFrame | None:
    """Neighbour means over `IntraLinks` of the same nodes by a scan; None where ids repeat or a feature has no finite bound."""
    value = lambda f: F.col(f).cast("double")
    sound = [F.max(F.abs(value(f))).alias(f"m_{f}") for f in features]
    facts = nodes.agg(F.count(F.lit(1)).alias("n"), *sound).first()
    most = {f: facts[f"m_{f}"] for f in features}
    # NaN counts as largest of all.
    if any(m is not None and not m < 1e300 for m in most.values()) or not nodes.groupBy(node_id).count().where("count > 1").isEmpty():
        return None
    unit = {f: (m or 1.0) / STEPS for f, m in most.items()}
    if any(u < 1e-290 for u in unit.values()):
        return None
    placed = nodes.where(F.col("ifo").isNotNull() & F.col(links.time).isNotNull() & ~F.isnan(F.col(links.time).cast("double")) & F.col(node_id).isNotNull())
    placed = placed.select("ifo", F.col(links.time).alias("_time"), F.col(node_id).alias("_node"), F.lit(1).cast("long").alias("n_neighbours"), *[
        c for k, f in enumerate(features) for c in (
            F.coalesce(F.round(value(f) / unit[f]).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias(f"s{k}"),
            F.col(f).isNotNull().cast("long").alias(f"c{k}"))])
    counted = [f"{x}{k}" for k in range(len(features)) for x in "sc"]
    sums = sums_within(placed, "_time", "_node", links.window_s, ["n_neighbours", *counted], ["ifo"])
    mean = lambda k, f: F.when(F.col(f"c{k}") > 0, F.col(f"s{k}").cast("double") / F.col(f"c{k}") * F.lit(unit[f])).alias(f"mean_{f}")
    return sums.select(F.col("_node").alias(node_id), *[mean(k, f) for k, f in enumerate(features)], "n_neighbours")


def neighbour_means(nodes: DataFrame, edges: DataFrame | IntraLinks, features: Sequence[str], node_id: str = "id",
                    source: str = "src", target: str = "dst", edge_features: Sequence[str] = ()) -> DataFrame:
    """Mean over a node's neighbours of their features and of the edges' own; zero without neighbours.

    One round of mean aggregation: messages are combined by target before they
    are shuffled, so a hub costs what its messages cost and no more. Over `IntraLinks` of these nodes no message is formed at
    all: close rows number the square of their density, and their sums come from one scan.
    """
    if isinstance(edges, IntraLinks):
        means = _band_means(nodes, edges, features, node_id) if edges.nodes is nodes and edges.event == node_id and not edge_features else None
        if means is not None:
            return nodes.join(means, on=node_id, how="left").fillna(0, [f"mean_{f}" for f in features] + ["n_neighbours"])
        edges = edges.edges()
    sent = nodes.select(F.col(node_id).alias(source), *[F.col(f).alias(f"_m_{f}") for f in features])
    messages = lookup_join(edges.select(source, target, *edge_features), sent, [source])
    means = messages.groupBy(F.col(target).alias(node_id)).agg(
        *[F.avg(f"_m_{f}").alias(f"mean_{f}") for f in features], *[F.avg(f).alias(f"mean_{f}") for f in edge_features],
        F.count(F.lit(1)).alias("n_neighbours"))
    return nodes.join(means, on=node_id, how="left").fillna(
        0, [f"mean_{f}" for f in (*features, *edge_features)] + ["n_neighbours"])


class MessagePassingScorer:
    """Rounds of neighbour means on the nodes, then a perceptron on both ends of an edge and its features.

    The order of the two ends does not matter: an edge enters as the sum and the
    absolute difference of its ends.
    """

    def __init__(self, node_features: Sequence[str], edge_features: Sequence[str], rounds: int = 1, hidden: int = 16,
                 seed: int = 0, prefix: str = "gnn"):
        self.node_features, self.edge_features = tuple(node_features), tuple(edge_features)
        self.rounds, self.hidden, self.seed, self.prefix = rounds, hidden, seed, prefix
        self.model: PipelineModel | None = None

    def _node_columns(self) -> list[str]:
        cols, layer = list(self.node_features), list(self.node_features)
        for _ in range(self.rounds):
            layer = [f"mean_{c}" for c in layer]
            cols += layer
        return cols

    def _design(self, nodes: DataFrame, intra: DataFrame, cross: DataFrame, node_id: str) -> tuple[DataFrame, list[str]]:
        h, layer = nodes, list(self.node_features)
        for _ in range(self.rounds):
            h = neighbour_means(h, intra, layer, node_id).drop("n_neighbours")
            layer = [f"mean_{c}" for c in layer]
        cols = self._node_columns()
        end = lambda side: h.select(F.col(node_id).alias(side), *[F.col(c).alias(f"_{side}_{c}") for c in cols])
        rows = lookup_join(lookup_join(cross, end("src"), ["src"]), end("dst"), ["dst"])
        names = []
        for c in cols:
            a, b = F.col(f"_src_{c}"), F.col(f"_dst_{c}")
            rows = rows.withColumn(f"sum_{c}", a + b).withColumn(f"gap_{c}", F.abs(a - b)).drop(f"_src_{c}", f"_dst_{c}")
            names += [f"sum_{c}", f"gap_{c}"]
        return rows, [*names, *self.edge_features]

    def fit(self, nodes: DataFrame, intra: DataFrame, cross: DataFrame, label: str = "label", mask: Column | None = None,
            node_id: str = "id", epochs: int = 60) -> "MessagePassingScorer":
        rows, names = self._design(nodes, intra, cross if mask is None else cross.where(mask), node_id)
        rows = _checked(rows, names).withColumn("_y", F.col(label).cast("double"))
        head = MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_y", layers=[len(names), self.hidden, 2],
                                              maxIter=epochs, seed=self.seed)
        self.model = Pipeline(stages=[*_standardised(names), head]).fit(rows)
        return self

    def score(self, nodes: DataFrame, intra: DataFrame, cross: DataFrame, node_id: str = "id") -> DataFrame:
        if self.model is None:
            raise RuntimeError("the scorer has not been fitted")
        rows, names = self._design(nodes, intra, cross, node_id)
        scored = _scored(_checked(rows, names), self.model, names, self.prefix)
        return scored.drop(*[n for n in names if n not in self.edge_features])

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load_model(self, path: str) -> "MessagePassingScorer":
        self.model = PipelineModel.load(path)
        return self


class BackgroundAnomaly:
    """How badly the principal directions of accidental edges reproduce a candidate's features."""

    def __init__(self, features: Sequence[str], components: int = 3):
        self.features, self.components = tuple(features), components
        self.model: PipelineModel | None = None

    def fit(self, background: DataFrame) -> "BackgroundAnomaly":
        stages = [*_standardised(self.features), PCA(k=min(self.components, len(self.features)), inputCol="_x", outputCol="_z")]
        self.model = Pipeline(stages=stages).fit(_checked(background, self.features))
        return self

    def score(self, table: DataFrame) -> DataFrame:
        """Mean squared residual: what of the standardised row lies outside the kept directions."""
        if self.model is None:
            raise RuntimeError("the anomaly score has not been fitted")
        rows = self.model.transform(_checked(table, self.features))
        square = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda acc, v: acc + v * v)
        # The directions are orthonormal, so the residual is what projection leaves over.
        pca = self.model.stages[-1].pc.toArray()
        mean_free = F.greatest(square("_x") - square("_z"), F.lit(0.0)) / F.lit(float(pca.shape[0]))
        return rows.withColumn("anomaly_score", mean_free).drop("_raw", "_x", "_z", *[f"_f_{f}" for f in self.features])
