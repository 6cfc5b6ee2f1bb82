"""F16: PCA fitted with ``pyspark.ml`` (distributed Gramian), applied as plain
column expressions: ``pca_component_i = sum_j (x_j - mean_j) * W[j, i]``.

``pyspark.ml.feature.PCA`` does not centre the projection, so the columns are
centred first; each component's sign is fixed so its largest-magnitude
loading is positive. Rows with a NULL input are left out of the fit and get
NULL components.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import qcol


def fit_pca(df: DataFrame, columns, k: int) -> dict:
    x = {c: qcol(c).cast("double") for c in columns}
    complete = df.select(*[x[c].alias(c) for c in columns]).na.drop()
    means = dict(zip(columns, complete.agg(*[F.avg(qcol(c)) for c in columns]).collect()[0]))
    centred = complete.select(*[(qcol(c) - F.lit(means[c])).alias(c) for c in columns])
    vec = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(centred).select("_v")
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vec)
    pc = model.pc.toArray()  # d x k, small
    comps = []
    for i in range(k):
        col = [float(v) for v in pc[:, i]]
        j = max(range(len(col)), key=lambda t: abs(col[t]))
        sign = -1.0 if col[j] < 0 else 1.0
        comps.append([sign * v for v in col])
    return {"method": "pca", "initial": list(columns), "means": [means[c] for c in columns],
            "components": comps, "explained_variance_ratio": [float(v) for v in model.explainedVariance]}


def apply_pca(df: DataFrame, params: dict) -> DataFrame:
    cols, means = params["initial"], params["means"]
    outs = []
    for i, w in enumerate(params["components"]):
        terms = [(qcol(c).cast("double") - F.lit(m)) * F.lit(wj) for c, m, wj in zip(cols, means, w)]
        outs.append(sum(terms[1:], terms[0]).alias(f"pca_component_{i + 1}"))
    return df.select(*[c for c in df.columns if c not in cols], *outs)
