"""Predictions and models that are made once and read often: tables in folders named by their input, each valid by its manifest."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.crossval import Fitted, Spec
from tessera.operators.folds import shared_hash
from tessera.operators.tables import set_shared_dir

#: Where all runs on one machine and neither the session nor the environment names a folder.
LOCAL = "/tmp/tessera-store"
#: Part of every manifest: tables of other code are made anew.
VERSION = 2


def store_dir(spark: SparkSession | None) -> str:
    """The folder of the store: spark.tessera.store, else one in the cluster's shared folder, else, on one machine, $TESSERA_STORE or a fixed one."""
    if spark is not None:
        if named := spark.conf.get("spark.tessera.store", None) or (f"{shared}/store" if (shared := set_shared_dir(spark)) else None):
            return named
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.tessera.store or spark.checkpoint.dir to a folder that all executors share")
    elif shared := _default("spark.checkpoint.dir"):
        return f"{shared.rstrip('/')}/store"
    return os.environ.get("TESSERA_STORE", LOCAL)


def _default(key: str) -> str | None:
    """What a new session would have: Spark's defaults file."""
    homes = [os.environ.get("SPARK_CONF_DIR"), *(f"{h}/conf" for h in (os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)) if h)]
    for home in filter(None, homes):
        if os.path.exists(at := f"{home}/spark-defaults.conf"):
            with open(at) as f:
                told = dict(parts for line in f if len(parts := line.split(None, 1)) == 2 and not line.startswith("#"))
            return told[key].strip() if key in told else None
    return None


def fingerprint(df: DataFrame, *columns: str | Column) -> str:
    """Rows and a sum of hashes of the columns, which any engine can tell; the order of rows does not matter."""
    told = F.concat_ws(":", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns])
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(shared_hash(told)), F.lit(0)).alias("h")).first()
    return f"{r['n']}-{r['h']}"


def fingerprint_sql(table: str, *columns: str) -> str:
    told = "||':'||".join(f"coalesce({c}::varchar, '')" for c in columns)
    return f"(SELECT count(*)||'-'||coalesce(sum(('0x'||md5({told})[1:8])::bigint), 0)::bigint FROM {table})"


class Store:
    """Tables of one input."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.root = spark, name, store_dir(spark)

    def path(self, kind: str, *parts: str) -> str:
        """{root}/{kind}/input={name}/{parts}"""
        return "/".join((self.root, kind, f"input={self.name}", *parts))

    def _manifest(self, part: str) -> str:
        return self.path("manifests", part)

    def manifest(self, part: str) -> dict | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._manifest(part) + "/_SUCCESS")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return json.loads(self.spark.read.text(self._manifest(part)).first()[0])

    def once(self, part: str, settings: dict, make: Callable[[], dict]) -> dict:
        """The manifest of a part; make() writes its tables, unless they stand there under the same settings. The manifest is written last."""
        want = json.loads(json.dumps({"version": VERSION, "settings": settings}))
        found = self.manifest(part)
        if found is None or {k: found.get(k) for k in want} != want:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self._manifest(part))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)  # a run that breaks off leaves no valid part
            found = want | {"made": make()}
            self.spark.createDataFrame([(json.dumps(found, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(self._manifest(part))
        return found

    def write(self, df: DataFrame, kind: str, *parts: str) -> None:
        df.write.mode("overwrite").parquet(self.path(kind, *parts))

    def read(self, kind: str, *parts: str) -> DataFrame:
        return self.spark.read.parquet(self.path(kind, *parts))

    def write_fitted(self, fitted: Fitted, name: str) -> None:
        """Weights and bias, a row a column of scores, and what a task must know of them."""
        rows = [(c, fitted.weights[c].tobytes(), float(fitted.bias[c])) for c in range(len(fitted.bias))]
        self.write(self.spark.createDataFrame(rows, "place int, weights binary, bias double"), "weights", name)
        s = fitted.spec
        told = {"kind": fitted.kind, "folds": s.folds, "classes": s.classes, "features": s.features, "starts": s.starts, "problems": s.problems, "loss": fitted.loss.tolist(), "passes": fitted.passes}
        self.write(self.spark.createDataFrame([(json.dumps(told),)], "told string"), "fitted", name)

    def read_fitted(self, name: str) -> Fitted:
        rows = self.read("weights", name).orderBy("place").collect()  # one model
        t = json.loads(self.read("fitted", name).first()[0])
        spec = Spec(tuple(t["folds"]), t["classes"], t["features"], tuple(t["starts"]), tuple(t["problems"]))
        return Fitted(t["kind"], spec, np.stack([np.frombuffer(r["weights"]) for r in rows]), np.array([r["bias"] for r in rows]), np.array(t["loss"]), t["passes"])
