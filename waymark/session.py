"""Session settings that the engine's results rely on, and plain configuration objects."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .sources import documents


def session(app: str = "waymark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; sizes such as shuffle partitions come from the cluster."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


@dataclass(frozen=True)
class BuildConfig:
    """Parameters of the trajectory build."""

    poi_min: int = 10
    user_min: int = 10
    train_ratio: float = 0.8
    window: int = 50
    step: int = 10
    mask_prob: float = 0.1
    max_user_events: int = 80
    min_sequence: int = 10
    seed: int = 42


@dataclass(frozen=True)
class DatasetLayout:
    """Where the tables of a data set lie, under a base URI."""

    base: str
    name: str

    def at(self, table: str) -> str:
        return f"{self.base.rstrip('/')}/{self.name}/{table}"


def merged(base: dict, other: dict) -> dict:
    """A deep merge of configurations; lists and scalars of the second win."""
    out = dict(base)
    for k, v in other.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_config(path: str) -> dict:
    """A configuration, YAML or JSON; what is no mapping is an error, an empty file an empty one.

    A URI is read through the active session's file systems, a plain path on the driver, where no session may run yet.
    """
    import yaml

    if "://" in path:
        found = yaml.safe_load(documents.read(path)) or {}
    else:
        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping but a {type(found).__name__}")
    return found


def write_config(path: str, payload: dict) -> None:
    """Writes a configuration as YAML, keys in their order, to a URI or a plain path of the driver."""
    import yaml

    if "://" in path:
        return documents.write(path, yaml.safe_dump(dict(payload), allow_unicode=True, sort_keys=False))
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(dict(payload), f, allow_unicode=True, sort_keys=False)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only in local mode, where there is one machine, a temporary one stands in."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="waymark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder and reads it back; the files go with discard(), or when the driver ends.

    What comes after has a short plan, and lost executors do not cost the work before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _place(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._waymark_cut = path
    return out


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def discard(df: DataFrame) -> None:
    """Deletes what cut() wrote, once nothing reads it any more; df is the frame that cut() gave."""
    where, fs = _place(df.sparkSession, df._waymark_cut)
    fs.delete(where, True)
