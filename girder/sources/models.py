"""Models as folders of tables: new ones, subsets, several side by side, as JSON."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "models": "model_id string, guid string, metadata string, max_local_id long, px double, py double, pz double",
    "items": "model_id string, local_id long, item_ix long, category string, guid string",
    "attributes": "model_id string, local_id long, ord int, name string, value_kind string, v_str string, v_num double, v_bool boolean, v_json string, type string",
    "relations": "model_id string, src_id long, name string, rel_ord int, dst_ids array<long>",
    "spatial_nodes": "model_id string, node_id long, parent_node_id long, ord int, depth int, local_id long, category string",
    "mesh_items": "model_id string, item_id long, local_id long, gt_id long",
    "samples": "model_id string, sample_ix long, sample_id long, item_id long, material_ix long, repr_ix long, lt_ix long",
}


@dataclass
class ModelTables:
    """DataFrames by table name; every table has model_id, so several models live side by side."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def write(self, folder: str) -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").partitionBy("model_id").parquet(f"{folder}/{name}")

    def select(self, model_id: str) -> ModelTables:
        return ModelTables({n: df.where(F.col("model_id") == model_id) for n, df in self.tables.items()})

    def merged(self, other: ModelTables) -> ModelTables:
        """Both side by side; another model of an id that is here takes its place."""
        kept = self
        for row in other["models"].select("model_id").collect():  # the models that are loaded
            kept = kept.without(row["model_id"])
        return ModelTables({n: df.unionByName(other[n]) for n, df in kept.tables.items()})

    def without(self, model_id: str) -> ModelTables:
        """The registry after a model is disposed of."""
        return ModelTables({n: df.where(F.col("model_id") != model_id) for n, df in self.tables.items()})

    def to_json(self, name: str) -> DataFrame:
        return self[name].select("model_id", F.to_json(F.struct("*")).alias("json"))


def read(spark: SparkSession, folder: str) -> ModelTables:
    return ModelTables({n: spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in SCHEMAS.items()})


def new_model(spark: SparkSession, model_id: str) -> ModelTables:
    """An empty model: identity placement, next id 1, an own guid, no metadata."""
    tables = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    tables["models"] = spark.createDataFrame([(model_id, str(uuid.uuid4()), "{}", 1, 0.0, 0.0, 0.0)], SCHEMAS["models"])
    return ModelTables(tables)


def subset(model: ModelTables, wanted: DataFrame) -> ModelTables:
    """The wanted (model_id, local_id) items with what they are drawn with; relations keep targets in the subset."""
    keys = ["model_id", "local_id"]
    out = {"models": model["models"]}
    for name in ("items", "attributes", "mesh_items"):
        out[name] = model[name].join(wanted, keys, "left_semi")
    out["spatial_nodes"] = model["spatial_nodes"].join(wanted, keys, "left_semi")
    out["samples"] = model["samples"].join(out["mesh_items"].select("model_id", "item_id"), ["model_id", "item_id"], "left_semi")
    flat = model["relations"].select("model_id", "src_id", "name", "rel_ord", F.posexplode("dst_ids").alias("pos", "dst_id"))
    inside = flat.join(wanted.select("model_id", F.col("local_id").alias("src_id")), ["model_id", "src_id"], "left_semi").join(wanted.select("model_id", F.col("local_id").alias("dst_id")), ["model_id", "dst_id"], "left_semi")
    out["relations"] = inside.groupBy("model_id", "src_id", "name", "rel_ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "dst_id"))), lambda x: x["dst_id"]).alias("dst_ids"))
    return ModelTables(out)


def aligned(models: DataFrame, first: str) -> DataFrame:
    """model_id and the translation that puts each model beside the first: base minus own coordinates."""
    base = models.where(F.col("model_id") == first).select(*[F.col(c).alias(f"b{c}") for c in ("px", "py", "pz")])
    return models.crossJoin(F.broadcast(base)).select("model_id", *[(F.col(f"b{c}") - F.col(c)).alias(f"d{c[1]}") for c in ("px", "py", "pz")])


def coordinate_system(models: DataFrame) -> DataFrame:
    """model_id, crs: the coordinate reference system of the metadata, null if there is none."""
    return models.select("model_id", F.get_json_object("metadata", "$.crs").alias("crs"))
