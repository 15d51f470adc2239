"""Datasets by kind: files through Spark's readers, and lists or dicts in memory."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks
from ..operators.ordered import settle

READERS: dict[str, Callable[..., DataFrame]] = {}
#: Names under which the splits of a dataset are known, in the order in which they are looked for.
SPLITS = {
    "train": [
        "train", "training", "train_set", "training_set", "train_dataset", "training_dataset", "train_data", "training_data",
        "pretrain", "pretrain_set", "pretrain_dataset", "pretrain_data", "pretraining",
    ],
    "calib": [
        "calibration", "calib", "cal", "calibration_set", "calib_set", "cal_set", "calibration_dataset", "calib_dataset",
        "calibration_data", "calib_data", "cal_data",
    ],
    "val": [
        "validation", "val", "valid", "validation_set", "val_set", "validation_dataset", "val_dataset", "validation_data", "val_data",
        "dev", "dev_set", "dev_dataset", "dev_data",
    ],
    "test": [
        "test", "testing", "test_set", "testing_set", "test_dataset", "testing_dataset", "test_data", "testing_data",
        "eval", "eval_set", "eval_dataset", "eval_data",
    ],
}


def reader(*kinds: str):
    def keep(f):
        READERS.update(dict.fromkeys(kinds, f))
        return f

    return keep


def read(spark: SparkSession, kind: str, source, **options) -> DataFrame:
    found = READERS.get(kind) or READERS.get(kind.lower())
    if not found:
        raise ValueError(f"no reader is known as {kind!r}; there are {', '.join(sorted(READERS))}")
    return found(spark, source, **options)


@reader("text_file", "txt")
def text(spark: SparkSession, path: str, newline: bool = True) -> DataFrame:
    """One row a line; with its line feed, unless said otherwise. The last line of a file gets one too."""
    lines = spark.read.text(path).withColumnRenamed("value", "text")
    return lines.withColumn("text", F.concat("text", F.lit("\n"))) if newline else lines


@reader("csv_file", "csv")
def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


@reader("json_file", "json", "jsonl")
def json(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """Lines of JSON; with field, documents that hold their rows in that array."""
    if not field:
        return spark.read.json(path)
    return spark.read.option("multiLine", True).json(path).select(F.explode(field).alias("_row")).select("_row.*")


@reader("mooncake")
def mooncake(spark: SparkSession, path: str, block: int = 512) -> DataFrame:
    """Lines of JSON with timestamp (ms), input_length, output_length and hash_ids, in order of time, with their blocks.

    Of rows with one time the one that was read first names an id first; `row` is the place it was read at.
    """
    x = placed(spark.read.schema("timestamp double, input_length bigint, output_length bigint, hash_ids array<bigint>").json(path))
    return sorted_rows(blocks.with_blocks(x, ("timestamp", "row"), block=block), "timestamp", [], ("row",))


@reader("weka")
def weka(spark: SparkSession, path: str, block: int = 64) -> DataFrame:
    """Lines of JSON with id (conversation), t (s), in, out and hash_ids, in order of time, with blocks by conversation and a remainder."""
    x = placed(spark.read.schema("id string, t double, `in` bigint, out bigint, hash_ids array<bigint>").json(path))
    return sorted_rows(blocks.conversation_blocks(x, ("t", "row"), block=block), "t", ["id"], ("row",))


def placed(df: DataFrame) -> DataFrame:
    """The rows of a trace, none of them with a null, with `row`, a number that rises with the place in the files, the same for all readers."""
    nulls = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in df.columns))
    first = df.columns[0]
    df = df.withColumn(first, F.when(nulls, F.raise_error(F.lit("a trace row has nulls")).cast(df.schema[first].dataType)).otherwise(F.col(first)))
    return settle(df.withColumn("row", F.monotonically_increasing_id()))


@reader("parquet_file", "parquet")
def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@reader("directory", "hf", "huggingface")
def directory(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A local dataset: Parquet or JSON files, also in a folder for each split (see `split_of`)."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = [(x.getPath().getName(), x.isDirectory()) for x in fs.listStatus(fs_path)]
    splits = sorted(n for n, folder in listed if folder and not n.startswith(("_", ".")))
    if split and not splits:
        raise ValueError(f"there is no split {split!r}")
    if splits:
        return directory(spark, f"{path}/{split_of(splits, split)}")
    kinds = {n.rsplit(".", 1)[-1] for n, _ in listed if not n.startswith(("_", "."))} & {"parquet", "json", "jsonl", "csv"}
    if len(kinds) != 1:
        raise ValueError("a folder of one kind of files is needed: parquet, json, jsonl or csv")
    return read(spark, kinds.pop(), path)


@reader("in_memory_dict")
def columns(spark: SparkSession, data: dict[str, list]) -> DataFrame:
    if not data or len({len(v) for v in data.values()}) != 1 or not next(iter(data.values())):
        raise ValueError("columns of one length, not empty, are needed")
    return spark.createDataFrame(list(zip(*data.values(), strict=True)), list(data))


@reader("in_memory_dict_list")
def rows(spark: SparkSession, data: list[dict]) -> DataFrame:
    if not data or len({frozenset(r) for r in data}) != 1:
        raise ValueError("rows with the same keys are needed")
    names = list(data[0])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in data], names)


@reader("in_memory_item_list")
def items(spark: SparkSession, data: list, name: str = "data") -> DataFrame:
    if not data:
        raise ValueError("the list is empty")
    return spark.createDataFrame([(x,) for x in data], [name])


def split_of(names: list[str], wanted: str | None = None) -> str:
    """The wanted split, else the first that is known in the order above, else the first."""
    if wanted:
        if wanted not in names:
            raise ValueError(f"there is no split {wanted!r}")
        return wanted
    return next((a for aliases in SPLITS.values() for a in aliases if a in names), names[0])


def save(df: DataFrame, path: str) -> None:
    """Writes by the ending of path: csv, json, jsonl or parquet."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "json", "jsonl", "parquet"):
        raise ValueError(f"{path} ends in none of csv, json, jsonl, parquet")
    w = df.write.option("header", True) if kind == "csv" else df.write
    getattr(w, "json" if kind == "jsonl" else kind)(path)


def trace(df: DataFrame, time: str, prompt: str, output: str, conversation: str | None = None) -> DataFrame:
    """(conversation, t_us, input_length, output_length), checked: a null or a negative count ends the query with an error."""
    missing = {time, prompt, output, *([conversation] if conversation else [])} - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
    bad = F.col(time).isNull() | F.col(prompt).isNull() | F.col(output).isNull() | (F.col(prompt) < 0) | (F.col(output) < 0)
    t = F.when(bad, F.raise_error(F.lit("a trace row has nulls or negative counts")).cast("double")).otherwise(F.col(time).cast("double"))
    return sorted_rows(df, time, [conversation] if conversation else []).select(
        (F.col(conversation) if conversation else F.lit(None).cast("string")).alias("conversation"), (t * 1_000_000).cast("bigint").alias("t_us"),
        F.col(prompt).cast("bigint").alias("input_length"), F.col(output).cast("bigint").alias("output_length"),
    )


def sorted_rows(df: DataFrame, time: str, keys: list[str], ties: tuple[str, ...] = ()) -> DataFrame:
    """df in order of keys, time and ties."""
    return df.orderBy(*keys, time, *ties)


def options(source: str | dict) -> dict:
    """Options of a dict, a JSON text, a JSON file or `key=value,...`; values of pairs are JSON where they can be, else texts."""
    import json as js
    from pathlib import Path

    if isinstance(source, dict):
        return dict(source)
    text = Path(source).read_text() if source.endswith(".json") and Path(source).is_file() else source.strip()
    if text.startswith("{"):
        return js.loads(text)
    out: dict = {}
    for pair in filter(None, (p.strip() for p in text.split(","))):
        name, sign, value = pair.partition("=")
        if not sign:
            raise ValueError(f"{pair!r} is no key=value")
        try:
            out[name.strip()] = js.loads(value)
        except ValueError:
            out[name.strip()] = value.strip()
    return out
