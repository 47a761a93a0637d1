"""Training examples from export records: features, labels, splits, manifest."""

from __future__ import annotations

import random
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.fixed import DATASET_SCHEMA
from tracewright.functions.values import clean_text, finite_double
from tracewright.sources.logs import spaced_json

LABEL_FIELDS = ["posture", "actual_side", "side"]
TEXTS = {"record_kind": "record_kind", "observer_side": "side", "track_type": "type", "track_subtype": "subtype", "class_name": "class_name", "dbid": "dbid"}
NUMBERS = ["latitude", "longitude", "altitude_m", "speed_kts", "heading_deg", "course_deg"]
MORE_TEXTS = ["identification_status", "detected_by"]
SPLITS = ["train", "val", "test"]


def choose_label(fields: list[Column]) -> Column:
    """The first field whose clean text isn't unknown, in lower case with underscores; Unknown ends the search too."""
    cleaned = [clean_text(f) for f in fields]
    return F.coalesce(*(F.when(c != "unknown", F.replace(F.lower(c), F.lit(" "), F.lit("_"))) for c in cleaned), F.lit("unknown"))


def features(get) -> Column:
    """The 16 features of a record; get(name) is the text of its field."""
    number = {n: finite_double(get(n)) for n in NUMBERS}
    parts = [clean_text(get(s)).alias(n) for n, s in TEXTS.items()] + [number[n].alias(n) for n in NUMBERS] + [clean_text(get(n)).alias(n) for n in MORE_TEXTS]
    parts.append((number["latitude"].isNotNull() & number["longitude"].isNotNull()).alias("has_position"))
    parts.append((number["speed_kts"].isNotNull() | number["heading_deg"].isNotNull() | number["course_deg"].isNotNull()).alias("has_kinematics"))
    return F.struct(*parts)


def build_examples(records: DataFrame, label_fields: list[str] = LABEL_FIELDS) -> DataFrame:
    """id, source_file, source_line, name, label, features and raw of records(path, line, record, text).

    The id is the record's guid; without one, a hash of file, line and record.
    """
    get = lambda n: F.try_variant_get("record", f"$.{n}", "string")
    # One row a record. Filters by id or label stay above a generator; further down they would parse a record once for each use.
    read = records.select("*", F.inline(F.array(F.struct(clean_text(get("guid")).alias("_guid"), choose_label([get(f) for f in label_fields]).alias("_label")))))
    named = F.col("_guid") != "unknown"
    text = F.when(~named, F.col("text"))
    hashed = F.substring(F.sha1(F.concat_ws(":", F.col("path"), F.col("line").cast("string"), spaced_json(text))), 1, 16)
    return read.select(
        F.when(named, F.col("_guid")).otherwise(hashed).alias("id"),
        F.col("path").alias("source_file"),
        F.col("line").alias("source_line"),
        clean_text(get("name")).alias("name"),
        F.col("_label").alias("label"),
        features(get).alias("features"),
        F.col("record").alias("raw"),
    )


def drop_unknown(examples: DataFrame) -> DataFrame:
    """Examples with a label; none left is an error."""
    out = examples.filter("label <> 'unknown'")
    if out.isEmpty():
        raise ValueError("no examples with a label")
    return out


def label_map(examples: DataFrame) -> DataFrame:
    """label and index (from 0, by alphabet). The labels are few, their order one window."""
    return examples.select("label").distinct().withColumn("index", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))


def _check(train: float, val: float) -> None:
    if not (0 < train < 1 and 0 <= val < 1 and train + val < 1):
        raise ValueError("fractions must be positive and sum to less than 1")


def split_by_hash(examples: DataFrame, id_col: str, train: float, val: float, seed: int) -> DataFrame:
    """examples with split. Exact sizes (train n * f without its fraction, val likewise, the rest test), in the order of a
    hash of id and seed. f counts as the decimal that it is written as: 0.7 of 720,000 are 504,000, where the product of
    floats is less. Rows of one id that a cut falls among are dealt out in the order of their JSON.

    The order is found without sorting the rows: they are counted by the leading digits of their hash, only the ids of the
    two buckets that hold a cut are ranked, and the ids at the cuts bound the splits in one narrow pass.
    """
    _check(train, val)
    digest = lambda: F.sha2(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")), 256)
    keyed = examples.select(F.col(id_col).alias("_id"), digest().alias("_h")).withColumn("_b", F.substring("_h", 1, 4))
    # At most 65,536 rows: one for each leading part of the hash.
    counts = sorted((r["_b"], r["_n"]) for r in keyed.groupBy("_b").agg(F.count("*").alias("_n")).collect())
    n = sum(size for _, size in counts)
    wanted, upto = {}, 0  # by bucket: the places in it of the first rows beyond train, and beyond val
    share = lambda f: int(n * Fraction(str(f)))
    cuts = [("train", share(train)), ("val", share(train) + share(val))]
    for bucket, size in counts:
        for name, at in cuts:
            if upto <= at < upto + size:
                wanted.setdefault(bucket, []).append((name, at - upto))
        upto += size
    # Places of an id's rows: from _r to below _end.
    end = F.sum("_n").over(Window.partitionBy("_b").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = F.lit(False)
    for bucket, places in wanted.items():
        for _, k in places:
            at = at | ((F.col("_b") == bucket) & (F.col("_r") <= k) & (F.lit(k) < F.col("_end")))
    ids = keyed.filter(F.col("_b").isin(list(wanted))).groupBy("_b", "_h", "_id").agg(F.count("*").alias("_n"))
    found = ids.withColumn("_end", end).withColumn("_r", F.col("_end") - F.col("_n")).filter(at).collect()  # two rows
    bound, dealt = {}, {}  # by cut: the hash and id of the row there; how many rows of that id come before it
    for bucket, places in wanted.items():
        for name, k in places:
            r = next(r for r in found if r["_b"] == bucket and r["_r"] <= k < r["_end"])
            bound[name], dealt[name] = (r["_h"], r["_id"]), k - r["_r"]

    def split(rows: DataFrame, nth: Column | None = None) -> DataFrame:
        def below(name: str) -> Column:
            if name not in bound:
                return F.lit(True)
            h, key = bound[name]
            same = F.col("_h") == h
            first = same & (F.col(id_col) == F.lit(key)) & (nth <= dealt[name]) if nth is not None else F.lit(False)
            return (F.col("_h") < h) | (same & (F.col(id_col) < F.lit(key))) | first

        return rows.withColumn("_h", digest()).withColumn("split", F.when(below("train"), "train").when(below("val"), "val").otherwise("test")).drop("_h", "_nth")

    shared = list({bound[name][1] for name, k in dealt.items() if k})
    if not shared:
        return split(examples)
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(F.to_json(F.struct(*examples.columns))))
    return split(examples.filter(~F.col(id_col).isin(shared))).unionByName(split(examples.filter(F.col(id_col).isin(shared)).withColumn("_nth", nth), F.col("_nth")))


def split_by_shuffle(examples: DataFrame, index: str, n: int, train: float, val: float, seed: int) -> DataFrame:
    """examples with split, by the standard library's seeded shuffle of 0..n-1 (index is a row's place, from 0). Sizes are
    products of floats, as in scripts that shuffle so.

    The permutation is made on the driver: for sets that scripts could shuffle in memory. split_by_hash() has no bound.
    """
    _check(train, val)
    order = list(range(n))
    random.Random(seed).shuffle(order)
    a, b = int(n * train), int(n * train) + int(n * val)
    rows = [(i, "train" if k < a else "val" if k < b else "test") for k, i in enumerate(order)]
    return examples.join(examples.sparkSession.createDataFrame(rows, f"{index} long, split string"), index)


def manifest(splits: dict[str, int], n_labels: int, inputs: list[str], label_fields: list[str]) -> dict:
    return {
        "schema": DATASET_SCHEMA,
        "input_files": inputs,
        "label_fields_priority": label_fields,
        "num_examples": sum(splits.values()),
        "num_labels": n_labels,
        "splits": splits,
        "files": {"examples": "examples", "csv": "all_examples", "label_map": "label_map"},
    }


def split_sizes(examples: DataFrame) -> DataFrame:
    """split and n, 0 for a split without rows."""
    return examples.agg(*(F.count_if(F.col("split") == s).alias(s) for s in SPLITS)).unpivot([], SPLITS, "split", "n")
