"""Stored indexes: Parquet by collection and settings, changed by whole versions, read with pruning.

Collections are dealt to slots by hash. A version's manifest says, slot by slot, which folder holds it; a
save writes the slots it touches into a folder of its own, all parts of the index, and publishes a manifest
that points to it. Vocabulary and postings are stored together, as rows of arrays by collection
(`tfidf.folded`), so that saves copy and merge collections, not terms. So readers never see chunks of one save with postings of another, an interrupted save
changes nothing, and of two saves at once the later one starts from what the earlier one published.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.config import DEFAULT, Settings
from lectern.operators.retrieve import Index
from lectern.operators.tfidf import STOP_WORDS, folded, unfolded
from lectern.plans.snapshots import ATTEMPTS, Snapshots
from lectern.plans.storage import LONG_ROWS, materialize

PARTS = ("chunks", "vocab", "postings")
#: What these are stored as, and the name of this layout.
STORED, LAYOUT = ("chunks", "runs"), "runs"


#: What the default embedder is called in the name of a stored index.
HASHING = "hashing"
SLOTS = 64


def versions(spark: SparkSession, path: str, cfg: Settings = DEFAULT, stop_words: tuple[str, ...] = STOP_WORDS, model: str = HASHING) -> Snapshots:
    """The versions of the index stored for these settings, stop list and model."""
    return Snapshots(spark, f"{path.rstrip('/')}/{cfg.fingerprint(LAYOUT, model, *stop_words)}")


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64(F.col("kb_id").cast("string")), F.lit(slots)).cast("int")


def _read(at: Snapshots, manifest: dict, part: str, slots: list[int] | None = None) -> DataFrame | None:
    """A part of a version, of some slots if given; None where no version has it."""
    if part not in manifest.get("schemas", {}):
        return None
    schema = T.StructType.fromJson(manifest["schemas"][part])
    paths = [f"{at.place}/{folder}/{part}/slot={s}" for s, folder in manifest["slot_folders"].items() if (slots is None or int(s) in slots) and part in manifest["slot_parts"][s]]
    return at.spark.read.schema(schema).parquet(*paths) if paths else at.spark.createDataFrame([], schema)


def save(index: Index, path: str, cfg: Settings = DEFAULT, slots: int = SLOTS, writers: int | None = None, model: str = HASHING) -> None:
    """Write an index; collections that are there already are replaced, others are kept.

    Each slot is written by `writers` tasks; unless given, by so many that there are as many as shuffle partitions. A store keeps the number of slots it began
    with. If another save is published meanwhile, the slots that both touch are written again over its version.
    """
    spark = index.chunks.sparkSession
    at = versions(spark, path, cfg, index.stop_words, model)
    ids = materialize(index.chunks.select("kb_id").distinct(), "store-ids")
    frames = {"chunks": index.chunks, "runs": index.runs if index.runs is not None else folded(index.vocab, index.postings)}
    number, manifest = at.latest()
    folder, base = None, None
    for _ in range(ATTEMPTS):
        slots = manifest.get("slots", slots)
        touched = sorted(r[0] for r in ids.select(_slot(slots)).distinct().collect())  # as many numbers as slots at most
        if not touched:
            return
        known = manifest.get("slot_folders", {})
        if folder is None or any(known.get(str(s)) != base.get(str(s)) for s in touched):
            folder, base = at.new_folder(), known
            parts = {str(s): [] for s in touched}
            for part, rows in frames.items():
                old = _read(at, manifest, part, touched)
                if old is not None:
                    rows = rows.unionByName(old.join(ids, "kb_id", "left_anti").select(*rows.columns))
                _write(rows, f"{at.place}/{folder}/{part}", slots, writers or max(1, round(int(spark.conf.get("spark.sql.shuffle.partitions")) / slots)))
                for name in at.names(f"{folder}/{part}"):
                    if name.startswith("slot="):
                        parts[name.removeprefix("slot=")].append(part)
        placed = {**known, **{str(s): folder for s in touched}}
        content = {
            "slots": slots, "slot_folders": placed, "slot_parts": {**manifest.get("slot_parts", {}), **parts}, "folders": sorted(set(placed.values())),
            "schemas": {part: rows.schema.jsonValue() for part, rows in frames.items()},
        }
        if at.publish(number + 1, content):
            return
        number, manifest = at.latest()
    raise RuntimeError("other writers publish all the time")


def _write(rows: DataFrame, target: str, slots: int, writers: int) -> None:
    writer = F.pmod(F.xxhash64(F.col("kb_id").cast("string"), F.lit(1)), F.lit(writers)).cast("int")
    slot = _slot(slots)
    dealt = rows.repartitionById(slots * writers, slot * writers + writer)
    dealt.withColumn("slot", slot).write.options(compression="zstd", **LONG_ROWS).partitionBy("slot").parquet(target)


def load(spark, path: str, cfg: Settings = DEFAULT, kb_ids: list | None = None, stop_words: tuple[str, ...] = STOP_WORDS, model: str = HASHING) -> Index | None:
    """The newest version of the index stored for these settings, stop list and model, of some collections if named; None without one."""
    at = versions(spark, path, cfg, stop_words, model)
    _, manifest = at.latest()
    if not manifest:
        return None
    wanted = None
    if kb_ids is not None:
        wanted = sorted({r[0] for r in spark.createDataFrame([(str(k),) for k in kb_ids], "kb_id string").select(_slot(manifest["slots"])).collect()})
    chunks, runs = (_read(at, manifest, part, wanted) for part in STORED)
    index = Index(chunks, *unfolded(runs), stop_words, runs)
    return index if kb_ids is None else index.where(F.col("kb_id").isin(list(kb_ids)))


def expire(spark, path: str, cfg: Settings = DEFAULT, keep: int = 2, older_than_s: float = 3600, stop_words: tuple[str, ...] = STOP_WORDS, model: str = HASHING) -> list[str]:
    """Delete old versions and what no kept one names."""
    return versions(spark, path, cfg, stop_words, model).expire(keep, older_than_s)


def missing(documents: DataFrame, stored: Index | None) -> DataFrame:
    """Documents (kb_id ...) that have no stored index."""
    return documents if stored is None else documents.join(stored.chunks.select("kb_id").distinct(), "kb_id", "left_anti")


def vocabulary_json(vocab: DataFrame | Index) -> DataFrame:
    """kb_id and a JSON object of terms with number and idf: a portable export of a vocabulary, or of an index's, by whole runs where it has them."""
    if isinstance(vocab, DataFrame):
        rows, gathered = vocab, F.collect_list(F.struct("term", "idf"))
    elif vocab.runs is None:
        return vocabulary_json(vocab.vocab)
    else:
        rows, gathered = vocab.runs.where("df IS NOT NULL").select("kb_id", F.col("terms").alias("term"), "idf"), F.flatten(F.collect_list(F.arrays_zip("term", "idf")))
    return rows.groupBy("kb_id").agg(F.sort_array(gathered).alias("terms")).select("kb_id", F.to_json(F.struct("terms")).alias("json"))
