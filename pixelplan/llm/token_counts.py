"""Token counts of documents in flat files of token ids that only end-of-document ids divide, without an index."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut, folder, opened, remove
from .text import slices

#: Ids of a block, and the end-of-document id of the byte-level vocabulary of 50,256 ranks.
BLOCK = 1 << 16
END = 50256
#: Blocks that one group of the prefix scan holds.
SCANNED = 256


def read_blocks(spark, path: str, block: int = BLOCK, width: int = 2) -> DataFrame:
    """Flat files of little-endian ids of `width` bytes as blocks: file, block (from 0), ids (binary).

    Spark lists the files; each block is a range of bytes that some task seeks and reads, so a file may have any
    size. Empty files give none, and so does a folder without files; equal files are told apart by their names.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    size = block * width
    ranges = files.select(F.col("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}"))).alias("block"))
    # A task gets ranges of some MB that lie one after another.
    dealt = ranges.repartition("file", F.expr("block div 64")).sortWithinPartitions("file", "block")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                part, out = batch.slice(k, 16), []
                for file, number in zip(part["file"].to_pylist(), part["block"].to_pylist(), strict=True):
                    if file != name:
                        system, place = opened(file)
                        name, source = file, system.open_input_file(place)
                    source.seek(number * size)
                    out.append(source.read(size))
                yield pa.RecordBatch.from_arrays([part["file"], part["block"], pa.array(out, pa.binary())], ["file", "block", "ids"])

    return dealt.mapInArrow(read, "file string, block long, ids binary")


def count_tokens(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """One row for each document of each file: file, document (from 0), n_tokens (without the end id).

    blocks: file, block (from 0, in the file's order), ids (binary, little-endian, `width` bytes each). Within a
    block the end ids are found by one vectorised search. A document that begins in an earlier block is stitched
    by a prefix scan of two levels: over the blocks of a run of SCANNED, and over one small row for each run, so
    no task gets a large file as a whole. Ids behind a file's last end id are a document without an end: they are
    returned too, if there are any. Null and empty blocks hold no ids; two ends in a row are a document of 0
    tokens. Other columns are not read.
    """
    file_kind = dict(blocks.dtypes)["file"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, heads, tails = [], [], []
            for raw in batch["ids"].to_pylist():
                ids = np.frombuffer(raw or b"", f"<u{width}")
                at = np.flatnonzero(ids == end)
                counts.append(np.diff(at, prepend=-1) - 1)
                heads.append(len(at))
                tails.append(len(ids) - (int(at[-1]) + 1 if len(at) else 0))
            yield pa.RecordBatch.from_arrays([batch["file"], batch["block"], pa.array([c.tolist() for c in counts], pa.list_(pa.int64())), pa.array(heads, pa.int64()), pa.array(tails, pa.int64())], ["file", "block", "counts", "ends", "tail"])

    found = blocks.select("file", "block", "ids").mapInArrow(search, f"file {file_kind}, block long, counts array<long>, ends long, tail long")
    found = found.withColumn("run", F.expr(f"block div {SCANNED}"))
    within = _scanned(found, ["file", "run"], "block", "ends", "tail")
    runs = within.where("last").select("file", "run", F.col("total").alias("ends"), F.col("since").alias("tail"))
    runs = _scanned(runs, ["file"], "run", "ends", "tail").select("file", "run", F.col("before").alias("run_before"), F.col("carry").alias("run_carry"), F.col("last").alias("run_last"))
    whole = within.join(runs, ["file", "run"])
    # Nothing has ended in this run yet: what the runs before have left goes on.
    carry = F.col("carry") + F.when(F.col("before") == 0, F.col("run_carry")).otherwise(0)
    since = F.col("since") + F.when(F.col("total") == 0, F.col("run_carry")).otherwise(0)
    counts = F.when(F.col("ends") > 0, F.concat(F.array(F.element_at("counts", 1) + carry), F.slice("counts", 2, F.greatest(F.lit(1), F.col("ends").cast("int"))))).otherwise(F.array().cast("array<long>"))
    rest = F.when(F.col("last") & F.col("run_last") & (since > 0), F.array(since)).otherwise(F.array().cast("array<long>"))
    each = whole.select("file", (F.col("before") + F.col("run_before")).alias("first"), F.posexplode(F.concat(counts, rest)).alias("at", "n_tokens"))
    return each.select("file", (F.col("first") + F.col("at")).alias("document"), "n_tokens")


def _scanned(rows: DataFrame, group: list[str], order: str, ends: str, tail: str) -> DataFrame:
    """rows with running sums in a group: total (ends so far), before (without this row's), since (ids since the last end, if any), carry (the same of the row before), last."""
    window = Window.partitionBy(*group).orderBy(order)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("total", F.sum(ends).over(upto)).withColumn("parts", F.sum((F.col(ends) > 0).cast("int")).over(upto))
    part = Window.partitionBy(*group, "parts").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("before", F.col("total") - F.col(ends)).withColumn("since", F.sum(tail).over(part))
    return out.withColumn("carry", F.lag("since", 1, 0).over(window)).withColumn("last", F.lead(order).over(window).isNull()).drop("parts")


def write_files(docs: DataFrame, ranks_path: str, place: str, id_col: str = "doc_id", text: str = "text", pattern: str | None = None) -> DataFrame:
    """Writes docs as flat files of 2-byte token ids to a folder that the tasks share, one for each partition, with nothing but end ids between documents.

    Returns where each document went: file (its name), document (from 0), id. The files are complete once these
    rows are; a task that runs again writes its file anew under another name and then puts it in place. Null texts are empty
    documents, repeated rows are documents each, ids may be null or repeat; other columns are not read, and an
    empty table gives no rows.
    """
    import public_tokenizers

    with open(ranks_path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    pattern = pattern or public_tokenizers.PATTERN
    kind = docs.schema[id_col].dataType.simpleString()
    system, path = opened(place)
    system.create_dir(path)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, task = _encoding(ranks.value, pattern), TaskContext.get()
        system, path = opened(place)
        name, number = f"{task.partitionId():08d}.ids", 0
        draft = f"{path}/.{name}.{task.taskAttemptId()}"
        with system.open_output_stream(draft) as out:
            for batch in slices(batches, "text"):
                ids = encoding.encode_ordinary_batch([t or "" for t in batch["text"].to_pylist()], num_threads=1)
                for own in ids:
                    own.append(END)
                    out.write(np.array(own, "<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(range(number, number + len(ids)), pa.int64()), batch["id"]], ["file", "document", "id"])
                number += len(ids)
        system.move(draft, f"{path}/{name}")

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(tokenise, f"file string, document long, id {kind}")


_encodings: dict[int, object] = {}


def _encoding(ranks: bytes, pattern: str):
    key = hash((ranks, pattern))
    if key not in _encodings:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def digest(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: its id and n_tokens, counted in the flat files that docs are tokenised to.

    The files are written to the shared folder, read back by ranges of bytes, scanned for end ids without any
    index, and removed. Only then is each file's k-th document given its id again. Null counts as an empty text of
    0 tokens; ids may be null or repeat; other columns are not read.
    """
    spark = docs.sparkSession
    place = folder(spark, "tokens")
    named = cut(write_files(docs, ranks_path, place, id_col, text))
    if named.isEmpty():
        return named.select(F.col("id").alias(id_col), F.col("document").alias("n_tokens"))
    counted = cut(count_tokens(read_blocks(spark, place, block)).withColumn("file", F.element_at(F.split("file", "/"), -1)))
    remove(spark, place)
    return named.join(counted, ["file", "document"]).select(F.col("id").alias(id_col), "n_tokens")
