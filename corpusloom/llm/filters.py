"""Dropping rows by a list of ids without shuffling the texts that stay."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a mask: 2 MB, whatever the corpus; a fuller mask only sends more rows through the exact join.
MASK_BITS = 24


def mask_of(hashes: DataFrame, column: str, bits: int = MASK_BITS) -> bytes:
    """A mask of the leading bits of a 64-bit hash column, 2**bits bits at any size: each of 256 stretches is put
    together by a task."""

    def stretch(rows: pa.Table) -> pa.Table:
        s = rows["stretch"][0].as_py()
        own = np.zeros(1 << (bits - 8), np.uint8)
        own[rows["place"].to_numpy()] = 1
        return pa.table({"stretch": pa.array([s], pa.int32()), "mask": pa.array([np.packbits(own).tobytes()], pa.binary())})

    lead = F.shiftrightunsigned(column, 64 - bits)
    coarse = hashes.select(F.shiftright(lead, bits - 8).cast("int").alias("stretch"), lead.bitwiseAND((1 << (bits - 8)) - 1).alias("place")).distinct()
    out = bytearray(1 << (bits - 3))
    for r in coarse.groupBy("stretch").applyInArrow(stretch, "stretch int, mask binary").collect():  # 2**bits bits in all
        out[r["stretch"] << (bits - 11) : (r["stretch"] + 1) << (bits - 11)] = r["mask"]
    return bytes(out)


def in_mask(df: DataFrame, mask: bytes, hashed: Column, bits: int = MASK_BITS) -> Column:
    """Whether the mask has a row's hash (true for some others too); only the hash goes to Python."""
    shared = df.sparkSession.sparkContext.broadcast(mask)

    @F.pandas_udf("boolean")
    def found(h: pd.Series) -> pd.Series:
        m = np.frombuffer(shared.value, np.uint8)
        at = (h.to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        return pd.Series((m[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    return found(hashed)


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is in dropped (one column; ids may be structs). Rows that a fixed-size mask of the ids rules
    out stay where they are; the others are held against the ids by an anti join. Rows with null ids stay."""
    gone = dropped.toDF("__gone").where("__gone IS NOT NULL").distinct()
    mask = mask_of(gone.select(F.xxhash64("__gone").alias("h")), "h")
    marked = docs.withColumn("__suspect", in_mask(docs, mask, F.xxhash64(id_col)))
    kept = marked.where(~F.col("__suspect")).drop("__suspect")
    suspect = marked.where("__suspect").drop("__suspect")
    return kept.unionByName(suspect.join(gone, F.col(id_col) == F.col("__gone"), "left_anti"))


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart that repeat an id with another text: (id is null, id, digest of the text). Ordered as ids are, nulls last."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("text"))
