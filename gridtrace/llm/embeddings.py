"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine, components.

1. Equal vectors of a label form a class; only one row of each goes on.
2. Each class gets a signature of sign bits. Table t's key is its own bits of the signature. As many
   bits a key as leave some dozens of rows to a bucket, and as many tables as find a pair at the
   threshold with probability ``recall`` (each table finds it with (1 - angle / pi) ** bits).
3. In each bucket only the signature's first ``seed_bits`` are compared, as no more of it is sent with
   each table's key. Only rows with a likely partner have their vectors fetched; partners met in an
   earlier table are passed over where those bits hold that table's key.
4. The fetched vectors of a bucket are compared by cosine in double precision. A pair counts in the
   first of all tables in which it meets, so no pair counts twice. Each row's links are counted there;
   what leaves the task are counts and the links of a spanning forest, not pairs.
5. Buckets over ``block`` rows are cut into blocks, and each pair of blocks is a task of its own.

Defined cases: a null label, a null, empty or zero vector and one with null or non-finite components
links with nothing; vectors of unlike length never link; very long vectors are compared as any others;
a cosine of exactly the threshold links; repeated rows count as vectors of their own; a null id is
carried along; columns other than vec_id, label and embedding are not looked at, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrace.llm.components import connected_components, forest
from gridtrace.session import materialize

SIGNATURE_BITS = 256


def plan_tables(rows_per_label: int, threshold: float, recall: float, bucket: int = 64) -> tuple[int, int]:
    """Bits a key and number of tables."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(24, max(3, round(math.log2(max(1, rows_per_label) / bucket)))) if rows_per_label > bucket else 3
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits)))


def planes(dim: int, bits: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits))


def signatures(x: np.ndarray, bits: int) -> np.ndarray:
    """Packed sign bits, one row each."""
    return np.packbits(x @ planes(x.shape[1], bits) > 0, axis=1)


def table_keys(packed: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of every row in every table."""
    b = np.unpackbits(packed, axis=1, count=bits * tables).reshape(len(packed), tables, bits).astype(np.int64)
    return b @ (1 << np.arange(bits, dtype=np.int64))


def _likely(n_bits: int, threshold: float) -> int:
    """Unlike bits up to which a pair may reach the threshold: six deviations over the mean."""
    p = math.acos(threshold) / math.pi
    return math.ceil(n_bits * p + 6 * math.sqrt(n_bits * p * (1 - p)))


def _first_meets(ka: np.ndarray, kb: np.ndarray, table: int) -> np.ndarray:
    """Pairs that share no key in an earlier table, as far as keys are known."""
    out = np.ones((len(ka), len(kb)), dtype=bool)
    for t in range(min(table, ka.shape[1])):
        out &= ka[:, t, None] != kb[None, :, t]
    return out


def _vectors(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float32) for v in col]).astype(np.float64)


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows with the pair of blocks (i, j) of their bucket in which they are compared, i <= j.

    A row of block k comes once for each block. Buckets of one block are left as they are; buckets
    of one row are dropped.
    """
    bucket = ["label", "dim", "t", "key"]
    counts = rows.groupBy(*bucket).count().where("count > 1")
    return (
        rows.join(counts, bucket)
        .withColumn("n", F.ceil(F.col("count") / block).cast("int"))
        .withColumn("k", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("i", F.least("k", "o"))
        .withColumn("j", F.greatest("k", "o"))
        .drop("count", "n", "o")
    )


def near_duplicates(df: DataFrame, threshold: float = 0.93, recall: float = 0.9995, block: int = 2048, seed_bits: int = SIGNATURE_BITS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    good = "size(embedding) > 0 AND label IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = float('infinity')) AND exists(embedding, x -> x <> 0)"
    rows = df.selectExpr("vec_id", "label", "embedding", f"coalesce({good}, false) AS good")
    valid = rows.where("good").withColumn("h", F.xxhash64("embedding")).withColumn("node", F.xxhash64("label", "h", F.hash("embedding"), F.size("embedding")))
    ids = valid.select("vec_id", "node")
    classes = materialize(
        valid.groupBy("node").agg(F.min("vec_id").alias("rid"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("embedding").alias("embedding")),
        "classes",
    )
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(largest, threshold, recall)
    n_bits = -(-max(seed_bits, bits * tables) // 8) * 8
    #: What of a signature goes to each bucket, whole tables in it, and unlike bits there.
    sent, known = seed_bits // 8, min(tables, seed_bits // bits)
    far = _likely(seed_bits, threshold)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby(b["embedding"].map(len)):
                packed = signatures(_vectors(part["embedding"]), n_bits)
                keys = table_keys(packed, bits, tables)
                heads = [r.tobytes() for r in packed[:, :sent]]
                for t in range(tables):
                    yield pd.DataFrame({"node": part["node"].to_numpy(), "label": part["label"].to_numpy(), "dim": dim, "t": t, "key": keys[:, t], "sig": heads})

    label_type = classes.schema["label"].dataType.simpleString()
    signed = classes.select("node", "label", "embedding").mapInPandas(sign, f"node long, label {label_type}, dim int, t int, key long, sig binary")
    group = ["label", "dim", "t", "key", "i", "j"]

    def likely(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        _, _, t, _, i, j = key
        packed = np.frombuffer(b"".join(g["sig"]), dtype=np.uint8).reshape(len(g), -1)
        keys = table_keys(packed, bits, known)
        nodes, k = g["node"].to_numpy(), g["k"].to_numpy()
        left = np.flatnonzero(k == i)
        right = left if i == j else np.flatnonzero(k == j)
        words = packed.view(np.uint64) if sent % 8 == 0 else packed
        some = np.zeros(len(g), dtype=bool)
        for s in range(0, len(left), 256):
            part = left[s : s + 256]
            apart = np.bitwise_count(words[part][:, None, :] ^ words[right][None]).sum(axis=2, dtype=np.int32)
            ok = (apart <= far) & _first_meets(keys[part], keys[right], int(t)) & (nodes[part][:, None] != nodes[right][None])
            some[part] |= ok.any(axis=1)
            some[right] |= ok.any(axis=0)
        return g.loc[some, ["node", *group, "k"]]

    flagged = _blocks(signed, block).groupBy(*group).applyInPandas(likely, f"node long, label {label_type}, dim int, t int, key long, i int, j int, k int")
    flagged = materialize(flagged, "likely")

    def verify(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        _, _, t, _, i, j = key
        x = _vectors(g["embedding"])
        norms = np.sqrt((x * x).sum(axis=1))
        keys = table_keys(signatures(x, n_bits), bits, tables)
        nodes, k, m = g["node"].to_numpy(), g["k"].to_numpy(), g["m"].to_numpy()
        left = np.flatnonzero(k == i)
        right = left if i == j else np.flatnonzero(k == j)
        links = np.zeros(len(g), dtype=np.int64)
        ends = []
        for s in range(0, len(left), 256):
            part = left[s : s + 256]
            cos = (x[part] @ x[right].T) / (norms[part][:, None] * norms[right][None])
            ok = (cos >= threshold) & _first_meets(keys[part], keys[right], int(t))
            if i == j:
                ok &= nodes[part][:, None] != nodes[right][None]
                links[part] += ok @ m[right]
            else:
                links[part] += ok @ m[right]
                links[right] += m[part] @ ok
            p, q = np.nonzero(ok)
            if len(p):
                ends.append(forest(nodes[part][p], nodes[right][q]))
        own = np.flatnonzero(links)
        counted = pd.DataFrame({"node": nodes[own], "links": links[own], "other": pd.array([pd.NA] * len(own), dtype="Int64")})
        if not ends:
            return counted
        u, v = forest(np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]))
        return pd.concat([counted, pd.DataFrame({"node": u, "links": 0, "other": pd.array(v, dtype="Int64")})])

    found = materialize(
        flagged.join(classes.select("node", "m", "embedding"), "node").groupBy(*group).applyInPandas(verify, "node long, links long, other long"), "found"
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("other IS NOT NULL"), "node", "other")
    named = classes.select("node", "rid", "m").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named, "named")
    first = named.groupBy("root").agg(F.min("rid").alias("component_id"))
    by_class = named.join(first, "root").select("node", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = ids.join(by_class, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
