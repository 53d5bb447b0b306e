"""Vector code compression: product codes fitted by active-entry Lloyd rounds in whole numbers.

A component x becomes floor(1024 * x); a vector is cut into four equal consecutive parts, and each part position
has its own codebook of at most 256 entries, which start as that part of the smallest vec_ids. A round gives
every part the nearest entry of its codebook (squared Euclidean distance, ties to the lower index) and moves each
used entry to the componentwise floor of its parts' mean.

A part's entry and exact distance are kept with its row. Where the entry did not move in the last update, no entry
that stayed can have become nearer, so the part is compared with the moved entries only, against the stored
distance; a part whose entry moved is compared with all. One written pass over the rows a round does both: it
assigns and leaves each task's sums by entry beside the rows, so the update adds up short rows. The table before
is dropped when the next one stands. Codebooks (4 x 256 entries) are all that reaches the driver.

Cases: vectors that are null, empty, hold a null or non-finite component, or are of another length than most (the
shorter length on a tie) take no part; a length that four does not divide is filled up with zeros; components
beyond +-65,536 count as that, so that all sums fit 64 bits; rows sharing an id are coded apart, and rows that start
the codebooks are taken by vec_id (nulls last), then vector; with fewer than 256 rows the codebooks are
shorter; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tarmetric.llm.common import table
from tarmetric.session import drop_path, materialize, scratch_path

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Largest size of a scaled component.
MOST = 1 << 26
#: Rows compared at once.
SLICE = 2048


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v: scaled whole components of the vectors that take part."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    scaled = lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int")
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long"), "label", vector.alias("e"))
    rows = rows.where(F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", finite))
    return rows.select("vec_id", "label", F.transform("e", scaled).alias("v"))


def usual_length(rows: DataFrame) -> int:
    found = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    return found["n"] if found else 0


def first_books(rows: DataFrame, width: int) -> np.ndarray:
    """(part, entry, component) of the smallest vec_ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    return np.ascontiguousarray(cut(np.array([r["v"] for r in first], dtype=np.int64), width).transpose(1, 0, 2))


def cut(vectors: np.ndarray, width: int) -> np.ndarray:
    """(row, part, component), filled up with zeros."""
    filled = np.zeros((len(vectors), PARTS * width), dtype=np.int64)
    filled[:, : vectors.shape[1]] = vectors
    return filled.reshape(len(vectors), PARTS, width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, the lower index on a tie."""
    top = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    at, least = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    exact = 4 * top * top * x.shape[1] < 1 << 53
    size = SLICE if exact else max(1, SLICE // 64)
    entries = book.astype(np.float64)
    lengths = (entries * entries).sum(axis=1)
    for s in range(0, len(x), size):
        own = x[s : s + size]
        if exact:  # doubles hold all these whole numbers
            real = own.astype(np.float64)
            d = (real * real).sum(axis=1)[:, None] - 2 * (real @ entries.T) + lengths
        else:
            gap = own[:, None, :] - book[None]
            d = (gap * gap).sum(axis=2)
        k = d.argmin(axis=1)
        at[s : s + size], least[s : s + size] = k, d[np.arange(len(own)), k].astype(np.int64)
    return at, least


def reassign(x: np.ndarray, book: np.ndarray, code: np.ndarray, stored: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and distances after an update that changed the entries marked ``moved``."""
    code, stored = code.copy(), stored.copy()
    active = np.flatnonzero(moved)
    if not len(active):
        return code, stored
    left = moved[code]
    code_of, gap = nearest(x[left], book)
    code[left], stored[left] = code_of, gap
    stay = np.flatnonzero(~left)
    k, gap = nearest(x[stay], book[active])
    k = active[k]
    better = (gap < stored[stay]) | ((gap == stored[stay]) & (k < code[stay]))
    code[stay[better]], stored[stay[better]] = k[better], gap[better]
    return code, stored


def coded(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The rows with code and distance of each part, and each task's sums by entry (rows with a ``cell``)."""
    width = books.shape[2]
    label = rows.schema["label"].dataType
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("v", T.ArrayType(T.IntegerType())),
        T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("gap", longs),
        T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", longs),
    ])

    def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(PARTS * ENTRIES, dtype=np.int64)
        total = np.zeros((PARTS * ENTRIES, width), dtype=np.int64)
        kind = None
        for b in batches:
            kind = b.schema.field("label").type
            if not b.num_rows:
                continue
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            x = cut(flat.reshape(b.num_rows, -1), width)
            code, gap = np.zeros((b.num_rows, PARTS), dtype=np.int64), np.zeros((b.num_rows, PARTS), dtype=np.int64)
            if moved is not None:
                code[:] = b.column("code").flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS)
                gap[:] = b.column("gap").flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS)
            for p in range(PARTS):
                own = x[:, p]
                code[:, p], gap[:, p] = nearest(own, books[p]) if moved is None else reassign(own, books[p], code[:, p], gap[:, p], moved[p])
                cell = p * ENTRIES + code[:, p]
                count += np.bincount(cell, minlength=len(count))
                order = np.argsort(cell, kind="stable")
                used, start = np.unique(cell[order], return_index=True)
                total[used] += np.add.reduceat(own[order], start, axis=0)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), b.column("v"), lists(code, pa.int32()), lists(gap, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
                names=schema.names,
            )
        used = np.flatnonzero(count)
        if len(used):
            n = len(used)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64())), pa.array(used, pa.int32()), pa.array(count[used]), lists(total[used], pa.int64())],
                names=schema.names,
            )

    own = ["vec_id", "label", "v"] + ([] if moved is None else ["code", "gap"])
    return rows.select(*own).mapInArrow(run, schema)


def updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each used entry at the floor of its parts' mean."""
    sums = state.where(F.col("cell").isNotNull())
    counts = sums.groupBy("cell").agg(F.sum("n").alias("n")).collect()
    place = sums.select("cell", F.posexplode("total").alias("at", "x")).groupBy("cell", "at").agg(F.sum("x").alias("x")).collect()
    n = {r["cell"]: r["n"] for r in counts}
    out = books.copy()
    for r in place:
        out[r["cell"] // ENTRIES, r["cell"] % ENTRIES, r["at"]] = r["x"] // n[r["cell"]]
    return out


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code: entry by part, gap: squared distance by part) and the codebooks (part, entry, component)."""
    spark = embeddings.sparkSession
    rows = whole_vectors(embeddings)
    length = usual_length(rows)
    rows = rows.where(F.size("v") == length)
    width = -(-length // PARTS)
    books, moved, old = first_books(rows, width) if length else np.zeros((PARTS, 0, 0), dtype=np.int64), None, None
    if not books.size:
        return rows.select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("array<bigint>").alias("gap")), books
    for turn in range(rounds + 1):
        path = scratch_path(spark, f"codes-{turn}")
        state = materialize(coded(rows, books, moved), "codes", path)
        if old:
            drop_path(spark, old)
        rows, old = state.where(F.col("cell").isNull()), path
        if turn < rounds:
            following = updated(state, books)
            moved, books = (following != books).any(axis=2), following
    return rows.select("vec_id", "label", "code", "gap"), books


def code_text(code: Column) -> Column:
    return F.array_join(F.transform(code, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def with_label_errors(coded_rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (the errors of equal labels summed, nulls together)."""
    rows = coded_rows.select("vec_id", "label", code_text(F.col("code")).alias("code"), F.aggregate("gap", F.lit(0).cast("long"), lambda a, x: a + x).alias("error"))
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error")


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    return with_label_errors(rows).withColumn("codebooks_sha256", F.lit(books_digest(books)))


def _oracle() -> str:
    """The rounds written out; a part of a vector is a row a component."""
    steps = [f"""kept as materialized (select row_number() over (order by vec_id, embedding) - 1 as r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
  from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (select r, i // (len(v) // {PARTS}) as p, i % (len(v) // {PARTS}) as k, v[i + 1] as x from (select r, v, unnest(range(len(v))) as i from kept)),
book0 as materialized (select p, r as e, k, x as c from x where r < {ENTRIES})"""]
    for t in range(ROUNDS + 1):
        steps.append(f"""gap{t} as materialized (select r, p, e, sum((x - c) * (x - c))::bigint as d from x join book{t} using (p, k) group by all),
best{t} as materialized (select r, p, min(d) as d, arg_min(e, (d, e)) as e from gap{t} group by all)""")
        if t < ROUNDS:
            steps.append(f"""mean{t} as materialized (select p, e, k, floor(sum(x)::double / count(*))::bigint as c from best{t} join x using (r, p) group by all),
book{t + 1} as materialized (select p, e, k, coalesce(m.c, b.c) as c from book{t} b left join mean{t} m using (p, e, k))""")
    return f"""with {', '.join(steps)},
out as (select vec_id, label, string_agg(format('{{:02x}}', e), '' order by p) as code, sum(d)::bigint as error from best{ROUNDS} join kept using (r) group by r, vec_id, label)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select sha256(string_agg(c::varchar, ',' order by p, e, k)) from book{ROUNDS}) as codebooks_sha256 from out"""


ORACLE = _oracle()
