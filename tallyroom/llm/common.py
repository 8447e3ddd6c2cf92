"""Pieces that several operators share: words, written tables, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A run of what is not ASCII white space, and of what is neither ASCII punctuation, space nor control.
SPACE = "[\\x20\\x09-\\x0D]+"
PLAIN_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
_TO_SPACE = bytes(b if PLAIN_BYTES.fullmatch(bytes([b])) else 32 for b in range(256))
#: Rows of an Arrow batch that are Python objects at the same time, and bytes of a batch (one row at least).
SLICE, BATCH_BYTES = 128, 8 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def space_words(text: Column) -> Column:
    """Words between ASCII white space; of null, none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def split_bytes(text: str | None) -> list[bytes]:
    """The same words in Python, as UTF-8: bytes are split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the runs of digits, a-z and what is not ASCII; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split() if text else []


def crc_remainder(ident: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo; null for a null id."""
    return F.crc32(ident.cast("string").cast("binary")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode, an error elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.gettempdir()}/tallyroom-checkpoints"
    return named.rstrip("/")


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows, written once to the shared folder and read from there: cuts the lineage, survives lost executors.

    by: a column that names folders, so that a filter on it reads its own alone.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyroom/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no later table reads: whatever was made of them is written itself."""
    for table in tables:
        session = table.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """A written table, sent to all executors if it has at most ``most`` rows; beyond, its join is shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Without the columns that would clash with a result's, in any case of letters."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def map_texts(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list], list[tuple]]],
    keep: list[str] | None = None,
    also: list[str] = (),
) -> DataFrame:
    """Append fields that Python computes from texts, batch by batch; no shuffle, memory bounded by SLICE rows and BATCH_BYTES.

    Lowers the session's bound on the bytes of an Arrow batch to BATCH_BYTES where it is higher: texts may be very long.

    make: called once in each task, returns a function from a list of texts (and of the columns in ``also``, zipped)
    to one tuple per row.  keep: the columns that stay, all by default.  A column whose name a field takes is replaced.
    """
    bound_batches(df.sparkSession)
    names = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    source = df.select(*dict.fromkeys([*[f"`{c}`" for c in kept], f"`{text}`", *[f"`{c}`" for c in also]]))
    schema = T.StructType([*[source.schema[c] for c in kept], *fields])
    types = [pa_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                given = batch.column(batch.schema.names.index(text)).to_pylist()
                if also:
                    given = list(zip(given, *[batch.column(batch.schema.names.index(c)).to_pylist() for c in also], strict=True))
                made = list(zip(*fn(given), strict=True)) or [[] for _ in fields]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(batch.schema.names.index(c)) for c in kept], *[pa.array(v, t) for v, t in zip(made, types, strict=True)]],
                    names=[*kept, *[f.name for f in fields]],
                )

    return source.mapInArrow(run, schema)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch to BATCH_BYTES where it is higher."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None)
    bytes_now = int(re.sub("[^0-9]", "", held)) if held and re.fullmatch("[0-9]+b?", held) else None
    if bytes_now is None or bytes_now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def pa_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, pa_type(f.dataType)) for f in kind.fields])
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    }[kind.simpleString()]


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if ":" in kind or "<" in kind else {
        "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(),
    }[kind])


def longs(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.LongType(), True))


def known_labels(labels: DataFrame, label: str, key: str, modulus: int, left_out: int) -> DataFrame:
    """(key, __label): ids that may be learned from, each with its largest label."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (crc_remainder(F.col(key), modulus) != left_out))
    return known.groupBy(key).agg(F.max(label).cast("int").alias("__label"))


def bounded_labels(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, modulus: int, left_out: int, per_class: int, per_class_chars: int | None = None) -> DataFrame:
    """At most ``per_class`` labelled texts of each class, in the order of a hash of the id: (key, text, label).

    per_class_chars: of these, so many as hold no more code points together; none of a class is left only if its first
    text alone holds more.

    Only ids whose crc32 remainder is not ``left_out`` are learned from.  An id with contradicting labels counts as its
    largest; of an id's rows one stays, the text with the smallest hash (a null text only if there is no other).  Ids
    are chosen before any text is read, and rows of one id are combined before the shuffle.
    """
    known = known_labels(labels, label, key, modulus, left_out)
    order = [F.xxhash64(F.col(key)), F.col(key)]
    chosen = known.where("__label = 0").orderBy(*order).limit(per_class).unionByName(known.where("__label = 1").orderBy(*order).limit(per_class))
    # at most 2 * per_class ids: a proven bound for the broadcast
    rows = docs.select(key, text).join(F.broadcast(chosen), key)
    rows = rows.groupBy(key, "__label").agg(F.min_by(text, F.struct(F.col(text).isNull(), F.xxhash64(text))).alias(text))
    if per_class_chars is None:
        return rows
    # per_class rows a class at most, without their texts
    rows = written(rows)
    upto = F.sum(F.coalesce(F.length(text), F.lit(0))).over(Window.partitionBy("__label").orderBy(*order))
    fits = rows.select(key, upto.alias("__upto")).where(F.col("__upto") <= per_class_chars).select(key)
    return rows.join(F.broadcast(fits), key, "left_semi")
