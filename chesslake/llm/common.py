"""Helpers shared by the training-data operators.

Row identity. A document is the pair (doc_id, text). Rows that agree in both are
repeats of one document; every operator gives them the same result. A null doc_id
is an ordinary value: joins on document keys are null-safe.
"""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators of the "plain word" rule: every ASCII byte that is no letter or digit.
#: Upper-case A-Z become lower case, bytes of non-ASCII characters stay.
_PLAIN_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none and all of it runs in one process (as in tests) a temporary folder is set; on a
    cluster executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="chesslake-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders written inside the calls of tidied functions that have not ended.
_written: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def tidied(name: str):
    """For functions that return a DataFrame: it is written, and what was written on the way to it goes."""

    def decorate(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(fn)
        def run(*args, **kwargs) -> DataFrame:
            _written.append([])
            try:
                out = fn(*args, **kwargs)
            finally:
                made = _written.pop()
            out = materialize(out, name)
            for path in made:
                remove_path(out.sparkSession, path)
            return out

        return run

    return decorate


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def plain_words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, then the runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` as UTF-8."""
    return text.translate(_PLAIN_WORDS).split() if text else []


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The text as a string column, a null-typed column included."""
    return F.col(name).cast("string")


def map_texts(
    df: DataFrame,
    fn: Callable[[], Callable[[list, list], dict[str, list]]],
    schema: T.StructType,
    keep: tuple[str, ...] = ("doc_id",),
    pass_on: tuple[str, ...] | None = None,
) -> DataFrame:
    """Run a text function over Arrow batches, with the columns of `keep` passed on.

    `fn()` is called once for each task (it loads models there) and returns the
    function of a batch: the texts as UTF-8 bytes or None, and the batch with the
    columns of `keep` from place 1, to a dict of new columns. Columns of `pass_on`
    (all of `keep` by default) are copied. Rows stay where they are: no shuffle.
    """
    out_schema, copied = schema, keep if pass_on is None else pass_on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        work = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            work = work or fn()
            for part in _bounded(batch):
                texts = part.column(0).cast(pa.binary()).to_pylist()
                got = work(texts, part)
                columns = []
                for i, field in enumerate(arrow):
                    if field.name in copied:
                        columns.append(part.column(1 + keep.index(field.name)).cast(field.type))
                    else:
                        value = got[field.name]
                        columns.append(
                            value if isinstance(value, pa.Array) else pa.array(value, type=field.type)
                        )
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    # columns go by place, so their names can't clash
    return df.select(text_column(df).alias("t"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))).mapInArrow(run, schema)


def _bounded(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes of text, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes.astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files of the machine are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def long_field(name: str) -> T.StructField:
    return T.StructField(name, T.LongType(), True)


def one_thread() -> None:
    """Numeric libraries of a task use the one core that the task has."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
