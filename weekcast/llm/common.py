"""Shared helpers: input columns, folders that all executors see, per-text Arrow maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.session import shared_folder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/llm/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: Rows of an Arrow batch of whole texts, which JVM and Python both hold.
TEXT_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files go when the write that made them has ended, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(df: DataFrame, text_rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: later readers don't repeat the
    work, and a lost executor costs a re-read. Its shuffles are removed after that. While it is
    written, Arrow batches have ``text_rows`` rows at most, where that is given."""
    spark = df.sparkSession
    path = new_folder(spark)
    usual, cleanup = spark.conf.get(_BATCH), spark.conf.get(_CLEANUP, "false")
    fewer = text_rows is not None and not 0 < int(usual) <= text_rows
    try:
        spark.conf.set(_CLEANUP, "true")
        if fewer:
            spark.conf.set(_BATCH, str(text_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, cleanup)
        if fewer:
            spark.conf.set(_BATCH, usual)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a table from ``write_once`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text; every other column, whatever its name, is left behind."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))


_models: dict = {}
_asked: set = set()


def held_model(name, make: Callable):
    """The worker's model of that name: tasks of one operator share what it remembers."""
    _asked.add(name)
    if name not in _models:
        _models[name] = make()
    return _models[name]


def started(start: Callable):
    """``start()``. A worker serves tasks of all operators one after another, so the models that
    this one doesn't ask for are let go."""
    _asked.clear()
    made = start()
    for name in _models.keys() - _asked:
        del _models[name]
    return made


def map_texts(
    df: DataFrame,
    schema: str,
    start: Callable[[], Callable[[dict], dict]],
    most_bytes: int = 4 << 20,
) -> DataFrame:
    """Arrow batches through ``start()(columns)``: a dict of input lists to a dict of
    output lists. ``start`` runs once per task, so models load there. Some ``most_bytes`` of
    input are Python objects at a time."""
    out = df.sparkSession.createDataFrame([], schema).schema
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, work = to_arrow_schema(out), started(start)
        for batch in batches:
            for part in slices(batch, most_bytes):
                made = work(dict(zip(part.schema.names, (c.to_pylist() for c in part.columns))))
                columns = [pa.array(made[n], arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, out)


def slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterable[pa.RecordBatch]:
    """The batch in pieces of about ``most_bytes``, so Python objects stay few at a time."""
    rows = batch.num_rows
    step = max(1, rows * most_bytes // max(batch.nbytes, most_bytes))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def sha256_hex(c) -> F.Column:
    return F.sha2(c, 256)


class Remembered:
    """A bounded table. A full generation becomes the old one and the one before it is forgotten:
    frequent keys stay. A generation ends at ``most`` entries or ``most_bytes`` of keys and values
    (as far as they have a length; lists count eight bytes an item); what one call asks for may come
    on top. Keys of more than ``longest`` characters, such as whole texts without a space, are made
    every time and never kept."""

    def __init__(self, most: int = 400_000, most_bytes: int = 32 << 20, longest: int = 64):
        self.most, self.most_bytes, self.longest = most, most_bytes, longest
        self.now: dict = {}
        self.old: dict = {}
        self.bytes = 0

    def get(self, key):
        """What is remembered of a key, or None."""
        found = self.now.get(key)
        return self.old.get(key) if found is None else found

    def lookup(self, keys: set, make: Callable[[list], list]) -> dict:
        """A table that has all of ``keys``; those unknown are made together."""
        missing = keys.difference(self.now)
        if len(self.now) + len(missing) > self.most or self.bytes > self.most_bytes:
            self.old, self.now, self.bytes, missing = self.now, {}, 0, keys
        known = self.old.keys() & missing
        self._keep((k, self.old[k]) for k in known)
        unknown = list(missing - known)
        made = dict(zip(unknown, make(unknown)))
        long = {k: v for k, v in made.items() if len(k) > self.longest}
        if long:
            self._keep((k, v) for k, v in made.items() if len(k) <= self.longest)
            return Both(long, self.now)
        self._keep(made.items())
        return self.now

    def _keep(self, pairs: Iterable[tuple]) -> None:
        new = dict(pairs)
        self.now.update(new)
        self.bytes += sum(map(len, new)) + size(new.values())


class Both(dict):
    """Entries of this call alone, and behind them a table that is kept."""

    def __init__(self, own: dict, kept: dict):
        super().__init__(own)
        self.kept = kept

    def __missing__(self, key):
        return self.kept[key]


def size(values: Iterable) -> int:
    """Bytes of values that are all of one kind: strings, or lists of numbers, or numbers."""
    values = list(values)
    if not values or not hasattr(values[0], "__len__"):
        return 8 * len(values)
    return sum(map(len, values)) * (1 if isinstance(values[0], (bytes, str)) else 8)
