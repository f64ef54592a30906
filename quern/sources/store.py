"""An index in Parquet: parts that are added as documents come, and what follows from them all."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.index import BASE, Index, as_documents, base_tables, derived_tables, merged_df
from quern.sources.scratch import scratch_path

DOCUMENTS = "doc_id long, title string, body string, created_at long"
#: Tables that are looked up by term lie sorted by it, so that readers skip the row groups without it.
BY_TERM = {"postings": "term", "vectors": "term", "df": "term", "completions": "term", "trigrams": "trigram"}
#: More parts than these are merged into one; the newest always stays apart.
MOST_PARTS = 16
PART = re.compile(r"part-(\d+)-(\d+)-(\d+)-(.*)")
DERIVED, MARK = "derived-", "trigram_counts"


@dataclass(frozen=True)
class Part:
    """A folder of base tables. It covers the numbers from `first` to `last`, more than one if parts were merged into it."""

    first: int
    last: int
    next_id: int
    batch: str

    @property
    def batches(self) -> dict[str, int]:
        """The streams whose batches it holds, and the number of the last batch of each."""
        return {stream: int(n) for stream, n in (b.split(".") for b in self.batch.split("+") if b)}

    @property
    def name(self) -> str:
        return f"part-{self.first}-{self.last}-{self.next_id}-{self.batch}"


class _Folder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self._jvm = path, spark._jvm
        self.files = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self) -> list[str]:
        return [entry.getPath().getName() for entry in self.files.listStatus(self._at(self.path))] if self.files.exists(self._at(self.path)) else []

    def whole(self, name: str, last: str) -> bool:
        return self.files.exists(self._at(f"{self.path}/{name}/{last}/_SUCCESS"))

    def remove(self, name: str) -> None:
        self.files.delete(self._at(f"{self.path}/{name}"), True)


def _all_parts(folder: _Folder) -> list[Part]:
    found = (PART.fullmatch(n) for n in folder.names())
    parts = [Part(int(m[1]), int(m[2]), int(m[3]), m[4]) for m in found if m and folder.whole(m[0], BASE[-1])]
    return sorted(parts, key=lambda p: (p.first, p.last))


def parts(spark: SparkSession, path: str) -> list[Part]:
    """The whole parts that make up the index, without those that another one covers; a part whose writing broke off isn't there."""
    every = _all_parts(_Folder(spark, path))
    return [p for p in every if not any(q != p and q.first <= p.first and p.last <= q.last for q in every)]


def _write(frame: DataFrame, path: str, name: str, in_order: bool) -> DataFrame:
    key = BY_TERM.get(name)
    frame = frame.repartitionByRange(key).sortWithinPartitions(key) if key and in_order else frame
    frame.write.mode("overwrite").parquet(f"{path}/{name}")
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{path}/{name}")


def next_id(spark: SparkSession, path: str) -> int:
    return max((p.next_id for p in parts(spark, path)), default=0)


def has_batch(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether a batch ("stream.number"; the numbers of a stream's batches ascend) was added already."""
    stream, _, number = batch.partition(".")
    return bool(batch) and any(p.batches.get(stream, -1) >= int(number) for p in parts(spark, path))


def add(docs: DataFrame, path: str, next_id: int, batch: str = "", in_order: bool = True) -> bool:
    """Index documents (with ids below next_id) as one more part of the index at a path; what is there isn't read.

    A part exists once its last table is committed, so one that breaks off changes nothing. A batch that was added is not
    added again, so one that is repeated after a restart counts once. Returns whether it was added.
    """
    spark, held = docs.sparkSession, parts(docs.sparkSession, path)
    if has_batch(spark, path, batch):
        return False
    number = max((p.last for p in held), default=0) + 1
    where = f"{path}/{Part(number, number, next_id, batch).name}"
    docs = as_documents(docs)
    tables = base_tables(docs, lambda name, df: df if name == BASE[-1] else _write(df, where, name, in_order))
    _write(tables[BASE[-1]], where, BASE[-1], in_order)
    if len(held) >= MOST_PARTS:
        merge(spark, path)
    return True


def _base(spark: SparkSession, path: str, held: list[Part]) -> dict[str, DataFrame]:
    tables = {name: spark.read.parquet(*(f"{path}/{p.name}/{name}" for p in held)) for name in BASE}
    return tables if len(held) == 1 else tables | {"df": merged_df(tables["df"])}


def merge(spark: SparkSession, path: str) -> None:
    """Write all parts but the newest as one. Parts that an earlier merge covered go now; those of this one stay for readers under way."""
    folder, held = _Folder(spark, path), parts(spark, path)[:-1]
    covered = [p for p in _all_parts(folder) if p not in parts(spark, path)]
    if len(held) > 1:
        last: dict[str, int] = {}
        for p in held:
            last |= {stream: max(n, last.get(stream, n)) for stream, n in p.batches.items()}
        new = Part(held[0].first, held[-1].last, held[-1].next_id, "+".join(f"{stream}.{n}" for stream, n in sorted(last.items())))
        tables = _base(spark, path, held)
        for name in BASE:
            _write(tables[name], f"{path}/{new.name}", name, True)
        for p in covered:
            folder.remove(p.name)


def load(spark: SparkSession, path: str, in_order: bool = True) -> Index:
    """The index at a path. What follows from all parts is made when it is first read after one was added, and then kept for all who read it."""
    folder, held = _Folder(spark, path), parts(spark, path)
    if not held:
        raise FileNotFoundError(f"no index at {path}")
    name = f"{DERIVED}{held[-1].last}"
    where, base = f"{path}/{name}", _base(spark, path, held)
    if not folder.whole(name, MARK):
        base["df"] = _write(base["df"], where, "df", in_order) if len(held) > 1 else base["df"]
        derived_tables(base, lambda table, df: _write(df, where, table, in_order))
        older = sorted(int(n.removeprefix(DERIVED)) for n in folder.names() if n.startswith(DERIVED))
        for n in older[:-2]:
            folder.remove(f"{DERIVED}{n}")
    if len(held) > 1:
        base["df"] = spark.read.parquet(f"{where}/df")
    return Index(**base, **{f.name: spark.read.parquet(f"{where}/{f.name}") for f in fields(Index) if f.name not in BASE})


def load_or_new(spark: SparkSession, path: str) -> Index:
    """The index at a path, or an empty one if there is nothing. A broken index raises: it is not taken for an empty one."""
    if not parts(spark, path):
        add(spark.createDataFrame([], DOCUMENTS), path, 0)
    return load(spark, path)


def save(index: Index, path: str) -> None:
    """Write an index that is held in memory as the first part at a path where there is none."""
    spark = index.documents.sparkSession
    if parts(spark, path):
        raise FileExistsError(f"there is an index at {path}")
    last = index.documents.agg(F.coalesce(F.max("doc_id") + 1, F.lit(0)).alias("n")).first().n
    for name in BASE:
        _write(getattr(index, name), f"{path}/{Part(1, 1, last, '').name}", name, True)


def scratch_index(docs: DataFrame) -> Index:
    """An index over documents (with ids) in the shared scratch folder, so that what is planned over it does not carry how it was built."""
    path = scratch_path(docs.sparkSession, "index")
    add(docs, path, 0, in_order=False)
    return load(docs.sparkSession, path, in_order=False)


def titled(documents: DataFrame, now: int, title_words: int = 8) -> DataFrame:
    """doc_id, title, body, created_at from a table of plain texts (doc_id, text): the first words are the title.

    Documents are dated back by up to 119 days, by id.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    cut = documents.select("doc_id", words.alias("words"))
    return cut.select(
        "doc_id",
        F.array_join(F.slice("words", 1, title_words), " ").alias("title"),
        F.array_join(F.slice("words", F.lit(title_words + 1), F.size("words")), " ").alias("body"),
        (F.lit(now) - (F.col("doc_id") % 120) * 86400).cast("long").alias("created_at"),
    )
