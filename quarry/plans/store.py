"""Versioned tables of files that are only added to, for changes that cost what they change.

A table's rows lie in Parquet files, sorted by a hash of the row's key (its CRC-32). A change adds
files with its new rows and, for rows that they replace or that go, files of (file, row) places; nothing that is
there is written again. What each version adds, marks as gone and drops is one small record under ``versions/``; every sixteenth
version leaves the whole list of files beside its record, so that reading the newest state takes few records.

Readers leave out the rows marked as gone; files without such rows are read as they are. Of each file the range of hashes is known, so a
lookup opens only files that may hold the key; within these, which are in the order of hashes, statistics of the hash skip the rest.
``compact`` merges what many changes left into files of narrow ranges, level by level: a row is written
again once for each level, of which there are as many as the table's size has digits, in a sense.

A record is put in its place by a rename that fails where the version is taken: then another writer was
first, and what depends on the state is worked out anew. A job that fails publishes nothing.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import size_of

_TRIES = 20  # against other writers
_EACH_STATE = 16  # versions from one whole list of files to the next
_SENT_ROWS = 2_000_000  # places of gone rows that are broadcast
_KEYS_KNOWN = 20_000  # keys of a change for which files are picked
_FEW = 500  # keys that are looked for by a list
_FILE = r"([^/]+/[^/]+/[^/]+)$"  # folder of the version, table, file
HASH = "_hash"
_ONE_FILE = 16 << 20  # bytes that are not worth more than a task
_MOST_FILE = 64 << 20  # bytes from which a table is dealt over more files than shuffles have partitions
_MOST_TIMES = 4  # by how many times more at most, since what the planner takes a join for may be far too much


def _hash(key) -> int:
    return zlib.crc32(str(key).encode())


@dataclass(frozen=True)
class Table:
    """Columns with types, and the key by which rows are found."""

    columns: dict[str, str]
    key: str

    @property
    def ddl(self) -> str:
        return ", ".join(f"`{name}` {kind}" for name, kind in self.columns.items())


class Change:
    """What one version does: files added and dropped, rows gone, and notes."""

    def __init__(self, folder: str):
        self.folder = folder
        self.record: dict = {"add": {}, "drop": {}, "gone": {}, "notes": {}}

    def add(self, table: str, entries: dict) -> None:
        self.record["add"].setdefault(table, {}).update(entries)

    def drop(self, table: str, files: Iterable[str]) -> None:
        self.record["drop"].setdefault(table, []).extend(files)

    def gone(self, table: str, at: str, rows: dict[str, int]) -> None:
        """Rows by file, whose places the table at ``at`` holds."""
        for file, n in rows.items():
            self.record["gone"].setdefault(table, {}).setdefault(file, []).append([at, n])

    def note(self, kind: str, key: str, value) -> None:
        self.record["notes"].setdefault(kind, {})[key] = value


class Store:
    """Tables of one folder, which may be on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table]):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables

    # files

    def fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def read_bytes(self, path: str) -> bytes | None:
        fs, at = self.fs(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write_bytes(self, path: str, data: bytes) -> str:
        fs, at = self.fs(path)
        stream = fs.create(at, True)
        stream.write(bytearray(data))
        stream.close()
        return str(at.toString())

    def delete_path(self, path: str) -> None:
        fs, at = self.fs(path)
        fs.delete(at, True)

    def _names(self, path: str) -> list[str]:
        fs, at = self.fs(path)
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    # versions

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/versions") if re.fullmatch(r"\d+\.json", n))

    def _state_at(self, version: int) -> dict | None:
        text = self.read_bytes(f"{self.path}/versions/{version}.state.json")
        return json.loads(text) if text else None

    def state(self, version: int | None = None) -> dict:
        """A version (the newest): its tables' files with what is known of each, and the notes."""
        names = set(self._names(f"{self.path}/versions"))
        known = sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))
        if version is None:
            version = known[-1] if known else 0
        if version == 0 or version not in known and f"{version}.state.json" not in names:
            return {"version": 0, "tables": {}, "notes": {}}
        whole = max((int(n[:-11]) for n in names if re.fullmatch(r"\d+\.state\.json", n) and int(n[:-11]) <= version), default=0)
        out = (self._state_at(whole) if whole else None) or {"version": 0, "tables": {}, "notes": {}}
        for v in range(out["version"] + 1, version + 1):
            record = json.loads(self.read_bytes(f"{self.path}/versions/{v}.json"))
            self._apply(out, record)
            out["version"] = v
        return out

    @staticmethod
    def _apply(state: dict, record: dict) -> None:
        for table, files in record["drop"].items():
            for f in files:
                state["tables"][table].pop(f, None)
        for table, files in record["add"].items():
            state["tables"].setdefault(table, {}).update(files)
        for table, files in record["gone"].items():
            for f, marks in files.items():
                entry = state["tables"][table][f]
                entry["gone"] = entry.get("gone", []) + marks
        for kind, notes in record["notes"].items():
            state["notes"].setdefault(kind, {}).update(notes)
        state["notes"] = {k: {a: b for a, b in v.items() if b is not None} for k, v in state["notes"].items()}

    def commit(self, change: Callable[[dict, Change], None]) -> int:
        """Publish what ``change`` fills in, given the newest state; again, on the newer state, where another writer was first."""
        for _ in range(_TRIES):
            state = self.state()
            version = state["version"] + 1
            own = Change(f"v{version}-{uuid.uuid4().hex[:8]}")
            change(state, own)
            if self._publish(version, own.record):
                if version % _EACH_STATE == 0:
                    self._apply(state, own.record)
                    state["version"] = version
                    self.write_bytes(f"{self.path}/versions/{version}.state.json", json.dumps(state).encode())
                return version
            self.delete_path(f"{self.path}/{own.folder}")
        raise RuntimeError(f"other writers were first {_TRIES} times")

    def _publish(self, version: int, record: dict) -> bool:
        """Put a version's record in its place; False where that is taken."""
        jvm, name = self.spark._jvm, f".{version}.{uuid.uuid4().hex}"
        self.write_bytes(f"{self.path}/versions/{name}", json.dumps({"version": version, "by": name} | record).encode())
        fs, at = self.fs(f"{self.path}/versions/{name}")
        _, place = self.fs(f"{self.path}/versions/{version}.json")
        uri = place.toUri() if place.toUri().getScheme() else jvm.java.net.URI("file:///")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.spark._jsparkSession.sessionState().newHadoopConf())
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(at, place, never)
        except Py4JJavaError:
            fs.delete(at, False)
            if not fs.exists(place):
                raise
            return False
        # where a file system's rename replaces what came between, the name within tells whose it is
        return json.loads(self.read_bytes(f"{self.path}/versions/{version}.json")).get("by") == name

    def expire(self, keep: int = 2) -> int:
        """Delete all versions but the last ``keep``, and the folders that only they use; how many went.

        Not while another writer is at work: what it has not yet published is in use by no version.
        """
        versions = self.versions()
        kept = versions[-max(1, keep) :]
        if not versions:
            return 0
        states = [self.state(v) for v in kept]
        if self._state_at(kept[0]) is None:  # later records build on it
            self.write_bytes(f"{self.path}/versions/{kept[0]}.state.json", json.dumps(states[0]).encode())
        used = {p.split("/")[0] for s in states for files in s["tables"].values() for f, e in files.items() for p in (f, *(g for g, _ in e.get("gone", [])))}
        old = [v for v in versions if v < kept[0]]
        for v in old:
            self.delete_path(f"{self.path}/versions/{v}.json")
            self.delete_path(f"{self.path}/versions/{v}.state.json")
        for name in self._names(self.path):
            if re.fullmatch(r"[vp]\d+-[0-9a-f]{8}", name) and name not in used:
                self.delete_path(f"{self.path}/{name}")
        return len(old)

    # rows

    def write(
        self, table: str, rows: DataFrame, folder: str | None = None, level: int = 0, merge: Callable[[DataFrame], DataFrame] | None = None, like: DataFrame | None = None
    ) -> dict:
        """New files of ``rows``, and what a state holds of each; to be added by a change.

        Each file has a range of hashes. As these are spread evenly, ranges are equal parts of all that there are, and ``rows`` is computed once.
        ``merge`` is applied to ranges drawn from a sample; where it groups by ``HASH`` and the key, rows are shuffled once for both.
        ``like``: a table of about that size, where ``rows`` come from a join.
        """
        kind = self.tables[table]
        folder = folder or f"p0-{uuid.uuid4().hex[:8]}"
        columns = [F.col(c).cast(t).alias(c) for c, t in kind.columns.items()]
        placed = rows.select(*columns).withColumn(HASH, F.crc32(F.coalesce(F.col(kind.key).cast("string"), F.lit("")).cast("binary")))
        at = f"{self.path}/{folder}/{table}"
        size = size_of(rows if like is None else like)
        if size <= _ONE_FILE:
            dealt = placed.repartition(1)
        elif merge:
            dealt = placed.repartitionByRange(HASH)
        else:
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            n = max(min(parts, size // max(1, _ONE_FILE) + 1), min(_MOST_TIMES * parts, size // _MOST_FILE + 1))
            dealt = placed.repartitionById(n, F.shiftright(F.col(HASH) * n, 32).cast("int"))
        (merge(dealt) if merge else dealt).sortWithinPartitions(HASH).write.option("compression", "zstd").parquet(at)
        read = self.spark.read.schema(f"{HASH} bigint").parquet(at)
        known = read.groupBy(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).agg(F.count("*").alias("n"), F.min(HASH).alias("lo"), F.max(HASH).alias("hi"))
        return {re.search(_FILE, r.f)[1]: {"rows": r.n, "bytes": r.s, "lo": r.lo, "hi": r.hi, "level": level} for r in known.collect()}  # a row for each file

    def entries(self, table: str, state: dict, keys: Iterable[str] | None = None) -> dict:
        """The files of a table, or those that may hold rows of ``keys``."""
        files = state["tables"].get(table, {})
        if keys is None:
            return files
        asked = sorted({_hash(k) for k in keys})

        def may(e: dict) -> bool:
            at = bisect_left(asked, e["lo"])
            return at < len(asked) and asked[at] <= e["hi"]

        return {f: e for f, e in files.items() if may(e)}

    def _scan(self, table: str, files: dict, places: bool = False, asked: list[str] | None = None) -> DataFrame:
        """The rows of some files that are not gone, or of these the ones of a few keys; with ``places``, where each lies."""
        kind = self.tables[table]
        columns = list(kind.columns)
        at = [F.substring_index("_metadata.file_path", "/", -3).alias("_file"), F.col("_metadata.row_index").alias("_row")]

        def read(some: list[str], with_places: bool) -> DataFrame:
            rows = self.spark.read.schema(f"{kind.ddl}, {HASH} bigint").parquet(*[f"{self.path}/{f}" for f in some])
            if asked is not None:  # rows are in the order of their hashes, so pages of others are skipped
                rows = rows.where(F.col(HASH).isin(sorted({_hash(k) for k in asked})) & F.col(kind.key).isin(asked))
            return rows.select(*columns, *(at if with_places else []))

        whole = sorted(f for f, e in files.items() if not e.get("gone"))
        holed = sorted(f for f, e in files.items() if e.get("gone"))
        parts = [read(whole, places)] if whole else []
        if holed:
            marks = sorted({g for f in holed for g, _ in files[f]["gone"]})
            n = sum(k for f in holed for _, k in files[f]["gone"])
            gone = self.spark.read.schema("_file string, _row long").parquet(*[f"{self.path}/{g}" for g in marks])
            left = read(holed, True).join(F.broadcast(gone) if n <= _SENT_ROWS else gone, ["_file", "_row"], "left_anti")
            parts.append(left if places else left.select(*columns))
        if not parts:
            kinds = kind.columns | ({"_file": "string", "_row": "bigint"} if places else {})
            return self.spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])  # no Python worker is begun for this
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read(self, table: str, state: dict | None = None, keys: Iterable[str] | None = None) -> DataFrame:
        """A table of a state (the newest), whole or only the rows of some keys."""
        state = state or self.state()
        if keys is None:
            return self._scan(table, self.entries(table, state))
        keys = sorted({str(k) for k in keys})
        return self._picked(table, state, keys, False)

    def _picked(self, table: str, state: dict, keys: list[str], places: bool) -> DataFrame:
        """The rows of a list of keys."""
        kind = self.tables[table]
        files = self.entries(table, state, keys)
        if len(keys) <= _FEW:
            return self._scan(table, files, places, keys)
        asked = self.spark.createDataFrame([(k,) for k in keys], "_asked string")
        return self._scan(table, files, places).join(F.broadcast(asked), F.col(kind.key) == F.col("_asked"), "left_semi")

    def known(self, keys: DataFrame) -> list[str] | None:
        """The keys in the one column of ``keys``, if there are few enough to pick files by them."""
        found = keys.select(F.col(keys.columns[0]).cast("string").alias("k")).where("k is not null").distinct().limit(_KEYS_KNOWN + 1).collect()
        return sorted(r.k for r in found) if len(found) <= _KEYS_KNOWN else None

    def matching(self, table: str, state: dict, keys: DataFrame | list[str], places: bool = False) -> DataFrame:
        """The rows whose key is in a list, or in the one column of ``keys``; unless these are very many, only files that may hold some of them are read."""
        picked = keys if isinstance(keys, list) else self.known(keys)
        if picked is not None:
            return self._picked(table, state, picked, places)
        kind = self.tables[table]
        found = self._scan(table, self.entries(table, state), places)
        return found.join(keys.select(F.col(keys.columns[0]).cast("string").alias(kind.key)).distinct(), kind.key, "left_semi")

    def remove(self, table: str, state: dict, change: Change, keys: DataFrame | list[str]) -> int:
        """Mark the rows of ``keys`` as gone; how many."""
        if not self.entries(table, state, keys if isinstance(keys, list) else None):
            return 0
        return self.mark(table, change, self.matching(table, state, keys, places=True).select("_file", "_row"))

    def mark(self, table: str, change: Change, places: DataFrame) -> int:
        """Mark ``places(_file, _row)`` as gone; how many."""
        at = f"{change.folder}/{table}-gone-{uuid.uuid4().hex[:8]}"
        places.write.parquet(f"{self.path}/{at}")
        rows = self.spark.read.schema("_file string, _row long").parquet(f"{self.path}/{at}").groupBy("_file").agg(F.count("*").alias("n")).collect()  # a row for each file
        if rows:
            change.gone(table, at, {r["_file"]: r.n for r in rows})
        return sum(r.n for r in rows)

    def append(self, table: str, change: Change, rows: DataFrame, like: DataFrame | None = None) -> DataFrame:
        """Add ``rows`` in new files; the rows as they are there."""
        entries = self.write(table, rows, change.folder, like=like)
        change.add(table, entries)
        return self._scan(table, entries)

    def compact(self, table: str, most_parts: int = 8, most_gone: float = 0.2, merge: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Merge the levels of a table that more than ``most_parts`` changes have added to, or of whose rows over ``most_gone`` are gone.

        What is merged goes one level up from the highest of them. ``merge`` is applied to the rows on the way, as by ``write``. How many files were merged.
        """

        def due(state: dict) -> tuple[dict, int]:
            levels: dict[int, dict] = {}
            for f, e in state["tables"].get(table, {}).items():
                levels.setdefault(e["level"], {})[f] = e
            out, top = {}, 0
            for level, files in levels.items():
                rows, gone = sum(e["rows"] for e in files.values()), sum(n for e in files.values() for _, n in e.get("gone", []))
                if len({f.split("/")[0] for f in files}) > most_parts or gone > most_gone * rows:
                    out, top = out | files, max(top, level + 1)
            return out, top

        def tidy(state: dict, change: Change) -> None:
            files, level = due(state)
            if files:
                rows = self._scan(table, files)
                change.add(table, self.write(table, rows, change.folder, level, merge))
                change.drop(table, files)

        found, _ = due(self.state())
        if found:
            self.commit(tidy)
        return len(found)
