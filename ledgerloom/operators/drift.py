"""Problem 4: schemas that drift between files.

Every record is reduced to its tagged paths (a leaf path and the type found there). Schemas fuse into tagged unions: per path all
alternative types that were met, each with the place where it appeared first, the alternative that holds now, and whether the latest
record has the path. Fusing is associative, so unions are built in parallel, per partition, and fused in order. ``schema_changes`` lets
each record meet the union of all earlier readable records of its stream and reports what appears in it: a path (added, or renamed), an
end of a path, another alternative. ``fused_schema`` is the union over all records; ``consistent_table`` reads all records into one
table, with a canonical column per path and a typed branch for each alternative of a path that has several.

Streams may be of any length: records are range-partitioned by stream and time, so a long stream spreads over many tasks. The union of
a partition's last stream is handed on to the partitions that follow, as a row of their own input; its size is that of the schema.

Defined results: unreadable text (null, empty, malformed, not an object, no stage) is no record; a record delivered twice counts once
(the first line of a file's stage holds, everywhere); repeated keys of an object count as the last; an empty object is a leaf without
type; rows without pipeline or without a time in the file name are no records; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, MapType, StringType

from ..session import written

CHANGES = "pipeline_id bigint, file_name string, stage string, change_kind string, old_path string, new_path string, old_type string, new_type string"
_STAMP = re.compile(r"_(\d{8}_\d{6})\.json$")


def _refuse(x: str):
    raise ValueError(x)


def tagged(value: dict, prefix: str = "") -> Iterator[tuple[str, str]]:
    """The leaf paths of an object with their types; '' for a leaf without type."""
    for k, v in value.items():
        path = prefix + k
        if isinstance(v, dict) and v:
            yield from tagged(v, path + ".")
        else:
            yield path, "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else ""


def parse(raw: str | None) -> tuple[str, str] | None:
    """The stage of a record and its tagged paths as JSON text in path order; None if it isn't readable."""
    try:
        value = json.loads(raw or "", parse_constant=_refuse)
        stage = value["stage"] if isinstance(value, dict) else None
        return (stage, json.dumps(dict(sorted(tagged(value))), ensure_ascii=False)) if isinstance(stage, str) else None
    except (ValueError, KeyError, RecursionError):
        return None


def _readable(values: pa.Array) -> pa.Array:
    return pa.array([parse(x) is not None for x in values.to_pylist()], pa.bool_())


def readable(raw: Column) -> Column:
    """Whether a text is a readable record: one well-formed JSON object with a stage, and nothing behind it."""
    return F.arrow_udf(_readable, BooleanType())(raw)


def records(df: DataFrame) -> DataFrame:
    """pipeline_id, file_name, at, stage, paths: a row per readable record, also of records delivered twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pid, file, line, raw in zip(*(c.to_pylist() for c in batch.columns)):
                stamp = _STAMP.search(file or "")
                got = parse(raw) if stamp and pid is not None else None
                if got:
                    rows.append((pid, file, stamp[1], line, *got))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["pipeline_id", "file_name", "at", "line_id", "stage", "paths"])

    return df.select(F.col("pipeline_id").cast("bigint"), "file_name", F.col("line_id").cast("bigint"), "raw").mapInArrow(
        run, "pipeline_id bigint, file_name string, at string, line_id bigint, stage string, paths string"
    )


class Union:
    """The tagged union of the records of one stream so far.

    paths: per path [present, current, origin, alternatives]: whether the latest record has it; the type that holds now ('' if none was
    met); the path that it continues under a new name while its type is unknown; and the first file of each alternative type. first: the
    stream's first record, at which an earlier union goes on.
    """

    def __init__(self, key=None, file: str = "", text: str = "", paths: dict | None = None, first: list[str] | None = None):
        self.key, self.file, self.text, self.paths, self.first = key, file, text, paths or {}, first

    @property
    def begun(self) -> bool:
        return bool(self.file)

    def state(self) -> str:
        return json.dumps([self.file, self.text, self.paths, self.first], ensure_ascii=False)

    @classmethod
    def of_state(cls, key, state: str) -> Union:
        return cls(key, *json.loads(state))

    def fuse(self, later: Union) -> Union:
        """The union of this one's records and those of ``later``, which follow in the same stream."""
        mine = Union.of_state(self.key, self.state())
        if later.first:
            mine.take(self.key, *later.first)
        paths = {p: [False, *own[1:]] for p, own in mine.paths.items()}
        for p, (present, now, origin, kinds) in later.paths.items():
            own = paths.get(p)
            if not now and origin in mine.paths:  # renamed while only nulls were met
                now = mine.paths[origin][1]
            elif not now and own:
                now = own[1]
            paths[p] = [present, now, origin, kinds | own[3] if own else dict(kinds)]
        return Union(self.key, later.file, later.text, paths, self.first)

    def take(self, key, file: str, text: str) -> list[tuple[str, str, str, str, str]]:
        """Takes the next record, given as the JSON text of its tagged paths, and gives the changes that it brings: kind, old and new
        path, old and new type. A record of the same file was delivered before."""
        if key != self.key:
            self.__init__(key)
        elif file == self.file or text == self.text:  # nothing new
            self.file = file
            return []
        new, first, paths = json.loads(text), not self.begun, self.paths
        changes = [] if first else self._appearing(new)
        self.first = [file, text] if first else self.first
        for what, a, b, *_ in changes:
            if what == "renamed":  # a renamed field keeps its type
                paths[b] = [True, paths[a][1], "" if paths[a][1] else a, dict(paths[a][3])]
        for p, own in paths.items():
            own[0] = p in new
        for p, kind in new.items():
            own = paths.setdefault(p, [True, "", "", {}])
            if kind:
                own[1] = kind
                own[3].setdefault(kind, file)
        self.file, self.text = file, text
        return changes

    def _appearing(self, new: dict[str, str]) -> list[tuple[str, str, str, str, str]]:
        """A vanished path and an appearing one are a renaming if their types agree (a leaf without type agrees with any): first those
        of the same last name, then a single pair that is left over."""
        gone = sorted(p for p, own in self.paths.items() if own[0] and p not in new)
        come = sorted(p for p in new if p not in self.paths or not self.paths[p][0])
        kind = lambda p: self.paths[p][1]
        agree = lambda a, b: not kind(a) or not new[b] or kind(a) == new[b]
        last = lambda p: p.rpartition(".")[2]
        out = []

        def pair(a: str, b: str) -> None:
            gone.remove(a)
            come.remove(b)
            out.append(("renamed", a, b, kind(a), new[b]))

        for a in list(gone):
            match = [b for b in come if last(a) == last(b) and agree(a, b)]
            if match:
                pair(a, match[0])
        if len(gone) == len(come) == 1 and agree(gone[0], come[0]):
            pair(gone[0], come[0])
        out += [("removed", a, "", kind(a), "") for a in gone] + [("added", "", b, "", new[b]) for b in come]
        # An alternative other than the one that holds: it is new to the path, or it returns.
        out += [("type_changed", p, p, kind(p), t) for p, t in sorted(new.items()) if t and p in self.paths and self.paths[p][0] and kind(p) not in ("", t)]
        return out


_STATE = "first_pipeline bigint, first_stage string, pipeline_id bigint, stage string, state string, part int"
_ORDER = ("part", "pipeline_id", "stage", "at", "file_name", "line_id")


def _ordered(df: DataFrame) -> DataFrame:
    """Records in order of stream and time, in range partitions that a written table holds fast."""
    own = records(df)
    ranged = own.repartitionByRange(F.col("pipeline_id"), F.col("stage"), F.col("at"), F.col("file_name")).sortWithinPartitions(*_ORDER[1:])
    return written(ranged.withColumn("part", F.spark_partition_id()), "records")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in ("part", "pipeline_id", "stage", "file_name", "line_id", "paths")))


def schema_changes(df: DataFrame) -> DataFrame:
    """A row per change of a record against the union of the earlier readable records of the same pipeline and stage."""
    own = _ordered(df)
    # Each range partition again becomes one task: rows move to the task of their part, sorted as before.
    parts = own.repartition(F.col("part")).sortWithinPartitions(*_ORDER)

    def unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, union, first = [], None, Union(), None

        def close():
            if part is not None:
                out.append((*first, *union.key, union.state(), part))

        for batch in batches:
            for p, pid, stage, file, _, paths in _rows(batch):
                if p != part:
                    close()
                    part, union, first = p, Union(), (pid, stage)
                union.take((pid, stage), file, paths)
        close()
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*out)) or [[]] * 6, kinds)], ["first_pipeline", "first_stage", "pipeline_id", "stage", "state", "part"])

    # One row per range partition passes by; what is handed on goes back as a row of the partition's input.
    states = written(parts.mapInArrow(unions, _STATE), "unions")
    before, handed = None, []
    for r in states.orderBy("part").toLocalIterator():
        key, first = (r["pipeline_id"], r["stage"]), (r["first_pipeline"], r["first_stage"])
        goes_on = before is not None and before.key == first
        if goes_on:
            handed.append((*first, "", before.file, -1, before.state(), r["part"]))
        union = Union.of_state(key, r["state"])
        before = before.fuse(union) if goes_on and key == first else union
    if handed:
        carried = df.sparkSession.createDataFrame(handed, "pipeline_id bigint, stage string, at string, file_name string, line_id bigint, paths string, part int")
        parts = own.unionByName(carried.select(*own.columns)).repartition(F.col("part")).sortWithinPartitions(*_ORDER)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, union = None, Union()
        for batch in batches:
            out = []
            for p, pid, stage, file, line, paths in _rows(batch):
                if p != part:
                    part, union = p, Union()
                if line == -1 and not union.begun:
                    union = Union.of_state((pid, stage), paths)
                else:
                    out += [(pid, file, stage, *change) for change in union.take((pid, stage), file, paths)]
            kinds = [pa.int64(), *[pa.string()] * 7]
            names = ["pipeline_id", "file_name", "stage", "change_kind", "old_path", "new_path", "old_type", "new_type"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*out)) or [[]] * 8, kinds)], names)

    return parts.mapInArrow(find, CHANGES)


def _once(df: DataFrame) -> DataFrame:
    """Of each file and stage the record that counts: the one of the first line."""
    return records(df).groupBy("pipeline_id", "file_name", "stage").agg(F.min_by(F.struct("at", "paths"), F.struct("line_id", "paths")).alias("r")).select("pipeline_id", "file_name", "stage", "r.*")


def fused_schema(df: DataFrame) -> DataFrame:
    """The tagged union of all records' schemas: a row per stage, path and type, with the number of records and the first file that
    has it, and whether the path has another type too. The canonical type is the most frequent one, the later in the alphabet of equals."""
    leaves = _once(df).select("stage", "at", F.explode(F.from_json("paths", "map<string,string>")).alias("path", "kind"))
    types = leaves.groupBy("stage", "path", "kind").agg(F.count("*").alias("n_records"), F.min("at").alias("first_at"))
    branches = types.where("kind <> ''").groupBy("stage", "path").agg(F.count("*").alias("n_types"), F.max_by("kind", F.struct("n_records", "kind")).alias("canonical_type"))
    return types.join(branches, ["stage", "path"], "left").select("stage", "path", "kind", "n_records", "first_at", F.coalesce("n_types", F.lit(0)).alias("n_types"), "canonical_type")


def _leaf_texts(values: pa.Array) -> pa.Array:
    """The leaves of each record, path and JSON text."""

    def leaves(value: dict, prefix: str = "") -> Iterator[tuple[str, str]]:
        for k, v in value.items():
            if isinstance(v, dict) and v:
                yield from leaves(v, prefix + k + ".")
            else:
                yield prefix + k, json.dumps(v, ensure_ascii=False)

    return pa.array([None if x is None or parse(x) is None else list(dict(leaves(json.loads(x))).items()) for x in values.to_pylist()], pa.map_(pa.string(), pa.string()))


#: Most paths that get columns of their own, the most frequent ones; the others go to the column ``~rest``.
MOST_PATHS = 2000
_AS = {"number": "double", "boolean": "boolean", "string": "string", "array": "string"}


def _typed(value: Column, kind: str) -> Column:
    return F.when(F.schema_of_variant(value).rlike(_VARIANT[kind]), value.cast(_AS[kind]))


#: Variant type names of each kind.
_VARIANT = {"number": "^(BIGINT|DOUBLE|DECIMAL|FLOAT|TINYINT|SMALLINT|INT)", "boolean": "^BOOLEAN$", "string": "^STRING$", "array": "^ARRAY"}


def consistent_table(df: DataFrame) -> DataFrame:
    """All readable records in one table: pipeline_id, file_name, stage, and a column per path.

    A path of one type gets that type (numbers as double, arrays as JSON text). A path of several types gets a canonical column of its
    most frequent type, into which other values are converted where they can be (else it is null there), and beside it a branch ``path::type`` for each type, which holds the values as they are. A path whose name
    differs from that of a more frequent one by case only gets a ``~`` behind it. Beyond MOST_PATHS paths the rarer ones, whose names
    then mostly are data, stand in the map ``~rest`` from path to JSON text.
    """
    schema = fused_schema(df).groupBy("path").agg(F.collect_set(F.when(F.col("kind") != "", F.col("kind"))).alias("kinds"), F.max_by("kind", F.when(F.col("kind") != "", F.struct("n_records", "kind"))).alias("main"), F.sum("n_records").alias("n"))
    found = schema.orderBy(F.col("n").desc(), "path").limit(MOST_PATHS + 1).collect()
    more, found = len(found) > MOST_PATHS, found[:MOST_PATHS]
    keys = {"pipeline_id", "file_name", "stage"}
    source = df.select(F.col("pipeline_id").cast("bigint"), "file_name", "line_id", "raw").where(readable(F.col("raw"))).select("pipeline_id", "file_name", "line_id", F.try_parse_json("raw").alias("v"))
    source = source.where(F.col("v").isNotNull() & F.col("pipeline_id").isNotNull() & F.col("file_name").rlike(_STAMP.pattern)).withColumn("stage", F.try_variant_get("v", "$.stage", "string")).where("stage IS NOT NULL")
    source = source.groupBy("pipeline_id", "file_name", "stage").agg(F.min_by("v", "line_id").alias("v"))
    columns, taken = [], set(keys)
    for r in found:
        if r["path"] in keys:
            continue
        name = r["path"]
        while name.lower() in taken:  # column names are compared without case
            name += "~"
        taken.add(name.lower())
        at = "$" + "".join(f'["{p}"]' if '"' not in p else f"['{p}']" for p in r["path"].split("."))
        main, kinds = r["main"] or "string", sorted(r["kinds"])
        columns.append(F.try_variant_get("v", at, _AS[main]).alias(name))
        if len(kinds) > 1:
            columns += [_typed(F.try_variant_get("v", at, "variant"), k).alias(f"{name}::{k}") for k in kinds]
    if more:
        rest = F.map_filter(F.arrow_udf(_leaf_texts, MapType(StringType(), StringType()))(F.to_json("v")), lambda k, v: ~k.isin([r["path"] for r in found]))
        columns.append(rest.alias("~rest"))
    return source.select("pipeline_id", "file_name", "stage", *columns)
