"""Adapters: code that turns a source's raw rows into records, declared by manifests and run on the executors inside a boundary.

An adapter is the text of a module with a generator `rows(context)`. It comes with a manifest and may use what `SERVED` and
`BUILTINS` name, nothing else: no files, processes or network, no other module, no way back from an object to the interpreter. That is
held twice. Before anything runs, the compiled code is read: every import, global name and attribute in it must be one that
the boundary serves (`refusals`). When it runs, it has a module of its own whose built-ins are those of `BUILTINS` and whose imports hand
out copies of the public names of `SERVED` modules. The boundary keeps honest adapters honest; it is no prison for hostile ones.

Two ways lead in. `adapted` maps the partitions of any DataFrame that Spark has read. The data source `AdapterSource`, registered
by `register`, reads the files that a manifest file names itself: `spark.read.format("shizuku_adapter").option("manifest",
path).load()`. It plans one partition for each row group of Parquet files and for each other file, reads only the raw columns that the
manifest lists, and takes filters: those on the source and the region of the manifest settle whole tables, those on columns that
the manifest declares to be copied go to the Parquet reader. Spark applies all filters again, so what is pushed down only saves work.
"""

from __future__ import annotations

import builtins
import dis
import importlib
import json
import types
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: Modules whose public names adapters get. All of them work on values in memory.
SERVED = ("__future__", "collections", "datetime", "decimal", "fractions", "functools", "itertools", "json", "math", "re", "unicodedata")
#: Built-in names that adapters get; exceptions are added below.
BUILTINS = (
    "abs", "all", "any", "bool", "bytes", "chr", "dict", "divmod", "enumerate", "filter", "float", "frozenset", "hash", "int", "isinstance", "issubclass", "iter", "len",
    "list", "map", "max", "min", "next", "None", "True", "False", "ord", "pow", "range", "repr", "reversed", "round", "set", "slice", "sorted", "str", "sum", "tuple", "zip",
)
_GIVEN = {n: getattr(builtins, n) for n in BUILTINS} | {n: x for n, x in vars(builtins).items() if isinstance(x, type) and issubclass(x, Exception)}
#: Attributes that lead from a value to frames, code or formatting mini-languages that read attributes.
_LEADS_OUT = ("_", "f_", "gi_", "cr_", "ag_", "tb_", "co_")
_READS_ATTRIBUTES = ("format", "format_map")
#: Rows that go to Spark together.
TOGETHER = 5000


@dataclass(frozen=True)
class Manifest:
    """What a source gives.

    source, region: constants of all its records; schema: of the records; expected_rows: how many there must be (None: any number);
    checks: conditions on all of them, as (name, SQL expression). For the data source also: code, the adapter; inputs: the files, Parquet,
    CSV or JSON lines by their endings; columns: the raw columns that the adapter reads (empty: all); copied: records' columns
    whose values are those of a raw column, as (record column, raw column).
    """

    source: str
    region: str
    schema: str
    expected_rows: int | None = None
    checks: tuple[tuple[str, str], ...] = ()
    code: str = ""
    inputs: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    copied: tuple[tuple[str, str], ...] = ()

    def problems(self) -> list[str]:
        out = [f"{name} is empty" for name in ("source", "region", "schema") if not getattr(self, name).strip()]
        if self.expected_rows is not None and (isinstance(self.expected_rows, bool) or not isinstance(self.expected_rows, int) or self.expected_rows < 0):
            out.append("expected_rows isn't a number of rows")
        own = {n for n, _ in self.copied} & {"source_id", "region_id"}
        return out + [f"{n} can't be copied from a raw column" for n in sorted(own)] + [f"the raw column {raw} is copied but not among columns" for _, raw in self.copied if self.columns and raw not in self.columns]

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Manifest:
        given = json.loads(text)
        if unknown := set(given) - set(Manifest.__dataclass_fields__):
            raise ValueError(f"a manifest has no {sorted(unknown)}")
        return Manifest(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in given.items()})


@dataclass
class Context:
    """What an adapter sees: its source, its region, and the raw rows of one partition as dicts."""

    source: str
    region: str
    input_rows: Callable[[], Iterator[dict]] = field(repr=False, default=lambda: iter(()))


# The boundary.


def _codes(code: types.CodeType) -> Iterator[types.CodeType]:
    yield code
    for x in code.co_consts:
        if isinstance(x, types.CodeType):
            yield from _codes(x)


def refusals(text: str) -> list[str]:
    """What an adapter's code asks for that the boundary doesn't serve, in order of lines; empty if it may run."""
    try:
        code = compile(text, "adapter", "exec", dont_inherit=True)
    except (SyntaxError, ValueError) as e:
        return [f"line {getattr(e, 'lineno', None) or 0}: {e}"]
    every = list(_codes(code))
    # Names that the code makes itself, at the top or as `global`.
    made = {i.argval for c in every for i in dis.get_instructions(c) if i.opname in ("STORE_NAME", "STORE_GLOBAL")}
    known, found = made | set(_GIVEN) | {"__name__", "__annotations__", "__conditional_annotations__"}, set()
    for c in every:
        level, line = 0, c.co_firstlineno
        for i in dis.get_instructions(c):
            line = i.line_number or line
            name = i.argval
            if i.opname == "IMPORT_NAME":
                if level or name not in SERVED:
                    found.add((line, f"import of {'.' * level}{name}"))
            elif i.opname == "IMPORT_FROM":
                if name.startswith("_"):
                    found.add((line, f"import of {name}"))
            elif i.opname in ("LOAD_NAME", "LOAD_GLOBAL", "LOAD_FROM_DICT_OR_GLOBALS"):
                if name not in known and not (i.opname == "LOAD_NAME" and name in ("__module__", "__qualname__")):
                    found.add((line, f"the name {name}"))
            elif i.opname in ("LOAD_ATTR", "LOAD_METHOD", "STORE_ATTR", "DELETE_ATTR", "LOAD_SUPER_ATTR"):
                if name.startswith(_LEADS_OUT) or name in _READS_ATTRIBUTES:
                    found.add((line, f"the attribute {name}"))
            elif i.opname == "MATCH_CLASS":  # reads attributes by names that stand in a constant
                found.add((line, "a class pattern"))
            elif i.opname == "CALL_INTRINSIC_1" and "STAR" in str(i.argrepr):
                found.add((line, "import of *"))
            elif i.opname == "LOAD_BUILD_CLASS":
                found.add((line, "a class"))
            # The level of an import is the number loaded two instructions before it.
            if i.opname in ("LOAD_CONST", "LOAD_SMALL_INT") and isinstance(name, int):
                level = name
    return [f"line {line}: {what}" for line, what in sorted(found)]


def _served(name: str, given: dict | None = None, here: dict | None = None, wanted: Sequence[str] = (), level: int = 0) -> types.ModuleType:
    if level or name not in SERVED:
        raise ImportError(f"adapters can't import {'.' * level}{name}")
    real, copy = importlib.import_module(name), types.ModuleType(name)
    for key, value in vars(real).items():
        if not key.startswith("_") and not isinstance(value, types.ModuleType):
            setattr(copy, key, value)
    return copy


def loaded(text: str) -> Callable[[Context], Iterable[dict]]:
    """The function `rows` of an adapter's code. Code that the boundary refuses doesn't run."""
    if found := refusals(text):
        raise ValueError(f"the adapter leaves its boundary: {'; '.join(found)}")
    names = {"__builtins__": _GIVEN | {"__import__": _served}, "__name__": "adapter"}
    exec(compile(text, "adapter", "exec", dont_inherit=True), names)
    if not callable(names.get("rows")):
        raise ValueError("the adapter has no function rows")
    return names["rows"]


# Running adapters.


def _record_schema(manifest: Manifest) -> str:
    return f"{manifest.schema}, source_id string, region_id string"


def _checked(manifest: Manifest, code: str) -> None:
    """Raises where manifest or code have problems, before a plan is made of them."""
    if manifest.problems():
        raise ValueError(f"{manifest.source}: {manifest.problems()}")
    loaded(code)


def _records(manifest: Manifest, code: str, inputs: Callable[[], Iterator[dict]]) -> Iterator[dict]:
    for record in loaded(code)(Context(manifest.source, manifest.region, inputs)):
        yield {**record, "source_id": manifest.source, "region_id": manifest.region}


def adapted(raw: DataFrame, manifest: Manifest, code: str = "") -> DataFrame:
    """The records that the adapter gives for the raw rows, partition by partition, with source_id and region_id. Manifests with problems and code beyond the boundary are refused at once."""
    code = code or manifest.code
    _checked(manifest, code)
    names = T._parse_datatype_string(_record_schema(manifest)).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def inputs() -> Iterator[dict]:
            for batch in batches:
                yield from batch.astype(object).where(batch.notna(), None).to_dict("records")

        held: list[dict] = []
        for record in _records(manifest, code, inputs):
            held.append(record)
            if len(held) == TOGETHER:
                yield pd.DataFrame(held, columns=names)
                held = []
        yield pd.DataFrame(held, columns=names)

    return raw.mapInPandas(run, _record_schema(manifest))


# The data source.


@dataclass
class _Part(InputPartition):
    """A file, or one row group of it."""

    path: str
    row_group: int | None = None

    def __init__(self, path: str, row_group: int | None = None):
        self.path, self.row_group = path, row_group


def _opened(path: str):
    """File system and path within it: of a local path, or of an address that Arrow knows (file, hdfs, s3, gs, ...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _text(path: str) -> str:
    system, place = _opened(path)
    with system.open_input_stream(place) as f:
        return f.read().decode()


class AdapterReader(DataSourceReader):
    """Plans partitions from a manifest and runs its adapter on each."""

    def __init__(self, manifest: Manifest, schema: T.StructType):
        self.manifest, self.names = manifest, schema.fieldNames()
        self.nothing = False
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what it can use and gives all back, so that Spark still applies them."""
        copied, fixed = dict(self.manifest.copied), {"source_id": self.manifest.source, "region_id": self.manifest.region}
        signs = {EqualTo: "==", EqualNullSafe: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in fixed and isinstance(f, (EqualTo, EqualNullSafe, In)):
                self.nothing |= fixed[column] not in (f.value if isinstance(f, In) else (f.value,))
            elif column in copied and type(f) in signs and f.value is not None:
                self.wanted.append((copied[column], signs[type(f)], f.value))
            elif column in copied and isinstance(f, In) and all(v is not None for v in f.value):
                self.wanted.append((copied[column], "in", list(f.value)))
            elif column in copied and isinstance(f, IsNotNull):
                self.wanted.append((copied[column], "not null", None))
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        import pyarrow.parquet as pq

        if self.nothing:
            return []
        out: list[InputPartition] = []
        for path in self.manifest.inputs:
            if path.endswith(".parquet"):
                system, place = _opened(path)
                meta = pq.read_metadata(place, filesystem=system)
                out += [_Part(path, i) for i in range(meta.num_row_groups) if self._may_hold(meta, i)]
            else:
                out.append(_Part(path))
        return out

    def _may_hold(self, meta, group: int) -> bool:
        """Whether a row group's statistics leave room for rows that pass the filters."""
        stats = {}
        for k in range(meta.num_columns):
            column = meta.row_group(group).column(k)
            if column.is_stats_set and column.statistics.has_min_max:
                stats[column.path_in_schema] = (column.statistics.min, column.statistics.max)
        for name, sign, value in self.wanted:
            if name not in stats or sign == "not null":
                continue
            lo, hi = stats[name]
            values = value if sign == "in" else [value]
            try:
                room = {"==": lambda v: lo <= v <= hi, "in": lambda v: lo <= v <= hi, ">": lambda v: hi > v, ">=": lambda v: hi >= v, "<": lambda v: lo < v, "<=": lambda v: lo <= v}[sign]
                if not any(room(v) for v in values):
                    return False
            except TypeError:  # a value of another kind than the column's
                continue
        return True

    def _batches(self, part: _Part) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        system, place = _opened(part.path)
        columns = list(self.manifest.columns) or None
        if part.row_group is not None:
            with system.open_input_file(place) as f:
                for batch in pq.ParquetFile(f).iter_batches(TOGETHER, row_groups=[part.row_group], columns=columns):
                    yield self._filtered(batch)
        elif part.path.endswith((".jsonl", ".json", ".ndjson")):
            import itertools

            with system.open_input_stream(place) as f:
                lines = (line for line in (x.strip() for x in f.read().decode().split("\n")) if line)
                while chunk := list(itertools.islice(lines, TOGETHER)):
                    rows = [json.loads(x) for x in chunk]
                    names = columns or list(dict.fromkeys(k for r in rows for k in r))
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows])
        else:
            import pyarrow.csv as pc

            options = pc.ConvertOptions(include_columns=columns)
            with system.open_input_stream(place) as f, pc.open_csv(f, convert_options=options) as reader:
                yield from reader

    def _filtered(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        import pyarrow.compute as pc

        by = {"==": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}
        for name, sign, value in self.wanted:
            column = batch.column(name)
            try:
                keep = pc.is_valid(column) if sign == "not null" else pc.is_in(column, pa.array(value, column.type)) if sign == "in" else by[sign](column, pa.scalar(value, column.type))
            except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError):  # Spark will filter
                continue
            batch = batch.filter(keep)
        return batch

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # where no partition was planned, Spark asks once without one
            return

        def inputs() -> Iterator[dict]:
            for batch in self._batches(partition):
                yield from batch.to_pylist()

        names = self.names
        for record in _records(self.manifest, self.manifest.code, inputs):
            yield tuple(record.get(n) for n in names)


class AdapterSource(DataSource):
    """Options: manifest, the path of a manifest file."""

    @classmethod
    def name(cls) -> str:
        return "shizuku_adapter"

    def _manifest(self) -> Manifest:
        if "manifest" not in self.options:
            raise ValueError("the option manifest names the manifest file")
        manifest = Manifest.from_json(_text(self.options["manifest"]))
        _checked(manifest, manifest.code)
        return manifest

    def schema(self) -> str:
        return _record_schema(self._manifest())

    def reader(self, schema: T.StructType) -> AdapterReader:
        return AdapterReader(self._manifest(), schema)


def register(spark: SparkSession) -> None:
    """Makes the data source known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AdapterSource)


def unmet(records: DataFrame, manifest: Manifest) -> DataFrame:
    """name, expected, found of the manifest's expectations that the records don't meet: the number of rows, and rows that break a check. One pass."""
    counts = [F.count("*").alias("rows"), *(F.count_if(~F.coalesce(F.expr(test), F.lit(False))).alias(f"c{i}") for i, (_, test) in enumerate(manifest.checks))]
    wanted = [("rows", F.lit(manifest.expected_rows).cast("long"), F.col("rows")), *((name, F.lit(0).cast("long"), F.col(f"c{i}")) for i, (name, _) in enumerate(manifest.checks))]
    listed = F.array(*(F.struct(F.lit(n).alias("name"), e.alias("expected"), f.alias("found")) for n, e, f in wanted))
    return records.agg(*counts).select(F.explode(listed).alias("x")).select("x.*").filter("expected IS NOT NULL AND expected <> found")
