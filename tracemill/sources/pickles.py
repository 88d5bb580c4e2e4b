"""Pickled artifacts as a Spark data source: `spark.read.format("tracemill_artifacts").load(base)`.

One input partition is one file, read opcode by opcode as a stream: rows come out as the lists of the file's top
object are read, and only values that a file refers to again are kept. Only plain data is understood; a pickle that
names any class or function is refused, so nothing of a file is ever called.
"""

from __future__ import annotations

import io
import json
import pickle
import pickletools
import uuid
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

#: One row for each item of each list in the top object, and one without an index for what is no list.
SCHEMA = "path string, dataset string, model string, file string, size long, field string, index long, value string"
_ARROW = pa.schema([(n, pa.int64() if n in ("size", "index") else pa.string()) for n in ("path", "dataset", "model", "file", "size", "field", "index", "value")])
_BATCH_BYTES, _BATCH_ROWS = 4 << 20, 2000

_VALUES = frozenset("INT BININT BININT1 BININT2 LONG LONG1 LONG4 STRING BINSTRING SHORT_BINSTRING BINBYTES SHORT_BINBYTES BINBYTES8 BYTEARRAY8 UNICODE SHORT_BINUNICODE BINUNICODE BINUNICODE8 FLOAT BINFLOAT".split())
_CONSTANTS = {"NONE": None, "NEWTRUE": True, "NEWFALSE": False}
_EMPTY = {"EMPTY_LIST": list, "EMPTY_DICT": dict, "EMPTY_TUPLE": tuple, "EMPTY_SET": set}


class _Rows(list):
    """A list whose items are passed on as they are read; it keeps their number only."""

    def __init__(self, field: str):
        super().__init__()
        self.field, self.n = field, 0


def _opcodes(stream) -> Iterator[tuple[str, object]]:
    for op, arg, _ in pickletools.genops(stream):
        yield op.name, arg


def _referred(stream) -> set[int]:
    """Numbers of the memo that the pickle reads again."""
    return {int(arg) for name, arg in _opcodes(stream) if name in ("GET", "BINGET", "LONG_BINGET")}


def items(opened) -> Iterator[tuple[str, int | None, object]]:
    """(field, index, value) of a pickle: the items of the lists in its top dict, or of a top list under the field "".

    opened() opens the file anew, as a buffered stream: it is read twice. What is no list has no index.
    Raises ValueError for a pickle that holds more than plain data, or that ends early.
    """
    with opened() as stream:
        wanted = _referred(stream)
    with opened() as stream:
        yield from _run(_opcodes(stream), wanted)


def _run(ops, wanted: set[int]) -> Iterator[tuple[str, int | None, object]]:
    stack, below, memo, count = [], [], {}, 0

    def remember(k: int) -> None:
        if k in wanted:
            memo[k] = stack[-1]

    def add(held, new) -> Iterator[tuple[str, int, object]]:
        if isinstance(held, _Rows):
            for v in new:
                yield held.field, held.n, v
                held.n += 1
        else:
            held.extend(new)

    for name, arg in ops:
        if name in ("PROTO", "FRAME"):
            continue
        if name in _VALUES:
            stack.append(arg)
        elif name in _CONSTANTS:
            stack.append(_CONSTANTS[name])
        elif name in _EMPTY:
            value = _EMPTY[name]()
            if name == "EMPTY_LIST":  # a list that is the top object, or a value of the top dict, is passed on
                top = below[0] if below else stack
                if not below and not stack:
                    value = _Rows("")
                elif top and isinstance(top[0], dict) and (len(below) == 1 and len(top) == 1 and len(stack) % 2 == 1 or not below and len(stack) == 2):
                    value = _Rows(str(stack[-1]))
            stack.append(value)
        elif name == "MARK":
            below.append(stack)
            stack = []
        elif name in ("APPENDS", "SETITEMS", "ADDITEMS"):
            new, stack = stack, below.pop()
            if name == "APPENDS":
                yield from add(stack[-1], new)
            elif name == "SETITEMS":
                stack[-1].update(zip(new[::2], new[1::2]))
            else:
                stack[-1].update(new)
        elif name == "APPEND":
            v = stack.pop()
            yield from add(stack[-1], [v])
        elif name == "SETITEM":
            v, k = stack.pop(), stack.pop()
            stack[-1][k] = v
        elif name in ("LIST", "TUPLE", "DICT", "FROZENSET"):
            new, stack = stack, below.pop()
            stack.append(dict(zip(new[::2], new[1::2])) if name == "DICT" else {"LIST": list, "TUPLE": tuple, "FROZENSET": frozenset}[name](new))
        elif name in ("TUPLE1", "TUPLE2", "TUPLE3"):
            k = int(name[-1])
            stack[-k:] = [tuple(stack[-k:])]
        elif name == "MEMOIZE":
            remember(count)
            count += 1
        elif name in ("PUT", "BINPUT", "LONG_BINPUT"):
            remember(int(arg))
            count += 1
        elif name in ("GET", "BINGET", "LONG_BINGET"):
            stack.append(memo[int(arg)])
        elif name == "POP":
            stack.pop()
        elif name == "POP_MARK":
            stack = below.pop()
        elif name == "STOP":
            break
        else:
            raise ValueError(f"the pickle holds more than plain data: {name}")
    top = stack[-1]
    if isinstance(top, _Rows):
        return
    for k, v in top.items() if isinstance(top, dict) else [("", top)]:
        if isinstance(v, list) and not isinstance(v, _Rows):
            for i, x in enumerate(v):
                yield str(k), i, x
        elif not isinstance(v, _Rows):
            yield str(k), None, v


def _plain(v):
    if isinstance(v, (set, frozenset)):
        return sorted((_plain(x) for x in v), key=repr)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).decode("utf-8", "replace")
    raise TypeError(type(v))


def as_json(v) -> str | None:
    """A value as JSON: tuples and sets as lists, bytes as text; None as no text at all."""
    return None if v is None else json.dumps(v, default=_plain)


def _parts(path: str) -> tuple[str, str, str]:
    """(dataset, model, file) of a path: the two folders above the file, or one and the model's name in the file's."""
    at = path.split("/")
    file = at[-1]
    if file.startswith("traces_"):
        return at[-2] if len(at) > 1 else "", file.removeprefix("traces_").removesuffix(".pkl").split(".part-")[0], file
    return at[-3] if len(at) > 2 else "", at[-2] if len(at) > 1 else "", file


class _File(InputPartition):
    def __init__(self, path: str, size: int):
        super().__init__((path, size))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base, self.pattern, self.only = options["path"], options.get("pattern", "*.pkl"), {}

    def pushFilters(self, filters):
        """Equalities and lists on the columns of the path choose the files; one on field, what is passed on."""
        self.only = {}
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute[0] in ("dataset", "model", "file", "field"):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], values) & values
            yield f

    def partitions(self):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.base) if "://" in self.base or self.base.startswith("file:") else (fs.LocalFileSystem(), self.base)
        out = []
        for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            inner = info.path.removeprefix(base).strip("/")
            if info.type == fs.FileType.File and fnmatch(info.base_name, self.pattern) and not any(x[:1] in "_." for x in inner.split("/")):
                known = dict(zip(("dataset", "model", "file"), _parts(info.path)))
                if all(known[k] in v for k, v in self.only.items() if k != "field"):
                    out.append(_File(info.path, info.size))
        return sorted(out, key=lambda p: p.value) or [_File("", 0)]

    def read(self, partition):
        from pyarrow import fs

        path, size = partition.value
        if not path:
            return
        system = fs.FileSystem.from_uri(self.base)[0] if "://" in self.base or self.base.startswith("file:") else fs.LocalFileSystem()
        opened = lambda: io.BufferedReader(system.open_input_file(path), 1 << 20)
        head, rows, held = [path, *_parts(path), size], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

        for field, index, value in items(opened):
            if "field" in self.only and field not in self.only["field"]:
                continue
            text = as_json(value)
            rows.append([*head, field, index, text])
            held += len(text or "")
            if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class _Writer(DataSourceWriter):
    """Rows (dataset, model, and any others) as pickles under base/dataset/model, at most rows_per_file in each.

    layout "rows": {metadata, data: list of dicts}; "columns": {column: list}. Files get their place when all tasks are done.
    """

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.base, self.prefix, self.layout = options["path"].removeprefix("file://").removeprefix("file:"), options.get("prefix", "pu_"), options.get("layout", "rows")
        self.limit, self.columns, self.job = int(options.get("rows_per_file", 2000)), columns, uuid.uuid4().hex

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.base) if "://" in self.base else (fs.LocalFileSystem(), self.base)

    def write(self, rows):
        system, base = self._system()
        held, files, total = {}, [], 0

        def flush(key):
            dataset, model = key
            data = held.pop(key)
            body = {"metadata": {"dataset_name": dataset, "teacher_model": model}, "data": data} if self.layout == "rows" else {c: [r[c] for r in data] for c in data[0]} | {"dataset_name": dataset, "model_name": model}
            folder = dataset if self.prefix == "traces_" else f"{dataset}/{model}"
            name = f"{self.prefix}{model}.part-{uuid.uuid4().hex[:12]}.pkl" if self.prefix == "traces_" else f"{self.prefix}part-{uuid.uuid4().hex[:12]}.pkl"
            inner = f"{folder}/{name}"
            at = f"{base}/_{self.job}/{inner}"
            system.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(at) as out:
                out.write(pickle.dumps(body, protocol=4))
            files.append(inner)

        for r in rows:
            d = r.asDict(recursive=True)
            key = (d.pop("dataset"), d.pop("model"))
            held.setdefault(key, []).append(d)
            total += 1
            if len(held[key]) >= self.limit:
                total -= len(held[key])
                flush(key)
            elif total >= 20 * self.limit:
                for k in list(held):
                    flush(k)
                total = 0
        for k in list(held):
            flush(k)
        return _Written(files)

    def commit(self, messages):
        system, base = self._system()
        for m in messages:
            for f in m.files:
                system.create_dir(f"{base}/{f}".rsplit("/", 1)[0], recursive=True)
                system.move(f"{base}/_{self.job}/{f}", f"{base}/{f}")
        self.abort(messages)

    def abort(self, messages):
        system, base = self._system()
        from pyarrow import fs

        if system.get_file_info(f"{base}/_{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/_{self.job}")


class PickledArtifacts(DataSource):
    """Options: path, a folder (a URI that pyarrow.fs knows, or a path that all executors see); pattern for file names when
    reading; prefix, layout and rows_per_file when writing."""

    @classmethod
    def name(cls) -> str:
        return "tracemill_artifacts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options), schema.fieldNames())


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to the session, with its filters pushed down."""
    spark.dataSource.register(PickledArtifacts)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
