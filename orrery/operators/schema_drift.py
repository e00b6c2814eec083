"""Problem 3: one consistent table out of files whose fields change, and a report of each change.

Every file's schema is profiled where its records are read; only one small row per file and field is shuffled. Files are
put in order within their stream and each is compared with the one before by :mod:`.schema_trees`; the comparisons run
side by side, since a file's row carries its predecessor's schema. The scripts are compiled into one projection per file
(field -> canonical name), which is joined to the records of that file and applied to them.
"""

from __future__ import annotations

import json
import math
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.schema_trees import MAP_BITS, Values, script, tree
from orrery.plans.cut import cut
from orrery.plans.pointers import follow
from orrery.plans.ranged import carried

CHANGES = "file_id bigint, stream_id string, change_kind string, field_path string, old_path string, old_kind string, new_kind string, cost double"
#: Columns the consistent table may have; more fields than this are an error, not a silent cut.
MAX_COLUMNS = 5000
#: The key of an object under which the field's own value lies; its other members tell more about it.
VALUE_KEY = "value"
#: Words that are cast to boolean by Spark.
YES_NO = frozenset({"true", "false", "yes", "no", "t", "f", "y", "n"})
#: What a number may begin with.
NUMBER_STARTS = frozenset("+-.0123456789")


def kind_of(value) -> str | None:
    """number (whole and decimal), text, boolean, list, object; None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    return {int: "number", float: "number", str: "text", list: "list", dict: "object"}[type(value)]


def single(value):
    """The single value inside a list (its first) or object (that of its value key, else of its least key), else the value itself."""
    while isinstance(value, (list, dict)):
        if isinstance(value, dict):
            value = value[key] if (key := VALUE_KEY if VALUE_KEY in value else min(value, default=None)) is not None else None
        else:
            value = next(iter(value), None)
    return value


def leaf_of(value) -> str | None:
    """Kind of the single value; a text that reads as a number or as yes/no counts as that, and 0 and 1 are a bit, which may be either."""
    value = single(value)
    if isinstance(value, str):
        low = value.strip().lower()
        if low in YES_NO:
            return "boolean"
        if low[:1] not in NUMBER_STARTS:
            return "text"
        try:
            value = float(low)
        except ValueError:
            return "text"
        if not -1e308 < value < 1e308:
            return "text"
    kind = kind_of(value)
    return "bit" if kind == "number" and value in (0, 1) else kind


def _paths(record: dict):
    """(path, value) of every field at any depth."""
    stack = [("", record)]
    while stack:
        above, value = stack.pop()
        for key, v in value.items():
            path = f"{above}\x1f{key}" if above else key
            yield path, v
            if isinstance(v, dict):
                stack.append((path, v))


def _parse(payload):
    try:
        value = json.loads(payload)
    except (TypeError, ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


KINDS, LEAVES = ("boolean", "list", "number", "object", "text"), ("bit", "boolean", "number", "text")
#: Counts of kinds and leaves, the sums of :class:`.schema_trees.Values`, and the map of values in words of 64 bits, as columns.
COUNTS = [f"kind_{k}" for k in KINDS] + [f"leaf_{k}" for k in LEAVES]
SUMS = ["numbers", "total", "squares", "whole", "negative"]
WORDS = [f"seen{i}" for i in range(MAP_BITS // 64)]
STATS = ", ".join(f"{c} {'double' if c in ('total', 'squares') else 'bigint'}" for c in (*COUNTS, *SUMS, *WORDS))
_KIND_AT, _LEAF_AT = {k: i for i, k in enumerate(KINDS)}, {k: len(KINDS) + i for i, k in enumerate(LEAVES)}
_TEXT, _BIT, _NUMBER, _SUMS = _KIND_AT["text"], _LEAF_AT["bit"], _LEAF_AT["number"], len(COUNTS)


def _counted(sums: list, value, texts: dict) -> None:
    """Add a non-null value to [*COUNTS, *SUMS, seen]. ``texts`` remembers what was found of a text."""
    kind = type(value)
    if kind is str:
        sums[_TEXT] += 1
    else:
        sums[_KIND_AT[kind_of(value)]] += 1
        if kind is list or kind is dict:
            value = single(value)
            kind = type(value)
            if value is None:
                return
    if kind is str:
        told = texts.get(value)
        if told is None:
            leaf = leaf_of(value)
            told = texts[value] = leaf, 1 << zlib.crc32(value.encode("utf-8", "surrogatepass")) % MAP_BITS
        sums[_LEAF_AT[told[0]]] += 1
        if told[0] == "text":
            sums[-1] |= told[1]
        if told[0] in ("text", "boolean"):
            return
    elif kind is bool:
        sums[_LEAF_AT["boolean"]] += 1
        return
    else:
        sums[_BIT if value == 0 or value == 1 else _NUMBER] += 1
    try:
        x = float(value)
    except OverflowError:  # a whole number beyond all doubles
        return
    if not math.isfinite(x):
        return
    y = math.asinh(x)
    sums[_SUMS] += 1
    sums[_SUMS + 1] += y
    sums[_SUMS + 2] += y * y
    sums[_SUMS + 3] += x.is_integer()
    sums[_SUMS + 4] += x < 0
    # the hash of a double is the same everywhere
    sums[-1] |= 1 << (hash(x) * 0x9E3779B97F4A7C15 >> 40) % MAP_BITS


def _word(bits: int, i: int) -> int:
    word = bits >> (64 * i) & (2**64 - 1)
    return word - 2**64 if word >= 2**63 else word


def _profile(batches):
    none = [0] * len(COUNTS) + [0, 0.0, 0.0, 0, 0] + [0]
    for batch in batches:
        files: dict[int, dict[str, list]] = {}
        texts: dict[str, tuple] = {}
        for file_id, payload in zip(batch["file_id"].to_pylist(), batch["payload"].to_pylist(), strict=True):
            record = _parse(payload)
            if record is None:
                continue
            fields = files.setdefault(file_id, {"": none})
            for path, v in _paths(record):
                sums = fields.get(path)
                if sums is None:
                    sums = fields[path] = none.copy()
                if v is not None:
                    _counted(sums, v, texts)
        keys = [[i for i, fields in files.items() for _ in fields], [path for fields in files.values() for path in fields]]
        sums = list(zip(*(c for fields in files.values() for c in fields.values()), strict=True)) if files else [[]] * len(none)
        kinds = [pa.int64()] * len(COUNTS) + [pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        maps = [pa.array([_word(b, i) for b in sums[-1]], pa.int64()) for i in range(len(WORDS))]
        cols = [pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.string()), *(pa.array(c, k) for c, k in zip(sums[:-1], kinds, strict=True)), *maps]
        yield pa.RecordBatch.from_arrays(cols, ["file_id", "path", *COUNTS, *SUMS, *WORDS])


#: Records of a file that lie together in one task (a power of two).
TOGETHER = 8192


def records_once(records: DataFrame) -> DataFrame:
    """file_id, record_no, payload: each record once (of different payloads the one of least hash). Rows without file_id or payload are
    left out; of those without record_no only equal payloads are one record.

    A file's records come out side by side, those of a large one in several tasks.
    """
    alone = F.when(F.col("record_no").isNull(), F.sha2("payload", 256))
    part = F.coalesce(F.floor(F.col("record_no") / TOGETHER).cast("bigint"), F.pmod(F.xxhash64("payload"), F.lit(TOGETHER)))
    rows = records.select("file_id", "record_no", "payload").where("file_id IS NOT NULL AND payload IS NOT NULL").withColumns({"_part": part, "_alone": alone})
    w = Window.partitionBy("file_id", "_part", "record_no", "_alone").orderBy(F.xxhash64("payload"))
    return rows.repartition("file_id", "_part").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("file_id", "record_no", "payload")


def profiles(once: DataFrame) -> DataFrame:
    """file_id, path, kind, leaf, values: the fields of each file; path '' stands for the file itself.

    A field is there if any record has its key. Its kind is that of most of its non-null values (at a tie the first in
    alphabetical order), null if it has none. ``values`` are sums over its values, null if it has none. Payloads that are no
    JSON objects are no records.
    """
    counted = once.select("file_id", "payload").mapInArrow(_profile, f"file_id bigint, path string, {STATS}")
    each = counted.groupBy("file_id", "path").agg(*(F.sum(c).alias(c) for c in (*COUNTS, *SUMS)), *(F.bit_or(c).alias(c) for c in WORDS))
    most = lambda kind, names: F.greatest(*(F.when(F.col(f"{kind}_{k}") > 0, F.struct(F.col(f"{kind}_{k}").alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k"))) for i, k in enumerate(names)))["k"]
    found = each.select("file_id", "path", most("kind", KINDS).alias("kind"), most("leaf", LEAVES).alias("leaf"), *SUMS, *WORDS)
    return found.select("file_id", "path", "kind", "leaf", F.when(F.col("leaf").isNotNull(), F.struct(*SUMS, *WORDS)).alias("values"))


def _values(v: dict | None) -> Values:
    if v is None:
        return Values()
    seen = sum((v[w] & (2**64 - 1)) << (64 * i) for i, w in enumerate(WORDS))
    return Values(*(v[c] for c in SUMS), seen)


def _schemas(column: pa.ListArray) -> tuple[list[dict[str, tuple]], pa.StructArray]:
    """Of each file its fields: path -> (kind, leaf, place of its values in the batch), and the values."""
    fields = column.flatten()
    names, values = [fields.field(c).to_pylist() for c in ("path", "kind", "leaf")], fields.field("values")
    ends = column.offsets.to_pylist()
    start = ends[0]
    out = [{names[0][i - start]: (names[1][i - start], names[2][i - start], i - start) for i in range(a, b)} for a, b in zip(ends, ends[1:], strict=False)]
    return out, values


def _tree(own: dict[str, tuple], values: pa.StructArray, other: dict[str, tuple]):
    """The schema; values are looked up only of fields that the other one hasn't."""
    return tree((path, kind, leaf, _values(values[at].as_py()) if path not in other else None) for path, (kind, leaf, at) in own.items())


def _diff(batches):
    names = ["tool", "file_id", "stream_id", "change_kind", "field_path", "old_path", "old_kind", "new_kind", "cost"]
    for batch in batches:
        rows = []
        (olds, old_values), (news, new_values) = _schemas(batch["before"]), _schemas(batch["fields"])
        cols = [batch[c].to_pylist() for c in ("tool", "file_id", "stream_id", "apart")]
        for tool, file_id, stream, apart, before, now in zip(*cols, olds, news, strict=True):
            if before.keys() == now.keys() and all(before[p][0] == k for p, (k, _, _) in now.items()):
                continue
            for e in script(_tree(before, old_values, now), _tree(now, new_values, before), frozenset((p["a"], p["b"]) for p in apart or ())):
                rows.append((tool, file_id, stream, e.change, e.path, e.old_path, e.old_kind, e.new_kind, e.cost))
                if e.change == "renamed" and e.new_kind is None and e.old_kind is not None:
                    # no value in this file: the kind is the last known, that of the old name
                    rows.append((tool, file_id, stream, "inherited", e.path, e.old_path, e.old_kind, e.old_kind, 0.0))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


ORDER = ("written_at", "file_id")


def files_once(files: DataFrame) -> DataFrame:
    """file_id, stream_id, tool, written_at: each file once (the version received last)."""
    w = Window.partitionBy("file_id").orderBy(F.col("received_at").desc_nulls_last(), F.xxhash64("stream_id", "tool", "written_at"))
    return files.select("file_id", "stream_id", "tool", "written_at", "received_at").where("file_id IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("file_id", "stream_id", "tool", "written_at")


def _side_by_side(found: DataFrame, placed: DataFrame) -> DataFrame:
    """file_id, tool, a, b: those renames of names a -> b in ``found`` that can't be, since some file of the tool has both in one
    object."""
    last = lambda c: F.element_at(F.split(c, "\x1f"), -1)
    above = lambda c: F.expr(f"substring({c}, 1, length({c}) - length(substring_index({c}, '\x1f', -1)))")
    renames = found.where("change_kind = 'renamed'").select("file_id", "tool", F.col("old_path").alias("a"), F.col("field_path").alias("b")).where(above("a") == above("b"))
    one = placed.select("tool", F.col("file_id").alias("_in"), F.col("path").alias("a")).join(renames.select("tool", "a", "b").distinct(), ["tool", "a"])
    both = one.join(placed.select(F.col("file_id").alias("_in"), F.col("path").alias("b")), ["_in", "b"], "left_semi").select("tool", "a", "b").distinct()
    return renames.join(both, ["tool", "a", "b"]).select("file_id", "tool", last("a").alias("a"), last("b").alias("b")).distinct()


def _compared(paired: DataFrame, placed: DataFrame) -> DataFrame:
    """The edits (see CHANGES, with tool) of each file of ``paired`` (cut). Files whose cheapest script renames what stands side
    by side elsewhere are compared again without those renames; the others' scripts stay the cheapest."""
    diff = lambda df: df.select("tool", "file_id", "stream_id", "before", "fields", "apart").mapInArrow(_diff, f"tool string, {CHANGES}")
    found = cut(diff(paired.withColumn("apart", F.lit(None).cast("array<struct<a:string,b:string>>"))), "changes")
    wrong = cut(_side_by_side(found, placed), "side-by-side")
    known = wrong
    while wrong.limit(1).count():
        files = wrong.select("file_id").distinct()
        # all that is known of the tool, in one short list per file
        apart = files.join(paired.select("file_id", "tool"), "file_id").join(known.select("tool", "a", "b").distinct(), "tool").groupBy("file_id").agg(F.collect_list(F.struct("a", "b")).alias("apart"))
        again = cut(diff(paired.join(apart, "file_id")), "changes")
        found = cut(found.join(files, "file_id", "left_anti").select(*again.columns).unionByName(again), "changes")
        wrong = cut(_side_by_side(again, placed), "side-by-side")
        known = known.unionByName(wrong)
    return found


def changes(files: DataFrame, profile: DataFrame) -> DataFrame:
    """One row per edit of each file against the nearest earlier one with records in its stream (see CHANGES).

    A field's kind is that of its values in the file or, without any, the last known in its stream, through renames. Two names
    that stand side by side in any file of the tool are no renames of one another. Files without stream_id or written_at have
    no order and no changes. The first file of a stream has no changes.
    """
    ordered = files.where("stream_id IS NOT NULL AND written_at IS NOT NULL").withColumn("tool", F.coalesce("tool", F.lit("")))
    placed = cut(profile.join(ordered, "file_id").select("tool", "stream_id", "written_at", "file_id", "path", "kind", "leaf", "values"), "profiles")
    told = result = None
    part = placed
    while True:
        known = part if told is None else part.join(told, ["file_id", "path"], "left").withColumn("kind", F.coalesce("kind", "_told")).drop("_told")
        known = carried(known, ["stream_id", "path"], ORDER, {"kind": "kind", "leaf": "leaf", "values": "values"}, current=True)
        # one short list per file: its fields
        per_file = known.groupBy("tool", "stream_id", "written_at", "file_id").agg(F.collect_list(F.when(F.col("path") != "", F.struct("path", "kind", "leaf", "values"))).alias("fields"))
        per_file = per_file.withColumn("fields", F.sort_array("fields"))
        paired = cut(carried(per_file, ["stream_id"], ORDER, {"fields": "before"}, current=False).where("before IS NOT NULL"), "paired")
        found = _compared(paired, placed)
        result = found if result is None else cut(result.join(part.select("stream_id").distinct(), "stream_id", "left_anti").select(*found.columns).unionByName(found), "changes")
        more = cut(found.where("change_kind = 'inherited'").select("stream_id", "file_id", F.col("field_path").alias("path"), F.col("new_kind").alias("_told")).distinct(), "inherited")
        if not more.limit(1).count():
            return result.where("change_kind <> 'inherited'").drop("tool")
        # only the streams where a kind went on under another name are looked at again
        part = placed.join(more.select("stream_id").distinct(), "stream_id", "left_semi")
        told = more.select("file_id", "path", "_told") if told is None else more.select("file_id", "path", "_told").unionByName(told).distinct()


def found_changes(files: DataFrame, records: DataFrame) -> DataFrame:
    """file_id, change_kind, field_name: the changes of top-level fields that are added, removed, renamed or retyped.

    field_name is the name in that file, for removed the old one. A field that goes into an object is removed, one that comes
    out of an object is added. Handles nulls, empty files, repeated records and files,
    unreadable payloads and empty tables as said in the functions above; other columns are ignored.
    """
    report = changes(files_once(files), profiles(records_once(records)))
    edits = report.where("change_kind IN ('added', 'removed', 'renamed', 'retyped')").select("file_id", "change_kind", F.col("field_path").alias("field_name"))
    moved = report.where("change_kind = 'moved'")
    for kind, path in (("removed", "old_path"), ("added", "field_path")):
        edits = edits.unionByName(moved.select("file_id", F.lit(kind).alias("change_kind"), F.col(path).alias("field_name")))
    return edits.where("instr(field_name, '\x1f') = 0").distinct()


def projections(files: DataFrame, profile: DataFrame, report: DataFrame) -> DataFrame:
    """file_id, field_name, canonical: the column that each top-level field of each file goes to.

    It is the name under which the field came into its stream, before all renames since. A field that went and came again
    starts anew under its own name; a file without stream keeps its names. If two fields of a file would go to one column,
    the later one keeps its own name.
    """
    # a file without a time has no place in its stream: it keeps its names
    files = files.withColumn("stream_id", F.when(F.col("written_at").isNotNull(), F.col("stream_id")))
    placed = profile.where("path <> '' AND instr(path, '\x1f') = 0").join(files, "file_id").select("stream_id", "written_at", "file_id", F.col("path").alias("name"))
    when = files.select("file_id", "written_at")
    top = report.where("instr(field_path, '\x1f') = 0")
    starts = top.where("change_kind IN ('added', 'renamed', 'moved')").join(when, "file_id").select("stream_id", "written_at", "file_id", F.col("field_path").alias("name"), F.when(F.col("change_kind") == "renamed", F.col("old_path")).alias("old"))
    first = placed.where("stream_id IS NOT NULL").groupBy("stream_id", "name").agg(F.min(F.struct("written_at", "file_id")).alias("at")).select("stream_id", "at.written_at", "at.file_id", "name", F.lit(None).cast("string").alias("old"))
    begun = starts.unionByName(first.join(starts.select("stream_id", "file_id", "name"), ["stream_id", "file_id", "name"], "left_anti"))
    begun = cut(begun.withColumn("node", F.xxhash64("stream_id", "file_id", "name")), "begun")
    steps = [*ORDER, "rank"]
    marks = begun.select("stream_id", "written_at", "file_id", "name", F.col("node").alias("mark"), F.lit(1).alias("rank"), F.lit(None).cast("bigint").alias("asks"))
    # the old name of a rename is looked up just before the file
    asks = begun.where("old IS NOT NULL").select("stream_id", "written_at", "file_id", F.col("old").alias("name"), F.lit(None).cast("bigint").alias("mark"), F.lit(0).alias("rank"), F.col("node").alias("asks"))
    answered = carried(marks.unionByName(asks), ["stream_id", "name"], steps, {"mark": "mark"}, current=True).where("asks IS NOT NULL").select(F.col("asks").alias("node"), F.col("mark").alias("to"))
    roots = follow(cut(begun.select("node").join(answered, "node", "left"), "chain"), "node", "to", "root").join(begun.select(F.col("node").alias("root"), F.col("name").alias("canonical")), "root").select("node", "canonical")
    use = placed.where("stream_id IS NOT NULL").select("stream_id", "written_at", "file_id", "name", F.lit(None).cast("bigint").alias("mark"), F.lit(2).alias("rank"), F.lit(1).cast("bigint").alias("asks"))
    owned = carried(marks.unionByName(use), ["stream_id", "name"], steps, {"mark": "mark"}, current=True).where("asks IS NOT NULL").select("file_id", "name", F.col("mark").alias("node"))
    named = owned.join(roots, "node", "left").select("file_id", F.col("name").alias("field_name"), F.coalesce("canonical", "name").alias("canonical"))
    named = named.unionByName(placed.where("stream_id IS NULL").select("file_id", F.col("name").alias("field_name"), F.col("name").alias("canonical")))
    nth = F.row_number().over(Window.partitionBy("file_id", "canonical").orderBy((F.col("field_name") != F.col("canonical")).cast("int"), "field_name"))
    return named.withColumn("_n", nth).select("file_id", "field_name", F.when(F.col("_n") == 1, F.col("canonical")).otherwise(F.col("field_name")).alias("canonical"))


def _as_text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return repr(value) if isinstance(value, (int, float)) else json.dumps(value)


def _members(column: str, value, wide: frozenset[str]):
    """(column, value) pairs of a field. Lists and objects of one are unwrapped, the value key of an object stands for the
    field, other members get columns of their own (joined by U+001F), at any depth. An object of one key is no wrapping if
    ``wide`` says that there are other keys in its place."""
    stack = [(column, value, column)]
    while stack:
        at, v, path = stack.pop()
        while isinstance(v, (list, dict)) and len(v) == 1 and not (isinstance(v, dict) and path in wide):
            if isinstance(v, dict):
                ((key, v),) = v.items()
                path = f"{path}\x1f{key}"
            else:
                v = v[0]
        if not isinstance(v, dict) or not v:
            yield at, None if v == {} else v
            continue
        for key, member in v.items():
            # an object under the value key is a member like any other
            own = key == VALUE_KEY and not isinstance(member, dict)
            stack.append((at if own else f"{at}\x1f{key}", member, f"{path}\x1f{key}"))


def _row(payload, fields, wide: frozenset[str]):
    """(column, value) pairs of a record."""
    to = dict(fields or [])
    for name, v in (_parse(payload) or {}).items():
        yield from _members(to.get(name, name), v, wide)


def _columns(wide: frozenset[str]):
    def run(batches):
        for batch in batches:
            seen: dict[tuple, int] = {}
            for file_id, payload, fields in zip(*(batch[c].to_pylist() for c in ("file_id", "payload", "fields")), strict=True):
                for key, v in _row(payload, ((f["field_name"], f["canonical"]) for f in fields or []), wide):
                    at = (file_id, key, "text" if isinstance(v, list) else leaf_of(v))
                    seen[at] = seen.get(at, 0) + 1
            cols = list(zip(*seen, strict=True)) if seen else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:]), pa.array(list(seen.values()), pa.int64())], ["file_id", "key", "leaf", "n"])

    return run


def _project(wide: frozenset[str]):
    def run(batches):
        for batch in batches:
            out = []
            for payload, fields in zip(batch["payload"].to_pylist(), batch["fields"].to_pylist(), strict=True):
                row = {key: _as_text(v) for key, v in _row(payload, ((f["field_name"], f["canonical"]) for f in fields or []), wide)}
                out.append(list(row.items()))
            yield pa.RecordBatch.from_arrays([batch["file_id"], batch["record_no"], pa.array(out, pa.map_(pa.string(), pa.string()))], ["file_id", "record_no", "row"])

    return run


#: Columns of the consistent table that are no fields; the last has what fits no column.
LEAD, UNFIT = ("file_id", "record_no", "stream_id", "tool"), "unfit_values"


def _names(keys: list[str]) -> dict[str, str]:
    """key -> column name. A member's path is joined by '_'; a name already taken, in any case, gets a number."""
    taken, out = {*LEAD, UNFIT}, {}
    for key in sorted(keys, key=lambda k: ("\x1f" in k, k)):
        name = f"field_{key}" if key in (*LEAD, UNFIT) else key.replace("\x1f", "_")
        free, n = name, 2
        while free.lower() in taken:
            free, n = f"{name}_{n}", n + 1
        taken.add(free.lower())
        out[key] = free
    return out


def _bounded(rows: DataFrame) -> list:
    """At most as many rows as the table may have columns."""
    found = rows.limit(MAX_COLUMNS + 1).collect()
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} different fields")
    return found


def consistent_table(files: DataFrame, records: DataFrame) -> DataFrame:
    """file_id, record_no, stream_id, tool, one typed column per canonical field and unfit_values, for every record of every file.

    A column is double or boolean if most files hold such values in it, else string. Wrapped single values (a list of one, an
    object of one key, an object's value key) are unwrapped, an object's other members have columns of their own, named
    field_member; longer lists are JSON texts. A stray value that doesn't fit the column's type is null there and stands in
    unfit_values, a JSON object of column -> value as text (null if all fit). Fields named like the five other columns get
    the prefix ``field_``.
    """
    once = cut(records_once(records), "records")
    profile = cut(profiles(once), "profile")
    meta = cut(files_once(files), "files")
    plan = cut(projections(meta, profile, changes(meta, profile)), "projections")
    # the places where objects have more than one key in all, by canonical name
    nested = profile.where("instr(path, '\x1f') > 0").withColumn("field_name", F.substring_index("path", "\x1f", 1)).join(plan, ["file_id", "field_name"])
    nested = nested.select(F.concat("canonical", F.expr("substring(path, length(field_name) + 1)")).alias("path"))
    above = F.expr("substring_index(path, '\x1f', size(split(path, '\x1f')) - 1)")
    wide = frozenset(r.above for r in _bounded(nested.distinct().groupBy(above.alias("above")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("above")))
    mapping = plan.groupBy("file_id").agg(F.collect_list(F.struct("field_name", "canonical")).alias("fields"))
    joined = once.join(mapping, "file_id", "left").select("file_id", "record_no", "payload", "fields")
    counted = joined.mapInArrow(_columns(wide), "file_id bigint, key string, leaf string, n bigint").groupBy("file_id", "key", "leaf").agg(F.sum("n").alias("n"))
    in_file = counted.groupBy("file_id", "key").agg(F.min(F.when(F.col("leaf").isNotNull(), F.struct((-F.col("n")).alias("n"), "leaf")))["leaf"].alias("leaf"))
    kinds = in_file.groupBy("key", "leaf").agg(F.count("leaf").alias("n"))
    columns = {r.key: r.leaf for r in _bounded(kinds.groupBy("key").agg(F.max(F.struct("n", "leaf"))["leaf"].alias("leaf")))}
    names = _names(list(columns))
    rows = joined.mapInArrow(_project(wide), "file_id bigint, record_no int, row map<string,string>")
    kind = {"number": "double", "bit": "double", "boolean": "boolean"}
    fields = [F.expr(f"try_cast(row[{_quoted(k)}] AS {kind.get(columns[k], 'string')})").alias(name) for k, name in names.items()]
    unfit = F.lit(None).cast("string")
    if typed := [k for k in names if columns[k] in kind]:
        # array_contains over literals, not one expression per column
        of = {t: "array(" + ", ".join(_quoted(k) for k in typed if kind[columns[k]] == t) + ")" for t in ("double", "boolean")}
        stray = " OR ".join(f"array_contains({keys}, k) AND try_cast(v AS {t}) IS NULL" for t, keys in of.items() if keys != "array()")
        named = f"map_from_arrays(array({', '.join(map(_quoted, typed))}), array({', '.join(_quoted(names[k]) for k in typed)}))"
        bad = f"array_sort(transform(filter(map_entries(row), e -> e.value IS NOT NULL AND exists(array(e.key), k -> exists(array(e.value), v -> {stray}))), e -> struct({named}[e.key] AS key, e.value AS value)))"
        unfit = F.expr(f"CASE WHEN size({bad}) > 0 THEN to_json(map_from_entries({bad})) END")
    return rows.join(meta.select("file_id", "stream_id", "tool"), "file_id", "left").select(*LEAD, *fields, unfit.alias(UNFIT))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
