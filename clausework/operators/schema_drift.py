"""Schemas that drift between files of newline-delimited JSON records.

The records are parsed once and reduced to counts for each (file, field, type, token); these counts
are written, and headers, profiles and renames are derived from them. Headers, one row for each file, lie in the
order of time in range partitions; what passes from one partition to the next is one header each, so that a site
with a third of all files is as many tasks as its files need. The union schema folds the kinds of values that were
met through a lattice of promotions, and a projection of the records casts each file to it.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: What a kind of value can be cast to. Kinds of text that only look like a number or a truth value are cast so
#: beside real ones: a column of such texts alone stays text.
PROMOTIONS = {
    "boolean": ("boolean", "whole", "decimal", "string"),
    "whole": ("whole", "decimal", "string"),
    "decimal": ("decimal", "string"),
    "flag": ("boolean", "whole", "decimal", "string"),
    "digits": ("whole", "decimal", "string"),
    "coded": ("whole", "decimal", "string"),
    "fraction": ("decimal", "string"),
    "array": ("array", "string"),
    "object": ("string",),
    "string": ("string",),
}
#: Types of columns from the narrowest to the widest, with their types in the table.
TYPES = {"boolean": "boolean", "whole": "bigint", "decimal": "double", "array": "array<string>", "string": "string"}
FIRM = ("boolean", "whole", "decimal", "array", "string", "object")
#: Fields of an object that carry its value, the first that is there.
CARRIERS = ("id", "code", "label", "value", "name", "text")
#: A new field carries a gone one's content from this score on (see :func:`rename_pairs`).
RENAME_SCORE = 0.6
#: Weight of the likeness of names against the likeness of contents.
NAME_WEIGHT = 0.35
#: Values whose likeness counts as much as that of the names; with more of them the contents decide.
PRIOR_VALUES = 1.0
#: Lines of one file that are grouped in one task.
FILE_BLOCK = 20_000
KEY = ["site", "table_name", "file_name"]
ORDER = ["site", "table_name", "at", "file_name"]


def _opened(text: Column) -> Column:
    """The text of a value with one wrapping opened: a one-element array, a one-field object or a carrier of a value."""
    carried = F.coalesce(*(F.get_json_object(text, f"$.{name}") for name in CARRIERS), F.nullif(F.regexp_extract(text, r'^\{"[^"]*":("?)(.*)\1\}$', 2), F.lit("")), text)
    element = F.when(F.json_array_length(text) == 1, F.get_json_object(text, "$[0]")).otherwise(text)
    return F.when(text.startswith("{") & text.endswith("}"), carried).when(text.startswith("["), element).otherwise(text)


def _bare(opened: Column, is_number: Column) -> Column:
    """The opened value in lower case, a number without the letters that lead it, truth as 1 or 0."""
    text = F.lower(F.trim(opened))
    code = F.regexp_replace(text, r"^[a-z]{1,5}[-_#:]0*(\d+)$", "$1")
    return F.when(is_number, opened).when(text.isin("true", "yes"), "1").when(text.isin("false", "no"), "0").when(F.length(text) <= 32, code).otherwise(text)


_NUMBER = re.compile(r"-?\d+(\.\d+)?", re.ASCII)
_WHOLE = re.compile(r"-?\d+(\.0+)?", re.ASCII)
_CODED = re.compile(r"[a-z]{1,5}[-_#:]0*(\d+)", re.ASCII)
_CODE_IN_TEXT = re.compile(r"\b(?=[a-z]*\d)(?=\d*[a-z])[a-z0-9]{5,}\b", re.ASCII)
_DIGITS = re.compile(r"\d+", re.ASCII)
_TRUTH = {"true": "1", "yes": "1", "false": "0", "no": "0"}
_OPENED_KINDS = {bool: "flag", int: "digits", float: "fraction"}


def _open(value: object) -> object:
    """A parsed value with one wrapping opened, as :func:`_opened` does with its text."""
    if isinstance(value, list) and len(value) == 1:
        return value[0]
    if isinstance(value, dict):
        for name in CARRIERS:
            if value.get(name) is not None:
                return value[name]
        if len(value) == 1:
            return next(iter(value.values()))
    return value


def _number_token(x: float) -> str:
    """Small whole numbers as they are, other numbers by magnitude."""
    if x != math.floor(x):
        return f"f{math.floor(math.log2(abs(x) + 1e-9) * 2)}"
    return str(int(x)) if abs(x) < 32 else f"n{math.floor(math.log2(abs(x) + 1) * 2)}"


def _of_text(text: str) -> tuple[str, float | None, str]:
    """(kind, number or None, token) of a text; words with numbers and codes in them are masked."""
    bare = text.strip().lower()
    if _NUMBER.fullmatch(bare) and len(bare) < 300:
        return ("digits" if _WHOLE.fullmatch(bare) else "fraction"), float(bare), _number_token(float(bare))
    if m := _CODED.fullmatch(bare):
        return "coded", float(m[1]), _number_token(float(m[1]))
    if bare in _TRUTH:
        return "flag", float(_TRUTH[bare]), _TRUTH[bare]
    masked = _DIGITS.sub("#", _CODE_IN_TEXT.sub("<code>", bare)) if _DIGITS.search(bare) else bare
    if len(masked) > 64:
        masked = masked[:24] + hashlib.blake2b(masked.encode("utf-8", "replace"), digest_size=8).hexdigest()
    return "string", None, masked.encode("utf-8", "replace").decode()


class _Values:
    """Describes parsed values; those that come again are described once."""

    def __init__(self):
        self.known: dict[tuple, tuple] = {}
        self.texts: dict[str, tuple] = {}
        self.numbers: dict[int, tuple] = {}

    def describe(self, value: object) -> tuple[tuple, float | None]:
        """((JSON type, kind, is a number, token), number); a null has none of them."""
        kind = type(value)
        if kind is str:
            found = self.texts.get(value)
            if found is None:
                found = self._kept(self.texts, value, self._described(value))
            return found
        if kind is int:
            found = self.numbers.get(value)
            if found is None:
                found = self._kept(self.numbers, value, self._described(value))
            return found
        return self._described(value)

    def _kept(self, memory: dict, value: object, found: tuple) -> tuple:
        if len(memory) >= 50_000:
            memory.clear()
        memory[value] = found
        return found

    def _described(self, value: object) -> tuple[tuple, float | None]:
        json_type, kind, number, token = self._parts(value)
        key = (json_type, kind, number is not None, token)
        return self.known.setdefault(key, key) if len(self.known) < 50_000 else key, number

    def _parts(self, value: object) -> tuple[str | None, str | None, float | None, str | None]:
        if isinstance(value, str):
            return "string", *_of_text(value)
        if value is None:
            return None, None, None, None
        if isinstance(value, bool):
            return "boolean", "boolean", float(value), str(int(value))
        if isinstance(value, int | float):
            x = float(value) if abs(value) < 1e300 else None
            whole = isinstance(value, int)
            # a number without a fraction is whole, however it was written
            kind = "whole" if whole or value.is_integer() else "decimal"
            return ("whole" if whole else "decimal"), kind, x, _number_token(x) if x is not None else "large"
        json_type = "array" if isinstance(value, list) else "object"
        inner = _open(_open(value))
        if isinstance(inner, str):
            return json_type, *_of_text(inner)
        if isinstance(inner, list | dict):
            return json_type, ("array" if isinstance(inner, list) else "object"), None, _of_text(json.dumps(inner, ensure_ascii=False, sort_keys=True))[2]
        if inner is None:
            return json_type, "string", None, ""
        return json_type, _OPENED_KINDS[type(inner)], *self._parts(inner)[2:]


class _Field:
    """What a file's block says of one field: counts of the descriptions, and the numbers."""

    __slots__ = ("counts", "numbers")

    def __init__(self):
        self.counts: dict[tuple, int] = {}
        self.numbers: list[float] = []

    def counts_upwards(self) -> bool:
        """True for numbers that hardly come again and lie close."""
        n = sum(k for described, k in self.counts.items() if described[0] is not None)
        return n > 1 and len(self.numbers) == n and max(self.numbers) - min(self.numbers) <= 3 * n and len(set(self.numbers)) >= 0.8 * n


_COUNTS = pa.schema(
    [("site", pa.string()), ("table_name", pa.string()), ("file_name", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("field", pa.string())]
    + [("json_type", pa.string()), ("kind", pa.string()), ("is_number", pa.bool_()), ("token", pa.string()), ("n", pa.int64())]
)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def count_values(lines: DataFrame) -> DataFrame:
    """Counts of the values of each (file, block of lines, field, type, kind, token), written once.

    ``lines``: ``file_name``, ``site``, ``table_name``, ``exported_at``, ``line_no``, ``record``. The rows move once,
    as they are, sorted to the task of their file and block of ``FILE_BLOCK`` lines, and are parsed and counted there
    as they come; a file with a third of all lines is as many tasks as it has blocks. Numbers that count upwards
    within a block are one token: their size says nothing. Values are described in Python: with expressions on variants
    the whole report took 1508 CPU seconds a GB (check tool), so 881.
    """
    block = F.coalesce(F.floor(F.col("line_no") / FILE_BLOCK), F.lit(0)).cast("bigint").alias("block")
    at = F.unix_micros(F.col("exported_at").cast("timestamp")).alias("at")
    rows = lines.where("site is not null and table_name is not null and file_name is not null and record is not null")
    moved = rows.select(*KEY, block, at, "record").repartition(*KEY, "block").sortWithinPartitions(*KEY, "block")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describe = _Values().describe

        def made() -> Iterator[tuple]:
            key, first, fields, n_records = None, None, {}, 0

            def flush() -> Iterator[tuple]:
                for name, field in fields.items():
                    counts: Counter[tuple] = Counter()
                    upwards = field.counts_upwards()
                    for (json_type, kind, is_number, token), n in field.counts.items():
                        counts[json_type, kind, is_number, "<sequence>" if upwards and is_number else token] += n
                    written = name.encode("utf-8", "replace").decode()
                    for described, n in counts.items():
                        yield *key, first, written, *described, n

            for batch in batches:
                for *here, at, record in zip(*(batch[c].to_pylist() for c in (*KEY, "block", "at", "record")), strict=True):
                    if key != here or n_records == 4 * FILE_BLOCK:  # lines without a number may be more than a block
                        yield from flush()
                        key, first, fields, n_records = here, None, {}, 0
                    n_records += 1
                    try:
                        parsed = json.loads(record, parse_constant=_no_constant)
                    except (ValueError, RecursionError):
                        continue
                    if not isinstance(parsed, dict):
                        continue
                    if at is not None and (first is None or at < first):
                        first = at
                    for name, value in parsed.items():
                        field = fields.get(name)
                        if field is None:
                            field = fields[name] = _Field()
                        described, number = describe(value)
                        field.counts[described] = field.counts.get(described, 0) + 1
                        if number is not None:
                            field.numbers.append(number)
            yield from flush()

        yield from _batches(made(), _COUNTS)

    names = {"int64": "bigint", "bool": "boolean", "string": "string"}
    return cut(moved.mapInArrow(count, ", ".join(f"{f.name} {names[str(f.type)]}" for f in _COUNTS)))


def _words(name: Column) -> Column:
    snake = F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))
    return F.array_distinct(F.filter(F.split(snake, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0))


def _name_likeness(a: Column, b: Column) -> Column:
    """1 for the same words in any case or style, else the shared words' part or the edit likeness of the joined words."""
    wa, wb = _words(a), _words(b)
    shared = F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(F.array_union(wa, wb)), F.lit(1))
    ja, jb = F.array_join(wa, ""), F.array_join(wb, "")
    edit = 1 - F.levenshtein(ja, jb) / F.greatest(F.length(ja), F.length(jb), F.lit(1))
    inside = F.when(ja.contains(jb) | jb.contains(ja), F.lit(0.6)).otherwise(F.lit(0.0))
    return F.greatest(shared, F.when(edit > 0.5, edit).otherwise(F.lit(0.0)), inside)


def _in_order(files: DataFrame) -> DataFrame:
    """The files in range partitions by site, table and time, with ``block``, the number of the partition; written once."""
    return cut(files.repartitionByRange(*(F.col(c) for c in ORDER)).sortWithinPartitions(*ORDER).withColumn("block", F.spark_partition_id()))


def file_headers(counts: DataFrame) -> DataFrame:
    """One row for each file, in order: ``fields``, the pairs (field, JSON type or null) of its header, and ``block``."""
    files = counts.groupBy(*KEY).agg(F.min("at").alias("at"), F.array_sort(F.collect_set(F.struct("field", "json_type"))).alias("fields"))
    return _in_order(files)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _carried(blocks: dict[int, dict], before: dict | None = None) -> dict[int, dict]:
    """For each block the state in which the one before it ends. ``blocks``: what :func:`_fold` says of each alone.

    A field whose types a block does not know takes them from the state before the block.
    """
    out, state = {}, before
    for block in sorted(blocks):
        out[block] = state
        end = blocks[block]
        fields = {}
        for name, types, origin in end["fields"]:
            if types is None and origin is not None and state is not None and (state["site"], state["table_name"]) == (end["site"], end["table_name"]):
                types = state["fields"].get(origin)
            fields[name] = tuple(types) if types is not None else None
        state = {"site": end["site"], "table_name": end["table_name"], "fields": fields}
    return out


def _ends(ordered: DataFrame, step) -> dict[int, dict]:
    """The last state of each block, gathered on the driver: one header for each partition of the files."""
    schema = pa.schema([("block", pa.int32()), ("site", pa.string()), ("table_name", pa.string()), ("fields", pa.list_(pa.struct([("name", pa.string()), ("types", pa.list_(pa.string())), ("origin", pa.string())])))])

    def last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = None
        for end in step(_rows(batches)):
            pass
        if end is not None:
            yield from _batches([end], schema)

    found = ordered.mapInArrow(last, "block int, site string, table_name string, fields array<struct<name: string, types: array<string>, origin: string>>").collect()
    return {r["block"]: {"site": r["site"], "table_name": r["table_name"], "fields": [tuple(f) for f in r["fields"]]} for r in found}


def _header(r: dict) -> dict[str, tuple[str, ...]]:
    """The fields of a file with their JSON types, sorted."""
    out: dict[str, tuple[str, ...]] = {}
    for f in r["fields"]:
        out[f["field"]] = (*out.get(f["field"], ()), *((f["json_type"],) if f["json_type"] else ()))
    return out


def _name_ends(rows: Iterator[dict]) -> Iterator[tuple]:
    for r in rows:
        yield r["block"], r["site"], r["table_name"], [{"name": n, "types": None, "origin": None} for n in _header(r)]


def step_pairs(ordered: DataFrame) -> DataFrame:
    """(site, table_name, file_name, field, new_field): each field gone since the file before with each new field of the file."""
    sent = ordered.sparkSession.sparkContext.broadcast(_carried(_ends(ordered, _name_ends)))
    schema = pa.schema([(c, pa.string()) for c in (*KEY, "field", "new_field")])

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            key, names = None, set()
            for i, r in enumerate(_rows(batches)):
                if i == 0 and (before := sent.value.get(r["block"])):
                    key, names = (before["site"], before["table_name"]), set(before["fields"])
                here = set(_header(r))
                if key == (r["site"], r["table_name"]):
                    for gone in sorted(names - here):
                        for new in sorted(here - names):
                            yield r["site"], r["table_name"], r["file_name"], gone, new
                key, names = (r["site"], r["table_name"]), here

        yield from _batches(made(), schema)

    return ordered.mapInArrow(pairs, ", ".join(f"{f.name} string" for f in schema))


def rename_pairs(counts: DataFrame, pairs: DataFrame, score: float = RENAME_SCORE) -> DataFrame:
    """(site, table_name, file_name, field, new_field): a field that is gone and the new field that carries its content.

    Candidates are only the gone and the new fields of one file. A pair scores the likeness of contents – the overlap
    of both names' token shares over the whole journal, of the kind of value (number or text) in which they agree
    best – raised by the likeness of the names. Few values say little: the content's weight is m / (m +
    ``PRIOR_VALUES``), m being the smaller number of values, and the names have the rest. Pairs are taken from the
    best score down, ties by name, until no gone and new field of the file are left that match.
    """
    key = ["table_name", "field", "new_field"]
    sides = pairs.select(*key).distinct().withColumn("side", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("name", F.when(F.col("side") == "a", F.col("field")).otherwise(F.col("new_field")))
    profile = counts.where("json_type is not null").groupBy("table_name", F.col("field").alias("name"), "is_number", "token").agg(F.sum("n").alias("n"))
    met = (
        profile.join(sides, ["table_name", "name"])
        .groupBy(*key, "is_number", "token")
        .agg(*(F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(s) for s in "ab"))
    )
    of_kind = Window.partitionBy(*key, "is_number")
    shares = met.withColumns({f"n_{s}": F.sum(s).over(of_kind) for s in "ab"})
    m = F.least("n_a", "n_b")
    kinds = shares.groupBy(*key, "is_number").agg(F.sum(F.coalesce(F.least(F.try_divide("a", "n_a"), F.try_divide("b", "n_b")), F.lit(0.0))).alias("likeness"), F.max(m / (m + PRIOR_VALUES)).alias("sure"))
    content = kinds.groupBy(*key).agg(F.max_by(F.struct("likeness", "sure"), F.struct(F.col("likeness") * F.col("sure"), "sure")).alias("best"))
    names = _name_likeness(F.col("field"), F.col("new_field"))
    by_content = F.when(F.col("best.likeness") < 0.25, 0.0).otherwise(F.col("best.likeness") + NAME_WEIGHT * names)
    scored = content.select(*key, (F.col("best.sure") * by_content + (1 - F.col("best.sure")) * names).alias("score")).where(F.col("score") >= score)
    rows = pairs.join(scored, key).select(*KEY, "field", "new_field", "score")
    return rows.groupBy(*KEY).applyInArrow(_assign, rows.schema)


def _assign(pairs: pa.Table) -> pa.Table:
    """The pairs of one file taken from the best score down, each field once; what is left free meets again."""
    pairs = pairs.sort_by([("score", "descending"), ("field", "ascending"), ("new_field", "ascending")])
    gone, new, kept = set(), set(), []
    for i, (a, b) in enumerate(zip(pairs["field"].to_pylist(), pairs["new_field"].to_pylist(), strict=True)):
        if a not in gone and b not in new:
            gone.add(a)
            new.add(b)
            kept.append(i)
    return pairs.take(pa.array(kept, pa.int64()))


def _step(r: dict, state: dict[str, tuple] | None) -> tuple[list[tuple[str, str, str]], dict[str, tuple]]:
    """(changes, state) of a file after the one that left ``state``: field -> (types, field of the unknown state before)."""
    old_name = {x["new_field"]: x["field"] for x in r["renames"] or ()}
    changes, now = [], {}
    for field, types in _header(r).items():
        old = old_name.get(field, field)
        if state is not None and old in state:
            before, origin = state[old]
            if old != field:
                changes.append((old, field, "renamed"))
            if types and before and types != before:
                changes.append((old, field, "type_changed"))
            now[field] = (types, None) if types else (before, origin)
        else:
            if state is not None:
                changes.append((field, field, "added"))
            now[field] = (types or None, None)
    taken = set(old_name.values())
    changes += [(field, field, "removed") for field in state or () if field not in now and field not in taken]
    return changes, now


def schema_changes(ordered: DataFrame, renames: DataFrame) -> DataFrame:
    """The ordered log of changes: site, table_name, file_name, exported_at, field, new_field, change.

    A fold over the files of each site and table in order. It runs twice: the first time each range partition folds
    its files alone and says how it ends (one header), with the fields whose types only the partition before knows;
    with these joined up, the second run gives the log. A file without a non-null value of a field keeps the types
    it had before, through renames too.
    """
    pairs = renames.groupBy(*KEY).agg(F.collect_list(F.struct("field", "new_field")).alias("renames"))
    files = _in_order(ordered.drop("block").join(pairs, KEY, "left"))
    context = files.sparkSession.sparkContext
    before = context.broadcast({b: x and {**x, "fields": list(x["fields"])} for b, x in _carried(_ends(files, _name_ends)).items()})

    def alone(rows: Iterator[dict]) -> Iterator[tuple]:
        key, state = None, None
        for i, r in enumerate(rows):
            if i == 0 and (known := before.value.get(r["block"])):
                key, state = (known["site"], known["table_name"]), {name: (None, name) for name in known["fields"]}
            mine = (r["site"], r["table_name"])
            _, state = _step(r, state if key == mine else None)
            key = mine
            yield r["block"], *mine, [{"name": n, "types": t, "origin": o} for n, (t, o) in state.items()]

    starts = context.broadcast(_carried(_ends(files, alone)))
    schema = pa.schema([("site", pa.string()), ("table_name", pa.string()), ("file_name", pa.string()), ("at", pa.int64()), *((c, pa.string()) for c in ("field", "new_field", "change"))])

    def log(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            key, state = None, None
            for i, r in enumerate(_rows(batches)):
                if i == 0 and (known := starts.value.get(r["block"])):
                    key, state = (known["site"], known["table_name"]), {n: (t, None) for n, t in known["fields"].items()}
                mine = (r["site"], r["table_name"])
                changes, state = _step(r, state if key == mine else None)
                key = mine
                for c in changes:
                    yield *mine, r["file_name"], r["at"], *c

        yield from _batches(made(), schema)

    found = files.mapInArrow(log, "site string, table_name string, file_name string, at bigint, field string, new_field string, change string")
    return found.select(*KEY, F.timestamp_micros("at").alias("exported_at"), "field", "new_field", "change")


class Drift:
    """The counts, ordered files and renames of exported records."""

    def __init__(self, lines: DataFrame):
        self.lines = lines
        self.counts = count_values(lines)
        self.files = file_headers(self.counts)
        self.renames = rename_pairs(self.counts, cut(step_pairs(self.files))).drop("score")

    def changes(self) -> DataFrame:
        return schema_changes(self.files, self.renames)


def drift_report(lines: DataFrame) -> DataFrame:
    """Every change between a file and the file before it of the same site and table.

    ``lines``: ``file_name``, ``site``, ``table_name``, ``exported_at``, ``line_no``, ``record``. Nulls and broken
    records are passed over, repeated lines change nothing, an empty table gives an empty report, further columns
    are ignored. A file none of whose records is valid takes no part, nor does a row with a null site, table or
    file name; of several times of one file the earliest counts, files without a time come first.
    """
    return Drift(lines).changes()


def canonical_names(drift: Drift) -> DataFrame:
    """(table_name, field, column): the names of one field across all sites and files under the most frequent of them.

    Names are linked by the renames found, the most frequent rename first, and by the same words in another style;
    two names that stand in one header together are two fields and never linked. One group holds the names of one
    table and the different pairs of names of its headers: it grows with the schema, not with files or records.
    """
    counts = drift.counts.groupBy("table_name", "field").agg(F.sum("n").alias("n"))
    links = drift.renames.groupBy("table_name", F.col("field").alias("a"), F.col("new_field").alias("b")).agg(F.count("*").alias("n"))
    header = F.col("header")
    headers = drift.files.select("table_name", F.array_distinct(F.transform("fields", lambda f: f["field"])).alias("header")).distinct()
    pairs = headers.select("table_name", F.explode(F.transform(header, lambda x: F.struct(x.alias("a"), header.alias("others")))).alias("p")).select("table_name", F.col("p.a").alias("a"), F.explode("p.others").alias("b"))
    apart = pairs.where("a < b").distinct()
    part = lambda df, what, a, b, n: df.select("table_name", F.lit(what).alias("what"), a.alias("a"), b.alias("b"), n.alias("n"))
    none = F.lit(None).cast("string")
    one = F.lit(0).cast("bigint")
    style = F.array_join(_words(F.col("field")), " ")
    rows = part(counts, "name", F.col("field"), style, F.col("n")).unionByName(part(links, "link", F.col("a"), F.col("b"), F.col("n"))).unionByName(part(apart, "apart", F.col("a"), F.coalesce("b", none), one))

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        names = rows[rows.what == "name"]
        members = {f: {f} for f in names.a}
        apart = {frozenset(p) for p in rows[rows.what == "apart"][["a", "b"]].itertuples(index=False)}

        def link(a: str, b: str) -> None:
            x, y = members.get(a), members.get(b)
            if x is not None and y is not None and x is not y and not any(frozenset((p, q)) in apart for p in x for q in y):
                x |= y
                for f in y:
                    members[f] = x

        for _, same in names.sort_values("a").groupby("b"):
            for f in same.a.iloc[1:]:
                link(same.a.iloc[0], f)
        found = rows[rows.what == "link"].sort_values(["n", "a", "b"], ascending=[False, True, True])
        for a, b in zip(found.a, found.b, strict=True):
            link(a, b)
        n = dict(zip(names.a, names.n, strict=True))
        best = {f: max(sorted(m), key=lambda x: n[x]) for f, m in members.items()}
        return pd.DataFrame({"table_name": names.table_name, "field": names.a, "column": names.a.map(best)})

    return rows.groupBy("table_name").applyInPandas(group, "table_name string, field string, column string")


def _join_of_kinds(kinds: Column) -> Column:
    """The least type that all ``kinds`` can be cast to and that one of them is by itself."""
    out = F.lit("string")
    for t in reversed(TYPES):
        able = [k for k, to in PROMOTIONS.items() if t in to]
        firm = [k for k in FIRM if k in able]
        all_able = F.size(F.array_except(kinds, F.array(*map(F.lit, able)))) == 0
        out = F.when(all_able & F.arrays_overlap(kinds, F.array(*map(F.lit, firm))), t).otherwise(out)
    return F.when(F.size(kinds) == 0, "string").otherwise(out)


def union_schema(drift: Drift, names: DataFrame) -> DataFrame:
    """(table_name, column, union_type, seen_types, n_files): the least type of the lattice that holds every file's values.

    The kinds of the opened values count, not the wrappings, except where a column has arrays only. A column without
    a value is text.
    """
    rows = drift.counts.join(names, ["table_name", "field"])
    seen = rows.groupBy("table_name", "column").agg(
        F.collect_set("kind").alias("kinds"), F.array_join(F.sort_array(F.collect_set("json_type")), "+").alias("seen_types"), F.count_distinct("site", "file_name").alias("n_files")
    )
    union = F.when(F.col("seen_types") == "array", "array").otherwise(_join_of_kinds(F.col("kinds")))
    return seen.select("table_name", "column", union.alias("union_type"), "seen_types", "n_files")


def _cast(opened: Column, union_type: str) -> Column:
    """An opened value in its column's type; null where it cannot be cast, which the union type rules out."""
    if union_type == "string":
        return opened
    bare = _bare(opened, F.lit(False))
    bare = F.regexp_replace(bare, r"\.0+$", "") if union_type == "whole" else bare
    return bare.try_cast(TYPES[union_type])


def unified_table(lines: DataFrame, table_name: str, columns: list[tuple[str, str, list[str]]]) -> DataFrame:
    """The valid records of one table in one schema: the file's columns, ``line_no``, and each column in its type.

    ``columns``: (column, union type, names in the files). Projections of the records: nothing is shuffled. Where a
    record has a column under two names, the column's own name counts, then the first in order that is not null.
    Values are opened (``[7]``, ``{"id": 7}``) and, in columns of numbers, taken out of text (``"CHK-0007"``, ``"7"``,
    ``7.0``). Repeated lines stay, with their own line number. A column named like one of the file's gets the prefix
    ``record_``.
    """
    keys = ["site", "file_name", "exported_at", "line_no"]
    rows = lines.where(F.col("table_name") == table_name).select(*keys, F.expr("try_parse_json(record)").alias("v"))
    rows = rows.where("site is not null and file_name is not null and v is not null and startswith(schema_of_variant(v), 'OBJECT')")
    raw, once, twice, out = [], [], [], []
    for i, (column, union_type, names) in enumerate(columns):
        paths = ["$['" + n.replace("\\", "\\\\").replace("'", "\\'") + "']" for n in sorted(names, key=lambda n: (n != column, n))]
        raw.append(F.coalesce(*(F.try_variant_get("v", p, TYPES["array" if union_type == "array" else "string"]) for p in paths)).alias(f"_{i}"))
        value = F.col(f"_{i}")
        once.append((value if union_type == "array" else _opened(value)).alias(f"_{i}"))
        twice.append((value if union_type == "array" else _opened(value)).alias(f"_{i}"))
        taken = column.lower() in {*KEY, "exported_at", "line_no"}
        out.append((value if union_type == "array" else _cast(value, union_type)).alias(f"record_{column}" if taken else column))
    return rows.select(*keys, *raw).select(*keys, *once).select(*keys, *twice).select(*keys, *out)


def unified_columns(drift: Drift) -> dict[str, list[tuple[str, str, list[str]]]]:
    """For each table the columns of its union schema with type and names: schema-sized, and needed to plan the projection."""
    names = canonical_names(drift)
    names = cut(names)
    grouped = names.groupBy("table_name", "column").agg(F.sort_array(F.collect_list("field")).alias("names")).join(union_schema(drift, names), ["table_name", "column"])
    out: dict[str, list[tuple[str, str, list[str]]]] = {}
    for r in grouped.orderBy("table_name", "column").collect():
        out.setdefault(r["table_name"], []).append((r["column"], r["union_type"], r["names"]))
    return out
