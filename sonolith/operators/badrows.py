"""Rows that fail to parse: bulk parsing of record blocks, bisection of failing blocks, strict diagnosis of the rest.

`parse_records` takes raw delimited records in a column and gives every one of them back, either with typed fields or
with the reason why it doesn't load. The records of a batch lie in one buffer, a line each; a block of them goes through
the bulk path at once: the columnar CSV reader turns that stretch of the buffer into columns. A block that fails is cut
in two and tried again, so that good records still load in bulk; of a failing block of LEAF records each is parsed, and
diagnosed, by a strict parser of the record alone. Blocks grow while they load and shrink while they fail. The checked
columns are then matched and converted as arrays; records in doubt there go to the strict parser too. The bulk path
accepts only what the strict one accepts: what the reader takes more kindly (stray quotes, line ends within a record,
empty lines, a byte order mark) is found by one columnar match beforehand and makes its block fail.

The first reason that holds is given: ``quoting`` (a field is neither quoted as a whole, with doubled quotes within,
nor free of quotes), ``column_count``, ``bad_value``.

Defined cases: a trailing carriage return isn't part of a record; a null or empty record has one field; a quoted field
may hold delimiters, quotes and line breaks; records of any length work. Other columns pass through; one named like a
field or `reason` is replaced by it. Rows are parsed where they lie: no shuffle, and no state beyond a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FIRST, LEAF, MOST = 64, 16, 4096
NUMBER = r" *[+-]?[0-9]+([.,][0-9]+)? *"
_NUMBER = re.compile(NUMBER)


@dataclass(frozen=True)
class Field:
    """A column of the records. With low and high it is a number within that range; unknown: an empty or blank field
    or a zero is allowed as well and gives null."""

    name: str
    low: float | None = None
    high: float | None = None
    unknown: bool = False

    @property
    def checked(self) -> bool:
        return self.low is not None


def _numbers(texts: pa.Array, field: Field) -> tuple[pa.Array, pa.Array]:
    """The values of a column of texts and whether each is valid."""
    form = pc.match_substring_regex(texts, rf"\A{NUMBER}\z")
    plain = pc.replace_substring(pc.if_else(form, pc.utf8_trim(texts, " "), "nan"), ",", ".")
    plain = pc.if_else(pc.starts_with(plain, "+"), pc.utf8_slice_codeunits(plain, 1, 1 << 30), plain)
    value = pc.cast(plain, pa.float64())
    good = pc.and_(form, pc.and_(pc.greater_equal(value, field.low), pc.less_equal(value, field.high)))
    if field.unknown:
        none = pc.or_(pc.equal(pc.utf8_trim_whitespace(texts), ""), pc.and_(form, pc.equal(value, 0.0)))
        return pc.if_else(none, pa.scalar(None, pa.float64()), value), pc.or_(good, none)
    return value, good


def split_strict(record: str, delimiter: str = ",", quote: str = '"') -> list[str] | None:
    """The fields of one record, or None where its quoting is broken."""
    fields, at = [], 0
    while True:
        if record.startswith(quote, at):
            part, at = [], at + 1
            while True:
                end = record.find(quote, at)
                if end < 0:
                    return None
                part.append(record[at:end])
                at = end + 1
                if not record.startswith(quote, at):
                    break
                part.append(quote)
                at += 1
            fields.append("".join(part))
            if at == len(record):
                return fields
            if not record.startswith(delimiter, at):
                return None
        else:
            end = record.find(delimiter, at)
            end = len(record) if end < 0 else end
            if quote in record[at:end]:
                return None
            fields.append(record[at:end])
            at = end
            if at == len(record):
                return fields
        at += 1


class _Loader:
    def __init__(self, fields: Sequence[Field], delimiter: str):
        self.fields, self.delimiter = fields, delimiter

    def bulk(self, lines: pa.Buffer) -> pa.Table | None:
        """The block's records as columns of texts, or None where any of them doesn't split plainly."""
        names = [f.name for f in self.fields]
        kinds = pcsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False, null_values=[])
        read = pcsv.ReadOptions(use_threads=False, column_names=names, block_size=max(1 << 20, lines.size + 1))
        form = pcsv.ParseOptions(delimiter=self.delimiter, ignore_empty_lines=False)
        try:
            return pcsv.read_csv(pa.BufferReader(lines), read, form, kinds)
        except pa.ArrowInvalid:
            return None

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Whether the reader takes each record as the strict parser does, as far as its fields are as many as wanted."""
        d = re.escape(self.delimiter)
        field = f'(?:"(?:[^"\\r\\n]|"")*"|[^"{d}\\r\\n]*)'
        good = pc.match_substring_regex(texts, rf"\A{field}(?:{d}{field})*\z")
        kind = pc.and_(pc.greater(pc.binary_length(texts), 0), pc.invert(pc.starts_with(texts, "\ufeff")))
        return pc.and_(good, kind).to_numpy(zero_copy_only=False)

    def strict(self, record: str) -> tuple[list[str] | None, str | None]:
        """The fields of one record as texts, or the reason why it doesn't load."""
        fields = split_strict(record, self.delimiter)
        if fields is None:
            return None, "quoting"
        if len(fields) != len(self.fields):
            return None, "column_count"
        for field, text in zip(self.fields, fields, strict=True):
            if field.checked and not self.valid(field, text):
                return None, "bad_value"
        return fields, None

    @staticmethod
    def valid(field: Field, text: str) -> bool:
        if field.unknown and not text.strip():
            return True
        if not _NUMBER.fullmatch(text):
            return False
        value = float(text.strip(" ").replace(",", "."))
        return field.low <= value <= field.high or (field.unknown and value == 0)

    def load(self, records: pa.Array) -> tuple[list[pa.Array], pa.Array]:
        """Columns in the order of the records, and the reasons."""
        whole = pc.fill_null(records.cast(pa.large_string()), "")
        texts = pc.replace_substring_regex(whole, r"\r\z", "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        odd = np.concatenate([[0], np.cumsum(~self.plain(texts))])
        lined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        offsets = np.frombuffer(lined.buffers()[1], np.int64)[lined.offset : lined.offset + len(lined) + 1]
        data = lined.buffers()[2]
        reasons: list[str | None] = [None] * len(texts)
        parts: list[list[pa.Array]] = [[pa.array([], pa.string())] for _ in self.fields]
        size, at = FIRST, 0
        while at < len(texts):
            end = min(at + size, len(texts))
            whole_block, stack = True, [(at, end)]
            while stack:  # from the left, so that columns come in order
                a, b = stack.pop()
                block = None
                if odd[a] == odd[b]:
                    block = self.bulk(data.slice(int(offsets[a]), int(offsets[b] - offsets[a])))
                if block is not None and block.num_rows == b - a:
                    for part, column in zip(parts, block.columns, strict=True):
                        part.extend(column.chunks)
                    continue
                whole_block = False
                if b - a > LEAF:
                    middle = (a + b) // 2
                    stack += [(middle, b), (a, middle)]
                    continue
                rows: list[list] = []
                for i in range(a, b):
                    fields, reasons[i] = self.strict(texts[i].as_py())
                    rows.append(fields or [None] * len(self.fields))
                for part, values in zip(parts, zip(*rows, strict=True), strict=True):
                    part.append(pa.array(values, pa.string()))
            size, at = min(2 * size, MOST) if whole_block else max(size // 2, 2 * LEAF), end
        columns = [pa.concat_arrays(part) for part in parts]
        # The split columns are checked as a whole. A quote left in a field is either doubled or a fault, and an
        # invalid value is one: the strict parser decides on these records.
        doubt = pa.array([False] * len(texts), pa.bool_())
        out = []
        for field, column in zip(self.fields, columns, strict=True):
            doubt = pc.or_(doubt, pc.fill_null(pc.match_substring(column, '"'), False))
            if field.checked:
                column, good = _numbers(column, field)
                doubt = pc.or_(doubt, pc.fill_null(pc.invert(good), False))
            out.append(column)
        for i in np.flatnonzero(doubt.to_numpy(zero_copy_only=False)).tolist():
            if reasons[i] is None:
                _, reasons[i] = self.strict(texts[i].as_py())
        reason = pa.array(reasons, pa.string())
        loads = pc.is_null(reason)
        return [pc.if_else(loads, c, pa.scalar(None, c.type)) for c in out], reason

    @staticmethod
    def kind(field: Field) -> pa.DataType:
        return pa.float64() if field.checked else pa.string()


def parse_records(df: DataFrame, raw: str, fields: Sequence[Field], delimiter: str = ",") -> DataFrame:
    """All rows of df with the fields of the record in column `raw` and `reason` (null where it loads)."""
    names = [f.name for f in fields]
    df = df.select(*[c for c in df.columns if c == raw or c not in {*names, "reason"}])
    added = [T.StructField(f.name, T.DoubleType() if f.checked else T.StringType()) for f in fields]
    schema = T.StructType([*df.schema.fields, *added, T.StructField("reason", T.StringType())])
    fields = tuple(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loader = _Loader(fields, delimiter)
        for batch in batches:
            columns, reasons = loader.load(batch.column(raw))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns, reasons], names=[*batch.schema.names, *names, "reason"]
            )

    return df.mapInArrow(run, schema)
