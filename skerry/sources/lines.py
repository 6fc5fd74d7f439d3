"""Text lines with their file, decoded per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.operators.joins import join_per_source


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Columns ``source_file`` and ``value``. Files are split among tasks; ``value`` holds the
    bytes of the line as they are, valid UTF-8 or not."""
    return spark.read.text(path).select(F.input_file_name().alias("source_file"), "value")


def unfold(df: DataFrame, fields: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    """Select ``keep`` and the parsed ``fields`` so that each is computed once per row.

    The fields pass through a generator of exactly one row. Spark does not push a later filter on
    a field below a generator, where it would split and parse the line again for every mention."""
    return df.select(*keep, F.inline(F.array(F.struct(*fields))))


def split_quoted(value: Column, separator: str) -> Column:
    """The fields of a record as an array. A field in quotes may hold separators, line ends and
    doubled quotes; a quote elsewhere is a character like others.

    Only records with a quote pay for the pattern. Its loops never give back what they matched, so
    a long field does not deepen the stack; the separator put in front makes no match empty."""
    sign, field = _patterns(separator)
    found = F.regexp_extract_all(F.concat(F.lit(separator), value), F.lit(field), 1)
    return F.when(value.contains('"'), F.transform(found, unquoted)).otherwise(F.split(value, sign))


def cut_quoted(value: Column, separator: str) -> Column:
    """The fields of :func:`split_quoted` as they are written, to be freed by :func:`unquoted`. Cheaper
    where few of them are asked for: there is no function over the array, which Spark would not compile.

    Fields before the first quote are split as they are; only those from the field with it on pay for
    the pattern. That part is cut by bytes, as a line need not be valid UTF-8."""
    sign, field = _patterns(separator)
    before = F.substring_index(value, '"', 1)
    separators = F.octet_length(before) - F.octet_length(F.replace(before, F.lit(separator), F.lit("")))
    plain = F.slice(F.split(before, sign), F.lit(1), (separators / len(separator.encode())).cast("int"))
    rest = F.substr(value.cast("binary"), F.octet_length(before) + 1).cast("string")
    tail = F.concat(F.lit(separator), F.substring_index(before, separator, -1), rest)
    found = F.regexp_extract_all(tail, F.lit(field), 1)
    return F.when(value.contains('"'), F.concat(plain, found)).otherwise(F.split(value, sign))


def unquoted(cell: Column) -> Column:
    """What a field says: without the quotes around it, doubled ones single."""
    inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    return F.when(cell.startswith('"') & cell.endswith('"') & (F.length(cell) > 1), inner).otherwise(cell)


def _patterns(separator: str) -> tuple[str, str]:
    """The separator, and a separator with the field after it, as patterns."""
    sign = "\\" + separator if separator in "|.^$*+?()[]{}" else separator
    return sign, f'{sign}("(?:[^"]++|"")*+"(?={sign}|\\z)|[^{sign}]*+)'


def placed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Columns ``source_file``, ``block``, ``line`` and ``value``. ``block`` is where the split of
    the file starts, ``line`` grows within it."""
    return spark.read.text(path).select(
        F.input_file_name().alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value")


def open_quote(value: Column) -> Column:
    """Whether a line has an odd number of quotes: it begins or ends a field with line ends."""
    return (F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))) % 2 == 1


def whole_records(lines: DataFrame) -> DataFrame:
    """Put the lines of a record together again where a quoted field holds line ends.

    ``lines`` have ``source_file``, ``block``, ``line``, ``value``, and ``inside``: whether their
    block begins within quotes, or null if the block has no such field at all, so that its lines
    are records as they are. Other columns are the same for all lines of a file and stay.

    Only blocks with such fields are sorted, each on its own. Records over a border of blocks are
    found by the last record begun before. An odd number of quotes in a file is an error, as then
    everything behind the last would be one record."""
    facts = [c for c in lines.columns if c not in ("block", "line", "value", "inside")]
    whole = lines.where("inside IS NULL").select(*facts, "value")
    own = ["source_file", "block"]
    sofar = Window.partitionBy(*own).orderBy("line")
    mixed = lines.where("inside IS NOT NULL").withColumn("_odd", open_quote(F.col("value")).cast("int"))
    before = F.coalesce(F.sum("_odd").over(sofar.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mixed = mixed.withColumn("_within", (F.col("inside").cast("int") + before) % 2 == 1)
    single = mixed.where("NOT _within AND _odd = 0").select(*facts, "value")
    # From here on lines of records with line ends only.
    place = F.struct("block", "line")
    parts = mixed.where("_within OR _odd = 1").withColumn("_begin", F.when(~F.col("_within"), place))
    last = parts.groupBy(*own).agg(F.max("_begin").alias("_last"))
    earlier = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    parts = parts.withColumn("_begin", F.last("_begin", ignorenulls=True).over(sofar)).join(carried, own)
    record = F.coalesce("_begin", "_carried").alias("_record")
    ordered = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    joined = parts.groupBy("source_file", record).agg(
        *[F.first(c).alias(c) for c in facts if c != "source_file"],
        F.array_join(F.transform(ordered, lambda p: p["value"]), "\n").alias("value"))
    return whole.unionByName(single).unionByName(joined.select(*facts, "value"))


def _western() -> tuple[str, str]:
    """The bytes where windows-1252 and latin-1 differ, as latin-1 and as windows-1252 text."""
    pairs = []
    for code in range(0x80, 0xA0):
        try:
            pairs.append((chr(code), bytes([code]).decode("windows-1252")))
        except UnicodeDecodeError:
            continue  # not assigned in windows-1252
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


# The five byte values windows-1252 leaves unassigned.
UNASSIGNED = "[\u0081\u008d\u008f\u0090\u009d]"


def encoding_flags(value: Column) -> dict[str, Column]:
    """Aggregates that decide how a file reads: all lines are UTF-8; some have odd bytes."""
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return {"_utf8": F.bool_and(F.is_valid_utf8(value)), "_odd_bytes": F.bool_or(latin.rlike(UNASSIGNED))}


def decoded(value: Column) -> Column:
    """The bytes of a line as text, by the flags of its file; a leading byte order mark goes."""
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    latin_text, western_text = _western()
    text = (
        F.when(F.col("_utf8"), value)
        .when(F.col("_odd_bytes"), latin)
        .otherwise(F.translate(latin, latin_text, western_text))
    )
    return F.regexp_replace(text, "^\ufeff", "")


def decode_lines(lines: DataFrame, source: str = "source_file") -> DataFrame:
    """Decode each file as UTF-8, else windows-1252, else latin-1; a leading byte order mark goes.

    The choice is per file, as one bad byte changes how the whole file reads. Two flags per file
    are aggregated and joined back, so no file has to fit in one task."""
    flags = encoding_flags(F.col("value"))
    verdict = lines.groupBy(source).agg(*[c.alias(name) for name, c in flags.items()])
    return join_per_source(lines, verdict, source).select(source, decoded(F.col("value")).alias("value"))
