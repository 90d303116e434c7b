"""Loading delimited rows: valid rows with typed coordinates, and each failing record with its reasons.

One anchored pattern per schema accepts whole good rows. What it doesn't accept passes through patterns for growing field
prefixes, and all reasons come from them. The first prefix of well-formed fields that doesn't match tells the field at which
a row breaks: its quoting, if a field begins there, else the row has ended too early. A row of the right shape meets one
prefix pattern for each typed field, in which that field alone is typed, so a broken one doesn't hide those behind it.
All are JVM expressions over the text; possessive quantifiers keep them linear and without recursion, however long a row is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
BARE = r'(?:[^"\t][^\t]*+)?+'
ANY = f"(?:{QUOTED}|{BARE})"
END = r"(?=\t|\z)"
MAX_LONG = "9223372036854775807"
STRANDS = ("+", "-", ".", "?", "NA")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "text"  # text, position or strand


FEATURE_FIELDS = tuple(
    Field(n, {"start": "position", "end": "position", "strand": "strand"}.get(n, "text"))
    for n in "family_id species gene_copy_id gene_id seqid source type start end strand phase id name parent parents ownership attrs".split()
)
TYPED_FIELDS = tuple(f for f in FEATURE_FIELDS if f.kind != "text")


def at_most(n: str) -> str:
    """The pattern of the numbers of as many digits as n, from 10...0 up to n."""
    smaller = [f"{n[:i]}[{int(i == 0)}-{int(d) - 1}][0-9]{{{len(n) - i - 1}}}" for i, d in enumerate(n) if int(d) > int(i == 0)]
    return "(?:" + "|".join([*smaller, n]) + ")"


#: The exact form of each kind, spaces at both ends left out.
EXACT = {"position": f" *+0*+(?:{at_most(MAX_LONG)}|[1-9][0-9]{{0,17}}) *+", "strand": " *+(?:" + "|".join("NA" if x == "NA" else f"[{x}]" for x in STRANDS) + ") *+"}


def field_pattern(kind: str, quotes: bool = True) -> str:
    """A field of a kind up to its end; in lines it may stand in quotes."""
    if kind == "text":
        return (ANY if quotes else r"[^\t]*+") + END
    return (f'(?:{EXACT[kind]}|"{EXACT[kind]}")' if quotes else EXACT[kind]) + END


def row_pattern(fields: tuple[Field, ...], quotes: bool = True) -> str:
    """The anchored pattern of a whole row."""
    return r"\A" + r"\t".join(field_pattern(f.kind, quotes) for f in fields) + r"\z"


def prefix_pattern(n: int, kind: str = "text", quotes: bool = True) -> str:
    """The anchored pattern of a row whose first n fields are well formed, the last of them of a kind."""
    return r"\A" + r"\t".join([field_pattern("text", quotes)] * (n - 1) + [field_pattern(kind, quotes)])


def split_fields(line: Column) -> Column:
    """The fields of a row whose quoting is in order, quotes taken off."""
    raw = F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit(rf"\t({ANY})(?=\t|\z)"), F.lit(1))
    return F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def position(value: Column) -> Column:
    """Spaces left out, only the digits 0-9, from 1 to the largest long; otherwise null."""
    return F.when(value.rlike(rf"\A{EXACT['position']}\z"), F.trim(value)).cast("long")


def strand(value: Column) -> Column:
    return F.when(F.trim(value).isin(*STRANDS), F.trim(value))


def _shape(line: Column) -> Column:
    """Struct of the first field that is broken in shape and the reason; null for a row of the right shape.

    Field by field: where the prefix up to it doesn't match, the row goes on behind the fields before (then its quoting is
    at fault) or has ended.
    """
    n = len(FEATURE_FIELDS)
    broken = lambda k, why: F.struct(F.lit(k).alias("field"), F.lit(why).alias("reason"))
    out = F.when(~line.rlike(prefix_pattern(1)), broken(1, "quoting"))
    for k in range(2, n + 1):
        goes_on = line.rlike(prefix_pattern(k - 1) + r"\t")
        out = out.when(~line.rlike(prefix_pattern(k)), F.when(goes_on, broken(k, "quoting")).otherwise(broken(k, "column_count")))
    more = line.rlike(prefix_pattern(n) + r"\t")
    well_quoted = line.rlike(prefix_pattern(n) + rf"(?:\t{ANY}{END})*+\z")
    return out.when(more & ~well_quoted, broken(n + 1, "quoting")).when(more, broken(n + 1, "column_count"))


def _values(text: Column, fields: tuple[Field, ...], start: Column, end: Column, quotes: bool) -> tuple[Column, Column]:
    """Reasons of a row of the right shape, and its first broken field: one prefix pattern for each typed field."""
    at = {f.name: i for i, f in enumerate(fields, 1)}
    bad = {f.name: ~text.rlike(prefix_pattern(at[f.name], f.kind, quotes)) for f in TYPED_FIELDS}
    backwards = F.coalesce(position(end) < position(start), F.lit(False))
    tests = (("start_value", bad["start"], "start"), ("end_value", bad["end"], "end"), ("end_before_start", backwards, "end"), ("strand_value", bad["strand"], "strand"))
    reasons = F.filter(F.array(*[F.when(t, F.lit(r)) for r, t, _ in tests]), lambda x: x.isNotNull())
    return reasons, F.coalesce(*[F.when(t, F.lit(at[n])) for _, t, n in tests])


def parse_columns(df: DataFrame, key: str) -> DataFrame:
    """Rows already in columns: record_id, the fields as read, and reasons (empty: valid).

    The typed columns are taken as one row of three fields, in which a null or a tab is a letter that no kind has. A null
    start, end or strand is a failing value; other nulls are not. Every row is one result row, repeated ones too;
    values of any length take linear time; extra columns of any name are left out; no rows give no rows.
    """
    get = lambda n: F.col(f"`{n}`")
    text = F.concat_ws("\t", *[F.coalesce(F.translate(get(f.name), "\t", "x"), F.lit("x")) for f in TYPED_FIELDS])
    good = text.rlike(row_pattern(TYPED_FIELDS, False)) & (position(get("end")) >= position(get("start")))
    reasons, _ = _values(text, TYPED_FIELDS, get("start"), get("end"), False)
    return df.select(get(key).alias("record_id"), *[get(f.name).alias(f.name) for f in FEATURE_FIELDS], F.when(good, F.array().cast("array<string>")).otherwise(reasons).alias("reasons"))


def parse_lines(df: DataFrame, key: str, line: str) -> DataFrame:
    """Raw lines: as parse_columns, with first_broken (1-based field, null where none).

    One carriage return at the end doesn't count. Null lines, lines of white space alone and lines that begin with
    `#` are no records and are left out. Every other line is one result row, repeated ones too, with linear time in
    its length; no lines give no rows; extra columns of any name are left out.
    """
    at = {f.name: i + 1 for i, f in enumerate(FEATURE_FIELDS)}
    rows = df.select(F.col(f"`{key}`").alias("record_id"), F.regexp_replace(F.col(f"`{line}`"), r"\r\z", "").alias("_line"))
    rows = rows.where(F.col("_line").isNotNull() & ~F.col("_line").startswith("#") & F.col("_line").rlike(r"[^\s]"))
    text = F.col("_line")
    sure = text.rlike(row_pattern(FEATURE_FIELDS))
    rows = rows.withColumn("_sure", sure).withColumn("_shape", F.when(~F.col("_sure"), _shape(text)))
    rows = rows.withColumn("_f", F.when(F.coalesce(F.col("_shape.reason") != "quoting", F.lit(True)), split_fields(text)))
    get = lambda name: F.get(F.col("_f"), F.lit(at[name] - 1))
    values, first = _values(text, FEATURE_FIELDS, get("start"), get("end"), True)
    good = F.col("_sure") & (position(get("end")) >= position(get("start")))
    reasons = F.when(good, F.array().cast("array<string>")).when(F.col("_shape").isNotNull(), F.array("_shape.reason")).otherwise(values)
    broken = F.when(~good, F.coalesce(F.col("_shape.field"), first))
    return rows.select("record_id", *[get(f.name).alias(f.name) for f in FEATURE_FIELDS], reasons.alias("reasons"), broken.alias("first_broken"))


def valid_rows(parsed: DataFrame) -> DataFrame:
    """The rows without a reason, coordinates typed."""
    typed = {"start": position(F.col("start")), "end": position(F.col("end")), "strand": strand(F.col("strand"))}
    return parsed.where(F.size("reasons") == 0).select("record_id", *[typed.get(f.name, F.col(f.name)).alias(f.name) for f in FEATURE_FIELDS])


def failures(parsed: DataFrame, source_table: str) -> DataFrame:
    """source_table, record_id, reason: one row for each record and reason."""
    return parsed.where(F.size("reasons") > 0).select(F.lit(source_table).alias("source_table"), "record_id", F.explode("reasons").alias("reason"))
