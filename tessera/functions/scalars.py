"""Scalar functions over columns; all are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(c) -> Column:
    """Lower-case hex SHA-256: the content address."""
    return F.sha2(c, 256)


def byte_length(c) -> Column:
    return F.octet_length(c).cast("long")


def base64_line(c) -> Column:
    """Base64 on one line; Spark breaks lines after 76 characters."""
    return F.translate(F.base64(F.encode(c, "UTF-8")), "\r\n", "")


def url_slug(c) -> Column:
    """URL-safe base64 without padding, on one line."""
    return F.translate(F.base64(F.encode(c, "UTF-8")), "+/=\r\n", "-_")


def from_url_slug(c) -> Column:
    x = F.translate(c, "-_", "+/")
    return F.decode(F.unbase64(F.rpad(x, F.ceil(F.length(x) / 4).cast("int") * 4, "=")), "UTF-8")


def decode_or_null(c) -> Column:
    """Base64 payload, null where it is malformed."""
    return F.decode(F.try_to_binary(c, F.lit("base64")), "UTF-8")


def escape_path(c) -> Column:
    """Only %, / and \\ are escaped, in that order."""
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")), F.lit("\\"), F.lit("%5C"))


def unescape_path(c) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%5C"), F.lit("\\")), F.lit("%2F"), F.lit("/")), F.lit("%25"), F.lit("%"))


def owner_and_name(c) -> Column:
    """struct(owner, name) of owner/name, both non-empty and no further slash; else null."""
    return F.when(c.rlike("^[^/]+/[^/]+$"), F.struct(F.split_part(c, F.lit("/"), F.lit(1)).alias("owner"), F.split_part(c, F.lit("/"), F.lit(2)).alias("name")))


def backoff(base, attempts: Column, most: int, cap=None) -> Column:
    """base * 2**min(attempts - 1, most), at most cap."""
    n = F.greatest(F.least(attempts - 1, F.lit(most)), F.lit(0))
    x = (F.lit(base) * F.pow(F.lit(2), n)).cast("long")
    return x if cap is None else F.least(x, F.lit(cap))


def byte_range(header: Column, size: Column) -> Column:
    """struct(first, last) of "bytes=a-b", "bytes=a-" or "bytes=-n", the end clamped; null if unsatisfiable."""
    pattern = r"^bytes=([0-9]*)-([0-9]*)$"
    a, b = (F.nullif(F.regexp_extract(header, pattern, i), F.lit("")).cast("long") for i in (1, 2))
    first = F.when(a.isNull(), F.greatest(size - b, F.lit(0))).otherwise(a)
    last = F.when(a.isNull() | b.isNull(), size - 1).otherwise(F.least(b, size - 1))
    return F.when((a.isNotNull() | (b > 0)) & (first <= last) & (first < size), F.struct(first.alias("first"), last.alias("last")))


def strip_branch(c) -> Column:
    """Branch of refs/heads/..., else null."""
    return F.when(c.startswith("refs/heads/"), F.substr(c, F.lit(12)))


def is_zero_sha(c) -> Column:
    return c.rlike("^0+$")


def octal_mode(c) -> Column:
    return F.lpad(F.conv(c.cast("string"), 10, 8), 6, "0")


def mode_kind(octal: Column) -> Column:
    """Kind of an octal git mode."""
    return (
        F.when(octal == "120000", "symlink").when(octal == "160000", "submodule").when(octal == "040000", "tree").when(octal == "100755", "executable").otherwise("file")
    )


def parent_dir(path: Column) -> Column:
    """Everything before the last slash; empty for a top-level path."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def pack_header(kind: Column, size: Column) -> Column:
    """Binary header of a pack entry: kind and the low 4 bits of the size, then 7 bits a byte; bit 7: more follow."""
    rest = F.shiftrightunsigned(size.cast("long"), 4)
    groups = F.filter(F.sequence(F.lit(0), F.lit(8)), lambda i: (i == 0) | (F.call_function("shiftrightunsigned", rest, (7 * i).cast("int")) > 0))
    groups = F.when(rest > 0, groups).otherwise(F.array().cast("array<int>"))
    byte = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    first = byte(kind * 16 + F.pmod(size, F.lit(16)) + F.when(rest > 0, 128).otherwise(0))
    more = F.transform(groups, lambda g, i: byte(F.call_function("shiftrightunsigned", rest, (7 * g).cast("int")).bitwiseAND(F.lit(127)) + F.when(i + 1 < F.size(groups), 128).otherwise(0)))
    return F.unhex(F.concat(first, F.array_join(more, "")))


def read_pack_header(b: Column) -> Column:
    """struct(kind, size) of a pack entry that begins with its header; null where it is cut off or above 60 bits."""
    at = lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("long")
    head = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.octet_length(b), F.lit(9)), F.lit(1))), at)
    last = F.array_position(F.transform(head, lambda x: x < 128), True).cast("int")
    size = lambda h: F.aggregate(F.transform(F.slice(h, 2, last - 1), lambda x, i: F.call_function("shiftleft", x.bitwiseAND(F.lit(127)), (4 + 7 * i).cast("int"))), h[0].bitwiseAND(F.lit(15)), lambda a, x: a + x)
    kind = F.shiftright(head[0], 4).bitwiseAND(F.lit(7)).cast("int")
    return F.when((F.octet_length(b) > 0) & (last > 0), F.struct(kind.alias("kind"), size(head).alias("size")))
