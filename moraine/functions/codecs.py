"""Functions without a Spark expression, as Arrow-batched pandas functions, and driver-side text of schemas."""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def domain_to_ascii(s: pd.Series) -> pd.Series:
    """Punycode form of a domain; '' if it has none, null for null."""

    def one(x):
        if x is None:
            return None
        try:
            return x.lower().encode("idna").decode("ascii")
        except UnicodeError:
            return ""

    return s.map(one)


def _codec(pack):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else pack(bytes(x)))

    return F.pandas_udf(run, T.BinaryType())


def _raw(x: bytes) -> bytes:
    c = zlib.compressobj(wbits=-15)
    return c.compress(x) + c.flush()


deflate, inflate = _codec(zlib.compress), _codec(zlib.decompress)
deflate_raw, inflate_raw = _codec(_raw), _codec(lambda x: zlib.decompress(x, -15))
gzip_pack, gunzip = _codec(lambda x: gzip.compress(x, mtime=0)), _codec(gzip.decompress)
unzip = _codec(lambda x: zlib.decompress(x, 47))


def scrypt(password: Column, salt: Column, size: int, n: int = 16384, r: int = 8, p: int = 1) -> Column:
    """The key derivation function of that name, ``size`` bytes; null for null."""

    def run(passwords: pd.Series, salts: pd.Series) -> pd.Series:
        key = lambda a, b: None if a is None or b is None else hashlib.scrypt(bytes(a), salt=bytes(b), n=n, r=r, p=p, maxmem=256 * n * r + (1 << 20), dklen=size)
        return pd.Series([key(a, b) for a, b in zip(passwords, salts)], dtype=object)

    return F.pandas_udf(run, T.BinaryType())(password.cast("binary"), salt.cast("binary"))


def replace_with(s: Column, pattern: str, make) -> Column:
    """Every match of ``pattern`` replaced by what ``make`` gives for it (a match object)."""
    found = re.compile(pattern)
    return F.pandas_udf(lambda x: x.map(lambda t: None if t is None else found.sub(make, t)), T.StringType())(s)


def _same(s: pd.Series) -> pd.Series:
    return s


def register_test_func(spark) -> None:
    """The SQL extension function: gives its text back."""
    spark.udf.register("test_func", F.pandas_udf(_same, T.StringType()))


_NAMES = {T.BooleanType: "boolean", T.StringType: "string"}


def typescript(t: T.DataType, optional: bool = False) -> str:
    """A Spark type as TypeScript text."""
    if isinstance(t, T.StructType):
        text = "{ " + "; ".join(f"{f.name}{'?' if f.nullable else ''}: {typescript(f.dataType)}" for f in t) + " }"
    elif isinstance(t, T.ArrayType):
        inner = typescript(t.elementType)
        text = f"({inner})[]" if " | " in inner else f"{inner}[]"
    elif isinstance(t, T.MapType):
        text = f"Record<{typescript(t.keyType)}, {typescript(t.valueType)}>"
    elif isinstance(t, T.NumericType):
        text = "number"
    else:
        text = _NAMES.get(type(t), "string" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "unknown")
    return f"{text} | undefined" if optional else text


def fields(df: DataFrame, rename: dict[str, str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """The columns of ``df`` under their outer names, without those that are skipped; a name that isn't there is an error."""
    if missing := sorted({*(rename or {}), *(skip or [])} - set(df.columns)):
        raise ValueError(f"no such fields: {missing}")
    return df.drop(*(skip or [])).withColumnsRenamed(rename or {})


def split_required(schema: T.StructType) -> tuple[list[str], list[str]]:
    """(required, optional) fields."""
    return [f.name for f in schema if not f.nullable], [f.name for f in schema if f.nullable]
