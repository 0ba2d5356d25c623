"""Functions for SQL: user functions by import path, built-in ones, network addresses."""

from __future__ import annotations

import importlib
import ipaddress
import sys
import typing
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the repository

TYPES: dict[type, T.DataType] = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType()}

#: Public suffixes of two labels that registered domains stand before; single labels are suffixes by themselves.
TWO_LABEL_SUFFIXES = frozenset(
    "co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk sch.uk com.au net.au org.au edu.au gov.au id.au co.nz org.nz net.nz govt.nz ac.nz co.jp or.jp ne.jp ac.jp go.jp ad.jp"
    " co.kr or.kr go.kr ac.kr com.br net.br org.br gov.br edu.br com.cn net.cn org.cn gov.cn edu.cn com.tw org.tw edu.tw com.hk org.hk com.sg org.sg edu.sg co.in net.in org.in"
    " gov.in ac.in co.za org.za gov.za ac.za com.mx org.mx gob.mx com.ar gob.ar com.tr org.tr gov.tr edu.tr co.il org.il ac.il com.my com.ph com.vn co.th co.id com.ua com.pl"
    " com.co com.pe com.ve com.eg com.sa com.pk com.ng co.ke".split()
)


def return_type(f: Callable) -> T.DataType:
    """The Spark type of a function's annotated result; a function without annotations is an error."""
    hints = typing.get_type_hints(f)
    if "return" not in hints or len(hints) <= len([a for a in hints if a == "return"]) and f.__code__.co_argcount:
        raise TypeError(f"{f.__qualname__}: parameters and result need type annotations")
    return data_type(hints["return"])


def data_type(hint) -> T.DataType:
    if hint in TYPES:
        return TYPES[hint]
    origin, args = typing.get_origin(hint), [a for a in typing.get_args(hint) if a is not type(None)]
    if origin is list:
        return T.ArrayType(data_type(args[0]))
    if origin is dict:
        return T.MapType(*map(data_type, args))
    if origin is not None and len(args) == 1:  # Optional
        return data_type(args[0])
    raise TypeError(f"no SQL type for {hint!r}")


def null_safe(f: Callable) -> Callable:
    """``f``, but null where an argument is null."""

    def wrapped(*args):
        return None if any(a is None for a in args) else f(*args)

    return wrapped


def register(spark: SparkSession, name: str, import_path: str) -> None:
    """The function at ``package.module.attribute`` under ``name`` in SQL; types come from its annotations."""
    module, _, attribute = import_path.rpartition(".")
    f = getattr(importlib.import_module(module), attribute)
    spark.udf.register(name, F.udf(null_safe(f), return_type(f), useArrow=True))


def register_builtin(spark: SparkSession) -> None:
    """``inet(text)`` and ``parse_domain(url)``."""
    spark.udf.register("inet", F.udf(inet_bytes, T.BinaryType(), useArrow=True))
    spark.udf.register("parse_domain", F.udf(null_safe(parse_domain), T.StringType(), useArrow=True))


def inet_bytes(text: str | None) -> bytes | None:
    """An IPv4 or IPv6 address as 16 bytes whose order is the addresses' order; null for what is none."""
    try:
        return None if text is None else b"\x00" * 12 + a.packed if (a := ipaddress.ip_address(text)).version == 4 else a.packed
    except ValueError:
        return None


def inet4(text: Column) -> Column:
    """An IPv4 address as a number, JVM-side."""
    parts = F.split(text, r"\.")
    return sum((F.get(parts, F.lit(i)).cast("long") * 256 ** (3 - i) for i in range(1, 4)), F.get(parts, F.lit(0)).cast("long") * 256**3)


def parse_domain(url: str) -> str:
    """The registered domain of a URL or host: the public suffix and one label; '' if there is none."""
    rest = url.partition("://")[2] if "://" in url else url.removeprefix("//")
    for mark in "/?#":
        rest = rest.partition(mark)[0]
    host = rest.rpartition("@")[2].partition(":")[0].rstrip(".").lower()
    labels = host.split(".")
    if len(labels) < 2 or not all(labels) or all(x.isdigit() for x in labels):
        return ""
    n = 3 if ".".join(labels[-2:]) in TWO_LABEL_SUFFIXES else 2
    return ".".join(labels[-n:]) if len(labels) >= n else ""


def registered_domain(url: Column) -> Column:
    """``parse_domain`` in Catalyst expressions."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    n = F.size(labels)
    valid = (n >= 2) & ~host.rlike(r"^[0-9.]+$") & ~host.rlike(r"(^\.|\.\.)")
    long = F.when(n >= 2, last(2)).isin(*sorted(TWO_LABEL_SUFFIXES))
    return F.when(url.isNull(), None).when(valid & long & (n >= 3), last(3)).when(valid & ~long, last(2)).otherwise("")
