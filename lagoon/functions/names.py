"""Receiver ids ``network.station.location.channel``, pairs ``A-B`` and archive paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field lengths of a SEED id, and its form with wildcards.
EXACT = r"^[A-Z0-9]{1,2}\.[A-Z0-9]{3,5}\.[A-Z0-9]{0,2}\.[A-Z0-9]{3}$"
WILD = r"^[A-Z0-9?*]{1,2}\.[A-Z0-9?*]{1,5}\.[A-Z0-9?*]{0,2}\.[A-Z0-9?*]{1,3}$"
FIELDS = ("network", "station", "location", "channel")


def is_receiver(receiver: Column, wildcards: bool = False) -> Column:
    return F.coalesce(receiver.rlike(WILD if wildcards else EXACT), F.lit(False))


def receiver_struct(receiver: Column) -> Column:
    parts = F.split(receiver, r"\.")
    return F.when(F.size(parts) == 4, F.struct(*[parts[i].alias(f) for i, f in enumerate(FIELDS)]))


def receiver_string(fields: Column) -> Column:
    return F.concat_ws(".", *[F.coalesce(fields[f], F.lit("")) for f in FIELDS])


def channel(receiver: Column) -> Column:
    return F.element_at(F.split(receiver, r"\."), -1)


def pair(a: Column, b: Column, separator: str = "-") -> Column:
    return F.concat(a, F.lit(separator), b)


def split_pair(name: Column, separator: str = "-") -> Column:
    return F.split(name, separator.replace(".", r"\."))


def substitute(receiver: Column, three_components: str = "12Z") -> Column:
    """Receivers that make a rotated (R or T) one: Z and two horizontals; others stand for themselves."""
    stem = F.substring(receiver, 1, F.length(receiver) - 1) if not isinstance(receiver, str) else receiver
    rotated = F.coalesce(receiver.rlike("[RT]$"), F.lit(False))
    return F.when(rotated, F.array(*[F.concat(stem, F.lit(c)) for c in three_components])).otherwise(F.array(receiver))


def split_pair_substitute(name: Column, separator: str = "-", three_components: str = "12Z") -> Column:
    return F.array_distinct(F.flatten(F.transform(split_pair(name, separator), lambda r: substitute(r, three_components))))


def archive_path(name: Column, time: Column) -> Column:
    """``YYYY/PAIR/PAIR.YYYY.DDD`` of a pair's day."""
    return F.concat(F.date_format(time, "yyyy"), F.lit("/"), name, F.lit("/"), name, F.lit("."), F.date_format(time, "yyyy.DDD"))
