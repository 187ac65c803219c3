"""Bit expressions for radix routing and packed rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def radix(key: Column, bits: int, shift: int = 0) -> Column:
    """``bits`` bits of the key from bit ``shift`` on."""
    return F.shiftright(key.bitwiseAND(F.lit(((1 << bits) - 1) << shift).cast("long")), shift)


def node_of_partition(partition: Column, partitions: int, nodes: int) -> Column:
    """Nodes 1..N own equal ranges of partitions; the last also owns the remainder."""
    each = partitions // nodes
    return F.least((partition / each).cast("long") + 1, F.lit(nodes).cast("long"))


def partitions_of_node(node: int, partitions: int, nodes: int) -> range:
    each = partitions // nodes
    return range((node - 1) * each, partitions if node == nodes else node * each)


def raw_word(key: Column, following: Column) -> Column:
    """Eight bytes read at a 32-bit key with a 32-bit column behind it."""
    return F.shiftleft(following.cast("long"), 32).bitwiseOR(key.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def next_power_of_two(n: int) -> int:
    return 1 if n <= 1 else 1 << math.ceil(math.log2(n))


def pack_pair(key: Column, value: Column) -> Column:
    """Key in the high, value in the low 32 bits."""
    return F.shiftleft(key.cast("long"), 32).bitwiseOR(value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def unpack_pair(word: Column) -> tuple[Column, Column]:
    return F.shiftright(word, 32), word.bitwiseAND(F.lit(0xFFFFFFFF))


#: Bits of a value in the radix form of packing.
VALUE_BITS = 27


def pack_radix(key: Column, value: Column, bits: int) -> Column:
    """Value in the low bits, and above it the key bits that the first pass has not used."""
    return value + F.shiftleft(F.shiftright(key, bits), bits + VALUE_BITS)


def unpack_radix(word: Column, partition: Column, bits: int) -> tuple[Column, Column]:
    """Key and value again, given the first pass's partition; values are below 2^(VALUE_BITS + bits)."""
    mask = (1 << (bits + VALUE_BITS)) - 1
    return F.shiftleft(F.shiftright(word, bits + VALUE_BITS), bits) + partition, word.bitwiseAND(F.lit(mask))
