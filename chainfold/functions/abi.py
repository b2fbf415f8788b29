"""Event signatures, ABI types, and Column expressions that decode logs.

A signature is parsed on the driver into parameters with a place: a topic, or a byte offset in the
data's head. Decoding is built-in Column arithmetic over BINARY, so it stays in generated code and
reads only the columns that a query uses. Places inside dynamic values are bound once, not repeated
in every expression that needs them.

Rules of the decoder: a word that the data does not hold whole is zero; `bytes` and `string` that
are malformed are empty; a dynamic array is cut to the elements that the data can hold; nested
dynamic types and indexed non-primitive parameters are refused when the decoder is built.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import u256
from .keccak import keccak256

WORD = 32
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_ALIASES = {"uint": "uint256", "int": "int256", "byte": "bytes1"}


class SignatureError(ValueError):
    """A signature or a type that cannot be used."""


@dataclass(frozen=True)
class AbiType:
    """kind: address, bool, uint, int, fixed (bytesN), bytes, string, array, list (dynamic array) or tuple."""

    kind: str
    size: int = 0
    parts: tuple["AbiType", ...] = ()

    @property
    def text(self) -> str:
        match self.kind:
            case "uint" | "int":
                return f"{self.kind}{self.size}"
            case "fixed":
                return f"bytes{self.size}"
            case "array":
                return f"{self.parts[0].text}[{self.size}]"
            case "list":
                return f"{self.parts[0].text}[]"
            case "tuple":
                return "(" + ",".join(p.text for p in self.parts) + ")"
        return self.kind

    @property
    def dynamic(self) -> bool:
        return self.kind in ("bytes", "string", "list") or any(p.dynamic for p in self.parts)

    @property
    def words(self) -> int:
        """Words in the head; a dynamic type has its offset there."""
        if self.dynamic:
            return 1
        if self.kind == "array":
            return self.size * self.parts[0].words
        return sum(p.words for p in self.parts) if self.kind == "tuple" else 1

    @property
    def primitive(self) -> bool:
        return self.kind not in ("array", "list", "tuple", "bytes", "string")


def _split(text: str) -> list[str]:
    """The parts between commas that stand outside brackets."""
    parts, depth, start = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c == "," and depth == 0:
            parts.append(text[start:k])
            start = k + 1
    return [*parts, text[start:]]


def parse_type(text: str) -> AbiType:
    text = text.strip()
    if text.endswith("]"):
        start = text.rfind("[")
        inside = text[start + 1 : -1]
        if start <= 0 or (inside and not inside.isdecimal()):
            raise SignatureError(f"unsupported type `{text}`")
        element = parse_type(text[:start])
        return AbiType("array", int(inside), (element,)) if inside else AbiType("list", 0, (element,))
    if text.startswith("(") and text.endswith(")"):
        return AbiType("tuple", 0, tuple(parse_type(p) for p in _split(text[1:-1])))
    text = _ALIASES.get(text, text)
    if text in ("address", "bool", "bytes", "string"):
        return AbiType(text)
    if m := re.fullmatch(r"(uint|int|bytes)(\d+)", text):
        n = int(m[2])
        if m[1] == "bytes" and 1 <= n <= 32:
            return AbiType("fixed", n)
        if m[1] != "bytes" and 8 <= n <= 256 and n % 8 == 0:
            return AbiType(m[1], n)
    raise SignatureError(f"unsupported type `{text}`")


@dataclass(frozen=True)
class Param:
    name: str
    type: AbiType
    indexed: bool
    place: int  # the topic's number from 1, or the byte offset in the data


@dataclass(frozen=True)
class ParsedEvent:
    name: str
    params: tuple[Param, ...]

    @property
    def canonical(self) -> str:
        return f"{self.name}({','.join(p.type.text for p in self.params)})"

    @cached_property
    def topic0(self) -> bytes:
        return keccak256(self.canonical.encode())

    def param(self, name: str) -> Param:
        for p in self.params:
            if p.name == name and name:
                return p
        known = ", ".join(p.name for p in self.params if p.name) or "none"
        raise SignatureError(f"event `{self.name}` has no parameter `{name}`; it has: {known}")


def _parse_param(part: str) -> tuple[str, AbiType, bool]:
    depth, end = 0, len(part)
    for k, c in enumerate(part):
        depth += (c in "([") - (c in ")]")
        if c.isspace() and depth == 0:
            end = k
            break
    kind, rest = parse_type(part[:end]), part[end:].split()
    if len(rest) > 2:
        raise SignatureError(f"parameter `{part}` has too many tokens, expected TYPE [indexed] [NAME]")
    if len(rest) == 2 and rest[0] != "indexed":
        raise SignatureError(f"expected `indexed` after the type in `{part}`")
    indexed = rest[:1] == ["indexed"]
    name = rest[-1] if len(rest) > indexed else ""
    if name and not _NAME.fullmatch(name):
        raise SignatureError(f"argument name `{name}` is not an identifier")
    return name, kind, indexed


def parse_event(signature: str) -> ParsedEvent:
    """`Name(TYPE [indexed] [NAME], ...)`"""
    if not signature:
        raise SignatureError("empty signature")
    name, opened, inner = signature.partition("(")
    if not opened:
        raise SignatureError(f"`{signature}`: missing `(`")
    if not inner.endswith(")"):
        raise SignatureError(f"`{signature}`: must end with `)`")
    name = name.strip()
    if not name:
        raise SignatureError(f"`{signature}`: missing event name")
    if not _NAME.fullmatch(name):
        raise SignatureError(f"`{signature}`: event name `{name}` is not an identifier")
    params: list[Param] = []
    topic = offset = 0
    for part in _split(inner[:-1]) if inner[:-1].strip() else []:
        if not part.strip():
            raise SignatureError(f"`{signature}`: empty parameter")
        arg, kind, indexed = _parse_param(part.strip())
        if arg and any(p.name == arg for p in params):
            raise SignatureError(f"`{signature}`: duplicate argument name `{arg}`")
        if indexed:
            topic += 1
            if topic > 3:
                raise SignatureError(f"`{signature}`: more than 3 indexed arguments")
            params.append(Param(arg, kind, True, topic))
        else:
            params.append(Param(arg, kind, False, offset))
            offset += WORD * kind.words
    return ParsedEvent(name, tuple(params))


ZERO = bytes(WORD)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: an expression that is written twice nests its copies, and runs in each."""
    return F.get(F.transform(F.array(value), body), 0)


def word_at(data: Column, offset: Column | int) -> Column:
    """The word at a byte offset, zero where the data does not hold all of it."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    whole = F.octet_length(data) >= offset + WORD
    return F.when(whole & (offset >= 0), F.call_function("substring", data, offset.cast("int") + 1, F.lit(WORD))).otherwise(F.lit(ZERO))


def topic_at(topics: Column, k: int) -> Column:
    return F.coalesce(F.get(topics, k), F.lit(ZERO))


def _small(word: Column) -> Column:
    """A word as a long, null where it does not fit 31 bits: an offset or a length."""
    def low(w: Column) -> Column:
        fits = (F.call_function("substring", w, F.lit(1), F.lit(28)) == F.lit(bytes(28))) & (F.call_function("substring", w, F.lit(29), F.lit(1)) < F.lit(b"\x80"))
        return F.when(fits, F.conv(F.hex(F.call_function("substring", w, F.lit(29), F.lit(4))), 16, 10).cast("long"))

    return bound(word, low)


def decode_word(word: Column, t: AbiType) -> Column:
    """A primitive from its word. Numbers of up to 56 bits are longs, up to 120 bits decimals, else 32-byte words."""
    part = lambda a, n: F.call_function("substring", word, F.lit(a), F.lit(n))
    match t.kind:
        case "address":
            return part(13, 20)
        case "bool":
            return part(32, 1) != F.lit(b"\x00")
        case "fixed":
            return part(1, t.size)
        case "uint" | "int":
            return u256.narrow(word, t.size, t.kind == "int")
    raise SignatureError(f"`{t.text}` is no primitive")


def _static(data: Column, offset: Column, t: AbiType) -> Column:
    if t.primitive:
        return decode_word(word_at(data, offset), t)
    if t.dynamic:
        raise SignatureError(f"nested dynamic type `{t.text}` is not decoded")
    if t.kind == "array":
        step = WORD * t.parts[0].words
        return F.array(*[_static(data, offset + k * step, t.parts[0]) for k in range(t.size)])
    fields, at = [], 0
    for k, p in enumerate(t.parts):
        fields.append(_static(data, offset + at, p).alias(f"_{k}"))
        at += WORD * p.words
    return F.struct(*fields)


def decode_value(data: Column, offset: int, t: AbiType) -> Column:
    """A value of the data whose head is at the offset."""
    if t.primitive:
        return decode_word(word_at(data, offset), t)
    if not t.dynamic:
        return bound(data, lambda d: _static(d, F.lit(offset), t))
    if t.kind not in ("bytes", "string", "list") or (t.kind == "list" and t.parts[0].dynamic):
        raise SignatureError(f"nested dynamic type `{t.text}` is not decoded")

    def tail(d: Column, start: Column, n: Column) -> Column:
        room = F.octet_length(d) - start - WORD
        if t.kind == "list":
            step = WORD * t.parts[0].words
            many = F.greatest(F.coalesce(F.least(n, F.floor(room / step)), F.lit(0)), F.lit(0))
            places = bound(many, lambda m: F.when(m > 0, F.sequence(F.lit(0), m.cast("int") - 1)).otherwise(F.expr("cast(array() as array<int>)")))
            return F.transform(places, lambda k: bound(start + WORD + k * step, lambda at: _static(d, at, t.parts[0])))
        raw = F.when((room >= n) & (room >= 0), F.call_function("substring", d, (start + WORD + 1).cast("int"), n.cast("int"))).otherwise(F.lit(b""))
        return raw.cast("string") if t.kind == "string" else raw

    return bound(data, lambda d: bound(_small(word_at(d, offset)), lambda start: bound(_small(word_at(d, start)), lambda n: tail(d, start, n))))


def decode_param(event: ParsedEvent, name: str, topics: Column, data: Column) -> Column:
    p = event.param(name)
    if not p.indexed:
        return decode_value(data, p.place, p.type)
    if not p.type.primitive:
        raise SignatureError(f"indexed parameter `{name}` of type `{p.type.text}` holds a hash")
    return decode_word(topic_at(topics, p.place), p.type)


def param_word(event: ParsedEvent, name: str, topics: Column, data: Column) -> Column:
    """The 32-byte word of a parameter as it stands in the topics or the data's head."""
    p = event.param(name)
    return topic_at(topics, p.place) if p.indexed else word_at(data, p.place)


def param_address(event: ParsedEvent, name: str, topics: Column, data: Column) -> Column:
    return F.call_function("substring", param_word(event, name, topics, data), F.lit(13), F.lit(20))


def decode_event(event: ParsedEvent, topics: Column, data: Column) -> Column:
    """A struct of the named parameters."""
    return F.struct(*[decode_param(event, p.name, topics, data).alias(p.name) for p in event.params if p.name])


def indexed_address(topics: Column, i: int) -> Column:
    return F.call_function("substring", topic_at(topics, i + 1), F.lit(13), F.lit(20))


def data_word(data: Column, k: int) -> Column:
    return word_at(data, WORD * k)


def data_address(data: Column, k: int) -> Column:
    return F.call_function("substring", data_word(data, k), F.lit(13), F.lit(20))


def event_id(block: Column, tx: Column, log: Column) -> Column:
    """16 bytes that sort in log order: block as 8 bytes, transaction and log as 4 each."""
    part = lambda c, n: F.lpad(F.hex(c.cast("long")), n, "0")
    return F.unhex(F.concat(part(block, 16), part(tx, 8), part(log, 8)))


def unpack_event_id(key: Column) -> Column:
    part = lambda a, n: F.conv(F.hex(F.call_function("substring", key, F.lit(a), F.lit(n))), 16, 10).cast("long")
    return F.struct(part(1, 8).alias("block_number"), part(9, 4).alias("tx_index"), part(13, 4).alias("log_index"))


def encode_arg(value: int | bool | bytes | str) -> bytes:
    """A literal as an ABI word: integers and addresses right-aligned, other bytes left-aligned."""
    if isinstance(value, bool):
        return int(value).to_bytes(WORD, "big")
    if isinstance(value, int):
        return (value % (1 << 256)).to_bytes(WORD, "big")
    if isinstance(value, str):
        value = bytes.fromhex(value.removeprefix("0x"))
    if len(value) > WORD:
        raise SignatureError(f"an argument of {len(value)} bytes is longer than a word")
    return value.rjust(WORD, b"\0") if len(value) == 20 else value.ljust(WORD, b"\0")


def decode_returns(value: Column, *types: str) -> Column:
    """(ok, v0, v1, ...) from a call's return bytes: here short or malformed data is an error, ok false and nulls."""
    parsed = [parse_type(t) for t in types]
    if any(t.dynamic for t in parsed):
        return bound(value, lambda v: _returns(v, parsed))
    return _returns(value, parsed)


def _returns(value: Column, parsed: list[AbiType]) -> Column:
    def whole(at: int, t: AbiType) -> Column:
        """Whether the value holds a dynamic type's tail."""
        step = WORD * t.parts[0].words if t.kind == "list" else 1
        return bound(_small(word_at(value, at)), lambda start: F.octet_length(value) >= start + WORD + _small(word_at(value, start)) * step)

    at, fields, ok = 0, [], F.lit(True)
    for t in parsed:
        ok = ok & (F.octet_length(value) >= at + WORD * t.words)
        if t.kind in ("bytes", "string", "list"):
            ok = ok & F.coalesce(whole(at, t), F.lit(False))
        fields.append(decode_value(value, at, t))
        at += WORD * t.words
    return bound(F.coalesce(ok, F.lit(False)), lambda fine: F.struct(fine.alias("ok"), *[F.when(fine, f).alias(f"v{k}") for k, f in enumerate(fields)]))
