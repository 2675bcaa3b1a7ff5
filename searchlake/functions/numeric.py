"""Sortable integers of floats, prefix codes of numbers, and IP ranges."""

from __future__ import annotations

import ipaddress
import struct


def sortable(value: float) -> int:
    """A signed 64-bit integer that orders as the float does."""
    (bits,) = struct.unpack(">q", struct.pack(">d", value))
    return bits ^ 0x7FFFFFFFFFFFFFFF if bits < 0 else bits


def unsortable(bits: int) -> float:
    return struct.unpack(">d", struct.pack(">q", bits ^ 0x7FFFFFFFFFFFFFFF if bits < 0 else bits))[0]


def prefix_code(value: int, shift: int = 0) -> bytes:
    """A shift byte and seven bits a byte of what the shift leaves."""
    rest = ((value & 0xFFFFFFFFFFFFFFFF) ^ (1 << 63)) >> shift
    groups = (63 - shift) // 7 + 1
    return bytes([0x20 + shift, *[rest >> 7 * i & 0x7F for i in reversed(range(groups))]])


def decode_prefix(code: bytes) -> tuple[int, int]:
    """(value, shift); the bits below the shift are zero."""
    shift = code[0] - 0x20
    rest = 0
    for b in code[1:]:
        if b > 0x7F:
            raise ValueError("not a prefix code")
        rest = rest << 7 | b
    value = ((rest << shift) & 0xFFFFFFFFFFFFFFFF) ^ (1 << 63)
    return value - (1 << 64) if value >= 1 << 63 else value, shift


def interleave(a: int, b: int) -> int:
    """Bits of a at even places, of b at odd ones."""
    return sum((a >> i & 1) << 2 * i | (b >> i & 1) << (2 * i + 1) for i in range(32))


def deinterleave(code: int) -> int:
    return sum((code >> 2 * i & 1) << i for i in range(32))


def ip_bytes(text: str) -> bytes | None:
    """Sixteen bytes of an address; version 4 is mapped into version 6."""
    try:
        own = ipaddress.ip_address(text)
    except ValueError:
        return None
    return own.packed if own.version == 6 else b"\0" * 10 + b"\xff\xff" + own.packed


def ip_range(cidr: str) -> tuple[bytes, bytes]:
    """First and last address of a network, or an address twice."""
    own = ipaddress.ip_network(cidr, strict=False)
    low, high = ip_bytes(str(own[0])), ip_bytes(str(own[-1]))
    assert low and high
    return low, high
