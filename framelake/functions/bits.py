"""Bit-level reading and writing for the byte walkers."""

from __future__ import annotations

from framelake.errors import malformed


class Bits:
    """A cursor over the bits of a byte string, the highest bit of a byte first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def left(self) -> int:
        return self.end - self.at

    def u(self, n: int) -> int:
        """n bits as an unsigned number."""
        if n > self.left():
            raise malformed("the bits end early")
        if not n:
            return 0
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        chunk = int.from_bytes(self.data[first:last], "big")
        value = chunk >> (8 * last - self.at - n) & ((1 << n) - 1)
        self.at += n
        return value

    def flag(self) -> bool:
        return bool(self.u(1))

    def ue(self) -> int:
        """Exp-Golomb; 32 leading zeros never fit."""
        zeros = 0
        while not self.u(1):
            zeros += 1
            if zeros >= 32:
                raise malformed("an Exp-Golomb code is too long")
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)

    def uvlc(self) -> int:
        """AV1's variable-length number; 32 leading zeros are an error."""
        zeros = 0
        while not self.u(1):
            zeros += 1
            if zeros >= 32:
                raise malformed("a uvlc code is too long")
        return self.u(zeros) + (1 << zeros) - 1

    def su(self, n: int) -> int:
        """n bits in two's complement."""
        value = self.u(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def ns(self, n: int) -> int:
        """One of n values in the least bits."""
        if n <= 1:
            return 0
        width = n.bit_length()
        short = (1 << width) - n
        value = self.u(width - 1)
        return value if value < short else (value << 1) - short + self.u(1)

    def unary(self, most: int) -> int:
        """Ones up to a zero, or up to ``most`` of them."""
        n = 0
        while n < most and self.u(1):
            n += 1
        return n

    def egk(self, k: int) -> int:
        """Exp-Golomb of order k as arithmetic coders have it: ones count up the order."""
        value = 0
        while self.u(1):
            value += 1 << k
            k += 1
            if k > 32:
                raise malformed("an Exp-Golomb code is too long")
        return value + self.u(k)

    def rice(self, k: int, most: int = 4) -> int:
        """A prefix of up to ``most`` ones and k bits; beyond, Exp-Golomb of the next order."""
        prefix = self.unary(most)
        return (prefix << k) + self.u(k) if prefix < most else (most << k) + self.egk(k + 1)

    def align(self) -> None:
        self.at = (self.at + 7) & ~7


def leb128(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, bytes read); at most eight bytes and 32 bits of value."""
    value = 0
    for i in range(8):
        if at + i >= len(data):
            raise malformed("a leb128 value ends early")
        value |= (data[at + i] & 0x7F) << 7 * i
        if not data[at + i] & 0x80:
            if value >> 32:
                raise malformed("a leb128 value exceeds 32 bits")
            return value, i + 1
    raise malformed("a leb128 value is too long")


def put_leb128(value: int) -> bytes:
    out = bytearray()
    while True:
        low, value = value & 0x7F, value >> 7
        out.append(low | (0x80 if value else 0))
        if not value:
            return bytes(out)


class BitWriter:
    """Bits into bytes, the highest first."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def u(self, value: int, n: int) -> BitWriter:
        if value >> n:
            raise ValueError("a value does not fit its bits")
        self.value, self.n = self.value << n | value, self.n + n
        return self

    def ue(self, value: int) -> BitWriter:
        width = (value + 1).bit_length()
        return self.u(0, width - 1).u(value + 1, width)

    def se(self, value: int) -> BitWriter:
        return self.ue(2 * value - 1 if value > 0 else -2 * value)

    def unary(self, value: int, most: int) -> BitWriter:
        self.u((1 << value) - 1, value)
        return self if value == most else self.u(0, 1)

    def egk(self, value: int, k: int) -> BitWriter:
        while value >= 1 << k:
            self.u(1, 1)
            value -= 1 << k
            k += 1
        return self.u(0, 1).u(value, k)

    def rice(self, value: int, k: int, most: int = 4) -> BitWriter:
        prefix = value >> k
        if prefix < most:
            return self.unary(prefix, most).u(value & (1 << k) - 1, k)
        return self.unary(most, most).egk(value - (most << k), k + 1)

    def trailing(self) -> BitWriter:
        """A one bit and zeros to the byte's end."""
        self.u(1, 1)
        return self.u(0, -self.n % 8)

    def bytes(self) -> bytes:
        pad = -self.n % 8
        return (self.value << pad).to_bytes((self.n + pad) // 8, "big")


def strip_emulation(data: bytes) -> bytes:
    """Payload of a NAL unit: the 03 after two zeros goes."""
    out, zeros = bytearray(), 0
    for b in data:
        if zeros >= 2 and b == 3:
            zeros = 0
            continue
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def insert_emulation(data: bytes) -> bytes:
    """A 03 after two zeros wherever a byte up to 03 follows."""
    out, zeros = bytearray(), 0
    for b in data:
        if zeros >= 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)
