"""Writes small SAS transport files for the tests."""

import math
import struct
from dataclasses import dataclass

BLANK_DATE = b"01JAN14:00:00:00"


@dataclass
class Column:
    name: str
    width: int
    is_text: bool
    values: list


def ibm_float(value, width=8):
    """None is the plain missing value; a one-letter text a special one."""
    if value is None:
        return (b"." + bytes(7))[:width]
    if isinstance(value, str):
        return (value.encode() + bytes(7))[:width]
    if value == 0:
        return bytes(width)
    sign, value = (0x80, -value) if value < 0 else (0, value)
    power = 0
    while value >= 1:
        value, power = value / 16, power + 1
    while value < 1 / 16:
        value, power = value * 16, power - 1
    return (bytes([sign | (power + 64)]) + int(value * 2**56).to_bytes(7, "big"))[:width]


def _pad(data):
    return data.ljust(math.ceil(len(data) / 80) * 80, b" ")


def transport_bytes(name, columns):
    def header(kind, tail=b"0" * 30):
        return (b"HEADER RECORD*******" + kind + b"HEADER RECORD!!!!!!!" + tail).ljust(80)

    out = header(b"LIBRARY ")
    out += (b"SAS     SAS     SASLIB  9.4     LINUX   " + b" " * 24 + BLANK_DATE).ljust(80)
    out += BLANK_DATE.ljust(80)
    out += header(b"MEMBER  ", b"000000000000000001600000000140")
    out += header(b"DSCRPTR ")
    member = b"SAS     " + name.upper().encode().ljust(8) + b"SASDATA 9.4     LINUX   "
    out += (member + b" " * 24 + BLANK_DATE).ljust(80)
    out += BLANK_DATE.ljust(80)
    out += header(b"NAMESTR ", b"000000%04d" % len(columns) + b"0" * 20)
    described, at = b"", 0
    for i, c in enumerate(columns):
        described += struct.pack(">hhhh8s40s8shhh2s8shhl52s", 2 if c.is_text else 1, 0, c.width,
                                 i + 1, c.name.encode().ljust(8), b" " * 40, b" " * 8, 0, 0, 0,
                                 b"  ", b" " * 8, 0, 0, at, b"\0" * 52)
        at += c.width
    out += _pad(described) + header(b"OBS     ")
    rows = b""
    for i in range(len(columns[0].values)):
        for c in columns:
            v = c.values[i]
            rows += (
                (v or "").encode("latin1").ljust(c.width)[: c.width]
                if c.is_text
                else ibm_float(v, c.width)
            )
    return out + _pad(rows)


def write_transport(path, columns):
    path.write_bytes(transport_bytes(path.stem, columns))
    return str(path)
