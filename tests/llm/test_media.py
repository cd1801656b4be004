"""Many false starts of media: no longer than one, and the same findings as of each start alone."""

import struct
import time
import zlib

import pytest

from chronoview.llm import media


def png(body=b"x"):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b"\x3b"


def jpeg():
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xda" + struct.pack(">H", 2) + b"data\xff\x00more\xff\xd9"


def pdf():
    return b"%PDF-1.4\nbody\nstartxref\n9\n%%EOF"


def zipped():
    return b"PK\x03\x04" + b"file" + b"PK\x01\x02dir." + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, 8, 8, 0)


@pytest.mark.parametrize("start", [b"%PDF-", b"PK\x03\x04", b"GIF89a" + b"\x01" * 7 + b"!\x01" + b"\x01a" * 3, b"\xff\xd8\xff\xe0\x00\x04ab", b"\xff\xd8\xff\xda\x00\x02abcd", b"RIFF\x10\x00\x00\x00WAVE", b"BM", png()[:40]])
def test_four_megabytes_of_false_starts(start):
    data = start * (4_000_000 // len(start))
    began = time.time()
    found = media.Sniffer().find(data)
    assert time.time() - began < 20 and not found


def test_findings_equal_those_of_each_start_alone():
    """Real media between false starts; memory of earlier walks changes nothing."""
    parts = [b"PK\x03\x04", b"RIFFxxxxWAVE", b"GIF89a!!", b"\xff\xd8\xff\xe0\x00\x02", b"BMxx", b"\x89PNG\r\n\x1a\n", b"text, "]
    data = b"head"
    for k, whole in enumerate([png(), gif(), jpeg(), pdf(), zipped(), media.wav(b"abcd" * 8)]):
        data += parts[k] + parts[(k + 3) % 7] + b" " * 30 + whole + b"tail"
    alone = []
    covered = 0
    for at in range(len(data)):
        for magic, kind, check in media.FORMATS:
            if at >= covered and data.startswith(magic, at) and (size := check(media.Value(data), at)):
                alone.append((kind, at, size))
                covered = at + size
    assert media.Sniffer().find(data) == alone
    assert {k for k, _, _ in alone} >= {"image/png", "image/gif", "image/jpeg", "application/pdf", "application/zip", "audio/wav"}
