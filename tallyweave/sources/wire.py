"""Wire formats: headers natively, transactions and blocks in Arrow batches.

A transaction is variable in length at every level, so it is decoded in one
pass per record; headers are fixed and cut by substrings. Hashes come in wire
order, as hex.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import MAX_COMPACT, compact_size_hex, from_little_endian, little_endian_hex, sha256d, to_hex

HEADER_BYTES = 80
INPUT = "struct<prev_txid: string, prev_vout: bigint, script: string, sequence: bigint>"
OUTPUT = "struct<value: bigint, script: string>"
TX = f"txid string, wtxid string, version bigint, lock_time bigint, inputs array<{INPUT}>, outputs array<{OUTPUT}>, witness array<array<string>>, wire_size bigint"
_HEADER = (("version", 0, 4), ("prev_hash", 4, 32), ("merkle_root", 36, 32), ("time", 68, 4), ("bits", 72, 4), ("nonce", 76, 4))


def decode_header(raw: Column) -> Column:
    """STRUCT of an 80-byte header's fields and its hash (wire order); null for another length."""
    digits = to_hex(raw)
    fields = []
    for name, at, size in _HEADER:
        cut = F.substring(digits, 2 * at + 1, 2 * size)
        fields.append((cut if size == 32 else from_little_endian(cut).cast("long")).alias(name))
    return F.when(F.length(raw) == HEADER_BYTES, F.struct(*fields, to_hex(sha256d(raw)).alias("hash")))


def encode_header(version: Column, prev_hash: Column, merkle_root: Column, time: Column, bits: Column, nonce: Column) -> Column:
    """The 80 bytes; hashes as hex in wire order."""
    return F.unhex(F.concat(little_endian_hex(version, 4), prev_hash, merkle_root, little_endian_hex(time, 4), little_endian_hex(bits, 4), little_endian_hex(nonce, 4)))


class Short(ValueError):
    """The bytes end within a record."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Short(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def u32(self) -> int:
        return struct.unpack("<I", self.take(4))[0]

    def count(self) -> int:
        mark = self.take(1)[0]
        if mark < 0xFD:
            return mark
        size, least = {0xFD: (2, 0xFD), 0xFE: (4, 1 << 16), 0xFF: (8, 1 << 32)}[mark]
        n = int.from_bytes(self.take(size), "little")
        if n < least or size == 8 and n > MAX_COMPACT:
            raise ValueError("a count is not in its shortest form or is too large")
        return n


def _sha256d(data: bytes) -> str:
    return hashlib.sha256(hashlib.sha256(data).digest()).digest().hex()


def read_tx(r: _Reader) -> dict:
    """The next transaction as a row of TX."""
    begin = r.at
    version = r.u32()
    marked = r.data[r.at : r.at + 2] == b"\0\1"
    if marked:
        r.at += 2
    body = r.at
    inputs = [{"prev_txid": r.take(32).hex(), "prev_vout": r.u32(), "script": r.take(r.count()).hex(), "sequence": r.u32()} for _ in range(r.count())]
    outputs = [{"value": int.from_bytes(r.take(8), "little"), "script": r.take(r.count()).hex()} for _ in range(r.count())]
    end = r.at
    witness = [[r.take(r.count()).hex() for _ in range(r.count())] for _ in inputs] if marked else []
    lock = r.u32()
    whole = r.data[begin : r.at]
    plain = whole[:4] + r.data[body:end] + whole[-4:]
    return {"txid": _sha256d(plain), "wtxid": _sha256d(whole), "version": version, "lock_time": lock, "inputs": inputs, "outputs": outputs, "witness": witness, "wire_size": len(whole)}


def encode_tx(version: Column, inputs: Column, outputs: Column, witness: Column, lock_time: Column) -> Column:
    """A transaction's bytes, natively; witnesses only if any stack has an item."""
    sized = lambda digits: F.concat(compact_size_hex((F.length(digits) / 2).cast("long")), digits)
    listed = lambda items, one: F.concat(compact_size_hex(F.size(items)), F.array_join(F.transform(items, one), ""))
    ins = listed(inputs, lambda x: F.concat(x["prev_txid"], little_endian_hex(x["prev_vout"], 4), sized(x["script"]), little_endian_hex(x["sequence"], 4)))
    outs = listed(outputs, lambda x: F.concat(little_endian_hex(x["value"], 8), sized(x["script"])))
    marked = F.exists(witness, lambda s: F.size(s) > 0)
    stacks = F.when(marked, F.array_join(F.transform(witness, lambda s: listed(s, sized)), "")).otherwise("")
    return F.unhex(F.concat(little_endian_hex(version, 4), F.when(marked, "0001").otherwise(""), ins, outs, stacks, little_endian_hex(lock_time, 4)))


def decode_txs(rows: DataFrame, raw: str, key: str, counted: bool = False) -> DataFrame:
    """Rows of TX for each row's bytes, with key and tx_index; error is set (and the rest null) for bytes that can't be read.

    counted: the bytes are a block's body, a count and then its transactions;
    else one transaction, which must use them up.
    """
    kind = dict(rows.dtypes)[key]
    schema = f"`{key}` {kind}, tx_index int, {TX}, error string"
    names = [x.split(" ")[0] for x in ("txid", "wtxid", "version", "lock_time", "inputs", "outputs", "witness", "wire_size")]
    arrow = {
        "inputs": pa.list_(pa.struct([("prev_txid", pa.string()), ("prev_vout", pa.int64()), ("script", pa.string()), ("sequence", pa.int64())])),
        "outputs": pa.list_(pa.struct([("value", pa.int64()), ("script", pa.string())])),
        "witness": pa.list_(pa.list_(pa.string())),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[dict] = []
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found: list[dict] = []
                try:
                    r = _Reader(bytes(data or b""))
                    found = [read_tx(r) | {"key": k, "tx_index": i, "error": None} for i in range(r.count() if counted else 1)]
                    if r.at != len(r.data):
                        raise ValueError(f"{len(r.data) - r.at} bytes are left over")
                except ValueError as e:
                    found = [dict.fromkeys(names) | {"key": k, "tx_index": None, "error": str(e)}]
                out += found
            columns = [pa.array([x["key"] for x in out], b.column(0).type), pa.array([x["tx_index"] for x in out], pa.int32())]
            columns += [pa.array([x[n] for x in out], arrow.get(n, pa.string() if n in ("txid", "wtxid") else pa.int64())) for n in names]
            columns.append(pa.array([x["error"] for x in out], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "tx_index", *names, "error"])

    return rows.select(F.col(key), F.col(raw)).mapInArrow(run, schema)


#: Bytes that a payload may have; a length above is noise. And what is read at a time.
MOST_PAYLOAD, READ_BYTES = 32 << 20, 1 << 20
_FRAME_HEAD = 24


def frames_in(read: Callable[[int], bytes], magic: bytes) -> Iterator[tuple[str, bytes]]:
    """(command, payload) of the framed messages in what read(n) gives, n bytes at a time until there is nothing.

    After noise magic is looked for again, bad checksums and an unfinished end
    are dropped. No more is held than one message and what is read at a time.
    """
    held, at, ended = b"", 0, False

    def more(need: int) -> bool:
        """Whether so many bytes from at are held, read if need be."""
        nonlocal held, at, ended
        if len(held) - at < need and not ended:
            parts = [held[at:]]
            at, size = 0, len(parts[0])
            while size < need:
                data = read(max(READ_BYTES, need - size))
                if not data:
                    ended = True
                    break
                parts.append(data)
                size += len(data)
            held = b"".join(parts)
        return len(held) - at >= need

    while more(_FRAME_HEAD):
        found = held.find(magic, at)
        if found < 0:
            at = len(held) - len(magic) + 1  # the mark may go on in what is read next
            continue
        at = found
        if not more(_FRAME_HEAD):
            return
        name, size, check = struct.unpack("<12sI4s", held[at + 4 : at + _FRAME_HEAD])
        if size > MOST_PAYLOAD or not more(_FRAME_HEAD + size):
            at += 1
            continue
        payload = held[at + _FRAME_HEAD : at + _FRAME_HEAD + size]
        if hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4] != check:
            at += 1
            continue
        yield name.rstrip(b"\0").decode("ascii", "replace"), payload
        at += _FRAME_HEAD + size


def frames(stream: bytes, magic: bytes) -> Iterator[tuple[str, bytes]]:
    """The framed messages in some bytes."""
    return frames_in(io.BytesIO(stream).read, magic)


def framed(magic: bytes, command: str, payload: bytes) -> bytes:
    """A message as it is sent."""
    check = hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4]
    return magic + struct.pack("<12sI4s", command.encode("ascii"), len(payload), check) + payload
