"""Fill-in-the-middle by piece tables.

A document's text and the sentinels are immutable buffers, and a document is a list of descriptors (buffer, start, length)
over them. Cutting splits descriptors at line ends, an arrangement permutes them and sets sentinels between, digests take
the described bytes one descriptor after another, and the inverse permutation over an output's own parts gives the text
back. Bytes are copied once, into the output.

Defined results: a null or empty text is plain, of no lines; a text that holds a sentinel is plain; a null id is hashed as
no digits; repeated rows are transformed each on its own; extra columns are ignored; an empty table gives an empty result;
a text of any length needs the memory of itself and its output; there are no ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches, bounded

#: Places of prefix, suffix and middle (0, 2, 1 of the cut text) in each form's output.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary, output_sha256 string"


@dataclass(frozen=True)
class Fim:
    """rate of 100 documents are transformed, spm of 100 of those in the order suffix, prefix, middle."""

    rate: int = 100
    spm: int = 50
    seed: int = 7
    #: Before prefix, middle and suffix.
    sentinels: tuple[str, str, str] = ("<P>", "<M>", "<S>")

    def marks(self) -> list[bytes]:
        return [s.encode() for s in self.sentinels]

    def draws(self, doc_id: int | None) -> list[int]:
        """Four numbers of 32 bits that hang on seed and id alone."""
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


Descriptor = tuple[int, int, int]


class PieceTable:
    """Descriptors over buffers that never change: buffer 0 is a text, those after it are sentinels."""

    def __init__(self, buffers: list[bytes], pieces: list[Descriptor] | None = None):
        self.buffers = buffers
        self.pieces = [(0, 0, len(buffers[0]))] if pieces is None else pieces

    def cut(self, places: Iterable[int]) -> PieceTable:
        """The same bytes with a piece's end at each place, counted in bytes from the beginning; a piece may be empty."""
        out, rest = [], list(self.pieces)
        passed = 0
        for place in places:
            while rest and passed + rest[0][2] < place:
                passed += rest[0][2]
                out.append(rest.pop(0))
            buffer, start, length = rest.pop(0)
            out.append((buffer, start, place - passed))
            rest.insert(0, (buffer, start + place - passed, length - (place - passed)))
            passed = place
        return PieceTable(self.buffers, out + rest)

    def arranged(self, order: tuple[int, ...], before: dict[int, int] | None = None) -> PieceTable:
        """Pieces in another order; before[i] is the buffer that goes, whole, before piece i."""
        out = []
        for i in order:
            if before:
                out.append((before[i], 0, len(self.buffers[before[i]])))
            out.append(self.pieces[i])
        return PieceTable(self.buffers, out)

    def views(self) -> list[memoryview]:
        return [memoryview(self.buffers[b])[s : s + n] for b, s, n in self.pieces]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.views():
            digest.update(view)
        return digest.hexdigest()

    def joined(self) -> bytes:
        return b"".join(self.views())


def _line_ends(text: bytes) -> np.ndarray:
    """Bytes before the end of each line; a last line may lack its newline."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if text.endswith(b"\n") or not text else np.append(ends, len(text))


def _code_points(text: bytes, begin: int, end: int) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8)[begin:end] & 0xC0) != 0x80))


def transformed(doc_id: int | None, text: bytes, fim: Fim) -> tuple[int, str, int | None, int | None, PieceTable]:
    """n, form, code points of prefix and middle, and the output as a table."""
    ends = _line_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = fim.draws(doc_id)
    marks = fim.marks()
    if not text or h3 % 100 >= fim.rate or any(m in text for m in marks):
        return n, "plain", None, None, PieceTable([text])
    places = [0 if k == 0 else int(ends[k - 1]) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    form = "spm" if h4 % 100 < fim.spm else "psm"
    table = PieceTable([text, *marks]).cut(places).arranged(ORDERS[form], {0: 1, 1: 2, 2: 3})
    return n, form, _code_points(text, 0, places[0]), _code_points(text, *places), table


def restored(output: bytes, form: str, fim: Fim) -> PieceTable:
    """The text's pieces within an output: sentinels are found where they stand, and the form's permutation is inverted.

    A text without sentinels can't make one with its neighbours, as a sentinel begins with a character that is nowhere
    else in it; so the first place of each is the one where it was set.
    """
    if form == "plain":
        return PieceTable([output])
    order, marks = ORDERS[form], fim.marks()
    at = [output.index(marks[i]) for i in order]
    parts = [(0, a + len(marks[i]), b - a - len(marks[i])) for a, b, i in zip(at, [*at[1:], len(output)], order, strict=True)]
    inverse = tuple(order.index(i) for i in range(3))
    return PieceTable([output], parts).arranged(inverse)


def check_sentinels(fim: Fim) -> None:
    if len(set(fim.sentinels)) != 3 or not all(fim.sentinels) or any(s[0] in t[1:] for s in fim.sentinels for t in fim.sentinels):
        raise ValueError("three different sentinels, whose first characters stand nowhere else in any of them")


def transform(docs: DataFrame, fim: Fim = Fim()) -> DataFrame:
    """n, form, prefix_chars, middle_chars, output (text) and output_sha256 for each row of docs(doc_id, text). Narrow."""
    check_sentinels(fim)

    def run(rows):
        for piece in batches(rows):
            out: dict[str, list] = {c: [] for c in ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256")}
            for doc_id, text in zip(piece["doc_id"], piece["text"], strict=True):
                n, form, before, middle, table = transformed(doc_id, text or b"", fim)
                for name, value in zip(out, (n, form, before, middle, table.joined(), table.sha256()), strict=True):
                    out[name].append(value)
            kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary(), "output_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(piece["doc_id"], pa.int64()), *(pa.array(out[c], t) for c, t in kinds.items())], names=["doc_id", *kinds])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return bounded(texts).mapInArrow(run, SCHEMA).withColumn("output", F.col("output").cast("string"))


def restore(outputs: DataFrame, fim: Fim = Fim()) -> DataFrame:
    """outputs(output, form, ...) with restored, the text that each was made of, and restored_sha256. Narrow."""
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    check_sentinels(fim)
    schema = StructType([*(StructField(f.name, BinaryType() if f.name == "output" else f.dataType) for f in outputs.schema), StructField("restored", BinaryType()), StructField("restored_sha256", StringType())])

    def run(rows):
        for r in rows:
            tables = [restored(o, form, fim) for o, form in zip(r.column("output").to_pylist(), r.column("form").to_pylist(), strict=True)]
            more = [pa.array([t.joined() for t in tables], pa.binary()), pa.array([t.sha256() for t in tables], pa.string())]
            yield pa.RecordBatch.from_arrays([*r.columns, *more], names=[*r.schema.names, "restored", "restored_sha256"])

    back = bounded(outputs.withColumn("output", F.col("output").cast("binary"))).mapInArrow(run, schema)
    return back.withColumns({c: F.col(c).cast("string") for c in ("output", "restored")})


def fill_in_middle(docs: DataFrame, fim: Fim = Fim()) -> DataFrame:
    """The transformation's figures with digests of each output and of the text rebuilt from it."""
    return restore(transform(docs, fim), fim).drop("output", "restored")
