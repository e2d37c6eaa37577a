"""Fill-in-middle transformation over a run-length encoding of character classes.

A text is encoded as its maximal runs of one class with the cumulative count of units before each run. Units are tokens
(optional white space and what follows it up to the next white space; white space at the end is a token of its own) or
single characters. In the first case the classes are white space and all else: a run that ends a token is one unit as wide
as itself, white space before a token has none. In the second the classes are the widths of characters in UTF-8, and a
run has a unit for each character. A cut after so many units is found by binary search over the cumulative counts; its
byte is the start of that run plus the units into it times their width.

Where the text is cut, and whether and how it is written, is decided by a hash of the seed and the id: the same row gets the
same result wherever it is computed.

Defined results: a null text is empty; an empty text, or one that holds a marker, is left as it is (``plain``); a null id
hashes as the seed alone; repeated rows each return a row; an empty table returns no rows; texts of any length are cut whole;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfactor.llm.common import small_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: White space of the contract, by byte; no other byte of a UTF-8 character is among them.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes of the character that a byte begins; bytes inside a character are told apart by _lead.
_WIDTH = np.array([1] * 0xC0 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10)


def _lead(raw: np.ndarray) -> np.ndarray:
    """Whether each byte begins a character."""
    return (raw & 0xC0) != 0x80


class Runs:
    """Maximal runs of a character class: where each starts, the units before it, and bytes a unit."""

    def __init__(self, text: bytes, unit: str = "token"):
        raw = np.frombuffer(text, np.uint8)
        self.size = len(raw)
        if unit == "token":
            kinds, at = _SPACE[raw], np.arange(len(raw))
        elif unit == "char":
            at = np.flatnonzero(_lead(raw))
            kinds = _WIDTH[raw[at]]
        else:
            raise ValueError(f"unit must be token or char, not {unit}")
        first = np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1]))) if len(kinds) else np.zeros(0, np.int64)
        self.starts = at[first]
        sizes = np.diff(np.append(self.starts, len(raw)))
        if unit == "token":
            units = (~kinds[first]).astype(np.int64)
            units[-1:] = 1
            self.width = sizes
        else:
            self.width = kinds[first]
            units = sizes // self.width
        self.after = np.cumsum(units)
        self.before = self.after - units

    @property
    def units(self) -> int:
        return int(self.after[-1]) if len(self.after) else 0

    def offset(self, cut: int) -> int:
        """The byte at which the first ``cut`` units end."""
        if cut <= 0:
            return 0
        run = int(np.searchsorted(self.after, cut))
        return int(self.starts[run] + (cut - self.before[run]) * self.width[run])


def draws(seed: str, key: int | None) -> list[int]:
    """Four numbers of 32 bits that decide about a row."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def rearrange(text: bytes, key: int | None, rate: int, spm: int, seed: str, unit: str) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, characters of the prefix and of the middle, the text as it is written)."""
    runs = Runs(text, unit)
    h = draws(seed, key)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return runs.units, "plain", None, None, text
    a, b = (runs.offset(c) for c in sorted(x % (runs.units + 1) for x in h[:2]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    chars = [int(np.count_nonzero(_lead(np.frombuffer(x, np.uint8)))) for x in (prefix, middle)]
    if h[3] % 100 < spm:
        return runs.units, "spm", *chars, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return runs.units, "psm", *chars, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def transform(docs: DataFrame, rate: int = 50, spm: int = 80, seed: str = "42", unit: str = "token") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of docs: of a hundred texts about ``rate`` are
    rearranged, and of a hundred of those about ``spm`` begin with the suffix."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            done = [rearrange(t, i, rate, spm, seed, unit) for i, t in zip(ids.to_pylist(), texts)]
            n, form, first, middle, out = zip(*done) if done else ((),) * 5
            longs = [pa.array(x, pa.int64()) for x in (n, first, middle)]
            yield pa.RecordBatch.from_arrays(
                [ids, longs[0], pa.array(form, pa.string()), *longs[1:], pa.array(out, pa.binary()).cast(pa.string())], names
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: str = "output", form: str = "form") -> Column:
    """The text from which transform() wrote an output. A marker stands once in it: none is in the text, and none can arise
    where a piece meets a marker, as markers begin and end with characters that they hold nowhere else."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    out = F.col(output)
    before, after = F.substring_index, lambda c, mark: F.substring_index(c, mark, -1)
    middle = after(out, m)
    rest = before(out, m, 1)
    psm = F.concat(after(before(rest, s, 1), p), middle, after(rest, s))
    spm = F.concat(after(rest, p), middle, after(before(rest, p, 1), s))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def digests(done: DataFrame) -> DataFrame:
    """transform() with the output and the text rebuilt from it as digests."""
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256")
    )
